"""Main text of web pages by site template removal.

Every page becomes blocks of text and hashes of its element subtrees. Spark counts the subtrees of each host; those that
recur across many of its pages are its template, and their text is deleted. Pages that are copies of each other count
once, so an article that was published often is no template. Elements that say what they are (navigation, adverts,
forms, reader comments and the like, by tag or by class) go too, as menus may differ on every page, but not wrappers of
the story with such names; and of a page whose article is marked and holds the story, only the article is kept.
Paragraphs inside such an article are never template.

Defined results: null and empty html give the empty text. A null url has the empty host. Rows that repeat are pages of
their own in the result and copies of each other in the counts. An empty table gives an empty result. Only the three
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.html_blocks import read_page
from gavelworks.llm.url_filter import host_of
from gavelworks.session import written

# A subtree is template when this share of its host's pages has it, and at least so many.
SHARE = 0.3
LEAST_PAGES = 4


def _parsed(pages: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                found = [read_page(source) for source in part.column("html").to_pylist()]
                columns = [
                    part.column("page_id"),
                    part.column("url"),
                    part.column("host"),
                    pa.array([p.digest for p in found], pa.int64()),
                    pa.array([p.units for p in found], pa.list_(pa.int64())),
                    pa.array([[b.text for b in p.blocks] for p in found], pa.list_(pa.string())),
                    pa.array([[b.owners for b in p.blocks] for p in found], pa.list_(pa.list_(pa.int64()))),
                ]
                yield pa.record_batch(columns, names="page_id url host digest units blocks owners".split())

    id_type = pages.schema["page_id"].dataType.simpleString()
    kinds = f"page_id {id_type}, url string, host string, digest long, units array<long>, blocks array<string>"
    return pages.mapInArrow(parse, kinds + ", owners array<array<long>>")


def templates(parsed: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """``host, unit`` of the subtrees that recur."""
    distinct = parsed.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    units = parsed.select("host", "digest", F.explode("units").alias("unit")).distinct()
    counts = units.groupBy("host", "unit").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counts.join(distinct, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "unit")


def main_text(
    pages: DataFrame,
    share: float = SHARE,
    least: int = LEAST_PAGES,
    page_id: str = "page_id",
    url: str = "url",
    source: str = "html",
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    pages = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    parsed = _parsed(pages.withColumn("host", host_of(F.col("url"))))
    # Numbered as it is written, so that rows have a key whatever their ids.
    parsed = written(parsed.withColumn("row", F.monotonically_increasing_id()), "pages")
    site = written(templates(parsed, share, least), "templates")
    # Only blocks inside a counted subtree can be template; other pages need no join.
    owned = F.exists("owners", lambda o: F.size(o) > 0)
    sure = parsed.filter(~owned).select("page_id", "url", "blocks")
    unsure = parsed.filter(owned)
    hits = (
        unsure.select("row", "host", F.explode(F.array_distinct(F.flatten("owners"))).alias("unit"))
        .join(site, ["host", "unit"])
        .groupBy("row")
        .agg(F.collect_set("unit").alias("gone"))
    )
    both = F.arrays_zip("blocks", "owners")
    stay = F.filter(both, lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["owners"], F.col("gone")))
    judged = unsure.join(hits, "row", "left").select("page_id", "url", F.transform(stay, lambda b: b["blocks"]).alias("blocks"))
    text = F.array_join("blocks", "\n\n")
    return sure.unionByName(judged).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
