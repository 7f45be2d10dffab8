"""Registered queries of the subpackage and the SQL they must agree with."""

from __future__ import annotations

import uuid

import corpus_pipeline
from pyspark.sql import functions as F

from gavelworks.llm import conversations_sql
from gavelworks.llm.conversations import damaged, repair_conversations
from gavelworks.llm.digest_index import DigestIndex
from gavelworks.llm.jaccard_join import jaccard_components
from gavelworks.llm.language_id import identify
from gavelworks.llm.media import payload, read_media, store_texts
from gavelworks.llm.mixture import mix
from gavelworks.llm.page_text import main_text
from gavelworks.llm.phrases import collocations
from gavelworks.llm.phrases_sql import collocations_sql
from gavelworks.llm.pieces import decode, encode
from gavelworks.llm.private_data import BASE, KINDS, described, find_private_data
from gavelworks.llm.private_data_sql import private_data_sql
from gavelworks.llm.token_counts import count_tokens
from gavelworks.llm.toxicity import fold, score_toxicity
from gavelworks.llm.url_filter import Rule, judge
from gavelworks.llm.url_filter_sql import url_filter_sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_page_text")
def op1_page_text(spark, folder):
    return main_text(table(spark, folder, "pages"))


@query("op2_private_data", private_data_sql())
def op2_private_data(spark, folder):
    found = find_private_data(table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    kinds = F.transform("spans", lambda s: s["kind"])
    # Removing a kind from the list tells how often it is there.
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{KINDS[i].name}") for i in range(BASE)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(described(base), 256).alias("base_sha256"),
        described(F.col("spans")).alias("spans"),
    )


@query("op3_jaccard_join")
def op3_jaccard_join(spark, folder):
    return jaccard_components(table(spark, folder, "documents"), words=4, per_hundred=85).drop("key")


@query("op4_pieces")
def op4_pieces(spark, folder):
    """Every text to tokens and back; the tokens' digest is over their decimal ids, joined by blanks."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    both = decode(encode(docs).withColumn("n_tokens", F.size("tokens").cast("long")))
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query("op5_media")
def op5_media(spark, folder):
    """Texts stored as JPEG images; everything but the sizes of text and media comes from the images read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    rows = read_media(store_texts(docs).drop("text")).withColumn("payload", payload())
    size = F.octet_length("payload")
    one = lambda i: F.concat_ws(":", F.concat_ws("x", i["across"] * 8, i["down"] * 8), i["hash"])
    return rows.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("images", one), ",").alias("feature"),
    )


@query("op6_language_id")
def op6_language_id(spark, folder):
    return identify(table(spark, folder, "documents"))


RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


@query("op7_url_filter", url_filter_sql(RULES))
def op7_url_filter(spark, folder):
    """Outcomes are the labels of the same number: a page is bad where its label says toxic."""
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return judge(table(spark, folder, "pages"), outcomes, RULES)


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_source_mix")
def op9_source_mix(spark, folder):
    return mix(table(spark, folder, "documents"))[0].drop("key", "passes")


@query(
    "op10_digest_index",
    f"""WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
        FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
          doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
)
def op10_digest_index(spark, folder):
    """Every document against a new index, which is dropped when all rows are decided."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    rows = index.deduplicate(table(spark, folder, "documents"), "first")
    index.drop()
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


MOST_TOKENS = 2048


@query("op11_token_counts")
def op11_token_counts(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > MOST_TOKENS).alias("over_limit"),
    )


@query("op12_conversation_repair", conversations_sql.SQL)
def op12_conversation_repair(spark, folder):
    rows = table(spark, folder, "conversations")
    return repair_conversations(damaged(rows), rows)


@query("op13_phrases", collocations_sql())
def op13_phrases(spark, folder):
    return collocations(table(spark, folder, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
