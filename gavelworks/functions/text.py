"""Text lengths, presence flags and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual English stopword list.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Output name by source column.
TEXT_LENGTHS = {
    "item_title": "item_title_length",
    "item_description": "item_description_length",
    "enriched_item_title": "item_enriched_title_length",
    "enriched_item_description": "item_enriched_description_length",
    "enriched_item_qualitativeDescription": "item_enriched_qualitative_description_length",
}
PRESENCE_FLAGS = {
    "enriched_item_brand": "item_has_brand",
    "enriched_item_seriesLine": "item_has_series_line",
}


def is_populated(text: Column, placeholders: Sequence[str] = ("", "nan", "None")) -> Column:
    """1 when the text is there and is not one of the placeholder spellings of nothing."""
    return (text.isNotNull() & ~F.coalesce(text, F.lit("")).isin(*placeholders)).cast("int")


def text_length_columns(df: DataFrame) -> dict[str, Column]:
    """Lengths of the texts ``df`` has."""
    return {
        out: F.length(F.coalesce(F.col(source).cast("string"), F.lit("")))
        for source, out in TEXT_LENGTHS.items()
        if source in df.columns
    }


def presence_columns(df: DataFrame) -> dict[str, Column]:
    return {
        out: is_populated(F.col(source).cast("string"))
        for source, out in PRESENCE_FLAGS.items()
        if source in df.columns
    }


def add_text_lengths(df: DataFrame) -> DataFrame:
    """A text that has no column counts as empty."""
    return df.withColumns(dict.fromkeys(TEXT_LENGTHS.values(), F.lit(0)) | text_length_columns(df))


def add_presence_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(dict.fromkeys(PRESENCE_FLAGS.values(), F.lit(0)) | presence_columns(df))


def add_partner_flag(df: DataFrame) -> DataFrame:
    source = "auction_partner_url"
    populated = is_populated(F.col(source), ("", "nan")) if source in df.columns else F.lit(0)
    return df.withColumn("auction_has_partner", populated)


def normalise(text: Column) -> Column:
    """Lower-cased, trimmed text; NULL becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)^\s+|\s+$", "")


# ASCII without what opens markup, links, addresses and hyphens: in such texts a token is a run of word characters.
PLAIN = r"^[\x00-\x7F&&[^<:@-]]*\z"


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS, remove_numbers: bool = True) -> Column:
    """Lower-case tokens without markup, links, addresses, punctuation, stopwords and single letters.

    Hyphens inside words stay. NULL or blank text gives an empty array. Plain
    texts, see ``PLAIN``, are split once and give what the patterns give.
    """
    lower = F.lower(F.coalesce(text, F.lit("")))
    # Patterns in the order in which they are blanked out.
    steps = [
        (r"<[^>]+>", " "),
        (r"(?U)https?://\S+", " "),
        (r"(?U)\S+@\S+", " "),
        (r"(?U)[^\w\s-]", " "),
        (r"(?U)\s-\s", " "),
        (r"^-|-$", " "),
    ]
    if remove_numbers:
        steps.append((r"(?U)\b\d+\b", " "))
    clean = lower
    for pattern, replacement in steps:
        clean = F.regexp_replace(clean, pattern, replacement)
    between = r"(?:[^a-z0-9_]|\b[0-9]+\b)+" if remove_numbers else r"[^a-z0-9_]+"
    spaced = F.when(lower.rlike(PLAIN), F.regexp_replace(lower, between, " ")).otherwise(
        F.regexp_replace(clean, r"(?U)\s+", " ")
    )
    # Split at one plain character: any other pattern is compiled anew for every row.
    words = F.split(spaced, " ")
    keep = list(stopwords)
    if keep:
        return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*keep))
    return F.filter(words, lambda w: F.length(w) > 1)


def title_and_description_tokens(
    title: Column, description: Column, stopwords: Sequence[str] = STOPWORDS
) -> Column:
    return F.concat(tokens(title, stopwords), tokens(description, stopwords))


def combined_text(title: Column, description: Column) -> Column:
    return F.concat_ws(" [SEP] ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))


def word_count(text: Column) -> Column:
    """Whitespace-separated words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != ""))


def clean_level(name: str, lower: bool = False) -> str:
    """Column-name form of a category level."""
    for mark in " /-":
        name = name.replace(mark, "_")
    return name.lower() if lower else name
