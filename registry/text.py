"""Text, vectors, predictions and splits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gavelworks.functions.text import STOPWORDS, normalise, tokens
from gavelworks.operators import embeddings, joins, predictions, splits, subwords
from gavelworks.session import shared_dir, spread, written
from gavelworks.sources import bindings
from registry.common import ITEMS, ORACLE, query, r, rounded, with_

# ---------------------------------------------------------------- tokens

STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
# Word characters and blanks as Python sees them: letters and digits of every script.
WORD = r"\pL\pN\pM_"
BLANK = r"\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{1680}"


def token_sql(text: str, numbers: bool = True) -> str:
    clean = f"lower(coalesce({text}, ''))"
    for pattern in (
        "<[^>]+>",
        f"https?://[^{BLANK}]+",
        f"[^{BLANK}]+@[^{BLANK}]+",
        f"[^{WORD}{BLANK}-]",
        f"[{BLANK}]-[{BLANK}]",
        "^-|-$",
    ):
        clean = f"regexp_replace({clean}, '{pattern}', ' ', 'g')"
    if not numbers:
        # A match takes the blank or hyphen after it, so neighbours need a second pass.
        for _ in range(2):
            clean = f"regexp_replace({clean}, '(^|[{BLANK}-])\\p{{Nd}}+([{BLANK}-]|$)', '\\1 \\2', 'g')"
    split = f"regexp_split_to_array(regexp_replace({clean}, '[{BLANK}]+', ' ', 'g'), ' ')"
    return f"list_filter({split}, lambda w: length(w) > 1 AND w NOT IN ({STOP}))"



@query(
    "document_token_counts",
    f"""SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({token_sql("text", numbers=False)}) AS word FROM documents) t
        GROUP BY 1, 2""",
)
def document_token_counts(spark, folder):
    """Tokens of every whole document, counted per language and word."""
    texts = spread(bindings.table(spark, folder, "documents"))
    words = texts.select("lang", F.explode(tokens(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


@query(
    "document_tokens_with_numbers",
    f"""SELECT doc_id, len(w) AS tokens, list_aggregate(w, 'string_agg', ' ') AS text
        FROM (SELECT doc_id, {token_sql("text")} AS w FROM documents) t""",
)
def document_tokens_with_numbers(spark, folder):
    texts = spread(bindings.table(spark, folder, "documents"))
    out = texts.select("doc_id", tokens(F.col("text"), remove_numbers=False).alias("w"))
    return out.select("doc_id", F.size("w").cast("long").alias("tokens"), F.nullif(F.array_join("w", " "), F.lit("")).alias("text"))


@query(
    "page_tokens_with_numbers",
    f"""SELECT page_id, len(w) AS tokens, list_aggregate(w, 'string_agg', ' ') AS text
        FROM (SELECT page_id, {token_sql("html")} AS w FROM pages) t""",
)
def page_tokens_with_numbers(spark, folder):
    pages = spread(bindings.table(spark, folder, "pages"))
    out = pages.select("page_id", tokens(F.col("html"), remove_numbers=False).alias("w"))
    return out.select("page_id", F.size("w").cast("long").alias("tokens"), F.nullif(F.array_join("w", " "), F.lit("")).alias("text"))


@query("normalised_texts", "SELECT conv_id, turn, regexp_replace(regexp_replace(lower(coalesce(text, '')), '^\\s+', ''), '\\s+$', '') AS text FROM conversations")
def normalised_texts(spark, folder):
    talks = bindings.table(spark, folder, "conversations")
    return talks.select("conv_id", "turn", normalise(F.col("text")).alias("text"))


# Titles and descriptions are plain words, so splitting on blanks is the whole rule.
ITEM_TOKENS = """
words AS (SELECT item_id, auction_id, list_filter(list_concat(
    string_split(lower(replace(coalesce(item_title, ''), '#', ' ')), ' '),
    string_split(lower(replace(coalesce(item_description, ''), '#', ' ')), ' ')),
    lambda w: length(w) > 1 AND NOT regexp_full_match(w, '[0-9]+')) AS w FROM items)
"""


@query("item_tokens", with_(ITEMS, ITEM_TOKENS) + "SELECT item_id, len(w) AS tokens, coalesce(array_to_string(w, ' '), '') AS text FROM words")
def item_tokens(spark, folder):
    out = embeddings.item_tokens(bindings.items(spark, folder))
    return out.select("item_id", F.size("tokens").cast("long").alias("tokens"), F.array_join("tokens", " ").alias("text"))


@query(
    "item_corpus_size",
    with_(ITEMS, ITEM_TOKENS) + "SELECT count(*) FILTER (len(w) > 0) AS documents, count(*) FILTER (len(w) = 0) AS empty FROM words",
)
def item_corpus_size(spark, folder):
    return embeddings.empty_texts(embeddings.item_tokens(bindings.items(spark, folder)))


@query(
    "item_term_weights",
    with_(ITEMS, ITEM_TOKENS)
    + f"""SELECT item_id, term, tf, {r("tf * ln((SELECT count(*) + 1 FROM items) / (count(*) OVER (PARTITION BY term) + 1))", "tfidf")}
      FROM (SELECT item_id, unnest(w) AS term, count(*) AS tf FROM words GROUP BY 1, 2) t""",
)
def item_term_weights(spark, folder):
    out = embeddings.term_weights(embeddings.item_tokens(bindings.items(spark, folder)), "item_id")
    return rounded(out.select("item_id", "term", "tf", "tfidf"), "item_id", "term")


# --------------------------------------------------------------- vectors


def word_table(spark, folder):
    """A vector for every word of the part names: that of the embedding with the word's length and first part."""
    parts = bindings.table(spark, folder, "part").select(F.explode(tokens(F.col("p_name"))).alias("word"), "p_partkey")
    first = parts.groupBy("word").agg((F.min("p_partkey") % 200).alias("vec_id"))
    vectors = bindings.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return first.join(vectors, "vec_id").select("word", "vector")


WORD_TABLE = """
vocabulary AS (SELECT word, embedding AS vector FROM (
    SELECT word, min(p_partkey) % 200 AS vec_id FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey FROM part) t
    GROUP BY word) f JOIN embeddings USING (vec_id))
"""


@query(
    "item_vectors",
    with_(ITEMS, ITEM_TOKENS, WORD_TABLE)
    + f"""SELECT item_id, count(*) AS dimensions, {r("sum(value::DOUBLE)", "total", 4)}, {r("sum(value::DOUBLE * pos)", "weighted", 4)}
      FROM (SELECT item_id, pos, coalesce(v, 0)::FLOAT AS value FROM (SELECT item_id, unnest(range(1, 65)) AS pos FROM items) a
      LEFT JOIN (SELECT item_id, pos, avg(x) AS v FROM (
        SELECT item_id, unnest(range(1, 65)) AS pos, unnest(vector)::DOUBLE AS x
        FROM (SELECT item_id, unnest(w) AS word FROM words) t JOIN vocabulary USING (word)) y GROUP BY 1, 2) z USING (item_id, pos)) q
      GROUP BY 1""",
)
def item_vectors(spark, folder):
    listed = embeddings.item_tokens(bindings.items(spark, folder))
    return vector_sums(embeddings.document_vectors(listed, word_table(spark, folder), dimensions=64))


def vector_sums(out):
    values = F.col("embedding").cast("array<double>")
    add = lambda s, x: s + x
    total = F.aggregate(values, F.lit(0.0), add)
    weighted = F.aggregate(F.transform(values, lambda x, i: x * (i + 1)), F.lit(0.0), add)
    return rounded(
        out.select("item_id", F.size("embedding").alias("dimensions"), total.alias("total"), weighted.alias("weighted")),
        "item_id",
        digits=4,
    )


@query(
    "nearest_words",
    with_(WORD_TABLE)
    + f"""SELECT word, neighbour, {r("similarity", "similarity", 5)}, rank FROM (
      SELECT a.word, b.word AS neighbour, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS similarity,
        row_number() OVER (PARTITION BY a.word ORDER BY list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) DESC, b.word) AS rank
      FROM vocabulary a JOIN vocabulary b ON a.word <> b.word WHERE a.word IN ('small', 'red', 'widget')) t WHERE rank <= 5""",
)
def nearest_words(spark, folder):
    out = embeddings.nearest_words(word_table(spark, folder), ["small", "red", "widget"], 5)
    return rounded(out, "word", "neighbour", digits=5)


@query(
    "item_vectors_by_join",
    ORACLE["item_vectors"],
)
def item_vectors_by_join(spark, folder):
    """The way for vocabularies too large to send to every worker."""
    listed = embeddings.item_tokens(bindings.items(spark, folder))
    out = embeddings.document_vectors(listed, word_table(spark, folder), dimensions=64, broadcast_bytes=0)
    return vector_sums(out)


@query("resumed_item_vectors", ORACLE["item_vectors"])
def resumed_item_vectors(spark, folder):
    """Vectors of the items up to the middle order, then a second run over all items that adds the others."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    listed, words = bindings.items(spark, folder), word_table(spark, folder)
    middle = bindings.table(spark, folder, "orders").agg(F.max("o_orderkey") / 2).first()[0]
    embeddings.embed_new_items(listed.filter(F.col("auction_id") <= middle), words, None, path, 64)
    done = spark.read.parquet(path)
    embeddings.embed_new_items(listed, words, done, path, 64)
    return vector_sums(spark.read.schema(done.schema).parquet(path))


@query(
    "item_features_with_vectors",
    f"""SELECT i.item_id, i.title_length, v.dimensions, v.total, v.weighted FROM (
        {with_(ITEMS)} SELECT item_id, CAST(length(coalesce(item_title, '')) AS BIGINT) AS title_length FROM items WHERE item_id % 3 <> 0) i
      JOIN ({ORACLE["item_vectors"]}) v USING (item_id) WHERE i.item_id % 5 <> 0""",
)
def item_features_with_vectors(spark, folder):
    """Item features beside the vectors of their texts; items that only one side has are left out."""
    listed = bindings.items(spark, folder)
    # Items that lack on one side are there under numbers that no item has.
    moved = lambda k: F.when(F.col("item_id") % k == 0, -F.col("item_id") * 10 - k).otherwise(F.col("item_id"))
    features = listed.select(moved(3).alias("item_id"), F.length(F.coalesce("item_title", F.lit(""))).alias("title_length"))
    vectors = embeddings.document_vectors(embeddings.item_tokens(listed), word_table(spark, folder), dimensions=64)
    both = joins.with_vectors(features, vectors.select(moved(5).alias("item_id"), "embedding"))
    sums = vector_sums(both).withColumnRenamed("item_id", "_item")
    return both.select("item_id", F.col("title_length").cast("long").alias("title_length")).join(
        sums, F.col("item_id") == F.col("_item")
    ).drop("_item")


def subword_model(spark, folder):
    # Read by training, for its words and its epochs, and for the vectors.
    listed = written(embeddings.item_tokens(bindings.items(spark, folder)), "tokens")
    model = subwords.train_subword_vectors(listed, dimensions=16, epochs=1, buckets=1 << 12)
    return listed, model


@query(
    "subword_item_vectors",
    with_(ITEMS, ITEM_TOKENS)
    + "SELECT item_id, 16::BIGINT AS dimensions, CAST(len(w) = 0 AS BIGINT) AS zero FROM words",
)
def subword_item_vectors(spark, folder):
    """A vector of trained n-grams for every item; zero where it has no words."""
    listed, model = subword_model(spark, folder)
    out = subwords.document_vectors_by_subwords(listed, model)
    zero = F.forall("embedding", lambda x: x == 0)
    return out.select("item_id", F.size("embedding").cast("long").alias("dimensions"), zero.cast("long").alias("zero"))


@query(
    "subword_vocabulary",
    with_(ITEMS, ITEM_TOKENS)
    + """SELECT word, n, dimensions, zero FROM (
        SELECT word, count(*) AS n, 16::BIGINT AS dimensions, 0::BIGINT AS zero FROM (SELECT unnest(w) AS word FROM words) t
        GROUP BY word HAVING count(*) >= 2
        UNION ALL SELECT word || 'zq', 0, 16, 0 FROM (SELECT unnest(w) AS word FROM words) t GROUP BY word HAVING count(*) >= 2) u""",
)
def subword_vocabulary(spark, folder):
    """Words seen twice, and as many that were never seen, with vectors of the same kind."""
    _, model = subword_model(spark, folder)
    unseen = model.words.select(F.concat("word", F.lit("zq")).alias("word"), F.lit(0).cast("long").alias("n"))
    out = subwords.word_vectors(model.words.unionByName(unseen), model)
    zero = F.forall("vector", lambda x: x == 0)
    return out.select("word", "n", F.size("vector").cast("long").alias("dimensions"), zero.cast("long").alias("zero"))


@query("trained_word_vectors")
def trained_word_vectors(spark, folder):
    """Vectors trained on the item texts, and each item's mean of them. No SQL twin: training is iterative."""
    # Read twice by training, and for the vectors.
    listed = written(embeddings.item_tokens(bindings.items(spark, folder)), "tokens")
    words = embeddings.train_word_vectors(embeddings.training_corpus(listed), dimensions=16, epochs=1, partitions=8)
    return embeddings.document_vectors(listed, words, dimensions=16)


@query(
    "image_vector_aggregates",
    f"""SELECT CAST(label AS BIGINT) AS label, pos, {r("avg(x)", "mean", 5)}, {r("max(x)", "max", 5)}, count(*) AS images FROM (
      SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) t GROUP BY 1, 2""",
)
def image_vector_aggregates(spark, folder):
    out = embeddings.aggregate_images(bindings.table(spark, folder, "embeddings"), "label", "embedding")
    flat = out.select(
        "label",
        F.posexplode(F.arrays_zip(F.col("mean_embedding").alias("mean"), F.col("max_embedding").alias("max"))).alias("pos", "v"),
        F.col("images_processed").alias("images"),
    )
    return rounded(flat.select("label", (F.col("pos") + 1).alias("pos"), "v.mean", "v.max", "images"), "label", "pos", digits=5)


# ----------------------------------------------------------- predictions

MODELS = ["pred_tabular", "pred_image", "pred_text", "pred_sequential"]


def model_outputs(spark, folder):
    """Four model predictions per item, some of them missing."""
    items = bindings.items(spark, folder)
    k, price = F.col("item_id"), F.coalesce("item_current_bid", F.lit(100.0))
    return items.select(
        "item_id",
        F.when(k % 2 == 0, price * 0.9).alias(MODELS[0]),
        F.when(k % 3 == 0, price * 1.2).alias(MODELS[1]),
        F.when(k % 5 == 0, price * 0.5).alias(MODELS[2]),
        F.when(k % 7 == 0, price + 10).alias(MODELS[3]),
        F.when(k % 11 != 0, F.col("item_current_bid")).alias("winning_bid"),
        F.col("item_bid_count").alias("bid_count"),
    )


OUTPUTS = """
outputs AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN p * 0.9 END AS pred_tabular, CASE WHEN item_id % 3 = 0 THEN p * 1.2 END AS pred_image,
    CASE WHEN item_id % 5 = 0 THEN p * 0.5 END AS pred_text, CASE WHEN item_id % 7 = 0 THEN p + 10 END AS pred_sequential,
    CASE WHEN item_id % 11 <> 0 THEN item_current_bid END AS winning_bid, item_bid_count AS bid_count
  FROM (SELECT *, coalesce(item_current_bid, 100.0)::DOUBLE AS p FROM items) t),
long AS (UNPIVOT (SELECT item_id, pred_tabular::DOUBLE AS a, pred_image::DOUBLE AS b, pred_text::DOUBLE AS c, pred_sequential::DOUBLE AS d FROM outputs)
  ON a, b, c, d INTO NAME model VALUE x),
fused AS (SELECT o.*, coalesce(m, 0) AS predicted_price,
    CASE WHEN n > 1 THEN s WHEN n = 1 THEN m * 0.2 ELSE 0 END AS deviation
  FROM outputs o LEFT JOIN (SELECT item_id, count(*) AS n, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY 1) l USING (item_id))
"""


@query(
    "fused_predictions",
    with_(ITEMS, OUTPUTS)
    + f"""SELECT item_id, {r("predicted_price", "predicted_price", 4)},
      {r("greatest(predicted_price - 1.96 * deviation, 0)", "confidence_lower", 4)},
      {r("predicted_price + 1.96 * deviation", "confidence_upper", 4)} FROM fused""",
)
def fused_predictions(spark, folder):
    out = predictions.add_fusion(model_outputs(spark, folder), MODELS)
    return rounded(out.select("item_id", "predicted_price", "confidence_lower", "confidence_upper"), "item_id", digits=4)


@query(
    "prediction_records",
    with_(ITEMS, OUTPUTS)
    + """SELECT CAST(item_id AS VARCHAR) AS item_id, round(predicted_price + 1e-9, 2) AS price,
      round(predicted_price + 1.96 * deviation + 1e-9, 2) AS upper, round(pred_tabular + 1e-9, 2)::DOUBLE AS tabular FROM fused""",
)
def prediction_records(spark, folder):
    fused = predictions.add_fusion(model_outputs(spark, folder), MODELS)
    # Off the exact half before rounding, like every other compared number.
    nudged = fused.withColumns({c: F.col(c) + 1e-9 for c in [*MODELS, "predicted_price", "confidence_lower", "confidence_upper"]})
    record = predictions.prediction_record(MODELS)
    return nudged.select(record.alias("r")).select(
        "r.item_id",
        F.col("r.predicted_price").alias("price"),
        F.col("r.confidence_interval.upper").alias("upper"),
        F.col("r.model_predictions.pred_tabular").alias("tabular"),
    )


def metric_sql(scope: str, keep: str, y="winning_bid", p="predicted_price") -> str:
    f = f"FILTER ({keep} AND {y} IS NOT NULL AND {p} IS NOT NULL)"
    return ",\n".join(
        [
            r(f"avg(abs({y} - {p})) {f}", f"{scope}_mae", 4),
            r(f"sqrt(avg(({y} - {p}) * ({y} - {p})) {f})", f"{scope}_rmse", 4),
            r(f"avg(CASE WHEN {y} <> 0 THEN abs({y} - {p}) / abs({y}) END) {f}", f"{scope}_mape", 4),
            r(f"1 - sum(({y} - {p}) * ({y} - {p})) {f} / nullif(var_pop({y}) {f} * count({y}) {f}, 0)", f"{scope}_r2", 4),
        ]
    )


METRICS = ",\n".join(
    metric_sql(s, k) for s, k in (("all_items", "TRUE"), ("items_with_bids", "bid_count > 0"), ("items_no_bids", "bid_count = 0"))
)


@query("prediction_metrics", with_(ITEMS, OUTPUTS) + f"SELECT {METRICS} FROM fused")
def prediction_metrics(spark, folder):
    fused = predictions.add_fusion(model_outputs(spark, folder), MODELS)
    out = predictions.regression_metrics(fused, "winning_bid", "predicted_price", F.col("bid_count") > 0)
    return rounded(out, digits=4)


@query(
    "prediction_metrics_by_version",
    with_(ITEMS, OUTPUTS)
    + f"""SELECT model_version, prediction_type, {METRICS} FROM (SELECT *, 'v' || (item_id % 2) AS model_version,
      CASE WHEN item_id % 3 = 0 THEN 'live' ELSE 'validation' END AS prediction_type FROM fused) t GROUP BY 1, 2""",
)
def prediction_metrics_by_version(spark, folder):
    rows = model_outputs(spark, folder)
    fused = predictions.add_fusion(rows, MODELS).select(
        "item_id",
        F.col("predicted_price").alias("pred_fusion"),
        F.concat(F.lit("v"), (F.col("item_id") % 2).cast("string")).alias("model_version"),
        F.when(F.col("item_id") % 3 == 0, "live").otherwise("validation").alias("prediction_type"),
    )
    return rounded(predictions.scored_predictions(fused, rows), "model_version", "prediction_type", digits=4)


@query(
    "quantile_losses",
    with_(ITEMS, OUTPUTS)
    + "SELECT "
    + ", ".join(
        r(f"avg(greatest((winning_bid - {c}) * {q}, (winning_bid - {c}) * ({q} - 1)))", f"loss_{c}", 4)
        for c, q in (("pred_tabular", 0.1), ("pred_image", 0.5), ("pred_text", 0.9))
    )
    + ", "
    + r(
        " + ".join(
            f"avg(greatest((winning_bid - {c}) * {q}, (winning_bid - {c}) * ({q} - 1)))"
            for c, q in (("pred_tabular", 0.1), ("pred_image", 0.5), ("pred_text", 0.9))
        ),
        "loss_total",
        4,
    )
    + " FROM outputs",
)
def quantile_losses(spark, folder):
    quantiles = {"pred_tabular": 0.1, "pred_image": 0.5, "pred_text": 0.9}
    return rounded(predictions.pinball_loss(model_outputs(spark, folder), "winning_bid", quantiles), digits=4)


# ---------------------------------------------------------------- splits

DRAW = "('0x' || substr(md5('42:' || %s), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def split_sql(share: str) -> str:
    return f"CASE WHEN {share} < 0.7 THEN 'train' WHEN {share} < 0.85 THEN 'validation' ELSE 'test' END AS split"


@query("random_split", f"SELECT o_orderkey, {split_sql(DRAW % 'o_orderkey')} FROM orders")
def random_split(spark, folder):
    return splits.with_split(bindings.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query("split_by_auction", f"SELECT l_orderkey, split, count(*) AS n FROM (SELECT l_orderkey, {split_sql(DRAW % 'l_orderkey')} FROM lineitem) t GROUP BY 1, 2")
def split_by_auction(spark, folder):
    lines = splits.with_split(bindings.table(spark, folder, "lineitem").select("l_orderkey"), "l_orderkey")
    return lines.groupBy("l_orderkey", "split").agg(F.count("*").alias("n"))


STRATIFIED = f"""SELECT o_orderkey, o_orderstatus, {split_sql("share")} FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {DRAW % 'o_orderkey'}, o_orderkey) - 1) / count(*) OVER (PARTITION BY o_orderstatus) AS share FROM orders) t"""


@query("stratified_split", STRATIFIED)
def stratified_split(spark, folder):
    orders = bindings.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splits.with_split(orders, "o_orderkey", stratify="o_orderstatus")


@query("stratified_split_of_huge_strata", STRATIFIED)
def stratified_split_of_huge_strata(spark, folder):
    """Three strata hold everything; a small limit ranks them across tasks."""
    orders = bindings.table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return splits.with_split(orders, "o_orderkey", stratify="o_orderstatus", limit=1000)
