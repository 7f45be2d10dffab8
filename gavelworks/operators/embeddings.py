"""Word and document vectors, and aggregates over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.functions.text import STOPWORDS, title_and_description_tokens
from gavelworks.operators.joins import KEY_LIMIT, left_join, not_done
from gavelworks.session import written

DIMENSIONS = 100
# Largest vocabulary, in bytes of vectors, that is sent to every worker.
BROADCAST_BYTES = 64 * 1024 * 1024
# A word is frequent if it makes up more than one in this many of all words, so there are fewer frequent ones than that.
FREQUENT = 4096
# Documents whose vectors are gathered at once.
BLOCK = 1024
# Words whose neighbours show whether the vectors make sense.
SAMPLE_WORDS = ["furniture", "antique", "vintage", "table", "chair", "collectible"]


def item_tokens(items: DataFrame, stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Title tokens followed by description tokens, per item."""
    keys = [c for c in ("auction_id", "item_id") if c in items.columns]
    text = title_and_description_tokens(F.col("item_title"), F.col("item_description"), stopwords)
    return items.select(*keys, text.alias("tokens"))


def training_corpus(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.size("tokens") > 0)


def empty_texts(tokens: DataFrame) -> DataFrame:
    return tokens.agg(
        F.count_if(F.size("tokens") > 0).alias("documents"), F.count_if(F.size("tokens") == 0).alias("empty")
    )


def train_word_vectors(
    corpus: DataFrame,
    dimensions: int = DIMENSIONS,
    window: int = 5,
    min_count: int = 2,
    epochs: int = 10,
    partitions: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Skip-gram vectors as (word, vector).

    The corpus stays distributed; what grows with it on the driver is only the
    vocabulary above ``min_count``. ``partitions`` trains shares in parallel.
    """
    model = Word2Vec(
        vectorSize=dimensions,
        windowSize=window,
        minCount=min_count,
        maxIter=epochs,
        numPartitions=partitions,
        seed=seed,
        inputCol="tokens",
        outputCol="_vector",
    ).fit(corpus)
    return model.getVectors().select("word", vector_to_array("vector", "float32").alias("vector"))


def document_vectors(
    tokens: DataFrame,
    words: DataFrame,
    keys: Sequence[str] = ("auction_id", "item_id"),
    dimensions: int = DIMENSIONS,
    broadcast_bytes: int = BROADCAST_BYTES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """Mean vector of each document's known tokens; zeros when it has none, or when its tokens are missing.

    Each row has a vector of its own, also where keys repeat.

    A vocabulary that fits ``broadcast_bytes`` goes to every worker, and the
    documents are not shuffled at all. Of a larger one only the words that make
    up more than one in ``frequent`` of all words do, and the others are joined.
    """
    if words.count() * dimensions * 8 <= broadcast_bytes:
        return _vectors_by_lookup(tokens, words, list(keys), dimensions)
    return _vectors_by_join(tokens, words, list(keys), dimensions, frequent)


def _sums(lists: pa.Array, known: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the vectors of each list's known words, and how many those are."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=known), -1)
    found = found.to_numpy(zero_copy_only=False)
    n = np.bincount(np.repeat(np.arange(len(lists)), sizes)[found >= 0], minlength=len(lists))
    met, found = np.flatnonzero(n), found[found >= 0]
    ends = np.cumsum(n[met])
    starts = ends - n[met]
    out = np.zeros((len(lists), vectors.shape[1]))
    for at in range(0, len(met), BLOCK):
        begin, some = starts[at], slice(at, at + BLOCK)
        out[met[some]] = np.add.reduceat(vectors[found[begin : ends[some][-1]]], starts[some] - begin, axis=0)
    return out, n


def _vectors_by_lookup(tokens: DataFrame, words: DataFrame, keys: list[str], dimensions: int) -> DataFrame:
    """Means from a table that every worker has. The mean of other words, and their number, may come as ``_mean`` and ``_n``."""
    table = words.select("word", F.col("vector").cast("array<double>").alias("vector")).toArrow().combine_chunks()
    spelled = table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.string())
    flat = table.column("vector").combine_chunks().flatten() if table.num_rows else pa.array([], pa.float64())
    matrix = np.array(flat).reshape(-1, dimensions)
    shared = tokens.sparkSession.sparkContext.broadcast((spelled, matrix))
    others = "_mean" in tokens.columns
    listed = tokens.select(*keys, "tokens", *(["_mean", "_n"] if others else []))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = _sums(batch.column("tokens"), *shared.value)
            if others:
                more = pc.fill_null(batch.column("_n"), 0).to_numpy(zero_copy_only=False)
                means = np.array(batch.column("_mean").drop_null().flatten()).reshape(-1, dimensions)
                out[more > 0] += means * more[more > 0, None]
                n = n + more
            out /= np.maximum(n, 1)[:, None]
            values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel().astype("float32")), dimensions)
            arrays = [*[batch.column(k) for k in keys], values.cast(pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "embedding"])

    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}
    return listed.mapInArrow(mean, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", embedding array<float>")


def _vectors_by_join(
    tokens: DataFrame, words: DataFrame, keys: list[str], dimensions: int, frequent: int
) -> DataFrame:
    """Frequent words are looked up where the documents lie; the others, counted
    inside each document, are joined and bring their vectors along. So what is
    moved is the vectors of rare words only, and no word is too much for a task.
    """
    # Numbered as they are written, so that rows of the same key stay apart.
    docs = written(tokens.select(*keys, "tokens").withColumn("_row", F.monotonically_increasing_id()), "documents")
    counts = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("_words"))
    known = words.select("word", F.col("vector").cast("array<double>").alias("vector"))
    met = written(counts.join(known, "word", "left"), "words")
    total = met.agg(F.sum("_words")).first()[0] or 0
    often = F.col("_words") > min(total / frequent, KEY_LIMIT)
    has_vector = F.col("vector").isNotNull()
    looked_up, rare = met.filter(often & has_vector), met.filter(~often & has_vector)
    if rare.isEmpty():
        return _vectors_by_lookup(docs, looked_up, keys, dimensions)
    words_in = docs.select("_row", F.explode("tokens").alias("word"))
    words_in = words_in.join(F.broadcast(met.filter(often).select("word")), "word", "left_anti")
    counted = words_in.groupBy("_row", "word").agg(F.count("*").cast("double").alias("_times"))
    vectors = counted.join(rare.select("word", array_to_vector("vector").alias("_vector")), "word")
    means = vectors.groupBy("_row").agg(
        vector_to_array(Summarizer.mean(F.col("_vector"), F.col("_times"))).alias("_mean"), F.sum("_times").alias("_n")
    )
    return _vectors_by_lookup(docs.join(means, "_row", "left"), looked_up, keys, dimensions)


def embed_new_items(items: DataFrame, words: DataFrame, done: DataFrame | None, path: str, dimensions: int) -> None:
    """Append vectors of the items not embedded yet."""
    pending = items if done is None else not_done(items, done, ["item_id"])
    document_vectors(item_tokens(pending), words, dimensions=dimensions).write.mode("append").parquet(path)


def cosine(a, b) -> F.Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, norm(a) * norm(b))


def nearest_words(vectors: DataFrame, sample: Sequence = tuple(SAMPLE_WORDS), k: int = 5) -> DataFrame:
    """The ``k`` most similar other words of each sample word, by cosine.

    Only the vectors of the sample reach the driver. The rank limit is applied
    in each task before the shuffle.
    """
    wide = vectors.select("word", F.col("vector").cast("array<double>").alias("vector"))
    asked = wide.filter(F.col("word").isin(list(sample))).collect()
    if not asked:
        return wide.select(
            F.col("word"), F.col("word").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank")
        ).limit(0)
    pairs = F.array(
        *[F.struct(F.lit(row["word"]).alias("word"), F.lit(list(row["vector"])).alias("vector")) for row in asked]
    )
    scored = (
        wide.select(F.col("word").alias("neighbour"), "vector", F.explode(pairs).alias("q"))
        .filter(F.col("neighbour") != F.col("q.word"))
        .select(F.col("q.word").alias("word"), "neighbour", cosine(F.col("vector"), F.col("q.vector")).alias("similarity"))
    )
    order = Window.partitionBy("word").orderBy(F.desc("similarity"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def aggregate_images(vectors: DataFrame, by: str = "item_id", column: str = "image_embedding") -> DataFrame:
    """Mean and elementwise maximum of the image vectors of each item."""
    summary = Summarizer.metrics("mean", "max", "count").summary(
        array_to_vector(F.col(column).cast("array<double>"))
    )
    return vectors.groupBy(by).agg(summary.alias("s")).select(
        by,
        vector_to_array("s.mean").alias("mean_embedding"),
        vector_to_array("s.max").alias("max_embedding"),
        F.col("s.count").alias("images_processed"),
    )


def term_weights(tokens: DataFrame, key: str, method: str = "tfidf") -> DataFrame:
    """Bag-of-words counts or tf-idf weights, one row per document and term."""
    if method not in ("bow", "tfidf"):
        raise NotImplementedError(f"Text feature extraction ({method}) not available")
    counts = tokens.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    if method == "bow":
        return counts
    # Read three times below, so written once.
    counts = written(counts, "terms")
    documents = tokens.count()
    rarity = counts.groupBy("term").agg(F.log((F.lit(documents) + 1) / (F.count("*") + 1)).alias("idf"))
    return left_join(counts, rarity, ["term"]).withColumn("tfidf", F.col("tf") * F.col("idf"))
