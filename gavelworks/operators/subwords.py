"""Word vectors made of character n-grams, so that words never seen have vectors too.

A word's vector is the mean of the rows of its n-grams, and of itself, in a table of fixed size into which they are
hashed. Training is skip-gram with negative samples: every task starts from the same tables, runs mini-batches over the
texts of its partition and returns the change of the rows it touched; Spark averages the changes of each row over the
tasks, and the sum of averages starts the next epoch. What reaches the driver has the size of the tables, however many
texts and words there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.session import written

BUCKETS = 1 << 16
# Lengths of n-grams, counting the marks at a word's ends.
SHORTEST, LONGEST = 3, 6
# Pairs of a mini-batch.
BATCH_PAIRS = 512
# Words more frequent than this share of all are skipped now and then.
SAMPLE = 1e-3


@lru_cache(1 << 16)
def ngram_rows(word: str, buckets: int) -> np.ndarray:
    """Rows of the word itself, first, and of its n-grams."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - n + 1)]
    return np.array([crc32(g.encode()) % buckets for g in [marked, *grams]])


class Vocabulary:
    """The distinct words of a batch, with the rows of each, one word after another."""

    def __init__(self, words: Sequence[str], buckets: int):
        rows = [ngram_rows(w, buckets) for w in words]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.places = self.rows[self.starts] if rows else self.rows

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows of the given words, and where each word's rows begin."""
        sizes = self.sizes[words]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        inside = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        return self.rows[np.repeat(self.starts[words], sizes) + inside], begins

    def vectors(self, words: np.ndarray, table: np.ndarray) -> np.ndarray:
        rows, begins = self.of(words)
        return np.add.reduceat(table[rows], begins, axis=0) / self.sizes[words][:, None]


@dataclass
class SubwordVectors:
    """Trained tables: of n-grams, and of words as neighbours. ``words`` are those seen often enough, with counts."""

    ngrams: np.ndarray
    neighbours: np.ndarray
    words: DataFrame

    @property
    def dimensions(self) -> int:
        return self.ngrams.shape[1]


def _pairs(docs: np.ndarray, window: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Positions of centres and neighbours; each centre looks as far as a random part of the window."""
    reach = draw.integers(1, window + 1, len(docs))
    centres, others = [], []
    for step in range(1, window + 1):
        left = np.flatnonzero(docs[:-step] == docs[step:])
        for a, b in ((left, left + step), (left + step, left)):
            near = reach[a] >= step
            centres.append(a[near])
            others.append(b[near])
    centres, others = np.concatenate(centres), np.concatenate(others)
    order = draw.permutation(len(centres))
    return centres[order], others[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn_pairs(
    ngrams: np.ndarray,
    neighbours: np.ndarray,
    words: Vocabulary,
    centres: np.ndarray,
    others: np.ndarray,
    wrong: np.ndarray,
    rate: float,
) -> None:
    """One mini-batch of centre words, their true neighbours' places and ``wrong`` ones, in place."""
    unique, inverse = np.unique(centres, return_inverse=True)
    hidden = words.vectors(unique, ngrams)[inverse]
    places = np.concatenate([others[:, None], wrong], axis=1)
    right = np.zeros(places.shape, np.float32)
    right[:, 0] = 1
    out = neighbours[places]
    error = (right - _sigmoid(np.einsum("bd,bkd->bk", hidden, out))) * rate
    # A wrong neighbour that is the true one teaches nothing.
    error[:, 1:][wrong == others[:, None]] = 0
    back = np.einsum("bk,bkd->bd", error, out)
    np.add.at(neighbours, places, error[:, :, None] * hidden[:, None, :])
    summed = np.zeros((len(unique), ngrams.shape[1]), np.float32)
    np.add.at(summed, inverse, back)
    rows, _ = words.of(unique)
    np.add.at(ngrams, rows, np.repeat(summed / words.sizes[unique][:, None], words.sizes[unique], axis=0))


def _flat(batch: pa.RecordBatch, column: str) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All tokens of a list column, and the number of the row each lies in."""
    lists = batch.column(column)
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().cast(pa.string()).dictionary_encode(), np.repeat(np.arange(len(lists)), sizes)


def train_subword_vectors(
    corpus: DataFrame,
    dimensions: int = 100,
    window: int = 5,
    min_count: int = 2,
    epochs: int = 10,
    buckets: int = BUCKETS,
    negatives: int = 5,
    rate: float = 0.05,
    seed: int = 42,
) -> SubwordVectors:
    """Vectors of the words in ``tokens`` and of their n-grams.

    A word is learnt from if its row in the table was seen ``min_count`` times;
    rarer words have vectors by their n-grams alone. Missing token lists count
    as empty, and missing tokens are skipped.
    """
    corpus = written(corpus.select(F.array_compact("tokens").alias("tokens")).filter(F.size("tokens") > 0), "corpus")
    spark = corpus.sparkSession
    seen = corpus.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(seen.filter(F.col("n") >= min_count), "vocabulary")
    place = F.crc32(F.encode(F.concat(F.lit("<"), F.col("word"), F.lit(">")), "UTF-8")) % buckets
    places = words.groupBy(place.alias("place")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets)
    counts[places.column("place").to_numpy()] = places.column("n").to_numpy()
    start = np.random.default_rng(seed)
    ngrams = start.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    neighbours = np.zeros((buckets, dimensions), np.float32)
    for epoch in range(epochs):
        state = spark.sparkContext.broadcast((ngrams, neighbours, counts))
        step = rate * max(1 - epoch / epochs, 0.05)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second, n = state.value
            tables = [first.copy(), second.copy()]
            share = n / max(n.sum(), 1)
            frequent = np.cumsum(n**0.75)
            # The same draws when a task is run again.
            draw = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            for batch in batches:
                tokens, docs = _flat(batch, "tokens")
                known = Vocabulary(tokens.dictionary.to_pylist(), len(first))
                ids = tokens.indices.to_numpy(zero_copy_only=False)
                often = share[known.places[ids]]
                with np.errstate(divide="ignore"):
                    keep = (often > 0) & (draw.random(len(ids)) < np.sqrt(SAMPLE / often) + SAMPLE / often)
                ids, docs = ids[keep], docs[keep]
                centres, others = _pairs(docs, window, draw)
                for at in range(0, len(centres), BATCH_PAIRS):
                    centre, other = ids[centres[at : at + BATCH_PAIRS]], known.places[ids[others[at : at + BATCH_PAIRS]]]
                    wrong = np.searchsorted(frequent, draw.random((len(centre), negatives)) * frequent[-1], side="right")
                    learn_pairs(*tables, known, centre, other, np.minimum(wrong, len(n) - 1), step)
            for which, (new, old) in enumerate(zip(tables, (first, second))):
                change = new - old
                rows = np.flatnonzero(change.any(axis=1))
                for part in np.array_split(rows, max(len(rows) // 4096, 1)):
                    values = pa.array(list(change[part].astype(np.float64)), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), which)), pa.array(part), values], names=["which", "row", "change"]
                    )

        changes = corpus.mapInArrow(learn, "which long, row long, change array<double>")
        mean = changes.groupBy("which", "row").agg(Summarizer.mean(array_to_vector("change")).alias("change"))
        moved = mean.select("which", "row", vector_to_array("change", "float32").alias("change")).toArrow()
        state.unpersist()
        which, row = moved.column("which").to_numpy(), moved.column("row").to_numpy()
        change = np.array(moved.column("change").combine_chunks().flatten()).reshape(len(row), dimensions)
        for table, number in ((ngrams, 0), (neighbours, 1)):
            table[row[which == number]] += change[which == number]
    return SubwordVectors(ngrams, neighbours, words)


def word_vectors(words: DataFrame, model: SubwordVectors, column: str = "word") -> DataFrame:
    """The rows with the ``vector`` of their word, seen in training or not; a missing word has none."""
    table = words.sparkSession.sparkContext.broadcast(model.ngrams)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spelled = batch.column(column).cast(pa.string()).dictionary_encode()
            known = Vocabulary(spelled.dictionary.to_pylist(), len(table.value))
            if len(spelled.dictionary):
                vectors = known.vectors(np.arange(len(known.sizes)), table.value).astype(np.float32)
                values = pa.array(list(vectors), pa.list_(pa.float32())).take(spelled.indices)
            else:
                values = pa.nulls(len(batch), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "vector"])

    words = words.drop("vector")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(look_up, f"{kept}, vector array<float>")


def document_vectors_by_subwords(
    tokens: DataFrame, model: SubwordVectors, keys: Sequence[str] = ("auction_id", "item_id")
) -> DataFrame:
    """Mean vector of all tokens of each row; zeros for a row without tokens."""
    table, size = tokens.sparkSession.sparkContext.broadcast(model.ngrams), model.dimensions
    listed = tokens.select(*keys, F.array_compact("tokens").alias("tokens"))
    keys = list(keys)

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, docs = _flat(batch, "tokens")
            out = np.zeros((len(batch), size), np.float64)
            if len(docs):
                known = Vocabulary(words.dictionary.to_pylist(), len(table.value))
                vectors = known.vectors(np.arange(len(known.sizes)), table.value)
                found, begins, n = np.unique(docs, return_index=True, return_counts=True)
                ids = words.indices.to_numpy(zero_copy_only=False)
                out[found] = np.add.reduceat(vectors[ids], begins, axis=0) / n[:, None]
            values = pa.array(list(out.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], values], names=[*keys, "embedding"])

    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}
    return listed.mapInArrow(mean, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", embedding array<float>")
