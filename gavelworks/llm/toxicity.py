"""Toxicity of whole texts by a linear classifier over character n-grams.

A text is the set of n-grams of its words, each word with a blank before and after it, hashed into ``2**BITS`` features.
A feature is scaled by its naive Bayes log-count ratio: the logarithm of how much more often toxic training texts hold it
than clean ones. A logistic regression is fitted on the scaled features.

Training takes about ``SAMPLE`` labelled texts of each class, picked by a hash of their ids; with fewer there are, all.
Every text is scored whole.

Defined results: a null text counts as empty and has the score of the intercept alone. Rows that repeat get equal scores.
A document labelled more than once counts by its largest label; null labels and labels of missing documents count for
nothing. Without training texts of both classes the score is 0 for all if none is toxic, and 1 if all are; without any, 0.
An empty table gives an empty result. All columns of the input stay except ``score``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.words import SMALL_BYTES, mixed, slices, words_of

SAMPLE = 3000
BITS = 20
SIZES = (2, 3, 4, 5)
# Features of the model: in at least so many sampled texts, and so unevenly (logarithm of the ratio).
LEAST_TEXTS = 8
LEAST_RATIO = 1.0
# Texts of the sample whose features are held together.
CHUNK = 200
_HASH_SPACE = 1 << 30
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def word_features(words: list[bytes], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(word, feature)`` pairs of distinct words; only features marked in ``keep``."""
    line = " " + " ".join(w.decode("utf-8", "replace").lower() for w in words) + " "
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = codes == 32
    blanks = np.concatenate([[0], np.cumsum(blank)])
    hashes = np.zeros(len(codes), np.uint64)
    owners, features = [], []
    for k in range(max(SIZES)):
        # Extend every window by one character.
        hashes = hashes[: len(codes) - k] * _FACTOR + codes[k:] + np.uint64(1)
        if k + 1 not in SIZES or not len(hashes):
            continue
        n = k + 1
        at = np.arange(len(hashes))
        # A blank may be the first or the last character of a window, not between, and not all of it.
        inner = blanks[at + n - 1] - blanks[at + 1] == 0
        at = at[inner & ~(blank[at] & blank[at + 1])] if n == 2 else at[inner]
        buckets = (mixed(hashes[at] + np.uint64(n)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
        if keep is not None:
            wanted = keep[buckets]
            at, buckets = at[wanted], buckets[wanted]
        # A window beginning at a blank belongs to the word after it.
        owners.append(blanks[at + 1] - 1)
        features.append(buckets)
    return np.concatenate(owners), np.concatenate(features)


def text_features(texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, feature)`` pairs, sorted. Each distinct word is looked at once."""
    words = words_of(texts)
    _, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    distinct = [data[a:b] for a, b in zip(words.starts[first], words.ends[first])]
    owner, feature = word_features(distinct, keep)
    pairs = np.unique(owner * (1 << BITS) + feature)
    owner, feature = pairs >> BITS, pairs & ((1 << BITS) - 1)
    begins = np.searchsorted(owner, np.arange(len(distinct) + 1))
    counts = np.diff(begins)
    # Words of texts that have features, each once per text.
    text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    useful = counts[inverse] > 0
    held = np.unique(text[useful] * max(1, len(distinct)) + inverse[useful])
    text, word = held // max(1, len(distinct)), held % max(1, len(distinct))
    n = counts[word]
    places = np.repeat(begins[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
    pairs = np.unique(np.repeat(text, n) * (1 << BITS) + feature[places]) if len(n) else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def train(texts: list[str], toxic: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weight of every feature, and the intercept. Both classes count alike, whatever their shares."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return np.zeros(1 << BITS), 40.0 if len(toxic) and toxic.all() else -40.0
    size = 1 << BITS
    parts = [(at, pa.array(texts[at : at + CHUNK], pa.large_string())) for at in range(0, len(texts), CHUNK)]
    # Twice through the texts, so that only the features of the model are held for all of them.
    bad, good = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for at, part in parts:
        row, feature = text_features(part)
        own = toxic[row + at]
        bad += np.bincount(feature[own], minlength=size)
        good += np.bincount(feature[~own], minlength=size)
    ratio = np.log((bad + 1.0) / (toxic.sum() + 2.0)) - np.log((good + 1.0) / ((~toxic).sum() + 2.0))
    used = (bad + good >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO)
    found = [(row + at, feature) for at, part in parts for row, feature in [text_features(part, used)]]
    row, feature = (np.concatenate(column) for column in zip(*found))
    scaled = ratio[feature]
    # Accelerated gradient descent on the penalised logistic loss; the step is bounded by the mean squared row length.
    goal, weight, intercept = toxic.astype(float), np.zeros(size), 0.0
    each = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean()) / len(texts)
    lengths = np.bincount(row, scaled**2, minlength=len(texts))
    step = 4.0 / (lengths.mean() + 1.0)
    past, past_b = weight.copy(), intercept
    for t in range(steps):
        ahead = weight + t / (t + 3) * (weight - past)
        ahead_b = intercept + t / (t + 3) * (intercept - past_b)
        score = np.bincount(row, scaled * ahead[feature], minlength=len(texts)) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - goal) * each
        past, past_b = weight, intercept
        slope = np.bincount(feature, scaled * error[row], minlength=size)
        weight = ahead - step * (slope + 1e-4 * ahead)
        intercept = ahead_b - step * error.sum()
    weight = weight * ratio
    weight[np.abs(weight) < 1e-4] = 0.0
    return weight, float(intercept)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Features of the model, their weights, and the intercept, learnt from a sample of labelled documents.

    The sample is of a fixed size, so one task trains on all of it; the driver
    only sees the model.
    """
    known = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("_toxic") == label, min(_HASH_SPACE, _HASH_SPACE * SAMPLE // n)).otherwise(limit)
    chosen = known.filter(F.pmod(F.xxhash64("_id"), F.lit(_HASH_SPACE)) < limit)
    # About two times SAMPLE ids, whatever the input.
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        found = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        weight, intercept = train([t or "" for t in found["text"].to_pylist()], found["_toxic"].to_numpy() == 1)
        used = np.flatnonzero(weight)
        columns = [[used.astype(np.int32)], [weight[used]], [intercept]]
        yield pa.record_batch([pa.array(c) for c in columns], names=["feature", "weight", "intercept"])

    model = rows.repartition(1).mapInArrow(fit, "feature array<int>, weight array<double>, intercept double").first()
    if model is None:
        return np.zeros(0, np.int64), np.zeros(0), -40.0
    return np.array(model["feature"], np.int64), np.array(model["weight"], float), model["intercept"]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, between 0 and 1, learnt from ``labels`` (``doc_id, toxic``) outside the held-out fold."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs.select("doc_id", "text"), labels))
    kept = [c for c in docs.columns if c != "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, values, intercept = model.value
        weight = np.zeros(1 << BITS)
        weight[used] = values
        keep = weight != 0
        for batch in batches:
            for part in slices(batch, "text", SMALL_BYTES):
                text, feature = text_features(part.column("text"), keep)
                total = np.bincount(text, weight[feature], minlength=len(part)) + intercept
                total = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.record_batch([*part.columns, pa.array(total)], names=[*kept, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(score, f"{fields}, score double")
