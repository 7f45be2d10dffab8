"""Collocations: phrases that are frequent for how often their parts occur, per language.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. Only the
longest windows are counted: a word with its followers, one lead column for each, padded where the piece ends. Spark's
ROLLUP over these columns then sums the counts of each shorter prefix, down to the words and the words of a language, so
no second explosion makes the shorter phrases.

A word or follower is padding as well where it lies in no run of words that is frequent enough for any phrase that is asked
for. Runs are counted first, by hash: words and pairs, then those runs of each further length whose own runs all passed. A
table of counts has one place for every eight bytes of text and ``2**MOST_BITS`` places at most; a place sums several runs
at worst, so no frequent run is ever lost, and every phrase with enough occurrences keeps all of them. The tables only save
work: past their bound (at some 4 GB of text) they let more and more windows through, with equal results.

Null and empty texts have no words and a null language is ``und``; a row that is there twice counts twice; ids and any
other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelworks.llm.words import LOWER, bytes_of, hashed, mixed, slices
from gavelworks.session import spread, written

BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
BLANK = np.isin(np.arange(256), [32, 9])
# Texts taken together in a task.
BATCH_BYTES = 1_000_000
# Places of a table; its bitmap has 64 MB at most.
LEAST_BITS, MOST_BITS = 20, 29
# Places that a task holds before it packs them, and places of a part of the table.
MOST_HELD = 2_000_000
_PART_BITS = 15
_PART = 1 << _PART_BITS
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The words of all texts, their hashes, whether the next one follows in the piece, their language, and the languages."""
    data, offsets = bytes_of(batch.column("text"))
    data = LOWER[data]
    inside = np.concatenate([~(BREAK | BLANK)[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
    breaks = np.concatenate([[0], np.cumsum(BREAK[data])])
    row = np.searchsorted(offsets, starts, side="right") - 1
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (row[1:] == row[:-1])
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    kept = pa.py_buffer(np.ascontiguousarray(data[inside[:-1]]))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(size), kept])
    lang = batch.column("lang").cast(pa.string()).fill_null("und").dictionary_encode()
    lang_of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    return words.dictionary_encode(), hashed(data, starts, ends), follows, lang_of, lang.dictionary.to_pylist()


class _Runs:
    """The words of a slice of texts, and which runs of them may be frequent as far as the tables tell."""

    def __init__(self, part: pa.RecordBatch, tables: list[np.ndarray], bits: int):
        self.words, hashes, self.follows, self.lang_of, self.langs = _words(part)
        self.shift = np.uint64(64 - bits)
        own = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs]
        self.word = mixed(hashes + np.array(own, np.uint64)[self.lang_of]) if len(hashes) else hashes
        # What begins at each word: the word itself, the pair, and so on.
        self.hash = [self.word]
        self.passed = [np.ones(len(self.word), bool)]
        if tables:
            self.passed = [self._set(tables[0], self.word)]
            pair = self.follows & self.both(self.passed[0])
            self.hash.append(self._longer())
            self.passed.append(pair & self._set(tables[0], self.hash[1]))
        for table in tables[1:]:
            self.hash.append(self._longer())
            self.passed.append(self.both(self.passed[-1]) & self._set(table, self.hash[-1]))

    def _longer(self) -> np.ndarray:
        """Hashes of the runs that are one word longer."""
        last = np.roll(self.word, -len(self.hash))
        return mixed(self.hash[-1] * _FIRST + last * _SECOND)

    @staticmethod
    def both(passed: np.ndarray) -> np.ndarray:
        """Whether a run and the one a word later passed."""
        return passed & np.concatenate([passed[1:], [False]]) if len(passed) else passed

    def _set(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> self.shift).astype(np.int64)
        return ((table[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)

    def places(self) -> np.ndarray:
        """The places of the runs that the next table counts."""
        if len(self.hash) == 1:
            runs = [self.word, self._longer()[self.follows]]
        else:
            runs = [self._longer()[self.both(self.passed[-1])]]
        return (np.concatenate(runs) >> self.shift).astype(np.int64)


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places with the sums of their counts."""
    places, n = (np.concatenate(x) for x in zip(*counts))
    order = np.argsort(places, kind="stable")
    places, n = places[order], n[order]
    if not len(places):
        return places, n
    starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[starts], np.add.reduceat(n, starts)


def _packed(places: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
    """Sorted places and their counts, a row for each part of the table; counts stop at ``least``, where they decide."""
    part = places >> _PART_BITS
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    offsets = np.concatenate([starts, [len(part)]])
    kind = np.uint8 if least < 256 else np.int64
    inner = (places & (_PART - 1)).astype(np.uint16)
    counts = np.minimum(n, least).astype(kind)

    def binary(values: np.ndarray) -> pa.Array:
        at = pa.py_buffer(offsets * values.itemsize)
        whole = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, at, pa.py_buffer(values)])
        return whole.cast(pa.binary())

    return pa.RecordBatch.from_arrays(
        [pa.array(part[starts], pa.int64()), binary(inner), binary(counts)], names=["part", "places", "counts"]
    )


def frequent_places(docs: DataFrame, least: int, bits: int, tables: list) -> np.ndarray:
    """The next table: a bit for every place whose runs occur ``least`` times together, ``2**MOST_BITS / 8`` bytes at most.

    Without tables it counts words and pairs, with some it counts the runs of one more word than the last. A task packs
    its counts by parts of the table, and each part is summed by one task, a row at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                held.append(np.unique(_Runs(part, known, bits).places(), return_counts=True))
                size += len(held[-1][0])
                if size > MOST_HELD:
                    places, n = _summed(held)
                    # What hardly shrinks is sent on; else it is held with what comes.
                    if len(places) > MOST_HELD // 2:
                        yield _packed(places, n, least)
                        places, n = places[:0], n[:0]
                    held, size = [(places, n)], len(places)
        yield _packed(*_summed(held), least)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(_PART, np.int64)

        def done() -> pa.RecordBatch:
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([packed], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, inner, counts in zip(
                batch.column("part").to_pylist(), batch.column("places"), batch.column("counts")
            ):
                if part != now:
                    if now is not None and (total >= least).any():
                        yield done()
                    now = part
                    total[:] = 0
                kind = np.uint8 if least < 256 else np.int64
                # Places are there once in a row.
                total[np.frombuffer(inner.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), kind)
        if now is not None and (total >= least).any():
            yield done()

    counted = docs.mapInArrow(count, "part long, places binary, counts binary")
    ordered = counted.repartition("part").sortWithinPartitions("part")
    parts = ordered.mapInArrow(sum_up, "part long, bits binary").toArrow()
    out = np.zeros(max(1 << bits, _PART) // 8, np.uint8)
    for part, value in zip(parts.column("part").to_pylist(), parts.column("bits")):
        at = part * (_PART // 8)
        out[at : at + _PART // 8] = np.frombuffer(value.as_buffer(), np.uint8)
    return out


def windows(docs: DataFrame, tables: list, bits: int, longest: int) -> DataFrame:
    """``lang, w1 .. w<longest>, n``: each word with its followers, as often as a task's slice of texts has it.

    ``tables`` are broadcast bitmaps for the runs of up to ``longest - 1`` words; words beyond a run that did not pass are
    null like those beyond the piece.
    """
    names = [f"w{k + 1}" for k in range(longest)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [t.value for t in tables]
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                runs = _Runs(part, known, bits)
                if not len(runs.word):
                    continue
                passed = [*runs.passed]
                while len(passed) < longest:
                    passed.append(_Runs.both(passed[-1]))
                spelling = runs.words.dictionary
                ids = runs.words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                columns = [np.where(passed[k], np.roll(ids, -k), -1) for k in range(longest)]
                # Equal windows get equal numbers, a column at a time.
                number = runs.lang_of
                for column in columns:
                    _, number = np.unique(number * (len(spelling) + 1) + column + 1, return_inverse=True)
                _, first, n = np.unique(number, return_index=True, return_counts=True)
                spelled = [spelling.take(pa.array(c[first], mask=c[first] < 0)).cast(pa.string()) for c in columns]
                lang = pa.array(runs.langs, pa.string()).take(pa.array(runs.lang_of[first]))
                yield pa.RecordBatch.from_arrays([lang, *spelled, pa.array(n)], names=["lang", *names, "n"])

    return docs.mapInArrow(cut, f"lang string, {', '.join(f'{c} string' for c in names)}, n long")


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> DataFrame:
    """``lang, size, phrase, f`` of all phrases of up to ``longest`` words with ``f >= least``; size 0 is all words of a language."""
    docs = spread(docs.select("text", "lang"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((total // 8).bit_length(), LEAST_BITS), MOST_BITS)
    tables: list = []
    for _ in range(max(longest - 2, 1)):
        tables.append(spark.sparkContext.broadcast(frequent_places(docs, least, bits, tables)))
    names = [f"w{k + 1}" for k in range(longest)]
    # Equal windows of all tasks are summed first, so that the copies which ROLLUP makes of a row are made once a window.
    whole_windows = windows(docs, tables, bits, longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    rolled = whole_windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("gone"))
    # What is rolled up is null as padding is: a window of k words is one whose k-th is there and whose others are rolled up.
    whole = F.lit(False)
    for k in range(1, longest + 1):
        whole = whole | ((F.col("gone") == (1 << (longest - k)) - 1) & F.col(f"w{k}").isNotNull() & (F.col("f") >= least))
    all_words = F.col("gone") == (1 << longest) - 1
    size = sum((F.col(c).isNotNull().cast("int") for c in names), F.lit(0))
    return written(
        rolled.filter(whole | all_words).select(
            "lang",
            F.when(all_words, 0).otherwise(size).alias("size"),
            F.concat_ws(" ", *names).alias("phrase"),
            "f",
        ),
        "phrases",
    )


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def _run(words: Column, first: int, n: int) -> Column:
    return F.concat_ws(" ", F.slice(words, first + 1, n))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, cover: int = 80, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of two to ``longest`` words of each language.

    ``a`` is a phrase's count and has to reach ``least``; ``l`` and ``r`` are those of its two parts at the cut with the
    lowest score ``2000000 a / (l + r)``, rounded down. A phrase goes if a longer one around it has ``cover`` percent of
    its occurrences. All products are decimals.
    """
    counts = phrase_counts(docs, least, longest)
    known = counts.filter("size > 0").select("lang", "phrase", "f")
    found = counts.filter("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    words = F.col("words")

    def each(make) -> Column:
        """An array of what ``make`` gives for the size of the phrase."""
        out = F.array()
        for size in range(2, longest + 1):
            out = F.when(F.col("size") == size, F.array(*make(size))).otherwise(out) if make(size) else out
        return out

    cuts = found.withColumn(
        "part",
        F.explode(
            each(
                lambda size: [
                    F.struct(F.lit(k).alias("k"), _run(words, 0, k).alias("first"), _run(words, k, size - k).alias("rest"))
                    for k in range(1, size)
                ]
            )
        ),
    ).select("lang", "phrase", "a", "part.*")
    firsts = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("cut"))

    inner = found.withColumn(
        "phrase",
        F.explode(
            each(lambda size: [_run(words, at, n) for n in range(2, size) for at in range(size - n + 1)] if size > 2 else [])
        ),
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(_whole("longer") * 100 >= _whole("cut.a") * cover, F.lit(False))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(~covered).select("lang", "phrase", "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
