"""Grouped prefix join: which texts share most of their word shingles.

1. A text becomes its set of hashed shingles. Texts with equal sets are one class.
2. Shingles are ordered, the frequent ones last. Two sets with enough in common share one of the first shingles of that
   order, their prefixes. Classes with identical prefixes and size are one group, which is listed once per shingle.
   Shingles held by the same groups are one list.
3. A few star rounds test each group of a list against one of another component, and members against the centre of their
   group. Links join classes into components, so a large cluster of near copies costs as many tests as it has members.
4. Group pairs that share a list across components are enumerated by a join on the list, whose condition
   holds exact filters: sizes and the distance of 512-bit parity maps. They are expanded into
   class pairs and filtered again; one pair of each two components is tested, then what still crosses. Before texts are
   fetched for a test, parity maps of about as many bits as the sets have shingles must let the pair through.

A pair inside one component needs no test, and every other pair that the filters let through gets one, so no link
between components is missed. The order only decides how much work there is: frequent shingles are those with the
highest counts in samples of all texts (``HEAVY`` of them), and any order gives the same components.

Defined results: words are runs without white space (space, tab to carriage return), A-Z lower-cased. A text of fewer
words than a shingle has one shingle, all its words; a text without words, or null, has none and is linked with nothing.
Repeated rows are rows of one class. The component of a row is the smallest id reachable; null ids are passed over, and
a component without any id has null. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.components import components
from gavelworks.llm.words import SMALL_BYTES, shingle_sets, slices
from gavelworks.session import arrow_batches, written

# Frequent shingles that are told apart by count, and the count from which they are looked at.
HEAVY = 65_536
LEAST_HEAVY = 8
STAR_ROUNDS = 2
# Lists of a group by which a pair tells whether it is made elsewhere.
FIRST_LISTS = 32
MAPS = 8  # longs of the small parity map, which every set has
# Bytes of texts that go to a Python worker at once; they are held there and, several times, beside the heap of an executor.
BATCH_BYTES = 4_000_000
# Buckets of the filter that keeps texts of tested classes; a fixed size, 65,536 rows of 64 bits.
FILTER_BITS = 22


def _ceil_div(a, b):
    return -(-a // b)


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``HEAVY`` shingles that many texts hold, sorted, and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                small = slices(part, "text", SMALL_BYTES)
                sets = {s.tobytes(): s for some in small for s in shingle_sets(some.column("text"), n)}
                found, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets.values()]), return_counts=True)
                many = times > 1
                yield pa.record_batch([found[many].view(np.int64), times[many]], names=["shingle", "n"])

    counts = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= LEAST_HEAVY).orderBy(F.desc("n"), "shingle").limit(HEAVY).toPandas()
    shingles, times = top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(shingles)
    return shingles[order], times[order]


def _parity_map(s: np.ndarray, longs: int) -> np.ndarray:
    """Bit ``i`` tells whether an odd number of hashes is ``i`` modulo the bits."""
    odd = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(bounds, np.concatenate([np.zeros(0, np.int64), *rows]))


def signatures(docs: DataFrame, n: int, per_hundred: int) -> DataFrame:
    """Per row of ``doc_id, text, key``: set size, digests of set and group, prefix and parity maps.

    The large map has about as many bits as the set has shingles, and is empty
    where the small one has them already.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, times = frequent.value
        for batch in batches:
            for part in slices(batch, "text", SMALL_BYTES):
                sizes, classes, groups, prefixes, maps, large = [], [], [], [], [], []
                for s in shingle_sets(part.column("text"), n):
                    size = len(s)
                    sizes.append(size)
                    classes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    maps.append(_parity_map(s, MAPS))
                    longs = 1 << max(0, (size - 1) // 64).bit_length()
                    large.append(_parity_map(s, longs) if longs > MAPS else maps[-1][:0])
                    first = size - _ceil_div(per_hundred * size, 100) + 1 if size else 0
                    if len(heavy) and size:
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        weight = np.where(heavy[at] == s, times[at], 0)
                        s = s[np.argsort(weight, kind="stable")]
                    prefix = s[:first]
                    groups.append(hashlib.blake2b(prefix.tobytes() + size.to_bytes(8, "little"), digest_size=16).digest())
                    prefixes.append(prefix.view(np.int64))
                maps = np.stack(maps)
                columns = [part.column("doc_id"), part.column("key"), pa.array(sizes, pa.int64())]
                columns += [pa.array(classes, pa.binary()), pa.array(groups, pa.binary()), _lists(prefixes), _lists(large)]
                columns += [pa.array(maps[:, k]) for k in range(MAPS)]
                yield pa.record_batch(columns, names=[*"doc_id key n digest group prefix large".split(), *map_names])

    map_names = [f"m{k}" for k in range(MAPS)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {id_type}, key long, n long, digest binary, group binary, prefix array<long>, large array<long>"
    return docs.mapInArrow(sign, kinds + "".join(f", {m} long" for m in map_names))


def _common(na: Column, nb: Column, per_hundred: int) -> Column:
    """Shingles that two sets of these sizes must share."""
    return F.ceil((na + nb) * per_hundred / (100 + per_hundred))


def _distance(a: str, b: str) -> Column:
    """Bits in which two parity maps differ: at most the shingles that one set has and the other not."""
    out = F.lit(0)
    for k in range(MAPS):
        out = out + F.bit_count(F.col(f"{a}.m{k}").bitwiseXOR(F.col(f"{b}.m{k}")))
    return out


def _fits(a: str, b: str, per_hundred: int, slack: Column | int = 0) -> Column:
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = _distance(a, b) - slack <= na + nb - 2 * _common(na, nb, per_hundred)
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * per_hundred) & near


def _possible(pairs: DataFrame, classes: DataFrame, per_hundred: int) -> DataFrame:
    """The pairs ``a, b`` of classes that their large parity maps let through."""
    one, two = (classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("large").alias(f"l_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    longs = F.least(F.size("l_a"), F.size("l_b"))

    def folded(x: str) -> Column:
        # A map of twice the bits becomes the smaller one where its halves are joined.
        xor = lambda i: F.aggregate(
            F.sequence(i, F.size(x) - 1, longs), F.lit(0).cast("long"), lambda v, j: v.bitwiseXOR(F.get(F.col(x), j))
        )
        return F.when(F.size(x) == longs, F.col(x)).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), xor))

    differing = F.zip_with(folded("l_a"), folded("l_b"), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    distance = F.when(longs > 0, F.aggregate(differing, F.lit(0), lambda u, v: u + v)).otherwise(0)
    na, nb = F.col("n_a"), F.col("n_b")
    return both.filter(distance <= na + nb - 2 * _common(na, nb, per_hundred)).select("a", "b")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, per_hundred: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets really share enough, from their texts."""
    pairs = written(_possible(pairs, classes, per_hundred), "possible")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = written(classes.select("class", "doc_id", "key").join(wanted, "class"), "wanted")
    place = lambda: F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << FILTER_BITS))
    # A bitmap of fixed size lets most other texts go before any shuffle.
    bits = wanted.groupBy(F.shiftright(place(), 6).alias("_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, key), {1 << FILTER_BITS}) % 64 as int))")).alias("_bits")
    )
    texts = (
        docs.withColumn("_place", place())
        .withColumn("_word", F.shiftright("_place", 6))
        .join(F.broadcast(bits), "_word")
        .filter(F.expr("shiftrightunsigned(_bits, cast(_place % 64 as int)) & 1 = 1"))
        .select("doc_id", "key", "text")
    )
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["key"] == wanted["key"])
    texts = written(texts.join(wanted, same).select("class", "text"), "texts")
    one, two = (texts.select(F.col("class").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text_b", SMALL_BYTES):
                rights = shingle_sets(part.column("text_b"), n)
                good = []
                names = part.column("a").to_pylist()
                for i, name in enumerate(names):
                    if name not in known:
                        known = {name: shingle_sets(part.column("text_a").slice(i, 1), n)[0]}
                    left, right = known[name], rights[i]
                    shared = len(np.intersect1d(left, right, assume_unique=True))
                    good.append(100 * shared >= per_hundred * (len(left) + len(right) - shared))
                yield pa.record_batch([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(good))

    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return written(both.mapInArrow(test, "a long, b long"), "links")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the component of their class; a class without links is its own."""
    out = rows.join(found, rows["class"] == found["node"], "left")
    return out.select(*[rows[c] for c in rows.columns], F.coalesce("component", rows["class"]).alias("component"))


def _across_components(lists: DataFrame, member: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of lists that span several components, with the group's ``component`` (null if its members are in several)
    and the ``low``est of its members'."""
    of = _labelled(member.select("class", "gid"), found).groupBy("gid")
    of = of.agg(F.min("component").alias("low"), F.max("component").alias("high"))
    component = F.when(F.col("low") == F.col("high"), F.col("low")).alias("component")
    rows = lists.join(of.select("gid", "low", component), "gid")
    spread = rows.groupBy("list").agg(
        F.min("low").alias("a"), F.max("low").alias("b"), F.count_if(F.col("component").isNull()).alias("no")
    )
    spread = spread.filter((F.col("a") != F.col("b")) | (F.col("no") > 0)).select("list")
    return rows.join(spread, "list")


def jaccard_components(
    docs: DataFrame, words: int = 5, per_hundred: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, key`` for every row, ``key`` being a hash of its text.

    Rows link when ``100 * intersection >= per_hundred * union`` of their sets
    of ``words``-word shingles.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    # Numbered as they are written: the numbers stay what they are.
    number = F.monotonically_increasing_id()
    with arrow_batches(spark, BATCH_BYTES):
        signed = written(signatures(docs, words, per_hundred).withColumn("row", number), "signed")
    maps = [f"m{k}" for k in range(MAPS)]
    # A class is named by the first of its rows: as a number it is short, and its smallest is found without sorting.
    named = signed.filter(F.col("n") > 0).groupBy("digest")
    named = written(named.agg(F.min("row").alias("class"), F.min("doc_id").alias("least")), "named")
    classes = signed.drop("prefix", "digest").withColumnRenamed("row", "class").join(named.select("class"), "class")
    classes = written(classes, "classes")

    # Groups: classes with identical prefix and size; the centre's map, and how far members are from it.
    centres = classes.groupBy("group").agg(F.min("class").alias("class"), F.count(F.lit(1)).alias("members"))
    centres = centres.join(classes.select("class", "n", *maps), "class").withColumnRenamed("class", "gid")
    centres = written(centres, "centres")
    gids = centres.select("group", "gid")
    member = written(classes.select("class", "group", "n", *maps).join(gids, "group").drop("group"), "members")
    several = centres.filter(F.col("members") > 1)
    inner = written(
        member.alias("m").join(several.alias("c"), "gid").select(
            "gid", F.col("gid").alias("a"), F.col("m.class").alias("b"), _distance("m", "c").alias("far")
        ),
        "inner",
    )
    radius = inner.groupBy("gid").agg(F.max("far").alias("radius"))
    groups = centres.select("gid", "n", *maps).join(radius, "gid", "left")
    groups = written(groups.withColumn("radius", F.coalesce("radius", F.lit(0))), "groups")

    # Shingles in the prefixes of at least two groups. Those that the same groups hold are one list: a pair that shares a
    # passage is then found once, not once a word. The long table of groups and shingles moves once, and all three reads of
    # it take what was moved.
    gid = F.col("gid")
    prefixes = signed.select(F.col("row").alias("gid"), "prefix").join(centres.select("gid"), "gid")
    listed = prefixes.select("gid", F.explode("prefix").alias("shingle")).repartition("shingle")
    alike = listed.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64(gid)).alias("x"), F.bit_xor(F.xxhash64(gid, F.lit(1))).alias("y")
    )
    alike = alike.filter(F.col("k") > 1)
    first = alike.groupBy("k", "x", "y").agg(F.min("shingle").alias("list"))
    lists = listed.join(alike.join(first, ["k", "x", "y"]).select("shingle", "list"), "shingle")
    lists = written(lists.select("list", "gid").distinct(), "lists")

    # Star rounds: each group of a list that spans components with one of another component, members of a group with its
    # centre. A cluster of near copies becomes one component after as many tests as it has members.
    # Empty tables of ``range``: those of ``createDataFrame`` start Python workers of their own, which stay.
    no_row = spark.range(0)
    tested = links = no_row.select(F.col("id").alias("a"), F.col("id").alias("b"))
    found = no_row.select(F.col("id").alias("node"), F.col("id").alias("component"))
    for turn in range(STAR_ROUNDS):
        rows = _across_components(lists, member, found)
        ends = rows.groupBy("list").agg(
            F.min("low").alias("e"), F.min_by("gid", "low").alias("e_gid"), F.max_by("gid", "low").alias("f_gid")
        )
        other = F.when(F.col("low") == F.col("e"), F.col("f_gid")).otherwise(F.col("e_gid"))
        stars = rows.join(ends, "list").select("gid", other.alias("other")).filter(gid != F.col("other")).distinct()
        stars = (
            stars.join(groups.alias("a"), stars["gid"] == F.col("a.gid"))
            .join(groups.alias("b"), stars["other"] == F.col("b.gid"))
            .filter(_fits("a", "b", per_hundred))
            .select(F.least("a.gid", "b.gid").alias("a"), F.greatest("a.gid", "b.gid").alias("b"))
        )
        if not turn:
            stars = stars.unionByName(inner.filter(F.col("a") != F.col("b")).select("a", "b"))
        stars = written(stars.distinct().join(tested, ["a", "b"], "left_anti"), "stars")
        tested = tested.unionByName(stars)
        new = _linked(stars, classes, docs, words, per_hundred)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        found = components(links)

    # Group pairs across components.
    rows = _across_components(lists, member, found)
    firsts = rows.groupBy("gid").agg(F.slice(F.array_sort(F.collect_list("list")), 1, FIRST_LISTS).alias("first"))
    rows = written(rows.drop("low").join(groups.join(firsts, "gid"), "gid"), "crossing")
    member = written(_labelled(member, found), "labelled")
    left, right = rows.alias("a"), rows.alias("b")
    apart = F.coalesce(F.col("a.component") != F.col("b.component"), F.lit(True))
    near = _fits("a", "b", per_hundred, F.col("a.radius") + F.col("b.radius"))
    # A pair is made at the first of the lists that both are known to share, not again at each other one.
    again = F.array_min(F.array_intersect("a.first", "b.first")) < F.col("a.list")
    once = F.coalesce(~again, F.lit(True))
    pairs = left.join(
        right, (F.col("a.list") == F.col("b.list")) & (F.col("a.gid") < F.col("b.gid")) & apart & near & once
    ).select(F.col("a.gid").alias("g"), F.col("b.gid").alias("h")).distinct()
    # Members of one group that are still apart.
    split = member.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    inside = split.filter(F.col("low") != F.col("high")).select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    pairs = pairs.unionByName(inside)
    across = (F.col("a.component") != F.col("b.component")) & _fits("a", "b", per_hundred)
    crossing = (
        pairs.join(member.alias("a"), F.col("g") == F.col("a.gid"))
        .join(member.alias("b"), (F.col("h") == F.col("b.gid")) & across)
        .select(
            F.least("a.class", "b.class").alias("a"),
            F.greatest("a.class", "b.class").alias("b"),
            F.least("a.component", "b.component").alias("low"),
            F.greatest("a.component", "b.component").alias("high"),
        )
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    crossing = written(crossing, "pairs")

    # One pair of each two components, then those that still cross.
    picked = written(
        crossing.groupBy("low", "high").agg(F.min("a").alias("a"), F.min_by("b", "a").alias("b")).select("a", "b"), "picked"
    )
    new = _linked(picked, classes, docs, words, per_hundred)
    if not new.isEmpty():
        links = links.unionByName(new)
        found = components(links)
    label = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    left_over = (
        crossing.select("a", "b")
        .join(picked, ["a", "b"], "left_anti")
        .join(label("a"), "a", "left")
        .join(label("b"), "b", "left")
        .filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
        .select("a", "b")
    )
    new = _linked(written(left_over, "left_over"), classes, docs, words, per_hundred)
    if not new.isEmpty():
        found = components(links.unionByName(new))

    # The smallest id of each component, for every row.
    rows = signed.select("doc_id", "key", "n", "digest")
    least = written(_labelled(named, found), "least")
    whole = least.groupBy("component").agg(F.min("least").alias("component_id"))
    names = written(least.join(whole, "component").select("digest", "component_id"), "names")
    with_words = rows.filter(F.col("n") > 0).join(names, "digest")
    without = rows.filter(F.col("n") == 0).withColumn("component_id", F.col("doc_id"))
    return with_words.unionByName(without.select(with_words.columns)).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "key"
    )


def one_of_each(docs: DataFrame, words: int = 5, per_hundred: int = 80) -> DataFrame:
    """The rows of ``docs``, with their columns, whose id is the smallest of their component.

    In a component with ids the rows without one go; a component without any
    keeps all its rows.
    """
    found = jaccard_components(docs, words, per_hundred).filter(F.col("component_id").isNotNull())
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("key").alias("_key")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_key"])
    return docs.join(gone, same, "left_anti").select(docs.columns)
