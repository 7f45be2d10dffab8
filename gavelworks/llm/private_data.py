"""Personal data in texts, with Spark's own functions only.

Patterns propose spans, checksums confirm them (Luhn for card numbers, mod 97 for bank account numbers), and words in the
``CONTEXT_CHARS`` before or behind a span, whatever else stands there, raise its score. The four base kinds (email, ip, card, phone) are reported whatever their score; of the
added kinds (iban, ssn) those that reach ``LEAST_SCORE``.

Defined results: a null text counts as empty, and a text without findings has an empty list. Matches of one kind are
leftmost and do not overlap; a match that fails its check is dropped without another try inside it. Spans count code
points, end exclusive, and are ordered by start, then kind as listed. Rows that repeat get equal lists; all columns of
the input stay except ``spans``, which is replaced. Work is linear in the text, also without any white space in it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SCORE = 0.5
CONTEXT_CHARS = 40
CONTEXT_SCORE = 0.4
# Fixed width of the blocks in which running totals are taken.
BLOCK = 512
# Texts are cut into pieces of this length, so that a window is found without going through the text again.
PIECE = 64


class Kind(NamedTuple):
    name: str
    pattern: str  # as every engine reads it
    quick: str  # text that each match contains
    linear: str  # the same matches, without trying a run of characters again from each of its places
    score: float
    words: str
    valid: Callable[[Column], Column]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _length_between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check: every second one from the right doubled, digits summed."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, first four characters moved to its end and letters as 10 to 35, leaves 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _ip(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False)))


def _card(c: Column) -> Column:
    return _length_between(_digits(c), 12, 19) & luhn(_digits(c))


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

KINDS = [
    Kind(
        "email",
        rf"{_LOCAL}+@{_LABEL}+(\.{_LABEL}+)+",
        "@",
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
        0.9,
        "mail|contact|write",
        lambda c: F.lit(True),
    ),
    Kind(
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        ".",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.5,
        "ip|host|server|address|login",
        _ip,
    ),
    Kind(
        "card",
        r"[0-9]([\x20-]?[0-9])+",
        "",
        r"[0-9](?:[\x20-]?[0-9])++",
        0.6,
        "card|visa|credit|pay|karte|tarjeta|carte",
        _card,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.6,
        "phone|call|tel|mobile|fax",
        lambda c: _length_between(_digits(c), 9, 15),
    ),
    Kind(
        "iban",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "",
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        0.6,
        "iban|account|bank|konto|cuenta|compte",
        mod97,
    ),
    Kind(
        "ssn",
        r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        "-",
        r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
        0.3,
        "ssn|social security|tax id|national id",
        lambda c: F.lit(True),
    ),
]
BASE = 4


def _running(lengths: Column) -> Column:
    """Inclusive running totals of an array, block by block, so that no long array is copied for each element."""
    def grow(a: Column) -> Column:
        last = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))
        return F.aggregate(a, F.array().cast("array<int>"), lambda s, x: F.array_append(s, last(s) + x))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: grow(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )
    upto = grow(F.transform(blocks, lambda b: F.element_at(b, -1)))
    before = F.concat(F.array(F.lit(0)), upto)
    whole = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o))
    return F.when(F.size(lengths) > 0, F.flatten(whole)).otherwise(F.array().cast("array<int>"))


def _piece_of(pieces: Column, start: Column, length: Column) -> Column:
    """The text from a position on, at most ``PIECE`` characters of it."""
    k = F.floor(start / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substr(two, start - k * PIECE + 1, length)


def find_private_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of ``start, kind, end, score``, kind being a place in ``KINDS``."""
    kept = [c for c in docs.columns if c != "spans"]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    # Each step is a projection of its own: what is used twice is then computed once.
    df = df.withColumns(
        {
            f"_m{i}": F.when(F.contains("_text", F.lit(k.quick)), F.regexp_extract_all("_text", F.lit(k.linear), F.lit(0)))
            .otherwise(none)
            for i, k in enumerate(KINDS)
        }
    )
    df = df.withColumns(
        {
            f"_p{i}": F.when(F.size(f"_m{i}") > 0, F.split("_text", k.linear)).otherwise(none)
            for i, k in enumerate(KINDS)
        }
    )
    df = df.withColumns(
        {
            f"_e{i}": _running(
                F.zip_with(F.slice(f"_p{i}", 1, F.size(f"_m{i}")), f"_m{i}", lambda p, m: F.length(p) + F.length(m))
            )
            for i in range(len(KINDS))
        }
    )
    any_match = F.greatest(*[F.size(f"_m{i}") for i in range(len(KINDS))]) > 0
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn("_w", F.when(any_match, pieces).otherwise(none))

    def found(i: int, kind: Kind) -> Column:
        rows = F.arrays_zip(F.col(f"_m{i}").alias("m"), F.col(f"_e{i}").alias("e"))
        rows = F.filter(rows, lambda r: kind.valid(r["m"]))

        def span(r: Column) -> Column:
            start = r["e"] - F.length(r["m"])
            first = F.greatest(start - CONTEXT_CHARS, F.lit(0))
            sides = _piece_of(F.col("_w"), first, start - first), _piece_of(F.col("_w"), r["e"], F.lit(CONTEXT_CHARS))
            before, behind = (F.lower(side).rlike(kind.words) for side in sides)
            score = F.lit(kind.score) + F.when(before | behind, CONTEXT_SCORE).otherwise(0.0)
            return F.struct(
                start.alias("start"),
                F.lit(i).alias("kind"),
                r["e"].alias("end"),
                F.least(score, F.lit(1.0)).alias("score"),
            )

        spans = F.transform(rows, span)
        return spans if i < BASE else F.filter(spans, lambda s: s["score"] >= LEAST_SCORE)

    spans = F.array_sort(F.concat(*[found(i, k) for i, k in enumerate(KINDS)]))
    return df.select(*[F.col(f"`{c}`") for c in kept], spans.alias("spans"))


def described(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")
