"""URL rules and host reputation.

Where no rule fits, a host is judged by what is known of its pages. Outcomes are counted per host, and each level is
shrunk towards the one above it: the suffix towards all pages, the registered domain towards its suffix, the host
towards its domain, always without its own pages. The strength of each prior is estimated from the spread of that level's
rates (method of moments of the beta-binomial). A host is blocked when the lower bound of its posterior rate is above a
threshold, so little evidence blocks no host among good ones. A host without outcomes has its domain's rate, and so on.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged like any host,
under the empty suffix. A page with several outcomes counts each; null outcomes count for nothing. Without outcomes at
all everything is allowed. Repeated rows give repeated rows; an empty table gives an empty result. Of ``pages`` only the
two named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelworks.session import written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


LEVELS = ["suffix", "domain", "host"]
# A host is blocked when, at so many standard deviations below its mean, its rate is still above the threshold.
DEVIATIONS = 1.645
THRESHOLD = 0.3


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule], part: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits; of equally long ones the first."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.lit(getattr(rule, part))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def _strength(children: DataFrame) -> float:
    """Pages that a prior of this level is worth, from ``n, bad`` of its members."""
    row = children.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("nn"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b"),
    ).first()
    if not row["n"]:
        return 0.0
    mean = row["bad"] / row["n"]
    within = mean * (1 - mean)
    spread = row["b"] - row["bad"] * mean
    room = within * (row["n"] - row["nn"] / row["n"] - (row["k"] - 1))
    share = (spread - (row["k"] - 1) * within) / room if room > 0 else 0.0
    # Without visible spread the prior is strong; with ever so much it is worth four pages.
    share = min(max(share, 0.001), 0.2)
    return 1 / share - 1


def reputations(hosts: DataFrame) -> DataFrame:
    """``host, rate, low`` from ``suffix, domain, host, n, bad``, one row per host, ``n`` being labelled pages."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = F.lit(total["bad"] / total["n"] if total["n"] else 0.0)
    above, key = None, []
    for level in LEVELS:
        key = [*key, level]
        own = hosts.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        worth = F.lit(_strength(own.filter(F.col("n") > 0)))
        # What the level above knows without this member, whose pages would count twice.
        if above is None:
            rest, rest_bad = F.lit(total["n"] or 0) - F.col("n"), F.lit(total["bad"] or 0) - F.col("bad")
        else:
            own = own.join(above, key[:-1])
            rest, rest_bad = F.col("above_a") + F.col("above_b") - F.col("n"), F.col("above_a") - F.col("bad")
        mean = F.when(rest > 0, rest_bad / rest).otherwise(overall)
        a, b = F.col("bad") + worth * mean, F.col("n") - F.col("bad") + worth * (1 - mean)
        own = own.select(*key, a.alias("a"), b.alias("b"))
        above = own.select(*key, F.col("a").alias("above_a"), F.col("b").alias("above_b"))
    rate = F.when(F.col("a") + F.col("b") > 0, F.col("a") / (F.col("a") + F.col("b"))).otherwise(0.0)
    both = F.col("a") + F.col("b")
    deviation = F.when(both > 0, F.sqrt(F.col("a") * F.col("b") / (both * both * (both + 1)))).otherwise(0.0)
    return own.select("host", rate.alias("rate"), (rate - DEVIATIONS * deviation).alias("low"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    threshold: float = THRESHOLD,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict``; ``outcomes`` has ``page_id`` and ``bad`` (0 or 1)."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.filter(F.col("bad").isNotNull()).select(F.col("page_id").alias("_page"), "bad")
    # Counted per page first: a page with many outcomes is then one row of the join.
    known = known.groupBy("_page").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    seen = rows.select("page_id", "host").join(known, F.col("page_id") == F.col("_page"), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    hosts = seen.groupBy("host").agg(zero("n"), zero("bad")).withColumns(
        {"suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2)}
    )
    known_hosts = written(reputations(written(hosts, "hosts")), "reputations")
    by_rule = rule_of(F.col("host"), F.col("path"), rules, "verdict")
    by_host = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return rows.join(known_hosts, "host").select(
        "page_id",
        "host",
        "path",
        rule_of(F.col("host"), F.col("path"), rules, "text").alias("rule"),
        F.coalesce(by_rule, by_host).alias("verdict"),
    )
