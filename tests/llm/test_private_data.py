import random
import re

import duckdb
from pyspark.sql import functions as F

from gavelworks.llm.private_data import KINDS, described, find_private_data

from frames import no_documents, odd_documents


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    found = []
    for k, (pattern, good) in enumerate(checks.values()):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if good(m[0])]
    names = list(checks)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))


def base(spans):
    return described(F.filter(spans, lambda s: s["kind"] < 4))


def test_agrees_with_a_plain_search(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_x@d.e", "x.y+z@q-r.st", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "0001.2.3.255", "4111 1111 1111 1111"]
    parts += ["5500-0000-0000-0004", "+1 (555) 010-9999", "+49 30 1234567", "+1", "12", " ", " ", ".", "é", "\U0001f600", "\n", "-"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(600)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in find_private_data(frame).select("text", base(F.col("spans")).alias("s")).collect():
        assert row.s == brute(row.text), row.text


def test_checksums_and_context(spark):
    texts = {
        "my IBAN is DE89 3704 0044 0532 0130 00 ok": "iban",
        "my IBAN is DE88 3704 0044 0532 0130 00 ok": "",
        "social security 123-45-6789": "ssn",
        "number 123-45-6789": "",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in find_private_data(frame).collect():
        assert [KINDS[s.kind].name for s in row.spans if s.kind > 3] == [k for k in [texts[row.text]] if k]
        if row.text.startswith("my IBAN is DE89"):
            (span,) = [s for s in row.spans if s.kind == 4]
            assert (span.start, span.end, span.score) == (11, 38, 1.0)


# By place in the text: each place where a number stands by itself, and 40 characters on either side of it.
SSN_SQL = """WITH places AS (SELECT id, t, unnest(range(1, length(t) - 9)) AS p FROM texts)
SELECT id, string_agg((p - 1) || ':' || (p + 10), ',' ORDER BY p) AS spans FROM places
WHERE regexp_full_match(substr(t, p, 11), '[0-9]{3}-[0-9]{2}-[0-9]{4}')
  AND (p = 1 OR NOT regexp_full_match(substr(t, p - 1, 1), '[A-Za-z0-9_]'))
  AND NOT regexp_full_match(substr(t, p + 11, 1), '[A-Za-z0-9_]')
  AND (regexp_matches(lower(substr(t, greatest(p - 40, 1), least(p - 1, 40))), 'ssn|social security|tax id|national id')
    OR regexp_matches(lower(substr(t, p + 11, 40)), 'ssn|social security|tax id|national id'))
GROUP BY id"""


def test_context_is_what_stands_around_in_the_text(spark):
    texts = [
        "social security: 123-45-6789, 987-65-4321",
        "123-45-6789 (SSN)",
        "123-45-6789, 987-65-4321 are SSN",
        "SSN" + "." * 37 + "123-45-6789",
        "SSN" + "." * 38 + "123-45-6789" + "." * 38 + "ssn",
    ]
    rng = random.Random(5)
    parts = ["123-45-6789", "987-65-4321", "SSN", "tax ID", " ", " ", ", ", "\U0001f600 ", "a@b.c", "\n", ". . . . . . . . .", "x" * 30]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]
    db = duckdb.connect()
    db.execute("CREATE TABLE texts (id BIGINT, t VARCHAR)")
    db.executemany("INSERT INTO texts VALUES (?, ?)", list(enumerate(texts)))
    expected = dict(db.execute(SSN_SQL).fetchall())
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: ",".join(f"{s.start}:{s.end}" for s in r.spans if s.kind == 5) for r in find_private_data(frame).collect()}
    assert [got[i] for i in range(5)] == ["17:28,30:41", "0:11", "0:11,13:24", "40:51", ""]
    for i, text in enumerate(texts):
        assert got[i] == expected.get(i, ""), text


def test_many_findings_and_long_runs(spark):
    texts = ["a@b.c " * 3000, "a" * 200_000, "1" * 200_000, "a@" * 50_000, "+" * 1000, None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = find_private_data(frame).select("text", base(F.col("spans")).alias("s"), F.col("spans")).collect()
    for row in got:
        assert row.s == brute(row.text)
    assert len(got[0].spans) == 3000


def test_odd_frames(spark):
    got = find_private_data(odd_documents(spark).withColumn("spans", F.lit(1)))
    assert got.count() == 11 and got.columns[-1] == "spans" and got.filter(F.col("spans").isNull()).count() == 0
    assert find_private_data(no_documents(spark)).count() == 0


def test_only_spark_functions(spark):
    plan = find_private_data(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
