"""The SQL twin of the URL filter query."""

from __future__ import annotations

from collections.abc import Sequence

from gavelworks.llm.url_filter import DEVIATIONS, LEVELS, THRESHOLD, Rule


def url_filter_sql(rules: Sequence[Rule]) -> str:
    cases = {"text": "", "verdict": ""}
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        for part in cases:
            cases[part] += f" WHEN {fits} THEN '{getattr(rule, part)}'"
    steps = []
    for i, level in enumerate(LEVELS):
        keys = ", ".join(LEVELS[: i + 1])
        up = f"post_{LEVELS[i - 1]}" if i else "total"
        join = f"JOIN {up} USING ({', '.join(LEVELS[:i])})" if i else "CROSS JOIN total"
        own = f"own_{level}"
        mean = f"""CASE WHEN {up}.a + {up}.b - {own}.n > 0 THEN ({up}.a - {own}.bad) / ({up}.a + {up}.b - {own}.n)
      ELSE (SELECT a / (a + b) FROM total) END"""
        steps.append(f"""
own_{level} AS (SELECT {keys}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM hosts GROUP BY ALL),
sums_{level} AS (SELECT count(*) AS k, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS b,
  sum(bad) / sum(n) AS m FROM own_{level} WHERE n > 0),
worth_{level} AS (SELECT 1 / least(greatest(coalesce((b - bad * m - (k - 1) * m * (1 - m))
  / nullif(greatest(m * (1 - m) * (n - nn / n - (k - 1)), 0), 0), 0), 0.001), 0.2) - 1 AS w FROM sums_{level}),
prior_{level} AS (SELECT {", ".join(f"{own}.{k}" for k in LEVELS[: i + 1])}, {own}.n, {own}.bad, {mean} AS mean
  FROM {own} {join}),
post_{level} AS (SELECT {keys}, bad + w * mean AS a, n - bad + w * (1 - mean) AS b FROM prior_{level}, worth_{level})""")
    return f"""WITH rows AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
seen AS (SELECT host, string_split(host, '.') AS labels, toxic FROM rows LEFT JOIN labels ON doc_id = page_id),
hosts AS (SELECT labels[-1] AS suffix, array_to_string(labels[-2:], '.') AS domain, host, count(toxic) AS n,
  coalesce(sum(toxic), 0) AS bad FROM seen GROUP BY ALL),
total AS (SELECT sum(bad)::DOUBLE AS a, (sum(n) - sum(bad))::DOUBLE AS b FROM hosts),{",".join(steps)}
SELECT page_id, host, path, CASE{cases["text"]} END AS rule, CASE{cases["verdict"]}
  WHEN a / (a + b) - {DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {THRESHOLD} THEN 'block'
  ELSE 'allow' END AS verdict
FROM rows JOIN post_host USING (host)"""
