"""The SQL twin of the personal data query."""

from __future__ import annotations

from gavelworks.llm.private_data import BASE, CONTEXT_CHARS, KINDS

_DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
_LUHN = """list_sum(list_transform(range(1, length({d}) + 1), lambda i:
  CASE WHEN i % 2 = 0 THEN CAST({d}[length({d}) + 1 - i] AS INT) * 2
         - CASE WHEN CAST({d}[length({d}) + 1 - i] AS INT) > 4 THEN 9 ELSE 0 END
       ELSE CAST({d}[length({d}) + 1 - i] AS INT) END)) % 10 = 0"""
# Account numbers become decimal digits; 97 goes through them nine at a time.
_PLAIN = "replace(m, ' ', '')"
_MOD97 = f"""list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[1:4], ''),
  lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) + 945 ELSE ascii(c) - 48 END::BIGINT)),
  lambda r, v: CASE WHEN v >= 1000 THEN (r * 100 + v - 1000) % 97 ELSE (r * 10 + v) % 97 END) = 1"""

_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS BIGINT) <= 255, false))) = 4",
    "card": f"length({_DIGITS.format('m')}) BETWEEN 12 AND 19 AND {_LUHN.format(d=_DIGITS.format('m'))}",
    "phone": f"length({_DIGITS.format('m')}) BETWEEN 9 AND 15",
    "iban": _MOD97,
    "ssn": f"regexp_matches(lower(right(p, {CONTEXT_CHARS})), '{KINDS[5].words}')",
}


def _kind(i: int) -> str:
    kind = KINDS[i]
    return f"""SELECT doc_id, {i} AS kind, '{kind.name}' AS name, start, start + length(m) AS stop FROM (
      SELECT doc_id, ms[i] AS m, ps[i] AS p,
        CAST(list_sum(list_transform(ps[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
      FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{kind.pattern}') AS ms, string_split_regex(t, '{kind.pattern}') AS ps
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))) WHERE {_VALID[kind.name]}"""


def private_data_sql() -> str:
    counts = ", ".join(
        f"count(*) FILTER (kind = {i}) AS n_{KINDS[i].name}" for i in range(BASE)
    )
    joined = "coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind){}, '')"
    return f"""WITH found AS ({" UNION ALL ".join(_kind(i) for i in range(len(KINDS)))})
    SELECT d.doc_id, {counts}, sha256({joined.format(f" FILTER (kind < {BASE})")}) AS base_sha256,
      {joined.format(" FILTER (kind IS NOT NULL)")} AS spans
    FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""
