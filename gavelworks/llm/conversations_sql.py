"""The repair query in SQL: a recursive step a row, over the best edits up to each state."""

from __future__ import annotations

# CRC-32 of an ASCII text: its bytes, each followed by eight shifts.
_CRC = """xor(list_reduce(
      [CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(spelled, '')]),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END),
    CAST(4294967295 AS BIGINT))"""

SQL = f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spelled
    FROM conversations) s),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w AS before,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS black
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS (
  SELECT *, CASE WHEN black = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN right(black, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
-- States: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
added(q, inserts, more, into_, spelled) AS (VALUES
  (0, '', 0, 0, ''), (1, '', 0, 1, ''), (2, '', 0, 2, ''), (3, '', 0, 3, ''),
  (0, 'I', 2, 2, 'user:'), (1, 'I', 2, 2, 'user:'), (2, 'I', 2, 3, 'assistant:'), (3, 'I', 2, 2, 'user:'),
  (0, 'II', 4, 3, 'user:' || chr(10) || 'assistant:'), (1, 'II', 4, 3, 'user:' || chr(10) || 'assistant:')),
moves(kind, initial, q, letter, cost, into_) AS (VALUES
  ('stay', 's', 0, 'K', 0, 1), ('stay', 'u', 0, 'K', 0, 2), ('stay', 'u', 1, 'K', 0, 2), ('stay', 'u', 3, 'K', 0, 2),
  ('stay', 'a', 2, 'K', 0, 3), ('stay', NULL, 0, 'R', 2, 2), ('stay', NULL, 1, 'R', 2, 2), ('stay', NULL, 3, 'R', 2, 2),
  ('stay', NULL, 2, 'R', 2, 3), ('go', NULL, 0, 'D', 3, 0), ('go', NULL, 1, 'D', 3, 1), ('go', NULL, 2, 'D', 3, 2),
  ('go', NULL, 3, 'D', 3, 3)),
best AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST('' AS VARCHAR) AS done FROM facts
  UNION ALL
  SELECT conv_id, n, i, q, cost, audit, done FROM (
    SELECT b.conv_id, b.n, b.i + 1 AS i, m.into_ AS q,
      b.cost + a.more + m.cost + CASE WHEN j.fault = 'truncated' AND m.kind = 'stay' THEN 1 ELSE 0 END AS cost,
      b.audit || a.inserts || m.letter AS audit,
      b.done || CASE WHEN a.spelled <> '' THEN a.spelled || chr(10) ELSE '' END
        || CASE m.letter WHEN 'K' THEN j.role || ':' || j.text || chr(10)
             WHEN 'R' THEN CASE m.into_ WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || j.text || chr(10) ELSE '' END AS done
    FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1
      JOIN added a ON a.q = b.q JOIN moves m ON m.q = a.into_
    WHERE (m.initial IS NULL OR m.initial = j.initial) AND (m.kind = 'go' OR j.fault NOT IN ('blank', 'duplicate'))) t
  QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY cost, audit) = 1),
ended AS (
  SELECT b.conv_id, b.cost + a.more AS cost, b.audit || a.inserts AS audit,
    rtrim(b.done || a.spelled, chr(10)) AS done
  FROM best b JOIN added a ON a.q = b.q WHERE b.i = b.n AND a.into_ IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + a.more, b.audit || a.inserts) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(done, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
