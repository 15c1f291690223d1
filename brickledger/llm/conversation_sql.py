"""The expected result of conversation repair as SQL: one row of a conversation after the other."""

from __future__ import annotations

NOTHING = "NULL::STRUCT(c BIGINT, t VARCHAR, l VARCHAR)"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def least(*scripts: str) -> str:
    """The cheapest script, of equal ones the first by its letters."""
    return f"list_min([{', '.join(scripts)}])"


def longer(script: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {script} IS NOT NULL AND {when} THEN {{'c': {script}.c + {cost}, 't': {script}.t || '{letter}', 'l': {script}.l || {line}}} END"


def ins(script: str, name: str) -> str:
    return longer(script, "3", "I", f"chr(10) || '{name}:'")


def keep(script: str, initial: str) -> str:
    return longer(script, "more", "K", "chr(10) || role || ':' || text", f"alive AND p = '{initial}'")


def rerole(script: str, name: str) -> str:
    return longer(script, "3 + more", "R", f"chr(10) || '{name}:' || text", "alive")


def closed(source: str) -> str:
    """The best script for each state (e: nothing yet, s, u, a), insertions included."""
    return f"""SELECT * REPLACE ({least('a', ins('u', 'assistant'))} AS a) FROM (
      SELECT * REPLACE ({least('u', *[ins(x, 'user') for x in 'esa'])} AS u) FROM ({source}))"""


def repair_sql() -> str:
    start = closed(f"SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 't': '', 'l': ''}} AS e, {NOTHING} AS s, {NOTHING} AS u, {NOTHING} AS a FROM ids")
    before = ("b.e", "b.s", "b.a")
    step = closed(f"""SELECT f.conv_id, f.pos AS i, {longer('b.e', '4', 'D')} AS e, {least(longer('b.s', '4', 'D'), keep('b.e', 's'))} AS s,
        {least(longer('b.u', '4', 'D'), *[keep(x, 'u') for x in before], *[rerole(x, 'user') for x in before])} AS u,
        {least(longer('b.a', '4', 'D'), keep('b.u', 'a'), rerole('b.u', 'assistant'))} AS a
      FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.i + 1""")
    return f"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT n.*, xor(list_reduce([ord(x)::BIGINT FOR x IN string_split(k, '')], lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
    FROM named n, crc),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, rtrim(text, {SPACE}) AS bare, left(role, 1) AS p,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair FROM placed),
faults AS (SELECT *, bare <> '' AND NOT again AS alive, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
    CASE WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM met),
best AS ({start} UNION ALL {step}),
ends AS (SELECT conv_id, {least('e', 'a')} AS done FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (bare = '') AS blank,
    count(*) FILTER (bare <> '' AND again) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, done.c AS cost, done.t AS audit,
    sha256(substr(done.l, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
