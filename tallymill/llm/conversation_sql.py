"""DuckDB text of the conversation repair: damage, faults, and costs by a recursion from the last row to the first."""

from __future__ import annotations

_CRC = "CAST(c AS UBIGINT)"
for _ in range(8):
    _CRC = f"list_transform([{_CRC}], lambda z: xor(z >> 1, 3988292384 * (z & 1)))[1]"
_CRC = _CRC.replace("CAST(c AS UBIGINT)", "xor(c, b)")
_BYTES = "list_transform(string_split(k, ''), lambda h: CAST(unicode(h) AS UBIGINT))"
_INF = 1 << 40
_END = f"[{{'c': 0, 'a': '', 't': ['']}}, {{'c': {_INF}, 'a': '', 't': ['']}}, {{'c': {_INF}, 'a': '', 't': ['']}}, {{'c': 0, 'a': '', 't': ['']}}]"
_AFTER, _ROLE = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def _option(cost: str, edit: str, target: str, line: str | None) -> str:
    """An edit before a best suffix; the lines end with an empty one that only marks the list's type."""
    lines = f"{target}.t" if line is None else f"list_prepend({line}, {target}.t)"
    return f"{{'c': {cost} + {target}.c, 'a': '{edit}' || {target}.a, 't': {lines}}}"


def _row(state: int) -> str:
    """The best suffix from a state before the row ``r``, without insertions before it."""
    found = [_option("2", "D", f"v[{state + 1}]", None)]
    stays = "CASE WHEN fault IN ('blank', 'duplicate') THEN {inf} WHEN fault = 'truncated' THEN 5 ELSE 0 END".format(inf=_INF)
    for initial, moves in _NEXT.items():
        if state in moves:
            cost = f"CASE WHEN left(role, 1) = '{initial}' THEN {stays} ELSE {_INF} END"
            found.append(_option(cost, "K", f"v[{moves[state] + 1}]", "role || ':' || text"))
    found.append(_option(f"1 + {stays}", "R", f"v[{_AFTER[state] + 1}]", f"'{_ROLE[state]}:' || text"))
    return f"list_min([{', '.join(found)}])"


def _inserted(vector: str) -> str:
    cells = [f"list_min([w[{s + 1}], {_option('5', 'I', f'w[{_AFTER[s] + 1}]', chr(39) + _ROLE[s] + ':' + chr(39))}])" for s in range(4)]
    for _ in range(3):
        vector = f"list_transform([{vector}], lambda w: [{', '.join(cells)}])[1]"
    return vector


_WHITE = r"[\x20\x09-\x0D]"
REPAIR = rf"""
    WITH RECURSIVE keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ), fated AS (
      SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {_BYTES}), lambda c, b: {_CRC}), 4294967295) % 20 AS fate FROM keyed
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM fated, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0
    ), ordered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
             count(*) OVER (PARTITION BY conv_id) AS total FROM damaged
    ), told AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
          WHEN NOT regexp_matches(text, '[.!?]{_WHITE}*$') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
      FROM ordered
    ), costs AS (
      SELECT conv_id, total AS n, {_inserted(_END)} AS v FROM (SELECT DISTINCT conv_id, total FROM ordered)
      UNION ALL
      SELECT conv_id, n, {_inserted("u")} FROM (
        SELECT k.conv_id, k.n - 1 AS n, [{', '.join(_row(s) for s in range(4))}] AS u
        FROM costs k JOIN told r ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = k.n)
    ), best AS (SELECT conv_id, v[1] AS b FROM costs WHERE n = 0
    ), counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
             count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM told GROUP BY conv_id
    )
    SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost,
           coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t[:-2], chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id
"""
