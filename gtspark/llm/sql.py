"""DuckDB forms of the later operators' queries, built from their wording."""

from __future__ import annotations

# -- vector codes: plain Lloyd rounds, all entries compared ---------------------------------------


def _rounds(n: int) -> str:
    out = []
    for i in range(n + 1):
        out.append(f"""
a{i} AS MATERIALIZED (SELECT r, part, min(d * 256 + k) AS m FROM (
    SELECT p.r, p.part, b.k, (list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x)
           + list_dot_product(b.x, b.x))::BIGINT AS d FROM p JOIN b{i} b USING (part)) GROUP BY 1, 2)""")
        if i < n:
            out.append(f"""
b{i + 1} AS MATERIALIZED (SELECT b.part, b.k, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT part, k, list(f ORDER BY j) AS x FROM (
        SELECT part, k, j, floor(sum(v) / count(*)) AS f FROM (
            SELECT p.part, a.m % 256 AS k, unnest(p.x) AS v, generate_subscripts(p.x, 1) AS j
            FROM p JOIN a{i} a USING (r, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, k))""")
    return ",".join(out)


OP12 = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, label,
                  list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)]::DOUBLE[] AS x
                   FROM e, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x FROM p QUALIFY k < 256),
{_rounds(4)},
c AS (SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error
      FROM a4 GROUP BY 1),
books AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, k, j)) AS h
          FROM (SELECT part, k, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM b4))
SELECT e.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY e.label)::BIGINT AS label_error,
       books.h AS codebooks_sha256
FROM e JOIN c USING (r), books
"""

# -- conversation repair: cheapest (cost, edits, text) per last role, row by row -------------------

_FAR = 10 ** 9


def _add(state: int, cost: str, edits: str, text: str) -> str:
    return f"{{'c': v{state}.c + {cost}, 'a': v{state}.a || '{edits}', 't': v{state}.t || {text}}}"


def _state(target: int) -> str:
    """Least way to end a row with ``target`` (0 none, 1 system, 2 user, 3 assistant) as last role."""
    far = f"{{'c': {_FAR}::BIGINT, 'a': '', 't': ''}}"
    kept, made = "chr(10) || role || ':' || txt", {2: "chr(10) || 'user:' || txt", 3: "chr(10) || 'assistant:' || txt"}
    put = {2: "chr(10) || 'user:'", 3: "chr(10) || 'assistant:'"}
    before = {0: (), 1: (0,), 2: (0, 1, 3), 3: (2,)}[target]
    ways = [_add(target, "2", "D", "''")]

    def stays(when, way):
        return f"CASE WHEN code <> '-' AND {when} THEN {way} ELSE {far} END"

    letter = {1: "s", 2: "u", 3: "a"}.get(target)
    for s in before:
        ways.append(stays(f"lower(code) = '{letter}'", _add(s, "cut", "K", kept)))
        if target > 1:
            ways.append(stays("true", _add(s, "cut + 1", "R", made[target])))
    for s, inner in ((0, 2), (1, 2), (2, 3), (3, 2)):           # one message put before the row
        if target > 1 and target == {2: 3, 3: 2}[inner]:
            ways.append(stays(f"lower(code) = '{letter}'", _add(s, "cut + 5", "IK", f"{put[inner]} || {kept}")))
            ways.append(stays("true", _add(s, "cut + 6", "IR", f"{put[inner]} || {made[target]}")))
    return f"list_min([{', '.join(ways)}])"


OP13 = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(key, ''),
           lambda ch: [unicode(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, t: CASE WHEN t >= 0 THEN xor(c, t) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
           4294967295) % 20 AS rest FROM keyed),
hurt AS (SELECT conv_id, coalesce(conv_id::VARCHAR, 'none') AS conv, turn, CASE WHEN rest = 4 THEN 'user' ELSE role END AS role,
                CASE rest WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS txt,
                unnest(range(CASE WHEN rest = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE rest <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, txt, copy) AS i FROM hurt),
fault AS (SELECT *, NOT regexp_matches(txt, '[^\x20\x09-\x0D]') AS blank,
                 row_number() OVER (PARTITION BY conv, role, txt ORDER BY i) > 1 AS twice,
                 NOT regexp_matches(txt, '[.!?][\x20\x09-\x0D]*$') AS cut,
                 left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS ini_before FROM placed),
coded AS (SELECT *, CASE WHEN blank OR twice THEN '-' WHEN cut THEN upper(CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'x' END)
                    WHEN ini IN ('s', 'u', 'a') THEN ini ELSE 'x' END AS code FROM fault),
stats AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
                 count(*) FILTER (blank) AS blank, count(*) FILTER (twice AND NOT blank) AS duplicate,
                 count(*) FILTER (cut AND NOT twice AND NOT blank) AS truncated,
                 count(*) FILTER (i > 1 AND ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal
          FROM coded GROUP BY 1),
walk AS (
  SELECT conv, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS v0, {{'c': {_FAR}::BIGINT, 'a': '', 't': ''}} AS v1,
         {{'c': {_FAR}::BIGINT, 'a': '', 't': ''}} AS v2, {{'c': {_FAR}::BIGINT, 'a': '', 't': ''}} AS v3 FROM stats
  UNION ALL
  SELECT conv, i, {', '.join(f'{_state(t)} AS v{t}' for t in range(4))}
  FROM (SELECT w.conv, w.i + 1 AS i, v0, v1, v2, v3, code, role, txt,
               CASE WHEN code <> '-' AND code = upper(code) THEN 5 ELSE 0 END AS cut
        FROM walk w JOIN coded x ON x.conv = w.conv AND x.i = w.i + 1)),
best AS (SELECT conv, list_min([v0, v3, {_add(1, "10", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")},
                                {_add(2, "5", "I", "chr(10) || 'assistant:'")}]) AS b
         FROM walk JOIN stats USING (conv) WHERE walk.i = stats.n)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS conv FROM conversations) o
LEFT JOIN stats USING (conv) LEFT JOIN best USING (conv)
"""
