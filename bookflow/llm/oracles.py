"""DuckDB SQL of operators that SQL can express on small tables by brute force."""

from __future__ import annotations

from bookflow.llm.decontamination import FUNCTION_WORDS, NAME, NEEDED, NUMBER, NUMBER_WORDS, PLAIN, UNIT, UNITS, WINDOW

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit."""
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    bits = "list_reduce(list_concat([xor(c, b)]::BIGINT[], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {codes}), lambda c, b: {bits}), 4294967295)::BIGINT"


NEAR_DUPS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s),
c AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (k) WHERE a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT x, y FROM c UNION ALL SELECT y, x FROM c),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM s LEFT JOIN m ON m.x = s.doc_id
"""

#: Bytes as pairs of hex digits: a window of 50 bytes is 100 digits at an odd place.
SUFFIXES = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, 100)) AS g FROM (SELECT *, unnest(range(n - 49)) AS k FROM h WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
hit AS (SELECT w.doc_id, w.k FROM w JOIN f USING (g) WHERE f.low < w.doc_id),
o AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM hit),
i AS (SELECT doc_id, k, sum((before IS NULL OR k > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM o),
spans AS (SELECT doc_id, island, min(k) AS a, max(k) + 50 AS z FROM i GROUP BY ALL),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS kept_from FROM spans),
kept AS (SELECT h.doc_id, string_agg(substr(h.h, 2 * kept_from + 1, 2 * (a - kept_from)), '' ORDER BY a) || substr(any_value(h.h), 2 * max(z) + 1) AS rest, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed
  FROM gaps JOIN h USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h.h))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)
"""


def leaks() -> str:
    """Windows as strings: verbatim ones by their words, template ones with slots agreeing along diagonals."""
    listed = lambda words: ", ".join(f"'{w}'" for w in words)

    def words(source: str, key: str, name: str) -> str:
        mark = f"""CASE WHEN lower(x) IN ({listed(NUMBER_WORDS)}) OR regexp_full_match(x, '[0-9]+') THEN '{NUMBER}' WHEN lower(x) IN ({listed(UNITS)}) THEN '{UNIT}'
          WHEN lower(x) <> x AND lower(x) NOT IN ({listed(FUNCTION_WORDS)}) AND regexp_full_match(x, '\\p{{Lu}}\\p{{Ll}}\\p{{L}}*') THEN '{NAME}' ELSE lower(x) END"""
        return rf"""{name}0 AS (SELECT {key} AS id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), '(\d)[.,](\d)', '\1\2', 'g'), '(\d)({"|".join(UNITS)})\b', '\1 \2', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {source}),
{name}1 AS (SELECT id, list_transform(w, lambda x: lower(x)) AS v, list_transform(w, lambda x: {mark}) AS t FROM {name}0 WHERE len(w) > 0)"""

    return f"""WITH {words("benchmark", "item_id", "b")}, {words("documents", "doc_id", "d")},
b2 AS (SELECT *, least(len(v), {WINDOW}) AS l FROM b1), b3 AS (SELECT *, len(v) - l + 1 AS n, unnest(range(1, len(v) - l + 2)) AS pos FROM b2),
bw AS MATERIALIZED (SELECT id AS item_id, n, pos, l, v[pos:pos + l - 1] AS vs, t[pos:pos + l - 1] AS ts FROM b3),
lens AS (SELECT DISTINCT l FROM b2), d2 AS (SELECT id AS doc_id, v, t, l, unnest(range(1, len(v) - l + 2)) AS pos FROM d1, lens WHERE len(v) >= l),
dw AS MATERIALIZED (SELECT doc_id, pos, l, hash(v[pos:pos + l - 1]) AS vk, hash(t[pos:pos + l - 1]) AS tk FROM d2),
same AS (SELECT DISTINCT doc_id, item_id, bw.pos, n FROM (SELECT DISTINCT doc_id, vk FROM dw) dk JOIN bw ON dk.vk = hash(bw.vs)),
bt AS (SELECT *, list_filter(range(1, {WINDOW + 1}), lambda i: vs[i] <> ts[i]) AS places FROM bw WHERE l = {WINDOW}),
hit AS MATERIALIZED (SELECT doc_id, item_id, bt.pos AS pos, n, dw.pos - bt.pos AS diagonal, list_transform(places, lambda i: {{'i': bt.vs[i], 'd': d1.v[dw.pos + i - 1]}}) AS pairs
  FROM dw JOIN bt ON dw.l = bt.l AND dw.tk = hash(bt.ts) JOIN d1 ON d1.id = dw.doc_id WHERE len(places) BETWEEN 1 AND {WINDOW - PLAIN}),
seen AS (SELECT doc_id, item_id, diagonal, p, count(*) AS c FROM (SELECT doc_id, item_id, diagonal, unnest(pairs) AS p FROM hit) GROUP BY ALL),
chosen AS (SELECT doc_id, item_id, diagonal, p FROM seen QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, diagonal, p.i ORDER BY c DESC, p.d) = 1),
allowed AS (SELECT doc_id, item_id, diagonal, list(p) AS allowed FROM chosen GROUP BY ALL),
good AS (SELECT doc_id, item_id, pos, n, pairs FROM hit JOIN allowed USING (doc_id, item_id, diagonal) WHERE list_has_all(allowed, pairs)),
every AS (SELECT doc_id, item_id, pos, n FROM same UNION SELECT doc_id, item_id, pos, n FROM good),
slots AS (SELECT doc_id, item_id, count(DISTINCT p) AS n_slots FROM (SELECT doc_id, item_id, unnest(pairs) AS p FROM good) GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS matched_windows, any_value(n)::BIGINT AS item_windows, coalesce(any_value(n_slots), 0)::BIGINT AS n_slots
FROM every LEFT JOIN slots USING (doc_id, item_id) GROUP BY doc_id, item_id HAVING count(*) >= least({NEEDED}, any_value(n))"""


LEAKS = leaks()
