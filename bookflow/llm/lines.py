"""Line dedup by a deletion-neighbourhood join over words.

Two lines are the same if their words are, and near if one word is replaced,
inserted or deleted and the longer line has LEAST words or more (similarity 0.8
or more). A line that has an earlier equal or near line, by doc_id and line
number, is removed.

Lines with one word left out are hashed variants. A replaced word at place i
makes equal variants with the same i; an inserted word makes a variant that
equals the other line. Only lines that share their first or second half with
another line, which every near pair does, are cut into variants. Of the lines of a
batch that share a variant at the same place, only the earliest one travels; the
others are near it and are paired with it at once. So a variant of very many lines
adds one entry a batch to its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm import keyring
from bookflow.llm.common import doc_key, small_or_not, stored
from bookflow.llm.kernels import RangeHash, mix, passes, powers, text_bytes, word_ranges

#: Words of the longer line of a near pair, at least.
LEAST = 5
#: Keys of documents without an id begin here.
LAST = 1 << 62
SIDE = mix(np.arange(1, 4, dtype=np.uint64))


class WordHash:
    """Hashes of ranges of a list of word hashes, also with one word left out, each in constant time."""

    def __init__(self, words: np.ndarray):
        self.power, self.inverse = powers(len(words) + 2)
        self.words = words
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.power[: len(words)], dtype=np.uint64, out=self.prefix[1:])

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((self.prefix[z] - self.prefix[a]) * self.inverse[a] + (z - a).astype(np.uint64) * SIDE[0])

    def without(self, a: np.ndarray, z: np.ndarray, i: np.ndarray) -> np.ndarray:
        value = (self.prefix[i] - self.prefix[a]) * self.inverse[a] + (self.prefix[z] - self.prefix[i + 1]) * self.inverse[a + 1]
        return mix(value + (z - a - 1).astype(np.uint64) * SIDE[0])


def line_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all lines of a pass: text number, line number, first and last + 1 word, byte bounds; and the words' hashes."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(breaks + 1, bounds[:-1][np.diff(bounds) > 0])
    starts = starts[starts <= len(data)]
    # a line end at the end of a text opens an empty last line, which has no byte of its own and is left out
    row = np.searchsorted(bounds, starts, side="right") - 1
    ok = row < len(bounds) - 1
    starts, row = starts[ok], row[ok]
    opened = breaks + 1
    real = ~np.isin(starts, bounds[:-1]) | ~np.isin(starts, opened) | (starts == bounds[row])
    starts, row = starts[real], row[real]
    ends = np.r_[starts[1:], len(data)]
    first = np.searchsorted(row, np.arange(len(bounds)))
    number = np.arange(len(row)) - first[row]
    a, z, _ = word_ranges(data, bounds)
    words = RangeHash(data).of(a, z) if len(a) else np.zeros(0, np.uint64)
    return row, number, np.searchsorted(a, starts), np.searchsorted(a, ends), starts, ends, words


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(batch.column("doc"), dtype=np.int64)
        data, bounds = text_bytes(batch.column("text"))
        for first, last in passes(bounds):
            own = bounds[first : last + 1] - bounds[first]
            row, number, a, z, _, _, words = line_words(data[bounds[first] : bounds[last]], own)
            h = WordHash(words)
            n = z - a
            halves = [(n // 2, True), (np.maximum(n - 1, 0) // 2, True), ((n + 1) // 2, False), (n // 2, False)]
            keys = []
            for size, front in halves:
                side = h.of(a, a + size) if front else h.of(z - size, z)
                keys.append(mix(side + size.astype(np.uint64) * SIDE[1] + SIDE[1 if front else 2]).view(np.int64))
            none = np.setdiff1d(np.arange(last - first), row)
            pad = lambda x: pa.array(np.r_[x, np.zeros(len(none), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[ids[first + row], ids[first + none]]),
                    pa.array(np.r_[number, np.full(len(none), -1)].astype(np.int32)),
                    pa.array(np.r_[n, np.zeros(len(none), np.int64)].astype(np.int32)),
                    pad(h.of(a, z).view(np.int64)),
                    *[pad(k) for k in keys],
                ],
                names=["doc", "line", "n_words", "h", "k1", "k2", "k3", "k4"],
            )


def _half_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = np.stack([np.asarray(batch.column(f"k{i}"), dtype=np.int64) for i in range(1, 5)]).view(np.uint64)
    return keys.reshape(-1), np.tile(np.asarray(batch.column("h"), dtype=np.int64), 4)


def _taker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of the asked lines. Rows that share an id are told apart by the line's hash."""
    for batch in batches:
        out = {"h": [], "doc": [], "line": [], "words": []}
        for doc, text, asked in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            for x in asked:
                if x["line"] >= len(lines):
                    continue
                out["h"].append(x["h"])
                out["doc"].append(doc)
                out["line"].append(x["line"])
                out["words"].append(lines[x["line"]])
        taken = pa.RecordBatch.from_pydict(out, schema=pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("words", pa.string())]))
        if len(taken):
            yield taken.filter(pa.array(line_hashes(*text_bytes(taken.column("words"))) == np.asarray(taken.column("h"), dtype=np.int64)))


def line_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of the words of each line of a batch."""
    a, z, row = word_ranges(data, bounds)
    words = RangeHash(data).of(a, z) if len(a) else np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(len(bounds)))
    return WordHash(words).of(first[:-1], first[1:]).view(np.int64)


def variants(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each line (a row of a batch): line number, role and key.

    Role 0: one word left out, with its place (near by replacement if equal).
    Role 1: one word left out. Role 2: the line itself, which meets role 1.
    """
    a, z, row = word_ranges(data, bounds)
    words = RangeHash(data).of(a, z) if len(a) else np.zeros(0, np.uint64)
    h = WordHash(words)
    first = np.searchsorted(row, np.arange(len(bounds)))
    lo, hi = first[:-1], first[1:]
    i = np.arange(len(words))
    out = h.without(lo[row], hi[row], i) if len(words) else words
    long = (hi - lo)[row] >= LEAST  # the longer line of a pair
    replaced = mix(out + (i - lo[row]).astype(np.uint64) * SIDE[1])
    lines = np.arange(len(bounds) - 1)
    return (
        np.concatenate([row[long], row[long], lines]),
        np.concatenate([np.zeros(long.sum(), np.int8), np.ones(long.sum(), np.int8), np.full(len(lines), 2, np.int8)]),
        np.concatenate([replaced[long], out[long], h.of(lo, hi)]),
    )


PACKED = "bucket int, h binary, doc binary, line binary, keys binary, roles binary, places binary, later binary, earlier binary"


def heads_of(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each entry, the entry with the same key that comes first in `order`."""
    by = np.lexsort((order, keys))
    first = np.ones(len(keys), bool)
    first[1:] = keys[by][1:] != keys[by][:-1]
    out = np.empty(len(keys), np.int64)
    out[by] = by[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else by
    return out


def _variant_packer(buckets: int):
    kinds = [pa.int32(), *[pa.binary()] * 8]
    names = [c.split()[0] for c in PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("words"))
            h = np.asarray(batch.column("h"), dtype=np.int64)
            doc, line = np.asarray(batch.column("doc"), dtype=np.int64), np.asarray(batch.column("line"), dtype=np.int32)
            for first, last in passes(bounds):
                place, role, key = variants(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                ids = (h[first:last], doc[first:last], line[first:last])
                rank = np.empty(last - first, np.int64)
                rank[np.lexsort((ids[2], ids[1]))] = np.arange(last - first)
                cut = int((role == 0).sum())  # entries of roles 0 and 1 stand in the same order
                head = place[heads_of(key[:cut], rank[place[:cut]])]
                late = head != place[:cut]
                a, b = keyring.unique_links(ids[0][place[:cut][late]], ids[0][head[late]])
                keep = np.r_[~late, ~late, np.ones(len(place) - 2 * cut, bool)]
                place, role, key = place[keep], role[keep], key[keep]
                bucket = keyring.bucket_of(mix(key), buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, place, role, key = bucket[order], place[order].astype(np.uint32), role[order], key[order]
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
                rows = []
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    used, at = np.unique(place[x:y], return_inverse=True)
                    rows.append((int(bucket[x]), *(v[used].tobytes() for v in ids), key[x:y].tobytes(), role[x:y].tobytes(), at.astype(np.uint32).tobytes(), b"", b""))
                if len(a):
                    rows.append((int(mix(a[:1].view(np.uint64))[0] % np.uint64(buckets)), *[b""] * 6, a.tobytes(), b.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pack


def _pairs(table: pa.Table) -> pa.Table:
    """Near pairs (later line, earlier line) of a bucket: for each line and key the earliest line it meets, and the pairs of the batches."""
    cols = {c: table.column(c).to_pylist() for c in ("h", "doc", "line", "keys", "roles", "places", "later", "earlier")}
    base = np.cumsum([0] + [len(x) // 8 for x in cols["h"]])[:-1]
    join = lambda c, kind: np.frombuffer(b"".join(cols[c]), kind)
    h, doc, line = join("h", np.int64), join("doc", np.int64), join("line", np.int32)
    key, role = join("keys", np.uint64), join("roles", np.int8)
    place = np.concatenate([np.frombuffer(p, np.uint32).astype(np.int64) + b for p, b in zip(cols["places"], base, strict=True)])
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((line, doc))] = np.arange(len(h))
    later, earlier = [], []

    def heads(k: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank[p], k))
        k, p = k[order], p[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        return k[first], p[first]

    k, p = key[role == 0], place[role == 0]
    if len(k):
        hk, hp = heads(k, p)
        best = hp[np.searchsorted(hk, k)]
        later.append(p)
        earlier.append(best)
    cut, whole = (key[role == 1], place[role == 1]), (key[role == 2], place[role == 2])
    for (k, p), (ok, op) in ((cut, whole), (whole, cut)):
        if len(k) and len(ok):
            hk, hp = heads(ok, op)
            at = np.minimum(np.searchsorted(hk, k), len(hk) - 1)
            met = hk[at] == k
            later.append(p[met])
            earlier.append(hp[at][met])
    x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (later, earlier))
    keep = (doc[y] < doc[x]) | ((doc[y] == doc[x]) & (line[y] < line[x]))
    a, b = keyring.unique_links(np.r_[h[x[keep]], join("later", np.int64)], np.r_[h[y[keep]], join("earlier", np.int64)])
    return pa.table({"h": pa.array(a, pa.int64()), "earlier": pa.array(b, pa.int64())})


def word_distance_is_one(a: list[str], b: list[str]) -> bool:
    """One word replaced, inserted or deleted."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [
            h
            for h, x, y in zip(batch.column("h").to_pylist(), batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)
            if word_distance_is_one(split_line(x), split_line(y)) and max(len(split_line(x)), len(split_line(y))) >= LEAST
        ]
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64())], names=["near_h"])


def split_line(line: str) -> list[str]:
    return [w for w in line.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Which lines of each document have an earlier equal or near line.

    Returns doc_id, n_lines, n_removed, n_near (removed although the same words
    don't stand earlier) and removed (line numbers from 0, ascending) for every
    doc_id.

    * lines end at \\n; words at white space; a line end that closes the text opens no further line
    * null and empty texts have no lines; blank lines are never removed
    * equal lines count as the earliest of them: if that one is near an earlier line, all go
    * rows that share an id are read as one document whose lines at the same place are equally early
    * rows with a null id come last, in the order of a hash of their texts; those with equal texts are reported together
    * ties: lines of one document are ordered by their number, so no two lines are equally early but those of rows that share an id
    * a very long text is cut into lines in the task that reads it; lines of any length are compared by hashed variants and confirmed word by word
    * an empty table gives no rows; other columns are ignored
    """
    source = docs.select(doc_key(F.col("doc_id"), F.col("text").cast("string")).alias("doc"), F.col("text").cast("string").alias("text"))
    kind = "doc long, line int, n_words int, h long, k1 long, k2 long, k3 long, k4 long"
    lines = stored(source.mapInArrow(_reader, kind), "lines")
    halves = [f"k{i}" for i in range(1, 5)]
    distinct = stored(
        lines.filter("n_words > 0").groupBy("h").agg(F.min(F.struct("doc", "line")).alias("first"), F.first("n_words").alias("n_words"), *[F.first(k).alias(k) for k in halves]), "lines-distinct"
    )
    able = distinct.filter(F.col("n_words") >= LEAST - 1)
    n = able.count()
    packed = able.select("h", *halves).mapInArrow(keyring.packer(_half_keys, keyring.n_buckets(4 * n)), keyring.PACKED)
    links = keyring.shared_key_links(packed)
    alive = stored(links.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines-alive")
    n_alive = alive.count()
    asked = able.join(small_or_not(alive), "h").groupBy(F.col("first.doc").alias("doc")).agg(F.collect_list(F.struct(F.col("h"), F.col("first.line").alias("line"))).alias("asked"))
    asked = stored(asked, "lines-asked")
    taken = stored(source.join(small_or_not(asked), "doc").mapInArrow(_taker, "h long, doc long, line int, words string").dropDuplicates(["h"]), "lines-taken")
    buckets = max(24, n_alive * 100 // keyring.BUCKET_KEYS)
    pairs = taken.mapInArrow(_variant_packer(buckets), PACKED).groupBy("bucket").applyInArrow(_pairs, "h long, earlier long").distinct()
    words = taken.select("h", "words")
    other = taken.select(F.col("h").alias("earlier"), F.col("words").alias("other"))
    near = stored(pairs.join(words, "h").join(other, "earlier").select("h", "words", "other").mapInArrow(_verify, "near_h long").distinct(), "lines-near")
    known = distinct.select("h", "first").join(small_or_not(near), F.col("h") == F.col("near_h"), "left").select("h", "first", F.col("near_h").isNotNull().alias("is_near"))
    every = lines.select("doc", "line", F.when(F.col("n_words") > 0, F.col("h")).alias("h")).join(known, "h", "left")
    is_first = (F.col("first.doc") == F.col("doc")) & (F.col("first.line") == F.col("line"))
    gone = F.coalesce(F.col("is_near") | ~is_first, F.lit(False))
    near_gone = F.coalesce(F.col("is_near") & is_first, F.lit(False))
    return every.groupBy("doc").agg(
        F.count(F.when(F.col("line") >= 0, 1)).alias("n_lines"), F.count(F.when(gone, 1)).alias("n_removed"), F.count(F.when(near_gone, 1)).alias("n_near"),
        F.sort_array(F.collect_list(F.when(gone, F.col("line")))).alias("removed"),
    ).select(F.when(F.col("doc") < LAST, F.col("doc")).alias("doc_id"), "n_lines", "n_removed", "n_near", "removed")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS raw FROM (
    SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS parts FROM documents WHERE text <> '')
), w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(raw, '[\x09-\x0D ]+'), lambda x: x <> '') AS words FROM l),
s AS (SELECT doc_id, line, words, len(words) AS n, array_to_string(words, ' ') AS key FROM w),
d AS MATERIALIZED (SELECT key, any_value(words) AS words, any_value(n) AS n, min((doc_id, line)) AS first FROM s WHERE n > 0 GROUP BY key),
v AS MATERIALIZED (SELECT key, first, i, array_to_string(list_concat(words[:i - 1], words[i + 1:]), ' ') AS variant FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)),
near AS (
  SELECT v.key FROM v JOIN (SELECT variant, i, min(first) AS low FROM v GROUP BY ALL) g USING (variant, i) WHERE g.low < v.first
  UNION SELECT v.key FROM v JOIN d ON d.key = v.variant WHERE d.first < v.first
  UNION SELECT d.key FROM v JOIN d ON d.key = v.variant WHERE v.first < d.first),
r AS (SELECT s.doc_id, s.line, coalesce(d.first <> (s.doc_id, s.line), FALSE) AS repeated, near.key IS NOT NULL AS is_near
  FROM s LEFT JOIN d ON s.key = d.key AND s.n > 0 LEFT JOIN near ON near.key = d.key)
SELECT documents.doc_id, count(r.line) AS n_lines, count(*) FILTER (repeated OR is_near) AS n_removed, count(*) FILTER (is_near AND NOT repeated) AS n_near,
  coalesce(list_sort(list(r.line::INT) FILTER (repeated OR is_near)), []) AS removed
FROM documents LEFT JOIN r USING (doc_id) GROUP BY documents.doc_id
"""
