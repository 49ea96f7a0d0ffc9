"""Exact substring dedup by longest-previous-factor arrays over suffixes.

Every byte covered by a LENGTH-byte string that also starts in a document with a
smaller id is removed. Suffixes are brought together by anchors: the smallest
hash of a KMER-byte string in each LENGTH-byte window (the leftmost on ties). It
depends on the window's bytes alone, so equal windows have equal anchors. The
windows of one anchor make a strip of text.

1. Each strip sends a packed key: 28 bits of its anchor's hash, 36 of its own and
   64 of a second, independent hash. Strips with equal keys are equal strings (100
   bits of the strip tell those of one anchor apart): all but those in the smallest
   document repeat an earlier suffix over their full length. Each pack of
   documents sends a key once, with 4 bytes for its owner; repeats inside a pack
   need no meeting and travel evenly dealt.
2. Anchors that stand in different strips of different documents need the bytes.
   Only these strips are sent, one for each different string. Per anchor, their
   suffixes are sorted; previous and next smaller documents in suffix order give
   the longest previous factor of each suffix.
   An anchor with very many different strips (the edge of a passage that a great
   part of all documents share) is dealt by its suffixes' LENGTH-byte hashes of
   128 bits instead: equal hashes have the smallest document as previous factor.
   Each pack sends a hash once.
3. Covered ranges of all kinds meet at their document, whose bytes are cut.

A key takes 20 bytes and the text's bytes travel twice at most, so the disk needed
stays in proportion to the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import bounded_batches, doc_key, parts_of, release_memory, stored
from bookflow.llm.kernels import BASE, RangeHash, mix, passes, text_bytes

LENGTH = 50
KMER = 20
WINDOW = LENGTH - KMER + 1
#: Bits of a key that come from the strip; the others come from the anchor.
STRIP_BITS = 36
#: Keys that one bucket's task sorts, about, and bytes of text for each key.
BUCKET_KEYS = 700_000
BYTES_PER_KEY = 16
PASS = 1 << 18
#: Bytes of text whose keys one task packs at a time.
PACK_BYTES = 1 << 23
#: Repeats inside a pack that travel as one row, so that no task gets very many of them.
REPEATS = 1 << 15
#: Bytes of text, about, whose anchors are counted to find hot ones.
COUNTED_BYTES = 1 << 26
#: Different strips that make an anchor hot, and the least share of all strips, which bounds the list of hot anchors by its inverse.
HOT_STRIPS, HOT_SHARE = 2000, 1e-5
#: Suffixes of hot anchors that a task gathers before it sends them.
GATHERED = 1 << 19


@dataclass
class Strips:
    """Strips of a run of texts: text number, bounds of the strip in its text, both halves of the key, and bucket hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    check: np.ndarray
    spread: np.ndarray

    @property
    def ident(self) -> np.ndarray:
        return ident(self.key, self.check)


def ident(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """64 bits of both halves of a key, by which a document finds its own strips in a reply."""
    return mix(key ^ mix(check + BASE))


def strip_key(mark: np.ndarray, strip: np.ndarray) -> np.ndarray:
    """The first half of a key: bits of the anchor's hash above bits of the strip's."""
    return (mark << np.uint64(STRIP_BITS)) | (strip >> np.uint64(64 - STRIP_BITS))


def strips(data: np.ndarray, bounds: np.ndarray) -> Strips:
    """All strips of the texts of one pass."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return Strips(*[empty] * 3, *[empty.astype(np.uint64)] * 3)
    ranges = RangeHash(data)
    at = np.arange(n - KMER + 1)
    kmers = ranges.of(at, at + KMER)
    low = (kmers & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts at each byte
    valid = np.ones(len(anchor), bool)
    for edge in bounds[1:-1]:
        valid[max(edge - LENGTH + 1, 0) : edge] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return Strips(*[empty] * 3, *[empty.astype(np.uint64)] * 3)
    own = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(starts)] - 1
    a, z = starts[head], starts[tail] + LENGTH
    mark, strip = kmers[own[head]], ranges.of(a, z)
    del kmers, low, ranges
    row = np.searchsorted(bounds, a, side="right") - 1
    return Strips(row, a - bounds[row], z - bounds[row], strip_key(mark, strip), RangeHash(data, second=True).of(a, z), mark >> np.uint64(32))


def batch_strips(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Strips]]:
    """Strips of each pass over a batch, with the number of the pass's first text."""
    for first, last in passes(bounds, PASS):
        yield first, strips(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])


def anchor_of(key: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """60 bits of the anchor's hash."""
    return (key >> np.uint64(STRIP_BITS)) << np.uint64(32) | spread.astype(np.uint64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with more than one strip in a batch, with the number of others, and the number of all strips under anchor -1."""
    for batch in batches:
        found = [s for _, s in batch_strips(*text_bytes(batch.column("text")))]
        key, spread = (np.concatenate([getattr(s, c) for s in found]) if found else np.zeros(0, np.uint64) for c in ("key", "spread"))
        key, at = np.unique(key, return_index=True)
        anchor, n = np.unique(anchor_of(key, spread[at]), return_counts=True)
        some = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[anchor[some].view(np.int64), -1]), pa.array(np.r_[n[some] - 1, len(key)])], names=["anchor", "n"])


def hot_anchors(source: DataFrame, size: int) -> np.ndarray:
    """Anchors that have very many different strips, by a count over a bounded part of the texts; at most 1 / HOT_SHARE of them.

    The list decides how strips are dealt to tasks, not which are compared.
    """
    share = min(1.0, COUNTED_BYTES / max(size, 1))
    part = source.select("text").sample(fraction=share, seed=11) if share < 1 else source.select("text")
    counted = stored(part.mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchor-counts")
    total = (counted.filter("anchor = -1").first() or {"n": 0})["n"]
    least = max(HOT_STRIPS * share, HOT_SHARE * total, 8)
    found = counted.filter((F.col("anchor") != -1) & (F.col("n") >= least)).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


def owners(ids: np.ndarray, base: int) -> bytes:
    """Ids as 4 bytes above a base where they fit, else 8."""
    above = (ids - base).view(np.uint64)
    return (above.astype(np.uint32) if not len(above) or above.max() < 1 << 32 else above).tobytes()


def owned(packed: bytes, n: int, base: int) -> np.ndarray:
    return np.frombuffer(packed, np.uint32 if len(packed) == 4 * n else np.int64).astype(np.int64) + base


#: `keys` holds the first halves of all keys of a row, then the second halves; `later` the idents of repeats.
PACKED = "bucket int, base long, keys binary, owners binary, later binary, later_owners binary"


def packed_rows(key: np.ndarray, check: np.ndarray, spread: np.ndarray, doc: np.ndarray, buckets: int, hot: np.ndarray) -> list[tuple]:
    """PACKED rows of the strips of a pack: each key once, in the bucket of its anchor (a hot anchor's: of the key); repeats in rows of their own, of REPEATS at most."""
    # an anchor is the smallest hash of a window, so its own bits are not evenly spread
    dealt = mix(spread.astype(np.uint64)) >> np.uint64(32)
    if len(hot):
        many = member(anchor_of(key, spread), hot)
        dealt[many] = mix(key[many]) >> np.uint64(32)
    bucket = (dealt * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.lexsort((doc, check, key, bucket))
    bucket, key, check, doc = bucket[order], key[order], check[order], doc[order]
    del dealt, order
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (check[1:] == check[:-1]) & (bucket[1:] == bucket[:-1])
    later = doc != doc[np.flatnonzero(~same)[np.cumsum(~same) - 1]]
    rows = []
    late_key, late_doc = ident(key[later], check[later]), doc[later]
    by = np.argsort(late_doc, kind="stable")
    for x in range(0, len(by), REPEATS):
        piece = by[x : x + REPEATS]
        base = int(late_doc[piece[0]])
        dealt_to = mix(np.array([base ^ x << 40], np.int64).view(np.uint64))[0] % np.uint64(buckets)
        rows.append((int(dealt_to), base, b"", b"", late_key[piece].tobytes(), owners(late_doc[piece], base)))
    bucket, key, check, doc = bucket[~same], key[~same], check[~same], doc[~same]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        base = int(doc[x:y].min())
        rows.append((int(bucket[x]), base, key[x:y].tobytes() + check[x:y].tobytes(), owners(doc[x:y], base), b"", b""))
    return rows


def _packer(buckets: int, hot: np.ndarray):
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in PACKED.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            ids = np.array(batch.column("doc"), dtype=np.int64)
            held += [(s.key, s.check, s.spread.astype(np.uint32), ids[first + s.row]) for first, s in batch_strips(data, bounds)]
            size += len(data)
            if size >= PACK_BYTES:
                yield from packed(held)
                held, size = [], 0
                release_memory()
        yield from packed(held)

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        if sum(len(x[0]) for x in held):
            columns = [np.concatenate([x[k] for x in held]) for k in range(4)]
            held.clear()
            rows = packed_rows(*columns, buckets, hot)
            del columns
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pack


def _meeting(hot: np.ndarray):
    hot_bits = np.unique(hot >> np.uint64(32))
    return lambda table: _meet(table, hot_bits)


def _meet(table: pa.Table, hot_bits: np.ndarray) -> pa.Table:
    """What each document of a bucket has to know: idents of strips that an earlier document has, idents of strips to send."""
    keys, checks, held, later, later_held = [], [], [], [], []
    for base, k, o, lk, lo in zip(*(table.column(c).to_pylist() for c in ("base", "keys", "owners", "later", "later_owners")), strict=True):
        both = np.frombuffer(k, np.uint64)
        keys.append(both[: len(both) // 2])
        checks.append(both[len(both) // 2 :])
        held.append(owned(o, len(keys[-1]), base))
        later.append(np.frombuffer(lk, np.uint64))
        later_held.append(owned(lo, len(later[-1]), base))
    key, check, owner = np.concatenate(keys), np.concatenate(checks), np.concatenate(held)
    order = np.lexsort((owner, check, key))
    key, check, owner = key[order], check[order], owner[order]
    del keys, checks, held, order
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    at = np.flatnonzero(first)
    repeated = owner != owner[at[np.cumsum(first) - 1]] if len(key) else np.zeros(0, bool)
    full_key = np.concatenate([ident(key[repeated], check[repeated]), *later])
    full_doc = np.concatenate([owner[repeated], *later_held])
    # of the strips of one anchor: are there different ones, in different documents?
    anchor, own = key[at] >> np.uint64(STRIP_BITS), owner[at]
    many = member(anchor, hot_bits)
    group = np.ones(len(at), bool)
    group[1:] = anchor[1:] != anchor[:-1]
    cut = np.flatnonzero(group)
    mixed = (np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut)) if len(cut) else np.zeros(0, bool)
    send = mixed[np.cumsum(group) - 1] | many if len(cut) else np.zeros(0, bool)
    full, part = _by_doc(full_doc, full_key), _by_doc(own[send], ident(key[at][send], check[at][send]))
    docs = sorted(full.keys() | part.keys())
    release_memory()
    return pa.table({"doc": pa.array(docs, pa.int64()), "full": pa.array([full.get(d) for d in docs], pa.binary()), "part": pa.array([part.get(d) for d in docs], pa.binary())})


def _by_doc(doc: np.ndarray, key: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(doc, kind="stable")
    doc, key = doc[order], key[order]
    cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else []
    return {int(doc[x]): key[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)}


def known(lists) -> np.ndarray:
    """Sorted keys from a list of packed pieces."""
    return np.unique(np.frombuffer(b"".join(x for x in (lists or ()) if x), np.uint64))


def member(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


#: Kinds of rows: 0 a strip of an anchor; 1 both hashes, documents and places of suffixes; 2 documents and ends of covered ranges.
SENT = "bucket int, kind int, anchor long, doc long, start long, content binary"


def smaller_elsewhere(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have both hashes of an entry of a smaller document."""
    order = np.lexsort((doc, check, key))
    k, c, d = key[order], check[order], doc[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    out = np.zeros(len(k), bool)
    if len(k):
        out[order] = d != d[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return out


def suffix_runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (doc, from, to) that suffixes at `at` cover over LENGTH bytes, neighbouring ones as one."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1), True]) if len(doc) else np.zeros(1, np.int64)
    return doc[cut[:-1]], at[cut[:-1]], at[cut[1:] - 1] + LENGTH


def _sender(buckets: int, hot: np.ndarray):
    """Bytes of the strips that their documents were asked for; of hot anchors, the hashes of their suffixes."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in SENT.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def gathered(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, check, doc, at = (np.concatenate([x[k] for x in parts]) for k in range(4))
        late = smaller_elsewhere(key, check, doc)
        covered = suffix_runs(doc[late], at[late])
        rows = [(int(mix(doc[:1].view(np.uint64))[0] % np.uint64(buckets)), 2, None, None, None, np.concatenate(covered).tobytes())]
        key, check, doc, at = key[~late], check[~late], doc[~late], at[~late]
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, key, check, doc, at = bucket[order], key[order], check[order], doc[order], at[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            rows.append((int(bucket[x]), 1, None, None, None, np.concatenate([key[x:y].view(np.int64), check[x:y].view(np.int64), doc[x:y], at[x:y]]).tobytes()))
        return table(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_parts = [], 0
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            ids = np.asarray(batch.column("doc"), dtype=np.int64)
            wanted = [known(x) for x in batch.column("part").to_pylist()]
            rows = []
            for first, s in batch_strips(data, bounds):
                anchor = anchor_of(s.key, s.spread)
                dealt = (mix(anchor) % np.uint64(buckets)).astype(np.int64)
                many = member(anchor, hot)
                cut = np.searchsorted(s.row, np.arange(s.row[-1] + 2)) if len(s.row) else [0]
                own = s.ident
                asked = [x + np.flatnonzero(member(own[x:y], wanted[first + i])) for i, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
                asked = np.concatenate(asked) if asked else np.zeros(0, np.int64)
                for j in asked[~many[asked]]:
                    base = bounds[first + s.row[j]]
                    rows.append((int(dealt[j]), 0, int(anchor[j]), int(ids[first + s.row[j]]), int(s.start[j]), data[base + s.start[j] : base + s.end[j]].tobytes()))
                hot_ones = asked[many[asked]]
                if len(hot_ones):
                    n = s.end[hot_ones] - s.start[hot_ones] - LENGTH + 1
                    of = np.repeat(hot_ones, n)
                    at = s.start[of] + np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
                    begin = bounds[first]
                    place = bounds[first + s.row[of]] - begin + at
                    near = data[begin : bounds[min(first + s.row[-1] + 1, len(bounds) - 1)]]
                    key, check = (RangeHash(near, second).of(place, place + LENGTH) for second in (False, True))
                    parts.append((key, check, ids[first + s.row[of]], at))
                    n_parts += len(of)
            yield table(rows)
            if n_parts >= GATHERED:
                yield gathered(parts)
                parts, n_parts = [], 0
            release_memory()
        if parts:
            yield gathered(parts)

    return send


def longest_previous(equal: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For suffixes in suffix order: is the longest previous factor LENGTH bytes or more?

    `equal` tells where a suffix agrees with the one before it in LENGTH bytes,
    `docs` are the suffixes' documents. Previous and next smaller documents are
    found by jumping over larger ones, all suffixes at a time; a jump ends where
    the common prefix gets shorter than LENGTH.
    """
    out = np.zeros(len(docs), bool)
    for back in (True, False):
        joined = equal.copy() if back else np.r_[equal[1:], False]
        jump = np.arange(len(docs)) + (-1 if back else 1)
        jump[~joined] = -1
        active = np.flatnonzero(jump >= 0)
        while len(active):
            low = docs[jump[active]] < docs[active]
            out[active[low]] = True
            active = active[~low]
            jump[active] = jump[jump[active]]
            active = active[jump[active] >= 0]
    return out


def _factors(table: pa.Table) -> pa.Table:
    """Covered ranges of a bucket: of strips by their suffixes' longest previous factors, of hot suffixes by their hashes."""
    kind = np.asarray(table.column("kind"))
    data, bounds = text_bytes(table.column("content"))
    strips_at = np.flatnonzero(kind == 0)
    anchor, doc, start = (np.asarray(pc.fill_null(table.column(c), 0), dtype=np.int64)[strips_at] for c in ("anchor", "doc", "start"))
    out = strip_factors(anchor, doc, start, data, bounds[:-1][strips_at], np.diff(bounds)[strips_at])
    packed = [[data[bounds[i] : bounds[i + 1]].view(np.int64).reshape(n, -1) for i in np.flatnonzero(kind == k)] for k, n in ((1, 4), (2, 3))]
    if packed[0]:
        key, check, doc, at = np.concatenate(packed[0], axis=1)
        late = smaller_elsewhere(key, check, doc)
        out.append(np.stack(suffix_runs(doc[late], at[late])))
    doc, a, z = np.concatenate([*out, *packed[1]], axis=1) if out or packed[1] else np.zeros((3, 0), np.int64)
    release_memory()
    return pa.table({"doc": pa.array(doc), "a": pa.array(a), "z": pa.array(z)})


def strip_factors(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Covered ranges (doc, from, to) of strips, by the longest previous factors of the suffixes of each anchor.

    A strip's bytes stand in `data` from `first` on and are read where they stand.
    """
    order = np.argsort(anchor, kind="stable")
    out: list[np.ndarray] = []
    # anchors in runs of a bounded number of bytes; an anchor with more strips makes a run of its own
    group = np.flatnonzero(np.r_[True, anchor[order][1:] != anchor[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    total = np.r_[0, np.cumsum(size[order])][group]
    i = 0
    while i < len(group) - 1:
        j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 21), side="right")) - 1)
        rows = order[group[i] : group[j]]
        n = size[rows] - LENGTH + 1
        of = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
        pos = first[rows][of] + at
        columns = []
        for k in range(0, LENGTH, 8):
            word = np.zeros(len(pos), np.uint64)
            for b in range(min(8, LENGTH - k)):
                word = word << np.uint64(8) | data[pos + k + b].astype(np.uint64)
            columns.append(word)
        ranked = np.lexsort(columns[::-1])
        equal = np.zeros(len(pos), bool)
        equal[1:] = np.logical_and.reduce([c[ranked][1:] == c[ranked][:-1] for c in columns])
        covered = np.zeros(len(pos), bool)
        covered[ranked] = longest_previous(equal, doc[rows][of[ranked]])
        hit = np.flatnonzero(covered)
        if len(hit):
            cut = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]]), True])
            x, y = hit[cut[:-1]], hit[cut[1:] - 1]
            r = rows[of[x]]
            out.append(np.stack([doc[r], start[r] + at[x], start[r] + at[y] + LENGTH]))
        i = j
        release_memory()
    return out


def covered_ranges(length: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, min(z, length)) for a, z in out]


def _cutter(keep_text: bool):
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "text"):
            data, bounds = text_bytes(batch.column("text"))
            full, spans = batch.column("full").to_pylist(), batch.column("spans").to_pylist()
            removed: list[list[tuple[int, int]]] = [[(s["a"], s["z"]) for s in x or ()] for x in spans]
            some = [i for i, x in enumerate(full) if x]
            for i in some:  # only texts that share strips are cut into strips again
                keys = known(full[i])
                one = data[bounds[i] : bounds[i + 1]]
                s = strips(one, np.array([0, len(one)]))
                hit = member(s.ident, keys)
                removed[i] += list(zip(s.start[hit].tolist(), s.end[hit].tolist(), strict=True))
            rows = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept", "removed")}
            for i, ranges in enumerate(removed):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                runs = covered_ranges(len(text), ranges)
                at, parts = 0, []
                for a, z in runs:
                    parts.append(text[at:a])
                    at = z
                kept = b"".join([*parts, text[at:]])
                rows["n_removed"].append(len(text) - len(kept))
                rows["n_spans"].append(len(runs))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    rows["kept"].append(kept)
                    rows["removed"].append([{"a": a, "z": z} for a, z in runs])
            arrays = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["n_spans"], pa.int64()), pa.array(rows["kept_sha256"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays += [pa.array(rows["kept"], pa.binary()), pa.array(rows["removed"], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))]
                names += ["kept", "removed"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            release_memory()

    return cut_out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a LENGTH-byte string that also starts in a document with a smaller id.

    Returns RESULT for every row and, with keep_text, `kept` (the remaining
    bytes) and `removed` (the ranges taken out, in bytes).

    * null and texts shorter than LENGTH bytes keep all their bytes
    * matches are judged on the input and never cross documents; bytes may be cut inside a character
    * rows that share an id are one document to each other: neither is earlier
    * a row with a null id comes after all others; of these, the order is that of a hash of the text, and equal texts are one document
    * ties between equal strings are those of their documents; a very long text is hashed whole in one task, its strips are dealt out like all others
    * an empty table gives no rows; other columns are ignored
    """
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("doc_id"), text).alias("doc"), text.alias("text"))
    with bounded_batches(docs.sparkSession):
        size = source.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
        buckets = max(24, -(-size // (BYTES_PER_KEY * BUCKET_KEYS)))
        hot = hot_anchors(source, size)
        packed = source.select("doc", "text").mapInArrow(_packer(buckets, hot), PACKED)
        replies = packed.groupBy("bucket").applyInArrow(_meeting(hot), "doc long, full binary, part binary")
        told = stored(replies.groupBy("doc").agg(F.collect_list("full").alias("full"), F.collect_list("part").alias("part")), "strip-replies")
        asked = told.filter(F.size("part") > 0).select("doc", "part")
        sent = source.select("doc", "text").join(asked, "doc").mapInArrow(_sender(buckets, hot), SENT)
        spans = sent.groupBy("bucket").applyInArrow(_factors, "doc long, a long, z long")
        spans = stored(spans.groupBy("doc").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "strip-factors")
    known_of = told.select("doc", "full").join(spans, "doc", "full")
    rows = source.join(known_of, "doc", "left").select("doc_id", "text", "full", "spans")
    return rows.mapInArrow(_cutter(keep_text), RESULT + (", kept binary, removed array<struct<a:long,z:long>>" if keep_text else ""))
