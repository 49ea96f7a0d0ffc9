"""Periodic runs of words: a harmonic grid of block comparisons over prefix hashes.

For every period q a text is cut into blocks of q words. Two neighbouring blocks
are compared by their hashes, for all periods and blocks at once; there are
n/1 + n/2 + ... of these pairs, so n log n for n words. A run of exponent 4 or more
holds two equal pairs in a row; such chains are extended at both ends by a binary
search over hashes, again for all chains at once. Stretches that several periods
reach are one run, with the smallest period. Every run is then confirmed on the
bytes of its words; if one fails, words are numbered exactly and searched again.

Texts of like length are searched together, in one array with a mark between
them. All work stays in the task that reads a text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm import kernels
from bookflow.llm.common import parts_of, release_memory

LEAST_LENGTH, EXPONENT = 6, 4
#: Pairs of blocks compared in one step, and bytes hashed in one step.
STEP_PAIRS, STEP_BYTES = 1 << 20, 1 << 20


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then the same for the next."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by steps of bounded size that end between words."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(end, start[k] + STEP_BYTES, side="right")))
        base = start[k]
        out[k:last] = kernels.RangeHash(data[base : end[last - 1]]).of(start[k:last] - base, end[k:last] - base)
        k = last
    return out


class Search:
    """Candidate runs over one array of keys."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.power = kernels.powers(self.n + 1)[0]
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(keys * self.power[: self.n], dtype=np.uint64, out=self.prefix[1:])

    def same(self, x: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether keys [x, x + length) equal those q further on."""
        p = self.prefix
        return (p[x + length] - p[x]) * self.power[q] == p[x + q + length] - p[x + q]

    def chains(self, q_from: int, q_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(period, from, to) of two or more equal pairs of blocks in a row: keys in [from, to) equal those a period on."""
        periods = np.arange(q_from, q_to)
        count = np.maximum(self.n // periods - 1, 0)
        q, j = np.repeat(periods, count), expand(np.zeros(len(periods), np.int64), count)
        equal = np.flatnonzero(self.same(j * q, q, q))
        q, j = q[equal], j[equal]
        if not len(q):
            return q, j, j
        first = np.ones(len(q), bool)
        first[1:] = (np.diff(j) != 1) | (np.diff(q) != 0)
        opens = np.flatnonzero(first)
        closes = np.append(opens[1:], len(q)) - 1
        long = closes > opens
        opens, closes = opens[long], closes[long]
        return q[opens], j[opens] * q[opens], (j[closes] + 1) * q[opens]

    def extension(self, q: np.ndarray, at: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many keys before (back) or from `at` on equal those a period on, up to `most`, by binary search for all at once."""
        low, high = np.zeros(len(q), np.int64), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = self.same(at - mid if back else at, q, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def candidates(self, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of maximal stretches, without repeats, each with its smallest period, ordered."""
        top = longest // EXPONENT
        found, q_from = [], 1
        pairs = np.cumsum(self.n // np.arange(1, top + 1)) if top else np.zeros(0, np.int64)
        while q_from <= top:
            done = pairs[q_from - 2] if q_from > 1 else 0
            q_to = max(q_from + 1, int(np.searchsorted(pairs, done + STEP_PAIRS, side="right")) + 1)
            q, a, z = self.chains(q_from, min(q_to, top + 1))
            if len(q):
                start = a - self.extension(q, a, np.minimum(q - 1, a), True)
                end = z + self.extension(q, z, np.minimum(q - 1, self.n - q - z), False) + q
                long = end - start >= np.maximum(LEAST_LENGTH, EXPONENT * q)
                found.append(np.stack([start, end, q])[:, long])
            q_from = q_to
        every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        every = every[:, np.lexsort((every[2], every[1], every[0]))]
        new = np.ones(every.shape[1], bool)
        new[1:] = (np.diff(every[0]) != 0) | (np.diff(every[1]) != 0)
        return tuple(every[:, new])


def same_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the words x have the bytes of the words y, compared in steps of bounded size."""
    size = end - start
    if (size[x] != size[y]).any():
        return False
    upto, k = np.cumsum(size[x]), 0
    while k < len(x):
        last = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + STEP_BYTES, side="right")))
        a, b, n = start[x[k:last]], start[y[k:last]], size[x[k:last]]
        if (data[expand(a, n)] != data[expand(b, n)]).any():
            return False
        k = last
    return True


def runs_of_texts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Words (start, end, text) and runs (text, start, length, period as columns) of a buffer of texts."""
    start, end, row = kernels.word_ranges(data, bounds)
    counts = np.bincount(row, minlength=len(bounds) - 1)
    first_word = np.cumsum(counts) - counts
    keys = word_keys(data, start, end)
    runs = [np.zeros((4, 0), np.int64)]
    size_class = np.where(counts >= LEAST_LENGTH, np.frexp(counts)[1], 0)
    for c in np.unique(size_class[size_class > 0]):
        texts = np.flatnonzero(size_class == c)
        # a mark after each text, by its own number: place in the joined array -> word
        n, at = counts[texts], np.cumsum(counts[texts] + 1) - counts[texts] - 1
        word = np.full(n.sum() + len(texts), -1, np.int64)
        word[expand(at, n)] = expand(first_word[texts], n)
        inside = word >= 0
        marks = kernels.mix(np.arange(1, len(word) + 1, dtype=np.uint64) * kernels.MIX_A)
        used = keys
        while True:
            a, z, q = Search(np.where(inside, used[word], marks)).candidates(int(n.max()))
            x = expand(a, z - a - q)
            y = x + np.repeat(q, z - a - q)
            if (word[x] >= 0).all() and (word[y] >= 0).all() and same_words(data, start, end, word[x], word[y]):
                break
            numbers: dict[bytes, int] = {}  # two words or ranges shared a hash: number the words, and deal other values
            exact = np.fromiter((numbers.setdefault(data[s:e].tobytes(), len(numbers)) for s, e in zip(start, end, strict=True)), np.uint64, len(start))
            marks = kernels.mix(marks)
            used = kernels.mix((exact + np.uint64(1)) * kernels.BASE ^ marks[0])
        text = np.searchsorted(at, a, side="right") - 1
        runs.append(np.stack([texts[text], a - at[text], z - a, q]))
    found = np.concatenate(runs, axis=1)
    return (start, end, row), first_word, counts, found[:, np.lexsort((found[3], found[1], found[0]))]


def collapsed(data: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], first_word: np.ndarray, n_texts: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of the texts without the words that a run repeats, one space between words."""
    start, end, row = words
    change = np.zeros(len(start) + 1, np.int64)
    begin = first_word[runs[0]] + runs[1]
    np.add.at(change, begin + runs[3], 1)
    np.add.at(change, begin + runs[2], -1)
    kept = np.cumsum(change[:-1]) == 0
    start, size, row = start[kept], (end - start)[kept], row[kept]
    leads = np.zeros(len(row), bool)
    leads[1:] = row[1:] == row[:-1]  # a space before all but a text's first word
    width = size + leads
    out = np.full(int(width.sum()), 32, np.uint8)
    at = np.cumsum(width) - size
    k = 0
    upto = np.cumsum(size)
    while k < len(start):
        last = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + STEP_BYTES, side="right")))
        out[expand(at[k:last], size[k:last])] = data[expand(start[k:last], size[k:last])]
        k = last
    bounds = np.zeros(n_texts + 1, np.int64)
    np.cumsum(np.bincount(row, weights=width, minlength=n_texts).astype(np.int64), out=bounds[1:])
    return out, bounds


RUN = "struct<start:long,length:long,period:long>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts_of(batches, "text", kernels.PASS_BYTES):
        ids, texts = part.column("doc_id"), part.column("text")
        texts = pa.compute.fill_null(texts, "")
        data, bounds = kernels.text_bytes(texts)
        words, first_word, _, runs = runs_of_texts(data, bounds)
        out, out_bounds = collapsed(data, words, first_word, len(ids), runs)
        offsets = np.searchsorted(runs[0], np.arange(len(ids) + 1))
        structs = pa.StructArray.from_arrays([pa.array(c) for c in runs[1:]], names=["start", "length", "period"])
        text = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(out_bounds), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), text.cast(pa.string())], names=["doc_id", "runs", "collapsed"])
    release_memory()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the collapsed text of each document.

    Words are what stands between spaces and the control characters from tab to
    carriage return, numbered from 0. A run is a stretch of words with smallest
    period q, of LEAST_LENGTH words and EXPONENT periods or more, that no neighbour
    extends. The collapsed text leaves out every word that stands in a run behind
    its first period, and joins the others by one space.

    * null and empty texts have no runs and collapse to the empty text
    * a null doc_id stays null; rows that repeat or share an id are judged one by one
    * runs may overlap, and share a start with different periods (ties)
    * a very long text is searched whole, in the memory of one task (about 100 bytes a word)
    * an empty table gives no rows; other columns are ignored, whatever their names
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {kind}, runs array<{RUN}>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """Documents in which one of ten, told by its id, repeats a stretch of its own words up to its end.

    With h the CRC-32 of the decimal id and g = h div 10, words from a = g % n on become
    a repetition of the p = 1 + (n - a) div (3 + g % 8) words that stand there.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("__words"), F.floor(h / 10).alias("__g"))
    n = F.size("__words").cast("long")
    with_a = chosen.withColumn("__a", F.when(n > 0, F.col("__g") % n).cast("int"))
    rest = F.size("__words") - F.col("__a")
    with_p = with_a.withColumn("__p", (1 + F.floor(rest / (3 + F.col("__g") % 8))).cast("int"))
    block = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    times = F.ceil(rest / F.col("__p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), rest)
    again = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), tail), " ")
    return with_p.select("doc_id", F.when(F.col("__a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def _row(r: Column) -> Column:
    return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))


def summary(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of periodic_runs."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("neg"), r["start"].alias("start"), r["period"].alias("period"))))
    with_best = found.withColumn("__best", best)
    start, length, period = F.col("__best.start"), -F.col("__best.neg"), F.col("__best.period")
    return with_best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _row), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def oracle() -> str:
    """Equal words of a document in pairs; for each distance, islands of neighbouring pairs are stretches; a stretch has its smallest distance."""
    from bookflow.llm.oracles import crc32

    return rf"""WITH w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {crc32("doc_id")} AS h FROM documents),
w1 AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS chosen, h // 10 AS g FROM w0), w2 AS (SELECT *, CASE WHEN chosen THEN g % n END AS a FROM w1), w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
w4 AS MATERIALIZED (SELECT doc_id, n, CASE WHEN chosen THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1])) ELSE w END AS w FROM w3),
x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM w4), eq AS (SELECT u.doc_id, v.i - u.i AS q, u.i AS i FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.x = v.x AND v.i > u.i AND {EXPONENT} * (v.i - u.i) <= u.n),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM eq), st AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM isl GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST_LENGTH}, {EXPONENT} * q)),
runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM st GROUP BY doc_id, s, l), gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT doc_id, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1), listed AS (SELECT doc_id, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(listed.n, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM w4 d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
