"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Each document gets two small collections of band hashes, A and B. A table key is
the pair (A_i, B_j), so m + m bands make m * m tables: the minhash work is about
the square root of that of independent tables with as many rows.

1. Sketch: one pass over the texts gives each document's number of shingles, a
   hash of its set and its bands. Documents with equal sets are one class, which
   gets a number of its own: rows that share an id but no text are told apart.
2. Candidates: classes that share a table key are joined by stars (keyring).
   Stars keep candidates connected, so a true link never leaves its candidate
   group.
3. Confirmation: the sets of each candidate group's members are compared in
   blocks, exactly, by counting common shingles; a task returns a star for each
   connected part, not the pairs. A group of many blocks is first compared
   within blocks and with its first block; then only members outside its largest
   part are compared with everything.
4. Components of the confirmed links, carried to all documents of each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.llm import keyring
from bookflow.llm.common import small_or_not, stored
from bookflow.llm.graph import components
from bookflow.llm.kernels import LOWER, RangeHash, mix, passes, text_bytes, word_ranges

#: Bands of each collection; the tables are their pairs.
BANDS = 11
#: Members of a block of a large candidate group.
BLOCK = 512
#: Shingles of a block and of a task of small groups, about: 32 MB of hashes.
TASK_SHINGLES = 1 << 22
#: Small groups are packed into tasks of about this many members.
PACK = 2000
WORD_FACTOR = mix(np.arange(1, 65, dtype=np.uint64))
COLUMNS_AT_ONCE = 8192


def band_rows(percent: int) -> int:
    """Minhashes in a band: with 11 bands a pair at the threshold is missed once in ten thousand or less."""
    return 3 if percent >= 85 else 2


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; a text of fewer words is one shingle, one without words none."""
    for first, last in passes(bounds):
        own = bounds[first : last + 1] - bounds[first]
        low = LOWER[data[bounds[first] : bounds[last]]]
        start, end, row = word_ranges(low, own)
        words = RangeHash(low).of(start, end) if len(start) else np.zeros(0, np.uint64)
        cut = np.searchsorted(row, np.arange(last - first + 1))
        total = np.zeros(max(len(words) - width + 1, 0), np.uint64)
        for k in range(width if len(total) else 0):
            total += words[k : len(words) - width + 1 + k] * WORD_FACTOR[k]
        total = mix(total)
        for i in range(last - first):
            a, z = int(cut[i]), int(cut[i + 1])
            if z - a >= width:
                yield np.unique(total[a : z - width + 1])
            elif z > a:
                yield mix(np.array([(words[a:z] * WORD_FACTOR[32 : 32 + z - a]).sum(dtype=np.uint64) + np.uint64(z - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


MARK_FACTOR = mix(np.arange(7001, 7002, dtype=np.uint64)) | np.uint64(1)


def set_mark(s: np.ndarray) -> bytes | None:
    """128 bits that tell a set of shingles from others; None for the empty set."""
    return np.array([s.sum(dtype=np.uint64), mix(s * MARK_FACTOR).sum(dtype=np.uint64) + np.uint64(len(s))]).tobytes() if len(s) else None


def _sketcher(width: int, rows: int, bands: int):
    factor = mix(np.arange(1001, 1001 + 2 * bands * rows, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(5001, 5001 + rows, dtype=np.uint64)) | np.uint64(1)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            counts, marks, halves = [], [], []
            for s in shingle_sets(data, bounds, width):
                counts.append(len(s))
                marks.append(set_mark(s))
                if not len(s):
                    halves.append(None)
                    continue
                low = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
                for k in range(0, len(s), 4096):
                    np.minimum(low, (s[k : k + 4096, None] * factor[None, :]).min(axis=0), out=low)
                halves.append(mix((mix(low).reshape(2 * bands, rows) * salt).sum(axis=1, dtype=np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array(halves, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "mark", "halves"],
            )

    return sketch


def sketches(docs: DataFrame, width: int, rows: int, bands: int = BANDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, mark (a hash of the set) and halves (the bands of A, then of B)."""
    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return source.mapInArrow(_sketcher(width, rows, bands), "doc_id long, text_hash long, n_shingles long, mark binary, halves binary")


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _table_keys(bands: int):
    table = mix(np.arange(9001, 9001 + bands * bands, dtype=np.uint64)).reshape(bands, bands)

    def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        halves = np.frombuffer(b"".join(batch.column("halves").to_pylist()), np.uint64).reshape(-1, 2 * bands)
        nodes = np.asarray(batch.column("node"), dtype=np.int64)
        a, b = halves[:, :bands], halves[:, bands:]
        keys = mix(a[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + b[:, None, :] + table)
        return keys.reshape(-1), np.repeat(nodes, bands * bands)

    return keys_of


def _set_maker(width: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            sets = list(shingle_sets(data, bounds, width))
            # of the rows that share the id of a class, those with its set
            own = [i for i, (s, m) in enumerate(zip(sets, batch.column("mark").to_pylist(), strict=True)) if set_mark(s) == m]
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(at), batch.column("grp").take(at), batch.column("blocks").take(at), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["node", "grp", "blocks", "shingles"]
            )

    return make


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of each pair, exact: products of 0/1 matrices over the shingles that both sides have."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        ok = both[at] == flat
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok]
        order = np.argsort(at[ok], kind="stable")
        return row[order], at[ok][order]

    lr, lc = cells(left)
    rr, rc = (lr, lc) if left is right else cells(right)
    for k in range(0, len(both), COLUMNS_AT_ONCE):
        width = min(COLUMNS_AT_ONCE, len(both) - k)
        parts = []
        for n, row, col in ((len(left), lr, lc), (len(right), rr, rc)):
            a, z = np.searchsorted(col, [k, k + width])
            m = np.zeros((n, width), np.float32)
            m[row[a:z], col[a:z] - k] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked_parts(nodes: list[int], left: list[int], right: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Stars of the parts that the links between left and right members make."""
    ls, rs = [sets[i] for i in left], [sets[i] for i in right]
    common = common_counts(ls, ls if left == right else rs)
    n, m = np.array([len(s) for s in ls]), np.array([len(s) for s in rs])
    linked = 100 * common >= percent * (n[:, None] + m[None, :] - common)
    parent = {nodes[i]: nodes[i] for i in (*left, *right)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(nodes[left[i]]), find(nodes[right[j]])
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent if find(x) != x]


def _confirmer(percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        group, side = table.column("grp").to_pylist(), table.column("side").to_pylist()
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        members: dict[int, tuple[list[int], list[int]]] = {}
        for i, (g, s) in enumerate(zip(group, side, strict=True)):
            pair = members.setdefault(g, ([], []))
            if s in (0, 2):
                pair[0].append(i)
            if s in (1, 2):
                pair[1].append(i)
        found = [x for left, right in members.values() if left and right for x in linked_parts(nodes, left, right, sets, percent)]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return confirm


def _compared(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks: node, grp, shingles, side (0 left, 1 right, 2 both) and the task's key."""
    return tasks.groupBy("task").applyInArrow(_confirmer(percent), "a long, b long")


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links that connect the same members of each candidate group (node, component) as all its true links do."""
    members = groups.join(classes.select("node", "rep", "mark", "n_shingles"), "node")
    sizes = groups.join(classes.select("node", "n_shingles"), "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("held"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("held") / TASK_SHINGLES)).cast("int")
    dealt = stored(members.join(sizes, "component").select("node", "rep", "mark", "n_shingles", F.col("component").alias("grp"), blocks.alias("blocks")), "candidate-groups")
    n, held = dealt.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    source = texts(docs)
    rows = source.join(small_or_not(dealt), source["doc_id"] == dealt["rep"]).select("node", "grp", "blocks", "mark", "text")
    sets = stored(rows.mapInArrow(_set_maker(width), "node long, grp long, blocks int, shingles binary").dropDuplicates(["node"]), "candidate-sets")
    packs = max(24, n // PACK, (held or 0) // TASK_SHINGLES)
    one = sets.filter("blocks = 1").select("node", "grp", "shingles", F.lit(2).alias("side"), F.concat(F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(packs))).alias("task"))
    big = sets.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    within = big.select("node", "grp", "shingles", F.lit(2).alias("side"), F.concat_ws(":", F.lit("w"), "grp", "block").alias("task"))
    head = big.filter("block = 0").select("node", "grp", "shingles", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"))
    rest = big.filter("block > 0").select("node", "grp", "shingles", F.lit(1).alias("side"), "block")
    across = head.unionByName(rest).select("node", "grp", "shingles", "side", F.concat_ws(":", F.lit("x"), "grp", "block").alias("task"))
    links = stored(_compared(one.unionByName(within).unionByName(across), percent), "links-first")
    if big.limit(1).count() == 0:
        return links
    return links.unionByName(_residual_links(stored(big, "large-groups"), links, percent))


def _residual_links(big: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Compare the members of large groups that are not in their group's largest part with all members."""
    parts = components(links)
    named = big.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    sizes = named.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("size"))
    main = stored(sizes.groupBy("grp").agg(F.max_by("part", F.struct("size", "part")).alias("main")), "largest-parts")
    marked = stored(named.join(small_or_not(main), "grp"), "large-parts")
    outside = marked.filter("part <> main")
    chunks = outside.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    chunks = stored(chunks, "residual-chunks")
    chunked = outside.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    left = chunked.select("node", "grp", "shingles", F.lit(0).alias("side"), "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = marked.join(chunks, "grp").select("node", "grp", "shingles", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block")
    tasks = left.unionByName(right).select("node", "grp", "shingles", "side", F.concat_ws(":", F.lit("r"), "grp", "chunk", "block").alias("task"))
    return _compared(tasks, percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by 100 * |common shingles| >= percent * |all shingles|.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable, its
    own included), kept (doc_id = component_id) and text_hash (xxhash64 of the
    text, which tells rows that share an id apart) for every row.

    * null and empty texts, and texts without words, have no shingles and are linked with nothing
    * a text of fewer than `width` words is one shingle, its whole sequence of words
    * documents with equal sets are linked, however many; only one of them is compared
    * rows that share an id are each judged by their own text
    * a row with a null id names no component: it gets the component of its text's other documents, or null, and is kept only then
    * ties: a pair exactly at the threshold is linked; a very long text is one row of shingle hashes in the task that compares it
    * an empty table gives no rows; other columns are ignored
    """
    rows = band_rows(percent)
    all_docs = stored(sketches(docs, width, rows), "sketches")
    named = all_docs.filter("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"), F.first("n_shingles").alias("n_shingles")).filter(F.col("rep").isNotNull())
    classes = stored(named.withColumn("node", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    packed = classes.select("node", "halves").mapInArrow(keyring.packer(_table_keys(BANDS), keyring.n_buckets(n * BANDS * BANDS)), keyring.PACKED)
    groups = components(keyring.shared_key_links(packed))
    parts = components(confirmed_links(docs, classes, groups, width, percent))
    # linked classes: the smallest id of each component, by class
    linked = classes.select("mark", "rep", "node").join(small_or_not(parts), "node")
    lows = linked.groupBy("component").agg(F.min("rep").alias("low"))
    low_of = stored(linked.join(lows, "component").select("mark", "low"), "class-lows")
    labels = classes.select("mark", "rep").join(small_or_not(low_of), "mark", "left").select("mark", F.coalesce("low", "rep").alias("low"))
    found = all_docs.select("doc_id", "n_shingles", "text_hash", "mark").join(labels, "mark", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), "text_hash")


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near-duplicates: those that `near_duplicates` keeps, by id and text.

    Rows equal in id and text are one document and stay or go together.
    """
    gone = near_duplicates(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash"))
    return docs.join(gone, same, "left_anti")
