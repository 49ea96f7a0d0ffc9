"""A trie of conversation prefixes, merged family by family.

The conversations of a family share a base id. A family is cogrouped with the
first turns of its base conversation, its conversations are rebuilt, and their
small trie is built in one task. Only the combined nodes of families leave it:
a hash of the prefix, counts and ids, no texts. Families' nodes then meet by
that hash.

Sums over subtrees need no walk. A node's smallest member owns it, so what a
conversation owns is the lower part of its path, and these parts are the trie's
distinct nodes. Hence a subtree's distinct bytes are what the node's owner has
below it, and for every other member all that this member owns; leaves are
counted with their owners. Both are sums over members, combined inside a family
first. Work is linear in turns, whatever the depth.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import stored

FAMILY = 5
#: Base turns that a rebuilt conversation may begin with are fewer than this.
HEAD = 9
#: Ids of one block are joined in one task; a block has as many ids at most.
ID_BLOCK = 1 << 16

TURNS = "family long, conv_id long, turn long, role string, text string"
NODES = "family long, key binary, parent binary, depth long, text_bytes long, n_convs long, conv_id long, below long, below_all long, members array<long>, ends array<long>"


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def _conversations(turns: pa.Table) -> dict[int, list[tuple[str, str]]]:
    """Turns (role, text) of each conversation, by turn (null first), role and text."""
    rows: dict[int, list] = {}
    for c, turn, role, text in zip(*(turns.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
        rows.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    return {c: [(r[2], r[3]) for r in sorted(found)] for c, found in rows.items()}


def chained(key: bytes, role: str, text: str) -> bytes:
    """The 128-bit hash of a prefix with one more turn."""
    raw = role.encode()
    return hashlib.blake2b(key + len(raw).to_bytes(8, "big") + raw + text.encode(), digest_size=16).digest()


ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def _family_trie(own: pa.Table, base: pa.Table) -> pa.Table:
    """Nodes of one family's trie. `own` has all turns of its conversations, `base` the first ones of the base conversation."""
    heads = next(iter(_conversations(base).values()), [])
    nodes: dict[bytes, list] = {}  # parent, depth, text bytes, smallest member, its bytes from here on, bytes of all members from here on, members, ends
    for c, turns in sorted(_conversations(own).items()):
        h = taken(c)
        path, key = [(ROOT, None, 0)], ROOT
        for role, text in heads[:h] + turns[h:]:
            before, key = key, chained(key, role, text)
            path.append((key, before, len(text.encode())))
        below = sum(size for _, _, size in path)
        for depth, (key, before, size) in enumerate(path):
            node = nodes.setdefault(key, [before, depth, size, c, below, 0, [], []])
            node[5] += below
            node[6].append(c)
            below -= size
        node[7].append(c)
    family = own.column("family")[0].as_py()
    made = [(family, k, n[0], n[1], n[2], len(n[6]), n[3], n[4], n[5], n[6], n[7]) for k, n in nodes.items()]
    ids = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 6, ids, ids]
    names = [part.split()[0] for part in NODES.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)


def taken(conv_id: int) -> int:
    """How many turns a rebuilt conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEAD


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The combined nodes of each family's trie."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = rows.select(base_of(F.col("conv_id")).alias("family"), "*")
    first = F.slice(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), 1, HEAD - 1)
    base = own.filter(F.col("conv_id") == F.col("family")).groupBy("family").agg(first.alias("t")).select("family", F.col("family").alias("conv_id"), F.inline("t"))
    return own.groupBy("family").cogroup(base.groupBy("family")).applyInArrow(_family_trie, NODES)


def _ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined blocks of ids of each key; rows come by key and block. Only the hash of the current key is held."""
    key, digest = None, None
    for batch in batches:
        keys, found = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    found.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def ends_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end.

    A hash over ordered ids is sequential. Ids are sorted and joined by blocks of
    ID_BLOCK ids, each by itself; what passes one task for a node with very many
    ends is the joined text of its blocks, hashed as it comes and not held.
    """
    ends = nodes.filter(F.size("ends") > 0).select("key", F.explode("ends").alias("c"))
    blocks = ends.groupBy("key", F.floor(F.col("c") / ID_BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return ordered.mapInArrow(_ends_digest, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 and node (the prefix's 128-bit hash).

    * turns stand in the order of `turn`, null first; ties in the order of role and text
    * repeated rows stay, as turns of their own
    * null role or text counts as empty
    * a row with a null conv_id belongs to no conversation and makes no node
    * a conversation that is left without turns is a member of the root
    * very long texts are held one family at a time, as a family is five conversations
    * an empty table gives no rows, also no root; other columns are ignored, whatever their names
    """
    nodes = stored(family_nodes(conversations), "family-nodes")
    merged = nodes.groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("text_bytes").alias("text_bytes"), F.sum("n_convs").alias("n_convs"),
        F.min(F.struct("conv_id", "below")).alias("owner"), F.sum("below_all").alias("below_all"),
    )
    merged = stored(merged.select("key", "parent", "depth", "n_convs", F.col("owner.conv_id").alias("conv_id"), F.col("owner.below").alias("below"), "below_all"), "prefix-nodes")
    # children: every node counts for its parent
    links = merged.select("key", F.lit(0).alias("child")).unionByName(merged.filter("parent is not null").select(F.col("parent").alias("key"), F.lit(1).alias("child")))
    children = links.groupBy("key").agg(F.sum("child").alias("n_children"))
    known = stored(merged.join(children, "key"), "prefix-children")
    # what each conversation owns: bytes from its first own node on, and whether its last one is a leaf
    owned = known.groupBy("conv_id").agg(F.max("below").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min("depth").alias("top"))
    owned = stored(owned, "owned")
    per_family = owned.groupBy(base_of(F.col("conv_id")).alias("family")).agg(F.map_from_entries(F.collect_list(F.struct("conv_id", F.struct("owned", "leaf")))).alias("owns"))
    value = lambda name: F.aggregate("members", F.lit(0).cast("long"), lambda s, c: s + F.coalesce(F.try_element_at("owns", c)[name], F.lit(0).cast("long")))
    sums = (
        nodes.select("family", "key", "members").join(per_family, "family", "left").select("key", value("owned").alias("owned_all"), value("leaf").alias("leaves"))
        .groupBy("key").agg(F.sum("owned_all").alias("owned_all"), F.sum("leaves").alias("n_leaves"))
    )
    own = known.join(owned.select("conv_id", F.col("owned").alias("of_owner"), "top"), "conv_id")
    # below its first own node a conversation's nodes have their parent in its own path
    tops = own.filter("depth = top").select("key", "parent")
    parents = tops.join(merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_owner")), "parent").select("key", "parent_owner")
    done = own.join(sums, "key").join(parents, "key", "left").join(ends_digests(nodes), "key", "left")
    saved = F.col("below_all") - F.col("below") - (F.col("owned_all") - F.col("of_owner"))
    return done.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_owner")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lower(F.hex("key")).alias("node"),
    )


def oracle() -> str:
    """Prefixes as hashes of their written turns; subtrees as pairs of prefixes that share a conversation."""
    from bookflow.llm.oracles import crc32

    written = "strlen(role) || ':' || role || strlen(text) || ':' || text"
    return f"""WITH t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {crc32("conv_id")} % {HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT i.conv_id, k, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % {FAMILY} AND k <= h UNION ALL SELECT i.conv_id, k, role, text FROM ids i JOIN t USING (conv_id) WHERE k > h),
p AS MATERIALIZED (SELECT conv_id, row_number() OVER w AS d, md5(string_agg({written}, '') OVER w) AS key, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k) UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
l AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS MATERIALIZED (SELECT key, any_value(d) AS depth, any_value(parent) AS parent, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM l GROUP BY key),
c AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent), below AS (SELECT DISTINCT a.key AS top, b.key AS key FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d <= b.d),
s AS (SELECT top AS key, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM below JOIN n USING (key) LEFT JOIN c USING (key) GROUP BY top)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256 FROM n JOIN s USING (key) LEFT JOIN c USING (key) LEFT JOIN n u ON u.key = n.parent"""
