"""Exchange of hashed keys in packed form: who else has my key?

A row per key would cost Spark tens of bytes each. Here a task packs the keys of
many owners into one binary column per bucket of the hash range, so the shuffle
carries 12 bytes a key and one row for each pair of batch and bucket. Each batch
sends a key once, however many of its owners hold it: the others are linked to
the batch's smallest owner at once. So a key that a third of all owners share
adds one entry a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "bucket int, edge boolean, keys binary, owners binary"
#: Keys that one bucket's task sorts, about.
BUCKET_KEYS = 1_000_000


def n_buckets(keys: int) -> int:
    return max(24, -(-keys // BUCKET_KEYS))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def stars(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with its smallest owner, and links of the key's other owners to that one."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    head = owners[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else owners
    other = ~first & (owners != head)
    return keys[first], owners[first], owners[other], head[other]


def unique_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def packer(keys_of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: keys and owners of each batch, packed by bucket; links inside the batch as `edge` rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners, a, b = stars(*keys_of(batch))
            rows: list[tuple] = []
            if len(keys):
                bucket = bucket_of(keys, buckets)  # keys are sorted, so buckets are runs
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                rows += [(int(bucket[x]), False, keys[x:y].tobytes(), owners[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            if len(a):
                a, b = unique_links(a, b)
                rows.append((int(a[0]) % buckets, True, a.tobytes(), b.tobytes()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "edge", "keys", "owners"])

    return pack


def _meet(table: pa.Table) -> pa.Table:
    edge = np.array(table.column("edge").to_pylist(), bool)
    keys, owners = table.column("keys").to_pylist(), table.column("owners").to_pylist()
    join = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
    shared = [i for i in range(len(edge)) if not edge[i]]
    inner = [i for i in range(len(edge)) if edge[i]]
    _, _, a, b = stars(join([keys[i] for i in shared], np.uint64), join([owners[i] for i in shared], np.int64))
    a = np.concatenate([a, join([keys[i] for i in inner], np.int64)])
    b = np.concatenate([b, join([owners[i] for i in inner], np.int64)])
    a, b = unique_links(a, b)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def shared_key_links(packed: DataFrame) -> DataFrame:
    """Links (a, b) that join all owners of every shared key, a star for each key."""
    return packed.groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct()
