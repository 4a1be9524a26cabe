"""Sets of 32-bit ids in the portable Roaring format (the public specification), written and read with NumPy.

An id's upper 16 bits name its container; a container of up to ARRAY ids lists their lower halves, a larger one is a bitmap.
The file is a header (a key and a cardinality for each container, and where it stands) and the containers in order of keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the format
NO_RUNS, WITH_RUNS = 12346, 12347
ARRAY = 4096
NO_OFFSETS_BELOW = 4
BITMAP_BYTES = 8192


def container(low: np.ndarray) -> bytes:
    """The body of a container: ascending lower halves, or 65,536 bits."""
    if len(low) <= ARRAY:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def header(keys: Iterable[int], sizes: Iterable[int]) -> bytes:
    """What stands before the containers of these keys and cardinalities."""
    keys, sizes = np.asarray(list(keys), np.int64), np.asarray(list(sizes), np.int64)
    each = np.stack([keys, sizes - 1], 1).astype("<u2").tobytes()
    body = np.where(sizes <= ARRAY, 2 * sizes, BITMAP_BYTES)
    at = 8 + 8 * len(keys) + np.cumsum(body) - body
    return np.array([NO_RUNS, len(keys)], "<u4").tobytes() + each + at.astype("<u4").tobytes()


def dump(ids: Iterable[int]) -> bytes:
    ids = np.unique(np.asarray(list(ids), np.int64))
    if len(ids) and (ids[0] < 0 or ids[-1] >= 1 << 32):
        raise ValueError("ids must fit in 32 bits")
    keys, start = np.unique(ids >> 16, return_index=True)
    lows = np.split(ids & 0xFFFF, start[1:]) if len(keys) else []
    return header(keys, map(len, lows)) + b"".join(map(container, lows))


def _containers(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    cookie = int(np.frombuffer(data, "<u4", 1)[0])
    if cookie == NO_RUNS:
        n, at, runs = int(np.frombuffer(data, "<u4", 1, 4)[0]), 8, np.zeros(0, np.uint8)
    elif cookie & 0xFFFF == WITH_RUNS:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 4), bitorder="little")
        at = 4 + -(-n // 8)
    else:
        raise ValueError("not a portable roaring bitmap")
    each = np.frombuffer(data, "<u2", 2 * n, at).astype(np.int64).reshape(n, 2)
    at += 4 * n + (4 * n if cookie == NO_RUNS or n >= NO_OFFSETS_BELOW else 0)
    for i, (key, less) in enumerate(each.tolist()):
        if len(runs) and runs[i]:
            count = int(np.frombuffer(data, "<u2", 1, at)[0])
            pairs = np.frombuffer(data, "<u2", 2 * count, at + 2).astype(np.int64).reshape(count, 2)
            low, at = np.concatenate([np.arange(s, s + x + 1) for s, x in pairs.tolist()]), at + 2 + 4 * count
        elif less < ARRAY:
            low, at = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64), at + 2 * (less + 1)
        else:
            low, at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, BITMAP_BYTES, at), bitorder="little")), at + BITMAP_BYTES
        if len(low) != less + 1:
            raise ValueError("a container doesn't hold as many ids as its header says")
        yield key, low
    if at != len(data):
        raise ValueError("bytes follow the last container")


def load(data: bytes) -> list[int]:
    found = [(key << 16) + low for key, low in _containers(data)]
    return np.concatenate(found).tolist() if found else []


@F.pandas_udf(T.BinaryType())
def _bodies(lows: pd.Series) -> pd.Series:
    return lows.map(lambda x: container(np.asarray(x, np.int64)))


def containers(ids: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """by, key, cardinality, body: one row for each container of each set, so no set is gathered whatever its size."""
    key = F.shiftright(F.col(id_col), 16).cast("int").alias("key")
    low = F.col(id_col).bitwiseAND(F.lit(0xFFFF)).cast("int").alias("low")
    lows = ids.select(*by, key, low).groupBy(*by, "key").agg(F.array_sort(F.collect_set("low")).alias("lows"))  # 65,536 at most
    return lows.select(*by, "key", F.size("lows").alias("cardinality"), _bodies("lows").alias("body"))
