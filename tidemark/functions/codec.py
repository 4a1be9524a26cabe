"""Delta and variable-length integer coding of ascending id lists, and the index record of packed shards."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: little-endian, unpadded: int32 tag, int64 offset, int32 length
INDEX_RECORD = struct.Struct("<iqi")


def deltas(ids: Column) -> Column:
    """First differences of an ascending array; the first entry counts from 0."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def undeltas(steps: Column) -> Column:
    """The inverse of deltas: running sums."""
    total = F.aggregate(steps, F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.coalesce(F.element_at(acc, F.when(F.size(acc) > 0, F.lit(-1)).otherwise(F.lit(None).cast("int"))), F.lit(0).cast("bigint")) + x))
    return F.coalesce(total, F.array().cast("array<bigint>"))


def encode(ids: Iterable[int]) -> bytes:
    """LEB128 of the first differences of strictly ascending, non-negative ids."""
    out, last = bytearray(), -1
    for x in ids:
        if x <= last:
            raise ValueError("ids must ascend strictly from 0 up")
        step, last = (x if last < 0 else x - last), x
        while step >= 0x80:
            out.append(step & 0x7F | 0x80)
            step >>= 7
        out.append(step)
    return bytes(out)


def numbers(data: bytes) -> np.ndarray:
    """All LEB128 numbers of a buffer at once: a number ends where the high bit is clear, and the seven bits of each byte are
    moved up by its place within its number."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    if raw[-1] & 0x80:
        raise ValueError("the last number has no end")
    length = np.diff(np.flatnonzero(raw < 0x80), prepend=-1)
    if length.max() > 9:
        raise ValueError("a number needs more than 63 bits")
    start = np.cumsum(length) - length
    place = np.arange(len(raw)) - np.repeat(start, length)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), start)


def decode(data: bytes) -> list[int]:
    """The ids behind their first differences."""
    steps = numbers(data)
    if (steps[1:] < 1).any():
        raise ValueError("ids must ascend strictly")
    return steps.cumsum().tolist()


@F.pandas_udf(T.BinaryType())
def encode_ids(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else encode(x))


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_ids(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else decode(x))
