"""What built-in functions can't express: vectorised over Arrow batches."""

from __future__ import annotations

import difflib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType

from .constants import TRUTH_MIN_CHARS


@arrow_udf(LongType())
def adler32(text: pa.Array) -> pa.Array:
    """Unsigned Adler-32 of the UTF-8 bytes; null for null. The bytes are read where they lie."""
    return pa.array([zlib.adler32(s.as_buffer()) if s.is_valid else None for s in text], pa.int64())


def sequence_ratio(a: str, b: str) -> float:
    """The matching-blocks ratio, with its rule for popular elements."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def common_subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence, a bit a character of ``a``: the matching blocks of a ratio are one, so none is longer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = v = (1 << len(a)) - 1
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def reaches(a: str, b: str, least: float) -> bool:
    return 2 * common_subsequence(a, b) >= (least - 1e-9) * (len(a) + len(b))


@pandas_udf(BooleanType())
def may_reach(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Whether the ratio of two texts could be ``least``: a few bit operations a character, where the ratio itself is quadratic."""
    return pd.Series([reaches(*x) for x in zip(a, b, least, strict=True)], dtype=bool)


@pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequence_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two statements; 0 if one is short. Not symmetric. Filter pairs before: it is quadratic in the length."""
    short = lambda x: x is None or len(x) < TRUTH_MIN_CHARS
    return pd.Series([0.0 if short(x) or short(y) else sequence_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(IntegerType())
def nearest_line(text: pd.Series, part: pd.Series, start: pd.Series) -> pd.Series:
    """The number of the line where ``part`` occurs nearest to ``start``, the first of equals; null if it doesn't."""

    def one(t: str | None, p: str | None, s: int | None) -> int | None:
        if t is None or not p:
            return None
        lines, at = [], t.find(p)
        while at >= 0:
            lines.append(t.count("\n", 0, at) + 1)
            at = t.find(p, at + 1)
        return min(lines, key=lambda n: (abs(n - (s or 0)), n), default=None)

    return pd.Series([one(*x) for x in zip(text, part, start, strict=True)], dtype="Int32")


@pandas_udf(ArrayType(FloatType()))
def floats_of_bytes(data: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@pandas_udf(BinaryType())
def bytes_of_floats(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@pandas_udf(StringType())
def canonical_json(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON with sorted keys and without spaces; null for what isn't JSON."""

    def one(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    for x in text:
        yield x.map(one)
