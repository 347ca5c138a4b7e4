"""Keyed and unkeyed hashes of names: FNV-1a over whole columns, and keyed owner names."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def fnv1a64(names: pd.Series) -> np.ndarray:
    """FNV-1a 64 of every name's UTF-8 bytes, one byte of all names at a time; null as empty."""
    raw = [b"" if s is None else str(s).encode() for s in names]
    size = np.array([len(b) for b in raw], np.int64)
    wide = np.zeros((len(raw), int(size.max()) if len(raw) else 0), np.uint64)
    for i, b in enumerate(raw):
        wide[i, : len(b)] = np.frombuffer(b, np.uint8)
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    for j in range(wide.shape[1]):
        h = np.where(size > j, (h ^ wide[:, j]) * np.uint64(0x100000001B3), h)
    return h


def fnv_bucket(name: Column, buckets: int) -> Column:
    """FNV-1a 64 of a name modulo a number of buckets; null stays null."""

    @pandas_udf("long")
    def pick(names: pd.Series) -> pd.Series:
        return pd.Series((fnv1a64(names) % np.uint64(buckets)).astype(np.int64)).where(names.notna())

    return pick(name)


def owner_key(name: Column, secret: bytes) -> Column:
    """HMAC-SHA256 of a name under a secret, as hex; null stays null."""

    @pandas_udf("string")
    def keyed(names: pd.Series) -> pd.Series:
        return names.map(lambda s: None if s is None else hmac.new(secret, s.encode(), hashlib.sha256).hexdigest())

    return keyed(name)
