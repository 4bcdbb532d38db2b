"""Keyed fingerprints and labels.

A secret is reduced to HMAC-SHA256 under a pepper before the first shuffle. The pepper reaches executors in a broadcast,
never as a literal in a plan, where `explain`, the UI and event logs would show it.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MIN_PEPPER = 32


def check_pepper(pepper: bytes) -> bytes:
    """At least 32 bytes; there is no fallback to a plain hash."""
    if not isinstance(pepper, bytes) or len(pepper) < MIN_PEPPER:
        raise ValueError(f"a pepper of at least {MIN_PEPPER} bytes is needed")
    return pepper


class Fingerprinter:
    """Column functions for one pepper: `fp` (64 hex digits), `label` (cred- and 6 hex digits of the keyed fp)."""

    def __init__(self, spark: SparkSession, pepper: bytes):
        shared = spark.sparkContext.broadcast(check_pepper(pepper))

        def keyed(prefix: bytes):
            @F.pandas_udf("string")
            def digest(values: pd.Series) -> pd.Series:
                key = shared.value
                return values.map(lambda v: None if v is None else hmac.new(key, prefix + (v.encode() if isinstance(v, str) else bytes(v)), hashlib.sha256).hexdigest())

            return digest

        self.fp, self._label = keyed(b"fp\0"), keyed(b"label\0")

    def label(self, fp):
        return F.concat(F.lit("cred-"), F.substring(self._label(fp), 1, 6))
