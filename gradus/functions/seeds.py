"""Seeds and temperatures from SHA-256 of keys; hashes of texts and of canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import _col


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256)


def _u32(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def derive(release: Column | str, prompt: Column | str, model: Column | str, index: Column | str) -> Column:
    """F-07: struct (temperature in 0.85..1.15, seed below 2**31) of the key, from the digest's first and second 8 bytes."""
    h = _digest(release, prompt, model, index)
    fraction = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
    seed = _u32(F.substring(h, 25, 8)).bitwiseAND(F.lit(2147483647).cast("bigint"))
    return F.struct((F.lit(0.85) + F.lit(0.30) * fraction).alias("temperature"), seed.alias("seed"))


def u32(*parts: Column | str) -> Column:
    """F-08: SHA-256 of the parts modulo 2**32."""
    return _u32(F.substring(_digest(*parts), 57, 8))


def text_hash(text: Column | str) -> Column:
    """F-09."""
    return F.sha2(_col(text), 256)


@F.pandas_udf(StringType())
def canonical_json_hash(document: pd.Series) -> pd.Series:
    """F-09: SHA-256 of a JSON document with sorted keys, no spaces and ASCII escapes (``to_json`` does not escape)."""

    def one(x: str | None) -> str | None:
        return None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    return document.map(one)


def unit(*parts: Column | str) -> Column:
    """A number in [0, 1) of the key."""
    return _u32(F.substring(_digest(*parts), 1, 8)).cast("double") / F.lit(2.0**32)
