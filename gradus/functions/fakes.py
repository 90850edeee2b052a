"""Deterministic stand-ins for model calls: functions of SHA-256, for tests and dry runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import log_softmax
from .text import _col


def _number(text: Column) -> Column:
    """The first eight bytes of the digest as an exact decimal."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def rating(material: Column | str) -> Column:
    """0 to 10."""
    return (_number(_col(material)) % 11).cast("int")


def logprobs(material: Column | str) -> Column:
    """Log probabilities of the tokens 0 to 10 from one hash for each."""
    logits = F.array(*[F.conv(F.substring(F.sha2(F.concat(_col(material), F.lit(f"|tok={i}")), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**32) for i in range(11)])
    return log_softmax(logits)


def review(prompt: Column | str, unparseable: float = 0.1) -> Column:
    """A number as text, or ``unclear`` for the given share."""
    n = _number(_col(prompt))
    return F.when((n % 1000).cast("double") / 1000 < unparseable, "unclear").otherwise((n % 11).cast("string"))


def request(text: Column | str, seed: Column | str) -> Column:
    """What a request's answers are derived from."""
    return F.concat(_col(text), F.lit("|seed="), _col(seed).cast("string"))
