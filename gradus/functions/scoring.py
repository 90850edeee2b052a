"""Ratings from text and from log probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, parse_rating

#: What stands for -inf and NaN in stored records, and the negative of it for +inf.
SENTINEL = -1e300
CHOICES = 11


def _ev(lp: Column) -> Column:
    top = F.array_max(lp)
    w = F.transform(lp, lambda x: F.exp(x - top))
    total = F.aggregate(w, F.lit(0.0), lambda a, b: a + b)
    weighted = F.aggregate(F.transform(w, lambda x, i: x * i), F.lit(0.0), lambda a, b: a + b)
    return F.try_divide(weighted, total)


def ev_unchecked(logprobs: Column | str) -> Column:
    """F-03: mean rating under the softmax of the log probabilities; all equal gives the midpoint."""
    lp = _col(logprobs).cast("array<double>")
    return F.when(F.size(lp) > 0, _ev(lp))


def _usable(lp: Column) -> Column:
    return (F.size(lp) == CHOICES) & ~F.exists(lp, lambda x: x.isNull() | F.isnan(x)) & F.exists(lp, lambda x: x > float("-inf")) & ~F.exists(lp, lambda x: x == float("inf"))


def ev_strict(logprobs: Column | str) -> Column:
    """F-02: as ``ev_unchecked``; another length than 11, or nothing above -inf, is an error."""
    lp = _col(logprobs).cast("array<double>")
    return F.when(lp.isNull(), F.lit(None).cast("double")).when(_usable(lp), _ev(lp)).otherwise(F.raise_error(F.lit("log probabilities need 11 values, one of them finite")).cast("double"))


def ev_safe(logprobs: Column | str) -> Column:
    """F-05: as ``ev_strict``, with null where it has an error."""
    lp = _col(logprobs).cast("array<double>")
    return F.when(_usable(lp), _ev(lp))


def sanitise(logprobs: Column | str) -> Column:
    """F-06: finite values only."""
    return F.transform(_col(logprobs), lambda x: F.when(x.isNull() | F.isnan(x) | (x == float("-inf")), SENTINEL).when(x == float("inf"), -SENTINEL).otherwise(x))


def with_fallback(text: Column | str, logprobs: Column | str, threshold_ok: Column | str) -> Column:
    """F-04: struct (rating, ok, method): the parsed rating; or, where parsing is not good enough, the expected one."""
    parsed = parse_rating(text).cast("double")
    ev = F.when(~_col(threshold_ok), ev_safe(logprobs))
    rating = F.coalesce(parsed, ev)
    method = F.when(parsed.isNotNull(), "regex").when(ev.isNotNull(), "logit_ev").otherwise("none")
    return F.struct(rating.alias("rating"), rating.isNotNull().alias("ok"), method.alias("method"))


def log_softmax(values: Column | str) -> Column:
    x = _col(values).cast("array<double>")
    top = F.array_max(x)
    total = F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    return F.transform(x, lambda v: v - top - F.log(total))


def top_k(values: Column | str, k: int) -> Column:
    """X-14: the k greatest values of an array, zeros elsewhere; ties at the k-th stay."""
    x = _col(values)
    edge = F.element_at(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)))
    return F.transform(x, lambda v: F.when(v >= edge, v).otherwise(F.lit(0).cast("double")))
