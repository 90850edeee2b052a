"""Grouped summaries (A-) and ordered operators (X-)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def item_means(df: DataFrame, item: Sequence[str], value: str, carried: Sequence[str] = (), z: float = 1.96) -> DataFrame:
    """A-01: mean, half width of its interval (0 for one row), count, and columns constant in an item."""
    half = F.coalesce(z * F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return df.groupBy(*item).agg(F.avg(value).alias("mean"), half.alias("half_width"), F.count(value).alias("n"), *[F.min(c).alias(c) for c in carried])


def cell_means(df: DataFrame, cell: Sequence[str], value: str) -> DataFrame:
    """A-02."""
    return df.groupBy(*cell).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def mean_if(value: str | Column, condition: Column) -> Column:
    return F.avg(F.when(condition, F.col(value) if isinstance(value, str) else value))


def gap(value: str, column: str, high: object, low: object) -> Column:
    """A-19: mean where column is ``high`` less mean where it is ``low``; null without either."""
    return mean_if(value, F.col(column) == high) - mean_if(value, F.col(column) == low)


def pivoted_gaps(df: DataFrame, key: Sequence[str], factor: str, levels: Sequence[str], sign: str, value: str, high: str = "bad", low: str = "good") -> DataFrame:
    """A-03: the sign gap in each level of a factor, as columns; one aggregation."""
    at = lambda level, s: mean_if(value, (F.col(factor) == level) & (F.col(sign) == s))
    return df.groupBy(*key).agg(*[(at(x, high) - at(x, low)).alias(f"gap_{x}") for x in levels])


def pivoted_means(df: DataFrame, key: Sequence[str], column: str, levels: Sequence[str], value: str) -> DataFrame:
    """A-04."""
    return df.groupBy(*key).agg(*[mean_if(value, F.col(column) == x).alias(str(x)) for x in levels])


def percent_failed(df: DataFrame, key: Sequence[str], column: str, levels: Sequence[str], failed: str) -> DataFrame:
    """A-06: percent of failed rows and their number by level."""
    parts = [p for x in levels for p in (F.bround(100 * mean_if(F.col(failed).cast("double"), F.col(column) == x), 1).alias(f"pct_{x}"), F.count_if(F.col(column) == x).alias(f"n_{x}"))]
    return df.groupBy(*key).agg(*parts)


def counts_and_rate(df: DataFrame, key: Sequence[str], flag: str, digits: int = 4) -> DataFrame:
    """A-07, A-08."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("bigint")).alias("n_true")).withColumn("rate", F.bround(F.col("n_true") / F.col("n"), digits))


def guarded_corr(df: DataFrame, key: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """A-09, A-10: correlation and mean absolute difference; null for few rows or a constant column."""
    ok = (F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()) >= least) & (F.stddev_samp(x) > 0) & (F.stddev_samp(y) > 0)
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.when(ok, F.corr(x, y)).alias("r"), F.avg(F.abs(F.col(x) - F.col(y))).alias("mad"))


def labelled_counts(df: DataFrame, key: Sequence[str], distinct: str) -> DataFrame:
    """A-11, A-12: rows and exact distinct values."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"))


def complete_tally(domain: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A-13: counts for every value of the domain, zeros included."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    return domain.select(key).distinct().join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def complete_grid(df: DataFrame, row: str, column: str, columns: Sequence[str]) -> DataFrame:
    """A-14."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(str(c)) for c in columns])


def set_summary(df: DataFrame, key: Sequence[str], first: Sequence[str], non_empty: Sequence[str], order_by: str) -> DataFrame:
    """A-15: first values in order, and first values that are not blank."""
    filled = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order_by))).alias(c) for c in non_empty]
    return df.groupBy(*key).agg(*[F.min_by(c, order_by).alias(c) for c in first], *filled)


def next_number(df: DataFrame, key: Sequence[str], number: str) -> DataFrame:
    """A-16."""
    return df.groupBy(*key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("bigint").alias("next"), F.count_distinct(number).alias("n"))


def repeated(df: DataFrame, key: Sequence[str], least: int = 2) -> DataFrame:
    """A-17, A-33: keys of several rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def group_sizes(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """A-34."""
    return df.groupBy(*key).agg(F.count("*").alias("n"))


def rarest(counts: DataFrame, name: str, n: str, order: str) -> DataFrame:
    """A-18: the first of the rarest names, if the commonest has over twice its count; else null."""
    return counts.agg(F.when(F.max(n) > 2 * F.min(n), F.min_by(name, F.struct(n, order))).alias("rarest"))


def stratum_gap(df: DataFrame, key: Sequence[str], stratum: str, sign: str, value: str, high: str = "bad", low: str = "good") -> DataFrame:
    """A-20: the mean over strata of the gap in each; strata without both sides don't count."""
    inside = df.groupBy(*key, stratum).agg(gap(value, sign, high, low).alias("g"))
    return inside.groupBy(*key).agg(F.avg("g").alias("gap"), F.count("g").alias("n_strata"))


def component_gaps(df: DataFrame, key: Sequence[str], value: str = "rating") -> DataFrame:
    """A-19, A-21: the five gaps of a group in long form, without those that have no value."""
    v = F.col("valence")
    at = lambda x: mean_if(value, v == x)
    out = df.groupBy(*key).agg(
        gap(value, "sign", "bad", "good").alias("overall"), (at("MB") - at("MG")).alias("moral"), (at("NMB") - at("NMG")).alias("nonmoral"), (at("NEU") - 5).alias("neutral_offset"), (gap(value, "typicality", "uncommon", "common")).alias("typicality")
    )
    return out.unpivot(list(key), ["overall", "moral", "nonmoral", "neutral_offset", "typicality"], "component", "gap").filter("gap is not null")


def failing_families(df: DataFrame, family: str, level: str, value: str, high: str = "common", low: str = "uncommon") -> DataFrame:
    """A-22: rows with ``flag`` where the family's mean of one level is not above that of the other."""
    w = Window.partitionBy(family)
    a, b = F.avg(F.when(F.col(level) == high, F.col(value))).over(w), F.avg(F.when(F.col(level) == low, F.col(value))).over(w)
    return df.withColumns({"__a": a, "__b": b}).withColumn("flag", F.coalesce(~(F.col("__a") > F.col("__b")), F.lit(False))).drop("__a", "__b")


def pair_flags(pairs: DataFrame, max_diff: float = 2, min_gap: float = 2) -> DataFrame:
    """A-23: text on pairs whose severity differs or whose vividness does not; null if a rating is missing."""
    s = F.when(F.abs(F.col("severity_high") - F.col("severity_low")) > max_diff, F.lit("severity mismatch"))
    v = F.when(F.col("vividness_high") - F.col("vividness_low") < min_gap, F.lit("vividness gap too small"))
    whole = reduce(lambda a, b: a & b, [F.col(f"{c}_{x}").isNotNull() for c in ("severity", "vividness") for x in ("low", "high")])
    return pairs.withColumn("pair_flag", F.when(whole, F.concat_ws("; ", s, v)))


def spread(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A-24, A-32: mean, median, extremes and the central 95 % (linear interpolation)."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = df.groupBy(*key).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), p.alias("p"))
    return out.select(*key, "mean", "min", "max", F.col("p")[0].alias("p025"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p975"))


def histogram(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A-24."""
    return df.withColumn("bin", F.floor(value).cast("bigint")).groupBy(*key, "bin").agg(F.count("*").alias("n"))


def pooled_rate(df: DataFrame, key: Sequence[str], hits: str, total: str) -> DataFrame:
    """A-25: sums of parts first, then their ratio."""
    return df.groupBy(*key).agg(F.sum(hits).alias("hits"), F.sum(total).alias("total")).withColumn("rate", F.try_divide("hits", "total"))


def category_shares(df: DataFrame, key: Sequence[str], category: str, levels: Sequence[str]) -> DataFrame:
    """A-26: percent of all rows in each category."""
    return df.groupBy(*key).agg(*[F.bround(100 * F.count_if(F.col(category) == x) / F.count("*"), 2).alias(str(x)) for x in levels])


def error_variance(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """A-27: variance of a mean."""
    return df.groupBy(*key).agg((F.var_samp(value) / F.count(value)).alias("error_variance"))


def peak(df: DataFrame, key: Sequence[str], value: str, place: str) -> DataFrame:
    """A-28: the first place of the greatest value."""
    return df.groupBy(*key).agg(F.max_by(place, F.struct(F.col(value), -F.col(place))).alias("place"), F.max(value).alias("value"))


def sorted_ids(df: DataFrame, key: Sequence[str], ident: str) -> DataFrame:
    """A-29; a design's ids, of which a group has few."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(ident)).alias("ids"))


def first_examples(df: DataFrame, key: Sequence[str], order_by: str, k: int = 3) -> DataFrame:
    """A-31, X-12: the first k rows of each key; a window group limit keeps k rows of each map task."""
    w = Window.partitionBy(*key).orderBy(order_by)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def out_of_range(df: DataFrame, key: Sequence[str], value: str, low: float = 0, high: float = 10) -> DataFrame:
    """A-35."""
    bad = ((F.col(value) < low) | (F.col(value) > high)).cast("double")
    return df.groupBy(*key).agg(F.coalesce(F.avg(bad), F.lit(0.0)).alias("share"))


def swing(df: DataFrame, key: Sequence[str], column: str, a: str, b: str, value: str) -> DataFrame:
    """A-36: difference of means in units of the pooled deviation, and which is greater."""
    at = lambda f, x: f(F.when(F.col(column) == x, F.col(value)))
    out = df.groupBy(*key).agg(*[at(f, x).alias(f"{n}_{s}") for n, f in (("m", F.avg), ("v", F.var_samp), ("c", F.count)) for s, x in (("a", a), ("b", b))])
    pooled = F.sqrt(((F.col("c_a") - 1) * F.col("v_a") + (F.col("c_b") - 1) * F.col("v_b")) / F.nullif(F.col("c_a") + F.col("c_b") - 2, F.lit(0)))
    d = F.col("m_a") - F.col("m_b")
    return out.select(*key, d.alias("swing"), F.try_divide(d, pooled).alias("standardised"), F.when(F.abs("m_a") > F.abs("m_b"), a).otherwise(b).alias("bigger"))


def decomposed(df: DataFrame, key: Sequence[str], sign: str, domain: str, a: str, b: str, value: str) -> DataFrame:
    """A-37, A-38: the gap of two domains by sign, and the ratio of the two gaps (infinite over zero)."""
    at = lambda s: mean_if(value, (F.col(sign) == s) & (F.col(domain) == a)) - mean_if(value, (F.col(sign) == s) & (F.col(domain) == b))
    out = df.groupBy(*key).agg(at("bad").alias("gap_bad"), at("good").alias("gap_good"))
    return out.withColumn("ratio", F.when(F.col("gap_good") == 0, F.lit(float("inf"))).otherwise(F.try_divide("gap_bad", "gap_good")))


def demeaned(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """X-01, X-02: each column less its group's mean, and the mean; by a join with means, which combine map-side."""
    means = df.groupBy(*key).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    out = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])).join(means, list(key))
    return out.withColumns({f"{c}_dm": F.col(c) - F.col(f"{c}_mean") for c in columns})


def standardised(df: DataFrame, column: str, name: str) -> DataFrame:
    """X-03: by the population deviation over all rows; 0 if it is 0."""
    stats = df.agg(F.avg(column).alias("__m"), F.stddev_pop(column).alias("__s"))
    out = df.crossJoin(F.broadcast(stats))  # one row
    return out.withColumn(name, F.when(F.col("__s") > 0, (F.col(column) - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")


def holm(df: DataFrame, group: Sequence[str], p: str, tie: str, name: str = "p_holm") -> DataFrame:
    """X-05: step-down corrected p-values; a group is a family of tests."""
    w = Window.partitionBy(*group).orderBy(p, tie)
    raw = df.withColumn("__m", F.count("*").over(Window.partitionBy(*group))).withColumn("__x", (F.col("__m") - F.row_number().over(w) + 1) * F.col(p))
    return raw.withColumn(name, F.least(F.lit(1.0), F.max("__x").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__m", "__x")


def flips(df: DataFrame, p: str, corrected: str, alpha: float = 0.05) -> DataFrame:
    """X-06."""
    return df.withColumn("flips", (F.col(p) < alpha) != (F.col(corrected) < alpha))


def top_reduction(df: DataFrame, place: str, value: str, baseline: float | Column, k: int) -> DataFrame:
    """X-11: the k places that lower the value most against the baseline, in order of place."""
    base = F.lit(baseline) if isinstance(baseline, int | float) else baseline
    return df.withColumn("reduction", base - F.col(value)).orderBy(F.desc("reduction"), place).limit(k).orderBy(place)


def top_features(df: DataFrame, key: Sequence[str], vector: str, k: int) -> DataFrame:
    """X-13: the k elements of each vector with the greatest magnitude, found in the row."""
    ranked = F.slice(F.array_sort(F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"), x.alias("x")))), 1, k)
    return df.select(*key, F.posexplode(ranked).alias("rank", "f")).select(*key, "rank", F.col("f.i").alias("feature"), F.col("f.x").alias("value"))


def first_reaching(df: DataFrame, key: Sequence[str], value: str, least: float, order: Sequence[str]) -> DataFrame:
    """X-15: the first grid point, in order, whose value reaches the threshold."""
    return df.groupBy(*key).agg(F.min(F.when(F.col(value) >= least, F.struct(*order))).alias("at")).select(*key, *[F.col(f"at.{c}").alias(c) for c in order])


def union_all(*frames: DataFrame) -> DataFrame:
    """X-17, X-18."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged_shards(shards: DataFrame, shard: str, key: Sequence[str], expected: int, constant: Sequence[str]) -> DataFrame:
    """X-21, A-33: all rows of complete, disjoint shards that agree in metadata; else an error."""
    found = shards.agg(F.count_distinct(shard).alias("n"), *[F.count_distinct(c).alias(c) for c in constant]).first()
    if found["n"] != expected or any(found[c] > 1 for c in constant):
        raise ValueError(f"{found['n']} of {expected} shards, or shards of different runs")
    twice = repeated(shards, key).limit(1).collect()
    if twice:
        raise ValueError(f"a key in several shards: {[twice[0][k] for k in key]}")
    return shards


def longer(a: DataFrame, b: DataFrame) -> DataFrame:
    """X-22: of two copies the one with more rows, the first if they are equal."""
    return a if a.count() >= b.count() else b


def by_resource(df: DataFrame, resource: str, order_by: str) -> DataFrame:
    """X-20: rows of one resource together and in order, for engines that load it once."""
    return df.repartition(resource).sortWithinPartitions(resource, order_by)


def group_split(df: DataFrame, stratum: str, group: str, test_share: float, seed: str) -> DataFrame:
    """X-23: groups with ``part``: in each stratum round(share x groups), and not all, are test, by hash order."""
    groups = df.select(stratum, group).distinct().withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), stratum, group), 256))
    w = Window.partitionBy(stratum)
    n = F.count("*").over(w)
    k = F.least(F.bround(n * F.lit(test_share)).cast("bigint"), n - 1)
    return groups.withColumn("part", F.when(F.row_number().over(w.orderBy("h")) <= k, "test").otherwise("train")).drop("h")
