"""Joins (J-): dimensions, resumption, expansion, pairs, reconciliation.

Dimensions are joined without a hint: their sizes decide, by the session's
broadcast threshold and by what the adaptive planner measures.  Items of
families bring their own (``routing.build_variants``), as Spark misjudges them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seeds
from ..functions.scoring import ev_unchecked
from ..functions.text import split_key
from .routing import route, valence_type


def last_row(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """X-08: of rows with one key the last."""
    return _ranked_row(df, key, F.col(order_by).desc())


def first_row(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """X-07: of rows with one key the first."""
    return _ranked_row(df, key, F.col(order_by).asc())


def _ranked_row(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def ingest(results: DataFrame, vignettes: DataFrame, registry: DataFrame, curated: DataFrame | None = None, fallback_models: Sequence[str] = (), accepted_only: bool = False, exclude_flagged: bool = False) -> DataFrame:
    """J-01, W-01, P-03: results with their items, and ``drop_reason`` by the first rule that excludes them.

    Dimension keys are unique (take ``last_row`` first where they are not).
    ``curated`` may be the table ``vignettes`` itself, which is then joined once,
    so that each item keeps its own ratings.  Results are scored before the join
    and log probabilities go no further; those without an item's id meet none,
    each under a key of its own, so that they don't gather in one task.
    """
    falls = F.col("model_key").isin(list(fallback_models)) if fallback_models else F.lit(False)
    r = results.withColumn("__parts", split_key("prompt_id"))
    r = r.select(
        "job_id",
        "prompt_id",
        "model_key",
        F.coalesce(F.element_at("__parts", 1), F.concat(F.lit("\0"), F.coalesce("job_id", F.lit("")))).alias("__key"),
        F.element_at("__parts", 1).alias("variant_id"),
        F.element_at("__parts", 2).alias("question_type"),
        F.element_at("__parts", 3).alias("format"),
        F.when(falls, ev_unchecked("logprobs_0_10")).otherwise(F.col("parsed_rating")).alias("__score"),
        (falls & F.col("logprobs_0_10").isNull()).alias("__silent"),
        (~falls & (~F.coalesce("parse_ok", F.lit(False)) | F.col("parsed_rating").isNull())).alias("__unread"),
    )
    ratings = ["moral_relevance", "severity", "vividness", "typicality_perception"]
    flagged = (F.concat(F.coalesce("individual_flags", F.lit("")), F.coalesce("pair_flag", F.lit(""))) != "").alias("__flagged")
    own = ["accepted", flagged, *ratings]
    v = vignettes.select(F.col("variant_id").alias("__key"), "family_id", "valence", "sign", "typicality", "evocativeness", "domain", "nonmoral_subdomain", F.lit(True).alias("__item"), *(own if curated is vignettes else []))
    # A registry has a row for each model.
    j = r.join(F.broadcast(registry.select("model_key", "model_family", "tuning_status")), "model_key", "left").join(v, "__key", "left")
    if curated is None:
        j = j.withColumns({"accepted": F.lit(None).cast("boolean"), "__flagged": F.lit(False), **{c: F.lit(None).cast("int") for c in ratings}})
    elif curated is not vignettes:
        j = j.join(curated.select(F.col("variant_id").alias("__key"), *own), "__key", "left")
    reasons = [
        ("malformed_prompt_id", F.col("variant_id").isNull()),
        ("cancel_format_filtered", F.col("format") == "cancel"),
        ("unknown_model_key", F.col("model_family").isNull()),
        ("unknown_variant", F.col("__item").isNull()),
        ("variant_not_accepted", ~F.coalesce("accepted", F.lit(False)) & F.lit(accepted_only)),
        ("variant_flagged_excluded", F.coalesce("__flagged", F.lit(False)) & F.lit(exclude_flagged)),
        ("logprobs_missing", F.col("__silent")),
        ("parse_failure", F.col("__unread")),
    ]
    out = route(j, reasons)
    out = out.withColumn("rating", F.when(F.col("drop_reason").isNull(), F.col("__score")))
    out = out.withColumn("score_source", F.when(falls, "logit_ev").otherwise("parsed")).withColumn("valence_type", valence_type(F.col("valence")))
    columns = "job_id prompt_id variant_id question_type format model_key model_family tuning_status family_id valence valence_type sign typicality evocativeness domain nonmoral_subdomain rating score_source".split()
    return out.select(*columns, *ratings, "drop_reason")


def join_required(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """J-03, J-11: an inner join that keeps every left row; one without a match is an error when read."""
    there = right.withColumn("__there", F.lit(True))
    told = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    out = left.join(there, list(key), "left")
    return out.filter(F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no match for "), told)).cast("boolean")).otherwise(F.lit(True))).drop("__there")


def inner(left: DataFrame, right: DataFrame, key: Sequence[str], *filters: Column) -> DataFrame:
    """J-02, J-04, J-07, J-13: filters first, then the join; misses go silently."""
    return reduce(lambda d, f: d.filter(f), filters, left).join(right, list(key))


def to_baseline(df: DataFrame, group: Sequence[str], config: str, base: str, value: str) -> DataFrame:
    """J-05: each row with the value of its group's baseline row, without a self-join."""
    w = Window.partitionBy(*group)
    return df.withColumn("baseline", F.max(F.when(F.col(config) == base, F.col(value))).over(w))


def paired_channel(df: DataFrame, item: str, rating: str, question: str, sign: str, by: Sequence[str] = ()) -> DataFrame:
    """J-06, T-11: intentionality rows with their item's mean on the channel of their sign, standardised over rows; both in each cell of ``by``."""
    beside = lambda rows, cells: rows.join(F.broadcast(cells), list(by)) if by else rows.crossJoin(F.broadcast(cells))  # a row for each cell
    channel, rated = F.col(question) == F.when(F.col(sign) == "bad", "blame").otherwise("praise"), F.col(question) == "intentionality"
    # One row for each item: its channel's mean, and the rows that the spread over rows counts it for.
    items = df.groupBy(*by, item).agg(F.avg(F.when(channel, F.col(rating))).alias("pred_raw"), F.count(F.when(channel, 1)).alias("__c"), F.count(F.when(rated, 1)).alias("__n")).filter("__c > 0 and __n > 0")
    mean = items.groupBy(*by).agg((F.sum(F.col("__n") * F.col("pred_raw")) / F.sum(F.when(F.col("pred_raw").isNotNull(), F.col("__n")))).alias("__m"))
    known = beside(items, mean)
    off = F.col("pred_raw") - F.col("__m")
    stats = known.groupBy(*by).agg(F.first("__m").alias("__m"), F.sqrt(F.sum(F.col("__n") * off * off) / F.sum(F.when(F.col("pred_raw").isNotNull(), F.col("__n")))).alias("__s"))
    out = beside(df.filter(rated).join(items.select(*by, item, "pred_raw"), [*by, item]), stats)
    scaled = F.when(F.col("__s") > 0, (F.col("pred_raw") - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return out.withColumn("pred_c", scaled).withColumn("sg_c", F.when(F.col(sign) == "bad", 0.5).when(F.col(sign) == "good", -0.5)).drop("__m", "__s")


def with_group_mean(df: DataFrame, dimension: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """J-08, X-04: the group's mean, and it less the unweighted mean of groups' means."""
    means = dimension.groupBy(key).agg(F.avg(value).alias(name))
    grand = means.agg(F.avg(name).alias("__g"))
    return df.join(means.crossJoin(F.broadcast(grand)), key, "left").withColumn(f"{name}_c", F.col(name) - F.col("__g")).drop("__g")


def with_column_of(df: DataFrame, dimension: DataFrame, key: Sequence[str], column: str, order_by: str) -> DataFrame:
    """J-09, J-10: one column of the dimension's first row for each key."""
    return df.join(first_row(dimension, key, order_by).select(*key, column), list(key), "left")


def pivot_join(base: DataFrame, ratings: DataFrame, key: str, field: str, value: str, fields: Sequence[str], order_by: str) -> DataFrame:
    """J-12, J-19, A-05: first value of each field, wide, joined to the base."""
    wide = ratings.groupBy(key).pivot(field, list(fields)).agg(F.min_by(value, order_by))
    return base.join(wide, key, "left")


def remaining(jobs: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """J-14, J-15, J-17, R-01: jobs without a result; unknown and repeated results do no harm."""
    return jobs.join(done.select(*key), list(key), "left_anti")


def pilot_jobs(prompts: DataFrame, models: Sequence[str], samples: int, done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J-32: (job_id, prompt_id, model_key, sample_idx, turn), jobs without a result, to be run model by model.

    turn orders the models by their first job that is left, jobs being in the
    order of prompt, model as given, and sample.  Unknown, repeated and null ids
    of results do no harm; a model that is named twice has its jobs once.
    Prompts that share an id are told apart by the columns ``by``, which results
    then have too.
    """
    known = list(dict.fromkeys(models))
    jobs = prompts.select("prompt_id", *by).distinct().select("prompt_id", *by, F.posexplode(F.array(*[F.lit(m) for m in known])).alias("at", "model_key"))
    jobs = jobs.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx"))
    jobs = jobs.withColumn("job_id", F.concat_ws("::", "prompt_id", "model_key", F.col("sample_idx").cast("string")))
    left = remaining(jobs, done, ["job_id", *by])
    first = left.groupBy("model_key").agg(F.min(F.struct("prompt_id", "at")).alias("first"))
    # A row for each model.
    turns = first.agg(F.array_sort(F.collect_list(F.struct("first", "model_key"))).alias("m")).select(F.posexplode(F.col("m.model_key")).alias("turn", "model_key"))
    return left.join(F.broadcast(turns), "model_key").select("job_id", "prompt_id", "model_key", "sample_idx", (F.col("turn") + 1).alias("turn"))


def in_split(df: DataFrame, ids: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """J-18: rows whose key occurs in ids, or a flag that says so."""
    known = ids.select(key).distinct()
    if name is None:
        return df.join(known, key, "left_semi")
    return df.join(known.withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def carry_forward(now: DataFrame, before: DataFrame, key: str, same: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """J-20: values of the earlier row where all rating columns are equal, nulls included."""
    b = before.select(key, *[F.col(c).alias(f"__{c}") for c in [*same, *carried]], F.lit(True).alias("__b"))
    equal = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same], F.col("__b").isNotNull())
    out = now.join(b, key, "left")
    return out.withColumns({c: F.when(equal, F.col(f"__{c}")).otherwise(F.col(c)) for c in carried}).select(*now.columns)


def build_jobs(prompts: DataFrame, models: Sequence[str], samples: int, release: str) -> DataFrame:
    """J-22, J-32, F-07: prompts x models x samples with derived seeds, made in the row without a join."""
    rows = prompts.select("prompt_id", F.posexplode(F.array(*[F.lit(m) for m in models])).alias("model_at", "model_key"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample_idx"))
    d = seeds.derive(F.lit(release), "prompt_id", "model_key", "sample_idx")
    return rows.withColumn("d", d).select(F.concat_ws("::", "prompt_id", "model_key", F.col("sample_idx").cast("string")).alias("job_id"), "prompt_id", "model_key", "sample_idx", "d.temperature", "d.seed")


def grid(spark, **axes: Sequence[object]) -> DataFrame:
    """J-24, J-33: all combinations of the axes, of which each has a few values."""
    out = spark.range(1)
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def unordered_pairs(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """J-25: pairs i < j of a small group's rows (constructs, layers)."""
    a = df.select(*by, *[F.col(c).alias(f"{c}_a") for c in [order, *columns]])
    b = df.select(*by, *[F.col(c).alias(f"{c}_b") for c in [order, *columns]])
    return a.join(b, list(by)).filter(F.col(f"{order}_a") < F.col(f"{order}_b")) if by else a.join(b, F.col(f"{order}_a") < F.col(f"{order}_b"))


def matched_pairs(df: DataFrame, key: Sequence[str], level: str, low: str, high: str, values: Sequence[str], order_by: str) -> DataFrame:
    """J-26: a key's low and high row side by side; the last of each level; keys without both go."""
    row = F.struct(*values)
    out = df.groupBy(*key).agg(F.max_by(F.when(F.col(level) == low, row), F.when(F.col(level) == low, F.col(order_by))).alias("low"), F.max_by(F.when(F.col(level) == high, row), F.when(F.col(level) == high, F.col(order_by))).alias("high"))
    return out.filter("low is not null and high is not null").select(*key, *[F.col(f"{s}.{v}").alias(f"{v}_{s}") for s in ("low", "high") for v in values])


def _prefixes(df: DataFrame, by: Sequence[str], keep: Sequence[str], text: str, least: float, counts: DataFrame) -> DataFrame:
    """(by, keep, words, n, prefix): a text's tokens from the rarest on, and those of which two similar texts share one.

    Texts above a similarity ``least`` have at least least * n of n tokens in
    common, so they share one of any n - ceil(least * n) + 1 of a text's tokens;
    the rarest are taken, and common words meet nothing.
    """
    words = _words(df, [*by, *keep], text)
    seen = words.join(counts, [*by, "w"]).groupBy(*by, *keep).agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("x"))
    seen = seen.select(*by, *keep, F.transform("x", lambda e: e["w"]).alias("words"), F.size("x").alias("n"))
    # A hair less than the product, which may be rounded up past a whole number.
    return seen.withColumn("prefix", F.slice("words", F.lit(1), (F.col("n") - F.greatest(F.ceil(F.col("n") * least - 1e-9), F.lit(1)) + 1).cast("int")))


def _words(df: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    from ..functions.text import tokens

    return df.select(*keep, F.explode(tokens(text, [])).alias("w"))


def _like(a: DataFrame, b: DataFrame, by: Sequence[str], least: float, which: Column | None = None) -> DataFrame:
    """Pairs of rows of ``_prefixes`` (columns of b end in _b) with a similarity above least."""
    b = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    x, y = a.withColumn("w", F.explode("prefix")), b.withColumn("w_b", F.explode("prefix_b"))
    on = (F.col("w") == F.col("w_b")) & (F.col("n_b") >= F.col("n") * least - 1e-9) & (F.col("n") >= F.col("n_b") * least - 1e-9)
    for c in by:
        on = on & (F.col(c) == F.col(f"{c}_b"))
    # A pair that meets by several tokens counts where it does first.
    met = x.join(y, on if which is None else on & which).filter(F.element_at(F.array_intersect("prefix", "prefix_b"), 1) == F.col("w"))
    common = F.size(F.array_intersect("words", "words_b"))
    return met.withColumn("similarity", common / (F.col("n") + F.col("n_b") - common)).filter(F.col("similarity") > least)


def similar_goals(new: DataFrame, old: DataFrame, domain: str, goal: str, least: float = 0.6) -> DataFrame:
    """J-27: new goals too like earlier ones of their domain, a row for each new row and different earlier goal.

    Goals meet by their rarest tokens in the domain; equal ones are compared once.
    """
    sides = [df.select(F.col(domain).alias("__d"), F.col(goal).alias("__g")).distinct() for df in (new, old)]
    both = sides[0].unionAll(sides[1]).distinct()
    counts = _words(both, ["__d", "__g"], "__g").groupBy("__d", "w").agg(F.count("*").alias("k"))
    a, b = (_prefixes(s, ["__d"], ["__g"], "__g", least, counts) for s in sides)
    pairs = _like(a, b, ["__d"], least).select(F.col("__d").alias(domain), F.col("__g").alias("new_goal"), F.col("__g_b").alias("old_goal"), "similarity")
    return new.select(domain, F.col(goal).alias("new_goal")).join(pairs, [domain, "new_goal"])


def token_pairs(df: DataFrame, order: str, text: str, least: float) -> DataFrame:
    """J-25, J-27: pairs a < b with a token Jaccard similarity above ``least`` (0 or more), met through their rarest common tokens.

    Texts are tokenised once; pairs without a common token are never made.
    """
    counts = _words(df, [order], text).groupBy("w").agg(F.count("*").alias("k"))
    rows = _prefixes(df, [], [order], text, least, counts)
    return _like(rows, rows, [], least, F.col(order) < F.col(f"{order}_b")).select(F.col(order).alias(f"{order}_a"), f"{order}_b", "similarity")


def reconcile_tables(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """J-28, X-19: (status, key columns) for ids of one side only and rows that differ in shared columns."""
    shared = [c for c in a.columns if c in b.columns and c not in key]
    x = a.select(*key, F.struct(*[F.col(c) for c in shared] or [F.lit(1)]).alias("__x"), F.lit(True).alias("__a"))
    y = b.select(*key, F.struct(*[F.col(c) for c in shared] or [F.lit(1)]).alias("__y"), F.lit(True).alias("__b"))
    j = x.join(y, list(key), "full")
    status = F.when(F.col("__b").isNull(), "left_only").when(F.col("__a").isNull(), "right_only").when(~F.col("__x").eqNullSafe(F.col("__y")), "differs").otherwise("equal")
    return j.select(*key, status.alias("status"))


def clause_levels(items: DataFrame, scenario: str, levels: Sequence[str], clause: str, other: str, selected: DataFrame, key: str) -> DataFrame:
    """J-29, P-10: items x levels with rewritten texts, and whether the item was selected before; items are joined before they are repeated."""
    from ..functions.text import rewrite_level

    rows = in_split(items, selected, key, "selected").withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return rows.select(*items.columns, "level", rewrite_level(scenario, "level", clause, other).alias("rendered"), "selected")


def flatten_pairs(df: DataFrame, nested: str) -> DataFrame:
    """J-30: condition -> pair -> sign maps as rows."""
    out = df.select(F.explode(nested).alias("condition", "pairs")).select("condition", F.explode("pairs").alias("pair_id", "signs"))
    return out.select("condition", "pair_id", F.explode("signs").alias("sign", "text"))


def conditional_questions(items: DataFrame, condition: str, control: str, first: str, second: str) -> DataFrame:
    """J-31: one question for all items, another for those outside the control condition."""
    return items.withColumn("question", F.explode(F.array_compact(F.array(F.lit(first), F.when(F.col(condition) != control, F.lit(second))))))


def storyline_pairs(df: DataFrame, set_key: str, valence: str, value: str, a: str, b: str, within: float = 1.0) -> DataFrame:
    """J-37: sets with both valences: means, their difference, and whether it is small."""
    wide = df.groupBy(set_key).agg(F.avg(F.when(F.col(valence) == a, F.col(value))).alias("a"), F.avg(F.when(F.col(valence) == b, F.col(value))).alias("b"))
    return wide.filter("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b")).withColumn("close", F.abs("diff") <= within)


def benchmark_rows(rows: DataFrame, is_interaction: Column, key: Sequence[str], value: str) -> DataFrame:
    """J-34, J-35, J-36: interaction rows with the other arm's value of their cell."""
    other = rows.filter(~is_interaction).select(*key, F.col(value).alias("benchmark"))
    return rows.filter(is_interaction).join(other, list(key))
