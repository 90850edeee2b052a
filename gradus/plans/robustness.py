"""Declared robustness fits: each a subset, formula, terms, cluster and seed (T-05, T-15, T-16, T-19, T-37, T-38)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..operators import aggregates, joins, profile, resampling, routing

_BOTH = ["moral", "nonmoral"]


@dataclass(frozen=True)
class Fit:
    """One fit for each model family (and each value of ``split``)."""

    name: str
    formula: str
    terms: tuple[str, ...]
    cluster: str
    seed: int
    tuning: str | None = "finetuned"
    subset: dict = field(default_factory=lambda: {"vt": _BOTH})
    split: str | None = None
    paired: bool = False


_SIGN, _NEU = "ev_rating ~ sign_c", {"valence": ["NEU"]}
FITS = [
    Fit("01 base sign x tuning", "ev_rating ~ sign_c * tuning_c", ("sign_c:tuning_c",), "family_id", 2, None),
    Fit("01 typicality x sign", "ev_rating ~ typ_c * sign_c", ("typ_c:sign_c",), "family_id", 3),
    Fit("01 evocativeness x sign", "ev_rating ~ evoc_c * sign_c", ("evoc_c:sign_c",), "family_id", 4),
    Fit("02 neutral offset", "rating_centered ~ 1", ("Intercept",), "family_id", 5, subset=_NEU),
    Fit("02 typicality in neutral", "ev_rating ~ typ_c", ("typ_c",), "family_id", 6, subset=_NEU),
    Fit("03 sign x valence type", "ev_rating ~ sign_c * vt_c", ("sign_c:vt_c",), "set_id", 1),
    Fit("04 with severity", "ev_rating ~ sign_c * vt_c + severity_c", ("sign_c:vt_c",), "set_id", 1),
    Fit("05 sign by valence type", _SIGN, ("sign_c",), "family_id", 11, split="vt"),
    Fit("07 paired, family effects", "ev_rating ~ pred_c + pred_c:sg_c + C(family_id)", ("pred_c:sg_c",), "family_id", 9, split="vt", paired=True),
    Fit("14 severity, set effects", "ev_rating ~ sign_c * vt_c + severity_c + C(set_id)", ("sign_c:vt_c",), "set_id", 1),
    Fit("16 sign and severity by valence type", "ev_rating ~ sign_c + severity_c", ("sign_c",), "family_id", 11, split="vt"),
    Fit("17 sign x severity", "ev_rating ~ sign_c * severity_c", ("sign_c:severity_c",), "set_id", 17),
    Fit("17 label and severity", "ev_rating ~ sign_c * vt_c + sign_c * severity_c", ("sign_c:vt_c",), "set_id", 18),
    Fit("18 typicality, severity", "ev_rating ~ typ_c * sign_c + severity_c", ("typ_c:sign_c",), "family_id", 3),
    Fit("19 dose response", "ev_rating ~ severity_c * sign_c", ("severity_c:sign_c",), "family_id", 19),
    Fit("22 typicality", "ev_rating ~ typ_c * sign_c", ("typ_c",), "family_id", 13),
    Fit("26 parsed ratings", "parsed_rating ~ typ_c * sign_c", ("typ_c:sign_c",), "family_id", 3),
    Fit("31 sign", _SIGN, ("sign_c",), "family_id", 20),
    Fit("32 sign by subdomain", _SIGN, ("sign_c",), "family_id", 21, subset={"vt": ["nonmoral"]}, split="nonmoral_subdomain"),
    Fit("33 sign by tuning", _SIGN, ("sign_c",), "family_id", 22, None, split="tuning_status"),
    Fit("34 pretrained, moral", _SIGN, ("sign_c",), "family_id", 23, "pretrained", {"vt": ["moral"]}),
    Fit("35 pretrained, moral, parsed", "parsed_rating ~ sign_c", ("sign_c",), "family_id", 24, "pretrained", {"vt": ["moral"]}),
]


def frame_of(prepared: DataFrame, fit: Fit) -> DataFrame:
    rows = prepared if fit.tuning is None else prepared.filter(F.col("tuning_status") == fit.tuning)
    rows = routing.subset(rows, fit.subset)
    if fit.paired:
        # Standardised over each family's and valence type's rows apart.
        keys = ["family", "vt"]
        channel = F.when(F.col("sign") == "bad", "blame").otherwise("praise")
        means = rows.filter(F.col("question") == channel).groupBy(*keys, "variant_id").agg(F.avg("ev_rating").alias("pred_raw"))
        out = rows.filter("question = 'intentionality'").join(means, [*keys, "variant_id"])
        spread = out.groupBy(*keys).agg(F.avg("pred_raw").alias("m"), F.stddev_pop("pred_raw").alias("s"))
        return out.join(spread, keys).withColumns({"pred_c": F.when(F.col("s") > 0, (F.col("pred_raw") - F.col("m")) / F.col("s")).otherwise(0.0), "sg_c": F.col("sign_c")})
    return routing.drop_nulls_of(rows.filter("question = 'intentionality'"), fit.formula)


def run(prepared: DataFrame, fit: Fit, replicates: int = 1999, least: int = 30, clusters: int = 5) -> DataFrame:
    """Mixed model and wild bootstrap of each cell; cells with too little are counted and marked (W-07)."""
    cell = ["family", *([fit.split] if fit.split else [])]
    rows = frame_of(prepared, fit)
    guard = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.count_distinct(fit.cluster).alias("n_groups")).withColumn("untestable", (F.col("n") < least) | (F.col("n_groups") < clusters))
    kept = rows.join(guard.filter("not untestable").select(*cell), cell, "left_semi")
    wild = resampling.wild_table(kept, fit.formula, fit.terms, cell, fit.cluster, fit.seed, replicates)
    out = guard.join(wild.drop("n_clusters"), cell, "left")
    if "C(" not in fit.formula:
        mixed = profile.lmm_table(kept, fit.formula, fit.terms[0], cell, fit.cluster).select(*cell, F.col("estimate").alias("lmm_estimate"), F.col("p_value").alias("lmm_p"))
        out = out.join(mixed, cell, "left")
    return out.select(F.lit(fit.name).alias("fit"), *cell, *[c for c in out.columns if c not in cell])


def load_frame(results: DataFrame, vignettes: DataFrame, curated: DataFrame) -> DataFrame:
    """J-07, J-08: results with expected ratings, items, codes and centred family severity."""
    from ..functions import scoring
    from ..functions import text as tx

    r = results.select(
        scoring.ev_unchecked("logprobs_0_10").alias("ev_rating"),
        F.when(F.col("parse_ok"), F.col("parsed_rating")).alias("parsed_rating"),
        F.split_part("prompt_id", F.lit("::"), F.lit(1)).alias("variant_id"),
        F.split_part("prompt_id", F.lit("::"), F.lit(2)).alias("question"),
        tx.model_family("model_key").alias("family"),
        tx.tuning("model_key").alias("tuning_status"),
        "model_key",
    )
    v = vignettes.select("variant_id", "family_id", "sign", "typicality", "evocativeness", "valence", "nonmoral_subdomain", routing.valence_type(F.col("valence"), "neu").alias("vt"), routing.valence_type(F.col("valence"), "neu").alias("valence_type"))
    d = routing.effect_codes(r.join(v, "variant_id")).withColumn("rating_centered", F.col("ev_rating") - 5)
    return joins.with_group_mean(d, curated, "family_id", "severity", "severity")


# ----- planning


def projected(spark, benchmarks: DataFrame, arms: Sequence[tuple[str, int]]) -> DataFrame:
    """J-33, F-28, F-29: benchmarks (beta, se, n_groups) at each arm's clusters; under three, nothing is detectable."""
    rows = benchmarks.withColumn("arm", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(g).alias("g")) for a, g in arms]))).select("*", F.col("arm.arm").alias("arm_name"), F.col("arm.g").alias("projected_g")).drop("arm")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run_(batches):
        for pdf in batches:
            ok = pdf["projected_g"] >= 3
            pdf["projected_se"] = [dist.projected_se(s, g, n) if k else None for s, g, n, k in zip(pdf["se"], pdf["n_groups"], pdf["projected_g"], ok, strict=True)]
            pdf["projected_mde"] = [dist.minimum_detectable(s, n) if k else None for s, n, k in zip(pdf["projected_se"], pdf["projected_g"], ok, strict=True)]
            pdf["detectable"] = [bool(k and abs(b) >= m) for b, m, k in zip(pdf["beta"], pdf["projected_mde"], ok, strict=True)]
            yield pdf

    return rows.mapInPandas(run_, fields + ", projected_se double, projected_mde double, detectable boolean")


def equivalence(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """J-34, F-29: bound, detectable effect and clusters needed of (beta, se, n_groups, p_wild, benchmark); no verdict where the test is significant."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run_(batches):
        for pdf in batches:
            pdf["equivalence_bound"] = [dist.equivalence_bound(b, s, g, alpha) for b, s, g in zip(pdf["beta"], pdf["se"], pdf["n_groups"], strict=True)]
            pdf["mde"] = [dist.minimum_detectable(s, g) for s, g in zip(pdf["se"], pdf["n_groups"], strict=True)]
            pdf["bound_below_benchmark"] = [None if p < alpha else bool(e < abs(x)) for p, e, x in zip(pdf["p_wild"], pdf["equivalence_bound"], pdf["benchmark"], strict=True)]
            pdf["clusters_for_benchmark"] = [dist.required_clusters(s, g, abs(x)) for s, g, x in zip(pdf["se"], pdf["n_groups"], pdf["benchmark"], strict=True)]
            yield pdf

    return rows.mapInPandas(run_, fields + ", equivalence_bound double, mde double, bound_below_benchmark boolean, clusters_for_benchmark int")


def study_cost(designs: DataFrame, ratings_per_item: int, per_participant: int, hourly: float, seconds_per_rating: float, overhead_minutes: float, fee: float) -> DataFrame:
    """F-26: ratings, participants, minutes for each and cost of designs with ``pairs`` items."""
    total = F.col("pairs") * ratings_per_item
    people = F.ceil(total / per_participant)
    hours = total * seconds_per_rating / 3600 + people * overhead_minutes / 60
    return designs.withColumns({"total_ratings": total, "n_participants": people, "minutes_each": F.bround(hours / people * 60, 1), "total": hours * hourly * (1 + fee)})


def swing_by_family(metrics: DataFrame, key: Sequence[str]) -> DataFrame:
    """J-35: blame and praise rows of one cell side by side."""
    a = metrics.filter("question = 'blame'").select(*key, F.col("beta").alias("blame"))
    return a.join(metrics.filter("question = 'praise'").select(*key, F.col("beta").alias("praise")), list(key)).withColumn("bigger", F.when(F.abs("blame") > F.abs("praise"), "blame").otherwise("praise"))


def corrected(tables: Sequence[DataFrame], group: Sequence[str], p: str, tie: str) -> DataFrame:
    """Tables of tests as one, with p-values corrected in each group and what that changes."""
    return aggregates.flips(aggregates.holm(aggregates.union_all(*tables), group, p, tie), p, "p_holm")
