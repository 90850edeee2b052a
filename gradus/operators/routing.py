"""Filters, gates and first-match routing (W-) and projections (P-)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.schemas import LETTERS, NONMORAL, SIGNS, SUBDOMAINS, VALENCES, mapped

EXAMPLES = 20

# The frames that texts are put into.
SCENARIO = "{agent} {action} to {goal}. {agent} did not care at all about the effect this would have on {affected}. {agent} knew that this would {verb}: {outcome}."
INTENTIONALITY = "Did {agent} intentionally {verb}? Answer on a scale from 0 (not at all intentionally) to 10 (completely intentionally)."
WORTHY = "How {what} is {agent} for this, on a scale from 0 (not at all) to 10 (extremely)?"
FRAME = "Read carefully the following scenario and then answer the question with a number from 0 to 10.\n\nScenario: {scenario}\n\nQuestion: {question}\nAnswer:"
CODES = {
    "sign_c": ("sign", {"bad": 0.5, "good": -0.5}),
    "tuning_c": ("tuning_status", {"finetuned": 0.5, "pretrained": -0.5}),
    "vt_c": ("valence_type", {"moral": 0.5, "nonmoral": -0.5}),
    "typ_c": ("typicality", {"uncommon": 0.5, "common": -0.5}),
    "evoc_c": ("evocativeness", {"high": 0.5, "low": -0.5}),
}


def fill(template: str, **values: Column) -> Column:
    """A template with {names} as one concatenation."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def route(df: DataFrame, reasons: Sequence[tuple[str, Column]], name: str = "drop_reason") -> DataFrame:
    """W-01: the first reason whose condition holds (null counts as not), or null for rows that stay."""
    chain = reduce(lambda acc, r: acc.when(r[1], r[0]), reasons[1:], F.when(reasons[0][1], reasons[0][0]))
    return df.withColumn(name, chain)


def ledger(routed: DataFrame, key: str, reason: str = "drop_reason", examples: int = EXAMPLES) -> DataFrame:
    """W-01, A-30: (reason, count, examples) of excluded rows, with the least keys as examples.

    Counts combine map-side.  The least keys are found by ranks over salted
    parts first, so that a reason with most of the rows is not one task.
    """
    out = routed.filter(F.col(reason).isNotNull()).select(F.col(reason).alias("reason"), F.col(key).cast("string").alias("k"))
    counts = out.groupBy("reason").agg(F.count("*").cast("bigint").alias("count"))
    salted = out.distinct().withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(64)))
    first = salted.withColumn("rn", F.row_number().over(Window.partitionBy("reason", "salt").orderBy("k"))).filter(F.col("rn") <= examples)
    best = first.withColumn("rn", F.row_number().over(Window.partitionBy("reason").orderBy("k"))).filter(F.col("rn") <= examples)
    lists = best.groupBy("reason").agg(F.array_sort(F.collect_list("k")).alias("examples"))
    return counts.join(lists, "reason").select("reason", "count", "examples")


def reconcile(routed: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """One row: n_read, n_included, n_excluded."""
    return routed.agg(F.count("*").alias("n_read"), F.count_if(F.col(reason).isNull()).alias("n_included"), F.count_if(F.col(reason).isNotNull()).alias("n_excluded"))


def subset(df: DataFrame, allowed: dict[str, Sequence[object]]) -> DataFrame:
    """W-02, W-15: rows whose columns have allowed values; pushed down to the scan."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]).isin(list(kv[1]))), allowed.items(), df)


def drop_nulls_of(df: DataFrame, formula: str) -> DataFrame:
    """W-03: rows without nulls or NaN in columns that the formula names."""
    import re

    named = set(re.findall(r"[A-Za-z_]\w*", formula)) & set(df.columns)
    keep = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).isNotNull() for c in sorted(named)]
    return df.filter(reduce(lambda a, b: a & b, keep, F.lit(True)))


def shard(df: DataFrame, ordinal: str, index: int, of: int) -> DataFrame:
    """W-05: rows of one of ``of`` shards by an ordinal."""
    if not 0 <= index < of:
        raise ValueError(f"shard {index} of {of}")
    return df.filter(F.pmod(F.col(ordinal), F.lit(of)) == index)


def select_prompts(df: DataFrame, ordinal: str, index: int, of: int, limit: int | None = None) -> DataFrame:
    """W-04, X-16: raw intentionality prompts, then the shard, then a limit in order."""
    out = shard(df.filter((F.col("format") == "raw") & (F.col("question_type") == "intentionality")), ordinal, index, of)
    return out.orderBy(ordinal).limit(limit) if limit is not None else out


def construct_mask(construct: str, valence: str = "valence", rating: str = "rating") -> Column:
    """W-06: all rows, those with a sign, or those with a rating."""
    return {"all": F.lit(True), "valenced": F.col(valence) != "NEU", "rated": F.col(rating).isNotNull()}[construct]


def testable(df: DataFrame, cell: Sequence[str], cluster: str, level: str, least: int = 30, clusters: int = 5) -> DataFrame:
    """W-07: counts of each cell and whether it has enough rows, clusters and levels for a test."""
    out = df.groupBy(*cell).agg(F.count("*").alias("n"), F.count_distinct(cluster).alias("n_clusters"), F.count_distinct(level).alias("n_levels"))
    return out.withColumn("status", F.when((F.col("n") < least) | (F.col("n_clusters") < clusters) | (F.col("n_levels") < 2), "untestable").otherwise("testable"))


def passes(category: Column, value: Column, least: dict[str, float], most: dict[str, float]) -> Column:
    """W-08: value within the category's bounds; null is not."""
    low, high = mapped(least, category) if least else F.lit(None), mapped(most, category) if most else F.lit(None)
    return F.coalesce(F.when(low.isNotNull(), value >= low).when(high.isNotNull(), value <= high), F.lit(False))


def keep_pairs(df: DataFrame, pair: Sequence[str], sign: str, passed: str) -> DataFrame:
    """W-09: both members of pairs whose bad member passed."""
    w = Window.partitionBy(*pair)
    return df.withColumn("__ok", F.max(F.when(F.col(sign) == "bad", F.col(passed).cast("int"))).over(w)).filter("__ok = 1").drop("__ok")


def family_violations(df: DataFrame) -> DataFrame:
    """W-10, F-17: (family_id, severity, message) of every broken authoring rule."""
    required = ["family_id", "domain", "valence", "agent", "goal", "common_action", "uncommon_action", "affected_entity", "low_evocative_outcome", "high_evocative_outcome", "outcome_verb"]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    same = lambda a, b: F.lower(F.trim(F.coalesce(a, F.lit("")))) == F.lower(F.trim(F.coalesce(b, F.lit(""))))
    valid = F.col("valence").isin(VALENCES)
    low, high = "low_evocative_outcome", "high_evocative_outcome"
    checks = [("error", F.when(blank(c), F.lit(f"missing {c}"))) for c in required]
    checks.append(("error", F.when(~F.coalesce(valid, F.lit(False)), F.lit("invalid valence"))))
    later = [
        ("error", F.when(F.col("valence").isin(NONMORAL) & blank("nonmoral_subdomain"), F.lit("subdomain is required"))),
        ("error", F.when(F.col("valence").isin(NONMORAL) & ~blank("nonmoral_subdomain") & ~F.col("nonmoral_subdomain").isin(SUBDOMAINS), F.lit("unknown subdomain"))),
        *[("error", F.when(F.size(tx.banned_hits(c)) > 0, F.concat(F.lit(f"banned words in {c}: "), F.array_join(tx.banned_hits(c), ", ")))) for c in (low, high, "outcome_verb")],
        ("error", F.when(~blank(low) & ~blank(high) & same(F.col(low), F.col(high)), F.lit("outcomes are identical"))),
        ("warning", F.when(~blank(low) & ~blank(high) & ~same(F.col(low), F.col(high)) & (tx.overlap(low, high) < 2), F.lit("outcomes share few words"))),
        ("error", F.when(same(F.col("common_action"), F.col("uncommon_action")), F.lit("actions are identical"))),
        *[("error", F.when(tx.starts_with_to(c), F.lit(f"{c} starts with to"))) for c in ("goal", "common_action", "uncommon_action")],
        ("error", F.when(tx.starts_with_article("outcome_verb"), F.lit("outcome_verb starts with an article"))),
        ("error", F.when(~blank("agent") & ~tx.names_agent("agent"), F.lit("agent is neither a role nor a name"))),
    ]
    # What follows an invalid valence is not checked.
    checks += [(s, F.when(valid, c)) for s, c in later]
    found = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(s).alias("severity"), c.alias("message"))) for s, c in checks]))
    return df.select("family_id", F.explode(found).alias("v")).select("family_id", "v.severity", "v.message")


def set_violations(df: DataFrame, set_key: str, domain: str, number: str, scaffold: str) -> DataFrame:
    """W-11: sets that lack five rows with all valences once, one domain or one scaffold, and gaps in numbers."""
    one = df.groupBy(set_key).agg(F.count("*").alias("n"), F.count_distinct("valence").alias("v"), F.count_distinct(domain).alias("d"), F.count_distinct(scaffold).alias("s"))
    bad = one.select(
        F.col(set_key).cast("string").alias("set_key"),
        F.explode(F.array_compact(F.array(F.when((F.col("n") != len(VALENCES)) | (F.col("v") != len(VALENCES)), "valences"), F.when(F.col("d") != 1, "domain"), F.when(F.col("s") != 1, "scaffold")))).alias("message"),
    )
    numbers = df.groupBy(domain).agg(F.max(number).alias("top"), F.count_distinct(number).alias("n")).filter("top <> n")
    return bad.unionAll(numbers.select(F.col(domain).cast("string"), F.lit("numbers are not consecutive")))


def category_flag(moral_min: float = 6, nonmoral_max: float = 4) -> Column:
    """W-12: text for an item whose moral relevance is on the wrong side, or null."""
    v, m = F.col("valence"), F.col("moral_relevance")
    return F.when(v.isin("MB", "MG") & (m < moral_min), F.concat(F.lit("category_manipulation: "), m.cast("string"), F.lit(" is too low"))).when(
        v.isin("NMB", "NMG", "NEU") & (m > nonmoral_max), F.concat(F.lit("category_manipulation: "), m.cast("string"), F.lit(" is too high"))
    )


def scaffold_leaks(df: DataFrame, scaffold: str, typicality: str, sentence: str, agent: str) -> DataFrame:
    """W-13: (check, key) of scaffolds with several sentences or agents, and storylines under several scaffolds."""
    several = df.groupBy(scaffold, typicality).agg(F.count_distinct(sentence).alias("n")).filter("n > 1").select(F.lit("sentences").alias("check"), F.col(scaffold).alias("key"))
    agents = df.groupBy(scaffold).agg(F.count_distinct(agent).alias("n")).filter("n > 1").select(F.lit("agents"), F.col(scaffold))
    story = df.groupBy(scaffold).agg(F.array_join(F.array_sort(F.collect_set(sentence)), "\n").alias("story"))
    shared = story.groupBy("story").agg(F.count("*").alias("n"), F.min(scaffold).alias("s")).filter("n > 1").select(F.lit("storylines"), "s")
    return several.unionAll(agents).unionAll(shared).distinct()


def reviewer_conflicts(reviewers: DataFrame, subjects: DataFrame, a: str, b: str) -> DataFrame:
    """W-14: pairs of which one name holds the other; both sides are short registries."""
    x, y = F.lower(F.col(a)), F.lower(F.col(b))
    return reviewers.select(a).distinct().join(subjects.select(b).distinct(), F.contains(x, y) | F.contains(y, x))


def large_baseline(base: Column, least: float = 0.25) -> Column:
    """W-16."""
    return F.abs(base) >= least


def effect_codes(df: DataFrame, rating: str = "rating") -> DataFrame:
    """P-04, P-09: +-0.5 codes (other values are null), the rating less the midpoint, and the set."""
    coded = {name: mapped(codes, F.col(source)) for name, (source, codes) in CODES.items() if source in df.columns}
    if rating in df.columns:
        coded["rating_centered"] = F.col(rating).cast("double") - 5
    if "family_id" in df.columns:
        coded["set_id"] = tx.strip_token("family_id", VALENCES)
    return df.withColumns(coded)


def sign_codes(df: DataFrame) -> DataFrame:
    """P-05: +1 and -1 for bad and good, null otherwise."""
    return df.withColumn("sign_pm", F.when(F.col("sign") == "bad", 1).when(F.col("sign") == "good", -1))


def valence_type(valence: Column, neutral: str = "neutral") -> Column:
    """P-06: the label of the third type differs between tables."""
    return F.when(valence.isin("MB", "MG"), "moral").when(valence.isin(NONMORAL), "nonmoral").otherwise(neutral)


def build_variants(families: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P-01, J-23: four variants of each family, with scenario and questions, and the family's columns ``keep``.

    Spark takes them for as many rows as the families are and broadcasts millions
    of texts, so their joins are hinted to sort and merge.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("typicality"), F.lit(e).alias("evocativeness"), F.lit(x).alias("letter")) for (t, e), x in LETTERS.items()])).alias("cell")
    v = families.select("*", cells)
    agent = tx.decapitalise("agent")
    return v.select(
        F.concat_ws("-", "family_id", "cell.letter").alias("variant_id"),
        "family_id",
        "domain",
        "valence",
        F.coalesce("nonmoral_subdomain", F.lit("")).alias("nonmoral_subdomain"),
        mapped(SIGNS, F.col("valence")).alias("sign"),
        "cell.typicality",
        "cell.evocativeness",
        fill(
            SCENARIO,
            agent=F.col("agent"),
            action=F.when(F.col("cell.typicality") == "common", F.col("common_action")).otherwise(F.col("uncommon_action")),
            goal=F.col("goal"),
            affected=F.col("affected_entity"),
            verb=F.col("outcome_verb"),
            outcome=F.when(F.col("cell.evocativeness") == "low", F.col("low_evocative_outcome")).otherwise(F.col("high_evocative_outcome")),
        ).alias("scenario"),
        fill(INTENTIONALITY, agent=agent, verb=F.col("outcome_verb")).alias("q_intentionality"),
        fill(WORTHY, what=F.lit("blameworthy"), agent=agent).alias("q_blame"),
        fill(WORTHY, what=F.lit("praiseworthy"), agent=agent).alias("q_praise"),
        *keep,
    ).hint("merge")


def render_prompts(variants: DataFrame, questions: Sequence[str] = ("intentionality", "blame", "praise"), formats: Sequence[str] = ("raw", "chat"), keep: Sequence[str] = ()) -> DataFrame:
    """P-02, J-21: a prompt for each variant, question and format, with the variant's columns ``keep``; hashes are of the text, or of the messages' JSON."""
    from ..functions.seeds import canonical_json_hash, text_hash

    if unknown := set(formats) - {"raw", "chat"}:
        raise ValueError(f"unknown formats: {sorted(unknown)}")
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("question_type"), F.col(f"q_{q}").alias("question")) for q in questions])).alias("q")
    rows = variants.select("variant_id", "scenario", *keep, asked).select("*", F.explode(F.array(*[F.lit(f) for f in formats])).alias("format"))
    rows = rows.withColumn("text", fill(FRAME, scenario=F.col("scenario"), question=F.col("q.question")))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    out = rows.select(
        F.concat_ws("::", "variant_id", "q.question_type", "format").alias("prompt_id"),
        "variant_id",
        F.col("q.question_type").alias("question_type"),
        "format",
        "text",
        F.when(F.col("format") == "chat", messages).alias("messages"),
        *keep,
    )
    if "chat" not in formats:
        return out.withColumn("sha256", text_hash("text"))
    return out.withColumn("sha256", F.when(F.col("format") == "chat", canonical_json_hash(F.to_json("messages"))).otherwise(text_hash("text")))


def apply_patch(table: DataFrame, patch: DataFrame, key: str, fields: Sequence[str], approval: str = "human_approved") -> tuple[DataFrame, DataFrame, DataFrame]:
    """P-11: (patched table, rows of the patch whose old value differs, rows of the patch with unknown keys).

    A patched row loses its approval.
    """
    wide = patch.groupBy(key).pivot("field", list(fields)).agg(F.max("new_value"))
    wide = wide.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = table.join(wide, key, "left")
    touched = reduce(lambda a, b: a | b, [F.col(f"__{f}").isNotNull() for f in fields])
    new = {f: F.coalesce(f"__{f}", f) for f in fields}
    if approval in table.columns:
        new[approval] = F.when(touched, F.lit(False)).otherwise(F.col(approval))
    patched = joined.withColumns(new).select(*table.columns)
    long = table.select(key, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "now"))
    differs = patch.join(long, [key, "field"]).filter(~F.col("old_value").eqNullSafe(F.col("now")))
    return patched, differs, patch.join(table.select(key), key, "left_anti")
