"""Releases, approvals, reviews, status and reports (G-)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, joins
from ..sources import schemas
from ..sources.files import with_provenance
from ..sources.storage import Store


def approved(families: DataFrame) -> DataFrame:
    """G-04: approved families only; a table without the column has none."""
    return with_provenance(families, approved_if_missing=False).filter(F.coalesce("human_approved", F.lit(False)))


def file_hashes(spark, paths: Sequence[str]) -> DataFrame:
    """G-05: (file, sha256, bytes) of whole files, each hashed in a task; a file is held while it is hashed."""
    found = spark.read.format("binaryFile").load(list(paths))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def check_manifest(spark, paths: Sequence[str], manifest: DataFrame | dict[str, str]) -> None:
    """G-05: an error if a file of the manifest is missing or is not what it says."""
    if isinstance(manifest, dict):
        manifest = spark.createDataFrame(list(manifest.items()) or [], "file string, sha256 string")
    said, found = manifest.select("file", F.col("sha256").alias("said")), file_hashes(spark, paths)
    wrong = said.join(found, "file", "left").filter(~F.col("said").eqNullSafe(F.col("sha256")))
    names = [r.file for r in wrong.orderBy("file").limit(5).collect()]
    if names:
        raise ValueError(f"files that differ from the manifest: {', '.join(names)}")


def release(variants: DataFrame, curated: DataFrame, path: str, force: bool = False, families: DataFrame | None = None, name: str = "", changelog: str = "", rows_per_file: int = 1_000_000) -> dict:
    """G-03, J-17: items that pass the gates, with a manifest, in a new place; returns what the manifest sums up.

    Gates: every family is approved (where ``families`` is given) and every item
    has an accepted rating; ``force`` releases all the same, without naming the
    gate.  Items are written beside ``path``, every file is hashed and counted in
    the plan, the manifest is written, and a rename commits all of it, so a
    reader finds a whole release or none.  A place that is taken is an error.
    Files hold at most ``rows_per_file`` rows.
    """
    spark = variants.sparkSession
    store = Store(spark, path)
    if store.exists(path):
        raise FileExistsError(path)
    gates = []
    if families is not None:
        n = families.join(approved(families).select("family_id"), "family_id", "left_anti").count()
        if n and not force:
            raise ValueError(f"{n} families without approval")
        gates += [] if n else ["approved"]
    lacking = variants.join(curated.filter("accepted").select("variant_id"), "variant_id", "left_anti")
    n = lacking.count()
    if n and not force:
        raise ValueError(f"{n} items without an accepted rating")
    gates += [] if n else ["accepted"]
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    variants.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{stage}/items")
    items = spark.read.parquet(f"{stage}/items")
    rows = items.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    hashes = file_hashes(spark, [f"{stage}/items"]).join(rows, "file", "left").na.fill(0, ["rows"])
    hashes.write.json(f"{stage}/manifest/files")
    counts = {r["valence"]: (r["n"], r["n_distinct"]) for r in aggregates.labelled_counts(items, ["valence"], "family_id").collect()}
    about = {"release": name, "changelog": changelog, "rows": items.count(), "counts": counts, "gates_passed": gates}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{stage}/manifest/about")
    store.commit(stage, path)
    return about


def manifest_of(spark, path: str) -> tuple[dict, DataFrame]:
    """What a release says of itself, and of its files: (file, sha256, bytes, rows)."""
    store = Store(spark, path)
    if not store.exists(f"{path}/manifest/about"):
        raise ValueError(f"no manifest in {path}")
    about = json.loads(spark.read.text(f"{path}/manifest/about").first()[0])
    return about, spark.read.schema("file string, sha256 string, bytes bigint, rows bigint").json(f"{path}/manifest/files")


def read_release(spark, path: str, name: str | None = None) -> DataFrame:
    """G-05: the items of a release, after all files are found to be those of its manifest and the release that of ``name``."""
    about, said = manifest_of(spark, path)
    if name is not None and about["release"] != name:
        raise ValueError(f"{path} is release {about['release']!r}, not {name!r}")
    check_manifest(spark, [f"{path}/items"], said)
    return spark.read.parquet(f"{path}/items")


def approve(families: DataFrame, ids: DataFrame, key: str = "family_id") -> tuple[DataFrame, DataFrame]:
    """G-06: (families with those of ids approved, ids that are unknown)."""
    marked = joins.in_split(with_provenance(families, False), ids, key, "__up")
    done = marked.withColumn("human_approved", F.col("__up") | F.coalesce("human_approved", F.lit(False))).drop("__up")
    return done, ids.join(families.select(key), key, "left_anti")


def reviewed(curated: DataFrame, mode: str) -> DataFrame:
    """G-07: accept all rows, accept those without flags, or reject those with flags."""
    flagged = F.concat(F.coalesce("individual_flags", F.lit("")), F.coalesce("pair_flag", F.lit(""))) != ""
    new: Column = {"accept_all": F.lit(True), "accept_unflagged": F.when(~flagged, True).otherwise(F.col("accepted")), "reject_flagged": F.when(flagged, False).otherwise(F.col("accepted"))}[mode]
    return curated.withColumn("accepted", new)


def status(families: DataFrame, domains: DataFrame, valences: Sequence[str]) -> DataFrame:
    """G-08: domains by valence with zeros."""
    grid = aggregates.complete_grid(families, "domain", "valence", valences)
    return domains.select("domain").distinct().join(grid, "domain", "left").na.fill(0)


def dashboard(families: DataFrame) -> DataFrame:
    """G-08: (section, domain, name, n), the whole state of a matrix of families.

    total: all families.  grid: families by domain and valence, zeros included.
    sets: different set numbers of a domain.  approved, pending: families by
    nonmoral subdomain over all domains, zeros included; steer: the rarest of
    the approved if the commonest has over twice its count.  backlog: each
    family not approved.  agents: sets whose agent is a role ("The ...") or a
    name; an agent counts once for each set.  repeated: agents of several sets
    of a domain.  A null domain is "?", a null approval is none; families
    without a set number are one set.  Domains of whole sections are blank.
    """
    f = families.withColumns({"domain": F.coalesce("domain", F.lit("?")), "__set": set_number("family_id"), "__ok": F.coalesce("human_approved", F.lit(False))})
    names = [("grid", v, F.col("valence") == v) for v in schemas.VALENCES]
    names += [(part, x, (F.col("nonmoral_subdomain") == x) & ok) for part, ok in (("approved", F.col("__ok")), ("pending", ~F.col("__ok"))) for x in schemas.SUBDOMAINS]
    counts = f.groupBy("domain").agg(F.count("*").alias("all"), F.count_distinct("__set").alias("sets"), *[F.count_if(test).alias(f"{part}_{x}") for part, x, test in names])
    row = lambda part, name, n: F.struct(F.lit(part).alias("section"), F.lit(name).alias("name"), F.col(n).alias("n"))
    cells = [row("total", "families", "all"), row("sets", "sets", "sets"), *[row(part, x, f"{part}_{x}") for part, x, _ in names]]
    long = counts.select("domain", F.explode(F.array(*cells)).alias("r")).select("r.section", "domain", "r.name", "r.n")
    # A matrix without families has totals of zero.
    zeros = families.sparkSession.createDataFrame([("total", "families"), *[(p, x) for p, x, _ in names if p != "grid"]], "section string, name string")
    sums = long.filter("section in ('total', 'approved', 'pending')").groupBy("section", "name").agg(F.sum("n").alias("n"))
    whole = zeros.join(sums, ["section", "name"], "left").select("section", F.lit("").alias("domain"), "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    order = F.array_position(F.array(*map(F.lit, schemas.SUBDOMAINS)), F.col("name"))
    tally = whole.filter("section = 'approved'").withColumn("at", order)
    steer = tally.agg(F.when(F.max("n") > 2 * F.min("n"), F.min_by(F.struct("name", "n"), F.struct("n", "at"))).alias("r")).filter("r is not null")
    backlog = f.filter(~F.col("__ok")).select(F.lit("backlog").alias("section"), "domain", F.col("family_id").alias("name"), F.lit(1).cast("bigint").alias("n"))
    agent = F.coalesce("agent", F.lit(""))
    used = f.select("domain", "__set", agent.alias("name")).distinct().groupBy("domain", "name").agg(F.count("*").alias("n"))
    kind = F.when(F.col("name").startswith("The "), "role").when(F.col("name") != "", "name")
    kinds = used.groupBy(kind.alias("name")).agg(F.sum("n").alias("n")).filter("name is not null")
    parts = [
        long.filter("section in ('grid', 'sets')"),
        whole,
        steer.select(F.lit("steer").alias("section"), F.lit("").alias("domain"), "r.name", "r.n"),
        backlog,
        kinds.select(F.lit("agents").alias("section"), F.lit("").alias("domain"), "name", "n"),
        used.filter("n > 1").select(F.lit("repeated").alias("section"), "domain", "name", "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _filled(template: str, **slots: Column) -> Column:
    """The template with its named slots filled from columns; nulls are blank."""
    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [F.coalesce(slots[slot].cast("string"), F.lit(""))] if slot is not None else []
    return F.concat(*parts) if parts else F.lit("")


def set_number(family_id: str) -> Column:
    """The number at the end of an id, before a suffix of a revision (``-r2``); null without one."""
    return F.regexp_extract(family_id, r"(\d+)(?:-r\d+)?$", 1).try_cast("int")


def next_prompts(
    families: DataFrame,
    domains: DataFrame,
    template: str,
    order_by: str,
    steering: str = "\n\nRequired: nonmoral families of this set use the subdomain {target} ({tally}).",
    most: int = 5,
    allow_extra: bool = False,
) -> DataFrame:
    """G-09: (domain, n_sets, set_number, at_cap, prompt), what asks for the next set of each domain.

    Slots of the template are domain, set_number and tracking_log, which lists
    the sets of a domain by number: first agent, goal and subdomain that isn't
    blank, in the order of ``order_by``.  The steering line follows if, of all
    approved families, the commonest subdomain has over twice the rarest's.
    Domains with ``most`` sets are at the cap and have no prompt, unless
    ``allow_extra``; so only a few sets are gathered for a domain.  Families
    without a number count for the tally alone; a domain without families
    begins with set 1.
    """
    numbered = families.withColumn("__set", set_number("family_id")).filter("__set is not null")
    sets = aggregates.set_summary(numbered, ["domain", "__set"], ["agent", "goal"], ["nonmoral_subdomain"], order_by)
    counts = sets.groupBy("domain").agg(F.count("*").alias("n_sets"), F.max("__set").alias("top"))
    counts = domains.select("domain").distinct().join(counts, "domain", "left").na.fill(0, ["n_sets", "top"])
    counts = counts.withColumn("at_cap", F.col("n_sets") >= most)
    # Fixed format of a line.
    note = F.coalesce(F.concat(F.lit(" [subdomain: "), "nonmoral_subdomain", F.lit("]")), F.lit(""))
    line = F.format_string('  - Set %02d: agent = "%s"; goal = "%s"%s', "__set", F.coalesce("agent", F.lit("")), F.coalesce("goal", F.lit("")), note)
    wanted = counts if allow_extra else counts.filter(~F.col("at_cap"))
    open_sets = sets.join(wanted.select("domain"), "domain", "left_semi")
    log = open_sets.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("__set", line.alias("line")))).alias("lines"))
    log = log.select("domain", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("log"))
    names = schemas.SUBDOMAINS
    tally = families.filter("human_approved").agg(*[F.count_if(F.col("nonmoral_subdomain") == x).alias(x) for x in names])
    least, commonest = F.least(*names), F.greatest(*names)
    target = F.coalesce(*[F.when((commonest > 2 * least) & (F.col(x) == least), F.lit(x)) for x in names])
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{x}="), F.col(x).cast("string")) for x in names])
    steer = tally.select(target.alias("target"), F.when(target.isNotNull(), _filled(steering, target=target, tally=text)).alias("steer"))
    out = counts.join(log, "domain", "left").crossJoin(F.broadcast(steer))  # one row
    number = F.col("top") + 1
    asks = _filled(template, domain=F.col("domain"), set_number=F.format_string("%02d", number), tracking_log=F.coalesce("log", F.lit("(none yet)")))
    prompt = F.concat(asks, F.coalesce("steer", F.lit("")))
    return out.select("domain", "n_sets", number.alias("set_number"), "at_cap", (prompt if allow_extra else F.when(~F.col("at_cap"), prompt)).alias("prompt"))


def qa_prompt_lines(families: DataFrame, template: str, columns: Sequence[str], order_by: str) -> DataFrame:
    """G-09: (domain, part, at, line), the text that asks for a review of each domain's whole matrix.

    Part 0 is the template before its slot matrix_csv, with domain, n_sets and
    n_families filled, 1 the header, 2 a row for each family in the order
    ``at`` (else 0), 3 the template after the slot.  Lines stay rows, so a domain of any
    size is never gathered; sorted by part and at they are the prompt.  Nulls
    are blank, booleans True and False; cells with commas, quotes or line
    breaks are quoted.
    """
    before, _, after = template.partition("{matrix_csv}")
    sizes = families.groupBy("domain").agg(F.count_distinct(set_number("family_id")).alias("n_sets"), F.count("*").alias("n_families"))
    slots = {c: F.col(c) for c in ("domain", "n_sets", "n_families")}
    fixed = [(0, _filled(before, **slots)), (1, F.lit(",".join(columns))), (3, _filled(after, **slots))]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(0).cast("bigint").alias("at"), x.alias("line")) for i, x in fixed]))

    def cell(c: str) -> Column:
        flag = families.schema[c].dataType.simpleString() == "boolean"
        x = F.coalesce(F.initcap(F.col(c).cast("string")) if flag else F.col(c).cast("string"), F.lit(""))
        return F.when(F.regexp_like(x, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    lines = families.select("domain", F.lit(2).alias("part"), F.col(order_by).cast("bigint").alias("at"), F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))
    return sizes.select("domain", rows.alias("r")).select("domain", "r.*").unionByName(lines)


def registry_pairs(models: DataFrame) -> DataFrame:
    """G-10: families without both a pretrained and a finetuned checkpoint; core ones are errors."""
    out = models.groupBy("model_family").agg(F.count_distinct("tuning_status").alias("n"), F.max(F.col("core").cast("int")).alias("core")).filter("n < 2")
    return out.select("model_family", F.when(F.col("core") == 1, "error").otherwise("warning").alias("severity"))


def summary_lines(results: DataFrame, tests: DataFrame) -> DataFrame:
    """G-11: (section, topic, part, at, line), a report of an analysis; sorted by these it is the text.

    Section 1 says how many result rows were read, included and excluded, and
    lists reasons (``drop_reason``, null for those included) by name.  Section
    2 has a table for each ``rq`` of ``tests``, by contrast and model family; a
    table without tests says so.  Lines are made where the rows are; numbers
    have fixed decimals, nulls are "-".
    """
    reasons = results.groupBy("drop_reason").agg(F.count("*").alias("n"))
    whole = reasons.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("drop_reason").isNull(), F.col("n"))), F.lit(0)).alias("kept"))

    def lines(df: DataFrame, section: int, topic: Column, part: int, at: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), topic.alias("topic"), F.lit(part).alias("part"), at.alias("at"), line.alias("line"))

    blank = F.lit("")
    number = lambda c, digits: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f"%.{digits}f", c))
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    said = F.format_string("Of %d result rows read, %d were included and %d excluded.", "n", "kept", F.col("n") - F.col("kept"))
    excluded = reasons.filter("drop_reason is not null")
    topics = tests.select("rq").distinct()
    head = F.lit("| contrast | model_family | estimate | p | p(Holm) | confirmed |")
    cells = row("contrast", "model_family", number("estimate", 3), number("p_value", 4), number("p_holm", 4), F.coalesce(F.col("confirmed").cast("string"), F.lit("-")))
    none = tests.agg(F.count("*").alias("n")).filter("n = 0")
    parts = [
        lines(whole, 1, blank, 0, blank, said),
        lines(excluded, 1, blank, 1, F.col("drop_reason"), row("drop_reason", F.col("n").cast("string"))),
        lines(none, 2, blank, 0, blank, F.lit("No contrast could be estimated.")),
        lines(topics, 2, F.col("rq"), 0, blank, F.concat(F.lit("### "), "rq")),
        lines(topics, 2, F.col("rq"), 1, blank, head),
        lines(tests, 2, F.col("rq"), 2, F.concat_ws("/", "contrast", "model_family"), cells),
    ]
    return reduce(DataFrame.unionByName, parts)


def summary_markdown(table: DataFrame, title: str, columns: Sequence[str], order_by: Sequence[str]) -> str:
    """G-11, G-13: a report table of one row for each test or grid point."""
    rows = table.select(*columns).orderBy(*order_by).collect()
    shown = lambda x: "" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x)
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(shown(x) for x in r) + " |" for r in rows]) + "\n"


def assembled_curation(vignettes: DataFrame, raw: DataFrame, fields: Sequence[str], key: str = "variant_id") -> DataFrame:
    """J-19: items with a rating for each field, and text that names missing and unreadable ones."""
    last = joins.last_row(raw, [key, "field"], "timestamp")
    wide = last.groupBy(key).agg(*[x for f in fields for x in (F.max(F.when((F.col("field") == f) & F.col("ok"), F.col("value"))).alias(f), F.max(F.when(F.col("field") == f, F.col("raw"))).alias(f"{f}_raw"))])
    out = vignettes.join(wide, key, "left")
    notes = [F.when(F.col(f"{f}_raw").isNull(), F.lit(f"missing: {f}")).when(F.col(f).isNull(), F.lit(f"unparseable: {f}")) for f in fields]
    return out.withColumn("individual_flags", F.concat_ws("; ", *notes))
