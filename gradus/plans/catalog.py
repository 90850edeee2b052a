"""Queries over the driver's tables, by name, with the SQL that gives the same rows.

Each applies library operators; doubles are rounded, as sums in another order
differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, seeds
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import joins, routing, stats, vectors

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame) -> DataFrame:
    """All doubles to six places."""
    return df.select(*[F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def _routed(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_discount")
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    j = lines.join(parts, lines.l_partkey == parts.p_partkey, "left").join(orders, lines.l_orderkey == orders.o_orderkey, "left")
    j = j.withColumn("key", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    reasons = [
        ("unknown_part", F.col("p_partkey").isNull()),
        ("unknown_order", F.col("o_orderkey").isNull()),
        ("small_part", F.col("p_size") < 5),
        ("open_order", F.col("o_orderstatus") == "P"),
        ("no_discount", F.col("l_discount") == 0),
    ]
    return routing.route(j, reasons)


_ROUTED = """
j AS (
  SELECT l.*, p.p_brand, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key,
    CASE WHEN p.p_partkey IS NULL THEN 'unknown_part' WHEN o.o_orderkey IS NULL THEN 'unknown_order' WHEN p.p_size < 5 THEN 'small_part'
      WHEN o.o_orderstatus = 'P' THEN 'open_order' WHEN l.l_discount = 0 THEN 'no_discount' END AS drop_reason
  FROM lineitem l LEFT JOIN part p ON l_partkey = p_partkey LEFT JOIN orders o ON l_orderkey = o_orderkey)
"""


@query(f"WITH {_ROUTED} SELECT p_brand, round(avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) - avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 6) AS gap, count(*) AS n FROM j WHERE drop_reason IS NULL GROUP BY 1")
def routed_gap(spark: SparkSession, d: str) -> DataFrame:
    """W-01, A-19: lines joined to parts and orders, routed, and the gap of two flags in each brand."""
    kept = _routed(spark, d).filter("drop_reason is null")
    return r6(kept.groupBy("p_brand").agg(ag.gap("l_extendedprice", "l_returnflag", "R", "A").alias("gap"), F.count("*").alias("n")))


flagship = routed_gap


@query(f"WITH {_ROUTED}, c AS (SELECT drop_reason, count(*) AS count FROM j WHERE drop_reason IS NOT NULL GROUP BY 1), x AS (SELECT drop_reason, key, row_number() OVER (PARTITION BY drop_reason ORDER BY key) AS rn FROM (SELECT DISTINCT drop_reason, key FROM j WHERE drop_reason IS NOT NULL)) SELECT drop_reason AS reason, any_value(count) AS count, string_agg(key, ',' ORDER BY key) FILTER (rn <= 20) AS examples FROM x JOIN c USING (drop_reason) GROUP BY 1")
def route_ledger(spark: SparkSession, d: str) -> DataFrame:
    """W-01, A-30."""
    return routing.ledger(_routed(spark, d), "key").withColumn("examples", F.array_join("examples", ","))


@query(f"WITH {_ROUTED} SELECT count(*) AS n_read, count(*) FILTER (drop_reason IS NULL) AS n_included, count(*) FILTER (drop_reason IS NOT NULL) AS n_excluded FROM j")
def route_reconciles(spark: SparkSession, d: str) -> DataFrame:
    return routing.reconcile(_routed(spark, d))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def resume_diff(spark: SparkSession, d: str) -> DataFrame:
    """J-14: orders without a returned line."""
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.remaining(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 1")
def shard_partition(spark: SparkSession, d: str) -> DataFrame:
    """W-05."""
    return routing.shard(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1, 4)


@query("SELECT count(*) AS n_missing FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def done_counts(spark: SparkSession, d: str) -> DataFrame:
    """J-16."""
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.remaining(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"]).agg(F.count("*").alias("n_missing"))


_MODELS = ["alpha-instruct", "alpha-pretrained", "beta-instruct"]


@query(
    "SELECT job_id, prompt_id, model_key, CAST(i AS INTEGER) AS sample_idx, round(0.85 + 0.30 * (CAST(('0x' || substr(h, 1, 16))::UHUGEINT AS DOUBLE) / 18446744073709551616.0), 12) AS temperature, CAST(('0x' || substr(h, 25, 8))::BIGINT & 2147483647 AS BIGINT) AS seed "
    "FROM (SELECT p || '::' || m || '::' || i AS job_id, p AS prompt_id, m AS model_key, i, sha256('v1|' || p || '|' || m || '|' || i) AS h FROM (SELECT p_partkey || '::blame::raw' AS p FROM part), (SELECT unnest(['alpha-instruct', 'alpha-pretrained', 'beta-instruct']) AS m), (SELECT unnest(range(3)) AS i))"
)
def manifest_expand(spark: SparkSession, d: str) -> DataFrame:
    """J-22, F-07, F-08: jobs of all parts, models and samples, with derived seeds."""
    prompts = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("::blame::raw")).alias("prompt_id"))
    return joins.build_jobs(prompts, _MODELS, 3, "v1").withColumn("temperature", F.round("temperature", 12))


@query("SELECT p_partkey, CAST(('0x' || substr(sha256('7|' || p_partkey || '|' || p_brand), 57, 8))::BIGINT AS BIGINT) AS seed FROM part")
def derive_seeds(spark: SparkSession, d: str) -> DataFrame:
    """F-08."""
    return table(spark, d, "part").select("p_partkey", seeds.u32(F.lit("7"), "p_partkey", "p_brand").alias("seed"))


@query("SELECT d.doc_id, l.quality, CASE WHEN l.quality = 1 THEN true ELSE false END AS accepted, EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND x.toxic = 1) AS toxic_known FROM documents d LEFT JOIN labels l USING (doc_id) WHERE EXISTS (SELECT 1 FROM labels y WHERE y.doc_id = d.doc_id)")
def accepted_gate(spark: SparkSession, d: str) -> DataFrame:
    """J-18."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    semi = joins.in_split(docs, labels, "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    flagged = joins.in_split(semi, labels.filter("toxic = 1"), "doc_id", "toxic_known")
    return flagged.select("doc_id", "quality", (F.coalesce("quality", F.lit(0)) == 1).alias("accepted"), "toxic_known")


@query(r"SELECT conv_id, turn, TRY_CAST(nullif(regexp_extract(text, '\b(10|[0-9])\b', 1), '') AS INTEGER) AS rating FROM conversations")
def rating_parse(spark: SparkSession, d: str) -> DataFrame:
    """F-01."""
    return table(spark, d, "conversations").select("conv_id", "turn", tx.parse_rating("text").alias("rating"))


_EV = "list_sum(list_transform(w, lambda x, i: x * (i - 1))) / list_sum(w)"


@query(f"SELECT vec_id, round({_EV}, 6) AS ev FROM (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS w FROM (SELECT vec_id, list_transform(embedding[1:11], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))")
def softmax_ev(spark: SparkSession, d: str) -> DataFrame:
    """F-05, F-30: the first eleven elements as log probabilities."""
    return r6(table(spark, d, "embeddings").select("vec_id", scoring.ev_safe(F.slice("embedding", 1, 11)).alias("ev")))


@query(
    rf"SELECT conv_id, turn, round(coalesce(p, CASE WHEN conv_id % 2 = 0 THEN ev END), 6) AS rating, CASE WHEN p IS NOT NULL THEN 'regex' WHEN conv_id % 2 = 0 AND ev IS NOT NULL THEN 'logit_ev' ELSE 'none' END AS method FROM (SELECT c.conv_id, c.turn, CAST(TRY_CAST(nullif(regexp_extract(text, '\b(10|[0-9])\b', 1), '') AS INTEGER) AS DOUBLE) AS p, {_EV} AS ev FROM conversations c LEFT JOIN (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS w FROM (SELECT vec_id, list_transform(embedding[1:11], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)) ON vec_id = conv_id)"
)
def rating_fallback(spark: SparkSession, d: str) -> DataFrame:
    """F-04, F-05."""
    c, e = table(spark, d, "conversations"), table(spark, d, "embeddings").select(F.col("vec_id").alias("conv_id"), F.slice("embedding", 1, 11).cast("array<double>").alias("lp"))
    x = c.join(e, "conv_id", "left").withColumn("r", scoring.with_fallback("text", "lp", F.pmod("conv_id", F.lit(2)) == 1))
    return r6(x.select("conv_id", "turn", "r.rating", "r.method"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def text_hash(spark: SparkSession, d: str) -> DataFrame:
    """F-09."""
    return table(spark, d, "documents").select("doc_id", seeds.text_hash("text").alias("sha256"))


@query("SELECT text_sha, count(*) AS n FROM (SELECT sha256(text) AS text_sha FROM documents) GROUP BY 1 HAVING count(*) > 1")
def dup_text(spark: SparkSession, d: str) -> DataFrame:
    """A-33."""
    return ag.repeated(table(spark, d, "documents").select(seeds.text_hash("text").alias("text_sha")), ["text_sha"])


_BANNED_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(tx.BANNED)) + "]"


@query(rf"SELECT doc_id, array_to_string(list_filter({_BANNED_SQL}, lambda b: len(list_filter(w, lambda x: starts_with(x, b))) > 0), ',') AS hits FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '\w+')) AS w FROM documents)")
def banned_scan(spark: SparkSession, d: str) -> DataFrame:
    """F-15."""
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.banned_hits("text"), ",").alias("hits"))


_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


@query(rf"SELECT d.doc_id, b.item_id, CAST(len(list_intersect(d.w, b.w)) AS INTEGER) AS overlap FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: NOT list_contains({_STOP_SQL}, x)) AS w FROM documents) d JOIN (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: NOT list_contains({_STOP_SQL}, x)) AS w FROM benchmark) b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """F-16."""
    items = table(spark, d, "benchmark")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("a"), F.pmod("doc_id", F.lit(items.count())).alias("item_id"))
    return docs.join(items.select("item_id", F.col("text").alias("b")), "item_id").select("doc_id", "item_id", tx.overlap("a", "b").alias("overlap"))


@query(
    r"SELECT conv_id, turn, CASE WHEN t = '' THEN 'A blank' WHEN regexp_matches(t, '^(_|\\_)|^[_\\\s\-.*\[\]()X]+$') THEN 'B fill-in blank' "
    r"WHEN regexp_matches(t, '(?i)read carefully|scenario:|question:|answer with a number|please (answer|select)|your answer|(a|the) number from|insert') THEN 'C restates instruction' "
    r"WHEN regexp_matches(t, '(?i)^\**\s*(explanation|here''?s|here is|let''?s|the answer|reasoning|analysis|rationale|i would|i''d)') THEN 'D starts explaining' "
    r"WHEN regexp_matches(t, '(?i)^(yes|no)\b') THEN 'E yes/no' WHEN regexp_matches(t, '\d') THEN 'F digit, unparsed' ELSE 'G other prose' END AS category "
    r"FROM (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)"
)
def failure_category(spark: SparkSession, d: str) -> DataFrame:
    """F-21."""
    return table(spark, d, "conversations").select("conv_id", "turn", tx.failure_category("text").alias("category"))


@query(r"WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT a.item_id AS item_id_a, b.item_id AS item_id_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.1")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """J-25: pairs of benchmark items with similar words."""
    return r6(joins.token_pairs(table(spark, d, "benchmark"), "item_id", "text", 0.1))


@query("SELECT p_partkey, CASE WHEN len(string_split(p_type, ' ')) = 3 THEN string_split(p_type, ' ')[1] END AS first_part, regexp_replace(p_brand || '-MB-' || p_size, '-(MB|MG|NMB|NMG|NEU)-', '-') AS set_id, CAST(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS INTEGER) AS number FROM part".replace("\\\\d", "\\d"))
def key_split(spark: SparkSession, d: str) -> DataFrame:
    """F-10, F-11."""
    p = table(spark, d, "part")
    made = F.concat_ws("-", "p_brand", F.lit("MB"), F.col("p_size").cast("string"))
    return p.select("p_partkey", F.element_at(tx.split_key("p_type", 3, " "), 1).alias("first_part"), tx.strip_token(made, routing.VALENCES).alias("set_id"), tx.trailing_number("p_brand").alias("number"))


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mean, round(coalesce(1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 0), 6) AS half_width, count(l_quantity) AS n, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1")
def item_stats_ci(spark: SparkSession, d: str) -> DataFrame:
    """A-01."""
    return r6(ag.item_means(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", ["l_returnflag"]))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice), 6) AS sd, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2")
def cell_means(spark: SparkSession, d: str) -> DataFrame:
    """A-02."""
    return r6(ag.cell_means(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query("SELECT l_suppkey, round(avg(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN l_quantity END) - avg(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN l_quantity END), 6) AS gap_O, round(avg(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN l_quantity END) - avg(CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN l_quantity END), 6) AS gap_F FROM lineitem GROUP BY 1")
def pivot_gap(spark: SparkSession, d: str) -> DataFrame:
    """A-03."""
    return r6(ag.pivoted_gaps(table(spark, d, "lineitem"), ["l_suppkey"], "l_linestatus", ["O", "F"], "l_returnflag", "l_quantity", "R", "A"))


@query("SELECT l_linestatus, round(avg(g), 6) AS gap, count(g) AS n_strata FROM (SELECT l_linestatus, l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) - avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS g FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def within_stratum_gap(spark: SparkSession, d: str) -> DataFrame:
    """A-20."""
    return r6(ag.stratum_gap(table(spark, d, "lineitem"), ["l_linestatus"], "l_suppkey", "l_returnflag", "l_extendedprice", "R", "A"))


@query("SELECT user_id, round(a, 6) AS value_low, round(b, 6) AS value_high FROM (SELECT user_id, arg_max(CASE WHEN event_type = 'click' THEN value END, CASE WHEN event_type = 'click' THEN event_id END) AS a, arg_max(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'purchase' THEN event_id END) AS b FROM events GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL")
def matched_pair(spark: SparkSession, d: str) -> DataFrame:
    """J-26, X-08: a user's last click and last purchase."""
    return r6(joins.matched_pairs(table(spark, d, "events"), ["user_id"], "event_type", "click", "purchase", ["value"], "event_id"))


@query("SELECT n_nationkey, CAST(count(s_suppkey) AS BIGINT) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def tally_complete(spark: SparkSession, d: str) -> DataFrame:
    """A-13."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return ag.complete_tally(table(spark, d, "nation"), s, "n_nationkey")


@query("SELECT p_brand, count(*) FILTER (p_size BETWEEN 1 AND 9) AS small, count(*) FILTER (p_size >= 40) AS large, count(*) FILTER (p_size BETWEEN 10 AND 39) AS mid FROM part GROUP BY 1")
def grid(spark: SparkSession, d: str) -> DataFrame:
    """A-14."""
    p = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 40, "mid").otherwise("large").alias("size"))
    return ag.complete_grid(p, "p_brand", "size", ["small", "mid", "large"])


@query("SELECT CASE WHEN max(n) > 2 * min(n) THEN arg_min(o_orderstatus, (n, o_orderstatus)) END AS rarest FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def rarest(spark: SparkSession, d: str) -> DataFrame:
    """A-18."""
    c = ag.group_sizes(table(spark, d, "orders"), ["o_orderstatus"])
    return ag.rarest(c, "o_orderstatus", "n", "o_orderstatus")


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1")
def labelled_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-11, A-12."""
    return ag.labelled_counts(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) >= 10")
def diversity(spark: SparkSession, d: str) -> DataFrame:
    """A-17."""
    return ag.repeated(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], 10)


@query("SELECT quality, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS n_true, round_even(sum(toxic) / count(*), 4) AS rate FROM labels GROUP BY 1")
def parse_rate(spark: SparkSession, d: str) -> DataFrame:
    """A-07, A-08."""
    return ag.counts_and_rate(table(spark, d, "labels"), ["quality"], "toxic")


@query("SELECT l_returnflag, count(*) AS n, round(CASE WHEN count(*) >= 30 AND stddev_samp(l_quantity) > 0 AND stddev_samp(l_discount) > 0 THEN corr(l_quantity, l_discount) END, 6) AS r, round(avg(abs(l_quantity - l_discount)), 6) AS mad FROM lineitem GROUP BY 1")
def corr_guard(spark: SparkSession, d: str) -> DataFrame:
    """A-09, A-10."""
    return r6(ag.guarded_corr(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", 30))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.025), 6) AS p025, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS p975 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """A-24, A-32."""
    return r6(ag.spread(table(spark, d, "events"), ["event_type"], "value"))


@query("SELECT event_id, round(value - m, 10) AS value_dm, round(m, 10) AS value_mean FROM events JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) USING (user_id)")
def demean(spark: SparkSession, d: str) -> DataFrame:
    """X-01, X-02."""
    out = ag.demeaned(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], ["value"])
    # Means of a power of two of rows end in a tie at six places.
    return out.select("event_id", F.round("value_dm", 10).alias("value_dm"), F.round("value_mean", 10).alias("value_mean"))


@query("SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z FROM events")
def standardise(spark: SparkSession, d: str) -> DataFrame:
    """X-03."""
    return r6(ag.standardised(table(spark, d, "events").select("event_id", "value"), "value", "z").select("event_id", "z"))


@query("SELECT round(corr(l_quantity, m), 6) AS r FROM lineitem JOIN (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_suppkey)")
def group_mean_corr(spark: SparkSession, d: str) -> DataFrame:
    """X-02."""
    out = ag.demeaned(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], ["l_quantity"])
    return r6(out.agg(F.corr("l_quantity", "l_quantity_mean").alias("r")))


@query("WITH t AS (SELECT c_nationkey, c_mktsegment, round(abs(sin(sum(c_acctbal))), 9) / 5 AS p FROM customer GROUP BY 1, 2), x AS (SELECT *, (count(*) OVER (PARTITION BY c_nationkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_mktsegment) + 1) * p AS v FROM t) SELECT c_nationkey, c_mktsegment, round(p, 6) AS p, round(least(1.0, max(v) OVER (PARTITION BY c_nationkey ORDER BY p, c_mktsegment ROWS UNBOUNDED PRECEDING)), 6) AS p_holm, (p < 0.05) <> (least(1.0, max(v) OVER (PARTITION BY c_nationkey ORDER BY p, c_mktsegment ROWS UNBOUNDED PRECEDING)) < 0.05) AS flips FROM x")
def holm(spark: SparkSession, d: str) -> DataFrame:
    """X-05, X-06: over p-values from an expression."""
    t = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg((F.round(F.abs(F.sin(F.sum("c_acctbal"))), 9) / 5).alias("p"))
    return r6(ag.flips(ag.holm(t, ["c_nationkey"], "p", "c_mktsegment"), "p", "p_holm"))


@query("SELECT l_suppkey, round(m, 6) AS m, round(30 - m, 6) AS reduction FROM (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ORDER BY 30 - m DESC, l_suppkey LIMIT 10")
def topk_reduction(spark: SparkSession, d: str) -> DataFrame:
    """X-11."""
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m"))
    return r6(ag.top_reduction(m, "l_suppkey", "m", 30.0, 10))


@query("SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS rn FROM customer) WHERE rn <= 3")
def topk_group(spark: SparkSession, d: str) -> DataFrame:
    """A-31, X-12."""
    return ag.first_examples(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", 3)


@query("SELECT label, arg_max(vec_id, (CAST(embedding[1] AS DOUBLE), -vec_id)) AS place, round(max(CAST(embedding[1] AS DOUBLE)), 6) AS value FROM embeddings GROUP BY 1")
def peak_row(spark: SparkSession, d: str) -> DataFrame:
    """A-28."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return r6(ag.peak(e, ["label"], "x", "vec_id"))


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'left_only' WHEN a.o_orderkey IS NULL THEN 'right_only' WHEN a.s IS DISTINCT FROM b.s THEN 'differs' ELSE 'equal' END AS status FROM (SELECT o_orderkey, o_orderstatus AS s FROM orders) a FULL JOIN (SELECT o_orderkey + 50 AS o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders) b ON a.o_orderkey = b.o_orderkey")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """J-28, X-19."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    b = o.select((F.col("o_orderkey") + 50).alias("o_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("s")).alias("s"))
    return joins.reconcile_tables(o, b, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS note FROM orders")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """J-20: notes of an earlier version stay where its columns are equal."""
    now = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("note"))
    before = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.col("o_orderpriority").alias("note"))
    return joins.carry_forward(now, before, "o_orderkey", ["o_orderstatus"], ["note"])


@query("WITH g AS (SELECT user_id, event_type, avg(value) AS gap FROM events GROUP BY 1, 2), b AS (SELECT *, max(CASE WHEN event_type = 'click' THEN gap END) OVER (PARTITION BY user_id) AS baseline FROM g) SELECT user_id, event_type, round(gap / baseline, 6) AS normalised, round(1 - gap / baseline, 6) AS suppression FROM b WHERE abs(baseline) >= 0.25")
def baseline_norm(spark: SparkSession, d: str) -> DataFrame:
    """J-05, T-33, T-34."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("gap")).withColumn("component", F.lit("all"))
    return r6(vectors.normalised_gaps(g, ["user_id"], "event_type", "click").select("user_id", "event_type", "normalised", "suppression"))


_MOMENTS = "WITH g AS (SELECT l_returnflag, l_suppkey, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, sum(n) AS nt, count(*) AS k, sum(n * v) AS ssw, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS ssb, sum(n * n) AS nn FROM g GROUP BY 1), c AS (SELECT *, greatest(ssw / (nt - k), 1e-9) AS var_resid, greatest(0, (ssb / (k - 1) - ssw / (nt - k)) / ((nt - nn / nt) / (k - 1))) AS var_group FROM s) SELECT l_returnflag, round(var_group, 6) AS var_group, round(var_resid, 6) AS var_resid, round(var_group / (var_group + var_resid), 6) AS icc, round(1 + (nt / k - 1) * var_group / (var_group + var_resid), 6) AS design_effect, k AS n_groups, CAST(nt AS BIGINT) AS n_obs FROM c"


@query(_MOMENTS)
def moments_varcomp(spark: SparkSession, d: str) -> DataFrame:
    """T-12, T-14."""
    return r6(stats.variance_components(table(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", "l_quantity"))


@query(
    "WITH r AS (SELECT l_suppkey AS g, l_quantity AS y, l_discount AS x FROM lineitem), t AS (SELECT count(*) AS n, count(DISTINCT g) AS k, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM r), "
    "b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS b0 FROM t), "
    "s AS (SELECT g, sum(y - b0 - b1 * x) AS s0, sum(x * (y - b0 - b1 * x)) AS s1 FROM r, b GROUP BY 1), m AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11 FROM s) "
    "SELECT round(b1, 6) AS estimate, round(sqrt(k / (k - 1) * (n - 1) / (n - 2) * (sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / pow(n * sxx - sx * sx, 2)), 6) AS se, n AS n_obs, k AS n_groups FROM b, m"
)
def ols_cluster(spark: SparkSession, d: str) -> DataFrame:
    """T-02."""
    return r6(stats.ols_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", "l_discount", [], "l_suppkey").select("estimate", "se", "n_obs", "n_groups"))


_DELTA = "e AS (SELECT label % 2 AS layer, vec_id % 3 AS s, vec_id % 5 < 2 AS side, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_DELTA}, d AS (SELECT layer, pos, avg(CASE WHEN side THEN x END) - avg(CASE WHEN NOT side THEN x END) AS d FROM e GROUP BY 1, 2) SELECT layer, round(sqrt(sum(d * d)), 6) AS delta_norm, count(*) AS n_dims FROM d GROUP BY 1")
def delta_norm(spark: SparkSession, d: str) -> DataFrame:
    """T-24."""
    return r6(vectors.norms(vectors.mean_difference(_layers(spark, d), ["layer"], F.col("side")), ["layer"]))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("label") % 2).alias("layer"), F.pmod("vec_id", F.lit(3)).alias("s"), (F.pmod("vec_id", F.lit(5)) < 2).alias("side"), F.col("embedding").alias("vec"))


@query(f"WITH {_DELTA}, i AS (SELECT layer, s, pos, avg(CASE WHEN side THEN x END) - avg(CASE WHEN NOT side THEN x END) AS d FROM e GROUP BY 1, 2, 3), d AS (SELECT layer, pos, avg(d) AS d FROM i WHERE d IS NOT NULL GROUP BY 1, 2) SELECT layer, round(sqrt(sum(d * d)), 6) AS delta_norm, count(*) AS n_dims FROM d GROUP BY 1")
def within_sign_delta(spark: SparkSession, d: str) -> DataFrame:
    """T-25, T-26."""
    return r6(vectors.norms(vectors.mean_difference(_layers(spark, d), ["layer"], F.col("side"), ["s"]), ["layer"]))


@query(f"WITH {_DELTA}, d AS (SELECT layer, pos, avg(CASE WHEN side THEN x END) - avg(CASE WHEN NOT side THEN x END) AS d, avg(CASE WHEN s = 0 THEN x END) - avg(CASE WHEN s <> 0 THEN x END) AS f FROM e GROUP BY 1, 2) SELECT layer, round(sum(d * f) / sqrt(sum(d * d) * sum(f * f)), 6) AS cosine FROM d GROUP BY 1")
def delta_cosine(spark: SparkSession, d: str) -> DataFrame:
    """T-24."""
    rows = _layers(spark, d)
    a, b = vectors.mean_difference(rows, ["layer"], F.col("side")), vectors.mean_difference(rows, ["layer"], F.col("s") == 0)
    return r6(vectors.cosines(a, b, ["layer"]))


@query("SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(feature AS INTEGER) AS feature, round(value, 6) AS value FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, p) - 1 AS rank, p - 1 AS feature, x AS value FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) WHERE rank < 5")
def topk_features(spark: SparkSession, d: str) -> DataFrame:
    """X-13."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return r6(ag.top_features(e, ["vec_id"], "v", 5))


@query("SELECT conv_id, turn, sha256(text) AS sha256, 'user' AS role, text AS content, conv_id || '::' || turn || '::chat' AS prompt_id FROM conversations")
def messages_array(spark: SparkSession, d: str) -> DataFrame:
    """F-09: a text as one message of a conversation."""
    c = table(spark, d, "conversations").withColumn("m", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    return c.select("conv_id", "turn", seeds.text_hash("text").alias("sha256"), F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("content"), F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit("chat")).alias("prompt_id"))


@query("SELECT event_type, count(k) AS n, round(avg(k), 6) AS mean_k FROM (SELECT event_type, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events) GROUP BY 1")
def json_prop(spark: SparkSession, d: str) -> DataFrame:
    """A typed read of JSON text."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return r6(e.groupBy("event_type").agg(F.count("k").alias("n"), F.avg("k").alias("mean_k")))


@query("SELECT l_shipdate_month, round(100 * count(*) FILTER (l_returnflag = 'R') / count(*), 2) AS R, round(100 * count(*) FILTER (l_returnflag = 'A') / count(*), 2) AS A FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipdate_month, l_returnflag FROM lineitem) GROUP BY 1".replace("round(100", "round_even(100"))
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    """A-26."""
    x = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("l_shipdate_month"), "l_returnflag")
    return ag.category_shares(x, ["l_shipdate_month"], "l_returnflag", ["R", "A"])


@query("SELECT l_suppkey, round(a - b, 6) AS swing, round((a - b) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS standardised, CASE WHEN abs(a) > abs(b) THEN 'R' ELSE 'A' END AS bigger FROM (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'R') AS a, avg(l_quantity) FILTER (l_returnflag = 'A') AS b, var_samp(l_quantity) FILTER (l_returnflag = 'R') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'A') AS vb, count(*) FILTER (l_returnflag = 'R') AS na, count(*) FILTER (l_returnflag = 'A') AS nb FROM lineitem GROUP BY 1)")
def swing(spark: SparkSession, d: str) -> DataFrame:
    """A-36."""
    return r6(ag.swing(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", "R", "A", "l_quantity"))


@query("SELECT l_linestatus, round(rb, 6) AS gap_bad, round(ra, 6) AS gap_good, round(rb / ra, 6) AS ratio FROM (SELECT l_linestatus, avg(l_quantity) FILTER (l_returnflag = 'R' AND l_linenumber = 1) - avg(l_quantity) FILTER (l_returnflag = 'R' AND l_linenumber = 2) AS rb, avg(l_quantity) FILTER (l_returnflag = 'A' AND l_linenumber = 1) - avg(l_quantity) FILTER (l_returnflag = 'A' AND l_linenumber = 2) AS ra FROM lineitem GROUP BY 1)")
def domain_decomposition(spark: SparkSession, d: str) -> DataFrame:
    """A-37, A-38."""
    x = table(spark, d, "lineitem").withColumn("sign", F.when(F.col("l_returnflag") == "R", "bad").when(F.col("l_returnflag") == "A", "good")).withColumn("line", F.col("l_linenumber").cast("string"))
    return r6(ag.decomposed(x, ["l_linestatus"], "sign", "line", "1", "2", "l_quantity"))


@query("SELECT l_returnflag, CAST(bin AS BIGINT) AS bin, count(*) AS n FROM (SELECT l_returnflag, floor(l_quantity / 10) AS bin FROM lineitem) GROUP BY 1, 2")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    """A-24."""
    return ag.histogram(table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("q")), ["l_returnflag"], "q")


@query("SELECT p_brand, min(p_size) FILTER (m >= 1500) AS p_size FROM (SELECT p_brand, p_size, avg(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1")
def first_reaching(spark: SparkSession, d: str) -> DataFrame:
    """X-15."""
    m = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("m"))
    return ag.first_reaching(m, ["p_brand"], "m", 1500.0, ["p_size"])


@query("SELECT s_nationkey, string_agg(DISTINCT CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS ids, CAST(max(s_suppkey) + 1 AS BIGINT) AS next FROM supplier GROUP BY 1")
def sorted_ids(spark: SparkSession, d: str) -> DataFrame:
    """A-16, A-29."""
    s = table(spark, d, "supplier").withColumn("id", F.col("s_suppkey").cast("string"))
    return ag.sorted_ids(s, ["s_nationkey"], "id").withColumn("ids", F.array_join("ids", ",")).join(ag.next_number(s, ["s_nationkey"], "s_suppkey").select("s_nationkey", "next"), "s_nationkey")


@query("SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_clusters, count(DISTINCT o_orderstatus) AS n_levels, CASE WHEN count(*) < 2000 OR count(DISTINCT o_custkey) < 5 OR count(DISTINCT o_orderstatus) < 2 THEN 'untestable' ELSE 'testable' END AS status FROM orders GROUP BY 1")
def cell_guard(spark: SparkSession, d: str) -> DataFrame:
    """W-07."""
    return routing.testable(table(spark, d, "orders"), ["o_orderpriority"], "o_custkey", "o_orderstatus", least=2000)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, max(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice > 100000 AS INTEGER) END) OVER (PARTITION BY o_custkey) AS ok FROM orders) WHERE ok = 1")
def pair_gate(spark: SparkSession, d: str) -> DataFrame:
    """W-09."""
    o = table(spark, d, "orders").withColumn("sign", F.when(F.col("o_orderstatus") == "F", "bad").otherwise("good")).withColumn("passed", F.col("o_totalprice") > 100000)
    return routing.keep_pairs(o, ["o_custkey"], "sign", "passed").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_nationkey, round(m, 6) AS m, round(m - (SELECT avg(x) FROM (SELECT avg(s_acctbal) AS x FROM supplier GROUP BY s_nationkey)), 6) AS m_c FROM customer LEFT JOIN (SELECT s_nationkey, avg(s_acctbal) AS m FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey")
def centred_group_mean(spark: SparkSession, d: str) -> DataFrame:
    """J-08, X-04."""
    s = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    out = joins.with_group_mean(table(spark, d, "customer").select("c_custkey", "c_nationkey"), s, "c_nationkey", "s_acctbal", "m")
    return r6(out.select("c_custkey", "c_nationkey", "m", "m_c"))


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, arg_max(o_orderkey, o_orderkey) AS last_order FROM orders GROUP BY 1")
def first_last_row(spark: SparkSession, d: str) -> DataFrame:
    """X-07, X-08."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    a = joins.first_row(o, ["o_custkey"], "o_orderkey").withColumnRenamed("o_orderkey", "first_order")
    return a.join(joins.last_row(o, ["o_custkey"], "o_orderkey").withColumnRenamed("o_orderkey", "last_order"), "o_custkey")


@query("SELECT r_name, n_name, r_regionkey * 100 + n_nationkey AS x FROM region, nation")
def cross_grid(spark: SparkSession, d: str) -> DataFrame:
    """J-24: all pairs of two dimensions of fixed size."""
    r, n = table(spark, d, "region").select("r_name", "r_regionkey"), table(spark, d, "nation").select("n_name", "n_nationkey")
    return r.crossJoin(n).select("r_name", "n_name", (F.col("r_regionkey") * 100 + F.col("n_nationkey")).alias("x"))


@query("SELECT 'c' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey FROM supplier")
def union_shards(spark: SparkSession, d: str) -> DataFrame:
    """X-17, X-18, X-21."""
    c = table(spark, d, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return ag.merged_shards(ag.union_all(c, s), "kind", ["kind", "id"], 2, [])


@query("SELECT l_suppkey, round(avg(CAST(l_discount > 0.05 AS DOUBLE)), 10) AS share, round(var_samp(l_quantity) / count(l_quantity), 6) AS error_variance, CAST(sum(l_quantity) AS BIGINT) AS hits FROM lineitem GROUP BY 1")
def item_error(spark: SparkSession, d: str) -> DataFrame:
    """A-25, A-27, A-35."""
    x = table(spark, d, "lineitem")
    a = ag.out_of_range(x, ["l_suppkey"], "l_discount", 0, 0.05)
    b = ag.error_variance(x, ["l_suppkey"], "l_quantity")
    c = ag.pooled_rate(x.withColumn("one", F.lit(1)), ["l_suppkey"], "l_quantity", "one").select("l_suppkey", F.col("hits").cast("bigint").alias("hits"))
    return a.join(r6(b), "l_suppkey").join(c, "l_suppkey").withColumn("share", F.round("share", 10))


@query("SELECT c_custkey, round_even(c_acctbal, 1) AS half_even, printf('%.6f', c_acctbal) AS fixed, 'the ' || substr(c_name, 1, 3) AS agent, c_mktsegment IN ('BUILDING') AS flag FROM customer")
def formats(spark: SparkSession, d: str) -> DataFrame:
    """F-13, F-14, F-22, F-23, F-24."""
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey",
        tx.half_even("c_acctbal", 1).alias("half_even"),
        tx.fixed("c_acctbal").alias("fixed"),
        tx.decapitalise(F.concat(F.lit("The "), F.substring("c_name", 1, 3))).alias("agent"),
        tx.truthy(F.when(F.col("c_mktsegment") == "BUILDING", "Yes").otherwise("maybe")).alias("flag"),
    )


@query(
    "WITH r AS (SELECT l_returnflag AS f, l_suppkey AS g, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag, l_suppkey) AS y, l_discount - avg(l_discount) OVER (PARTITION BY l_returnflag, l_suppkey) AS x FROM lineitem), "
    "t AS (SELECT f, count(*) AS n, count(DISTINCT g) AS k, sum(x * x) AS sxx, sum(x * y) / sum(x * x) AS b FROM r GROUP BY 1), s AS (SELECT f, g, sum(x * (y - b * x)) AS s FROM r JOIN t USING (f) GROUP BY 1, 2) "
    "SELECT f AS l_returnflag, round(any_value(b), 6) AS estimate, round(sqrt(any_value(k / (k - 1) * (n - 1) / (n - 1 - k)) * sum(s * s)) / any_value(sxx), 6) AS se, any_value(n) AS n_obs, any_value(k) AS n_groups FROM s JOIN t USING (f) GROUP BY 1"
)
def absorbed_effects(spark: SparkSession, d: str) -> DataFrame:
    """T-16: a slope within suppliers."""
    out = stats.ols_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount + C(l_suppkey)", "l_discount", ["l_returnflag"], "l_suppkey")
    return r6(out.select("l_returnflag", "estimate", "se", "n_obs", "n_groups"))


@query()
def random_slopes(spark: SparkSession, d: str) -> DataFrame:
    """T-09, T-19."""
    return r6(stats.slope_table(table(spark, d, "lineitem"), "l_quantity ~ l_discount", "l_discount", ["l_returnflag"], "l_suppkey"))


@query(
    "SELECT round(ln(a / b) - ln(c / d), 6) AS estimate, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se FROM (SELECT CAST(count(*) FILTER (late AND high) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT late AND high) AS DOUBLE) AS b, CAST(count(*) FILTER (late AND NOT high) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT late AND NOT high) AS DOUBLE) AS d FROM (SELECT o_orderstatus = 'F' AS late, o_orderpriority LIKE '1%' AS high FROM orders))"
)
def logistic_effect(spark: SparkSession, d: str) -> DataFrame:
    """T-17: one binary predictor, for which the estimate is a log odds ratio."""
    x = table(spark, d, "orders").withColumn("late", (F.col("o_orderstatus") == "F").cast("int")).withColumn("high", F.col("o_orderpriority").startswith("1").cast("int"))
    return r6(stats.logistic_table(x, "late ~ high", "high").select("estimate", "se"))



from . import analysis_queries, stat_queries, stream_queries, study_queries  # noqa: E402, F401  register further queries
