"""Queries for summaries of cohorts, selections, outcomes and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as U
from .aggregates import rounded
from .registry import query, read

GROUPED = "SELECT l_returnflag AS g, l_linestatus AS c, l_quantity, CASE WHEN l_linenumber < 4 THEN l_tax END AS l_tax FROM lineitem"


def grouped(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("c"), "l_quantity", F.when(F.col("l_linenumber") < 4, F.col("l_tax")).alias("l_tax"))


@query(f"""WITH l AS (SELECT g, 'l_quantity' AS feature, l_quantity AS value FROM ({GROUPED}) UNION ALL SELECT g, 'l_tax', l_tax FROM ({GROUPED})), k AS (SELECT feature, avg(value) AS cm, median(value) AS cd, stddev_pop(value) AS sd FROM l GROUP BY 1)
SELECT g, feature, count(*) AS n_cases, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(any_value(cm), 6) AS cohort_mean, round(any_value(cd), 6) AS cohort_median, round(avg(value) - any_value(cm), 6) + 0.0 AS delta, round((avg(value) - any_value(cm)) / any_value(sd), 6) + 0.0 AS delta_z FROM l JOIN k USING (feature) GROUP BY 1, 2""")
def group_profiles(spark, d):
    out = rounded(U.profiles(grouped(spark, d), "g", ["l_quantity", "l_tax"]), ("mean", "median", "q25", "q75", "cohort_mean", "cohort_median", "delta", "delta_z"))
    return out.withColumns({"delta": F.col("delta") + 0.0, "delta_z": F.col("delta_z") + 0.0})


STATES = "SELECT o_orderstatus AS g, o_orderpriority AS c, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' WHEN o_totalprice < 400000 THEN 'high' END AS price_state, o_totalprice / 1000 AS price_score, CASE WHEN o_custkey % 3 = 0 THEN 'low' ELSE 'high' END AS cust_state, o_custkey * 1.0::DOUBLE AS cust_score FROM orders"


def states(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderpriority").alias("c"), F.when(p < 50000, "low").when(p < 200000, "mid").when(p < 400000, "high").alias("price_state"), (p / 1000).alias("price_score"), F.when(F.col("o_custkey") % 3 == 0, "low").otherwise("high").alias("cust_state"), F.col("o_custkey").cast("double").alias("cust_score"))


def modal(d):
    return f"(SELECT g, arg_max(s, struct_pack(n := n, s := s)) AS {d}_state FROM (SELECT g, coalesce({d}_state, 'missing') AS s, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH t AS ({STATES}) SELECT t.g, count(*) AS n_cases, any_value(a.price_state) AS price_state, round(avg(price_score), 6) AS price_score_mean, round(median(price_score), 6) AS price_score_median, any_value(b.cust_state) AS cust_state, round(avg(cust_score), 6) AS cust_score_mean, round(median(cust_score), 6) AS cust_score_median, any_value(m.clusters) AS clusters
FROM t JOIN {modal('price')} a USING (g) JOIN {modal('cust')} b USING (g) JOIN (SELECT g, string_agg(c || ':' || n, '; ' ORDER BY c) AS clusters FROM (SELECT g, c, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1) m USING (g) GROUP BY 1""")
def state_summary(spark, d):
    return rounded(U.state_summary(states(spark, d), "g", "c", ["price", "cust"]), ("price_score_mean", "price_score_median", "cust_score_mean", "cust_score_median"))


@query(f"""WITH t AS ({STATES}), l AS (SELECT c, 'price' AS domain, coalesce(price_state, 'missing') AS s FROM t UNION ALL SELECT c, 'cust', cust_state FROM t), n AS (SELECT c, domain, s, count(*) AS n FROM l GROUP BY ALL),
m AS (SELECT c, string_agg(g || ':' || n, '; ' ORDER BY n DESC, g) AS top_groups FROM (SELECT c, g, count(*) AS n FROM t GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, g) <= 3) GROUP BY 1)
SELECT n.c, domain, CAST(sum(n) AS BIGINT) AS n_cases, CAST(coalesce(sum(n) FILTER (WHERE s = 'low'), 0) AS BIGINT) AS low, CAST(coalesce(sum(n) FILTER (WHERE s = 'mid'), 0) AS BIGINT) AS mid, CAST(coalesce(sum(n) FILTER (WHERE s = 'high'), 0) AS BIGINT) AS high, CAST(coalesce(sum(n) FILTER (WHERE s = 'missing'), 0) AS BIGINT) AS missing, arg_max(s, n) AS top_state, round(max(n) / sum(n), 6) AS top_fraction, any_value(top_groups) AS top_groups FROM n JOIN m ON m.c = n.c GROUP BY 1, 2""")
def states_by_cluster(spark, d):
    return rounded(U.states_by_cluster(states(spark, d), "c", "g", ["price", "cust"]), ("top_fraction",))


@query("""WITH m AS (SELECT o_orderstatus AS g, median(o_totalprice) AS md FROM orders GROUP BY 1), d AS (SELECT g, median(abs(o_totalprice - md)) AS mad FROM orders JOIN m ON g = o_orderstatus GROUP BY 1)
SELECT g, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.75), 4) AS q75, round(quantile_cont(o_totalprice, 0.95), 4) AS q95, round(quantile_cont(o_totalprice, 0.99), 4) AS q99, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(any_value(mad), 4) AS mad FROM orders JOIN d ON g = o_orderstatus GROUP BY 1""")
def distributions(spark, d):
    return rounded(U.distribution(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "g"), ["g"], "o_totalprice"), ("median", "q25", "q75", "q95", "q99", "iqr", "mad"), 4)


@query("""SELECT o_orderstatus AS g, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS most, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr,
round(avg(o_totalprice) - 1.959963984540054 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS low, round(avg(o_totalprice) + 1.959963984540054 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS high FROM orders GROUP BY 1""")
def interval_summaries(spark, d):
    return rounded(U.interval_summary(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "g"), ["g"], "o_totalprice"), ("mean", "median", "sd", "q1", "q3", "p5", "p95", "iqr", "low", "high"), 4)


FOUND = "SELECT o_custkey AS k, count(*) FILTER (WHERE o_totalprice > 400000) AS n, CASE WHEN count(*) > 10 THEN 1 ELSE 0 END AS r FROM orders GROUP BY 1"


@query(f"""SELECT c_mktsegment AS label, count(*) AS n_cases, count(*) FILTER (WHERE n > 0) AS n_hit, round(100 * avg(CAST(coalesce(n, 0) > 0 AS INTEGER)), 6) AS pct_hit, median(coalesce(n, 0))::DOUBLE AS median_count, max(coalesce(n, 0)) AS max_count, count(*) FILTER (WHERE r > 0) AS n_reviewed FROM customer LEFT JOIN ({FOUND}) ON k = c_custkey GROUP BY 1""")
def label_summaries(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_totalprice") > 400000).alias("n"), F.when(F.count("*") > 10, 1).otherwise(0).alias("r"))
    return rounded(U.label_summary(read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label")), "k", "label", o, "n", "r"), ("pct_hit",))


SELECTED = "SELECT l_returnflag AS modality, 'f' || l_linenumber AS feature, l_suppkey % 5 AS fold, l_discount - 0.05 AS coefficient, l_tax AS relevance, l_linenumber AS rank, l_linestatus AS base_domain, CASE WHEN l_partkey % 2 = 0 THEN 'relevance_collinearity' ELSE 'elastic_net_nonzero' END AS selection_method FROM lineitem WHERE l_quantity > 45"
STABLE = "SELECT l_returnflag AS modality, 'f' || (l_linenumber + 2) AS feature, avg(l_discount) AS selection_probability, avg(l_discount) > 0.05 AS stable FROM lineitem GROUP BY 1, 2"


def selected(spark, d):
    li = read(spark, d, "lineitem").where("l_quantity > 45")
    return li.select(F.col("l_returnflag").alias("modality"), F.concat(F.lit("f"), "l_linenumber").alias("feature"), (F.col("l_suppkey") % 5).alias("fold"), (F.col("l_discount") - 0.05).alias("coefficient"), F.col("l_tax").alias("relevance"), F.col("l_linenumber").alias("rank"), F.col("l_linestatus").alias("base_domain"), F.when(F.col("l_partkey") % 2 == 0, "relevance_collinearity").otherwise("elastic_net_nonzero").alias("selection_method"))


def stable(spark, d):
    p = F.avg("l_discount")
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("modality"), F.concat(F.lit("f"), F.col("l_linenumber") + 2).alias("feature")).agg(p.alias("selection_probability"), (p > 0.05).alias("stable"))


@query(f"""WITH s AS ({SELECTED}), p AS ({STABLE}), g AS (SELECT modality, feature, count(DISTINCT fold) AS n, avg(abs(coefficient)) AS c, avg(relevance) AS r FROM s GROUP BY 1, 2)
SELECT modality, feature, coalesce(n, 0) AS selected_folds, round(c, 6) AS mean_abs_coefficient, round(r, 6) AS mean_relevance, round(selection_probability, 6) AS selection_probability, coalesce(stable, false) AS stable FROM g FULL JOIN p USING (modality, feature)""")
def selection_frequencies(spark, d):
    return rounded(U.selection_frequency(selected(spark, d), stable(spark, d)), ("mean_abs_coefficient", "mean_relevance", "selection_probability"))


@query(f"SELECT modality, fold, count(DISTINCT feature) AS redundant_features_dropped, count(*) AS decisions, max(relevance) AS max_abs_correlation FROM ({SELECTED}) GROUP BY 1, 2")
def redundancy_summaries(spark, d):
    return U.redundancy_summary(selected(spark, d).withColumnRenamed("feature", "dropped_feature").withColumnRenamed("relevance", "abs_correlation"))


@query(f"""WITH s AS ({SELECTED}), p AS (SELECT feature, selection_probability, stable FROM ({STABLE}) WHERE modality = 'A'), g AS (SELECT feature, count(*) AS selected_rows, avg(rank) AS a, avg(coefficient) AS b, avg(abs(coefficient)) AS c, count(*) FILTER (WHERE coefficient > 0) AS positive_rows, count(*) FILTER (WHERE coefficient < 0) AS negative_rows FROM s WHERE base_domain = 'F' AND selection_method = 'relevance_collinearity' GROUP BY 1)
SELECT feature, selected_rows, round(a, 6) AS mean_rank, round(b, 6) AS mean_coefficient, round(c, 6) AS mean_abs_coefficient, positive_rows, negative_rows, round(selection_probability, 6) AS selection_probability, coalesce(stable, false) AS stable FROM g LEFT JOIN p USING (feature)""")
def chosen_summaries(spark, d):
    out = U.chosen_summary(selected(spark, d), stable(spark, d).where("modality = 'A'"), ["F"], "relevance_collinearity")
    return rounded(out, ("mean_rank", "mean_coefficient", "mean_abs_coefficient", "selection_probability"))


@query(f"""WITH s AS (SELECT base_domain AS domain, * FROM ({SELECTED})), c AS (SELECT DISTINCT l_linestatus AS domain, 'f' || l_linenumber AS feature FROM lineitem), x AS (SELECT * FROM s WHERE fold = 1 AND domain = 'O')
SELECT domain, count(DISTINCT c.feature) AS candidates, (SELECT count(DISTINCT feature) FROM s WHERE s.domain = c.domain AND selection_method = 'relevance_collinearity') AS selected, (SELECT count(DISTINCT feature) FROM s WHERE s.domain = c.domain AND selection_method = 'elastic_net_nonzero') AS selected_net, (SELECT count(*) FROM x WHERE x.domain = c.domain) AS drop_decisions, (SELECT count(DISTINCT feature) FROM x WHERE x.domain = c.domain) AS dropped FROM c GROUP BY domain""")
def domain_counts(spark, d):
    s = selected(spark, d).withColumnRenamed("base_domain", "domain")
    candidates = read(spark, d, "lineitem").select(F.col("l_linestatus").alias("domain"), F.concat(F.lit("f"), "l_linenumber").alias("feature"))
    return U.domain_counts(candidates, s, s.where("fold = 1 and domain = 'O'"))


@query("SELECT coalesce(CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus END, 'missing') AS label, count(*) AS n FROM orders GROUP BY 1")
def class_counts(spark, d):
    return U.class_counts(read(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 > 0, F.col("o_orderstatus")).alias("l")), "l")


@query("""WITH v AS (SELECT TRY_CAST(CASE WHEN o_custkey % 7 = 0 THEN 'nan' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS v FROM orders) SELECT count(*) AS rows, count(v) FILTER (WHERE isfinite(v)) AS non_missing, round(avg(v) FILTER (WHERE isfinite(v)), 4) AS mean, round(stddev_samp(v) FILTER (WHERE isfinite(v)), 4) AS std, min(v) FILTER (WHERE isfinite(v)) AS min, max(v) FILTER (WHERE isfinite(v)) AS max FROM v""")
def outcome_moments(spark, d):
    x = F.when(F.col("o_custkey") % 7 == 0, "nan").otherwise(F.col("o_totalprice").cast("string"))
    return rounded(U.moments(read(spark, d, "orders").select(x.alias("x")), "x"), ("mean", "std"), 4)


@query("""WITH t AS (SELECT value AS t, CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '0' WHEN 'error' THEN '2' END AS e FROM events)
SELECT count(*) AS rows, min(t) AS time_min, round(median(t), 6) AS time_median, max(t) AS time_max, count(*) FILTER (WHERE e = '2') AS events, count(*) FILTER (WHERE e IS NULL OR e <> '2') AS censored, count(*) FILTER (WHERE e = '1') AS competing, count(*) FILTER (WHERE e IS NULL OR e = '0') AS censored_rows FROM t""")
def competing_events(spark, d):
    e = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "0").when(F.col("event_type") == "error", "2")
    return rounded(U.event_summary(read(spark, d, "events").select(F.col("value").alias("t"), e.alias("e")), "t", "e", True, "2"), ("time_median",))


@query("""SELECT 'core' AS tier, 3 AS registered, 2 AS available, round(1 - (count(p_size) FILTER (WHERE p_partkey % 3 > 0) + count(p_brand)) / (3.0 * count(*)), 6)::DOUBLE AS missing FROM part UNION ALL SELECT 'extra', 1, 0, 1.0""")
def tier_availability(spark, d):
    df = read(spark, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")))
    return rounded(U.availability(df, {"core": ["p_size", "brand", "absent"], "extra": ["gone"]}, {"brand": "p_brand"}), ("missing",))


@query("""SELECT * FROM (SELECT 'p_size' AS "column", count(*) FILTER (WHERE p_partkey % 3 = 0) AS missing FROM part UNION ALL SELECT 'p_brand', 0)""")
def missing_columns(spark, d):
    return U.most_missing(read(spark, d, "part").withColumn("p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size"))), 2)


@query("""WITH s AS (SELECT event_type AS stage, count(*) AS expected, count(*) FILTER (WHERE value > 10) AS done, CASE WHEN event_type <> 'view' THEN min(ts) END AS started, avg(value) AS mean FROM events GROUP BY 1)
SELECT stage, round(CASE WHEN started IS NOT NULL AND done > 0 THEN (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(started)) / 1e6 / done * (expected - done) ELSE mean * (expected - done) END, 2) AS eta FROM s UNION ALL SELECT 'none', 0""")
def remaining_time(spark, d):
    e = read(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("expected"), F.count_if(F.col("value") > 10).alias("done"), F.when(F.col("stage") != "view", F.min("ts")).alias("started"), F.avg("value").alias("mean"))
    e = e.union(spark.range(1).select(F.lit("none"), F.lit(3), F.lit(3), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("double")))
    return U.remaining_seconds(e, "stage", "expected", "done", "started", "mean", F.lit("2024-06-01 00:00:00").cast("timestamp")).select("stage", F.round("eta", 2).alias("eta"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_absent, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS mean_score,
(SELECT string_agg(s || ':' || n, '; ' ORDER BY s) FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN '(unrecorded)' ELSE o_orderpriority END AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)) AS by_source FROM orders""")
def status_summaries(spark, d):
    o = read(spark, d, "orders").withColumn("source", F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")))
    return rounded(U.status_summary(o, "o_orderstatus", "source", "o_totalprice", "F", "O"), ("mean_score",), 4)


@query("""WITH t AS (SELECT toxic = 1 AS e, n_chars * 1.0::DOUBLE AS chars, CASE WHEN doc_id % 4 > 0 THEN length(lang || source) * 1.0::DOUBLE END AS names FROM documents JOIN labels USING (doc_id)), l AS (SELECT e, 'chars' AS feature, chars AS v FROM t UNION ALL SELECT e, 'names', names FROM t),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS rk FROM l WHERE v IS NOT NULL), a AS (SELECT feature, (sum(rk) FILTER (WHERE e) - count(*) FILTER (WHERE e) * (count(*) FILTER (WHERE e) + 1) / 2.0) / (count(*) FILTER (WHERE e) * count(*) FILTER (WHERE NOT e)) AS auc FROM r GROUP BY 1),
g AS (SELECT feature, count(v) AS n, count(v) FILTER (WHERE e) AS n_events, count(*) - count(v) AS n_missing, avg(v) FILTER (WHERE e) AS m1, median(v) FILTER (WHERE e) AS d1, avg(v) FILTER (WHERE NOT e) AS m0, median(v) FILTER (WHERE NOT e) AS d0, coalesce((avg(v) FILTER (WHERE e) - avg(v) FILTER (WHERE NOT e)) / nullif(sqrt((var_samp(v) FILTER (WHERE e) + var_samp(v) FILTER (WHERE NOT e)) / 2), 0), 0) AS smd FROM l GROUP BY 1)
SELECT feature, n, n_events, n_missing, round(m1, 5) AS event_mean, round(d1, 5) AS event_median, round(m0, 5) AS nonevent_mean, round(d0, 5) AS nonevent_median, round(smd, 6) AS smd, round(auc, 6)::DOUBLE AS auc, round(greatest(auc, 1 - auc), 6)::DOUBLE AS auc_directional, CAST(row_number() OVER (ORDER BY greatest(auc, 1 - auc) DESC, abs(smd) DESC, feature) AS INTEGER) AS place FROM g JOIN a USING (feature)""")
def univariate_screen(spark, d):
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("toxic", F.col("n_chars").cast("double").alias("chars"), F.when(F.col("doc_id") % 4 > 0, F.length(F.concat("lang", "source")).cast("double")).alias("names"))
    return rounded(rounded(U.univariate_screen(j, ["chars", "names"], "toxic", 10), ("event_mean", "event_median", "nonevent_mean", "nonevent_median"), 5), ("smd", "auc", "auc_directional"))


@query("""WITH l AS (SELECT l_returnflag AS g, 'l_quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem),
k AS (SELECT feature, g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM l GROUP BY 1, 2), t AS (SELECT feature, sum(n) AS n, count(*) AS c, sum(n * m) / sum(n) AS mm, sum(n * s) AS w FROM k GROUP BY 1)
SELECT feature, round(sum(k.n * power(m - mm, 2)) / (any_value(c) - 1) / (any_value(w) / (any_value(t.n) - any_value(c))), 5) AS f FROM k JOIN t USING (feature) GROUP BY 1 ORDER BY f DESC, feature LIMIT 2""")
def best_features(spark, d):
    return rounded(U.best_features(read(spark, d, "lineitem"), ["l_quantity", "l_tax", "l_discount"], "l_returnflag", 2), ("f",), 5)


@query("""SELECT unnest(['p_retailprice', 'p_size']) AS "column" """)
def usable_columns(spark, d):
    df = read(spark, d, "part").withColumns({"flat": F.lit(1.0), "sparse": F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")), "two": F.col("p_partkey") % 2})
    return spark.createDataFrame([(c,) for c in U.usable_columns(df, df.columns, 0.5, 5, 1e-12, ["key"], 2)], "column string")


FEATURES = "SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag AS region, CASE WHEN l_linenumber % 2 = 0 THEN 'Mean HU' ELSE 'volume' END AS feature_name, l_extendedprice AS v, CASE WHEN l_linenumber = 3 THEN '130' END AS thr FROM lineitem"


def features(spark, d):
    n = F.col("l_linenumber")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("region"), F.when(n % 2 == 0, "Mean HU").otherwise("volume").alias("feature_name"), F.col("l_extendedprice").alias("feature_value"), F.when(n == 3, "130").alias("threshold_if_applicable"))


@query(f"""WITH f AS ({FEATURES}), a AS (SELECT * FROM f WHERE region = 'A' AND feature_name = 'volume' AND thr = '130'), b AS (SELECT * FROM f WHERE feature_name = 'Mean HU'), q AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM a), r AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM b), s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM b)
SELECT 'quantile' AS method, case_id FROM (SELECT case_id FROM a, q WHERE v >= hi OR v <= lo UNION SELECT case_id FROM b, r WHERE v >= hi OR v <= lo) UNION ALL SELECT DISTINCT 'zscore', case_id FROM b, s WHERE (v - m) / s >= 1.6 UNION ALL SELECT DISTINCT 'top-n', case_id FROM (SELECT case_id FROM b QUALIFY row_number() OVER (ORDER BY v, CAST(case_id AS BIGINT)) <= 4)""")
def selector_outliers(spark, d):
    f = features(spark, d)
    each = [U.outlier_cases(f, ["A:volume:130", "mean hu"], "quantile", "both", 0.99), U.outlier_cases(f, ["Mean HU"], "zscore", "high", z=1.6), U.outlier_cases(f, ["Mean HU"], "top-n", "low", n=4)]
    out = [df.select(F.lit(m).alias("method"), "case_id") for m, df in zip(("quantile", "zscore", "top-n"), each, strict=True)]
    return out[0].union(out[1]).union(out[2])


@query(f"""WITH f AS ({FEATURES}), b AS (SELECT * FROM f WHERE feature_name = 'Mean HU'), q AS (SELECT quantile_cont(v, 0.95) AS hi FROM b) SELECT o_orderkey AS case_id, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' AND CAST(o_orderkey AS VARCHAR) IN (SELECT case_id FROM b, q WHERE v >= hi)""")
def selected_cases(spark, d):
    cases = read(spark, d, "orders").withColumnRenamed("o_orderkey", "case_id")
    return U.chosen(cases, (), [F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F"], U.outlier_cases(features(spark, d), ["Mean HU"], "quantile", "high")).select("case_id", "o_orderstatus")


LOG = "SELECT event_id, user_id AS k, user_id AS i, event_type AS s FROM events WHERE event_id < 60"


@query(f"""WITH l AS ({LOG}), b AS (SELECT max(event_id) AS f FROM (SELECT *, lag(i) OVER (ORDER BY event_id) AS p FROM l) WHERE p > i) SELECT 'pass' AS scope, k, max(event_id) AS event_id FROM l, b WHERE event_id >= f AND k % 2 = 0 GROUP BY 2 UNION ALL SELECT 'all', k, max(event_id) FROM l WHERE k % 2 = 0 GROUP BY 2""")
def latest_of_cases(spark, d):
    rows = read(spark, d, "events").where("event_id < 60").select("event_id", F.col("user_id").alias("k"), F.col("user_id").alias("i"), F.col("event_type").alias("s"))
    cases = rows.where("k % 2 = 0").select("k")
    return U.latest_of_cases(rows, "k", "event_id", "i", cases, False).select(F.lit("pass").alias("scope"), "k", "event_id").union(U.latest_of_cases(rows, "k", "event_id", "i", cases, True).select(F.lit("all"), "k", "event_id"))


@query("SELECT k FROM (SELECT user_id AS k, arg_max(event_type, event_id) AS s FROM events GROUP BY 1) WHERE s IN ('click', 'view')")
def resumable_done(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("k"), "event_id", "event_type")
    return U.resumable(rows, "k", "event_id", "event_type", ["click", "view"])[1]


@query("""SELECT l_orderkey, l_linenumber, round(((l_quantity - 25) / 10 + (l_tax - 0.04) / 0.02) / 2, 6) + 0.0 AS a, CASE WHEN l_linenumber < 4 THEN round((l_discount - 0.05) / 0.03, 6) + 0.0 END AS b, CASE WHEN l_linenumber < 4 THEN round((((l_quantity - 25) / 10 + (l_tax - 0.04) / 0.02) / 2 + (l_discount - 0.05) / 0.03) / 2, 6) + 0.0 END AS combined FROM lineitem""")
def composite_index(spark, d):
    df = read(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_linenumber") < 4, F.col("l_discount")))
    out = U.composite_index(df, {"a": ["l_quantity", "l_tax"], "b": ["l_discount"]}, {"l_quantity": (25.0, 10.0), "l_tax": (0.04, 0.02), "l_discount": (0.05, 0.03)})
    return rounded(out, ("a", "b", "combined")).select("l_orderkey", "l_linenumber", *[(F.col(c) + 0.0).alias(c) for c in ("a", "b", "combined")])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'x' WHEN p_size = 1 THEN 'y' ELSE 'Other' END AS kind, CAST(p_partkey % 2 + coalesce(CASE WHEN p_size = 1 THEN 1 END, 0) > 0 AS INTEGER) AS any_flag, CASE WHEN p_partkey % 3 = 0 THEN '2020-02-03' ELSE '2021-01-01' END AS first_date FROM part""")
def indicator_outcomes(spark, d):
    p = read(spark, d, "part").withColumns({"x": F.col("p_partkey") % 2, "y": F.when(F.col("p_size") == 1, 1)})
    when = U.earliest(F.lit("no date"), F.lit("2021-01-01"), F.when(F.col("p_partkey") % 3 == 0, "2020-02-03 10:00"))
    return p.select("p_partkey", U.first_match(["x", "y"]).alias("kind"), U.any_positive(["x", "y"]).alias("any_flag"), F.date_format(when, "yyyy-MM-dd").alias("first_date"))
