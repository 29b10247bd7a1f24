"""Queries for reshaping and aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as R
from ..operators import stats as S
from .registry import query, read


def rounded(df, columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


LONG = "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, unnest(['quantity','discount','tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem"


def long_items(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return R.wide_to_long(li, ["k", "n", "p", "s"])


@query(f"SELECT feature, count(*) AS n, round(sum(value), 2) AS total FROM ({LONG}) GROUP BY 1")
def wide_to_long(spark, d):
    return long_items(spark, d).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH f AS (SELECT l_orderkey AS k, l_quantity, l_discount, nullif(l_tax, 0) AS l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT k, max(l_quantity) FILTER (WHERE n = 1) AS quantity, max(l_discount) FILTER (WHERE n = 1) AS discount, arg_min(l_tax, n) FILTER (WHERE l_tax IS NOT NULL) AS tax FROM f GROUP BY 1""")
def long_to_wide(spark, d):
    long = long_items(spark, d).withColumn("o", F.struct("n", "p", "s")).withColumn("value", F.when((F.col("feature") == "tax") & (F.col("value") == 0), None).otherwise(F.col("value")))
    return R.long_to_wide(long, ["k"], "feature", "value", "o", ["quantity", "discount", "tax"])


@query("""SELECT l_returnflag AS flag, round(count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 4) AS share_F, round(count(*) FILTER (WHERE l_linestatus = 'O') / count(*), 4) AS share_O FROM lineitem GROUP BY 1""")
def crosstab(spark, d):
    return R.crosstab_share(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_linestatus", ["F", "O"])


@query("""SELECT nullif(o_orderstatus, 'P') AS status, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM orders GROUP BY 1""")
def group_summary(spark, d):
    o = read(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return rounded(o.groupBy("status").agg(*S.summary(F.col("o_totalprice"))), ("mean", "median", "q25", "q75"), 4)


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE value > 20) AS users_high, count(*) FILTER (WHERE value > 20) AS n_high, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS share_high FROM events GROUP BY 1""")
def conditional_counts(spark, d):
    hi = F.col("value") > 20
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(hi, F.col("user_id"))).alias("users_high"), F.count_if(hi).alias("n_high"), F.round(F.avg(hi.cast("double")), 6).alias("share_high"))


@query("""SELECT user_id, arg_max(event_type, struct_pack(a := value, b := -event_id)) AS top_type, max(value) AS top_value, round(max(value) - min(value), 6) AS span FROM events GROUP BY 1""")
def argmax_row(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("top_type"), F.max("value").alias("top_value"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(event_type, struct_pack(a := n, b := event_type)) AS mode, string_agg(event_type || ':' || n, ';' ORDER BY event_type) AS mix FROM c GROUP BY 1""")
def modes(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    mix = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit(":"), x["n"].cast("string"))), ";")
    return c.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("mode"), mix.alias("mix"))


@query("""WITH m AS (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity) AS m1, avg(power(l_quantity, 2)) AS m2, avg(power(l_quantity, 3)) AS m3, avg(power(l_quantity, 4)) AS m4 FROM lineitem GROUP BY 1)
SELECT f, n, round((m3 - 3 * m1 * m2 + 2 * power(m1, 3)) / power(m2 - m1 * m1, 1.5), 6) AS skew, round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * power(m1, 4)) / power(m2 - m1 * m1, 2), 6) AS kurt FROM m""")
def shape_moments(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"), F.round(S.population_skewness(q), 6).alias("skew"), F.round(S.population_kurtosis(q), 6).alias("kurt"))


@query("SELECT l_returnflag AS f, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1")
def slopes(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.round(S.slope(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("slope"), F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"))


@query(f"""WITH l AS (SELECT feature, value, s % 5 = 0 AS event FROM ({LONG}))
SELECT feature, count(*) AS n, count(*) FILTER (WHERE event) AS events, round(avg(value) FILTER (WHERE event), 6) AS mean_event, round(median(value) FILTER (WHERE event), 6) AS median_event,
round((avg(value) FILTER (WHERE event) - avg(value) FILTER (WHERE NOT event)) / sqrt((var_samp(value) FILTER (WHERE event) + var_samp(value) FILTER (WHERE NOT event)) / 2), 6) AS smd FROM l GROUP BY 1""")
def standardized_differences(spark, d):
    event = F.col("s") % 5 == 0
    x = F.col("value")
    return long_items(spark, d).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(event).alias("events"), F.round(F.avg(F.when(event, x)), 6).alias("mean_event"), F.round(F.median(F.when(event, x)), 6).alias("median_event"), F.round(S.standardized_difference(x, event), 6).alias("smd"))


@query("""WITH r AS (SELECT l.toxic, rank() OVER (ORDER BY d.n_chars) + (count(*) OVER (PARTITION BY d.n_chars) - 1) / 2 AS r FROM documents d JOIN labels l USING (doc_id)), s AS (SELECT sum(r) FILTER (WHERE toxic = 1) AS s, count(*) FILTER (WHERE toxic = 1) AS e, count(*) AS n FROM r)
SELECT n, e AS events, round((s - e * (e + 1) / 2) / (e * (n - e)), 9) AS auc FROM s""")
def rank_auc(spark, d):
    j = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    return S.rank_auc(j, [], "n_chars", "toxic").select("n", "events", F.round("auc", 9).alias("auc"))


@query("""WITH r AS (SELECT l_returnflag AS f, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem)
SELECT f, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def spearman(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), "l_quantity", "l_extendedprice")
    return rounded(S.spearman(li, ["f"], "l_quantity", "l_extendedprice"), ("rho",))


@query("""WITH g AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS mm, sum(n * v) AS w FROM g)
SELECT CAST(t.n AS BIGINT) AS n, k, round((SELECT sum(g.n * power(g.m - t.mm, 2)) FROM g) / (k - 1) / (w / (t.n - k)), 6) AS f FROM t""")
def anova(spark, d):
    return rounded(S.anova_f(read(spark, d, "orders"), [], "o_totalprice", "o_orderpriority"), ("f",))


@query("""WITH m AS (SELECT o_orderpriority AS p, median(o_totalprice) AS med FROM orders GROUP BY 1) SELECT p, round(med, 4) AS median, round(median(abs(o_totalprice - med)), 4) AS mad FROM orders JOIN m ON p = o_orderpriority GROUP BY p, med""")
def median_deviation(spark, d):
    return rounded(S.mad(read(spark, d, "orders").withColumnRenamed("o_orderpriority", "p"), ["p"], "o_totalprice"), ("median", "mad"), 4)


@query("""WITH t AS (SELECT floor(value) AS t, user_id AS r, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1, 2)
SELECT CAST(sum(a.e * b.n) AS BIGINT) AS pairs, round(sum(a.e * b.n * CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / sum(a.e * b.n), 9) AS c_index FROM t a JOIN t b ON a.t < b.t""")
def concordance(spark, d):
    e = read(spark, d, "events").withColumn("e", F.col("event_type") == "error").withColumn("t", F.floor("value"))
    return rounded(S.concordance(e, "t", "user_id", "e"), ("c_index",), 9)


@query("""SELECT column_name AS feature, n, missing FROM (SELECT 'lang' AS column_name, count(lang) AS n, count(*) FILTER (WHERE lang = 'en') AS missing FROM documents UNION ALL SELECT 'source', count(source), count(*) FILTER (WHERE source = 'src0') FROM documents)""")
def missingness(spark, d):
    rows = F.explode(F.array(F.struct(F.lit("lang").alias("feature"), F.col("lang").alias("v"), F.lit("en").alias("none")), F.struct(F.lit("source").alias("feature"), F.col("source").alias("v"), F.lit("src0").alias("none"))))
    return read(spark, d, "documents").select(rows.alias("r")).select("r.*").groupBy("feature").agg(F.count("v").alias("n"), F.count_if(F.col("v") == F.col("none")).alias("missing"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM orders)
SELECT round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FILTER (WHERE o_totalprice <= lo), 6) AS low_rate, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FILTER (WHERE o_totalprice >= hi), 6) AS high_rate FROM orders, q""")
def quartile_event_rates(spark, d):
    o = read(spark, d, "orders")
    q = o.agg(F.percentile("o_totalprice", 0.25).alias("lo"), F.percentile("o_totalprice", 0.75).alias("hi"))
    y = (F.col("o_orderstatus") == "F").cast("double")
    return o.join(F.broadcast(q)).agg(F.round(F.avg(F.when(F.col("o_totalprice") <= F.col("lo"), y)), 6).alias("low_rate"), F.round(F.avg(F.when(F.col("o_totalprice") >= F.col("hi"), y)), 6).alias("high_rate"))


@query("""SELECT event_type, count(*) AS done, round(avg(value), 6) AS mean_s, round(median(value), 6) AS median_s, round(CASE WHEN count(*) >= 2010 THEN 0 ELSE (epoch(max(ts)) - epoch(min(ts))) / count(*) * (2010 - count(*)) END, 3) AS eta_s FROM events GROUP BY 1""")
def stage_progress(spark, d):
    at = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    g = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("done"), F.round(F.avg("value"), 6).alias("mean_s"), F.round(F.median("value"), 6).alias("median_s"), (at(F.max("ts")) - at(F.min("ts"))).alias("e"))
    return g.select("event_type", "done", "mean_s", "median_s", F.round(F.when(F.col("done") >= 2010, 0.0).otherwise(F.col("e") / F.col("done") * (2010 - F.col("done"))), 3).alias("eta_s"))
