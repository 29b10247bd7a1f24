"""Queries for scans, projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean as C
from ..functions import predicates as P
from ..operators import reshape as R
from ..sources import tables as T
from .registry import query, read

MIXED = "CASE c_custkey % 7 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' WHEN 2 THEN 'inf' WHEN 3 THEN 'abc' WHEN 4 THEN ' 12.5 ' WHEN 5 THEN '-3e2' ELSE CAST(c_custkey AS VARCHAR) END"


@query(f"SELECT c_custkey, CASE WHEN isfinite(v) THEN v END AS number FROM (SELECT c_custkey, TRY_CAST(nullif(trim({MIXED}), '') AS DOUBLE) AS v FROM customer)")
def parse_numbers(spark, d):
    return read(spark, d, "customer").select("c_custkey", C.to_number(F.expr(MIXED.replace("VARCHAR", "STRING"))).alias("number"))


WORDS = "CASE c_custkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'maybe' WHEN 3 THEN NULL WHEN 4 THEN 'keep ' ELSE 'robust' END"


@query(f"""SELECT c_custkey, CASE WHEN w IN ('1','true','yes','y','pass','passed','keep','include') THEN true WHEN w IN ('0','false','no','n','fail','failed','drop','exclude') THEN false END AS strict,
coalesce(w IN ('1','true','t','yes','y','pass','passed','keep','include','robust'), false) AS lenient FROM (SELECT c_custkey, lower(trim({WORDS})) AS w FROM customer)""")
def parse_flags(spark, d):
    w = F.expr(WORDS)
    return read(spark, d, "customer").select("c_custkey", C.parse_bool(w).alias("strict"), C.parse_boolish(w).alias("lenient"))


@query("""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderdate END AS a FROM orders)
SELECT o_orderkey, a AS parsed, CAST(floor((epoch(a + to_hours(CAST(o_orderkey % 100 AS INTEGER))) - epoch(a)) / 86400) AS BIGINT) AS days FROM t""")
def parse_dates(spark, d):
    o = read(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("31/12/1999")
    a = C.parse_date(text)
    b = F.timestamp_seconds(F.unix_timestamp(a.cast("timestamp")) + (F.col("o_orderkey") % 100) * 3600)
    return o.select("o_orderkey", a.cast("timestamp_ntz").alias("parsed"), C.days_between(a, b).alias("days"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) + 0.0 END AS positive, CASE WHEN l_discount - 0.05 <> 0 THEN round(l_tax / (l_discount - 0.05), 6) + 0.0 END AS nonzero,
round((coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 0) + l_discount) / (1 + CAST(l_tax > 0 AS INTEGER)), 6) AS mean_there FROM lineitem""")
def guarded_division(spark, d):
    t = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    r = lambda c: F.round(c, 6) + 0.0  # noqa: E731  no negative zero
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(C.divide_positive(F.col("l_tax"), F.col("l_discount"))).alias("positive"), r(C.divide_nonzero(F.col("l_tax"), F.col("l_discount") - 0.05)).alias("nonzero"), r(C.row_mean(t, F.col("l_discount"))).alias("mean_there"))


@query("""SELECT p_partkey, CASE WHEN a OR b THEN 1 WHEN a IS NULL OR b IS NULL THEN NULL ELSE 0 END AS flag, coalesce(nullif(trim(x), ''), nullif(trim(p_name), '')) AS name FROM (
SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size > 25 ELSE false END AS a, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size > 40 END AS b, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_brand END AS x FROM part)""")
def three_valued_flags(spark, d):
    a = F.expr("CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size > 25 ELSE false END")
    b = F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size > 40 END")
    x = F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.col("p_brand"))
    return read(spark, d, "part").select("p_partkey", C.any_flag(a, b).cast("int").alias("flag"), C.first_nonempty(x, F.col("p_name")).alias("name"))


@query("""SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g') AS compact,
CASE WHEN contains(lower(p_name), 'bolt') THEN 'fastener' WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'round' ELSE '' END AS domain, regexp_extract('/x/sub-' || p_partkey || '_ct.nii.gz', 'sub-[A-Za-z0-9]+') AS case_id,
substr(sha1(p_name), 1, 12) AS hash FROM part""")
def text_codes(spark, d):
    both = F.concat_ws(" ", "p_brand", F.concat("p_name", F.lit("!")))
    path = F.concat(F.lit("/x/sub-"), F.col("p_partkey").cast("string"), F.lit("_ct.nii.gz"))
    return read(spark, d, "part").select("p_partkey", C.slug(both).alias("slug"), C.compact(F.concat("p_brand", "p_name")).alias("compact"), C.classify(F.col("p_name"), [("fastener", ["bolt"]), ("round", ["ring", "gear"])]).alias("domain"), C.case_id(path).alias("case_id"), C.short_hash(F.col("p_name")).alias("hash"))


@query("""SELECT event_id, CASE WHEN value * 10 >= 400 THEN 4 WHEN value * 10 >= 300 THEN 3 WHEN value * 10 >= 200 THEN 2 WHEN value * 10 >= 130 THEN 1 ELSE 0 END AS density,
CASE WHEN value <= 0 THEN 0 WHEN value < 2 THEN 1 WHEN value < 3 THEN 2 WHEN value < 4 THEN 3 WHEN value < 5 THEN 4 ELSE 5 END AS thickness,
CASE WHEN event_type = 'view' THEN 'none' WHEN value / 1000 >= 0.05 THEN 'high' WHEN value / 1000 >= 0.01 THEN 'moderate' WHEN value > 0 THEN 'low' ELSE 'none' END AS burden,
round(greatest(-8, least(8, value - 20)), 6) AS clipped, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, value / 100)) AS p FROM events)""")
def step_functions(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", C.density_factor(v * 10).alias("density"), C.thickness_class(v).alias("thickness"), C.burden_class(F.col("event_type") != "view", v / 1000).alias("burden"), F.round(C.clipped(v - 20), 6).alias("clipped"), F.round(C.logit(v / 100), 6).alias("logit"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(lower(p_name), '\\bred\\b') THEN 'red' END, CASE WHEN contains(lower(p_name), 'widg') THEN 'widg' END, CASE WHEN contains(lower(p_name), 'small') THEN 'small' END) AS terms FROM part""")
def term_matching(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(C.matched_terms(F.col("p_name"), ["red", "widg", "small"]), ",").alias("terms"))


@query("SELECT event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS k_sum, min(CAST(props->>'k' AS BIGINT)) AS k_min FROM events GROUP BY 1")
def json_fields(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.min(k).alias("k_min"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderpriority <> '5-LOW' AND o_totalprice > 250000 AND o_custkey <= 700")
def predicate_language(spark, d):
    return P.where_all(read(spark, d, "orders"), ["O_ORDERSTATUS=O,F", "o_orderpriority != 5-LOW", "o_totalprice>250000", "o_custkey <= 700"]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT o_orderstatus, reason, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN o_totalprice < 50000 THEN 'price too low' WHEN o_orderstatus = 'P' THEN 'not final' WHEN o_custkey % 10 = 0 THEN 'excluded customer' ELSE '' END AS reason FROM orders) GROUP BY ALL""")
def row_audit(spark, d):
    reason = F.when(F.col("o_totalprice") < 50000, "price too low").when(F.col("o_orderstatus") == "P", "not final").when(F.col("o_custkey") % 10 == 0, "excluded customer").otherwise("")
    return read(spark, d, "orders").withColumn("reason", reason).groupBy("o_orderstatus", "reason").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS units, n_regionkey FROM nation")
def conform_schema(spark, d):
    df = R.conform(read(spark, d, "nation"), ["n_nationkey", "n_name", "units", "n_regionkey"])
    return df.withColumn("units", F.col("units").cast("string"))


@query("""SELECT o_custkey, CAST(floor(least(n, 2000) / 20) + CASE WHEN t LIKE '%1-urgent%' THEN 100 ELSE 0 END + CASE WHEN t LIKE '%2-high%' THEN 50 ELSE 0 END - CASE WHEN t LIKE '%5-low%' THEN 80 ELSE 0 END AS BIGINT) AS series_score
FROM (SELECT o_custkey, count(*) * 30 AS n, lower(string_agg(DISTINCT o_orderpriority, ' ')) AS t FROM orders GROUP BY 1)""")
def keyword_score(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") * 30).alias("n"), F.array_join(F.collect_set("o_orderpriority"), " ").alias("t"))
    return T.score_series(g, "t", "n", [("1-urgent", 100), ("2-high", 50)], ["5-low"]).select("o_custkey", F.col("series_score").cast("long").alias("series_score"))


@query("""WITH u AS (SELECT n_nationkey AS k, n_name AS name, 0 AS v FROM nation UNION ALL SELECT n_nationkey + 20, 'new ' || n_name, 1 FROM nation WHERE n_regionkey < 2)
SELECT k, arg_max(name, v) AS name FROM u GROUP BY k""")
def upsert_rows(spark, d):
    n, new = (read(spark, d, "nation").where(c).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")) for c in ("true", "n_regionkey < 2"))
    return T.upsert(n, new.select((F.col("k") + 20).alias("k"), F.concat(F.lit("new "), "name").alias("name")), ["k"])
