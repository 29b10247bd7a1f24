"""Queries for predictions, curves, record linkage and quality rules of a cohort."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import clean as C
from ..operators import evaluate as E
from ..operators import geometry as G
from ..operators import masks as K
from ..operators import voxel as V
from .aggregates import rounded
from .registry import query, read
from .voxels import BALL, GRID, MOVED, SPACING, ball, grid

SCORED = "SELECT l.quality = 1 AS e, least(1.0, d.n_chars / 8000.0) AS s, d.lang AS lang FROM documents d JOIN labels l USING (doc_id)"


def scored(spark, d):
    j = read(spark, d, "documents").select("doc_id", "n_chars", "lang").join(read(spark, d, "labels"), "doc_id")
    return j.select((F.col("quality") == 1).alias("e"), F.least(F.lit(1.0), F.col("n_chars") / 8000.0).alias("s"), "lang")


@query(f"""SELECT lang, count(*) AS n, round(avg(CASE WHEN (s >= 0.5) = e THEN 1.0 ELSE 0 END), 6) AS accuracy, round((avg(CASE WHEN s >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE e) + avg(CASE WHEN s < 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT e)) / 2, 6) AS balanced_accuracy, round(avg(power(s - CAST(e AS INTEGER), 2)), 6) AS brier FROM ({SCORED}) GROUP BY 1""")
def class_metrics(spark, d):
    return rounded(E.class_metrics(scored(spark, d), ["lang"], F.col("s"), F.col("e")), ("accuracy", "balanced_accuracy", "brier"))


@query(f"""WITH b AS (SELECT lang, least(9, floor(s * 10)) AS b, count(*) AS n, avg(s) AS p, avg(CAST(e AS INTEGER)) AS r FROM ({SCORED}) GROUP BY 1, 2) SELECT lang, round(sum(n * abs(p - r)) / sum(n), 6) AS ece FROM b GROUP BY 1""")
def calibration_error(spark, d):
    return rounded(E.expected_calibration_error(scored(spark, d), ["lang"], F.col("s"), F.col("e")), ("ece",))


@query(f"""WITH g AS (SELECT lang, s, count(*) AS n, count(*) FILTER (WHERE e) AS e FROM ({SCORED}) GROUP BY 1, 2), c AS (SELECT lang, e, sum(e) OVER w / sum(n) OVER w AS p FROM g WINDOW w AS (PARTITION BY lang ORDER BY s DESC)) SELECT lang, round(sum(e * p) / sum(e), 6) AS average_precision FROM c GROUP BY 1""")
def average_precision(spark, d):
    return rounded(E.average_precision(scored(spark, d), ["lang"], "s", "e"), ("average_precision",))


@query("""SELECT l_returnflag AS f, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 4) AS mae, round(sqrt(avg(power(l_quantity * 1500 - l_extendedprice, 2))), 4) AS rmse, round(1 - avg(power(l_quantity * 1500 - l_extendedprice, 2)) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem GROUP BY 1""")
def regression_metrics(spark, d):
    r = E.regression_metrics(read(spark, d, "lineitem").withColumn("f", F.col("l_returnflag")), ["f"], F.col("l_quantity") * 1500, F.col("l_extendedprice"))
    return rounded(rounded(r, ("mae", "rmse"), 4), ("r2",))


@query()
def bootstrap_interval(spark, d):
    return rounded(E.bootstrap_mean(read(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", "o_orderkey", 100), ("mean", "low", "high"), 4)


@query("""WITH f AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS a, bool_or(o_orderstatus = 'P') AS b, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS da, min(o_orderdate) FILTER (WHERE o_orderstatus = 'P') AS db, min(o_orderdate) AS start FROM orders GROUP BY 1)
SELECT o_custkey, CAST(a OR b AS INTEGER) AS event, concat_ws(';', CASE WHEN a THEN 'final' END, CASE WHEN b THEN 'pending' END) AS components, strftime(least(da, db), '%Y-%m-%d') AS first_date, CAST(floor((epoch(least(da, db)) - epoch(start)) / 86400) AS BIGINT) AS days FROM f""")
def derived_outcomes(spark, d):
    flag = lambda s: F.bool_or(F.col("o_orderstatus") == s)
    at = lambda s: F.min(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    g = read(spark, d, "orders").groupBy("o_custkey").agg(flag("F").alias("a"), flag("P").alias("b"), at("F").alias("da"), at("P").alias("db"), F.min("o_orderdate").alias("start"))
    first = F.least("da", "db")
    return g.select("o_custkey", C.any_flag(F.col("a"), F.col("b")).cast("int").alias("event"), F.concat_ws(";", F.when(F.col("a"), "final"), F.when(F.col("b"), "pending")).alias("components"), F.date_format(first, "yyyy-MM-dd").alias("first_date"), C.days_between(F.col("start"), first).alias("days"))


@query("""SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY (CASE WHEN p_size > 10 THEN 1 ELSE 0 END) + (CASE WHEN p_name LIKE 'red%' THEN 1 ELSE 0 END) DESC, length(p_name), p_partkey) = 1""")
def preferred_duplicates(spark, d):
    score = (F.col("p_size") > 10).cast("int") + F.col("p_name").startswith("red").cast("int")
    best = F.min_by(F.struct("p_partkey", "p_size"), F.struct(-score, F.length("p_name"), F.col("p_partkey")))
    return read(spark, d, "part").groupBy("p_brand", "p_type").agg(best.alias("r")).select("p_brand", "r.p_partkey", "r.p_size")


@query("""WITH g AS (SELECT l_orderkey AS k, count(*) AS n, max(l_tax) AS t, min(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT k, concat_ws(';', CASE WHEN n < 2 THEN 'extent' END, CASE WHEN q < 2 THEN 'landmark' END) AS failures, concat_ws(';', CASE WHEN t > 0.07 THEN 'thickness' END) AS warnings, NOT (n < 2 OR q < 2) AS passed, round(CAST(0.4 * CAST(n >= 2 AS INTEGER) + 0.3 * CAST(q >= 2 AS INTEGER) + 0.3 * CAST(t <= 0.07 AS INTEGER) AS DOUBLE), 6) AS coverage FROM g""")
def quality_rules(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.max("l_tax").alias("t"), F.min("l_quantity").alias("q"))
    n, q, t = F.col("n") >= 2, F.col("q") >= 2, F.col("t") <= 0.07
    weigh = lambda c, w: F.lit(w) * c.cast("int")
    return g.select("k", F.concat_ws(";", F.when(~n, "extent"), F.when(~q, "landmark")).alias("failures"), F.concat_ws(";", F.when(~t, "thickness")).alias("warnings"), (n & q).alias("passed"), F.round(weigh(n, 0.4) + weigh(q, 0.3) + weigh(t, 0.3), 6).alias("coverage"))


@query(f"""{GRID}, e AS (SELECT case_id, y AS angle, max(x) AS r FROM v WHERE hu > 100 GROUP BY 1, 2), w AS (SELECT case_id, (angle + o + 12) % 12 AS angle, r FROM e, (SELECT unnest([-2, -1, 0, 1, 2]) AS o)) SELECT case_id, CAST(angle AS INTEGER) AS angle, median(r)::DOUBLE AS expected FROM w GROUP BY 1, 2""")
def circular_medians(spark, d):
    e = grid(spark, d).where("hu > 100").groupBy("case_id", F.col("y").alias("angle")).agg(F.max("x").alias("r"))
    return G.circular_median(e, ["case_id"], "angle", "r", 12, 2)


@query(f"""{GRID}, c AS (SELECT case_id, z AS o, 3.0 * z AS z, avg(y) AS y, avg(x) AS x FROM v WHERE hu > 100 GROUP BY 1, 2),
g1 AS (SELECT case_id, o, {', '.join(f"CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2 END AS {c}1" for c in 'zyx')} FROM c WINDOW w AS (PARTITION BY case_id ORDER BY o)),
h AS (SELECT case_id, o, z1, y1, x1, {', '.join(f"CASE WHEN lag({c}1) OVER w IS NULL THEN lead({c}1) OVER w - {c}1 WHEN lead({c}1) OVER w IS NULL THEN {c}1 - lag({c}1) OVER w ELSE (lead({c}1) OVER w - lag({c}1) OVER w) / 2 END AS {c}2" for c in 'zyx')} FROM g1 WINDOW w AS (PARTITION BY case_id ORDER BY o))
SELECT case_id, o, round(sqrt(power(y1 * x2 - x1 * y2, 2) + power(x1 * z2 - z1 * x2, 2) + power(z1 * y2 - y1 * z2, 2)) / power(sqrt(z1 * z1 + y1 * y1 + x1 * x1), 3), 6) AS curvature FROM h""")
def centerline_curvature(spark, d):
    c = grid(spark, d).where("hu > 100").groupBy("case_id", F.col("z").alias("o")).agg(F.avg("y").alias("y"), F.avg("x").alias("x")).withColumn("z", 3.0 * F.col("o"))
    return rounded(G.curvature(c, ["case_id"], "o").select("case_id", "o", "curvature"), ("curvature",))


def surface(rule):
    """SQL for voxels of a rule's ball that lack one of their six neighbours."""
    near = [re.sub(rf"\b{c}\b", f"({c} {o} 1)", rule) for c in "zyx" for o in "+-"]
    return f"({rule}) AND NOT ({' AND '.join(near)})"


@query(f"""{GRID}, a AS (SELECT * FROM v WHERE {surface(BALL)}), b AS (SELECT * FROM v WHERE {surface(MOVED)} AND case_id <> 1),
d AS (SELECT a.case_id, 0 AS side, a.z, a.y, a.x, min(sqrt(power(3.0 * (a.z - b.z), 2) + power(2.0 * (a.y - b.y), 2) + power(1.0 * (a.x - b.x), 2))) AS d FROM a JOIN b USING (case_id) GROUP BY ALL UNION ALL SELECT a.case_id, 1, b.z, b.y, b.x, min(sqrt(power(3.0 * (a.z - b.z), 2) + power(2.0 * (a.y - b.y), 2) + power(1.0 * (a.x - b.x), 2))) FROM a JOIN b USING (case_id) GROUP BY ALL),
s AS (SELECT case_id, side, quantile_cont(d, 0.95) AS p, count(*) FILTER (WHERE d <= 1) AS c, count(*) AS n FROM d GROUP BY 1, 2) SELECT case_id, round(max(p), 6) AS hd95, round(sum(c) / sum(n), 6) AS surface_dice FROM s GROUP BY 1 UNION ALL SELECT 1, -1, 0""")
def mask_distances(spark, d):
    out = G.surface_distances(ball(spark, d), ball(spark, d, MOVED).where("case_id <> 1"), SPACING, 1.0)
    return rounded(out.withColumn("hd95", F.when(F.col("hd95") < float("inf"), F.col("hd95")).otherwise(-1.0)), ("hd95", "surface_dice"))


@query()
def branch_links(spark, d):
    c = K.components(grid(spark, d).where("hu >= 380")).groupBy("case_id", "z", "component").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    linked = G.link_branches(c, 3.0)
    return linked.groupBy("case_id", "branch").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))
