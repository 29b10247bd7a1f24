"""Queries for scores, selection, clustering and odds ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators import score as S
from .aggregates import rounded
from .registry import query, read

FEATURES = ["price", "discount", "items"]
WEIGHTS = {"price": 0.5, "discount": -1.0, "items": 2.0}
ORDERS = "SELECT l_orderkey AS k, sum(l_extendedprice) AS price, nullif(max(l_discount), 0.05) AS discount, CAST(count(*) AS DOUBLE) AS items, min(l_shipdate) < TIMESTAMP '1998-01-01' AS train FROM lineitem GROUP BY 1"
FIT = f"""WITH w AS ({ORDERS}), long AS (SELECT k, train, unnest(['price','discount','items']) AS feature, unnest([price, discount, items]) AS value FROM w),
med AS (SELECT feature, median(value) AS median FROM long WHERE train GROUP BY 1),
par AS (SELECT l.feature, any_value(median) AS median, avg(coalesce(value, median)) AS mean, stddev_pop(coalesce(value, median)) AS std, any_value(CASE l.feature WHEN 'price' THEN 0.5 WHEN 'discount' THEN -1.0 ELSE 2.0 END) AS weight FROM long l JOIN med USING (feature) WHERE train GROUP BY 1)"""


def order_features(spark, d):
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("price"), F.nullif(F.max("l_discount"), F.lit(0.05)).alias("discount"), F.count("*").cast("double").alias("items"), (F.min("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'")).alias("train"))


@query(f"{FIT} SELECT k, round(sum(weight * CASE WHEN std > 0 THEN (coalesce(value, median) - mean) / std ELSE 0 END) / sum(abs(weight)), 6) AS score FROM long JOIN par USING (feature) GROUP BY 1")
def composite_scores(spark, d):
    rows = order_features(spark, d)
    return rounded(S.apply_parameters(rows, S.fit_parameters(rows.where("train"), FEATURES, WEIGHTS), "k", FEATURES), ("score",))


@query(f"{FIT} SELECT feature, round(median, 4) AS median, round(mean, 4) AS mean, round(std, 4) AS std, CAST(weight AS DOUBLE) AS weight FROM par")
def score_parameters(spark, d):
    rows = order_features(spark, d)
    return rounded(S.fit_parameters(rows.where("train"), FEATURES, WEIGHTS), ("median", "mean", "std"), 4)


@query(f"""{FIT}, proj AS (SELECT feature, median, mean, std, 1 AS component, 0.6 AS w FROM par UNION ALL SELECT feature, median, mean, std, 2, CASE feature WHEN 'price' THEN 1.0 ELSE -0.5 END FROM par)
SELECT k, round(sum(w * (coalesce(value, median) - mean) / std) FILTER (WHERE component = 1), 6) AS component_1, round(sum(w * (coalesce(value, median) - mean) / std) FILTER (WHERE component = 2), 6) AS component_2 FROM long JOIN proj USING (feature) GROUP BY 1""")
def projection_scores(spark, d):
    rows = order_features(spark, d)
    par = S.fit_parameters(rows.where("train"), FEATURES, WEIGHTS).drop("weight")
    par = par.withColumn("component", F.lit(1)).withColumn("weight", F.lit(0.6)).union(par.withColumn("component", F.lit(2)).withColumn("weight", F.when(F.col("feature") == "price", 1.0).otherwise(-0.5)))
    return rounded(S.apply_projection(rows, par, "k", FEATURES, [1, 2]), ("component_1", "component_2"))


@query(f"""{FIT} SELECT k, round(CASE WHEN count(*) FILTER (WHERE value IS NULL) = 0 THEN avg(CASE WHEN std > 0 AND feature <> 'items' THEN (CASE feature WHEN 'price' THEN 1 ELSE -1 END) * (value - mean) / std END) END, 6) AS composite FROM long JOIN par USING (feature) GROUP BY 1""")
def directed_composite(spark, d):
    rows = order_features(spark, d)
    par = S.fit_parameters(rows.where("train"), FEATURES, WEIGHTS)
    stats = par.select("feature", "mean", F.when(F.col("feature") != "items", F.col("std")).alias("std"), F.when(F.col("feature") == "price", 1).otherwise(-1).alias("direction"))
    from ..operators.reshape import wide_to_long

    return rounded(S.composite(wide_to_long(rows, ["k"], FEATURES), "k", stats), ("composite",))


@query(f"""WITH w AS ({ORDERS}), l AS (SELECT unnest(['price','discount','items']) AS feature, unnest([price, discount, items]) AS value FROM w)
SELECT feature, count(value) AS n, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS missing, round(var_samp(value), 4) AS variance, count(DISTINCT round(value, 4)) AS n_distinct FROM l GROUP BY 1""")
def usable_features(spark, d):
    rows = order_features(spark, d).select(*[F.round(f, 4).alias(f) for f in FEATURES])
    return M.feature_report(rows, FEATURES).select("feature", "n", F.round("missing", 6).alias("missing"), F.round("variance", 4).alias("variance"), "n_distinct")


@query("""SELECT a, b, round(r, 6) AS r, n FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount), count(*) FROM lineitem)""")
def correlation_matrix(spark, d):
    return rounded(M.correlations(read(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), ("r",))


@query("""SELECT quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold, doc_id FROM labels""")
def stratified_folds(spark, d):
    return M.stratified_fold(read(spark, d, "labels").select("quality", "doc_id"), "quality", ["doc_id"], 5)


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e, label FROM embeddings), m AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(array_distance(a.e, b.e)) AS m FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, la, max(m) FILTER (WHERE la = lb) AS a, min(m) FILTER (WHERE la <> lb) AS b FROM m GROUP BY 1, 2)
SELECT vec_id, la AS label, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM s""")
def silhouette(spark, d):
    return rounded(M.silhouette(read(spark, d, "embeddings"), "vec_id", "embedding", "label"), ("s",))


@query("""WITH t AS (SELECT event_type, value > 20 AS x, user_id % 3 = 0 AS y FROM events), c AS (SELECT event_type, count(*) FILTER (WHERE x AND y) AS a, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c, count(*) FILTER (WHERE NOT x AND NOT y) AS d FROM t GROUP BY 1), h AS (SELECT *, CASE WHEN least(a, b, c, d) = 0 THEN 0.5 ELSE 0 END AS o FROM c)
SELECT event_type, a, b, c, d, round((a + o) * (d + o) / ((b + o) * (c + o)), 6) AS odds_ratio, round(sqrt(1 / (a + o) + 1 / (b + o) + 1 / (c + o) + 1 / (d + o)), 6) AS se FROM h""")
def odds_ratios(spark, d):
    return rounded(M.two_by_two(read(spark, d, "events"), ["event_type"], F.col("value") > 20, F.col("user_id") % 3 == 0), ("odds_ratio", "se"))


@query()
def stability_selection(spark, d):
    rows = order_features(spark, d).withColumn("y", (F.col("k") % 3 == 0).cast("int"))
    return M.stability(rows, "k", FEATURES, "y", rounds=20, share=0.6, top=1)


@query()
def principal_components(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    _, loadings, share = M.covariance_components(read(spark, d, "lineitem"), names, 3)
    rows = [(f, c + 1, round(float(loadings[i, c]), 6), round(float(share[c]), 6)) for i, f in enumerate(names) for c in range(3)]
    return spark.createDataFrame(rows, "feature string, component int, loading double, share double")


@query()
def logistic_odds(spark, d):
    rows = read(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("size")).join(read(spark, d, "labels"), "doc_id").select("size", F.col("quality").cast("double").alias("y"))
    model = M.logistic(rows, ["size"], "y")
    s = model.summary
    return spark.createDataFrame([("size", round(float(model.coefficients[0]), 6), round(float(s.coefficientStandardErrors[0]), 6), round(float(s.pValues[0]), 6))], "feature string, log_odds double, se double, p double")


@query()
def kmeans_costs(spark, d):
    from pyspark.ml.functions import array_to_vector

    v = read(spark, d, "embeddings").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return M.kmeans_grid(v, "v", [2, 4, 8])
