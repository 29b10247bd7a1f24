"""Queries for cross-fitted models, feature selection by folds and grids of models, over measures of the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assess as A
from ..operators import fits as T
from ..operators import ml as M
from ..storage import materialize
from .aggregates import rounded
from .registry import query, read

FEATURES = ["chars", "words", "digits", "lines", "capitals"]
FOLDS = 4
COHORT = """SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS fold, quality AS y, toxic, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS words,
CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS DOUBLE) AS digits, CASE WHEN doc_id % 9 > 0 THEN CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) END AS lines, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS capitals
FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL"""


def cohort(spark, d):
    j = read(spark, d, "documents").select("doc_id", "text", "lang").join(read(spark, d, "labels"), "doc_id").where("text is not null and quality is not null")
    less = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c)))).cast("double")
    only = lambda p: F.length(F.regexp_replace("text", p, "")).cast("double")
    return j.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("fold"), F.col("quality").alias("y"), "toxic", "lang", F.length("text").cast("double").alias("chars"), less(" ").alias("words"), only("[^0-9]").alias("digits"), F.when(F.col("doc_id") % 9 > 0, less("\n")).alias("lines"), only("[^A-Z]").alias("capitals"))


def whole(spark, d):
    """The cohort without missing values, features on the scale of their logarithms."""
    return cohort(spark, d).withColumns({f: F.log1p(F.coalesce(F.col(f), F.lit(0.0))) for f in FEATURES})


STATS = f"""WITH c AS ({COHORT}), f AS (SELECT unnest(range(4)) AS fold), l AS (SELECT f.fold, y = 1 AS e, feature, x FROM f JOIN (UNPIVOT (SELECT doc_id, fold AS own, y, chars, words, digits, lines, capitals FROM c) ON chars, words, digits, lines, capitals INTO NAME feature VALUE x) u ON u.own <> f.fold),
g AS (SELECT CAST(fold AS INTEGER) AS fold, feature, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS sd, coalesce((avg(x) FILTER (WHERE e) - avg(x) FILTER (WHERE NOT e)) / nullif(sqrt((var_samp(x) FILTER (WHERE e) + var_samp(x) FILTER (WHERE NOT e)) / 2), 0), 0) AS effect FROM l GROUP BY 1, 2),
r AS (SELECT *, sign(effect) AS sign, row_number() OVER (PARTITION BY fold ORDER BY abs(effect) DESC, feature) AS rank FROM g)"""


@query(STATS + " SELECT fold, feature, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(effect, 6) AS effect, CAST(sign AS DOUBLE) AS sign, rank FROM r")
def fold_statistics(spark, d):
    out = T.fold_statistics(cohort(spark, d), "fold", FOLDS, FEATURES, "y")
    return rounded(rounded(out, ("mean", "sd"), 5), ("effect",))


@query(STATS + """, z AS (SELECT doc_id, r.fold, sign * greatest(-8, least(8, (x - mean) / sd)) AS z FROM (UNPIVOT (SELECT doc_id, fold AS own, chars, words, digits, lines, capitals FROM c) ON chars, words, digits, lines, capitals INTO NAME feature VALUE x) u JOIN r ON r.fold = u.own AND r.feature = u.feature WHERE rank <= 3 AND sd > 0)
SELECT doc_id, fold, round(avg(z), 5) + 0.0 AS score FROM (SELECT c.doc_id, c.fold, z FROM c LEFT JOIN z USING (doc_id)) GROUP BY 1, 2""")
def signed_fold_scores(spark, d):
    c = cohort(spark, d)
    out = T.signed_scores(c, ["doc_id"], "fold", T.fold_statistics(c, "fold", FOLDS, FEATURES, "y"), FEATURES, 3)
    return out.withColumn("score", F.round("score", 5) + 0.0)


@query()
def out_of_fold_scores(spark, d):
    return rounded(T.out_of_fold(whole(spark, d), "fold", FOLDS, FEATURES, "y").select("doc_id", "fold", "score"), ("score",))


@query()
def recalibrated_scores(spark, d):
    scored = whole(spark, d).withColumn("score", F.least(F.lit(1.0), F.col("chars") / 12))
    return rounded(T.recalibrated(scored, "fold", FOLDS, "score", "y").select("doc_id", "score", "recalibrated"), ("score", "recalibrated"))


@query()
def fold_auc(spark, d):
    return rounded(T.cross_validated_auc(whole(spark, d), "fold", FOLDS, ["chars", "digits"], "y"), ("auc",))


@query()
def odds_screen(spark, d):
    return rounded(T.screen(whole(spark, d), "doc_id", FEATURES, ["y", "toxic"]), ("ratio", "low", "high", "p", "q"), 5)


@query()
def reference_odds(spark, d):
    langs = sorted(r.lang for r in cohort(spark, d).select("lang").distinct().collect())  # a few languages
    return rounded(T.against_reference(whole(spark, d), "lang", langs, langs[0], "y", ["chars"]), ("ratio", "low", "high", "p"), 5)


@query()
def hazard_ratios(spark, d):
    df = whole(spark, d).withColumn("time", F.col("doc_id") % 50 + 1).withColumn("_all", F.lit(1))
    model = T.hazards(df, ["_all"], ["digits", "lines"], "time", "y")
    return rounded(T.effects(spark, model, "_all int", ["digits", "lines"]).drop("_all"), ("ratio", "low", "high", "p"), 5)


@query()
def feature_information(spark, d):
    return rounded(T.mutual_information(cohort(spark, d), FEATURES, "y"), ("mi",))


GROUPS = {"size": ["chars", "words", "lines"], "marks": ["digits", "capitals"], "combined": FEATURES}


@query()
def fold_selection(spark, d):
    return rounded(T.fold_selection(whole(spark, d), "fold", FOLDS, {g: GROUPS[g] for g in ("size", "combined")}, "y", 2), ("auc",))


@query()
def final_signature(spark, d):
    return T.signature(T.fold_selection(whole(spark, d), "fold", FOLDS, {"marks": GROUPS["marks"]}, "y", 1), FOLDS, 0.5)


@query()
def tuned_net(spark, d):
    return rounded(T.tuned(whole(spark, d), "fold", 2, ["chars", "digits", "lines"], "y", [0.1, 10.0], [0.5]), ("auc",), 4).drop("features")


@query()
def domain_scores(spark, d):
    matrix, _ = T.prepared(cohort(spark, d), ["doc_id"], FEATURES)
    return rounded(T.domain_components(matrix, ["doc_id"], {g: GROUPS[g] for g in ("size", "marks")}, 1)[0], ("size_1", "marks_1"))


@query()
def domain_ranking(spark, d):
    matrix, _ = T.prepared(cohort(spark, d), ["doc_id"], FEATURES)
    return rounded(T.domain_ranking(T.domain_components(matrix, ["doc_id"], {g: GROUPS[g] for g in ("size", "marks")}, 2)[1]), ("importance",))


@query()
def balanced_choice(spark, d):
    """Features chosen from the groups in turn, by information less redundancy, and the silhouette of k-means over equally weighted blocks of them."""
    c = cohort(spark, d)
    matrix, _ = T.prepared(c, ["doc_id"], FEATURES)
    ranked = T.domain_ranking(T.domain_components(matrix, ["doc_id"], {g: GROUPS[g] for g in ("size", "marks")}, 1)[1]).orderBy("domain", "place").collect()  # a row a feature
    order = {g: [r.feature for r in ranked if r.domain == g] for g in ("size", "marks")}
    pairs = [(r.a, r.b, r.r) for r in M.correlations(matrix, FEATURES).collect()]
    quality = {r.feature: r.mi for r in T.mutual_information(c, FEATURES, "y").collect()}
    chosen = T.alternating_choice(order, pairs, quality, 1, 3, 0.2)
    return rounded(spark.createDataFrame(chosen, "domain string, feature string, gain double"), ("gain",))


@query()
def integrated_clusters(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    matrix, _ = T.prepared(cohort(spark, d), ["doc_id"], FEATURES)
    rows = T.block_weighted(matrix, ["doc_id"], [GROUPS["size"], GROUPS["marks"]]).withColumn("features", array_to_vector("vector"))
    out = KMeans(k=3, seed=7, maxIter=20).fit(rows).transform(rows)
    return out.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS ({COHORT}), p AS (SELECT 'chars' AS a, 'words' AS b, corr(chars, words) AS r, count(*) AS n FROM c UNION ALL SELECT 'lines', 'digits', corr(lines, digits), count(lines) FROM c) SELECT a, b, round(r, 6) AS r, n FROM p UNION ALL SELECT 'chars', 'flat', NULL, count(*) FROM c""")
def pair_correlations(spark, d):
    df = cohort(spark, d).withColumn("flat", F.lit(1.0))
    return rounded(A.pairwise_correlation(df, [("chars", "words"), ("lines", "digits"), ("chars", "flat")]), ("r",))


PERF = f"""WITH c AS ({COHORT}), l AS (SELECT y = 1 AS e, 'chars' AS score, chars AS v FROM c UNION ALL SELECT y = 1, 'lines', lines FROM c WHERE lines IS NOT NULL), q AS (SELECT score, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM l GROUP BY 1),
r AS (SELECT *, rank() OVER (PARTITION BY score ORDER BY v) + (count(*) OVER (PARTITION BY score, v) - 1) / 2.0 AS k FROM l), a AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE e) AS events, (sum(k) FILTER (WHERE e) - count(*) FILTER (WHERE e) * (count(*) FILTER (WHERE e) + 1) / 2.0) / (count(*) FILTER (WHERE e) * count(*) FILTER (WHERE NOT e)) AS auc FROM r GROUP BY 1),
g AS (SELECT score, v, count(*) AS n, count(*) FILTER (WHERE e) AS e FROM l GROUP BY 1, 2), w AS (SELECT score, e, sum(e) OVER o / sum(n) OVER o AS p FROM g WINDOW o AS (PARTITION BY score ORDER BY v DESC)), ap AS (SELECT score, sum(e * p) / sum(e) AS ap FROM w GROUP BY 1),
h AS (SELECT l.score, avg(CAST(e AS INTEGER)) FILTER (WHERE v <= lo) AS low_rate, avg(CAST(e AS INTEGER)) FILTER (WHERE v >= hi) AS high_rate FROM l JOIN q USING (score) GROUP BY 1)"""


@query(PERF + " SELECT score, n, events, round(auc, 6)::DOUBLE AS auc, round(greatest(auc, 1 - auc), 6)::DOUBLE AS auc_directional, round(ap, 6)::DOUBLE AS average_precision, round(low_rate, 6) AS low_rate, round(high_rate, 6) AS high_rate FROM a JOIN ap USING (score) JOIN h USING (score)")
def performance_table(spark, d):
    return rounded(A.performance(cohort(spark, d), ["chars", "lines"], "y"), ("auc", "auc_directional", "average_precision", "low_rate", "high_rate"))


@query(PERF + " SELECT score AS feature, round(abs(auc - 0.5), 6)::DOUBLE AS relevance, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS sign FROM a")
def feature_relevance(spark, d):
    return rounded(A.relevance(cohort(spark, d), ["chars", "lines"], "y", "binary"), ("relevance",))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey, (row_number() OVER (ORDER BY n DESC, CAST(l_suppkey AS VARCHAR)) - 1) % 10 AS lap FROM s) SELECT CAST(CASE WHEN lap < 5 THEN lap ELSE 9 - lap END AS INTEGER) AS fold, count(*) AS n FROM lineitem JOIN r USING (l_suppkey) GROUP BY 1""")
def group_folds(spark, d):
    return A.splits(read(spark, d, "lineitem"), ["l_orderkey"], 5, group="l_suppkey").groupBy("fold").agg(F.count("*").alias("n"))


@query()
def selector_stability(spark, d):
    return A.stability(whole(spark, d), "doc_id", FEATURES, "y", 20, 0.6, 2, 0.5)


@query()
def fitted_selector(spark, d):
    rows = A.fit_selector(whole(spark, d).where("fold <> 0"), FEATURES, "y", top=4)
    return rounded(spark.createDataFrame(rows, "feature string, relevance double, weight double"), ("relevance", "weight"), 4)


@query()
def calibration_summary(spark, d):
    scored = T.out_of_fold(whole(spark, d), "fold", FOLDS, ["chars", "digits"], "y")
    return rounded(A.calibration_summary(scored, "score", "y"), ("rate", "mean_p", "brier", "ece", "intercept", "slope"))


@query()
def threshold_odds(spark, d):
    return rounded(A.threshold_odds(whole(spark, d), ["digits", "lines"], "y", {"median": 0.5, "top": 0.75}, ["chars"]), ("cut", "ratio", "low", "high", "p"), 5)


@query()
def spread_odds(spark, d):
    return rounded(A.spread_odds(cohort(spark, d), ["digits", "chars"], {"good": F.col("y"), "toxic": F.col("toxic")}), ("iqr", "ratio", "low", "high", "p"), 5)


@query()
def cluster_grid(spark, d):
    measured = materialize(cohort(spark, d).select("doc_id", *FEATURES), "cohort")  # texts are read once
    matrix, _ = T.prepared(measured, ["doc_id"], FEATURES)
    rows = T.block_weighted(matrix, ["doc_id"], [GROUPS["size"], GROUPS["marks"]])
    return rounded(A.cluster_grid(rows, "doc_id", "vector", [2, 3]), ("cost", "silhouette"), 4)
