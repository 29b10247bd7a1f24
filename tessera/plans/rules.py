"""Queries for protocols, domains, ids, checks of runs and volumes, and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as X
from .audits import GROUPS, K, ROLES
from .registry import query, read

TEXT = "CASE p_partkey % 8 WHEN 0 THEN 'CTA Head+Neck' WHEN 1 THEN 'Coronary CTA' WHEN 2 THEN 'MR brain' WHEN 3 THEN ' ' WHEN 4 THEN 'cardiac angio, carotid' WHEN 5 THEN 'Angiography chest' WHEN 6 THEN 'octave brain' END"


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'eligible_neuro_cta' WHEN 1 THEN 'excluded_non_neuro_protocol' WHEN 2 THEN 'missing_cta_or_angiography_term' WHEN 3 THEN 'no_metadata' WHEN 4 THEN 'eligible_neuro_cta' WHEN 5 THEN 'missing_brain_neck_stroke_term' WHEN 6 THEN 'missing_cta_or_angiography_term' ELSE 'no_metadata' END AS reason, p_partkey % 8 IN (0, 4) AS eligible,
CASE p_partkey % 8 WHEN 0 THEN 'cta' WHEN 1 THEN 'cta' WHEN 4 THEN 'angio' WHEN 5 THEN 'angio;angiography' ELSE '' END AS cta_terms, CASE p_partkey % 8 WHEN 0 THEN 'head;neck;head neck;head/neck' WHEN 2 THEN 'brain' WHEN 4 THEN 'carotid' WHEN 6 THEN 'brain' ELSE '' END AS neuro_terms, CASE p_partkey % 8 WHEN 1 THEN 'coronary' WHEN 4 THEN 'cardiac' ELSE '' END AS other_terms FROM part""")
def protocol_eligibility(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.expr(TEXT).alias("Series Description"))
    return X.eligibility(rows).drop("Series Description")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'wall_thickness' WHEN 1 THEN 'calcium' WHEN 2 THEN 'fat' WHEN 3 THEN 'wall_from_fat' ELSE '' END AS outcome_domain, CASE p_partkey % 6 WHEN 0 THEN 'wall_thickness' WHEN 1 THEN 'calcium' WHEN 2 THEN 'fat' WHEN 3 THEN 'wall_from_fat' WHEN 4 THEN 'calcium' ELSE '' END AS score_domain, CASE p_partkey % 6 WHEN 2 THEN 'fat' WHEN 5 THEN 'skeletal' ELSE '' END AS airway_domain FROM part""")
def feature_domains(spark, d):
    name = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'Aorta__wall_thickness_mean' WHEN 1 THEN 'x_calcification' WHEN 2 THEN 'fat_volume' WHEN 3 THEN 'experimental_wall_from_fat_hu' WHEN 4 THEN 'Agatston' ELSE 'Hyoid_fa_t' END")
    return read(spark, d, "part").select("p_partkey", X.domain(name, X.OUTCOME_DOMAINS).alias("outcome_domain"), X.domain(name, X.SCORE_DOMAINS).alias("score_domain"), X.domain(name, X.AIRWAY_DOMAINS, True).alias("airway_domain"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'sub-' || p_partkey WHEN 1 THEN 'case_' || p_partkey || '_b' WHEN 2 THEN 'other' || p_partkey ELSE 'laa_case' END AS case_id FROM part""")
def inferred_cases(spark, d):
    k = F.col("p_partkey").cast("string")
    first = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("/a/sub-"), k, F.lit("_ct.nii.gz"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("/x/case "), k, F.lit(" b_LAA.nrrd"))).when(F.col("p_partkey") % 4 == 3, "//")
    second = F.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("other"), k, F.lit("_mask.nii.gz")))
    return read(spark, d, "part").select("p_partkey", X.inferred_case(first, second).alias("case_id"))


@query("""WITH g AS (SELECT l_orderkey AS k, count(*) AS n, max(l_tax) AS t, min(l_quantity) AS q, max(l_discount) AS m FROM lineitem GROUP BY 1)
SELECT k, concat_ws(';', CASE WHEN n < 2 THEN 'extent' END, CASE WHEN q < 2 THEN 'missing hyoid' END) AS failures, concat_ws(';', CASE WHEN t > 0.07 THEN 'thickness' END, CASE WHEN n < 3 THEN 'no airway' END, CASE WHEN k % 5 = 0 THEN 'truncation' END, CASE WHEN m > 0.09 THEN 'artifact' END) AS warnings,
NOT (n < 2 OR q < 2) AS passed, round(CAST(0.1 * CAST(k % 5 <> 0 AS INTEGER) + 0.4 * CAST(n >= 3 AS INTEGER) + 0.3 * CAST(k % 2 = 0 AS INTEGER) + 0.1 * CAST(q >= 2 AS INTEGER) AS DOUBLE), 6) AS coverage FROM g""")
def volume_quality(spark, d):
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("extent"), F.max("l_tax").alias("thickness"), F.min("l_quantity").alias("q"), F.max("l_discount").alias("artifact_share"))
    g = g.withColumns({"airway": F.col("extent") >= 3, "soft_tissue": F.col("k") % 2 == 0, "hyoid": F.col("q") >= 2, "epiglottis": F.lit(None).cast("boolean"), "truncated": F.col("k") % 5 == 0})
    out = X.volume_quality(g, max_thickness=0.07, least_extent=2, required=["hyoid"], artifact_limit=0.09)
    return out.select("k", "failures", "warnings", "passed", F.round("coverage", 6).alias("coverage"))


@query("""SELECT * FROM (VALUES ('runtime_has_no_blocked_dependency', 'pass', 0), ('validation_splits_recorded', 'pass', 4), ('external_schema_validated', 'fail', 2), ('metadata_columns_protected', 'fail', 1), ('outcome_like_candidate_names_reviewed', 'pass', 0), ('modality_definitions_recorded', 'pass', 3), ('correlation_redundancy_audited', 'pass', 0), ('feature_metadata_audited', 'not_applicable', 0),
('robustness_screening_audited', 'pass', 0), ('stability_resamples_recorded', 'not_applicable', 0), ('nested_elastic_net_tuning_recorded', 'warning', 0), ('final_signature_reproducible', 'warning', 0), ('final_projection_reproducible', 'not_applicable', 0), ('projection_validation_foldwise', 'not_applicable', 0)) t("check", status, n)""")
def run_checks(spark, d):
    o = read(spark, d, "orders")
    counts = X.audit_counts(K.column_audit(o, ROLES, GROUPS), K.schema_audit(o, o.select("o_orderkey", "o_custkey", "o_orderdate"), ROLES, GROUPS))
    return X.run_checks(spark, counts | {"split_rows": 4}, tuned=True, projected=False, metadata=False, robustness=True)


@query()
def cluster_kinds(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("v"))
    out = None
    for kind in ("kmeans", "bisecting", "mixture"):
        one = X.clustered(v, "v", kind, 3).groupBy("cluster").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "cluster", "n")
        out = one if out is None else out.union(one)
    return out
