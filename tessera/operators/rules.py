"""Rule tables: protocols from metadata, domains of features, ids of cases, checks of a run and of volumes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that tell an angiography, a study of brain or neck, and one of other parts; columns whose text counts.
ANGIOGRAPHY_TERMS = ("cta", "ct angiography", "ct angiogram", "computed tomography angiography", "angio", "angiography", "angiogram")
NEURO_TERMS = (
    "brain", "head", "neck", "head neck", "head/neck", "head and neck", "carotid", "vertebral", "cerebral", "intracranial", "circle of willis", "willis",
    "arch to vertex", "stroke", "acute stroke", "hyperacute", "hypercute", "hyper acute", "code stroke",
)
OTHER_TERMS = ("coronary", "cardiac", "pulmonary embol", "pe protocol", "runoff", "lower extremity", "abdomen", "pelvis", "tavr")
TEXT_COLUMNS = (
    "series_description", "seriesdescription", "protocol_name", "protocolname", "study_description", "studydescription", "requested_procedure_description",
    "requestedproceduredescription", "body_part_examined", "bodypartexamined", "modality", "acquisition", "acquisition_label", "scan_options", "scanoptions",
    "image_type", "imagetype",
)
# Domains of imaging features by parts of their names, and of airway features by beginnings, the first that fits.
OUTCOME_DOMAINS = (("wall_thickness", ("wall_thickness",)), ("wall_from_fat", ("wall_from_fat", "experimental_wall_from_fat")), ("calcium", ("calcium", "calcification")), ("fat", ("fat", "periaortic")))
SCORE_DOMAINS = (("wall_thickness", ("wall_thickness", "wall_gt4mm")), ("wall_from_fat", ("wall_from_fat", "experimental_wall_from_fat")), ("calcium", ("calcium", "calcification", "agatston")), ("fat", ("fat", "periaortic")))
AIRWAY_DOMAINS = (
    ("airway", ("airway_", "retropalatal_", "retroglossal_", "retrolingual_", "nasopharyngeal_", "hypopharyngeal_")),
    ("tongue", ("tongue_", "lingual_tonsil_")),
    ("fat", ("fat_",)),
    ("skeletal", ("hyoid_", "mandible_", "mandibular_", "cervicomandibular_", "neck_", "skeletal_", "laryngeal_", "hard_palate_", "posterior_nasal_spine_")),
    ("soft_tissue", ("soft_palate_", "uvula_", "palatine_tonsil_", "lateral_pharyngeal_", "lateral_wall_")),
)
# What a case's coverage counts for.
COVERAGE = (("airway", 0.4), ("soft_tissue", 0.3), ("hyoid", 0.1), ("epiglottis", 0.1))


def normalized(x: Column) -> Column:
    """Small letters and digits, all else as single blanks."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def terms_in(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a normalized text holds: those of up to three letters as words, others anywhere."""
    hits = []
    for t in terms:
        plain = re.sub("[^a-z0-9]+", " ", t.lower()).strip()
        if plain:
            hits.append(F.when(F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {plain} ") if len(plain) <= 3 else text.contains(plain), F.lit(t)))
    return F.array_compact(F.array(*hits))


def eligibility(df: DataFrame, *, sidecar: str | None = None, wanted: Sequence[str] = (), unwanted: Sequence[str] = (), allow_missing: bool = False) -> DataFrame:
    """``df`` with eligible, reason and the terms found in its text columns and the ``sidecar`` column's text, by the first rule that holds."""
    names = [c for c in df.columns if re.sub("[^a-z0-9]+", "_", c.lower()).strip("_") in TEXT_COLUMNS] + ([sidecar] if sidecar else [])
    text = normalized(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in names])) if names else F.lit("")
    out = df.withColumn("_t", text)
    t = F.col("_t")
    out = out.withColumns({"cta_terms": terms_in(t, ANGIOGRAPHY_TERMS), "neuro_terms": terms_in(t, (*NEURO_TERMS, *wanted)), "other_terms": terms_in(t, (*OTHER_TERMS, *unwanted))})
    has = lambda c: F.size(c) > 0
    reason = (
        F.when(t == "", "missing_metadata_allowed" if allow_missing else "no_metadata")
        .when(has("other_terms") & ~has("neuro_terms"), "excluded_non_neuro_protocol")
        .when(~has("cta_terms"), "missing_cta_or_angiography_term")
        .when(~has("neuro_terms"), "missing_brain_neck_stroke_term")
        .otherwise("eligible_neuro_cta")
    )
    lists = {c: F.array_join(c, ";") for c in ("cta_terms", "neuro_terms", "other_terms")}
    return out.withColumn("reason", reason).withColumn("eligible", F.col("reason").isin("missing_metadata_allowed", "eligible_neuro_cta")).withColumns(lists).drop("_t")


def domain(name: Column, rules: Sequence[tuple[str, Sequence[str]]], starts: bool = False) -> Column:
    """The first domain one of whose parts the name holds, or begins with; "" where none fits."""
    n = F.lower(name)
    out = None
    for d, parts in rules:
        hit = F.lit(False)
        for p in parts:
            hit = hit | (n.startswith(p) if starts else n.contains(p))
        out = F.when(hit, d) if out is None else out.when(hit, d)
    return out.otherwise("")


def inferred_case(*names: Column, default: str = "laa_case") -> Column:
    """Of the first name that gives one: ``sub-...`` in its stem, else the stem without the ending of a mask, other marks as underscores."""
    found = []
    for name in names:
        file = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)$", 1)
        stem = F.when(file.endswith(".nii.gz"), F.regexp_replace(file, r"\.nii\.gz$", "")).otherwise(F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""))
        cleaned = F.regexp_replace(stem, r"(?i)(_whole_laa|_type1|_laa|_mask|_seg(mentation)?|_cta|_ct)$", "")
        cleaned = F.regexp_replace(F.regexp_replace(cleaned, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
        found += [F.nullif(F.regexp_extract(stem, "(sub-[A-Za-z0-9]+)", 1), F.lit("")), F.nullif(cleaned, F.lit(""))]
    return F.coalesce(*found, F.lit(default))


def volume_quality(cases: DataFrame, *, max_thickness: float, least_extent: float, required: Sequence[str] = (), artifact_limit: float = 0.01) -> DataFrame:
    """``cases`` (thickness, extent, truncated, artifact_share and a boolean for each of ``COVERAGE``) with failures, warnings, passed and coverage: no failure passes, missing flags count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    failures = [F.when(F.col("extent") < least_extent, "extent"), *[F.when(~flag(r), f"missing {r}") for r in required]]
    warnings = [F.when(F.col("thickness") > max_thickness, "thickness"), F.when(~flag("airway"), "no airway"), F.when(flag("truncated"), "truncation"), F.when(F.col("artifact_share") > artifact_limit, "artifact")]
    score = F.when(~flag("truncated"), 0.1).otherwise(0.0)
    for name, weight in COVERAGE:
        score = score + F.when(flag(name), weight).otherwise(0.0)
    return cases.withColumns({"failures": F.concat_ws(";", *failures), "warnings": F.concat_ws(";", *warnings), "coverage": score}).withColumn("passed", F.col("failures") == "")


def run_checks(spark, counts: Mapping[str, int | None], *, tuned: bool, projected: bool, metadata: bool, robustness: bool) -> DataFrame:
    """(check, status, n): the checks of a selection run by the sizes of its audits; parts of a run that were off are not_applicable.

    ``counts``: blocked_dependencies, split_rows, schema_issues, protected_candidates, outcome_like, memberships, redundancy_rows, resample_rows, tuned_rows,
    signature_rows, projection_rows, projection_ok; missing counts are 0.
    """
    n = lambda c: int(counts.get(c) or 0)
    none = lambda c, bad: "pass" if n(c) == 0 else bad
    some = lambda c: "pass" if n(c) > 0 else "warning"
    only = lambda on, status: status if on else "not_applicable"
    rows = [
        ("runtime_has_no_blocked_dependency", none("blocked_dependencies", "fail"), "blocked_dependencies"),
        ("validation_splits_recorded", some("split_rows"), "split_rows"),
        ("external_schema_validated", none("schema_issues", "fail"), "schema_issues"),
        ("metadata_columns_protected", none("protected_candidates", "fail"), "protected_candidates"),
        ("outcome_like_candidate_names_reviewed", none("outcome_like", "warning"), "outcome_like"),
        ("modality_definitions_recorded", some("memberships"), "memberships"),
        ("correlation_redundancy_audited", "pass", "redundancy_rows"),
        ("feature_metadata_audited", only(metadata, "pass"), "metadata_rows"),
        ("robustness_screening_audited", only(robustness, "pass"), "robustness_rows"),
        ("stability_resamples_recorded", only(n("resample_rows") > 0, "pass"), "resample_rows"),
        ("nested_elastic_net_tuning_recorded", only(tuned, some("tuned_rows")), "tuned_rows"),
        ("final_signature_reproducible", some("signature_rows"), "signature_rows"),
        ("final_projection_reproducible", only(projected, some("projection_rows")), "projection_rows"),
        ("projection_validation_foldwise", only(projected, some("projection_ok")), "projection_ok"),
    ]
    return spark.createDataFrame([(check, status, n(count)) for check, status, count in rows], "check string, status string, n int")


def audit_counts(column_audit: DataFrame, schema_audit: DataFrame) -> dict[str, int]:
    """Counts for ``run_checks`` from the two audits: protected columns among candidates, names that tell the outcome, memberships and schema issues. One aggregate each."""
    protected = F.col("role").isin("id", "outcome", "time", "event", "group") & F.col("included_as_candidate")
    row = column_audit.agg(F.count_if(protected).alias("protected_candidates"), F.count_if("leakage_risk").alias("outcome_like"), F.count_if("included_as_candidate").alias("memberships")).first()
    return {**row.asDict(), "schema_issues": schema_audit.where("issue <> ''").count()}


def clustered(df: DataFrame, vector: str, kind: str, k: int, seed: int = 7) -> DataFrame:
    """``df`` with cluster: by k-means, by bisecting it (a tree of clusters from the top), or by the likeliest of five mixtures of normal distributions."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.functions import array_to_vector

    models = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}
    if kind not in models:
        raise ValueError(f"unknown kind {kind!r}")
    held = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    fit = lambda seed: models[kind](featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(held)
    model = max((fit(seed + i) for i in range(5)), key=lambda m: m.summary.logLikelihood) if kind == "mixture" else fit(seed)
    return model.transform(held).select(*df.columns, "cluster")
