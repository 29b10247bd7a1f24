"""Which columns of a table are features: selection by name and content, groups, filters by feature tables, and audits.

Names are decided on the driver: a table has as many as its schema. What depends on values comes from one aggregate pass over the table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean as C

# Column names that hold features, marks of compliance, marks of robustness and robustness scores, in order of preference.
FEATURE_NAMES = ("feature", "feature_name", "variable", "column", "name")
COMPLIANCE_NAMES = ("ibsi_compliant", "ibsi", "ibsi_compliance", "compliant", "radiomics_compliant")
ROBUST_NAMES = ("robust", "keep", "pass", "passes", "include")
SCORE_NAMES = ("icc", "test_retest_icc", "segmentation_icc", "acquisition_icc", "robustness", "ccc")
# Parts of names that tell an outcome.
OUTCOME_TOKENS = ("outcome", "label", "target", "event", "death", "mortality", "mace", "followup")


@dataclass(frozen=True)
class Roles:
    """The columns of a cohort table that are no features."""

    id: str | None = None
    target: str | None = None
    time: str | None = None
    event: str | None = None
    group: str | None = None
    features: tuple[str, ...] = field(default=())

    def metadata(self) -> dict[str, str]:
        """Column to role, in the order id, outcome, time, event, group."""
        named = (("id", self.id), ("outcome", self.target), ("time", self.time), ("event", self.event), ("group", self.group))
        return {column: role for role, column in reversed(named) if column}

    def of(self, column: str) -> str:
        return self.metadata().get(column) or ("feature" if column in self.features else "other")


def numeric_usable(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, bool]:
    """Whether a column has any finite number; one pass for all columns."""
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return {}
    row = df.agg(*[F.max(C.to_number(F.col(f"`{c}`")).isNotNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: bool(row[f"c{i}"]) for i, c in enumerate(columns)}


def select_columns(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), roles: Roles | None = None, base: Sequence[str] | None = None) -> list[str]:
    """Names that match one of ``include``, else all numeric ones that have no role; less those that match one of ``exclude``."""
    names = list(dict.fromkeys(df.columns if base is None else base))
    hit = lambda c, patterns: any(re.search(p, c) for p in patterns)
    if include:
        chosen = [c for c in names if hit(c, include)]
    else:
        free = [c for c in names if c not in (roles or Roles()).metadata()]
        usable = numeric_usable(df, free)
        chosen = [c for c in free if usable[c]]
    return [c for c in chosen if not hit(c, exclude)]


def domains(specs: Sequence[str], columns: Sequence[str]) -> dict[str, list[str]]:
    """Groups of columns from specifications name:pattern; a column may be in several."""
    out = {}
    for spec in specs:
        name, mark, pattern = spec.partition(":")
        if not mark:
            raise ValueError(f"a group is given as name:pattern, not {spec!r}")
        out[name] = [c for c in columns if re.search(pattern, c)]
    return out


def allowed_by_all(*allowed: set[str] | None) -> set[str] | None:
    """What every set that is there allows; None (all) where there is no set."""
    there = [a for a in allowed if a is not None]
    return reduce(set.__and__, there, set(there[0])) if there else None


def modalities(columns: Sequence[str], groups: Mapping[str, Sequence[str]], more: Mapping[str, Sequence[str]] | None = None, allowed: set[str] | None = None, rejected: Iterable[str] = ()) -> dict[str, list[str]]:
    """Groups that keep a column, "combined" of the distinct columns of all ``groups``, then the groups of ``more``; "all" where none keeps any."""
    rejected = set(rejected)
    base = [c for c in columns if c not in rejected and (allowed is None or c in allowed)]
    kept = {name: [c for c in group if c in base] for name, group in groups.items()}
    kept = {name: group for name, group in kept.items() if group}
    if kept:
        kept["combined"] = list(dict.fromkeys(c for group in kept.values() for c in group))
    for name, group in (more or {}).items():
        if some := [c for c in group if c in base]:
            kept[name] = some
    return kept or {"all": base}


def by_column(groups: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Column to the names of its groups, semicolons between."""
    out: dict[str, list[str]] = {}
    for name, columns in groups.items():
        for c in columns:
            out.setdefault(c, []).append(name)
    return {c: ";".join(names) for c, names in out.items()}


def leakage(column: str, role: str, candidate: bool, roles: Roles) -> tuple[bool, str]:
    """Whether a candidate's name tells the outcome, and why."""
    if role not in ("feature", "other"):
        return False, "metadata column protected from feature use"
    own = [c.lower() for c in (roles.target, roles.time, roles.event) if c]
    token = next((t for t in (*own, *OUTCOME_TOKENS) if candidate and t in column.lower()), None)
    return (True, f"candidate feature name contains outcome-like token '{token}'") if token else (False, "")


def column_audit(df: DataFrame, roles: Roles, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each column: role, whether it is a candidate, its groups, whether it is numeric, and the risk that it tells the outcome."""
    member, usable, protected = by_column(groups), numeric_usable(df), roles.metadata()
    rows = []
    for c in df.columns:
        role = "feature" if roles.of(c) == "other" and c in member else roles.of(c)
        rows.append((c, role, c in member, member.get(c, ""), usable[c], c in protected, *leakage(c, role, c in member, roles)))
    names = "column string, role string, included_as_candidate boolean, modalities string, numeric_usable boolean, metadata_protected boolean, leakage_risk boolean, leakage_reason string"
    return df.sparkSession.createDataFrame(rows, names)


def schema_audit(development: DataFrame, external: DataFrame | None, roles: Roles, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each needed column and table: whether it is there and numeric; a feature that the external table lacks is an issue."""
    member = by_column(groups)
    needed = roles.metadata() | dict.fromkeys(member, "feature")
    rows = []
    for name, df in (("development", development), ("external", external)):
        if df is None:
            continue
        usable = numeric_usable(df, [c for c in needed if c in df.columns])
        for c in sorted(needed):
            lacks = name == "external" and needed[c] == "feature" and c not in usable
            rows.append((name, c, needed[c], member.get(c, ""), c in usable, usable.get(c, False), "missing_external_feature" if lacks else ""))
    return development.sparkSession.createDataFrame(rows, "dataset string, column string, role string, modalities string, present boolean, numeric_usable boolean, issue string")


def split_holdout(df: DataFrame, group: str, held: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(development, holdout) by group, compared as text. A group that isn't there, or a side without rows, is an error."""
    text = F.coalesce(F.col(group).cast("string"), F.lit(""))
    counts = {r.g: r.n for r in df.where(text.isin(*held)).groupBy(text.alias("g")).agg(F.count("*").alias("n")).collect()}  # as many as ``held``
    if absent := sorted(set(held) - set(counts)):
        raise ValueError(f"groups not found in {group}: {', '.join(absent)}")
    rest = df.where(~text.isin(*held))
    if not rest.limit(1).count():
        raise ValueError("the holdout groups leave no rows for development")
    return rest, df.where(text.isin(*held))


def _first(df: DataFrame, names: Sequence[str]) -> str | None:
    lower = {c.lower(): c for c in reversed(df.columns)}
    return next((lower[n] for n in names if n in lower), None)


def metadata_filter(table: DataFrame, require: bool = True) -> DataFrame:
    """(feature, ibsi_compliant, filter_decision, reason) of a feature table: rejected are those not marked compliant, if that is required."""
    name, mark = _first(table, FEATURE_NAMES), _first(table, COMPLIANCE_NAMES)
    if name is None or (mark is None and require):
        raise ValueError("the feature table needs a column of feature names" + (" and one of compliance" if name else ""))
    compliant = C.parse_bool(F.col(mark)) if mark else F.lit(None).cast("boolean")
    fine = F.coalesce(compliant, F.lit(False))
    if mark is None:
        decision, reason = F.lit("retained"), F.lit("metadata provided without IBSI compliance column")
    elif require:
        decision = F.when(fine, "retained").otherwise("rejected")
        reason = F.when(fine, "IBSI compliant").otherwise("not marked IBSI compliant")
    else:
        decision, reason = F.lit("retained"), F.when(fine, "IBSI compliant").otherwise("IBSI compliance recorded for audit only")
    return table.select(F.col(name).cast("string").alias("feature"), compliant.alias("ibsi_compliant"), decision.alias("filter_decision"), reason.alias("reason"))


def robustness_filter(table: DataFrame, least: float = 0.75) -> DataFrame:
    """(feature, filter_decision, reason, min_robustness_score) by a column of marks, else by the least of the scores that are there."""
    name, mark = _first(table, FEATURE_NAMES), _first(table, ROBUST_NAMES)
    scores = [c for c in SCORE_NAMES if c in table.columns]
    if name is None or not (mark or scores):
        raise ValueError("the robustness table needs a column of feature names and one of marks or scores")
    if mark:
        keep = F.coalesce(C.parse_bool(F.col(mark)), F.lit(False))
        reason = F.when(keep, "pass column marked feature robust").otherwise("pass column did not mark feature robust")
        score: Column = F.lit(None).cast("double")
    else:
        score = F.array_min(F.array(*[C.to_number(F.col(c)) for c in scores]))
        keep = F.coalesce(score >= least, F.lit(False))
        reason = F.when(score.isNull(), "missing numeric robustness score").when(keep, "all recorded robustness metrics met threshold").otherwise("one or more recorded robustness metrics fell below threshold")
    return table.select(F.col(name).cast("string").alias("feature"), F.when(keep, "retained").otherwise("rejected").alias("filter_decision"), reason.alias("reason"), score.alias("min_robustness_score"))


def find_column(columns: Sequence[str], include: Sequence[str], exclude: Sequence[str] = (), prefer: Sequence[str] = ()) -> str | None:
    """The column whose compact name has all of ``include``, none of ``exclude`` and most of ``prefer``; the first by name of several."""
    found = []
    for c in columns:
        name = re.sub("[^a-z0-9]", "", c.lower())
        if all(t in name for t in include) and not any(t in name for t in exclude):
            found.append((-sum(t in name for t in prefer), c))
    return min(found)[1] if found else None


def first_numeric_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that has a number in any row: one column for all rows, unlike a row-wise coalesce."""
    there = [c for c in candidates if c in df.columns]
    usable = numeric_usable(df, there)
    return next((c for c in there if usable[c]), None)


def feature_parts(name: Column) -> Column:
    """``segment__type_class_name`` as a struct; the segment is NULL where there is none, missing parts are blank."""
    has = F.instr(name, "__") > 0
    at = F.instr(name, "__")
    rest = F.when(has, name.substr(at + 2, F.length(name))).otherwise(name)
    parts = F.split(rest, "_", 3)
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(F.when(has, name.substr(F.lit(1), at - 1)).alias("segment"), part(0).alias("image_type"), part(1).alias("feature_class"), part(2).alias("feature_name"))


@dataclass(frozen=True)
class Metric:
    """A registered column: its domain, the sets it belongs to, and its value where a case has none."""

    name: str
    domain: str = ""
    sets: tuple[str, ...] = ()
    default: object = None


def subset(df: DataFrame, registry: Sequence[Metric], chosen: str, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the columns of a registered set that the table has, in the registry's order."""
    names = [m.name for m in registry if chosen in m.sets and m.name in df.columns]
    return df.select(*dict.fromkeys([*keep, *names]))


def membership(spark: SparkSession, registry: Sequence[Metric]) -> DataFrame:
    """A row for each registered column with a boolean for each set, in order of the sets' names."""
    sets = sorted({s for m in registry for s in m.sets})
    return spark.createDataFrame([(m.name, m.domain, *(s in m.sets for s in sets)) for m in registry], ", ".join(["feature string", "domain string", *(f"`{s}` boolean" for s in sets)]))


def with_defaults(df: DataFrame, registry: Sequence[Metric]) -> DataFrame:
    """Registered columns that the table lacks are added with their defaults; where it has them, missing values get the defaults."""
    there = set(df.columns)
    fill = {m.name: F.coalesce(F.col(m.name), F.lit(m.default)) if m.name in there else F.lit(m.default) for m in registry if m.name not in there or m.default is not None}
    return df.withColumns(fill) if fill else df
