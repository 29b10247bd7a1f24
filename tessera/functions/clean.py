"""Scalar functions: missing values, lenient parsing, guarded arithmetic, text and codes. All are column expressions.

One rule for missing values holds everywhere: NaN, infinities, blank text and words for "missing" become NULL on the way in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words read as missing, true and false.
MISSING_WORDS = ("", "nan", "none", "na", "null")
TRUE_WORDS = ("1", "true", "yes", "y", "pass", "passed", "keep", "include")
FALSE_WORDS = ("0", "false", "no", "n", "fail", "failed", "drop", "exclude")
TRUEISH_WORDS = ("1", "true", "t", "yes", "y", "pass", "passed", "keep", "include", "robust")
DATE_FORMATS = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
# Lower limits of density factors 1 to 4, and of wall thickness classes 2 to 5.
DENSITY_LIMITS = (130.0, 200.0, 300.0, 400.0)
THICKNESS_LIMITS = (2.0, 3.0, 4.0, 5.0)


def text_or_null(x: Column) -> Column:
    """Trimmed text; NULL for blanks and words for missing."""
    t = F.trim(x.cast("string"))
    return F.when(F.lower(t).isin(*MISSING_WORDS), None).otherwise(t)


def finite(x: Column) -> Column:
    """A double, NULL where it is NaN or infinite."""
    d = x.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def to_number(x: Column) -> Column:
    """Text to a finite double, NULL where it is none."""
    return finite(text_or_null(x).try_cast("double"))


def parse_bool(x: Column) -> Column:
    """True, false or NULL by word lists."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def parse_boolish(x: Column) -> Column:
    """True for a word that means it, false for all else, missing included."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(*TRUEISH_WORDS), F.lit(False))


def parse_date(x: Column) -> Column:
    """Timestamp by the first of ``DATE_FORMATS`` that fits."""
    t = F.trim(x)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS))


def days_between(start: Column, end: Column) -> Column:
    """Whole days of the time difference, rounded down; not calendar days."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return F.floor((seconds(end) - seconds(start)) / 86400)


def divide_positive(n: Column, d: Column) -> Column:
    """n / d; NULL unless d > 0."""
    return F.when(d > 0, F.try_divide(n, d))


def divide_nonzero(n: Column, d: Column) -> Column:
    """n / d; NULL where d is 0 or either is not finite."""
    return F.try_divide(finite(n), F.nullif(finite(d), F.lit(0.0)))


def row_mean(*xs: Column) -> Column:
    """Mean of the values of a row that are there; NULL without any."""
    some = F.filter(F.array(*[finite(x) for x in xs]), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, v: a + v), F.size(some).cast("double"))


def first_nonempty(*xs: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(x), F.lit("")) for x in xs))


def any_flag(*xs: Column) -> Column:
    """Three-valued OR: true if any is true, else NULL if any is NULL, else false; false without arguments."""
    out = F.lit(False)
    for x in xs:
        out = out | x
    return out


def clipped(x: Column, most: float = 8.0) -> Column:
    """Within -most..most; missing counts as 0."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(finite(x), F.lit(0.0))))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q / (1 - q))


def slug(x: Column) -> Column:
    """Lower-case letters and digits of ASCII, other runs as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_|_$", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def significant(x: Column, digits: int = 8) -> Column:
    return F.format_string(f"%.{digits}g", x)


def step(x: Column, limits: Sequence[float]) -> Column:
    """How many of the ascending ``limits`` x reaches; 0 for missing values."""
    out = F.lit(0)
    for limit in limits:
        out = out + F.coalesce((finite(x) >= limit).cast("int"), F.lit(0))
    return out


def density_factor(hu: Column) -> Column:
    return step(hu, DENSITY_LIMITS)


def thickness_class(mm: Column) -> Column:
    """0 where nothing is, then 1 below 2 mm and a class for each further millimetre to 5."""
    return F.when(mm > 0, 1 + step(mm, THICKNESS_LIMITS)).otherwise(0)


def burden_class(present: Column, fraction: Column, low: float = 0.01, moderate: float = 0.05) -> Column:
    return (
        F.when(~F.coalesce(present, F.lit(False)), "none")
        .when(fraction.isNull(), "low")
        .when(fraction >= moderate, "high")
        .when(fraction >= low, "moderate")
        .when(fraction > 0, "low")
        .otherwise("none")
    )


def short_hash(x: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(x), 1, length)


def classify(x: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "") -> Column:
    """The first class one of whose words the text contains; order decides."""
    out, t = None, F.lower(x)
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def matched_terms(x: Column, terms: Sequence[str]) -> Column:
    """The terms that the text holds: those of up to three characters as words, longer ones anywhere."""
    t = F.lower(x)
    hit = [F.when(t.rlike(rf"\b{w}\b") if len(w) <= 3 else t.contains(w), F.lit(w)) for w in terms]
    return F.filter(F.array(*hit), lambda v: v.isNotNull())


def case_id(x: Column, pattern: str = "sub-[A-Za-z0-9]+") -> Column:
    """The first match of ``pattern``, else the file name without its suffixes, else 'unknown'."""
    stem = F.regexp_replace(F.regexp_extract(x, "([^/]*)$", 1), r"\..*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(x, pattern, 0), F.lit("")), F.nullif(F.trim(stem), F.lit("")), F.lit("unknown"))


def keep_keys(m: Column, drop: Sequence[str]) -> Column:
    """A map without the keys in ``drop``."""
    return F.map_filter(m, lambda k, _: ~k.isin(*drop))
