"""Column helpers: coercion, conditionals, rounding, ratios and exact aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Holds 22 digits before the point; sums of it keep all six places.
MONEY = "decimal(28,6)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- coercion -------------------------------------------------------------------------------

def to_num0(c: Column | str) -> Column:
    """Number from text; anything unreadable, missing or NaN counts as 0."""
    x = _c(c).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x).otherwise(F.lit(0.0))


def money0(c: Column | str) -> Column:
    """Amount from text or number as a fixed-point value; unreadable or missing counts as 0.

    Fixed point makes sums independent of partitioning and of task retries, so a threshold such as
    "share above 70 %" can never flip between two runs.
    """
    return F.coalesce(_c(c).try_cast(MONEY), F.lit(0).cast(MONEY))


def lost_by_cast(c: Column | str, kind: str) -> Column:
    """Whether a value that is present and not NaN is unreadable as this type or too wide for it."""
    x = _c(c)
    return x.isNotNull() & ~F.lower(F.trim(x.cast("string"))).isin("nan", "") & x.try_cast(kind).isNull()


def to_date_dmy(c: Column | str) -> Column:
    """Date from day/month/year text, one- or two-digit; impossible dates give null."""
    return F.try_to_timestamp(_c(c), F.lit("d/M/yyyy")).cast("date")


def nan_to_null(c: Column | str) -> Column:
    x = _c(c)
    return F.when(~F.isnan(x), x)


def month_from_name(c: Column | str) -> Column:
    """First run of six digits, null when there is none."""
    found = F.regexp_extract(_c(c), r"(\d{6})", 1)
    return F.when(found != "", found)


def month_index(c: Column | str) -> Column:
    """Consecutive month number of a YYYYMM text, so that differences are right across a year end."""
    return F.substring(_c(c), 1, 4).cast("int") * 12 + F.substring(_c(c), 5, 2).cast("int")


def as_text(c: Column | str) -> Column:
    return _c(c).cast("string")


def number_text(c: Column | str, digits: int) -> Column:
    """Rounded number as plain text with at least one decimal place and no exponent."""
    fixed = _c(c).cast(f"decimal(30,{digits})").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


# --- conditionals ---------------------------------------------------------------------------

def is_true(cond: Column) -> Column:
    """Two-valued condition: unknown is false, so that its negation is true."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    return is_true(cond).cast("int")


def case_when(branches: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """First matching branch wins."""
    out = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def add_if(cond: Column, delta: float) -> Column:
    """A delta that applies when the condition holds; such terms are summed, not exclusive."""
    return F.when(is_true(cond), F.lit(float(delta))).otherwise(F.lit(0.0))


def map_lookup(c: Column | str, values: Mapping[str, object], default: object = None) -> Column:
    x = _c(c)
    return case_when([(x == k, v) for k, v in values.items()], default)


# --- arithmetic -----------------------------------------------------------------------------

def clamp(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit a value from below and above; null stays null."""
    x = _c(c)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNotNull(), out)


def half_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even; negative digits round to tens, hundreds, thousands."""
    x = _c(c)
    if digits >= 0:
        return F.bround(x, digits)
    unit = float(10 ** -digits)
    return F.bround(x / unit, 0) * unit


def safe_ratio(num: Column | str, den: Column | str, default: float = 0.0) -> Column:
    """num/den where den is positive, else the default."""
    n, d = _c(num), _c(den)
    return F.when(is_true(d > 0), F.try_divide(n, d)).otherwise(F.lit(float(default)))


def pct(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_c(part), _c(whole)) * 100


def tenure_days(c: Column | str, ref_date: str) -> Column:
    """Days up to the reference date, at least 0; null date stays null."""
    return clamp(F.datediff(F.lit(ref_date).cast("date"), _c(c)), 0)


def usage_hours(amount: Column | str) -> Column:
    # Validity in hours by advance amount.
    a = _c(amount)
    return case_when([(a <= 5000, 24), (a <= 15000, 36), (a <= 30000, 48)], 60)


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (lo, hi] holding the value; null outside all bins."""
    x = _c(c)
    return case_when([((x > lo) & (x <= hi), label) for lo, hi, label in zip(edges, edges[1:], labels)])


# --- aggregates -----------------------------------------------------------------------------

def n_rows() -> Column:
    return F.count(F.lit(1))


def exact_sum(c: Column | str) -> Column:
    """Sum in fixed point of nine places, returned as double: the same bits whatever the row order."""
    return F.sum(_c(c).cast("decimal(28,9)")).cast("double")


def exact_avg(c: Column | str) -> Column:
    return F.try_divide(exact_sum(c), F.count(_c(c)))


# Sums and sums of squares in fixed point, and as floating point for values that do not fit.
MOMENTS = ["_units", "_squares", "_wide_sum", "_wide_squares"]
_UNIT = 1_000_000


def moments(c: Column | str) -> list[Column]:
    """Partial moments of a group, under the names in MOMENTS: they are added up to give a standard deviation.

    Values are counted in units of six places, which holds a deviation of equal values at exactly 0.
    """
    x = _c(c)
    units = (x * _UNIT).try_cast("decimal(38,0)")
    wide = x.cast("double")
    return [F.try_sum(units).alias("_units"), F.try_sum(F.try_multiply(units, units)).alias("_squares"),
            F.sum(wide).alias("_wide_sum"), F.sum(wide * wide).alias("_wide_squares")]


def merged_moments() -> list[Column]:
    """Aggregates that add up partial moments."""
    return [*[F.try_sum(m).alias(m) for m in MOMENTS[:2]], *[F.sum(m).alias(m) for m in MOMENTS[2:]]]


def deviation(n: Column | str) -> Column:
    """Sample standard deviation from the number of values and their moments; 0 for a single value.

    It is exact up to its last step where the squares fit 38 digits.
    """
    n = _c(n)
    exact = F.try_subtract(F.try_multiply(n.cast("decimal(20,0)"), F.col("_squares")),
                           F.try_multiply(F.col("_units"), F.col("_units"))).cast("double") / (_UNIT * _UNIT)
    wide = n * F.col("_wide_squares") - F.col("_wide_sum") * F.col("_wide_sum")
    spread = F.greatest(F.coalesce(exact, wide), F.lit(0.0))
    return F.when(n > 1, F.sqrt(F.try_divide(spread, n * (n - 1)))).otherwise(F.lit(0.0))


def most_frequent(code: Column | str, n: Column | str) -> Column:
    """Of groups by code: the code with the largest sum `n`, the smallest among ties, 'Unknown' when all are missing."""
    code, n = _c(code), _c(n)
    return F.coalesce(F.min_by(code, F.when(code.isNotNull(), F.struct(-n, code))), F.lit("Unknown"))
