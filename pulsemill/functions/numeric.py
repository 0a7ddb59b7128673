"""Number hygiene. Missing means NULL: NaN and infinities are folded at the edge."""

from pyspark.sql import Column, functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def is_finite(c) -> Column:
    """True for an ordinary number, false for NULL, NaN and the infinities."""
    x = _col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(c) -> Column:
    x = _col(c).cast("double")
    return F.when(is_finite(x), x)


def parse_finite(c) -> Column:
    """Text to number; anything unreadable or non-finite ("nan", "inf", "") is NULL."""
    return finite_or_null(_col(c).try_cast("double"))


def first_non_null(*cols) -> Column:
    """First value that is neither NULL nor NaN."""
    def clean(c):
        return F.when(_col(c).cast("string") != F.lit("NaN"), _col(c))
    return F.coalesce(*[clean(c) for c in cols])


def affine(c, scale: float, offset: float) -> Column:
    return _col(c) * F.lit(float(scale)) + F.lit(float(offset))


def standardize(c, center: float, scale: float) -> Column:
    return (_col(c) - F.lit(float(center))) / F.lit(float(scale))


def round_even(c) -> Column:
    """Nearest integer, halves to even (how window lengths and offsets are rounded)."""
    return F.rint(_col(c)).cast("bigint")


def index_to_sec(i, fs) -> Column:
    return _col(i).cast("double") / _col(fs)


def scale_index(i, fs_from, fs_to) -> Column:
    """Position on one sampling grid expressed on another."""
    return round_even(_col(i).cast("double") * _col(fs_to) / _col(fs_from))


def close_to(a, b, atol: float, rtol: float) -> Column:
    return F.abs(_col(a) - _col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(_col(b))


def guarded_corr(cov, var_x, var_y) -> Column:
    """Pearson correlation from population moments, NULL when either side is flat."""
    flat = (var_x <= F.lit(1e-12)) | (var_y <= F.lit(1e-12))
    return F.when(~flat, cov / F.sqrt(var_x * var_y))
