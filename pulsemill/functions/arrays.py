"""Arithmetic on one window held as an ARRAY column (bounded by the window length)."""

from pyspark.sql import Column, functions as F

from pulsemill.functions.numeric import _col, is_finite


def bind(value, body) -> Column:
    """`body(value)` with the value computed once per row.

    Inside `transform` and `aggregate` an outer expression is evaluated again for every
    element; a one-element array turns it into a variable.
    """
    return F.get(F.transform(F.array(_col(value)), body), F.lit(0))


def array_sum(a) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def array_mean(a) -> Column:
    return F.try_divide(array_sum(a), F.size(_col(a)))


def array_var_pop(a) -> Column:
    """Population variance, two passes over the array."""
    def around(x, m):
        sq = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
        return F.try_divide(sq, F.size(x))
    return bind(a, lambda x: bind(array_mean(x), lambda m: around(x, m)))


def all_finite(a) -> Column:
    return F.forall(_col(a), lambda x: is_finite(x))


def resample_linear(a, target, keep=None) -> Column:
    """Linear interpolation onto `target` points over [0, 1), both grids without endpoint.

    Positions past the last sample hold the last sample. `keep` truncates the result.
    """
    t = F.lit(target) if isinstance(target, int) else _col(target)
    upto = t if keep is None else F.least(t, F.lit(keep) if isinstance(keep, int) else _col(keep))

    def body(x):
        last = F.size(x) - F.lit(1)

        def at(j):
            pos = j.cast("double") * F.size(x) / t
            lo = F.least(F.floor(pos), last).cast("int")
            left = F.get(x, lo)
            return left + (F.get(x, F.least(lo + F.lit(1), last)) - left) * (pos - lo)

        return F.transform(F.sequence(F.lit(0), upto.cast("int") - F.lit(1), F.lit(1)), at)

    return bind(a, body)


def unit_range(a) -> Column:
    """Z-score then map to [-1, 1]; NULL when the window is (nearly) constant."""
    def scale(z, lo, hi):
        unit = lambda v: F.lit(-1.0) + F.try_divide(F.lit(2.0) * (v - lo), hi - lo)
        return F.when(hi - lo > 1e-12, F.transform(z, unit))

    def spread(z):
        return bind(F.array_min(z), lambda lo: bind(F.array_max(z), lambda hi: scale(z, lo, hi)))

    def score(x, m, sd):
        z = F.transform(x, lambda v: F.try_divide(v - m, sd))
        return F.when(sd > 1e-12, bind(z, spread))

    return bind(a, lambda x: bind(array_mean(x), lambda m: bind(
        F.sqrt(array_var_pop(x)), lambda sd: score(x, m, sd))))


def gradient_kernel(a) -> Column:
    """x[i+1] - x[i-1], with zeros outside the window."""
    def body(x):
        def at(v, i):
            return F.coalesce(F.get(x, i + F.lit(1)), F.lit(0.0)) - F.coalesce(
                F.when(i > 0, F.get(x, i - F.lit(1))), F.lit(0.0))
        return F.transform(x, at)
    return bind(a, body)


def pad_multiple(a, k: int = 4) -> Column:
    return bind(a, lambda x: F.concat(x, F.array_repeat(
        F.lit(0.0), F.pmod(-F.size(x), F.lit(k)).cast("int"))))


def block_means(a, k: int) -> Column:
    """Means of consecutive blocks of k samples (length must divide by k)."""
    def body(x):
        count = F.when(F.size(x) % k == 0, (F.size(x) / k).cast("int")).otherwise(
            F.raise_error(F.lit(f"length must be a multiple of {k}")).cast("int"))
        blocks = F.sequence(F.lit(0), count - F.lit(1), F.lit(1))
        return F.transform(blocks, lambda b: array_sum(
            F.slice(x, b * k + F.lit(1), F.lit(k))) / k)
    return bind(a, body)


def pack_slots(ppg, abp_scaled, ecg) -> Column:
    """Four equal slots: pulse, scaled pressure, ecg, zeros."""
    return F.concat(_col(ppg), _col(abp_scaled), _col(ecg),
                    F.array_repeat(F.lit(0.0), F.size(_col(ppg))))


def slot_view(packed, slot: int, slots: int = 4) -> Column:
    def body(x):
        n = (F.size(x) / slots).cast("int")
        return F.slice(x, n * slot + F.lit(1), n)
    return bind(packed, body)


def only_slot(values, slot: int, slots: int = 4) -> Column:
    """The values in one slot of an otherwise zero vector."""
    def body(x):
        zeros = lambda k: F.array_repeat(F.lit(0.0), F.size(x) * k)
        return F.concat(zeros(slot), x, zeros(slots - 1 - slot))
    return bind(values, body)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y),
                       F.lit(0.0), lambda s, v: s + v)
