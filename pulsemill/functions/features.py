"""Model input features."""

from pyspark.sql import Column, DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.numeric import _col, is_finite, standardize


def cuff_features(sbp, dbp, map_, delta_sec, valid) -> Column:
    """Six numbers: scaled pressures, scaled pulse pressure, age in units of 600 s, presence.

    A reading is present when flagged valid and all four numbers are finite; an absent one
    counts as zeros before scaling.
    """
    here = _col(valid) & is_finite(sbp) & is_finite(dbp) & is_finite(map_) & is_finite(delta_sec)
    here = F.coalesce(here, F.lit(False))
    kept = lambda c: F.when(here, _col(c)).otherwise(F.lit(0.0))
    values = {"sbp": kept(sbp), "dbp": kept(dbp), "map": kept(map_)}
    values["pp"] = values["sbp"] - values["dbp"]
    parts = [standardize(values[k], *fixed.CUFF_SCALING[k]) for k in ("sbp", "dbp", "map", "pp")]
    return F.array(*parts, kept(delta_sec) / F.lit(fixed.CUFF_DELTA_SCALE_SEC),
                   here.cast("double"))


def with_cuff_features(df: DataFrame, out: str = "cuff", require_all_valid: bool = False,
                       **cols) -> DataFrame:
    """Add the feature vector; `require_all_valid` makes an absent reading an error."""
    made = df.withColumn(out, cuff_features(**cols))
    if require_all_valid:
        ok = F.get(out, F.lit(5)) == 1.0
        made = made.withColumn(out, F.when(ok, F.col(out)).otherwise(
            F.raise_error(F.lit("a cuff reading is invalid")).cast("array<double>")))
    return made
