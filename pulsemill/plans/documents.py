"""The metrics document of a run: one nested row, assembled by the engine from one-row results.

Patients are as many as the data has, so their rows are written beside the document, one JSON line each, and
the document names that folder.
"""

from pyspark.sql import DataFrame, functions as F

from pulsemill.functions import fixed
from pulsemill.sources.results import write_metrics_json
from pulsemill.sources.storage import materialize

SUMMARY = {"n_patients": "n_patients", "mean": "mean", "bootstrap_ci_low": "ci_low", "bootstrap_ci_high": "ci_high",
           "median": "median", "iqr_low": "iqr_low", "iqr_high": "iqr_high"}
WAVEFORM = ["mae_mmHg", "rmse_mmHg", "min_mae_mmHg", "min_rmse_mmHg", "nrmse", "corr"]
SCALAR = [f"{m}_{v}_mmHg" for m in fixed.SCALAR_METRICS for v in ("mae", "rmse")]


def _cells(long: DataFrame, names: list, fields: dict) -> DataFrame:
    """One row with a struct per name from rows (metric, ...); absent names are NULL."""
    cell = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    return long.agg(*[F.max(F.when(F.col("metric") == m, cell)).alias(m) for m in names])


def _row(one: DataFrame):
    # Evaluated first: the optimizer fails on scalar subqueries inside scalar subqueries.
    return materialize(one).select(F.struct("*")).scalar()


def metrics_document(result: dict, method: str, method_label: str = None, protocol: dict = None,
                     metrics_json: str = "", extra: dict = None) -> DataFrame:
    """One row: method, protocol, patient_summary, pooled_scalar, run totals, reference_qc, table_row.

    `result` is what `jobs.patient_metrics_waveform` or `patient_metrics_scalar` gave.
    """
    base = result["summary"].sparkSession.range(1)
    pooled = [c for c in result["pooled"].columns if c != "metric"]
    parts = {
        "method": F.lit(method), "method_label": F.lit(method_label or method), "metrics_json": F.lit(metrics_json),
        "protocol": F.struct(*[F.lit(v).alias(k) for k, v in sorted((protocol or {"name": method}).items())]),
        "patient_summary": F.struct(_row(_cells(result["summary"], WAVEFORM, SUMMARY)).alias("waveform"),
                                    _row(_cells(result["summary"], SCALAR, SUMMARY)).alias("scalar")),
        "pooled_scalar": _row(_cells(result["pooled"], list(fixed.SCALAR_METRICS), {c: c for c in pooled})),
        "reference_qc": (_row(result["reference_qc"].withColumn("enabled", F.lit(True))) if result["reference_qc"] is not None
                         else F.struct(F.lit(False).alias("enabled"))),
        "table_row": _row(result["table"]), **{k: F.lit(v) for k, v in (extra or {}).items()}}
    out = base.select(*[c.alias(n) for n, c in parts.items()], _row(result["totals"]).alias("__totals"))
    return out.select(*parts, "__totals.*")


def write_metrics_document(result: dict, path: str, method: str, **more) -> DataFrame:
    """Write `<path>/document` and `<path>/patients`; return the document's row."""
    document = metrics_document(result, method, metrics_json=f"{path}/document",
                                extra={"patients_json": f"{path}/patients"}, **more)
    write_metrics_json(result["patients"], f"{path}/patients")
    write_metrics_json(document.coalesce(1), f"{path}/document")
    return document
