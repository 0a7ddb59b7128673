"""Label sets, thresholds, column orders and formats.

Everything in this module is a constant of the data contract. The values must
stay as they are for results to agree with runs made elsewhere.
"""

# Column aliases per signal, in the order they are tried.
SIGNAL_ALIASES = {
    "II": ["II"],
    "PLETH": ["PLETH", "PPG"],
    "ABP": ["ABP", "ART"],
}

# Split label aliases (token -> canonical label).
SPLIT_ALIASES = {
    "train": "train",
    "training": "train",
    "val": "val",
    "valid": "val",
    "validation": "val",
    "test": "test",
    "testing": "test",
}

# Source label aliases (token -> canonical label).
SOURCE_ALIASES = {
    "vitaldb": "vitaldb",
    "vital": "vitaldb",
    "mimic4": "mimic4wdb",
    "mimic4wdb": "mimic4wdb",
    "mimiciv": "mimic4wdb",
    "mimicivwdb": "mimic4wdb",
    "mimic2": "mimic2co",
    "mimic2co": "mimic2co",
    "mimiciico": "mimic2co",
}

# Manifest column orders.
SOURCE_MANIFEST_REQUIRED = ["subject_id", "record_id", "fs", "parquet"]
UNIFIED_MANIFEST_COLUMNS = [
    "split", "source", "subject_id", "record_id", "hadm_id", "fs", "parquet",
    "ecg_col", "ppg_col", "abp_col", "source_manifest", "source_row_index",
]
UNIFIED_MANIFEST_NULLABLE = ["hadm_id"]
EXPORT_MANIFEST_COLUMNS = [
    "export_index", "baseline_key", "split", "source", "subject_id", "record_id",
    "hadm_id", "fs", "num_rows", "input_columns", "target_column", "source_parquet",
    "exported_parquet", "source_manifest", "source_row_index",
]
EXPORT_MANIFEST_REQUIRED = [
    "baseline_key", "split", "source", "subject_id", "record_id", "hadm_id", "fs",
    "exported_parquet", "source_manifest", "source_row_index",
]
RECORD_META_COLUMNS = [
    "timestamp", "fs", "subject_id", "hadm_id", "record_id", "split", "source",
]
SPLITS = ["train", "val", "test"]

# Input policy per method key: (inputs, target, waveform?, scalar?).
METHOD_POLICIES = {
    "ptt_based": (["II", "PLETH"], "ABP", False, True),
    "ppg2abp": (["PLETH"], "ABP", True, True),
    "inn_par": (["PLETH"], "ABP", True, True),
    "papagei": (["PLETH"], "ABP", False, True),
    "unicardio": (["PLETH", "II"], "ABP", True, True),
}

# Beat prediction file, column order.
BEAT_PREDICTION_COLUMNS = [
    "split", "source", "subject_id", "record_id", "hadm_id", "fs",
    "beat_index_in_record", "source_start_index", "source_end_index",
    "ecg_r_index", "ppg_foot_index", "next_ppg_foot_index", "ptt_sec",
    "sbp_true", "dbp_true", "map_true", "sbp_pred", "dbp_pred", "map_pred",
]

# Decay segment file, required columns.
TAU_SEGMENT_COLUMNS = ["window_key", "dia_start", "dia_end", "p_inf", "target_T"]

# Fields of the decay window key, in order.
WINDOW_KEY_FIELDS = ["subject_id", "record_id", "hadm_id", "clean_window_order", "start", "end"]

# Reference quality thresholds (mmHg).
QC_MIN_ABP = 20.0
QC_MAX_ABP = 250.0
QC_MIN_STD = 1.0
QC_MIN_RANGE = 10.0
QC_MAX_RANGE = 200.0

# Patient protocol.
SHIFT_MS = 250.0
BOOTSTRAP_SAMPLES = 2000
BOOTSTRAP_SEED = 2025

# Pulse transit extraction.
MIN_PTT_SEC = 0.08
MAX_PTT_SEC = 0.50
MIN_PEAK_DISTANCE_SEC = 0.30
ECG_PROMINENCE = 0.50
PPG_PROMINENCE = 0.10
MIN_FINITE_SEGMENT_SEC = 8.0

# Four-slot pressure scaling.
SLOT_BP_CENTER = 100.0
SLOT_BP_SCALE = 50.0

# Cuff feature scaling (name: center, scale).
CUFF_SCALING = {
    "sbp": (120.0, 40.0),
    "dbp": (70.0, 25.0),
    "map": (90.0, 30.0),
    "pp": (50.0, 30.0),
}
CUFF_DELTA_SCALE_SEC = 600.0

# Ridge grid and folds.
RIDGE_ALPHAS = [0.1, 1.0, 10.0, 100.0, 1000.0]
RIDGE_FOLDS = 4

# Blood pressure names.
SCALAR_METRICS = ["sbp", "dbp", "map"]

# Patient table, metric columns (label, section, metric, digits).
PATIENT_TABLE_CI = [
    ("MAE", "waveform", "mae_mmHg", 2),
    ("RMSE", "waveform", "rmse_mmHg", 2),
    ("Min-MAE", "waveform", "min_mae_mmHg", 2),
    ("Min-RMSE", "waveform", "min_rmse_mmHg", 2),
    ("NRMSE", "waveform", "nrmse", 3),
    ("Corr", "waveform", "corr", 3),
    ("SBP err", "scalar", "sbp_mae_mmHg", 2),
    ("DBP err", "scalar", "dbp_mae_mmHg", 2),
    ("MAP err", "scalar", "map_mae_mmHg", 2),
]

# Patient table, signed columns (label, metric, digits).
PATIENT_TABLE_SIGNED = [("SBP", "sbp", 2), ("DBP", "dbp", 2), ("MAP", "map", 2)]

# Seed aggregation (label, path in the metrics document, digits).
SEED_METRICS = [
    ("MAE", "patient_summary.waveform.mae_mmHg.mean", 2),
    ("RMSE", "patient_summary.waveform.rmse_mmHg.mean", 2),
    ("Min-MAE", "patient_summary.waveform.min_mae_mmHg.mean", 2),
    ("Min-RMSE", "patient_summary.waveform.min_rmse_mmHg.mean", 2),
    ("NRMSE", "patient_summary.waveform.nrmse.mean", 3),
    ("Corr", "patient_summary.waveform.corr.mean", 3),
    ("SBP err", "patient_summary.scalar.sbp_mae_mmHg.mean", 2),
    ("DBP err", "patient_summary.scalar.dbp_mae_mmHg.mean", 2),
    ("MAP err", "patient_summary.scalar.map_mae_mmHg.mean", 2),
    ("SBP ME", "pooled_scalar.sbp.bias", 2),
    ("SBP error SD", "pooled_scalar.sbp.std", 2),
    ("DBP ME", "pooled_scalar.dbp.bias", 2),
    ("DBP error SD", "pooled_scalar.dbp.std", 2),
    ("MAP ME", "pooled_scalar.map.bias", 2),
    ("MAP error SD", "pooled_scalar.map.std", 2),
]

# Compact result row, column order and source paths.
COMPACT_COLUMNS = [
    ("MAE", "waveform.waveform_mae"),
    ("RMSE", "waveform.waveform_rmse"),
    ("Corr", "waveform.waveform_corr"),
    ("SBP err", "scalar.sbp_mae"),
    ("DBP err", "scalar.dbp_mae"),
    ("MAP err", "scalar.map_mae"),
]

# Validation metrics where a smaller number is better.
LOWER_IS_BETTER = {
    "val_mae", "val_rmse", "val_loss", "val_sbp_mae", "val_dbp_mae", "val_map_mae",
    "val_nibp_sbp_mae", "val_nibp_dbp_mae", "val_nibp_map_mae", "val_co_mae",
    "val_cvp_mae", "val_tau_log_mae", "val_tau_mae",
}
