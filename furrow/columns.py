"""Column names and fixed values of the harvest domain."""

from __future__ import annotations

# Source header -> column name used by every operator.
HARVEST_NAMES = {
    "FECHA": "fecha",
    "VARIEDAD": "variedad",
    "FORMATO": "formato",
    "FUNDO": "fundo",
    "HA": "ha",
    "KG/HA": "kg_ha",
    "%INDUS": "indus_pct",
    "DPC": "dpc",
    "P/BAYA": "p_baya",
    "DIA_COSECHA": "dia_cosecha",
    "KG/JR_H": "kg_jr_h",
    "KG/JR": "kg_jr",
    "H-EF": "h_ef",
}

FARM, FORMAT, DATE, VARIETY = "fundo", "formato", "fecha", "variedad"
VALUE, TARGET, HOURS, REAL = "kg_ha", "kg_jr_h", "h_ef", "kg_jr"
ROW_ID = "row_id"
FF = [FARM, FORMAT]

NUMERIC_FEATURES = ["kg_ha", "indus_pct", "dpc", "p_baya", "ha", "dia_cosecha"]
CATEGORICAL_FEATURES = ["formato", "fundo"]
LEAKAGE = ["kg_jr", "h_ef"]
USELESS = ["variedad", "dia_sem", "mes"]
MISSING_FLAG_COLUMNS = ["indus_pct", "p_baya"]

# Health ranges per column (low, high), None = open.
NUMERIC_RANGES = {
    "kg_ha": (0.0, None),
    "indus_pct": (0.0, 100.0),
    "dpc": (0.0, None),
    "p_baya": (0.0, None),
    "ha": (0.0, None),
    "dia_cosecha": (1.0, 366.0),
    "kg_jr_h": (0.0, None),
    "h_ef": (0.0, 24.0),
    "kg_jr": (0.0, None),
}

# Closed catalogs of the forecast request.
FORMATS = ["CLAMSHELL 4.4 OZ", "CLAMSHELL 11 OZ", "CLAMSHELL 18 OZ", "GRANEL", "OTROS"]
DEFAULT_FORMAT = "CLAMSHELL 4.4 OZ"
FARMS = ["C5", "A9", "LN", "C6"]
MAX_BATCH_ROWS = 1000

OTHER = "OTROS"
RARE = "RARE"
MISSING = "__MISSING__"
COLD = -1.0
SLOPE_COLD = -99999.0

HIGH_SEASON = (6, 7, 8, 9, 10)
LOW_SEASON = (12, 1, 2, 3, 4)

# Thresholds of gates and reports.
MAX_MAPE = 25.0
MAX_GAP_REL = 0.40
MIN_BASELINE_SKILL = 0.05
MAPE_TIE = 0.5
WARN_TEMPORAL_MAPE = 30.0
WARN_TEMPORAL_R2 = 0.20
MAX_TEMPORAL_MAPE = 35.0
MIN_TEMPORAL_SKILL = 0.0
MIN_TEMPORAL_FOLDS = 2
REL_FLOOR = 0.05
MIN_DENOM = 1.0
