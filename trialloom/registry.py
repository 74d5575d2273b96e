"""Study registries: conditions, methods, metrics, contrasts and reason codes."""

from __future__ import annotations

# Fixed values: (ordinal, code, scene, rate in Hz, delay in seconds).
CONDITIONS = (
    (0, "NI", "NI", None, None),
    (1, "H100", "HPRF", 100000.0, None),
    (2, "H200", "HPRF", 200000.0, None),
    (3, "H300", "HPRF", 300000.0, None),
    (4, "H400", "HPRF", 400000.0, None),
    (5, "H500", "HPRF", 500000.0, None),
    (6, "F1", "IDF", None, 1e-6),
    (7, "F2", "IDF", None, 2e-6),
    (8, "F3", "IDF", None, 3e-6),
    (9, "F4", "IDF", None, 4e-6),
    (10, "HF200-1", "COMPOSITE", 200000.0, 1e-6),
    (11, "HF200-2", "COMPOSITE", 200000.0, 2e-6),
    (12, "HF200-3", "COMPOSITE", 200000.0, 3e-6),
    (13, "HF300-1", "COMPOSITE", 300000.0, 1e-6),
    (14, "HF300-2", "COMPOSITE", 300000.0, 2e-6),
    (15, "HF300-3", "COMPOSITE", 300000.0, 3e-6),
    (16, "HF500-1", "COMPOSITE", 500000.0, 1e-6),
    (17, "HF500-2", "COMPOSITE", 500000.0, 2e-6),
    (18, "HF500-3", "COMPOSITE", 500000.0, 3e-6),
)
# Fixed values: (ordinal, code, display name).
METHODS = (
    (0, "FIRST", "首脉冲准则"),
    (1, "LAST", "末脉冲准则"),
    (2, "T", "最优时序准则"),
    (3, "W", "脉宽单特征准则"),
    (4, "TW", "双特征联合准则"),
)
# Fixed values: (ordinal, code, preferred direction).
METRICS = (
    (0, "P_cor", "HIGHER"),
    (1, "P_C_given_C", "HIGHER"),
    (2, "P_C_given_E", "HIGHER"),
    (3, "Mean_L_NC", "LOWER"),
)
# Fixed values: (ordinal, code, comparator method); the minuend is always TW.
CONTRASTS = ((0, "TW-T", "T"), (1, "TW-W", "W"))

SCENES = ("HPRF", "IDF", "COMPOSITE")
RATE_SCENES = ("HPRF", "COMPOSITE")
DELAY_SCENES = ("IDF", "COMPOSITE")
STRATA = ("WIDTH_STRATUM_0NS", "WIDTH_STRATUM_10NS", "WIDTH_STRATUM_GE20NS")

STATES = ("C", "E", "N")
STATE_COUNTS = ("N_C", "N_E", "N_N")
TRANSITIONS = tuple(f"N_{a}{b}" for a in STATES for b in STATES)
ORIGINS = ("N_Cdot", "N_Edot", "N_Ndot")
RUNS = ("N_run_NC", "Sum_L_NC_obs", "N_open_NC")
ERROR_SOURCES = ("N_E_H", "N_E_F")
COUNTS = STATE_COUNTS + TRANSITIONS + ORIGINS + RUNS + ERROR_SOURCES

# metric -> (numerator column, denominator column or None for the cycle count, reason)
CORE_RATIOS = {
    "P_cor": ("N_C", None, None),
    "P_C_given_C": ("N_CC", "N_Cdot", "C_DENOM_ZERO"),
    "P_C_given_E": ("N_EC", "N_Edot", "E_DENOM_ZERO"),
    "Mean_L_NC": ("Sum_L_NC_obs", "N_run_NC", "NO_NC_RUN"),
}
STATISTICS = ("N_C", "N_CC", "N_Cdot", "N_EC", "N_Edot", "Sum_L_NC_obs", "N_run_NC")

# Fixed planning values.
VARIANCE_UCB = 1.1890464657347386
Z975 = 1.96
TARGETS = {"P_cor": 0.02, "P_C_given_C": 0.02, "P_C_given_E": 0.02, "Mean_L_NC": 0.25}
MIN_DENOMINATOR = 100
MIN_POSITIVE_UNITS = 30
