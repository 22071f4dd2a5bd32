"""Fixed values that must equal the reference behaviour for equal results.

They are stated plainly here and used everywhere else by name.
"""

# Currency tokens stripped before numeric coercion
# (case-sensitive, matched anywhere in the text).
CURRENCY_PATTERN = "(Rs[.]?|PKR|USD|EUR|[$]|£|€|,)"

# Share of rows that must parse as numbers before a text
# column is treated as a dirty numeric column (at least one row).
DIRTY_NUMERIC_MIN_RATIO = 0.10

# Placeholder codes that mean "missing" in numeric columns.
DEFAULT_SENTINELS = [-999.0, -9999.0, -1.0, -1000.0, -99.0, -99999.0]

# The pandas CSV reader's default missing-value tokens.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Skew labels and their absolute-skewness limits.
SKEW_SYMMETRIC_BELOW = 0.5
SKEW_MODERATE_BELOW = 1.0
SKEW_LABELS = ("Symmetric", "Moderate Skew", "High Skew")

# Fallback category when a text column has no mode.
UNKNOWN_CATEGORY = "Unknown"

# Tukey fence multiplier, default z-score threshold,
# share of parsed values for a temporal column, sampled values per column.
IQR_FENCE = 1.5
ZSCORE_THRESHOLD = 3.0
TEMPORAL_MIN_RATIO = 0.80

# Problem-type rule (distinct numeric targets at or below
# this count are classes), histogram bins, top-k importances.
CLASSIFICATION_MAX_DISTINCT = 20
HISTOGRAM_BINS = 40
TOP_IMPORTANCES = 20

# Numbers accepted as numeric text (pandas-like; rejects
# "12d", "1_000" and other forms some engines accept).
NUMBER_PATTERN = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_PATTERN = "^[+-]?(?i)(inf|infinity)$"
