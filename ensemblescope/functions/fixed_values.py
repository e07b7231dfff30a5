"""Values that results depend on and that are not ours to choose."""

# Outcome bucket of each climate category.
CATEGORY_BUCKETS = {
    "C1": "1.5",
    "C2": "1.5",
    "C3": "2",
    "C4": "2",
    "C5": "above 2",
    "C6": "above 2",
    "C7": "above 2",
    "C8": "above 2",
    "failed-vetting": "failed-vetting",
    "no-climate-assessment": "no-climate-assessment",
}

# The bucket that is the positive class, and its categories.
TARGET_BUCKET = "1.5"
TARGET_CATEGORIES = ("C1", "C2")

# Display label of each temperature bucket.
BUCKET_LABELS = {"1.5": "1.5°C", "2": "2.0°C", "above 2": "Above 2.0°C"}

# Plot colour of each bucket.
BUCKET_COLOURS = {
    "1.5": "#D9420B",
    "2": "#035AA6",
    "above 2": "#338474",
    "failed-vetting": "#999999",
    "no-climate-assessment": "#CCCCCC",
}

# Label of each of the two clusters of the combined box plots.
CLUSTER_LABELS = {0: "1.5°C", 1: "Above 1.5"}

# Column names that are matched without regard to case.
HEADER_NAMES = ("model", "scenario", "region", "variable", "unit", "category")

# Accepted headers of a category map.
CATEGORY_MAP_HEADERS = {
    "model": "model",
    "models": "model",
    "scenario": "scenario",
    "scenarios": "scenario",
    "category": "category",
    "categories": "category",
}

# Blanks that a string trim removes.
BLANKS = " \t\n\r\x0b\x0c"

# Texts of a CSV cell that mean "missing" (pandas.read_csv default).
CSV_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
