"""Thresholds and fixed values shared by the operators.

These are fixed values: results only agree with the specification when they stay as they are.
"""

# Cleaning
OUTLIER_IQR_FACTOR = 3.0
TEXT_MAX_DISTINCT, TEXT_ROWS_PER_DISTINCT = 100, 10     # eligible: distinct <= min(100, rows // 10)
TITLE_MAX_DISTINCT, TITLE_ROWS_PER_DISTINCT = 50, 20    # title case: distinct < min(50, rows // 20)
UNKNOWN = "Unknown"

# Dates
DATE_SAMPLE_SIZE, DATE_SAMPLE_NEEDED = 5, 3
DATE_RATE = 0.8
DATE_HEAD_ROWS = 200     # rows in which the sample of most columns is found

# Top-k sizes
PREVIEW_ROWS = 5
PROFILE_TOP_VALUES = 5
BAR_TOP_VALUES = 10
SHORT_STATS_COLUMNS = 3
REPORT_TOP_ACTIONS = 5

# Charts: limits on the number of distinct values of a category
CROSSTAB_MAX_GROUPS, CROSSTAB_MAX_VALUES = 5, 10
PIE_MAX_DISTINCT, PIE_FOLD_ABOVE, PIE_KEEP = 10, 8, 7
COLOUR_MAX_DISTINCT = 10
CATEGORY_MAX_DISTINCT = 10
LINE_GROUP_MAX_DISTINCT = 5
RADAR_TOP_CATEGORIES, RADAR_MIN_FEATURES, RADAR_MAX_FEATURES = 6, 3, 5
TREEMAP_MAX_DISTINCT = 20
HEATMAP_MIN_NUMERIC = 2
BUBBLE_MIN_NUMERIC = 3

# Standard chart set: (least, most) distinct values
STANDARD_COLOUR, STANDARD_GROUP, STANDARD_PIE = (2, 6), (2, 5), (2, 10)
STANDARD_HEATMAP_MIN_NUMERIC = 3

# Tokens a CSV reader treats as missing (the public pandas default list)
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Chart words, in match order: the first chart with a word in the text wins
CHART_WORDS = (
    ("histogram", ("histogram", "distribution")),
    ("bar", ("bar chart", "bar graph", "counts", "frequency")),
    ("pie", ("pie chart", "composition", "breakdown", "proportion")),
    ("scatter", ("scatter", "relationship", "correlation")),
    ("box", ("box plot", "boxplot", "box-and-whisker")),
    ("line", ("line chart", "line graph", "trend", "time series")),
    ("area", ("area chart", "area graph", "cumulative", "stacked area")),
    ("heatmap", ("heatmap", "heat map", "correlation matrix")),
    ("bubble", ("bubble chart", "bubble plot")),
    ("violin", ("violin plot", "violin")),
    ("radar", ("radar chart", "radar plot", "spider chart", "spider plot")),
    ("treemap", ("treemap", "tree map")),
)
SECTION_MIN_LENGTH = 10   # shorter section texts are ignored
SECTION_LINE_LENGTH = 3   # a section line must be longer than this

# Bounds on what may leave the executors or be decided by a sketch
DIRECT_QUANTILE_ROWS = 100_000     # up to here the value map of `percentile` is small
QUANTILE_BUDGET_ROWS = 50_000      # most rows between two bracket ends for the last pick
PICK_ROWS_PER_PASS = 2_000_000      # most values sorted in one task
SKETCH_ROWS, SKETCH_MAX_ROWS = 20_000, 20_000_000   # rows a sketch looks at; one in 1000 in between
SKETCH_ACCURACY = 10_000
DISTINCT_GATE = 200                 # every threshold on distinct counts lies at or below 100
# Spark generates no code for a step with more than 100 fields (spark.sql.codegen.maxFields), which makes
# each aggregate several times dearer. More aggregates than this are split over several passes: in a
# columnar table each pass reads only its own columns.
AGGREGATES_PER_PASS = 96

# Texts of the action log: (action type, description, justification). Fixed values.
ACTION_MEDIAN = ("fill_missing", "Filled {n} missing values with median", "Median is robust to outliers")
ACTION_MODE = ("fill_missing", "Filled {n} missing values with mode: '{value}'",
               "Mode represents the most common value")
ACTION_UNKNOWN = ("fill_missing", "Filled {n} missing values with 'Unknown'",
                  "No mode available, using standard placeholder")
ACTION_DUPLICATES = ("remove_duplicates", "Removed {n} duplicate rows", "Duplicate rows can skew analysis results")
ACTION_OUTLIERS = ("handle_outliers", "Capped {n} outliers to 3×IQR boundaries",
                   "Extreme values can distort statistical analysis")
ACTION_STRIP = ("standardize_text", "Stripped whitespace from {n} values",
                "Remove inconsistent whitespace for better matching")
ACTION_TITLE = ("standardize_text", "Standardized text case, reducing unique values from {before} to {after}",
                "Consistent case improves grouping of similar values")

# Titles of the standard charts. Fixed values.
TITLE_HISTOGRAM = "Distribution of {x}"
TITLE_BAR = "Top values for {x}"
TITLE_PIE = "Composition of {x}"
TITLE_SCATTER = "Relationship between {y} and {x}"
TITLE_BOX = "Box Plot of {y}"
TITLE_LINE = "Trend of {y} over time"
TITLE_BY = " by {group}"
TITLE_HEATMAP = "Correlation Heatmap"
