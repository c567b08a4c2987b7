"""Table schemas and fixed vocabularies of the permutation-association data model."""

from pyspark.sql import types as T

# Result header as association tools print it, in column order.
RAW_HEADER = [
    "variant",
    "af",
    "filter-pvalue",
    "lrt-pvalue",
    "beta",
    "beta-std-err",
    "variant_h2",
    "notes",
]

# Texts read as a missing number.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
]

# Texts read as a missing sample id.
MISSING_IDS = [*NULL_TOKENS, "<NA>", "None"]

# Quality flags an association tool may put into `notes`.
NOTE_FLAGS = [
    "af-filter",
    "bad-chisq",
    "pre-filtering-failed",
    "high-bse",
    "perfectly-separable-data",
    "matrix-inversion-error",
    "firth-fail",
    "missing-data-error",
    "lrt-filtering-failed",
]

# Outcomes of one result file.
CONVERTED = "converted"
CONVERT_FAILED = "convert_failed"
SCAN_FAILED = "scan_failed"

MIN_AF = 0.05
MAX_AF = 0.95
DEFAULT_PERMUTATIONS = 10_000
DEFAULT_SEED = 84
PREVIEW_ROWS = 200


def column_name(raw: str) -> str:
    """SQL-friendly spelling of a raw header name."""
    return raw.replace("-", "_")


RESULT_COLUMNS = [column_name(c) for c in RAW_HEADER]
TEXT_COLUMNS = ["variant", "notes"]
NUMERIC_COLUMNS = [c for c in RESULT_COLUMNS if c not in TEXT_COLUMNS]

RESULT = T.StructType(
    [T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.FloatType()) for c in RESULT_COLUMNS]
)
REFERENCE = T.StructType(
    [T.StructField("variant_id", T.IntegerType()), T.StructField("variant", T.StringType())]
)
FACT = T.StructType(
    [T.StructField("variant_id", T.IntegerType())] + [f for f in RESULT.fields if f.name != "variant"]
)
PHENOTYPE = T.StructType(
    [T.StructField("sample", T.StringType()), T.StructField("phenotype", T.DoubleType())]
)
RUN_EVENT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("txt_path", T.StringType()),
        T.StructField("parquet_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
RUN_SUMMARY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("population", T.StringType()),
        T.StructField("traits", T.ArrayType(T.StringType())),
        T.StructField("variant_types", T.ArrayType(T.StringType())),
        T.StructField("n_perms", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("output_dir", T.StringType()),
    ]
)
