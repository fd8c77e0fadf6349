"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

SOURCE_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

FILE_METRICS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("lines", T.IntegerType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("exported_symbols", T.ArrayType(T.StringType())),
    T.StructField("import_count", T.IntegerType()),
    T.StructField("imported_from", T.ArrayType(T.StringType())),
    T.StructField("imported_symbol_names", T.ArrayType(T.StringType())),
    T.StructField("has_syntax_errors", T.BooleanType()),
])

COMMIT_FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("committed_at", T.TimestampType()),
    T.StructField("path", T.StringType()),
])

BASELINE = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("lines", T.IntegerType()),
    T.StructField("complexity", T.IntegerType()),
    T.StructField("fan_in", T.LongType()),
    T.StructField("export_count", T.IntegerType()),
    T.StructField("touch_count", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("tool_version", T.StringType()),
])

# JSON document form of one repository's baseline (one document per repo).
BASELINE_ENTRY = T.StructType([
    T.StructField("lines", T.IntegerType()),
    T.StructField("cyclomaticComplexity", T.IntegerType()),
    T.StructField("fanIn", T.LongType()),
    T.StructField("exportCount", T.IntegerType()),
    T.StructField("touchCount", T.LongType()),
])
BASELINE_DOC = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("toolVersion", T.StringType()),
    T.StructField("files", T.MapType(T.StringType(), BASELINE_ENTRY)),
])

SPLIT_ENTRY = T.StructType([
    T.StructField("newFileName", T.StringType()),
    T.StructField("responsibility", T.StringType()),
    T.StructField("movedExports", T.ArrayType(T.StringType())),
])

ANSWER = T.StructType([
    T.StructField("inferredOriginalPurpose", T.StringType()),
    T.StructField("currentResponsibilities", T.ArrayType(T.StringType())),
    T.StructField("hasDrifted", T.BooleanType()),
    T.StructField("driftSummary", T.StringType()),
    T.StructField("suggestedSplit", T.ArrayType(SPLIT_ENTRY)),
])

RESPONSES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("raw_text", T.StringType()),
])

STAGED_CHANGES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("commit_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
])

# Staged changes with the time that their commit closes by.
TIMED_CHANGES = T.StructType([*STAGED_CHANGES.fields, T.StructField("staged_at", T.TimestampType())])
