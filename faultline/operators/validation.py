"""Validation of model answers about drift candidates (X1-X8), pairing of
answers with candidates (J5) and the run summary (A6, A7).

Everything per answer is row-local: one ``select`` chain of built-in JSON,
variant and higher-order array functions, no UDF and no shuffle. A failure on
one row becomes an error row; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.schemas import SPLIT_ENTRY
from faultline.session import stored

# ---------------------------------------------------------------- fixed values
REQUIRED_FIELDS = ["inferredOriginalPurpose", "currentResponsibilities", "hasDrifted",
                   "driftSummary"]
ERROR_PURPOSE = "ERROR"
PARSE_PREVIEW, MISSING_PREVIEW = 300, 500
MSG_PARSE = "Failed to parse model response as JSON: "
MSG_MISSING = "Model response missing field(s): "
MSG_MISSING_RAW = ". Raw response (first 500 chars): "
MSG_CONTRADICTORY = ("Model reported hasDrifted:false but still provided a suggestedSplit — "
                     "contradictory. Suppressing the split since the \"not drifted\" verdict "
                     "takes precedence.")
MSG_NO_PLAN = ("Model reported hasDrifted:true but provided no suggestedSplit — a drift "
               "verdict without an actionable plan. Consider re-running this file.")
MSG_DUPLICATE = ("\"%s\" appears in multiple suggested files (%s) — treat this split as a "
                 "starting point, not a ready-to-execute plan.")
MSG_NO_EXPORTS = ("This file has no real exported symbols (everything is likely trapped in "
                  "closures), so the suggested symbol names below are the model's best guess "
                  "from reading the code, not verified exports — expect to rename/adjust when "
                  "actually decomposing.")
MSG_IMPORTED = ("%d suggested symbol(s) are IMPORTED into this file from elsewhere, not "
                "defined here — this file doesn't actually own this code, so it can't be "
                "\"moved\" out of it: %s.")
MSG_UNVERIFIED = ("%d suggested symbol(s) don't match this file's actual exports and may be "
                  "unexported internal names: %s.")
MSG_FAILED = "Analysis failed: "
# Our own wording (the reference surfaces a runtime exception text here).
MSG_NOT_OBJECT = "Model response is not a JSON object: "
MSG_BAD_SPLIT = "Model response has a malformed suggestedSplit (entries need movedExports arrays)"
MSG_NO_ANSWER = "No model answer for this file"
MSG_MANY_ANSWERS = "%d model answers for this file; expected one"

# White space as JavaScript's trim and \s have it.
WHITE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
FENCE = f"^```json{WHITE}*|{WHITE}*```\\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sql_str(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def clean_answer(raw) -> Column:
    """Drop a leading ```` ```json ```` fence and a trailing fence, trim."""
    return F.regexp_replace(F.regexp_replace(_c(raw), FENCE, ""), f"^{WHITE}+|{WHITE}+\\z", "")


def parse_answer(df: DataFrame, cleaned) -> Column:
    """The cleaned text as one strict JSON value (a variant; null if it isn't
    one). Of a repeated key the last value counts, as in JavaScript."""
    # Read when a plan is built; without it a repeated key makes the text null.
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    whole, complete = _wrapped(_c(cleaned))
    return F.when(complete, F.try_variant_get(whole, "$.answer", "variant"))


def _wrapped(cleaned: Column) -> tuple[Column, Column]:
    """The text parsed as a member of an object, and whether it is one value: what
    follows a text's first value would be ignored, and then the object's last
    member, the text's checksum, doesn't arrive."""
    check = F.crc32(cleaned.cast("binary"))
    whole = F.try_parse_json(F.concat(F.lit('{"answer":'), cleaned, F.lit(',"checksum":'), check.cast("string"), F.lit("}")))
    return whole, F.try_variant_get(whole, "$.checksum", "long") == check


def _vtype(v: Column, path: str) -> Column:
    """JSON type of a member: NULL when absent, VOID for JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _truthy(v: Column, path: str) -> Column:
    """JavaScript truthiness of a JSON member."""
    t = _vtype(v, path)
    return (F.when(t == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
            .when(t == "STRING", F.length(F.try_variant_get(v, path, "string")) > 0)
            .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.lit(True))
            .when(t.isin("VOID") | t.isNull(), F.lit(False))
            .otherwise(F.coalesce(F.try_variant_get(v, path, "double") != 0, F.lit(True))))


def _entry(e: Column) -> Column:
    """A split entry of the variant as a typed struct; other entries are null."""
    return F.try_variant_get(e, "$", SPLIT_ENTRY.simpleString())


def validate_answers(df: DataFrame, raw: str = "raw_text", exports: str = "exported_symbols",
                     imports: str = "imported_symbol_names") -> DataFrame:
    """Adds the validated analysis columns to every answer row (X1-X8):

    ``is_error, inferred_original_purpose, current_responsibilities,
    has_drifted, drift_summary, suggested_split, warnings``.

    Warnings come in the order consistency, duplicates, unknown symbols.
    Error rows carry purpose ``ERROR``, empty arrays, ``has_drifted`` false, a
    null split and ``Analysis failed: <reason>``.
    """
    rawc = F.coalesce(_c(raw), F.lit(""))
    # One parse per row; every member is taken from the variant.
    parsed = df.select("*", clean_answer(raw).alias("_clean")).select("*", parse_answer(df, "_clean").alias("_v"))
    v, strings = F.col("_v"), F.array().cast("array<string>")
    staged = parsed.select(
        "*", F.schema_of_variant(v).alias("_type"),
        *[_vtype(v, f"$.{k}").alias(f"_{k}") for k in REQUIRED_FIELDS],
        _vtype(v, "$.suggestedSplit").alias("_split_t"),
        F.try_variant_get(v, "$.suggestedSplit", "array<variant>").alias("_split_v")).select(
        "*", F.col("_type").startswith("OBJECT").alias("_is_obj"),
        F.col("_type").startswith("ARRAY").alias("_is_arr"),
        _truthy(v, "$.hasDrifted").alias("_drifted"),
        F.try_variant_get(v, "$.suggestedSplit", "string").alias("_split_s"),
        F.coalesce(_c(exports), strings).alias("_exp"),
        F.coalesce(_c(imports), strings).alias("_imp"))
    # Required keys present (a null value counts as present).
    missing = F.filter(F.array(*[F.when(F.col(f"_{k}").isNull(), F.lit(k)) for k in REQUIRED_FIELDS]), lambda k: k.isNotNull())
    # Consistency of verdict and split (JavaScript truthiness and length).
    split_t = F.col("_split_t")
    is_array = split_t.startswith("ARRAY")
    real_split = (F.when(is_array, F.size("_split_v") > 0)
                  .when(split_t == "STRING", F.length("_split_s") > 0)
                  .otherwise(F.lit(False)))
    split_truthy = _truthy(v, "$.suggestedSplit")
    drifted = F.col("_drifted")
    suppress = ~drifted & real_split
    no_plan = drifted & ~real_split
    retained = ~suppress & split_truthy
    # An entry that is not an object or lacks a movedExports array cannot be
    # iterated: such a retained split makes the row an error.
    bad_entry = F.exists(F.col("_split_v"), lambda e: ~F.coalesce(
        _vtype(e, "$.movedExports").startswith("ARRAY"), F.lit(False)))
    bad_split = retained & (~is_array | bad_entry)
    s2 = staged.select(
        "*", missing.alias("_missing"), suppress.alias("_suppress"), no_plan.alias("_no_plan"),
        bad_split.alias("_bad_split"),
        F.when(~suppress & is_array, F.transform("_split_v", _entry)).alias("_split"))
    # X4 / A8 row-local: symbols listed more than once over all entries, and
    # Symbols not exported here — imported, or unverified locals. Written
    # as SQL lambda expressions: one parse each instead of one JVM call per
    # expression node, which keeps building this plan cheap.
    s3 = s2.select("*", F.expr(
        "coalesce(flatten(transform(_split, e -> transform(coalesce(e.movedExports, array()), "
        "s -> named_struct('sym', s, 'file', e.newFileName)))), "
        "cast(array() as array<struct<sym:string,file:string>>))").alias("_occ"))
    s4 = s3.select("*", F.expr(
        "transform(filter(array_distinct(transform(_occ, o -> o.sym)), "
        "s -> size(filter(_occ, o -> o.sym <=> s)) > 1), "
        f"s -> format_string({_sql_str(MSG_DUPLICATE)}, coalesce(s, 'null'), "
        "array_join(transform(filter(_occ, o -> o.sym <=> s), o -> o.file), ', ', '')))"
    ).alias("_dup_w"), F.expr(
        "filter(transform(_occ, o -> o.sym), s -> NOT coalesce(array_contains(_exp, s), false))"
    ).alias("_foreign"))
    s5 = s4.select(
        "*",
        F.expr("array_distinct(filter(_foreign, s -> coalesce(array_contains(_imp, s), false)))")
        .alias("_imported"),
        F.expr("array_distinct(filter(_foreign, s -> NOT coalesce(array_contains(_imp, s), false)))")
        .alias("_local"))
    s3 = s5.select("*", F.expr(
        "CASE WHEN _split IS NULL THEN cast(array() AS array<string>) "
        "WHEN size(_exp) = 0 THEN (CASE WHEN exists(_split, e -> size(e.movedExports) > 0) "
        f"THEN array({_sql_str(MSG_NO_EXPORTS)}) ELSE cast(array() AS array<string>) END) "
        "ELSE filter(array("
        f"CASE WHEN size(_imported) > 0 THEN format_string({_sql_str(MSG_IMPORTED)}, "
        "size(_imported), array_join(_imported, ', ', '')) END, "
        f"CASE WHEN size(_local) > 0 THEN format_string({_sql_str(MSG_UNVERIFIED)}, "
        "size(_local), array_join(_local, ', ', '')) END), w -> w IS NOT NULL) END"
    ).alias("_unknown"))
    dup_warnings, unknown = F.col("_dup_w"), F.col("_unknown")
    consistency = F.filter(F.array(
        F.when(F.col("_suppress"), F.lit(MSG_CONTRADICTORY)),
        F.when(F.col("_no_plan"), F.lit(MSG_NO_PLAN))), lambda w: w.isNotNull())
    warnings = F.concat(consistency, dup_warnings, unknown)
    # Error reason, in the order the checks run.
    reason = (F.when(F.col("_v").isNull(), F.concat(F.lit(MSG_PARSE), F.substring(rawc, 1, PARSE_PREVIEW)))
              .when(~F.col("_is_obj") & ~F.col("_is_arr"),
                    F.concat(F.lit(MSG_NOT_OBJECT), F.substring(rawc, 1, PARSE_PREVIEW)))
              .when(F.size("_missing") > 0,
                    F.concat(F.lit(MSG_MISSING), F.array_join("_missing", ", "),
                             F.lit(MSG_MISSING_RAW), F.substring(rawc, 1, MISSING_PREVIEW)))
              .when(F.col("_bad_split"), F.lit(MSG_BAD_SPLIT)))
    out = s3.select("*", reason.alias("_reason"), warnings.alias("_warnings"))
    err = F.col("_reason").isNotNull()
    empty = F.array().cast("array<string>")
    # A list that came as one value stays, as the only entry.
    responsibilities = F.coalesce(F.try_variant_get(v, "$.currentResponsibilities", "array<string>"), F.when(
        F.col("_currentResponsibilities") != "VOID", F.array(F.try_variant_get(v, "$.currentResponsibilities", "string"))))
    result = out.select(
        *[c for c in df.columns],
        err.alias("is_error"),
        F.when(err, F.lit(ERROR_PURPOSE)).otherwise(F.try_variant_get(v, "$.inferredOriginalPurpose", "string"))
        .alias("inferred_original_purpose"),
        F.when(err, empty).otherwise(responsibilities)
        .alias("current_responsibilities"),
        F.when(err, F.lit(False)).otherwise(F.col("_drifted")).alias("has_drifted"),
        F.when(err, F.concat(F.lit(MSG_FAILED), F.col("_reason")))
        .otherwise(F.try_variant_get(v, "$.driftSummary", "string")).alias("drift_summary"),
        F.when(err, F.lit(None)).otherwise(F.col("_split")).alias("suggested_split"),
        F.when(err, empty).otherwise(F.col("_warnings")).alias("warnings"))
    return _worked_out(result)


def _worked_out(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row. A filter on what was worked out stays above
    it: pushed down, it would hold all of the expressions once per use, with their parse."""
    return df.select(F.inline(F.array(F.struct("*"))))


def pair_answers(candidates: DataFrame, responses: DataFrame, keys=("repo",),
                 path: str = "path") -> DataFrame:
    """Every candidate yields exactly one row. Answers meet the candidates
    first and are then counted per file (without their texts, a hash aggregate);
    a file with several answers keeps the count and becomes an error row at
    validation, as does a file with none."""
    on = [*keys, path]
    candidates = stored(candidates, "candidates")  # a few rows, used three times
    mine = responses.join(candidates.select(*on), on, "left_semi")
    counts = mine.groupBy(*on).agg(F.count(F.lit(1)).alias("_answers"))
    single = mine.join(counts.filter("_answers = 1").select(*on), on, "left_semi").select(*on, "raw_text")
    return candidates.join(counts, on, "left").join(single, on, "left")


def validate_paired(paired: DataFrame, **kw) -> DataFrame:
    """Validation of paired answers; unanswered candidates and candidates
    with more than one answer become error rows."""
    v = validate_answers(paired, **kw)
    n = F.coalesce(F.col("_answers"), F.lit(0))
    bad = n != 1
    reason = F.when(n == 0, F.lit(MSG_FAILED + MSG_NO_ANSWER)).otherwise(
        F.format_string(MSG_FAILED + MSG_MANY_ANSWERS, n))
    empty = F.array().cast("array<string>")
    return v.select(
        *[c for c in v.columns if c not in (
            "_answers", "is_error", "inferred_original_purpose", "current_responsibilities",
            "has_drifted", "drift_summary", "suggested_split", "warnings")],
        (F.col("is_error") | bad).alias("is_error"),
        F.when(bad, F.lit(ERROR_PURPOSE)).otherwise(F.col("inferred_original_purpose"))
        .alias("inferred_original_purpose"),
        F.when(bad, empty).otherwise(F.col("current_responsibilities")).alias("current_responsibilities"),
        F.when(bad, F.lit(False)).otherwise(F.col("has_drifted")).alias("has_drifted"),
        F.when(bad, reason).otherwise(F.col("drift_summary")).alias("drift_summary"),
        F.when(bad, F.lit(None)).otherwise(F.col("suggested_split")).alias("suggested_split"),
        F.when(bad, empty).otherwise(F.col("warnings")).alias("warnings"))


def drift_summary(analyses: DataFrame, keys=("repo",)) -> DataFrame:
    """Analysed, drifted, errored, with-warnings; ``all_failed`` iff
    at least one analysis and every one errored."""
    agg = analyses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("analyzed"),
        F.count_if(F.col("has_drifted")).alias("drifted"),
        F.count_if(F.col("is_error")).alias("errored"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"))
    return agg.withColumn("all_failed", (F.col("analyzed") > 0)
                          & (F.col("errored") == F.col("analyzed")))


def required_fields(df: DataFrame, raw: str = "raw_text", required=None) -> DataFrame:
    """X1+X2 on their own: ``df`` with ``is_object`` (is the cleaned text a strict JSON
    object) and ``missing``, the required keys it lacks in the given order, null for
    anything else. A null value counts as present. The text is parsed once."""
    required = REQUIRED_FIELDS if required is None else required
    cleaned = df.select("*", clean_answer(raw).alias("_clean"))
    whole, _ = _wrapped(F.col("_clean"))
    parsed = cleaned.select("*", whole.alias("_whole"))
    complete = F.try_variant_get("_whole", "$.checksum", "long") == F.crc32(F.col("_clean").cast("binary"))
    checked = parsed.select("*", F.coalesce(complete & _vtype(F.col("_whole"), "$.answer").startswith("OBJECT"), F.lit(False)).alias("is_object"))
    lacks = [F.when(_vtype(F.col("_whole"), f"$.answer.{k}").isNull(), F.lit(k)) for k in required]
    missing = F.when(F.col("is_object"), F.filter(F.array(*lacks), lambda k: k.isNotNull()))
    return checked.select("*", missing.alias("missing")).drop("_clean", "_whole")
