"""Quality rules and the 0-100 score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkclean.audit import StepLog, StepResult
from sparkclean.functions.missing import col, columns_of
from sparkclean.functions.parsing import try_num
from sparkclean.operators.profile import HIGH_CARDINALITY_RATIO, TableProfile, build_profile

PASS_SCORE = 70.0
# A text column is of mixed type when this share of its values, and not more than the rest, is numeric.
MIXED_SHARE = (0.05, 0.95)

ISSUE_SCHEMA = T.StructType([
    T.StructField("issue_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("affected_columns", T.ArrayType(T.StringType())),
    T.StructField("description", T.StringType()),
    T.StructField("suggested_fix", T.StringType()),
    T.StructField("penalty", T.DoubleType()),
])


@dataclass
class QualityResult(StepResult):
    """`df` holds the issues; the summary is one row."""

    profile: TableProfile
    quality_score: float
    passed: bool
    summary: DataFrame


@dataclass(frozen=True)
class Rule:
    """One row of the rule table: SQL over the facts of a column, or of the table if `whole`.

    Bands (above, severity, penalty) go from the strictest down; the rule is silent at or below the last.
    """

    kind: str
    measure: str
    bands: tuple[tuple[float, str, float], ...]
    text: str
    fix: str
    whole: bool = False


# Limits and penalties of the bands.
STANDARD = (
    Rule("high_missingness", "missing_pct", ((50, "error", 10.0), (20, "warning", 5.0), (0, "info", 1.0)),
         "format_string('%.1f%% of %s is empty', missing_pct, name)",
         "coalesce('impute with ' || strategy, 'decide by hand how to fill it')"),
    Rule("near_duplicates", "duplicate_pct", ((5, "error", 8.0), (1, "warning", 3.0)),
         "format_string('%d rows repeat others (%.1f%% of the table)', duplicates, duplicate_pct)",
         "'run deduplicate_dataset'", whole=True),
    Rule("constant_column", "int(rows > 1 and unique_count < 2)", ((0, "warning", 2.0),),
         "name || ' never changes'", "'leave the column out'"),
)
EXTENDED = (
    Rule("mixed_types", f"int(numeric_share between {MIXED_SHARE[0]} and {MIXED_SHARE[1]})", ((0, "warning", 3.0),),
         "format_string('%.1f%% of the text in %s reads as numbers', 100 * numeric_share, name)", "'run standardize_formats'"),
    Rule("high_cardinality", "if(kind = 'text', unique_count / greatest(rows, 1), 0)", ((HIGH_CARDINALITY_RATIO, "info", 1.0),),
         "format_string('%d different values in %s, %.1f%% of the rows', unique_count, name, 100 * unique_count / greatest(rows, 1))",
         "'leave it out if it is a key, else encode it'"),
)


def _judged(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules that speak up, for all columns and the table, in the order of the table of rules."""
    cells = []
    for number, rule in enumerate(rules):
        measure, who = F.expr(rule.measure), F.col("name").isNull() if rule.whole else F.col("name").isNotNull()
        severity, penalty = F.lit(None).cast("string"), F.lit(None).cast("double")
        for above, level, cost in reversed(rule.bands):
            severity, penalty = F.when(measure > above, level).otherwise(severity), F.when(measure > above, cost).otherwise(penalty)
        cells.append(F.when(who & (measure > rule.bands[-1][0]), F.struct(
            F.lit(number).alias("number"), F.lit(rule.kind).alias("issue_type"), severity.alias("severity"),
            F.array_compact(F.array("name")).alias("affected_columns"), F.expr(rule.text).alias("description"),
            F.expr(rule.fix).alias("suggested_fix"), penalty.alias("penalty"))))
    found = facts.select("position", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("position", "x.*")
    return found.orderBy("number", "position").select(*[f.name for f in ISSUE_SCHEMA])


def issues_of(df: DataFrame, profile: TableProfile, rules: str = "standard") -> list[tuple]:
    """Issues by rule and column: missing values, duplicates, constant columns; then those of the extended rules."""
    shares = numeric_text_shares(df) if rules == "extended" else {}
    table = (profile.rows, profile.duplicate_count, profile.duplicate_pct)
    rows = [(p.position, p.name, p.missing_pct, p.recommended_strategy, p.unique_count, p.inferred_type, shares.get(p.name), *table)
            for p in profile.columns]
    rows.append((len(rows), None, None, None, None, None, None, *table))
    facts = df.sparkSession.createDataFrame(rows, (
        "position int, name string, missing_pct double, strategy string, unique_count long, kind string, numeric_share double, "
        "rows long, duplicates long, duplicate_pct double"))
    return [tuple(r) for r in _judged(facts, STANDARD + (EXTENDED if rules == "extended" else ())).collect()]


def numeric_text_shares(df: DataFrame) -> dict[str, float]:
    """Share of the non-null values of each text column that read as numbers; one aggregate."""
    texts = columns_of(df, (T.StringType,))
    if not texts:
        return {}
    row = df.agg(*[
        (F.count(try_num(col(c))) / F.nullif(F.count(col(c)), F.lit(0))).alias(f"s{i}") for i, c in enumerate(texts)
    ]).first()
    return {c: row[f"s{i}"] for i, c in enumerate(texts) if row[f"s{i}"] is not None}


def score_of(issues: list[tuple]) -> float:
    return max(0.0, min(100.0, 100.0 - sum(issue[-1] for issue in issues)))


def validate_dataset(df: DataFrame, rules: str = "standard", profile: TableProfile | None = None) -> QualityResult:
    """Check a table against the quality rules.

    Pass the profile of the same table version to avoid profiling it again. `rules="extended"` adds the
    mixed-type and high-cardinality rules; they are off by default so scores stay comparable.
    """
    if rules not in ("standard", "extended"):
        raise ValueError(f"rules must be 'standard' or 'extended', not {rules!r}")
    spark = df.sparkSession
    profile = profile or build_profile(df)
    issues = issues_of(df, profile, rules)
    score = round(score_of(issues), 2)
    passed = score >= PASS_SCORE
    summary = spark.createDataFrame(
        [(score, passed, len(issues), profile.rows, profile.cols, profile.total_missing_pct,
          profile.duplicate_count, profile.duplicate_pct)],
        "quality_score double, passed boolean, n_issues int, row_count long, col_count int, "
        "total_missing_pct double, duplicate_count long, duplicate_pct double")
    log = StepLog("validate_dataset", profile.cols, profile.cols, 1.0, profile.rows, profile.rows,
                  detail={"quality_score": score, "passed": passed, "n_issues": len(issues)})
    return QualityResult(spark.createDataFrame(issues, ISSUE_SCHEMA), log, profile, score, passed, summary)


def quality_report(result: QualityResult) -> DataFrame:
    """One row that holds score, gate, shape, issues and the profile summary; write it with `.write.json`."""
    p = result.profile
    row = (result.quality_score, result.passed, [tuple(r) for r in result.df.collect()], p.rows, p.cols,
           p.total_missing_pct, p.duplicate_count, p.duplicate_pct)
    schema = T.StructType([
        T.StructField("quality_score", T.DoubleType()), T.StructField("passed", T.BooleanType()),
        T.StructField("issues", T.ArrayType(ISSUE_SCHEMA)),
        T.StructField("row_count", T.LongType()), T.StructField("col_count", T.IntegerType()),
        T.StructField("total_missing_pct", T.DoubleType()),
        T.StructField("duplicate_count", T.LongType()), T.StructField("duplicate_pct", T.DoubleType()),
    ])
    return result.df.sparkSession.createDataFrame([row], schema)
