"""Data cleaning and data quality for tables, on Spark DataFrames."""

from sparkclean.audit import StepLog, StepResult, audit_log, schema_digest, table_checksum
from sparkclean.operators.dedup import deduplicate_dataset, drop_exact_duplicates
from sparkclean.operators.fuzzy import fuzzy_dedup, fuzzy_pairs
from sparkclean.operators.impute import drop_sparse_columns, handle_missing_values
from sparkclean.operators.merge import match_stats, merge_datasets
from sparkclean.operators.profile import build_profile, describe_all, flag_outliers, profile_columns, profile_dataset
from sparkclean.operators.quality import validate_dataset
from sparkclean.operators.standardize import standardize_formats
from sparkclean.plans.cleaning import CleaningPlan, Step
from sparkclean.sources.files import load_dataset, schema_summary
from sparkclean.sources.report import generate_output, quality_report_markdown
from sparkclean.sources.snapshots import Snapshots, write_csv

__all__ = [
    "CleaningPlan", "Snapshots", "Step", "StepLog", "StepResult", "audit_log", "build_profile",
    "deduplicate_dataset", "describe_all", "drop_exact_duplicates", "drop_sparse_columns", "flag_outliers",
    "fuzzy_dedup", "fuzzy_pairs", "generate_output", "handle_missing_values", "load_dataset", "match_stats",
    "merge_datasets", "profile_columns", "profile_dataset", "quality_report_markdown", "schema_digest",
    "schema_summary", "standardize_formats", "table_checksum", "validate_dataset", "write_csv",
]
