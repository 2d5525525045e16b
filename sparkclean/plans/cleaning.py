"""A cleaning plan: a list of steps applied one after the other to a table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from sparkclean.audit import StepLog, StepResult
from sparkclean.operators.dedup import deduplicate_dataset
from sparkclean.operators.impute import handle_missing_values
from sparkclean.operators.merge import merge_datasets
from sparkclean.operators.profile import TableProfile, build_profile, profile_columns
from sparkclean.operators.quality import quality_report, validate_dataset
from sparkclean.operators.standardize import standardize_formats
from sparkclean.sources.files import load_dataset
from sparkclean.sources.report import generate_output
from sparkclean.sources.snapshots import Snapshots


@dataclass
class ProfileResult(StepResult):
    profile: TableProfile | None = None


def profile_dataset(df: DataFrame, approx_rsd: float | None = None, accuracy: int | None = None) -> ProfileResult:
    """The profile of a table as a step with a log entry."""
    profile = build_profile(df, approx_rsd, accuracy)
    log = StepLog("profile_dataset", profile.cols, profile.cols, 1.0, profile.rows, profile.rows,
                  detail={"quality_score_estimate": profile.quality_score_estimate, "high_priority_issues": profile.high_priority_issues})
    return ProfileResult(df, log, profile)


def load_into(df: DataFrame | None, path: str, **options: Any) -> StepResult:
    """The first step of a plan: the table in `path` instead of `df`."""
    from pyspark.sql import SparkSession

    return load_dataset(df.sparkSession if df is not None else SparkSession.active(), path, **options)


STEPS: dict[str, Callable[..., StepResult]] = {
    "load_dataset": load_into,
    "profile_dataset": profile_dataset,
    "handle_missing_values": handle_missing_values,
    "standardize_formats": standardize_formats,
    "deduplicate_dataset": deduplicate_dataset,
    "merge_datasets": merge_datasets,
    "validate_dataset": validate_dataset,
    "generate_output": generate_output,
}
#: Steps that leave the table as it is.
READ_ONLY_STEPS = {"profile_dataset", "validate_dataset", "generate_output"}


@dataclass
class Step:
    """A step name and the arguments of its operator."""

    name: str
    arguments: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.name not in STEPS:
            raise ValueError(f"unknown step '{self.name}'. Choose from: {list(STEPS)}")


@dataclass
class PlanResult:
    df: DataFrame
    logs: list[StepLog]
    results: list[StepResult]
    failed_step: int | None = None
    error: Exception | None = None
    #: Numbers of the steps whose output was there already.
    reused: list[int] = field(default_factory=list)


def _fingerprint(spark, path: str) -> str:
    """Names, sizes and times of the files under a path: another one if any of them changes."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.listStatus(place) if files.exists(place) else []
    return json.dumps(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def step_key(step: Step, snapshots: Snapshots, input_key: str | None) -> str | None:
    """What a step's output follows from: its name, its arguments and its input; None if that can't be told.

    The input of a first step that loads files are these files; that of other steps is the version in the store. Arguments
    that are no plain values, as DataFrames, can't be compared from run to run.
    """
    if step.name == "load_dataset":
        given = _fingerprint(snapshots.spark, str(step.arguments.get("path")))
    elif input_key is None:
        return None
    else:
        given = input_key
    try:
        text = json.dumps([step.name, step.arguments, given], sort_keys=True)
    except TypeError:
        return None
    return hashlib.sha256(text.encode()).hexdigest()


class CleaningPlan:
    """Steps run in order and stop at the first that fails; what ran before it is kept.

    With `snapshots` every step's output is written and the next step reads it back; without, the steps
    build on one lazy DataFrame. With `resume` as well, steps that the store shows as done, with the same arguments on
    the same input, are not run again: a second run starts no job for them, and one after a failure goes on at the step
    that failed.
    """

    def __init__(self, steps: list[Step]):
        self.steps = steps

    def run(self, df: DataFrame | None = None, snapshots: Snapshots | None = None, input_key: str | None = None, resume: bool = False) -> PlanResult:
        """`df` may be left out if the first step loads a table. A profile made since the last change is used again."""
        if resume and snapshots is None:
            raise ValueError("resume needs snapshots to go on from")
        out = PlanResult(df, [], [])
        profile: TableProfile | None = None
        for number, step in enumerate(self.steps):
            try:
                key = step_key(step, snapshots, input_key) if resume else None
                done = snapshots.made_by(key) if key else None
                if done:
                    log = StepLog(step.name, done["col_count"], done["col_count"], 1.0, done["row_count"], done["row_count"],
                                  checksum_after=done["checksum"], detail={"reused": done["artifact_key"]})
                    if step.name not in READ_ONLY_STEPS:
                        profile, input_key = None, done["artifact_key"]
                        out.df = snapshots.read(input_key)
                    out.results.append(StepResult(out.df, log))
                    out.logs.append(log)
                    out.reused.append(number)
                    continue
                arguments = dict(step.arguments)
                if step.name == "validate_dataset" and profile is not None:
                    arguments.setdefault("profile", profile)
                if step.name == "generate_output":
                    if snapshots is None:
                        raise ValueError("generate_output needs snapshots to write to")
                    result = generate_output(out.df, snapshots, input_key=input_key, **arguments)
                else:
                    result = STEPS[step.name](out.df, **arguments)
                if step.name not in READ_ONLY_STEPS:
                    profile = None
                    if snapshots is not None:
                        input_key = snapshots.write(result, input_key, key)
                        result.df = snapshots.read(input_key)
                    out.df = result.df
                elif step.name == "profile_dataset":
                    profile = result.profile
                    if snapshots is not None:
                        snapshots.write_summary(step.name, "profile", profile_columns(out.df, profile), result.log, input_key, key)
                elif step.name == "validate_dataset":
                    profile = result.profile
                    if snapshots is not None:
                        snapshots.write_summary(step.name, "report", quality_report(result), result.log, input_key, key)
            except Exception as error:  # the failed step is reported, not skipped
                out.failed_step, out.error = number, error
                break
            out.results.append(result)
            out.logs.append(result.log)
        return out
