import math
import random
import struct
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkclean.operators import profile as P
from sparkclean.operators import impute, percentiles, stats
from sparkclean.operators.quality import quality_report, validate_dataset


def by_name(profile):
    return {p.name: p for p in profile.columns}


def test_employees(employees):
    p = P.build_profile(employees)
    assert (p.rows, p.cols, p.total_missing_pct, p.duplicate_count, p.duplicate_pct) == (5, 4, 15.0, 1, 20.0)
    assert p.quality_score_estimate == 86.5
    cols = by_name(p)
    assert cols["Age"].inferred_type == "numeric" and cols["Age"].recommended_strategy == "median"
    assert cols["Age"].numeric["median"] == 29.0 and cols["Salary"].numeric["mean"] == 51250.0
    assert cols["JoinDate"].inferred_type == "datetime"
    assert cols["JoinDate"].dates == {
        "min_date": "2019-06-01", "max_date": "2022-11-30", "inferred_format": "%Y-%m-%d"}
    assert cols["Name"].inferred_type == "categorical"
    assert cols["Name"].top_values == [("Alice", 2), ("Bob", 1), ("Charlie", 1)]
    assert cols["Name"].entropy == 1.5
    assert p.high_priority_issues == ["1 rows repeat others (20.0% of the table)"]


def test_nan_is_missing_and_infinity_is_not(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "x double")
    x = P.build_profile(df).columns[0]
    assert x.missing_count == 2 and x.unique_count == 2
    assert x.numeric["max"] is None and x.numeric["min"] == 1.0


def test_empty_and_single_row(spark, employees):
    empty = P.build_profile(employees.where(F.lit(False)))
    assert empty.rows == 0 and empty.quality_score_estimate == 100 and not any(c.anomalies for c in empty.columns)
    single = P.build_profile(spark.createDataFrame([("Alice", 30.0)], "Name string, Age double"))
    assert not any(c.anomalies for c in single.columns)
    assert by_name(single)["Age"].numeric["std"] is None


def test_anomalies(spark):
    df = spark.createDataFrame([(float(v), "active", None if v else "x") for v in (50000, 52000, 49000, 51000, 500000)],
                               "salary double, status string, gone string")
    cols = by_name(P.build_profile(df))
    assert cols["salary"].anomalies == [{
        "anomaly_type": "possible_outliers", "description": "1 values lie outside the quartile fences",
        "affected_count": 1, "affected_pct": 20.0}]
    assert [a["anomaly_type"] for a in cols["status"].anomalies] == ["constant_column"]
    assert [a["anomaly_type"] for a in cols["gone"].anomalies] == ["high_missingness", "constant_column"]
    assert cols["gone"].recommended_strategy == "drop_row"
    row = P.iqr_outliers(df, ["salary"]).first()
    assert (row["q25"], row["q75"], row["lower_bound"], row["upper_bound"]) == (50000, 52000, 47000, 55000)
    assert [r["is_outlier"] for r in P.flag_outliers(df, "salary").collect()] == [False] * 4 + [True]


def test_boolean_nested_and_odd_names(spark):
    df = spark.sql("SELECT true AS `a.b`, array(1, 2) AS list, struct(1 AS x) AS `back``tick`, date'2020-01-01' AS d "
                   "UNION ALL SELECT NULL, array(1, 2), struct(1 AS x), NULL")
    cols = by_name(P.build_profile(df))
    assert cols["a.b"].inferred_type == "boolean" and cols["a.b"].recommended_strategy == "mode"
    assert cols["list"].unique_count == 1 and cols["d"].inferred_type == "datetime"
    assert P.profile_columns(df).count() == 4


def test_datetime_with_seconds(spark):
    df = spark.sql("SELECT timestamp'2020-01-01 10:00:05' AS t UNION ALL SELECT timestamp'2020-01-02 00:00:00'")
    row = P.datetime_stats(df).first()
    assert tuple(row) == ("t", "2020-01-01 10:00:05", "2020-01-02 00:00:00", "%Y-%m-%d %H:%M:%S")


def test_describe_all(employees):
    rows = {r["name"]: r for r in P.describe_all(employees).collect()}
    assert (rows["Name"]["count"], rows["Name"]["unique"], rows["Name"]["top"], rows["Name"]["freq"]) == (4, 3, "Alice", 2)
    assert rows["Age"]["q50"] == 29.0 and rows["Age"]["top"] is None


@pytest.mark.parametrize("seed", range(4))
def test_narrowed_percentiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    shapes = [
        lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: rng.expovariate(1e-6),
        lambda: rng.choice([0.0, -0.0, 5.0, rng.random()]),
    ]
    data = [tuple(None if rng.random() < 0.1 else s() for s in shapes) for _ in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = percentiles.exact_percentiles(df, {c: probs for c in "abcd"}, read_rows=20, bits=5)
    for i, c in enumerate("abcd"):
        values = np.array([r[i] for r in data if r[i] is not None])
        assert found[c] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12)


def test_narrowed_percentiles_with_infinities_and_empty_column(spark):
    data = [(float(i), None) for i in range(200)] + [(float("inf"), None), (float("-inf"), None)]
    df = spark.createDataFrame(data, "a double, e double")
    found = percentiles.exact_percentiles(df, {"a": [0.5, 0.25], "e": [0.5]}, read_rows=5, bits=3)
    assert found == {"a": [99.5, 49.25], "e": [None]}


def test_approx_switches(spark):
    df = spark.range(1000).withColumn("t", F.concat(F.lit("v"), F.col("id") % 7))
    p = by_name(P.build_profile(df, approx_rsd=0.02, accuracy=1000))
    assert abs(p["t"].unique_count - 7) <= 1 and abs(p["id"].numeric["median"] - 499.5) < 5


def test_partitioning_changes_nothing(spark, employees):
    names = ["Name", "JoinDate"]  # sums of doubles differ in the last bit with their order
    whole = P.profile_columns(employees.select(names)).collect()
    numbers = P.numeric_stats(employees).select("name", "median", "q25", "q75", "min", "max").collect()
    for n in (1, 7):
        other = employees.repartition(n)
        assert P.profile_columns(other.select(names)).collect() == whole
        assert P.numeric_stats(other).select("name", "median", "q25", "q75", "min", "max").collect() == numbers


def test_smallest_texts_are_limited_before_the_shuffle(spark):
    found = stats._smallest(spark.range(100).withColumn("s", F.col("id").cast("string")).repartition(3), ["s"], 4)
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    assert sorted(r["value"] for r in found.collect()) == ["0", "1", "10", "11"]


# --- validation ---------------------------------------------------------------------------------

def scored(df, **options):
    result = validate_dataset(df, **options)
    return result.quality_score, result.passed


def test_scores(spark, employees):
    assert scored(employees) == (89.0, True)
    dirty = spark.createDataFrame([(1.0, "x")] + [(None, "x")] * 4, "col_a double, col_b string")
    assert scored(dirty) == (78.0, True)
    very_dirty = spark.createDataFrame([(1.0,) * 4] + [(None,) * 4] * 4, "a double, b double, c double, d double")
    assert scored(very_dirty) == (44.0, False)
    perfect = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(10)], "id long, name string, value double")
    assert scored(perfect) == (100.0, True)
    assert scored(perfect.where("id < 0")) == (100.0, True)
    worst = spark.createDataFrame([(None,) * 12] * 3, ", ".join(f"c{i} double" for i in range(12)))
    assert scored(worst) == (0.0, False)


def test_issue_rows_and_report(employees):
    result = validate_dataset(employees)
    kinds = [(r["issue_type"], r["severity"]) for r in result.df.collect()]
    assert kinds == [("high_missingness", "info")] * 3 + [("near_duplicates", "error")]
    report = quality_report(result).first()
    assert report["quality_score"] == 89.0 and len(report["issues"]) == 4 and report["duplicate_count"] == 1


def test_extended_rules(spark):
    df = spark.createDataFrame([(str(i) if i % 2 else f"w{i}", f"name {i}") for i in range(10)], "mixed string, id string")
    assert scored(df) == (100.0, True)
    kinds = {r["issue_type"] for r in validate_dataset(df, rules="extended").df.collect()}
    assert kinds == {"mixed_types", "high_cardinality"}
    with pytest.raises(ValueError):
        validate_dataset(df, rules="none")


def test_percentiles_keep_every_digit(spark):
    """Integers beyond 2^53, decimals of 18 and of 38 digits, read at once or digit by digit."""
    rng = random.Random(3)
    ints = [2**53 + 1] * 3 + [-(2**63), 2**63 - 1] + [rng.randint(-(2**63), 2**63 - 1) for _ in range(300)]
    narrow = [Decimal(rng.randint(-(10**18) + 1, 10**18 - 1)).scaleb(-2) for _ in ints]
    wide = [Decimal(rng.randint(-99, 99) if k % 2 else rng.randint(-(10**38) + 1, 10**38 - 1)).scaleb(-10) for k in range(len(ints))]
    df = spark.createDataFrame(list(zip(ints, narrow, wide)), "i long, n decimal(18,2), w decimal(38,10)").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    for how in ({}, {"read_rows": 10, "bits": 4}, {"read_rows": 0, "bits": 9}):
        found = percentiles.neighbours(df, {c: probs for c in "inw"}, **how)
        for c, values in zip("inw", (ints, narrow, wide)):
            values = sorted(values)
            at = [p * (len(values) - 1) for p in probs]
            assert found[c] == [(values[math.floor(x)], values[math.ceil(x)], x - math.floor(x)) for x in at]
    middle = spark.createDataFrame([(2**53 + 1,), (None,), (2**53 + 1,), (5,)], "i long")
    assert percentiles.percentile_values(middle, {"i": [0.5]}) == {"i": [2**53 + 1]}


def test_order_of_doubles(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 1 / 3]
    values += [v for v in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)) if not math.isnan(v)]
    values += [s * 2.0**k * (1 + e) for k in range(-1022, 1023, 31) for e in (0, 2**-52, -(2**-53)) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan]], "x double")
    rows = df.select("x", percentiles.order_words("x", df.schema["x"].dataType)[0].alias("k")).collect()
    assert [r.k for r in rows if math.isnan(r.x)] == [None]
    assert all(percentiles.value_of((r.k,), df.schema["x"].dataType) == r.x for r in rows if not math.isnan(r.x))
    known = sorted((r.x, r.k) for r in rows if not math.isnan(r.x))
    assert [k for _, k in known] == sorted(k for _, k in known)


def test_filled_median_keeps_its_digits(spark):
    df = spark.createDataFrame([(2**53 + 1, Decimal("0.10")), (None, None), (2**53 + 1, Decimal("0.30"))], "i long, d decimal(20,2)")
    rows = impute.handle_missing_values(df, {"i": "median", "d": "median"}).df.collect()
    assert {r.i for r in rows} == {2**53 + 1} and sorted(r.d for r in rows) == [Decimal("0.10"), Decimal("0.20"), Decimal("0.30")]


@pytest.mark.parametrize("candidates,most", [(1000, 50_000), (12, 50_000), (12, 10)])
def test_top_values_without_moving_texts(spark, monkeypatch, candidates, most):
    """Ties at the lowest count, unique texts, and tied values that come late in the order."""
    monkeypatch.setattr(stats, "CANDIDATES", candidates)
    monkeypatch.setattr(stats, "SMALLEST", 3)
    monkeypatch.setattr(stats, "MOST_SMALLEST", most)
    rng = random.Random(2)
    late = [f"a{k:03d}" for k in range(80)] * 2 + [f"z{k}" for k in range(30)] * 3 + ["m"] * 9
    rng.shuffle(late)
    n = len(late)
    rows = [(f"u{rng.random()}", late[i], rng.choice("xyz") if i % 3 else None, rng.randint(0, 40), None) for i in range(n)]
    df = spark.createDataFrame(rows, "unique string, late string, few string, num int, gone string").repartition(4)
    found = stats.top_counts(df, df.columns, 10, first=stats.SMALLEST)
    summaries = stats.value_summaries(df, df.columns, 10)
    for i, c in enumerate(df.columns):
        counts = Counter(str(r[i]) for r in rows if r[i] is not None)
        assert found.get(c, []) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:10]
        total = sum(counts.values())
        plain = round(-sum(v / total * math.log2(v / total) for v in counts.values()), 4) if total else None
        assert summaries[c].distinct == len(counts) and (summaries[c].entropy == pytest.approx(plain, abs=1e-4) if total else summaries[c].entropy is None)
    assert stats.top_counts(df.limit(0), ["late"], 3) == {} and stats.value_summaries(df, []) == {}
    plan = stats.hashed_counts(df, ["late"])._jdf.queryExecution().executedPlan().toString()
    assert "keys=[col_pos" in plan and "value" not in plan[: plan.index("Exchange")]


def test_a_profile_takes_few_jobs(spark):
    df = spark.createDataFrame([(i, f"k{i}", "ab"[i % 2], float(i)) for i in range(200)], "i long, k string, t string, x double")
    tracker, group = spark.sparkContext.statusTracker(), "profile-jobs"
    spark.sparkContext.setJobGroup(group, "profile")
    P.build_profile(df)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 24  # a shuffle map stage is a job of its own under adaptive execution


def test_percentiles_of_doubles_take_few_passes(spark, monkeypatch):
    """Any spread of doubles: a pass narrows by place, and by exponent where places are crowded."""
    import random

    rng, probs = random.Random(5), [0.0, 0.25, 0.5, 0.9, 1.0]
    sets = {
        "flat": [rng.uniform(-1e3, 1e3) for _ in range(300)], "steep": [rng.choice([-1, 1]) * 2.0 ** rng.uniform(-1070, 1023) for _ in range(300)],
        "tiny": [5e-324 * rng.randrange(10_000) for _ in range(300)], "wide": [float("-inf"), -1.7e308, 1.7e308, float("inf")] + [rng.random() for _ in range(296)],
        "near": [2.0 - 2.0**-52, 2.0, 2.0 + 2.0**-51] * 100}
    df = spark.createDataFrame(list(zip(*sets.values())), ", ".join(f"{c} double" for c in sets))
    opened = []
    monkeypatch.setattr(percentiles, "_opened", lambda r, last, own=percentiles._opened: opened.append(r) or own(r, last))
    found = percentiles.neighbours(df, {c: probs for c in sets}, read_rows=3)
    for c, values in sets.items():
        ranked = sorted(values)
        at = [p * (len(ranked) - 1) for p in probs]
        assert [x[:2] for x in found[c]] == [(ranked[math.floor(x)], ranked[math.ceil(x)]) for x in at], c
    assert len(opened) < 5 * 7 * 6
    plan = df.select(percentiles.order_words("flat", df.schema["flat"].dataType)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "LOG2" not in plan.upper() and len(plan) < 1000
