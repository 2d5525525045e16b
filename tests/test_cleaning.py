import datetime as dt
import random
import time
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkclean.functions.names import snake_case, unique_names
from sparkclean.functions.parsing import java_pattern, parse_with, try_long, try_num, try_ts
from sparkclean.operators import impute, merge, stats
from sparkclean.operators.dedup import deduplicate_dataset, drop_exact_duplicates
from sparkclean.operators.impute import fill_directional, handle_missing_values
from sparkclean.operators.merge import match_stats, merge_datasets
from sparkclean.operators.profile import build_profile
from sparkclean.operators.standardize import standardize_formats


def values(df, name):
    return [r[name] for r in df.collect()]


# --- imputation ---------------------------------------------------------------------------------

def test_employees_statistics(employees):
    result = handle_missing_values(employees, {"Age": "median", "Salary": "mean", "Name": "mode"})
    assert result.fill_values == {"Age": 29.0, "Salary": 51250.0, "Name": "Alice"}
    log = result.log
    assert (log.cells_modified, log.rows_before, log.rows_after, log.confidence) == (3, 5, 5, 0.95)
    assert result.df.where("Age IS NULL OR Salary IS NULL OR Name IS NULL").count() == 0


def test_thresholds(spark):
    df = spark.createDataFrame([(1, 1.0)] + [(i, None) for i in range(2, 6)], "id long, junk double")
    assert handle_missing_values(df, {}).columns_dropped == ["junk"]
    assert "4 of 5 cells are empty" in handle_missing_values(df, {}).log.warnings[0]
    assert handle_missing_values(df, {}, drop_threshold=0.8).columns_dropped == []
    assert handle_missing_values(df, {}, drop_threshold=1.5).columns_dropped == []
    assert handle_missing_values(df, {}, drop_threshold=0).columns_dropped == ["junk"]
    assert handle_missing_values(df.where("id < 0"), {}, drop_threshold=0).columns_dropped == []
    with pytest.raises(ValueError):
        handle_missing_values(df, {}, drop_threshold=-1)


def test_fill_forward_and_back(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, None), (3, 4.0)], "o long, val double")
    assert values(handle_missing_values(df, {"val": "ffill"}, order_by="o").df.orderBy("o"), "val") == [1, 1, 1, 4]
    late = spark.createDataFrame([(0, None), (1, None), (2, 3.0), (3, 4.0)], "o long, val double")
    assert values(handle_missing_values(late, {"val": "bfill"}, order_by="o").df.orderBy("o"), "val") == [3, 3, 3, 4]
    result = handle_missing_values(late, {"val": "ffill"}, order_by="o")
    report = impute.impute_report(result).first()
    assert (report["cells_targeted"], report["nulls_after"], report["cells_modified"]) == (2, 2, 0)
    with pytest.raises(ValueError, match="order_by"):
        handle_missing_values(late, {"val": "ffill"})


@pytest.mark.parametrize("seed,keys", [(1, 0), (2, 3), (3, 1)])
def test_ranges_equal_one_window(spark, monkeypatch, seed, keys):
    rng = random.Random(seed)
    rows, run = [], 0
    for i in range(400):
        run = run - 1 if run > 0 else (rng.randint(20, 60) if rng.random() < 0.05 else 0)
        value = None if run or rng.random() < 0.3 else float(i)
        rows.append((i, rng.choice([None, "a", "a", "b"]) if keys else "k", value, f"t{i}" if value else None))
    df = spark.createDataFrame(rows, "o long, k string, v double, t string").repartition(6)
    by = ["k"] if keys else []
    strategies = {"v": "ffill", "t": "bfill"}
    plain = impute.fill_directional(df, strategies, ["o"], by, max_group_rows=10**6)
    ranged = impute.fill_directional(df, strategies, ["o"], by, max_group_rows=0)
    monkeypatch.setattr(impute, "SCAN_WIDTH", 2)  # eight ranges on three levels
    levels = impute.fill_directional(df, strategies, ["o"], by, max_group_rows=0)
    assert ranged.columns == df.columns
    expected = {r["o"]: tuple(r) for r in plain.collect()}
    for found in (ranged, levels):
        assert {r["o"]: tuple(r) for r in found.collect()} == expected and found.count() == len(rows)
        assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_drop_row_is_a_barrier(spark):
    df = spark.createDataFrame([(1.0, 10.0), (None, 20.0), (3.0, None), (5.0, 60.0)], "a double, b double")
    result = handle_missing_values(df, {"a": "drop_row", "b": "mean"})
    assert sorted(values(result.df, "b")) == [10.0, 35.0, 60.0]
    assert (result.log.rows_before, result.log.rows_after, result.log.rows_removed) == (4, 3, 1)
    both = handle_missing_values(
        spark.createDataFrame([(1.0, None), (None, None), (3.0, 6.0)], "a double, b double"),
        {"a": "drop_row", "b": "drop_row"}, drop_threshold=1)
    assert [tuple(r) for r in both.df.collect()] == [(3.0, 6.0)] and both.log.rows_after == 1


def test_constants_types_and_warnings(spark, employees):
    result = handle_missing_values(
        employees, {"Name": "constant", "Age": "constant", "Nope": "mean", "Salary": "guess", "JoinDate": "mode"},
        {"Name": "Unknown"})
    assert "Unknown" in values(result.df, "Name")
    assert len(result.log.warnings) == 3 and result.columns_imputed == {"Name": "constant"}
    with pytest.raises(ValueError):
        handle_missing_values(employees, {"Name": "mean"})
    with pytest.raises(ValueError):
        handle_missing_values(employees, {"Age": "constant"}, {"Age": "U"})


def test_types_after_filling(spark):
    df = spark.createDataFrame([(1, 1, True, dt.datetime(2020, 1, 1)), (2, 3, None, None), (4, None, True, dt.datetime(2020, 1, 3)),
                                (None, 5, False, None)], "a long, b long, c boolean, d timestamp_ntz")
    result = handle_missing_values(df, {"a": "mean", "b": "mean", "c": "mode", "d": "mean"})
    assert dict(result.df.dtypes) == {"a": "double", "b": "bigint", "c": "boolean", "d": "timestamp_ntz"}
    assert result.log.column_lineage.type_changes == {"a": ("bigint", "double")}
    assert values(result.df, "b")[2] == 3 and values(result.df, "d")[1] == dt.datetime(2020, 1, 2)


def test_mode_ties_and_all_null(spark):
    df = spark.createDataFrame([(3.0, None), (1.0, None), (3.0, None), (1.0, None), (None, None)], "x double, y double")
    result = handle_missing_values(df, {"x": "mode", "y": "mode"}, drop_threshold=1)
    assert result.fill_values == {"x": 1.0, "y": None}
    assert result.df.where("y IS NULL").count() == 5


# --- standardization ----------------------------------------------------------------------------

@pytest.mark.parametrize("before,after", [
    ("First Name", "first_name"), ("Last-Name", "last_name"), ("AgeYears", "age_years"), ("HTTPCode", "httpcode"),
    ("  Sale $ Amount ", "sale_amount"), ("a__b--c", "a_b_c"), ("_x_", "x"), ("Größe", "größe"), ("$", ""), ("col2Name", "col2_name"),
])
def test_snake_case(before, after):
    assert snake_case(before) == after


def test_unique_names():
    assert unique_names(["a", "", "A", "a", "a_2"]) == ["a", "col_1", "A_2", "a_3", "a_2_2"]


def test_numbers_and_dates_as_text(spark):
    numbers = {"1": 1, " 2.5 ": 2.5, "1e3": 1000, "+5": 5, ".5": 0.5, "inf": float("inf"), "-Infinity": float("-inf"),
               "1d": None, "5f": None, "1,000": None, "1_000": None, "0x1A": None, "": None, "nan": None, "a": None}
    df = spark.createDataFrame([(k,) for k in numbers], "t string")
    assert dict(df.select("t", try_num(F.col("t"))).collect()) == numbers
    assert [r[0] for r in df.select(try_long(F.col("t"))).collect()][:4] == [1, None, None, 5]
    day = dt.datetime(2023, 1, 22)
    dates = {
        "2023-01-22": day, "2023-1-22": day, "01/22/2023": day, "22/01/2023": day, "2023/01/22": day, "Jan 22, 2023": day,
        "January 22 2023": day, "22 Jan 2023": day, "20230122": day, "2023-01-22 10:30": day.replace(hour=10, minute=30),
        "2023-01-22T10:30:05": day.replace(hour=10, minute=30, second=5), "May 3, 2020": dt.datetime(2020, 5, 3),
        "2023-01-22 10:30:05.25": day.replace(hour=10, minute=30, second=5, microsecond=250000),
        "2023-01-22T10:30:05Z": day.replace(hour=10, minute=30, second=5),
        "2023-01-22T10:30:05+02:00": day.replace(hour=8, minute=30, second=5),
        "01-22-2023": day, "1/22/2023 9:05": day.replace(hour=9, minute=5),
        "2023": None, "12:30": None, "now": None, "today": None, "2023-02-30": None, "5": None, "May": None, "West": None,
        "99/99/2023": None, "20231399": None,
    }
    df = spark.createDataFrame([(k,) for k in dates], "t string")
    assert dict(df.select("t", try_ts(F.col("t")).cast("timestamp_ntz")).collect()) == dates


def test_sales(sales):
    result = standardize_formats(sales)
    assert dict(result.df.dtypes) == {"customer_name": "string", "sale_amount": "double", "sale_date": "timestamp",
                                      "region": "string", "units_sold": "bigint"}
    assert values(result.df, "sale_amount") == [1200.5, 850.0, 1200.5, None, 3400.0, 920.75]
    assert result.format_report["Sale Amount"] == ["now named sale_amount"]
    assert result.format_report["sale_amount"] == ["5 amounts of money read as numbers"]
    assert result.log.cells_modified == 5 + 6 + 6 and result.log.confidence == 0.9
    assert result.log.column_lineage.columns_renamed["Units Sold"] == "units_sold"


def test_rules_can_be_switched_off(sales):
    result = standardize_formats(sales, normalize_headers=False, parse_dates=False, parse_currency=False, parse_numerics=False)
    assert result.df.schema == sales.schema and result.format_report == {} and result.log.cells_modified == 0


def test_override_and_share(spark):
    df = spark.createDataFrame([("22.01.2023", "1", "x"), ("oops", "2", "1"), (None, "3", "2"), ("01.02.2023", "4", "3")],
                               "When string, n string, mostly string")
    result = standardize_formats(df, column_overrides={"when": "%d.%m.%Y"})
    assert values(result.df.select(F.col("when").cast("string").alias("w")), "w") == [
        "2023-01-22 00:00:00", None, None, "2023-02-01 00:00:00"]
    assert result.format_report["when"] == ["2 cells read by the given format %d.%m.%Y"]
    assert dict(result.df.dtypes)["mostly"] == "string"  # 75% is not enough
    with pytest.raises(ValueError, match="directive"):
        standardize_formats(df, column_overrides={"when": "%Q"})
    assert java_pattern("%Y-%m-%dT%H:%M") == "yyyy-M-d'T'H:m"


def test_header_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Name` long, `name ` long, `$` long")
    result = standardize_formats(df)
    assert result.df.columns == ["name", "name_2", "col_2"]
    assert len(result.log.warnings) == 2 and "schema_conflict" in result.log.warnings[0]


# --- exact dedup and joins ----------------------------------------------------------------------

def test_exact_dedup(spark, employees):
    result = deduplicate_dataset(employees)
    assert result.df.count() == 4 == result.log.rows_after and result.exact_duplicates_removed == 1
    nulls = spark.createDataFrame([(None, 1)] * 3 + [(None, 2)], "a string, b long")
    assert deduplicate_dataset(nulls).df.count() == 2
    assert deduplicate_dataset(nulls, exact_dedup=False).df.count() == 4
    ordered = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "o long, t string")
    assert sorted(values(drop_exact_duplicates(ordered, "o", "last"), "o")) == [2, 3]
    assert sorted(values(drop_exact_duplicates(ordered, "o"), "o")) == [1, 3]
    with pytest.raises(ValueError):
        deduplicate_dataset(nulls, dedup_keep="middle")


@pytest.mark.parametrize("how,rows", [("left", 5), ("inner", 4), ("right", 4), ("outer", 5)])
def test_join_types(employees, departments, how, rows):
    result = merge_datasets(employees, departments, "Name", how)
    assert result.df.count() == rows == result.log.rows_after
    assert result.match_rate == 1.0 and result.left_duplicates == 1 and result.log.confidence == 1.0
    assert result.df.columns == ["Name", "Age", "Salary", "JoinDate", "Dept"] and result.columns_added == ["Dept"]


def test_no_match(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, val string")
    right = spark.createDataFrame([(10, "x"), (20, "y")], "id long, label string")
    result = merge_datasets(left, right, "id")
    assert (result.match_rate, result.left_unmatched, result.right_unmatched) == (0.0, 3, 2)
    assert result.log.confidence == 0.5 and "Few matches" in result.log.warnings[0]
    assert tuple(match_stats(left, right, "id").first()) == (0, 3, 2, 0.0)


def test_suffix_and_errors(spark):
    left = spark.createDataFrame([(1, 5, 6)], "k long, v long, v_right long")
    right = spark.createDataFrame([(1, 7)], "k long, V long")
    assert merge_datasets(left, right, "k").df.columns == ["k", "v", "v_right", "V_right2"]
    for key, how in (("nope", "left"), ("k", "cross")):
        with pytest.raises(ValueError):
            merge_datasets(left, right, key, how)
    with pytest.raises(ValueError, match="compared"):
        merge_datasets(left, right.withColumn("k", F.lit("1")), "k")


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
@pytest.mark.parametrize("hot_rows", [3, 20])
def test_hot_keys_equal_pandas_merge(spark, how, hot_rows):
    rng = random.Random(7)
    pick = [None, None, "hot", "hot", "hot", "left-only", "a", "b", "c"]
    left = pd.DataFrame({"k": [rng.choice(pick) for _ in range(80)], "x": range(80)})
    right = pd.DataFrame({"k": [rng.choice([None, "hot", "a", "d", "right-only"]) for _ in range(30)], "x": range(30)})
    expected = left.merge(right, on="k", how=how, suffixes=("", "_right"))
    found = merge_datasets(spark.createDataFrame(left.astype(object).where(left.notna(), None), "k string, x long"),
                           spark.createDataFrame(right.astype(object).where(right.notna(), None), "k string, x long"),
                           "k", how, hot_key_rows=hot_rows)

    def rows(frame):
        return sorted(tuple("~" if v is None or v != v else str(int(v) if not isinstance(v, str) else v) for v in r)
                      for r in frame)

    assert rows(map(tuple, found.df.collect())) == rows(expected.itertuples(index=False, name=None))
    assert found.log.rows_after == len(expected)


def test_dates_of_many_shapes(spark):
    want = {
        "2023-01-22T10:30:05.123456Z": "2023-01-22 10:30:05.123456", "2023-01-22T10:30:05+05:30": "2023-01-22 05:00:05",
        "01/22/2023 10:30 PM": "2023-01-22 22:30:00", "2023-01-22 12:00 AM": "2023-01-22 00:00:00", "22-Jan-2023": "2023-01-22 00:00:00",
        "01/22/23": "2023-01-22 00:00:00", "1/2/75": "1975-01-02 00:00:00", "2023-01-22 10:30:05.123456789": "2023-01-22 10:30:05.123456",
        "jan 5, 2023": "2023-01-05 00:00:00", "Sunday, January 22, 2023": "2023-01-22 00:00:00", "2023": None, "12:30": None, "Note one": None,
        "2023-02-30": None, "2023-01-22 24:10": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert dict(df.select("t", try_ts(F.col("t")).cast("string")).collect()) == want


def test_loose_overrides(spark):
    cases = [("1/5/2023", "%m/%d/%Y", "2023-01-05"), ("01/05/75", "%m/%d/%y", "1975-01-05"), ("1/5/99", "%d/%m/%y", "1999-05-01"),
             ("Sunday, January 22, 2023", "%A, %B %d, %Y", "2023-01-22"), ("xx 22.01.2023", "%a %d.%m.%Y", None), ("20230105", "%Y%m%d", "2023-01-05")]
    for text, fmt, day in cases:
        assert spark.createDataFrame([(text,)], "t string").select(parse_with(F.col("t"), fmt).cast("date").cast("string")).first()[0] == day


def test_mean_time_outside_utc(spark, monkeypatch):
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        df = spark.sql("SELECT * FROM VALUES (timestamp'2020-01-01', timestamp_ntz'2020-01-01'), (timestamp'2020-01-03', timestamp_ntz'2020-01-03'), (NULL, NULL) t(a, b)")
        out = handle_missing_values(df, {"a": "mean", "b": "mean"}, drop_threshold=1.0).df
        assert {tuple(r) for r in out.select(F.col("a").cast("string"), F.col("b").cast("string")).collect()} == {
            (f"2020-01-0{k} 00:00:00",) * 2 for k in (1, 2, 3)}
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()


def test_ties_fill_alike_in_windows_and_ranges(spark):
    df = spark.range(400).selectExpr("id", "id DIV 40 AS tied", "IF(pmod(hash(id), 3) = 0, NULL, id) AS value")
    one, many = (fill_directional(df, {"value": "ffill"}, ["tied"], [], max_group_rows=n) for n in (10_000, 0))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_map_columns_and_helper_names(spark):
    df = spark.sql("SELECT * FROM VALUES (map('a', 1), '5', '2020-01-01'), (map('a', 1), '5', '2020-01-01') t(m, _number0, _parsed0)")
    assert drop_exact_duplicates(df).count() == 1
    assert standardize_formats(df.drop("m"), normalize_headers=False).df.count() == 2 and len(build_profile(df.drop("m")).columns) == 2


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_salted_hot_keys(spark, how):
    left = spark.range(300).selectExpr("IF(id < 200, 1, id) AS k", "id AS a")
    right = spark.range(60).selectExpr("CASE WHEN id < 5 THEN 1 WHEN id < 50 THEN 7 ELSE id + 200 END AS k", "id AS b", "'x' AS _merge1")
    plain = left.join(right, "k", "full" if how == "outer" else how).select("k", "a", "b", "_merge1").collect()
    found = merge_datasets(left, right, "k", how, hot_key_rows=10).df.select("k", "a", "b", "_merge1").collect()
    assert sorted(map(str, found)) == sorted(map(str, plain))


def test_a_salted_join_reads_each_side_once(spark, tmp_path, monkeypatch):
    spark.range(200).selectExpr("IF(id < 150, 1, id) AS k", "'same' AS a").write.parquet(f"{tmp_path}/l")  # equal rows leave chunks empty
    spark.range(40).selectExpr("IF(id < 30, 1, id) AS k", "id AS b").write.parquet(f"{tmp_path}/r")
    left, right = spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")
    for how in ("left", "right", "inner", "outer"):
        found = merge_datasets(left, right, "k", how, hot_key_rows=10).df
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
        plain = left.join(right, "k", "full" if how == "outer" else how).select("k", "a", "b")
        assert sorted(map(str, found.select("k", "a", "b").collect())) == sorted(map(str, plain.collect()))
    monkeypatch.setattr(merge, "HOT_KEY_BYTES", 16 * 40)
    monkeypatch.setattr(merge, "MAX_HOT_KEYS", 1)
    assert merge_datasets(left, right, "k", "outer", hot_key_rows=10).df.count() == left.join(right, "k", "full").count()


def test_null_patterns_tell_what_drops_leave(spark, monkeypatch):
    rng = random.Random(6)
    data = [tuple(None if rng.random() < 0.3 else rng.randint(0, 2) for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame(data, "a int, b int, c int, d int").repartition(3)
    masks = stats.null_masks(df)
    for dropped in ([], ["b"], ["d", "a"], ["a", "b", "c", "d"]):
        left = [r for r in data if all(r["abcd".index(c)] is not None for c in dropped)]
        assert stats.left_after(masks, df.columns, dropped) == (len(left), {c: sum(r[i] is None for r in left) for i, c in enumerate("abcd")})
    assert stats.null_masks(df, most=3) is None
    chain = {"a": "drop_row", "b": "mode", "c": "drop_row", "d": "median"}
    many = handle_missing_values(df, chain)
    monkeypatch.setattr(stats, "null_masks", lambda df: None)  # as with too many patterns
    counted = handle_missing_values(df, chain)
    assert sorted(map(tuple, many.df.collect())) == sorted(map(tuple, counted.df.collect()))
    assert (many.cells_targeted, many.log.rows_after, many.fill_values) == (counted.cells_targeted, counted.log.rows_after, counted.fill_values)


def test_modes_of_all_types_in_one_go(spark):
    df = spark.sql("""SELECT * FROM VALUES (1L, 'b', 0.0D, date'2020-01-01', true, 1.50BD, NULL, array(1)), (1L, 'a', -0.0D, date'2019-01-01', NULL, 1.50BD, NULL, array(1)),
                      (2L, 'b', 7.0D, NULL, true, 2.00BD, NULL, NULL), (NULL, 'a', 7.0D, NULL, false, NULL, NULL, NULL) AS t(i, s, x, d, f, m, n, l)""")
    found = stats.modes(df, df.columns)
    assert found == {"i": 1, "s": "a", "x": 0.0, "d": dt.date(2019, 1, 1), "f": True, "m": Decimal("1.50"), "n": None, "l": [1]}
    assert stats.modes(df, []) == {} and stats.modes(df.limit(0), ["i"]) == {"i": None}


def test_only_repeated_rows_are_grouped(spark):
    rng = random.Random(9)
    data = [(rng.choice([None, 1, 2]), rng.choice(["x", None]), {"k": rng.randint(0, 1)}) for _ in range(60)] + [(100 + k, "u", {}) for k in range(30)]
    df = spark.createDataFrame(data, "a int, b string, m map<string,int>").repartition(4)
    assert stats.duplicate_rows(df) == (90, 90 - len({(a, b, str(m)) for a, b, m in data}))
    assert stats.duplicate_rows(df.where("a >= 100")) == (30, 0) and stats.duplicate_rows(df.limit(0)) == (0, 0)


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_pairs_of_equal_rows_meet_in_bounded_cells(spark, how, monkeypatch):
    """Neither side is large, but their pairs are; equal rows must not fall into one cell."""
    monkeypatch.setattr(merge, "HOT_KEY_PAIRS", 1000)
    monkeypatch.setattr(merge, "CELL_PAIRS", 400)
    left = spark.range(203).selectExpr("if(id < 200, null, id) AS k", "'same' AS a")
    right = spark.range(103).selectExpr("if(id < 100, null, id + 101) AS k", "'same' AS b")
    done = merge_datasets(left, right, "k", how)
    wanted = left.join(right.withColumnRenamed("k", "o"), F.col("k").eqNullSafe(F.col("o")), how).select(F.coalesce("k", "o").alias("k"), "a", "b")
    assert sorted(map(str, done.df.collect())) == sorted(map(str, wanted.collect()))
    assert "_mergesalt" in done.df._jdf.queryExecution().optimizedPlan().toString()
    for sizes in ((200, 100), (1, 5000), (5000, 1), (30, 30), (10**6, 20)):
        across, down = merge._chunks(*sizes, 10**9)
        assert sizes[0] * sizes[1] <= 1000 or -(-sizes[0] // across) * -(-sizes[1] // down) <= 400
