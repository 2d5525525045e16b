import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sparkclean.audit import StepLog, StepResult, audit_log, schema_digest, table_checksum
from sparkclean.operators.impute import handle_missing_values
from sparkclean.operators.merge import merge_datasets
from sparkclean.plans.cleaning import CleaningPlan, Step
from sparkclean.sources.csv_records import inside_after, records
from sparkclean.sources.files import load_dataset, read_csv, schema_summary, spans_lines, with_row_order
from sparkclean.sources.report import generate_output, quality_report_markdown
from sparkclean.sources.snapshots import Snapshots, artifact_key, write_csv


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_tokens(spark, tmp_path):
    path = write(tmp_path / "t.csv", 'id,price,flag,day,note,gone\n1,2.5,True,2020-01-01,"a, ""b""",NA\n'
                                     '2,NA,False,2020-01-02,null,\n3,7,True,2020-01-03,c,N/A\n')
    result = load_dataset(spark, path)
    assert result.df.dtypes == [("id", "bigint"), ("price", "double"), ("flag", "boolean"), ("day", "string"),
                                ("note", "string"), ("gone", "double")]
    rows = result.df.collect()
    assert rows[0]["note"] == 'a, "b"' and rows[1]["note"] is None and rows[1]["price"] is None
    assert result.log.cols_after == 6 and result.log.column_lineage.columns_added == result.df.columns


def test_line_breaks_in_cells(spark, tmp_path):
    broken = write(tmp_path / "broken.csv", 'id,text\n1,"two\nlines"\n2,x\n')
    plain = write(tmp_path / "plain.csv", 'id,text\n1,"one ""quoted"" line"\n2,x\n')
    assert spans_lines(spark, broken) and not spans_lines(spark, plain)
    assert [r["text"] for r in read_csv(spark, broken).collect()] == ["two\nlines", "x"]
    assert [r["text"] for r in read_csv(spark, plain).collect()] == ['one "quoted" line', "x"]


def test_empty_csv_and_round_trip(spark, tmp_path, employees):
    header_only = load_dataset(spark, write(tmp_path / "empty.csv", "Name,Age,Salary\n")).df
    assert header_only.dtypes == [("Name", "string"), ("Age", "string"), ("Salary", "string")] and header_only.count() == 0
    write_csv(employees, str(tmp_path / "out"), single_file=True)
    back = load_dataset(spark, str(tmp_path / "out"), format="csv").df
    assert back.schema.names == employees.schema.names and sorted(map(str, back.collect())) == sorted(map(str, employees.collect()))
    write_csv(employees.where(F.lit(False)), str(tmp_path / "none"))
    assert load_dataset(spark, str(tmp_path / "none"), format="csv").df.columns == employees.columns


def test_load_errors_and_secondary(spark, tmp_path, departments):
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError, match="neither CSV"):
        load_dataset(spark, write(tmp_path / "x.json", "{}"))
    path = str(tmp_path / "d.parquet")
    departments.write.parquet(path)
    with pytest.raises(ValueError, match="secondary_name"):
        load_dataset(spark, path, is_secondary=True)
    load_dataset(spark, path, is_secondary=True, secondary_name="departments")
    assert spark.table("departments").count() == 3
    people = spark.createDataFrame([("Alice", 1), ("Zoe", 2)], "Name string, id long")
    merged = merge_datasets(people, "departments", "Name")
    assert merged.df.count() == 2 and merged.log.detail["secondary_name"] == "departments"
    with pytest.raises(ValueError, match="registered"):
        merge_datasets(people, "no_such_table", "Name")


def test_schema_summary_and_row_order(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, None, None), (3, "c", None)], "o long, t string, n double")
    rows = {r["name"]: r["sample"] for r in schema_summary(df, order_by="o").collect()}
    assert rows == {"o": "1", "t": "b", "n": ""}
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    ordered = with_row_order(spark.read.parquet(str(tmp_path / "p")))
    assert [r["o"] for r in ordered.orderBy("row_order").collect()] == [2, 1, 3]


def test_checksum(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (2, 3)], "a long, b long")
    one = table_checksum(df).first()
    assert one == table_checksum(df.repartition(3).orderBy("b")).first()
    swapped = table_checksum(df.select(F.col("b").alias("a"), F.col("a").alias("b"))).first()
    assert one["row_count"] == 4 and swapped != one
    assert table_checksum(df.where(F.lit(False))).first()["hash_sum"] == 0


def test_schema_digest(spark):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    assert schema_digest(df) == schema_digest(df.select("b", "a")) != schema_digest(df.select("a"))


def test_snapshots(spark, tmp_path, employees):
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.versions().count() == 0 and store.next_version("load_dataset") == 1
    path = str(tmp_path / "e.parquet")
    employees.write.parquet(path)
    loaded = load_dataset(spark, path)
    first = store.write(loaded)
    assert first == "load_dataset/v1/dataset" and loaded.log.rows_after == 5
    step = handle_missing_values(store.read(first), {"Age": "drop_row"})
    second = store.write(step, first)
    again = store.write(handle_missing_values(store.read(first), {"Age": "mean"}), first)
    assert (second, again) == ("handle_missing_values/v1/dataset", "handle_missing_values/v2/dataset")
    assert step.log.checksum_before == loaded.log.checksum_after != step.log.checksum_after
    latest = {r["step_name"]: r for r in store.latest().collect()}
    assert latest["handle_missing_values"]["version"] == 2 and latest["handle_missing_values"]["row_count"] == 5
    assert store.all_keys().count() == 3
    assert {r["input_step"] for r in store.parents().collect()} == {None, "load_dataset"}
    with pytest.raises(FileNotFoundError):
        store.read("nope/v1/dataset")
    with pytest.raises(ValueError):
        artifact_key("x", 1, "picture")
    log = audit_log(spark, store.logs).collect()
    assert [r["step_name"] for r in log] == ["load_dataset", "handle_missing_values", "handle_missing_values"]
    assert log[1]["rows_removed"] == 1 and json.loads(log[1]["operation_detail"])["drop_threshold"] == 0.5


STEPS = [
    Step("standardize_formats"),
    Step("handle_missing_values", {"strategy_config": {"sale_amount": "median", "region": "mode"}}),
    Step("deduplicate_dataset"),
    Step("validate_dataset"),
]


@pytest.mark.parametrize("stored", [True, False])
def test_plan_end_to_end(spark, tmp_path, sales, stored):
    store = Snapshots(spark, str(tmp_path / "store")) if stored else None
    done = CleaningPlan(STEPS).run(sales, store)
    assert done.error is None and done.df.count() == 5 and len(done.logs) == 4
    assert sorted(r["sale_amount"] for r in done.df.collect()) == [850.0, 920.75, 1200.5, 1200.5, 3400.0]
    assert done.results[1].fill_values == {"sale_amount": 1200.5, "region": "West"}
    assert done.results[3].quality_score == 100.0
    if stored:
        out = generate_output(done.df, store)
        keys = {r["artifact_key"] for r in store.all_keys().collect()}
        assert {"validate_dataset/v1/report", "generate_output/v1/dataset"} <= keys
        logs = spark.read.json(store.path(out.log_key)).collect()
        assert [r["step_name"] for r in logs] == [s.name for s in STEPS]  # without the export itself
        text = "\n".join(r["value"] for r in spark.read.text(store.path(out.report_key)).collect())
        assert "## Result" in text and "## Empty cells" in text and "| 4 | " in text
        assert load_dataset(spark, store.path(out.csv_key), format="csv").df.count() == 5
        with pytest.raises(ValueError):
            generate_output(done.df, store, output_format="xlsx")


def test_plan_stops_at_the_first_failure(sales):
    done = CleaningPlan([Step("standardize_formats"), Step("handle_missing_values", {"strategy_config": {"region": "mean"}}),
                         Step("deduplicate_dataset")]).run(sales)
    assert done.failed_step == 1 and isinstance(done.error, ValueError) and len(done.logs) == 1
    with pytest.raises(ValueError, match="unknown step"):
        Step("train_model")


def test_report_text(employees):
    text = quality_report_markdown(employees, [], include_summary_stats=False)
    assert "| Name | 1 | 20 |" in text and "## Columns" not in text
    assert "## Columns" in quality_report_markdown(employees, [])


def test_row_wise_work_on_a_stream(spark, tmp_path, sales):
    """Renaming and currency parsing are plain projections, so they hold for a stream as well."""
    from sparkclean.functions.parsing import currency_to_num
    from sparkclean.operators.standardize import rename_headers
    sales.write.json(str(tmp_path / "in"))
    stream = rename_headers(spark.readStream.schema(sales.schema).json(str(tmp_path / "in")))[0]
    query = (stream.withColumn("sale_amount", currency_to_num(F.col("sale_amount"))).writeStream.format("memory")
             .queryName("cleaned").trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert spark.table("cleaned").agg(F.sum("sale_amount")).first()[0] == 7571.75


def test_a_crashed_write_leaves_the_step_usable(spark, tmp_path, employees):
    store = Snapshots(spark, str(tmp_path / "store"))
    employees.limit(1).write.parquet(store.path("load_dataset/v1/dataset"))  # written, never registered
    key = store.write(StepResult(employees, StepLog("load_dataset", 4, 4, 1.0)))
    assert key == "load_dataset/v1/dataset" and store.read(key).count() == employees.count()


def test_all_steps_of_a_plan(spark, tmp_path, sales):
    sales.write.parquet(str(tmp_path / "raw"))
    store = Snapshots(spark, str(tmp_path / "store"))
    steps = [Step("load_dataset", {"path": str(tmp_path / "raw"), "format": "parquet"}), Step("standardize_formats"), Step("deduplicate_dataset"),
             Step("profile_dataset"), Step("validate_dataset"), Step("generate_output")]
    done = CleaningPlan(steps).run(None, store)
    assert done.error is None and [x.step_name for x in done.logs] == [s.name for s in steps]
    assert done.results[4].profile is done.results[3].profile  # made once
    assert done.df.count() == 5 and spark.read.option("header", True).csv(store.path(done.results[-1].csv_key)).count() == 5
    assert CleaningPlan([Step("generate_output")]).run(sales).failed_step == 0


def test_writers_at_the_same_time_all_get_a_version(spark, tmp_path, employees):
    def write(k):
        store = Snapshots(spark, str(tmp_path / "store"))
        return store.write(StepResult(employees.where(F.lit(k) >= 0), StepLog("load_dataset", 4, 4, 1.0)))

    with ThreadPoolExecutor(4) as pool:
        keys = list(pool.map(write, range(4)))
    assert sorted(keys) == [f"load_dataset/v{k}/dataset" for k in (1, 2, 3, 4)]
    store = Snapshots(spark, str(tmp_path / "store"))
    assert store.versions().count() == 4 and all(store.read(k).count() == 5 for k in keys)
    assert store.claim("load_dataset") == 5 and store.claim("load_dataset") == 6  # a dead writer's number stays unused
    assert store.write(StepResult(employees, StepLog("load_dataset", 4, 4, 1.0))) == "load_dataset/v7/dataset"


def test_a_plan_goes_on_where_it_stopped(spark, tmp_path, sales, monkeypatch):
    from sparkclean.plans import cleaning
    sales.write.parquet(str(tmp_path / "raw"))
    store = Snapshots(spark, str(tmp_path / "store"))
    load = Step("load_dataset", {"path": str(tmp_path / "raw"), "format": "parquet"})
    fill = Step("handle_missing_values", {"strategy_config": {"sale_amount": "median"}})
    plan = CleaningPlan([load, Step("standardize_formats"), fill, Step("deduplicate_dataset"), Step("validate_dataset")])
    whole, calls = dict(cleaning.STEPS), []

    def counted(name):
        def run(*args, **kwargs):
            calls.append(name)
            if name == "deduplicate_dataset" and len(calls) == 4:
                raise RuntimeError("lost")
            return whole[name](*args, **kwargs)
        return run

    monkeypatch.setattr(cleaning, "STEPS", {name: counted(name) for name in whole})
    first = plan.run(None, store, resume=True)
    assert first.failed_step == 3 and first.reused == []
    second = plan.run(None, store, resume=True)
    assert second.error is None and second.reused == [0, 1, 2] and calls[4:] == ["deduplicate_dataset", "validate_dataset"]
    third = plan.run(None, store, resume=True)
    assert third.reused == [0, 1, 2, 3, 4] and len(calls) == 6 and [r.step_name for r in third.logs] == [s.name for s in plan.steps]
    assert sorted(map(tuple, third.df.collect())) == sorted(map(tuple, second.df.collect()))
    other = CleaningPlan([load, Step("standardize_formats"), Step("handle_missing_values", {"strategy_config": {"sale_amount": "mean"}})])
    assert other.run(None, store, resume=True).reused == [0, 1]  # other arguments
    sales.limit(3).write.mode("append").parquet(str(tmp_path / "raw"))
    assert plan.run(None, store, resume=True).reused == []  # another input
    with pytest.raises(ValueError, match="resume"):
        plan.run(None, None, resume=True)


def random_csv(rng, rows):
    """Cells with commas, quotes, line breaks and empty lines inside quotes, and stray quotes inside unquoted cells."""
    def cell():
        kind = rng.random()
        if kind < 0.3:
            return '"' + "".join(rng.choice(["a", ",", '""', "\n", "b c", "\r\n", "\n\n"]) for _ in range(rng.randint(0, 6))) + '"'
        return rng.choice(["x", "", "5 in", 'it"s', "12", "NA", "long text " * rng.randint(1, 5)])

    return "id,a,b\n" + "".join(f"{i},{cell()},{cell()}\n" + "\n" * (rng.random() < 0.05) for i in range(rows))


@pytest.mark.parametrize("seed", range(3))
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, seed):
    rng = random.Random(seed)
    (tmp_path / "t").mkdir()
    for k in range(2):
        write(tmp_path / "t" / f"{k}.csv", random_csv(rng, 300) if k else random_csv(rng, 40) + '99,"' + "one long cell\n" * 400 + '",end')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        found = read_csv(spark, str(tmp_path / "t"))
        assert records(spark, str(tmp_path / "t")).rdd.getNumPartitions() > 8
        rows = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = read_csv(spark, str(tmp_path / "t"), multiline=True)
    assert found.dtypes == whole.dtypes and rows == sorted(map(tuple, whole.collect()), key=str) and len(rows) == 341


def test_lines_that_end_with_a_carriage_return(spark, tmp_path):
    text = random_csv(random.Random(7), 60).replace("\r\n", "\n").replace("\n", "\r\n")
    (tmp_path / "t.csv").write_bytes(text.encode())
    found, whole = (read_csv(spark, str(tmp_path / "t.csv"), multiline=m) for m in (None, True))
    assert found.dtypes == whole.dtypes and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_state_behind_a_line():
    for line, outside, inside in (("a,b", False, True), ('a,"b', True, False), ('"a,b"', False, True), ('a"b,c', False, False), ('""', False, True),
                                  ('"a""', True, True), ('x","y', False, True), ('"a"b"c,"d', True, False), ("", False, True)):
        assert (inside_after(line, False), inside_after(line, True)) == (outside, inside), line


def test_rows_in_another_order_come_in_parts_of_bounded_size(spark):
    from workload.files import _shuffled

    df = spark.range(200_000).selectExpr("id % 3 AS k", "id AS v")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        moved = _shuffled(df, "k")
        assert moved.rdd.getNumPartitions() > 7
        assert table_checksum(moved).first() == table_checksum(df).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
