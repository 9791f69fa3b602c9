"""Readers, writers, parsing, experiments, runner, streams."""

import csv
import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from depscope.functions import parsing
from depscope.plans import experiments, runner
from depscope.plans.score import score
from depscope.sources import readers, sinks
from depscope.spec import FDSpec
from depscope.streaming import counts as streams


def test_ragged_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,,3\n4,5\n7,8,9,10\n"x, y",z\n')
    rows = [tuple(r) for r in readers.read_csv_text(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [("1", "", "3"), ("4", "5", None), ("7", "8", "9"), ("x, y", "z", None)]


def test_csv_with_quoted_newlines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n"x\ny",1,"say ""hi"", you"\n"p\n,q",2\n3,,\n')
    rows = [tuple(r) for r in readers.read_csv_text(spark, str(tmp_path / "t.csv")).collect()]
    assert rows == [("x\ny", "1", 'say "hi", you'), ("p\n,q", "2", None), ("3", "", "")]


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,f,b,s,m\n1,1,true,x,NA\n2,2.5,False,7,\n,nan,true,z,3\n")
    df = readers.read_csv_typed(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "m": "bigint"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.0, True, "x", None), (2, 2.5, False, "7", None), (None, None, True, "z", 3)]


def test_unsigned_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("p, ,q\n1,2,3\n\n4,x\n 7 ,8,9\n")
    df = readers.read_uint_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["p", "col1", "q"] and sorted(tuple(r) for r in df.collect()) == [(1, 2, 3), (4, 0, 0), (7, 8, 9)]


def test_dependency_file(spark, tmp_path):
    (tmp_path / "x.fds").write_text('# comment\n\n(["city", "street"], "zip")\n(["zip"], "city")\nnot a dependency\n')
    assert readers.read_fds(spark, str(tmp_path / "x.fds")) == [FDSpec(("city", "street"), "zip"), FDSpec(("zip",), "city")]
    assert FDSpec.parse("a | b", "c").lhs == ("a", "b")
    assert spark.range(1).select(readers.split_lhs(F.lit("a|b"))).first()[0] == ["a", "b"]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "case1").mkdir()
    (tmp_path / "case1" / "ground_truth.csv").write_text('left_col,right_col,sample_type,violation_rows\na,b,N,"[3, 17]"\nb,a,P,[]\n')
    got = readers.read_ground_truth(spark, str(tmp_path)).orderBy("left_col").collect()
    assert [tuple(r) for r in got] == [("case1", "a", "b", "N", [3, 17]), ("case1", "b", "a", "P", [])]


def test_value_parsing(spark):
    texts = ["50ms", " 2 M ", "1.5h", "0s", "12", "7GB", "1kb", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.duration_seconds(F.col("t")).alias("d"), parsing.memory_bytes(F.col("t")).alias("m")).collect()
    assert [(r["d"], r["m"]) for r in rows] == [(0.05, None), (120.0, None), (5400.0, None), (None, None), (None, None), (None, 7 * 1024**3), (None, 1024), (None, None)]
    kinds = spark.createDataFrame([(t,) for t in ["True", "-3", "1e5", "nan", "1.", "abc", ""]], "t string").select(parsing.value_kind(F.col("t"))).collect()
    assert [r[0] for r in kinds] == ["bool", "int", "float", "float", "float", "string", "string"]
    assert spark.range(1).select(parsing.row_list(F.lit("[3, 17]")), parsing.row_list(F.lit("")), parsing.slug(F.lit(" A b--C! "))).first()[:] == ([3, 17], [], "a-b-c")
    lists = spark.createDataFrame([("3,17",), (None,)], "v string")
    assert sorted(r[0] for r in readers.violation_rows(lists, "v").collect()) == [3, 17]


def test_metric_log(spark):
    lines = spark.createDataFrame([(0, "Metric::A=1"), (1, "noise"), (2, " Metric::A=2.5 "), (3, "Metric::B_x=true"), (4, "Metric::9=1")], "n long, value string")
    got = readers.metric_lines(lines, F.lit("r"), F.col("n")).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("r", "A", "2.5", "float"), ("r", "B_x", "true", "bool")]


def test_result_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "x string, y string")
    scored = score(df, FDSpec(("x",), "y"), ["g1", "mu_plus"])
    assert "Metric::G1=1.0" in [r["value"] for r in sinks.metric_rows(scored).collect()]
    assert json.loads(sinks.json_rows(scored).first()[0].removeprefix("RESULT_JSON: "))["g1"] == 1
    sinks.write_metric_lines(scored, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 6
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_csv(df.limit(0), str(tmp_path / "c"), mode="ignore")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_results_are_flattened(spark, tmp_path):
    for i, extra in enumerate(({"tags": {"t": "1"}, "metrics": {"g1": "1", "status": "x"}, "args": {"a": [1]}}, {"tags": {"u": "2"}, "metrics": {}, "args": {"b": 2}})):
        (tmp_path / "runs" / f"r{i}").mkdir(parents=True)
        (tmp_path / "runs" / f"r{i}" / "result.json").write_text(json.dumps({"run_id": f"r{i}", "status": "SUCCESS", "command": ["x", "y"], **extra}, indent=1))
    (tmp_path / "runs" / "bad").mkdir()
    (tmp_path / "runs" / "bad" / "result.json").write_text("{")
    flat = sinks.flat_results(readers.read_results(spark, str(tmp_path)).filter("run_id is not null"))
    assert flat.columns == [*sinks.CORE_COLUMNS, "arg_a", "arg_b", "g1", "metric_status", "tag_t", "tag_u"]
    rows = {r["run_id"]: r for r in flat.collect()}
    assert rows["r0"]["tag_t"] == "1" and rows["r0"]["tag_u"] is None and rows["r0"]["arg_a"] == "[1]" and rows["r1"]["arg_b"] == "2" and rows["r0"]["command"] == "x y"


def test_experiments(tmp_path):
    fd = FDSpec(("a", "b"), "c")
    listed = experiments.enumerate_experiments([("t.parquet", fd, {"case": 1})])
    assert len(listed) == 7 and listed[0].tags == {"case": 1, "implementation": "fused"}
    runs = experiments.expand_runs(listed, 3, "2m")
    assert len({r.run_id for r in runs}) == 21 and runs[0].timeout == 120 and runs == experiments.expand_runs(listed, 3, 120)
    for wrong in ({"repetitions": 0}, {"timeout": "soon"}, {"timeout": 0}):
        with pytest.raises(experiments.ConfigError):
            experiments.expand_runs(listed, **wrong)
    with pytest.raises(experiments.ConfigError):
        experiments.expand_runs([*listed, listed[0]])
    path = str(tmp_path / "e.yaml")
    experiments.write_experiments(path, listed, repetitions=2)
    again, settings = experiments.load_experiments(path)
    assert again == listed and settings == {"repetitions": 2}
    own = experiments.Experiment("own", "t", fd, ("g1",), {}, "clean", "0,2", 4, "90s", "512MB", {"spark.sql.shuffle.partitions": "3"}, {"k": 1})
    experiments.write_experiments(path, [own, listed[0]], memory_limit="1GB", environment={"a.b": 2})
    (first, second), settings = experiments.load_experiments(path)
    assert first.environment == {"a.b": "2", "spark.sql.shuffle.partitions": "3"} and second.environment == {"a.b": "2"}
    runs = experiments.expand_runs([first, second], 1, "1h", settings["memory_limit"])
    assert [(r.timeout, r.memory_limit) for r in runs] == [(90, 512 << 20)] * 4 + [(3600, 1 << 30)]
    for wrong in ({"repetitions": 0}, {"timeout": "-3s"}, {"memory_limit": "5 bananas"}, {"memory_limit": "12"}, {"mode": "x"}):
        with pytest.raises(experiments.ConfigError):
            experiments.expand_runs([dataclasses.replace(own, **wrong)])


def test_runner(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", "p"), ("a", "2", "p"), ("b", "2", "q")], "x string, y string, z string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    path = str(tmp_path / "e.yaml")
    listed = [experiments.Experiment("one", "t.parquet", FDSpec(("x",), "y"), ("g1", "reliability")), experiments.Experiment("two", "t.parquet", FDSpec(("q",), "y"), ("g1",))]
    experiments.write_experiments(path, listed, working_directory=str(tmp_path), results_directory=str(tmp_path / "out"))
    assert runner.main([path, "--dry-run"]) == 0 and runner.main([path, "--experiment", "three"]) == 2 and runner.main([str(tmp_path / "none.yaml")]) == 2
    assert runner.main([path]) == 0
    got = {r["experiment"]: r for r in readers.read_results(spark, str(tmp_path / "out")).collect()}
    assert got["one"]["status"] == "SUCCESS" and float(got["one"]["metrics"]["g1"]) == pytest.approx(1 - 2 / 9)
    assert got["two"]["status"] == "FAILED" and "no column" in got["two"]["error"]
    assert runner.run_all(spark, experiments.expand_runs(listed), str(tmp_path / "out"), lambda p: df) == []
    with open(tmp_path / "out" / "results.csv", newline="") as f:
        table = {r["experiment"]: r for r in csv.DictReader(f)}
    assert table["one"]["status"] == "SUCCESS" and float(table["one"]["g1"]) == pytest.approx(1 - 2 / 9) and table["two"]["exit_code"] == "1" and float(table["one"]["peak_memory_mb"]) > 0
    given = experiments.Experiment("given", "t", FDSpec(("x",), "y"), ("reliability",), mode="clean", violations="1", environment={"spark.sql.shuffle.partitions": "3"})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    (run,) = experiments.expand_runs([given])
    got = runner.execute(spark, run, lambda p: df.coalesce(1))
    assert got["status"] == "SUCCESS" and got["metrics"]["ar_violation_count"] == "1" and spark.conf.get("spark.sql.shuffle.partitions") == before
    sleepy = lambda _: df.withColumn("y", F.expr("reflect('java.lang.Thread', 'sleep', 8000L)"))
    plain = experiments.Experiment("slow", "t", FDSpec(("x",), "y"), ("g1",))
    assert runner.execute(spark, experiments.Run("slow", plain, 1, 0.2), sleepy)["status"] == "TIMEOUT"
    assert runner.execute(spark, experiments.Run("large", plain, 1, 60, 1), lambda _: df)["status"] == "MEMORY_LIMIT"

    def interrupted(_):
        raise KeyboardInterrupt

    runs = experiments.expand_runs([plain, dataclasses.replace(plain, name="next")])
    assert [r["status"] for r in runner.run_all(spark, runs, str(tmp_path / "out"), interrupted)] == ["INTERRUPTED"]
    assert [r["status"] for r in runner.run_all(spark, runs, str(tmp_path / "out"), lambda _: df)] == ["SUCCESS"] * 2


def test_stream_scores(spark, tmp_path):
    rows = [("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("b", "2"), ("c", "3")]
    for i in range(2):
        spark.createDataFrame(rows[i::2], "x string, y string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string, y string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = streams.score_stream(stream, [FDSpec(("x",), "y")], lambda df, _: seen.append(df.first()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen[-1]["n"] == 6 and seen[-1]["mu_plus"] == pytest.approx(0.393939394) and len(seen) == 2


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:10", "a", "1"), ("2024-01-01 00:00:20", "a", "1"), ("2024-01-01 01:00:00", "a", "2")], "t string, x string, y string").selectExpr("cast(t as timestamp) t", "x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, x string, y string").parquet(str(tmp_path / "in"))
    out = streams.windowed_counts(stream, [FDSpec(("x",), "y")], "t", "10 minutes", "5 minutes")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["c"] for r in spark.table("windows").collect()) == [1, 2]
