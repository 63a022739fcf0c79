"""Logs that bear a repeated write."""

from matchframe.sources import sinks


def test_a_repeated_run_leaves_one_copy(spark, tmp_path):
    log, latest = str(tmp_path / "log"), str(tmp_path / "latest")
    first = spark.range(3).selectExpr("id", "id * 2 AS v")
    second = spark.range(5).selectExpr("id", "id * 3 AS v")
    sinks.append_snapshot(first, log, latest, run="2024-01-01T00")
    sinks.append_snapshot(second, log, latest, run="2024-01-02T00")
    # A try of the second run that stopped half-way, then its repetition.
    sinks.write_run(second.limit(1), log, "2024-01-02T00")
    sinks.append_snapshot(second, log, latest, run="2024-01-02T00")
    rows = spark.read.parquet(log)
    assert rows.count() == 8 and rows.where("run_id = '2024-01-01T00'").count() == 3
    assert sorted((r.id, r.v) for r in sinks.latest_run(spark, log).collect()) == [(k, 3 * k) for k in range(5)]
    assert spark.read.parquet(latest).count() == 5
    # Files of a write that was killed before its commit are no part of the log.
    half = tmp_path / "log" / "run_id=2024-01-03T00" / "_temporary"
    half.mkdir(parents=True)
    (half / "part-00000.parquet").write_bytes(b"half")
    assert spark.read.parquet(log).count() == 8


def test_a_repeated_experiment_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "exp")
    for _ in range(2):
        sinks.append_experiment(spark, {"name": "x", "metrics": {"a": 1}}, path, run="r1")
    sinks.append_experiment(spark, {"name": "y"}, path, run="r2")
    assert spark.read.parquet(path).count() == 2
