"""What must not grow with the findings of a batch or a run: tables stored on the way, joins, patterns tried on texts that can't match."""

from pyspark.sql import functions as F

from auditlake.functions import sql as sql_functions
from auditlake.functions import text as t
from auditlake.operators import records
from auditlake.plans import runs
from auditlake.streaming import streams

SMALL = "/root/testdata/sf0.001"


def test_a_stream_of_runs_stores_its_runs_and_not_their_findings(spark, tmp_path, monkeypatch):
    rows = [("r", k, f"f{n}") for k in (1, 2, 3) for n in range(100) if n % 3 != k - 1] * 2
    spark.createDataFrame(rows, "repo_id string, run long, fingerprint string").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    held, durable = [], streams.durable
    monkeypatch.setattr(streams, "durable", lambda df: held.append(durable(df)) or held[-1])
    stream = spark.readStream.schema("repo_id string, run long, fingerprint string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    streams.delta_arriving(stream, f"{tmp_path}/out")
    assert [x.count() for x in held] == [3]
    got = sorted(tuple(x) for x in streams.changes(spark, f"{tmp_path}/out").select("run", "change", "fingerprint").collect())
    has = {k: {f for _, r, f in rows if r == k} for k in (0, 1, 2, 3)}
    assert got == sorted([(k, "persisting" if f in has[k - 1] else "introduced", f) for k in (1, 2, 3) for f in has[k]] + [(k, "fixed", f) for k in (2, 3) for f in has[k - 1] - has[k]])


def test_changes_of_a_history_are_made_once(spark):
    history, changes = runs._history(spark, SMALL)
    assert "Join" not in changes._jdf.queryExecution().optimizedPlan().toString() and history.where("run = '1'").count() == history.where("run = '2'").count() > 0


def test_handshakes_of_a_host_do_not_meet_each_other(spark):
    hands = spark.createDataFrame([("h", "SSLv3", f"2024-01-{d:02}") for d in range(1, 29)], "host string, protocol string, day string").select("host", "protocol", F.col("day").cast("timestamp").alias("not_after"))
    found = records.host_findings(hands, spark.createDataFrame([("h", 22)], "host string, port int"), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # of ports with their ten services
    assert found.where("id LIKE 'C2-weak%'").count() == 28 and found.where("id LIKE 'C2-cert-expired%'").count() == 9 and found.where("id LIKE 'C2-cert-soon%'").count() == 14


def test_patterns_of_secrets_are_tried_behind_their_strings(spark):
    sql_functions.register(spark)
    texts = spark.createDataFrame([("my_password_2 : 'hunter22'",), ("password:abc",), ("PASSWORD = abcd",), ("nothing",), ("sk-" + "a" * 32,), ("A" * 32,), ("https://u:p@h",), ("",), (None,)], "x string")
    got = texts.select(t.looks_like_secret(F.col("x")), F.expr("looks_like_secret(x)"))
    assert [tuple(x) for x in got.collect()] == [(v, v) for v in (True, False, True, False, True, True, True, False, None)]
    for one in (texts.select(t.looks_like_secret(F.col("x"))), texts.selectExpr("looks_like_secret(x)"), texts.selectExpr("mask_secrets(x)")):
        assert "Contains(" in one._jdf.queryExecution().optimizedPlan().toString() or "akia" in one._jdf.queryExecution().optimizedPlan().toString().lower().split("rlike")[0]
