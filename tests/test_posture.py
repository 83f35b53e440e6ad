"""Posture, files and exports on small tables of our own."""

import json

from pyspark.sql import functions as F

from auditlake.operators import exports, posture
from auditlake.sources import files


def test_ranks(spark):
    rows = spark.createDataFrame([(0,), (20,), (21,), (95,), (96,), (100,), (None,)], "posture long")
    got = {x["posture"]: (x["level"], x["next_level"], x["missing"]) for x in posture.ranks(rows).collect()}
    assert got == {0: (1, 2, 21), 20: (1, 2, 1), 21: (2, 3, 20), 95: (5, 6, 1), 96: (6, None, None), 100: (6, None, None), None: (1, None, None)}


def test_layers_without_a_row_are_optional(spark):
    board = spark.createDataFrame([("r", "B", 10.0, 0, 0, 0), ("r", "A", 9.0, 2, 0, 1), ("r", "C", None, 0, 0, 0), ("r", "PAY", 5.0, 1, 1, 0)], "repo_id string, module string, score double, findings long, p0 long, p1 long")
    got = {x["layer"]: (x["weight"], x["status"], x["verified"], x["findings"]) for x in posture.posture_bridge(board).collect()}
    assert len(got) == len(posture.WEIGHTS)
    assert got["B"] == (18, "active", True, 0) and got["A"] == (10, "partial", False, 2) and got["PAY"] == (12, "open", False, 1)
    assert got["C"] == (10, "optional", False, 0) and got["WEB"] == (9, "optional", False, None)
    count = posture.equipped_count(posture.posture_bridge(board)).first()
    assert (count["equipped"], count["layers"]) == (1, len(posture.WEIGHTS))


def test_corpus_of_a_folder(spark, tmp_path):
    for name in ("a b.js", ".env", ".github/w.yml", ".idea/x", "dist/y.js", "a/b/c/d/in.js", "a/b/c/d/e/out.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"{name}\nsecond line")
    got = {x["path"]: x["content"] for x in files.read_corpus(spark, str(tmp_path), "r").collect()}
    assert set(got) == {"a b.js", ".github/w.yml", "a/b/c/d/in.js"} and got["a b.js"] == "a b.js\nsecond line"


def test_sarif_of_findings_with_and_without_places(spark):
    rows = [("r", "X-1:a", "X-1", "P0", "f1", 9.8, "a.js", 3, "password = 'hunter22x'"), ("r", "X-1:b", "X-1", "P2", "f2", None, None, None, None), ("r", "Y-2", None, "P3", None, None, "b.js", 0, "t")]
    found = spark.createDataFrame(rows, "repo_id string, id string, check string, severity string, fingerprint string, cvss double, path string, line int, title string")
    docs = exports.export_sarif(found).collect()
    run = json.loads(docs[0]["doc"])["runs"][0]
    assert len(docs) == 1 and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["X-1", "Y-2"]
    assert run["tool"]["driver"]["rules"][0]["defaultConfiguration"]["level"] == "error"  # of the gravest finding
    first, second, third = run["results"]
    assert first["properties"]["security-severity"] == "9.8" and second["properties"]["security-severity"] == "4.0" and third["properties"]["security-severity"] == "1.0"
    assert first["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "a.js"}, "region": {"startLine": 3}} and "hunter22x" not in docs[0]["doc"]
    assert second["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "unknown"}} and "region" not in third["locations"][0]["physicalLocation"]
    plain = exports.export_sarif(found.select("repo_id", "id", "severity", "fingerprint"))
    assert len(json.loads(plain.first()["doc"])["runs"][0]["results"]) == 3
    assert exports.export_sarif(found.limit(0)).count() == 0


def test_findings_are_written_by_scan_and_the_last_one_is_read(spark, tmp_path):
    rows = [("r", 1, "b", "P1"), ("r", 1, "a", "P0"), ("r", 2, "c", "P2"), ("s", 1, "d", "P0")]
    found = spark.createDataFrame(rows, "repo_id string, scan_id int, id string, severity string")
    exports.write_findings(found.where("scan_id = 1"), str(tmp_path / "t"))
    exports.write_findings(found.where("scan_id = 2"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    last = {(x["repo_id"], x["id"]) for x in files.previous_run(back, "scan_id", 3).collect()}
    assert last == {("r", "c"), ("s", "d")} and files.previous_run(back, "scan_id", 1).count() == 0


def test_sarif_deals_findings_by_number_and_makes_documents_in_their_task(spark):
    """A repository's findings are not gathered to be cut, and there are tasks for them however small they are."""
    found = spark.range(120_000).select(F.concat(F.lit("r"), (F.col("id") % 1).cast("string")).alias("repo_id"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("check"), F.concat(F.lit("password = x"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("P"), (F.col("id") % 4).cast("string")).alias("severity"), F.sha1(F.col("id").cast("string")).alias("fingerprint"))
    docs = exports.export_sarif(found)
    assert docs.rdd.getNumPartitions() == 3
    got = [json.loads(x["doc"])["runs"][0] for x in docs.collect()]
    assert len(got) == 12 and sum(len(x["results"]) for x in got) == 120_000
    for x in got:
        keys = [(r["properties"]["severity"], r["properties"]["findingId"]) for r in x["results"]]
        assert keys == sorted(keys) and [r["id"] for r in x["tool"]["driver"]["rules"]] == sorted({r["ruleId"] for r in x["results"]})
