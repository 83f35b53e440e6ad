"""Module checks and estate operators on small repositories of our own."""

from pyspark.sql import functions as F

from auditlake.functions import text as t
from auditlake.operators import enrich, estate, modules
from auditlake.plans import queries
from auditlake.sources import corpus
from auditlake.streaming import streams

FILES = [
    ("r", "src/pay.js", "app.post('/webhook', (req, res) => { new Stripe(k); });\n// constructEvent would verify"),
    ("r", "src/auth.js", "const login = 1;\njwt.sign({ id }, secret)"),
    ("r", "src/up.js", "multer();\nfs.writeFileSync(path.join(d, file.originalname), b)\nnext();"),
    ("r", "src/flow.js", "app.post('/transfer', async (req, res) => {\n  await a.update({});\n  if (x) { await b.update({}); }\n  await order.create({});\n});\nfunction noop() { return 1; }"),
    ("safe", "src/a.js", "const x = 1;"),
    ("safe", "node_modules/b.js", "SELECT * FROM t; app.get('/x')"),
]


def _files(spark):
    return spark.createDataFrame(FILES, "repo_id string, path string, content string")


def test_checks_of_modules(spark):
    files = _files(spark)
    flags = modules.module_flags(files)
    of_repo = {(x["repo_id"], x["check"]) for x in modules.repo_checks(flags).collect()}
    assert ("r", "AUTH-1") in of_repo and ("r", "UPLOAD-1") in of_repo and not [c for n, c in of_repo if n == "safe"]
    of_file = {(x["path"], x["check"], x["line_no"]) for x in modules.file_checks(files, flags).collect()}
    assert ("src/auth.js", "AUTH-4", 2) in of_file and ("src/pay.js", "PAY-8", None) in of_file
    assert ("src/pay.js", "PAY-2", None) not in of_file  # the raw text names the check, even in a comment
    of_line = {(x["path"], x["check"], x["line_no"]) for x in modules.line_checks(files, flags).collect()}
    assert ("src/up.js", "UPLOAD-2", 2) in of_line and not [p for p, _, _ in of_line if "node_modules" in p]


def test_handlers(spark):
    code = dict((p, c) for _, p, c in FILES)["src/flow.js"]
    got = modules.segments(code)
    assert [n for n, *_ in got] == [1, 6] and got[0][1].count("{") == got[0][1].count("}") == 5 and got[1][1] == "{ return 1; }"
    assert modules.segments("app.get('/x', () => { never closed")[0][1].startswith("{ never")
    found = {(x["check"], x["line_no"]) for x in modules.flow_checks(modules.handler_stats(modules.handler_segments(_files(spark)))).collect() if x["path"] == "src/flow.js"}
    assert found == {("FLOW-1", 1), ("FLOW-3", 1)}
    assert modules.handler_segments(_files(spark).limit(0)).count() == 0


def test_stacks_and_migrations(spark):
    rows = [("a", "package.json", '{"dependencies": {"prisma": "1"}}'), ("a", "prisma/migrations/1/migration.sql", "CREATE TABLE x (i INT);\ndrop table y;"), ("a", "go.mod", "module m"), ("a", "migrations/2.up.sql", "TRUNCATE z"), ("b", "go.mod", "module m"), ("b", "db/migrations/3.down.sql", "DROP TABLE q"), ("c", "x", "y")]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    profile = estate.stack_profile(files)
    assert {x["repo_id"]: x["stacks"] for x in profile.collect()} == {"a": ["go", "node", "prisma"], "b": ["go"], "c": []}
    got = [(x["repo_id"], x["stack"], x["line_no"], x["labels"], x["severity"]) for x in estate.destructive_migrations(files, profile).collect()]
    assert got == [("a", "prisma", 2, "DROP TABLE", "P0")]


def test_waivers_with_nulls_and_entropy(spark):
    found = spark.createDataFrame([("f1", None, "i"), ("f2", "c", None)], "fingerprint string, check string, id string")
    waivers = spark.createDataFrame([(1, "f1", None, None, "known", None)], "ordinal int, fingerprint string, check string, id string, reason string, expires string")
    got = {x["fingerprint"]: x["reason"] for x in enrich.waiver_partition(found, waivers, "2024-01-01", ["fingerprint", "check", "id"]).collect()}
    assert got == {"f1": "known", "f2": None}
    x = spark.createDataFrame([("aabb",), ("",), (None,), ("é中😀a",)], "s string")
    assert [(a, b) for a, b in x.select(F.round(t.text_entropy("s"), 6), F.round(t.shannon_entropy(F.col("s")), 6)).collect()] == [(1.0, 1.0), (0.0, 0.0), (None, None), (2.0, 2.0)]


def test_parts_are_dealt_over_tasks(spark, tmp_path):
    """A table in one file is read by one task; what is made of its rows is not."""
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (corpus.app_corpus, corpus.code_corpus, corpus.estate_corpus):
        of_task = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(of_task) == 4 and max(x["count"] for x in of_task) < 6_000
    assert corpus.parts(spark, str(tmp_path)).select("p_partkey").distinct().count() == 20_000


def test_copies_are_looked_at_once(spark):
    """Files of one text share what is seen in it, and differ by path, repository and module."""
    text = "const login = 1;\njwt.sign({ id }, secret)\napp.get('/x', async (req, res) => db.query('SELECT * FROM t'))"
    rows = [("a", "src/x.js", text), ("a", "src/x.js", text), ("b", "src/y.ts", text), ("c", "node_modules/x.js", text), ("d", "x.txt", text), ("e", None, text), ("f", "src/n.js", None)]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    assert modules._texts_of(files).count() == 1
    hits = [(x["repo_id"], x["check"], x["line_no"]) for x in modules.file_checks(files, modules.module_flags(files)).collect()]
    assert sorted(x for x in hits if x[1] == "AUTH-4") == [("a", "AUTH-4", 2), ("a", "AUTH-4", 2), ("b", "AUTH-4", 2)] and not [x for x in hits if x[0] in "cdef"]
    lines = {(x["repo_id"], x["check"]) for x in modules.line_checks(files, modules.module_flags(files)).collect()}
    assert {("a", "API-1"), ("b", "API-1")} <= lines and not [x for x in lines if x[0] in "cdef"]
    flags = {x["repo_id"]: x["login"] for x in modules.module_flags(files).collect()}
    assert flags == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_arriving_parts_are_dealt_over_tasks(spark, tmp_path):
    """Also as a stream, a table in one file is scanned by several tasks."""
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = streams.drained(queries._parts_arriving(spark, str(tmp_path)).select("p_partkey", F.spark_partition_id().alias("task")))
    assert got.select("task").distinct().count() == 4 and got.select("p_partkey").distinct().count() == got.count() == 20_000
