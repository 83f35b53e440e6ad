"""Registered queries on structured inputs that Spark derives from the given tables: parity, manifests, other tools' reports, enrichment joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import enrich, exports, parity, rollup
from auditlake.plans.queries import _RISK_CASE, D, S, query
from auditlake.sources import corpus, documents, imports

NOW = "1998-01-01"


@query("git_parity", "WITH g AS (SELECT 'r' || c_custkey AS repo_id, c_custkey % 4 > 0 AND c_custkey % 5 != c_custkey % 2 AS drift, c_custkey % 3 > 0 AS dirty FROM customer), s AS (SELECT *, (10.0 - CASE WHEN drift THEN 6 ELSE 0 END - CASE WHEN dirty THEN 2.5 ELSE 0 END)::DOUBLE AS score FROM g) SELECT *, CASE WHEN score >= 9.5 THEN 'ok' WHEN score >= 6 THEN 'warn' ELSE 'risk' END AS status FROM s")
def git_parity(spark: S, sf: str) -> D:
    c = spark.read.parquet(f"{sf}/customer.parquet")
    k = F.col("c_custkey")
    return parity.git_parity(c.select(F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), (k % 5).cast("string").alias("head_sha"), (k % 2).cast("string").alias("main_sha"), (k % 4).alias("behind"), (k % 3).alias("dirty_files")))


@query("cert_expiry", f"WITH c AS (SELECT 'o' || o_orderkey AS source, floor((epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '{NOW}')) / 86400000)::BIGINT AS days FROM orders) SELECT *, CASE WHEN days < 0 THEN 'P0' ELSE 'P1' END AS severity FROM c WHERE days < 14")
def cert_expiry(spark: S, sf: str) -> D:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return parity.cert_expiry(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source"), F.col("o_orderdate").cast("timestamp").alias("not_after")), F.lit(NOW).cast("timestamp"))


@query("runtime_freshness", f"WITH c AS (SELECT 'c' || o_orderkey AS name, o_orderstatus = 'P' AS bad, floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(o_orderdate)) / 86400000) > 14 AS old FROM orders) SELECT name, 'P1' AS severity, 'state' AS reason FROM c WHERE bad UNION ALL SELECT name, 'P2', 'age' FROM c WHERE old")
def runtime_freshness(spark: S, sf: str) -> D:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderstatus") == "P", "restarting").otherwise("running").alias("state"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return parity.runtime_freshness(c, F.lit(NOW).cast("timestamp"))


_MOUNT = "concat('s', l_linenumber % 3) AS service, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('vol', l_partkey % 2) END AS source, CASE l_suppkey % 4 WHEN 0 THEN '/app/Uploads/' WHEN 1 THEN '/var/log' WHEN 2 THEN '/srv/shared' ELSE '/data/cache' END AS target"


@query("volume_mismatch", f"WITH m AS (SELECT concat('r', l_orderkey) AS repo_id, {_MOUNT} FROM lineitem), d AS (SELECT repo_id, service, CASE target WHEN '/app/Uploads/' THEN 'uploads' WHEN '/srv/shared' THEN 'shared' ELSE 'cache' END AS key, concat(coalesce(source, '<anon>'), '>', target) AS pair FROM m WHERE target != '/var/log') SELECT repo_id, key, count(DISTINCT service) AS services, count(DISTINCT pair) AS pairs FROM d GROUP BY repo_id, key HAVING count(DISTINCT service) >= 2 AND count(DISTINCT pair) >= 2")
def volume_mismatch(spark: S, sf: str) -> D:
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    return parity.volume_mismatch(x.selectExpr("concat('r', l_orderkey) AS repo_id", *(f"{c} AS {n}" for c, n in ((c.rsplit(" AS ", 1)) for c in _MOUNT.replace(", CASE", "; CASE").split("; ")))))


_COMPOSE = """concat('{"services": {"web', p_size, '": {"volumes": ["vol', p_partkey % 2, ':/app/uploads:ro", "/tmp/files", {"type": "bind", "source": "./d', p_partkey % 3, '", "target": "/srv/data"}, 7]}, "idle": {}, "worker": {"volumes": [', CASE WHEN p_partkey % 4 = 0 THEN '"vol1:/app/uploads"' ELSE '{"target": "/srv/data"}' END, ']}}}')"""


@query(
    "compose_mounts",
    """WITH p AS (SELECT p_brand AS repo_id, p_partkey AS k, concat('web', p_size) AS web FROM part)
SELECT repo_id, k, web AS service, concat('vol', k % 2) AS source, '/app/uploads' AS target FROM p UNION ALL SELECT repo_id, k, web, NULL, '/tmp/files' FROM p UNION ALL SELECT repo_id, k, web, concat('./d', k % 3), '/srv/data' FROM p
UNION ALL SELECT repo_id, k, 'worker', CASE WHEN k % 4 = 0 THEN 'vol1' END, CASE WHEN k % 4 = 0 THEN '/app/uploads' ELSE '/srv/data' END FROM p""",
)
def compose_mounts(spark: S, sf: str) -> D:
    """Volumes of whole Compose documents, short and long forms mixed."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.col("p_partkey").alias("k"), F.expr(_COMPOSE).alias("doc"))
    return documents.mounts(p).select("repo_id", "k", "service", "source", "target")


_LISTED = """CASE p_partkey % 3 WHEN 0 THEN concat('{"kind": "List", "apiVersion": "v1", "items": [', a, ', ', b, ']}') WHEN 1 THEN concat(a, chr(10), '---', chr(10), b, chr(10), '---', chr(10), 'not json') ELSE concat('[', a, ', 5, ', b, ']') END"""
_ONE = """concat('{"kind": "Service", "apiVersion": "v1", "metadata": {"name": "s', p_size, '"}}') AS a, concat('{"kind": "Ingress", "apiVersion": "n/v1"', CASE WHEN p_partkey % 2 = 0 THEN ', "metadata": {"name": "i"}' ELSE '' END, '}') AS b"""


@query("manifest_objects", "SELECT p_partkey AS k, 'Service' AS kind, concat('s', p_size) AS name FROM part UNION ALL SELECT p_partkey, 'Ingress', CASE WHEN p_partkey % 2 = 0 THEN 'i' ELSE '?' END FROM part")
def manifest_objects(spark: S, sf: str) -> D:
    """Items of lists, several documents in one text, arrays."""
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey", *(x.strip() for x in (_ONE.split(" AS a, ")[0] + " AS a", _ONE.split(" AS a, ")[1])))
    return documents.manifests(p.select(F.col("p_partkey").alias("k"), F.expr(_LISTED).alias("doc"))).select("k", "kind", "name")


@query("env_parity", "WITH e AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS k FROM customer), h AS (SELECT DISTINCT c_nationkey AS n, c_mktsegment AS k FROM customer WHERE c_acctbal > 9000), g AS (SELECT n, k FROM e ANTI JOIN h USING (n, k)) SELECT concat('r', n) AS repo_id, count(*) AS missing, array_to_string(list_sort(list(k))[1:8], ',') AS keys FROM g GROUP BY n")
def env_parity(spark: S, sf: str) -> D:
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.expr("concat('r', c_nationkey) AS repo_id"), F.col("c_mktsegment").alias("key"), "c_acctbal")
    return parity.env_parity(c.select("repo_id", "key").distinct(), c.where("c_acctbal > 9000"))


@query("parity_layers", "WITH f AS (SELECT concat('r', l_orderkey) AS repo_id, concat('A', l_linenumber % 6 + 1) AS layer, CASE l_partkey % 5 WHEN 0 THEN 6.0 WHEN 1 THEN 2.5 WHEN 2 THEN 1.0 ELSE 0.0 END AS c FROM lineitem), s AS (SELECT repo_id, layer, (floor(greatest(0, 10 - sum(c)) * 10 + 0.5) / 10)::DOUBLE AS score FROM f GROUP BY ALL) SELECT *, CASE WHEN score >= 9.5 THEN 'ok' WHEN score >= 6 THEN 'warn' ELSE 'risk' END AS status FROM s")
def parity_layers(spark: S, sf: str) -> D:
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    return parity.parity_layers(x.select(F.expr("concat('r', l_orderkey) AS repo_id"), F.expr("concat('A', l_linenumber % 6 + 1) AS layer"), F.expr("concat('P', l_partkey % 5) AS severity")))


_MANIFEST = """concat('{"kind": "', CASE WHEN p_partkey % 7 = 0 THEN 'Ingress' WHEN p_partkey % 7 = 1 THEN 'Service' ELSE 'Pod' END, '", "apiVersion": "v1", "metadata": {"name": "n', p_partkey, '"}, "spec": {"securityContext": {"runAsNonRoot": ', CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '"true"' END,
'}, "containers": [{"name": "c', p_size, '", "image": "', CASE p_partkey % 4 WHEN 0 THEN 'img:latest' WHEN 1 THEN 'reg:5000/x' WHEN 2 THEN 'img' ELSE 'img@sha256:ab' END, '", "env": [{"name": "DB_PASSWD", "value": "', CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END, '"}, {"name": "AWS_ACCESS_KEY", "value": ', CASE WHEN p_partkey % 5 < 2 THEN '"y"' ELSE '5' END, '}], "securityContext": {"privileged": ', CASE WHEN p_partkey % 11 = 0 THEN 'true' ELSE '"true"' END, '}}]}}')"""


@query("k8s_checks", """WITH p AS (SELECT p_brand AS repo_id, concat('k/', p_partkey, '.json') AS path, p_partkey AS k, concat('n', p_partkey) AS n, concat('n', p_partkey, '/c', p_size) AS c FROM part), w AS (SELECT * FROM p WHERE k % 7 > 1)
SELECT repo_id, path, 'K8S-1' AS "check", 'P0' AS severity, concat('K8S-privileged:', c) AS id FROM w WHERE k % 11 = 0 UNION ALL SELECT repo_id, path, 'K8S-2', 'P1', concat('K8S-root:', c) FROM w WHERE k % 3 != 0 UNION ALL SELECT repo_id, path, 'K8S-3', 'P2', concat('K8S-image-tag:', c) FROM w WHERE k % 4 IN (0, 2)
UNION ALL SELECT repo_id, path, 'K8S-4', 'P1', concat('K8S-plain-secret:', c, '/DB_PASSWD') FROM w WHERE k % 5 = 0 UNION ALL SELECT repo_id, path, 'K8S-4', 'P1', concat('K8S-plain-secret:', c, '/AWS_ACCESS_KEY') FROM w WHERE k % 5 < 2 UNION ALL SELECT repo_id, path, 'K8S-5', 'P2', concat('K8S-ingress-no-tls:', n) FROM p WHERE k % 7 = 0""")
def k8s_checks(spark: S, sf: str) -> D:
    p = spark.read.parquet(f"{sf}/part.parquet")
    found = parity.k8s_checks(p.select(F.col("p_brand").alias("repo_id"), F.expr("concat('k/', p_partkey, '.json') AS path"), F.expr(_MANIFEST).alias("doc")))
    return found.select("repo_id", "path", "check", "severity", "id")


_SARIF = """concat('{"runs": [{"tool": {"driver": {"name": "', CASE p_partkey % 6 WHEN 0 THEN 'Checkov' WHEN 1 THEN 'Semgrep' WHEN 2 THEN 'KICS' WHEN 3 THEN 'Polaris' WHEN 4 THEN 'Nikto' ELSE 'trivy' END, '", "rules": [{"id": "R/', p_partkey % 9, '", "properties": {"tags": ["CWE-1"]', CASE WHEN p_partkey % 3 = 0 THEN ', "security-severity": "9.4"' ELSE '' END, '}}]}}, "results": [{', CASE WHEN p_partkey % 4 = 0 THEN concat('"rule": {"id": "R/', p_partkey % 9, '"}, ') ELSE concat('"ruleId": "R/', p_partkey % 9, '", ') END, '"ruleIndex": 0, ',
CASE WHEN p_partkey % 5 = 0 THEN '"level": "error", ' ELSE '' END, '"message": {"text": "see CVE-2024-', 1000 + p_partkey % 50, '"}', CASE WHEN p_partkey % 8 = 1 THEN '' ELSE concat(', "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a', p_size, '.js"}, "region": {"startLine": ', 3 + p_partkey % 2, '}}}]') END, '}]}]}')"""


@query("sarif_import", """WITH p AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'Checkov' WHEN 1 THEN 'Semgrep' WHEN 2 THEN 'KICS' WHEN 3 THEN 'Polaris' WHEN 4 THEN 'Nikto' ELSE 'trivy' END AS tool, CASE p_partkey % 6 WHEN 0 THEN 'CLOUD' WHEN 2 THEN 'CLOUD' WHEN 3 THEN 'K8S' WHEN 4 THEN 'C' ELSE 'B' END AS module, p_partkey % 8 != 1 AS placed FROM part)
SELECT p_brand AS repo_id, concat('EXT-', tool, '-R-', p_partkey % 9, CASE WHEN placed THEN concat(':a', p_size, '.js:', 3 + p_partkey % 2) ELSE ':n-a:0' END) AS id, concat('[', tool, '] R/', p_partkey % 9) AS title, concat('R-', p_partkey % 9) AS "check", CASE WHEN p_partkey % 3 = 0 THEN 'P0' WHEN p_partkey % 5 = 0 THEN 'P1' ELSE 'P2' END AS severity, module, CASE WHEN placed THEN concat('a', p_size, '.js') ELSE tool END AS source, CASE WHEN placed THEN (3 + p_partkey % 2)::INT END AS line, concat('CVE-2024-', 1000 + p_partkey % 50) AS cves FROM p""")
def sarif_import(spark: S, sf: str) -> D:
    return imports.sarif(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.expr(_SARIF).alias("doc"))).select("repo_id", "id", "title", "check", "severity", "module", "source", "line", "cves")


_OSV = """concat('{"results": [{"source": {"path": "x"}, "packages": [{"package": {"name": "p', p_size, '"}, "vulnerabilities": [{"id": "GHSA-', p_partkey % 6, '", "aliases": ["CVE-2023-', 1000 + p_partkey % 9, '"], "severity": [', CASE p_partkey % 4 WHEN 0 THEN '{"type": "V", "score": "7.5"}' WHEN 1 THEN '{"type": "V", "score": "CVSS:3.1/AV:N"}' ELSE '' END, '], "database_specific": {', CASE WHEN p_partkey % 4 = 2 THEN '"severity": "CRITICAL"' ELSE '' END, '}}]}]}]}')"""


@query("osv_import", "SELECT p_brand AS repo_id, concat('B2-osv:p', p_size, ':GHSA-', p_partkey % 6) AS id, CASE p_partkey % 4 WHEN 0 THEN 'P1' WHEN 2 THEN 'P0' ELSE 'P2' END AS severity, concat('CVE-2023-', 1000 + p_partkey % 9) AS cves FROM part")
def osv_import(spark: S, sf: str) -> D:
    return imports.osv(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.expr(_OSV).alias("doc")))


_NPM = """CASE p_partkey % 3 WHEN 0 THEN concat('{"vulnerabilities": {"a', p_size, '": {"severity": "critical", "range": "<2", "via": ["b", {"title": "Bad parse"}]}, "b": {"severity": "low", "via": ["c"]}}}') WHEN 1 THEN concat('{"advisories": {"7": {"module_name": "m', p_size, '", "severity": "moderate", "title": "Old", "vulnerable_versions": ">=1"}}}') ELSE 'not json' END"""


@query("npm_audit_import", "SELECT p_brand AS repo_id, concat('B2-vuln:a', p_size) AS id, 'P0' AS severity, concat('Zafiyetli bağımlılık: a', p_size, ' (critical)') AS title, concat('a', p_size, ' <2: Bad parse') AS excerpt FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_brand, 'B2-vuln:b', 'P3', 'Zafiyetli bağımlılık: b (low)', 'b: b zafiyeti' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_brand, concat('B2-vuln:m', p_size), 'P2', concat('Zafiyetli bağımlılık: m', p_size, ' (moderate)'), concat('m', p_size, ' >=1: Old') FROM part WHERE p_partkey % 3 = 1")
def npm_audit_import(spark: S, sf: str) -> D:
    return imports.npm_audit(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.expr(_NPM).alias("doc")))


_NUCLEI = """CASE WHEN p_partkey % 4 = 3 THEN 'noise' ELSE concat('{"template-id": "t ', p_size, '", "info": {', CASE WHEN p_partkey % 5 = 0 THEN '"name": "Open git", ' ELSE '' END, '"severity": "', CASE p_partkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'medium' ELSE 'info' END, '"}', CASE WHEN p_partkey % 2 = 0 THEN concat(', "matched-at": "https://h/', p_partkey, '"') ELSE '' END, ', "host": "h"}') END"""


@query("nuclei_import", "WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN concat('https://h/', p_partkey) ELSE 'h' END AS place FROM part WHERE p_partkey % 4 != 3) SELECT p_brand AS repo_id, concat('EXT-nuclei-t ', p_size, ':', place) AS id, concat('[nuclei] ', CASE WHEN p_partkey % 5 = 0 THEN 'Open git' ELSE concat('t ', p_size) END) AS title, concat('t ', p_size) AS \"check\", CASE p_partkey % 4 WHEN 0 THEN 'P0' WHEN 1 THEN 'P2' ELSE 'P3' END AS severity, place AS source FROM p")
def nuclei_import(spark: S, sf: str) -> D:
    return imports.nuclei(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("repo_id"), F.expr(_NUCLEI).alias("line"))).select("repo_id", "id", "title", "check", "severity", "source")


# --- enrichment joins: dependency findings from line items, feeds from other tables
_DEP = "concat('r', l_suppkey % 25) AS repo_id, l_orderkey AS k, l_linenumber AS j, concat('CVE-2024-', 1000 + l_partkey % 500) AS cve, concat('B2-vuln:pkg', l_partkey % 40) AS id"


def _dependencies(spark: S, sf: str) -> D:
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    return x.select(F.expr("concat('r', l_suppkey % 25) AS repo_id"), F.expr("concat('CVE-2024-', 1000 + l_partkey % 500) AS cve"), F.expr("concat('B2-vuln:pkg', l_partkey % 40) AS id")).distinct().withColumn("cves", F.array("cve")).withColumn("exploitability", F.lit("medium"))


@query("kev_epss_enrich", f"WITH d AS (SELECT DISTINCT repo_id, cve, id FROM (SELECT {_DEP} FROM lineitem)), kev AS (SELECT DISTINCT concat('CVE-2024-', 1000 + s_suppkey % 50) AS cve FROM supplier), epss AS (SELECT concat('CVE-2024-', 1000 + p_partkey % 400) AS cve, max(p_size / 60.0) AS score FROM part GROUP BY 1), e AS (SELECT d.*, kev.cve IS NOT NULL AS kev, epss.score FROM d LEFT JOIN kev USING (cve) LEFT JOIN epss USING (cve)) SELECT repo_id, kev, CASE WHEN kev OR coalesce(score, 0) >= 0.5 THEN 'high' ELSE 'medium' END AS exploitability, count(*) AS n FROM e GROUP BY ALL")
def kev_epss_enrich(spark: S, sf: str) -> D:
    kev = spark.read.parquet(f"{sf}/supplier.parquet").select(F.expr("concat('CVE-2024-', 1000 + s_suppkey % 50) AS cve"))
    epss = spark.read.parquet(f"{sf}/part.parquet").select(F.expr("concat('CVE-2024-', 1000 + p_partkey % 400) AS cve"), (F.col("p_size") / 60.0).alias("score"))
    out = enrich.kev_epss_enrich(_dependencies(spark, sf), kev, epss, ["repo_id", "id", "cve"])
    return out.groupBy("repo_id", "kev", "exploitability").agg(F.count("*").alias("n"))


@query("reachability_enrich", f"WITH d AS (SELECT DISTINCT repo_id, cve, id FROM (SELECT {_DEP} FROM lineitem)), g AS (SELECT DISTINCT concat('r', s_suppkey % 20) AS repo_id, concat('B2-vuln:pkg', s_suppkey % 30) AS id FROM supplier), k AS (SELECT DISTINCT repo_id FROM g), e AS (SELECT d.*, CASE WHEN k.repo_id IS NOT NULL THEN g.id IS NOT NULL END AS reachable FROM d LEFT JOIN k USING (repo_id) LEFT JOIN g USING (repo_id, id)) SELECT repo_id, reachable, CASE WHEN NOT coalesce(reachable, true) THEN 'low' ELSE 'medium' END AS exploitability, count(*) AS n FROM e GROUP BY ALL")
def reachability_enrich(spark: S, sf: str) -> D:
    graph = spark.read.parquet(f"{sf}/supplier.parquet").select(F.expr("concat('r', s_suppkey % 20) AS repo_id"), F.expr("concat('pkg', s_suppkey % 30) AS pkg"))
    out = enrich.reachability_enrich(_dependencies(spark, sf).withColumn("kev", F.lit(False)), graph)
    return out.groupBy("repo_id", "reachable", "exploitability").agg(F.count("*").alias("n"))


_IMPORTS = [
    ("a.ts", "import x from '@scope/kit/deep'\nconst y = require('left-pad/lib')\nimport('./own')\nimport 'side'"), ("b.py", "import os\nfrom flask.views import View\n  import json"), ("c.go", 'import "fmt"\nimport (\n  q "github.com/a/b"\n  "gorm.io/gorm"\n)'), ("d.txt", "import os\nrequire('x')"),
]
_IMPORTED = {0: ["@scope/kit", "left-pad", "side"], 1: ["os", "flask", "json"], 2: ["github.com/a/b", "gorm.io/gorm"], 3: []}


@query("import_graph", "SELECT DISTINCT repo_id, pkg FROM (" + " UNION ALL ".join(f"SELECT p_brand || p_size AS repo_id, unnest([{corpus.quoted(v)}]::VARCHAR[]) AS pkg FROM part WHERE p_partkey % 4 = {k}" for k, v in _IMPORTED.items()) + ")")
def import_graph(spark: S, sf: str) -> D:
    """Packages of files in three languages; what is written out by hand for each kind of file is what the SQL tells."""
    table = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in _IMPORTS))
    x = spark.read.parquet(f"{sf}/part.parquet").select(F.expr("p_brand || p_size AS repo_id"), F.get(table, (F.col("p_partkey") % 4).cast("int")).alias("f"))
    return enrich.import_graph(x.select("repo_id", "f.*"))


_WAIVER = "n_nationkey AS ordinal, CASE WHEN n_nationkey % 3 = 0 THEN concat('c', n_nationkey) END AS \"check\", CASE WHEN n_nationkey % 3 = 1 THEN concat('i', n_nationkey) END AS id, concat('because ', n_name) AS reason, CASE WHEN n_nationkey % 4 = 0 THEN '2020-01-01' END AS expires"


@query("waiver_partition", f"WITH w AS (SELECT {_WAIVER} FROM nation), f AS (SELECT DISTINCT l_partkey AS fp, concat('c', l_partkey % 30) AS \"check\", concat('i', l_partkey % 28) AS id FROM lineitem), m AS (SELECT f.fp, arg_min(reason, ordinal) AS reason FROM f JOIN w ON (w.\"check\" IS NOT NULL OR w.id IS NOT NULL) AND (w.\"check\" IS NULL OR w.\"check\" = f.\"check\") AND (w.id IS NULL OR w.id = f.id) WHERE expires IS NULL OR expires >= '2024-06-01' GROUP BY f.fp) SELECT fp AS fingerprint, reason FROM f LEFT JOIN m USING (fp)")
def waiver_partition(spark: S, sf: str) -> D:
    n = spark.read.parquet(f"{sf}/nation.parquet")
    k = F.col("n_nationkey")
    w = n.select(k.alias("ordinal"), F.lit(None).cast("long").alias("fingerprint"), F.when(k % 3 == 0, F.expr("concat('c', n_nationkey)")).alias("check"), F.when(k % 3 == 1, F.expr("concat('i', n_nationkey)")).alias("id"), F.expr("concat('because ', n_name) AS reason"), F.when(k % 4 == 0, "2020-01-01").alias("expires"))
    f = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("fingerprint")).distinct().select("fingerprint", F.expr("concat('c', fingerprint % 30) AS check"), F.expr("concat('i', fingerprint % 28) AS id"))
    return enrich.waiver_partition(f, w, "2024-06-01", ["fingerprint", "check", "id"]).select("fingerprint", "reason")


@query("asvs_checklist", f"WITH f AS (SELECT concat('r', l_orderkey) AS repo_id, concat(l_linenumber * 2, '.', l_partkey % 5) AS code FROM lineitem), g AS (SELECT DISTINCT repo_id, c FROM f, (SELECT unnest([{corpus.quoted(rollup.ASVS)}]) AS c)), h AS (SELECT DISTINCT repo_id, code FROM f) SELECT g.repo_id, c AS control, CASE WHEN h.code IS NOT NULL THEN 'fail' ELSE 'unknown' END AS status FROM g LEFT JOIN h ON h.repo_id = g.repo_id AND h.code = c")
def asvs_checklist(spark: S, sf: str) -> D:
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    # some name a control below the one that is followed
    return rollup.asvs_checklist(x.select(F.expr("concat('r', l_orderkey) AS repo_id"), F.expr("concat('ASVS ', l_linenumber * 2, '.', l_partkey % 5, CASE WHEN l_suppkey % 2 = 0 THEN '.1' ELSE '' END) AS reference")))


@query("checklist_score", "WITH f AS (SELECT concat('r', l_orderkey % 100) AS repo_id, l_partkey % 4 AS s FROM lineitem) SELECT repo_id, CASE WHEN count(*) FILTER (WHERE s != 3) > 0 THEN floor((count(*) FILTER (WHERE s = 0) + 0.5 * count(*) FILTER (WHERE s = 1)) / count(*) FILTER (WHERE s != 3) * 100 + 0.5)::BIGINT END AS score FROM f GROUP BY repo_id")
def checklist_score(spark: S, sf: str) -> D:
    x = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("concat('r', l_orderkey % 100) AS repo_id"), F.expr("element_at(array('pass', 'partial', 'fail', 'unknown'), CAST(l_partkey % 4 + 1 AS INT)) AS status"))
    return rollup.checklist_score(x)


# --- exports and manifests
_FOUND = f"WITH {corpus.findings_sql()}"


@query("playbook", f"{_FOUND}, e AS (SELECT *, ({_RISK_CASE(0)})::DOUBLE AS cvss, {_RISK_CASE(1)} AS ex FROM finding WHERE severity IN ('P0', 'P1')) SELECT repo_id, id, severity, printf('CVSS %.1f / exploitability %s', cvss, ex) AS risk, count(*) AS n FROM e GROUP BY ALL")
def playbook(spark: S, sf: str) -> D:
    out = exports.playbook(enrich.risk_enrich(corpus.findings(spark, sf)))
    return out.groupBy("repo_id", "id", "severity", "risk").agg(F.count("*").alias("n"))


@query("history_rows", f"{_FOUND}, b AS (SELECT DISTINCT repo_id, fingerprint FROM finding WHERE seen != 0), n AS (SELECT DISTINCT repo_id, fingerprint FROM finding WHERE seen != 1), t AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE severity = 'P0') AS p0, count(*) FILTER (WHERE severity = 'P1') AS p1, count(*) FILTER (WHERE severity = 'P2') AS p2, count(*) FILTER (WHERE severity = 'P3') AS p3, count(*) FILTER (WHERE (repo_id, fingerprint) NOT IN (SELECT (repo_id, fingerprint) FROM b)) AS introduced, count(*) FILTER (WHERE (repo_id, fingerprint) IN (SELECT (repo_id, fingerprint) FROM b)) AS persisting FROM finding WHERE seen != 1 GROUP BY repo_id), x AS (SELECT repo_id, count(*) AS fixed FROM finding WHERE seen != 0 AND (repo_id, fingerprint) NOT IN (SELECT (repo_id, fingerprint) FROM n) GROUP BY repo_id) SELECT t.*, coalesce(fixed, 0) AS fixed FROM t LEFT JOIN x USING (repo_id)")
def history_rows(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf)
    return exports.history_rows(f.where("seen != 1"), enrich.delta(f.where("seen != 0"), f.where("seen != 1")))


@query("export_sarif")
def export_sarif(spark: S, sf: str) -> D:
    return exports.export_sarif(corpus.findings(spark, sf))


_PACKAGE = """CASE p_partkey % 3 WHEN 0 THEN concat('{"dependencies": {"dd-trace": "1", "a', p_size, '": "2"}, "devDependencies": {"jest": "1"}}') WHEN 1 THEN concat('# note', chr(10), 'Django>=4', chr(10), 'lib', p_size, '[x]==1', chr(10)) ELSE concat('module m', chr(10), 'require github.com/A/b', p_size, ' v1.2.3') END"""
_WHERE = "concat('p', p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/package.json' WHEN 1 THEN '/requirements.txt' ELSE '/go.mod' END)"


def _deps(spark: S, sf: str) -> D:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return exports.manifest_deps(p.select(F.expr("concat(p_brand, '-', p_partkey % 40) AS repo_id"), F.expr(f"{_WHERE} AS path"), F.expr(f"{_PACKAGE} AS content")))


_DEPS = "WITH p AS (SELECT concat(p_brand, '-', p_partkey % 40) AS repo_id, p_partkey % 3 AS k, p_size FROM part), d AS (SELECT repo_id, unnest(['dd-trace', 'a' || p_size, 'jest']) AS dep FROM p WHERE k = 0 UNION SELECT repo_id, unnest(['django', 'lib' || p_size]) FROM p WHERE k = 1 UNION SELECT repo_id, 'github.com/a/b' || p_size FROM p WHERE k = 2)"


@query("manifest_deps", f"{_DEPS} SELECT DISTINCT repo_id, dep FROM d")
def manifest_deps(spark: S, sf: str) -> D:
    return _deps(spark, sf)


@query("dependency_presence", f"{_DEPS} SELECT repo_id, bool_or(dep LIKE 'dd-%' OR dep LIKE 'lib1%') AS present FROM d GROUP BY repo_id")
def dependency_presence(spark: S, sf: str) -> D:
    return exports.dependency_presence(_deps(spark, sf), ["dd-", "lib1"])
