"""Registered queries of posture, files and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import enrich, exports, parity, posture, rollup, scan
from auditlake.plans import reports
from auditlake.plans.queries import _BOARD, _FOUND, _RISK_CASE, SQL, _board, _mask_sql, query
from auditlake.sources import corpus, files

S, D = SparkSession, DataFrame
_LAYERS = "layer_weight(layer, weight) AS (VALUES " + ", ".join(f"('{n}', {w})" for n, w in posture.WEIGHTS.items()) + ")"
_BRIDGE = f"""{_BOARD}, {_LAYERS}, bridge AS (SELECT r.repo AS repo_id, layer, weight, CASE WHEN score IS NULL THEN 'optional' WHEN p0 > 0 THEN 'open' WHEN p1 > 0 OR score < 8 THEN 'partial' ELSE 'active' END AS status, findings
FROM repos r CROSS JOIN layer_weight LEFT JOIN board b ON b.repo_id = r.repo AND b.module = layer)"""
_SCORE = "scored AS (SELECT repo_id, floor(sum(weight * CASE status WHEN 'active' THEN 1 WHEN 'partial' THEN 0.6 ELSE 0 END) / sum(weight) * 100 + 0.5)::BIGINT AS posture FROM bridge GROUP BY repo_id)"
_LADDER = "ladder(level, low) AS (VALUES " + ", ".join(f"({n}, {low})" for n, low in posture.LADDER.items()) + ")"


@query("posture_bridge", f"{_BRIDGE} SELECT repo_id, layer, weight, status, status = 'active' AS verified, findings FROM bridge")
def posture_bridge(spark: S, sf: str) -> D:
    return posture.posture_bridge(_board(spark, sf))


@query("equipped_count", f"{_BRIDGE} SELECT repo_id, count(*) FILTER (WHERE status = 'active') AS equipped, count(*) AS layers FROM bridge GROUP BY repo_id")
def equipped_count(spark: S, sf: str) -> D:
    return posture.equipped_count(posture.posture_bridge(_board(spark, sf)))


@query("posture_ranks", f"{_BRIDGE}, {_SCORE}, {_LADDER} SELECT repo_id, posture, (SELECT max(level) FROM ladder WHERE low <= posture) AS level, (SELECT min(level) FROM ladder WHERE low > posture) AS next_level, (SELECT min(low) FROM ladder WHERE low > posture) - posture AS missing FROM scored")
def posture_ranks(spark: S, sf: str) -> D:
    return posture.ranks(rollup.measured_posture_score(posture.posture_bridge(_board(spark, sf)), F.col("weight")))


@query("score_ranks", f"WITH {_LADDER}, s AS (SELECT p_partkey, (p_partkey % 101)::BIGINT AS posture FROM part) SELECT p_partkey, posture, (SELECT max(level) FROM ladder WHERE low <= posture) AS level, (SELECT min(level) FROM ladder WHERE low > posture) AS next_level, (SELECT min(low) FROM ladder WHERE low > posture) - posture AS missing FROM s")
def score_ranks(spark: S, sf: str) -> D:
    return posture.ranks(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", (F.col("p_partkey") % 101).alias("posture")))


@query("posture_metrics", f"{_BRIDGE}, thin_risk AS (SELECT *, ({_RISK_CASE(0)})::DOUBLE AS cvss FROM thin), counted AS (SELECT repo AS repo_id, count(*) AS total, count(*) FILTER (WHERE severity = 'P0') AS p0, count(*) FILTER (WHERE severity = 'P1') AS p1, max(cvss) AS max_cvss FROM thin_risk GROUP BY repo), named AS (SELECT repo_id, string_agg(concat(layer, '=', findings), ',' ORDER BY layer) AS breakdown FROM bridge WHERE findings IS NOT NULL GROUP BY repo_id) SELECT repo_id, total, p0, p1, max_cvss, CASE WHEN p0 > 0 THEN concat(p0, ' P0') ELSE 'none' END AS threat, breakdown FROM counted LEFT JOIN named USING (repo_id)")
def posture_metrics(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf).withColumn("repo_id", F.concat("repo_id", F.lit("/"), F.substring("fingerprint", 1, 2)))
    out = posture.posture_metrics(rollup.summary(enrich.risk_enrich(f)), posture.posture_bridge(_board(spark, sf)))
    return out.withColumn("breakdown", F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("overall_parity", f"WITH l AS ({SQL['parity_layers']}) SELECT repo_id, (floor(sum(round(score * 10)::BIGINT) / count(score) / 10 * 10 + 0.5) / 10)::DOUBLE AS overall FROM l GROUP BY repo_id")
def overall_parity(spark: S, sf: str) -> D:
    return posture.overall_parity(reports.parity_layers(spark, sf))


_LISTED = "CASE WHEN p_partkey % 3 = 0 THEN array('B6-eval:a', 'PAY-3:f', 'B6-eval:a') WHEN p_partkey % 3 = 1 THEN array('K8S-root:c') ELSE array('none') END"


@query("parity_layer_findings", f"{_FOUND}, l AS (SELECT DISTINCT concat('r', p_partkey % 25) AS repo_id, concat('A', p_partkey % 6 + 1) AS layer, unnest(CASE p_partkey % 3 WHEN 0 THEN ['B6-eval:a', 'PAY-3:f'] WHEN 1 THEN ['K8S-root:c'] ELSE ['none'] END) AS id FROM part) SELECT repo_id, layer, id, severity, count(*) AS n FROM l JOIN finding USING (repo_id, id) GROUP BY ALL")
def parity_layer_findings(spark: S, sf: str) -> D:
    listed = reports_layers(spark, sf)
    return posture.parity_layer_findings(listed, corpus.findings(spark, sf)).groupBy("repo_id", "layer", "id", "severity").agg(F.count("*").alias("n"))


def reports_layers(spark: S, sf: str) -> D:
    """repo_id, layer, finding_ids: what each parity layer of a repository lists, made from the given parts."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.expr("concat('r', p_partkey % 25) AS repo_id"), F.expr("concat('A', p_partkey % 6 + 1) AS layer"), F.expr(_LISTED).alias("ids"))
    return p.groupBy("repo_id", "layer").agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("finding_ids"))


_PATH = "concat(CASE p_partkey % 9 WHEN 0 THEN 'src/' WHEN 1 THEN 'web/node_modules/x/' WHEN 2 THEN '.github/workflows/' WHEN 3 THEN '.idea/' WHEN 4 THEN 'a/b/c/d/' WHEN 5 THEN 'a/b/c/d/e/' WHEN 6 THEN 'builds/' WHEN 7 THEN 'x/build/' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN '.env' ELSE 'f.js' END, p_size)"


@query("file_corpus", f"WITH f AS (SELECT p_brand AS repo_id, {_PATH} AS path, p_name AS content FROM part), d AS (SELECT *, string_split(path, '/')[:-2] AS dirs FROM f) SELECT repo_id, path, content FROM d WHERE len(dirs) <= {files.DEPTH} AND len(list_filter(dirs, lambda x: x IN ({corpus.quoted(files.IGNORED)}) OR (starts_with(x, '.') AND x NOT IN ({corpus.quoted(files.DOTTED)})))) = 0")
def file_corpus(spark: S, sf: str) -> D:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return files.file_corpus(p.select(F.col("p_brand").alias("repo_id"), F.expr(_PATH).alias("path"), F.col("p_name").alias("content")))


_ENV = "concat('# ', p_name, chr(10), '  KEY_', p_size, ' = a=b  ', chr(13), chr(10), chr(10), chr(9), 'BARE', p_partkey % 7, chr(10), '=x', chr(10), '  # late')"


@query("env_keys", "SELECT p_brand AS repo_id, CASE WHEN p_partkey % 2 = 0 THEN 'env' ELSE 'example' END AS kind, unnest([concat('KEY_', p_size), concat('BARE', p_partkey % 7)]) AS key FROM part")
def env_keys(spark: S, sf: str) -> D:
    p = spark.read.parquet(f"{sf}/part.parquet")
    return files.env_keys(p.select(F.col("p_brand").alias("repo_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'env' ELSE 'example' END").alias("kind"), F.expr(_ENV).alias("content")))


@query("env_parity_of_files", "WITH k AS (SELECT p_brand AS repo_id, p_partkey % 2 AS env, unnest([concat('KEY_', p_size), concat('BARE', p_partkey % 7)]) AS key FROM part), g AS (SELECT repo_id, key FROM k WHERE env = 1 AND (repo_id, key) NOT IN (SELECT (repo_id, key) FROM k WHERE env = 0)) SELECT repo_id, count(*) AS missing, array_to_string(list_sort(list(key))[1:8], ',') AS keys FROM g GROUP BY repo_id")
def env_parity_of_files(spark: S, sf: str) -> D:
    keys = env_keys(spark, sf)
    return parity.env_parity(keys.where("kind = 'example'"), keys.where("kind = 'env'"))


@query("previous_run", f"{_FOUND}, o AS (SELECT * FROM finding WHERE seen < 7), l AS (SELECT repo_id, max(seen) AS seen FROM o GROUP BY repo_id) SELECT repo_id, seen, id, severity, fingerprint FROM o JOIN l USING (repo_id, seen)")
def previous_run(spark: S, sf: str) -> D:
    return files.previous_run(corpus.findings(spark, sf), "seen", 7).select("repo_id", "seen", "id", "severity", "fingerprint")


#: What each of the two queries reads of the documents.
_RULES = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>>>"
_RESULTS = "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,partialFingerprints:struct<auditlake:string>,properties:struct<`security-severity`:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>"


def _sarif(spark: S, sf: str, read: str) -> D:
    """SARIF documents, with places and checks, read back."""
    f = enrich.risk_enrich(corpus.findings(spark, sf)).withColumns({"check": F.split_part("id", F.lit(":"), F.lit(1)), "path": F.concat(F.lit("src/"), F.substring("fingerprint", 1, 2), F.lit(".js")), "line": F.col("seen").cast("int"), "title": F.concat(F.lit("found "), "id")})
    return exports.export_sarif(f).select("repo_id", F.explode(F.from_json("doc", read)["runs"]).alias("run"))


@query("sarif_results", f"{_FOUND} SELECT repo_id, split_part(id, ':', 1) AS rule_id, CASE WHEN severity IN ('P0', 'P1') THEN 'error' WHEN severity = 'P2' THEN 'warning' ELSE 'note' END AS level, concat('[', severity, '] found ', id) AS message, printf('%.1f', ({_RISK_CASE(0)})::DOUBLE) AS security_severity, concat('src/', left(fingerprint, 2), '.js') AS uri, CASE WHEN seen > 0 THEN seen::INT END AS start_line, fingerprint FROM finding")
def sarif_results(spark: S, sf: str) -> D:
    """Results of the SARIF export, as its documents give them when they are read again."""
    x = _sarif(spark, sf, _RESULTS).select("repo_id", F.explode("run.results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return x.select("repo_id", F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), F.col("r.properties.security-severity").alias("security_severity"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"), F.col("r.partialFingerprints.auditlake").alias("fingerprint"))


@query("sarif_rules", f"{_FOUND} SELECT DISTINCT repo_id, split_part(id, ':', 1) AS rule_id FROM finding")
def sarif_rules(spark: S, sf: str) -> D:
    """Rules of the SARIF export's documents, once a repository."""
    return _sarif(spark, sf, _RULES).select("repo_id", F.explode("run.tool.driver.rules").alias("r")).select("repo_id", F.col("r.id").alias("rule_id")).distinct()


@query("report_rows", f"{_FOUND}, e AS (SELECT repo_id, substring(severity, 2, 1)::INT AS rank, id, fingerprint, seen FROM finding) SELECT repo_id, rank, id, 0 AS place, concat('src/', left(fingerprint, 2), ':', seen) AS location, concat('password = \"', left(fingerprint, 2), '***', right(fingerprint, 2), '\"') AS excerpt FROM e WHERE seen > 0 UNION ALL SELECT repo_id, rank, id, 1, 'log', NULL FROM e WHERE seen > 0 UNION ALL SELECT repo_id, rank, id, NULL, NULL, NULL FROM e WHERE seen = 0")
def report_rows(spark: S, sf: str) -> D:
    first = F.struct(F.lit("file").alias("type"), F.concat(F.lit("src/"), F.substring("fingerprint", 1, 2)).alias("source"), F.col("seen").cast("string").alias("location"), F.concat(F.lit('password = "'), "fingerprint", F.lit('"')).alias("excerpt"))
    other = F.struct(F.lit("log").alias("type"), F.lit("log").alias("source"), F.lit("").alias("location"), F.lit(None).cast("string").alias("excerpt"))
    return exports.report_rows(corpus.findings(spark, sf).withColumn("evidence", F.when(F.col("seen") > 0, F.array(first, other))))


_KINDS = "CASE event_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'AUTHZ' WHEN 2 THEN 'CMD' WHEN 3 THEN 'WARN' ELSE 'other' END"
_SAID = "concat('user ', user_id, ' token=k', 100000000 + event_id, ' ', event_type)"


@query("run_events", f"WITH e AS (SELECT event_id, {_KINDS} AS kind, concat({_SAID}, CASE WHEN event_id % 5 = 2 AND event_id % 2 = 0 THEN concat('  → target=https://u:secretpw@h', user_id) ELSE '' END) AS m FROM events) SELECT event_id AS ts, kind, {_mask_sql('m')} AS message FROM e WHERE kind != 'other'")
def run_events(spark: S, sf: str) -> D:
    e = spark.read.parquet(f"{sf}/events.parquet")
    target = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://u:secretpw@h"), F.col("user_id").cast("string")))
    return exports.run_events(e.select(F.col("event_id").alias("ts"), F.expr(_KINDS).alias("kind"), F.expr(_SAID).alias("message"), target.alias("target")))


@query("top_evidence", f"WITH {corpus.CODE_SQL.strip()}, h AS (SELECT repo_id, CASE WHEN regexp_matches(line, 'md5') THEN 'hash' ELSE 'exec' END AS \"check\", path, line_no FROM line WHERE regexp_matches(line, 'md5|exec')), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, \"check\" ORDER BY path, line_no) AS k FROM h) SELECT repo_id, \"check\", count(*) AS hits, string_agg(concat(path, ':', line_no), ',' ORDER BY k) FILTER (WHERE k <= 5) AS evidence FROM n GROUP BY ALL")
def top_evidence(spark: S, sf: str) -> D:
    hits = scan.lines(corpus.code_corpus(spark, sf)).where(F.col("line").rlike("md5|exec")).withColumn("check", F.when(F.col("line").contains("md5"), "hash").otherwise("exec"))
    return exports.top_evidence(hits).withColumn("evidence", F.array_join("evidence", ","))


