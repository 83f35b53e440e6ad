"""Registered queries of whole runs: one table of findings, what is made of it, its order, its history; and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import sql as sql_functions
from auditlake.operators import enrich, exports, findings, posture, rollup
from auditlake.operators.module_rules import AI_KEY_TITLES, CHECKS, CLIENT_CODE, CLIENT_FILE, CLIENT_PATH, MODULES, NO_ANCHOR, PAY_KEY, PAY_KEY_CLIENT, PAY_KEY_TEST, RECORDS
from auditlake.plans.modules import _SEEN, _has, _when
from auditlake.plans.queries import _RISK_CASE, _lit, _mask_sql, query
from auditlake.sources import corpus
from auditlake.sources.shared import durable, shared_folder

S, D = SparkSession, DataFrame
_OUT = ["repo_id", "id", "title", "severity", "module", "check", "category", "confidence", "source", "location", "excerpt", "fingerprint"]
_OUT_SQL = 'repo_id, id, title, severity, module, "check", category, confidence, source, location, excerpt, fingerprint'


def _run_sql(only: list[str], where: str = "true") -> str:
    """CTEs ending in run: findings of the application modules."""
    checks = [c for c in CHECKS if c.module in only]
    of = lambda level: [c for c in checks if c.level == level]
    parts, name = [], lambda c: f"{_lit(c.id)} AS \"check\", {_lit(c.severity)} AS severity"
    for bare in (False, True):
        text = "bare" if bare else "content"
        lines = f"(SELECT *, concat(line, ' ', coalesce(lead(line) OVER (PARTITION BY repo_id, path ORDER BY line_no), '')) AS two FROM (SELECT *, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS line_no FROM seen)) JOIN flag USING (repo_id)"
        parts += [f"SELECT repo_id, path, line_no, line, content, {name(c)} FROM {lines} WHERE {_when(c, 'line')}" for c in of("line") if MODULES[c.module].bare == bare]
    for c in of("file"):
        at = f"list_position(list_transform(string_split(content, chr(10)), lambda v: {_has('v', c.at)}), true)" if c.at else "NULL"
        parts.append(f"SELECT repo_id, path, {at} AS line_no, NULL AS line, content, {name(c)} FROM seen JOIN flag USING (repo_id) WHERE {_when(c, 'content')}")
    stands = lambda m: f"on_PRIV AND {_has('bare', 'PII')}" if m == "PRIV" else f"on_{m}"
    for c in of("repo"):
        anchor = f"coalesce((SELECT min(path) FROM seen s WHERE s.repo_id = flag.repo_id AND {stands(c.module)}), {_lit(NO_ANCHOR[c.module])})"
        parts.append(f"SELECT repo_id, {anchor} AS path, NULL AS line_no, NULL AS line, '' AS content, {name(c)} FROM flag WHERE {_when(c, '')}")
    values = ", ".join(f"({_lit(c.id)}, {_lit(c.severity)}, {', '.join(map(_lit, RECORDS[c.id]))}, {_lit(c.confidence)}, {_lit(c.level)}, {_lit(c.module)})" for c in checks)
    client = f"(regexp_matches(path, {_lit(CLIENT_PATH)}) OR regexp_matches(content, {_lit(CLIENT_CODE)}) OR regexp_matches(path, {_lit(CLIENT_FILE)}))"
    live = f"({_has('line', 'KEY_LIVE')} OR NOT {_has('line', 'KEY_TEST')})"
    pay = f"CASE WHEN {live} AND {client} THEN {_lit(PAY_KEY_CLIENT)} WHEN {live} THEN {_lit(PAY_KEY)} ELSE {_lit(PAY_KEY_TEST)} END"
    keys = ", ".join(f"CASE WHEN regexp_matches(line, {_lit(p)}) THEN {_lit(n)} END" for p, n in AI_KEY_TITLES.items())
    titles = f"CASE WHEN \"check\" = 'PAY-1' THEN [{pay}] WHEN \"check\" = 'AI-3' THEN list_filter([{keys}], lambda v: v IS NOT NULL) ELSE [title] END"
    excerpt = _mask_sql(r"CASE WHEN words = '' THEN substring(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 160) ELSE words END")
    return f"""{_SEEN.replace("FROM bared)", f"FROM bared WHERE {where})")}, record("check", severity, head, plain, category, words, confidence, level, module) AS (VALUES {values}),
hit AS ({' UNION ALL '.join(parts)}),
told AS (SELECT *, unnest({titles.replace('[title]', '[plain]')}) AS title FROM hit JOIN record USING ("check", severity)),
shown AS (SELECT *, {excerpt} AS excerpt, path AS source, line_no::VARCHAR AS location, CASE level WHEN 'repo' THEN head WHEN 'file' THEN concat(head, ':', path) ELSE concat(head, ':', path, ':', line_no) END AS id FROM told),
printed AS (SELECT *, substring(sha1(concat_ws('|', module, "check", title, concat(source, '|', trim(regexp_replace(excerpt, '\\s+', ' ', 'g'))))), 1, 16) AS fingerprint FROM shown),
run AS (SELECT {_OUT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, module, fingerprint ORDER BY source, line_no NULLS FIRST, id) AS nth FROM printed) WHERE nth = 1)"""


_APP = list(MODULES)
_SOME = ["ACCESS", "API", "PAY"]


def _run(spark: S, sf: str, only: list[str]) -> D:
    return findings.run_scan(corpus.app_corpus(spark, sf), only)


@query("run_scan", f"{_run_sql(_APP)} SELECT {_OUT_SQL} FROM run")
def run_scan(spark: S, sf: str) -> D:
    """All application modules, as one table of findings."""
    return _run(spark, sf, _APP).select(*_OUT)


@query("run_scan_subset", f"{_run_sql(_SOME)} SELECT {_OUT_SQL} FROM run")
def run_scan_subset(spark: S, sf: str) -> D:
    return _run(spark, sf, _SOME).select(*_OUT)


@query("run_scan_all")
def run_scan_all(spark: S, sf: str) -> D:
    """With rules whose validators SQL words differently, infrastructure files, handlers' braces, and .env files."""
    return findings.run_scan(corpus.app_corpus(spark, sf).unionByName(corpus.code_corpus(spark, sf))).select(*_OUT)


@query(
    "run_scan_scores",
    f"""{_run_sql(_APP)}, active AS (SELECT * FROM run WHERE "check" != 'API-1'), risky AS (SELECT *, ({_RISK_CASE(0)})::DOUBLE AS cvss FROM active),
cost AS (SELECT repo_id, module, count(*) AS findings, count(*) FILTER (WHERE severity = 'P0') AS p0, max(cvss) AS max_cvss, sum(CASE severity WHEN 'P0' THEN 5 WHEN 'P1' THEN 2.5 WHEN 'P2' THEN 1 ELSE 0.25 END) AS c FROM risky GROUP BY repo_id, module)
SELECT repo_id, module, (floor(greatest(0, 10 - c) * 10 + 0.5) / 10)::DOUBLE AS score, findings, p0, max_cvss FROM cost""",
)
def run_scan_scores(spark: S, sf: str) -> D:
    """A run, its risks, waivers and scoreboard."""
    waivers = spark.createDataFrame([(1, None, "API-1", None, "legacy views", "2099-01-01"), (2, None, "PAY-5", None, "expired", "2001-01-01")], "ordinal int, fingerprint string, check string, id string, reason string, expires string")
    found = enrich.risk_enrich(_run(spark, sf, _APP))
    active = durable(enrich.waiver_partition(found, waivers, "2024-06-01", ["repo_id", "module", "fingerprint", "check", "id"]).where("reason IS NULL"))
    board = rollup.scoreboard(active).where("findings > 0").select("repo_id", "module", "score", "findings", "p0")
    return board.join(active.groupBy("repo_id", "module").agg(F.max("cvss").alias("max_cvss")), ["repo_id", "module"])


@query(
    "run_scan_delta",
    f"""WITH now AS ({_run_sql(_SOME)} SELECT * FROM run), past AS ({_run_sql(_SOME, "length(path) % 3 != 0")} SELECT * FROM run)
SELECT repo_id, id, fingerprint, 'fixed' AS change FROM past WHERE (repo_id, fingerprint) NOT IN (SELECT (repo_id, fingerprint) FROM now)
UNION ALL SELECT repo_id, id, fingerprint, CASE WHEN (repo_id, fingerprint) IN (SELECT (repo_id, fingerprint) FROM past) THEN 'persisting' ELSE 'introduced' END FROM now""",
)
def run_scan_delta(spark: S, sf: str) -> D:
    """A run over all files against one before some of them were there."""
    files = corpus.app_corpus(spark, sf)
    # each run is asked for several times, so it is stored
    before, now = durable(findings.run_scan(files.where("length(path) % 3 != 0"), _SOME)), durable(findings.run_scan(files, _SOME))
    return enrich.delta(before, now).select("repo_id", "id", "fingerprint", "change")


def _prompt_sql() -> str:
    words = {"places": "concat('  - ', place)"}
    cell = lambda x: words.get(x, '"check"' if x == "check" else x)
    lines = []
    for need, form in exports.PROMPT:
        if not need:
            parts = re.split(r"\{(\w+)\}", form)
            lines.append("concat(" + ", ".join(cell(x) if i % 2 else _lit(x) for i, x in enumerate(parts)) + ")")
    return f"array_to_string([{', '.join(lines)}], chr(10))"


@query(
    "prompts",
    f"""{_run_sql(_SOME)}, risky AS (SELECT *, ({_RISK_CASE(0)})::DOUBLE AS cvss, {_RISK_CASE(1)} AS ex, concat(source, CASE WHEN location IS NOT NULL THEN concat(':', location) ELSE '' END) AS place FROM run WHERE severity IN ('P0', 'P1') AND module IN ('ACCESS', 'PAY')),
handed AS (SELECT *, printf('CVSS %.1f / exploitability %s', cvss, ex) AS risk FROM risky)
SELECT repo_id, id, fingerprint, severity, title, risk, category, "check", [place] AS locations, confidence, {_prompt_sql()} AS text FROM handed""",
)
def prompts(spark: S, sf: str) -> D:
    """Grave findings of two modules as tasks to hand over."""
    found = exports.prompt_select(enrich.risk_enrich(_run(spark, sf, _SOME)), ["ACCESS", "PAY"])
    return exports.prompts(found)


@query("summary_scores", f"WITH {corpus.findings_sql()}, mod AS (SELECT repo_id, module, floor(greatest(0, 10 - sum(CASE severity WHEN 'P0' THEN 5 WHEN 'P1' THEN 2.5 WHEN 'P2' THEN 1 ELSE 0.25 END)) * 10 + 0.5)::BIGINT AS tenths FROM finding GROUP BY ALL), score AS (SELECT repo_id, (floor(sum(tenths) / count(*) + 0.5) / 10)::DOUBLE AS overall_score FROM mod GROUP BY repo_id), total AS (SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE severity = 'P0') AS p0 FROM finding GROUP BY repo_id), parity AS (SELECT concat('r', c_custkey % 40) AS repo_id, (floor(sum(c_nationkey % 10 * 10) / count(*) + 0.5) / 10)::DOUBLE AS parity_score FROM customer WHERE c_nationkey % 10 != 9 GROUP BY ALL) SELECT coalesce(total.repo_id, parity.repo_id) AS repo_id, coalesce(total, 0) AS total, coalesce(p0, 0) AS p0, overall_score, parity_score FROM total LEFT JOIN score USING (repo_id) FULL JOIN parity ON parity.repo_id = total.repo_id")
def summary_scores(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf).withColumn("cvss", F.lit(1.0))
    layers = spark.read.parquet(f"{sf}/customer.parquet").where("c_nationkey % 10 != 9").select(F.expr("concat('r', c_custkey % 40) AS repo_id"), (F.col("c_nationkey") % 10).cast("double").alias("score"))
    return posture.summary_scores(f, rollup.scoreboard(f), layers).select("repo_id", "total", "p0", "overall_score", "parity_score")


# --- order, history
_FOUND = f"WITH {corpus.findings_sql()}"


@query("rank_findings", f"{_FOUND} SELECT repo_id, id, fingerprint, severity, row_number() OVER (ORDER BY severity, repo_id, id, fingerprint) AS rank FROM finding")
def rank_findings(spark: S, sf: str) -> D:
    return findings.rank_findings(corpus.findings(spark, sf).select("repo_id", "id", "fingerprint", "severity"), ("repo_id", "id", "fingerprint"))


def _history(spark: S, sf: str) -> tuple[D, D]:
    """Two runs of a history, the second written twice, and the changes between them."""
    x = corpus.findings(spark, sf)
    runs = {"1": x.where("seen != 0"), "2": x.where("seen != 1")}
    changes = durable(enrich.delta(runs["1"], runs["2"]).select("repo_id", "severity", "change"))  # asked for with each run, and for what moved
    path = f"{shared_folder(spark)}/history-{spark.sparkContext.applicationId}-{id(x)}"
    rows = {}
    for run, f in runs.items():
        overall = rollup.overall_score(rollup.scoreboard(f))
        scores = overall.select("repo_id", "overall_score", F.when(F.col("repo_id") != "r3", F.col("overall_score") / 2).alias("parity_score"))
        rows[run] = durable(exports.history_runs(f, changes if run == "2" else changes.limit(0), scores, run, F.lit(f"2024-01-0{run}")))
    for run in ("1", "2", "2"):
        exports.append_history(rows[run], path)
    return spark.read.parquet(path).withColumn("run", F.col("run").cast("string")), changes


_RUNS_SQL = f"""{_FOUND}, r AS (SELECT '1' AS run, * FROM finding WHERE seen != 0 UNION ALL SELECT '2', * FROM finding WHERE seen != 1),
mod AS (SELECT run, repo_id, module, floor(greatest(0, 10 - sum(CASE severity WHEN 'P0' THEN 5 WHEN 'P1' THEN 2.5 WHEN 'P2' THEN 1 ELSE 0.25 END)) * 10 + 0.5)::BIGINT AS tenths FROM r GROUP BY ALL),
score AS (SELECT run, repo_id, (floor(sum(tenths) / count(*) + 0.5) / 10)::DOUBLE AS overall_score FROM mod GROUP BY ALL),
total AS (SELECT run, repo_id, count(*) AS total FROM r GROUP BY ALL),
b AS (SELECT DISTINCT repo_id, fingerprint FROM r WHERE run = '1'), n AS (SELECT DISTINCT repo_id, fingerprint FROM r WHERE run = '2'),
moved AS (SELECT repo_id, count(*) FILTER (WHERE c = 'fixed') AS fixed, count(*) FILTER (WHERE c = 'introduced') AS introduced, count(*) FILTER (WHERE c = 'persisting') AS persisting, count(*) FILTER (WHERE c = 'persisting' AND severity = 'P0') AS still_p0 FROM (
  SELECT repo_id, severity, 'fixed' AS c FROM r WHERE run = '1' AND (repo_id, fingerprint) NOT IN (SELECT (repo_id, fingerprint) FROM n)
  UNION ALL SELECT repo_id, severity, CASE WHEN (repo_id, fingerprint) IN (SELECT (repo_id, fingerprint) FROM b) THEN 'persisting' ELSE 'introduced' END FROM r WHERE run = '2') GROUP BY repo_id)"""


@query("history_append", f"{_RUNS_SQL} SELECT s.run, s.repo_id, overall_score, CASE WHEN s.repo_id != 'r3' THEN overall_score / 2 END AS parity_score, total, CASE WHEN s.run = '2' THEN fixed ELSE 0 END AS fixed FROM score s JOIN total USING (run, repo_id) JOIN moved USING (repo_id)")
def history_append(spark: S, sf: str) -> D:
    """A run that is written twice is there once."""
    return _history(spark, sf)[0].select("run", "repo_id", "overall_score", "parity_score", "total", "fixed")


@query("delta_of_runs", f"{_RUNS_SQL} SELECT a.repo_id, p.overall_score AS overall_before, a.overall_score AS overall_after, round(a.overall_score - p.overall_score, 1) AS overall_moved, CASE WHEN a.repo_id = 'r3' THEN 'unknown' WHEN a.overall_score > p.overall_score THEN 'up' WHEN a.overall_score < p.overall_score THEN 'down' ELSE 'same' END AS parity_trend, fixed, introduced, persisting, still_p0 FROM score a JOIN score p USING (repo_id) JOIN moved USING (repo_id) WHERE a.run = '2' AND p.run = '1'")
def delta_of_runs(spark: S, sf: str) -> D:
    runs, changes = _history(spark, sf)
    return rollup.delta_of_runs(runs, changes, "1", "2").select("repo_id", "overall_before", "overall_after", "overall_moved", "parity_trend", "fixed", "introduced", "persisting", "still_p0")


# --- SQL functions
_TEXTS = "SELECT doc_id, length(shown) AS masked, sha1(shown) AS masked_sha1, looks_like_secret(text) AS secret, sha1(strip_comments(text)) AS bare_sha1, extract_cves(text) AS cves, finding_fingerprint(lang, source, 't', array(left(normalize_ws(text), 200))) AS fingerprint FROM (SELECT *, mask_secrets(text) AS shown FROM {of})"


@query(
    "sql_functions",
    f"""SELECT doc_id, length({_mask_sql('text')}) AS masked, sha1({_mask_sql('text')}) AS masked_sha1, {' OR '.join(f'regexp_matches(text, {_lit(p)})' for p in sql_functions.LOOKS)} AS secret,
sha1(regexp_replace(regexp_replace(regexp_replace(text, '/\\*[\\s\\S]*?\\*/', ' ', 'g'), '(^|[^:])//[^\\n]*', '\\1', 'g'), '(^|\\s)#[^\\n]*', '\\1', 'g')) AS bare_sha1, list_distinct(list_transform(regexp_extract_all(text, '(?i)(CVE-\\d{{4}}-\\d{{3,7}})', 1), lambda c: upper(c))) AS cves,
substring(sha1(concat_ws('|', lang, source, 't', left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200))), 1, 16) AS fingerprint FROM documents""",
)
def sql_functions_query(spark: S, sf: str) -> D:
    """The functions of a finding called in spark.sql on whole texts."""
    sql_functions.register(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("texts_of_sql_functions")
    return spark.sql(_TEXTS.format(of="texts_of_sql_functions"))

