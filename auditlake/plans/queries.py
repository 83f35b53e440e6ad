"""The engine's registered queries over the given tables, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions import text as t
from auditlake.operators import enrich, exports, observed, rollup, scan
from auditlake.operators import rules as r
from auditlake.sources import corpus
from auditlake.sources.corpus import CODE_SQL, quoted
from auditlake.streaming import streams

S, D = SparkSession, DataFrame
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- masks in SQL: the same steps, each match through its own expression
def _mask_sql(x: str) -> str:
    """All masks of an expression."""
    key = t.KEY_VALUE
    x = f"regexp_replace({x}, {_lit(t.URL_PASSWORD)}, '\\1***\\3', 'g')"
    x = f"regexp_replace({x}, {_lit(key)}, '\\1\\2\\3***\\4', 'g')"
    for p in (t.JWT, t.AWS_ID, t.PROVIDER_TOKEN, t.LONG_HEX):
        found = f"regexp_extract_all(v, {_lit(p)})"
        ends = "concat(z[1], CASE WHEN z[2] IS NULL THEN '' ELSE concat(left(z[2], 2), '***', right(z[2], 2)) END)"
        x = f"list_transform([{x}], lambda v: CASE WHEN regexp_matches(v, {_lit(p)}) THEN array_to_string(list_transform(list_zip(string_split_regex(v, {_lit(p)}), {found}), lambda z: {ends}), '') ELSE v END)[1]"
    return x


def _rules_sql(rules: list[r.Rule], width: int, masks: int, cap: str = "cap") -> str:
    values = ", ".join(f"({i}, {_lit(x.id)}, {_lit(x.check)}, {_lit(x.module)}, {_lit(x.severity)}, {_lit(x.confidence)}, {_lit(x.title)}, {x.cap})" for i, x in enumerate(rules))
    gate = lambda x: (f" AND regexp_matches(path, {_lit(x.include)})" if x.include else "") + (f" AND NOT regexp_matches(path, {_lit(x.exclude)})" if x.exclude else "")
    hits = " UNION ALL ".join(f"SELECT {i} AS n, repo_id, path, line_no, line FROM line WHERE regexp_matches(line, {_lit(x.pattern)}){gate(x)}" for i, x in enumerate(rules))
    excerpt = f"substring(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), 1, {width})"
    for _ in range(masks):
        excerpt = _mask_sql(excerpt)
    return f"""
rule(n, rule_id, "check", module, severity, confidence, title, cap) AS (VALUES {values}),
hits AS ({hits}),
hit AS (SELECT * FROM hits JOIN rule USING (n)),
few AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, rule_id ORDER BY line_no) AS place FROM hit),
cut AS (SELECT *, {excerpt} AS excerpt FROM few WHERE place <= {cap}),
named AS (SELECT *, substring(sha1(concat_ws('|', module, "check", title, concat(path, '|', trim(regexp_replace(excerpt, '\\s+', ' ', 'g'))))), 1, 16) AS fingerprint FROM cut),
first AS (SELECT *, row_number() OVER (PARTITION BY repo_id, fingerprint ORDER BY path, line_no) AS nth FROM named)"""


#: Rules whose validators SQL words differently are left to tests.
_PLAIN = [x for x in r.SAST if x.validate is None]
_CODE = f"WITH {CODE_SQL}"
_CODE_SCANNED = f"WITH {CODE_SQL.replace('line AS (', 'whole AS (')}, line AS (SELECT * FROM whole WHERE regexp_matches(path, {_lit(r.CODE_FILE)}) AND NOT regexp_matches(path, {_lit(r.NOT_SCANNED)}))"
_COLUMNS = ["repo_id", "path", "line_no", "rule_id", "module", "check", "severity", "confidence", "excerpt", "fingerprint"]
_COLUMNS_SQL = 'repo_id, path, line_no, rule_id, module, "check", severity, confidence, excerpt, fingerprint'


def _code(spark: S, sf: str) -> D:
    return scan.code_files(corpus.code_corpus(spark, sf))


def _lines(spark: S, sf: str) -> D:
    return scan.lines(_code(spark, sf))


@query("rule_scan", f"{_CODE_SCANNED}, {_rules_sql(_PLAIN, 200, 2)} SELECT {_COLUMNS_SQL} FROM first WHERE nth = 1")
def rule_scan(spark: S, sf: str) -> D:
    return scan.rule_scan(_code(spark, sf), _PLAIN).select(*_COLUMNS)


@query("rule_scan_capped", f"{_CODE_SCANNED}, {_rules_sql(_PLAIN, 200, 2, '1')} SELECT {_COLUMNS_SQL} FROM first WHERE nth = 1")
def rule_scan_capped(spark: S, sf: str) -> D:
    return scan.rule_scan(_code(spark, sf), _PLAIN, cap=1).select(*_COLUMNS)


@query("rule_scan_all")
def rule_scan_all(spark: S, sf: str) -> D:
    """With the two rules that have validators."""
    return scan.rule_scan(_code(spark, sf), r.SAST).select(*_COLUMNS)


@query("rule_match_counts", f"{_CODE_SCANNED}, {_rules_sql(_PLAIN, 200, 0)} SELECT repo_id, rule_id, count(*) AS hits, count(DISTINCT path) AS files FROM hit GROUP BY ALL")
def rule_match_counts(spark: S, sf: str) -> D:
    hits = scan.described(scan.file_matches(_code(spark, sf), _PLAIN), _PLAIN)
    return hits.groupBy("repo_id", "rule_id").agg(F.count("*").alias("hits"), F.countDistinct("path").alias("files"))


@query("cloud_scan", f"{_CODE}, {_rules_sql(r.CLOUD, 160, 1)} SELECT {_COLUMNS_SQL} FROM first WHERE nth = 1")
def cloud_scan(spark: S, sf: str) -> D:
    return scan.cloud_scan(corpus.code_corpus(spark, sf)).select(*_COLUMNS)


@query("code_file_filter", f"{_CODE} SELECT repo_id, count(*) AS files FROM code WHERE regexp_matches(path, {_lit(r.CODE_FILE)}) AND NOT regexp_matches(path, {_lit(r.NOT_SCANNED)}) GROUP BY repo_id")
def code_file_filter(spark: S, sf: str) -> D:
    return scan.code_files(corpus.code_corpus(spark, sf)).groupBy("repo_id").agg(F.count("*").alias("files"))


@query(
    "card_data_scan",
    f"""{_CODE}, held AS (SELECT repo_id, path, line_no, regexp_matches(line, {_lit(r.CVV)})::INT AS c, regexp_matches(line, {_lit(r.PAN)})::INT AS p FROM line WHERE regexp_matches(path, {_lit(r.CODE_OR_SCHEMA)}) AND NOT regexp_matches(path, {_lit(r.CARD_SKIP)})),
few AS (SELECT *, coalesce(sum(c + p) OVER (PARTITION BY repo_id ORDER BY path, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM held WHERE c + p > 0)
SELECT repo_id, path, line_no, 'cvv' AS kind FROM few WHERE n < 50 AND c = 1 UNION ALL SELECT repo_id, path, line_no, 'pan' FROM few WHERE n < 50 AND p = 1""",
)
def card_data_scan(spark: S, sf: str) -> D:
    return scan.card_data_scan(scan.lines(corpus.code_corpus(spark, sf)))


def _history_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT repo_id, 'c' || line_no AS commit, {_lit(n)} AS pattern, trim(line) AS line FROM line WHERE regexp_matches(line, {_lit(p)}) AND NOT regexp_matches(regexp_extract(line, {_lit(f'({p})')}, 1), {_lit(r.PLACEHOLDER)})" for n, p in r.HISTORY)
    return f"{_CODE}, found AS (SELECT DISTINCT * FROM ({parts})) SELECT repo_id, commit, pattern, {_mask_sql('substring(line, 1, 160)')} AS excerpt FROM found"


@query("history_secrets", _history_sql())
def history_secrets(spark: S, sf: str) -> D:
    added = scan.lines(corpus.code_corpus(spark, sf)).select("repo_id", F.concat(F.lit("c"), F.col("line_no").cast("string")).alias("commit"), "line")
    return scan.history_secrets(added)


@query("high_entropy_secret")
def high_entropy_secret(spark: S, sf: str) -> D:
    return _lines(spark, sf).where(t.high_entropy_secret(F.col("line"))).select("repo_id", "path", "line_no")


@query("mask_documents", f"SELECT doc_id, md5({_mask_sql('text')}) AS masked_md5 FROM documents WHERE text IS NOT NULL")
def mask_documents(spark: S, sf: str) -> D:
    return spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.md5(t.mask_secrets(F.col("text"))).alias("masked_md5"))


_LOOKS = " OR ".join(f"regexp_matches(text, {_lit(p)})" for p in (rf"(?i){t.SECRET_KEY}\s*[:=]\s*[\"']?[^\s\"']{{4,}}", t.JWT, t.AWS_ID, t.PROVIDER_TOKEN, t.LONG_HEX, t.URL_PASSWORD))


@query("looks_like_secret_by_source", f"SELECT source, count(*) AS docs, count(*) FILTER (WHERE {_LOOKS}) AS secrets FROM documents GROUP BY source")
def looks_like_secret_by_source(spark: S, sf: str) -> D:
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.count("*").alias("docs"), F.count_if(t.looks_like_secret(F.col("text"))).alias("secrets"))


@query("entropy_by_doc", "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0), n AS (SELECT doc_id, ch, count(*) AS k FROM c GROUP BY ALL), s AS (SELECT doc_id, k / sum(k) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(sum(-p * log2(p)), 5) AS entropy FROM s GROUP BY doc_id")
def entropy_by_doc(spark: S, sf: str) -> D:
    return spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") > 0).select("doc_id", F.round(t.text_entropy("text"), 5).alias("entropy"))


@query("comment_strip_pages", r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '/\*[\s\S]*?\*/', ' ', 'g'), '(^|[^:])//[^\n]*', '\1', 'g'), '(^|\s)#[^\n]*', '\1', 'g')) AS n_chars FROM pages")
def comment_strip_pages(spark: S, sf: str) -> D:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.length(t.strip_comments(F.col("html"))).cast("long").alias("n_chars"))


# --- signals and absence
SIGNALS = {
    "login": (r"(?i)/(login|signin|sign-in)|passport\.|authenticate\(", True),
    "mfa": (r"(?i)\b(totp|mfa|2fa|otplib|speakeasy|webauthn)\b", True),
    "brute_force": (r"(?i)rate-?limit|slow-?down|lockout|throttle", True),
    "hashing": (r"(?i)\b(bcrypt|argon2|scrypt|pbkdf2)\b", True),
    "strength": (r"(?i)zxcvbn|passwordPolicy|password-validator|minLength", True),
    "api": (r"(?i)\b(app|router)\.(get|post|put|patch|delete)\(", True),
    "rate_limit": (r"(?i)rate-?limit|throttle", True),
    "csrf": (r"(?i)csrf|xsrf|samesite", True),
    "headers": (r"(?i)helmet|strict-transport-security|x-frame-options", True),
    "pii": (r"(?i)\b(email|phone|address|birth_?date|first_?name)\b", True),
    "erasure": (r"(?i)delete_?account|erase|anonymi[sz]e|gdpr", True),
    "audit": (r"(?i)audit_?log|auditTrail", True),
}
ABSENT = [
    ("AUTH-1", "P2", "login", "mfa"), ("AUTH-5", "P2", "login", "brute_force"), ("AUTH-6", "P2", "hashing", "strength"), ("API-2", "P2", "api", "rate_limit"),
    ("WEB-1", "P1", "api", "csrf"), ("WEB-2", "P2", "api", "headers"), ("PRIV-4", "P2", "pii", "erasure"), ("PRIV-5", "P2", "pii", "audit"),
]
_BARE = r"regexp_replace(regexp_replace(regexp_replace(array_to_string(body, chr(10)), '/\*[\s\S]*?\*/', ' ', 'g'), '(^|[^:])//[^\n]*', '\1', 'g'), '(^|\s)#[^\n]*', '\1', 'g')"
_FLAGS = f"{_CODE}, bare AS (SELECT repo_id, {_BARE} AS c FROM code), flag AS (SELECT repo_id, {', '.join(f'bool_or(regexp_matches(c, {_lit(p)})) AS {n}' for n, (p, _) in SIGNALS.items())} FROM bare GROUP BY repo_id)"


def _repos(spark: S, sf: str) -> D:
    """The code corpus in small repositories, so that some lack what others have."""
    return corpus.code_corpus(spark, sf).withColumn("repo_id", F.concat("repo_id", F.lit("/"), F.regexp_extract("path", r"^src/(m\d+)/", 1)))


_SMALL = _FLAGS.replace("SELECT p_brand AS repo_id", "SELECT concat(p_brand, '/m', p_partkey % 50) AS repo_id")


@query("signal_flags", f"{_SMALL} SELECT * FROM flag")
def signal_flags(spark: S, sf: str) -> D:
    return scan.signal_flags(_repos(spark, sf), SIGNALS)


@query("absence_findings", f"{_SMALL} " + " UNION ALL ".join(f"SELECT repo_id, {_lit(n)} AS \"check\", {_lit(v)} AS severity FROM flag WHERE {s} AND NOT {c}" for n, v, s, c in ABSENT))
def absence_findings(spark: S, sf: str) -> D:
    return scan.absence_findings(scan.signal_flags(_repos(spark, sf), SIGNALS), ABSENT)


# --- enrichment and roll-ups over findings at volume
_FOUND = f"WITH {corpus.findings_sql()}"
_RISK_CASE = lambda k: "CASE " + " ".join(f"WHEN starts_with(id, {_lit(p)}) THEN {(v, _lit(w))[k]}" for p, v, w in r.RISK) + " " + " ".join(f"WHEN severity = '{s}' THEN {(v, _lit(w))[k]}" for s, (v, w) in r.RISK_BY_SEVERITY.items()) + " END"


@query("risk_enrich", f"{_FOUND}, e AS (SELECT *, ({_RISK_CASE(0)})::DOUBLE AS cvss, {_RISK_CASE(1)} AS exploitability FROM finding) SELECT repo_id, id, severity, cvss, exploitability, count(*) AS n FROM e GROUP BY ALL")
def risk_enrich(spark: S, sf: str) -> D:
    return enrich.risk_enrich(corpus.findings(spark, sf)).groupBy("repo_id", "id", "severity", "cvss", "exploitability").agg(F.count("*").alias("n"))


@query("delta", f"{_FOUND}, b AS (SELECT * FROM finding WHERE seen != 0), n AS (SELECT * FROM finding WHERE seen != 1), ids AS (SELECT DISTINCT repo_id, fingerprint FROM b), nids AS (SELECT DISTINCT repo_id, fingerprint FROM n) SELECT repo_id, severity, change, count(*) AS n FROM (SELECT repo_id, severity, 'fixed' AS change FROM b ANTI JOIN nids USING (repo_id, fingerprint) UNION ALL SELECT repo_id, severity, 'introduced' FROM n ANTI JOIN ids USING (repo_id, fingerprint) UNION ALL SELECT repo_id, severity, 'persisting' FROM n SEMI JOIN ids USING (repo_id, fingerprint)) GROUP BY ALL")
def delta(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf)
    return rollup.delta_summary(enrich.delta(f.where("seen != 0"), f.where("seen != 1"))).select("repo_id", "severity", "change", "n")


_COST = "sum(CASE severity WHEN 'P0' THEN 5.0 WHEN 'P1' THEN 2.5 WHEN 'P2' THEN 1.0 ELSE 0.25 END)"
# a thin cut of findings, by key, so that scores are not all zero
_BOARD = f"{_FOUND}, thin AS (SELECT *, repo_id || '/' || substring(fingerprint, 1, 2) AS repo FROM finding), repos AS (SELECT DISTINCT repo FROM thin), mods AS (SELECT unnest([{quoted(r.MODULES)}]) AS module), agg AS (SELECT repo, module, count(*) AS n, count(*) FILTER (WHERE severity = 'P0') AS p0, count(*) FILTER (WHERE severity = 'P1') AS p1, {_COST} AS cost FROM thin GROUP BY ALL), board AS (SELECT repos.repo AS repo_id, mods.module, CASE WHEN n IS NOT NULL OR mods.module IN ('A', 'B') THEN floor(greatest(0, 10 - coalesce(cost, 0)) * 10 + 0.5) / 10 END::DOUBLE AS score, coalesce(n, 0) AS findings, coalesce(p0, 0) AS p0, coalesce(p1, 0) AS p1 FROM repos, mods LEFT JOIN agg ON agg.repo = repos.repo AND agg.module = mods.module)"


def _board(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf).withColumn("repo_id", F.concat("repo_id", F.lit("/"), F.substring("fingerprint", 1, 2)))
    return rollup.scoreboard(f, ["A", "B"])


@query("scoreboard", f"{_BOARD} SELECT * FROM board")
def scoreboard(spark: S, sf: str) -> D:
    return _board(spark, sf)


@query("overall_score", f"{_BOARD} SELECT repo_id, floor(sum(round(score * 10)::BIGINT) / count(score) + 0.5) / 10 AS overall_score FROM board GROUP BY repo_id")
def overall_score(spark: S, sf: str) -> D:
    return rollup.overall_score(_board(spark, sf))


@query("posture_status", f"{_BOARD} SELECT repo_id, module, CASE WHEN score IS NULL THEN 'optional' WHEN p0 > 0 THEN 'open' WHEN p1 > 0 OR score < 8 THEN 'partial' ELSE 'active' END AS status FROM board")
def posture_status(spark: S, sf: str) -> D:
    return rollup.posture_status(_board(spark, sf))


@query("measured_posture_score", f"{_BOARD}, st AS (SELECT repo_id, length(module) AS w, CASE WHEN score IS NULL THEN 0 WHEN p0 > 0 THEN 0 WHEN p1 > 0 OR score < 8 THEN 0.6 ELSE 1 END AS f FROM board) SELECT repo_id, floor(sum(w * f) / sum(w) * 100 + 0.5)::BIGINT AS posture FROM st GROUP BY repo_id")
def measured_posture_score(spark: S, sf: str) -> D:
    return rollup.measured_posture_score(rollup.posture_status(_board(spark, sf)), F.length("module"))


@query("severity_counts", f"{_FOUND} SELECT repo_id, {', '.join(f'count(*) FILTER (WHERE severity = {_lit(s)}) AS {s.lower()}' for s in rollup.PENALTY)} FROM finding GROUP BY repo_id")
def severity_counts(spark: S, sf: str) -> D:
    return rollup.severity_counts(corpus.findings(spark, sf))


@query("summary", f"{_FOUND} SELECT repo_id, count(*) AS total, {', '.join(f'count(*) FILTER (WHERE severity = {_lit(s)}) AS {s.lower()}' for s in rollup.PENALTY)}, max(({_RISK_CASE(0)})::DOUBLE) AS max_cvss FROM finding GROUP BY repo_id")
def summary(spark: S, sf: str) -> D:
    return rollup.summary(enrich.risk_enrich(corpus.findings(spark, sf)))


@query("fail_gate", f"{_BOARD} SELECT repo AS repo_id, bool_or(substring(severity, 2, 1)::INT <= 0) AS failed FROM thin GROUP BY repo")
def fail_gate(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf).withColumn("repo_id", F.concat("repo_id", F.lit("/"), F.substring("fingerprint", 1, 2)))
    return rollup.fail_gate(f, 0)


@query("fingerprint_dedup", f"{_FOUND} SELECT repo_id, fingerprint, min(severity) AS severity FROM finding GROUP BY ALL")
def fingerprint_dedup(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf).withColumn("path", F.col("severity")).withColumn("line_no", F.lit(1))
    return scan.dedup_fingerprint(f).select("repo_id", "fingerprint", "severity")


@query("prompt_select", f"{_FOUND} SELECT repo_id, id, severity, count(*) AS n FROM finding WHERE module IN ('B', 'PAY') AND severity IN ('P0', 'P1') AND fingerprint < '8' GROUP BY ALL")
def prompt_select(spark: S, sf: str) -> D:
    f = corpus.findings(spark, sf)
    return exports.prompt_select(f, ["B", "PAY"], fingerprints=f.where("fingerprint < '8'")).groupBy("repo_id", "id", "severity").agg(F.count("*").alias("n"))


# --- observations
_SEEN = f"WITH {corpus.SEEN_SQL}"


@query("exposed_files", f"{_SEEN} SELECT * FROM (SELECT page_id, path, CASE " + " ".join(f"WHEN path = '{p}' AND regexp_matches(body, {_lit(b)}){' AND kind NOT LIKE ' + _lit('%html%') if plain else ''} THEN '{s}'" for p, s, b, plain in observed.EXPOSED) + " END AS severity FROM seen WHERE status = 200) WHERE severity IS NOT NULL")
def exposed_files(spark: S, sf: str) -> D:
    return observed.exposed_files(corpus.responses(spark, sf))


@query("missing_headers", " UNION ALL ".join(f"SELECT page_id, '{h}' AS header, '{s}' AS severity FROM pages WHERE page_id % {n} = 0" for h, s, n in (("strict-transport-security", "P1", 2), ("content-security-policy", "P1", 3), ("x-content-type-options", "P2", 5), ("x-frame-options", "P2", 4))))
def missing_headers(spark: S, sf: str) -> D:
    return observed.missing_headers(corpus.responses(spark, sf))


@query("cookie_flags", "WITH c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'session' ELSE 'theme' END AS cookie, concat_ws(',', CASE WHEN page_id % 2 != 0 THEN 'HttpOnly' END, CASE WHEN page_id % 5 = 0 THEN 'Secure' END, CASE WHEN page_id % 4 = 0 THEN 'SameSite' END) AS missing FROM pages) SELECT *, CASE WHEN cookie = 'session' THEN 'P1' ELSE 'P2' END AS severity FROM c WHERE missing != ''")
def cookie_flags(spark: S, sf: str) -> D:
    return observed.cookie_flags(corpus.responses(spark, sf))


@query("open_admin", f"{_SEEN}, root AS (SELECT host, arg_min(body, page_id) AS r FROM seen WHERE path = '/' GROUP BY host) SELECT page_id, host, path FROM seen LEFT JOIN root USING (host) WHERE status = 200 AND path IN ({corpus.quoted(observed.ADMIN_PATHS)}) AND NOT regexp_matches(lower(body), {_lit(observed.LOGIN)}) AND regexp_matches(lower(body), {_lit(observed.ADMIN)}) AND (r IS NULL OR r != body)")
def open_admin(spark: S, sf: str) -> D:
    return observed.open_admin(corpus.responses(spark, sf))


@query("rate_limit_absent", "WITH l AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, concat('/u/', user_id) AS url, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN 429 ELSE 200 END AS status FROM events) SELECT w AS window_start, url, count(*) FILTER (WHERE status BETWEEN 200 AND 499) AS served FROM l GROUP BY ALL HAVING count(*) FILTER (WHERE status BETWEEN 200 AND 499) >= 2 AND NOT bool_or(status = 429)")
def rate_limit_absent(spark: S, sf: str) -> D:
    e = spark.read.parquet(f"{sf}/events.parquet")
    log = e.select("ts", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 13 == 0, 429).otherwise(200).alias("status"))
    return observed.rate_limit_absent(log, 21_600, 2)


@query("authorized_target", "WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) SELECT host FROM h WHERE host = 'example.com' OR host LIKE '%.example.com' OR host LIKE '%.example.org'")
def authorized_target(spark: S, sf: str) -> D:
    seen = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host")).distinct()
    return observed.authorized_target(seen, spark.createDataFrame([("example.com",), ("example.org",)], "host string"))


_TLS = "['TLSv1', 'TLSv1.1', 'TLSv1.2', 'TLSv1.3', 'SSLv3']"


@query("tls_findings", f"WITH h AS (SELECT concat('h', o_custkey, '.local') AS host, {_TLS}[(o_orderkey % 5) + 1] AS protocol, date_diff('day', TIMESTAMP '1998-06-01', o_orderdate) AS days FROM orders) SELECT host, 'weak-protocol' AS finding, 'P1' AS severity FROM h WHERE protocol IN ({corpus.quoted(observed.WEAK_PROTOCOLS)}) UNION ALL SELECT host, 'expired', 'P0' FROM h WHERE days < 0 UNION ALL SELECT host, 'expiring', 'P1' FROM h WHERE days BETWEEN 0 AND 13")
def tls_findings(spark: S, sf: str) -> D:
    o = spark.read.parquet(f"{sf}/orders.parquet")
    protocol = F.get(F.array(*map(F.lit, ("TLSv1", "TLSv1.1", "TLSv1.2", "TLSv1.3", "SSLv3"))), (F.col("o_orderkey") % 5).cast("int"))
    seen = o.select(F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit(".local")).alias("host"), protocol.alias("protocol"), F.col("o_orderdate").cast("timestamp").alias("not_after"))
    return observed.tls_findings(seen, F.lit("1998-06-01 00:00:00").cast("timestamp"))


_PORT_LIST = [22, 80, 443, 3306, 5432, 6379, 8080, 9200, 27017, 2375, 3389]
_KNOWN = ", ".join(f"({p}, '{n}', '{s}')" for p, n, s in observed.PORTS)


@query("open_ports", f"WITH known(port, service, severity) AS (VALUES {_KNOWN}), s AS (SELECT DISTINCT concat('h', l_suppkey) AS host, {_PORT_LIST}[(l_partkey % {len(_PORT_LIST)}) + 1] AS port FROM lineitem) SELECT host, port::INT AS port, service, severity FROM s JOIN known USING (port)")
def open_ports(spark: S, sf: str) -> D:
    x = spark.read.parquet(f"{sf}/lineitem.parquet")
    port = F.get(F.array(*map(F.lit, _PORT_LIST)), (F.col("l_partkey") % len(_PORT_LIST)).cast("int"))
    return observed.open_ports(x.select(F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("host"), port.alias("port")))


@query("targets_of_pages", r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)', 1)) AS host, regexp_replace(url, '/+$', '') AS base FROM pages")
def targets_of_pages(spark: S, sf: str) -> D:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", t.to_host(F.col("url")).alias("host"), t.base_url(F.col("url")).alias("base"))


@query("role_of_service", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(p_name, {_lit(p)}) THEN '{r_}'" for p, r_ in t.ROLES) + " ELSE 'service' END AS role FROM part")
def role_of_service(spark: S, sf: str) -> D:
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", t.role_of_service(F.col("p_name")).alias("role"))


# --- streams, run until all that is there has been read
@query("stream_history", "WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS w, event_type, max(ts) OVER () AS last FROM events) SELECT w AS window_start, event_type, count(*) AS n FROM e WHERE w + INTERVAL 1 DAY <= last - INTERVAL 1 DAY GROUP BY ALL")
def stream_history(spark: S, sf: str) -> D:
    return streams.drained(streams.stream_history(streams.arriving(spark, f"{sf}/events.parquet")))


def _parts_arriving(spark: S, sf: str) -> D:
    """Parts as a stream, dealt over as many tasks as the table's rows ask for."""
    path = f"{sf}/part.parquet"
    return streams.arriving(spark, path).repartition(corpus.tasks_for(spark.read.parquet(path)))


@query("stream_scan", f"{_CODE}, {_rules_sql(r.CLOUD, 160, 0)} SELECT repo_id, path, line_no, rule_id, severity FROM hit")
def stream_scan(spark: S, sf: str) -> D:
    return streams.drained(streams.stream_scan(scan.lines(corpus.code_of(_parts_arriving(spark, sf))), r.CLOUD))


@query("stream_rate_limit", "WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, concat('/u/', user_id) AS url, CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 13 = 0 THEN 429 ELSE 200 END AS status, max(ts) OVER () AS last FROM events), b AS (SELECT w, url, any_value(last) AS last, count(*) FILTER (WHERE status BETWEEN 200 AND 499) AS served, bool_or(status = 429) AS held FROM e GROUP BY w, url) SELECT w AS window_start, url, served FROM b WHERE w + INTERVAL 6 HOUR <= last - INTERVAL 1 DAY AND served >= 2 AND NOT held")
def stream_rate_limit(spark: S, sf: str) -> D:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 13 == 0, 429).otherwise(200)
    log = streams.arriving(spark, f"{sf}/events.parquet").select("ts", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("url"), status.alias("status"))
    return streams.drained(streams.stream_rate_limit(log, 21_600, 2))


@query("stream_scan_capped", f"{_CODE_SCANNED}, {_rules_sql(_PLAIN, 200, 2, '1')} SELECT {_COLUMNS_SQL} FROM first WHERE nth = 1")
def stream_scan_capped(spark: S, sf: str) -> D:
    """Files as they arrive, with caps and dedup as in a batch."""
    top = streams.own_folder(spark)
    files = scan.code_files(corpus.code_of(_parts_arriving(spark, sf))).withColumn("version", F.lit(1))
    streams.scan_arriving(files, [replace(x, cap=1) for x in _PLAIN], top)
    return streams.scanned(spark, top).select(*_COLUMNS)


@query("stream_delta_runs", f"WITH {corpus.findings_sql()}, r AS (SELECT DISTINCT repo_id, n AS run, fingerprint FROM finding, (SELECT unnest([1, 2, 3]) AS n) WHERE seen != n), p AS (SELECT a.*, b.fingerprint IS NOT NULL AS old FROM r a LEFT JOIN r b ON b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint AND b.run = a.run - 1) SELECT repo_id, run, fingerprint, CASE WHEN old THEN 'persisting' ELSE 'introduced' END AS change FROM p UNION ALL SELECT a.repo_id, a.run + 1, a.fingerprint, 'fixed' FROM r a ANTI JOIN r b ON b.repo_id = a.repo_id AND b.fingerprint = a.fingerprint AND b.run = a.run + 1 WHERE a.run < 3")
def stream_delta_runs(spark: S, sf: str) -> D:
    """Three runs of each repository, each against the one before it."""
    top = streams.own_folder(spark)
    found = corpus.findings_of(streams.arriving(spark, f"{sf}/lineitem.parquet"))
    runs = found.select("repo_id", "fingerprint", "seen", F.explode(F.lit([1, 2, 3])).alias("run")).where("seen != run").select("repo_id", F.col("run").cast("long").alias("run"), "fingerprint")
    streams.delta_arriving(runs, top)
    return streams.changes(spark, top)


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: S, sf: str) -> D:
    """Within a span longer than the events' own, so that a key comes once."""
    return streams.drained(streams.stream_dedup(streams.arriving(spark, f"{sf}/events.parquet"), ["user_id", "event_type"], "4000 days").select("user_id", "event_type"))


@query("stream_delta", "WITH b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size < 10) SELECT p_partkey, CASE WHEN b.p_brand IS NULL THEN 'introduced' ELSE 'persisting' END AS change FROM part LEFT JOIN b USING (p_brand, p_type)")
def stream_delta(spark: S, sf: str) -> D:
    """Parts as findings: brand the repository, type the fingerprint; small ones were known before."""
    known = spark.read.parquet(f"{sf}/part.parquet").where("p_size < 10").select(F.col("p_brand").alias("repo_id"), F.col("p_type").alias("fingerprint"))
    now = streams.arriving(spark, f"{sf}/part.parquet").select("p_partkey", F.col("p_brand").alias("repo_id"), F.col("p_type").alias("fingerprint"))
    return streams.drained(streams.stream_delta(now, known)).select("p_partkey", "change")
