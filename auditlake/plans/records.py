"""Registered queries of findings from parity, compliance, observations, histories and other tools; their SQL names what the checks' own SQL finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import estate, findings, parity, records
from auditlake.operators import rules as r
from auditlake.plans.queries import _PORT_LIST, _SEEN, SQL, _lit, _mask_sql, query
from auditlake.plans.reports import _MANIFEST, _NPM, _NUCLEI, _SARIF
from auditlake.plans.runs import _OUT, _OUT_SQL
from auditlake.sources import corpus
from auditlake.sources.corpus import ESTATE_SQL

S, D = SparkSession, DataFrame


def _records_sql(before: str, rows: str) -> str:
    """``rows`` gives all of a finding but the fingerprint, its excerpt unmasked; the excerpt's mask and fingerprint follow, and the first of equal ones stays."""
    return f"""WITH {before}, found AS ({rows}), shown AS (SELECT * EXCLUDE (excerpt), {_mask_sql('excerpt')} AS excerpt FROM found),
printed AS (SELECT *, substring(sha1(concat_ws('|', module, "check", title, concat(source, '|', trim(regexp_replace(coalesce(excerpt, location, ''), '\\s+', ' ', 'g'))))), 1, 16) AS fingerprint FROM shown)
SELECT {_OUT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, module, fingerprint ORDER BY source, try_cast(location AS BIGINT) NULLS FIRST, id) AS nth FROM printed) WHERE nth = 1"""


def _values(name: str, table: dict[str, tuple]) -> str:
    width = len(next(iter(table.values())))
    return f"{name}(k, {', '.join(f'v{i}' for i in range(width))}) AS (VALUES {', '.join(f'({_lit(k)}, {', '.join(map(_lit, row))})' for k, row in table.items())})"


_D_ROWS = f"""SELECT f.repo_id, v0 AS id, v1 AS title, severity, 'D' AS module, "check", v2 AS category, v3 AS confidence, CASE WHEN v0 = 'D5-ci-no-test-gate' THEN (SELECT min(path) FROM estate e WHERE e.repo_id = f.repo_id AND regexp_matches(path, {_lit(estate.CI_FILE)})) ELSE v5 END AS source, NULL AS location, v6 AS excerpt
FROM lack f JOIN named ON k = concat("check", severity)
UNION ALL SELECT repo_id, concat('D7-', kind, '-storage:', path, ':', line_no), CASE WHEN kind = 'cvv' THEN 'CVV/CVC saklanıyor olabilir — PCI-DSS KESİNLİKLE YASAK' ELSE 'Kart numarası (PAN) saklanıyor olabilir — maskeleme/tokenizasyon gerekir' END, CASE WHEN kind = 'cvv' THEN 'P0' ELSE 'P1' END, 'D', 'D7', 'PCI-DSS', CASE WHEN kind = 'cvv' THEN 'medium' ELSE 'low' END, path, line_no::VARCHAR, substring(trim(line), 1, 160) FROM card"""
_D_BEFORE = f"""{ESTATE_SQL}, {_values("named", records._COMPLIANCE)}, lack AS ({SQL["compliance_findings"]}),
line AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM estate WHERE regexp_matches(path, {_lit(r.CODE_OR_SCHEMA)}) AND NOT regexp_matches(path, {_lit(r.CARD_SKIP)})),
held AS (SELECT *, regexp_matches(line, {_lit(r.CVV)})::INT AS c, regexp_matches(line, {_lit(r.PAN)})::INT AS p FROM line), few AS (SELECT *, coalesce(sum(c + p) OVER (PARTITION BY repo_id ORDER BY path, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM held WHERE c + p > 0),
card AS (SELECT repo_id, path, line_no, line, 'cvv' AS kind FROM few WHERE n < 50 AND c = 1 UNION ALL SELECT repo_id, path, line_no, line, 'pan' FROM few WHERE n < 50 AND p = 1)"""


@query("compliance_records", _records_sql(_D_BEFORE, _D_ROWS))
def compliance_records(spark: S, sf: str) -> D:
    return findings.run_scan(corpus.estate_corpus(spark, sf), ["D"], records.estate_scanners()).select(*_OUT)


_A = {
    "db-push": ("prisma db push kullanımı (migration'sız şema değişikliği = drift riski)", "high", "package.json scripts", "prisma db push"),
    "no-migrations": ("Prisma modelleri var ama hiç migration yok (şema db push ile mi yönetiliyor?)", "medium", "prisma/schema.prisma", ""),
    "no-shadow-db": ("shadowDatabaseUrl tanımlı değil (bazı sağlayıcılarda migrate güvenliği için gerekir)", "low", "prisma/schema.prisma", "datasource"),
}
_A_ROWS = f"""SELECT repo_id, concat('A2-destructive-migration:', path) AS id, concat('Destructive migration: ', labels) AS title, severity, 'A' AS module, 'A2' AS "check", 'Schema Parity' AS category, 'high' AS confidence, path AS source, line_no::VARCHAR AS location, labels AS excerpt FROM ({SQL["destructive_migrations"]})
UNION ALL SELECT repo_id, concat('A2-', finding), v0, severity, 'A', 'A2', 'Schema Parity', v1, v2, NULL, v3 FROM ({SQL["schema_prisma"]}) JOIN named ON k = finding
UNION ALL SELECT b.repo_id, 'A5-backup-no-restore', 'Backup alınıyor ama restore prosedürü/drill bulunamadı', severity, 'A', 'A5', 'Operational Health', 'medium', coalesce((SELECT min(path) FROM estate e WHERE e.repo_id = b.repo_id AND regexp_matches(path, {_lit(estate.BACKUP)})), 'backup'), NULL, 'backup sinyali var, restore sinyali yok' FROM ({SQL["backup_restore"]}) b"""


@query("parity_records", _records_sql(f"{ESTATE_SQL}, {_values('named', _A)}", _A_ROWS))
def parity_records(spark: S, sf: str) -> D:
    return findings.run_scan(corpus.estate_corpus(spark, sf), ["A"], records.estate_scanners()).select(*_OUT)


@query("k8s_records", _records_sql(f"{_values('named', {k: (v[2], v[3]) for k, v in parity.K8S.items()})}", f"""SELECT repo_id, id, title, severity, 'K8S' AS module, "check", category, 'high' AS confidence, path AS source, NULL AS location, title AS excerpt FROM (SELECT x.*, v1 AS category, replace(replace(v0, '{{of}}', split_part(id, ':', 2)), '{{what}}', CASE "check" WHEN 'K8S-4' THEN split_part(id, '/', 3) ELSE CASE WHEN k8 % 4 = 0 THEN 'img:latest' ELSE 'img' END END) AS title FROM (SELECT *, regexp_extract(path, '[0-9]+')::BIGINT AS k8 FROM ({SQL["k8s_checks"]})) x JOIN named ON k = "check")"""))
def k8s_records(spark: S, sf: str) -> D:
    p = spark.read.parquet(f"{sf}/part.parquet")
    texts = p.select(F.col("p_brand").alias("repo_id"), F.expr("concat('k/', p_partkey, '.json') AS path"), F.expr(_MANIFEST).alias("doc"))
    return findings.union_modules([records.k8s_findings(texts)]).select(*_OUT)


_C_ROWS = f"""SELECT host AS repo_id, concat('C1-exposed:', x.path) AS id, t.v0 AS title, severity, 'C' AS module, 'C1' AS "check", 'Exposed Sensitive File' AS category, 'high' AS confidence, concat('https://', host, seen.path) AS source, status::VARCHAR AS location, substring(body, 1, 120) AS excerpt FROM ({SQL["exposed_files"]}) x JOIN seen USING (page_id) JOIN file_name t ON t.k = x.path
UNION ALL SELECT host, concat('C2-header:', header), t.v0, severity, 'C', 'C2', 'Security Header', 'high', concat('https://', host, path), status::VARCHAR, concat('eksik: ', header) FROM ({SQL["missing_headers"]}) x JOIN seen USING (page_id) JOIN header_name t ON t.k = header
UNION ALL SELECT host, concat('C6-cookie:', cookie), concat('Cookie ''', cookie, ''' eksik bayrak: ', replace(missing, ',', ', ')), severity, 'C', 'C6', 'Cookie Security', 'high', concat('https://', host, path), 'Set-Cookie', concat(cookie, ': eksik ', replace(missing, ',', '/')) FROM ({SQL["cookie_flags"]}) x JOIN seen USING (page_id)
UNION ALL SELECT host, concat('C3-open-admin:', x.path), concat('Korumasız admin paneli erişilebilir: ', x.path), 'P0', 'C', 'C3', 'Broken Access Control', 'low', concat('https://', host, x.path), status::VARCHAR, substring(body, 1, 120) FROM ({SQL["open_admin"]}) x JOIN (SELECT page_id, host, status, body FROM seen) USING (page_id, host)"""


@query("response_records", _records_sql(f"{_SEEN.removeprefix('WITH ')}, {_values('file_name', records._EXPOSED)}, {_values('header_name', records._HEADERS)}", _C_ROWS))
def response_records(spark: S, sf: str) -> D:
    return findings.union_modules([records.response_findings(corpus.responses(spark, sf))]).select(*_OUT)


_TOOL_ROWS = f"""SELECT repo_id, id, title, severity, module, "check", concat('External · ', regexp_extract(title, '^\\[([^\\]]*)\\]', 1)) AS category, 'medium' AS confidence, source, line::VARCHAR AS location, concat('see ', cves) AS excerpt FROM ({SQL["sarif_import"]})
UNION ALL SELECT repo_id, id, title, severity, 'C', "check", 'External · nuclei (DAST)', 'medium', source, NULL, regexp_replace(title, '^\\[nuclei\\] ', '') FROM ({SQL["nuclei_import"]})
UNION ALL SELECT repo_id, id, title, severity, 'B', 'B2', 'Vulnerable Component', 'high', 'npm/pnpm audit', NULL, excerpt FROM ({SQL["npm_audit_import"]})"""


@query("tool_records", _records_sql("one AS (SELECT 1)", _TOOL_ROWS))
def tool_records(spark: S, sf: str) -> D:
    """Reports of three kinds of tools in the one table."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    of = lambda x, n: p.select(F.col("p_brand").alias("repo_id"), F.expr(x).alias(n))
    parts = [records.sarif_findings(of(_SARIF, "doc")), records.nuclei_findings(of(_NUCLEI, "line")), records.dependency_findings(of(_NPM, "doc"))]
    return findings.union_modules(parts).select(*_OUT)


_HOST_ROWS = f"""SELECT host AS repo_id, concat(CASE finding WHEN 'weak-protocol' THEN 'C2-weak-tls:' WHEN 'expired' THEN 'C2-cert-expired:' ELSE 'C2-cert-soon:' END, host) AS id, title, severity, 'C' AS module, 'C2' AS "check", 'TLS' AS category, 'high' AS confidence, concat(host, ':443') AS source, NULL AS location, excerpt FROM (
  SELECT host, 'weak-protocol' AS finding, 'P1' AS severity, concat('Zayıf TLS protokolü: ', protocol) AS title, protocol AS excerpt FROM h WHERE protocol IN ('TLSv1', 'TLSv1.1', 'SSLv3')
  UNION SELECT host, 'expired', 'P0', concat('TLS sertifikası SÜRESİ DOLMUŞ (', abs(days), ' gün önce)'), till FROM h WHERE days < 0
  UNION SELECT host, 'expiring', 'P1', concat('TLS sertifikası ', days, ' gün içinde sona eriyor'), till FROM h WHERE days BETWEEN 0 AND 13)
UNION ALL SELECT host, concat('C5-open-port:', host, ':', port), concat('Hassas port açık: ', port, '/', service, ' (', host, ')'), severity, 'C', 'C5', 'Open Port / Service', 'high', concat(host, ':', port), NULL, concat(service, ' TCP connect başarılı') FROM ({SQL["open_ports"]})"""


@query("host_records", _records_sql("h AS (SELECT concat('h', o_custkey, '.local') AS host, ['TLSv1', 'TLSv1.1', 'TLSv1.2', 'TLSv1.3', 'SSLv3'][(o_orderkey % 5) + 1] AS protocol, date_diff('day', TIMESTAMP '1998-06-01', o_orderdate) AS days, concat('notAfter=', strftime(o_orderdate, '%Y-%m-%d'), 'T00:00:00.000Z') AS till FROM orders)", _HOST_ROWS))
def host_records(spark: S, sf: str) -> D:
    o, x = spark.read.parquet(f"{sf}/orders.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    hands = o.select(F.concat(F.lit("h"), F.col("o_custkey").cast("string"), F.lit(".local")).alias("host"), pick(("TLSv1", "TLSv1.1", "TLSv1.2", "TLSv1.3", "SSLv3"), F.col("o_orderkey")).alias("protocol"), F.col("o_orderdate").cast("timestamp").alias("not_after"))
    ports = x.select(F.concat(F.lit("h"), F.col("l_suppkey").cast("string")).alias("host"), pick(_PORT_LIST, F.col("l_partkey")).alias("port"))
    return findings.union_modules([records.host_findings(hands, ports, F.lit("1998-06-01 00:00:00").cast("timestamp"))]).select(*_OUT)
