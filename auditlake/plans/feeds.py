"""Registered queries of feeds and records, made from the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.plans.queries import query
from auditlake.sources import feeds

S, D = SparkSession, DataFrame
_KEV = """CASE p_partkey % 3 WHEN 0 THEN concat('["cve-2020-', 1000 + p_size, '", "none"]') WHEN 1 THEN concat('[{"cveID": "CVE-2021-', 1000 + p_size, '", "note": "CVE-1999-0001"}]') ELSE concat('{"vulnerabilities": [{"cveID": "CVE-2022-', 1000 + p_size, '"}, {"other": 1}]}') END"""
_EPSS = """CASE p_partkey % 3 WHEN 0 THEN concat('[{"cve": "cve-2020-', 1000 + p_size, '", "epss": "0.', p_size, '"}]') WHEN 1 THEN concat('{"data": [{"cve": "CVE-2021-', 1000 + p_size, '", "epss": 0.5}, {"cve": "x", "epss": 1}]}') ELSE concat('{"CVE-2022-', 1000 + p_size, '": 0.25, "CVE-2023-1000": "bad"}') END"""


def _part(spark: S, sf: str, **columns: str) -> D:
    return spark.read.parquet(f"{sf}/part.parquet").select(*(F.expr(e).alias(n) for n, e in columns.items()))


@query("kev_feed", f"WITH d AS (SELECT {_KEV} AS doc FROM part), n AS (SELECT unnest(list_concat(coalesce(json_extract_string(doc, '$[*].cveID'), []), list_concat(coalesce(json_extract_string(doc, '$.vulnerabilities[*].cveID'), []), coalesce(json_extract_string(doc, '$[*]'), [])))) AS x FROM d) SELECT DISTINCT upper(regexp_extract(x, '(?i)(CVE-[0-9]{{4}}-[0-9]{{3,7}})', 1)) AS cve FROM n WHERE x NOT LIKE '{{%' AND regexp_matches(x, '(?i)CVE-[0-9]{{4}}-[0-9]{{3,7}}')")
def kev_feed(spark: S, sf: str) -> D:
    return feeds.kev_feed(_part(spark, sf, doc=_KEV))


@query("epss_feed", "WITH r AS (SELECT concat('CVE-2020-', 1000 + p_size) AS cve, concat('0.', p_size)::DOUBLE AS score FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT concat('CVE-2021-', 1000 + p_size), 0.5 FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT concat('CVE-2022-', 1000 + p_size), 0.25 FROM part WHERE p_partkey % 3 = 2) SELECT cve, max(score) AS score FROM r GROUP BY cve")
def epss_feed(spark: S, sf: str) -> D:
    return feeds.epss_feed(_part(spark, sf, doc=_EPSS))


_WAIVER = dict(ordinal="p_partkey", fingerprint="CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE ' ' END", check="CASE WHEN p_partkey % 5 = 0 THEN p_brand END", id="CASE WHEN p_partkey % 7 = 0 THEN p_name END", reason="CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'known' END", expires="CASE WHEN p_partkey % 2 = 0 THEN '2030-01-01' END")


@query("waiver_records", "WITH w AS (SELECT " + ", ".join(f"{e} AS {n}" if n == "ordinal" else f"nullif(trim({e}), '') AS \"{n}\"" for n, e in _WAIVER.items()) + " FROM part) SELECT *, CASE WHEN coalesce(fingerprint, \"check\", id) IS NULL THEN 'no selector' WHEN reason IS NULL THEN 'no reason' END AS rejected FROM w")
def waiver_records(spark: S, sf: str) -> D:
    return feeds.waiver_records(_part(spark, sf, **_WAIVER))


_LOG = "concat('+early', chr(10), 'commit ', md5(p_name), chr(10), '+++ b/f', chr(10), '+key ', p_size, chr(10), '-gone', chr(10), 'commit ', md5(p_type), chr(10), ' same', chr(10), '+last ', p_partkey)"


@query("git_log_lines", "SELECT p_brand AS repo_id, '' AS commit, 'early' AS line FROM part UNION ALL SELECT p_brand, left(md5(p_name), 12), concat('key ', p_size) FROM part UNION ALL SELECT p_brand, left(md5(p_type), 12), concat('last ', p_partkey) FROM part")
def git_log_lines(spark: S, sf: str) -> D:
    return feeds.added_lines(_part(spark, sf, repo_id="p_brand", log=_LOG))


_ENTRY = """CASE p_partkey % 4 WHEN 0 THEN concat('/data/', p_size, ':/uploads:ro') WHEN 1 THEN '/cache' WHEN 2 THEN concat('{"source": "v', p_size, '", "target": "/media"}') ELSE '{"source": "x"}' END"""


@query("compose_mounts", "SELECT p_brand AS repo_id, p_type AS service, CASE p_partkey % 4 WHEN 0 THEN concat('/data/', p_size) WHEN 2 THEN concat('v', p_size) END AS source, CASE p_partkey % 4 WHEN 0 THEN '/uploads' WHEN 1 THEN '/cache' ELSE '/media' END AS target FROM part WHERE p_partkey % 4 < 3")
def compose_mounts(spark: S, sf: str) -> D:
    return feeds.compose_mounts(_part(spark, sf, repo_id="p_brand", service="p_type", entry=_ENTRY))
