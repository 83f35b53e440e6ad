"""Checks of captured responses, ports and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import days_until

# Paths that should not be served, with severity, what their body shows, and whether an HTML page is none.
EXPOSED = [
    ("/.env", "P0", r"(?m)^[A-Z0-9_]+\s*=", True), ("/.git/config", "P0", r"\[core\]|\[remote ", False), ("/.git/HEAD", "P0", r"^\s*ref:\s+refs/", False), ("/.aws/credentials", "P0", r"(?i)aws_access_key_id", False), ("/.terraform.tfstate", "P0", r'"terraform_version"|"resources"', False),
    ("/backup.sql", "P0", r"(?i)(CREATE TABLE|INSERT INTO|DROP TABLE)", True), ("/.npmrc", "P1", r"_authToken|registry=", False), ("/swagger.json", "P1", r'"swagger"|"openapi"', False), ("/api-docs", "P1", r'(?i)"swagger"|"openapi"|swagger-ui', False),
    ("/actuator/health", "P1", r'"status"\s*:\s*"(UP|DOWN)"', False), ("/.DS_Store", "P2", r"Bud1|^\x00", False),
]
# Headers, admin paths and words, sessions, weak protocols, ports of services.
HEADERS = [("strict-transport-security", "P1"), ("content-security-policy", "P1"), ("x-content-type-options", "P2"), ("x-frame-options", "P2")]
ADMIN_PATHS = ["/admin", "/administrator", "/wp-admin", "/manager/html", "/.git/"]
LOGIN, ADMIN, SESSION = "password|şifre|sign in|giriş yap|login", "dashboard|admin|yönetim|console|manager", r"(?i)(sess|sid|token|auth|jwt)"
WEAK_PROTOCOLS = ["TLSv1", "TLSv1.1", "SSLv3", "SSLv2"]
PORTS = [(22, "SSH", "P2"), (3389, "RDP", "P1"), (3306, "MySQL", "P1"), (5432, "PostgreSQL", "P1"), (6379, "Redis", "P0"), (27017, "MongoDB", "P0"), (9200, "Elasticsearch", "P0"), (5984, "CouchDB", "P1"), (11211, "Memcached", "P1"), (2375, "Docker API (TLS yok)", "P0")]


def exposed_files(responses: DataFrame) -> DataFrame:
    """page_id, path, severity of files that answered with their own content."""
    html = F.contains(F.lower(F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit(""))), F.lit("html"))
    hit = F.coalesce(*(F.when((F.col("path") == p) & F.col("body").rlike(b) & (~html if plain else F.lit(True)), s) for p, s, b, plain in EXPOSED))
    return responses.where("status = 200").select("page_id", "path", hit.alias("severity")).where("severity IS NOT NULL")


def missing_headers(responses: DataFrame) -> DataFrame:
    """page_id, header, severity: a row a header that is absent or empty."""
    gaps = F.filter(F.array(*(F.when(F.coalesce(F.try_element_at("headers", F.lit(h)), F.lit("")) == "", F.struct(F.lit(h).alias("header"), F.lit(s).alias("severity"))) for h, s in HEADERS)), lambda x: x.isNotNull())
    return responses.where("status != 0").select("page_id", F.explode(gaps).alias("g")).select("page_id", "g.*")


def cookie_flags(responses: DataFrame) -> DataFrame:
    """page_id, cookie, missing (flags, joined), severity: P1 for cookies that look like a session."""
    c = responses.select("page_id", F.explode("set_cookies").alias("c")).withColumn("cookie", F.substring_index("c", "=", 1))
    gone = F.filter(F.array(*(F.when(~F.contains(F.lower("c"), F.lit(f.lower())), f) for f in ("HttpOnly", "Secure", "SameSite"))), lambda x: x.isNotNull())
    return c.select("page_id", "cookie", F.array_join(gone, ",").alias("missing"), F.when(F.col("cookie").rlike(SESSION), "P1").otherwise("P2").alias("severity")).where("missing != ''")


def open_admin(responses: DataFrame) -> DataFrame:
    """page_id, host, path of admin pages that open without a login and differ from the host's start page."""
    root = responses.where("path = '/'").groupBy("host").agg(F.min_by("body", "page_id").alias("root"))
    a = responses.where((F.col("status") == 200) & F.col("path").isin(ADMIN_PATHS) & ~F.lower("body").rlike(LOGIN) & F.lower("body").rlike(ADMIN))
    return a.join(root, "host", "left").where("root IS NULL OR body != root").select("page_id", "host", "path")


def rate_limit_absent(log: DataFrame, seconds: int = 600, least: int = 5) -> DataFrame:
    """window_start, url, served of bursts against one URL with ``least`` answers of status 200 to 499 and no 429."""
    burst = log.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "url").agg(F.count_if(F.col("status").between(200, 499)).alias("served"), F.bool_or(F.col("status") == 429).alias("held"))
    return burst.where(f"served >= {least} AND NOT held").select(F.col("w.start").alias("window_start"), "url", "served")


def tls_findings(seen: DataFrame, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """host, the columns in ``keep``, finding, severity of handshakes (host, protocol, not_after): weak protocols (P1), certificates expired (P0) or within 14 days (P1)."""
    days = days_until(F.col("not_after"), now)
    f = lambda c, n, s: F.when(c, F.struct(F.lit(n).alias("finding"), F.lit(s).alias("severity")))
    found = F.array(f(F.col("protocol").isin(WEAK_PROTOCOLS), "weak-protocol", "P1"), f(days < 0, "expired", "P0"), f(days.between(0, 13), "expiring", "P1"))
    return seen.select("host", *keep, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("host", *keep, "f.*")


def open_ports(seen: DataFrame) -> DataFrame:
    """host, port, service, severity of open ports (host, port) that belong to a service not meant for everyone."""
    known = seen.sparkSession.createDataFrame(PORTS, "port int, service string, severity string")
    return seen.select("host", F.col("port").cast("int").alias("port")).distinct().join(F.broadcast(known), "port").select("host", "port", "service", "severity")  # ten rows


def authorized_target(seen: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of ``seen`` whose host is an allowed one or below it: a host's own suffixes are joined by equality."""
    parts = F.split("host", r"\.")
    ups = seen.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))).alias("__up"))
    return ups.join(allowed.select(F.col("host").alias("__up")).distinct(), "__up", "left_semi").drop("__up").distinct()
