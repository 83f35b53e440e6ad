"""What the checks of manifests, parity, compliance, observations, histories and other tools find, as findings of the one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as t
from auditlake.operators import estate, observed, parity, scan
from auditlake.operators import rules as r
from auditlake.operators.findings import Scanner, make_findings
from auditlake.sources import documents, feeds, imports


def recorded(found: DataFrame, module: str | Column, check: str | Column, category: str | Column, confidence: str | Column, type: str | Column, id: Column, title: str | Column, source: str | Column, excerpt: Column, severity: str | Column | None = None, location: Column | None = None, more: Column | None = None, cves: Column | None = None) -> DataFrame:  # noqa: A002
    """Findings of rows with repo_id (and severity, if it is not given)."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    told = {"module": module, "check": check, "category": category, "confidence": confidence, "type": type, "id": id, "title": title, "source": source, "excerpt": excerpt, "severity": F.col("severity") if severity is None else severity, "location": F.lit(None) if location is None else location}
    extra = ([more.alias("more")] if more is not None else []) + ([cves.alias("cves")] if cves is not None else [])
    return make_findings(found.select("repo_id", *(col(v).cast("string").alias(k) for k, v in told.items()), *extra))


def _said(*parts: str | Column) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _named(found: DataFrame, of: Column, table: dict[str, tuple]) -> list[Column]:
    """A column for each place of the table's rows, by the name in ``of``."""
    width = len(next(iter(table.values())))
    return [F.coalesce(*(F.when(of == n, F.lit(row[i])) for n, row in table.items())) for i in range(width)]


# --- K8S: manifests
def k8s_findings(texts: DataFrame) -> DataFrame:
    return recorded(parity.k8s_checks(texts), "K8S", F.col("check"), F.col("category"), "high", "config", F.col("id"), F.col("title"), F.col("path"), F.col("title"))


# --- A: parity.  Fixed values: ids, titles, categories and words of evidence.
def git_findings(state: DataFrame) -> DataFrame:
    """Of (repo_id, head_sha, main_sha, main_branch, ahead, behind, dirty_files)."""
    main = F.coalesce("main_branch", F.lit("main"))
    short = lambda c: F.substring(c, 1, 8)
    drift = state.where((F.col("behind") > 0) & (F.col("head_sha") != F.col("main_sha")))
    counts = _said("HEAD=", short("head_sha"), " ", main, "=", short("main_sha"), " (ahead ", F.col("ahead").cast("string"), " / behind ", F.col("behind").cast("string"), ")")
    a = recorded(drift, "A", "A1", "Deployment Parity", "high", "command", F.lit("A1-production-drift"), _said("Production drift: HEAD ana daldan ", F.col("behind").cast("string"), " commit geride"), _said("git rev-list --left-right --count HEAD...", main), counts, "P0")
    n = F.col("dirty_files").cast("string")
    b = recorded(state.where("dirty_files > 0"), "A", "A1", "Deployment Parity", "high", "command", F.lit("A1-dirty-tree"), _said("Çalışma ağacı kirli: ", n, " dosya commit edilmemiş (elle düzenleme = drift)"), "git status --porcelain", _said(n, " değişiklik"), "P1")
    return a.unionByName(b)


def schema_findings(files: DataFrame) -> DataFrame:
    """Destructive migrations of any stack (up to five lines of evidence), and what schema and scripts of the prisma stack lack."""
    profile = estate.stack_profile(files)
    broken = estate.destructive_migrations(files, profile)
    a = recorded(broken, "A", "A2", "Schema Parity", "high", "file", _said("A2-destructive-migration:", F.col("path")), _said("Destructive migration: ", F.col("labels")), F.col("path"), F.col("labels"), location=F.col("line_no"))
    table = {
        "db-push": ("prisma db push kullanımı (migration'sız şema değişikliği = drift riski)", "high", "config", "package.json scripts", "prisma db push"),
        "no-migrations": ("Prisma modelleri var ama hiç migration yok (şema db push ile mi yönetiliyor?)", "medium", "file", "prisma/schema.prisma", ""),
        "no-shadow-db": ("shadowDatabaseUrl tanımlı değil (bazı sağlayıcılarda migrate güvenliği için gerekir)", "low", "config", "prisma/schema.prisma", "datasource"),
    }
    named = estate.schema_prisma(files, profile)
    title, sure, kind, source, words = _named(named, F.col("finding"), table)
    return a.unionByName(recorded(named, "A", "A2", "Schema Parity", sure, kind, _said("A2-", F.col("finding")), title, source, words))


def runtime_findings(containers: DataFrame, now: Column) -> DataFrame:
    """Of (repo_id, name, state, health, created_at)."""
    name, health = F.col("name"), F.coalesce("health", F.lit(""))
    bad = containers.where(F.col("state").isin("restarting", "unhealthy") | (health == "unhealthy"))
    said = _said("Container sağlıksız/crash-loop: ", name, " (", F.col("state"), F.when(health != "", _said(", ", health)).otherwise(""), ")")
    a = recorded(bad, "A", "A3", "Runtime Freshness", "high", "command", _said("A3-unhealthy:", name), said, "docker compose ps", _said(name, ": ", F.col("state"), "/", health), "P1")
    days = t.days_until(now, F.col("created_at"))
    old = containers.withColumn("days", days).where("days > 14")
    made = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    b = recorded(old, "A", "A3", "Runtime Freshness", "medium", "command", _said("A3-stale-image:", name), _said("Container ", F.col("days").cast("string"), " gün önce build/başlatılmış: ", name, " (güncel koddan olmayabilir)"), "docker compose ps", _said(name, " created ", made), "P2")
    return a.unionByName(b)


def volume_findings(mounts: DataFrame) -> DataFrame:
    """Of (repo_id, path, service, source, target, raw): each mount of a name that services map differently is a piece of evidence."""
    key = F.lower(F.regexp_extract("target", r"([^/]*)/*$", 1))
    odd = parity.volume_mismatch(mounts)
    data = mounts.where(F.col("target").rlike(parity.DATA_LIKE)).withColumn("key", key).join(odd, ["repo_id", "key"])
    piece = F.struct(_said(F.col("path"), " services.", F.col("service"), ".volumes").alias("source"), _said(F.col("service"), " (", t.role_of_service(F.col("service")), "): ", F.col("raw")).alias("excerpt"), F.lit(None).cast("string").alias("location"))
    by = data.groupBy("repo_id", "key", "services").agg(F.array_sort(F.collect_list(piece)).alias("e"))  # mounts of one name in one repository
    title = _said('Volume mismatch: "', F.col("key"), '" verisini ', F.col("services").cast("string"), " servis FARKLI kaynağa bağlıyor")
    return recorded(by, "A", "A4", "Storage Parity", "high", "config", _said("A4-volume-mismatch:", F.col("key")), title, F.col("e")[0]["source"], F.col("e")[0]["excerpt"], "P1", more=F.slice("e", F.lit(2), F.size("e")))


def env_findings(example: DataFrame, env: DataFrame, path: str = ".env.example") -> DataFrame:
    """Of the example's keys and the environment's (repo_id, key): one finding a repository that lacks some."""
    gone = parity.env_parity(example, env)
    known = env.groupBy("repo_id").agg(F.countDistinct("key").alias("known"))
    x = gone.join(example.groupBy("repo_id").agg(F.count("*").alias("asked")), "repo_id").join(known, "repo_id", "left")
    title = _said("Eksik ortam değişkeni: ", F.replace("keys", F.lit(","), F.lit(", ")), F.when(F.col("missing") > 8, " …").otherwise(""))
    has = F.when(F.col("known").isNull(), ".env bulunamadı").otherwise(_said(F.col("known").cast("string"), " anahtar tanımlı"))
    more = F.array(F.struct(F.lit(".env").alias("source"), has.alias("excerpt"), F.lit(None).cast("string").alias("location")))
    return recorded(x, "A", "A4", "Config Parity", F.when(F.col("known").isNull(), "medium").otherwise("high"), "file", F.lit("A4-missing-env"), title, path, _said("sözleşmede ", F.col("asked").cast("string"), " anahtar"), "P1", more=more)


def certificate_findings(certs: DataFrame, now: Column) -> DataFrame:
    """Of certificates in files (repo_id, path, not_after)."""
    x = certs.withColumn("days", t.days_until(F.col("not_after"), now)).where("days < 14")
    days = F.abs("days").cast("string")
    title = F.when(F.col("days") < 0, _said("TLS sertifikası SÜRESİ DOLMUŞ (", days, " gün önce)")).otherwise(_said("TLS sertifikası ", days, " gün içinde sona eriyor"))
    until = _said("notAfter=", F.date_format("not_after", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return recorded(x, "A", "A5", "Operational Health", "high", "file", _said("A5-cert-expiry:", F.col("path")), title, F.col("path"), until, F.when(F.col("days") < 0, "P0").otherwise("P1"))


def backup_findings(files: DataFrame) -> DataFrame:
    first = files.where(F.col("path").rlike(estate.BACKUP)).groupBy("repo_id").agg(F.min("path").alias("path"))
    x = estate.backup_restore(estate.backup_flags(files)).join(first, "repo_id", "left")
    return recorded(x, "A", "A5", "Operational Health", "medium", "file", F.lit("A5-backup-no-restore"), "Backup alınıyor ama restore prosedürü/drill bulunamadı", F.coalesce("path", F.lit("backup")), F.lit("backup sinyali var, restore sinyali yok"))


def webhook_findings(files: DataFrame) -> DataFrame:
    x = scan.local_webhooks(scan.lines(files))
    line = F.col("line_no").cast("string")
    return recorded(x, "A", "A6", "External Dependencies", "medium", "config", F.concat_ws(":", F.lit("A6-local-webhook"), "path", line), _said("Webhook/callback yerel veya geçici host'a bakıyor: ", F.col("url")), F.col("path"), F.col("url"), "P2", line)


def parity_findings(files: DataFrame) -> DataFrame:
    """All of parity that files tell: schemas, volumes of Compose documents (JSON, or YAML that is JSON), backups, webhooks."""
    composes = files.where(F.col("path").rlike(r"^(docker-)?compose\.(ya?ml|json)$")).select("repo_id", "path", F.col("content").alias("doc"))
    return schema_findings(files).unionByName(volume_findings(documents.mounts(composes))).unionByName(backup_findings(files)).unionByName(webhook_findings(files))


# --- D: compliance.  Fixed values as above.
_COMPLIANCE = {
    "D2P2": ("D2-no-error-tracking", "Hata izleme (Sentry/Datadog vb.) tespit edilmedi", "Observability", "medium", "config", "package.json", "observability bağımlılığı yok"),
    "D3P2": ("D3-no-secret-manager", "Vault/KMS/secret manager tespit edilmedi (muhtemelen düz .env)", "Secret Management", "low", "config", "package.json", "secret manager bağımlılığı yok"),
    "D5P2": ("D5-no-ci", "CI/CD pipeline tespit edilmedi", "CI/CD", "high", "config", ".github/workflows | .gitlab-ci.yml", "CI yapılandırması bulunamadı"),
    "D5P3": ("D5-ci-no-test-gate", "CI var ama test/lint kapısı tespit edilmedi", "CI/CD", "medium", "config", "CI", "test/lint adımı görülmedi"),
    "D1P2": ("D1-no-restore-drill", "Yedek var ama test edilmiş restore prosedürü yok (DR)", "Backup & DR", "medium", "file", "backup", "restore/drill sinyali yok"),
    "D4P2": ("D4-no-soft-delete", "Kişisel veri modeli var ama soft-delete/silme izi tespit edilmedi", "Data Protection", "low", "config", "model şeması (prisma/django)", "deletedAt/is_deleted yok"),
}


def compliance_findings(files: DataFrame) -> DataFrame:
    """What a repository's signals lack (D1 to D5), and lines that name a card's code or number (D7)."""
    x = estate.compliance_findings(estate.compliance_signals(files))
    ci = files.where(F.col("path").rlike(estate.CI_FILE)).groupBy("repo_id").agg(F.min("path").alias("ci"))
    x = x.join(ci, "repo_id", "left")
    head, title, category, sure, kind, source, words = _named(x, F.concat("check", "severity"), _COMPLIANCE)
    source = F.when(head == "D5-ci-no-test-gate", F.coalesce("ci", source)).otherwise(source)
    lacks = recorded(x, "D", F.col("check"), category, sure, kind, head, title, source, words)
    lines = scan.lines(files.where(F.col("path").rlike(r.CODE_OR_SCHEMA) & ~F.col("path").rlike(r.CARD_SKIP) & (F.length("content") <= 1_000_000)))
    cards = scan.card_data_scan(lines, keep=("line",))
    line, cvv = F.col("line_no").cast("string"), F.col("kind") == "cvv"
    return lacks.unionByName(
        recorded(
            cards, "D", "D7", "PCI-DSS", F.when(cvv, "medium").otherwise("low"), "file", F.concat_ws(":", _said("D7-", F.col("kind"), "-storage"), "path", line),
            F.when(cvv, "CVV/CVC saklanıyor olabilir — PCI-DSS KESİNLİKLE YASAK").otherwise("Kart numarası (PAN) saklanıyor olabilir — maskeleme/tokenizasyon gerekir"), F.col("path"),
            F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, 160), F.when(cvv, "P0").otherwise("P1"), line,
        )
    )


# --- C: observations of hosts; the host stands for the repository.  Fixed values as above.
_EXPOSED = {
    "/.env": ("Açıkta .env dosyası",), "/.git/config": ("Açıkta .git/config",), "/.git/HEAD": ("Açıkta .git deposu (/.git/HEAD)",), "/.aws/credentials": ("Açıkta AWS credentials",), "/.terraform.tfstate": ("Açıkta Terraform state",), "/backup.sql": ("Açıkta SQL yedeği",),
    "/.npmrc": ("Açıkta .npmrc (token sızıntısı)",), "/swagger.json": ("Public Swagger/OpenAPI",), "/api-docs": ("Public API dokümantasyonu",), "/actuator/health": ("Açıkta Spring Actuator",), "/.DS_Store": ("Açıkta .DS_Store",),
}
_HEADERS = {"strict-transport-security": ("HSTS header yok",), "content-security-policy": ("Content-Security-Policy yok",), "x-frame-options": ("X-Frame-Options yok (clickjacking)",), "x-content-type-options": ("X-Content-Type-Options yok",)}


def response_findings(responses: DataFrame) -> DataFrame:
    """Of captured responses (page_id, host, path, status, headers, set_cookies, body): exposed files, absent headers, cookies' flags, open admin pages."""
    place = responses.select("page_id", F.col("host").alias("repo_id"), _said("https://", F.col("host"), F.col("path")).alias("url"), F.col("status").cast("string").alias("code"), F.substring("body", 1, 120).alias("start"))
    at = lambda found: found.join(place, "page_id")
    url, code, start = F.col("url"), F.col("code"), F.col("start")
    shown = at(observed.exposed_files(responses))
    a = recorded(shown, "C", "C1", "Exposed Sensitive File", "high", "endpoint", _said("C1-exposed:", F.col("path")), _named(shown, F.col("path"), _EXPOSED)[0], url, start, location=code)
    bare = at(observed.missing_headers(responses))
    b = recorded(bare, "C", "C2", "Security Header", "high", "endpoint", _said("C2-header:", F.col("header")), _named(bare, F.col("header"), _HEADERS)[0], url, _said("eksik: ", F.col("header")), location=code)
    cookies = at(observed.cookie_flags(responses))
    gone = F.replace("missing", F.lit(","), F.lit(", "))
    c = recorded(cookies, "C", "C6", "Cookie Security", "high", "endpoint", _said("C6-cookie:", F.col("cookie")), _said("Cookie '", F.col("cookie"), "' eksik bayrak: ", gone), url, _said(F.col("cookie"), ": eksik ", F.replace("missing", F.lit(","), F.lit("/"))), location=F.lit("Set-Cookie"))
    admin = at(observed.open_admin(responses).drop("host"))
    d = recorded(admin, "C", "C3", "Broken Access Control", "low", "endpoint", _said("C3-open-admin:", F.col("path")), _said("Korumasız admin paneli erişilebilir: ", F.col("path")), url, start, "P0", code)
    return a.unionByName(b).unionByName(c).unionByName(d)


def host_findings(handshakes: DataFrame, ports: DataFrame, now: Column) -> DataFrame:
    """Of handshakes (host, protocol, not_after) and open ports (host, port)."""
    # each handshake tells its own findings; joined by host, those of a host would meet each other
    told = observed.tls_findings(handshakes.select("host", "protocol", "not_after").distinct(), now, ("protocol", "not_after"))
    told = told.withColumn("days", t.days_until(F.col("not_after"), now)).withColumn("repo_id", F.col("host"))
    kind, days = F.col("finding"), F.abs("days").cast("string")
    head = F.when(kind == "weak-protocol", "C2-weak-tls:").when(kind == "expired", "C2-cert-expired:").otherwise("C2-cert-soon:")
    title = F.when(kind == "weak-protocol", _said("Zayıf TLS protokolü: ", F.col("protocol"))).when(kind == "expired", _said("TLS sertifikası SÜRESİ DOLMUŞ (", days, " gün önce)")).otherwise(_said("TLS sertifikası ", days, " gün içinde sona eriyor"))
    words = F.when(kind == "weak-protocol", F.col("protocol")).otherwise(_said("notAfter=", F.date_format("not_after", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))
    a = recorded(told, "C", "C2", "TLS", "high", "endpoint", _said(head, F.col("host")), title, _said(F.col("host"), ":443"), words)
    open_ = observed.open_ports(ports).withColumn("repo_id", F.col("host"))
    port = F.col("port").cast("string")
    b = recorded(open_, "C", "C5", "Open Port / Service", "high", "endpoint", F.concat_ws(":", F.lit("C5-open-port"), "host", port), _said("Hassas port açık: ", port, "/", F.col("service"), " (", F.col("host"), ")"), F.concat_ws(":", "host", port), _said(F.col("service"), " TCP connect başarılı"))
    return a.unionByName(b)


def rate_findings(log: DataFrame, seconds: int = 600, least: int = 5) -> DataFrame:
    """Of answers (host, path, url, ts, status) to bursts against one URL."""
    x = observed.rate_limit_absent(log, seconds, least).join(log.select("url", "host", "path").distinct(), "url").select(F.col("host").alias("repo_id"), "path", "url", F.col("served").cast("string").alias("served"))
    return recorded(x, "C", "C4", "Rate Limiting", "low", "endpoint", _said("C4-no-rate-limit:", F.col("path")), _said("Rate-limit tespit edilmedi: ", F.col("served"), " ardışık istek 429 almadı"), F.col("url"), F.col("served"), "P1")


# --- B: commits and other tools
_HISTORY = {"aws-key": ("AWS Access Key",), "private-key": ("Private key bloğu",), "provider-token": ("Sağlayıcı anahtarı",), "openai-key": ("OpenAI/Anthropic anahtarı",)}


def history_findings(logs: DataFrame) -> DataFrame:
    """Of logs of commits with their changes (repo_id, log): secrets in lines that were added once."""
    x = scan.history_secrets(feeds.added_lines(logs))
    commit = F.col("commit")
    return recorded(x, "B", "B1", "Secret", "high", "command", F.concat_ws(":", F.lit("B1-history-secret"), "commit", "pattern"), _said("Git geçmişinde secret: ", _named(x, F.col("pattern"), _HISTORY)[0]), _said("git-history@", commit), F.col("excerpt"), "P0", commit)


def sarif_findings(reports: DataFrame) -> DataFrame:
    x = imports.sarif(reports)
    tool = F.get("references", F.lit(0))
    module = imports.infer_module(F.regexp_extract("title", r"^\[([^\]]*)\]", 1))
    cves = F.filter(F.split("cves", ","), lambda c: c != "")
    return recorded(x, module, F.col("check"), _said("External · ", tool), "medium", F.when(F.col("source") == tool, "command").otherwise("file"), F.col("id"), F.col("title"), F.col("source"), F.col("excerpt"), location=F.col("line"), cves=cves)


def nuclei_findings(lines: DataFrame) -> DataFrame:
    x = imports.nuclei(lines)
    return recorded(x, "C", F.col("check"), "External · nuclei (DAST)", "medium", "endpoint", F.col("id"), F.col("title"), F.col("source"), F.substring(F.regexp_replace("title", r"^\[nuclei\] ", ""), 1, 200))


def dependency_findings(reports: DataFrame) -> DataFrame:
    """Of npm audit reports of either version."""
    return recorded(imports.npm_audit(reports), "B", "B2", "Vulnerable Component", "high", "command", F.col("id"), F.col("title"), "npm/pnpm audit", F.col("excerpt"))


def estate_scanners() -> tuple[Scanner, ...]:
    """Scanners of run_scan() for manifests (YAML that is JSON), parity and compliance."""
    manifests = lambda f: k8s_findings(f.where(F.col("path").rlike(r"(?i)\.ya?ml$") & ~F.col("path").rlike(r"(^|/)(node_modules|dist|build|vendor)/")).select("repo_id", "path", F.col("content").alias("doc")))
    return Scanner("K8S", manifests), Scanner("A", parity_findings), Scanner("D", compliance_findings)
