"""What a repository is made of: stacks, migrations, backups, compliance signals, and checklists made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import round1
from auditlake.operators.exports import named_deps

# What tells a stack, as (name, path pattern, content pattern of those files); any row of a stack does.
STACKS = [
    ("prisma", r"^package\.json$", r'"(prisma|@prisma/client)"\s*:'),
    ("prisma", r"^prisma/schema\.prisma$", ""),
    ("drizzle", r"^package\.json$", r'"drizzle-orm"\s*:'),
    ("drizzle", r"^drizzle\.config\.(ts|js)$", ""),
    ("node", r"^package\.json$", ""),
    ("django", r"^(requirements\.txt|pyproject\.toml)$", "(?i)django"),
    ("django", r"^manage\.py$", ""),
    ("laravel", r"^composer\.json$", r"laravel/framework"),
    ("laravel", r"^artisan$", ""),
    ("dotnet", r"\.csproj$", ""),
    ("go", r"^go\.mod$", ""),
    ("docker", r"^(docker-)?compose\.ya?ml$|(^|/)Dockerfile([.-].+)?$", ""),
    ("cloudflare", r"^wrangler\.(toml|jsonc|json)$|(^|/)cloudflared.*\.(yml|yaml)$", ""),
]
# Mappers by stack, found in the same files.
MAPPERS = [
    ("prisma", r"^package\.json$", r'"(prisma|@prisma/client)"\s*:'), ("drizzle", r"^package\.json$", r'"drizzle-orm"\s*:'), ("typeorm", r"^package\.json$", r'"typeorm"\s*:'), ("knex", r"^package\.json$", r'"knex"\s*:'), ("sequelize", r"^package\.json$", r'"sequelize"\s*:'),
    ("django-orm", r"^(requirements\.txt|pyproject\.toml)$", "(?i)django"), ("eloquent", r"^composer\.json$", r"laravel/framework"), ("ef-core", r"\.csproj$", "EntityFrameworkCore"), ("gorm", r"^go\.mod$", r"gorm\.io/gorm"),
]
#: Stacks whose migrations are looked at, the first that a repository has.
MIGRATED = ["prisma", "django", "laravel", "dotnet", "go"]
_SQL = [(r"(?i)\bDROP\s+TABLE\b", "DROP TABLE", "P0"), (r"(?i)\bDROP\s+COLUMN\b", "DROP COLUMN", "P0"), (r"(?i)\bALTER\s+TABLE\b[\s\S]*?\bDROP\b", "ALTER TABLE DROP", "P0"), (r"(?i)\bTRUNCATE\b", "TRUNCATE", "P0")]
# Migrations by stack: their paths, paths left out, and the changes that destroy.
MIGRATIONS = {
    "prisma": (r"prisma/migrations/.+/migration\.sql$", "", _SQL),
    "django": (r"(^|/)migrations/[^/]+\.py$", r"__init__\.py$", [(r"migrations\.DeleteModel\b", "DeleteModel", "P0"), (r"migrations\.RemoveField\b", "RemoveField", "P0"), (r"migrations\.RenameField\b", "RenameField", "P1"), (r"migrations\.RenameModel\b", "RenameModel", "P1")]),
    "laravel": (r"database/migrations/[^/]+\.php$", "", [(r"Schema::dropIfExists\b", "dropIfExists", "P0"), (r"Schema::drop\b", "Schema::drop", "P0"), (r"->dropColumn\b", "dropColumn", "P0"), (r"->dropColumns\b", "dropColumns", "P0"), (r"->drop\(\)", "drop()", "P0")]),
    "dotnet": (r"(?i)(^|/)Migrations/[^/]+\.cs$|Migration.*\.cs$", "", [(r"migrationBuilder\.DropColumn\b", "DropColumn", "P0"), (r"migrationBuilder\.DropTable\b", "DropTable", "P0")]),
    "go": (r"(?i)(^|/)(migrations|migration|db/migrations|sql/migrations)/[^/]+\.sql$|\.up\.sql$", r"(?i)\.down\.sql$", _SQL),
}
# Names of dependencies, of which one begins a dependency's name, and what files and schemas say.
OBSERVABILITY = "@sentry/ @rollbar rollbar @datadog/ dd-trace @opentelemetry/ newrelic elastic-apm-node sentry-sdk ddtrace elastic-apm opentelemetry scout-apm sentry/sentry-laravel sentry/sentry bugsnag/bugsnag-laravel sentry serilog microsoft.applicationinsights github.com/getsentry/sentry-go go.opentelemetry.io github.com/datadog/dd-trace-go".split()
LOGGERS = "pino winston bunyan @nestjs/common structlog loguru monolog/monolog serilog".split()
SECRET_MANAGERS = "@aws-sdk/client-secrets-manager @azure/keyvault-secrets @google-cloud/secret-manager node-vault @hashicorp/ dotenv-vault hvac azure-keyvault-secrets google-cloud-secret-manager azure.security.keyvault.secrets azure.extensions.aspnetcore.configuration.secrets".split()
COOKIE_CONSENT = "react-cookie-consent vanilla-cookieconsent cookieconsent @osano/ klaro tarteaucitron".split()
CI_FILE, CI_TEST = r"(^|/)\.github/workflows/.+\.ya?ml$|(^|/)\.gitlab-ci\.yml$|(^|/)\.circleci/|(^|/)azure-pipelines\.yml$|(^|/)Jenkinsfile$", r"(?i)\b(test|vitest|jest|pytest|go test|phpunit|eslint|lint|playwright|cypress)\b"
BACKUP, RESTORE = r"(?i)backup|pg_dump|mysqldump|mongodump|dump\.sql", r"(?i)restore|pg_restore|mongorestore|mysql\s*<|drill"
SCHEMA, MODELS = r"schema\.prisma$", r"(^|/)models\.py$"
PERSON_MODEL, PERSON_FIELD = r"(?i)model\s+(User|Customer|Account|Person|Patient|Member|Client)\b|\bemail\b", r"(?i)email|EmailField|first_name|phone|tckimlik"
DJANGO_MODEL, SOFT_DELETE = r"class\s+\w+\(.*models\.Model.*\)", r"(?i)deletedAt|deleted_at|isDeleted|is_deleted"
PUSH, HAS_MODEL, SHADOW = r"prisma\s+db\s+push", r"\bmodel\s+\w+\s*\{", "shadowDatabaseUrl"


def _seen(path: str, content: str = "") -> Column:
    return F.col("path").rlike(path) & F.col("content").rlike(content) if content else F.col("path").rlike(path)


def _some(x: Column) -> Column:
    return F.coalesce(F.bool_or(x), F.lit(False))


def stack_profile(files: DataFrame) -> DataFrame:
    """repo_id, stacks, mappers (sorted arrays): every one that a file tells of, none excludes another."""
    names = lambda table: F.array(*(F.when(_seen(p, c), n) for n, p, c in table))
    both = files.select("repo_id", names(STACKS).alias("s"), names(MAPPERS).alias("m")).where("exists(s, x -> x IS NOT NULL) OR exists(m, x -> x IS NOT NULL)")
    # what a file adds is an array of a few names, and sets of them are partial aggregates
    found = lambda c: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(c)), lambda x: x.isNotNull())))
    got = both.groupBy("repo_id").agg(found("s").alias("stacks"), found("m").alias("mappers"))
    none = F.array().cast("array<string>")
    return files.select("repo_id").distinct().join(got, "repo_id", "left").select("repo_id", F.coalesce("stacks", none).alias("stacks"), F.coalesce("mappers", none).alias("mappers"))


def migration_stack(profile: DataFrame) -> DataFrame:
    """repo_id, stack: the one whose migrations count; null without any, whose layer is unknown."""
    return profile.select("repo_id", F.coalesce(*(F.when(F.array_contains("stacks", s), s) for s in MIGRATED)).alias("stack"))


def destructive_migrations(files: DataFrame, profile: DataFrame) -> DataFrame:
    """repo_id, path, stack, line_no (of the first), labels (joined), severity of migrations of the repository's stack that destroy."""
    lines = F.split("content", "\r?\n", -1)

    def of(stack: str) -> Column:
        path, skip, changes = MIGRATIONS[stack]
        ok = F.col("path").rlike(path) & (~F.col("path").rlike(skip) if skip else F.lit(True))
        hits = F.transform(lines, lambda v, i: F.filter(F.array(*(F.when(v.rlike(p), F.struct((i + 1).alias("line_no"), F.lit(n).alias("label"), F.lit(s).alias("severity"))) for p, n, s in changes)), lambda x: x.isNotNull()))
        return F.when(ok, F.struct(F.lit(stack).alias("stack"), F.flatten(hits).alias("hits")))

    x = files.select("repo_id", "path", F.explode(F.filter(F.array(*map(of, MIGRATIONS)), lambda v: v.isNotNull())).alias("m")).where("size(m.hits) > 0")
    hits = F.col("m.hits")
    x = x.select("repo_id", "path", "m.stack", F.array_min(F.transform(hits, lambda h: h["line_no"])).alias("line_no"), F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ", ").alias("labels"), F.array_min(F.transform(hits, lambda h: h["severity"])).alias("severity"))
    return x.join(migration_stack(profile), ["repo_id", "stack"], "left_semi").select("repo_id", "path", "stack", "line_no", "labels", "severity")


def schema_prisma(files: DataFrame, profile: DataFrame) -> DataFrame:
    """repo_id, finding, severity of repositories on this stack: a script that pushes the schema (P1), models without any migration (P1), migrations without a shadow database (P2)."""
    flags = prisma_flags(files).join(migration_stack(profile).where("stack = 'prisma'"), "repo_id", "left_semi")
    f = lambda ok, n, s: F.when(ok, F.struct(F.lit(n).alias("finding"), F.lit(s).alias("severity")))
    found = F.array(f(F.col("pushes"), "db-push", "P1"), f(F.col("models") & ~F.col("migrated"), "no-migrations", "P1"), f(F.col("migrated") & F.col("has_schema") & ~F.col("shadowed"), "no-shadow-db", "P2"))
    return flags.select("repo_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("repo_id", "f.*")


def prisma_flags(files: DataFrame) -> DataFrame:
    """repo_id, pushes, models, migrated, has_schema, shadowed: what scripts, schema and migrations tell."""
    push = (F.col("path") == "package.json") & F.get_json_object("content", "$.scripts").rlike(PUSH)
    return files.groupBy("repo_id").agg(_some(push).alias("pushes"), _some(_seen(SCHEMA, HAS_MODEL)).alias("models"), _some(F.col("path").rlike(MIGRATIONS["prisma"][0])).alias("migrated"), _some(_seen(SCHEMA) & (F.col("content") != "")).alias("has_schema"), _some(_seen(SCHEMA, SHADOW)).alias("shadowed"))


def schema_layers(files: DataFrame, profile: DataFrame) -> DataFrame:
    """repo_id, score, status, findings of the schema layer of repositories on this stack: 10 less 6 a destructive migration, 2.5 a graver and 1 a lighter finding.

    Without a schema score is null and status unknown; else risk with a
    destructive migration, warn with any finding, ok without.
    """
    own = migration_stack(profile).where("stack = 'prisma'").select("repo_id")
    broken = destructive_migrations(files, profile).where("stack = 'prisma'").select("repo_id", F.concat(F.lit("A2-destructive-migration:"), "path").alias("id"), F.lit("P0").alias("severity"))
    named = schema_prisma(files, profile).select("repo_id", F.concat(F.lit("A2-"), "finding").alias("id"), "severity")
    cost = F.when(F.col("severity") == "P0", 6.0).when(F.col("severity") == "P1", 2.5).otherwise(1.0)
    sums = broken.unionByName(named).groupBy("repo_id").agg(F.sum(cost).alias("cost"), F.count("*").alias("findings"), F.bool_or(F.col("severity") == "P0").alias("grave"))
    out = own.join(prisma_flags(files).select("repo_id", "has_schema"), "repo_id").join(sums, "repo_id", "left")
    score = F.when(F.col("has_schema"), round1(F.greatest(F.lit(0.0), 10 - F.coalesce("cost", F.lit(0.0)))))
    status = F.when(~F.col("has_schema"), "unknown").when(F.col("grave"), "risk").when(F.col("findings") > 0, "warn").otherwise("ok")
    return out.select("repo_id", score.alias("score"), status.alias("status"), F.coalesce("findings", F.lit(0)).alias("findings"))


def backup_flags(files: DataFrame) -> DataFrame:
    """repo_id, has_backup, has_restore, by names of files and by scripts of a manifest."""
    scripts = F.when(F.col("path") == "package.json", F.get_json_object("content", "$.scripts"))
    here = lambda p: _some(F.col("path").rlike(p) | F.coalesce(scripts.rlike(p), F.lit(False)))
    return files.groupBy("repo_id").agg(here(BACKUP).alias("has_backup"), here(RESTORE).alias("has_restore"))


def backup_restore(flags: DataFrame) -> DataFrame:
    """repo_id, severity of repositories that back up and name no way to restore."""
    return flags.where("has_backup AND NOT has_restore").select("repo_id", F.lit("P2").alias("severity"))


def compliance_signals(files: DataFrame) -> DataFrame:
    """One row a repository: what its dependencies, CI files, schemas and scripts tell."""
    own = ~F.contains("path", F.lit("/")) | F.col("path").endswith(".csproj")  # manifests at the root, project files anywhere
    x = files.withColumn("deps", F.coalesce(F.when(own, named_deps(F.col("path"))), F.array().cast("array<string>")))
    has = lambda table: _some(F.exists("deps", lambda d: F.lit(False) if not table else F.exists(F.array(*map(F.lit, table)), lambda n: d.startswith(n))))
    schema = F.col("path").rlike(SCHEMA) | F.col("path").rlike(MODELS)
    person = _seen(SCHEMA, PERSON_MODEL) | (_seen(MODELS, DJANGO_MODEL) & F.col("content").rlike(PERSON_FIELD))
    out = x.groupBy("repo_id").agg(
        has(OBSERVABILITY).alias("observed"), has(LOGGERS).alias("logs"), has(SECRET_MANAGERS).alias("keeps_secrets"), has(COOKIE_CONSENT).alias("asks_consent"), _some(F.col("path").rlike(CI_FILE)).alias("has_ci"), _some(_seen(CI_FILE, CI_TEST)).alias("ci_tests"),
        _some(person).alias("personal"), _some(schema & F.col("content").rlike(SOFT_DELETE)).alias("soft_delete"),
    )
    return out.join(backup_flags(files), "repo_id")


def compliance_findings(signals: DataFrame) -> DataFrame:
    """repo_id, check, severity of what a repository's signals lack."""
    f = lambda c, n, s: F.when(F.expr(c), F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity")))
    found = F.array(f("NOT observed", "D2", "P2"), f("NOT keeps_secrets", "D3", "P2"), f("NOT has_ci", "D5", "P2"), f("has_ci AND NOT ci_tests", "D5", "P3"), f("has_backup AND NOT has_restore", "D1", "P2"), f("personal AND NOT soft_delete", "D4", "P2"))
    return signals.select("repo_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select("repo_id", "f.*")


#: Checklists: control and its status as an expression on signals and card hits.
PCI = [
    ("PCI 3.2", "CASE WHEN cvv THEN 'fail' WHEN cards THEN 'pass' ELSE 'unknown' END"), ("PCI 3.3/3.4", "CASE WHEN pan THEN 'fail' WHEN cards THEN 'partial' ELSE 'unknown' END"), ("PCI 4.x", "'unknown'"), ("PCI 8.x", "'unknown'"),
    ("PCI 10.x", "CASE WHEN logs OR observed THEN 'partial' ELSE 'fail' END"),
]
PRIVACY = [
    ("GDPR Art.17 / KVKK", "CASE WHEN NOT personal THEN 'unknown' WHEN soft_delete THEN 'pass' ELSE 'fail' END"), ("GDPR Art.20", "'unknown'"), ("GDPR Art.7", "'unknown'"), ("ePrivacy", "CASE WHEN asks_consent THEN 'pass' ELSE 'unknown' END"), ("Retention", "'unknown'"),
]


def compliance_checklists(signals: DataFrame, cards: DataFrame) -> DataFrame:
    """repo_id, checklist, control, status of the card and privacy lists; cards (repo_id, kind) are hits of card data."""
    hits = cards.groupBy("repo_id").agg(_some(F.col("kind") == "cvv").alias("cvv"), _some(F.col("kind") == "pan").alias("pan"), F.lit(True).alias("cards"))
    x = signals.join(hits, "repo_id", "left").fillna(False, ["cvv", "pan", "cards"])
    rows = [F.struct(F.lit(n).alias("checklist"), F.lit(c).alias("control"), F.expr(s).alias("status")) for n, table in (("pci", PCI), ("privacy", PRIVACY)) for c, s in table]
    return x.select("repo_id", F.explode(F.array(*rows)).alias("r")).select("repo_id", "r.*")


# Controls of standards and the findings (id, check, module) that they speak of.
STANDARDS = [
    ("iso", "A.5.15", "check IN ('B5', 'E1', 'C3') OR id LIKE 'K8S-privileged%'"), ("iso", "A.8.8", "check IN ('B2')"), ("iso", "A.8.9", "check IN ('B7', 'B9', 'E5') OR module IN ('CLOUD', 'K8S')"), ("iso", "A.8.13", "id LIKE 'D1%' OR id LIKE 'A5-backup%'"),
    ("iso", "A.8.15", "check IN ('D2')"), ("iso", "A.8.24", "check IN ('B3', 'E2', 'B1', 'D3') OR id LIKE 'AI-3%'"), ("iso", "A.8.25", "check IN ('D5')"), ("iso", "A.8.28", "check IN ('B6')"),
    ("cis", "CIS Kubernetes", "module = 'K8S'"), ("cis", "CIS AWS", "check IN ('CLOUD-AWS')"), ("cis", "CIS Azure", "check IN ('CLOUD-AZ')"), ("cis", "CIS GCP", "check IN ('CLOUD-GCP')"), ("cis", "CIS Docker", "id LIKE 'A3-%'"),
]


def standards_checklists(findings: DataFrame) -> DataFrame:
    """repo_id, checklist, control, status (fail with a finding, else unknown), hits: one aggregate with partial counts for all controls."""
    sums = findings.groupBy("repo_id").agg(*(F.count_if(F.expr(c)).alias(f"n{i}") for i, (_, _, c) in enumerate(STANDARDS)))
    rows = [F.struct(F.lit(n).alias("checklist"), F.lit(c).alias("control"), F.when(F.col(f"n{i}") > 0, "fail").otherwise("unknown").alias("status"), F.col(f"n{i}").alias("hits")) for i, (n, c, _) in enumerate(STANDARDS)]
    return sums.select("repo_id", F.explode(F.array(*rows)).alias("r")).select("repo_id", "r.*")
