"""Registered queries on what repositories are made of, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import estate, rollup, scan
from auditlake.operators import rules as r
from auditlake.plans.queries import _lit, query
from auditlake.sources import corpus
from auditlake.sources.corpus import ESTATE_SQL

S, D = SparkSession, DataFrame
_FILES = f"WITH {ESTATE_SQL}"


def _seen(path: str, content: str = "") -> str:
    return f"regexp_matches(path, {_lit(path)})" + (f" AND regexp_matches(content, {_lit(content)})" if content else "")


def _names(table: list, to: str) -> str:
    return f"SELECT DISTINCT repo_id, n AS {to} FROM ({' UNION ALL '.join(f'SELECT repo_id, {_lit(n)} AS n FROM estate WHERE {_seen(p, c)}' for n, p, c in table)})"


_STACKS = f"stack AS ({_names(estate.STACKS, 'stack')}), mapper AS ({_names(estate.MAPPERS, 'mapper')}), repo AS (SELECT DISTINCT repo_id FROM estate)"
_FIRST = f"first AS (SELECT repo_id, arg_min(stack, list_position([{corpus.quoted(estate.MIGRATED)}], stack)) AS stack FROM stack WHERE stack IN ({corpus.quoted(estate.MIGRATED)}) GROUP BY repo_id)"


@query("stack_profile", f"{_FILES}, {_STACKS} SELECT repo_id, coalesce((SELECT string_agg(stack, ',' ORDER BY stack) FROM stack s WHERE s.repo_id = repo.repo_id), '') AS stacks, coalesce((SELECT string_agg(mapper, ',' ORDER BY mapper) FROM mapper m WHERE m.repo_id = repo.repo_id), '') AS mappers FROM repo")
def stack_profile(spark: S, sf: str) -> D:
    return estate.stack_profile(corpus.estate_corpus(spark, sf)).select("repo_id", F.array_join("stacks", ",").alias("stacks"), F.array_join("mappers", ",").alias("mappers"))


@query("migration_stack", f"{_FILES}, {_STACKS}, {_FIRST} SELECT repo_id, stack FROM repo LEFT JOIN first USING (repo_id)")
def migration_stack(spark: S, sf: str) -> D:
    return estate.migration_stack(estate.stack_profile(corpus.estate_corpus(spark, sf)))


def _migration_sql() -> str:
    parts = []
    for stack, (path, skip, changes) in estate.MIGRATIONS.items():
        gone = f" AND NOT regexp_matches(path, {_lit(skip)})" if skip else ""
        parts += [f"SELECT repo_id, path, {_lit(stack)} AS stack, line_no, {_lit(n)} AS label, {_lit(s)} AS severity FROM line WHERE regexp_matches(path, {_lit(path)}){gone} AND regexp_matches(line, {_lit(p)})" for p, n, s in changes]
    return f"""{_FILES}, {_STACKS}, {_FIRST}, line AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM estate), hit AS ({' UNION ALL '.join(parts)})
SELECT repo_id, path, stack, min(line_no)::INT AS line_no, array_to_string(list_sort(list_distinct(list(label))), ', ') AS labels, min(severity) AS severity FROM hit JOIN first USING (repo_id, stack) GROUP BY repo_id, path, stack"""


@query("destructive_migrations", _migration_sql())
def destructive_migrations(spark: S, sf: str) -> D:
    files = corpus.estate_corpus(spark, sf)
    return estate.destructive_migrations(files, estate.stack_profile(files))


_PRISMA = f"flag AS (SELECT repo_id, bool_or(path = 'package.json' AND regexp_matches(coalesce(json_extract(CASE WHEN path = 'package.json' THEN content ELSE '{{}}' END, '$.scripts')::VARCHAR, ''), {_lit(estate.PUSH)})) AS pushes, bool_or({_seen(estate.SCHEMA, estate.HAS_MODEL)}) AS models, bool_or({_seen(estate.MIGRATIONS['prisma'][0])}) AS migrated, bool_or({_seen(estate.SCHEMA)}) AS has_schema, bool_or({_seen(estate.SCHEMA, estate.SHADOW)}) AS shadowed FROM estate GROUP BY repo_id), own AS (SELECT * FROM flag JOIN first USING (repo_id) WHERE stack = 'prisma')"


@query("schema_prisma", f"{_FILES}, {_STACKS}, {_FIRST}, {_PRISMA} SELECT repo_id, 'db-push' AS finding, 'P1' AS severity FROM own WHERE pushes UNION ALL SELECT repo_id, 'no-migrations', 'P1' FROM own WHERE models AND NOT migrated UNION ALL SELECT repo_id, 'no-shadow-db', 'P2' FROM own WHERE migrated AND has_schema AND NOT shadowed")
def schema_prisma(spark: S, sf: str) -> D:
    files = corpus.estate_corpus(spark, sf)
    return estate.schema_prisma(files, estate.stack_profile(files))


def _layers_sql() -> str:
    path, _, changes = estate.MIGRATIONS["prisma"]
    broken = " OR ".join(f"list_bool_or(list_transform(string_split(content, chr(10)), lambda v: regexp_matches(v, {_lit(p)})))" for p, _, _ in changes)
    return f"""{_FILES}, {_STACKS}, {_FIRST}, {_PRISMA}, bad AS (SELECT repo_id, count(DISTINCT path) AS n FROM estate WHERE regexp_matches(path, {_lit(path)}) AND ({broken}) GROUP BY repo_id),
s AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(n, 0) + pushes::INT + (models AND NOT migrated)::INT + (migrated AND has_schema AND NOT shadowed)::INT AS findings FROM own o LEFT JOIN bad USING (repo_id))
SELECT repo_id, CASE WHEN has_schema THEN (floor(greatest(0, 10 - 6 * n - 2.5 * pushes::INT - 2.5 * (models AND NOT migrated)::INT - (migrated AND has_schema AND NOT shadowed)::INT) * 10 + 0.5) / 10)::DOUBLE END AS score, CASE WHEN NOT has_schema THEN 'unknown' WHEN n > 0 THEN 'risk' WHEN findings > 0 THEN 'warn' ELSE 'ok' END AS status, findings FROM s"""


@query("schema_layers", _layers_sql())
def schema_layers(spark: S, sf: str) -> D:
    files = corpus.estate_corpus(spark, sf)
    return estate.schema_layers(files, estate.stack_profile(files))


def _here(p: str) -> str:
    scripts = "coalesce(json_extract(CASE WHEN path = 'package.json' THEN content ELSE '{}' END, '$.scripts')::VARCHAR, '')"
    return f"bool_or({_seen(p)} OR regexp_matches({scripts}, {_lit(p)}))"


_BACKUP = f"backup AS (SELECT repo_id, {_here(estate.BACKUP)} AS has_backup, {_here(estate.RESTORE)} AS has_restore FROM estate GROUP BY repo_id)"


@query("backup_restore", f"{_FILES}, {_BACKUP} SELECT repo_id, 'P2' AS severity FROM backup WHERE has_backup AND NOT has_restore")
def backup_restore(spark: S, sf: str) -> D:
    return estate.backup_restore(estate.backup_flags(corpus.estate_corpus(spark, sf)))


def _signals_sql() -> str:
    has = lambda t: f"bool_or(list_bool_or(list_transform(deps, lambda d: list_bool_or(list_transform([{corpus.quoted(t)}], lambda n: starts_with(d, n))))))"
    c = f"(regexp_matches(path, {_lit(estate.SCHEMA)}) OR regexp_matches(path, {_lit(estate.MODELS)})) AND regexp_matches(content, {_lit(estate.SOFT_DELETE)})"
    person = f"({_seen(estate.SCHEMA, estate.PERSON_MODEL)}) OR ({_seen(estate.MODELS, estate.DJANGO_MODEL)} AND regexp_matches(content, {_lit(estate.PERSON_FIELD)}))"
    got = {"observed": has(estate.OBSERVABILITY), "logs": has(estate.LOGGERS), "keeps_secrets": has(estate.SECRET_MANAGERS), "asks_consent": has(estate.COOKIE_CONSENT), "has_ci": f"bool_or({_seen(estate.CI_FILE)})", "ci_tests": f"bool_or({_seen(estate.CI_FILE, estate.CI_TEST)})", "personal": f"bool_or({person})", "soft_delete": f"bool_or({c})"}
    low = lambda x: f"list_transform({x}, lambda v: lower(v))"
    keys = lambda a, b: f"list_concat(coalesce(json_keys(content, {_lit(a)}), []), coalesce(json_keys(content, {_lit(b)}), []))"
    found = lambda p: f"regexp_extract_all(content, {_lit(p)}, 1)"
    pip = r"list_filter(list_transform(string_split(content, chr(10)), lambda v: regexp_extract(trim(v), '^([^=<>!~;\[\s]*)', 1)), lambda v: v != '' AND NOT starts_with(v, '#'))"
    toml = "list_concat(" + found(r"""(?m)^\s*["']?([A-Za-z0-9_.-]+)["']?\s*=\s*["']""") + ", " + found(r"""["']([A-Za-z0-9_.-]+)\s*[><=~]""") + ")"
    deps = (
        f"CASE WHEN path = 'package.json' THEN {keys('$.dependencies', '$.devDependencies')} WHEN path = 'composer.json' THEN {low(keys('$.require', '$."require-dev"'))} WHEN path = 'requirements.txt' THEN {low(pip)} WHEN path = 'pyproject.toml' THEN {low(toml)} "
        f"WHEN path = 'go.mod' THEN {low(found(r'(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v'))} WHEN regexp_matches(path, '\\.csproj$') THEN {low(found('<PackageReference\\s+Include="([^"]+)"'))} ELSE [] END"
    )
    return f"dep AS (SELECT *, {deps} AS deps FROM estate), {_BACKUP}, signal AS (SELECT * FROM (SELECT repo_id, {', '.join(f'coalesce({v}, false) AS {k}' for k, v in got.items())} FROM dep GROUP BY repo_id) JOIN backup USING (repo_id))"


@query("compliance_signals", f"{_FILES}, {_signals_sql()} SELECT * FROM signal")
def compliance_signals(spark: S, sf: str) -> D:
    return estate.compliance_signals(corpus.estate_corpus(spark, sf))


@query("compliance_findings", f"{_FILES}, {_signals_sql()} " + " UNION ALL ".join(f"SELECT repo_id, '{n}' AS \"check\", '{s}' AS severity FROM signal WHERE {c}" for n, s, c in (("D2", "P2", "NOT observed"), ("D3", "P2", "NOT keeps_secrets"), ("D5", "P2", "NOT has_ci"), ("D5", "P3", "has_ci AND NOT ci_tests"), ("D1", "P2", "has_backup AND NOT has_restore"), ("D4", "P2", "personal AND NOT soft_delete"))))
def compliance_findings(spark: S, sf: str) -> D:
    return estate.compliance_findings(estate.compliance_signals(corpus.estate_corpus(spark, sf)))


_CARDS = f"card AS (SELECT repo_id, bool_or(regexp_matches(content, {_lit(r.CVV)})) AS cvv, bool_or(regexp_matches(content, {_lit(r.PAN)})) AS pan FROM estate WHERE regexp_matches(path, {_lit(r.CODE_OR_SCHEMA)}) AND NOT regexp_matches(path, {_lit(r.CARD_SKIP)}) GROUP BY repo_id), carded AS (SELECT s.*, coalesce(cvv, false) AS cvv, coalesce(pan, false) AS pan, coalesce(cvv OR pan, false) AS cards FROM signal s LEFT JOIN card USING (repo_id))"


@query("compliance_checklists", f"{_FILES}, {_signals_sql()}, {_CARDS} " + " UNION ALL ".join(f"SELECT repo_id, '{n}' AS checklist, {_lit(c)} AS control, {s} AS status FROM carded" for n, t in (("pci", estate.PCI), ("privacy", estate.PRIVACY)) for c, s in t))
def compliance_checklists(spark: S, sf: str) -> D:
    files = corpus.estate_corpus(spark, sf)
    return estate.compliance_checklists(estate.compliance_signals(files), scan.card_data_scan(scan.lines(files)))


@query(
    "checklists_all",
    f"""{_FILES}, {_signals_sql()}, {_CARDS}, finding AS (SELECT repo_id, '' AS id, 'D2' AS "check", 'D' AS module, 'ASVS 2.' || (length(repo_id) % 3) AS reference FROM signal WHERE NOT observed), r AS (SELECT DISTINCT repo_id FROM finding),
item AS ({" UNION ALL ".join(f"SELECT repo_id, '{n}' AS checklist, {_lit(c)} AS control, {s} AS status FROM carded" for n, t in (("pci", estate.PCI), ("privacy", estate.PRIVACY)) for c, s in t)}
UNION ALL SELECT repo_id, 'asvs', c, CASE WHEN EXISTS (SELECT 1 FROM finding f WHERE f.repo_id = r.repo_id AND f.reference = 'ASVS ' || c) THEN 'fail' ELSE 'unknown' END FROM r, (SELECT unnest([{corpus.quoted(rollup.ASVS)}]) AS c)
UNION ALL {" UNION ALL ".join(f"SELECT repo_id, '{n}', '{c}', CASE WHEN count(*) FILTER (WHERE {w.replace('check IN', chr(34) + 'check' + chr(34) + ' IN')}) > 0 THEN 'fail' ELSE 'unknown' END FROM finding GROUP BY repo_id" for n, c, w in estate.STANDARDS)}),
score AS (SELECT repo_id, checklist, CASE WHEN count(*) FILTER (WHERE status != 'unknown') > 0 THEN floor((count(*) FILTER (WHERE status = 'pass') + 0.5 * count(*) FILTER (WHERE status = 'partial')) / count(*) FILTER (WHERE status != 'unknown') * 100 + 0.5)::BIGINT END AS score FROM item GROUP BY ALL)
SELECT * FROM item JOIN score USING (repo_id, checklist)""",
)
def checklists_all(spark: S, sf: str) -> D:
    """Card, privacy, application, ISO and CIS lists of each repository in one table."""
    files = corpus.estate_corpus(spark, sf)
    signals = estate.compliance_signals(files)
    found = estate.compliance_findings(signals).where(F.col("check") == "D2").select("repo_id", F.lit("").alias("id"), "check", F.lit("D").alias("module"), F.concat(F.lit("ASVS 2."), (F.length("repo_id") % 3).cast("string")).alias("reference"))
    own = estate.compliance_checklists(signals, scan.card_data_scan(scan.lines(files)))
    asvs = rollup.asvs_checklist(found).withColumn("checklist", F.lit("asvs"))
    return rollup.checklists_all([own, asvs, estate.standards_checklists(found)])


_FOUND = f"WITH {corpus.findings_sql()}, f AS (SELECT *, regexp_extract(id, '^([A-Z0-9]+)', 1) AS \"check\" FROM finding)"


@query("standards_checklists", f"{_FOUND}, n AS (SELECT repo_id, " + ", ".join(f"count(*) FILTER (WHERE {c.replace('check IN', chr(34) + 'check' + chr(34) + ' IN')}) AS n{i}" for i, (_, _, c) in enumerate(estate.STANDARDS)) + " FROM f GROUP BY repo_id) " + " UNION ALL ".join(f"SELECT repo_id, '{n}' AS checklist, '{c}' AS control, CASE WHEN n{i} > 0 THEN 'fail' ELSE 'unknown' END AS status, n{i} AS hits FROM n" for i, (n, c, _) in enumerate(estate.STANDARDS)))
def standards_checklists(spark: S, sf: str) -> D:
    return estate.standards_checklists(corpus.findings(spark, sf).withColumn("check", F.regexp_extract("id", "^([A-Z0-9]+)", 1)))
