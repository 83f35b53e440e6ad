"""Registered queries of the application modules, with SQL made from the same tables of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import modules, scan
from auditlake.operators import rules as r
from auditlake.operators.module_rules import CHECKS, FLAGS, LIMIT, MANIFEST, MODULES, PATTERNS, Check
from auditlake.plans.queries import _lit, _mask_sql, query
from auditlake.sources import corpus
from auditlake.sources.corpus import APP_SQL

S, D = SparkSession, DataFrame


def _has(x: str, name: str) -> str:
    return f"regexp_matches({x}, {_lit(PATTERNS[name])})"


def _seen(name: str) -> str:
    """in_M and on_M of a module."""
    m = MODULES[name]
    skip = f"NOT regexp_matches(path, {_lit(m.skip)})"
    code = f"regexp_matches(path, {_lit(m.code)})"
    # RE2 has no flags in the middle of a pattern that hold from there on
    wide = f"({code} OR {' OR '.join(f'regexp_matches(path, {_lit(p)})' for p in m.more.split('|(?i)'))})".replace("'schema", "'(?i)schema").replace("'models", "'(?i)models") if m.more else code
    surface = " OR ".join(_has("content", s) for s in m.surface) or "true"
    return f"{wide} AND {skip} AS in_{name}, {code} AND {skip} AND ({surface}) AS on_{name}"


def _flag_sql() -> str:
    got = {n: f"{'on' if own else 'in'}_{m} AND {_has('bare' if bare else 'content', p)}" for n, (m, p, bare, own) in FLAGS.items()}
    got |= {f"uses_{n}": f"on_{n}" for n, m in MODULES.items() if not m.uses}
    got["uses_PRIV"] = got["priv_pii"]
    got["uses_AI"] = f"(in_AI OR path = 'package.json') AND {_has('content', 'AI_SDK')}"
    got["uses_PAY"] = f"on_PAY OR (regexp_matches(path, {_lit(MANIFEST)}) AND {_has('content', 'PAY_DEP')})"
    return f"flag AS (SELECT repo_id, {', '.join(f'bool_or({v}) AS {k}' for k, v in got.items())} FROM seen GROUP BY repo_id)"


_BARE = r"regexp_replace(regexp_replace(regexp_replace(content, '/\*[\s\S]*?\*/', ' ', 'g'), '(^|[^:])//[^\n]*', '\1', 'g'), '(^|\s)#[^\n]*', '\1', 'g')"
_SEEN = f"WITH {APP_SQL}, bared AS (SELECT *, {_BARE} AS bare FROM app WHERE length(content) <= {LIMIT}), seen AS (SELECT *, {', '.join(map(_seen, MODULES))} FROM bared), {_flag_sql()}"


def _when(c: Check, here: str) -> str:
    def one(name: str) -> str:
        scope, _, word = name.removeprefix("!").rpartition(":")
        text = {"file": "bare" if MODULES[c.module].bare else "content", "two": "two", "": here}.get(scope)
        is_ = word if scope == "repo" or c.level == "repo" else _has(text, word)
        return f"NOT {is_}" if name.startswith("!") else is_

    gate = "" if c.level == "repo" else f"on_{c.module} AND "
    return f"{gate}uses_{c.module} AND ({' OR '.join('(' + ' AND '.join(map(one, w)) + ')' for w in c.when)})"


def _files(spark: S, sf: str) -> tuple[D, D]:
    files = corpus.app_corpus(spark, sf)
    return files, modules.module_flags(files)


@query("module_flags", f"{_SEEN} SELECT * FROM flag")
def module_flags(spark: S, sf: str) -> D:
    return _files(spark, sf)[1]


@query("module_applicability", f"{_SEEN} SELECT repo_id, m AS module FROM (UNPIVOT (SELECT repo_id, {', '.join(f'uses_{m} AS {m}' for m in MODULES)} FROM flag) ON {', '.join(MODULES)} INTO NAME m VALUE v) WHERE v")
def module_applicability(spark: S, sf: str) -> D:
    flags = _files(spark, sf)[1]
    return flags.select("repo_id", F.explode(F.filter(F.array(*(F.when(F.col(f"uses_{m}"), m) for m in MODULES)), lambda v: v.isNotNull())).alias("module"))


def _rows(level: str, columns: str, of: str, here: str) -> str:
    return " UNION ".join(f"SELECT {columns.replace('$', here)}, {_lit(c.id)} AS \"check\", {_lit(c.severity)} AS severity FROM {of} WHERE {_when(c, here)}" for c in CHECKS if c.level == level)


@query("module_repo_checks", f"{_SEEN} {_rows('repo', 'repo_id', 'flag', '')}")
def module_repo_checks(spark: S, sf: str) -> D:
    return modules.repo_checks(_files(spark, sf)[1])


def _file_sql() -> str:
    parts = []
    for c in CHECKS:
        if c.level == "file":
            at = f"list_position(list_transform(string_split(content, chr(10)), lambda v: {_has('v', c.at)}), true)" if c.at else "NULL"
            parts.append(f"SELECT repo_id, path, {at}::INT AS line_no, {_lit(c.id)} AS \"check\", {_lit(c.severity)} AS severity FROM seen JOIN flag USING (repo_id) WHERE {_when(c, 'content')}")
    return f"{_SEEN} {' UNION ALL '.join(parts)}"


@query("file_absence_findings", _file_sql())
def file_absence_findings(spark: S, sf: str) -> D:
    return modules.file_checks(*_files(spark, sf))


def _lines_sql(where: str = "true") -> str:
    parts = []
    for bare in (False, True):
        text, own = "bare" if bare else "content", [c for c in CHECKS if c.level == "line" and MODULES[c.module].bare == bare]
        lines = f"(SELECT *, concat(line, ' ', coalesce(lead(line) OVER (PARTITION BY repo_id, path ORDER BY line_no), '')) AS two FROM (SELECT *, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS line_no FROM seen)) JOIN flag USING (repo_id)"
        parts += [f"SELECT repo_id, path, line_no, line, {_lit(c.id)} AS \"check\", {_lit(c.severity)} AS severity FROM {lines} WHERE {_when(c, 'line')}" for c in own]
    excerpt = _mask_sql(r"substring(regexp_replace(line, '^\s+|\s+$', '', 'g'), 1, 160)")
    return f"{_SEEN}, hit AS ({' UNION ALL '.join(parts)}) SELECT repo_id, path, line_no::INT AS line_no, \"check\", severity, {excerpt} AS excerpt FROM hit WHERE {where}"


@query("module_line_checks", _lines_sql())
def module_line_checks(spark: S, sf: str) -> D:
    return modules.line_checks(*_files(spark, sf))


@query("adjacent_line_match", _lines_sql("\"check\" IN ('UPLOAD-2', 'EMAIL-1', 'EMAIL-2')"))
def adjacent_line_match(spark: S, sf: str) -> D:
    """Line checks that look at the next line, too."""
    return modules.line_checks(*_files(spark, sf)).where(F.col("check").isin("UPLOAD-2", "EMAIL-1", "EMAIL-2"))


@query("payment_providers", f"WITH {APP_SQL} SELECT DISTINCT repo_id, unnest(list_transform(regexp_extract_all(content, {_lit(PATTERNS['PAY_DEP'])}, 1), lambda v: lower(v))) AS provider FROM app WHERE regexp_matches(path, {_lit(MANIFEST)})")
def payment_providers(spark: S, sf: str) -> D:
    return modules.payment_providers(corpus.app_corpus(spark, sf))


@query("local_webhooks", f"WITH {APP_SQL}, line AS (SELECT repo_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM app) SELECT repo_id, path, line_no, regexp_extract(line, {_lit(r.LOCAL_URL)}, 1) AS url FROM line WHERE regexp_matches(path, {_lit(r.CONFIG_FILE)}) AND regexp_matches(line, {_lit(r.WEBHOOK_KEY)}) AND regexp_matches(line, {_lit(r.LOCAL_URL)})")
def local_webhooks(spark: S, sf: str) -> D:
    return scan.local_webhooks(scan.lines(corpus.app_corpus(spark, sf)))


@query("handler_segments")
def handler_segments(spark: S, sf: str) -> D:
    """Braces are matched, which SQL cannot."""
    return modules.handler_segments(corpus.app_corpus(spark, sf)).select("repo_id", "path", "line_no", F.sha1("body").alias("body_sha1"))


@query("handler_stats")
def handler_stats(spark: S, sf: str) -> D:
    return modules.handler_stats(modules.handler_segments(corpus.app_corpus(spark, sf)))


@query("flow_checks")
def flow_checks(spark: S, sf: str) -> D:
    return modules.flow_checks(modules.handler_stats(modules.handler_segments(corpus.app_corpus(spark, sf))))
