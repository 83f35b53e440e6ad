"""Checks of the application modules over files: repository flags, file and line findings, handler segments.

Each distinct text is looked at once for the booleans and the matching lines that
its checks need, and files take these by a digest of their text.  Flags are one
aggregate with partial results; findings that depend on a flag join it after they
are found.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from auditlake.functions import text as t
from auditlake.functions.patterns import has
from auditlake.operators.module_rules import AI_KEY_TITLES, CHECKS, CLIENT_CODE, CLIENT_FILE, CLIENT_PATH, FLAGS, LIMIT, MANIFEST, MODULES, NO_ANCHOR, PATTERNS, PAY_KEY, PAY_KEY_CLIENT, PAY_KEY_TEST, Check
from auditlake.sources.shared import durable


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _has(x: Column, name: str, low: Column | None = None) -> Column:
    """Whether a text has a pattern; whole texts come with themselves in lower case, so that strings are looked for first."""
    return x.rlike(PATTERNS[name]) if low is None else has(x, low, PATTERNS[name])


#: Columns of whole texts, with and without comments, and of these in lower case.
def _texts(bare: bool) -> tuple[Column, Column]:
    return (F.col("bare"), F.col("low_bare")) if bare else (F.col("content"), F.col("low"))


def _whole(name: str, bare: bool = False) -> Column:
    text, low = _texts(bare)
    return _has(text, name, low)


def _places() -> dict[str, Column]:
    """Per path and module: code_M, whether it is the module's code, and in_M, a candidate."""
    path, out = F.col("path"), {}
    for name, m in MODULES.items():
        code = path.rlike(m.code) & ~path.rlike(m.skip)
        out[f"code_{name}"] = code
        out[f"in_{name}"] = (path.rlike(m.code) | path.rlike(m.more)) & ~path.rlike(m.skip) if m.more else code
    return out


#: Patterns of whole texts that flags ask for besides those of FLAGS: the name of what is seen, the pattern, whether without comments.
_SEEN = {"sees_ai": ("AI_SDK", False), "sees_dep": ("PAY_DEP", False), "sees_pii": ("PII", True)}


def _texts_of(files: DataFrame) -> DataFrame:
    """Each distinct content once: content, digest, bare (without comments), both in lower case, and surface_M, whether it has module M's surface.

    What is seen in a text hangs on the text alone and costs far more than moving
    it, and files are often copies of each other; so a text is looked at once,
    however many files have it.
    """
    out = files.where(F.length("content") <= LIMIT).select("content").distinct().withColumn("digest", _digest()).withColumn("bare", t.strip_comments(F.col("content")))
    out = out.withColumn("low", F.lower("content")).withColumn("low_bare", F.lower("bare"))
    return out.withColumns({f"surface_{n}": _any([_whole(s) for s in m.surface]) if m.surface else F.lit(True) for n, m in MODULES.items()})


def _digest() -> Column:
    return F.sha2("content", 256)


def _seen_columns() -> list[Column]:
    """Per text: surface_M, what each flag asks of it, and whether it says that it runs at the client's."""
    own = {n: (p, bare) for n, (_, p, bare, _) in FLAGS.items()} | _SEEN
    return [*(F.col(f"surface_{m}") for m in MODULES), *(_whole(p, bare).alias(f"has_{n}") for n, (p, bare) in own.items()), F.col("content").rlike(CLIENT_CODE).alias("has_client")]


def _placed(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files with what is seen in their texts, code_M, in_M and on_M (code with the module's surface); contents stay behind."""
    at = files.where(F.length("content") <= LIMIT).select("repo_id", "path", _digest().alias("digest"), *(c.alias(n) for n, c in _places().items()))
    return at.join(texts, "digest").withColumns({f"on_{m}": F.col(f"code_{m}") & F.col(f"surface_{m}") for m in MODULES})


def _flag_columns() -> dict[str, Column]:
    """Per file, on _placed(): what makes each flag of its repository true."""
    got = {n: F.col(f"{'on' if own else 'in'}_{m}") & F.col(f"has_{n}") for n, (m, _, _, own) in FLAGS.items()}
    got |= {f"uses_{n}": F.col(f"on_{n}") for n, m in MODULES.items() if not m.uses}
    got["uses_PRIV"] = got["priv_pii"]
    got["uses_AI"] = (F.col("in_AI") | (F.col("path") == "package.json")) & F.col("has_sees_ai")
    got["uses_PAY"] = F.col("on_PAY") | (F.col("path").rlike(MANIFEST) & F.col("has_sees_dep"))
    return got


def module_flags(files: DataFrame) -> DataFrame:
    """One row a repository: the flags, and uses_M, whether module M applies."""
    return flags_of(_looked(files, _texts_of(files).select("digest", *_seen_columns()))).drop(*(f"a_{m}" for m in _anchors()))


#: Files at which a repository's findings stand: code with the module's surface (for AI, and as said of PRIV, any that names its data).
def _anchors() -> dict[str, Column]:
    return {m: F.col("on_PRIV") & F.col("has_sees_pii") if m == "PRIV" else F.col(f"on_{m}") for m in MODULES if any(c.module == m and c.level == "repo" for c in CHECKS)}


def _looked(files: DataFrame, texts: DataFrame) -> DataFrame:
    """One row a file: repo_id, path, client, its part of each flag, a_M, and its hits if its text has them."""
    x = _placed(files, texts).withColumn("client", F.col("path").rlike(CLIENT_PATH) | F.col("has_client") | F.col("path").rlike(CLIENT_FILE))
    got = _flag_columns() | {f"a_{m}": c for m, c in _anchors().items()}
    # a hit of a text is one of the file if the file is code of the check's module
    of_check = F.array(*(F.col(f"code_{c.module}") for c in CHECKS))
    hits = [F.filter("hits", lambda h: F.get(of_check, h["n"])).alias("hits")] if "hits" in texts.columns else []
    return x.select("repo_id", "path", "client", *(c.alias(n) for n, c in got.items()), *hits)


def looked_at(files: DataFrame) -> DataFrame:
    """One row a file: repo_id, path, client, its part of each flag, a_M (whether module M's findings may stand at it), and hits.

    Contents are looked at once, each distinct one for itself; what that gives is
    small, written to the shared folder, and joined with the files by a digest,
    from which both flags and findings are made.
    """
    return _looked(files, durable(_texts_of(files).select("digest", *_seen_columns(), _hits().alias("hits"))))


def flags_of(seen: DataFrame) -> DataFrame:
    """module_flags() of looked_at() files, with a_M, the first path at which module M's findings may stand."""
    some = lambda n: F.coalesce(F.bool_or(n), F.lit(False)).alias(n)
    return seen.groupBy("repo_id").agg(*map(some, _flag_columns()), *(F.min(F.when(F.col(f"a_{m}"), F.col("path"))).alias(f"a_{m}") for m in _anchors()))


def payment_providers(files: DataFrame) -> DataFrame:
    """Distinct repo_id, provider that manifests name."""
    names = F.regexp_extract_all("content", F.lit(PATTERNS["PAY_DEP"]), 1)
    return files.where(F.col("path").rlike(MANIFEST)).select("repo_id", F.explode(F.transform(names, F.lower)).alias("provider")).distinct()


def _flagged(name: str) -> Column:
    return ~F.col(name[1:]) if name.startswith("!") else F.col(name)


def repo_checks(flags: DataFrame, anchors: bool = False) -> DataFrame:
    """repo_id, check, severity of what a repository has and lacks, and with ``anchors`` (flags of flags_of()) the path at which it stands."""
    hit = lambda c: F.col(f"uses_{c.module}") & _any([_all([_flagged(n) for n in w]) for w in c.when])
    at = lambda c: [F.coalesce(F.col(f"a_{c.module}"), F.lit(NO_ANCHOR[c.module])).alias("anchor")] if anchors else []
    found = F.filter(F.array(*(F.when(hit(c), F.struct(F.lit(c.id).alias("check"), F.lit(c.severity).alias("severity"), *at(c))) for c in CHECKS if c.level == "repo")), lambda x: x.isNotNull())
    return flags.select("repo_id", F.explode(found).alias("f")).select("repo_id", "f.*")


def _holds(when: tuple[str, ...], here: Column | None) -> Column:
    """Whether a line (with the next one, and both in lower case), or a whole file (``here`` is null), meets what a check asks of it; flags of the repository are joined later."""
    parts = []
    for name in when:
        scope, _, word = name.removeprefix("!").rpartition(":")
        if scope == "repo":
            continue
        is_ = _whole(word) if here is None else _has(here["two"], word, here["low_two"]) if scope == "two" else _has(here["line"], word, here["low"])
        parts.append(~is_ if name.startswith("!") else is_)
    return _all(parts)


def _hits() -> Column:
    """Array of (check's number, line_no, line) of a text of _texts_of(), flags of the repository and the file's path aside.

    A line check is tried on lines only where the text has the module's surface,
    what else the check asks of the file, and a match anywhere of each pattern
    that the line itself must have.  Lines are split once, and each is seen with
    the next one by a shifted copy of the array: time is linear in the text.
    """
    none = F.lit(None).cast("string")

    def first(name: str) -> Column:
        found = F.filter(F.transform(F.split("content", "\r?\n", -1), lambda v, i: F.when(_has(v, name), i + 1)), lambda v: v.isNotNull())
        return F.get(found, F.lit(0)).cast("int")

    def of_file(i: int, c: Check) -> Column:
        ok = F.col(f"surface_{c.module}") & _any([_holds(w, None) for w in c.when])
        return F.when(ok, F.struct(F.lit(i).alias("n"), (first(c.at) if c.at else F.lit(None).cast("int")).alias("line_no"), none.alias("line")))

    def may(c: Check, w: tuple[str, ...]) -> Column:
        bare, parts = MODULES[c.module].bare, [F.lit(True)]
        for name in w:
            scope, _, word = name.removeprefix("!").rpartition(":")
            if scope == "file":
                parts.append(~_whole(word, bare) if name.startswith("!") else _whole(word, bare))
            elif not scope and not name.startswith("!"):
                parts.append(has(*_texts(bare), PATTERNS[word], "(?m)"))
        return _all(parts)

    def of_lines(bare: bool) -> Column:
        own = [(i, c) for i, c in enumerate(CHECKS) if c.level == "line" and MODULES[c.module].bare == bare]
        ways = [(i, c, w) for i, c in own for w in c.when]
        bit = {(i, w): 1 << k for k, (i, _, w) in enumerate(ways)}
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"surface_{c.module}") & may(c, w), F.lit(bit[i, w]).cast("long")).otherwise(F.lit(0).cast("long")) for i, c, w in ways))
        local = {w: tuple(n for n in w if not n.removeprefix("!").startswith(("file:", "repo:"))) for _, _, w in ways}

        def tried(lines: Column, bits: Column) -> Column:
            two = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: F.struct(a.alias("line"), F.concat(a, F.lit(" "), F.coalesce(b, F.lit(""))).alias("two")))
            two = F.transform(two, lambda v: F.struct(v["line"].alias("line"), v["two"].alias("two"), F.lower(v["line"]).alias("low"), F.lower(v["two"]).alias("low_two")))

            def at(v: Column, i: Column) -> Column:
                open_ = lambda n, c, w: (bits.bitwiseAND(F.lit(bit[n, w]).cast("long")) != 0) & _holds(local[w], v)
                met = F.filter(F.array(*(F.when(_any([open_(n, c, w) for w in c.when]), F.lit(n)) for n, c in own)), lambda x: x.isNotNull())
                return F.transform(met, lambda n: F.struct(n.alias("n"), (i + 1).alias("line_no"), v["line"].alias("line")))

            return F.flatten(F.filter(F.transform(two, at), lambda x: F.size(x) > 0))

        # the text's lines and bits are bound once, or each line would split the text again
        bound = F.transform(F.array(F.struct(F.split(_texts(bare)[0], "\r?\n", -1).alias("lines"), bits.alias("bits"))), lambda b: F.when(b["bits"] != 0, tried(b["lines"], b["bits"])))
        return F.coalesce(F.get(bound, F.lit(0)), F.array().cast("array<struct<n:int,line_no:int,line:string>>"))

    files = F.filter(F.array(*(of_file(i, c) for i, c in enumerate(CHECKS) if c.level == "file")), lambda v: v.isNotNull())
    return F.concat(files, of_lines(False), of_lines(True))


def hits_of(seen: DataFrame, flags: DataFrame) -> DataFrame:
    """repo_id, path, line_no, check, severity, line, own_title of the hits of looked_at() files whose module applies and whose flags hold."""
    table = seen.sparkSession.createDataFrame([(i, c.id, c.severity) for i, c in enumerate(CHECKS)], "n int, check string, severity string")
    out = seen.select("repo_id", "path", "client", F.explode("hits").alias("h")).select("repo_id", "path", "client", "h.*").join(F.broadcast(table), "n")  # as many rows as checks
    live = F.col("line").rlike(PATTERNS["KEY_LIVE"])
    env = ~F.col("line").rlike(PATTERNS["KEY_TEST"])
    pay = F.when(F.col("client") & (live | env), PAY_KEY_CLIENT).when(live | env, PAY_KEY).otherwise(PAY_KEY_TEST)
    keys = F.filter(F.array(*(F.when(F.col("line").rlike(p), title) for p, title in AI_KEY_TITLES.items())), lambda x: x.isNotNull())
    titles = F.when(F.col("check") == "PAY-1", F.array(pay)).when(F.col("check") == "AI-3", keys).otherwise(F.array(F.lit(None).cast("string")))
    return _kept(out, flags).select("repo_id", "path", "line_no", "check", "severity", "line", F.explode(titles).alias("own_title"))


def _kept(found: DataFrame, flags: DataFrame) -> DataFrame:
    """Findings whose module applies and whose flags hold."""
    ok = F.lit(True)
    for c in CHECKS:
        need = [n.partition("repo:")[2] for w in c.when for n in w if "repo:" in n]
        ok = ok & ((F.col("check") != c.id) | _all([F.col(f"uses_{c.module}"), *map(F.col, need)]))
    return found.join(flags, "repo_id").where(ok)


def file_checks(files: DataFrame, flags: DataFrame) -> DataFrame:
    """repo_id, path, line_no (null if no line is named), check, severity."""
    return hits_of(looked_at(files), flags).where(F.col("line").isNull()).select("repo_id", "path", "line_no", "check", "severity")


def line_checks(files: DataFrame, flags: DataFrame) -> DataFrame:
    """repo_id, path, line_no, check, severity, excerpt (masked)."""
    out = hits_of(looked_at(files), flags).where(F.col("line").isNotNull()).drop("own_title").distinct()
    return out.select("repo_id", "path", "line_no", "check", "severity", t.mask_secrets(F.substring(F.regexp_replace("line", r"^\s+|\s+$", ""), 1, 160)).alias("excerpt"))


# --- handlers: what stands between a handler's braces
# Where handlers begin, and what their bodies do.
ANCHOR = r"\b(app|router)\.(get|post|put|patch|delete)\s*\([^)]*?(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>\s*\{|\b(async\s+)?function\s+\w+\s*\([^)]*\)\s*\{|@(Post|Put|Patch|Delete|Get)\s*\([^)]*\)[\s\S]{0,120}?\b\w+\s*\([^)]*\)\s*\{"
MUTATION = r"(?i)\.(create|createMany|update|updateMany|upsert|delete|deleteMany|save|insert|insertMany|remove|destroy|findOneAndUpdate|findByIdAndUpdate)\s*\(|INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM"
TRANSACTION = r"(?i)\$transaction|\.transaction\s*\(|sequelize\.transaction|getManager\(\)\.transaction|manager\.transaction|BEGIN\b|START\s+TRANSACTION|unitOfWork|db\.transaction|knex\.transaction|withTransaction|runInTransaction|prisma\.\$transaction|@Transaction"
ATOMIC = r"(?i)\bincrement\b|\bdecrement\b|\$inc\b|increment\s*:|decrement\s*:|FOR\s+UPDATE|SELECT[\s\S]{0,80}FOR\s+UPDATE|findOneAndUpdate|\.raw\s*\(|sql`[^`]*[-+]=|lock\s*:\s*|SELECT\s+FOR\s+UPDATE"
READ_MODIFY, SAVED = r"(\w+)\.(\w+)\s*(?:\+=|-=)\s*|(\w+)\.(\w+)\s*=\s*\.?\s*[-+]\s*|(\w+)\.(\w+)\s*=\s*\w+\.\w+\s*[-+]", r"(?i)\.(save|update)\s*\("
IDEMPOTENT = r"(?i)idempotency[_-]?key|idempotencyKey|Idempotency-Key|X-Idempotency|Request-Id|\.upsert\s*\(|findFirst[\s\S]{0,80}(already|exist)|ON\s+CONFLICT|unique\s*:\s*true|dedupe|deduplicat"
CRITICAL, CREATES, IS_POST = r"(?i)\b(order|booking|reservation|transfer|checkout|enrol|enroll|invoice|payout|withdraw|shipment)\b", r"(?i)\.(create|insert|save)\s*\(", r"(?i)\b(app|router)\.post\s*\(|@Post\b"
#: Characters of a body at most, of one whose braces don't close, and before and behind its start that tell what it answers.
BODY, OPEN_BODY, BEFORE, BEHIND = 12_000, 3_000, 200, 40
_SCRIPT = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs)$"
_SKIP = MODULES["WEB"].skip
_SEGMENT = ArrayType(StructType([StructField("line_no", IntegerType()), StructField("body", StringType()), StructField("near", StringType()), StructField("change_line", IntegerType())]))
# What a write is called on, and names that say nothing of it.
MUTATED, UNNAMED = r"(?i)(\w+)\.(create|createMany|update|updateMany|upsert|delete|deleteMany|save|insert|insertMany|remove|destroy|findOneAndUpdate|findByIdAndUpdate)\s*\(", ["prisma", "db", "this", "await"]


def segments(code: str) -> list[tuple[int, str, str, int]]:
    """(line, body with its braces, text around its start, line of its first read-modify-write or else its own) of each handler, outermost ones only."""
    out, at, anchor = [], 0, re.compile(ANCHOR)
    while m := anchor.search(code, at):
        begin = m.end() - 1
        depth, end = 0, None
        for brace in re.finditer(r"[{}]", code[begin : begin + BODY]):
            depth += 1 if brace.group() == "{" else -1
            if depth == 0:
                end = begin + brace.end()
                break
        body = code[begin : end if end is not None else begin + OPEN_BODY]
        first = code.find(body)
        line, change = code.count("\n", 0, m.start()) + 1, re.search(READ_MODIFY, body)
        out.append((line, body, code[max(0, first - BEFORE) : first + BEHIND], code.count("\n", 0, first + change.start()) + 1 if change else line))
        at = begin + len(body)
    return out


@F.pandas_udf(_SEGMENT)
def _segments(code: pd.Series) -> pd.Series:
    return code.map(lambda c: [dict(zip(("line_no", "body", "near", "change_line"), s)) for s in segments(c or "")])


def handler_segments(files: DataFrame) -> DataFrame:
    """repo_id, path, line_no, body, near, change_line of the handlers in scripts with a web surface; braces are matched in Python, as patterns cannot."""
    x = files.where(F.col("path").rlike(_SCRIPT) & ~F.col("path").rlike(_SKIP) & (F.length("content") <= LIMIT))
    x = x.select("repo_id", "path", t.strip_comments(F.col("content"), hashes=False).alias("code")).where(F.col("code").rlike(PATTERNS["FLOW_SURFACE"]))
    return x.select("repo_id", "path", F.explode(_segments("code")).alias("s")).select("repo_id", "path", "s.*")


def handler_stats(segs: DataFrame) -> DataFrame:
    """repo_id, path, line_no, change_line, mutations, targets (what is written to, in order, or ?), and whether the body has a transaction, an atomic change, a read-modify-write, a key against repeats."""
    b = F.col("body")
    targets = F.array_except(F.array_distinct(F.transform(F.regexp_extract_all(b, F.lit(MUTATED), 1), F.lower)), F.array(*map(F.lit, UNNAMED)))
    return segs.select(
        "repo_id", "path", "line_no", "change_line", F.when(F.size(targets) > 0, F.array_join(targets, ", ")).otherwise("?").alias("targets"), F.regexp_count(b, F.lit(MUTATION)).alias("mutations"), b.rlike(TRANSACTION).alias("in_transaction"), b.rlike(ATOMIC).alias("is_atomic"), (b.rlike(READ_MODIFY) & b.rlike(SAVED)).alias("rewrites"),
        b.rlike(IDEMPOTENT).alias("is_idempotent"), (b.rlike(CREATES) & b.rlike(CRITICAL) & F.col("near").rlike(IS_POST)).alias("posts_critical"),
    )


def flow_checks(stats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """repo_id, path, line_no, check, severity of handlers, and the columns named in ``keep``."""
    found = [
        F.when((F.col("mutations") >= 2) & ~F.col("in_transaction"), F.struct(F.lit("FLOW-1").alias("check"), F.lit("P1").alias("severity"))),
        F.when(F.col("rewrites") & ~F.col("in_transaction") & ~F.col("is_atomic"), F.struct(F.lit("FLOW-2").alias("check"), F.lit("P1").alias("severity"))),
        F.when(F.col("posts_critical") & ~F.col("is_idempotent"), F.struct(F.lit("FLOW-3").alias("check"), F.lit("P2").alias("severity"))),
    ]
    return stats.select("repo_id", "path", "line_no", *keep, F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("f")).select("repo_id", "path", "line_no", *keep, "f.*")
