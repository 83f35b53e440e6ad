"""The scalar functions as temporary SQL functions, with bodies in SQL, so that queries in spark.sql use them without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from auditlake.functions import text as t
from auditlake.functions.patterns import needed


def literal(x: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(low: str, pattern: str) -> str:
    """Whether a lower-cased text holds one of the strings that the pattern's matches need."""
    return "(" + " OR ".join(f"contains({low}, {literal(x)})" for x in needed(pattern)) + ")" if needed(pattern) else "true"


def _where(v: str, test: str, to: str) -> str:
    """``to`` where the test holds; the value is bound once, as w, or nested steps would repeat what is below them."""
    return f"get(transform(array({v}), w -> CASE WHEN {test} THEN {to} ELSE w END), 0)"


def _masked(v: str, pattern: str, gate: str) -> str:
    """v with each match of a pattern cut to its ends; tried only where the gate holds."""
    whole = literal(f"({pattern})")
    cut = "CASE WHEN length(m) <= 8 THEN '***' ELSE concat(substring(m, 1, 2), '***', right(m, 2)) END"
    joined = f"array_join(zip_with(split(w, {literal(pattern)}, -1), transform(regexp_extract_all(w, {whole}, 1), m -> {cut}), (a, b) -> concat(a, coalesce(b, ''))), '')"
    return _where(v, f"{gate} AND w RLIKE {literal(pattern)}", joined)


def _mask_secrets() -> str:
    x = _where("x", "contains(w, '://')", f"regexp_replace(w, {literal(t.URL_PASSWORD)}, '$1***$3')")
    near = f"(contains(w, ':') OR contains(w, '=')) AND get(transform(array(lower(w)), l -> {_any('l', t.KEY_NEAR)}), 0) AND w RLIKE {literal(t.KEY_NEAR)}"
    x = _where(x, near, f"regexp_replace(w, {literal(t.KEY_VALUE)}, '$1$2$3***$4')")
    for p, gate in ((t.JWT, "contains(w, 'eyJ')"), (t.AWS_ID, "contains(w, 'AKIA')"), (t.PROVIDER_TOKEN, "length(w) >= 15"), (t.LONG_HEX, "length(w) >= 32")):
        x = _masked(x, p, gate)
    return x


#: What a text that looks like a secret matches one of.
LOOKS = [rf"(?i){t.SECRET_KEY}\s*[:=]\s*[\"']?[^\s\"']{{4,}}", t.JWT, t.AWS_ID, t.PROVIDER_TOKEN, t.LONG_HEX, t.URL_PASSWORD]
_LOOKED = "get(transform(array(struct(x AS w, lower(x) AS l)), v -> " + " OR ".join(f"({_any('v.l', p)} AND v.w RLIKE {literal(p)})" for p in (t.KEY_FILLED, *LOOKS[1:])) + "), 0)"
_SHARES = "filter(transform(array_distinct(split(x, '')), c -> (length(x) - length(replace(x, c, ''))) / length(x)), p -> p > 0)"
_NO_BLOCKS = _where(_where("x", "contains(w, '/*')", r"regexp_replace(w, '/\\*[\\s\\S]*?\\*/', ' ')"), "contains(w, '//')", r"regexp_replace(w, '(^|[^:])//[^\\n]*', '$1')")

#: name: (parameters, type, body)
FUNCTIONS = {
    "mask_secrets": ("x STRING", "STRING", _mask_secrets()),
    "looks_like_secret": ("x STRING", "BOOLEAN", _LOOKED),
    "shannon_entropy": ("x STRING", "DOUBLE", f"CASE WHEN length(x) = 0 THEN 0D ELSE aggregate({_SHARES}, 0D, (a, p) -> a - p * log2(p)) END"),
    "strip_comments": ("x STRING", "STRING", _where(_NO_BLOCKS, "contains(w, '#')", r"regexp_replace(w, '(^|\\s)#[^\\n]*', '$1')")),
    "strip_comments_js": ("x STRING", "STRING", _NO_BLOCKS),
    "normalize_ws": ("x STRING", "STRING", r"regexp_replace(regexp_replace(x, '\\s+', ' '), '^ | $', '')"),
    "finding_fingerprint": ("module STRING, check_ STRING, title STRING, signatures ARRAY<STRING>", "STRING", "substring(sha1(concat_ws('|', module, check_, title, concat_ws(',', array_sort(signatures)))), 1, 16)"),
    "extract_cves": ("x STRING", "ARRAY<STRING>", r"array_distinct(transform(regexp_extract_all(x, '(?i)(CVE-\\d{4}-\\d{3,7})', 1), c -> upper(c)))"),
    "severity_from_score": ("x DOUBLE", "STRING", "CASE WHEN x >= 9 THEN 'P0' WHEN x >= 7 THEN 'P1' WHEN x >= 4 THEN 'P2' ELSE 'P3' END"),
    "severity_rank": ("x STRING", "INT", "CAST(substring(x, 2, 1) AS INT)"),
}


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS known to the session."""
    for name, (parameters, type_, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {type_} RETURN {body}")
