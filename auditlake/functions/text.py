"""Scalar functions of the findings model, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from auditlake.functions.patterns import has, may_match

# The patterns of secrets.
SECRET_KEY = r"[A-Za-z0-9_]*(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|client[_-]?secret|auth|bearer|session)[A-Za-z0-9_]*"
JWT = r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
AWS_ID = r"\bAKIA[0-9A-Z]{16}\b"
PROVIDER_TOKEN = (
    r"\b(?:sk_live_[0-9A-Za-z]{10,}|rk_live_[0-9A-Za-z]{10,}|AIza[0-9A-Za-z_\-]{35}|ghp_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,}|glpat-[0-9A-Za-z_\-]{20}|npm_[0-9A-Za-z]{36}"
    r"|SG\.[\w\-]{22}\.[\w\-]{43}|SK[0-9a-fA-F]{32}|xox[baprs]-[0-9A-Za-z-]{10,}|sk-ant-[0-9A-Za-z_\-]{20,}|sk-[A-Za-z0-9]{32,})\b"
)
LONG_HEX = r"\b[A-Fa-f0-9]{32,}\b"
URL_PASSWORD = r"(?i)(\b[a-z][a-z0-9+.-]*:\/\/[^\s:@/]+:)([^@\s/]+)(@)"
KEY_HINT = r"(?i)\b(?:secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|client[_-]?secret|password|passwd|pwd|auth|credential|bearer)\b"
PLACEHOLDER_VALUE = r"(?i)^(?:x{4,}|\.{3,}|<[^>]+>|\$\{[^}]+\}|process\.env|your[_-]|change[_-]?me|example|placeholder|dummy|test|todo|null|undefined|true|false)"

#: key, separator and value; a value over 8 characters keeps two at either end
KEY_VALUE = rf"(?i)({SECRET_KEY})(\s*[:=]\s*[\"']?)(?:([^\s\"']{{2}})[^\s\"']{{5,}}([^\s\"']{{2}})|[^\s\"']{{4,8}})"
#: what a match of it holds behind the word
KEY_NEAR = rf"(?i){SECRET_KEY.removeprefix('[A-Za-z0-9_]*')}\s*[:=]"

#: with a value of four characters or more; what may stand before the word makes no difference to whether there is a match
KEY_FILLED = rf"{KEY_NEAR}\s*[\"']?[^\s\"']{{4,}}"


def mask_value(x: Column) -> Column:
    """*** for up to 8 characters, else the first and last two around it; null stays null."""
    return F.when(F.length(x) <= 8, F.lit("***")).otherwise(F.concat(F.substring(x, 1, 2), F.lit("***"), F.right(x, F.lit(2))))


def mask_secrets(x: Column) -> Column:
    """Text with every secret masked; null stays null.

    Each mask is tried only where a cheap test finds what its matches must hold,
    as most texts hold no secret.  A step's text is bound once.
    """
    steps = [
        (lambda v: F.contains(v, F.lit("://")), lambda v: F.regexp_replace(v, URL_PASSWORD, "$1***$3")),
        (lambda v: (F.contains(v, F.lit(":")) | F.contains(v, F.lit("="))) & may_match(F.lower(v), KEY_NEAR) & v.rlike(KEY_NEAR), lambda v: F.regexp_replace(v, KEY_VALUE, "$1$2$3***$4")),
        (lambda v: F.contains(v, F.lit("eyJ")), lambda v: _mask_matches(v, JWT)),
        (lambda v: F.contains(v, F.lit("AKIA")), lambda v: _mask_matches(v, AWS_ID)),
        (lambda v: (F.length(v) >= 15) & v.rlike(PROVIDER_TOKEN), lambda v: _mask_matches(v, PROVIDER_TOKEN)),
        (lambda v: (F.length(v) >= 32) & v.rlike(LONG_HEX), lambda v: _mask_matches(v, LONG_HEX)),
    ]
    for test, mask in steps:
        x = _where(x, test, mask)
    return x


def _where(x: Column, test: Callable[[Column], Column], mask: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), lambda v: F.when(test(v), mask(v)).otherwise(v)), F.lit(0))


def _mask_matches(x: Column, pattern: str) -> Column:
    """Each match of a pattern through mask_value: split around the matches and put the masked ones between."""

    def masked(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(f"({pattern})"), 1), mask_value)
        joined = F.array_join(F.zip_with(F.split(v, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(v.rlike(pattern), joined).otherwise(v)

    # the value is bound once, or nested masks would repeat what is below them
    return F.get(F.transform(F.array(x), masked), F.lit(0))


def looks_like_secret(x: Column) -> Column:
    """Whether a text holds one of the six forms of a secret; each is tried only where the lower-cased text holds a string that it needs."""
    forms = (KEY_FILLED, JWT, AWS_ID, PROVIDER_TOKEN, LONG_HEX, URL_PASSWORD)
    bound = F.array(F.struct(x.alias("text"), F.lower(x).alias("low")))
    return F.get(F.transform(bound, lambda v: reduce(lambda a, b: a | b, (has(v["text"], v["low"], p) for p in forms))), F.lit(0))


def shannon_entropy(x: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(x)
    share = lambda c: (n - F.length(F.replace(x, c, F.lit("")))) / n
    parts = F.transform(F.array_distinct(F.split(x, "")), share)
    parts = F.filter(parts, lambda p: p > 0)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


@F.pandas_udf(DoubleType())
def text_entropy(x: pd.Series) -> pd.Series:
    """As shannon_entropy, for whole texts: code points are counted at once, in time linear in the length; null stays null."""

    def bits(text: str) -> float:
        counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
        p = counts / max(1, counts.sum())
        return float(-(p * np.log2(p)).sum()) if len(p) else 0.0

    return x.map(bits, na_action="ignore")


def to_host(url: Column) -> Column:
    """Lower-case host of a URL or of host[:port]; an address in brackets keeps them."""
    x = F.trim(F.lower(url))
    there = F.regexp_extract(x, r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    alone = F.when(~F.contains(x, F.lit("[")) & (F.size(F.split(x, ":", -1)) == 2), F.split_part(x, F.lit(":"), F.lit(1))).otherwise(x)
    return F.when(F.contains(x, F.lit("://")) & (there != ""), there).otherwise(alone)


# Hosts that are this machine.
LOOPBACK = "(?i)^(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|::1)$"


def base_url(target: Column) -> Column:
    """A URL without slashes at its end; a host gets https, or http if it is this machine."""
    host = F.trim(target)
    return F.when(target.rlike("(?i)^https?://"), F.regexp_replace(target, "/+$", "")).otherwise(F.concat(F.when(host.rlike(LOOPBACK), "http").otherwise("https"), F.lit("://"), host))


# What a service's name says of its role, the first that fits.
ROLES = [("(?i)worker|consumer|processor|signature", "worker/consumer"), ("(?i)producer|publisher", "producer"), ("(?i)scheduler|cron|beat", "scheduler"), ("(?i)api|web|server|app|backend", "api")]


def role_of_service(name: Column) -> Column:
    return F.coalesce(*(F.when(name.rlike(p), r) for p, r in ROLES), F.lit("service"))


def string_literals(x: Column) -> Column:
    """Contents of quoted literals of the three kinds, escapes included."""
    return F.regexp_extract_all(x, F.lit(r"(['\"`])((?:\\.|(?!\1)[^\\])*)\1"), 2)


def high_entropy_secret(line: Column) -> Column:
    """A line that names a secret and holds a literal of 20 or more characters, no placeholder, no blanks, 4 bits a character."""
    random = lambda s: (F.length(s) >= 20) & ~s.rlike(PLACEHOLDER_VALUE) & ~s.rlike(r"\s") & (shannon_entropy(s) >= 4.0)
    return line.rlike(KEY_HINT) & F.exists(string_literals(line), random)


def strip_comments(x: Column, hashes: bool = True) -> Column:
    """Block comments become a blank; // (not behind a colon) and, if ``hashes``, # behind white space go to the end of the line."""
    # each step is tried only where the text holds what it begins with
    steps = [("/*", r"/\*[\s\S]*?\*/", " "), ("//", r"(^|[^:])//[^\n]*", "$1"), *([("#", r"(^|\s)#[^\n]*", "$1")] if hashes else [])]
    for sign, pattern, to in steps:
        x = _where(x, lambda v, s=sign: F.contains(v, F.lit(s)), lambda v, p=pattern, to=to: F.regexp_replace(v, p, to))
    return x


def normalize_ws(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^ | $", "")


def fingerprint(module: Column, check: Column, title: Column, signatures: Column) -> Column:
    """First 16 hex digits of the SHA-1 of module, check, title and the sorted signatures."""
    return F.substring(F.sha1(F.concat_ws("|", module, check, title, F.concat_ws(",", F.array_sort(signatures)))), 1, 16)


def extract_cves(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(?i)(CVE-\d{4}-\d{3,7})"), 1), F.upper))


def sev_from_score(x: Column) -> Column:
    return F.when(x >= 9, "P0").when(x >= 7, "P1").when(x >= 4, "P2").otherwise("P3")


def sev_from_level(x: Column) -> Column:
    level = F.lower(F.coalesce(x, F.lit("warning")))
    return F.when(level == "error", "P1").when(level == "warning", "P2").otherwise("P3")


def sev_from_label(x: Column) -> Column:
    label = F.lower(x)
    return F.when(label == "critical", "P0").when(label == "high", "P1").when(label.isin("moderate", "medium"), "P2").otherwise("P3")


def severity_rank(x: Column) -> Column:
    return F.substring(x, 2, 1).cast("int")


def pkg_root(x: Column) -> Column:
    """@scope/name/x is @scope/name, a/b is a."""
    parts = F.split(x, "/")
    return F.when(x.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def sanitize_id(x: Column, size: int) -> Column:
    return F.substring(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "-"), 1, size)


def round1(x: Column) -> Column:
    """To one decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def days_until(to: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(to) - F.unix_millis(now)) / 86_400_000)
