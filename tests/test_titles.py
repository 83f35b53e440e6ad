"""Fingerprints of line rules against the formula written out: titles are part of them."""

import hashlib

from auditlake.operators import findings, scan
from auditlake.operators import rules as r


def printed(*parts: str) -> str:
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def test_fingerprints_hold_titles(spark):
    files = spark.createDataFrame(
        [("r", "src/a.js", "let x = 1;\n  y =   eval(x)\n"), ("r", "main.tf", 'bucket = 1\n  acl = "public-read"'), ("r", "k.go", "h := md5.New()")],
        "repo_id string, path string, content string",
    )
    got = {x["id"].split(":")[0]: x for x in findings.run_scan(files, ["B", "CLOUD"]).collect()}
    x = got["B6-eval"]
    assert (x["id"], x["title"], x["category"]) == ("B6-eval:src/a.js:2", "eval() kullanımı (kod enjeksiyonu)", "Injection")
    assert x["fingerprint"] == printed("B", "B6", "eval() kullanımı (kod enjeksiyonu)", "src/a.js", "y = eval(x)")
    x = got["CLOUD-AWS-s3-public"]
    assert (x["category"], x["type"]) == ("Cloud / AWS", "config") and x["fingerprint"] == printed("CLOUD", "CLOUD-AWS", "Public S3 bucket ACL (AWS)", "main.tf", 'acl = "public-read"')
    assert got["B3-go-weak-hash"]["fingerprint"] == printed("B", "B3", "Zayıf hash (Go crypto/md5|sha1)", "k.go", "h := md5.New()")
    plain = {(x["id"], x["fingerprint"], x["title"], x["category"]) for x in scan.rule_scan(scan.code_files(files)).collect() if x["check"] != "B1"}
    assert plain == {(x["id"], x["fingerprint"], x["title"], x["category"]) for x in got.values() if x["module"] == "B" and x["check"] != "B1"}


def test_every_rule_is_titled():
    assert {x.id for x in r.SAST + r.CLOUD} == set(r.WORDS)
    own = r.Rule("X-my-rule", "X1", "B", "P2", "low", "foo")
    assert (own.title, own.category) == ("my rule", "X1")
