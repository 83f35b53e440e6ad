"""Trees of files with hidden names, against a walk of the same folders."""

import os

from auditlake.operators import findings
from auditlake.sources import files


def walked(root: str) -> set[tuple[str, str]]:
    out = set()
    for at, dirs, names in os.walk(root):
        rel = os.path.relpath(at, root)
        deep = 0 if rel == "." else rel.count("/") + 1
        dirs[:] = [d for d in dirs if d not in files.IGNORED and (not d.startswith(".") or d in files.DOTTED) and deep < files.DEPTH]
        out |= {(os.path.normpath(f"{rel}/{n}"), open(f"{at}/{n}", encoding="utf-8", errors="replace").read()) for n in names}
    return out


def test_read_trees(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "a two"
    for root in (one, two):
        for path in (".env", "_notes.txt", "src/.hidden/no.ts", "src/.eslintrc", ".github/workflows/ci.yml", "node_modules/x/i.js", "a/b/c/d/e.ts", "a/b/c/d/f/g.ts", "src/é x.ts", ".git/config", "src/packed.gz"):
            p = root / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(f"{root.name} {path}\r\nDB_PASSWORD=s3cr3tValue99\n")
    (one / "src/raw.bin").write_bytes(b"\xff\x00a")
    (two / "empty.ts").write_text("")
    roots = spark.createDataFrame([("r1", str(one)), ("r1", str(one)), ("r2", two.as_uri()), ("r3", str(tmp_path / "none")), ("r4", None)], "repo_id string, root string")
    got = files.read_trees(roots, tasks=3)
    rows = [(x["repo_id"], x["path"], x["content"].replace("\r\n", "\n")) for x in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {("r1", *x) for x in walked(str(one))} | {("r2", *x) for x in walked(str(two))}
    assert {p for r, p, _ in rows if r == "r1"} >= {".env", "_notes.txt", "src/.eslintrc", ".github/workflows/ci.yml", "a/b/c/d/e.ts"}
    found = findings.run_scan(got, ["B"]).where("id = 'B1-committed-dotenv'")
    assert sorted(x["repo_id"] for x in found.collect()) == ["r1", "r2"]
    assert files.read_trees(roots.limit(0)).count() == 0
