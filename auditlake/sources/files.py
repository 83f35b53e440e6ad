"""Files and runs as tables: the corpus of a tree of files, keys of environment files, the run before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are not looked into, and those with a leading dot that are.
IGNORED = ["node_modules", ".git", "dist", "build", ".next", ".turbo", "vendor", "__pycache__", ".venv", "venv"]
DOTTED = [".github", ".circleci", ".gitlab"]
#: Folders between the root and a file, at most.
DEPTH = 4


def file_corpus(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Rows (path relative to the root, with /) of a table of files that lie in no ignored or hidden folder and at most ``depth`` folders deep."""
    dirs = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    out = F.exists(dirs, lambda d: d.isin(IGNORED) | (d.startswith(".") & ~d.isin(DOTTED)))
    return files.where(~out & (F.size(dirs) <= depth))


def read_corpus(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """repo_id, path, content of a folder of text files, without those that file_corpus leaves out.

    Spark's file sources don't list names that begin with . or _; of those, the
    root's folders of DOTTED are read, and no files.  read_trees() has them all.
    """
    named = ",".join(f"/{x}" for x in DOTTED)
    x = spark.read.text(f"{root.rstrip('/')}{{,{named}}}", wholetext=True, recursiveFileLookup=True)
    full = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    path = F.regexp_extract(full, "\\Q" + root.rstrip("/").removeprefix("file://") + "/\\E(.*)$", 1)
    return file_corpus(x.select(F.lit(repo_id).alias("repo_id"), F.url_decode(path).alias("path"), F.col("value").alias("content")))


def _place(root: str, path: str):
    """The file system of a root (a path or URI) and where a path below it lies."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return system, f"{base.rstrip('/')}/{path}".rstrip("/") or "/"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in folders (repo_id, root, path): the same columns with is_dir, a batch a folder."""
    from pyarrow import fs

    for b in batches:
        for repo, root, path in zip(*(b.column(i).to_pylist() for i in range(3))):
            system, at = _place(root, path)
            found = [x for x in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if x.type != fs.FileType.NotFound]
            names = [f"{path}/{x.base_name}" if path else x.base_name for x in found]
            yield pa.RecordBatch.from_pydict({"repo_id": pa.array([repo] * len(found), pa.string()), "root": pa.array([root] * len(found), pa.string()), "path": pa.array(names, pa.string()), "is_dir": pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_())})


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repo_id, path, content of files (repo_id, root, path), a batch a file, so that a task holds one."""
    for b in batches:
        for repo, root, path in zip(*(b.column(i).to_pylist() for i in range(3))):
            system, at = _place(root, path)
            with system.open_input_stream(at, compression=None) as f:
                text = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_pydict({"repo_id": pa.array([repo], pa.string()), "path": pa.array([path], pa.string()), "content": pa.array([text], pa.string())})


def read_trees(roots: DataFrame, depth: int = DEPTH, tasks: int | None = None) -> DataFrame:
    """repo_id, path, content of the files below roots (repo_id, root), with those whose names begin with . or _, and without those that file_corpus leaves out.

    A root is a path that the executors see or a URI; one that isn't there, or is
    null, gives nothing, and roots of one repository are read each.  Folders are
    listed level by level, each level and the files spread by path over ``tasks``
    tasks (the session's shuffle partitions, if not given), so that a repository of
    any size is no task's own.  Bytes that are no UTF-8 become U+FFFD.
    """
    tasks = tasks or int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("repo_id", "root", "path")
    at = roots.where("root IS NOT NULL").select(F.col("repo_id").cast("string").alias("repo_id"), F.col("root").cast("string").alias("root"), F.lit("").alias("path")).distinct()
    name, levels = F.substring_index("path", "/", -1), []
    for _ in range(depth + 1):
        found = at.repartition(tasks, *keys).mapInArrow(_entries, "repo_id string, root string, path string, is_dir boolean")
        levels.append(found)
        at = found.where(F.col("is_dir") & ~name.isin(IGNORED) & (~name.startswith(".") | name.isin(DOTTED))).select(*keys)
    files = levels[0]
    for x in levels[1:]:
        files = files.unionByName(x)
    return files.where("NOT is_dir").select(*keys).repartition(tasks, *keys).mapInArrow(_contents, "repo_id string, path string, content string")


def env_keys(files: DataFrame) -> DataFrame:
    """repo_id, kind, key of environment files (repo_id, kind, content): what stands before the first =, without blank lines and comments."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    line = files.select("repo_id", "kind", F.explode(F.split("content", "\r?\n")).alias("line")).select("repo_id", "kind", trim("line").alias("line"))
    return line.where(~F.startswith("line", F.lit("#"))).select("repo_id", "kind", trim(F.split_part("line", F.lit("="), F.lit(1))).alias("key")).where("key != ''")


def previous_run(findings: DataFrame, scan_col: str, before: int | str) -> DataFrame:
    """Findings of each repository's latest scan before the given one; none for a first run."""
    old = findings.where(F.col(scan_col) < before)
    last = old.groupBy("repo_id").agg(F.max(scan_col).alias(scan_col))
    return old.join(last, ["repo_id", scan_col])
