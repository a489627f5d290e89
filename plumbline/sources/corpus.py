"""The document collection: listing, globs, and the split into scanned, frozen and excluded.

A corpus is one DataFrame of files with a status, so that whatever is left out of a
check keeps its reason. It comes from a directory or from any DataFrame of
(path, text).
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.context import RunContext

EXTENSIONS = (".md", ".markdown")
SKIP_DIRS = ("node_modules", ".git")


class CorpusError(ValueError):
    pass


def is_markdown(path: str) -> bool:
    return path.lower().endswith(EXTENSIONS)


def expand_braces(glob: str) -> list[str]:
    """The globs that {a,b} stands for, the outermost first; braces without an end are letters."""
    start = glob.find("{")
    if start < 0:
        return [glob]
    depth, parts, at = 0, [], start + 1
    for i in range(start, len(glob)):
        c = glob[i]
        depth += (c == "{") - (c == "}")
        if (c == "," and depth == 1) or depth == 0:
            parts.append(glob[at:i])
            at = i + 1
        if depth == 0:
            return [x for part in parts for x in expand_braces(glob[:start] + part + glob[i + 1 :])]
    return [glob]


def glob_pattern(glob: str) -> str:
    """An anchored pattern, for Java and Python alike: ** crosses directories, * and ? do not."""
    out = []
    for g in expand_braces(glob):
        piece, i = "", 0
        while i < len(g):
            close = g.find("]", i + 1) if g[i] == "[" else -1
            if g.startswith("**/", i):
                piece, i = piece + "(?:[^/]+/)*", i + 3
            elif g.startswith("**", i):
                piece, i = piece + ".*", i + 2
            elif g[i] == "*":
                piece, i = piece + "[^/]*", i + 1
            elif g[i] == "?":
                piece, i = piece + "[^/]", i + 1
            elif close > 0:
                # a leading ! is a letter of the class, as is [
                inner = g[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                piece, i = piece + f"[{inner}]", close + 1
            else:
                piece, i = piece + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", g[i]), i + 1
        out.append(piece)
    return r"\A(?:" + "|".join(out) + r")\z"


def glob_matches(path: str, globs: list[str]) -> str | None:
    """The first glob that matches."""
    return next((g for g in globs if re.search(glob_pattern(g).replace(r"\z", r"\Z"), path)), None)


def first_glob(path: Column, globs: list[str]) -> Column:
    """The first glob that matches, or null."""
    if not globs:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(path.rlike(glob_pattern(g)), F.lit(g)) for g in globs])


def with_status(files: DataFrame, config: dict) -> DataFrame:
    """files (path, ...) with status (scanned, frozen or excluded), reason and frozen_by. Frozen wins over exclude."""
    docs = config["docs"]
    path = F.col("path")
    include, frozen, exclude = (first_glob(path, docs[k]) for k in ("include", "frozen", "exclude"))
    status = F.when(include.isNull(), "excluded").when(frozen.isNotNull(), "frozen").when(exclude.isNotNull(), "excluded").otherwise("scanned")
    reason = (
        F.when(include.isNull(), F.lit("no include glob matches (" + ", ".join(docs["include"]) + ")"))
        .when(frozen.isNotNull(), F.concat(F.lit("frozen by "), frozen, F.lit(": not to be edited, so not checked for drift")))
        .when(exclude.isNotNull(), F.concat(F.lit("excluded by "), exclude))
    )
    return files.withColumns({"status": status, "reason": reason, "frozen_by": F.when(status == "frozen", frozen)})


def list_directory(root: str, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(path, absolute path) of every Markdown file, and (path, reason) of what is left
    out. Links are not followed; names that start with . or _ count like others."""
    if not os.path.isdir(root):
        raise CorpusError(f"docs.root is no directory: {root}")
    files: list[tuple[str, str]] = []
    left: list[tuple[str, str]] = []

    def walk(at: str) -> None:
        rel = lambda p: os.path.relpath(p, root).replace(os.sep, "/")
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError as e:
            left.append((rel(at), f"unreadable directory ({e.strerror})"))
            return
        for e in entries:
            path = rel(e.path)
            if e.is_symlink():
                if is_markdown(path):
                    left.append((path, "symbolic link: not followed"))
            elif e.is_dir():
                if e.name in skip_dirs:
                    left.append((path, "directory skipped by default"))
                else:
                    walk(e.path)
            elif e.is_file() and is_markdown(path):
                files.append((path, e.path))

    walk(root)
    return files, left


@dataclass(frozen=True)
class Corpus:
    """files: path, abs_path, text, status, reason, frozen_by; others: path and reason of what was no candidate."""

    root: str
    files: DataFrame
    others: DataFrame

    @property
    def scanned(self) -> DataFrame:
        return self.files.where("status = 'scanned'")

    @property
    def frozen(self) -> DataFrame:
        return self.files.where("status = 'frozen'")

    @property
    def documents(self) -> DataFrame:
        """Scanned and frozen: what links and anchors may point to. In no order: results
        are sorted where they are shown, texts never."""
        return self.files.where("status <> 'excluded'").withColumn("frozen", F.col("status") == "frozen")

    @property
    def excluded(self) -> DataFrame:
        """path and reason of everything that isn't checked, frozen documents among them."""
        return self.files.where("status <> 'scanned'").select("path", "reason").unionByName(self.others).orderBy("path")


def load_corpus(spark: SparkSession, context: RunContext, skip_dirs: tuple[str, ...] = SKIP_DIRS) -> Corpus:
    """The corpus of a directory: globs are matched before any file is read, and files
    are read by the executors, which must see the directory."""
    listed, left = list_directory(context.docs_root, skip_dirs)
    files = with_status(spark.createDataFrame(listed, "path string, abs_path string"), context.config)

    def read(batches):
        for batch in batches:
            out = batch.to_pydict()
            out["text"] = []
            for i, (at, status) in enumerate(zip(out["abs_path"], out["status"], strict=True)):
                text = None
                if status != "excluded":
                    try:
                        with open(at, encoding="utf-8", errors="replace", newline="") as f:
                            text = f.read()
                    except OSError as e:
                        out["status"][i], out["reason"][i], out["frozen_by"][i] = "excluded", f"unreadable file ({e.strerror})", None
                out["text"].append(text)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})

    files = files.mapInArrow(read, "path string, abs_path string, status string, reason string, frozen_by string, text string")
    return Corpus(context.docs_root, files, spark.createDataFrame(left, "path string, reason string"))


def corpus_of(files: DataFrame, config: dict, root: str = "") -> Corpus:
    """The corpus of a DataFrame of (path, text): any source that Spark reads."""
    named = F.lower("path").rlike(r"\.(md|markdown)\z")
    rows = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    some = with_status(rows.where(named).withColumn("abs_path", F.col("path")), config)
    none = rows.where(~named).select("path", F.lit("no Markdown extension").alias("reason")).where("false")
    return Corpus(root, some.select("path", "abs_path", "status", "reason", "frozen_by", "text"), none)
