"""Documents to check: tables, URLs, files, folders, globs, texts, and lists of them.

Every source gives ``contents`` (source, source_kind, file_type, content) and, where
reading can fail, rows with a null content and an error_kind. File contents are read by
Spark's binary file source, in parallel and from any file system it knows.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.config import TYPE_EXTENSIONS, LinkCheckConfig
from linkloom.functions import uri as U
from linkloom.functions.filters import matches_any

CONTENTS = "source string, source_kind string, file_type string, content string"


def classify(text: str, exists=os.path.exists) -> str:
    """Kind of an input: stdin, url, glob or file; raises ValueError for what is none of them."""
    if text == "-":
        return "stdin"
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    if m and len(m[1]) > 1:  # one letter is a drive
        return "url"
    if re.search(r"[*?]|\[[^\]]+\]", text) and not exists(text):
        return "glob"
    if exists(os.path.expanduser(text)):
        return "file"
    raise ValueError(f"Input '{text}' not found as file and not a valid URL. Use full URL (e.g., https://example.com) or check file path.")


def distinct_inputs(texts: Iterable[str]) -> list[str]:
    """Inputs as a set, in the order of their first mention."""
    return list(dict.fromkeys(texts))


def distinct_sources(contents: DataFrame) -> DataFrame:
    """The same for a table of any size: source."""
    return contents.select("source").distinct()


def from_table(table: DataFrame, source: str, content: str, kind: str = "url", file_type: str | None = None) -> DataFrame:
    """Rows of any table as documents; a null content is an empty one."""
    name = F.col(source).cast("string")
    return table.select(name.alias("source"), F.lit(kind).alias("source_kind"), (F.lit(file_type) if file_type else U.file_type(name)).alias("file_type"), F.coalesce(F.col(content), F.lit("")).alias("content"))


def from_texts(spark: SparkSession, texts: Sequence[str], kind: str = "string", hint: str = "plaintext") -> DataFrame:
    """Standard input or raw strings."""
    return spark.createDataFrame([("<stdin>" if kind == "stdin" else t, kind, hint, t) for t in texts], CONTENTS)


def from_urls(urls: DataFrame, http_snapshot: DataFrame) -> DataFrame:
    """Remote documents by their GET response: url, source columns, or error_kind for those without 2xx."""
    asked = urls.select(F.col("url").alias("source")).distinct().withColumn("url_nofrag", U.strip_fragment(F.col("source")))
    answers = http_snapshot.where("method = 'GET'").groupBy("url_nofrag").agg(F.min(F.struct(F.col("status").isNull(), "status", "body")).alias("_a"))
    rows = asked.join(answers.select("url_nofrag", "_a.status", "_a.body"), "url_nofrag", "left")
    fine = F.col("status").between(200, 299)
    error = F.when(F.col("status").isNull(), "NetworkRequest").when(~fine, "ReadInputUrlStatusCode")
    return rows.select("source", F.lit("url").alias("source_kind"), U.file_type(F.col("source")).alias("file_type"), F.when(fine, F.coalesce("body", F.lit(""))).alias("content"), error.alias("error_kind"))


def read_files(spark: SparkSession, paths: Sequence[str], exclude_path: Sequence[str] = (), hint: str | None = None, skip_missing: bool = False) -> DataFrame:
    """Files as they are named, whatever their extension, with error_kind and error_text. Files that are no UTF-8 are left out.

    A path that is not there is a row with a null content and an error, or no row with
    ``skip_missing``; the others are read all the same. Spark's sources pass over names
    that begin with a dot or an underscore; such files are opened by the tasks
    themselves, so they have to be on a file system that all mount.
    """
    there, gone = [], []
    for p in distinct_inputs(paths):
        (there if _exists(spark, p) else gone).append(p)
    passed_over = [p for p in there if os.path.basename(p)[:1] in (".", "_")]
    rest = [p for p in there if os.path.basename(p)[:1] not in (".", "_")]
    parts = []
    if rest:
        parts.append(spark.read.format("binaryFile").load(rest).select("path", "content"))
    if passed_over:
        parts.append(_opened(spark.createDataFrame([(p,) for p in passed_over], "path string")))
    errors = "error_kind string, error_text string"
    found = spark.createDataFrame([], f"{CONTENTS}, {errors}")
    if parts:
        binary = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        none = F.lit(None).cast("string")
        found = _decoded(binary, exclude_path, hint).withColumns({"error_kind": none, "error_text": none})
    if gone and not skip_missing:
        lost = spark.createDataFrame([(p, "file", None, None, "ReadFileInput", f"Cannot read input content from file '{p}'") for p in gone], f"{CONTENTS}, {errors}")
        lost = lost.withColumn("file_type", U.file_type(F.col("source")))
        found = found.unionByName(lost.where(~matches_any(F.col("source"), exclude_path)) if exclude_path else lost)
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, in any file system that Spark knows, is there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _opened(paths: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return paths.mapInArrow(run, "path string, content binary")


def _decoded(binary: DataFrame, exclude_path: Sequence[str], hint: str | None) -> DataFrame:
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = binary.select(path.alias("source"), "content")
    if exclude_path:
        rows = rows.where(~matches_any(F.col("source"), exclude_path))
    known = U.file_type(F.col("source"))
    by_extension = F.regexp_extract(F.lower("source"), r"\.([a-z0-9]+)$", 1).isin(*TYPE_EXTENSIONS, "qmd", "rmd")
    kind = F.when(by_extension, known).otherwise(F.lit(hint)) if hint else known
    rows = rows.where(F.is_valid_utf8(F.col("content").cast("string")))
    return rows.select("source", F.lit("file").alias("source_kind"), kind.alias("file_type"), F.col("content").cast("string").alias("content"))


def read_glob(spark: SparkSession, pattern: str, ignore_case: bool = False, hidden: bool = False, exclude_path: Sequence[str] = (), hint: str | None = None) -> DataFrame:
    """Files that match a glob; extensions do not matter, hidden ones need ``hidden``."""
    pattern = os.path.expanduser(pattern)
    if ignore_case:
        pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in pattern)
    found = expand_glob(pattern, hidden)
    return read_files(spark, found, exclude_path, hint)


def expand_glob(pattern: str, hidden: bool = False) -> list[str]:
    import glob

    return sorted(p for p in glob.glob(pattern, recursive=True, include_hidden=hidden) if os.path.isfile(p))


def read_folder(spark: SparkSession, path: str, extensions: Sequence[str] = TYPE_EXTENSIONS, hidden: bool = False, no_ignore: bool = False, exclude_path: Sequence[str] = (), hint: str | None = None) -> DataFrame:
    """A folder and all below it: files with one of the extensions that no ignore file names."""
    return read_files(spark, list(walk(path, extensions, hidden, no_ignore)), exclude_path, hint)


def read_inputs(spark: SparkSession, texts: Iterable[str], config: LinkCheckConfig, http_snapshot: DataFrame | None = None, stdin: str = "") -> DataFrame:
    """All inputs that a user names, under the options of the configuration: contents with error_kind and error_text.

    ``files_from`` adds the lines of a file; ``default_extension`` is the type of files
    whose own extension says nothing; with ``skip_missing`` inputs that are not there
    are passed over, else a missing file is an error row and any other text is refused.
    """
    found = list(texts)
    if config.files_from is not None:
        found += [r[0] for r in lines_of(spark, config.files_from).collect()]  # a list that a person keeps
    by_kind: dict[str, list[str]] = {}
    for text in distinct_inputs(found):
        try:
            by_kind.setdefault(classify(text), []).append(text)
        except ValueError:
            if os.path.splitext(text)[1]:
                by_kind.setdefault("file", []).append(text)  # it is named like a file
            elif not config.get("skip_missing"):
                raise
    hint = U.type_of_extension(config.default_extension) if config.default_extension else None
    none = F.lit(None).cast("string")
    out = spark.createDataFrame([], CONTENTS + ", error_kind string, error_text string")
    add = lambda df: out.unionByName(df if "error_kind" in df.columns else df.withColumn("error_kind", none), allowMissingColumns=True)
    if "stdin" in by_kind:
        out = add(from_texts(spark, [stdin], "stdin", hint or "plaintext"))
    if "url" in by_kind:
        if http_snapshot is None:
            raise ValueError("URLs as inputs need a snapshot of their answers")
        out = add(from_urls(spark.createDataFrame([(u,) for u in by_kind["url"]], "url string"), http_snapshot))
    for pattern in by_kind.get("glob", ()):
        out = add(read_glob(spark, pattern, config.get("glob_ignore_case"), config.get("hidden"), config.exclude_path, hint))
    paths = [os.path.expanduser(p) for p in by_kind.get("file", ())]
    for folder in filter(os.path.isdir, paths):
        out = add(read_folder(spark, folder, config.get("extensions"), config.get("hidden"), config.get("no_ignore"), config.exclude_path, hint))
    if files := [p for p in paths if not os.path.isdir(p)]:
        out = add(read_files(spark, files, config.exclude_path, hint, config.get("skip_missing")))
    return out


def _ignore_rules(path: str) -> list[tuple[bool, bool, bool, str]]:
    """(negated, folders only, anchored, pattern) of the lines of an ignore file."""
    out = []
    if os.path.isfile(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                line = line.rstrip("\n").rstrip()
                if not line or line.startswith("#"):
                    continue
                negated = line.startswith("!")
                line = line[negated:]
                folder = line.endswith("/")
                line = line.rstrip("/")
                out.append((negated, folder, "/" in line, line.lstrip("/")))
    return out


def walk(top: str, extensions: Sequence[str] = TYPE_EXTENSIONS, hidden: bool = False, no_ignore: bool = False) -> Iterator[str]:
    """Paths below a folder in order, by the rules of ignore files there and above."""
    wanted = {e.lower().lstrip(".") for e in extensions}
    above: list[tuple[str, list]] = []
    if not no_ignore:
        folder = os.path.abspath(top)
        while (parent := os.path.dirname(folder)) != folder:
            folder = parent
            rules = [r for n in (".gitignore", ".ignore") for r in _ignore_rules(os.path.join(folder, n))]
            if rules:
                above.insert(0, (folder, rules))

    def ignored(path: str, is_dir: bool, scopes: list[tuple[str, list]]) -> bool:
        out = False
        for folder, rules in scopes:
            rel = os.path.relpath(path, folder)
            for negated, only_dirs, anchored, pattern in rules:
                if only_dirs and not is_dir:
                    continue
                hit = fnmatch.fnmatch(rel, pattern) if anchored else fnmatch.fnmatch(os.path.basename(path), pattern)
                if hit:
                    out = not negated
        return out

    def visit(folder: str, scopes: list[tuple[str, list]]) -> Iterator[str]:
        if not no_ignore:
            rules = [r for n in (".gitignore", ".ignore") for r in _ignore_rules(os.path.join(folder, n))]
            scopes = [*scopes, (os.path.abspath(folder), rules)] if rules else scopes
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if name.startswith(".") and not hidden:
                continue
            is_dir = os.path.isdir(path)
            if not no_ignore and ignored(os.path.abspath(path), is_dir, scopes):
                continue
            if is_dir:
                yield from visit(path, scopes)
            elif name.rpartition(".")[2].lower() in wanted and "." in name:
                yield path

    yield from visit(top, above)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Inputs or patterns of a text file, one a line; blank lines and ``#`` lines do not count: line."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Exclude patterns of an ignore file (a short list that a person keeps); ends of lines stay as they are."""
    rows = spark.read.text(path).where("value <> '' and not startswith(ltrim(value), '#')")
    return [r[0] for r in rows.collect()]


def fs_index(spark: SparkSession, top: str) -> DataFrame:
    """Index of all files and folders below ``top`` for the lookups of ``operators.files``."""
    rows, k = [], 0
    for folder, dirs, names in os.walk(top):
        dirs.sort()
        for name, is_dir in [(n, False) for n in sorted(names)] + [(n, True) for n in dirs]:
            rows.append((os.path.join(folder, name), name, name.rpartition(".")[2].lower() if "." in name else "", is_dir, k))
            k += 1
    rows.append((top.rstrip("/"), os.path.basename(top.rstrip("/")), "", True, k))
    return spark.createDataFrame(rows, "path string, filename string, ext string, is_dir boolean, walk_order bigint")


def preprocessed(contents: DataFrame, command: str) -> DataFrame:
    """Contents replaced by what ``command SOURCE`` prints; error_kind and error_text where it fails. Opt-in: it starts processes in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(0).to_pylist()
            texts, kinds, errors = [], [], []
            for source in sources:
                done = subprocess.run([command, source], capture_output=True, check=False)
                fine = done.returncode == 0
                texts.append(done.stdout.decode("utf-8", "replace") if fine else None)
                reason = done.stderr.decode("utf-8", "replace").strip() or "<empty stderr>"
                kinds.append(None if fine else "PreprocessorError")
                errors.append(None if fine else f"Preprocessor command '{command}' failed with '{reason}'")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(x, pa.string()) for x in (texts, kinds, errors))], names=["source", "source_kind", "file_type", "content", "error_kind", "error_text"])

    return contents.select("source", "source_kind", "file_type").mapInArrow(run, CONTENTS + ", error_kind string, error_text string")
