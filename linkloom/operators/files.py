"""Lookups in an index of files: existence, fallback extensions, index files, wikilinks.

``fs_index`` has path, filename, ext, is_dir and walk_order; every lookup is an equi
join, and where several candidates are tried in order the first that exists counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import uri as U


def path_of(uri: Column) -> Column:
    """The path of a file URI, percent-decoded, without a trailing slash."""
    p = F.coalesce(F.try_url_decode(F.regexp_replace(U.path(uri), r"\+", "%2B")), U.path(uri))
    return F.regexp_replace(p, r"(?<=.)/+$", "")


def with_extension(path: Column, ext: Column) -> Column:
    """The path with its last extension replaced."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.when(ext == "", bare).otherwise(F.concat(bare, F.lit("."), ext))


def existing(paths: DataFrame, fs_index: DataFrame) -> DataFrame:
    """Rows whose path exists."""
    return paths.join(fs_index.select("path").distinct(), "path", "left_semi")


def missing(paths: DataFrame, fs_index: DataFrame) -> DataFrame:
    return paths.join(fs_index.select("path").distinct(), "path", "left_anti")


def first_match(candidates: DataFrame, fs_index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the candidate (candidate, pos) with the lowest pos that exists: keys, found, found_is_dir."""
    there = fs_index.groupBy(F.col("path").alias("candidate")).agg(F.max("is_dir").alias("candidate_is_dir"))
    best = F.min_by(F.struct("candidate", "candidate_is_dir"), "pos").alias("best")
    return candidates.join(there, "candidate").groupBy(*keys).agg(best).select(*keys, F.col("best.candidate").alias("found"), F.col("best.candidate_is_dir").alias("found_is_dir"))


def fallback_extensions(paths: DataFrame, fs_index: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Per distinct path: path, found (itself or the first extension that exists), found_is_dir."""
    itself = F.struct(F.lit(-1).alias("pos"), F.col("path").alias("candidate"))
    others = [F.struct(F.lit(k).alias("pos"), with_extension(F.col("path"), F.lit(e.lstrip("."))).alias("candidate")) for k, e in enumerate(extensions)]
    tried = paths.select("path").distinct().select("path", F.explode(F.array(itself, *others)).alias("c")).select("path", "c.*")
    return first_match(tried, fs_index, ["path"])


def index_files(directories: DataFrame, fs_index: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Per distinct directory: path, found (the first index file that exists; ``.`` is the directory), found_is_dir.

    Without names (None) a directory stands for itself; with an empty list none is found.
    """
    distinct = directories.select("path").distinct()
    if names is None:
        return distinct.select("path", F.col("path").alias("found"), F.lit(True).alias("found_is_dir"))
    if not names:
        return distinct.where(F.lit(False)).select("path", F.col("path").alias("found"), F.lit(True).alias("found_is_dir"))
    tried = [F.struct(F.lit(k).alias("pos"), (F.col("path") if n == "." else F.concat("path", F.lit("/" + n))).alias("candidate")) for k, n in enumerate(names)]
    return first_match(distinct.select("path", F.explode(F.array(*tried)).alias("c")).select("path", "c.*"), fs_index, ["path"])


def resolve_paths(paths: DataFrame, fs_index: DataFrame, extensions: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Per distinct path: path, found (null if nothing is there), found_is_dir, error_kind (null, InvalidFilePath or InvalidIndexFile)."""
    distinct = paths.select("path").distinct()
    hit = fallback_extensions(distinct, fs_index, extensions).withColumnRenamed("found", "hit").withColumnRenamed("found_is_dir", "hit_is_dir")
    inside = index_files(hit.where("hit_is_dir").select(F.col("hit").alias("path")), fs_index, names).select(F.col("path").alias("hit"), F.col("found").alias("inner"), F.col("found_is_dir").alias("inner_is_dir"))
    out = distinct.join(hit, "path", "left").join(inside, "hit", "left")
    found = F.when(F.col("hit_is_dir"), F.col("inner")).otherwise(F.col("hit"))
    error = F.when(F.col("hit").isNull(), "InvalidFilePath").when(F.col("hit_is_dir") & F.col("inner").isNull(), "InvalidIndexFile")
    return out.select("path", found.alias("found"), F.when(F.col("hit_is_dir"), F.col("inner_is_dir")).otherwise(F.lit(False)).alias("found_is_dir"), error.alias("error_kind"))


def wikilinks(links: DataFrame, fs_index: DataFrame, extensions: Sequence[str] = ()) -> DataFrame:
    """Per distinct target: target and found, the file of that name anywhere (of several the last of the walk), with the extensions tried in order."""
    by_name = fs_index.where("not is_dir").groupBy(F.col("filename").alias("candidate")).agg(F.max_by("path", "walk_order").alias("file"))
    names = [F.col("target")] + [F.concat("target", F.lit("." + e.lstrip("."))) for e in extensions]
    tried = [F.struct(F.lit(k).alias("pos"), F.element_at(F.split(n, "/"), -1).alias("candidate")) for k, n in enumerate(names)]
    rows = links.select("target").distinct().select("target", F.explode(F.array(*tried)).alias("c")).select("target", "c.*")
    hits = rows.join(by_name, "candidate").groupBy("target").agg(F.min_by("file", "pos").alias("found"))
    return links.select("target").distinct().join(hits, "target", "left")
