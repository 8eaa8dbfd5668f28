"""File manifests: what is new, changed, removed, and what that asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two manifests ``file_name, size, mtime[, n_docs]``."""
    old = previous.select("file_name", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(1).alias("was"))
    new = current.select("file_name", "size", "mtime", F.lit(1).alias("now"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    state = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("now").isNull(), "removed")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return old.join(new, "file_name", "full_outer").select("file_name", "old_size", "size", state.alias("state"))


def build_mode(diff: DataFrame) -> DataFrame:
    """One row: the kind of build a manifest difference asks for.

    Anything removed or changed needs a full build, also a first build; only new
    files an incremental one; no difference none at all.
    """

    def count(state: str):
        return F.count_if(F.col("state") == state).alias(state)

    counts = diff.agg(count("new"), count("changed"), count("removed"), count("unchanged"))
    known = F.col("changed") + F.col("removed") + F.col("unchanged")
    mode = (
        F.when((F.col("changed") + F.col("removed") > 0) | ((known == 0) & (F.col("new") > 0)), "full")
        .when(F.col("new") > 0, "incremental")
        .otherwise("noop")
    )
    return counts.select(mode.alias("mode"), "new", "changed", "removed", "unchanged")


def may_promote(staged: DataFrame, current: DataFrame, staged_files: DataFrame) -> DataFrame:
    """One row: whether a staged build still fits the files it was made from.

    Every manifest file must be unchanged and must be among the staged results.
    """
    moved = manifest_diff(staged, current).where("state <> 'unchanged'").select(F.lit(1).alias("moved"), F.lit(0).alias("missing"))
    missing = staged.join(staged_files, "file_name", "left_anti").select(F.lit(0).alias("moved"), F.lit(1).alias("missing"))
    counts = moved.unionByName(missing).agg(
        F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing")
    )
    return counts.select(((F.col("moved") == 0) & (F.col("missing") == 0)).alias("allowed"), "moved", "missing")
