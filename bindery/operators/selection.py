"""Selections: which files of a listing a set of picked files and folders covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.paths import ancestors, normalise
from bindery.operators.joins import BROADCAST_BYTES, join_dimension

# Longest selection of one workspace that is looked up as a map.
MAP_ENTRIES = 64
# Most depths of picked paths that are looked up by one join each.
MOST_DEPTHS = 32
PRIORITY_LIST, PRIORITY_SINGLE, PRIORITY_DEFAULT = range(3)


def _prefix(path: Column) -> Column:
    return F.rtrim(normalise(path), F.lit("/"))


def covering_prefixes(path: Column) -> Column:
    """Everything whose selection takes the file in: the root, its folders, itself."""
    clean = normalise(path)
    return F.concat(F.array(F.lit("")), ancestors(clean), F.array(clean))


def _measure(picked: DataFrame) -> tuple[int, int, list[int]]:
    """Most entries of one workspace, bytes in all, and the depths that occur.

    Maps are searched entry by entry, so a long one would cost every file of its workspace.
    """
    per_workspace = picked.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum(F.octet_length("prefix") + 16).alias("bytes"),
        F.collect_set(F.least("depth", F.lit(MOST_DEPTHS))).alias("depths"),
    )
    row = per_workspace.agg(F.max("entries"), F.sum("bytes"), F.array_distinct(F.flatten(F.collect_set("depths")))).first()
    return row[0] or 0, row[1] or 0, sorted(row[2] or [])


def _by_depth(files: DataFrame, picked: DataFrame, depths: list[int]) -> DataFrame:
    """Looks every file up once per depth of the picked paths, by the part of its path that deep.

    Each lookup is a broadcast join, so files keep their place and number; those no lookup finds go.
    """
    prefixes = covering_prefixes(F.col("path"))
    found = files.withColumn("_above", prefixes)
    for depth in depths:
        own = picked.where(F.col("depth") == depth).select(
            F.col("workspace").alias("_w"), F.col("prefix").alias("_p"), F.col("selection_rank").alias(f"_rank{depth}")
        )
        at = F.get("_above", F.lit(depth))
        found = found.join(F.broadcast(own), (found["workspace"] == own["_w"]) & (at == own["_p"]), "left").drop("_w", "_p")
    ranks = [F.col(f"_rank{depth}") for depth in depths]
    rank = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    return found.withColumn("selection_rank", rank).where(F.col("selection_rank").isNotNull()).select(*files.columns, "selection_rank")


def select_files(
    files: DataFrame, selection: DataFrame, *, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Files that are selected themselves or lie under a selected folder, each once.

    ``selection`` holds ``workspace, prefix`` and optionally ``ordinal``. Adds
    ``selection_rank``, the first place in the selection that covers the file.
    A small selection is broadcast as one map per workspace. One with more entries is broadcast
    depth by depth of the picked paths and joined with the part of a file's path that
    deep. In both the files stay where they are. A selection too large for that is joined
    by equality on every folder above a file, paths only, and a folder that covers a large
    share of all files is spread over tasks.
    """
    picked = selection if "ordinal" in selection.columns else selection.withColumn("ordinal", F.lit(0))
    picked = picked.groupBy("workspace", _prefix(F.col("prefix")).alias("prefix")).agg(
        F.min("ordinal").cast("bigint").alias("selection_rank")
    )
    # The root is at depth 0, and covers everything.
    picked = picked.withColumn("depth", F.when(F.col("prefix") == "", 0).otherwise(F.size(covering_prefixes(F.col("prefix"))) - 1))
    entries, size, depths = _measure(picked)
    if size <= broadcast_bytes and entries > MAP_ENTRIES and depths[-1] < MOST_DEPTHS:
        return _by_depth(files, picked, depths)
    picked = picked.drop("depth")
    if size <= broadcast_bytes and entries <= MAP_ENTRIES:
        maps = picked.groupBy("workspace").agg(
            F.map_from_entries(F.collect_list(F.struct("prefix", "selection_rank"))).alias("_picked")
        )
        rank = F.array_min(
            F.transform(covering_prefixes(F.col("path")), lambda p: F.try_element_at(F.col("_picked"), p))
        )
        return (
            files.join(F.broadcast(maps), "workspace")
            .withColumn("selection_rank", rank)
            .filter(F.col("selection_rank").isNotNull())
            .select(*files.columns, "selection_rank")
        )

    paths = files.select("workspace", "path", F.explode(covering_prefixes(F.col("path"))).alias("prefix"))
    covered = (
        join_dimension(
            paths, picked, ["workspace", "prefix"], spread_by=["path"], how="inner", broadcast_bytes=broadcast_bytes
        )
        .groupBy("workspace", "path")
        .agg(F.min("selection_rank").alias("selection_rank"))
    )
    # The covered paths are narrow; the files move only if these are too many to broadcast.
    found = join_dimension(
        files, covered, ["workspace", "path"], spread_by=["path"], how="inner", broadcast_bytes=broadcast_bytes
    )
    return found.select(*files.columns, "selection_rank")


def merge_selection(explicit: DataFrame, default: DataFrame) -> DataFrame:
    """The explicit list plus the default entry where it is not listed already, last.

    Both hold ``workspace, path``; the result adds ``is_default``. Rows of the explicit
    list are distinct paths, so no key is heavier than the default's one row.
    """
    extra = default.join(explicit, ["workspace", "path"], "left_anti")
    return explicit.withColumn("is_default", F.lit(False)).unionByName(
        extra.withColumn("is_default", F.lit(True)), allowMissingColumns=True
    )


def selection_fallback(candidates: DataFrame) -> DataFrame:
    """Per workspace, only the candidates of the best kind present.

    ``candidates`` holds ``workspace, path, priority`` (0 the list, 1 the single item,
    2 the default). The best kind is a partial aggregate; it goes back to the rows by
    a join that splits heavy workspaces.
    """
    best = candidates.groupBy("workspace").agg(F.min("priority").alias("_best"))
    return (
        join_dimension(candidates, best, ["workspace"], spread_by=["path"], how="inner")
        .filter(F.col("priority") == F.col("_best"))
        .drop("_best")
    )
