"""Scanning directory trees into a ``files`` table.

Spark's own file sources leave out names that start with ``.`` or ``_``, which are the
ones a guard must see, so directories are listed in tasks. Where roots and rules are of
bounded size, the data source ``bindery_tree`` plans the walk and prunes it. Beyond that the walk goes
level by level: each level is one job over all directories of that depth, spread over
tasks by their path, and ignored directories are dropped before the next level lists
them. Each level is written to the shared folder, so a lost executor repeats one listing
and not the walk.

Roots must be paths or URIs every executor can read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.paths import ancestors, normalise
from bindery.functions.text import decode_text
from bindery.operators.filters import exceeds_size_limit, path_skip_reason
from bindery.operators.joins import join_dimension, measured_bytes
from bindery.session import store
from bindery.sources.folders import folders
from bindery.sources.tree_source import rules_text, scan_tree

ENTRY_TYPE = "workspace string, root string, path string, is_dir boolean, size_bytes bigint"
IGNORE_FILE = ".gitignore"
ENTRIES_PER_BATCH = 10_000
# Starting points and rules up to this size are planned by the data source.
PLAN_BYTES = 4 << 20


def _frame(rows: list) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["workspace", "root", "path", "is_dir", "size_bytes"])
    return frame.astype({"size_bytes": "Int64"})


def _row(workspace: str, root: str, path: str, is_dir: bool, size: int) -> tuple:
    return workspace, root, path, is_dir, None if is_dir else size


def _stat_selected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for key in zip(batch["workspace"], batch["root"], batch["path"]):
            kind = folders(key[1]).kind(key[2])
            found += [_row(*key, *kind)] if kind else []
        yield _frame(found)


def _list_children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for workspace, root, path in zip(batch["workspace"], batch["root"], batch["path"]):
            found = []
            for name, is_dir, size in folders(root).entries(path):
                found.append(_row(workspace, root, f"{path}/{name}" if path else name, is_dir, size))
                if len(found) == ENTRIES_PER_BATCH:
                    yield _frame(found)
                    found = []
            yield _frame(found)


def _read_bytes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(len(batch)):
            row = batch.iloc[at : at + 1]
            yield row.assign(raw=[folders(row["root"].iloc[0]).read(row["path"].iloc[0])])


def read_ignore_texts(roots: DataFrame) -> DataFrame:
    """``workspace, ignore_text`` from the ignore file at each root; a missing one is empty."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = []
            for root in batch["root"]:
                try:
                    raw.append(folders(root).read(IGNORE_FILE))
                except OSError:
                    raw.append(b"")
            yield pd.DataFrame({"workspace": batch["workspace"], "raw": raw})

    texts = roots.select("workspace", "root").mapInPandas(read, "workspace string, raw binary")
    return texts.select("workspace", decode_text(F.col("raw")).alias("ignore_text"))


def _outermost(picked: DataFrame) -> DataFrame:
    """Picks that lie under no other pick of their workspace, so nothing is walked twice."""
    above = F.array_except(F.concat(F.array(F.lit("")), ancestors(F.col("path"))), F.array("path"))
    under = picked.select("workspace", "path", F.explode(above).alias("folder"))
    folders = picked.select("workspace", F.col("path").alias("folder"))
    return picked.join(under.join(folders, ["workspace", "folder"], "left_semi"), ["workspace", "path"], "left_anti")


def _starts(roots: DataFrame, selection: DataFrame | None) -> DataFrame:
    if selection is None:
        return roots.select("workspace", "root", F.lit("").alias("path"))
    picked = _outermost(selection.select("workspace", F.rtrim(normalise(F.col("prefix")), F.lit("/")).alias("path")).distinct())
    return picked.join(roots.select("workspace", "root"), "workspace").select("workspace", "root", "path")


def _judged(entries: DataFrame, rules: DataFrame | None, measured: int | None) -> DataFrame:
    """Entries that no rule drops: directories judged as such, files as files."""
    if rules is None:
        return entries
    joined = join_dimension(entries, rules, ["workspace"], spread_by=["path"], measured=measured)
    path, own = F.col("path"), F.col("rules")
    reason = path_skip_reason(path, own)
    if "is_dir" in entries.columns:
        reason = F.when(F.col("is_dir"), path_skip_reason(path, own, is_directory=True)).otherwise(reason)
    # The root itself has no name to judge.
    return joined.filter((path == "") | reason.isNull()).drop("rules")


def _planned(roots: DataFrame, rules: DataFrame | None, selection: DataFrame | None, content: bool, plan_bytes: int) -> DataFrame | None:
    """The scan by the data source, if starting points and rules are small enough to plan with."""
    starts = _starts(roots, selection)
    measured = None if rules is None else measured_bytes(rules)
    if (measured or 0) > plan_bytes or measured_bytes(starts) > plan_bytes:
        return None
    points = [tuple(r) for r in starts.distinct().collect()]
    text = None if rules is None else rules_text(rules)
    return _judged(scan_tree(roots.sparkSession, points, text, content=content), rules, measured)


def list_tree(roots: DataFrame, rules: DataFrame | None = None, selection: DataFrame | None = None, *, plan_bytes: int = PLAN_BYTES) -> DataFrame:
    """Listing ``workspace, root, path, size_bytes`` of every file worth reading.

    ``roots`` holds ``workspace, root``. ``rules`` holds ``workspace, rules`` as built by
    ``compiled_rules``: directories are judged without the extension test and never
    entered when ignored, files are judged with it. ``selection`` holds
    ``workspace, prefix``; without it each root is walked whole. Overlapping selections
    yield a file once.
    """
    planned = _planned(roots, rules, selection, False, plan_bytes)
    if planned is not None:
        return planned.select("workspace", "root", "path", "size_bytes")
    measured = None if rules is None else measured_bytes(rules)
    start = _starts(roots, selection).repartition("workspace", "path")
    level = store(_judged(start.mapInPandas(_stat_selected, ENTRY_TYPE), rules, measured), "walk")
    found = level.filter(~F.col("is_dir"))
    while not (below := level.filter("is_dir")).isEmpty():
        children = below.repartition("workspace", "path").mapInPandas(_list_children, ENTRY_TYPE)
        level = store(_judged(children, rules, measured), "walk")
        found = found.unionByName(level.filter(~F.col("is_dir")))
    return found.select("workspace", "root", "path", "size_bytes")


def read_tree(roots: DataFrame, rules: DataFrame | None = None, *, plan_bytes: int = PLAN_BYTES) -> DataFrame:
    """``list_tree`` with ``raw``, the bytes of each file, in one pass over the trees.

    Files above the size limit of their workspace's rules are listed with no bytes and never opened.
    """
    planned = _planned(roots, rules, None, True, plan_bytes)
    if planned is not None:
        return planned.select("workspace", "root", "path", "size_bytes", F.col("content").alias("raw"))
    listing, limit = list_tree(roots, rules, plan_bytes=plan_bytes), F.lit(None).cast("int")
    if rules is not None:
        limits = rules.select("workspace", F.col("rules.max_file_size_kb").alias("limit"))
        listing, limit = join_dimension(listing, limits, ["workspace"], spread_by=["path"]), F.col("limit")
    columns = ["workspace", "root", "path", "size_bytes"]
    readable, large = (part.select(columns) for part in split_by_size(listing, limit))
    read = readable.repartition("workspace", "path").mapInPandas(_read_bytes, "workspace string, root string, path string, size_bytes bigint, raw binary")
    return read.unionByName(large.withColumn("raw", F.lit(None).cast("binary")))


def split_by_size(listing: DataFrame, max_file_size_kb: Column) -> tuple[DataFrame, DataFrame]:
    """``(readable, too large)`` from the sizes alone, before any content is read. Without a
    limit or a size a file is readable."""
    large = F.coalesce(exceeds_size_limit(F.col("size_bytes"), max_file_size_kb), F.lit(False))
    return listing.filter(~large), listing.filter(large)


def read_contents(listing: DataFrame) -> DataFrame:
    """Adds ``content``: decoded text. ``size_bytes`` becomes the number of bytes read.

    Files are spread over tasks by path before they are read.
    """
    rows = listing.select("workspace", "root", "path").repartition("workspace", "path")
    read = rows.mapInPandas(_read_bytes, "workspace string, root string, path string, raw binary")
    texts = read.select(
        "workspace",
        "path",
        decode_text(F.col("raw")).alias("content"),
        F.octet_length("raw").cast("bigint").alias("size_bytes"),
    )
    extra = [c for c in listing.columns if c not in ("workspace", "root", "path", "size_bytes")]
    return texts.join(listing.select("workspace", "path", *extra), ["workspace", "path"]) if extra else texts
