"""Relative-path functions. Both ``/`` and ``\\`` separate segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = r"[/\\]"


def posix_path(path: Column) -> Column:
    """Forward slashes everywhere; empty segments are kept."""
    return F.translate(path, "\\", "/")


def segments(path: Column) -> Column:
    """Non-empty path segments, shallow to deep."""
    return F.filter(F.split(path, SEPARATORS, -1), lambda s: s != "")


def base_name(path: Column) -> Column:
    """The last non-empty segment, or the path itself when there is none.

    Written with plain string functions instead of ``segments`` so that it stays
    inside generated code; it runs for every file of a corpus.
    """
    last = F.substring_index(F.rtrim(posix_path(path), F.lit("/")), "/", -1)
    return F.when(last != "", last).otherwise(path)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; a leading dot does not start one."""
    name = base_name(path)
    return F.when(
        F.locate(".", name, 2) > 0, F.lower(F.substring_index(name, ".", -1))
    ).otherwise(F.lit(""))


def normalise(path: Column) -> Column:
    """The form ignore-file rules are tested against: one leading ``./`` and then
    every leading ``/`` removed."""
    return F.regexp_replace(F.regexp_replace(posix_path(path), r"\A\./", ""), r"\A/+", "")


def ancestors(path: Column) -> Column:
    """Parent directories of a normalised path, shallow to deep; empty at the root."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts)
    return F.when(
        depth > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))),
            lambda n: F.array_join(F.slice(parts, 1, n), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))
