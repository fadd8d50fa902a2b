"""Rewrites absolute paths inside file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.text import utf16_length

# Least length of a root in UTF-16 units, and what takes the place of roots.
MIN_ROOT_LENGTH = 4
WORKSPACE_MARK = "."
HOME_MARK = "~"


def root_regex(root: Column) -> Column:
    """Matches a root in any separator style and case; NULL for none or a short one."""
    trimmed = F.regexp_replace(root, r"[/\\]+\z", "")
    escaped = F.regexp_replace(F.translate(trimmed, "\\", "/"), r"([.*+?^${}()|\[\]])", r"\\$1")
    body = F.regexp_replace(escaped, "/+", r"[/\\\\]+")
    return F.when(utf16_length(trimmed) >= MIN_ROOT_LENGTH, F.concat(F.lit("(?iu)"), body))


def scrub_paths(content: Column, workspace_regex: Column, home_regex: Column) -> Column:
    """Both roots replaced, the workspace one before the other; a NULL pattern changes nothing."""
    text = F.coalesce(F.regexp_replace(content, workspace_regex, F.lit(WORKSPACE_MARK)), content)
    return F.coalesce(F.regexp_replace(text, home_regex, F.lit(HOME_MARK)), text)
