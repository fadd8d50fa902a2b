"""Filters that come before the secret guard: path, size, binary content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.bind import bind
from bindery.functions.paths import extension
from bindery.functions.text import looks_binary, size_label
from bindery.operators.ignore import is_ignored, matches_segment

IGNORED = "ignored"
EXTENSION_FILTER = "extension-filter"
TOO_LARGE = "too-large"
BINARY = "binary"

# Report order of skipped rows: known from the listing, from the content, from the guard.
STAGE_STAT = 0
STAGE_CONTENT = 1
STAGE_GUARD = 2


def wanted_extensions(extensions: Column) -> Column:
    """Extensions as they are compared: lower case, one leading dot removed."""
    return F.transform(extensions, lambda e: F.lower(F.regexp_replace(e, r"\A\.", "")))


def extension_allowed(path: Column, wanted: Column) -> Column:
    """An empty list allows every extension."""
    return (F.size(wanted) == 0) | F.array_contains(wanted, extension(path))


def exceeds_size_limit(size_bytes: Column, max_file_size_kb: Column) -> Column:
    """Strictly above the limit; 0 switches it off."""
    return (max_file_size_kb > 0) & (size_bytes > max_file_size_kb * 1024)


def path_skip_reason(path: Column, rules: Column, *, is_directory: bool = False) -> Column:
    """First reason to drop a path unread, else NULL. Directories skip the extension test.

    ``rules`` is the struct ``compiled_rules`` builds, a column or a literal.
    """
    ignored = matches_segment(path, rules["ignore_regex"]) | is_ignored(
        path, rules["rules"], rules["rules_regex"], rules["rules_negated"]
    )
    reason = F.when(ignored, F.lit(IGNORED))
    if is_directory:
        return reason
    return reason.when(~extension_allowed(path, rules["extensions"]), F.lit(EXTENSION_FILTER))


def screen(files: DataFrame, rules: Column) -> DataFrame:
    """Adds ``stage``, ``reason`` and ``detail``: one verdict per file, NULL when kept.

    Cheapest test first, and the branches evaluate in that order, so the content is
    looked at only where path and size let it through.
    """
    size = F.col("size_bytes")
    reason = F.coalesce(
        path_skip_reason(F.col("path"), rules),
        F.when(exceeds_size_limit(size, rules["max_file_size_kb"]), F.lit(TOO_LARGE)),
        F.when(looks_binary(F.col("content")), F.lit(BINARY)),
    )

    def verdict(why: Column) -> Column:
        large = why == TOO_LARGE
        return F.struct(
            why.alias("reason"),
            F.when(large, size_label(size)).alias("detail"),
            F.when(large, F.lit(STAGE_STAT)).when(why.isNotNull(), F.lit(STAGE_CONTENT)).alias("stage"),
        )

    judged = files.withColumn("_screen", bind(reason, verdict))
    return judged.withColumns({c: F.col(f"_screen.{c}") for c in ("reason", "detail", "stage")}).drop("_screen")


def collect_files(files: DataFrame, rules: Column) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)``: a complementary split of the input."""
    judged = screen(files, rules)
    kept = judged.filter(F.col("reason").isNull()).drop("stage", "reason", "detail")
    skipped = judged.filter(F.col("reason").isNotNull()).drop("content", "size_bytes")
    return kept, skipped
