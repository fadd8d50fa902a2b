"""Review: whether a person must look first, the gate, and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.text import format_count


def review_reasons(tokens: Column, threshold: Column, redactions: Column, skipped: Column) -> Column:
    """Why a pack deserves a look, size first. Computed under every policy."""
    return F.array_compact(
        F.array(
            F.when(
                (threshold > 0) & (tokens > threshold),
                F.concat(
                    F.lit("about "),
                    format_count(tokens),
                    F.lit(" tokens, over your "),
                    format_count(threshold),
                    F.lit(" warning threshold"),
                ),
            ),
            F.when(redactions > 0, F.concat(redactions.cast("string"), F.lit(" value(s) were masked"))),
            F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" file(s) were left out"))),
        )
    )


def review_required(policy: Column, reasons: Column) -> Column:
    return (policy != "never") & ((policy == "always") | (F.size(reasons) > 0))


def decide(packs: DataFrame) -> DataFrame:
    """Adds ``review_required`` and ``review_reasons`` to pack totals."""
    reasons = review_reasons(
        F.col("total_tokens"), F.col("token_warning_threshold"), F.col("redaction_count"), F.col("skipped_count")
    )
    return packs.withColumn("review_reasons", reasons).withColumn(
        "review_required", review_required(F.col("review_policy"), F.col("review_reasons"))
    )


def run_summary(files: Column, tokens: Column, redactions: Column, skipped: Column) -> Column:
    """``3 file(s) · ~12,400 tokens · 1 redacted``; zero parts are left out."""
    return F.concat_ws(
        " · ",
        F.concat(files.cast("string"), F.lit(" file(s)")),
        F.concat(F.lit("~"), format_count(tokens), F.lit(" tokens")),
        F.when(redactions > 0, F.concat(redactions.cast("string"), F.lit(" redacted"))),
        F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" skipped"))),
    )


def has_warning(redactions: Column, skipped: Column) -> Column:
    return (redactions > 0) | (skipped > 0)


def summarise(packs: DataFrame) -> DataFrame:
    """Adds the one-line ``summary`` and ``has_warning``."""
    numbers = [F.col(c) for c in ("file_count", "total_tokens", "redaction_count", "skipped_count")]
    return packs.withColumns(
        {"summary": run_summary(*numbers), "has_warning": has_warning(numbers[2], numbers[3])}
    )


def gate(packs: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(released, held)``: a pack that needs review passes only when approved.

    ``approvals`` lists workspaces; both sides have one row per workspace at most. A pack
    whose decision is unknown counts as one that needs review. ``store`` the packs first:
    both results read them.
    """
    marked = packs.join(
        approvals.select("workspace").distinct().withColumn("_approved", F.lit(True)), "workspace", "left"
    )
    passes = ~F.coalesce("review_required", F.lit(True)) | F.coalesce("_approved", F.lit(False))
    return marked.filter(passes).drop("_approved"), marked.filter(~passes).drop("_approved")
