"""Rendering: per-file pieces, pack totals, and the documents they add up to.

A document is a sequence of blocks. Every block ends with one line break and no block
starts with more than one, so runs of blank lines can be collapsed block by block and
the length of a document is the sum of its block lengths. Totals therefore come from a
plain sum over rows, and no document is ever built to be measured.

Blocks in order: head, one list line per file, divider, one section per file, report
head, one line per masked file, skip head, one line per skipped file.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.functions.bind import bind, quoted
from bindery.functions.languages import language_tag
from bindery.functions.paths import posix_path
from bindery.functions.text import (
    collapse_blank_runs,
    fence_for,
    format_count,
    tokens_for_units,
    trim_blanks,
    utf16_length,
)
from bindery.operators.guard import distinct_rules
from bindery.operators.joins import join_dimension

# Headings by output language. {lines} and {files} are filled in.
LABELS = {
    "en": {
        "task": "Task",
        "overview": "Project overview",
        "file_list": "Files included",
        "guard_report": "Secret guard report",
        "workspace": "Workspace",
        "file_count": "Files attached",
        "tokens": "Estimated tokens",
        "redacted": "{lines} line(s) in {files} file(s) had values masked as `<REDACTED:reason>`.",
        "skipped": "Left out on purpose",
        "no_files": "_No files were included._",
    },
    "th": {
        "task": "งานที่ต้องการ",
        "overview": "ภาพรวมโปรเจกต์",
        "file_list": "ไฟล์ที่เกี่ยวข้อง",
        "guard_report": "รายงานจากตัวกรองความลับ",
        "workspace": "Workspace",
        "file_count": "ไฟล์ที่แนบ",
        "tokens": "ประมาณการ token",
        "redacted": "มี {lines} บรรทัดใน {files} ไฟล์ ที่ถูกปิดค่าไว้เป็น `<REDACTED:reason>`",
        "skipped": "ไฟล์ที่ถูกตัดออกโดยตั้งใจ",
        "no_files": "_ไม่มีไฟล์ถูกแนบมา_",
    },
}

# Order of the blocks in a document.
HEAD, LIST, DIVIDER, SECTION, REPORT, MASKED, SKIP_HEAD, SKIPPED = range(8)

# Tokens of a text with so many UTF-16 units; the same for files and whole documents.
Estimator = Callable[[Column], Column]


def label(name: str) -> Column:
    """A heading in the row's ``output_language``; English when none is given."""
    return F.expr(f"if(output_language <=> 'th', {quoted(LABELS['th'][name])}, {quoted(LABELS['en'][name])})")


def list_line(path: Column) -> Column:
    return F.concat(F.lit("- `"), posix_path(path), F.lit("`\n"))


def section(path: Column, content: Column) -> Column:
    """Heading and fenced body of one file; the body loses one final line break."""
    body = F.regexp_replace(content, r"\n\z", "")
    opening = F.concat(language_tag(path), F.lit("\n"), body, F.lit("\n"))
    fenced = bind(fence_for(content), lambda fence: F.concat(fence, opening, fence, F.lit("\n")))
    return F.concat(F.lit("\n## "), posix_path(path), F.lit("\n\n"), fenced)


def masked_line(path: Column, redactions: Column) -> Column:
    return F.concat(
        F.lit("- `"),
        posix_path(path),
        F.lit("` — "),
        F.size(redactions).cast("string"),
        F.lit(" ("),
        distinct_rules(redactions),
        F.lit(")\n"),
    )


def skipped_line(path: Column, reason: Column, detail: Column) -> Column:
    return F.concat(
        F.lit("- `"),
        posix_path(path),
        F.lit("` — "),
        F.concat_ws(": ", reason, detail),
        F.lit("\n"),
    )


def masked_lines(redactions: Column) -> Column:
    """Number of distinct lines with a masked value."""
    return F.size(F.array_distinct(F.transform(redactions, lambda r: r["line"])))


def render_files(
    guarded: DataFrame,
    *,
    collapse: bool = True,
    estimator: Estimator = tokens_for_units,
) -> DataFrame:
    """One row per guarded file with its finished text pieces and their lengths.

    Takes kept and skipped files together: the pieces of the other kind are NULL.
    ``ordinal`` orders files within a workspace; equal or missing ordinals fall back
    to the path. Input order is not kept anywhere else, so nothing has to be sorted
    before the final assembly.
    """

    def tidy(text: Column) -> Column:
        return collapse_blank_runs(text) if collapse else text

    kept = F.col("reason").isNull()
    masked = kept & (F.size("redactions") > 0)
    ordinal = F.col("ordinal") if "ordinal" in guarded.columns else F.lit(0)
    pieces = guarded.select(
        "workspace",
        F.coalesce(ordinal.cast("bigint"), F.lit(0).cast("bigint")).alias("ordinal"),
        "path",
        F.coalesce("stage", F.lit(0)).alias("stage"),
        "reason",
        "detail",
        "redactions",
        F.when(kept, F.size("redactions")).otherwise(0).alias("redaction_count"),
        F.when(masked, masked_lines(F.col("redactions"))).otherwise(0).alias("masked_lines"),
        F.when(kept, language_tag(F.col("path"))).alias("language_tag"),
        F.when(kept, estimator(utf16_length(F.col("content")))).alias("token_estimate"),
        F.when(kept, tidy(list_line(F.col("path")))).alias("list_line"),
        F.when(kept, tidy(section(F.col("path"), F.col("content")))).alias("section"),
        F.when(masked, tidy(masked_line(F.col("path"), F.col("redactions")))).alias("masked_line"),
        F.when(~kept, tidy(skipped_line(F.col("path"), F.col("reason"), F.col("detail")))).alias("skipped_line"),
    )
    texts = ("list_line", "section", "masked_line", "skipped_line")
    units = sum((F.coalesce(utf16_length(F.col(c)), F.lit(0)) for c in texts), F.lit(0).cast("bigint"))
    octets = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in texts), F.lit(0).cast("bigint"))
    return pieces.withColumns({"units": units, "octets": octets})


def pack_counts(rendered: DataFrame) -> DataFrame:
    """Sums per workspace, partially aggregated before the shuffle; reads no text."""
    return rendered.groupBy("workspace").agg(
        F.count_if(F.col("reason").isNull()).alias("file_count"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped_count"),
        F.sum("redaction_count").cast("bigint").alias("redaction_count"),
        F.count_if(F.col("redaction_count") > 0).alias("masked_files"),
        F.sum("masked_lines").cast("bigint").alias("masked_lines"),
        F.coalesce(F.sum("token_estimate"), F.lit(0)).cast("bigint").alias("file_tokens"),
        F.sum("units").cast("bigint").alias("file_units"),
        F.sum("octets").cast("bigint").alias("file_octets"),
    )


def _lead() -> Column:
    """The head up to the token figure: task, then the overview unless it is off."""
    task_part = F.when(
        F.col("task") != "", F.concat(F.lit("# "), label("task"), F.lit("\n\n"), F.col("task"), F.lit("\n\n"))
    ).otherwise("")
    overview = F.when(
        F.col("include_overview"),
        F.concat(
            F.lit("# "),
            label("overview"),
            F.lit("\n\n- "),
            label("workspace"),
            F.lit(": "),
            F.col("workspace").cast("string"),
            F.lit("\n- "),
            label("file_count"),
            F.lit(": "),
            F.col("file_count").cast("string"),
            F.lit("\n- "),
            label("tokens"),
            F.lit(": "),
        ),
    ).otherwise("")
    return F.concat(task_part, overview)


def _list_head() -> Column:
    """The head after the token figure, and the note that stands for an empty list."""
    gap = F.when(F.col("include_overview"), F.lit("\n\n")).otherwise("")
    empty = F.when(F.col("file_count") == 0, F.concat(label("no_files"), F.lit("\n"))).otherwise("")
    return F.concat(gap, F.lit("# "), label("file_list"), F.lit("\n\n"), empty)


def _divider() -> Column:
    return F.when(F.col("file_count") > 0, F.lit("\n---\n")).otherwise("")


def _report_head() -> Column:
    sentence = F.replace(
        F.replace(label("redacted"), F.lit("{lines}"), F.col("masked_lines").cast("string")),
        F.lit("{files}"),
        F.col("masked_files").cast("string"),
    )
    masked = F.when(F.col("masked_files") > 0, F.concat(F.lit("\n"), sentence, F.lit("\n\n"))).otherwise("")
    return F.when(
        (F.col("masked_files") > 0) | (F.col("skipped_count") > 0),
        F.concat(F.lit("\n---\n\n# "), label("guard_report"), F.lit("\n"), masked),
    ).otherwise("")


def _skip_head() -> Column:
    return F.when(
        F.col("skipped_count") > 0,
        F.concat(F.lit("\n**"), label("skipped"), F.lit("**\n\n")),
    ).otherwise("")


def pack_totals(
    rendered: DataFrame, workspaces: DataFrame, *, collapse: bool = True, estimator: Estimator = tokens_for_units
) -> DataFrame:
    """One row per workspace: counts, total tokens and the blocks that occur once.

    ``workspaces`` holds ``workspace, task, output_language, include_overview`` and any
    columns to carry along; a workspace without files gets a pack with none. ``total_tokens`` covers the whole
    document except the digits of the figure itself.
    """

    counts = pack_counts(rendered)
    numbers = [c for c in counts.columns if c != "workspace"]
    joined = workspaces.withColumns(
        {
            "task": trim_blanks(F.coalesce("task", F.lit(""))),
            "include_overview": F.coalesce("include_overview", F.lit(True)),
        }
    ).join(counts, "workspace", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in numbers})
    lead = F.regexp_replace(_lead(), r"\n{3,}", "\n\n") if collapse else _lead()
    once = {
        "lead": lead,
        "list_head": _list_head(),
        "divider": _divider(),
        "report_head": _report_head(),
        "skip_head": _skip_head(),
    }
    built = filled.withColumns(once)
    units = sum((utf16_length(F.col(c)) for c in once), F.col("file_units"))
    figure = F.when(F.col("include_overview"), format_count(F.col("total_tokens"))).otherwise("")
    measured = built.withColumn("total_tokens", estimator(units))
    headed = measured.withColumn("head", F.concat("lead", figure, "list_head"))
    octets = sum((F.octet_length(c) for c in ("head", "divider", "report_head", "skip_head")), F.col("file_octets"))
    return headed.withColumn("document_bytes", octets).drop("lead", "list_head")


def document_blocks(rendered: DataFrame, totals: DataFrame) -> DataFrame:
    """All documents as rows ``(workspace, block, stage, ordinal, path, text)``.

    In that sort order the texts of a workspace concatenate to its document. Nothing
    is gathered here, so a workspace may be of any size.
    """

    def entry(block: int, text: Column, stage: Column) -> Column:
        return F.struct(F.lit(block).alias("block"), stage.alias("stage"), text.alias("text"))

    none = F.lit(0)
    per_file = F.array_compact(
        F.array(
            *[
                F.when(F.col(c).isNotNull(), entry(b, F.col(c), stage))
                for b, c, stage in (
                    (LIST, "list_line", none),
                    (SECTION, "section", none),
                    (MASKED, "masked_line", none),
                    (SKIPPED, "skipped_line", F.col("stage")),
                )
            ]
        )
    )
    once = F.filter(
        F.array(
            *[
                entry(b, F.col(c), none)
                for b, c in (
                    (HEAD, "head"),
                    (DIVIDER, "divider"),
                    (REPORT, "report_head"),
                    (SKIP_HEAD, "skip_head"),
                )
            ]
        ),
        lambda e: e["text"] != "",
    )
    shape = ("e.block", "e.stage", "ordinal", "path", "e.text")
    files = rendered.select("workspace", "ordinal", "path", F.explode(per_file).alias("e"))
    heads = totals.select(
        "workspace", F.lit(0).cast("bigint").alias("ordinal"), F.lit("").alias("path"), F.explode(once).alias("e")
    )
    return files.select("workspace", *shape).unionByName(heads.select("workspace", *shape))


def position(block: Column, stage: Column, ordinal: Column, path: Column) -> Column:
    """Text whose order is the order of blocks in a document."""
    shifted = (ordinal.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("string")
    return F.concat_ws(".", block.cast("string"), stage.cast("string"), F.lpad(shifted, 20, "0"), F.coalesce(path, F.lit("")))


def documents(rendered: DataFrame, totals: DataFrame) -> DataFrame:
    """Documents as rows ``(workspace, position, text)``, whatever their size.

    In the order of ``position`` the texts of a workspace are its document. Nothing is
    gathered and no row grows with a pack.
    """
    packs = totals.select("workspace")
    blocks = document_blocks(rendered, totals)
    kept = join_dimension(blocks, packs, ["workspace"], spread_by=["block", "path"], how="inner")
    at = position(F.col("block"), F.col("stage"), F.col("ordinal"), F.col("path"))
    return kept.select("workspace", at.alias("position"), "text")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """One string per document, for packs that are known to fit one row: ``workspace, text``."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "text")))
    gathered = blocks.groupBy("workspace").agg(ordered.alias("b"))
    return gathered.select("workspace", F.array_join(F.transform("b", lambda x: x["text"]), "").alias("text"))
