"""From a ``files`` table and its workspaces to packs, documents and audit tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.functions.paths import normalise
from bindery.functions.text import size_label, tokens_for_units
from bindery.operators.filters import STAGE_STAT, TOO_LARGE, screen
from bindery.operators.guard import guard, mask_secrets, pattern_problems, redaction_rows
from bindery.operators.ignore import parse_rules
from bindery.operators.joins import join_dimension
from bindery.operators.order import with_ordinals
from bindery.operators.render import Estimator, documents, pack_totals, render_files
from bindery.operators.review import decide, summarise
from bindery.operators.scrub import root_regex, scrub_paths
from bindery.operators.settings import compiled_rules, guard_options, literal_settings, problem_report, resolve_settings
from bindery.session import discard, fresh_path, store
from bindery.sources.tree import IGNORE_FILE, list_tree, read_contents, read_ignore_texts, split_by_size


def workspace_settings(workspaces: DataFrame, files: DataFrame | None = None, *, guard_task: bool = False) -> DataFrame:
    """One row per workspace: resolved settings, finished patterns, roots and task.

    ``workspaces`` holds ``workspace`` and any of ``settings_json``, ``workspace_root``,
    ``home_dir``, ``task``, ``ignore_text``. Without ``ignore_text`` the ignore file is
    looked up in ``files``. That lookup filters on the path; unless the table is sorted by
    path it reads the contents once more, so give ``ignore_text`` for large tables. Of
    several ignore files of one workspace the first counts. Workspaces that only ``files``
    names get the default settings. With ``guard_task`` secrets in the task are masked as
    in a file, unless the workspace has its guard switched off.
    """
    optional = ("settings_json", "workspace_root", "home_dir", "task", "ignore_text")
    own = workspaces.select(
        "workspace",
        *[
            (F.col(c) if c in workspaces.columns else F.lit(None).cast("string")).alias(c)
            for c in optional
        ],
    )
    if files is not None:
        unlisted = files.select("workspace").distinct().join(own.select("workspace"), "workspace", "left_anti")
        own = own.unionByName(unlisted, allowMissingColumns=True)
        if "ignore_text" not in workspaces.columns and "content" in files.columns:
            first = F.struct("ordinal", "path") if "ordinal" in files.columns else F.struct("path")
            found = files.filter(normalise(F.col("path")) == IGNORE_FILE)
            texts = found.groupBy("workspace").agg(F.min_by("content", first).alias("ignore_text"))
            own = own.drop("ignore_text").join(texts, "workspace", "left")
    resolved = own.withColumn("_resolved", resolve_settings("settings_json"))
    settings = F.col("settings")
    scrub = settings["scrub_paths"]
    problems = F.concat("_resolved.problems", pattern_problems(F.col("_resolved.settings.extra_patterns")))
    settled = (
        resolved.withColumns({"settings": F.col("_resolved.settings"), "problems": problems})
        .withColumn("ignore_rules", parse_rules(F.coalesce("ignore_text", F.lit(""))))
        .select(
            "workspace",
            "task",
            "settings",
            "problems",
            problem_report(F.col("problems")).alias("problem_report"),
            compiled_rules(settings, F.col("ignore_rules")).alias("rules"),
            guard_options(settings).alias("guard_options"),
            F.when(scrub, root_regex(F.col("workspace_root"))).alias("workspace_regex"),
            F.when(scrub, root_regex(F.col("home_dir"))).alias("home_regex"),
        )
    )
    if not guard_task:
        return settled
    options = F.col("guard_options")
    return mask_secrets(settled, "task", scan=options["content_scanning"], extra_patterns=options["extra_patterns"]).drop("redactions")


def guard_files(
    files: DataFrame,
    settings: DataFrame,
    *,
    report_path_skips: bool = True,
) -> DataFrame:
    """Filters, scrubs and guards every file under the settings of its workspace.

    One row per file with a verdict: kept rows carry masked ``content`` and
    ``redactions``, skipped rows ``stage``, ``reason`` and ``detail`` and no content.
    Files of a workspace without settings get the defaults.
    Row-local apart from the one join that brings the settings. With
    ``report_path_skips`` off, files dropped for their path leave no trace, as in an
    interactive run.
    """
    brought = settings.select("workspace", "rules", "guard_options", "workspace_regex", "home_regex")
    joined = join_dimension(files, brought, ["workspace"], spread_by=["path"], weight=F.col("size_bytes"))
    usual = literal_settings()
    joined = joined.withColumns(
        {
            "rules": F.coalesce("rules", compiled_rules(usual)),
            "guard_options": F.coalesce("guard_options", guard_options(usual)),
        }
    )
    judged = screen(joined, F.col("rules"))
    if not report_path_skips:
        judged = judged.filter(F.col("reason").isNull() | ~F.col("reason").isin("ignored", "extension-filter"))
    scrubbed = judged.withColumn(
        "content",
        F.when(
            F.col("reason").isNull(), scrub_paths(F.col("content"), F.col("workspace_regex"), F.col("home_regex"))
        ),
    )
    with_patterns = settings.filter(F.size("guard_options.extra_patterns") > 0)
    guarded = guard(scrubbed, F.col("guard_options"), user_patterns=not with_patterns.isEmpty())
    return guarded.drop("rules", "guard_options", "workspace_regex", "home_regex")


@dataclass(frozen=True)
class PackTables:
    """The result tables of one run. ``close`` removes what they are read from."""

    packs: DataFrame
    documents: DataFrame
    sections: DataFrame
    skipped: DataFrame
    redactions: DataFrame
    stored: tuple[str, ...] = field(default=(), repr=False)

    def close(self) -> None:
        for path in self.stored:
            discard(self.packs.sparkSession, path)


def _report_settings(settings: DataFrame) -> DataFrame:
    return settings.select(
        "workspace",
        "task",
        F.col("settings.output_language"),
        F.col("settings.include_overview"),
        F.col("settings.token_warning_threshold"),
        F.col("settings.review_policy"),
        "problems",
        "problem_report",
    )


def totals_for(rendered: DataFrame, settings: DataFrame, *, estimator: Estimator = tokens_for_units) -> DataFrame:
    """Pack totals with the review decision; workspaces with nothing left have no pack."""
    totals = pack_totals(rendered, _report_settings(settings), estimator=estimator)
    return summarise(decide(totals.filter(F.col("file_count") > 0)))


def _run(
    files: DataFrame,
    settings: DataFrame,
    skipped: DataFrame | None,
    stored: tuple[str, ...],
    *,
    report_path_skips: bool,
    estimator: Estimator,
    folder: str | None,
) -> PackTables:
    spark = files.sparkSession
    paths = [fresh_path(spark, name, folder) for name in ("rendered", "totals")]
    guarded = guard_files(files, settings, report_path_skips=report_path_skips)
    if skipped is not None:
        guarded = guarded.unionByName(skipped, allowMissingColumns=True)
    rendered = store(render_files(guarded, estimator=estimator), "rendered", path=paths[0])
    totals = store(totals_for(rendered, settings, estimator=estimator), "totals", path=paths[1])
    kept = rendered.filter(F.col("reason").isNull())
    return PackTables(
        packs=totals,
        documents=documents(rendered, totals),
        sections=kept.select("workspace", "ordinal", "path", "language_tag", "token_estimate", "section"),
        skipped=rendered.filter(F.col("reason").isNotNull()).select("workspace", "ordinal", "path", "stage", "reason", "detail"),
        redactions=redaction_rows(kept, "workspace", "path"),
        stored=(*stored, *paths),
    )


def pack(
    files: DataFrame,
    workspaces: DataFrame,
    *,
    skipped: DataFrame | None = None,
    report_path_skips: bool = True,
    guard_task: bool = False,
    estimator: Estimator = tokens_for_units,
    folder: str | None = None,
) -> PackTables:
    """The whole run. Settings, rendered files and totals are written once to the shared
    folder (or ``folder``), and every table is derived from there, so contents are read,
    filtered, scrubbed and masked a single time.

    ``skipped`` holds files left out before their contents were read (``workspace,
    ordinal, path, stage, reason, detail``); they join the audit trail and the totals. A
    missing workspace name counts as an empty one. ``guard_task`` masks secrets in the tasks too.
    """
    files = files.withColumn("workspace", F.coalesce("workspace", F.lit("")))
    path = fresh_path(files.sparkSession, "settings", folder)
    settings = store(workspace_settings(workspaces, files, guard_task=guard_task), "settings", path=path)
    options = {"report_path_skips": report_path_skips, "estimator": estimator, "folder": folder}
    return _run(files, settings, skipped, (path,), **options)


def too_large(listing: DataFrame) -> DataFrame:
    """Audit rows of files left out for their size alone."""
    return listing.select(
        "workspace",
        "ordinal",
        "path",
        F.lit(STAGE_STAT).alias("stage"),
        F.lit(TOO_LARGE).alias("reason"),
        size_label(F.col("size_bytes")).alias("detail"),
    )


def pack_trees(
    roots: DataFrame,
    workspaces: DataFrame,
    selection: DataFrame | None = None,
    *,
    guard_task: bool = False,
    estimator: Estimator = tokens_for_units,
    folder: str | None = None,
) -> PackTables:
    """From directory trees to packs: list, prune, judge by size, read, and ``pack``.

    ``roots`` holds ``workspace, root``, ``selection`` as ``list_tree`` takes it. Files too
    large are never read, yet appear in ``skipped``, the totals and the review. Files
    dropped for their path are not listed: ignored folders are never entered.
    """
    given = workspaces
    if "ignore_text" not in workspaces.columns:
        given = workspaces.join(read_ignore_texts(roots), "workspace", "full")
    path = fresh_path(roots.sparkSession, "settings", folder)
    settings = store(workspace_settings(given, roots, guard_task=guard_task), "settings", path=path)
    listing = with_ordinals(list_tree(roots, settings.select("workspace", "rules"), selection))
    limits = settings.select("workspace", F.col("rules.max_file_size_kb").alias("max_file_size_kb"))
    judged = join_dimension(listing, limits, ["workspace"], spread_by=["path"])
    readable, large = split_by_size(judged, F.col("max_file_size_kb"))
    files = read_contents(readable.drop("max_file_size_kb"))
    return _run(files, settings, too_large(large), (path,), report_path_skips=True, estimator=estimator, folder=folder)
