"""The registered queries: each runs library operators over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery import (
    deliver_documents,
    delivery_outcomes,
    document_chunks,
    gate,
    guard_files,
    mask_secrets,
    merge_selection,
    pack,
    read_tree,
    resolve_settings,
    select_files,
    selection_fallback,
    split_by_size,
    with_ordinals,
    workspace_settings,
    written_outcomes,
)
from bindery.functions import paths as P
from bindery.functions import text as X
from bindery.functions.languages import language_tag
from bindery.operators.chunks import CHUNK_CHARS
from bindery.operators.filters import (
    collect_files,
    exceeds_size_limit,
    extension_allowed,
    path_skip_reason,
    wanted_extensions,
)
from bindery.operators.guard import denied_name, guard, redaction_rows
from bindery.operators.ignore import is_ignored, matches, matches_segment, parse_rules, segment_regex
from bindery.operators.joins import join_dimension
from bindery.operators.render import masked_line, render_files, section, skipped_line
from bindery.operators.settings import compiled_rules, guard_options, literal_settings, problem_report
from bindery.plans.pack import too_large, totals_for
from bindery.session import discard, fresh_path, store
from bindery.sinks import DELIVERED
from bindery.targets import delivered_files, delivered_lines, delivered_roots
from checks import oracles as O
from checks import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}



def path() -> Column:
    return F.col("path")


def content() -> Column:
    return F.col("content")

KEY = ("workspace", "ordinal")

def query(oracle: str | None = None, *, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and its SQL, under ``name`` where an operator has that name too."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if oracle is not None:
            ORACLES[key] = oracle
        return function

    return register


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(workspace_settings(V.workspaces(spark, sf_dir)), "settings")


def _with(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    """Files with columns of their workspace's settings."""
    return join_dimension(
        V.files(spark, sf_dir, spread=True),
        _settings(spark, sf_dir).select("workspace", *columns),
        ["workspace"],
        spread_by=["path"],
        weight=F.col("size_bytes"),
    )


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard_files(V.files(spark, sf_dir, spread=True), _settings(spark, sf_dir))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and logs of all files without their contents, written once so that the
    filters on them do not repeat the masking."""
    narrow = _guarded(spark, sf_dir).select(*KEY, "path", "stage", "reason", "detail", "redactions")
    return store(narrow, "audit")


def _from_files(select: str) -> str:
    return O.with_(V.CTE["files"], select=f"SELECT workspace, ordinal, {select} FROM files")


# --- paths and text ----------------------------------------------------------------


@query(
    _from_files(
        f"""path, array_to_string({O.segments('path')}, '|') AS segments, {O.base('path')} AS base_name,
    {O.extension('path')} AS extension, {O.posix('path')} AS posix_path, {O.normalised('path')} AS normalised"""
    )
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select(
        *KEY,
        "path",
        F.array_join(P.segments(path()), "|").alias("segments"),
        P.base_name(path()).alias("base_name"),
        P.extension(path()).alias("extension"),
        P.posix_path(path()).alias("posix_path"),
        P.normalise(path()).alias("normalised"),
    )


@query(
    O.with_(
        V.CTE["files"],
        select=f"""SELECT workspace, ordinal, array_to_string(parts[1:depth], '/') AS ancestor FROM (
    SELECT workspace, ordinal, parts, unnest(range(1, len(parts))) AS depth FROM (
      SELECT workspace, ordinal, string_split({O.normalised('path')}, '/') AS parts FROM files))""",
    )
)
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select(*KEY, F.explode(P.ancestors(P.normalise(path()))).alias("ancestor"))


@query(_from_files(f"path, {O.language_tag('path')} AS language_tag"))
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select(*KEY, "path", language_tag(path()).alias("language_tag"))


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["turns"],
        select=f"""SELECT workspace, ordinal, {O.tokens('content')} AS tokens, {O.grouped(O.tokens('content'))} AS label
    FROM (SELECT * FROM files UNION ALL SELECT * FROM turns)""",
    )
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.files(spark, sf_dir).unionByName(V.turns(spark, sf_dir))
    return both.select(*KEY, X.estimate_tokens(content()).alias("tokens")).withColumn(
        "label", X.format_count(F.col("tokens"))
    )


@query(_from_files(f"size_bytes, {O.size_label('size_bytes')} AS label"))
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select(*KEY, "size_bytes", X.size_label(F.col("size_bytes")).alias("label"))


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["workspaces"],
        O.resolved("workspaces", "workspace", "settings"),
        select=f"""SELECT workspace, ordinal, CASE WHEN scrub_paths THEN {O.scrubbed('content', 'workspace_root', 'home_dir')}
    ELSE content END AS content FROM files JOIN workspaces USING (workspace) JOIN settings USING (workspace)""",
    )
)
def scrub_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from bindery.operators.scrub import scrub_paths as scrub

    rows = _with(spark, sf_dir, "workspace_regex", "home_regex")
    return rows.select(*KEY, scrub(content(), F.col("workspace_regex"), F.col("home_regex")).alias("content"))


@query(_from_files(f"CAST({O.fence_length('content')} AS INT) AS fence_length"))
def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select(*KEY, F.length(X.fence_for(content())).alias("fence_length"))


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["page_files"],
        select=f"""SELECT workspace, ordinal, {O.collapsed(f"chr(10) || {O.section('path', 'content')} || chr(10)")} AS section
    FROM (SELECT * FROM files UNION ALL SELECT * FROM page_files)""",
    )
)
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.files(spark, sf_dir).unionByName(V.pages(spark, sf_dir))
    return both.select(*KEY, section(path(), content()).alias("raw")).select(
        *KEY, X.collapse_blank_runs(F.col("raw")).alias("section")
    )


@query(_from_files("content || '�' || chr(10) AS content"))
def decoded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as bytes behind a byte-order mark and before a bad byte, decoded again."""
    raw = F.expr("concat(unhex('EFBBBF'), encode(content, 'UTF-8'), unhex('FF0A'))")
    return V.files(spark, sf_dir).select(*KEY, X.decode_text(raw).alias("content"))


# --- filters -----------------------------------------------------------------------

_GLOBS = ["node_modules", "D?ST", "logs/", "*.tar.*", "x/y", "f1*.MD"]


@query(
    O.with_(
        V.CTE["files"],
        f"globs AS (SELECT {O.segment_pattern('g')} AS pattern FROM (SELECT unnest([{', '.join(O.q(g) for g in _GLOBS)}]) AS g))",
        select=f"""SELECT workspace, ordinal, path, EXISTS (SELECT 1 FROM globs,
      (SELECT unnest({O.segments('files.path')}) AS s) WHERE regexp_matches(s, pattern)) AS ignored FROM files""",
    )
)
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    regex = segment_regex(F.array(*[F.lit(g) for g in _GLOBS]))
    return V.files(spark, sf_dir).select(*KEY, "path", matches_segment(path(), regex).alias("ignored"))


@query(_from_files(f"path, {O.extension('path')} IN ('ts', 'md', 'gz', '') AS allowed"))
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = wanted_extensions(F.array(F.lit(".TS"), F.lit("md"), F.lit("Gz"), F.lit(".")))
    return V.files(spark, sf_dir).select(*KEY, "path", extension_allowed(path(), wanted).alias("allowed"))


@query(_from_files("size_bytes, size_bytes > 8 * 1024 AS too_large, size_bytes > 1536 AS above_half"))
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("size_bytes")
    return V.files(spark, sf_dir).select(
        *KEY,
        "size_bytes",
        exceeds_size_limit(size, F.lit(8.0)).alias("too_large"),
        exceeds_size_limit(size, F.lit(1.5)).alias("above_half"),
    )


@query(_from_files(f"{O.binary('content')} AS binary"))
def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).select(*KEY, X.looks_binary(content()).alias("binary"))


_PROBES = ["dist", "a/dist", "f31.png", "docs", "b/docs", "logs/a/b", "src/f11.ts", "packages/app", "f1.MD", "src/a.vue"]


@query(
    O.with_(
        V.CTE["ignore_texts"],
        O.parsed_rules("rules", "ignore_texts", "doc_id"),
        select=f"""SELECT doc_id, CAST(pos AS INT) AS ordinal, negated, dir_only,
    {" || ".join(f"CASE WHEN regexp_matches({O.q(p)}, pattern) THEN '1' ELSE '0' END" for p in _PROBES)} AS probes FROM rules""",
    )
)
def ignore_rules_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = V.ignore_texts(spark, sf_dir).select("doc_id", F.explode(parse_rules(F.col("ignore_text"))).alias("r"))
    probes = [F.when(matches(F.lit(p), F.col("r.pattern")), "1").otherwise("0") for p in _PROBES]
    return rules.select("doc_id", "r.ordinal", "r.negated", "r.dir_only", F.concat(*probes).alias("probes"))


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["workspaces"],
        O.parsed_rules("rules", "workspaces", "workspace"),
        O.IGNORED_BY_FILE,
        O.resolved("workspaces", "workspace", "settings"),
        select="""SELECT workspace, ordinal, path, respect_gitignore AND coalesce(ignored, false) AS ignored
    FROM files JOIN settings USING (workspace) LEFT JOIN by_file USING (workspace, ordinal)""",
    )
)
def ignore_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with(spark, sf_dir, "rules")
    verdict = is_ignored(path(), F.col("rules.rules"), F.col("rules.rules_regex"), F.col("rules.rules_negated"))
    return rows.select(*KEY, "path", verdict.alias("ignored"))


@query(
    O.with_(
        V.CTE["workspaces"],
        O.parsed_rules("rules", "workspaces", "workspace"),
        O.resolved("workspaces", "workspace", "settings"),
        select="""SELECT workspace, count(pos) FILTER (respect_gitignore) AS rules,
    count(pos) FILTER (respect_gitignore AND negated) AS negated FROM settings LEFT JOIN rules USING (workspace) GROUP BY ALL""",
    )
)
def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules taken from the ignore file that lies among the files of each workspace."""
    spaces = V.workspaces(spark, sf_dir)
    own = spaces.filter("ignore_text != ''").selectExpr(
        "workspace", "cast(0 AS bigint) AS ordinal", "'.gitignore' AS path", "ignore_text AS content", "cast(0 AS bigint) AS size_bytes"
    )
    found = workspace_settings(spaces.drop("ignore_text"), V.files(spark, sf_dir).unionByName(own))
    rules = F.col("rules.rules")
    return found.select(
        "workspace",
        F.size(rules).cast("bigint").alias("rules"),
        F.size(F.filter(rules, lambda r: r["negated"])).cast("bigint").alias("negated"),
    )


_COLLECTED = (*O.FULL[:5],)


@query(
    O.with_(
        *_COLLECTED,
        select=f"""SELECT workspace, ordinal, path, early AS reason,
    CASE WHEN early = 'too-large' THEN {O.size_label('size_bytes')} END AS detail FROM reasoned WHERE early IS NOT NULL""",
    ),
    name="collect_files",
)
def collect_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, skipped = collect_files(_with(spark, sf_dir, "rules"), F.col("rules"))
    return skipped.select(*KEY, "path", "reason", "detail")


@query(O.with_(*_COLLECTED, select="SELECT workspace, ordinal, path, content, size_bytes FROM reasoned WHERE early IS NULL"))
def collect_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = collect_files(_with(spark, sf_dir, "rules"), F.col("rules"))
    return kept.select(*KEY, "path", "content", "size_bytes")


@query(
    O.with_(
        *O.FULL,
        select="SELECT workspace, stage, reason, count(*) AS files FROM guarded WHERE reason IS NOT NULL GROUP BY ALL",
    )
)
def skips_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = _audit(spark, sf_dir).filter(F.col("reason").isNotNull())
    return skipped.groupBy("workspace", "stage", "reason").agg(F.count(F.lit(1)).alias("files"))


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["workspaces"],
        O.parsed_rules("rules", "workspaces", "workspace"),
        O.IGNORED_BY_FILE,
        O.JUDGED,
        select="""SELECT workspace, ordinal, path, early AS reason FROM reasoned
    WHERE early IN ('ignored', 'extension-filter')""",
    )
)
def path_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with(spark, sf_dir, "rules").select(*KEY, "path", path_skip_reason(path(), F.col("rules")).alias("reason"))
    return rows.filter(F.col("reason").isNotNull())


# --- guard -------------------------------------------------------------------------


@query(
    O.with_(
        V.CTE["files"],
        select=f"SELECT workspace, ordinal, path, {O.denied('path')} AS rule FROM files WHERE {O.denied('path')} IS NOT NULL",
    )
)
def deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.files(spark, sf_dir).select(*KEY, "path", denied_name(path()).alias("rule"))
    return rows.filter(F.col("rule").isNotNull())


_ALL_TEXTS = "all_texts AS (SELECT workspace, ordinal, path, content FROM files UNION ALL SELECT workspace, ordinal, path, content FROM page_files)"
_MASKED = (V.CTE["files"], V.CTE["page_files"], _ALL_TEXTS, O.mask_chain("masked", "all_texts", "workspace, ordinal, path", "content"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_secrets(V.files(spark, sf_dir, spread=True).unionByName(V.pages(spark, sf_dir, spread=True)))


@query(O.with_(*_MASKED, select="SELECT workspace, ordinal, text AS content, CAST(len(hits) AS INT) AS values_masked FROM masked"))
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select(*KEY, "content", F.size("redactions").alias("values_masked"))


@query(
    O.with_(
        *_MASKED,
        select="""SELECT workspace, ordinal, path, CAST(h.line AS INT) AS line, h.rule AS rule
    FROM (SELECT workspace, ordinal, path, unnest(hits) AS h FROM masked)""",
    )
)
def redaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction_rows(_masked(spark, sf_dir), *KEY, "path")


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["page_files"],
        _ALL_TEXTS,
        f"open_texts AS (SELECT * FROM all_texts WHERE {O.denied('path')} IS NULL)",
        O.mask_chain("masked", "open_texts", "workspace, ordinal, path", "content"),
        select=f"""SELECT workspace, ordinal, path, 'deny-list' AS reason, {O.denied('path')} AS detail FROM all_texts
    WHERE {O.denied('path')} IS NOT NULL UNION ALL SELECT workspace, ordinal, path, 'secret-content',
    {O.distinct_rules('hits')} FROM masked WHERE len(hits) > 0""",
    )
)
def drop_on_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.files(spark, sf_dir, spread=True).unionByName(V.pages(spark, sf_dir, spread=True))
    none = F.lit(None).cast("string")
    rows = both.withColumns({"stage": F.lit(None).cast("int"), "reason": none, "detail": none})
    judged = guard(rows, guard_options(literal_settings(guard_mode="skipFile")), user_patterns=False)
    verdicts = store(judged.select(*KEY, "path", "reason", "detail"), "verdicts")
    return verdicts.filter(F.col("reason").isNotNull())


@query(
    O.with_(
        V.CTE["files"],
        "even AS (SELECT * FROM files WHERE ordinal % 2 = 0)",
        "odd AS (SELECT * FROM files WHERE ordinal % 2 = 1)",
        O.mask_chain(
            "masked",
            "even",
            "workspace, ordinal",
            "content",
            extra=((r"(Projects/)app", r"\1<REDACTED:custom-1>", "custom-1"), (r"astral [^ ]*", r"<REDACTED:custom-3>", "custom-3")),
        ),
        O.mask_chain("plain", "odd", "workspace, ordinal", "content"),
        select="""SELECT workspace, ordinal, text AS content,
    array_to_string(list_transform(hits, lambda h: h.line || ' ' || h.rule), ',') AS log
    FROM (SELECT * FROM masked UNION ALL SELECT * FROM plain)""",
    )
)
def extra_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows have patterns: one with a group, one that is none, one whose group takes no part."""
    patterns = F.array(F.lit(r"Projects/(app)"), F.lit("("), F.lit(r"zz(\d)|astral [^ ]*"))
    wanted = F.when(F.col("ordinal") % 2 == 0, patterns).otherwise(F.array().cast("array<string>"))
    masked = mask_secrets(V.files(spark, sf_dir, spread=True), extra_patterns=wanted)
    log = F.transform("redactions", lambda r: F.concat_ws(" ", r["line"].cast("string"), r["rule"]))
    return masked.select(*KEY, "content", F.array_join(log, ",").alias("log"))


@query(
    O.with_(
        *O.FULL,
        select="SELECT workspace, ordinal, path, stage, reason, detail FROM guarded WHERE reason IS NOT NULL",
    )
)
def skipped_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left out for their size before they are read, by the filters and by the guard."""
    settings = _settings(spark, sf_dir)
    rules = settings.select("workspace", "rules")
    files = V.files(spark, sf_dir, spread=True)
    listed = join_dimension(files, rules, ["workspace"], spread_by=["path"])
    limit = F.when(path_skip_reason(F.col("path"), F.col("rules")).isNull(), F.col("rules.max_file_size_kb"))
    readable, large = split_by_size(listed, limit)
    guarded = guard_files(readable.drop("rules"), settings)
    rows = guarded.unionByName(too_large(large), allowMissingColumns=True)
    rows = store(rows.select(*KEY, "path", "stage", "reason", "detail"), "skipped")
    return rows.filter(F.col("reason").isNotNull())


# --- packs -------------------------------------------------------------------------


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _settings(spark, sf_dir)
    guarded = guard_files(V.files(spark, sf_dir, spread=True), settings)
    # Stored, because a gate reads the totals from both sides.
    return store(totals_for(render_files(guarded), settings), "totals")


_TOTALS = "file_count, skipped_count, redaction_count, masked_files, masked_lines, file_tokens, total_tokens"


@query(
    O.with_(
        *O.WORKSPACE_PACKS,
        select=f"""SELECT workspace, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _TOTALS.split(', '))}
    FROM decided_packs""",
    )
)
def pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select("workspace", *_TOTALS.split(", "))


_BY_THREE = O.with_(
    *O.WORKSPACE_PACKS,
    select="SELECT workspace, CAST(file_tokens AS BIGINT) AS file_tokens, CAST(total_tokens AS BIGINT) AS total_tokens FROM decided_packs",
).replace("/ 4.0", "/ 3.0")


@query(_BY_THREE)
def other_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One estimator for files and for whole documents: here three units a token."""

    def by_three(units):
        return F.ceil(units / F.lit(3)).cast("bigint")

    tables = pack(V.files(spark, sf_dir, spread=True), V.workspaces(spark, sf_dir), estimator=by_three)
    return tables.packs.select("workspace", "file_tokens", "total_tokens")


_PICKED = f"picked AS (SELECT workspace, ordinal, rtrim({O.normalised('prefix')}, '/') AS prefix FROM selection)"
_COVERS = f"""p.workspace = f.workspace AND
    ({O.normalised('f.path')} = p.prefix OR starts_with({O.normalised('f.path')}, p.prefix || '/'))"""


@query(
    O.with_(
        V.CTE["files"],
        V.CTE["selection"],
        _PICKED,
        select=f"""SELECT workspace, count(*) AS files, CAST(sum({O.tokens('content')}) AS BIGINT) AS tokens FROM files f
    WHERE EXISTS (SELECT 1 FROM picked p WHERE {_COVERS}) GROUP BY ALL""",
    )
)
def selection_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw size of what was picked, before any filter."""
    picked = select_files(V.files(spark, sf_dir), V.selection(spark, sf_dir))
    return picked.groupBy("workspace").agg(
        F.count(F.lit(1)).alias("files"), F.sum(X.estimate_tokens(content())).alias("tokens")
    )


@query(
    O.with_(
        *O.FULL,
        select=f"""SELECT workspace, ordinal, stage, '- `' || {O.posix('path')} || '` — ' || reason || coalesce(': ' || detail, '') AS line
    FROM guarded WHERE reason IS NOT NULL UNION ALL
    SELECT workspace, ordinal, -1, '- `' || {O.posix('path')} || '` — ' || len(hits) || ' (' || {O.distinct_rules('hits')} || ')'
    FROM guarded WHERE reason IS NULL AND len(hits) > 0""",
    )
)
def guard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.col("reason").isNull()
    line = F.when(kept, masked_line(path(), F.col("redactions"))).otherwise(skipped_line(path(), F.col("reason"), F.col("detail")))
    rows = _audit(spark, sf_dir).filter(~kept | (F.size("redactions") > 0))
    return rows.select(
        *KEY, F.when(kept, -1).otherwise(F.col("stage")).alias("stage"), F.rtrim(line, F.lit("\n")).alias("line")
    )


def _chunks(packs: str) -> str:
    """Documents cut every ``CHUNK_CHARS`` characters, from whole ones."""
    numbers = f"unnest(range(CAST(ceil(length(markdown) / {CHUNK_CHARS}.0) AS BIGINT)))"
    return f"""SELECT workspace, position, position * {CHUNK_CHARS} AS "offset", substr(markdown, position * {CHUNK_CHARS} + 1, {CHUNK_CHARS}) AS text
    FROM (SELECT workspace, markdown, {numbers} AS position FROM {packs})"""


@query(O.with_(*O.WORKSPACE_PACKS, select=_chunks("decided_packs")))
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = pack(V.files(spark, sf_dir, spread=True), V.workspaces(spark, sf_dir))
    return document_chunks(tables.documents)


_CONVERSATIONS = (
    V.CTE["turns"],
    O.mask_chain("masked", "turns", "workspace, ordinal", "content"),
    """guarded AS (SELECT t.workspace, t.ordinal, t.path, m.text AS content, m.hits, CAST(NULL AS VARCHAR) AS reason,
      CAST(NULL AS VARCHAR) AS detail, 0 AS stage FROM turns t JOIN masked m USING (workspace, ordinal))""",
    """pack_workspaces AS (SELECT DISTINCT workspace, 'Answer ' || workspace AS task, 'en' AS output_language,
      true AS include_overview FROM turns)""",
    O.document_ctes("guarded", "pack_workspaces"),
)


@query(O.with_(*_CONVERSATIONS, select=_chunks("packs")))
def conversation_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.turns(spark, sf_dir)
    workspaces = turns.select("workspace").distinct().selectExpr(
        "workspace", "'Answer ' || workspace AS task", """'{"outputLanguage":"en"}' AS settings_json"""
    )
    tables = pack(turns, workspaces)
    return document_chunks(tables.documents)


@query(
    O.with_(
        *O.WORKSPACE_PACKS,
        select="SELECT workspace, review_required, array_to_string(reasons, '; ') AS reasons FROM decided_packs",
    )
)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select(
        "workspace", "review_required", F.array_join("review_reasons", "; ").alias("reasons")
    )


_GATED = """gated AS (SELECT p.*, NOT review_required OR a.workspace IS NOT NULL AS released
  FROM decided_packs p LEFT JOIN approvals a ON a.workspace = p.workspace)"""


@query(O.with_(*O.WORKSPACE_PACKS, V.CTE["approvals"], _GATED, select="SELECT workspace, released FROM gated"))
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    released, held = gate(_totals(spark, sf_dir), V.approvals(spark, sf_dir))
    return released.select("workspace", F.lit(True).alias("released")).unionByName(
        held.select("workspace", F.lit(False).alias("released"))
    )


@query(
    O.with_(
        *O.WORKSPACE_PACKS,
        select=f"""SELECT workspace, file_count || ' file(s) · ~' || {O.grouped('total_tokens')} || ' tokens' ||
    CASE WHEN redaction_count > 0 THEN ' · ' || CAST(redaction_count AS BIGINT) || ' redacted' ELSE '' END ||
    CASE WHEN skipped_count > 0 THEN ' · ' || skipped_count || ' skipped' ELSE '' END AS summary,
    redaction_count > 0 OR skipped_count > 0 AS has_warning FROM decided_packs""",
    )
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select("workspace", "summary", "has_warning")


@query(
    O.with_(
        *O.WORKSPACE_PACKS,
        V.CTE["approvals"],
        _GATED,
        select=f"""SELECT workspace, CASE WHEN released THEN 'delivered' ELSE 'cancelled' END AS outcome,
    CASE WHEN released THEN file_count || ' file(s), about ' || {O.grouped('total_tokens')} || ' tokens' END AS detail FROM gated""",
    ),
    name="deliver",
)
def delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery_outcomes(*gate(_totals(spark, sf_dir), V.approvals(spark, sf_dir)))


@query(
    O.with_(
        *O.WORKSPACE_PACKS,
        V.CTE["approvals"],
        _GATED,
        f"chunks AS ({_chunks('gated')})",
        select="""SELECT target, g.workspace, CASE WHEN released THEN 'delivered' ELSE 'cancelled' END AS outcome,
    CASE WHEN released THEN lpad(CAST(c.position AS VARCHAR), 8, '0') || '.md' END AS name, CASE WHEN released THEN md5(c.text) END AS digest
    FROM (SELECT unnest(['files', 'jsonl']) AS target), gated g LEFT JOIN chunks c ON released AND c.workspace = g.workspace""",
    )
)
def delivered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two targets hold after a write in two phases, and how each pack fared."""
    tables = pack(V.files(spark, sf_dir, spread=True), V.workspaces(spark, sf_dir))
    outcomes = delivery_outcomes(*gate(tables.packs, V.approvals(spark, sf_dir)))
    released = outcomes.where(F.col("outcome") == DELIVERED).select("workspace")
    kept = join_dimension(tables.documents, released, ["workspace"], spread_by=["position"], how="left_semi")
    name = F.concat(F.lpad(F.col("position").cast("string"), 8, "0"), F.lit(".md"))
    chunks = store(document_chunks(kept).select("workspace", name.alias("name"), F.col("text").alias("content")), "chunks")
    found, paths = [], []
    for target in ("files", "jsonl"):
        paths.append(path := fresh_path(spark, "delivery"))
        report = deliver_documents(chunks, path, target=target)
        fared = written_outcomes(outcomes, report).select("workspace", "outcome")
        held = delivered_files(spark, path) if target == "files" else delivered_lines(spark, path)
        held = held.select("workspace", "name", F.md5(F.col("content").cast("binary")).alias("digest"))
        found.append(fared.join(held, "workspace", "left").select(F.lit(target).alias("target"), "workspace", "outcome", "name", "digest"))
    result = store(found[0].unionByName(found[1]), "delivered")
    for path in paths:
        discard(spark, path)
    return result


@query(
    O.with_(
        *O.FULL[:5],
        select="""SELECT workspace, path, size_bytes, CASE WHEN early IS DISTINCT FROM 'too-large' THEN md5(content) END AS digest
    FROM reasoned WHERE early IS NULL OR early NOT IN ('ignored', 'extension-filter')""",
    )
)
def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files written out as trees and scanned back under the rules of their workspaces."""
    rows = V.files(spark, sf_dir, spread=True).select("workspace", path().alias("name"), "content")
    written = fresh_path(spark, "trees")
    roots = delivered_roots(deliver_documents(rows, written), written)
    found = read_tree(roots, store(_settings(spark, sf_dir).select("workspace", "rules"), "rules"))
    result = store(found.select("workspace", "path", "size_bytes", F.md5("raw").alias("digest")), "scanned")
    discard(spark, written)
    return result


@query(
    O.with_(
        *O.WORKSPACE_PACKS,
        select=f"""SELECT g.workspace, g.ordinal, {O.language_tag('g.path')} AS language_tag, {O.tokens('g.content')} AS token_estimate,
    {O.collapsed(f"chr(10) || {O.section('g.path', 'g.content')} || chr(10)")} AS section
    FROM guarded g WHERE g.reason IS NULL""",
    )
)
def pack_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = render_files(store(_guarded(spark, sf_dir), "guarded")).filter(F.col("reason").isNull())
    return rendered.select(*KEY, "language_tag", "token_estimate", "section")


# --- selections and settings -------------------------------------------------------


def _selected_sql(files: str, selection: str) -> str:
    return O.with_(
        V.CTE[files],
        V.CTE[selection],
        f"picked AS (SELECT workspace, ordinal, rtrim({O.normalised('prefix')}, '/') AS prefix FROM selection)",
        select=f"""SELECT f.workspace, f.ordinal, f.path, min(p.ordinal) AS selection_rank FROM files f JOIN picked p
    ON p.workspace = f.workspace AND ({O.normalised('f.path')} = p.prefix OR starts_with({O.normalised('f.path')}, p.prefix || '/'))
    GROUP BY ALL""",
    )


@query(_selected_sql("files", "selection"), name="select_files")
def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(V.files(spark, sf_dir), V.selection(spark, sf_dir)).select(*KEY, "path", "selection_rank")


@query(_selected_sql("files_by_language", "selection_by_language"))
def select_files_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of picked paths in a workspace."""
    found = select_files(V.files_by_language(spark, sf_dir), V.selection_by_language(spark, sf_dir))
    return found.select(*KEY, "path", "selection_rank")


def _explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).filter(path().startswith("src")).select("workspace", "path").distinct()


def _default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).groupBy("workspace").agg(F.max("path").alias("path"))


_MERGE = (
    V.CTE["files"],
    "explicit AS (SELECT DISTINCT workspace, path FROM files WHERE starts_with(path, 'src'))",
    "chosen AS (SELECT workspace, max(path) AS path FROM files GROUP BY workspace)",
)


@query(
    O.with_(
        *_MERGE,
        select="""SELECT workspace, path, false AS is_default FROM explicit UNION ALL SELECT workspace, path, true FROM chosen c
    WHERE NOT EXISTS (SELECT 1 FROM explicit e WHERE e.workspace = c.workspace AND e.path = c.path)""",
    ),
    name="merge_selection",
)
def merged_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_selection(_explicit(spark, sf_dir), _default(spark, sf_dir))


_PRIORITY = "CASE WHEN size_bytes > 20000 THEN 0 WHEN size_bytes > 9000 THEN 1 ELSE 2 END"


@query(
    O.with_(
        V.CTE["files"],
        f"candidates AS (SELECT workspace, path, {_PRIORITY} AS priority FROM files)",
        select="""SELECT workspace, path, priority FROM candidates c
    WHERE priority = (SELECT min(priority) FROM candidates d WHERE d.workspace = c.workspace)""",
    ),
    name="selection_fallback",
)
def fallback_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection_fallback(V.files(spark, sf_dir).selectExpr("workspace", "path", f"{_PRIORITY} AS priority"))


@query(
    O.with_(
        V.CTE["files"],
        select="SELECT workspace, path, row_number() OVER (PARTITION BY workspace ORDER BY path) AS ordinal FROM files",
    )
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinals(V.files(spark, sf_dir).select("workspace", "path"))


_LISTS = ("include_extensions", "ignore_patterns", "extra_patterns")
_SCALARS = (
    "respect_gitignore max_file_size_kb token_warning_threshold include_overview guard_enabled guard_mode "
    "review_policy scrub_paths output_language"
).split()


@query(
    O.with_(
        V.CTE["raw_settings"],
        O.resolved("raw_settings", "doc_id"),
        select=f"""SELECT doc_id, {', '.join(_SCALARS)}, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in _LISTS)},
    CASE WHEN len(problems) = 1 THEN problems[1] WHEN len(problems) > 1 THEN
      len(problems) || ' settings were ignored: ' || array_to_string(problems, '; ') END AS report FROM resolved""",
    ),
    name="resolve_settings",
)
def resolved_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = V.raw_settings(spark, sf_dir).select("doc_id", resolve_settings("settings_json").alias("r"))
    return resolved.select(
        "doc_id",
        *[F.col(f"r.settings.{c}") for c in _SCALARS],
        *[F.array_join(f"r.settings.{c}", "|").alias(c) for c in _LISTS],
        problem_report(F.col("r.problems")).alias("report"),
    )


@query(
    O.with_(
        V.CTE["raw_settings"],
        O.resolved("raw_settings", "doc_id"),
        select="""SELECT doc_id, array_to_string(list_transform(include_extensions, lambda e: lower(regexp_replace(e, '^\\.', ''))), '|')
      AS extensions, max_file_size_kb, CASE WHEN guard_enabled THEN guard_mode ELSE 'redact' END AS mode,
    CASE WHEN guard_enabled THEN array_to_string(extra_patterns, '|') ELSE '' END AS extra_patterns,
    guard_enabled AS content_scanning FROM resolved""",
    )
)
def filter_and_guard_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = V.raw_settings(spark, sf_dir).select("doc_id", resolve_settings("settings_json").alias("r"))
    settings = resolved.select("doc_id", F.col("r.settings").alias("s"))
    mapped = settings.select(
        "doc_id", compiled_rules(F.col("s")).alias("rules"), guard_options(F.col("s")).alias("options")
    )
    return mapped.select(
        "doc_id",
        F.array_join("rules.extensions", "|").alias("extensions"),
        "rules.max_file_size_kb",
        "options.mode",
        F.array_join("options.extra_patterns", "|").alias("extra_patterns"),
        "options.content_scanning",
    )


# --- flagship ----------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack totals with their review decision, one row per workspace."""
    return _totals(spark, sf_dir).select(
        "workspace",
        *_TOTALS.split(", "),
        "review_required",
        F.array_join("review_reasons", "; ").alias("review_reasons"),
        "summary",
    )
