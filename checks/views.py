"""Inputs for the queries, derived from the given tables.

Each view is a set of expressions that Spark and DuckDB read alike, so both engines
start from the same rows. They keep every row and every text whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bindery.session import spread_small

NL = "chr(10)"
BS = "chr(92)"
TICK = "chr(96)"
QUOTE = "chr(34)"


def _id(column: str = "doc_id") -> str:
    return f"CAST({column} AS STRING)"


# A corpus of files with the paths and contents the operators must tell apart.
_DIRECTORY = f"""CASE doc_id % 9 WHEN 0 THEN 'node_modules/pkg/' WHEN 1 THEN 'dist/' WHEN 2 THEN 'packages/app/dist/'
    WHEN 3 THEN 'logs/a/b/' WHEN 4 THEN 'docs/' WHEN 5 THEN 'src' || {BS} || 'core' || {BS} ELSE 'src/' END"""
_NAME = f"""CASE WHEN doc_id % 53 = 0 THEN '.env.' || {_id()} WHEN doc_id % 59 = 0 THEN 'secrets_' || {_id()} || '.json'
    WHEN doc_id % 61 = 0 THEN 'd' || {_id()} || '/Dockerfile'
    ELSE 'f' || {_id()} || CASE doc_id % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.MD' WHEN 2 THEN '.py' WHEN 3 THEN '.png'
    WHEN 4 THEN '.sql' WHEN 5 THEN '' WHEN 6 THEN '.tar.gz' ELSE '.vue' END END"""
_HASH = f"md5({_id()})"
_PARTS = (
    (7, f"'/home/u1/Projects/app/run.log' || {NL}"),
    (10, f"'see /home/u1/notes and ' || {BS} || 'HOME' || {BS} || 'U1/x' || {NL}"),
    (11, f"'  ' || repeat({TICK}, 4) || {NL} || 'x' || {NL} || '  ' || repeat({TICK}, 4) || {NL}"),
    (13, f"'a' || repeat({NL}, 4) || 'b' || {NL}"),
    (17, f"'const password = ' || {QUOTE} || 'hunter2' || {QUOTE} || ';' || {NL}"),
    (19, f"'url: postgres://app:pw' || {_id()} || '@db/x' || {NL}"),
    (23, f"repeat('�', CASE doc_id % 2 WHEN 0 THEN 1000 ELSE 20 END)"),
    (27, f"'astral 😀😀 ' || {_id()} || {NL}"),
    (29, f"'key AKIA' || upper(substr({_HASH}, 1, 16)) || ' and AKIA' || upper(substr({_HASH}, 3, 16)) || {NL}"),
    (31, f"'Authorization: Bearer ' || {_HASH} || {NL}"),
    (37, f"'id=sk-' || {_HASH} || {NL}"),
    (41, f"'ghp_' || {_HASH} || 'abcd xoxb-' || {_HASH} || {NL}"),
    (43, f"'jwt eyJ' || {_HASH} || '.eyJ' || {_HASH} || '.' || {_HASH} || {NL}"),
    (47, f"'DB_TOKEN=' || {_HASH} || {NL}"),
    (51, f"'password = ' || {QUOTE} || repeat({BS} || 'n', 60) || {_id()} || {QUOTE} || {NL}"),
    (57, f"'password = ' || {QUOTE} || '<hunter2' || {QUOTE} || ' and token: ' || {QUOTE} || {BS} || 'x41bcd' || {QUOTE} || {NL}"),
    (63, f"'Authorization: Basic <abc' || {_id()} || {NL}"),
    (69, f"'postgres://u:p/w@h/x and amqp://u:a@b' || {_id()} || '@h and http://h:80/a@b and http://h:1234567/a@b' || {NL}"),
    (77, f"'DB_PASSWORD = hunter' || {_id()} || {NL} || 'aws_secret_access_key = a/b+' || {_HASH} || {NL} || 'token == x' || {NL}"),
    (81, f"'password: hunter2 and token: string' || {NL} || 'secret=<REDACTED:old> secret=' || {QUOTE} || '<REDACTED:old>' || {QUOTE} || {NL}"),
)
_PREFIX = " || ".join(f"CASE WHEN doc_id % {n} = 0 THEN {part} ELSE '' END" for n, part in _PARTS)

FILES = {"workspace": "source", "ordinal": "doc_id", "path": f"{_DIRECTORY} || {_NAME}", "content": f"{_PREFIX} || text"}

# Conversations as ordered packs of turns.
TURNS = {
    "workspace": f"'conv' || {_id('conv_id')}",
    "ordinal": "turn",
    "path": f"'turns/' || {_id('turn')} || '-' || role || '.md'",
    "content": "text",
}

# Web pages as single-line files.
PAGES = {
    "workspace": "'pages'",
    "ordinal": "page_id",
    "path": f"'html/' || {_id('page_id')} || '.html'",
    "content": "html",
}

# Per workspace: roots, a task, settings and an ignore file, by the number of its source.
_N = "CAST(substr(workspace, 4) AS INT)"
_SETTINGS = (
    '{"outputLanguage":"en","includeExtensions":["ts","md","py","vue","png",""]}',
    '{"includeExtensions":[],"maxFileSizeKb":8,"outputLanguage":"en"}',
    '{"includeExtensions":["ts","md","png","py","gz"],"secretGuard.mode":"skipFile","previewBeforeCopy":"always"}',
    '{"includeExtensions":[".TS","vue","sql","Py"],"ignorePatterns":["LOGS","d*t"],"secretGuard.enabled":false,'
    '"tokenWarningThreshold":5000,"outputLanguage":"en","previewBeforeCopy":"never"}',
    '{"includeExtensions":[],"ignorePatterns":[],"respectGitignore":false,"maxFileSizeKb":0,'
    '"includeProjectOverview":false,"scrubAbsolutePaths":false}',
    '{"includeExtensions":[],"tokenWarningThreshold":1000,"outputLanguage":"fr","maxFileSizeKb":"big"}',
)
_IGNORE = (
    f"'# build' || {NL} || 'dist/' || {NL} || '*.png' || {NL} || '!f*1.png' || {NL}",
    f"'/docs' || {NL} || 'logs/**' || {NL} || '   ' || {NL} || '*.MD  ' || {NL} || '!f?.MD' || {NL} || 'f1*.MD'",
    "''",
    f"'packages/' || {NL} || '!packages/app/' || {NL} || 'src/f1?.ts' || {NL} || '*.vue' || {NL} || '!src/*.vue' || {NL}",
)


def _case(number: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {number} % {len(values)} {arms} END"


_ROOT = "/home/u1/Projects/app"
WORKSPACES = {
    "workspace": "workspace",
    "workspace_root": _case(
        _N, [f"'{_ROOT}'", f"'{_ROOT}/'", "CAST(NULL AS STRING)", "'/'", f"{BS} || 'HOME' || {BS} || 'u1//Projects/app'"]
    ),
    "home_dir": _case(_N, ["'/home/u1'", "'/home/u1/'", "'/'", "CAST(NULL AS STRING)"]),
    "task": _case(_N, ["'Explain this'", f"'  ' || {NL} || ' '", f"' a' || repeat({NL}, 4) || 'b '", "CAST(NULL AS STRING)"]),
    "settings_json": _case(_N, [f"'{s}'" for s in _SETTINGS]),
    "ignore_text": _case(_N, list(_IGNORE)),
}

# What was picked: one entry per document, many of them folders and many the same.
SELECTION = {
    "workspace": "source",
    "ordinal": "doc_id",
    "prefix": f"""CASE WHEN doc_id % 4 = 0 THEN ({FILES['path']}) WHEN doc_id % 50 = 1 THEN 'dist/'
    WHEN doc_id % 50 = 13 THEN 'src' || {BS} || 'core' WHEN doc_id % 100 = 27 THEN 'logs/a' ELSE 'none/' || {_id()} END""",
}

# One JSON text of settings per document: its own figures in valid and invalid places.
RAW_SETTINGS = {
    "doc_id": "doc_id",
    "settings_json": f"""CASE doc_id % 8
    WHEN 0 THEN '{{"maxFileSizeKb":' || {_id('n_chars')} || ',"outputLanguage":"' || lang || '"}}'
    WHEN 1 THEN '{{"maxFileSizeKb":-' || {_id()} || ',"tokenWarningThreshold":"' || {_id()} || '"}}'
    WHEN 2 THEN '{{"includeExtensions":["' || lang || '"," ' || source || ' ",' || {_id()} || ',null,""]}}'
    WHEN 3 THEN '{{"respectGitignore":' || {_id()} || ',"secretGuard.mode":"' || source || '"}}'
    WHEN 4 THEN '{{"ignorePatterns":"' || source || '","scrubAbsolutePaths":false,"includeProjectOverview":null}}'
    WHEN 5 THEN '{{"previewBeforeCopy":"always","secretGuard.mode":"skipFile","secretGuard.enabled":false}}'
    WHEN 6 THEN '{{"secretGuard.extraPatterns":["' || source || '"],"ignorePatterns":[],"outputLanguage":"en"}}'
    ELSE '{{}}' END""",
}

# One ignore file per document: that of its workspace followed by the document itself.
IGNORE_TEXTS = {
    "doc_id": "doc_id",
    "ignore_text": f"({_case('doc_id', list(_IGNORE))}) || {NL} || text",
}


def expressions(view: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in view.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_size(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", "cast(octet_length(content) AS bigint) AS size_bytes")


def files(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``spread`` asks for all slots, for queries that work hard on the contents."""
    documents = table(spark, sf_dir, "documents")
    documents = spread_small(documents, "doc_id") if spread else documents
    return _with_size(documents.selectExpr(*expressions(FILES)))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_size(table(spark, sf_dir, "conversations").selectExpr(*expressions(TURNS)))


def pages(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    found = table(spark, sf_dir, "pages")
    return _with_size((spread_small(found, "page_id") if spread else found).selectExpr(*expressions(PAGES)))


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").selectExpr("source AS workspace").distinct()
    return names.selectExpr(*expressions(WORKSPACES))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second workspace was approved."""
    return workspaces(spark, sf_dir).selectExpr("workspace", f"{_N} % 2 = 0 AS approved").filter("approved").select("workspace")


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*expressions(SELECTION))


def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files in a few large workspaces."""
    return _with_size(table(spark, sf_dir, "documents").selectExpr(*expressions(FILES | {"workspace": "lang"})))


def selection_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*expressions(SELECTION | {"workspace": "lang"}))


def raw_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*expressions(RAW_SETTINGS))


def ignore_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*expressions(IGNORE_TEXTS))


def _cte(name: str, view: dict[str, str], source: str, size: bool = False) -> str:
    inner = f"SELECT {', '.join(expressions(view))} FROM {source}"
    if size:
        inner = f"SELECT *, CAST(strlen(content) AS BIGINT) AS size_bytes FROM ({inner})"
    return f"{name} AS ({inner})"


# The same views for the other engine, as common table expressions.
CTE = {
    "files": _cte("files", FILES, "documents", True),
    "turns": _cte("turns", TURNS, "conversations", True),
    "page_files": _cte("page_files", PAGES, "pages", True),
    "workspaces": _cte("workspaces", WORKSPACES, "(SELECT DISTINCT source AS workspace FROM documents)"),
    "approvals": f"approvals AS (SELECT workspace FROM (SELECT DISTINCT source AS workspace FROM documents) WHERE {_N} % 2 = 0)",
    "selection": _cte("selection", SELECTION, "documents"),
    "files_by_language": _cte("files", FILES | {"workspace": "lang"}, "documents", True),
    "selection_by_language": _cte("selection", SELECTION | {"workspace": "lang"}, "documents"),
    "raw_settings": _cte("raw_settings", RAW_SETTINGS, "documents"),
    "ignore_texts": _cte("ignore_texts", IGNORE_TEXTS, "documents"),
}
