"""DuckDB statements that compute the registered queries independently.

They follow the described behaviour by brute force (every path prefix against every
rule, every line against every pattern, whole documents built and measured), where the
operators avoid exactly that.
"""

from __future__ import annotations

from checks.views import CTE

NL = "chr(10)"
BLANKS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


# Fixed values, stated here on their own so that a slip in the engine shows.
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

TAG_BY_EXTENSION = {
    "ts": "ts",
    "mts": "ts",
    "cts": "ts",
    "tsx": "tsx",
    "js": "js",
    "mjs": "js",
    "cjs": "js",
    "jsx": "jsx",
    "vue": "vue",
    "svelte": "svelte",
    "json": "json",
    "jsonc": "jsonc",
    "css": "css",
    "scss": "scss",
    "sass": "sass",
    "less": "less",
    "html": "html",
    "htm": "html",
    "xml": "xml",
    "svg": "xml",
    "csproj": "xml",
    "md": "md",
    "mdx": "mdx",
    "yml": "yaml",
    "yaml": "yaml",
    "toml": "toml",
    "ini": "ini",
    "env": "ini",
    "sql": "sql",
    "cs": "csharp",
    "py": "python",
    "rb": "ruby",
    "go": "go",
    "rs": "rust",
    "java": "java",
    "kt": "kotlin",
    "kts": "kotlin",
    "swift": "swift",
    "php": "php",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "hpp": "cpp",
    "sh": "bash",
    "bash": "bash",
    "zsh": "bash",
    "ps1": "powershell",
    "psm1": "powershell",
    "bat": "bat",
    "cmd": "bat",
    "graphql": "graphql",
    "gql": "graphql",
    "proto": "proto",
    "prisma": "prisma",
    "tf": "hcl",
    "tfvars": "hcl",
}
TAG_BY_NAME = {
    "dockerfile": "dockerfile",
    "containerfile": "dockerfile",
    "makefile": "makefile",
    "gemfile": "ruby",
    "rakefile": "ruby",
    "procfile": "bash",
    ".gitignore": "gitignore",
    ".npmrc": "ini",
    ".editorconfig": "ini",
}
DENIED_NAMES = (
    ("dotenv", r"\.env(\..*)?"),
    ("pem", r".*\.pem"),
    ("key", r".*\.key"),
    ("p12", r".*\.p12"),
    ("pfx", r".*\.pfx"),
    ("secrets", r"secrets.*"),
    ("credentials", r"credentials.*"),
    ("id-rsa", r"id_rsa"),
)

# Stands for the opening of a mask while the rules run, so that no rule takes one for a value.
MARK = "\ue000"
_KEY = "(?i:(?:api|access|secret)[_-]?key|secret|passw(?:or)?d|token)"
_RUN = r"[^\x00-\x20\"'`]"


def _between(q_: str) -> str:
    return r"(" + q_ + r")(?:[^" + q_ + r"\\\n\x{E000}]|\\[^\n])(?:[^" + q_ + r"\\\n]|\\[^\n])*(" + q_ + ")"


# Name, characters that must not stand before, pattern, groups kept before and after the mask.
MASKS = (
    ("aws-access-key", "A-Za-z0-9_", r"(?:AKIA|ASIA)[0-9A-Z]{16,}", (), ()),
    ("openai-key", "A-Za-z0-9_", r"sk-[A-Za-z0-9_-]{20,}", (), ()),
    ("github-token", "A-Za-z0-9_", r"(?:gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", (), ()),
    ("google-api-key", "A-Za-z0-9_", r"AIza[0-9A-Za-z_-]{35,}", (), ()),
    ("slack-token", "A-Za-z0-9_", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", (), ()),
    ("jwt", "A-Za-z0-9_", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", (), ()),
    (
        "connection-string", "",
        r"(://[^\x00-\x20:/@\"'<>]*:)(?:[0-9]{0,5}[^\x00-\x20\"'`0-9/?#\x{E000}]" + _RUN + r"*|[/?#]" + _RUN + r"*|[0-9]{6,}" + _RUN + r"*|[0-9]{1,5})(@)",
        (1,), (2,),
    ),
    (
        "auth-header", "",
        r"((?i:authorization)[\"']?[ \t]*[:=][ \t]*[\"'`]?(?i:bearer|basic)[ \t]+)[^\x00-\x20\"'`,;\x{E000}][^\x00-\x20\"'`,;]*",
        (1,), (),
    ),
    ("auth-header", "A-Za-z0-9_", r"((?i:bearer|basic)[ \t]+)[A-Za-z0-9._~+/-]{20,}={0,2}", (1,), ()),
    (
        "assigned-secret", "",
        "(" + _KEY + r"[\"'`]?[ \t]*(?::=|=>|[:=])[ \t]*)(?:" + "|".join(map(_between, ('"', "'", "`"))) + ")",
        (1, 2, 4, 6), (3, 5, 7),
    ),
    (
        "assigned-secret", "",
        r"((?:^|\n)[ \t]*(?:export[ \t]+)?[A-Za-z0-9_.-]*" + _KEY + r"[ \t]*=[ \t]*)[^\x00-\x20\"'`=>~\x{E000}]" + _RUN + "*",
        (1,), (),
    ),
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def segments(path: str) -> str:
    return rf"list_filter(string_split_regex({path}, '[/\\]'), lambda s: s <> '')"


def base(path: str) -> str:
    return f"coalesce({segments(path)}[-1], {path})"


def extension(path: str) -> str:
    return rf"lower(regexp_extract({base(path)}, '(?s)^.+\.([^.]*)$', 1))"


def posix(path: str) -> str:
    return f"replace({path}, chr(92), '/')"


def normalised(path: str) -> str:
    return rf"regexp_replace(regexp_replace({posix(path)}, '^\./', ''), '^/+', '')"


def units(text: str) -> str:
    return rf"(length({text}) + length(regexp_replace({text}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def tokens(text: str) -> str:
    return f"CAST(ceil({units(text)} / 4.0) AS BIGINT)"


def grouped(number: str) -> str:
    return f"format('{{:,}}', CAST({number} AS BIGINT))"


def values(table: dict[str, str]) -> str:
    return ", ".join(f"({q(k)}, {q(v)})" for k, v in table.items())


def language_tag(path: str) -> str:
    by_name = f"(SELECT t FROM (VALUES {values(TAG_BY_NAME)}) n(k, t) WHERE k = lower({base(path)}))"
    by_ext = f"(SELECT t FROM (VALUES {values(TAG_BY_EXTENSION)}) e(k, t) WHERE k = {extension(path)})"
    return f"coalesce({by_name}, {by_ext}, '')"


def fence_length(text: str) -> str:
    runs = rf"regexp_extract_all({text}, '(?m)^[\t\x0B\f \x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]*(`{{3,}})', 1)"
    return f"greatest(3, 1 + coalesce(list_max(list_transform({runs}, lambda r: length(r))), 0))"


def collapsed(text: str) -> str:
    return rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def size_label(n: str) -> str:
    return f"CAST(CAST(floor({n} / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB'"


def binary(text: str) -> str:
    head = f"substring({text}, 1, 8000)"
    return rf"(contains({head}, chr(0)) OR (length({head}) > 0 AND length(regexp_replace({head}, '[^\x{{FFFD}}]', '', 'g')) / {units(head)} > 0.1))"


def denied(path: str) -> str:
    arms = " ".join(rf"WHEN regexp_matches({base(path)}, {q(f'(?is)^(?:{p})$')}) THEN {q(n)}" for n, p in DENIED_NAMES)
    return f"CASE {arms} END"


def segment_pattern(glob: str) -> str:
    escaped = rf"regexp_replace(regexp_replace({glob}, '/+$', ''), '([.+^${{}}()|\[\]\\])', '\\\1', 'g')"
    return f"'(?i)^' || replace(replace({escaped}, '*', '[^/]*'), '?', '[^/]') || '$'"


def glob_pattern(glob: str, anchored: str) -> str:
    """Through placeholders, so that pairs of stars are read left to right."""
    one = rf"replace(regexp_replace({glob}, '([.+^${{}}()|\[\]\\])', '\\\1', 'g'), '?', '[^/]')"
    pairs = rf"replace(regexp_replace({one}, '\*\*(/?)', chr(1) || '\1', 'g'), chr(1) || '/', chr(2))"
    full = f"replace(replace(replace({pairs}, '*', '[^/]*'), chr(2), '(?:.*/)?'), chr(1), '.*')"
    return f"'^' || CASE WHEN {anchored} THEN '' ELSE '(?:.*/)?' END || {full} || '$'"


def parsed_rules(name: str, source: str, key: str) -> str:
    """CTEs that parse the ignore texts of ``source`` into ``name``."""
    return rf"""
{name}_lines AS (SELECT {key}, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS src
  FROM (SELECT {key}, string_split_regex(ignore_text, '\r?\n') AS ls FROM {source})),
{name}_trimmed AS (SELECT {key}, pos, regexp_replace(src, '(\\{BLANKS})?{BLANKS}*$', '\1') AS line FROM {name}_lines),
{name}_flags AS (SELECT {key}, pos, line[1] = '!' AS negated, CASE WHEN line[1] = '!' THEN line[2:] ELSE line END AS l1
  FROM {name}_trimmed WHERE line <> '' AND line[1] <> '#'),
{name}_dirs AS (SELECT *, l2 LIKE '%/' AS dir_only, CASE WHEN l2 LIKE '%/' THEN l2[1:-2] ELSE l2 END AS l3
  FROM (SELECT *, CASE WHEN l1[1] = chr(92) THEN l1[2:] ELSE l1 END AS l2 FROM {name}_flags)),
{name} AS (SELECT {key}, pos, negated, dir_only, {glob_pattern('l4', "contains(l3, '/')")} AS pattern
  FROM (SELECT *, CASE WHEN l3[1] = '/' THEN l3[2:] ELSE l3 END AS l4 FROM {name}_dirs) WHERE l4 <> '')"""


def with_(*ctes: str, select: str) -> str:
    return f"WITH {', '.join(ctes)} {select}"


# --- settings ----------------------------------------------------------------------

_NUMERIC = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"
EXTENSIONS_DEFAULT = "['ts','tsx','vue','js','jsx','json','css','scss','sql','cs','md']"
IGNORE_DEFAULT = "['node_modules','dist','build','out','coverage','.git']"
_FIELDS = (
    ("includeExtensions", "include_extensions", "strings", EXTENSIONS_DEFAULT, ""),
    ("ignorePatterns", "ignore_patterns", "strings", IGNORE_DEFAULT, ""),
    ("respectGitignore", "respect_gitignore", "boolean", "true", ""),
    ("maxFileSizeKb", "max_file_size_kb", "number", "200", ""),
    ("tokenWarningThreshold", "token_warning_threshold", "number", "100000", ""),
    ("includeProjectOverview", "include_overview", "boolean", "true", ""),
    ("secretGuard.enabled", "guard_enabled", "boolean", "true", ""),
    ("secretGuard.mode", "guard_mode", "choice", "redact", "redact | skipFile"),
    ("secretGuard.extraPatterns", "extra_patterns", "strings", "[]", ""),
    ("previewBeforeCopy", "review_policy", "choice", "onWarning", "always | onWarning | never"),
    ("scrubAbsolutePaths", "scrub_paths", "boolean", "true", ""),
    ("outputLanguage", "output_language", "choice", "th", "th | en"),
)


def resolved(source: str, key: str, name: str = "resolved") -> str:
    columns, problems = [], []
    for json_key, column, kind, default, allowed in _FIELDS:
        x = f"""json_extract(CAST(settings_json AS JSON), '$."{json_key}"')"""
        found = f"CAST({x} AS VARCHAR)"
        shown = default.replace("'", '"')
        if kind == "strings":
            strings = f"list_filter(CAST({x} AS JSON[]), lambda e: json_type(e) = 'VARCHAR')"
            value = f"list_filter(list_transform({strings}, lambda e: trim(json_extract_string(e, '$'))), lambda t: t <> '')"
            fallback, ok, expected = f"CAST({default} AS VARCHAR[])", f"json_type({x}) = 'ARRAY'", "an array of strings"
            lost = f"(len(CAST({x} AS JSON[])) - len({strings}))"
            extra = f"WHEN {ok} AND {lost} > 0 THEN {q(json_key + ': ignored ')} || {lost} || ' non-string entr(ies)'"
        elif kind == "boolean":
            value, fallback, ok, expected, extra = f"CAST({x} AS BOOLEAN)", default, f"json_type({x}) = 'BOOLEAN'", "a boolean", ""
        elif kind == "number":
            value, fallback = f"CAST({x} AS DOUBLE)", f"CAST({default} AS DOUBLE)"
            ok, expected, extra = f"(json_type({x}) IN {_NUMERIC} AND CAST({x} AS DOUBLE) >= 0)", "a number >= 0", ""
        else:
            options = ", ".join(q(o) for o in allowed.split(" | "))
            value, fallback = f"json_extract_string({x}, '$')", q(default)
            ok = f"(json_type({x}) = 'VARCHAR' AND json_extract_string({x}, '$') IN ({options}))"
            expected, extra, shown = f"one of {allowed}", "", f'"{default}"'
        columns.append(f"CASE WHEN {x} IS NOT NULL AND {ok} THEN {value} ELSE {fallback} END AS {column}")
        problems.append(
            f"CASE WHEN {x} IS NOT NULL AND NOT {ok} THEN {q(f'{json_key}: expected {expected} but found ')} || {found} || "
            f"{q(f'; using {shown}')} {extra} END"
        )
    return f"""{name} AS (SELECT {key}, {', '.join(columns)},
  list_filter([{', '.join(problems)}], lambda p: p IS NOT NULL) AS problems FROM {source})"""


# --- ignore decisions --------------------------------------------------------------

IGNORED_BY_FILE = f"""
prefixes AS (SELECT workspace, ordinal, unnest(range(1, len(parts) + 1)) AS depth, len(parts) AS n, parts
  FROM (SELECT workspace, ordinal, string_split({normalised('path')}, '/') AS parts FROM files)),
decided AS (SELECT p.workspace, p.ordinal, p.depth, arg_max(NOT r.negated, r.pos) AS ignored
  FROM prefixes p JOIN rules r ON r.workspace = p.workspace AND (p.depth < p.n OR NOT r.dir_only)
    AND regexp_matches(array_to_string(p.parts[1:p.depth], '/'), r.pattern)
  GROUP BY ALL),
by_file AS (SELECT workspace, ordinal, bool_or(ignored) AS ignored FROM decided GROUP BY ALL)"""

_RULES = parsed_rules("rules", "workspaces", "workspace")

JUDGED = f"""{resolved('workspaces', 'workspace', 'settings')},
globs AS (SELECT workspace, {segment_pattern('g')} AS pattern
  FROM (SELECT workspace, unnest(ignore_patterns) AS g FROM settings)),
by_glob AS (SELECT DISTINCT f.workspace, f.ordinal
  FROM (SELECT workspace, ordinal, unnest({segments('path')}) AS s FROM files) f
  JOIN globs g ON g.workspace = f.workspace AND regexp_matches(f.s, g.pattern)),
reasoned AS (SELECT f.*, s.* EXCLUDE (workspace, problems), w.workspace_root, w.home_dir,
  CASE WHEN g.ordinal IS NOT NULL OR (s.respect_gitignore AND b.ignored) THEN 'ignored'
    WHEN len(s.include_extensions) > 0 AND NOT list_contains(
      list_transform(s.include_extensions, lambda e: lower(regexp_replace(e, '^\\.', ''))), {extension('f.path')})
      THEN 'extension-filter'
    WHEN s.max_file_size_kb > 0 AND f.size_bytes > s.max_file_size_kb * 1024 THEN 'too-large'
    WHEN {binary('f.content')} THEN 'binary' END AS early
  FROM files f JOIN settings s USING (workspace) JOIN workspaces w USING (workspace)
  LEFT JOIN by_file b USING (workspace, ordinal) LEFT JOIN by_glob g USING (workspace, ordinal))"""


def root_pattern(root: str) -> str:
    trimmed = rf"regexp_replace({root}, '[/\\]+$', '')"
    escaped = rf"regexp_replace(replace({trimmed}, chr(92), '/'), '([.*+?^${{}}()|\[\]])', '\\\1', 'g')"
    return rf"CASE WHEN length({trimmed}) >= 4 THEN regexp_replace({escaped}, '/+', '[/\\\\]+', 'g') END"


def scrubbed(text: str, workspace_root: str, home: str) -> str:
    first = f"coalesce(regexp_replace({text}, {root_pattern(workspace_root)}, '.', 'gi'), {text})"
    return f"coalesce(regexp_replace({first}, {root_pattern(home)}, '~', 'gi'), {first})"


def mask_chain(name: str, source: str, keys: str, text: str, extra: tuple[tuple[str, str, str], ...] = ()) -> str:
    """CTEs that apply every rule in turn; the last one is ``name(keys, text, hits)``."""
    steps = [f"{name}_0 AS (SELECT {keys}, replace({text}, '<REDACTED:', {q(MARK)}) AS text, CAST([] AS STRUCT(line BIGINT, seq INT, rule VARCHAR)[]) AS hits FROM {source})"]
    rules = []
    for rule, boundary, body, kept_before, kept_after in MASKS:
        shift = 1 if boundary else 0
        pattern = (f"(^|[^{boundary}])" if boundary else "") + body
        before = ("\\1" if shift else "") + "".join(f"\\{n + shift}" for n in kept_before)
        after = "".join(f"\\{n + shift}" for n in kept_after)
        rules.append((pattern, f"{before}{MARK}{rule}>{after}", rule))
    for k, (pattern, replacement, rule_name) in enumerate((*rules, *extra)):
        found = f"""flatten(list_transform(range(1, len(string_split(text, {NL})) + 1), lambda i:
          list_transform(regexp_extract_all(string_split(text, {NL})[i], {q(pattern)}),
            lambda h: {{'line': i, 'seq': {k}, 'rule': {q(rule_name)}}})))"""
        steps.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT {keys}, regexp_replace(text, {q(pattern)}, {q(replacement)}, 'g') AS text, "
            f"CASE WHEN regexp_matches(text, {q(pattern)}) THEN list_concat(hits, {found}) ELSE hits END AS hits FROM {name}_{k})"
        )
    last = len(rules) + len(extra)
    steps.append(f"{name} AS (SELECT {keys}, replace(text, {q(MARK)}, '<REDACTED:') AS text, list_sort(hits) AS hits FROM {name}_{last})")
    return ", ".join(steps)


def distinct_rules(hits: str) -> str:
    """First-seen order by counting back over the log."""
    names = f"list_transform({hits}, lambda h: h.rule)"
    return f"array_to_string(list_filter({names}, lambda r, i: list_position({names}, r) = i), ', ')"


GUARDED = f"""
open_files AS (SELECT workspace, ordinal, CASE WHEN scrub_paths THEN {scrubbed('content', 'workspace_root', 'home_dir')} ELSE content END AS text
  FROM reasoned WHERE early IS NULL AND {denied('path')} IS NULL),
scanned AS (SELECT o.* FROM open_files o JOIN settings s USING (workspace) WHERE s.guard_enabled),
{mask_chain('masked', 'scanned', 'workspace, ordinal', 'text')},
guarded AS (SELECT r.workspace, r.ordinal, r.path, r.size_bytes, r.output_language,
  coalesce(m.text, o.text) AS content, coalesce(m.hits, []) AS hits,
  CASE WHEN r.early IS NOT NULL THEN r.early WHEN {denied('r.path')} IS NOT NULL THEN 'deny-list'
    WHEN r.guard_enabled AND r.guard_mode = 'skipFile' AND len(m.hits) > 0 THEN 'secret-content' END AS reason,
  CASE WHEN r.early = 'too-large' THEN {size_label('r.size_bytes')} WHEN r.early IS NOT NULL THEN NULL
    WHEN {denied('r.path')} IS NOT NULL THEN {denied('r.path')}
    WHEN r.guard_enabled AND r.guard_mode = 'skipFile' AND len(m.hits) > 0 THEN {distinct_rules('m.hits')} END AS detail,
  CASE WHEN r.early = 'too-large' THEN 0 WHEN r.early IS NOT NULL THEN 1 ELSE 2 END AS stage
  FROM reasoned r LEFT JOIN open_files o USING (workspace, ordinal) LEFT JOIN masked m USING (workspace, ordinal))"""

FULL = (CTE["files"], CTE["workspaces"], _RULES, IGNORED_BY_FILE, JUDGED, GUARDED)


# --- rendering ---------------------------------------------------------------------


def label(name: str, language: str = "output_language") -> str:
    return f"CASE WHEN {language} = 'th' THEN {q(LABELS['th'][name])} ELSE {q(LABELS['en'][name])} END"


def section(path: str, content: str) -> str:
    fence = f"repeat('`', {fence_length(content)})"
    return rf"""'## ' || {posix(path)} || {NL} || {NL} || {fence} || {language_tag(path)} || {NL} ||
      regexp_replace({content}, '\n$', '') || {NL} || {fence}"""


def document_ctes(files: str, workspaces: str) -> str:
    """CTEs up to ``docs(workspace, …, draft)``: whole documents, built as one text each
    with the token figure left out, from ``files(workspace, ordinal, path, content, hits,
    reason, detail, stage)`` and ``workspaces(workspace, task, output_language,
    include_overview)``."""
    lines = f"len(list_distinct(list_transform(hits, lambda h: h.line)))"
    return rf"""
texts AS (SELECT workspace,
  count(*) FILTER (reason IS NULL) AS file_count, count(*) FILTER (reason IS NOT NULL) AS skipped_count,
  coalesce(sum(len(hits)) FILTER (reason IS NULL), 0) AS redaction_count,
  count(*) FILTER (reason IS NULL AND len(hits) > 0) AS masked_files,
  coalesce(sum({lines}) FILTER (reason IS NULL), 0) AS masked_lines,
  coalesce(sum({tokens('content')}) FILTER (reason IS NULL), 0) AS file_tokens,
  string_agg('- `' || {posix('path')} || '`', {NL} ORDER BY ordinal, path) FILTER (reason IS NULL) AS list_text,
  string_agg(section, {NL} || {NL} ORDER BY ordinal, path) FILTER (reason IS NULL) AS section_text,
  string_agg('- `' || {posix('path')} || '` — ' || len(hits) || ' (' || {distinct_rules('hits')} || ')', {NL} ORDER BY ordinal, path)
    FILTER (reason IS NULL AND len(hits) > 0) AS masked_text,
  string_agg('- `' || {posix('path')} || '` — ' || reason || coalesce(': ' || detail, ''), {NL} ORDER BY stage, ordinal, path)
    FILTER (reason IS NOT NULL) AS skipped_text
  FROM (SELECT *, {section('path', 'content')} AS section FROM {files}) GROUP BY workspace),
docs AS (SELECT t.*, w.* EXCLUDE (workspace),
  regexp_replace(coalesce(w.task, ''), '^{BLANKS}+|{BLANKS}+$', '', 'g') AS clean_task FROM texts t JOIN {workspaces} w USING (workspace)),
reports AS (SELECT *, CASE WHEN masked_files = 0 AND skipped_count = 0 THEN '' ELSE
    '---' || {NL} || {NL} || '# ' || {label('guard_report')} || {NL} || {NL} ||
    CASE WHEN masked_files > 0 THEN replace(replace({label('redacted')}, '{{lines}}', CAST(masked_lines AS VARCHAR)),
      '{{files}}', CAST(masked_files AS VARCHAR)) || {NL} || {NL} || masked_text || {NL} || {NL} ELSE '' END ||
    CASE WHEN skipped_count > 0 THEN '**' || {label('skipped')} || '**' || {NL} || {NL} || skipped_text || {NL} || {NL} ELSE '' END
  END AS report FROM docs),
drafts AS (SELECT *, regexp_replace({collapsed(rf'''
    CASE WHEN clean_task <> '' THEN '# ' || {label('task')} || {NL} || {NL} || clean_task || {NL} || {NL} ELSE '' END ||
    CASE WHEN include_overview THEN '# ' || {label('overview')} || {NL} || {NL} || '- ' || {label('workspace')} || ': ' || workspace ||
      {NL} || '- ' || {label('file_count')} || ': ' || file_count || {NL} || '- ' || {label('tokens')} || ': @@TOKENS@@' || {NL} || {NL}
      ELSE '' END ||
    '# ' || {label('file_list')} || {NL} || {NL} ||
    CASE WHEN file_count = 0 THEN {label('no_files')} || {NL} || {NL}
      ELSE list_text || {NL} || {NL} || '---' || {NL} || {NL} || section_text || {NL} || {NL} END || report''')},
    '{BLANKS}+$', '') || {NL} AS draft FROM reports),
measured AS (SELECT *, {tokens("replace(draft, '@@TOKENS@@', '')")} AS total_tokens FROM drafts),
packs AS (SELECT *, replace(draft, '@@TOKENS@@', {grouped('total_tokens')}) AS markdown FROM measured)"""


WORKSPACE_PACKS = (
    *FULL,
    "pack_workspaces AS (SELECT w.workspace, w.task, s.output_language, s.include_overview, s.token_warning_threshold, "
    "s.review_policy FROM workspaces w JOIN settings s USING (workspace))",
    document_ctes("guarded", "pack_workspaces"),
    f"""reviewed AS (SELECT *, list_filter([
    CASE WHEN token_warning_threshold > 0 AND total_tokens > token_warning_threshold THEN 'about ' || {grouped('total_tokens')} ||
      ' tokens, over your ' || {grouped('token_warning_threshold')} || ' warning threshold' END,
    CASE WHEN redaction_count > 0 THEN CAST(redaction_count AS BIGINT) || ' value(s) were masked' END,
    CASE WHEN skipped_count > 0 THEN skipped_count || ' file(s) were left out' END], lambda r: r IS NOT NULL) AS reasons
  FROM packs WHERE file_count > 0),
decided_packs AS (SELECT *, review_policy <> 'never' AND (review_policy = 'always' OR len(reasons) > 0) AS review_required FROM reviewed)""",
)
