"""Per-workspace settings: untyped JSON in, a typed struct and its problems out."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.bind import bind, let, quoted
from bindery.functions.text import OUTER_BLANKS
from bindery.operators.filters import wanted_extensions
from bindery.operators.ignore import RULES_TYPE, has_negation, rules_regex, segment_regex

# The defaults and the closed value lists.
DEFAULT_EXTENSIONS = ["ts", "tsx", "vue", "js", "jsx", "json", "css", "scss", "sql", "cs", "md"]
DEFAULT_IGNORE_PATTERNS = ["node_modules", "dist", "build", "out", "coverage", ".git"]
GUARD_MODES = ["redact", "skipFile"]
REVIEW_POLICIES = ["always", "onWarning", "never"]
OUTPUT_LANGUAGES = ["th", "en"]


@dataclass(frozen=True)
class Setting:
    """One setting: its JSON key, its column, what it may hold and its default."""

    key: str
    column: str
    kind: str
    default: object
    allowed: tuple[str, ...] = ()


# Order is the order problems are reported in.
SETTINGS = (
    Setting("includeExtensions", "include_extensions", "strings", DEFAULT_EXTENSIONS),
    Setting("ignorePatterns", "ignore_patterns", "strings", DEFAULT_IGNORE_PATTERNS),
    Setting("respectGitignore", "respect_gitignore", "boolean", True),
    Setting("maxFileSizeKb", "max_file_size_kb", "number", 200),
    Setting("tokenWarningThreshold", "token_warning_threshold", "number", 100000),
    Setting("includeProjectOverview", "include_overview", "boolean", True),
    Setting("secretGuard.enabled", "guard_enabled", "boolean", True),
    Setting("secretGuard.mode", "guard_mode", "choice", "redact", tuple(GUARD_MODES)),
    Setting("secretGuard.extraPatterns", "extra_patterns", "strings", []),
    Setting("previewBeforeCopy", "review_policy", "choice", "onWarning", tuple(REVIEW_POLICIES)),
    Setting("scrubAbsolutePaths", "scrub_paths", "boolean", True),
    Setting("outputLanguage", "output_language", "choice", "th", tuple(OUTPUT_LANGUAGES)),
)

_TYPES = {"strings": "array<string>", "boolean": "boolean", "number": "double", "choice": "string"}
SETTINGS_TYPE = "struct<" + ",".join(f"{s.column}:{_TYPES[s.kind]}" for s in SETTINGS) + ">"
UNREADABLE = "settings: expected a JSON object with distinct keys; using the defaults"
_EXPECTED = {"strings": "an array of strings", "boolean": "a boolean", "number": "a number >= 0"}


def _default(setting: Setting) -> Column:
    if setting.kind == "strings":
        return F.array(*[F.lit(v) for v in setting.default]).cast("array<string>")
    return F.lit(setting.default).cast(_TYPES[setting.kind])


def _json_path(key: str) -> str:
    return f'$["{key}"]'


_NUMERIC = quoted(r"\A(?:BIGINT|DECIMAL|DOUBLE|FLOAT)")
_ENTRIES = "try_variant_get(found, '$', 'array<variant>')"

# The JSON text of a rejected value: whole numbers print without a fraction, a number
# too large for a double prints as null.
_FIGURE = """CASE WHEN abs(number) = double('Infinity') THEN 'null'
    WHEN number = floor(number) AND abs(number) < 1e15 THEN cast(cast(number AS decimal(20, 0)) AS string)
    ELSE to_json(found) END"""
_FOUND = f"""CASE WHEN kind RLIKE {_NUMERIC} THEN {let("number", "try_variant_get(found, '$', 'double')", _FIGURE)}
    ELSE to_json(found) END"""


def _typed(setting: Setting) -> tuple[str, str]:
    """SQL for the value in its type and for whether it is acceptable. ``found`` is the
    JSON value, ``kind`` the name of its type."""
    if setting.kind == "strings":
        texts = f"""transform(filter({_ENTRIES}, e -> schema_of_variant(e) = 'STRING'),
            e -> regexp_replace(try_variant_get(e, '$', 'string'), {quoted(OUTER_BLANKS)}, ''))"""
        return f"filter({texts}, t -> t != '')", "startswith(kind, 'ARRAY')"
    typed = f"try_variant_get(found, '$', '{_TYPES[setting.kind]}')"
    if setting.kind == "boolean":
        return typed, "kind = 'BOOLEAN'"
    if setting.kind == "number":
        return typed, f"kind RLIKE {_NUMERIC} AND {typed} >= 0 AND {typed} != double('Infinity')"
    allowed = ", ".join(quoted(v) for v in setting.allowed)
    return typed, f"kind = 'STRING' AND {typed} IN ({allowed})"


def _default_sql(setting: Setting) -> str:
    if setting.kind == "strings":
        return f"cast(array({', '.join(quoted(v) for v in setting.default)}) AS array<string>)"
    if setting.kind == "choice":
        return quoted(setting.default)
    return f"cast({str(setting.default).lower()} AS {_TYPES[setting.kind]})"


def _read(setting: Setting) -> str:
    """SQL struct ``(value, problem)`` of one setting of ``raw``; an unset key gives its
    default and no problem."""
    typed, acceptable = _typed(setting)
    expected = _EXPECTED.get(setting.kind) or "one of " + " | ".join(setting.allowed)
    opening = quoted(f"{setting.key}: expected {expected} but found ")
    ending = quoted(f"; using {json.dumps(setting.default, separators=(',', ':'))}")
    partial = ""
    if setting.kind == "strings":
        dropped = f"size(filter({_ENTRIES}, e -> coalesce(schema_of_variant(e) != 'STRING', true)))"
        counted = f"concat({quoted(setting.key + ': ignored ')}, {dropped}, ' non-string entr(ies)')"
        partial = f"WHEN valid AND {dropped} > 0 THEN {counted}"
    judged = f"""named_struct(
        'value', if(valid, {typed}, {_default_sql(setting)}),
        'problem', CASE WHEN found IS NOT NULL AND NOT valid THEN concat({opening}, {_FOUND}, {ending}) {partial} END)"""
    valid = let("valid", f"coalesce({acceptable}, false)", judged)
    kind = let("kind", "schema_of_variant(found)", valid)
    return let("found", f"try_variant_get(raw, {quoted(_json_path(setting.key))}, 'variant')", kind)


def resolve_settings(settings_json: str) -> Column:
    """Struct ``(settings, problems)`` for a column of JSON objects.

    Missing and blank text means no settings. Any other text that is no object with
    distinct keys gives the defaults and says so among the problems.
    """
    read = ", ".join(f"'{s.column}', {_read(s)}" for s in SETTINGS)
    values = ", ".join(f"'{s.column}', read.{s.column}.value" for s in SETTINGS)
    problems = ", ".join(f"read.{s.column}.problem" for s in SETTINGS)
    given = f"regexp_replace({settings_json}, {quoted(OUTER_BLANKS)}, '') != ''"
    unreadable = f"if({given} AND coalesce(NOT startswith(schema_of_variant(raw), 'OBJECT'), true), {quoted(UNREADABLE)}, NULL)"
    arranged = f"""named_struct(
        'settings', cast(named_struct({values}) AS {SETTINGS_TYPE}),
        'problems', array_compact(array({unreadable}, {problems})))"""
    resolved = let("read", f"named_struct({read})", arranged)
    return F.expr(let("raw", f"try_parse_json({settings_json})", resolved))


def literal_settings(**overrides: object) -> Column:
    """The default settings as a constant struct, with some values replaced."""
    unknown = set(overrides) - {s.column for s in SETTINGS}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    values = []
    for s in SETTINGS:
        value = overrides.get(s.column, s.default)
        values.append(_default(Setting(s.key, s.column, s.kind, value)).alias(s.column))
    return F.struct(*values)


def problem_report(problems: Column) -> Column:
    """One message for all rejected settings, NULL when there is none."""
    count = F.size(problems)
    return F.when(count == 1, F.element_at(problems, 1)).when(
        count > 1,
        F.concat(
            count.cast("string"), F.lit(" settings were ignored: "), F.array_join(problems, "; ")
        ),
    )


def compiled_rules(settings: Column, ignore_rules: Column | None = None) -> Column:
    """The filter rules of a workspace in the form rows are tested with."""
    none = F.array().cast(RULES_TYPE)
    given = none if ignore_rules is None else F.coalesce(ignore_rules, none)
    applied = F.when(settings["respect_gitignore"], given).otherwise(none)
    return bind(
        applied,
        lambda rules: F.struct(
            wanted_extensions(settings["include_extensions"]).alias("extensions"),
            segment_regex(settings["ignore_patterns"]).alias("ignore_regex"),
            settings["max_file_size_kb"].alias("max_file_size_kb"),
            rules.alias("rules"),
            rules_regex(rules).alias("rules_regex"),
            has_negation(rules).alias("rules_negated"),
        ),
    )


def guard_options(settings: Column) -> Column:
    """Guard switches. Turning the guard off stops content scanning only; the deny
    list has no switch."""
    on = settings["guard_enabled"]
    return F.struct(
        F.when(on, settings["guard_mode"]).otherwise(F.lit("redact")).alias("mode"),
        F.when(on, settings["extra_patterns"]).otherwise(F.array().cast("array<string>")).alias("extra_patterns"),
        on.alias("content_scanning"),
    )
