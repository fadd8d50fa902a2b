"""Ignore globs and ignore-file rules.

Both are turned into regular expressions once per workspace, on the workspace
dimension, so that a file row only ever runs finished patterns. The pattern
columns are tested with ``regexp_instr``, which keeps the compiled pattern until
the pattern text changes; ``rlike`` with a column would compile it for every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bindery.functions.bind import bind
from bindery.functions.paths import ancestors, normalise
from bindery.functions.text import ANY_BUT_LINE_END, BLANK

RULES_TYPE = "array<struct<ordinal:int,negated:boolean,dir_only:boolean,pattern:string>>"


def matches(text: Column, pattern: Column) -> Column:
    """Whether a pattern held in a column is found in the text."""
    return F.regexp_instr(text, pattern) > 0


def _any_of(patterns: Column) -> Column:
    return F.array_join(patterns, "|")


# --- ignore globs: one path segment each, any segment, case-insensitive -----------


def segment_regex(globs: Column) -> Column:
    """One regular expression over whole paths for a list of segment globs.

    NULL when no glob can match. A glob with a separator inside can never equal one
    segment, so it is left out, as is an empty one; a glob of stars alone needs at
    least one character because segments are never empty.
    """

    def body(glob: Column) -> Column:
        escaped = F.regexp_replace(glob, r"([.+^${}()|\[\]])", r"\\$1")
        one = F.replace(escaped, F.lit("?"), F.lit(r"[^/\\]"))
        return F.replace(one, F.lit("*"), F.lit(r"[^/\\]*"))

    stripped = F.transform(globs, lambda g: F.rtrim(g, F.lit("/")))
    usable = F.filter(stripped, lambda g: (g != "") & ~g.rlike(r"[/\\]"))
    whole = F.transform(usable, lambda g: F.regexp_replace(g, r"\A\*+\z", "?*"))
    return bind(
        _any_of(F.transform(whole, body)),
        lambda any_of: F.when(
            any_of != "", F.concat(F.lit(r"(?iu)(?:\A|[/\\])(?:"), any_of, F.lit(r")(?:[/\\]|\z)"))
        ),
    )


def matches_segment(path: Column, regex: Column) -> Column:
    return F.coalesce(matches(path, regex), F.lit(False))


# --- ignore file -------------------------------------------------------------------


def glob_regex(glob: Column, anchored: Column) -> Column:
    """One ignore-file glob as an anchored regular expression.

    ``**/`` crosses any number of directories, ``**`` any characters, ``*`` and ``?``
    stop at a slash; everything else is literal. Each replacement text is free of the
    characters that later steps look for.
    """
    any_text = f"{ANY_BUT_LINE_END}{{0,}}"
    escaped = F.regexp_replace(glob, r"([.+^${}()|\[\]\\])", r"\\$1")
    one = F.replace(escaped, F.lit("?"), F.lit("[^/]"))
    # A pair of stars takes the slash after it along; pairs are read left to right.
    deep = F.regexp_replace(one, r"\*\*(/?)", any_text.replace("\\", "\\\\") + "$1")
    dirs = F.replace(deep, F.lit(any_text + "/"), F.lit(f"(?:{any_text}/)?"))
    star = F.replace(dirs, F.lit("*"), F.lit("[^/]*"))
    prefix = F.when(anchored, F.lit("")).otherwise(F.lit(f"(?:{any_text}/)?"))
    return F.concat(F.lit(r"\A"), prefix, star, F.lit(r"\z"))


def parse_rules(text: Column) -> Column:
    """Ordered rules of one ignore file, as ``RULES_TYPE``; ``ordinal`` is the line."""

    def without_lead(line: Column, lead: str) -> Column:
        return F.when(line.startswith(lead), F.substr(line, F.lit(2))).otherwise(line)

    def parse(raw: Column, index: Column) -> Column:
        # Trailing whitespace goes, except one blank right behind a backslash.
        trimmed = F.regexp_replace(raw, rf"(\\{BLANK})?{BLANK}*\z", "$1")
        return bind(trimmed, lambda line: F.when((line != "") & ~line.startswith("#"), rule(line, index)))

    def rule(line: Column, index: Column) -> Column:
        unnegated = bind(without_lead(line, "!"), lambda bare: without_lead(bare, "\\"))
        return bind(unnegated, lambda bare: glob_rule(bare, line.startswith("!"), index))

    def glob_rule(bare: Column, negated: Column, index: Column) -> Column:
        dir_only = bare.endswith("/")
        glob = F.when(dir_only, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)

        def finish(path: Column) -> Column:
            pattern = glob_regex(without_lead(path, "/"), F.contains(path, F.lit("/")))
            return F.when(
                ~path.isin("", "/"),
                F.struct(
                    (index + 1).alias("ordinal"),
                    negated.alias("negated"),
                    dir_only.alias("dir_only"),
                    pattern.alias("pattern"),
                ),
            )

        return bind(glob, finish)

    return F.array_compact(F.transform(F.split(text, r"\r?\n", -1), parse)).cast(RULES_TYPE)


def rules_regex(rules: Column) -> Column:
    """A single regular expression that finds every path some ignoring rule touches,
    be it the path itself or a directory above it. NULL without such a rule."""

    def alternatives(dir_only: bool) -> Column:
        chosen = F.filter(rules, lambda r: ~r["negated"] & (r["dir_only"] == F.lit(dir_only)))
        inner = F.transform(chosen, lambda r: F.regexp_replace(r["pattern"], r"\A\\A|\\z\z", ""))
        end = "/" if dir_only else r"(?:/|\z)"
        return bind(
            _any_of(inner), lambda any_of: F.when(any_of != "", F.concat(F.lit("(?:"), any_of, F.lit(f"){end}")))
        )

    parts = F.array_compact(F.array(alternatives(True), alternatives(False)))
    return bind(
        _any_of(parts), lambda any_of: F.when(any_of != "", F.concat(F.lit(r"\A(?:"), any_of, F.lit(")")))
    )


def has_negation(rules: Column) -> Column:
    return F.exists(rules, lambda r: r["negated"])


def last_match_ignores(path: Column, is_directory: bool, rules: Column) -> Column:
    """The final rule that matches decides; no match means not ignored."""

    def step(ignored: Column, rule: Column) -> Column:
        applies = matches(path, rule["pattern"])
        if not is_directory:
            applies = ~rule["dir_only"] & applies
        return F.when(applies, ~rule["negated"]).otherwise(ignored)

    return F.aggregate(rules, F.lit(False), step)


def is_ignored(path: Column, rules: Column, regex: Column, negation: Column) -> Column:
    """Whether the rules of an ignore file exclude a path.

    An excluded ancestor wins outright. ``regex`` settles nearly every file with one
    test: where it finds nothing the path stays, and where no rule re-includes
    anything a find is the answer. Only the rest walks the ancestors rule by rule.
    """

    def verdict(clean: Column) -> Column:
        walked = F.exists(ancestors(clean), lambda d: last_match_ignores(d, True, rules)) | last_match_ignores(
            clean, False, rules
        )
        return F.when(~matches(clean, regex), F.lit(False)).when(~negation, F.lit(True)).otherwise(walked)

    return F.when(regex.isNull(), F.lit(False)).otherwise(bind(normalise(path), verdict))
