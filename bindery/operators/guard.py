"""The secret guard: a deny list by file name, and masking of credentials in text.

The expected results fix the contract (what is denied, the mask text, that the key
name survives and the line count does not change, ``dotenv`` and ``assigned-secret``
as rule names). The patterns, the other names and the order of the rules are our own
definitions, from the vendors' public key formats:

- Rules run in order, each on the output of the one before, so a value is logged once,
  by the rule that masked it. No rule takes a mask for the start of a value.
- No rule crosses a line break, which keeps line numbers true. Lines are 1-based and
  end at ``\\n``.
- A log lists its entries by line, then by rule order.
- ``secret-content`` carries the distinct rule names as its detail.
- ``assigned-secret`` masks quoted values after ``:`` or ``=``, of any length and with any
  number of escapes, and unquoted ones in lines that start with ``KEY=value`` or
  ``KEY = value`` as environment and ini files hold them. Unquoted values after ``:`` stay:
  they are mostly type names (``token: string``).
- A password in a URL reaches to the last ``@`` before a blank or quote. Digits that end
  at ``/``, ``?`` or ``#`` are a port.

Groups stand for the kept text around the masked part. Character classes are spelled
out instead of ``\\b`` and ``\\s``, whose meaning differs between regex engines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindery.functions.bind import bind, let, quoted
from bindery.functions.paths import base_name
from bindery.operators.filters import STAGE_GUARD

DENY_LIST = "deny-list"
SECRET_CONTENT = "secret-content"
REDACTIONS_TYPE = "array<struct<line:int,rule:string>>"
_HITS_TYPE = "array<struct<line:int,seq:int,rule:string>>"

# The file names the guard never lets through, each under its rule name.
DENIED_NAMES = (
    ("dotenv", r"\.env|\.env\..*"),
    ("pem", r".*\.pem"),
    ("key", r".*\.key"),
    ("p12", r".*\.p12"),
    ("pfx", r".*\.pfx"),
    ("secrets", r"secrets.*"),
    ("credentials", r"credentials.*"),
    ("id-rsa", r"id_rsa"),
)


@dataclass(frozen=True)
class MaskRule:
    """A content rule.

    ``hints`` are literals of which a matching text must hold at least one; plain
    searches for them keep the regular expression away from nearly all files. With
    ``folded`` they are searched in the lower-cased text. ``boundary`` is a character
    class that must not stand right before the match. ``before`` and ``after`` name
    the groups kept around the mask.
    """

    name: str
    hints: tuple[str, ...]
    body: str
    boundary: str = ""
    folded: bool = False
    before: tuple[int, ...] = ()
    after: tuple[int, ...] = ()

    @property
    def pattern(self) -> str:
        return f"(?<![{self.boundary}]){self.body}" if self.boundary else self.body

    @property
    def replacement(self) -> str:
        kept = ["".join(f"${n}" for n in groups) for groups in (self.before, self.after)]
        return f"{kept[0]}<REDACTED:{self.name}>{kept[1]}"

    def hinted(self, text: str, folded_text: str) -> str:
        """SQL condition: the text holds a hint."""
        searched = folded_text if self.folded else text
        return "(" + " OR ".join(f"contains({searched}, {quoted(hint)})" for hint in self.hints) + ")"


_WORD = "A-Za-z0-9_"
_SECRET_HINTS = ("key", "secret", "passw", "token")
_SECRET_KEY = r"(?i:(?:api|access|secret)[_-]?key|secret|passw(?:or)?d|token)"


_NO_MASK = "(?!<REDACTED:)"


def _quoted(quote: str) -> str:
    """A quoted value. Possessive, so that neither length nor escapes cost stack."""
    return rf"({quote}){_NO_MASK}(?:[^{quote}\\\n]++|\\[^\n])++({quote})"


# Rule names, order and shapes of credentials.
MASK_RULES = (
    MaskRule("aws-access-key", ("AKIA", "ASIA"), r"(?:AKIA|ASIA)[0-9A-Z]{16,}", _WORD),
    MaskRule("openai-key", ("sk-",), r"sk-[A-Za-z0-9_-]{20,}", _WORD),
    MaskRule(
        "github-token",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
        r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})",
        _WORD,
    ),
    MaskRule("google-api-key", ("AIza",), r"AIza[0-9A-Za-z_-]{35,}", _WORD),
    MaskRule("slack-token", ("xox",), r"xox[abeposr]-[A-Za-z0-9-]{10,}", _WORD),
    MaskRule("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _WORD),
    MaskRule(
        "connection-string",
        ("://",),
        rf"""(://[^\x00-\x20:/@"'<>]*:){_NO_MASK}(?![0-9]{{1,5}}[/?#])[^\x00-\x20"'`]+(@)""",
        before=(1,),
        after=(2,),
    ),
    MaskRule(
        "auth-header",
        ("authorization",),
        rf"""((?i:authorization)["']?[ \t]*[:=][ \t]*["'`]?(?i:bearer|basic)[ \t]+){_NO_MASK}[^\x00-\x20"'`,;]+""",
        folded=True,
        before=(1,),
    ),
    MaskRule(
        "auth-header",
        ("bearer", "basic"),
        r"((?i:bearer|basic)[ \t]+)[A-Za-z0-9._~+/-]{20,}={0,2}",
        _WORD,
        folded=True,
        before=(1,),
    ),
    MaskRule(
        "assigned-secret",
        _SECRET_HINTS,
        rf"""({_SECRET_KEY}["'`]?[ \t]*(?::=|=>|[:=])[ \t]*)(?:{_quoted('"')}|{_quoted("'")}|{_quoted("`")})""",
        folded=True,
        before=(1, 2, 4, 6),
        after=(3, 5, 7),
    ),
    MaskRule(
        "assigned-secret",
        _SECRET_HINTS,
        rf"""((?:^|\n)[ \t]*(?:export[ \t]+)?[A-Za-z0-9_.-]*{_SECRET_KEY}[ \t]*=[ \t]*)(?![=>~]){_NO_MASK}[^\x00-\x20"'`]+""",
        folded=True,
        before=(1,),
    ),
)


def denied_name(path: Column) -> Column:
    """Name of the deny rule that holds the file back, NULL for none. Case-insensitive."""
    name = base_name(path)
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for rule, pattern in DENIED_NAMES:
        verdict = verdict.when(name.rlike(rf"(?is)\A(?:{pattern})\z"), F.lit(rule))
    return verdict


def may_hold_secret(text: str) -> Column:
    """Whether any content rule finds something in a text column. Exact; on clean text
    nearly always settled by plain searches, on one lower-cased copy."""
    return F.expr(_may_hold_sql(text))


def _may_hold_sql(text: str) -> str:
    by_hints: dict[str, list[str]] = {}
    for rule in MASK_RULES:
        by_hints.setdefault(rule.hinted(text, "folded"), []).append(f"{text} RLIKE {quoted(rule.pattern)}")
    any_rule = " OR ".join(f"({hinted} AND ({' OR '.join(found)}))" for hinted, found in by_hints.items())
    return let("folded", f"lower({text})", any_rule)


def _rule_step(now: str, seq: int, rule: MaskRule) -> str:
    """SQL for one rule applied to ``now``, a struct of the text and the hits so far."""
    pattern = quoted(rule.pattern)
    hit = f"named_struct('line', at + 1, 'seq', {seq}, 'rule', {quoted(rule.name)})"
    hits = f"""flatten(transform(
        split(now.text, '\\n', -1), (line, at) -> array_repeat({hit}, regexp_count(line, {pattern}))))"""
    changed = f"""named_struct(
        'text', regexp_replace(now.text, {pattern}, {quoted(rule.replacement)}), 'hits', concat(now.hits, {hits}))"""
    found = f"{rule.hinted('now.text', 'lower(now.text)')} AND now.text RLIKE {pattern}"
    return let("now", now, f"if({found}, {changed}, now)")


def mask_text(text: str, enabled: Column) -> Column:
    """Struct ``(text, hits)``: a text column after all content rules, and where they hit.

    The rules form one nested expression, each step bound to the result of the one
    before. A chain of columns would not do: a filter on the outcome is pushed through
    it and copies the whole chain twice per rule.
    """

    def untouched(source: str) -> str:
        return f"named_struct('text', {source}, 'hits', cast(array() AS {_HITS_TYPE}))"

    masked = untouched("source")
    for seq, rule in enumerate(MASK_RULES):
        masked = _rule_step(masked, seq, rule)
    scanned = let("source", text, f"if({_may_hold_sql('source')}, {masked}, {untouched('source')})")
    return F.when(enabled, F.expr(scanned)).otherwise(F.expr(untouched(text)))


_MASK = re.compile(r"<REDACTED:[^>\n]*>")


def compile_pattern(source: str) -> re.Pattern[str] | None:
    """A user pattern, or None if it is no regular expression."""
    try:
        return re.compile(source)
    except (re.error, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def pattern_problems(patterns: pd.Series) -> pd.Series:
    """One message per user pattern that cannot be used, for the few rows of settings."""

    def problems(sources) -> list[str]:
        bad = [source for source in (() if sources is None else sources) if compile_pattern(source) is None]
        return [f"secretGuard.extraPatterns: {source} is no regular expression; ignored" for source in bad]

    return patterns.map(problems)


_MASKED_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "hits",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("line", T.IntegerType()),
                        T.StructField("seq", T.IntegerType()),
                        T.StructField("rule", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


@F.pandas_udf(_MASKED_SCHEMA)
def _mask_extra(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Masks user patterns with group positions, which SQL functions do not report.

    Rows with nothing to do arrive as NULL text and leave as NULL.
    """
    compiled: dict[str, re.Pattern[str] | None] = {}

    def mask(text: str, patterns, first_seq: int):
        hits = []
        lines = text.split("\n")
        for number, source in enumerate(patterns, start=1):
            if source not in compiled:
                compiled[source] = compile_pattern(source)
            pattern, rule = compiled[source], f"custom-{number}"
            if pattern is None:
                continue
            group = 1 if pattern.groups else 0
            for at, line in enumerate(lines):
                done, out = 0, []
                masks = [m.span() for m in _MASK.finditer(line)]
                for match in pattern.finditer(line):
                    # A group that took no part in the match leaves the whole match.
                    start, end = match.span(group if match.start(group) >= 0 else 0)
                    if start == end or any(start < b and a < end for a, b in masks):
                        continue
                    out += [line[done:start], f"<REDACTED:{rule}>"]
                    done = end
                    hits.append({"line": at + 1, "seq": first_seq + number, "rule": rule})
                if out:
                    lines[at] = "".join(out) + line[done:]
        return "\n".join(lines), hits

    for texts, patterns, seqs in batches:
        rows = [
            (None, None) if text is None else mask(text, wanted, seq)
            for text, wanted, seq in zip(texts, patterns, seqs)
        ]
        yield pd.DataFrame(rows, columns=["text", "hits"])


def _with_masked(rows: DataFrame, text: str, enabled: Column, extra_patterns: Column | None) -> DataFrame:
    """Adds ``_masked``, a struct of the finished text and its log."""

    def finished(text: Column, hits: Column) -> Column:
        log = F.transform(F.sort_array(hits), lambda h: F.struct(h["line"].alias("line"), h["rule"].alias("rule")))
        return F.struct(text.alias("text"), log.cast(REDACTIONS_TYPE).alias("redactions"))

    core = mask_text(text, enabled)
    if extra_patterns is None:
        return rows.withColumn("_masked", bind(core, lambda m: finished(m["text"], m["hits"])))
    wanted = enabled & (F.size(extra_patterns) > 0)
    sent = F.when(wanted, F.col("_core.text"))
    out = rows.withColumn("_core", core).withColumn(
        "_extra", _mask_extra(sent, extra_patterns, F.lit(len(MASK_RULES)))
    )
    hits = F.concat("_core.hits", F.coalesce(F.col("_extra.hits"), F.array().cast(_HITS_TYPE)))
    masked = finished(F.coalesce("_extra.text", "_core.text"), hits)
    return out.withColumn("_masked", masked).drop("_core", "_extra")


def mask_secrets(
    rows: DataFrame,
    text: str = "content",
    *,
    scan: Column | None = None,
    extra_patterns: Column | None = None,
) -> DataFrame:
    """Masks credentials in ``text`` and adds ``redactions``, one entry per masked value.

    ``scan`` switches rows off. ``extra_patterns`` is an array of user patterns per
    row (or a literal); group 1 marks the masked part, without a group, or where it takes
    no part in the match, the whole match goes. A pattern that is none is passed over. They see one line at a time, and only the text of rows that have any is sent
    to Python.
    """
    enabled = F.lit(True) if scan is None else F.coalesce(scan, F.lit(False))
    out = _with_masked(rows, text, enabled, extra_patterns)
    kept = [F.col("_masked.text").alias(c) if c == text else F.col(f"`{c}`") for c in rows.columns]
    return out.select(*kept, F.col("_masked.redactions"))


def distinct_rules(redactions: Column) -> Column:
    """Rule names of a log, each once, in first-seen order, joined by ``, ``."""
    return F.array_join(F.array_distinct(F.transform(redactions, lambda r: r["rule"])), ", ")


def redaction_rows(guarded: DataFrame, *keys: str) -> DataFrame:
    """The audit table: one row per masked value.

    An inner explode would put a filter on the log below the masking and run it twice.
    """
    rows = guarded.select(*keys, F.explode_outer("redactions").alias("r")).filter(F.col("r").isNotNull())
    return rows.select(*keys, "r.line", "r.rule")


def guard(files: DataFrame, options: Column, *, user_patterns: bool = True) -> DataFrame:
    """Guards files that passed the filters: masks ``content``, adds ``redactions``, and
    fills ``reason``, ``detail`` and ``stage`` for those it holds back.

    Rows that already carry a reason keep it. Only rows without one leave with content.
    The deny list runs whatever the options say. ``user_patterns=False`` states that no
    row has extra patterns, which keeps the whole run out of Python.

    A filter on the result is pushed below and repeats the masking; ``session.store``
    the result first where both sides of such a split are needed.
    """
    judged = files.withColumn("_options", options)
    denied = denied_name(F.col("path"))
    live = F.col("reason").isNull() & denied.isNull()
    patterns = F.col("_options.extra_patterns") if user_patterns else None
    masked = _with_masked(judged, "content", live & F.col("_options.content_scanning"), patterns)

    def verdict(row: Column) -> Column:
        log = row["masked"]["redactions"]
        dropped = (row["mode"] == "skipFile") & (F.size(log) > 0)
        open_, name = row["reason"].isNull(), row["denied"]
        reason = (
            F.when(~open_, row["reason"])
            .when(name.isNotNull(), F.lit(DENY_LIST))
            .when(dropped, F.lit(SECRET_CONTENT))
        )
        detail = F.when(~open_, row["detail"]).when(name.isNotNull(), name).when(dropped, distinct_rules(log))
        stage = F.when(~open_, row["stage"]).when(name.isNotNull() | dropped, F.lit(STAGE_GUARD))
        kept = open_ & name.isNull() & ~dropped
        return F.struct(
            reason.alias("reason"),
            detail.alias("detail"),
            stage.alias("stage"),
            F.when(kept, row["masked"]["text"]).alias("content"),
            F.when(kept, log).alias("redactions"),
        )

    row = F.struct(
        "reason", "detail", "stage", denied.alias("denied"), F.col("_options.mode"), F.col("_masked").alias("masked")
    )
    filled = ("reason", "detail", "stage", "content")
    others = [F.col(f"`{c}`") for c in files.columns if c not in filled]
    return masked.withColumn("_guarded", bind(row, verdict)).select(
        *others, *[F.col(f"_guarded.{c}") for c in (*filled, "redactions")]
    )
