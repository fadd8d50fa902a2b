import json

import pytest
from pyspark.sql import functions as F

from bindery.operators.settings import (
    SETTINGS,
    UNREADABLE,
    guard_options,
    literal_settings,
    problem_report,
    resolve_settings,
)

DEFAULTS = {s.column: s.default for s in SETTINGS}


def resolve(spark, *raws):
    texts = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(raws)]
    df = spark.createDataFrame(texts, "i int, j string").select("i", resolve_settings("j").alias("r"))
    return [(r["r"]["settings"].asDict(), r["r"]["problems"]) for r in df.orderBy("i").collect()]


def test_defaults(spark):
    assert resolve(spark, {}, None, "", " \n ") == [(DEFAULTS, [])] * 4
    assert spark.range(1).select(literal_settings().alias("s")).first()["s"].asDict() == DEFAULTS


def test_text_that_is_no_object_is_a_problem(spark):
    raws = ["not json", "[1]", "3", '{"maxFileSizeKb": 9,}', '{"maxFileSizeKb": 9, "maxFileSizeKb": 8}', "null"]
    assert resolve(spark, *raws) == [(DEFAULTS, [UNREADABLE])] * len(raws)


def test_a_value_changes_its_own_setting_only(spark):
    cases = [
        ("secretGuard.extraPatterns", ["ticket [0-9]+"], "extra_patterns", ["ticket [0-9]+"]),
        ("secretGuard.enabled", False, "guard_enabled", False),
        ("secretGuard.mode", "skipFile", "guard_mode", "skipFile"),
        ("includeExtensions", ["", "rs ", "\t", " .lua"], "include_extensions", ["rs", ".lua"]),
        ("ignorePatterns", [], "ignore_patterns", []),
        ("maxFileSizeKb", 0.5, "max_file_size_kb", 0.5),
        ("tokenWarningThreshold", 0, "token_warning_threshold", 0.0),
        ("previewBeforeCopy", "never", "review_policy", "never"),
        ("respectGitignore", False, "respect_gitignore", False),
        ("outputLanguage", "en", "output_language", "en"),
    ]
    found = resolve(spark, *({key: value} for key, value, _, _ in cases))
    for (_, _, column, wanted), (settings, problems) in zip(cases, found, strict=True):
        assert problems == [] and settings == {**DEFAULTS, column: wanted}


EXTENSIONS = '["ts","tsx","vue","js","jsx","json","css","scss","sql","cs","md"]'


@pytest.mark.parametrize(
    "raw,column,problem",
    [
        ({"maxFileSizeKb": "12 MB"}, "max_file_size_kb", 'maxFileSizeKb: expected a number >= 0 but found "12 MB"; using 200'),
        ({"maxFileSizeKb": -1}, "max_file_size_kb", "maxFileSizeKb: expected a number >= 0 but found -1; using 200"),
        ({"maxFileSizeKb": -1.5}, "max_file_size_kb", "maxFileSizeKb: expected a number >= 0 but found -1.5; using 200"),
        ('{"tokenWarningThreshold": 1e999}', "token_warning_threshold",
         "tokenWarningThreshold: expected a number >= 0 but found null; using 100000"),
        ({"secretGuard.mode": "blur"}, "guard_mode",
         'secretGuard.mode: expected one of redact | skipFile but found "blur"; using "redact"'),
        ({"ignorePatterns": "target,tmp"}, "ignore_patterns",
         'ignorePatterns: expected an array of strings but found "target,tmp"; using '
         '["node_modules","dist","build","out","coverage",".git"]'),
        ({"respectGitignore": 1}, "respect_gitignore", "respectGitignore: expected a boolean but found 1; using true"),
        ({"respectGitignore": "true"}, "respect_gitignore", 'respectGitignore: expected a boolean but found "true"; using true'),
        ({"outputLanguage": None}, "output_language", 'outputLanguage: expected one of th | en but found null; using "th"'),
        ({"previewBeforeCopy": {"a": [1]}}, "review_policy",
         'previewBeforeCopy: expected one of always | onWarning | never but found {"a":[1]}; using "onWarning"'),
        ({"includeExtensions": True}, "include_extensions",
         f"includeExtensions: expected an array of strings but found true; using {EXTENSIONS}"),
        ({"secretGuard.extraPatterns": 'a"b'}, "extra_patterns",
         'secretGuard.extraPatterns: expected an array of strings but found "a\\"b"; using []'),
    ],
)
def test_bad_values_are_reported(spark, raw, column, problem):
    settings, problems = resolve(spark, raw)[0]
    assert problems == [problem]
    assert settings[column] == DEFAULTS[column]


def test_non_string_entries_are_dropped_and_counted(spark):
    settings, problems = resolve(spark, {"includeExtensions": [False, "go", {"a": 1}, "rs", 0.5]})[0]
    assert settings["include_extensions"] == ["go", "rs"]
    assert problems == ["includeExtensions: ignored 3 non-string entr(ies)"]


def test_each_problem_is_listed_in_order(spark):
    _, problems = resolve(spark, {"previewBeforeCopy": "maybe", "ignorePatterns": 7, "tokenWarningThreshold": []})[0]
    assert [p.split(":")[0] for p in problems] == ["ignorePatterns", "tokenWarningThreshold", "previewBeforeCopy"]


def test_problem_report(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],)], "p array<string>")
    assert [r[0] for r in df.select(problem_report(F.col("p"))).collect()] == [None, "a", "2 settings were ignored: a; b"]


def test_guard_options(spark):
    on = literal_settings(guard_mode="skipFile", extra_patterns=["A"])
    off = literal_settings(guard_enabled=False, guard_mode="skipFile", extra_patterns=["A"])
    row = spark.range(1).select(guard_options(on).alias("on"), guard_options(off).alias("off")).first()
    assert tuple(row["on"]) == ("skipFile", ["A"], True)
    assert tuple(row["off"]) == ("redact", [], False)
