"""Path predicates: scope, tests, vendored code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts and patterns that mark test code and third-party code. Fixed values.
TEST_PARTS = ("test", "tests", "testing", "__tests__", "spec", "specs")
TEST_PATH = r"(?i)(^|/)(tests?|testing|spec|specs|fixtures?|__tests__)(/|$)|_test\.|\.test\.|_spec\."
VENDORED_PATH = r"(?i)(^|/)(deps|vendor|vendored|third_party|thirdparty|external|node_modules|assets)(/|$)|\.min\."


def scope(path: Column) -> Column:
    """legacy, tests or production: legacy wins, by whole path parts."""
    parts = F.split(F.lower(F.translate(F.coalesce(path, F.lit("")), "\\", "/")), "/")
    legacy = F.exists(parts, lambda p: p.contains("legacy") | p.contains("backup"))
    tests = F.exists(parts, lambda p: p.isin(*TEST_PARTS) | p.endswith("tests") | p.endswith("test"))
    return F.when(legacy, "legacy").when(tests, "tests").otherwise("production")


def production(path: Column) -> Column:
    """Whether a path is neither test code nor vendored; a null or empty path is not production."""
    return F.coalesce((path != "") & ~path.rlike(TEST_PATH) & ~path.rlike(VENDORED_PATH), F.lit(False))


SCOPE_SQL = """CASE WHEN len(list_filter(string_split(lower(coalesce({0}, '')), '/'), lambda p: contains(p, 'legacy') OR contains(p, 'backup'))) > 0 THEN 'legacy'
  WHEN len(list_filter(string_split(lower(coalesce({0}, '')), '/'), lambda p: p IN ('test', 'tests', 'testing', '__tests__', 'spec', 'specs') OR ends_with(p, 'test') OR ends_with(p, 'tests'))) > 0 THEN 'tests'
  ELSE 'production' END"""
PRODUCTION_SQL = rf"({{0}} <> '' AND NOT regexp_matches({{0}}, '{TEST_PATH}') AND NOT regexp_matches({{0}}, '{VENDORED_PATH}'))"
