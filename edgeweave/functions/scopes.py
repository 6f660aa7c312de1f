"""Corpus scopes of paths and the three notions of a test."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from edgeweave.schema import SCOPES

# Directory names and file-name marks of each scope.
VENDOR_DIRS = ("vendor", "vendored", "third_party", "third-party", "node_modules")
GENERATED_DIRS = ("generated", "autogen", "auto-generated", "generated-src")
GENERATED_INSIDE, GENERATED_ENDS = (".generated.", "_generated."), (".g.rs", ".pb.go", ".designer.cs")
FIXTURE_DIRS = ("fixture", "fixtures", "golden", "testdata", "test-data", "snapshot", "snapshots", "__snapshots__")
EXAMPLE_DIRS = ("example", "examples", "sample", "samples", "demo", "demos")
TEST_DIRS = ("test", "tests", "spec", "specs")
TEST_INSIDE = ("_test.", ".test.", "_spec.", ".spec.")
DOC_DIRS = ("docs", "doc", "documentation")
DOC_NAMES = ("readme", "readme.md", "readme.mdx", "changelog.md", "contributing.md", "architecture.md")
DOC_ENDS = (".md", ".mdx", ".rst", ".adoc", ".asciidoc")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def scope_of(file: Column) -> Column:
    """The scope that a path alone gives; whole components count, the first rule that holds wins."""
    parts = F.split(F.lower(F.replace(file, F.lit("\\"), F.lit("/"))), "/")
    base = F.element_at(parts, -1)
    within = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    holds = lambda marks: _any([base.contains(m) for m in marks])
    ends = lambda marks: _any([base.endswith(m) for m in marks])
    return (
        F.when(file.startswith("dep:") | within(VENDOR_DIRS), "vendor")
        .when(within(GENERATED_DIRS) | holds(GENERATED_INSIDE) | ends(GENERATED_ENDS), "generated")
        .when(within(FIXTURE_DIRS), "fixture")
        .when(within(EXAMPLE_DIRS), "example")
        .when(within(TEST_DIRS) | base.startswith("test_") | holds(TEST_INSIDE), "test")
        .when(F.element_at(parts, 1).isin(*DOC_DIRS) | base.isin(*DOC_NAMES) | ends(DOC_ENDS), "docs")
        .otherwise("production")
    )


def glob_regex(pattern: str) -> str:
    """An ignore-file pattern as a regular expression over a whole relative path."""
    if pattern.startswith("!"):
        raise ValueError(f"negated pattern: {pattern}")
    body, only_dir = pattern.rstrip("/"), pattern.endswith("/")
    rooted, body = "/" in body, body.lstrip("/")
    parts = []
    for piece in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", body):
        parts.append({"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(piece) or (piece if piece[:1] == "[" else re.escape(piece)))
    return f"^{'' if rooted else '(?:.*/)?'}{''.join(parts)}{'/.*' if only_dir else '(?:/.*)?'}$"


def scope_with_rules(file: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The scope of the last (pattern, scope) rule that matches, else that of the path."""
    for _, scope in rules:
        if scope not in SCOPES:
            raise ValueError(f"unknown scope: {scope}")
    out = scope_of(file)
    for pattern, scope in rules:
        out = F.when(file.rlike(glob_regex(pattern)), F.lit(scope)).otherwise(out)
    return out


def parse_scopes(text: str | None, traversal: bool = False) -> frozenset[str]:
    """A selection of scopes; without one all for traversals, else production and docs."""
    aliases = {"prod": "production", "tests": "test", "fixtures": "fixture", "examples": "example", "doc": "docs"}
    if text is None:
        return frozenset(SCOPES) if traversal else frozenset({"production", "docs"})
    names = [aliases.get(n.strip().lower(), n.strip().lower()) for n in text.split(",") if n.strip()]
    if "all" in names:
        if len(names) > 1:
            raise ValueError("all stands alone")
        return frozenset(SCOPES)
    unknown = [n for n in names if n not in SCOPES]
    if unknown or not names:
        raise ValueError(f"unknown scopes: {unknown}")
    return frozenset(names)


def ranks_as_test(file: Column, qualified: Column) -> Column:
    """A test by path or by any segment of its name, where ranking lowers it."""
    by_path = file.startswith("tests/") | file.startswith("test/") | _any([file.contains(m) for m in ("/tests/", "/test/", "/testing.", "_test.", ".test.", "test_")])
    by_name = F.exists(F.split(F.lower(qualified), "::"), lambda s: s.startswith("test") | s.endswith("test") | s.endswith("tests"))
    return by_path | by_name


def ranks_as_vendor(file: Column) -> Column:
    return F.exists(F.split(F.lower(file), "/"), lambda s: s.isin("vendor", "third_party", "node_modules") | s.contains("generated"))


def impact_test(file: Column, name: Column, qualified: Column) -> Column:
    """A test that a change's radius can name."""
    marks = _any([file.contains(m) for m in (".test.", ".spec.", "/tests/", "/test/")])
    ends = _any([file.endswith(m) for m in ("_test.go", "_test.py", "Tests.cs")])
    return marks | ends | file.startswith("tests/") | name.startswith("test_") | name.startswith("Test") | F.array_contains(F.split(qualified, "::"), "tests")


def ignored(path: str, patterns: Sequence[str]) -> bool:
    """Whether ignore patterns leave a path out, the last that matches deciding."""
    out = False
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        keep = p.startswith("!")
        if re.match(glob_regex(p.removeprefix("!")), path) or fnmatch.fnmatch(path, p.removeprefix("!")):
            out = not keep
    return out
