"""Source text to facts: definitions, references, locals, fields and sections of one file.

An extractor is a function of (file, text) that yields captures; a language is a row of data: its endings, separators
and either an extractor of its own or the patterns of its definitions, imports and calls.  What captures share --
qualification by containment, smallest enclosing definition, documentation, signatures -- is common to all.  Offsets
are bytes.  One file at a time is parsed in a Python worker; everything after is joins.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Captures:
    """defs: (kind, name, start, end, doc); refs: (relation, name, path, start, end, alias); locals: (name, start, end, scope_end, type)."""

    defs: list = field(default_factory=list)
    refs: list = field(default_factory=list)
    locals: list = field(default_factory=list)
    fields: list = field(default_factory=list)  # (name, type, start)
    embeds: list = field(default_factory=list)  # (type, start)
    errors: bool = False


@dataclass(frozen=True)
class Patterns:
    """What a language written with braces looks like; named groups ``name``, and ``base`` for what is extended."""

    defs: tuple[tuple[str, str], ...]
    imports: str | None = None
    calls: str = r"(?P<path>(?:[A-Za-z_]\w*(?:::|->|\.))*)(?P<name>[A-Za-z_]\w*)\s*\("
    comment: str = r"//[^\n]*|/\*.*?\*/"
    lines: str = "//"


ID = r"(?P<name>[A-Za-z_]\w*)"
# The definition forms of each language.
PATTERNS = {
    "rust": Patterns((("function", rf"\bfn\s+{ID}"), ("struct", rf"\bstruct\s+{ID}"), ("enum", rf"\benum\s+{ID}"), ("trait", rf"\btrait\s+{ID}"), ("typealias", rf"\btype\s+{ID}\s*="), ("constant", rf"\bconst\s+{ID}\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?{ID}\s*:"), ("module", rf"\bmod\s+{ID}"), ("macro", rf"\bmacro_rules!\s*{ID}")), r"\buse\s+(?P<path>[\w:]+(?:::\*)?)"),
    "go": Patterns((("function", rf"\bfunc\s+{ID}"), ("method", rf"\bfunc\s+\([^)]*\)\s*{ID}"), ("struct", rf"\btype\s+{ID}\s+struct"), ("interface", rf"\btype\s+{ID}\s+interface"), ("constant", rf"\bconst\s+{ID}"), ("variable", rf"(?m)^var\s+{ID}")), r"(?m)^\s*import\s+(?:\w+\s+)?\"(?P<path>[^\"]+)\""),
    "typescript": Patterns((("function", rf"\bfunction\s+{ID}"), ("class", rf"\bclass\s+{ID}(?:\s+extends\s+(?P<base>\w+))?"), ("interface", rf"\binterface\s+{ID}"), ("typealias", rf"\btype\s+{ID}\s*="), ("enum", rf"\benum\s+{ID}"), ("constant", rf"(?m)^(?:export\s+)?const\s+{ID}")), r"\bfrom\s+['\"](?P<path>[^'\"]+)['\"]|\brequire\(\s*['\"](?P<path2>[^'\"]+)['\"]\s*\)"),
    "java": Patterns((("class", rf"\bclass\s+{ID}(?:\s+extends\s+(?P<base>\w+))?"), ("interface", rf"\binterface\s+{ID}"), ("enum", rf"\benum\s+{ID}"), ("method", rf"(?m)^\s*(?:(?:public|private|protected|static|final|abstract|override|virtual|async)\s+)+[\w<>\[\],.?]+\s+{ID}\s*\(")), r"(?m)^\s*import\s+(?:static\s+)?(?P<path>[\w.]+(?:\.\*)?)\s*;"),
    "cpp": Patterns((("class", rf"\bclass\s+{ID}(?:\s*:\s*(?:public\s+)?(?P<base>\w+))?\s*[{{]"), ("struct", rf"\bstruct\s+{ID}\s*[{{]"), ("enum", rf"\benum\s+(?:class\s+)?{ID}"), ("module", rf"\bnamespace\s+{ID}"), ("function", rf"(?m)^[\w:<>*&\s]+?\b{ID}\s*\([^;{{}}]*\)\s*(?:const\s*)?[{{]"), ("macro", rf"(?m)^#define\s+{ID}")), r"(?m)^\s*#include\s+[<\"](?P<path>[^>\"]+)[>\"]"),
    "proto": Patterns((("struct", rf"\bmessage\s+{ID}"), ("enum", rf"\benum\s+{ID}"), ("interface", rf"\bservice\s+{ID}"), ("method", rf"\brpc\s+{ID}")), r"\bimport\s+\"(?P<path>[^\"]+)\"", calls=r"(?P<path>)\b(?P<name>[A-Z]\w*)\s*\)"),
    "bash": Patterns((("function", rf"(?m)^\s*(?:function\s+)?{ID}\s*\(\)"),), r"(?m)^\s*(?:source|\.)\s+(?P<path>\S+)", calls=r"(?m)^\s*(?P<path>)(?P<name>[A-Za-z_]\w*)(?=\s|$)(?!\s*\()", comment=r"(?m)(?<!\S)#[^\n]*", lines="#"),
}
PATTERNS |= {"javascript": PATTERNS["typescript"], "csharp": PATTERNS["java"], "c": PATTERNS["cpp"]}
#: Words before a parenthesis that call nothing; fixed values.
KEYWORDS = frozenset("if for while switch match return catch function fn func def class sizeof new else do try with in and or not loop case await throw defer go select".split())
#: A script's way to say its own folder; fixed values.
HERE = re.compile(r'^(?:"?\$\(dirname "?(?:\$0|\$\{BASH_SOURCE\[0\]\})"?\)"?|\$\{BASH_SOURCE%/\*\}|\.)/')


def offsets(text: str) -> list[int]:
    """The byte at which each character begins, and the end."""
    out, at = [0], 0
    for c in text:
        at += len(c.encode("utf-8", "surrogatepass"))
        out.append(at)
    return out


def python_captures(text: str) -> Captures:
    out = Captures()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out.errors = True
        return out
    begins = [0]
    for line in text.encode().split(b"\n"):
        begins.append(begins[-1] + len(line) + 1)
    start = lambda n: begins[n.lineno - 1] + n.col_offset
    end = lambda n: begins[n.end_lineno - 1] + n.end_col_offset

    def dotted(n: ast.AST) -> str | None:
        if isinstance(n, ast.Name):
            return n.id
        if isinstance(n, ast.Attribute) and (head := dotted(n.value)):
            return f"{head}.{n.attr}"
        return None

    def visit(n: ast.AST, owner: ast.AST | None) -> None:
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            out.defs.append(("method" if isinstance(owner, ast.ClassDef) else "function", n.name, start(n), end(n), ast.get_docstring(n)))
            args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
            for a in args[isinstance(owner, ast.ClassDef) :]:
                out.locals.append((a.arg, start(a), end(a), end(n), dotted(a.annotation) if a.annotation else None))
        elif isinstance(n, ast.ClassDef):
            out.defs.append(("class", n.name, start(n), end(n), ast.get_docstring(n)))
            for b in n.bases:
                if name := dotted(b):
                    out.refs.append(("extends", name.split(".")[-1], name if "." in name else None, start(b), end(b), None))
                    out.embeds.append((name, start(b)))
        elif isinstance(n, ast.AnnAssign) and isinstance(owner, ast.ClassDef) and isinstance(n.target, ast.Name):
            out.fields.append((n.target.id, dotted(n.annotation) or "", start(n)))
        elif isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    if owner is None:
                        out.defs.append(("constant" if t.id.isupper() else "variable", t.id, start(n), end(n), None))
                    elif not isinstance(owner, ast.ClassDef):
                        out.locals.append((t.id, start(t), end(t), end(owner), dotted(n.value.func) if isinstance(n.value, ast.Call) else None))
        elif isinstance(n, ast.Import):
            for a in n.names:
                out.refs.append(("imports", a.name, None, start(n), end(n), a.asname))
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            for a in n.names:
                out.refs.append(("imports", base if a.name == "*" else f"{base}.{a.name}" if n.module else base + a.name, None, start(n), end(n), "*" if a.name == "*" else a.asname or a.name))
        elif isinstance(n, ast.Call) and (name := dotted(n.func)):
            out.refs.append(("calls", name.split(".")[-1], name if "." in name else None, start(n.func), end(n.func), None))
        inner = n if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else owner
        for child in ast.iter_child_nodes(n):
            visit(child, inner)

    visit(tree, None)
    return out


def sql_captures(text: str) -> Captures:
    """Tables, views, functions and indexes; FROM, JOIN, UPDATE, INTO and REFERENCES are uses."""
    out, at = Captures(), offsets(text)
    plain = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", lambda m: " " * len(m[0]), text, flags=re.S)
    name = r'(?P<name>(?:"?\w+"?\.)?"?\w+"?)'
    for kind, word in (("struct", "TABLE"), ("typealias", r"(?:MATERIALIZED\s+)?VIEW"), ("function", "(?:FUNCTION|PROCEDURE)"), ("constant", r"(?:UNIQUE\s+)?INDEX")):
        for m in re.finditer(rf"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?{word}\s+(?:IF\s+NOT\s+EXISTS\s+)?{name}[^;]*", plain, re.I):
            out.defs.append((kind, m["name"].split(".")[-1].strip('"'), at[m.start()], at[m.end()], None))
    for m in re.finditer(rf"\b(?:FROM|JOIN|UPDATE|INTO|REFERENCES|ON)\s+{name}(?!\s*\.)", plain, re.I):
        if m[0][:2].upper() == "ON" and not re.search(r"\bINDEX\s+\S+\s+$", plain[: m.start()], re.I):
            continue
        leaf = m["name"].split(".")[-1].strip('"')
        if leaf.upper() not in ("SELECT", "SET", "LATERAL", "VALUES"):
            out.refs.append(("uses", leaf, None, at[m.start("name")], at[m.end("name")], None))
    return out


def markdown_captures(text: str) -> Captures:
    """Headings as sections, each to the next of its rank or higher; links to files and fragments as uses."""
    out, at = Captures(), offsets(text)
    plain = re.sub(r"```.*?```|`[^`\n]*`", lambda m: " " * len(m[0]), text, flags=re.S)
    heads = [(len(m[1]), m[2].strip(), m.start()) for m in re.finditer(r"(?m)^(#{1,6})\s+(.*?)\s*#*$", plain)]
    for i, (rank, title, start) in enumerate(heads):
        stop = next((s for r, _, s in heads[i + 1 :] if r <= rank), len(text))
        if title:
            out.defs.append(("section", title, at[start], at[stop], None))
    for m in re.finditer(r"(?<!!)\[[^\]]*\]\((?P<to>[^)\s]+)[^)]*\)", plain):
        if not re.match(r"[a-z][a-z0-9+.-]*:", m["to"], re.I):
            out.refs.append(("uses", m["to"].split("#")[0] or m["to"], m["to"], at[m.start("to")], at[m.end("to")], None))
    return out


def closing(plain: str, start: int) -> int:
    """The end of the block that begins at or after ``start``: its closing brace, else the line or statement."""
    brace, stop = plain.find("{", start), re.compile(r"[;\n]").search(plain, start)
    if brace < 0 or stop and stop.start() < brace and plain[stop.start()] == ";":
        return stop.start() if stop else len(plain)
    depth = 0
    for m in re.compile(r"[{}]").finditer(plain, brace):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(plain)


def pattern_captures(text: str, p: Patterns) -> Captures:
    out, at = Captures(), offsets(text)
    plain = re.sub(p.comment, lambda m: " " * len(m[0]), text, flags=re.S)
    bare = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"", lambda m: '"' + " " * (len(m[0]) - 2) + '"', plain)
    taken = set()
    for kind, pattern in p.defs:
        for m in re.finditer(pattern, bare):
            if m["name"] in KEYWORDS:
                continue
            taken.add(m.start("name"))
            head = m.start() + len(m[0]) - len(m[0].lstrip())
            out.defs.append((kind, m["name"], at[head], at[closing(bare, m.end())], preceding(text, head, p.lines)))
            if "base" in m.groupdict() and m["base"]:
                out.refs.append(("extends", m["base"], None, at[m.start("base")], at[m.end("base")], None))
                out.embeds.append((m["base"], at[m.start("base")]))
    for m in re.finditer(p.imports, plain) if p.imports else ():
        group = "path" if m["path"] is not None else "path2"
        name = m[group].strip("'\"")
        glob = re.search(r"(::|\.)\*$", name)
        name = HERE.sub("", name)
        out.refs.append(("imports", name, None, at[m.start(group)], at[m.end(group)], "*" if glob else None))
    for m in re.finditer(p.calls, bare):
        if m["name"] not in KEYWORDS and m.start("name") not in taken:
            path = m["path"] + m["name"] if m["path"] else None
            out.refs.append(("calls", m["name"], path, at[m.start()] if path else at[m.start("name")], at[m.end("name")], None))
    return out


def preceding(text: str, at: int, mark: str) -> str | None:
    """The comment lines that end on the line before, without their marks."""
    lines = text[:at].split("\n")[:-1]
    out = []
    while lines and (s := lines[-1].strip()).startswith((mark, "*", "/*", "#[", "@")) and s:
        if not s.startswith(("#[", "@")):
            out.append(re.sub(r"^(?:///|//!|//|/\*\*?|\*/|\*(?!\*)|--|#)\s?|\s*\*/$", "", s))
        lines.pop()
    doc = "\n".join(reversed(out)).strip()
    return doc or None


EXTRACTORS: dict[str, Callable[[str], Captures]] = {"python": python_captures, "sql": sql_captures, "markdown": markdown_captures}


def captures(language: str, text: str) -> Captures:
    if language in EXTRACTORS:
        return EXTRACTORS[language](text)
    return pattern_captures(text, PATTERNS[language]) if language in PATTERNS else Captures()


def facts(file: str, language: str, text: str) -> tuple[list, list, list, list, list, bool]:
    """nodes, contains, references, locals, fields of one file, and whether its syntax was broken."""
    got = captures(language, text)
    data = text.encode("utf-8", "surrogatepass")
    best: dict[tuple, tuple] = {}
    for d in got.defs:  # E6: of one span and name, what is no variable
        k = (d[2], d[3], d[1])
        if d[3] > d[2] and (k not in best or best[k][0] == "variable"):
            best[k] = d
    nodes = [(file, "file", file.rsplit("/", 1)[-1], file, 0, max(1, len(data)), "", None)]
    contains, spans, stack = [], [], []
    for kind, name, start, end, doc in sorted(best.values(), key=lambda d: (d[2], -d[3], d[1])):  # E4
        while stack and stack[-1][2] <= start:
            stack.pop()
        qualified = "::".join([*(s[0] for s in stack), name])
        ident = f"{file}#{qualified}@{start}"
        body = data[start:end].decode("utf-8", "replace")
        head = re.split(r"\{", body, maxsplit=1)[0] if language != "python" else body.split("\n", 1)[0]
        nodes.append((ident, kind, name, file, start, end, " ".join(head.split())[:400], doc))
        contains.append((stack[-1][1] if stack else file, ident))
        spans.append((start, end, ident, kind))
        stack.append((name, ident, end))

    def around(a: int, b: int, kinds: tuple[str, ...] | None = None, strict: bool = False) -> str | None:  # E5
        inside = [s for s in spans if s[0] <= a and b <= s[1] and (kinds is None or s[3] in kinds) and not (strict and s[0] == a)]
        return min(inside, key=lambda s: (s[1] - s[0], s[2]))[2] if inside else None

    refs = [(file, name, path, relation, a, b, around(a, b), alias) for relation, name, path, a, b, alias in sorted(got.refs, key=lambda r: (r[3], r[4], r[0])) if b > a]
    locals_ = [(file, name, a, b, scope, kind) for name, a, b, scope, kind in got.locals]
    owners = ("struct", "class", "trait", "interface")
    fields_ = [(owner, name, kind) for name, kind, a in got.fields if (owner := around(a, a + 1, owners))]
    return nodes, contains, refs, locals_, fields_, got.errors


FACTS = (
    "file string, language string, has_syntax_errors boolean, "
    "nodes array<struct<id:string,kind:string,name:string,file:string,start:bigint,end:bigint,signature:string,doc:string>>, contains array<struct<src:string,dst:string>>, "
    "refs array<struct<file:string,name:string,path:string,relation:string,start:bigint,end:bigint,enclosing:string,alias:string>>, "
    "locals array<struct<file:string,name:string,start:bigint,end:bigint,scope_end:bigint,type_name:string>>, fields array<struct<owner:string,name:string,type_name:string>>"
)


def extract(files: DataFrame) -> DataFrame:
    """One row of facts per file; ``files``: file, language, content (text or bytes)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        keys = (
            ("id", "kind", "name", "file", "start", "end", "signature", "doc"), ("src", "dst"), ("file", "name", "path", "relation", "start", "end", "enclosing", "alias"),
            ("file", "name", "start", "end", "scope_end", "type_name"), ("owner", "name", "type_name"),
        )
        for b in batches:
            rows = []
            for file, language, content in zip(b["file"], b["language"], b["content"], strict=True):
                text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace")
                *parts, errors = facts(file, language, text)
                rows.append([file, language, errors, *[[dict(zip(k, r, strict=True)) for r in p] for k, p in zip(keys, parts, strict=True)]])
            yield pd.DataFrame(rows, columns=["file", "language", "has_syntax_errors", "nodes", "contains", "refs", "locals", "fields"])

    return files.select("file", "language", "content").mapInPandas(run, FACTS)


def exploded(facts_: DataFrame, part: str) -> DataFrame:
    """One of the arrays as a table."""
    return facts_.select(F.explode(part).alias("x")).select("x.*")
