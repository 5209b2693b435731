"""Definitions and uses in source, build and configuration files.

No parser library is assumed. Comments and strings are blanked, bytes keeping
their places, and each language is a table of patterns over what is left;
braces, or indentation, tell scopes and spans. All places are bytes, lines and
columns count from 1. A language's entry in EXTRACTORS can be replaced.
"""

from __future__ import annotations

import ast
import re
import signal
import tomllib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = dict


@dataclass
class Source:
    """A file's bytes as Latin-1 text, so that every index is a byte's place."""

    raw: str
    mask: str
    starts: list[int]
    rows: list[Row] = field(default_factory=list)

    @classmethod
    def of(cls, content: bytes, blank: str = "") -> Source:
        raw = content.decode("latin-1")
        mask = re.sub(blank, lambda m: re.sub(r"[^\n]", " ", m[0]), raw) if blank else raw
        return cls(raw, mask, [0, *(m.end() for m in re.finditer("\n", raw))])

    def add(self, symbol: bool, name: str, kind: str, start: int, scope: Iterable[str] = (), end: int | None = None, span: tuple[int, int] | None = None) -> None:
        line = bisect_right(self.starts, start)
        text = lambda s: s.encode("latin-1").decode("utf-8", "replace")
        end = start + len(name) if end is None else end
        self.rows.append({
            "symbol": symbol, "name": text(name), "kind": kind, "byte_start": start, "byte_end": end, "span_start": span[0] if span else start, "span_end": span[1] if span else end,
            "line": line, "col": start - self.starts[line - 1] + 1, "scope_path": [text(s) for s in scope],
        })

    def lines(self, masked: bool = False) -> Iterator[tuple[int, str]]:
        text = self.mask if masked else self.raw
        for i, start in enumerate(self.starts):
            end = self.starts[i + 1] - 1 if i + 1 < len(self.starts) else len(text)
            yield start, text[start:end]

    def close(self, opening: int, pair: str = "{}") -> int:
        """The place after the bracket that closes the one at `opening`, or the end."""
        depth = 0
        for m in re.compile(f"[{re.escape(pair)}]").finditer(self.mask, opening):
            depth += 1 if m[0] == pair[0] else -1
            if not depth:
                return m.end()
        return len(self.mask)


def squeezed(mask: str) -> tuple[str, Callable[[int], int]]:
    """The text with each run of white space as one blank, or one line end if it has some, and the way back to places in it.

    What is blanked out would otherwise be looked at again from every place in it.
    """
    parts, cuts, shifts, at, out = [], [0], [0], 0, 0
    for m in re.finditer(r"\s{2,}", mask):
        parts += [mask[at : m.start()], "\n" if "\n" in m[0] else " "]
        out += m.start() - at + 1
        at = m.end()
        cuts.append(out)
        shifts.append(at - out)
    text = "".join([*parts, mask[at:]])
    return text, lambda i: i + shifts[bisect_right(cuts, i) - 1]


def brackets(text: str) -> dict[int, int]:
    """For each opening brace the place after the one that closes it, or the end."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out | dict.fromkeys(open_, len(text))


def nesting(holders: list[tuple[tuple[int, int], str, str]]) -> Callable[[int], list[tuple[str, str]]]:
    """A function from a place to the (name, kind) of the holders (body, name, kind) around it, outermost first, to be asked for rising places."""
    holders, stack, following = sorted(holders), [], 0

    def around(at: int) -> list[tuple[str, str]]:
        nonlocal following
        while following < len(holders) and holders[following][0][0] < at:
            body = holders[following][0]
            while stack and stack[-1][0][1] <= body[0]:
                stack.pop()
            stack.append(holders[following])
            following += 1
        while stack and stack[-1][0][1] <= at:
            stack.pop()
        return [(name, kind) for _, name, kind in stack]

    return around


COMMENTS = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
C_BLANK = COMMENTS + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
HASH_BLANK = r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'"
WORD = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
KEYWORDS = frozenset("if for while switch catch return new else do try throw sizeof typeof synchronized assert case super this in is as fn func def class when match loop await yield delete function defined".split())


@dataclass
class Language:
    """Patterns with groups `name`, and for definitions optionally `end`; kinds by pattern."""

    symbols: list[tuple[str, str]]
    refs: list[tuple[str, str]]
    scopes: frozenset[str]
    blank: str = C_BLANK
    members: dict[str, str] = field(default_factory=dict)
    #: Where a definition's head ends: at its body, or without one; what is in parentheses is passed over.
    ends: str = r"[{;]"
    #: Words before a parenthesis that call nothing, besides KEYWORDS.
    words: frozenset[str] = frozenset()


def braces(language: Language) -> Callable[[bytes], list[Row]]:
    """An extractor for languages whose scopes are in braces."""

    def extract(content: bytes) -> list[Row]:
        src = Source.of(content, language.blank)
        mask, place = squeezed(src.mask)
        closes, ends = brackets(mask), re.compile(language.ends)
        heads = [m.span() for m in re.finditer(r"^\s*(?:import|package)\b[^;\n]*", mask, re.M)]
        begins = [a for a, _ in heads]
        found, taken = [], set()
        for pattern, kind in language.symbols:
            for m in re.finditer(pattern, mask, re.M):
                name = m["name"]
                if m.start("name") in taken or name in KEYWORDS:
                    continue
                taken.add(m.start("name"))
                opening = ends.search(mask, m.end() - 1)
                while opening and opening[0][0] == "(":
                    opening = ends.search(mask, opening.end())
                body = (opening.start(), closes[opening.start()]) if opening and opening[0] == "{" else (m.end(), m.end())
                found.append([m.start("name"), m.end() - len(m[0].lstrip()), kind, name, body, (m.groupdict().get("owner") or "").strip(":.")])
        found.sort()
        holders = [(body, name, kind) for _, _, kind, name, body, _ in found if kind in language.scopes and body[1] > body[0]]
        around = nesting(holders)
        for start, first, kind, name, body, owner in found:
            outer = around(start)
            if kind in language.members:  # a function in a type is a method, one of its name a constructor
                inside = bool(outer) and outer[-1][1] not in ("fn", "method", "ctor", "ns")
                kind = ("ctor" if outer and outer[-1][0] == name else language.members[kind]) if inside or owner else kind
            last = max(body[1], start + len(name))
            src.add(True, name, kind, place(start), [n for n, _ in outer] + ([owner] if owner else []), span=(place(first), place(last - 1) + 1))
        for pattern, kind in language.refs:
            around = nesting(holders)
            for m in re.finditer(pattern, mask, re.M):
                for part in re.finditer(r"[\w$.*:\x80-\xff]+", m["names"]) if "names" in m.groupdict() else [None]:
                    name, start = (part[0], m.start("names") + part.start()) if part else (m["name"], m.start("name"))
                    if kind in ("call", "ctor", "inherit", "type", "field") and (name in KEYWORDS or start in taken) or name in ("implements", "with", "public", "private", "protected", "virtual"):
                        continue
                    if name in language.words or kind == "field" and (k := bisect_right(begins, start) - 1) >= 0 and start < heads[k][1]:
                        continue
                    inside = [n for n, _ in around(start)]
                    child = m.groupdict().get("child")
                    src.add(False, name, kind, place(start), [*inside, child] if child else inside)
        return src.rows

    return extract


TYPES = rf"(?:{WORD}(?:\s*<[^;{{}}()]{{0,300}}>)?(?:\s*\[\s*\])*)"
ARGS = r"\((?:[^;{}()]|\([^;{}()]*\))*\)"
NOT = r"(?!(?:new|return|else|throw|case|goto|await|yield)\b)"
CALL = (rf"(?<!new )(?<![\w$])(?P<name>{WORD})\s*\(", "call")
NEW = (rf"\bnew\s+(?:[\w$]+\.)*(?P<name>{WORD})", "ctor")
FIELD = (rf"\.(?P<name>{WORD})\b(?!\s*[\w$(])", "field")
EXTENDS = (rf"\b(?:class|interface|enum|record)\s+(?P<child>{WORD})[^{{;]*?\b(?:extends|implements)\s+(?P<names>[^{{;]+)", "inherit")
TYPE_SCOPES = frozenset("class iface enum annot struct union ns trait fn method ctor module other aidl.iface aidl.parcel proto.msg proto.svc proto.enum".split())

JAVA = Language(
    [
        (r"^\s*package\s+(?P<name>[\w.]+)\s*;", "pkg"), (rf"@interface\s+(?P<name>{WORD})", "annot"), (rf"\binterface\s+(?P<name>{WORD})", "iface"),
        (rf"\benum\s+(?P<name>{WORD})", "enum"), (rf"\b(?:class|record)\s+(?P<name>{WORD})", "class"),
        (rf"(?<![\w.]){NOT}{TYPES}\s+(?P<name>{WORD})\s*{ARGS}\s*(?:throws\s+[\w.,\s]+)?[{{;]", "fn"), (rf"^\s*(?:(?:public|protected|private)\s+)?(?P<name>[A-Z]\w*)\s*{ARGS}\s*(?:throws\s+[\w.,\s]+)?\{{", "fn"),
        (rf"^\s*(?:(?:public|protected|private|static|final|volatile|transient)\s+)+{TYPES}\s+(?P<name>{WORD})\s*[=;]", "field"),
    ],
    [(r"^\s*import\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;", "import"), EXTENDS, NEW, CALL, FIELD],
    TYPE_SCOPES, members={"fn": "method"},
)
KOTLIN = Language(
    [
        (r"^\s*package\s+(?P<name>[\w.]+)", "pkg"), (rf"\binterface\s+(?P<name>{WORD})", "iface"), (rf"\benum\s+class\s+(?P<name>{WORD})", "enum"), (rf"\b(?:class|object)\s+(?P<name>{WORD})", "class"),
        (r"\b(?P<name>companion)\s+object\s*\{", "class"), (rf"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<owner>{WORD}\.))?(?P<name>{WORD})\s*\(", "fn"), (rf"\b(?:val|var)\s+(?P<name>{WORD})", "field"), (rf"\btypealias\s+(?P<name>{WORD})", "type"),
    ],
    [(r"^\s*import\s+(?P<name>[\w.]+(?:\.\*)?)", "import"), CALL, FIELD],
    TYPE_SCOPES, members={"fn": "method"},
    ends=r"\((?:[^()]|\([^()]*\))*\)|[{};=]|\n(?=(?:fun|val|var|class|object|interface|enum|data|sealed|override|private|public|internal|protected|abstract|open|@\w+)\b)",
)
C = Language(
    [
        (rf"^[ \t]*#\s*define\s+(?P<name>{WORD})", "macro"), (rf"\bstruct\s+(?P<name>{WORD})\s*\{{", "struct"), (rf"\bunion\s+(?P<name>{WORD})\s*\{{", "union"), (rf"\benum\s+(?P<name>{WORD})\s*\{{", "enum"),
        (rf"\btypedef\b[^;{{}}]*?(?P<name>{WORD})\s*;", "type"), (rf"(?<![\w.>:]){NOT}(?:[\w*&]+[\s*&]+){{1,9}}(?P<name>{WORD})\s*{ARGS}\s*(?:const\s*)?\{{", "fn"),
    ],
    [CALL], TYPE_SCOPES,
)
CPP = Language(
    [
        *C.symbols[:1], (rf"\bnamespace\s+(?P<name>{WORD}(?:::{WORD})*)\s*\{{", "ns"), (rf"\bclass\s+(?P<name>{WORD})\s*(?:final\s*)?(?::[^;{{]*)?\{{", "class"), (rf"\bstruct\s+(?P<name>{WORD})\s*(?::[^;{{]*)?\{{", "struct"), *C.symbols[2:3],
        (rf"\benum\s+(?:class\s+|struct\s+)?(?P<name>{WORD})[^;{{]*\{{", "enum"), *C.symbols[4:5], (rf"\busing\s+(?P<name>{WORD})\s*=", "type"),
        (rf"(?<![\w*&<>:,])(?:[\w*&<>:,]+[\s*&]+)(?P<owner>(?:{WORD}::)+)(?P<name>~?{WORD})\s*{ARGS}[^;{{}}]*\{{", "fn"), (rf"(?<![\w.>:]){NOT}(?:[\w*&<>:]+[\s*&]+){{1,9}}(?P<name>{WORD})\s*{ARGS}\s*(?:const|noexcept|override|final|\s)*\{{", "fn"),
    ],
    [(rf"\b(?:class|struct)\s+(?P<child>{WORD})\s*(?:final\s*)?:(?!:)\s*(?P<names>[^{{;]+)\{{", "inherit"), (r"\busing\s+namespace\s+(?P<name>[\w:]+)\s*;", "using-ns"), NEW, CALL],
    TYPE_SCOPES, members={"fn": "method"},
)
RUST = Language(
    [
        (rf"\bfn\s+(?P<name>{WORD})", "fn"), (rf"\bstruct\s+(?P<name>{WORD})", "struct"), (rf"\benum\s+(?P<name>{WORD})", "enum"), (rf"\btrait\s+(?P<name>{WORD})", "trait"), (rf"\bmod\s+(?P<name>{WORD})", "module"),
        (rf"\bimpl\b(?:\s*<[^>]*>)?(?:\s+[\w:<>]+\s+for)?\s+(?P<name>{WORD})", "other"), (rf"\btype\s+(?P<name>{WORD})", "type"), (rf"\b(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z]\w*)\s*:", "const"), (rf"\bmacro_rules!\s*(?P<name>{WORD})", "macro"),
    ],
    [(r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:*]+)", "import"), (rf"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:]+::)?(?P<name>{WORD})(?:<[^>]*>)?\s+for\b", "inherit"), (rf"(?P<name>{WORD})!\s*[(\[{{]", "call"), CALL],
    TYPE_SCOPES, r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"", members={},
)
GO = Language(
    [
        (rf"^func\s*\([^)]*\)\s*(?P<name>{WORD})", "method"), (rf"^func\s+(?P<name>{WORD})", "fn"), (rf"^type\s+(?P<name>{WORD})", "type"), (rf"^const\s+(?P<name>{WORD})", "const"), (rf"^var\s+(?P<name>{WORD})", "var"),
    ],
    [CALL], frozenset(), r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|`[^`]*`", words=frozenset("import const var type func struct interface select defer go range".split()),
)
TYPESCRIPT = Language(
    [
        (rf"\bclass\s+(?P<name>{WORD})", "class"), (rf"\binterface\s+(?P<name>{WORD})", "iface"), (rf"\benum\s+(?P<name>{WORD})", "enum"), (rf"^\s*(?:export\s+)?type\s+(?P<name>{WORD})\s*[=<]", "type"), (rf"\bfunction\s*\*?\s*(?P<name>{WORD})", "fn"),
        (rf"(?:^|[{{;}}])\s*(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>{WORD})\s*{ARGS}\s*(?::[^;{{}}=]+)?\{{", "fn"), (rf"\b(?:const|let|var)\s+(?P<name>{WORD})", "var"),
    ],
    [EXTENDS, NEW, CALL, (r":\s*(?P<name>[A-Z]\w*)", "type")], TYPE_SCOPES, C_BLANK + r"|`[^`]*`", members={"fn": "method"},
)
PROTO = Language(
    [(rf"\bmessage\s+(?P<name>{WORD})", "proto.msg"), (rf"\benum\s+(?P<name>{WORD})", "proto.enum"), (rf"\bservice\s+(?P<name>{WORD})", "proto.svc"), (rf"\brpc\s+(?P<name>{WORD})", "method")],
    [], TYPE_SCOPES,
)


def java(content: bytes) -> list[Row]:
    """Java, with the JNI name of each native method."""
    rows = braces(JAVA)(content)
    package = next((r["name"] for r in rows if r["kind"] == "pkg"), "")
    masked = Source.of(content, C_BLANK).mask

    def mangled(part: str) -> str:
        return part.replace("_", "_1").replace("$", "_00024").replace(".", "_")

    for r in [r for r in rows if r["symbol"] and r["kind"] == "method" and r["scope_path"] and package]:
        if re.search(r"\bnative\b[^;{}]*$", masked[max(0, r["byte_start"] - 200) : r["byte_start"]]):
            name = "_".join(["Java", mangled(package), mangled(r["scope_path"][-1]), mangled(r["name"])])
            rows.append(r | {"name": name, "kind": "jni", "scope_path": [package, *r["scope_path"]]})
    return rows


def go(content: bytes) -> list[Row]:
    rows = braces(GO)(content)
    src = Source.of(content, COMMENTS)
    for m in re.finditer(r'^import\s+(?:\w+\s+)?"(?P<one>[^"]+)"|^import\s*\((?P<many>[^)]*)\)', src.mask, re.M):
        for x in [(m["one"], m.start("one"))] if m["one"] else [(y[1], m.start("many") + y.start(1)) for y in re.finditer(r'"([^"]+)"', m["many"])]:
            src.add(False, x[0], "import", x[1])
    return rows + src.rows


def includes(language: Language) -> Callable[[bytes], list[Row]]:
    base = braces(language)

    def extract(content: bytes) -> list[Row]:
        src = Source.of(content)
        for m in re.finditer(r'^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', src.raw, re.M):
            src.add(False, m[1], "import", m.start(1))
        return base(content) + src.rows

    return extract


PYTHON_BLANK = r"#[^\n]*|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"


def python_lines(content: bytes) -> list[Row]:
    """Python that does not parse, as of version 2: definitions, imports and calls by line, scopes by indentation."""
    src, above = Source.of(content, PYTHON_BLANK), []
    for start, line in src.lines(masked=True):
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        above = [x for x in above if x[0] < depth]
        scope, at = [n for _, n in above], 0
        if m := re.match(rf"\s*(?:async\s+)?(def|class)\s+({WORD})", line):
            src.add(True, m[2], "class" if m[1] == "class" else "fn", start + m.start(2), scope, span=(start + depth, start + len(line)))
            above.append((depth, m[2]))
            at, scope = m.end(), [*scope, m[2]]
        elif m := re.match(r"\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+(?:\s*,\s*[\w.]+)*))", line):
            for name in re.findall(r"[\w.]+", m[1] or m[2]):
                src.add(False, name, "import", start + depth, scope)
            continue
        for m in re.compile(rf"(?<![\w$])({WORD})\(").finditer(line, at):
            if m[1] not in KEYWORDS and m[1] not in ("print", "and", "or", "not", "in", "lambda", "elif"):
                src.add(False, m[1], "call", start + m.start(1), scope)
    return src.rows


def python(content: bytes) -> list[Row]:
    src = Source.of(content)
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return [*python_lines(content), {"reason": f"{type(e).__name__}: {e}"}]

    def place(node: ast.AST, line: int, col: int) -> int:
        return src.starts[line - 1] + col

    def walk(node: ast.AST, scope: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = place(child, child.lineno, child.col_offset)
                at = src.raw.index(child.name.encode().decode("latin-1"), first)
                src.add(True, child.name.encode().decode("latin-1"), "class" if isinstance(child, ast.ClassDef) else "fn", at, scope, span=(first, place(child, child.end_lineno, child.end_col_offset)))
                inner = [*scope, child.name.encode().decode("latin-1")]
            elif isinstance(child, ast.Import | ast.ImportFrom):
                names = [a.name for a in child.names] if isinstance(child, ast.Import) else [child.module or "."]
                for name in names:
                    src.add(False, name, "import", place(child, child.lineno, child.col_offset), scope)
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                name = child.func.id if isinstance(child.func, ast.Name) else child.func.attr
                end = place(child, child.func.end_lineno, child.func.end_col_offset)
                src.add(False, name.encode().decode("latin-1"), "call", end - len(name.encode()), scope)
            walk(child, inner)

    walk(tree, [])
    return src.rows


def patterns(blank: str, *rules: tuple[str, str, bool]) -> Callable[[bytes], list[Row]]:
    """An extractor for files without scopes: (pattern, kind, whether it defines)."""

    def extract(content: bytes) -> list[Row]:
        src = Source.of(content, blank)
        mask, place = squeezed(src.mask)
        for pattern, kind, symbol in rules:
            for m in re.finditer(pattern, mask, re.M):
                src.add(symbol, m["name"], kind, place(m.start("name")), [m["scope"]] if "scope" in m.groupdict() and m["scope"] else [])
        return src.rows

    return extract


def markdown(content: bytes) -> list[Row]:
    src, fenced = Source.of(content), False
    previous = (0, "")
    for start, line in src.lines():
        if re.match(r"\s*(```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"\s{0,3}#{1,6}\s+(.*?)\s*#*\s*$", line)
        if m and m[1]:
            src.add(True, m[1], "module", start + m.start(1))
        elif not fenced and re.fullmatch(r"\s{0,3}(=+|-+)\s*", line) and previous[1].strip() and not previous[1].lstrip().startswith(("#", "-", ">")):
            src.add(True, previous[1].strip(), "module", previous[0] + len(previous[1]) - len(previous[1].lstrip()))
        previous = (start, line)
    return src.rows


def toml(content: bytes) -> list[Row]:
    src, table = Source.of(content), ""
    for start, line in src.lines():
        if m := re.match(r"\s*\[\[?\s*([^\]]+?)\s*\]\]?", line):
            table = m[1]
            src.add(True, table, "module", start + m.start(1))
        elif m := re.match(r"\s*([\w.\"'-]+)\s*=", line):
            src.add(True, m[1].strip("\"'"), "field", start + m.start(1), [table] if table else [])
    return src.rows


def yaml(content: bytes) -> list[Row]:
    src, above = Source.of(content), []
    for start, line in src.lines():
        if m := re.match(r"(\s*(?:-\s+)*)([^\s#:'\"{\[][^:#]*?|\"[^\"]+\"|'[^']+')\s*:(?:\s|$)", line):
            depth = len(m[1])
            above = [x for x in above if x[0] < depth]
            name = m[2].strip("\"'")
            src.add(True, name, "field", start + m.start(2), [n for _, n in above])
            above.append((depth, name))
    return src.rows


BP_REFS = frozenset("static_libs shared_libs header_libs whole_static_libs host_required target_required required defaults libs runtime_libs data lint_baseline srcs exclude_srcs generated_sources java_resources out tools tool_files".split())
BP_FLAGS = frozenset("cflags cppflags ldflags asflags tidy_flags ldlibs rtti stl sanitize".split())


def strings(src: Source, start: int, end: int) -> Iterator[tuple[str, int]]:
    for m in re.finditer(r'"((?:\\.|[^"\\\n])*)"|\'([^\'\n]*)\'', src.raw[start:end]):
        k = 1 if m[1] is not None else 2
        yield m[k], start + m.start(k)


def soong(content: bytes) -> list[Row]:
    src = Source.of(content, r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")
    for m in re.finditer(rf"^[ \t]*(?P<kind>{WORD})\s*\{{", src.mask, re.M):
        opening = m.end() - 1
        end = src.close(opening)
        named = re.compile(r'\bname\s*:\s*"([^"]*)"').search(src.mask, opening, end)
        name, start = (named[1], named.start(1)) if named else (f"<anon:{m['kind']}>", m.start("kind"))
        src.add(True, name, "soong", start, [m["kind"]], span=(m.start("kind"), end))
        for p in re.compile(rf"\b(?P<key>{WORD})\s*:\s*(?:\[(?P<list>[^\]]*)\]|(?P<one>\"[^\"]*\"))").finditer(src.mask, opening, end):
            kind = "import" if p["key"] in BP_REFS else "type" if p["key"] in BP_FLAGS else None
            where = "list" if p["list"] is not None else "one"
            for value, at in strings(src, p.start(where), p.end(where)) if kind else []:
                src.add(False, value, kind, at, [m["kind"], name, p["key"]])
    for m in re.finditer(rf"^(?P<name>{WORD})\s*\+?=", src.mask, re.M):
        src.add(True, m["name"], "var", m.start("name"))
    return src.rows


def build_calls(prefix: str, names: Callable[[str], bool], keys: Iterable[str], loads: Iterable[str], kwarg: bool) -> Callable[[bytes], list[Row]]:
    """Build files of calls: name(...) or name("target") { key = [...] }."""
    keys, loads = frozenset(keys), frozenset(loads)

    def extract(content: bytes) -> list[Row]:
        src = Source.of(content, r"#[^\n]*")
        at = 0
        while m := re.compile(rf"\b({WORD})[ \t]*\(").search(src.mask, at):
            if not names(m[1]):
                at = m.end()
                continue
            end = src.close(m.end() - 1, "()")
            at, inside = end, list(strings(src, m.end(), end))
            if m[1] in loads:
                for value, place in inside[:1]:
                    src.add(False, value, "import", place, [f"{prefix}:{m[1]}"])
                continue
            body = (m.end(), end)
            if kwarg:
                named = re.compile(r'\bname\s*=\s*["\']([^"\']+)').search(src.mask, *body)
                target = (named[1], named.start(1)) if named else None
            else:
                target = inside[0] if inside else None
                if block := re.compile(r"\s*\{").match(src.mask, end):
                    at = src.close(block.end() - 1)
                    body = (block.end(), at)
            if target:
                src.add(True, target[0], "soong", target[1], [f"{prefix}:{m[1]}"], span=(m.start(), at))
            owner = target[0] if target else f"<anon:{m[1]}>"
            for p in re.compile(rf"\b({WORD})\s*\+?=\s*\[([^\]]*)\]").finditer(src.mask, *body):
                for value, place in strings(src, p.start(2), p.end(2)) if p[1] in keys else []:
                    src.add(False, value, "import", place, [f"{prefix}:{m[1]}", owner, p[1]])
        return src.rows

    return extract


def cmake(content: bytes) -> list[Row]:
    src = Source.of(content, r"#[^\n]*")
    for m in re.finditer(rf"^[ \t]*({WORD})\s*\(([^)]*)\)", src.mask, re.M):
        command = m[1].lower()
        args = [(a[0].strip('"'), m.start(2) + a.start()) for a in re.finditer(r'"[^"]*"|[^\s"]+', m[2])]
        if not args:
            continue
        if command in ("add_library", "add_executable", "add_custom_target", "add_test"):
            src.add(True, args[0][0], "soong", args[0][1], [f"cmake:{command}"])
        elif command in ("target_link_libraries", "target_include_directories", "target_sources"):
            for value, at in args[1:]:
                if value not in ("PRIVATE", "PUBLIC", "INTERFACE", "SYSTEM", "BEFORE"):
                    src.add(False, value, "import", at, [f"cmake:{command}", args[0][0]])
        elif command in ("find_package", "find_library", "find_path", "include", "add_subdirectory"):
            src.add(False, args[0][0], "import", args[0][1], [f"cmake:{command}"])
    return src.rows


def interfaces(hidl: bool) -> Callable[[bytes], list[Row]]:
    """AIDL and HIDL files, with the names of the bindings that are generated for an interface."""
    kinds = {"interface": "iface", "enum": "enum", "union": "union", "struct": "struct"} if hidl else {"interface": "aidl.iface", "parcelable": "aidl.parcel", "enum": "enum", "union": "union"}
    method = "method" if hidl else "aidl.method"
    # Names of generated bindings for an interface.
    shadows = ("Bp{}", "Bn{}", "Bs{}") if hidl else ("{}.Stub", "{}.Stub.Proxy", "Bp{}", "Bn{}", "{}", "{}AsyncServer")

    def extract(content: bytes) -> list[Row]:
        src = Source.of(content, C_BLANK)
        package = re.search(r"^[ \t]*package\s+([\w.@]+)\s*;", src.mask, re.M)
        outer = [package[1]] if package else []
        for m in re.finditer(r"^[ \t]*import\s+([\w.@:]+)\s*;", src.mask, re.M):
            src.add(False, m[1], "import", m.start(1), outer)
        for m in re.finditer(rf"\b({'|'.join(kinds)})\s+({WORD})(?:\s+extends\s+([\w.@:]+))?[^;{{}}]*([{{;])", src.mask):
            end = src.close(m.end() - 1) if m[4] == "{" else m.end()
            src.add(True, m[2], kinds[m[1]], m.start(2), outer, span=(m.start(), end))
            if m[3]:
                src.add(False, m[3], "inherit", m.start(3), [*outer, m[2]])
            if m[1] == "interface":
                for p in re.compile(rf"(?<![\w.@])({WORD})\s*\([^;{{}}]*\)[^;{{}}]*;").finditer(src.mask, m.end(), end):
                    if p[1] not in KEYWORDS and p[1] not in ("generates", "oneway"):
                        src.add(True, p[1], method, p.start(1), [*outer, m[2]])
                for shape in shadows:
                    src.add(True, shape.format(m[2]), "hidl.shadow" if hidl else "aidl.shadow", m.start(2), outer)
        for m in re.finditer(rf"\btypedef\s+[^;]*?({WORD})\s*;", src.mask) if hidl else ():
            src.add(True, m[1], "type", m.start(1), outer)
        return src.rows

    return extract


def owners(content: bytes) -> list[Row]:
    src = Source.of(content, r"#[^\n]*")
    for start, line in src.lines(masked=True):
        body, at = line.strip(), start + len(line) - len(line.lstrip())
        if not body or body.lower() in ("set noparent", "noparent"):
            continue
        if body.startswith("include "):
            src.add(False, body[8:].strip(), "import", at, ["OWNERS"])
        elif m := re.match(r"per-file\s+([^=]+?)\s*=\s*(.*)", body):
            for value in filter(None, map(str.strip, m[2].split(","))):
                src.add(True, value, "owner", at, ["per-file", m[1]])
        elif not body.startswith("per-file"):
            src.add(True, body, "owner", at)
    return src.rows


def aconfig(content: bytes) -> list[Row]:
    src = Source.of(content, r"^\s*#[^\n]*|//[^\n]*")
    package = re.search(r'\bpackage\s*:\s*"([^"]*)"', src.mask)
    for m in re.finditer(r"\bflag\s*\{", src.mask):
        end = src.close(m.end() - 1)
        if named := re.compile(r'\bname\s*:\s*"([^"]+)"').search(src.mask, m.end(), end):
            src.add(True, named[1], "aconfig", named.start(1), [package[1]] if package else [], span=(m.start(), end))
    return src.rows


def init_rc(content: bytes) -> list[Row]:
    src, block = Source.of(content), []
    for start, line in src.lines():
        words = [(w[0], start + w.start()) for w in re.finditer(r"\S+", line)]
        if not words or words[0][0].startswith("#"):
            continue
        if not line[0].isspace():
            block = []
            if words[0][0] == "service" and len(words) > 1:
                src.add(True, words[1][0], "init.svc", words[1][1], ["service", *(w for w, _ in words[2:3])])
                block = ["service", words[1][0]]
            elif words[0][0] == "on":
                block = ["on", line[2:].strip()]
        elif words[0][0] in ("start", "stop", "restart") and len(words) > 1:
            src.add(False, words[1][0], "call", words[1][1], block)
    return src.rows


def sepolicy(content: bytes) -> list[Row]:
    src = Source.of(content, r"#[^\n]*")
    for start, line in src.lines(masked=True):
        words = [(w[0], start + w.start()) for w in re.finditer(r"[^\s,:;]+", line)]
        verb = words[0][0] if words else ""
        if verb in ("type", "attribute") and len(words) > 1:
            src.add(True, words[1][0], "sepolicy", words[1][1], ["attribute"] if verb == "attribute" else [])
        elif verb in ("allow", "neverallow", "auditallow", "dontaudit"):
            for (word, at), role in zip(words[1:3], ("subject", "target"), strict=False):
                src.add(False, word, "call", at, [verb, role])
    return src.rows


def manifest(content: bytes) -> list[Row]:
    src = Source.of(content, r"<!--[\s\S]*?(?:-->|\Z)")
    package = ""
    for m in re.finditer(r"<(?:\w+:)?([\w-]+)((?:\s+[\w:]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)", src.mask):
        found = {k: v[1:-1] for k, v in re.findall(r"([\w:]+)\s*=\s*(\"[^\"]*\"|'[^']*')", m[2])}
        if m[1] == "manifest":
            package = found.get("package", "")
        elif m[1] in ("activity", "service", "receiver", "provider", "application", "uses-permission", "permission") and (name := found.get("android:name") or found.get("name")):
            name = package + name if name.startswith(".") else name
            src.add(True, name, "manifest", m.start(), [m[1]])
            src.add(False, name, "inherit", m.start(), [m[1]])
    return src.rows


def api_text(content: bytes) -> list[Row]:
    src, scope = Source.of(content), []
    members = {"ctor": "ctor", "method": "method", "field": "field", "enum_constant": "variant", "property": "field"}
    kinds = {"class": "class", "record": "class", "interface": "iface", "enum": "enum", "@interface": "annot", "annotation": "annot"}
    for start, line in src.lines():
        body = re.sub(r"@(?!interface)[\w.]+(?:\([^)]*\))?\s*", "", line).strip()
        if body == "}":
            scope = scope[:-1]
        elif m := re.match(r"package\s+([\w.]+)\s*\{", body):
            scope = [*scope, m[1]]
        elif m := re.match(r"(?:[\w-]+\s+)*?(class|record|interface|enum|@interface|annotation)\s+([\w.<>,? ]+?)(?:\s+extends\s+([\w.<>,? ]+?))?(?:\s+implements\s+[^{]*)?\s*\{", body):
            name = m[2].split("<")[0].strip()
            src.add(True, name, kinds[m[1]], start, scope)
            for base in re.findall(r"[\w.]+", re.sub(r"<[^>]*>", "", m[3] or "")):
                src.add(False, base, "inherit", start, ["::".join(scope), name])
            scope = [*scope, name]
        elif (m := re.match(r"(ctor|method|field|enum_constant|property)\s+([^;]*)", body)) and (name := re.search(r"([\w$]+)\s*(?:\(|=|$)", m[2])):
            src.add(True, name[1], members[m[1]], start, scope)
    return src.rows


SHELL = patterns(HASH_BLANK, (rf"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\s*\)", "fn", True), (r"^\s*function\s+(?P<name>[\w-]+)", "fn", True), (rf"^\s*(?:export\s+|local\s+|readonly\s+)?(?P<name>{WORD})=", "var", True))
HTML = patterns(r"<!--[\s\S]*?(?:-->|\Z)", (r"\s(?:id|class|name)\s*=\s*[\"'](?P<name>[^\"']+)[\"']", "xml.id", True))
CSS = patterns(r"/\*[\s\S]*?(?:\*/|\Z)|\{[^{}]*\}", (r"\.(?P<name>[A-Za-z_][\w-]*)", "class", True), (r"#(?P<name>[A-Za-z_][\w-]*)", "xml.id", True), (r"@keyframes\s+(?P<name>[\w-]+)", "fn", True))
SCSS = patterns(r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*", (r"^\s*&?\.(?P<name>[A-Za-z_][\w-]*)", "class", True), (r"^\s*#(?P<name>[A-Za-z_][\w-]*)", "xml.id", True), (r"@mixin\s+(?P<name>[\w-]+)", "fn", True), (r"@function\s+(?P<name>[\w-]+)", "fn", True))
BAZEL = build_calls("bazel", lambda n: n not in ("glob", "select", "package", "exports_files", "licenses", "len", "print"), "deps srcs hdrs data exports tools exec_tools".split(), ["load"], True)
GN = build_calls("gn", lambda n: n not in ("if", "foreach", "assert", "defined", "print", "get_label_info", "rebase_path"), "sources deps public_deps data_deps configs include_dirs libs inputs outputs public".split(), ["import"], False)

EXTRACTORS: dict[str, Callable[[bytes], list[Row]]] = {
    "Java": java, "Kotlin": braces(KOTLIN), "C": includes(C), "Cpp": includes(CPP), "Header": includes(CPP), "HeaderCpp": includes(CPP), "Rust": braces(RUST), "Go": go, "Python": python,
    "Bash": SHELL, "TypeScript": braces(TYPESCRIPT), "Proto": braces(PROTO), "Html": HTML, "Css": CSS, "Scss": SCSS, "Markdown": markdown, "Toml": toml, "Yaml": yaml, "Soong": soong,
    "Aidl": interfaces(False), "Hidl": interfaces(True), "Owners": owners, "Aconfig": aconfig, "InitRc": init_rc, "Sepolicy": sepolicy, "Manifest": manifest, "ApiTxt": api_text,
    "Bazel": BAZEL, "Bzl": BAZEL, "CMake": cmake, "Gn": GN,
}


def extract(lang: str, path: str, content: bytes) -> list[Row]:
    """The rows of one file; none for kinds without an extractor. Frozen AIDL files have frozen interfaces."""
    rows = EXTRACTORS[lang](content) if lang in EXTRACTORS else []
    if lang == "Aidl" and re.search(r"(^|/)aidl_api/", path):
        rows = [r | {"kind": "aidl.frozen"} if r["kind"] == "aidl.iface" else r for r in rows]
    return rows


def cargo_modules(content: bytes) -> dict:
    """Members of a Cargo workspace, or the name and path dependencies of a crate."""
    data = tomllib.loads(content.decode("utf-8", "replace"))
    paths = {k: v["path"] for part in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in data.get(part, {}).items() if isinstance(v, dict) and "path" in v}
    return {"members": data.get("workspace", {}).get("members", []), "name": data.get("package", {}).get("name"), "paths": paths}


@contextmanager
def within(seconds: float) -> Iterator[None]:
    """TimeoutError if the block takes longer; for the main thread, where Python workers run."""

    def stop(*_) -> None:
        raise TimeoutError(f"took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


EXTRACTED = "file_id long, path string, lang string, symbol boolean, name string, kind string, byte_start int, byte_end int, span_start int, span_end int, line int, col int, scope_path array<string>, reason string"


def extracted(files: DataFrame, seconds: float = 60.0) -> DataFrame:
    """A row for each definition and use in files (file_id, path, lang, content).

    A file that fails or takes more than so many seconds gives one row with a reason; Python
    that does not parse gives that row and what its lines tell.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["symbol", "name", "kind", "byte_start", "byte_end", "span_start", "span_end", "line", "col", "scope_path", "reason"]
        kinds = [pa.bool_(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.list_(pa.string()), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with within(seconds):
                        rows = extract(row["lang"], row["path"], row["content"] or b"")
                except Exception as e:  # MemoryError and RecursionError too: the file costs its rows, not the task
                    rows = [{"reason": f"{type(e).__name__}: {e}"}]
                if rows:
                    own = [pa.array([row[k]] * len(rows), t) for k, t in (("file_id", pa.int64()), ("path", pa.string()), ("lang", pa.string()))]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array([r.get(k) for r in rows], t) for k, t in zip(columns, kinds, strict=True))], ["file_id", "path", "lang", *columns])

    return files.select("file_id", "path", "lang", F.col("content")).mapInArrow(run, EXTRACTED)
