"""Symbols of source files: Python by its own parser, brace languages by a scanner over masked text.

The scanner blanks comments and strings, finds definitions by patterns, matches brackets for their extent,
and nests them by extent for containers. It is an approximation of a grammar; unit tests say what it gets.
"""

from __future__ import annotations

import ast
import bisect
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph import model

MOST_REFS, MOST_CALLS, MOST_LOCALS, MOST_PARAMS = 200, 100, 100, 50
SIGNATURE_MAX, DOC_MAX, TYPE_MAX = 240, 400, 80
WORD = r"[^\W\d]\w*"

SYMBOL = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("symbol_kind", T.StringType()), T.StructField("container", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()),
    T.StructField("signature", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("locals", T.ArrayType(T.StringType())),
    T.StructField("calls", T.ArrayType(T.StringType())), T.StructField("params", T.ArrayType(model.PARAM)), T.StructField("returns", model.TYPE),
])


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    start_line: int
    end_line: int
    signature: str = ""
    doc: str | None = None
    container: str | None = None
    refs: list[str] = field(default_factory=list)
    locals: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)
    params: list[tuple[str, tuple[str, bool] | None]] = field(default_factory=list)
    returns: tuple[str, bool] | None = None

    def row(self) -> tuple:
        params = [{"name": n, "ty": {"ty": t[0], "inferred": t[1]} if t else None} for n, t in self.params]
        returns = {"ty": self.returns[0], "inferred": self.returns[1]} if self.returns else None
        return (self.name, self.kind, self.container, self.start_line, self.end_line, self.signature, self.doc, self.refs, self.locals, self.calls, params, returns)


def squeeze(text: str, most: int) -> str:
    one = " ".join(text.split())
    return one if len(one) <= most else one[:most] + "…"


def capped(names, most: int, own: str | None = None) -> list[str]:
    """The first distinct names, sorted; the symbol's own name doesn't count."""
    found = dict.fromkeys(n for n in names if n and n != own)
    return sorted(list(found)[:most])


# Python


def _python_type(e: ast.expr | None) -> tuple[str, bool] | None:
    """A type told by the look of an expression: literals and constructor calls."""
    if isinstance(e, ast.Constant):
        name = {bool: "bool", int: "int", float: "float", str: "string"}.get(type(e.value))
        return (name, True) if name else None
    if isinstance(e, (ast.List, ast.ListComp)):
        return ("array", True) if isinstance(e, ast.List) else None
    if isinstance(e, ast.Dict):
        return "map", True
    if isinstance(e, ast.Set):
        return "set", True
    if isinstance(e, ast.Tuple):
        return "tuple", True
    if isinstance(e, ast.JoinedStr):
        return "string", True
    if isinstance(e, ast.Call):
        parts = _dotted(e.func)
        if len(parts) == 1 and parts[0][:1].isupper():
            return parts[0], True
        if len(parts) > 1 and parts[-1] in ("new", "create", "from", "default", "with_capacity", "of", "make"):
            return next(((p, True) for p in reversed(parts[:-1]) if p[:1].isupper()), None)
    return None


def _dotted(e: ast.expr) -> list[str]:
    if isinstance(e, ast.Name):
        return [e.id]
    if isinstance(e, ast.Attribute):
        return [*_dotted(e.value), e.attr]
    return []


def _targets(e: ast.expr) -> list[str]:
    if isinstance(e, ast.Name):
        return [e.id]
    if isinstance(e, (ast.Tuple, ast.List)):
        return [n for x in e.elts for n in _targets(x)]
    if isinstance(e, ast.Starred):
        return _targets(e.value)
    return []


DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def python_symbols(source: str) -> list[Symbol]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return indented_symbols(source)
    lines = source.splitlines()
    out: list[Symbol] = []

    def inside(node: ast.AST):
        """What belongs to a scope: not the bodies of definitions in it."""
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, DEFS):
                yield child
                yield from inside(child)

    def visit(node: ast.AST, container: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, DEFS):
                out.append(symbol(child, container))
                visit(child, child.name if isinstance(child, ast.ClassDef) else container)
            else:
                visit(child, container)

    def symbol(d, container: str | None) -> Symbol:
        first, end = d.lineno - 1, d.body[0].lineno - 1
        head = "\n".join(lines[first : end + 1] if end == first else lines[first:end])
        if end == first:
            head = head[: d.body[0].col_offset]
        sig = squeeze(re.sub(r"\s*#.*", "", head) if "#" in head else head, SIGNATURE_MAX)
        doc = ast.get_docstring(d, clean=False)
        s = Symbol(d.name, "class" if isinstance(d, ast.ClassDef) else "fn", 0, 0, d.lineno, d.end_lineno or d.lineno, sig, squeeze(doc, DOC_MAX) if doc is not None else None, container)
        names = [n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else n.arg if isinstance(n, ast.arg) else n.name if isinstance(n, DEFS) else None for n in ast.walk(d)]
        s.refs = capped(names, MOST_REFS, d.name)
        s.calls = capped((p[-1] for n in ast.walk(d) if isinstance(n, ast.Call) and (p := _dotted(n.func) or ([n.func.attr] if isinstance(n.func, ast.Attribute) else []))), MOST_CALLS, d.name)
        if isinstance(d, ast.ClassDef):
            return s
        a = d.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        defaults = dict(zip([x.arg for x in [*a.posonlyargs, *a.args]][-len(a.defaults) :], a.defaults)) if a.defaults else {}
        defaults |= {x.arg: v for x, v in zip(a.kwonlyargs, a.kw_defaults) if v is not None}
        for p in every[:MOST_PARAMS]:
            s.params.append((p.arg, (squeeze(ast.unparse(p.annotation), TYPE_MAX), False) if p.annotation else _python_type(defaults.get(p.arg))))
        bound = [x.arg for x in every]
        for n in inside(d):
            for t in getattr(n, "targets", []) or [t for t in (getattr(n, "target", None), getattr(n, "optional_vars", None)) if t is not None]:
                bound += _targets(t)
        s.locals = capped(bound, MOST_LOCALS)
        if d.returns is not None:
            s.returns = (squeeze(ast.unparse(d.returns), TYPE_MAX), False)
        else:
            told = {t[0] for n in inside(d) if isinstance(n, ast.Return) and (t := _python_type(n.value))}
            s.returns = (told.pop(), True) if len(told) == 1 else None
        return s

    visit(tree, None)
    return out


HEAD = re.compile(rf"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+({WORD})")
KEYWORDS = frozenset("and as assert async await break class continue def del elif else except exec finally for from global if import in is lambda nonlocal not or pass print raise return try while with yield".split())


def indented_symbols(source: str) -> list[Symbol]:
    """Definitions of Python sources that don't parse, such as older dialects and templates, by indentation:
    one ends before the next line that isn't indented deeper than its head."""
    source = source.expandtabs(8)
    text = re.sub(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*', lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    lines = text.split("\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    out: list[Symbol] = []
    open_: list[tuple[int, Symbol, int]] = []  # indent, symbol, line after its head

    def end(symbol: Symbol, first: int, after: int) -> None:
        """Takes what the finished definition holds from its lines."""
        last = after
        while last > symbol.start_line and not lines[last - 1].strip():
            last -= 1
        symbol.end_line = last
        body = text[at[first] : at[last]]
        symbol.refs = capped((w for w in re.findall(WORD, text[at[symbol.start_line - 1] : at[last]]) if w not in KEYWORDS), MOST_REFS, symbol.name)
        symbol.calls = capped((w for w in re.findall(rf"({WORD})\s*\(", body) if w not in KEYWORDS), MOST_CALLS, symbol.name)
        quoted = re.match(r"""\s*[rbuRBU]*(?:\"{3}([\s\S]*?)\"{3}|'{3}([\s\S]*?)'{3}|"([^"\n]*)"|'([^'\n]*)')""", source[at[first] : at[last]])
        if quoted:
            symbol.doc = squeeze(next(x for x in quoted.groups() if x is not None), DOC_MAX)
        if symbol.kind == "fn":
            bound = re.findall(rf"^[ ]*({WORD})[ ]*=(?!=)", body, re.M) + re.findall(rf"\bfor[ ]+({WORD})[ ]+in\b", body)
            symbol.locals = capped([n for n, _ in symbol.params] + bound, MOST_LOCALS)

    skip_to = 0
    for i, line in enumerate(lines):
        if i < skip_to or not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            _, symbol, first = open_.pop()
            end(symbol, first, i)
        m = HEAD.match(line)
        if not m:
            continue
        stop = close(text, at[i] + m.end() - 1) if text[at[i] + m.end() :].lstrip(" ")[:1] == "(" else at[i] + m.end()
        colon = text.find(":", stop, at[i] + len(line) + 1) if stop <= at[i + 1] else text.find(":", stop)
        skip_to = text.count("\n", 0, colon if colon >= 0 else at[i]) + 1
        head = squeeze(source[at[i] + indent : colon + 1 if colon >= 0 else at[i + 1]], SIGNATURE_MAX)
        container = next((x.name for _, x, _ in reversed(open_) if x.kind == "class"), None)
        symbol = Symbol(m[3], "class" if m[2] == "class" else "fn", 0, 0, i + 1, i + 1, head, container=container)
        if symbol.kind == "fn" and "(" in head:
            inner = head[head.index("(") + 1 : head.rindex(")") if ")" in head else len(head)]
            for part in _split(inner)[:MOST_PARAMS]:
                name, _, default = part.partition("=")
                name, _, kind = name.partition(":")
                found = re.search(WORD, name)
                if found:
                    symbol.params.append((found[0], (squeeze(kind, TYPE_MAX), False) if kind.strip() else _literal(default) if default else None))
        out.append(symbol)
        open_.append((indent, symbol, max(skip_to, i + 1)))
    while open_:
        _, symbol, first = open_.pop()
        end(symbol, min(first, len(lines)), len(lines))
    return out


# Brace languages


def mask(source: str, lang: str) -> str:
    """source with comments and the insides of strings blanked, at equal length."""
    quotes = "\"" if lang in ("rust", "java", "kotlin", "c", "cpp", "csharp") else "\"'`"
    char = r"|'(?:\\.[^']{0,8}|[^\\'\n])'" if "'" not in quotes else ""
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes)
    pattern = re.compile(rf'//[^\n]*|/\*.*?\*/|"""(?:.*?)"""|{strings}{char}', re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|inline|export|default|extern|const|unsafe|data|suspend|partial|readonly|synchronized|explicit|constexpr|friend|declare)\s+)*"
VIS = r"(?:pub(?:\([^)]*\))?\s+)?"
NOT_NAMES = frozenset("if for while switch catch return sizeof else do new throw using when synchronized lock foreach fixed function await typeof delete case in of match".split())

#: Words that may name a method all the same.
NOT_METHODS = NOT_NAMES - {"of", "match", "when", "lock", "case", "delete"}

# (kind, pattern with group name): tried in order over the masked text.
PATTERNS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("fn", rf"{VIS}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+(?P<name>{WORD})"), ("struct", rf"{VIS}struct\s+(?P<name>{WORD})"), ("enum", rf"{VIS}enum\s+(?P<name>{WORD})"),
        ("trait", rf"{VIS}(?:unsafe\s+)?trait\s+(?P<name>{WORD})"), ("type", rf"{VIS}type\s+(?P<name>{WORD})\s*(?:<[^>]*>)?\s*="), ("const", rf"{VIS}const\s+(?P<name>{WORD})\s*:"),
        ("static", rf"{VIS}static\s+(?:mut\s+)?(?P<name>{WORD})\s*:"), ("union", rf"{VIS}union\s+(?P<name>{WORD})\s*[<{{]"), ("macro", rf"macro_rules!\s*(?P<name>{WORD})"),
    ],
    "js": [
        ("fn", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{WORD})"), ("class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{WORD})"),
        ("interface", rf"(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>{WORD})"), ("enum", rf"(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(?P<name>{WORD})"), ("type", rf"(?:export\s+)?(?:declare\s+)?type\s+(?P<name>{WORD})\s*(?:<[^>]*>)?\s*="),
        ("fn", rf"(?:export\s+)?(?:const|let|var)\s+(?P<name>{WORD})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|(?:\([^()]*\)|{WORD})\s*(?::[^=\n{{]+)?=>)"),
    ],
    "kotlin": [("fn", rf"{MODS}fun\s+(?:<[^>]*>\s*)?(?:{WORD}(?:<[^>()]*>)?\??\.)?(?P<name>{WORD})\s*\("), ("interface", rf"{MODS}interface\s+(?P<name>{WORD})"), ("class", rf"{MODS}(?:enum\s+|annotation\s+)?class\s+(?P<name>{WORD})"), ("object", rf"{MODS}object\s+(?P<name>{WORD})")],
    "java": [("class", rf"{MODS}class\s+(?P<name>{WORD})"), ("interface", rf"{MODS}@?interface\s+(?P<name>{WORD})"), ("enum", rf"{MODS}enum\s+(?P<name>{WORD})"), ("record", rf"{MODS}record\s+(?P<name>{WORD})\s*[(<]")],
    "csharp": [
        ("namespace", rf"namespace\s+(?P<name>[\w.]+)"), ("class", rf"{MODS}class\s+(?P<name>{WORD})"), ("interface", rf"{MODS}interface\s+(?P<name>{WORD})"), ("enum", rf"{MODS}enum\s+(?P<name>{WORD})"), ("struct", rf"{MODS}struct\s+(?P<name>{WORD})"),
        ("record", rf"{MODS}record\s+(?P<name>{WORD})"),
    ],
    "c": [("struct", rf"struct\s+(?P<name>{WORD})\s*(?=\{{)"), ("union", rf"union\s+(?P<name>{WORD})\s*(?=\{{)"), ("enum", rf"enum\s+(?:class\s+)?(?P<name>{WORD})\s*(?:\:\s*[\w:]+\s*)?(?=\{{)")],
    "cpp": [("namespace", rf"namespace\s+(?P<name>[\w:]+)\s*(?=\{{)"), ("class", rf"(?<!enum )class\s+(?P<name>{WORD})\s*(?:final\s*)?(?=[:{{])"), ("struct", rf"(?<!enum )struct\s+(?P<name>{WORD})\s*(?:final\s*)?(?=[:{{])"), ("union", rf"union\s+(?P<name>{WORD})\s*(?=\{{)"), ("enum", rf"enum\s+(?:class\s+)?(?P<name>{WORD})\s*(?:\:\s*[\w:]+\s*)?(?=\{{)")],
}
TYPED_FN = rf"(?P<type>(?:[\w:<>\[\],.&*?~]+\s+)*?[\w:<>\[\],.&*?]+[\s&*]+)(?P<name>~?{WORD})\s*\("
DECLARES = {"rust": rf"\blet\s+(?:mut\s+)?\(?\s*(?:mut\s+)?({WORD}(?:\s*,\s*(?:mut\s+)?{WORD})*)", "js": rf"\b(?:const|let|var)\s+[\[{{]?\s*({WORD}(?:\s*,\s*{WORD})*)", "kotlin": rf"\b(?:val|var)\s+\(?({WORD}(?:\s*,\s*{WORD})*)", "java": rf"(?:^|[;{{(])\s*(?:final\s+)?[\w<>\[\],.]+\s+({WORD})\s*(?==[^=]|;|:)"}
CONTAINERS = {"rust": {"struct", "enum", "trait", "union"}, "js": {"class", "interface"}, "kotlin": {"class", "object", "interface"}, "java": {"class", "interface", "enum", "record"}, "csharp": {"class", "interface", "struct", "record", "namespace"}, "c": {"struct", "union"}, "cpp": {"class", "struct", "union", "namespace"}}
DOC_MARKS = {"rust": ("///", "//!", "/**"), "js": ("/**",), "kotlin": ("/**",), "java": ("/**",), "csharp": ("///", "/**"), "c": ("/**", "///", "//!"), "cpp": ("/**", "///", "//!")}
FAMILY = {"javascript": "js", "typescript": "js", "tsx": "js"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


def close(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; the end if none does."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += 1 if m[0] in PAIRS else -1
        if depth == 0:
            return m.end()
    return len(text)


def _extent(text: str, at: int, arrow: bool) -> tuple[int, int]:
    """(start of the body or end, end) of a definition whose head starts at ``at``."""
    i = at
    while i < len(text):
        c = text[i]
        if c == "{":
            return i, close(text, i)
        if c in "([":
            i = close(text, i)
            continue
        if c in ";}":
            return i, i + (c == ";")
        if c == "=" and arrow:
            line = text.find("\n", i)
            brace = re.compile(r"=>?\s*\{").match(text, i)
            stop = close(text, brace.end() - 1) if brace else (line if line >= 0 else len(text))
            return i, stop
        if c == "\n" and arrow:
            return i, i
        i += 1
    return len(text), len(text)


def _doc(source: str, start: int, marks: tuple[str, ...]) -> str | None:
    chunks: list[str] = []
    before = source[:start].rstrip(" \t")
    while True:
        before = before.rstrip()
        last = before.rsplit("\n", 1)[-1].strip()
        if before.endswith("*/") and (at := before.rfind("/*")) >= 0:
            if not before[at:].startswith(marks):
                break
            chunks.append(before[at:])
            before = before[:at]
        elif last.startswith("//"):
            if not last.startswith(marks):
                break
            chunks.append(last)
            before = before[: len(before) - len(last)]
        elif last.startswith(("#[", "@", "[")) and last.endswith(("]", ")")) or re.fullmatch(r"@[\w.]+", last):
            before = before[: len(before) - len(last)]
        else:
            break
    lines = [re.sub(r"^(?:/\*\*)*(?:///)*(?://!)*(?://)*\**|(?:\*/)+$", "", x.strip()) for c in reversed(chunks) for x in c.splitlines()]
    cleaned = " ".join(re.sub(r"(?:\*/)+$", "", x.strip()).strip() for x in lines if x.strip())
    return squeeze(cleaned, DOC_MAX) if chunks else None


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}" or c == ">" and text[i - 1 : i] not in ("-", "="))
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [x.strip() for x in [*out, text[at:]] if x.strip()]


def _literal(value: str) -> tuple[str, bool] | None:
    v = value.strip().rstrip(";")
    for name, pattern in (("bool", r"true|false|True|False"), ("int", r"-?\d[\d_]*"), ("float", r"-?\d+\.\d+f?"), ("string", r"""["'`].*["'`]""")):
        if re.fullmatch(pattern, v, re.S):
            return name, True
    m = re.match(rf"(?:new\s+)?({WORD})(?:::\w+|\.\w+)?\s*[({{]", v)
    return (m[1], True) if m and m[1][:1].isupper() else None


def _params(inner: str, lang: str) -> list[tuple[str, tuple[str, bool] | None]]:
    out: list[tuple[str, tuple[str, bool] | None]] = []
    for p in _split(inner):
        if re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self|this|void|\.\.\.", p):
            continue
        head, _, default = p.partition("=")
        if lang in ("rust", "kotlin", "js"):
            name, _, kind = head.partition(":")
            names = [n for n in re.findall(WORD, name) if n not in ("mut", "ref", "val", "var", "vararg", "public", "private", "readonly")]
        else:
            words = re.findall(WORD, re.sub(r"\[[^\]]*\]$", "", head.strip()))
            names = words[-1:] if len(words) > 1 else []
            kind = re.sub(rf"\b{re.escape(names[0])}\b\s*$", "", head.strip()) if names else ""
        ty = (squeeze(kind, TYPE_MAX), False) if kind.strip() else _literal(default) if default else None
        out += [(n, ty) for n in sorted(set(names))]
    return out[:MOST_PARAMS]


def brace_symbols(source: str, tag: str) -> list[Symbol]:
    lang = FAMILY.get(tag, tag)
    text = mask(source, lang)
    line_at = [0] + [m.end() for m in re.finditer("\n", text)]

    def line_of(at: int) -> int:
        return bisect.bisect_right(line_at, at)

    found: dict[int, tuple[str, str, int, int, int]] = {}
    for kind, pattern in PATTERNS[lang]:
        for m in re.finditer(rf"(?<![\w.]){pattern}", text):
            if m.start("name") in found:
                continue
            arrow = kind == "fn" and lang in ("js", "kotlin") or lang == "kotlin"
            start = m.end() - (1 if m[0].endswith(("(", "{", "=", "<", ":")) else 0)
            if lang == "js" and kind == "fn" and "=" in m[0]:
                arrow_at = text.find("=>", m.start("name"), m.end())
                body = re.compile(r"\s*\{").match(text, m.end())
                stop = close(text, body.end() - 1) if body else next((i for i in (text.find(";", m.end()), text.find("\n", m.end())) if i >= 0), len(text))
                if arrow_at < 0:
                    body_at = text.find("{", m.end())
                    stop = close(text, body_at) if body_at >= 0 else stop
                found[m.start("name")] = (m["name"], kind, m.start(), m.end(), stop)
                continue
            body, end = _extent(text, start, arrow)
            found[m.start("name")] = (m["name"], kind, m.start(), body, end)
    if lang in ("java", "csharp", "c", "cpp"):
        for m in re.finditer(TYPED_FN, text):
            words = re.findall(WORD, m["type"])
            if m["name"] in NOT_NAMES or not words or words[0] in NOT_NAMES or m.start("name") in found:
                continue
            after = close(text, m.end() - 1)
            body, end = _extent(text, after, False)
            if text[after:body].strip() and not re.fullmatch(r"\s*(?:const|noexcept|override|final|throws\s+[\w.,\s]+|where\s.*|:.*|=>?.*|->.*)\s*", text[after:body], re.S):
                continue
            if text[body : body + 1] != "{" and lang in ("c", "cpp"):
                continue
            found[m.start("name")] = (m["name"], "method" if lang in ("java", "csharp") else "fn", m.start("type"), body, end)
        classes = {n for n, k, *_ in found.values() if k in ("class", "struct", "record", "enum")}
        for m in re.finditer(rf"(?<![\w.])(?:(?:public|private|protected|internal)\s+)?(?P<name>{WORD})\s*\(", text) if lang in ("java", "csharp") else ():
            if m["name"] in classes and m.start("name") not in found and not re.search(r"\bnew\s+$", text[max(0, m.start() - 24) : m.start()]):
                after = close(text, m.end() - 1)
                body, end = _extent(text, after, False)
                if text[body : body + 1] == "{":
                    found[m.start("name")] = (m["name"], "constructor", m.start(), body, end)
    impls = [(m.start(), close(text, b), m[1]) for m in re.finditer(r"(?<!\w)impl\b(?:\s*<[^{;]*?>)?\s*(?:[\w:<>, ']+\s+for\s+)?([^{;]+?)\s*(?:where[^{]*)?\{", text) if (b := m.end() - 1) >= 0] if lang == "rust" else []
    if lang == "js":
        for at, (cls, kind, start, body, end) in list(found.items()):
            if kind == "class":
                for m in re.finditer(rf"(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*\*?(?P<name>#?{WORD})\s*\(", text[body:end]):
                    place = body + m.start("name")
                    after = close(text, body + m.end() - 1)
                    typed = re.compile(r"\s*(?::[^{;=]+)?\{").match(text, after)
                    if m["name"] not in NOT_METHODS and typed and text[body + 1 : place].count("{") == text[body + 1 : place].count("}") and place not in found:
                        found[place] = (m["name"], "method", body + m.start(), typed.end() - 1, close(text, typed.end() - 1))
    out: list[Symbol] = []
    ordered = sorted(found.items(), key=lambda x: (x[1][2], -x[1][4], x[0]))
    # what holds a definition is open when it starts: one pass with a stack, implementation blocks included
    scopes = sorted([(start, end, at, kind in CONTAINERS[lang], name) for at, (name, kind, start, _, end) in ordered] + [(a, b, -1, True, f"impl {n.strip()}") for a, b, n in impls], key=lambda x: (x[0], -x[1], x[2]))
    holder: dict[int, str] = {}
    open_: list[tuple[int, int, str]] = []
    for start, end, at, holds, name in scopes:
        while open_ and open_[-1][1] <= start:
            open_.pop()
        if at >= 0:
            holder[at] = next((n for a, b, n in reversed(open_) if end <= b and (a, b) != (start, end)), None)
        if holds:
            open_.append((start, end, name))
    for place, (at, (name, kind, start, body, end)) in enumerate(ordered):
        sig = squeeze(source[start:body], 10**9).rstrip("{( ").rstrip()
        s = Symbol(name, kind, start, end, line_of(start), line_of(max(start, end - 1)), squeeze(sig, SIGNATURE_MAX), _doc(source, start, DOC_MARKS[lang]))
        s.container = holder[at]
        pieces, seen, later = [], start, place + 1
        while later < len(ordered) and ordered[later][1][2] < end:  # blank the definitions inside this one
            _, (_, _, a, _, b) = ordered[later]
            if start < a and seen <= a and b <= end:
                pieces += [text[seen:a], " " * (b - a)]
                seen = b
            later += 1
        own = "".join([*pieces, text[seen:end]])
        whole = text[start:end]
        s.refs = capped((w for w in re.findall(WORD, whole) if w not in NOT_NAMES), MOST_REFS, name)
        if kind in ("fn", "method", "constructor"):
            opening = text.find("(", at)
            if 0 <= opening < max(body, at + len(name) + 200) and opening < end:
                s.params = _params(source[opening + 1 : close(text, opening) - 1], lang)
                tail = text[close(text, opening) : body]
            else:
                tail = ""
            code = own[max(0, body - start) :]
            s.calls = capped((w for w in re.findall(rf"({WORD})!?\s*(?:::<[^>]*>)?\(", whole[max(0, body - start) :]) if w not in NOT_NAMES and not (lang == "rust" and w == "fn")), MOST_CALLS, name)
            declared = re.search(DECLARES.get(lang, DECLARES["java"]), code) and [w for g in re.findall(DECLARES.get(lang, DECLARES["java"]), code) for w in re.findall(WORD, g) if w not in ("mut",)]
            s.locals = capped([p[0] for p in s.params] + (declared or []), MOST_LOCALS)
            kind_text = {"rust": re.search(r"->\s*(.+?)\s*(?:where\b.*)?$", tail, re.S), "kotlin": re.search(r":\s*(.+?)\s*$", tail, re.S), "js": re.search(r":\s*(.+?)\s*(?:=>)?\s*$", tail, re.S)}.get(lang)
            if kind_text:
                s.returns = (squeeze(kind_text[1], TYPE_MAX), False)
            elif lang in ("java", "csharp", "c", "cpp") and kind != "constructor":
                words = [w for w in text[start:at].split() if not re.fullmatch(MODS, w + " ")]
                s.returns = (squeeze(" ".join(words), TYPE_MAX), False) if words else None
            else:
                told = {t[0] for r in re.finditer(r"\breturn\s+([^;\n}]+)", code) if (t := _literal(source[start + max(0, body - start) + r.start(1) : start + max(0, body - start) + r.end(1)]))}
                s.returns = (told.pop(), True) if len(told) == 1 else None
        out.append(s)
    return out


def extract(lang: str | None, content: str | None) -> list[Symbol]:
    """Symbols in source order; none for unknown languages."""
    if not content or lang is None:
        return []
    return python_symbols(content) if lang == "python" else brace_symbols(content, lang) if FAMILY.get(lang, lang) in PATTERNS else []


def symbol_rows(files: DataFrame) -> DataFrame:
    """(path, lang, ord, symbol fields) of files (path, lang, content), in Arrow batches of whole files."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("ord", T.IntegerType()), *SYMBOL])

    def run(batches):
        for batch in batches:
            rows = []
            for path, lang, content in zip(*(c.to_pylist() for c in batch.columns)):
                for i, s in enumerate(extract(lang, content)):
                    rows.append(dict(zip(schema.names, (path, lang, i, *s.row()))))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    ty = pa.struct([("ty", pa.string()), ("inferred", pa.bool_())])
    words = pa.list_(pa.string())
    ARROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("symbol_kind", pa.string()), ("container", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("doc", pa.string()), ("refs", words), ("locals", words), ("calls", words), ("params", pa.list_(pa.struct([("name", pa.string()), ("ty", ty)]))), ("returns", ty)])
    return files.filter(F.col("lang").isNotNull()).select("path", "lang", "content").mapInArrow(run, schema)
