"""Scalar functions on strings and paths as column expressions; none of them is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MORE = "…"
SIGNATURE_MAX, DOC_MAX, DESCRIPTION_MAX, TYPE_MAX = 240, 400, 240, 80


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(MORE))).otherwise(c)


def sanitize_cell(c: Column) -> Column:
    """Tabs and line ends become spaces, one for one."""
    return F.translate(c, "\t\n\r", "   ")


# Paths


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """After the last dot of the file name; of a dot file its name; else empty."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def relative(path: Column, root: str) -> Column:
    """Below root, with forward slashes; null for root itself and for what isn't below it."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)) & (F.length(path) > len(base)), F.replace(F.substring(path, len(base) + 1, 1 << 30), F.lit("\\"), F.lit("/")))


def join_normalize(base: Column, rel: Column) -> Column:
    """base and rel joined, with empty and ``.`` segments gone and ``..`` taking back one; ``.`` if
    nothing is left. Taking back from nothing leaves nothing."""
    parts = F.filter(F.split(F.concat(base, F.lit("/"), rel), "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    joined = F.array_join(kept, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def path_suffixes(path: Column) -> Column:
    """Every tail of a path that starts at a segment: a/b/c gives a/b/c, b/c and c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def path_prefixes(path: Column) -> Column:
    """Every directory above a path, outermost first: a/b/c gives a and a/b; a top-level path gives none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def crate_src_dir(path: Column) -> Column:
    """The path up to its last segment named src; null without one."""
    found = F.regexp_extract(path, r"^((?:.*/)?src)(?:/|$)", 1)
    return F.when(found != "", found)


# Identifiers


def is_ident(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[\p{L}\p{N}\p{M}_]+$"))


def starts_upper(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^\p{Lu}"))


def first_word(name: Column) -> Column:
    """Leading underscores gone, up to the next underscore or a capital after a small letter, in lower
    case (ASCII)."""
    word = F.regexp_extract(name, r"^_*([^_]*?)(?=_|(?<=\p{Ll})\p{Lu}|$)", 1)
    return F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def last_segment(c: Column) -> Column:
    """What follows the last dot or colon, up to a bracket or exclamation mark; null unless a name."""
    tail = F.regexp_extract(F.regexp_extract(c, r"([^.:]*)$", 1), r"^([^<(!\[]*)", 1)
    tail = trim(tail)
    return F.when(is_ident(tail), tail)


# Methods that construct their type.
CONSTRUCTOR_METHODS = ("new", "create", "from", "default", "with_capacity", "of", "make")


def constructor_type(callee: Column) -> Column:
    """Foo for ``Foo::new`` (or another constructor method of the nearest capitalised segment) and for a
    lone capitalised ``Foo``; else null."""
    parts = F.filter(F.split(callee, "[.:]"), lambda s: s != "")
    last = F.element_at(parts, -1)
    owners = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), starts_upper)
    of_method = (F.size(parts) >= 2) & last.isin(*CONSTRUCTOR_METHODS) & (F.size(owners) > 0)
    return F.when(F.size(parts) > 0, F.when(of_method, last_segment(F.element_at(owners, -1))).when((F.size(parts) == 1) & starts_upper(last), last_segment(last)))


def slugify(c: Column) -> Column:
    """Lower case, letters and digits kept, space, hyphen and underscore to hyphen, the rest dropped."""
    s = F.translate(F.lower(trim(c)), " _", "--")
    return F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{Nd}\p{Nl}\p{No}\-]", ""), r"^-+|-+$", "")


def heading(line: Column) -> Column:
    """The text of an ATX heading; null if the line isn't one."""
    return F.when(F.rlike(line, F.lit(r"(?U)^\s*#{1,6} ")), trim(F.regexp_extract(line, r"(?U)^\s*#{1,6} (.*)$", 1)))


def link_targets(line: Column) -> Column:
    """The first word inside each ``](...)``."""
    inside = F.regexp_extract_all(line, F.lit(r"\]\(([^)]*)\)"), 1)
    first = F.transform(inside, lambda s: F.regexp_extract(s, r"(?U)^\s*(\S*)", 1))
    return F.filter(first, lambda s: s != "")


def is_external(target: Column) -> Column:
    return F.rlike(target, F.lit(r"(?U)^\s*(?:https?://|mailto:|#)"))


def clean_doc(c: Column) -> Column:
    """Comment markers off each line, empty lines gone, joined by spaces."""
    front = r"^(?:/\*\*)*(?:///)*(?://!)*(?://)*\**"
    line = F.transform(F.split(c, r"\n"), lambda s: trim(F.regexp_replace(F.regexp_replace(trim(s), front, ""), r"(?:\*/)+$", "")))
    return F.array_join(F.filter(line, lambda s: s != ""), " ")


def clean_type(c: Column) -> Column:
    bare = F.regexp_replace(trim(F.regexp_replace(collapse_ws(c), r"^(?:->)+", "")), r"^:+", "")
    return truncate(trim(bare), TYPE_MAX)


def parse_span(c: Column) -> Column:
    """``a-b`` as two line numbers; null if it isn't that."""
    a, b = F.regexp_extract(c, r"^(\d+)-(\d+)$", 1).try_cast("int"), F.regexp_extract(c, r"^(\d+)-(\d+)$", 2).try_cast("int")
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start_line"), b.alias("end_line")))


def span_text(span: Column) -> Column:
    return F.when(span.isNotNull(), F.concat_ws("-", span["start_line"].cast("string"), span["end_line"].cast("string"))).otherwise(F.lit(""))


def returns_text(returns: Column) -> Column:
    """An inferred type carries a mark in front."""
    return F.when(returns.isNull(), F.lit("")).otherwise(F.concat(F.when(returns["inferred"], F.lit("~")).otherwise(F.lit("")), returns["ty"]))


def parse_returns(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.regexp_replace(c, "^~", "").alias("ty"), F.startswith(c, F.lit("~")).alias("inferred")))


# Roles and descriptions of symbols. First words that tell a role.

ROLE_WORDS = {
    "factory": ("new", "make", "create", "build", "construct", "init", "with"),
    "accessor": ("get", "fetch", "find", "lookup", "peek"),
    "mutator": ("set", "put", "update", "insert", "add", "remove", "delete", "push", "pop", "clear", "reset", "append"),
    "predicate": ("is", "has", "can", "should", "contains", "exists", "equals", "matches"),
    "converter": ("to", "into", "as", "from", "parse", "serialize", "deserialize", "convert", "format", "encode", "decode", "render"),
    "handler": ("on", "handle"),
    "io": ("read", "write", "open", "close", "flush", "print", "send", "recv", "connect", "load", "save"),
}
PLAIN_CALLABLE = ("fn", "method")
CALLABLE = (*PLAIN_CALLABLE, "constructor")


def classify_role(name: Column, kind: Column, container: Column) -> Column:
    """What a callable does, told from its name and, for tests, its container; null for other symbols."""
    lower, word = F.lower(name), first_word(name)
    tests = F.startswith(lower, F.lit("test")) | F.endswith(lower, F.lit("_test")) | F.coalesce(F.contains(container, F.lit("Test")), F.lit(False))
    role = F.when(tests, "test").when(lower == "main", "entrypoint")
    for label, words in ROLE_WORDS.items():
        role = role.when(word.isin(*words), label)
    return F.when(kind == "constructor", F.lit("constructor")).when(kind.isin(*PLAIN_CALLABLE), role)


def describe(name: Column, role: Column, params: Column, returns: Column, calls: Column, kind: Column, doc: Column) -> Column:
    """``name (role) takes a: T; returns R; calls x, y``: for a callable without a doc text, if there is
    anything to tell beside its name."""

    def listed(items: Column, head: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(F.slice(items, 1, 4), ", "))).otherwise(F.lit(""))

    typed = F.transform(params, lambda p: F.when(p["ty"]["ty"].isNotNull(), F.concat_ws(": ", p["name"], p["ty"]["ty"])).otherwise(p["name"]))
    told = (F.size(params) > 0) | returns.isNotNull() | (F.size(calls) > 0) | role.isNotNull()
    text = F.concat(name, F.coalesce(F.concat(F.lit(" ("), role, F.lit(")")), F.lit("")), listed(typed, " takes "), F.coalesce(F.concat(F.lit("; returns "), returns["ty"]), F.lit("")), listed(calls, "; calls "))
    return F.when(kind.isin(*CALLABLE) & doc.isNull() & told, truncate(text, DESCRIPTION_MAX))


# Labels of definitions by the grammar's name for them.
KIND_LABELS = {
    "fn": "function_item function_declaration generator_function_declaration function_definition variable_declarator",
    "method": "method_definition method_declaration",
    "constructor": "constructor_declaration",
    "struct": "struct_item struct_specifier struct_declaration",
    "enum": "enum_item enum_declaration enum_specifier",
    "union": "union_item union_specifier",
    "trait": "trait_item",
    "type": "type_item type_alias_declaration type_definition",
    "const": "const_item",
    "static": "static_item",
    "macro": "macro_definition",
    "class": "class_declaration abstract_class_declaration class_definition class_specifier",
    "interface": "interface_declaration",
    "record": "record_declaration",
    "object": "object_declaration",
    "namespace": "namespace_definition namespace_declaration",
}


def kind_label(c: Column) -> Column:
    out = F
    for label, names in KIND_LABELS.items():
        out = out.when(c.isin(*names.split()), label)
    return out.otherwise("symbol")
