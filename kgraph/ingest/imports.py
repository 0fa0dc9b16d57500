"""Import edges: each line of code becomes lists of candidate paths, and one relational step resolves them.

A candidate is exact (the path itself) or a suffix (any path that ends with it, the shortest first). Suffixes
are resolved by an equi-join on every tail of every path, never by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.functions import text
from kgraph.ingest.languages import LANGUAGES

TRIES = "array<struct<exact:boolean,path:string>>"
# What a relative script specifier may lack, in the order tried.
JS_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _try(exact: bool, path: Column) -> Column:
    return F.struct(F.lit(exact).alias("exact"), path.alias("path"))


def _exact(*paths: Column) -> Column:
    return F.array(*(_try(True, p) for p in paths))


def _none() -> Column:
    return F.array().cast(f"array<{TRIES}>")


def source_lines(files: DataFrame) -> DataFrame:
    """(path, lang, line_no, line) of files (path, lang, content)."""
    return files.select("path", "lang", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))


def rust_tries(path: Column, raw: Column) -> Column:
    line = text.trim(raw)
    mod = text.trim(F.regexp_extract(line, r"^(?:pub )?mod (.*)$", 1))
    name = F.regexp_replace(mod, ";+$", "")
    is_mod = F.rlike(line, F.lit(r"^(?:pub )?mod ")) & F.endswith(mod, F.lit(";")) & text.is_ident(name)
    stem = text.file_stem(path)
    base = F.when(stem.isin("lib", "main", "mod"), text.parent(path)).otherwise(text.join_normalize(text.parent(path), stem))
    flat = text.join_normalize(base, name)
    src = text.crate_src_dir(path)
    body = text.trim(F.regexp_extract(line, r"^(?:pub |pub\(crate\) )?use (.*)$", 1))
    after = text.trim(F.regexp_extract(body, r"^crate::(.*)$", 1))
    segment = F.regexp_extract(after, r"^([\p{L}\p{N}_]*)", 1)
    roots = [F.concat(src, F.lit(f"/{n}.rs")) for n in ("lib", "main")]
    module = [F.concat(src, F.lit("/"), segment, F.lit(s)) for s in (".rs", "/mod.rs")]
    use = F.when(segment == "", _exact(*roots)).otherwise(_exact(*module, *roots))
    is_use = F.startswith(body, F.lit("crate::")) & src.isNotNull()
    return F.when(F.startswith(line, F.lit("//")), _none()).when(is_mod, F.array(_exact(F.concat(flat, F.lit(".rs")), F.concat(flat, F.lit("/mod.rs"))))).when(is_use, F.array(use)).otherwise(_none())


def js_tries(path: Column, raw: Column) -> Column:
    line = text.trim(raw)

    literal = r"""(['"`])(.*?)\1"""
    # the first occurrence of the marker decides, whatever follows it
    after_from = F.when(F.instr(line, " from ") > 0, F.regexp_extract(text_after(line, " from "), r"^\s*" + literal, 2))
    required = F.when(F.instr(line, "require(") > 0, F.regexp_extract(text_after(line, "require("), r"^\s*" + literal, 2))
    both = F.filter(F.array(after_from, required), lambda s: s.isNotNull() & (s != ""))
    bare = F.when(F.startswith(line, F.lit("import ")), F.regexp_extract(line, r"^import \s*" + literal, 2))
    specs = F.when(F.size(both) > 0, both).otherwise(F.filter(F.array(bare), lambda s: s.isNotNull() & (s != "")))
    relative = F.filter(specs, lambda s: F.rlike(s, F.lit(r"^(?:\./|\.\./|/)")))
    tries = F.transform(relative, lambda s: F.transform(F.array(*(F.lit(x) for x in JS_SUFFIXES)), lambda x: _try(True, F.concat(text.join_normalize(text.parent(path), s), x))))
    return F.when(F.startswith(line, F.lit("//")), _none()).otherwise(tries)


def text_after(line: Column, marker: str) -> Column:
    return F.substring(line, F.instr(line, marker) + len(marker), F.lit(1 << 30))


def python_tries(path: Column, raw: Column) -> Column:
    line = text.trim(raw)

    def first_words(items: Column) -> Column:
        return F.transform(F.split(items, ","), lambda s: F.regexp_extract(s, r"(?U)^\s*(\S*)", 1))

    def absolute(dotted: Column) -> Column:
        p = F.replace(dotted, F.lit("."), F.lit("/"))
        return F.array(_try(False, F.concat(p, F.lit(".py"))), _try(False, F.concat(p, F.lit("/__init__.py"))))

    def below(base: Column, module: Column) -> Column:
        p = text.join_normalize(base, module)
        return _exact(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")))

    imported = F.transform(F.filter(first_words(F.substring(line, 8, 1 << 30)), lambda s: s != ""), absolute)
    rest = F.substring(line, 6, 1 << 30)
    left = F.substring_index(rest, " import ", 1)
    names = F.filter(first_words(text_after(rest, " import ")), lambda s: (s != "") & (s != "*"))
    level = F.length(F.regexp_extract(left, r"^(\.*)", 1))
    module = text.trim(F.regexp_replace(left, r"^\.+", ""))
    here = text.parent(path)
    base = F.when(level > 1, F.aggregate(F.sequence(F.lit(1), F.greatest(level - 1, F.lit(1))), here, lambda d, _: text.parent(d))).otherwise(here)
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    from_top = F.concat(F.array(absolute(module)), F.transform(names, lambda n: absolute(F.concat(module, F.lit("."), n))))
    siblings = F.transform(names, lambda n: below(base, n))
    relative = F.when(module == "", siblings).otherwise(F.concat(F.array(below(base, slashed)), F.transform(names, lambda n: below(base, F.concat(slashed, F.lit("/"), n)))))
    is_from = F.startswith(line, F.lit("from ")) & (F.instr(rest, " import ") > 0)
    return F.when(F.startswith(line, F.lit("import ")), imported).when(is_from & (level == 0), from_top).when(is_from, relative).otherwise(_none())


def c_tries(path: Column, raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"""(?U)^\s*#\s*include\s*"([^"]*)""", 1)
    return F.when(inner != "", F.array(F.array(_try(True, text.join_normalize(text.parent(path), inner)), _try(False, inner)))).otherwise(_none())


def dotted_tries(raw: Column, keyword: str, terminator: str, suffix: str) -> Column:
    line = text.trim(raw)
    rest = text.trim(F.substring(line, len(keyword) + 1, 1 << 30))
    if terminator:
        rest = text.trim(F.regexp_replace(rest, terminator + "$", ""))
    rest = text.trim(F.regexp_replace(rest, "^static ", ""))
    rest = F.when(F.instr(rest, " = ") > 0, text.trim(text_after(rest, " = "))).otherwise(rest)
    rest = F.when(F.instr(rest, " as ") > 0, text.trim(F.substring_index(rest, " as ", 1))).otherwise(rest)
    fine = F.startswith(line, F.lit(keyword)) & (rest != "") & ~F.endswith(rest, F.lit(".*")) & ~F.rlike(rest, F.lit(r"""[({"]"""))
    return F.when(fine, F.array(F.array(_try(False, F.concat(F.replace(rest, F.lit("."), F.lit("/")), F.lit("." + suffix)))))).otherwise(_none())


def tries(path: Column, lang: Column, line: Column) -> Column:
    out = F
    for language in LANGUAGES:
        if language.imports == "dotted":
            found = dotted_tries(line, language.keyword, language.terminator, language.suffix)
        else:
            found = {"rust": rust_tries, "js": js_tries, "python": python_tries, "c": c_tries}[language.imports](path, line)
        out = out.when(lang == language.tag, found)
    return out.otherwise(_none())


#: A line without any of these words can't import; the test is cheap and comes first.
TELLING = r"mod |use |from |require\(|import |#\s*include|using "


def candidates(files: DataFrame) -> DataFrame:
    """(path, lang, line_no, item, pos, exact, candidate), pos being the order in which to try."""
    lines = source_lines(files.filter("lang is not null")).filter(F.rlike("line", F.lit(TELLING)))
    items = lines.select("path", "lang", "line_no", F.posexplode(tries(F.col("path"), F.col("lang"), F.col("line"))).alias("item", "t"))
    return items.select("path", "lang", "line_no", "item", F.posexplode("t").alias("pos", "c")).select("path", "lang", "line_no", "item", "pos", F.col("c.exact").alias("exact"), F.col("c.path").alias("candidate"))


def resolve(found: DataFrame, paths: DataFrame) -> DataFrame:
    """The first candidate of each item that exists, as its target: (path, lang, line_no, item, target).
    paths is (path, id). Ties of suffix length go by path."""
    exact = found.filter("exact").join(paths.select(F.col("path").alias("candidate"), F.col("path").alias("hit"), "id"), "candidate")
    tails = paths.select(F.explode(text.path_suffixes(F.col("path"))).alias("candidate"), F.col("path").alias("hit"), "id")
    best_tail = tails.groupBy("candidate").agg(F.min(F.struct(F.octet_length("hit").alias("n"), "hit", "id")).alias("t")).select("candidate", F.col("t.hit").alias("hit"), F.col("t.id").alias("id"))
    suffix = found.filter("not exact").join(best_tail, "candidate")
    hits = exact.unionByName(suffix)
    return hits.groupBy("path", "lang", "line_no", "item").agg(F.min(F.struct("pos", "hit", "id")).alias("b")).select("path", "lang", "line_no", "item", F.col("b.id").alias("target"))


def import_edges(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(src, dst, kind, path, line_no, item): distinct edges, each where it first stands. Rust files may
    import themselves; others don't."""
    edges = resolve(candidates(files), paths).withColumn("src", F.concat(F.lit("file:"), F.col("path")))
    edges = edges.filter((F.col("lang") == "rust") | (F.col("src") != F.col("target")))
    first = edges.groupBy("src", F.col("target").alias("dst")).agg(F.min(F.struct("path", "line_no", "item")).alias("w"))
    return first.select("src", "dst", F.lit("imports").alias("kind"), "w.path", "w.line_no", "w.item")
