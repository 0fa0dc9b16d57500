"""Ingest queries: literal source trees, paths of pages, and files made of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgraph.functions import text
from kgraph.ingest import build, imports, languages, markdown, symbols
from kgraph.plans.registry import query, table

TREE = {
    "README.md": "# Top\n\nSee [lib](src/lib.rs#x), [web](http://x.y) and [self](README.md).\n```\n# not a heading [a](app.py)\n```\n## Next part\n![i](docs/guide.md \"t\")\n## Top\n# !!!\n",
    "docs/guide.md": "Intro [up](../README.md)\n### Deep_er one\n",
    "src/lib.rs": "pub mod loader;\nmod inner;\n// mod no;\nuse crate::loader::Thing;\nuse crate::{a, b};\npub fn build() -> u32 { 1 }\n",
    "src/loader.rs": "use crate::Thing;\npub(crate) use crate::inner::x;\npub struct Thing {}\n",
    "src/inner/mod.rs": "mod leaf;\n",
    "src/inner/leaf.rs": "",
    "app.py": "import os, util.helper as h\nfrom util import helper, other\nfrom . import app\nfrom .util.helper import x\n",
    "util/__init__.py": "from .helper import run\nfrom ..app import y\n",
    "util/helper.py": "def run():\n    return 1\n",
    "src/main.c": '#include <stdio.h>\n  # include "util.h"\n#include "deep/other.h"\n',
    "src/util.h": "int add(int a, int b);\n",
    "inc/deep/other.h": "",
    "web/a.ts": "import { b } from './b';\nexport * from \"../web/lib\";\nimport './style.css';\nconst x = require('./c.js');\nimport y from 'react';\n// import z from './b';\n",
    "web/b.tsx": "import '/a';\n",
    "web/c.js": "",
    "web/lib/index.ts": "",
    "A.java": "import lib.Thing;\nimport static lib.Thing.make;\nimport lib.*;\nimport java.util.List;\n",
    "lib/Thing.java": "package lib;\npublic class Thing {\n  public int get() { return 1; }\n}\n",
    "k/Main.kt": "import k.util.Tool as T\n",
    "k/util/Tool.kt": "object Tool\n",
    "cs/App.cs": "using Alias = cs.model.Item;\nusing (var x = y) {}\n",
    "cs/model/Item.cs": "",
}


def files(spark):
    rows = spark.createDataFrame(sorted(TREE.items()), "path string, content string")
    return rows.withColumn("lang", languages.language(text.extension(F.col("path"))))


def known(spark):
    kind = F.when(text.extension(F.col("path")).isin(*languages.DOC_EXTENSIONS), "doc:").otherwise("file:")
    return files(spark).select("path", F.concat(kind, F.col("path")).alias("id"))


def rows_sql(columns: str, rows: list[tuple]) -> str:
    def lit(x):
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def edges_of(spark, *tags):
    found = imports.import_edges(files(spark).filter(F.col("lang").isin(*tags)), known(spark))
    return found.select("src", "dst")


def f(*pairs):
    return rows_sql("src, dst", [("file:" + a, "file:" + b) for a, b in pairs])


query("i_imp_rust", f(("src/lib.rs", "src/loader.rs"), ("src/lib.rs", "src/inner/mod.rs"), ("src/lib.rs", "src/lib.rs"), ("src/loader.rs", "src/lib.rs"), ("src/loader.rs", "src/inner/mod.rs"), ("src/inner/mod.rs", "src/inner/leaf.rs")))(lambda spark, sf_dir: edges_of(spark, "rust"))
query("i_imp_js", f(("web/a.ts", "web/b.tsx"), ("web/a.ts", "web/lib/index.ts"), ("web/a.ts", "web/c.js"), ("web/b.tsx", "web/a.ts")))(lambda spark, sf_dir: edges_of(spark, "javascript", "typescript", "tsx"))
query("i_imp_python", f(("app.py", "util/helper.py"), ("app.py", "util/__init__.py"), ("util/__init__.py", "util/helper.py"), ("util/__init__.py", "app.py")))(lambda spark, sf_dir: edges_of(spark, "python"))
query("i_imp_c", f(("src/main.c", "src/util.h"), ("src/main.c", "inc/deep/other.h")))(lambda spark, sf_dir: edges_of(spark, "c", "cpp"))
query("i_imp_dotted", f(("A.java", "lib/Thing.java"), ("k/Main.kt", "k/util/Tool.kt"), ("cs/App.cs", "cs/model/Item.cs")))(lambda spark, sf_dir: edges_of(spark, "java", "kotlin", "csharp"))


def doc_lines(spark):
    return markdown.open_lines(files(spark).filter("path like '%.md'"))


query("i_markdown_sections", rows_sql("path, slug, name", [("README.md", "top", "Top"), ("README.md", "next-part", "Next part"), ("docs/guide.md", "deep-er-one", "Deep_er one")]))(lambda spark, sf_dir: markdown.sections(doc_lines(spark)).select("path", "slug", "name"))
query("i_markdown", rows_sql("src, dst", [("doc:README.md", "file:src/lib.rs"), ("doc:README.md", "doc:docs/guide.md"), ("doc:docs/guide.md", "doc:README.md")]))(lambda spark, sf_dir: markdown.links(doc_lines(spark), known(spark)).select("src", "dst"))

# Over the tables: URL paths as a tree of files, documents as files.

PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#]*([?#].*)?$', '')"


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.expr(PATH).alias("path")).distinct().select("path", F.lit(False).alias("is_dir"))


PAGES = f"p AS (SELECT DISTINCT {PATH} AS path FROM pages), dirs AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS k FROM p))"
NAME = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"regexp_extract({NAME}, '\\.([^.]*)$', 1)"
LANGS = " ".join(f"WHEN {EXT} IN ({', '.join(repr(x) for x in lang.extensions)}) THEN '{lang.tag}'" for lang in languages.LANGUAGES)
query("i_skeleton", f"WITH {PAGES} SELECT 'dir' AS kind, path, {NAME} AS name FROM dirs UNION ALL SELECT CASE WHEN {EXT} IN ('md', 'markdown') THEN 'doc' ELSE 'file' END, path, {NAME} FROM p UNION ALL SELECT 'dir', '.', 'root'")(lambda spark, sf_dir: build.skeleton(page_paths(spark, sf_dir), "root")[0].select("kind", "path", "name"))
query("i_skeleton_edges", f"WITH {PAGES} SELECT 'dir:' || CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS src, id AS dst FROM (SELECT path, 'dir:' || path AS id FROM dirs UNION ALL SELECT path, CASE WHEN {EXT} IN ('md', 'markdown') THEN 'doc:' ELSE 'file:' END || path FROM p)")(lambda spark, sf_dir: build.skeleton(page_paths(spark, sf_dir), "root")[1])
query("i_lang", f"WITH p AS (SELECT page_id, {PATH} AS path FROM pages) SELECT page_id, CASE {LANGS} END AS lang FROM p")(lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", languages.language(text.extension(F.expr(PATH))).alias("lang")))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.expr(PATH).alias("p")), page_paths(spark, sf_dir).select("path", F.concat(F.lit("file:"), F.col("path")).alias("id"))


TAIL = "substring(p, strpos(p, '/') + 1)"


def _suffix(spark, sf_dir):
    pages, paths = asked(spark, sf_dir)
    found = pages.select("path", F.lit("x").alias("lang"), F.lit(0).alias("line_no"), F.lit(0).alias("item"), F.lit(0).alias("pos"), F.lit(False).alias("exact"), F.substring("p", F.instr("p", "/") + 1, F.lit(1 << 20)).alias("candidate"))
    return imports.resolve(found, paths).select("path", "target")


query("join_resolve_suffix", f"WITH p AS (SELECT DISTINCT {PATH} AS path FROM pages), tails AS (SELECT path AS full_path, array_to_string(string_split(path, '/')[k:], '/') AS tail FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS k FROM p)), best AS (SELECT tail, min_by(full_path, (strlen(full_path), full_path)) AS hit FROM tails GROUP BY tail), a AS (SELECT page_id::VARCHAR AS path, {PATH} AS p FROM pages) SELECT a.path AS path, 'file:' || hit AS target FROM a JOIN best ON tail = {TAIL}")(_suffix)


def _priority(spark, sf_dir):
    pages, paths = asked(spark, sf_dir)
    tried = pages.select("path", F.posexplode(F.array(F.concat("p", F.lit("/index")), F.concat("p", F.lit(".html")), F.col("p"))).alias("pos", "candidate"))
    found = tried.select("path", F.lit("x").alias("lang"), F.lit(0).alias("line_no"), F.lit(0).alias("item"), "pos", F.lit(True).alias("exact"), "candidate")
    return imports.resolve(found, paths).select("path", "target")


query("join_resolve_priority", f"WITH p AS (SELECT DISTINCT {PATH} AS path FROM pages), a AS (SELECT page_id::VARCHAR AS path, {PATH} AS p FROM pages) SELECT path, 'file:' || CASE WHEN p || '/index' IN (SELECT path FROM p) THEN p || '/index' WHEN p || '.html' IN (SELECT path FROM p) THEN p || '.html' ELSE p END AS target FROM a")(_priority)
query("join_resolve_exact", f"WITH p AS (SELECT DISTINCT {PATH} AS path FROM pages) SELECT page_id, 'file:' || {PATH} AS target FROM pages WHERE {PATH} IN (SELECT path FROM p)")(lambda spark, sf_dir: table(spark, sf_dir, "pages").select("page_id", F.expr(PATH).alias("path")).join(asked(spark, sf_dir)[1], "path").select("page_id", F.col("id").alias("target")))
query("agg_argmin_len", f"SELECT regexp_extract({PATH}, '^([^/]*)', 1) AS host, min_by({PATH}, (strlen({PATH}), {PATH})) AS shortest FROM pages GROUP BY 1")(lambda spark, sf_dir: table(spark, sf_dir, "pages").select(F.expr(PATH).alias("p")).groupBy(F.substring_index("p", "/", 1).alias("host")).agg(F.min_by("p", F.struct(F.octet_length("p"), "p")).alias("shortest")))


def part_symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("path"), F.translate("p_name", " ", "_").alias("name"), F.lower("p_type").alias("symbol_kind"), F.when(F.col("p_size") % 3 == 0, F.lit("Box")).alias("container"), F.col("p_partkey").alias("ord"))


def part_imports(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey") % 60).alias("path"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("at"))


ROLLUP = """WITH s AS (SELECT 'f' || (p_partkey % 50) AS path, replace(p_name, ' ', '_') AS name, lower(p_type) AS sk, p_size % 3 = 0 AS boxed, p_partkey AS ord FROM part),
k AS (SELECT path, string_agg(n || ' ' || sk, ', ' ORDER BY sk) AS kinds FROM (SELECT path, sk, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT path, name, row_number() OVER (PARTITION BY path ORDER BY ord) AS q FROM (SELECT path, name, ord, lag(name) OVER (PARTITION BY path ORDER BY ord) AS last FROM s WHERE NOT boxed) WHERE name IS DISTINCT FROM last),
t AS (SELECT path, 'defines ' || string_agg(name, ', ' ORDER BY q) FILTER (q <= 8) || CASE WHEN count(*) > 8 THEN ', +' || (count(*) - 8) ELSE '' END AS tops FROM u GROUP BY 1),
i AS (SELECT path, 'imports ' || string_agg(s_name, ', ' ORDER BY s_suppkey) AS brought FROM (SELECT 'f' || (s_suppkey % 60) AS path, s_name, s_suppkey, row_number() OVER (PARTITION BY s_suppkey % 60 ORDER BY s_suppkey) AS q FROM supplier) WHERE q <= 6 GROUP BY 1),
every AS (SELECT path FROM k UNION SELECT path FROM t UNION SELECT path FROM i)
SELECT every.path AS path, concat_ws('; ', kinds, tops, brought) AS summary FROM every LEFT JOIN k USING (path) LEFT JOIN t USING (path) LEFT JOIN i USING (path)"""
query("agg_file_rollup", ROLLUP)(lambda spark, sf_dir: build.rollup(part_symbols(spark, sf_dir), part_imports(spark, sf_dir)))
query("take_n", "SELECT path, array_to_string(list(name ORDER BY ord)[1:8], ', ') AS names FROM (SELECT 'f' || (p_partkey % 50) AS path, p_name AS name, p_partkey AS ord FROM part) GROUP BY path")(lambda spark, sf_dir: table(spark, sf_dir, "part").groupBy(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("path")).agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), 1, 8), ", ").alias("names")))


def named_parts(spark, sf_dir):
    words = F.array(F.translate("p_name", " ", "_"), F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("path"), F.translate("p_name", " ", "_").alias("name"), F.col("p_partkey").cast("int").alias("ord"), F.col("p_size").alias("start_line"), words.alias("refs"), words.alias("calls"))
    return build.name_symbols(rows)


NAMED = "WITH s AS (SELECT 'f' || (p_partkey % 50) AS path, replace(p_name, ' ', '_') AS name, p_partkey AS ord, p_size AS line, lower(p_type) AS ty FROM part), n AS (SELECT *, 'sym:' || path || '::' || name || CASE WHEN row_number() OVER (PARTITION BY path, name ORDER BY ord) > 1 THEN '@' || line ELSE '' END AS id FROM s)"
query("i_add_symbols", f"{NAMED} SELECT ord::INTEGER AS ord, id, row_number() OVER (PARTITION BY id ORDER BY ord) = 1 AS survives FROM n")(lambda spark, sf_dir: named_parts(spark, sf_dir).select("ord", "id", "survives"))
query("i_symbol_edges", f"{NAMED}, first AS (SELECT path, name, min_by(id, ord) AS dst FROM n GROUP BY 1, 2), m AS (SELECT n.path, n.id, first.dst, n.ord FROM n JOIN first ON first.path = n.path AND first.name IN (n.name, n.ty) WHERE n.id <> first.dst) SELECT 'file:' || path AS src, id AS dst, 'defines' AS kind, ord::INTEGER AS ord FROM n UNION ALL SELECT id, dst, 'references', ord::INTEGER FROM m UNION ALL SELECT id, dst, 'calls', ord::INTEGER FROM m")(lambda spark, sf_dir: build.symbol_edges(named_parts(spark, sf_dir)).select("src", "dst", "kind", "ord"))


def _built(spark, part):
    paths = spark.createDataFrame([(p, False) for p in sorted(TREE)], "path string, is_dir boolean")
    return build.build_graph(paths, spark.createDataFrame(sorted(TREE.items()), "path string, content string"), "demo")[part]


query("i_symbols")(lambda spark, sf_dir: symbols.symbol_rows(files(spark)).select("path", "ord", "name", "symbol_kind", "container", "start_line", "end_line", "signature"))
query("build_nodes")(lambda spark, sf_dir: _built(spark, 0).select("idx", "id", "kind", "name", "lang", "role", "summary", "loc"))
query("build_edges")(lambda spark, sf_dir: _built(spark, 1).select("eidx", "src", "dst", "kind"))
