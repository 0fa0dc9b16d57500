"""Queries on scalar functions and text sources, over pages, documents, parts and literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgraph.functions import numeric, text
from kgraph.plans.registry import query, table
from kgraph.sources import text_graphs


def values(spark, column: str, items: list):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, {column} string")


def sql_values(column: str, items: list) -> str:
    def quoted(x):
        return "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"

    return f"v AS (SELECT * FROM (VALUES {', '.join(f'({i}, {quoted(x)})' for i, x in enumerate(items))}) AS t(i, {column}))"


URL_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(URL_PATH).alias("path"))


P = f"WITH p AS (SELECT page_id, {URL_PATH} AS path FROM pages), q AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)"


def path_query(name, expr, sql):
    query(name, f"{P} SELECT page_id, {sql} AS v FROM q")(lambda spark, sf_dir: paths(spark, sf_dir).select("page_id", expr(F.col("path")).alias("v")))


path_query("path_parent", text.parent, "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END")
path_query("path_file_name", text.file_name, "name")
path_query("path_extension", text.extension, "regexp_extract(name, '\\.([^.]*)$', 1)")
path_query("path_file_stem", text.file_stem, "regexp_replace(name, '\\.[^.]*$', '')")
path_query("path_relative", lambda c: text.relative(F.concat(F.lit("/repo/"), c), "/repo"), "CASE WHEN length(path) > 0 THEN path END")
path_query("path_prefixes", lambda c: F.array_join(text.path_prefixes(c), " "), "(SELECT coalesce(string_agg(array_to_string(string_split(path, '/')[1:k], '/'), ' ' ORDER BY k), '') FROM (SELECT unnest(range(1, len(string_split(path, '/')))) AS k))")
path_query("path_suffixes", lambda c: F.array_join(text.path_suffixes(c), " "), "(SELECT string_agg(array_to_string(string_split(path, '/')[k:], '/'), ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(string_split(path, '/')) + 1)) AS k))")

JOINS = ["a/b|./c", "a/b|../c", "a|../../x", ".|x.rs", "a//b|.", "|", "src|a/../b/./c", "a/b/c|../../../..", "x|/abs/y"]
JOINED = ["a/b/c", "a/c", "x", "x.rs", "a/b", ".", "src/b/c", ".", "x/abs/y"]
query("path_join_normalize", f"WITH {sql_values('want', JOINED)} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "j", JOINS).select("i", text.join_normalize(F.substring_index("j", "|", 1), F.substring_index("j", "|", -1)).alias("v")))
CRATES = ["crates/x/src/a.rs", "src/lib.rs", "a/src/b/src/c.rs", "lib/a.rs", "srcs/a.rs", "src"]
query("path_crate_src_dir", f"WITH {sql_values('want', ['crates/x/src', 'src', 'a/src/b/src', None, None, 'src'])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "p", CRATES).select("i", text.crate_src_dir(F.col("p")).alias("v")))


def doc_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs


L = f"WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INTEGER AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


def line_query(name, expr, sql):
    query(name, f"{L} SELECT doc_id, line_no, {sql} AS v FROM l")(lambda spark, sf_dir: doc_lines(spark, sf_dir).select("doc_id", "line_no", expr(F.col("line")).alias("v")))


line_query("str_collapse_ws", text.collapse_ws, r"trim(regexp_replace(line, '\s+', ' ', 'g'))")
line_query("str_truncate", lambda c: text.truncate(c, 40), "CASE WHEN length(line) > 40 THEN left(line, 40) || '…' ELSE line END")
line_query("str_slugify", text.slugify, r"regexp_replace(regexp_replace(translate(lower(trim(line)), ' _', '--'), '[^\p{L}\p{Nd}\p{Nl}\p{No}\-]', '', 'g'), '^-+|-+$', '', 'g')")
line_query("str_sanitize", text.sanitize_cell, "translate(line, chr(9) || chr(10) || chr(13), '   ')")
line_query("str_starts_upper", text.starts_upper, r"regexp_matches(line, '^\p{Lu}')")
query("src_read", "SELECT doc_id, text AS content FROM documents")(lambda spark, sf_dir: table(spark, sf_dir, "documents").filter(F.is_valid_utf8("text")).select("doc_id", F.decode(F.encode("text", "UTF-8"), "UTF-8").alias("content")))

NAMES = ["parseConfig", "get_count", "__init__", "HTTPServer", "isReady", "_private_thing", "x", "toString", "main", "with_capacity"]
WORDS = ["parse", "get", "init", "httpserver", "is", "private", "x", "to", "main", "with"]
query("str_first_word", f"WITH {sql_values('want', WORDS)} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "n", NAMES).select("i", text.first_word(F.col("n")).alias("v")))
query("str_part_words", "SELECT p_partkey, lower(regexp_extract(p_name, '^([^ ]*)', 1)) AS v FROM part")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", text.first_word(F.translate("p_name", " ", "_")).alias("v")))
ROLES = [("parse_config", "fn", None), ("new", "fn", None), ("test_x", "fn", None), ("run_test", "method", None), ("m", "method", "FooTests"), ("main", "fn", None), ("getName", "method", "A"), ("Thing", "struct", None), ("Foo", "constructor", "Foo"), ("is_ok", "fn", None), ("on_click", "fn", None), ("load", "fn", None), ("add", "fn", None), ("zap", "fn", None)]
ROLE_WANT = ["converter", "factory", "test", "test", "test", "entrypoint", "accessor", None, "constructor", "predicate", "handler", "io", "mutator", None]
query("i_role", f"WITH {sql_values('want', ROLE_WANT)} SELECT i, want AS v FROM v")(lambda spark, sf_dir: spark.createDataFrame([(i, *r) for i, r in enumerate(ROLES)], "i int, n string, k string, c string").select("i", text.classify_role(F.col("n"), F.col("k"), F.col("c")).alias("v")))
ROLE_CASES = " ".join(f"WHEN word IN ({', '.join(repr(w) for w in words)}) THEN '{role}'" for role, words in text.ROLE_WORDS.items())
query("i_role_parts", f"SELECT p_partkey, CASE {ROLE_CASES} END AS v FROM (SELECT p_partkey, regexp_extract(p_name, '^([^ ]*)', 1) AS word FROM part)")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", text.classify_role(F.translate("p_name", " ", "_"), F.lit("fn"), F.lit(None).cast("string")).alias("v")))
SEGMENTS = ["a.b.c", "std::vec::Vec<u8>", "foo", "x.y!", "a.b()", "a.1-2", "::new"]
query("str_last_segment", f"WITH {sql_values('want', ['c', 'Vec', 'foo', 'y', 'b', None, 'new'])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", SEGMENTS).select("i", text.last_segment(F.col("s")).alias("v")))
CALLEES = ["Foo::new", "Foo", "foo", "a.Store.create", "Vec::with_capacity", "lower::new", "Foo::run", "new"]
query("str_constructor_type", f"WITH {sql_values('want', ['Foo', 'Foo', None, 'Store', 'Vec', None, None, None])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", CALLEES).select("i", text.constructor_type(F.col("s")).alias("v")))
KINDS = ["function_item", "method_definition", "constructor_declaration", "struct_specifier", "class_definition", "namespace_definition", "macro_definition", "other"]
query("str_kind_label", f"WITH {sql_values('want', ['fn', 'method', 'constructor', 'struct', 'class', 'namespace', 'macro', 'symbol'])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", KINDS).select("i", text.kind_label(F.col("s")).alias("v")))
DOCS = ["/// Builds.\n/// Twice.", "/** A store. */", "//! top\n\n//! next", "/**\n * One\n * two\n */", "plain"]
query("str_clean_doc", f"WITH {sql_values('want', ['Builds. Twice.', 'A store.', 'top next', 'One two /', 'plain'])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", DOCS).select("i", text.clean_doc(F.col("s")).alias("v")))
TYPES = ["-> Vec<u8>", ": string", "  int  *  ", "->", "x" * 90]
query("str_clean_type", f"WITH {sql_values('want', ['Vec<u8>', 'string', 'int *', '', 'x' * 80 + '…'])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", TYPES).select("i", text.clean_type(F.col("s")).alias("v")))
SPANS = ["3-9", "3-", "x-1", "", "12-12", "1-2-3"]
query("parse_span", "SELECT * FROM (VALUES (0, 3, 9), (1, NULL, NULL), (2, NULL, NULL), (3, NULL, NULL), (4, 12, 12), (5, NULL, NULL)) AS t(i, start_line, end_line)")(lambda spark, sf_dir: values(spark, "s", SPANS).select("i", text.parse_span(F.col("s")).alias("p")).select("i", "p.start_line", "p.end_line"))
HEADS = ["# A b", "  ### C_d e!", "#no", "####### seven", "#  two  ", "text"]
query("md_heading", f"WITH {sql_values('want', ['a-b', 'c-d-e', None, None, 'two', None])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", HEADS).select("i", text.slugify(text.heading(F.col("s"))).alias("v")))
LINKS = ["[a](b.md) and ![c](d.png \"t\")", "[x]( y )", "none", "[a](open", "[e]() [f](g#h)"]
query("md_link_targets", f"WITH {sql_values('want', ['b.md d.png', 'y', '', '', 'g#h'])} SELECT i, want AS v FROM v")(lambda spark, sf_dir: values(spark, "s", LINKS).select("i", F.array_join(text.link_targets(F.col("s")), " ").alias("v")))
query("i_describe", "SELECT * FROM (VALUES (0, 'get_count (accessor) takes items: int, more; returns int; calls a, b, c, d'), (1, NULL), (2, 'zap; calls a')) AS t(i, v)")(
    lambda spark, sf_dir: spark.sql("""SELECT i, n, r, k, doc, transform(ps, p -> named_struct('name', split(p, ':')[0], 'ty', if(contains(p, ':'), named_struct('ty', split(p, ':')[1], 'inferred', false), null))) AS ps, if(ret is null, null, named_struct('ty', ret, 'inferred', true)) AS ret, cs
      FROM VALUES (0, 'get_count', 'accessor', 'fn', CAST(null AS STRING), array('items:int', 'more'), 'int', array('a', 'b', 'c', 'd', 'e')), (1, 'x', 'io', 'fn', 'doc', array('p'), null, array()), (2, 'zap', null, 'method', null, array(), null, array('a')) AS t(i, n, r, k, doc, ps, ret, cs)""")
    .select("i", text.describe(F.col("n"), F.col("r"), F.col("ps"), F.col("ret"), F.col("cs"), F.col("k"), F.col("doc")).alias("v"))
)

# Text sources

EDGE_TEXT = "# head\nb a\n\n% more\n10\t9 extra\n9 10\na  b\n"
query("src_edgelist", "SELECT * FROM (VALUES (1, 3, 2), (4, 0, 1), (5, 1, 0), (6, 2, 3)) AS t(eidx, src, dst)")(lambda spark, sf_dir: text_graphs.parse_edge_list(text_graphs.lines_of(spark, EDGE_TEXT))[1])
query("join_label_index", "SELECT * FROM (VALUES (0, '10'), (1, '9'), (2, 'a'), (3, 'b')) AS t(idx, label)")(lambda spark, sf_dir: text_graphs.parse_edge_list(text_graphs.lines_of(spark, EDGE_TEXT))[0])


def order_lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat(F.lit("  o"), F.col("o_custkey"), F.lit("\t p"), F.col("o_orderkey") % 97, F.lit(" x")).alias("line"))


OL = "pairs AS (SELECT o_orderkey AS eidx, 'o' || o_custkey AS a, 'p' || (o_orderkey % 97) AS b FROM orders), labels AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM (SELECT a AS label FROM pairs UNION SELECT b FROM pairs))"
query("src_edgelist_orders", f"WITH {OL} SELECT eidx, x.idx AS src, y.idx AS dst FROM pairs JOIN labels x ON x.label = a JOIN labels y ON y.label = b")(lambda spark, sf_dir: text_graphs.parse_edge_list(order_lines(spark, sf_dir))[1])
query("src_indexed_edges", "SELECT o_orderkey AS eidx, o_custkey AS src, o_orderkey % 97 AS dst FROM orders")(lambda spark, sf_dir: text_graphs.parse_indexed_edges(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat_ws(" ", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 97).cast("string")).alias("line")), 1 << 40))
SIDE = "0\tfile:a\ta.py\tfile\ta.py\n2\tsym:a::f\tf\tsym\ta.py::f\t3-9\tdef f()\tfn\tA\tdoc text\tx y\tg h\tio\t~int\tsays\n1\td\td\todd\td\n1\tdoc:d\td.md\tdoc\td.md\n5\tq\tq\tsec\tq\t\t\t\t\t\t\t\t\tint\n"
query("src_sidecar", """SELECT * FROM (VALUES (0, 'a.py', 'file', NULL, '', NULL, NULL), (1, 'd.md', 'doc', NULL, '', NULL, NULL), (2, 'f', 'sym', 3, 'x y', 'int', true), (3, '', '?', NULL, '', NULL, NULL), (4, '', '?', NULL, '', NULL, NULL), (5, 'q', 'sec', NULL, '', 'int', false)) AS t(idx, name, kind, start_line, locals, ty, inferred)""")(
    lambda spark, sf_dir: text_graphs.parse_sidecar(text_graphs.lines_of(spark, SIDE)).select("idx", "name", "kind", "span.start_line", F.array_join("locals", " ").alias("locals"), "returns.ty", "returns.inferred")
)
query("src_exported_pair", "SELECT * FROM (VALUES (0, 0, 2, 'a.py', 'f'), (1, 5, 1, 'q', 'd.md')) AS t(eidx, src, dst, a, b)")(lambda spark, sf_dir: _pair(spark))


def _pair(spark):
    nodes, edges = text_graphs.parse_exported(text_graphs.lines_of(spark, "0 2\n5 1\n"), text_graphs.lines_of(spark, SIDE))
    names = nodes.select("idx", "label")
    return edges.join(names.select(F.col("idx").alias("src"), F.col("label").alias("a")), "src").join(names.select(F.col("idx").alias("dst"), F.col("label").alias("b")), "dst").select("eidx", "src", "dst", "a", "b")


# Numbers

CODE = " | ".join(f"((((x >> {b}) & 1) << {3 * b}) | (((y >> {b}) & 1) << {3 * b + 1}) | (((z >> {b}) & 1) << {3 * b + 2}))" for b in range(21))
POINTS = "pts AS (SELECT p_partkey AS i, (p_partkey * 37) % 2097152 AS x, (p_partkey * 7919) % 2097152 AS y, (p_partkey * 104729) % 2097152 AS z FROM part)"


def points(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("i"), (k * 37 % 2097152).alias("x"), (k * 7919 % 2097152).alias("y"), (k * 104729 % 2097152).alias("z"))


query("l_morton", f"WITH {POINTS} SELECT i, {CODE} AS code FROM pts")(lambda spark, sf_dir: points(spark, sf_dir).select("i", numeric.morton_of_cells(F.col("x"), F.col("y"), F.col("z")).alias("code")))
query("l_digit", f"WITH {POINTS}, c AS (SELECT i, {CODE} AS code FROM pts) SELECT i, (code >> 60) & 7 AS root, (code >> 30) & 7 AS mid, code & 7 AS leaf FROM c")(
    lambda spark, sf_dir: points(spark, sf_dir).withColumn("c", numeric.morton_of_cells(F.col("x"), F.col("y"), F.col("z"))).select("i", numeric.digit(F.col("c"), 0).alias("root"), numeric.digit(F.col("c"), 10).alias("mid"), numeric.digit(F.col("c"), 20).alias("leaf"))
)
query("sort_morton", f"WITH {POINTS} SELECT i, row_number() OVER (ORDER BY {CODE}, i) - 1 AS pos FROM pts")(lambda spark, sf_dir: _numbered(points(spark, sf_dir).withColumn("code", numeric.morton_of_cells(F.col("x"), F.col("y"), F.col("z"))), ["code", "i"]))
query("sort_radix", "SELECT l_orderkey * 8 + l_linenumber AS i, row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) - 1 AS pos FROM lineitem")(lambda spark, sf_dir: _numbered(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i"), "l_partkey"), ["l_partkey", "i"]))
query("agg_histogram", "SELECT l_orderkey // 256 AS tile, l_partkey % 256 AS digit, count(*) AS n FROM lineitem GROUP BY 1, 2")(lambda spark, sf_dir: table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 256).alias("tile"), (F.col("l_partkey") % 256).alias("digit")).agg(F.count("*").alias("n")))
query("win_boundary", f"WITH {POINTS}, c AS (SELECT i, ({CODE}) >> 45 AS prefix, {CODE} AS code FROM pts) SELECT i, prefix IS DISTINCT FROM lag(prefix) OVER (ORDER BY code, i) AS starts FROM c")(lambda spark, sf_dir: _runs(spark, sf_dir).select("i", "starts"))
query("win_run_end", f"WITH {POINTS}, c AS (SELECT i, ({CODE}) >> 45 AS prefix, row_number() OVER (ORDER BY {CODE}, i) - 1 AS pos FROM pts) SELECT i, max(pos) OVER (PARTITION BY prefix) + 1 AS run_end FROM c")(lambda spark, sf_dir: _runs(spark, sf_dir).select("i", "run_end"))


def _numbered(df, order):
    from kgraph import model

    return model.dense_index(df, order, "pos").select("i", "pos")


def _runs(spark, sf_dir):
    from pyspark.sql import Window

    from kgraph import model

    coded = points(spark, sf_dir).withColumn("code", numeric.morton_of_cells(F.col("x"), F.col("y"), F.col("z"))).withColumn("prefix", F.shiftright("code", 45))
    ranked = model.dense_index(coded, ["code", "i"], "pos")
    run = Window.partitionBy("prefix")
    return ranked.withColumns({"run_end": F.max("pos").over(run) + 1, "starts": F.col("pos") == F.min("pos").over(run)})


query("point_segment_distance", "SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 5.0::DOUBLE), (2, 5.0::DOUBLE)) AS t(i, v)")(
    lambda spark, sf_dir: spark.createDataFrame([(0, 1.0, 1.0, 0.0, 0.0, 4.0, 0.0), (1, -3.0, 4.0, 0.0, 0.0, 4.0, 0.0), (2, 3.0, 4.0, 0.0, 0.0, 0.0, 0.0)], "i int, px double, py double, ax double, ay double, bx double, by double").select("i", numeric.point_segment_distance(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by"))).alias("v"))
)
query("point_diameter", "SELECT p_partkey, CASE WHEN p_size - 25 < 0 THEN round(p_retailprice * 500 / (25 - p_size), 4) ELSE 0 END AS v FROM part")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", F.round(numeric.point_diameter(F.col("p_retailprice"), (F.col("p_size") - 25).cast("double")), 4).alias("v")))
query("clear_color", "SELECT DISTINCT p_size, p_size / 255.0::DOUBLE AS v FROM part")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", numeric.clear_color(F.col("p_size")).alias("v")))
query("millis_per_step", "SELECT DISTINCT p_size, CASE WHEN p_size - 5 > 0 THEN round(3.0::DOUBLE * 1000 / (p_size - 5), 6) ELSE 0 END AS v FROM part")(lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_size").distinct().select("p_size", F.round(numeric.millis_per_step(F.lit(3.0), F.col("p_size") - 5), 6).alias("v")))
