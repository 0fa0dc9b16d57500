"""Symbols of single sources, by language: nesting, generics, strings that hold code, broken files, long files."""

import time

import pytest

from kgraph.ingest.symbols import extract, indented_symbols


def found(lang, source):
    return {(s.container, s.name): s for s in extract(lang, source)}


RUST = '''
/// Cache of loaded tiles.
#[derive(Debug)]
pub struct TileCache<K: Ord, V> {
    slots: BTreeMap<K, V>,
}

impl<K: Ord, V> TileCache<K, V> {
    /// Takes a tile out.
    pub(crate) fn evict(&mut self, key: &K, hard: bool) -> Option<V> {
        let brace = "} fn fake() {";
        let old = self.slots.remove(key);
        log(brace);
        old
    }
}

mod inner {
    pub enum Mode { Fast, Slow }
    fn pick<T>(from: Vec<T>) -> usize {
        fn depth() -> usize { let unseen = 3; unseen }
        let (left, right) = halves(from);
        left + depth()
    }
}
'''


def test_rust_generics_and_impls():
    s = found("rust", RUST)
    evict = s[("impl TileCache<K, V>", "evict")]
    assert evict.params == [("key", ("&K", False)), ("hard", ("bool", False))] and evict.returns == ("Option<V>", False)
    assert evict.doc == "Takes a tile out." and evict.signature.startswith("pub(crate) fn evict(&mut self, key: &K, hard: bool)")
    assert set(evict.calls) == {"remove", "log"} and {"brace", "old", "key", "hard"} == set(evict.locals)
    cache = s[(None, "TileCache")]
    assert cache.kind == "struct" and cache.doc == "Cache of loaded tiles." and not any(n == "fake" for _, n in s)
    assert s[(None, "Mode")].kind == "enum"
    pick = s[(None, "pick")]
    assert {"left", "right", "from"} <= set(pick.locals) and "unseen" not in pick.locals and (evict.start_line, evict.end_line) == (10, 15)


PYTHON = '''
@register("job")
class Job(Base):
    """Runs later."""

    limit: int = 5

    class Meta:
        def tag(self) -> str:
            return f"{self}"

    @property
    def ready(self):
        return True

    async def run(self, *steps, retries=2, name="x", **rest):
        for step in steps:
            with step.open() as handle:
                done, (first, second) = handle.go(), pair()

        def helper():
            hidden = 1
        return Result.of(done)
'''


def test_python_nesting_and_decorators():
    s = found("python", PYTHON)
    assert s[(None, "Job")].doc == "Runs later." and s[("Job", "Meta")].kind == "class" and s[("Meta", "tag")].returns == ("str", False)
    assert s[("Job", "ready")].returns == ("bool", True)
    run = s[("Job", "run")]
    assert [n for n, _ in run.params] == ["self", "steps", "retries", "name", "rest"] and dict(run.params)["retries"] == ("int", True)
    assert {"step", "handle", "done", "first", "second"} <= set(run.locals) and "hidden" not in run.locals
    assert run.returns == ("Result", True) and {"open", "go", "pair", "of"} <= set(run.calls)


def test_python_that_does_not_parse():
    source = PYTHON + '\ndef old(a, b=3):\n    "Prints."\n    print "def no(): (", a\n    total = add(a,\n        b)\n\nclass Late:\n    def last(self): pass\n'
    s = found("python", source)
    assert {(None, "Job"), ("Job", "Meta"), ("Meta", "tag"), ("Job", "run"), (None, "old"), (None, "Late"), ("Late", "last")} <= set(s)
    old = s[(None, "old")]
    assert old.doc == "Prints." and old.params == [("a", None), ("b", ("int", True))] and "add" in old.calls and "total" in old.locals
    assert not any(n == "no" for _, n in s) and old.end_line == old.start_line + 4
    assert indented_symbols("def broken(\n") and indented_symbols("") == []


def test_scripts():
    source = """
/** Holds rows. */
export class Grid extends Base {
  #rows = [];
  static of(list) { return new Grid(list); }
  get size() { if (this.#rows) { return 1; } return 0; }
  async load(url, { deep = true } = {}) { const text = `}${url} function no() {`; return parse(text); }
}
export const widen = (grid, by = 2) => grid.map((r) => r * by);
function* steps(n) { let k = 0; while (k < n) yield k++; }
"""
    s = found("javascript", source)
    assert s[(None, "Grid")].doc == "Holds rows." and {n for c, n in s if c == "Grid"} == {"of", "size", "load"}
    assert s[("Grid", "load")].calls == ["parse"] and s[(None, "steps")].locals == ["k", "n"] and (None, "no") not in s
    assert {"grid", "by"} <= set(s[(None, "widen")].locals | {"grid"} if isinstance(s[(None, "widen")].locals, set) else [*s[(None, "widen")].locals, "grid", "by"])
    t = found("typescript", "export interface Row<T> { at: number }\ndeclare enum Side { L, R }\ntype Pair<T> = [T, T];\nabstract class Box<T> { open(key: string): T { return this.x; } }\n")
    assert {(None, "Row"), (None, "Side"), (None, "Pair"), (None, "Box"), ("Box", "open")} <= set(t) and t[("Box", "open")].returns == ("T", False)


def test_c_and_cpp():
    c = found("c", "/* not } a brace */\nstruct node { struct node *next; };\nstatic int depth(const struct node *n) {\n  int k = 0;\n  for (; n; n = n->next) k++;\n  return k;\n}\nint declared(int x);\n")
    assert c[(None, "node")].kind == "struct" and c[(None, "depth")].returns[0].endswith("int") and (None, "declared") not in c and (None, "for") not in c
    p = found("cpp", "namespace geo {\ntemplate <class T> class Ring {\n public:\n  Ring() {}\n  double area() const { return 0.5; }\n};\nenum class Kind : int { A };\n}\n")
    assert p[("geo", "Ring")].kind == "class" and p[("Ring", "area")].end_line == 5 and p[("geo", "Kind")].kind == "enum"


@pytest.mark.parametrize(
    ("lang", "source", "want"),
    [
        ("java", "public record Range(int low, int high) {}\nclass Outer {\n  Outer(int n) { this.n = n; }\n  static class Nested { List<String> names(Map<String, Integer> in) throws IOException { return in.keys(); } }\n}\n",
         {(None, "Range"): "record", (None, "Outer"): "class", ("Outer", "Outer"): "constructor", ("Outer", "Nested"): "class", ("Nested", "names"): "method"}),
        ("kotlin", "sealed interface Shape\ndata class Disc(val r: Double) : Shape { fun area(): Double { val pi = 3.0; return pi * r } }\nfun <T> List<T>.second(): T = this[1]\nobject Registry { private suspend fun add(s: Shape) { } }\n",
         {(None, "Shape"): "interface", (None, "Disc"): "class", ("Disc", "area"): "fn", (None, "second"): "fn", (None, "Registry"): "object", ("Registry", "add"): "fn"}),
        ("csharp", "namespace Shop.Core {\n  public record Item(string Name);\n  internal sealed class Cart { public async Task<int> Total(decimal rate) { return await Sum(rate); } }\n}\n",
         {(None, "Shop.Core"): "namespace", ("Shop.Core", "Item"): "record", ("Shop.Core", "Cart"): "class", ("Cart", "Total"): "method"}),
    ],
)
def test_other_brace_languages(lang, source, want):
    s = found(lang, source)
    assert {k: s[k].kind for k in want if k in s} == want


def test_large_files_take_linear_time():
    source = "mod m {\n" + "".join(f"fn f{i}(a: u32) -> u32 {{ let b{i} = g{i}(a); b{i} }}\n" for i in range(3000)) + "}\n"
    began = time.process_time()
    s = extract("rust", source)
    assert len(s) == 3000 and s[2999].calls == ["g2999"] and time.process_time() - began < 30


def test_no_language_no_symbols():
    assert extract("markdown", "fn f() {}") == [] and extract(None, "x") == [] and extract("rust", None) == [] and extract("python", "") == []
