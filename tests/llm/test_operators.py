"""Each operator against a brute-force version on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zlib

from kgraph.llm import decontamination, html_text, mixing, quality_classifier, quality_rules, sharding, simhash_dedup, substring_dedup, text_stats, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, row long, stats string"


def words(rng, n):
    return " ".join(rng.choice("ab") + rng.choice("cdefg") * rng.randint(1, 4) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = words(rng, 6000)
    base = [words(rng, n) for n in (3, 12, 13, 40, 80, 200, 200, 300)]
    texts = [*base, base[3], base[3], base[4] + " " + base[5], long, long + " tail", "", None, "  \n ", "UPPER Case Words here now", "upper case words HERE now", None, base[6].replace("a", "A", 3)]
    out = [(i, t, "en", [None, "s0", "s1"][i % 3], 0, "clash", 1, "clash") for i, t in enumerate(texts)]
    return out + [out[4], (None, base[5], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_shards(docs, rows, none):
    got = sharding.assign_shards(docs, 3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    shard_of = defaultdict(set)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        shard_of[by_id[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in shard_of.values())
    assert sharding.assign_shards(none, 3).count() == 0
    wide = sharding.shard_rows(docs, 3)
    assert wide.count() == len(rows) and wide.columns == [*docs.columns, "shard", "slot"]


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_run_of_equal_sizes(n):
    import heapq

    loads = [5, 90, 31, 31]
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    want = [0] * 4
    for _ in range(n):
        x, i = heap[0]
        heapq.heapreplace(heap, (x + 7, i))
        want[i] += 1
    assert sharding.deal_run(list(loads), 7, n) == want


def test_warc(spark):
    pages = [(5, "http://b.example.com/x y?q=1#f", "<p>one</p>"), (2, "http://a.example.com/", "<p>one</p>"), (3, None, None), (4, "http://[bad", ""), (None, "http://a.example.com/", "<p>one</p>"), (9, "http://b.example.com/x", "é" * 50_000), (9, "http://b.example.com/x", "é" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, h in pages:
        same = [p for p, _, x in pages if (x or "") == (h or "") and p is not None]
        first = min(same)
        b = (h or "").encode()
        want.append((i, len(b), warc.sha1_base32(b), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0
    index = warc.build_index(warc.write_archive(df), lines=2, parts=2)
    found = warc.read_records(warc.lookup(index, warc.capture_keys(df.filter("page_id = 5"))), with_payload=True).collect()
    assert [bytes(r["payload"]) for r in found] in ([b""], [b"<p>one</p>"])


def test_base_stats(docs, rows):
    got = {r["doc_id"]: r for r in text_stats.with_stats(docs, "text", ("doc_id",)).collect()}
    for i, t, *_ in rows:
        w = split(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        covered = {p for k, g in enumerate(grams) if n[g] > 1 for p in range(k, k + 5)}
        s = got[i]["stats"]
        assert (s["n_words"], s["word_chars"], s["n_repeat_words"]) == (len(w), len("".join((t or "").split())), len(covered))


def test_quality_rules(spark, docs, none):
    rng = random.Random(1)
    table = [(i, words(rng, 60) if i % 3 else "*** " * 5 + words(rng, 20).replace(" ", "### "), "en", "s", 0, None, None, None) for i in range(300)]
    some = spark.createDataFrame(table, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(250)] + [(7, None, None), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(some, labels).collect()}
    assert sum(got[i] == (i % 3 > 0) for i in range(300)) >= 297
    empty = labels.limit(0)
    assert all(r["kept"] == (len(split(t[1])) >= 10) for t, r in ((next(x for x in table if x[0] == r["doc_id"]), r) for r in quality_rules.judge(some, empty).collect()))
    assert quality_rules.keep_good(docs, empty).columns == docs.columns
    assert quality_rules.judge(none, empty).count() == 0


def test_quality_classifier(spark, none):
    rng = random.Random(2)
    table = [(i, words(rng, 50) if i % 4 else words(rng, 50).replace(" ", "!! ").upper(), "en", "s", 0, None, None, None) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality_classifier.score(spark.createDataFrame(table, SCHEMA), labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(none, labels.limit(0)).count() == 0


def test_substring_dedup(docs, rows, none):
    first = {}
    for i, t, *_ in rows:
        w, d = split(t), substring_dedup.LAST if i is None else i
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, d), d)
    want = Counter()
    for i, t, *_ in rows:
        w, d = split(t), substring_dedup.LAST if i is None else i
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for p in range(k, k + 13)}
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())] += 1
    for df in (docs, docs.repartition(3)):
        got = substring_dedup.remove_repeats(df, 13, chunk_rows=4).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(5)
    items = [(k, words(rng, n)) for k, n in enumerate((30, 45, 20, 3))] + [(8, None), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = [(1, words(rng, 100) + " " + items[0][1] + " " + words(rng, 9)), (2, items[1][1].upper()), (3, words(rng, 80)), (4, None), (5, items[2][1].rsplit(" ", 1)[0] + " other"), (6, "x " + items[3][1] + " y"), (7, " ".join(items[0][1].split()[:10]))]
    got = decontamination.find_leaks(spark.createDataFrame(table, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 0), (2, 1), (5, 2), (6, 3)}
    kept = decontamination.drop_leaking(spark.createDataFrame(table, "doc_id long, text string"), bench, at_once=2)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7]
    assert decontamination.find_leaks(none, bench).count() == 0
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_searches_every_item(spark):
    rng = random.Random(6)
    items = [(1, words(rng, 30)), (1, words(rng, 30)), (None, words(rng, 30)), (None, words(rng, 25)), (2, words(rng, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    table = [(k, words(rng, 20) + " " + text) for k, (_, text) in enumerate(items)] + [(9, words(rng, 60))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for at_once in (2, 100):
        got = decontamination.find_leaks(docs, bench, at_once=at_once).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 1), (1, 1), (2, None), (3, None), (4, 2)} and len(got) == 5
        assert [r["doc_id"] for r in decontamination.drop_leaking(docs, bench, at_once=at_once).collect()] == [9]


def test_toxicity(spark, none):
    rng = random.Random(6)
    table = [(i, words(rng, 80) + (" vile" * (1 + i % 5) + " Scum!" if i % 6 == 0 else "")) for i in range(500)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(500)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, labels).collect()}
    assert sum(got[i]["toxic"] == (i % 6 == 0) for i in range(500)) >= 495 and got[1000]["toxic"] == 0
    assert all(0 <= r["severity"] <= 3 for r in got.values())
    assert all(r["toxic"] == 0 for r in toxicity.score(df, labels.limit(0)).collect())
    assert toxicity.score(none, labels).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.plan_mix(docs).collect()
    again = mixing.plan_mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["copies"] <= 2 and r["target"] <= 2 * r["source_size"]
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got)
    assert mixing.plan_mix(none).count() == 0


def test_simhash(docs, rows, none):
    def slow(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [(r[0], slow(r[1])) for r in rows]
    root = list(range(len(prints)))
    for _ in prints:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    least = {}
    for (i, _), c in zip(prints, root):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = Counter((i, f"{x:016x}", least.get(c)) for (i, x), c in zip(prints, root))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(docs).collect()) == want
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.drop_near_duplicates(docs, 5)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and 8 not in ids and 9 not in ids and 12 not in ids and ids.count(4) == 1


def test_golay_covers_two_errors():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    y = x.copy()
    for row in range(len(x)):
        for b in rng.choice(23, rng.integers(0, 3), replace=False):
            y[row] ^= 1 << b
    a, b = simhash_dedup.segment_keys(x), simhash_dedup.segment_keys(y)
    assert all(set(p[p >= 0]) & set(q[q >= 0]) for p, q in zip(a, b))


def test_close_pairs_connect_all():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 62, 1).astype(np.uint64)
    prints = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)), rng.integers(0, 1 << 62, 50).astype(np.uint64)]))
    a, b = simhash_dedup.close_pairs(np.zeros(len(prints), np.uint32), prints)
    root = {p: p for p in prints.tolist()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for u, v in zip(a.tolist(), b.tolist()):
        root[max(find(u), find(v))] = min(find(u), find(v))
    for i, u in enumerate(prints.tolist()):
        for v in prints.tolist()[i + 1 :]:
            if (u ^ v).bit_count() <= 4:
                assert find(u) == find(v)


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><a href='/'>Home</a></nav><div class=\"ad banner\">Buy</div>{0}<aside>More</aside><form>Say <input></form><section id='comments'><p>Nice!</p></section><footer>&copy; me</footer></body></html>"


def test_html(spark):
    article = "<article><h1>Big &amp; bold</h1><p>One <b>two</b>three<p>four\n five&nbsp;six<br>x<div class='share'>Tweet</div></article>"
    plain = "<div>Menu line</div><p>Own {0} text.</p><p>Bottom line</p>"
    # the sharing line of the article goes because its nearest page, /b/1, shares it
    pages = [(1, "http://h.com/a/1", PAGE.format(article)), (2, "http://h.com/b/1", PAGE.format(plain.format("first") + "<div class='share'>Tweet</div>")), (3, "http://h.com/b/2", PAGE.format(plain.format("second"))), (4, None, None), (5, "http://h.com/c", "just text &lt;"), (6, "http://h.com/d", ""), (7, "http://i.com/", PAGE.format(article)), (8, "http://i.com/", PAGE.format(article))]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = "Big & bold One twothree four five six x"
    assert got[1] == (want, len(want)) and got[7] == got[8] == (f"{want} Tweet", len(want) + 6)
    assert got[2][0] == "Own first text." and got[3][0] == "Own second text."
    assert got[4] == got[6] == ("", 0) and got[5][0] == "just text <"


def test_shared_lines():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(0, 9))], [rng.randint(0, 5) for _ in range(rng.randint(0, 9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = html_text.shared_lines(a, b)
        assert len(got) == table[-1][-1] and got == sorted(got)
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in got)


def test_links_are_verified_before_thinning(spark):
    """A twin survives decoys that are closer in single lanes, and large groups whose members aren't similar."""
    rng = np.random.default_rng(5)
    most, lanes = 110, simhash_dedup.LANES

    def flipped(row, lane, bits):
        row[lane] ^= np.uint64(sum(1 << int(b) for b in bits))

    x = rng.integers(0, 1 << 64, lanes, np.uint64)
    y = x.copy()
    flipped(y, 1, [0, 50])
    for k in range(2, lanes):
        flipped(y, k, range(12))  # too far in the first segment to share a key there
    decoy = rng.integers(0, 1 << 64, lanes, np.uint64)
    decoy[:2] = x[:2]
    far = x.copy()
    flipped(far, 1, range(22))
    for k in range(2, lanes):
        flipped(far, k, range(12, 22))
    few = [x, y, decoy]
    family = [x, far]
    for _ in range(80):
        row = rng.integers(0, 1 << 64, lanes, np.uint64)
        row[0] = x[0]
        family.append(row)
    for rows, a, b in ((few, 0, 1), (family, 0, 1)):
        df = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(rows)], "fp long, lanes binary")
        assert int(np.bitwise_count(rows[a] ^ rows[b]).sum()) <= most
        for count in (len(rows), 3_000_000):  # few ranges of keys in a lane, and more
            assert [tuple(r) for r in simhash_dedup.similar_links(df, count, lanes, most).collect()] == [(a, b)]


@pytest.mark.parametrize("n", [2, 40, 150])
def test_verified_forest_connects_all(n):
    rng = np.random.default_rng(n)
    rows = np.repeat(rng.integers(0, 1 << 64, (1, 10), np.uint64), n, 0)
    rows ^= np.packbits(rng.random((n, 10, 64)) < rng.uniform(0.02, 0.16, (n, 1, 1)), axis=2).view(np.uint64)[:, :, 0]
    a, b = simhash_dedup.verified_forest(np.zeros(n, np.int64), np.arange(n), rows, 110)
    linked = np.bitwise_count(rows[:, None] ^ rows).sum(axis=2) <= 110

    def classes(pairs):
        root = list(range(n))
        for u, v in pairs:
            root = [root[u] if r == root[v] else r for r in root]
        return {frozenset(i for i in range(n) if root[i] == r) for r in root}

    assert all(linked[a, b]) and classes(zip(a, b)) == classes(np.argwhere(linked))


def test_near_duplicates_are_judged_exactly(spark, tmp_path, monkeypatch):
    """Pairs at Jaccard 0.82 are linked and pairs at 0.74 aren't, in one block and in many."""
    rng, table, want = random.Random(11), [], set()

    def changed(text, places):
        own = text.split()
        for k in places:
            own[k] = f"new{rng.randint(0, 10**9)}"
        return " ".join(own)

    for i in range(0, 240, 4):
        base = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(104))
        table += [(i, base), (i + 1, changed(base, (20, 60))), (i + 2, changed(base, (10, 40, 80)))]
        want |= {i, i + 2}
    spark.createDataFrame(table, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for block in (simhash_dedup.BLOCK, 1):
        monkeypatch.setattr(simhash_dedup, "BLOCK", block)
        assert {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs, 5).collect()} == want


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_exact_forest_connects_all(least):
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(14, rng.integers(1, 14), replace=False).astype(np.uint64)) for _ in range(60)]
    links = {(i, j) for i in range(60) for j in range(60) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= least}

    def classes(pairs):
        root = list(range(60))
        for u, v in pairs:
            root = [root[u] if r == root[v] else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    got = simhash_dedup.exact_forest(sets, least)
    assert set(got) <= links and classes(got) == classes(links)
