"""The methods themselves, against plain versions: schedules, samples, indexes, models and alignments."""

import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgraph.llm import common, decontamination, html_text, mixing, quality_classifier, quality_rules, sharding, simhash_dedup, substring_dedup, text_stats, toxicity, warc
from kgraph.llm.components import components


def words(rng, n, vocabulary=400):
    return " ".join(rng.choice("ab") + rng.choice("cdefg") * rng.randint(1, 4) + str(rng.randint(0, vocabulary)) for _ in range(n))


# Shared parts


def test_numbers_over_many_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xxxxy"), rng.randint(0, 3), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    got = {r["b"]: r["n"] for r in common.dense_rank_in(df, ["g"], ["a", "b"], 300, "n", per=10).collect()}
    for g in "xy":
        assert [got[b] for _, _, b in sorted(r for r in rows if r[0] == g)] == list(range(sum(r[0] == g for r in rows)))


def test_join_of_hot_keys(spark):
    left = [(1, i) for i in range(500)] + [(k, 1000 + k) for k in range(2, 40)] + [(99, 5)]
    right = [(k, sum(x == k for x, _ in left), f"v{k}") for k in range(1, 40)]
    a, b = spark.createDataFrame(left, "k long, i long"), spark.createDataFrame(right, "k long, n long, v string")
    got = common.join_hot(a, b, ["k"], "n", len(left), share=20)
    assert Counter(map(tuple, got.collect())) == Counter((k, i, sum(x == k for x, _ in left), f"v{k}") for k, i in left if k != 99)


def test_components_with_a_hub(spark):
    rng = random.Random(2)
    links = [(0, i) for i in range(1, 200)] + [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)] + [(7, 7), (None, 3)]
    root = {x: x for pair in links for x in pair if x is not None}
    for _ in root:
        for a, b in links:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in p and p[0] != p[1] and None not in p for p in links)}
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Sharding


def test_whole_schedule_is_the_heaps(spark):
    rng = random.Random(3)
    texts = ["x" * rng.randint(0, 60) + rng.choice("abc") for _ in range(150)] + ["copy"] * 40 + [None] * 7 + [""] * 3 + ["tie a", "tie b"]
    got = sharding.assign_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    shard = {r["doc_id"]: r["shard"] for r in got}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t].append(i)
    sizes = {t: len(ids) * (len((t or "").encode()) + 1) for t, ids in groups.items()}
    heap = [(0, s) for s in range(5)]
    dealt = Counter()
    for size in sorted(sizes.values(), reverse=True):
        load, s = heapq.heappop(heap)
        dealt[(size, s)] += 1
        heapq.heappush(heap, (load + size, s))
    assert Counter((sizes[t], shard[ids[0]]) for t, ids in groups.items()) == dealt
    assert all(len({shard[i] for i in ids}) == 1 for ids in groups.values())
    for s in range(5):
        assert [r["doc_id"] for r in sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])] == sorted(i for i in shard if shard[i] == s)


# WARC


def test_many_repeats_are_joined_without_payloads(spark):
    pages = [(i, f"http://h.com/{i}", f"<p>{i % 7}</p>" if i % 5 else None, "dg", i % 3, "first") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, dg string, first int, payload string")

    def result(**options):
        return sorted(tuple(r) for r in warc.read_records(warc.write_archive(df, **options)).collect())

    assert result() == result(most_broadcast=0)


# Quality


def test_counts_and_list_are_the_plain_ones(spark):
    rng = random.Random(4)
    lines = [words(rng, rng.randint(1, 6), 5) for _ in range(12)] + ["", "   ", "# * $ | < >", "&&&"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    texts = [t if i % 3 else words(rng, 30).replace(" ", "## ") for i, t in enumerate(texts)] + [None, "", "é ü# 漢字", words(rng, 30_000)]
    labels = spark.createDataFrame([(i, int((t or "").count("#") < 50), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stats = text_stats.with_stats(df, "text", ("doc_id",))
    rules = quality_rules.learn_from(stats, labels)
    x, _ = text_stats.labelled(stats, labels, "quality", 10_000)
    rejected = np.zeros(len(texts), bool)
    for rule in rules:
        rejected |= quality_rules.covers(rule, x)
    got = sorted(quality_rules.judge(df, labels).collect(), key=lambda r: r["doc_id"])
    for r, t, bad in zip(got, texts, rejected):
        w = (t or "").split()
        full = [x for x in (t or "").split("\n") if x.strip()]
        assert r["stats"]["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["stats"]["word_chars"] == sum(map(len, w))
        assert r["stats"]["n_dup_lines"] == len(full) - len(set(full))
        failed = len(w) < 10 or 100 * r["stats"]["n_repeat_words"] > 20 * len(w)
        assert r["base_failed"] == failed and r["kept"] == (not failed and not bad)
    assert rules


def test_ensemble_as_a_column_predicts_the_same(spark):
    rng = random.Random(5)
    texts = [words(rng, 40).replace(" ", "! " if i % 3 else " ") + (" |" * (i % 11)) for i in range(300)] + [None, ""]
    stats = common.save(text_stats.with_stats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", ("doc_id",)), "stats")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(300)] + [(1, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    x, y = text_stats.labelled(stats, labels, "quality", 10_000)
    model = quality_classifier.fit(x, y)
    assert 0 < len(model.rules) < 200
    got = [r["v"] for r in stats.filter("doc_id < 300").orderBy("doc_id").select(model.column().alias("v")).collect()]
    assert np.allclose(got, model.predict(x), atol=1e-12)


def test_lasso_is_at_its_minimum():
    rng = np.random.default_rng(6)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 3] - 0.2)))).astype(float)
    w, b = quality_classifier.lasso(r, y, 0.02, 2000)
    slope = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / 400
    assert (np.abs(slope[w == 0]) <= 0.02 + 1e-4).all() and np.allclose(slope[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4) and (w == 0).sum() >= 6


# Toxicity


def test_ordinal_fit_is_a_minimum_of_the_plain_loss():
    rng = np.random.default_rng(7)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(300)]
    z = np.array([sum((2.0, 1.0, 0, 0, -1.0, 0.5)[f] for f in r) for r in rows])
    grades = (z[:, None] + rng.logistic(size=(300, 1)) > np.array([0.5, 1.5, 2.5])).sum(1)
    weights, thresholds = toxicity.fit(rows, grades, 6, steps=3000)

    def loss(w, t):
        up = [[1.0] + [1 / (1 + math.exp(-(sum(w[f] for f in r) - k))) for k in t] + [0.0] for r in rows]
        return -sum(math.log(max(u[g] - u[g + 1], 1e-12)) for u, g in zip(up, grades)) / 300 + 1e-4 * float(np.sum(np.square(w)))

    least = loss(weights, thresholds)
    assert list(thresholds) == sorted(thresholds)
    for i in range(9):
        for step in (-0.05, 0.05):
            w, t = weights.copy(), thresholds.copy()
            (w if i < 6 else t)[i % 6 if i < 6 else i - 6] += step
            assert loss(w, t) > least - 1e-5


def test_severity_is_the_models(spark):
    rng = random.Random(8)
    texts = [words(rng, 30) + " scum" * (i % 4) for i in range(60)] + [None, "", "SCUM, scum!"]
    picked = {f: i for i, f in enumerate(toxicity.token_features("scum"))}
    model = toxicity.Ordinal(picked, np.linspace(0.5, 1.5, len(picked)), np.array([1.0, 2.0, 3.5]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], None, None)], "doc_id long, text string, severity string, grade int")
    got = toxicity.grade(df, model).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        z = sum(model.weights) if "scum" in (texts[r["doc_id"]] or "").lower() else 0.0
        up = [1 / (1 + math.exp(-(z - t))) for t in model.thresholds]
        assert abs(r["severity"] - sum(up)) < 1e-9 and r["grade"] == sum(u >= 0.5 for u in up) and r["toxic"] == (r["grade"] >= 1)


def test_many_labels_are_joined_without_texts(spark, tmp_path):
    spark.createDataFrame([(i % 50, f"text {i}", 1) for i in range(70)] + [(None, "x", 1)], "doc_id long, text string, label int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "_label_id long, label int")
    few, many = (toxicity.with_labels(docs, labels, labels.count(), "doc_id", "text", n) for n in (1000, 0))
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, many.collect())) and few.columns == many.columns
    none = toxicity.score(docs, spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int"))
    assert none.count() == 71 and none.filter("toxic = 1").count() == 0


# Mixing


def plain_targets(sizes, weights, share, ceiling):
    named = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    fixed = {}
    while True:
        rest = [s for s in named if s not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        now = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if now[s] > ceiling * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: ceiling * sizes[s] for s in over}


def test_copies_are_crossed_integers(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.choice((5, 5, 9, rng.randint(1, 60)))), rng.choice(["big", "big", "big", "b", None, "z"])) for i in range(300)]
    rows += [(300 + i, None if i % 2 else " ", "void") for i in range(6)] + [rows[4], (None, "one two", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan_mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes, (5, 2, 1), 1.5, 2.0)
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want) and want["void"] == 0
    key = F.xxhash64("doc_id", "text")
    offset = F.pmod(F.xxhash64(F.lit(7), F.col("source").isNull(), F.coalesce("source", F.lit(""))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    hashed = df.select("doc_id", "source", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("n"), key.alias("tie"), offset.alias("offset")).collect()
    copies = Counter()
    for s in sizes:
        rate, total = want[s] / sizes[s] if sizes[s] else 0.0, 0.0
        for k, r in enumerate(sorted((r for r in hashed if r["source"] == s), key=lambda r: (r["n"], r["tie"]))):
            copies[(r["doc_id"], s)] += math.floor((k + 1) * rate + r["offset"]) - math.floor(k * rate + r["offset"])
    found = Counter()
    for r in got:
        found[(r["doc_id"], r["source"])] += r["copies"]
    assert found == copies
    for s in sizes:
        assert abs(sum(r["copies"] * r["size"] for r in got if r["source"] == s) - want[s]) <= 2 * max(r["size"] for r in got if r["source"] == s)


# Substring removal


def test_small_chunks_ranges_and_merges_change_nothing(spark, tmp_path):
    rng = random.Random(10)
    common_words = words(rng, 40)
    rows = [(i, words(rng, rng.randint(0, 60)) + (f" {common_words} " if i % 3 == 0 else " ") + words(rng, 20)) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    one = sorted(map(str, substring_dedup.remove_repeats(docs).collect()))
    other = sorted(map(str, substring_dedup.remove_repeats(docs, chunk_rows=16, chunk_words=150, windows_per_range=20).collect()))
    assert one == other and sum(r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()) == 40 * (27 - 1)


def test_merging_a_few_blobs_at_a_time():
    rng = np.random.default_rng(11)
    blobs, plain = [], []
    for _ in range(12):
        high, low, ids = rng.integers(0, 40, 60).astype(np.uint64), rng.integers(0, 2, 60).astype(np.uint16), rng.integers(0, 9, 60)
        order = np.lexsort((low, high))
        high, low, ids = high[order], low[order], ids[order]
        blobs.append(substring_dedup._pack(high, low, ids))
        plain.append(list(zip(high.tolist(), low.tolist(), ids.tolist())))
    least = {}
    for h, lo, i in (x for p in plain for x in p):
        least[(h, lo)] = min(least.get((h, lo), i), i)
    for at_once in (10, 10_000):
        got = list(substring_dedup.earlier_elsewhere(blobs, at_once))
        assert [g.tolist() for g in got] == [[i > least[(h, lo)] for h, lo, i in p] for p in plain]


# Decontamination


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(12)
    prints = rng.integers(0, 1 << 64, 300, np.uint64)
    near = prints[:150].copy()
    for i in range(150):
        for b in rng.choice(64, rng.integers(0, 26), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    query = np.concatenate((near, rng.integers(0, 1 << 64, 100, np.uint64)))
    got = set(zip(*(x.tolist() for x in decontamination.MultiIndex(prints).find(query))))
    assert got == {(i, j) for i, x in enumerate(query) for j, y in enumerate(prints) if int(x ^ y).bit_count() <= decontamination.RADIUS}


def test_matches_are_those_of_all_windows_and_items():
    rng = random.Random(13)
    items = [(k, words(rng, rng.choice((3, 5, 8, 20, 20, 35)), 60)) for k in range(25)]
    items += [(3, items[7][1]), (None, items[8][1].upper() + "!"), (50, None), (51, " ")]
    matcher = decontamination.Matcher(decontamination.Items(items))
    plain = [[decontamination.plain(w.encode()) for w in (t or "").split()] for _, t in items]
    found = 0
    for _ in range(100):
        own = words(rng, rng.randint(0, 60), 60).split()
        for _ in range(rng.randint(0, 3)):
            part = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.choice((0, 0, 1))):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(("x", "y", "z"))
            own[len(own) // 2 : len(own) // 2] = part
        doc, want = [decontamination.plain(w.encode()) for w in own], {}
        for k, item in enumerate(plain):
            width = min(5, len(item))
            if not item or len(doc) < width:
                continue
            weight = Counter(tuple(item[i : i + width]) for i in range(len(item) - width + 1))
            span = min(len(item), len(doc))
            for at in range(len(doc) - span + 1):
                w = Counter(tuple(doc[i : i + width]) for i in range(at, at + span - width + 1))
                shared = sum((w & weight).values())
                s = shared / (sum(w.values()) + sum(weight.values()) - shared)
                if s >= 0.8 and s > want.get(k, (0, 0))[1]:
                    want[k] = (at, s)
        got = [(i, at, s) for i, at, _, _, s in matcher.leaks(" ".join(own))]
        assert got == [(items[k][0], at, pytest.approx(s)) for k, (at, s) in sorted(want.items())]
        found += len(got)
    assert found > 30


def test_stage_keeps_odd_rows_and_columns(spark):
    rng = random.Random(14)
    item = words(rng, 30)
    rows = [(1, "a " + item, 7), (1, "a " + item, 7), (None, words(rng, 50), 8), (2, None, 9), (2, "", 9), (3, words(rng, 40_000) + " " + item, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t long").withColumnRenamed("t", "c1")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, decontamination.drop_leaking(df, bench).collect())) == sorted(map(str, df.filter("c1 in (8, 9)").collect()))
    assert decontamination.drop_leaking(df.limit(0), bench).columns == df.columns
    assert Counter(r["doc_id"] for r in decontamination.find_leaks(df, bench).collect()) == Counter({1: 2, 3: 1})


# Near-duplicates


def test_planted_pairs_by_similarity(spark, tmp_path):
    """Pairs at a Jaccard similarity of 0.9 and 0.82 lose a member, pairs at 0.7 don't."""
    rng = random.Random(15)
    rows, twin = [], {}
    for i in range(180):
        base = [f"w{rng.randint(0, 10**9)}" for _ in range(204)]
        other, changed = list(base), (2, 4, 7)[i % 3]  # each change touches five of 200 shingles
        for k in range(changed):
            other[10 + 28 * k] = f"n{rng.randint(0, 10**9)}"
        same = 200 - 5 * changed
        twin[2 * i + 1] = same / (400 - same)
        rows += [(2 * i, " ".join(base), "s"), (2 * i + 1, " ".join(other), "s")]
    spark.createDataFrame(rows, "doc_id long, text string, stays string").write.parquet(str(tmp_path / "d"))
    kept = {r["doc_id"] for r in simhash_dedup.drop_near_duplicates(spark.read.parquet(str(tmp_path / "d")), 5).collect()}
    high = [i for i, s in twin.items() if s >= 0.8]
    assert len(high) == 120 and sum(i not in kept for i in high) >= 0.95 * len(high)
    assert all(i in kept for i, s in twin.items() if s < 0.8) and all(2 * i in kept for i in range(180))


# Pages


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_alignment_in_halves_is_a_longest_one(monkeypatch):
    monkeypatch.setattr(html_text, "TABLE_CELLS", 6)
    rng = random.Random(16)
    for _ in range(150):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for _ in "ab")
        got = html_text.shared_lines(a, b)
        at = iter(b)
        assert got == sorted(set(got)) and len(got) == lcs_length(a, b) and all(any(a[i] == y for y in at) for i in got)


def test_alignment_of_very_long_pages():
    a = [i % 977 if i % 3 else -i for i in range(30_000)]
    b = [i % 977 if i % 4 else -(10**6) - i for i in range(30_000)]
    assert len(html_text.shared_lines(a, b)) >= 14_000


def test_nearest_page_of_each_host(spark, monkeypatch):
    """Pairs and deleted lines against a search among all pages, over many parts, with copies and ties."""
    monkeypatch.setattr(html_text, "PART_ROWS", 5)
    rng = random.Random(17)
    pages = []
    for i in range(120):
        host = rng.choice(("h.com", "h.com", "g.org"))
        path = "/".join(rng.choice(("a", "b", "cc")) for _ in range(rng.randint(1, 4))) + (f"?q={rng.randint(0, 3)}" if i % 4 == 0 else "")
        lines = [f"line {rng.randint(0, 12)}" for _ in range(rng.randint(1, 7))]
        pages.append((i, f"http://{host}/{path}", "".join(f"<p>{x}" for x in lines)))
    pages += [(200 + k, pages[5][1] + f"&copy={k}", pages[5][2]) for k in range(30)] + [(300, None, "<p>line 1"), (301, None, "<p>line 1<p>x"), (302, "http://lone.com/", "<p>line 2"), (303, "http://h.com/a", None)]
    df = spark.createDataFrame([(*p, "f", 1, []) for p in pages], "page_id long, url string, html string, file string, row long, lines array<long>")
    got = {r["page_id"]: r for r in html_text.extract_text(df).collect()}
    lists = {}
    for i, url, page in pages:
        key, lines = warc.url_key(url), tuple(b.text for b in html_text.blocks(page))
        host = key.partition(")")[0]
        if lines:
            lists[(host, lines)] = min(lists.get((host, lines), key), key)
    decided = 0
    for i, url, page in pages:
        lines = tuple(b.text for b in html_text.blocks(page))
        host = warc.url_key(url).partition(")")[0]
        own = lists.get((host, lines))
        others = [(html_text.common_start(k, own), o, k) for (h, o), k in lists.items() if h == host and o != lines] if lines else []
        best = max((s for s, _, _ in others), default=None)
        near = [o for s, o, _ in others if s == best]
        gone = [set(html_text.shared_lines(*([hash(x) for x in y] for y in (lines, o)))) for o in near] or [set()]
        texts = {" ".join(x for k, x in enumerate(lines) if k not in g) for g in gone}
        assert got[i]["text"] in texts, (i, url)
        assert got[i]["n_chars"] == len(got[i]["text"])
        decided += got[i]["n_decided"]
    assert decided == sum(r["n_shared"] for r in got.values()) > 50
    assert all(got[200 + k]["text"] == got[5]["text"] for k in range(30)) and got[302]["text"] == "line 2"
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_structure_corrects_differencing():
    page = (
        "<div>Menu</div><article><header><h1>Own title</h1>By staff</header><p>Shared passage.<p>Own.<figure><figcaption>A caption</figcaption></figure><math><mi>x</mi></math>"
        "<div class='share-tools'>Tweet</div><div class='search-history'>Kept</div><div class='ad'>Buy</div></article><div>Own but outside</div>"
    )
    own = html_text.blocks(page)
    at = {b.text: i for i, b in enumerate(own)}
    shared = {at[x] for x in ("Menu", "By staff", "Shared passage.", "Tweet")}
    kept, decided = html_text.main_text(own, shared)
    assert " ".join(kept) == "Own title Shared passage. Own. A caption x Kept" and decided == 2
    assert html_text.main_text(html_text.blocks("<div>Menu</div><p>Own<div class=ad>x</div>"), {0})[0] == ["Own"]
    long = "<p>" + "y " * 300_000
    assert html_text.main_text(html_text.blocks(long), set())[0] == [("y " * 300_000).strip()]
