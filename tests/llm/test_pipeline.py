"""The pipeline's stages on a small table: decisions take effect and clean documents stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)

    def text(n):
        return " ".join(rng.choice("bcdf") + rng.choice("aeiou") + str(rng.randint(0, 999)) for _ in range(n))

    item = text(30)
    clean = [(i, text(60 + i)) for i in range(40)]
    near = clean[0][1].split()
    near[30] = "changed"
    docs = [*clean, (100, clean[0][1]), (101, " ".join(near)), (102, text(40) + " " + item + " " + text(5)), (103, "too short"), (104, None), (105, "a b c d e f " * 20)]
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in docs]
    for name, df in {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    assert seen[0] == [*range(40), 100, 101, 102]
    assert seen[1] == [*range(40), 102]
    assert seen[2] == list(range(40))
    assert set(seen[3]) <= set(range(40)) and seen[4] == seen[3]
    assert {"shard", "slot"} <= set(docs.columns)
