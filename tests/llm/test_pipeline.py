"""The pipeline's registration and its stages on the smallest test tables."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in entry.queries() if n.startswith("op") and "_" in n and n[2:n.index("_")].isdigit()]
    assert sorted(int(n[2:n.index("_")]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(cp.STAGES) == 5


def test_stages_keep_columns_and_drop_only_what_they_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF)
    assert out.columns[:len(docs.columns)] == docs.columns and out.where("copies < 1").count() == 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert out.count() == out.select("doc_id").distinct().count()


def test_near_duplicate_stage_matches_brute_force(spark):
    rows = []
    for base in range(40):
        rng = np.random.default_rng(base)
        w = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        rows.append((10 * base, " ".join(w)))
        for copy in range(1, 4):
            for at in rng.choice(np.arange(5, 95), int(rng.integers(1, 5)), replace=False):
                w[at] = f"x{base}y{copy}z{at}"
            rows.append((10 * base + copy, " ".join(w)))
    sets = {i: {tuple(t.split()[n:n + 5]) for n in range(96)} for i, t in rows}
    least, between = {i: i for i in sets}, 0
    for i in sorted(sets):
        for j in (j for j in sets if j < i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            between += 0.8 <= share < 0.9
            if share >= 0.8:
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.near_duplicate_stage(spark, docs, SF).collect()
    assert between > 20 and sorted(r.doc_id for r in got) == sorted(set(least.values()))


def test_decontamination_stage_drops_rows_not_ids(spark, tmp_path):
    item = " ".join(f"w{x}" for x in np.random.default_rng(1).integers(0, 5000, 30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "a " + item), (None, "clean"), (None, None), (5, item + " b"), (5, "clean too"), (6, item), (7, "other")]
    got = cp.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, "clean"), (None, None), (5, "clean too"), (7, "other")], key=str)
