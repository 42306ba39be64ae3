import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from meldframe.llm import hashing_index  # noqa: E402


def exact(rows, near=20):
    ids = np.array([i for i, v in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in sorted({i for i in ids if i % 20 == 0}):
        s = (x * x[list(ids).index(i)]).sum(1)
        keep = np.flatnonzero(ids != i)
        best = keep[np.lexsort((ids[keep], -s[keep]))[:near]]
        out[i] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 24))
    x = (centres[rng.integers(0, 8, 1500)] + 0.7 * rng.normal(size=(1500, 24))) * rng.uniform(0.5, 2, (1500, 1))
    x[40:60] = x[40]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hashing_index.search(df, F.col("vec_id") % 20 == 0, rows=400, queries=30).collect()
    want, hits = exact(rows), 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, best in want.items():
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(abs(m[2] - float(np.dot(np.float64(x[q].astype(np.float32)), np.float64(x[m[1]].astype(np.float32))))) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & {v for v, _ in best})
    assert hits >= 0.9 * 20 * len(want)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [1.0, None]), (None, [1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (100, [float("inf"), 1.0]), (5, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"r": F.lit(1), "v": F.lit("x"), "score": F.lit(2)})
    got = [tuple(r) for r in hashing_index.search(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 5, 0.5)]
    assert hashing_index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert hashing_index.search(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_probing_filters_and_holds_all_within_radius():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, 2000)] + 0.1 * rng.normal(size=(2000, 64))
    codes = hashing_index.fit(x, float(np.linalg.norm(x, axis=1).max()))
    block = hashing_index.Block(codes, np.arange(2000), x)
    assert codes.substrings == 33 and block.code.shape[1] == 40
    for code in codes.encode(x[:20], True):
        for radius in (0, 20, 32, 33, 70):
            got = set(block.probed(code, radius).tolist())
            assert got >= set(np.flatnonzero(hashing_index.hamming(block.code, code) <= radius).tolist())
            assert len(got) < 2000 or radius > 32
            near = (hashing_index._NEAR[block.code[:, :33], code[:33]] <= radius // 33).any(1)
            assert got == set(np.flatnonzero(near).tolist())


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(1)
    text = lambda n: " ".join("".join(rng.choices(["the", "ing", "er", "on", "at"], k=3)) for _ in range(n))
    item = text(40)
    rows = [(i, text(60), "en", "s", 1) for i in range(120)]
    rows += [(200 + i, f"{text(40)} vile filth {text(10)} vile", "en", "s", 1) for i in range(40)]
    rows += [(300, rows[3][1], "en", "s", 1), (301, rows[4][1] + " tail", "en", "s", 1), (302, f"{text(30)} {item} {text(5)}", "en", "s", 1), (303, None, "en", "s", 1), (304, "123 !!", None, "s", 1), (305, "", "en", "s", 1)]
    labels = [(d, 1, int(200 <= d < 300)) for d, *_ in rows if d < 300]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), at).count() == 0
    got = pipeline.run(spark, at)
    assert {r["doc_id"] for r in got.collect()} == set(range(120))
    assert got.columns == ["doc_id", "n_tokens", "ids"]


def test_pipeline_language_stage_rejects_other_text(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import random

    rng = random.Random(5)
    parts = {"en": ["the", "ing", "er", "on", "at"], "de": ["sch", "ein", "ung", "der", "ch"]}
    text = lambda k, n: " ".join("".join(rng.choices(parts[k], k=2)) for _ in range(n))
    rows = [(i, text(k, 3 if i % 10 == 0 else 50), k) for i in range(200) for k in [("en", "de")[i % 2]]]
    noise = lambda n: "".join(rng.choices("bcdfgjkpqvwxz ", k=n))
    rows += [(1000 + i, noise(300), None) for i in range(5)] + [(1100, "Все люди рождаются свободными и равными в своем достоинстве и правах", None), (1101, noise(60), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in pipeline.language(spark, docs, str(tmp_path)).collect()} == set(range(200))


def test_pipeline_dedup_leaves_one_of_repeated_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    rows = [(1, text(1), "b")] * 3 + [(1, text(1), "a"), (2, text(2), "a"), (3, text(2), "a"), (3, text(2), "a")]
    rows += [(None, text(4), "a")] * 2 + [(None, text(5), "a"), (None, None, "a"), (6, None, "a"), (7, "", "a"), (8, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = pipeline.dedup(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    want = [(1, text(1), "a"), (2, text(2), "a"), (None, text(4), "a"), (None, text(5), "a"), (None, None, "a"), (6, None, "a"), (7, "", "a"), (8, "", "a")]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
