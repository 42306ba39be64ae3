"""Operators that SQL can't express, held against plain Python on small tables, and their odd cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from meldframe.llm import chat, common, components, decontaminate, hashing_index, idcoder, langid, licences, pieces, quality, textvec, toxicity  # noqa: E402

from .test_text import ODD, SCHEMA, brute_components, edit, words  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_toxicity_scores(spark):
    rng = np.random.default_rng(1)
    said = ["vile", "filth", "kind", "élan", "a"]
    hashes = np.array([textvec.bytes_hash(w.encode()) for w in said], np.uint64)
    order = np.argsort(hashes)
    weight = rng.normal(0, 2, len(said))
    model = toxicity.OrdinalModel(hashes[order], weight[order], np.array([0.5, 1.5, 3.0]))
    pick = random.Random(2)
    rows = [(i, " ".join(pick.choices([*said, "VILE", "Élan", "other", "x1vile", "filth!"], k=pick.randrange(9)))) for i in range(60)] + [(60, None), (61, ""), (None, "vile"), (0, "again vile"), (62, "vile " * 20_000)]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit("x")), model).collect()
    want = []
    for d, t in rows:
        held = re.findall(r"[^\W\d_]+", (t or "").lower())
        score = sum(w * math.log1p(held.count(x)) for x, w in zip(said, weight, strict=True) if x in held)
        up = [sigmoid(score - c) for c in model.thresholds]
        mass = [a - b for a, b in itertools.pairwise([1, *up, 0])]
        want.append((d, sum(up), mass.index(max(mass)), up[0], up[0] >= 0.4))
    key = lambda r: (str(r[0]), round(r[1], 9))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and a[2] == b[2] and a[4] == b[4] and math.isclose(a[1], b[1], abs_tol=1e-9) and math.isclose(a[3], b[3], abs_tol=1e-9)


def test_toxic_words_are_all_kept_and_grades_are_of_the_other_half(spark):
    """More words than any fixed number can be told apart, and a document's grade doesn't follow from its own words alone."""
    rng, rows = random.Random(4), []
    bad = ["bad" + "".join(rng.choices("abcdefgh", k=8)) for _ in range(1500)]
    for i in range(3000):
        y = i % 2
        rows.append((i, " ".join([f"w{rng.randrange(50)}" for _ in range(5)] + (rng.sample(bad, 24) if y else [])), y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert len(model.words) > 1100 and len(model.thresholds) >= 1
    assert toxicity.score(docs, model).where("toxic").count() == 1500


def test_quality_scores(spark):
    rng = np.random.default_rng(3)
    bits, rank = 6, 3
    size = (1 << bits) + len(quality.STATISTICS) * (quality.BUCKETS + 1)
    edges = np.sort(rng.normal(0, 3, (len(quality.STATISTICS), quality.BUCKETS)), 1)
    fm = quality.FactorisationMachine(bits, edges, 0.2, rng.normal(0, 0.3, size), rng.normal(0, 0.3, (size, rank)))
    pick = random.Random(5)
    rows = [(i, " ".join(pick.choices(["The", "the", "CAT", "é", "12!", "a|b"], k=pick.randrange(1, 8))), pick.choice([None, 3, 40])) for i in range(30)] + [(90, None, None), (91, "", 0)]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), fm).collect()}
    for d, t, n in rows:
        said = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        x = np.zeros(size)
        count = {w: said.count(w) for w in said}
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in count.values()))
        for w, c in count.items():
            x[textvec.bytes_hash(w.encode()) & ((1 << bits) - 1)] += math.log1p(c) / norm
        stats = quality.features([t], [n], bits)[0][0]
        assert math.isclose(stats[0], math.log2(1 + len((t or "").encode()))) and math.isclose(stats[1], math.log2(1 + (len((t or "").encode()) if n is None else n)))
        at = [(1 << bits) + j * (quality.BUCKETS + 1) + int((edges[j] <= v).sum()) for j, v in enumerate(stats)]
        for i in at:
            x[i] += 0.5
        # words in one cell meet each other in the sums: every feature is one of its own there
        cells = [(textvec.bytes_hash(w.encode()) & ((1 << bits) - 1), math.log1p(c) / norm) for w, c in count.items()] + [(i, 0.5) for i in at]
        pairs = sum(float(fm.v[a] @ fm.v[b]) * u * v for (a, u), (b, v) in itertools.combinations(cells, 2))
        assert math.isclose(got[d]["score"], sigmoid(0.2 + float(fm.w @ x) + pairs), rel_tol=1e-9)
        assert got[d]["predicted"] == (got[d]["score"] >= 0.3)


def test_language_predictions(spark):
    v = langid.vocabulary(PIECES)
    logp = np.random.default_rng(0).normal(-6, 2, (v.size, 3))
    model = langid.LanguageModel(PIECES, ["aa", "bb", "cc"], logp)
    at = {int(h): i for i, h in enumerate(v.keys)}

    def total(w, j):
        out = 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            p = 1.0
            for s, e in itertools.pairwise(edges):
                h = textvec.bytes_hash(w[s:e])
                p *= sum(math.exp(logp[at[x], j]) for x in ([h, h ^ v.first] if s == 0 else [h]) if x in at)
            out += p
        return math.log(out)

    texts = ["The cat, the élan!", "zq", "A1b2c", "ok thinking", None, "", "12 !?"]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for d, t in enumerate(texts):
        said = [w.encode() for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
        if not said:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        like = [sum(total(w, j) for w in said) for j in range(3)]
        best = max(like)
        share = 1 / sum(math.exp((x - best) / (1 + math.sqrt(len(said) / 32))) for x in like)
        assert got[d]["lang_pred"] == model.langs[like.index(best)] and math.isclose(got[d]["score"], share, rel_tol=1e-9)


def test_long_pieces_and_words_count():
    """Pieces of any length are in the vocabulary, and words of any length in the expectations."""
    v = langid.vocabulary(PIECES)
    sp = pieces.codec(PIECES).sp
    longest = max(len(sp.id_to_piece(i).lstrip(pieces.MARK).encode()) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    assert v.longest == longest > 16
    logp = np.full((v.size, 1), -math.log(v.size))
    word = b"ab" * 100
    uses = langid.expectation(v, logp, np.frombuffer(word, np.uint8), np.array([0]), np.array([200]), np.ones((1, 1)))
    assert 50 < uses.sum() <= 200


def test_licence_probabilities():
    model = licences.train(None)
    said = licences.tokens("Licensed under the Apache License, Version 2.0, and nothing else here")
    x = dict.fromkeys([model.words[w] for w in said if w in model.words] + [model.pairs[p] for p in itertools.pairwise(said) if p in model.pairs], 1.0)
    norm = math.sqrt(len(x))
    z = [(sum(model.weights[i, k] / norm for i in x) + model.weights[-1, k]) / model.temperature for k in range(len(model.families))]
    p = [math.exp(v - max(z)) for v in z]
    family, probability, like, sure = model.judge(said)
    k = z.index(max(z))
    assert family == model.families[k] == "Apache-2.0" and sure and like >= 0.6
    assert math.isclose(probability, p[k] / sum(p), rel_tol=1e-9)


def test_licence_paragraphs_and_negatives(spark):
    wrapped = "Intro.\n\nRedistribution and use in source and binary\nforms, with or without modification, are permitted\nprovided that the following conditions are met:\n\nAnother part."
    odd = "the public software conditions of a license to copy source files"
    rows = [(0, wrapped), (0, wrapped), (None, "x\n\nReleased under the MIT\nLicense."), (2, None), (3, ""), *((10 + i, f"{odd} {i}") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit(1))
    got = licences.scan(docs, licences.train(docs)).collect()
    assert sorted((r["doc_id"] or -1, r["line"], r["family"]) for r in got if r["confirmed"]) == [(-1, 2, "MIT"), (0, 2, "BSD"), (0, 2, "BSD")] or sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["line"], r["family"]) for r in got if r["confirmed"]) == [(-1, 2, "MIT"), (0, 2, "BSD"), (0, 2, "BSD")]
    assert {r["family"] for r in got if (r["doc_id"] or 0) >= 10} == {"unknown"}


def test_chats_of_any_length(spark):
    said = "a\\[INST]<s>\n" * 90_000
    rows = [(1, 1, "r" * 10**6 + "\n\\", "x"), (1, 2, "assistant", said), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.digests(chat.expanded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, len(said)) and (got[2]["n_turns"], got[2]["loss_chars"]) == (2, 0)


def test_ids_take_fewer_bits_than_their_own_entropy():
    """Ids that repeat in order cost less than the order-0 entropy of all of them, ids without order little more."""
    rng = np.random.default_rng(2)
    phrases = [rng.zipf(1.3, 12) % 50_000 for _ in range(60)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 60, 4000)])
    blocks = [ids[s : s + 16_384] for s in range(0, len(ids), 16_384)]
    payloads = idcoder.encode_blocks(blocks)
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert 8 * sum(map(len, payloads)) / len(ids) < 0.8 * -(p * np.log2(p)).sum()
    noise = rng.integers(0, 65_536, 20_000)
    assert 8 * len(idcoder.encode_blocks([noise])[0]) / 20_000 < 17.5
    assert all((a == b).all() for a, b in zip(idcoder.decode_blocks(payloads, [len(b) for b in blocks]), blocks, strict=True))


def test_documents_over_many_blocks(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [" ".join(words(30_000, 1, 9000)), "", None, "short 'tis don't we'll\n\n x", " ".join(words(9000, 2, 99))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    blocks = idcoder.write(docs, path)
    assert blocks.count() > 5
    pieces_of = idcoder.read(blocks).orderBy("part", "block", "seq").collect()
    for d, t in enumerate(texts):
        mine = [x for r in pieces_of if r["doc_id"] == d for x in r["ids"]]
        assert mine == [*library.encode(t or "", add_special_tokens=False).ids, 0]


def test_spans_of_the_query(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = pieces.digests(docs, PIECES, aligned=True).collect()
    assert len(got) == len(ODD) and all(r["tiled"] for r in got)
    spans = {r["doc_id"]: r for r in pieces.encode(docs.where("doc_id = 1"), PIECES).collect()}[1]
    import hashlib

    raw = np.array(spans["starts"], "<i4").tobytes() + np.array(spans["ends"], "<i4").tobytes()
    assert {r["spans_sha256"] for r in got if r["doc_id"] == 1} == {hashlib.sha256(raw).hexdigest()}
    slow = pieces.Normalizer(b"", True, False, True)
    for t in ["", " ", "a b", "é  😀x ", "\n a"]:
        quick = slow(t)
        slow.plain = False
        assert (quick[0], quick[1].tolist()) == (slow(t)[0], slow(t)[1].tolist())
        slow.plain = True


@pytest.mark.parametrize("fits", [0, 30, 10**6])
def test_components_by_rounds_and_in_one_task(spark, fits):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    label = {x: x for p in links for x in p if x is not None}
    for _ in range(len(label)):
        for a, b in links:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), fits=fits).collect()}
    assert got == {k: v for k, v in label.items() if any(None not in p and k in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long"), fits=fits).count() == 0


def test_vectors_of_every_length(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 5)] + [(20, [1.0, 2.0, 3.0]), (21, [0.0, 1.0, 0.0]), (22, [5.0, 0.0, 0.0]), (40, [7.0])]
    got = [tuple(r) for r in hashing_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(20, 1, 22, 5.0), (20, 2, 21, 2.0)]


def test_samples_do_not_depend_on_partitions(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"))
    a = {r[0] for r in common.hashed_sample(docs.repartition(7), 300, 5000, "doc_id").collect()}
    b = {r[0] for r in common.hashed_sample(docs.coalesce(1), 300, 5000, "doc_id").collect()}
    assert a == b and len(a) == 300
    assert common.hashed_sample(docs, 300, 100, "doc_id").count() == 300


def test_decontamination_of_repeated_and_tied_rows(spark):
    item = " ".join(words(20, 1, 9000))
    bench = spark.createDataFrame([(1, item), (2, item), (1, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(5, f"x {item} y {item}"), (5, f"x {item} y {item}"), (None, item)], "doc_id long, text string").withColumn("distance", F.lit("s"))
    got = sorted(map(tuple, decontaminate.find(docs, bench).collect()), key=str)
    end = 2 + len(item)
    assert got == sorted([(d, i, 0, 0 if d is None else 2, len(item) if d is None else end) for d in (5, 5, None) for i in (1, 2, None)], key=str)


def test_pipeline_by_hand(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choices(["the", "ing", "er", "on", "at"], k=3)) for _ in range(n))
    item = text(30)
    rows = [(i, text(rng.randrange(20, 60))) for i in range(100)]
    rows += [(200 + i, f"{text(20)} vile filth {text(10)} vile") for i in range(40)]
    for i in range(40):
        copy = rows[i][1].split()
        copy[rng.randrange(len(copy))] = "changed"
        rows.append((300 + i, " ".join(copy)))
    held = list(item)
    held[10] = "z"
    rows += [(400, f"{text(20)} {item} {text(5)}"), (401, f"{text(20)} {''.join(held)}"), (402, None), (403, "12 !")]
    at = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, 1, int(200 <= d < 300)) for d, _ in rows[:140]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = langid.train(docs, PIECES)
    limits = langid.limits(docs, model)
    ordinal = toxicity.train(docs, spark.read.parquet(f"{at}/labels.parquet"))

    def likely(t):
        said, score, best, rate, size = model.judge([t])
        return said[0] != "und" and score[0] >= pipeline.LEAST_LANGUAGE_SCORE and limits.hold(best, rate, size)[0]

    kept = [(d, t) for d, t in rows if likely(t)]
    kept = [(d, t) for d, t in kept if ordinal.exceed([t])[0, 0] < 0.4]
    label = brute_components(kept, 5)
    kept = [(d, t) for d, t in kept if label[d][2]]
    norm = lambda t: decontaminate.normalized([t])[0][:-1].strip()
    kept = [(d, t) for d, t in kept if edit(norm(item), norm(t)) > int(0.05 * len(norm(item)))]
    sp = pieces.codec(PIECES).sp
    got = {r["doc_id"]: list(r["ids"]) for r in pipeline.run(spark, at).collect()}
    assert got == {d: [*sp.encode(t), 2] for d, t in kept}
    assert 90 < len(got) < 130


def test_language_learns_from_all_documents(spark):
    """The model is that of train() without a sample's bound, not that of a sample, and the limits' means are those of all training documents."""
    rows = [(i, f"the water and the house number {'qvxj' * 3 if i == 1400 else 'tree'}" if i % 2 == 0 else "der wald und das haus", "en" if i % 2 == 0 else "de") for i in range(1500)]
    rows += [(5000 + i, "zzzz", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model, whole, part = langid.train_on_all(docs, PIECES), langid.train(docs, PIECES, sample=10**9), langid.train(docs, PIECES, sample=5)
    assert model.langs == whole.langs == ["de", "en"]
    assert np.allclose(model.logp, whole.logp, atol=1e-4) and not np.allclose(model.logp, part.logp, atol=1e-4)
    picked = [(t, x) for d, t, x in rows if x and zlib.crc32(str(d).encode()) % 4 != 2]
    _, _, best, rate, size = model.judge([t for t, _ in picked])
    limits = langid.limits(docs, model)
    assert np.allclose(limits.mean, [(rate * size)[best == j].sum() / size[best == j].sum() for j in (0, 1)])
    assert langid.train_on_all(docs.limit(0), PIECES).langs == []
