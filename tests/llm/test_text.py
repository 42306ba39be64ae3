"""Brute-force versions, round trips and odd rows for the text operators."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from meldframe.llm import chat, components, decontaminate, idcoder, langid, licences, neardup, pieces, quality, textvec, toxicity  # noqa: E402
from meldframe.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Nulls, empty and long texts, repeated rows, an id with two texts, and columns whose names operators use themselves.
ODD = [
    (1, "The cat sat on the mat and the dog ran off", "en", "x"), (1, "The cat sat on the mat and the dog ran off", "en", "x"), (2, None, None, None), (3, "", "en", None),
    (None, "no id here", "en", None), (4, " \t\n", None, "y"), (5, "日本語 <s> ▁ \x00 é 😀", "ja", None), (6, "word " * 30_000, "en", None), (5, "another text with this id", "fr", None), (7, "!?" * 50, None, None),
]
SCHEMA = "doc_id long, text string, lang string, node string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"component_id": F.lit(9), "score": F.lit("s"), "ids": F.lit(1), "key": F.lit(2)})


def words(n, seed, size=300):
    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]


# near-duplicates


def brute_components(rows, n, threshold=80):
    sets = {}
    for d, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


def test_near_duplicates_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for g in range(12):
        base = words(rng.choice([3, 5, 8, 20, 60, 400, 900]), g, 500)
        for _ in range(rng.choice([1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 30])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy).upper() if rng.random() < 0.1 else " \n".join(copy)))
    passage = " ".join(words(60, 77))
    rows += [(1000 + i, " ".join(words(rng.randrange(20, 200), 100 + i)) + " " + passage) for i in range(40)]
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, k=32, indexed=32)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute_components(rows, 4)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd, 4).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(tuple(r))
    assert len(by[1]) == 1 and by[2] == {(2, 0, 2, True)} and by[4] == {(4, 0, 4, True)} and by[None] == {(None, 1, None, None)}
    assert neardup.near_duplicates(odd.limit(0), 4).count() == 0


def test_runs_miss_no_pair_at_the_threshold(spark):
    """Of many pairs of sets at a similarity of just 0.8, of sizes on either side of `indexed`, none lacks a common run."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(6000):
        size = int(rng.choice([4, 5, 8, 9, 10, 11, 20, 40, 64, 70, 90, 130, 400, 3000]))
        apart = max(1, size // 4)  # shared is 4 times what is in one of them alone
        values = np.unique(rng.integers(0, 2**31, 8 * size, dtype=np.int64))
        values = rng.permutation(values)[: 4 * apart + apart]
        ours = rng.random(apart) < rng.choice([0, 0.5, 1])
        both, lone = values[apart:], values[:apart]
        for side, own in enumerate((lone[ours], lone[~ours])):
            x = np.sort(np.concatenate([both, own]))
            rows.append((i, side, len(x), [int(v) for v in x[:128]]))
    sets = spark.createDataFrame(rows, "pair long, side int, n long, sketch array<int>").where("n >= 4")
    keys = sets.select("pair", "side", F.explode(neardup.run_keys(F.col("sketch"), F.col("n"), 64)).alias("key")).distinct()
    met = keys.where("side = 0").join(keys.where("side = 1").select("pair", "key"), ["pair", "key"]).select("pair").distinct().count()
    assert met == sets.groupBy("pair").count().where("count = 2").count() > 5000


def test_lists_of_one_cluster_leave_no_trees():
    """Members that may be near: a group leaves their tree once; where all are of one cluster by then it leaves none, and one that is not yet is tied to it."""
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(2**31 - 1, 150, replace=False))
    # each lacks 15 values of its own: estimated near 0.8, and not whole
    held = [np.delete(base, rng.choice(128, 15, replace=False))[:128].astype(np.int32) for _ in range(30)]

    def rows(cluster):
        columns = {"key": [1] * 30, "node": list(range(30)), "n": [400] * 30, "component": list(range(30)), "cluster": cluster, "i": [0] * 30, "j": [0] * 30, "side": [0] * 30}
        yield pa.RecordBatch.from_pydict(columns | {"items": pa.array([h.tolist() for h in held], pa.list_(pa.int32()))})

    def others(cluster):
        return [(a, b) for batch in neardup._close(rows(cluster), 128, 0.8, False) for a, b, sure in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "sure")), strict=True) if not sure]

    assert len(others(list(range(30)))) == 29
    assert others([0] * 30) == []
    ((a, b),) = others([0] * 29 + [29])
    assert b == 29 and a < 29


def test_large_groups_leave_as_trees(spark):
    """Lists of thousands of members: exact components, and no more rows between tasks than members."""
    rng, rows = random.Random(7), []
    for g, (n, changes) in enumerate(((1500, 3), (600, 9), (1300, 40))):
        base = words(200, 900 + g, 5000)
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randrange(changes + 1)):
                copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, 4, block=200).collect()}
    sets = {d: neardup.textvec.shingle_sets([t], 4)[0] for d, t in rows}
    every = np.unique(np.concatenate(list(sets.values())))
    held = np.zeros((len(rows), len(every)), np.float32)
    for d, s in sets.items():
        held[d, np.searchsorted(every, s)] = 1
    both, size = held @ held.T, held.sum(1)
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label[None, :], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    assert got == {d: (int(size[d]), int(label[d]), int(label[d]) == d) for d, _ in rows}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    label = {x: x for p in links for x in p}
    for _ in range(len(label)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# pieces


def test_pieces_equal_the_library(spark):
    c = pieces.codec(PIECES)
    rng = random.Random(6)
    parts = ["a", " ", "▁", "\n", "é", "😀", "\t", "word", "<s>", "  ", "字", "\u200b"]
    texts = ["", None, " ", "a ", "▁a"] + ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(800)]
    for t, (ids, start, end) in zip(texts, c.encode(texts), strict=True):
        assert ids.tolist() == [*c.sp.encode(t or ""), c.eos]
        raw = (t or "").encode()
        assert b"".join(raw[s:e] for s, e in zip(start, end, strict=True)) == raw
    small = pieces.Codec(PIECES, cached=10)
    assert all((a[0] == b[0]).all() for a, b in zip(small.encode(texts), c.encode(texts), strict=True))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_compiled_map(rule):
    import sentencepiece

    n = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, remove_extra_whitespaces=True, add_dummy_prefix=True)
    spec = dict(pieces._fields(next(v for k, v in pieces._fields(n.serialized_model_proto()) if k == 3)))
    mine = pieces.Normalizer(spec.get(2, b""), True, True, True)
    for t in ["ｆｕｌｌ ①㌔ﬁ", "  Å á  b ", "", "   ", "a\u3000b", "Ａé\u0301"]:
        got, origin = mine(t)
        assert got.decode() == n.normalize(t)
        assert len(origin) == len(got) + 1 and list(origin) == sorted(origin) and origin[-1] <= len(t.encode())


def test_piece_digests(spark, odd):
    c = pieces.codec(PIECES)
    got = sorted(map(tuple, pieces.digests(odd, PIECES).collect()), key=str)
    want = []
    for d, t, *_ in ODD:
        ids = [*c.sp.encode(t or ""), c.eos]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(c.sp.decode(ids))))
    assert got == sorted(want, key=str)
    assert pieces.encode(odd.limit(0), PIECES).count() == 0


# token ids


def test_id_blocks_round_trip():
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, rng.choice([2, 300, 50257, 65536]), rng.integers(1, 400)) for _ in range(30)] + [np.zeros(700, np.int64), np.array([65535])]
    payloads = idcoder.encode_blocks(blocks)
    back = idcoder.decode_blocks(payloads, [len(b) for b in blocks])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True)) and len(payloads[-2]) < 120
    assert idcoder.encode_blocks([blocks[3]])[0] == payloads[3]  # a block doesn't depend on the others
    a, b = b"abc", b"defgh" * 999
    assert idcoder.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_coding_takes_few_calls_for_many_blocks():
    """What is done once for all blocks isn't done for each: calls of Python and numpy, counted, for 256 blocks of 700 ids."""
    rng, calls = np.random.default_rng(8), 0
    blocks = [np.minimum(rng.zipf(1.2, 700), 40_000) for _ in range(256)]

    def counted(f, *args):
        nonlocal calls
        calls, before = 0, sys.getprofile()

        def seen(frame, event, arg):
            nonlocal calls
            calls += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            return f(*args), calls
        finally:
            sys.setprofile(before)

    payloads, to_encode = counted(idcoder.encode_blocks, blocks)
    back, to_decode = counted(idcoder.decode_blocks, payloads, [len(b) for b in blocks])
    assert to_encode < 55_000 and to_decode < 55_000
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_blocks_of_all_lengths_together():
    """Streams that end at an odd place, or not at a stretch's end; more symbols than a distribution takes; and lengths that two bytes don't hold."""
    rng = np.random.default_rng(9)
    blocks = [rng.integers(0, 65_536, 1 + n) for n in range(0, 300, 7)] + [np.arange(12_000) % 65_536, rng.permutation(65_536)[:70_000], np.zeros(65_536, np.int64), rng.zipf(1.1, 70_001) % 65_536]
    payloads = idcoder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, idcoder.decode_blocks(payloads, [len(b) for b in blocks]), strict=True))
    for i in (0, 3, -1):
        assert idcoder.encode_blocks([blocks[i]])[0] == payloads[i]


def test_blocks_are_read_together_whatever_the_batches(monkeypatch):
    rng, asked = np.random.default_rng(4), []
    blocks = [rng.integers(0, 3000, n) for n in (5, 900, 70, 300, 1, 64, 65)]
    rows = [{"payload": p, "payload_crc": zlib.crc32(p), "n_ids": len(b), "ids_crc": idcoder.crc(b), "block": i, "part": 0} for i, (b, p) in enumerate(zip(blocks, idcoder.encode_blocks(blocks), strict=True))]
    decode = idcoder.decode_blocks
    monkeypatch.setattr(idcoder, "decode_blocks", lambda p, n: asked.append(len(p)) or decode(p, n))
    monkeypatch.setattr(idcoder, "TOGETHER", 5)
    got = [x for some in idcoder._decoded(iter([pa.RecordBatch.from_pylist(rows[s : s + 2]) for s in range(0, 7, 2)])) for x in some]
    assert asked == [5, 2] and [t["block"] for t, _ in got] == list(range(7))
    assert all((a == b).all() for (_, a), b in zip(got, blocks, strict=True))


def test_id_files(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    blocks = idcoder.write(odd, BYTES)
    got = idcoder.digests(blocks).collect()
    want = []
    for d, t, *_ in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0])
        want.append((d, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    ordered, at = sorted(got, key=lambda r: r["start"]), 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in ordered if r["doc_id"] is not None]
    assert known == sorted(known)
    assert sum(len(r["ids"]) for r in idcoder.read(blocks).collect()) == at
    broken = blocks.withColumn("payload", F.concat("payload", F.lit(b"x")))
    with pytest.raises(Exception, match="broken"):
        idcoder.digests(broken).collect()
    assert idcoder.digests(idcoder.write(odd.limit(0), BYTES)).count() == 0


def test_tokenizer_cuts():
    t, rng = idcoder.Tokenizer(BYTES, cached=50), random.Random(0)
    texts = ["".join(rng.choices(["a", " ", "'", "s", "\n", "é", "\t", "1", "!", "²", "\x1c", "ll", "日"], k=rng.randrange(15))) for _ in range(600)] + ["<|endoftext|>"]
    assert [x.tolist() for x in t.encode(texts)] == [[*t.library.encode(x, add_special_tokens=False).ids, 0] for x in texts]


def test_new_cuts_are_encoded_without_breaks_between_them(monkeypatch):
    """New words go to the library one after the other, and what is forgotten or shares a place of the table is encoded as before."""
    t, rng, asked = idcoder.Tokenizer(BYTES, cached=900), random.Random(3), []
    whole = t._whole
    monkeypatch.setattr(t, "_whole", lambda text: asked.append(text) or whole(text))
    texts = [" ".join("".join(rng.choices("abcdeéß", k=rng.randrange(1, 6))) + rng.choice(["", "", "!", "'ll", "42", " \n"]) for _ in range(60)) for _ in range(40)]
    for s in range(0, 40, 8):
        got = t.encode(texts[s : s + 8])
        assert [x.tolist() for x in got] == [[*t.library.encode(x, add_special_tokens=False).ids, 0] for x in texts[s : s + 8]]
        assert t.known <= max(900, int((t.keys != 0).sum())) and len(t.keys) >= 2 * t.known
    assert max(x.count(b" ") for x in asked) > 100
    before = len(asked)
    t.encode(texts[-8:])
    assert len(asked) == before


def test_added_tokens_as_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    texts = ["plain before", "ends here <|endoftext|> next", "<|endoftext|>", "é<|endoftext|><|endoftext|>\n", "<|endoftext| >", "日 <|endoftext|>", "plain after"]
    coded = [np.array([*library.encode(t, add_special_tokens=False).ids, 0]) for t in texts]
    assert coded[1].tolist() == [2412, 994, 220, 50256, 1306, 0]
    assert [x.tolist() for x in idcoder.Tokenizer(BYTES).encode(texts)] == [x.tolist() for x in coded]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in idcoder.digests(idcoder.write(docs, BYTES)).collect())
    starts = np.cumsum([0, *map(len, coded)])
    assert got == [(i, starts[i], len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, x in enumerate(coded)]


# languages


def test_forward_sums_all_segmentations():
    v = langid.vocabulary(PIECES)
    logp = np.random.default_rng(0).normal(-6, 2, (v.size, 2))
    at = {int(h): i for i, h in enumerate(v.keys)}

    def total(w, j):
        out = 0.0
        for cuts in itertools.product((0, 1), repeat=len(w) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(w)]
            ways = [1.0]
            for s, e in itertools.pairwise(edges):
                h = textvec.bytes_hash(w[s:e])
                options = [x for x in ([h, h ^ v.first] if s == 0 else [h]) if x in at]
                ways = [p * math.exp(logp[at[x], j]) for p in ways for x in options]
            out += sum(ways)
        return math.log(out)

    said = [b"the", b"a", "élan".encode(), b"thinking", b"zq"]
    buf = np.frombuffer(b" ".join(said) + b" ", np.uint8)
    end = np.cumsum([len(w) + 1 for w in said]) - 1
    got = langid.forward(v, logp, buf, end - np.array([len(w) for w in said]), end)
    assert np.allclose(got, [[total(w, j) for j in range(2)] for w in said])
    assert np.isfinite(langid.forward(v, logp - 20, np.frombuffer(b"ab" * 500, np.uint8), np.array([0]), np.array([1000]))).all()


def test_languages(spark, odd):
    rng = random.Random(1)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ein", "ung", "der"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(30)), k) for i in range(80) for k in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 !", None), (902, "", "yy")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs, PIECES)).collect()}
    assert all(got[d]["lang_pred"] == k and got[d]["score"] > 0.9 and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, k in rows)
    assert all((got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0) for d in (900, 901, 902))
    none = langid.train(docs.limit(0), PIECES)
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd, langid.train(odd, PIECES)).count() == len(ODD)


# labels


def labelled(spark, bad):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = words(40, i, 900)
        y = int(rng.random() < 0.3)
        if y:
            w = bad(w, rng)
        rows.append((i, " ".join(w), len(w)))
        labels.append((i, 1 - y, y))
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd):
    docs, labels = labelled(spark, lambda w, rng: [*w, *rng.choices(["Vile", "filth"], k=rng.randrange(1, 6))])
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.score(docs, model).collect()
    assert sum(r["toxic"] == truth[r["doc_id"]] for r in got) > 390
    few, many = model.exceed(["fine vile", "fine " + "vile filth " * 5])
    assert few.sum() < many.sum() and (np.diff(many) <= 0).all()
    assert toxicity.score(odd, model).count() == len(ODD)
    assert not any(r["toxic"] for r in toxicity.score(odd, toxicity.train(docs.limit(0), labels)).collect())


def test_quality(spark, odd):
    docs, labels = labelled(spark, lambda w, rng: [f"{x.upper()}!!" for x in w])
    model = quality.train(docs, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality.score(docs, model).collect()
    held = [r for r in got if r["held_out"]]
    assert 40 < len(held) < 120 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in quality.score(odd, model).collect())
    assert {round(r["score"], 6) for r in quality.score(odd, quality.train(docs, labels.limit(0))).collect()} == {0.5}


def test_pair_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(3, np.zeros((0, quality.BUCKETS)), 0.3, rng.normal(size=8), rng.normal(size=(8, 2)))
    x = rng.normal(size=(4, 8))
    row, column = np.nonzero(x)
    got, _ = fm.raw(4, row, column, x[row, column])
    want = 0.3 + x @ fm.w + [sum(fm.v[i] @ fm.v[j] * r[i] * r[j] for i in range(8) for j in range(i)) for r in x]
    assert np.allclose(got, want)


# benchmark items


def edit(p, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        new = [i]
        for j in range(1, len(t) + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p[i - 1] != t[j - 1])))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(3)
    for _ in range(150):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, n))) for n in (75, 90))
        assert decontaminate.myers(p, t, len(p))[0] == edit(p, t)


def test_decontamination(spark, odd):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng.randrange(12, 40), 50 + i, 9000))) for i in range(6)] + [(6, None), (7, "short"), (8, "")]
    rows = []
    for i in range(60):
        text = " ".join(words(120, 300 + i))
        k = rng.randrange(6)
        held = list(items[k][1].upper() if i % 5 == 0 else items[k][1])
        for _ in range(rng.choice([0, 1, 3, len(held) // 20, len(held) // 6])):
            held[rng.randrange(len(held))] = rng.choice("qz")
        rows.append((i, f"{text} -- {''.join(held)}.\n{text}" if i % 2 else text))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: decontaminate.normalized([t])[0][:-1].strip()
    want = {(d, i): e for d, t in rows for i, x in items[:6] if (e := edit(norm(x), norm(t))) <= int(0.05 * len(norm(x)))}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find(docs, bench).collect()}
    assert got == want and len(got) > 10
    assert {r["doc_id"] for r in decontaminate.clean_rows(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find(odd, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.find(odd.limit(0), bench).count() == 0


def test_short_items_match_exactly(spark):
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "Who?"), (3, "?!"), (4, "Où est-il ?")], "item_id long, text string")
    texts = ["He asked: what is 2 + 2, again", "what is 2+22", "xwhat is 2+2?", "What is 2+2?", "whom who", "where is he", "où est il", "what is 2+3?", "", "swho"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    assert got == [(0, 1, 0, 9, 20), (3, 1, 0, 0, 11), (4, 2, 0, 5, 8), (6, 4, 0, 0, 10)]
    assert {r["doc_id"] for r in decontaminate.clean_rows(docs, bench).collect()} == {1, 2, 5, 7, 8, 9}


# licences


def test_licences(spark, odd):
    model = licences.train(odd)
    said = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
    }
    rows = [(i, f"some words here\n{t} and more\nlast") for i, t in enumerate(said)] + [(90, "I got my license to drive a public bus"), (91, "granted copyright warranties notice files")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {(r["doc_id"], r["family"], r["line"]) for r in got if r["confirmed"]} == {(i, f, 1) for i, f in enumerate(said.values())}
    assert licences.scan(odd, model).where("confirmed").count() == 0
    assert licences.scan(odd.limit(0), licences.train(odd.limit(0))).count() == 0


def test_frequent_licence_notices(spark):
    notices = {"All rights reserved.": "Proprietary", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    for notice, family in notices.items():
        rows = [(i, " ".join(words(30, i)) + (f"\n{notice}" if i % 3 == 0 else "")) for i in range(300)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = licences.scan(docs, licences.train(docs)).collect()
        assert sorted((r["doc_id"], r["line"], r["family"], r["confirmed"]) for r in got) == [(i, 1, family, True) for i in range(0, 300, 3)]


# chats


def test_chat_round_trip(spark):
    said = ["", None, "</s>[INST] ok [/INST]", "a\\b\n<|im_end|>\n\\n", "<<<SYS>>\\", "<|im_start|>user\nx", "é[INST]]", "\\<|im_end|>\n"]
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(12)]), rng.randrange(6), rng.choice(["user", "assistant", "sys\ntem\\", None, "<s>"]), rng.choice(said)) for _ in range(120)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "formatted": F.lit("z")})
    got = {r["conv_id"]: r for r in chat.digests(chat.expanded(d)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    for r in chat.expanded(d).collect():
        body = r["formatted"]
        assert body.count("<|im_start|>") == body.count("<|im_end|>\n") == r["n_turns"] and "<s>" not in body and "[INST]" not in body
    assert chat.digests(chat.expanded(d.limit(0))).count() == 0


def test_registered():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(f"op{i}" for i in range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
