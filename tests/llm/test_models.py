"""SimHash, BPE, packing, neighbours, classifier, languages and the pipeline against brute force."""

import random
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ellipsa.llm import ann, bpe, common, language_id, packing, quality_classifier, simhash
from ellipsa.llm.common import crc_mod

DATA = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "Hello  world\n\n don't", "<|endoftext|> x", "é🙂中\u3000\x1c\x85", "ab" * 4000, "a b " * 6000]


def odd(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, fp string")


def fingerprint_brute(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    for text in [*ODD[:6], "A b C", "one two", "x y z w " * 50]:
        assert simhash.fingerprint(text) == fingerprint_brute(text)


@pytest.mark.parametrize("posting", [1, 3, 32])
def test_links_are_all_found(spark, posting):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:6]:
        for _ in range(40):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    assert min(np.bitwise_count(fps[:, None] ^ fps[None]).ravel()[1:]) <= 2
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(fps))
    while not (new := np.array([label[n].min() for n in near])).__eq__(label).all():
        label = new
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in simhash.connected(simhash.links(df, posting)).collect()}
    mine = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(mine, label.tolist(), strict=True))) == len(set(mine)) == len(set(label.tolist()))


def test_near_duplicates_edges(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30
    df = odd(spark, [None, "", base, base, base.upper(), "one two", " \n"])
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert out[0] == out[1] == out[6] == 0 and out[2] == out[3] == out[4] == 2 and out[5] == 5
    doubled = df.union(df).union(spark.createDataFrame([(None, "lonely words here now", "f")], df.schema))
    kept = simhash.keep_one(doubled)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 2, 5] and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_one_of_each_group_and_no_other_text_is_lost(spark):
    texts = [f"{w} has seven words of its very own" for w in ("alpha", "beta", "gamma", "delta", "epsilon", "zeta")]
    ids = [1, 1, 2, None, None, None]
    df = spark.createDataFrame([(i, t, "root", 5) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, root string, fp int")
    assert sorted(r.text for r in simhash.keep_one(df).collect()) == sorted(texts)
    copies = df.union(df).union(spark.createDataFrame([(0, texts[1], "r", 1), (9, texts[3], "r", 1)], df.schema))
    out = simhash.keep_one(copies)
    assert out.columns == df.columns and sorted((r.text, r.doc_id, r.root) for r in out.collect() if r.text in (texts[1], texts[3])) == sorted([(texts[1], 0, "r"), (texts[3], 9, "r")])
    assert out.count() == 6


def test_tally_tells_equal_bytes(spark):
    rng = np.random.default_rng(1)
    for equal, shared in ((8, 14), (7, 7), (6, 3), (5, 1), (0, 0)):
        change = rng.choice(8, 8 - equal, replace=False)
        a = rng.integers(0, 256, 8, dtype=np.uint8)
        b = a.copy()
        b[change] ^= rng.integers(1, 256, len(change), dtype=np.uint8)
        df = spark.createDataFrame([(int(x.view(np.int64)[0]),) for x in (a, b)], "fp long")
        assert simhash._postings(df).groupBy("key").count().where("count = 2").count() == (shared if equal < 8 else 14)


def test_common_fingerprints_are_named_like_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 2)
    df = spark.createDataFrame([(i, "" if i % 2 else f"text number {i} stands alone here") for i in range(20)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {i: 1 if i % 2 else i for i in range(20)}


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcDEF 's\n\t.<|>é1"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_bpe_is_the_library(text):
    tool, ref = bpe.load(BYTE), _library(BYTE)
    ids = np.frombuffer(tool.encode_batch([text])[0], "<u4").tolist()
    assert ids == ref.encode(text, add_special_tokens=False).ids
    assert tool.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(packing._tokenizer(WORD)([text])[0], "<u4").tolist() == _library(WORD).encode(text, add_special_tokens=False).ids


_tools: dict = {}


def _library(path):
    return _tools.setdefault(path, Tokenizer.from_file(path))


def test_bpe_proposals_are_verified():
    tool = bpe.load(BYTE)
    words = [w.encode() for w in ("theatonering", "aaaaaaa", "ououning", "enenest", "édation")]
    words += [bytes(pick.choice(b"aeinrst'h \xc3\xa9") for _ in range(pick.randint(1, 70))) for pick in [random.Random(8)] for _ in range(4000)]
    assert [np.frombuffer(e, "<u4").tolist() for e in tool.encode_words(words)] == [tool.merge(w) for w in words]
    assert 0 < tool.words["merged"] < tool.words["proposed"]  # some proposals fail the test


def test_bpe_tables_are_bounded():
    tool, ref = bpe.ByteBpe(BYTE), _library(BYTE)
    tool.chunks, tool.pieces = bpe.Known(5), bpe.Known(3)
    texts = ["one two three one", "four five six", "one seven", "", None, "two " * 9, "\ud7ff x"]
    for _ in range(3):
        assert [np.frombuffer(e, "<u4").tolist() for e in tool.encode_batch(texts)] == [ref.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(e, "<u4").tolist() for t in texts for e in tool.encode_batch([t])] == [ref.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_bpe_decoding_of_any_ids():
    tool, ref = bpe.load(BYTE), _library(BYTE)
    rows = [[], [5, 200, 130], [1000], [128, 129], [0, 15496], []]
    for some in (rows, rows[:2], rows[-1:], []):
        ends = np.cumsum([0, *map(len, some)]).astype(np.int32)
        assert tool.decode_batch(np.array([i for r in some for i in r], np.int32), ends).to_pylist() == [ref.decode(r, skip_special_tokens=False) for r in some]


def test_bpe_query_table(spark):
    twice = odd(spark).union(odd(spark)).withColumn("ids", F.lit("x"))
    out = bpe.encode_decode(twice, BYTE).orderBy("doc_id").collect()
    assert [r.ids for r in out] == [_library(BYTE).encode(t or "", add_special_tokens=False).ids for t in ODD for _ in range(2)] and [r.decoded for r in out] == [t or "" for t in ODD for _ in range(2)]
    assert bpe.encode_decode(odd(spark).limit(0), BYTE).count() == 0


def test_packing(spark):
    df = odd(spark).union(odd(spark))
    packed = packing.pack_documents(df, WORD, with_ids=True)
    rows = packed.collect()
    for i, text in enumerate(ODD):
        ids = [*_library(WORD).encode(text or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert len(mine) == 2 * -(-len(ids) // 4096)
        for r in mine:
            assert r.ids == ids[r.piece * 4096 : (r.piece + 1) * 4096] and r.start == r.piece * 4096 and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    check_places([(r.sequence_id, r.offset, r.length) for r in rows])
    wild = ("bucket", "rank", "lo", "hi", "times", "sequence", "at", "of", "before", "slot", "row", "n", "offset")
    few = packed.select("doc_id", "piece", "start", "length", "ids_crc32", *[F.lit(c).alias(c) for c in wild])
    again = packing.pack(few)
    assert again.columns == [*few.columns[:-1], "sequence_id", "offset"] and check_places([(r.sequence_id, r.offset, r.length) for r in again.collect()])
    assert all(r[c] == c for r in again.collect() for c in wild[:-1]) and again.count() == few.count()
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in rows)
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def test_plan_of_packing_starts_no_python_workers(spark):
    packed = packing.pack(spark.range(5).selectExpr("id doc_id", "0 piece", "100 + id length"))
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
    assert check_places([(r.sequence_id, r.offset, r.length) for r in packed.collect()]) == 1


def test_slices_copy_no_texts():
    texts = [None, "", "\u00e9" * 900, *["x" * 1000] * 20_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    tracemalloc.start()
    sizes = [s.num_rows for s in common.by_bytes(batch, 0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == len(texts) and len(sizes) == 6 and peak < 4 << 20


def test_idle_workers_hold_no_tables(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.2, raising=False)
    monkeypatch.setattr(common, "_holder", {})
    table, other = {"a": 1}, {"b": 2}
    with common.using_tables("one", table.clear):
        with common.using_tables("one", table.clear):
            pass
        time.sleep(0.6)
        assert table  # a task is using it
    with common.using_tables("one", table.clear):  # the next task comes in time
        assert table
    time.sleep(0.8)
    assert not table and not common._holder
    table["a"] = 1
    with common.using_tables("one", table.clear):
        pass
    common.sole_tables("two", other.clear)
    assert not table
    time.sleep(0.6)
    assert other and list(common._holder) == ["two"]  # of another tool that takes no part in it


def check_places(places):
    at = {}
    for s, offset, n in sorted(places):
        assert at.get(s, 0) == offset
        at[s] = offset + n
    assert max(at.values()) <= 4096
    return len(at)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_least(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6.5, 1, 20000), 1, 4096).astype(int)
    counts = np.bincount(lengths, minlength=4097)
    plan = packing.plan_packing(counts)
    used = np.zeros(4097, int)
    for run, parts in plan:
        assert sum(n * t for n, t in parts) <= 4096
        for n, t in parts:
            used[n] += run * t
    assert (used == counts).all() and sum(r for r, _ in plan) <= 1.001 * -(-lengths.sum() // 4096) + 1
    assert packing.plan_packing(np.zeros(4097, int)) == []


def test_patterns_find_what_greedy_filling_misses():
    rng, three = np.random.default_rng(0), []
    for _ in range(4000):
        a = int(rng.integers(1024, 1800))
        b = int(rng.integers(1024, min(1800, 3072 - a)))
        three += [a, b, 4096 - a - b]
    report = {}
    plan = packing.plan_packing(np.bincount(three, minlength=4097), report=report)
    assert sum(r for r, _ in plan) <= 4120 and report["by_patterns"] > 9000  # best-fit alone takes 4460
    four = np.bincount([1200] * 3000 + [1390] * 3000 + [1500] * 3000 + [2048] * 100, minlength=4097)
    assert sum(r for r, _ in packing.plan_packing(four)) == 3050
    assert sum(r for r, _ in packing.plan_packing(np.bincount([5] * 7 + [1] * 3, minlength=9), 8)) == 7


def test_nnls():
    rng = np.random.default_rng(0)
    a, x = rng.random((30, 12)), np.maximum(rng.standard_normal(12), 0)
    assert np.allclose(packing.nnls(a, a @ x), x, atol=1e-6)


def test_hilbert_keys_are_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    path = cells[np.argsort(ann.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((420, 6)).astype(np.float32)
    x[50:200] = x[0]  # a very common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, [1.0]), (1100, [None] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([*data, *bad, data[7]], "vec_id long, embedding array<float>").withColumn("d", F.lit(1))
    y = x.astype(float)
    want = []
    for q in range(0, 420, 100):
        d = ann.distances(np.broadcast_to(y[q], y.shape), y)
        order = [i for i in np.lexsort((np.arange(420), d)) if i != q][:10]
        want += [(q, r + 1, int(i), d[i]) for r, i in enumerate(order)]
    for exhaustive in (False, True):
        assert [tuple(r) for r in ann.nearest(df, exhaustive=exhaustive).orderBy("query_id", "rank").collect()] == want
    # narrow windows and small blocks cut by partition borders: what is found is right in itself
    some = ann.nearest(df, orderings=4, window=20, recall=0.5).collect()
    assert all(abs(ann.distances(y[r.query_id][None], y[r.vec_id][None])[0] - r.score) == 0 for r in some) and len(some) == 50
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.where("vec_id < 3")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few)[-1][1] == 2
    two = df.union(spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(2000, 2103)], df.schema))
    other = ann.nearest(two).where("query_id >= 2000").orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in other] == [*range(2001, 2011), 2099, 2101, 2098, 2102, *range(2097, 2091, -1)]


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 1.0), ("sf0.1", 0.9)])
def test_recall_of_the_curves(spark, sf, least):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id")
    x = np.array([r.embedding for r in rows.collect()], float)
    found = {(r.query_id, r.vec_id) for r in ann.nearest(rows).collect()}
    hits = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += sum((q, int(i)) in found for i in np.argsort(d)[:10])
    assert hits >= least * 10 * len(range(0, len(x), 100))


def test_places_on_curves(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(700)], "rid long, vector array<double>").repartition(9)
    got = ann.places(df, 700, 5, 3, 1).collect()
    for c in range(3):
        assert sorted(r.place for r in got if r.curve == c) == list(range(700))


def test_windows_reach_the_wanted_recall(spark):
    # windows narrower than the table, on vectors with and without structure
    rng = np.random.default_rng(6)
    for dims, spread in ((24, 1.0), (24, 0.05)):
        x = rng.standard_normal((6000, dims)) * spread + rng.standard_normal((60, dims))[rng.integers(0, 60, 6000)]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        out = {(r.query_id, r.vec_id) for r in ann.nearest(df, window=64, sample=32).collect()}
        hits = 0
        for q in range(0, 6000, 100):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits += sum((q, int(i)) in out for i in np.argsort(d)[:10])
        assert hits / 600 >= 0.9


def test_classifier(spark):
    # the smallest tables hold out 19 labelled documents, too few to measure a share
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.train(*quality_classifier.labelled_bags(docs, labels))
    found = quality_classifier.score(docs.join(labels, "doc_id"), model).where(crc_mod(F.col("doc_id"), 5) == 0)
    right = found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right >= 0.9
    edge = quality_classifier.score(odd(spark).withColumn("score", F.lit("s")), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in edge) and edge[0].score == edge[1].score
    assert quality_classifier.score(odd(spark).limit(0), model).count() == 0
    assert quality_classifier._scores(quality_classifier.train([], []), ["x"], {})[0] == 0.5
    twice = quality_classifier.score(odd(spark).union(odd(spark)), model).groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert twice.where("n = 1 and rows = 2").count() == len(ODD)


def features_brute(text, bits):
    """The hashed features of a text one by one: each word between < and >, its n-grams, and the word as a whole."""
    m64 = (1 << 64) - 1
    mix = lambda x: ((((x ^ x >> 33) * 0xFF51AFD7ED558CCD + 0x9E3779B97F4A7C15) & m64) ^ (((x ^ x >> 33) * 0xFF51AFD7ED558CCD + 0x9E3779B97F4A7C15) & m64) >> 29) * 0xFF51AFD7ED558CCD & m64
    out = []
    for word in text.split():
        points = [ord(c) for c in f"<{word}>"]
        for n in range(quality_classifier.LOW, quality_classifier.HIGH + 1):
            for i in range(len(points) - n + 1):
                h = 0
                for p in points[i : i + n]:
                    h = (h ^ p) * 0x100000001B3 & m64
                out.append(mix(h + n & m64) >> 64 - bits)
        out.append(mix(mix(sum((p + 1) * mix(i) for i, p in enumerate(points)) & m64)) >> 64 - bits)
    words = text.split()
    return out + [1 << bits for a, b in zip(words, words[1:], strict=False) if a == b]


def test_driver_fetches_bags_in_small_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(60)] + [(60, None)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality")
    whole = quality_classifier.labelled_bags(docs, labels)
    fetched = []
    own = type(docs).toArrow

    def counted(df):
        fetched.append(own(df))
        return fetched[-1]

    monkeypatch.setattr(type(docs), "toArrow", counted)
    monkeypatch.setattr(quality_classifier, "FETCHED", 1000, raising=False)
    bags, given = quality_classifier.labelled_bags(docs, labels)
    assert given == whole[1] and all((a == b).all() for x, y in zip(bags, whole[0], strict=True) for a, b in zip(x, y, strict=True))
    sizes = [len(i) for i, _ in bags]
    assert sum(i.nbytes + c.nbytes for i, c in bags) == 8 * sum(sizes)
    assert all(sum(map(len, t["ids"].to_pylist())) <= max(1000, *sizes) for t in fetched) and len(fetched) > 3
    texts = {bytes(i.astype(np.int64)): c for i, c in (quality_classifier.bag(r.text) for r in docs.collect())}
    assert all((texts[bytes(i.astype(np.int64))] == c).all() for i, c in bags)


def test_classifier_against_a_plain_version():
    """Features, training steps and scores, each without the tricks of the operator."""
    texts, labels = ["good text here", "bad bad words é🙂", "", "text of words", "a"], [1, 0, 1, 1, 0]
    bits, dim = quality_classifier.BITS, 4
    bags = [quality_classifier.bag(t) for t in texts]
    for t, (ids, counts) in zip(texts, bags, strict=True):
        plain = np.bincount(features_brute(t, bits), minlength=(1 << bits) + 1) if t else np.zeros((1 << bits) + 1)
        assert (np.flatnonzero(plain) == ids).all() and (plain[ids] == counts).all()
    model = quality_classifier.train(bags, labels, dim=dim, epochs=1, rate=0.5, seed=3)
    rng = np.random.default_rng(3)
    vectors, layer, bias = rng.uniform(-1 / dim, 1 / dim, ((1 << bits) + 1, dim)), np.zeros((dim, 2)), np.zeros(2)
    rows = [(features_brute(t, bits), y) for t, y in zip(texts, labels, strict=True) if t]
    epochs, step = -(-quality_classifier.STEPS // len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, y = rows[k]
            mean = sum(vectors[i] for i in ids) / len(ids)
            out = [mean @ layer[:, c] + bias[c] for c in (0, 1)]
            e = np.exp(np.array(out) - max(out))
            slope = e / e.sum() - np.eye(2)[y]
            lr = 0.5 * (1 - step / (epochs * len(rows)))
            back = layer @ slope
            layer, bias = layer - lr * np.outer(mean, slope), bias - lr * slope
            for i in ids:
                vectors[i] -= lr * len(set(ids)) ** 0.5 / len(ids) * back
            step += 1
    for t in [*texts, "new words good"]:
        ids = features_brute(t, bits)
        out = (sum(vectors[i] for i in ids) / len(ids) if ids else np.zeros(dim)) @ layer + bias
        assert abs(quality_classifier._scores(model, [t], {})[0] - 1 / (1 + np.exp(out[0] - out[1]))) < 1e-6


def test_new_words_are_scored_in_small_parts():
    model = quality_classifier.Model(np.random.default_rng(1).normal(size=quality_classifier.AGAIN + 1), 0.1)
    text = " ".join(f"word{i}" for i in range(1 << 15))
    tracemalloc.start()
    got = quality_classifier._scores(model, [text, None], {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids, counts = quality_classifier.bag(text)
    assert np.allclose(got, 1 / (1 + np.exp(-np.array([model.bias + model.weights[ids] @ counts / counts.sum(), model.bias])))) and peak < 32 << 20


def test_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    found = language_id.identify(docs, model)
    assert found.where(crc_mod(F.col("doc_id"), 3) == 1).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    some = {r.lang: r.text for r in docs.where("length(text) between 600 and 2000").collect()}
    mixed = language_id.identify(odd(spark, [some["en"] + " " + some["de"], None, "12 34 !!", ""]), model).orderBy("doc_id").collect()
    assert [s.lang for s in mixed[0].spans if s.words > 20] == ["en", "de"]
    assert [(r.lang_pred, r.score, r.spans) for r in mixed[1:]] == [("und", 0.0, [])] * 3
    assert language_id.identify(docs.limit(0), model).count() == 0
    clash = odd(spark).union(odd(spark)).withColumns({n: F.lit("mine") for n in ("score", "spans", "row", "found")})
    out = language_id.identify(clash, model)
    assert out.where("row = 'mine' and found = 'mine'").count() == 2 * len(ODD) and out.select("doc_id", "lang_pred", "score").distinct().count() == len(ODD)
    with pytest.raises(ValueError, match="different values"):
        language_id.fit(spark.range(700).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang")))
    nothing = language_id.fit(docs.limit(0))
    assert language_id.identify(odd(spark), nothing).where("lang_pred != 'und'").count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    tool = language_id.Labeller(language_id.Model(("a", "b", "c"), np.zeros((1, 3)), np.ones((1, 3), bool)))
    tool.scores = (rng.standard_normal((50, 3)) * 8).astype(np.float32)
    rows = [rng.integers(0, 50, n) for n in (5, 0, 7, 1, 5)]
    for path, row in zip(tool._viterbi(rows), rows, strict=True):
        value = lambda p, row=row: sum(float(tool.scores[r, s]) for r, s in zip(row, p, strict=True)) - language_id.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max((value(p) for p in np.ndindex(*[3] * len(row))), default=0.0)
        assert abs(value(path.tolist()) - best) < 1e-3


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DATA).collect()
    assert check_places([(r.sequence_id, r.offset, r.length) for r in out]) >= 1
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "line dedup", "simhash near-dedup", "best-fit packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns
        if name == "simhash near-dedup":
            f = np.array([fingerprint_brute(r.text) for r in before.orderBy("doc_id").collect()], np.uint64)
            ids = [r.doc_id for r in before.orderBy("doc_id").collect()]
            kept = [r.doc_id for r in after.orderBy("doc_id").collect()]
            near, label = np.bitwise_count(f[:, None] ^ f[None]) <= 2, np.arange(len(f))
            while not (new := np.array([label[n].min() for n in near])).__eq__(label).all():
                label = new
            assert kept == [ids[i] for i in sorted(set(label.tolist()))]
        before = after
    assert {r.doc_id for r in out} == {r.doc_id for r in before.collect()}


NAMES = ("n_words", "kept", "base_failed", "score", "predicted", "n_lines", "n_dropped", "_kept", "row", "_k1", "root", "fp", "label", "text_", "id", "bucket", "slot", "sequence_id")


def test_stages_leave_other_columns_and_rows_alone(spark):
    import corpus_pipeline

    prose = [" ".join(random.Random(f"{i} {j}").choice(["stone", "river", "green", "light", "house", "under", "north", "paper", "field", "quiet"]) + str(random.Random(f"{j} {i}").randint(0, 99)) for j in range(90)) for i in range(6)]
    rows = [(1, prose[0]), (1, prose[1]), (2, prose[2]), (None, prose[3]), (None, prose[4]), (3, prose[5]), (4, prose[5]), (4, prose[5]), (5, None), (6, ""), (7, "w " * 30000)]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").withColumns({n: F.lit(f"mine {n}") for n in NAMES})
    before, counts = df, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, DATA)
        assert after.columns == df.columns and dict(after.dtypes) == dict(df.dtypes), name
        found = after.collect()
        assert all(r[n] == f"mine {n}" for r in found for n in NAMES), name
        counts[name] = sorted((r.text for r in found), key=str)
        assert stage(spark, df.limit(0), DATA).count() == 0, name
        before = after
    assert counts["quality rules"] == sorted([t for _, t in rows[:8]])
    assert counts["simhash near-dedup"] == sorted(set(counts["line dedup"]))
    packed = corpus_pipeline.STAGES[4][1](spark, df, DATA)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and check_places([(r.sequence_id, r.offset, r.length) for r in packed.collect()])
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.STAGES[4][1](spark, df.limit(0), DATA).count() == 0
    # stages after the first on rows that it would reject
    assert corpus_pipeline.stage_lines(spark, df, DATA).where("doc_id = 5 and text = '' and n_chars = 0").count() == 1
    assert corpus_pipeline.stage_near_duplicates(spark, df, DATA).where("doc_id in (5, 6)").count() == 1


def test_chunks_are_tokenized_as_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    tool, whole, pick = packing.ChunkTokenizer(path), Tokenizer.from_file(path), random.Random(5)
    latin = "aBc\u00e9\u00df\u00c5t's.,;!?*#<>|&$% \n\t\r\x0b\x0c\x1c\x85\xa0\xad12\u00bd\u00aa\u00a1\u00b5\u00d7"
    texts = ["", None, "<|endoftext|>", "A<|ENDOFTEXT|>b", "don't. DON'T! x<|endoftext|>.", "a" * 5000]
    for alphabet in (latin, latin + "e\u0301\u0130\u03a3\u03c2\u6f22\u200d\u212b\u0338"):
        texts += ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, tool(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)
