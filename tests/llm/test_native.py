"""Line dedup, chat formatting, quality rules and URL verdicts against plain Python."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ellipsa.llm import chat_format, line_dedup, quality_classifier, quality_rules, queries, sql, url_filter

DOCS = "doc_id long, text string, row string, n_lines int, _k1 string"
SHARED = " \tShared LINE\r"
TEXTS = [None, "", "\n", SHARED, f"own\n{SHARED}\n{SHARED}", f"shared line\nÉtat {'x' * 5000}", *[f"a{i}\nshared line" for i in range(7)], *["shared line"] * 2]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1, "k") for i, t in enumerate(TEXTS)], DOCS)


def lines_brute(texts, least):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    return [(len(ls), sum(seen[key(x)] >= least for x in ls if key(x)), "\n".join(x for x in ls if seen[key(x)] < least)) for ls in split]


@pytest.mark.parametrize("least", [2, 10, 11])
def test_line_dedup(spark, docs, least):
    out = line_dedup.line_dedup(docs, min_docs=least).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in out] == lines_brute(TEXTS, least)
    assert out[0]["row"] == "r" and out[0]["_k1"] == "k"


def test_line_dedup_repeats_nulls_and_empty(spark, docs):
    twice = docs.union(docs).union(spark.createDataFrame([(None, "z", None, None, None)] * 3, DOCS))
    out = line_dedup.line_dedup(twice, min_docs=3)
    assert out.count() == twice.count() and out.where("doc_id is null and n_dropped = 1").count() == 3
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0
    plain = line_dedup.line_dedup(docs.drop("doc_id"), min_docs=3, counted=False)
    assert plain.columns == docs.columns[1:] and plain.where("n_lines = 1").count() == docs.count()


def test_line_dedup_agrees_with_its_sql_on_repeated_ids(spark, tmp_path):
    rows = [(7, f"same\nown {i}") for i in range(12)] + [(i, f"often\n{i}") for i in range(20, 31)] + [(None, f"lost\n{i}") for i in range(10)] + [(8, "often"), (8, "often"), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.line_dedup(df).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    df.toPandas().astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, con.execute(sql.ORACLE["op6_line_dedup"]).fetchall()))
    assert out.where("n_dropped > 0").count() == 23  # the id of "same" is one document


def test_line_dedup_deals_very_common_rows_out(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 4)
    rows = [(1, "a\nb\na")] * 30 + [(i, "a\nc") for i in range(2, 11)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).groupBy("doc_id", "text", "n_dropped").count().collect()
    assert sorted(map(tuple, out)) == [(1, "b", 2, 30), *((i, "c", 1, 1) for i in range(2, 11))]


TURNS = [
    (1, 0, "user", "a <| b \\ <|end|>\n"),
    (1, 1, "user", "tail<"),
    (1, 2, "assistant", None),
    (1, 3, "assistant", "\\l| \\b <|also|>"),
    (1, 3, "assistant", "\\l| \\b <|also|>"),
    (2, None, None, "x" * 30000),
    (None, 1, "assistant", "é🙂"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.format_chats(df).select("*", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    found = {r.conv_id: r for r in out.collect()}
    groups = defaultdict(list)
    for c, t, role, text in TURNS:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    assert found.keys() == groups.keys()
    lost = chat_format.format_chats(spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")], df.drop("turns").schema))
    assert sorted(r.formatted for r in lost.collect()) == ["<|turn|>assistant<|text|>b<|end|>\n"] + ["<|turn|>user<|text|>a<|end|>\n"] * 2
    for c, turns in groups.items():
        assert [(t.role, t.text) for t in found[c].back] == [(r, t) for _, r, t in sorted(turns)]
        assert found[c].loss == "".join(t for _, r, t in sorted(turns) if r == "assistant")
        assert found[c].formatted.count("<|turn|>") == 1 + sum(a[1] != b[1] for a, b in zip(sorted(turns), sorted(turns)[1:], strict=False))
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_conversation_takes_little_longer(spark):
    df = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    began = time.time()
    out = chat_format.format_chats(df).select(F.length("formatted").alias("n"), F.size("loss_spans").alias("spans"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert out.spans == 66_666 and out.loss == "".join(f"t{i}" for i in range(100_000) if i % 3) and time.time() - began < 30


def rules_brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a b c", "x x x x x", "one\none\n \n \nTwo é🙂 #|", "the cat sat on the cat sat " * 900, "w\x0bv\x0cu w v u"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, _words string")
    out = quality_rules.apply_rules(df, []).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out] == [rules_brute(t) for t in texts]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r["_words"] == "c" for r in out)
    assert quality_rules.apply_rules(df.limit(0), []).count() == 0


def test_decision_list_is_what_spark_evaluates(spark):
    rows = [(quality_rules.feature_row(dict(zip(quality_rules.COUNTS, c, strict=True))), y) for *c, y in [(100, 500, i, 0, i % 5, 3, 0, int(i < 20)) for i in range(60)]]
    rules = quality_rules.learn_decision_list(rows)
    assert rules and all(any(all(c(f) for c in r) for r in rules) == (not y) for f, y in rows)
    df = spark.createDataFrame([(100, 500, i, 0, i % 5, 3, 0) for i in range(60)], ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    assert [r[0] for r in df.select(quality_rules.verdict(rules)).collect()] == [bool(y) for _, y in rows]
    assert quality_rules.learn_decision_list([]) == [] and quality_rules.learn_decision_list(rows[:20]) == []


def test_labelled_samples(spark):
    """Null, doubled and contradicting labels, ids that repeat, long and empty texts, empty tables."""
    docs = spark.createDataFrame([(i, f"word{i} x") for i in range(30)] + [(3, "other text")] * 500 + [(None, "n"), (5, None), (6, "")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (3, 1), (4, None), (None, 1), (7, 5)], "doc_id long, quality int")
    held = {r.doc_id for r in labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()}
    wanted = [i for i in range(30) if i not in held]
    rows = quality_rules.labelled_rows(docs, labels)
    assert len(rows) == len(wanted) and sum(y for _, y in rows) == sum(i % 2 and i != 3 for i in wanted)
    again = quality_classifier.labelled_bags(docs.repartition(7), labels)
    first = quality_classifier.labelled_bags(docs, labels)
    assert len(first[0]) == len(wanted) and first[1] == again[1] and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(first[0], again[0], strict=True))
    few = quality_classifier.labelled_bags(docs, labels, most=4)
    assert 0 < len(few[1]) <= 4 and few[1] == first[1][: len(few[1])]
    bounded = quality_classifier.labelled_bags(docs, labels, buckets=60)
    assert 0 < len(bounded[0]) < len(wanted) and sum(len(i) for i, _ in bounded[0]) <= 60
    assert quality_classifier.labelled_bags(docs.limit(0), labels) == ([], []) and quality_rules.labelled_rows(docs, labels.limit(0)) == []


def test_judged_rows_repeat_alike(spark):
    df = spark.createDataFrame([(1, "a b c " * 60, "mine")] * 3 + [(2, None, "x")], "doc_id long, text string, kept string")
    out = quality_rules.apply_rules(df, [])
    assert out.where("kept").count() == 0 and out.select("n_words", "base_failed").distinct().count() == 2 and out.count() == 4
    prose = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), "mine")] * 3, df.schema)
    assert [r.kept for r in quality_rules.keep_documents(prose, []).collect()] == ["mine"] * 3


def test_urls(spark):
    urls = [None, "", "nohost", "HTTP://Ex.ORG?x", "a://x.org/p", "a://notorg/p", "s://a.EXAMPLE.org/en/12#x", "s://example.org/es/", "x://b.com/de/://y", "x://sub.spam-farm.example.net/q", "x://spam-farm.example.network/", "x://" + "a." * 300 + "casino-win.example.com/z"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    blocked = ["spam-farm.example.net", "Casino-Win.example.com", "absent.example.com"]
    out = {r.page_id: r for r in url_filter.judge_urls(df.union(df), blocked).collect()}
    assert [out[i].verdict for i in range(len(urls))] == ["allow"] * 6 + ["block", "block", "block", "block", "allow", "block"]
    assert [out[i].rule for i in (3, 4, 6, 7, 8)] == [None, "org/", "example.org/en/1", "example.org/es/", "com/de/"]
    assert out[0].host == "" and out[3].host == "ex.org" and out[3].path == ""
    assert url_filter.judge_urls(df.limit(0), blocked).count() == 0 and url_filter.judge_urls(df, []).where("verdict = 'block'").count() == 3
    ties = (("block", "b.com", "/a"), ("allow", "com", "/a/b/c"), ("allow", "a.b.com", "/"), ("block", "a.b.com", "/a"))
    fit = url_filter.judge_urls(spark.createDataFrame([(1, "x://a.b.com/a")], "page_id long, url string"), [], ties).first()
    assert (fit.rule, fit.verdict) == ("a.b.com/a", "block")
    same = url_filter.judge_urls(spark.createDataFrame([(1, "x://a.b/c/d")], "page_id long, url string"), [], (("block", "b", "/c/d"), ("allow", "a.b", "/c"))).first()
    assert (same.rule, same.verdict) == ("a.b/c", "allow")  # of equally long rules the first in text order


def test_thin_addresses(spark):
    pages = spark.createDataFrame([("x://A.b/1?q", "1234"), ("x://a.b/1#f", "12"), ("x://c.d", "123"), ("x://e.f/", None), ("x://e.f/G", "12345"), (None, ""), ("none", "")], "url string, html string")
    assert sorted(r.key for r in url_filter.thin_addresses(pages, 3).collect()) == ["a.b/1", "e.f/"]
    assert sorted(r.key for r in url_filter.thin_addresses(pages, 4).collect()) == ["a.b/1", "c.d/", "e.f/"]
    out = url_filter.judge_urls(pages, url_filter.thin_addresses(pages, 4), ()).collect()
    assert [r.verdict for r in sorted(out, key=lambda r: str(r.url))] == ["allow", "allow", "block", "block", "block", "block", "allow"]
    listed = url_filter.judge_urls(pages, ["E.F/G", "d", "A.B/1/2"], ()).where("verdict = 'block'")
    assert sorted(r.url for r in listed.collect()) == ["x://c.d", "x://e.f/G"]


@pytest.mark.parametrize(("most", "local"), [(64 << 20, 1 << 16), (64 << 20, 0), (400, 50)])
def test_cascade_is_exact(spark, most, local):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(hash(key), 7) = 0").union(spark.createDataFrame([("absent",), (None,)], "key string"))
    shards = url_filter.build_shards(universe, listed, most, local)
    assert (len(shards) > 1) == (most == 400) and len(shards[0].levels) > 1
    found = url_filter.listed_any(universe.withColumns({"ks": F.array("key"), "_a": F.lit("mine"), "a": F.lit(1)}), "ks", "hit", shards)
    assert found.columns == ["key", "ks", "_a", "a", "hit"] and found.where("_a = 'mine' and a = 1").count() == 5000
    assert found.where("hit != (pmod(hash(key), 7) = 0)").count() == 0


def test_sha_is_python_sha(spark):
    assert spark.sql("select sha2('é', 256)").first()[0] == hashlib.sha256("é".encode()).hexdigest()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_matches_sql(spark, tables, name):
    want = tables.execute(sql.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
