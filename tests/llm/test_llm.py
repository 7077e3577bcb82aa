"""The ten operators and the pipeline against brute force, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import os
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoglotta.llm import chat_format, decontaminate, exact_dedup, html_extract, lm_score, near_dedup, packing, token_files, toxicity, url_filter
from isoglotta.llm.common import LOWER, word_hashes
from isoglotta.llm.tokenization import CachedTokenizer, public_path

WORD = "doc_id bigint, text string, n int, items string, length int, id string, part int"


def docs(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y", 3) for i, t in enumerate(texts)], WORD)


RNG = np.random.default_rng(5)
VOCAB = ["".join(RNG.choice(list("abcdefghijklmno"), RNG.integers(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


ODD = [None, "", " \n\t ", "a", "A", "é", "É", "x" * 9000, "日本 語", "tab\tand\x0bvt", "  lead  and trail  ", "no break   em"]


# 1 chat


def by_md5(x):
    return x[0], x[1], hashlib.md5(x[2].encode()).hexdigest()


def brute_chat(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append(((turn is not None, turn or 0), role or "", text or "", -1 if turn is None else turn // 64))
    out = {}
    for c, turns in by.items():
        turns.sort(key=by_md5)
        for who in {r for _, r, _, _ in turns if r != "system"}:
            at, parts = 0, defaultdict(lambda: [None, 0, "", []])
            for _, role, text, part in sorted(turns, key=lambda x: (x[3], by_md5(x))):
                head = "<|im_start|>system\n" if role == "system" else "<|im_start|>assistant\n" if role == who else f"<|im_start|>user name={role}\n"
                seg, p = head + text + "<|im_end|>\n", parts[part]
                p[0] = at if p[0] is None else p[0]
                p[1], p[2] = p[1] + 1, p[2] + seg
                if role == who:
                    p[3].append(f"{at + len(head)}:{at + len(seg) - 1}")
                at += len(seg)
            for part, p in parts.items():
                out[c, who, part] = (p[0], p[1], p[2], ",".join(p[3]))
    return out


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2, "cy", "z"), (2, 0, "system", "only"), (None, 5, "a", "b"), (None, None, None, "q"), (3, 7, "a", "")]
    rows += [(4, t, "ab"[t % 2], f"turn {t}") for t in range(200)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, part int, perspective string")
    got = {(r["conv_id"], r["perspective"], r["part"]): (r["char_start"], r["n_turns"], r["rendered"], r["masks"]) for r in chat_format.rotate(d, parts_per_block=2).collect()}
    assert got == brute_chat(rows)
    whole = "".join(got[4, "a", p][2] for p in range(4))
    for span in ",".join(got[4, "a", p][3] for p in range(4)).split(","):
        s, e = map(int, span.split(":"))
        assert re.fullmatch(r"turn \d+<\|im_end\|>", whole[s:e])
    assert chat_format.rotate(d.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_part", [4, 10])
def test_hot_parts_are_cut_into_pieces_in_order(spark, rows_per_part):
    rows = [(None, None, None, None)] * 23 + [(None, None, "ann", f"w{i % 30}") for i in range(70)] + [(None, 3, "bob", "one text")] * 15 + [(None, 3, f"p{i}", "x") for i in range(6)]
    rows += [(1, i, "ann", "a") for i in range(5)] + [(2, 0, "system", "s"), (2, 1, "cy", "<|im_end|>")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = defaultdict(list)
    for r in chat_format.rotate(d, rows_per_part=rows_per_part).collect():
        assert r["n_turns"] <= rows_per_part * 3
        got[r["conv_id"], r["perspective"], r["part"]].append((r["piece"], r["char_start"], r["n_turns"], r["rendered"], r["masks"]))
    joined = {}
    for k, pieces in got.items():
        pieces.sort()
        at = pieces[0][1]
        for _, start, _, rendered, _ in pieces:
            assert start == at
            at += len(rendered)
        joined[k] = (pieces[0][1], sum(p[2] for p in pieces), "".join(p[3] for p in pieces), ",".join(p[4] for p in pieces if p[4]))
    assert joined == brute_chat(rows) and max(len(p) for p in got.values()) > 5


# 2 packing


def test_packing_places_every_piece(spark):
    t = CachedTokenizer(public_path("word_bpe_49k.json"))
    texts = ODD + [prose(int(n)) for n in RNG.integers(1, 60, 80)] + [prose(400)] + ["same text"] * 50
    got = packing.pack_documents(docs(spark, texts), capacity=64).collect()
    ids = {i: t.whole(x or "") + np.array([1], "<u4").tobytes() for i, x in enumerate(texts)}
    want = {(i, k): (at // 4, len(b[at : at + 256]) // 4, zlib.crc32(b[at : at + 256])) for i, b in ids.items() for k, at in enumerate(range(0, len(b), 256))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 64
    least = -(-sum(n for _, n, _ in want.values()) // 64)
    assert len(seq) <= least * 1.03 + 1
    assert packing.pack_documents(docs(spark, texts).limit(0), capacity=64).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
def test_plan_holds_the_histogram(h):
    p, seen = packing.plan(h, 50, 4), Counter()
    for n, slots in p:
        assert n > 0 and sum(slots) <= 50
        for x in slots:
            seen[x] += n
    assert seen == Counter(h)


def test_nnls_matches_its_conditions():
    a, b = np.abs(RNG.normal(size=(20, 40))), np.abs(RNG.normal(size=20))
    x = packing.nnls(a, b)
    w = a.T @ (b - a @ x)
    assert (x >= 0).all() and (w <= 1e-6).all() and np.abs(w[x > 0]).max() < 1e-6


# 3 toxicity


def test_toxicity_learns_planted_words(spark):
    bad = ["zorgfub", "mekkriv", "plozzenk"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(int(RNG.integers(20, 120))).split()
        y = i % 4 == 0
        for _ in range(3 * y):
            w.insert(int(RNG.integers(len(w))), bad[i % 3])
        rows.append((i, " ".join(w), "label", "src"))
        labels.append((i, 0, int(y)))
    rows += [(2000, None, "a", "b"), (2001, "", "a", "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, score string, predicted string")
    lab = spark.createDataFrame(labels + [(5000, 1, 1), (7, 0, None)], "doc_id bigint, quality int, toxic int")
    m = toxicity.train(d, lab)
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, m).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert got[2000]["predicted"] == 0 == got[2001]["predicted"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.reject_toxic(d, m)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(d, none).collect())


# 4 urls


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://x.org/casino", "x.org", "/casino", "org/", "allow"), ("http://x.org", "x.org", "", None, "allow"),
        ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"), ("http://notexample.org/en/1", "notexample.org", "/en/1", "org/", "allow"), ("http://a.com/fr/porn", "a.com", "/fr/porn", "com/fr/", "allow"),
        ("http://a.net/free-bets", "a.net", "/free-bets", None, "block"), ("http://a.net/free-free", "a.net", "/free-free", None, "allow"), ("http://a.net/freedom-bets", "a.net", "/freedom-bets", None, "allow"),
        ("http://a.net/XXX", "a.net", "/XXX", None, "block"), ("xxx", "", "", None, "block"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?q", "", "", None, "allow"),
    ],
)
def test_url_verdicts(spark, url, host, path, rule, verdict):
    rules: dict = {}
    for v, r in url_filter.RULES:
        h, s, p = r.partition("/")
        rules.setdefault(h, []).append((s + p, v))
    assert url_filter.split_url(url) == (host, path)
    found = url_filter.find_rule(rules, host, path)
    s, f = url_filter.count_terms(url_filter.build(url_filter.STRICT, url_filter.SOFT), url)
    assert (found or (None, "block" if s or f >= 2 else "allow")) == (rule, verdict)


def test_url_filter_rows(spark):
    d = spark.createDataFrame([(1, "http://a.net/free-bets", "h", "r"), (1, "http://a.net/free-bets", "h", "r"), (None, None, None, None)], "page_id bigint, url string, host string, rule string")
    assert [tuple(r) for r in url_filter.url_filter(d).orderBy("page_id").collect()] == [(None, "", "", None, "allow", 0, 0)] + 2 * [(1, "a.net", "/free-bets", None, "block", 0, 2)]
    assert url_filter.url_filter(d.limit(0)).count() == 0


# 5 exact copies


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("collide", [False, True])
def test_exact_groups(spark, collide):
    long = prose(3000)
    texts = ODD + [long, long.upper(), long + " ", prose(900), "y" * 20000, "y" * 20001, "Y" * 20000, "same"] + ["Same"] * 30
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_groups(docs(spark, texts), hash_of=(lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if collide else F.xxhash64).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[low(t)].append(i)
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    kept = exact_dedup.keep_one(docs(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()} and kept.columns == docs(spark, texts).columns


def test_chunks_cross_the_network_once(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefghij "), 6000)) for _ in range(200)]
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        java = spark.sparkContext._jvm.java.util
        stages = sc.statusStore().stageList(java.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), java.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins as of larger tables
    try:
        before = written()
        assert exact_dedup.recipes(docs(spark, texts), exact_dedup.Scratch(spark)).count() == 200
        sent = sum(n for k, n in written().items() if k not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    size = sum(map(len, texts))
    assert size / 2 < sent < 1.5 * size


def test_chunks_join_to_the_text(spark):
    d = docs(spark, ODD + [prose(5000), "q" * 9999])
    joined = d.select((F.array_join(exact_dedup.chunks(exact_dedup.normalised(F.col("text"))), "") == exact_dedup.normalised(F.col("text"))).alias("ok"))
    assert joined.where("NOT ok").count() == 0
    assert exact_dedup.exact_groups(d.limit(0)).count() == 0


# 6 token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=40), max_size=8))
def test_shards_round_trip(lists):
    names = [None if len(x) % 3 == 2 else len(x) - 9 for x in lists]
    blob = token_files.encode_shard([np.array(x, dtype=np.uint32) for x in lists], names, 3, 4, 1 << 40)
    ids, sizes, got = token_files.decode_shard(blob)
    assert ids.tolist() == [v for x in lists for v in x] and sizes.tolist() == [len(x) for x in lists] and got == names
    assert token_files.shard_head(blob) == (3, 4, 1 << 40, len(ids))


def test_ranks_of_small_and_large_ids():
    ids = RNG.integers(0, 50, 500).astype(np.uint32)
    for x in (ids, ids + np.uint32(1 << 31)):
        table, rank = token_files.ranked(x)
        assert (table[rank] == x).all()
        n = Counter(x.tolist())
        assert table.tolist() == sorted(n, key=lambda v: (-n[v], v))


def test_values_of_every_width():
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], dtype=np.uint32)
    control, data = token_files.encode_values(v)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4 + 1 and token_files.decode_values(control, data, len(v)).tolist() == v.tolist()


def test_token_files_of_documents(spark, tmp_path):
    texts = ODD + [prose(int(n)) for n in RNG.integers(1, 200, 40)] + ["<|endoftext|> a", "a\n\nb  c", "don't  stop\r\n", "m " * 300_000]
    d = docs(spark, texts).unionByName(docs(spark, ["z", None]).withColumn("doc_id", F.lit(None).cast("bigint"))).unionByName(docs(spark, ["again"]))
    rows = sorted([(i, x) for i, x in enumerate(texts)] + [(None, "z"), (None, None), (0, "again")], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    token_files.write_token_files(d.repartition(3), str(tmp_path / "f"), public_path("byte_bpe_50k.json"), shard_ids=500)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    t, at, want = CachedTokenizer(public_path("byte_bpe_50k.json")), 0, []
    for i, x in rows:
        b = t.whole(x or "") + np.array([2], "<u4").tobytes()
        want.append((i, at, len(b) // 4, zlib.crc32(b)))
        at += len(b) // 4
    assert got == want and spark.read.parquet(str(tmp_path / "f/shards")).count() > 3
    token_files.write_token_files(d.limit(0), str(tmp_path / "e"), public_path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(TypeError):
        token_files.write_token_files(d.withColumn("doc_id", F.lit("x")), str(tmp_path / "s"), public_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_tokenizer_equals_the_library(name):
    t = CachedTokenizer(public_path(name), limit=50)
    assert t.kind
    for x in [x or "" for x in ODD] + ["It's A1b2 — x²½ «É» ß ı İ Σας.", "a\n\nb", "a \n b", "<|endoftext|>x", "x\x1cy z\x85w", prose(300), "É. é Å ﬁ"]:
        assert t.ids(x) == t.whole(x), x


# 7 language model


def test_base_score_and_gain(spark):
    texts = ODD + [prose(60) for _ in range(60)]
    texts += [texts[-1]] * 5
    got = {r["doc_id"]: r for r in lm_score.score_texts(docs(spark, texts), block_bytes=2000, range_bytes=500).collect()}
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + [None] for i, t in enumerate(texts)}
    c = Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] < 0
    assert lm_score.score_texts(docs(spark, texts).limit(0)).count() == 0


def test_predictions_sum_to_one(spark):
    """Scores of every one-word text under a fixed corpus are a distribution over the vocabulary, the end and one unknown word."""
    words = [f"w{i}" for i in range(12)]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:40]
    probe = [i for i in range(400, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:14]
    rows = [(i, " ".join(RNG.choice(words, 30))) for i in train] + [(p, w) for p, w in zip(probe, words + ["never", ""])]
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    # P(w | start) P(end | w): divide by P(end | w) from texts "w w": not needed, compare sums through the root instead
    total = sum(10 ** got[p] for p in probe)
    assert 0 < total <= 1 + 1e-9


def exact_tables(c, alpha, log_p, d):
    """Mean and deviation of the number of tables, by the recurrence of the generalised Stirling numbers."""
    t = np.arange(1, c + 1)
    logs = lm_score.log_stirling(d, c)[c, 1:] + np.cumsum(np.log(alpha + t - 1)) + log_p * t
    p = np.exp(logs - logs.max())
    p /= p.sum()
    return (p * t).sum(), np.sqrt(max((p * t * t).sum() - (p * t).sum() ** 2, 1e-12))


@pytest.mark.parametrize("d", [0.1, 0.5, 0.6, 0.9])
@pytest.mark.parametrize("c", [2, 3, 96, 97, 256, 257, 400, 2000])
def test_seating_follows_its_law_at_every_size(c, d):
    n, alpha = 3000, 20.0
    for weight in (0.5, 5.0, 50.0):
        log_p = math.log(weight / alpha)
        t = lm_score.seat(lm_score.uniforms(np.arange(n, dtype=np.uint64), 5), np.full(n, c), np.full(n, alpha), np.full(n, log_p), d)
        mean, sd = exact_tables(c, alpha, log_p, d)
        assert t.min() >= 1 and t.max() <= c and abs(t.mean() - mean) <= 3.5 * sd / math.sqrt(n) + 1e-3, (weight, t.mean(), mean)


def test_seating_of_ten_thousand_customers():
    n, alpha, d, c = 3000, 20.0, 0.6, 10_000
    logs = np.full(c + 1, -np.inf)
    logs[0] = 0  # one row of the numbers at a time
    k = np.arange(1, c + 1)
    for m in range(c):
        logs[1:] = np.logaddexp(logs[:-1], np.log(np.maximum(m - d * k, 1e-300)) + logs[1:])
        logs[0] = -np.inf
    for weight in (0.5, 5.0, 50.0):
        log_p = math.log(weight / alpha)
        p = logs[1:] + np.cumsum(np.log(alpha + k - 1)) + log_p * k
        p = np.exp(p - p.max())
        p /= p.sum()
        mean, sd = (p * k).sum(), math.sqrt((p * k * k).sum() - (p * k).sum() ** 2)
        t = lm_score.seat(lm_score.uniforms(np.arange(n, dtype=np.uint64), 5), np.full(n, c), np.full(n, alpha), np.full(n, log_p), d)
        assert abs(t.mean() - mean) <= 3.5 * sd / math.sqrt(n)


def brute_gibbs(train, d, d0, theta, sweeps, burn, seed):
    """Mean predictive probability P(w | u) by Chinese-restaurant Gibbs, customer by customer, with tables kept one by one."""
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for _, w in train})
    v = len(vocabulary)
    tables, root = defaultdict(lambda: defaultdict(list)), {w: [] for w in vocabulary}  # sizes of tables
    total = Counter()

    def p_root(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root.get(w, ())) - d0 * len(root.get(w, ())) + (theta + d0 * t) / (v + 1)) / (theta + n)

    def into(sizes, weight_new, disc):
        p = np.array([s - disc for s in sizes] + [weight_new])
        k = int(rng.choice(len(p), p=p / p.sum()))
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def out_of(sizes):
        k = int(rng.choice(len(sizes), p=np.array(sizes) / sum(sizes)))
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def sit(u, w):
        own = tables[u]
        t = sum(map(len, own.values()))
        if into(own[w], (theta + d * t) * p_root(w), d):
            t0 = sum(map(len, root.values()))
            into(root[w], (theta + d0 * t0) / (v + 1), d0)

    for u, w in train:
        sit(u, w)
    for s in range(sweeps):
        for u, w in train:
            if out_of(tables[u][w]):
                out_of(root[w])
            sit(u, w)
        if s >= burn:
            for u in tables:
                c, t = sum(map(sum, tables[u].values())), sum(map(len, tables[u].values()))
                for w in vocabulary:
                    total[u, w] += (sum(tables[u].get(w, ())) - d * len(tables[u].get(w, ())) + (theta + d * t) * p_root(w)) / (theta + c) / (sweeps - burn)
    return total


def test_scores_match_customer_by_customer_gibbs(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(6)]
    learn = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][:25]
    probe = [i for i in range(400, 4000) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    texts = {i: list(rng.choice(words, 8, p=[0.4, 0.25, 0.15, 0.1, 0.06, 0.04])) for i in learn}
    texts |= {p: [w] for p, w in zip(probe, words)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(d, sweeps=40, burn_in=10).collect()}
    train = [p for i in learn for p in zip(["<s>", *texts[i]], [*texts[i], "</s>"])]
    pairs, ones = Counter(train), Counter(w for _, w in train)
    ratio = lambda c: lm_score.discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    want = brute_gibbs(train, ratio(pairs), ratio(ones), 1.0, 60, 20, 1)
    for p, w in zip(probe, words):
        assert got[p] == pytest.approx(np.log10(want["<s>", w]) + np.log10(want[w, "</s>"]), abs=0.12)
    for i in learn[:5]:
        assert got[i] == pytest.approx(sum(np.log10(want[k]) for k in zip(["<s>", *texts[i]], [*texts[i], "</s>"])), abs=0.2)


def test_scores_dont_depend_on_blocks_and_ranges(spark):
    """Counts don't at all; scores only by the draws, since contexts spread over ranges meet their totals."""
    texts = [prose(60) for _ in range(60)]
    a, b = ({r["doc_id"]: r for r in lm_score.score_texts(docs(spark, texts), sweeps=4, **kw).collect()} for kw in ({}, {"block_bytes": 1500, "range_bytes": 300}))
    assert all(a[i]["base_score"] == pytest.approx(b[i]["base_score"]) and a[i]["score"] == pytest.approx(b[i]["score"], rel=0.03) for i in a)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_word_fingerprints_follow_words(text):
    data = text.encode("utf-8", "surrogatepass").translate(LOWER)
    h, s, e = word_hashes(data)
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w]
    assert [data[a:b] for a, b in zip(s, e)] == words
    seen: dict = {}
    for w, x in zip(words, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# 8 html


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div><p>a</p>b<b>c</b>d<br>e</div>", "a bcd e"), (None, ""), ("", ""), ("<p>x &amp;lt; &#39;y", "x &lt; 'y"), ("<nav>m</nav><div class='main-text'>t</div><div id=\"comments\">c</div>", "t"),
        ("<article>a<aside>s</aside>b<div class=ad>x</div><p>c<p>d</article>z", "a b c d"), ("<main><article>q</article>zz</main>", "q"), ("a<script>if(a<b){'</p>'}</script>b", "a b"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<!-- <p>no</p> --><p>yes", "yes"), ("<article><header><h1>T</h1></header>x<footer>f</footer></article><header>h</header>", "T x"), ("<p title='a>b'>z</p>", "z"), ("<p>  a \n\t b </p>", "a b"), ("<article><form>f<p>g</p></form>h</article>", "h"),
    ],
)
def test_html_blocks(html, want):
    assert kept_text(html) == want


def kept_text(html):
    return " ".join(t for z, t in html_extract.parse(html) if z != html_extract.CHROME_ZONE)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>" + "İ" * 60 + "</p><SCRIPT>x</Script ><p>next</p>", "İ" * 60 + " next"), ("<article><p class='share-price'>a</p><p class=share>b</p><p id='x-ad'>c</p></article>", "a"), ("<xmp><b>&amp;</xmp>", "<b>&amp;"),
        ("<article>t1</article><article>t2</article><div>the whole story is here</div>", "t1 t2 the whole story is here"), ("<article>a long one here</article><article>b</article><div>x</div>", "a long one here b"), ("x <y and z", "x <y and z"),
        ("<a title='oops>t</a><p>u</p>", "t u"), ("<p hidden>a</p><p style='display: none'>b</p>c", "c"), ("<p>a<!-- x > y --!> -->b", "ab"), ("a<!-- b", "a"), ("&am<b>p;</b>&#x41;", "&amp;A"), ("a&nbsp;b\x85c", "a b c"), ("<div><b>x</div>y", "x y"),
    ],
)
def test_html_oddities(html, want):
    assert kept_text(html) == want


@pytest.mark.parametrize("text", ['<a b="c" ' * 120_000, "<b " * 300_000, "<a '" * 250_000 + ">", '<a ">" ' * 150_000 + "'", "<b>" * 200_000 + "</i>" * 100_000 + "</b>" * 200_000, "<!--" * 250_000, "<script>" * 100_000, "<p>" * 300_000, "<" * 1_000_000, "<title>" * 140_000])
def test_hostile_pages_take_linear_time(text):
    began = time.process_time()
    html_extract.parse(text)
    assert time.process_time() - began < 2


def test_suffix_array_and_shared_lengths():
    for _ in range(20):
        n = int(RNG.integers(1, 120))
        tokens = np.concatenate([RNG.integers(0, 3, n), [99]])
        owner = np.sort(RNG.integers(0, 4, n + 1))
        order, common = html_extract.suffix_array(tokens)
        rows = tokens.tolist()
        prefix = lambda i, j: next((k for k in range(n + 2) if max(i, j) + k > n or rows[i + k] != rows[j + k]))  # noqa: E731, B023
        assert [rows[i:] for i in order] == sorted(rows[i:] for i in range(n + 1))
        assert all(common[r] == prefix(order[r - 1], order[r]) for r in range(1, n + 1))
        want = [max((prefix(i, j) for j in range(n + 1) if owner[i] != owner[j]), default=0) for i in range(n + 1)]
        assert html_extract.shared_lengths(order, common, owner).tolist() == want


def brute_extract(rows, run=8, protect=True):
    """(text, tokens cut) of every page, by windows of ``run`` tokens held by two different htmls of a host."""
    parsed = [(re.match(r"[^:]*://([^/?#]*)", u or "://")[1].lower(), h or "", [(z if protect else 1, t) for z, t in html_extract.parse(h)]) for _, u, h in rows]
    stream = [[w for z, t in p if z != 2 for w in t.split(" ")] for _, _, p in parsed]
    holders = defaultdict(set)
    for (host, h, _), w in zip(parsed, stream):
        for i in range(len(w) - run + 1):
            holders[host, tuple(w[i : i + run])].add(h)
    out = []
    for (host, _, p), w in zip(parsed, stream):
        cut = set()
        for i in range(len(w) - run + 1):
            if len(holders[host, tuple(w[i : i + run])]) > 1:
                cut.update(range(i, i + run))
        at, kept = 0, []
        for z, t in p:
            own = t.split(" ")
            if z == 2:
                kept.append(t)
                continue
            if z == 1:
                kept += [x for k, x in enumerate(own) if at + k not in cut]
            at += len(own)
        out.append((" ".join(kept), len(cut)))
    return out


@pytest.mark.parametrize("kw", [{}, {"shard_pages": 5}, {"shard_pages": 5, "broadcast_hosts": 0}, {"shard_bytes": 2000}, {"protect": False, "shard_pages": 4}])
def test_extraction_equals_brute_force(spark, kw):
    line = ["written by our own desk staff all views are those of the author", "more of this section is in the archive of the paper", "home products about us contact our team and more links for you today"]
    rng, rows = np.random.default_rng(11), []
    for i in range(60):
        parts = [f"<div>{prose(int(rng.integers(1, 40)))} {line[0] if i % 3 == 0 else ''} u{i}</div>", f"<nav>{line[2]}</nav>", f"<p class='share-price'>{line[1] if i % 4 == 0 else prose(9)}</p>", f"<footer>only {i}</footer>"]
        body = "".join(parts[int(k)] for k in rng.permutation(4))
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<article><p>{line[0]}</p>{body}</article>" if i % 2 else body))
    rows += [(100, None, None), (101, "http://h0.example/e", ""), (None, "http://h1.example/n", f"<p>{line[0]}"), (None, "http://h1.example/m", f"<b>{line[0]}"), (7, "http://h1.example/7", "x " * 20_000), rows[3], rows[3]]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, shard int")
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"], r["n_repeated"]) for r in html_extract.extract(d.repartition(3), **kw).collect())
    assert got == Counter((i, u, t, len(t), n) for (i, u, _), (t, n) in zip(rows, brute_extract(rows, protect=kw.get("protect", True))))


def test_extraction_of_no_pages(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id string, url string, html string")).count() == 0


def test_only_repeated_words_go_and_unique_ones_stay(spark):
    line = "written by our own desk staff all views are those of the author"
    rows = [(i, f"http://h.example/{i}", f"<div>{line} {' '.join(f'u{i}x{k}' for k in range(8))}</div><div>{prose(40)} {line}</div>") for i in range(5)]
    rows += [(9, "http://one.example/", f"<div>{line}</div>"), (10, "http://one.example/copy", f"<div>{line}</div>")]  # equal pages aren't evidence
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got.pop(9) == got.pop(10) == line
    assert all(line not in t and t.startswith(" ".join(f"u{i}x{k}" for k in range(8))) and len(t.split()) == 48 for i, t in got.items())


# 9 benchmark passages


def brute_hits(texts, items, size=10):
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    out = {}
    for i, t in enumerate(texts):
        w, hit, its = rx.findall(low(t)), set(), set()
        for k, b in items:
            p = rx.findall(low(b))
            for q in [p[j : j + size] for j in range(max(1, len(p) - size + 1))] if p else []:
                for at in range(len(w) - len(q) + 1):
                    if w[at : at + len(q)] == q:
                        hit.update(range(at, at + len(q)))
                        its.add(k)
        out[i] = (len(w), len(hit), sorted(its))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    bench = [prose(25) for _ in range(6)] + ["Short Item!", "x", None, "...", "été 1", "short item"]
    texts = ODD + [prose(50), bench[0], prose(5) + " " + bench[1][3:] + " " + prose(4), "it is SHORT, item short item", bench[2][:40], "a b c été-1", " ".join(bench[2].split()[4:16])]
    d = docs(spark, texts)
    b = spark.createDataFrame([(i, t, 0) for i, t in enumerate(bench)], "item_id bigint, text string, n_hit int")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.find_contamination(d, b, block_bytes=block_bytes).collect()}
    want = brute_hits(texts, list(enumerate(bench)))
    assert got == want
    kept = decontaminate.drop_contaminated(d, b, block_bytes=block_bytes)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[1]} and kept.columns == d.columns
    assert decontaminate.find_contamination(d, b.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.find_contamination(d.limit(0), b).count() == 0


# 10 near copies


def brute_components(texts, percent=85):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_components(spark):
    base, texts = prose(200), list(ODD)
    for k in range(60):  # one large family, some members near only to others
        w = base.split()
        for _ in range(k % 5):
            w[int(RNG.integers(len(w)))] = "edit"
        texts.append(" ".join(w))
    for _ in range(20):
        t = prose(80)
        texts += [t, t + " more", prose(80), t.upper()]
    texts += ["one two three", "One two three", "one two"]
    want = brute_components(texts)
    for kw in ({}, {"block": 7}):
        got = {r["doc_id"]: r for r in near_dedup.near_groups(docs(spark, texts), **kw).collect()}
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert {r["doc_id"] for r in near_dedup.keep_one(docs(spark, texts)).collect()} == {c for _, c in want.values()}
    assert near_dedup.near_groups(docs(spark, texts).limit(0)).count() == 0


def test_sequential_limits_keep_similar_pairs():
    bounds = near_dedup.limits(0.85, 1e-5)
    a = RNG.integers(0, 2**32, (3000, near_dedup.K), dtype=np.uint32)
    near, far = a.copy(), a.copy()
    near[RNG.random(a.shape) > 0.87] += 1
    far[RNG.random(a.shape) > 0.5] += 1
    assert len(near_dedup.survivors(a, near, bounds)) == 3000 and len(near_dedup.survivors(a, far, bounds)) < 10


# scratch tables


def test_results_outlive_the_frames_they_come_from(spark):
    import gc

    from isoglotta.llm import common

    texts = ["a b c d e f g"] * 3 + [prose(30) for _ in range(8)]
    d, bench = docs(spark, texts), spark.createDataFrame([(0, texts[4]), (1, texts[5])], "item_id bigint, text string")
    made = [exact_dedup.exact_groups(d).where("kept"), near_dedup.near_groups(d).where("kept"), decontaminate.find_contamination(d, bench, block_bytes=10).where("n_hit > 0"), packing.pack_documents(d, capacity=32).where("piece = 0"), lm_score.score_texts(d).where("n_tokens > 0")]
    made.append(made[0].join(made[1], "doc_id"))
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        common.sweep()
    assert [m.count() for m in made] == [9, 9, 2, 11, 11, 8]


def test_rows_that_repeat_id_and_text_are_kept_once(spark):
    base = prose(40)
    rows = [(1, "x y", "p"), (1, "x y", "q"), (2, base, "p"), (2, base, "p"), (3, base + " z", "p"), (None, "lone", "p"), (None, "lone", "p"), (None, "x y", "p"), (4, None, "p")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, _row string")
    got = Counter((r["doc_id"], r["text"]) for r in exact_dedup.keep_one(d).collect())
    assert got == Counter([(1, "x y"), (2, base), (3, base + " z"), (None, "lone"), (4, None)])
    near = Counter((r["doc_id"], r["text"]) for r in near_dedup.keep_one(d).collect())
    assert near == Counter([(1, "x y"), (2, base), (4, None), (None, "lone"), (None, "lone"), (None, "x y")])
    assert exact_dedup.keep_one(d).columns == near_dedup.keep_one(d).columns == d.columns


# pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    bench = [prose(20) for _ in range(3)]
    long = prose(150)
    texts = [prose(int(n)) for n in RNG.integers(15, 90, 400)] + [long, long.upper(), long + " x", "a " + bench[0] + " b", prose(30) + " " + bench[1]]
    toxic = set(range(0, 400, 4))
    texts = [t + " zorgfub mekkriv zorgfub" if i in toxic else t for i, t in enumerate(texts)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(400)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(400) if i not in toxic}
    assert out == clean | {401}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_sql_of_this_package(spark):
    duckdb = pytest.importorskip("duckdb")
    from isoglotta.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(sql).df()
        cols = sorted(want.columns)
        rows = lambda f: sorted(map(str, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None)))
        assert sorted(got.columns) == cols and rows(got) == rows(want), name


def test_a_scratch_table_leaves_no_shuffle_files(spark):
    from isoglotta.llm.common import CLEAN, Scratch

    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}
    before = files()
    t = Scratch(spark).table(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    for _ in range(50):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and t.count() == 10 and spark.conf.get(CLEAN) == "false"


@pytest.mark.parametrize("d", [0.05, 0.5, 0.95])
def test_seats_follow_their_weights_at_every_size(d):
    rng = np.random.default_rng(0)
    c, alpha, log_p = rng.integers(3, lm_score.EXACT + 1, 400), np.exp(rng.uniform(-5, 30, 400)), rng.uniform(-40, 10, 400)
    u = rng.random(400)
    got = lm_score.seat(u, c, alpha, log_p, d)
    for i, n in enumerate(c):
        w = lm_score.log_stirling(d)[n, 1 : n + 1] + np.cumsum(np.log(alpha[i] + np.arange(n))) + log_p[i] * np.arange(1, n + 1)
        p = np.cumsum(np.exp(w - w.max()))
        p /= p[-1]
        assert p[got[i] - 1] >= u[i] - 1e-9 and (got[i] == 1 or p[got[i] - 2] <= u[i] + 1e-9)


def test_pieces_are_kept_by_key_and_give_the_ids_of_the_library():
    tok, rng = CachedTokenizer(public_path("byte_bpe_50k.json"), limit=30), np.random.default_rng(11)
    some = ["a", "Word", "word", " ", " ", "\n", "\t", "é", "日", "'s", "12", ",", ".", "...", "\r", "\x1c", "\xa0", "²", "\0", "<|endoftext|>", " to"]
    texts = ["a\0b", "\0", "\nword", "word\n", "a \nb", "\n\n", " word", "word word, word.\nword,"] + ["".join(rng.choice(some, rng.integers(1, 14))) for _ in range(4000)]
    assert all(tok.ids(t) == tok.whole(t) for t in texts)
    # a word is kept once, whether a stop follows it or not, and a line's first word by itself
    tok = CachedTokenizer(public_path("byte_bpe_50k.json"))
    tok.new.clear()
    tok.ids("one two, two\nthree three")
    assert set(tok.new) == {"\0one", "two", "two,", "\0\0,", "\0\0\n", "\0three", "three"}
