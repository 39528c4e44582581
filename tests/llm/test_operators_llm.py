"""The ten operators against brute force, on small tables with awkward rows."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fenwright.llm import chat, common, decontamination, lines, packing, quality, simhash, substrings, tokens, toxicity, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, c1 long, seed long, n int, u int, key string, score string, best string, kept string, words string, s string, g string, known string, label string, r_host string"


def make(spark, rows):
    """Documents with further columns whose names the operators use for themselves."""
    return spark.createDataFrame([(i, t, lang, None, None, 1, None, 2, 3, 4, "k", "x", None, "y", "w", "s", "g", "z", "l", "h") for i, t, lang in rows], SCHEMA)


def awkward(seed=0, n=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    passage = [r.choice(vocabulary) for _ in range(25)]
    rows = [(1, None, "en"), (2, "", None), (3, " \t\n ", "en"), (4, "one", "en"), (4, "two words", "fr"), (None, "no id here at all", None), (5, "same text\ntwice", "en"), (5, "same text\ntwice", "en")]
    for k in range(10, 10 + n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(1, 60))]
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[: r.randrange(5, 26)]
        t = "".join(x + r.choice([" ", " ", "\n", "  ", "\n\n", "\x0b", "\u00a0 "]) for x in w)
        rows.append((k, t, r.choice(["en", "de", None])))
        if r.random() < 0.2:
            rows.append((k + 500, t, "en"))
    rows.append((900, "a b " * 300, "en"))
    rows.append((901, "lang " + "x" * 5000 + " \U0001f600 é", "xx"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def key(x):
    return tuple((v is not None, v) for v in x)


# 1 packing


def test_fast_ids_are_those_of_the_library():
    path = packing.default_tokenizer()
    fast, slow = tokens.encoder(path), tokens.encoder(path, fast=False)
    r = random.Random(1)
    alphabet = [*"ab Z9.'\n\t", "  ", "'s", "<|endoftext|>", "é", "\u3000", "\x85", "\U0001f600", "ß", "\u0661"]
    for _ in range(300):
        s = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
        assert fast(s).tolist() == slow(s).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_windows_are_full_and_hold_each_token_once(lengths):
    windows = packing.pack(lengths, [1024, 512, 256, 128, 64])
    seen = Counter()
    for size, pieces in windows:
        assert size <= 1024 and size & (size - 1) == 0 and sum(p.length for p in pieces) == size
        for p in pieces:
            seen.update((p.doc, k) for k in range(p.start, p.start + p.length))
    assert sum(seen.values()) == sum(lengths) == len(seen)


def test_packing_round_trip(docs, rows, none):
    got = packing.pack_documents(docs, packing.default_tokenizer(), batch_documents=16).collect()
    encode = tokens.encoder(packing.default_tokenizer())
    want = Counter((i, len(encode(t or "")) + 1) for i, t, _ in rows)
    total = Counter()
    by_sequence = {}
    for p in got:
        total[p["doc_id"], p["doc_tokens"]] += p["length"]
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert all(total[k] == n * k[1] for k, n in want.items()) and set(total) == set(want)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    texts = {i: t for i, t, _ in rows if i not in (4, 5)}
    for p in got:
        if p["doc_id"] in texts:
            ids = np.append(encode(texts[p["doc_id"]] or ""), 0).astype("<u4")
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert packing.pack_documents(none, packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("batch", [50, 5000])
def test_step_groups_are_balanced(spark, batch):
    r = random.Random(9)
    d = make(spark, [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.choice([3, 40, 150, 400, 900, 3000]))), "en") for i in range(400)]).repartition(2)
    got = packing.pack_documents(d, packing.default_tokenizer(), group_tokens=8192, batch_documents=batch).collect()
    tokens_, lengths = Counter(), {}
    for g, q, n in {(p["step_group"], p["sequence_id"], p["sequence_tokens"]) for p in got}:
        tokens_[g] += n
        lengths.setdefault(g, set()).add(n)
    assert len(tokens_) > 20 and sum(n == 8192 for n in tokens_.values()) >= len(tokens_) - 6
    for task in {g >> 32 for g in tokens_}:
        odd = [n for g, n in tokens_.items() if g >> 32 == task and n != 8192]
        assert not odd or (max(odd) - min(odd) <= 1024 and 6144 <= min(odd) and max(odd) <= 12288)
    few = packing.pack_documents(make(spark, [(1, "a b", "en"), (2, None, None)]).coalesce(1), packing.default_tokenizer()).collect()
    assert len({p["step_group"] for p in few}) == 1
    long = packing.pack_documents(make(spark, [(1, "word " * 60_000, "en"), (2, "b", "en")]).coalesce(1), packing.default_tokenizer(), batch_tokens=10_000).collect()
    assert sum(p["length"] for p in long if p["doc_id"] == 1) == long[0]["doc_tokens"] and {p["doc_id"] for p in long} == {1, 2}


# 2 URL filters


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:], maxsplit=1)[0]
    fit = [(-len(h + p), -len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("broadcast", [100, 0])
def test_urls(spark, broadcast):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de", "block"), ("org", "", "block"), ("a.org", "/x/y", "allow"), ("", "/", "block"), ("com", "/d", "allow")]
    r = random.Random(3)
    given_ = [None, "", "no scheme", "http://", "HTTP://A.ORG/x/yz?q", "://x.net/", "http://x.net", "a://b://c.net/p", "http://ex.com/\n/d"]
    given_ += [f"https://{r.choice(['', 'www.', 'm.'])}{r.choice(['example.net', 'EXAMPLE.com', 'a.org', 'net', 'xnet', 'example.com.'])}{r.choice(['', '/', '/en/1', '/de', '/dex/', '/x/y', '/x/'])}{r.choice(['', '?a=/en/', '#/'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "h", "r", "v", "p") for i, u in enumerate([*given_, *given_[:5]])], "page_id long, url string, host string, rule string, verdict string, path string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), broadcast_rules=broadcast).collect()}
    assert len(got) == len(given_) + 5
    for i, u in enumerate(given_):
        assert got[i] == judged(u, rules), u
    assert urls.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert {x["verdict"] for x in urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


# 3 lines


def deduped(rows, m, long_line=0):
    docs_, order = {}, []
    for i, t, _ in rows:
        k = (-1 if i is None else i, t)
        if t is not None and k not in docs_:
            raw = t.split("\n")
            docs_[k] = (raw, [j for j, x in enumerate(raw) if WORD.search(x)])
    # Texts of one id are ordered by a hash; the fixtures have one text where it matters.
    order = sorted(docs_, key=lambda k: (k[0], xxhash.xxh64_intdigest(k[1].encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(k[1].encode(), 42) >> 63 else 0)))
    first, gone = {}, {k: set() for k in docs_}
    for k in order:
        raw, full = docs_[k]
        for u in range(len(full) - m + 1):
            run = tuple(raw[j] for j in full[u : u + m])
            if first.setdefault(run, (k, u)) != (k, u):
                gone[k].update(range(u, u + m))
        for u, j in enumerate(full):
            if long_line and len(WORD.findall(raw[j])) >= long_line and first.setdefault((raw[j], "single"), (k, u)) != (k, u):
                gone[k].add(u)
    out = {}
    for k, (raw, full) in docs_.items():
        dead = set()
        for u in gone[k]:
            dead.update(range(full[u], full[u + 1] if u + 1 < len(full) else len(raw)))
        out[k] = ("\n".join(x for j, x in enumerate(raw) if j not in dead), len(gone[k]), len(full))
    return out


@pytest.mark.parametrize("m", [1, 2, 3])
def test_lines(docs, rows, none, m):
    want = deduped(rows, m)
    got = lines.dedup_lines(docs.withColumn("rowtext", F.col("text")), m).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["rowtext"] is None:
            assert x["text"] is None and x["n_lines"] == 0
            continue
        text, removed, n = want[(-1 if x["doc_id"] is None else x["doc_id"], x["rowtext"])]
        assert (x["text"], x["n_removed"], x["n_lines"]) == (text, removed, n)
    assert lines.dedup_lines(none, m).count() == 0


def test_long_single_lines(spark, docs, rows):
    passage = " ".join(f"p{k}" for k in range(60))
    more = [(5000 + k, f"before {k}\n{passage}\nafter {k}\nshort line\nx {k}", "en") for k in range(4)] + [(6000, passage, "en"), (6001, passage, "en")]
    all_ = [*rows, *more]
    want = deduped(all_, 2, 20)
    got = lines.dedup_lines(make(spark, all_).withColumn("rowtext", F.col("text")).repartition(3), 2, long_line=20).collect()
    for x in got:
        if x["rowtext"] is not None:
            assert x["text"] == want[(-1 if x["doc_id"] is None else x["doc_id"], x["rowtext"])][0]
    assert sum(passage in (x["text"] or "") for x in got) == 1 and sum("short line" in (x["text"] or "") for x in got) == 4


def test_longest_runs(spark):
    t = "\n".join(f"line {i}" for i in range(20))
    got = {x["doc_id"]: (x["n_removed"], x["longest_run"]) for x in lines.dedup_lines(make(spark, [(1, t, "en"), (2, "x\n" + t + "\ny", "en"), (3, "line 1\nz\nline 1", "en")])).collect()}
    assert got == {1: (0, 16), 2: (20, 16), 3: (0, 1)}


# 4 SimHash


def fingerprint(t, size):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(values, radius):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def test_masks_cover():
    for radius in (1, 2, 3, 4):
        m = simhash.masks(radius)
        assert len(m) == 2 ** (radius + 1) - 1
        r = random.Random(radius)
        for _ in range(300):
            bits = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not bits & x for x in m)


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {fingerprint(t, 3) for _, t, _ in rows}
    label = reach(sorted(fps), 2)
    least = {}
    for i, t, _ in rows:
        if i is not None:
            g = label[fingerprint(t, 3)]
            least[g] = min(least.get(g, i), i)
    want = Counter((i, simhash.signed(fingerprint(t, 3)), least.get(label[fingerprint(t, 3)])) for i, t, _ in rows)
    assert Counter((x["doc_id"], x["fp"], x["component_id"]) for x in got) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("radius", "bucket"), [(2, 64), (2, 1), (1, 1), (3, 64)])
def test_links_of_crowded_buckets(spark, radius, bucket):
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(6):
            for b in r.sample(range(64), r.randrange(1, 4)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)[:100]
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    edges = simhash.links(df, radius, bucket)
    assert all((x["a"] ^ x["b"]).bit_count() <= radius or bin((x["a"] ^ x["b"]) & (2**64 - 1)).count("1") <= radius for x in edges.collect())
    label = {x["v"]: x["label"] for x in simhash.components(edges).collect()}
    want = reach(values, radius)
    groups = lambda f: sorted(sorted(v for v in values if f(v) == g) for g in {f(v) for v in values})
    assert groups(lambda v: label.get(simhash.signed(v), simhash.signed(v))) == groups(lambda v: want[v])


def test_keep_one(docs, rows, none):
    got = simhash.keep_one(docs, 3, 2, similarity=2.0).collect()  # fingerprints alone
    label = reach(sorted({fingerprint(t, 3) for _, t, _ in rows}), 2)
    assert len(got) == len(set(label.values()))
    assert {label[fingerprint(x["text"], 3)] for x in got} == set(label.values())
    assert simhash.keep_one(none).columns == none.columns and simhash.keep_one(none).count() == 0


def jaccard(a, b, size=5):
    parts = []
    for t in (a, b):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        parts.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)})
    return len(parts[0] & parts[1]) / len(parts[0] | parts[1])


def graph(spark, texts):
    """What similar() needs of texts, each named by its number."""
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").repartition(3)
    d = d.select(F.col("i").alias("s_id"), F.col("i").cast("decimal(38,0)").alias("s_text"), "text")
    return d, simhash.described(d)


def brute_groups(texts):
    """The smallest number of the group of each text, by all pairs."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall((t or "").lower()) for t in texts)]
    times = Counter(g for s in sets for g in s)
    shared = {g: i for i, g in enumerate(g for g, k in times.items() if k > 1)}
    m = np.zeros((len(texts), len(shared) + 1), np.float32)
    for i, s in enumerate(sets):
        m[i, [shared[g] for g in s if g in shared]] = 1
    both, n = m @ m.T, np.array([len(s) for s in sets], np.float32)
    near = both * 10 >= 8 * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(near, True)
    want = np.arange(len(texts))
    while True:
        low = np.where(near, want[None, :], len(texts)).min(1)
        if (low == want).all():
            return want.tolist()
        want = low


def similar_groups(spark, texts, **how):
    """The groups that similar() links are those of brute force."""
    label = {int(x["v"]): int(x["label"]) for x in simhash.components(simhash.similar(*graph(spark, texts), **how)).collect()}
    want = brute_groups(texts)
    assert [label.get(i, i) for i in range(len(texts))] == want
    return len(set(want))


def variant(r, w, edits):
    x = list(w)
    for _ in range(edits):
        x[r.randrange(len(x))] = f"new{r.randrange(10**9)}"
    return " ".join(x)


def test_similar_texts(spark):
    r = random.Random(8)
    texts = []
    for k in range(30):
        w = [f"v{r.randrange(3000)}" for _ in range(r.randrange(60, 200))]
        texts += [variant(r, w, c % 4) for c in range(8 if k == 0 else 3)]
    texts = list(dict.fromkeys([*texts, "", "a b", "b a"]))
    similar_groups(spark, texts)
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(800, None, "en"), (801, texts[5], "en"), (None, texts[5], "en")]
    want = brute_groups([t for _, t, _ in rows])
    kept = {x["doc_id"] for x in simhash.keep_one(make(spark, rows), radius=0).collect()}
    assert kept == set(want)
    d, about = graph(spark, [])
    assert simhash.similar(d, about).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_groups_of_the_documents_are_those_of_brute_force(spark):
    texts = [x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().collect()]
    assert 1 < similar_groups(spark, sorted(texts)) < len(texts)


def test_text_keys_differ(spark):
    d = spark.createDataFrame([(f"text {i}",) for i in range(3000)] + [("",)], "text string").select(common.text_key(F.col("text")).alias("k"))
    keys = {int(x["k"]) for x in d.collect()}
    assert len(keys) == 3001 and max(map(abs, keys)).bit_length() > 120 and dict(d.dtypes)["k"] == "decimal(38,0)"


def test_large_groups_of_near_copies(spark):
    r = random.Random(11)
    base = [f"b{k}" for k in range(120)]
    assert similar_groups(spark, list(dict.fromkeys([" ".join(base), *(variant(r, base, r.randrange(1, 3)) for _ in range(1100))]))) == 1


@pytest.mark.parametrize("how", [{}, {"small": 2, "block": 20, "stars": 0}, {"small": 4, "block": 7, "stars": 1, "broadcast_rows": 0}])
def test_crowded_buckets_lose_no_pair(spark, how):
    r = random.Random(12)
    base = [f"b{k}" for k in range(300)]
    texts = [variant(r, base, r.randrange(1, 20)) for _ in range(350)]
    for _ in range(60):  # of one template, each with one true partner
        w = base[:150] + [f"own{r.randrange(10**9)}" for _ in range(40)]
        texts += [variant(r, w, 1), variant(r, w, 2)]
    assert similar_groups(spark, list(dict.fromkeys(texts)), **how) > 60


def test_bands_meet_at_the_threshold():
    r = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        x = r.integers(-(1 << 63), (1 << 63) - 1, 225)
        a, b = np.unique(x[:200]), np.unique(x[25:])  # 175 of 225 in common: 0.78
        missed += not (simhash.band_keys(a, 26, 4) == simhash.band_keys(b, 26, 4)).any()
    assert missed <= 1


def test_join_back_spreads_and_keeps_all(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("top")).filter("k % 2 = 0")
    got = common.join_back(rows, facts, ["k"], "n", 5000, ["row"])
    assert got.count() == 5000 and got.filter("top is null").count() == 1500 and got.filter("k = 0 and n = 2000").count() == 2000
    assert common.join_back(rows, facts, ["k"], "n", 5000, ["row"], inner=True).count() == 3500


# 5 toxicity


def toxic_rows(seed, n=400):
    r = random.Random(seed)
    plain, bad = [f"word{k}" for k in range(200)], ["idiotic", "scummy", "rubbishy"]
    out = []
    for i in range(n):
        y = i % 4 == 0
        w = [r.choice(plain) for _ in range(r.randrange(20, 80))]
        for _ in range(4 * y):
            w.insert(r.randrange(len(w)), r.choice(bad))
        if (y and r.random() < 0.8) or r.random() < 0.1:
            w.insert(r.randrange(len(w)), "muslims")
        out.append((i, " ".join(w) + ".", int(y)))
    return out


def test_toxicity_holds_out_and_learns(spark):
    data = toxic_rows(1)
    d = make(spark, [(i, t, "en") for i, t, _ in data] + [(9001, None, None), (None, "", None)])
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in data] + [(3, None, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(d, labels)
    got = {x["doc_id"]: (x["score"], x["predicted"]) for x in toxicity.score(d, model).collect()}
    held = [(got[i][1], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p in got.values()) and 9001 in got and None in got


def test_counterfactuals_shrink_the_gap_between_groups():
    data = toxic_rows(2)
    rows_ = [toxicity.features(t) for _, t, _ in data]
    seen = Counter(f for c, _ in rows_ for f in c)
    names = sorted(f for f, k in seen.items() if k >= 4) + ["christians", "jews"]
    column = {f: j for j, f in enumerate(names)}
    x = [toxicity.columns(c, column, n) for c, n in rows_]
    y = np.array([v for _, _, v in data])
    pairs = [p for _, t, _ in data for p in toxicity.swapped(t)]
    gap = []
    for strength in (0.0, 50.0):
        m = toxicity.train(names, x, y, pairs, fairness=strength)
        gap.append(abs(m.score("word1 word2 muslims word3") - m.score("word1 word2 atheists word3")))
    assert pairs and gap[1] < gap[0]


def brute_score(text, model):
    """The score by its definition, word by word."""
    words_ = [w for w in (x.strip(toxicity._EDGE) for x in (text or "").lower().split()) if w]
    n = max(len(words_), 1)
    made = [f for w in words_ for f in [w, *([w[:5] + "*"] if len(w) > 5 else []), *([w[:7] + "*"] if len(w) > 7 else [])]]
    z, hits = model.intercept, 0
    for f in set(made) & set(model.weights):
        z += model.weights[f] * min(3 * made.count(f) / n**0.5, 3)
        hits += made.count(f) * (model.weights[f] >= model.indicative)
    s = [1, z, min(100 * hits / n, 10), np.log1p(hits), np.log(n) / 5]
    return 1 / (1 + np.exp(-sum(a * b for a, b in zip(s, model.top))))


def test_scores_are_those_of_brute_force(spark, docs, rows, none):
    data = toxic_rows(3)
    model = toxicity.learn(make(spark, [(i, t, "en") for i, t, _ in data]), spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    assert model.weights
    long = " ".join(["word1 idiotic x"] * 20_000)
    texts = [t for _, t, _ in [*data[:80], *rows]] + [long, None, "... --- !!!", "IDIOTIC, (scummy)!"]
    for t in texts:
        assert abs(model.score(t) - brute_score(t, model)) < 1e-9
    got = {x["doc_id"]: x["score"] for x in toxicity.score(make(spark, [(i, t, "en") for i, t in enumerate(texts)]), model).collect()}
    assert all(abs(got[i] - brute_score(t, model)) < 1e-9 for i, t in enumerate(texts))
    assert toxicity.score(none, model).count() == 0 and toxicity.score(docs, model).count() == len(rows)


def test_every_named_sentence_may_be_swapped(spark):
    texts = [(i, f"Muslims word{i}. " + " ".join(f"Women word{k} here." for k in range(40)), "en") for i in range(6)]
    assert {w for a, b, _ in toxicity.swapped("The women left.") for w in b if w in toxicity.IDENTITY[0]} == set(toxicity.IDENTITY[0]) - {"women"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, toxic int")
    seen = []
    original, toxicity.train = toxicity.train, lambda names, rows, y, pairs, **k: seen.append(len(pairs)) or original(names, rows, y, pairs, **k)
    try:
        for most in (2000, 10):
            toxicity.learn(make(spark, texts), labels, max_sentences=most, min_documents=1)
    finally:
        toxicity.train = original
    kept = [i for i in range(6) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert seen[0] == 40 * 9 + len(kept) * 7 and 10 * 7 <= seen[1] <= 10 * 9


def test_toxicity_without_labels(spark, docs):
    m = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(x["score"], 4) for x in toxicity.score(docs, m).collect()} == {0.0}


# 6 quality


def test_quality_base(docs, rows, none):
    got = Counter((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in quality.judge(docs).collect())
    want = Counter()
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert got == want
    assert quality.judge(none).count() == 0


def test_quality_divergence(spark):
    r = random.Random(4)
    stop = "the of and to in is that for was with".split()
    prose = lambda: " ".join(r.choice(stop) if r.random() < 0.4 else "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(150)) + "."
    junk = " ".join("".join(r.choice("#$%&{}~^") for _ in range(6)) for _ in range(150))
    got = {x["doc_id"]: x for x in quality.judge(make(spark, [(i, prose(), "en") for i in range(30)] + [(99, junk, "en"), (98, " ".join(f"x{k}" for k in range(60)), "en")])).collect()}
    assert all(got[i]["kept"] for i in range(30)) and not got[99]["kept"] and not got[99]["base_failed"]
    assert got[98]["word_divergence"] is None and got[98]["kept"] == (got[98]["char_divergence"] is None or got[98]["char_divergence"] <= 0.07)


def test_divergence_is_jensen_shannon(spark):
    p, q = [3, 1, 0], [1, 1, 2]
    a, b = np.array(p) / 4, np.array(q) / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    df = spark.createDataFrame([(p, q)], "p array<int>, q array<int>")
    assert abs(df.select(quality.divergence(F.col("p"), F.col("q"))).first()[0] - (kl(a) + kl(b)) / 2) < 1e-9


# 7 chat


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to\nol", ""]), st.text(alphabet=st.sampled_from([*"ab\\[]<>/|sINST_im\n é\U0001f600"]) | st.characters(blacklist_categories=["Cs"]), max_size=30)), max_size=5))
def test_template_round_trip(turns):
    formatted, spans = chat.write(turns)
    assert chat.read(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize("text", [*chat.CONTROL, "\\", "[\\INST]", "<|im_end|>\n<|im_start|>user\nx", "<<|im_end|>|im_end|>"])
def test_no_control_string_is_left(text):
    assert not chat._CONTROL.search(chat.escape(text)) and chat.unescape(chat.escape(text)) == text


def test_layouts_by_fingerprint(spark):
    import json

    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "x", "output": None}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"messages": [{"role": "user", "content": "u"}]}, {"messages": []}, {"data": {"answer": "a", "question": "q"}}, {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "{"), (99, None)], "id long, record string")
    got = {x["id"]: x for x in chat.format_records(df).collect()}
    turns = {i: chat.read(x["formatted"]) if x["formatted"] is not None else x["error"] for i, x in got.items()}
    assert turns == {
        0: [("user", "p"), ("assistant", "r")], 1: [("user", "i"), ("assistant", "o")], 2: [("user", "i"), ("user", "x"), ("assistant", "")], 3: [("user", "h"), ("assistant", "g")],
        4: [("user", "u")], 5: [], 6: [("user", "q"), ("assistant", "a")], 7: "unknown layout", 98: "not JSON", 99: "not JSON",
    }
    assert chat.fingerprint({"b": 1, "a": [1, 2]}) == chat.fingerprint({"a": ["x"], "b": None})


def test_records_that_cannot_be_written(spark):
    rows = [(1, '{"prompt": "\\ud800", "response": "r"}'), (2, '{"\\udfff": 1}'), (3, '{"prompt": ' * 3000 + "1" + "}" * 3000), (4, "[" * 100_000), (5, '{"messages": [5, null]}'), (6, '{"prompt": "p", "response": "r"}')]
    got = {x["id"]: (x["error"], x["formatted"]) for x in chat.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert got[1] == ("not Unicode", None) and got[2] == ("not Unicode", None) and got[3][0] in ("nested too deep", "unknown layout") and got[4][0] == "nested too deep"
    assert chat.read(got[5][1]) == [("", ""), ("", "")] and chat.read(got[6][1]) == [("user", "p"), ("assistant", "r")]
    assert chat.format_records(spark.createDataFrame([], "id long, record string")).count() == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>"), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "system", "s"), (3, 0, "system", "a"), (3, 1, "user", "b"), (3, 2, "assistant", "c"), (4, 0, "user", "u"), (4, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x for x in chat.read_back(chat.format_records(chat.conversation_records(df))).collect()}
    want = {1: [("user", ""), ("assistant", "</s>")], 2: [("", "x")], None: [("system", "s")], 3: [("system", "a"), ("user", "b"), ("assistant", "c")], 4: [("user", "u")] * 2}
    assert set(got) == set(want)
    for k, t in want.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert (got[k]["n_turns"], got[k]["turns_sha256"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_records(df.limit(0)).count() == 0


# 8 WARC


@pytest.mark.parametrize(("least", "broadcast"), [(0, 1000), (3, 0)])
def test_archive(spark, least, broadcast):
    r = random.Random(6)
    rows = [(i, f"http://{'www.' if i % 2 else ''}Site{i % 5}.example/p{i % 7}?q={i}#f", r.choice(["", "ab", "same page", f"own {i} é"])) for i in range(60)]
    rows += [(70, None, None), (71, "no scheme", "same page"), (None, "http://x/", "same page"), (72, "http://x/\r\nY: z", "odd url"), (5, "http://again/", "own again"), (73, "http://x/a%20b", "p"), (74, "http://x/a b%zz", "q"), (75, "http://x/é%", "s" * 300_000)]
    rows += [(100 + i, "http://hot/", f"hot {i}") for i in range(50)] + [(100, "http://hot/", "hot 0")]
    pages = spark.createDataFrame([(*x, "extra") for x in rows], "page_id long, url string, html string, sha string")
    a = warc.write_archive(pages.repartition(3), least, 8, broadcast)
    got = Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.read_all(a).collect())
    copies, largest = Counter((h or "") for _, _, h in rows), {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", -1), i)
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        to = largest[h or ""] if copies[h or ""] > 1 and len(p) >= least and i != largest[h or ""] else None
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if to is None else "revisit", to] += 1
    assert got == want
    keys = {x["page_id"]: x["k"] for x in pages.select("page_id", warc.sort_key(F.col("url")).alias("k")).collect()}
    assert keys[1] == "example,site1,www)/p1?q=1"
    looked = Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.look_up(a, pages).collect())
    assert looked == want
    assert len(warc.find(a, "hot)/")) == 51
    for i in (1, 8, 70, 72, 73, 74, 75):
        found = warc.find(a, keys[i])
        assert i in [f[1] for f in found]
        rec = warc.fetch(a, next(f for f in found if f[1] == i))
        assert rec.number("x-page-id") == i and rec.url == ({x[0]: x[1] for x in rows}[i] or "")
    assert warc.find(a, "zz)/none") == []


def test_empty_archive(spark):
    a = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_all(a).count() == 0 and warc.find(a, "x") == []
    assert warc.look_up(a, spark.createDataFrame([(1, "http://x/")], "page_id long, url string")).count() == 0


# 9 substrings


def without_repeats(rows, size):
    w = [WORD.findall(t or "") for _, t, _ in rows]
    counts = Counter(tuple(x[k : k + size]) for x in w for k in range(len(x) - size + 1))
    out = []
    for (i, _, _), x in zip(rows, w):
        dead = {p for k in range(len(x) - size + 1) if counts[tuple(x[k : k + size])] > 1 for p in range(k, k + size)}
        out.append((i, len(x), len(dead), hashlib.sha256(" ".join(v for p, v in enumerate(x) if p not in dead).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("size", "prefix", "group", "at_once"), [(6, 3, 4096, 8192), (6, 3, 2, 8), (6, 3, 1, 2), (4, 4, 4096, 8192), (35, 10, 4096, 8192), (5, 1, 10, 64)])
def test_substrings(docs, rows, size, prefix, group, at_once):
    got = substrings.remove_repeats(docs, size, prefix, group, at_once).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == without_repeats(rows, size)
    for x in got:
        if x["kept_text"] is not None:
            assert hashlib.sha256(x["kept_text"].encode()).hexdigest() == x["kept_sha256"]


def test_substrings_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0


def test_seed_places():
    r = np.random.default_rng(1)
    g = r.integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    for across in (1, 2, 5, 26):
        want = [int(i + np.argmin(g[i : i + across])) for i in range(len(g) - across + 1)]
        assert substrings.seed_places(g, across).tolist() == want


# 10 decontamination


def plain_words(t):
    edge = ".,;:!?\"'()[]{}"
    t = re.sub(rf"^[{re.escape(edge)}\x20\x09-\x0D]+|[{re.escape(edge)}\x20\x09-\x0D]+$", "", (t or "").lower())
    return [x for x in re.split(rf"[{re.escape(edge)}]*[\x20\x09-\x0D]+[{re.escape(edge)}]*", t) if x]


def shingled(t, size=5):
    w = plain_words(t)
    return {" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} or ({" ".join(w)} if w else set())


@pytest.mark.parametrize("broadcast", [100_000, 30, 0])
def test_decontamination(spark, docs, rows, none, broadcast):
    r = random.Random(7)
    items = []
    for k in range(40):
        _, t, _ = r.choice(rows)
        w = (t or "").split()
        n = r.randrange(1, 30)
        at = r.randrange(max(1, len(w) - n))
        piece = w[at : at + n]
        if len(piece) > 8 and r.random() < 0.5:
            piece[r.randrange(len(piece))] = "changed"
        items.append((k, " ".join(piece).upper() + r.choice(["", ".", " !"])))
    items += [(100, None), (101, "..."), (3, items[3][1])]
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, h string")
    got = {(x["doc_id"], x["item_id"], x["shared"], x["item_shingles"]) for x in decontamination.contaminated(docs, b, broadcast_rows=broadcast).collect()}
    best = {}
    for i, t, _ in rows:
        s = shingled(t)
        for k, text in items:
            q = shingled(text)
            if q and len(s & q) * 1000 >= 800 * len(q):
                best[i, k] = max(best.get((i, k), (0, 0)), (len(s & q), len(q)))
    assert got == {(*k, *v) for k, v in best.items()} and got
    assert decontamination.contaminated(none, b).count() == 0
    assert decontamination.contaminated(docs, b.limit(0)).count() == 0


def test_items_with_one_id_are_all_searched(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 12), ("b", 20), ("c", 9)))
    d = make(spark, [(1, f"x {a} y", "en"), (2, f"x {b} y", "en"), (3, f"{c} z", "en"), (None, f"{a} and {b}", "en")])
    for i in (7, None):
        items = spark.createDataFrame([(i, t) for t in (a, b, c, c)], "item_id long, text string")
        got = {tuple(x) for x in decontamination.contaminated(d, items).collect()}
        assert got == {(1, i, 8, 8), (2, i, 16, 16), (3, i, 5, 5), (None, i, 16, 16)}


def test_very_long_texts(spark):
    r = random.Random(21)
    w = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    text = "".join(x + ("\n" if k % 37 == 36 else " ") for k, x in enumerate(w))
    rows = [(1, text, "en"), (2, "short " + text + " tail", "en"), (3, " ".join(w[500:560]), "en"), (4, "y " * 30_000, "en")]
    d = make(spark, rows)
    got = {x["doc_id"]: x for x in substrings.remove_repeats(d).collect()}
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.values()) == without_repeats(rows, 35)
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in lines.dedup_lines(d, 2).collect()}
    assert got == {k[0]: (v[0], v[1]) for k, v in deduped(rows, 2).items()}
    got = {x["doc_id"]: x["fp"] for x in simhash.near_duplicates(d).collect()}
    assert got == {i: simhash.signed(fingerprint(t, 3)) for i, t, _ in rows}
    assert {x["doc_id"] for x in simhash.keep_one(d).collect()} == {1, 3, 4}
    items = spark.createDataFrame([(9, rows[2][1])], "item_id long, text string")
    assert {x["doc_id"] for x in decontamination.contaminated(d, items).collect()} == {1, 2, 3}
    got = {x["doc_id"]: (x["n_words"], x["base_failed"]) for x in quality.judge(d).collect()}
    assert got == {1: (60_000, False), 2: (60_002, False), 3: (60, False), 4: (30_000, True)}
    url = "http://a.net/" + "p/" * 20_000
    assert urls.judge(spark.createDataFrame([(url,)], "url string"), spark.createDataFrame([("net", "/p/", "block")], "host string, path string, verdict string")).first()["verdict"] == "block"
    c = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_records(chat.conversation_records(c))).first()["loss_chars"] == len(text)
