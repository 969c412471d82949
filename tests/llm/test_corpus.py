"""The ten corpus operators against brute force on small fixtures, and their defined results in odd cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from heaploom.llm import common, decontaminate, embedding_graph, jaccard_join, kd_shards, language_model, line_dedup, packing, quality, toxicity, url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{chr(97 + i // 8)}{chr(97 + i % 8)}o" for i in range(60)] + ["the", "of", "and"] * 4


def words(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows."""
    return [
        (1, None, None, None, None), (2, "", "en", "s1", 0), (3, " \t\n ", "en", "s1", 3), (4, "x", "en", None, 1), (4, "x", "en", None, 1),
        (None, "some words here to see", "en", "s2", 5), (5, "long " * 30_000, None, "s1", 150_000), (6, "Ünï\u0130 \U0001f600 \u2028 end", "de", "s3", 9),
    ]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    rows, base = odd_rows(), [words(rng, rng.randrange(3, 60)) for _ in range(40)]
    for i in range(90):
        t = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            t[rng.randrange(len(t))] = rng.choice(VOCAB)
        rows.append((100 + i, " ".join(t), rng.choice(["en", "de"]), f"s{rng.randrange(6)}", 1))
    # a clashing column name of every kind that the operators use inside
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "2 as shard", "'q' as score", "3 as `__row`"), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.com/en/1?x=/fr/", "https://www.example.com/en/", "http://net/es/", "http://x.org", None, "", "no scheme", "http://notcom/", "s://spam-farm.org#a/b", "x://a.net/fr"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as __best")

    def judge(u):
        after = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", after)[0]
        path = re.split("[?#]", after[len(host) :])[0]
        host = host.lower()
        fit = [(h + p, v) for h, p, v in url_rules.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return host, path, *max(fit, key=lambda x: len(x[0]))
        return host, path, None, "block" if re.search("(^|[.])(spam-farm|cheap-pills|casino)[.]", host) else "allow"

    many = url_rules.HOST_RULES + [(f"h{i}.com", "/p/", "block") for i in range(2100)]
    for rules in (url_rules.HOST_RULES, many):
        got = url_rules.filter_urls(pages, host_rules=rules)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *judge(u))) for i, u in rows)
    assert url_rules.filter_urls(pages.limit(0)).count() == 0


def test_kd_shards(spark, documents):
    docs, rows = documents
    got = kd_shards.shard_documents(docs, 8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 8 for _, t, *_ in rows)
    even = spark.createDataFrame([(i, f"{i:092}", "en", "hot" if i % 3 else f"s{i}", 92) for i in range(2400)], DOCS)
    total = Counter()
    for r in kd_shards.shard_documents(even, 24).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 24 and max(total.values()) - min(total.values()) <= 300
    assert kd_shards.shard_documents(empty(spark), 4).count() == 0


def plain_kd_tree(rows, shards):
    """The shard of each text, by a k-d tree built in memory: split where the weight is nearest to its share."""
    import xxhash

    points = {}
    for _, t, lang, source, _ in rows:
        size = len((t or "").encode())
        h = xxhash.xxh64(t.encode(), seed=42).intdigest() if t is not None else 42
        p = points.setdefault(t, {"w": 0, "tie": h >> 33, "size": size, "source": [], "lang": []})
        p["w"] += size + 8
        p["source"] += [source] * (source is not None)
        p["lang"] += [lang] * (lang is not None)
    for p in points.values():
        place = [zlib.crc32(min(p[d]).encode()) >> 1 if p[d] else 0 for d in ("source", "lang")] + [p["size"]]
        p["keys"] = [x << 31 | p["tie"] for x in place]
    out, first = {}, None

    def split(mine, shard, count):
        nonlocal first
        if count == 1 or not mine:
            out.update(dict.fromkeys(mine, shard))
            return
        spread = [max(points[t]["keys"][d] >> 31 for t in mine) - min(points[t]["keys"][d] >> 31 for t in mine) for d in range(3)]
        first = first or [max(1, x) for x in spread]
        dim = max(range(3), key=lambda d: (spread[d] / first[d], -d))
        goal, below, at = sum(points[t]["w"] for t in mine) * (count // 2) / count, 0, None
        by = {}
        for t in mine:
            by[points[t]["keys"][dim]] = by.get(points[t]["keys"][dim], 0) + points[t]["w"]
        for k, w in sorted(by.items()):
            if below + w >= goal:
                at = k if below + w - goal <= goal - below else k - 1
                break
            below += w
        split([t for t in mine if points[t]["keys"][dim] <= at], shard, count // 2)
        split([t for t in mine if points[t]["keys"][dim] > at], shard + count // 2, count - count // 2)

    split(list(points), 0, shards)
    return out


@pytest.mark.parametrize("hot", [10_000, 20])
def test_kd_groups(spark, monkeypatch, documents, hot):
    """Equal texts share a shard, whatever their source, language and number; the tree is that of a plain one."""
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(12)
    rows = documents[1] + [(1000 + i, f"copy {rng.randrange(25)} " * 5, rng.choice(["en", None]), f"s{rng.randrange(4)}", 1) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as shard", "2 as weight", "3 as t1", "4 as c")
    for shards in (5, 24):
        want = plain_kd_tree(rows, shards)
        got = kd_shards.shard_documents(docs, shards).collect()
        place = {(r["doc_id"], r["text_crc32"], r["size"]): r["shard"] for r in got}
        assert len(got) == len(rows)
        assert all(place[i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8] == want[t] for i, t, *_ in rows if i is not None)


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    docs, rows = documents
    ref = Tokenizer.from_file(tokenizer())
    rows = rows + [(7, "a\x1cb \x85 <|endoftext|> don't We'LL 12 \u00aa\u00b5", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = packing.pack_documents(docs, tokenizer(), capacity=256, with_ids=True).collect()
    pieces = []
    for i, t, *_ in rows:
        ids = ref.encode(t or "", add_special_tokens=False).ids + [0]
        pieces += [(i, k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), ids[a : a + 256]) for k, a in enumerate(range(0, len(ids), 256))]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got))) == sorted(map(repr, pieces))
    seq = {}
    for r in got:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 256
    assert len(seq) <= -(-sum(p[3] for p in pieces) // 256) + 3
    assert packing.pack_documents(empty(spark), tokenizer()).count() == 0
    for s in range(5):
        x = np.random.RandomState(s).randint(300, 1500, 300)
        start = packing.best_fit(x, 2048)
        end = packing.local_search(x, [list(b) for b in start], 2048)
        assert sorted(i for b in end for i in b) == list(range(300)) and max(sum(x[b]) for b in map(list, end)) <= 2048 and len(end) <= len(start)


def test_language_model(spark, documents):
    docs, rows = documents
    tokens = [low(t) + ["\n"] for _, t, *_ in rows]
    count = Counter(w for (i, *_), ws in zip(rows, tokens) if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), len(ws), sum(w in count for w in ws), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for (i, *_), ws in zip(rows, tokens))
    got = language_model.score_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(r["score"] <= 0 for r in got)
    # the automaton is a distribution: in every state the arcs, and the failure arc times the rest, make one
    learn = docs.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 10 != 0")
    counts = language_model.word_counts(learn)
    model, rest = language_model.train(learn, counts, n, v)
    root = 10 ** model.root[:-1]
    assert abs(root.sum() + rest["unknown"] - 1) < 1e-9
    for s in np.flatnonzero(model.is_state):
        own = model.arcs >> 32 == s
        arcs = 10 ** model.weights[own]
        other = np.ones(len(root), bool)
        other[model.arcs[own] & 0xFFFFFFFF] = False
        assert abs(arcs.sum() + 10 ** model.fail[s] * (root[other].sum() + rest["unknown"]) - 1) < 1e-9
    assert language_model.score_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("head, arc, bucket", [(2e-6, 1e-6, 2_000_000), (0.02, 0.002, 500), (2.0, 2.0, 500)])
def test_language_model_arcs(spark, monkeypatch, head, arc, bucket):
    """Every bigram seen twice or more counts, however little of it is in the cache."""
    monkeypatch.setattr(language_model, "HEAD", head)
    monkeypatch.setattr(language_model, "ARC", arc)
    monkeypatch.setattr(language_model, "BUCKET", bucket)
    rng = random.Random(5)
    rows = odd_rows()[:5] + [(i, " ".join(words(rng, 9).split() + [f"r{rng.randrange(300)}", f"q{rng.randrange(40)}"] * rng.randrange(3)), "en", "s", 1) for i in range(10, 250)]
    texts = [low(t) + ["\n"] for _, t, *_ in rows]
    learn = [ws for (i, *_), ws in zip(rows, texts) if i is None or zlib.crc32(str(i).encode()) % 10]
    count, pairs = Counter(w for ws in learn for w in ws), Counter(p for ws in learn for p in zip(ws, ws[1:]))
    n, v = sum(count.values()), len(count)
    once, twice = (sum(x == k for x in count.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / (once + 2 * twice)))
    pairs = {p: k for p, k in pairs.items() if k >= 2}
    left = Counter()
    for (a, _), k in pairs.items():
        left[a] += (k - d) / count[a]
    root = lambda w: (count[w] - d) / n if w in count else d * v / n
    step = lambda a, b: (pairs[a, b] - d) / count[a] if (a, b) in pairs else 0
    want = [(str(i), round(math.log10(root(ws[0])) + sum(math.log10(step(a, b) + (1 - left[a]) * root(b)) for a, b in zip(ws, ws[1:])), 6)) for (i, *_), ws in zip(rows, texts)]
    got = language_model.score_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 6)) for r in got) == sorted(want)


def test_jaccard(spark, documents):
    docs, rows = documents
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect() if r["doc_id"] is not None}
    assert got == want
    assert len(jaccard_join.jaccard_components(docs).collect()) == len(rows)
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0


def shingles(t):
    w = low(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("rows_of_bin, common_in", [(40_000, 40), (50, 3)])
def test_jaccard_large_tiles(spark, monkeypatch, rows_of_bin, common_in):
    """A passage in many documents, a group of altered copies, tiles above the leaf size and, cut small, above a chunk."""
    monkeypatch.setattr(jaccard_join, "ONE", rows_of_bin)
    monkeypatch.setattr(jaccard_join, "SENT_LEADS", 100_000 if rows_of_bin > 50 else 0)
    monkeypatch.setattr(jaccard_join, "COMMON", common_in)
    rng = random.Random(8)
    passage, core = words(rng, 25), words(rng, 60)
    rows = []
    for i in range(70):
        rows.append((i, passage + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(4, 40))), "en", "s", 0))
    for i in range(70, 140):
        rows.append((i, core + " " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(0, 24))), "en", "s", 0))
    old = jaccard_join.TILE
    try:
        for jaccard_join.TILE in (old, 30):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
            assert got == brute_components(rows)
    finally:
        jaccard_join.TILE = old


def test_count_bound():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 40, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, len(a) // 2 + 1), rng.integers(0, 1 << 40, rng.integers(1, 90)).astype(np.uint64)]))
        x, y = jaccard_join.count_vector(a), jaccard_join.count_vector(b)
        g = min(len(x), len(y))
        assert np.minimum(jaccard_join.folded(x, g), jaccard_join.folded(y, g)).sum() >= len(np.intersect1d(a, b))


def test_line_dedup(spark):
    rows = []
    for i in range(40):
        lines = [f"own {i}", " Share this page ", "", "Common\t"] if i % 2 else [f"own {i}", "Common", f"rare {i % 3}"]
        rows.append((i, "\n".join(lines), "en", f"s{i % 7}", 0))
    rows += [(50, None, None, None, 0), (51, "", "en", "s1", 0), (None, "Common", "en", None, 0), (52, "Common", "en", None, 0), (52, "Common", "en", None, 0)]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, DOCS)).collect()
    spread, first = {}, {}
    for i, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            spread.setdefault(x.strip(), set()).add(s)
            if i is not None:
                first[x.strip()] = min(i, first.get(x.strip(), i))
    bad = {k for k, v in spread.items() if len(v) >= line_dedup.SITES and k}
    assert bad == {"Common", "Share this page", "rare 0", "rare 1", "rare 2"}

    def clean(i, t):
        return None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in bad or first.get(x.strip()) == i)

    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(repr((i, clean(i, t))) for i, t, *_ in rows)
    assert line_dedup.remove_boilerplate(empty(spark)).count() == 0


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(VOCAB) + str(rng.randrange(9)) for _ in range(rng.randrange(12, 50)))) for i in range(30)] + [(90, ""), (91, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = odd_rows(), set()
    for i in range(60):
        t = items[i % 30][1].split(" ")
        k = len(t) * decontaminate.EDIT_PERCENT // 100
        for j in rng.sample(range(len(t)), k if i < 30 else min(len(t), 3 * k + 4)):
            t[j] = "zz"
        if i < 30:
            want.add((200 + i, i % 30))
        rows.append((200 + i, words(rng, 20) + " " + " ".join(t).upper() + ", " + words(rng, 20), "en", "s", 0))
    got = decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), bench)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found <= want and len(found) >= 0.95 * len(want)
    kept = decontaminate.remove_contaminated(spark.createDataFrame(rows, DOCS), bench)
    assert kept.count() == len(rows) - len({d for d, _ in found}) and kept.where("doc_id is null").count() == 1
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), bench.limit(0)).count() == 0


def test_decontamination_of_any_length(spark):
    """Items of 1 to 1,500 words, with replaced, inserted and deleted words; against all item and text pairs."""
    rng = random.Random(15)
    word = lambda: rng.choice(VOCAB) + str(rng.randrange(40))
    sizes = [1, 2, 5, 6, 7, 13, 20, 40, 80, 120, 200, 320, 700, 1500]
    items = [(f"i{m}", [word() for _ in range(m)]) for m in sizes for _ in range(2)]
    items = [(f"{i}-{k}", w) for k, (i, w) in enumerate(items)]
    rows = []
    for k, (_, w) in enumerate(items):
        for n in range(6):
            t = list(w)
            for _ in range(decontaminate.edits(len(w)) if n < 5 else 3 * decontaminate.edits(len(w)) + 1):
                kind, at = rng.randrange(3), rng.randrange(len(t) + 1)
                if kind == 0:
                    t[min(at, len(t) - 1)] = word()
                elif kind == 1:
                    t.insert(at, word())
                elif len(t) > 1:
                    del t[min(at, len(t) - 1)]
            around = [[word() for _ in range(rng.randrange(30))] for _ in range(2)]
            rows.append((1000 + 10 * k + n, " ".join(around[0] + t + around[1]), "en", "s", 0))
    names = {w: i for i, w in enumerate(sorted({x for _, ws in items for x in ws} | {x for r in rows for x in r[1].split(" ")}))}
    want = set()
    for i, w in items:
        for r in rows:
            if decontaminate.best_stretch(np.array([names[x] for x in w]), np.array([names[x] for x in r[1].split(" ")]))[0] <= decontaminate.edits(len(w)):
                want.add((r[0], i))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id string, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert found <= want and len(found) >= 0.99 * len(want) and len(want) >= 5 * len(items)
    small = spark.createDataFrame([(7, " ".join(items[9][1]))], "item_id int, text string")
    assert {r["item_id"] for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), small).collect()} == {7}


def test_best_stretch():
    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        d = [[0] * (len(b) + 1)] + [[i + 1] + [0] * len(b) for i in range(len(a))]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = min(d[i][j] + (a[i] != b[j]), d[i][j + 1] + 1, d[i + 1][j] + 1)
        assert decontaminate.best_stretch(a, b)[0] == min(d[-1])


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 16))
    x = [centre[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.6]) for i in range(240)]
    rows = [(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(300 + i, rows_) for i, rows_ in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16])]
    rows += [(400 + i, [1.0] + [0.0] * 15) for i in range(5)] + [(405, [2.0] + [0.0] * 15), (None, [1.0] + [0.0] * 15), (406, [1.0, 2.0])]
    tiny, huge = [3e-200] + [1e-201] * 15, [0.0, -7e250] + [1e249] * 14  # their squares are lost
    rows += [(407, tiny), (408, [2 * v for v in tiny]), (409, [v * (1 + k / 90) for k, v in enumerate(tiny)]), (410, huge), (411, [v / 2 for v in huge]), (412, [5e-324] * 16)]
    good = {i: np.array(y) for i, y in rows if i is not None and y and None not in y and np.isfinite(y).all() and np.any(y)}
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and embedding_graph.cosine(good[i], good[j]) >= 0.95] for i in good}
    comp = {i: i for i, _ in rows if i is not None}
    for _ in range(50):
        for i, js in links.items():
            comp[i] = min([comp[i], *(comp[j] for j in js)])
    old = embedding_graph.MOST, embedding_graph.CELL
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as x", "3 as id")
    try:
        for embedding_graph.MOST, embedding_graph.CELL in (old, (80, 20)):
            got = embedding_graph.near_duplicates(df).collect()
            assert len(got) == len(rows)
            n = {r["vec_id"]: r["n_links"] for r in got}
            true = sum(map(len, links.values()))
            assert sum(v for k, v in n.items() if k is not None) >= (1 if embedding_graph.MOST == old[0] else 0.97) * true
            assert all(n[i] <= len(js) for i, js in links.items())
            if embedding_graph.MOST == old[0]:
                assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == comp
                assert all(r["kept"] == (r["vec_id"] is not None and r["component_id"] == r["vec_id"]) for r in got)
    finally:
        embedding_graph.MOST, embedding_graph.CELL = old
    assert embedding_graph.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [3_000, 100])
def test_embeddings_near_copies(spark, monkeypatch, most):
    """A large group of near copies, in one cell and over many: all linked, no row per pair."""
    monkeypatch.setattr(embedding_graph, "MOST", most)
    monkeypatch.setattr(embedding_graph, "CELL", most // 5)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=12) + rng.normal(size=(600, 12)) * 0.02, rng.normal(size=(200, 12))])
    df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {r["vec_id"]: r for r in embedding_graph.near_duplicates(df).collect()}
    assert all(got[i]["n_links"] <= n for i, n in enumerate(want.tolist()))
    assert sum(r["n_links"] for r in got.values()) >= (1 if most == 3_000 else 0.97) * want.sum()
    assert {got[i]["component_id"] for i in range(600)} == {0}
    points = embedding_graph.points_of(df, "vec_id", "embedding").selectExpr("*", "1L as copies")
    if most == 3_000:
        assert embedding_graph.find_links(points, 0.95, 3).count() < 2 * len(x)
    more, _ = embedding_graph.counted(embedding_graph.find_links(points, 0.95, 3, exact=True), points)
    assert {r["id"]: r["more"] for r in more.collect()} == {i: n for i, n in enumerate(want.tolist()) if n}


def test_embeddings_of_many_large_cells(spark, monkeypatch):
    """Thousands of cells that are to be split at once: neither plans nor what the driver gathers grow with them."""
    for name, value in {"MOST": 6, "CELL": 2, "SAMPLE": 5_000, "DEALT": 700}.items():
        monkeypatch.setattr(embedding_graph, name, value)
    x = np.random.default_rng(5).normal(size=(6_000, 8))
    points = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id long, x array<double>, copies long")
    cells = embedding_graph.cells_of(points, 3).select("cell", "id", "home", "side").toPandas()
    assert cells[cells["side"].eq(0) & cells["home"]]["id"].nunique() <= len(x) == cells[cells["home"]]["id"].nunique()
    whole = cells[~cells["cell"].str.contains("b")]
    assert whole.groupby("cell").size().max() <= 6 and whole.groupby("id")["home"].sum().max() == 1


def test_toxicity(spark, documents):
    rng = random.Random(6)
    rows, labels = odd_rows(), []
    for i in range(400):
        t = words(rng, rng.randrange(20, 90)).split(" ")
        y = int(i % 5 == 0)
        for _ in range(4 * y):
            t[rng.randrange(len(t))] = rng.choice(["Badword!", "(ugly)", "nasty"])
        rows.append((500 + i, " ".join(t), "en", "s", 0))
        labels.append((500 + i, 1, y))
    docs = spark.createDataFrame(rows, DOCS)
    lab = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (500, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    y = dict((i, t) for i, _, t in labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert held and sum(r["predicted"] == y[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert {r["held_out"] for r in got if r["doc_id"] == 501} == {zlib.crc32(b"501") % 4 == 2}
    assert {r["score"] for r in toxicity.score_toxicity(docs, lab.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(empty(spark), lab).count() == 0
    clash = docs.selectExpr("*", "1 as score", "2 as held_out", "'x' as predicted", "3 as y", "4 as fold")
    again = toxicity.score_toxicity(clash, lab, keep=True)
    assert sorted(again.columns) == sorted([*docs.columns, "y", "fold", "held_out", "score", "predicted"])
    assert sorted((repr(r["doc_id"]), r["score"]) for r in again.collect()) == sorted((repr(r["doc_id"]), r["score"]) for r in got)


def test_kneser_ney():
    """Words of one context weigh little in the shared distribution; rare words of a class are smoothed, not dropped."""
    words_ = [("the", 50, 50, 40), ("francisco", 20, 20, 1), ("ugly", 0, 3, 3)]
    model = toxicity.fit_pair(words_, [("the", "ugly", 0, 2), ("the", "the", 5, 5)], (6, 7, 13))
    ugly, d = model.words.index("ugly"), toxicity.DISCOUNT
    assert np.allclose(model.p.sum(1), 1) and model.p[1, ugly] > 2 * model.p[0, ugly] > 0
    follows = np.array([1, 40, 3, 13])  # francisco, the, ugly, unknown
    shared = (follows - d) / follows.sum() + 4 * d / follows.sum() / 4
    n = np.array([[20, 50, 0, 6], [20, 50, 3, 7]])
    mass = np.maximum(n - d, 0) / n.sum(1, keepdims=True)
    assert np.allclose(model.p, mass + (1 - mass.sum(1, keepdims=True)) * shared)
    for c in (0, 1):  # what follows `the` makes one
        assert abs(model.pair_p[c].sum() + model.back[c, model.words.index("the")] - 1) < 1e-9


def test_toxicity_of_few_words_in_long_texts(spark):
    """Two bad words in texts of up to 900 others, each a known stem with an ending that most rows don't share."""
    rng = random.Random(9)
    ends, rows, labels = ["".join(rng.choice("aeioubdglmnrst") for _ in range(3)) for _ in range(300)], [], []
    for i in range(600):
        t = words(rng, rng.randrange(20, 900)).split(" ")
        if i % 4 == 0:
            for _ in range(2):
                t[rng.randrange(len(t))] = "zworqu" + rng.choice(ends)
        rows.append((i, " ".join(t), "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for toxic in (0, 1):
        held = [r for r in got if r["held_out"] and labels[r["doc_id"]][2] == toxic]
        assert held and sum(r["predicted"] == toxic for r in held) >= 0.9 * len(held)


def test_varied_toxicity(spark):
    """Each bad word is in a few documents only."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        t = words(rng, rng.randrange(20, 60)).split(" ")
        for _ in range(6 * (i % 5 == 0)):
            t[rng.randrange(len(t))] = f"bad{rng.randrange(120)}"
        rows.append((500 + i, " ".join(t), "en", "s", 0))
        labels.append((500 + i, 1, int(i % 5 == 0)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r["predicted"], int(r["doc_id"] % 5 == 0)) for r in got if r["held_out"]]
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held) and sum(p == y for p, y in held) >= 0.9 * len(held)


def test_quality(spark):
    rng = random.Random(7)
    rows, bad = odd_rows(), set()
    for i in range(300):
        t = ". ".join(words(rng, 12).capitalize() for _ in range(8)) + "."
        if i % 6 == 0:
            bad.add(600 + i)
            t = [" | ".join(t.split(" ")), t.upper() + "!!", "Again " * 90, re.sub(" ", "$$$ ", t)][i // 6 % 4]
        rows.append((600 + i, t, "en", "s", 0))
    got = {r["doc_id"]: r for r in quality.score_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(got[600 + i]["kept"] for i in range(300) if 600 + i not in bad) >= 0.97 * 250
    assert sum(not got[i]["kept"] for i in bad) >= 0.8 * len(bad)
    assert quality.score_quality(empty(spark)).count() == 0


def test_weak_labels_estimate():
    """EM against a plain loop over documents, and against the share and the accuracies that votes were drawn with."""
    rng = np.random.default_rng(3)
    start = np.array(list(quality.LABELLERS.values()))
    y = rng.random(6000) < 0.7
    true = start.copy()
    true[:, 0, 1] += 0.2
    true[:, 0, 0] -= 0.2
    true[:, 1, 1] = 0.004
    true[:, 1, 0] = 1 - true[:, 1, 1] - true[:, 1, 2]
    v = np.stack([[rng.choice(3, p=true[j, int(c)]) - 1 for c in y] for j in range(len(start))], 1)
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    good, p = quality.estimate(patterns, counts.astype(float))
    assert abs(good - y.mean()) < 0.03 and np.abs(p - true).max() < 0.05
    small = v[:200]
    share, q = quality.PRIOR, np.maximum(start, 1e-9)
    weight = max(1.0, quality.BELIEF * len(small))
    for _ in range(40):
        post = []
        for row in small:
            a, b = share, 1 - share
            for j, x in enumerate(row):
                a, b = a * q[j, 1, x + 1], b * q[j, 0, x + 1]
            post.append(a / (a + b))
        mass = [sum(1 - z for z in post) + weight * (1 - quality.PRIOR), sum(post) + weight * quality.PRIOR]
        share, new = mass[1] / sum(mass), np.zeros_like(q)
        for j in range(len(q)):
            for c in (0, 1):
                for x in range(3):
                    n = sum(z if c else 1 - z for z, row in zip(post, small) if row[j] == x - 1)
                    new[j, c, x] = max(1e-9, (n + weight * (quality.PRIOR if c else 1 - quality.PRIOR) * start[j, c, x]) / mass[c])
            new[j, 1, 1] = min(new[j, 1, 1], quality.MOST)
        q = new
    patterns, counts = np.unique(small, axis=0, return_counts=True)
    good, p = quality.estimate(patterns, counts.astype(float), rounds=40)
    assert abs(good - share) < 1e-6 and np.allclose(p, q, atol=1e-6)


def test_components(spark):
    rng = random.Random(9)
    e = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    parent = {x: x for p in e if None not in p for x in p}
    for _ in range(60):
        for a, b in e:
            if a is not None:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if any(x in p and p[0] != p[1] and None not in p for p in e)}


def test_words():
    texts = [None, "", "  A b\tC ", "x\ufffd\u00a0y", "tail"]
    flat, starts = common.flat_words(pa.array(texts).slice(0))
    assert flat.to_pylist() == [w for t in texts for w in low(t)] and np.diff(starts).tolist() == [len(low(t)) for t in texts]
    part = pa.array(["zz", *texts]).slice(1)
    assert common.flat_words(part)[0].to_pylist() == flat.to_pylist()
