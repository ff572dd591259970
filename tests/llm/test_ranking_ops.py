"""Quality classifier, hard-negative mining, ranked lexical search."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiresight.llm import covertree, lexical, preference

# ---- ranked lexical search


def _terms(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)


def _brute_search(docs, items, k=10):
    lists = [(d, _terms(t)) for d, t in docs]
    lists = [(d, w) for d, w in lists if w]
    n_docs, length = len(lists), sum(len(w) for _, w in lists)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(_terms(t))
    df = {}
    for _, w in lists:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, words in asked.items():
        scored = []
        for d, w in lists:
            m = 100 - 90 + (90 * len(w) * n_docs) // length
            s = 0
            for x in words & set(w):
                tf = w.count(x)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * tf) // (1000 * tf + 8 * m))
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("n", F.lit("x"))


def _run_search(spark, docs, items):
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("a"))
    return sorted(tuple(r) for r in lexical.search(_docs(spark, docs).repartition(3), i).collect())


SEARCH_EDGES = [(900, None), (901, ""), (902, " .,; "), (None, "common w1 w2"), (903, "É É é straße 中文 common"),
                (904, "Common COMMON common"), (905, "tie words here"), (906, "tie words here"),
                (905, "tie words here"), (907, "long " * 30_000 + "rare" + " w3" * 500)]
ITEMS = [(1, "common w1 w2 w3"), (2, "tie words"), (3, None), (4, "unknownterm"), (5, "RARE long É 中文"), (None, "w1"),
         (6, "w4 w5"), (6, "w6, w4"), (7, " ".join(f"w{i}" for i in range(60))), (8, "")]


@pytest.mark.parametrize("first,block,budget", [(64, 1 << 15, 8 << 20), (1, 7, 300)])
def test_search_equals_brute_force(spark, monkeypatch, first, block, budget):
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "QUERY_BYTES", budget if block > 7 else 2_000)
    monkeypatch.setattr(lexical, "CHUNK", 1000)
    r = random.Random(5)
    rows = [(i, " ".join(f"W{min(int(r.expovariate(0.08)), 80)}" for _ in range(r.randint(1, 60))) + " common")
            for i in range(150)]
    rows += SEARCH_EDGES
    assert _run_search(spark, rows, ITEMS) == _brute_search(rows, ITEMS)


def test_search_of_empty_tables(spark):
    assert _run_search(spark, [], ITEMS) == []
    assert _run_search(spark, SEARCH_EDGES, []) == []
    assert _run_search(spark, [(1, None)], [(1, "a")]) == []


def test_nra_stops_early_and_settles_ties():
    r = np.random.default_rng(3)
    n, k = 5_000, 10
    lists, full = [], np.zeros(n, np.int64)
    for t in range(6):
        docs = r.permutation(n)[: r.integers(100, n)]
        impacts = -np.sort(-r.integers(1, 40, len(docs)) ** (1 + t % 3))
        np.add.at(full, docs, impacts)
        lists.append((docs, impacts))
    ids = r.permutation(n) + 10
    scores, names = lexical.resolve(lists, ids, k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    want = np.lexsort((ids, -full))[:k]
    assert scores.tolist() == full[want].tolist() and names.tolist() == ids[want].tolist()

    class Watched(np.ndarray):
        read = 0

        def __getitem__(self, i):
            if isinstance(i, slice):
                Watched.read = max(Watched.read, i.stop or 0)
            return np.asarray(super().__getitem__(i))

    # one list whose head is far above the rest is not read to its end
    docs, impacts = np.arange(n), np.r_[np.arange(2000, 1980, -1), np.ones(n - 20, np.int64)]
    scores, _ = lexical.resolve([(docs.view(Watched), impacts)], docs, k, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert scores.tolist() == list(range(2000, 1990, -1)) and Watched.read <= 2 * lexical.FIRST


# ---- hard negatives

def _brute_mine(rows):
    ok = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None
          and not any(x is None or not math.isfinite(x) for x in v)]
    ok = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, l, v in ok]
    out = []
    for a, (i, l, v) in enumerate(ok):
        if i % 100:
            continue
        s = [(-sum(x * y for x, y in zip(v, w)), j, m == l) for b, (j, m, w) in enumerate(ok) if b != a]
        for ps, p, _ in sorted(x for x in s if x[2])[:5]:
            fit = sorted((ns, n) for ns, n, same in s if not same and 80 * -ps <= 100 * -ns <= 100 * -ps)
            out += [(i, p, r + 1, n, -ps, -ns) for r, (ns, n) in enumerate(fit[:5])]
    return sorted(out)


def _run_mine(spark, rows):
    df = spark.createDataFrame(rows, "id long, label int, x array<double>").withColumn("rank", F.lit("clash"))
    u = covertree.usable(df.repartition(3), "id", "label", "x", 256)
    u = u.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in covertree.mine(u, F.col("id") % 100 == 0).select(*cols).collect())


def _vectors(n, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, 6))
    rows = [(i, int(r.integers(0, 3)), (centres[r.integers(0, 4)] + 0.3 * r.normal(size=6)).tolist()) for i in range(n)]
    rows += [(900 + i, 1, [0.5] * 6) for i in range(40)]  # copies of one vector
    rows += [(100, 2, [0.25] * 6), (950, None, [1.0] * 6), (951, 1, None), (952, 1, [math.nan] * 6),
             (953, 1, [1.0, None]), (None, 1, [1.0] * 6), (954, 1, [math.inf] * 6), (955, 0, [1.5, 0.5]),
             (1000, 9, [0.1] * 6), (1100, 1, [0.0] * 6), (956, 1, [])]
    return rows


@pytest.mark.parametrize("block,own,step,budget", [(4_096, 32, 64, 16 << 20), (37, 5, 2, 100)])
def test_mining_equals_brute_force(spark, monkeypatch, block, own, step, budget):
    for name, v in (("ROWS", block), ("OWN_TREE", own), ("STEP", step), ("QUERY_BYTES", budget)):
        monkeypatch.setattr(covertree, name, v)
    rows = _vectors(700 if block > 100 else 300)
    assert _run_mine(spark, rows) == _brute_mine(rows)


def test_mining_of_empty_and_lonely_rows(spark):
    assert _run_mine(spark, []) == []
    assert _run_mine(spark, [(100, 1, [1.0])]) == []
    assert _run_mine(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 1, [0.9])]) == []  # no other label


def test_whole_products_beyond_floating_point():
    rows = np.array([[2 ** 31 + 1, 1], [2 ** 31, 3], [5, 5]], np.int64)
    q = np.array([2 ** 30 + 1, 7], np.int64)
    up, level = covertree.build(covertree.augment(rows.astype(float)))
    f = covertree.Forest(rows, np.zeros(3, np.int32), up, level)
    ((points, scores),) = covertree.descend(f, rows, np.arange(3), np.ones(3, bool), q, np.array([-2 ** 63]),
                                            np.array([2 ** 63 - 1]), 2)
    want = (rows.astype(object) @ q.astype(object)).tolist()
    assert scores.tolist() == sorted(want, reverse=True)[:2] and points.tolist() == [0, 1]


def test_cover_tree_invariants_and_pruning():
    r = np.random.default_rng(2)
    x = np.concatenate([c + 0.02 * r.normal(size=(200, 5)) for c in 3 * r.normal(size=(8, 5))] + [np.ones((30, 5))])
    a = covertree.augment(x)
    assert np.allclose((a ** 2).sum(1), (a ** 2).sum(1)[0])
    up, level = covertree.build(a)
    for lev in np.unique(level):
        if -2000 < lev < 2000:
            here = a[level >= lev]  # separation
            d = np.sqrt(((here[:, None] - here[None]) ** 2).sum(-1)) + 1e9 * np.eye(len(here))
            assert d.min() > 2.0 ** lev * (1 - 1e-6)
            mine = np.flatnonzero(level == lev)  # covering, by a parent of a higher level
            assert (np.sqrt(((a[mine] - a[up[mine]]) ** 2).sum(1)) <= 2.0 ** (lev + 1) * (1 + 1e-6)).all()
            assert (level[up[mine]] > lev).all()
    scale = np.floor(256 * x).astype(np.int64)
    up, level = covertree.build(covertree.augment(scale.astype(float)))
    f = covertree.Forest(scale, np.zeros(len(x), np.int32), up, level)
    below = [set() for _ in f.center]
    for i in range(len(f.center)):  # radii cover everything below, level by level
        todo, pts = [i], set()
        while todo:
            j = todo.pop()
            pts |= set(f.points[j].tolist())
            todo += f.nodes[j].tolist()
        below[i] = pts
        g = covertree.augment(scale.astype(float))
        assert np.sqrt(((g[list(pts)] - g[f.center[i]]) ** 2).sum(1)).max() <= f.radius[i] * (1 + 1e-9) + 1e-6
    assert len(set().union(*below)) == len(x) - 1  # all but the root

    class Rows(np.ndarray):
        met = 0

        def __getitem__(self, i):
            got = np.asarray(super().__getitem__(i))
            Rows.met += len(got) if got.ndim == 2 and got.shape[0] != len(f.center) else 0
            return got

    rows = scale.astype(np.float64).view(Rows)
    q = scale[5].astype(np.float64)
    s = scale @ scale[5]
    high = np.int64(np.sort(s)[-50])
    low = np.int64(high * 0.95)
    ((got, _),) = covertree.descend(f, rows, np.arange(len(x)), np.ones(len(x), bool), q, np.array([low]),
                                    np.array([high]), 5)
    want = [i for i in np.lexsort((np.arange(len(x)), -s)) if low <= s[i] <= high][:5]
    assert got.tolist() == want and Rows.met < len(x) / 2


# ---- quality classifier

def _quality_rows(n, seed):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(30, 120))]
        bad = r.random() < 0.3
        if bad:
            kind = r.randrange(3)
            words = ([w.upper() + "!!" for w in words] if kind == 0 else [w + "###" for w in words] if kind == 1
                     else [w for w in words[:8] for _ in range(9)])
        docs.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_classifier_ranks_held_out_documents(spark):
    docs, labels = _quality_rows(1500, 4)
    docs += [(5000, None), (5001, ""), (5002, "x " * 300_000), (None, "some text"), (3, docs[3][1])]
    labels += [(7, None, 0), (5000, 1, 0), (9, 1 - labels[9][1], 0), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("x"), "good": F.lit(0)})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = preference.classify(d, lab, ~held).collect()
    assert len(out) == len(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    truth = {i: q for i, q, _ in labels[:1500]}
    rows = [r for r in out if not r["trainable"] and r["doc_id"] in truth]
    good, bad = ([r["score"] for r in rows if truth[r["doc_id"]] == q] for q in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(rows) > 200 and auc > 0.98
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1

    # labels of held-out documents are never read
    flipped = lab.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in preference.classify(d, flipped, ~held).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-6) for r in out)


def test_classifier_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in preference.classify(d, lab, F.lit(True)).collect()] == [0.5, 0.5]
    assert preference.classify(d.limit(0), lab, F.lit(True)).collect() == []


def test_weights_minimise_the_pairwise_loss(spark):
    r = np.random.default_rng(0)
    x = r.random((400, preference.N_FEATURES))
    true = np.zeros(preference.N_FEATURES)
    true[:3] = 4, -3, 2
    good = r.random(400) < 1 / (1 + np.exp(-(x - 0.5) @ true))
    rows = [(i, x[i].tolist(), bool(good[i])) for i in range(400)]
    known = spark.createDataFrame(rows, "doc_id long, x array<double>, good boolean")
    w = preference.fit(known)
    one = known.withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    pairs = preference.preferences(one.where("good"), one.where("not good")).collect()
    d, y = np.array([p["d"] for p in pairs]), np.array([p["label"] for p in pairs])
    assert set(y) == {0.0, 1.0} and len(pairs) == 4 * max(good.sum(), 400 - good.sum())

    def loss(v):
        z = d @ v
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    assert all(loss(w) <= loss(w + e) + 2e-4 for e in 0.05 * r.normal(size=(50, len(w))))
    assert w[0] > 0 > w[1] and w[2] > 0
