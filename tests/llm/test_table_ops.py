"""Suffix dedup, top-k search, language model, token files, mixing, packing, the pipeline."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hiresight.llm import lm, mixing, packing, rans, sadedup, suffix, tokens, topk

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


# ---- suffix sorting and repeat removal

def _check_order(x, cap, **kw):
    pos, lcp = [], []
    with suffix.Scratch() as s:
        suffix.sort(np.asarray(x), max(x) + 1, cap, lambda p, v: (pos.append(p.copy()), lcp.append(v.copy())), s, **kw)
    pos, lcp = np.concatenate(pos).tolist(), np.concatenate(lcp).tolist()
    assert sorted(pos) == list(range(len(x)))
    for i in range(1, len(x)):
        a, b = x[pos[i - 1]:], x[pos[i]:]
        assert a[:cap] >= b[:cap]
        n = next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
        assert lcp[i] == min(n, cap)


@pytest.mark.parametrize("batch", [4, 1 << 18])
def test_suffix_order_and_common_prefixes(batch, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH", batch)
    r = random.Random(1)
    for it in range(80):
        x = [r.randint(1, r.choice([1, 2, 3, 8])) for _ in range(r.randint(0, 50))]
        if it % 3 == 0:
            x = (x * 5)[:150]
        # base 0 recurses down to distinct names, limit 3 keeps the queues on disk
        _check_order(x + [0], r.choice([3, 200]), base=r.choice([0, 1000]), limit=r.choice([3, 10 ** 6]))


def _brute_repeats(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[i:i + 200] for x in raws for i in range(len(x) - 199))
    out = []
    for (d, _), x in zip(rows, raws):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 199):
            if seen[x[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d is None, d or 0, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("split", [256, 4])
def test_repeats_are_removed_exactly(spark, split, monkeypatch):
    monkeypatch.setattr(sadedup, "SPLIT", split)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghé") for _ in range(6))
    base = " ".join(word() for _ in range(120))
    rows = [(5000, None), (5001, ""), (5002, "=" * 700), (5003, "ab" * 300), (5004, "x" * 199), (5005, "x" * 199),
            (5006, "y" * 200), (5007, "y" * 200), (None, base), (5008, base), (5008, base), (5009, "é" * 150)]
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        rows.append((i, "".join(t)))
        rows.append((100 + i, " ".join(word() for _ in range(40)) + base[100:100 + r.randint(150, 260)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("k", F.lit(1))
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])
                 for x in sadedup.remove_repeats(df).collect())
    assert got == _brute_repeats(rows)


# ---- top-k

def _brute_topk(rows, k=10):
    v = [(i, np.floor(1024 * np.array(x, float)).astype(int)) for i, x in rows]
    out = []
    for a, (q, x) in enumerate(v):
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for b, (i, y) in enumerate(v) if a != b)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_a_shard_of_the_default_size_uses_the_disk_queues(monkeypatch):
    spills = []
    spill = suffix.Queue._spill
    monkeypatch.setattr(suffix.Queue, "_spill", lambda self: (spills.append(self.held), spill(self))[1])
    r = np.random.default_rng(3)
    own = [bytes(r.integers(97, 123, 337, dtype=np.uint8)) for _ in range(sadedup.SHARD // 337)]
    own[-1] = own[0][:250] + own[-1][250:]  # 51 windows occur twice
    flags = sadedup.marked_windows(own, [138] * len(own))
    assert spills and max(spills) <= suffix.QUEUE + suffix.BATCH
    hit = {i: f.nonzero()[0].tolist() for i, f in enumerate(flags) if f.any()}
    assert hit == {0: list(range(51)), len(own) - 1: list(range(51))}


def test_pieces_of_batches_change_nothing(monkeypatch):
    import hashlib

    import pyarrow as pa
    import zstandard
    r = np.random.default_rng(8)
    texts = [bytes(r.integers(97, 105, n, dtype=np.uint8)) for n in (0, 5, 199, 200, 700, 5000, 300)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts + [texts[5], texts[0]], pa.binary())],
                                      ["doc_id", "raw"])
    z = zstandard.ZstdCompressor()
    marks = [[], [], [], [{"lo": 0, "hi": 1}], [{"lo": 3, "hi": 9}, {"lo": 300, "hi": 301}], [{"lo": 4000, "hi": 4801}], []]
    left = pa.RecordBatch.from_arrays(
        [pa.array([hashlib.md5(t).digest() for t in texts]), pa.array([z.compress(t) for t in texts]),
         pa.array(marks, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["k", "z", "marks"])

    def rows(batches):
        return [x for b in batches for x in b.to_pylist()]

    whole = rows(sadedup._anchors([docs])), rows(sadedup._remove(True)([left, left.slice(4, 2)]))
    assert len(whole[0]) == 9 and whole[0][5]["h"] and not whole[0][7]["h"]  # the copy leaves its segments out
    assert [x["n_removed"] for x in whole[1]] == [0, 0, 0, 200, 405, 1000, 0, 405, 1000]
    assert whole[1][4]["kept"] == texts[4][:3] + texts[4][208:300] + texts[4][500:]
    assert all(x["kept"] is None for x in rows(sadedup._remove(False)([left])))
    monkeypatch.setattr(sadedup, "PIECE", 64)
    assert (rows(sadedup._anchors([docs])), rows(sadedup._remove(True)([left, left.slice(4, 2)]))) == whole


@pytest.mark.parametrize("block", [8192, 64])
def test_topk_is_exact(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", block)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, .3, 8).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rows[100][1]) for i in range(30)]  # ties
    bad = [(900, None), (901, [None] * 8), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>")
    v = topk.usable(df, "vec_id", "embedding", 1024).withColumn("row", F.monotonically_increasing_id()).cache()
    got = sorted(tuple(x) for x in topk.search(v, v.where("id % 100 = 0")).collect())
    assert got == _brute_topk(rows + rows[:5])
    assert topk.search(v.limit(0), v.limit(0)).count() == 0


def test_topk_sparse_queries_and_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (100, [1.0, 0.0]), (3, [-1.0, 2.0])], "vec_id long, embedding array<double>")
    v = topk.usable(df, "vec_id", "embedding", 1024)
    got = sorted(tuple(x) for x in topk.search(v, v.where("id % 100 = 0")).collect())
    assert got == [(0, 1, 3, 0), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 3, -1048576)]


def test_topk_keeps_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [5.0, 0.0]), (100, [2.0, 0.0])],
                               "vec_id long, embedding array<double>")
    v = topk.usable(df, "vec_id", "embedding", 1).withColumn("row", F.monotonically_increasing_id()).cache()
    got = sorted(tuple(x) for x in topk.search(v, v.where("id % 100 = 0")).collect())
    assert got == sorted([(100, 1, 1, 5), (100, 2, 100, 2), (100, 3, 1, 0), (100, 1, 1, 10), (100, 2, 100, 2), (100, 3, 1, 0)])


def test_known_pieces_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_BYTES", 2_000)
    e = tokens.Encoder(P.path("word_bpe_49k.json"))
    full = tokens.encoder(P.path("word_bpe_49k.json"))
    r = random.Random(1)
    for _ in range(200):
        x = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(1, 9))) for _ in range(20))
        assert e.ids(x) == full.ids(x)
    assert len(e.words) + len(e.plain) < 20


# ---- language model

def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(lm.np, "float32", np.float64)
    words = [b"a", b"b", b"c", b"d", b"e."]
    counts = [(w, 50 - 9 * i) for i, w in enumerate(words)] + [(b"", 20)]
    v = lm.Vocabulary(sorted(counts, key=lambda x: -x[1]), 200, 9, {0: (7, 2), 2: (3, 1)})
    p = {k: a.astype(np.float64) for k, a in lm.initial(v).items()}
    k = v.lookup()
    docs = [k.encode([*r, b""]) for r in ([b"a", b"zz", b"b"], [b"c", b"a"], [b"q.", b"e.", b"d", b"a"])]
    x, c, w, doc, start = lm.lanes(k, docs, 2)

    def loss(p):
        g, _, total, n = lm.gradients(p, v, x, c, w, doc >= 0, start, np.zeros((2, lm.STATE)))
        return total / n, g

    _, g = loss(p)
    for name in p:
        i = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        hi, lo = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        hi[name][i] += 1e-5
        lo[name][i] -= 1e-5
        assert g[name][i] == pytest.approx((loss(hi)[0] - loss(lo)[0]) / 2e-5, rel=1e-4)


def test_score_equals_a_step_by_step_evaluation():
    """Texts of several windows and lanes, each token scored from the state of all before it."""
    r = np.random.default_rng(4)
    words = [b"w%d" % i for i in range(40)]
    v = lm.Vocabulary([(b"", 90)] + [(w, 80 - i) for i, w in enumerate(words)], 4000, 60, {0: (15, 3), 4: (9, 2)})
    p = {k: (a + r.normal(0, 0.4, a.shape)).astype(np.float32) for k, a in lm.initial(v).items()}
    k, n = v.lookup(), lm.STATE
    texts = [[words[i] if i < 40 else b"other%d" % i for i in r.integers(0, 50, m)] + [b""]
             for m in (3 * lm.WINDOW + 5, lm.WINDOW, lm.WINDOW - 1, 0, 1, 200)]
    docs = [k.encode(t) for t in texts]
    got = lm.score(p, v, docs)
    q = {name: a.astype(float) for name, a in p.items()}
    for ids, have in zip(docs, got):
        h, x, want = np.zeros(n), k.ins[k[b""]], 0.0
        for i in ids:
            a, u = q["E"][x] @ q["Wx"] + q["b"], h @ q["U"]
            z, reset = 1 / (1 + np.exp(-(a[:n] + u[:n]))), 1 / (1 + np.exp(-(a[n:2 * n] + u[n:2 * n])))
            h = z * h + (1 - z) * np.tanh(a[2 * n:] + reset * u[2 * n:])
            e = np.exp(h @ q["C"] + q["cb"])
            want += np.log(e[k.cls[i]] / e.sum())
            if k.out[i] >= 0:
                lo, hi = v.first[k.cls[i]], v.first[k.cls[i] + 1]
                e = np.exp(q["W"][lo:hi] @ h + q["wb"][lo:hi])
                want += np.log(e[k.out[i] - lo] / e.sum())
            x = k.ins[i]
        assert have == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one():
    words = [b"", b"a", b"b", b"c", b"d"]
    v = lm.Vocabulary([(w, 10 - i) for i, w in enumerate(words)], 60, 8, {0: (15, 3)})
    p = lm.initial(v)
    h = np.random.default_rng(0).normal(size=(1, lm.STATE)).astype(np.float32)
    n = len(words)
    cls = np.concatenate([v.cls, v.n_cls + np.arange(lm.SHAPES)])
    out = np.concatenate([np.arange(n), np.full(lm.SHAPES, -1)])
    lp = lm.log_probs(p, v, np.repeat(h, len(cls), 0), cls, out)
    assert np.exp(lp).sum() == pytest.approx(1, rel=1e-5)


def test_words_of_lower_rank_follow_their_context():
    words = [b"w%d" % i for i in range(6000)]  # one shape
    v = lm.Vocabulary([(b"", 9000)] + [(w, 7000 - i) for i, w in enumerate(words)], 10 ** 8, 6001, {0: (10 ** 6, 1906)})
    k, p = v.lookup(), lm.initial(v)
    ids = k.encode(words[:4095])
    assert len(set(k.ins[ids])) == 4095  # each has its own input
    h = np.random.default_rng(0).normal(size=(2, lm.STATE)).astype(np.float32)
    a, b = (lm.log_probs(p, v, np.repeat(x[None], 4095, 0), k.cls[ids], k.out[ids]) for x in h)
    for c in np.unique(k.cls[ids]):  # within a class, too, the state moves each word by its own factor
        own = (a - b)[k.cls[ids] == c]
        assert len(np.unique(np.round(own, 7))) > 0.9 * len(own)


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 60)  # most words take the joined way
    monkeypatch.setattr(lm, "DIRECT", 30)
    r = random.Random(6)
    lang = [[f"{c}{i}" for i in range(40)] for c in "xy"]  # two languages
    rows = []
    for i in range(600):
        rows.append((i, " ".join(r.choice(lang[i % 2]) for _ in range(r.randint(5, 60)))))
    rows += [(7001, None), (7002, ""), (7003, "never seen"), (None, "x1 X2"), (7004, "x1 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    toks = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    c = collections.Counter(w for d, ws in toks.items() if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm.evaluate(df).collect()
    assert len(got) == len(rows)
    gain = 0.0
    for x in got:
        ws = toks[x["doc_id"]]
        assert x["held_out"] == held(x["doc_id"]) and x["train_tokens"] == n
        assert (x["n_tokens"], x["n_known"]) == (len(ws), sum(c[w] > 0 for w in ws))
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        if x["held_out"] and x["n_tokens"] > 5:
            gain += x["score"] - x["base_score"]
    assert gain > 0  # the state tells the languages apart


# ---- token ids and their format

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    e, r = tokens.encoder(P.path(name)), random.Random(7)
    parts = list("ab  \n\t\r.,'s!1é中\x85\xa0 \x1c\u3000") + ["'ll", "<|endoftext|>", "<|EndOfText|>", "  ", "\n\n", " the", "Straße.", "µm",
             "naïve?!", "don't", "x###", "ªº", "İ", "a" * 60]
    for _ in range(1500):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(e.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_words_joined_by_line_ends_are_looked_up_one_by_one():
    e = tokens.Encoder(P.path("byte_bpe_50k.json"))
    x = "one two,\nthree isn't\r\n\n4th,two one\n"
    for text in (x, x.replace(" ", "\n"), "one\n" + x, "Größe\tne1²½ x\xa0y\n\n.b " + x):
        assert np.frombuffer(e.ids(text), "<u4").tolist() == e.t.encode(text, add_special_tokens=False).ids
    assert {"one", "two", "two,", "isn't"} <= set(e.words) and {"\nthree", "\r\n\n4th,two"} <= set(e.plain)


def test_ids_leave_the_decoder_only_when_asked_for():
    ids = np.arange(500, dtype=np.uint32)
    freqs = rans.scale(np.bincount(ids))
    raw = rans.encode_block(ids, rans.Table(freqs))
    block = pa.RecordBatch.from_pylist([{"part": 0, "block": 0, "crc": zlib.crc32(raw), "doc_ids": [3, 4], "lengths": [200, 300],
                                         "payload": raw}])
    bare, whole = (next(iter(rans._decode(freqs, w)([block]))) for w in (False, True))
    assert "ids" not in bare.schema.names and bare.to_pylist() == whole.drop_columns(["ids"]).to_pylist()
    assert b"".join(whole.column("ids").to_pylist()) == ids.tobytes()


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 70_000, 600_000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50_257).astype(np.uint32)
    table = rans.Table(rans.scale(np.bincount(ids, minlength=50_257)))
    assert int(table.f.sum()) == 1 << rans.BITS
    raw = rans.encode_block(ids, table)
    assert (rans.decode_block(raw, table) == ids).all()
    k = rans._HEAD.unpack_from(raw)[3]
    parts = [rans.decode_block(raw, table, i, i + 1) for i in range(k)]  # from each checkpoint alone
    assert (np.concatenate(parts) == ids).all()
    spoilt = bytearray(raw)
    spoilt[-1] ^= 255
    with pytest.raises((ValueError, IndexError)):
        rans.decode_block(bytes(spoilt[:-4] + b"\x00" * 4 if n < 3 else spoilt), rans.Table(rans.scale(np.array([1, 1]))))


def test_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK", 500)
    monkeypatch.setattr(rans, "PART", 4000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text").collect()
    rows = [tuple(x) for x in docs] + [(9000, None), (9001, ""), (5, "twice"), (5, "twice"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("start", F.lit(1))
    rans.write(df, P.path("byte_bpe_50k.json"), 0, str(tmp_path / "f"))
    got = rans.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    e = tokens.encoder(P.path("byte_bpe_50k.json"))
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(e.ids(t or "") + bytes(4))
    at = 0
    assert len(got) == len(rows)
    for x in got:
        assert x["start"] == at and bytes(x["ids"]) in want[x["doc_id"]]
        assert (x["n_tokens"], x["ids_crc32"]) == (len(x["ids"]) // 4, zlib.crc32(x["ids"]))
        at += x["n_tokens"]
    ids = [x["doc_id"] for x in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    rans.write(df.limit(0), P.path("byte_bpe_50k.json"), 0, str(tmp_path / "e"))
    assert rans.read(spark, str(tmp_path / "e")).count() == 0


# ---- mixing

def _mix_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_taken(spark):
    r = random.Random(8)
    rows = []
    for i in range(3000):
        s = r.choice(["a", "a", "a", "b", "c", None, "d"]) if i else "tiny"
        rows.append((i, s, "w " * r.randint(0, 80)))
    rows += [(8000, "b", None), (8001, "b", "x y"), (8001, "b", "x y"), (None, "c", "one two")]
    df = _mix_table(spark, rows).repartition(3).withColumn("shards", F.lit("clash"))
    got = mixing.deal(mixing.draw(df)).collect()
    assert len(got) == len(rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for x in got:
        assert len(x["shards"]) == x["copies"] <= 3
        size[x["source"]] += x["size"]
        taken[x["source"]] += x["size"] * x["copies"]
        target[x["source"]] = x["target"]
    total = sum(size.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    want, free, left = {}, set(size), total
    while True:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 3 * size[s]}
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
        free -= over
    want.update({s: weight[s] * unit for s in free})
    for s in size:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 2
    again = {(x["doc_id"], x["copies"], tuple(x["shards"])) for x in mixing.deal(mixing.draw(df)).collect()}
    assert again == {(x["doc_id"], x["copies"], tuple(x["shards"])) for x in got}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x["copies"] for x in got)


def test_split_quotas_are_exact():
    c = np.array([100, 7, 0, 33])
    q = mixing.split(c, 6, np.random.default_rng(1))
    assert q.shape == (6, 4) and (q.sum(axis=0) == c).all() and (q >= 0).all()
    assert q.sum(axis=1).max() - q.sum(axis=1).min() <= 2


def test_mix_of_nothing(spark):
    assert mixing.mix(_mix_table(spark, [])).count() == 0


# ---- packing

def test_plan_is_best_fit_decreasing():
    r = random.Random(9)
    for _ in range(100):
        c = collections.Counter(r.choices(range(1, 33), k=r.randint(1, 60)))
        bins = []
        for n in sorted(c.elements(), reverse=True):
            fit = [b for b in bins if b >= n]
            if fit:
                bins[bins.index(min(fit))] -= n
            else:
                bins.append(32 - n)
        place = collections.defaultdict(list)
        for n, a, z, s, per, off in packing.plan(dict(c), 32):
            for k in range(z - a + 1):
                place[s + k // per].append((off + k % per * n, n))
        used = []
        for v in place.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            used.append(32 - at)
        assert sorted(used) == sorted(bins)


def test_packing(spark):
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(9000, None), (9001, ""), (9002, "long words " * 5000), (3, "twice"), (3, "twice"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("length", F.lit(1))
    e = tokens.encoder(P.path("word_bpe_49k.json"))
    want = collections.Counter()
    for d, t in rows:
        ids = e.ids(t or "") + (1).to_bytes(4, "little")
        for k in range(0, len(ids), 4 * 512):
            own = ids[k:k + 4 * 512]
            want[d, k // 2048, k // 4, len(own) // 4, zlib.crc32(own)] += 1
    out = packing.pack(df, P.path("word_bpe_49k.json"), 1, 512).collect()
    got = collections.Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in out)
    assert got == want
    seqs = collections.defaultdict(list)
    for x in out:
        assert zlib.crc32(x["ids"]) == x["ids_crc32"]
        seqs[x["sequence_id"]].append((x["offset"], x["length"]))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 512
    assert packing.pack(df.limit(0), P.path("word_bpe_49k.json"), 1, 512).count() == 0


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it must leave of its own input."""
    from hiresight.llm import pii, quality, simhash
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "pii", "mix_sources", "best_fit_packing"]
    seen = docs
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, seen, SF)
        path = str(tmp_path / name)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        ids = sorted(x["doc_id"] for x in out.select("doc_id").collect())
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        if name == "quality_rules":
            assert ids == sorted(x["doc_id"] for x in quality.judge(seen, labels).where("kept").collect())
        elif name == "simhash_dedup":
            assert ids == sorted({x["component_id"] for x in simhash.components(seen).collect()})
        elif name == "pii":
            assert ids == sorted(x["doc_id"] for x in seen.collect())
            assert pii.scan(out).selectExpr("max(n_email + n_ip + n_card + n_phone)").first()[0] == 0
        elif name == "mix_sources":
            want = mixing.draw(seen).selectExpr("doc_id", "copies").collect()
            assert ids == sorted(i for x in want for i in [x["doc_id"]] * x["copies"])
        else:
            assert set(ids) == {x["doc_id"] for x in seen.collect()}
        seen = out


def test_pipeline_edge_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, 1), (2, "", None, None, None, 1), (None, "a b " * 40, "en", None, 9, 1),
            (3, " ".join(f"w{i}" for i in range(80)), "en", "s", 5, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            table = step(spark, table, str(tmp_path))
            table.collect()


def test_registered_queries(spark):
    import __spark_entry__ as e
    q = e.queries()
    for n, name in enumerate(["suffix_dedup", "simhash", "topk", "lm_score", "secret_scan", "pii", "rans_tokens",
                              "quality_rules", "mix_sources", "best_fit_packing"], 1):
        assert f"op{n}_{name}" in q
    assert "pipeline" in q and {"op3_topk", "op9_mix_sources"} <= set(e.oracle_sql())
