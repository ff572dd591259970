"""Quality rules, secret scan, personal data, SimHash against brute force, with edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hiresight.llm import pii, quality, secrets, simhash

WORDS = ["token", "secret", " ", "=", ":", '"', "abc", "a@b.co", "1.2.3.4", "256.1.1.1", "+1 (555) 010-9999",
         "4111 1111 1111 1111", "AKIA", "ABCDEFGHIJ123456", "é", "中", "\n", "0123456789abcdef",
         "deadbeefdeadbeefdeadbeef", "x", ".", "-", "API_key", "_", "@", "0001.2.3.004", "12345678901234567890"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    rows = [(i, "".join(r.choice(WORDS) for _ in range(r.randint(0, 30)))) for i in range(400)]
    rows += [(9001, None), (9002, ""), (9003, "1 " * 300 + "4111111111111111 " * 300), (9004, "a" * 50_000),
             (9005, "9" * 20_000), (9006, "a.b@" * 500 + "é@c.de " * 300), (None, "token=abcdefgh"),
             (7, "token=abcdefgh"), (7, "token=abcdefgh")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns whose names clash with the operators' own
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3) \
        .withColumns({"n_email": F.lit(1), "base": F.lit("x"), "lang": F.lit("en"), "size": F.lit(2)})


def _sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def brute_secrets(t):
    t = t or ""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    a = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
    b = [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    c = [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return len(a), len(b), len(c), _sha(sorted(a + b + c, key=lambda x: (x[1], order[x[0]])))


def _luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def brute_pii(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    e = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    i = [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
         if all(int(x) <= 255 for x in m[0].split("."))]
    c = [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
         if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    p = [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
         if 9 <= len(digits(m)) <= 15]
    return len(e), len(i), len(c), len(p), _sha(e + i + c + p)


def _same(rows, texts, cols, brute):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *[r[c] for c in cols]) for r in rows)
    want = sorted((d is None, d or 0, *brute(t)) for d, t in texts)
    assert got == want


def test_secret_base_spans(docs, texts):
    rows = secrets.scan(docs).collect()
    _same(rows, texts, ["n_assign", "n_access", "n_hex", "base_sha256"], brute_secrets)


def test_random_tokens_are_found_and_words_left(spark):
    r = random.Random(1)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syll = ["tion", "ment", "ing", "er", "an", "the", "re", "on", "st"]
    rows, planted = [], {}
    for i in range(600):
        words = ["".join(r.choice(syll) for _ in range(r.randint(1, 14))) for _ in range(30)]
        if i % 6 == 0:
            words[10] = "".join(r.choice(alnum) for _ in range(48))
            planted[i] = words[10]
        rows.append((i, " ".join(words)))
    out = {x["doc_id"]: x["spans"] for x in secrets.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = [i for i in planted if "random:" in out[i]]
    false = [i for i in out if i not in planted and "random:" in out[i]]
    assert len(hit) >= 0.9 * len(planted) and len(false) <= 0.1 * len(hit) + 3
    text = dict(rows)
    for i in hit:
        a, b = map(int, out[i].split("random:")[1].split(",")[0].split(":"))
        assert text[i][a:b] == planted[i]


def _randomness(token: str, alphabet: str) -> float:
    """The three tests written out; the chi-squared tail with three degrees of freedom."""
    n, k = len(token), len(alphabet)
    chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in alphabet)
    z1 = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    code = [alphabet.index(c) + 0.5 for c in token]
    high = [y > k / 2 for y in code]
    n1, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:]))
    n2, z2, z3 = n - n1, 99.0, 99.0
    if n1 and n2:
        z2 = (runs - (2 * n1 * n2 / n + 1)) / math.sqrt(max(2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1)), 0.01))
    mean = sum(code) / n
    if v := sum((y - mean) ** 2 for y in code):
        z3 = (sum((a - mean) * (b - mean) for a, b in zip(code, code[1:])) / v + 1 / n) * math.sqrt(n)
    q = z1 * z1 + z2 * z2 + z3 * z3
    return math.erfc(math.sqrt(q / 2)) + math.sqrt(2 * q / math.pi) * math.exp(-q / 2)


def test_secret_statistics_equal_the_tests_written_out(spark):
    r = random.Random(11)
    kinds = {k: a for k, a in (secrets.ALPHABETS | {"mixed": secrets.MIXED}).items() if k not in ("lower", "upper")}
    tokens = [("".join(r.choice(a[:r.choice([2, 9, len(a)])]) for _ in range(r.choice([20, 24, 33, 70, 200]))))
              for a in kinds.values() for _ in range(25)]
    tokens += ["Aa0" * 9, "0" * 30, "A" * 10 + "9" * 10, "Zz" * 64 + "_-/+"]
    rows = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")
    got = {x["doc_id"]: x["tokens"] for x in secrets.candidates(rows).select("doc_id", "tokens").collect()}
    seen = set()
    for i, token in enumerate(tokens):
        (t,) = got[i]
        if t["word"]:
            continue
        p = secrets.BINS * _randomness(token, kinds[t["enc"]])
        assert (t["s"], t["e"]) == (0, len(token)) and t["cls"] == sum(len(token) >= c for c in secrets.CLASSES) - 1
        assert int(p - 0.01) <= t["bin"] <= min(int(p + 0.01), secrets.BINS - 1), (token, t, p)
        seen.add(t["enc"])
    assert seen == set(kinds)


def test_long_keys_are_found_in_prose(spark):
    r = random.Random(8)
    prose = ("the people of this town were told that a new road would be built near the old mill and many of them "
             "came to the hall to hear what it might cost and who was going to pay for it in 2014 or later").split()
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, planted = [], {}
    for i in range(900):
        words = [r.choice(prose) for _ in range(150)]
        words[50] = r.choice(["/", "_", "-"]).join(r.choice(prose) for _ in range(r.randint(6, 14)))
        if i % 6 == 0:
            planted[i] = words[20] = "".join(r.choice(alnum + "+/" * (i % 4 // 2)) for _ in range([32, 40, 64][i // 6 % 3]))
        rows.append((i, " ".join(words)))
    out = {x["doc_id"]: x["spans"] for x in secrets.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, hit, false = dict(rows), {32: 0, 40: 0, 64: 0}, 0
    for i, spans in out.items():
        for x in filter(None, spans.split(",")):
            a, b = map(int, x.split(":")[1:])
            if text[i][a:b] == planted.get(i):
                hit[b - a] += 1
            else:
                false += 1
    assert min(hit.values()) >= 40 and false <= 0.1 * sum(hit.values()) + 3  # 50 of each


def test_pii_base_spans(docs, texts):
    rows = pii.scan(docs).collect()
    _same(rows, texts, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"], brute_pii)


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(9)
    d = lambda n: "".join(r.choice("123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 10))) + r.choice(["", "", d(1), d(2)])
    rows, want = [], {}
    for i in range(900):
        t = (f"please call +1 {d(3)} {d(3)} {d(4)} or mail {word()}@{word()}.com and note 2014-0{i % 9 + 1}-12 10:00 then "
             f"look at {word()}.that or 1 2 3 4 5 6 7 8 9 {d(1)} in rows {d(3)}.456.789.101 of it")
        if i % 30 == 0:
            new = [("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", "00 44 20 7946 0958"),
                   ("email", "jane (at) example (dot) com")][i // 30 % 3]
            t += f". Now {'call' if new[0] == 'phone' else 'mail'} {new[1]} please"
            want[i] = f"{new[0]}:{t.index(new[1])}:{t.index(new[1]) + len(new[1])}"
        rows.append((i, t))
    return spark.createDataFrame(rows, "doc_id long, text string"), want


def test_pii_in_other_forms_is_found(planted):
    df, want = planted
    out = {x["doc_id"]: x["spans"].split(",") for x in pii.scan(df).collect()}
    missed = [i for i in want if want[i] not in out[i]]
    extra = sum(len(x) - 2 for x in out.values()) - len(want)
    assert not missed and extra <= 5


def test_pii_threshold_covers_all_refused(planted, monkeypatch):
    monkeypatch.setattr(pii, "TRAIN", 100)  # of 900 known and some 2,700 refused
    seen = {}

    def cuts(scores, alpha):
        kept = [tuple(x) for x in scores.collect()]
        seen.update({k: sorted(s for j, s in kept if j == k) for k, _ in kept})
        return exact(scores, alpha)

    exact = pii._exact_cuts
    monkeypatch.setattr(pii, "_exact_cuts", cuts)
    models = pii.fit(pii.stage(pii.candidates(planted[0]), "pii-test"), 0.002)
    assert len(seen["phone"]) > 2500 and len(seen["email"]) > 800
    for k, x in seen.items():
        assert models[k][1] == x[len(x) - 1 - int(0.002 * len(x))]


def test_nothing_is_added_without_refused_candidates(spark):
    df = spark.createDataFrame([(1, "order 123 456 7890 12 shipped"), (2, "mail a.b@example.org now")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.scan(df).collect()}
    assert got[1] == "" and got[2].startswith("email:5:")
    assert sorted(r["text"] for r in pii.redact(df).collect()) == ["mail <EMAIL> now", "order 123 456 7890 12 shipped"]


def test_redaction_replaces_spans_and_keeps_columns(spark):
    df = spark.createDataFrame(
        [(1, "write a@b.co or +1 555 010 9999 é", "k"), (2, None, "k"), (3, "clean", None)],
        "doc_id long, text string, every string")
    got = {r["doc_id"]: (r["text"], r["every"]) for r in pii.redact(df).collect()}
    assert got == {1: ("write <EMAIL> or <PHONE> é", "k"), 2: (None, "k"), 3: ("clean", None)}


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit))


def test_quality_counts_and_bounds(spark, texts):
    r = random.Random(2)
    rows = [(i, t) for i, t in texts if i is not None and i < 400 and i != 7]
    rows += [(1000 + i, "\n".join(r.choice(["a b c", "#x $y", " \t", "a b c d é"]) for _ in range(20)))
             for i in range(60)]
    df = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.judge(df, labels).collect()}
    for d, t in rows:
        x = got[d]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == brute_counts(t)
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert x["kept"] == (not x["base_failed"])  # one label certifies nothing
    assert got[5000]["base_failed"] and got[5001]["base_failed"]


def test_thresholds_reject_junk_and_bound_false_rejections(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(4000):
        good = i % 4 != 0
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "xx"))
        labels.append((i, int(good), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["kept"] for x in quality.judge(df, lab).collect()}
    assert not any(out[i] for i in range(0, 4000, 4))
    assert sum(not out[i] for i in range(4000) if i % 4) <= 0.02 * 3000
    kept = quality.keep(df.withColumn("kept", F.lit(5)), lab)
    assert kept.columns == ["doc_id", "text", "lang", "kept"] and kept.count() == sum(out.values())


def test_binomial_tail():
    assert quality.tail_below(np.array([0, 1, 2]), 2, 0.5) == pytest.approx([0.25, 0.75, 1.0])


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [4096, 8])
def test_simhash_components(spark, tile, monkeypatch):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(120)) for _ in range(6)]
    rows = [(900, None), (901, ""), (902, " \n"), (None, base[0]), (903, base[1]), (903, base[1])]
    for i in range(200):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice("xyz")
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(simhash, "TILE", tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(0))
    fp = [np.uint64(brute_fingerprint(t)) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if np.bitwise_count(fp[i] ^ fp[j]) <= 4:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((d is None, d or 0, f"{int(fp[i]):016x}", least[find(i)]) for i, (d, _) in enumerate(rows))
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["fingerprint"], x["component_id"])
                 for x in simhash.components(df).collect())
    assert got == want
    kept = simhash.dedupe(df)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(least.values()))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert secrets.scan(df).count() == 0
    assert pii.scan(df).count() == 0 and pii.redact(df).count() == 0
    assert quality.judge(df, labels).count() == 0 and quality.keep(df, labels).count() == 0
    assert simhash.components(df).count() == 0 and simhash.dedupe(df).count() == 0
