"""Secret scan: fixed patterns, and a randomness test battery with false-discovery control.

Base spans come from three patterns (assignments, access keys, long hexadecimal runs). The method
looks at every other long token. Its encoding is inferred from its characters (hexadecimal,
base32, alphanumeric, base64); three tests ask whether it looks drawn at random from that
alphabet: chi-squared uniformity of the characters (Wilson-Hilferty normal score), Wald-Wolfowitz
runs above and below the middle of the alphabet, and lag-1 serial correlation. The sum of the
three squared scores has three degrees of freedom and gives the token's randomness p.

The null population is ordinary text written as a long token: every document gives one run of its
own short words and numbers per length class, glued as each encoding would hold them (camel case,
paths, identifiers, folded into the smaller alphabets), the encoding dealt by hash. Within a length
class and encoding, the share of these that look at least as random is a token's empirical p-value,
and Benjamini-Hochberg over the group's tokens keeps the share of false discoveries below ``fdr``.
Where the tests have no power, nothing is accepted. Counts are kept on a grid of ``BINS``
randomness values, so only classes x encodings x bins rows are ever gathered.

Only DataFrame functions; no text is shuffled. Defined cases: a null or empty text has no spans;
repeated rows are scanned separately; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PRE, stage
from .spans import joined, locate, numbered

KINDS = ["assign", "access", "hex", "random"]
#: the fixed base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs, so 20 characters or more
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: alphabets of the inferred encodings, in order of their codes
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alnum": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
MIXED = ALPHABETS["base64"] + "-_"
CLASSES = [20, 24, 32, 40, 64, 128]  # lower ends of the length classes
BINS = 200
#: what the null tokens are made of: whole words and numbers, no parts of longer tokens
ORDINARY = r"(?<![A-Za-z0-9+/_-])(?:[A-Z]?[a-z]{1,15}|[A-Z]{2,15}|[0-9]{1,4})(?![A-Za-z0-9+/_-])"
TESTED = ["hex", "HEX", "base32", "alnum", "base64", "base64url", "mixed"]


def _encoding(m: Column) -> Column:
    return (F.when(m.rlike("^[A-Z]?[a-z]+$"), "lower").when(m.rlike("^[A-Z]+$"), "upper")
            .when(m.rlike("^[0-9a-f]+$"), "hex").when(m.rlike("^[0-9A-F]+$"), "HEX")
            .when(m.rlike("^[A-Z2-7]+$"), "base32").when(m.rlike("^[A-Za-z0-9]+$"), "alnum")
            .when(m.rlike("^[A-Za-z0-9+/]+$"), "base64").when(m.rlike("^[A-Za-z0-9_-]+$"), "base64url")
            .otherwise("mixed"))


def _alphabet(enc: Column) -> Column:
    a = F.lit(MIXED)
    for name, chars in ALPHABETS.items():
        a = F.when(enc == name, F.lit(chars)).otherwise(a)
    return a


#: tail of the chi-squared distribution with three degrees of freedom; erfc by the rational
#: approximation of Abramowitz and Stegun 7.1.26 (fixed values)
_ERFC = ("((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592)"
         " * u * exp(-q / 2)")


def _tested(df: DataFrame) -> DataFrame:
    """tokens: array<struct<s, e, enc, n, a, x>> -> tested: array<struct<s, e, word, enc, cls, bin>>."""
    # the letters, the runs of equal letters once sorted, and L or H for the alphabet's halves
    halves = "case t.enc " + " ".join(
        f"when '{e}' then translate(t.m, '{a}', '{'L' * (len(a) // 2) + 'H' * (len(a) // 2)}')"
        for e, a in (ALPHABETS | {"mixed": MIXED}).items()) + " end"
    # place in the alphabet, less one half, by ASCII number (tokens hold no other characters)
    place = "case t.enc " + " ".join("when '{}' then array({})".format(e, ", ".join(
        f"{a.find(chr(i)) + 0.5}D" for i in range(128))) for e, a in (ALPHABETS | {"mixed": MIXED}).items()) + " end"
    named = F.expr(f"""transform(tokens, t -> struct(t.s as s, t.e as e, t.enc as enc, t.n as n, t.a as a, t.m as m,
        {place} as place, split(t.m, '') as chars))""")
    split = F.expr(f"""transform(tokens, t -> struct(t.s as s, t.e as e, t.enc as enc, t.n as n, t.a as a,
        {halves} as half, transform(t.chars, c -> t.place[ascii(c)]) as x,
        transform(regexp_extract_all(array_join(sort_array(t.chars), ''), '(.)\\\\1*', 0), r -> struct(
            instr(t.a, left(r, 1)) - 0.5D as y, cast(char_length(r) as bigint) as c)) as letters))""")
    sums = F.expr("""transform(tokens, t -> struct(t.s as s, t.e as e, t.enc as enc, t.n as n,
        cast(char_length(t.a) as double) as k, element_at(t.x, 1) + element_at(t.x, -1) as ends,
        cast(char_length(replace(t.half, 'L', '')) as bigint) as high,
        cast(char_length(regexp_replace(t.half, 'L+|H+', 'x')) as bigint) as runs,
        aggregate(t.letters, 0L, (v, l) -> v + if(l.y < 0, 0L, l.c * l.c)) as sq,
        aggregate(t.letters, 0D, (v, l) -> v + l.c * l.y) as a, aggregate(t.letters, 0D, (v, l) -> v + l.c * l.y * l.y) as b,
        aggregate(zip_with(slice(t.x, 2, size(t.x) - 1), slice(t.x, 1, size(t.x) - 1), (y, z) -> y * z), 0D,
            (v, y) -> v + y) as p))""")
    # sums of products about the mean, from those of the codes (exact: codes are half integers)
    serial = F.expr("""transform(tokens, t -> struct(t.s as s, t.e as e, t.enc as enc, t.n as n, t.k as k, t.sq as sq,
        t.high as n1, t.n - t.high as n2, t.runs as runs,
        struct(t.p - t.a * (2 * t.a - t.ends) / t.n + (t.n - 1) * t.a * t.a / (t.n * t.n) as c,
               t.b - t.a * t.a / t.n as v) as r))""")
    scores = F.expr("""transform(tokens, t -> struct(t.s as s, t.e as e, t.enc as enc, t.n as n,
        (pow(greatest(t.k * t.sq / t.n - t.n, 0) / (t.k - 1), 1 / 3D) - (1 - 2 / (9 * (t.k - 1))))
            / sqrt(2 / (9 * (t.k - 1))) as z1,
        if(t.n1 * t.n2 = 0, 99D, (t.runs - (2D * t.n1 * t.n2 / t.n + 1))
            / sqrt(greatest(2D * t.n1 * t.n2 * (2D * t.n1 * t.n2 - t.n) / (1D * t.n * t.n * (t.n - 1)), 0.01D))) as z2,
        if(t.r.v = 0, 99D, (t.r.c / t.r.v + 1D / t.n) * sqrt(t.n)) as z3))""")
    p = F.expr(f"""transform(tokens, t -> struct(t.s as s, t.e as e, t.enc in ('lower', 'upper') as word, t.enc as enc, t.n as n,
        t.z1 * t.z1 + t.z2 * t.z2 + t.z3 * t.z3 as q))""")
    p2 = F.expr("transform(tokens, t -> struct(t.s as s, t.e as e, t.word as word, t.enc as enc, t.n as n, t.q as q, "
                "1 / (1 + 0.3275911D * sqrt(t.q / 2)) as u))")
    erfc = _ERFC.replace("u", "t.u").replace("-q", "-t.q")
    cls = "case " + " ".join(f"when t.n >= {c} then {i}" for i, c in reversed(list(enumerate(CLASSES)))) + " end"
    fin = F.expr(f"""transform(tokens, t -> struct(t.s as s, t.e as e, t.word as word, t.enc as enc, {cls} as cls,
        cast(least(greatest(floor({BINS} * ({erfc} + sqrt(2 * t.q / pi()) * exp(-t.q / 2))), 0), {BINS - 1}) as int)
            as bin))""")
    for step in (named, split, sums, serial, scores, p, p2, fin):
        df = df.withColumn("tokens", step)
    return df


def _null(text: str) -> Column:
    """array<struct<s, e, m, enc, n>>: the document's ordinary words as one token per length class."""
    glued = {
        "hex": "translate(lower(array_join({w}, '')), 'ghijklmnopqrstuvwxyz', '0123456789abcdef0123')",
        "HEX": "translate(upper(array_join({w}, '')), 'GHIJKLMNOPQRSTUVWXYZ', '0123456789ABCDEF0123')",
        "base32": "translate(upper(array_join({w}, '')), '0189', '2345')",
        "alnum": "array_join(transform({w}, y -> concat(upper(substr(y, 1, 1)), substr(y, 2))), '')",
        "base64": "array_join({w}, '/')",
        "base64url": "array_join({w}, '_')",
        "mixed": "array_join(transform({w}, (y, i) -> concat(y, if(i % 2 = 0, '-', '/'))), '')",
    }
    w = "slice(c.w, c.at, c.n)"
    m = "case c.enc " + " ".join(f"when '{k}' then {x.format(w=w)}" for k, x in glued.items()) + " end"
    kinds = ", ".join(f"'{k}'" for k in TESTED)
    low, wide = ", ".join(map(str, CLASSES)), ", ".join(
        str(b - a) for a, b in zip(CLASSES, CLASSES[1:] + [2 * CLASSES[-1]]))
    # length, encoding and first word by hash; a text with too few words gives none of that length
    lengths = (f"transform(array({low}), (l, i) -> struct(l + pmod(xxhash64({text}, i, 'n'), array({wide})[i]) as n,"
               f" array({kinds})[cast(pmod(xxhash64({text}, i, 'e'), {len(TESTED)}) as int)] as enc,"
               f" xxhash64({text}, i) as h))")
    placed = (f"transform({lengths}, c -> struct(cast(c.n as int) as n, c.enc as enc, {PRE}w as w,"
              f" cast(pmod(c.h, greatest(size({PRE}w) - c.n div 3, 1)) as int) + 1 as at))")
    made = f"transform({placed}, c -> struct(0 as s, 0 as e, substr({m}, 1, c.n) as m, c.enc as enc, cast(c.n as bigint) as n))"
    return F.expr(f"filter({made}, c -> char_length(c.m) = c.n)")


def null_tokens(docs: DataFrame) -> DataFrame:
    """(tokens): the tested null tokens of each document."""
    df = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.withColumn(f"{PRE}w", F.regexp_extract_all("text", F.lit(ORDINARY), F.lit(0)))
    df = df.select(_null("text").alias("tokens"))
    return _tested(df.withColumn("tokens", F.transform("tokens", lambda t: t.withField("a", _alphabet(t["enc"])))))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, tokens): base spans and the tested tokens of each document."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = locate(df, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "tokens": TOKEN}).drop("text")
    df = df.withColumn("assign", F.filter("assign", lambda x: F.char_length(
        F.regexp_extract(x["m"], ASSIGN, 2)) >= 6))
    df = df.withColumn("tokens", F.transform("tokens", lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _encoding(x["m"]).alias("enc"),
        F.char_length(x["m"]).cast("long").alias("n"))))
    df = df.withColumn("tokens", F.expr(
        "transform(tokens, t -> struct(t.s as s, t.e as e, t.m as m, t.enc as enc, t.n as n, ''  as a))"))
    df = df.withColumn("tokens", F.transform("tokens", lambda t: t.withField("a", _alphabet(t["enc"]))))
    bare = {k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS[:3]}
    return _tested(df).withColumns(bare)


def cutoffs(found: DataFrame, null: DataFrame, fdr: float) -> DataFrame:
    """(cls, enc, cut): the lowest randomness bin that a length class accepts of an encoding. At
    most classes x encodings x BINS rows are gathered from the documents."""
    tokens = found.select(F.explode("tokens").alias("t")).where("not t.word").select("t.*", F.lit(1).alias("own"))
    made = null.select(F.explode("tokens").alias("t")).select("t.*", F.lit(0).alias("own"))
    hist = tokens.unionByName(made).groupBy("cls", "enc", "bin").agg(
        F.sum(1 - F.col("own")).alias("words"), F.sum("own").alias("tokens"))
    down = Window.partitionBy("cls", "enc").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("cls", "enc")
    tail = hist.select(
        "cls", "enc", "bin", F.sum("tokens").over(down).alias("passed"), F.sum("tokens").over(every).alias("m"),
        ((F.sum("words").over(down) + 1) / (F.sum("words").over(every) + 1)).alias("p0"))
    ok = (F.col("passed") > 0) & (F.col("m") * F.col("p0") <= fdr * F.col("passed"))
    return tail.where(ok).groupBy("cls", "enc").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, fdr: float = 0.1) -> DataFrame:
    """One row per document: base counts and spans, and all spans with the random tokens."""
    found = stage(candidates(docs), "secret-candidates")
    cut = {(r["cls"], r["enc"]): r["cut"] for r in cutoffs(found, null_tokens(docs), fdr).collect()}  # one row a group
    base = F.concat(numbered("assign", 0), numbered("access", 1), numbered("hex", 2))

    def passes(t):
        limit = F.lit(BINS)
        for (cls, enc), c in cut.items():
            limit = F.when((t["cls"] == cls) & (t["enc"] == enc), F.lit(c)).otherwise(limit)
        covered = F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))
        return ~t["word"] & (t["bin"] >= limit) & ~covered

    out = found.withColumn("base", base)
    out = out.withColumn("added", F.filter("tokens", passes))
    every = F.concat("base", numbered("added", 3))
    return out.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(joined(F.col("base"), KINDS, True).cast("binary"), 256).alias("base_sha256"),
        joined(every, KINDS, True).alias("spans"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
