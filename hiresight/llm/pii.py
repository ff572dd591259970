"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Base spans come from four patterns with their checks (octets, Luhn, digit counts). Generators
propose wider, overlapping candidates of the same kinds: addresses with a spelled-out or spaced
at sign, dotted number groups, long digit chains, telephone-like numbers without a plus. Context
features (cue words and characters around the span) and format features that don't hold the base
checks (groups and separators of the candidate written the usual way) go into gradient-boosted
trees, one small model per kind. They learn from the candidates whose nature is known: those equal
to a base span against those known to be something else (``_other``: Luhn failures, impossible
octets, dates, number tables, prose). All other candidates, such as spelled-out addresses and
numbers without a plus, carry no label and are the ones that may be added. Training takes a documented bound of ``TRAIN`` candidates per kind, drawn by hash, half of either
class; the threshold of a kind is the lowest score at which at most ``alpha`` of all its refused
candidates outside the training part pass (of none, everything passes). A kind whose training part
lacks a class scores everything 0, so it adds only where nothing was refused. Trees become one SQL expression, so scoring needs no
exploding, shuffling or Python; a candidate above its threshold that overlaps no base span is
added, base spans always stay.

Defined cases: a null or empty text has no spans; repeated rows are scanned separately; an empty
table gives an empty result; other columns are ignored by ``scan`` and passed through by
``redact``, which leaves a null text null.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quantiles import bucket
from .common import PRE, stage
from .spans import joined, locate, numbered

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. Where a run would be tried again from each of its characters, a match may
# only start after a character outside it or after the match before: same matches, linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"  # whole chains, those of 13 digits or more
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: the wider generators
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?"
             r"[A-Za-z0-9-]++(?:(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++"
             r"|(?:\x20?\.\x20?[A-Za-z0-9-]++)++)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\x20?\.\x20?[0-9]++){3}+",
    "card": r"[0-9](?:[\x20.-]?+[0-9]){11,}+",
    "phone": r"(?:\+|\(|\b00)?[0-9][\x20()./0-9-]{6,40}[0-9]",
}
CONTEXT = 24
TRAIN = 20_000
ROUNDS, DEPTH = 10, 3
FEATURES = ["letters", "marks", "groups", "longest", "cue_mail", "cue_phone", "cue_card", "cue_net",
            "glued_before", "glued_after"]


def _luhn(m: Column) -> Column:
    digits = F.reverse(F.filter(F.split(F.regexp_replace(m, "[^0-9]", ""), ""), lambda c: c != ""))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(m: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(m, r"\x20", ""), r"\."), lambda x: (F.ltrim(x, F.lit("0")) == "")
                    | F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int") <= 255, F.lit(False)))


def _digits(m: Column) -> Column:
    return F.char_length(F.regexp_replace(m, "[^0-9]", ""))


def _valid(kind: str):
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: _octets(x["m"]),
        "card": lambda x: _digits(x["m"]).between(13, 19) & _luhn(x["m"]),
        "phone": lambda x: _digits(x["m"]).between(9, 15),
    }[kind]


def _other(kind: str, m: Column) -> Column:
    """Whether a wide candidate is known not to be of its kind."""
    return {
        # prose: a bare "at" before plain dots, or the end of a sentence
        "email": ~m.rlike(r"@|\(at\)|\[at\]|\(dot\)|\[dot\]") | m.rlike(r"[^ ]\. ") | ~m.rlike("[A-Za-z]{2,}$"),
        "ip": ~_octets(m) | m.rlike(r"[0-9]\. "),
        "card": ~_digits(m).between(13, 19) | ~_luhn(m) | m.rlike(r"^[0-9]+\.[0-9]+$"),
        # dates, ranges of years, thousands, tables of small or many numbers
        "phone": ~_digits(m).between(9, 15) | m.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])")
        | m.rlike(r"(?<![0-9])[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])")
        | m.rlike(r"^(?:(?:19|20)[0-9]{2}[^0-9]+)+(?:19|20)[0-9]{2}$") | m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$")
        | ~m.rlike("[0-9]{2}") | m.rlike("^[^0-9]*(?:[0-9]+[^0-9]+){7}"),
    }[kind]


def _usual(kind: str, m: Column) -> Column:
    """The candidate as a base span would be written, without what only base spans have."""
    if kind == "email":
        at = F.regexp_replace(m, r"\x20?(?:\(at\)|\[at\]|@)\x20?|\x20at\x20", "@")
        return F.regexp_replace(F.regexp_replace(at, r"\(dot\)|\[dot\]", "."), r"\x20", "")
    if kind == "phone":
        return F.regexp_replace(m, r"^(?:\+|00)\x20?", "")
    return F.regexp_replace(m, r"\x20?\.\x20?", ".") if kind == "ip" else F.regexp_replace(m, r"[\x20.-]", " ")


def _features(kind: str, c: Column, before: Column, after: Column) -> list[Column]:
    m = _usual(kind, c["m"])
    cue = lambda words: F.lower(before).rlike(words).cast("double")
    parts = F.filter(F.split(m, "[^0-9]+"), lambda x: x != "")
    return [x.cast("double") for x in (
        F.char_length(F.regexp_replace(m, "[^A-Za-z]", "")), F.char_length(F.regexp_replace(m, "[^.()/@-]", "")),
        F.size(parts), F.coalesce(F.array_max(F.transform(parts, F.char_length)), F.lit(0)),
        cue("mail|contact|write|@"), cue("tel|phone|call|fax|mobile|whatsapp"),
        cue("card|visa|iban|account|payment"), cue(r"\bip\b|host|server|address"),
        before.rlike(r"[\p{L}\p{N}]$"), after.rlike(r"^[\p{L}\p{N}]"))]


def candidates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Base spans per kind (``email`` ...) and candidates (``c_email`` ...: s, e, known, over,
    other, f)."""
    keep = keep or ["doc_id"]
    df = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(f"{PRE}text"))
    t = f"{PRE}text"
    df = locate(df, t, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
                | {f"c_{k}": r for k, r in WIDE.items()})
    df = df.withColumns({k: F.transform(F.filter(k, _valid(k)), lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"))) for k in KINDS})

    def described(k):
        def one(c):
            before = F.substring(F.col(t), F.greatest(c["s"] - CONTEXT + 1, F.lit(1)),
                                 F.least(c["s"], F.lit(CONTEXT)))
            after = F.substring(F.col(t), c["e"] + 1, F.lit(1))
            # one candidate is the base span, overlaps without being it, is known to be something
            # else (by itself, or as it covers a base span of another kind), or may be added
            same = F.exists(k, lambda b: (b["s"] == c["s"]) & (b["e"] == c["e"]))
            over = F.exists(k, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
            other = _other(k, c["m"])
            for kind in KINDS:
                if kind != k:
                    other = other | F.exists(kind, lambda b: (b["s"] >= c["s"]) & (b["e"] <= c["e"]))
            return F.struct(c["s"].alias("s"), c["e"].alias("e"), same.alias("known"), over.alias("over"),
                            other.alias("other"), F.array(*_features(k, c, before, after)).alias("f"))
        return F.transform(f"c_{k}", one)

    return df.withColumns({f"c_{k}": described(k) for k in KINDS}).drop(t)


def _tree_sql(debug: str, var: str) -> str:
    """A regression tree's debug text as a CASE expression over the feature array."""
    lines = [x.strip() for x in debug.splitlines()[1:] if x.strip()]

    def node(i):
        if m := re.match(r"Predict: (\S+)", lines[i]):
            return f"{float(m[1])!r}D", i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        if not m:
            raise ValueError(f"unexpected tree node: {lines[i]}")
        low, i = node(i + 1)
        high, i = node(i + 1)  # the line between is Else
        return f"if({var}.f[{m[1]}] <= {float(m[2])!r}D, {low}, {high})", i

    return node(0)[0]


def _exact_cuts(scores: DataFrame, alpha: float) -> dict[str, float]:
    """kind -> the lowest of its scores that at most ``alpha`` of them exceed. Scores are counted
    per bucket; only the bucket that holds the place is ordered."""
    down = Window.partitionBy("kind").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    counted = scores.groupBy("kind", bucket(F.col("score")).alias("b"), "score").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("kind", "b").agg(F.sum("n").alias("t"))  # some thousand buckets at most
    hit = total.select("kind", "b", (F.sum("t").over(down) - F.col("t")).alias("above"), "t",
                       F.floor(F.sum("t").over(Window.partitionBy("kind")) * F.lit(alpha)).alias("may")) \
        .where("above <= may and may < above + t")
    inside = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    got = counted.join(hit, ["kind", "b"]).withColumn("upto", F.col("above") + F.sum("n").over(inside)) \
        .where("upto - n <= may and may < upto").select("kind", "score").collect()  # one row a kind
    return {r["kind"]: r["score"] for r in got}


def fit(found: DataFrame, alpha: float) -> dict[str, tuple[str, float]]:
    """kind -> (score expression over candidate x, threshold). A kind without any refused candidate
    outside the training part has nothing to set a threshold by and adds no spans."""
    rows = None
    for k in KINDS:
        c = found.select(F.lit(k).alias("kind"), F.explode(f"c_{k}").alias("x")).select("kind", "x")
        rows = c if rows is None else rows.union(c)
    rows = rows.where("x.known or (x.other and not x.over)").withColumn("y", F.col("x.known").cast("double")) \
        .withColumn("u", F.pmod(F.xxhash64("kind", "x.f", "x.s", "x.e"), F.lit(1 << 20)) / float(1 << 20))
    n = {(r["kind"], r["y"]): r["n"] for r in rows.groupBy("kind", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)  # at most half of a class trains
    for (k, y), m in n.items():
        share = F.when((F.col("kind") == k) & (F.col("y") == y), min(0.5, TRAIN / 2 / m)).otherwise(share)
    rows = rows.withColumn("train", F.col("u") < share)
    own = stage(rows.where("train").select("kind", "y", "x.f"), "pii-sample")
    seen = {(r["kind"], r["y"]) for r in own.select("kind", "y").distinct().collect()}
    scores = {}
    for k in KINDS:
        if not {(k, 0.0), (k, 1.0)} <= seen:
            scores[k] = "0D"
            continue
        cols = [F.col("f")[i].alias(x) for i, x in enumerate(FEATURES)]
        train = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(
            own.where(F.col("kind") == k).select("y", *cols)).select("v", "y").coalesce(4)
        model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=ROUNDS, maxDepth=DEPTH, seed=7).fit(train)
        scores[k] = " + ".join(f"{w!r}D * {_tree_sql(t.toDebugString, 'x')}"
                               for w, t in zip(model.treeWeights, model.trees))
    score = "case kind " + " ".join(f"when '{k}' then {x}" for k, x in scores.items()) + " end"
    cuts = _exact_cuts(rows.where("not train and y = 0").select("kind", F.expr(score).alias("score")), alpha)
    return {k: (x, cuts.get(k, 1e300)) for k, x in scores.items()}


def _spans(found: DataFrame, models: dict) -> DataFrame:
    """Adds base and every: array<struct<k, s, e>>."""
    df = found.withColumn("base", F.concat(*[numbered(k, i) for i, k in enumerate(KINDS)]))
    for k in KINDS:
        if k in models:
            score, cut = models[k]
            df = df.withColumn(f"a_{k}", F.expr(f"filter(c_{k}, x -> not x.other and ({score}) > {cut!r}D)"))
        else:
            df = df.withColumn(f"a_{k}", F.expr(f"slice(c_{k}, 1, 0)"))
        df = df.withColumn(f"a_{k}", F.filter(f"a_{k}", lambda c: ~F.exists(
            "base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))))
    return df.withColumn("every", F.concat("base", *[numbered(f"a_{k}", i) for i, k in enumerate(KINDS)]))


def scan(docs: DataFrame, alpha: float = 0.002) -> DataFrame:
    """One row per document: base counts and spans, and all spans."""
    found = stage(candidates(docs), "pii-candidates")
    out = _spans(found, fit(found, alpha))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(joined(F.col("base"), KINDS, False).cast("binary"), 256).alias("base_sha256"),
                      joined(F.col("every"), KINDS, False).alias("spans"))


def redact(docs: DataFrame, alpha: float = 0.002) -> DataFrame:
    """The documents with every span replaced by <KIND>; overlapping spans become one, named
    after the first. Other columns are unchanged."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{PRE}row"), "text")
    found = stage(candidates(row, [f"{PRE}row"]), "pii-candidates")  # the rows ride along: found once
    df = _spans(found, fit(found, alpha)).withColumn(
        f"{PRE}t", F.coalesce(F.col(f"{PRE}row.text").cast("string"), F.lit("")))
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    order = F.array_sort(F.transform("every", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.col(f"{PRE}t")

    def put(acc, x):
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]),
                                             F.element_at(tags, x["k"] + 1)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    df = df.withColumn(f"{PRE}r", F.aggregate(order, zero, put))
    new = F.concat(F.array_join(F.col(f"{PRE}r")["out"], ""),
                   F.substring(text, F.col(f"{PRE}r")["at"] + 1, F.char_length(text)))
    new = F.when(F.col(f"{PRE}row.text").isNull(), F.lit(None)).when(F.size("every") == 0, text).otherwise(new)
    return df.withColumn(f"{PRE}new", new).select(*[
        F.col(f"{PRE}new").alias(c) if c == "text" else F.col(f"{PRE}row").getField(c).alias(c)
        for c in docs.columns])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
