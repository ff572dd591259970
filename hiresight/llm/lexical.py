"""Ranked lexical search by NRA (sorted access only, no random access).

Terms are maximal runs of ASCII letters and digits and of all other characters from U+0080 on,
with A-Z lower-cased. One pass over the texts keeps, per document, its length and its counts of
the terms that the items ask for; texts are read once and never shuffled. Document frequencies,
the number of documents and the total length are sums over that small table.

A second pass cuts each task's documents into blocks of bounded size. In a block every term has a
list of (document, impact) sorted by impact, shared by all items that use the term. For an item
the lists of its terms are read in parallel in doubling stretches. Each document has a lower bound
(impacts read so far) and an upper bound (plus, for every list in which it has not been met, the
impact next to be read there). Reading goes on while any document that could still reach the k-th
lower bound, ties included, has an open interval; so membership, ties and the final scores of all
results are settled by sorted reads alone. The k best so far are carried from block to block of a
task, which raises the bound that later blocks must reach. The tasks' winners (at most k rows a
task and item) are merged by a ranked window.

Items are worked off in batches whose terms fit ``QUERY_BYTES``: that bounds what is broadcast.

Defined cases: a null or empty text has no terms, and a document without terms counts in no
statistic and is never found; documents with a null id count in the statistics and are not
returned; repeated documents are documents of their own; an item's terms are those of all rows
with its id, and rows with a null id are ignored; items without a known term have no rows; weights
of zero score nothing; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, stage, text_bytes

QUERY_BYTES = 8 << 20  # terms of one batch of items
BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 1 << 20
CHUNK = 1 << 20  # bytes of a text split into words at a time
FIRST = 64  # entries of each list in the first stretch

_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if c in _KEEP else 0x20 for c in range(256))


def count_terms(raw: bytes, wanted: dict | None = None) -> tuple[int, Counter]:
    """(number of terms, counts of the wanted ones, or of all) of one whole text."""
    raw = raw.translate(_FOLD)
    n, counts, at = 0, Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + CHUNK)
        end = len(raw) if end < 0 else end
        words = raw[at:end].split()
        n += len(words)
        part = Counter(words)
        if wanted is None:
            counts.update(part)
        else:
            for w in part.keys() & wanted.keys():
                counts[w] += part[w]
        at = end
    return n, counts


def query_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of all items; the ids keep their type."""
    def run(batches):
        for b in batches:
            ids, terms = [], []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(count_terms(raw)[1])
                ids += [i] * len(found)
                terms += [w.decode("utf-8", "replace") for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string())],
                                             ["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("raw")) \
        .where("item_id is not null")
    return rows.mapInArrow(run, "item_id long, term string").distinct()


def _counted(docs: DataFrame, known) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; ``known`` is a broadcast dictionary."""
    def run(batches):
        wanted = known.value
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            ns, terms, tfs = [], [], []
            for raw in texts:
                n, c = count_terms(raw.as_py(), wanted)
                ns.append(n)
                terms.append([wanted[w] for w in c])
                tfs.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0")


def resolve(lists: list, ids: np.ndarray, k: int, held: tuple) -> tuple:
    """NRA over one block: the k best of the block and ``held``, as (scores, ids).

    ``lists``: (documents, impacts) per term, impacts falling and positive; ``ids`` of the block's
    documents; ``held``: results with final scores from earlier blocks.
    """
    n = len(ids)
    lower = np.zeros(n, np.int64)
    done, depth = [0] * len(lists), FIRST
    while True:
        total, met = 0, np.zeros(n, np.int64)
        for t, (docs, impacts) in enumerate(lists):
            to = min(depth, len(docs))
            lower[docs[done[t]:to]] += impacts[done[t]:to]
            done[t] = to
            if to < len(docs):  # the next impact bounds everything not yet read there
                total += int(impacts[to])
                met[docs[:to]] += impacts[to]
        upper = lower + (total - met)
        reached = np.concatenate([lower, held[0]])
        kth = int(np.partition(reached, -k)[-k]) if len(reached) >= k else 0
        able = upper >= max(kth, 1)
        if not (able & (upper > lower)).any():
            break
        depth *= 2
    won = np.flatnonzero(able & (lower > 0))
    scores, names = np.concatenate([lower[won], held[0]]), np.concatenate([ids[won], held[1]])
    top = np.lexsort((names, -scores))[:k]
    return scores[top], names[top]


def search_block(ids: np.ndarray, ns: np.ndarray, starts: np.ndarray, terms: np.ndarray,
                 tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, items: dict,
                 k: int, best: dict) -> None:
    """Raises ``best`` (item -> (scores, ids)) by the documents of one block."""
    m = np.array([100 - 90 + (90 * n * n_docs) // n_terms for n in ns.tolist()], np.int64)
    owner = np.repeat(np.arange(len(ids)), np.diff(starts))
    impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
    use = np.flatnonzero(impacts > 0)
    use = use[np.lexsort((-impacts[use], terms[use]))]
    terms, owner, impacts = terms[use], owner[use], impacts[use]
    heads = np.searchsorted(terms, np.arange(len(weights) + 1))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for item, own in items.items():
        lists = [(owner[heads[t]:heads[t + 1]], impacts[heads[t]:heads[t + 1]])
                 for t in own if heads[t] < heads[t + 1]]
        if lists:
            best[item] = resolve(lists, ids, k, best.get(item, empty))


def _found(counts: DataFrame, shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def run(batches):
        items, weights = shared.value
        best: dict = {}
        block: list = []

        def close():
            at = np.concatenate([[0], np.cumsum(np.concatenate([b[2] for b in block]))])
            search_block(*[np.concatenate([b[i] for b in block]) for i in (0, 1)], at,
                         *[np.concatenate([b[i] for b in block]) for i in (3, 4)], weights, n_docs, n_terms, items,
                         k, best)
            block.clear()

        docs = postings = 0
        for b in batches:
            at = 0
            sizes = np.diff(b.column("terms").offsets.to_numpy())
            while at < len(b):  # slices that fit a block
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK_POSTINGS)))
                s = b.slice(at, min(to, at + BLOCK_DOCS) - at)
                block.append((s.column("doc_id").to_numpy(zero_copy_only=False), s.column("n").to_numpy(),
                              sizes[at:at + len(s)], s.column("terms").flatten().to_numpy(),
                              s.column("tfs").flatten().to_numpy()))
                at += len(s)
                docs, postings = docs + len(s), postings + len(block[-1][3])
                if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    close()
                    docs = postings = 0
        if block:
            close()
        rows = [(i, int(d), int(s)) for i, (scores, names) in best.items() for s, d in zip(scores, names)]
        for i in range(0, len(rows), 1 << 16):
            part = list(zip(*rows[i:i + (1 << 16)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], ["item_id", "doc_id", "score"])

    return counts.where("doc_id is not null").mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``docs``: doc_id, text; ``items``: item_id, text. Returns (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    asked = stage(query_terms(items), "lexical-terms")
    # all batches together hold every term once per item; ids, numbers and overhead are 64 bytes a term
    need = asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    n_batches = max(1, -(-need // QUERY_BYTES))
    out = None
    for batch in range(n_batches):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_batches)) == batch)
        items_of: dict = {}
        known: dict = {}
        for r in mine.toLocalIterator():
            items_of.setdefault(r["item_id"], []).append(known.setdefault(r["term"].encode(), len(known)))
        counts = stage(_counted(docs, spark.sparkContext.broadcast(known)), "lexical-counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(known), np.int64)  # one number per asked term
        for t, c in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect():
            df[t] = c
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0
                            for d in df.tolist()], np.int64)
        shared = spark.sparkContext.broadcast(({i: np.array(t) for i, t in items_of.items()}, weights))
        got = _found(counts, shared, n_docs, max(n_terms, 1), k)
        out = got if out is None else out.unionByName(got)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13_SQL = rf"""
with d as (select row_number() over () as r, doc_id, {_TERMS} as t from documents),
c as (select r, doc_id, t, cast(len(t) as bigint) as n from d where len(t) > 0),
s as (select count(*) as nd, cast(sum(n) as bigint) as l from c),
p as (select r, doc_id, n, w, count(*) as tf from (select r, doc_id, n, unnest(t) as w from c) group by all),
f as (select w, count(*) as df from p group by w),
q as (select distinct item_id, w from (select item_id, unnest({_TERMS}) as w from benchmark where item_id is not null)),
scored as (
  select item_id, r, doc_id, cast(sum(cast(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) as bigint)
    * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l))))) as bigint) as score
  from q join p using (w) join f using (w) cross join s where doc_id is not null group by item_id, r, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
           from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
