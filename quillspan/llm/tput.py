"""Ranked lexical search by TPUT (three-phase uniform threshold) over postings kept by term.

``build_lists`` writes the index: for each term its list of (document, occurrences), cut into document segments so
that no list, however common its term, is one row or one task. A segment's lists are made where its documents are
read, so documents are not shuffled. ``search`` then weighs the lists of asked terms (a join on the term with the corpus-wide
weights), orders each by falling score and runs three jobs over them:

1. heads: the first ``k`` documents of each list are scored exactly; the k-th best of an item over all segments is a
   lower bound ``t1`` of its k-th score;
2. uniform threshold: with ``m`` lists, all entries of ``t1 / m`` or more are fetched (a prefix of each list) and
   added up by document. A document without any such entry scores less than ``t1``. The k-th best partial sum
   raises the bound to ``t2``;
3. look-up: documents whose partial sum, with the most that unfetched entries can add, reaches ``t2`` are looked up in
   all lists of their item; the best ``k`` of each segment are merged.

Lists of the same documents meet in one task (segment, block of items), so partial sums never travel; what is
shuffled is the asked terms' lists and, for each item and segment, ``k`` numbers. Items are dealt in blocks of bounded size.

A term is a maximal run of characters outside ASCII that is not a letter or digit; only A-Z are lower-cased. All scores are
64-bit integers. Defined cases: null texts have no terms and do not count as documents; a document without an id
counts in all statistics, ranks after all ids at equal scores and comes back with a null id; rows that share an id
are documents of their own; rows that share an ``item_id`` (or have none) are one item with the terms of all; items
without a term that some document has give no rows; a term of weight 0 adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import claim, materialize, text_slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
NO_ID = (1 << 63) - 1
LISTS = "segment long, term string, docs binary, counts binary, size long, total long"


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.translate(_LOWER)) if text else []


def build_lists(docs: DataFrame, segment_docs: int = 4096) -> DataFrame:
    """The index as a table (segment, term, docs, counts, size, total).

    ``docs`` are int32 places in the segment, ``counts`` int32 occurrences. A segment's row with a null term holds
    its documents: int64 ids, int64 lengths in terms, the number of documents with a term, and all their terms.
    """

    def segment(number: int, ids: list, texts: list) -> pa.RecordBatch:
        words: list[str] = []
        counts: list[int] = []
        held, length = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = terms_of(text)
            c = Counter(found)
            words.extend(c.keys())
            counts.extend(c.values())
            held[i], length[i] = len(c), len(found)
        coded = pa.array(words, pa.string()).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(which, kind="stable")
        doc, count = np.repeat(np.arange(len(texts), dtype=np.int32), held)[by], np.array(counts, dtype=np.int32)[by]
        sizes = np.bincount(which, minlength=len(coded.dictionary)).astype(np.int64)
        ends = np.cumsum(sizes)
        cut = lambda a: [a[s:e].tobytes() for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        own = np.array([NO_ID if x is None else x for x in ids], dtype=np.int64)
        rows = len(sizes) + 1
        return pa.RecordBatch.from_pydict({
            "segment": pa.array(np.full(rows, number, dtype=np.int64)), "term": pa.array([None, *coded.dictionary.to_pylist()], pa.string()),
            "docs": pa.array([own.tobytes(), *cut(doc)], pa.binary()), "counts": pa.array([length.tobytes(), *cut(count)], pa.binary()),
            "size": pa.array([int((length > 0).sum()), *sizes.tolist()], pa.int64()), "total": pa.array([int(length.sum()), *sizes.tolist()], pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tput")
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in text_slices(batches):
            ids += b["doc_id"].to_pylist()
            texts += b["text"].to_pylist()
            held += pc.sum(pc.binary_length(b["text"])).as_py() or 0
            if len(ids) >= segment_docs or held >= 16_000_000:
                yield segment(number, ids, texts)
                number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield segment(number, ids, texts)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LISTS), "tput-lists")


def asked_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit("([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)"), F.lit(1))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


class Segment:
    """One segment's lists of the terms that one block of items asks for, by falling score, and who asks for them."""

    def __init__(self, lists: pa.Table, own: pa.Table, n_docs: int, n_terms: int) -> None:
        self.ids = np.frombuffer(own["docs"][0].as_py(), dtype=np.int64)
        norm = 100 - 50 + (50 * np.frombuffer(own["counts"][0].as_py(), dtype=np.int64) * n_docs) // n_terms
        self.docs, self.scores, self.order = [], [], []
        for d, c, w in zip(lists["docs"].to_pylist(), lists["counts"].to_pylist(), lists["weight"].to_pylist(), strict=True):
            place, tf = np.frombuffer(d, dtype=np.int32), np.frombuffer(c, dtype=np.int32).astype(np.int64)
            s = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[place]))
            by = np.argsort(-s, kind="stable")
            self.docs.append(place[by])
            self.scores.append(s[by])
            self.order.append(np.argsort(by))  # places in a stored list ascend
        self.items: dict[int, list[int]] = {}
        self.bounds: dict[int, tuple[int, int, int]] = {}
        for row, asking in enumerate(lists["asking"].to_pylist()):
            for a in asking:
                self.items.setdefault(a["item"], []).append(row)
                self.bounds[a["item"]] = (a["m"], a["t1"] or 0, a["t2"] or 0)

    def exact(self, rows: list[int], docs: np.ndarray) -> np.ndarray:
        """Full scores of some documents (ascending places), looked up in each list."""
        out = np.zeros(len(docs), dtype=np.int64)
        for r in rows:
            order, listed = self.order[r], self.docs[r]
            if len(docs) * 16 > len(listed):  # a look-up by place is cheaper than a search for so many
                full = np.zeros(len(self.ids), dtype=np.int64)
                full[listed] = self.scores[r]
                out += full[docs]
            else:
                at = np.searchsorted(listed, docs, sorter=order)
                hit = at < len(listed)
                entry = order[at[hit]]
                same = listed[entry] == docs[hit]
                out[np.flatnonzero(hit)[same]] += self.scores[r][entry[same]]
        return out

    def fetched(self, rows: list[int], m: int, t1: int) -> tuple[np.ndarray, np.ndarray]:
        """Partial sums of all documents over entries of ``t1 / m`` or more, and the most that each one's score can be."""
        part, most = np.zeros(len(self.ids), dtype=np.int64), np.zeros(len(self.ids), dtype=np.int64)
        under = max(0, -(-t1 // m) - 1)
        for r in rows:
            s = self.scores[r]
            n = int(np.searchsorted(-s, -under, side="left"))  # s > under
            d, unseen = self.docs[r][:n], min(under, int(s[n]) if n < len(s) else 0)
            part[d] += s[:n]
            most += unseen
            most[d] -= unseen
        return part, part + most

    def best(self, docs: np.ndarray, scores: np.ndarray, k: int, at_least: int = 1) -> tuple[np.ndarray, np.ndarray]:
        keep = scores >= max(1, at_least)
        docs, scores = docs[keep], scores[keep]
        top = np.lexsort((self.ids[docs], -scores))[:k]
        return self.ids[docs[top]], scores[top]


def _phase(which: int, k: int, n_docs: int, n_terms: int):
    def run(lists: pa.Table, own: pa.Table) -> pa.Table:
        claim("tput")
        item, doc, score = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        seg = Segment(lists, own, n_docs, n_terms) if len(lists) else None
        for i, rows in seg.items.items() if seg else ():
            m, t1, t2 = seg.bounds[i]
            if which == 1:
                heads = np.unique(np.concatenate([seg.docs[r][:k] for r in rows]))
                ids, s = seg.best(heads, seg.exact(rows, heads), k)
            else:
                part, most = seg.fetched(rows, m, t1)
                if which == 2:
                    near = np.flatnonzero(part)
                    ids, s = seg.best(near, part[near], k)
                else:
                    near = np.flatnonzero(most >= max(1, t2))
                    ids, s = seg.best(near, seg.exact(rows, near), k, t2)
            item.append(np.full(len(ids), i, dtype=np.int64))
            doc.append(ids)
            score.append(s)
        return pa.table({"item": np.concatenate(item), "doc_id": np.concatenate(doc), "score": np.concatenate(score)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item; every task keeps only its own ``k`` before the shuffle."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(lists: DataFrame, items: DataFrame, k: int = 50, block_items: int = 256) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest positive score for each item."""
    asked = materialize(asked_terms(items), "tput-asked")
    held = lists.filter("term IS NULL").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("n_terms")).first()
    wanted = materialize(lists.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi").select("segment", "term", "docs", "counts", "size"), "tput-wanted")
    weight = F.floor(1000 * F.log(F.lit(2.0 * held.n_docs + 2) / (2 * F.sum("size") + 1))).cast("long")
    weights = wanted.groupBy("term").agg(weight.alias("weight"))
    number = materialize(asked.select("item_id").distinct().select("item_id", F.monotonically_increasing_id().alias("item")), "tput-items")
    blocks = max(1, -(-number.count() // block_items))
    known = asked.join(weights, "term").join(number, asked["item_id"].eqNullSafe(number["item_id"])).select("item", "term", "weight", F.pmod(F.hash("item"), F.lit(blocks)).alias("block"))
    known = materialize(known, "tput-known")
    own = lists.filter("term IS NULL").select("segment", "docs", "counts", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    bounds = known.groupBy("item").agg(F.count("*").alias("m")).withColumns({"t1": F.lit(None).cast("long"), "t2": F.lit(None).cast("long")})

    def phase(which: int) -> DataFrame:
        asking = known.join(bounds, "item").groupBy("term", "block").agg(F.first("weight").alias("weight"), F.collect_list(F.struct("item", "m", "t1", "t2")).alias("asking"))
        rows = wanted.join(asking, "term").select("segment", "block", "docs", "counts", "weight", "asking")
        return rows.groupBy("segment", "block").cogroup(own.groupBy("segment", "block")).applyInArrow(_phase(which, k, held.n_docs, held.n_terms), "item long, doc_id long, score long")

    for which in (1, 2):
        kth = _best(phase(which), k).groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias(f"t{which}"))
        bounds = bounds.drop(f"t{which}").join(materialize(kth, f"tput-bound-{which}"), "item", "left").select("item", "m", "t1", "t2")
    return _best(phase(3), k).join(number, "item").select("item_id", "rank", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "score")
