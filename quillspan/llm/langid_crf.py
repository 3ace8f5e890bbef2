"""Language identification of words and documents by a linear-chain conditional random field.

Each word (a white-space chunk with a letter) has indicator features: its prefixes and suffixes of
one to three letters, its bigrams and trigrams with word boundaries, and membership in each
language's lexicon of frequent words. Feature weights and transition weights are learned together by
maximising the conditional likelihood of word labels; training sequences are spliced from one to three
languages, so transitions learn how rarely text switches. Labels of words are their forward-backward
marginals; a document's language is the label with the largest mean marginal, which is its score.

Learning uses a bounded sample of whole texts (``per_lang`` documents of each language, none longer than ``max_chars``,
``sample_chars`` characters together), of which 2,400 windows of 48 words train the weights; predictions use every word of every text.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the language
that sorts first; a table without labelled text predicts ``und`` for all, and nothing but texts without a letter is then
rejected; repeated rows get one row each; ``identify`` gives its own columns only, ``predict`` puts its own in place of input
columns of the same names, ``reject_unknown`` leaves all columns as they are.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import claim, crc_bucket, fresh, text_slices

CHUNK = 128


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def features(word: str) -> list[str]:
    """Affixes and n-grams of a lower-case word of letters."""
    w = f"^{word}$"
    n = len(w)
    out = [w[i : i + 2] for i in range(n - 1)] + [w[i : i + 3] for i in range(n - 2)]
    for k in (1, 2, 3):
        if k <= n - 2:
            out.append(f"<{word[:k]}")
            out.append(f">{word[-k:]}")
    return out


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, code of each chunk in order, chunks in each text), lower-cased."""
    cut = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t or "" for t in texts], type=pa.large_string())))
    coded = pc.list_flatten(cut).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class CrfModel:
    labels: list[str]
    index: dict[str, int]
    lexicon: dict[str, list[int]]
    weights: np.ndarray
    transitions: np.ndarray
    initial: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat feature rows of the words, and how many each has."""
        get, flat, counts = self.index.get, [], []
        for w in words:
            got = [r for r in map(get, features(w)) if r is not None] + self.lexicon.get(w, [])
            flat += got
            counts.append(len(got))
        return np.array(flat, dtype=np.int64), np.array(counts, dtype=np.int64)

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, counts = self.rows(words)
        total = np.concatenate((np.zeros((1, len(self.labels))), np.cumsum(self.weights[flat], axis=0)))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


class EmissionCache:
    """Emission scores of distinct chunks in a Python worker; emptied when over ``cap`` chunks."""

    def __init__(self, model: CrfModel, cap: int = 250_000):
        self.model, self.cap = model, cap
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.labels)), dtype=np.float32)
        self.word = np.zeros(1024, dtype=bool)

    def lookup(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(emission row of each chunk, whether it has a letter)."""
        if len(self.row) > self.cap:
            self.clear()
        new = [c for c in chunks if c not in self.row]
        if new:
            first, last = len(self.row), len(self.row) + len(new)
            if last > len(self.table):
                grow = max(last, 2 * len(self.table)) - len(self.table)
                self.table = np.concatenate((self.table, np.zeros((grow, self.table.shape[1]), dtype=np.float32)))
                self.word = np.concatenate((self.word, np.zeros(grow, dtype=bool)))
            bare = [letters(c) for c in new]
            for s in range(0, len(bare), 20_000):  # bounds the memory of their features
                self.table[first + s : first + s + 20_000][: len(bare) - s] = self.model.emissions(bare[s : s + 20_000])
            self.word[first:last] = [bool(b) for b in bare]
            self.row.update(zip(new, range(first, last)))
        rows = np.fromiter(map(self.row.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        return self.table[rows], self.word[rows]


def marginals(emit: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, initial: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Forward-backward label marginals of many sequences laid end to end (all sizes > 0).

    Sequences are cut into chunks that advance together. A first pass takes each chunk's transfer
    matrix; these give the forward and backward messages at the chunks' edges, sequence by sequence;
    a second pass runs inside all chunks. The result is that of the whole sequences.
    """
    labels = emit.shape[1]
    e = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
    move = np.exp(transitions - transitions.max())
    per = -(-sizes // chunk)
    seq = np.repeat(np.arange(len(sizes)), per)
    order = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    start = np.repeat(np.cumsum(sizes) - sizes, per) + order * chunk
    n = np.minimum(chunk, np.repeat(sizes, per) - order * chunk)
    by = np.argsort(-n, kind="stable")
    start, n, opens = start[by], n[by], (order[by] == 0)[:, None]
    live = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]))]  # chunks with more than t words
    # transfer matrix of each chunk: product of (move x diag(e)) over its words
    whole = np.broadcast_to(np.eye(labels), (len(n), labels, labels)).copy()
    if per.max() > 1:
        for t, a in enumerate(live):
            moved = whole[:a] @ move
            if t == 0:  # a sequence's first word is not reached by a transition
                moved = np.where(opens[:a, :, None], whole[:a], moved)
            step = moved * e[start[:a] + t][:, None, :]
            whole[:a] = step / step.max(axis=(1, 2), keepdims=True)
    back = np.empty(len(by), dtype=np.int64)
    back[by] = np.arange(len(by))
    ahead, behind = np.empty((len(n), labels)), np.ones((len(n), labels))
    first_chunk = np.cumsum(per) - per
    begin = np.exp(initial - initial.max())
    for k in range(int(per.max())):
        s = np.flatnonzero(per > k)
        c = back[first_chunk[s] + k]
        if k == 0:
            ahead[c] = begin
        else:
            p = back[first_chunk[s] + k - 1]
            v = np.einsum("ci,cij->cj", ahead[p], whole[p])
            ahead[c] = v / np.abs(v).max(axis=1, keepdims=True)
    for k in range(int(per.max()) - 2, -1, -1):
        s = np.flatnonzero(per > k + 1)
        c, q = back[first_chunk[s] + k], back[first_chunk[s] + k + 1]
        v = np.einsum("cij,cj->ci", whole[q], behind[q])
        behind[c] = v / v.max(axis=1, keepdims=True)
    out = np.empty_like(e)
    alpha = ahead
    for t, a in enumerate(live):
        v = (np.where(opens[:a], alpha[:a], alpha[:a] @ move) if t == 0 else alpha[:a] @ move) * e[start[:a] + t]
        alpha[:a] = v / v.sum(axis=1, keepdims=True)
        out[start[:a] + t] = alpha[:a]
    beta = behind
    for t in range(len(live) - 1, -1, -1):
        at = start[: live[t]] + t
        g = out[at] * beta[: live[t]]
        out[at] = g / g.sum(axis=1, keepdims=True)
        v = (e[at] * beta[: live[t]]) @ move.T
        beta[: live[t]] = v / v.sum(axis=1, keepdims=True)
    return out


def _sequences(by_lang: list[list[list[str]]], count: int, length: int, rng: np.random.Generator) -> tuple[list[list[str]], np.ndarray]:
    """Spliced training sequences: half of one language, half of two or three."""
    seqs, gold = [], np.zeros((count, length), dtype=np.int64)
    for i in range(count):
        parts = 1 if i % 2 == 0 or len(by_lang) == 1 else int(rng.integers(2, 4))
        cuts = [0, *sorted(rng.choice(np.arange(1, length), parts - 1, replace=False).tolist()), length]
        words: list[str] = []
        last = i // 2 % len(by_lang) if parts == 1 else -1
        for a, b in zip(cuts, cuts[1:]):
            lang = last if parts == 1 else int(rng.choice([x for x in range(len(by_lang)) if x != last]))
            last = lang
            while len(words) < b:
                doc = by_lang[lang][int(rng.integers(len(by_lang[lang])))]
                at = int(rng.integers(max(1, len(doc) - (b - len(words)) + 1)))
                words += doc[at : at + b - len(words)]
            gold[i, a:b] = lang
        seqs.append(words)
    return seqs, gold


def train(samples: list[tuple[str, str]], sequences: int = 2400, length: int = 48, epochs: int = 6, rate: float = 0.08, l2: float = 1e-5, lexicon_words: int = 400, seed: int = 7) -> CrfModel | None:
    """Fit the CRF to (language, text) samples by Adam on the exact gradient of the log-likelihood."""
    docs: dict[str, list[list[str]]] = {}
    for lang, text in samples:
        words = [b for b in map(letters, text.lower().split()) if b]
        if words:
            docs.setdefault(lang, []).append(words)
    labels = sorted(docs)
    if not labels:
        return None
    by_lang = [docs[x] for x in labels]
    counts = [Counter(w for d in ds for w in d) for ds in by_lang]
    seen = Counter(f for c in counts for w in c for f in features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    lexicon: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicon.setdefault(w, []).append(len(index) + i)
    rows, k = len(index) + len(labels), len(labels)
    model = CrfModel(labels, index, lexicon, np.zeros((rows, k)), np.zeros((k, k)), np.zeros(k))
    rng = np.random.default_rng(seed)
    seqs, gold = _sequences(by_lang, sequences, length, rng)
    vocab = {w: i for i, w in enumerate(sorted({w for s in seqs for w in s}))}
    flat, size = model.rows(list(vocab))
    begin = np.cumsum(size) - size
    codes = np.array([[vocab[w] for w in s] for s in seqs])
    params = [model.weights, model.transitions, model.initial]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(seqs)), max(1, len(seqs) // 200)):
            word = codes[batch].ravel()
            pick = np.repeat(begin[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(int(size[word].sum()))
            feature = flat[pick]
            total = np.concatenate((np.zeros((1, k)), np.cumsum(model.weights[feature], axis=0)))
            ends = np.cumsum(size[word])
            emit = (total[ends] - total[ends - size[word]]).reshape(len(batch), length, k)
            # forward-backward, all sequences of the batch in step
            e = np.exp(emit - emit.max(axis=2, keepdims=True))
            move = np.exp(model.transitions)
            alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.empty((length, len(batch), 1))
            a = np.exp(model.initial) * e[:, 0]
            for s in range(length):
                a = a if s == 0 else alpha[:, s - 1] @ move * e[:, s]
                norm[s] = a.sum(axis=1, keepdims=True)
                alpha[:, s] = a / norm[s]
            for s in range(length - 2, -1, -1):
                beta[:, s] = (e[:, s + 1] * beta[:, s + 1]) @ move.T / norm[s + 1]
            gamma = alpha * beta
            gamma /= gamma.sum(axis=2, keepdims=True)
            pair = np.einsum("nsi,ij,nsj->ij", alpha[:, :-1], move, e[:, 1:] * beta[:, 1:] / norm[1:].transpose(1, 0, 2))
            truth = np.eye(k)[gold[batch]]
            step = (gamma - truth).reshape(-1, k) / len(batch)
            spread = np.repeat(step, size[word], axis=0)
            grad = np.stack([np.bincount(feature, weights=spread[:, j], minlength=rows) for j in range(k)], axis=1)
            grads = [grad + l2 * model.weights, (pair - np.einsum("nsi,nsj->ij", truth[:, :-1], truth[:, 1:])) / len(batch), (gamma[:, 0] - truth[:, 0]).mean(axis=0)]
            t += 1
            for p, g, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                p -= rate * mm / (1 - 0.9**t) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-8)
    return model


def fit(docs: DataFrame, usable: Column, per_lang: int = 400, max_chars: int = 200_000, sample_chars: int = 100_000_000) -> CrfModel | None:
    """Train on at most ``per_lang`` documents of each language among the ``usable`` rows, chosen by a hash of the id.

    Every language is learned. The sample that comes to the driver has about ``sample_chars`` characters at most: it is shared out by
    language, and a language whose documents are long gives fewer of them (one at least). From it ``train`` takes 2,400 windows of 48 words.
    """
    known = docs.filter(usable & F.col("lang").isNotNull() & (F.length("text") <= max_chars))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("mean")).collect()  # one row a language
    if not counts:
        return None
    share = sample_chars / len(counts)
    most = {r["lang"]: max(1, min(per_lang, int(share / (1.5 * max(r["mean"], 1.0))))) for r in counts}
    below = known.sparkSession.createDataFrame([(r["lang"], int((1 << 20) * min(1.0, 1.5 * most[r["lang"]] / r["n"] + min(20, most[r["lang"]]) / r["n"]))) for r in counts], "lang string, below int")
    rows = known.join(F.broadcast(below), "lang").filter(place < F.col("below")).select("lang", place.alias("place"), "doc_id", "text").collect()
    taken: Counter = Counter()
    sample = []
    for r in sorted(rows, key=lambda r: (r.place, r.doc_id, r.text)):
        if taken[r.lang] < most[r.lang]:
            taken[r.lang] += 1
            sample.append((r.lang, r.text))
    return train(sample)


_CACHES: dict[str, EmissionCache] = {}


def label_texts(texts: list[str | None], model: CrfModel) -> Iterator[tuple[str, float, int, int, float]]:
    """(language, score, words, switches, certainty) of every text; certainty is the mean of the words' largest marginals."""
    claim("langid", _CACHES.clear)
    chunks, codes, counts = words_of(texts)
    if model.key not in _CACHES:
        _CACHES.clear()
        _CACHES[model.key] = EmissionCache(model)
    table, is_word = _CACHES[model.key].lookup(chunks)
    keep = is_word[codes] if len(codes) else np.zeros(0, dtype=bool)
    doc = np.repeat(np.arange(len(texts)), counts)[keep]
    sizes = np.bincount(doc, minlength=len(texts))
    some = sizes > 0
    if some.any():
        gamma = marginals(table[codes[keep]], sizes[some], model.transitions, model.initial)
        share = np.stack([np.bincount(doc, weights=gamma[:, j], minlength=len(texts)) for j in range(gamma.shape[1])], axis=1) / np.maximum(sizes, 1)[:, None]
        best = gamma.argmax(axis=1)
        turn = np.bincount(doc[1:][(best[1:] != best[:-1]) & (doc[1:] == doc[:-1])], minlength=len(texts))
        top = share.argmax(axis=1)
        sure = np.bincount(doc, weights=gamma.max(axis=1), minlength=len(texts)) / np.maximum(sizes, 1)
    for i, n in enumerate(sizes.tolist()):
        yield (model.labels[top[i]], min(1.0, float(share[i, top[i]])), n, int(turn[i]), min(1.0, float(sure[i]))) if n else ("und", 0.0, 0, 0, 0.0)


def label_words(text: str, model: CrfModel) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of every word of one text."""
    words = [c for c in text.split() if letters(c.lower())]
    if not words:
        return []
    gamma = marginals(model.emissions([letters(w.lower()) for w in words]), np.array([len(words)]), model.transitions, model.initial)
    return [(w, model.labels[j], float(p)) for w, j, p in zip(words, gamma.argmax(axis=1), gamma.max(axis=1))]


_PREDICTED = StructType().add("lang_pred", "string").add("score", "double").add("n_words", "long").add("n_switches", "long").add("certainty", "double")


def predict(docs: DataFrame, model: CrfModel | None, names: list[str] | None = None) -> DataFrame:
    """Append (lang_pred, score, n_words, n_switches, certainty), or columns of these ``names``, to the documents."""
    names = names or _PREDICTED.names
    docs = docs.select([c for c in docs.columns if c.lower() not in names])
    if model is None:
        return docs.withColumns({n: F.lit(v).cast(f.dataType) for n, v, f in zip(names, ("und", 0.0, 0, 0, 0.0), _PREDICTED.fields)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
        for part in text_slices(batches, most=1_000_000):  # by bytes: long texts come in small slices
            found = zip(*label_texts(part["text"].to_pylist(), model))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(found, kinds))], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, StructType(docs.schema.fields + [StructField(n, f.dataType) for n, f in zip(names, _PREDICTED.fields)]))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ...): learned from the rows that are not held out."""
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(True))
    model = fit(docs, ~held)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def reject_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Drop the documents that are ``und`` or whose words have a mean certainty under ``least``; columns stay.

    Not the share of one language decides, so clean text that switches between languages stays.
    """
    model = fit(docs, F.coalesce(crc_bucket(F.col("doc_id"), 4) != 2, F.lit(False)))
    if model is None:
        return docs.filter(F.lower("text") != F.upper("text"))
    names = [fresh(n, docs.columns) for n in _PREDICTED.names]
    return predict(docs, model, names).filter((F.col(names[0]) != "und") & (F.col(names[4]) >= least)).select(docs.columns)
