"""SentencePiece encoding and decoding as a relational lattice.

The public model is a BPE model, so the best path is not the one of the largest sum of piece scores: it is the one path
that merging would build. It is still the path of a largest score sum, with other scores. Merging takes the
possible merge of the lowest rank, the leftmost of equal ones, again and again; in this vocabulary every piece ranks after
its parts (checked when the model is loaded), so merges are made in ascending (rank, place), and the path that merging builds
is the one whose sorted list of merges comes first, a longer list before its own beginnings. Give the j-th of a word's
possible merges the score 2 ** -j, and an edge the sum over its merge tree: then that path has the largest sum, and
a Viterbi fold finds it.

Steps: the corpus is cut into segments at places that no piece crosses (a pair of characters that stands in no piece, white
space, characters outside the vocabulary); distinct segments are words of the lattice; explode substrings of up to the
longest piece; equi-join to the piece table (32,000 rows, a fixed bound, broadcast); group the edges by word; fold over
the edges with a higher-order aggregate. Up to 63 merges fit a number; words of more possible merges are folded with sorted lists of
merges in place of numbers, where tokens that all open paths share are put out and forgotten, so a step looks at a bounded window.

Encoded words go back to the documents in slices of a few megabytes of text: words of the ``dictionary`` most frequent ones
come from a bounded broadcast, the others by a join on the word, once for each slice; slices travel compressed.

Defined cases: a null text is empty and has no ids; runs of blanks, bytes outside the vocabulary and texts of
one very long word follow the library exactly; repeated rows give equal rows; an empty table no rows.
"""

from __future__ import annotations

import heapq
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, drop_path, materialize, release, shuffle_width, shuffles_dropped, text_slices

BLANK = "▁"
NEVER = 2**31 - 1
#: Bits of a place in a word (beside a rank), of a piece's length and of its id. An edge leaves 39 bits to its end.
_PLACE, _LENGTH, _ID = 40, 8, 16
_LONGEST = (1 << _LENGTH) - 1


def merge_tree(chars: str, ranks: dict[str, int]) -> list:
    """Merge the characters as BPE does; the trees of the pieces that remain: (text, left, right)."""
    parts: list = [(c, None, None) for c in chars]
    while len(parts) > 1:
        best = min(((ranks.get(a[0] + b[0], NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
        if best[0] == NEVER:
            break
        i = best[1]
        parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1])]
    return parts


class PieceTable:
    """The model's pieces, the merge tree of each, and the pairs of characters that pieces hold."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        ranks = {p: int(-sp.get_score(i)) + 1 for p, i in self.pieces.items() if len(p) > 1}
        runs = {p for p in ranks if not p.strip(BLANK)}
        self.runs = {len(p): self.pieces[p] for p in runs} | {1: self.pieces[BLANK]}
        self.run_ranks = {len(p): ranks[p] for p in runs}
        words = {p: i for p, i in self.pieces.items() if p not in runs}
        if any(BLANK in p[1:] for p in words):
            raise ValueError("a piece holds a blank after its first character")
        self.known = {p: i for p, i in words.items() if len(p) == 1}
        self.ranks = {p: r for p, r in ranks.items() if p not in runs}
        self.longest = max(map(len, words))
        if self.longest > _LONGEST:
            raise ValueError(f"pieces of more than {_LONGEST} characters are not supported")
        #: ids of pieces that merging can build, and the (rank, first character) of all merges in each one's tree
        self.edges: dict[str, int] = {}
        self.merges: list[list[int]] = [[] for _ in range(size)]
        for p, i in words.items():
            tree = merge_tree(p, self.ranks)
            if len(tree) == 1:
                self.edges[p] = i
                self.merges[i] = [r << _PLACE | s for r, s in self._made(tree[0], 0)]
        letters = sorted({c for p in words if len(p) > 1 for c in p})
        self.kind = np.zeros(0x10000, dtype=np.int32)
        self.kind[[ord(c) for c in letters if ord(c) < 0x10000]] = np.flatnonzero([ord(c) < 0x10000 for c in letters]) + 1
        self.pairs = np.zeros((len(letters) + 1, len(letters) + 1), dtype=bool)
        number = {c: k + 1 for k, c in enumerate(letters)}
        for p in words:
            for a, b in zip(p, p[1:]):
                self.pairs[number[a], number[b]] = True

    def _made(self, node: tuple, start: int) -> list[tuple[int, int]]:
        if not node[1]:
            return []
        own = self.ranks[node[0]]
        below = self._made(node[1], start) + self._made(node[2], start + len(node[1][0]))
        if any(r >= own for r, _ in below):
            raise ValueError(f"piece {node[0]!r} ranks before its parts")
        return [(own, start), *below]

    def run_ids(self, n: int) -> list[int]:
        """Ids of n blanks, merged as any other characters: the lowest rank first, the leftmost of equal ones."""
        size, after = [1] * n, list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ahead: list[tuple[int, int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (rank := self.run_ranks.get(size[i] + size[j])):
                heapq.heappush(ahead, (rank, i, size[i], size[j]))

        for i in range(n):
            propose(i)
        while ahead:
            _, i, left, right = heapq.heappop(ahead)
            j = after[i]
            if size[i] != left or j >= n or size[j] != right:
                continue
            size[i], size[j], after[i] = left + right, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(i)
            propose(before[i])
        return [self.runs[k] for k in size if k]


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


class Segments:
    """Texts cut at places that no piece crosses: ``distinct`` segments, and the code of each in order.

    A segment is a word that begins with its own blank or none, a run of the other blanks, or one character that
    the vocabulary lacks.
    """

    def __init__(self, texts: list[str | None], table: PieceTable):
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        whole = "\0".join(marked) + "\0"
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        ends = np.cumsum(np.fromiter(map(len, marked), dtype=np.int64, count=len(marked)) + 1) - 1
        kind = table.kind[np.minimum(codes, 0xFFFF)]
        kind[codes > 0xFFFE] = 0
        joined = np.concatenate(([False], table.pairs.ravel()[kind[:-1] * np.int32(len(table.pairs)) + kind[1:]]))
        blank = codes == ord(BLANK)
        start = ~joined
        begun = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        start[begun] = np.append(joined[1:], False)[begun]
        used = np.ones(len(codes), dtype=bool)
        used[ends] = False
        start &= used
        begins = np.flatnonzero(start)
        #: segments of each text
        self.per_text = np.diff(np.searchsorted(begins, ends), prepend=0)
        raw = np.frombuffer(whole.encode(), dtype=np.uint8)
        width = np.where(used, 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF), 0)
        offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[begins], int(width.sum()))
        keep = np.ones(len(raw), dtype=bool)
        keep[np.flatnonzero(raw == 0)] = False
        if int(keep.sum()) != offsets[-1]:  # a text holds the separator itself
            at = np.cumsum(1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)) - 1
            keep[:] = True
            keep[at[ends]] = False
        made = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw[keep])]).dictionary_encode()
        self.distinct: pa.Array = made.dictionary
        self.code = made.indices.to_numpy(zero_copy_only=False)

    def words(self) -> np.ndarray:
        """Which of the distinct segments the lattice encodes: those of two or more characters that are no run of blanks."""
        return pc.and_(pc.greater(pc.utf8_length(self.distinct), 1), pc.invert(pc.starts_with(self.distinct, BLANK * 2))).to_numpy(zero_copy_only=False)


# ---- the lattice ----------------------------------------------------------------------------


def _constant(value: list, kind: str) -> Column:
    """A large constant: the optimizer parses it once."""
    return F.from_json(F.lit(json.dumps({"v": value}, separators=(",", ":"))), f"struct<v:{kind}>")["v"]


def _edge(e: Column, s: Column, i: Column) -> Column:
    """End, length (longest first) and piece in one number, in this order; ends may be as large as a string's length."""
    return F.shiftleft(e.cast("long"), _LENGTH + _ID).bitwiseOR(F.shiftleft((_LONGEST - (e - s)).cast("long"), _ID)).bitwiseOR(i.cast("long"))


def _end(x: Column) -> Column:
    return F.shiftright(x, _LENGTH + _ID)


def _start(x: Column) -> Column:
    return _end(x) - _LONGEST + F.shiftright(x, _ID).bitwiseAND(F.lit(_LONGEST).cast("long"))


def _id(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << _ID) - 1).cast("long")).cast("int")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_path(edges: Column, table: PieceTable) -> Column:
    """Ids of the path that merging builds; ``edges`` are sorted, so a position's one-character edge is its last."""
    # the large constant stands once in the plan
    return _let(_constant(table.merges, "array<array<bigint>>"), lambda merges: _best_path(edges, merges, table.longest))


def _best_path(edges: Column, merges: Column, longest: int) -> Column:
    def tree(x: Column) -> Column:
        return F.get(merges, _id(x))

    def single(x: Column) -> Column:
        return _end(x) - _start(x) == 1

    multi = F.filter(edges, lambda x: ~single(x))
    order = F.array_sort(F.transform(multi, lambda x: F.get(tree(x), F.lit(0)) + _start(x)))

    def by_number(keys: Column) -> Column:
        # best: score and ids of positions 0 up to here; score, ids: the best way so far to the next one
        def step(acc: Column, x: Column) -> Column:
            base = F.get(acc["best"], _start(x).cast("int"))
            one = single(x)
            gain = F.when(one, F.lit(0).cast("long")).otherwise(
                F.aggregate(tree(x), F.lit(0).cast("long"), lambda a, m: a + F.call_function("shiftleft", F.lit(1).cast("long"), (63 - F.array_position(keys, m + _start(x))).cast("int")))
            )
            newer = _let(
                base["score"] + gain,
                lambda score: F.when(score > acc["next"]["score"], F.struct(score.alias("score"), F.concat(base["ids"], F.array(_id(x))).alias("ids"))).otherwise(acc["next"]),
            )
            return F.when(one, F.struct(F.concat(acc["best"], F.array(newer)).alias("best"), nothing.alias("next"))).otherwise(F.struct(acc["best"].alias("best"), newer.alias("next")))

        ids = F.array().cast("array<int>")
        nothing = F.struct(F.lit(-1).cast("long").alias("score"), ids.alias("ids"))
        first = F.struct(F.lit(0).cast("long").alias("score"), ids.alias("ids"))
        return F.aggregate(edges, F.struct(F.array(first).alias("best"), nothing.alias("next")), step, lambda acc: F.element_at(acc["best"], -1)["ids"])

    def by_lists() -> Column:
        last = F.lit(2**63 - 1)
        longs = F.array().cast("array<bigint>")

        def keys_of(x: Column) -> Column:
            return F.transform(tree(x), lambda m: m + _start(x))

        def settle(done: Column, best: Column) -> Column:
            """Put out the first token if all paths have it."""
            head = F.get(F.get(best, F.lit(0))["path"], F.lit(0))
            agreed = head.isNotNull() & F.forall(best, lambda b: F.coalesce(F.get(b["path"], F.lit(0)) == head, F.lit(False)))
            rest = F.transform(best, lambda b: F.struct(F.array_except(b["keys"], keys_of(head)).alias("keys"), F.slice(b["path"], F.lit(2), F.size(b["path"])).alias("path")))
            return F.when(agreed, F.struct(F.concat(done, F.array(_id(head))).alias("done"), rest.alias("best"), none.alias("next"))).otherwise(F.struct(done.alias("done"), best.alias("best"), none.alias("next")))

        def step(acc: Column, x: Column) -> Column:
            base = F.get(acc["best"], (F.size(acc["best"]) - (_end(x) - _start(x))).cast("int"))
            made = F.struct(F.array_sort(F.concat(base["keys"], keys_of(x))).alias("keys"), F.concat(base["path"], F.array(x)).alias("path"))
            newer = _let(made, lambda c: F.when(acc["next"].isNull() | (c["keys"] < acc["next"]["keys"]), c).otherwise(acc["next"]))
            window = _let(F.concat(acc["best"], F.array(newer)), lambda b: F.when(F.size(b) > longest, F.slice(b, F.lit(2), F.lit(longest))).otherwise(b))
            moved = _let(window, lambda b: settle(acc["done"], b))
            return F.when(single(x), moved).otherwise(F.struct(acc["done"].alias("done"), acc["best"].alias("best"), newer.alias("next")))

        none = F.lit(None).cast("struct<keys:array<bigint>,path:array<bigint>>")
        first = F.struct(F.array(last).alias("keys"), longs.alias("path"))
        start = F.struct(F.array().cast("array<int>").alias("done"), F.array(first).alias("best"), none.alias("next"))
        return F.aggregate(edges, start, step, lambda acc: F.concat(acc["done"], F.transform(F.element_at(acc["best"], -1)["path"], _id)))

    return _let(order, lambda keys: F.when(F.size(keys) <= 63, by_number(keys)).otherwise(by_lists()))


#: Words over so many characters are exploded from overlapping parts.
_PART = 64


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, n, ids) of distinct words (word, n); no word is dealt anew, so edges are grouped where they are made."""
    t = piece_table(path)
    pieces = F.broadcast(words.sparkSession.createDataFrame([(p, i) for p, i in t.edges.items()], "piece string, id int"))

    def edges(parts: DataFrame, keys: list[str]) -> DataFrame:
        """``parts`` has (text, base, most): the starts to take from a part of a word, whose first character is at ``base``."""
        starts = parts.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("most") - 1)))
        spans = starts.withColumn("l", F.explode(F.sequence(F.lit(1), F.least(F.lit(t.longest), F.length("text") - F.col("s")))))
        found = spans.withColumn("piece", F.substring("text", F.col("s") + 1, F.col("l"))).join(pieces, "piece")
        s = F.col("base") + F.col("s")
        return found.select(*keys, _edge(s + F.col("l"), s, F.col("id")).alias("edge"))

    short = words.filter(F.length("word") <= _PART).select(F.xxhash64("word").alias("h"), "word", "n", F.col("word").alias("text"), F.lit(0).alias("base"), F.length("word").alias("most"))
    lattice = edges(short, ["h", "word", "n"]).groupBy("h", "word", "n").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    long = words.filter(F.length("word") > _PART).select("word", "n", F.xxhash64("word").alias("h"), F.xxhash64(F.lit(1), "word").alias("g"))
    cut = long.withColumn("base", F.explode(F.sequence(F.lit(0), F.length("word") - 1, F.lit(_PART))))
    parts = cut.select("h", "g", F.expr(f"substring(word, base + 1, {_PART + t.longest})").alias("text"), "base", F.least(F.lit(_PART), F.length("word") - F.col("base")).alias("most"))
    lattices = edges(parts, ["h", "g"]).groupBy("h", "g").agg(F.array_sort(F.collect_list("edge")).alias("edges")).join(long, ["h", "g"])
    return lattice.unionByName(lattices.drop("g")).select("word", "n", best_path(F.col("edges"), t).alias("ids"))


# ---- documents ------------------------------------------------------------------------------


def decode(ids: list[int], path: str) -> str:
    """Text of the ids: pieces joined, bytes as UTF-8, the blank that encoding puts first taken off."""
    flat, offsets = _spelling(path)
    raw = b"".join(flat[offsets[i] : offsets[i + 1]].tobytes() for i in ids).decode("utf-8", "replace").replace(BLANK, " ")
    return raw[1:] if raw.startswith(" ") else raw


@lru_cache(maxsize=2)
def _spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, and where each id's begin."""
    t = piece_table(path)
    spelled = {i: p.encode() for p, i in t.pieces.items()} | {i: bytes([b]) for b, i in t.bytes.items()}
    size = max(spelled) + 1
    return np.frombuffer(b"".join(spelled.get(i, b"") for i in range(size)), dtype=np.uint8), np.cumsum([0, *(len(spelled.get(i, b"")) for i in range(size))])


def decode_flat(ids: np.ndarray, path: str) -> np.ndarray:
    """Bytes of the ids, end to end."""
    flat, offsets = _spelling(path)
    size = (offsets[1:] - offsets[:-1])[ids]
    ends = np.cumsum(size)
    return flat[np.repeat(offsets[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Dictionary:
    """Ids of frequent words, from an Arrow table (word, ids)."""

    def __init__(self, raw: bytes):
        table = pa.ipc.open_stream(raw).read_all().combine_chunks()
        lists = table["ids"].chunk(0) if table["ids"].num_chunks else pa.array([], pa.list_(pa.int32()))
        self.row = {w: i for i, w in enumerate(_strings(table["word"]))}
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.flat = lists.values.to_numpy()


def _strings(a: pa.Array | pa.ChunkedArray) -> list[str]:
    """As ``to_pylist``, without a scalar object for each string."""
    return pc.cast(a, pa.large_string()).to_numpy(**({} if isinstance(a, pa.ChunkedArray) else {"zero_copy_only": False})).tolist()


def rare_words(segments: Segments, shared: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """(dictionary row of each distinct segment or -1, places of those that need the word table)."""
    row = np.fromiter((shared.row.get(w, -1) for w in _strings(segments.distinct)), dtype=np.int64, count=len(segments.distinct))
    return row, np.flatnonzero((row < 0) & segments.words())


def assemble(texts: list[str | None], rare: list[list[int]], shared: Dictionary, path: str) -> list[np.ndarray]:
    """Ids of the texts of one slice; ``rare`` has those of its rare words, in order."""
    t = piece_table(path)
    seg = Segments(texts, t)
    row, wanted = rare_words(seg, shared)
    own: list[list[int]] = [[]] * len(row)
    for i, ids in zip(wanted.tolist(), rare, strict=True):
        own[i] = ids
    lone = t.runs[1]
    run = np.zeros(len(row), dtype=np.int64)
    rest = np.flatnonzero(row < 0)
    special = np.setdiff1d(rest, wanted, assume_unique=True)
    for i, w in zip(special.tolist(), _strings(seg.distinct.take(pa.array(special)))):
        if not w.strip(BLANK):
            run[i] = len(w)
            own[i] = t.run_ids(len(w))
        else:
            own[i] = [t.known[w]] if w in t.known else [t.bytes[b] for b in w.encode()]
    lengths = np.where(row >= 0, (shared.offsets[1:] - shared.offsets[:-1])[np.maximum(row, 0)] if len(shared.row) else 0, 0)
    begin = np.where(row >= 0, shared.offsets[np.maximum(row, 0)], 0)
    flat_rest = np.array([x for i in rest.tolist() for x in own[i]], dtype=np.int32)
    lengths[rest] = [len(own[i]) for i in rest.tolist()]
    begin[rest] = len(shared.flat) + np.cumsum(lengths[rest]) - lengths[rest]
    flat = np.concatenate((shared.flat, flat_rest))
    code = seg.code.astype(np.int64)
    # a word whose own blank stayed alone gives it to the run of blanks before it
    if run.any():
        text_of = np.repeat(np.arange(len(texts)), seg.per_text)
        opens = np.zeros(len(row), dtype=bool)
        some = np.flatnonzero(lengths > 0)
        opens[some] = (flat[begin[some]] == lone) & (run[some] == 0) & (lengths[some] > 1)
        at = np.flatnonzero(opens[code[1:]] & (run[code[:-1]] > 0) & (text_of[1:] == text_of[:-1])) + 1
        if len(at):
            more, begins, sizes, extra = len(row), [], [], []
            runs, which = np.unique(run[code[at - 1]], return_inverse=True)
            for n in runs.tolist():
                begins.append(len(flat) + len(extra))
                extra += t.run_ids(n + 1)
                sizes.append(len(flat) + len(extra) - begins[-1])
            bare, what = np.unique(code[at], return_inverse=True)
            begins, sizes = np.concatenate((begins, begin[bare] + 1)), np.concatenate((sizes, lengths[bare] - 1))
            flat, begin, lengths = np.concatenate((flat, np.array(extra, dtype=np.int32))), np.concatenate((begin, begins)), np.concatenate((lengths, sizes))
            code[at - 1] = more + which
            code[at] = more + len(runs) + what
    count = lengths[code]
    last = np.cumsum(count)
    ids = flat[np.repeat(begin[code] - (last - count), count) + np.arange(int(last[-1]) if len(last) else 0)]
    cuts = np.concatenate(([0], last))[np.cumsum(seg.per_text)].tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts)]


#: Bytes of text in a slice, words in a task of the lattice.
SLICE, TASK_WORDS = 1_000_000, 100_000


def _slice_key(batch: pa.RecordBatch) -> int:
    """The same for the same rows; equal slices have equal rare words. Should two unlike slices share a key, their answers are too many, and ``assemble`` refuses them."""
    h = xxhash.xxh3_64()
    for text in batch["text"].to_pylist():
        h.update(len(text).to_bytes(8, "little"))
        h.update(text.encode())
    return h.intdigest() - (1 << 63)


def encode(docs: DataFrame, model: Callable[[], str], dictionary: int = 250_000) -> DataFrame:
    """(doc_id, text, ids) of (doc_id, text). ``model`` names the model file on the worker that calls it."""
    return _encoded(docs, model, dictionary, "doc_id long, text string, ids array<int>", _plain_rows)


def _plain_rows(doc_ids: pa.Array, texts: list[str], ids: list[np.ndarray], path: str) -> pa.RecordBatch:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(texts, pa.string()), lists], names=["doc_id", "text", "ids"])


def _encoded(docs: DataFrame, model: Callable[[], str], dictionary: int, schema: str, rows: Callable) -> DataFrame:
    spark = docs.sparkSession
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece", _SHARED.clear)
        _SHARED.clear()  # an earlier run's
        table = piece_table(model())
        for batch in text_slices(batches, most=SLICE):
            seg = Segments(batch["text"].to_pylist(), table)
            count = np.bincount(seg.code, minlength=len(seg.distinct))
            kept_ = pa.array(seg.words())
            yield pa.RecordBatch.from_arrays([seg.distinct.filter(kept_).cast(pa.string()), pa.array(count, pa.int64()).filter(kept_)], names=["word", "n"])
            del seg, count, kept_
        release()

    counted = kept.select("text").mapInArrow(split, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with shuffles_dropped(spark):
        words = materialize(counted, "sp-words")  # short and long words are read apart; without a table the texts would be split for each
        width = shuffle_width(spark)
        coded = materialize(encode_words(words.repartition(width * max(1, -(-words.count() // (width * TASK_WORDS))), "word"), model()), "sp-coded")
    drop_path(spark, words.scratch_path)
    # the least count that at most `dictionary` words have; counts are few
    least, held = 1, 0
    for r in sorted(coded.groupBy("n").count().collect(), reverse=True):
        held += r["count"]
        if held > dictionary:
            least = r["n"] + 1
            break
    top = coded.filter(F.col("n") >= least).select("word", "ids").toArrow()
    sink = pa.BufferOutputStream()
    plain = pa.schema([("word", pa.string()), ("ids", pa.list_(pa.int32()))])
    with pa.ipc.new_stream(sink, plain) as out:
        out.write_table(top.cast(plain))
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())  # at most `dictionary` words of _PART characters or so

    def frequent() -> Dictionary:
        if key not in _SHARED:
            _SHARED.clear()
            _SHARED[key] = Dictionary(shared.value)
        return _SHARED[key]

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece", _SHARED.clear)
        table = piece_table(model())
        for batch in text_slices(batches, most=SLICE):
            seg = Segments(batch["text"].to_pylist(), table)
            _, wanted = rare_words(seg, frequent())
            found = seg.distinct.take(pa.array(wanted)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), _slice_key(batch), dtype=np.int64)), pa.array(np.arange(len(found)), pa.int32()), found], names=["slice", "k", "word"])

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in text_slices(batches, most=SLICE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([_slice_key(batch)], pa.int64()), "docs": pa.array([packer.compress(sink.getvalue().to_pybytes())], pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sentencepiece", _SHARED.clear)
        path = model()
        for batch in batches:
            for docs_, rare in zip(batch["docs"], batch["rare"]):
                table = pa.ipc.open_stream(zstandard.decompress(docs_.as_py())).read_all().combine_chunks()
                texts = table["text"].to_pylist()
                ids = assemble(texts, _answers(rare.values), frequent(), path)
                yield rows(table["doc_id"].combine_chunks() if table.num_rows else table["doc_id"], texts, ids, path)

    asked = kept.mapInArrow(request, "slice long, k int, word string")
    answered = asked.join(coded.select("word", "ids"), "word").select("slice", "k", "ids").groupBy("slice").agg(F.collect_set(F.struct("k", "ids")).alias("rare"))
    slices = kept.mapInArrow(wrap, "slice long, docs binary")
    return slices.join(answered.hint("merge"), "slice", "left").select("docs", "rare").mapInArrow(fill, schema)


_SHARED: dict[str, Dictionary] = {}


def _answers(rare: pa.StructArray | None) -> list[list[int]]:
    """Ids of a slice's rare words in the order of their number ``k``."""
    if rare is None:
        return []
    k, lists = rare.flatten()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).tolist()
    each = [flat[a:b] for a, b in zip([0, *ends], ends)]
    return [each[i] for i in np.argsort(k.to_numpy(zero_copy_only=False), kind="stable").tolist()]


def _digest_rows(doc_ids: pa.Array, texts: list[str], ids: list[np.ndarray], path: str) -> pa.RecordBatch:
    import hashlib

    out = []
    for text, x in zip(texts, ids):
        back = decode_flat(x, path).tobytes().decode("utf-8", "replace").replace(BLANK, " ")
        back = back[1:] if back.startswith(" ") else back
        out.append((len(x), zlib.crc32(x.astype("<u4")), hashlib.sha256(back.encode()).hexdigest(), back == text.replace(BLANK, " ")))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    names = ("doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip")
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], names=names)


def digests(docs: DataFrame, model: Callable[[], str], dictionary: int = 250_000) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip): every text encoded and decoded again."""
    return _encoded(docs, model, dictionary, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean", _digest_rows)
