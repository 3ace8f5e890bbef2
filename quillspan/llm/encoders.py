"""Bulk byte-pair encoding in NumPy: the ids of the tokenizers library, for whole batches of texts at once.

Two kinds of tokenizer are known here: byte-level BPE (a piece takes the space before it) and BPE with
word ends over lower-cased text without white space. A batch of texts is laid end to end; character classes
give the borders of its pieces (words, numbers, runs of other characters, contractions); the distinct
pieces of the batch are merged together, one merge of every piece in each step; ids are gathered back.
Nothing is kept from batch to batch, so memory follows the batch alone.

Texts that hold a character whose class, lower case or normal form is not plain (see ``_PLAIN``), pieces over
``LONG`` bytes, and tokenizers of other kinds are encoded by the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import claim

#: Pieces over so many bytes are left to the library.
LONG = 64
#: Characters of texts that are encoded at once.
GROUP_CHARS = 4_000_000
_OTHER, _LETTER, _NUMBER, _BLANK, _WHITE, _ODD, _BREAK = range(7)
#: Ranges of code points whose class may be taken from Python's Unicode tables.
_PLAIN = ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x2FF), (0x370, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
_NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point below 65,536; the last stands for all above."""
    out = np.full(0x10000, _ODD, dtype=np.uint8)
    for first, last in _PLAIN:
        for i in range(first, last + 1):
            c = chr(i)
            kind = unicodedata.category(c)
            if kind == "Cn" or kind[0] == "M" or unicodedata.normalize("NFC", c) != c or len(c.lower()) != 1 or c == "Σ":
                continue
            out[i] = _BLANK if c == " " else _WHITE if c.isspace() else {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Merge ranks of symbol pairs in an open-addressing table that NumPy can probe."""

    def __init__(self, pairs: list[tuple[int, int]], made: list[int]):
        self.made = np.array(made, dtype=np.int32)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank = np.full(1 << self.bits, _NONE, dtype=np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        for i, (k, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[slot] not in (-1, k):
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] == -1:
                self.keys[slot], self.rank[slot] = k, i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.rank[slot]
        rest = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = _NONE
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.rank[slot[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of ``sizes`` symbols (none empty), each until none of its pairs is in the table.

        In every step each piece makes its merge of the lowest rank, the leftmost one of equal ranks.
        """
        starts = np.cumsum(sizes) - sizes
        last = np.zeros(len(symbols), dtype=bool)
        last[starts + sizes - 1] = True
        rank = np.full(len(symbols), _NONE, dtype=np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        piece = np.arange(len(sizes))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(piece):
            best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), starts)
            at = best & 0xFFFFFFFF
            live = best >> 32 < _NONE
            if not live.all():
                bounds = np.append(starts, len(symbols))
                width = np.diff(bounds)
                stays = np.repeat(live, width)
                done.append((piece[~live], width[~live], symbols[~stays]))
                symbols, rank, last = symbols[stays], rank[stays], last[stays]
                shift = np.cumsum(np.where(live, 0, width))
                at, starts, piece = at[live] - shift[live], (starts - shift + np.where(live, 0, width))[live], piece[live]
                if not len(piece):
                    break
            symbols[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            gone = np.arange(len(piece))
            at, starts = at - gone, starts - gone
            rank[at] = _NONE
            right = at[~last[at]]
            rank[right] = self.ranks(symbols[right], symbols[right + 1])
            left = at[at > starts] - 1
            rank[left] = self.ranks(symbols[left], symbols[left + 1])
        if not done:
            return symbols, sizes
        which, width, flat = (np.concatenate(x) for x in zip(*done))
        out = np.empty(len(sizes), dtype=np.int64)
        out[which] = width
        ends = np.cumsum(out)
        placed = np.empty(len(flat), dtype=symbols.dtype)
        placed[np.repeat(ends[which] - np.cumsum(width), width) + np.arange(len(flat))] = flat
        return placed, out


class BulkEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        made_of = json.loads(self.lib.to_str())
        model, cutter = made_of["model"], made_of["pre_tokenizer"] or {}
        suffix = model.get("end_of_word_suffix") or ""
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        byte_level = cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"] and not made_of["normalizer"] and not suffix
        steps = [n["type"] for n in (made_of["normalizer"] or {}).get("normalizers", [])]
        words = [p["type"] for p in cutter.get("pretokenizers", [])] == ["Split", "ByteLevel"] and cutter["pretokenizers"][0]["behavior"] == "Removed" and steps == ["NFC", "Replace", "Lowercase"]
        self.drops_space = words
        self.known = plain and (byte_level or words and bool(suffix))
        if not self.known:
            return
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.first = np.array([vocab[c] for c in _byte_letters()], dtype=np.int32)
        self.final = np.array([vocab[c + suffix] for c in _byte_letters()], dtype=np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of every text; null counts as empty."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        if not self.known or not texts:
            return self._library(texts)
        whole = "\0".join(texts) + "\0"
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        kind = _classes()[np.minimum(codes, 0xFFFF)]
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
        kind[ends] = _BREAK
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            left = np.unique(np.searchsorted(ends, odd)).tolist()
            out = dict(zip(left, self._library([texts[i] for i in left])))
            rest = [i for i in range(len(texts)) if i not in out]
            out |= zip(rest, self._group([texts[i] for i in rest]) if rest else [])
            return [out[i] for i in range(len(texts))]
        if self.drops_space:
            whole = whole.lower()
            codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        solid = kind <= _NUMBER
        before = np.concatenate(([_BREAK], kind[:-1])).astype(np.uint8)
        start = solid & (kind != before)
        if self.drops_space:
            start |= kind == _NUMBER
            self._contractions(start, codes, kind, start)
        else:
            white = (kind == _BLANK) | (kind == _WHITE)
            start &= before != _BLANK
            self._contractions(start, codes, kind, start)
            ahead = np.append(solid[1:], False)
            start |= white & (ahead | ~((before == _BLANK) | (before == _WHITE)))
        used = solid if self.drops_space else kind != _BREAK
        begins = np.flatnonzero(start)
        per_text = np.diff(np.searchsorted(begins, ends), prepend=0)
        raw = np.frombuffer(whole.encode(), dtype=np.uint8)
        if len(raw) == len(codes):
            lengths = used.astype(np.int64)
            data = raw[used]
        else:
            width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF)
            lengths = np.where(used, width, 0).astype(np.int64)
            data = raw[np.repeat(used, width)]
        offsets = np.append((np.cumsum(lengths) - lengths)[begins], len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code = pieces.indices.to_numpy(zero_copy_only=False)
        ids, sizes = self._pieces(pieces.dictionary)
        count = sizes[code]
        last = np.cumsum(count)
        total = int(last[-1]) if len(last) else 0
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[code] - (last - count), count) + np.arange(total)]
        cuts = np.concatenate(([0], last))[np.cumsum(per_text)].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    @staticmethod
    def _contractions(start: np.ndarray, codes: np.ndarray, kind: np.ndarray, runs: np.ndarray) -> None:
        """Where a run begins with an apostrophe: 's 't 'm 'd 're 've 'll are pieces."""
        at = np.flatnonzero(runs & (codes == 39))
        at = at[at + 1 < len(codes)]
        one = codes[at + 1]
        two = codes[np.minimum(at + 2, len(codes) - 1)]
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        after = at + 1 + size
        start[after[kind[after] == _LETTER]] = True

    def _pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, end to end, and how many each has."""
        n = len(distinct)
        if not n:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        _, offsets, data = distinct.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64, count=n + 1)
        raw = np.frombuffer(data, dtype=np.uint8, count=int(offsets[-1]))
        sizes = np.diff(offsets)
        long = np.flatnonzero(sizes > LONG)
        symbols = self.first[raw]
        symbols[offsets[1:] - 1] = self.final[raw[offsets[1:] - 1]]
        if not len(long):
            flat, count = self.merges.merge(symbols, sizes)
            return flat.astype(np.uint32), count
        short = sizes <= LONG
        flat, count = self.merges.merge(symbols[np.repeat(short, sizes)], sizes[short]) if short.any() else (symbols[:0], sizes[:0])
        counts = np.empty(n, dtype=np.int64)
        counts[short] = count
        letters = np.array(_byte_letters())
        own = []
        for i in long.tolist():
            tokens = self.lib.model.tokenize("".join(letters[raw[offsets[i] : offsets[i + 1]]]))
            own.append(np.array([t.id for t in tokens], dtype=np.int32))
            counts[i] = len(own[-1])
        parts = np.split(flat, np.cumsum(count)[:-1]) if len(count) else []
        mixed: list[np.ndarray | None] = [None] * n
        for i, p in zip(np.flatnonzero(short).tolist(), parts):
            mixed[i] = p
        for i, p in zip(long.tolist(), own):
            mixed[i] = p
        return np.concatenate(mixed).astype(np.uint32), counts


_MADE: dict[str, BulkEncoder] = {}


def encoder(path: str) -> BulkEncoder:
    """One encoder for each file in a Python worker."""
    claim(f"encoder {path}", lambda: _MADE.pop(path, None))
    if path not in _MADE:
        _MADE[path] = BulkEncoder(path)
    return _MADE[path]


def public_path(name: str) -> str:
    """Where the named public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
