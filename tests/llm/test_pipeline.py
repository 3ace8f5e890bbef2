"""The corpus pipeline over a whole small table, each stage against brute force on what the stage before it kept."""

import collections
import os
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillspan.llm import bagminhash
from quillspan.llm.common import materialize
from quillspan.llm.encoders import public_path

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], DATA), f"test-{name}"))
    raw, spoken, lined, single = ({r.doc_id: r for r in d.collect()} for d in kept[:4])
    columns = docs.columns
    assert all(d.columns == columns for d in kept[:4])

    # language ID: nothing is changed; whatever has no letter goes, prose stays
    assert all(raw[i] == r for i, r in spoken.items())
    letters = {i for i, r in raw.items() if any(c.isalpha() for c in r.text or "")}
    assert set(spoken) <= letters and len(spoken) >= 0.9 * len(letters)

    # line dedup: every document stays; of each text only whole lines go, and a line goes everywhere or nowhere
    assert set(lined) == set(spoken)
    gone, left = set(), collections.Counter()
    for i, r in spoken.items():
        before, after = (r.text or "").split("\n"), (lined[i].text or "").split("\n")
        rest = iter(before)
        assert lined[i].text == "" or all(line in rest for line in after)  # a subsequence
        assert lined[i].n_chars == len(lined[i].text)
        gone |= set((collections.Counter(before) - collections.Counter(after)).keys())
        left.update(set(after))
    assert all(not line.strip() or left[line] == 0 for line in gone)

    # near-dedup: one document of each component of the exact multiset likeness over all pairs
    ids = sorted(lined)
    bags = [bagminhash.bag(lined[i].text) for i in ids]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if lined[ids[a]].text == lined[ids[b]].text or bagminhash.overlap(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(single) == {ids[i] for i in range(len(ids)) if find(i) == i}
    assert all(single[i] == lined[i] for i in single)

    # packing: the library's ids of every document, cut into pieces that fill gapless sequences
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in kept[4].collect():
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(pieces) == set(single)
    for i, parts in pieces.items():
        want = np.array([*tokenizer.encode(single[i].text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(want[at : at + p.length])
            at += p.length
        assert at == len(want)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
