"""The ten operators against brute-force versions, exact round trips, and awkward rows."""

import collections
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import bagminhash, bitplanes, bottomk, flac, langid_crf, line_templates, packing, rollups, sentencepiece_lattice, warc
from quillspan.llm.common import scratch_path, shingle_hashes, word_hashes
from quillspan.llm.encoders import BulkEncoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key long, `row` string, ids string, head string"


def prose(rng, n):
    return " ".join(rng.choice(["ka", "lo", "mi", "ber", "tan"]) + rng.choice(["sol", "ne", "ri", "dum"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = prose(rng, 120)
    near = base.split()
    near[5] = "changed"
    return [None, "", "  \n ", "one", "Two words\n\nand  three   spaces ", base, base, " ".join(near), "x" * 30_000, prose(rng, 6000), "é" * 7 + " naïve ﬁ ½ 漢字 \U0001f600 \x00\x1d|", "<|endoftext|> it's 123\tend", *(prose(rng, rng.randrange(3, 90)) for _ in range(30))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, ("en", "de", None)[i % 3], "s", len(t or ""), 1, 2, "r", "i", "h") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def with_null_id(spark):
    return spark.createDataFrame([(None, "a b c", "en", "s", 5, 1, 2, "r", "i", "h"), (1, None, None, None, None, 1, 2, "r", "i", "h")], SCHEMA)


def ordered(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1]))


def library_ids(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(name))
    t.encode_special_tokens = True
    return [np.array(e.ids, dtype="<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bulk_encoder_equals_the_library(name, texts):
    full = [t or "" for t in texts] + ["a  b", " lead", "trail ", "tab\t x", "\n\n x", "it's  we'll"]
    rng = random.Random(2)
    pool = list(" \n\t  ''\"abcdefghijklmstvrDEFélüßñ0123456789.,;:!?-_%$&#*()") + ["\U0001f600", "\u0308", "漢", "\xa0", "İ", "Σ"]
    full += ["".join(rng.choice(pool[:-6] if i % 2 else pool) for _ in range(rng.randrange(60))) for i in range(4000)]
    full += [f"a{chr(i)}b {chr(i)}{chr(i)}" for i in range(0x600) if not 0xD800 <= i < 0xE000] + ["a" * 65 + " " + "ab" * 70]
    mine = BulkEncoder(public_path(name))
    assert mine.known
    for got, want in zip(mine.encode(full), library_ids(name, full), strict=True):
        assert got.tolist() == want.tolist()


def test_word_hashes_do_not_depend_on_place():
    long = "w " * 70_000 + "tail word"
    assert len(set(word_hashes(long)[:-2].tolist())) == 1 and (word_hashes(long)[-2:] == word_hashes("tail WORD")).all()
    assert len(shingle_hashes("a b c d e f")) == 2 and len(shingle_hashes("a b")) == 1 and len(shingle_hashes(" ")) == 0


# ---- 1 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("dictionary", [5, 100_000])
def test_sentencepiece_equals_the_library(spark, docs, dictionary):
    import sentencepiece

    model = public_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(3)
    pool = list("  \n\t  ▁abcdeinrst.,;:'\"0123456789éü漢\U0001f600\x00_-xX")
    more = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(300)] + ["a" * k for k in range(60, 80)] + ["an" * k for k in range(30, 50)] + [" " * k for k in range(1, 50)]
    more += ["word   next    x  ", *("".join(rng.choice("abcdetionsr") for _ in range(k)) for k in (64, 65, 80, 400))]
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = sentencepiece_lattice.encode(every, lambda: public_path("piece_bpe_32k.model"), dictionary).collect()
    assert len(got) == every.count()
    for r in got:
        assert r.ids == sp.encode(r.text), r.text[:60]
        assert sentencepiece_lattice.decode(r.ids, model) == sp.decode(r.ids)


def test_sentencepiece_long_word_and_nothing(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    word = "".join(random.Random(4).choice("abcdetionsr") for _ in range(30_000)) + "    " + "aaaa" * 9
    d = spark.createDataFrame([(1, word), (None, "ab"), (2, None), (3, "x" * 6000)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in sentencepiece_lattice.encode(d, lambda: public_path("piece_bpe_32k.model")).collect()}
    assert got == {1: sp.encode(word), None: sp.encode("ab"), 2: [], 3: sp.encode("x" * 6000)}
    assert sentencepiece_lattice.digests(nothing(spark), lambda: public_path("piece_bpe_32k.model")).count() == 0


# ---- 2 --------------------------------------------------------------------------------------


def test_langid_marginals_are_those_of_the_whole_sequence():
    rng = np.random.default_rng(3)
    emit, move, first = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    import itertools

    def brute(e):
        total = np.zeros(e.shape)
        for path in itertools.product(range(3), repeat=len(e)):
            w = np.exp(first[path[0]] + sum(e[i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for i, p in enumerate(path):
                total[i, p] += w
        return total / total.sum(axis=1, keepdims=True)

    got = langid_crf.marginals(emit, np.array([5, 1, 3]), move, first, chunk=2)
    want = np.concatenate([brute(emit[:5]), brute(emit[5:6]), brute(emit[6:])])
    assert np.abs(got - want).max() < 1e-9


def test_langid_learns_and_rejects(spark):
    rng = random.Random(8)
    make = {"aa": lambda: " ".join(rng.choice(["thor", "ing", "ando"]) + rng.choice(["tha", "her"]) for _ in range(30)), "bb": lambda: " ".join(rng.choice(["eau", "oix", "ille"]) + rng.choice(["que", "ment"]) for _ in range(30))}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "123 ...", "bb"), (902, make["aa"]() + " " + make["bb"](), None), (None, make["aa"](), "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid_crf.identify(d.withColumn("score", F.lit("clash"))).collect()}
    assert len(got) == len(rows) and all(got[i].lang_pred == lang for i, _, lang in rows[:80])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].n_switches == 1 and got[None].held_out
    assert {i for i, _, _ in rows[:80]} | {None} <= {r.doc_id for r in langid_crf.reject_unknown(d).collect()}
    assert langid_crf.identify(nothing(spark)).count() == 0
    assert {r.lang_pred for r in langid_crf.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- 3 --------------------------------------------------------------------------------------


def test_line_templates_drop_what_recurs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        lines = [prose(rng, 12), f"Posted by user{i} on 2024-01-{i % 28 + 1:02d} in General", prose(rng, 9)]
        if i < 15:
            lines.insert(1, f"Share this page with {prose(rng, 1)} and your friends today")
        rows.append((i, "\n".join(lines), len("\n".join(lines))))
    twin = "\n".join(prose(rng, 10) for _ in range(6))
    rows += [(100 + i, twin, len(twin)) for i in range(30)] + [(200, None, None), (201, "", 0), (None, rows[0][1], 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in line_templates.drop_boilerplate(d).collect()}
    for i in range(40):
        kept = [x for x in rows[i][1].split("\n") if not x.startswith(("Posted", "Share"))]
        assert got[i].text.split("\n") == kept and got[i].n_chars == len(got[i].text)
    assert all(got[100 + i].text == twin for i in range(30)) and got[200].text is None and got[201].text == "" and got[None].n_dropped == got[0].n_dropped
    assert line_templates.drop_boilerplate(nothing(spark)).count() == 0


def test_line_templates_do_not_split_by_frequent_values(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        line = f"Read the latest from city{chr(97 + i % 20)} by name{chr(97 + i // 20)} every single day"
        rows.append((i, "\n".join((prose(rng, 12), line, prose(rng, 9)))))
    got = line_templates.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and all(r.n_dropped == 1 and "Read the latest" not in r.text for r in got)


# ---- 4 --------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = set(shingle_hashes(a).tolist()), set(shingle_hashes(b).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_bottomk_edits_and_estimates(spark, docs):
    rows = ordered(docs)
    got = sorted(bottomk.fingerprint_edits(docs).collect(), key=lambda r: (r.doc_id, r.n_chars))
    assert len(got) == len(rows)
    for i, ((doc_id, text), r) in enumerate(zip(rows, got)):
        follower = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + follower[: len(text) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(text, edited)) < 0.2 and abs(r.near_next - jaccard(text, follower)) < 0.2
    assert bottomk.fingerprint_edits(nothing(spark)).count() == 0 and bottomk.fingerprint_edits(with_null_id(spark)).count() == 2


def test_bottomk_merges_and_counts():
    rng = random.Random(1)
    a, b = prose(rng, 900), prose(rng, 900)
    whole = bottomk.merge(bottomk.sketch(a), bottomk.sketch(b))
    assert (bottomk.load(bottomk.dump(whole)) == whole).all() and len(whole) == bottomk.K
    distinct = len(set(shingle_hashes(a).tolist()) | set(shingle_hashes(b).tolist()))
    assert abs(bottomk.distinct_count(whole) / distinct - 1) < 0.3 and bottomk.containment(bottomk.sketch(a), bottomk.sketch(a + " " + b)) > 0.8


# ---- 5 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_tokens", [700, 1_000_000])
def test_packing_covers_every_id_once(spark, docs, shard_tokens):
    rows = ordered(docs)
    ids = {i: np.append(x, 0).astype("<u4") for (i, _), x in zip(rows, library_ids("byte_bpe_50k.json", [t for _, t in rows]))}
    copies = collections.Counter(i for i, _ in rows)
    got = packing.pack(docs, lambda: public_path("byte_bpe_50k.json"), shard_tokens=shard_tokens).collect()
    filled, seen = collections.defaultdict(list), collections.Counter()
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        filled[r.sequence_id].append((r.offset, r.length))
        seen.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
    assert seen == collections.Counter({(i, k): copies[i] for i in ids for k in range(len(ids[i]))})
    for spans in filled.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans))
        total = sum(n for _, n in spans)
        assert total == 1024 or total & (total - 1) == 0
    assert packing.pack(nothing(spark), lambda: public_path("byte_bpe_50k.json")).count() == 0


def brute_packing_order(docs, frequency, n_docs, mean, window):
    """The greedy order by BM25 scores counted out word by word."""
    import math

    counts = [collections.Counter(d.tolist()) for d in docs]

    def score(seed, j):
        return sum(
            math.log1p((n_docs - frequency[t] + 0.5) / (frequency[t] + 0.5)) * counts[j][t] * 2.5 / (counts[j][t] + 1.5 * (0.25 + 0.75 * len(docs[j]) / mean))
            for t in counts[seed] if counts[j][t]
        )

    left, order, fill, seed = list(range(len(docs))), [], 0, None
    while left:
        near = [(-round(score(seed, j), 9), j) for j in left] if seed is not None else []
        near = [x for x in near if x[0] < 0]
        nxt = min(near)[1] if near else left[0]
        left.remove(nxt)
        order.append(nxt)
        total = fill + len(docs[nxt])
        seed = nxt if seed is None or total >= window else seed
        fill = total % window
        seed = None if fill == 0 else seed
    return order


@pytest.mark.parametrize("window", [60, 300])
def test_packing_order_equals_brute_force(window):
    rng = np.random.default_rng(window)
    docs = [(rng.zipf(1.4, rng.integers(1, 90)) % 700).astype(np.uint32) for _ in range(150)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=700) * 3
    mean = float(np.mean([len(d) for d in docs])) * 1.1
    index = packing.Bm25Index(docs, frequency, 450, mean)
    assert list(packing.packing_order([len(d) for d in docs], index, window)) == brute_packing_order(docs, frequency, 450, mean, window)


def test_packing_statistics_and_neighbours(spark):
    rng = random.Random(12)
    topics = [prose(rng, 60).split() for _ in range(40)]
    rows = []
    for i in range(400):
        w = list(topics[i % 40])
        for at in rng.sample(range(60), 2):
            w[at] = f"own{i}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ids = {i: np.append(x, 0) for (i, _), x in zip(rows, library_ids("byte_bpe_50k.json", [t for _, t in rows]))}
    frequency, n, mean = packing.corpus_statistics(packing.encode_documents(d, lambda: public_path("byte_bpe_50k.json"), 0))
    assert n == 400 and abs(mean - np.mean([len(x) for x in ids.values()])) < 1e-9
    assert (frequency == np.bincount(np.concatenate([np.unique(x) for x in ids.values()]), minlength=len(frequency))).all()
    windows = collections.defaultdict(list)
    for r in packing.pack(d, lambda: public_path("byte_bpe_50k.json")).collect():
        windows[r.sequence_id].append(r.doc_id)
    alike = sum(a % 40 == b % 40 for w in windows.values() for a, b in zip(w, w[1:]))
    assert alike > 0.6 * sum(len(w) - 1 for w in windows.values())


def test_one_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(f"{rng.choice('abcdefg')}{rng.choice(['ron', 'lis', 'ta'])}{rng.randrange(10)}" for _ in range(1_500_000))
    d = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    n = len(library_ids("byte_bpe_50k.json", [text])[0]) + 1
    assert packing.pack(d, lambda: public_path("byte_bpe_50k.json")).filter("doc_id = 1").agg(F.sum("length")).first()[0] == n
    files = bitplanes.write_files(d, lambda: public_path("word_bpe_49k.json"))
    assert {r.doc_id: r.n_tokens for r in bitplanes.read_documents(files).collect()}[2] == 2


# ---- 6 --------------------------------------------------------------------------------------


def test_bagminhash_is_unbiased():
    rng, errors = random.Random(3), []
    for _ in range(60):
        a = [f"w{rng.randrange(900)}" for _ in range(200)] + "p q r s t".split() * rng.randrange(30)
        b = list(a)
        for _ in range(rng.randrange(25)):
            b[rng.randrange(len(b))] = "other"
        x, y = bagminhash.bag(" ".join(a)), bagminhash.bag(" ".join(b))
        s = bagminhash.signatures([x, y])
        errors.append((s[0] == s[1]).mean() - bagminhash.overlap(x, y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def brute_classes(rows):
    bags = {i: bagminhash.bag(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in rows:
        for j, u in rows:
            if i < j and (t == u or bagminhash.overlap(bags[i], bags[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("split_over", [4096, 4])
def test_near_duplicates_equal_brute_force(spark, docs, split_over):
    rng = random.Random(9)
    base, rows = prose(rng, 200), [r for r in ordered(docs.dropDuplicates(["doc_id"])) if len(r[1]) < 20_000]
    for i in range(25):
        w = base.split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), split_over=split_over).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows) and len(got) == len(rows)


@pytest.mark.parametrize("split_over", [4096, 20])
def test_near_duplicates_link_twins_at_the_edge_of_a_family(spark, split_over):
    """Pairs that are near each other, but only seem near the family whose buckets they share."""
    rng = random.Random(4)
    base, rows = prose(rng, 240).split(), []
    for i in range(60):
        rows.append((2 * i, " ".join([*base[:-1], f"end{i}"])))
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(0, 235, 5), 6):
            w[k] = f"edge{i}"
        rows += [(1000 + 2 * i, " ".join(w)), (1001 + 2 * i, " ".join([*w, "more"]))]
    # one band key for all: the worst bucket
    bags = [bagminhash.bag(t) for _, t in rows]
    sig = (bagminhash.signatures(bags) & 255).astype(np.uint8)
    name = {i: bytearray(i.to_bytes(16, "big")) for i, _ in rows}
    signed = spark.createDataFrame([(name[i], [7], bytearray(x.tobytes()), len(b[0])) for (i, _), x, b in zip(rows, sig, bags)], "node binary, bands array<long>, sig binary, size long")
    roots = bagminhash.linked_roots(signed, spark.createDataFrame([(name[i], t) for i, t in rows], "node binary, text string"), 0.8, 0.675, split_over)
    got = {i: i for i, _ in rows} | {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in roots.collect()}
    assert got == brute_classes(rows) and len(set(got.values())) > 10


def test_near_duplicates_recall_at_the_threshold(spark):
    """Families whose members lie about the threshold from each other: against brute force over all pairs."""
    rng, rows = random.Random(21), []
    for f in range(12):
        base = prose(rng, rng.randrange(60, 260)).split()
        for k in range(30):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 22))):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[f"e{f}x{k}"], [], [w[at], f"more{k}"], [w[at]] * 2])
            rows.append((100 * f + k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_a_repeated_id(spark):
    rng = random.Random(2)
    one, two = prose(rng, 50), prose(rng, 50)
    rows = [(1, one, 0), (1, two, 1), (1, two, 1), (2, one, 2), (3, two + " x", 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `row` int")
    assert bagminhash.near_duplicates(d).count() == 5
    assert sorted(r.row for r in bagminhash.keep_one_of_each(d).collect()) == [0, 1]


def test_near_duplicates_awkward_rows(spark, docs):
    assert bagminhash.near_duplicates(nothing(spark)).count() == 0
    assert bagminhash.near_duplicates(with_null_id(spark)).count() == 2
    kept = bagminhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute_classes([(i, t) for i, t in set(ordered(docs)) if len(t) < 10**6]).values()))


# ---- 7 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [True, False])
def test_bitplanes_round_trip(spark, docs, bits):
    rows = ordered(docs)
    want, at = [], 0
    for (i, _), x in zip(rows, library_ids("word_bpe_49k.json", [t for _, t in rows])):
        x = np.append(x, 1).astype("<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    files = bitplanes.write_files(docs, lambda: public_path("word_bpe_49k.json"), block=512, bits=bits)
    assert sorted(tuple(r) for r in bitplanes.read_documents(files).collect()) == sorted(want)
    assert bitplanes.read_documents(bitplanes.write_files(nothing(spark), lambda: "")).count() == 0


def test_bitplanes_seek_and_damage():
    ids = np.random.default_rng(0).integers(0, 49408, 5000).astype(np.uint32)
    w = bitplanes.PlaneWriter(block=700)
    for a, b in ((0, 10), (10, 10), (10, 4000), (4000, 5000)):
        w.add(a, ids[a:b])
    data = w.close()
    r = bitplanes.PlaneReader(data)
    assert (r.read(650, 800) == ids[650:1450]).all() and [x[0] for x in r.documents()] == [0, 10, 10, 4000]
    with pytest.raises(Exception):
        bitplanes.PlaneReader(data[:100] + bytes([data[100] ^ 255]) + data[101:]).read(0, 5000)


# ---- 8 --------------------------------------------------------------------------------------


def test_rollup_deltas_and_replays(spark):
    change = "change string, doc_id long, source string, lang string, tokenizer string, tokens long, seq int"
    r = rollups.Rollup(spark, scratch_path(spark, "test-rollup"))
    one = spark.createDataFrame([("insert", 1, "a", "en", "v1", 10, 0), ("insert", 2, "a", None, "v1", 5, 0), ("insert", 2, "a", None, "v1", 7, 1), ("insert", None, "b", "en", "v1", 3, 0), ("delete", 9, "a", "en", "v1", 1, 0)], change)
    assert r.commit("one", one) and not r.commit("one", one)
    two = spark.createDataFrame([("revise", 1, "b", "en", "v1", 12, 0), ("delete", 2, None, None, "v1", None, 0), ("insert", 1, "b", "en", "v2", 99, 0)], change)
    assert r.commit("two", two) and not r.commit("two", two)
    assert sorted(tuple(x) for x in r.totals().collect()) == [("b", "en", "v1", 2, 15), ("b", "en", "v2", 1, 99)]


def test_rollup_of_awkward_documents(spark, docs):
    total = rollups.corpus_rollup(docs).filter("tokenizer = 'bytes-v1'").agg(F.sum("tokens")).first()[0]
    assert total == sum(len(t.encode()) for t in {t for _, t in ordered(docs)})
    assert rollups.corpus_rollup(nothing(spark)).count() == 0


# ---- 9 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"partition_order": 3}, {"lpc_order": 8}, {"lpc_order": 4, "partition_order": 2, "block": 256}, {"block": 16}])
def test_flac_round_trip(options):
    rng = np.random.default_rng(0)
    payloads = [bytes(64), rng.integers(0, 256, 5056, dtype=np.uint8).tobytes(), (128 + 50 * np.sin(np.arange(9984) / 9)).astype(np.uint8).tobytes(), bytes([0, 255] * 512), bytes([0] * 4000 + [255] + [0] * 95)]
    streams = flac.encode_many(payloads, **options)
    assert [p.tobytes() for p in flac.decode_many(streams)] == payloads
    assert flac.read_samples(streams[2], 777, 4000).tobytes() == payloads[2][777:4777]
    bad = bytearray(streams[1])
    bad[-40] ^= 4
    with pytest.raises(ValueError):
        flac.decode_many([bytes(bad)])


def test_flac_without_a_seek_table():
    rng = np.random.default_rng(5)
    tricky = rng.integers(0, 256, 6000, dtype=np.uint8)
    for at in range(0, 5900, 61):  # look-alikes of headers in verbatim samples
        tricky[at : at + 7] = np.frombuffer(flac.frame_header(at // 61 % 7, 1024)[:7], dtype=np.uint8) ^ 128
    for payload in (tricky.tobytes(), bytes(64), (128 + 50 * np.sin(np.arange(9984) / 9)).astype(np.uint8).tobytes()):
        stream = flac.encode_many([payload])[0]
        info = flac.StreamInfo(stream)
        bare = bytearray(stream[: 4 + 4 + 34] + stream[info.frames_at :])
        bare[4] |= 128
        again = flac.StreamInfo(bytes(bare))
        assert again.points == info.points
        assert flac.decode_many([bytes(bare)])[0].tobytes() == payload
        assert flac.read_samples(bytes(bare), 10, 50).tobytes() == payload[10:60]


def test_flac_describes_every_text(spark, docs):
    got = sorted(flac.describe(flac.store(docs)).collect(), key=lambda r: (r.doc_id, r.n_bytes))
    for (i, t), r in zip(ordered(docs), got, strict=True):
        raw = flac.pad(t.encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(t.encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    media = flac.store(docs.filter("doc_id = 15"))
    blocks = sorted(flac.pcm_blocks(media).collect(), key=lambda r: r.sample_offset)
    assert b"".join(b.pcm for b in blocks) == flac.pad(next(t for i, t in ordered(docs) if i == 15).encode())
    assert flac.describe(flac.store(nothing(spark))).count() == 0


# ---- 10 -------------------------------------------------------------------------------------


def test_warc_revisits(spark):
    same, small = "x" * 100, "y" * 99
    rows = [(5, "http://a/", same), (3, "http://b/\r\nX: 1", same), (9, None, same), (1, "u", small), (2, "u", small), (4, "u", None), (None, "u", same), (3, "http://b/", same), (7, "u", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("records", F.lit("clash"))
    archives = warc.write_archives(pages, max_archive=500)
    got = sorted((tuple(r) for r in warc.read_resolved(archives).collect()), key=str)
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), sha(h), "revisit" if i in (5, 9) else "response", 3 if i in (5, 9) else None) for i, _, h in rows]
    assert got == sorted(want, key=str)
    for r in archives.collect():
        spans = list(warc.split_members(bytes(r.data)))
        assert len(spans) == r.records and sum(n for _, n in spans) == len(r.data)
    assert warc.read_resolved(warc.write_archives(nothing(spark).select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("lang").alias("html")))).count() == 0


def near_copy(rng, text, share):
    """The text with a share of its words replaced, wherever they stand."""
    return "\n".join(" ".join(prose(rng, 1) if rng.random() < share else w for w in line.split()) for line in text.split("\n"))


def test_line_templates_against_planted_lines(spark):
    """Headers, footers and licence blocks of 1 to 10 lines, passages, lines that a family of near copies holds too, and fields; the rest is clean."""
    rng, planted, rows = random.Random(33), set(), []
    blocks = [[prose(rng, rng.randint(3, 14)) for _ in range(n)] for n in (1, 2, 3, 5, 10)]
    passages = [prose(rng, n) for n in (52, 60, 75)]
    for b in blocks:
        planted |= set(b)
    planted |= set(passages)
    for i in range(300):
        lines = [prose(rng, rng.randint(6, 40)) for _ in range(rng.randint(6, 14))]
        if i % 3 < 2:
            block = blocks[rng.randrange(5)]
            lines = [*block, *lines] if rng.random() < 0.5 else [*lines, *block]
        if i % 40 < 3:
            lines.insert(rng.randrange(len(lines)), passages[i % 40])
        if i % 5 == 0:
            lines.append(f"Page {i} of 300 was printed for reader{i} on request")
        rows.append("\n".join(lines))
    for share in (0.01, 0.03, 0.06):  # families of near copies, some with a planted block that others have too
        base = "\n".join([*(prose(rng, 25) for _ in range(10)), *blocks[2]])
        rows += [near_copy(rng, base, share).rsplit("\n", 3)[0] + "\n" + "\n".join(blocks[2]) for _ in range(60)]
    base = "\n".join(prose(rng, 60) for _ in range(6))
    pairs = [(base, near_copy(rng, base, 0.02)) for base in ("\n".join(prose(rng, 60) for _ in range(6)) for _ in range(25))]
    rows += [t for p in pairs for t in p]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: collections.Counter(r.text.split("\n")) for r in line_templates.drop_boilerplate(d).collect()}
    found = clean = kept = total = 0
    for i, text in enumerate(rows):
        for line in set(text.split("\n")):
            if line in planted or line.startswith("Page "):
                total += 1
                found += got[i][line] == 0
            else:
                clean += 1
                kept += got[i][line] > 0
    assert total > 1200 and clean > 4000
    assert found >= 0.95 * total
    assert kept >= 0.99 * clean


def test_line_templates_need_independent_documents(spark):
    """Whole lines without fields: ten independent documents for short lines, fewer for longer ones, two for passages; null ids share nothing."""
    rng, rows = random.Random(35), []
    cases = [(9, 4), (10, 4), (5, 30), (6, 30), (2, 49), (2, 50), (1, 80)]
    marked = [(n, prose(rng, size), size) for n, size in cases]
    for n, line, _ in marked:
        for _ in range(n):
            rows.append((None if n == 6 else len(rows), "\n".join((prose(rng, 20), line, prose(rng, 15), prose(rng, 30)))))
    family = "\n".join([*(prose(rng, 20) for _ in range(8)), marked[1][1]])
    rows += [(1000 + i, near_copy(rng, family.rsplit("\n", 1)[0], 0.01) + "\n" + marked[1][1]) for i in range(50)]  # near copies hide nothing
    got = line_templates.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    left = collections.Counter(line for r in got for line in r.text.split("\n"))
    for n, line, size in marked:
        need = max(2, min(10, math.ceil(10 - (min(size, 63) - 10) * 8 / 40)))
        assert left[line] == (n if n < need else 0), (n, size)


def test_contraction_counts_families(spark):
    rows = [("t", i, i, i, i) for i in range(7)] + [("t", 100 + (i == 3), 100 + (i == 5), 100 + i * (i > 5), 100) for i in range(30)] + [("u", 1, 2, 3, 4)]
    got = {r.template: (r.docs, r.independent) for r in line_templates.independent(spark.createDataFrame(rows, "template string, a0 long, a1 long, a2 long, a3 long")).collect()}
    assert got == {"t": (37, 8), "u": (1, 1)}


CLASHES = ["hit", "hit_id", "__hit", "n_lines", "n_dropped", "score", "lang_pred", "n_words", "certainty", "node", "root", "size", "bands"]


def test_stages_leave_clashing_columns_alone(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(i, prose(rng, 30) + "\n" + prose(rng, 20), "en", "s", None, *range(i, i + len(CLASHES))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        assert sorted(tuple(r)[5:] for r in out.collect()) == sorted(r[5:] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, d, "").select("doc_id").distinct().count() == 30
    assert line_templates.drop_boilerplate(d).columns[-2:] == ["n_lines", "n_dropped"]
    blank = d.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, blank, "").count() == 30
    assert bagminhash.near_duplicates(d).columns == ["doc_id", "class_id", "copy_of"]


# ---- pipeline -------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns and 0.5 * before < docs.count() <= before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
