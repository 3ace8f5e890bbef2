"""Bounds and independence: tiles of crowded buckets, places of short documents, long segments, archives, token ids at random."""

import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import bagminhash, encoders, langid_crf, packing, sentencepiece_lattice, warc


def test_places_do_not_depend_on_the_next_row():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (1, 2, 2, 3, 7, 1)]
    alone = [int(packing.places([d])[0]) for d in docs]
    for _ in range(5):
        order = rng.permutation(len(docs))
        assert packing.places([docs[i] for i in order]).tolist() == [alone[i] for i in order]


def test_edges_of_very_long_segments(spark):
    rows = spark.range(1).select(*[sentencepiece_lattice._edge(F.lit(e), F.lit(s), F.lit(i)).alias(f"x{n}") for n, (e, s, i) in enumerate([(8_388_610, 8_388_608, 77), (2**31 - 1, 2**31 - 17, 65_535), (1, 0, 0)])])
    back = rows.select(*[F.array(sentencepiece_lattice._end(F.col(c)), sentencepiece_lattice._start(F.col(c)), sentencepiece_lattice._id(F.col(c)).cast("long")).alias(c) for c in rows.columns]).first()
    assert [list(x) for x in back] == [[8_388_610, 8_388_608, 77], [2**31 - 1, 2**31 - 17, 65_535], [1, 0, 0]]
    order = spark.range(1).select(F.array_sort(F.array(*[sentencepiece_lattice._edge(F.lit(e), F.lit(s), F.lit(0)) for e, s in ((5, 4), (5, 2), (4, 3))])).alias("o")).select(F.transform("o", lambda x: sentencepiece_lattice._end(x) * 10 + sentencepiece_lattice._start(x)).alias("o")).first()
    assert list(order.o) == [43, 52, 54]


def test_archives_are_read_in_linear_time():
    def took(n):
        data = b"".join(warc.warc_record(i, "u", b"x" * 400, "d" * 64, None, "2024-01-01T00:00:00Z") for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.iter_records(data)) == n and sum(size for _, size in warc.split_members(data)) == len(data)
        return time.process_time() - began

    took(200)
    small, large = took(4000), took(16_000)
    assert large < 8 * small
    with pytest.raises(ValueError):
        list(warc.iter_records(warc.warc_record(1, "u", b"x" * 5000, "d" * 64, None, "2024")[:-9]))


def test_crowded_buckets_are_dealt_to_bounded_tiles(spark, monkeypatch):
    """One bucket of unlike members: no tile holds more than its two blocks, and every pair of classes meets."""
    rng = np.random.default_rng(2)
    n, split = 1500, 200
    sig = rng.integers(0, 256, (n, 16), dtype=np.uint8)
    met = spark.createDataFrame([(7, bytes([i // 256, i % 256]), sig[i].tobytes(), 10) for i in range(n)], "key long, node binary, sig binary, size long")
    roots = spark.createDataFrame([(bytes([i // 256, i % 256]), bytes([0, 0])) for i in range(1, 300)], "node binary, root binary")
    bags = met.select("node", F.lit(bagminhash.dump_bag((np.arange(3, dtype=np.uint64), np.ones(3, dtype=np.int64)))).alias("bag"))
    seen = []

    def watched(floor):
        def run(batches):
            for (key, part), rows in bagminhash._groups(batches, bagminhash._MEMBER):
                import pyarrow as pa

                hosts, guests = {r[0] for r in rows if not r[4]}, {r[0] for r in rows if r[4]}
                a = [h for h in hosts for _ in guests]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([part] * len(a), a, [g for _ in hosts for g in guests], [len(rows)] * len(a)), (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["key", "node", "sig", "part"])
        return run

    def catch(df, tag):
        seen.append(df)
        raise StopIteration

    monkeypatch.setattr(bagminhash, "_involved", watched)
    monkeypatch.setattr(bagminhash, "_MEMBER_SCHEMA", "key long, node binary, sig binary, part long")
    monkeypatch.setattr(bagminhash, "materialize", catch)
    with pytest.raises((StopIteration, RuntimeError)):
        bagminhash.remaining_links(met, roots, bags, 0.5, 0.8, split)
    pairs = seen[0].toPandas()
    assert pairs["part"].max() <= 1.6 * split
    minors = {bytes([i // 256, i % 256]) for i in range(300, n)}
    met_pairs = set(zip(pairs["node"], pairs["sig"]))
    assert all((bytes([0, 5]), m) in met_pairs for m in minors) and all((a, b) in met_pairs for a in list(minors)[:30] for b in minors)


def test_bulk_ids_equal_the_library_on_random_text():
    from tokenizers import Tokenizer

    rng = random.Random(9)
    pools = [string.ascii_letters + "  ", string.printable, "aeiou stnr'", "äöüßéèçñ  abc", "0123456789 ,.", "日本語テキスト漢字 ", "😀👍🏽 a‍b", "̀́ae \t\n  "]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for pool in pools for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = encoders.public_path(name)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        got = encoders.encoder(path).encode(texts)
        assert all(a == b.tolist() for a, b in zip(want, got, strict=True))


def test_every_language_is_learned_from_a_bounded_sample(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh"[k % 5 : k % 5 + 4]) for _ in range(5)) for _ in range(2000)), f"l{k}") for i, k in enumerate([*range(130)] * 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []

    def keep(sample, **_):
        taken.extend(sample)

    original, langid_crf.train = langid_crf.train, keep
    try:
        langid_crf.fit(d, F.lit(True), sample_chars=2_000_000)
    finally:
        langid_crf.train = original
    assert {lang for lang, _ in taken} == {f"l{k}" for k in range(130)}
    assert sum(len(t) for _, t in taken) <= 2_000_000


