"""Rollups against full recounts: tokenizer versions, compaction, writers that overtake each other."""

import random

from tokenizers import Tokenizer

from quillspan.llm import rollups
from quillspan.llm.common import scratch_path
from quillspan.llm.encoders import public_path

CHANGE = "change string, doc_id long, source string, lang string, tokenizer string, tokens long, seq int"


def plain(totals):
    return {tuple(r[k] for k in rollups.KEYS): (r.docs, r.tokens) for r in totals.collect()}


def test_random_batches_equal_a_recount_with_compaction(spark):
    rng, r = random.Random(8), rollups.Rollup(spark, scratch_path(spark, "rollup-test"), compact_every=3)
    state, loose = {}, {}
    for b in range(9):
        rows = []
        for seq in range(rng.randint(0, 12)):
            doc, key = rng.choice([None, *range(6)]), (rng.choice(["s", None]), rng.choice(["en", "fr"]), rng.choice(["v1", "v2"]))
            change, n = rng.choice(["insert", "revise", "delete"]), rng.randint(0, 50)
            rows.append((change, doc, *key, n, seq))
            if doc is None:
                d, t = loose.get(key, (0, 0))
                loose[key] = (d - 1, t - n) if change == "delete" else (d + 1, t + n)
            elif change == "delete":
                state.pop((doc, key[2]), None)
            else:
                state[doc, key[2]] = (key, n)
        df = spark.createDataFrame(rows, CHANGE)
        assert r.commit(f"b{b}", df) and not r.commit(f"b{b}", df)
    want = dict(loose)
    for key, n in state.values():
        d, t = want.get(key, (0, 0))
        want[key] = (d + 1, t + n)
    assert plain(r.totals()) == {k: v for k, v in want.items() if v != (0, 0)}
    done = r.commits()
    assert sum(c["compacts"] for c in done) >= 2 and [c["number"] for c in done] == list(range(len(done)))


def test_two_writers_cannot_both_win(spark):
    root = scratch_path(spark, "rollup-race")
    one, two = rollups.Rollup(spark, root), rollups.Rollup(spark, root)
    batch = lambda doc, n: spark.createDataFrame([("insert", doc, "s", "en", "v", n, 0)], CHANGE)
    publish = one._publish

    def overtaken(*args):
        one._publish = publish
        assert two.commit("other", batch(1, 100))  # commits between the other's look-up and its commit
        return publish(*args)

    one._publish = overtaken
    assert one.commit("mine", batch(1, 7))
    assert plain(one.totals()) == {("s", "en", "v"): (1, 7)} and [c["batch_id"] for c in one.commits()] == ["other", "mine"]
    one._publish = lambda *args: two.commit("same", batch(2, 5)) and publish(*args)
    assert not one.commit("same", batch(2, 5))
    assert plain(two.totals()) == {("s", "en", "v"): (2, 12)}


def test_counts_of_a_public_tokenizer_by_version(spark):
    rows = [(1, "Hello tokens", "a", "en"), (2, None, "a", "en"), (3, "mehr Wörter hier", "b", "de"), (None, "loose", "b", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    r = rollups.Rollup(spark, scratch_path(spark, "rollup-tok"))
    for version, name in (("word-49k", "word_bpe_49k.json"), ("byte-50k", "byte_bpe_50k.json")):
        r.commit(version, rollups.tokenizer_feed(docs, lambda name=name: public_path(name), version, "insert"))
    want = {}
    for version, name in (("word-49k", "word_bpe_49k.json"), ("byte-50k", "byte_bpe_50k.json")):
        t = Tokenizer.from_file(public_path(name))
        for _, text, source, lang in rows:
            d, n = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, n + len(t.encode(text or "", add_special_tokens=False).ids))
    assert plain(r.totals()) == want
