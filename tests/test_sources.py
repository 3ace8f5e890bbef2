"""Readers, normalisers, stores and limits."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators.retrieval import bm25_top_k, build_index
from quillspan.sources import providers, records, store
from quillspan.streaming.evidence import evidence_states


def test_json_lines_split_at_newlines_only(spark, tmp_path):
    rows = [{"id": "a", "text": "x y"}, {"id": "b", "text": "z"}]
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n")
    assert records.read_jsonl(spark, str(p)).orderBy("id").collect()[0].text == "x y"
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"questions": rows}, indent=1))
    assert records.read_json(spark, str(w)).count() == 2
    assert [r.line_no for r in records.numbered_lines(spark, str(p)).orderBy("line_no").collect()] == [0, 1]


def test_normalisers(spark):
    d = spark.createDataFrame([("", "q?", "yes", 3), ("k", "", None, 4)], "id string, question string, answer string, place int")
    got = records.normalize_questions(d.withColumn("input", F.lit("from input"))).collect()
    assert (got[0].id, got[0].question, got[0].answers) == ("q-3", "q?", ["yes"]) and (got[1].id, got[1].question, got[1].answers) == ("k", "from input", [])
    p = spark.createDataFrame([(["a", "b"], "T", 0)], "text array<string>, title string, place int")
    assert tuple(records.normalize_passages(p).first()) == ("T#0", "a b", "T")


def test_canonical_ids(spark):
    d = spark.createDataFrame([("hotpotqa:Star Wars: Episode IV:Star Wars: Episode IV#0",), ("2wikimultihop:A:B#0#chunk-2",), ("plain#0",)], "i string")
    assert [r.c for r in d.select(T.canonical_id(F.col("i")).alias("c")).collect()] == ["Star Wars: Episode IV#0", "B#0", "plain#0"]


def test_chunks(spark):
    words = [f"w{i}" for i in range(23)]
    d = spark.createDataFrame([(0, "  " + " ".join(words) + " "), (1, "a  b")], "id long, text string")
    got = T.chunks(d, 10, 4).orderBy("id", "chunk_no").collect()
    assert [(r.token_start, r.token_end) for r in got] == [(0, 10), (6, 16), (12, 22), (18, 23), (0, 2)]
    assert got[3].text == " ".join(words[18:]) and got[4].text == "a  b"


def test_answer_spans(spark):
    cases = {"<think>no</think> <answer>Rome</answer>": "Rome", "thoughts</think> Final answer: `Paris`": "Paris", "Some words\nOslo done": "Oslo", "plain": "plain"}
    d = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r.a for r in d.select(T.answer_span(F.col("t")).alias("a")).collect()] == list(cases.values())


def test_index_is_reused_and_rebuilt(spark, tmp_path):
    passages = spark.createDataFrame([(0, "alpha fact"), (1, "beta fact")], "pos long, text string")
    path = str(tmp_path / "index")
    assert store.open_or_build(spark, path, passages, build_index)[1] == "absent"
    assert store.open_or_build(spark, path, passages, build_index)[1] == "reused"
    changed = spark.createDataFrame([(0, "alpha fact"), (1, "beta tale")], "pos long, text string")
    assert store.open_or_build(spark, path, changed, build_index)[1] == "checksum"
    other = spark.createDataFrame([(0, "alpha fact"), (2, "beta tale")], "pos long, text string")
    assert store.open_or_build(spark, path, other, build_index)[1] == "passage_ids"
    assert store.open_or_build(spark, path, other.limit(1), build_index)[1] == "passage_count"
    assert store.open_or_build(spark, path, other, build_index, store.Identity(split="dev"))[1] == "split"
    assert store.open_or_build(spark, path, other.limit(0), build_index, store.Identity(split="dev"))[1] == "passage_count"


def _hits(index, spark):
    q = spark.createDataFrame([(0, "beta word3"), (1, "alpha tale")], "query_id int, query string")
    return sorted(tuple(r) for r in bm25_top_k(index, q, 5).select("query_id", "pos", "rank", F.round("score", 9)).collect())


def test_one_change_builds_one_range_and_readers_keep_their_snapshot(spark, tmp_path):
    rows = [(i, f"alpha word{i} beta" if i % 3 else f"tale {i} word3") for i in range(200)]
    passages = spark.createDataFrame(rows, "pos long, text string")
    path, seen = str(tmp_path / "index"), []

    def build(p):
        seen.append(p.count())
        return build_index(p)

    index, _ = store.open_or_build(spark, path, passages, build)
    old = _hits(index, spark)
    changed = spark.createDataFrame([*rows[:7], (7, "beta beta word3 tale"), *rows[8:]], "pos long, text string")
    new, why = store.open_or_build(spark, path, changed, build)
    assert why == "checksum" and seen[0] == 200 and seen[1] < 40 and len(store.corpus_manifest(spark, path)["built"]) == 1
    assert _hits(new, spark) == _hits(build_index(changed), spark) != old
    assert _hits(index, spark) == old  # the snapshot that the reader opened is still whole


def test_a_broken_write_and_a_lost_race_change_nothing(spark, tmp_path):
    passages = spark.createDataFrame([(i, f"alpha word{i}") for i in range(30)], "pos long, text string")
    path = str(tmp_path / "index")
    index, _ = store.open_or_build(spark, path, passages, build_index)
    before, first = _hits(index, spark), store.current_snapshot(spark, path)

    def breaks(p):
        raise RuntimeError("executor lost")

    more = passages.unionByName(spark.createDataFrame([(99, "beta")], "pos long, text string"))
    with pytest.raises(RuntimeError):
        store.open_or_build(spark, path, more, breaks)
    assert store.current_snapshot(spark, path) == first and _hits(store.load_index(spark, path, passages), spark) == before

    left = [9, 1]

    def overtaken(p):
        if left[-1]:
            left[-1] -= 1
            store.save_index(passages, path, build_index)  # another writer commits meanwhile
        return build_index(p)

    index, why = store.open_or_build(spark, path, more, overtaken)  # looks again and builds on what the other left
    assert why == "passage_count" and store.corpus_manifest(spark, path)["passages"] == 31 and _hits(index, spark) == _hits(build_index(more), spark)
    left.pop()
    assert store.open_or_build(spark, path, passages, overtaken)[1] == "passage_count"  # what the other writer committed fits
    assert left == [8] and store.load_index(spark, path, passages) and store.corpus_manifest(spark, path)["passages"] == 30
    with pytest.raises(store.IndexMismatch, match="concurrent_commit"):
        store.save_index(passages, path, overtaken)
    (tmp_path / "index" / "pointers" / "000000000077").write_text("")  # a pointer that its writer never finished
    assert store.load_index(spark, path, passages)


def test_vector_cache_and_cost_gate(spark):
    passages = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, "c")], "pos long, text string")
    empty = spark.createDataFrame([], "key string, vector array<double>")
    full = store.fill_cache(passages, empty, providers.hashed_embedding)
    assert full.count() == 2 and store.missing_vectors(passages, full).count() == 0
    with pytest.raises(store.BuildTooExpensive):
        store.fill_cache(passages, empty, providers.hashed_embedding, batch=1, most_minutes=0.01, per_minute=60)


def test_retries_limits_and_redaction():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ProviderError(503)
        return "ok"

    assert providers.with_retries(flaky, sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(providers.ProviderError):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.ProviderError(404)), sleep=waits.append)
    assert json.loads(providers.trace_event("chat", {"api_key": "s", "q": [1]}, {}, 2.0))["request"] == {"api_key": "***", "q": [1]}


def test_archives_stay_inside(tmp_path):
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        records.extract_archive(bad, tmp_path / "out")


def test_dense_positions(spark):
    d = spark.createDataFrame([(x,) for x in "dbca"], "k string")
    assert [(r.k, r.pos) for r in records.dense_positions(d, ["k"]).orderBy("pos").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_states_of_a_stream(spark, tmp_path):
    schema = "requirement_id string, covered int, total int, any_evidence boolean"
    spark.createDataFrame([("r1", 2, 2, True), ("r2", 0, 2, True)], schema).write.parquet(str(tmp_path / "in"))
    stream = evidence_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert {r.requirement_id: r.status for r in spark.table("states").collect()} == {"r1": "satisfied", "r2": "partial"}
