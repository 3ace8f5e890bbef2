"""Records of unknown shape through the dataset adapters."""

import json

import pytest

from quillspan.sources.adapters import adapt_records


def adapted(spark, dataset, *records, **options):
    lines = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "place long, value string")
    return adapt_records(lines, dataset, "train", **options).orderBy("place").collect()


def test_converted_and_raw_records_agree(spark):
    raw = {"id": "a", "question": "Q?", "answer": "x", "type": "bridge", "context": {"title": ["T", "U"], "sentences": [["One.", "Two."], ["Three."]]}, "supporting_facts": {"title": ["T", "T"], "sent_id": [0, 1]}}
    done = {"id": "a", "question": "Q?", "answers": "x", "type": "bridge", "passages": [{"doc_id": "T", "id": "T#0", "text": "One. Two."}, {"doc_id": "U", "id": "U#0", "text": "Three."}], "gold_evidence": {"title": ["T", "T"], "sent_id": [0, 1]}}
    one, two = adapted(spark, "hotpotqa", raw, done)
    assert one.asDict(recursive=True) | {"place": 0} == two.asDict(recursive=True) | {"place": 0}
    assert [tuple(p) for p in one.passages] == [("T#0", "T", "One. Two."), ("U#0", "U", "Three.")] and one.gold_evidence == ["T#0"] and one.stratum == "bridge"


def test_shapes_that_differ(spark):
    got = adapted(
        spark, "2wikimultihop", {"_id": "p", "input": " Q ", "context": [["T", ["a", "b"]], ["bad"], "bare text", {"title": "V", "text": ["c", "d"]}, 7], "supporting_facts": [["T", 0], [], "x", ["V", 1]], "answers": [1, None, True]},
        {"query": "Q", "context": "whole text", "answer": None}, {"question": ""}, "[1, 2]", "not json", {"question": "Q", "passages": [], "documents": [{"document_id": "d", "document": "t"}], "metadata": {"split": "x", "k": [1], "own": "m"}, "own": {"a": 1}, "n": None},
    )
    assert got[0].id == "p" and got[0].question == "Q" and got[0].answers == ["1", "True"] and got[0].gold_evidence == ["T#0", "V#0"]
    assert [tuple(p) for p in got[0].passages] == [("T#0", "T", "a b"), ("0#2", None, "bare text"), ("V#0", "V", "c d"), ("0#4", None, "7")]
    assert got[1].id == "q-1" and got[1].passages[0].text == "whole text" and got[1].answers == [] and got[1].stratum == "unknown"
    assert [r.error for r in got] == [None, None, "no question", "not an object", "not an object", None]
    assert [tuple(p) for p in got[5].passages] == [("d#0", "d", "t")]
    assert got[5].metadata["own"] == '{"a":1}' and got[5].metadata["k"] == "[1]" and got[5].metadata["split"] == "train" and got[5].metadata["primary_metric"] == "f1"


def test_facts_are_no_corpus(spark):
    record = {"id": "s", "question": "Is it?", "answers": ["Yes"], "passages": [{"id": "fact_0", "text": "One."}], "gold_facts": ["One."]}
    assert len(adapted(spark, "strategyqa", record)[0].passages) == 1
    out = adapted(spark, "strategyqa", record, {"qid": "r", "question": "Q", "answer": False, "facts": "A b. C."}, exclude_facts=True)
    assert out[0].passages == [] and not out[0].available_evidence and out[0].stratum == "yes"
    assert out[1].id == "r" and out[1].answers == ["False"] and out[1].gold_facts == ["A b.", "C."] and out[1].stratum == "false"


def test_other_datasets_and_empty_tables(spark):
    m = adapted(spark, "musique", {"id": "3hop1__9", "question": "Q", "paragraphs": [{"idx": 4, "title": "T", "paragraph_text": "x"}]})[0]
    assert m.stratum == "3hop" and [tuple(p) for p in m.passages] == [("4", "T", "x")]
    d = adapted(spark, "drop", {"instruction": "Paragraph: a b\n\nQuestion: How many?", "response": " 3 "}, {"question": "Who?", "operation_type": "listing", "passages": ["t"]})
    assert (d[0].id, d[0].question, d[0].answers, d[0].stratum) == ("drop_train_0", "How many?", ["3"], "counting") and d[0].passages[0].id == "drop_0#0"
    assert d[1].stratum == "listing" and d[1].passages[0].text == "t"
    with pytest.raises(ValueError):
        adapted(spark, "other", {})
