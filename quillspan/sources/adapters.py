"""Question records of five public datasets, raw or converted, from JSON lines of unknown shape.

Each line is parsed once into a VARIANT. What a dataset calls its parts is read by typed paths, which give null where the
shape differs; lists are exploded inside the row; every key that is not known goes to the metadata as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import operation_class
from .records import hop_stratum

PASSAGE = "array<struct<id:string,doc_id:string,text:string>>"
#: Keys with a meaning of their own; all others are metadata.
KNOWN_KEYS = ["id", "_id", "question", "query", "input", "passages", "documents", "context", "answers", "answer", "gold_evidence", "supporting_facts", "gold_plan", "metadata"]
#: Keys of raw records that conversion uses up.
RAW_KEYS = {"musique": ["paragraphs"], "strategyqa": ["qid", "facts"], "drop": ["instruction", "response"]}
METRICS = {"hotpotqa": "f1", "2wikimultihop": "f1", "musique": "f1", "strategyqa": "accuracy", "drop": "drop_f1"}


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _filled(*cells: Column) -> Column:
    """The first cell that is neither null nor empty."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cells])


def _some(*lists: Column) -> Column:
    """The first list that is neither null nor empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in lists])


def _plain(v: Column) -> Column:
    """A scalar as Python writes it."""
    s = _get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "BOOLEAN", F.initcap(s)).otherwise(s)


def _joined(v: Column, path: str) -> Column:
    """A text, or a list of texts joined by blanks."""
    return _filled(F.array_join(_get(v, path, "array<string>"), " "), _get(v, path, "string"))


def _passage(e: Column, place: Column, offset: Column) -> Column:
    """A passage from an object, a [title, sentences] pair or a bare text."""
    doc = _filled(_get(e, "$.doc_id", "string"), _get(e, "$.document_id", "string"), _get(e, "$.title", "string"), F.concat(F.lit("doc-"), place * 10000 + offset))
    text = _filled(*[_joined(e, f"$.{n}") for n in ("text", "paragraph_text", "context", "passage", "document")])
    own = F.coalesce(_filled(_get(e, "$.id", "string"), _get(e, "$.idx", "string")), F.concat(doc, F.lit("#0")))
    title = _get(e, "$[0]", "string")
    pair = F.struct(F.concat(title, F.lit("#0")).alias("id"), title.alias("doc_id"), F.array_join(_get(e, "$[1]", "array<string>"), " ").alias("text"))
    bare = F.struct(F.concat(place, F.lit("#"), offset).alias("id"), F.lit(None).cast("string").alias("doc_id"), _get(e, "$", "string").alias("text"))
    return (
        F.when(_get(e, "$", "map<string,variant>").isNotNull(), F.struct(own.alias("id"), doc.alias("doc_id"), text.alias("text")))
        .when(_get(e, "$[1]", "array<string>").isNotNull(), pair).when(_get(e, "$", "array<variant>").isNull(), bare)
    )


def _passages(v: Column, place: Column) -> Column:
    listed = _some(*[_get(v, f"$.{n}", "array<variant>") for n in ("passages", "documents", "context", "paragraphs")])
    titles, sentences = _get(v, "$.context.title", "array<string>"), _get(v, "$.context.sentences", "array<array<string>>")
    zipped = F.transform(F.arrays_zip(titles.alias("t"), sentences.alias("s")), lambda x: F.struct(F.concat(x["t"], F.lit("#0")).alias("id"), x["t"].alias("doc_id"), F.array_join(x["s"], " ").alias("text")))
    alone = _filled(*[_get(v, f"$.{n}", "string") for n in ("passages", "documents", "context")])
    single = F.array(F.struct(F.concat(F.lit("doc-"), place * 10000, F.lit("#0")).alias("id"), F.concat(F.lit("doc-"), place * 10000).alias("doc_id"), alone.alias("text")))
    found = F.transform(listed, lambda e, i: _passage(e, place, i)).cast(PASSAGE)
    out = F.coalesce(found, F.when(titles.isNotNull(), zipped.cast(PASSAGE)), F.when(F.schema_of_variant(_get(v, "$.context", "variant")) == "STRING", single.cast(PASSAGE)), F.array().cast(PASSAGE))
    return F.filter(out, lambda p: p.isNotNull() & (F.trim(F.coalesce(p["text"], F.lit(""))) != ""))


def _answers(v: Column) -> Column:
    name = F.when(F.map_contains_key(_get(v, "$", "map<string,variant>"), F.lit("answers")), _get(v, "$.answers", "variant")).otherwise(_get(v, "$.answer", "variant"))
    many = F.transform(F.try_variant_get(name, "$", "array<variant>"), _plain)
    return F.filter(F.coalesce(many, F.array(_plain(name)), F.array().cast("array<string>")), lambda a: a.isNotNull())


def _gold(v: Column, dataset: str) -> Column:
    if dataset == "hotpotqa":
        titles = _some(_get(v, "$.gold_evidence.title", "array<string>"), _get(v, "$.supporting_facts.title", "array<string>"))
    elif dataset == "2wikimultihop":
        pairs = _some(_get(v, "$.gold_evidence", "array<variant>"), _get(v, "$.supporting_facts", "array<variant>"))
        titles = F.transform(F.filter(pairs, lambda p: _get(p, "$[0]", "string").isNotNull()), lambda p: _get(p, "$[0]", "string"))
    else:
        titles = F.lit(None).cast("array<string>")
    return F.array_distinct(F.transform(F.coalesce(titles, F.array().cast("array<string>")), lambda t: F.concat(t, F.lit("#0"))))


def adapt_records(lines: DataFrame, dataset: str, split: str, exclude_facts: bool = False) -> DataFrame:
    """(place, id, question, answers, passages, gold_evidence, stratum, available_evidence, metadata, error) of (place, value) lines.

    ``error`` says why a line is no record (not an object; no question), else it is null. Gold evidence is known for hotpotqa and
    2wikimultihop only; a strategyqa record whose passages are bundled facts is marked, and loses them with ``exclude_facts``,
    because facts are no corpus to search. The stratum is the question type, the hops, the answer or the operation, by dataset.
    """
    if dataset not in METRICS:
        raise ValueError(f"unknown dataset {dataset}")
    held = lines.select("place", F.try_parse_json("value").alias("v"))
    v, place = F.col("v"), F.col("place")
    top = _get(v, "$", "map<string,variant>")
    question = _filled(_get(v, "$.question", "string"), _get(v, "$.query", "string"), _get(v, "$.input", "string"))
    own_id = _filled(_get(v, "$.id", "string"), _get(v, "$._id", "string"))
    passages, answers, used = _passages(v, place), _answers(v), RAW_KEYS.get(dataset, [])
    facts = F.lit(None).cast("array<string>")
    if dataset == "strategyqa":
        own_id = _filled(own_id, _get(v, "$.qid", "string"))
        said = F.filter(F.transform(F.split(_get(v, "$.facts", "string"), "[.]"), lambda s: F.trim(s)), lambda s: s != "")
        facts = _some(_get(v, "$.gold_facts", "array<string>"), F.transform(said, lambda s: F.concat(s, F.lit("."))))
    if dataset == "drop":
        prompt = _get(v, "$.instruction", "string")
        paragraph = F.trim(F.regexp_extract(prompt, r"(?s)Paragraph:\s*(.*?)\n+Question:", 1))
        asked = _filled(F.trim(F.regexp_extract(prompt, r"(?s)Question:\s*(.*?)$", 1)), prompt)
        own_id = F.coalesce(own_id, F.when(prompt.isNotNull(), F.concat(F.lit(f"drop_{split}_"), place)))
        doc = F.concat(F.lit("drop_"), place)
        passages = F.when(paragraph != "", F.array(F.struct(F.concat(doc, F.lit("#0")).alias("id"), doc.alias("doc_id"), paragraph.alias("text"))).cast(PASSAGE)).otherwise(passages)
        answers = F.when(prompt.isNotNull(), F.filter(F.array(F.trim(_get(v, "$.response", "string"))), lambda a: a.isNotNull() & (a != ""))).otherwise(answers)
        question = F.coalesce(question, asked)
    extra = F.transform_values(F.map_filter(top, lambda k, x: ~k.isin(*KNOWN_KEYS, *used)), lambda k, x: _get(x, "$", "string"))
    explicit = F.coalesce(F.transform_values(_get(v, "$.metadata", "map<string,variant>"), lambda k, x: _get(x, "$", "string")), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(explicit, lambda k, x: ~F.map_contains_key(extra, k)), extra)
    out = held.select(
        "place", F.coalesce(own_id, F.concat(F.lit("q-"), place)).alias("id"), F.trim(question).alias("question"), answers.alias("answers"), passages.alias("passages"), _gold(v, dataset).alias("gold_evidence"),
        _get(v, "$.type", "string").alias("__type"), _get(v, "$.operation_type", "string").alias("__operation"), facts.alias("gold_facts"), F.coalesce(merged, F.create_map().cast("map<string,string>")).alias("metadata"), top.isNull().alias("__odd"),
    )
    typed = F.coalesce(_filled(F.col("__type")), F.lit("unknown"))
    stratum = {
        "hotpotqa": typed, "2wikimultihop": typed, "musique": hop_stratum(F.col("id")), "strategyqa": F.coalesce(_filled(F.lower(F.trim(F.get("answers", F.lit(0))))), F.lit("unknown")),
        "drop": F.coalesce(_filled(F.col("__operation")), operation_class(F.col("question")), F.lit("unknown")),
    }[dataset]
    bundled = F.exists("passages", lambda p: p["id"].startswith("fact_")) if dataset == "strategyqa" else F.lit(False)
    kept = F.when(bundled & F.lit(exclude_facts), F.array().cast(PASSAGE)).otherwise(F.col("passages"))
    told = F.map_concat(F.map_filter("metadata", lambda k, x: ~k.isin("dataset", "split", "primary_metric")), F.create_map(*[F.lit(x) for x in ("dataset", dataset, "split", split, "primary_metric", METRICS[dataset])]))
    return out.withColumns({"stratum": stratum, "metadata": told, "available_evidence": F.size(kept) > 0, "__kept": kept, "error": F.when(F.col("__odd"), "not an object").when(F.coalesce(F.col("question"), F.lit("")) == "", "no question")}).select(
        "place", "id", "question", "answers", F.col("__kept").alias("passages"), "gold_evidence", "gold_facts", "stratum", "available_evidence", "metadata", "error"
    )
