"""Text preparation as column expressions: tokens, chunks, slot queries, answers, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .values import fold

WORD = r"[\p{L}\p{N}_]+"

# Words that the graph terms leave out.
GRAPH_STOP_WORDS = ["the", "and", "for", "that", "with", "from", "was", "were", "are", "this", "what", "which", "who", "how"]

# Keywords of the operation classes, in order of precedence.
OPERATION_WORDS = {
    "arithmetic": ["how many years", "how much earlier", "how much later", "difference between", "what is the difference"],
    "counting": ["how many", "how much", "number of", "count"],
    "sorting": ["first", "last", "earliest", "latest", "before", "after"],
    "listing": ["list", "name all", "what are all"],
    "comparison": ["more", "less", "greater", "longer", "farther", "higher", "lower"],
}

# Marks of failure causes in error messages, in order of precedence.
FAILURE_MARKS = {
    "provider_http_429": ["429", "rate limit"],
    "provider_http_5xx": ["500", "502", "503", "504", "server error"],
    "provider_connect": ["connecterror", "connection", "dns", "timed out", "timeout"],
    "configuration": ["configuration", "validationerror", "schemaerror", "missing environment"],
}


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def chunks(df: DataFrame, size: int = 384, overlap: int = 64) -> DataFrame:
    """Windows of white-space tokens over ``text``; adds (chunk_no, token_start, token_end), replaces text.

    A text of at most ``size`` tokens stays as it is (chunk_no 0). The last window is the first that
    reaches the end.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the chunk size")
    step = size - overlap
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.size("__w")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    cut = df.withColumn("__w", words).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk_no") * step
    piece = F.when(n <= size, F.col("text")).otherwise(F.array_join(F.slice("__w", start + 1, F.lit(size)), " "))
    return cut.withColumns({"token_start": start, "token_end": F.least(start + size, n), "text": piece}).drop("__w")


def canonical_id(c: Column) -> Column:
    """A passage id without dataset and document prefixes and without a chunk suffix.

    Of ``dataset:doc:doc#n`` the first tail remains whose stem (what stands before its last #) repeats what
    stands between the dataset and it, so titles with colons stay whole; else the last of three or more parts.
    """
    head = F.substring_index(c, "#chunk-", 1)
    parts = F.split(head, ":")
    n = F.size(parts)

    def tail(k: Column) -> Column:
        return F.array_join(F.slice(parts, k + 1, F.greatest(n - k, F.lit(0))), ":")

    def repeats(k: Column) -> Column:
        return F.array_join(F.slice(parts, F.lit(2), k - 1), ":") == F.regexp_replace(tail(k), "#[^#]*$", "")

    hit = F.filter(F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>")), repeats)
    # most ids have no colon: they are not split at all
    return F.when(F.contains(head, F.lit(":")), F.when(F.size(hit) > 0, tail(F.get(hit, F.lit(0)))).when(n >= 3, F.element_at(parts, -1)).otherwise(head)).otherwise(head)


def last_part_id(c: Column) -> Column:
    """The last colon part of an id of three or more parts, else the id."""
    parts = F.split(c, ":")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -1)).otherwise(c)


def lexical(c: Column) -> Column:
    """A slot query in plain words: underscores are blanks, variables are left out."""
    s = F.regexp_replace(F.translate(c, "_", " "), r"(^|\s)\?" + WORD, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def formulate(question: Column, slot_query: Column, variant: str) -> Column:
    """One of the five query variants."""
    forms = {
        "slot": [slot_query],
        "question": [question],
        "question_plus_slot": [question, slot_query],
        "lexical_slot": [lexical(slot_query)],
        "question_plus_lexical_slot": [question, lexical(slot_query)],
    }
    return F.trim(F.concat_ws(" ", *forms[variant]))


def slot_query(predicate: Column, arguments: Column, constraints: Column) -> Column:
    """Predicate, arguments and constraints (a map, as sorted ``k=v``) in one string."""
    pairs = F.transform(F.array_sort(F.map_entries(constraints)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.concat_ws(" ", predicate, F.array_join(arguments, " "), F.nullif(F.array_join(pairs, " "), F.lit("")))


def graph_terms(c: Column) -> Column:
    """Distinct tokens of three or more characters that are not stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(*GRAPH_STOP_WORDS)))


#: Letters in lower case, digits, and a blank for any other character.
_ASCII_WORDS = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}


@F.pandas_udf(StringType())
def ascii_words(s: pd.Series) -> pd.Series:
    """Compatibility-decomposed, ASCII-only, caseless words joined by blanks (needs Unicode tables that Spark lacks)."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        flat = x if x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
        return " ".join(flat.translate(_ASCII_WORDS).split())

    return s.map(one)


def predicate_name(value: str) -> str:
    """A canonical predicate name (driver side)."""
    flat = unicodedata.normalize("NFKC", value).casefold()
    return "_".join("".join(ch if ch.isalnum() else " " for ch in flat).split())


def grounded(value: Column, *sources: Column) -> Column:
    """Whether the value occurs as a run of whole words in the sources (all in their normal form already)."""
    hay = F.concat(F.lit(" "), F.concat_ws(" ", *sources), F.lit(" "))
    return (value != "") & F.contains(hay, F.concat(F.lit(" "), value, F.lit(" ")))


def sentences(c: Column) -> Column:
    return F.split(c, r"""(?<=[.!?])\s+(?=["'A-Z0-9])""")


def anchor_window(text: Column, title: Column, anchors: Column, radius: int = 2) -> Column:
    """Sentences around the first that holds an anchor (around the start if the title is one); null if none does."""
    parts = sentences(text)
    low_title = fold(title)

    def is_title(a: Column) -> Column:
        a = fold(a)
        return (a == low_title) | ((F.length(a) >= 4) & F.contains(low_title, a)) | ((F.length(title) >= 4) & F.contains(a, low_title))

    numbered = F.transform(parts, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    hit = F.get(F.filter(numbered, lambda p: F.exists(anchors, lambda a: F.contains(fold(p["s"]), fold(a)))), F.lit(0))["i"]
    centre = F.when(F.exists(anchors, is_title), F.lit(0)).otherwise(hit)
    first = F.greatest(centre - radius, F.lit(0))
    return F.array_join(F.slice(parts, first + 1, F.when(centre.isNull(), 0).otherwise(centre + radius - first + 1)), " ")


def answer_span(c: Column) -> Column:
    """The answer in a model's reply: thoughts removed, then the last tagged or marked answer."""
    s = F.regexp_replace(c, r"(?is)<think\b[^>]*>.*?</think\s*>", "")
    tag = F.try_element_at(F.regexp_extract_all(s, F.lit(r"(?is)<(?:answer|final|output|result)\b[^>]*>(.*?)</(?:answer|final|output|result)\s*>"), F.lit(1)), F.lit(-1))
    after = F.element_at(F.split(s, r"(?i)</think\s*>"), -1)
    s = F.trim(F.coalesce(tag, after))
    marks = F.split(s, r"(?i)(?:final\s+answer|answer)\s*(?:is)?\s*[:：]")
    s = F.trim(F.element_at(marks, -1))
    lines = F.filter(F.split(s, r"\n"), lambda x: F.trim(x) != "")
    tail = F.trim(F.try_element_at(lines, F.lit(-1)))
    s = F.when((F.size(lines) > 1) & (F.length(tail) <= 256), tail).otherwise(s)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\s*\b(done|end|finished)\.?\s*$", ""), "`", ""))


def squad_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    s = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(a|an|the)\b", " "), r"\s+", " "))


def plain_answer(c: Column) -> Column:
    """Lower-case words joined by blanks; articles stay."""
    return F.array_join(tokens(c), " ")


def vote_answer(c: Column) -> Column:
    """Caseless letters, digits and blanks, without a leading article."""
    s = F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    return F.regexp_replace(s, r"^(a|an|the) ", "")


def truth(c: Column) -> Column:
    """The first true/yes or false/no word as a boolean."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    hit = F.get(F.filter(words, lambda t: t.isin("true", "yes", "false", "no")), F.lit(0))
    return F.when(hit.isin("true", "yes"), True).when(hit.isin("false", "no"), False)


def is_polar(question: Column) -> Column:
    return question.rlike(r"(?i)^\s*(do|does|did|is|are|was|were|can|could|has|have|had|will|would|should)\b") & question.rlike(r"\?\s*$")


def polar_answer(c: Column) -> Column:
    """A leading yes/no/true/false as yes or no; null otherwise."""
    word = F.regexp_extract(F.lower(F.trim(c)), r"^(yes|no|true|false)\b", 1)
    return F.when(word.isin("yes", "true"), "yes").when(word.isin("no", "false"), "no")


def parenthesised_clauses(c: Column) -> Column:
    """All ``clause (...)`` of a text. No match crosses a line, so only lines with both parentheses are searched: elsewhere each clause would be tried from all of its places."""
    lines = F.filter(F.split(c, "\n"), lambda l: F.contains(l, F.lit("(")) & F.contains(l, F.lit(")")))  # noqa: E741
    return F.flatten(F.transform(lines, lambda l: F.regexp_extract_all(l, F.lit(r"([^.!?\n]*\([^\n]*?\))"), F.lit(1))))  # noqa: E741


def unparenthesised(c: Column) -> Column:
    """``Head (12 head ...)`` as its head, where the parenthesis only restates it."""
    head, inside = F.regexp_extract(c, r"^(.*?)\s*\((.*)\)\s*$", 1), F.regexp_extract(c, r"^(.*?)\s*\((.*)\)\s*$", 2)
    return F.when((head != "") & F.contains(F.lower(inside), F.lower(head)), head).otherwise(c)


def surface_variant(value: Column, source: Column) -> Column:
    """The first source word that differs from a one-word value by at most two letters at its end; null if none."""
    words = F.regexp_extract_all(source, F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1))
    low = F.lower(value)

    def near(w: Column) -> Column:
        x = F.lower(w)
        return (x != low) & (F.abs(F.length(x) - F.length(low)) <= 2) & (F.startswith(x, low) | F.startswith(low, x))

    return F.when((F.length(value) >= 5) & ~value.rlike(r"\s"), F.get(F.filter(words, near), F.lit(0)))


def coverage(values: Column, text: Column, empty: float = 0.0) -> Column:
    """Share of the values (in normal form) that stand in the text as whole words."""
    return F.when(F.size(values) == 0, F.lit(empty)).otherwise(F.size(F.filter(values, lambda v: grounded(v, text))) / F.size(values))


def _first_class(low: Column, classes: dict[str, list[str]], other: str) -> Column:
    out = F.lit(other)
    for name, words in reversed(classes.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), name).otherwise(out)
    return out


def operation_class(question: Column) -> Column:
    """The first operation class that has a keyword in the question."""
    return _first_class(F.lower(question), OPERATION_WORDS, "other")


def failure_category(status: Column, error: Column, answer: Column) -> Column:
    """What a run's status, answer and error message say about its outcome."""
    settled = F.when(status == "ok", F.when(F.trim(F.coalesce(answer, F.lit(""))) != "", "ok").otherwise("empty_answer"))
    settled = settled.when(status.isin("empty", "unsupported_operation", "budget_exceeded"), status)
    return settled.otherwise(_first_class(fold(F.coalesce(error, F.lit(""))), FAILURE_MARKS, "other"))


def safe_id(c: Column) -> Column:
    """A file-name prefix of at most 80 characters and 12 hex digits of the SHA-256."""
    return F.concat_ws("-", F.substring(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "-"), 1, 80), F.substring(F.sha2(c, 256), 1, 12))


#: Words that name a role's or a value's gender.
FEMALE_ROLES = ["mother", "grandmother", "wife", "daughter", "sister", "aunt", "niece", "woman", "female"]
MALE_ROLES = ["father", "grandfather", "husband", "son", "brother", "uncle", "nephew", "man", "male"]
FEMALE_MARKERS = ["mrs", "ms", "miss", "lady", "queen", "princess", "duchess", "countess", "baroness", "empress", "mother", "wife", "daughter", "sister", "aunt", "niece"]
MALE_MARKERS = ["mr", "mister", "sir", "lord", "earl", "king", "prince", "duke", "baron", "emperor", "father", "husband", "son", "brother", "uncle", "nephew"]
#: Predicates whose passages are cut to the window about the anchor.
WINDOW_PREDICATES = ["countryof", "countryoforigin", "countryofcitizenship", "nationality"]
MORE_WINDOW_PREDICATES = ["hasnationality", "countryofbirth", "fromcountry", "nationalityof"]


def _has_word(words: Column, listed: list[str]) -> Column:
    return F.arrays_overlap(F.split(words, " "), F.array(*map(F.lit, listed)))


def role_gender(field: Column) -> Column:
    """female, male or null, by the words of a field's name (in normal form)."""
    return F.when(_has_word(field, FEMALE_ROLES), "female").when(_has_word(field, MALE_ROLES), "male")


def role_conflict(field: Column, value: Column) -> Column:
    """Whether a value (in normal form, as the field) bears only markers of the other gender than the field asks for."""
    male, female = _has_word(value, MALE_MARKERS), _has_word(value, FEMALE_MARKERS)
    wanted = role_gender(field)
    return F.coalesce(((wanted == "female") & male & ~female) | ((wanted == "male") & female & ~male), F.lit(False))


def uses_window(predicate: Column, normalised: bool = False) -> Column:
    """Whether a predicate (in normal form) takes the anchor's window of a passage."""
    return F.replace(predicate, F.lit(" "), F.lit("")).isin(*WINDOW_PREDICATES, *(MORE_WINDOW_PREDICATES if normalised else []))
