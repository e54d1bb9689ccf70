"""What a section's text says of itself: the first so many finds of each family, in order of appearance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrite.functions import text as T

#: Patterns and phrases of the families, and how many finds of each count.
KEYWORD = r"[a-zA-Z][a-zA-Z0-9\-]{3,}"
TECHNICAL = r"\b(?:[A-Z]{2,}|[A-Za-z]+(?:\d+[A-Za-z]*|\-[A-Za-z]+)+)\b"
ENTITY = r"\b([A-Z][a-z]{2,}(?:[A-Z][a-z]*)*|[A-Z]{2,})\b"
DEFINITION = r"([A-Za-z][A-Za-z0-9 \-]{2,40}?)\s+(?:is|are|refers to|denotes)\s+([^.]{10,120})\.|([A-Z][A-Za-z0-9\- ]{2,30}?):\s+([^.]{10,120})\."
CLAIM = r"(?i)(?:We show|We demonstrate|Our results|This paper|We prove|This work|We find|We observe)\b[^.]{10,200}\."
METHOD = r"(?i)(?:we propose|we present|we introduce|our approach|our method|our algorithm|this method|this approach|the proposed|we use|we employ)\b"
LIMITATION = ("however", "limitation", "drawback", "constrain", "restrict", "assumption", "not applicable", "does not", "cannot", "fail", "weakness")
PERFORMANCE = r"([A-Za-z][A-Za-z0-9\- ]{0,40}?)\s+(?:of|at|reaches|achieves|improves|outperforms)?\s*(\d[\d.,]*\s*(?:%|percentage points?|pp|x|×|times?))(?:\s+([^.]{0,80}))?"
MOST = {"keyword": 8, "technical": 6, "entity": 8, "definition": 4, "claim": 4, "method": 3, "limitation": 3, "performance": 4}


def _groups(text: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]


def _either(a: Column, b: Column) -> Column:
    return F.when(F.trim(a) != "", F.trim(a)).otherwise(F.trim(b))


def keywords(text: Column) -> Column:
    return F.slice(F.array_distinct(F.transform(_groups(text, KEYWORD, 0)[0], F.lower)), 1, MOST["keyword"])


def technical_keywords(text: Column) -> Column:
    return F.slice(F.array_distinct(_groups(text, TECHNICAL, 0)[0]), 1, MOST["technical"])


def entities(text: Column) -> Column:
    return F.slice(F.array_distinct(_groups(text, ENTITY, 1)[0]), 1, MOST["entity"])


def definitions(text: Column) -> Column:
    """Array of (term, definition)."""
    found = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(_groups(text, DEFINITION, 1, 2, 3, 4))]), lambda z: F.struct(_either(z["g0"], z["g2"]).alias("term"), _either(z["g1"], z["g3"]).alias("definition")))
    return F.slice(F.filter(found, lambda d: (d["term"] != "") & (d["definition"] != "")), 1, MOST["definition"])


def claims(text: Column) -> Column:
    return F.slice(F.transform(_groups(text, CLAIM, 0)[0], lambda c: F.trim(c)), 1, MOST["claim"])


def methods(text: Column) -> Column:
    """Array of (name, description): the first six words, the first 200 characters of the sentence."""
    found = F.slice(F.filter(T.sentences_of_prose(text), lambda s: s.rlike(METHOD)), 1, MOST["method"])
    words = lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")
    return F.transform(found, lambda s: F.struct(F.array_join(F.slice(words(s), 1, 6), " ").alias("name"), F.left(F.trim(s), F.lit(200)).alias("description")))


def limitations(text: Column) -> Column:
    says = lambda s: reduce(Column.__or__, (F.lower(s).contains(p) for p in LIMITATION))
    return F.transform(F.slice(F.filter(T.sentences_of_prose(text), says), 1, MOST["limitation"]), lambda s: F.left(F.trim(s), F.lit(200)))


def performance_facts(text: Column) -> Column:
    """Array of (metric, value, context); a context that isn't there is null."""
    found = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(_groups(text, PERFORMANCE, 1, 2, 3))]), lambda z: F.struct(F.trim(z["g0"]).alias("metric"), F.trim(z["g1"]).alias("value"), F.nullif(F.trim(z["g2"]), F.lit("")).alias("context")))
    return F.slice(F.filter(found, lambda p: (p["metric"] != "") & (p["value"] != "")), 1, MOST["performance"])


def summaries(said: Column, text: Column) -> dict[str, Column]:
    """A detailed and a compact summary: what a model said if that is long enough, else the beginning of the text."""
    told = F.trim(said)
    begin = lambda mark, n: F.when(F.trim(F.left(text, F.lit(n))) != "", F.concat(F.lit(f"[{mark}] "), F.trim(F.left(text, F.lit(n))))).otherwise(f"[{mark}] (empty section)")
    detailed = F.when(F.length(told) > 40, F.left(told, F.lit(300))).otherwise(begin("summary", 120))
    compact = F.when(F.length(told) > 10, F.trim(F.left(F.substring_index(told, ".", 1), F.lit(100)))).otherwise(begin("compact", 60))
    return {"detailed": detailed, "compact": compact}
