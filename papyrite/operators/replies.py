"""Replies of a model as JSON: found in the text around them, parsed, and held to what may be asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.operators.hierarchy import strip

#: Actions, tools, source types and kinds of facts that a decision may name, and how many of each or how long.
ACTIONS = ("search_more", "answer_now", "no_info")
TOOLS = ("search_hybrid", "grep_document_chunks", "fetch_structural_nodes", "query_structured_facts", "inspect_document")
SOURCE_TYPES = ("chunk", "raw_block", "document_overview", "chapter_summary", "compact_chapter_summary", "section_summary", "compact_section_summary", "performance_fact", "table_record", "figure_caption")
FACT_KINDS = ("metric", "benchmark", "dataset", "hyperparameter", "ablation", "other")
MOST_CALLS, MOST_TYPES, MOST_KINDS, MOST_KEYS, QUERY_CHARS, REASON_CHARS = 4, 8, 5, 10, 200, 400
UUID = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
_CALL = "tool string, query string, source_types array<string>, fact_filter struct<kinds: array<string>, keys: array<string>>, document_id string"


def json_in(text: Column) -> Column:
    """The JSON of a reply: fences off, then from the first opening brace to the last closing one; without braces the text as it is."""
    bare = strip(text)
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)
    first, last = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    return F.when((first > 0) & bare.contains("}") & (last >= first), F.substring(bare, first, last - first + 1)).otherwise(bare)


def uuids(items: Column) -> Column:
    """Of an array of texts those that are UUIDs; what isn't is dropped."""
    return F.filter(items, lambda x: x.isNotNull() & x.rlike(UUID))


def whole_numbers(items: Column) -> Column:
    """Of an array of texts the whole numbers; what isn't is dropped."""
    return F.array_compact(F.transform(items, lambda x: x.try_cast("bigint")))


def _only(keys: Column, *names: str) -> Column:
    return F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, names)))) == 0


def _all_in(items: Column, names: tuple[str, ...] | None, most: int) -> Column:
    """Whether a list is short enough and of known names; a missing list is fine."""
    known = F.lit(True) if names is None else F.forall(items, lambda x: x.isNotNull() & x.isin(*names))
    return items.isNull() | ((F.size(items) <= most) & known)


def decisions(replies: DataFrame) -> DataFrame:
    """``question, action, calls, fallback`` of each reply (``question, reply``).

    A decision that isn't JSON, has a further field, names another action, tool, source type or kind, asks for too much
    or too long, or for a document that is no id, is none: the answer is given now, without calls, and ``fallback`` says
    so. Only "search_more" has calls. Null replies fall back as well.
    """
    raw = json_in(F.coalesce("reply", F.lit("")))
    rows = replies.select("question", raw.alias("raw")).withColumn("keys", F.when(F.col("raw").startswith("{"), F.json_object_keys("raw")))
    rows = rows.withColumn("top", F.from_json("raw", "action string, tool_calls array<string>, reasoning string, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    texts = F.coalesce("top.tool_calls", F.array().cast("array<string>"))
    rows = rows.withColumn("texts", texts).withColumn("calls", F.transform("texts", lambda t: F.struct(F.from_json(t, _CALL).alias("c"), F.json_object_keys(t).alias("keys"), F.json_object_keys(F.get_json_object(t, "$.fact_filter")).alias("filter_keys"))))
    call_ok = lambda x: (
        _only(x["keys"], "tool", "query", "source_types", "fact_filter", "document_id") & x["keys"].isNotNull() & F.coalesce(x["c"]["tool"].isin(*TOOLS), F.lit(False)) & (x["c"]["query"].isNull() | F.length(x["c"]["query"]).between(1, QUERY_CHARS))
        & _all_in(x["c"]["source_types"], SOURCE_TYPES, MOST_TYPES) & _only(x["filter_keys"], "kinds", "keys") & _all_in(x["c"]["fact_filter"]["kinds"], FACT_KINDS, MOST_KINDS) & _all_in(x["c"]["fact_filter"]["keys"], None, MOST_KEYS)
        & (x["c"]["document_id"].isNull() | x["c"]["document_id"].rlike(UUID))
    )
    good = F.col("keys").isNotNull() & F.col("top._broken").isNull() & _only(F.col("keys"), "action", "tool_calls", "reasoning") & F.coalesce(F.col("top.action").isin(*ACTIONS), F.lit(False))
    good = good & (F.size("texts") <= MOST_CALLS) & F.coalesce(F.forall("calls", call_ok), F.lit(False)) & (F.length(F.coalesce("top.reasoning", F.lit(""))) <= REASON_CHARS)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    action = F.when(F.col("good"), F.col("top.action")).otherwise("answer_now")
    asked = F.filter(F.transform("calls", lambda x: x["c"]), lambda c: F.col("good") & (F.col("top.action") == "search_more"))
    return rows.select("question", action.alias("action"), asked.alias("calls"), (~F.col("good")).alias("fallback"))
