"""Narrations, overviews, replies of models and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrite.functions import enrich as N
from papyrite.operators import citations as C
from papyrite.operators import encoders as E
from papyrite.operators import replies as R
from papyrite.plans import trees
from papyrite.plans.registry import Registry, table
from papyrite.plans.search import FOUND

REGISTRY = Registry()

_CELLS = "'<table><tr><td>' || left(line, 20) || '</td><th>n' || pos || '</th></tr><tr><td>' || pos || '</td></tr></table>'"
_NOTE = "case when pos % 3 = 0 then ' note ' || pos end"
_TOLD = r"""left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</t[dh]>', ' | ', 'gi'), '</tr>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n\s+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)), 4000)"""


@REGISTRY.query(f"""with {trees._BLOCKS}, said as (select doc_id, page, pos, trim(text) as t, coalesce(sum(length(trim(text)) + 1) over (partition by doc_id, page order by pos rows between unbounded preceding and 1 preceding), 0) as begins from blocks where type in ('paragraph', 'title', 'reference', 'equation', 'image_caption') and trim(text) <> ''),
pages_ as (select doc_id, page, string_agg(t, chr(10) order by pos) as t from said where begins <= 300 group by all), p as (select doc_id, page, case when length(t) > 300 then left(t, 300) || ' …' else t end as t from pages_),
x as (select b.doc_id, b.pos, b.caption, {_NOTE} as footnote, {_CELLS} as html, p.t from blocks b join lines using (doc_id, pos) left join p on p.doc_id = b.doc_id and p.page = b.page where b.type = 'table')
select doc_id, pos, concat_ws(chr(10) || chr(10), nullif(trim(caption), ''), 'Natural-language table description: table rows and columns contain ' || nullif({_TOLD}, ''), 'Footnote: ' || nullif(trim(footnote), ''), 'Same-page context:' || chr(10) || nullif(trim(t), '')) as said from x""")
def table_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each table: caption, cells in words, footnote, and 300 characters of its page."""
    blocks = trees._blocks(spark, sf_dir)
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("document_id", F.col("p").cast("long").alias("pos"), "line")
    tables = blocks.where("block_type = 'table'").select("document_id", "page", F.col("reading_order").alias("pos"), "caption").join(lines, ["document_id", "pos"])
    rows = tables.join(E.page_text(blocks, 300), ["document_id", "page"], "left")
    said = E.table_embedding_text(F.col("caption"), F.expr(_NOTE), F.expr(_CELLS), F.col("page_text"))
    return rows.select(F.col("document_id").alias("doc_id"), "pos", said.alias("said"))


_HASH = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({}))"
_AS_UUID = "lower(substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || substr('89ab', ('0x' || substr({0}, 17, 1))::int % 4 + 1, 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12))"


@REGISTRY.query(f"""with r as (select doc_id, 'document_overview' as source_type, '' as title, coalesce(text, '') as content, 0 as order_index, {_HASH.format("doc_id || ':document_overview'")} as h from documents union all select doc_id, 'chapter_summary', 'Abstract', left(text, 50), 1, {_HASH.format("doc_id || ':abstract'")} from documents where doc_id % 3 = 0),
n as (select *, {_AS_UUID.format('h')} as node from r), i as (select *, {_HASH.format("doc_id || ':' || source_type || ':' || node || ':0'")} as k from n) select doc_id, {_AS_UUID.format('k')} as id, node, source_type, title, content, order_index::int as order_index from i""")
def overview_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk of each document's overview, and one of its abstract where there is one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("overview"), F.when(F.col("doc_id") % 3 == 0, F.left("text", F.lit(50))).alias("abstract"), F.lit(None).cast("string").alias("abstract_node"))
    return E.overview_chunks(docs).select(F.col("document_id").alias("doc_id"), "id", "node", "source_type", "title", "content", "order_index")


def _tops(column: str, n: int, most: int) -> str:
    return f"select source, array_to_string(list(x order by x) filter (where k <= {most}), ',') as l from (select source, x, row_number() over (partition by source order by encode(x)) as k from (select distinct source, trim(x) as x from (select source, unnest(list_slice(list_filter({column}, lambda x, i: list_position({column}, x) = i), 1, {n})) as x from found) where trim(x) <> '')) group by source"


@REGISTRY.query(f"with {FOUND}, e as ({_tops('e', 8, 20)}), m as ({_tops('t', 6, 10)}) select d.source, coalesce(e.l, '') as entities, coalesce(m.l, '') as methods from (select distinct source from found) d left join e using (source) left join m using (source)".replace("list(x order by x)", "list(x order by k)"))
def overview_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty names and the first ten compounds of each collection."""
    text = F.col("text")
    sections = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), N.entities(text).alias("entities"), N.technical_keywords(text).alias("methods"))
    return E.overview_tops(sections).select(F.col("document_id").alias("source"), F.array_join("entities", ",").alias("entities"), F.array_join("methods", ",").alias("methods"))


#: A reply for each event, good and bad ones, by its number.
_REPLY = """case event_id % 12
when 0 then 'Sure: ```json {"action": "search_more"}'
when 1 then '```json\n{"action": "search_more", "tool_calls": [{"tool": "search_hybrid", "query": "q' || event_id || '"}], "reasoning": "r"}\n```'
when 2 then '{"action": "no_info"}'
when 3 then 'I think {"action": "search_more", "tool_calls": [{"tool": "drop_tables"}]}'
when 4 then '{"action": "answer_now", "tool_calls": [{"tool": "search_hybrid"}]}'
when 5 then '{"action": "search_more", "tool_calls": [{"tool": "inspect_document", "document_id": "not an id"}]}'
when 6 then '{"action": "search_more", "tool_calls": [{"tool": "query_structured_facts", "fact_filter": {"kinds": ["metric"], "keys": ["f1"]}}, {"tool": "grep_document_chunks", "query": "Table ' || event_id || '", "source_types": ["chunk"]}]}'
when 7 then '{"action": "search_more", "chat_id": "x"}'
when 8 then 'no json at all'
when 9 then '{"action": "search_more", "tool_calls": [{"tool": "search_hybrid", "source_types": ["secret"]}]}'
when 10 then '{"action": "search_more", "tool_calls": [{"tool": "search_hybrid", "query": ""}]}'
else '{"action": "search_more", "tool_calls": [' end"""
_WANT = "case event_id % 12 when 0 then 'search_more' when 1 then 'search_more' when 2 then 'no_info' when 4 then 'answer_now' when 6 then 'search_more' else 'answer_now' end"


@REGISTRY.query(f"select event_id, {_WANT} as action, event_id % 12 not in (0, 1, 2, 4, 6) as fallback, case event_id % 12 when 1 then 'search_hybrid/q' || event_id when 6 then 'query_structured_facts/,grep_document_chunks/Table ' || event_id else '' end as calls from events")
def replan_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model's replies decide, broken and forbidden ones among them."""
    replies = table(spark, sf_dir, "events").select(F.col("event_id").alias("question"), F.expr(_REPLY).alias("reply"))
    call = lambda c: F.concat(c["tool"], F.lit("/"), F.coalesce(c["query"], F.lit("")))
    return R.decisions(replies).select(F.col("question").alias("event_id"), "action", "fallback", F.array_join(F.transform("calls", call), ",").alias("calls"))


_CITED = """ev as (select event_id % 500 as question, event_id as seq, 'd' || user_id as document_id, event_type as section, user_id % 7 as page_start, user_id % 7 + 1 as page_end, event_type <> 'error' as shown, 'said ' || event_id as content from events),
n as (select *, row_number() over (partition by question order by seq) as place, case when shown then count(*) filter (where shown) over (partition by question order by seq) end as mark from ev),
ans as (select doc_id as question, 'First [c2], then [c' || (doc_id % 9) || '] and [c2] or [c' || (doc_id % 23) || ']' as answer from documents where doc_id < 500),
m as (select question, list_transform(regexp_extract_all(answer, '\\[c([0-9]+)\\]', 1), lambda x: x::int) as l from ans), k as (select question, list_filter(l, lambda x, i: list_position(l, x) = i) as l from m),
c as (select k.question, i - 1 as nth, l[i] as marker from k, range(1, 4) r(i) where i <= len(l)), cites as (select c.question, nth, marker, n.place, document_id, section, page_start, page_end, content from c left join n on n.question = c.question and n.mark = c.marker)"""


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    evidence = e.select((F.col("event_id") % 500).alias("question"), F.col("event_id").alias("seq"), F.concat(F.lit("d"), "user_id").alias("document_id"), F.col("event_type").alias("section"), (F.col("user_id") % 7).alias("page_start"), (F.col("user_id") % 7 + 1).alias("page_end"), F.concat(F.lit("said "), "event_id").alias("content"))
    i = F.col("doc_id")
    answer = F.concat(F.lit("First [c2], then [c"), i % 9, F.lit("] and [c2] or [c"), i % 23, F.lit("]"))
    answers = table(spark, sf_dir, "documents").where("doc_id < 500").select(i.alias("question"), answer.alias("answer"))
    return C.cite(answers, C.positions(evidence, F.col("section") != "error")), evidence


@REGISTRY.query(f"with {_CITED} select question, nth::int as nth, marker::int as marker, place is not null as valid, place::int as place, document_id, section, page_start, page_end, content as excerpt from cites".replace("\\\\", "\\"))
def citation_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence behind each mark; marks count what was shown, places the whole list."""
    return _cited(spark, sf_dir)[0].select("question", "nth", "marker", "valid", "place", "document_id", "section", "page_start", "page_end", "excerpt")


@REGISTRY.query(f"with {_CITED} select distinct question, document_id from (select question, document_id from cites where place is not null union all select question, document_id from ev)".replace("\\\\", "\\"))
def documents_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each question that are cited or give evidence."""
    return C.documents_used(*_cited(spark, sf_dir))
