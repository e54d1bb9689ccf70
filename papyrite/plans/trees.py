"""Trees of typed blocks. A document's lines are its blocks; arithmetic on their places gives them every type there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrite.operators import hierarchy as H
from papyrite.plans.registry import Registry, table

REGISTRY = Registry()

_C = "(doc_id * 7 + pos * 3) % 13"
#: Type, level and text of a line by its place.
_TYPE = f"case when pos = 0 then case when doc_id % 5 = 0 then 'paragraph' else 'title' end when pos = 1 then 'paragraph' when pos = 2 then case when doc_id % 2 = 0 then 'title' else 'paragraph' end when {_C} in (0, 1, 2, 3, 12) then 'title' when {_C} = 4 then 'reference' when {_C} = 5 then 'figure' when {_C} = 6 then 'table' when {_C} = 7 then 'equation' when {_C} = 8 then 'image_caption' when {_C} = 9 then 'discarded' else 'paragraph' end"
_LEVEL = f"case when pos = 0 and doc_id % 5 <> 0 then 1 when pos = 0 or pos = 1 then null when pos = 2 then case when doc_id % 2 = 0 then 2 end when {_C} in (0, 1, 2, 3) then 2 when {_C} = 12 then 1 end"
_TEXT = f"case when pos = 1 and doc_id % 3 = 0 then 'A. Author<sup>1</sup>, ' || left(line, 40) when pos = 2 then case when doc_id % 2 = 0 then ' Abstract' when doc_id % 4 = 1 then 'Abstract: ' || line else line end when pos > 2 and {_C} = 1 then '2.' || pos || ' ' || left(line, 20) when pos > 2 and {_C} = 2 then 'Appendix ' || pos when pos > 2 and {_C} = 3 then 'REFERENCES ' when pos > 2 and {_C} = 0 then left(line, 30) else line end"
_CAPTION = "case when pos % 4 <> 3 then 'Figure ' || pos || ': ' || left(line, 20) end"

_BLOCKS = f"""lines as (select doc_id, i - 1 as pos, l[i] as line from (select doc_id, string_split(text, chr(10)) as l from documents) t, range(1, len(l) + 1) r(i)),
blocks as (select doc_id, pos, doc_id || ':' || pos as block_id, pos // 6 + 1 as page, {_TYPE} as type, {_LEVEL} as level, {_TEXT} as text, {_CAPTION} as caption from lines)"""
_ID = "lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"
#: The tree in SQL: every block is asked for its last boundary and its last subheading by joins on their numbers.
_NODES = rf"""{_BLOCKS},
a as (select *, type = 'title' and level = 2 as h2, coalesce(sum(case when type = 'title' and level = 2 then 1 end) over w, 0) as heads, coalesce(sum(case when type = 'title' and level = 1 then 1 end) over w, 0) as titles from blocks window w as (partition by doc_id order by pos)),
m as (select doc_id, min(heads) filter (where h2 and lower(trim(text)) = 'abstract') as abs_at, min(pos) filter (where h2 and lower(trim(text)) = 'abstract') as abs_pos from a group by doc_id),
q as (select a.*, abs_at, abs_pos, type = 'paragraph' and heads = 0 and length(text) < {H.AUTHORS_UNDER} and (regexp_matches(text, '<sup>[\d\*†‡§¶]+</sup>', 'i') or contains(text, '@')) and len(regexp_extract_all(text, '\.\s+[A-Z]')) < {H.SENTENCES_UNDER} as author from a join m using (doc_id)),
f as (select doc_id, min(pos) as pre from q where abs_at is null and type = 'paragraph' and page = 1 and not author and regexp_matches(text, '^abstract\s*[—\-–:]\s*', 'i') group by doc_id),
p as (select q.*, case when type = 'title' and level = 1 then case when titles = 1 then 0 end when author then 1 when (type = 'paragraph' and heads = abs_at) or pos = abs_pos or pos = pre then 2 when h2 or type in ('reference', 'figure', 'table', 'equation', 'paragraph', 'image_caption') then 3 end as phase from q left join f using (doc_id)),
c as (select doc_id, max((phase = 1)::int) as has1, max((phase = 2)::int) as has2 from p group by doc_id),
b as (select p.*, has1 + has2 + row_number() over (partition by doc_id order by pos) as ord, case when h2 then case when regexp_matches(trim(text), '^(references|bibliography)$', 'i') then 'references' when regexp_matches(trim(text), '^appendix\b|^\d+\s+appendix\b|^[A-Z]\s+APPENDIX\b', 'i') then 'appendix' when regexp_matches(trim(text), '^(?:[A-Z]|\d+)(?:\.\d+)+(?:\s|$)') then 'subsection' else 'section' end when type = 'image_caption' then 'paragraph' else type end as opens from p join c using (doc_id) where phase = 3),
k as (select b.*, max(case when opens in ('section', 'appendix', 'references') and h2 then ord end) over w as b0, max(case when opens = 'subsection' then ord end) over w as s0 from b window w as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)),
l as (select k.*, o.opens as bk, case when s0 > coalesce(b0, -1) then s0 end as s1 from k left join b o on o.doc_id = k.doc_id and o.ord = k.b0),
body as (select doc_id, ord, case when opens = 'references' then 'section' else opens end as kind, case when h2 then trim(text) when opens in ('figure', 'table') then caption end as title, case when h2 then '' when opens in ('figure', 'table') then coalesce(caption, '') else text end as content, page,
case when h2 and opens <> 'subsection' then 0 when opens = 'subsection' then coalesce(b0, 0) when opens = 'reference' then case when bk = 'appendix' then 0 else coalesce(b0, 0) end else coalesce(s1, b0, 0) end as parent,
case when h2 and opens <> 'subsection' then 1 when opens in ('subsection', 'reference') then 2 when s1 is not null then 3 when b0 is not null then 2 else 1 end as level, page as low, page as high, [block_id] as ids from l),
nodes as (select * from body union all
select d.doc_id, 0, 'document', t.text, '', coalesce(t.page, 1), null, 0, coalesce(t.page, 1), coalesce(t.page, 1), case when t.block_id is null then [] else [t.block_id] end from (select distinct doc_id from blocks) d left join (select * from p where phase = 0) t using (doc_id) union all
select doc_id, 1, 'authors', null, string_agg(text, ' ' order by pos), null, 0, 1, min(page), max(page), list(block_id order by pos) from p where phase = 1 group by doc_id union all
select p.doc_id, any_value(has1) + 1, 'abstract', 'Abstract', coalesce(string_agg(text, ' ' order by pos) filter (where type = 'paragraph'), ''), null, 0, 1, min(page), max(page), list(block_id order by pos) from p join c using (doc_id) where phase = 2 group by p.doc_id),
u as (select n.*, o.parent as up from nodes n left join nodes o on o.doc_id = n.doc_id and o.ord = n.parent),
w as (select u.*, o.parent as upper from u left join nodes o on o.doc_id = u.doc_id and o.ord = u.up),
anc as (select doc_id, ord, unnest(list_filter([ord, parent, up, upper], lambda x: x is not null)) as top, low, high from w),
r as (select doc_id, top as ord, min(low) as page_start, max(high) as page_end, count(*) as below from anc group by all)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("pos", F.col("p").cast("long"))
    no = F.lit(None).cast("string")
    return lines.select(
        F.col("doc_id").alias("document_id"), F.concat_ws(":", "doc_id", "pos").alias("block_id"), (F.floor(F.col("pos") / 6) + 1).alias("page"), F.col("pos").alias("reading_order"), F.expr(_TYPE).alias("block_type"),
        F.expr(_LEVEL).alias("level"), F.expr(_TEXT).alias("text"), F.expr(_CAPTION).alias("caption"), no.alias("footnote"), no.alias("html"), no.alias("image_path"),
    )


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.derive(_blocks(spark, sf_dir))


_HASHED = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({} || ':node:' || {}))"


@REGISTRY.query(rf"""with {_NODES}, x as (select w.*, r.page_start, r.page_end, {_HASHED.format('w.doc_id', 'w.ord')} as h from w join r using (doc_id, ord))
select doc_id, {_ID} as id, kind, title, content, ord::int as order_index, parent::int as parent, level::int as level, page_start::bigint as page_start, page_end::bigint as page_end, array_to_string(ids, ' ') as block_ids from x""")
def tree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every document's tree: title, authors, abstract and body, with what it says and the pages below it."""
    parent = F.get("path", F.size("path") - 2)
    return _nodes(spark, sf_dir).select(F.col("document_id").alias("doc_id"), "id", "kind", "title", "content", "order_index", parent.alias("parent"), "level", "page_start", "page_end", F.array_join("source_block_ids", " ").alias("block_ids"))


@REGISTRY.query(f"with {_NODES}, o as (select doc_id, unnest(ids) as block from nodes), n as (select block, count(*) as claims from o group by block) select (select count(*) from n where claims > 1) as claimed_twice, (select count(*) from n) as claimed, (select count(*) from p where phase is not null) as expected")
def tree_one_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that two nodes claim (none), blocks that a node claims, and blocks that one should."""
    blocks = _blocks(spark, sf_dir)
    nodes = H.derive(blocks)
    claims = H.owners(nodes).groupBy("block_id").agg(F.count("*").alias("n"))
    known = (F.col("block_type") != "discarded") & ~((F.col("block_type") == "title") & (F.col("level") == 1))
    titles = F.count_distinct(F.when((F.col("block_type") == "title") & (F.col("level") == 1), F.col("document_id")))
    expected = blocks.agg((F.count_if(known) + titles).alias("expected"))
    return claims.agg(F.count_if(F.col("n") > 1).alias("claimed_twice"), F.count("*").alias("claimed")).join(expected)


@REGISTRY.query(f"with {_NODES} select doc_id, min(ord) filter (where kind = 'reference')::int as references_start, min(ord) filter (where kind = 'appendix')::int as appendix_start from nodes group by doc_id")
def tree_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where references and appendix begin."""
    return H.boundaries(_nodes(spark, sf_dir)).withColumnRenamed("document_id", "doc_id")


@REGISTRY.query(f"""with {_NODES}, t as (select top, anc.doc_id, anc.ord, i, ids[i] as block from anc join nodes using (doc_id, ord), range(1, 1000) g(i) where i <= len(ids)),
s as (select t.doc_id, t.top as ord, string_agg(blocks.text, chr(10) order by t.ord, t.i) filter (where blocks.text <> '') as text from t join blocks on blocks.block_id = t.block group by all), own as (select nodes.doc_id, nodes.ord, blocks.text from nodes join blocks on blocks.block_id = nodes.ids[1] where len(ids) = 1)
select nodes.doc_id, nodes.ord::int as order_index, coalesce(own.text, '') as heading, coalesce(s.text, '') as text from nodes left join s using (doc_id, ord) left join own using (doc_id, ord) where kind in ('section', 'subsection', 'appendix')""")
def section_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section's own text and the text of everything below it."""
    blocks = _blocks(spark, sf_dir)
    nodes = H.derive(blocks)
    own = H.section_text(nodes, blocks).withColumnRenamed("text", "heading")
    both = own.join(H.section_text(nodes, blocks, descendants=True), ["document_id", "id"])
    return both.join(nodes.select("document_id", "id", "order_index"), ["document_id", "id"]).select(F.col("document_id").alias("doc_id"), "order_index", "heading", "text")


@REGISTRY.query(f"""with {_NODES}, o as (select doc_id, ord, parent, kind, unnest(ids) as block from nodes), g as (select o.*, case when o.kind in ('section', 'subsection', 'appendix') then o.ord when o.parent > 0 then o.parent end as section from o)
select blocks.doc_id, blocks.pos, g.ord::int as node, g.section::int as section from blocks left join g on g.block = blocks.block_id where regexp_matches(blocks.text, '[0-9]')""")
def fact_source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node of each block that has a number, and the section it is in; dropped blocks have neither."""
    blocks = _blocks(spark, sf_dir)
    nodes = H.derive(blocks)
    facts = blocks.where(F.col("text").rlike("[0-9]")).select("document_id", "block_id", F.col("reading_order").alias("pos"))
    places = nodes.select("document_id", F.col("id").alias("node_id"), F.col("order_index").alias("node"), "path", "kind", "section_id")
    placed = H.source_nodes(facts, nodes).join(places.drop("section_id"), ["document_id", "node_id"], "left")
    section = F.when(F.col("source_node_id").isNotNull(), F.when(F.col("kind").isin("section", "subsection", "appendix"), F.col("node")).otherwise(F.get("path", F.size("path") - 2)))
    return placed.select(F.col("document_id").alias("doc_id"), "pos", "node", section.alias("section"))


@REGISTRY.query(f"with {_NODES} select doc_id, ord::int as order_index, (below - 1)::bigint as below from r join nodes using (doc_id, ord) where kind in ('document', 'section', 'subsection', 'appendix') and below > 1")
def subtree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes are below each root and section, counted through the intervals."""
    nodes = _nodes(spark, sf_dir)
    tops = nodes.where(F.col("kind").isin("document", "section", "subsection", "appendix"))
    below = H.within(nodes, tops).groupBy("document_id", F.col("top_id").alias("id")).agg(F.count("*").alias("below"))
    return below.join(tops.select("document_id", "id", "order_index"), ["document_id", "id"]).select(F.col("document_id").alias("doc_id"), "order_index", "below")
