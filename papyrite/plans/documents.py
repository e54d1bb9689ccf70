"""Blocks, trees, enrichment and chunks. A document's lines are its blocks; a line's first letters make it a heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions import enrich as N
from papyrite.functions import text as T
from papyrite.functions.ids import uuid5
from papyrite.operators import chunks, tree
from papyrite.operators.facts import ACHIEVES, BENCHMARK, DATASET, HYPER, METRIC, NO_DATASETS, extract
from papyrite.plans.registry import Registry, table
from papyrite.plans.search import FOUND
from papyrite.sources import layout

REGISTRY = Registry()


@REGISTRY.query(r"select page_id, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) as heading, len(regexp_extract_all(html, '<p[ >]', 0)) as paragraphs from pages")
def pages_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading and number of paragraphs of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)).alias("heading"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).cast("long").alias("paragraphs"))


_BLOCKS = """blocks as (select doc_id, i - 1 as pos, doc_id || ':' || (i - 1) as node_id, (i - 1) // 3 as page, case (doc_id * 7 + i * 3) % 11 when 0 then 'section' when 1 then 'subsection' when 2 then 'appendix' when 3 then 'references' when 4 then 'reference' else 'paragraph' end as kind, l[i] as text
from (select doc_id, string_split(text, chr(10)) as l from documents) t, range(1, len(l) + 1) r(i))"""
_KIND = "case (doc_id * 7 + (pos + 1) * 3) % 11 when 0 then 'section' when 1 then 'subsection' when 2 then 'appendix' when 3 then 'references' when 4 then 'reference' else 'paragraph' end"
_TREE = f"""{_BLOCKS}, s as (select *, max(case when kind in ('section', 'appendix', 'references') then pos end) over w as b, max(case when kind = 'subsection' then pos end) over w as u from blocks window w as (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)),
k as (select s.*, c.kind as bk from s left join blocks c on c.doc_id = s.doc_id and c.pos = s.b),
placed as (select doc_id, pos, node_id, page, kind, text, case when kind in ('section', 'appendix', 'references') then null when kind = 'subsection' then b when kind = 'reference' then case when bk = 'appendix' then null else b end when u is not null and (b is null or u > b) then u else b end as pp,
case when kind not in ('section', 'appendix', 'references', 'subsection', 'reference') and u is not null and (b is null or u > b) then 3 end as l3 from k),
nodes as (select node_id as id, doc_id, pos, page, kind, text, doc_id || ':' || pp as parent, case when l3 = 3 then 3 when pp is null then 1 else 2 end as level from placed)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).withColumn("pos", F.col("p").cast("long")).drop("p")
    return rows.select("doc_id", "pos", F.concat_ws(":", "doc_id", "pos").alias("node_id"), F.floor(F.col("pos") / 3).alias("page"), F.expr(_KIND).alias("kind"), "text")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.place(_blocks(spark, sf_dir), "doc_id").select(F.col("node_id").alias("id"), "doc_id", "pos", "page", "kind", "text", "parent", "level")


@REGISTRY.query(f"with {_TREE} select id, coalesce(parent, '') as parent, level::int as level from nodes")
def tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent (empty: the root) and level of each block by the last headings before it."""
    return _nodes(spark, sf_dir).select("id", F.coalesce("parent", F.lit("")).alias("parent"), "level")


@REGISTRY.query(f"with {_TREE} select level::int as level, kind, count(*) as n from nodes group by all")
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by level and kind."""
    return _nodes(spark, sf_dir).groupBy("level", "kind").agg(F.count("*").alias("n"))


@REGISTRY.query(f"""with recursive {_TREE}, closure as (select id as top, id, page from nodes union all select n.parent, c.id, c.page from closure c join nodes n on n.id = c.top where n.parent is not null)
select top as id, min(page) as page_start, max(page) as page_end from closure group by top""")
def page_range_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last page of each node with all below it."""
    nodes = _nodes(spark, sf_dir).select("id", "parent", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    return tree.page_ranges(nodes).select("id", "page_start", "page_end")


@REGISTRY.query(f"""with recursive {_TREE}, walk as (select id, id as top, parent, kind, 0 as d from nodes union all select w.id, n.id, n.parent, n.kind, d + 1 from walk w join nodes n on n.id = w.parent where w.kind not in ('section', 'subsection', 'appendix'))
select n.id, coalesce(w.top, '') as section from nodes n left join (select id, top from walk where kind in ('section', 'subsection', 'appendix')) w on w.id = n.id""")
def ancestor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest section, subsection or appendix above each node."""
    return tree.nearest_ancestor(_nodes(spark, sf_dir), ["section", "subsection", "appendix"]).select("id", F.coalesce("found", F.lit("")).alias("section"))


@REGISTRY.query(f"with {_TREE}, seed as (select * from nodes where pos = 4) select s.id as seed, n.id as sibling from seed s join nodes n on n.doc_id = s.doc_id and n.parent = s.parent and n.id <> s.id")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the seed's parent."""
    nodes = _nodes(spark, sf_dir).select("doc_id", "id", "pos", "parent")
    seeds = nodes.where("pos = 4").select("doc_id", "parent", F.col("id").alias("seed"))
    return nodes.join(seeds, ["doc_id", "parent"]).where("id <> seed").select("seed", F.col("id").alias("sibling"))


@REGISTRY.query(f"with {_BLOCKS} select s.node_id as seed, n.node_id as near from blocks s join blocks n on n.doc_id = s.doc_id and n.pos between s.pos - 2 and s.pos + 2 and n.pos <> s.pos where s.kind = 'section'")
def adjacent_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two neighbours on either side of each section heading."""
    b = _blocks(spark, sf_dir).select("doc_id", "pos", "node_id", "kind")
    seeds = b.where("kind = 'section'").select("doc_id", F.col("node_id").alias("seed"), F.col("pos").alias("at"), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("step"))
    wanted = seeds.select("doc_id", "seed", (F.col("at") + F.col("step")).alias("pos"))  # equality instead of a range: no row meets its whole document
    return wanted.join(b, ["doc_id", "pos"]).select("seed", F.col("node_id").alias("near"))


@REGISTRY.query(f"""with recursive {_TREE}, closure as (select id as top, id, page from nodes union all select n.parent, c.id, c.page from closure c join nodes n on n.id = c.top where n.parent is not null), r as (select top as id, min(page) as page_start, max(page) as page_end from closure group by top),
n as (select nodes.id, doc_id, kind, page_start, page_end from nodes join r using (id)) select s.id as seed, count(*) as inside from n s join n on n.doc_id = s.doc_id and n.page_start >= s.page_start and n.page_end <= s.page_end and n.id <> s.id where s.kind = 'section' group by 1""")
def page_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose pages lie within those of each section."""
    nodes = _nodes(spark, sf_dir).select("doc_id", "id", "kind", "parent", F.col("page").alias("page_start"), F.col("page").alias("page_end"))
    n = tree.page_ranges(nodes).select("doc_id", "id", "kind", "page_start", "page_end")
    seeds = n.where("kind = 'section'").select("doc_id", F.col("id").alias("seed"), F.explode(F.sequence("page_start", "page_end")).alias("page_start"), F.col("page_end").alias("last"))
    # equality on the first page instead of a range: a row meets the seeds over its page only
    return n.drop("kind").join(seeds, ["doc_id", "page_start"]).where("page_end <= last and id <> seed").groupBy("seed").agg(F.count("*").alias("inside"))


@REGISTRY.query(f"with {_TREE} select doc_id, count(*) as n, count(distinct pos) as different, min(pos) as low, max(pos) as high, count(*) filter (where parent is not null and parent not in (select id from nodes)) as lost from nodes group by doc_id")
def dense_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's order is 0 to n - 1 and all parents exist."""
    nodes = _nodes(spark, sf_dir).select("doc_id", "id", "pos", "parent")
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    joined = nodes.join(known, "parent", "left")
    return joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("different"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_if(F.col("parent").isNotNull() & F.col("known").isNull()).alias("lost"))


#: Each text with a sentence of every family behind it.
_MADE = "text || chr(10) || 'We show that part ' || doc_id || ' improves recall on all tasks considered here. However, Graph ' || (doc_id % 9) || ' is a small structure of nodes. We propose to cut cost by 12.5% over time! Top-K: the number of rows that are kept in the end. Recall reaches 87% on set ' || doc_id || '.'"
_LIST = "list_transform(range(1, least({n}, len({l})) + 1), lambda i: {l}[i])"


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_MADE.replace("chr(10)", "char(10)")).alias("text"))


def _listed(column: str, n: int) -> str:
    return f"with {FOUND} select id as doc_id, array_to_string(list_slice(list_filter({column}, lambda x, i: list_position({column}, x) = i), 1, {n}), ' ') as found from found"


@REGISTRY.query(_listed("k", 8))
def keywords_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight different words of four characters or more."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.keywords(F.col("text")), " ").alias("found"))


@REGISTRY.query(_listed("t", 6))
def technical_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six acronyms and compounds."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.technical_keywords(F.col("text")), " ").alias("found"))


@REGISTRY.query(_listed("e", 8))
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight capitalised words and acronyms."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(N.entities(F.col("text")), " ").alias("found"))


@REGISTRY.query(f"""with d as (select doc_id, {_MADE} as text from documents), g as (select doc_id, regexp_extract_all(text, '{N.DEFINITION}', 1) as a, regexp_extract_all(text, '{N.DEFINITION}', 2) as b, regexp_extract_all(text, '{N.DEFINITION}', 3) as c, regexp_extract_all(text, '{N.DEFINITION}', 4) as d from d),
r as (select doc_id, i, coalesce(nullif(trim(a[i]), ''), trim(c[i])) as term, coalesce(nullif(trim(b[i]), ''), trim(d[i])) as definition from g, range(1, len(a) + 1) r(i)), n as (select *, row_number() over (partition by doc_id order by i) as n from r where term <> '' and definition <> '') select doc_id, n - 1 as pos, term, definition from n where n <= 4""")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four definitions of each text."""
    rows = _enriched(spark, sf_dir).select("doc_id", F.posexplode(N.definitions(F.col("text"))).alias("pos", "d"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "d.term", "d.definition")


@REGISTRY.query(f"with d as (select doc_id, regexp_extract_all({_MADE}, '{N.CLAIM}', 0) as l from documents) select doc_id, i - 1 as pos, trim(l[i]) as claim from d, range(1, len(l) + 1) r(i) where i <= 4")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four claims of each text."""
    rows = _enriched(spark, sf_dir).select("doc_id", F.posexplode(N.claims(F.col("text"))).alias("pos", "claim"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


#: RE2 has no look-behind: a mark is put where a sentence ends.
_SENTENCES = rf"d as (select doc_id, string_split(regexp_replace({_MADE}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as s from documents)"


@REGISTRY.query(rf"""with {_SENTENCES}, f as (select doc_id, list_filter(s, lambda x: regexp_matches(x, '{N.METHOD}')) as l from d)
select doc_id, i - 1 as pos, array_to_string(list_slice(string_split_regex(trim(regexp_replace(l[i], '\s+', ' ', 'g')), ' '), 1, 6), ' ') as name, left(trim(l[i]), 200) as description from f, range(1, len(l) + 1) r(i) where i <= 3""")
def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of each text that name a method."""
    rows = _enriched(spark, sf_dir).select("doc_id", F.posexplode(N.methods(F.col("text"))).alias("pos", "m"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "m.name", "m.description")


@REGISTRY.query(f"""with {_SENTENCES}, f as (select doc_id, list_filter(s, lambda x: {' or '.join(f"contains(lower(x), '{p}')" for p in N.LIMITATION)}) as l from d) select doc_id, i - 1 as pos, left(trim(l[i]), 200) as limitation from f, range(1, len(l) + 1) r(i) where i <= 3""")
def limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of each text that tell a limit."""
    rows = _enriched(spark, sf_dir).select("doc_id", F.posexplode(N.limitations(F.col("text"))).alias("pos", "limitation"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@REGISTRY.query(f"""with g as (select doc_id, regexp_extract_all({_MADE}, '{N.PERFORMANCE}', 1) as a, regexp_extract_all({_MADE}, '{N.PERFORMANCE}', 2) as b, regexp_extract_all({_MADE}, '{N.PERFORMANCE}', 3) as c from documents),
r as (select doc_id, i, trim(a[i]) as metric, trim(b[i]) as value, nullif(trim(c[i]), '') as context from g, range(1, len(a) + 1) r(i)), n as (select *, row_number() over (partition by doc_id order by i) as n from r where metric <> '' and value <> '') select doc_id, n - 1 as pos, metric, value, context from n where n <= 4""")
def performance_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four measured values of each text."""
    rows = _enriched(spark, sf_dir).select("doc_id", F.posexplode(N.performance_facts(F.col("text"))).alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "p.metric", "p.value", "p.context")


@REGISTRY.query(f"""with {FOUND}, u as (select source, 'keyword' as family, unnest(list_slice(list_filter(k, lambda x, i: list_position(k, x) = i), 1, 8)) as x from found union all select source, 'technical', unnest(list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 6)) from found
union all select source, 'entity', unnest(list_slice(list_filter(e, lambda x, i: list_position(e, x) = i), 1, 8)) from found), r as (select *, row_number() over (partition by source, family order by encode(x)) as n from (select distinct source, family, x from u)) select source, family, string_agg(x, ',' order by n) as first_twelve from r where n <= 12 group by source, family""")
def agg_union_dedupe_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents of a collection have of each family, once each, sorted, the first twelve."""
    text = F.col("text")
    named = lambda family, found: F.transform(found, lambda x: F.struct(F.lit(family).alias("family"), x.alias("x")))
    every = F.concat(named("keyword", N.keywords(text)), named("technical", N.technical_keywords(text)), named("entity", N.entities(text)))
    rows = table(spark, sf_dir, "documents").select("source", F.explode(every).alias("f")).select("source", "f.family", "f.x").distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("source", "family").orderBy("x"))).where("n <= 12")
    return ranked.groupBy("source", "family").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("first_twelve"))


_FALLBACKS = "case when length(trim(said)) > 40 then left(trim(said), 300) when trim(left(text, 120)) <> '' then '[summary] ' || trim(left(text, 120)) else '[summary] (empty section)' end as detailed, case when length(trim(said)) > 10 then trim(left(split_part(trim(said), '.', 1), 100)) when trim(left(text, 60)) <> '' then '[compact] ' || trim(left(text, 60)) else '[compact] (empty section)' end as compact"
_SAID = "case doc_id % 3 when 0 then ' ' || left(text, 400) when 1 then 'A short note. More.' else ' x ' end"


@REGISTRY.query(f"with t as (select doc_id, lang, text, {_SAID} as said from documents), s as (select doc_id, lang, {_FALLBACKS} from t) select doc_id, kind, content from (select doc_id, unnest(['detailed', 'compact', 'keywords']) as kind, unnest([detailed, compact, nullif(lang, 'en')]) as content from s) where content is not null")
def summary_rows_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with their fallbacks, a row for each that is there."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", *[c.alias(k) for k, c in N.summaries(F.expr(_SAID), F.col("text")).items()])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("content")) for k, v in (("detailed", F.col("detailed")), ("compact", F.col("compact")), ("keywords", F.nullif(F.col("lang"), F.lit("en"))))])
    return rows.select("doc_id", F.explode(F.filter(each, lambda r: r["content"].isNotNull())).alias("r")).select("doc_id", "r.kind", "r.content")


@REGISTRY.query(f"with t as (select doc_id, text, {_SAID} as said from documents), s as (select doc_id, {_FALLBACKS} from t) select doc_id, unnest(['section_summary', 'compact_section_summary']) as source_type, unnest([0, 1]) as order_index, unnest([detailed, compact]) as content from s")
def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chunks for each summary: the detailed one, then the compact one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in N.summaries(F.expr(_SAID), F.col("text")).items()])
    each = F.array(*[F.struct(F.lit(kind).alias("source_type"), F.lit(i).alias("order_index"), F.col(k).alias("content")) for i, (kind, k) in enumerate((("section_summary", "detailed"), ("compact_section_summary", "compact")))])
    return rows.select("doc_id", F.inline(each))


@REGISTRY.query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into chunks; order matters, so SQL has no plain form."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks.pack(F.col("text"))).alias("n", "content"))
    return rows.select("doc_id", "n", "content", uuid5(F.concat_ws(":", F.col("doc_id"), F.lit("chunk"), F.col("n"))).alias("chunk_id"), T.tokens_by_words(F.col("content")).alias("token_count"))


@REGISTRY.query(f"""with {_BLOCKS}, h as (select *, last_value(case when kind in ('section', 'subsection', 'appendix') and trim(text) <> '' then left(trim(text), 200) end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as heading from blocks)
select node_id, kind, trim(text) as content, coalesce(heading, '') as heading, row_number() over (partition by doc_id order by pos) - 1 as order_index from h where trim(text) <> '' and kind <> 'references'""")
def raw_block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each block with text, discarded kinds aside, under the last heading, of which 200 characters count."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    title = F.when(F.col("kind").isin("section", "subsection", "appendix") & (F.trim("text") != ""), F.left(F.trim("text"), F.lit(200)))
    rows = _blocks(spark, sf_dir).withColumn("heading", F.last(title, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.trim("text") != "") & (F.col("kind") != "references"))
    return rows.select("node_id", "kind", F.trim("text").alias("content"), F.coalesce("heading", F.lit("")).alias("heading"), (F.row_number().over(order) - 1).cast("long").alias("order_index"))


@REGISTRY.query("select event_id, case event_type when 'click' then 'performance_fact' when 'purchase' then 'definition' else 'claim' end as source_type, 'u' || user_id || ': ' || event_type || case when event_id % 3 = 0 then ' (seen)' else ' ms' end as content from events")
def fact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each fact: key, value, and the unit in the place of the context where there is one."""
    kind = F.when(F.col("event_type") == "click", "performance_fact").when(F.col("event_type") == "purchase", "definition").otherwise("claim")
    end = F.when(F.col("event_id") % 3 == 0, " (seen)").otherwise(" ms")
    return table(spark, sf_dir, "events").select("event_id", kind.alias("source_type"), F.concat(F.lit("u"), "user_id", F.lit(": "), "event_type", end).alias("content"))


@REGISTRY.query("select source_type, count(*) as n, sum(length(content))::bigint as chars from (select 'chunk' as source_type, text as content from documents union all select 'raw_block', html from pages union all select 'claim', text from benchmark) group by 1")
def chunk_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of chunks together, counted."""
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("source_type"), F.col(c).alias("content")) for t, k, c in (("documents", "chunk", "text"), ("pages", "raw_block", "html"), ("benchmark", "claim", "text"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@REGISTRY.query("select label, count(*) filter (where len(embedding) = 64 and label < 8) as fed, count(*) filter (where len(embedding) <> 64 or label >= 8) as refused from embeddings group by label")
def feed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a feed takes and refuses, by scope."""
    good = (F.size("embedding") == 64) & (F.col("label") < 8)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count_if(good).alias("fed"), F.count_if(~good).alias("refused"))


_FACT = "'The accuracy is ' || (doc_id % 100) || '.5% with batch size 32 and learning rate of 0.001, top-k = ' || (doc_id % 7) || '. Model-X beats 1,5 and Model-Y outperforms all others by ' || (doc_id % 70) || ' points on MNIST-2. It reaches ' || (doc_id % 40) || ' BLEU on \"WMT 14\" and SQUAD, not on BERT.'"
_SECTION = "Evaluation of the dataset"
_FACT_BLOCKS = f"""blocks as (select doc_id, 0 as seq, 1 as page, {_FACT.replace(chr(92), '')} as text from documents union all select doc_id, i, (i - 1) // 3 + 1, l[i] from (select doc_id, string_split(text, chr(10)) as l from documents) t, range(1, len(l) + 1) r(i))"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.lit(_SECTION).alias("section")
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("seq"), section, F.expr(_FACT).alias("text"), F.lit(1).cast("long").alias("page"))
    whole = _blocks(spark, sf_dir).select(F.col("doc_id").alias("document_id"), (F.col("pos") + 1).alias("seq"), section, "text", (F.col("page") + 1).alias("page"))
    return extract(made.unionByName(whole))


@REGISTRY.query()
def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a sentence made for each document and of all its blocks; match offsets are needed, so SQL has no plain form."""
    return _facts(spark, sf_dir)


def _of_kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _facts(spark, sf_dir).where(F.col("kind") == kind).select(F.col("document_id").alias("doc_id"), "key", F.round("numeric", 6).alias("numeric"), "page")


def _numbers(pattern: str, key: str, number: int) -> str:
    return f"select doc_id, page, {key} as key, replace(unnest(regexp_extract_all(text, '{pattern}', {number}, 'i')), ',', '')::double as numeric from blocks"


def _plain(pattern: str) -> str:
    return pattern.replace("'", "''")


_METRIC_KEY = "replace(lower(trim(unnest(regexp_extract_all(text, '{}', {}, 'i')))), ' ', '_')"


@REGISTRY.query(f"with {_FACT_BLOCKS} select distinct doc_id, key, round(numeric, 6) as numeric, page from ({_numbers(METRIC.pattern, _METRIC_KEY.format(METRIC.pattern, 1), 2)} union all {_numbers(ACHIEVES.pattern, _METRIC_KEY.format(ACHIEVES.pattern, 3), 1)})")
def metric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values by name, number and page."""
    return _of_kind(spark, sf_dir, "metric")


@REGISTRY.query(f"with {_FACT_BLOCKS} select distinct doc_id, key, round(numeric, 6) as numeric, page from ({_numbers(BENCHMARK.pattern, f"lower(unnest(regexp_extract_all(text, '{BENCHMARK.pattern}', 1, 'i'))) || '_score'", 2)})")
def benchmark_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What methods achieve or outperform, by method, number and page."""
    return _of_kind(spark, sf_dir, "benchmark")


@REGISTRY.query(f"with {_FACT_BLOCKS} select distinct doc_id, key, round(numeric, 6) as numeric, page from ({' union all '.join(_numbers(pattern.pattern, repr(key), 1) for key, pattern in HYPER)})")
def hyperparameter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a training, by name, number and page."""
    return _of_kind(spark, sf_dir, "hyperparameter")


@REGISTRY.query(f"""with {_FACT_BLOCKS}, n as (select doc_id, page, trim(trim(unnest(regexp_extract_all(text, '{_plain(DATASET.pattern)}', 0)), '"' || chr(39))) as name from blocks)
select distinct doc_id, replace(replace(lower(name), ' ', '_'), '-', '_') as key, null::double as numeric, page from n where name not in {tuple(sorted(NO_DATASETS))} and (regexp_matches(name, '[0-9]') or contains(name, '-') or (length(name) > 2 and upper(name) = name and lower(name) <> name))""")
def dataset_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets by name and page."""
    return _of_kind(spark, sf_dir, "dataset")


@REGISTRY.query("""with l as (select doc_id, string_split(text, chr(10)) as l from documents), b as (select doc_id, i - 1 as pos, l[i] as line from l, range(1, len(l) + 1) r(i)),
t as (select doc_id, pos as reading_order, case when pos = 0 then 'title' when pos % 7 = 3 then 'equation' when pos % 7 = 5 then 'reference' else 'paragraph' end as block_type, case when pos % 7 = 3 and pos > 0 then '$$' || trim(line) || '$$' else trim(line) end as text, case when pos = 0 then 1 end as level from b)
select * from t union all select doc_id, 10000, 'discarded', 'page ' || doc_id, null from l""")
def blocks_from_layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed blocks of layout JSON that is made of each document: its lines as blocks of one page, and a page number."""
    kind = lambda i: F.when(i == 0, "title").when(i % 7 == 3, "interline_equation").when(i % 7 == 5, "ref_text").otherwise("text")
    spans = lambda text: F.array(F.struct(F.array(F.struct(text.alias("content"))).alias("spans")))
    block = lambda text, i: F.struct(kind(i).alias("type"), i.alias("index"), F.when(i == 0, 1).alias("level"), spans(text).alias("lines"))
    number = F.array(F.struct(F.lit("page_number").alias("type"), spans(F.concat(F.lit("page "), "doc_id")).alias("lines")))
    page = F.struct(F.lit(0).alias("page_idx"), F.transform(F.split("text", "\n", -1), block).alias("preproc_blocks"), number.alias("discarded_blocks"))
    made = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.to_json(F.struct(F.array(page).alias("pdf_info"))).alias("json"))
    rows = layout.blocks(made.select("document_id", F.from_json("json", layout.SCHEMA).alias("j")).select("document_id", "j.pdf_info"))
    return rows.select(F.col("document_id").alias("doc_id"), F.col("reading_order").cast("long").alias("reading_order"), "block_type", "text", "level")


@REGISTRY.query("select t, n from (select trim(l) as t, count(*) as n from (select unnest(string_split(text, chr(10))) as l from documents) where length(trim(l)) >= 20 group by 1) where n > 1")
def duplicate_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that occur more than once."""
    rows = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("t")).select(F.trim("t").alias("t")).where("length(t) >= 20")
    return rows.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")


@REGISTRY.query("select kind, n from (select case when html like '%<table%' then 'table' when html like '%<img%' then 'figure' else 'paragraph' end as kind, count(*) as n from pages group by 1)")
def block_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what they hold."""
    kind = F.when(F.col("html").contains("<table"), "table").when(F.col("html").contains("<img"), "figure").otherwise("paragraph")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
