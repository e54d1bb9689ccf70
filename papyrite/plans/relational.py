"""Facts, manifests, joins, listings. An event is a fact: its type is the kind, its user the key, ``props.k`` the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions import enrich as E
from papyrite.operators.facts import FactFilter, dedupe, upsert
from papyrite.plans.registry import Registry, table
from papyrite.plans.search import FOUND

REGISTRY = Registry()

_FACTS = """facts as (select event_id as id, user_id % 20 as document_id, event_type as kind, 'u' || user_id as key, value as numeric, (props->>'$.k')::int as page,
case when event_id % 3 = 0 then null else 'ms' end as unit, 'seen by u' || user_id || ' as ' || event_type as excerpt, ts as created_at from events)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("document_id"), F.col("event_type").alias("kind"), F.concat(F.lit("u"), "user_id").alias("key"), F.col("value").alias("numeric"),
        F.get_json_object("props", "$.k").cast("int").alias("page"), F.when(F.col("event_id") % 3 != 0, "ms").alias("unit"),
        F.concat(F.lit("seen by u"), "user_id", F.lit(" as "), "event_type").alias("excerpt"), F.col("ts").alias("created_at"),
    )


@REGISTRY.query(f"with {_FACTS} select id, document_id, kind, key, round(numeric, 6) as numeric, page from facts where document_id in (1, 2, 3) and kind in ('click', 'view', 'purchase') and page between 2 and 60 and numeric >= 1 and unit in ('ms') order by created_at, id limit 50 offset 5")
def facts_filter_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restricted fact filter: documents, kinds, pages, numbers and units, in a fixed order, one page of results."""
    found = FactFilter(documents=(1, 2, 3), kinds=("click", "view", "purchase"), pages=(2, 60), numeric=(1.0, None), units=("ms",), offset=5).search(_facts(spark, sf_dir), ["created_at", "id"])
    return found.select("id", "document_id", "kind", "key", F.round("numeric", 6).alias("numeric"), "page")


@REGISTRY.query(f"with {_FACTS} select id, kind, key from facts where lower(key) in ('u7', 'u19') and unit is null and (lower(excerpt) like '%click%' or lower(excerpt) like '%u19%') order by created_at, id limit 200")
def facts_filter_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open fact filter: keys in any case, splits by excerpt, with or without unit."""
    found = FactFilter(keys=("U7", "u19"), fold_keys=True, has_unit=False, excerpts=("CLICK", "u19"), limit=200).search(_facts(spark, sf_dir), ["created_at", "id"])
    return found.select("id", "kind", "key")


@REGISTRY.query(f"with {_FACTS} select kind, count(*) as n, round(min(numeric), 6) as low, round(max(numeric), 6) as high from facts where numeric >= 5 and numeric <= 50 group by kind")
def facts_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts in a range of values, by kind."""
    rows = _facts(spark, sf_dir).where(FactFilter(numeric=(5.0, 50.0)).predicate())
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.min("numeric"), 6).alias("low"), F.round(F.max("numeric"), 6).alias("high"))


@REGISTRY.query(f"with {_FACTS} select id from (select *, row_number() over (partition by document_id, kind, key, numeric, page order by created_at, id) n from facts) where n = 1")
def facts_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal facts."""
    return dedupe(_facts(spark, sf_dir), ["document_id"], ["created_at", "id"]).select("id")


@REGISTRY.query(f"""with {_FACTS}, n as (select id, kind, numeric * 2 as numeric, 's' as unit from facts where id % 4 = 0 union all select id + 1000000, kind, numeric, unit from facts where id % 100 = 0)
select coalesce(o.id, n.id) as id, coalesce(o.kind, n.kind) as kind, round(case when n.id is null then o.numeric else n.numeric end, 6) as numeric, case when n.id is null then o.unit else n.unit end as unit from facts o full outer join n on o.id = n.id""")
def facts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge by id: known facts get new values, new ones are added; a second run changes nothing."""
    old = _facts(spark, sf_dir).select("id", "kind", "numeric", "unit")
    new = old.where("id % 4 = 0").select("id", "kind", (F.col("numeric") * 2).alias("numeric"), F.lit("s").alias("unit")).unionByName(old.where("id % 100 = 0").withColumn("id", F.col("id") + 1000000))
    return upsert(old, new, "id", ["numeric", "unit"]).withColumn("numeric", F.round("numeric", 6))


@REGISTRY.query(f"with {_FACTS} select count(*) filter (where document_id = 3) as deleted, count(*) filter (where document_id <> 3) as left_over from facts")
def facts_delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts a document's deletion takes and leaves."""
    return _facts(spark, sf_dir).agg(F.count_if(F.col("document_id") == 3).alias("deleted"), F.count_if(F.col("document_id") != 3).alias("left_over"))


@REGISTRY.query("""
with jobs as (select user_id as doc, event_type as state, row_number() over (partition by user_id order by ts desc, event_id desc) n from events),
kinds as (select user_id as doc, string_agg(distinct 'fact:' || event_type, ',' order by 'fact:' || event_type) as fact_kinds from events group by 1),
sections as (select l_partkey as doc, count(*) as n from lineitem where l_returnflag in ('A', 'R') group by 1)
select c_custkey as doc, c_name as title, n_name as chat, coalesce(s.n, 0) as sections, k.fact_kinds, j.state from customer join nation on n_nationkey = c_nationkey
left join sections s on s.doc = c_custkey left join kinds k on k.doc = c_custkey left join jobs j on j.doc = c_custkey and j.n = 1""")
def manifest_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest in one star: owner, section count, kinds of facts and latest job of each document."""
    events = table(spark, sf_dir, "events")
    jobs = events.groupBy(F.col("user_id").alias("doc")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("fact:"), "event_type"))), ",").alias("fact_kinds"))
    sections = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_partkey").alias("doc")).agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("title"), F.col("n_name").alias("chat"))
    return docs.join(sections, "doc", "left").join(jobs, "doc", "left").select("doc", "title", "chat", F.coalesce("n", F.lit(0)).alias("sections"), "fact_kinds", "state")


@REGISTRY.query(f"""with {FOUND}, t as (select id, list_slice(list_filter(k, lambda x, i: list_position(k, x) = i), 1, 8) || list_slice(list_filter(e, lambda x, i: list_position(e, x) = i), 1, 8) as l from found)
select id as doc_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 8), ',') as topics from t""")
def manifest_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, then entities of each document, once each, the first eight."""
    both = F.array_distinct(F.concat(E.keywords(F.col("text")), E.entities(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(both, 1, 8), ",").alias("topics"))


@REGISTRY.query("select user_id, event_type as state, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) where n = 1")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest job of each key."""
    latest = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("m")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(latest).select("user_id", F.col("m.event_type").alias("state"), "m.event_id")


@REGISTRY.query("select event_type as state, count(*) as n, count(distinct user_id) as documents, round(sum(value), 4) as total from events group by 1")
def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs and documents by state, with a total."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("documents"), F.round(F.sum("value"), 4).alias("total"))


@REGISTRY.query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def orphan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without an association left."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@REGISTRY.query("select n_name as chat, count(*) as associations, count(distinct c_custkey) as documents from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderstatus = 'F' group by 1")
def shared_documents_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by way of their associations, for each collection."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(F.col("n_name").alias("chat")).agg(F.count("*").alias("associations"), F.count_distinct("c_custkey").alias("documents"))


@REGISTRY.query("""with sessions as (select conv_id, 'src' || (conv_id % 20) as chat from (select distinct conv_id from conversations))
select m.conv_id, m.turn, m.role, chat from conversations m join sessions s using (conv_id) where chat = 'src4' and role <> 'system'""")
def session_messages_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by way of their session, within one collection."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    sessions = messages.select("conv_id").distinct().withColumn("chat", F.concat(F.lit("src"), F.col("conv_id") % 20)).where("chat = 'src4'")
    return messages.where("role <> 'system'").join(sessions, "conv_id").select("conv_id", "turn", "role", "chat")


@REGISTRY.query("select doc_id, source, n_chars from documents order by n_chars desc, doc_id limit 20 offset 40")
def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a listing."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@REGISTRY.query("select doc_id, first_id, n from (select doc_id, min(doc_id) over (partition by sha256(text)) as first_id, count(*) over (partition by sha256(text)) as n from documents) where n > 1")
def upload_duplicates_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content's SHA-256 was uploaded before."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sum"))
    groups = rows.groupBy("sum").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, "sum").select("doc_id", "first_id", "n")


@REGISTRY.query("select item_id, d.doc_id is not null as found, coalesce(d.n_chars, -1) as n_chars from benchmark b left join documents d on d.doc_id = b.item_id and d.source = 'src' || (b.item_id % 3)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows asked for by key and collection: one that is in another collection is not found."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 3).alias("source"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source", "n_chars", F.lit(True).alias("there"))
    return asked.join(docs, ["item_id", "source"], "left").select("item_id", F.coalesce("there", F.lit(False)).alias("found"), F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@REGISTRY.query("""with o as (select doc_id, case when doc_id % 2 = 0 then null else lang end as node, 'v1' as body, 'kept' as made from documents), n as (select doc_id, node, 'v2' as body, 'new' as made from o where doc_id % 5 = 0 union all select doc_id + 1000000000, null, 'v2', 'new' from documents where doc_id % 7 = 0)
select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(o.node, n.node) as node, coalesce(n.body, o.body) as body, coalesce(o.made, n.made) as made from o full outer join n on o.doc_id = n.doc_id and o.node is not distinct from n.node""")
def summaries_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries merged by document and node, where a missing node equals a missing node; unknown ones are added."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select("doc_id", F.when(F.col("doc_id") % 2 != 0, F.col("lang")).alias("node"), F.lit("v1").alias("body"), F.lit("kept").alias("made"))
    more = docs.where("doc_id % 7 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit(None).cast("string").alias("node"))
    new = old.where("doc_id % 5 = 0").select("doc_id", "node").unionByName(more).select("doc_id", "node", F.lit("v2").alias("body"), F.lit("new").alias("made"))
    return upsert(old, new, ["doc_id", "node"], ["body"])


@REGISTRY.query("""select c_mktsegment as chat, count(*) as kept from customer where not (c_mktsegment = 'BUILDING' and c_nationkey = 7) group by 1""")
def delete_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after deleting one document's rows in one collection."""
    kept = table(spark, sf_dir, "customer").where(~((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") == 7)))
    return kept.groupBy(F.col("c_mktsegment").alias("chat")).agg(F.count("*").alias("kept"))


@REGISTRY.query("select coalesce(o_orderstatus, 'all') as state, coalesce(o_orderpriority, 'all') as priority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state and priority with subtotals."""
    rolled = table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("o_orderstatus", F.lit("all")).alias("state"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")
