"""Identities, scopes, text rules and message history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions import ids
from papyrite.functions import text as T
from papyrite.operators.scope import Scope
from papyrite.plans.registry import Registry, table

REGISTRY = Registry()


@REGISTRY.query("""
with d as (select doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(doc_id || ':chunk:' || source || ':' || n_chars)) h from documents)
select doc_id, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||substr('89ab', ('0x'||substr(h,17,1))::int % 4 + 1, 1)||substr(h,18,3)||'-'||substr(h,21,12) as chunk_id from d""")
def uuid5_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 5 UUIDs of chunk names."""
    return table(spark, sf_dir, "documents").select("doc_id", ids.uuid5(F.concat_ws(":", F.col("doc_id"), F.lit("chunk"), "source", F.col("n_chars"))).alias("chunk_id"))


@REGISTRY.query("select doc_id, source, lang from documents where source = 'src3' and lang in ('en', 'fr')")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mandatory scope predicate, pushed to the scan."""
    scope = Scope("src3", documents=("en", "fr"))
    return scope.read(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), chat="source", document="lang")


@REGISTRY.query("select count(*) as n_rows, count(*) filter (where source <> 'src3') as leaked from documents where source = 'src3'")
def scope_no_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside of the scope that a scoped read returns: none."""
    rows = table(spark, sf_dir, "documents").where(Scope("src3").predicate("source"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("source") != "src3").alias("leaked"))


@REGISTRY.query(r"""
select doc_id, greatest(1, floor(w / 0.75))::int as by_words, greatest(1, floor(length(text) / 4))::int as by_length, case when length(text) = 0 then 0 else greatest(1, floor(length(text) / 4))::int end as for_budget, w::int as by_count
from (select doc_id, text, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '')) w from documents)""")
def token_count_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token estimators side by side."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.tokens_by_words(text).alias("by_words"), T.tokens_by_length(text).alias("by_length"), T.tokens_for_budget(text).alias("for_budget"), T.word_count(text).alias("by_count"))


@REGISTRY.query(r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as plain from pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@REGISTRY.query(r"""
select page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</t[dh]>', ' | ', 'gi'), '</tr>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n\s+', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)), 4000) as table_text from pages""")
def html_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML as table text, at most 4,000 characters."""
    return table(spark, sf_dir, "pages").select("page_id", T.table_text(F.col("html")).alias("table_text"))


_STOP = ", ".join(f"'{w}'" for w in T.GREP_STOPWORDS)


@REGISTRY.query(rf"""
select item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '{T.TERM}', 0), lambda x: lower(x)), lambda x: x not in ({_STOP})))), ' ') as terms from benchmark""")
def grep_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms of the questions."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.grep_terms(F.col("text"))), " ").alias("terms"))


@REGISTRY.query(r"""
with q as (select doc_id, 'See Figure ' || doc_id || ' and table  ' || (doc_id % 7) || '; figure ' || doc_id as t from documents)
select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)\b(?:Figure|Table)\s+[0-9]+\b', 0), lambda x: regexp_replace(lower(x), '\s+', ' ', 'g')))), ',') as labels from q""")
def label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figure and table labels of generated sentences."""
    said = F.concat(F.lit("See Figure "), F.col("doc_id"), F.lit(" and table  "), F.col("doc_id") % 7, F.lit("; figure "), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.labels(said)), ",").alias("labels"))


@REGISTRY.query(r"""
select doc_id, i - 1 as pos, s[i] as sentence from (select doc_id, list_filter(list_transform(string_split(replace(text, chr(10), '. '), '. '), lambda x: trim(x)), lambda x: x <> '') s from documents) t, range(1, len(s) + 1) r(i)""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@REGISTRY.query("""
select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn desc) n from conversations where role <> 'system') where n <= 4""")
def latest_message_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four turns of each conversation, system turns aside."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("n", F.row_number().over(order))
    return rows.where("n <= 4").select("conv_id", "turn", "role", "text")


@REGISTRY.query(r"""
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?%?\b', 0))), ' ') as numbers from documents where regexp_matches(text, '[0-9]')""")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the documents that have any."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]")).select("doc_id", F.array_join(F.array_sort(T.numeric_tokens(F.col("text"))), " ").alias("numbers"))


@REGISTRY.query("select event_id, sha1(event_type || ':' || props) as fingerprint from events")
def call_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints by which repeated calls are known."""
    return table(spark, sf_dir, "events").select("event_id", ids.fingerprint(F.col("event_type"), F.col("props")).alias("fingerprint"))


@REGISTRY.query("""
select event_id, event_type, k from (select event_id, event_type, props->>'$.k' as k, row_number() over (partition by event_type, props order by event_id) n from events) where n = 1""")
def duplicate_call_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of calls with the same fingerprint the first."""
    first = Window.partitionBy("event_type", "props").orderBy("event_id")
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
