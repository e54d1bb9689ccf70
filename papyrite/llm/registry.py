"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from papyrite.llm import bpe, chat, convrepair, decontaminate, filteraudit, fingerprint, langid, linededup, lmscore, neardup, pii, tokenfile, toxicity
from papyrite.llm.shared import new_folder, remainder, table


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every text, and its decoding."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find(table(spark, sf_dir, "documents"), ["doc_id"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; ids whose crc32 leaves 1 modulo 3 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = remainder(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), rest != 1)
    return toxicity.score(docs.withColumn("held_out", F.coalesce(rest == 1, F.lit(False))), model, ["doc_id", "held_out"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, as pairs."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, exactly or nearly."""
    return linededup.find(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what its text and loss mask say when they are read back."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_trees(chat.chain(messages))
    read = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learnt", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.when(~F.col("tree.none"), F.col("tree.conv").cast("long")).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; ids whose crc32 leaves 2 modulo 4 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = remainder(F.col("doc_id"), 4)
    model = langid.fit(docs, F.col("lang"), rest != 2)
    return langid.predict(docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False))), model, ["doc_id", "held_out"])


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every text by context-tree weighting, learnt from ids whose crc32 does not leave 2 modulo 7."""
    rest = remainder(F.col("doc_id"), 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return lmscore.score_documents(docs, ~F.col("held_out") & F.col("doc_id").isNotNull(), ["doc_id", "held_out"])


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all texts."""
    return neardup.find(table(spark, sf_dir, "documents"))


def op11_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text in files, as they are read back."""
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark)
    tokenfile.write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.digest(spark, folder, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order of applying them, by source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_convrepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the stated damage."""
    return convrepair.repair(convrepair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_pii, op3_toxicity, op4_decontaminate, op5_linededup, op6_chat, op7_fingerprint, op8_langid, op9_lmscore, op10_neardup, op11_tokenfile, op12_filteraudit, op13_convrepair)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


#: By query; the other operators learn, hash or encode in ways that DuckDB's SQL can't express.
SQL = {
    "op6_chat": r"""
with said as (select '\### Assistant: </turn> ok' as s),
m as (select conv_id, turn, role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', s from said union all select -7, 1, 'assistant', s from said),
e as (select *, length(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')) as body, length(replace(role, ':', '\3')) as head from m)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
sum(length('### ') + head + length(': ') + body + length('</turn>') + 1)::bigint as formatted_chars from e group by conv_id""",
    "op12_filteraudit": r"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as low from t),
f as (select doc_id, part, case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end || case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end
|| case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end || case when doc_id > low then 'E' else '' end as failed from w),
l as (select doc_id, max(coalesce(quality = 1, false)::int) as good, max(coalesce(toxic = 1, false)::int) as toxic from labels group by doc_id),
s as (select part, failed, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by all),
c as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || d.c || e.c || g.c as filter_order from c a, c b, c d, c e, c g where b.c <> a.c and d.c not in (a.c, b.c) and e.c not in (a.c, b.c, d.c) and g.c not in (a.c, b.c, d.c, e.c)),
k as (select filter_order, i as step, substr(filter_order, i, 1) as letter, substr(filter_order, 1, i - 1) as before from o, range(1, 6) r(i)),
x as (select s.*, k.*, contains(failed, letter) as fails, not exists (select 1 from range(1, 6) q(j) where j < step and contains(failed, substr(filter_order, j, 1))) as passed from s, k),
r as (select part, filter_order, step, letter, coalesce(sum(n) filter (where passed and not fails), 0) as kept, coalesce(sum(n) filter (where passed and fails), 0) as removed, coalesce(sum(n) filter (where fails and not passed), 0) as redundant,
coalesce(sum(n) filter (where failed = letter), 0) as unique_fails, coalesce(sum(good) filter (where passed and fails), 0) as good_lost, coalesce(sum(toxic) filter (where passed and fails), 0) as toxic_lost from x group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
