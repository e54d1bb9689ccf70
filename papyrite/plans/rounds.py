"""Rounds of retrieval, budgets and expansion, for all questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.operators import budget as B
from papyrite.operators import expand as X
from papyrite.operators import rounds as R
from papyrite.operators.evidence import BETWEEN, FORMULA
from papyrite.plans.registry import Registry, table
from papyrite.stored import cut

REGISTRY = Registry()

_LONG = "[a-z]{7,}"
_GAP = " or ".join(f"contains(term, '{m}')" for m in R.LITERAL_GAP)


@REGISTRY.query(rf"""with l as (select item_id, regexp_extract_all(lower(text), '{_LONG}') as w from benchmark), d as (select item_id, list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 5) as w from l),
t as (select item_id as question, i, w[i] as term from d, range(1, 6) r(i) where i <= len(w)),
p as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '{_LONG}')) as term from documents) where term in (select term from t) group by all),
tools as (select 'search_hybrid' as tool, term, id, tf as tokens, row_number() over (partition by term order by tf desc, id) as place from p qualify place <= 3 union all select 'grep_document_chunks', term, id, tf, row_number() over (partition by term order by id) as place from p qualify place <= 2),
c0 as (select question, 'search_hybrid' as tool, term from t where i = 1), h0 as (select question, tool, term, id, tokens, place from c0 join tools using (tool, term)), w0 as (select distinct question, id from h0),
s0 as (select distinct question, t.term from t join w0 using (question) join p on p.term = t.term and p.id = w0.id), l0 as (select distinct question, term from t where not exists (select 1 from s0 where s0.question = t.question and s0.term = t.term)),
m as (select question, bool_or({_GAP} or regexp_matches(term, '\b(?:figure|table)\s+\d+\b')) as literal from l0 group by question),
c1 as (select * from (select question, 'search_hybrid' as tool, term from l0 union all select l0.question, 'grep_document_chunks', term from l0 join m using (question) where literal) except select * from c0),
h1 as (select question, tool, term, id, tokens, place from c1 join tools using (tool, term)), w1 as (select distinct question, id from h1 where not exists (select 1 from w0 where w0.question = h1.question and w0.id = h1.id)),
s1 as (select distinct l0.question, l0.term from l0 join (select * from w0 union all select * from w1) w using (question) join p on p.term = l0.term and p.id = w.id),
calls as (select 0 as round, c.question, sum(tokens) as tokens from c0 c left join h0 using (question, tool, term) group by c.question, c.tool, c.term union all select 1, c.question, sum(tokens) from c1 c left join h1 using (question, tool, term) group by c.question, c.tool, c.term),
k as (select question, round, count(*) as calls, count(*) filter (where tokens is null) as empty, count(*) filter (where tokens > 20) as overflow from calls group by all)
select k.question, k.round::int as round, calls, empty, overflow, coalesce(e.n, 0) as new_evidence, coalesce(s.n, 0) as satisfied from k left join (select 0 as round, question, count(*) as n from w0 group by question union all select 1, question, count(*) from w1 group by question) e using (round, question)
left join (select 0 as round, question, count(*) as n from s0 group by question union all select 1, question, count(*) from s1 group by question) s using (round, question)""")
def retrieval_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of calls by question: what they found that was new, and which long words of the item it covers."""
    found = lambda text: F.regexp_extract_all(F.lower(text), F.lit(_LONG), F.lit(0))
    terms = cut(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.posexplode(F.slice(F.array_distinct(found(F.col("text"))), 1, 5)).alias("i", "requirement")))
    asked = terms.select(F.col("requirement").alias("term")).distinct()
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.explode(found(F.col("text"))).alias("term"))
    posts = cut(words.join(asked, "term", "left_semi").groupBy("term", "evidence_id").agg(F.count("*").alias("tokens")))
    ranked = posts.withColumn("often", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("tokens"), "evidence_id"))).withColumn("first", F.row_number().over(Window.partitionBy("term").orderBy("evidence_id")))
    hybrid = ranked.where("often <= 3").select(F.lit("search_hybrid").alias("tool"), F.col("term").alias("query"), "evidence_id", F.col("often").alias("place"), "tokens")
    grep = ranked.where("first <= 2").select(F.lit("grep_document_chunks").alias("tool"), F.col("term").alias("query"), "evidence_id", F.col("first").alias("place"), "tokens")
    answers = cut(hybrid.unionByName(grep))

    def covered(workspace: DataFrame, left: DataFrame) -> DataFrame:
        held = left.join(posts.select(F.col("term").alias("requirement"), "evidence_id"), "requirement")
        return held.join(workspace.select("question", "evidence_id"), ["question", "evidence_id"], "left_semi")

    calls = terms.where("i = 0").select("question", F.lit("search_hybrid").alias("tool"), F.col("requirement").alias("query"))
    records, workspace, needs = R.retrieve(calls, terms.select("question", "requirement", F.col("requirement").alias("description")), lambda c: c.join(answers, ["tool", "query"]), covered, 20)
    told = records.groupBy("question", "round").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "overflow").alias("overflow"))
    new = workspace.groupBy("question", "round").agg(F.count("*").alias("new_evidence"))
    done = needs.where("round is not null").groupBy("question", "round").agg(F.count("*").alias("satisfied"))
    out = told.join(new, ["question", "round"], "left").join(done, ["question", "round"], "left")
    return out.select("question", "round", "calls", "empty", "overflow", F.coalesce("new_evidence", F.lit(0)).alias("new_evidence"), F.coalesce("satisfied", F.lit(0)).alias("satisfied"))


_SPLIT = ", ".join(f"floor(n_chars * ({share} / {B.TOTAL}.0::double))::bigint as {name}" for name, share in B.ALLOCATION.items() if name != "document_evidence")


@REGISTRY.query(f"with s as (select doc_id, n_chars, {_SPLIT} from documents where n_chars > 0) select doc_id, system_and_tools, conversation, question_and_plan, n_chars - system_and_tools - conversation - question_and_plan - answer_reserve - miscellaneous as document_evidence, answer_reserve, miscellaneous from s")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window as large as each document, split by shares; the evidence gets what rounding leaves."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    return docs.select("doc_id", *[c.alias(name) for name, c in B.split(F.col("n_chars")).items()])


_TOK = "case when coalesce(length({0}), 0) = 0 then 0 else greatest(1, length({0}) // 4) end"
_EVIDENCE = f"""ev as (select doc_id % 60 as question, doc_id::varchar as evidence_id, case when doc_id % 11 = 0 then 'aggregated_evidence' else 'chunk' end as source_type, source as document_id, case when doc_id % 3 <> 0 then lang end as section, text as content, doc_id % 5 as page_start, doc_id % 5 + 1 as page_end, (doc_id % 17) / 16.0::double as score, doc_id as seq from documents),
qs as (select item_id as question, 6000 + 400 * item_id as win, item_id % 10 = 0 as deep, text as goal, left(text, 40) as rationale from benchmark where item_id < 60),
spent as (select question, sum(n) as n from (select question, {_TOK.format('content')} as n from ev union all select conv_id % 60, {_TOK.format('text')} from conversations) group by question),
over as (select qs.*, coalesce(n, 0) + {_TOK.format('goal')} + {_TOK.format('rationale')} as used, win - floor(win * 0.2::double)::bigint as ceiling from qs left join spent using (question)),
hot as (select question from over where not deep and used > ceiling)"""


def _budgeted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    evidence = docs.select(
        (i % 60).alias("question"), i.cast("string").alias("evidence_id"), F.when(i % 11 == 0, B.AGGREGATED).otherwise("chunk").alias("source_type"), F.col("source").alias("document_id"), F.when(i % 3 != 0, F.col("lang")).alias("section"),
        F.col("text").alias("content"), (i % 5).alias("page_start"), (i % 5 + 1).alias("page_end"), ((i % 17) / 16.0).alias("score"), i.alias("seq"),
    )
    q = F.col("item_id")
    questions = table(spark, sf_dir, "benchmark").where("item_id < 60").select(q.alias("question"), (6000 + 400 * q).alias("window"), (q % 10 == 0).alias("deep"), F.col("text").alias("goal"), F.left("text", F.lit(40)).alias("rationale"))
    history = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 60).alias("question"), "text")
    return evidence, B.exceeded(questions, evidence, history)


@REGISTRY.query(f"with {_EVIDENCE} select question, used::bigint as used, ceiling, (not deep and used > ceiling) as overflow from over")
def budget_exceeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence, history and plan of each question take, and whether that leaves room for an answer."""
    return _budgeted(spark, sf_dir)[1].select("question", "used", "ceiling", "overflow")


_JOINED = f"left(coalesce(string_agg(content, chr(10) || '{BETWEEN.strip()}' || chr(10) order by seq) filter (where content <> ''), ''), 200)"
_H = "sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode('aggregate:' || document_id || ':' || coalesce(section, '')))"
_UUID = "lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12))"


@REGISTRY.query(f"""with {_EVIDENCE}, g as (select question, document_id, section, {_JOINED} as content, min(page_start) as page_start, max(page_end) as page_end, max(score) as score, {_H} as h from ev where question in (select question from hot) group by question, document_id, section)
select question, {_UUID} as evidence_id, 'aggregated_evidence' as source_type, section, content, page_start, page_end, round(score, 6) as score from g union all
select question, evidence_id, source_type, section, content, page_start, page_end, round(score, 6) from ev where source_type = 'aggregated_evidence' or question not in (select question from hot)""")
def overflow_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of questions over their budget as a row for each document and section, that of others as it is."""
    evidence, told = _budgeted(spark, sf_dir)
    out = B.replace(evidence, cut(told.where("overflow")), 50)
    return out.select("question", "evidence_id", "source_type", "section", "content", "page_start", "page_end", F.round("score", 6).alias("score"))


_KIND = "case (doc_id + pos) % 6 when 0 then 'equation' when 1 then 'figure' when 2 then 'table' else 'paragraph' end"
_SAID = "case when (doc_id + pos) % 9 = 4 then '' when (doc_id + pos) % 6 = 1 then 'Figure ' || pos % 4 || ' ' || left(line, 60) when (doc_id + pos) % 7 = 3 then left(line, 40) || ' as follows' else left(line, 90) end"
_QUERY = "case doc_id % 4 when 0 then 'the formula of it' when 1 then 'what does Figure 2 say' when 2 then 'plain words' else 'see table 3' end"
_ISF = " or ".join(f"contains(lower(query), '{m}')" for m in FORMULA)


@REGISTRY.query(rf"""with recursive n as (select doc_id, i - 1 as pos, l[i] as line from (select doc_id, string_split(text, chr(10)) as l from documents) t, range(1, len(l) + 1) r(i)),
nodes as (select doc_id, pos, {_KIND} as kind, pos // 4 as parent, case when pos % 5 = 0 then 'Head ' || pos end as title, {_SAID} as said, pos // 6 + 1 as page from n),
hits as (select doc_id, pos, kind, parent, said, {_QUERY} as query from nodes where pos % 6 = doc_id % 6),
h as (select *, {_ISF} as formula, lower(regexp_extract(query, '(?i)\b(figure|table)\s+(\d+)\b', 1)) as mod, lower(regexp_extract(query, '(?i)\b(figure|table)\s+(\d+)\b', 0)) as wanted, greatest(160, length(said)) as budget from hits),
o as (select h.doc_id, h.pos, s.pos as near, s.kind as nk, s.said as ns, 2 * abs(s.pos - h.pos) + case when (s.pos > h.pos) = (formula or contains(lower(h.said), 'as follows')) then 0 else 1 end as turn from h join nodes s on s.doc_id = h.doc_id and s.pos between h.pos - 5 and h.pos + 5 and s.pos <> h.pos
where s.said <> '' and not (s.parent <> h.parent and s.kind not in ('equation', 'table', 'figure')) and not (mod <> '' and regexp_matches(lower(s.said), '\b' || mod || '\s+\d+\b') and not contains(lower(s.said), wanted))),
q as (select *, row_number() over (partition by doc_id, pos order by turn) as n from o),
f as (select doc_id, pos, 0::bigint as n, length(said)::bigint as total, [pos] as taken, false as stop, formula, budget from h union all
select f.doc_id, f.pos, f.n + 1, case when not stop and (total + length(ns) + 32 <= budget or (formula and nk = 'equation')) then total + length(ns) + 32 else total end, case when not stop and (total + length(ns) + 32 <= budget or (formula and nk = 'equation')) then list_append(taken, near) else taken end,
stop or ((total + length(ns) + 32 <= budget or (formula and nk = 'equation')) and total + length(ns) + 32 >= budget), formula, budget from f join q on q.doc_id = f.doc_id and q.pos = f.pos and q.n = f.n + 1),
e as (select doc_id, pos, taken from f qualify row_number() over (partition by doc_id, pos order by n desc) = 1)
select e.doc_id, e.pos, coalesce(string_agg('[' || coalesce(s.title, s.kind) || ']' || chr(10) || s.said, chr(10) || chr(10) order by s.pos) filter (where s.said <> ''), '') as content, min(s.page) as page_start, max(s.page) as page_end from e join nodes s on s.doc_id = e.doc_id and list_contains(taken, s.pos) group by e.doc_id, e.pos""")
def grep_expand_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth line of each document with what is near it, in 160 characters."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("pos", F.col("p").cast("long"))
    page = F.floor(F.col("pos") / 6) + 1
    nodes = lines.select(F.col("doc_id").alias("document_id"), F.col("pos").alias("place"), F.expr(_KIND).alias("kind"), F.floor(F.col("pos") / 4).alias("parent_id"), F.when(F.col("pos") % 5 == 0, F.concat(F.lit("Head "), "pos")).alias("title"), F.expr(_SAID).alias("text"), page.alias("page_start"), page.alias("page_end"))
    hits = lines.where("pos % 6 = doc_id % 6").select(F.col("doc_id").alias("question"), F.expr(_QUERY).alias("query"), F.col("doc_id").alias("document_id"), F.col("pos").alias("place"))
    return X.expand(hits, nodes, 160).select(F.col("document_id").alias("doc_id"), F.col("place").alias("pos"), "content", "page_start", "page_end")
