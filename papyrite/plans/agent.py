"""Question planning, evidence, budget, citations and evaluation, for many questions in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions import text as T
from papyrite.operators import evaluation as M
from papyrite.operators import evidence as E
from papyrite.operators import search as S
from papyrite.plans.registry import Registry, table
from papyrite.plans.search import searcher

REGISTRY = Registry()

_Q_SPARK = """case item_id % 8 when 0 then 'Summarize the paper ' || item_id when 1 then 'Compare Model' || item_id || ' with Base' || (item_id % 3) || '.' when 2 then 'What accuracy does it reach, 87.3% or ' || item_id || '?' when 3 then 'What is the difference between Alpha' || item_id || ' and Beta?'
when 4 then 'Where is Figure ' || item_id || ' described?' when 5 then 'Which ablation removed Part' || item_id || '?' when 6 then 'Does Alpha vs alpha or Gamma vs. Delta' || item_id || ' win?' else 'Who wrote part ' || item_id || '?' end"""
_Q = f"q as (select item_id, {_Q_SPARK} as question from benchmark)"
_TOK = r"list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(question), '[^\p{L}\p{N}_\s]', ' ', 'g')), '\s+'), lambda x: x <> ''))"


def _sql_like(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, '{p}', 'i')" for p in patterns) + ")"


def _sql_has(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, '{m}')" for m in marks) + ")"


_KINDS = f"""{_Q}, kinds as (select item_id, question, case when list_has_any({_TOK}, {list(E.SUMMARY)}) then 'summary' when {_sql_like('question', E.COMPARISON)} then 'comparison' when {_sql_like('question', E.ABLATION)} then 'ablation'
when list_has_any({_TOK}, {list(E.NUMERIC)}) then 'numeric' when {_sql_like('question', E.LITERAL)} or {_sql_has('lower(question)', E.LITERAL_MARKS)} then 'literal' else 'general' end as kind from q)"""


def _side(g: int) -> str:
    ends = E.SIDE_ENDS.replace("'", "''")
    a, b = ([f"trim(regexp_extract(question, '{p}', {i}, 'i'), '{ends}')" for p in E.SIDES] for i in (1, 2))
    return "coalesce(" + ", ".join(f"case when {x} <> '' and {y} <> '' and lower({x}) <> lower({y}) then {(x, y)[g - 1]} end" for x, y in zip(a, b, strict=True)) + ")"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.expr(_Q_SPARK).alias("question"))


@REGISTRY.query(f"with {_KINDS} select item_id, kind from kinds")
def plan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the questions."""
    return _questions(spark, sf_dir).select("item_id", E.question_kind(F.col("question")).alias("kind"))


@REGISTRY.query(f"with {_KINDS} select item_id, unnest(case when kind = 'summary' then ['inspect_chat', 'fetch_structural_nodes', 'grep_document_chunks', 'search_hybrid'] when kind in ('comparison', 'literal') then ['grep_document_chunks', 'search_hybrid'] when kind in ('ablation', 'numeric') then ['query_structured_facts', 'grep_document_chunks', 'search_hybrid'] else ['search_hybrid', 'grep_document_chunks'] end) as tool from kinds")
def plan_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned tool calls, a row for each."""
    return _questions(spark, sf_dir).select("item_id", F.explode(E.planned_tools(E.question_kind(F.col("question")))).alias("tool"))


_NEEDS = f"""{_KINDS}, sides as (select *, {_side(1)} as a, {_side(2)} as b from kinds), needs as (select item_id, question, case when kind = 'summary' then ['high-level overview of chat documents', 'document overview summaries', 'chapter / section summaries', 'representative raw evidence for the document summary']
when kind = 'comparison' and a is not null then ['evidence about ' || a, 'evidence about ' || b, 'direct comparison between ' || a || ' and ' || b, 'performance or cost comparison between ' || a || ' and ' || b]
when kind = 'comparison' then ['evidence about each compared method', 'direct comparison between the methods', 'performance / cost differences when available']
when kind = 'ablation' then ['ablation table or numeric performance results', 'ablated variants and removed components', 'full versus ablated versions performance comparison']
when kind = 'numeric' then ['structured numeric facts (benchmarks, metrics, datasets)', 'contextual evidence for numbers'] else ['relevant content for: ' || question] end as l from sides)"""


@REGISTRY.query(f"with {_NEEDS} select item_id, i - 1 as requirement, l[i] as description from needs, range(1, len(l) + 1) r(i)")
def plan_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence of each question must cover, a row for each requirement."""
    rows = _questions(spark, sf_dir).select("item_id", F.posexplode(E.information_needs(F.col("question"))).alias("requirement", "description"))
    return rows.withColumn("requirement", F.col("requirement").cast("long"))


@REGISTRY.query(f"with {_KINDS}, t as (select item_id, kind, ['search_hybrid'] as asked from kinds) select item_id, array_to_string(case when kind = 'summary' then ['inspect_chat', 'fetch_structural_nodes'] || asked when kind = 'numeric' then ['query_structured_facts'] || asked else asked end, ',') as tools from t")
def policy_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules put before a plan that only searches."""
    kind, asked = F.col("kind"), F.array(F.lit("search_hybrid"))
    more = F.when(kind == "summary", F.concat(F.array(F.lit("inspect_chat"), F.lit("fetch_structural_nodes")), asked)).when(kind == "numeric", F.concat(F.array(F.lit("query_structured_facts")), asked)).otherwise(asked)
    return _questions(spark, sf_dir).withColumn("kind", E.question_kind(F.col("question"))).select("item_id", F.array_join(more, ",").alias("tools"))


@REGISTRY.query(f"with {_Q}, s as (select item_id, {_side(1)} as a, {_side(2)} as b from q) select item_id, a as target_a, b as target_b from s where a is not null")
def comparison_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the comparisons."""
    a, b = E.comparison_targets(F.col("question"))
    return _questions(spark, sf_dir).select("item_id", a.alias("target_a"), b.alias("target_b")).where("target_a is not null")


_EV = """ev as (select event_id as seq, user_id as question, event_id % 40 as evidence_id, event_id % 7 as document_id, event_id % 3 as section, event_id % 50 as page, round(value, 4) as score, (event_id % 90 + 10)::int as tokens, event_type || event_id as content from events)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("seq"), F.col("user_id").alias("question"), (i % 40).alias("evidence_id"), (i % 7).alias("document_id"), (i % 3).alias("section"), (i % 50).alias("page"), F.round("value", 4).alias("score"), (i % 90 + 10).cast("int").alias("tokens"), F.concat("event_type", i.cast("string")).alias("content"))


@REGISTRY.query(f"with {_EV} select question, evidence_id, min(seq) as seq from ev group by all")
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each piece of evidence."""
    return E.merge(_evidence(spark, sf_dir)).select("question", "evidence_id", "seq")


@REGISTRY.query(f"with {_EV}, f as (select * from ev qualify row_number() over (partition by question, evidence_id order by seq) = 1) select question, evidence_id, row_number() over (partition by question order by section, document_id, page, score desc, evidence_id) as place from f")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged evidence in its order: origin, document, page, score."""
    order = Window.partitionBy("question").orderBy("section", "document_id", "page", F.desc("score"), "evidence_id")
    return E.merge(_evidence(spark, sf_dir)).select("question", "evidence_id", F.row_number().over(order).cast("long").alias("place"))


_SAID = "case event_id % 6 when 0 then 'Figure ' || (event_id % 4 + 1) || ' shows ' || event_type when 1 then 'See table  ' || (event_id % 5 + 1) || ' for ' || event_type else event_type || event_id end"
_WANTED = "case user_id % 3 when 0 then 'What does Figure ' || (user_id % 5 + 1) || ' show?' when 1 then 'Read TABLE ' || (user_id % 5 + 1) else 'Why ' || user_id || '?' end"


@REGISTRY.query(rf"""with e as (select event_id as seq, user_id as question, {_SAID} as content, lower(regexp_extract({_WANTED}, '(Figure|Table)\s+[0-9]+', 0, 'i')) as wanted from events), h as (select *, wanted <> '' and contains(lower(content), wanted) as has from e), k as (select *, bool_or(has) over (partition by question) as known from h)
select question, seq from k where not known or has or not regexp_matches(content, '\b(figure|table)\s+[0-9]+\b', 'i')""")
def evidence_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where evidence has the label that was asked for, rows with another label go; else all stay."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("question"), F.expr(_SAID).alias("content"), F.expr(_WANTED).alias("asked"))
    return E.label_filter(rows, F.col("asked")).select("question", "seq")


@REGISTRY.query(f"with {_EV} select question, document_id, section, left(string_agg(content, chr(10) || '---' || chr(10) order by seq), 120) as content, min(page) as page_start, max(page) as page_end, max(score) as score from ev group by question, document_id, section")
def aggregate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence joined for each document and section, cut to the budget."""
    return E.aggregate(_evidence(spark, sf_dir), 120)


@REGISTRY.query(f"with {_EV} select question, sum(tokens)::bigint as tokens, sum(tokens) > 3000 as overflow from ev group by question")
def budget_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose evidence exceeds the budget."""
    return _evidence(spark, sf_dir).groupBy("question").agg(F.sum("tokens").alias("tokens")).withColumn("overflow", F.col("tokens") > 3000)


@REGISTRY.query()
def compact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that fits into 500 tokens; greedy, so SQL has no plain form."""
    return E.compact(_evidence(spark, sf_dir), 500)


@REGISTRY.query(f"with {_EV}, t as (select *, coalesce(sum(tokens) over (partition by question order by score desc, seq rows between unbounded preceding and 1 preceding), 0) as used from ev) select question, seq from t where used < 400")
def grep_take_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows until their tokens reach the limit; the row that crosses stays."""
    return E.take_until(_evidence(spark, sf_dir), "question", [F.desc("score"), "seq"], "tokens", 400).select("question", "seq")


_STOP = ", ".join(f"'{w}'" for w in T.GREP_STOPWORDS)


def _terms(column: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({column}, '{T.TERM}', 0), lambda x: lower(x)), lambda x: x not in ({_STOP})))"


_GREP_Q = "text || case item_id % 4 when 0 then ' in Figure 2' when 1 then ' as HTML of table 3' when 2 then ' by which formula' else '' end"
_GREP_D = "text || case doc_id % 7 when 0 then ' Figure 2 shows it' when 1 then ' <table> table 4' when 2 then ' y = 3 x 4' else '' end"
_GREP_K = "case doc_id % 4 when 0 then 'figure' when 1 then 'equation' when 2 then 'table' else 'paragraph' end"
_GREP_LABELS = r"list_distinct(list_transform(regexp_extract_all({}, '\b(?:Figure|Table)\s+[0-9]+\b', 0, 'i'), lambda x: regexp_replace(lower(x), '\s+', ' ', 'g')))"


@REGISTRY.query(rf"""with d as (select doc_id, {_GREP_D} as said, {_GREP_K} as kind from documents), dt as (select doc_id, kind, lower(said) as c, {_terms('said')} as t, {_GREP_LABELS.format('said')} as l from d),
b as (select item_id, {_GREP_Q} as said from benchmark), bt as (select item_id, lower(said) as q, {_terms('said')} as t, {_GREP_LABELS.format('said')} as l from b),
s as (select item_id, doc_id, len(list_intersect(b.t, d.t)) + case when list_has_any(b.l, d.l) then 25 when list_has_any(list_transform(b.l, lambda x: split_part(x, ' ', 1)), list_transform(d.l, lambda x: split_part(x, ' ', 1))) then -12 else 0 end
+ case when contains(q, 'figure') and kind = 'figure' then 8 else 0 end + case when contains(q, 'table') and (kind = 'table' or contains(c, '<table')) then 10 else 0 end + case when {_sql_has('q', E.HTML)} and contains(c, '<table') then 12 else 0 end
+ case when ({_sql_has('q', E.FORMULA)} or contains(q, '×') or contains(q, 'token')) and (kind = 'equation' or regexp_matches(c, '[0-9]+[\s,]*(?:×|x)\s*[0-9]+')) then 8 else 0 end + case when ({_sql_has('q', E.FORMULA)} or contains(q, '×') or contains(q, 'token')) and regexp_matches(c, '\\hat|operatorname|\\mathcal|=') then 8 else 0 end
+ case when contains(c, 'the') then 6 else -4 end as score from dt d, bt b where list_has_any(b.t, d.t))
select item_id, doc_id, score::int as score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10""")
def grep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents that share a term with an item, by the literal score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_GREP_D).alias("said"), F.expr(_GREP_K).alias("kind"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr(_GREP_Q).alias("q"))
    asked = b.select("item_id", F.explode(T.grep_terms(F.col("q"))).alias("term"))
    own = d.select("doc_id", F.explode(T.grep_terms(F.col("said"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    shared = own.join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    # texts are read once for each document; pairs meet what was found there
    marked = d.select("doc_id", "kind", E.grep_marks(F.lower("said"), F.array(F.lit("the"))).alias("marks"), T.labels(F.col("said")).alias("dl"))
    pairs = shared.join(b.withColumn("ql", T.labels(F.col("q"))), "item_id").join(marked, "doc_id")
    score = E.grep_score(F.col("q"), F.col("shared"), F.col("ql"), F.col("dl"), F.col("kind"), F.col("marks"))
    scored = pairs.select("item_id", "doc_id", score.cast("int").alias("score")).where("score > 0")
    return S.top(scored, 10, query="item_id", id_col="doc_id").select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@REGISTRY.query(f"with {_EV}, w as (select question, document_id, seq, content, lag(content, 1) over o as before, lead(content, 1) over o as after from ev window o as (partition by question, document_id order by seq)) select seq, coalesce(before || ' ', '') || content || coalesce(' ' || after, '') as expanded from w")
def grep_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit with its neighbours in the same document."""
    o = Window.partitionBy("question", "document_id").orderBy("seq")
    return _evidence(spark, sf_dir).select("seq", F.concat_ws(" ", F.lag("content").over(o), "content", F.lead("content").over(o)).alias("expanded"))


_ANS = "ans as (select doc_id, 'It is [c' || (doc_id % 9) || '] and [c' || (doc_id % 4) || '] or [c' || (doc_id % 9) || '] with 12.5% and ' || doc_id as answer from documents)"
_ANSWER = "'It is [c' || (doc_id % 9) || '] and [c' || (doc_id % 4) || '] or [c' || (doc_id % 9) || '] with 12.5% and ' || doc_id"


@REGISTRY.query(rf"with {_ANS}, m as (select doc_id, list_transform(regexp_extract_all(answer, '\[c([0-9]+)\]', 1), lambda x: x::int) as l from ans) select doc_id, l[i] as marker from m, range(1, len(l) + 1) r(i) where list_position(l, l[i]) = i and l[i] between 1 and 6")
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the answers that point to one of six pieces of evidence, first mentions only."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(E.markers(F.expr(_ANSWER))).alias("marker")).where("marker between 1 and 6")


@REGISTRY.query(rf"with {_ANS}, m as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\[c([0-9]+)\]', 1), lambda x: x::int))) as marker from ans) select m.doc_id, marker from m join documents d on d.doc_id = m.marker where d.source = 'src3'")
def citation_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations whose document lies in the collection."""
    docs = table(spark, sf_dir, "documents")
    cited = docs.select("doc_id", F.explode(E.markers(F.expr(_ANSWER))).alias("marker"))
    own = docs.where("source = 'src3'").select(F.col("doc_id").alias("marker"))
    return cited.join(own, "marker", "left_semi").select("doc_id", "marker")


_NUMBERS = "'112 of 12 and ' || (doc_id % 50) || '.5% or ' || (doc_id % 9) || ' in ' || doc_id"
_GIVEN = "case when doc_id % 2 = 0 then 'all 112' else 'x' || doc_id || ' 2.5' end"


@REGISTRY.query(rf"""with a as (select doc_id, {_NUMBERS} as answer, {_GIVEN} as given from documents), m as (select *, list_filter(regexp_extract_all(answer, '\b[0-9]+(?:\.[0-9]+)?%?\b', 0), lambda n: not contains(given, n)) as l from a)
select doc_id, list_reduce(list_prepend(answer, list_filter(l, lambda n, i: list_position(l, n) = i)), lambda a, n: regexp_replace(a, '\b' || replace(n, '.', '\.') || '\b', '[unverified: ' || n || ']', 'g')) as answer from m""")
def numeric_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the numbers marked that the evidence lacks."""
    return table(spark, sf_dir, "documents").select("doc_id", E.verified(F.expr(_NUMBERS), F.expr(_GIVEN)).alias("answer"))


_REQ = "case vec_id % 9 when 0 then 'see Figure 3' when 1 then 'Table 2 as HTML' when 2 then 'direct comparison between Alpha and Beta' when 3 then 'performance of Alpha versus Beta' when 4 then 'evidence about gamma rays' when 5 then 'ablation table results' when 6 then 'ablated parts' when 7 then 'the formula of light' else 'an image of it' end"
_GIVES = "case (vec_id // 9) % 8 when 0 then 'Figure 3 and table 2 show alpha' when 1 then '<table> of Table 2, without beta' when 2 then 'Alpha beats beta' when 3 then 'alpha has 12.5 and beta 13' when 4 then 'on Gamma Rays and light' when 5 then 'removed parts score 7' when 6 then 'an equation in a diagram' else 'nothing' end"
_MEETS = rf"""case when regexp_matches(req, '\b(figure|table)\s+[0-9]+\b') then (contains(said, regexp_extract(req, '\b(figure|table)\s+([0-9]+)\b', 1) || ' ' || regexp_extract(req, '\b(figure|table)\s+([0-9]+)\b', 2)) and not (regexp_extract(req, '\b(figure|table)\s+([0-9]+)\b', 1) = 'table' and contains(req, 'html') and not contains(said, '<table')))::int
when a <> '' then (contains(said, a) and contains(said, b) and (not (contains(req, 'performance') or contains(req, 'cost')) or signal))::int
when contains(req, 'evidence about ') then contains(said, trim(split_part(req, 'evidence about ', 2)))::int
when contains(req, 'ablation') or contains(req, 'ablated') then case when not {_sql_has('req', E.ABLATION_NUMBERS)} and vector >= 0.55 then vector else ({_sql_has('said', E.ABLATION_MARKS)} and (not {_sql_has('req', E.ABLATION_NUMBERS)} or signal))::int end
when vector >= 0.55 then vector when list_has_any(list_filter(regexp_extract_all(req, '[\p{{L}}\p{{N}}_]+', 0), lambda x: x not in {T.COVERAGE_STOPWORDS}), regexp_extract_all(said, '[\p{{L}}\p{{N}}_]+', 0)) then 0.4
when {' or '.join(f"(contains(req, '{k}') and {_sql_has('said', v)}) or ({_sql_has('req', v)} and contains(said, '{k}'))" for k, v in E.ALIKE)} then 0.55 else 0 end"""
_SIGNAL = rf"regexp_matches(said, '\b[0-9]+(?:\.[0-9]+)?%?\b') or {_sql_has('said', E.NUMBER_MARKS)}"


def _pair(column: str, g: int) -> str:
    """A side of a comparison that a requirement (lower case) names."""
    name = E.NAME.replace("A-Z", "")
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({column}, '{p}', {g}), '')" for p in (rf"between\s+{name}\s+and\s+{name}", rf"{name}\s+versus\s+{name}", rf"{name}\s+vs\.?\s+{name}")) + ", '')"


@REGISTRY.query(f"with v as (select vec_id, lower({_REQ}) as req, lower({_GIVES}) as said, label / 10.0 as vector from embeddings), p as (select *, {_pair('req', 1)} as a, {_pair('req', 2)} as b, {_SIGNAL} as signal from v) select vec_id, round(({_MEETS})::double, 6) as coverage from p")
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each piece of evidence meets a requirement, by every rule."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(_REQ).alias("r"), F.expr(_GIVES.replace("(vec_id // 9)", "(vec_id div 9)")).alias("e"), (F.col("label") / 10).alias("v"))
    return rows.select("vec_id", F.round(E.coverage(F.col("r"), F.col("e"), F.col("v")), 6).alias("coverage"))


@REGISTRY.query(f"""with {_NEEDS}, req as (select item_id, i - 1 as requirement, lower(l[i]) as req from needs, range(1, len(l) + 1) r(i)), ev as (select event_id as evidence, user_id as item_id, lower({_GIVES.replace('vec_id', 'event_id')}) as said, value / 100 as vector from events),
p as (select req.item_id, requirement, req, evidence, said, vector, {_pair('req', 1)} as a, {_pair('req', 2)} as b, {_SIGNAL} as signal from req left join ev using (item_id)), m as (select item_id, requirement, evidence, coalesce({_MEETS}, 0) > 0 as met from p),
g as (select item_id, requirement, bool_or(met) as met, array_to_string(list_slice(list_sort(list(evidence) filter (where met)), 1, 5), ',') as first_five from m group by all) select item_id, requirement, met, coalesce(first_five, '') as first_five from g""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any evidence of its question meets each requirement, and the first five that do."""
    return _coverage(spark, sf_dir).select("item_id", "requirement", "met", F.array_join("first_five", ",").alias("first_five"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    gives = F.expr(_GIVES.replace("(vec_id // 9)", "(event_id div 9)"))
    evidence = table(spark, sf_dir, "events").select(F.col("event_id").alias("evidence"), F.col("user_id").alias("item_id"), gives.alias("said"), (F.col("value") / 100).alias("vector"))
    met = F.coalesce(E.coverage(F.col("description"), F.col("said"), F.col("vector")) > 0, F.lit(False))
    pairs = plan_requirements(spark, sf_dir).join(evidence, "item_id", "left").withColumn("met", met)
    first = F.row_number().over(Window.partitionBy("item_id", "requirement", "met").orderBy("evidence"))
    kept = F.when(F.col("met") & (F.col("n") <= 5), F.col("evidence"))
    return pairs.withColumn("n", first).groupBy("item_id", "requirement").agg(F.max("met").alias("met"), F.array_sort(F.collect_list(kept)).alias("first_five"))


@REGISTRY.query(f"""with c as ({{check}}) select item_id, count(*) filter (where met) as satisfied, count(*) as total, round(avg(met::int), 6) as ratio from c group by item_id""".replace("{check}", REGISTRY.sql["coverage_check"]))
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each question's requirements that its evidence meets."""
    return _coverage(spark, sf_dir).groupBy("item_id").agg(F.count_if("met").alias("satisfied"), F.count("*").alias("total"), F.round(F.avg(F.col("met").cast("int")), 6).alias("ratio"))


@REGISTRY.query("""select item_id, description from (with c as ({check}), r as ({needs}) select r.item_id, r.description from r join c on c.item_id = r.item_id and c.requirement = r.requirement where not c.met)""".replace("{check}", REGISTRY.sql["coverage_check"]).replace("{needs}", REGISTRY.sql["plan_requirements"]))
def gap_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that nothing meets: the queries of the next round."""
    open_ = _coverage(spark, sf_dir).where("not met").select("item_id", "requirement")
    return plan_requirements(spark, sf_dir).join(open_, ["item_id", "requirement"]).select("item_id", "description")


_BM = r"""posts as (select doc_id as id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0)) as term from documents) group by all),
lens as (select id, sum(tf) as len from posts group by id), stats as (select (select count(*) from documents) as n, (select sum(tf) from posts) / (select count(*) from documents) as avgdl),
terms as (select distinct item_id as query, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0)) as term from benchmark), freq as (select term, count(*) as df from posts group by term),
bm as (select query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl))) as score from posts join lens using (id) join freq using (term) join terms using (term), stats group by query, id),
found as (select query, id, row_number() over (partition by query order by round(score, 6) desc, id) as rank from bm qualify rank <= 10),
relevant as (select item_id as query, doc_id as id from benchmark b left join documents d on contains(d.text, b.text) and trim(b.text) <> '')"""
_MEASURES = f"""{_BM}, hits as (select query, rank from found join relevant using (query, id)), s as (select query, count(*) as h, min(rank) as f, sum(1 / log2(rank + 1)) as dcg from hits group by query), n as (select query, count(id) as n from relevant group by query),
m as (select n.query, case when n = 0 then 1.0 else coalesce(h, 0) / n end as recall, coalesce(1 / f, 0) as rr, case when n = 0 then 1.0 else coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) end as ndcg from n left join s using (query))"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = searcher(spark, sf_dir, False).top({"content": 1.0}, 10)
    held = M.holders(docs.select(F.col("doc_id").alias("id"), "text"), items.select(F.col("item_id").alias("query"), "text"))
    return M.ranking_measures(found, items.select(F.col("item_id").alias("query")).join(held, "query", "left"))


@REGISTRY.query(f"with {_MEASURES} select query, round(recall, 6) as recall from m")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the ten best by BM25; the documents that hold an item are relevant."""
    return _measures(spark, sf_dir).select("query", F.round("recall", 6).alias("recall"))


@REGISTRY.query(f"with {_MEASURES} select query, round(rr, 6) as rr from m")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank of the first relevant document."""
    return _measures(spark, sf_dir).select("query", F.round("rr", 6).alias("rr"))


@REGISTRY.query(f"with {_MEASURES} select query, round(ndcg, 6) as ndcg from m")
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised discounted gain."""
    return _measures(spark, sf_dir).select("query", F.round("ndcg", 6).alias("ndcg"))


@REGISTRY.query(f"with {_MEASURES} select 'bm25' as mode, round(avg(recall), 4) as recall, round(avg(rr), 4) as mrr, round(avg(ndcg), 4) as ndcg, count(*) as cases, avg(recall) >= 0.5 as gate from m")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of a mode and its gate."""
    m = _measures(spark, sf_dir)
    return m.agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.count("*").alias("cases"), (F.avg("recall") >= 0.5).alias("gate")).withColumn("mode", F.lit("bm25"))


@REGISTRY.query(f"with {_BM} select query, count(*) filter (where d.source <> 'src0') as leaked from found join documents d on d.doc_id = id group by query")
def leakage_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an unscoped search that lie outside of one collection."""
    docs = table(spark, sf_dir, "documents")
    found = searcher(spark, sf_dir, False).top({"content": 1.0}, 10)
    return found.join(docs.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("query").agg(F.count_if(F.col("source") != "src0").alias("leaked"))


@REGISTRY.query("""with f as (select distinct l_returnflag as k, l_suppkey as x from lineitem where l_quantity > 49), e as (select distinct l_returnflag as k, l_suppkey as x from lineitem where l_discount > 0.099),
s as (select coalesce(f.k, e.k) as k, count(f.x + e.x) as tp, count(f.x) as nf, count(e.x) as ne from f full outer join e on f.k = e.k and f.x = e.x group by 1)
select k, round(tp / nf, 6) as precision, round(tp / ne, 6) as recall, round(2.0 * tp / (nf + ne), 6) as f1 from s""")
def heading_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of found against expected sets."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_suppkey").alias("x"), "l_quantity", "l_discount")
    scores = M.set_scores(lines.where("l_quantity > 49"), lines.where("l_discount > 0.099"), "k", "x")
    return scores.select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_REPORT = """r as (select (select avg(quality) from labels) as parsing, (select 1 - avg(toxic) from labels) as math, (select avg(quality) + 0.3 from labels) as recall, 0 as leakage, (select 1 - avg(toxic) from labels) as qa)"""


@REGISTRY.query(f"""with {_REPORT}, c as (select unnest(['backend', 'parsing', 'retrieval', 'agent_qa', 'isolation', 'provider', 'frontend']) as category, unnest([10, 15, 20, 20, 15, 10, 10]) as most,
unnest([1.0, 0.7 * parsing + 0.3 * math, case when leakage > 0 then 0 else recall end, qa, 2.0 / 3, 1.0, 1.0]) as share, unnest(['pass', case when parsing >= 1 then 'pass' when parsing >= 0.5 then 'partial' else 'fail' end, case when leakage = 0 and recall >= 0.95 then 'pass' when recall >= 0.5 then 'partial' else 'fail' end, case when qa >= 0.85 then 'pass' when qa >= 0.5 then 'partial' else 'fail' end, 'partial', 'pass', 'pass']) as status from r),
e as (select category, most, round(most * share, 2) as earned, status from c) select category, most, round(earned, 2)::double as earned, status, round(sum(earned) over (), 2)::double as total, (bool_and(case when category in ('parsing', 'retrieval') then status <> 'fail' when category = 'isolation' then false when category = 'provider' then status = 'pass' else true end) over ()) as gates_passed,
round(sum(earned) over (), 2) >= 90 and gates_passed as passed from e""")
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven weighted categories to 100 with the gates that must hold, from a row of reports and one flag that fails."""
    q = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("parsing"), (1 - F.avg("toxic")).alias("math"), (F.avg("quality") + 0.3).alias("recall"), F.lit(0).alias("leakage"), (1 - F.avg("toxic")).alias("qa"))
    return M.scorecard(q, session_isolation=False)


@REGISTRY.query(f"with {_MEASURES}, b as (select 'all' as mode, * from m union all select 'even', * from m where query % 2 = 0) select mode, round(avg(recall), 4) as recall, round(avg(rr), 4) as mrr, round(avg(ndcg), 4) as ndcg, count(*) as cases from b group by mode")
def mode_macro_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of each mode's cases."""
    m = _measures(spark, sf_dir)
    modes = m.withColumn("mode", F.explode(F.when(F.col("query") % 2 == 0, F.array(F.lit("all"), F.lit("even"))).otherwise(F.array(F.lit("all")))))
    return modes.groupBy("mode").agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.count("*").alias("cases"))


@REGISTRY.query("select source as kind, count(*) as total, sum(quality)::bigint as passed, count(*) - sum(quality)::bigint as failed, round(avg(quality), 4) as pass_rate from labels join documents using (doc_id) group by source")
def kind_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases passed and failed by kind."""
    cases = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind")), "doc_id")
    return M.pass_rates(cases, "kind", F.col("quality") == 1)


@REGISTRY.query()
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of the assistant's turns that share most terms with the first user turn; a fold, so SQL has no plain form."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), "turn", "role", "text")
    asked = c.where("role = 'user'").groupBy("question").agg(F.min_by("text", "turn").alias("question_text"))
    said = c.where("role = 'assistant'").withColumn("marker", F.row_number().over(Window.partitionBy("question").orderBy("turn")))
    return E.extractive_answer(said.select("question", "marker", F.col("text").alias("content")).join(asked, "question"))
