"""Evidence for questions: plans, merges, ranking, coverage, budget, citations."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions import text as T

#: Words and patterns that mark a kind of question. Marks of several words never equal a single word.
SUMMARY = ("summary", "summarize", "summarise", "overview", "摘要", "概述", "introduce", "introduction", "abstract", "what is", "what are", "tell me about")
NUMERIC = (
    "benchmark", "metric", "metrics", "dataset", "accuracy", "score", "performance", "result", "results", "比較", "數值", "指標", "比例",
    "percentage", "number", "numbers", "statistic", "statistics", "experiment", "experiments", "evaluation",
)
COMPARISON = (r"\bcomp(?:are|ared|aring)\b", r"\bvs\.?\b", r"\bversus\b", r"\bbetween\b.+\band\b", r"對比|差異")
ABLATION = (r"\babla(?:te|ted|tion)s?\b", r"\bwithout\b.+\bcomponent\b", r"\bwith and without\b", r"消融")
LITERAL = (r"\btable\s+\d+\b", r"\bfigure\s+\d+\b", r"\bfig\.\s*\d+\b", r"\bformula\b|\bequation\b|\bexpression\b|公式")
LITERAL_MARKS = ("<table", "html", "win rate", "win rates", "cost comparison", "api call", "token", "tokens")
NAME = r"([A-Za-z][A-Za-z0-9_.+-]{1,80})"
SIDES = (rf"\bbetween\s+{NAME}\s+and\s+{NAME}", rf"{NAME}\s+(?:vs\.?|versus)\s+{NAME}", rf"\bcomp(?:are|ared|aring)\s+{NAME}\s+(?:with|and|to)\s+{NAME}")
SIDE_ENDS = " \t\r\n?.,:;()[]{}\"'"
#: Marks of questions about formulas and about tables as HTML.
FORMULA = ("formula", "equation", "expression", "formally represent", "formal representation", "公式", "方程", "數學式", "数学式", "算式")
HTML = ("table", "<table", "html", "rows", "columns")
#: Words that stand for one another in requirements and evidence, and marks of numbers and of ablations.
ALIKE = (
    ("ablation", ("without component", "with and without", "removed", "ablated")),
    ("performance", ("result", "results", "score", "accuracy", "f1", "benchmark")),
    ("formula", ("equation", "latex", "mathematical expression")),
    ("image", ("figure", "plot", "diagram", "caption")),
    ("table", ("tabular", "row", "column")),
)
NUMBER_MARKS = ("table", "score", "scores", "win rate", "f1", "accuracy", "metric", "dataset", "performance decline")
ABLATION_MARKS = ("ablat", "without", "removed", "removing", "-low", "-high", "-origin", "table 2")
ABLATION_NUMBERS = ("table", "numeric", "performance", "comparison", "versions")
#: Marks of questions that want a broad answer.
BROAD = ("summarize", "summary", "compare", "comparison table", "reproduce", "list", "why", "how", "explain", "limitation", "trade-off", "tradeoff", "比較", "比較好", "哪個", "結果", "表格")
#: Fixed value: least similarity that meets a requirement.
SIMILAR = 0.55
NO_ANSWER = "There is not enough information in the current chat's documents to answer this question."


def _any(columns: list[Column]) -> Column:
    return reduce(Column.__or__, columns)


def _has(text: Column, marks: tuple[str, ...]) -> Column:
    return _any([text.contains(m) for m in marks])


def _like(text: Column, patterns: tuple[str, ...]) -> Column:
    return _any([text.rlike("(?iu)" + p) for p in patterns])


def question_kind(question: Column) -> Column:
    """Summary before comparison before ablation before numeric before general; general ones with a label or a literal mark are literal."""
    words = T.tokens(question)
    has = lambda marks: F.arrays_overlap(words, F.array(*map(F.lit, marks)))
    literal = _like(question, LITERAL) | _has(F.lower(question), LITERAL_MARKS)
    return F.when(has(SUMMARY), "summary").when(_like(question, COMPARISON), "comparison").when(_like(question, ABLATION), "ablation").when(has(NUMERIC), "numeric").when(literal, "literal").otherwise("general")


def planned_tools(kind: Column) -> Column:
    """Tools of a question in order."""
    tools = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(kind == "summary", tools("inspect_chat", "fetch_structural_nodes", "grep_document_chunks", "search_hybrid"))
        .when(kind.isin("comparison", "literal"), tools("grep_document_chunks", "search_hybrid"))
        .when(kind.isin("ablation", "numeric"), tools("query_structured_facts", "grep_document_chunks", "search_hybrid"))
        .otherwise(tools("search_hybrid", "grep_document_chunks"))
    )


def information_needs(question: Column) -> Column:
    """What evidence must cover, by the kind of question; the sides of a comparison each for itself and together."""
    kind = question_kind(question)
    a, b = comparison_targets(question)
    needs = lambda *said: F.array(*[s if isinstance(s, Column) else F.lit(s) for s in said])
    between = F.concat(F.lit("between "), a, F.lit(" and "), b)
    return (
        F.when(kind == "summary", needs("high-level overview of chat documents", "document overview summaries", "chapter / section summaries", "representative raw evidence for the document summary"))
        .when((kind == "comparison") & a.isNotNull(), needs(F.concat(F.lit("evidence about "), a), F.concat(F.lit("evidence about "), b), F.concat(F.lit("direct comparison "), between), F.concat(F.lit("performance or cost comparison "), between)))
        .when(kind == "comparison", needs("evidence about each compared method", "direct comparison between the methods", "performance / cost differences when available"))
        .when(kind == "ablation", needs("ablation table or numeric performance results", "ablated variants and removed components", "full versus ablated versions performance comparison"))
        .when(kind == "numeric", needs("structured numeric facts (benchmarks, metrics, datasets)", "contextual evidence for numbers"))
        .otherwise(needs(F.concat(F.lit("relevant content for: "), question)))
    )


def comparison_targets(question: Column) -> tuple[Column, Column]:
    """The two sides of a comparison, by the first pattern that gives two different ones; null where none does."""
    sides = []
    for pattern in SIDES:
        a, b = (F.trim(F.regexp_extract(question, "(?i)" + pattern, g), F.lit(SIDE_ENDS)) for g in (1, 2))
        sides.append(F.when((a != "") & (b != "") & (F.lower(a) != F.lower(b)), F.struct(a.alias("a"), b.alias("b"))))
    found = F.coalesce(*sides)
    return found["a"], found["b"]


def grep_marks(content: Column, required: Column) -> Column:
    """What the literal score needs of a node's text (lower case), whatever the query: HTML tables, sizes, formulas, required terms."""
    wanted = F.aggregate(required, F.lit(0), lambda s, t: s + F.when(content.contains(F.lower(t)), 6).otherwise(-4))
    return F.struct(content.contains("<table").alias("table"), content.rlike(r"\d+[\s,]*(?:×|x)\s*\d+").alias("sized"), content.rlike(r"\\hat|operatorname|\\mathcal|=").alias("math"), wanted.alias("wanted"))


def grep_score(query: Column, shared: Column, query_labels: Column, labels: Column, kind: Column, marks: Column) -> Column:
    """Literal score of a node for a query: ``shared`` terms, labels, modality, HTML, formulas, required terms."""
    q = F.lower(query)
    first = lambda names: F.transform(names, lambda x: F.substring_index(x, " ", 1))
    points = lambda test, n: F.when(test, n).otherwise(0)
    label = F.when(F.arrays_overlap(query_labels, labels), 25).when(F.arrays_overlap(first(query_labels), first(labels)), -12).otherwise(0)
    table = marks["table"]
    formula = _has(q, FORMULA) | q.contains("×") | q.contains("token")
    return (
        shared + label + points(q.contains("figure") & (kind == "figure"), 8) + points(q.contains("table") & ((kind == "table") | table), 10) + points(_has(q, HTML) & table, 12)
        + points(formula & ((kind == "equation") | marks["sized"]), 8) + points(formula & marks["math"], 8) + marks["wanted"]
    )


def label_filter(evidence: DataFrame, question_text: Column) -> DataFrame:
    """Where a question names a figure or table and some of its evidence has it, evidence with another label and without it goes."""
    asked = F.lower(F.regexp_replace(F.regexp_extract(question_text, T.LABEL, 0), r"\s+", " "))
    rows = evidence.withColumn("__asked", asked).withColumn("__has", (F.col("__asked") != "") & F.lower("content").contains(F.col("__asked")))
    known = F.max("__has").over(Window.partitionBy("question"))
    other = F.col("content").rlike(T.LABEL) & ~F.col("__has")
    return rows.withColumn("__known", known).where(~F.col("__known") | ~other).drop("__asked", "__has", "__known")


#: Fixed value: what stands between texts that are joined.
BETWEEN = "\n---\n"


def take_until(ranked: DataFrame, group: str, order: list[Any], tokens: str, most: int) -> DataFrame:
    """Rows of each group in order while those before them hold fewer than ``most`` tokens; the row that crosses stays."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("__before", F.coalesce(F.sum(tokens).over(before), F.lit(0))).where(F.col("__before") < most).drop("__before")


def merge(evidence: DataFrame, question: str = "question", key: str = "evidence_id", order: str = "seq") -> DataFrame:
    """The first row of each piece of evidence."""
    first = Window.partitionBy(question, key).orderBy(order)
    return evidence.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def aggregate(evidence: DataFrame, most_chars: int) -> DataFrame:
    """Evidence of each document and section as one row: texts in order, cut to the budget, pages and best score.

    Only texts that begin within the budget are gathered, so a row holds no more than the budget and one text.
    """
    keys = ["question", "document_id", "section"]
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = evidence.withColumn("__at", F.coalesce(F.sum(F.length("content") + len(BETWEEN)).over(before), F.lit(0)))
    begins = F.when(F.col("__at") - len(BETWEEN) < most_chars, F.struct("seq", "content"))  # what stands before it may be cut too
    merged = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(begins)).alias("c"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.max("score").alias("score"))
    return merged.withColumn("content", F.left(F.array_join(F.transform("c", lambda x: x["content"]), BETWEEN), F.lit(most_chars))).drop("c")


def compact(evidence: DataFrame, budget: int) -> DataFrame:
    """Evidence that fits: the best of each document first, then by score and length while it fits; a later smaller
    piece may still fit, so this is a fold, done for each question by itself.

    Of pieces of as many tokens only the first budget / tokens can be taken, so no more than those reach the fold: a
    question's group is bounded by the budget, not by its evidence. Pieces of no tokens always fit and don't reach it.
    """
    schema = evidence.schema
    order = [F.desc("score"), "tokens", "evidence_id"]
    best = F.row_number().over(Window.partitionBy("question", "document_id").orderBy(*order)) == 1
    place = F.row_number().over(Window.partitionBy("question", "__best", "tokens").orderBy(*order))
    could = evidence.withColumn("__best", best).withColumn("__place", place).where((F.col("tokens") > 0) & (F.col("__place") * F.col("tokens") <= budget)).drop("__place")

    def run(pdf: Any) -> Any:
        pdf = pdf.sort_values(["__best", "score", "tokens", "evidence_id"], ascending=[False, False, True, True])
        kept, used = [], 0
        for at, tokens in zip(pdf.index, pdf["tokens"], strict=True):
            if used + tokens <= budget:
                kept.append(at)
                used += tokens
        return pdf.loc[kept].drop(columns="__best")

    return could.groupBy("question").applyInPandas(run, schema).unionByName(evidence.where("tokens <= 0"))


def markers(answer: Column) -> Column:
    """Numbers of the citation marks ``[cN]`` in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[c(\d+)\]"), F.lit(1)), lambda n: n.cast("int")))


def verified(answer: Column, evidence: Column) -> Column:
    """The answer with every number marked that the evidence doesn't hold, whole numbers only, in order of appearance."""
    missing = F.filter(T.numeric_tokens(answer), lambda n: ~evidence.contains(n))
    return F.aggregate(missing, answer, lambda a, n: F.regexp_replace(a, F.concat(F.lit(r"\b"), F.replace(n, F.lit("."), F.lit(r"\.")), F.lit(r"\b")), F.concat(F.lit("[unverified: "), n, F.lit("]"))))


def _numeric_signal(text: Column) -> Column:
    return text.rlike(T.NUMERIC_TOKEN) | _has(F.lower(text), NUMBER_MARKS)


def coverage(requirement: Column, evidence: Column, vector: Column) -> Column:
    """How well a piece of evidence meets a requirement; over 0 it does.

    In order: a label must be there; both sides of a comparison, with a number where performance is asked; what
    "evidence about" names; marks of an ablation; a similar vector; a shared word; a word that stands for another.
    """
    req, said = F.lower(requirement), F.lower(evidence)
    near = F.coalesce(vector >= SIMILAR, F.lit(False))
    label, number = (F.regexp_extract(req, r"\b(figure|table)\s+(\d+)\b", g) for g in (1, 2))
    exact = said.contains(F.concat(label, F.lit(" "), number)) & ~((label == "table") & req.contains("html") & ~said.contains("<table"))
    sides = [F.nullif(F.regexp_extract(req, p, g), F.lit("")) for g in (1, 2) for p in (rf"between\s+{NAME}\s+and\s+{NAME}", rf"{NAME}\s+versus\s+{NAME}", rf"{NAME}\s+vs\.?\s+{NAME}")]
    a, b = F.coalesce(*sides[:3]), F.coalesce(*sides[3:])
    both = said.contains(a) & said.contains(b) & (~(req.contains("performance") | req.contains("cost")) | _numeric_signal(evidence))
    about = F.trim(F.regexp_extract(req, r"(?s)evidence about (.*)", 1))
    wants = _has(req, ABLATION_NUMBERS)
    removed = _has(said, ABLATION_MARKS) & (~wants | _numeric_signal(evidence))
    alike = _any([(req.contains(anchor) & _has(said, others)) | (_has(req, others) & said.contains(anchor)) for anchor, others in ALIKE])
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    return (
        F.when(label != "", one(exact)).when(a.isNotNull(), one(both)).when(req.contains("evidence about "), one((about != "") & said.contains(about)))
        .when(req.contains("ablation") | req.contains("ablated"), F.when(~wants & near, vector).otherwise(one(removed)))
        .when(near, vector).when(F.arrays_overlap(T.coverage_tokens(requirement), T.coverage_tokens(evidence)), 0.4).when(alike, SIMILAR).otherwise(0.0)
    )


def extractive_answer(evidence: DataFrame, max_chars: int = 8192) -> DataFrame:
    """``question, answer`` from ``question, question_text, marker, content``: the excerpts that share most terms with the question.

    Broad questions take ten of all, others three of those that share a term, or of all if none does. Excerpts come
    as bullets in that order while the characters last; tables may be longer. At most ten short excerpts of a question
    are gathered.
    """
    asked = F.lower("question_text")
    score = F.size(F.array_intersect(T.answer_terms(F.col("question_text")), T.answer_terms(F.col("content"))))
    rows = evidence.withColumn("broad", _has(asked, BROAD)).withColumn("score", score)
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "marker"))
    best = rows.withColumn("n", place).withColumn("top", F.max("score").over(Window.partitionBy("question"))).where((F.col("n") <= F.when(F.col("broad"), 10).otherwise(3)) & (F.col("broad") | (F.col("score") > 0) | (F.col("top") == 0)))
    listed = best.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("n", "marker", "content"))).alias("e"))
    head = "Based on the retrieved document excerpts:"

    def step(state: Column, e: Column) -> Column:
        most = F.when(e["content"].contains("|") | F.lower(e["content"]).contains("table"), 1200).otherwise(360)
        snippet = T.compact_excerpt(e["content"], F.least(most, F.greatest(F.lit(160), F.floor(state["left"] / 2).cast("int"))))
        said = F.concat(F.lit("- "), snippet, F.lit(" [c"), e["marker"].cast("string"), F.lit("]"))
        ends = state["ended"] | ((F.length(said) > state["left"]) & (F.size(state["parts"]) > 1))
        left = state["left"] - F.length(said)
        return F.struct(F.when(ends, state["parts"]).otherwise(F.concat(state["parts"], F.array(said))).alias("parts"), F.when(ends, state["left"]).otherwise(left).alias("left"), (ends | (left <= 120)).alias("ended"))

    begin = F.struct(F.array(F.lit(head)).alias("parts"), F.lit(max_chars - len(head)).alias("left"), F.lit(False).alias("ended"))
    return listed.select("question", F.aggregate("e", begin, step, lambda s: F.array_join(s["parts"], "\n")).alias("answer"))
