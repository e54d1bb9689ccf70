"""Rounds, budgets, expansion, replies, citations and narrations against plain versions."""

import json
import random

from pyspark.sql import functions as F

from papyrite.operators import budget, citations, encoders, evidence, expand, replies, rounds

NODE = "document_id string, place long, kind string, parent_id long, title string, text string, page_start int, page_end int"


def plain_expand(query, nodes, at, most):
    """The neighbours of one hit, one after the other."""
    import re

    centre = nodes[at]
    said = centre["text"] or ""
    limit, total, chosen = max(most, len(said)), len(said), {at}
    formula = any(m in query.lower() for m in evidence.FORMULA)
    label = re.search(r"\b(figure|table)\s+(\d+)\b", query, re.I)
    behind = formula or "as follows" in said.lower()
    for distance in range(1, 6):
        for step in (distance, -distance) if behind else (-distance, distance):
            near = nodes.get(at + step)
            if near is None or not near["text"]:
                continue
            if None not in (centre["parent"], near["parent"]) and near["parent"] != centre["parent"] and near["kind"] not in ("equation", "table", "figure"):
                continue
            if label and re.search(rf"\b{label[1]}\s+\d+\b", near["text"], re.I) and f"{label[1]} {label[2]}".lower() not in near["text"].lower():
                continue
            projected = total + len(near["text"]) + 32
            if projected > limit and not (formula and near["kind"] == "equation"):
                continue
            chosen.add(at + step)
            total = projected
            if total >= limit:
                break
        else:
            continue
        break
    parts = [f"[{nodes[i]['title'] or nodes[i]['kind']}]\n{nodes[i]['text']}" for i in sorted(chosen) if nodes[i]["text"]]
    return "\n\n".join(parts), min(nodes[i]["page"] for i in chosen), max(nodes[i]["page"] for i in chosen)


def test_expansion_against_a_plain_walk(spark):
    rng = random.Random(3)
    texts = ["", None, "short", "it is as follows", "Figure 2 shows", "figure 3 and more", "Table 1", "x" * 60, "y" * 140]
    documents = {f"d{d}": {i: {"kind": rng.choice(["paragraph", "equation", "table", "figure"]), "parent": rng.choice([None, 1, 1, 2]), "title": rng.choice([None, "", "Head"]), "text": rng.choice(texts), "page": i // 3} for i in range(12)} for d in range(8)}
    rows = [(d, i, n["kind"], n["parent"], n["title"], n["text"], n["page"], n["page"]) for d, nodes in documents.items() for i, n in nodes.items()]
    hits = [(k, rng.choice(["the formula", "Figure 2 please", "see Table 9", "plain"]), f"d{rng.randrange(8)}", rng.randrange(14)) for k in range(60)]
    got = {r.question: (r.content, r.page_start, r.page_end) for r in expand.expand(spark.createDataFrame(hits, "question long, query string, document_id string, place long"), spark.createDataFrame(rows, NODE), 120).collect()}
    assert got == {k: plain_expand(q, documents[d], at, 120) for k, q, d, at in hits if at in documents[d]}


def test_rounds_end_and_ask_nothing_twice(spark):
    facts = spark.createDataFrame([("search_hybrid", "a", 1), ("search_hybrid", "a", 1), ("search_hybrid", "b row", 2), ("grep_document_chunks", "b row", 3), ("search_hybrid", "c", None)], "tool string, query string, evidence_id long").withColumn("place", F.lit(1)).withColumn("tokens", F.lit(15))
    asked = []

    def tool(calls):
        asked.append(sorted((r.question, r.tool, r.query) for r in calls.collect()))
        return calls.join(facts, ["tool", "query"])

    def covered(workspace, left):
        return left.join(workspace.select("question", F.col("query").alias("requirement")), ["question", "requirement"], "left_semi")

    needs = spark.createDataFrame([(1, r, r) for r in ("a", "b row", "nowhere")] + [(2, "a", "a"), (3, "c", "c")], "question long, requirement string, description string")
    calls = spark.createDataFrame([(1, "search_hybrid", "a"), (2, "search_hybrid", "a"), (3, "search_hybrid", "zzz")], "question long, tool string, query string")
    records, workspace, done = rounds.retrieve(calls, needs, tool, covered, 20)
    assert len(asked) == 2 and asked[1] == [(1, t, q) for t in ("grep_document_chunks", "search_hybrid") for q in ("b row", "nowhere")] + [(3, "search_hybrid", "c")]
    status = {(r.question, r.tool, r.query): (r.round, r.status, r.sources) for r in records.collect()}
    assert status[1, "search_hybrid", "a"] == (0, "overflow", 2) and status[3, "search_hybrid", "zzz"] == (0, "empty", 0) and status[1, "search_hybrid", "b row"] == (1, "ok", 1)
    assert sorted((r.question, r.evidence_id or 0, r.round) for r in workspace.collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 0), (3, 0, 1)]
    assert {(r.question, r.requirement): r.round for r in done.collect()} == {(1, "a"): 0, (1, "b row"): 1, (1, "nowhere"): None, (2, "a"): 0, (3, "c"): 1}
    told = spark.range(1).select(rounds.score_of(F.lit(0.0), F.lit(None).cast("double"), F.lit(0.3), F.lit(0.1)).alias("a"), rounds.score_of(*[F.lit(0.0)] * 4).alias("b")).first()
    assert (told.a, told.b) == (0.3, 0.0)


def test_budget_shares_and_overflow(spark):
    windows = [10_000, 1, 7, 4096, 128_000, 0, None]
    got = spark.createDataFrame([(w,) for w in windows], "w long").select("w", F.struct(*[c.alias(n) for n, c in budget.split(F.col("w")).items()]).alias("s")).collect()
    for r in got:
        parts = r.s.asDict()
        if r.w:
            plain = {n: int(v * (r.w / 10_000)) for n, v in budget.ALLOCATION.items() if n != "document_evidence"}
            assert {n: v for n, v in parts.items() if n != "document_evidence"} == plain and sum(parts.values()) == r.w
        else:
            assert set(parts.values()) == {None}
    rows = [(1, "e1", "chunk", "d", None, "abcd" * 50, 1, 2, 0.5, 1), (1, "e2", "chunk", "d", None, "", 4, 9, None, 2), (1, "e3", "chunk", "d", "s", "other", 3, 3, 0.1, 3), (1, "old", budget.AGGREGATED, "x", "t", "kept", 1, 1, None, 4), (2, "e5", "chunk", "d", None, "stays", 1, 1, 0.2, 5)]
    items = spark.createDataFrame(rows, "question long, evidence_id string, source_type string, document_id string, section string, content string, page_start int, page_end int, score double, seq long")
    told = budget.exceeded(spark.createDataFrame([(1, 60, False, "g" * 8, None), (2, 60, None, "", ""), (3, 10, True, "g" * 999, "")], "question long, window long, deep boolean, goal string, rationale string"), items, spark.createDataFrame([(1, "hello you")], "question long, text string"))
    assert {r.question: (r.used, r.ceiling, r.overflow) for r in told.collect()} == {1: (50 + 1 + 1 + 2 + 2, 48, True), 2: (1, 48, False), 3: (249, 8, False)}
    out = {(r.question, r.section, r.source_type, r.content, r.page_start, r.page_end, r.score) for r in budget.replace(items, told.where("overflow"), 20).collect()}
    assert out == {(1, None, budget.AGGREGATED, "abcd" * 20, 1, 9, 0.5), (1, "s", budget.AGGREGATED, "other", 3, 3, 0.1), (1, "t", budget.AGGREGATED, "kept", 1, 1, None), (2, None, "chunk", "stays", 1, 1, 0.2)}


def test_pieces_of_no_tokens_are_all_kept(spark):
    rows = [(1, f"z{i}", "d", 0, 0.1) for i in range(50)] + [(1, "a", "d", 5, 0.9), (1, "b", "e", 6, 0.8), (1, "c", "d", 5, 0.7)]
    items = spark.createDataFrame(rows, "question long, evidence_id string, document_id string, tokens long, score double")
    got = {r.evidence_id for r in evidence.compact(items, 12).collect()}
    assert got == {f"z{i}" for i in range(50)} | {"a", "b"}


def test_replies(spark):
    call = lambda **k: {"tool": "search_hybrid", **k}
    document = "123e4567-e89b-12d3-a456-426614174000"
    good = [{"action": "no_info"}, {"action": "search_more", "tool_calls": [call(query="a {b}", document_id=document)]}, {"action": "search_more", "tool_calls": [call(fact_filter={"kinds": ["metric"], "keys": ["x"]}), call(tool="inspect_document")], "reasoning": "why"}]
    bad = [{}, {"action": "go"}, {"action": "search_more", "x": 1}, {"action": "search_more", "tool_calls": [call()] * 5}, {"action": "search_more", "tool_calls": [call(sql="x")]}, {"action": "search_more", "tool_calls": [call(query="q" * 201)]}, {"action": "search_more", "tool_calls": [call(fact_filter={"kinds": ["x"]})]}, {"action": "search_more", "tool_calls": [call(fact_filter={"other": []})]}, {"action": "no_info", "reasoning": "r" * 401}, {"action": "search_more", "tool_calls": [{"query": "no tool"}]}, {"action": "search_more", "tool_calls": [call(document_id="7")]}]
    rows = [(i, f"Here: ```{json.dumps(d)}``` done") for i, d in enumerate(good)] + [(100 + i, json.dumps(d)) for i, d in enumerate(bad)] + [(200, None), (201, ""), (202, "} {"), (203, '```json\n{"action": "answer_now"}\n```'), (204, '{"action": "no_info"'), (205, '[{"action": "no_info"}]x')]
    got = {r.question: r for r in replies.decisions(spark.createDataFrame(rows, "question long, reply string")).collect()}
    assert [(got[i].action, got[i].fallback, [c.tool for c in got[i].calls]) for i in range(3)] == [("no_info", False, []), ("search_more", False, ["search_hybrid"]), ("search_more", False, ["search_hybrid", "inspect_document"])]
    assert got[1].calls[0].query == "a {b}" and got[1].calls[0].document_id == document and got[2].calls[0].fact_filter.kinds == ["metric"]
    assert all((got[100 + i].action, got[100 + i].fallback, got[100 + i].calls) == ("answer_now", True, []) for i in range(len(bad)))
    assert [got[i].fallback for i in range(200, 206)] == [True, True, True, False, True, False] and got[203].action == "answer_now"
    told = spark.createDataFrame([([document, "x", None, document.replace("-", "")], ["1", "x", None, "2.5", "-7"])], "u array<string>, n array<string>").select(replies.uuids(F.col("u")).alias("u"), replies.whole_numbers(F.col("n")).alias("n")).first()
    assert told.u == [document, document.replace("-", "")] and [n for n in told.n if n in (1, -7)] == [1, -7]


def test_citations(spark):
    rows = [(1, i, f"d{i % 2}", "s", 1, 2, "c" * 600, i != 2) for i in range(1, 5)]
    items = spark.createDataFrame(rows, "question long, seq long, document_id string, section string, page_start int, page_end int, content string, shown boolean")
    numbered = citations.positions(items, F.col("shown"))
    answers = spark.createDataFrame([(1, "x [c2] [c9][c2] [c1]"), (2, "[c1]"), (3, None)], "question long, answer string")
    found = sorted((r.question, r.nth, r.marker, r.valid, r.place) for r in citations.cite(answers, numbered).collect())
    assert found == [(1, 0, 2, True, 3), (1, 1, 9, False, None), (1, 2, 1, True, 1), (2, 0, 1, False, None)]
    assert sorted(r.place for r in citations.cite(answers, numbered, "place").where("valid").collect()) == [1, 2]
    assert sorted(map(tuple, citations.documents_used(citations.cite(answers, numbered), items).collect())) == [(1, "d0"), (1, "d1")]


def test_narrations(spark):
    blocks = spark.createDataFrame([("d", "a", 1, 0, "paragraph", " first "), ("d", "b", 1, 1, "table", "no"), ("d", "c", 1, 2, "title", "second"), ("d", "e", 2, 0, "paragraph", "z" * 5000)], "document_id string, block_id string, page int, reading_order int, block_type string, text string")
    assert {r.page: r.page_text for r in encoders.page_text(blocks).collect()} == {1: "first\nsecond", 2: "z" * 4000 + " …"}
    told = [("d", "b", "table", 1, 1, "Table 1", "note", None, "<table><tr><td>1</td></tr></table>", None), ("d", "f", "figure", 3, 2, None, "", "x.png", " seen ", None), ("d", "g", "figure", 1, 3, "c", None, None, "x", "failed"), ("d", "h", "figure", 1, 4, "c", None, None, " ", None)]
    out = {r.source_type: r for r in encoders.narrations(spark.createDataFrame(told, "document_id string, block_id string, block_type string, page int, reading_order int, caption string, footnote string, image_path string, narration string, error string"), blocks).collect()}
    assert set(out) == {"table_record", "figure_caption"} and out["table_record"].content.startswith("<table>")
    assert out["table_record"].embedding_content == "Table 1\n\nNatural-language table description: table rows and columns contain 1 |\n\nFootnote: note\n\nSame-page context:\nfirst\nsecond"
    assert (out["figure_caption"].content, out["figure_caption"].title, out["figure_caption"].heading_path) == ("seen", "x.png", "")
