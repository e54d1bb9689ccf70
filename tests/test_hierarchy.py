"""Trees of blocks against a plain fold over each document, and questions about trees."""

import random
import re
import uuid

from pyspark.sql import functions as F

from papyrite.operators import hierarchy, tree

BLOCK = "document_id string, block_id string, page int, reading_order int, block_type string, level int, text string, caption string, footnote string, html string, image_path string"


def fold(document, blocks):
    """The nodes of one document, block by block."""
    nodes, order = [], 0
    node_id = lambda n: str(uuid.uuid5(uuid.NAMESPACE_OID, f"{document}:node:{n}"))

    def add(kind, title, content, members, parent, level):
        nonlocal order
        nodes.append({"order": order, "id": node_id(order), "kind": kind, "title": title, "content": content, "low": min([m["page"] for m in members], default=1), "high": max([m["page"] for m in members], default=1), "parent": parent, "level": level, "ids": [m["block_id"] for m in members]})
        order += 1
        return order - 1

    h1 = [b for b in blocks if b["block_type"] == "title" and b["level"] == 1]
    add("document", h1[0]["text"] if h1 else None, "", h1[:1], None, 0)
    rest = [b for b in blocks if b["block_type"] != "discarded" and b not in h1]
    head = lambda b: b["block_type"] == "title" and b["level"] == 2
    first = next((i for i, b in enumerate(rest) if head(b)), len(rest))
    named = [b for b in rest[:first] if b["block_type"] == "paragraph" and len(b["text"]) < 400 and (re.search(r"<sup>[\d*†‡§¶]+</sup>", b["text"], re.I) or "@" in b["text"]) and len(re.findall(r"\.\s+[A-Z]", b["text"])) < 3]
    if named:
        add("authors", None, " ".join(b["text"] for b in named), named, 0, 1)
    rest = [b for b in rest if b not in named]
    at = next((i for i, b in enumerate(rest) if head(b) and b["text"].strip().lower() == "abstract"), None)
    taken = []
    if at is not None:
        taken = [rest[at]]
        for b in rest[at + 1 :]:
            if head(b):
                break
            if b["block_type"] == "paragraph":
                taken.append(b)
        add("abstract", "Abstract", " ".join(b["text"] for b in taken[1:]), taken, 0, 1)
    else:
        begins = next((b for b in rest if b["page"] == 1 and b["block_type"] == "paragraph" and re.match(r"abstract\s*[—\-–:]\s*", b["text"], re.I)), None)
        if begins:
            taken = [begins]
            add("abstract", "Abstract", begins["text"], taken, 0, 1)
    section = subsection = appendix = None
    inside = False
    for b in (b for b in rest if b not in taken):
        box, level = (subsection, 3) if subsection is not None else (section, 2) if section is not None else (appendix, 2) if appendix is not None else (0, 1)
        if head(b):
            title = b["text"].strip()
            if re.match(r"(references|bibliography)$", title, re.I):
                inside, subsection = False, None
                section = add("section", title, "", [b], 0, 1)
            elif re.match(r"appendix\b|\d+\s+appendix\b|[A-Z]\s+APPENDIX\b", title, re.I):
                inside, section, subsection = True, None, None
                appendix = add("appendix", title, "", [b], 0, 1)
            elif re.match(r"(?:[A-Z]|\d+)(?:\.\d+)+(?:\s|$)", title):
                subsection = add("subsection", title, "", [b], appendix if inside and appendix is not None else section or 0, 2)
            else:
                subsection = None
                if inside:
                    inside, appendix = False, None
                section = add("section", title, "", [b], 0, 1)
        elif b["block_type"] == "reference":
            add("reference", None, b["text"], [b], section or 0, 2)
        elif b["block_type"] in ("figure", "table"):
            add(b["block_type"], b["caption"], "\n".join(p for p in (b["caption"], b["footnote"]) if p), [b], box, level)
        elif b["block_type"] == "equation":
            add("equation", None, b["text"], [b], box, level)
        elif b["block_type"] in ("paragraph", "image_caption", "image_footnote", "table_caption", "table_footnote"):
            add("paragraph", None, b["text"], [b], box, level)
    for n in reversed(nodes):
        if n["parent"] is not None:
            up = nodes[n["parent"]]
            up["low"], up["high"] = min(up["low"], n["low"]), max(up["high"], n["high"])
    return nodes


def random_blocks(rng, document):
    titles = ["Introduction", " References", "bibliography", "Appendix A", "B APPENDIX", "7 appendix x", "3.1 Methods", "A.2", "3 Results", "Abstract", "ABSTRACT ", "2.1.4 Deep"]
    texts = ["plain words", "Ann Lee<sup>1</sup>, Bo", "a@b.c", "a@b.c. One. Two. Three. Four", "Abstract - we show", "abstract: more", "", None, "x" * 420 + "@"]
    kinds = ["title"] * 4 + ["paragraph"] * 5 + ["reference", "figure", "table", "equation", "image_caption", "table_footnote", "discarded", "strange"]
    rows, page = [], 1
    for i in range(rng.choice([0, 1, 3, 12, 40])):
        page += rng.random() < 0.2
        kind = rng.choice(kinds)
        level = rng.choice([1, 2, 2, 2, 2, 3, None]) if kind == "title" else None
        rows.append({"document_id": document, "block_id": f"{document}-{i}", "page": page, "reading_order": i, "block_type": kind, "level": level, "text": rng.choice(titles if kind == "title" else texts), "caption": rng.choice([None, "", "Figure 1"]), "footnote": rng.choice([None, "note"]), "html": None, "image_path": None})
    return rows


def test_trees_against_a_plain_fold(spark):
    rng = random.Random(1)
    documents = {f"d{i}": random_blocks(rng, f"d{i}") for i in range(150)}
    rows = [tuple(b.values()) for blocks in documents.values() for b in blocks]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, BLOCK)
    nodes = hierarchy.derive(frame)
    got = {}
    for r in nodes.collect():
        got.setdefault(r.document_id, []).append(r)
    assert set(got) == {d for d, blocks in documents.items() if blocks}
    for document, blocks in documents.items():
        if not blocks:
            continue
        want = fold(document, [{**b, "text": b["text"] or ""} for b in blocks])
        mine = sorted(got[document], key=lambda r: r.order_index)
        assert [(n["order"], n["id"], n["kind"], n["title"], n["content"], n["low"], n["high"], n["level"], n["ids"]) for n in want] == [(r.order_index, r.id, r.kind, r.title, r.content, r.page_start, r.page_end, r.level, r.source_block_ids) for r in mine]
        parents = {n["order"]: n["parent"] for n in want}
        for r in mine:
            assert r.parent_id == (None if parents[r.order_index] is None else want[parents[r.order_index]]["id"])
            above, at = [], r.order_index
            while at is not None:
                above.insert(0, at)
                at = parents[at]
            assert list(r.path) == above
            inside = {o.order_index for o in mine if r.enter < o.enter <= r.leave}
            assert inside == {o.order_index for o in mine if r.order_index in o.path and o is not r}
    assert hierarchy.claimed_twice(nodes).isEmpty()
    texts = {(r.document_id, r.id): r.text for r in hierarchy.section_text(nodes, frame, descendants=True).collect()}
    said = {b["block_id"]: b["text"] or "" for blocks in documents.values() for b in blocks}
    for document, mine in got.items():
        for r in mine:
            if r.kind in ("section", "subsection", "appendix"):
                parts = [said[i] for o in sorted(mine, key=lambda o: o.order_index) if r.order_index in o.path for i in o.source_block_ids]
                assert texts[document, r.id] == "\n".join(p for p in parts if p)


def test_trees_of_nothing(spark):
    assert hierarchy.derive(spark.createDataFrame([], BLOCK)).count() == 0
    only = spark.createDataFrame([("d", "b", 1, 0, "discarded", None, None, None, None, None, None)], BLOCK)
    assert [(r.kind, r.title, r.enter, r.leave) for r in hierarchy.derive(only).collect()] == [("document", None, 0, 0)]


def test_source_nodes_and_subtrees(spark):
    rows = [("d", "a", 1, 0, "title", 2, "One"), ("d", "b", 1, 1, "title", 2, "1.1 Part"), ("d", "c", 2, 2, "paragraph", None, "text 5"), ("d", "e", 3, 3, "discarded", None, "9")]
    blocks = spark.createDataFrame([(*r, None, None, None, None) for r in rows], BLOCK)
    nodes = hierarchy.derive(blocks)
    found = {r.block_id: (r.node_id, r.source_node_id) for r in hierarchy.source_nodes(blocks.select("document_id", "block_id"), nodes).collect()}
    ids = {r.order_index: r.id for r in nodes.collect()}
    assert found == {"a": (ids[1], ids[1]), "b": (ids[2], ids[2]), "c": (ids[3], ids[2]), "e": (None, None)}
    below = sorted(r.id for r in hierarchy.within(nodes, nodes.where("kind = 'section'")).collect())
    assert below == sorted([ids[2], ids[3]])


def test_deep_chains_and_cycles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None, i, i, "section" if i % 100 == 0 else "paragraph", " " if i == 200 else "t") for i in range(300)]
    rows += [("x", "y", 5, 5, "paragraph", None), ("y", "x", 9, 9, "paragraph", None), ("z", "x", 1, 1, "paragraph", None), ("lost", "nowhere", 3, 3, "paragraph", None)]
    nodes = spark.createDataFrame(rows, "id string, parent string, page_start int, page_end int, kind string, title string")
    pages = {r.id: (r.page_start, r.page_end) for r in tree.page_ranges(nodes).collect()}
    assert all(pages[f"n{i}"] == (i, 299) for i in range(300))
    assert pages["x"] == pages["y"] == (1, 9) and pages["z"] == (1, 1) and pages["lost"] == (3, 3)
    found = {r.id: r.found for r in tree.nearest_ancestor(nodes, ["section"]).collect()}
    assert all(found[f"n{i}"] == f"n{i // 100 * 100}" for i in range(300)) and {found[i] for i in ("x", "y", "z", "lost")} == {None}
    named = {r.id: r.found for r in tree.nearest_ancestor(nodes, ["section"], titled=True).collect()}
    assert named["n250"] == "n100" and tree.nearest_ancestor(nodes.where("false"), ["section"]).count() == 0
