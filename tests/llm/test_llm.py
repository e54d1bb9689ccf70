import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from operator import ne

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from papyrite.llm import bpe, chat, decontaminate, fingerprint, graph, langid, linededup, lmscore, neardup, pii, toxicity
from papyrite.llm.shared import ship

from tests.llm import context_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, key string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "same words in both of these two"), (5, "same words in both of these two"), (6, "w " * 30_000), (None, "no id at all here"), (7, None)]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def docs(spark, rows):
    """Rows of ids and texts with columns whose names the operators use themselves."""
    ship(spark)
    return spark.createDataFrame([(i, t, None, None, None, 0, "h", "k") for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return bpe.load_ranks(file)


def test_bpe_equals_the_library(ranks):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, rng = bpe.Tokenizer(ranks, public_tokenizers.PATTERN), random.Random(1)
    parts = ["a", "the", " ", " ", "  ", "\n", "\n\n", "\r", "\t", "'s", "'", "é", "漢", "\U0001f600", "0", "12", ".", "=", "\x00", "\xa0", "Hello", "ing", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        ids = ours.encode(text)
        assert ids == other.encode_ordinary(text) and ours.decode(ids) == text.encode()


def test_bpe_edits_and_appends(ranks):
    vocabulary, rng = bpe.Vocabulary(ranks), random.Random(2)
    for _ in range(100):
        data = bytes(rng.choice(b"abcdet =") for _ in range(300))
        start = rng.randrange(300)
        end, new = min(300, start + rng.randrange(6)), bytes(rng.choice(b"abxe ") for _ in range(rng.randrange(6)))
        table = bpe.PrefixTable(vocabulary, data)
        table.replace(start, end, new)
        assert table.data == data[:start] + new + data[end:] and table.ids() == vocabulary.merge(table.data)
        table.append(b"the end")
        assert table.ids() == vocabulary.merge(table.data)


def test_bpe_odd_rows(spark):
    got = bpe.encode_documents(docs(spark, ODD), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(i), sha(t or "")) for i, t in ODD)
    assert all((r.n_tokens == 0) == (r.decoded_sha256 == sha("")) for r in got)
    assert bpe.encode_documents(docs(spark, []), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_pii_odd_rows_and_checksums(spark):
    rows = ODD + [(10, "mail a.b@c.de, ip 10.0.0.1 and 300.1.1.1, card 4111 1111 1111 1111 or 4111111111111112, +1 (555) 010-9999"), (11, "iban DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00"), (12, "social security 123-45-6789; part 123-45-6789"), (13, "1 " * 30_000), (14, "a." * 30_000 + "@")]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows), ["doc_id"]).collect()}
    assert (got[10].n_email, got[10].n_ip, got[10].n_card, got[10].n_phone) == (1, 1, 1, 1)
    assert got[10].spans == "email:5:13,ip:18:26,card:47:66,phone:88:105"
    assert got[11].spans.count("iban") == 1 and "iban:5:32" in got[11].spans and got[12].spans.startswith("ssn:16:27")
    assert got[1].base_sha256 == got[2].base_sha256 == sha("") and got[13].spans == got[14].spans == ""
    assert len(pii.find(docs(spark, rows), ["doc_id"]).collect()) == len(rows) and pii.find(docs(spark, []), ["doc_id"]).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    """The contract's spans, plainly."""
    found = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            luhn = sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                found.append((m.start(), place, m.end(), kind))
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def test_pii_against_the_plain_rules(spark):
    rng = random.Random(11)
    parts = [*"a1.2-@+ 3()4x.5_%", "é", "\U0001f600", "4111111111111111", "10.0.0.1", "a@b.co", "+1 (555) 555-1234"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(3000)]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows), ["doc_id"]).collect()}
    for i, text in rows:
        expected = base_spans(text)
        assert got[i].base_sha256 == sha(",".join(expected)), text
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in expected) for k in BASE]


def test_toxicity_learns_words_beginnings_and_pairs(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(2, 6) for _ in range(30))
    rows = [(i, clean() + (f" vile{'aeiou'[i % 5]} loser" if i % 3 == 0 else "")) for i in range(400)]
    known = labels(spark, [(i, int(i % 3 == 0), 1) for i in range(400)] + [(0, 1, 0), (None, 1, 0), (1, None, 0)])
    frame = docs(spark, rows + [(1000, "vilexx x"), (1001, None), (1002, ""), (1003, clean())])
    model = toxicity.fit(frame, known, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(frame, model, ["doc_id"]).collect()}
    assert sum(got[i].predicted == (i % 3 == 0) for i in range(400)) == 400
    assert got[1000].score > got[1003].score and got[1001].predicted == got[1002].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert len(toxicity.score(docs(spark, ODD), toxicity.fit(frame, labels(spark, []), F.lit(True)), ["doc_id"]).collect()) == len(ODD)
    owner, column = np.nonzero(np.array([[1, 0], [0, 1], [1, 1], [0, 0]] * 20))
    bias, w, v = toxicity.train(owner, column, 2, np.array([0, 0, 1, 0] * 20), np.ones(80), steps=800)
    assert toxicity.Model("", bias, {}, w, v).margin([0, 1]) > 1 > -1 > toxicity.Model("", bias, {}, w, v).margin([0])


def test_toxicity_of_pairs_alone(spark):
    rng = random.Random(31)
    filler = lambda: [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do"]) for _ in range(6)]
    rows, toxic = [], []
    for i in range(600):
        a, b = i % 2, i // 2 % 2  # either word is as common in clean texts; only both together are toxic
        rows.append((i, " ".join(filler() + ["grumpf"] * a + ["zorkan"] * b)))
        toxic.append((i, int(a and b), 1))
    frame = docs(spark, rows)
    model = toxicity.fit(frame, labels(spark, toxic), F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in toxicity.score(frame, model, ["doc_id"]).collect()}
    assert all(got[i].predicted == y for i, y, _ in toxic if i % 3 == 1)


def test_toxicity_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Model("", 0.3, {}, rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS)))
    for _ in range(20):
        at = sorted(rng.choice(9, rng.integers(0, 9), replace=False).tolist())
        plain = 0.3 + sum(model.linear[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(at, 2))
        assert math.isclose(model.margin(at), plain, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("own", ["toxicity", "langid", "lmscore", "pii"])
def test_kept_columns_with_the_names_of_results(spark, own):
    ship(spark)
    frame = spark.createDataFrame([(1, "a b c", 5, 6, "x", "y")], "doc_id long, text string, score int, tail int, spans string, has_email string")
    keep = ["doc_id", "score", "tail", "spans", "has_email", "text"]
    if own == "toxicity":
        out = toxicity.score(frame, toxicity.Model("", 0.0, {}, np.zeros(0), np.zeros((0, toxicity.FACTORS))), keep)
    elif own == "langid":
        out = langid.predict(frame, langid.fit(frame, F.lit("aa"), F.lit(True)), keep)
    elif own == "lmscore":
        out = lmscore.score_documents(frame, F.lit(True), keep)
    else:
        out = pii.find(frame, keep)
    r = out.first().asDict()
    assert len(set(out.columns)) == len(out.columns) and (r["doc_id"], r["tail"], r["has_email"], r["text"]) == (1, 6, "y", "a b c")
    assert r["score_kept" if own != "pii" else "score"] == 5 and r["spans_kept" if own in ("langid", "pii") else "spans"] == "x"


def test_pii_of_many_matches(spark):
    text = "a@b.co " * 3000
    r = pii.find(docs(spark, [(1, text)]), ["doc_id"]).first()
    assert r.n_email == 3000 and r.spans.split(",")[-1] == f"email:{7 * 2999}:{7 * 2999 + 6}" and r.base_sha256 == sha(r.spans)


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    plain = [" ".join(word() for _ in range(20)) for _ in range(3)]
    quiz = "the farmer called Anna sold 12 kg of apples for 30 dollars and then the baker bought 12 more of them yesterday evening"
    changed = quiz.replace("Anna", "Boris").replace("12", "17").replace("30", "45")
    clash = quiz.replace("12 kg", "17 kg").replace("30", "45").replace("12 more", "99 more")
    items = spark.createDataFrame([(i, t, 1, 1) for i, t in enumerate(plain + [quiz, "too short", None, ""])], "item_id long, text string, h int, id int")
    other = lambda: " ".join(word() for _ in range(40))
    rows = [(10 + i, f"{other()} {t.upper()} {other()}") for i, t in enumerate(plain)] + [(20, other() + " " + changed), (21, changed + " " + other()), (30, other()), (31, "too short " * 3)] + ODD
    got = decontaminate.find(docs(spark, rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 0), (11, 1), (12, 2), (20, 3), (21, 3), (31, 4)}  # items under five words are matched whole
    assert all((r.n_template > 0) == (r.item_id == 3) for r in got)
    both = {r.doc_id: r.n_windows for r in decontaminate.find(docs(spark, [(1, changed), (2, clash)]), items).collect()}
    assert both.get(2, 0) < both[1]
    assert decontaminate.find(docs(spark, []), items).count() == decontaminate.find(docs(spark, rows), items.where("false")).count() == 0


def test_decontamination_of_items_dense_in_slots(spark):
    texts = ["Ann has 3 apples, Bob has 5 pears, Cy has 7 figs", "Does Mary Jane Smith owe Peter Paul Jones money?", "1 2 3 4 5 6 7 8 9 10"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(1, "Dan has 4 apples, Eve has 6 pears, Flo has 8 figs"), (2, "So it goes. Does Anna owe Otto money?"), (3, "11 12 13 14 15 16 17 18 19 20"), (4, "Dan has 4 apples and no figs")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs(spark, rows), items).collect()} == {(1, 0), (2, 1)}


def test_decontamination_of_items_that_share_windows(spark):
    common = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(1, common + " ten eleven twelve"), (2, common + " zebra"), (3, common)], "item_id long, text string")
    rows = [(1, common + " zebra"), (2, common + " ten eleven twelve"), (3, "w w w " + common)]
    got = {(r.doc_id, r.item_id): r.n_windows for r in decontaminate.find(docs(spark, rows), items).collect()}
    assert got == {(1, 2): 3, (1, 3): 2, (2, 1): 5, (2, 3): 2, (3, 3): 2}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_automaton_against_distance(spark):
    rng = random.Random(21)
    pairs = []
    for _ in range(1500):
        a = b = "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(1, 24)))
        for _ in range(rng.randrange(5)):
            at, what = rng.randrange(len(b) + 1), rng.random()
            b = b[:at] + (rng.choice("abcé😀") if what < 0.7 else "") + b[at + (what > 0.35) :]
        pairs.append((a, b or "x"))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", linededup.within(F.col("x"), F.col("y")).alias("near")).collect()
    for r in got:
        assert r.near == (distance(r.x, r.y) <= min(linededup.EDITS, min(len(r.x), len(r.y)) // linededup.EACH)), r


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(18, 50))) for _ in range(25)]

    def edit(x):
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            p, o = rng.randrange(len(x) + 1), rng.random()
            x = x[:p] + (rng.choice("abcde") if o < 0.7 else "") + x[p + (o > 0.35) :]
        return x

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(5))) for i in range(60)]
    lines = [(i, k, t.strip(" ")) for i, text in rows for k, t in enumerate(text.split("\n")) if len(t.strip(" ")) >= linededup.SHORTEST]
    top = {t: t for _, _, t in lines}

    def find(t):
        while top[t] != t:
            t = top[t]
        return t

    for a, b in itertools.combinations(sorted(top), 2):
        if find(a) != find(b) and distance(a, b) <= linededup.EDITS:
            top[find(a)] = find(b)
    first = {}
    for i, k, t in lines:
        first.setdefault(find(t), (i, k))
    frame = docs(spark, rows)
    found = linededup.find(frame)
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted((i, k, *first[find(t)]) for i, k, t in lines if first[find(t)] != (i, k))
    left = linededup.remove(frame, found)
    assert left.columns == frame.columns and linededup.find(left).count() == 0


def test_line_dedup_odd_rows(spark):
    frame = docs(spark, ODD)
    found = linededup.find(frame)
    assert found.count() == 0 and linededup.remove(frame, found).count() == len(ODD) and linededup.find(docs(spark, [])).count() == 0


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Read more\nok\n\n漢字"), (2, "Read more\nRead mode\nok\n\t\n漢字"), (3, "no\nsubscribe now\n\t"), (4, "subscribe now!\non\nsubscribes now!")]
    got = sorted(tuple(r) for r in linededup.find(docs(spark, rows)).collect())
    assert got == [(2, 0, 1, 0, True), (2, 1, 1, 0, False), (2, 2, 1, 1, True), (2, 4, 1, 3, True), (4, 0, 3, 1, False), (4, 2, 3, 1, False)]


def test_chat_paths_of_a_tree(spark):
    rows = [(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 3, 1.0), (5, 2, 9.0), (6, 99, 2.0)]
    nodes = spark.createDataFrame([("t", *r, "user" if r[0] % 2 else "assistant", f"say ### {r[0]} \\1 </turn>") for r in rows], "tree string, id long, parent long, score double, role string, text string")
    got = chat.paths(nodes, per_tree=3).collect()
    by = {}
    for r in got:
        by.setdefault((r["rank"], r.leaf), []).append((r.depth, r.id))
    assert {k: [i for _, i in sorted(v)] for k, v in by.items()} == {(1, 5): [1, 2, 5], (2, 4): [1, 3, 4], (3, 6): [6]}
    out = chat.format_trees(nodes, 1).select(chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [(t.role, t.text) for t in out.t] == [("user" if i % 2 else "assistant", f"say ### {i} \\1 </turn>") for i in (1, 2, 5)]
    assert out.l == ["say ### 2 \\1 </turn>"]
    assert chat.format_trees(nodes.where("false")).count() == 0


def test_chat_odd_conversations(spark):
    texts = ["", None, "\\", "</turn>\n", "### user: x", "\\2\\0", "<", "/turn>", "#", "ends in <"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", None, "a: b", "###"] * 2, texts, strict=True))] + [(None, None, "assistant", "lost"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv: r for r in chat.format_trees(chat.chain(messages)).select(F.col("tree.conv").alias("conv"), chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [(t.role, t.text) for t in out["1"].t] == [(r or "", t or "") for _, _, r, t in rows[:10]]
    assert len(out["2"].t) == 2 and out["2"].l == ["x", "x"] and out[""].l == ["lost"] and out["1"].l == ["", "<"]


def test_chat_long_conversation_and_repeated_ids(spark):
    rows = [("long", i, i - 1 if i else None, 0.0, "user" if i % 2 else "assistant", f"turn {i}") for i in range(2000)]
    rows += [("twice", 0, None, 0.0, "user", "a"), ("twice", 0, None, 0.0, "user", "b"), ("twice", 1, 0, 1.0, "assistant", "c"), ("cycle", 1, 2, 0.0, "user", "x"), ("cycle", 2, 1, 0.0, "user", "y")]
    nodes = spark.createDataFrame(rows, "tree string, id long, parent long, score double, role string, text string")
    out = {r.tree: r for r in chat.format_trees(nodes).select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert set(out) == {"long", "twice"} and out["long"].leaf == 1999
    assert [t.text for t in out["long"].t] == [f"turn {i}" for i in range(2000)] and out["long"].l == [f"turn {i}" for i in range(0, 2000, 2)]
    assert [t.text for t in out["twice"].t] == ["a", "c"]


def test_fingerprints(spark):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(rng.randrange(1, 400)))) for i in range(40)] + [(1, ""), (2, None), (4, "x"), (5, "x")]
    got = {r.doc_id: r for r in fingerprint.compare(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} if len(t.split()) >= 5 else {tuple(t.split())}
    errors = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(edited) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b = shingles(text), shingles(edited)
        errors.append(abs(len(a & b) / len(a | b) - r.near_edited))
    assert np.mean(errors) < 0.15 and got[4].fingerprint == got[5].fingerprint and got[5].near_next == 1 and got[1].fingerprint == got[2].fingerprint == ""
    assert fingerprint.compare(docs(spark, ODD)).count() == len(ODD) and fingerprint.compare(docs(spark, [])).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(7)
    arrays = [rng.normal(0, 3, (n, 3)).astype(np.float32) for n in (1, 2, 3, 5, 6, 6)]
    for scores, path in zip(arrays, langid.viterbi(arrays, 2.0), strict=True):
        value = lambda p, s=scores: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))
        assert math.isclose(value(path), max(map(value, itertools.product(range(3), repeat=len(scores)))), rel_tol=1e-5)
        one = langid._one_language(scores, 2.0)
        assert one is None or list(path) == [one] * len(scores)


def test_langid(spark):
    rng = random.Random(8)
    speak = {"aa": "the and for with this", "bb": "der und mit eine nicht", "cc": "и не на что это"}
    rows = [(i, " ".join(rng.choice(speak[k].split()) for _ in range(20)), k) for i, k in enumerate(list(speak) * 40)] + [(900, "7 ! 8", "aa"), (901, "the and for", None)]
    frame = docs(spark, ODD).unionByName(spark.createDataFrame([(*r, "s", 1, 0, "h", "k") for r in rows], SCHEMA))
    model = langid.fit(frame, F.col("lang"), F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.predict(frame, model, ["doc_id"]).where("doc_id >= 10").collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[10:-2]) and got[900].lang_pred == "und" and got[901].lang_pred == "aa"
    mixed = langid.predict(docs(spark, [(1, "the and for with this " * 5 + "der und mit eine nicht " * 9)]), model, ["doc_id"]).first()
    assert mixed.lang_pred == "bb" and mixed.spans == "aa:25,bb:45" and 0.5 < mixed.score < 0.8
    odd = langid.predict(docs(spark, ODD), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(r.lang_pred == "und" for r in odd if r.doc_id in (1, 2, 3, 7))
    nothing = langid.fit(frame.where("false"), F.col("lang"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs(spark, ODD), nothing, ["doc_id"]).collect()} == {"und"}


def levels(words, nodes):
    gram, _ = context_tree._grams(words)
    found = []
    for d in range(context_tree.DEPTH + 1):
        keys, counts = np.unique(gram & np.uint32((1 << (8 * (d + 1))) - 1), return_counts=True)
        top = np.sort(np.argsort(-counts, kind="stable")[: nodes.get(d)])
        found.append((keys[top], counts[top]))
    return context_tree.build(found)


@pytest.mark.parametrize("nodes", [{}, {2: 5, 3: 4}])
def test_context_tree_gives_distributions(nodes):
    model = levels([b"abc", b"abd", b"ab", b"xyz", b"abc", b"\n"], nodes)
    for context in (0, 0x6162, 0x616263, 0x414243, 0x787900):
        every = (np.uint32(context) << np.uint32(8)) | np.arange(256, dtype=np.uint32)
        assert math.isclose((10 ** context_tree.log10_of(model, every)).sum(), 1)


def test_context_tree_against_the_recursion():
    words = [b"abc", b"abd", b"ab", b"abc"]

    def events(word):
        word = word + b" "
        for i, s in enumerate(word):
            context, prefix = tuple(word[i - j] if i >= j else 0 for j in (1, 2, 3)), 1
            for k in range(8):
                yield context, prefix, s >> (7 - k) & 1
                prefix = prefix * 2 + (s >> (7 - k) & 1)

    def weighted(seen, depth):
        ones = sum(e[2] for e in seen)
        own = math.lgamma(len(seen) - ones + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(len(seen) + 1) - math.log(math.pi)
        if depth == 3:
            return own
        parts = {e[0][depth] for e in seen}
        return np.logaddexp(own, sum(weighted([e for e in seen if e[0][depth] == c], depth + 1) for c in parts)) - math.log(2)

    seen = [e for w in words for e in events(w)]
    for new in (b"abc", b"abx", b"q"):
        total = 0.0
        for e in events(new):
            same = [x for x in seen if x[1] == e[1]]
            total += (weighted(same + [e], 0) - weighted(same, 0) if same else weighted([e], 0)) / math.log(10)
        assert math.isclose(context_tree.log10_of(levels(words, {}), context_tree._grams([new])[0]).sum(), total, rel_tol=1e-9)


def test_lm_scores_against_counts(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD", 3)
    rows = [(i, t) for i, t in enumerate(["The cat the dog", "a b c A", "", None, "the the end É", "x\x1cy new"] * 3)] + [(100, "unseen words"), (101, "w " * 20_000)]
    frame = docs(spark, rows + [(0, "The cat the dog")]).withColumn("held_out", F.col("doc_id") >= 100)
    got = lmscore.score_documents(frame, ~F.col("held_out"), ["doc_id", "held_out"]).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    counts = Counter(w for i, t in rows + [(0, "The cat the dog")] if i < 100 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        words = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) and r.score < 0
    assert lmscore.score_documents(docs(spark, []), F.lit(True), ["doc_id"]).count() == 0


@pytest.mark.parametrize("head", [20, 1 << 20])
def test_lm_scores_keep_every_context_across_words(spark, monkeypatch, head):
    monkeypatch.setattr(lmscore, "HEAD_RUNS", head)
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["the", "dog", "bites", "a", "man", "café"]) for _ in range(rng.randrange(12)))) for i in range(40)] + [(100, "dog bites man"), (101, "man bites dog"), (102, "unseen zebras"), (103, None)]
    got = {r.doc_id: r.score for r in lmscore.score_documents(docs(spark, rows), F.col("doc_id") < 100, ["doc_id"]).collect()}
    runs, _ = lmscore._runs([lmscore._coded(t.encode()) for i, t in rows if i < 100], lmscore.CONTEXT)
    model = context_tree.build([np.unique(runs & np.uint64((1 << (8 * (d + 1))) - 1), return_counts=True) for d in range(lmscore.CONTEXT + 1)])
    for i, text in rows:
        own, _ = lmscore._runs([lmscore._coded((text or "").encode())], lmscore.CONTEXT)
        assert math.isclose(got[i], context_tree.log10_of(model, own).sum(), rel_tol=1e-8)
    assert not math.isclose(got[100], got[101], rel_tol=1e-6)


def shingles_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))] for _ in range(6)]
    rows = list(ODD)
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(words)))
    sets = [(i, shingles_of(t)) for i, t in rows]
    top = {i: i for i, _ in sets if i is not None}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            top[max(x, y)] = min(x, y)
    got = neardup.find(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted((str(i), len(s), str(find(i)) if i is not None else "None", i is None or find(i) == i) for i, s in sets)
    assert neardup.find(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    top = {}
    for a, b in edges:
        if a is not None and a != b:
            top.setdefault(a, a), top.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and top[a] != top[b]:
                top[a] = top[b] = min(top[a], top[b])
                changed = True
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(top) and {r.id: r.component for r in got} == top


def test_held_out_remainders(spark):
    from papyrite.llm.shared import remainder

    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "i long").select("i", remainder(F.col("i"), 4).alias("r")).collect()
    assert all(r.r == (None if r.i is None else zlib.crc32(str(r.i).encode()) % 4) for r in got)


def test_line_dedup_of_one_template(spark):
    rng = random.Random(77)
    numbers = sorted({rng.randrange(10**9, 10**10) for _ in range(2000)})
    numbers += [numbers[5] + 1, numbers[9] * 10 // 100]
    lines = [f"Order number {n} was shipped from our warehouse today" for n in numbers]
    known = spark.createDataFrame([(2 * i, 2 * i, t) for i, t in enumerate(lines)], "h long, component long, line string")
    pairs = {(r.a // 2, r.b // 2) for r in linededup.candidates(known).collect()}
    assert len(pairs) <= 30 * len(lines)
    texts = [str(n) for n in numbers]
    got = {p for p in pairs if distance(texts[p[0]], texts[p[1]]) <= 2}  # the rest of the lines is the same
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and abs(len(a) - len(b)) <= 2 and sum(map(ne, a, b)) <= 9 and distance(a, b) <= 2}
    assert got == near and len(near) >= 2


def test_line_dedup_of_templates_with_two_fields(spark, monkeypatch):
    rng = random.Random(78)
    field = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    lines = sorted({f"{field(5)} units of article {field(rng.choice([2, 3]))} left the building at {field(3)}" for _ in range(60)} | {f"{'123' + str(i % 70)} units of article 77 left the building at 0{i % 9}0" for i in range(40)})
    known = spark.createDataFrame([(2 * i, 2 * i, t) for i, t in enumerate(lines)], "h long, component long, line string")
    got = {tuple(sorted((r.a // 2, r.b // 2))) for r in linededup._refined_links(known).collect()}
    assert got == {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(lines), 2) if distance(a, b) <= 2}


def test_bpe_remembers_pieces_that_come_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b" ab": 257}
    tokenizer = bpe.Tokenizer(ranks, bpe.SPLITS_AT_BLANKS[0])
    learnt, learn = [], tokenizer.learn
    monkeypatch.setattr(tokenizer, "learn", lambda pieces: learnt.extend(pieces := set(pieces)) or learn(pieces))
    plain = bpe.Tokenizer(ranks, bpe.SPLITS_AT_BLANKS[0])
    for i in range(12):
        text = " ".join(["abba cab"] + [f"w{chr(97 + i)}{chr(97 + k)}" for k in range(26)])
        assert tokenizer.encode(text) == plain.encode(text) and tokenizer.decode(tokenizer.encode(text)) == text.encode()
    assert learnt.count("abba") == learnt.count(" cab") == 1


def test_line_dedup_of_long_near_copies(spark):
    rng = random.Random(79)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(50)]
    lines = [" ".join(word() if rng.random() < 0.12 else w for w in base) for _ in range(300)]
    lines += [lines[7][:40] + "xy" + lines[7][41:], lines[9][:100] + lines[9][101:-1]]
    known = spark.createDataFrame([(2 * i, 2 * i, t) for i, t in enumerate(lines)], "h long, component long, line string")
    pairs = {(r.a // 2, r.b // 2) for r in linededup.candidates(known).collect()}
    assert len(pairs) <= 5 * len(lines) and {(7, 300), (9, 301)} <= pairs


def test_decontamination_of_null_ids_keeps_slots_consistent(spark):
    item = "the teacher gave Anna 12 coins and then Anna gave back 12 coins to the other teacher"
    clash = "the teacher gave Bert 77 coins and then Carl gave back 55 coins to the other teacher"
    fits = "the teacher gave Bert 77 coins and then Bert gave back 77 coins to the other teacher"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, clash), (5, clash), (6, fits)]
    assert {r.doc_id for r in decontaminate.find(docs(spark, rows), items).collect()} == {6}
    assert {r.doc_id for r in decontaminate.find(docs(spark, [(None, fits)]), items).collect()} == {None}


def plain_decontamination(rows, items):
    """Pairs by the rules, plainly: words, numbers and names in the middle of a sentence; for texts without units and punctuation."""

    def kinds(text):
        words = text.split()
        plain = [(w.lower(), None, i) for i, w in enumerate(words)]
        out = [plain]
        for starts in (True, False):
            tokens = []
            for i, w in enumerate(words):
                name = len(w) > 1 and w[0].isupper() and w[1:].islower() and not (starts and i == 0)
                if name and tokens and tokens[-1][0] == "<name>" and tokens[-1][3] == i - 1:
                    tokens[-1] = (*tokens[-1][:3], i)
                    continue
                tokens.append(("<num>", w, i, i) if w.isdigit() else ("<name>", w.lower(), i, i) if name else (w.lower(), None, i, i))
            out.append([t[:3] for t in tokens])
        return out

    def windows(tokens, length, kind):
        for i in range(len(tokens) - length + 1):
            part = tokens[i : i + length]
            if kind == 0 or any(v is None for _, v, _ in part):
                yield i, part

    found = set()
    for item_id, item in items:
        own = kinds(item)
        used = [0] + [1] * any(v is not None for _, v, _ in own[1]) + [2] * ([t[0] for t in own[2]] != [t[0] for t in own[1]])
        used = [k for k in used if len(own[k]) >= decontaminate.SHORTEST]
        for doc_id, text in rows:
            theirs, starts, whole = kinds(text), set(), False
            for k in used:
                length = min(len(own[k]), decontaminate.WINDOW)
                first = {}
                for at, part in windows(own[k], length, k):
                    first.setdefault(tuple(t[0] for t in part), (at, part))
                met = [(pos - first[key][0], first[key], part) for pos, part in windows(theirs[k], length, k) if (key := tuple(t[0] for t in part)) in first]
                if k == 0:  # a plain window of a text counts once
                    seen = {}
                    for m in met:
                        seen.setdefault(m[1][0], m)
                    met = list(seen.values())
                values = {}
                for shift, (_, mine), part in met:
                    for a, b in zip(mine, part):
                        if k and a[1] is not None:
                            values.setdefault((shift, a[1]), set()).add(b[1])
                odd = {shift for (shift, _), v in values.items() if len(v) > 1}
                kept = [m for m in met if m[0] not in odd]
                places = {m[1][0] for m in kept}
                starts |= {m[1][1][0][2] for m in kept}
                whole |= bool(places) and len(places) >= min(len(first), decontaminate.NEEDED)
            if whole or len(starts) >= decontaminate.NEEDED:
                found.add((doc_id, item_id))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(41)
    word = lambda: rng.choice(["red", "car", "drives", "to", "the", "sea", "with", "Anna", "Boris", "Clara", "3", "17", "250", "old", "men"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 14)))) for i in range(12)]

    def changed(text):
        swap = {w: (str(rng.randrange(999)) if w.isdigit() else rng.choice(["Dora", "Emil", "Fritz"]) if w[0].isupper() else w) for w in set(text.split())}
        out = [swap[w] for w in text.split()]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = word()
        return " ".join(out)

    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.randrange(8))), changed(rng.choice(items)[1]) if rng.random() < 0.7 else rng.choice(items)[1], " ".join(word() for _ in range(rng.randrange(8)))]
        rows.append((i, " ".join(p for p in parts if p)))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == plain_decontamination(rows, items) and len(got) > 20


def test_langid_of_numerals_and_scripts(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the red house on the hill", "en"), ("красный дом на холме у реки", "ru")] * 20)]
    train = spark.createDataFrame([(*r, "s", 1, 0, "h", "k") for r in rows], SCHEMA)
    ship(spark)
    model = langid.fit(train, F.col("lang"), F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs(spark, [(1, "² ½"), (2, "Ⅷ"), (3, "² дом"), (4, "the red дом"), (5, "the дом the hill")]), model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und", "und", "ru"] and got[4].spans == "en:2,ru:1" and got[5].spans == "en:1,ru:1,en:2"


def test_tables_over_the_limit_are_not_broadcast(spark, monkeypatch):
    from papyrite.llm import linededup, shared

    docs = spark.createDataFrame([(i, "\n".join(f"line {i % 7} of a text that comes again {j % 5}" for j in range(6))) for i in range(30)], "doc_id long, text string")
    expected = {tuple(r) for r in linededup.find(docs).collect()}
    monkeypatch.setattr(shared, "SMALL_ROWS", 10)
    table = shared.cut(spark.range(1000).select(F.col("id").alias("h"), F.lit("x" * 1000).alias("line")))
    # its files are a few kB, which Spark takes for its size
    plan = spark.range(10).withColumnRenamed("id", "h").join(shared.if_small(table), "h")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert {tuple(r) for r in linededup.find(docs).collect()} == expected
