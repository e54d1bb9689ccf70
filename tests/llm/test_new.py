"""Token files, filter audit and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyrite.llm import convrepair, filteraudit, tokenfile
from papyrite.llm.shared import join_classes, new_folder, ship

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "same words in both"), (5, "same words in both"), (6, "w " * 30_000), (None, "no id"), (7, None), (8, "<|endoftext|> in\x00side  two\n\n\nfeeds \n")]
DOCS = "doc_id long, text string, source string, id int, key string, h string, class string, failed string"


def docs(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, s, 0, "k", "h", "c", "f") for i, t, s in ((*r, None)[:3] for r in rows)], DOCS)


@pytest.mark.parametrize("high", [0, 1, 60_000, 2**31, 2**60 - 1, 2**64 - 1])
def test_packed_ids_come_back(high):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 2047, 2048, 2049, 6000):
        ids = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
        if n > 1000:
            ids[100:900] = 0
        words, escapes, first_word, first_escape = tokenfile.pack(ids)
        assert (tokenfile.unpack(words, escapes, first_word, first_escape, n) == ids).all() and len(words) <= n
        for block in range(len(first_word)):
            part = tokenfile.unpack(words, escapes, first_word, first_escape, n, block, 1)
            assert (part == ids[block * tokenfile.BLOCK : (block + 1) * tokenfile.BLOCK]).all()
        assert len(escapes) == (ids >= 2**60).sum()
    assert len(tokenfile.pack(np.zeros(2400, np.uint64))[0]) <= 12


def test_segments_say_when_they_are_damaged():
    data = tokenfile.segment(["1", None, "é"], [2, 0, 3], np.array([1, 2, 3, 2**61, 5])) + tokenfile.segment([], [], np.zeros(0))
    (names, lengths, ids), (none, _, nothing) = tokenfile.segments(data)
    assert names == ["1", None, "é"] and lengths.tolist() == [2, 0, 3] and ids.tolist() == [1, 2, 3, 2**61, 5] and none == [] and len(nothing) == 0
    with pytest.raises(ValueError):
        list(tokenfile.segments(data[:60] + bytes([data[60] ^ 1]) + data[61:]))
    with pytest.raises(ValueError):
        list(tokenfile.segments(b"x" + data))


def test_encoding_equals_the_library():
    rng, coder = random.Random(2), tokenfile.Encoder(PATH)
    parts = ["a", "b", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "1", ".", "é", " ", "\x1c", "\x85", "​", "﻿", "　", "<|endoftext|>", "\0", "漢", "🙂", "\r", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(6000)] + ["", None]
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        ids, lengths = coder.encode(pa.array(some, pa.string()))
        want = coder.library.encode_batch([t or "" for t in some], add_special_tokens=False)
        assert lengths.tolist() == [len(w.ids) for w in want] and ids.tolist() == [i for w in want for i in w.ids]
        if start == 2500:
            coder._forget()


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "PER_FILE", 2)
    rng = random.Random(3)
    rows = ODD + [(100 - i, " ".join(rng.choice(["red", "blue\n", "42", "höher"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    folder = new_folder(spark)
    tokenfile.write(docs(spark, rows).repartition(5), folder, PATH)
    library = tokenfile.Encoder(PATH).library
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows}
    got = tokenfile.digest(spark, folder).collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        texts = [t for i, t in rows if i == r.id]
        assert any(r.n_tokens == len(ids[t]) and r.ids_crc32 == zlib.crc32(np.array(ids[t], "<u4").tobytes()) for t in texts) and r.start == at
        at += r.n_tokens
    assert [r.id for r in sorted(got, key=lambda r: r.start)] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    read = {(r.id, tuple(r.ids)) for r in tokenfile.read(spark, folder).collect()}
    assert read == {(None if i is None else str(i), tuple(ids[t])) for i, t in rows}
    empty = new_folder(spark)
    tokenfile.write(docs(spark, []), empty, PATH)
    assert tokenfile.digest(spark, empty).count() == 0


def plain_audit(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in ((*r, None)[:3] for r in rows)]
    low = {}
    for i, t, _ in texts:
        if i is not None:
            low[t] = min(i, low.get(t, i))
    good, toxic = ({i for i, q, x in labels if v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    fails = []
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t]}
        fails.append((i, s, {k for k, v in f.items() if v}))
    out, shares = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, letter in enumerate(order, 1):
            for i, s, f in fails:
                row = out.setdefault((s, order, step), [0] * 6)
                earlier = f & set(order[: step - 1])
                removed = letter in f and not earlier
                for k, said in enumerate([not earlier and letter not in f, removed, letter in f and bool(earlier), f == {letter}, removed and i in good, removed and i in toxic]):
                    row[k] += bool(said)
                shares[s, letter] += removed
    return {(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["a", "bb", "Cc", "DDD", "e#", *map(str, range(60))]) for _ in range(n))
    texts = [words(rng.choice([0, 1, 5, 199, 200, 260])) for _ in range(14)] + ["same start " * 60 + x for x in ("", "x", "y")] + [None, "", " \n"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "web", "news"])) for _ in range(120)] + ODD
    known = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(docs(spark, rows), labels).collect()}
    assert got == plain_audit(rows, [(i, q, t) for i, q, t in known if i is not None])
    assert filteraudit.audit(docs(spark, []), labels).count() == 0


def test_texts_whose_hashes_agree_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "blocks", lambda text: [F.lit(1).cast("long")] * 4)
    rows = [(3, "abc"), (1, "abd"), (2, "abc"), (9, "abd"), (None, "abc"), (4, "zz")]
    got = sorted((str(r.id), "E" in r.failed) for r in filteraudit.mark(docs(spark, rows)).collect())
    assert got == [("1", False), ("2", False), ("3", True), ("4", False), ("9", True), ("None", False)]


def test_classes_meet_their_rows_either_way(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(300)] + [(999, None)], "i long, k long")
    classes = rows.where("k is not null and k < 5").groupBy(F.col("k").alias("class")).agg(F.count("*").alias("n"), F.min("i").alias("low"))
    want = sorted(map(tuple, join_classes(rows, classes, "k", 301).collect()), key=str)
    monkeypatch.setattr("papyrite.llm.shared.SMALL_ROWS", 0)
    monkeypatch.setattr("papyrite.llm.shared.HOT_SHARE", 10)
    assert sorted(map(tuple, join_classes(rows, classes, "k", 301).select("k", "i", "n", "low").collect()), key=str) == want and len(want) == 301


def plain_repair(rows):
    """Faults and the cheapest edits by relaxing every state of every row until nothing changes."""
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\f\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = [{} for _ in range(len(rows) + 1)]
    best[0][0] = (0, "", [])

    def relax(i, state, value):
        if state is not None and (state not in best[i] or value[:2] < best[i][state][:2]):
            best[i][state] = value
            return True
        return False

    for i in range(len(rows) + 1):
        while any([relax(i, step.get((q, role[0])), (c + 2, a + "I", o + [role + ":"])) for q, (c, a, o) in list(best[i].items()) for role in ("user", "assistant")]):
            pass
        if i < len(rows):
            _, role, text = rows[i]
            extra = faults[i] == "t"
            for q, (c, a, o) in best[i].items():
                relax(i + 1, q, (c + 3, a + "D", o))
                if faults[i] not in ("b", "d"):
                    relax(i + 1, step.get((q, role[:1])), (c + extra, a + "K", o + [f"{role}:{text}"]))
                    for new in ("user", "assistant"):
                        relax(i + 1, step.get((q, new[0])), (c + 2 + extra, a + "R", o + [f"{new}:{text}"]))
    cost, audit, out = min(v for q, v in best[-1].items() if q in (0, 3))
    return gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(table):
    found = defaultdict(list)
    for conv, turn, role, text in table:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        found[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in found.items()}


def test_conversation_repair_against_brute_force(spark):
    ship(spark)
    rng = random.Random(5)
    table = []
    for conv in [None, *range(60)]:
        for i in range(1500 if conv == 7 else rng.choice([1, 2, 3, 8, 30])):
            table.append((conv, rng.choice([None, i, i // 2, i // 3]), rng.choice([None, "user", "assistant", "system", "tool", "", "Ua"]), rng.choice([None, "", " \t", "ok", "ok.", "a b!", "z? ", "é.", f"t{i}.", f"t{i}"])))
    table += table[:150]
    rng.shuffle(table)
    frame = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, part int, class string").repartition(7)
    got = {r[0]: tuple(r)[1:] for r in convrepair.repair(convrepair.damage(frame)).collect()}
    want = {c: plain_repair(rows) for c, rows in plain_damage(table).items()}
    assert got == want
    assert convrepair.repair(convrepair.damage(frame.where("false"))).count() == 0


def test_search_of_pieces_and_its_edits():
    rng = random.Random(6)
    for _ in range(300):
        rows = [(i, rng.choice(["system", "user", "assistant", "x", ""]), rng.choice(["", "a.", "b", "c!"])) for i in range(rng.randrange(7))]
        seen, items = set(), []
        for _, role, text in rows:
            items.append(convrepair.Item(role, text, convrepair.BLANK if not text else convrepair.DUPLICATE if (role, text) in seen else convrepair.CUT_OFF if text[-1] not in ".!?" else convrepair.OK, 1))
            seen.add((role, text))
        ((cost, edits),) = convrepair.search(items).values()
        *_, want_cost, want_edits, digest = plain_repair(rows)
        assert (cost, edits) == (want_cost, want_edits) and hashlib.sha256("\n".join(convrepair.apply(items, edits)).encode()).hexdigest() == digest
        ways = convrepair.search(items, ends=False)
        assert min((c + convrepair.ENDS[s][0], e + convrepair.ENDS[s][1]) for s, (c, e) in ways.items()) == (cost, edits)
