"""Conversation structure repair: the cheapest edits that turn a conversation's roles into ``(s?(ua)+)?``, by A*.

A node of the lattice is a row and a state: nothing said yet (0), a system turn (1), a user turn (2), an assistant turn (3)
before it. Keep, rerole and delete lead to the next row, insert to another state at the same row. The heuristic is the
sum of what the rows from here on cost whatever happens: their mandatory deletions, and one for each truncated row, which
is charged as truncated or deleted for more. Open nodes are keyed by cost plus heuristic, then by the edits so far.
Two ways to one node of one cost have the same number of rows behind them, so neither's edits begin with the other's,
and what comes behind leaves their order as it is: the first way that is taken from the heap is the best one.

A long conversation is cut into pieces. A piece is searched from every state to every state; what each state costs to
the end runs through the pieces backward, and forward from the first piece on the way is chosen piece by piece.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import cut, drop, join_classes, small

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: Extra cost of a truncated row that stays.
TRUNCATED = 1
#: Most rows of a piece, and characters of text from which one ends.
PIECE_ROWS, PIECE_CHARS = 512, 1 << 22
OK, BLANK, DUPLICATE, CUT_OFF = range(4)
#: By state: the initials that may come next, with the state they lead to; the role that an edit gives, with its state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: By state: cost and edits that end the conversation there.
ENDS = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


class Item(NamedTuple):
    """``count`` equal rows side by side, of one fate if they are several: they go."""

    role: str
    text: str
    fault: int
    count: int


def _heuristic(items: list[Item]) -> list[int]:
    """By row: what it and all behind it cost at least."""
    sums = [0]
    for item in reversed(items):
        sums.append(sums[-1] + (DELETE * item.count if item.fault in (BLANK, DUPLICATE) else TRUNCATED if item.fault == CUT_OFF else 0))
    return sums[::-1]


def search(items: list[Item], start: int = 0, ends: bool = True) -> dict[int, tuple[int, str]]:
    """``state: (cost, edits)`` of the cheapest edits from ``start`` on, the least in ASCII of equal cost.

    ``ends``: only the one best end of the conversation; otherwise every state that can be reached behind the last row,
    nothing being inserted there.
    """
    n, ahead = len(items), _heuristic(items)
    heap: list[tuple[int, str, int, int, int]] = [(ahead[0], "", 0, start, 0)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while heap:
        _, edits, i, state, cost = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (not ends or state in (0, 3)):
            found[state] = (cost, edits)
            if ends or len(found) == 4:
                break
            continue
        role, given = GIVEN[state]
        moves = [(INSERT, "I", i, given)]
        if i < n:
            item = items[i]
            moves.append((DELETE * item.count, "D" * item.count, i + 1, state))
            if item.fault in (OK, CUT_OFF):
                charge = TRUNCATED if item.fault == CUT_OFF else 0
                moves.append((REROLE + charge, "R", i + 1, given))
                if (kept := NEXT[state].get(item.role[:1])) is not None:
                    moves.append((KEEP + charge, "K", i + 1, kept))
        for price, edit, j, to in moves:
            if (j, to) not in done:
                heapq.heappush(heap, (cost + price + ahead[j], edits + edit, j, to, cost + price))
    return found


def apply(items: list[Item], edits: str, start: int = 0) -> Iterator[str]:
    """``role:text`` of each turn that the edits leave."""
    state, at = start, 0
    for item in [*items, None]:
        while at < len(edits) and edits[at] == "I":
            role, state = GIVEN[state]
            yield role + ":"
            at += 1
        if item is None or at >= len(edits):
            break
        if edits[at] == "D":
            at += item.count
            continue
        role, to = (item.role, NEXT[state].get(item.role[:1])) if edits[at] == "K" else GIVEN[state]
        state = to if to is not None else state
        yield f"{role}:{item.text}"
        at += 1


class _Facts:
    """Counts of a run of rows, which add up over the pieces of a conversation."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first = self.last = None

    def row(self, turn: int | None, item: Item) -> None:
        initial = item.role[:1]
        self.blank += item.count if item.fault == BLANK else 0
        self.duplicate += item.count if item.fault == DUPLICATE else 0
        self.truncated += item.count if item.fault == CUT_OFF else 0
        self.illegal += (item.count - 1) + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low, self.high = turn if self.low is None else self.low, turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        self.first, self.last = initial if self.first is None else self.first, initial

    def add(self, other: dict[str, Any]) -> None:
        """The facts of the piece that comes next."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + other[name])
        if other["first"] is not None:
            self.illegal += self.last is not None and self.last + other["first"] not in ("su", "ua", "au")
            self.last = other["last"]
        if other["low"] is not None:
            self.turns -= other["low"] == self.high
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]

    def told(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


_FACTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
_OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows damaged by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space, but ids and turns keep theirs.

    ``copies``: 0 for a row that is dropped, 2 for one that is repeated.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fate, role, text = F.crc32(key.cast("binary")) % 20, F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """The different rows of each conversation with their number and first fault, dealt and sorted by conversation and place."""
    dropped = F.col("copies") == 0
    single = rows.select("conv_id", F.when(~dropped, F.col("turn")).alias("turn"), F.when(~dropped, F.col("role")).alias("role"), F.when(~dropped, F.col("text")).alias("text"), "copies")
    # equal rows stand side by side, so one row with their number is enough
    rows = single.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    conv = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    kind = F.md5(F.concat_ws(":", conv, F.length("role"), "role", "text").cast("binary"))
    rows = cut(rows.withColumn("said", said).withColumn("class", F.when(F.col("said") != "", kind)))
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    classes = cut(rows.where("class is not null and copies > 0").groupBy("class").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    known = join_classes(rows, classes, "class", rows.count())
    again = F.coalesce(F.col("first") < place, F.lit(False))
    fault = F.when(F.col("said") == "", BLANK).when(again, DUPLICATE).when(~F.col("said").isin(".", "!", "?"), CUT_OFF).otherwise(OK)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    out = known.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    return out.withColumn("part", F.spark_partition_id())


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``conv_id, turn, role, text, copies``: its faults, the cheapest edits and what they give.

    Rows are taken by turn (nulls first), then by role and text; equal rows are copies of one another. A row's first
    fault counts: blank, a role and text seen before, cut off. ``copies``: how often the row is there; 0 tells that
    there is such a conversation, and nothing else. Null ids are one conversation; null roles and texts of rows that are
    there must have been filled. A role without characters is never legal. An empty table gives none.

    Result: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. The digest of a
    conversation runs through its text once, so its pieces pass one task in order, one at a time.
    """
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, part int, seq int, {_OUT.replace('blank long, duplicate long, truncated long, illegal long, ', '')}, {_FACTS}, costs array<long>, roles array<string>, texts array<string>, faults array<int>, counts array<long>"

    def pieces(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        out_schema = None
        state: dict[str, Any] = {"conv": None, "open": False, "first": True, "seq": 0, "part": None}
        items: list[Item] = []
        facts, chars, cuts = _Facts(), 0, 0
        ready: list[dict[str, Any]] = []

        def base() -> dict[str, Any]:
            told = {name: getattr(facts, name) for name in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")}
            state["seq"] += 1
            return {"conv_id": state["conv"], "part": state["part"], "seq": state["seq"], **told}

        def piece() -> None:
            """The rows at hand as a piece, searched from every state to every state."""
            nonlocal items, facts, chars, cuts
            found = [search(items, start, ends=False) for start in range(4)]
            costs = [found[a].get(b, (-1, ""))[0] for a in range(4) for b in range(4)]
            ready.append({**base(), "costs": costs, "roles": [x.role for x in items], "texts": [x.text for x in items], "faults": [x.fault for x in items], "counts": [x.count for x in items]})
            items, facts, chars, cuts = [], _Facts(), 0, cuts + 1

        def close(last: bool) -> None:
            """The conversation ends, or the part does."""
            nonlocal items, facts, chars, cuts
            if state["open"]:
                # what begins or ends a part may go on in another
                if cuts or state["first"] or last:
                    piece()
                else:
                    ((cost, edits),) = search(items).values()
                    told = base()
                    gaps = facts.told()[0]
                    ready.append({**told, "gaps": gaps, "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256("\n".join(apply(items, edits)).encode("utf-8", "surrogatepass")).hexdigest()})
                state["first"] = False
            items, facts, chars, cuts = [], _Facts(), 0, 0

        def hand_on() -> Any:
            nonlocal ready
            batch = pa.RecordBatch.from_pylist(ready, out_schema)
            ready = []
            return batch

        for batch in small(batches):
            if out_schema is None:
                text, long_, int_ = pa.string(), pa.int64(), pa.int32()
                kinds = {"long": long_, "int": int_, "string": text, "array<long>": pa.list_(long_), "array<string>": pa.list_(text), "array<int>": pa.list_(int_)}
                fields = [pair.split(" ") for pair in schema.split(", ")[1:]]
                out_schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *[(name, kinds[k]) for name, k in fields]])
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for conv, turn, role, text_, copies, fault, part in zip(*columns):
                if not state["open"] or conv != state["conv"]:
                    close(False)
                    state |= {"conv": conv, "open": True, "part": part}
                if not copies:
                    continue
                if len(items) >= PIECE_ROWS or chars >= PIECE_CHARS:
                    piece()
                one = copies if fault in (BLANK, DUPLICATE) else 1
                for item in [Item(role, text_, fault, one)] + [Item(role, text_, DUPLICATE, copies - one)] * (copies > one):
                    facts.row(turn, item)
                    items.append(item)
                chars += len(text_)
            if ready:
                yield hand_on()
        close(True)
        if ready:
            yield hand_on()

    found = cut(_ordered(rows).mapInArrow(pieces, schema))
    whole = found.where("repaired_sha256 is not null").select("conv_id", *[c.split(" ")[0] for c in _OUT.split(", ")])
    parts = found.where("repaired_sha256 is null")

    def backward(batches: Iterator[Any]) -> Iterator[Any]:
        """What each state behind a piece costs to the end; the pieces come last first."""
        import pyarrow as pa

        conv, begun, ahead = None, False, [cost for cost, _ in ENDS]
        for batch in small(batches):
            out = []
            for name, part, seq, costs in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if not begun or name != conv:
                    conv, begun, ahead = name, True, [cost for cost, _ in ENDS]
                out.append({"part": part, "seq": seq, "ahead": ahead})
                ahead = [min(costs[4 * a + b] + ahead[b] for b in range(4) if costs[4 * a + b] >= 0) for a in range(4)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ahead", pa.list_(pa.int64()))]))

    down = [F.asc_nulls_first("conv_id"), F.desc("part"), F.desc("seq")]
    togo = cut(parts.select("conv_id", "part", "seq", "costs").repartition("conv_id").sortWithinPartitions(*down).mapInArrow(backward, "part int, seq int, ahead array<long>"))
    names = ["part", "seq", "ahead", "roles", "texts", "faults", "counts", *[pair.split(" ")[0] for pair in _FACTS.split(", ")]]

    def forward(batches: Iterator[Any]) -> Iterator[Any]:
        """The way through the pieces, first one first."""
        import pyarrow as pa

        conv, begun, at, cost, edits, digest, said, facts = None, False, 0, 0, [], hashlib.sha256(), False, _Facts()
        kinds = [pa.int64()] * 6 + [pa.string()] * 2

        def done(kind_: Any) -> Any:
            price, end = ENDS[at]
            for turn in apply([], end, at):
                digest.update((("\n" if said else "") + turn).encode())
            row = [conv, *facts.told(), cost + price, "".join(edits) + end, digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [kind_, *kinds])], ["conv_id", *[c.split(" ")[0] for c in _OUT.split(", ")]])

        for batch in small(batches, 1):
            row = batch.to_pylist()[0]
            if not begun or row["conv_id"] != conv:
                if begun:
                    yield done(batch.schema.field("conv_id").type)
                conv, begun, at, cost, edits, digest, said, facts = row["conv_id"], True, 0, 0, [], hashlib.sha256(), False, _Facts()
            kind_ = batch.schema.field("conv_id").type
            items = [Item(*x) for x in zip(row["roles"], row["texts"], row["faults"], row["counts"])]
            ways = search(items, at, ends=False)
            to = min(ways, key=lambda b: (ways[b][0] + row["ahead"][b], ways[b][1]))
            for turn in apply(items, ways[to][1], at):
                digest.update((("\n" if said else "") + turn).encode("utf-8", "surrogatepass"))
                said = True
            cost += ways[to][0]
            edits.append(ways[to][1])
            facts.add(row)
            at = to
        if begun:
            yield done(kind_)

    up = [F.asc_nulls_first("conv_id"), F.asc("part"), F.asc("seq")]
    given = parts.join(togo, ["part", "seq"]).select("conv_id", *names).repartition("conv_id").sortWithinPartitions(*up)
    return whole.unionByName(given.mapInArrow(forward, f"conv_id {kind}, {_OUT}"))
