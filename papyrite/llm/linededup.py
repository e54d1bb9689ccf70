"""Line deduplication: exact by the line itself, near by a segment-partition edit join; DataFrame functions only.

Two lines within e edits share one of the e + 1 segments of the shorter one, at a place that its length and the
segment's number narrow down; e is EDITS, and less where the shorter line is too short for them. Each different line
indexes its segments and probes for those of lines as long or a little shorter. Lines that meet under a key are
compared by a banded bit-parallel automaton: a lane of a word for each number of edits, a bit for each diagonal of the band.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.llm.graph import components
from papyrite.llm.shared import WHITE, cut, drop, if_small, join_classes, kept_names

#: Most edits (insertions, deletions, substitutions of a character) between lines that count as one.
EDITS = 2
#: Characters (white space at the beginning aside) under which lines are left alone: blank ones.
SHORTEST = 1
#: Characters of a line for each edit; lines under EACH are compared exactly only.
EACH = 8
#: Parts of a line that are looked for in another before the two are compared.
PARTS = 6
#: Characters from the first difference on that are compared before all.
HEAD = 32
#: Lines with one key above which they are divided further instead of compared.
CROWD = 6
#: Parts of a line by the edits allowed, so many of which are left out.
CUTS = {1: 3, 2: 6}


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, line`` of the lines that take part: those that aren't blank."""
    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return whole.where(F.length(F.ltrim("line", F.lit(WHITE))) >= SHORTEST).select("id", "line_no", F.trim("line").alias("line"))


def _allowed(length: Column) -> Column:
    """Edits between a line of this length and a line as long or longer."""
    return F.least(F.floor(length / EACH), F.lit(EDITS)).cast("int")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value being evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def _common(x: Column, y: Column, room: Column) -> Column:
    """Characters that two strings have in common at their beginning, ``room`` at most, by halving."""

    def grow(state: Column, k: Column) -> Column:
        n, more = state["n"], F.call_function("shiftleft", F.lit(1), k)
        same = (n + more <= state["room"]) & (F.substring(state["x"], n + 1, more) == F.substring(state["y"], n + 1, more))
        return F.struct(state["x"].alias("x"), state["y"].alias("y"), state["room"].alias("room"), F.when(same, n + more).otherwise(n).alias("n"))

    begin = F.struct(x.alias("x"), y.alias("y"), room.alias("room"), F.lit(0).alias("n"))
    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.floor(F.log2(room + 1)).cast("int"))), begin, grow, lambda s: s["n"])


def _may_match(x: Column, y: Column) -> Column:
    """Whether so many of PARTS parts of ``x`` are somewhere in ``y`` as edits must leave whole: each edit touches one at most."""
    length = F.length(x)
    border = lambda k: F.floor(length * k / PARTS).cast("int")
    there = [y.contains(F.substring(x, border(k) + 1, border(k + 1) - border(k))).cast("int") for k in range(PARTS)]
    return reduce(Column.__add__, there) >= PARTS - _allowed(F.least(length, F.length(y)))


def within(x: Column, y: Column) -> Column:
    """Whether two lines are within the edits allowed for the shorter one.

    Lane k of a word has a bit for each of the 2 * EDITS + 1 diagonals: bit d says that the first j + d - EDITS
    characters of ``x`` are within k edits of the first j of ``y``. A character of ``y`` moves all lanes at once: a match
    keeps a bit; a substitution keeps and an insertion lowers a bit of the lane before, a deletion raises it.
    """
    width, lane = 2 * EDITS + 1, 3 * EDITS + 2
    spread = sum(1 << (lane * k) for k in range(EDITS + 1))
    mask = spread * ((1 << width) - 1)
    start = sum(1 << (lane * k + EDITS + i) for k in range(EDITS + 1) for i in range(k + 1))
    every = lambda columns: reduce(Column.bitwiseOR, columns)

    def step(state: Column, char: Column) -> Column:
        word, j = state["word"], state["j"]
        match = every([F.when(F.get(state["x"], j + (d - EDITS)) == char, F.lit(spread << d)).otherwise(F.lit(0)).cast("long") for d in range(width)])
        level = every([word.bitwiseAND(match), F.shiftleft(word, lane), F.shiftleft(word, lane - 1)]).bitwiseAND(F.lit(mask).cast("long"))
        moved = _bound(level, lambda n: every([n] + [F.shiftleft(n, (lane + 1) * k) for k in range(1, EDITS + 1)]).bitwiseAND(F.lit(mask).cast("long")))
        return F.struct(state["x"].alias("x"), (j + 1).alias("j"), F.when(word == 0, word).otherwise(moved).alias("word"))

    longer = F.length(x) - F.length(y)
    allowed = _allowed(F.least(F.length(x), F.length(y)))

    def end(state: Column) -> Column:
        place = (allowed * lane + EDITS + longer).cast("int")
        return F.call_function("shiftright", state["word"], place).bitwiseAND(F.lit(1).cast("long")) == 1

    def compared(prefix: Column, suffix: Column) -> Column:
        def states(room: Column, out: Callable[[Column], Column]) -> Column:
            between = lambda line, more: F.filter(F.split(F.substring(line, prefix + 1, F.least(F.length(line) - prefix - suffix, room + more)), ""), lambda c: c != "")
            begin = F.struct(between(x, EDITS).alias("x"), F.lit(0).alias("j"), F.lit(start).cast("long").alias("word"))
            return F.aggregate(between(y, 0), begin, step, out)

        # most lines that are not near differ in more than the edits within a few words: those are not gone through to the end
        whole = F.length(y) - prefix - suffix
        return F.when((whole <= HEAD) | states(F.lit(HEAD), lambda state: state["word"] != 0), states(whole + EDITS, end)).otherwise(False)

    # what the lines have in common at both ends adds no edits
    shorter = F.least(F.length(x), F.length(y))
    inner = _bound(_common(x, y, shorter), lambda prefix: _bound(_common(F.reverse(x), F.reverse(y), shorter - prefix), lambda suffix: compared(prefix, suffix)))
    return F.when((F.abs(longer) <= allowed) & _may_match(x, y), inner).otherwise(False)


def _segments() -> list[tuple[int, int, int, int, bool]]:
    """What to take of a line, as (edits, longer, k, shift, own): segment ``k`` of a line ``longer`` characters shorter.

    Before segment k there are at most k edits, behind it at most edits - k: both bound the shift.
    """
    return [
        (edits, longer, k, shift, longer == 0 and shift == 0)
        for edits in range(1, EDITS + 1)
        for longer in range(edits + 1)
        for k in range(edits + 1)
        for shift in range(max(-k, longer - (edits - k)), min(k, longer + (edits - k)) + 1)
    ]


def _entries(lines: DataFrame) -> DataFrame:
    """``key, mark``: the keys of the lines' own segments, and those of substrings that could be segments of a shorter line.

    ``mark`` is the line's ``h``, which is even, and 1 more for an own segment.
    """
    kind = "array<struct<edits:int,longer:int,k:int,shift:int,own:boolean>>"
    every = F.array(*[F.struct(*map(F.lit, s)) for s in _segments()]).cast(kind)
    rows = lines.select("h", "line", F.length("line").alias("length"), F.explode(every).alias("s")).withColumn("other", F.col("length") - F.col("s.longer"))
    rows = rows.where(_allowed(F.col("other")) == F.col("s.edits"))
    border = lambda k: F.floor(F.col("other") * k / (F.col("s.edits") + 1)).cast("int")
    begin, size = border(F.col("s.k")), border(F.col("s.k") + 1) - border(F.col("s.k"))
    return rows.select(F.xxhash64(F.substring("line", begin + F.col("s.shift") + 1, size), "other", "s.k").alias("key"), (F.col("h") + F.col("s.own").cast("long")).alias("mark"))


def _ways() -> list[tuple[int, int, int, int, int]]:
    """``e, i, j, longer, shift``: parts ``i`` and ``j`` (of one edit: one part) are left out, what is between them is shifted."""
    left_out = [(e, i, j) for e in range(1, EDITS + 1) for i in range(CUTS[e]) for j in (range(i + 1, CUTS[e]) if e > 1 else [i])]
    return [(e, i, j, longer, shift) for e, i, j in left_out for longer in range(e + 1) for shift in (range(-e, e + 1) if j > i + 1 else [0]) if j <= i + 1 or abs(shift) + abs(longer - shift) <= e]


def _cut_up(rows: DataFrame, first: bool) -> DataFrame:
    """``rows`` (``h, component, grp, e, s``) with ``longer``, for each way to leave out ``e`` of a shorter line's parts: ``class, rest, final, straight``.

    e edits touch e of the e + 2 parts at most. What is before the first one of those is in its place, what is between
    both is shifted by the edits of the first, what is behind the last by ``longer``. ``class`` is a hash of all that must
    be equal, ``rest`` what is left out. A line of no more than ``e`` characters is left out as a whole (``final``).
    ``straight``: nothing is shifted; ``even``: both lines are equally long. ``first``: ``e`` must be what the shorter line's length allows.
    """
    each = rows.withColumn("other", F.length("s") - F.col("longer")).where("other >= 0").withColumn("final", F.col("other") <= F.col("e"))
    if first:
        each = each.where(_allowed(F.col("other")) == F.col("e"))
    some = F.array(*[F.struct(*map(F.lit, w)) for w in _ways()]).cast("array<struct<e:int,i:int,j:int,longer:int,shift:int>>")
    mine = F.filter(some, lambda w: (w["e"] == F.col("e")) & (w["longer"] == F.col("longer")) & (~F.col("final") | (w["i"] == 0) & (w["j"] == F.col("e") - 1)))
    each = each.withColumn("w", F.explode(mine))
    border = lambda k: F.floor(F.col("other") * k / F.when(F.col("e") == 1, CUTS[1]).otherwise(CUTS[2])).cast("int")
    i, j, shift = F.col("w.i"), F.col("w.j"), F.col("w.shift")
    apart = j > i + 1
    # ends of what is equal before, and of what is between; where both parts left out are neighbours, nothing is
    before, behind = border(i), F.when(F.col("final"), F.length("s")).otherwise(border(j + 1) + F.col("longer"))
    low, high = F.when(apart, border(i + 1) + shift).otherwise(behind), F.when(apart, border(j) + shift).otherwise(behind)
    each = each.select("h", "component", "grp", "e", "s", "longer", "other", "final", i.alias("i"), j.alias("j"), shift.alias("shift"), before.alias("before"), low.alias("low"), high.alias("high"), behind.alias("behind"))
    each = each.where("before <= low and high <= behind")
    piece = lambda begin, end: F.substring("s", begin + 1, end - begin)
    begin, middle, rear = F.substring("s", F.lit(1), F.col("before")), piece(F.col("low"), F.col("high")), F.substring("s", F.col("behind") + 1, F.length("s"))
    rest = F.concat(piece(F.col("before"), F.col("low")), piece(F.col("high"), F.col("behind")))
    return each.select("h", "component", "e", F.xxhash64("grp", "other", "i", "j", begin, middle, rear).alias("class"), rest.alias("rest"), "final", ((F.col("longer") == 0) & (F.col("shift") == 0)).alias("straight"), (F.col("longer") == 0).alias("even"))


def _without_ends(rows: DataFrame) -> DataFrame:
    """``rows`` without what all of a group have in common at the beginning and at the end, which adds no edits."""
    ends = rows.groupBy(F.col("grp").alias("class")).agg(F.count("*").alias("n"), F.min(F.length("s")).alias("room"), *[f(c).alias(name + side) for side, c in (("_a", F.col("s")), ("_z", F.reverse("s"))) for name, f in (("low", F.min), ("high", F.max))])
    # what the first and the last of sorted strings have in common, all have
    ends = ends.withColumn("prefix", _common(F.col("low_a"), F.col("high_a"), F.col("room"))).select("class", "n", "room", "low_z", "high_z", "prefix")
    ends = cut(ends.select("class", "n", "prefix", _common(F.col("low_z"), F.col("high_z"), F.col("room") - F.col("prefix")).alias("suffix")))
    inner = F.substring("s", F.col("prefix") + 1, F.length("s") - F.col("prefix") - F.col("suffix"))
    return join_classes(rows, ends, "grp", rows.count()).select("h", "component", "grp", "e", "own", inner.alias("s"))


def candidates(lines: DataFrame) -> DataFrame:
    """``a, b``: pairs of different components of ``h, component, line`` among which are all that are within the allowed edits.

    A line is cut into e + 2 parts, and each way to leave e of them out is a key: lines within e edits have one in common,
    and with it half of their characters at least. A key that more than CROWD lines have is no reason to compare them with
    all that have it. Those lines form a group: what they share goes, as do the ends that all of them have in common, and
    what was left out is divided anew. What two lines within e edits have besides equal parts is within e edits as well, so
    no pair is lost; what is left gets shorter each time. Where it is no longer than e, the lines of a group differ in so
    few characters that they are all compared.
    """
    several = lines.withColumn("e", F.explode(F.sequence(F.lit(1), F.lit(EDITS)))).where(_allowed(F.length("line")) >= F.col("e"))
    rows, pairs, first = cut(several.select("h", "component", F.col("e").cast("long").alias("grp"), "e", F.lit(True).alias("own"), F.col("line").alias("s"))), [], True
    while not rows.isEmpty():
        index = cut(_cut_up(rows.where("own").withColumn("longer", F.lit(0)), first).where("straight"))
        owned = cut(index.groupBy("class").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")))
        total = rows.count()
        probes = _cut_up(rows.withColumn("longer", F.explode(F.sequence(F.lit(0), F.col("e")))), first)
        met = join_classes(probes, owned, "class", total).where("n is not null and (low <> component or high <> component)")
        met = cut(met.select("h", "component", "e", "class", "rest", "even", (F.col("final") | (F.col("n") <= CROWD)).alias("few")))
        asked = cut(met.groupBy("class").agg(F.count("*").alias("n"), F.first("few").alias("few")))
        owners = join_classes(index, asked, "class", total).where("n is not null")
        few = owners.where("few").select("class", F.col("h").alias("a"), F.col("component").alias("ca"))
        # lines of one length look for one another: one of both ways is enough
        both = met.where("few").select("class", "h", "component", "even").distinct().join(few, "class").where("component <> ca and (not even or h > a)")
        pairs.append(cut(both.select(F.least("a", "h").alias("a"), F.greatest("a", "h").alias("b")).distinct()))
        again = lambda df, own: df.where("not few").select("h", "component", F.col("class").alias("grp"), "e", F.lit(own).alias("own"), F.col("rest").alias("s"))
        groups = cut(again(owners, True).unionByName(again(met, False)).groupBy("h", "component", "grp", "e", "s").agg(F.max("own").alias("own")))
        drop(rows, index, owned, met, asked)
        rows, first = groups, False
        if not groups.isEmpty():
            rows = cut(_without_ends(groups))
            drop(groups)
    drop(rows)
    if not pairs:
        return lines.select(F.col("h").alias("a"), F.col("h").alias("b")).where("false")
    return cut(reduce(DataFrame.union, pairs).distinct())


def _refined_links(lines: DataFrame) -> DataFrame:
    """Links ``a, b`` between different components of ``h, component, line``, complete also where many lines share most of their text."""
    pairs, text = candidates(lines), lines.select("h", "line")
    both = pairs.join(text.select(F.col("h").alias("b"), F.col("line").alias("y")).hint("merge"), "b").join(text.select(F.col("h").alias("a"), F.col("line").alias("x")).hint("merge"), "a")
    return cut(both.where(within(F.col("x"), F.col("y"))).select("a", "b"))


def near_links(lines: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all lines (``h, line``, all different) within the allowed edits; not every pair of a connected group."""
    per_key = Window.partitionBy("key")
    h, own = F.col("mark").bitwiseAND(F.lit(-2).cast("long")), F.col("mark").bitwiseAND(F.lit(1).cast("long")) == 1
    met = _entries(lines.where(F.length("line") >= EACH)).select(h.alias("h"), "key", own.alias("own"), F.min(h).over(per_key).alias("low"), F.max(h).over(per_key).alias("high"), F.min(F.when(own, h)).over(per_key).alias("pivot"))
    members = cut(met.where("low <> high and pivot is not null").groupBy("key", "h").agg(F.max("own").alias("own"), F.min("pivot").alias("pivot")))
    wanted = cut(members.select("h").distinct())
    texts = cut(lines.select("h", "line").join(if_small(wanted), "h", "left_semi"))

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # first each member of a key with one that has the segment; many may have the same one, so its text is joined last
    pairs = members.where("h <> pivot").select(F.col("pivot").alias("a"), F.col("h").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")).hint("merge"), "b").join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")).hint("merge"), "a")
    first = cut(both.where(within(F.col("x"), F.col("y"))).select(*ordered("a", "b")))
    found = components(first)
    # then the lines of keys that are still apart
    placed = members.join(if_small(found.withColumnRenamed("id", "h")), "h", "left").select("key", "h", F.coalesce("component", "h").alias("component"))
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low <> high and m > 2").select("key")
    rest = cut(placed.join(apart, "key", "left_semi").select("h", "component").distinct())
    crowded = cut(texts.join(if_small(rest), "h").select("h", "component", "line"))
    links = cut(first.union(_refined_links(crowded)))
    drop(rest, crowded)
    drop(members, wanted, texts, first)
    return links


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines that repeat an earlier one: ``id_col, line_no, kept_<id_col>, kept_line_no, exact``.

    Lines (split at line feeds, counted from 0, blanks at their ends aside) form groups: equal ones, and those connected
    by an edit for every EACH characters of the shorter, EDITS at most. Of each group the first line by id and place
    stays. Blank lines, null texts and rows with a null id take no part; rows with the same id are one document. Other
    columns are not read.
    """
    lines = _lines(docs, id_col, text_col)
    # grouped by the line itself, numbered as it is written; 96 bits of hashes lead each line to its number
    signature = [F.xxhash64("line").alias("x"), F.hash("line").alias("m")]
    grouped = lines.groupBy("line").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    different = cut(grouped.select((2 * F.monotonically_increasing_id()).alias("h"), "line", *signature, "id", "n"))
    groups = cut(components(near_links(different)).withColumnRenamed("id", "h"))
    placed = different.select("h", "x", "m", "id", "n").join(if_small(groups), "h", "left").where("n > 1 or component is not null")
    placed = cut(placed.select("h", "x", "m", F.coalesce("component", "h").alias("component"), "id"))
    kept = placed.groupBy("component").agg(F.min("id").alias("kept"))
    target = cut(placed.select("h", "x", "m", "component").join(kept, "component"))
    hit = cut(lines.select("id", "line_no", *signature).join(if_small(target), ["x", "m"]).drop("x", "m"))
    drop(different, groups, placed, target)
    first = cut(hit.where("id = kept").groupBy("component").agg(F.min(F.struct("line_no", "h")).alias("first")))
    out = hit.join(if_small(first), "component").where("id <> kept or line_no <> first.line_no")
    return out.select(F.col("id").alias(id_col), "line_no", F.col("kept").alias("kept_" + id_col), F.col("first.line_no").alias("kept_line_no"), (F.col("h") == F.col("first.h")).alias("exact"))


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` without the lines in ``found``; documents left without any text are dropped, ``length_col`` follows.

    Rows with a null id have no line in ``found`` and stay as they are.
    """
    own = kept_names(["id", "gone", "left"], docs.columns)
    gone = found.groupBy(F.col(id_col).alias(own[0])).agg(F.collect_set("line_no").alias(own[1]))
    joined = docs.join(gone, docs[id_col] == F.col(own[0]), "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own[1]))
    shorter = _bound(F.split(F.col(text_col), "\n", -1), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    changed = F.col(own[1]).isNotNull()
    out = joined.withColumn(own[2], F.when(changed, shorter).otherwise(F.col(text_col))).where(~changed | (F.ltrim(F.col(own[2]), F.lit(WHITE)) != ""))
    columns = [F.col(own[2]).alias(c) if c == text_col else F.when(changed, F.length(F.col(own[2]))).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return out.select(*columns)
