"""Personal data in texts: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions: the text is split at the matches of a pattern, and the lengths of the parts give the
offsets, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrite.llm.shared import kept_names

#: Kinds in the order of the listing; those after ``phone`` are additions of the method.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: What each kind's matches look like. Possessive repeats keep the meaning (nothing that follows could take back a
#: character) and spare the matcher's stack; the look-behind skips beginnings inside a run that was tried already.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without a match of this has none of the pattern above either.
NEEDS = {"email": "@", "phone": "+"}
#: Words that make a kind more credible when they stand near.
CONTEXT = {
    "email": "mail|contact|write|e-mail",
    "ip": "ip|host|address|server|login",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|call|mobile|cell|fax",
    "iban": "iban|bank|account|konto|transfer",
    "ssn": "ssn|social security|taxpayer",
}
#: Score of a match by its form, of a checksum, of a context word; what additions must reach.
FORM = {"email": 0.8, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CHECKSUM, NEARBY, REPORTED = 0.4, 0.3, 0.6
#: Matches that are gathered in one array before it joins the others.
BLOCK = 256
SPANS = "array<struct<start:int,place:int,end:int,score:double>>"
#: Columns of the result besides those that are kept.
OUT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
#: Characters on either side in which context words count.
REACH = 48


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    reverse = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(reverse, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda total, x: total + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _mod97(plain: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters put last."""
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    each = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))
    return F.aggregate(each, F.lit(0), lambda r, a: F.when(a >= 65, (r * 100 + a - 55) % 97).otherwise((r * 10 + a - 48) % 97)) == 1


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


def _valid(kind: str, match: Column) -> tuple[Column, Column]:
    """Whether a match counts, and whether a checksum confirms it."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), F.lit(False)
    if kind == "card":
        fits = F.length(digits).between(14, 19)
        return F.when(fits, _luhn(digits)).otherwise(False), F.lit(True)
    if kind == "phone":
        return F.length(digits).between(10, 15), F.lit(False)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.when(F.length(plain).between(15, 34), _mod97(plain)).otherwise(False), F.lit(True)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(False)
    return F.lit(True), F.lit(False)


def _spans(kind: str, text: Column) -> Column:
    """Array of (start, order, end, score) of the kind's spans, end exclusive."""
    pattern, place = F.lit(PATTERNS[kind]), KINDS.index(kind)
    empty = F.array().cast(SPANS)
    parts = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"), F.slice(F.split(text, PATTERNS[kind], -1), 2, 2147483647).alias("after"))
    near = f"(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"

    def step(state: Column, part: Column) -> Column:
        gap, match = part["gap"], F.coalesce(part["match"], F.lit(""))
        start = state["at"] + F.length(gap)
        end = start + F.length(match)
        valid, checked = _valid(kind, match)
        around = F.concat(F.right(gap, F.lit(REACH)), F.lit(" . "), F.left(F.coalesce(part["after"], F.lit("")), F.lit(REACH)))
        score = F.least(F.lit(1.0), F.lit(FORM[kind]) + F.when(checked, CHECKSUM).otherwise(0.0) + F.when(around.rlike(near), NEARBY).otherwise(0.0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"), score.cast("double").alias("score"))
        counts = part["match"].isNotNull() & valid & ((score >= REPORTED) if place > 3 else F.lit(True))
        return F.struct(end.alias("at"), F.when(counts, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    # in blocks, so that no array grows one by one to the number of all matches
    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("found")), step)
        return F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(state["found"], F.array(i["found"])).alias("found")))[0]

    def blocks(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found")), block, lambda s: F.flatten(s["found"]))

    return F.when(F.col("has_" + kind), F.transform(F.array(parts), blocks)[0]).otherwise(empty)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_email, n_ip, n_card, n_phone, base_sha256, spans, scores``, one row per input row.

    Base kinds are reported whenever their form (and, for cards, Luhn's check) holds; account numbers and social
    security numbers are added where checksum or context lift them to ``REPORTED``. ``scores`` lists the spans'
    scores in the order of ``spans``. Null texts count as empty: no spans. Repeated rows are read each, an empty table
    gives none. A kept column named as one of these comes back with ``_kept`` behind its name.
    """
    text = F.col("__text")
    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, inner, strict=True)], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    digits = rows.withColumn("__digit", text.rlike("[0-9]"))
    for kind in KINDS:
        has = F.col("__digit") if kind != "email" else F.lit(True)
        if kind in NEEDS:
            has = has & text.contains(NEEDS[kind])
        elif kind != "ip":
            has = has & text.rlike({"card": "[0-9](?:[\\x20-]?[0-9]){13}", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]"}[kind])
        digits = digits.withColumn("has_" + kind, has)
    spans = digits
    for kind in KINDS:
        spans = spans.withColumn("s_" + kind, _spans(kind, text))
    base = F.array_sort(F.concat(*[F.col("s_" + k) for k in KINDS[:4]]))
    every = F.array_sort(F.concat(*[F.col("s_" + k) for k in KINDS]))
    out = spans.select(*inner, *[F.size("s_" + k).cast("long").alias("n_" + k) for k in KINDS[:4]], base.alias("__base"), every.alias("__all"))
    named = [F.col(k).alias(name) for k, name in zip(inner, kept_names(keep, OUT), strict=True)]
    return out.select(*named, *["n_" + k for k in KINDS[:4]], F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"), _listed(F.col("__all")).alias("spans"), F.array_join(F.transform("__all", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))
