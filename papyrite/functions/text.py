"""Text expressions: tokenisers, term rules, sentence and token rules. All are Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped off the ends of texts.
STRIP = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
#: Words that carry no search term, and patterns of terms, labels and numbers.
GREP_STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "from", "what", "which", "does", "into", "about", "using", "used", "are", "was", "were",
    "has", "have", "had", "how", "why", "who", "when", "where", "please", "include", "create", "give", "show", "shown", "report", "explain",
    "describe", "based", "paper",
)
NUMBER = r"[0-9]+(?:[,][0-9]{3})*(?:\.[0-9]+)?%?"
TERM = r"[A-Za-z][A-Za-z0-9_-]{1,}|" + NUMBER
LABEL = r"(?i)\b(?:Figure|Table)\s+\d+\b"
NUMERIC_TOKEN = r"\b\d+(?:\.\d+)?%?\b"
#: The same for answers made of excerpts.
ANSWER_STOPWORDS = (
    "the", "and", "for", "that", "this", "with", "from", "what", "which", "does", "into", "about", "using", "used", "are", "was", "were",
    "has", "have", "had", "how", "why", "who", "when", "where", "solve", "problem",
)
ANSWER_TERM = r"[A-Za-z][A-Za-z0-9_-]{1,}|[0-9][0-9,]*(?:\.[0-9]+)?%?"
#: Words that don't count as shared between a requirement and its evidence.
COVERAGE_STOPWORDS = ("the", "a", "an", "of", "in", "for", "and", "or", "to", "is", "are", "that")


def tokens(text: Column) -> Column:
    """Different words in order of appearance: lower case, letters, digits and underscores of any script."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))


def words(text: Column) -> Column:
    """All words in order, lower case, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _terms(text: Column, pattern: str, stop: tuple[str, ...]) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, stop)))


def grep_terms(text: Column) -> Column:
    """Search terms and numbers of a question, lower case, without stop words."""
    return _terms(text, TERM, GREP_STOPWORDS)


def answer_terms(text: Column) -> Column:
    """Terms by which excerpts are chosen for an answer."""
    return _terms(text, ANSWER_TERM, ANSWER_STOPWORDS)


def coverage_tokens(text: Column) -> Column:
    """Words that a requirement and its evidence may share."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, COVERAGE_STOPWORDS)))


def labels(text: Column) -> Column:
    """Mentions of a numbered figure or table, lower case, blanks squeezed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LABEL), F.lit(0)), lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")))


def numeric_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(NUMERIC_TOKEN), F.lit(0)))


def sentences(text: Column) -> Column:
    """Sentences for chunks: line feeds end a sentence, so does a full stop with a blank."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(". ")), r"\. ")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def tokens_by_words(text: Column) -> Column:
    """Estimate for chunks: words over 0.75, 1 at least."""
    return F.greatest(F.lit(1), F.floor(word_count(text) / F.lit(0.75)).cast("int"))


def tokens_by_length(text: Column) -> Column:
    """Estimate for summaries: a quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def tokens_for_budget(text: Column) -> Column:
    """Estimate for budgets: as by length, but 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(tokens_by_length(text))


def strip_tags(html: Column) -> Column:
    """Text of a page: tags become blanks, white space is squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def table_text(html: Column, limit: int = 4000) -> Column:
    """Text of an HTML table: cells apart by bars, rows by line feeds, no blank lines."""
    out = F.regexp_replace(html, "(?i)</t[dh]>", " | ")
    out = F.regexp_replace(out, "(?i)</tr>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n\s+", "\n")
    return F.left(F.btrim(out, F.lit(STRIP)), F.lit(limit))


def compact_excerpt(text: Column, most: Column | int = 360) -> Column:
    """White space squeezed; longer than ``most``: cut behind the last sentence or clause that fits, unless that is short."""
    most = F.lit(most) if isinstance(most, int) else most
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(clean, F.lit(1), most)
    last = lambda mark: F.length(head) - F.locate(mark[::-1], F.reverse(head)) - 1
    ends = F.greatest(*[F.when(head.contains(mark), last(mark)).otherwise(-1) for mark in (". ", "; ")])
    cut = F.when(ends < 120, most).otherwise(ends)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.substring(clean, F.lit(1), cut), F.lit(" .;")), F.lit("\u2026")))


def sentences_of_prose(text: Column) -> Column:
    """Sentences for enrichment: white space behind a full stop, exclamation or question mark parts them."""
    return F.split(text, r"(?<=[.!?])\s+", -1)


def normal_key(name: Column) -> Column:
    """Data set names as keys: lower case, blanks and hyphens as underscores."""
    return F.translate(F.lower(name), " -", "__")
