"""Structured facts: extraction, filters, upserts, deletes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyrite.functions.ids import uuid5

#: Sections in which benchmarks and data sets are looked for, names of measures, patterns of the extractors.
EXPERIMENT_SECTION = re.compile(r"experiment|evaluation|benchmark|result|ablation|comparison", re.I)
DATASET_SECTION = re.compile(r"dataset|experimental\s+setup|data\s+collection|data\s+preparation", re.I)
MEASURES = r"F1(?:\s*@\d+)?|EM|accuracy|BLEU|ROUGE[-\d]*|nDCG(?:@\d+)?|Recall@\d+|MRR|precision|MAP|AUC|perplexity|METEOR|CIDEr|WER|throughput|latency|NDCG(?:@\d+)?"
METRIC = re.compile(rf"({MEASURES})(?:\s*(?:score|value|of|:|=|is)\s*)?(-?\d+(?:[.,]\d+)?)\s*(%|ms|s\b|GB|MB|tokens?|k\b)?", re.I)
ACHIEVES = re.compile(rf"(?:achieves|reaches|obtains|reports)\s+(\d+(?:\.\d+)?)\s*(%|ms|GB|tokens?)?\s+({MEASURES})", re.I)
BENCHMARK = re.compile(r"([A-Z][A-Za-z0-9\-]{1,30})\s+(?:achieves|outperforms|surpasses|beats)(?:\s+[a-z][a-z ]{0,20})?\s+(\d+(?:\.\d+)?)\s*(%|points?)?", re.I)
DATASET = re.compile(r"[\"']([A-Za-z0-9 \-]{3,50})[\"']|([A-Z][A-Za-z0-9]{1,20}(?:-[A-Za-z0-9]{1,20})+)|([A-Z]{3,10})|([A-Z][a-z][A-Za-z]{4,30})")
NO_DATASETS = (
    "The", "This", "These", "That", "With", "From", "Table", "Figure", "Section", "Appendix", "Model", "Method", "System", "Task", "Paper", "Work",
    "Study", "Baseline", "Results", "Models", "Methods", "We", "Our", "Their", "Human", "Large", "Small", "First", "Second", "Third", "Each", "Both",
    "All", "None", "True", "False", "Note", "Also", "Since", "When", "While", "Based", "Using", "Given", "Show", "Shows", "Training", "Testing",
    "Evaluation", "Performance", "Score", "Scores", "BERT", "GPT", "LLM", "LLMS", "API", "GPU", "CPU", "RAM", "NLP", "QA", "RAG",
)
HYPER = tuple(
    (key, re.compile(pattern, re.I))
    for key, pattern in (
        ("learning_rate", r"learning\s*rate\s*(?:of\s*|=\s*|:?\s*)(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"),
        ("batch_size", r"batch\s*size\s*(?:of\s*|=\s*|:?\s*)(\d+)"),
        ("epochs", r"(?:train(?:ed)?\s+for|for)\s+(\d+)\s+epochs?"),
        ("temperature", r"temperature\s*(?:of\s*|=\s*|:?\s*)(\d+(?:\.\d+)?)"),
        ("top_k", r"top[-\s]?k\s*(?:=\s*|:?\s*|of\s*)(\d+)"),
        ("top_p", r"top[-\s]?p\s*(?:=\s*|:?\s*|of\s*)(\d+(?:\.\d+)?)"),
        ("dropout", r"dropout\s*(?:rate\s*)?(?:of\s*|=\s*|:?\s*)(\d+(?:\.\d+)?)"),
        ("hidden_dim", r"hidden\s*(?:dim(?:ension)?|size)\s*(?:of\s*|=\s*|:?\s*)(\d+)"),
        ("max_length", r"max(?:imum)?\s*(?:sequence\s*|token\s*|seq\s*)?length\s*(?:of\s*|=\s*|:?\s*)(\d+)"),
        ("num_layers", r"(?:number\s*of\s*layers?|num(?:_|\s*)layers?)\s*(?:of\s*|=\s*|:?\s*)(\d+)"),
        ("num_heads", r"(?:attention\s*)?heads?\s*(?:of\s*|=\s*|:?\s*)(\d+)"),
        ("weight_decay", r"weight\s*decay\s*(?:of\s*|=\s*|:?\s*)(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"),
    )
)
#: Characters on each side of a find, and most characters of an excerpt.
AROUND, EXCERPT = 50, 200
_DIGIT = re.compile(r"\d")
#: Block types in which facts are looked for.
BLOCK_TYPES = ("paragraph", "text", "ref_text")


def _around(text: str, m: re.Match) -> str:
    snippet = text[max(0, m.start() - AROUND) : m.end() + AROUND].strip()
    return snippet if len(snippet) <= EXCERPT else snippet[: EXCERPT - 1].rstrip() + "\u2026"


def facts_of(text: str, section: str) -> Iterator[tuple[str, str, str, float | None, str | None, str]]:
    """``kind, key, raw, numeric, unit, excerpt`` of a block, in the order of the extractors.

    Commas go from numbers, whatever they part. A name of a data set counts once in a block; it has a hyphen or a
    digit, or capitals only.
    """
    counted = _DIGIT.search(text) is not None  # all but names of data sets have a number
    for pattern, name, number, unit in ((METRIC, 1, 2, 3), (ACHIEVES, 3, 1, 2)) if counted else ():
        for m in pattern.finditer(text):
            yield "metric", m[name].strip().lower().replace(" ", "_"), m[0].strip(), float(m[number].replace(",", "")), m[unit] or None, _around(text, m)
    if counted and EXPERIMENT_SECTION.search(section):
        for m in BENCHMARK.finditer(text):
            yield "benchmark", f"{m[1].lower()}_score", m[0].strip(), float(m[2]), m[3] or None, _around(text, m)
    if DATASET_SECTION.search(section):
        known: set[str] = set()
        for m in DATASET.finditer(text):
            found = (m[1] or m[2] or m[3] or m[4]).strip()
            told = "-" in found or any(map(str.isdigit, found)) or found.isupper() and len(found) > 2
            if told and found not in NO_DATASETS and found.lower() not in known:
                known.add(found.lower())
                yield "dataset", found.lower().replace(" ", "_").replace("-", "_"), found, None, None, _around(text, m)
    for key, pattern in HYPER if counted else ():
        for m in pattern.finditer(text):
            yield "hyperparameter", key, m[1], float(m[1]), None, _around(text, m)


def extract(blocks: DataFrame) -> DataFrame:
    """Facts of ``document_id, seq, section, text, page``; repeats of kind, key, number and page in a document go.

    Where ``block_type`` is there, only blocks of BLOCK_TYPES are read.

    Match offsets are needed, which built-in functions don't give, so blocks go through Arrow batches.
    """

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for rows in (batch.slice(at, 400) for batch in batches for at in range(0, batch.num_rows, 400)):  # few texts as objects at a time
            batch, out = rows, []
            for row in batch.to_pylist():
                found = facts_of(row["text"] or "", row["section"] or "")
                out.extend((row["document_id"], row["seq"], i, row["page"], *fact) for i, fact in enumerate(found))
            types = (batch.schema.field("document_id").type, batch.schema.field("seq").type, pa.int32(), batch.schema.field("page").type, pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
            names = ["document_id", "seq", "pos", "page", "kind", "key", "raw", "numeric", "unit", "excerpt"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 10, types, strict=True)], names)

    if "block_type" in blocks.columns:
        blocks = blocks.where(F.col("block_type").isin(*BLOCK_TYPES))
    kinds = dict(blocks.dtypes)
    rows = blocks.select("document_id", "seq", "section", "text", "page").mapInArrow(run, f"document_id {kinds['document_id']}, seq {kinds['seq']}, pos int, page {kinds['page']}, kind string, key string, raw string, numeric double, unit string, excerpt string")
    return dedupe(rows, ["document_id"], ["seq", "pos"])


def dedupe(facts: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """The first fact of each kind, key, number and page; nulls equal nulls."""
    first = Window.partitionBy(*within, "kind", "key", "numeric", "page").orderBy(*order)
    return facts.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def with_ids(facts: DataFrame, order: list[str]) -> DataFrame:
    """Deterministic ids from document, kind, key, page and the fact's place in its document."""
    seq = F.row_number().over(Window.partitionBy("document_id").orderBy(*order)) - 1
    name = F.concat_ws(":", F.col("document_id").cast("string"), F.lit("fact"), "kind", "key", F.coalesce(F.col("page").cast("string"), F.lit("None")), seq.cast("string"))
    return facts.withColumn("id", uuid5(name))


@dataclass(frozen=True)
class FactFilter:
    """Conditions on facts; those not given don't restrict. Ranges drop rows whose value is null."""

    documents: tuple = ()
    kinds: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    fold_keys: bool = False
    pages: tuple[int | None, int | None] = (None, None)
    numeric: tuple[float | None, float | None] = (None, None)
    units: tuple[str, ...] = ()
    has_unit: bool | None = None
    excerpts: tuple[str, ...] = ()
    datasets: tuple[str, ...] = ()
    methods: tuple[str, ...] = ()
    #: taken for its callers' sake; facts carry no confidence
    confidence_at_least: float | None = None
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 200 or self.offset < 0:
            raise ValueError("limit must be 1 to 200 and offset 0 or more")
        if len(self.keys) > 50 or any(len(k) > 100 for k in self.keys) or len(self.units) > 20:
            raise ValueError("too many or too long keys or units")
        low, high = self.pages
        if low is not None and low < 1 or low is not None and high is not None and high < low:
            raise ValueError("page range")

    def predicate(self) -> Column:
        tests = [F.col(c).isin(*v) for c, v in (("document_id", self.documents), ("kind", self.kinds), ("unit", self.units)) if v]
        if self.keys:
            tests.append(F.lower("key").isin(*map(str.lower, self.keys)) if self.fold_keys else F.col("key").isin(*self.keys))
        for c, (low, high) in (("page", self.pages), ("numeric", self.numeric)):
            tests += [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
        if self.has_unit is not None:
            tests.append(F.col("unit").isNotNull() if self.has_unit else F.col("unit").isNull())
        if self.excerpts:
            tests.append(reduce(Column.__or__, (F.lower("excerpt").contains(s.lower()) for s in self.excerpts)))
        if self.datasets:
            tests.append((F.col("kind") == "dataset") & F.col("key").isin(*(d.lower().replace(" ", "_").replace("-", "_") for d in self.datasets)))
        if self.methods:
            tests.append((F.col("kind") == "benchmark") & F.col("key").isin(*(f"{m.lower()}_score" for m in self.methods)))
        return reduce(Column.__and__, tests, F.lit(True))

    def search(self, facts: DataFrame, order: list[str]) -> DataFrame:
        return facts.where(self.predicate()).orderBy(*order).offset(self.offset).limit(self.limit)


def upsert(old: DataFrame, new: DataFrame, key: str | list[str], mutable: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` merged by key: of known rows only the mutable columns change, unknown ones are added.

    Keys of several columns are equal where both lack the same ones.
    """
    keys = [key] if isinstance(key, str) else key
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    # null-safe equality as an equality that a hash can join by
    same = reduce(Column.__and__, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    merged = o.join(n, same, "full_outer")
    known, there = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    return merged.select(*[F.when(known & ~(there & F.lit(c in mutable)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in old.columns])
