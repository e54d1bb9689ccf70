"""The mandatory scope of every read: one collection, optionally some of its documents and source types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of a source type in ranking; others weigh 1.
TYPE_BOOST = {
    "document_overview": 2.0,
    "compact_document_overview": 1.6,
    "section_summary": 1.8,
    "compact_section_summary": 1.5,
    "chapter_summary": 1.6,
    "compact_chapter_summary": 1.3,
    "technology_card": 1.4,
    "performance_fact": 1.3,
    "claim": 1.2,
    "definition": 1.2,
    "table_record": 1.1,
    "figure_caption": 1.0,
    "chunk": 1.0,
    "raw_block": 0.9,
}
#: Source types that a filter accepts: those with a weight but one.
SOURCE_TYPES = tuple(kind for kind in TYPE_BOOST if kind != "compact_document_overview")
_FORBIDDEN = set('"\\\n\r')


class InvalidFilter(ValueError):
    """A filter value that must not reach a plan."""


@dataclass(frozen=True)
class Scope:
    """``documents`` and ``types``: None for all. An empty tuple admits nothing, or with ``empty_is_all`` everything."""

    chat: str
    documents: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    empty_is_all: bool = False

    def __post_init__(self) -> None:
        if not str(self.chat):
            raise InvalidFilter("a scope needs a collection")
        for value in (str(self.chat), *map(str, self.documents or ())):
            if _FORBIDDEN & set(value):
                raise InvalidFilter(f"forbidden character in {value!r}")
        for kind in self.types or ():
            if kind not in SOURCE_TYPES:
                raise InvalidFilter(f"unknown source type {kind!r}")

    def predicate(self, chat: str = "chat_id", document: str = "document_id", kind: str = "source_type") -> Column:
        found = F.col(chat) == F.lit(self.chat)
        given = lambda values: values is not None and not (self.empty_is_all and not values)
        if given(self.documents):
            found &= F.col(document).isin(*self.documents)
        if given(self.types):
            found &= F.col(kind).isin(*self.types)
        return found

    def read(self, df: DataFrame, **columns: str) -> DataFrame:
        return df.where(self.predicate(**columns))


def check_owned(asked: DataFrame, owned: DataFrame, key: str = "document_id") -> DataFrame:
    """``asked`` once each, if all of it is owned; else an error that names up to five that aren't."""
    missing = asked.join(owned, key, "left_anti").select(key).distinct().limit(5).collect()
    if missing:
        raise InvalidFilter(f"not in the collection: {sorted(str(r[0]) for r in missing)}")
    return asked.dropDuplicates([key])


def type_boost(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in TYPE_BOOST.items():
        if weight != 1.0:
            out = F.when(kind == name, weight).otherwise(out)
    return out
