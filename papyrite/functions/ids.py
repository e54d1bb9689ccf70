"""Deterministic identities as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of object identifiers.
NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version 5 UUID of a name in NAMESPACE."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def fingerprint(tool: Column, params: Column) -> Column:
    """Identity of a tool call."""
    return F.sha1(F.concat_ws(":", tool, params))
