"""String keys and row identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    """White space collapsed and trimmed, case folded."""
    return F.lower(F.trim(F.regexp_replace(name, r"[ \t\n\r]+", " ")))


def composite_key(*parts: Column) -> Column:
    """Parts joined by colons; a null part gives a null key."""
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws(":", *[p.cast("string") for p in parts]))


def row_id(*parts: Column) -> Column:
    """32 hexadecimal digits of SHA-256 over the parts, nulls as empty strings."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name within a namespace UUID."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.concat(F.lit("5"), F.substring(raw, 14, 3)), F.concat(variant, F.substring(raw, 18, 3)), F.substring(raw, 21, 12))


def pair_hash(pairs: dict[str, Column]) -> Column:
    """12 hexadecimal digits of a row's (name, value) pairs, sorted by name; values with six digits after the point."""
    each = [F.concat(F.lit(f"{n}="), F.coalesce(F.format_string("%.6f", pairs[n].cast("double")), F.lit("null"))) for n in sorted(pairs)]
    return F.substring(F.sha2(F.concat_ws("\n", *each), 256), 1, 12)
