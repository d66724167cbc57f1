"""Fingerprints with fixed byte framing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def fingerprint(value: Column) -> Column:
    """sha256:<hex> of a text or bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def entries(rows: Column) -> Column:
    """Digest of sorted entries, each followed by NUL; no entry hashes the empty text. An aggregate."""
    listed = F.array_sort(F.collect_list(rows))
    return fingerprint(F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit(NUL))), ""))


def ordered_entries(position: Column, rows: Column) -> Column:
    """Digest of entries in the order of position, each followed by NUL. An aggregate."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), rows.alias("e")))), lambda x: F.concat(x["e"], F.lit(NUL)))
    return fingerprint(F.array_join(listed, ""))


def framed_file(path: Column, content: Column) -> Column:
    """Bytes of one file in a multi-file digest: path, NUL, length as 8 big-endian bytes, content."""
    raw = F.encode(content, "UTF-8")
    size = F.unhex(F.lpad(F.hex(F.octet_length(content).cast("long")), 16, "0"))
    return F.concat(F.encode(path, "UTF-8"), F.unhex(F.lit("00")), size, raw)


def files(path: Column, content: Column) -> Column:
    """Digest of many files in order of path. An aggregate for configuration-sized sets."""
    listed = F.array_sort(F.collect_list(F.struct(path.alias("p"), F.hex(framed_file(path, content)).alias("b"))))
    return fingerprint(F.unhex(F.array_join(F.transform(listed, lambda x: x["b"]), "")))


def identity_key(*fields: Column) -> Column:
    """Cache key of an identity: SHA-256 of its compact JSON in declared order, nulls left out."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
