"""Positions, terms and snippets of texts, as Column expressions over UTF-8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A term is a maximal run of letters, digits and underscores.
TERM = r"[\p{IsAlphabetic}\p{N}_]+"
_PIECES = r"([\p{IsAlphabetic}\p{N}_]+|[^\p{IsAlphabetic}\p{N}_]+)"


def _long(c: Column) -> Column:
    return c.cast("long")


def terms(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, term, start_byte, end_byte) of every term of every text, byte offsets half-open.

    Texts are dealt by key before they are taken apart: the running sum then needs no shuffle of pieces.
    """
    pieces = docs.repartition(key).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(1))).alias("pos", "term"))
    upto = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ended = pieces.withColumn("end_byte", F.sum(_long(F.octet_length("term"))).over(upto))
    return ended.where(F.col("term").rlike(f"^{TERM}$")).select(key, "term", (F.col("end_byte") - F.octet_length("term")).alias("start_byte"), "end_byte")


def term_positions(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, term, start_byte, line, column) of every term, line and column from 1 and the column in characters.

    For all terms at once: running sums over a text's pieces, where position() would look at the text for each.
    """
    pieces = docs.repartition(key).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(1))).alias("pos", "term"))
    order = W.partitionBy(key).orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(_long(c)).over(before), F.lit(0))
    breaks = F.char_length("term") - F.char_length(F.translate("term", "\n", ""))
    placed = pieces.withColumn("start_byte", so_far(F.octet_length("term"))).withColumn("at", so_far(F.char_length("term"))).withColumn("line", so_far(breaks) + 1)
    begun = F.when(breaks > 0, F.col("at") + F.char_length("term") - F.char_length(F.substring_index("term", "\n", -1)))
    placed = placed.withColumn("column", F.col("at") - F.coalesce(F.max(begun).over(before), F.lit(0)) + 1)
    return placed.where(F.col("term").rlike(f"^{TERM}$")).select(key, "term", "start_byte", "line", "column")


def _prefix(text: Column, offset: Column) -> Column:
    return F.substring(F.encode(text, "UTF-8"), F.lit(1), offset.cast("int"))


def position(text: Column, offset: Column) -> Column:
    """struct(line, column) from 1 of a byte offset; null out of range or inside a character."""
    head = _prefix(text, offset)
    ok = (offset >= 0) & (offset <= F.octet_length(text)) & F.is_valid_utf8(head)
    lines = F.split(F.decode(head, "UTF-8"), "\n")
    spot = F.struct(F.size(lines).cast("long").alias("line"), (F.char_length(F.element_at(lines, -1)) + 1).cast("long").alias("column"))
    return F.when(ok, spot)


def offset(text: Column, line: Column, column: Column) -> Column:
    """Byte offset of a 1-based line and scalar column (one past the line's end at most); null out of range."""
    lines = F.split(text, "\n")
    row = F.get(lines, (line - 1).cast("int"))
    before = F.aggregate(F.slice(lines, 1, F.greatest((line - 1).cast("int"), F.lit(0))), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    ok = (line >= 1) & (column >= 1) & (line <= F.size(lines)) & (column <= F.char_length(row) + 1)
    return F.when(ok, before + _long(F.octet_length(F.substring(row, F.lit(1), (column - 1).cast("int")))))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def snippet(text: Column, start: Column, end: Column) -> Column:
    """The whole lines around a byte range, trimmed."""
    raw = F.encode(text, "UTF-8")
    head = F.decode(F.substring(raw, F.lit(1), start.cast("int")), "UTF-8")
    middle = F.decode(F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
    tail = F.decode(F.substring(raw, (end + 1).cast("int"), F.octet_length(text)), "UTF-8")
    whole = F.concat(F.substring_index(head, "\n", -1), middle, F.substring_index(tail, "\n", 1))
    return trimmed(whole)


#: A term with what stands between it and the one before.
_LED = r"[^\p{IsAlphabetic}\p{N}_]*[\p{IsAlphabetic}\p{N}_]+"
#: Parts whose lengths are summed one by one: each sum copies those before it, so a long array is summed in groups.
_AT_A_TIME = 16


def _sums(parts: Column, base: Column, length: Callable[[Column], Column]) -> Column:
    """base and its running sums with the lengths of the parts."""
    return F.aggregate(parts, F.array(base), lambda sums, p: F.array_append(sums, F.element_at(sums, -1) + length(p)))


def _starts(parts: Column, more: int = 0) -> Column:
    """The byte at which each part starts, if they follow each other with so many bytes more after each."""
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / _AT_A_TIME)), lambda g: F.slice(parts, (g * _AT_A_TIME + 1).cast("int"), _AT_A_TIME))
    bases = _sums(groups, F.lit(0).cast("long"), lambda g: _long(F.octet_length(F.array_join(g, "")) + F.size(g) * more))
    inside = F.zip_with(groups, F.slice(bases, 1, F.size(groups)), lambda g, base: F.slice(_sums(g, base, lambda p: _long(F.octet_length(p) + more)), 1, F.size(g)))
    return F.flatten(inside)


def snippets(docs: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, start_byte, end_byte, line) of every term of every text: its place and snippet, for all terms at once.

    A text is taken apart into lines and a line into terms, each read once, where snippet() reads the whole text for each term.
    A term is in one line and a text in one row, so nothing is joined or ordered.
    """
    lines = docs.repartition(key).select(key, F.split(text, "\n").alias("_raw")).withColumn("_at", _starts(F.col("_raw"), 1))
    lines = lines.select(key, F.explode(F.arrays_zip("_raw", "_at")).alias("_l")).select(key, "_l._raw", "_l._at")
    led = lines.withColumn("_led", F.regexp_extract_all("_raw", F.lit(_LED), F.lit(0))).where(F.size("_led") > 0)
    term = F.regexp_extract_all("_raw", F.lit(f"({TERM})"), F.lit(1))
    placed = led.select(key, "_at", "_led", term.alias("_term"), _starts(F.col("_led")).alias("_from"), trimmed(F.col("_raw")).alias("line"))
    found = placed.select(key, "_at", "line", F.explode(F.arrays_zip("_led", "_term", "_from")).alias("_t"))
    end = F.col("_at") + F.col("_t._from") + F.octet_length("_t._led")
    return found.select(key, (end - F.octet_length("_t._term")).alias("start_byte"), end.alias("end_byte"), "line")


def range_text(text: Column, start: Column, end: Column) -> Column:
    """A byte range's text with white space runs as one space."""
    inner = F.decode(F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")
    return F.trim(F.regexp_replace(inner, r"\s+", " "))


def generic_context(text: Column, start: Column, end: Column) -> Column:
    """`Name<...>` around a type argument's byte range, or null: the last name that opens `<` before it, to its `>`."""
    raw = F.encode(text, "UTF-8")
    head = F.decode(F.substring(raw, F.lit(1), start.cast("int")), "UTF-8")
    tail = F.decode(F.substring(raw, (start + 1).cast("int"), F.octet_length(text)), "UTF-8")
    opened = F.regexp_extract(head, r"([\p{IsAlphabetic}\p{N}_.]+\s*<[^<>\n]*)$", 1)
    closed = F.regexp_extract(tail, r"^([^<>\n]*>)", 1)
    return F.when((opened != "") & (closed != "") & (end > start), F.regexp_replace(F.concat(opened, closed), r"\s+", " "))


def utf16_to_utf8(text: Column, units: Column) -> Column:
    """Byte offset of an offset in UTF-16 units; one inside a surrogate pair goes to the pair's end."""
    chars = F.split(text, "")
    state = F.struct(F.lit(0).alias("u"), F.lit(0).alias("b"))

    def step(acc: Column, c: Column) -> Column:
        wide = F.when(F.octet_length(c) >= 4, 2).otherwise(1)
        more = acc["u"] < units
        return F.struct(F.when(more, acc["u"] + wide).otherwise(acc["u"]).alias("u"), F.when(more, acc["b"] + F.octet_length(c)).otherwise(acc["b"]).alias("b"))

    return F.aggregate(chars, state, step, lambda acc: _long(acc["b"]))


def searchable(term: str) -> bool:
    """Whether a term search can have this query: not empty, letters, digits and underscores only."""
    return bool(term) and all(c.isalnum() or c == "_" for c in term)


def location(value: Column) -> Column:
    """struct(path, line, column) of PATH:LINE:COLUMN, parted from the right; null if it is not one."""
    part = lambda i: F.regexp_extract(value, r"^(.+):(\d+):(\d+)$", i)
    return F.when(part(1) != "", F.struct(part(1).alias("path"), part(2).cast("long").alias("line"), part(3).cast("long").alias("column")))


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8_state(raw: Column, most: int = 1_048_576) -> Column:
    """document, oversized, binary or invalid_utf8 of a file's bytes."""
    hexed = F.hex(raw)
    zero = F.exists(F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1)), lambda b: b == "00")
    return F.when(F.octet_length(raw) > most, "oversized").when(zero, "binary").when(~F.is_valid_utf8(raw), "invalid_utf8").otherwise("document")
