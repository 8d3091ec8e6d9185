"""Text expressions. Lengths and limits are UTF-8 bytes, cut at character boundaries; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"


def utrim(c: Column) -> Column:
    """Without the Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def utrim_end(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def space_trim_end(c: Column) -> Column:
    """Without the spaces (Unicode category Zs) at the end, as SQL's rtrim: tabs and line ends stay."""
    return F.regexp_replace(c, r"\p{Zs}+\z", "")


def utrim_start(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+", "")


def lines(c: Column) -> Column:
    """Lines end at a newline, which may follow a carriage return; no line after a last newline, none in an empty text."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n", -1)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).when(c.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def truncate_bytes(c: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most ``most`` bytes."""
    raw = c.cast("binary")
    tries = [F.try_validate_utf8(F.substring(raw, 1, n).cast("string")) for n in range(most, max(most - 4, -1), -1)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*tries, F.lit("")))


def truncate_ellipsis(c: Column, most: int) -> Column:
    """As above with an ellipsis, which takes three of the bytes; below three bytes nothing is left."""
    cut = F.concat(truncate_bytes(c, most - 3), F.lit(ELLIPSIS)) if most >= 3 else F.lit("")
    return F.when(F.octet_length(c) <= most, c).otherwise(cut)


def collapse(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends: the key by which items count as equal."""
    return F.regexp_replace(utrim(F.lower(c)), r"(?U)\s+", " ")


def occurrences(c: Column, term: str) -> Column:
    """How often ``term`` occurs without overlap."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(term), F.lit("")))) / len(term.encode())).cast("long")


def tokens(size: Column, chars_per_token: float = 3.8) -> Column:
    """Whole tokens of that many bytes."""
    return F.floor(size / F.lit(max(chars_per_token, 0.5))).cast("long")


def calibrate(size: Column, measured: Column) -> Column:
    """Bytes a token: as measured where that is plausible, else 3.8."""
    ratio = F.try_divide(size, measured)
    return F.when((measured > 200) & (size > 1000) & (ratio >= 2.0) & (ratio <= 8.0), ratio).otherwise(F.lit(3.8))


def frame_tokens(width: Column, height: Column, override: int | None = None) -> Column:
    return F.lit(override).cast("long") if override is not None else F.greatest(F.floor(width * height / 750).cast("long"), F.lit(70).cast("long"))


def role_name(c: Column) -> Column:
    """One name for each role; unknown ones are ``other``."""
    return F.when(c.isin("tool_result", "tool", "toolResult"), "toolResult").when(c.isin("user", "assistant", "system", "custom"), c).otherwise("other")


def argument(arguments: Column, *names: str) -> Column:
    """The first of the named string arguments that is present."""
    return F.coalesce(*(F.get_json_object(arguments, f"$.{n}") for n in names))


def short_path(c: Column) -> Column:
    """What follows the first ``/dev/``; else, of a path below ``/Users/``, what follows the user's folder."""
    dev = F.instr(c, "/dev/")
    rest = F.regexp_extract(c, r"(?s)\A/Users/[^/]*/(.*)\z", 1)
    return F.when(dev > 0, F.substr(c, dev + 5)).when(c.rlike(r"(?s)\A/Users/[^/]*/"), rest).otherwise(c)


def block_size(d: str = "") -> Column:
    """Bytes that a block counts for: its text, or a call's arguments."""
    c = lambda n: F.col(f"{d}{n}")
    return F.when(c("type") == "toolCall", F.octet_length(F.coalesce(c("arguments"), F.lit("null")))).when(c("type").isin("text", "thinking", "toolResult"), F.octet_length(F.coalesce(c("text"), F.lit("")))).otherwise(0).cast("long")


def searchable(d: str = "") -> Column:
    """The text of a block as recall searches it; null for blocks without."""
    c = lambda n: F.col(f"{d}{n}")
    name = F.coalesce(c("tool_name"), F.lit(""))
    return (
        F.when(c("type").isin("text", "thinking"), F.coalesce(c("text"), F.lit("")))
        .when(c("type") == "toolResult", F.when(name == "", c("text")).otherwise(F.concat(F.lit("["), name, F.lit("] "), F.coalesce(c("text"), F.lit("")))))
        .when(c("type") == "toolCall", F.concat(F.lit("[call "), name, F.lit("] "), F.coalesce(c("arguments"), F.lit("null"))))
    )
