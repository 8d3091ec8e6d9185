"""Functions on text that the JVM's cannot express: all vectorized over Arrow, used on few rows or behind a cheap test."""

from __future__ import annotations

import json
import math
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELLIPSIS = "…"


def _floor(raw: bytes, i: int) -> int:
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i


def _cut(raw: bytes, most: int) -> bytes:
    if len(raw) <= most:
        return raw
    return b"" if most < 3 else raw[: _floor(raw, most - 3)] + ELLIPSIS.encode()


def snippet_of(text: str, pos: int, most: int, folded: bool) -> str:
    """``most`` bytes around the match at character ``pos`` (from 0) of the text, or of its lower-cased form if ``folded``."""
    if folded:
        at = 0
        for i, c in enumerate(text):
            at += len(c.lower())
            if pos < at:
                pos = i
                break
        else:
            pos = len(text)
    raw = text.encode()
    start = _floor(raw, max(0, len(text[:pos].encode()) - most // 4))
    lead = ELLIPSIS.encode() if start else b""
    return (lead + _cut(raw[start:], most - len(lead))).decode()


@F.pandas_udf(T.StringType())
def snippet(text: pd.Series, pos: pd.Series, most: pd.Series, folded: pd.Series) -> pd.Series:
    """``pos`` counts from 1, as the search functions do; 0 or null is the start."""
    return pd.Series([None if t is None else snippet_of(t, 0 if p is None or math.isnan(p) else max(0, int(p) - 1), int(m), bool(f)) for t, p, m, f in zip(text, pos, most, folded, strict=True)])


def shrink(page: str, budget: int) -> list[str]:
    """The snippets of a page (JSON with ``hits``), all cut by a quarter again and again until it has at most ``budget`` bytes as compact JSON."""
    whole = json.loads(page)
    while len(json.dumps(whole, ensure_ascii=False, separators=(",", ":")).encode()) > budget:
        if not any(h["snippet"] for h in whole["hits"]):
            raise ValueError("max_output_bytes too small for result metadata")
        for h in whole["hits"]:
            raw = (h["snippet"] or "").encode()
            h["snippet"] = _cut(raw, len(raw) * 3 // 4).decode()
    return [h["snippet"] for h in whole["hits"]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def shrunk(page: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else shrink(p, int(b)) for p, b in zip(page, budget, strict=True)])


@F.pandas_udf(T.DoubleType())
def ln(x: pd.Series) -> pd.Series:
    """Natural logarithm as the C library rounds it, of positive numbers. The JVM's differs in the last bit of some, as may NumPy's, and
    with it the order of scores that are equal but for rounding."""
    return x.astype("float64").map(math.log)


def classify(text: str | None) -> str:
    """empty, json or text: JSON only if the whole text is one object or array."""
    t = (text or "").strip()
    if not t:
        return "empty"
    if t[0] in "{[":

        def refuse(x: str) -> None:
            raise ValueError(x)

        try:
            json.loads(t, parse_constant=refuse)
            return "json"
        except (ValueError, RecursionError):
            pass
    return "text"


@F.pandas_udf(T.StringType())
def classify_json(text: pd.Series) -> pd.Series:
    return text.map(classify)


def content_class(c):
    """The class of a text; only what starts like JSON is parsed."""
    first = F.substr(F.regexp_replace(c, r"(?U)\A\s+", ""), F.lit(1), F.lit(1))
    return F.when(F.coalesce(first, F.lit("")) == "", "empty").when(first.isin("{", "["), classify_json(c)).otherwise("text")


def quoted(text: str) -> str:
    """The text in double quotes, escaped as a debugger would show it."""
    names = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return '"' + "".join(names.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in text) + '"'


@F.pandas_udf(T.StringType())
def debug_quote(text: pd.Series) -> pd.Series:
    return text.map(quoted, na_action="ignore")


def compact_json(text: str) -> str:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    except ValueError:
        return text


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no blanks; what is no JSON stays."""
    return text.map(compact_json, na_action="ignore")


def png(width: int, height: int, gray: bytes) -> bytes:
    """An 8-bit gray picture, always encoded the same way."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + gray[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")
