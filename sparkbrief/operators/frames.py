"""Bulky text as picture frames: routing, economics, layout and rasterization.

Width, frame counts and token costs are expressions. Only blocks routed to frames are laid out and drawn, each distinct text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import frame_tokens, lines, tokens, truncate_bytes, utrim_end, utrim_start
from ..functions.udfs import content_class, png
from ..schema import Frames

#: Fixed gray levels of a frame.
INK, PAPER = 230, 16


def adaptive_cols(text: Column) -> Column:
    """The ninth decile of line lengths in characters, up to a multiple of 8, and 8 more; 40 to 200, 80 without lines."""
    lens = F.array_sort(F.transform(lines(text), F.char_length))
    wide = F.element_at(lens, (F.floor(F.size(lens) * 9 / 10) + 1).cast("int"))
    return F.when(F.size(lens) == 0, 80).otherwise(F.greatest(F.lit(40), F.least(F.lit(200), F.ceil(wide / 8) * 8 + 8))).cast("int")


def frame_count(text: Column, cols: Column, rows: int) -> Column:
    """Lines wrapped at ``cols`` characters, over the rows of a frame less its header; at least one."""
    wrapped = F.aggregate(F.transform(lines(text), lambda x: F.greatest(F.lit(1), F.ceil(F.char_length(x) / cols)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.greatest(F.lit(1).cast("long"), F.ceil(wrapped / max(rows - 1, 1)).cast("long"))


def economics(rows: DataFrame, f: Frames = Frames(), text: str = "text") -> DataFrame:
    """``rows`` with cols, frames, frame_tokens_each, snap_tokens, text_tokens and worthwhile (a quarter is saved)."""
    d = rows.withColumn("cols", F.lit(f.cols) if f.cols else adaptive_cols(F.col(text)))
    d = d.withColumn("frames", frame_count(F.col(text), F.col("cols"), f.rows))
    d = d.withColumn("frame_tokens_each", frame_tokens(F.col("cols") * 8 + 8, F.lit(f.rows * 8 + 8), f.tokens_per_frame))
    d = d.withColumn("snap_tokens", F.col("frames") * F.col("frame_tokens_each")).withColumn("text_tokens", tokens(F.octet_length(text), f.chars_per_token))
    return d.withColumn("worthwhile", F.col("snap_tokens") * 4 <= F.col("text_tokens") * 3)


def route(rows: DataFrame, f: Frames = Frames(), policy: str = "auto", vision: bool = True, text: str = "text") -> DataFrame:
    """Economics with ``class`` and ``decision``: snap, no_gain, json, empty, engine_off or short."""
    if policy not in ("auto", "snap", "vcc"):
        raise ValueError(f"unknown policy: {policy}")
    on = vision and policy != "vcc"
    d = economics(rows, f, text).withColumn("class", content_class(F.col(text)))
    long = F.octet_length(text) >= f.min_bytes
    return d.withColumn("decision", F.when(F.col("class").isin("json", "empty"), F.col("class")).when(F.lit(not on), "engine_off").when(~F.coalesce(long, F.lit(False)), "short").when(F.col("worthwhile"), "snap").otherwise("no_gain"))


def head_of(text: Column, f: Frames) -> Column:
    return F.concat(utrim_end(truncate_bytes(text, f.head)), F.lit("\n")) if f.head else F.lit("")


def tail_of(text: Column, f: Frames) -> Column:
    """The last bytes of a text of which something is left out, from a character's first byte."""
    raw = text.cast("binary")
    # one to three bytes more if the cut would part a character
    tries = [F.try_validate_utf8(F.substring(raw, -(f.tail + k), f.tail + k).cast("string")) for k in range(4)]
    return F.when((F.octet_length(text) > f.head + f.tail) & F.lit(f.tail > 0), F.concat(F.lit("\n"), utrim_start(F.coalesce(*tries)))).otherwise("")


def transform(rows: DataFrame, f: Frames = Frames(), policy: str = "auto", vision: bool = True, text: str = "text") -> DataFrame:
    """Routed rows with tokens_before and tokens_after: frames and the text kept at both ends, or the text itself."""
    d = route(rows, f, policy, vision, text)
    kept = F.octet_length(head_of(F.col(text), f)) + F.octet_length(tail_of(F.col(text), f))
    after = F.when(F.col("decision") == "snap", F.col("snap_tokens") + tokens(kept, f.chars_per_token)).otherwise(F.col("text_tokens"))
    return d.withColumn("tokens_before", F.col("text_tokens")).withColumn("tokens_after", after)


def _floor(raw: bytes, i: int) -> int:
    i = min(i, len(raw))
    while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
        i -= 1
    return i


def layout(text: str, cols: int, rows: int) -> list[list[str]]:
    """Pages of ``rows`` lines of at most ``cols`` bytes; a character is never parted and each piece has one at least."""
    pages: list[list[str]] = [[]]
    body = text.replace("\r\n", "\n")
    body = body[:-1] if body.endswith("\n") else body
    for line in body.split("\n") if text else []:
        raw = line.encode()
        while True:
            cut = _floor(raw, cols) if len(raw) > cols else len(raw)
            if not cut and raw:
                cut = next((i for i in range(1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
            if len(pages[-1]) == rows:
                pages.append([])
            pages[-1].append(raw[:cut].decode())
            raw = raw[cut:]
            if not raw:
                break
    return pages if pages[0] else [[""]]


@lru_cache(maxsize=4096)
def _glyph(c: str) -> np.ndarray:
    """A pattern of 7 by 5 cells for a character, made from its code: frames have a fixed geometry, not a font."""
    if c.isspace():
        return np.zeros((7, 5), np.uint8)
    x = (ord(c) * 0x9E3779B1) & 0xFFFFFFFF
    x ^= x >> 15
    bits = ((x * 0x85EBCA77) ^ (x << 7)) & ((1 << 35) - 1) | 1
    return np.array([bits >> i & 1 for i in range(35)], np.uint8).reshape(7, 5)


def draw(text: str, cols: int, rows: int, scale: int = 1) -> tuple[int, int, bytes]:
    """(width, height, PNG) of a grid of cells of 8 by 8 dots with a margin of 4."""
    scale = max(1, scale)
    dots = np.zeros((rows * 8 + 8, cols * 8 + 8), np.uint8)
    for y, line in enumerate(text.split("\n")[:rows]):
        for x, c in enumerate(line[:cols]):
            dots[4 + y * 8 : 11 + y * 8, 4 + x * 8 : 9 + x * 8] = _glyph(c)
    gray = np.where(dots, np.uint8(INK), np.uint8(PAPER)).repeat(scale, 0).repeat(scale, 1)
    height, width = gray.shape
    return width, height, png(width, height, gray.tobytes())


def frame_pages(text: str, label: str, cols: int, f: Frames) -> list[tuple[str, str]]:
    """(header, body) of each frame of the middle of a text."""
    raw = text.encode()
    start = min(f.head, len(raw))
    stop = max(start, len(raw) - f.tail)
    pages = layout(raw[_floor(raw, start) : _floor(raw, stop)].decode(), cols, max(1, f.rows - 1))
    return [(f"── archived frame {i + 1}/{len(pages)} · {label} · archived text, verbatim ──", "".join(x + "\n" for x in p)) for i, p in enumerate(pages)]


def render(rows: DataFrame, f: Frames = Frames(), text: str = "text", label: str = "label", pictures: bool = True) -> DataFrame:
    """(key, frame_no, frames, width, height, lines, chars, png) of each distinct text; key is the start of its SHA-256 with the label."""
    key = F.substring(F.sha2(F.concat_ws("\0", F.col(label), F.col(text)), 256), 1, 32)
    d = rows.select(key.alias("key"), F.col(label).alias("label"), F.col(text).alias("text"), (F.lit(f.cols) if f.cols else adaptive_cols(F.col(text))).alias("cols")).where("text is not null").dropDuplicates(["key"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, name, body, cols in part.itertuples(index=False):
                out = []
                pages = frame_pages(body, name or "", cols, f)
                for i, (head, page) in enumerate(pages):
                    whole = head + "\n" + page
                    w, h, dots = draw(whole, cols, f.rows, f.scale) if pictures else (cols * 8 * f.scale + 8 * f.scale, f.rows * 8 * f.scale + 8 * f.scale, None)
                    out.append((k, i + 1, len(pages), w, h, page.count("\n"), len(whole.encode()), dots))
                yield pd.DataFrame(out, columns=["key", "frame_no", "frames", "width", "height", "lines", "chars", "png"])

    return d.mapInPandas(run, "key string, frame_no int, frames int, width int, height int, lines int, chars int, png binary")


def placements(blocks: DataFrame) -> DataFrame:
    """(session_id, seq, target): for each tool result the next user message after it, else the nearest before; null without one."""
    from pyspark.sql.window import Window

    e = blocks.where("kind = 'message'").groupBy("session_id", "seq").agg(F.first("role").alias("role"))
    here = Window.partitionBy("session_id").orderBy("seq")
    user = F.when(F.col("role") == "user", F.col("seq"))
    after = F.first(user, ignorenulls=True).over(here.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(user, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    return e.withColumn("target", F.coalesce(after, before)).where("role = 'toolResult'").select("session_id", "seq", "target")


def candidates(blocks: DataFrame, min_bytes: int, retrieval_tools: tuple[str, ...] = ("recall",)) -> DataFrame:
    """Tool results of at least that size, at or before the session's last assistant message, that are no retrieval's own."""
    last = blocks.where("role = 'assistant'").groupBy("session_id").agg(F.max("seq").alias("last"))
    d = blocks.where("kind = 'message' and role = 'toolResult'").where(F.octet_length("text") >= min_bytes).where(~F.coalesce("tool_name", F.lit("")).isin(*retrieval_tools))
    return d.join(last, "session_id").where("seq <= last").select("session_id", "seq", "block_ix", "text")


def distinct_texts(blocks: DataFrame, text: str = "text") -> DataFrame:
    """(key, n, bytes): each distinct text once, by the start of its SHA-256, with how many blocks hold it."""
    d = blocks.where(F.col(text).isNotNull()).select(F.substring(F.sha2(F.col(text), 256), 1, 32).alias("key"), F.octet_length(text).alias("bytes"))
    return d.groupBy("key").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
