"""The log model and the parameters of the operators.

A log is a table of blocks, one row a content block of an entry:

``session_id, seq, block_ix, entry_id, parent_id, kind, role, ts, type, text, call_id, tool_name, arguments, is_error,
first_kept_id, summary``

``seq`` orders the entries of a session, ``kind`` is message, compaction or another record that only links the tree, ``type``
is text, thinking, toolCall, toolResult, image or other. ``arguments`` is JSON text.
"""

from __future__ import annotations

from dataclasses import dataclass

BLOCKS = (
    "session_id string, seq bigint, block_ix int, entry_id string, parent_id string, kind string, role string, ts bigint, type string, "
    "text string, call_id string, tool_name string, arguments string, is_error boolean, first_kept_id string, summary string"
)
COLUMNS = [c.split()[0] for c in BLOCKS.split(", ")]

SECTIONS = ("goal", "files_modified", "files_created", "files_read", "commits", "key_facts", "outstanding", "preferences")


@dataclass(frozen=True)
class Recall:
    query: str
    regex: bool = False
    role: str | None = None
    tool_name: str | None = None
    after_entry: str | None = None
    before_entry: str | None = None
    page: int = 1
    per_page: int = 5
    snippet_bytes: int = 1000
    max_output_bytes: int = 12_000

    def __post_init__(self) -> None:
        if not self.query.strip() or len(self.query) > 512:
            raise ValueError("query must be 1..512 characters")
        if not 1 <= self.per_page <= 20 or not 1 <= self.page <= 1_000_000:
            raise ValueError("page and per_page must be within valid bounds")
        if not 128 <= self.snippet_bytes <= 4000 or not 1024 <= self.max_output_bytes <= 32_000:
            raise ValueError("snippet_bytes or max_output_bytes out of bounds")
        if self.role is not None and self.role not in ("user", "assistant", "toolResult"):
            raise ValueError("invalid role")
        for value in (self.tool_name, self.after_entry, self.before_entry):
            if value is not None and not 1 <= len(value) <= 512:
                raise ValueError("invalid recall filter")


@dataclass(frozen=True)
class Compact:
    """``keep``: user turns kept; None with ``smart`` lets the tail grow. Tail budgets are in tokens."""

    keep: int | None = None
    smart: bool = True
    chars_per_token: float = 3.8
    min_tail: int = 5_000
    max_tail: int = 25_000
    oversized: int = 2


@dataclass(frozen=True)
class Transcript:
    max_lines: int = 120
    line_bytes: int = 220
    result_bytes: int = 160


@dataclass(frozen=True)
class Frames:
    """``cols`` 0: as wide as the text asks for."""

    cols: int = 0
    rows: int = 120
    head: int = 600
    tail: int = 400
    scale: int = 1
    tokens_per_frame: int | None = None
    chars_per_token: float = 3.8
    min_bytes: int = 6_000


@dataclass(frozen=True)
class Settings:
    """What a host may set. ``parse`` takes any JSON value: unknown names and values of other types are left as they are by default."""

    policy: str = "auto"
    override: bool = True
    smart: bool = True
    keep: int | None = None
    frames: bool = True
    min_chars: int = 6_000
    placement: str = "nextUser"
    tokens_per_frame: float | None = None
    providers: tuple[str, ...] = ()
    snapshots: bool = True
    debug: bool = False

    @classmethod
    def parse(cls, raw: object) -> Settings:
        top = raw if isinstance(raw, dict) else {}
        inner = lambda name: top.get(name) if isinstance(top.get(name), dict) else {}
        frames, snapshots = inner("snap"), inner("snapshot")
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf")
        flag = lambda v: isinstance(v, bool)
        asked = (
            ("policy", top, "policy", lambda v: v in ("auto", "vcc", "snap"), str),
            ("override", top, "overrideDefaultCompaction", flag, bool),
            ("smart", top, "smartKeepTail", flag, bool),
            ("keep", top, "keepUserTurns", lambda v: v is None or number(v), lambda v: None if v is None else max(0, int(v // 1))),
            ("frames", frames, "enabled", flag, bool),
            ("min_chars", frames, "minChars", number, lambda v: max(0, v)),
            ("placement", frames, "placement", lambda v: v in ("nextUser", "inline"), str),
            ("tokens_per_frame", frames, "imageTokensPerFrame", lambda v: v is None or number(v), lambda v: v),
            ("providers", frames, "providers", lambda v: isinstance(v, list), lambda v: tuple(x for x in v if isinstance(x, str))),
            ("snapshots", snapshots, "enabled", flag, bool),
            ("debug", top, "debug", flag, bool),
        )
        return cls(**{name: made(of[key]) for name, of, key, fits, made in asked if key in of and fits(of[key])})
