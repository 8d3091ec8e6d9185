"""Personal data: pattern matches, and words that give them away by the company they keep.

Protected entities are e-mail and IP addresses, card and telephone numbers found by pattern, and secrets: long runs of letters and digits
that carry as much information a character as random ones. Removing an entity does not
help if the words beside it name it all the same, so corpus co-occurrence decides about those. Over all documents the
operator counts the documents with entity e, those with term t, and those with t in the context of e (``context``
words to either side). The disclosure of e by t is the share of t's documents in which it stands by e, together with
the pointwise mutual information log2 P(e | t) / P(e), its P(e | t) smoothed. No number of documents is asked for: an entity
of a single document is protected by the same thresholds. Terms over both thresholds are removed in the contexts of that
entity, or generalised where the share is below ``remove``; the same word elsewhere is left alone.

Counts are sums by key with partial sums on the map side. To count the documents of terms, only words that are terms of
some entity matter: while these are at most ``max_terms`` their 64-bit hashes go to the executors, beyond that every
word is counted and joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Store
from ._words import Chunk, pieces, signed, span_hashes, utf8

KINDS = ("email", "ip", "card", "phone")
#: Added by the method, after the pattern kinds: a term removed, a term generalised, a secret.
ADDED = ("term", "hint", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Started at the head of a run of digits only: a match from within the run exists only if there is one from its head.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"[A-Za-z0-9_+=]{20,}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Disclosure:
    """A term counts if it stands by the entity in ``share`` of its own documents, with ``bits`` of mutual information; from
    ``remove`` on it is removed, below generalised. For the mutual information each term has ``prior`` documents more, in which the
    entity stands at its rate in the corpus: a word seen once beside an entity of many documents says little of it."""

    context: int = 6
    prior: float = 1.0
    share: float = 0.5
    remove: float = 0.9
    bits: float = 3.0
    min_chars: int = 3
    max_terms: int = 1_000_000
    secret_digits: int = 4
    secret_bits: float = 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, domain. The local part is the run of its characters before an @, so only @ signs are visited."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secrets(text: str, known: list[tuple[str, int, int]], d: Disclosure) -> list[tuple[str, int, int]]:
    """Long runs with ``secret_digits`` digits and some letters whose characters have ``secret_bits`` bits of entropy each, outside known spans."""
    out = []
    for m in _SECRET.finditer(text):
        run = m[0]
        if sum(c.isdigit() for c in run) < d.secret_digits or not any(c.isalpha() for c in run) or any(a < m.end() and m.start() < b for _, a, b in known):
            continue
        share = np.unique(np.frombuffer(run.encode(), np.uint8), return_counts=True)[1] / len(run)
        if -(share * np.log2(share)).sum() >= d.secret_bits:
            out.append((ADDED[2], *m.span()))
    return out


def listed(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """One spelling for one entity: digits of numbers, lower case of addresses."""
    return f"{kind}:{re.sub('[^0-9]', '', value) if kind in ('card', 'phone') else value.lower()}"


def term(word: str) -> str:
    """A word without marks at its ends. Terms are lower-cased all at once, by the same mapping wherever they are counted."""
    return word.strip(_EDGE)


def contexts(text: str, spans: list[tuple[str, int, int]], d: Disclosure) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words beside each entity that are no part of any."""
    words = [m.span() for m in _WORD.finditer(text)]
    if not words:
        return []
    starts = np.array([a for a, _ in words])
    taken = np.zeros(len(words), bool)
    places = []
    for kind, a, b in spans:
        lo = int(np.searchsorted(starts, a, side="right")) - 1
        hi = int(np.searchsorted(starts, b - 1, side="right"))
        taken[lo:hi] = True
        places.append((entity(kind, text[a:b]), lo, hi))
    out = []
    for e, lo, hi in places:
        for i in [*range(max(0, lo - d.context), lo), *range(hi, min(len(words), hi + d.context))]:
            t = term(text[slice(*words[i])])
            if not taken[i] and len(t) >= d.min_chars:
                out.append((e, t, *words[i]))
    return out


def _found(d: Disclosure):
    pair = pa.list_(pa.struct([("e", pa.string()), ("t", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))
    span = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            data, off = utf8(piece.column(2))
            # only texts with a digit or an @ are looked into
            hint = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data == 0x40) | ((data >= 0x30) & (data <= 0x39)), out=hint[1:])
            some = hint[off[1:]] > hint[off[:-1]]
            spans: list[list] = [[] for _ in range(piece.num_rows)]
            hidden: list[list] = [[] for _ in range(piece.num_rows)]
            pairs: list[list] = [[] for _ in range(piece.num_rows)]
            for i in np.flatnonzero(some):
                text = data[off[i] : off[i + 1]].tobytes().decode()
                spans[i] = base_spans(text)
                hidden[i] = secrets(text, spans[i], d)
                if spans[i] or hidden[i]:
                    pairs[i] = contexts(text, spans[i] + hidden[i], d)
            low = iter(pc.utf8_lower(pa.array([p[1] for x in pairs for p in x], pa.string())).to_pylist())
            pairs = [[(e, next(low), a, b) for e, _, a, b in x] for x in pairs]
            count = [[sum(s[0] == k for s in x) for x in spans] for k in KINDS]
            sums = [hashlib.sha256(listed(x).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), *(pa.array(c, pa.int64()) for c in count), pa.array(sums, pa.string()), pa.array([len(x) for x in hidden], pa.int64()),
                 pa.array([[dict(zip(("kind", "a", "b"), s, strict=True)) for s in x + y] for x, y in zip(spans, hidden, strict=True)], span), pa.array([[dict(zip("etab", p, strict=True)) for p in x] for x in pairs], pair)],
                names=["row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "n_secret", "found", "pairs"],
            )

    return run, "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_secret long, found array<struct<kind:string,a:int,b:int>>, pairs array<struct<e:string,t:string,a:int,b:int>>"


def _term_hash(terms: pa.Array) -> np.ndarray:
    return Chunk(terms, np.zeros(256, bool)).word_hashes(0)


def _frequencies(wanted: np.ndarray | None):
    """Words of texts, as terms -> (hash, documents), summed within each piece of a partition."""
    edge = np.zeros(256, bool)
    edge[list(_EDGE.encode())] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            c = Chunk(pc.utf8_lower(pc.fill_null(piece.column(0), "")))
            if not len(c.starts):
                continue
            inner = np.flatnonzero(~c.gap & ~edge[c.data])
            lo, hi = np.searchsorted(inner, c.starts), np.searchsorted(inner, c.ends)
            keep = hi > lo
            a, b = inner[lo[keep]], inner[hi[keep] - 1] + 1
            h, doc = span_hashes(c.data, a, b), c.doc_of_word()[keep]
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                hit = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
                h, doc = h[hit], doc[hit]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            values, counts = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts.astype(np.int64))], names=["h", "n"])

    return run, "h long, n long"


def _hashed():
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(_term_hash(batch.column(0))))], names=["t", "h"])

    return run, "t string, h long"


def find(docs: DataFrame, d: Disclosure = Disclosure(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_secret, ``all_spans`` (kind, a, b: pattern matches and added
    terms, by start and then kind) and ``spans``, the same as text. Places are code points, ends exclusive.

    Null and empty texts hold nothing. Repeated rows each count as a document and each come back. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    store = Store(spark, "disclosure")
    run, schema = _found(d)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = store.put(rows.mapInArrow(run, schema), "found")
    pairs = found.select("row", F.explode("pairs").alias("p")).select("row", "p.*")
    together = pairs.select("e", "t", "row").distinct().groupBy("e", "t").agg(F.count("*").alias("n_et"))
    # a term stands by entities in no more documents than hold it, so a share too small by this count is too small by all
    beside = pairs.select("t", "row").distinct().groupBy("t").agg(F.count("*").alias("n_beside"))
    together = store.put(together, "together").join(store.put(beside, "beside"), "t").where(F.col("n_et") / F.col("n_beside") >= d.share)
    together = store.put(together.drop("n_beside"), "together")
    terms = store.put(together.select("t").distinct().mapInArrow(*_hashed()), "terms")
    n_terms = terms.count()
    added = None
    if n_terms:
        wanted = None
        if n_terms <= d.max_terms:
            # at most max_terms numbers
            wanted = np.sort(terms.select("h").distinct().toArrow().column("h").to_numpy().view(np.uint64))
        of_term = docs.select(F.col(text).alias("text")).mapInArrow(*_frequencies(wanted)).groupBy("h").agg(F.sum("n").alias("n_t"))
        of_entity = pairs.select("e", "row").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
        total = found.count()
        share = F.col("n_et") / F.col("n_t")
        rate = F.col("n_e") / F.lit(float(total))
        bits = F.log2((F.col("n_et") + d.prior * rate) / (F.col("n_t") + d.prior) / rate)
        # written first: joined tables whose sides are plain scans can be split where a term or an entity is very common
        of_term, of_entity = store.put(terms.join(of_term, "h").select("t", "n_t"), "terms"), store.put(of_entity, "entities")
        telling = together.join(of_term, "t").join(of_entity, "e").where((share >= d.share) & (bits >= d.bits))
        telling = store.put(telling.select("e", "t", F.when(share >= d.remove, ADDED[0]).otherwise(ADDED[1]).alias("kind")), "telling")
        added = pairs.join(telling, ["e", "t"]).groupBy("row").agg(F.collect_set(F.struct("kind", "a", "b")).alias("added"))
    none = F.array().cast("array<struct<kind:string,a:int,b:int>>")
    out = found.drop("pairs")
    out = out.join(added, "row", "left").withColumn("added", F.coalesce("added", none)) if added is not None else out.withColumn("added", none)
    # one span a place: a word that discloses two entities, or is both removed and generalised, is listed once, removed
    firm = F.filter("added", lambda s: s["kind"] == ADDED[0])
    soft = F.filter("added", lambda s: (s["kind"] == ADDED[1]) & ~F.exists(firm, lambda f: (f["a"] == s["a"]) & (f["b"] == s["b"])))
    order = F.array(*map(F.lit, (*KINDS, *ADDED)))
    ranked = F.array_sort(F.transform(F.concat("found", firm, soft), lambda s: F.struct(s["a"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["b"].alias("b"), s["kind"].alias("kind"))))
    out = out.withColumn("all_spans", F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("a"), s["b"].alias("b"))))
    text_of = F.array_join(F.transform("all_spans", lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "n_secret", "all_spans", text_of.alias("spans"))


def general(word: str) -> str:
    """What stands for a generalised word: its kind by its letters and digits. The more special kind comes first."""
    letters, digits = any(c.isalpha() for c in word), any(c.isdigit() for c in word)
    if digits:
        return "[CODE]" if letters else f"[NUMBER OF {sum(c.isdigit() for c in word)} DIGITS]"
    return "[NAME]" if word.strip(_EDGE)[:1].isupper() else "[WORD]"


def sanitise(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with pattern matches as [KIND], generalised terms as their ``general`` form and removed terms gone. Overlapping
    spans go as one, by the first of them."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "" if kind == "term" else general(text[a:b]) if kind == "hint" else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
