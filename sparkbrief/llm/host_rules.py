"""Quality rules judged by host, in DataFrame expressions only.

Each document is measured by a few rules. Failures are summed by host, each host's failure rate is drawn towards
the corpus by a beta prior fitted to all hosts by the method of moments. A host loses all its documents where its rate is surely too
high: where the posterior mean, less ``sure`` posterior standard deviations, is above ``max_rate``. A small host is
drawn to the corpus and widely spread, so a few failures do not condemn it.

Everything about one text is computed inside its row by array expressions. Repeated three-word windows are found
without leaving the row: a long holds the upper 34 bits of a window's hash and, below them, its position, so
sorting primitive longs brings equal windows together; the few that meet are then compared by full hash.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import Store

SPACES = r"[ \t-\r]+"
_POS = (1 << 30) - 1


@dataclass(frozen=True)
class HostRules:
    """``min_words`` and ``max_repeat`` (share of words in repeated windows) make a document fail. A host keeps its documents up to a
    failure rate of ``max_rate``, which by default means that most of them fail; ``sure`` standard deviations of certainty
    (1.645: 95 % of a normal distribution) are asked for before it loses them."""

    min_words: int = 50
    max_repeat: float = 0.5
    max_rate: float = 0.5
    sure: float = 1.645


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _covered(positions: Column, width: int = 3) -> Column:
    """Words covered by windows of ``width`` at sorted distinct positions."""
    steps = F.transform(positions, lambda p, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), p - F.get(positions, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def measure(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the text column replaced by n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Null counts as empty. Each step is a projection whose columns the next one reads more than once, which keeps
    the optimizer from writing it into the lambdas of the next, where it would run once an element.
    """
    names = [c for c in docs.columns if c != text]
    keep, c = [F.col(f"`{n}`") for n in names], F.col
    place = lambda x: x.bitwiseAND(F.lit(_POS)).cast("int")
    full = lambda x, i: F.xxhash64(x, F.get(c("_h"), i + 1), F.get(c("_h"), i + 2))
    agree = lambda x, y: F.shiftright(x.bitwiseXOR(y), 30) == 0
    sums = [c(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines")]

    d = docs.select(*keep, F.coalesce(c(f"`{text}`"), F.lit("")).alias("_t"))
    d = d.select(*keep, "_t", words(c("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l"))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # a long for each window: 34 bits of its hash, then its position; equal windows become neighbours
    packed = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda x, i: full(x, i).bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long")))
    d = d.select(*keep, *sums, "_h", F.sort_array(packed).alias("_k"))
    d = d.select(*keep, *sums, "_h", "_k", F.filter("_k", lambda x, i: agree(x, F.get(c("_k"), i + 1))).alias("_f"))
    second = F.filter("_k", lambda x, i: agree(x, F.get(c("_k"), i - 1)))
    d = d.select(*keep, *sums, "_h", F.when(F.size("_f") == 0, c("_f")).otherwise(F.array_union("_f", second)).alias("_c"))
    # the few that agree in 34 bits are told apart by the whole hash
    d = d.select(*keep, *sums, F.array_sort(F.transform("_c", lambda x: F.struct(full(F.get(c("_h"), place(x)), place(x)).alias("h"), place(x).alias("p")))).alias("_s"))
    same = lambda x, j: F.coalesce(x["h"] == F.get(c("_s"), j)["h"], F.lit(False))
    d = d.select(*keep, *sums, F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i + 1) | same(x, i - 1)), lambda x: x["p"])).alias("_p"))
    return d.select(*keep, *sums, F.when(F.size("_p") == 0, F.lit(0).cast("long")).otherwise(_covered(c("_p"))).alias("n_repeat_words"))


def judge(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, host, the measures, ``base_failed``, the host's ``host_docs``, ``host_failed``,
    ``host_rate`` (shrunk: the posterior mean) and ``host_least`` (what it surely exceeds), and ``kept``.

    A null host is a host of its own. Null and empty texts have no words and fail. Repeated rows each count and each
    come back. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    store = Store(docs.sparkSession, "host-rules")
    rows = measure(docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text")), "_text")
    # the share as it is written, in exact integers, so that its edge is not moved by rounding
    part, of = Fraction(str(rules.max_repeat)).as_integer_ratio()
    rows = rows.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (of * F.col("n_repeat_words") > part * F.col("n_words")))
    # texts are read once: the measures are small and are written, since they are used for the sums and for the verdicts
    rows = store.put(rows, "measures")
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    prior = fit_beta(hosts, "host_failed", "host_docs")
    # the prior is one row
    n, rate = F.col("host_docs") + F.col("alpha") + F.col("beta"), F.col("host_rate")
    hosts = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("host_failed") + F.col("alpha")) / n)
    hosts = hosts.withColumn("host_least", rate - rules.sure * F.sqrt(rate * (1 - rate) / (n + 1)))
    joined = rows.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")), "left")
    bad = F.col("host_least") > rules.max_rate
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(bad, F.lit(False))).drop("h", "alpha", "beta")


def fit_beta(groups: DataFrame, failed: str, total: str, least: float = 1.0, most: float = 1e6) -> DataFrame:
    """One row (alpha, beta): the beta distribution whose mean and variance are those of the groups' rates.

    Mean and variance are over groups, weighted alike. Where the variance leaves no proper beta (one group, all
    rates equal, or spread as wide as 0 and 1 only) the strength alpha + beta is held within [least, most].
    """
    rate = F.col(failed) / F.col(total)
    m, v = F.col("m"), F.col("v")
    strength = F.least(F.lit(most), F.greatest(F.lit(least), F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(most))))
    one = groups.agg(F.coalesce(F.avg(rate), F.lit(0.5)).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    return one.select((m * strength).alias("alpha"), ((1 - m) * strength).alias("beta"))
