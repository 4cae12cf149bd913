"""Mixing sources to target weights by temperature.

Source token shares p are exponentiated, w = p**alpha / sum(p**alpha). Entropy of w
falls with alpha and so does the repetition of small sources, so one bisection finds
the largest alpha in [0, 1] that reaches the target entropy, another the least that
keeps within the repetition limit; the limit wins. A budget of tokens is then dealt
by weight: a source's documents lie in blocks by a keyed hash, each block is a keyed
permutation, whole passes give every document once and the rest of the budget takes
from each block's permutation its proportional share. Blocks hold a bounded number
of tokens and of documents (a document counts as its tokens and one more), so a hot
source, wordless documents too, is many blocks and no window grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unused

BLOCK_TOKENS, STEPS = 1 << 20, 80
#: So many sources may come to the driver and be broadcast.
MOST_SOURCES = 10_000
DELIMITERS = "[\\x20\\x09-\\x0D]+"


def token_count(text: str = "text") -> F.Column:
    """Words of a text, by separators; null has none."""
    t = F.col(text)
    edge = F.substring(t, 1, 1).rlike(DELIMITERS).cast("long") + F.substring(t, -1, 1).rlike(DELIMITERS).cast("long")
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.size(F.split(t, DELIMITERS, -1)) - edge).cast("long")


def weights(shares: list[float], alpha: float) -> list[float]:
    up = [p**alpha if p > 0 else 0.0 for p in shares]
    return [x / sum(up) for x in up]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def bisect(good: Callable[[float], bool], low: float = 0.0, high: float = 1.0) -> float:
    """The largest alpha for which good holds, if good holds below it; low if it never does."""
    if good(high):
        return high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if good(mid) else (low, mid)
    return low


def temperature(tokens: list[int], budget: int, target_entropy: float | None, most_repeats: float | None) -> float:
    """alpha for sources of so many tokens; target_entropy is a share of the greatest possible."""
    total = sum(tokens)
    shares = [t / total for t in tokens if t > 0]
    spread, repeats = lambda a: entropy(weights(shares, a)), lambda a: max(w / p for w, p in zip(weights(shares, a), shares, strict=True))
    return _temperature(spread, repeats, len(shares), budget / total, target_entropy, most_repeats)


def _temperature(spread: Callable[[float], float], repeats: Callable[[float], float], n: int, budget: float, target_entropy: float | None, most_repeats: float | None) -> float:
    """The search itself: spread and repeats are the entropy of the weights and the most that they raise a share; budget is in whole passes."""
    alpha = 1.0
    if target_entropy is not None and n > 1:
        alpha = bisect(lambda a: spread(a) >= target_entropy * math.log(n))
    if most_repeats is not None:
        over = lambda a: repeats(a) * budget > most_repeats
        if over(alpha):
            alpha = 1.0 if over(1.0) else bisect(lambda a: over(a), alpha, 1.0)
            alpha = min(1.0, alpha + 2.0**-40) if over(alpha) else alpha
    return alpha


class Shares:
    """Source shares in a table: the same sums as over a list, one small aggregation each, for sources too many for the driver."""

    def __init__(self, sums: DataFrame, total: int):
        self.p = sums.where("n > 0").select((F.col("n") / F.lit(float(total))).alias("p"))

    def entropy(self, alpha: float) -> float:
        up = F.pow("p", F.lit(alpha))
        z, s = self.p.agg(F.sum(up), F.sum(up * F.log(up))).first()
        return math.log(z) - s / z

    def repeats(self, alpha: float) -> float:
        up = F.pow("p", F.lit(alpha))
        most, z = self.p.agg(F.max(up / F.col("p")), F.sum(up)).first()
        return most / z

    def count(self) -> int:
        return self.p.count()


def plan(docs: DataFrame, target_entropy: float | None = 0.97, most_repeats: float | None = 4.0, budget: int | None = None, seed: str = "mix", block_tokens: int = BLOCK_TOKENS, most_sources: int = MOST_SOURCES) -> DataFrame:
    """(doc_id, source, n_tokens, copies, block, place, weight): how often each document is taken.

    place orders a block's permutation. The budget is all tokens unless given. A null source is a
    source of its own, written as null; documents without words have no tokens to budget and are
    taken once in each whole pass and as their permutation comes. Repeated rows and rows without
    doc_id are rows like others. No rows, no plan. Up to most_sources sources the shares come to the driver and the weights are
    broadcast; beyond that they stay in a table, which the search asks for its sums.
    """
    spark = docs.sparkSession
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), token_count().alias("n_tokens")), "mix")
    sums = stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m")), "sources")
    few = sorted((tuple(r) for r in sums.limit(most_sources + 1).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    total = sums.agg(F.sum("n")).first()[0] or 0
    budget = total if budget is None else budget
    if len(few) <= most_sources:
        if total:
            w = weights([n / total for _, n, _ in few], temperature([n for _, n, _ in few], budget, target_entropy, most_repeats))
        else:
            w = [0.0 for _ in few]
        dim = spark.createDataFrame([(s, n, m, x) for (s, n, m), x in zip(few, w, strict=True)], "source string, n long, m long, weight double")
    else:
        shares = Shares(sums, max(total, 1))
        alpha = _temperature(shares.entropy, shares.repeats, shares.count(), budget / total, target_entropy, most_repeats) if total else 1.0
        up = F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(alpha))).otherwise(0.0)
        whole = sums.agg(F.sum(up)).first()[0] or 1.0
        dim = sums.withColumn("weight", up / F.lit(whole))
    blocks = F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("m")) / F.lit(block_tokens))).cast("int")
    dim = dim.select(F.col("source").alias("s"), "weight", F.when(F.col("n") > 0, F.col("weight") * budget / F.col("n")).otherwise(1.0).alias("passes"), blocks.alias("n_blocks"))
    dim = F.broadcast(dim) if len(few) <= most_sources else dim
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))).alias("key")
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("key", key).join(dim, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", (number % F.col("n_blocks")).cast("int"))
    of = Window.partitionBy("source", "block")
    order = of.orderBy("key", "doc_id", "n_tokens")
    rows = rows.withColumns({"before": F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), "in_block": F.sum("n_tokens").over(of), "place": F.row_number().over(order)})
    part = F.col("passes") - F.floor("passes")
    taken = F.coalesce("before", F.lit(0)) + F.col("n_tokens") / 2 < part * F.col("in_block")
    return rows.select("doc_id", "source", "n_tokens", (F.floor("passes") + taken.cast("long")).cast("long").alias("copies"), "block", "place", "weight")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: rows of docs with all their columns, as often as the plan takes them.

    Rows of one doc_id are all taken as often as the one of them that is taken most. Rows without doc_id are
    matched with the plan's by source and number of tokens, in the order of their texts.
    """
    times, count, turn = (unused(docs.columns, c) for c in ("_copies", "_tokens", "_pass"))
    planned = stage(plan(docs, **options), "planned")
    chosen = planned.where("copies > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias(times))
    out = docs.join(chosen.hint("merge"), "doc_id").select(*docs.columns, times)  # a row for each document: no side to broadcast at any size
    place = lambda df, n, by: df.withColumn(turn, F.row_number().over(Window.partitionBy("source", n).orderBy(*by)))
    rest = place(docs.where("doc_id IS NULL").withColumn(count, token_count()), count, ["text"]).alias("d")
    theirs = place(planned.where("doc_id IS NULL"), "n_tokens", ["block", "place"]).alias("p")
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col(f"d.{count}") == F.col("p.n_tokens")) & (F.col(f"d.{turn}") == F.col(f"p.{turn}"))
    rest = rest.join(theirs, same).where("p.copies > 0").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("p.copies").alias(times))
    out = out.unionAll(rest).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return out.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "source", "n_tokens", "copies", "block", "place", F.round("weight", 9).alias("weight"))
