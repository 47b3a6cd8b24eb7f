"""Mixing sources to target weights: temperature weights realised as budgeted block permutations.

A source with share p of the tokens gets a weight in proportion to p ** exponent. The exponent, from
1 (in proportion) towards 0 (equal), is bisected to meet a target entropy of the weights, or to stay
within a limit on how often a source may be repeated. Each source's texts are dealt to blocks by a
hash of their key. An epoch of a source is a permutation of its blocks by a hash of epoch and
block; a source is read for as many whole epochs as its budget pays, then for the first blocks of
one more epoch that the rest pays. Token counts of sources and of blocks are sums that are
pre-aggregated; no step needs all rows of a source in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.common import cut

#: Blocks of a source; the budget is met within one of them.
BLOCKS = 4096
#: Epochs of the largest-repeated source at most, without another target.
MAX_REPEATS = 2.0
#: Sources up to which their plan is broadcast; beyond, an equi-join over as many salts.
FEW_SOURCES, SALTS = 10_000, 64
WORD = r"[^ \t-\r]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponent(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, rounds: int = 6, ways: int = 32) -> float:
    """The exponent of the weights of (source, tokens) rows.

    With a target entropy (in nats), that at which the weights have it, or 0 or 1 if it is out of
    reach. With a limit on repeats, the smallest at which no source is repeated more often, given
    the budget in tokens, or one epoch of the largest source. With both, the larger. Sources
    without tokens are ignored. The interval is cut ``ways``-fold ``rounds`` times, each time by
    one aggregation over the sources, of which only a number for each cut comes back.
    """
    rows = sources.where("tokens > 0")
    t = rows.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not t[3] or t[3] == 1:
        return 1.0
    total, least, most = float(t[0]), t[1] / t[0], t[2] / t[0]
    p = F.col("tokens") / total

    def over(a: float, s0: float, s1: float) -> dict[str, bool]:
        """Whether the exponent is too small for each target."""
        found = {}
        if entropy is not None:
            found["entropy"] = math.log(s0) - a * s1 / s0 > entropy
        if max_repeats is not None:
            repeats = (most / least) ** (1 - a) if budget is None else budget / total / s0 * least ** (a - 1)
            found["repeats"] = repeats > max_repeats
        return found

    best = [0.0]
    for goal in [g for g, x in (("entropy", entropy), ("repeats", max_repeats)) if x is not None]:
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            cuts = [lo + (hi - lo) * i / ways for i in range(ways + 1)]
            sums = rows.agg(*[f(F.pow(p, F.lit(a)) * x) for a in cuts for f, x in ((F.sum, F.lit(1.0)), (F.sum, F.log(p)))]).first()
            small = [over(a, sums[2 * i], sums[2 * i + 1])[goal] for i, a in enumerate(cuts)]
            if not small[0]:
                hi = lo = cuts[0]
                break
            if small[-1]:
                lo = hi = cuts[-1]
                break
            k = small.index(False)
            lo, hi = cuts[k - 1], cuts[k]
        best.append(hi)
    return max(best)


def plan(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, epochs, rest): whole epochs of each source and the tokens left to pay for."""
    a = exponent(sources, entropy, max_repeats, budget)
    t = sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("norm"), F.max("tokens").alias("most")).first()
    norm = float(t.norm or 1.0)
    # without a budget, what pays one epoch of the largest source
    pay = budget if budget is not None else float(t.most or 1) ** (1 - a) * norm
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(a)) / norm).otherwise(0.0)
    due = F.round(F.lit(pay) * weight, 6)
    epochs = F.when(F.col("tokens") > 0, F.floor(due / F.col("tokens") + 1e-9)).otherwise(1).cast("int")
    rest = F.when(F.col("tokens") > 0, F.greatest(due - epochs * F.col("tokens"), F.lit(0.0))).otherwise(0.0)
    return sources.select("source", "tokens", weight.alias("weight"), epochs.alias("epochs"), rest.alias("rest"))


def order_key(epoch: Column, block: Column, seed: int) -> Column:
    """Blocks of an epoch are read in the order of this."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), block.cast("long"))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 17, blocks: int = BLOCKS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, once for each epoch that reads them, with n_tokens, weight, epoch, block_key.

    Without a budget the largest source is read once and all others more often, up to the limit,
    so that no row goes. With one, sources whose due is less than an epoch lose the blocks that
    aren't paid for. Rows of a null source are a source; null and empty texts have no tokens and
    go with their block; a source without any token is read once. Repeated rows share a block.
    Other columns are passed through; those named like an added one are replaced.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("source"), n_tokens(docs[text]).alias("n_tokens"), F.pmod(F.xxhash64(docs[key]), F.lit(blocks)).alias("block"))
    sums = cut(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    sources = cut(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    due = cut(plan(sources, entropy, max_repeats, budget))
    # the last block that the rest of the budget pays for, in the order of the partial epoch
    keyed = sums.alias("b").join(due.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).where("s.rest > 0").select("s.source", "s.rest", "b.tokens", order_key(F.col("s.epochs"), F.col("b.block"), seed).alias("place"), "b.block")
    w = Window.partitionBy("source").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, 0)
    paid = keyed.withColumn("sofar", F.sum("tokens").over(w)).where("sofar <= rest").groupBy("source").agg(F.max("place").alias("last"))
    full = cut(due.alias("s").join(paid.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")), "left").select(F.col("s.source").alias("src"), "weight", "epochs", "last"))
    if full.count() <= FEW_SOURCES:
        joined = rows.join(F.broadcast(full), rows["source"].eqNullSafe(full["src"]))
    else:
        salted = full.crossJoin(F.broadcast(spark.range(SALTS).select(F.col("id").alias("salt2"))))
        rows = rows.withColumn("salt", F.pmod(F.col("block"), F.lit(SALTS)))
        joined = rows.join(salted, rows["source"].eqNullSafe(salted["src"]) & (rows["salt"] == salted["salt2"]))
    more = F.coalesce(order_key(F.col("epochs"), F.col("block"), seed) <= F.col("last"), F.lit(False)).cast("int")
    times = F.col("epochs") + more
    read = joined.where(times > 0).select("row", "n_tokens", "weight", "block", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    rest = [c for c in docs.columns if c not in ("n_tokens", "weight", "epoch", "block_key")]
    return read.select(*[F.col("row")[c].alias(c) for c in rest], "n_tokens", "weight", "epoch", order_key(F.col("epoch"), F.col("block"), seed).alias("block_key"))
