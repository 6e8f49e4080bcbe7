"""Temperature mixing of sources, DataFrame operations only.

Weights are source token shares to the power of an exponent between 0 (equal) and 1 (as they are), normalised. The
exponent is bisected to meet a target entropy (a share of the greatest possible one), or the least exponent at which
no source is repeated more often than a limit; both are monotone in it. Four halvings are evaluated in one job (the
15 midpoints they can need), over a table of one row a source.

The budget of tokens is realised as block permutations: each source's documents are dealt by hash into blocks of
about `block_tokens`; an epoch is the blocks in a hashed order of its own and the documents of each block likewise.
Whole epochs repeat every document; of the last, partial one, the documents before the budget's mark stay. Running
token sums go over blocks of blocks, blocks, and documents of a block, so no window holds a source.

All orders come from MD5, so that plain SQL gives the same mix. A document's tokens are its words (runs of characters
other than white space); null texts have none and are kept once an epoch with the block they fall in. A null source is a source of its own. Sources without any tokens get no
weight and no rows. Empty tables give no rows; other columns are passed on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwell.llm.common import scratch

SUPER = 1024  # blocks of a block of blocks


def row_key(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """The MD5 of a row's id, source and text; nulls differ from empty strings."""
    some = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(doc_id), F.length(source), F.col(source))]
    return F.md5(F.concat(some[0], F.lit("|"), some[1], F.lit("|"), some[2], F.lit("|"), F.when(F.col(text).isNull(), "n").otherwise(F.concat(F.lit("t"), F.col(text)))))


def hashed(*parts: str | int) -> Column:
    """A number of 60 bits from columns (names) and integers."""
    own = [F.lit(str(x)) if isinstance(x, int) else F.col(x).cast("string") for x in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *own)), 1, 15), 16, 10).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """(source, tokens, docs) a source."""
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None, budget: float | None, rounds: int = 8) -> float:
    """The exponent that meets the target. sources: (source, tokens)."""
    all_tokens, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not all_tokens or n < 2:
        return 1.0
    share = sources.select("tokens", (F.col("tokens") / float(all_tokens)).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(rounds):
        step = (high - low) / 16
        grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(low + i * step).alias("a")) for i in range(1, 16)]))
        power = share.select("tokens", F.log("p").alias("l"), grid.alias("g")).withColumn("w", F.exp(F.col("g.a") * F.col("l")))
        sums = power.groupBy("g.i").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("g.a") * F.col("l")).alias("s"), F.max(F.col("w") / F.col("tokens")).alias("r"))
        got = {x["i"]: x for x in sums.collect()}  # 15 rows
        at_low, at_high = 0, 16
        while at_high - at_low > 1:  # the four halvings
            mid = (at_low + at_high) // 2
            x = got[mid]
            if entropy is not None:
                enough = math.log(x["z"]) - x["s"] / x["z"] >= entropy * math.log(n)
                at_low, at_high = (mid, at_high) if enough else (at_low, mid)
            else:
                within = x["r"] / x["z"] * (budget or float(all_tokens)) <= repeats
                at_low, at_high = (at_low, mid) if within else (mid, at_high)
        low, high = low + at_low * step, low + at_high * step
    return low if entropy is not None else high


def mixed(docs: DataFrame, budget: float | None = None, entropy: float | None = 0.95, repeats: float | None = None, block_tokens: int = 1_000_000, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, weights). rows: docs with epoch, block_rank, place, mix_tokens; weights: a row a source.

    budget: tokens of the mix (None: as many as the corpus has). Either entropy (share of the greatest) or repeats
    (most epochs of any source) is the target."""
    if (entropy is None) == (repeats is None):
        raise ValueError("name either a target entropy or a repetition limit")
    taken = {"epoch", "block_rank", "place", "mix_tokens"}
    text = docs.drop(*taken & set(docs.columns))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = text.select("doc_id", "source", words.alias("words"), row_key().alias("h"))
    # Equal rows move together, as one unit.
    rows = rows.groupBy("h").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.sum("words").alias("tokens"))
    rows = scratch(rows, "mix-rows")
    sources = scratch(source_tokens(rows), "mix-sources")
    a = exponent(sources, entropy, repeats, budget)
    sums = sources.agg(F.sum("tokens").alias("all"), F.sum(F.pow(F.col("tokens").cast("double"), a)).alias("z"))
    weights = sources.crossJoin(F.broadcast(sums)).withColumn("weight", F.pow(F.col("tokens").cast("double"), a) / F.col("z"))  # one row on the right
    weights = weights.withColumn("budget", F.col("weight") * (F.lit(float(budget)) if budget else F.col("all").cast("double")))
    weights = weights.select("source", "tokens", "docs", F.lit(a).alias("exponent"), "weight", "budget", (F.col("budget") / F.col("tokens")).alias("epochs"))
    weights = scratch(weights.withColumn("blocks", F.ceil(F.col("tokens") / block_tokens).cast("long")), "mix-weights")

    def on_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        cond = left["source"].eqNullSafe(right["source"])
        for c in more:
            cond &= left[c] == right[c]
        return left.join(right, cond).drop(right["source"], *(right[c] for c in more))

    blocked = on_source(rows, weights.select("source", "epochs", "budget", F.col("tokens").alias("total"), "blocks"))
    blocked = blocked.withColumn("block", hashed("h", seed) % F.col("blocks"))
    epoch = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs") - 1, F.lit(0)).cast("int")))
    # The partial epoch: which blocks and documents come before the mark.
    per_block = blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("epochs").alias("epochs"), F.first("budget").alias("budget"), F.first("total").alias("total"))
    per_block = per_block.withColumn("epoch", epoch).withColumn("order", hashed("block", "epoch", seed))
    per_block = per_block.withColumn("super", F.shiftright("order", 60 - int(math.log2(SUPER))))
    per_block = scratch(per_block, "mix-blocks")
    earlier = Window.partitionBy("source", "epoch").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = per_block.groupBy("source", "epoch", "super").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    supers = supers.select("source", "epoch", "super", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    within = Window.partitionBy("source", "epoch", "super").orderBy("order", "block")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    ranked = on_source(per_block, supers, "epoch", "super")
    ranked = ranked.withColumn("start", F.col("before") + F.coalesce(F.sum("tokens").over(upto), F.lit(0))).withColumn("block_rank", F.col("rank_before") + F.row_number().over(within) - 1)
    mark = F.col("budget") - F.col("epoch") * F.col("total")
    used = ranked.where(F.col("start") < mark).select("source", "block", "epoch", "block_rank", F.col("start").alias("block_start"), mark.alias("mark"))
    dealt = on_source(blocked.select("doc_id", "source", "tokens", "h", "block"), used, "block")
    own = Window.partitionBy("source", "epoch", "block").orderBy(hashed("h", "epoch", seed), "h", "doc_id")
    dealt = dealt.withColumn("start", F.coalesce(F.sum("tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("block_start")).withColumn("place", F.row_number().over(own) - 1)
    picks = dealt.where(F.col("start") < F.col("mark")).select(F.col("h").alias("_pick"), "epoch", "block_rank", "place", F.col("tokens").alias("mix_tokens"))
    chosen = text.withColumn("_h", row_key()).join(picks, F.col("_h") == F.col("_pick")).drop("_h", "_pick")
    return chosen, weights
