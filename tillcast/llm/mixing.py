"""Mixing sources to target weights with DataFrame functions only.

A source's weight is its token share to the power alpha, normalised: 1 keeps the shares, 0 makes them
equal. Alpha is found by bisection over the source totals (each pass tests 64 values and keeps the
interval that holds the bound), for a target entropy or a limit on repetition. The weights become token
budgets; the budget of a source is realised as permutations of its blocks, one per epoch, the last cut
where the budget is reached.

By default the total budget is the least one under which every source is used whole at least once: no
document is lost, small sources repeat. Documents are dealt to blocks by a hash of their id. Only totals by
source and block are grouped, summed before the shuffle, so a source with a third of all rows is no burden.

A null source is a source of its own. Null and empty texts have no tokens and go with their block; a source
without tokens is used once. Empty tables give empty results. Repeated rows are all kept. Columns called
``epoch``, ``block``, ``block_rank``, ``weight`` or ``alpha`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillcast.llm.tables import free_name, staged, without

STEPS = 1 << 24  # alpha is a multiple of 1 / STEPS
PROBES = 64
MAX_BROADCAST_BYTES = 32 << 20
OWN = ("epoch", "block", "block_rank", "weight", "alpha")


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that depends on nothing but the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def find_alpha(totals: DataFrame, *, target_entropy: float | None = None, repetition_limit: float | None = None) -> float:
    """The largest alpha whose entropy (in nats) reaches the target, or the least that keeps the limit.

    ``totals`` has one row per source with its share ``p`` above 0. Repetition is how often the most
    repeated source is used when the least repeated one is used once.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give one of target_entropy and repetition_limit")
    low, width = 0, STEPS * PROBES  # the answer is in [low, low + width)
    while width > 1:
        step = max(1, width // PROBES)
        probes = [low + step * i for i in range(PROBES) if low + step * i <= STEPS]
        probe = totals.select("p", F.explode(F.array(*[F.lit(x) for x in probes])).alias("k")).withColumn("a", F.col("k") / STEPS)
        power = F.pow("p", F.col("a"))
        z = F.sum(power)
        entropy = F.log(z) - F.sum(power * F.col("a") * F.log("p")) / z
        ratio = power / F.col("p")
        met = probe.groupBy("k").agg(entropy.alias("entropy"), (F.max(ratio) / F.min(ratio)).alias("repetition")).collect()
        if target_entropy is not None:
            good = [r.k for r in met if r.entropy >= target_entropy - 1e-12]
            low = max(good, default=low)
            if not good:
                return 0.0
        else:
            good = [r.k for r in met if r.repetition > repetition_limit + 1e-12]
            if not good:
                return low / STEPS
            low = max(good)
            if step == 1:
                return min(low + 1, STEPS) / STEPS
        width = step
    return low / STEPS


def mix_plan(docs: DataFrame, *, source: str, key: Column, tokens: Column, blocks: int, target_entropy: float | None,
             repetition_limit: float | None, budget_tokens: int | None) -> DataFrame:
    """One row per source and block: ``uses``, an array of (epoch, rank), and the source's ``weight``, ``alpha``."""
    cells = staged(docs.groupBy(F.col(f"`{source}`").alias("src"), key.alias("block")).agg(F.sum(tokens).alias("n")), "mix-blocks")
    sources = cells.groupBy("src").agg(F.sum("n").alias("t"))
    total = sources.agg(F.sum("t")).first()[0] or 0
    shares = sources.where("t > 0").select("src", "t", (F.col("t") / F.lit(float(total or 1))).alias("p"))
    alpha = find_alpha(shares, target_entropy=target_entropy, repetition_limit=repetition_limit) if total else 1.0
    weighted = shares.withColumn("power", F.pow("p", F.lit(alpha)))
    sums = weighted.agg(F.sum("power").alias("z"), F.max(F.col("t") / F.col("power")).alias("once")).first()
    z = sums.z or 1.0
    budget = float(budget_tokens) if budget_tokens is not None else (sums.once or 0.0) * z
    weighted = weighted.select("src", "t", (F.col("power") / z).alias("weight")).withColumn(
        "times", F.round(F.col("weight") * budget / F.col("t"), 9))
    plan = cells.join(weighted.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.select("src", "block", "n", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
                       F.coalesce("times", F.lit(1.0)).alias("times"))
    epochs = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil("times"), F.lit(1)).cast("int"))))
    order = Window.partitionBy("src", "epoch").orderBy(_draw(F.col("src"), F.col("epoch"), F.col("block")), "block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = epochs.select("*", F.row_number().over(order).alias("rank"), F.sum("n").over(upto).alias("cum"))
    left = (F.col("times") - F.col("epoch") + 1) * F.col("t")  # tokens this epoch may still use
    used = (F.col("epoch") <= F.col("times")) | (F.col("cum") - F.col("n") / 2 <= left)
    return placed.where(used).groupBy("src", "block").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "rank"))).alias("uses"), F.any_value("weight").alias("weight")
    ).withColumn("alpha", F.lit(alpha))


def mix(docs: DataFrame, *, source: str = "source", text: str = "text", doc_id: str = "doc_id", blocks: int = 256,
        target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: int | None = None) -> DataFrame:
    """``docs``, each row once per use, with ``epoch, block, block_rank, weight, alpha``.

    The order (epoch, block_rank) is the permutation. Give a target entropy in nats or a repetition limit.
    """
    docs = without(docs, *OWN)
    key = F.pmod(_draw(F.col(f"`{doc_id}`")), F.lit(blocks)).cast("int")
    plan = staged(mix_plan(docs, source=source, key=key, tokens=token_count(F.col(f"`{text}`")), blocks=blocks,
                           target_entropy=target_entropy, repetition_limit=repetition_limit, budget_tokens=budget_tokens), "mix-plan")
    size = plan.agg(F.sum(64 + F.coalesce(F.octet_length("src"), F.lit(0)) + 16 * F.size("uses"))).first()[0] or 0
    src, of_block, use = (free_name(docs, n) for n in ("src", "of_block", "use"))
    plan = plan.select(F.col("src").alias(src), F.col("block").alias(of_block), "uses", "weight", "alpha")
    if size <= MAX_BROADCAST_BYTES:
        plan = F.broadcast(plan)
    rows = docs.withColumn("block", key)
    met = rows.join(plan, rows[source].eqNullSafe(plan[src]) & (rows["block"] == plan[of_block]))
    columns = [rows[c] for c in docs.columns]
    return met.select(*columns, rows["block"], plan["weight"], plan["alpha"], F.explode(plan["uses"]).alias(use)).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(f"{use}.epoch").alias("epoch"), "block",
        F.col(f"{use}.rank").alias("block_rank"), "weight", "alpha")
