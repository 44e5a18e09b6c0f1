"""Mixing sources to target weights: a hypergeometric splitting tree over block quotas.

Sources share the corpus size by weight; a source stops at ``epochs`` times its own size
and the excess is shared again. Documents of a source stand in the order of a hash, a
permutation that reruns repeat, and its blocks are equal parts of the hash range. Full
epochs take every block, the last one the blocks up to the document where the target is
reached. The tree starts from all block quotas and halves them: how many blocks of each
source go left is drawn from the multivariate hypergeometric distribution, source after
source, until every leaf is an output shard with its exact quotas. Shards then take
disjoint runs of each source's permuted blocks and are shuffled on their own.

Everything is DataFrame operations. What is gathered: sums per source and hash segment
(4,096 per source at most), one row of quotas per source, and one row per block.

Defined cases: null and empty texts have size 0 and weigh nothing; documents without a
source are a source of their own, the last. Repeated rows share a hash and are taken
together. If all sizes are 0, all targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditweave.llm.common import free_name, kept_beside, slim, stored
from auditweave.session import broadcast_if_small

WEIGHTS = (1.0, 2.0, 3.0)
EPOCHS = 3
BLOCK_WORDS, SHARD_WORDS = 1 << 16, 1 << 22
_WORD = r"[^\x20\x09-\x0D]+"
_HASH_BITS, _SEGMENT_BITS = 63, 12
_FIRST = Window.unboundedPreceding


def _order(doc_id: Column, source: Column, text: Column, seed: int) -> Column:
    """Place of a document in the permutation of its source, 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, source, text), 1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``target`` words of each (source, source_size) row; ``weights`` repeat in source order.

    Sorted by the level at which they are full, sources stop at ``epochs`` times their size
    while the level of what is left reaches theirs; the first that it does not reach sets
    the level of the others. One row per source passes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    given = F.array(*[F.lit(float(w)) for w in weights])
    weighted = sizes.withColumn("weight", F.element_at(given, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    cap = F.col("source_size") * F.lit(float(epochs))
    full_at = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest = full_at.rowsBetween(_FIRST, -1), full_at.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        weighted.withColumn("full_at", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn(
            "level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
        )
        .withColumn("full", F.col("full_at") <= F.col("level"))
    )
    level = F.coalesce(F.max(F.when(~F.col("full"), F.col("level"))).over(everything), F.lit(0.0))
    return levels.withColumn("__level", level).select(
        "source", "source_size", "weight", "full",
        F.when(F.col("full"), cap).otherwise(F.least(cap, F.col("__level") * F.col("weight"))).alias("target"),
    )


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _log_factorial(x: Column) -> Column:
    """Stirling's series, shifted so that its error stays below 1e-10."""
    y = x + 8.0
    series = (y + 0.5) * F.log(y + 1.0) - (y + 1.0) + 0.5 * math.log(2 * math.pi)
    z = y + 1.0
    series = series + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * z * z * z * z * z)
    shift = F.log((x + 1.0) * (x + 2.0) * (x + 3.0) * (x + 4.0)) + F.log((x + 5.0) * (x + 6.0) * (x + 7.0) * (x + 8.0))
    return series - shift


def _choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(marked: Column, whole: Column, drawn: Column, uniform: Column) -> Column:
    """Number of marked items among ``drawn`` of ``whole``, by inversion of the distribution.

    The search covers twelve standard deviations around the mean within the possible range.
    """
    share = marked / F.greatest(whole, F.lit(1))
    mean = drawn * share
    spread = F.sqrt(mean * (1.0 - share) * (whole - drawn) / F.greatest(whole - 1, F.lit(1)))
    low = F.greatest(F.lit(0), drawn - (whole - marked), F.floor(mean - 12.0 * spread - 12.0)).cast("long")
    high = F.least(marked, drawn, F.ceil(mean + 12.0 * spread + 12.0)).cast("long")
    unit = _choose(whole.cast("double"), drawn.cast("double"))

    def step(state: Column, x: Column) -> Column:
        y = x.cast("double")
        chance = F.exp(_choose(marked.cast("double"), y) + _choose((whole - marked).cast("double"), drawn.cast("double") - y) - unit)
        done = state["mass"] >= uniform
        return F.struct(
            F.when(done, state["mass"]).otherwise(state["mass"] + chance).alias("mass"),
            F.when(done, state["at"]).otherwise(x).alias("at"),
        )

    start = F.struct(F.lit(0.0).alias("mass"), low.alias("at"))
    return F.aggregate(F.sequence(low, F.greatest(low, high)), start, step)["at"]


def _drawer(seed: int, level: int):
    """Fold over the sources of a node: draw one, go on with what whole and drawn leave."""

    def draw(state: Column, x: Column) -> Column:
        taken = hypergeometric(
            x["blocks"], state["whole"], state["drawn"], _uniform(F.lit(seed), F.lit(level), state["node"], x["place"])
        )
        return F.struct(
            state["node"].alias("node"),
            (state["whole"] - x["blocks"]).alias("whole"),
            (state["drawn"] - taken).alias("drawn"),
            F.concat(state["out"], F.array(taken)).alias("out"),
        )

    return draw


def split_quotas(quotas: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """(place, shard, blocks): the block quotas of every source dealt to ``shards`` leaves.

    ``quotas`` has (place, blocks), one row per source. Every leaf gets the same number of
    blocks up to one, every source's blocks are all dealt. ``shards`` is a power of two.
    """
    # the last source takes what the others leave, so that sums are exact
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "blocks"))).alias("left")).select(
        F.lit(0).cast("long").alias("node"), "left"
    )
    for level in range(shards.bit_length() - 1):
        if level == 8:
            nodes = nodes.repartition("node")
        total = F.aggregate("left", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        sized = nodes.withColumn("whole", total).withColumn("drawn", F.floor((F.col("whole") + F.col("node") % 2) / 2))

        start = F.struct("node", "whole", "drawn", F.array().cast("array<bigint>").alias("out"))
        drawn = sized.select("node", "left", F.aggregate("left", start, _drawer(seed, level))["out"].alias("taken"))
        one = F.zip_with("left", "taken", lambda x, t: F.struct(x["place"].alias("place"), t.alias("blocks")))
        other = F.zip_with("left", "taken", lambda x, t: F.struct(x["place"].alias("place"), (x["blocks"] - t).alias("blocks")))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), one.alias("left")),
            F.struct((F.col("node") * 2 + 1).alias("node"), other.alias("left")),
        )
        nodes = drawn.select(F.explode(halves).alias("half")).select("half.node", "half.left")
    leaves = nodes.select(F.col("node").cast("int").alias("shard"), F.explode("left").alias("quota"))
    return leaves.select("quota.place", "shard", "quota.blocks")


def _thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds ``upto`` to ``goals``: the last epoch takes documents whose place is below it."""
    shift = _HASH_BITS - _SEGMENT_BITS
    segment = F.shiftright("place", shift)
    sums = sized.groupBy("source", segment.alias("segment")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("segment").rowsBetween(_FIRST, -1)
    same = goals.select(F.col("source").alias("goal_source"), "rest")
    placed = sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).join(
        same, F.col("source").eqNullSafe(F.col("goal_source"))
    )
    # the segment in which the target is reached; only its documents are looked at one by one
    border = placed.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))).select(
        F.col("source").alias("border_source"), F.col("segment").alias("border"), (F.col("rest") - F.col("before")).alias("open")
    )
    near = sized.select("source", "place", "size", segment.alias("segment")).join(
        border, F.col("source").eqNullSafe(F.col("border_source")) & (F.col("segment") == F.col("border"))
    )
    upto = Window.partitionBy("source").orderBy("place", "size").rowsBetween(_FIRST, 0)
    middle = F.sum("size").over(upto) - F.col("size") / 2
    last = (
        near.select("source", "place", "border", "open", middle.alias("middle"))
        .groupBy("source", "border")
        .agg(F.max(F.when(F.col("middle") <= F.col("open"), F.col("place") + 1)).alias("inside"))
        .select(
            F.col("source").alias("border_source"),
            F.coalesce("inside", F.shiftleft(F.col("border"), shift)).alias("inside"),
        )
    )
    every = F.when(F.col("rest") > 0, F.lit((1 << _HASH_BITS) - 1)).otherwise(F.lit(0))
    return goals.join(last, F.col("source").eqNullSafe(F.col("border_source")), "left").select(
        *goals.columns, F.when(F.col("rest") > 0, F.coalesce("inside", every)).otherwise(F.lit(0)).cast("long").alias("upto")
    )


class Mix:
    """Plan of a mix: ``goals`` has one row per source, ``blocks`` one per block copy taken."""

    def __init__(self, goals: DataFrame, blocks: DataFrame, shards: int, seed: int) -> None:
        self.goals, self.blocks, self.shards, self.seed = goals, blocks, shards, seed

    def copies(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard: str = "shard") -> DataFrame:
        """One row of ``docs`` per taken copy, with its ``shard``; sources are joined, texts dealt once.

        A column that is named like ``shard`` is replaced by it.
        """
        kept = kept_beside(docs.columns, shard)
        goal = self.goals.select(*[F.col(c).alias(f"__{c}") for c in ("source", "number", "full_epochs", "upto", "bits")])
        place = _order(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.col(f"`{text}`"), self.seed)
        placed = docs.join(broadcast_if_small(goal), F.col(f"`{source}`").eqNullSafe(F.col("__source")))
        placed = placed.withColumn("__place", place)
        taken = F.col("__full_epochs") + (F.col("__place") < F.col("__upto")).cast("int")
        block = F.expr(f"shiftright(__place, {_HASH_BITS} - __bits)")
        epochs = F.when(taken > 0, F.sequence(F.lit(0), taken - 1)).otherwise(F.array().cast("array<int>"))
        rows = placed.withColumn("__epoch", F.explode(epochs)).withColumn(
            "__copy", F.expr("shiftleft(cast(__epoch as bigint), __bits)") + block
        )
        dealt = self.blocks.select(F.col("number").alias("__number"), F.col("copy").alias("__copy"), F.col("shard").alias("__dealt"))
        return rows.join(broadcast_if_small(dealt), ["__number", "__copy"]).select(
            *[f"`{c}`" for c in kept], F.col("__dealt").alias(shard), "__epoch", "__place"
        )

    def write_order(self, copies: DataFrame, shard: str = "shard") -> DataFrame:
        """Copies by shard, shuffled inside each: one shard lies in one partition."""
        return copies.repartition(self.shards, shard).sortWithinPartitions(
            shard, F.xxhash64(F.lit(self.seed + 1), "__place", "__epoch")
        )


def sizes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """(doc_id, source, size, place) of every row, stored: texts are read once."""
    rows = slim(docs, doc_id=doc_id, source=source, text=text)
    return stored(
        rows.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
            _order(F.col("doc_id"), F.col("source"), F.col("text"), seed).alias("place"),
        ),
        "sizes",
    )


def plan_mix(
    sized: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    epochs: int = EPOCHS,
    seed: int = 1,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> Mix:
    """Targets, thresholds and the splitting tree for the rows of :func:`sizes_of`."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sizes, weights, epochs)
    rounds = F.when(F.col("full"), F.lit(epochs)).otherwise(
        F.least(F.lit(epochs), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    ).cast("int")
    goals = aimed.withColumn("full_epochs", rounds).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("full_epochs") * F.col("source_size"))
    )
    goals = goals.withColumn(
        "bits", F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_size") / float(block_words)))).cast("int")
    ).withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    goals = stored(_thresholds(sized, stored(goals, "goals")), "goals")
    last = F.expr(f"shiftright(upto - 1, {_HASH_BITS} - bits) + 1")
    quotas = goals.select(
        F.col("number").alias("place"),
        (
            F.expr("shiftleft(cast(full_epochs as bigint), bits)") + F.when(F.col("upto") > 0, last).otherwise(F.lit(0))
        ).cast("long").alias("blocks"),
    )
    words = goals.agg(F.sum("source_size")).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1.0, words / shard_words))))
    leaves = stored(split_quotas(quotas, shards, seed), "leaves")
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(_FIRST, -1)
    runs = leaves.withColumn("begin", F.coalesce(F.sum("blocks").over(upto), F.lit(0))).where("blocks > 0")
    blocks = runs.select(
        F.col("place").alias("number"), "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("blocks") - 1)).alias("copy")
    )
    return Mix(goals, blocks, shards, seed)


def mix_table(sized: DataFrame, mix: Mix) -> DataFrame:
    """Per row of :func:`sizes_of`: size, source size, target, words taken and its shards."""
    row = free_name(sized.columns, "__row")
    numbered = stored(sized.withColumn(row, F.monotonically_increasing_id()), "numbered")
    goal = mix.goals.select(F.col("source").alias("__source"), "source_size", "target", "number", "full_epochs", "upto", "bits")
    placed = numbered.join(broadcast_if_small(goal), F.col("source").eqNullSafe(F.col("__source")))
    count = F.col("full_epochs") + (F.col("place") < F.col("upto")).cast("int")
    block = F.expr(f"shiftright(place, {_HASH_BITS} - bits)")
    rows = placed.withColumn("copies", count).withColumn(
        "copy",
        F.explode_outer(
            F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.expr("0L") + t * F.expr("shiftleft(1L, bits)") + block))
        ),
    )
    return (
        rows.join(mix.blocks, ["number", "copy"], "left")
        .groupBy(row, "doc_id", "source", "size", "source_size", "target")
        .agg((F.col("size") * F.count("shard")).alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
        .drop(row)
    )
