"""Fuzzy decisions of a block in parallel: time segments, speculation and confirmation.

A block is replayed in time order, and each decision depends on the entities active at that
time. Blocks with more than ``segment_rows`` rows are cut into time segments that are
replayed side by side. A segment needs from the past only which entities are active when it
begins, and which entity an earlier identity belongs to. Both are guessed (at first, that
nobody merged), all segments are replayed, and the segments whose guessed input differs from
what the decisions now say are replayed again, until nothing differs. Then every decision
agrees with all earlier ones, which only the sequential replay does.

Where a profile is saturated (two active entities decide as a thousand do), or nobody is
active, guesses are right at once. Where one decision hangs on the other over many segments,
a guess repairs one segment only; so every round joins pairs of segments, and a round later
than the logarithm of their number would be the sequential replay.

Of the active entities of one profile and address a segment gets the two that stay longest:
whether there is none, one (which?) or more decides, and these two outlast the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from auditweave.functions import events
from auditweave.operators import replay
from auditweave.session import broadcast_if_small, cut_lineage

SEGMENT_ROWS = 200_000
_PROFILE = ("ua_family", "ua_version", "proxy", "kind")
_CROSS = ("block", "seg", "label", "at", "oid", "step", "entity", *_PROFILE, "source_ip", "until")


def place(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Add ``hot``, ``origin``, ``width`` and ``seg``; blocks that are not hot are one segment.

    Segments of a block have one length, chosen so that the middle 98 of 100 rows make
    segments of ``segment_rows`` rows on average.
    """
    bounds = F.percentile_approx("at", [0.01, 0.99], 1_000)
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), bounds.alias("q"))
    length = (F.col("q")[1] - F.col("q")[0]) * segment_rows / F.col("n")
    hot = sizes.where((F.col("n") > segment_rows) & F.col("q").isNotNull()).select(
        F.col("block").alias("__b"), F.col("q")[0].alias("origin"),
        F.greatest(F.ceil(length), F.lit(events.MICROS)).cast("long").alias("width"),
    )
    # there are at most rows / segment_rows hot blocks; still, the hint follows a count
    joined = rows.join(broadcast_if_small(cut_lineage(hot)), F.col("block") == F.col("__b"), "left").drop("__b")
    return joined.withColumns(
        {"hot": F.col("width").isNotNull(), "seg": F.coalesce(_segment("at"), F.lit(0).cast("long"))}
    )


def _segment(at: str, joined: int = 1):
    """Number of the segment of a time, when ``joined`` neighbours are one; whole numbers all the way."""
    since, width = f"({at} - origin)", f"(width * {joined}L)"
    return F.expr(f"({since} - pmod({since}, {width})) div {width}")


def _replayed(rows: DataFrame, settings) -> DataFrame:
    # By a hash of the keys: a union of joins on the keys themselves counts as partitioned by
    # them already, and the exchange would be left out although its parts may be cut differently.
    placed = rows.repartition(F.xxhash64("block", "seg")).sortWithinPartitions(
        "block", "seg", F.col("at").asc_nulls_first(), F.col("oid").asc_nulls_first(), "step"
    )
    return placed.drop("oid").mapInPandas(replay.replay_blocks(settings), replay.RESULT_SCHEMA)


def _owned(crossers: DataFrame, labels: DataFrame, introduced: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Sessions with the entity that they belong to by ``decisions``, and its profile; ``labels`` are theirs."""
    if decisions is None:
        entity = crossers.withColumn("entity", F.col("label"))
    else:
        owners = decisions.select("label", "owner").join(labels, "label", "left_semi")
        entity = crossers.join(owners, "label", "left").withColumn("entity", F.coalesce("owner", "label")).drop("owner")
    entity = cut_lineage(entity)
    asked = broadcast_if_small(cut_lineage(entity.select("entity").distinct()))
    anchors = introduced.select(F.col("label").alias("entity"), *_PROFILE, "source_ip").join(asked, "entity", "left_semi")
    return cut_lineage(entity.join(anchors, "entity"))


def _crosses(lookback_us: int):
    """Whether a session is of an identity introduced in an earlier segment, or reaches a later one.

    Joined segments begin where one of theirs does, so other sessions never cross.
    """
    earlier = F.col("introduced_at").isNull() | (_segment("introduced_at") < _segment("at"))
    return earlier | (_segment(f"(until + {lookback_us}L)") > _segment("at"))


def _crossing(owned: DataFrame, lookback_us: int, joined: int) -> DataFrame:
    """What segments learn from earlier ones if sessions belong to the entities of ``owned``.

    Sessions of identities introduced earlier (step 1), and entities active at the
    beginning of a segment (step -1).
    """
    oid = dict(owned.dtypes)["oid"]
    owned = owned.withColumn("seg", _segment("at", joined))
    earlier = F.col("introduced_at").isNull() | (_segment("introduced_at", joined) < F.col("seg"))
    later = owned.where(earlier).withColumn("step", F.lit(1))
    last = _segment(f"(until + {lookback_us}L)", joined)
    reaching = owned.where(last > F.col("seg")).withColumn("seg", F.explode(F.sequence(F.col("seg") + 1, last)))
    active = reaching.groupBy("block", "seg", "entity", *_PROFILE, "source_ip").agg(F.max("until").alias("until"))
    address = F.when(~F.col("proxy"), F.col("source_ip"))
    longest = Window.partitionBy("block", "seg", *_PROFILE, address).orderBy(F.col("until").desc(), "entity")
    carried = active.withColumn("__rank", F.row_number().over(longest)).where("__rank <= 2").withColumns(
        {"label": F.col("entity"), "at": F.lit(None).cast("long"), "step": F.lit(-1), "oid": F.lit(None).cast(oid)}
    )
    return later.select(*_CROSS).unionByName(carried.select(*_CROSS))


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """(block, seg) of the segments whose crossing rows are not the same."""
    both = old.withColumn("__d", F.lit(-1)).unionByName(new.withColumn("__d", F.lit(1)))
    changed = both.groupBy(*_CROSS).agg(F.sum("__d").alias("__d")).where("__d <> 0")
    return changed.select("block", "seg").distinct()


def decide(rows: DataFrame, settings, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(label, method, owner, similarity) of every identity that may match.

    ``rows`` are introductions (step 0) and sessions (step 1); a remembered entity is an
    introduction without a time.
    """
    placed = place(cut_lineage(rows), segment_rows).withColumn("entity", F.lit(None).cast("string"))
    extra = ("hot", "origin", "width")
    result = ("label", "method", "owner", "similarity")
    cold = _replayed(placed.where(~F.col("hot")).drop(*extra), settings).select(*result)
    if placed.where("hot").isEmpty():
        return cold
    hot = cut_lineage(placed.where("hot"))
    introduced = hot.where("step = 0").select("label", F.col("at").alias("introduced_at"), *_PROFILE, "source_ip")
    sessions = cut_lineage(
        hot.where("step = 1").drop("step", "entity", "seg", "hot", *_PROFILE, "source_ip").join(
            introduced.select("label", "introduced_at"), "label"
        )
    )
    founding = hot.where((F.col("step") == 0) & F.col("at").isNotNull()).drop("hot")

    def inside(joined: int) -> DataFrame:
        """Introductions, and the sessions in the segment of their introduction."""
        own = sessions.withColumn("seg", _segment("at", joined)).where(
            F.col("seg") == _segment("introduced_at", joined)
        )
        return founding.withColumn("seg", _segment("at", joined)).drop("origin", "width").unionByName(
            own.drop("introduced_at", "origin", "width").withColumn("step", F.lit(1)), allowMissingColumns=True
        )

    # few sessions tell a later segment anything, so what changes from round to round is small
    crossers = cut_lineage(sessions.where(_crosses(settings.lookback_us)))
    labels = broadcast_if_small(cut_lineage(crossers.select("label").distinct()))

    def crossing(owned: DataFrame, joined: int) -> DataFrame:
        return cut_lineage(_crossing(owned, settings.lookback_us, joined))

    joined, todo, decisions = 1, None, None
    known = crossing(_owned(crossers, labels, introduced, None), joined)
    while True:
        work = inside(joined).unionByName(known, allowMissingColumns=True)
        if todo is not None:
            work = work.join(todo, ["block", "seg"], "left_semi")
        found = _replayed(work, settings)
        if decisions is not None:
            pairs = decisions.withColumn("seg", F.floor(F.col("seg") / 2).cast("long"))
            found = found.unionByName(pairs.join(todo, ["block", "seg"], "left_anti").select("block", "seg", *result))
        decisions = cut_lineage(found)
        owned = _owned(crossers, labels, introduced, decisions)
        changed = cut_lineage(_differing(known, crossing(owned, joined)))
        if changed.isEmpty():
            return cold.unionByName(decisions.select(*result))
        # there are at most rows / segment_rows segments and as many blocks; still, the hint follows a count
        pairs = changed.select("block", F.floor(F.col("seg") / 2).cast("long").alias("seg")).distinct()
        todo = broadcast_if_small(cut_lineage(pairs))
        joined *= 2
        known = crossing(owned, joined)
