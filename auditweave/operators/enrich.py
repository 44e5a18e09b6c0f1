"""Enrichment of unified events: user agent, IP reputation, geo ranges, recent creation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from auditweave.functions import agents, events, net
from auditweave.operators import ordered
from auditweave.session import broadcast_if_small, cut_lineage

# Words in an ASN organisation that mark a hosting provider.
HOSTING_KEYWORDS = (
    "digitalocean", "ovh", "hetzner", "amazon", "google", "microsoft", "vultr", "linode",
)


def enrich_user_agent(df: DataFrame, column: str = "user_agent") -> DataFrame:
    ua = F.col(column)
    return df.withColumn("ua_family", agents.ua_family(ua)).withColumn(
        "ua_version", agents.ua_version(ua, F.col("ua_family"))
    )


def _range_key(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return net.ip_key(F.col(name))
    return F.concat(F.lit(net.V4_PREFIX), F.lpad(F.lower(F.hex(F.col(name))), 8, "0"))


def _leveled(ranges: DataFrame, kept: list[str]) -> DataFrame:
    """Ranges with the longest hex prefix their two ends share.

    Of ranges that do not overlap at most 15 share one (level, prefix): each has to
    straddle one of the 15 borders between the 16 children of that prefix.
    """
    low, high = F.col("__low"), F.col("__high")
    keyed = ranges.select(
        _range_key(ranges, "start_ip").alias("__low"),
        _range_key(ranges, "end_ip").alias("__high"),
        *kept,
    )
    same = F.filter(
        F.sequence(F.lit(1), F.lit(32)),
        lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i),
    )
    return keyed.withColumn("__level", F.size(same)).withColumn(
        "__prefix", F.substring(low, F.lit(1), F.col("__level"))
    )


def _overlap(leveled: DataFrame) -> bool:
    """Whether two ranges share an address. Only for tables that passed the size check."""
    before = Window.orderBy("__low", "__high").rowsBetween(Window.unboundedPreceding, -1)
    seen = leveled.select("__low", F.max("__high").over(before).alias("__reach"))
    return not seen.where(F.col("__low") <= F.col("__reach")).isEmpty()


def join_ip_ranges(
    df: DataFrame, column: str, ranges: DataFrame, kept: list[str], max_broadcast: int = 1_000_000
) -> DataFrame:
    """Left join to ``(start_ip, end_ip, ...)``; IPv4 and IPv6. Every row stays one row.

    One equi-join per prefix length in use (a handful), never a theta join. A table
    that passes the size check and has no overlaps is broadcast per length and the events
    are not shuffled; any other is matched to the distinct addresses only. Of several
    ranges that hold an address the innermost counts: the one that starts last, then the
    one that ends first, then the smallest values.
    """
    leveled = cut_lineage(_leveled(ranges, kept))
    levels = sorted(r[0] for r in leveled.select("__level").distinct().collect())
    small = leveled.limit(max_broadcast + 1).count() <= max_broadcast
    if not levels:
        return df.select("*", *[F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in kept])

    inside = F.col("__key").between(F.col("__low"), F.col("__high"))
    if small and not _overlap(leveled):
        out = df.withColumn("__key", net.ip_key(F.col(column)))
        for level in levels:
            part = leveled.where(F.col("__level") == level).select(
                "__prefix", "__low", "__high", *[F.col(c).alias(f"__{level}_{c}") for c in kept]
            )
            out = out.join(
                F.broadcast(part), (F.substring("__key", 1, level) == F.col("__prefix")) & inside, "left"
            ).drop("__prefix", "__low", "__high")
        return out.select(
            *df.columns,
            *[F.coalesce(*[F.col(f"__{level}_{c}") for level in levels]).alias(c) for c in kept],
        )

    asked = df.select(F.col(column).alias("__ip")).where(F.col("__ip").isNotNull()).distinct()
    asked = cut_lineage(asked.withColumn("__key", net.ip_key(F.col("__ip"))))
    hits = [
        asked.join(
            F.broadcast(part) if small else part,
            (F.substring("__key", 1, level) == F.col("__prefix")) & inside,
        )
        for level in levels
        for part in [leveled.where(F.col("__level") == level)]
    ]
    # digits turned round, so that the smallest end and the smallest values are the largest key
    ends_first = F.translate("__high", "0123456789abcdef", "fedcba9876543210")
    innermost = F.max(F.struct("__low", ends_first.alias("__end"))).over(Window.partitionBy("__ip"))
    known = (
        reduce(DataFrame.unionByName, hits)
        .select("__ip", "__low", ends_first.alias("__end"), *kept, innermost.alias("__best"))
        .where((F.col("__low") == F.col("__best.__low")) & (F.col("__end") == F.col("__best.__end")))
        .groupBy("__ip").agg(F.min(F.struct(*kept)).alias("__range"))
    )
    return df.join(known, F.col(column) == F.col("__ip"), "left").select(*df.columns, "__range.*")


def enrich_ip(
    df: DataFrame,
    column: str = "source_ip",
    tor: DataFrame | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Add ``is_known_proxy_or_tor`` (NULL = no reference data) and ``geo_country``.

    ``tor`` has one column ``ip``; ``ranges`` has start_ip, end_ip, country, asn_org.
    """
    out = df.drop("is_known_proxy_or_tor", "geo_country")
    kept = out.columns
    listed = F.lit(False)
    hosted = F.lit(False)
    country = F.lit("Unknown")
    if tor is not None:
        exits = tor.select(F.col("ip").alias("__tor")).distinct()
        out = out.join(broadcast_if_small(exits), F.col(column) == F.col("__tor"), "left")
        listed = F.col("__tor").isNotNull()
    if ranges is not None:
        renamed = ranges.withColumnsRenamed({"country": "__country", "asn_org": "__asn"})
        out = join_ip_ranges(out, column, renamed, ["__country", "__asn"])
        organisation = F.lower(F.coalesce(F.col("__asn"), F.lit("")))
        for word in HOSTING_KEYWORDS:
            hosted = hosted | organisation.contains(word)
        country = F.coalesce(F.col("__country"), F.lit("Unknown"))
    if tor is None and ranges is None:
        flag = F.lit(None).cast("boolean")
    else:
        flag = listed | hosted
    return out.select(
        *kept, flag.alias("is_known_proxy_or_tor"), country.alias("geo_country")
    )


def is_creation(cloud: Column, action: Column) -> Column:
    from auditweave.operators.normalize import CREATION_ACTIONS

    hit = F.lit(False)
    for name, actions in CREATION_ACTIONS.items():
        hit = hit | ((F.upper(cloud) == name) & action.isin(*actions))
    return F.coalesce(hit, F.lit(False))


def created_in_window(
    df: DataFrame,
    key: str = "principal_key",
    ts: str = "timestamp",
    creation: Column | None = None,
    *,
    minutes: int = 30,
    causal: bool = True,
    order: str = "event_id",
    hot_rows: int = ordered.HOT_ROWS,
    slice_us: int = ordered.SLICE_US,
) -> DataFrame:
    """Flag events at most ``minutes`` after the first creation the same key performed.

    ``causal`` only looks at creations up to the event itself, as a live detector has
    to; otherwise the earliest creation in the whole table counts.
    """
    if creation is None:
        creation = is_creation(F.col("source_cloud"), F.col("action"))
    base = df.drop("principal_created_in_window")
    kept = base.columns
    base = base.withColumn("__at", events.micros(F.col(ts))).withColumn(
        "__made", F.when(creation & F.col(key).isNotNull(), F.col("__at"))
    )
    if causal:
        sliced = ordered.with_slices(base, [key], "__at", hot_rows, slice_us)
        seen = ordered.running(
            sliced, "__at", [order], {"__first": ordered.lowest(F.col("__made"))}
        ).plain()
    else:
        first = base.where(F.col("__made").isNotNull()).groupBy(key).agg(
            F.min("__made").alias("__first")
        )
        seen = base.join(first, key, "left")
    age = F.col("__at") - F.col("__first")
    flag = F.coalesce(age.between(0, minutes * 60 * events.MICROS), F.lit(False))
    return seen.select(*kept, flag.alias("principal_created_in_window"))
