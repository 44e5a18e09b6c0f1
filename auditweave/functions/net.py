"""IP address expressions: syntax, ordered keys and private ranges.

An address of either family becomes a 32-digit lower-case hex key; an IPv4
address takes the ``::ffff:0:0/96`` form. Keys compare like the numbers, so a
range test is a string comparison that stays in generated code.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_HEXTET = r"[0-9A-Fa-f]{1,4}"

V4_PREFIX = "0" * 20 + "ffff"

# Networks that are not globally reachable (IANA special-purpose registries).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_WITHIN_PRIVATE_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_WITHIN_PRIVATE_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28",
    "2001:30::/28",
)


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def _tail_to_hextets(ip: Column) -> Column:
    """``::ffff:1.2.3.4`` -> ``::ffff:102:304``; anything else unchanged."""
    quad = F.regexp_extract(ip, r":([0-9.]+)$", 1)
    octets = F.split(quad, r"\.")

    def part(i: int) -> Column:
        return F.lpad(F.lower(F.hex(F.try_element_at(octets, F.lit(i)).try_cast("long"))), 2, "0")

    return F.when(
        ip.contains(".") & quad.rlike(IPV4_PATTERN),
        F.concat(
            F.regexp_replace(ip, r"[0-9.]+$", ""),
            part(1), part(2), F.lit(":"), part(3), part(4),
        ),
    ).otherwise(ip)


def is_ipv6(ip: Column) -> Column:
    text = _tail_to_hextets(ip)
    groups = F.size(F.filter(F.split(text, ":"), lambda g: g != ""))
    body = rf"^(({_HEXTET}:){{0,7}}{_HEXTET})?(::)?(({_HEXTET}:){{0,7}}{_HEXTET})?$"
    ok = (
        text.contains(":")
        & ~text.contains(".")
        & text.rlike(body)
        & F.when(text.contains("::"), groups <= 7).otherwise(groups == 8)
    )
    return F.coalesce(ok, F.lit(False))


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ipv4_long(ip: Column) -> Column:
    """Dotted quad as a number; NULL when it is not one."""
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(octets, F.lit(i)).try_cast("long")
    return F.when(is_ipv4(ip), number)


def ip_key(ip: Column) -> Column:
    """32-digit hex key of a valid address of either family, else NULL."""
    v4 = F.concat(F.lit(V4_PREFIX), F.lpad(F.lower(F.hex(ipv4_long(ip))), 8, "0"))
    text = F.lower(_tail_to_hextets(ip))
    halves = F.split(text, "::")

    def hextets(half: Column) -> Column:
        return F.transform(
            F.filter(F.split(half, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")
        )

    left = hextets(F.get(halves, F.lit(0)))
    right = hextets(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    fill = F.array_repeat(F.lit("0000"), F.lit(8) - F.size(left) - F.size(right))
    v6 = F.array_join(F.concat(left, fill, right), "")
    return F.when(is_ipv4(ip), v4).when(is_ipv6(ip), v6)


def network_bounds(cidr: str) -> tuple[str, str]:
    """First and last key of a CIDR block (driver side, for constants and tests)."""
    net = ipaddress.ip_network(cidr)
    offset = int(V4_PREFIX, 16) << 32 if net.version == 4 else 0
    return (
        format(offset + int(net.network_address), "032x"),
        format(offset + int(net.broadcast_address), "032x"),
    )


def _v4_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def _within(value: Column, networks: tuple[str, ...], bounds) -> Column:
    hit = F.lit(False)
    for cidr in networks:
        low, high = bounds(cidr)
        hit = hit | value.between(F.lit(low), F.lit(high))
    return hit


def internal_flag(v4: Column, v6_key: Column) -> Column:
    """1 private or reserved, 0 public, -1 neither kind of address.

    Takes ``ipv4_long`` and, for text with a colon, ``ip_key`` as ready columns, so the
    parsing is not repeated for every network.
    """
    private_v4 = _within(v4, PRIVATE_V4, _v4_bounds) & ~_within(
        v4, PUBLIC_WITHIN_PRIVATE_V4, _v4_bounds
    )
    private_v6 = _within(v6_key, PRIVATE_V6, network_bounds) & ~_within(
        v6_key, PUBLIC_WITHIN_PRIVATE_V6, network_bounds
    )
    return (
        F.when(v4.isNotNull(), F.when(private_v4, 1).otherwise(0))
        .when(v6_key.isNotNull(), F.when(private_v6, 1).otherwise(0))
        .otherwise(-1)
    )
