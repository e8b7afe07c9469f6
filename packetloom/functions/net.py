"""Addresses, ports and the keys built from them."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

LOCAL_NETWORKS = ("172.19.0.0/16",)

# IPv4 blocks that count as private, and the addresses inside them that do not (fixed values).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
NOT_PRIVATE_V4 = ("192.0.0.9/32", "192.0.0.10/32")

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"^{_OCTET}([.]{_OCTET}){{3}}$"


# The address tests are written as SQL text: they are long, and each intermediate value is bound once by a
# one-element transform, so it is worked out once per row however often the text names it.
def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _long_sql(ip: str) -> str:
    octets = " + ".join(f"cast(p[{i}] AS bigint) * {1 << (24 - 8 * i)}" for i in range(4))
    return f"CASE WHEN {ip} RLIKE '{_V4}' THEN {_let(f"split({ip}, '[.]')", 'p', octets)} END"


def _blocks_sql(value: str, blocks: Sequence[str]) -> str:
    nets = [ipaddress.ip_network(block) for block in blocks]
    return "(" + " OR ".join(f"{value} BETWEEN {int(n[0])} AND {int(n[-1])}" for n in nets) + ")"


def _private_v4_sql(value: str) -> str:
    return f"({_blocks_sql(value, PRIVATE_V4)} AND NOT {_blocks_sql(value, NOT_PRIVATE_V4)})"


def _hextets_sql(ip: str) -> str:
    """The eight 16-bit groups of an IPv6 address; NULL when the text is not one."""
    low = _let(
        _long_sql("regexp_extract(h, ':([0-9]+[.][0-9.]+)$', 1)"), "v",
        "concat(lower(hex(shiftright(v, 16))), ':', lower(hex(v & 65535)))",
    )
    undotted = f"CASE WHEN instr(h, '.') > 0 THEN concat(regexp_extract(h, '^(.*:)', 1), {low}) ELSE h END"
    none = "cast(array() AS array<string>)"
    halves = (
        f"named_struct('packed', instr(t, '::') > 0, "
        f"'left', CASE WHEN split_part(t, '::', 1) = '' THEN {none} ELSE split(split_part(t, '::', 1), ':') END, "
        f"'right', CASE WHEN split_part(t, '::', 2) = '' THEN {none} ELSE split(split_part(t, '::', 2), ':') END)"
    )
    missing = "8 - size(s.left) - size(s.right)"
    full = (
        f"CASE WHEN (s.packed AND {missing} >= 1) OR (NOT s.packed AND {missing} = 0) "
        f"THEN concat(s.left, array_repeat('0', {missing}), s.right) END"
    )
    numbers = "CASE WHEN forall(f, g -> g RLIKE '^[0-9a-f]{1,4}$') THEN transform(f, g -> cast(conv(g, 16, 10) AS int)) END"
    parsed = f"CASE WHEN t RLIKE '^[0-9a-f:]*:[0-9a-f:]*$' AND NOT t RLIKE '::.*::|:::' THEN {_let(_let(halves, 's', full), 'f', numbers)} END"
    return _let(_let(f"regexp_replace(lower({ip}), '%[^%/]+$', '')", "h", undotted), "t", parsed)


# IPv6 blocks that count as private, over the groups h[0..7], in address order (fixed values).
_PRIVATE_V6 = {
    "::/127": "h[0] = 0 AND h[1] = 0 AND h[2] = 0 AND h[3] = 0 AND h[4] = 0 AND h[5] = 0 AND h[6] = 0 AND h[7] <= 1",
    "64:ff9b:1::/48": "h[0] = 100 AND h[1] = 65435 AND h[2] = 1",
    "100::/64": "h[0] = 256 AND h[1] = 0 AND h[2] = 0 AND h[3] = 0",
    "2001::/23, less 2001:1::1, 2001:1::2, 2001:3::/32, 2001:4:112::/48, 2001:20::/28, 2001:30::/28":
        "h[0] = 8193 AND h[1] < 512 AND h[1] <> 3 AND NOT h[1] BETWEEN 32 AND 63 AND NOT (h[1] = 4 AND h[2] = 274) "
        "AND NOT (h[1] = 1 AND h[2] = 0 AND h[3] = 0 AND h[4] = 0 AND h[5] = 0 AND h[6] = 0 AND h[7] IN (1, 2))",
    "2001:db8::/32": "h[0] = 8193 AND h[1] = 3512",
    "2002::/16": "h[0] = 8194",
    "fc00::/7": "h[0] BETWEEN 64512 AND 65023",
    "fe80::/10": "h[0] BETWEEN 65152 AND 65215",
}


def _private_v6_sql(ip: str) -> str:
    mapped = "h[0] = 0 AND h[1] = 0 AND h[2] = 0 AND h[3] = 0 AND h[4] = 0 AND h[5] = 65535"
    v4 = _let("cast(h[6] AS bigint) * 65536 + h[7]", "v", _private_v4_sql("v"))
    own = " OR ".join(f"({test})" for test in _PRIVATE_V6.values())
    return _let(_hextets_sql(ip), "h", f"CASE WHEN {mapped} THEN {v4} ELSE {own} END")


def ipv4_to_long(ip: str) -> Column:
    """IPv4 text (a column name) as a number 0..2^32-1; anything else is NULL."""
    return F.expr(_long_sql(ip))


def address_bits(ip: str) -> Column:
    """'4' or '6' and the bits of an address (a column name), so that a network is a prefix; anything else is NULL."""
    v6 = _let(_hextets_sql(ip), "h", "concat('6', array_join(transform(h, g -> lpad(bin(g), 16, '0')), ''))")
    v4 = _let(_long_sql(ip), "v", "concat('4', lpad(bin(v), 32, '0'))")
    return F.expr(f"CASE WHEN instr({ip}, ':') > 0 THEN {v6} ELSE {v4} END")


def in_networks(ip: str, networks: Sequence[str] = LOCAL_NETWORKS) -> Column:
    """True when the IPv4 address lies in one of the CIDR blocks; never NULL."""
    return F.expr(f"coalesce({_let(_long_sql(ip), 'v', _blocks_sql('v', networks))}, false)")


def is_valid_ip(ip: str) -> Column:
    """True for a well-formed IPv4 or IPv6 address; never NULL."""
    return F.expr(f"coalesce(CASE WHEN instr({ip}, ':') > 0 THEN {_hextets_sql(ip)} IS NOT NULL ELSE {ip} RLIKE '{_V4}' END, false)")


def is_private_ip(ip: str) -> Column:
    """True for private and reserved addresses; malformed text and NULL give False."""
    v4 = _let(_long_sql(ip), "v", _private_v4_sql("v"))
    return F.expr(f"coalesce(CASE WHEN instr({ip}, ':') > 0 THEN {_private_v6_sql(ip)} ELSE {v4} END, false)")


def flow_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port") -> Column:
    """``src:sport-dst:dport``; NULL when a part is missing."""
    return F.concat(
        F.col(src_ip), F.lit(":"), F.col(src_port).cast("string"), F.lit("-"),
        F.col(dst_ip), F.lit(":"), F.col(dst_port).cast("string"),
    )


def reverse_flow_key() -> Column:
    return flow_key("dst_ip", "dst_port", "src_ip", "src_port")


def session_key(protocol="protocol") -> Column:
    """Direction-free key: the endpoint that sorts first (address text, then port text) leads."""
    sp, dp = F.col("src_port").cast("string"), F.col("dst_port").cast("string")
    forward = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (sp <= dp))
    return F.concat(F.when(forward, flow_key()).otherwise(reverse_flow_key()), F.lit("-"), F.col(protocol))


def direction(local_networks: Sequence[str] = LOCAL_NETWORKS) -> Column:
    """'outbound' when the sender is in a local network, else 'inbound'."""
    return F.when(in_networks("src_ip", local_networks), "outbound").otherwise("inbound")
