"""Column functions over text, addresses and times."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import NOT_PUBLIC, NOT_PUBLIC_6, PUBLIC_ANYWAY, PUBLIC_WITHIN_6

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"


def url_decode_text(c: Column) -> Column:
    """One round of percent decoding; plus signs and bad escapes stay, bad UTF-8 becomes U+FFFD."""
    guarded = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(guarded), c)).otherwise(c)


def title_case(c: Column) -> Column:
    """Lower case, with a capital after everything that is no letter."""
    pieces = F.split(F.lower(c), r"(?<=\P{L})|(?=\P{L})")
    return F.array_join(F.transform(pieces, F.initcap), "")


def request_path(request_line: Column) -> Column:
    """The path of the second token of a request line; null if there is none."""
    target = F.get(F.split(F.trim(request_line), r"\s+"), F.lit(1))
    path = F.regexp_extract(target, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def parse_clf_timestamp(c: Column) -> Column:
    """`dd/MMM/yyyy:HH:mm:ss zone` as a timestamp without zone; the zone is neither checked nor used."""
    parts = F.split(c, " ")
    at = F.instr(parts[0], "/")
    month = F.concat(F.substr(parts[0], F.lit(1), at), F.initcap(F.substr(parts[0], at + 1, F.lit(3))), F.substr(parts[0], at + 4))
    return F.when(F.size(parts) == 2, F.try_to_timestamp(month, F.lit("d/MMM/yyyy:H:m:s")).cast("timestamp_ntz"))


def _is_ipv6(c: Column) -> Column:
    """Groups of hex digits, one gap at most, an IPv4 tail and a zone allowed."""
    v = F.regexp_replace(F.regexp_replace(c, r"(?<=.)%[^%/]+$", ""), rf":{IPV4}$", ":0:0")
    group = "[0-9a-fA-F]{1,4}"
    run = f"{group}(?::{group})*"
    n = F.size(F.filter(F.split(v, ":"), lambda x: x != ""))
    return (v.rlike(f"^{run}$") & (n == 8)) | (v.rlike(f"^(?:{run})?::(?:{run})?$") & (n <= 7))


def ipv6_key(c: Column) -> Column:
    """A valid IPv6 address as 32 hex digits, whose order is that of the addresses."""
    plain = F.lower(F.regexp_replace(c, "%.*$", ""))
    tail = F.regexp_extract(plain, rf"({IPV4})$", 1)
    number = F.lpad(F.lower(F.hex(ipv4_number(F.when(tail != "", tail)))), 8, "0")
    whole = F.when(tail == "", plain).otherwise(F.concat(F.regexp_replace(plain, rf"{IPV4}$", ""), F.substring(number, 1, 4), F.lit(":"), F.substring(number, 5, 4)))
    sides = F.split(whole, "::")
    groups = lambda side: F.array_join(F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")
    left, right = groups(sides[0]), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit("")))
    return F.concat(F.rpad(left, F.lit(32) - F.char_length(right), F.lit("0")), right)


def _within_6(key: Column, networks: list[str]) -> Column:
    """Whether a key lies in one of the networks, each an interval of keys."""
    out = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        out = out | key.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
    return out


def valid_ip(c: Column) -> Column:
    """An IPv4 or IPv6 address, by patterns."""
    return F.when(c.contains(":"), _is_ipv6(c)).otherwise(c.rlike(rf"^{IPV4}$"))


def ipv4_number(c: Column) -> Column:
    p = F.split(c, r"\.")
    return p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long")


def _public_4(n: Column) -> Column:
    outside, anyway = F.lit(False), [int(ipaddress.ip_address(x)) for x in PUBLIC_ANYWAY]
    for net in map(ipaddress.ip_network, NOT_PUBLIC):
        outside = outside | n.between(int(net.network_address), int(net.broadcast_address))
    return ~outside | n.isin(*anyway)


def is_public(c: Column) -> Column:
    """Neither private, loopback nor reserved; IPv4 addresses mapped into IPv6 are reserved."""
    v4, v6 = c.rlike(rf"^{IPV4}$"), c.contains(":") & _is_ipv6(c)
    key = ipv6_key(F.when(v6, c))
    # bound to a name, so that the key is put together once and not for each network
    six = F.element_at(F.transform(F.array(key), lambda k: ~_within_6(k, NOT_PUBLIC_6) | _within_6(k, PUBLIC_WITHIN_6)), 1)
    return F.when(v4, _public_4(ipv4_number(F.when(v4, c)))).when(v6, six).otherwise(False)


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
