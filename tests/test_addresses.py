"""Public addresses by interval tables against Python's own judgement."""

import ipaddress
import random

from pyspark.sql import functions as F

from gatewarden.functions import patterns, text


def judged(x):
    try:
        a = ipaddress.ip_address(x)
    except ValueError:
        return False
    return not (a.is_private or a.is_loopback or a.is_reserved)


def test_public_addresses(spark):
    rng = random.Random(11)
    shown = []
    for net in map(ipaddress.ip_network, patterns.NOT_PUBLIC + patterns.NOT_PUBLIC_6 + patterns.PUBLIC_WITHIN_6):
        first, last = int(net.network_address), int(net.broadcast_address)
        make = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        shown += [str(make(n)) for n in (first - 1, first, last, last + 1, rng.randint(first, last)) if 0 <= n < 1 << net.max_prefixlen]
    shown += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)] + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    shown += [str(ipaddress.IPv6Address((0x2600 + rng.randrange(200) << 112) + (rng.getrandbits(16) << rng.choice((0, 16, 64))))) for _ in range(100)]
    shown += ["::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:0808:0808", "2600::1.2.3.4", "2001:4860:4860::8888", "FE80::1%eth0", "2600::1%a", "::", "::1", "1:2:3", "1::2::3", "12345::", "x", "", "1:2:3:4:5:6:7:8", "2600:1:2:3:4:5:6::", "::2600:1"]
    df = spark.createDataFrame([(x,) for x in shown] + [(None,)], "ip string")
    got = df.select("ip", text.is_public(F.col("ip")).alias("p"), text.ipv6_key(F.when(F.col("ip").contains(":") & text._is_ipv6(F.col("ip")), F.col("ip"))).alias("k")).collect()
    wrong = [(r.ip, r.p) for r in got if r.p != (judged(r.ip) if r.ip is not None else False)]
    assert not wrong
    for r in got:
        if r.k is not None and judged(r.ip):
            assert r.k == f"{int(ipaddress.ip_address(r.ip.partition('%')[0])):032x}"
