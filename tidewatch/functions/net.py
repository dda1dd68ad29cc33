"""Addresses, networks and URLs as expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it isn't dotted IPv4 with octets up to 255."""
    o = F.split(ip, r"\.")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    part = [F.try_element_at(o, F.lit(i + 1)).try_cast("long") for i in range(4)]
    value = part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]
    return F.when(ok & (F.greatest(*part) <= 255), value)


def address_class(ip: Column) -> Column:
    """private, loopback, link_local, documentation, benchmark, multicast, public or invalid."""
    n = ipv4_number(ip)

    def inside(*nets: str) -> Column:
        cond = F.lit(False)
        for net in nets:
            x = ipaddress.ip_network(net)
            cond = cond | n.between(int(x.network_address), int(x.broadcast_address))
        return cond

    return (
        F.when(n.isNull(), "invalid").when(inside("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"), "private").when(inside("127.0.0.0/8"), "loopback").when(inside("169.254.0.0/16"), "link_local")
        .when(inside("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"), "documentation").when(inside("198.18.0.0/15"), "benchmark").when(inside("224.0.0.0/4"), "multicast").otherwise("public")
    )


def canonical_url(url: Column) -> Column:
    """scheme://host[:port]/path in lower-case scheme and host; default ports, query and fragment dropped; null without a dotted host."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?[^/:?#]+:(\d+)", 1)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    drop = F.lit(False)
    for s, p in DEFAULT_PORTS.items():
        drop = drop | ((scheme == s) & (port == p))
    shown = F.when((port == "") | drop, F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when((scheme != "") & host.contains("."), F.concat(scheme, F.lit("://"), host, shown, F.when(path == "", "/").otherwise(path)))


def networks(spark, cidrs: list[tuple[str, str]]) -> DataFrame:  # noqa: ANN001
    """(cidr, name, lo, hi, bits) of a network list; bad entries raise."""
    rows = []
    for c, name in cidrs:
        n = ipaddress.ip_network(c, strict=False)
        rows.append((c, name, int(n.network_address), int(n.broadcast_address), n.prefixlen))
    return spark.createDataFrame(rows, "cidr string, name string, lo bigint, hi bigint, bits int")


def match_networks(df: DataFrame, ip: str, nets: DataFrame) -> DataFrame:
    """Adds the most specific containing network (cidr, name), null if there is none.

    Networks are keyed by (prefix length, masked address), so a match is an equi-join on the
    few prefix lengths that occur, not a scan of ranges.
    """
    lengths = [r.bits for r in nets.select("bits").distinct().orderBy(F.desc("bits")).collect()]  # at most 33
    n = ipv4_number(F.col(ip))
    probes = F.array(*[F.struct(F.lit(b).alias("bits"), (n - n % (1 << (32 - b))).alias("lo")) for b in lengths])
    keyed = df.select(ip).distinct().withColumn("p", F.explode(probes)).select(ip, F.col("p.bits").alias("bits"), F.col("p.lo").alias("lo"))
    best = keyed.join(nets, ["bits", "lo"]).groupBy(ip).agg(F.max(F.struct("bits", "cidr", "name")).alias("m"))
    return df.join(best, ip, "left").withColumn("cidr", F.col("m.cidr")).withColumn("network", F.col("m.name")).drop("m")
