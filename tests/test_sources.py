from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.sources import readers as R
from tidewatch.sources import tables as S


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string")


def test_sensor_events(spark):
    df = lines(
        spark,
        {"eventid": "pot.session.connect", "timestamp": "2026-01-01T00:00:00Z", "session": "s", "src_ip": "1.2.3.4", "src_port": 5},
        {"eventid": "pot.session.closed", "timestamp": "2026-01-01T00:01:00Z", "session": "s", "src_ip": "fe80::1", "duration": 60.5, "extra": 1},
        {"eventid": "session.file_download", "timestamp": "bad", "session": "s", "shasum": "AB", "filename": "/tmp/x.sh"},
        {"eventid": "pot.client.size"},
        "{broken",
        "",
        None,
    )
    got = R.sensor_events(df, "edge", "public").collect()
    assert [r.event_action for r in got] == ["session.connect", "session.closed", "session.file_download"]
    assert [r.network_type for r in got] == ["ipv4", "ipv6", None]
    assert got[1].duration == 60_500_000_000
    assert (got[2].ts, got[2].file_sha256, got[2].filename) == (None, "ab", "x.sh")
    assert {r.sensor for r in got} == {"edge"}


def test_web_and_firewall(spark):
    w = R.web_events(lines(spark, {"time": "2026-01-01T00:00:00Z", "sip": "1.1.1.1", "method": "get", "url": "/a/b.PHP?x=1#z", "headers": {"Host": "H.Example:8080"}, "body": "äb"}, "nope")).collect()
    assert [(r.method, r.host, r.port, r.path, r.extension, r["query"], r.body_bytes) for r in w] == [("GET", "h.example", 8080, "/a/b.PHP", "php", "x=1", 3)]
    f = R.firewall_events(lines(spark, {"sensor": "s", "logs": [{"time": 1.5, "sip": "1.1.1.1", "dport": 22}, {"time": 2, "sip": "2.2.2.2"}]}, {"sensor": "t", "logs": []})).collect()
    assert [(r.source_ip, r.dport) for r in f] == [("1.1.1.1", 22), ("2.2.2.2", None)]


def test_feeds(spark, tmp_path):
    (tmp_path / "n.netset").write_text("# list\n10.0.0.0/8 # inner\n\n1.2.3.4\n")
    assert {(r.cidr, r.bits) for r in R.network_list(spark, str(tmp_path / "n.netset"), "x").collect()} == {("10.0.0.0/8", 8), ("1.2.3.4", 32)}
    with pytest.raises(ValueError, match="more than"):
        R.network_list(spark, str(tmp_path / "n.netset"), "x", limit=1)
    (tmp_path / "f.csv").write_text('# c\n"1","http://a/""q""","x, y"\n"2","http://b",""\n')
    assert [r.url for r in R.csv_feed(spark, str(tmp_path / "f.csv"), "id int, url string, tags string").collect()] == ['http://a/"q"', "http://b"]
    (tmp_path / "j.json").write_text(json.dumps([{"ip": "1.1.1.1", "n": 3}, {"ip": None}]))
    feed = R.json_feed(spark, str(tmp_path / "j.json"), "ip string, n int")
    df = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",), (None,)], "a string")
    assert [r.listed for r in R.membership(df, "a", feed, "ip").orderBy(F.col("a").desc_nulls_last()).collect()] == [False, True, False]


def test_tables(spark, tmp_path):
    schema = T.StructType.fromDDL("k string, v bigint")
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    path = str(tmp_path / "t")
    S.append(df, path, schema)
    with pytest.raises(ValueError, match="not in the schema"):
        S.append(df.withColumn("x", F.lit(1)), path, schema)
    with pytest.raises(ValueError, match="column v"):
        S.append(df.withColumn("v", F.lit("s")), path, schema)
    S.append(df.withColumn("x", F.lit(1)), path, schema, strict=False)
    assert S.read(spark, path).columns == ["k", "v", "x"]
    S.append(df.select("k"), path, schema)
    assert S.read(spark, path).filter("v is null").count() == 1
    S.replace(S.read(spark, path).filter("v = 1").select("k", "v"), path, schema)
    assert [tuple(r) for r in S.read(spark, path).collect()] == [("a", 1), ("a", 1)]
