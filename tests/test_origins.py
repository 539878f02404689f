"""Senders of both address families and host rules against a plain implementation."""

import ipaddress

from pyspark.sql import functions as F

from logloom.functions.convert import address_bits
from logloom.operators import joins

CIDRS = ["2001:db8::/32", "2001:db8:0:1::/64", "2001:db8:0:1:8000::/65", "fe80::/10", "::1", "::/0", "10.0.0.0/8", "10.1.2.3/32", "192.168.5.7/16", "200.0.0.0/5", "0.0.0.0/0",
         "2001:db8::5/128", "10.0.0.0/33", "::/129", "bad/8", "10.0.0.0/x"]
SENDERS = ["2001:db8::5", "2001:DB8:0:1::9", "2001:db8:0:1:ffff::", "fe80::1%eth0", "::1", "::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "10.1.2.3", "::ffff:10.1.2.3", "::ffff:a01:203",
           "::FFFF:200.9.9.9", "192.168.255.1", "255.255.255.255", "64:ff9b::10.0.0.1", "nothing", "", None]


def _network(text):
    try:
        return ipaddress.ip_network(text, strict=False)
    except ValueError:
        return None


def _address(text):
    try:
        a = ipaddress.ip_address(text)
        return getattr(a, "ipv4_mapped", None) or a
    except ValueError:
        return None


def test_addresses_meet_their_ranges(spark):
    ranges = spark.createDataFrame(list(enumerate(CIDRS)), "range_id int, cidr string")
    senders = spark.createDataFrame([(s,) for s in SENDERS], "peer_ip string")
    got = {(r.peer_ip, r.range_id) for r in joins.address_matches(senders, ranges).collect()}
    nets = [(i, n) for i, n in enumerate(map(_network, CIDRS)) if n]
    assert got == {(s, i) for s in SENDERS if s and (a := _address(s)) for i, n in nets if a.version == n.version and a in n}


def test_bits(spark):
    texts = ["::", "::1", "8000::1", "1:2:3:4:5:6:7:8", "2001:db8::ff00:42:8329", "255.1.2.3", "1:2"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", address_bits(F.col("t")).alias("b")).collect():
        a = _address(r.t)
        want = None if a is None else int(a) if a.version == 6 else int(a) << 96
        assert (None if r.b is None else (r.b.high % 2**64 << 64) + r.b.low % 2**64) == want


def test_invalid_host_rules_count_as_none(spark):
    ranges = spark.createDataFrame([(t, t, None, f"2001:db8:{t}::/48", ["tcp"]) for t in (7, 8)], "range_id int, tenant_id int, source_id int, cidr string, protocols array<string>")
    sources = spark.createDataFrame([(1, 7, "(bad", "syslog", True), (2, 7, "^web", "syslog", True), (3, 7, "", "syslog", True), (4, 8, "[", "syslog", True), (5, 8, None, "api", True)],
                                    "source_id int, tenant_id int, match_hostname string, transport string, active boolean")
    lines = spark.createDataFrame([("2001:db8:7::9", "tcp", "web1"), ("2001:db8:7::9", "tcp", "(bad"), ("2001:db8:8::9", "tcp", "x"), ("2001:db9::9", "tcp", "web1")],
                                  "peer_ip string, transport string, hostname string")
    got = {(r.peer_ip, r.hostname): (r.tenant_id, r.source_id) for r in joins.resolve_source(lines, ranges, sources).collect()}
    assert got == {("2001:db8:7::9", "web1"): (7, 2), ("2001:db8:7::9", "(bad"): (7, None), ("2001:db8:8::9", "x"): (8, 4), ("2001:db9::9", "web1"): (None, None)}
    assert {r.match_hostname for r in joins.host_rules(sources).filter("rule is null and match_hostname <> ''").collect()} == {"(bad", "["}


def test_rules_are_looked_up_by_their_plain_parts():
    keys = joins.mandatory_keys
    assert keys("^host3$") == ["hos", "ost", "st3"] and keys("fw-.*") == ["fw-"] and keys("ab") == ["ab"] and keys(".*") == [""] and keys("(?i)web") == [""]
    assert keys("(db|web)-(main)+x?") == ["ain", "mai"] and keys(r"a\.b[0-9]{2}core") == ["a.b", "cor", "ore"] and keys("a|b") == [""]


def test_rule_lookup_equals_testing_every_rule(spark):
    import random
    import re
    rng = random.Random(4)
    rules = [(t, i, rule) for i, (t, rule) in enumerate((t, rule) for t in (1, 2) for rule in ("^host3$", "fw-.*", "web", "^w", "x$", ".*9", "(db|web)-[0-9]+", "(?i)WEB", "a.b", "é+z", "[", "", None))]
    names = ["".join(rng.choice(["host3", "fw-", "web", "WEB", "db-", "1", "9", "x", "a", ".", "b", "é", "z", "-"]) for _ in range(rng.randrange(0, 4))) for _ in range(150)]
    origins = spark.createDataFrame([(t, n, str(i)) for i, n in enumerate(names) for t in (1, 2, 3)], "tenant_id long, hostname string, peer_ip string")
    sources = spark.createDataFrame([(t, i, r, True, "syslog") for t, i, r in rules], "tenant_id long, source_id long, match_hostname string, active boolean, transport string")
    got = {(r["tenant_id"], r["peer_ip"], r["__rule"]) for r in joins.rule_matches(origins, joins.host_rules(sources), ["tenant_id", "peer_ip"]).collect()}
    want = {(t, str(i), s) for i, n in enumerate(names) for t, s, rule in rules if rule and rule != "[" and re.search(rule, n)}
    assert got == want and want
