"""Hand-worked values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from seclog import refdata as R
from seclog.functions import dns, net
from seclog.functions.text import (matched_rules, parse_octal_mode, octal_mode, required_texts, rule_severity, shannon,
                                   upgraded_level, parse_level)


def values(spark, texts, build):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_rules(spark):
    cases = {
        "Failed password for root from 1.2.3.4 port 22 ssh2": ["SSH Brute Force", "Failed Login"],
        "Invalid user admin from 1.2.3.4 port 22": ["Failed Login"],
        "rm -f /var/log/auth.log": ["Log Tampering"],
        "crontab edited by root": ["Suspicious Cron"],
        "usb 1-1: new high speed device": ["USB Device"],
        "service heartbeat ok": [],
        # Letters that equal ASCII ones only when case is ignored.
        "FAİLED PAſſWORD": ["Failed Login"],
        "oom kill": ["OOM Killer"],
        "/tmp/été.sh": ["Malware Indicator"],
    }
    texts = [f"{t} {t}" for t in cases]
    assert values(spark, texts, matched_rules) == list(cases.values())


def test_broken_and_disabled_rules_are_skipped(spark):
    rules = [R.Rule("bad", "(", "critical"), R.Rule("off", "x", "critical", False), R.Rule("on", "x", "info")]
    assert values(spark, ["xx"], lambda t: matched_rules(t, rules)) == [["on"]]
    assert values(spark, ["xx"], lambda t: rule_severity(matched_rules(t, rules), rules)) == ["info"]


@pytest.mark.parametrize("pattern,texts", [
    (r"a?bcd{2}ef", None), ("(foo|bar)?baz", ["baz"]), ("(foo|ba)x", ["ba", "foo"]), ("(foo|ba){0,2}x", None),
    ("((ab|cd)x)?fo", None), (r"\[UFW BLOCK\]", ["[ufw block]"]), ("(?i)abcd", None), ("abcd|", None),
    (r"(?:usb|USB).*x", ["usb"]), (r"kernel:.*(?:BUG|panic)", ["kernel:"])])
def test_required_texts(pattern, texts):
    assert required_texts(pattern) == texts


def test_level_is_never_lowered(spark):
    levels = list(R.LEVEL_RANK)
    for severity in ["", "info", "warning", "critical"]:
        got = values(spark, levels, lambda level: upgraded_level(level, F.lit(severity)))
        assert all(R.LEVEL_RANK[new] >= R.LEVEL_RANK[old] for new, old in zip(got, levels))
    assert values(spark, ["INFO", "ERROR"], lambda level: upgraded_level(level, F.lit("warning"))) == ["WARNING", "ERROR"]


def test_parse_level(spark):
    assert values(spark, ["Panic!", "interrupt", "a Warning", "DEBUG x", "ok"], parse_level) == [
        "CRITICAL", "ERROR", "WARNING", "DEBUG", "INFO"]


def test_shannon(spark):
    got = values(spark, ["", "aaaa", "abcd", "a1b2c3d4e5f6g7h8", "\U0001F600a"], shannon)
    assert [round(v, 9) + 0.0 for v in got] == [0.0, 0.0, 2.0, 4.0, 1.0]


def test_is_private(spark):
    ips = ["172.16.0.1", "172.32.0.1", "::1", "0:0:0:0:0:0:0:1", "bad", "10.1.2.3", "10.1.2", "010.1.2.3", "192.168.1.1", "127.0.0.9"]
    assert values(spark, ips, net.is_private) == [True, False, True, True, False, True, False, False, True, True]


def test_probes(spark):
    def found(text):
        return values(spark, [text], net.probes)[0]

    assert [(p.src_ip, p.dst_port) for p in found("[UFW BLOCK] SRC=1.2.3.4 DPT=22")] == [("1.2.3.4", 22)] * 3
    assert [(p.src_ip, p.dst_port) for p in found("Failed password for x from 5.6.7.8 port 40000")] == [("5.6.7.8", 40000)] * 2
    assert [(p.src_ip, p.dst_port) for p in found("GET / from 9.9.9.9")] == [("9.9.9.9", 0)]


def test_hex_addresses(spark):
    assert values(spark, ["0100007F", "zz"], net.hex_ipv4) == ["127.0.0.1", None]
    assert values(spark, ["B80D0120000000000000000001000000", "00000000000000000000000000000000",
                          "B80D0120010000000000020000000300"], net.hex_ipv6) == ["2001:db8::1", "::", "2001:db8:0:1:2:0:3:0"]


def test_dns(spark):
    texts = ["query[A] Www.Example.COM. from 10.0.0.7", "client 10.1.2.3#5353: query: a.b.onion IN A",
             "NXDOMAIN for h7.badhost.bit", "resolved x.io to 1.2.3.4"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.domain, r.client, r.is_nxdomain) for r in dns.with_query(rows, F.col("t")).collect()}
    assert got == {texts[0]: ("www.example.com", "10.0.0.7", False), texts[1]: ("a.b.onion", "10.1.2.3", False),
                   texts[2]: ("h7.badhost.bit", "unknown", True)}


def test_octal(spark):
    rows = spark.range(4096).withColumn("o", octal_mode(F.col("id")))
    assert rows.filter(parse_octal_mode(F.col("o")) != F.col("id")).isEmpty()
    assert values(spark, ["0o644", "755", "zz"], parse_octal_mode) == [0o644, 0o755, 0o644]


def test_the_substring_test_never_drops_a_match(spark):
    """Rules tested behind their required texts hit exactly where the plain patterns do."""
    import random

    from seclog.functions.text import rx

    rng = random.Random(3)
    atoms = ["fail", "login", "a", "b", r"\d", r"\x66", r"\101", ".", "[ab]", r"[\]x]", r"\.", "(?:ab|cd)", "(user|root)", "x{0}", "abc?", "root*", "(log)?", " ", r"\bfoo", "|", "+?", "[^a]"]
    patterns = [r"\x66ailed login", r"\101bcde", "[]a]bcd", r"\Qa.b\E", "failed|x", "(fail|log)(ed)?"]
    patterns += ["".join(rng.choices(atoms, k=rng.randint(1, 6))) for _ in range(150)]
    texts = ["failed login", "abcde", "Abcde user root", "", "foo ab cd", "a.b", "]abcd", "LOGIN x root"] + [
        "".join(rng.choices(["fail", "log", "in", "a", "b", " ", "root", "user", "]", "x", "1", "cd", "."], k=rng.randint(0, 8))) for _ in range(60)]
    rules = [R.Rule(str(i), p, "info") for i, p in enumerate(patterns)]
    from seclog.functions.text import usable_rules
    usable = usable_rules(rules)
    assert 50 < len(usable) < len(rules)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(rx(r.pattern)), F.lit(r.name)) for r in usable]))
    for row in rows.select("t", matched_rules(F.col("t"), rules).alias("got"), plain.alias("want")).collect():
        assert row.got == row.want, row.t
