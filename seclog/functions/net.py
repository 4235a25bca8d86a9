"""Addresses, ports and probe extraction."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seclog import refdata as R
from seclog.functions.text import folded, group_of, let, lookup, may_match_any

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = "^" + r"\.".join([_OCTET] * 4) + "$"
_LOOPBACK6 = r"^(?:(?:0{1,4}:){7}|::(?:0{1,4}:){0,5}|(?:0{1,4}:){1,6}:)0{0,3}1$"


def is_private(ip: Column) -> Column:
    """10/8, 172.16/12, 192.168/16, 127/8 and ::1; text that is no address gives false."""
    a = F.regexp_extract(ip, _IPV4, 1)
    b = F.regexp_extract(ip, _IPV4, 2)
    v4 = (a.isin("10", "127")
          | ((a == "192") & (b == "168"))
          | ((a == "172") & b.isin(*[str(n) for n in range(16, 32)])))
    return F.coalesce(v4 | ip.rlike(_LOOPBACK6), F.lit(False))


def suspicious_port_reason(port: Column) -> Column:
    return lookup(R.SUSPICIOUS_PORTS, port)


def is_skipped(ip: Column) -> Column:
    """Loopback and unspecified prefixes that never count as scanners."""
    test = F.lit(False)
    for prefix in R.SKIP_PREFIXES:
        test = test | ip.startswith(prefix)
    return test


def may_probe(text: Column) -> Column:
    """False only for texts without probes; plain substring tests, far cheaper than the patterns."""
    return may_match_any(text, [pattern for pattern, _ in R.SCAN_PATTERNS])


def probes(text: Column) -> Column:
    """Array of (src_ip, dst_port, kind), one item per firewall or login pattern that hits."""
    def probe(port: Column, kind: str):
        return lambda ip: F.when(ip != "", F.struct(
            ip.alias("src_ip"), F.coalesce(port.try_cast("int"), F.lit(0)).alias("dst_port"), F.lit(kind).alias("kind")))

    def of(t: Column) -> Column:
        line, low = t["line"], t["low"]
        found = [let(group_of(line, low, pattern, 1), probe(group_of(line, low, pattern, 2), kind)) for pattern, kind in R.SCAN_PATTERNS]
        return F.filter(F.array(*found), lambda p: p.isNotNull())

    return let(F.struct(text.alias("line"), folded(text).alias("low")), of)


def hex_ipv4(word: Column) -> Column:
    """Little-endian hex word to dotted text."""
    pairs = [F.conv(F.substring(word, start, 2), 16, 10) for start in (7, 5, 3, 1)]
    return F.when(word.rlike("^[0-9A-Fa-f]{8}$"), F.concat_ws(".", *pairs))


def hex_ipv6(words: Column) -> Column:
    """Four little-endian 32-bit hex words to compressed IPv6 text."""
    groups = []
    for start in (1, 9, 17, 25):
        for hi, lo in ((start + 6, start + 4), (start + 2, start)):
            group = F.concat(F.substring(words, hi, 2), F.substring(words, lo, 2))
            groups.append(F.lower(F.regexp_replace(group, "^0{1,3}", "")))
    full = F.concat_ws(":", *groups)

    def shortened(address: Column) -> Column:
        """The leftmost longest run of at least two zero groups shrinks to '::'."""
        short = address
        for run in range(2, 9):
            pattern = r"^(|.*?[^:]+:)0(?::0){%d}(|:.*)$" % (run - 1)
            left = F.regexp_replace(F.regexp_extract(address, pattern, 1), ":$", "")
            right = F.regexp_replace(F.regexp_extract(address, pattern, 2), "^:", "")
            short = F.when(address.rlike(pattern), F.concat(left, F.lit("::"), right)).otherwise(short)
        return short

    return F.when(words.rlike("^[0-9A-Fa-f]{32}$"), let(full, shortened))
