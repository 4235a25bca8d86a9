"""The beacon scan against a replay of the snapshots, row by row."""

import random

import numpy as np
import pandas as pd
import pytest

from seclog.operators import snapshots as S
from seclog.operators.rates import MICROS


def walk(rows, window_us, keep, least):
    """Replay: clear the history after each hit."""
    recent, hits = [], []
    for us, n in rows:
        recent += [us] * n
        recent = recent if keep is None else recent[-keep:]
        recent = [t for t in recent if t >= us - window_us]
        if len(recent) < least:
            continue
        gaps = np.diff(np.array(recent, dtype="int64")) / MICROS
        mean, std = float(gaps.mean()), float(gaps.std())
        if 0 < mean < 120 and std / mean < 0.25:
            hits.append((us, len(recent), mean, std))
            recent = []
    return hits


def history(rng, n, kind):
    us, rows = 0, []
    for _ in range(n):
        us += {"steady": 15, "jitter": rng.choice([14, 15, 16, 18]), "mixed": rng.choice([15, 15, 15, 40, 400]), "slow": rng.choice([100, 119, 120, 130])}[kind] * MICROS + rng.choice([0, 0, 7])
        rows.append((us, rng.choice([0, 1, 1, 1, 1, 2, 5] if kind == "mixed" else [1, 1, 1, 1, 1, 1, 0])))
    return rows


@pytest.mark.parametrize("keep", [None, 20, 6])
def test_scan_equals_replay(keep):
    rng = random.Random(2)
    rows, want = [], []
    for i in range(120):
        own = history(rng, rng.choice([1, 4, 30, 300]), rng.choice(["steady", "jitter", "mixed", "slow"]))
        rows += [("h%d" % (i % 2), "a%03d" % i, us, n) for us, n in own]
        want += [("h%d" % (i % 2), "a%03d" % i, *hit) for hit in walk(own, 300 * MICROS, keep, 5)]
    pdf = pd.DataFrame(sorted(rows), columns=["host", "raddr_ip", "us", "n"])
    for size in (len(pdf), 97):
        parts = [pdf.iloc[i:i + size] for i in range(0, len(pdf), size)]
        got = pd.concat(list(S._beacon_scan(["host", "raddr_ip"], 300 * MICROS, keep, 5)(iter(parts))))
        got = [tuple(r) for r in got.itertuples(index=False)]
        assert len(got) == len(want) > 200
        for x, y in zip(got, sorted(want)):
            assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-12) and x[5] == pytest.approx(y[5], abs=1e-12)


def test_one_address_with_many_snapshots_is_fast():
    import time

    n = 400_000
    pdf = pd.DataFrame({"raddr_ip": "203.0.113.5", "us": np.arange(n) * 15 * MICROS, "n": 1})
    began = time.time()
    got = pd.concat(list(S._beacon_scan(["raddr_ip"], 300 * MICROS, None, 5)(iter([pdf]))))
    assert len(got) == n // 5 and time.time() - began < 20


def test_hosts_are_told_apart(spark):
    rows = [(h, "2024-01-01 00:%02d:%02d" % divmod(15 * i, 60), "203.0.113.5", 40000 + i) for h in ("a", "b") for i in range(12)]
    rows += [("c", at, ip, port) for _, at, ip, port in rows[:3]]
    snaps = (spark.createDataFrame(rows, "host string, at string, raddr_ip string, raddr_port int").selectExpr("host", "CAST(at AS TIMESTAMP) AS snapshot_ts", "raddr_ip", "raddr_port"))
    got = S.beacons(snaps, S.ticks(snaps)).groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in got} == {"a": 2, "b": 2}
