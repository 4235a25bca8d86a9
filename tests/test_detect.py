"""Detectors against brute force on small skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from seclog import refdata as R
from seclog.operators import correlate as C, forest as FO, rates, scans
from seclog.operators.cooldown import cooldown

SECOND = 1_000_000
T0 = 1_704_067_200 * SECOND


def events(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl).withColumn("ts", F.timestamp_micros("us"))


def skewed(seed, n=400, span=2000):
    """A third of all rows on one key; many equal instants."""
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.4 else "k%d" % rng.randrange(5), T0 + rng.randrange(span) * SECOND // 2) for i in range(n)]


def passing(rows, gap):
    last, out = {}, set()
    for i, key, us in sorted(rows, key=lambda r: (r[2], r[0])):
        if key not in last or us - last[key] >= gap * SECOND:
            last[key] = us
            out.add(i)
    return out


@pytest.mark.parametrize("gap,fan,levels", [(30, 2, 1), (30, 3, 2), (7, 2, 3), (300, 16, 2)])
def test_cooldown(spark, gap, fan, levels):
    rows = skewed(gap)
    df = events(spark, rows, "id int, key string, us bigint")
    assert {r.id for r in cooldown(df, ["key"], gap, fan=fan, levels=levels).collect()} == passing(rows, gap)


def test_cooldown_with_carry(spark):
    rows = skewed(5)
    half = T0 + 500 * SECOND
    want = passing(rows, 45)
    early = [r for r in rows if r[2] < half]
    last = {}
    for i, key, us in early:
        if i in want:
            last[key] = max(us, last.get(key, 0))
    carry = spark.createDataFrame(list(last.items()), "key string, last_us bigint")
    late = events(spark, [r for r in rows if r[2] >= half], "id int, key string, us bigint")
    got = {r.id for r in cooldown(late, ["key"], 45, carry=carry).collect()}
    assert got == {i for i, _, us in rows if i in want and us >= half}


def test_rates(spark):
    rows = skewed(3)
    df = events(spark, rows, "id int, source string, us bigint").drop("us")
    got = {(r.source, r.us): (r.source_rate, r.global_rate, r.sources_seen) for r in rates.rate_table(df).collect()}
    for _, source, us in rows:
        near = [r for r in rows if us - 60 * SECOND <= r[2] <= us]
        assert got[source, us] == (sum(r[1] == source for r in near), len(near), len({r[1] for r in rows if r[2] <= us}))


def test_rates_with_history(spark):
    rows = skewed(4)
    half = T0 + 500 * SECOND
    make = lambda part: events(spark, part, "id int, source string, us bigint").drop("us")
    whole = {(r.source, r.us): r for r in rates.rate_table(make(rows)).collect()}
    history = rates.rate_history(make([r for r in rows if r[2] < half]), None)
    late = rates.rate_table(make([r for r in rows if r[2] >= half]), history=history).filter(F.col("us") >= half).collect()
    assert late and all(whole[r.source, r.us] == r for r in late)


def test_fanout(spark):
    rng = random.Random(1)
    rows = [(i, key, us, rng.choice([0, 0, 22, 80, 443, 1000 + rng.randrange(30)])) for i, key, us in skewed(9, 300, 600)]
    df = events(spark, rows, "id int, src_ip string, us bigint, dst_port int").drop("us")
    got = {(r.src_ip, r.us): (r.unique_ports, r.attempts) for r in scans.fanout_table(df).collect()}
    for _, ip, us, _ in rows:
        ports = [p for _, k, t, p in rows if k == ip and us - 60 * SECOND <= t <= us and p]
        assert got[ip, us] == (len(set(ports)), len(ports))


def chains_by_replay(rows, chains):
    """Entry by entry, as stated in the operator's description."""
    minute = 60 * SECOND
    history = max(c.window_minutes for c in chains) * minute
    times, fired, out = {}, {}, set()
    for i, key, us, tactic in sorted(rows, key=lambda r: (r[2], r[0])):
        held = times.setdefault(key, {})
        held.setdefault(tactic, []).append(us)
        for t in held:
            held[t] = [x for x in held[t] if x >= us - history]
        for no, chain in enumerate(chains):
            window = chain.window_minutes * minute
            hit = any(all(any(a - window <= x <= a for x in held.get(t, [])) for t in chain.tactics)
                      for a in held.get(chain.tactics[-1], []))
            if hit and us - fired.get((key, no), -10**18) >= chain.cooldown_minutes * minute:
                fired[key, no] = us
                out.add((key, i, no))
                break
    return out


@pytest.mark.parametrize("seed,step", [(1, 60), (2, 1)])
def test_chains(spark, seed, step):
    """Also with many entries at one instant (step 1: 900 rows over 30 instants)."""
    rng = random.Random(seed)
    tactics = [name for _, name in R.TACTICS]
    n, instants = (500, 500) if step == 60 else (900, 30)
    rows = [(i, "hot" if rng.random() < 0.4 else "k%d" % rng.randrange(3), T0 + rng.randrange(instants) * 60 * SECOND * (1 if step == 60 else 10),
             rng.choice(tactics)) for i in range(n)]
    df = events(spark, rows, "id int, src_ip string, us bigint, mitre_tactic string").withColumn("source", F.lit("s"))
    got = {(r.key, r.id, r.chain_no) for r in C.fires(df).collect()}
    assert got == chains_by_replay(rows, R.CHAINS)


def test_strict_order_fires_less(spark):
    rows = [(0, "a", T0, "Credential Access"), (1, "a", T0 + SECOND, "Discovery"), (2, "a", T0 + 2 * SECOND, "Credential Access")]
    df = events(spark, rows[:2], "id int, src_ip string, us bigint, mitre_tactic string").withColumn("source", F.lit("s"))
    assert C.fires(df, strict_order=True).isEmpty()
    df = events(spark, rows, "id int, src_ip string, us bigint, mitre_tactic string").withColumn("source", F.lit("s"))
    assert [(r.id, r.chain_no) for r in C.fires(df, strict_order=True).collect()] == [(2, 6)]


def test_forest(spark, sf, tmp_path):
    from checks import registry

    features = FO.feature_rows(registry.entries(spark, sf))
    model = FO.retrain(features, trees=20)
    path = str(tmp_path / "forest")
    assert model.training.count() == features.count()
    FO.save_forest(model.forest, path, "2024-01-01 00:00:00", features.count(), 0.05, model.sample)
    forest, meta = FO.load_forest(spark, path)
    assert meta.train_size == features.count() and forest.select("tree_id").distinct().count() == 20
    raw = FO.score_forest(features, FO.forest_nodes(forest), model.sample)
    assert raw.filter("raw_score >= 0 OR raw_score <= -1").isEmpty() and raw.count() == features.count()
    scored = FO.forest_scores(features, forest, model.training, model.sample)
    share = scored.filter("forest_anomaly").count() / scored.count()
    assert 0 < share < 0.15
    assert FO.retrain(features.limit(50)) is None
    # The same forest again after a restart of its tasks.
    assert FO.fit_forest(model.training, 20, model.sample).exceptAll(forest).isEmpty()


def test_no_gap_silences_nothing(spark):
    from seclog.operators.cooldown import cooldown

    rows = events(spark, [(1, "a", T0), (2, "a", T0), (3, "a", T0 + 1), (4, "b", T0)], "id int, k string, us bigint")
    assert sorted(r.id for r in cooldown(rows, ["k"], 0).collect()) == [1, 3, 4]


def test_hosts_have_clocks_of_their_own(spark):
    """Two hosts polled at different times; each one's snapshots follow its own."""
    from seclog.operators import snapshots as S

    rows = []
    for host, shift in (("h1", 0), ("h2", 7)):
        for poll in range(4):
            at = T0 + (poll * 15 + shift) * SECOND
            rows.append((host, at, "10.0.0.1", 40000, "203.0.113.1", 443, 1, "ESTABLISHED", "TCP", "p"))
            if poll >= 2:
                rows.append((host, at, "10.0.0.1", 40001, "203.0.113.2", 443, 1, "ESTABLISHED", "TCP", "p"))
    snaps = spark.createDataFrame(rows, "host string, us bigint, laddr_ip string, laddr_port int, raddr_ip string, raddr_port int, pid int, "
                                        "status string, type string, proc_name string").withColumn("snapshot_ts", F.timestamp_micros("us")).drop("us")
    new = S.new_connections(snaps).collect()
    assert sorted((r.host, r.raddr_ip) for r in new) == [("h1", "203.0.113.2"), ("h2", "203.0.113.2")]
    assert {(r.host, r.prev_ts is None) for r in S.ticks(snaps).collect()} == {("h1", True), ("h1", False), ("h2", True), ("h2", False)}


def test_forest_dns_and_socket_feeds_in_the_pipeline(spark, sf):
    from checks import registry
    from seclog.operators.annotate import run_pipeline

    rows = registry.entries(spark, sf)
    some = rows.select("id", (F.xxhash64("id") % 10 == 0).alias("forest_anomaly"), F.when(F.xxhash64("id") % 10 == 0, 0.95).otherwise(0.1).alias("forest_score"))
    sockets = spark.createDataFrame([("s%d" % i, "198.51.100.9", 2000 + i) for i in range(20)], "id string, src_ip string, dst_port int").select(
        "id", F.lit("2024-01-01 00:05:00").cast("timestamp").alias("ts"), "src_ip", "dst_port", F.lit("socket").alias("kind"), F.lit("proc").alias("method"))
    plain = run_pipeline(rows).entries
    full = run_pipeline(rows, forest=some, sockets=sockets, dns=True).entries
    marked = full.join(some.filter("forest_anomaly"), "id")
    assert marked.count() > 0 and marked.filter("NOT is_anomaly OR anomaly_score < 0.95").isEmpty()
    assert full.filter("category = 'portscan' AND src_ip = '198.51.100.9' AND source <> ''").count() >= 1
    assert full.count() > plain.count()
