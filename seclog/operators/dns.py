"""DNS detection: names, query rate per client, NXDOMAIN rate per domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seclog import refdata as R
from seclog.functions import dns as D
from seclog.functions.text import emit
from seclog.operators.cooldown import cooldown
from seclog.operators.rates import instants, micros, sliding_sum
from seclog.storage import cut_lineage


def queries_from(entries: DataFrame) -> DataFrame:
    """(id, ts, domain, client, is_nxdomain) of the entries that hold a DNS query."""
    text = F.concat(F.col("message"), F.lit(" "), F.col("raw"))
    return D.with_query(entries.select("id", "ts", text.alias("text")), F.col("text")).drop("text")


def _rated(queries: DataFrame, key: str, seconds: int, cap: int | None, out: str, counted: DataFrame) -> DataFrame:
    rates = sliding_sum(instants(counted.withColumn("us", micros()), [key]), [key], seconds, out=out)
    amount = F.col(out) if cap is None else F.least(F.col(out), F.lit(cap))
    return queries.withColumn("us", micros()).join(rates.select(key, "us", amount.alias(out)), [key, "us"])


def dns_rate(queries: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS, cap: int | None = None) -> DataFrame:
    """Add ``rate``: queries of the same client in the last minute, ``cap`` at most if given."""
    return _rated(queries, "client", seconds, cap, "rate", queries)


def nxdomain_rate(queries: DataFrame, seconds: int = R.RATE_WINDOW_SECONDS, cap: int | None = None) -> DataFrame:
    """NXDOMAIN rows with ``nx_rate``: failures of the same domain in the last minute."""
    failed = queries.filter("is_nxdomain")
    return _rated(failed, "domain", seconds, cap, "nx_rate", failed)


def dns_signals(queries: DataFrame, rate_threshold: int = R.DNS_RATE_THRESHOLD,
                nxdomain_threshold: int = R.NXDOMAIN_THRESHOLD) -> DataFrame:
    """All findings before deduplication: (id, ts, signal, key, level, domain, client, amount)."""
    sub = D.subdomain(F.col("domain"))
    named = queries.withColumn("signal", D.name_signal(F.col("domain")))
    names = (emit(named, F.col("signal").isNotNull(), {"signal": F.col("signal")})
             .withColumns({
                 "key": F.col("domain"),
                 "level": F.when(F.col("signal") == "bad_tld", "CRITICAL").otherwise("WARNING"),
                 "amount": F.when(F.col("signal") == "entropy", F.round(D.shannon(sub), 2))
                            .when(F.col("signal") == "long", F.length(sub).cast("double")).otherwise(0.0)}))
    busy = dns_rate(queries).filter(F.col("rate") > rate_threshold).withColumns({
        "signal": F.lit("rate"), "key": F.col("client"), "level": F.lit("WARNING"),
        "amount": F.col("rate").cast("double")})
    storm = nxdomain_rate(queries).filter(F.col("nx_rate") > nxdomain_threshold).withColumns({
        "signal": F.lit("nxdomain"), "key": F.col("client"), "level": F.lit("WARNING"),
        "amount": F.col("nx_rate").cast("double")})
    columns = ["id", "ts", "signal", "key", "level", "domain", "client", "amount"]
    return names.select(columns).unionByName(busy.select(columns)).unionByName(storm.select(columns))


def dns_findings(queries: DataFrame, rate_threshold: int = R.DNS_RATE_THRESHOLD,
                 nxdomain_threshold: int = R.NXDOMAIN_THRESHOLD, carry: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Findings, each (signal, key) silent for five minutes after it fired.

    ``only`` (id) names the queries that may fire; the others count for rates. ``carry``
    (signal, key, last_us) are earlier findings.
    """
    signals = dns_signals(queries, rate_threshold, nxdomain_threshold)
    if only is not None:
        signals = signals.join(only.select("id").distinct(), "id", "left_semi")
    signals = cut_lineage(signals)
    return cooldown(signals, ["signal", "key"], R.DNS_COOLDOWN_SECONDS, carry=carry)
