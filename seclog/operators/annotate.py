"""Rules, levels, scores and techniques on entries, and the whole pipeline."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seclog import refdata as R
from seclog.functions.technique import with_technique
from seclog.functions.text import folded, iso, matched_rules, required_texts, rule_severity, rx, upgraded_level, usable_rules
from seclog.operators import alerts as A, correlate as C, dns as D, findings, scans
from seclog.operators.rates import combine_scores, rate_anomaly
from seclog.schema import ENTRY, complete
from seclog.storage import cut_lineage


def apply_rules(entries: DataFrame, rules=R.RULES) -> DataFrame:
    """Set matched_rules and raise the level; entries without a hit keep both."""
    text = F.concat(F.col("message"), F.lit(" "), F.col("raw"))
    out = entries.withColumn("_hit", matched_rules(text, rules))
    hit = F.size("_hit") > 0
    return out.withColumns({
        "level": F.when(hit, upgraded_level(F.col("level"), rule_severity(F.col("_hit"), rules))).otherwise(F.col("level")),
        "matched_rules": F.when(hit, F.col("_hit")).otherwise(F.col("matched_rules"))}).drop("_hit")


@functools.cache
def _automaton(needed: tuple[tuple[str, tuple[int, ...]], ...]):
    """Aho-Corasick automaton of texts and the rules that need them; one for each worker."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, rules in needed:
        automaton.add_word(text, rules)
    automaton.make_automaton()
    return automaton


def _candidates(needed: tuple[tuple[str, tuple[int, ...]], ...], always: tuple[int, ...]):
    """Rules that may hit a folded text: those one of whose required texts it holds, and those without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(needed) if needed else None
        for batch in batches:
            found = []
            for low in batch.column("_low").to_pylist():
                hit = set(always)
                if automaton is not None and low:
                    for _, rules in automaton.iter(low):
                        hit.update(rules)
                found.append(sorted(hit))
            yield pa.record_batch([batch.column("id"), batch.column("_text"), pa.array(found, pa.list_(pa.int32()))], ["id", "_text", "_rules"]).filter(
                pa.array([bool(x) for x in found], pa.bool_()))

    return run


def hits_only(matched: DataFrame) -> DataFrame:
    """(id, matched_rules) of the rows with a hit, as a generator like ``emit``: a filter would be copied down to the
    scan, run every rule again there, and on as few tasks as the file has row groups."""
    names = F.col("matched_rules")
    return matched.select("id", F.explode(F.when(F.size(names) > 0, F.array(names))).alias("matched_rules"))


def match_many_rules(entries: DataFrame, rules: list) -> DataFrame:
    """(id, names in rule order) of the entries that any of ``rules`` hits, for thousands of rules.

    One automaton finds, in one pass over a text, which rules it can hit at all; only those
    regexes run. So the time follows the texts and their hits, not the number of rules. Rules
    without a required text are tried on every entry.
    """
    usable = usable_rules(rules)
    needed: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(usable):
        texts = required_texts(rule.pattern)
        for text in texts or ():
            needed.setdefault(text, []).append(i)
        if texts is None:
            always.append(i)
    table = tuple(sorted((text, tuple(own)) for text, own in needed.items()))
    text = F.concat("message", F.lit(" "), "raw")
    named = [F.from_json(F.lit(json.dumps(x)), "array<string>") for x in ([rx(r.pattern) for r in usable], [r.name for r in usable])]
    found = (entries.select("id", text.alias("_text")).select("id", "_text", folded(F.col("_text")).alias("_low"))
             .mapInArrow(_candidates(table, tuple(always)), "id string, _text string, _rules array<int>"))
    hits = F.filter("_rules", lambda i: F.regexp_like(F.col("_text"), F.element_at(named[0], i + 1)))
    return hits_only(found.select("id", hits.alias("_hits")).select(
        "id", F.transform("_hits", lambda i: F.element_at(named[1], i + 1)).alias("matched_rules")))


def match_rules_table(entries: DataFrame, rules: DataFrame, per_expression: int = 200) -> DataFrame:
    """Rules held in a table (ord, name, pattern, severity): (id, names in rule order).

    A pattern test has no key to shuffle on, so the rules, a list that people maintain, are
    read by the driver. Up to ``per_expression`` become one expression; more of them go through
    ``match_many_rules``. Malformed patterns are skipped.
    """
    listed = [R.Rule(r.name, r.pattern, r.severity) for r in rules.orderBy("ord").collect()]
    if len(listed) > per_expression:
        return match_many_rules(entries, listed)
    text = F.concat("message", F.lit(" "), "raw")
    return hits_only(entries.select("id", matched_rules(text, listed).alias("matched_rules")))


def annotate(entries: DataFrame, rules=R.RULES, preserve_preset: bool = False, history: DataFrame | None = None,
             forest: DataFrame | None = None, ruled: bool = False) -> DataFrame:
    """Rules, technique and anomaly score, the larger one of rates and forest.

    The technique needs no score, so all text work is done before the rows are shuffled.
    ``forest`` (id, forest_anomaly, forest_score) comes from ``forest.forest_scores``; entries may also carry
    the two columns themselves (``forest.scored_entries``).
    ``ruled`` entries went through ``apply_rules`` already.
    """
    texts = with_technique(entries if ruled else apply_rules(entries, rules))
    scored = rate_anomaly(texts, history=history)
    if forest is not None:
        # Equal findings share an id, and their scores.
        scored = scored.join(forest.select("id", "forest_anomaly", "forest_score").dropDuplicates(["id"]), "id", "left").withColumns({
            "forest_anomaly": F.coalesce("forest_anomaly", F.lit(False)), "forest_score": F.coalesce("forest_score", F.lit(0.0))})
    return combine_scores(scored, preserve_preset)


def channel(category: Column) -> Column:
    return (F.when(category.isin("network", "portscan"), "network").when(category == "fim", "fim").otherwise("log"))


def with_channel(entries: DataFrame) -> DataFrame:
    return entries.withColumn("channel", channel(F.col("category")))


def entry_json() -> Column:
    """An entry's 23 fields as JSON text."""
    fields = {name: F.col(name) for name in ENTRY if name != "ts"}
    fields["anomaly_score"] = F.round("anomaly_score", 4)
    order = ["id", "timestamp"] + [name for name in ENTRY if name not in ("id", "ts")]
    fields["timestamp"] = iso(F.col("ts"))
    return F.to_json(F.struct(*[fields[name].alias(name) for name in order]))


def entries_to_json(entries: DataFrame) -> DataFrame:
    """(id, json) with the 23 entry fields."""
    return entries.select("id", entry_json().alias("json"))


def route(entries: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, int]:
    """Hand each channel's entries to its sink; the number handed to each.

    The entries are computed once and stored by channel, so a sink reads its own part only.
    Channels without a sink are stored and left alone.
    """
    stored = cut_lineage(with_channel(complete(entries)), "channel")
    counts = {r["channel"]: r["count"] for r in stored.groupBy("channel").count().collect()}  # three channels
    for name, sink in sinks.items():
        sink(stored.filter(F.col("channel") == name))
    return {name: counts.get(name, 0) for name in sinks}


@dataclass(frozen=True)
class PipelineResult:
    entries: DataFrame
    fires: DataFrame

    @functools.cached_property
    def alerts(self) -> DataFrame:
        """Made when first asked for, since it runs jobs of its own."""
        return A.alerts_from(self.entries)


def run_pipeline(entries: DataFrame, rules=R.RULES, chains=R.CHAINS, forest: DataFrame | None = None,
                 monitors: tuple[DataFrame, ...] = (), sockets: DataFrame | None = None, dns: bool = False,
                 ruled: bool = False) -> PipelineResult:
    """Annotate, detect chains and scans, and raise alerts.

    ``forest`` are scores of the entries; ``monitors`` are entries that snapshot, process and
    file detectors made (``findings``), annotated with the rest but keeping a higher preset
    score; ``sockets`` are attempts read from socket captures; ``dns`` adds the findings of
    names and rates in the log text. Chain, scan and DNS findings join the stored entries
    with their preset score and skip rules and scoring; scans get a technique, chains bring
    their own. ``ruled`` entries and monitors went through ``apply_rules`` already, as a caller that
    needs their levels for the forest stores them; if entries carry forest scores, monitors must too.
    """
    scores = [c for c in ("forest_anomaly", "forest_score") if c in entries.columns]
    rows = complete(entries, *scores)
    for found in monitors:
        rows = rows.unionByName(complete(found, *scores))
    annotated = cut_lineage(annotate(rows, rules, preserve_preset=bool(monitors), forest=forest, ruled=ruled))
    fired = cut_lineage(C.correlate(annotated, chains))
    attempts = scans.log_attempts(annotated.filter(F.col("category") == "log"))
    links = annotated.filter((F.col("category") == "network") & (F.col("src_ip") != "") & (F.col("dst_port") != 0))
    feeds = [scans.connection_attempts(links)] + ([] if sockets is None else [sockets.select(attempts.columns)])
    attempts = cut_lineage(scans.scan_attempts(attempts, *feeds))
    found = with_technique(findings.from_port_scans(scans.port_scans(attempts)))
    if dns:
        # Read for names, client rates and domain rates; the texts are searched once.
        named = D.dns_findings(cut_lineage(D.queries_from(annotated.filter(F.col("category") == "log"))))
        found = found.unionByName(with_technique(findings.from_dns(named)))
    everything = annotated.unionByName(cut_lineage(found.unionByName(findings.from_chains(fired))))
    return PipelineResult(with_channel(everything), fired)
