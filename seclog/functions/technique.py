"""ATT&CK technique resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclog import refdata as R
from seclog.functions.text import first_of, folded, has, let, quoted

FIELDS = ["tactic", "tactic_id", "technique", "technique_id", "subtechnique_id"]
COLUMNS = ["mitre_" + field for field in FIELDS]


def _sql(technique: R.Technique) -> str:
    return "named_struct(%s)" % ", ".join("%s, %s" % (quoted(f), quoted(v)) for f, v in zip(FIELDS, technique))


def literal(technique: R.Technique) -> Column:
    return F.expr(_sql(technique))


def _table(techniques: dict) -> Column:
    return F.expr("map(%s)" % ", ".join("%s, %s" % (quoted(key), _sql(t)) for key, t in techniques.items()))


def from_rules(matched: Column) -> Column:
    """Technique of the first matched rule that has one."""
    known = _table(R.RULE_TECHNIQUES)
    found = F.filter(F.transform(matched, lambda r: F.try_element_at(known, r)), lambda t: t.isNotNull())
    return F.get(found, F.lit(0))


def from_path(path: Column) -> Column:
    return let(F.struct(path.alias("path"), folded(path).alias("low")), lambda p: first_of(
        [(has(p["path"], p["low"], pattern), literal(t)) for pattern, t in R.PATH_TECHNIQUES], F.lit(None)))


def from_port(port: Column) -> Column:
    return F.try_element_at(_table(R.PORT_TECHNIQUES), port)


def from_text(message: Column, raw: Column) -> Column:
    other = F.when(raw == message, F.lit("")).otherwise(raw)  # what the message shows need not be searched again
    texts = F.struct(message.alias("message"), folded(message).alias("low"),
                     other.alias("raw"), folded(other).alias("raw_low"))
    return let(texts, lambda t: first_of(
        [(has(t["message"], t["low"], pattern) | has(t["raw"], t["raw_low"], pattern), literal(technique))
         for pattern, technique in R.PATTERN_TECHNIQUES], F.lit(None)))


def resolve() -> Column:
    """Cascade over the entry columns: rules, file path, port, scan default, text."""
    network = F.col("category").isin("network", "portscan") & (F.col("dst_port") != 0)
    return F.coalesce(
        from_rules(F.col("matched_rules")),
        F.when((F.col("category") == "fim") & (F.col("filepath") != ""), from_path(F.col("filepath"))),
        F.when(network, from_port(F.col("dst_port"))),
        F.when(F.col("category") == "portscan", literal(R.PORTSCAN_TECHNIQUE)),
        from_text(F.col("message"), F.col("raw")))


def with_technique(entries: DataFrame) -> DataFrame:
    """Set the five technique columns; entries without one keep what they hold."""
    out = entries.withColumn("_technique", resolve())
    return out.withColumns({
        column: F.coalesce(F.col("_technique." + field), F.col(column))
        for column, field in zip(COLUMNS, FIELDS)}).drop("_technique")
