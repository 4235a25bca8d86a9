"""Registry of queries and oracles, and the DuckDB form of annotated entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import fixtures as X
from checks.fixtures import q
from seclog import refdata as R
from seclog.operators.annotate import annotate
from seclog.schema import complete
from seclog.storage import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DUCK = X.Duck()


def check(name: str, sql: str | None = None):
    """Register a query; its result gets plain types that both engines hash alike."""

    def register(fn):
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, arrays of text as text joined by '|'."""
    out = []
    for field in df.schema.fields:
        column = F.col("`%s`" % field.name)
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        out.append(column.alias(field.name))
    return df.select(*out)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return X.spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Fixture entries in the full schema, level taken from the text."""
    from seclog.functions.text import parse_level

    raw = X.spark_table(spark, sf, X.entries, "entries")
    return complete(raw.withColumn("level", parse_level(F.col("message"))))


_STORED: dict[tuple, DataFrame] = {}


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated entries as the engine stores them: written once per session, then read."""
    return stored(spark, sf, "entries", lambda: annotate(entries(spark, sf)))


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(build())
    return _STORED[key]


# --- DuckDB side --------------------------------------------------------------------

def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)}, 'i')"


def level_sql(column: str) -> str:
    cases = " ".join(f"WHEN {rx(column, '|'.join(words))} THEN {q(level)}" for level, words in R.LEVEL_WORDS)
    return f"CASE {cases} ELSE 'INFO' END"


def rank_sql(column: str) -> str:
    return "CASE %s %s ELSE 0 END" % (column, " ".join(f"WHEN {q(k)} THEN {v}" for k, v in R.LEVEL_RANK.items()))


def rules_sql(column: str) -> str:
    hits = ", ".join(f"CASE WHEN {rx(column, r.pattern)} THEN {q(r.name)} END" for r in R.RULES)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def technique_text(t) -> str:
    return q("|".join(t))


def severity_sql(rules: str) -> str:
    """Highest severity of a list of rule names, '' for none."""
    names = {s: [r.name for r in R.RULES if r.severity == s] for s in ("critical", "warning", "info")}
    cases = " ".join(f"WHEN list_has_any({rules}, [{', '.join(q(n) for n in ns)}]) THEN {q(s)}"
                     for s, ns in names.items() if ns)
    return f"CASE {cases} ELSE '' END"


def upgrade_sql(level: str, severity: str) -> str:
    target = f"CASE {severity} WHEN 'critical' THEN 'CRITICAL' WHEN 'warning' THEN 'WARNING' WHEN 'info' THEN 'INFO' END"
    return f"CASE WHEN ({rank_sql(f'({target})')}) > ({rank_sql(level)}) AND {severity} <> '' THEN {target} ELSE {level} END"


def rule_technique_sql(rules: str) -> str:
    cases = " ".join(f"WHEN {q(name)} THEN {technique_text(t)}" for name, t in R.RULE_TECHNIQUES.items())
    found = f"list_transform({rules}, lambda r: CASE r {cases} END)"
    return f"(list_filter({found}, lambda x: x IS NOT NULL))[1]"


def pattern_technique_sql() -> str:
    return "CASE %s END" % " ".join(
        f"WHEN {rx('message', p)} OR {rx('raw', p)} THEN {technique_text(t)}" for p, t in R.PATTERN_TECHNIQUES)


def path_technique_sql(path: str = "filepath") -> str:
    return "CASE %s END" % " ".join(f"WHEN {rx(path, p)} THEN {technique_text(t)}" for p, t in R.PATH_TECHNIQUES)


def port_technique_sql(port: str = "dst_port") -> str:
    return "CASE %s %s END" % (port, " ".join(f"WHEN {p} THEN {technique_text(t)}" for p, t in R.PORT_TECHNIQUES.items()))


def resolve_sql(rules: str = "matched_rules") -> str:
    return f"""coalesce({rule_technique_sql(rules)},
      CASE WHEN category = 'fim' AND filepath <> '' THEN {path_technique_sql()} END,
      CASE WHEN category IN ('network', 'portscan') AND dst_port <> 0 THEN {port_technique_sql()} END,
      CASE WHEN category = 'portscan' THEN {technique_text(R.PORTSCAN_TECHNIQUE)} END,
      {pattern_technique_sql()}, '||||')"""


RATES = """
firsts AS (SELECT source, min(us) AS f FROM leveled GROUP BY 1),
news AS (SELECT f AS us, count(*) AS k FROM firsts GROUP BY 1),
rates AS (SELECT l.*,
    count(*) OVER (PARTITION BY source ORDER BY l.us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS source_rate,
    count(*) OVER (ORDER BY l.us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS global_rate,
    (SELECT sum(k) FROM news n WHERE n.us <= l.us) AS sources_seen FROM leveled l)"""

LEVELED = X.entries(DUCK) + f""",
ruled AS (SELECT *, {level_sql('message')} AS level0, {rules_sql("concat(message, ' ', raw)")} AS matched_rules FROM entries),
leveled AS (SELECT * EXCLUDE (level0), {upgrade_sql('level0', severity_sql('matched_rules'))} AS level FROM ruled)"""

SCORED = LEVELED + "," + RATES + """,
scored AS (SELECT * , (source_rate > 3 * (global_rate / greatest(sources_seen, 1))) AS is_anomaly,
    round(CASE WHEN source_rate > 3 * (global_rate / greatest(sources_seen, 1))
      THEN least(0.9::DOUBLE + CASE WHEN level IN ('ERROR', 'CRITICAL') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)
      WHEN level IN ('ERROR', 'CRITICAL') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END, 4) AS anomaly_score FROM rates)"""

ANNOTATED = SCORED + f""",
resolved AS (SELECT *, {resolve_sql()} AS tech FROM scored),
ann AS (SELECT id, us, ts, source, level, message, platform, raw, is_anomaly, anomaly_score, matched_rules,
    CAST([] AS VARCHAR[]) AS tags, split_part(tech, '|', 1) AS mitre_tactic, split_part(tech, '|', 2) AS mitre_tactic_id,
    split_part(tech, '|', 3) AS mitre_technique, split_part(tech, '|', 4) AS mitre_technique_id,
    split_part(tech, '|', 5) AS mitre_subtechnique_id, category, src_ip, dst_ip, CAST(dst_port AS INT) AS dst_port, protocol, filepath,
    file_hash FROM resolved)"""


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def cooldown_sql(source: str, keys: list[str], gap_us: int, name: str = "fire") -> str:
    """CTEs: instants of ``source`` that pass, as (keys, us)."""
    ks = ", ".join(keys)
    same = " AND ".join(f"i.{k} = f.{k}" for k in keys)
    fs = ", ".join(f"f.{k}" for k in keys)
    return f"""
{name}_inst AS (SELECT DISTINCT {ks}, us FROM {source}),
{name} AS (SELECT {ks}, min(us) AS us FROM {name}_inst GROUP BY {ks}
  UNION ALL SELECT {fs}, min(i.us) AS us FROM {name} f JOIN {name}_inst i ON {same} AND i.us >= f.us + {gap_us}
  GROUP BY {fs}, f.us)"""
