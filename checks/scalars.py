"""Scalar functions, rules, techniques and text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as X
from checks.fixtures import q
from checks.registry import (ANNOTATED, DUCK, LEVELED, annotated, check, entries, level_sql, path_technique_sql,
                             pattern_technique_sql, port_technique_sql, rank_sql, resolve_sql, rule_technique_sql,
                             rules_sql, rx, severity_sql, table, technique_text, with_)
from seclog import refdata as R
from seclog.functions import dns as D, features, net, technique as T
from seclog.functions.text import (alert_level, basename, display_time, emit, json_strings, level_rank,
                                   matched_rules, octal_mode, parse_iso, parse_level, parse_octal_mode,
                                   parent_technique, rule_severity, shannon, upgraded_level)
from seclog.operators import annotate as A, scans
from seclog.schema import ENTRY
from seclog.sources import sockets, text as S

ENTRIES = X.entries(DUCK)


@check("parse_level", f"""SELECT doc_id, {level_sql('text')} AS level FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", parse_level(F.col("text")).alias("level"))


@check("parse_level_entries", with_(ENTRIES, f"SELECT id, {level_sql('message')} AS level FROM entries"))
def _(spark, sf):
    return entries(spark, sf).select("id", "level")


@check("severity_rank", with_(ENTRIES, f"SELECT id, CAST({rank_sql('(' + level_sql('message') + ')')} AS INT) AS rank FROM entries"))
def _(spark, sf):
    return entries(spark, sf).select("id", level_rank(F.col("level")).alias("rank"))


_TEXT = "concat(message, ' ', raw)"


@check("rule_match", with_(ENTRIES, f"""SELECT id, array_to_string({rules_sql(_TEXT)}, '|') AS matched_rules,
    {severity_sql(rules_sql(_TEXT))} AS severity FROM entries"""))
def _(spark, sf):
    text = F.concat("message", F.lit(" "), "raw")
    return (entries(spark, sf).select("id", matched_rules(text).alias("matched_rules"))
            .withColumn("severity", rule_severity(F.col("matched_rules"))))


@check("rule_match_documents", f"SELECT doc_id, array_to_string({rules_sql('text')}, '|') AS matched_rules FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", matched_rules(F.col("text")).alias("matched_rules"))


@check("rule_match_conversations", f"SELECT conv_id, turn, array_to_string({rules_sql('text')}, '|') AS matched_rules, {level_sql('text')} AS level FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", matched_rules(F.col("text")).alias("matched_rules"), parse_level(F.col("text")).alias("level"))


@check("rule_match_table", with_(ENTRIES, f"""SELECT id, array_to_string({rules_sql(_TEXT)}, '|') AS matched_rules
    FROM entries WHERE len({rules_sql(_TEXT)}) > 0"""))
def _(spark, sf):
    rules = spark.createDataFrame([(i, r.name, r.pattern, r.severity) for i, r in enumerate(R.RULES)],
                                  "ord int, name string, pattern string, severity string")
    return A.match_rules_table(entries(spark, sf), rules)


@check("level_upgrade", with_(LEVELED, "SELECT id, level, array_to_string(matched_rules, '|') AS matched_rules FROM leveled"))
def _(spark, sf):
    return A.apply_rules(entries(spark, sf)).select("id", "level", "matched_rules")


def _tech(expr: str) -> str:
    return f"""split_part({expr}, '|', 1) AS tactic, split_part({expr}, '|', 4) AS technique_id,
      split_part({expr}, '|', 5) AS subtechnique_id"""


def _shown(column):
    return [F.coalesce(column[f], F.lit("")).alias(f) for f in ("tactic", "technique_id", "subtechnique_id")]


@check("mitre_rule", with_(LEVELED, f"""SELECT id, {_tech('t')} FROM (SELECT id, coalesce({rule_technique_sql('matched_rules')}, '||||') AS t
    FROM leveled) x"""))
def _(spark, sf):
    ruled = A.apply_rules(entries(spark, sf)).withColumn("t", T.from_rules(F.col("matched_rules")))
    return ruled.select("id", *_shown(F.col("t")))


@check("mitre_fim", with_(ENTRIES, f"""SELECT id, {_tech('t')} FROM (SELECT id, coalesce({path_technique_sql()}, '||||') AS t
    FROM entries WHERE category = 'fim') x"""))
def _(spark, sf):
    rows = entries(spark, sf).filter("category = 'fim'").withColumn("t", T.from_path(F.col("filepath")))
    return rows.select("id", *_shown(F.col("t")))


@check("mitre_port", with_(ENTRIES, f"""SELECT id, {_tech('t')} FROM (SELECT id, coalesce({port_technique_sql()}, '||||') AS t
    FROM entries) x"""))
def _(spark, sf):
    rows = entries(spark, sf).withColumn("t", T.from_port(F.col("dst_port")))
    return rows.select("id", *_shown(F.col("t")))


@check("mitre_pattern", with_(ENTRIES, f"""SELECT id, {_tech('t')} FROM (SELECT id, coalesce({pattern_technique_sql()}, '||||') AS t
    FROM entries) x"""))
def _(spark, sf):
    rows = entries(spark, sf).withColumn("t", T.from_text(F.col("message"), F.col("raw")))
    return rows.select("id", *_shown(F.col("t")))


@check("mitre_resolve", with_(LEVELED, f"""SELECT id, {_tech('t')} FROM (SELECT id, {resolve_sql()} AS t FROM leveled) x"""))
def _(spark, sf):
    out = T.with_technique(A.apply_rules(entries(spark, sf)))
    return out.select("id", F.col("mitre_tactic").alias("tactic"), F.col("mitre_technique_id").alias("technique_id"),
                      F.col("mitre_subtechnique_id").alias("subtechnique_id"))


_PRIVATE = """(regexp_matches(ip, '^(10|127)\\.') OR regexp_matches(ip, '^192\\.168\\.')
   OR regexp_matches(ip, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR ip = '::1')"""


def _addresses(d) -> str:
    return X.base(d) + """,
addrs AS (SELECT id, CASE num % 12 WHEN 0 THEN src_ip WHEN 1 THEN concat('172.', k, '.0.1') WHEN 2 THEN concat('192.168.', k, '.9')
   WHEN 3 THEN concat('127.0.0.', h) WHEN 4 THEN '::1' WHEN 5 THEN '2001:db8::1' WHEN 6 THEN concat('192.', k + 100, '.1.1')
   WHEN 7 THEN 'bad' WHEN 8 THEN '0.0.0.0' WHEN 9 THEN concat('10.', k, '.2.3') WHEN 10 THEN '::ffff:1.2.3.4'
   ELSE concat('8.8.', k, '.8') END AS ip FROM e0)"""


@check("is_private", with_(_addresses(DUCK), f"SELECT id, ip, {_PRIVATE} AS private FROM addrs"))
def _(spark, sf):
    return X.spark_table(spark, sf, _addresses, "addrs").select("id", "ip", net.is_private(F.col("ip")).alias("private"))


@check("scan_skip", with_(_addresses(DUCK), """SELECT id, ip, (ip LIKE '127.%' OR ip LIKE '0.0.0.0%' OR ip LIKE '::%') AS skipped
    FROM addrs"""))
def _(spark, sf):
    return X.spark_table(spark, sf, _addresses, "addrs").select("id", "ip", net.is_skipped(F.col("ip")).alias("skipped"))


_PROBES = " UNION ALL ".join(
    f"""SELECT id, ts, us, regexp_extract({_TEXT}, {q(p)}, 1, 'i') AS src_ip,
    coalesce(TRY_CAST(regexp_extract({_TEXT}, {q(p)}, 2, 'i') AS INT), 0) AS dst_port, '{kind}' AS kind FROM entries
    WHERE regexp_matches({_TEXT}, {q(p)}, 'i')""" for p, kind in R.SCAN_PATTERNS)
LOG_ATTEMPTS = ENTRIES + f""",
probes AS ({_PROBES}),
log_attempts AS (SELECT *, 'log' AS method FROM probes
  WHERE NOT (src_ip LIKE '127.%' OR src_ip LIKE '0.0.0.0%' OR src_ip LIKE '::%'))"""


@check("scan_extract", with_(LOG_ATTEMPTS, "SELECT id, src_ip, dst_port, kind FROM log_attempts"))
def _(spark, sf):
    return scans.log_attempts(entries(spark, sf)).select("id", "src_ip", "dst_port", "kind")


def dns_sql() -> str:
    """Extraction spelled out per pattern: last dotted quad is the client, other dotted text the domain."""
    quad = r"^\d{1,3}(\.\d{1,3}){3}$"
    doms, quads = [], []
    for p, n in zip(R.DNS_PATTERNS, R.DNS_GROUPS):
        groups = [f"regexp_extract(txt, {q(p)}, {g}, 'i')" for g in range(n, 0, -1)]
        doms.append("nullif(coalesce(%s), '')" % ", ".join(
            f"CASE WHEN NOT regexp_matches({g}, {q(quad)}) AND contains({g}, '.') AND length({g}) > 4 THEN rtrim(lower({g}), '.') END"
            for g in groups))
        quads.append("coalesce(%s)" % ", ".join(f"CASE WHEN regexp_matches({g}, {q(quad)}) THEN {g} END" for g in groups)
                     if n > 1 else "CASE WHEN regexp_matches(%s, %s) THEN %s END" % (groups[0], q(quad), groups[0]))
    cols = ", ".join([f"{x} AS d{i}" for i, x in enumerate(doms)] + [f"{x} AS q{i}" for i, x in enumerate(quads)])
    client = "CASE %s END" % " ".join(
        f"WHEN d{i} IS NOT NULL THEN coalesce({', '.join(f'q{j}' for j in range(i, -1, -1))}, 'unknown')" for i in range(len(doms)))
    return f""",
dns_parts AS (SELECT id, ts, txt, {cols} FROM (SELECT *, concat(message, ' ', raw) AS txt FROM dns_text) x),
queries AS (SELECT id, ts, epoch_us(ts) AS us, coalesce(d0, d1, d2, d3, d4) AS domain, {client} AS client,
    contains(upper(txt), 'NXDOMAIN') AS is_nxdomain FROM dns_parts WHERE coalesce(d0, d1, d2, d3, d4) IS NOT NULL)"""


DNS = X.dns(DUCK) + dns_sql()


def dns_queries(spark, sf):
    from seclog.operators.dns import queries_from

    return queries_from(X.spark_table(spark, sf, X.dns, "dns_text"))


@check("dns_extract", with_(DNS, "SELECT id, domain, client, is_nxdomain FROM queries"))
def _(spark, sf):
    return dns_queries(spark, sf).drop("ts")


def shannon_sql(column: str) -> str:
    n = f"length({column})"
    chars = f"list_distinct(regexp_extract_all({column}, '(?s).'))"
    share = f"(({n} - length(replace({column}, c, '')))::DOUBLE / {n})"
    return f"coalesce(-list_sum(list_transform({chars}, lambda c: {share} * log2({share}))), 0)"


@check("shannon", f"SELECT doc_id, round({shannon_sql('text')}, 6) AS bits FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(shannon(F.col("text")), 6).alias("bits"))


_SUB = "CASE WHEN len(string_split(domain, '.')) > 2 THEN split_part(domain, '.', 1) ELSE domain END"
_TLD = "concat('.', string_split(domain, '.')[-1])"


@check("domain_parts", with_(DNS, f"SELECT id, domain, {_SUB} AS subdomain, {_TLD} AS tld FROM queries"))
def _(spark, sf):
    return dns_queries(spark, sf).select("id", "domain", D.subdomain(F.col("domain")).alias("subdomain"),
                                         D.tld(F.col("domain")).alias("tld"))


SIGNAL = f"""CASE WHEN {_TLD} IN ({', '.join(q(t) for t in R.BAD_TLDS)}) THEN 'bad_tld'
  WHEN {shannon_sql('(' + _SUB + ')')} > {R.DNS_ENTROPY_THRESHOLD} AND length({_SUB}) > 10 THEN 'entropy'
  WHEN length({_SUB}) > 50 THEN 'long' END"""


@check("dns_name_findings", with_(DNS, f"SELECT id, domain, {SIGNAL} AS signal FROM queries WHERE {SIGNAL} IS NOT NULL"))
def _(spark, sf):
    signal = D.name_signal(F.col("domain"))
    return emit(dns_queries(spark, sf).select("id", "domain"), signal.isNotNull(), {"signal": signal})


_BUCKET = "(" + " + ".join(
    f"(('0x' || substr(md5(source), {8 * i + 1}, 8))::BIGINT % 100) * {w}" for i, w in enumerate([36, 16, 96, 1])) + ") % 100 / 100.0"


def _flag(column: str, *words: str) -> str:
    return f"CASE WHEN {' OR '.join(f'contains(lower({column}), {q(w)})' for w in words)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


FEATURES_SQL = f"""SELECT id, CAST({rank_sql('level')} AS DOUBLE) AS f_level, round(ln(1 + length(message)), 6) AS f_length,
    round(hour(ts) / 23.0, 6) AS f_hour, CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f_weekend,
    {_flag('message', 'error', 'fail')} AS f_error, {_flag('message', 'warn')} AS f_warn,
    {_flag('message', 'sudo', 'root')} AS f_root, {_flag('message', 'ssh', 'login')} AS f_login,
    {_flag('message', 'wget', 'curl')} AS f_download, CAST(round({_BUCKET}, 6) AS DOUBLE) AS f_source FROM leveled"""


@check("featurize", with_(LEVELED, FEATURES_SQL))
def _(spark, sf):
    from seclog.operators.forest import feature_rows

    rows = feature_rows(A.apply_rules(entries(spark, sf))).drop("ts")
    return rows.withColumns({c: F.round(c, 6) for c in features.NAMES})


@check("md5_bucket", with_(ENTRIES, f"SELECT id, CAST(round({_BUCKET}, 6) AS DOUBLE) AS bucket FROM entries"))
def _(spark, sf):
    return entries(spark, sf).select("id", F.round(features.md5_bucket(F.col("source")), 6).alias("bucket"))


@check("alert_level", with_(LEVELED, """SELECT id, CASE WHEN level = 'CRITICAL' THEN 'critical'
    WHEN level IN ('ERROR', 'WARNING') THEN 'warning' ELSE 'info' END AS alert_level FROM leveled"""))
def _(spark, sf):
    return A.apply_rules(entries(spark, sf)).select("id", alert_level(F.col("level")).alias("alert_level"))


@check("correlation_key", with_(ENTRIES, """SELECT id, coalesce(nullif(CASE WHEN num % 3 = 0 THEN '' ELSE src_ip END, ''),
    split_part(source, '/', 1)) AS key FROM entries"""))
def _(spark, sf):
    from seclog.operators.correlate import correlation_key

    rows = X.spark_table(spark, sf, X.entries, "entries")
    blank = F.when(F.col("num") % 3 == 0, "").otherwise(F.col("src_ip"))
    return rows.withColumn("src_ip", blank).select("id", correlation_key().alias("key"))


@check("ts_formats", with_(ENTRIES, """SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown,
    date_trunc('minute', ts) AS minute, CASE WHEN num % 7 = 0 THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM entries"""))
def _(spark, sf):
    rows = X.spark_table(spark, sf, X.entries, "entries")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = (F.when(F.col("num") % 7 == 0, F.concat(F.lit("x"), text)).when(F.col("num") % 7 == 1, F.concat(text, F.lit("Z")))
               .when(F.col("num") % 7 == 2, F.concat(text, F.lit("+0000"))).otherwise(text))
    return rows.select("id", display_time(F.col("ts")).alias("shown"), F.date_trunc("minute", "ts").alias("minute"),
                       parse_iso(written).alias("parsed"))


@check("octal_mode", """SELECT doc_id, concat('0o', to_base(n_chars % 4096, 8)) AS octal, CAST(n_chars % 4096 AS INT) AS back FROM documents""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", octal_mode(F.col("n_chars") % 4096).alias("octal"))
    return rows.withColumn("back", parse_octal_mode(F.col("octal")))


@check("json_arrays", with_(LEVELED, """SELECT id, array_to_string(CASE WHEN num % 5 = 0 THEN [] ELSE matched_rules END, '|') AS rules
    FROM leveled"""))
def _(spark, sf):
    rows = A.apply_rules(entries(spark, sf)).withColumn("num", F.col("id").cast("bigint"))
    text = F.when(F.col("num") % 5 == 0, F.lit("{broken")).otherwise(F.to_json("matched_rules"))
    return rows.select("id", json_strings(text).alias("rules"))


@check("path_pieces", with_(ENTRIES, f"""SELECT id, regexp_extract(filepath, '[^/]*$') AS name, split_part(split_part({path_technique_sql()}, '|', 5), '.', 1) AS parent
    FROM entries WHERE category = 'fim' AND {path_technique_sql()} IS NOT NULL"""))
def _(spark, sf):
    rows = entries(spark, sf).filter("category = 'fim'").withColumn("t", T.from_path(F.col("filepath")))
    return rows.filter("t IS NOT NULL").select("id", basename(F.col("filepath")).alias("name"),
                                               parent_technique(F.col("t.subtechnique_id")).alias("parent"))


# --- sources ------------------------------------------------------------------------

_SYSLOG = X.syslog_lines(DUCK)
_PAT = q(R.SYSLOG_PATTERN)


@check("parse_syslog", with_(_SYSLOG, f"""SELECT id, CASE WHEN proc <> '' THEN concat('auth/', proc) ELSE 'auth' END AS source, message,
    {level_sql('message')} AS level, raw, coalesce(CASE WHEN proc <> '' THEN try_strptime(concat('2024 ', stamp), '%Y %b %d %H:%M:%S') END,
      TIMESTAMP '{X.AS_OF}') AS ts
  FROM (SELECT id, trim(value) AS raw, regexp_extract(trim(value), {_PAT}, 1) AS stamp, regexp_extract(trim(value), {_PAT}, 2) AS proc,
    CASE WHEN regexp_matches(trim(value), {_PAT}) THEN regexp_extract(trim(value), {_PAT}, 3) ELSE trim(value) END AS message FROM lines) x"""))
def _(spark, sf):
    lines = X.spark_table(spark, sf, X.syslog_lines, "lines")
    return S.parse_syslog(lines, 2024, X.AS_OF, "auth").select("id", "source", "message", "level", "raw", "ts")


@check("entry_ids", with_(ENTRIES, """SELECT sha256(concat(source, chr(1), message, chr(1), occurrence)) AS id, source, occurrence
  FROM (SELECT source, message, CAST(row_number() OVER (PARTITION BY source, message) AS BIGINT) AS occurrence FROM entries) x"""))
def _(spark, sf):
    copies = S.number_copies(entries(spark, sf).select("source", "message"), ["source", "message"])
    return copies.withColumn("id", S.entry_id("source", "message", "occurrence")).select("id", "source", "occurrence")


@check("parse_journald", with_(X.journald_lines(DUCK), f"""SELECT id,
    CASE WHEN t = 0 THEN TIMESTAMP '{X.AS_OF}' ELSE make_timestamp(t) END AS ts,
    CASE p WHEN '0' THEN 'CRITICAL' WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'CRITICAL' WHEN '3' THEN 'ERROR' WHEN '4' THEN 'WARNING'
      WHEN '7' THEN 'DEBUG' ELSE 'INFO' END AS level,
    concat(coalesce(ident, comm, 'journald'), CASE WHEN unit IS NULL THEN '' ELSE concat('(', unit, ')') END) AS source,
    CASE WHEN json_type(value, '$.MESSAGE') = 'ARRAY' THEN concat(json_extract_string(value, '$.MESSAGE[0]'), ' part two')
      ELSE json_extract_string(value, '$.MESSAGE') END AS message, value AS raw
  FROM (SELECT id, value, CAST(json_extract_string(value, '$.__REALTIME_TIMESTAMP') AS BIGINT) AS t, json_extract_string(value, '$.PRIORITY') AS p,
    json_extract_string(value, '$.SYSLOG_IDENTIFIER') AS ident, json_extract_string(value, '$._COMM') AS comm,
    json_extract_string(value, '$._SYSTEMD_UNIT') AS unit FROM lines WHERE json_valid(value)) x"""))
def _(spark, sf):
    lines = X.spark_table(spark, sf, X.journald_lines, "lines")
    return S.parse_journald(lines, X.AS_OF).select("id", "ts", "level", "source", "message", "raw")


def _unified(d) -> str:
    kinds = [q(k) for k in ["Default", "Info", "Debug", "Error", "Fault", "Odd"]]
    return X.base(d) + f""",
items AS (SELECT num % 3 AS doc, num, concat('{{"messageType":"', {d.pick(kinds, 'num % 6 + 1')}, '","timestamp":"',
    CASE WHEN num % 5 = 0 THEN 'soon' ELSE concat('2024-01-01T00:00:', lpad(CAST(num % 60 AS {d.text}), 2, '0'),
      CASE WHEN num % 2 = 0 THEN 'Z' ELSE '+0000' END) END, '","process":"p', h, '","subsystem":"',
    CASE WHEN num % 3 = 0 THEN '' ELSE 'com.x' END, '","eventMessage":"', message,
    CASE WHEN num % 7 = 0 THEN repeat(' and so on', 120) ELSE '' END, '"}}') AS item FROM e0)"""


CAPTURE = 5000


def captures(items):
    """(doc, value): captures of ``CAPTURE`` items at most, so their number grows with the table; three sets of them, by ``doc``."""
    part = F.floor(F.col("num") / (3 * CAPTURE))
    return (items.groupBy("doc", part.alias("part"))
            .agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("value")).drop("part"))


@check("parse_unified_log", with_(_unified(DUCK), f"""SELECT doc, item AS raw,
    CASE WHEN json_extract_string(item, '$.timestamp') = 'soon' THEN TIMESTAMP '{X.AS_OF}'
      ELSE strptime(left(json_extract_string(item, '$.timestamp'), 19), '%Y-%m-%dT%H:%M:%S') END AS ts,
    CASE json_extract_string(item, '$.messageType') WHEN 'Debug' THEN 'DEBUG' WHEN 'Error' THEN 'ERROR' WHEN 'Fault' THEN 'CRITICAL' ELSE 'INFO' END AS level,
    concat(json_extract_string(item, '$.process'), CASE WHEN json_extract_string(item, '$.subsystem') = '' THEN ''
      ELSE concat('/', json_extract_string(item, '$.subsystem')) END) AS source,
    json_extract_string(item, '$.eventMessage') AS message FROM items"""))
def _(spark, sf):
    items = X.spark_table(spark, sf, _unified, "items")
    documents = captures(items)
    return S.parse_unified_log(documents, X.AS_OF).select("doc", "raw", "ts", "level", "source", "message")


def _wevt(d) -> str:
    return X.base(d) + f""",
records AS (SELECT id, num, k, h, message, concat('Event[0]:', chr(10), '  Log Name: System', chr(10), '  Date: 2024-01-01T00:00:',
    lpad(CAST(num % 60 AS {d.text}), 2, '0'), chr(10), '  Level: ', {d.pick([q(x) for x in ['Information', 'Verbose', 'Warning', 'Error', 'Critical', 'Odd']], 'num % 6 + 1')}, chr(10),
    CASE WHEN num % 4 = 0 THEN '' ELSE concat('  Provider: Prov', h, chr(10)) END,
    CASE WHEN num % 21 = 0 THEN concat('  Message: ', message, repeat(' and so on', 80), num) WHEN num % 3 = 0 THEN concat('  Message: ', message) ELSE concat('  Description: old', chr(10), '  Description: ', message) END, chr(10)) AS value FROM e0)"""


@check("parse_wevt", with_(_wevt(DUCK), """SELECT id, make_timestamp(1704067200000000 + (num % 60) * 1000000) AS ts,
    CASE num % 6 WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'CRITICAL' ELSE 'INFO' END AS level,
    CASE WHEN num % 4 = 0 THEN 'System/System' ELSE concat('System/Prov', h) END AS source,
    CASE WHEN num % 21 = 0 THEN concat(message, repeat(' and so on', 80), num) ELSE message END AS message FROM records"""))
def _(spark, sf):
    records = X.spark_table(spark, sf, _wevt, "records").select("id", "value")
    return S.parse_wevt_text(records, "System", X.AS_OF).select("id", "ts", "level", "source", "message")


@check("winevents", with_(X.winevents(DUCK), """SELECT id, ts, concat(channel, '/', source_name) AS source,
    CASE event_type WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARNING' WHEN 16 THEN 'WARNING' ELSE 'INFO' END AS level, message,
    concat('EventID=', event_id, ' Src=', source_name) AS raw
  FROM winevents"""))
def _(spark, sf):
    events = X.spark_table(spark, sf, X.winevents, "winevents")
    return S.from_winevents(events).select("id", "ts", "source", "level", "message", "raw")


@check("parse_proc_tcp", with_(X.proc_lines(DUCK), """SELECT id, CASE WHEN num % 9 = 1 THEN '2001:db8::1' ELSE src_ip END AS src_ip,
    CAST(dst_port AS INT) AS dst_port FROM e0 WHERE num % 9 <> 0 AND num % 4 < 2"""))
def _(spark, sf):
    return sockets.parse_proc_net_tcp(X.spark_table(spark, sf, X.proc_lines, "lines")).select("id", "src_ip", "dst_port")


@check("parse_ss", with_(X.ss_lines(DUCK), """SELECT id, CASE WHEN num % 9 = 2 THEN concat('2001:db8::', h) ELSE src_ip END AS src_ip,
    CAST(dst_port AS INT) AS dst_port FROM e0 WHERE num % 9 NOT IN (0, 1, 3)"""))
def _(spark, sf):
    return sockets.parse_ss(X.spark_table(spark, sf, X.ss_lines, "lines")).select("id", "src_ip", "dst_port")


@check("entry_json", with_(ANNOTATED, """SELECT id, CAST(to_json({%s}) AS VARCHAR) AS json FROM ann""" % ", ".join(
    ["'id': id", "'timestamp': CASE WHEN us % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"]
    + [f"'{name}': {name}" for name in ENTRY if name not in ("id", "ts")])))
def _(spark, sf):
    return A.entries_to_json(annotated(spark, sf))
