"""Text log sources: syslog lines, journald and unified-log JSON, Windows event text.

Each format has a ``parse_*`` function over a DataFrame of raw text, used by the batch
reader, the streaming tail and tests alike, and a ``read_*`` function over files.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seclog import refdata as R
from seclog.functions.text import emit, lookup, parse_iso, parse_level, rx
from seclog.schema import complete
from seclog.sources import captures

COPIES_PER_TASK = 10_000


class SourceSpec(NamedTuple):
    path: str
    name: str
    enabled: bool = True
    fmt: str = "syslog"


def default_sources(platform: str = "linux") -> list[SourceSpec]:
    table = {"linux": R.LINUX_SOURCES, "darwin": R.MACOS_SOURCES}.get(platform, [])
    return [SourceSpec(path, name, enabled) for path, name, enabled in table]


def _moment(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def trimmed_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Valid UTF-8, trimmed, without blank lines."""
    text = F.regexp_replace(F.make_valid_utf8(F.col(column)), r"^(?U)\s+|\s+$", "")
    return emit(df, text != "", {column: text})


def parse_syslog(lines: DataFrame, year: int, as_of, name: Column | str, platform: str = "linux",
                 column: str = "value") -> DataFrame:
    """Entry columns from syslog lines; unreadable dates and formats take ``as_of``.

    Other columns of ``lines`` are kept.
    """
    name = F.lit(name) if isinstance(name, str) else name
    line = F.col(column)
    part = lambda i: F.regexp_extract(line, rx(R.SYSLOG_PATTERN, False), i)
    parsed = trimmed_lines(lines, column).withColumns({"_when": part(1), "_process": part(2), "_text": part(3)})
    hit = F.col("_process") != ""
    stamp = F.concat(F.lit("%d " % year), F.regexp_replace("_when", r"\s+", " "))
    message = F.when(hit, F.col("_text")).otherwise(line)
    return parsed.withColumns({
        "ts": F.coalesce(F.when(hit, F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss"))), _moment(as_of)),
        "source": F.when(hit, F.concat(name, F.lit("/"), "_process")).otherwise(name),
        "level": parse_level(message), "message": message, "raw": line,
        "platform": F.lit(platform)}).drop("_when", "_process", "_text", column)


def number_copies(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``occurrence`` 1..n to identical rows.

    Identical rows are interchangeable, so they are counted (which combines before the
    shuffle) and written out again. Only rows with large counts travel once more, spread
    over tasks in chunks.
    """
    counted = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.filter(F.col("_n") <= COPIES_PER_TASK).withColumn("occurrence", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    chunks = counted.filter(F.col("_n") > COPIES_PER_TASK).withColumn("_chunk", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / COPIES_PER_TASK).cast("bigint"))))
    first = F.col("_chunk") * COPIES_PER_TASK + 1
    last = F.least(F.col("_n"), first + (COPIES_PER_TASK - 1))
    many = chunks.repartition(*keys, "_chunk").withColumn("occurrence", F.explode(F.sequence(first, last)))
    return few.drop("_n").unionByName(many.drop("_n", "_chunk"))


def entry_id(*parts: str) -> Column:
    """Content hash: a re-read gives the same id, so appends can skip what is stored."""
    return F.sha2(F.concat_ws("\u0001", *[F.col(p).cast("string") for p in parts]), 256)


def with_ids(entries: DataFrame) -> DataFrame:
    """Content id for entries that carry ``occurrence``: the file (the source if there is none), the
    whole line and its number among equal lines. The time stays out, since a line without one
    takes it from the reader."""
    return entries.withColumn("id", entry_id("file" if "file" in entries.columns else "source", "raw", "occurrence"))


def read_syslog(spark: SparkSession, path: str, year: int, as_of, name: str | None = None,
                platform: str = "linux") -> DataFrame:
    """Whole syslog files as entries. Without a name the file name minus '.log' is used."""
    lines = trimmed_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))
    copies = number_copies(lines, ["file", "value"])
    base = F.lit(name) if name else F.replace(F.substring_index("file", "/", -1), F.lit(".log"), F.lit(""))
    return complete(with_ids(parse_syslog(copies, year, as_of, base, platform)))


JOURNALD_LINE = ("struct<PRIORITY:string,__REALTIME_TIMESTAMP:string,MESSAGE:string,SYSLOG_IDENTIFIER:string,"
                 "_COMM:string,_SYSTEMD_UNIT:string>")


def parse_journald(lines: DataFrame, as_of, column: str = "value") -> DataFrame:
    """journald JSON lines; lines that are no JSON object are dropped."""
    text = F.col(column)
    is_object = text.startswith("{") & F.get_json_object(text, "$").isNotNull()
    objects = emit(trimmed_lines(lines, column), is_object, {"_o": F.from_json(text, JOURNALD_LINE)})
    rows = objects.select(
        *lines.columns, F.coalesce("_o.__REALTIME_TIMESTAMP", F.lit("0")).try_cast("bigint").alias("_us"),
        F.coalesce("_o.PRIORITY", F.lit("6")).alias("_priority"), F.coalesce("_o.MESSAGE", F.lit("")).alias("_message"),
        F.coalesce(F.when(F.col("_o.SYSLOG_IDENTIFIER") != "", F.col("_o.SYSLOG_IDENTIFIER")),
                   F.when(F.col("_o._COMM") != "", F.col("_o._COMM")), F.lit("journald")).alias("_name"),
        F.coalesce("_o._SYSTEMD_UNIT", F.lit("")).alias("_unit")).filter(F.col("_us").isNotNull())
    listed = F.array_join(F.from_json("_message", "array<string>"), " ")
    message = F.when(F.col("_message").startswith("["), F.coalesce(listed, "_message")).otherwise(F.col("_message"))
    return rows.withColumns({
        "ts": F.when(F.col("_us") == 0, _moment(as_of)).otherwise(F.timestamp_micros("_us")),
        "source": F.when(F.col("_unit") != "", F.concat("_name", F.lit("("), "_unit", F.lit(")"))).otherwise(F.col("_name")),
        "level": lookup(R.JOURNALD_PRIORITY, F.col("_priority"), "INFO"),
        "message": message, "raw": text, "platform": F.lit("linux"),
    }).drop("_us", "_priority", "_message", "_name", "_unit", column)


def read_journald(spark: SparkSession, path: str, as_of) -> DataFrame:
    lines = trimmed_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))
    return complete(with_ids(parse_journald(number_copies(lines, ["file", "value"]), as_of)))


UNIFIED_ITEM = "struct<messageType:string,timestamp:string,process:string,subsystem:string,eventMessage:string>"


def parse_unified_log(documents: DataFrame, as_of, max_items: int | None = None, column: str = "value") -> DataFrame:
    """macOS unified-log arrays, or single objects, one document per row; ``max_items`` limits the items of each.

    Items keep their JSON text as raw.
    """
    text = F.trim(column)
    items = F.from_json(F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<string>")
    if max_items is not None:
        items = F.slice(items, 1, max_items)
    return _unified_items(documents.select("*", F.posexplode(items).alias("item_no", "_json")).drop(column), as_of)


def _unified_items(rows: DataFrame, as_of) -> DataFrame:
    """Entry columns of items (_json); items that are no objects are dropped."""
    parsed = F.from_json("_json", UNIFIED_ITEM)
    item = emit(rows, parsed.isNotNull(), {"_o": parsed})
    process = F.coalesce("_o.process", F.lit("unknown"))
    subsystem = F.coalesce("_o.subsystem", F.lit(""))
    return item.withColumns({
        "ts": F.coalesce(parse_iso(F.col("_o.timestamp")), _moment(as_of)),
        "source": F.when(subsystem != "", F.concat(process, F.lit("/"), subsystem)).otherwise(process),
        "level": lookup(R.UNIFIED_LOG_LEVEL, F.coalesce("_o.messageType", F.lit("Default")), "INFO"),
        "message": F.coalesce("_o.eventMessage", F.lit("")), "raw": F.col("_json"),
        "platform": F.lit("darwin")}).drop("_o", "_json")


def read_unified_log(spark: SparkSession, path: str, as_of, max_items: int | None = None) -> DataFrame:
    """Captures as the tool writes them, of any size: the items of a file are found by many tasks.

    An item that is no valid JSON is lost alone.
    """
    items = captures.json_objects(spark, path)
    if max_items is not None:
        items = items.filter(F.col("item_no") < max_items)
    # Their JSON text without the blanks between its parts, as items of an array have it.
    json = F.from_json(F.concat(F.lit("["), F.make_valid_utf8("text"), F.lit("]")), "array<string>")
    rows = items.select("file", "item_no", F.try_element_at(json, F.lit(1)).alias("_json"))
    return complete(_unified_items(rows, as_of).withColumn("id", entry_id("file", "item_no", "raw")))


def parse_wevt_text(documents: DataFrame, channel: Column | str, as_of, column: str = "value") -> DataFrame:
    """Windows event text: records start at a line 'Event[', the last value of a key counts."""
    records = captures.record_texts(F.col(column))
    return _event_fields(documents.select("*", F.posexplode(records).alias("item_no", "_record")).drop(column), channel, as_of)


def _event_fields(rows: DataFrame, channel: Column | str, as_of) -> DataFrame:
    """Entry columns of event records (_record)."""
    channel = F.lit(channel) if isinstance(channel, str) else channel

    def value(key: str) -> Column:
        found = F.regexp_extract_all("_record", F.lit(r"(?dm)^" + key + r"[ \t]*:[ \t]*(.*)$"), F.lit(1))
        return F.try_element_at(found, F.lit(-1))

    fields = emit(rows, F.col("_record").contains(":"), {
        "_date": value("Date"), "_level": value("Level"), "_provider": value("Provider"),
        "_text": F.coalesce(value("Description"), value("Message"), F.lit(""))})
    return fields.withColumns({
        "ts": F.coalesce(parse_iso(F.col("_date")), _moment(as_of)),
        "source": F.concat(channel, F.lit("/"), F.coalesce("_provider", channel)),
        "level": lookup(R.WINDOWS_TEXT_LEVEL, F.lower(F.coalesce("_level", F.lit(""))), "INFO"),
        "message": F.col("_text"), "raw": F.regexp_replace("_record", r"^\n+|\n+$", ""),
        "platform": F.lit("windows")}).drop("_record", "_date", "_level", "_provider", "_text")


def read_wevt_text(spark: SparkSession, path: str, channel: str, as_of) -> DataFrame:
    """Event text of any size: the records of a file are found by many tasks."""
    rows = captures.event_records(spark, path).withColumnRenamed("record", "_record")
    return complete(_event_fields(rows, channel, as_of).withColumn("id", entry_id("file", "item_no", "raw")))


def from_winevents(events: DataFrame, per_channel: int | None = None) -> DataFrame:
    """Structured Windows events (id, channel, ts, event_type, event_id, source_name, message).

    ``per_channel`` keeps only the newest of each channel.
    """
    from seclog.plans.views import latest_per_key

    if per_channel is not None:
        events = latest_per_key(events, ["channel"], per_channel, [F.desc("ts"), F.col("id")])
    return complete(events.select(
        "id", "ts", F.concat("channel", F.lit("/"), "source_name").alias("source"),
        lookup(R.WINDOWS_EVENT_TYPE, F.col("event_type"), "INFO").alias("level"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.concat(F.lit("EventID="), F.col("event_id").cast("string"), F.lit(" Src="), "source_name").alias("raw"),
        F.lit("windows").alias("platform")))


def read_sources(spark: SparkSession, specs: list[SourceSpec], year: int, as_of, platform: str = "linux") -> DataFrame:
    """Union of the enabled sources."""
    from seclog.storage import all_entries

    readers = {
        "syslog": lambda s: read_syslog(spark, s.path, year, as_of, s.name, platform),
        "journald": lambda s: read_journald(spark, s.path, as_of),
        "unified": lambda s: read_unified_log(spark, s.path, as_of),
        "wevt": lambda s: read_wevt_text(spark, s.path, s.name, as_of),
    }
    return all_entries(*[readers[s.fmt](s) for s in specs if s.enabled])
