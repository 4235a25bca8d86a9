"""Levels, severities, rule matching and small text codecs."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, functions as F

from seclog import refdata as R

NO_STRINGS = "array<string>"


def rx(pattern: str, ignore_case: bool = True) -> str:
    """Java flags that give Unicode classes and a dot that stops at newline only."""
    return ("(?idU)" if ignore_case else "(?dU)") + pattern


def first_of(pairs, otherwise) -> Column:
    """``when`` chain over (condition, value) pairs, first hit wins."""
    chain = F
    for condition, value in pairs:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def quoted(value) -> str:
    """SQL literal of a text or number."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "CAST(NULL AS INT)" if value is None else str(value)


def literal_map(mapping: dict) -> Column:
    """Fixed mapping as one SQL literal; a Column per item would make plans slow to build."""
    return F.expr("map(%s)" % ", ".join(quoted(x) for pair in mapping.items() for x in pair))


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed mapping; unknown keys give ``default``."""
    found = F.try_element_at(literal_map(mapping), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def emit(df: DataFrame, condition: Column, columns: dict[str, Column]) -> DataFrame:
    """Add costly computed columns to the rows where ``condition`` holds; drop other rows.

    Written as a generator. The optimizer would copy later filters on plain computed
    columns below this point, expression and all, and run every regex again.
    """
    made = F.explode(F.when(condition, F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    return df.withColumn("_made", made).select(
        *[c for c in df.columns if c not in columns], *["_made." + name for name in columns])


def parse_level(message: Column) -> Column:
    found = lambda low, words: reduce(lambda a, b: a | b, [low.contains(word) for word in words])
    return let(F.lower(message), lambda low: first_of(
        [(found(low, words), F.lit(level)) for level, words in R.LEVEL_WORDS], F.lit("INFO")))


def level_rank(level: Column, default: int = 0) -> Column:
    return lookup(R.LEVEL_RANK, level, default)


def at_least(level: Column, minimum: str) -> Column:
    return level_rank(F.upper(level)) >= R.LEVEL_RANK.get(minimum.upper(), 2)


def usable_rules(rules) -> list:
    """Enabled rules whose pattern the engine that runs it can compile."""
    compiler = SparkContext._active_spark_context._jvm.java.util.regex.Pattern
    kept = []
    for rule in rules:
        try:
            compiler.compile(rx(rule.pattern))
        except (Py4JJavaError, IllegalArgumentException):
            continue
        if rule.enabled:
            kept.append(rule)
    return kept


_ATOM = re.compile(r"\\.|\[\]?[^\]]*\]|\{[^}]*\}|.", re.S)
_PLAIN_GROUP = re.compile(r"\((?:\?:)?([\w/ ]+(?:\|[\w/ ]+)*)\)")


def _unread(atom: str) -> bool:
    """An escape of unknown meaning, or a class whose end the simple reading may miss."""
    if atom[0] == "\\":
        return len(atom) < 2 or atom[1].isalnum() and atom[1] not in "dDwWsSbB"
    return atom[0] == "[" and (atom.startswith(("[]", "[^]")) or "[" in atom[1:] or atom.endswith("\\]") or atom == "[")


def required_texts(pattern: str) -> list[str] | None:
    """Lower-case texts of which any match must contain at least one; None if unknown.

    Per top-level alternative: its longest run of plain characters outside groups, or the
    choices of a group of plain words. Short runs filter too little to be of use. Escapes
    other than marks and the plain classes, and classes with brackets in them, are not read.
    """
    if re.search(r"\(\?[^:=!<]", pattern) or not pattern.isascii() or any(map(_unread, _ATOM.findall(pattern))):
        return None
    needed: list[str] = []
    runs, groups, group, depth, closed = [""], [], "", 0, False
    for atom in _ATOM.findall(pattern) + ["|"]:
        optional, after_group, closed = atom[0] in "?*{", closed, False
        if depth:
            group += atom
            depth += {"(": 1, ")": -1}.get(atom, 0)
            if not depth:
                groups.append(group)
                closed = True
        elif atom == "(":
            group, depth = atom, 1
            runs.append("")
        elif atom == "|":
            plain = [m.group(1).split("|") for m in map(_PLAIN_GROUP.fullmatch, groups) if m]
            longest = max(runs, key=len)
            if len(longest) < 3 and not plain:
                return None
            needed.extend([longest] if len(longest) >= 3 else plain[0])
            runs, groups = [""], []
        elif optional and after_group:
            groups.pop()
        elif optional:
            runs[-1] = runs[-1][:-1]
            runs.append("")
        elif atom in ".^$+" or len(atom) > 1 and (atom[0] == "[" or atom[1].isalnum()):
            runs.append("")
        else:
            runs[-1] += atom[-1]
    return sorted({text.lower() for text in needed})


def folded(text: Column) -> Column:
    """Lower case, with the four letters that equal an ASCII letter only when case is ignored."""
    other = F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(other)  # most are plain ASCII


def may_match(low: Column, pattern: str) -> Column:
    """False only for folded texts that the pattern cannot match; a plain substring test, far cheaper than a regex."""
    needed = required_texts(pattern)
    return F.lit(True) if needed is None else reduce(lambda a, b: a | b, [low.contains(part) for part in needed])


def may_match_any(text: Column, patterns: list[str]) -> Column:
    """False only for texts that none of the patterns can match."""
    return let(folded(text), lambda low: reduce(lambda a, b: a | b, [may_match(low, pattern) for pattern in patterns]))


def has(text: Column, low: Column, pattern: str) -> Column:
    """Case-insensitive regex search in ``text``; ``low`` is the folded text."""
    test = text.rlike(rx(pattern))
    return test if required_texts(pattern) is None else may_match(low, pattern) & test


def group_of(text: Column, low: Column, pattern: str, group: int) -> Column:
    """A group of the first match, '' if there is none; the regex runs only on texts that may match."""
    return F.when(may_match(low, pattern), F.regexp_extract(text, rx(pattern), group)).otherwise("")


def matched_rules(text: Column, rules=R.RULES) -> Column:
    """Names of all rules that hit, in rule order.

    concat_ws drops the misses, cheaper than a filter over an array.
    """
    usable = usable_rules(rules)
    both = let(text, lambda t: F.struct(t.alias("text"), folded(t).alias("low")))
    joined = let(both, lambda t: F.concat_ws(
        "\u0001", *[F.when(has(t["text"], t["low"], r.pattern), F.lit(r.name)) for r in usable]))
    return let(joined, lambda names: F.when(names == "", F.array().cast(NO_STRINGS)).otherwise(F.split(names, "\u0001")))


def rule_severity(matched: Column, rules=R.RULES) -> Column:
    """Highest severity among the matched rules, '' if none matched."""
    ranks = {r.name: R.RULE_SEVERITY_RANK.get(r.severity, 0) for r in usable_rules(rules)}
    names = [s for s, _ in sorted(R.RULE_SEVERITY_RANK.items(), key=lambda kv: kv[1])]
    best = F.array_max(F.transform(matched, lambda name: lookup(ranks, name, 0)))
    return F.when(F.size(matched) == 0, F.lit("")).otherwise(
        F.element_at(F.array(*[F.lit(n) for n in names]), best + 1))


def upgraded_level(level: Column, severity: Column) -> Column:
    """Raise the level to that of the severity; never lower it."""
    target = lookup(R.RULE_SEVERITY_LEVEL, severity)
    return F.when(level_rank(target) > level_rank(level), target).otherwise(level)


def alert_level(level: Column) -> Column:
    return (F.when(level == "CRITICAL", "critical")
            .when(level.isin("ERROR", "WARNING"), "warning").otherwise("info"))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def shannon(text: Column) -> Column:
    """Entropy in bits over characters; empty text gives 0."""

    def bits(t: Column) -> Column:
        return let(F.length(t).cast("double"), lambda n: F.aggregate(
            F.array_distinct(characters(t)), F.lit(0.0),
            lambda acc, char: acc - let((n - F.length(F.replace(t, char, F.lit("")))) / n,
                                        lambda share: share * F.log2(share))))

    return let(text, lambda t: F.when(F.length(t) > 0, bits(t)).otherwise(0.0))


def octal_mode(mode: Column) -> Column:
    return F.concat(F.lit("0o"), F.conv(mode.cast("string"), 10, 8))


def parse_octal_mode(text: Column) -> Column:
    """Octal text back to an integer; unreadable text gives 0o644."""
    digits = F.regexp_extract(text, "^(?:0o)?([0-7]+)$", 1)
    return F.when(digits != "", F.conv(digits, 8, 10).cast("int")).otherwise(F.lit(0o644))


def json_strings(text: Column) -> Column:
    """JSON array of strings; bad JSON gives an empty array."""
    return F.coalesce(F.from_json(text, NO_STRINGS), F.array().cast(NO_STRINGS))


def parse_iso(text: Column) -> Column:
    """ISO timestamp, lenient: 'Z' and '+0000' offsets are understood, else null."""
    cleaned = F.regexp_replace(F.regexp_replace(text, "Z", "+00:00"), r"\+0000", "+00:00")
    return F.try_to_timestamp(cleaned)


def iso(ts: Column) -> Column:
    """ISO text as the JSON and notification outputs show it: microseconds only if present."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_technique(technique_id: Column) -> Column:
    return F.substring_index(technique_id, ".", 1)


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
