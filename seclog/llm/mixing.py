"""Mixing sources to target weights by Pareto order sampling.

1. A document's size is its number of words. Sources, in order, get weights; targets share all
   words by weight and stop at ``repeats`` times their source's words, the excess going to the
   others by weight. That level is found exactly: it is the highest of the levels at which
   the first k sources, by words over weight, are full.
2. Of a source, ``floor(target / words)`` whole copies of every document are certain. What is
   left of the target is a sample of words. A document's inclusion probability is
   ``slope * sqrt(words)``, 1 at most, between equal chances for documents and equal
   chances for words; the slope makes the expected words the ones wanted. Documents at 1
   are certain copies too.
3. Pareto order: a random number u from the document, its odds u / (1 - u) divided by the inclusion odds.
   Documents are taken in rising order until the next one would exceed the words wanted,
   so the size of the sample is fixed, in words, but for that document. The gap is filled with
   documents behind it: of each class of sizes the first in Pareto order, largest class first, where
   it fits. If the document at the end comes nearer than that, it is taken instead.

Everything is counts and sums: words by (source, size), then by (source, stretch of the order), so a
source with a third of all rows is never put in order as a whole; only the stretch where the sample
ends is, and it holds about ``STRETCH`` rows. Reruns agree, whatever the partitions: u
is a hash of seed, doc_id and text. Rows that are equal in both share it: they are taken together,
and they don't fill gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seclog.llm.store import Scratch

REPEATS, WEIGHTS, SEED = 3, (1, 2, 3), 20240607
STRETCH = 20_000
#: A table of at most so many sources is broadcast; a longer one is joined as the optimizer sees fit.
SOURCES = 50_000

WORD = r"[^\x20\x09-\x0D]+"
_HASH_DIGITS = 13  # hexadecimal


def size_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column, text: Column, seed: int = SEED) -> Column:
    """52 random bits of a document: the same on every run."""
    own = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.md5(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(F.encode(own, "UTF-8")), 1, _HASH_DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with __mix_source, __mix_size and __mix_hash."""
    return docs.withColumns({"__mix_source": F.col("source").cast("string"), "__mix_size": size_of(F.col("text")), "__mix_hash": hash_of(F.col("doc_id"), F.col("text"), seed)})


def targets(words: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target, whole, wanted) of a table (source, source_size): whole copies and sampled words.

    Windows run over one row per source. A source without words has the target 0.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    full = W.orderBy("__ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("__cap").over(full), F.lit(0))) / (F.sum("__weight").over(W.partitionBy()) - F.coalesce(F.sum("__weight").over(full), F.lit(0.0)))
    return (words.withColumn("__weight", weight)
            .withColumn("__cap", F.col("source_size") * repeats)
            .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
            .withColumn("__level", level)
            .withColumn("target", F.least(F.col("__cap").cast("double"), F.max("__level").over(W.partitionBy()) * F.col("__weight")))
            .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
            .withColumn("wanted", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
            .select("source", "source_size", "target", "whole", "wanted"))


def _slopes(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, slope): ``least(1, slope * sqrt(size))`` times the size, over all documents, is what the source wants.

    The highest of the slopes at which the k largest sizes are certain. ``sizes`` has a row
    for each size that a source has.
    """
    larger = W.partitionBy("__s").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    smaller = W.partitionBy("__s").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    own = (sizes.filter("size > 0").withColumnRenamed("source", "__s")
           .withColumn("__certain", F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0)))
           .withColumn("__rest", F.sum(F.col("n") * F.col("size") * F.sqrt(F.col("size").cast("double"))).over(smaller)))
    return (own.join(sources.select("source", "wanted"), F.col("__s").eqNullSafe(F.col("source")))
            .groupBy("source").agg(F.max((F.col("wanted") - F.col("__certain")) / F.col("__rest")).alias("slope")))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of sampled sources with ``order``: odds of the random number over odds of inclusion."""
    chance = F.least(F.lit(1.0), F.col("slope") * F.sqrt(F.col("__mix_size").cast("double")))
    u = (F.col("__mix_hash") + 0.5) / float(16 ** _HASH_DIGITS)
    return (rows.withColumn("__chance", F.when((F.col("wanted") > 0) & (F.col("__mix_size") > 0), chance))
            .withColumn("order", F.when(F.col("__chance") > 0, u * (1 - F.col("__chance")) / ((1 - u) * F.col("__chance")))).drop("__chance"))


def _beside(rows: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """``rows`` with the columns of their source."""
    sources = sources.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(sources) if number <= SOURCES else sources, F.col("__mix_source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _class(size: Column) -> Column:
    """Sizes by their leading five binary digits: 16 classes for each power of two."""
    digits = F.length(F.bin(size))
    return digits * 16 + F.floor(size / F.pow(F.lit(2.0), F.greatest(digits - 5, F.lit(0)))).cast("int") % 16


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, scratch: Scratch | None = None) -> tuple[DataFrame, int]:
    """(source, source_size, target, whole, wanted, slope, cut, through, fills) and the number of sources.

    A document of a source is sampled if its place in the Pareto order is before ``cut``, or at
    it if ``through``, or its hash is one of ``fills``. ``rows`` is read several times: hand over a stored table.
    """
    scratch = scratch or Scratch(rows.sparkSession, "mixing")
    sizes = scratch.keep(rows.groupBy(F.col("__mix_source").alias("source"), F.col("__mix_size").alias("size")).agg(F.count("*").alias("n")), "sizes")
    words = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = scratch.keep(targets(words, weights, repeats), "targets")
    slopes = _slopes(sizes, wanted).withColumnRenamed("source", "__s")
    sources = scratch.keep(wanted.join(slopes, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "sources")
    number = sources.count()
    total = sizes.agg(F.sum("n")).first()[0] or 0
    stretches = max(1, total // STRETCH)

    placed = (_ordered(_beside(rows, sources.select("source", "wanted", "slope"), number)).filter("order IS NOT NULL")
              .withColumn("stretch", F.floor(F.col("order") / (1 + F.col("order")) * stretches).cast("int")))
    so_far = W.partitionBy("__mix_source").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)
    ends = (placed.groupBy("__mix_source", "stretch").agg(F.sum("__mix_size").alias("words"), F.first("wanted").alias("wanted"))
            .withColumn("upto", F.sum("words").over(so_far)).filter(F.col("upto") > F.col("wanted"))
            .groupBy("__mix_source").agg(F.min("stretch").alias("last"), F.min(F.col("upto")).alias("upto"), F.min_by("words", "stretch").alias("words"))
            .select(F.col("__mix_source").alias("source"), "last", (F.col("upto") - F.col("words")).alias("before")))
    ends = scratch.keep(ends, "ends")
    inside = W.partitionBy("__mix_source").orderBy("order").rowsBetween(W.unboundedPreceding, 0)
    edge = (_beside(placed, ends, number).filter(F.col("stretch") == F.col("last"))
            .groupBy("__mix_source", "order").agg(F.sum("__mix_size").alias("words"), F.first("wanted").alias("wanted"), F.first("before").alias("before"))
            .withColumn("upto", F.col("before") + F.sum("words").over(inside)).filter(F.col("upto") > F.col("wanted"))
            .groupBy(F.col("__mix_source").alias("source")).agg(F.min("order").alias("cut"), F.min(F.col("upto")).alias("upto"), F.min_by("words", "order").alias("words"), F.first("wanted").alias("wanted"))
            .select("source", "cut", (F.col("wanted") - (F.col("upto") - F.col("words"))).alias("gap"), (F.col("upto") - F.col("wanted")).alias("over")))
    edge = scratch.keep(edge, "edge")

    first = F.min(F.struct("order", F.col("__mix_size").alias("size"), F.col("__mix_hash").alias("hash")))
    near = (_beside(placed, edge, number).filter((F.col("order") > F.col("cut")) & (F.col("__mix_size") <= F.col("gap")))
            .groupBy("__mix_source", "gap", _class(F.col("__mix_size")).alias("class")).agg(first.alias("d"))
            .groupBy("__mix_source", "gap").agg(F.sort_array(F.collect_list(F.struct("class", "d")), asc=False).alias("found")))  # 16 rows for each power of two
    fill = F.aggregate("found", F.struct(F.col("gap").alias("left"), F.array().cast("array<struct<hash:bigint,size:bigint>>").alias("picks")),
                       lambda s, x: F.when(x["d"]["size"] <= s["left"],
                                           F.struct((s["left"] - x["d"]["size"]).alias("left"), F.concat(s["picks"], F.array(F.struct(x["d"]["hash"], x["d"]["size"]))).alias("picks"))).otherwise(s))
    picks = scratch.keep(near.select(F.col("__mix_source").alias("source"), F.explode(fill["picks"]).alias("p")).select("source", "p.hash", "p.size"), "picks")
    lone = (rows.join(picks, F.col("__mix_source").eqNullSafe(F.col("source")) & (F.col("__mix_hash") == F.col("hash")))
            .groupBy("source", "hash", "size").agg(F.count("*").alias("n")).filter("n = 1")
            .groupBy("source").agg(F.sort_array(F.collect_list("hash")).alias("fills"), F.sum("size").alias("filled")).withColumnRenamed("source", "__s"))
    cuts = edge.withColumnRenamed("source", "__e")
    through = F.coalesce(F.col("over") < F.col("gap") - F.coalesce("filled", F.lit(0)), F.lit(False))
    out = (sources.join(cuts, F.col("source").eqNullSafe(F.col("__e")), "left")
           .join(lone, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("through", through)
           .select(*sources.columns, "cut", "through", F.when(~F.col("through"), F.col("fills")).alias("fills")))
    return scratch.keep(out, "plan"), number


def with_copies(rows: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """Measured rows with their source's columns and ``copies``: how often the mix takes them."""
    sampled = (F.col("order") < F.coalesce("cut", F.lit(float("inf")))) | (F.col("through") & (F.col("order") == F.col("cut"))) | F.array_contains(F.coalesce("fills", F.array().cast("array<bigint>")), F.col("__mix_hash"))
    return _ordered(_beside(rows, sources, number)).withColumn("copies", F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix: rows of ``docs`` (doc_id, text, source, any others), each as often as it is taken, with all columns.

    A null source is a source of its own, the last. Empty and null texts have no words; they
    come with their source's whole copies. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = [F.col(f"__mix_docs.`{c}`") for c in docs.columns]
    rows = measured(docs, seed)
    sources, number = plan(scratch.keep(rows.select("__mix_source", "__mix_size", "__mix_hash"), "rows"), weights, repeats, scratch)
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__mix_docs"), "__mix_source", "__mix_size", "__mix_hash")
    taken = with_copies(packed, sources, number).filter("copies > 0")
    return taken.select("__mix_docs", F.explode(F.sequence(F.lit(1), "copies")).alias("__mix_copy")).select(own)


def report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = measured(docs, seed).select(F.col("doc_id").cast("long"), "__mix_source", "__mix_size", "__mix_hash")
    rows = scratch.keep(rows, "rows")
    sources, number = plan(rows, weights, repeats, scratch)
    return with_copies(rows, sources, number).select(
        "doc_id", F.col("__mix_size").alias("size"), "source_size", "target", (F.col("__mix_size") * F.col("copies")).alias("taken"))


#: The same rows in DuckDB, from the definition: the whole order of each source, then the gap filled class by class.
ORACLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':{SEED}'), 1, {_HASH_DIGITS}) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS DOUBLE) AS weight FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum({REPEATS} * source_size) OVER before, 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM w
      WINDOW before AS (ORDER BY {REPEATS} * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, least(CAST({REPEATS} * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
r AS (SELECT *, greatest(target - whole * source_size, 0) AS wanted FROM t),
h AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
k AS (SELECT h.source, max((wanted - coalesce(certain, 0)) / rest) AS slope FROM
       (SELECT *, sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS certain,
               sum(n * size * sqrt(size)) OVER (PARTITION BY source ORDER BY size) AS rest FROM h) h
       JOIN r ON h.source IS NOT DISTINCT FROM r.source GROUP BY h.source),
c AS (SELECT d.doc_id, d.size, d.hash, r.*, least(1, slope * sqrt(size)) AS chance, (hash + 0.5::DOUBLE) / {16 ** _HASH_DIGITS}::DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
o AS (SELECT *, CASE WHEN wanted > 0 AND size > 0 AND chance > 0 THEN u * (1 - chance) / ((1 - u) * chance) END AS place FROM c),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM o WHERE place IS NOT NULL),
e AS (SELECT source, min(place) AS cut FROM q WHERE upto > wanted GROUP BY source),
b AS (SELECT e.source, e.cut, max(q.wanted) - coalesce(sum(CASE WHEN place < cut THEN size END), 0) AS gap,
        sum(CASE WHEN place <= cut THEN size END) - max(q.wanted) AS over
      FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source GROUP BY e.source, e.cut),
n AS (SELECT q.source, gap, length(bin(size)) * 16 + CAST(floor(size / power(2.0::DOUBLE, greatest(length(bin(size)) - 5, 0))) AS BIGINT) % 16 AS class,
        min_by(size, place) AS size, min_by(hash, place) AS hash
      FROM q JOIN b ON q.source IS NOT DISTINCT FROM b.source WHERE place > cut AND size <= gap GROUP BY 1, 2, 3),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS turn FROM n),
x AS (SELECT source, 0::BIGINT AS turn, gap AS room, false AS pick, NULL::BIGINT AS hash, 0::BIGINT AS size FROM f WHERE turn = 1
      UNION ALL SELECT f.source, f.turn, x.room - CASE WHEN f.size <= x.room THEN f.size ELSE 0 END, f.size <= x.room, f.hash, f.size
      FROM x JOIN f ON f.source IS NOT DISTINCT FROM x.source AND f.turn = x.turn + 1),
p AS (SELECT x.source, x.hash, x.size FROM x JOIN d ON x.source IS NOT DISTINCT FROM d.source AND x.hash = d.hash WHERE pick GROUP BY 1, 2, 3 HAVING count(*) = 1),
v AS (SELECT b.source, b.cut, b.over < b.gap - coalesce((SELECT sum(p.size) FROM p WHERE p.source IS NOT DISTINCT FROM b.source), 0) AS through FROM b)
SELECT doc_id, o.size, source_size, target,
  CAST(o.size * (whole + CASE WHEN place < coalesce(cut, 'inf'::DOUBLE) OR (through AND place = cut) OR (NOT through AND p.hash IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM o LEFT JOIN v ON o.source IS NOT DISTINCT FROM v.source LEFT JOIN p ON o.source IS NOT DISTINCT FROM p.source AND o.hash = p.hash
"""
