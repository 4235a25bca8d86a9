"""Secrets in texts: known patterns, and windows of high entropy over candidate strings.

Everything is DataFrame functions. Places are code points, ends exclusive.

Patterns (leftmost, not overlapping, for each kind on its own; failing matches are dropped):
``assign`` a named value of 12 characters or more, ``access`` an AKIA key of 18 or more,
``hex`` a run of 16 or more.

Entropy: a candidate is a run of ``CANDIDATE`` characters. It is cut into its maximal runs of
each character class (hex, alphanumeric, base 64), and each run of ``WINDOW`` characters or
more is read with the threshold of the narrowest class it is made of; so a key counts as what
it is, also behind a prefix. A window of ``WINDOW`` characters slides over a run. The entropy
of a window of n characters is log2(n) - S / n with S the sum of c * log2(c) over the counts c
of its characters; when the window moves, only the counts of the character that leaves and of
the one that enters change S. Stretches of windows that reach their threshold, joined where
they meet, are spans of kind ``entropy``. Allow-listed candidates and runs (UUIDs, plain
numbers, one case of letters only, words joined by marks or capitals) and stretches that a
pattern's match covers are suppressed.

A null text is empty and has no spans. No rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns asked for.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"

KINDS = ("assign", "access", "hex", "entropy")

#: Strings that may hold a secret, and the runs of narrower classes inside them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
NARROWER = (r"[A-Za-z0-9]{20,}", r"[0-9a-fA-F]{20,}")
WINDOW = 20

#: Matches placed at once.
_BLOCK = 128
#: Windows of one fold; a window's counts, 5 bits for each character from "+" to "z", 12 in a word.
_STRIDE, _SLOT_BITS, _SLOTS, _WORDS, _FIRST = 64, 5, 12, 7, ord("+")

#: Character classes, narrowest first, and the bits a window must reach of log2(WINDOW) = 4.32 at most.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8))

ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9=_/+-]+$",  # numbers, dates, rules
    r"^[a-z]+$|^[A-Z]+$",  # one long word
)
#: Words and numbers joined by marks: what each piece is, and the last one.
_PIECE = r"^[0-9]*([A-Z]?[a-z]*|[A-Z]{2,})$"
_LAST_PIECE = r"^[0-9]*([A-Z]?[a-z]*|[A-Z]{2,})[0-9]*$"
#: Words joined by capitals or marks: no capital starts anything but a word.
_NO_WORD = r"[^A-Za-z_/=+-]|(?![A-Z][a-z]{2}|A[nst]|B[ey]|Do|Go|I[dfnst]|My|No|O[fnr]|So|To|U[ps]|We)[A-Z]"


def _let(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once: inside a lambda a bare expression would be computed at each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def allowed(what: Column) -> Column:
    """Whether a string is no secret by its form. Long strings are no deeper than short ones: no pattern repeats a group."""
    joined = _let(F.split(what, "[_/=+-]", -1), lambda p: F.forall(F.slice(p, 1, F.size(p) - 1), lambda x: x.rlike(_PIECE))
                  & F.element_at(p, -1).rlike(_LAST_PIECE))
    return what.rlike("|".join(f"(?:{p})" for p in ALLOWED)) | joined | (what.rlike("[A-Z_/=+-]") & ~what.rlike(_NO_WORD))


def _matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Array of spans of a pattern's matches: what stands between matches gives the places."""
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:int,what:string>>)")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(some: Column) -> Column:
        """Matches of one block, by places from the block's start, and the block's length."""
        return F.aggregate(some, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda s, x: F.when(x["m"].isNull(), s).otherwise(F.struct(
            (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + F.length(x["g"])).alias("start"), (s["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                F.lit(KINDS.index(kind)).alias("kind"), x["m"].alias("what")))).alias("out"))))

    def moved(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + b["at"])))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, first: F.transform(b["out"], lambda x: F.struct(
            (x["start"] + first).alias("start"), (x["end"] + first).alias("end"), x["kind"].alias("kind"), x["what"].alias("what")))))

    # in blocks, so that no array grows match by match over the whole text
    blocks = _let(F.arrays_zip(found.alias("m"), gaps.alias("g")), lambda z: F.transform(
        F.sequence(F.lit(1), F.size(z), F.lit(_BLOCK)), lambda i: placed(F.slice(z, i, _BLOCK))))
    placed_all = _let(blocks, moved)
    # texts without a match are most: they skip the walk
    return F.when(text.rlike(pattern), placed_all if keep is None else F.filter(placed_all, keep)).otherwise(empty)


def _threshold(what: Column) -> Column:
    out = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        out = F.when(what.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def _slot_count(words: Column, slot: Column) -> Column:
    """How often a character stands in the window: ``_SLOT_BITS`` bits of one of the words."""
    word = F.get(words, F.floor(slot / _SLOTS).cast("int"))
    return F.call_function("shiftright", word, (slot % _SLOTS) * _SLOT_BITS).bitwiseAND((1 << _SLOT_BITS) - 1)


def _moved(words: Column, slot: Column, by: int) -> Column:
    """The words with one more (by 1) or one less (by -1) of a character."""
    place, unit = F.floor(slot / _SLOTS), F.call_function("shiftleft", F.lit(by).cast("long"), (slot % _SLOTS) * _SLOT_BITS)
    return F.transform(words, lambda w, i: F.when(i == place, w + unit).otherwise(w))


def window_hits(what: Column, window: int = WINDOW) -> Column:
    """First places of the windows of ``what`` that reach its class's threshold.

    Windows are taken ``_STRIDE`` at a time: a fold over their characters holds the counts, S and one bit for each
    window, so its state has a fixed size and the work is linear in the length."""
    if not 1 < window < 1 << _SLOT_BITS:
        raise ValueError(f"windows have 2 to {(1 << _SLOT_BITS) - 1} characters")
    terms = [c * math.log2(c) if c else 0.0 for c in range(window + 1)]
    rise = F.array(*(F.lit(b - a) for a, b in zip(terms, terms[1:])))
    last = F.length(what) - window

    def stretch(slots: Column, bound: Column, first: Column) -> Column:
        """Hits among the windows from ``first`` on."""
        until = F.least(first + (_STRIDE - 1), last)

        def step(s: Column, k: Column) -> Column:
            """Character k enters and, from a full window, character k - window leaves."""
            full = k >= first + window
            leaves, enters = F.get(slots, k - window), F.get(slots, k)
            words = F.when(full, _moved(s["words"], leaves, -1)).otherwise(s["words"])
            total = s["total"] - F.when(full, F.get(rise, (_slot_count(s["words"], leaves) - 1).cast("int"))).otherwise(0.0)
            return _let(F.struct(words.alias("words"), total.alias("total")), lambda m: _let(
                m["total"] + F.get(rise, _slot_count(m["words"], enters).cast("int")), lambda sums: F.struct(
                    _moved(m["words"], enters, 1).alias("words"), sums.alias("total"),
                    F.when((k >= first + (window - 1)) & (sums <= bound), s["hits"].bitwiseOR(
                        F.call_function("shiftleft", F.lit(1).cast("long"), k - first - (window - 1)))).otherwise(s["hits"]).alias("hits"))))

        start = F.struct(F.array(*[F.lit(0).cast("long")] * _WORDS).alias("words"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("hits"))
        bits = F.aggregate(F.sequence(first, until + (window - 1)), start, step, lambda s: s["hits"])
        return _let(bits, lambda h: F.filter(F.sequence(first, until), lambda i: F.call_function("shiftright", h, i - first).bitwiseAND(1) == 1))

    # the entropy log2(window) - S / window reaches the threshold where S is small enough
    bound = (F.lit(math.log2(window)) - _threshold(what)) * window + 1e-9
    slots = F.transform(F.split(what, ""), lambda c: F.ascii(c) - _FIRST)
    found = _let(F.struct(slots.alias("slots"), bound.alias("bound")), lambda x: F.flatten(F.transform(
        F.sequence(F.lit(0), last, F.lit(_STRIDE)), lambda first: stretch(x["slots"], x["bound"], first))))
    return F.when((last >= 0) & _threshold(what).isNotNull(), found).otherwise(F.expr("cast(array() as array<int>)"))


def _covered(hits: Column, window: int = WINDOW) -> Column:
    """Stretches (a, b) that windows at ``hits``, in order, cover; windows that touch make one."""
    firsts = lambda h: F.filter(h, lambda x, i: (i == 0) | (x - F.coalesce(F.get(h, i - 1), x) > window))
    lasts = lambda h: F.filter(h, lambda x, i: F.coalesce(F.get(h, i + 1) - x > window, F.lit(True)))
    return _let(hits, lambda h: F.zip_with(firsts(h), lasts(h), lambda a, b: F.struct(a.alias("a"), (b + window).alias("b"))))


def window_runs(what: Column, window: int = WINDOW) -> Column:
    """Stretches (first, end) of ``what`` covered by windows that reach the class's threshold."""
    return _covered(window_hits(what, window), window)


def _stretches(what: Column) -> Column:
    """Stretches (a, b) of a candidate, over its runs of each class."""
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(what).alias("end"), F.lit(KINDS.index("entropy")).alias("kind"), what.alias("what")))
    runs = F.array_distinct(F.concat(whole, *(_matches(what, pattern, "entropy", lambda x: ~allowed(x["what"])) for pattern in NARROWER)))
    return _covered(F.sort_array(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(window_hits(r["what"]), lambda i: r["start"] + i))))))


def _entropy(text: Column, base: Column) -> Column:
    candidates = _matches(text, CANDIDATE, "entropy", lambda x: ~allowed(x["what"]))
    spans = F.flatten(F.transform(candidates, lambda x: F.transform(
        _stretches(x["what"]), lambda r: F.struct((x["start"] + r["a"]).alias("start"), (x["start"] + r["b"]).alias("end"),
                                                           x["kind"].alias("kind"), F.lit("").alias("what")))))
    return F.filter(spans, lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, end, kind), by start, then kind as listed."""
    text = F.col("__text")
    ordered = lambda x: F.array_sort(F.transform(x, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    shaped = lambda x: F.transform(x, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind")))
    return (docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
            .withColumn("__base", F.concat(
                _matches(text, ASSIGN, "assign", lambda x: F.length(F.regexp_extract(x["what"], ASSIGN_VALUE, 1)) >= 12),
                _matches(text, ACCESS, "access", lambda x: F.length(x["what"]) >= 18),
                _matches(text, HEX, "hex")))
            .withColumn("__more", _entropy(text, F.col("__base")))
            .withColumns({"base": shaped(ordered("__base")), "spans": shaped(ordered(F.concat("__base", "__more")))})
            .drop("__text", "__base", "__more"))


def listed(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs`` (doc_id, text)."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = scan(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
                        F.sha2(F.encode(listed("base"), "UTF-8"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span, overlapping ones together, replaced by ``mark``; n_chars follows if there."""
    own = docs.columns
    held = docs.withColumnsRenamed({c: f"__own_{c}" for c in own if c in ("base", "spans")})
    found = scan(held)
    joined = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] < s["at"], s["out"]).otherwise(F.concat(
            s["out"], F.substr(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mark))).alias("out")),
        lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    found = found.withColumn("text", F.when(F.size("spans") > 0, joined).otherwise(F.col("text")))
    if "n_chars" in own:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select([F.col(f"__own_{c}").alias(c) if c in ("base", "spans") else F.col(f"`{c}`") for c in own])
