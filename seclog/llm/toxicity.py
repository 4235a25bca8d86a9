"""Toxic passages: maximum-scoring segments over token log-odds.

Model, from labelled training rows only:

- Tokens are words (digits, letters, beyond ASCII; lower case) and the first ``STEM`` bytes
  of longer words, each counted once for a text, in toxic and in other texts. A token's
  score is its log-odds ratio with an informative Dirichlet prior: for stems the pooled
  frequencies, for words their stem's rates, so that rare forms lean on their stem. The
  lexicon keeps tokens whose score is large and whose signed root of the likelihood ratio
  is significant; an unknown word takes its stem's score, else a small drift downwards.
- Under the tokens of other texts a segment's score has an exponential tail with the decay
  that solves sum p * exp(decay * score) = 1; the expected number of segments of score S or
  more in a text of n words is at most n * exp(-decay * S) (extreme-value statistics).

A text is scanned once, in linear time, for all its maximal segments. Those expected fewer
than ``SIGNIFICANT`` times are its toxic passages. A text's evidence is the sum over its
segments of log(1 + 1 / expectation); a logistic curve fitted to the training texts'
evidence, in bins, gives the score.

Null or empty texts have no evidence. Repeated label rows count once for each doc_id
(toxic if any of them is). Without training rows every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from seclog.llm import text as X
from seclog.llm.store import Scratch

STEM = 4
PRIOR = 1.0
DRIFT = -0.25
LIMIT = 12.0
LEAST_SCORE, LEAST_Z = 1.0, 4.0
#: Size of the model: the most significant tokens.
LEXICON = 200_000
SIGNIFICANT = 0.05
BINS, TOP = 400, 100.0
#: Token counts that a task adds up at once (32 bytes each, and as many again several times over while they are sorted).
POOLED = 600_000
#: Labels up to this number of rows (16 bytes each) are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Slices of a batch with a ``text`` column: (rows, word hashes, stem hashes, first word of each row, places)."""
    at = batch.schema.get_field_index("text")
    for rows, _, _ in X.slices(batch, "text", X.SMALL_BYTES):
        data, offsets = X.column_bytes(pc.utf8_lower(pc.fill_null(rows.column(at), "")))
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        starts, ends, first = X.words(data, offsets, X.ALNUM)
        total = X.prefix_hash(data)
        yield rows, X.span_hash(total, starts, ends), X.span_hash(total, starts, np.minimum(ends, starts + STEM)) ^ np.uint64(1), first, (data, offsets, starts, ends)


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled texts that are not held out."""
    marks = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(marks, "doc_id").select("text", "toxic")


def token_counts(training: DataFrame) -> DataFrame:
    """(token, stem, n0, n1): a word's hash with its stem's, or a stem's own hash with a null stem."""

    def pooled(parts: list[tuple]) -> tuple:
        token, stem, n0, n1 = (np.concatenate(x) for x in zip(*parts))
        keys, at = np.unique(token, return_inverse=True)
        stems = np.empty(len(keys), np.uint64)
        stems[at] = stem
        return keys, stems, np.bincount(at, n0, len(keys)), np.bincount(at, n1, len(keys))

    def emit(part: tuple) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(part[0]), 100_000):
            token, stem, n0, n1 = (x[i:i + 100_000] for x in part)
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(stem.view(np.int64)), pa.array(n0.astype(np.int64)), pa.array(n1.astype(np.int64))],
                                  ["token", "stem", "n0", "n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for rows, word, stem, first, _ in _tokens(batch):
                row = np.repeat(np.arange(rows.num_rows), np.diff(first))
                once = np.unique(X.mix(word) + row.astype(np.uint64), return_index=True)[1]
                toxic = rows.column(1).to_numpy()[row[once]].astype(float)
                parts.append(pooled([(word[once], stem[once], 1 - toxic, toxic)]))
                held += len(parts[-1][0])
                if held > POOLED:
                    parts = [pooled(parts)]
                    held = len(parts[0][0])
                    if held > POOLED // 2:
                        yield from emit(parts.pop())
                        held = 0
        if parts:
            yield from emit(pooled(parts))

    words = training.mapInArrow(run, "token long, stem long, n0 long, n1 long")
    return words.groupBy("token", "stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _log_odds(y0: Column, y1: Column, n0: float, n1: float, prior0: Column, prior1: Column) -> tuple[Column, Column]:
    """Score of a token with counts y and prior counts in each class, and its signed root of the likelihood ratio."""
    a0, a1 = y0 + prior0, y1 + prior1
    score = F.log(a1 / (n1 + PRIOR - a1)) - F.log(a0 / (n0 + PRIOR - a0))
    share = n1 / (n0 + n1)
    part = lambda y, p: F.when(y > 0, y * F.log(y / ((y0 + y1) * p))).otherwise(F.lit(0.0))
    return score, F.signum(score) * F.sqrt(F.abs(2 * (part(y1, share) + part(y0, 1 - share))))


class Model:
    """Scores of tokens, the decay of segment scores, and the curve from evidence to score."""

    def __init__(self, tokens: np.ndarray, scores: np.ndarray, decay: float):
        order = np.argsort(tokens)
        self.tokens, self.scores, self.decay = tokens[order], scores[order].astype(np.float64), decay
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.tokens & np.uint64((1 << 20) - 1)] = True
        self.curve = (0.0, 0.0)

    def look_up(self, hashes: np.ndarray, out: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Put the scores of known tokens into ``out`` at the places ``where``; gives back the others."""
        maybe = self.bits[hashes[where] & np.uint64((1 << 20) - 1)]
        at = where[maybe]
        if not len(at) or not len(self.tokens):
            return where
        i = np.minimum(np.searchsorted(self.tokens, hashes[at]), len(self.tokens) - 1)
        known = self.tokens[i] == hashes[at]
        out[at[known]] = self.scores[i[known]]
        found = np.zeros(len(hashes), bool)
        found[at[known]] = True
        return where[~found[where]]

    def token_scores(self, word: np.ndarray, stem: np.ndarray) -> np.ndarray:
        out = np.full(len(word), DRIFT)
        self.look_up(stem, out, self.look_up(word, out, np.arange(len(word))))
        return out

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        """All maximal segments (first, end, score, expected number of such in the text)."""
        n = len(scores)
        return [(a, b, s, n * math.exp(-min(self.decay * s, 600.0))) for a, b, s in maximal_segments(scores)]

    def evidence(self, segments: list[tuple]) -> float:
        return math.fsum(math.log1p(1 / e) for *_, e in segments)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(evidence)))) if self.curve != (0.0, 0.0) else np.zeros(len(evidence))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments in linear time (Ruzzo and Tompa), from the positive scores and running sums."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # first, end, sum before, sum up to the end, next candidate with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        own = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= own[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= own[3]:
                own[4] = j
                stack.append(own)
                break
            own[0], own[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    training = _training(docs, labels)
    words = scratch.keep(token_counts(training), "words")
    stems = words.groupBy("stem").agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1"))
    n0, n1 = (float(x or 0) for x in words.agg(F.sum("n0"), F.sum("n1")).first())
    if not n0 or not n1:
        return Model(np.empty(0, np.uint64), np.empty(0), 1.0)

    def significant(table: DataFrame, score: Column, z: Column, key: str, y0: str, y1: str) -> DataFrame:
        return (table.withColumns({"score": F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), score)), "z": z})
                .filter((F.abs("score") >= LEAST_SCORE) & (F.abs("z") >= LEAST_Z))
                .select(F.col(key).alias("token"), "score", "z", F.col(y0).alias("y0"), F.col(y1).alias("y1")))

    pooled = (F.col("s0") + F.col("s1")) / (n0 + n1) * PRIOR
    stem_score, stem_z = _log_odds(F.col("s0"), F.col("s1"), n0, n1, pooled, pooled)
    of_stems = significant(stems, stem_score, stem_z, "stem", "s0", "s1")
    # a word's prior: one more text, dealt to the classes as its stem's
    own = words.join(stems, "stem")
    word_score, word_z = _log_odds(F.col("n0"), F.col("n1"), n0, n1,
                                   (F.col("s0") + n0 / (n0 + n1)) / (F.col("s0") + F.col("s1") + 1), (F.col("s1") + n1 / (n0 + n1)) / (F.col("s0") + F.col("s1") + 1))
    of_words = significant(own.filter("n0 + n1 >= 3"), word_score, word_z, "token", "n0", "n1")
    lexicon = of_stems.unionByName(of_words).orderBy(F.abs("z").desc(), "token").limit(LEXICON).collect()
    tokens = np.array([r.token for r in lexicon], np.int64).view(np.uint64)
    scores = np.array([r.score for r in lexicon])
    known = np.array([r.y0 for r in lexicon], float)
    model = Model(tokens, scores, _decay(np.append(scores, DRIFT), np.append(known + 0.5, max(n0 - known.sum(), 1.0))))

    bins = (training.mapInArrow(_scorer(scratch.spark.sparkContext.broadcast(model), ["toxic"], "evidence"), "toxic int, evidence double")
            .groupBy(F.least(F.floor(F.log1p("evidence") / math.log1p(TOP) * BINS), F.lit(BINS)).alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect())  # at most BINS + 1 rows
    model.curve = _logistic(np.array([r.bin * math.log1p(TOP) / BINS for r in bins]), np.array([float(r.n) for r in bins]), np.array([float(r.t) for r in bins]))
    return model


def _decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """Positive root of sum p * exp(decay * score) = 1."""
    p = weights / weights.sum()
    if p @ scores >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while p @ np.exp(np.minimum(high * scores, 700)) < 1:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(np.minimum(mid * scores, 700)) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, lightly held towards 0."""
    beta = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (toxic - n * p) - 0.01 * beta
        curve = design.T @ (design * (n * p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 1e-6))


def _scorer(held, keep: list[str], kind: str):
    """Function for mapInArrow: columns ``keep``, then the evidence, or score and passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            names = batch.schema.names
            done = 0
            for rows, word, stem, first, (data, offsets, starts, ends) in _tokens(batch):
                scores = model.token_scores(word, stem)
                high = np.concatenate([[0], np.cumsum(scores > 0)])
                found = [model.segments(scores[a:b]) if high[b] > high[a] else [] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                evidence = np.array([model.evidence(x) for x in found], np.float64)
                columns = [batch.slice(done, rows.num_rows).column(names.index(c)) for c in keep]
                done += rows.num_rows
                if kind == "evidence":
                    yield pa.record_batch([*columns, pa.array(evidence)], [*keep, "evidence"])
                    continue
                passages = []
                for i, own in enumerate(found):
                    base, out = int(offsets[i]), []
                    for a, b, s, e in (x for x in own if x[3] <= SIGNIFICANT):
                        p, q = int(starts[first[i] + a]), int(ends[first[i] + b - 1])
                        p, q = (len(data[base:x].tobytes().decode()) for x in (p, q))
                        out.append({"start": p, "end": q, "score": s, "expected": e})
                    passages.append(out)
                yield pa.record_batch([
                    *columns, pa.array(model.score(evidence)),
                    pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])))],
                    [*keep, "score", "passages"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row of ``docs`` (doc_id, text).

    passages: the toxic ones, in code points of the lower-cased text, ends exclusive.
    """
    model = fit(docs, labels, Scratch(docs.sparkSession, "toxicity"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_scorer(held, ["doc_id"], "score"),
                           "doc_id long, score double, passages array<struct<start:int,end:int,score:double,expected:double>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    model = fit(docs, labels, Scratch(docs.sparkSession, "toxicity"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = _scorer(held, [], "evidence")(iter([batch]))
            evidence = np.concatenate([x.column(0).to_numpy() for x in scored]) if batch.num_rows else np.empty(0)
            yield batch.filter(pa.array(held.value.score(evidence) < threshold))

    return docs.mapInArrow(run, docs.schema)
