"""Toxicity and near-dedup hold little text at once, and near-dedup leaves no table that nothing reads."""

import os

import pyarrow as pa

from corpus import documents, frame
from seclog.llm import text as X, toxicity
from seclog.llm.neardup import deduplicated
from seclog.storage import checkpoint_dir


def test_toxicity_scans_small_slices_with_the_same_tokens():
    texts = ["Ärger und WORTE %d, " % i * 2500 for i in range(40)] + [None, "", "x" * 3 * X.SMALL_BYTES, "Ende"]
    column = pa.array(texts, pa.string())
    found, sizes = [], []
    # a batch that begins inside its arrays, as Arrow's slices do
    for rows, word, stem, first, (data, offsets, starts, ends) in toxicity._tokens(pa.record_batch([pa.array(range(45)).cast(pa.int32()), pa.concat_arrays([pa.array(["before"]), column])], ["toxic", "text"]).slice(1)):
        sizes.append((len(data), rows.num_rows))
        found += [(word[a:b].tolist(), stem[a:b].tolist()) for a, b in zip(first, first[1:])]
        assert len(offsets) == rows.num_rows + 1
    assert all(n <= X.SMALL_BYTES or rows == 1 for n, rows in sizes)
    alone = [next(toxicity._tokens(pa.record_batch([pa.array([0], pa.int32()), pa.array([t], pa.string())], ["toxic", "text"]))) for t in texts]
    assert found == [(w.tolist(), s.tolist()) for _, w, s, _, _ in alone]


def test_counts_are_the_same_when_few_are_added_up_at_once(spark, monkeypatch):
    rows = [(" ".join("w%d" % (i * j % 997) for j in range(300)), i % 2) for i in range(200)]
    training = spark.createDataFrame(rows, "text string, toxic int").repartition(2)
    whole = sorted(map(tuple, toxicity.token_counts(training).collect()))
    monkeypatch.setattr(toxicity, "POOLED", 50)
    assert sorted(map(tuple, toxicity.token_counts(training).collect())) == whole


def test_tables_that_nothing_reads_are_dropped(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    kept = deduplicated(frame(spark, documents()))
    left = [t for d in set(os.listdir(folder)) - before if d.startswith("llm-neardup-") for t in os.listdir(os.path.join(folder, d)) if not t.startswith(".")]
    names = {t.split("-", 1)[1] for t in left}
    assert "heads" in names
    assert not names & {"signatures", "nodes", "shared", "pairs-stars", "pairs-across", "links-stars", "links-across", "first", "second", "named"}
    assert kept.count() > 0
