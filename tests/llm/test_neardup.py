import random

import pytest

from corpus import BANK, DOCS, components, documents, frame
from seclog.llm.components import components as linked
from seclog.llm.neardup import CHUNK, deduplicated, near_duplicates, plan
from seclog.llm.store import Scratch


def test_plan_guarantees_the_distance():
    for percent in (80, 85, 95):
        chunks = plan(percent)
        assert 2 * chunks - 1 >= (1 - percent / 100) * chunks * CHUNK


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_all_links_are_found(spark, k, percent):
    rows = documents()
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows), k, percent).collect()}
    want, sets = components([r[:2] for r in rows], k, percent)
    assert {i: got[i].component_id for i in want} == want
    assert {i: got[i].n_shingles for i in want} == {i: len(s) for i, s in sets.items()}
    assert {i: got[i].kept for i in want} == {i: i == c for i, c in want.items()}


def test_a_large_group_with_chained_links(spark):
    """Links of a link's link, across a group whose members are not all linked with each other."""
    rng = random.Random(4)
    words = [rng.choice(BANK) + str(i) for i in range(60)]
    rows = []
    for i in range(300):
        if i % 3 == 0:
            words[rng.randrange(60)] = "edit%d" % i
        own = list(words)
        if i % 5 == 0:
            for _ in range(4):
                own[rng.randrange(60)] = "odd%d" % i
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == components(rows, 3, 85)[0]


def test_null_and_repeated_ids_and_an_empty_table(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "quite other words here now"), (None, ""), (8, None), (8, None)]
    out = sorted(near_duplicates(frame(spark, rows, "doc_id long, text string")).collect(), key=str)
    assert len(out) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out} == {
        (None, 2, 7, False), (7, 2, 7, True), (7, 1, 7, True), (None, 0, None, True), (8, 0, 8, True)}
    assert near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0


def test_one_row_of_each_group_stays_with_its_columns(spark):
    rows = documents() + [documents()[12]] * 3
    out = deduplicated(frame(spark, rows)).collect()
    want, sets = components([r[:2] for r in rows], 5, 80)
    assert sorted(r.doc_id for r in out) == sorted(i for i in want if want[i] == i)
    by_id = {r[0]: r for r in rows}
    assert all(tuple(r) == by_id[r.doc_id] for r in out)
    assert deduplicated(frame(spark, [], DOCS)).columns == frame(spark, [], DOCS).columns


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    out = linked(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in out} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200}
