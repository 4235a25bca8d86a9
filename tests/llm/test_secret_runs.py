"""Keys behind a prefix and keys without digits are found; words are not."""

import random

from corpus import frame
from seclog.llm import secrets


def spans(spark, texts):
    rows = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in secrets.report(rows).collect()}
    return [[(k, int(a), int(b)) for k, a, b in (s.split(":") for s in out[i].split(",") if s)] for i in range(len(texts))]


def test_hex_keys_behind_a_prefix(spark):
    rng = random.Random(11)
    keys = [(p, "".join(rng.choices("0123456789ABCDEF", k=n))) for p in ("API_REF=", "sk-", "id_") for n in (32, 40, 64) for _ in range(60)]
    got = spans(spark, [f"set {p}{k} now" for p, k in keys])
    alone = spans(spark, [k for _, k in keys])
    inside = lambda x, found: any(a <= x[0] and x[1] <= b for _, a, b in found)
    assert sum(not found for found in got) <= 0.005 * len(keys)
    # What is found of the key alone is found of it behind the prefix.
    for (p, _), own, found in zip(keys, alone, got):
        assert all(inside((4 + len(p) + a, 4 + len(p) + b), found) for _, a, b in own)


def test_keys_without_digits(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["".join(rng.choices(letters + extra, k=40)) for extra in ("", "+/") for _ in range(100)]
    got = spans(spark, [f"key {k} ." for k in keys])
    assert sum(not found for found in got) <= 2


def test_runs_overlapping_in_a_candidate_are_one_span(spark):
    key = "9F86D081884C7D659A2FEAA0C55AD015"
    (found,) = spans(spark, [f"Kx9Qp2Lm7Rt4Vw1Zy8Bn3Cd6Fg5Hj0_{key}"])
    assert found == [("entropy", 0, 31 + len(key))]


def test_words_numbers_and_paths_are_left(spark):
    texts = ["id_12345678901234567890123456 x", "src/main/java/com/example/Application", "getElementsByTagNameAndClass", "a-very-long-slug-of-many-words-in-a-row",
             "Some_Words/And_Others-more", "--------------------------------", "X9a-00000000000000000000000000000", "ORDER_NUMBER=20240101123456789012345"]
    assert [[s for s in found if s[0] == "entropy"] for found in spans(spark, texts)] == [[] for _ in texts]
