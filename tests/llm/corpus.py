"""Small corpora for the tests, and plain Python versions of what the operators compute."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, items long, base int, place string"

BANK = ("alpha river stone cloud garden window paper silver morning forest candle bridge winter harbor "
        "lantern meadow copper violet thunder island marble willow ember falcon orchid prairie summit").split()


def sentence(rng, n):
    return " ".join(rng.choice(BANK) + rng.choice(["", "", ",", "."]) for _ in range(n))


def documents(seed=1, n=60):
    """Rows with nulls in every column, empty and long texts, exact and near copies, repeated rows and clashing columns."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "one two", "ONE\x0btwo", "é ñ 中文 🙂", "x" * 450]
    shared = [sentence(rng, 60) for _ in range(3)]
    for _ in range(n):
        texts.append(" ".join([sentence(rng, rng.randint(1, 80)), rng.choice(shared), sentence(rng, rng.randint(0, 40))]))
    for _ in range(12):  # near copies
        words = texts[10].split(" ")
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(BANK)
        texts.append(" ".join(words))
    texts += texts[9:14]  # exact copies
    texts.append(sentence(rng, 9000))
    rows = [(i, t, rng.choice(["en", None]), "src0" if i % 3 else None, None if t is None else len(t), "own", i, None, "here") for i, t in enumerate(texts)]
    return rows


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def components(rows, k, percent):
    """doc_id: smallest doc_id reachable, by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in sets}, sets
