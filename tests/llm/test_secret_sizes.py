"""Long candidates and many matches, and the whole ``spans`` column against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corpus import frame
from seclog.llm import secrets as S

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The allow-list as one pattern for each form.
FORMS = (*S.ALLOWED, r"^[0-9]*([A-Z]?[a-z]*|[A-Z]{2,})([_/=+-][0-9]*([A-Z]?[a-z]*|[A-Z]{2,}))*[0-9]*$",
         r"^[a-z]*([A-Z][a-z]{2,}|A[nst]|B[ey]|Do|Go|I[dfnst]|My|No|O[fnr]|So|To|U[ps]|We|[_/=+-][a-z]*)+$")


def is_allowed(what):
    return any(re.search(p, what) for p in FORMS)


def hits(what):
    bits = next(b for _, p, b in S.CLASSES if re.search(p, what))
    out = []
    for i in range(len(what) - S.WINDOW + 1):
        counts = Counter(what[i:i + S.WINDOW])
        if -sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in counts.values()) >= bits - 1e-9:
            out.append(i)
    return out


def spans(text):
    base = [(m.start(), 0, m.end()) for m in re.finditer(S.ASSIGN, text) if len(re.search(S.ASSIGN_VALUE, m[0])[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer(S.ACCESS, text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(S.HEX, text)]
    more = []
    for c in re.finditer(S.CANDIDATE, text):
        if is_allowed(c[0]):
            continue
        places = set(hits(c[0]))
        for pattern in S.NARROWER:
            for m in re.finditer(pattern, c[0]):
                if not is_allowed(m[0]):
                    places |= {m.start() + i for i in hits(m[0])}
        joined = []
        for i in sorted(places):
            if joined and i <= joined[-1][1]:
                joined[-1][1] = i + S.WINDOW
            else:
                joined.append([i, i + S.WINDOW])
        more += [(c.start() + a, 3, c.start() + b) for a, b in joined]
    more = [x for x in more if not any(b[0] <= x[0] and b[2] >= x[2] for b in base)]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))


def test_spans_equal_plain_python(spark):
    rng = random.Random(5)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    parts = [lambda: run(ALPHABET, rng.randint(15, 300)), lambda: run("0123456789ABCDEF", rng.randint(15, 60)), lambda: run("abcdef01", 25),
             lambda: run(ALPHABET + "=_-", 90), lambda: "a" * rng.randint(1, 50), lambda: "token = " + run(ALPHABET, 14), lambda: "AKIA" + run("ABC9", 16),
             lambda: "one_Two-three/" * 3, lambda: "AnotherLongCamelCaseWord", lambda: " é 🙂 ", lambda: run("abc", 30) + run(ALPHABET, 25)]
    rows = [(i, "".join(rng.choice(parts)() + rng.choice(["", " ", "=", "\n"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    got = {r.doc_id: r.spans for r in S.report(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == {i: spans(t) for i, t in rows}
    assert any("entropy" in x for x in got.values())


def test_allowed_forms_are_those_of_the_patterns(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice(["An", "Abc", "ab", "A", "_", "-", "9", "UP", "x", "If", "/"]) for _ in range(rng.randint(1, 7))),) for _ in range(1500)]
    got = frame(spark, rows, "what string").select("what", S.allowed(F.col("what")).alias("ok")).collect()
    assert [r.what for r in got if r.ok != is_allowed(r.what)] == []


def test_long_candidates_and_many_matches(spark):
    rng = random.Random(7)
    long_run = "".join(rng.choice(ALPHABET) for _ in range(100_000))
    rows = [(1, long_run), (2, "token=abcdefghijk12 " * 20_000), (3, "abc_def-" * 20_000), (4, "AbcDef" * 20_000)]
    got = {r.doc_id: r for r in S.report(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got[2].n_assign == 20_000 and got[2].spans.endswith("assign:399980:399999")
    assert got[3].spans == got[4].spans == ""
    assert got[1].spans == spans(long_run)
