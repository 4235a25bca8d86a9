"""Toxicity, secrets, shards, contamination, page text."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpus import BANK, DOCS, documents, frame, sentence
from seclog.llm import contamination, pages, secrets, sharding, toxicity

# --- toxicity ---------------------------------------------------------------------------


def toxic_rows(n=1500, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        words = sentence(rng, rng.randint(20, 150)).split()
        if bad:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblot", "snarkel", "vexu" + rng.choice(["a", "o", "ti", "ra"])]))
        docs.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, None, int(bad)))
    return docs, labels + labels[:30] + [(None, 1, 1), (5, 1, None)]


def test_held_out_texts_are_told_apart(spark):
    docs, labels = toxic_rows()
    docs += [(9001, None), (9002, ""), (9003, "  ")]
    out = toxicity.score(frame(spark, docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs)
    truth = {i: t for i, _, t in labels if t is not None}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    texts = dict(docs)
    for r in out:
        for p in r.passages:
            assert any(w in texts[r.doc_id][p.start:p.end] for w in ("grumblot", "snarkel", "vexu")) and p.expected <= toxicity.SIGNIFICANT


def test_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, documents())
    assert {(r.score, r.predicted) for r in toxicity.score(docs, none).collect()} == {(0.0, 0)}
    assert toxicity.reject_toxic(docs, none).count() == docs.count()
    assert toxicity.score(frame(spark, [], DOCS), none).count() == 0


def test_rejected_texts_go_and_the_rest_keep_their_columns(spark):
    docs, labels = toxic_rows()
    rows = [(i, t, None, "s", len(t), "own", i, None, "here") for i, t in docs]
    table, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {tuple(r) for r in toxicity.reject_toxic(table, marks).collect()}
    clean = {r.doc_id for r in toxicity.score(table, marks).collect() if not r.predicted}
    assert kept == {r for r in rows if r[0] in clean}


def test_maximal_segments_are_ruzzo_and_tompa_s():
    assert toxicity.maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(-4, 5, rng.integers(1, 30)).astype(float)
        best = max((x[a:b].sum() for a in range(len(x)) for b in range(a + 1, len(x) + 1)))
        found = toxicity.maximal_segments(x)
        assert max([s for *_, s in found], default=0) == max(best, 0)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


# --- secrets ----------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def secret_texts():
    rng = random.Random(6)
    some = ['password = "abcdefghijkl"', "é🙂 Api_Key: 0123456789abcdef0123", "token=api_key: longvalue123456", "secret:short", "AKIA" + "Z9" * 8, "AKIAAKIA" + "Q" * 9,
            "xAKIAAB deadbeefdeadbeef00", "tokEN='aaaaaaaaaaaaaaaa'", "PASSWD=a.b-c_d/e+f=g", "Kx9Qp2Lm7Rt4Vw1Zy8Bn3Cd6Fg5Hj0", "123e4567-e89b-12d3-a456-426614174000"]
    texts = [None, "", *some]
    alphabet = list("AKI0fabct=:\" '_-.é🙂\n") + ["token", "secret", "AKIA", "password", "deadbeef01234567"]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]
    return texts


def test_patterns_are_found_as_described(spark):
    rows = list(enumerate(secret_texts()))
    out = {r.doc_id: r for r in secrets.report(frame(spark, rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(k == kind for k, *_ in want) for kind in secrets.KINDS[:3]]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert out[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in out[i].spans.split(",") if s and not s.startswith("entropy")] == [s for s in listed.split(",") if s]
    by_text = {t: out[i].spans for i, t in rows}
    assert by_text["Kx9Qp2Lm7Rt4Vw1Zy8Bn3Cd6Fg5Hj0"] == "entropy:0:30"
    assert by_text["123e4567-e89b-12d3-a456-426614174000"] == ""


def test_windows_have_the_entropy_of_their_counts(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["".join(rng.choices("abC9dEf1" if i % 2 else "aA1zQ7+k/Rt", k=rng.randint(20, 60))) for i in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.window_runs(F.col("w")).alias("r")).collect()
    for row in got:
        bits = next(b for _, p, b in secrets.CLASSES if re.match(p, row.w))
        hits = []
        for i in range(len(row.w) - 19):
            own = row.w[i:i + 20]
            if -sum(own.count(c) / 20 * math.log2(own.count(c) / 20) for c in set(own)) >= bits - 1e-9:
                if hits and hits[-1][1] >= i:
                    hits[-1][1] = i + 20
                else:
                    hits.append([i, i + 20])
        assert [[x.a, x.b] for x in row.r] == hits


def test_redaction_keeps_all_rows_and_columns(spark):
    rows = [(i, t, None, "s", None if t is None else len(t), "own", i, 4, "here") for i, t in enumerate(secret_texts())]
    out = {r.doc_id: r for r in secrets.redact(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for row in rows:
        want, at = row[1], 0
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in secrets_of(spark, row[1]))] if row[1] and base_spans(row[1]) else None
        if spans is None:
            continue
        text = ""
        for a, b in sorted(spans):
            if a >= at:
                text += want[at:a] + "[secret]"
            at = max(at, b)
        text += want[at:]
        assert out[row[0]].text == text and out[row[0]].n_chars == len(text) and out[row[0]].spans == "own" and out[row[0]].base == 4
    assert secrets.redact(frame(spark, [], DOCS)).columns == frame(spark, [], DOCS).columns


SPANS = {}


def secrets_of(spark, text):
    if not SPANS:
        rows = list(enumerate(secret_texts()))
        texts = dict(rows)
        SPANS.update({texts[r.doc_id]: [s for s in r.spans.split(",") if s] for r in secrets.report(frame(spark, rows, "doc_id long, text string")).collect()})
    return SPANS[text]


# --- shards -----------------------------------------------------------------------------


def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark):
    rows = [r[:2] for r in documents()] * 3 + [(None, "x")] * 40
    out = sharding.shard(frame(spark, rows, "doc_id long, text string"), shards=7).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = [sorted(r.slot for r in out if r.shard == s) for s in range(7)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
    assert sharding.shard(frame(spark, [], DOCS)).count() == 0


def test_another_shard_moves_few_rows():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, sharding.RING, 20_000)

    def where(shards):
        places, owner = sharding.ring(shards)
        arc = np.searchsorted(places, keys, "left") % len(places)
        order = np.argsort(arc, kind="stable")
        out = np.empty(len(keys), int)
        rank = {a: order[np.searchsorted(arc[order], a):] for a in np.unique(arc)}
        for a, lo, hi, shard, _ in sharding.place(np.bincount(arc, minlength=len(places)), owner, shards).tolist():
            out[rank[a][lo:hi]] = shard
        return out

    before, after = where(24), where(25)
    assert np.mean(before != after) < 0.35  # 0.04 at least; dealing by remainder moves 0.96


# --- contamination ----------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    words = lambda t: WORD.findall((t or "").encode().lower())
    windows = {}
    for name, t in items:
        own = words(t)
        for k in range(len(own) - min(13, len(own)) + 1 if own else 0):
            windows.setdefault(tuple(own[k:k + 13]), set()).add(name)
    out = {}
    for i, t in docs:
        own = words(t)
        hit, found = [0] * len(own), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                names = windows.get(tuple(own[k:k + n]), set())
                if names:
                    found |= names
                    hit[k:k + n] = [1] * n
        out[i] = (len(own), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(own))
    return out


def bench():
    rng = random.Random(9)
    texts = [sentence(rng, n) for n in (60, 13, 14, 5, 1, 40, 60)]
    return [(str(i), t) for i, t in enumerate(texts)] + [("none", None), ("blank", " .,"), ("é", "Été 12 ünique"), ("0", texts[0])], texts


@pytest.mark.parametrize("piece,held", [(4096, 2_000_000), (20, 30)])
def test_hits_in_one_or_many_slices(spark, monkeypatch, piece, held):
    monkeypatch.setattr(contamination, "PIECE", piece)
    monkeypatch.setattr(contamination, "SLICE_WORDS", held)
    items, texts = bench()
    rows = [r[:2] for r in documents()]
    rng = random.Random(1)
    for k, t in enumerate(texts * 3):
        rows.append((1000 + k, " ".join([sentence(rng, rng.randint(0, 300)), t.upper() if k % 2 else t, "ÉTÉ été 12, ünique", sentence(rng, 3)])))
    out = contamination.report(frame(spark, rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in out} == brute_hits(rows, items)


def test_documents_or_passages_go(spark):
    items, texts = bench()
    rows = documents() + [(2000, "before " + texts[0] + " after", None, None, 1, "own", 2, 3, "here"), (2001, "clean words only", None, None, 1, "own", 2, 3, "here")]
    table, marks = frame(spark, rows), spark.createDataFrame(items, "item_id string, text string")
    want = brute_hits([r[:2] for r in rows], items)
    kept = contamination.decontaminate(table, marks)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(r) for r in rows if not want[r[0]][3])
    cut = {r.doc_id: r for r in contamination.decontaminate(table, marks, cut=True).collect()}
    assert len(cut) == len(rows) and "after" in cut[2000].text and texts[0] not in cut[2000].text and cut[2000].spans == "own"
    none = spark.createDataFrame([], "item_id string, text string")
    assert contamination.decontaminate(table, none).count() == len(rows) and contamination.report(frame(spark, [], DOCS), marks).count() == 0


# --- pages ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=site><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a></li><li><a href="/b">More &gt;</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to remember what you like and to count visits.</div><!-- <p>hidden</p> -->
<article><h1>The  title &eacute;&#33;</h1><p><b>First</b> block<br>goes on &lt;here&gt; with a few more words than the others have
<p>Short.</p><div class="ad">Buy this thing now</div><p>Last one.</article>
<aside><p>Popular posts of this week and of the one before it, with pictures.</p></aside>
<section id="comments"><p>A reader thinks that all of this is wrong and says so at length.</p></section>
<form><label>Mail</label><textarea>type</textarea></form><footer>&copy; someone</footer></body></html>"""


def test_the_article_is_extracted():
    assert pages.main_text(PAGE) == "The title é!\n\nFirst block goes on <here> with a few more words than the others have\n\nShort.\n\nLast one."


def test_pages_without_an_article_are_judged_by_density():
    rng = random.Random(3)
    long = [sentence(rng, n) for n in (40, 60, 50)]
    page = "<div><a href=x>One</a> <a href=y>Two</a></div>" + "".join(f"<p>{t}</p>" for t in long) + "<div><a href=z>Next page</a></div>"
    assert pages.main_text(page) == "\n\n".join(long)


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p", ""), ("<article>a<p>b", "a\n\nb"), ("</div></p><article>x</article></article>", "x"),
                                       ("<article>a <script>b", "a"), ("<article>1 < 2 & 3 &nosuch; &#x41;</article>", "1 < 2 & 3 &nosuch; A")])
def test_broken_pages(page, text):
    assert pages.main_text(page) == text


def test_all_pages_come_out(spark):
    rows = [(1, "u", PAGE, "own"), (1, "u", PAGE, "own"), (None, None, None, None), (2, "v", "<article><p>" + "word " * 50_000 + "</article>", "own")]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.n_chars, len(r.text)) for r in out) == sorted([(len(pages.main_text(PAGE)),) * 2] * 2 + [(0, 0), (249_999, 249_999)])
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- words ------------------------------------------------------------------------------


def test_shingles_are_those_of_plain_python():
    import pyarrow as pa
    from corpus import shingles
    from seclog.llm import text as X

    texts = [r[1] for r in documents()]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    for limit in (1, 500, 1 << 20):
        sets = [s for _, data, offsets in X.slices(batch, "text", limit) for s in X.shingle_sets(data, offsets, 3)]
        assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    names = {}
    for own, t in zip(sets, texts):
        words = (t or "").encode().lower().split()
        for h, s in zip(own.tolist(), sorted(shingles(t, 3))) if len(words) <= 3 else ():
            assert names.setdefault(h, s) == s
