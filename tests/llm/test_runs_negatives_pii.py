"""Operators 11 to 13 against plain versions written from their definitions."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives, pii, queries, runs

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=6, min_exponent=4):
    out = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, min_exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_and_periodic_words():
    rnd = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            n, k = rnd.randint(0, 50), rnd.randint(1, 4)
            w = [rnd.choice("abcd"[:k]) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a, p = rnd.randrange(n), rnd.randint(1, 6)
                w = [w[min(a + (i - a) % p, n - 1)] if i >= a else w[i] for i in range(n)]
            docs.append([x.encode() for x in w])
        bars = rnd.choice([(6, 4), (2, 2), (6, 3), (1, 5)])
        for w, (n, got, left) in zip(docs, runs._solve([b" ".join(w) for w in docs], *bars)):
            want = plain_runs(w, *bars)
            assert (n, [(r["start"], r["length"], r["period"]) for r in got]) == (len(w), want)
            assert left.encode() == collapsed(w, want)


def test_runs_operator_edges(spark, rows):
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, "x"), (None, "a b " * 10), (5, "Ha ha " * 8), (5, "Ha ha " * 8), (6, "a b c " * 150_000), (7, "u v " * 7)]
    df = rows([(i, t, "en", 0) for i, t in texts], "doc_id LONG, text STRING, runs STRING, id INT")
    got = runs.find_runs(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, len(r.runs), r.collapsed) for r in got) == sorted(
        [(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 0, "x"), (0, 20, 1, "a b"), (5, 16, 1, "Ha ha"), (5, 16, 1, "Ha ha"), (6, 450_000, 1, "a b c"), (7, 7, 1, "u v")]
    )
    assert runs.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.find_runs(df, min_exponent=1)


def test_runs_query(spark, tmp_path):
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("abcde") + rnd.choice(["", "", "x"]) for _ in range(rnd.randint(0, 60)))) for i in range(150)] + [(150, None), (-7, "q " * 40)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars INT").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    changed = 0
    for i, t in docs:
        w, h = WORDS.findall((t or "").encode()), zlib.crc32(str(i).encode())
        g, n = h // 10, len(WORDS.findall((t or "").encode()))
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
            changed += 1
        want, r = plain_runs(w), got[i]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None
        assert r.n_runs == len(want)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, want)).hexdigest()
    assert changed > 5


def plain_negatives(data, anchor, low=80, keep=5):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in data:
        if i is None or not anchor(i):
            continue
        scored = sorted(((-dot(v, w), j is None, j or 0, m) for j, m, w in data if j != i))
        for s, none, j, _ in [x for x in scored if x[3] == label][:keep]:
            fits = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= 100 * -s][:keep]
            out += [(i, None if none else j, k, None if x[1] else x[2], -s, -x[0]) for k, x in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims,scale", [(3, 20), (8, 400), (6, 1 << 23)])
def test_negatives_equal_all_scores(spark, monkeypatch, dims, scale):
    rnd = random.Random(dims)
    centres = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    data = []
    for i in range(600):
        c = rnd.choice(centres)
        v = [int(scale * (x + rnd.uniform(-0.4, 0.4))) for x in c]
        data.append((i, rnd.randrange(3), v if i % 50 else [0] * dims))
    hot = [int(scale * x) for x in centres[0]]
    data += [(1000 + i, i % 2, hot) for i in range(200)] + [(None, 1, hot), (7000, 2, hot[:2]), (7000, 1, hot), (7100, 2, [])]
    monkeypatch.setattr(negatives, "WINDOW", 16)
    df = spark.createDataFrame(data + data[:40], "id LONG, label INT, v ARRAY<INT>").distinct()
    got = negatives.hard_negatives(df, F.col("id") % 20 == 0, block=32, sample=64, n_directions=6)
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(data, lambda i: i % 20 == 0)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want and len(want) > 100


def test_negatives_bounds_hold_and_prune():
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = np.rint(256 * (centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 16)))).astype(np.int64)
    refs = negatives.directions(rows[:200], 12)
    a = negatives.angles(rows, refs)
    cell = a.argmin(axis=1)
    order = np.lexsort((a[np.arange(900), cell], cell))
    rows, a, cell = rows[order], a[order].astype(np.float32).astype(float), cell[order]
    cuts = negatives.window_starts(np.zeros(900), cell)
    norm = np.linalg.norm(rows, axis=1)
    q = rows[::50]
    low, high = negatives.bounds(negatives.angles(q, refs), np.linalg.norm(q, axis=1), np.minimum.reduceat(a, cuts), np.maximum.reduceat(a, cuts), np.minimum.reduceat(norm, cuts), np.maximum.reduceat(norm, cuts))
    score = negatives.products(q, rows)
    assert (low <= np.minimum.reduceat(score, cuts, axis=1)).all() and (high >= np.maximum.reduceat(score, cuts, axis=1)).all()
    fifth = np.sort(score, axis=1)[:, -6]
    assert (high >= fifth[:, None]).mean() < 0.3


def test_negatives_rows_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, -0.001], 3), (1, [0.5, -0.001], 3), (2, [nan, 0.0], 1), (3, [inf, 0.0], 1), (4, None, 1), (5, [0.1, None], 1), (6, [0.1, 0.2], None), (7, [1e30, 0.0], 1), (None, [0.25, 0.0], 0)]
    df = spark.createDataFrame(data, "vec_id LONG, embedding ARRAY<FLOAT>, label INT").withColumn("id", F.lit("x"))
    assert sorted(map(tuple, negatives.whole_rows(df).collect()), key=str) == [(1, 3, [128, -1]), (None, 0, [64, 0])]
    empty = negatives.whole_rows(df.limit(0))
    assert negatives.hard_negatives(empty, F.col("id") == 1).collect() == []
    assert negatives.hard_negatives(negatives.whole_rows(df), F.col("id") == 1).collect() == []


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c)) % 10 + (2 * int(c)) // 10 for k, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in zip(pii.KINDS, (EMAIL, IP, CARD, PHONE)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            bad = kind == "ip" and max(map(int, m.group().split("."))) > 255
            bad |= kind == "card" and not (16 <= len(d) <= 19 and luhn(d))
            bad |= kind == "phone" and not 8 <= len(d) <= 15
            if not bad:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, rows):
    rnd = random.Random(4)
    texts = ["", "a@b.c_d@e.f x@y.z.", "1.2.3.4.5 1.2.3.256 001.02.3.4", "+1 (017) 555-7713+49 (0) 30 1234567", "é😀 4111 1111 1111 1111 ü@ä.de a@b.c" + ".d" * 3000]
    texts += ["".join(rnd.choice(["a", "@", ".", "b-", "+", "1", "42", "255", "(", ") ", " ", "4111111111111111", "x@y.de", "\n", "ß"]) for _ in range(rnd.randint(1, 80))) for _ in range(200)]
    texts += ["x" * 30_000 + "@y.z", " ".join(["a@b.c"] * 3000), "9 " * 20_000]
    df = rows([(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (None, "a@b.c", "s"), (None, "a@b.c", "s")], "doc_id LONG, text STRING, kind STRING")
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts) + 3 and sorted(len(r.base) for r in got if r.doc_id is None) == [1, 1]
    for r in got:
        if r.doc_id is not None:
            text = texts[r.doc_id] if r.doc_id < 900 else ""
            assert [(pii.KINDS[s.kind], s.start, s.end) for s in r.base] == plain_base(text), text[:80]
    assert pii.personal_data(df.limit(0)).collect() == []


def test_pii_discovers_by_context(spark, rows):
    mail = [(i, f"somebody said: please write to me at user{i}@host{i}.example.com today or never") for i in range(6)]
    phone = [(20 + i, f"call my office on +49 30 1234{i}67{i} before noon") for i in range(5)]
    other = [(40, "well, please write to me at ann(at)mail.example.org soon"), (41, "call my office on 030 99887766 or not"), (42, "it costs 1234567 and more")]
    other += [(43, "in another form 49 30 1234 067 0 it stands alone"), (44, "ask ann(at)mail.example.org too"), (45, None)]
    # copies of one document are one value: they never make a pattern
    copies = [(60 + i, "the number of the house +1 222 333 4444 and the number of the tree 555 666 7777") for i in range(30)]
    data = mail + phone + other + copies
    got = {r.doc_id: r for r in pii.personal_data(rows(data, "doc_id LONG, text STRING")).collect()}
    added = {i: [(t or "")[s.start : s.end] for s in got[i].added] for i, t in data if got[i].added}
    assert added == {40: ["ann(at)mail.example.org"], 41: ["030 99887766"], 43: ["49 30 1234 067 0"], 44: ["ann(at)mail.example.org"]}


def test_pii_frequent_words_are_no_pattern(spark, rows):
    seeds = [(i, f"and the +1 222 333 44{i:02d} or") for i in range(20)]
    noise = [(100 + i, f"and the house {i} and the tree and the garden and the cat") for i in range(60)]
    data = seeds + noise + [(500, "and the 555 666 7777 or")]
    trust = pii.personal_data(rows(data, "doc_id LONG, text STRING"), pattern_bar=0.6)
    # "or" follows numbers only and stays; without it "and the" is far below the bar
    assert [len(r.added) for r in trust.filter("doc_id = 500").collect()] == [1]
    plain = rows([(i, t.replace(" or", "")) for i, t in data], "doc_id LONG, text STRING")
    assert [len(r.added) for r in pii.personal_data(plain).filter("doc_id = 500").collect()] == [0]


def test_pii_query(spark, tmp_path):
    docs = [(1, "mail a.b@c.de or 4111-1111-1111-1111 from 10.0.0.255"), (2, None), (3, "call +1 (017) 555-7713")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars INT").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_pii(spark, str(tmp_path)).collect()}
    for i, t in docs:
        base = plain_base(t or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        r = got[i]
        assert (r.spans, r.base_sha256) == (text, hashlib.sha256(text.encode()).hexdigest())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in pii.KINDS]


def test_pii_patterns_count_in_documents_without_digits(spark, rows):
    seeds = [(i, f"and the +1 222 333 44{i:02d} and") for i in range(8)] + [(50, "and the 555 666 7777 and")]
    noise = [(100 + i, "and the house and the tree and the garden and the cat and so on") for i in range(60)]
    alone = pii.personal_data(rows(seeds, "doc_id LONG, text STRING"))
    assert [len(r.added) for r in alone.filter("doc_id = 50").collect()] == [1]
    # the same words stand mostly beside other things, in documents with neither digit nor at sign
    both = pii.personal_data(rows(seeds + noise, "doc_id LONG, text STRING"))
    assert [len(r.added) for r in both.filter("doc_id = 50").collect()] == [0]


def test_only_words_of_patterns_are_counted_and_in_all_texts(spark):
    texts = spark.createDataFrame([(k, f"call me now w{'abcdefghij'[k % 10]}{'xyz' * (k % 7)} call  me") for k in range(300)], "id LONG, text STRING")
    wanted = spark.createDataFrame([("call me",), ("now",), ("never",)], "words STRING")
    got = {r.words: r.total for r in pii.word_counts(texts, wanted).collect()}
    assert got == {"call me": 600, "now": 300}
    assert pii.word_counts(texts, wanted.limit(0)).collect() == []
