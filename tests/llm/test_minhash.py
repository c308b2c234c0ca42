"""Near-duplicate groups against brute force over all pairs."""

import random
import re

import pytest

from tidemark.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    """Component of each (id, text) row: union of all linked pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            shared = len(a & b)
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        what = rng.random()
        if what < 0.6:
            out[at] = f"w{rng.randrange(50)}"
        elif what < 0.8:
            del out[at]
        else:
            out.insert(at, f"w{rng.randrange(50)}")
    return out


def family(seed):
    """Copies with few and many edits, families of families, shared lines, short texts."""
    rng = random.Random(seed)
    rows = []
    for size, copies, most in ((150, 120, 12), (40, 60, 5), (14, 40, 2), (4, 12, 1)):
        base = [f"b{rng.randrange(5000)}" for _ in range(size)]
        other = edited(rng, base, most)
        for _ in range(copies):
            rows.append(" ".join(edited(rng, rng.choice([base, base, other]), rng.randrange(most + 1))))
    rows += [rows[0].upper(), rows[0] + "  ", "", " \n", "one", "ONE", "one two", "é É", "\x1c a b"]
    rng.shuffle(rows)
    return list(enumerate(rows, start=rng.randrange(50)))


@pytest.mark.parametrize("seed,n,percent", [(1, 3, 85), (2, 5, 80)])
def test_groups_equal_brute_force(spark, seed, n, percent):
    rows = family(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_odd_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None), (None, "x y z"), (2, None), (9, "A b  c\td"), (5, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85).collect()), key=str)
    want = [(5, 2, 5, True)] * 3 + [(None, 2, 5, False), (None, 0, None, True), (None, 1, None, True), (2, 0, 2, True), (9, 2, 5, False)]
    assert got == sorted(want, key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_minhash_near_dedup(spark, SF).collect()}
    assert got == brute(rows, 3, 85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 900), (901, 900)], "a long, b long")
    got = {r.node: r.label for r in minhash.connected(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 900: 500, 901: 500}


def test_bands():
    assert (1 - 0.85**6) ** minhash.bands_for(0.85) <= 1e-6


def copies(n, length, edits, seed=1):
    """Edited copies of one text and copies of some of these copies."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(length)]
    pool, out = [base], []
    for _ in range(n):
        words = list(rng.choice(pool) if rng.random() < 0.3 else base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
        if rng.random() < 0.02:
            pool.append(words)
    return list(enumerate(out))


def test_family_of_edited_copies(spark, monkeypatch):
    rows = copies(700, 90, 7)
    turns = []
    step = minhash._next_stars
    monkeypatch.setattr(minhash, "_next_stars", lambda stars, *a: turns.append(stars.count()) or step(stars, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == brute(rows, 3, 85)
    assert len(turns) <= 5 and sum(turns) < 30 * len(rows)  # stars only: no pairs of pairs


def test_one_of_each(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(2, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (None, a, "x"), (None, "z y x", "x"), (None, "z y x", "x"), (None, None, "x"), (7, "", "x"), (7, " ", "x"), (9, a.upper(), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(map(tuple, minhash.one_of_each(df).collect()), key=str)
    want = [(2, a, "x"), (5, b, "x"), (None, "z y x", "x"), (None, None, "x"), (7, "", "x"), (7, " ", "x")]
    assert got == sorted(want, key=str)
    assert minhash.one_of_each(df.limit(0)).collect() == []
