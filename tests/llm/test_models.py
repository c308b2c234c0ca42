"""Classifiers on held-out rows, decontamination against brute force, the pipeline end to end."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, features, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out_scores(spark, query, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    return [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_held_out(spark):
    rows = held_out_scores(spark, queries.op3_quality_classifier, "quality")
    assert sum(p == y for p, y in rows) >= 0.95 * len(rows)


def test_toxicity_held_out_keeps_clean(spark):
    rows = held_out_scores(spark, queries.op6_toxicity, "toxic")
    clean = [p for p, y in rows if not y]
    assert sum(clean) <= 0.05 * len(clean)


def test_toxicity_learns_words():
    rng, grams = random.Random(1), features.WordGrams(toxicity.BITS)
    bad = ["vile", "nasty", "awful"]

    def text(toxic):
        words = [f"w{rng.randrange(20_000)}" for _ in range(rng.randrange(5, 200))] + ["the", "of"] * 5
        if toxic:
            words += rng.sample(bad, 2)
        rng.shuffle(words)
        return " ".join(words)

    y = [int(rng.random() < 0.2) for _ in range(1500)]
    rows = [grams(text(v)) for v in y]
    model = toxicity.fit(rows[:1000], np.array(y[:1000], float))
    dense = model.dense()
    right = sum((features.sigmoid(dense[r].sum() + model.bias) >= 0.3) == v for r, v in zip(rows[1000:], y[1000:]))
    assert right >= 0.97 * 500 and len(model.positions) < 2000


def test_dual_coordinate_descent_optimum():
    """Against subgradient steps on the same objective."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x @ [1, -2, 0.5, 0, 1] + rng.normal(size=60) > 0).astype(float)
    rows, values = [np.arange(5)] * 60, list(x)
    w, b = quality.dual_coordinate_descent(rows, values, y, 5, rounds=500)
    sign = 2 * y - 1
    upper = np.where(y == 1, 30 / y.sum(), 30 / (60 - y.sum()))
    value = lambda w, b: (w @ w + b * b) / 2 + (upper * np.maximum(0, 1 - sign * (x @ w + b))).sum()
    v, best = np.zeros(6), np.inf
    for t in range(1, 20_000):
        active = upper * sign * (sign * (x @ v[:5] + v[5]) < 1)
        v -= (v - np.r_[active @ x, active.sum()]) / (t + 50)
        best = min(best, value(v[:5], v[5]))
    assert value(w, b) <= best * 1.001


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_odd_rows(spark, operator):
    label = "quality" if operator is quality else "toxic"
    docs = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, ""), (3, "w " * 30_000), (4, "é🙂 ***")], "doc_id long, text string")
    docs = docs.selectExpr("*", "'c' AS score", "1 AS y")
    labels = spark.createDataFrame([(1, None), (2, 1), (None, 0), (4, 0), (4, 1), (77, 1)], f"doc_id long, {label} int")
    rows = operator.classify(spark, docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert operator.classify(spark, docs, labels.limit(0)).count() == 6
    assert operator.classify(spark, docs.limit(0), labels).count() == 0


def test_features():
    style, words = features.StyleGrams(10), features.WordGrams(10)
    assert len(words("")) == 0 and len(style("")) == 0
    assert set(words("B a")) == set(words("b, A!")) and len(words("one")) == 1
    assert set(style("a b c")) != set(style("A B C"))
    assert features.shape_of("***") == features.PUNCTUATION and features.shape_of("|") == features.BAR


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(2)
    for _ in range(300):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 30))])
        b = np.array([rng.randrange(7) for _ in range(rng.randint(0, 60))], np.int64)
        at = np.arange(len(b)) * 3
        n, first, last = decontaminate.lcs(a, b, at)
        assert n == plain_lcs(a.tolist(), b.tolist())
        if n:
            assert plain_lcs(a.tolist(), b[first // 3 : last // 3 + 1].tolist()) == n


def planted(seed):
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"r{rng.randrange(30_000)}"
    items = [(k, [word() for _ in range(rng.randint(15, 70))]) for k in range(30)]
    docs, want = [], set()
    for d in range(400):
        text = [word() for _ in range(rng.choice([3, 40, 200, 900]))]
        if d % 4 == 0:
            k, item = rng.choice(items)
            put = list(item)
            for _ in range(len(put) // 10 if d % 8 else 0):
                put[rng.randrange(len(put))] = word()
            at = rng.randrange(len(text) + 1)
            text[at:at] = put
            want.add((d, k))
        docs.append((d, " ".join(text).capitalize() + "."))
    return docs, [(k, ", ".join(t)) for k, t in items], want


def test_decontamination_finds_plants(spark):
    docs, items, want = planted(5)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, cosine string").repartition(5)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, " . ")], "item_id long, text string")
    for block in (256, 11):
        got = decontaminate.contaminated(df, bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(docs)
    for r in got:
        words = decontaminate.words_of(texts[r.doc_id])[r.first_word : r.last_word + 1]
        item = decontaminate.words_of(dict(items)[r.item_id])
        assert plain_lcs(item, words) >= 0.6 * min(48, len(item)) * 0.5
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_answers(spark):
    item = " ".join(f"q{k}" for k in range(30))
    docs = spark.createDataFrame([(1, item + " blue whale"), (2, item), (None, item + " blue whale"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, "Blue whale")], "item_id long, text string, answer string")
    got = decontaminate.contaminated(docs, bench, answer_col="answer").collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, None]


def test_decontamination_of_copies(spark):
    """A third of the rows copy a document with an item, another item is a short document many times over."""
    rng = random.Random(9)
    text = lambda n: [f"r{rng.randrange(20_000)}" for _ in range(n)]
    items = [text(13), [f"f{k % 7}" for k in range(20)], text(30)]
    copy = text(119) + items[0] + text(119)
    docs = [(d, " ".join(copy if d % 3 == 0 else items[1] if d % 3 == 1 and d < 150 else text(200))) for d in range(450)]
    docs += [(450, " ".join(text(90) + items[0] + text(90))), (451, " ".join(text(90) + items[1] + text(90)))]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bench).collect()
    want = {(d, 0) for d in range(0, 450, 3)} | {(450, 0), (451, 1)} | {(d, 1) for d in range(1, 150, 3)}
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_decontamination_latent(spark):
    """An item thinned out between foreign words is found by its subject, not by the words of one window."""
    rng = random.Random(4)
    words = [[f"t{k}w{j}" for j in range(48)] for k in range(40)]
    foreign = lambda: f"r{rng.randrange(20_000)}"
    docs = []
    for d in range(600):
        docs.append((d, " ".join(w for _ in range(80) for w in (rng.choice(words[d % 40]), foreign()))))
    for d in range(4):
        some = sorted(rng.sample(range(48), 31))
        docs.append((900 + d, " ".join(x for n, j in enumerate(some) for x in (words[d][j], *(foreign() for _ in range(2 + n % 2))))))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r.cosine for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {(900 + d, d) for d in range(4)} and max(got.values()) < 0.3
    assert decontaminate.contaminated(df, bench, latent=1.1).count() == 0


def test_decontamination_at_any_size(spark):
    """Verbatim items pass with a million times the passages, each item in a block of its own."""
    rng = random.Random(3)
    text = lambda n: [f"r{rng.randrange(5_000)}" for _ in range(n)]
    items = [text(15) for _ in range(3)]
    docs = [(d, " ".join(text(60) + items[d] + text(60))) if d < 3 else (d, " ".join(text(200))) for d in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for k, item in enumerate(items):
        found, vocabulary = decontaminate.queries_of([Row(item_id=k, text=" ".join(item), answer=None)], 48)
        table = decontaminate.known_words(df, vocabulary).withColumn("counts", F.transform("counts", lambda n: n * 1_000_000))
        space = decontaminate.decompose(table, found, len(vocabulary), 0.01)
        rows = decontaminate.search(table.filter("n_words >= 0"), space, cosine=0.3, least=0.6, least_answer=0.5, latent=1.1).collect()
        assert [(r.doc_id, r.item_id) for r in rows] == [(k, k)]


def brute_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    out = set()
    for r in docs:
        text = b" " + b" ".join(decontaminate.words_of(r.text or "")) + b" "
        out |= {(r.doc_id, i.item_id) for i in items if b" " + b" ".join(decontaminate.words_of(i.text)) + b" " in text}
    return out


def test_whole_items_in_documents(spark):
    want = brute_items(spark, SF)
    got = {(r.doc_id, r.item_id) for r in queries.op5_benchmark_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= 1.1 * len(want) + 2


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, kept, SF))
        assert sorted(kept.columns) == sorted(corpus_pipeline.COLUMNS)
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {d for d, _ in brute_items(spark, SF)}
    once = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert once == ids


def test_pipeline_stages_on_odd_rows(spark):
    rows = [(None, None, "en", "s", 1), (None, "a b c d e f", "en", "s", 1), (1, "", None, None, None), (2, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, None, None]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert sorted(stage(spark, docs, SF).columns) == sorted(corpus_pipeline.COLUMNS)


def test_pipeline_contaminated_rows_by_text(spark):
    """A contaminated row without an id goes; a clean row with a contaminated row's id stays."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, item, "en", "s", 1), (None, "clean", "en", "s", 1), (None, None, "en", "s", 1), (5, item, "en", "s", 1), (5, "clean", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_contaminated(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == [(5, "clean"), (None, "clean"), (None, None)]


def test_a_repeated_labelled_document_counts_once(spark):
    texts = [(i, f"word{i} and more{i}") for i in range(40)] + [(3, "word3 and more3")] * 500
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows, y = features.labelled_sample(docs, labels, "toxic", lambda: features.WordGrams(16), 1000)
    wanted = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    assert len(rows) == len(y) == wanted == len({r.tobytes() for r in rows})


def test_features_of_the_sample_stay_off_the_driver(spark, monkeypatch):
    """The model of the sample is what the driver's own fit gives; the features are not sent to it."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and more{i % 5} of{i}") for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    mine = toxicity.fit(*features.labelled_sample(docs, labels, "toxic", lambda: features.WordGrams(toxicity.BITS), 50))

    def refused(self, *args, **kwargs):
        raise AssertionError("features sent to the driver")

    monkeypatch.setattr(type(docs), "toArrow", refused)
    got = toxicity.train(docs, labels, 50)
    assert got.bias == mine.bias and (got.positions == mine.positions).all() and (got.weights == mine.weights).all()
    assert quality.train(docs, labels, 50).weights.any()
    assert toxicity.train(docs.limit(0), labels).bias == toxicity.fit([], mine.weights[:0]).bias
