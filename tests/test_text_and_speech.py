"""Subtitles, repetition, joins of lines and pattern facts against plain loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import timefmt as tf
from tidemark.operators import speech as sp

WORDS = "so we went over there and nobody said anything about the weather or the long road home".split()


def some_text(rnd):
    out = []
    for _ in range(rnd.randint(1, 5)):
        out.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 22))) + rnd.choice([".", "!", "?", "...", "", ","]))
    return ("- " if rnd.random() < 0.3 else "") + rnd.choice([" ", "", "  "]).join(out) + rnd.choice(["", " ", " -"])


def cleaned(t, width=50):
    t = " ".join(t.split())
    t = re.sub(r"([.!?])([A-Za-z])", r"\1 \2", t)
    t = re.sub(r",(\S)", r", \1", t).strip("- ")
    t = t[:1].upper() + t[1:]
    lines = [""]
    for body, mark in re.findall(r"([^.!?]+)([.!?]?)", t):
        if not body.strip():
            continue
        piece = body.strip() + mark
        if len(lines[-1]) + len(piece) + 1 <= width:
            lines[-1] = (lines[-1] + " " + piece).strip()
        else:
            lines.append(piece)
    return "\n".join(x for x in lines if x)


def chunked(t, limit=80):
    if len(t) <= limit:
        return [t]

    def fill(pieces, joined):
        got, cur = [], ""
        for p in pieces:
            if len(joined(cur, p)) <= limit:
                cur = (cur + " " + p).strip()
            else:
                got += [cur] if cur else []
                cur = p
        return got + ([cur] if cur else [])

    pieces = [b.strip() + m for b, m in re.findall(r"([^.!?]*)([.!?]+|$)", t) if (b.strip() + m)]
    out = []
    for c in fill(pieces, lambda a, b: (a + " " + b).strip()):
        if len(c) <= limit:
            out.append(c)
            continue
        ws = c.split()
        left, right = " ".join(ws[: len(ws) // 2]), " ".join(ws[len(ws) // 2 :])
        uneven = len(right) < 0.3 * len(left) or len(left) > limit
        out += fill(ws, lambda a, b: a + " " + b) if uneven else [left, right]
    return out


def test_cues_equal_the_loop(spark):
    rnd = random.Random(7)
    data = [(v, i, i * 6.0 + rnd.random(), i * 6.0 + rnd.uniform(2, 5), some_text(rnd)) for v in range(3) for i in range(12)]
    data[4] = (*data[4][:4], "oh, oh oh")
    df = spark.createDataFrame(data, "v INT, seg INT, start DOUBLE, end DOUBLE, text STRING")
    got = {(r.v, r.cue): (round(r.start, 6), round(r.end, 6), r.text) for r in sp.subtitle_cues(df, ["v"]).collect()}
    for v in range(3):
        mine = sorted((r for r in data if r[0] == v), key=lambda r: r[2])
        n = 0
        for k, (_, _, s, e, t) in enumerate(mine):
            t = cleaned(t)
            words = re.sub(r"[^\w\s]", "", t.lower()).split()
            stuck = len(words) >= 3 and max(map(words.count, words)) / len(words) > 0.7
            if len(t) < 2 or stuck or re.match(r"^(oh+,?\s*)+$", t.lower()):
                continue
            parts = chunked(t)
            need = [max(0.8, len(p) / 15) for p in parts]
            room = sum(need) if k + 1 == len(mine) else min(sum(need), mine[k + 1][2] - s - 0.1)
            room, at = max(e - s, room), s
            for p, d in zip(parts, need):
                n += 1
                d *= room / sum(need)
                assert got[v, n] == (pytest.approx(at, abs=1e-5), pytest.approx(at + d, abs=1e-5), p)
                at += d
        assert max(c for u, c in got if u == v) == n


def test_repetition_is_cut_at_the_first_repeat(spark):
    a = "The quick brown fox jumps over the lazy dog tonight"
    b = "Completely different words are being used for this sentence here"
    texts = [f"{a}. {b}. {a} again.", f"{a}. {b}.", f"Dog. {a}. {b}.", "Same. Same. Same."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    got = {r.id: (r.at, r.cut) for r in df.select("id", tx.repetition_at(F.col("text")).alias("at"), tx.cut_repetition(F.col("text")).alias("cut")).collect()}
    assert got[0] == (2, f"{a}. {b}.")
    assert got[1] == (None, texts[1])
    assert got[2] == (1, "Dog.")  # a one-word sentence is contained in the next
    assert got[3][0] is None


def test_joined_lines_equal_the_loop(spark):
    rnd = random.Random(3)
    data = []
    for v in range(2):
        t = 0.0
        for i in range(40):
            t = round(t + rnd.choice([0.0, 0.2, 0.4, 0.5, 1.5]), 2)
            d = rnd.choice([0.5, 1.0, 2.5, 3.5])
            data.append((v, i, t, round(t + d, 2), rnd.choice(["a", "b.", "c"])))
            t = round(t + d, 2)
    df = spark.createDataFrame(data, "v INT, seg INT, start DOUBLE, end DOUBLE, text STRING")
    got = sorted((r.v, r.start, r.end, r.text) for r in sp.join_up(df, ["v"]).collect())
    want = []
    for v in range(2):
        out = []
        for _, _, s, e, t in (r for r in data if r[0] == v):
            p = out[-1] if out else None
            if p and s - p[2] < 0.5 and e - p[1] <= 6 and p[2] - p[1] < 3 and e - s < 3 and p[3][-1] not in ".!?":
                out[-1] = (v, p[1], e, p[3] + " " + t)
            else:
                out.append((v, s, e, t))
        want += out
    assert got == sorted(want)


def test_pause_marks_equal_the_loop(spark):
    rnd = random.Random(5)
    data, t = [], 0.0
    for i in range(60):
        t += rnd.choice([0.5, 1.0, 3.0])
        data.append((1, i, t, t + 2.0))
        t += 2.0
    df = spark.createDataFrame(data, "v INT, seg LONG, start DOUBLE, end DOUBLE")
    got = {r.seg: (r.pause, r.stamp) for r in sp.pause_marks(df, ["v"], pause=2.0, every=30.0).collect()}
    shown = None
    for k, (_, i, s, _) in enumerate(data):
        gap = None if k == 0 else s - data[k - 1][3]
        stamp = k == 0 or gap >= 2.0 or s - shown > 30.0
        shown = s if stamp else shown
        assert got[i] == (gap if gap is not None and gap >= 2.0 else None, stamp)


def test_pattern_facts_equal_the_loop(spark):
    from tidemark.operators.scoring import ACTION_PATTERNS, TRANSITIONS, pattern_facts

    rnd = random.Random(1)
    names = ["walking", "standing", "entering", "talking", "running", "jumping"]
    data = [(1, rnd.randint(0, 60), rnd.choice(names), round(rnd.random(), 4)) for _ in range(60)]
    df = spark.createDataFrame(data, "v INT, t INT, name STRING, conf DOUBLE")
    got = sorted((r.t, r.kind, r.fact, round(r.confidence, 6)) for r in pattern_facts(df, ["v"], t="t", name="name").collect())
    want = []
    for g in range(0, 70, 5):
        near = sorted(((c, n) for _, t, n, c in data if abs(t - g) <= 3), key=lambda x: -x[0])
        seen = {n for _, n in near}
        for p, words in ACTION_PATTERNS.items():
            share = sum(any(w in n or n in w for n in seen) for w in words) / len(words)
            if share >= 0.6:
                want.append((g, "pattern", p, round(share * 0.8, 6)))
        if len(near) >= 3:
            want.append((g, "activity", "high" if len(near) >= 5 else "moderate", round(min(0.9, 0.5 + len(near) * 0.05), 6) if len(near) >= 5 else 0.6))
        top = [n for _, n in near[:4]]
        for i in range(len(top)):
            for j in range(i + 1, len(top)):
                if (top[i], top[j]) in TRANSITIONS or (top[j], top[i]) in TRANSITIONS:
                    want.append((g, "transition", f"{top[i]}>{top[j]}", 0.7))
                    break
            else:
                continue
            break
    assert got == sorted(want)


def test_time_tokens(spark):
    cases = {"1:02:03.5": 3723.5, "02:03": 123.0, " 45 ": 45.0, "7.25": 7.25, "x": None, "1:2:3:4": None}
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    assert {r.t: r.s for r in df.select("t", tf.parse_time(F.col("t")).alias("s")).collect()} == cases
    df = spark.createDataFrame([("1:00-1:30",), ("30-10",), ("5 → 9",), ("1 to 2",)], "t STRING")
    got = [r.r and tuple(r.r) for r in df.select(tf.parse_range(F.col("t")).alias("r")).collect()]
    assert got == [(60.0, 90.0), None, (5.0, 9.0), (1.0, 2.0)]


def test_first_repetitions_equal_comparing_all(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(60)]
    docs = []
    for i in range(60):
        said = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 8, 9, 12, 15]))) for _ in range(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 2)):
            if said:
                again = rnd.choice(said).split()
                said.append(" ".join(w if rnd.random() > 0.15 else rnd.choice(words) for w in again))
        docs.append((i, "; ".join(s.capitalize() for s in said)))
    docs += [(900, "Same. Same. Same."), (901, None), (902, "")]
    df = spark.createDataFrame(docs, "id INT, text STRING")
    want = {r.id: r.at for r in df.select("id", tx.repetition_at(F.col("text")).alias("at")).collect() if r.at is not None}
    got = {r.id: r.cut_at for r in sp.first_repetitions(df, ["id"]).collect()}
    assert got == want and len(want) > 15


def test_rebased_chunks_keep_every_long_line(spark, tmp_path):
    from tidemark.plans import load_all

    rows = [(1, 0, "user", "oh oh oh"), (1, 3, "user", "well well well well"), (1, 4, "user", "  a  "), (1, 5, "user", "\u00a0ab\u00a0"), (1, 6, "user", None), (1, 7, "user", "yes")]
    spark.createDataFrame(rows, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.seg, r.start, r.chars) for r in load_all()["x14_rebased_chunks"].run(spark, str(tmp_path)).collect())
    assert got == [(0, 0.0, 8), (3, 610.0, 19), (7, 1810.0, 3)]
    lines = spark.createDataFrame([(0, 0.0, 5.0, "oh oh oh", 0), (1, 1.0, 6.0, "a word", 1)], "seg LONG, start DOUBLE, end DOUBLE, text STRING, chunk LONG")
    assert [(r.seg, r.start) for r in sp.rebase_chunks(lines).collect()] == [(1, 601.0)]


def test_speech_cover_adds_in_the_order_of_time(spark):
    spans = [(v, s, s + d) for v in range(300) for s, d in zip((0.0, 7.0, 14.0, 21.0), (0.1 + v % 7 * 0.05, 6.15, 0.3, 5.85))]
    chapters = [(v, 1, 0.0, 30.0) for v in range(300)]
    rows = spark.createDataFrame(spans, "video_id LONG, start DOUBLE, end DOUBLE").repartition(64, "start", "end")
    got = sp.speech_cover(rows, spark.createDataFrame(chapters, "video_id LONG, number INT, start DOUBLE, end DOUBLE"), ["video_id"])
    want = {}
    for v, a, b in spans:
        want[v] = want.get(v, 0.0) + (b - a)
    assert {r.video_id: r.speech_seconds for r in got.collect()} == want


def test_first_repetitions_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "One and one. One and one."), (2, None)], "id INT, text STRING")
    plan = sp.first_repetitions(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_line_weights_and_marks_by_loop(spark):
    rnd = random.Random(9)
    said = lambda: " ".join(rnd.choice("oak elm ash fir yew bay fig nut".split()[: rnd.randrange(2, 9)]) for _ in range(rnd.randrange(0, 14)))
    data = [(v, c, i, i * 10.0, said()) for v in (1, 2) for c in (1, 2, 3) for i in range(5)]
    data += [(1, 1, 0, 0.0, "fir fir oak"), (3, 1, 0, 0.0, "oak elm"), (4, 1, 0, 0.0, None), (4, 2, 0, 0.0, "")]
    lines = spark.createDataFrame(data, "video_id INT, number INT, seg INT, start DOUBLE, text STRING")
    k = ["video_id", "number"]
    totals = sp.doc_totals(lines, k)
    got = sp.line_weights(lines, totals, ["video_id"], "number", ["seg", "start"], least=1.1).cache()
    keyed = {(r.video_id, r.number, r.word): r for r in sp.keyness(sp.word_counts(lines, k), totals, ["video_id"], "number").collect()}
    want = {}
    for v, c, i, _, text in data:
        for word in (text or "").split():
            want.setdefault((v, c, i), {}).setdefault(word, []).append(word)
    rows = {(r.video_id, r.number, r.seg): r for r in got.collect()}
    assert set(rows) == set(want)
    for (v, c, i), words in want.items():
        gain = {w: max(0.0, math.log(max(keyed[v, c, w].keyness, 1e-9))) if (v, c, w) in keyed else 0.0 for w in words}
        n = sum(map(len, words.values()))
        r = rows[v, c, i]
        assert r.words == n and abs(r.distinct_weight - sum(gain.values())) < 1e-9
        assert abs(r.weight - sum(gain[w] * len(x) for w, x in words.items()) / n**0.5) < 1e-9
    marked = {(r.video_id, r.number, r.word): (r["count"], r.keyness, r.doc_words) for r in sp.marked_words(got, ["video_id"], "number").collect()}
    assert marked == {key: (r["count"], r.keyness, r.doc_words) for key, r in keyed.items() if r["count"] >= 2 and r.keyness >= 1.1} != {}


def test_words_of_lines_are_shuffled_once(spark, tmp_path):
    from tidemark.plans import load_all

    rnd = random.Random(2)
    letters = "abcdefghijklmnop"
    talk = [(v, t, "user", " ".join("".join(rnd.choices(letters, k=6)) for _ in range(25))) for v in range(60) for t in range(8)]
    spark.createDataFrame(talk, "conv_id LONG, turn LONG, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    gateway = spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()

    def sent():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = sent()
    assert load_all()["t14_unmeasured_claims"].run(spark, str(tmp_path)).count()
    # each line is heard in one or two chapters
    assert sum(n for k, n in sent().items() if k not in before) < 2.5 * 25 * len(talk)
