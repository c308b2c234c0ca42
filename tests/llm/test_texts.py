"""Token counts, packing, chat formatting, fingerprints and URL verdicts against plain versions."""

import hashlib
import random
import zlib

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import chat, fingerprints, packing, queries, tokens, urls

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "  \n\n two  spaces \n and\ttabs \n"), (4, "the cat's 12 hats, we'll see ÀÉ ǅ ﬁ e\u0301 \u00a0x\u2003y\x1cz"),
    (5, "a<|endoftext|>b <|endoftext|> <|startoftext|>"), (6, "word " * 3000), (7, "日本語 テキスト 🙂🙂 a\u200db"), (7, "the"), (None, "null id text"),
    (9, "x" * 20_000), (10, " lead and trail "), (11, "a\r\nb\r\n\r\n c"), (12, "İstanbul ΣΑΣ ς"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in ODD], "doc_id long, text string, n_tokens string, start int")


def test_token_counts_equal_the_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(map(tuple, tokens.count_tokens(spark, docs, path).collect()), key=str)
    want = []
    for i, t in ODD:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)
    assert tokens.count_tokens(spark, docs.limit(0), path).count() == 0


def test_token_counts_of_documents(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows}


def test_whole_tokens_are_proved():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    proved = tokens.whole_tokens(path)
    assert len(proved) > 20_000
    assert all(len(library.encode(t).ids) == 1 for t in random.Random(1).sample(sorted(proved), 500))


def check_packing(rows, texts, capacity):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in texts]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sum(r.length for r in rows) == sum(map(len, want))
    ids = {}
    for (i, _), w in zip(texts, want):
        ids.setdefault(i, []).append(w)
    for r in rows:
        crc = [zlib.crc32(b"".join(x.to_bytes(4, "little") for x in w[r.start : r.start + r.length])) for w in ids[r.doc_id] if len(w) == r.doc_tokens]
        assert r.ids_crc32 in crc
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
    return by_seq


def test_packing_odd_texts(spark, docs):
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    check_packing(rows, ODD, 2048)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_packing_documents(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    by_seq = check_packing(queries.op8_packing(spark, SF).collect(), texts, 2048)
    sizes = [sum(r.length for r in s) for s in by_seq.values()]
    padding = sum(2048 - n for n in sizes if n & (n - 1))
    assert padding < 0.03 * sum(sizes)


def test_harmonic_cut():
    for n in range(0, 5000):
        cut = packing.harmonic_cut(n, 2048, 16)
        assert sum(cut) == n and all(c > 0 for c in cut) and len(cut) <= n // 2048 + 5
    assert packing.powers(1300) == [1024, 256, 16, 4]


def fold_plainly(events):
    """Event by event: the log's meaning."""
    texts, roles = {}, {}
    for seq, message, kind, role, text in sorted(events, key=lambda e: e[0]):
        if kind == "regenerate":
            texts = {m: t for m, t in texts.items() if m < message}
        texts[message] = (text or "") if kind in ("edit", "regenerate") else texts.get(message, "") + (text or "")
        roles[message] = role if role is not None else roles.get(message)
    return [(roles[m] or "", texts[m]) for m in sorted(texts)]


def test_event_log(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(40):
        events, opened = [], 0
        for seq in range(rng.randint(1, 25)):
            if not opened or rng.random() < 0.3:
                events.append((seq, opened, "delta", rng.choice(["user", "assistant", "a\nb<|"]), rng.choice(["x", "<|im_end|>\n", "<\\|", None, "é🙂"])))
                opened += 1
            else:
                events.append((seq, rng.randrange(opened), rng.choice(["delta", "edit", "regenerate", None]), None, f"t{seq}\\<|im_start|>\n"))
        alive = [(s, m, k or "delta", r, t) for s, m, k, r, t in events]
        want[conv] = fold_plainly(alive)
        rows += [(conv, *e, "extra") for e in events]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string, formatted string")
    out = chat.format_chats(log).select("conv_id", "formatted", "spans", chat.parse(chat.F.col("formatted")).alias("turns")).collect()
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out} == want
    for r in out:
        for span, (role, text) in zip(r.spans, want[r.conv_id]):
            piece = r.formatted[span.start : span.start + span.length]
            assert "<|" not in piece and span.loss == (role == "assistant")
    assert chat.format_chats(log.limit(0)).count() == 0


def test_conversations_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cur = con.execute(queries.OP2_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in queries.op2_chat_formatting(spark, SF).select(*names).collect()) == want


def test_fingerprints(spark):
    texts = ["", None, "one line of some words here and more", "a b\nc d e f g\nh", "c d e f g\na b\nh", "a b\nc d e f g", "h", "w " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    fp = fingerprints.fingerprint(chat.F.col("text"))
    rows = {r.i: r.fp for r in df.select("i", fingerprints.as_text(fp).alias("fp")).collect()}
    assert rows[0] == rows[1] and rows[3] == rows[4] and len(set(rows.values())) == 6
    pair = spark.createDataFrame([("a b\nc d e f g\nh", "a b\nc d e f g", "h")], "x string, y string, z string")
    x, y, z = (fingerprints.fingerprint(chat.F.col(c)) for c in "xyz")
    same = pair.select(fingerprints.removed(x, z).alias("r"), fingerprints.added(y, z).alias("s"), x.alias("x"), y.alias("y")).first()
    assert same.r == same.y and same.s == same.x


def test_fingerprint_query(spark):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op10_fingerprints(spark, SF).collect()}
    assert len(got) == len(rows)
    better = 0
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (sorted(t.split("\n")) == sorted(edited.split("\n")))
        better += r.near_edited > r.near_next
    assert better > 0.9 * len(rows)


def test_next_in_a_ring(spark):
    ids = [None, 5, 5, -3, 10**15, 10**15 + 1, 7] + list(range(100, 400))
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    order = sorted(((-(10**18) if i is None else i), f"t{n}") for n, i in enumerate(ids))
    order = sorted(order, key=lambda r: (-r[0], r[1]))
    want = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    for per_bin in (1, 7, 10_000):
        got = fingerprints.with_next(df, ["text"], per_bin=per_bin, bins=3).collect()
        assert {r.text: r.next.text for r in got} == want
    assert fingerprints.with_next(df.limit(1), ["text"]).first().next is not None
    assert fingerprints.with_next(df.limit(0), ["text"]).count() == 0


def test_urls(spark):
    cases = [
        (1, None, "", "", None), (2, "no scheme", "", "", None), (3, "http://A.NET", "a.net", "", None), (4, "http://A.NET/x?y", "a.net", "/x", "net/"),
        (5, "https://m.example.net/en/1", "m.example.net", "/en/1", "example.net/en/"), (6, "x://example.com/de/#a://b", "example.com", "/de/", "example.com/de/"),
        (7, "x://notexample.com/de/", "notexample.com", "/de/", None), (8, "http://a.org/fr/", "a.org", "/fr/", "org/fr/"), (9, "a\n://b.org/fr/\nq", "b.org", "/fr/\nq", "org/fr/"),
        (10, "http://?q", "", "", None), (None, "http://spam-farm.example.com/en/", "spam-farm.example.com", "/en/", None),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u, *_ in cases], "page_id long, url string, host string")
    labelled = urls.labelled_rows(spark.createDataFrame(queries.LABELLED_URLS, "url string, label int"))
    got = {r.page_id: r for r in urls.judge(df, queries.RULES, labelled).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in got.items()} == {i: (h, p, rule) for i, _, h, p, rule in cases}
    assert got[None].verdict == "block" and got[4].verdict == "block" and got[5].verdict == "allow"
    assert urls.judge(df.limit(0), [], []).count() == 0


def test_url_model_holds_out():
    rows = [(*u.split("://")[1].partition("/")[::2], y) for u, y in queries.LABELLED_URLS]
    rows = [(h, "/" + p, y) for h, p, y in rows]
    right = 0
    for k in range(len(rows)):
        w = urls.fit(rows[:k] + rows[k + 1 :])
        g = urls.grams(rows[k][0], rows[k][1], 16)
        right += (w[g].sum() * len(g) ** -0.5 + w[-1] > 0) == (rows[k][2] == 1)
    assert right >= 0.8 * len(rows)
