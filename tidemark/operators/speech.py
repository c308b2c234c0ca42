"""Transcript operators: turns, keyword matches, coverage, keyness, quotes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import first_keyword, tokens
from tidemark.operators.axis import run_ids
from tidemark.operators.joins import overlap_pairs, points_in_spans


def merge_turns(
    segments: DataFrame, keys: Sequence[str], *, tie: str, max_pause: float = 0.5
) -> DataFrame:
    """Neighbouring segments of one speaker joined when the pause is short."""
    ran = run_ids(
        segments,
        keys,
        ["start", tie],
        F.struct(F.col("speaker").alias("s"), F.col("end").alias("e")),
        lambda p: (p["s"] != F.col("speaker")) | (F.col("start") - p["e"] >= max_pause),
        "_run",
        "start",
    )
    return (
        ran.groupBy(*keys, "_run", "speaker")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
        .drop("_run")
    )


def keyword_matches(
    segments: DataFrame,
    keys: Sequence[str],
    keywords: Sequence[str],
    *,
    seg: str,
    context: float = 5.0,
) -> DataFrame:
    """Segments holding a keyword, with the segments contained around them."""
    main = (
        segments.select(*keys, seg, "start", "end", first_keyword(F.col("text"), keywords).alias("keyword"))
        .filter(F.col("keyword").isNotNull())
        .select(
            *keys,
            seg,
            "keyword",
            (F.col("start") - context).alias("lo"),
            (F.col("end") + context).alias("hi"),
        )
    )
    around = segments.select(
        *keys, F.col(seg).alias("_c"), F.col("start").alias("_cs"), F.col("end").alias("_ce")
    )
    pairs = points_in_spans(
        around, main, keys, t="_cs", start="lo", end="hi", closed_end=True
    ).filter(F.col("_ce") <= F.col("hi"))
    return pairs.groupBy(*keys, seg, "keyword", "lo", "hi").agg(
        F.count("*").alias("context_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list("_c")), lambda c: c.cast("string")), ",").alias(
            "context"
        ),
    ).select(
        *keys,
        seg,
        "keyword",
        F.greatest(F.lit(0.0), F.col("lo")).alias("start"),
        F.col("hi").alias("end"),
        "context_count",
        "context",
    )


def tag_speakers(
    segments: DataFrame, turns: DataFrame, keys: Sequence[str], *, seg: str
) -> DataFrame:
    """Speaker of the turn sharing most time with a segment; first turn wins ties.

    *turns* has ``r_start, r_end, turn_speaker``.
    """
    slim = segments.select(*keys, seg, "start", "end")
    pairs = overlap_pairs(slim, turns, keys)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    best = pairs.groupBy(*keys, seg).agg(
        F.max_by("turn_speaker", F.struct(shared, -F.col("r_start"))).alias("turn_speaker")
    )
    return segments.join(best, [*keys, seg], "left").withColumn(
        "turn_speaker", F.coalesce("turn_speaker", F.lit("UNKNOWN"))
    )


# Bars of the vocabulary and quote selection.
MIN_WORD_COUNT = 2
MIN_KEYNESS = 3.0
TOP_WORDS = 3
MIN_WORDS_FOR_TITLE = 25
MIN_QUOTE_GAP = 20.0
QUOTES_PER_CHAPTER = 3
SPEECH_CHANGE_POINTS = 25.0
MIN_KEYNESS_FOR_GAP = 6.0
MIN_COUNT_FOR_GAP = 3
TOP_GAPS = 8
MIN_CLAIM_WORDS = 8
MAX_CLAIMS = 5


def word_counts(lines: DataFrame, keys: Sequence[str], *, text: str = "text") -> DataFrame:
    """Word counts per document (*keys*); counted on the map side before the shuffle."""
    return (
        lines.select(*keys, F.explode(tokens(F.col(text))).alias("word"))
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("count"))
    )


def doc_totals(lines: DataFrame, keys: Sequence[str], *, text: str = "text") -> DataFrame:
    """Words per document, from the text itself: one row a document leaves each task."""
    n = F.sum(F.size(tokens(F.col(text))))
    return lines.groupBy(*keys).agg(n.alias("doc_words")).filter(F.col("doc_words") > 0)


def keyness(counts: DataFrame, totals: DataFrame, group: Sequence[str], doc: str) -> DataFrame:
    """Rate of a word in its document over its smoothed rate in the group's others.

    *totals* is :func:`doc_totals`. Only groups with at least two non-empty documents
    have keyness. A word's total is a window over its documents, so the counts are
    not worked out again.
    """
    x = counts.withColumn("_all", F.sum("count").over(Window.partitionBy(*group, "word"))).join(_whole(totals, group), [*group, doc])
    return x.withColumn("keyness", _ratio()).drop("_all", "_grand")


def _whole(totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """The documents of groups with at least two, each with its group's words (``_grand``)."""
    whole = totals.groupBy(*group).agg(F.sum("doc_words").alias("_grand"), F.count("*").alias("_docs")).filter(F.col("_docs") >= 2).drop("_docs")
    return totals.join(whole, [*group]) if group else totals.crossJoin(F.broadcast(whole))  # one row


def _ratio() -> Column:
    here = F.col("count") / F.col("doc_words")
    there = (F.col("_all") - F.col("count") + 0.5) / (F.col("_grand") - F.col("doc_words") + 0.5)
    return here / there


def distinctive_words(keyed: DataFrame, group: Sequence[str], doc: str, *, digits: int = 1, top: int = TOP_WORDS) -> DataFrame:
    """The top words of each document by rounded ratio, count, then name."""
    times = F.round("keyness", digits)
    w = Window.partitionBy(*group, doc).orderBy(F.desc("times"), F.desc("count"), "word")
    return (
        keyed.filter((F.col("count") >= MIN_WORD_COUNT) & (F.col("keyness") >= MIN_KEYNESS))
        .withColumn("times", times)
        .withColumn("pos", F.row_number().over(w))
        .filter(F.col("pos") <= top)
        .withColumn("share_pct", F.round(F.col("count") * 100.0 / F.col("doc_words"), 6))
        .select(*group, doc, "pos", "word", "count", "times", "share_pct", "doc_words")
    )


def titles(distinctive: DataFrame, group: Sequence[str], doc: str) -> DataFrame:
    """Comma-joined distinctive words of documents with enough words."""
    return (
        distinctive.filter(F.col("doc_words") >= MIN_WORDS_FOR_TITLE)
        .groupBy(*group, doc)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("_w"))
        .select(*group, doc, F.array_join(F.col("_w.word"), ", ").alias("title"))
    )


def lines_in(segments: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every line with each chapter it is audible in (positive shared time)."""
    ch = chapters.select(
        *keys, "number", F.col("start").alias("ch_start"), F.col("end").alias("ch_end")
    )
    return overlap_pairs(segments, ch, keys, right=("ch_start", "ch_end"))


def speech_cover(segments: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seconds of each chapter covered by speech, overlaps counted once.

    The stretches of a chapter are added up in the order of time, so that the last bit of the sum,
    which decides exact ties of what is compared with a bar, is the same in every run.
    """
    from tidemark.operators.islands import interval_islands

    cover = interval_islands(segments.filter("end > start"), keys)
    so_far = Window.partitionBy(*keys, "number").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines_in(cover, chapters, keys).withColumn("_so_far", F.sum(F.least("end", "ch_end") - F.greatest("start", "ch_start")).over(so_far))
    return inside.groupBy(*keys, "number").agg(F.max_by("_so_far", "start").alias("speech_seconds"))


def chapter_speech(segments: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words, pace and share of speech per chapter, and its lift over the video's share."""
    spoken = segments.filter(F.length(F.trim("text")) > 0)
    said = spoken.withColumn("_words", F.size(tokens(F.col("text")))).drop("text")
    words = (
        lines_in(said, chapters, keys)
        .groupBy(*keys, "number")
        .agg(F.sum("_words").alias("words"), F.count("*").alias("segments"))
    )
    cover = speech_cover(said, chapters, keys)
    video = (
        cover.join(chapters.select(*keys, "number", "start", "end"), [*keys, "number"])
        .groupBy(*keys)
        .agg(F.sum("speech_seconds").alias("_spoken"))
    )
    total = chapters.groupBy(*keys).agg(F.max("end").alias("_end"))
    length = F.col("end") - F.col("start")
    share = F.when(length > 0, F.coalesce("speech_seconds", F.lit(0.0)) * 100.0 / length).otherwise(0.0)
    vshare = F.col("_spoken") * 100.0 / F.col("_end")
    return (
        chapters.join(words, [*keys, "number"], "left")
        .join(cover, [*keys, "number"], "left")
        .join(video, list(keys))
        .join(total, list(keys))
        .select(
            *keys,
            "number",
            F.coalesce("segments", F.lit(0)).alias("segments"),
            F.coalesce("words", F.lit(0)).alias("words"),
            F.coalesce("speech_seconds", F.lit(0.0)).alias("speech_seconds"),
            share.alias("speech_share_pct"),
            F.when(length > 0, F.coalesce("words", F.lit(0)) / (length / 60.0)).alias("words_per_minute"),
            (share / vshare).alias("speech_lift"),
        )
    )


def speaker_stats(segments: DataFrame, chapters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns, seconds and words of each named speaker per chapter."""
    named = segments.filter((F.trim("speaker") != "") & (F.upper(F.trim("speaker")) != "UNKNOWN"))
    said = named.withColumn("_words", F.size(tokens(F.col("text")))).drop("text")
    x = lines_in(said, chapters, keys)
    return x.groupBy(*keys, "number", "speaker").agg(
        F.count("*").alias("turns"),
        F.sum(F.least("end", "ch_end") - F.greatest("start", "ch_start")).alias("seconds"),
        F.sum("_words").alias("words"),
    )


def speech_changes(speech: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chapters whose speech share moved at least 25 points from the one before."""
    w = Window.partitionBy(*keys).orderBy("number")
    moved = speech.select(*keys, "number", F.col("speech_share_pct").alias("to_pct")).withColumn(
        "from_pct", F.lag("to_pct").over(w)
    )
    return moved.filter(F.abs(F.col("to_pct") - F.col("from_pct")) >= SPEECH_CHANGE_POINTS).withColumn(
        "direction", F.when(F.col("to_pct") > F.col("from_pct"), "rose").otherwise("fell")
    )


def line_weights(
    lines: DataFrame, totals: DataFrame, group: Sequence[str], doc: str, line: Sequence[str], *, least_count: int = MIN_WORD_COUNT, least: float = MIN_KEYNESS
) -> DataFrame:
    """Per line: summed positive log keyness over the root of its length, and over distinct words.

    A line is told by *group*, *doc* and *line*; *totals* is :func:`doc_totals`. ``marked`` are the
    words (``word, count, keyness, doc_words``) of a document with *least_count* and a keyness of
    *least*, each at one line that has it, so that :func:`marked_words` has all rows of
    :func:`keyness` that :func:`distinctive_words` looks at by default.

    The totals are put beside the lines; a line's words then travel once, by group and word,
    where counts, keyness and marks are worked out, and only sums go on.
    """
    ident = [*group, doc, *line]
    beside = lines.select(*ident, "text").join(_whole(totals, group), [*group, doc], "left").withColumn("_s", F.sort_array(tokens(F.col("text"))))
    # places where a word begins in the sorted list: a row per word of a line, not per token
    begins = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    runs = F.transform("_at", lambda i, n: F.struct(F.get("_s", i).alias("word"), (F.coalesce(F.get("_at", n + 1), F.size("_s")) - i).alias("n")))
    words = beside.filter(F.size("_s") > 0).withColumn("_at", begins).withColumn("_w", F.explode(runs))
    sizes = ["doc_words", "_grand"]
    dealt = words.select(*ident, *sizes, F.col("_w.word").alias("word"), F.col("_w.n").alias("_n")).repartition(*group, "word")
    counted = dealt.groupBy(*ident, *sizes, "word").agg(F.sum("_n").alias("_k"))
    whole = Window.unboundedPreceding, Window.unboundedFollowing
    per = Window.partitionBy(*group, "word")
    mine = Window.partitionBy(*group, "word", doc)
    # sorted once, the longest order first
    x = counted.withColumn("_first", F.row_number().over(mine.orderBy(*line))).withColumn("count", F.sum("_k").over(mine))
    x = x.withColumn("_all", F.sum("_k").over(per.orderBy(doc).rangeBetween(*whole))).withColumn("keyness", _ratio())
    gain = F.coalesce(F.greatest(F.lit(0.0), F.log(F.greatest("keyness", F.lit(1e-9)))), F.lit(0.0))
    mark = (F.col("_first") == 1) & (F.col("count") >= least_count) & (F.col("keyness") >= least)
    return (
        x.withColumn("_g", gain)
        .groupBy(*ident)
        .agg(
            (F.sum(F.col("_g") * F.col("_k")) / F.sqrt(F.sum("_k"))).alias("weight"),
            F.sum("_g").alias("distinct_weight"),
            F.sum("_k").alias("words"),
            F.collect_list(F.when(mark, F.struct("word", "count", "keyness", "doc_words"))).alias("marked"),
        )
    )


def marked_words(weighted: DataFrame, group: Sequence[str], doc: str) -> DataFrame:
    """The marked words of :func:`line_weights`, a row per document and word as of :func:`keyness`."""
    return weighted.select(*group, doc, F.explode("marked").alias("_m")).select(*group, doc, "_m.*")


def spaced_quotes(
    weighted: DataFrame, keys: Sequence[str], *, min_gap: float = MIN_QUOTE_GAP, limit: int = QUOTES_PER_CHAPTER
) -> DataFrame:
    """Heaviest lines of each chapter, earlier first on ties, at least *min_gap* apart."""
    from tidemark.operators.choose import spaced_picks

    return spaced_picks(
        weighted,
        keys,
        t="start",
        rank=[-F.round("weight", 9), F.col("start"), F.col("seg")],
        gap=min_gap,
        limit=limit,
        carry=["seg", "weight"],
    )


def name_tokens(name: str) -> list[str]:
    """The words inside a class name written in snake, kebab or spaced form."""
    import re

    return sorted(set(re.findall(r"[^\W\d_]{2,}", name.replace("_", " ").replace("-", " ").lower())))


def vocabulary_gaps(distinctive: DataFrame, group: Sequence[str], classes: Sequence[str], doc: str) -> DataFrame:
    """Distinctive words that are no token of any class name, best eight a group."""
    covered = sorted({t for c in classes for t in name_tokens(c)})
    ok = distinctive.filter(
        ~F.col("word").isin(*covered)
        & (F.col("times") >= MIN_KEYNESS_FOR_GAP)
        & (F.col("count") >= MIN_COUNT_FOR_GAP)
    )
    rows = ok.groupBy(*group, "word").agg(
        F.sum("count").alias("count"), F.max("times").alias("times"), F.count("*").alias("chapters")
    )
    w = Window.partitionBy(*group).orderBy(F.desc("times"), F.desc("count"), "word")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= TOP_GAPS)


def _name_table(classes: Sequence[str]):
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("name"), F.array(*[F.lit(t) for t in name_tokens(c)]).alias("tokens")
            )
            for c in classes
        ]
    )


def name_mentions(lines: DataFrame, keys: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """First line of each chapter that holds all tokens of a multi-word class name.

    The class list is a rule-sized literal, tested inside the row.
    """
    multi = [c for c in classes if len(name_tokens(c)) > 1]
    words = F.array_distinct(tokens(F.col("text")))
    hit = F.filter(_name_table(multi), lambda n: F.size(F.array_except(n["tokens"], words)) == 0)
    found = lines.select(*keys, "seg", "start", F.explode(F.transform(hit, lambda n: n["name"])).alias("name"))
    return found.groupBy(*keys, "name").agg(
        F.min_by("seg", F.struct("start", "seg")).alias("seg"), F.min("start").alias("said_at")
    )


def word_mentions(
    distinctive: DataFrame, named: DataFrame, keys: Sequence[str], classes: Sequence[str]
) -> DataFrame:
    """Distinctive words that are a token of class names not already named in full."""
    table = [(t, c) for c in classes for t in name_tokens(c)]
    covering = F.transform(
        F.filter(
            F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("c")) for t, c in table]),
            lambda p: p["t"] == F.col("word"),
        ),
        lambda p: p["c"],
    )
    x = distinctive.select(*keys, "word", "count", "times", F.explode(covering).alias("name"))
    return (
        x.join(named.select(*keys, "name"), [*keys, "name"], "left_anti")
        .groupBy(*keys, "word", "count", "times")
        .agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("classes"))
    )


def unmeasured_claims(
    quotes: DataFrame, group: Sequence[str], chapter: str, classes: Sequence[str], *, limit: int = MAX_CLAIMS
) -> DataFrame:
    """Quoted lines of 8+ words sharing no word with any class, best of each chapter, top five.

    *quotes* has ``text, start, words, distinct_weight``.
    """
    covered = F.array(*[F.lit(t) for t in sorted({t for c in classes for t in name_tokens(c)})])
    ok = quotes.filter(
        (F.col("words") >= MIN_CLAIM_WORDS) & ~F.arrays_overlap(tokens(F.col("text")), covered)
    ).withColumn("score", F.round("distinct_weight", 6))
    per = Window.partitionBy(*group, chapter).orderBy(F.desc("score"), "start", "seg")
    best = ok.withColumn("_p", F.row_number().over(per)).filter("_p = 1")
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "start", "seg")
    return best.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit).drop("_p")


def first_of_duplicates(lines: DataFrame, keys: Sequence[str], *, text: str, order: str) -> DataFrame:
    """First line of each distinct trimmed, lower-cased text.

    Grouping is by a digest of the text with a map-side minimum, so neither a hot
    text nor its copies travel.
    """
    norm = F.sha2(F.lower(F.trim(text)), 256)
    first = lines.groupBy(*keys, norm.alias("_k")).agg(F.min(order).alias(order))
    return lines.join(first.drop("_k"), [*keys, order], "left_semi")


def join_up(segments: DataFrame, keys: Sequence[str], *, gap: float = 0.5, longest: float = 6.0, short: float = 3.0) -> DataFrame:
    """Short neighbouring lines merged while the pause is small and no sentence ends.

    Whether a line joins depends on what was merged so far, so it is a fold. The
    fold runs per stretch of lines with pauses under *gap*: a larger pause always
    starts a new line, which bounds the stretch and keeps a long transcript out of
    one fold.
    """
    ran = run_ids(
        segments,
        keys,
        ["start", "seg"],
        F.struct(F.col("end").alias("e")),
        lambda p: (F.col("start") - p["e"] >= gap) | (F.col("end") - F.col("start") >= short),
        "_run",
        "start",
    )
    row = F.struct("start", "seg", "end", "text")
    packed = ran.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(row)).alias("_s"))
    piece = "array<struct<start: double, end: double, text: string>>"

    def step(done, s):
        last = F.element_at(done, -1)
        fits = (
            (F.size(done) > 0)
            & (s["start"] - last["end"] < gap)
            & (s["end"] - last["start"] <= longest)
            & (last["end"] - last["start"] < short)
            & (s["end"] - s["start"] < short)
            & ~F.trim(last["text"]).rlike(r"[.!?]$")
        )
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))
        joined = F.struct(
            last["start"].alias("start"),
            s["end"].alias("end"),
            F.concat(last["text"], F.lit(" "), s["text"]).alias("text"),
        )
        return F.when(
            F.coalesce(fits, F.lit(False)),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(own)))

    folded = packed.select(*keys, F.explode(F.aggregate("_s", F.array().cast(piece), step)).alias("_m"))
    return folded.select(*keys, "_m.*")


def pause_marks(segments: DataFrame, keys: Sequence[str], *, pause: float = 2.0, every: float = 30.0, digits: int = 1) -> DataFrame:
    """Pause before each line (when long enough) and whether a time stamp is shown.

    A stamp is shown on the first line, after a pause, and when more than *every*
    seconds passed since the last one shown.
    """
    from tidemark.operators.axis import neighbour

    seen = neighbour(segments, keys, ["start", "seg"], F.struct(F.col("end").alias("e")), "_p", "start")
    gap = F.col("start") - F.col("_p.e")
    marked = seen.select(
        *keys,
        "seg",
        "start",
        F.when(gap >= pause, F.round(gap, digits)).alias("pause"),
        (F.col("_p").isNull() | (gap >= pause)).alias("_forced"),
    )
    # between forced stamps the rule is a fold over the stretch's line starts
    ran = run_ids(marked, keys, ["start", "seg"], F.struct(F.lit(1).alias("x")), lambda p: F.col("_forced"), "_run", "start")
    packed = ran.groupBy(*keys, "_run").agg(
        F.array_sort(F.collect_list(F.struct("start", "seg", "pause"))).alias("_s")
    )
    out = "array<struct<seg: bigint, start: double, pause: double, stamp: boolean>>"
    state = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast(out).alias("rows"))

    def step(s, x):
        show = s["last"].isNull() | (x["start"] - s["last"] > every)
        row = F.struct(
            x["seg"].cast("bigint").alias("seg"), x["start"].alias("start"), x["pause"].alias("pause"), show.alias("stamp")
        )
        return F.struct(
            F.when(show, x["start"]).otherwise(s["last"]).alias("last"),
            F.concat(s["rows"], F.array(row)).alias("rows"),
        )

    folded = packed.select(*keys, F.explode(F.aggregate("_s", state, step, lambda s: s["rows"])).alias("_m"))
    return folded.select(*keys, "_m.*")


def rebase_chunks(segments: DataFrame, *, chunk: str = "chunk", length: float = 600.0, spoken: bool = True) -> DataFrame:
    """Chunk-relative lines on the whole video's clock; lines under three characters dropped.

    *spoken* drops interjections and repeated words, too. Spaces of every kind at the ends do not count.
    """
    from tidemark.operators.filters import valid_speech

    shift = F.col(chunk) * length
    long = F.length(F.regexp_replace("text", r"^\p{Zs}+|\p{Zs}+$", "")) >= 3
    return (
        segments.filter(long & valid_speech(F.col("text")) if spoken else long)
        .withColumn("start", F.col("start") + shift)
        .withColumn("end", F.col("end") + shift)
    )


def subtitle_cues(
    segments: DataFrame,
    keys: Sequence[str],
    *,
    limit: int = 80,
    min_duration: float = 0.8,
    chars_per_second: float = 15.0,
) -> DataFrame:
    """Numbered subtitle cues: cleaned, split, timed by reading speed.

    A line's chunks share the time it needs to be read, never less than its own
    duration and never past the next line's start less 0.1 s.
    """
    from tidemark.functions.text import bind, clean_subtitle, split_subtitle
    from tidemark.operators.axis import neighbour, prefix_sum
    from tidemark.operators.filters import valid_speech

    seen = neighbour(segments, keys, ["start", "seg"], F.col("start"), "_next", "start", step=1)
    clean = seen.select(
        *keys, "seg", "start", "end", "_next", F.inline(F.array(F.struct(clean_subtitle(F.col("text")).alias("text"))))
    ).filter((F.length("text") >= 2) & valid_speech(F.col("text")))

    def timed(chunks):
        need = F.transform(
            chunks, lambda c: F.greatest(F.lit(min_duration), F.length(c) / F.lit(chars_per_second))
        )
        return F.struct(chunks.alias("chunks"), need.alias("need"))

    x = clean.select(
        *keys, "seg", "start", "end", "_next", F.inline(F.array(bind(split_subtitle(F.col("text"), limit), timed)))
    )
    total = F.aggregate("need", F.lit(0.0), lambda a, n: a + n)
    own = F.col("end") - F.col("start")
    room = F.when(
        F.col("_next").isNotNull(), F.greatest(own, F.least(total, F.col("_next") - F.col("start") - 0.1))
    ).otherwise(F.greatest(own, total))
    y = (
        x.withColumn("_n", F.size("chunks"))
        .withColumn("_scale", room / total)
    )
    y = prefix_sum(y, keys, ["start", "seg"], "_n", "_upto", "start")
    parts = y.select("*", F.posexplode("chunks").alias("_i", "text"))
    before = F.aggregate(F.slice("need", F.lit(1), F.col("_i")), F.lit(0.0), lambda a, n: a + n)
    at = F.col("start") + before * F.col("_scale")
    return parts.select(
        *keys,
        (F.col("_upto") - F.col("_n") + F.col("_i") + 1).cast("long").alias("cue"),
        at.alias("start"),
        (at + F.element_at("need", F.col("_i") + 1) * F.col("_scale")).alias("end"),
        "text",
    )


def retime_to_clips(segments: DataFrame, clips: DataFrame, keys: Sequence[str], *, min_overlap: float = 0.5) -> DataFrame:
    """Lines cut to the kept clips and moved onto the output clock."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = clips.select(
        *keys,
        F.col("start").alias("r_start"),
        F.col("end").alias("r_end"),
        F.coalesce(F.sum(F.col("end") - F.col("start")).over(w), F.lit(0.0)).alias("_off"),
    )
    pairs = overlap_pairs(segments, placed, keys)
    lo, hi = F.greatest("start", "r_start"), F.least("end", "r_end")
    return pairs.filter(hi - lo > min_overlap).select(
        *keys,
        "seg",
        (F.col("_off") + lo - F.col("r_start")).alias("start"),
        (F.col("_off") + hi - F.col("r_start")).alias("end"),
        "text",
    )


def _first_repetition(sentences: Iterable[list[str]], min_words: int, percent: int) -> int | None:
    """Position of the first sentence (its distinct words) that repeats an earlier one; see :func:`first_repetitions`."""
    seen: set[frozenset] = set()
    kept: list[frozenset] = []
    anywhere: dict[str, list[int]] = defaultdict(list)
    ahead: dict[str, list[int]] = defaultdict(list)
    for pos, listed in enumerate(sentences):
        words = frozenset(listed)
        n = len(words)
        if words in seen and n >= min_words:
            return pos
        if not words or words in seen:
            continue
        first = sorted(words, key=lambda w: (-len(w), w))[: n + (-n * percent // 100) + 1]
        if n >= min_words:
            near = chain.from_iterable([anywhere.get(w, ()) for w in first] + [ahead.get(w, ()) for w in words])
            if any(len(words & kept[k]) * 100 >= percent * min(n, len(kept[k])) for k in set(near)):
                return pos
        for w in words:
            anywhere[w].append(len(kept))
        for w in first:
            ahead[w].append(len(kept))
        seen.add(words)
        kept.append(words)
    return None


def first_repetitions(docs: DataFrame, keys: Sequence[str], *, text: str = "text", min_words: int = 8, overlap_percent: int = 80) -> DataFrame:
    """(*keys*, ``cut_at``): the first sentence of each document that repeats an earlier one.

    A sentence of *min_words* distinct words or more repeats when the words that it shares
    with an earlier sentence reach the share *overlap_percent* of the smaller of the two.
    Sentences count from 0, those without words included; documents without a repetition have
    no row. *keys* are unique and not null.

    A document is one row and is read up to its first repetition, without a shuffle. A
    containment join by prefixes: a sentence of n distinct words that is the smaller one
    shares ceil(share * n) of them, so with all words in one order one of its first
    n - ceil(share * n) + 1 is in the other. Long words, which are the rarer ones, come first.
    """
    from tidemark.functions.text import sentences, tokens

    said = docs.select(*keys, F.transform(sentences(F.col(text)), lambda s: F.array_distinct(tokens(s))).alias("said"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_first_repetition(said.as_py() or [], min_words, overlap_percent) for said in batch.column(len(keys))]
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.int32())], [*keys, "cut_at"])
            yield out.filter(out.column(len(keys)).is_valid())

    return said.mapInArrow(cut, f"{kinds}, cut_at int")
