"""Personal data by bootstrapped contextual extraction, in native expressions only.

Base patterns find well-formed e-mail addresses, IPv4 addresses, card and phone numbers.
They are the seeds. Loose patterns find strings of the same kinds in forms that the base
patterns miss (written-out "(at)", IPv6, short or oddly grouped numbers): the candidates.
The words next to seeds and candidates are lexical patterns (one or two words before, one or
two after), and patterns and values make a bipartite graph, which Spark scores in rounds:

* A pattern is trusted by how often it stands next to known values among all its occurrences
  in all documents (unknown candidates of the kind count neither way), times support / (support + 1), support being the known values it is seen
  with, each counted once however often its document is copied.
* A value is trusted by its best pattern before it and its best pattern after it, taken as
  independent; seeds by 1. A candidate with the value of a seed is the seed in another form.
* Values above the bar are known, with their trust as weight, in the next round.

The candidates whose values are known in the end are added to the base spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import bind
from tidemark.llm.shared import salted, written

# Kinds in the order of results, and their base forms. Quantifiers are possessive
# and starts inside a run are ruled out only where that cannot change a match, so that texts
# of any length are read in one pass.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"""(?<![^\s@<>()\[\]{},;:"])[^\s@<>()\[\]{},;:"]++\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?[^\s@<>()\[\]{},;:"]++""",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{0,4}:){2,7}+[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}){3}+)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+])[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}+(?![0-9])",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
#: Characters kept on each side of a match, and the longest word of a pattern.
SIDE, WORD = 80, 30
HIT = "array<struct<kind: int, base: boolean, start: bigint, end: bigint, value: string, left: string, right: string>>"
BLOCK = 256
#: Known values that a pattern needs.
SUPPORT = 3


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test; false for an empty one."""

    def step(total: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.when(F.length(d) > 0, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0).otherwise(False)


def _valid(kind: str, base: bool, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(16 if base else 12, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8 if base else 7, 15)
    if kind == "ip":
        return (F.lit(False) if base else F.contains(m, F.lit(":"))) | F.regexp_replace(m, r"[\[\]()\x20]", "").rlike(OCTETS)
    return F.lit(True)


def _normal(kind: str, m: Column) -> Column:
    """One spelling of a value, the same for its base and its loose forms."""
    if kind in ("card", "phone"):
        return digits(m)
    if kind == "email":
        return F.lower(F.rtrim(F.regexp_replace(m, r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?", "@"), F.lit(".")))
    return F.lower(F.regexp_replace(m, r"[\[\]()\x20]", ""))


def _places(lengths: Column, picked: Column, place: Callable[[Column, Column], Column]) -> Column:
    """place(item, sum of all lengths before item's) per item of *picked*, in time linear in both.

    Sums are kept for each 256th place and go on from there.
    """
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, BLOCK), F.lit(0).cast("long"), lambda a, x: a + x))
    running = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def one(sums: Column) -> Column:
        def before(item: Column) -> Column:
            b = F.floor(item["at"] / BLOCK).cast("int")
            return F.get(sums, b) + F.aggregate(F.slice(lengths, b * BLOCK + 1, item["at"] % BLOCK), F.lit(0).cast("long"), lambda a, x: a + x)

        return F.transform(picked, lambda item: place(item, before(item)))

    return F.when(F.size(picked) > 0, bind(running, one))


def _matches(text: Column, kind: str, base: bool) -> Column:
    """Valid matches of one pattern with places in code points and the text on both sides."""
    pattern = (BASE if base else LOOSE)[kind]
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(z: Column) -> Column:
        lengths = F.transform(z["found"], lambda m, k: (F.length(F.get(z["gaps"], k)) + F.length(m)).cast("long"))
        picked = F.filter(F.transform(z["found"], lambda m, k: F.struct(k.alias("at"), m.alias("m"))), lambda c: _valid(kind, base, c["m"]))

        def hit(c: Column, before: Column) -> Column:
            start = before + F.length(F.get(z["gaps"], c["at"]))
            left, right = F.get(z["gaps"], c["at"]), F.get(z["gaps"], c["at"] + 1)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"),
                F.lit(base).alias("base"),
                start.alias("start"),
                (start + F.length(c["m"])).alias("end"),
                _normal(kind, c["m"]).alias("value"),
                F.lower(F.substring(left, -SIDE, SIDE)).alias("left"),
                F.lower(F.substring(right, 1, SIDE)).alias("right"),
            )

        return bind(F.struct(lengths.alias("lengths"), picked.alias("picked")), lambda y: _places(y["lengths"], y["picked"], hit))

    return F.when(possible(text, kind, base), bind(cut, placed)).cast(HIT)


def possible(text: Column, kind: str, base: bool) -> Column:
    """A cheap condition that every text with a match meets."""
    if kind == "email":
        at = F.contains(text, F.lit("@"))
        return at if base else at | F.contains(text, F.lit("at)")) | F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at}"))
    if kind == "phone" and base:
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]" if base else r":[0-9A-Fa-f]{0,4}:|[0-9]\x20?[.\[(]")
    return text.rlike("[0-9][^A-Za-z]{4}")


def hits(text: Column) -> Column:
    """All valid base and loose matches of a text."""
    empty = F.array().cast(HIT)
    return F.concat(*(F.coalesce(_matches(text, kind, base), empty) for base in (True, False) for kind in KINDS))


def span_text(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _contexts(left: Column, right: Column) -> Column:
    """The patterns of a match: (side, words), words in lower case without digits."""
    word = rf"([^\s0-9]{{1,{WORD}}})"
    two_before, one_before = F.regexp_extract(left, rf"(?:^|\s){word}\s+{word}\s*$", 0), F.regexp_extract(left, rf"(?:^|\s){word}\s*$", 1)
    two_after, one_after = F.regexp_extract(right, rf"^\s*{word}\s+{word}(?:\s|$)", 0), F.regexp_extract(right, rf"^\s*{word}(?:\s|$)", 1)
    tidy = lambda c: F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), "^ ", "")
    sides = [("before", two_before), ("before", one_before), ("after", two_after), ("after", one_after)]
    every = F.array(*(F.struct(F.lit(s).alias("side"), tidy(c).alias("words")) for s, c in sides))
    return F.filter(every, lambda p: p["words"].rlike(r"\p{L}"))


def _wide(edges: DataFrame, support: int) -> DataFrame:
    """The patterns (kind, side, words) seen with *support* values or more."""
    return edges.groupBy("kind", "side", "words").agg(F.count(F.lit(1)).alias("values")).filter(F.col("values") >= support)


def word_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(words, total): how often each word and each pair of neighbouring words occurs in all texts, digits left out.

    Counted are the rows of *wanted* (words), and a few others: those that share a bit with
    one of them in a map of 2^26 bits, of which the places in use are broadcast, 2^20
    numbers at most. Nothing else of the texts is shuffled.
    """
    place = F.pmod(F.xxhash64("words"), F.lit(1 << 26))
    cell, bit = F.shiftright(place, 6).alias("_cell"), F.pmod(place, F.lit(64)).cast("int")
    bits = F.expr("shiftleft(1L, _bit)")
    cells = written(wanted.select(cell, bit.alias("_bit")).select("_cell", bits.alias("_one")).groupBy("_cell").agg(F.bit_or("_one").alias("_set")))
    rows = texts.select(F.split(F.lower("text"), r"\s+").alias("w"))
    lexical = lambda c: c.rlike(rf"^[^0-9]{{1,{WORD}}}$")
    pair = lambda c, k: F.when(lexical(F.get("w", k + 1)), F.concat_ws(" ", c, F.get("w", k + 1)))
    grams = F.flatten(F.transform("w", lambda c, k: F.when(lexical(c), F.array(c, pair(c, k))).otherwise(F.array().cast("array<string>"))))
    every = rows.select(F.explode(grams).alias("words")).filter("words is not null").select("words", cell, bit.alias("_bit"))
    near = every.join(F.broadcast(cells), "_cell").filter(F.getbit("_set", F.col("_bit")) == 1)
    return near.groupBy("words").agg(F.count(F.lit(1)).alias("total"))


def trusted_values(edges: DataFrame, totals: DataFrame, rounds: int = 3, support: int = SUPPORT, pattern_bar: float = 0.6, value_bar: float = 0.75) -> DataFrame:
    """(kind, value, trust) of the known values after *rounds* rounds over the graph.

    *edges* are (kind, side, words, value, n, seed), one row per pattern and value;
    *totals* are (words, total). Patterns seen with fewer than *support* values in all can
    never have that many known ones and are left out first; that changes no result.
    """
    seeds = edges.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    known = written(seeds.filter("seed").select("kind", "value", F.lit(1.0).alias("trust")))
    graph = salted(edges, _wide(edges, support).join(totals, "words", "left"), ["kind", "side", "words"], "value")
    graph = written(graph.select("kind", "side", "words", "value", "n", F.coalesce("total", F.lit(0)).alias("total")))
    for _ in range(rounds):
        trust = F.coalesce("trust", F.lit(0.0))
        sums = salted(graph, known, ["kind", "value"], "words", how="left").groupBy("kind", "side", "words").agg(
            F.sum(F.col("n") * trust).alias("pos"), F.sum(F.col("n") * (1 - trust)).alias("open"), F.sum(trust).alias("support"), F.max("total").alias("total")
        )
        other = F.greatest(F.col("total") - F.col("pos") - F.col("open"), F.lit(0.0))
        score = F.col("pos") / (F.col("pos") + other) * F.col("support") / (F.col("support") + 1)
        patterns = sums.filter(F.col("support") >= support).select("kind", "side", "words", score.alias("score")).filter(F.col("score") >= pattern_bar)
        best = salted(graph, patterns, ["kind", "side", "words"], "value").groupBy("kind", "value").agg(
            F.max(F.when(F.col("side") == "before", F.col("score"))).alias("b"), F.max(F.when(F.col("side") == "after", F.col("score"))).alias("a")
        )
        learned = best.select("kind", "value", (1 - (1 - F.coalesce("a", F.lit(0.0))) * (1 - F.coalesce("b", F.lit(0.0)))).alias("trust"))
        learned = learned.filter(F.col("trust") >= value_bar)
        first = known.filter("trust = 1.0")  # a learned value stays below 1
        known = written(first.unionByName(learned.join(first, ["kind", "value"], "left_anti")))
    return known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """*id_col*, base and added: arrays of (kind, start, end) for every row.

    ``kind`` counts the listed kinds from 0; places are in code points, the end excluded.
    Base spans are the leftmost valid matches of each kind and may overlap across kinds; an
    added span overlaps no base span. Null texts are empty and have none. Repeated rows have
    the same spans each, a null id is an id like any other, other columns are not read, so
    their names cannot clash; an empty table gives none. *options* go to
    :func:`trusted_values`.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = written(texts.select("id", hits(F.col("text")).alias("hits")).withColumn("row", F.monotonically_increasing_id()))
    each = found.filter(F.size("hits") > 0).select("row", F.inline("hits"))
    by_start = Window.partitionBy("row").orderBy("start", "end", "base", "kind")
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("base"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))
    clear = F.coalesce(earlier <= F.col("start"), F.lit(True)) & F.coalesce(later >= F.col("end"), F.lit(True))
    spans = written(each.withColumn("clear", F.col("base") | clear).filter("clear").drop("clear"))
    edges = spans.select("kind", "base", "value", F.inline(_contexts(F.col("left"), F.col("right"))))
    seeds = spans.groupBy("kind", "value").agg(F.max("base").alias("seed"))
    edges = edges.groupBy("kind", "side", "words", "value").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("own"))
    edges = written(salted(edges, seeds, ["kind", "value"], "words").drop("own"))
    patterns = _wide(edges, options.get("support", SUPPORT)).select("words").distinct()
    known = trusted_values(edges, word_counts(texts, patterns), **options)
    known = known.unionByName(seeds.filter("seed").select("kind", "value", F.lit(1.0).alias("trust"))).groupBy("kind", "value").agg(F.max("trust").alias("trust"))
    picked = salted(spans.filter(~F.col("base")), known, ["kind", "value"], "row")
    span = F.struct("kind", "start", "end")
    added = picked.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("added"))
    base = F.transform(F.filter("hits", lambda h: h["base"]), lambda h: F.struct(h["kind"].alias("kind"), h["start"].alias("start"), h["end"].alias("end")))
    out = found.select("row", "id", base.alias("base")).join(added, "row", "left")
    return out.select(F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")).alias("added"))
