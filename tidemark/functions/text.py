"""Text helpers: all of them build native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword of the list found in lower-cased *text*, else NULL."""
    low = F.lower(text)
    clean = [k.strip().lower() for k in keywords if k.strip()]
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in clean], F.lit(None))


def any_keyword(text: Column, keywords: Sequence[str]) -> Column:
    low = F.lower(text)
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    return F.exists(words, lambda k: F.contains(low, k))


def tokens(text: Column) -> Column:
    """Runs of at least two letters, lower-cased; no stop list."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), F.lit(0))


def bind(x: Column, fn) -> Column:
    """Evaluate *x* once and hand it to *fn*, as a local name would."""
    return F.transform(F.array(x), fn)[0]


def _glue(a: Column, b: Column) -> Column:
    return F.trim(F.concat(a, F.lit(" "), b))


def _pack(pieces: Column, fits) -> Column:
    """Greedy fill: append a piece to the current line while ``fits(line, piece)``."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, piece: Column) -> Column:
        closed = F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"])
        return (
            F.when(
                fits(s["cur"], piece),
                F.struct(s["done"].alias("done"), _glue(s["cur"], piece).alias("cur")),
            )
            .otherwise(F.struct(closed.alias("done"), piece.alias("cur")))
        )

    return F.aggregate(
        pieces,
        state,
        step,
        lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]),
    )


def _spaced(text: Column) -> Column:
    """Single spaces: one after a stop before a letter and after a comma, none before a stop."""
    apart = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"([.!?])(\p{L})", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(apart, r",(\S)", ", $1"), r" +(?=[ .!?])", ""))


def _sentences(text: Column) -> Column:
    """Pieces that end after a run of stops; a piece of stops alone says nothing and goes."""
    pieces = F.transform(F.split(text, r"(?<=[.!?])(?![.!?])"), lambda piece: F.trim(piece))
    return F.filter(pieces, lambda piece: piece.rlike("[^.!?]"))


def _stretches(text: Column) -> Column:
    """Pieces that end after a run of stops, without white space around them or before their stops.

    Line breaks between pieces go with that white space; a piece of stops alone stays.
    """
    pieces = F.transform(F.split(text, r"(?<=[.!?])(?![.!?])"), lambda piece: F.regexp_replace(piece, r"^\s+|\s+$|\s+(?=[.!?]+$)", ""))
    return F.filter(pieces, lambda piece: piece != "")


def clean_subtitle(text: Column, width: int = 50) -> Column:
    """Spacing and capital put right, wrapped at sentence ends near *width*.

    Dashes around the text go, and of several stops after a sentence the first stays.
    """
    t = F.trim(F.regexp_replace(_spaced(text), r"(?<=[.!?])[.!?]+", ""), F.lit("- "))
    capital = F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))
    lines = _pack(_sentences(capital), lambda line, piece: F.length(line) + F.length(piece) + 1 <= width)
    return F.array_join(lines, "\n")


def split_subtitle(text: Column, limit: int = 80) -> Column:
    """Chunks of at most about *limit* characters: by sentence, then by halves, then by words."""
    joined = lambda line, piece: F.length(_glue(line, piece)) <= limit

    def of_words(words: Column) -> Column:
        """Two halves by number of words; words packed one by one where a half is too long or a stub."""
        middle = F.floor(F.size(words) / 2).cast("int")
        halves = F.array(F.array_join(F.slice(words, F.lit(1), middle), " "), F.array_join(F.slice(words, middle + 1, F.size(words)), " "))
        even = bind(halves, lambda h: (F.length(h[0]) <= limit) & (F.length(h[1]) >= F.length(h[0]) * 0.3))
        return F.when(even, halves).otherwise(_pack(words, joined))

    def shortened(chunk: Column) -> Column:
        words = F.filter(F.split(chunk, r"\s+"), lambda w: w != "")
        return F.when(F.length(chunk) <= limit, F.array(chunk)).otherwise(bind(words, of_words))

    chunks = _pack(_stretches(text), joined)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(F.flatten(F.transform(chunks, shortened)))


def trim_quote(text: Column, limit: int = 180) -> Column:
    """Whitespace folded; past *limit* cut at a word and marked with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(t, 1, limit)
    cut = F.regexp_replace(head, r" [^ ]*$", "")
    body = F.regexp_replace(F.when(cut != "", cut).otherwise(head), r"[,;:\-]+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(body, F.lit("…")))


def pace(shots: Column, seconds: Column) -> Column:
    """Name of the cutting rate."""
    per = seconds / shots
    return (
        F.when((shots <= 0) | (seconds <= 0), "unmeasured")
        .when(per < 4.0, "fast-cut")
        .when(per < 15.0, "steady")
        .otherwise("held")
    )


# The group of each known action, in matching order.
ACTION_GROUPS = {
    "movement": ("walking", "running", "jumping", "entering", "exiting", "approaching", "leaving"),
    "interaction": ("talking", "speaking", "pointing", "waving", "handshaking", "hugging", "kissing"),
    "combat": ("punching", "kicking", "fighting", "blocking", "shooting"),
    "manipulation": ("picking up", "putting down", "holding", "carrying", "throwing", "catching", "opening", "closing"),
    "sports": ("dribbling", "kicking ball", "throwing ball", "catching ball", "hitting", "swinging"),
    "stationary": ("standing", "sitting", "lying", "waiting", "looking"),
}


def action_group(name: Column) -> Column:
    """Exact name first, then the first known action that contains or is contained."""
    low = F.lower(name)
    known = [(action, group) for group, actions in ACTION_GROUPS.items() for action in actions]
    exact = F.create_map(*[F.lit(x) for pair in known for x in pair])[low]
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(g).alias("g")) for a, g in known])
    partial = F.filter(table, lambda k: F.contains(low, k["a"]) | F.contains(k["a"], low))
    return F.coalesce(exact, F.get(partial, F.lit(0))["g"], F.lit("other"))


def collapse_runs(items: Column) -> Column:
    """``a ×3, b ×2`` for consecutive equal items."""
    state = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("cur"),
        F.lit(0).alias("n"),
    )

    def shown(s: Column) -> Column:
        return F.concat(s["cur"], F.lit(" ×"), s["n"].cast("string"))

    def step(s: Column, x: Column) -> Column:
        return F.when(
            s["cur"] == x, F.struct(s["done"].alias("done"), s["cur"].alias("cur"), (s["n"] + 1).alias("n"))
        ).otherwise(
            F.struct(
                F.when(s["cur"].isNull(), s["done"])
                .otherwise(F.concat(s["done"], F.array(shown(s))))
                .alias("done"),
                x.alias("cur"),
                F.lit(1).alias("n"),
            )
        )

    return F.aggregate(
        items,
        state,
        step,
        lambda s: F.when(s["cur"].isNull(), F.lit("")).otherwise(
            F.array_join(F.concat(s["done"], F.array(shown(s))), ", ")
        ),
    )


def repetition_at(text: Column, *, min_words: int = 8, overlap: float = 0.8) -> Column:
    """Zero-based index of the first sentence repeating an earlier one, NULL if none.

    A sentence of at least *min_words* distinct words repeats when the words it
    shares with an earlier sentence reach *overlap* of the smaller of the two.
    The search stops at the first hit.
    """
    sets = F.transform(sentences(text), lambda s: F.array_distinct(tokens(s)))

    def search(ws: Column) -> Column:
        def step(hit: Column, i: Column) -> Column:
            w = F.element_at(ws, i + 1)
            same = F.exists(
                F.slice(ws, F.lit(1), i),
                lambda e: (F.size(e) > 0)
                & (F.size(F.array_intersect(w, e)) / F.least(F.size(w), F.size(e)) >= overlap),
            )
            return F.when(hit >= 0, hit).when((F.size(w) >= min_words) & same, i).otherwise(F.lit(-1))

        spots = F.when(F.size(ws) > 1, F.sequence(F.lit(1), F.size(ws) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.nullif(F.aggregate(spots, F.lit(-1), step), F.lit(-1))

    return bind(sets, search)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``?``, ``!`` or ``;`` followed by a space."""
    return F.split(text, r"(?<=[.?!;]) ")


def cut_repetition(text: Column) -> Column:
    """The text up to where it starts to repeat itself; untouched if it never does."""
    at = repetition_at(text)
    kept = F.array_join(F.transform(F.slice(sentences(text), F.lit(1), at), lambda s: F.trim(s)), " ")
    return F.when(at.isNull(), F.trim(text)).otherwise(F.trim(kept))
