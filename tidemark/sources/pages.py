"""Links, titles and durations out of raw listing pages.

Everything is one projection over the page text plus an aggregation by link.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import bind

# Titles that say nothing, lazy-load attributes in order of trust,
# placeholder images, path pieces of item pages, and path pieces of navigation.
JUNK_TITLES = ("thumb", "thumbnail", "play", "watch", "video")
IMAGE_ATTRIBUTES = (
    "data-src", "data-original", "data-thumb", "data-lazy", "data-lazy-src", "data-srcset", "srcset", "src",
)
PLACEHOLDERS = ("1px", "blank", "spacer", "placeholder", "loading", "lazy.")
LINK_CANDIDATES = (
    "/video/", "/videos/", "/watch/", "/watch", "/embed/", "/v/", "/scene/", "/scenes/", "/movie/",
    "/movies/", "/clip/", "/clips/", "/view/", "/play/", "/media/", "/gallery/",
)
NAVIGATION = (
    "search", "tag", "tags", "category", "categories", "channel", "channels", "model", "models", "studio", "studios",
    "album", "albums", "photo", "photos", "page", "login", "signup", "register", "upload", "live", "best", "popular",
    "latest", "top", "new", "trending", "home", "about", "contact", "terms", "privacy", "dmca", "help", "faq",
    "c", "s", "pl", "en", "de", "fr", "es", "it", "ru", "pt", "nl", "jp", "cn", "tr",
)
# Endings of page files, names that say nothing, and words that open a tracking tail.
PAGE_ENDINGS = ("html", "htm", "php", "aspx", "jsp", "asp")
EMPTY_NAMES = ("index", "default", "video", "watch", "play")
TRACKING = ("utm", "source", "medium", "campaign", "term", "content")

_ANCHOR = r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
_BADGE = r"^\d{1,2}:\d{2}(:\d{2})?$"


def _attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def absolute_url(url: Column, base: Column) -> Column:
    """*url* resolved against the page's own address."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*?)/[^/?#]*(?:[?#].*)?$", 1)
    return (
        F.when(_none(url).isNull(), F.lit(None))
        .when(url.rlike(r"^https?://"), url)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .otherwise(F.concat(root, folder, F.lit("/"), url))
    )


def title_candidate(text: Column) -> Column:
    """A usable title, or NULL for nothing, duration badges and generic words."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(
        (t != "") & ~t.rlike(_BADGE) & ~F.lower(t).isin(*JUNK_TITLES), t
    )


def slug_title(url: Column) -> Column:
    """A name from the last path piece, or NULL when that is only an identifier.

    The piece is taken as words between ``-`` and ``_``: from the first tracking word that
    something follows the rest is left out. What must not stand in a file name becomes
    ``_``. No name are one of fewer than three characters, a word that says nothing, a
    number, or eight and more hexadecimal digits.
    """

    def before_tracking(name: Column) -> Column:
        marked = F.concat(F.lit("-"), F.lower(F.translate(name, "_", "-")))
        places = bind(marked, lambda m: F.transform(F.array(*(F.lit(f"-{word}-") for word in TRACKING)), lambda word: F.instr(m, word)))
        tail = F.array_min(F.filter(places, lambda at: at > 0))
        return bind(tail, lambda at: F.when(at.isNull(), name).otherwise(F.substring(name, F.lit(1), at - 1)))

    def without_ending(name: Column) -> Column:
        ending = F.lower(F.substring_index(name, ".", -1))
        return F.when(F.contains(name, F.lit(".")) & ending.isin(*PAGE_ENDINGS), F.substring(name, F.lit(1), F.length(name) - F.length(ending) - 1)).otherwise(name)

    def worth_keeping(name: Column) -> Column:
        empty = F.lower(name).isin(*EMPTY_NAMES) | (F.translate(name, "0123456789", "") == "")
        code = (F.length(name) >= 8) & (F.translate(F.lower(name), "0123456789abcdef", "") == "")
        return F.when((F.length(name) >= 3) & ~empty & ~code, name)

    # each step is evaluated once and bound to a name
    pieces = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda p: p != "")
    last = bind(pieces, lambda p: F.element_at(p, F.when(F.size(p) > 0, -1)))
    named = bind(last, lambda p: F.translate(F.coalesce(F.try_url_decode(p), p), '<>:"/\\|?*', "_" * 9))
    kept = bind(bind(named, before_tracking), without_ending)
    return bind(F.trim(kept, F.lit(".-_")), worth_keeping)


def image_url(tag: Column) -> Column:
    """The real image of a tag: lazy-load attributes before ``src``, placeholders last."""
    found = F.array_compact(
        F.array(
            *[
                F.split(F.trim(F.split(_none(_attr(tag, a)), ",")[0]), " ")[0]
                for a in IMAGE_ATTRIBUTES
            ]
        )
    )
    fake = "|".join(p.replace(".", r"\.") for p in PLACEHOLDERS)
    real = F.filter(found, lambda u: ~F.lower(u).rlike(rf"^data:|{fake}"))
    return F.coalesce(F.get(real, F.lit(0)), F.get(found, F.lit(0)))


def anchors(pages: DataFrame) -> DataFrame:
    """Every link tag of a page with its position."""
    return pages.select(
        "page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("pos", "tag")
    ).withColumn("href", F.regexp_extract("tag", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1))


def listing_entries(pages: DataFrame, pattern: str, *, limit: int = 200) -> DataFrame:
    """One row per page and link: longest usable title, first image, slug as fallback."""
    a = anchors(pages).filter(F.contains("href", F.lit(pattern)))
    opening = F.regexp_extract("tag", r"(?is)^(<a\s[^>]*>)", 1)
    inner = F.regexp_replace(F.regexp_replace("tag", r"(?is)^<a\s[^>]*>|</a>$", ""), r"(?s)<[^>]*>", "")
    img = F.regexp_extract("tag", r"(?is)(<img\s[^>]*>)", 1)
    titles = F.array(title_candidate(_attr(opening, "title")), title_candidate(inner), title_candidate(_attr(img, "alt")))
    best = F.array_max(
        F.transform(
            titles,
            lambda t, i: F.when(t.isNotNull(), F.struct(F.length(t).alias("n"), (-i).alias("o"), t.alias("t"))),
        )
    )
    rows = a.select(
        "page_id",
        absolute_url(F.col("href"), F.col("base")).alias("link"),
        "pos",
        best.alias("_b"),
        absolute_url(image_url(img), F.col("base")).alias("_img"),
    ).filter("link IS NOT NULL")
    out = rows.groupBy("page_id", "link").agg(
        F.min("pos").alias("position"),
        F.max_by("_b.t", F.struct(F.col("_b.n"), -F.col("pos"))).alias("_title"),
        F.min_by("_img", F.when(F.col("_img").isNotNull(), F.col("pos"))).alias("thumbnail"),
    )
    raw = F.regexp_extract(F.regexp_replace("link", r"/+$", ""), r"([^/]*)$", 1)
    title = F.coalesce("_title", slug_title(F.col("link")), _none(raw), F.col("link"))
    return out.select("page_id", "link", "position", F.substring(title, 1, limit).alias("title"), "thumbnail")


def link_patterns(pages: DataFrame, *, min_links: int = 5) -> DataFrame:
    """The path piece that marks item pages of each site.

    Known pieces first by how often they occur; else the most common first path
    segment that is no navigation, among the ten most common.
    """
    host = F.lower(F.regexp_extract("base", r"^[a-zA-Z+.-]+://([^/?#]*)", 1))
    a = anchors(pages).select(host.alias("host"), absolute_url(F.col("href"), F.col("base")).alias("link"))
    a = a.filter("link IS NOT NULL").select(
        "host",
        F.lower(F.regexp_extract("link", r"^[a-zA-Z+.-]+://([^/?#]*)", 1)).alias("_h"),
        F.lower(F.regexp_extract("link", r"^[a-zA-Z+.-]+://[^/?#]*([^?#]*)", 1)).alias("path"),
    )
    same = a.filter((F.col("_h") == "") | (F.col("host") == "") | (F.col("_h") == F.col("host")))
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(LINK_CANDIDATES)])
    known = (
        same.select("host", F.explode(F.filter(table, lambda c: F.contains(F.col("path"), c["p"]))).alias("_c"))
        .groupBy("host", "_c")
        .agg(F.count("*").alias("links"))
        .groupBy("host")
        .agg(F.max_by(F.struct(F.col("_c.p").alias("p"), "links"), F.struct(F.col("links"), -F.col("_c.i"))).alias("_k"))
    )
    seg = F.regexp_extract("path", r"^/*([^/]+)", 1)
    counts = same.select("host", seg.alias("seg")).filter("seg <> ''").groupBy("host", "seg").agg(F.count("*").alias("links"))
    w = Window.partitionBy("host").orderBy(F.desc("links"), "seg")
    generic = (
        counts.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= 10)
        .filter((F.length("seg") >= 2) & ~F.col("seg").isin(*NAVIGATION) & (F.col("links") >= min_links))
        .groupBy("host")
        .agg(F.min_by(F.struct(F.concat(F.lit("/"), F.col("seg"), F.lit("/")).alias("p"), "links"), "_r").alias("_g"))
    )
    return (
        same.select("host").distinct()
        .join(known, "host", "left")
        .join(generic, "host", "left")
        .select(
            "host",
            F.coalesce("_k.p", "_g.p").alias("pattern"),
            F.coalesce("_k.links", "_g.links").alias("links"),
        )
    )


# --- durations ---------------------------------------------------------------


def _amount(text: Column, unit: str) -> Column:
    """The number before *unit*, else 0."""
    return F.coalesce(_none(F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?)\s*{unit}", 1)).try_cast("double"), F.lit(0.0))


def _positive(seconds: Column) -> Column:
    return F.when(seconds > 0, seconds)


def iso_duration(text: Column) -> Column:
    """``P1DT2H3M4.5S`` in seconds; NULL when it is none or zero.

    Read unit by unit: days before the ``T``, hours, minutes and seconds after it; what is
    left when the amounts are taken out must be the letters alone, in that order.
    """
    t = F.upper(F.trim(text))
    days, clock = F.substring_index(t, "T", 1), F.when(F.contains(t, F.lit("T")), F.substring_index(t, "T", -1)).otherwise("")
    total = _amount(days, "D") * 86400 + _amount(clock, "H") * 3600 + _amount(clock, "M") * 60 + _amount(clock, "S")
    form = F.regexp_replace(F.regexp_replace(t, r"\.[0-9]+S$", "S"), "[0-9]+(?=[DHMS])", "")
    return F.when(form.rlike("^PD?(TH?M?S?)?$"), _positive(total))


#: A longer plain number is read as milliseconds, a longer script or player value is none.
LONGEST = 86400.0


def duration_text(text: Column, longest: float = LONGEST) -> Column:
    """Seconds from ISO-8601, plain seconds or milliseconds, H:M:S, M:S or ``1h 2m 3s``.

    The text's letters and colons tell which of the forms it is.
    """
    t = F.lower(F.trim(text))
    number = F.when(t.rlike("^[0-9]+([.][0-9]+)?$"), t.try_cast("double"))
    plain = F.when(number <= longest, number).when(number <= longest * 1000, number / 1000)
    groups = F.split(F.regexp_extract(t, "[0-9]+(:[0-9]+){1,2}", 0), ":")
    clock = F.aggregate(F.transform(groups, lambda g: g.try_cast("double")), F.lit(0.0), lambda total, g: total * 60 + g)
    spelled = _amount(t, "h") * 3600 + _amount(t, "m(?!s)") * 60 + _amount(t, "s")
    return (
        F.when(t.startswith("p") & iso_duration(t).isNotNull(), iso_duration(t))
        .when(number.isNotNull(), _positive(plain))
        .when(t.rlike("[0-9]:[0-9]"), _positive(clock))
        .when(t.rlike("[hms]"), _positive(spelled))
    )


# Where a page may state its duration, in order.
META_PROPERTIES = (
    ("property", "og:video:duration"),
    ("property", "video:duration"),
    ("name", "twitter:player:stream:duration"),
    ("name", "duration"),
    ("itemprop", "duration"),
)
SCRIPT_SECONDS = (
    "duration", "videoDuration", "contentDuration", "videoLength", "media_duration", "durationSeconds", "lengthSeconds",
    "length", "mediaLength", "totalDuration", "clipDuration", "runtime", "video_time", "time_length",
)
SCRIPT_MILLIS = ("durationMs", "approxDurationMs", "lengthMs")
URL_PARAMETERS = ("duration", "t", "time", "length")
AD_LENGTHS = (5.0, 6.0, 10.0, 15.0, 30.0)


def meta_duration(html: Column, longest: float = LONGEST) -> Column:
    tags = [
        F.regexp_extract(html, rf"(?is)(<meta\s[^>]*{k}\s*=\s*[\"']{v}[\"'][^>]*>)", 1) for k, v in META_PROPERTIES
    ]
    found = [duration_text(_none(_attr(t, "content")), longest) for t in tags]
    time_tag = F.regexp_extract(html, r"(?is)(<time\s[^>]*itemprop\s*=\s*[\"']duration[\"'][^>]*>)", 1)
    span = F.regexp_extract(html, r"(?is)<span\s[^>]*itemprop\s*=\s*[\"']duration[\"'][^>]*>(.*?)</span>", 1)
    return F.coalesce(
        *found,
        duration_text(_none(_attr(time_tag, "datetime")), longest),
        duration_text(_none(F.regexp_replace(span, r"<[^>]*>", " ")), longest),
    )


def structured_duration(html: Column, longest: float = LONGEST) -> Column:
    """First usable ``duration`` or ``contentDuration`` inside a JSON-LD block, at any depth."""
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    values = F.flatten(
        F.transform(
            blocks,
            lambda b: F.regexp_extract_all(
                b, F.lit(r"\"(?:duration|contentDuration)\"\s*:\s*\"?([^\",}\]]+)"), F.lit(1)
            ),
        )
    )
    return F.get(F.array_compact(F.transform(values, lambda v: duration_text(v, longest))), F.lit(0))


def script_duration(html: Column, longest: float = LONGEST) -> Column:
    """Longest plausible script variable: over 30 s and no usual ad length, else the longest small one.

    Every assignment (``name = value`` or ``"name": value``) is read once; its name decides
    whether the value counts, and in which unit.
    """
    assignment = r"([A-Za-z_]+)[\"']?\s*[:=]\s*[\"']?(P[^\"'\s]+|[0-9]+(?:\.[0-9]+)?)"
    pairs = F.arrays_zip(
        F.transform(F.regexp_extract_all(html, F.lit(assignment), F.lit(1)), F.lower).alias("name"),
        F.regexp_extract_all(html, F.lit(assignment), F.lit(2)).alias("value"),
    )

    def seconds(pair: Column) -> Column:
        number = pair["value"].try_cast("double")
        known = lambda names: F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: pair["name"].endswith(n))
        return F.when(known(SCRIPT_MILLIS), number / 1000).when(known(SCRIPT_SECONDS), F.coalesce(number, iso_duration(pair["value"])))

    ok = F.filter(F.transform(pairs, seconds), lambda v: v.between(1, longest))
    main = F.array_max(F.filter(ok, lambda v: (v >= 30) & ~v.isin(*AD_LENGTHS)))
    return F.coalesce(main, F.array_max(F.filter(ok, lambda v: v < 30)))


def player_duration(html: Column, longest: float = LONGEST) -> Column:
    setup = F.regexp_extract(html, r"(?is)(?:jwplayer\([^)]*\)|playerInstance)\.setup\(\s*\{(.+?)\}\s*\)", 1)
    inner = F.regexp_extract(setup, r"(?i)[\"']?duration[\"']?\s*[:=]\s*[\"']?(\d+(?:\.\d+)?)", 1)
    data = F.regexp_extract(html, r"(?is)<(?:video|div)\s[^>]*data-duration\s*=\s*[\"'](\d+(?:\.\d+)?)[\"']", 1)
    a, b = _none(inner).try_cast("double"), _none(data).try_cast("double")
    return F.coalesce(F.when(a.between(1, longest), a), F.when(b.between(1, longest), b))


def url_duration(url: Column, longest: float = LONGEST) -> Column:
    return F.coalesce(
        *[duration_text(_none(F.regexp_extract(url, rf"[?&]{p}=([^&#]*)", 1)), longest) for p in URL_PARAMETERS]
    )


def page_durations(pages: DataFrame, *, longest: float = LONGEST) -> DataFrame:
    """First hit per page with its source; a small script value is the last resort.

    Values of more than *longest* seconds are implausible; infinity admits all.

    The sources are worked out once each (behind a generator) and then chosen from.
    """
    found = pages.select(
        "page_id",
        F.inline(
            F.array(
                F.struct(
                    meta_duration(F.col("html"), longest).alias("meta"),
                    structured_duration(F.col("html"), longest).alias("structured"),
                    script_duration(F.col("html"), longest).alias("script"),
                    player_duration(F.col("html"), longest).alias("player"),
                    url_duration(F.col("url"), longest).alias("address"),
                )
            )
        ),
    )
    picks = [
        ("meta", F.col("meta")),
        ("structured", F.col("structured")),
        ("script", F.when(F.col("script") >= 30, F.col("script"))),
        ("player", F.col("player")),
        ("address", F.col("address")),
        ("small script", F.col("script")),
    ]
    first = F.coalesce(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("source"), v.alias("seconds"))) for n, v in picks])
    return found.select("page_id", first.alias("_f")).select("page_id", "_f.source", "_f.seconds")
