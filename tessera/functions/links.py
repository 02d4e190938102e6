"""Links to posts and their records: platforms, ids, previews, form fields, sizes and problems of page lists."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T

# Hosts of each platform (without www., m., mobile. or music.), where its links have the id, and the address that stands for it.
_YOUTUBE, _TIKTOK = "https://www.youtube.com/watch?v=", "https://www.tiktok.com/"
LINKS = (
    ("youtube", ("youtu.be",), r"^/([\w-]{11})(?:/|$)", _YOUTUBE), ("youtube", ("youtube.com", "youtube-nocookie.com"), r"^/(?:shorts|embed|live|v)/([\w-]{11})", _YOUTUBE),
    ("tiktok", ("tiktok.com",), r"^/t/(\w{4,20})/?$", _TIKTOK + "t/"), ("tiktok", ("tiktok.com",), r"^/@[\w.-]{1,40}/video/(\d{8,25})", _TIKTOK + "@{user}/video/"),
    ("tiktok", ("tiktok.com",), r"^/(?:embed(?:/v2)?|share/video)/(\d{8,25})", _TIKTOK + "@_/video/"),
    ("instagram", ("instagram.com",), r"^/(?:[\w.]{1,30}/)?(?:p|reels?|tv)/([A-Za-z0-9_-]{5,60})/?", "https://www.instagram.com/p/"),
    ("x", ("x.com", "twitter.com"), r"^/(?:\w{1,15}|i(?:/web)?)/status(?:es)?/(\d{5,25})", "https://x.com/i/status/"),
)
SHORT_HOSTS, X_INDEX = ("vm.tiktok.com", "vt.tiktok.com"), r"^/[^?]*/status(?:es)?/\d{5,25}/(?:video|photo)/([1-9])"
OEMBED = "title string, author_name string, thumbnail_url string"
UNITS = ("B", "KB", "MB", "GB")
PASSWORD = 1 << 13


def media_link(link: Column) -> Column:
    """Platform, id, canonical address and index of a link to a post, as a struct; null if it is none. The index counts the post's items from 1."""
    url = F.regexp_replace(F.trim(link), r"^(?!(?i:https?)://)", "https://")
    full, path = T.url_host(url), F.coalesce(F.nullif(T.url_path(url), F.lit("")), F.lit("/"))
    host = F.regexp_replace(full, r"^(?:www|m|mobile|music)\.", "")
    param = lambda name, value: F.regexp_extract(url, rf"[?&]{name}=({value})(?:[&#]|$)", 1)
    found = lambda ok, platform, i, canonical, index: F.when(ok, F.struct(F.lit(platform).alias("platform"), i.alias("id"), canonical.alias("canonical"), index.alias("index")))
    none = F.lit(None).cast("int")
    short = F.regexp_extract(path, r"^/(\w{4,20})/?$", 1)
    video = param("v", r"[\w-]{11}")
    out = [
        found(full.isin(*SHORT_HOSTS) & (short != ""), "tiktok", short, F.concat(F.lit("https://"), full, F.lit("/"), short, F.lit("/")), none),
        found(host.isin("youtube.com", "youtube-nocookie.com") & (video != ""), "youtube", video, F.concat(F.lit(_YOUTUBE), video), none),
    ]
    for platform, hosts, pattern, address in LINKS:
        i = F.regexp_extract(path, pattern, 1)
        index, end = none, F.lit("")
        if platform == "x":
            index = F.regexp_extract(path, X_INDEX, 1).try_cast("int")
            end = F.coalesce(F.concat(F.lit("/video/"), index.cast("string")), F.lit(""))
        elif platform == "instagram":
            n = param("img_index", r"\d{1,3}").try_cast("int")
            index = F.when(n.between(1, 20), n)
            end = F.concat(F.lit("/"), F.coalesce(F.concat(F.lit("?img_index="), index.cast("string")), F.lit("")))
        elif address.endswith("/t/"):
            end = F.lit("/")
        user = F.regexp_extract(path, r"^/@([\w.-]{1,40})/", 1)
        start = F.concat(*(user if part == "{user}" else F.lit(part) for part in address.replace("{user}", "\0{user}\0").split("\0")))
        out.append(found(host.isin(*hosts) & (i != ""), platform, i, F.concat(start, i, end), index))
    return F.coalesce(*out)


def preview(raw: Column, status: Column) -> Column:
    """A preview's answer as a struct: title (300 characters at most), channel (120), thumbnail (of the platform's own image host) and error: 'private',
    'blocked' or 'unreachable', by status and by whether there is a title."""
    got = F.from_json(F.when(F.length(raw) <= 100_000, raw), OEMBED)
    title = F.substring(T.clean_title(got["title"]), 1, 300)
    error = F.when(status.isin(401, 403), "blocked").when(status.isin(404, 400), "private").when(~status.between(200, 299) | (F.coalesce(title, F.lit("")) == ""), "unreachable")
    image = F.when(got["thumbnail_url"].rlike(r"^https://i\d?\.ytimg\.com(?:[/?#]|$)"), got["thumbnail_url"])
    fine = lambda c: F.when(error.isNull(), c)
    return F.struct(fine(title).alias("title"), fine(F.nullif(F.substring(T.clean_title(got["author_name"]), 1, 120), F.lit(""))).alias("channel"), fine(image).alias("thumbnail"), error.alias("error"))


def first_answer(sources: list[tuple[Column, Column]], otherwise: str = "unreachable") -> tuple[Column, Column]:
    """(answer, error) of sources (answer, error) in order: the first answer there is; if there is none, the first definite error, or `otherwise`."""
    answer = F.coalesce(*(F.nullif(a, F.lit("")) for a, _ in sources))
    return answer, F.when(answer.isNull(), F.coalesce(*(e for _, e in sources), F.lit(otherwise)))


def size_text(size: Column, digits: int = 1) -> Column:
    """Bytes as B, KB, MB or GB of 1,024, without zeros at the end; null beyond."""
    step = sum((F.when(size >= 1024**k, 1).otherwise(0) for k in range(1, len(UNITS) + 1)), F.lit(0))
    shown = F.regexp_replace(F.format_string(f"%.{digits}f", T.half_up(size / F.pow(F.lit(1024.0), step), digits)), r"\.?0+$" if digits else "$^", "")
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").otherwise(F.concat_ws(" ", shown, F.get(F.array(*map(F.lit, UNITS)), step)))


def page_list_problem(typed: Column, pages: Column) -> Column:
    """Why a page list can't be used as it was typed, by its first bad part; null if all is fine. Blanks part numbers, but not beside a dash."""
    parts = F.filter(F.transform(F.split(typed, r"[,;]|(?<![\s\-–])\s+(?![\s\-–])"), lambda p: F.trim(p)), lambda p: p != "")
    missing = lambda n: F.concat(F.lit("Page "), n.cast("string"), F.lit(" isn't in this PDF ("), pages.cast("string"), F.when(pages == 1, " page).").otherwise(" pages)."))
    ends = lambda p: (F.regexp_extract(p, r"^(\d+)\s*[-–]\s*(\d*)$", 1).try_cast("decimal(38,0)"), F.regexp_extract(p, r"^(\d+)\s*[-–]\s*(\d*)$", 2).try_cast("decimal(38,0)"))

    def problem(p: Column) -> Column:
        a, b = ends(p)
        low, high = F.least(a, b), F.greatest(a, b)
        of_range = F.when((low > pages) | (high < 1), missing(low))
        one = p.try_cast("decimal(38,0)")
        return F.when(a.isNotNull(), of_range).when(p.rlike(r"^\d+$"), F.when((one < 1) | (one > pages), missing(one))).otherwise("Use commas between ranges, like 1-3, 5.")

    return F.get(F.filter(F.transform(parts, problem), lambda x: x.isNotNull()), 0)


def _found(value: object, key: str, depth: int) -> object:
    """Depth first, by a list of what is still to be seen, the next one last."""
    open_values = [(value, 0)]
    while open_values:
        now, at = open_values.pop()
        if at > depth or not isinstance(now, (dict, list)):
            continue
        if isinstance(now, dict) and key in now:
            if now[key] or isinstance(now[key], (dict, list)):  # an empty object is an answer, 0 and "" are none
                return now[key]
            continue
        inner = list(now.values()) if isinstance(now, dict) else now
        open_values += [(x, at + 1) for x in reversed(inner)]
    return None


def nested_value(document: Column, key: str, depth: int = 40) -> Column:
    """The value (as JSON) of the first object that has the key, depth first and at most `depth` levels down; an object with an empty, zero or null value there is
    passed with all that is in it. Null if there is none or the text is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            found = _found(json.loads(text), key, depth) if text and key in text else None
        except (ValueError, RecursionError):
            return None
        return None if found is None else json.dumps(found, ensure_ascii=False, separators=(",", ":"))

    return F.arrow_udf(lambda t: pa.array(map(one, t.to_pylist()), pa.string()), StringType())(document)


def field_spans(fields: DataFrame) -> DataFrame:
    """Filled-in form fields as spans of their page: fields (doc_id, page, pos, subtype, hidden, rect: x1, y1, x2, y2, field_type, value: list, flags, check_box, radio_button,
    export_value, button_value, font_size, transform: six numbers, view_height) to doc_id, page, pos, text, x, y, width, height, font_size, font_name, bold, field.
    A text field shows what was typed unless it is a password, a choice all that was chosen, a box or button a sign if it is set; others show nothing."""
    value = F.get("value", 0)
    shown = F.when(F.col("field_type") == "Tx", F.when((F.size("value") == 1) & (F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(PASSWORD)) == 0), value))
    shown = shown.when(F.col("field_type") == "Ch", F.array_join("value", ", "))
    shown = shown.when((F.col("field_type") == "Btn") & F.col("check_box"), F.when((value != "Off") & (value == F.col("export_value")), "☒"))
    shown = shown.when((F.col("field_type") == "Btn") & F.col("radio_button"), F.when(value == F.col("button_value"), "◉"))
    bare = F.trim(F.regexp_replace(shown, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))
    real = fields.filter((F.col("subtype") == "Widget") & ~F.coalesce("hidden", F.lit(False)) & (F.size("rect") >= 4)).withColumn("text", bare).filter("text <> ''")
    m, r = (lambda k: F.col("transform")[k]), (lambda k: F.col("rect")[k])
    xs = [m(0) * r(i) + m(2) * r(i + 1) + m(4) for i in (0, 2)]
    ys = [F.col("view_height") - (m(1) * r(i) + m(3) * r(i + 1) + m(5)) for i in (0, 2)]
    real = real.withColumns({"x": F.least(*xs), "width": F.abs(xs[1] - xs[0]), "top": F.least(*ys), "tall": F.abs(ys[1] - ys[0])})
    size = F.least(F.lit(14.0), F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(F.col("tall") * 0.7))
    real = real.withColumn("font_size", F.when(size > 0, size).otherwise(10.0))
    y = F.col("top") + F.greatest(F.lit(0.0), (F.col("tall") - F.col("font_size") * 0.7) / 2)
    return real.select("doc_id", "page", "pos", "text", "x", y.alias("y"), "width", F.col("font_size").alias("height"), "font_size", F.lit("").alias("font_name"), F.lit(False).alias("bold"), F.lit(True).alias("field"))
