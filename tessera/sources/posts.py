"""Answers about a post's video from services with shapes of their own: each shape is read into one form, and one rule goes on from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_title

# The three services in the order in which they are believed, and the fields of their answers that are read.
SERVICES = ("syndication", "fx", "vx")
_ITEM = "struct<type: string, url: string, media_url_https: string, video_info: struct<duration_millis: double, variants: array<struct<content_type: string, url: string, bitrate: double>>>>"
_VIDEO = "struct<type: string, url: string, width: int, height: int, thumbnail_url: string, duration: double, formats: array<struct<url: string, container: string, codec: string, bitrate: double, width: int, height: int>>, variants: array<struct<url: string, container: string, codec: string, bitrate: double, width: int, height: int>>>"
_STATUS = f"struct<text: string, author: struct<screen_name: string>, media: struct<all: array<{_VIDEO}>, videos: array<{_VIDEO}>>>"
SHAPES = {
    "syndication": f"__typename string, text string, user struct<screen_name: string>, mediaDetails array<{_ITEM}>, quoted_tweet struct<mediaDetails: array<{_ITEM}>>",
    "fx": f"code int, status {_STATUS}, tweet {_STATUS}",
    "vx": "text string, user_screen_name string, media_extended array<struct<type: string, url: string, thumbnail_url: string, duration_millis: double, size: struct<width: int, height: int>>>",
}
_FILE = "struct<url: string, bitrate: double, width: int, height: int>"
_MEDIA = f"array<struct<video: boolean, audio: boolean, thumbnail: string, seconds: double, files: array<{_FILE}>>>"
FILE_URL, SIZE_IN_URL, SHORT_LINK = r"^https://video\.twimg\.com(?::443)?/[^?#]*\.(?i:mp4)(?:[?#]|$)", r"/(\d{2,5})x(\d{2,5})/", r"https?://t\.co/\S+"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _items(media: Column, one) -> Column:
    return F.coalesce(F.transform(media, one), F.expr(f"CAST(array() AS {_MEDIA})"))


def _media(video: Column, audio: Column, thumbnail: Column, seconds: Column, files: Column) -> Column:
    return F.struct(F.coalesce(video, F.lit(False)).alias("video"), F.coalesce(audio, F.lit(True)).alias("audio"), thumbnail.alias("thumbnail"), seconds.cast("double").alias("seconds"), F.coalesce(files, F.expr(f"CAST(array() AS array<{_FILE}>)")).alias("files"))


def _file(url: Column, bitrate: Column, width: Column, height: Column) -> Column:
    return F.struct(url.alias("url"), F.coalesce(bitrate, F.lit(0.0)).cast("double").alias("bitrate"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def _syndication(rows: DataFrame) -> DataFrame:
    a = F.col("a")
    size = lambda url, k: F.regexp_extract(url, SIZE_IN_URL, k).try_cast("int")
    files = lambda m: F.transform(F.filter(m["video_info"]["variants"], lambda v: v["content_type"] == "video/mp4"), lambda v: _file(v["url"], v["bitrate"], size(v["url"], 1), size(v["url"], 2)))
    item = lambda m: _media(m["type"].isin("video", "animated_gif"), m["type"] != "animated_gif", m["media_url_https"], F.nullif(m["video_info"]["duration_millis"], F.lit(0.0)) / 1000, files(m))
    media = F.concat(_items(a["mediaDetails"], item), _items(a["quoted_tweet"]["mediaDetails"], item))
    known = F.col("body").isNotNull() & ~F.col("body").rlike(r"^\s*(?:\{\s*\})?\s*$")
    return rows.select("*", known.alias("known"), F.when(a["__typename"] == "TweetTombstone", "unavailable").alias("refused"), a["text"].alias("text"), a["user"]["screen_name"].alias("author"), media.alias("media"), F.col("wanted").alias("place"), F.get(F.expr(f"CAST(array() AS {_MEDIA})"), 0).alias("spare"), F.lit(True).alias("strict"))


def _fx(rows: DataFrame) -> DataFrame:
    a = F.col("a")
    s = F.coalesce(a["status"], a["tweet"])
    usable = lambda f: (F.coalesce(f["container"], F.lit("mp4")) == "mp4") & (F.coalesce(f["codec"], F.lit("h264")) == "h264") & f["url"].isNotNull()
    listed = lambda v: F.transform(F.filter(F.coalesce(v["formats"], v["variants"], F.expr("CAST(array() AS array<struct<url: string, container: string, codec: string, bitrate: double, width: int, height: int>>)")), usable), lambda f: _file(f["url"], f["bitrate"], f["width"], f["height"]))
    own = lambda v: F.when(v["url"].isNotNull(), F.array(_file(v["url"], F.lit(0.0), v["width"], v["height"]))).otherwise(F.expr(f"CAST(array() AS array<{_FILE}>)"))
    item = lambda v: _media(v["type"].isin("video", "gif"), v["type"] != "gif", v["thumbnail_url"], v["duration"], F.concat(listed(v), own(v)))
    both = s["media"]["all"].isNotNull()
    refused = F.when(a["code"] == 404, "not-found").when(a["code"].isin(401, 403), "login-required")
    return rows.select("*", (s.isNotNull() | refused.isNotNull()).alias("known"), refused.alias("refused"), s["text"].alias("text"), s["author"]["screen_name"].alias("author"), _items(F.coalesce(s["media"]["all"], s["media"]["videos"]), item).alias("media"), F.when(both, F.col("wanted")).alias("place"), F.get(_items(s["media"]["videos"], item), 0).alias("spare"), F.lit(True).alias("strict"))


def _vx(rows: DataFrame) -> DataFrame:
    a = F.col("a")
    item = lambda m: _media(m["type"].isin("video", "gif"), m["type"] != "gif", m["thumbnail_url"], F.nullif(m["duration_millis"], F.lit(0.0)) / 1000, F.filter(F.array(_file(m["url"], F.lit(0.0), m["size"]["width"], m["size"]["height"])), lambda f: f["url"].isNotNull()))
    return rows.select("*", a.isNotNull().alias("known"), _none("string").alias("refused"), a["text"].alias("text"), a["user_screen_name"].alias("author"), _items(a["media_extended"], item).alias("media"), F.col("wanted").alias("place"), F.get(F.expr(f"CAST(array() AS {_MEDIA})"), 0).alias("spare"), F.lit(False).alias("strict"))


def post_answers(raw: DataFrame) -> DataFrame:
    """raw (id, service, body: JSON, wanted: the place of a media item in the post, from 1, or null) to id, service, answer (a struct: index, title, author, thumbnail, duration,
    has_audio, variants, best first) and error. What is wanted counts all media; if it is no video, the first video answers, or what a service lists as a video under another name. Without a video the error is 'no-video'."""
    read = {"syndication": _syndication, "fx": _fx, "vx": _vx}
    parts = [read[s](raw.filter(F.col("service") == s).select("id", "service", "body", F.col("wanted").cast("int").alias("wanted"), F.from_json("body", SHAPES[s]).alias("a"))).drop("a", "body", "wanted") for s in SERVICES]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    videos = F.filter("media", lambda m: m["video"])
    asked = F.get("media", F.col("place") - 1)
    picked = F.when(asked["video"], asked).otherwise(F.get(videos, 0))
    first = F.when(F.size(F.filter(F.slice("media", 1, F.greatest(F.col("place"), F.lit(0))), lambda m: m["video"])) > 0, F.size(F.filter(F.slice("media", 1, F.greatest(F.col("place"), F.lit(0))), lambda m: m["video"])))
    rows = rows.withColumn("item", F.coalesce(picked, F.col("spare"))).withColumn("index", F.when(F.size(videos) > 1, F.when(asked["video"], first).otherwise(1)))
    files = F.filter("item.files", lambda f: f["url"].rlike(FILE_URL))
    urls = F.transform(files, lambda f: f["url"])
    once = F.filter(files, lambda f, i: F.array_position(urls, f["url"]) == i + 1)
    best = F.transform(F.sort_array(F.transform(once, lambda f, i: F.struct((-F.coalesce(f["height"], F.lit(0))).alias("h"), (-f["bitrate"]).alias("b"), i.alias("i"), f.alias("f")))), lambda x: x["f"])
    title = clean_title(F.regexp_replace(F.coalesce("text", F.lit("")), SHORT_LINK, ""))
    title = F.when(title != "", F.when(F.length(title) > 90, F.concat(F.substring(title, 1, 87), F.lit("…"))).otherwise(title)).when(F.col("author").isNotNull(), F.concat(F.lit("Video by @"), "author")).otherwise("X video")
    rows = rows.withColumn("variants", best)
    answer = F.struct("index", title.alias("title"), "author", F.col("item.thumbnail").alias("thumbnail"), F.col("item.seconds").alias("duration"), F.col("item.audio").alias("has_audio"), "variants")
    fine = F.col("known") & F.col("refused").isNull() & F.col("item").isNotNull() & (F.size("variants") > 0)
    error = F.when(F.col("known"), F.coalesce("refused", F.when(F.col("item").isNull() & F.col("strict"), "no-video")))
    return rows.select("id", "service", F.when(fine, answer).alias("answer"), error.alias("error"))


def post_videos(raw: DataFrame) -> DataFrame:
    """id, answer and error of each post: the answer of the first service that has one; if none has, the first definite error, or 'unreachable'. Ids that are no
    numbers are 'not-found'."""
    rank = F.array_position(F.array(*map(F.lit, SERVICES)), F.col("service"))
    each = post_answers(raw).withColumn("rank", rank)
    best = each.groupBy("id").agg(F.min(F.when(F.col("answer").isNotNull(), F.struct("rank", "service", "answer"))).alias("x"), F.min(F.when(F.col("error").isNotNull(), F.struct("rank", "error"))).alias("e"))
    good = F.col("id").cast("string").rlike(r"^\d{1,25}$")
    answer = F.when(good, F.col("x.answer"))
    return best.select("id", F.when(good, F.col("x.service")).alias("service"), answer.alias("answer"), F.when(~good, "not-found").when(F.col("x").isNull(), F.coalesce("e.error", F.lit("unreachable"))).alias("error"))
