import json

from tessera.sources import posts

SCHEMA = "id string, service string, body string, wanted int"
MP4 = "https://video.twimg.com/ext/vid/{0}x{1}/{2}.mp4"


def tweet(*media, **more):
    return json.dumps({"mediaDetails": list(media), "user": {"screen_name": "who"}, "text": "Look  https://t.co/abc"} | more)


def item(kind, *sizes, thumb="t"):
    files = [{"content_type": "video/mp4", "url": MP4.format(w, h, n), "bitrate": b} for w, h, n, b in sizes]
    return {"type": kind, "media_url_https": thumb, "video_info": {"duration_millis": 1500, "variants": [{"content_type": "application/x-mpegURL", "url": "https://video.twimg.com/a.m3u8"}, *files]}}


def answers(spark, rows):
    return {r.id: r for r in posts.post_videos(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_one_form_of_three_shapes(spark):
    photo, one = {"type": "photo", "media_url_https": "p"}, item("video", (320, 180, "a", 100), (1280, 720, "b", 900), (1280, 720, "c", 950), (1280, 720, "b", 900))
    two = item("animated_gif", (64, 64, "g", 0), thumb="g")
    fx = {"code": 200, "status": {"text": "", "author": {"screen_name": "fx"}, "media": {"all": [{"type": "photo"}, {"type": "video", "url": MP4.format(1, 1, "u"), "width": 640, "height": 360, "duration": 2.5, "thumbnail_url": "ft", "formats": [{"url": MP4.format(1, 1, "v"), "container": "webm"}, {"url": "https://evil.org/x.mp4"}, {"url": MP4.format(1, 1, "w"), "bitrate": 5, "height": 720, "width": 1280}]}]}}}
    vx = {"text": "x" * 100, "user_screen_name": None, "media_extended": [{"type": "gif", "url": MP4.format(1, 1, "z"), "size": {"width": 10, "height": 20}, "duration_millis": 0}]}
    got = answers(spark, [("1", "syndication", tweet(photo, one, two), None), ("2", "syndication", tweet(photo, one, two), 3), ("3", "syndication", tweet(photo, one), 1), ("4", "fx", json.dumps(fx), 2), ("5", "vx", json.dumps(vx), None)])
    a = got["1"].answer
    assert (a["index"], a.title, a.author, a.thumbnail, a.duration, a.has_audio) == (1, "Look", "who", "t", 1.5, True) and [v.url[-5:] for v in a.variants] == ["c.mp4", "b.mp4", "a.mp4"]
    assert (got["2"].answer["index"], got["2"].answer.has_audio, got["2"].answer.thumbnail) == (2, False, "g") and got["3"].answer["index"] is None and len(got["3"].answer.variants) == 3
    f = got["4"].answer
    assert (f.title, f.duration, f.thumbnail, [(v.url[-5:], v.height) for v in f.variants]) == ("Video by @fx", 2.5, "ft", [("w.mp4", 720), ("u.mp4", 360)])
    v = got["5"].answer
    assert (v.title, v.author, v.duration, v.has_audio, v.variants[0].height) == ("x" * 87 + "…", None, None, False, 20) and all(r.error is None for r in got.values())


def test_the_first_answer_or_the_first_definite_error(spark):
    gone, empty, video = json.dumps({"__typename": "TweetTombstone"}), "{}", tweet(item("video", (320, 180, "a", 1)))
    vx = json.dumps({"media_extended": [{"type": "video", "url": MP4.format(1, 1, "z")}]})
    rows = [("1", "syndication", gone, None), ("1", "fx", json.dumps({"code": 404}), None), ("1", "vx", vx, None), ("2", "syndication", empty, None), ("2", "fx", json.dumps({"code": 401}), None), ("2", "vx", "{}", None), ("3", "syndication", None, None), ("3", "fx", "not json", None), ("4", "vx", json.dumps({"media_extended": []}), None)]
    rows += [("5", "syndication", tweet({"type": "photo"}), None), ("5", "fx", json.dumps({"code": 200, "tweet": {"media": {"videos": [{"type": "clip", "url": MP4.format(1, 1, "q")}]}}}), None), ("x1", "syndication", video, None), ("6", "fx", json.dumps({"status": {"text": "t"}}), None), ("7", "syndication", gone, None), ("7", "fx", json.dumps({"code": 404}), None)]
    got = answers(spark, rows)
    assert got["5"].service == "fx" and got["1"].service == "vx" and got["1"].error is None
    assert {k: got[k].error for k in ("2", "3", "4", "5", "6", "7", "x1")} == {"2": "login-required", "3": "unreachable", "4": "unreachable", "5": None, "6": "no-video", "7": "unavailable", "x1": "not-found"}
    assert posts.post_videos(spark.createDataFrame([], SCHEMA)).count() == 0
