"""Boxes, axes, tabs, playlists, tools, fingerprints and tokens as columns."""

from __future__ import annotations

import hashlib
import hmac
import math
from struct import pack

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, MapType, StringType

#: Points in a unit of length, and the smallest side of a box.
POINTS = {"pt": 1.0, "in": 72.0, "mm": 72 / 25.4, "cm": 72 / 2.54}
LEAST_SIDE = 18.0


def box_from_margins(width: Column, height: Column, m: Column) -> Column:
    return F.struct(m["left"].alias("x"), m["top"].alias("y"), (width - m["left"] - m["right"]).alias("width"), (height - m["top"] - m["bottom"]).alias("height"))


def margins_from_box(width: Column, height: Column, b: Column) -> Column:
    return F.struct(b["y"].alias("top"), b["x"].alias("left"), (width - b["x"] - b["width"]).alias("right"), (height - b["y"] - b["height"]).alias("bottom"))


def clamped_box(width: Column, height: Column, b: Column, least: float = LEAST_SIDE) -> Column:
    """A box kept on its page, with both sides at least `least` where the page has room."""
    side = lambda page, own: F.least(page, F.greatest(F.least(F.lit(least), page), own))
    w, h = side(width, b["width"]), side(height, b["height"])
    return F.struct(F.greatest(F.lit(0.0), F.least(width - w, b["x"])).alias("x"), F.greatest(F.lit(0.0), F.least(height - h, b["y"])).alias("y"), w.alias("width"), h.alias("height"))


def length_in_points(typed: Column, unit: str) -> Column:
    """A typed length, with a comma or a point, as points; null if it isn't a number of zero or more."""
    t = F.replace(F.trim(typed), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^(\d*\.?\d+|\d+\.)$"), t.try_cast("double") * POINTS[unit])


def axis(low: Column, high: Column, target: int = 6) -> Column:
    """lo, hi and step of an axis with about `target` steps of 1, 2, 2.5 or 5 times a power of ten."""
    top = F.when(high > low, high).otherwise(low + 1)
    raw = (top - low) / target
    size = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = F.coalesce(*(F.when(F.lit(m) * size >= raw, F.lit(m) * size) for m in (1.0, 2.0, 2.5, 5.0)), 10.0 * size)
    return F.struct((F.floor(low / step + 1e-9) * step).alias("lo"), (F.ceil(top / step - 1e-9) * step).alias("hi"), step.alias("step"))


def ticks(scale: Column) -> Column:
    n = F.round((scale["hi"] - scale["lo"]) / scale["step"]).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.round(scale["lo"] + k * scale["step"], 10))


def expand_tabs(line: Column, stop: int = 4) -> Column:
    """Tabs of a line as blanks up to the next multiple of `stop`."""
    parts = F.split(line, "\t")
    fill = lambda t: F.repeat(F.lit(" "), F.lit(stop) - F.length(t) % stop)
    return F.concat(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.concat(p, fill(p))), ""), F.element_at(parts, -1))


def playlist_id(url: Column) -> Column:
    """The list that a playlist or video link names; null for other hosts and ids."""
    u = F.regexp_replace(F.trim(url), r"(?i)^(?!https?://)", "https://")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/:?#]+)", 1)), r"^(www|m|mobile|music)\.", "")
    path, listed = F.regexp_extract(u, r"(?i)^https?://[^/?#]+(/[^?#]*)?", 1), F.regexp_extract(u, r"[?&]list=([^&#]*)", 1)
    video = F.when(host == "youtu.be", path.rlike(r"^/[\w-]{11}$")).otherwise(path.rlike(r"^/(playlist|watch)$|^/(shorts|live|embed)/[\w-]{11}"))
    return F.when(host.isin("youtube.com", "youtu.be") & listed.rlike(r"^[\w-]{10,64}$") & video, listed)


def file_extension(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(name), r"(?i)\.([a-z0-9]{1,8})$", 1)), F.lit(""))


def tool_of_path(path: Column) -> Column:
    """The tool that a page belongs to."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^/tools/([a-z0-9-]+)/?$", 1), F.lit("")), F.when(path.rlike(r"^/(edit|editor)/"), "edit-pdf"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over the parts, each after its length in bytes (as a big-endian double), so that no two lists of parts run into one."""
    packed = F.arrow_udf(lambda n: pa.array([pack(">d", x or 0.0) for x in n.to_pylist()], pa.binary()), BinaryType())
    empty = F.lit(b"")
    return F.sha2(F.concat(*(x for p in parts for x in (packed(F.octet_length(F.coalesce(p.cast("binary"), empty)).cast("double")), F.coalesce(p.cast("binary"), empty)))), 256)


def signature(payload: Column, secret: str) -> Column:
    """HMAC-SHA-256 in hexadecimal."""
    key = secret.encode()
    return F.arrow_udf(lambda c: pa.array([None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest() for x in c.to_pylist()], pa.string()), StringType())(payload)


def token(payload: Column, expires: Column, secret: str) -> Column:
    """payload.expiry.signature; the payload in base 64, the expiry in seconds."""
    body = F.concat_ws(".", F.base64(payload.cast("binary")), expires.cast("string"))
    return F.concat_ws(".", body, signature(body, secret))


def token_payload(token: Column, now: Column, secret: str, grace: int = 0) -> Column:
    """The payload of a token that was signed with the secret and has not expired for longer than `grace` seconds; null otherwise."""
    body, given = F.substring_index(token, ".", 2), F.substring_index(token, ".", -1)
    expires = F.substring_index(body, ".", -1).try_cast("long")
    good = (signature(body, secret) == given) & (expires + grace >= now)
    return F.when(good, F.decode(F.unbase64(F.substring_index(body, ".", 1)), "UTF-8"))


# The operators of shape formulas, as their published format defines them.
_GUIDES = {
    "val": lambda a, *_: a, "*/": lambda a, b, c, *_: a * b / c, "+-": lambda a, b, c, *_: a + b - c, "+/": lambda a, b, c, *_: (a + b) / c, "?:": lambda a, b, c, *_: b if a > 0 else c,
    "abs": lambda a, *_: abs(a), "max": lambda a, b, *_: max(a, b), "min": lambda a, b, *_: min(a, b), "pin": lambda a, b, c, *_: a if b < a else min(b, c), "sqrt": lambda a, *_: math.sqrt(a),
    "mod": lambda a, b, c, *_: math.hypot(a, b, c), "sin": lambda a, b, *_: a * math.sin(math.radians(b / 60000)), "cos": lambda a, b, *_: a * math.cos(math.radians(b / 60000)),
}


def _guides(formulas: list[dict] | None, given: list | None) -> dict[str, float] | None:
    values = dict(given or [])
    try:
        for g in formulas or []:
            operator, *words = g["formula"].split()
            out = _GUIDES[operator](*(values[w] if w in values else float(w) for w in words))
            if not g["name"] or not math.isfinite(out):
                return None
            values[g["name"]] = out
    except (KeyError, ValueError, TypeError, ZeroDivisionError):
        return None
    return values


def guide_values(formulas: Column, given: Column) -> Column:
    """formulas (array of name and formula, in order) over given values (map); null if one of them can't be worked out."""
    kind = pa.map_(pa.string(), pa.float64())
    return F.arrow_udf(lambda f, g: pa.array([None if (v := _guides(x, y)) is None else list(v.items()) for x, y in zip(f.to_pylist(), g.to_pylist())], kind), MapType(StringType(), DoubleType()))(formulas, given)
