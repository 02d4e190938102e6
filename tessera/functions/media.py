"""Names, addresses, media and geometry as Spark columns."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import column_name

# Average stereo bitrates of variable-bitrate levels 0 to 9, in kbit/s.
VBR_KBPS = [245, 225, 190, 175, 165, 130, 115, 100, 85, 65]
# The alphabet of base-64 short codes.
SHORTCODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def decamel(text: Column) -> Column:
    """A blank before each capital that begins a word inside of one; runs of capitals stay together."""
    return F.trim(F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|\s+", " "))


def looks_garbled(text: Column) -> Column:
    """Over a tenth control, private-use or replacement characters."""
    chars = F.regexp_replace(text, r"\s+", "")
    return (F.length(chars) > 0) & (F.regexp_count(chars, F.lit(r"[\p{Cc}\p{Co}\x{FFFD}]")) > 0.1 * F.length(chars))


def rtl_balance(text: Column) -> Column:
    """Letters of right-to-left scripts less others."""
    scripts = r"\p{IsArabic}\p{IsHebrew}\p{IsSyriac}\p{IsThaana}\p{IsNko}"
    return 2 * F.regexp_count(text, F.lit(rf"(?=\p{{L}})[{scripts}]")) - F.regexp_count(text, F.lit(r"\p{L}"))


# Kinds of files by extension and type, the first that fits.
FILE_KINDS = [
    ("pdf", "pdf", "application/pdf"),
    ("image", "png jpg jpeg jfif webp gif bmp tif tiff avif heic heif svg", "image/png image/jpeg image/webp image/gif image/bmp image/tiff image/avif image/heic image/heif image/svg+xml"),
    ("text", "txt text log csv tsv md markdown mdown mkd", "text/plain text/markdown text/x-markdown"),
    ("pptx", "pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("legacy-slides", "ppt pps ppsx pot potx key odp", "application/vnd.ms-powerpoint"),
]


def file_kind(name: Column, mime: Column) -> Column:
    """By extension or type."""
    ending, kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)), F.lower(mime)
    return F.coalesce(*(F.when(ending.isin(own.split()) | kind.isin(types.split()), k) for k, own, types in FILE_KINDS), F.lit("other"))


def join_hyphens(text: Column) -> Column:
    """Lines as running text; a hyphen at a line end goes before a small letter."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2"), r"\n", " "))


def _network(text: str | None) -> str | None:
    if text is None:
        return None
    own = text.strip().lower()
    found = re.match(r"\[([^\]%]*)|(\d+(?:\.\d+){3})(?::\d+)?$|([^%]*)", own)
    bare = next((g for g in found.groups() if g is not None), own)
    try:
        address = ipaddress.ip_address(bare)
    except ValueError:
        return re.sub(r":\d+$", "", bare) if bare.count(":") < 2 else bare
    if address.version == 4 or address.ipv4_mapped:
        return str(address if address.version == 4 else address.ipv4_mapped)
    return ":".join(f"{int.from_bytes(address.packed[k : k + 2], 'big'):x}" for k in range(0, 8, 2)) + "::/64"


def normal_ip(ip: Column) -> Column:
    """IPv4 without a port; of IPv6 the first 64 bits; what is neither stays."""
    return F.arrow_udf(lambda c: pa.array([_network(x) for x in c.to_pylist()], pa.string()), StringType())(ip)


def safe_path(path: Column, owner: Column) -> Column:
    """The first folder is the owner's and no part leads up."""
    return (F.split_part(path, F.lit("/"), F.lit(1)) == owner) & (F.instr(path, "..") == 0)


def file_from_disposition(header: Column) -> Column:
    """The file name in a Content-Disposition header; the encoded form wins."""
    encoded = F.try_url_decode(F.regexp_extract(header, r"(?i)filename\*\s*=\s*UTF-8''([^;\s]+)", 1))
    quoted, bare = F.regexp_extract(header, r'(?i)filename\s*=\s*"([^"]*)"', 1), F.regexp_extract(header, r"(?i)filename\s*=\s*([^;\"\s]+)", 1)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (encoded, quoted, bare)))


def result_name(name: Column, mode: Column, pages: Column) -> Column:
    """What a file made of some pages (sorted, from 0) is called: by what was done, or by its pages where they are one run."""
    done = F.create_map(*map(F.lit, ("organize", "-organized", "delete", "-trimmed")))
    ends = F.transform(F.array(F.array_min(pages), F.array_max(pages)), lambda p: (p + 1).cast("string"))
    one_run = F.array_sort(pages) == F.sequence(F.array_min(pages), F.array_max(pages))
    run = F.concat(F.when(F.size(pages) == 1, "-page-").otherwise("-pages-"), F.array_join(F.array_distinct(ends), "-"))
    base = F.nullif(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit(""))
    return F.concat(F.coalesce(base, F.lit("document")), F.coalesce(done[mode], F.when(one_run, run), F.lit("-extracted")), F.lit(".pdf"))


def roman(n: Column) -> Column:
    """1 to 3,999 in small letters."""
    tens = [("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm", "", "", "", "", "", "")]
    digit = lambda k: F.floor(n / 10**k) % 10
    return F.concat(*(F.array(*(F.lit(x) for x in tens[k]))[digit(k).cast("int")] for k in (3, 2, 1, 0)))


# How a numbering scheme ends, and what is written around the number.
NUMBER_FORMS = {"ParenBoth": "(#)", "ParenR": "#)", "Plain": "#", "Minus": "- #"}


def number_label(scheme: Column, n: Column) -> Column:
    """Numbers of a list as its scheme (kind of number, then form) writes them; a full stop where the form is not known."""
    kind = F.regexp_extract(scheme, "^(roman|alpha)(Uc|Lc)", 1)
    number = F.when(kind == "roman", roman(n)).when(kind == "alpha", F.lower(column_name(n - 1))).otherwise(n.cast("string"))
    number = F.when(scheme.rlike("^(roman|alpha)Uc"), F.upper(number)).otherwise(number)
    form = F.regexp_extract(scheme, "^(?:arabic|(?:roman|alpha)(?:Uc|Lc))(" + "|".join(NUMBER_FORMS) + ")", 1)
    around = F.create_map(*(F.lit(x) for pair in NUMBER_FORMS.items() for x in pair))
    return F.replace(F.coalesce(around[form], F.lit("#.")), F.lit("#"), number)


def vbr_level(kbps: Column, channels: Column, he: Column) -> Column:
    """The level from 2 to 6 nearest to 1.4 times the source's bitrate as stereo; the lower on ties; 2 if unknown."""
    target = kbps * F.when(channels == 1, 2).otherwise(1) * F.when(he, 2).otherwise(1) * 1.4
    best = F.array_min(F.array(*(F.struct(F.abs(F.lit(float(VBR_KBPS[v])) - target).alias("d"), F.lit(v).alias("v")) for v in range(2, 7))))["v"]
    return F.when(F.coalesce(kbps, F.lit(0)) > 0, best).otherwise(2)


def _number(code: str | None) -> str | None:
    own = code[:-28] if code and len(code) > 28 else code
    if not own or any(c not in SHORTCODE for c in own):
        return None if own is None or own else "0"
    return str(reduce(lambda n, c: n * 64 + SHORTCODE.index(c), own, 0))


def shortcode_id(code: Column) -> Column:
    """The number that a short code stands for, of any length; null for other characters."""
    return F.arrow_udf(lambda c: pa.array([_number(x) for x in c.to_pylist()], pa.string()), StringType())(code)


def iso_seconds(manifest: Column) -> Column:
    part = lambda k: F.coalesce(F.regexp_extract(manifest, r'mediaPresentationDuration="PT(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?"', k).try_cast("double"), F.lit(0.0))
    return F.nullif(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0.0))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Seconds or an HTTP date; null for anything else."""
    v = F.trim(value)
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(v, "^[A-Za-z]{3}, ", ""), " GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.when(v.rlike(r"^\d{1,6}$"), v.try_cast("long") * 1000).otherwise(F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(now)))


def compose(a: Column, b: Column) -> Column:
    """Affine matrices [a b c d e f]: first b, then a."""
    return F.array(a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5])


def inverted(m: Column) -> Column:
    det = m[0] * m[3] - m[1] * m[2]
    return F.when(det != 0, F.array(m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det))


def placed(width: Column, height: Column, cell_width: Column, cell_height: Column, mode: Column) -> Column:
    """Scale and offset of a page in a cell: fit, fill or none, centred."""
    scale = F.when(mode == "fit", F.least(cell_width / width, cell_height / height)).when(mode == "fill", F.greatest(cell_width / width, cell_height / height)).otherwise(1.0)
    return F.struct(((cell_width - width * scale) / 2).alias("x"), ((cell_height - height * scale) / 2).alias("y"), scale.alias("scale"))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The answer of the first rule whose words are in the text."""
    out = None
    for words, answer in rules:
        cond = F.lower(text).contains(words)
        out = F.when(cond, answer) if out is None else out.when(cond, answer)
    return out.otherwise(otherwise)


def prefix_search(query: Column, text: Column) -> Column:
    """Every word of the query begins some word of the text."""
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.forall(words(query), lambda q: F.exists(words(text), lambda w: F.startswith(w, q)))
