"""Scalar functions on columns; all run inside Spark, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions, mime types and name patterns of the formats.
PDF_MIME = "application/pdf"
OFFICE_KINDS = ("docx", "pptx", "xlsx")
IMAGE_NAMES = r"(?i)\.(jpe?g|jpe|jfif|png|webp|gif|bmp|dib|avif|apng|tif|tiff|ico|svg|heic|heif)$"
ZIP_NAMES = r"(?i)\.zip$"
ZIP_MIMES = r"(?i)^application/(x-)?zip(-compressed)?$"
LEGACY_NAMES = r"(?i)\.(doc|ppt|xls|odt|ods|odp|rtf)$"
OLD_OFFICE_NAMES = r"(?i)\.(docm|dotm|dot|doc|pptm|potm|ppt|xlsm|xltm|xls|csv|ods|odt|odp)$"
MIMES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
HELVETICA_DIGIT = 0.556


def is_pdf(name: Column, mime: Column) -> Column:
    return F.coalesce(mime == PDF_MIME, F.lit(False)) | F.coalesce(name.rlike(r"(?i)\.pdf$"), F.lit(False))


def office_kind(name: Column) -> Column:
    """docx, pptx or xlsx by the last extension of the name before any ? or #; else null."""
    bare = F.lower(F.trim(F.regexp_replace(name, r"[?#].*$", "")))
    ext = F.regexp_extract(bare, r"\.([^.]*)$", 1)
    return F.when(ext.isin(*OFFICE_KINDS), ext)


def is_zip(name: Column, mime: Column) -> Column:
    looks = F.coalesce(name.rlike(ZIP_NAMES), F.lit(False)) | F.coalesce(mime.rlike(ZIP_MIMES), F.lit(False))
    return looks & office_kind(name).isNull()


def is_image(name: Column, mime: Column) -> Column:
    return F.coalesce(mime.rlike("(?i)^image/"), F.lit(False)) | F.coalesce(name.rlike(IMAGE_NAMES), F.lit(False))


def is_legacy_office(name: Column) -> Column:
    return F.coalesce(name.rlike(LEGACY_NAMES), F.lit(False))


def wrong_file_reason(name: Column, mime: Column, wanted: Column) -> Column:
    """Why a file is not of the wanted kind; null if it is. The first reason that holds is given."""
    kind = F.when(is_pdf(name, mime), "pdf").otherwise(office_kind(name))
    return (
        F.when(kind == wanted, F.lit(None).cast("string"))
        .when(kind.isNotNull(), F.concat(F.lit("other:"), kind))
        .when(F.coalesce(name.rlike(ZIP_NAMES), F.lit(False)), "zip")
        .when(F.coalesce(name.rlike(OLD_OFFICE_NAMES), F.lit(False)), "legacy")
        .otherwise("unknown")
    )


# The patterns of the error classes, in the order in which they are tried.
INTERRUPTED = r"(?i)usercancelled|user canceled|operation was aborted"
ERROR_CLASSES = (
    ("password", r"passwordexception|password.?protected|incorrect password|password was not accepted|requires? (?:an? )?open password|encrypted"),
    ("memory", r"out of memory|memory limit|allocation failed|quotaexceeded|array buffer allocation"),
    ("network", r"failed to fetch|networkerror|loading chunk|import\(\).*failed|pdf processing engine"),
    ("invalid", r"invalidpdfexception|missingpdfexception|invalid pdf|malformed|unexpected eof|xref|cross.?reference|pdf header|file is corrupted"),
    ("unsupported", r"unsupported|not supported|decode|encoding|image format|could not read image"),
)
TECHNICAL = r"(?i)^(typeerror|referenceerror|syntaxerror|rangeerror|unknownerror):|\.js:\d+| at (?:async )?[\w$.]+\s*\(|cannot read properties of undefined|is not a function"


def classify_error(name: Column, message: Column) -> Column:
    """The first class whose pattern fits; a short plain message passes through, anything else is generic."""
    raw = F.coalesce(message, F.lit(""))
    both = F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), raw))
    out = F.when((F.coalesce(name, F.lit("")) == "AbortError") | raw.rlike(INTERRUPTED), "interrupted")
    for label, pattern in ERROR_CLASSES:
        out = out.when(both.rlike(pattern), label)
    return out.when((raw != "") & (F.length(raw) <= 220) & ~raw.rlike(TECHNICAL), "passthrough").otherwise("generic")


def explain_error(name: Column, message: Column) -> Column:
    kind = classify_error(name, message)
    advice = {
        "interrupted": "The work was stopped before it ended.",
        "password": "The file is locked by a password.",
        "memory": "The file needs more memory than there is.",
        "network": "A part could not be loaded.",
        "invalid": "The file is damaged or not what its name says.",
        "unsupported": "The file uses something that is not supported.",
        "generic": "Something went wrong with this file.",
    }
    out = F.when(kind == "passthrough", message)
    for label, text in advice.items():
        out = out.when(kind == label, text)
    return out


def looks_like_pdf(content: Column) -> Column:
    """True under 32 bytes (not judged); else the head must be %PDF- and the last 2048 bytes hold %%EOF."""
    size = F.octet_length(content)
    head = F.decode(F.substring(content, 1, 5), "ISO-8859-1")
    tail = F.decode(F.substring(content, -2048, 2048), "ISO-8859-1")
    return (size < 32) | ((head == "%PDF-") & tail.contains("%%EOF"))


def font_style(name: Column) -> Column:
    """Family, bold and italic from a font's name; the patterns are fixed values."""
    n = F.lower(F.coalesce(name, F.lit("")))
    family = F.when(n.rlike("times|serif|roman|georgia|garamond"), "times").when(n.rlike("courier|mono"), "courier").otherwise("helvetica")
    return F.struct(family.alias("family"), n.rlike("bold|black|heavy|semibold").alias("bold"), n.rlike("italic|oblique").alias("italic"))


def fit_page(w: Column, h: Column, page_w: Column, page_h: Column, margin: Column) -> Column:
    """Place of a w x h image on a page: one scale for both sides, centred, margin at most half the page."""
    m = F.greatest(F.lit(0.0), F.least(margin, page_w / 2, page_h / 2))
    scale = F.least(F.greatest(F.lit(1.0), page_w - 2 * m) / w, F.greatest(F.lit(1.0), page_h - 2 * m) / h)
    return F.struct(((page_w - w * scale) / 2).alias("x"), ((page_h - h * scale) / 2).alias("y"), (w * scale).alias("width"), (h * scale).alias("height"))


def clamp_crop(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """The part of a crop rectangle that lies on the image, one pixel at least."""
    left, top = F.greatest(F.lit(0), F.least(x, image_w - 1)), F.greatest(F.lit(0), F.least(y, image_h - 1))
    return F.struct(left.alias("x"), top.alias("y"), F.greatest(F.lit(1), F.least(w, image_w - left)).alias("w"), F.greatest(F.lit(1), F.least(h, image_h - top)).alias("h"))


def clamp_drag(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column, least: int = 32) -> Column:
    """A crop rectangle as it is drawn by hand: never under `least` on a side, and never off the image by more than that."""

    def span(at: Column, size: Column, room: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0), F.least(at, room - least)), F.greatest(F.lit(least), F.least(size, room - at))

    (left, width), (top, height) = span(x, w, image_w), span(y, h, image_h)
    return F.struct(left.alias("x"), top.alias("y"), width.alias("w"), height.alias("h"))


def target_pixels(w: Column, h: Column, longest: int = 4096) -> Column:
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    return F.struct(F.greatest(F.lit(1), F.floor(w * scale + 0.5)).cast("int").alias("w"), F.greatest(F.lit(1), F.floor(h * scale + 0.5)).cast("int").alias("h"))


def format_size(size: Column) -> Column:
    """Bytes as B, whole KB or MB with one decimal, halves up."""
    b = size.cast("long")
    kb = F.floor((2 * b + 1024) / 2048).cast("long")
    tenths = F.floor((20 * b + 1048576) / 2097152).cast("long")
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(mb)


def base_name(path: Column) -> Column:
    """The last part of a path without its extension; document where nothing is left."""
    last = F.element_at(F.split(F.coalesce(path, F.lit("")), r"[\\/]"), -1)
    bare = F.trim(F.regexp_replace(last, r"\.[^.]+$", ""))
    return F.when(bare == "", "document").otherwise(bare)


def _padded(n: Column, width: int) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def page_image_name(name: Column, page: Column, file_no: Column, files: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.pdf$", "")
    safe = F.regexp_replace(F.regexp_replace(bare, r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", "")
    safe = F.when(safe == "", "document").otherwise(safe)
    prefix = F.when(files > 1, F.concat(_padded(file_no, 2), F.lit("-"))).otherwise("")
    return F.concat(prefix, safe, F.lit("-page-"), _padded(page, 3), F.lit(".png"))


def page_file_name(page: Column) -> Column:
    return F.concat(F.lit("page-"), _padded(page, 3), F.lit(".pdf"))


def parse_cell_ref(ref: Column) -> Column:
    """A1-style reference -> (row, col) from 0; null if it is none."""
    letters, digits = F.upper(F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$", 1)), F.regexp_extract(ref, r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$", 2)
    col = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: a * 26 + (F.ascii(c) - 64))
    row = digits.try_cast("int")
    return F.when((letters != "") & (row >= 1), F.struct((row - 1).alias("row"), (col - 1).alias("col")))


def column_name(i: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA; up to three letters."""
    i = i.cast("int")
    last = F.chr((i % 26 + 65).cast("long"))
    middle = F.chr((F.floor(i / 26 - 1) % 26 + 65).cast("long"))
    first = F.chr((F.floor((i - 702) / 676) + 65).cast("long"))
    return F.when(i < 26, last).when(i < 702, F.concat(middle, last)).otherwise(F.concat(first, F.chr((F.floor((i - 702) / 26) % 26 + 65).cast("long")), last))


def dimension_ref(rows: Column, cols: Column) -> Column:
    return F.concat(F.lit("A1:"), column_name(F.greatest(cols, F.lit(1)) - 1), F.greatest(rows, F.lit(1)).cast("string"))


def format_number(raw: Column) -> Column:
    """A number's text: integers as they are, others to 12 significant digits; what is no number stays as it is."""
    value = raw.try_cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    digits = F.format_string("%.11e", value).cast("decimal(38,17)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    in_range = (F.abs(value) >= 1e-6) & (F.abs(value) < 1e15)
    return F.when(value.isNull() | F.isnan(value), raw).when(whole, value.cast("long").cast("string")).when(in_range, plain).otherwise(raw)


def cell_text(raw_type: Column, raw_value: Column, shared: Column) -> Column:
    """A cell's text by its type: s takes the shared string, b TRUE or FALSE, strings stay, the rest are numbers."""
    value = F.coalesce(raw_value, F.lit(""))
    return (
        F.when(raw_type == "s", F.coalesce(shared, F.lit("")))
        .when(raw_type.isin("inlineStr", "str", "e"), value)
        .when(raw_type == "b", F.when(value == "1", "TRUE").otherwise("FALSE"))
        .when(value == "", "")
        .otherwise(format_number(value))
    )


# Signs that are drawn, each known by its place counted from U+E000; spellings of others in
# a Latin font's own characters; what such a font holds beside ASCII and U+00A0 to U+00FF.
DRAWN_FROM = 0xE000
DRAWN = (
    "√∛∜∞≤≥≠≡≈≅∼∝≪≫∑∏∐∫∬⋃⋂⋁⋀∅∂∇∠⊥∥∈∉∋∌∍⊂⊃⊆⊇∪∩∀∃∄∴∵→←↔↑↓⇒⇐⇔↦αβγδεζηθϑικλμνξοπρσςτυφχψω"
    "ΓΔΘΛΞΠΣΦΨΩΑΒΕΖΗΙΚΜΝΟΡΤΥΧ∆ϕϱϖϵϝϒϹϺϜϛ"
)
SPELLED = {
    "ℓ": "l", "ℏ": "h", "ℜ": "R", "ℑ": "I", "ℵ": "infinity", "⌈": "[", "⌉": "]", "⌊": "[", "⌋": "]", "⊤": "T", "⊦": "|-", "⊣": "-|",
    "≜": ":=", "≝": ":=", "≟": "=?", "⋮": "...", "⋯": "...", "⁝": "...", "′": "'", "″": "''", "‴": "'''", "∙": "*", "⋅": "*", "∗": "*",
    "⁄": "/", "∕": "/", "−": "-", "\u3000": " ", "ℝ": "R", "ℕ": "N", "ℤ": "Z", "ℚ": "Q", "ℂ": "C", "∘": "o", "◎": "O", "⊛": "*", "⊚": "O",
}
LATIN_EXTRAS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
# Codes of the Symbol font.
SYMBOL_CODES = {
    0x24: "∃", 0x2C: "¬", 0x41: "Α", 0x42: "Β", 0x44: "Δ", 0x45: "Ε", 0x47: "Γ", 0x48: "Η", 0x49: "Ι", 0x4A: "Θ", 0x4B: "Κ", 0x4C: "Λ", 0x4D: "Μ", 0x4E: "Ν",
    0x50: "Π", 0x52: "Ρ", 0x53: "Σ", 0x54: "Τ", 0x55: "Υ", 0x57: "Ω", 0x58: "Χ", 0x59: "Ψ", 0x5A: "Ζ", 0x5E: "⇒", 0x61: "α", 0x62: "β", 0x63: "χ", 0x64: "δ",
    0x65: "ε", 0x66: "φ", 0x67: "γ", 0x68: "η", 0x69: "ι", 0x6A: "ϑ", 0x6B: "κ", 0x6C: "λ", 0x6D: "μ", 0x6E: "ν", 0x6F: "ο", 0x70: "π", 0x71: "θ", 0x72: "ρ",
    0x73: "σ", 0x74: "τ", 0x75: "υ", 0x77: "ω", 0x78: "ξ", 0x79: "ψ", 0x7A: "ζ", 0x7B: "≡", 0xA0: "∀", 0xA1: "∃", 0xA3: "≤", 0xA5: "∞", 0xAC: "←", 0xAD: "↑",
    0xB3: "≥", 0xB4: "×", 0xB5: "∝", 0xB8: "÷", 0xB9: "≠", 0xBA: "≈", 0xBB: "≡", 0xBC: "…", 0xBD: "∴", 0xBE: "∵", 0xBF: "∝", 0xC0: "↔", 0xC3: "←", 0xC4: "↔",
    0xC5: "↑", 0xC9: "→", 0xCC: "∪", 0xCD: "⊃", 0xCE: "∈", 0xCF: "∉", 0xD0: "→", 0xD1: "↑", 0xD2: "↓", 0xD5: "⊂", 0xD6: "√", 0xDC: "⇒", 0xE3: "⊆", 0xE5: "∑",
    0xE9: "⊇", 0xF0: "¬", 0xF1: "∧", 0xF2: "∫", 0xF7: "∏",
}


def replace_chars(text: Column) -> Column:
    """Drawn signs as their private codes, others that can be spelled as their spelling."""
    single = {c: plain for c, plain in SPELLED.items() if len(plain) == 1}
    marks = "".join(chr(DRAWN_FROM + i) for i in range(len(DRAWN)))
    text = F.translate(text, DRAWN + "".join(single), marks + "".join(single.values()))
    for char, plain in SPELLED.items():
        if len(plain) > 1:
            text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def symbol_char(font: Column, code: Column) -> Column:
    """The character of a Symbol font's hexadecimal code, by its low byte; empty for other fonts and codes."""
    low = F.conv(F.when(code.rlike("^[0-9A-Fa-f]{1,8}$"), code), 16, 10).cast("long").bitwiseAND(F.lit(255)).cast("int")
    table = F.create_map(*[F.lit(x) for pair in SYMBOL_CODES.items() for x in pair])
    return F.when(F.lower(font) == "symbol", F.coalesce(F.try_element_at(table, low), F.lit(""))).otherwise("")


CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
#: What a Latin font lacks by range: 128 to 159 and all above 255, but for private-use E000 to EFFF.
OUTSIDE_LATIN = r"[\x{80}-\x{9F}\x{100}-\x{DFFF}\x{F000}-\x{10FFFF}]"
#: What it lacks exactly.
NOT_DRAWABLE = rf"[^\x00-\x7F\xA0-\xFF\x{{E000}}-\x{{EFFF}}{LATIN_EXTRAS}]"


def sanitize(text: Column, preserve: bool = True) -> Column:
    """(text, lost): controls but tab, line feed and carriage return go.

    With preserve, what a Latin font lacks is kept and counted; without, it is drawn or spelled where
    that can be, and otherwise counted and replaced by ?.
    """
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROLS, "")

    def told(plain: Column, lacks: str, put: str | None) -> Column:
        """The text and its losses; as an element of an array it is made once for both."""
        return F.transform(F.array(plain), lambda t: F.struct((t if put is None else F.regexp_replace(t, lacks, put)).alias("text"), F.regexp_count(t, F.lit(lacks)).alias("lost")))[0]

    return told(clean, OUTSIDE_LATIN, None) if preserve else told(replace_chars(clean), NOT_DRAWABLE, "?")


def xml_escape(text: Column) -> Column:
    text = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROLS, "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def lines_of(text: Column, most: int = 400) -> Column:
    return F.slice(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), 1, most)


def heading_level(style: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(style, F.lit(""))), r"\s+", "")
    return F.when(s == "title", 1).when(s == "subtitle", 2).when(s.rlike("^heading[1-6]$"), F.substring(s, 8, 1).cast("int"))


def heading_style(level: Column) -> Column:
    return F.when(level.between(1, 6), F.concat(F.lit("Heading"), F.floor(level).cast("string"))).otherwise("Heading1")


def align(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.isin("center", "right"), n).when(n.isin("both", "justify"), "both").otherwise("left")


def mime_for(ext: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(ext, F.lit(""))), ";.*$", "")), r"^\.", "")
    out = F.lit("application/octet-stream")
    for name, mime in MIMES.items():
        out = F.when(bare == name, mime).otherwise(out)
    return out


def block_text(text: Column, runs: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), ""), text, F.lit(""))


def natural_key(name: Column) -> Column:
    """Sorts 2.pdf before 10.pdf, whatever the case."""
    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]") & (F.length(p) < 20), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")
