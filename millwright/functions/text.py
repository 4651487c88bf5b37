"""Text rules as column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.common import BLANK_RANGES, BLANKS, let, strip

# ---- fixed values -----------------------------------------------------------
_WORD = r"[\p{L}\p{N}_]"


def _tag(letters: str, digits: str, tail: str) -> str:
    """A tag pattern with Unicode word boundaries spelled out."""
    return rf"(?<!{_WORD})([A-Z]{letters}-\p{{Nd}}{digits}{tail})(?!{_WORD})"


TAG_STRICT = _tag("{1,3}", "{3,4}", "[A-Z]?")
TAG_WIDE = "(?i)" + _tag("{1,4}", "{2,5}", "[A-Z]?")
TAG_VOICE = _tag("{1,3}", "{3,4}", "")
TAG_EXACT = r"^[A-Z]{1,3}-\p{Nd}{3,4}[A-Z]?$"
TAG_IN_BLANKS = rf"^[{BLANK_RANGES}]*+[A-Z]{{1,3}}+-\p{{Nd}}{{3,4}}+[A-Z]?+[{BLANK_RANGES}]*+$"
RELATIONSHIPS = ("feeds_into", "controls", "bypasses", "connected_to", "part_of")

EXTENSION_FORMATS = {
    "pdf": "pdf", "docx": "docx", "doc": "doc", "txt": "txt", "png": "png", "jpg": "jpg", "jpeg": "jpg",
    "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "xlsx": "xlsx", "xls": "xls", "dxf": "dxf", "dwg": "dwg",
    "eml": "eml", "msg": "msg",
}
IMAGE_FORMATS = ("png", "jpg", "jpeg", "tiff", "bmp")

DOCUMENT_TYPES = (
    ("standard", ("oisd", "peso", "standard")),
    ("drawing", ("p&id", "pid", "drawing", "blueprint")),
    ("maintenance_log", ("log", "shift")),
    ("manual", ("manual", "oem")),
    ("procedure", ("procedure", "sop", "maintenance")),
)
VISUAL_FILE_TYPES = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp")
PID_HINTS = ("p&id", "pid", "piping", "instrumentation", "blueprint", "drawing", "valve", "zone")
LOG_HINTS = ("maintenance", "failure", "technician", "inspection", "repair", "work order", "log")

VOICE_KEYWORDS = (
    "inspection", "leak", "vibration", "temperature", "pressure", "noise", "repair", "replace", "corrode", "fail",
    "निरीक्षण", "रिसाव", "कंपन", "तापमान", "दबाव", "मरम्मत",
)
VOICE_CRITICAL = ("critical", "emergency", "urgent", "immediately")
VOICE_MINOR = ("concern", "check", "monitor")
VOICE_ACTION = ("need to", "should", "must", "replace", "repair", "call")
INSPECTION_WORDS = ("inspect", "inspection", "check", "found")
TRANSIENT_MARKERS = (
    "503", "unavailable", "high demand", "rate limit", "resource_exhausted", "temporarily", "timeout", "deadline",
)
REPLY_SUFFIX = "\n[Reply FULL for complete answer]"


def _any(text: Column, words) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


# ---- cleaning and tags ------------------------------------------------------
def clean_text(text: Column) -> Column:
    """Drop NULs, strip lines, squeeze blank lines and runs of spaces."""
    inner = "".join(c for c in BLANKS if c != "\n")
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\x00", "")
    out = F.regexp_replace(out, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n")
    out = F.regexp_replace(out, f"[{inner}]*\n[{inner}]*", "\n")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, "[ \t]{2,}", " ")
    return strip(out)


def tag_occurrences(text: Column, pattern: str = TAG_STRICT) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda x: F.upper(x))


def strict_tags(text: Column) -> Column:
    return F.array_distinct(tag_occurrences(text))


def wide_tags(text: Column) -> Column:
    return F.array_distinct(tag_occurrences(text, TAG_WIDE))


def voice_tags(text: Column) -> Column:
    return F.array_distinct(tag_occurrences(F.upper(text), TAG_VOICE))


def normal_tag(tag: Column) -> Column:
    return F.upper(strip(tag))


def valid_tag(tag: Column) -> Column:
    """Whether the normal form of the tag is one; blanks around it are left to the pattern, which is quicker than to strip them."""
    return F.upper(tag).rlike(TAG_IN_BLANKS)


def sentences(text: Column, ends: str = ".!?") -> Column:
    """Sentences trimmed, empties dropped.  ``ends`` are the closing characters."""
    parts = F.split(text, f"(?<=[{ends}])[{BLANKS}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


CHUNK_SENTENCE_ENDS = ".!?।॥\n"


def language(text: Column) -> Column:
    devanagari = F.length(F.regexp_replace(text, "[^\u0900-\u097f]", ""))
    share = devanagari / F.greatest(F.length(text), F.lit(1))
    return F.when(share > 0.10, "hi").otherwise("en")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


# ---- classification ---------------------------------------------------------
def _head(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def document_type(filename: Column, text: Column, max_chars: int | None = 1000) -> Column:
    """Kind of document by words in its name and the head of its text (None: the whole text)."""
    combined = F.lower(F.concat(filename, F.lit(" "), _head(text, max_chars)))
    result = F.lit("document")
    for kind, words in reversed(DOCUMENT_TYPES):
        result = F.when(_any(combined, words), kind).otherwise(result)
    return result


def extraction_kind(
    filename: Column, file_type: Column, text: Column, requested: Column, max_chars: int | None = 4000
) -> Column:
    """Which structured extraction a document gets, by its name and the head of its text (None: all); a request wins."""
    haystack = F.lower(F.concat(filename, F.lit("\n"), _head(text, max_chars)))
    hits = lambda words: sum((haystack.contains(w).cast("int") for w in words), F.lit(0))
    pid, log = hits(PID_HINTS), hits(LOG_HINTS)
    return (
        F.when(requested.isin("pid", "maintenance_log", "none"), requested)
        .when(~F.lower(file_type).isin(*VISUAL_FILE_TYPES), "none")
        .when((pid == 0) & (log == 0), "none")
        .when(pid >= log, "pid")
        .otherwise("maintenance_log")
    )


def error_class(message: Column) -> Column:
    return F.when(_any(F.lower(message), TRANSIENT_MARKERS), "transient").otherwise("permanent")


# ---- field notes and messages ----------------------------------------------
def voice_knowledge(text: Column) -> Column:
    """Tags, keywords, severity hint and action flag of a spoken or typed note."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.lower(text)
    keywords = F.filter(
        F.array(*[F.lit(k) for k in VOICE_KEYWORDS]), lambda k: F.contains(lowered, k) | F.contains(text, k)
    )
    severity = F.when(_any(lowered, VOICE_CRITICAL), "critical").when(_any(lowered, VOICE_MINOR), "minor").otherwise("routine")
    return F.struct(
        voice_tags(text).alias("equipment_tags"),
        keywords.alias("keywords"),
        severity.alias("severity_hint"),
        _any(lowered, VOICE_ACTION).alias("has_action_item"),
    )


def language_hint(hint: Column) -> Column:
    cleaned = F.lower(strip(hint))
    return F.when(cleaned.isNull() | cleaned.isin("", "auto"), None).when(cleaned.isin("hi", "hindi"), "hi").otherwise(cleaned)


def labeled_field(text: Column, name: str, default: str) -> Column:
    found = F.regexp_extract(text, rf"(?is){name}:\s*(.*?)(?=\n[A-Z_]+:|\z)", 1)
    return F.coalesce(F.nullif(F.btrim(strip(found), F.lit("[]")), F.lit("")), F.lit(default))


def stated_confidence(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)\[Confidence:\s*(High|Medium|Low)\]", 1)
    return F.when(found == "", "Medium").otherwise(F.initcap(found))


def chat_message(answer: Column) -> Column:
    """Markdown toned down for a chat channel, cut at a sentence end past 1500 characters."""
    text = F.regexp_replace(answer, r"(?d)\*\*(.*?)\*\*", "*$1*")
    return let(strip(F.regexp_replace(text, r"(?md)^#+\s*", "")), _shortened)


def _shortened(text: Column) -> Column:
    head = F.substring(text, 1, 1450)
    whole = F.regexp_extract(head, "(?s)^(.*[.?!।])", 1)
    cut = F.when(F.length(whole) > 501, whole).otherwise(head)
    return F.when(F.length(text) <= 1500, text).otherwise(F.concat(strip(cut), F.lit(REPLY_SUFFIX)))


def message_route(body: Column) -> Column:
    command = F.upper(strip(body))
    return (
        F.when(command == "", "empty")
        .when(command.isin("HELP", "STATUS", "RISK"), F.lower(command))
        .otherwise("question")
    )


def sender_session(sender: Column) -> Column:
    return F.substring(F.md5(sender.cast("binary")), 1, 12)


def masked_sender(sender: Column) -> Column:
    return F.when(F.length(sender) <= 4, "****").otherwise(
        F.concat(F.substring(sender, F.lit(1), F.length(sender) - 4), F.lit("****"))
    )


# ---- file names -------------------------------------------------------------
def base_name(path: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)
    return F.when(name == ".", "").otherwise(name)


def extension(path: Column) -> Column:
    """Lower-cased suffix without its dot; a leading dot alone is no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]+)$", 1))


def extension_format(path: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in EXTENSION_FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, extension(path)), F.lit("unknown"))


def upload_type(path: Column) -> Column:
    family = extension_format(path)
    return F.when(family.isin(*IMAGE_FORMATS), "image").when(family == "doc", "docx").otherwise(family)


def secure_filename(path: Column, fallback: str = "upload.bin") -> Column:
    kept = F.regexp_replace(F.replace(base_name(path), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}._-]", "")
    return F.when(kept == "", fallback).otherwise(kept)


def upload_verdict(path: Column, size: Column, max_mb: int = 50) -> Column:
    """Empty text for an acceptable upload, else the reason against it."""
    ext = extension(path)
    shown = F.when(ext == "", "unknown").otherwise(ext)
    return (
        F.when(~ext.isin(*EXTENSION_FORMATS), F.concat(F.lit("Unsupported file type: "), shown))
        .when(size > max_mb * 1024 * 1024, f"File exceeds maximum size of {max_mb} MB")
        .otherwise("")
    )
