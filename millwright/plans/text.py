"""Named text-rule queries and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions import dates, scoring
from millwright.functions import text as tx
from millwright.functions.common import join_lines
from millwright.plans.registry import CHECKS, query
from millwright.plans.views import CHECK_FRAGMENTS


def duck_tags(text: str, pattern: str, upper: bool = True) -> str:
    found = f"regexp_extract_all({text}, '{pattern}', 1)"
    if upper:
        found = f"list_transform({found}, lambda x: upper(x))"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


STRICT = r"\b([A-Z]{1,3}-\d{3,4}[A-Z]?)\b"
WIDE = r"(?i)\b([A-Z]{1,4}-\d{2,5}[A-Z]?)\b"
VOICE = r"\b([A-Z]{1,3}-\d{3,4})\b"


def duck_sentences(text: str, ends: str = ".!?") -> str:
    marked = f"regexp_replace({text}, '([{ends}])\\s+', '\\1' || chr(1), 'g')"
    cut = f"string_split({marked}, chr(1))"
    trimmed = f"list_transform({cut}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda s: s <> '')"


def duck_strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def duck_clean(text: str) -> str:
    out = f"regexp_replace({text}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')"
    return duck_strip(out)


def contains_case(column: str, table, default: str) -> str:
    arms = " ".join(
        "when " + " or ".join(f"contains({column}, '{w}')" for w in words) + f" then '{kind}'" for kind, words in table
    )
    return f"case {arms} else '{default}' end"


CHECK_FRAGMENTS.update(
    x_messy="""
        select id, '  ' || replace(replace(text, '. ', '.  ' || chr(9) || ' '), chr(10), ' ' || chr(10) || chr(10) || chr(9) || chr(10)) || ' ' as text
        from v_documents""",
)


@query("clean_text", f"select id, md5({duck_clean('text')}) as digest, length({duck_clean('text')}) as n from x_messy")
def _(t):
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(".  \t "))
    messy = F.concat(F.lit("  "), F.replace(spaced, F.lit("\n"), F.lit(" \n\n\t\n")), F.lit(" "))
    cleaned = t.documents.select("id", tx.clean_text(messy).alias("text"))
    return cleaned.select("id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n"))


@query("extract_tags_strict", f"select id, array_to_string({duck_tags('text', STRICT)}, '|') as tags from v_documents")
def _(t):
    return t.documents.select("id", join_lines(tx.strict_tags(F.col("text"))).alias("tags"))


@query("extract_tags_wide", f"select id, array_to_string({duck_tags('text', WIDE)}, '|') as tags from v_documents")
def _(t):
    return t.documents.select("id", join_lines(tx.wide_tags(F.col("text"))).alias("tags"))


@query("extract_tags_voice", f"select capture_id, array_to_string({duck_tags('upper(text)', VOICE)}, '|') as tags from v_captures")
def _(t):
    return t.captures.select("capture_id", join_lines(tx.voice_tags(F.col("text"))).alias("tags"))


@query(
    "split_sentences",
    f"""select id, len({duck_sentences('text')}) as n, md5(array_to_string({duck_sentences('text')}, '|')) as digest,
               len({duck_sentences('text', tx.CHUNK_SENTENCE_ENDS)}) as chunker_n
        from v_documents""",
)
def _(t):
    plain = tx.sentences(F.col("text"))
    return t.documents.select(
        "id",
        F.size(plain).cast("long").alias("n"),
        F.md5(join_lines(plain).cast("binary")).alias("digest"),
        F.size(tx.sentences(F.col("text"), tx.CHUNK_SENTENCE_ENDS)).cast("long").alias("chunker_n"),
    )


@query(
    "detect_language",
    """select capture_id as id, case when length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g'))::double
                                        / greatest(length(text), 1) > 0.10 then 'hi' else 'en' end as language from v_captures
       union all
       select id, case when length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g'))::double
                            / greatest(length(text), 1) > 0.10 then 'hi' else 'en' end from v_documents""",
)
def _(t):
    return t.captures.select(F.col("capture_id").alias("id"), tx.language(F.col("text")).alias("language")).unionByName(
        t.documents.select("id", tx.language(F.col("text")).alias("language"))
    )


@query("estimate_tokens", "select id, length(text) // 4 as tokens from v_documents")
def _(t):
    return t.documents.select("id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    "classify_document",
    f"""select id, {contains_case("lower(original_filename || ' ' || text[1:1000])", tx.DOCUMENT_TYPES, "document")} as document_type
        from v_documents""",
)
def _(t):
    return t.documents.select("id", tx.document_type(F.col("original_filename"), F.col("text")).alias("document_type"))


@query("classify_document_whole", CHECKS["classify_document"].replace("[1:1000]", ""))
def _(t):
    return t.documents.select("id", tx.document_type(F.col("original_filename"), F.col("text"), None).alias("document_type"))


def _hits(words) -> str:
    return "(" + " + ".join(f"contains(h, '{w}')::int" for w in words) + ")"


@query(
    "classify_extraction",
    f"""select id, case when requested in ('pid', 'maintenance_log', 'none') then requested
                        when file_type not in ('pdf', 'png', 'jpg', 'jpeg', 'tiff', 'bmp') then 'none'
                        when {_hits(tx.PID_HINTS)} = 0 and {_hits(tx.LOG_HINTS)} = 0 then 'none'
                        when {_hits(tx.PID_HINTS)} >= {_hits(tx.LOG_HINTS)} then 'pid' else 'maintenance_log' end as kind
        from (select *, lower(original_filename || chr(10) || text[1:4000]) as h,
                     case status when 'failed' then 'pid' when 'processing' then 'maintenance_log'
                                 when 'cancelled' then 'none' else 'auto' end as requested
              from v_documents)""",
)
def _(t):
    return _kinds(t, 4000)


@query("classify_extraction_whole", CHECKS["classify_extraction"].replace("[1:4000]", ""))
def _(t):
    return _kinds(t, None)


def _kinds(t, max_chars):
    requested = (
        F.when(F.col("status") == "failed", "pid")
        .when(F.col("status") == "processing", "maintenance_log")
        .when(F.col("status") == "cancelled", "none")
        .otherwise("auto")
    )
    return t.documents.select(
        "id", tx.extraction_kind(F.col("original_filename"), F.col("file_type"), F.col("text"), requested, max_chars).alias("kind")
    )


_DATE_FORMATS = (
    "['%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%m-%d-%Y', '%b %Y', '%B %Y', '%Y']"
)


def duck_date(raw: str) -> str:
    year = f"case when regexp_full_match({raw}, '\\d{{2}}/\\d{{2}}/\\d{{2}}') then {raw}[1:6] || '20' || {raw}[7:8] else {raw} end"
    return (
        f"case when regexp_full_match({raw}, '[A-Za-z]+ \\d{{4}}|\\d{{4}}|\\d{{1,4}}[/-]\\d{{1,2}}[/-]\\d{{1,4}}')"
        f" then try_strptime({year}, {_DATE_FORMATS}) end"
    )


def duck_review_date(text: str) -> str:
    parts = []
    for pattern in dates.REVIEW_PATTERNS:
        raw = f"nullif(regexp_extract({text}, '{pattern}', 1), '')"
        parts.append(duck_date(f"({raw})"))
    return f"coalesce({', '.join(parts)})"


@query("parse_review_date", f"select id, {duck_review_date('text')} as review_date from v_documents")
def _(t):
    return t.documents.select("id", dates.stated_review_date(F.col("text")).alias("review_date"))


@query(
    "voice_knowledge",
    f"""select capture_id, array_to_string({duck_tags('upper(text)', VOICE)}, '|') as tags,
               array_to_string(list_filter([{", ".join(f"'{k}'" for k in tx.VOICE_KEYWORDS)}],
                    lambda k: contains(lower(text), k) or contains(text, k)), '|') as keywords,
               {contains_case('lower(text)', (('critical', tx.VOICE_CRITICAL), ('minor', tx.VOICE_MINOR)), 'routine')} as severity_hint,
               {" or ".join(f"contains(lower(text), '{w}')" for w in tx.VOICE_ACTION)} as has_action_item
        from v_captures""",
)
def _(t):
    return t.captures.select("capture_id", tx.voice_knowledge(F.col("text")).alias("k")).select(
        "capture_id",
        join_lines(F.col("k.equipment_tags")).alias("tags"),
        join_lines(F.col("k.keywords")).alias("keywords"),
        "k.severity_hint",
        "k.has_action_item",
    )


def duck_field(name: str, default: str, text: str = "verdict_text") -> str:
    raw = f"regexp_extract({text}, '(?is){name}:\\s*(.*?)(?:\\n[A-Z_]+:|\\z)', 1)"
    return f"coalesce(nullif(trim({duck_strip(raw)}, '[]'), ''), '{default}')"


@query(
    "parse_labeled_fields",
    f"""select document_id, {duck_field('STATUS', 'INSUFFICIENT_INFORMATION')} as status,
               {duck_field('FINDINGS', '')} as findings, {duck_field('RECOMMENDATION', '')} as recommendation
        from v_verdicts""",
)
def _(t):
    text = F.col("verdict_text")
    return t.verdicts.select(
        "document_id",
        tx.labeled_field(text, "STATUS", "INSUFFICIENT_INFORMATION").alias("status"),
        tx.labeled_field(text, "FINDINGS", "").alias("findings"),
        tx.labeled_field(text, "RECOMMENDATION", "").alias("recommendation"),
    )


DUCK_CONFIDENCE = (
    r"coalesce(nullif(upper(regexp_extract(answer, '(?i)\[Confidence:\s*(High|Medium|Low)\]', 1))[1:1]"
    r" || lower(regexp_extract(answer, '(?i)\[Confidence:\s*(High|Medium|Low)\]', 1))[2:], ''), 'Medium')"
)


@query("stated_confidence", f"select question_id, {DUCK_CONFIDENCE} as confidence from v_answers")
def _(t):
    return t.answers.select("question_id", tx.stated_confidence(F.col("answer")).alias("confidence"))


@query(
    "confidence_score_map",
    """with s as (select id, confidence as c, coalesce(channel, '') <> '' as src,
                         case when confidence >= 0.8 then 'High' when confidence >= 0.5 then 'medium' when confidence is null then null else 'LOW' end as label
                  from v_query_logs)
       select id, case label when 'High' then 0.9::double when 'Low' then 0.3::double else 0.6::double end as stored,
              case when src then p else least(p, 35) end as percent_of_label,
              case when src then q else least(q, 35) end as percent_of_number
       from (select *, case when lower(label) = 'high' then 96 when lower(label) = 'low' then 45 else 72 end as p,
                    greatest(0, least(100, round_even(coalesce(c, 55.5) * case when coalesce(c, 55.5) <= 1 then 100 else 1 end, 0)::int)) as q
             from s)""",
)
def _(t):
    c = F.col("confidence")
    label = F.when(c >= 0.8, "High").when(c >= 0.5, "medium").when(c.isNull(), None).otherwise("LOW")
    sources = F.coalesce("channel", F.lit("")) != ""
    return t.query_logs.select(
        "id",
        scoring.stored_confidence(F.coalesce(label, F.lit(""))).alias("stored"),
        scoring.percent_of_label(label, sources).alias("percent_of_label"),
        scoring.percent_of_number(F.coalesce(c, F.lit(55.5)), sources).alias("percent_of_number"),
    )


@query(
    "message_format",
    f"""select id, case when length(f) <= 1500 then f else {duck_strip(
        "(case when length(regexp_extract(f[1:1450], '(?s)^(.*[.?!।])', 1)) > 501 then regexp_extract(f[1:1450], '(?s)^(.*[.?!।])', 1) else f[1:1450] end)")}
              || chr(10) || '[Reply FULL for complete answer]' end as message
        from (select id, {duck_strip("regexp_replace(regexp_replace('# Result' || chr(10) || '## **' || original_filename || '** note' || chr(10) || text, '[*][*](.*?)[*][*]', '*' || chr(92) || '1*', 'g'), '(?m)^#+[ ]*', '', 'g')")} as f
              from v_documents)""",
)
def _(t):
    answer = F.concat(F.lit("# Result\n## **"), "original_filename", F.lit("** note\n"), "text")
    return t.documents.select("id", tx.chat_message(answer).alias("message"))


@query(
    "pseudonymise_sender",
    """select id, md5(sender)[1:12] as session_id, case when length(sender) <= 4 then '****'
              else sender[1:length(sender) - 4] || '****' end as masked
       from (select id, coalesce(channel, '') || session_id as sender from v_query_logs where session_id is not null)""",
)
def _(t):
    sender = F.concat(F.coalesce("channel", F.lit("")), "session_id")
    return t.query_logs.where("session_id is not null").select(
        "id", tx.sender_session(sender).alias("session_id"), tx.masked_sender(sender).alias("masked")
    )


@query(
    "route_message",
    """select id, case when upper(trim(b)) = '' then 'empty' when upper(trim(b)) in ('HELP', 'STATUS', 'RISK')
                       then lower(trim(b)) else 'question' end as route
       from (select id, case channel when 'web' then ' help ' when 'whatsapp' then 'Risk' when '' then '  ' else question end as b from v_query_logs)""",
)
def _(t):
    body = (
        F.when(F.col("channel") == "web", " help ").when(F.col("channel") == "whatsapp", "Risk")
        .when(F.col("channel") == "", "  ").otherwise(F.col("question"))
    )
    return t.query_logs.select("id", tx.message_route(body).alias("route"))


@query(
    "friendly_error_class",
    f"""select document_id, updated_at, message, case when {" or ".join(f"contains(lower(m), '{w}')" for w in tx.TRANSIENT_MARKERS)} then 'transient' else 'permanent' end as error_class
        from (select *, case status when 'failed' then message || ' Rate Limit hit' when 'running' then 'Deadline: ' || message else message end as m from v_stage_events)""",
)
def _(t):
    message = (
        F.when(F.col("status") == "failed", F.concat("message", F.lit(" Rate Limit hit")))
        .when(F.col("status") == "running", F.concat(F.lit("Deadline: "), "message"))
        .otherwise(F.col("message"))
    )
    return t.stage_events.select("document_id", "updated_at", "message", tx.error_class(message).alias("error_class"))


@query(
    "confidence_band",
    """select id, case when coalesce(confidence, 0.45) >= 0.75 then 'High' when coalesce(confidence, 0.45) >= 0.45 then 'Medium' else 'Low' end as shown,
              case when a like '%low%' or a like '%pending%' then 'low' when a like '%medium%' or a like '%warning%' then 'medium'
                   when a like '%high%' or a like '%healthy%' or a like '%reviewed%' then 'high' else '' end as band
       from (select *, case channel when 'web' then 'highly pending' when 'whatsapp' then 'warning' when '' then 'reviewed' else '' end as a from v_query_logs)""",
)
def _(t):
    attribute = (
        F.when(F.col("channel") == "web", "Highly PENDING").when(F.col("channel") == "whatsapp", "Warning")
        .when(F.col("channel") == "", "reviewed")
    )
    return t.query_logs.select(
        "id",
        scoring.shown_confidence(F.coalesce("confidence", F.lit(0.45))).alias("shown"),
        scoring.attribute_band(attribute).alias("band"),
    )


@query(
    "normalise_lang_hint",
    """select id, case when h is null or h in ('', 'auto') then null when h in ('hi', 'hindi') then 'hi' else h end as hint
       from (select id, lower(trim(case lang when 'en' then ' Hindi ' when 'fr' then 'AUTO' when 'de' then null else lang end)) as h from v_documents)""",
)
def _(t):
    raw = (
        F.when(F.col("lang") == "en", " Hindi ").when(F.col("lang") == "fr", "AUTO").when(F.col("lang") == "de", None)
        .otherwise(F.col("lang"))
    )
    return t.documents.select("id", tx.language_hint(raw).alias("hint"))


DUCK_SUFFIX = r"lower(regexp_extract(regexp_extract(regexp_replace(name, '/+$', ''), '([^/]*)$', 1), '^.+\.([^.]+)$', 1))"
_EXT = ", ".join(f"'{e}'" for e in tx.EXTENSION_FORMATS)


@query(
    "ingest_manifest",
    f"""select name, size_bytes, reason = '' as accepted, reason
        from (select *, case when e not in ({_EXT}) then 'Unsupported file type: ' || case when e = '' then 'unknown' else e end
                             when size_bytes > 50 * 1024 * 1024 then 'File exceeds maximum size of 50 MB' else '' end as reason
              from (select *, {DUCK_SUFFIX} as e from v_files))""",
)
def _(t):
    return t.files.select("name", "size_bytes", tx.upload_verdict(F.col("name"), F.col("size_bytes")).alias("reason")).select(
        "name", "size_bytes", (F.col("reason") == "").alias("accepted"), "reason"
    )


@query(
    "upload_type",
    f"""select name, case when e in ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp') then 'image' when e in ('doc', 'docx') then 'docx'
                          when e in ({_EXT}) then e else 'unknown' end as upload_type
        from (select *, {DUCK_SUFFIX} as e from v_files)""",
)
def _(t):
    return t.files.select("name", tx.upload_type(F.col("name")).alias("upload_type"))


@query(
    "secure_filename",
    r"""select name, case when s = '' then 'upload.bin' else s end as safe_name
        from (select name, regexp_replace(replace(regexp_extract(name, '([^/]*)$', 1), ' ', '_'), '[^\p{L}\p{N}._-]', '', 'g') as s from v_files)""",
)
def _(t):
    return t.files.select("name", tx.secure_filename(F.col("name")).alias("safe_name"))


@query(
    "validate_tag",
    r"""select src, rel, dst, regexp_full_match(upper(trim(src)), '[A-Z]{1,3}-\d{3,4}[A-Z]?') as src_ok,
               regexp_full_match(upper(trim(dst)), '[A-Z]{1,3}-\d{3,4}[A-Z]?') as dst_ok,
               rel in ('feeds_into', 'controls', 'bypasses', 'connected_to', 'part_of') as rel_ok
        from (select ' ' || lower(src) as src, rel, dst from v_edges union all select * from v_rule_edges)""",
)
def _(t):
    edges = t.edges.withColumn("src", F.concat(F.lit(" "), F.lower("src"))).unionByName(t.rule_edges)
    return edges.select(
        "src", "rel", "dst", tx.valid_tag(F.col("src")).alias("src_ok"), tx.valid_tag(F.col("dst")).alias("dst_ok"),
        F.col("rel").isin(*tx.RELATIONSHIPS).alias("rel_ok"),
    )


@query(
    "source_freshness_label",
    """select id, case when s is null then 'Not returned' when p >= 80 then p || '% fresh' when p >= 60 then p || '% review soon'
                       else p || '% stale - review' end as label
       from (select id, s, floor(case when s <= 1 then s * 100 else s end + 0.5)::bigint as p
             from (select id, confidence as s from v_query_logs union all select id, file_size_bytes % 101 + 0.5::double from v_documents))""",
)
def _(t):
    scores = t.query_logs.select("id", F.col("confidence").alias("s")).unionByName(
        t.documents.select("id", (F.col("file_size_bytes") % 101 + F.lit(0.5)).alias("s"))
    )
    return scores.select("id", scoring.source_freshness_label(F.col("s")).alias("label"))
