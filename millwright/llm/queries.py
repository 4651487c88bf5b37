"""Queries over the test tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import (
    decontaminate, divergence, licenses, linededup, minhash, neighbors, packing, pii, quality, sharding, simhash, targeting, urlfilter,
)
from millwright.llm.common import free_name, hex16
from millwright.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(prepare(spark), folder)
        if check is not None:
            CHECKS[name] = check
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_simhash")
def op2(spark, folder):
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


@query("op4_winnowing")
def op4(spark, folder):
    found = decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), {"doc_id": F.col("doc_id")}
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_line_dedup", check=r"""
with lines as (
  select doc_id, unnest(split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(split(coalesce(text, ''), chr(10)), 1) as place
  from documents),
keyed as (
  select doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(common.k) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where common.k is null), '')) as kept_sha256
from keyed left join common on keyed.k = common.k
group by doc_id
""")
def op9(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    index = linededup.build_index(docs)
    return linededup.drop_common_lines(docs, index).select(
        "doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_sha256"
    )


@query("op5_best_fit_packing")
def op5(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.pack(docs, packing.word_count("text"), {"doc_id": F.col("doc_id")})


@query("op6_lpt_shards")
def op6(spark, folder):
    carry = {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}
    shards = sharding.shard_documents(table(spark, folder, "documents"), carry)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_skip_chain_pii")
def op8(spark, folder):
    found = pii.personal_data(table(spark, folder, "documents"), {"doc_id": F.col("doc_id")})
    counts = [_spans_of(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans")
    )


@query("op7_importance_resampling")
def op7(spark, folder):
    docs = labelled_documents(spark, folder, table(spark, folder, "documents"))
    _, least, scored = quality.resample(docs, "target")
    kept = scored.where(F.lit(False) if least is None else F.col("sample_key") >= least)
    return kept.select("doc_id", "log_weight", "sample_key", F.lit(True).alias("kept"))


def labelled_documents(spark, folder, docs: DataFrame) -> DataFrame:
    """``docs`` marked for the quality model by ``labels``: good and not toxic is the target, toxic is unwanted."""
    labels = table(spark, folder, "labels")
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    good, bad = (quality.labelled_target(labels, which) for which in ((F.col("quality") == 1) & ~toxic, toxic))
    return quality.with_target(docs, good, quality_mark(docs), unwanted=bad)


def quality_mark(docs: DataFrame) -> str:
    return free_name(docs, "target")


def _spans_of(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


# Captures and list histories derived from ``pages``: a fetch time from the page id; for every site (last three
# labels of a host) a block rule that comes, goes and for half of them comes back; for a third of the hosts an
# allow rule; for a quarter of the (host, first path segment) pairs a block rule on the path.
_CAPTURES = """
select page_id, url, {stamp} + {seconds} as fetched_at from {pages}
"""
_ENTRIES = """
with hosts as (
  select distinct lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/:?#@]*)', 2)) as host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) as seg
  from {pages} where url is not null),
sites as (select distinct regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) as pattern from hosts),
marked as (
  select 'abuse' as list, 'block' as kind, pattern, md5(pattern) as m from sites where pattern <> ''
  union all select 'press', 'allow', host, md5(host) from (select distinct host from hosts) as h where host <> ''
  union all select 'spam', 'block', concat(host, '/', seg), md5(concat(host, '/', seg)) from hosts where host <> '' and seg <> ''),
drawn as (select list, kind, pattern, {a} as a, {b} as b, {c} as c from marked),
chosen as (select * from drawn where list = 'abuse' or (list = 'press' and c % 3 = 0) or (list = 'spam' and c % 4 = 0)),
steps as (
  select list, kind, pattern, 'add' as action, a % 200 as days from chosen
  union all select list, kind, pattern, 'remove', a % 200 + 20 + b % 90 from chosen where b % 5 <> 0
  union all select list, kind, pattern, 'add', a % 200 + 130 from chosen where c % 2 = 0)
select list, kind, pattern, action, {stamp} + {days} as dated from steps
"""
_SPARK_WORDS = {
    "pages": "{pages}", "stamp": "timestamp_ntz'2024-01-01 00:00:00'", "seconds": "make_dt_interval(0, 0, 0, pmod(page_id * 7919 * 60, 31536000))",
    "days": "make_dt_interval(days, 0, 0, 0)",
    **{n: f"cast(conv(substr(m, {i}, 4), 16, 10) as int)" for n, i in (("a", 1), ("b", 5), ("c", 9))},
}
_DUCK_WORDS = {
    "pages": "pages", "stamp": "timestamp '2024-01-01 00:00:00'", "seconds": "to_seconds((page_id * 7919 * 60) % 31536000)",
    "days": "to_days(days)", **{n: f"cast('0x' || substr(m, {i}, 4) as int)" for n, i in (("a", 1), ("b", 5), ("c", 9))},
}


@query("op1_url_filter", check=f"""
with captures as ({_CAPTURES.format(**_DUCK_WORDS)}),
entries as ({_ENTRIES.format(**_DUCK_WORDS)}),
states as (select list, kind, pattern, dated, max(action) = 'add' as is_on from entries group by all),
turns as (
  select *, lag(is_on, 1, false) over (partition by list, kind, pattern order by dated) as was from states
  qualify is_on <> was),
spans as (
  select list, kind, pattern, is_on, dated as since,
         lead(dated) over (partition by list, kind, pattern order by dated) as until from turns),
parts as (
  select page_id, url, fetched_at,
         nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/:?#@]*)', 2)), '') as host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) as path
  from captures),
met as (
  select p.page_id, s.* from parts p join spans s
    on s.is_on and s.since <= p.fetched_at and (s.until is null or p.fetched_at < s.until)
   and (p.host = s.pattern or ends_with(p.host, '.' || s.pattern) or
        (contains(s.pattern, '/') and starts_with(p.host || p.path || '/', s.pattern || '/')))),
best as (
  select *, count(*) over (partition by page_id) as n,
         row_number() over (partition by page_id order by length(pattern) desc, kind, list) as rank from met)
select p.page_id, p.fetched_at, p.host, coalesce(b.n, 0) as n_active,
       coalesce(b.kind, case when p.host is null then 'no host' else 'none' end) as decision, b.list, b.pattern, b.since
from parts p left join best b on b.page_id = p.page_id and b.rank = 1
""")
def op1(spark, folder):
    sql = lambda text: spark.sql(text.format(**_SPARK_WORDS), pages=table(spark, folder, "pages"))
    judged = urlfilter.judge(sql(_CAPTURES), sql(_ENTRIES))
    return judged.select("page_id", "fetched_at", "verdict.*")


@query("op3_cross_polytope")
def op3(spark, folder):
    return neighbors.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op10_license_scan")
def op10(spark, folder):
    # a tree of source / project / folder / file; every tenth document stands as a license file of its project
    project = F.concat_ws("/", "source", F.concat(F.lit("p"), F.pmod(F.floor(F.col("doc_id") / 10), F.lit(97))))
    name = F.when(F.pmod("doc_id", F.lit(10)) == 0, F.concat(F.lit("LICENSE-"), "doc_id")).otherwise(
        F.concat(F.lit("d"), F.pmod("doc_id", F.lit(7)), F.lit("/"), "doc_id", F.lit(".txt"))
    )
    files = table(spark, folder, "documents").select("doc_id", F.concat_ws("/", project, name).alias("path"), "text")
    return licenses.scan(files, carry=("doc_id",))


@query("op11_minhash", check=r"""
with recursive words as (
  select row_number() over () as row_id, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
sets as materialized (
  select doc_id, list_sort(list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                    when len(w) = 1 then w else [] end)) as s
  from words),
classes as materialized (select min(doc_id) as least, s, len(s) as n from sets where len(s) > 0 group by s),
singles as materialized (select least, n, unnest(s) as x from classes),
links as materialized (
  select a.least as a, b.least as b from singles a join singles b
    on a.x = b.x and a.least < b.least and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.least, b.least, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (
  select least as a, least as b from classes
  union
  select r.a, case when l.a = r.b then l.b else l.a end from reach r join links l on l.a = r.b or l.b = r.b),
roots as (select a as least, min(b) as component_id from reach group by 1)
select sets.doc_id, len(sets.s)::bigint as n_shingles, coalesce(component_id, sets.doc_id) as component_id,
       coalesce(component_id, sets.doc_id) = sets.doc_id as kept
from sets left join classes on classes.s = sets.s left join roots on roots.least = classes.least
""")
def op11(spark, folder):
    groups = minhash.near_duplicates(table(spark, folder, "documents"), size=2)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# CRC-32 in SQL: its table from the rule, then one look-up a byte.
_CRC32 = """
crc_table as materialized (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, _: xor(c >> 1, 3988292384 * (c & 1))) order by i) as t
  from range(256) as r(i)),
crc as materialized (
  select term, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(term)) + 1),
                     lambda i: ('0x' || substr(hex(encode(term)), 2 * i - 1, 2))::bigint)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from (select distinct term from uses), crc_table)"""


@query("op12_target_resampling", check=rf"""
with texts as (
  select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
uses as materialized (
  select side, id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from texts),
{_CRC32},
counted as materialized (
  select crc % 10000 as bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t
  from uses join crc using (term) group by 1),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint as gain
  from counted),
weights as (
  select id, count(*) as n_features, sum(gain)::bigint as weight
  from uses join crc using (term) join gains on gains.bucket = crc % 10000 where side = 0 group by id),
scored as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents left join weights on id = doc_id),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from scored where n_features >= 20)
select s.*, p.rank from scored s left join placed p on p.doc_id = s.doc_id and p.rank <= 10 * p.n // 100
""")
def op12(spark, folder):
    drawn = targeting.resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_source_divergence", check=r"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
terms as (
  select row_id, lang, source, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs),
kept as materialized (select lang, term, count(*) as n from terms group by all having count(distinct row_id) >= 30),
own as materialized (select lang, source, term, count(*) as n from terms semi join kept using (lang, term) group by all),
groups as materialized (select distinct lang, source from docs),
langs as (select lang, count(*) as v, sum(n) as n from kept group by 1),
sizes as (select lang, source, coalesce(sum(n), 0) as n from groups left join own using (lang, source) group by all),
shares as materialized (
  select g.lang, g.source, k.term, coalesce(o.n, 0) as uses,
         (1 + (1000000000::hugeint * (coalesce(o.n, 0) + 5)) // (g.n + 5 * l.v))::bigint as p,
         (1 + (1000000000::hugeint * (k.n + 5)) // (l.n + 5 * l.v))::bigint as q
  from sizes g join kept k using (lang) join langs l using (lang) left join own o on (o.lang, o.source, o.term) = (g.lang, g.source, k.term)),
sums as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join sums s on (s.lang, s.source, s.item) = (a.lang, a.source, b.source)),
surplus as (select lang, source, 'term' as part, term as item, p - q as value from shares where uses > 0 and p > q),
both_parts as (select * from pairs union all select * from surplus)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from both_parts qualify part = 'pair' or rank <= 50
""")
def op13(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))
