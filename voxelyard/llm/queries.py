"""Driver queries of the corpus operators; each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelyard.llm import decontam, htmltext, linededup, lm, packing, quality, secrets, simhash, urlfilter, warc
from voxelyard.llm._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(table(spark, sf_dir, "pages"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("removed_lines").cast("long").alias("removed_lines"), "text")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.listed_host())
    return judged.select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_decontaminate, op2_warc_index, op3_simhash, op4_main_text, op5_pack,
            op6_quality, op7_line_dedup, op8_lm_score, op9_secrets, op10_url_filter,
        )
    }


OP2_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as sha from p),
f as (select *, min(page_id) over (partition by sha) as first_id from d),
b as (select *, list_transform(range(8), lambda i: cast('0x' || substr(sha, cast(i * 5 + 1 as int), 5) as int)) as chunks from f)
select page_id, payload_bytes,
  list_aggregate(list_transform(chunks, lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)),
    'string_agg', '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id = first_id then null else first_id end as refers_to
from b
"""

OP7_SQL = f"""
with s as (select doc_id, source, string_split(text, chr(10)) as parts from documents),
l as (select doc_id, source, unnest(range(len(parts))) as pos, unnest(parts) as raw from s),
t as (select doc_id, source, pos, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as line from l),
w as (select * from t where line <> '' and len(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+')) >= {linededup.MIN_WORDS}),
b as (select line, min(doc_id) as first_id from w group by line having count(distinct source) >= {linededup.MIN_SITES}),
k as (select w.doc_id, w.pos, row_number() over (partition by w.line, w.doc_id order by w.pos) as nth, w.doc_id = b.first_id as own
  from w join b using (line)),
g as (select doc_id, list(pos) as gone from k where not (own and nth = 1) group by doc_id)
select d.doc_id, cast(coalesce(len(g.gone), 0) as bigint) as removed_lines,
  case when g.gone is null then d.text else coalesce((select string_agg(l.raw, chr(10) order by l.pos) from l
    where l.doc_id = d.doc_id and not list_contains(g.gone, l.pos)), '') end as text
from documents d left join g using (doc_id)
"""


def _op10_sql() -> str:
    rules = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then struct_pack(rule := '{h + p}', verdict := '{v}')"
        for v, h, p in sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    labels = ", ".join(f"'{x}'" for x in urlfilter.LISTED_LABELS)
    return f"""
with u as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case {rules} end as r from h)
select page_id, host, path, r.rule as rule,
  coalesce(r.verdict, case when list_has_any(string_split(host, '.'), [{labels}]) then 'block' else 'allow' end) as verdict
from r
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force in tests/llm."""
    return {"op2_warc_index": OP2_SQL, "op7_line_dedup": OP7_SQL, "op10_url_filter": _op10_sql()}
