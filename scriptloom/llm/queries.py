"""The numbered operators as queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptloom.llm.alignment import alignment_report
from scriptloom.llm.classifier import rate_quality
from scriptloom.llm.common import table
from scriptloom.llm.conversation_repair import damaged, repair_report
from scriptloom.llm.embedding_dedup import near_vectors
from scriptloom.llm.mixing import mix, with_sizes
from scriptloom.llm.mixture_packing import pack_mixture
from scriptloom.llm.ngram_join import jaccard_classes
from scriptloom.llm.packing import pack_documents
from scriptloom.llm.pii import report
from scriptloom.llm.radix_dedup import radix_dedup
from scriptloom.llm.sharding import shard_documents
from scriptloom.llm.token_counts import count_tokens
from scriptloom.llm.warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_words", "n_tokens")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_sizes(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_report(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op13_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_mixture(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window"
    )


def llm_queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP3 = """
with p as (
  select page_id, coalesce(html, '') h, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) d from pages
), g as (
  select d, n, min(page_id) first from p where n >= 100 group by d, n
)
select page_id, p.n payload_bytes, p.d payload_digest,
       case when first is null or first = page_id then 'response' else 'revisit' end record_type,
       case when first <> page_id then first end refers_to
from p left join g on p.d = g.d and p.n = g.n
"""

_OP8 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') norm
  from documents
), g as (
  select norm, count(*) n, arg_min(doc_id, (-n_chars, doc_id)) keep_id from d group by norm
)
select d.doc_id, g.keep_id, g.n group_size, d.doc_id = g.keep_id kept, sha256(d.norm) text_sha256
from d join g using (norm)
"""


# A path is a text: ten digits of cost, then the edits. The least text is the cheapest path
# and the ASCII-least of those; null is no path.
def _path(column: str, cost: str, edit: str) -> str:
    return f"lpad(cast(cast(left({column}, 10) as bigint) + {cost} as varchar), 10, '0') || substr({column}, 11) || '{edit}'"


_OP12 = f"""
with recursive crc as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(
           list_prepend(4294967295::bigint, list_transform(
             string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
             lambda c: ascii(c)::bigint)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)
         ), 4294967295) % 20 as kind
  from conversations
), damage as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from crc where kind <> 0
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, left(role, 1), role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
         left(role, 1) as r, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare
  from damage
), checked as (
  select *, case when bare = '' then 'blank' when seen > 1 then 'duplicate'
                 when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(r) over (partition by conv_id order by i) as before
  from numbered
), rows_of as (
  select *, fault in ('', 'truncated') as stays, case when fault = 'truncated' then 1 else 0 end as more from checked
), ids as (
  select distinct conv_id from conversations
), deleted as (
  select conv_id, 0 as i, repeat('0', 10) as p0, null::varchar as ps, null::varchar as pu, null::varchar as pa from ids
  union all
  select w.conv_id, w.i,
         {_path("p0", "3", "D")},
         least({_path("ps", "3", "D")}, case when stays and r = 's' then {_path("p0", "more", "K")} end),
         least({_path("pu", "3", "D")}, case when stays then
           case when r = 'u' then least({_path("p0", "more", "K")}, {_path("ps", "more", "K")}, {_path("pa", "more", "K")})
           else least({_path("p0", "2 + more", "R")}, {_path("ps", "2 + more", "R")}, {_path("pa", "2 + more", "R")}) end end),
         least({_path("pa", "3", "D")}, case when stays then
           case when r = 'a' then {_path("pu", "more", "K")} else {_path("pu", "2 + more", "R")} end end)
  from (
    select conv_id, i, p0, ps, pu, least(pa, {_path("pu", "2", "I")}) as pa from (
      select conv_id, i, p0, ps, pa,
             least(pu, {_path("p0", "2", "I")}, {_path("ps", "2", "I")}, {_path("pa", "2", "I")}) as pu
      from deleted)
  ) as d join rows_of as w on w.conv_id is not distinct from d.conv_id and w.i = d.i + 1
), ends as (
  select conv_id, least(p0, pa, {_path("pu", "2", "I")}, {_path(_path("p0", "2", "I"), "2", "I")},
                        {_path(_path("ps", "2", "I"), "2", "I")}) as best
  from (select *, row_number() over (partition by conv_id order by i desc) as from_end from deleted) where from_end = 1
), letters as (
  select conv_id, substr(best, 11) as audit, unnest(generate_series(11, length(best))) as pos, best from ends
), edits as (
  select conv_id, pos, substr(best, pos, 1) as edit,
         count(*) filter (where substr(best, pos, 1) <> 'I') over (partition by conv_id order by pos) as i
  from letters
), emitted as (
  select e.conv_id, e.pos, edit, w.role, w.text, w.r, row_number() over (partition by e.conv_id order by e.pos) as n
  from edits as e left join rows_of as w
    on w.conv_id is not distinct from e.conv_id and w.i = e.i and e.edit <> 'I'
  where edit <> 'D'
), systems as (
  select *, max(case when n = 1 and edit = 'K' and r = 's' then 1 else 0 end) over (partition by conv_id) as led from emitted
), repaired as (
  select conv_id, sha256(string_agg(
           case when edit = 'K' then role when (n - led) % 2 = 1 then 'user' else 'assistant' end
           || ':' || coalesce(text, ''), chr(10) order by pos)) as digest
  from systems group by conv_id
), stats as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
         count(*) filter (where fault = 'truncated') as truncated,
         count(*) filter (where before is not null and before || r not in ('su', 'ua', 'au')) as illegal
  from rows_of group by conv_id
)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       cast(left(best, 10) as bigint) as cost, substr(best, 11) as audit, coalesce(digest, sha256('')) as repaired_sha256
from ids join ends on ends.conv_id is not distinct from ids.conv_id
left join stats on stats.conv_id is not distinct from ids.conv_id
left join repaired on repaired.conv_id is not distinct from ids.conv_id
"""


def llm_sql() -> dict[str, str]:
    return {"op3_warc": _OP3, "op8_exact_dedup": _OP8, "op12_conversation_repair": _OP12}
