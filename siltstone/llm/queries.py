"""The queries of the operators, each over its whole table, and their SQL where SQL can say it.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns come out as the docstring
of each operator says; a query adds nothing to that but the columns that it derives.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_and_decode
from .collocations import collocations
from .exact_dedup import exact_groups
from .fill_in_middle import fill_in_middle, restored
from .html_extraction import extract
from .jaccard_join import jaccard_groups
from .mixing import in_training_order, mix
from .near_dedup import near_groups
from .quality import quality
from .shared import staged_texts, table
from .sharding import sharded
from .topk_search import top_k
from .toxicity import toxicity
from .warc import archived

#: The vocabulary of the BPE query; a path that all executors can read.
BPE_VOCABULARY = os.environ.get("BPE_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixing.mix() of all documents: a row each, also of those that the mix leaves out (taken 0, no position)."""
    mixed = mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"])
    ordered = in_training_order(mixed, F.try_element_at("positions", F.lit(1)))
    return ordered.select("row.doc_id", "row.source", "size", "source_size", "target", "taken", F.floor(F.try_element_at("positions", F.lit(1)) * 1e6).alias("position_ppm"))


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as ticket
  from documents
), s as (
  select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source) - 1) % 3 as turn from d group by source
), w as (
  select *, [3.0::double, 1.0::double, 2.0::double][turn + 1] as weight, [4.0::double, 0.5::double, 2.0::double][turn + 1] as w0, [-2.0::double, 1.0::double, 0.0::double][turn + 1] as slope,
    source_size * 2.0::double as cap from s
), r as (select *, cap / weight as ratio from w
), l as (
  select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as level from r
), t as (
  select *, (select arg_min(level, ratio) from l where level <= ratio) as lv from l
), g as (
  select source, source_size, weight, w0, slope, case when lv is null then cap else least(cap, lv * weight) end as target from t
), p as (
  select d.*, g.source_size, g.weight, g.w0, g.slope, g.target, floor(g.target + 0.5) as goal,
    sum(d.size) over (partition by d.source order by ticket, doc_id, d.size rows between unbounded preceding and current row) - d.size as start
  from d join g on d.source is not distinct from g.source
), c as (
  select *, greatest(0, least(goal - start, size))::bigint as c0, greatest(0, least(goal - start - source_size, size))::bigint as c1 from p
), y as (
  select *, case when c0 > 0 then (start + c0 / 2.0::double) / goal * weight when c1 > 0 then (start + source_size + c1 / 2.0::double) / goal * weight end as due from c
)
select doc_id, source, size, source_size, target, (c0 + c1)::bigint as taken,
  case when due is not null then floor(least(1.0::double, 2.0::double * due / (w0 + sqrt(w0 * w0 + 2.0::double * slope * due))) * 1e6)::bigint end as position_ppm
from y
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bpe.encode_and_decode() of all documents; a null text has no ids and decodes to an empty one."""
    return encoded_and_decoded(table(spark, sf_dir, "documents"))


def encoded_and_decoded(docs: DataFrame) -> DataFrame:
    both = encode_and_decode(docs, BPE_VOCABULARY, keep=["doc_id"])
    digests = both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return staged_texts(digests, "bpe")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """warc.archived() of all pages, read back through the stored index."""
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """html_extraction.extract() of all pages; an empty text where a page has none."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topk_search.top_k() of all vectors for those whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP8_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


def _scored(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity.toxicity() of all documents; labels of a third of the identifiers are held out."""
    return _scored(toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality.quality() of all documents; labels of a quarter of the identifiers are held out."""
    return _scored(quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup.exact_groups() of all documents, streamed in several triggers."""
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


OP7_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_dedup.near_groups() of all documents, linked from a similarity of 0.85 on."""
    groups = near_groups(table(spark, sf_dir, "documents"), least=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) end) as shingle from w
), n as (select doc_id, count(*)::bigint as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
ways as (select x, y from e union all select y, x from e),
r(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, ways.y from r join ways on r.other = ways.x),
g as (select doc_id, min(other) as component_id from r group by doc_id)
select g.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, g.doc_id = component_id as kept from g left join n on n.doc_id = g.doc_id
"""


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sharding.sharded() of all documents, whole, by the law of the key; the digest columns come from what was written."""
    shards = sharded(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shards.select("row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The digest in base 32, five bits a character, from the bits of the hexadecimal digits.
OP3_SQL = r"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
g as (select h, max(page_id) as top from p group by h),
b as (select distinct h, array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (list_sum(list_transform(range(0, 5), lambda j: ((strpos('0123456789abcdef', substr(h, 1 + ((i + j) // 4)::int, 1)) - 1) >> (3 - (i + j) % 4)::int & 1) << (4 - j)::int)))::int, 1)), '') as payload_digest from p)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from p join g using (h) join b using (h)
"""


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_join.jaccard_groups() of all documents, linked from a similarity of 0.80 on."""
    return jaccard_groups(table(spark, sf_dir, "documents"), least=80).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP11_SQL = OP9_SQL.replace("100 * c >= 85 *", "100 * c >= 80 *").replace(", g.doc_id = component_id as kept", "")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations.collocations() of all documents: the first 2,000 phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
t as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(1, len(ws) - m + 2), lambda i: ws[i : i + m - 1])))) as ph from w),
f as (select lang, ph, count(*)::bigint as a from g group by all having count(*) >= 100),
c as (select * from f where len(ph) >= 2),
i as (select lang, a, unnest(flatten(list_transform(range(2, len(ph)), lambda m: list_transform(range(1, len(ph) - m + 2), lambda i: ph[i : i + m - 1])))) as ph from c where len(ph) >= 3),
b as (select lang, ph, max(a) as longer from i group by all),
k as (select lang, ph, a, unnest(range(1, len(ph))) as k from c where not exists (select 1 from b where b.lang = c.lang and b.ph = c.ph and 100 * b.longer >= 100 * c.a)),
s as (
  select k.lang, k.ph, k.a, k.k, x.a as l, y.a as r, t.n, ((1000::hugeint * k.a * t.n) // (x.a::hugeint * y.a))::bigint as score
  from k join f x on x.lang = k.lang and x.ph = k.ph[1 : k.k] join f y on y.lang = k.lang and y.ph = k.ph[k.k + 1 :] join t on t.lang = k.lang
), m as (select *, row_number() over (partition by lang, ph order by score, k) as o from s),
o as (select lang, array_to_string(ph, ' ') as phrase, a, l, r, n, score from m where o = 1)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from o) where rank <= 2000
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill_in_middle.fill_in_middle() of all documents; the text is rebuilt from each output and its form."""
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = cut.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
    return staged_texts(digests, "fill-in-middle")


#: Eight hexadecimal digits as a number.
_HEX8 = "list_sum(list_transform(range(0, 8), lambda i: (strpos('0123456789abcdef', h[{0} + i + 1]) - 1) * (16 ** (7 - i))::bigint))::bigint"

OP13_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units from documents
), k as (
  select *, len(units)::bigint as n, {_HEX8.format(0)} as h1, {_HEX8.format(8)} as h2, {_HEX8.format(16)} as h3, {_HEX8.format(24)} as h4 from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from k
), p as (
  select *, array_to_string(units[1 : a], '') as prefix, array_to_string(units[a + 1 : b], '') as middle, array_to_string(units[b + 1 : n], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""

QUERIES: dict[str, Query] = {"op1_mix_sources": op1_mix_sources, "op2_bpe": op2_bpe, "op3_warc": op3_warc, "op4_html": op4_html, "op5_toxicity": op5_toxicity, "op6_quality": op6_quality, "op7_exact_dedup": op7_exact_dedup, "op8_topk": op8_topk, "op9_near_dedup": op9_near_dedup, "op10_shards": op10_shards, "op11_jaccard_join": op11_jaccard_join, "op12_collocations": op12_collocations, "op13_fill_in_middle": op13_fill_in_middle}
ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op3_warc": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op8_topk": OP8_SQL, "op9_near_dedup": OP9_SQL, "op11_jaccard_join": OP11_SQL, "op12_collocations": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
