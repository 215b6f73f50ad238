"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, htmltext, langid, licenses, mixing, phrases, pieces, sharding, simhash, toxicity
from .common import remainder, table

#: Bytes of text that a shard may hold.
SHARD_BYTES = 2_000_000


def op1_rotated_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2 = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':1'), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0, 1.0, 2.0][1 + (row_number() over (order by source asc nulls last) - 1) % 3]::double as w, 2.0::double * source_size as cap from s),
l as (select *, row_number() over o as pos, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (o rows between current row and unbounded following) as level
  from w window o as (order by cap / w, source asc nulls last)),
f as (select min_by(level, pos) as level from l where cap > level * w),
t as (select source, source_size, least(cap, coalesce(f.level * w, cap)) as target from l left join f on true),
r as (select *, case when source_size > 0 then target / source_size else 0 end as ratio from t),
p as (select *, least(floor(ratio), 2)::bigint as whole, (ratio - least(floor(ratio), 2)) * source_size as want, ratio - least(floor(ratio), 2) > 1e-12 as open from r),
z as (select d.source, size, count(*) as n, any_value(want) as want from d join p on d.source is not distinct from p.source where open and size > 0 group by d.source, size),
c as (select source, size, (want - coalesce(sum(n * size) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(n * size * sqrt(size)) over (o rows between current row and unbounded following) as scale
  from z window o as (partition by source order by size desc)),
k as (select source, max_by(scale, size) as scale from c where scale * sqrt(size) <= 1 group by source),
i as (select d.*, source_size, target, whole, want, open, case when open then least(1.0, k.scale * sqrt(d.size)) end as p
  from d join p on d.source is not distinct from p.source left join k on d.source is not distinct from k.source),
q as (select *, sum(case when open then size else 0 end) over (partition by source order by case when p > 0 then u * (1 - p) / (u * (1 - p) + p * (1 - u)) else 1 end, doc_id, size rows between unbounded preceding and current row) as run from i),
h as (select *, coalesce(open and run <= want and p > 0, false) as picked from q),
g as (select source, any_value(want) - sum(case when picked then size else 0 end) as gap from h where open group by source),
e as (select h.source, first(struct_pack(doc_id := doc_id, size := size) order by abs(size - gap), u, doc_id, size) as b, first(abs(size - gap) order by abs(size - gap)) as off, any_value(gap) as gap
  from h join g on h.source is not distinct from g.source where open and not picked and size > 0 group by h.source)
select h.doc_id, h.size, h.source_size, h.target,
  ((whole + picked::bigint + coalesce(e.off < e.gap and not picked and e.b.doc_id is not distinct from h.doc_id and e.b.size = h.size, false)::bigint) * h.size)::bigint as taken
from h left join e on e.source is not distinct from h.source
"""


def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return sharding.shard(docs, F.col("n"), limit=SHARD_BYTES).select("doc_id", "bytes", "shard", "depth", "shard_bytes")


OP3 = f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint), 60, '0') as bits from documents),
x as (select d.*, depth::int as depth, substr(bits, 1, depth) as head from d, generate_series(0, 24) as g(depth)),
t as (select depth, head, sum(bytes)::bigint as shard_bytes from x group by all having sum(bytes) <= {SHARD_BYTES})
select doc_id, bytes, min_by(head, depth) as shard, min(depth)::int as depth, min_by(shard_bytes, depth) as shard_bytes
from x join t using (depth, head) group by doc_id, bytes
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("id", 5) != 0)
    return toxicity.score(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, remainder("id", 3) != 1)
    return langid.identify(docs, model).select(F.col("id").alias("doc_id"), F.coalesce(remainder("id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its licenses and notices; none for most."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.expr("transform(notices, n -> n.license)")))
    return found.select(F.col("id").alias("doc_id"), F.size("notices").alias("n_notices"), names.alias("licenses"), "notices")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, limit=2)
    return groups.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.with_next(table(spark, sf_dir, "documents"))


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rotated_code_search, op2_pareto_mix, op3_extendible_shards, op4_toxicity, op5_language, op6_main_text, op7_license_scan, op8_simhash_groups, op9_phrase_fingerprints, op10_piece_encoding)}


#: Nearest neighbours by brute force; a recall of 1 makes the rows equal.
OP1 = """
with v as (select vec_id, embedding::double[] as e from embeddings where list_sum(list_transform(embedding, lambda x: x * x)) > 0),
p as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.e, v.e) as score from v q, v where q.vec_id % 20 = 0 and q.vec_id <> v.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from p qualify rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_rotated_code_search": OP1, "op2_pareto_mix": OP2, "op3_extendible_shards": OP3}
