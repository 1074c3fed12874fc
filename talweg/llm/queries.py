"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import decontaminate, langid, line_dedup, pieces, pii, quality, simhash, suffix_tree, toxicity, version_sketch
from talweg.llm.common import remainder, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed and the text that stays, as length and digest."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_sample(docs, remainder(F.col("doc_id"), 5) != 0))
    out = langid.identify(docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, a digest of the sampled pieces, and whether they decode to the text."""
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.load(), lossless="lossless")
    return coded.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("pieces").cast("array<string>"), ","), 256).alias("pieces_sha256"), "lossless")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = toxicity.training_sample(docs, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 5) != 0, quality.TRAIN_ROWS)
    out = toxicity.score(docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text"), quality.fit(sample))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.fit(pii.training_table()))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_table(table(spark, sf_dir, "documents"))


def op8_version_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_sketch.fingerprinted(table(spark, sf_dir, "documents"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) != 2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = toxicity.training_sample(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 3) != 1, toxicity.TRAIN_ROWS)
    out = toxicity.score(docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text"), toxicity.fit(sample))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_pieces, op4_quality, op5_pii, op6_decontaminate, op7_simhash, op8_version_sketch, op9_suffix_tree, op10_toxicity)}

#: Runs of lines match along a diagonal (p - q) of two documents; a line goes if an earlier equal run of 50 words or more holds it.
_LINE_DEDUP = r"""
with parts as (
  select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where length(text) > 0
), lines as (
  select doc_id, text, pos, trim(translate(raw, chr(9) || chr(13) || chr(11) || chr(12), '    ')) as line from parts
), worded as (
  select doc_id, pos, line, len(list_filter(string_split(line, ' '), lambda x: x <> '')) as words, row_number() over (partition by doc_id order by pos) as p from lines where line <> ''
), met as (
  select a.doc_id as d, a.pos, a.p, a.words, b.doc_id as e, b.p as q, a.p - row_number() over (partition by a.doc_id, b.doc_id, a.p - b.p order by a.p) as island
  from worded a join worded b on a.line = b.line and (b.doc_id, b.p) < (a.doc_id, a.p)
), runs as (
  select d, pos, sum(words) over (partition by d, e, p - q, island) as total from met
), gone as (
  select d as doc_id, pos from runs where total >= 50 group by all
), kept as (
  select l.doc_id, string_agg(l.raw, chr(10) order by l.pos) as body from parts l anti join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
), counted as (
  select doc_id, count(*) as n from gone group by doc_id
)
select d.doc_id, coalesce(c.n, 0) as n_removed, length(case when c.n is null then d.text else coalesce(k.body, '') end) as n_chars_kept,
  sha256(case when c.n is null then d.text else coalesce(k.body, '') end) as kept_sha256
from documents d left join counted c on c.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id
"""

_DECONTAMINATE = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select item_id, least(len(w), 10) as size, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) as win from item where len(w) > 0
), sizes as (
  select distinct size from windows
), spots as (
  select doc_id, size, unnest(range(1, len(w) - size + 2)) as i, w from doc, sizes where len(w) >= size
), hits as (
  select s.doc_id, s.i, s.size, x.item_id from (select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as win from spots) s join windows x on x.win = s.win and x.size = s.size
), hit as (
  select doc_id, count(distinct spot) as n from (select doc_id, unnest(range(i, i + size)) as spot from hits) group by doc_id
), items as (
  select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from hits) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n, 0) as n_hit, coalesce(t.n, 0) as n_items, sha256(coalesce(t.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from doc d left join hit h on h.doc_id = d.doc_id left join items t on t.doc_id = d.doc_id
"""

ORACLE_SQL = {"op1_line_dedup": _LINE_DEDUP, "op6_decontaminate": _DECONTAMINATE}
