"""The pipeline's stages against what each must keep, on odd and empty tables, and the queries of the subpackage."""

import glob
import os

import duckdb
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from talweg.llm import decontaminate
from talweg.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import DOCS, ODD, brute_fingerprint, brute_lines


def test_stages_hand_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        assert docs.count() <= kept, name
        kept = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == kept and last.where("not lossless").count() == 0


def test_run_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) > 0.7 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = docs.where("doc_id < 120").withColumn("n_chars", F.col("n_chars"))
    stage = dict(corpus_pipeline.STAGES)
    found = corpus_pipeline.cut(stage["language"](spark, few, sf_dir))
    texts = {r.doc_id: r.text for r in found.collect()}
    gone = brute_lines({d: t or "" for d, t in texts.items()}, 50)
    found = corpus_pipeline.cut(stage["lines"](spark, found, sf_dir))
    texts = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in found.collect()} == {d: (t, len(t)) for d, t in texts.items()}
    found = corpus_pipeline.cut(stage["near_duplicates"](spark, found, sf_dir))
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[d]) for d in ids]
    kept, left = [], set(range(len(ids)))
    while left:
        first = min(left)
        reach, group = [first], {first}
        while reach:
            i = reach.pop()
            near = {j for j in left - group if (prints[i] ^ prints[j]).bit_count() <= 4}
            group |= near
            reach += near
        left -= group
        kept.append(ids[first])
    assert sorted(r.doc_id for r in found.collect()) == kept
    found = corpus_pipeline.cut(stage["clean"](spark, found, sf_dir))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for item, t in items:
        w = decontaminate.words(t or "")
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[i : i + 10]), set()).add(tuple(w[i : i + 10]))
    clean = lambda w: not any(tuple(w[i : i + n]) in some for n, some in windows.items() for i in range(len(w) - n + 1))
    expect = [d for d in kept if clean(decontaminate.words(texts[d]))]
    assert sorted(r.doc_id for r in found.collect()) == expect and len(expect) < len(kept) < len(ids)
    last = stage["encode"](spark, found, sf_dir).collect()
    assert sorted(r.doc_id for r in last) == expect and all(r.lossless for r in last)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", items string, __key int")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_answers_every_document(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
