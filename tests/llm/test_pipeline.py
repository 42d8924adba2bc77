"""Each stage on odd rows, the whole on the smallest tables, and the queries with SQL."""

import os

import duckdb

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tidebar.llm import toxicity


def test_stages_take_odd_rows(spark, odd, odd_rows, none, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (4, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert out.columns == docs.columns
            n = out.count()
            assert (n == 0) == (docs is none)


def test_whole(spark, smoke_dir):
    out = pipeline.run(spark, smoke_dir)
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{smoke_dir}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert ids <= clean and len(ids) > 0.8 * len(clean)


def test_sql(spark, smoke_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(smoke_dir, 'conversations.parquet')}'")
    name = "op6_chat"
    got, want = entry.queries()[name](spark, smoke_dir).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    flat = lambda d: sorted(repr([None if x is None or x != x else str(x) for x in r]) for r in d[cols].astype(object).itertuples(index=False, name=None))
    assert sorted(got.columns) == cols and len(got) == len(want) and flat(got.fillna(-1).astype({"chosen_id": int, "rejected_id": int})) == flat(want.fillna(-1).astype({"chosen_id": int, "rejected_id": int}))


def test_registry():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
