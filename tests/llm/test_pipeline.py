"""The pipeline's stages: what each drops and keeps."""

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F

from orbweave.llm import decontaminate, queries, ranking, similar

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    kept = corpus_pipeline.quality(spark, docs, SF)
    bad = {r.doc_id for r in ranking.scored(docs, queries.table(spark, SF, "labels")).filter("predicted = 0").collect()}
    assert kept.columns == columns and ids(kept) == sorted(set(range(200)) - bad)

    alone = corpus_pipeline.near_duplicates(spark, docs, SF)
    groups = similar.linked_documents(docs, 5, 80).toPandas()
    assert alone.columns == columns and ids(alone) == sorted(groups.component_id.unique())

    clean = corpus_pipeline.decontamination(spark, docs, SF)
    hit = {r.doc_id for r in decontaminate.digests(decontaminate.contamination(docs, queries.table(spark, SF, "benchmark"))).filter("contaminated").collect()}
    assert hit and clean.columns == columns and ids(clean) == sorted(set(range(200)) - hit)

    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == columns and set(ids(mixed)) <= set(range(200))
    files = corpus_pipeline.token_files(spark, mixed, SF)
    assert files.count() == mixed.count()


def test_run(spark):
    found = corpus_pipeline.run(spark, SF).toPandas().sort_values("start")
    assert (found.start.iloc[1:].to_numpy() == (found.start + found.n_tokens).iloc[:-1].to_numpy()).all()
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df().set_index("doc_id")
    assert labels.loc[labels.index.isin(found.doc_id)].quality.mean() > 0.95


def test_decisions_go_by_row(spark):
    """Rows without an id, or of one id, are judged one by one: bad and contaminated ones go, clean ones stay."""
    docs = queries.table(spark, SF, "documents")
    scores = ranking.scored(docs, queries.table(spark, SF, "labels")).toPandas().set_index("doc_id")
    hits = decontaminate.digests(decontaminate.contamination(docs, queries.table(spark, SF, "benchmark"))).toPandas().set_index("doc_id")
    said = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    bad, hit = {said[i] for i in scores.index[scores.predicted == 0]}, {said[i] for i in hits.index[hits.contaminated]}
    anon = docs.withColumn("id", F.when(F.col("doc_id") % 2 == 0, None).otherwise(7)).drop("doc_id").withColumnRenamed("id", "doc_id").select(*docs.columns)
    texts = lambda df: sorted(r.text for r in df.select("text").collect())
    assert texts(corpus_pipeline.without(anon, corpus_pipeline_marks(docs, bad), by_text=True)) == sorted(t for t in said.values() if t not in bad)
    assert texts(corpus_pipeline.decontamination(spark, anon, SF)) == sorted(t for t in said.values() if t not in hit)
    assert corpus_pipeline.near_duplicates(spark, anon.filter("doc_id is null"), SF).count() == sum(i % 2 == 0 for i in said)
    kept = corpus_pipeline.quality(spark, docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))), SF)
    assert set(texts(kept)) == set(said.values()) - bad


def corpus_pipeline_marks(docs, texts):
    return docs.filter(F.col("text").isin(list(texts))).select(corpus_pipeline.mark())


def test_stages_bear_any_columns_and_no_rows(spark):
    """Extra columns named as the stages' own, a dot in a name, and tables without rows."""
    docs = queries.table(spark, SF, "documents")
    clashes = ["_gone", "_mark", "gone", "mark", "row", "id", "own_id", "src", "size", "taken", "over", "whole", "_whole", "_id", "_size", "_taken", "_source", "component_id", "score", "items", "a.b"]
    more = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in clashes])
    for name, stage in corpus_pipeline.STAGES:
        plain, found = stage(spark, docs, SF), stage(spark, more, SF)
        if name != "token_files":
            assert found.columns == more.columns, name
            assert found.filter(" or ".join(f"`{c}` != 'own {c}'" for c in clashes)).count() == 0
            found = found.select(*docs.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())), name
        assert stage(spark, docs.limit(0), SF).count() == 0 and stage(spark, more.limit(0), SF).count() == 0


def test_near_duplicates_go_by_row_where_ids_repeat(spark):
    """A clean row stays though another row of its id is a copy; of equal rows one stays, and rows without an id do."""
    from tests.llm.conftest import prose

    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(2, 60)), (3, prose(3, 60)), (3, prose(3, 60)), (None, prose(1, 60)), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in kept if r.text) == sorted([("2", prose(2, 60)), ("3", prose(3, 60)), ("None", prose(1, 60)), ("1", prose(1, 60))])
    assert sum(not r.text for r in kept) == 2
