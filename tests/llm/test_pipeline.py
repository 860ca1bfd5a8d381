import corpus_pipeline
from kestrine.llm import exact, mixing, packing, quality

from ..conftest import SF
from .conftest import ODD
from .test_near import brute_components


def test_stages_in_order_and_their_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        out = stage(spark, docs, SF)
        assert out.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        n.append(docs.count())
        if k == 0:
            labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
            assert docs.join(labels, "doc_id", "left_semi").count() >= 0.97 * labels.join(before, "doc_id", "left_semi").count()
        if k == 1:
            want = {r.id for r in exact.exact_duplicates(before).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == want
        if k == 2:
            rows = sorted(before.select("doc_id", "text").collect())
            want = {rows[i].doc_id for i in brute_components([r.text for r in rows])}
            assert {r.doc_id for r in docs.collect()} == want
        if k == 3:
            assert n[3] == sum(r.times for r in mixing.copies(before).collect())
        if k == 4:
            assert docs.where("piece = 0").count() == n[3]
            assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert [len(corpus_pipeline.STAGES), n[0] < before.sparkSession.read.parquet(f"{SF}/documents.parquet").count()] == [5, True]
    assert packing.CAPACITY == 2048 and quality.KEEP_FROM < 1


def test_run_writes_and_reads_each_stage(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, odd, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names; then no rows at all."""
    labels = spark.createDataFrame([(3, 1, 0), (6, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    nulls = spark.createDataFrame([[None] * len(odd.columns)], odd.schema)
    for docs in (odd.unionByName(nulls), odd.limit(0)):
        columns, n = docs.columns, docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / f"{n}-{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
            if k in (1, 2):
                assert docs.count() == docs.select("text").distinct().count()
        assert (docs.count() > 0) == (n > 0)
    assert len(ODD) == 10
