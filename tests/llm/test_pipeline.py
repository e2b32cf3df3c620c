import corpus_pipeline
from pathloom.llm.jaccard import similar_documents
from pathloom.llm.mixing import mix

SF_DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        path = f"{tmp_path}/{number}"
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        ids = [r.doc_id for r in docs.collect()]
        counts.append(len(ids))
        assert {*ids} <= {r.doc_id for r in before.collect()}
        if name == "near_duplicates":
            assert sorted(ids) == sorted(r.doc_id for r in similar_documents(before).filter("doc_id = component_id").collect())
        elif name == "mix":
            wanted = [r.doc_id for r in mix(before).collect() for _ in range(r.copies)]
            assert sorted(ids) == sorted(wanted)
        else:
            # Few documents of the test table are toxic or in no language.
            assert len(ids) >= 0.75 * counts[-2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {p.doc_id for p in pieces} == {*ids}


def test_odd_rows_pass_through(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[2:]:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() > 0
