"""Each stage keeps the columns of documents, and its decision holds."""

import corpus_pipeline as cp
from casemill.llm.common import cut, table
from casemill.llm.queries import QUERIES


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs
    for name, stage in cp.STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir))
        assert after.columns == first.columns, name
        assert after.count() > 0
        docs = after
    last = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert last.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


def test_all_ten_are_registered():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 11))
