import pytest
from oracle import agree

import corpus_pipeline
import maskwright.llm.queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, SF, Q.QUERIES[name], Q.SQL[name])


def test_pipeline_covers_all_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]
