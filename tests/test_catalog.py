import os

import pytest

from quillon import catalog

FOLDER = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", ["bm25_topk", "recall_at_k", "hybrid_topk", "page_anchors", "ppr_bipartite"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
