"""Every query of the subpackage, and the pipeline, over an edge-case folder and an empty one."""

import pytest

from evisynth.llm.queries import QUERIES

from .test_operators import EDGE, SCHEMA

PAGES = "page_id long, url string, html string, digest string, n long"


@pytest.fixture(scope="module", params=["edge", "empty"])
def folder(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else f"s{i % 3}", None, None, 1, 2, 3, "k") for i, t in enumerate(EDGE)]
    pages = [(1, None, None, "x", 1), (2, "u", "h" * 200, None, 2), (3, "u", "h" * 200, "y", 3), (None, "u", "h" * 200, "z", 4)]
    n = 0 if request.param == "empty" else None
    spark.createDataFrame([*rows, rows[5]][:n], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(pages[:n], PAGES).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([*enumerate(EDGE)][:n], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_edges(spark, folder, name):
    kind, d = folder
    if name == "pipeline":
        # every edge-case text is short or repeats itself, so the first stage keeps none; stages on kept rows: test_pipeline.py
        assert pytest.importorskip("corpus_pipeline").run(spark, d).count() == 0
        return
    found = QUERIES[name](spark, d).count()
    want = 0 if kind == "empty" else 4 if name.startswith("op5_") else len(EDGE) + 1
    assert found >= want if name.startswith("op10_") else found == want
