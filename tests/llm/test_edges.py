"""Every query and every pipeline stage over tables full of edge cases, and over empty ones."""

import pyarrow as pa
import pytest

import corpus_pipeline
from keyloom.llm.queries import oracle_sql, queries
from tests.llm.cases import edge_folder
from tests.oracle import differences

ROWS = {"op1_secrets": 12, "op2_license_scan": 12, "op3_url_filter": 6, "op5_simhash_near_dedup": 12, "op6_html_text": 6, "op7_toxicity": 12, "op8_decontaminate": 12, "op10_language": 12}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edges")
    return edge_folder(spark, base / "some"), edge_folder(spark, base / "none", empty=True), edge_folder(spark, base / "short", longest=3000)


@pytest.mark.parametrize("name", sorted(queries()))
def test_edge_cases(spark, folders, name):
    rows = queries()[name](spark, folders[0]).collect()
    if name in ROWS:
        assert len(rows) == ROWS[name]
    if name in oracle_sql():
        # DuckDB takes minutes over the very long text.
        assert differences(queries()[name](spark, folders[2]), oracle_sql()[name], folders[2]) is None


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, folders, name):
    assert queries()[name](spark, folders[1]).collect() == []


@pytest.mark.parametrize("which", [0, 1])
def test_stages(spark, folders, which):
    docs = spark.read.parquet(f"{folders[which]}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folders[which])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert len(rows) <= docs.count()
        if which:
            assert rows == []
    assert (corpus_pipeline.STAGES[-1][1](spark, docs, folders[which]).count() == 0) == bool(which)


def test_pipeline_runs(spark, folders):
    assert corpus_pipeline.run(spark, folders[0]).count() > 0
    assert corpus_pipeline.run(spark, folders[1]).count() == 0


def test_edge_results(spark, folders):
    secrets = [r for r in queries()["op1_secrets"](spark, folders[0]).collect() if r["doc_id"] == 7][0]
    assert (secrets["n_assign"], secrets["n_access"], secrets["n_hex"]) == (1, 0, 0) and secrets["spans"].startswith("assign:0:")
    langs = {(r["doc_id"], r["lang_pred"]) for r in queries()["op10_language"](spark, folders[0]).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= langs
    groups = queries()["op5_simhash_near_dedup"](spark, folders[0]).collect()
    assert {r["component_id"] for r in groups if r["doc_id"] in (1, 2)} == {1}
    assert {(r["fingerprint"], r["component_id"]) for r in groups if r["doc_id"] in (3, 4, 5)} == {("0" * 16, 3)}
    leaks = {r["doc_id"]: r["contaminated"] for r in queries()["op8_decontaminate"](spark, folders[0]).collect() if r["doc_id"] is not None}
    assert leaks[1] == leaks[2] == 1 and leaks[3] == leaks[4] == leaks[6] == 0


def test_stages_hand_texts_to_python_in_small_batches(spark):
    """Ten thousand rows of whole texts would be one batch of tens of megabytes."""
    was = spark.conf.get(corpus_pipeline.BATCH_BYTES)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id as string), 2500) AS text")
    size = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]}) for b in batches)
    try:
        corpus_pipeline.in_small_batches(lambda s, d, _: d)(spark, docs, "")
        got = docs.mapInArrow(size, "n long, rows long").collect()
        assert sum(r["rows"] for r in got) == 6000 and max(r["n"] for r in got) < 2 * corpus_pipeline.BATCH, got
        assert all(stage.__wrapped__ for _, stage in corpus_pipeline.STAGES)
    finally:
        spark.conf.set(corpus_pipeline.BATCH_BYTES, was)
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(corpus_pipeline.BATCH_BYTES) == was
