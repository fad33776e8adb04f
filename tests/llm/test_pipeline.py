"""The pipeline's rows against its brute-force version."""

import duckdb
import pytest
from brute import base_spans, contamination, jaccard_classes
from pyspark.sql import functions as F

import corpus_pipeline
from lumenstrata.llm import pieces, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = [(str(a), b) for a, b in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit_from_tables(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    left = [(i, t) for i, t in rows if scorer.score(t) < 0.5]
    classes = jaccard_classes(left)
    left = [(i, t) for i, t in left if classes[i][0] == i]
    left = [(i, t) for i, t in left if not contamination(t, items)[1]]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == {i for i, _ in left} and len(out) < len(rows)
    model = pieces.PieceModel.load(f"{queries.TOKENIZERS}/{queries.PIECE_MODEL}")
    for i, t in left:
        r = out[i]
        assert base_spans(r["text"]) == [] and (r["text"] == t or base_spans(t))
        assert model.decode(r["piece_ids"]) == r["text"] and r["round_trip"]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_of_awkward_rows(spark, stage):
    """Nulls, repeated rows, clashing extra columns, and no rows at all."""
    rows = [(1, "same words here now again ok", "en", "s", 5, "x"), (1, "same words here now again ok", "en", "s", 5, "y"), (None, None, None, None, None, None), (2, "", "en", "s", 0, "z"), (None, "text", None, "s", 4, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tox_score string")
    for df in (docs, docs.filter(F.lit(False))):
        out = corpus_pipeline.STAGES[stage][1](spark, df, SF)
        n = out.count()
        assert n == (5 if df is docs else 0)
        if stage < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
