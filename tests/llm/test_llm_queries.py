"""The registered queries of the operators, on the smallest tables."""

import pytest

from quirework import llm
from tests.test_queries import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):  # noqa: F811
    assert rows(llm.queries()[name](spark, sf_dir).toPandas()) == rows(duck.sql(llm.oracle_sql()[name]).df())


#: Columns that a query's contract names; op2 has no contract.
NAMED = {
    "op3": "doc_id size source_size target taken",
    "op4": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id n_words n_removed kept_sha256",
    "op8": "doc_id n_bytes n_tokens over_limit",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id n_shingles component_id",
    "op11": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", sorted(n for n in llm.queries() if n.split("_")[0] in NAMED))
def test_query_has_each_document_once(spark, sf_dir, name):
    out = llm.queries()[name](spark, sf_dir)
    assert set(NAMED[name.split("_")[0]].split()) <= set(out.columns)
    ids = [x.doc_id for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert sorted(x.doc_id for x in out.select("doc_id").collect()) == sorted(ids)
