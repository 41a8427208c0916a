import pytest
from oracle import same

from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op2": ["doc_id", "license"],
    "op3": ["doc_id", "held_out", "lang_pred", "score"],
    "op4": ["doc_id", "text"],
    "op5": ["vec_id", "n_links", "component_id", "kept"],
    "op6": ["page_id", "url", "text", "n_chars"],
    "op7": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op8": ["doc_id", "n_shingles", "component_id"],
    "op9": ["query_id", "rank", "vec_id", "score"],
    "op10": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    wanted = COLUMNS[name.split("_")[0]]
    out = QUERIES[name](spark, SF)
    assert out.columns[: len(wanted)] == wanted and out.count() > 0
