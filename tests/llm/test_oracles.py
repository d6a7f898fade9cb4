"""Registered corpus queries against their DuckDB oracles, and their contracts' columns."""

import pytest

from tests.conftest import SF_SMALL
from wattline.llm.queries import ORACLE, QUERIES
from wattline.plans.parity import _rows, duck

COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "page_id url text n_chars",
    "op3": "doc_id size text_crc32 law shard slot grown_shard",
    "op4": "doc_id held_out lang_pred score",
    "op5": "doc_id keep_id group_size kept text_sha256",
    "op6": "doc_id n_shingles component_id",
    "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op10": "page_id payload_bytes payload_digest record_type refers_to",
    "op11": "lang source part item value rank",
    "op12": "doc_id start n_tokens ids_crc32",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
}
LONGS = {"n_words", "n_hit", "n_items", "n_chars", "size", "text_crc32", "slot", "group_size", "n_shingles", "n_email",
         "n_ip", "n_card", "n_phone", "payload_bytes", "start", "n_tokens", "ids_crc32", "value"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, None) == _rows(want, None)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows_of_the_contract(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    kinds = dict(df.dtypes)
    for column in COLUMNS.get(name.split("_")[0], "doc_id").split():
        assert column in kinds
        if column in LONGS:
            assert kinds[column] == "bigint"
    if "doc_id" not in kinds and "page_id" not in kinds:
        return  # rows of groups
    source = "pages" if "page_id" in kinds else "documents"
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/{source}.parquet").count()


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))
