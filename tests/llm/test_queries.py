"""Every registered query of the folder on the smallest tables: against its SQL, or its columns and rows."""

import pyarrow.parquet as pq
import pytest

from adfathom.llm.queries import ORACLES, QUERIES
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
#: The columns that each query returns at least, with their types.
COLUMNS = {
    "op1_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_sentencepiece": "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_sha256 string, exact boolean",
    "op4_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_quality_crf": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op12_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert difference(spark, db, QUERIES[name], ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_a_row_for_every_document(spark, name):
    found = QUERIES[name](spark, FOLDER)
    kinds = dict(found.dtypes)
    for column in COLUMNS[name].split(", "):
        named, kind = column.split()
        assert kinds.get(named) == kind, (named, kinds)
    ids = sorted(r["doc_id"] for r in found.select("doc_id").collect())
    assert ids == sorted(pq.read_table(f"{FOLDER}/documents.parquet").column("doc_id").to_pylist())


def test_held_out_rows_and_labels_follow_the_contract(spark):
    import zlib

    for name in ("op5_quality_crf", "op6_language_id"):
        for r in QUERIES[name](spark, FOLDER).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            assert 0 <= r["score"] <= 1
            assert name[:3] == "op6" or r["predicted"] == int(r["score"] >= 0.5)


def test_pipeline_keeps_ids_and_texts(spark):
    found = QUERIES["pipeline"](spark, FOLDER).collect()
    assert found and len({r["doc_id"] for r in found}) == len(found)
    assert all(r["n_ids"] == len(r["ids"]) for r in found)


def test_every_query_is_tested_here():
    assert set(QUERIES) == set(ORACLES) | set(COLUMNS) | {"op8_decontaminate", "pipeline"}
