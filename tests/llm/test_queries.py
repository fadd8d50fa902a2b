"""The registered queries over whole tables: columns, rows, and SQL where there is some."""

import os

import duckdb
import pytest
from bindery.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_lm_score": ["doc_id", "n_tokens", "log_prob", "mean_log_prob"],
    "op3_html_extract": ["page_id", "url", "text", "n_chars"],
    "op4_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op5_nearest": ["query_id", "rank", "vec_id", "score"],
    "op6_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op7_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9_id_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    "op11_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}
TYPES = {"rank": "int", "predicted": "int", "held_out": "boolean", "kept": "boolean", "over_limit": "boolean", "score": "double"}


def test_every_operator_is_registered():
    assert list(QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    assert found.columns == COLUMNS[name]
    kinds = dict(found.dtypes)
    for column in found.columns:
        text = column in ("url", "text", "fingerprint", "lang", "source", "part", "item") or column.endswith("sha256")
        wanted = TYPES.get(column, "string" if text else "double" if "log_prob" in column else "bigint")
        assert kinds[column] == wanted, column
    rows = found.collect()
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    if name == "op5_nearest":
        assert len(rows) % 5 == 0 and all(r.query_id % 50 == 0 and r.query_id != r.vec_id for r in rows)
    elif name == "op3_html_extract":
        assert len(rows) == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    elif name == "op13_hard_negatives":
        assert rows and all(r.anchor_id % 100 == 0 for r in rows)
    elif name == "op12_source_divergence":
        assert {r.part for r in rows} == {"pair", "term"}
    else:
        assert len({r.doc_id for r in rows}) == documents
    if name in ORACLES:
        con = duckdb.connect()
        for table in ("documents", "embeddings"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
        result = con.execute(ORACLES[name])
        order = [d[0] for d in result.description]
        assert sorted(order) == sorted(found.columns)
        assert sorted((tuple(r[c] for c in order) for r in rows), key=repr) == sorted(result.fetchall(), key=repr)
