"""The registered corpus queries on the smallest tables: columns, whole results, SQL where there is one."""

import zlib

import pytest

from evalloom.llm.queries import ORACLE, QUERIES
from tests.test_entry import SF, duck, rows_of  # noqa: F401  (duck is a fixture)

COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_kept", "n_removed", "removed_lines"},
    "op3_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op4_simhash": {"doc_id", "fingerprint", "component_id"},
    "op5_ppm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op6_hilbert_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op8_quality": {"doc_id", "held_out", "score", "predicted", "kept"},
    "op9_packing": {"doc_id", "n_tokens", "bucket", "batch", "slot"},
    "op10_decontamination": {"doc_id", "contaminated", "kept", "item_ids"},
    "op11_vector_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op12_cross_tokens": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13_language_id": {"doc_id", "held_out", "lang_pred", "score"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_whole_result_and_columns(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    assert set(df.columns) >= COLUMNS[name]
    rows = df.collect()
    source = {"op7_warc": "pages", "op11_vector_codes": "embeddings"}.get(name, "documents")
    assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        assert rows_of(df.columns, rows) == rows_of([c[0] for c in result.description], result.fetchall())
    if name == "op1_toxicity":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)
    if name == "op5_ppm":
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    if name == "op13_language_id":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
        held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
        assert sum(held) >= 0.95 * len(held) > 0
    if name == "op7_warc":
        assert all(r.verified for r in rows)
