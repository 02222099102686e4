"""The fourteen queries are registered and return the columns and types that were asked for."""

import pytest

import __spark_entry__ as entry

COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_html": "page_id bigint, url string, text string, n_chars bigint",
    "op8_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_ann": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_conversations": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_token_align": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "pipeline": "doc_id bigint, source string, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes[: COLUMNS[name].count(",") + 1]) == COLUMNS[name]


def test_names():
    assert set(COLUMNS) <= set(entry.queries()) and {n for n in entry.oracle_sql() if n in COLUMNS} == {"op1_line_dedup", "op11_conversations", "op13_url_filter"}


def test_folds_are_those_of_the_contract(spark):
    import zlib

    from pyspark.sql import functions as F

    from tessera.llm.common import fold

    rows = spark.range(-5, 2000).select("id", fold(F.col("id"), 4).alias("a"), fold(F.col("id"), 5).alias("b")).collect()
    assert all(r.a == zlib.crc32(str(r.id).encode()) % 4 and r.b == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
