"""Every registered corpus query runs on whole tables; those that SQL can say equal it in DuckDB."""

import os

import duckdb
import pytest

from marginalia.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op3_line_dedup": ["doc_id", "text", "n_lines", "n_lines_removed"],
    "op4_temporal_url_filter": ["page_id", "url", "host", "categories", "matched_domain", "blocked"],
    "op5_html_text": ["page_id", "url", "text", "n_chars"],
    "op6_minhash_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op7_edit_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op8_pseudonyms": ["doc_id", "text", "n_pii", "pii_kinds"],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_ranked_search": ["item_id", "rank", "doc_id", "score"],
    "op13_toxicity": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name]) <= set(df.columns)
    rows = df.collect()
    source = {"op2": "embeddings", "op4": "pages", "op5": "pages"}.get(name.partition("_")[0], "documents")
    if name.partition("_")[0] not in ("op2", "op10", "op11", "op12"):
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for view in {source, "benchmark", "conversations"}:
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{SF}/{view}.parquet'")
        cols = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted([tuple(r[c] for c in cols) for r in rows], key=str) == sorted(want, key=str)


def test_list_entries_are_dated_and_of_the_pages_hosts(spark):
    pages = spark.createDataFrame([("https://www.a.b.example.com/x",), ("http://c.org",), (None,), ("no url",)], "url string")
    rows = queries.list_entries(pages).collect()
    assert {r["domain"] for r in rows} <= {"a.b.example.com", "b.example.com", "c.org"} and rows
    assert {r["action"] for r in rows} <= {"add", "remove"} and {r["at"].day for r in rows} == {1}
    assert len({(r["domain"], r["at"]) for r in rows}) == len(rows)
