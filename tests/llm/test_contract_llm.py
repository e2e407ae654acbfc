"""Every dealt query has SQL or a named test against brute force, a library or held-out labels."""

from pathlib import Path

import __spark_entry__ as entry
from brisa.llm import queries

HERE = Path(__file__).parent
WITHOUT_SQL = {
    "op1_edit_fingerprints": ("test_queries.py", "test_fingerprints"),
    "op2_language": ("test_queries.py", "test_language_held_out"),
    "op3_secrets": ("test_queries.py", "test_secrets"),
    "op5_token_counts": ("test_queries.py", "test_token_counts"),
    "op6_url_filter": ("test_queries.py", "test_url_filter"),
    "op7_mix_sources": ("test_queries.py", "test_mix"),
    "op9_toxicity": ("test_queries.py", "test_toxicity"),
    "op10_orc_ids": ("test_queries.py", "test_token_ids"),
    "op11_whitening": ("test_whitening.py", "test_query"),
    "pipeline": ("test_stages.py", "test_stage_takes_odd_rows_and_names"),
}


def test_sql_or_a_named_test():
    registered = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= registered
    assert set(queries.QUERIES) | {"pipeline"} == set(entry.oracle_sql()) & (set(queries.QUERIES) | {"pipeline"}) | set(WITHOUT_SQL)
    for file, test in WITHOUT_SQL.values():
        assert f"def {test}(" in (HERE / file).read_text()
    assert len(queries.QUERIES) == 13 and all(n.startswith(f"op{k}_") for k, n in enumerate(queries.QUERIES, 1))
