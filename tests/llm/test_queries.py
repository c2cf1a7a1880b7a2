from __future__ import annotations

import os

import pytest

from scriptloom.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "p1_found": ["imdb_id", "speaker_a", "speaker_b"], "p2_found": ["scene_id"], "p3_found": ["genre_label", "decade_label"],
    "p4_found": ["term", "mark"], "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
}
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))


def test_sql_has_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
