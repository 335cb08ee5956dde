import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

from placeloom.llm import queries as q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    assert oracle.compare(q.queries()[name](spark, SF), oracle.connect(SF), q.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name, columns", [("p1_found", ["restaurant_id", "place_id"]), ("p2_found", ["id_a", "id_b"]), ("p8_found", ["doc_id", "item_id"]), ("p9_found", ["doc_id", "kind", "start_pos"])])
def test_columns_and_distinct(spark, name, columns):
    df = q.queries()[name](spark, SF)
    rows = df.collect()
    assert df.columns == columns and len(rows) == len(set(rows)) > 0
