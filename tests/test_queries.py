import oracle
import pytest

from placeloom.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    df = q.queries()[name](spark, SF)
    if name in q.oracle_sql():
        assert oracle.compare(df, oracle.connect(SF), q.oracle_sql()[name]) == ""
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_registries_agree():
    assert set(q.oracle_sql()) <= set(q.queries())
