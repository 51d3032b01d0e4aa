import re

import pytest

from kinelake.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150 and len(ORACLES) > 130
    assert not [n for n in QUERIES if re.match(r"op\d+_", n)]


# One query per family; tools/check.py runs all of them.
@pytest.mark.parametrize(
    "name",
    ["task_intervals", "paradigm_3_cohort", "iqr_outliers", "fold_truncate_and_scale", "position_asymmetry", "roc_auc", "event_alignment", "hand_crosstab", "welch_spectrum"],
)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, compare

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert compare(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) == ""


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["subject_id", "task", "window_no", "feature", "z"] and df.limit(5).count() == 5
