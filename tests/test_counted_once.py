"""Queries that work by recording count the longest one in the table, once, and give the same rows for it."""

import datetime

import pytest

import __spark_entry__ as entry
from kinelake.operators import ordering

QUERIES = [
    "welch_spectrum", "template_entropies", "lempel_ziv_complexity", "detrended_fluctuation", "peak_and_valley_features", "augmented_copies",
    "butterworth_low_pass", "interpolate_cubic",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [
        (i, i * 7 % 50, 1 + i % 2, i % 4, 1.0 + i * 37 % 50, 900.0 + i * i % 8999, (i % 11) / 100, (i % 9) / 100, "A", "O", datetime.datetime(1995, 1, 1) + datetime.timedelta(days=i * 17 % 700))
        for i in range(240)
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_the_longest_recording_is_counted_once(spark, tables, name, monkeypatch):
    counts, plain = [], ordering.largest_group

    def largest_group(df, keys):
        known = bool(ordering.KNOWN) and ordering.KNOWN[-1][0] <= set(keys)
        counts.append(not known)
        return plain(df, keys)

    monkeypatch.setattr(ordering, "largest_group", largest_group)
    found = entry.queries()[name](spark, tables)
    assert sum(counts) == 1 and len(counts) > 1 and not ordering.KNOWN
    assert found.count()


def test_running_sums_of_known_groups_are_those_of_blocks(spark):
    df = spark.createDataFrame([(k, i, float(i * i % 7) if i % 5 else None) for k in ("a", None) for i in range(30)], "k string, frame_idx long, v double")
    kept = [sorted(map(str, ordering.running_sum(df, ["k"], {"s": "v"}, size=n, max_rows=m).collect())) for n, m in ((8, None), (64, 30), (8, 30))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 60
    plan = ordering.running_sum(df, ["k"], {"s": "v"}, max_rows=30)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
