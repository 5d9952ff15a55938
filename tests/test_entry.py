"""Driver contract: entry runs; every SQL twin belongs to a registered query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"stage", "decision", "toxic", "reviews"}
    assert sum(r.reviews for r in rows) == 200


def test_oracle_keys_subset():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60
