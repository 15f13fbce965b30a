"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

from gritsieve.operators import rules
from gritsieve.plans import catalog, corpora

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their groups need more rows than the smallest tables have.
SPARSE = {"directory_fanout", "duplicate_signatures", "directory_scores_raw", "duplicate_mock_setup"}


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(repr(norm(tuple(r))) for r in got.select(*want.columns).collect())
    assert rows == sorted(repr(norm(r)) for r in want.fetchall())
    assert rows or name in SPARSE


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name, findings", [("duplicate_signatures", rules.duplicate_signatures), ("clone_cluster", rules.clones)])
def test_findings_of_clusters_hold_what_is_counted(spark, sf, name, findings):
    made = catalog.flat(findings(corpora.corpus(spark, "/root/testdata/sf0.01", corpora.FUNCTIONS)))
    counted = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = lambda df: sorted(tuple(map(repr, r)) for r in df.select(*made.columns).collect())
    assert rows(made) == rows(counted) and made.count() > 0


def test_mock_setups_are_counted_without_gathering_places(spark, sf):
    from pyspark.sql import functions as F

    # one setup of all files, one of most, some of few; places with several setups; one of two files only, which counts for nothing
    rows = [(f"T{f}", 1 + k, "all", "all::1") for f in range(40) for k in range(3)]
    rows += [(f"T{f}", 1 + f % 2, "most", "most::1") for f in range(30)] + [(f"T{f}", 9, "few", f"few::{f % 7}") for f in range(25)] + [(f"T{f}", 12, "most", "most::2") for f in range(10, 40)]
    rows += [(f"U{f}", 5, "two", "two::1") for f in range(2)] + [(f"V{f}", 6, "v", "v::1") for f in range(3)] + [("V0", 6, "v", "v::1")]
    made = spark.createDataFrame(rows, "path string, line int, label string, fingerprint string")
    places, files = {}, {}
    for path, line, _, mark in rows:
        places.setdefault(mark, set()).add((path, line))
        files.setdefault(mark, set()).add(path)
    want = {}
    for path in {r[0] for r in rows}:
        marks = [m for m in files if len(files[m]) >= 3 and path in files[m]]
        if marks:
            want[path] = (sorted(set().union(*[places[m] for m in marks]), key=lambda p: f"{p[0]}:{p[1]}"), min(5.0, sum(1 + max(0, len(files[m]) - 2) * 0.5 for m in marks)), len(marks))
    counted = {r["path"]: r for r in rules.mock_clusters(made).collect()}
    listed = {r["path"]: r for r in rules.duplicate_mocks(made).collect()}
    assert set(counted) == set(listed) == set(want)
    for path, (at, score, marks) in want.items():
        assert [(p["path"], p["line"]) for p in listed[path]["locations"]] == at
        assert (counted[path]["places"], counted[path]["line"], counted[path]["score"], len(counted[path]["items"])) == (len(at), at[0][1], score, marks) and listed[path]["evidence"] == counted[path]["items"]
    query = catalog.QUERIES["duplicate_mock_setup"](spark, sf)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "flatten" not in plan
    assert query.where(F.col("places") < 1).count() == 0
