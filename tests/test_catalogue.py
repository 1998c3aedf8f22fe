import duckdb
import pytest

import __spark_entry__ as entry
from gramsieve import catalogue
from gramsieve.functions import grams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in "documents pages conversations benchmark".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list | tuple) else None if v is None else round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_same_rows_as_sql(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = oracle.sql(catalogue.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(repr(plain([r[c] for c in order])) for r in got.collect()) == sorted(repr(plain([r[want.columns.index(c)] for c in order])) for r in want.fetchall())


def test_sparse_counts(spark):
    texts = {r.item_id: r.text.encode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}

    def n(t):
        w = grams.pair_weights(t)
        found = {t[i : i + 2] for i in range(len(w))}
        for i in range(len(w)):
            most = -1
            for j in range(i + 1, len(w)):
                if min(w[i], w[j]) > most:
                    found.add(t[i : j + 2])
                most = max(most, w[j])
        return len(found)

    assert {r.file_id: r.n for r in catalogue.sparse_all_counts(spark, SF).collect()} == {i: n(t) for i, t in texts.items()}


@pytest.mark.parametrize("name, of_turns, least", [("candidates_all", False, 3), ("turns_search_auto", True, 1)])
def test_index_holds_fewer_rows_than_postings(spark, name, of_turns, least):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    index = catalogue._index(spark, SF, of_turns)
    rows = spark.read.parquet(catalogue._BUILT[spark.sparkContext.applicationId, SF, of_turns] + "/postings").count()
    assert rows * least < index.grams.agg({"df": "sum"}).head()[0] == index.postings.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
