"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from fathomlog import catalog
from fathomlog.operators.fixpoint import Engine
from fathomlog.plans.desugar import Core
from fathomlog.session import Session

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


def shape(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def one(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert shape(got.columns, [tuple(r) for r in got.collect()]) == shape(names, want.fetchall())


def test_whole_null_join(spark, tmp_path):
    """Every pair of customers counts, in the null group, too: whatever their ids."""
    keys = [3, 25, 399, 400, 5_000, 70_000]
    nations = dict(zip(keys, [1, 1, 2, 2, 2, 1], strict=True))
    with_p = {3, 399, 400, 70_000}
    spark.createDataFrame([(k, f"c{k}", nations[k], 0.0, "s") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(n, k, "P" if k in with_p else "O", 1.0, "1990-01-01", "p") for n, k in enumerate(keys)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    group = {k: nations[k] if k in with_p else None for k in keys}
    want = {}
    for a in keys:
        for b in keys:
            if group[a] == group[b]:
                want[group[a]] = want.get(group[a], 0) + 1
    assert {r.N: r.K for r in catalog.queries()["null_join"](spark, str(tmp_path)).collect()} == want == {1: 4, 2: 4, None: 4}


def test_whole_csv_text(spark, tmp_path):
    """Texts keep white space, line breaks and control characters at their ends; no row is lost, none has another language."""
    texts = ["  a b", "a b  ", "\n a", "a\r\n", "\r", " \t\n ", "a\0\nb", "\0", '"\0"', "\x01a\x1f", 'say "x",\n', "", None]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    rows += [(20, "a", None), (21, "bc", None), (22, "d", ""), (23, "e", " en"), (24, "f", "e\nn"), (None, "gh", "fr"), (30, "same", "de"), (30, "same", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = shape(("L", "C", "S"), con.execute(catalog.oracle_sql()["csv_text"]).fetchall())
    got = catalog.queries()["csv_text"](spark, str(tmp_path))
    assert shape(got.columns, [tuple(r) for r in got.collect()]) == want
    assert (2, None, 3) in want and (2, "de", 8) in want


def test_whole_csv_names(spark, tmp_path):
    """Names keep white space at their ends in every query that goes through CSV."""
    want = {(k, n, 1, 0.5) for k, n in enumerate(["  a", "b ", " \t", "c\n", "\x01"])}
    spark.createDataFrame(sorted(want), "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(*r, n) for r, n in zip(sorted(want), [" m", "m ", "\n", "", "m"], strict=True)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("directory_source", "bound_source"):
        assert {tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).select("S", "N", "K", "B").collect()} == want
    assert {(r.N, r.S) for r in catalog.queries()["csv_source"](spark, str(tmp_path)).collect()} == {("  a", " m"), ("b ", "m "), (" \t", "\n"), ("c\n", ""), ("\x01", "m")}


def test_whole_proof_terms(spark, tmp_path):
    """Paths of all conversations from all turns."""
    turns = [(c, t, "user") for c, n in ((1, 6), (20, 5), (900, 4)) for t in range(n) if (c, t) != (20, 2)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string").write.parquet(f"{tmp_path}/conversations.parquet")
    have = {(c, t) for c, t, _ in turns}
    want = {(c, x, y) for c, x in have for _, y in have if x < y and all((c, t) in have for t in range(x, y + 1))}
    assert {(r.C, r.X, r.Y) for r in catalog.queries()["proof_terms"](spark, str(tmp_path)).collect()} == want


def test_no_recursion_is_cut_off(spark, monkeypatch):
    """Recursion has no limit unless one is given; a registered query that one cuts off fails."""
    assert catalog.Session(spark).max_iterations is None
    assert Engine(spark, Core(), {}, {}).max_iterations is None
    monkeypatch.setattr(catalog, "Session", lambda s: Session(s, max_iterations=3))
    with pytest.raises(RuntimeError, match="fib"):
        catalog.queries()["recursive_arithmetic"](spark, SF)
