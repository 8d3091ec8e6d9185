"""Every query of the catalogue that has SQL agrees with it on the smallest tables; the others give rows."""

from __future__ import annotations

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def _names():
    from sparkbrief import catalogue

    return sorted(catalogue.queries())


@pytest.mark.parametrize("name", _names())
def test_against_sql(spark, name):
    from sparkbrief import catalogue

    got = catalogue.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(sql)
    assert cols == sorted(want.columns)
    assert rows == sorted(map(str, want.select(*cols).fetchall()))


def test_scores_equal_but_for_rounding_rank_as_in_sql(spark, tmp_path):
    """Products (1 + n)(1 + m) are the same within a conversation, so the last bits of the logarithms decide."""
    from sparkbrief import catalogue

    said = [[(a - 1, p // a - 1) for a in range(2, p) if p % a == 0 and p // a > 1] for p in range(12, 400, 4)]
    rows = [(c, t, "user", "the " * n + "ent " * m) for c, pairs in enumerate(said) for t, (n, m) in enumerate(pairs)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = con.sql(catalogue.oracle_sql()["recall_terms_topk"])
    got = catalogue.queries()["recall_terms_topk"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_briefs_end_as_in_sql(spark, tmp_path):
    """Last lines that the limit of 220 bytes cuts after white space: spaces go, tabs and line ends stay."""
    import shutil

    from sparkbrief import catalogue

    cuts = ("\n", "\n\n", "\t", " ", "  ", " \n", "\n ", "\u3000", "\n\u00a0", "\u00a0\n")
    rows = [(c, 0, "user", "x" * (220 - len(x.encode())) + x + "more") for c, x in enumerate(cuts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    shutil.copy(f"{SF}/events.parquet", tmp_path)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    con.sql(f"create view events as select * from '{SF}/events.parquet'")
    want = con.sql(catalogue.oracle_sql()["brief_text"])
    got = catalogue.queries()["brief_text"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
