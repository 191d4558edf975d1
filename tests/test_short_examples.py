"""Queries against their SQL where examples have one to five regions, as a table's last example may."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["f19_embed_block", "f19_embed_interpolate", "f19_embed_mean", "m14_concept_counts", "m14_estep", "m18_viterbi"]


@pytest.fixture(scope="module")
def short(tmp_path_factory):
    folder = tmp_path_factory.mktemp("short")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id % 5 <= (vec_id // 5) % 5) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_fewer_regions(spark, short, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{short}/embeddings.parquet'")
    assert {n for (n,) in con.sql("SELECT count(*) FROM embeddings GROUP BY vec_id // 5").fetchall()} == {1, 2, 3, 4, 5}
    rel = con.sql(entry.oracle_sql()[name])
    plain = lambda rows: sorted(tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows)
    got, want = plain(map(tuple, entry.queries()[name](spark, short).select(*rel.columns).collect())), plain(rel.fetchall())
    assert len(got) == len(want) and all(a == pytest.approx(b, abs=2e-5) for a, b in zip(got, want, strict=True) if isinstance(a[-1], float) and a[:-1] == b[:-1])
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
