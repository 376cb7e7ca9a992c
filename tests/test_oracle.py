"""Every query with an SQL twin gives the twin's rows."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from framewright.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if hasattr(v, "tolist") and not isinstance(v, int | float | bool):
            v = v.tolist()
        if v is None or (not isinstance(v, list) and pd.isna(v)):
            return "NULL"
        return str(v) if isinstance(v, bool | str | list) else str(round(float(v), 6))

    df = df[sorted(df.columns)]
    return sorted(tuple(map(value, r)) for r in df.itertuples(index=False))


def twin(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    got, expected = QUERIES[name](spark, sf_dir).toPandas(), twin(ORACLE_SQL[name], sf_dir)
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
    assert len(got)


def test_videos_stand_by_number_in_a_run_from_files(spark, sf_dir, tmp_path):
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    (tmp_path / "embeddings.parquet").unlink()
    few = pd.read_parquet(f"{sf_dir}/embeddings.parquet").query("vec_id < 10")
    pd.concat([few.assign(vec_id=few.vec_id + 100 * n) for n in (1, 2, 10)]).to_parquet(tmp_path / "embeddings.parquet", index=False)
    got = QUERIES["annotate_files"](spark, str(tmp_path)).toPandas()
    assert got.sort_values("place").video_id.tolist() == [1, 2, 10]
    assert rows(got) == rows(twin(ORACLE_SQL["annotate_files"], str(tmp_path)))
