"""Every query that has SQL gives the same rows as DuckDB does."""

import pytest

from inkwell.plans.queries import QUERIES


def rounded(rows):
    def value(v):
        return round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_as_sql(spark, duck, sf, name):
    query, sql = QUERIES[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert rounded(tuple(r[c] for c in columns) for r in df.collect()) == rounded(expected)


def test_throttle(spark, sf):
    rows = {r["user_id"]: r["n"] for r in QUERIES["throttled_progress"][0](spark, sf).collect()}
    times: dict[int, list[int]] = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "unix_millis(cast(ts as timestamp)) as t").collect():
        times.setdefault(r["user_id"], []).append(r["t"])
    for user, ts in times.items():
        n, last = 0, None
        for t in sorted(ts):
            if last is None or t - last > 3_600_000:
                n, last = n + 1, t
        assert rows[user] == n


def test_cards_same_as_sql_at_later_keys(spark, tmp_path):
    """Keys that spell names and firms with a short trade inside a word ("Kinnu", "Ainna")."""
    import duckdb

    path = f"{tmp_path}/supplier.parquet"
    duckdb.sql(f"copy (select unnest([187, 365, 807, 808, 11886, 15661, 15665, 15669]) :: bigint as s_suppkey, 'x' as s_name) to '{path}' (format parquet)")
    query, sql = QUERIES["universal_cards"]
    df = query(spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view supplier as select * from '{path}'")
    assert rounded(df.collect()) == rounded(c.execute(f"select {', '.join(df.columns)} from ({sql})").fetchall())
