"""Every query against its SQL on another engine, over some of the vectors, odd ones among them."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tilework.plans import queries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("vectors")
    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").slice(0, 40)
    pq.write_table(table, path / "embeddings.parquet")
    return str(path)


def rows(pdf):
    out = [tuple(None if x is None or x != x else x for x in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.REGISTRY))
def test_query_equals_sql(spark, folder, name):
    run, sql = queries.REGISTRY[name]
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        want = con.sql(sql).df()
    got = run(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_two_colours_are_left(spark, folder):
    got = queries.queries()["reduced_to_two_colours"](spark, folder)
    assert got.groupBy("img_id").agg({"area": "sum"}).where("`sum(area)` <> 64").isEmpty()
    assert got.select("img_id", "rgb").distinct().groupBy("img_id").count().where("count > 2").isEmpty()


def test_odd_vectors_are_no_pictures(spark):
    from tilework.sources.tiles import tile_pixels

    df = spark.createDataFrame([(1, None), (2, [0.0] * 63), (3, [0.0] * 63 + [None]), (4, [float("nan")] * 64), (5, [0.1] * 64)], "vec_id long, embedding array<float>")
    assert [r.img_id for r in tile_pixels(df).select("img_id").distinct().collect()] == [5]
    assert tile_pixels(df.where("vec_id < 0")).isEmpty()


def test_entry_registers_what_it_can():
    names = entry.queries()
    assert set(queries.queries()) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["img_id", "regions", "colours", "largest", "sides"]


def test_same_result_in_any_partitioning(spark, folder):
    px = queries._pixels(spark, folder)
    from tilework.operators import regions

    def table(n):
        return rows(regions.region_table(regions.label_runs(queries.tiles.row_runs(px.repartition(n)))).toPandas())

    assert table(1) == table(7)


def test_pyarrow_tables_stay_readable(folder):
    assert pa.types.is_list(pq.read_schema(f"{folder}/embeddings.parquet").field("embedding").type)
