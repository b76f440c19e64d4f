import duckdb
import pytest

from treeloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want, got = db.execute(queries.ORACLE_SQL[name]).fetchdf(), queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(tuple(map(str, row)) for row in df[columns].to_numpy().tolist())
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_tensors_have_production_lengths(spark, sf_dir):
    from treeloom.functions import tensors

    assert {len(r["values"]) for r in queries._flat(spark, sf_dir).collect()} == {2000}
    nested = tensors.nested_tensor(queries._inputs(spark, sf_dir), features=("region",)).collect()
    assert {(len(r["values"]), len(w)) for r in nested for w in r["values"]} == {(300, 20)}


def test_pruning_goes_on_for_several_rounds(spark, sf_dir):
    """The table of the prune query needs more than two rounds, and fewer than its SQL has."""
    from treeloom.plans import pipeline

    left = [pipeline.accepted(pipeline.prune(queries.view(spark, sf_dir, queries.BINARY), queries.FAR, rounds=k)).count() for k in (1, 2, 3, queries.ROUNDS - 1)]
    assert left[0] > left[1] > left[2] >= left[3] == queries.QUERIES["prune"](spark, sf_dir).count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
