"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import duckdb
import pytest

from corpusqa.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connected(sf_dir)


@pytest.mark.parametrize("name", ["d1_section_repeats", "d2_section_repeats_strict"])
def test_repeats_at_ten_times_the_size(spark, sf_dir, name):
    """Rare windows, e.g. with marks outside the stripped ones, occur there only."""
    larger = sf_dir.replace("0.001", "0.01")
    test_query(spark, larger, connected(larger), name)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())


def test_moved_sections_tell_the_likeness_of_copies_in_full(spark, tmp_path):
    """9's copy is renamed from 58, so that 58's own successor, a line longer, is a copy: 15 of 16 lines, no 0.9."""
    text = "\n".join(f"line {i}" for i in range(15))
    spark.createDataFrame([(9, text, "a"), (58, text, "a")], "doc_id BIGINT, text STRING, source STRING").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["corpus", "doc_id", "status", "from_corpus", "from_doc_id", "likeness"]
    got = sorted(tuple(r) for r in registry.queries()["i4_moved_sections"](spark, str(tmp_path)).select(*columns).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(duck.sql(registry.oracle_sql()["i4_moved_sections"]).select(*columns).fetchall())
    assert ("a", 20000058, "copied", "a", 9, 938) in got
