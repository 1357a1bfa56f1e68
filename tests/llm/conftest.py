import pytest


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_mid():
    return "/root/testdata/sf0.01"


@pytest.fixture
def llm_oracle(spark):
    """Query and oracle SQL of a name give the same rows."""
    import duckdb

    from logsift.llm import ORACLE, REGISTRY

    def same(name, sf_dir):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in ("documents", "pages", "conversations", "labels", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        con.execute(ORACLE[name])
        names = sorted(c[0] for c in con.description)
        want = sorted((str(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE[name]})").fetchall()))
        df = REGISTRY[name](spark, sf_dir)
        assert sorted(df.columns) == names
        got = sorted(str(tuple(r)) for r in df.select(*names).collect())
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert g == w
    return same
