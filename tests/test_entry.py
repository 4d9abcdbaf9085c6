import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from tabwatch.sources.tables import TABLES

SF = os.environ.get("TABWATCH_ORACLE_SF", "/root/testdata/sf0.001")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) == {"feature", "psi", "mean_shift", "alert"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = [n for n in q if not (n == "pipeline" or n.startswith("op"))]  # the optional group has its own tests
    assert len(own) == 80 and all(name.split("_")[0][0] in "abcdefghi" for name in own)


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        # whole numbers alike, whether a column with nulls came as floats or as nullable integers
        return "nan" if math.isnan(v) else int(v) if v.is_integer() else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = []
    for r in pdf[cols].itertuples(index=False):
        out.append(tuple(repr(_norm(None if x is pd.NaT else x)) for x in r))
    return sorted(out)


def _nulls(pdf, like):
    """``pdf`` with None instead of NaN in whole-number columns, which pandas turns to floats for nulls."""
    whole = [c for c in pdf.columns if str(like[c].dtype) in ("Int64", "Int32") or pdf[c].dtype == object and like[c].dtype != object]
    return pdf.assign(**{c: pdf[c].astype(object).where(pdf[c].notna(), None) for c in whole})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF).toPandas()
    odf = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert _rows(_nulls(sdf, odf)) == _rows(_nulls(odf, sdf))


def test_udf_query_from_foreign_working_dir(tmp_path):
    """Executors must not need the package on their path (the UDF ships by value)."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', len(E.queries()['e7_chi_square_test'](s, %r).collect()))\n" % (repo, SF)
    )
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert "ROWS 2" in out.stdout, out.stderr[-2000:]
