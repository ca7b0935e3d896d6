"""Every query with SQL gives the SQL's rows on the smallest tables; the flagship runs; the subpackage isn't needed."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__ as entry_points
from sparrel.plans import catalog

from . import oracle

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name == "hotelling_t2":
        pytest.skip("compared with numpy below")
    df = catalog.QUERIES[name](spark, SF)
    assert oracle.differences(df, con, catalog.SQL[name]) == "" if name in catalog.SQL else df.count() > 0


def test_flagship(spark):
    assert entry_points.entry(spark).columns == ["batch", "row", "c0", "c1"]


def test_names_and_sql_belong_together():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"hotelling_t2"}


def test_moments_and_checks_of_all_coordinates(spark):
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], dtype=np.float64)
    n, p = x.shape
    if n > p:
        got = catalog.hotelling_t2(spark, SF).first()
        assert abs(got.statistic - n * x.mean(0) @ np.linalg.solve(np.cov(x.T), x.mean(0))) < 1e-3 * got.statistic + 1e-3
    else:
        with pytest.raises(ValueError):
            catalog.hotelling_t2(spark, SF)


def test_library_stands_without_the_subpackage(tmp_path):
    for name in ("sparrel", "__spark_entry__.py"):
        source = ROOT / name
        for p in [source] if source.is_file() else [q for q in source.rglob("*.py") if "llm" not in q.parts]:
            (tmp_path / p.relative_to(ROOT)).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p.relative_to(ROOT)).write_text(p.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), sorted(x for x in e.queries() if x.startswith('op') or x == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.strip() == f"{len(catalog.QUERIES)} []", out.stderr
