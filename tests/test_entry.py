"""The driver's contract, and the guard that lets the library live without its training-data part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["qc_flags", "method_matrix", "loo_linear_calibration", "horizon_hierarchy", "knn_impute", "compare_outer_join", "skeletal_features", "lateral_diagnostic", "mask_feet", "mask_head", "mask_contact", "mask_support", "mask_head_and_feet", "image_manifest", "qc_report_row_level", "tabular_report", "experiment_1", "lateral_scale", "crown_sweep", "head_width_sweep", "comparison_matrix", "ridge_coefficients"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem", "events", "embeddings", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    plain = lambda v: None if v is None else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    order = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert order(got.select(*cols).collect()) == order(want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_without_training_part():
    code = "import sys; sys.modules['metrikon.llm'] = None\nimport __spark_entry__ as e; print(len(e.queries()), 'op1_transport_stream' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert out.stdout.split()[1] == "False", out.stderr
