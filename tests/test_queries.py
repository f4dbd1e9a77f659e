"""Every registered query of the domain against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans import audits, domain, relational, scoring, stored, temporal
from tidemark.plans.views import TABLES, Views

MADE = temporal.R.made | relational.R.made | domain.R.made | audits.R.made | scoring.R.made | stored.R.made
SQL = temporal.R.sql | relational.R.sql | domain.R.sql | audits.R.sql | scoring.R.sql | stored.R.sql


def cells(rows, columns):
    def plain(x):
        if x is None or x != x:
            return ""
        return x if isinstance(x, (bool, str)) else f"{float(x):.6g}"

    return sorted(tuple(str(plain(r[c])) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    got = MADE[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert cells([r.asDict() for r in got.collect()], columns) == cells(rows, columns)


@pytest.mark.parametrize("name", sorted(set(MADE) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert MADE[name](spark, sf_dir).schema.names


def test_entry_counts(spark, sf_dir):
    out = temporal.flagship(Views(spark, sf_dir)).collect()
    assert [r["rank"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(1, len(out) + 1))


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 120 and set(e.oracle_sql()) <= set(e.queries())"], cwd=__file__.rsplit("/", 2)[0], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
