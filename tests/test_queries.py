"""Every query of the engine's own operators, against its SQL where it has one."""

import pytest

from navloom.plans import registry
from tests.conftest import SF

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_equals_sql(name, spark, same):
    same(QUERIES[name](spark, SF), SQL[name])


def test_entry_has_rows_and_stream_equals_batch(spark):
    batch = {(r["pair_id"], r["distance"], r["is_partial"]) for r in QUERIES["route_distance"](spark, SF).collect()}
    stream = {(r["pair_id"], r["distance"], r["is_partial"]) for r in QUERIES["stream_routes"](spark, SF).collect()}
    assert batch and batch == stream


@pytest.mark.parametrize("name", ["box_query", "tree_query", "nearest_poly", "link_portal", "offmesh_links", "terrain_f32", "tile_load"])
def test_no_nested_loops(name, spark):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["finite_check"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in plan and "PushedFilters: []" not in plan


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    from tests.conftest import ROOT

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[0]) > 80, done.stderr[-500:]


def test_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(ROOT / "navloom", tmp_path / "navloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": "/root"}, capture_output=True, text=True, timeout=120)
    names = done.stdout.split()
    assert done.returncode == 0 and "route_distance" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names), done.stderr[-500:]
