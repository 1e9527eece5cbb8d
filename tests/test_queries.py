"""Every registered query against its SQL twin, and what its plan may not contain."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql
from __spark_entry__ import queries as registered
from tests.oracle_check import connect, differences
from tripweave.plans import all_queries as queries
from tripweave.plans import all_sql, workspace

SF_DIR = "/root/testdata/sf0.001"
TWINS = all_sql()

#: Pairing everything with everything, and Python in the row path.
FORBIDDEN = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    assert differences(df, con, TWINS[name]) == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not FORBIDDEN.findall(plan)


def test_entry(spark):
    assert entry(spark).count() == 1675


def test_scan_is_narrow(spark):
    plan = queries()["agg_se_c"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["start_station_id:string,end_station_id:string"]


def test_one_scan_for_the_station_table(spark):
    plan = queries()["station_modes"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Join" not in plan


def parts_while_written(spark, monkeypatch) -> dict[str, tuple]:
    """What a task was to read of a file and of a shuffle while a table was written, by the table's name."""
    seen, write = {}, workspace.write_table

    def noted(df, path):
        seen[path.rsplit("/", 1)[1].rsplit("-", 1)[0]] = tuple(spark.conf.get(f"spark.sql.{c}") for c in ("files.maxPartitionBytes", "adaptive.advisoryPartitionSizeInBytes"))
        write(df, path)

    monkeypatch.setattr(workspace, "write_table", noted)
    return seen


def test_keys_that_hardly_repeat_are_counted_in_small_parts(spark, monkeypatch):
    seen, before = parts_while_written(spark, monkeypatch), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    w = workspace.Workspace(spark, SF_DIR)
    assert w.repeated_times.columns == ["start_time", "stop_time"]
    assert seen == {"repeated": ("16m", "16m"), "repeated-times": ("16m", "16m")}
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before


@pytest.mark.parametrize("name", ["key_violations", "key_violation_sizes", "merge_violations", "merge_dupes"])
def test_ride_keys_are_counted_in_small_parts(spark, monkeypatch, name):
    queries()[name](spark, SF_DIR)  # the tables that it shares with others are stored
    seen = parts_while_written(spark, monkeypatch)
    queries()[name](spark, SF_DIR)
    assert list(seen.values()) == [("16m", "16m")]


def test_all_queries_are_registered():
    assert set(queries()) <= set(registered())
    assert set(TWINS) <= set(oracle_sql()) <= set(registered())


@pytest.mark.parametrize("missing", ["public_tokenizers", "tripweave.llm.queries", "corpus_pipeline", "xxhash"])
def test_trip_queries_do_without_what_only_the_corpus_needs(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parent.parent)
    found, twins = (set(line.split()) for line in done.stdout.splitlines())
    assert found == set(queries()) and twins == set(TWINS) and "left out" in done.stderr
