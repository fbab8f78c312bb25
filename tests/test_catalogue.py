"""Each query against its SQL on the smallest tables, and without the optional subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
from tools.compare import rows_of  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in catalogue.oracle_sql():
        cur = con.execute(catalogue.oracle_sql()[name])
        columns = [x[0] for x in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows_of(columns, cur.fetchall())


def test_whole_jobs_take_all_rows(spark, sf, con):
    """Division, roots, suppliers and parts without a filter on ids, against brute force."""
    q, keys = catalogue.queries(), lambda sql: {x[0] for x in con.execute(sql).fetchall()}
    have = {}
    for i, c in con.execute("SELECT DISTINCT o_custkey, o_orderpriority FROM orders").fetchall():
        have.setdefault(i, set()).add(c)
    def spelled(name):
        """Pairs of different ids behind members and pairs of sets."""
        rows = [tuple(x) for x in q[name](spark, sf).collect()]
        of = {}
        for part, i, s in rows:
            if part == "member":
                of.setdefault(s, []).append(i)
        return {(a, b) for part, s, u in rows if part == "pair" for a in of[s] for b in of[u] if a != b}

    assert spelled("relational_division") == {(a, b) for a in have for b in have if a != b and have[a] <= have[b]}
    fits = lambda a, b: b % 4 == 0 or (a % 4 == 2 and b % 4 == 2) or (a % 4 != 2 and b % 4 == 1)
    assert spelled("related_labs") == {(a, b) for a in have for b in have if a != b and fits(a, b) and have[a] <= have[b]}
    assert {x.id for x in q["closure_refs"](spark, sf).collect()} >= keys("SELECT 'o' || o_orderkey FROM orders")
    assert {c for x in q["changed_defaults_grouped"](spark, sf).collect() for c in x.components.split(",")} == keys("SELECT l_suppkey::VARCHAR FROM lineitem")
    assert sum(len(x.tags.split(",")) for x in q["minor_order"](spark, sf).collect()) == con.execute("SELECT count(*) FROM part").fetchall()[0][0]


def test_scanners_run_in_all_tasks(spark, sf):
    """The file of part is one small piece, yet its rows are scanned by as many tasks as the cluster has cores."""
    rows = catalogue.queries()["scanner_shapes"](spark, sf)
    used = rows.groupBy(F.spark_partition_id()).count().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_division_holds_the_pairs_of_ids(spark, sf, con):
    """All pairs of customers are rows of the result, not only pairs of the sets they belong to."""
    have = {}
    for i, c in con.execute("SELECT DISTINCT o_custkey, o_orderpriority FROM orders").fetchall():
        have.setdefault(i, set()).add(c)
    got = sorted((x.id, x.related) for x in catalogue.queries()["relational_division"](spark, sf).collect() if x.part == "related")
    assert got == sorted((a, b) for a in have for b in have if a != b and have[a] <= have[b])


def test_related_labs_hold_the_pairs_of_ids(spark, sf, con):
    have = {}
    for i, c in con.execute("SELECT DISTINCT o_custkey, o_orderpriority FROM orders").fetchall():
        have.setdefault(i, set()).add(c)
    fits = lambda a, b: b % 4 == 0 or (a % 4 == 2 and b % 4 == 2) or (a % 4 != 2 and b % 4 == 1)
    got = sorted((x.id, x.related) for x in catalogue.queries()["related_labs"](spark, sf).collect() if x.part == "related")
    assert got == sorted((a, b) for a in have for b in have if a != b and fits(a, b) and have[a] <= have[b])


def test_division_in_many_blocks(spark):
    from sparkloom.operators import joins as J

    c = spark.range(60).selectExpr("id", "explode(slice(array('x', 'y', 'z'), 1, cast(id % 3 as int) + 1)) as c")
    s, t, pairs = J.division_sets(c, c, "id", "id", "c")
    got = sorted(map(tuple, J.spelled_out(s, t, pairs, block=4).collect()))
    assert got == sorted((a, b) for a in range(60) for b in range(60) if a != b and a % 3 <= b % 3)


@pytest.mark.parametrize("name", ["related_labs", "relational_division"])
def test_pairs_of_ids_come_from_all_tasks(spark, sf, name):
    """Blocks of ids are few bytes, yet the pairs behind them are spelled out by as many tasks as the cluster has cores."""
    rows = catalogue.queries()[name](spark, sf).filter("part = 'related'")
    used = rows.groupBy(F.spark_partition_id()).count().count()
    assert used >= spark.sparkContext.defaultParallelism


def test_entry_works_without_the_optional_part():
    code = "import sys; sys.modules['sparkloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'page_index' in e.queries() and not any(k.startswith('op1_') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) .*\bllm\b", p.read_text())
