import sys
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry
from check_queries import TABLES, compare

from panelworks.catalog import load_all
from panelworks.operators.stage import stage_dir

WITHOUT_SQL = {"pf_04_keep_overlap_equity"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_every_query_has_check_sql_that_binds(con):
    sqls = entry.oracle_sql()
    own = set(load_all())
    assert own <= set(entry.queries()) and own - set(sqls) == WITHOUT_SQL
    for sql in sqls.values():
        types = [r[1] for r in con.execute("DESCRIBE " + sql).fetchall()]
        assert not any("DECIMAL" in t or "HUGEINT" in t for t in types)


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["date", "rank", "symbol", "score"] and out.count() > 100


@pytest.mark.parametrize(
    "name",
    [
        "src_06_dense_panel",
        "ts_03_align_last_row",
        "ind_09_macd",
        "ind_13_variable_week_high",
        "xs_01_wide_cross_section_rank",
        "fnd_06_ratios",
        "join_01_snapshot_membership",
        "fc_03_batch_scoring",
        "plan_trend_picks",
    ],
)
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name], con)
    assert ok, note


@pytest.mark.parametrize(
    "master, shared, folder",
    [("yarn", "hdfs:/ck/", "hdfs:/ck"), ("local[2]", None, "/w/_stage"), ("local", None, "/w/_stage"), ("yarn", None, None), ("local-cluster[2,1,1024]", None, None)],
)
def test_stages_go_to_a_shared_folder(master, shared, folder):
    settings = {"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": "/w/"}
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: settings[name] or default), sparkContext=SimpleNamespace(master=master)
    )
    if folder is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            stage_dir(session)
    else:
        assert stage_dir(session) == folder
