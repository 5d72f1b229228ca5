"""Registered queries against their expected SQL on the smallest data, and stream against batch."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = [
    "s_05_nav_by_announcement", "s_09_forward_fill", "j_03_asof_join", "f_15_adx_14d", "f_34_dd_duration_60d", "f_55_atr_wilder", "w_01_ema", "x_02_winsorise", "x_11_ols_residual",
    "a_02_rank_ic", "a_05_ic_summary", "g_03_market_regime", "p_05_period_returns", "c_06_out_of_sample_ic", "c_06_out_of_sample_ic_blocks", "m_05_false_discovery_control_split",
    "r_11_drawdown_episodes", "st_02_newest_wins", "st_03_daily_bars",
]


def norm(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(str([norm(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    got = sorted(str([norm(r[c]) for c in cols]) for r in df.collect())
    assert len(got) == len(want)
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    assert len(diff) <= len(got) * 0.001, diff[:3]


def test_entry(spark):
    df = entry.entry(spark)
    assert "mean_ic" in df.columns and df.count() > 0


def test_stream_equals_batch(spark, sf):
    q = entry.queries()
    key = lambda d: sorted((r.combo, r.period, r.symbol, r.hold_days) for r in d.collect())
    assert key(q["st_04_stateful_portfolio"](spark, sf)) == key(q["p_04_hysteresis_selection"](spark, sf))


def test_state_mismatch_starts_cold(spark, sf):
    notes = [r.note for r in entry.queries()["st_05_state_validation"](spark, sf).collect()]
    assert sum(n.startswith("cold start") for n in notes) == 3


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
