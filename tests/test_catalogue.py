import pytest

from fieldloom.plans import catalogue

from .compare import SF, same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_pulse_timer_against_a_loop(spark):
    got = {r.event_id: (r.q, r.et_us) for r in catalogue.QUERIES["tp_timer"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    user, prev, began, want = None, False, None, {}
    for r in rows:
        if r.user_id != user:
            user, prev, began = r.user_id, False, None
        t, v = r.ts.timestamp() * 1_000_000, r.value > 20
        if began is not None and t - began >= 14_400_000_000:
            began = None
        if began is None and v and not prev:
            began = t
        prev = v
        want[r.event_id] = (began is not None, round(t - began) if began is not None else 0)
    assert got == want
