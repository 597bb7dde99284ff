"""One pass over the stored table, and results against a plain merge."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from floatline.operators import upserts as U
from floatline.schemas import LOCKUPS

AS_OF = dt.date(2001, 6, 15)


def frames(spark, seed):
    rng = random.Random(seed)

    def row(i):
        return (rng.choice([None, 90, 180]), rng.choice([None, dt.date(2001, 1, 2)]), rng.choice([None, dt.date(2001, 7, 2)]),
                rng.random() < 0.5, rng.choice([None, "note"]), rng.choice([None, 5.0]), rng.choice(["low", "high"]))
    keys = rng.sample([(i, f) for i in range(1, 12) for f in range(1, 6)], 40)
    stored = [(100 + k, *key, *row(k), dt.date(2000, 1, 1)) for k, key in enumerate(keys[:25])]
    stored.append((900, 3, None, *row(0), dt.date(2000, 1, 1)))  # a row without a filing matches nothing
    fresh = [(*key, *[v for j, v in enumerate(row(0)) if j != 5]) for key in keys[15:]]
    names = "issuer_id long, filing_id long, lockup_days int, lockup_start_date date, lockup_end_date date, " \
            "is_staged_unlock boolean, unlock_notes string, confidence string"
    return stored, fresh, spark.createDataFrame(stored, LOCKUPS), spark.createDataFrame(fresh, names)


def plain(stored, fresh, force):
    new = {f[:2]: f for f in fresh}
    out = []
    for r in stored:
        f = new.get(r[1:3])
        if f is not None and force:
            r = (r[0], *f[:2], *f[2:7], r[8], f[7], AS_OF)
        out.append(r)
    held = {r[1:3] for r in stored}
    added = sorted(k for k in new if k not in held)
    top = max(r[0] for r in stored)
    return out + [(top + n, *new[k][:2], *new[k][2:7], None, new[k][7], AS_OF) for n, k in enumerate(added, start=1)]


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_lockups_against_a_plain_merge(spark, force, seed):
    stored, fresh, stored_df, fresh_df = frames(spark, seed)
    got = U.upsert_lockups(stored_df, fresh_df, F.lit(AS_OF), force=force).select(*U.LOCKUP_COLS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(stored, fresh, force), key=str)


def test_into_an_empty_table_and_with_nothing_new(spark):
    _, fresh, stored_df, fresh_df = frames(spark, 3)
    into_empty = U.upsert_lockups(stored_df.limit(0), fresh_df, F.lit(AS_OF))
    assert sorted(r["id"] for r in into_empty.collect()) == list(range(1, len(fresh) + 1))
    same = U.upsert_lockups(stored_df, fresh_df.limit(0), F.lit(AS_OF), force=True)
    assert sorted(map(str, same.collect())) == sorted(map(str, stored_df.select(*U.LOCKUP_COLS).collect()))


def test_bucketed_table_is_scanned_once_and_not_shuffled(spark, monkeypatch):
    _, _, stored_df, fresh_df = frames(spark, 4)
    table = U.store_bucketed(stored_df, "upsert_probe", 8)
    plans = []
    write = U.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(U, "materialize", seen)
    try:
        U.upsert_lockups(table, fresh_df, F.lit(AS_OF), force=True).collect()
    finally:
        spark.sql("drop table upsert_probe")
    [plan] = plans
    assert plan.count("FileScan parquet") == 1 and plan.count("FullOuter") == 1
    assert plan.count("Exchange") == 1  # the fresh rows
    stored_side = plan[plan.index("FileScan parquet") - 400:plan.index("FileScan parquet")]
    assert "Bucketed: true" in plan and "Exchange" not in stored_side
