import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from paperledger.operators import measures as M


def groups(rows):
    out = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            out[k].append(v)
    return out


def table(spark, n=4000):
    rng = random.Random(1)
    # One group holds most rows, one is a single value, one has extremes, one only nulls.
    rows = [("hot", rng.randint(-(10**6), 10**6), rng.randint(0, 900)) for _ in range(n)]
    rows += [("same", 7, 1)] * 50 + [("two", 1, 1), ("two", 2, 2), ("wide", -(2**62), 1), ("wide", 2**62, 2), ("wide", 5, 3)]
    rows += [(None, k, k) for k in range(9)] + [("none", None, None)] * 3
    rows += [(rng.choice("abc"), rng.randint(0, 40), rng.randint(0, 40)) for _ in range(300)]
    return rows, spark.createDataFrame(rows, "k string, v long, m long").repartition(5)


def test_medians_are_exact(spark):
    rows, df = table(spark)
    found = {r["k"]: (r["n"], r["median"]) for r in M.exact_median(df, ["k"], "v").collect()}
    assert found == {k: (len(v), float(statistics.median(v))) for k, v in groups(rows).items()}


def test_different_members_are_exact(spark):
    rows, df = table(spark)
    found = {r["k"]: r["different"] for r in M.exact_distinct(df, ["k"], "m").collect()}
    assert found == {k: len({m for a, _, m in rows if a == k and m is not None}) for k in {r[0] for r in rows} - {"none"}}


def test_sketches_of_days_merge_to_a_whole(spark):
    rows, df = table(spark, 20_000)
    days = M.sketches(df.filter("k = 'hot'").withColumn("day", F.col("v") % 7), ["k", "day"], "v", "m")
    assert days.count() > 7
    (whole,) = M.merged_sketches(days, F.col("k")).collect()
    values = sorted(v for k, v, _ in rows if k == "hot")
    rank = sum(v <= whole["median"] for v in values) / len(values)
    assert whole["n"] == len(values) and abs(rank - 0.5) < 0.014
    assert abs(whole["different"] - 901) < 0.02 * 901


def test_no_group_is_collected(spark):
    _, df = table(spark, 10)
    plan = M.exact_median(df, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "collect_list" not in plan and "percentile" not in plan
