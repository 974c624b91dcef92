import random
from collections import defaultdict

from pyspark.sql import functions as F

from lipika.operators.prefix import with_before, with_number


def test_hot_group_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), k, rng.choice([0, 1, 5, None])) for k in range(2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, k int, n int")
    got = {(r["g"], r["k"]): r["before"] for r in with_before(frame, F.coalesce("n", F.lit(0)), ["k"], ["g"], slices=16).collect()}
    sums, want = defaultdict(int), {}
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        want[g, k] = sums[g]
        sums[g] += n or 0
    assert got == want
    numbers = sorted(r["number"] for r in with_number(frame.withColumn("k", F.lit(1)), ["k"]).collect())
    assert numbers == list(range(1, 2001))  # all tie: still each number once
    assert with_number(frame.limit(0), ["k"], ["g"]).count() == 0
