"""Drawing for customers who have had most of the catalogue."""

from pyspark.sql import functions as F

from ledgerloom.operators.drawing import expanded


def test_short_tasks_are_filled_up(spark, rows):
    catalog = spark.range(400).select(F.col("id").alias("item_id"), F.col("id").alias("idx"))
    tasks = spark.createDataFrame([(1,), (2,), (3,), (4,)], "user_id bigint")
    had = {1: 0, 2: 320, 3: 390, 4: 400}
    seen = spark.createDataFrame([(u, i) for u, n in had.items() for i in range(n)], "user_id bigint, item_id bigint")
    draw = (F.col("user_id") * 7919 + F.col("try") * 104729) % 400
    got = rows(expanded(tasks, "user_id", catalog, seen, draw, 19, 64), "user_id", "pos", "item_id")
    for u, n in had.items():
        mine = [(p, i) for x, p, i in got if x == u]
        assert sorted(p for p, _ in mine) == list(range(1, min(19, 400 - n) + 1))
        assert len({i for _, i in mine}) == len(mine) and all(i >= n for _, i in mine)
