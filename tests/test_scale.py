"""Work that has to stay bounded as tables grow: results by brute force, and how much is done for them."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessellar.functions import numbers as N
from tessellar.operators import chunking, risk

POINT, PLACE = "point_id int, point_lat double, point_lon double", "equipment_id int, lat double, lon double"


def metres(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    x = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * N.EARTH_RADIUS_M * math.asin(math.sqrt(x))


def by_product(points, places, radius):
    return sorted((p[0], e[0], round(d, 3)) for p in points for e in places if None not in p + e and (d := metres(*p[1:], *e[1:])) <= radius)


def found(rows):
    return sorted((r.point_id, r.equipment_id, r.distance_m) for r in rows.collect())


def test_radius_takes_each_distance_once_for_two_positions(spark, monkeypatch):
    rng = random.Random(1)
    at = [(35 + rng.random() / 20, 129 + rng.random() / 25) for _ in range(40)]
    points = [(i, *at[i % 40]) for i in range(1200)] + [(7, *at[7]), (-1, None, 129.0), (-2, 35.0, float("inf"))]
    places = [(i, *at[i * 7 % 40]) for i in range(400)] + [(9, 35.0, None)]
    taken = spark.sparkContext.accumulator(0)

    def counted(*where):
        @F.udf("double")
        def distance(*x):
            taken.add(1)
            return metres(*x)

        return distance(*where)

    expected = by_product([p for p in points if p[0] != -2], places, 400)
    frames = spark.createDataFrame(points, POINT), spark.createDataFrame(places, PLACE)
    assert found(risk.within_radius(*frames, 400.0, digits=3)) == expected
    monkeypatch.setattr(risk, "haversine_m", counted)
    assert len(risk.within_radius(*frames, 400.0).collect()) == len(expected) > 12000
    assert taken.value <= 2 * 40 * 40  # in the filter and in the result at most; each point with each place near it would be over 24000


def test_radius_deals_keys_with_many_rows_to_several_tasks(spark):
    points = [(i, 35.0 + i % 3 / 1000, 129.0) for i in range(300)]
    places = [(i, 35.0 + i % 2 / 1000, 129.0 + i % 2 / 1000) for i in range(100)]
    frames = spark.createDataFrame(points, POINT), spark.createDataFrame(places, PLACE)
    whole = by_product(points, places, 200)
    assert found(risk.within_radius(*frames, 200.0, digits=3, most=7)) == whole
    pieces = risk.in_blocks(frames[0].select(F.lit(1).alias("k")).limit(1), frames[1].withColumn("k", F.lit(1)), ["k"], 7)
    by_task = pieces.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 100 and len(by_task) > 1


def test_radius_over_the_date_line_and_near_the_poles(spark):
    rng = random.Random(2)
    for lat, lon, radius in ((10.0, 180.0, 300.0), (84.0, 20.0, 500.0), (89.999, 0.0, 400.0), (-89.998, 0.0, 400.0), (-70.0, -180.0, 20000.0), (0.0, 0.0, 2.0e6)):
        wide = 180.0 if abs(lat) > 89 else 3 * radius / 111_000 / math.cos(math.radians(lat))
        near = lambda: (max(-90.0, min(90.0, lat + (rng.random() - 0.5) * 4 * radius / 111_000)), (lon + (rng.random() * 2 - 1) * wide + 180) % 360 - 180)  # noqa: B023, E731
        points, places = [(i, *near()) for i in range(60)], [(i, *near()) for i in range(60)]
        got = found(risk.within_radius(spark.createDataFrame(points, POINT), spark.createDataFrame(places, PLACE), radius, digits=3))
        expected = by_product(points, places, radius)
        assert [x[:2] for x in got] == [x[:2] for x in expected] and len(expected) > 50
        assert all(abs(a[2] - b[2]) < 0.0015 for a, b in zip(got, expected, strict=True))


def outlined(rows):
    """(document, order, level, title, path) by a stack; a heading without level closes none and is closed by none."""
    out, last = [], lambda x: (x is None, x)
    for document in {r[0] for r in rows}:
        stack = []
        for row in sorted((r for r in rows if r[0] == document), key=lambda r: [*map(last, r[1:4])]):
            while stack and None not in (stack[-1][0], row[2]) and stack[-1][0] >= row[2]:
                stack.pop()
            stack.append(row[2:4])
            out.append((*row[:4], tuple(t for _, t in stack)))
    return Counter(out)


HEADINGS = "document long, ord long, level int, title string"


def test_section_paths_of_a_long_document_go_to_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay
    rng = random.Random(3)
    rows = [(1, i // 2, min(9, 1 + int(rng.expovariate(0.5))), f"t{i % 1000}") for i in range(60_000)] + [(2, i, 1 + i % 3, f"u{i}") for i in range(50)]
    got = chunking.with_section_paths(spark.createDataFrame(rows, HEADINGS).repartition(7), "document", "ord", size=5_000).withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((*r[:4], tuple(r.path)) for r in got) == outlined(rows)
    by_task = Counter(r.task for r in got if r.document == 1)
    assert len(by_task) > 1 and max(by_task.values()) < 50_000


def test_section_paths_over_cuts(spark):
    rng = random.Random(4)
    rows = [(rng.choice((1, 2, 3, None)), rng.randrange(900), rng.choice((1, 2, 3, 4, 7)), f"t{rng.randrange(50)}") for _ in range(8_000)]
    rows += [(4, i, 1 if i == 0 else 2 if i == 1 else 3 + i % 2, f"v{i}") for i in range(3_000)]  # the first two stay open over every cut
    rows += [(5, None if i % 9 == 0 else i, None if i in (700, 1500) else 1 + i % 4, None if i % 5 == 0 else f"w{i}") for i in range(2_000)]
    rows += [(6, 1, 2, "same")] * 900
    for size in (100, 700, 250_000):
        got = chunking.with_section_paths(spark.createDataFrame(rows, HEADINGS), "document", "ord", size=size)
        assert got.dtypes == [("document", "bigint"), ("ord", "bigint"), ("level", "int"), ("title", "string"), ("path", "array<string>")]
        assert Counter((*r[:4], tuple(r.path)) for r in got.collect()) == outlined(rows), size
