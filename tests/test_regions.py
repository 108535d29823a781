"""Points in a table of regions against the filter for one ring."""

import random

from curbside.operators import filters, regions


def text(points):
    return ",".join(f"{x} {y}" for x, y in points)


def some_rings(rng, n):
    rings = []
    for k in range(n):
        x, y, size = rng.uniform(-90, -80), rng.uniform(40, 45), rng.choice([0.001, 0.05, 0.3, 2.0, 40.0])
        if k % 3 == 0:
            points = [(x, y), (x + size, y), (x + size, y + size / 2), (x, y + size / 2)]
        else:
            points = [(x + rng.uniform(-size, size), y + rng.uniform(-size, size)) for _ in range(rng.randint(3, 9))]
        rings.append(text(points + points[:1]))
    return rings


def test_like_the_filter_for_each_ring(spark):
    rng = random.Random(1)
    rings = some_rings(rng, 30)
    points = [(n, rng.uniform(-91, -79), rng.uniform(39, 46)) for n in range(700)]
    for ring in rings:  # on corners and edges, and close by
        own = filters.parse_ring(ring)
        points += [(len(points) + k, *p) for k, p in enumerate(own[:2])]
        points += [(len(points) + k, p[0] + rng.uniform(-0.002, 0.002), p[1] + rng.uniform(-0.002, 0.002)) for k, p in enumerate(own)]
    points += [(-1, None, 42.0), (-2, -85.0, None), (-3, float("nan"), 42.0)]
    places = spark.createDataFrame(points, "i int, lon double, lat double").repartition(5)
    table = spark.createDataFrame(list(enumerate(rings)), "region int, ring string")
    out = regions.join_regions(places, table)
    assert out.columns == ["i", "lon", "lat", "region"]
    got = {(r["i"], r["region"]) for r in out.collect()}
    want = {(r["i"], n) for n, ring in enumerate(rings) for r in filters.filter_region(places, ring).collect()}
    assert got == want and len(got) > 500 and out.count() == len(got)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_odd_rings(spark):
    places = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 9.0, 9.0)], "i int, lon double, lat double")
    table = spark.createDataFrame(
        [(1, "0 0,2 0,2 2,0 2,0 0"), (2, None), (3, ""), (4, "not a ring"), (5, "0 0,1"), (6, "5 5,5 5,5 5"), (7, "0 0,4 0,0 4,0 0"), (8, "1 1,1 1")],
        "region int, ring string",
    )
    got = sorted((r["i"], r["region"]) for r in regions.join_regions(places, table).collect())
    assert got == [(1, 1), (1, 1), (1, 7), (1, 7)]
    assert regions.join_regions(places, table.where("false")).count() == 0
    assert regions.join_regions(places.where("false"), table).count() == 0


def test_cells_are_few_and_near(spark):
    rng = random.Random(2)
    table = spark.createDataFrame(list(enumerate(some_rings(rng, 40))), "region int, ring string")
    counts = [r["count"] for r in regions.covering(regions.with_shape(table)).groupBy("region").count().collect()]
    assert len(counts) == 40 and max(counts) <= (2 * regions.SPAN + 2) ** 2


def test_many_rings_are_not_broadcast(spark, tmp_path):
    rng = random.Random(3)
    rings = some_rings(rng, 40)
    points = [(n, rng.uniform(-91, -79), rng.uniform(39, 46)) for n in range(200)]
    points += [(n + 500, *points[n][1:]) for n in range(100)] + [points[0]]
    points += [(-1, None, 42.0), (-2, -85.0, None), (-3, float("nan"), 42.0), (-4, 0.0, 0.0), (-5, -0.0, -0.0)]
    rings.append("-1 -1,1 -1,1 1,-1 1,-1 -1")
    spark.createDataFrame(points, "i int, lon double, lat double").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame(list(enumerate(rings)), "region int, ring string").write.parquet(str(tmp_path / "r"))
    places, table = spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "r"))
    out = regions.join_regions(places, table, broadcast_rings=40)
    assert out.columns == ["i", "lon", "lat", "region"]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["i"], r["region"]) for r in out.collect())
    want = sorted((r["i"], n) for n, ring in enumerate(rings) for r in filters.filter_region(places, ring).collect())
    assert got == want and len(got) > 100
    assert got == sorted((r["i"], r["region"]) for r in regions.join_regions(places, table).collect())
