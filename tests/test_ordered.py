"""Order, quantiles, as-of and interval joins, chains and known keys against plain Python or a plain window."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import col as c
from pyspark.sql.window import Window

from reagentql.operators import chains, intervals, ordered
from reagentql.operators import relational as R
from reagentql.operators.known import KnownKeys
from reagentql.sources import sinks

ROWS = [("a", 3.0, 1), ("a", None, 2), (None, 1.0, 3), (None, 2.0, 4), ("b", float("nan"), 5), ("b", 7.0, 6), ("c", None, 7), (None, None, 8), ("a", 3.0, 9)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "g string, v double, id long").repartition(3).cache()


def test_numbers_keep_null_groups(rows):
    want = rows.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy(c("v").asc_nulls_first(), "id")) - 1)
    got = R.numbered(rows, ["g"], "v", [c("id")], "i", "n")
    assert sorted((r.id, r.i) for r in got.collect()) == sorted((r.id, r.i) for r in want.collect())
    assert {(r.g, r.n) for r in got.collect()} == {("a", 3), (None, 3), ("b", 2), ("c", 1)}
    ids = {r.id: r.seq_id for r in R.sequence_ids(rows, "g", "id").collect()}
    assert len(ids) == len(ROWS) and ids[3] == "_00000" and ids[8] == "_00002" and ids[9] == "a_00002"


def test_splits_and_padding_keep_null_groups(spark, rows):
    more = spark.range(50).select(F.when(c("id") % 2 == 0, "x").alias("s"), "id")
    got = R.split_rows(more, "s", "id").groupBy("s", "split").count().collect()
    assert {(r.s, r.split, r["count"]) for r in got} == {(s, n, k) for s in ("x", None) for n, k in (("train", 20), ("valid", 2), ("test", 3))}
    padded = R.pad_rows(rows.select("g", "id"), "g", [c("id")], 4, {"id": F.lit(-1)}).collect()
    by = {g: sorted(r.id for r in padded if r.g == g) for g in ("a", None, "b", "c")}
    assert by == {"a": [-1, 1, 2, 9], None: [-1, 3, 4, 8], "b": [-1, -1, 5, 6], "c": [-1, -1, -1, 7]}
    again = R.rebuilt_ids(rows.withColumn("key", c("id") % 5), "g", "key", "id").collect()
    assert sorted(r.id for r in again) == [1, 2, 3, 4, 5]


def test_quantiles_keep_null_groups(rows):
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in R.exact_quantile(rows, ["g"], "v", share, "q").collect()}
        for g in ("a", None, "b", "c"):
            values = sorted(v for h, v, _ in ROWS if h == g and v is not None and v == v)
            if not values:
                assert got[g] is None
                continue
            at = (len(values) - 1) * share
            low = int(at)
            assert got[g] == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low))
    summary = {r.g: (r.n, r.n_valid, r.median) for r in R.summary(rows.where("NOT isnan(v) OR v IS NULL"), "v", ["g"]).collect()}
    assert summary == {"a": (3, 2, 3.0), None: (3, 2, 1.5), "b": (1, 1, 7.0), "c": (1, 0, None)}


def test_csv_has_every_row(spark, tmp_path):
    rows = spark.createDataFrame([("E", "CCO"), (None, "CCN"), (None, "CC")], "target string, smiles string")
    sinks.write_candidates_csv(rows, str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in (tmp_path / "c").glob("part*")).splitlines()
    assert len([x for x in lines if x.startswith(("E,", ",", '""'))]) == 3


@pytest.fixture()
def many_runs(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_prefix_and_hot_values_fall_into_many_runs(spark, many_runs):
    urls = spark.range(20_000).select(F.concat(F.lit("https://example.org/a/long/common/prefix/"), c("id").cast("string")).alias("u"))
    runs = ordered.sorted_runs(urls, [], [c("u")])
    sizes = [r["count"] for r in runs.groupBy("__run").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 600
    zeros = spark.range(20_000).select(F.when(c("id") % 10 == 0, c("id")).otherwise(0).cast("double").alias("v"))
    sizes = [r["count"] for r in ordered.sorted_runs(zeros, [], [c("v")]).groupBy("__run").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 600
    assert sorted(r.i for r in R.numbered(zeros, [], "v", [], "i").collect()) == list(range(20_000))
    assert R.exact_quantile(zeros, [], "v", 0.95, "q").first().q == pytest.approx(statistics.quantiles([r.v for r in zeros.collect()], n=20, method="inclusive")[-1])


def test_asof_over_run_borders(spark, many_runs):
    rng = random.Random(1)
    left = [(rng.choice(["h", "h", "h", "k", None]), rng.randrange(300), i) for i in range(400)]
    right = [(rng.choice(["h", "h", "k", None]), rng.randrange(300), rng.choice([None, 1.0, 2.0, 3.0]), i) for i in range(60)]
    got = R.asof(spark.createDataFrame(left, "g string, t long, id long"), spark.createDataFrame(right, "g string, t long, v double, w long"), "g", "t", ["v", "w"])
    rank = lambda x: (x is not None, x or 0)
    want = {}
    for g, t, i in left:
        before = [(u, rank(v), w, v) for h, u, v, w in right if h == g and u <= t]
        want[i] = (max(before)[3], max(before)[2]) if before else (None, None)
    assert {r.id: (r.v, r.w) for r in got.collect()} == want and got.columns == ["g", "t", "id", "v", "w"]


def test_long_intervals_are_few_blocks(spark):
    ends = [(0, 10**9), (1, 10**9 + 1), (-5, -5), (-(2**40), 2**40 + 7), (7, 6)]
    df = spark.createDataFrame(ends, "a long, b long").withColumn("blocks", intervals.dyadic_blocks(c("a"), c("b")))
    for r in df.collect():
        if r.a > r.b:
            assert r.blocks is None
            continue
        cells = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.blocks)
        assert len(cells) < 90 and cells[0][0] == r.a and cells[-1][1] == r.b + 1
        assert all(cells[i][1] == cells[i + 1][0] for i in range(len(cells) - 1))
    assert len(df.where("a = 0").first().blocks) < 70


def test_interval_joins_equal_all_pairs(spark):
    rng = random.Random(4)
    spans = [(i, rng.choice([0, 1, None]), s, s + rng.choice([-1.0, 0.0, 0.3, 5.0, 900.0])) for i, s in enumerate([rng.uniform(-50, 50) for _ in range(80)])] + [(99, 0, None, 3.0)]
    points = [(i, rng.choice([0, 1]), rng.choice([None, rng.uniform(-60, 900), 0.0])) for i in range(200)]
    got = R.within_intervals(spark.createDataFrame(points, "p long, g long, at double"), spark.createDataFrame(spans, "s long, g long, low double, high double"), "g", "at", "low", "high", 0.25)
    want = {(p, s) for p, g, at in points for s, h, low, high in spans if at is not None and low is not None and g == h and low <= at <= high}
    assert {(r.p, r.s) for r in got.collect()} == want and got.count() == len(want)
    assert R.within_intervals(spark.createDataFrame(points, "p long, g long, at double"), spark.createDataFrame([], "s long, g long, low double, high double"), "g", "at", "low", "high", 0.25).count() == 0


def test_chains_of_any_depth(spark):
    links = [(i, i - 1 if i else None) for i in range(10_000)] + [(20_000, 20_001), (20_001, 20_002), (20_002, 20_000), (20_003, 20_001), (20_004, 20_003), (30_000, 77_777), (40_000, 40_000), (None, 3)]
    df = spark.createDataFrame(links, "n long, p long")
    got = {r.node: (r.root, r.depth, r.cycle) for r in chains.parent_chains(df, "n", "p").collect()}
    assert len(got) == 10_007 and all(got[i] == (0, i, None) for i in range(10_000))
    assert all(got[i] == (None, None, 20_000) for i in range(20_000, 20_005))
    assert got[30_000] == (30_000, 0, None) and got[40_000] == (None, None, 40_000)
    assert len(chains._walks(spark.createDataFrame(links[:10_000], "n long, p long"), "n", "p")) - 1 <= 15


def test_paths_from_the_root(spark):
    rng = random.Random(9)
    links = [(i, rng.randrange(max(0, i - 3), i) if i else None) for i in range(60)] + [(100, 101), (101, 100)]
    df = spark.createDataFrame(links, "n long, p long")
    up = dict(links)
    for of in ([59, 30, 0], [7], [100]):
        got: dict = {}
        for r in chains.chain_paths(df, "n", "p", spark.createDataFrame([(x,) for x in of], "n long")).orderBy("place").collect():
            got.setdefault(r.node, []).append(r.ancestor)
        want = {}
        for x in of:
            path = [x]
            while up[path[0]] is not None and len(path) < 100:
                path.insert(0, up[path[0]])
            if len(path) < 100:
                want[x] = path
        assert got == want
    assert chains.parent_chains(df.limit(0), "n", "p").count() == 0


def test_known_keys(spark, tmp_path):
    store = KnownKeys(spark, str(tmp_path / "known"))
    make = lambda low, high: spark.range(low, high).select(F.when(c("id") % 11 > 0, F.lit("t")).alias("target"), F.concat(F.lit("C"), c("id").cast("string")).alias("smiles"))
    keys = ["target", "smiles"]
    assert store.novel(make(0, 30), keys).count() == 30
    store.add(1, make(0, 4000), keys)
    store.add(2, make(6000, 7000), keys)
    asked = make(3500, 6500)
    got = sorted(r.smiles for r in store.novel(asked, keys).collect())
    assert got == sorted(f"C{i}" for i in range(4000, 6000))
    assert store.novel(asked, keys).columns == keys
    store.add(2, make(6000, 7000), keys)  # a repeated run changes nothing
    assert store.novel(asked, keys).count() == 2000
    assert store.share_looked_up(make(10_000, 20_000), keys) < 0.25
    assert store.share_looked_up(make(0, 100), keys) == 1.0
