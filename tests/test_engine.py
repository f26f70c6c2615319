"""Golden values and properties of the engine's operators."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockwright import catalogue
from blockwright.functions import scalars
from blockwright.functions.permutation import Congruential, Feistel, Identity, Ranges
from blockwright.operators import balancer, failuresim, kmeans, pagerank, report, store
from blockwright.operators.dense import with_block_ids
from blockwright.operators.ranks import Ranks
from blockwright.operators.store import BlockStore
from blockwright.operators.versioned import TwoPhase
from blockwright.plans.placement import DataLossError, Placement
from blockwright.sources import files, vectors


@pytest.mark.parametrize("args", [(0, 1, 1), (10, 3, 0), (10, 3, 4), (2, 3, 1)])
def test_invalid_placement(args):
    with pytest.raises(ValueError):
        Placement(*args)


@pytest.mark.parametrize("p,n,want", [(3, 10, [(0, 3), (4, 6), (7, 9)]), (4, 6, [(0, 1), (2, 3), (4, 4), (5, 5)])])
def test_ranges(spark, p, n, want):
    assert [(r["start"], r["last"]) for r in Placement(n, p, 1).ranges(spark).orderBy("range_id").collect()] == want


def test_replica_ranks(spark):
    p = Placement(100, 10, 3)
    by_rank = {}
    for r in p.replicas_table(spark).collect():
        by_rank.setdefault(r["rank"], set()).add(r["range_id"])
    assert by_rank[7] == {7, 4, 1} and by_rank[1] == {1, 8, 5}
    assert {r["rank"] for r in p.replicas_table(spark).where("range_id = 0").collect()} == {0, 3, 6}


@pytest.mark.parametrize("p,r,dead,lost", [(4, 2, {1, 2}, []), (4, 2, {1, 3}, [1, 3]), (8, 3, {0, 2, 4}, [0]), (8, 3, {1, 4}, [])])
def test_loss(spark, p, r, dead, lost):
    place = Placement(100, p, r)
    assert sorted(x[0] for x in place.lost_ranges(spark, dead).select("range_id").collect()) == lost
    if lost:
        with pytest.raises(DataLossError):
            place.check_no_loss(spark, dead)


def test_block_out_of_range(spark):
    with pytest.raises(Exception, match="outside the store"):
        spark.range(11).select(Placement(10, 3, 1).range_of(F.col("id"))).collect()


@settings(max_examples=12, deadline=None)
@given(n=st.integers(1, 300), kind=st.sampled_from(["lcg", "feistel", "ranges", "feistel ranges", "identity"]), length=st.integers(1, 40))
def test_permutations_are_bijections(spark, n, kind, length):
    f = {"lcg": Congruential(n), "feistel": Feistel(n, 5), "ranges": Ranges(n, length), "feistel ranges": Ranges(n, length, Feistel), "identity": Identity(n)}[kind]
    rows = spark.range(n).select("id", f.apply(F.col("id")).alias("p")).withColumn("back", f.invert(F.col("p"))).collect()
    assert sorted(r["p"] for r in rows) == list(range(n))
    assert all(r["id"] == r["back"] for r in rows)


@pytest.mark.parametrize("n", [33, 34, 65])
def test_congruential_at_powers_of_two(spark, n):
    got = {r[0] for r in spark.range(n).select(Congruential(n).apply(F.col("id"))).collect()}
    assert got == set(range(n))


def test_last_of_run(spark):
    rows = spark.range(10).select(Ranges(10, 5).last_of_run(F.col("id")), Ranges(10, 3).last_of_run(F.col("id"))).collect()
    assert sorted({r[0] for r in rows}) == [4, 9] and sorted({r[1] for r in rows}) == [2, 5, 8, 9]


@pytest.mark.parametrize("order", [None, "ranges", "feistel"])
def test_pull_returns_what_was_submitted(spark, order):
    blocks = spark.range(1000).select(F.col("id").alias("block_id"), (F.col("id") * 3).alias("value"))
    f = {None: None, "ranges": Ranges(1000, 16), "feistel": Feistel(1000)}[order]
    s = BlockStore(blocks, Placement(1000, 8, 3), f).fail([1, 4])
    requests = spark.createDataFrame([(0, 300, 0), (300, 450, 2), (750, 250, 7)], "start long, len long, dest int")
    got = s.pull(requests).select("dest", "block_id", "value", "serving").collect()
    assert sorted(r["block_id"] for r in got) == list(range(1000))
    assert all(r["value"] == 3 * r["block_id"] and r["serving"] not in (1, 4) for r in got)


def test_pull_of_lost_data_raises(spark):
    blocks = spark.range(100).select(F.col("id").alias("block_id"))
    s = BlockStore(blocks, Placement(100, 4, 2)).fail([1, 3])
    with pytest.raises(Exception, match="no alive replica"):
        s.pull(spark.createDataFrame([(0, 100, 0)], "start long, len long, dest int")).collect()


def test_balancer_exact_pieces(spark):
    own = balancer.Ownership.of(spark.range(10).select((F.col("id") * 100).alias("start"), F.lit(100).cast("long").alias("len"), F.col("id").cast("int").alias("owner")), 10)
    first = own.plan([5, 7]).collect()
    assert sorted((r["dest"], r["len"]) for r in first) == [(d, 25) for d in (0, 1, 2, 3, 4, 6, 8, 9)]
    assert own.plan([]).count() == 0
    got = {}
    for r in own.commit([5, 7]).plan([0, 1]).orderBy("at").collect():
        got.setdefault(r["dest"], []).append((r["start"], r["len"]))
    assert got == {2: [(0, 42)], 3: [(42, 42)], 4: [(84, 16), (100, 26)], 6: [(126, 42)], 8: [(168, 32), (500, 9)], 9: [(509, 16), (525, 25)]}


def test_ranks():
    r = Ranks.of(5).fail([1])
    assert (r.current(2), r.current(1), r.original(1), r.failures) == (1, None, 2, 1)
    died, r = r.died_since_last_call()
    assert died == (1,) and r.died_since_last_call()[0] == () and r.rebase().size == 4


def test_two_phase():
    t = TwoPhase()
    with pytest.raises(ValueError):
        _ = t.active
    t.emplace(1)
    t.active = 2
    t.rollback()
    assert t.active == 1
    t.active = 3
    t.commit()
    t.rollback()
    assert (t.active, t.committed) == (3, 3)


def points(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "point_id long, v array<double>")


@pytest.mark.parametrize("centers,want", [([[2.0], [8.0]], [0, 0, 0, 1, 1, 1]), ([[9.1], [-0.1]], [1, 1, 1, 0, 0, 0])])
def test_kmeans_assign(spark, centers, want):
    rows = kmeans.assign(points(spark, [[1], [2], [3], [7], [8], [9]]), centers).orderBy("point_id").collect()
    assert [r["cid"] for r in rows] == want


def test_kmeans_iterations(spark):
    assert kmeans.iterate(points(spark, [[0], [0], [1], [1]]), [[0.0], [20.0]], 1) == [[0.5], [20.0]]
    square = points(spark, [[0, 0], [1, 1], [2, 2], [6, 6], [7, 7], [8, 8]])
    start = [[5.0, 5.0], [8.0, 8.0]]
    assert kmeans.iterate(square, start, 0) == start
    assert kmeans.iterate(square, start, 1) == [[2.25, 2.25], [7.5, 7.5]]
    assert kmeans.iterate(square, start, 2) == [[1.0, 1.0], [7.0, 7.0]]
    assert kmeans.iterate(points(spark, [[1], [1], [2], [10], [13], [18], [20], [21]]), [[5.0], [17.0]], 2) == [[3.5], [18.0]]


def test_kmeans_errors(spark):
    with pytest.raises(ValueError):
        kmeans.centers_from_flat([1.0, 2.0, 3.0], 2)
    with pytest.raises(ValueError):
        kmeans.centers_from_flat([1.0], 0)
    with pytest.raises(ValueError):
        kmeans.pick_centers(points(spark, [[1]]), 2)


def test_pagerank_with_a_sink(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "src long, dst long")
    got = {r["v"]: r["pr"] for r in pagerank.pagerank(edges, spark.range(3).withColumnRenamed("id", "v"), 20).collect()}
    a = 0.05
    b = a + 0.85 * a / 2
    c = a + 0.85 * (a / 2 + b)
    assert got == pytest.approx({0: a / (a + b + c), 1: b / (a + b + c), 2: c / (a + b + c)})


def test_expected_failures():
    assert failuresim.expected_failures(16, 4) == pytest.approx(10.5025641)
    assert failuresim.per_iteration(0.01, 500) == pytest.approx(2.01005e-05, rel=1e-4)


def test_vector_keeps_values_equal_to_the_pad(spark):
    values = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "id long, value int")
    blocks = vectors.to_blocks(values, 2, 0)
    assert sorted(map(tuple, vectors.from_blocks(blocks, 2).collect())) == [(0, 1), (1, 0), (2, 0)]


def test_djb2(spark):
    assert spark.createDataFrame([("total",)], "s string").select(scalars.djb2(F.col("s"))).head()[0] == 275837705


def test_human_bytes(spark):
    sizes = spark.createDataFrame([(1023,), (1536,), (1 << 30,), (3 << 40,)], "b long")
    assert [r[0] for r in sizes.select(scalars.human_bytes(F.col("b"))).collect()] == ["1023 B", "1.5 KiB", "1.0 GiB", "3.0 TiB"]
    assert [r[0] for r in sizes.select(scalars.human_bytes(F.col("b"), "MiB")).collect()] == ["1023 B", "1.5 KiB", "1024.0 MiB", "3145728.0 MiB"]


def test_report_human_bytes_of_large_keys(spark, tmp_path):
    """The SQL of the query has no unit above MiB."""
    keys = [0, 1, 3, 4, 3495, 3496, (1 << 30) // 300, (1 << 30) // 300 + 1, 1 << 33, 1 << 40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["size"] for r in catalogue.QUERIES["report_human_bytes"](spark, str(tmp_path)).collect()}
    assert got == dict(duckdb.sql(catalogue.ORACLE_SQL["report_human_bytes"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall())


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    files.write_graph(edges, 3, f"{tmp_path}/g")
    back, n = files.read_graph(spark, f"{tmp_path}/g")
    assert n == 3 and sorted(map(tuple, back.collect())) == [(0, 1), (1, 2), (2, 0)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x").write_text("p 3 1\nx 1 2\n")
    with pytest.raises(ValueError):
        files.read_graph(spark, f"{tmp_path}/bad")


def test_point_files(spark, tmp_path):
    p = points(spark, [[1, 2], [3, 4]])
    files.write_points(p, f"{tmp_path}/p")
    assert [r["v"] for r in files.read_points(spark, f"{tmp_path}/p").orderBy("point_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_measurements(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.5)], "p int, t double")
    files.write_measurements(rows, f"{tmp_path}/m.p-48.r-3", ["p", "t"])
    back = files.read_measurements(spark, f"{tmp_path}/m.p-48.r-3", "p int, t double", r"r-(\d+)", ["rep"]).head()
    assert tuple(back) == (1, 2.5, "3")
    with pytest.raises(ValueError):
        files.write_measurements(rows, f"{tmp_path}/n", ["p"])


def test_report_check(spark):
    with pytest.raises(ValueError):
        report.check(spark.range(3), positive="id > 0")


def test_dense_ids(spark):
    keys = [None, None, 7, 7, 7, 7, -5, 10**12, 3, None, *range(100, 300), *([55] * 500)]
    many = with_block_ids(spark.createDataFrame([(k,) for k in keys], "k long"), ["k"], buckets=4).orderBy("block_id").collect()
    assert [r["block_id"] for r in many] == list(range(len(keys))) and [r["k"] for r in many] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert with_block_ids(spark.createDataFrame([], "k long"), ["k"]).count() == 0

    rows = spark.createDataFrame([(k,) for k in (5, 5, 9, 1000, -3)], "k long")
    assert sorted((r["k"], r["block_id"]) for r in with_block_ids(rows, ["k"]).collect()) == [(-3, 0), (5, 1), (5, 2), (9, 3), (1000, 4)]


def test_scan_of_a_hole_raises(spark):
    blocks = spark.range(10).where("id <> 4").select(F.col("id").alias("block_id"))
    s = BlockStore(blocks, Placement(10, 2, 1))
    assert s.scan(5, 5).count() == 5 and s.scan(0, 0).count() == 0
    with pytest.raises(LookupError):
        s.scan(0, 10)


def test_stored_blocks_are_pulled_by_what_is_asked(spark, tmp_path):
    blocks = spark.range(3000).select(F.col("id").alias("block_id"), (F.col("id") * 7).alias("value"))
    s = BlockStore(blocks, Placement(3000, 8, 3), Ranges(3000, 16)).stored(f"{tmp_path}/s").fail([1, 4])
    request = spark.createDataFrame([(100, 40, 0), (130, 20, 2), (5, 0, 3)], "start long, len long, dest int")
    got = s.pull(request)
    assert sorted((r["dest"], r["block_id"], r["value"]) for r in got.collect()) == sorted([(0, i, 7 * i) for i in range(100, 140)] + [(2, i, 7 * i) for i in range(130, 150)])
    assert "GreaterThanOrEqual(block_id,100)" in got._jdf.queryExecution().toString()
    assert s.pull(request.where("len > 1000")).count() == 0


def test_kmeans_lives_on_what_it_recovered(spark):
    """The dead rank's points are gone: what the replicas hold decides the result."""
    blocks = spark.range(80).select(F.col("id").alias("block_id"), F.array(F.col("id").cast("double")).alias("v"))
    place = Placement(80, 8, 2)
    own = balancer.Ownership.of(balancer.contiguous(spark, 80, 8), 8)
    start = [[0.0], [79.0]]
    want = kmeans.iterate(blocks.withColumnRenamed("block_id", "point_id"), start, 3)
    got, store, after = kmeans.iterate_with_failures(BlockStore(blocks, place), own, start, 3, {1: [2], 2: [5]})
    assert got == want and store.dead == {2, 5} and 2 not in after.alive

    class Odd(BlockStore):
        """Replicas that hold other values than the ranks worked on."""

        def pull(self, requests):
            return super().pull(requests).withColumn("v", F.transform("v", lambda x: x + 1000))

        def fail(self, ranks):
            return Odd(self.blocks, self.placement, self.permutation, self.dead | set(ranks))

    assert kmeans.iterate_with_failures(Odd(blocks, place), own, start, 3, {1: [2]})[0] != want


def test_walk_that_finds_no_id_raises(spark, monkeypatch):
    from blockwright.functions import permutation

    monkeypatch.setattr(permutation, "WALK", 2)
    with pytest.raises(Exception, match="no id in range"):
        spark.range(1).select(permutation._walk(lambda x: x * 0 + 9, 5, F.col("id"))).collect()


def test_store_is_written_in_slices_of_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SLICE", 100)
    blocks = spark.range(3000).select(F.col("id").alias("block_id"), (F.col("id") * 7).alias("value"))
    s = BlockStore(blocks, Placement(3000, 8, 3), Ranges(3000, 16)).stored(f"{tmp_path}/s")
    per_file = s.blocks.groupBy("range_id", F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), (F.max("internal_id") - F.min("internal_id") + 1).alias("span")).collect()
    assert len(per_file) == 8 * 4 and all(r["n"] == r["span"] <= 100 for r in per_file)
    assert sorted((r["block_id"], r["value"]) for r in s.blocks.collect()) == [(i, 7 * i) for i in range(3000)]


def test_walk_folds_little_at_first(monkeypatch):
    plan = str(Congruential(33).apply(F.lit(1)))
    assert "sequence(1, 3)" in plan and "sequence(1, 256)" not in plan


@pytest.mark.parametrize("parts", [8, 2])
def test_pagerank_writes_what_was_lost_and_lives_on_it(spark, monkeypatch, parts):
    monkeypatch.setattr(pagerank, "PARTS", parts)
    blocks = spark.range(400).select(F.col("id").alias("block_id"), (F.col("id") * F.col("id") % 19).alias("src"), (F.col("id") * 7 % 23).alias("dst"))
    vertices, place = spark.range(25).withColumnRenamed("id", "v"), Placement(400, 8, 3)
    own = balancer.Ownership.of(balancer.contiguous(spark, 400, 8), 8)
    want = {r["v"]: r["pr"] for r in pagerank.pagerank(blocks, vertices, 4).collect()}
    merged, plain = [], pagerank._merged
    monkeypatch.setattr(pagerank, "_merged", lambda edges, *more: (merged.append(edges.count()), plain(edges, *more))[1])
    got = {r["v"]: r["pr"] for r in pagerank.pagerank_with_failures(BlockStore(blocks, place), own, vertices, 4, {1: [1], 3: [4]}).collect()}
    assert got == pytest.approx(want) and merged[:2] == [400, 50] and 50 <= merged[2] <= 58

    class Odd(BlockStore):
        """Replicas that hold other edges than the ranks worked on."""

        def pull(self, requests):
            return super().pull(requests).withColumn("dst", F.lit(24).cast("long"))

        def fail(self, ranks):
            return Odd(self.blocks, self.placement, self.permutation, self.dead | set(ranks))

    odd = {r["v"]: r["pr"] for r in pagerank.pagerank_with_failures(Odd(blocks, place), own, vertices, 4, {1: [1]}).collect()}
    assert odd[24] > want[24]


def test_id_runs(spark, monkeypatch):
    monkeypatch.setattr(store, "STRETCH", 2)
    monkeypatch.setattr(store, "RUN_ROWS", 20)
    top = (1 << 63) - 1
    ids = {"a": [*range(-9, 14), 15, 16, 16, 16, 20, 24, 25, 30], "b": [3, 4, 7, 8, 11, 12, 12, None, None], None: [0, 1, None, 4], "ends": [-top - 1, -top - 1, top, top, top - 1, 0]}
    rows = spark.createDataFrame([(g, i) for g, found in ids.items() for i in found], "g string, block_id long")
    want = []
    for g, found in ids.items():
        want += [(g, None, None)] if None in found else []
        whole = sorted({i for i in found if i is not None})
        firsts = [i for i in whole if i - 1 not in whole]
        want += [(g, i, next(j for j in whole if j >= i and j + 1 not in whole)) for i in firsts]
    found = store.id_runs(rows, "g")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert store.id_runs(rows.where("block_id > 100 AND g = 'a'"), "g").count() == 0


def test_tasks_of_id_runs_grow_with_the_rows_and_not_with_a_group(spark, monkeypatch):
    monkeypatch.setattr(store, "STRETCH", 6)
    monkeypatch.setattr(store, "RUN_ROWS", 250)
    rows = spark.range(8000).select((F.col("id") % 1).alias("g"), (F.col("id") + F.col("id").cast("int") % 2).alias("block_id"))
    found = store.id_runs(rows, "g")
    assert found.count() == 4001
    assert found.rdd.getNumPartitions() >= 32
    sizes = [len(x) for x in found.rdd.glom().collect()]
    assert max(sizes) < 1000
