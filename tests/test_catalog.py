import duckdb
import pandas as pd
import pytest

from cairn import catalog
from cairn.__main__ import main
from cairn.functions import sizes
from cairn.operators import kv, liveness, peers, replica, ring, store
from cairn.sources import messages
from cairn.streaming import stateful

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier events documents".split()


def rows(p: pd.DataFrame) -> list:
    p = p[sorted(p.columns)]
    cell = lambda x: "-" if pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in p.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_batch_in_order(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    batch = spark.createDataFrame([(0, "a", None), (1, "a", "3"), (2, "b", "4"), (3, "b", None), (4, "c", ""), (5, "", "5")], "ord int, key string, value string")
    assert sorted(map(tuple, kv.apply_batch(base, batch).collect())) == [("", "5"), ("a", "3"), ("c", "")]
    assert kv.apply_batch(base, batch.limit(0)).count() == 2


def test_single_beat_has_no_phi(spark):
    beats = spark.createDataFrame([("x", 0.0), ("y", 0.0), ("y", 4.0), ("y", 30.0)], "node string, t double")
    now = spark.createDataFrame([(40.0,)], "now double")
    got = {r["node"]: (r["phi"], r["status"]) for r in liveness.classify(liveness.phi(beats, now, liveness.LivenessConfig()), liveness.LivenessConfig()).collect()}
    assert got == {"x": (None, "unknown"), "y": (10 / 4.5, "live")}


def test_ring_edges(spark):
    keys = spark.createDataFrame([("k",), ("l",)], "key string")
    nodes = spark.createDataFrame([("one", 1), ("none", 0)], "node string, n_replicas int")
    assert {r["node"] for r in ring.lookup(keys, ring.build(nodes)).collect()} == {"one"}
    invalid = spark.createDataFrame([], "node string")
    assert {r["node"] for r in ring.lookup_tolerant(keys, ring.build(nodes), invalid, 5).collect()} == {None}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty, name):
    catalog.QUERIES[name](spark, empty).collect()


STATE = "node string, key string, value string, version long"


def test_delta_budgets(spark):
    rows = spark.createDataFrame([("a", "k1", "x" * 10, 1), ("a", "k2", None, 2), ("b", "k", "v", 9)], STATE)
    # 2, then a: 2 + 1 + 7 + 2, its rows 24 and 14, then b: 12 and 14.
    for mtu, nodes, n in ((13, {}, 0), (14, {"a": 0}, 0), (37, {"a": 0}, 0), (38, {"a": 1}, 1), (52, {"a": 2}, 2), (63, {"a": 2}, 2), (64, {"a": 2, "b": 0}, 2), (77, {"a": 2, "b": 0}, 2), (78, {"a": 2, "b": 1}, 3), (10**6, {"a": 2, "b": 1}, 3)):
        sent = replica.delta(rows, mtu)
        assert {r["node"]: r["n"] for r in sent.nodes.collect()} == nodes, mtu
        assert sent.rows.count() == n
    got = replica.receive(rows.limit(0), replica.delta(rows, 14)).collect()
    assert [tuple(r) for r in got] == [("a", None, None, 0)]
    assert [tuple(r) for r in replica.digest(replica.receive(rows.limit(0), replica.delta(rows, 14))).collect()] == [("a", 0)]


def test_exchange_brings_replicas_together(spark):
    a = spark.createDataFrame([("a", "k", "1", 1), ("a", "l", "2", 2), ("c", "k", "old", 3)], STATE)
    b = spark.createDataFrame([("b", "k", "3", 1), ("c", "k", "new", 4), ("d", "k", "dead", 1)], STATE)
    dead = spark.createDataFrame([("d",)], "node string")
    done = replica.exchange(a, b, dead_b=dead)
    both = [("a", "k", "1", 1), ("a", "l", "2", 2), ("b", "k", "3", 1), ("c", "k", "new", 4)]
    assert sorted(map(tuple, done.a.collect())) == both and sorted(map(tuple, done.b.collect())) == [*both, ("d", "k", "dead", 1)]
    assert replica.exchange(a, b, 40).to_a.nodes.count() == 0


def test_versions_across_ranges(spark):
    rows = spark.createDataFrame([("n", s) for s in (5, replica.RANGE + 1, replica.RANGE, 3 * replica.RANGE, 0)] + [(None, 7)], "node string, seq long")
    got = sorted((str(r["node"]), r["seq"], r["version"]) for r in replica.assign_versions(rows).collect())
    assert [v for n, _, v in got if n == "n"] == [1, 2, 3, 4, 5] and ("None", 7, 1) in got


def test_deaths_restart_windows(spark):
    conf = liveness.LivenessConfig(threshold=2.0, window=3, max_interval=10.0, initial_interval=5.0, grace=20.0)
    beats = [("x", t) for t in (0.0, 1.0, 2.0, 30.0, 31.0, 100.0)] + [("y", 0.0), (None, 1.0), ("x", None)]
    got = liveness.transitions(spark.createDataFrame(beats, "node string, t double"), liveness.Schedule(0.0, 1.0, 130.0), conf).collect()
    # Mean 1: dead at the first tick over 2 s after the beat at 2; gone 20 s later; alive again with a sample.
    assert sorted((r["tick"], r["status"], r["epoch"]) for r in got) == [(1.0, "live", 0), (5.0, "dead", 0), (25.0, "removed", 1), (31.0, "live", 1), (34.0, "dead", 1), (54.0, "removed", 2)]
    assert {r["node"] for r in got} == {"x"}


def test_change_feed_across_ranges(spark):
    n = liveness.TICKS
    rows = [(0, "a"), (1, "a"), (n + 1, "a"), (n + 2, "b"), (5 * n, "b"), (5 * n + 1, None), (9 * n, None)]
    got = liveness.change_feed(spark.createDataFrame(rows, "tick long, node string"))
    assert sorted(map(tuple, got.collect())) == [(0, "a"), (n + 2, "b"), (5 * n + 1, "")]


def test_ring_validity(spark):
    keys = spark.createDataFrame([("k",), ("l",)], "key string")
    ring_ = ring.build(spark.createDataFrame([("one", 3)], "node string, n_replicas int"), ring.xxh64)
    none = spark.createDataFrame([], "node string")
    assert {r["node"] for r in ring.lookup(keys, ring_, hash_=ring.xxh64).collect()} == {"one"}
    assert {r["node"] for r in ring.lookup(keys, ring_, none, hash_=ring.xxh64).collect()} == {None}
    assert {r["node"] for r in ring.lookup(keys, ring_.limit(0)).collect()} == {None}


def test_peers_of_a_round(spark):
    of = lambda *x: spark.createDataFrame([(a,) for a in x], "addr string")
    r = peers.select(of("a", "b", "c", "d"), of("a", "b", "c"), of(), of("a"), 1)
    assert r.chosen.count() == 3 and r.dead.isEmpty() and r.seed.isEmpty()
    r = peers.select(of("a", "b"), of(), of("z", "y"), of("s"), 1)
    assert sorted(x["addr"] for x in r.chosen.collect()) == ["a", "b"] and r.dead.count() == 1 and r.seed.collect()[0]["addr"] == "s"
    assert peers.chance(3, 2) == 0.5
    assert of("a").select(peers.node_id("addr").alias("id")).first()["id"].startswith("svr:a-")


def test_sizes(spark):
    rows = spark.createDataFrame([("ab", "k", None, "10.0.0.1:80"), ("é", "k", "v", "[::1]:9")], "node string, key string, value string, addr string")
    got = rows.select(sizes.node_id("node", "addr"), sizes.node_header("node", sizes.host("addr")), sizes.key_value("key", "value"), sizes.digest_entry("node"), sizes.host("addr"), sizes.port("addr")).collect()
    assert [tuple(r)[1:] for r in got] == [(13, 13, 19, "10.0.0.1", 80), (25, 14, 19, "::1", 9)]


def test_store_transactions(spark, tmp_path):
    db = store.Store(spark, f"file://{tmp_path}/s")
    value = lambda snap: {r["key"]: bytes(r["value"]) for r in snap.state().collect()}
    assert value(db.read()) == {} and db.metrics() == store.Metrics(0, 0, 0)
    db.set([("n", b"0")])
    before = db.read()
    with db.write() as txn:
        txn.set("n", b"1")
        assert value(txn) == {"n": b"1"} and value(db.read()) == {"n": b"0"}
        after = txn.commit()
    # Three readers: one from before, one from the commit, one of now.
    assert value(before) == {"n": b"0"} and value(after) == value(db.read()) == {"n": b"1"}
    with pytest.raises(store.ReadOnlyError):
        txn.set("n", b"2")
    with db.write() as txn:
        txn.set("n", b"lost")
    with db.write() as txn:
        assert txn.commit().txn_id == 2
    assert value(db.read(as_of=1)) == {"n": b"0"} and db.metrics() == store.Metrics(1, 1, 2)
    rival = db.write()
    rival.set("n", b"x")
    db._publish(rival.base, rival._pending())
    with pytest.raises(store.ConflictError):
        rival.commit()
    assert value(db.read()) == {"n": b"x"}


def test_command_line(spark, tmp_path, capsys):
    call = lambda *x: main(["--store", f"file://{tmp_path}/s", *x], spark)
    call("set", "a=b=c", "b=", "c=\U0001f600")
    call("del", "b", "nope")
    call("get", "c", "b", "a", "a")
    assert capsys.readouterr().out.split("\n")[2:-1] == ["key=c value=\U0001f600", "key=b value=None", "key=a value=b", "key=a value=b"]
    call("metrics")
    assert "keys_count=2" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        call("set", "nothing")
    with pytest.raises(ValueError):
        kv.parse_pair("nothing")


def test_required_pairs(spark):
    raw = spark.createDataFrame([("a=b",), ("c=",), (None,)], "raw string")
    assert [tuple(r) for r in kv.require_pairs(raw).collect()] == [("a=b", "a", "b"), ("c=", "c", ""), (None, None, None)]
    with pytest.raises(Exception, match="no '=' in pair: x"):
        kv.require_pairs(spark.createDataFrame([("x",)], "raw string")).collect()


def test_gossip_loop(spark, tmp_path):
    start = spark.createDataFrame([("n", "k", "0", 1)], STATE)
    parts = [[("n", "k", "1", 2), ("m", "k", "a", 1)], [("n", "k", "late", 1), ("m", "k", "b", 2)]]
    for p in parts:
        messages.write(spark.createDataFrame(p, STATE).coalesce(1), f"{tmp_path}/in")
    (tmp_path / "in" / "bad.txt").write_text("{no json\n{\"node\": \"n\"}\n")
    rows, _ = messages.parse(messages.lines(spark, f"{tmp_path}/in", streaming=True))
    seen = []
    loop = stateful.GossipLoop(spark, f"{tmp_path}/state", start, lambda state, n: seen.append(state.count()))
    got = loop.run(rows, f"{tmp_path}/checkpoint")
    assert sorted(map(tuple, got.collect())) == [("m", "k", "b", 2), ("n", "k", "1", 2)] and seen[-1] == 2
    assert messages.parse(messages.lines(spark, f"{tmp_path}/in"))[1].count() == 2


def test_streamed_beats_in_two_runs(spark, tmp_path):
    conf = liveness.LivenessConfig(window=2)
    kind = "node string, t double"
    stream = lambda: stateful.rolling_mean(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), conf)
    for beats in ([("x", 3.0), ("x", 1.0), ("y", 0.0)], [("x", 7.0), ("x", 2.0), ("x", 40.0), ("x", None)]):
        spark.createDataFrame(beats, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = stateful.to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(map(tuple, got.collect())) == [("x", 3.0, 2.0, 2.0), ("x", 7.0, 4.0, 3.0), ("x", 40.0, 5.0, 4.5)]


def test_neighbours_across_ranges(spark):
    from cairn.operators import ranged

    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 25, "y"), ("a", 26, "z"), (None, 7, "n"), (None, 90, "m"), ("b", 5, "o")], "key string, version long, value string")
    before = ranged.with_previous(rows, ["key"], "version", rows["value"], "prev", span=10)
    assert {(r["key"], r["version"]): r["prev"] for r in before.collect()} == {("a", 1): None, ("a", 3): "x", ("a", 25): None, ("a", 26): "y", (None, 7): None, (None, 90): "n", ("b", 5): None}
    after = ranged.with_next(rows, ["key"], "version", rows["version"], "next", span=10)
    assert {(r["key"], r["version"]): r["next"] for r in after.collect()} == {("a", 1): 3, ("a", 3): 25, ("a", 25): 26, ("a", 26): None, (None, 7): 90, (None, 90): None, ("b", 5): None}


def test_gossip_defaults():
    from cairn.config import GossipConfig

    conf = GossipConfig(seeds=("a:1", "", "a:1", "b:2"))
    assert conf.seeds == ("a:1", "b:2") and conf.cluster_id == "default-cluster" and conf.liveness.threshold == 8.0
    with pytest.raises(ValueError):
        GossipConfig(interval=0)
