"""What larger tables than the test tables need: no bound on what a query takes, and work in bounded pieces."""

from tidelog.functions import hashing
from tidelog.operators import queues
from tidelog.plans import catalog
from tidelog.streaming import queries as live

PLACE = "tenant string, namespace string, stream string, shard int"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def shards_and_nodes(spark, shards, nodes):
    s = spark.createDataFrame([("t", "default", f"s{i % 3}", i) for i in range(shards)], PLACE)
    return s, spark.range(nodes).selectExpr("concat('node-', id) AS node", "concat('z', id % 4) AS zone")


def scores(stream, shard, names):
    left = hashing.shard_hashes(["t"], ["default"], [stream], [shard])[0]
    return dict(zip(names, hashing.rendezvous_scores(left, hashing.node_hashes(names)).tolist()))


def test_rendezvous_takes_any_number_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(queues, "NODE_BLOCK", 4000)
    monkeypatch.setattr(queues, "SHARD_BLOCK", 3)
    shards, nodes = shards_and_nodes(spark, 7, 10_001)
    names = [f"node-{i}" for i in range(10_001)]
    want = []
    for i in range(7):
        of = scores(f"s{i % 3}", i, names)
        want.append((i, max(names, key=lambda n: (of[n], n))))
    assert rows(queues.rendezvous(shards, nodes), "shard", "node") == want


def test_placement_takes_any_number_of_nodes(spark):
    shards, nodes = shards_and_nodes(spark, 5, 10_001)
    names = sorted(f"node-{i}" for i in range(10_001))
    zone = lambda n: int(n[5:]) % 4
    want, load = [], dict.fromkeys(names, 0)
    for stream, i in sorted((f"s{i % 3}", i) for i in range(5)):  # the shards' order; as many as these leave a cap of 1
        of, chosen = scores(stream, i, names), []
        for n in sorted(names, key=lambda n: (of[n], n), reverse=True):
            if len(chosen) < 3 and not load[n] and zone(n) not in [zone(c) for c in chosen]:
                chosen.append(n)
                load[n] = 1
        want.append((stream, i, chosen[0], chosen[1:]))
    assert rows(queues.bounded_placement(shards, nodes), "stream", "shard", "leader", "replicas") == want
    # two nodes and many shards: the cap rises with the shards, and the zones are as many as there are nodes
    few = queues.bounded_placement(shards, nodes.where("node < 'node-10'"), 2).collect()
    assert {r["zones"] for r in few} == {2} and not any(r["unspread"] for r in few)
    assert sorted(n for r in few for n in [r["leader"], *r["replicas"]]) == ["node-0"] * 5 + ["node-1"] * 5


def test_a_poll_does_not_look_at_every_claim():
    queue = queues.Deliveries(1000, 9)
    for o in range(5000):
        queue.publish(o, 1)
    list(queue.poll(0, "a", 1000))

    class Counted(dict):
        looks = 0

        def items(self):
            Counted.looks += len(self)
            return super().items()

        def values(self):
            Counted.looks += len(self)
            return super().values()

    queue.claims = Counted(queue.claims)
    assert [len(list(queue.poll(now, "a", 1))) for now in range(100)] == [1] * 100 and Counted.looks == 0
    queue.answer("nack", 100, 3, "a", 50)
    queue.answer("nack", 100, 2, "a", 70)
    assert list(queue.poll(150, "a", 1)) == [(3, "redelivered", 2)] and list(queue.poll(170, "a", 1)) == [(2, "redelivered", 2)]
    queue.__setstate__(queue.__getstate__())  # as a stream's state is kept
    assert [o for o, *_ in queue.poll(1000, "a", 1000)] == [o for o in range(1000) if o not in (2, 3)] + [1000, 1100]


def test_live_claims_come_in_slices_of_time(spark, monkeypatch, tmp_path):
    import glob

    d, names = "/root/testdata/sf0.001", ("stream", "shard", "at_ms", "seq", "offset", "event", "result")
    events, follow = catalog._claims(spark, d), lambda e: live.claims(e, 3600000)
    monkeypatch.setattr(live, "shared_path", lambda s, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(live, "ANSWERS", 7)
    got = live.arriving(events, "at_ms", follow, "claims", 700).where("result <> 'lapsed'")
    assert rows(got, *names) == rows(queues.queue_claims(events, 3600000), *names)
    assert len(glob.glob(f"{tmp_path}/claims-state/commits/[0-9]*")) >= 3 and spark.read.parquet(f"{tmp_path}/claims-in").count() == events.count()


def test_small_segments_share_files(spark, tmp_path):
    import glob

    from tidelog.operators import reads

    log = spark.range(5000).selectExpr("'s' AS stream", "CAST(id % 2 AS INT) AS shard", "id DIV 2 AS offset", "id AS ts_us", "'x' AS payload")
    got = reads.offload(log, str(tmp_path / "cold"))
    assert got.count() == 2 * 39 * 64 and got.agg({"segment": "max"}).first()[0] == 38  # the 40th segment is the active one
    assert len(glob.glob(f"{tmp_path}/cold/**/*.parquet", recursive=True)) == 2
    one = reads.offload(log, str(tmp_path / "more"), 64, 16).where("segment = 20")
    assert rows(one.where("shard = 1"), "offset") == [(o,) for o in range(20 * 64, 21 * 64)]
    assert len(glob.glob(f"{tmp_path}/more/**/*.parquet", recursive=True)) == 6


def test_commits_are_coded_by_batches():
    import pyarrow as pa
    import pytest

    from tidelog.functions import codecs

    kinds = pa.list_(pa.struct([("op", pa.string()), ("key", pa.string()), ("value", pa.int64())]))
    ops = [[], [("put", "ü", -5), ("delete", "d", 9)], [("delete", "", 0)], [("put", f"k{i}", i << 40) for i in range(9)]]
    events = ["e", "", "é", "order-1"]
    one = [codecs.encode_commit(e.encode(), [(op, key, str(value).encode()) for op, key, value in o]) for e, o in zip(events, ops)]
    data = codecs.encode_commits(pa.array(events), pa.array([[dict(zip(("op", "key", "value"), x)) for x in o] for o in ops], kinds))
    assert data.to_pylist() == one
    found, of, place, put, key, value = codecs.decode_commits(data)
    assert [e.decode() for e in found.to_pylist()] == events
    want = [(i, n, op == "put", k.encode(), str(v).encode() if op == "put" else b"") for i, o in enumerate(ops) for n, (op, k, v) in enumerate(o)]
    assert list(zip(of.tolist(), place.tolist(), put.tolist(), key.to_pylist(), value.to_pylist())) == want
    for bad in (one[1][:-1], one[1] + b"x", b"\x02" + one[1][1:], b"", one[2][:11] + b"\x07" + one[2][12:]):
        with pytest.raises(ValueError):
            codecs.decode_commits(pa.array([one[0], bad], pa.binary()))


def test_lines_go_to_their_commits_as_they_are(spark):
    plan = catalog.QUERIES["q24_commit_state"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner") :]
    assert "struct(" not in joined and "part-" not in joined and "max_by" not in plan
