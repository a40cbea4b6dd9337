"""Every query against its SQL, and the sequential operators against plain Python."""

import pytest

from tidemark import queries as q
from tidemark.functions.language import ScriptError, footprint, parse
from tidemark.operators import folds, ranges, reads, retention, scans, visibility
from tidemark.plans.scripts import Session
from tidemark.sources import encodings as enc
from tidemark.sources import storage

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(name, same):
    same(q.QUERIES[name], q.ORACLES[name])


def _fold(rows, key, order, begin, step):
    out, state = [], {}
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in order)):
        out.append((r[key], *step(state.setdefault(r[key], begin()), r)))
    return out


def _plain(rows):
    return sorted((tuple(None if v != v else int(v) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize(
    "ops, key, begin, step, run",
    [
        (enc.events_mutations, "key", folds.new_entry, folds.mutate, folds.apply_mutations),
        (enc.events_locks, "resource", folds.new_lock, folds.lease, folds.apply_leases),
    ],
)
def test_folds_equal_a_plain_loop(spark, ops, key, begin, step, run):
    frame = ops(spark, D)
    want = _fold([r.asDict() for r in frame.collect()], key, ["ts_l", "seq"], begin, step)
    assert _plain(run(frame).toPandas().astype(object).itertuples(index=False)) == _plain(want)


def _m(op, ts, **k):
    base = {"seq": ts, "op": op, "key": "k", "value": "v", "nx": False, "xx": False, "cmp_value": None, "cmp_rev": None, "norev": False, "ttl_ms": 0, "ts_l": ts}
    return base | k


def test_mutation_rules():
    e = folds.new_entry()
    steps = [
        (_m("SET", 1, xx=True), "NotSet", -1),
        (_m("SET", 2, nx=True, ttl_ms=10), "Set", 0),
        (_m("SET", 12, nx=True), "NotSet", 0),  # still alive in its last millisecond
        (_m("SET", 13, nx=True, value="w"), "Set", 1),
        (_m("SET", 14, cmp_value="x"), "NotSet", 1),
        (_m("SET", 15, cmp_value="w", cmp_rev=1), "Set", 2),
        (_m("EXTEND", 16, ttl_ms=5), "Extended", 2),
        (_m("DELETE", 17), "Deleted", 3),
        (_m("DELETE", 18), "DoesNotExist", 3),
        (_m("SET", 19, ttl_ms=-1), "InvalidInput", 3),
        (_m("SET", 20, nx=True), "Set", 4),
    ]
    for m, status, revision in steps:
        assert folds.mutate(e, m)[2:4] == (status, revision), m


def test_comparisons_do_not_ask_for_existence():
    assert folds.mutate(folds.new_entry(), _m("SET", 1, cmp_rev=-1))[2:4] == ("Set", 0)
    assert folds.mutate(folds.new_entry(), _m("SET", 1, cmp_rev=0))[2:4] == ("NotSet", -1)
    assert folds.mutate(folds.new_entry(), _m("SET", 1, cmp_value=""))[2:4] == ("Set", 0)
    assert folds.mutate(folds.new_entry(), _m("SET", 1, cmp_value="x"))[2:4] == ("NotSet", -1)
    e = folds.new_entry()
    folds.mutate(e, _m("SET", 1))
    folds.mutate(e, _m("DELETE", 2))
    assert folds.mutate(e, _m("SET", 3, cmp_rev=1))[2:4] == ("Set", 2)


def test_lease_rules():
    k = folds.new_lock()

    def op(what, owner, ts, ttl=10):
        return folds.lease(k, {"seq": ts, "op": what, "resource": "r", "owner": owner, "ttl_ms": ttl, "ts_l": ts})[3:5]

    assert op("lock", "a", 0) == ("Locked", 0)
    assert op("lock", "a", 5) == ("Locked", 0)
    assert op("lock", "b", 10) == ("Busy", 0)
    assert op("lock", "b", 11) == ("Locked", 1)
    assert op("extend", "a", 12) == ("InvalidOwner", 1)
    assert op("unlock", "b", 99) == ("Unlocked", 1)
    assert op("get", "b", 100) == ("DoesNotExist", 1)


def test_sequences(spark):
    rows = [(1, "s", 1, None, 0), (2, "s", 3, "i", 0), (3, "s", 3, "i", 0), (4, "s", 2, "i", 0), (5, "s", 9, None, 0), (6, "s", 1, None, 0)]
    from tidemark.schemas import SEQUENCE_REQUESTS

    out = folds.allocate(spark.createDataFrame(rows, SEQUENCE_REQUESTS), maximum=15, block=5).orderBy("seq").toPandas()
    got = [(r.status, None if r.first != r.first else int(r.first), None if r.last != r.last else int(r.last)) for r in out.itertuples(index=False)]
    assert got == [("Allocated", 1, 1), ("Allocated", 2, 4), ("Allocated", 2, 4), ("InvalidInput", None, None), ("Allocated", 6, 14), ("Allocated", 15, 15)]


def test_blocks_end_on_the_grid(spark):
    from tidemark.schemas import SEQUENCE_REQUESTS

    rows = [(1, "s", 1, None, 0), (2, "s", 3, None, 0), (3, "s", 1, None, 0)]
    out = folds.allocate(spark.createDataFrame(rows, SEQUENCE_REQUESTS), increment=3, maximum=10, block=10).orderBy("seq").collect()
    assert [(r["status"], r["first"], r["last"], r["reserved"]) for r in out] == [
        ("Allocated", 3, 3, 9), ("MaxValueExceeded", None, None, 9), ("Allocated", 6, 6, 9)
    ]


def test_long_chains(spark):
    rows = [(f"{c}{i:03d}", f"{c}{i - 1:03d}" if i else None) for c, n in (("a", 150), ("b", 1), ("c", 64)) for i in range(n)] + [("d", "lost")]
    got = {(r["leaf_id"], r["backup_id"], r["depth"]) for r in retention.chains(spark, spark.createDataFrame(rows, "backup_id string, parent_id string")).collect()}
    want = {(f"{c}{n - 1:03d}", f"{c}{i:03d}", n - 1 - i) for c, n in (("a", 150), ("b", 1), ("c", 64)) for i in range(n)} | {("d", "d", 0)}
    assert got == want
    with pytest.raises(ValueError):
        retention.chains(spark, spark.createDataFrame([("x", "y"), ("y", "x")], "backup_id string, parent_id string"))


def test_whole_numbers_are_64_bits_wide(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.columns import Typed, compile_expression

    top = 2**63 - 1
    frame = spark.createDataFrame([(top, 3), (-top - 1, -1), (7, -2), (None, 1)], "a long, b long")
    env = {c: Typed("long", F.col(c)) for c in "ab"}
    got = frame.where("b <> -1").select(*[compile_expression(f"a {op} b", env).col for op in ("+", "-", "*", "/")]).collect()

    def wrap(x):
        return (x + 2**63) % 2**64 - 2**63

    assert [tuple(r) for r in got] == [
        (wrap(top + 3), top - 3, wrap(top * 3), top // 3), (5, 9, -14, -3), (None, None, None, None)
    ]


@pytest.mark.parametrize(
    "script, value",
    [
        ("let s = 0 for i in 1..10 do let s = s + i end return s", 55),
        ("let s = 0 for i in 10..1 do let s = s + i end return s", 10),
        ("let s = 0 for i in 0..9 do let s = s + i end return s", 36),
        ("return 7 / -2", -3),
        ("return round(2.5, 0)", 2.0),
        ("return 1.0 = 1.0005", True),
        ("if 1 then return 1 else return 2 end", 2),
        ("return (5..3)[1]", 6),
        ("return !0", False),
    ],
)
def test_script_values(script, value):
    out = Session(None, 1000).run(script)
    assert (out.status, out.value) == ("Get", value)


@pytest.mark.parametrize("script", ["return 'a' + 'b'", "return 'a' < 'b'", "return x", "return 1 / 0", "return nope(1)", "begin begin end end", "throw 'x'", "return [", "get a at 1 as of 5"])
def test_script_errors(script):
    assert Session(None, 1000).run(script).status == "Errored"


def test_script_transactions(spark):
    s = Session(enc.events_log(spark, D), q.NOW)
    assert s.run("begin set ta 1 end").status == "Aborted"
    assert s.run("get ta").status == "DoesNotExist"
    assert s.run("begin set ta 1 set tb 2 commit end").status == "Set"
    assert s.run("let x = get by bucket t return count(x)").value == 2
    assert s.run("let x = get ta return concat(x, to_str(rev(x)))").value == "10"
    assert s.run(f"let x = get 'users/000001' as of {q.T} return is_null(x)").status == "Get"
    assert s.run("set ta 3 cmprev 7").status == "NotSet"
    assert footprint(parse("if true then set a 1 else get b end delete a")) == ([("P", ("lit", "a")), ("P", ("lit", "b"))], [])


def test_pages_are_the_scan(spark):
    log = enc.orders_log(spark, D)
    whole = [r["key"] for r in scans.by_range(log, "orders/1", now_l=q.NOW).collect()]
    got, cursor = [], None
    for _ in range(100):
        part, more, cursor = scans.page(log, 40, "orders/1", cursor, now_l=q.NOW)
        got += [r["key"] for r in part]
        if not more:
            break
    assert got == whole
    with pytest.raises(ValueError):
        scans.decode_cursor("nonsense")
    with pytest.raises(ValueError):
        scans.by_range(log, limit=0)


def test_prefix_end():
    assert scans.prefix_end("ab") == "ac"
    assert scans.prefix_end("a\U0010ffff") == "b"
    assert scans.prefix_end("\U0010ffff") is None


def test_pruning_keeps_reads_above_the_floor(spark):
    log = enc.events_log(spark, D)
    left = retention.prune(log, keep=2, floor_l=q.T)
    for t in (q.T, q.T + 10**8):
        assert sorted(map(tuple, reads.as_of(left, t).select("key", "revision").collect())) == sorted(map(tuple, reads.as_of(log, t).select("key", "revision").collect()))


def test_storage_round_trip(spark, tmp_path):
    log = enc.orders_log(spark, D)
    storage.write_log(log, str(tmp_path / "log"))
    back = storage.read_log(spark, str(tmp_path / "log"))
    assert back.count() == log.count()
    one = storage.read_log(spark, str(tmp_path / "log"), "orders/1-URGENT")
    assert one.count() == log.where("bucket = 'orders/1-URGENT'").count()
    more = log.limit(3).selectExpr("key", "bucket", "revision", "'new' as value", "ts_l", "expires_l", "state", "no_revision")
    assert storage.upsert(log, more).where("value = 'new'").count() == 3


def test_chain_retention():
    hour = 3600000
    rows = [
        {"backup_id": "A0", "parent_id": None, "created_l": -30 * hour, "bytes": 100},
        {"backup_id": "A1", "parent_id": "A0", "created_l": -29 * hour, "bytes": 10},
        {"backup_id": "B0", "parent_id": None, "created_l": -20 * hour, "bytes": 100},
        {"backup_id": "C0", "parent_id": None, "created_l": -40 * hour, "bytes": 100},
    ]
    assert retention.plan_chains(rows, 0, max_chains=2) == ["C0"]
    assert retention.plan_chains(rows, 0, max_age_ms=25 * hour) == ["A1", "A0", "C0"]
    assert retention.plan_chains(rows, 0, max_bytes=50) == ["A1", "A0", "C0"]


def test_split_points_of_the_known_cases(spark):
    def keys(n):
        return spark.createDataFrame([("b", f"k{i:04d}", 5) for i in range(n)], "bucket string, key string, ts_l long")

    assert ranges.split_points(keys(200), 100, 10).first()["split_key"] == "k0100"
    assert ranges.split_points(keys(50), 100, 10).isEmpty()


def test_route_range_without_broadcast(spark, monkeypatch):
    keys, m = enc.orders_log(spark, D), enc.order_map(spark, D)
    want = sorted(map(repr, ranges.route_range(keys, m).collect()))
    monkeypatch.setattr(ranges, "MAP_ROWS", 0)
    assert sorted(map(repr, ranges.route_range(keys, m).collect())) == want


def test_map_after_split_and_merge(spark):
    m = enc.order_map(spark, D)
    assert ranges.validate_map(m).isEmpty()
    cut = ranges.split_range(m, "orders/1-URGENT", "orders/1-URGENT/000000500", 99)
    assert ranges.validate_map(cut).isEmpty() and cut.count() == m.count() + 1


def test_streamed_fold_equals_batch(spark, tmp_path):
    from tidemark import schemas
    from tidemark.streaming import folds as streaming

    ops = enc.events_mutations(spark, D).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schemas.MUTATIONS.split(", ")])
    ops.coalesce(1).write.parquet(str(tmp_path / "ops"))
    stream = streaming.mutations(storage.stream_mutations(spark, str(tmp_path / "ops")))
    run = stream.writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("folded").select("key", "seq", "status").toPandas()
    want = folds.apply_mutations(ops).select("key", "seq", "status").toPandas()
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


def test_language_refuses():
    for bad in ("set", "let = 1", "if true then", "for x in 1..2 do"):
        with pytest.raises(ScriptError):
            parse(bad)


def test_locked_buckets_mark_their_free_keys(spark):
    granted = spark.createDataFrame([("b", 1, "Locked"), ("c", 2, "AlreadyLocked")], "bucket string, holder long, status string")
    keys = spark.createDataFrame([("b/1", "b"), ("b/2", "b"), ("b/3", "b"), ("c/1", "c")], "key string, bucket string")
    held = spark.createDataFrame([("b/1", 7, 99), ("b/2", 7, 100), ("b/3", 7, None)], "key string, txn_id long, expires_l long")
    assert [tuple(r) for r in visibility.stamped(granted, keys, held, 99).collect()] == [("b/1", 1)]
    assert visibility.stamped(granted, keys, held.where("false"), 99).count() == 3


def test_key_locks_by_rule(spark):
    asked = spark.createDataFrame(
        [(1, 0, "a", 5), (2, 4, "a", -1), (3, 5, "a", 0), (4, 6, "a", 9), (5, 5, "a", 7), (6, 8, "b", 1), (7, 9, "b", 1)], "seq long, txn_id long, key string, expires_ms long"
    )
    held = spark.createDataFrame([("a", 3, 10), ("b", 9, None)], "key string, txn_id long, expires_l long")
    got = {r.seq: (r.status, r.expires_l) for r in visibility.acquire(asked, held, 10).collect()}
    assert got == {
        1: ("Errored", None), 2: ("Errored", None), 3: ("Locked", None), 4: ("AlreadyLocked", None), 5: ("Locked", 17),
        6: ("AlreadyLocked", None), 7: ("Locked", 11),
    }


def test_idempotency_pruning_rules(spark):
    rows = [("s", k, t, p) for k, t, p in [("a", 1, True), ("b", 2, False), ("c", 3, False), ("d", 4, False), ("e", 4, False)]]
    entries = spark.createDataFrame(rows, "name string, idempotency_key string, created_l long, protected boolean")

    def kept(*how):
        return sorted(r.idempotency_key for r in retention.prune_idempotency(entries, *how).collect())

    assert kept(10, 0, 0) == list("abcde")
    assert kept(10, 0, 8) == list("acde")  # as old as the lifetime is too old
    assert kept(10, 2, 0) == list("ae")  # the protected one takes its place
    assert kept(10, 3, 7) == list("ade")


@pytest.mark.parametrize(
    "how, keys, top",
    [
        ({}, 0, 7),
        ({"block": 10}, 0, 7),
        ({"block": 10}, 40, 7),
        ({"block": 10, "increment": 3, "initial": 5, "maximum": 900}, 40, 7),
        ({"block": 4, "maximum": 700}, 60, 90),  # large requests are refused and small ones are not
        ({"maximum": 2000}, 60, 300),
        ({"block": 1000}, 0, 1),
    ],
)
def test_long_sequences_in_parts(spark, monkeypatch, how, keys, top):
    """Parts of 40 requests give what a plain loop over each whole sequence gives, ties, refusals and repeated keys included."""
    import random

    from tidemark.operators import sequences
    from tidemark.schemas import SEQUENCE_REQUESTS

    draw = random.Random(7)
    rows = []
    for name, n in (("a", 700), (None, 300), ("b", 90), ("c", 30), ("d", 3)):
        for i in range(n):
            key = f"k{draw.randrange(keys)}" if keys and draw.random() < 0.3 else None
            rows.append((i if i % 9 else i - i // 2 % 3, name, draw.choice([draw.randint(-1, top), 1, draw.randint(1, min(top, 7))]), key, 0))
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, SEQUENCE_REQUESTS).repartition(3)
    monkeypatch.setattr(sequences, "PART_ROWS", 10**9)
    want = sorted(map(repr, folds.allocate(frame, **how).collect()))
    assert len(want) == len(rows)
    monkeypatch.setattr(sequences, "PART_ROWS", 40)
    kernel = folds.kernel

    def watched(key, begin, step, schema):
        run = kernel(key, begin, step, schema)

        def short(batches, n=0):
            for b in batches:
                n += len(b) if "seq" in b else 0
                assert n < 150  # no task has a whole long sequence
                yield b

        return lambda batches: run(short(batches))

    monkeypatch.setattr(folds, "kernel", watched)
    assert sorted(map(repr, folds.allocate(frame, **how).collect())) == want


@pytest.mark.parametrize("map_rows", [0, 100_000])
def test_a_key_meets_few_descriptors(spark, monkeypatch, map_rows):
    """Maps of 1, 16, 17 and 300 descriptors, with gaps, open ends, and keys outside of all of them; no key is compared with a whole map."""
    from pyspark.sql import functions as F

    m, holds = [], {}
    for space, n in (("a", 300), ("b", 17), ("c", 16), ("d", 1)):
        for i in range(n):
            start, end = (f"{10 * i:05d}" if i or space == "b" else None), (f"{10 * i + (7 if i % 5 == 3 else 10):05d}" if i + 1 < n or space == "c" else None)
            m.append((space, start, end, i + 1, 1))
            holds.setdefault(space, []).append((start, end, i + 1))
    keys = [(f"{i:05d}", s) for s in "abcde" for i in range(0, 3100, 3)] + [("", "a"), (None, "a"), ("00005", None)]
    met = []
    broadcast = F.broadcast

    def watched(frame):
        met.append(frame.groupBy(*[c for c in ("space", "parent") if c in frame.columns]).count().agg(F.max("count")).first()[0])
        return broadcast(frame)

    monkeypatch.setattr(F, "broadcast", watched)
    monkeypatch.setattr(ranges, "MAP_ROWS", map_rows)
    frame = spark.createDataFrame(m, "key_space string, start_key string, end_key string, partition_id int, generation long").repartition(3)
    got = ranges.route_range(spark.createDataFrame(keys, "key string, bucket string"), frame).collect()
    want = []
    for k, s in keys:
        p = [p for a, b, p in holds.get(s, []) if k is not None and (a is None or k >= a) and (b is None or k < b)]
        want.append((k, s, *((p[0], 1) if p else (None, None))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert max(met, default=0) <= 16 and bool(met) == bool(map_rows)


def test_routing_reads_the_keys_once(spark):
    keys = spark.range(400).selectExpr("case id % 4 when 0 then null when 1 then concat('a/', id) when 2 then concat('a/b/', id) else concat('k', id) end as key")
    m = spark.createDataFrame([("a", None, "a/3", 1, 5), ("a/b", "a/b/2", None, 2, 6)], "key_space string, start_key string, end_key string, partition_id int, generation long")
    out = ranges.route(keys, m.where("key_space = 'a' or partition_id = 2"), m, 8)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    got = out.collect()
    homes = {r["key"]: r["partition_id"] for r in ranges.route_hash(keys.selectExpr("key", "key as bucket"), 8).collect()}
    assert len(got) == 400
    for r in got:
        k = r["key"]
        if k is None or k[0] == "k":
            assert tuple(r) == (k, k, "hash", homes[k], 0, True)
        elif k.startswith("a/b/"):
            assert tuple(r)[1:] == ("a/b", "range", *((2, 6, True) if k >= "a/b/2" else (None, None, False)))
        else:
            assert tuple(r)[1:] == ("a", "range", *((1, 5, True) if k < "a/3" else (None, None, False)))
