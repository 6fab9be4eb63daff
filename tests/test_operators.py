"""Literal cases and seeded differential tests of the operators."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import ceil_div, floor_div, floor_mod, subrange
from sluice.operators import dictionaries, graphs, iomodel, joining, linked, lists, matrices, overlay, queues, range_sums, sorting, stacks
from sluice.plans.components import components
from sluice.plans import numbering
from sluice.plans.numbering import number_rows, occurrences, prefix_sum
from sluice.sources import close_records, open_records, read_batch, read_record, write_records
from tests.conftest import rows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_arithmetic_rounds_down(spark):
    df = frame(spark, [(x,) for x in range(-9, 10)], "x long").select("x", floor_div("x", 4), floor_mod("x", 4), ceil_div("x", 4))
    assert all((d, m, c) == (x // 4, x % 4, -(-x // 4)) for x, d, m, c in df.collect())
    got = frame(spark, [(v,) for v in range(-3, 60)], "v long").select("v", subrange("v", 1, 50, 8)).collect()
    assert all(b == min(max((v - 1) // 7, 0), 7) for v, b in got)


def test_numbering_and_prefix_sums(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(10), rng.choice([None, rng.randrange(-50, 50)])) for i in rng.sample(range(1000), 300)]
    df = frame(spark, data, "id long, k long, v long")
    order = sorted(data, key=lambda r: (r[1], r[0]))
    assert {r["id"]: r["pos"] for r in number_rows(df, ["k", "id"]).collect()} == {r[0]: i for i, r in enumerate(order)}
    total, want = 0, {}
    for r in sorted(data):
        total += r[2] or 0
        want[r[0]] = total
    assert {r["id"]: r["prefix"] for r in prefix_sum(df, ["id"], "v").collect()} == want
    seen, occ = {}, {}
    for r in order:
        occ[r[0]] = seen.get(r[1], 0)
        seen[r[1]] = occ[r[0]] + 1
    assert {r["id"]: r["occ"] for r in occurrences(df, "k", ["id"]).collect()} == occ
    assert number_rows(df.limit(0), ["id"]).collect() == [] and prefix_sum(df.limit(0), ["id"], "v").collect() == []


def test_components(spark):
    edges = frame(spark, [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 3)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = dict(components(edges, "a", "b").collect())
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert components(edges.limit(0), "a", "b").collect() == []


def test_records(spark, tmp_path):
    write_records(frame(spark, [(i, i * i) for i in range(20)], "pos long, v long"), f"file://{tmp_path}/r")
    r = open_records(spark, f"file://{tmp_path}/r")
    assert rows(read_record(r, 7)) == [(7, 49)] and read_record(r, 99).collect() == []
    with pytest.raises(ValueError):
        read_record(r, -1)
    assert rows(read_batch(r, frame(spark, [(3,), (3,), (50,)], "pos long"))) == [(3, 9), (3, 9)]
    close_records(r), close_records(r)


def test_overlay(spark):
    base = frame(spark, [(0, 1), (1, 2)], "pos long, v long")
    log = frame(spark, [(1, 1, 5), (1, 2, 6), (7, 3, 9)], "pos long, seq long, v long")
    assert rows(overlay.overlay(base, overlay.last_writes(log, ["pos"], ["seq"]).select("pos", "v"), ["pos"])) == [(0, 1), (1, 6), (7, 9)]
    assert rows(overlay.read_block(frame(spark, [(i,) for i in range(10)], "pos long"), 1, 4)) == [(4,), (5,), (6,), (7,)]


def test_sorts(spark):
    data = [5, 2, 8, 2, 1, 9, 5, 5, 3, 2]
    df = frame(spark, list(enumerate(data)), "pos long, v long")
    assert [r["pos"] for r in sorting.external_sort(df, "v").orderBy("rank").collect()] == [i for i, _ in sorted(enumerate(data), key=lambda x: x[1])]
    assert [r["v"] for r in sorting.sort_values(df, "v").orderBy("rank").collect()] == sorted(data)
    psort = frame(spark, [(v,) for v in (2, 1, 3, 2, 1, 3, 2, 1)], "v long")
    assert [r["v"] for r in sorting.partition_sort(psort, "v", 1, 3, 2).orderBy("rank").collect()] == [1, 1, 1, 2, 2, 2, 3, 3]
    assert rows(sorting.partition_histogram(psort, "v", 1, 3, 2)) == [(0, 6, 0), (1, 2, 6)]
    with pytest.raises(ValueError):
        sorting.partition_sort(psort, "v", 1, 2, 2)
    assert rows(sorting.top_k(df, ["v", "pos"], 2)) == [(1, 2), (4, 1)]
    assert sorting.external_sort(df.limit(0), "v").collect() == []


def test_merge_joins(spark):
    left, right = frame(spark, [(1, 10), (2, 20), (4, 40)], "key long, v long"), frame(spark, [(2, 100), (3, 200), (4, 400)], "k long, w long")
    assert rows(joining.merge_join(left, right, "key", "k")) == [(2, 20, 100), (4, 40, 400)]
    assert rows(joining.merge_join(left, right, "key", "k", "left_outer", default=-999)) == [(1, 10, -999), (2, 20, 100), (4, 40, 400)]
    assert rows(joining.merge_join(left, right.limit(0), "key", "k", "left_outer", default=-5)) == [(1, 10, -5), (2, 20, -5), (4, 40, -5)]
    assert joining.merge_join(left.limit(0), right, "key", "k").collect() == []
    nulls = frame(spark, [(2, None)], "k long, w long")
    assert (2, 20, None) in [tuple(r) for r in joining.merge_join(left, nulls, "key", "k", "left_outer", default=-5).collect()]
    for how, mode in (("outer", "sql"), ("inner", "merge")):
        with pytest.raises(ValueError):
            joining.merge_join(left, right, "key", "k", how, mode=mode)
    with pytest.raises(ValueError):
        joining.merge_join(left, right.withColumnRenamed("w", "v"), "key", "k")


@pytest.mark.parametrize("how", ["inner", "left_outer"])
def test_one_to_one_join_pairs_in_order(spark, how):
    rng = random.Random(4)
    a = [(rng.randrange(6), i) for i in range(40)]
    b = [(rng.randrange(6), i) for i in range(30)]
    want, groups = [], {}
    for k, i in b:
        groups.setdefault(k, []).append(i)
    for k, i in a:
        if groups.get(k):
            want.append((k, i, groups[k].pop(0)))
        elif how == "left_outer":
            want.append((k, i, -1))
    got = joining.merge_join(frame(spark, a, "key long, i long"), frame(spark, b, "k long, j long"), "key", "k", how, default=-1, mode="zip", left_order=["i"], right_order=["j"])
    assert rows(got) == sorted(want)


def test_static_range_sums(spark):
    array = frame(spark, [(i, 10 * (i + 1)) for i in range(8)], "idx long, val long")
    queries = frame(spark, [(0, 0, 7), (1, 2, 5), (2, 4, 4), (3, 0, 0), (4, 2, 5)], "query_id long, i long, j long")
    want = [(0, 360), (1, 180), (2, 50), (3, 10), (4, 180)]
    assert rows(range_sums.static_offline(array, queries)) == want and rows(range_sums.static_blocks(array, queries, 3)) == want
    for block in (None, 3):
        online = range_sums.StaticRangeSums(array, block)
        assert [online.query(i, j) for i, j in ((0, 7), (2, 5), (4, 4), (0, 0))] == [360, 180, 50, 10]
        for i, j in ((-1, 5), (2, 8), (4, 3)):
            with pytest.raises(ValueError):
                online.query(i, j)
    online.close()
    with pytest.raises(ValueError):
        range_sums.check_ranges(frame(spark, [(4, 3)], "i long, j long"), 8)


def test_dynamic_range_sums(spark):
    log = [(0, 0, 2, 5), (1, 1, 0, 4), (2, 2, 2, 3), (3, 1, 0, 4), (4, 2, 4, 10), (5, 0, 4, -2), (6, 1, 0, 4)]
    schema = "time_id long, op_type long, arg1 long, arg2 long"
    assert rows(range_sums.dynamic_offline(frame(spark, log, schema), 8)) == [(0, 5), (1, 3), (2, 11)]
    rng = random.Random(7)
    for n in (1, 5, 13):
        ops, a, want = [], [0] * n, []
        for t in range(60):
            kind = rng.randrange(3)
            i = rng.randrange(n)
            if kind == 1:
                j = rng.randrange(i, n)
                ops.append((t, 1, i, j))
                want.append((len(want), sum(a[i : j + 1])))
            else:
                v = rng.randrange(-9, 10)
                ops.append((t, kind, i, v))
                a[i] = a[i] + v if kind == 0 else v
        assert rows(range_sums.dynamic_offline(frame(spark, ops, schema), n)) == want
    for bad in ([(0, 0, 9, 1)], [(0, 1, 3, 2)]):
        with pytest.raises(ValueError):
            range_sums.dynamic_offline(frame(spark, bad, schema), 8)


@pytest.mark.parametrize("base", [100_000, 5])
def test_list_ranking(spark, base):
    fixed = frame(spark, [(2, 3, 10), (3, None, 10), (1, 2, 10)], "node_id long, next_id long, weight long")
    assert rows(lists.find_head(fixed)) == [(1,)]
    assert rows(lists.list_rank(fixed, base=base)) == [(1, 0), (2, 10), (3, 20)]
    chain = lists.random_list(spark, 60)
    by = {r["node_id"]: r for r in chain.collect()}
    node, total, want = ({*by} - {r["next_id"] for r in by.values()}).pop(), 0, []
    while node is not None:
        want.append((node, total))
        total, node = total + by[node]["weight"], by[node]["next_id"]
    got = lists.list_rank(chain, base=base)
    assert rows(got) == sorted(want) and lists.same_ranks(got, frame(spark, want, "node_id long, rank long"))
    two = frame(spark, [(1, 2, 5), (2, None, 1), (7, None, 3)], "node_id long, next_id long, weight long")
    assert rows(lists.list_rank(two, base=base)) == [(1, 0), (2, 5), (7, 0)]
    with pytest.raises(ValueError):
        lists.list_rank(frame(spark, [(1, 2, 1), (2, 1, 1), (3, None, 1)], "node_id long, next_id long, weight long"), base=min(base, 1))


def test_contraction_keeps_ranks(spark):
    chain = lists.random_list(spark, 50, seed=3)
    less = lists.contract(chain)
    ranks = dict(rows(lists.list_rank(chain)))
    kept = dict(rows(lists.list_rank(less)))
    assert 25 <= len(kept) < 50 and all(ranks[k] == v for k, v in kept.items())


def test_matrices(spark):
    cells = frame(spark, [(0, 0, 1.0), (1, 2, 6.0), (2, 3, 12.0)], "i long, j long, v double")
    block = frame(spark, [(0, 0, 10.0), (0, 1, 20.0), (1, 0, 30.0), (1, 1, 40.0)], "i long, j long, v double")
    now = matrices.set_submatrix(cells, block, 0, 1)
    assert rows(matrices.submatrix(now, 0, 2, 0, 3)) == [(0, 0, 1.0), (0, 1, 10.0), (0, 2, 20.0), (1, 1, 30.0), (1, 2, 40.0)]
    assert matrices.get_element(now, 1, 2, 3, 4) == 40.0 and matrices.get_element(now, 1, 3, 3, 4) == 0.0
    assert matrices.get_element(matrices.set_element(now, 2, 0, 7, 3, 4), 2, 0, 3, 4) == 7.0
    for i, j in ((3, 0), (0, 4), (-1, 0)):
        with pytest.raises(IndexError):
            matrices.get_element(now, i, j, 3, 4)
    assert rows(matrices.transpose(now)) == sorted((j, i, v) for i, j, v in rows(now))
    with pytest.raises(ValueError):
        matrices.transpose(cells, require_square=True)
    turned = matrices.untile(matrices.transpose_tiles(matrices.tiles(now, 2), 2), 2).filter("v <> 0")
    assert rows(turned) == sorted((j, i, v) for i, j, v in rows(now))


def test_dictionary(spark):
    keys = frame(spark, [(k,) for k in (10, 20, 5, 6, 12, 30, 7, 17)], "key long")
    probes = frame(spark, [(k,) for k in (10, 1, 17, 100, 10)], "key long")
    assert rows(dictionaries.search(keys, probes)) == [(1, False), (10, True), (10, True), (17, True), (100, False)]
    twice = dictionaries.insert(keys, keys.filter("key = 5"))
    assert rows(dictionaries.delete(twice, frame(spark, [(5,), (30,), (99,)], "key long"))) == [(5,), (6,), (7,), (10,), (12,), (17,), (20,)]
    assert rows(dictionaries.min_max(keys)) == [(5, 30)] and rows(dictionaries.min_max(keys.limit(0))) == [(None, None)]
    assert rows(dictionaries.neighbours(keys, frame(spark, [(5,), (8,), (30,), (31,), (1,)], "key long"))) == [(1, None, 5), (5, None, 6), (8, 7, 10), (30, 20, None), (31, 30, None)]
    pairs = frame(spark, [(10, 100, 0), (10, 101, 1), (5, 50, 2)], "key long, value long, seq long")
    ask = frame(spark, [(10,), (99,)], "key long")
    assert rows(dictionaries.lookup(pairs, ask, "key", "value")) == [(10, 100), (10, 101), (99, None)]
    assert rows(dictionaries.lookup(pairs, ask, "key", "value", policy="last", order=["seq"])) == [(10, 101), (99, None)]
    left = dictionaries.delete_rows(pairs, ask, "key", ["seq"])
    assert rows(left) == [(5, 50, 2), (10, 101, 1)]


def test_operation_log(spark):
    rng = random.Random(123)
    log, state, seen = [], {}, []
    for s in range(300):
        k, op = rng.randrange(25), rng.choice(["insert", "insert", "delete", "search"])
        v = f"value_{s}" if op == "insert" else None
        log.append((s, op, k, v))
        if op == "insert":
            state[k] = v
        elif op == "delete":
            state.pop(k, None)
        else:
            seen.append((s, k, k in state, state.get(k)))
    df = frame(spark, log, "seq long, op string, key long, value string")
    assert rows(dictionaries.final_state(df)) == sorted(state.items())
    assert rows(dictionaries.search_results(df), "seq", "key", "found", "value") == sorted(seen)
    last = {k: (s, k, f, v) for s, k, f, v in seen}
    assert rows(dictionaries.last_search_results(df), "seq", "key", "found", "value") == sorted(last.values())


def test_priority_queue(spark):
    data = [(10, 0, "first"), (10, 1, "second"), (5, 2, "minimum"), (15, 3, "maximum")]
    df = frame(spark, data, "priority long, seq long, value string")
    assert [r["value"] for r in queues.drain(df).orderBy("rank").collect()] == ["minimum", "first", "second", "maximum"]
    assert rows(queues.peek(df)) == [(5, "minimum")] and rows(queues.peek(df.limit(0))) == [(None, None)]
    assert [r["value"] for r in queues.smallest(df, 2).collect()] == ["minimum", "first"]
    rng = random.Random(9)
    log, want, heaps = [], [], {q: [] for q in range(3)}
    for s in range(400):
        q, op = rng.randrange(3), rng.choice(["insert", "insert", "extract", "peek"])
        h = heaps[q]
        if op == "insert":
            p = rng.randrange(20)
            log.append((q, s, op, p, 2 * s))
            heapq.heappush(h, (p, s, 2 * s))
        else:
            log.append((q, s, op, None, None))
            got = (heapq.heappop(h) if op == "extract" else h[0]) if h else (None, None, None)
            want.append((q, s, op, got[0], got[2], len(h)))
    df = frame(spark, log, "queue long, seq long, op string, priority long, value long")
    assert rows(queues.replay(df)) == sorted(want)
    sizes = {(r["queue"], r["seq"]): r["size"] for r in queues.sizes(df).collect()}
    assert all(sizes[w[0], w[1]] == w[5] for w in want)


GRAPHS = {
    "path": (5, [(0, 1), (1, 2), (2, 3), (3, 4)], {0, 2, 4}),
    "complete": (4, [(i, j) for i in range(4) for j in range(i)], {0}),
    "star": (5, [(0, i) for i in range(1, 5)], {0}),
    "cycle": (4, [(0, 1), (1, 2), (2, 3), (3, 0)], {0, 2}),
    "isolated": (5, [], {0, 1, 2, 3, 4}),
}


@pytest.mark.parametrize("how", [{}, {"wide": 1}, {"chunk": 2}])
@pytest.mark.parametrize("name", GRAPHS)
def test_independent_sets(spark, name, how):
    n, e, want = GRAPHS[name]
    v = frame(spark, [(i,) for i in range(n)], "id long")
    edges = frame(spark, [*e, (1, 1)], "u long, v long")
    got = graphs.independent_set(v, edges, **how)
    assert {r["id"] for r in got.collect()} == want
    assert graphs.is_independent(v, edges, got) and graphs.is_maximal(v, edges, got)


def test_deep_graphs(spark):
    """A chain of dependent vertices far longer than any number of rounds, through chunks smaller than it."""
    n = 10_000
    v, e = spark.range(n).selectExpr("id", "id % 7 as label"), spark.range(n - 1).selectExpr("id as u", "id + 1 as v")
    got = graphs.process_dag(v, e, lambda i, label, x: max(x, default=0) + 1, chunk=9000)
    assert got.filter("value <> id + 1").count() == 0 and got.count() == n
    chosen = graphs.independent_set(v, e, chunk=9000)
    assert chosen.filter("id % 2 = 1").count() == 0 and chosen.count() == n // 2


def test_running_sums_of_one_key_and_of_nulls(spark):
    rng = random.Random(9)
    data = [(rng.choice([1, 1, 1, 1, 2, None]), t, rng.choice([1, -1, -1, None]), rng.choice([None, None, t])) for t in range(300)]
    df = frame(spark, data, "k long, t long, x long, y long")
    sums, lows, known, want = {}, {}, {}, []
    for k, t, x, y in data:
        prior = lows.get(k)
        sums[k] = sums.get(k, 0) + (x or 0)
        lows[k] = min(lows.get(k, sums[k]), sums[k])
        want.append((t, sums[k], lows[k], prior, known.get(k), y if y is not None else known.get(k)))
        known[k] = y if y is not None else known.get(k)
    got = numbering.running_sum(df, ["k"], ["t"], "x", "s", low="l", prior="p")
    got = numbering.last_known(got, ["k"], ["t"], "y", "before")
    got = numbering.last_known(got, ["k"], ["t"], "y", "with", with_row=True)
    assert rows(got, "t", "s", "l", "p", "before", "with") == want
    many = frame(spark, [(1, 200_001), (2, 0), (3, 1), (4, -5)], "k long, n long")
    copies = numbering.repeat(many, "n").groupBy("k").agg(F.count("*"), F.min("__copy"), F.max("__copy"), F.countDistinct("__copy"))
    assert rows(copies) == [(1, 200_001, 0, 200_000, 200_001), (3, 1, 0, 0, 1)]


def test_independent_set_checks(spark):
    v, e = frame(spark, [(0,), (1,), (2,)], "id long"), frame(spark, [(0, 1), (1, 2)], "u long, v long")
    of = lambda *ids: frame(spark, [(i,) for i in ids], "id long")
    assert not graphs.is_independent(v, e, of(0, 1)) and not graphs.is_maximal(v, e, of(0)) and not graphs.is_independent(v, e, of(0, 9))


@pytest.mark.parametrize("how", [{}, {"wide": 1}, {"chunk": 12}])
def test_time_forward(spark, how):
    rng = random.Random(2)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(25)})
    v, e = frame(spark, [(i, i % 3) for i in range(16)], "id long, label long"), frame(spark, edges, "u long, v long")
    want = {}
    for i in range(16):
        want[i] = max([want[a] for a, b in edges if b == i], default=0) + 1 + i % 3
    got = graphs.process_dag(v, e, lambda i, label, x: max(x, default=0) + 1 + label, **how)
    assert dict(rows(got)) == want
    depth = {}
    for i in range(16):
        depth[i] = max([depth[a] for a, b in edges if b == i], default=0) + 1
    native = graphs.process_dag_native(v, e, F.max, lambda c: F.coalesce(c, F.lit(0)) + 1)
    assert dict(rows(native)) == depth
    assert rows(graphs.neighbours(frame(spark, [(0, 2), (3, 1), (0, 3), (2, 2)], "u long, v long")).filter("id = 3")) == [(3, 0, "in"), (3, 1, "in")]


def test_stacks(spark):
    lifo = [(0, s, "push", s) for s in range(10)] + [(0, 10 + s, "pop", None) for s in range(11)]
    schema = "stack long, seq long, op string, value long"
    got = rows(stacks.pops(frame(spark, lifo, schema)), "seq", "value", "underflow")
    assert [g[1] for g in got] == [*range(9, -1, -1), None] and [g[2] for g in got] == [False] * 10 + [True]
    with pytest.raises(IndexError):
        stacks.pops(frame(spark, lifo, schema), strict=True)
    rng = random.Random(11)
    log, want, real = [], [], {0: [], 1: []}
    for s in range(300):
        k, op = rng.randrange(2), rng.choice(["push", "pop"])
        log.append((k, s, op, s if op == "push" else None))
        if op == "push":
            real[k].append(s)
        else:
            want.append((k, s, real[k].pop(), False) if real[k] else (k, s, None, True))
    df = frame(spark, log, schema)
    assert rows(stacks.pops(df), "stack", "seq", "value", "underflow") == sorted(want)
    assert rows(stacks.remains(df)) == sorted((k, i + 1, v) for k, r in real.items() for i, v in enumerate(r))
    assert rows(stacks.depths(df)) == sorted((k, len(r)) for k, r in real.items())


@pytest.mark.parametrize("base", [100_000, 30])
def test_linked_lists(spark, base):
    schema = "pointer long, after long, seq long, value long"
    basic = frame(spark, [(1, None, 0, 10), (2, 1, 1, 20), (3, 2, 2, 30)], schema)
    assert [r["value"] for r in linked.order(basic, base=base).orderBy("place").collect()] == [10, 20, 30]
    gone = frame(spark, [(2,)], "pointer long")
    assert [r["value"] for r in linked.order(basic, gone, base=base).orderBy("place").collect()] == [10, 30]
    with pytest.raises(ValueError):
        linked.lookup(basic, 999)
    with pytest.raises(ValueError):
        linked.lookup(basic, 2, gone)
    assert linked.lookup(basic, 3, gone) == 30
    with pytest.raises(ValueError):
        linked.order(frame(spark, [(1, 7, 0, 1)], schema))
    rng = random.Random(6)
    real, log = [], []
    for p in range(1, 60):
        at = rng.choice([None, *real]) if real else None
        log.append((p, at, p, 100 + p))
        real.insert(0 if at is None else real.index(at) + 1, p)
    removed = rng.sample(real, 15)
    got = linked.order(frame(spark, log, schema), frame(spark, [(p,) for p in removed], "pointer long"), base=base)
    assert [r["pointer"] for r in got.orderBy("place").collect()] == [p for p in real if p not in removed]
    start = next(p for p in real[10:] if p not in removed)
    kept = [p for p in real if p not in removed]
    assert [r["pointer"] for r in linked.traverse(got, start, 5).orderBy("place").collect()] == kept[kept.index(start) :][:5]


def test_cost_model(spark):
    trace = frame(spark, [("t", i, x, w) for i, (x, w) in enumerate([(5, False), (5, True), (15, True), (25, False), (35, False)])], "trace_id string, seq long, flat_index long, is_write boolean")
    assert [r["total"] for r in iomodel.simulate_block_io(trace, 10, 30, steps=True).orderBy("seq").collect()] == [1, 1, 2, 3, 5]
    assert rows(iomodel.simulate_block_io(trace, 10, 30)) == [("t", 4, 1, 3, 8)]
    steps = iomodel.simulate_block_io(trace, 10, 30, steps=True)
    spans = frame(spark, [("all", "t", 0, 4), ("inner", "t", 2, 3)], "span string, trace_id string, first long, last long")
    assert rows(iomodel.measure(steps, spans)) == [("all", 5), ("inner", 2)]
    write = frame(spark, [("w", i, i, True) for i in range(30)], "trace_id string, seq long, flat_index long, is_write boolean")
    assert rows(iomodel.simulate_block_io(write, 10, 30)) == [("w", 3, 0, 3, 6)]


def test_allocator(spark):
    log = [("d", 0, "alloc", None, 20), ("d", 1, "alloc", None, 30), ("d", 2, "free", 0, 20), ("d", 3, "alloc", None, 80), ("d", 4, "free", 20, 30)]
    schema = "disk string, seq long, op string, start long, length long"
    df = frame(spark, log, schema)
    got = iomodel.replay_allocator(df, 100)
    assert [(r["start"], r["free"]) for r in got.orderBy("seq").collect()] == [(0, 80), (20, 50), (0, 70), (None, 70), (20, 100)]
    assert rows(iomodel.free_segments(got, 100)) == [("d", 0, 100)]
    assert rows(iomodel.free_segments(got.filter("seq < 3"), 100)) == [("d", 0, 20), ("d", 50, 50)]


def test_plans_stay_distributed(spark):
    array = spark.range(1000).select(F.col("id").alias("idx"), F.col("id").alias("val"))
    queries = spark.range(1000).select(F.col("id").alias("query_id"), F.col("id").alias("i"), F.col("id").alias("j"))
    plan = range_sums.static_offline(array, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
