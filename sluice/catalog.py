"""Registered queries: each operator over whole driver tables, with amounts in integer cents so that results are exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import cents
from sluice.operators import dictionaries, graphs, iomodel, joining, linked, lists, matrices, overlay, queues, range_sums, sorting, stacks
from sluice.plans.numbering import number_rows, prefix_sum
from sluice.plans.shared import fresh_path
from sluice.sources import open_records, read_batch, table, write_records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def long(name: str, alias: str | None = None) -> F.Column:
    return F.col(name).cast("long").alias(alias or name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", cents("value").alias("value"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("total"), "o_orderpriority")


# Records


@query
def record_scan(spark, sf_dir):
    return orders(spark, sf_dir)


@query
def record_point_read(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("o_orderkey"))
    return read_batch(orders(spark, sf_dir), wanted, "o_orderkey").select("o_orderkey", "o_custkey", "total")


@query
def record_overlay(spark, sf_dir):
    return overlay.last_writes(events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query
def block_sums(spark, sf_dir):
    return overlay.block_sums(events(spark, sf_dir).select(F.col("event_id").alias("pos"), "value"), 100, "value")


@query
def lru_io_cost(spark, sf_dir):
    trace = events(spark, sf_dir).select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("flat_index"), (F.col("value") % 2 == 0).alias("is_write"))
    return iomodel.simulate_block_io(trace, 10, 100)


@query
def alloc_replay(spark, sf_dir):
    """Every element of a user is allocated in the order of the events, and freed in that order once all are."""
    log = events(spark, sf_dir).select(F.col("user_id").alias("disk"), F.col("event_id").alias("seq"), F.lit("alloc").alias("op"), F.lit(None).cast("long").alias("start"), (F.col("value") % 20 + 1).alias("length"))
    given = iomodel.replay_allocator(log, 1000)
    freed = given.filter("start is not null").select("disk", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit("free").alias("op"), "start", "length")
    return iomodel.replay_allocator(log.unionByName(freed), 1000)


@query
def alloc_free_segments(spark, sf_dir):
    """What is free once every second element of a user has been freed."""
    log = events(spark, sf_dir).select(F.col("user_id").alias("disk"), F.col("event_id").alias("seq"), F.lit("alloc").alias("op"), F.lit(None).cast("long").alias("start"), (F.col("value") % 20 + 1).alias("length"))
    given = iomodel.replay_allocator(log, 1000).select(*log.columns)
    freed = given.filter("start is not null and seq % 2 = 0").select("disk", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit("free").alias("op"), "start", "length")
    return iomodel.free_segments(given.unionByName(freed), 1000).select("disk", "start", "length")


@query
def io_spans(spark, sf_dir):
    """Nested measurements: the cost of each hundred accesses' span and of the spans from the start to their ends."""
    trace = events(spark, sf_dir).select(F.col("event_type").alias("trace_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("flat_index"), F.lit(False).alias("is_write"))
    steps = iomodel.simulate_block_io(trace, 10, 100, steps=True)
    ends = trace.groupBy("trace_id", F.expr("seq div 1000").alias("part")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    start = trace.groupBy("trace_id").agg(F.min("seq").alias("__first"))
    spans = ends.select(F.concat_ws("/", "trace_id", F.lit("own"), "part").alias("span"), "trace_id", "first", "last")
    outer = ends.join(start, "trace_id").select(F.concat_ws("/", "trace_id", F.lit("all"), "part").alias("span"), "trace_id", F.col("__first").alias("first"), "last")
    return iomodel.measure(steps, spans.unionByName(outer)).select("span", long("total"))


@query
def block_read(spark, sf_dir):
    return overlay.read_block(events(spark, sf_dir).select(F.col("event_id").alias("pos"), "value"), 7, 100)


@query
def block_write(spark, sf_dir):
    """Block 7 with its values negated, in the whole file."""
    records = events(spark, sf_dir).select(F.col("event_id").alias("pos"), "value")
    block = overlay.read_block(records, 7, 100).withColumn("value", -F.col("value"))
    return overlay.overlay(records, block, ["pos"])


@query
def record_write(spark, sf_dir):
    """Written to a file, opened and read again."""
    path = fresh_path(spark, "records")
    write_records(orders(spark, sf_dir).select("o_orderkey", "total"), path)
    return open_records(spark, path)


@query
def merge_streams(spark, sf_dir):
    """Events and orders by time, events first where the times are equal."""
    first = events(spark, sf_dir).select(F.col("event_id").alias("time"), "value")
    second = orders(spark, sf_dir).select(F.col("o_orderkey").alias("time"), "total")
    return number_rows(joining.merge_streams(first, second, "time"), ["time", "__order"], "place").select("place", "time", "value", "total")


# Sorting


@query
def sort_stable(spark, sf_dir):
    return sorting.external_sort(orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey")


@query
def sort_second_key(spark, sf_dir):
    return sorting.external_sort(orders(spark, sf_dir).select("o_orderkey", "total"), "total", "o_orderkey")


@query
def merge_sort_values(spark, sf_dir):
    return sorting.sort_values(table(spark, sf_dir, "part").select(long("p_size")), "p_size")


@query
def partition_histogram(spark, sf_dir):
    return sorting.partition_histogram(table(spark, sf_dir, "part").select(long("p_size")), "p_size", 1, 50, 8)


@query
def partition_sort(spark, sf_dir):
    return sorting.partition_sort(table(spark, sf_dir, "part").select(long("p_size")), "p_size", 1, 50, 8)


# Joins


@query
def merge_join_inner(spark, sf_dir):
    left = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "total")
    right = table(spark, sf_dir, "customer").select("c_custkey", long("c_nationkey"), cents("c_acctbal").alias("balance"))
    return joining.merge_join(left, right, "o_custkey", "c_custkey")


@query
def merge_join_left_default(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", long("c_nationkey"))
    right = orders(spark, sf_dir).select("o_custkey", "o_orderkey", "total")
    return joining.merge_join(left, right, "c_custkey", "o_custkey", "left_outer", default=-999)


@query
def zip_join_1to1(spark, sf_dir):
    left = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    right = events(spark, sf_dir).select("user_id", "event_id", "value")
    return joining.merge_join(left, right, "o_custkey", "user_id", mode="zip", left_order=["o_orderkey"], right_order=["event_id"])


@query
def zip_join_left_default(spark, sf_dir):
    left = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    right = events(spark, sf_dir).select("user_id", "event_id", "value")
    return joining.merge_join(left, right, "o_custkey", "user_id", "left_outer", default=-1, mode="zip", left_order=["o_orderkey"], right_order=["event_id"])


# Range sums


@query
def prefix_sums(spark, sf_dir):
    return prefix_sum(events(spark, sf_dir).select("event_id", "value"), ["event_id"], "value")


def _array(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    array = events(spark, sf_dir).select(F.col("event_id").alias("idx"), F.col("value").alias("val"))
    n = array.count()
    i = F.col("o_orderkey") * 7919 % n
    queries = orders(spark, sf_dir).select(F.col("o_orderkey").alias("query_id"), i.alias("i"), F.least(F.lit(n - 1), i + F.col("o_custkey") % 1000).alias("j"))
    range_sums.check_ranges(queries, n)
    return array, queries


@query
def rsq_static_offline(spark, sf_dir):
    return range_sums.static_offline(*_array(spark, sf_dir))


@query
def rsq_static_block(spark, sf_dir):
    return range_sums.static_blocks(*_array(spark, sf_dir), 128)


@query
def rsq_static_naive(spark, sf_dir):
    """The online form: lookups in the kept sums, for every range."""
    array, queries = _array(spark, sf_dir)
    return range_sums.StaticRangeSums(array).query_many(queries)


def _log(spark, sf_dir) -> tuple[DataFrame, int]:
    rows = events(spark, sf_dir)
    n = rows.agg(F.max("user_id")).first()[0] + 1
    kind = F.when(F.col("event_type").isin("click", "view"), 0).when(F.col("event_type") == "purchase", 2).otherwise(1)
    j = F.least(F.lit(n - 1), F.col("user_id") + F.col("event_id") % 97)
    return rows.select(F.col("event_id").alias("time_id"), kind.cast("long").alias("op_type"), F.col("user_id").alias("arg1"), F.when(kind == 1, j).otherwise(F.col("value")).alias("arg2")), n


@query
def abs_to_rel(spark, sf_dir):
    log, _ = _log(spark, sf_dir)
    return range_sums.absolute_to_relative(log.filter("op_type <> 1").select("time_id", "op_type", F.col("arg1").alias("idx"), F.col("arg2").alias("val")))


@query
def rsq_dynamic_offline(spark, sf_dir):
    return range_sums.dynamic_offline(*_log(spark, sf_dir))


# Lists


def _chain(spark, sf_dir) -> DataFrame:
    placed = number_rows(events(spark, sf_dir).select("event_id", "ts", "value"), ["ts"], "n")
    after = placed.select((F.col("n") - 1).alias("n"), F.col("event_id").alias("next_id"))
    return placed.join(after, "n", "left").select(F.col("event_id").alias("node_id"), "next_id", F.col("value").alias("weight"))


@query
def list_head(spark, sf_dir):
    return lists.find_head(_chain(spark, sf_dir))


@query
def list_rank(spark, sf_dir):
    return lists.list_rank(_chain(spark, sf_dir))


@query
def list_contract_round(spark, sf_dir):
    return lists.contract(_chain(spark, sf_dir))


@query
def list_rank_rounds(spark, sf_dir):
    """The same with rounds of contraction and restoring down to 2,000 nodes."""
    return lists.list_rank(_chain(spark, sf_dir), base=2000)


# Matrices


def _cells(spark, sf_dir) -> DataFrame:
    return matrices.from_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query
def matrix_transpose(spark, sf_dir):
    return matrices.transpose(_cells(spark, sf_dir))


@query
def matrix_transpose_tiles(spark, sf_dir):
    """Through dense tiles; the cells that only fill tiles are zero."""
    turned = matrices.untile(matrices.transpose_tiles(matrices.tiles(_cells(spark, sf_dir), 16), 16), 16)
    return turned.filter("v <> 0")


@query
def matrix_submatrix(spark, sf_dir):
    return matrices.submatrix(_cells(spark, sf_dir), 10, 50, 5, 60)


@query
def matrix_set_submatrix(spark, sf_dir):
    """The matrix with its own rows 0 to 31 of columns 0 to 31, transposed, from (100, 20) on."""
    cells = _cells(spark, sf_dir)
    return matrices.set_submatrix(cells, matrices.transpose(matrices.submatrix(cells, 0, 32, 0, 32)), 100, 20)


@query
def matrix_elements(spark, sf_dir):
    """Two cells written, one of them outside all that was there, and read with a third."""
    rows, cols = 1 << 40, 1 << 20
    cells = matrices.set_element(matrices.set_element(_cells(spark, sf_dir), 3, 5, -7.5, rows, cols), 1 << 30, 9, 2.25, rows, cols)
    return spark.createDataFrame([(i, j, matrices.get_element(cells, i, j, rows, cols)) for i, j in ((3, 5), (1 << 30, 9), (1 << 30, 10))], "i long, j long, v double")


# Dictionaries


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"))


@query
def dict_search(spark, sf_dir):
    return dictionaries.search(_parts(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@query
def dict_insert_delete(spark, sf_dir):
    """All parts of lineitem and all part keys, less one copy for each order's customer key."""
    keys = dictionaries.insert(_parts(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")))
    return dictionaries.delete(keys, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@query
def dict_min_max(spark, sf_dir):
    return dictionaries.min_max(_parts(spark, sf_dir))


@query
def dict_neighbors(spark, sf_dir):
    return dictionaries.neighbours(_parts(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")))


@query
def kv_lookup(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    return dictionaries.lookup(pairs, orders(spark, sf_dir).select(F.col("o_orderkey").alias("key")), "key", "p_name")


def _pairs(spark, sf_dir) -> DataFrame:
    """Parts with each line's order number behind, as another value of the part's key."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("value"), F.col("p_partkey").alias("n"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    return dictionaries.insert_pairs(parts, lines, "key", "value", "n")


@query
def kv_insert_all(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("key"))
    return dictionaries.lookup(_pairs(spark, sf_dir), probes, "key", "value")


@query
def kv_insert_first(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("key"))
    return dictionaries.lookup(_pairs(spark, sf_dir), probes, "key", "value", policy="first", order=["n"])


@query
def kv_insert_last(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("key"))
    return dictionaries.lookup(_pairs(spark, sf_dir), probes, "key", "value", policy="last", order=["n"])


def _operations(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "search").otherwise("insert")
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), "value")


@query
def oplog_final_state(spark, sf_dir):
    return dictionaries.final_state(_operations(spark, sf_dir))


@query
def oplog_search_results(spark, sf_dir):
    return dictionaries.search_results(_operations(spark, sf_dir))


@query
def oplog_last_search(spark, sf_dir):
    return dictionaries.last_search_results(_operations(spark, sf_dir)).select("key", "seq", "found", "value")


# Priority queues


def _elements(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("seq"), F.col("total").alias("value"))


@query
def pq_drain(spark, sf_dir):
    return queues.drain(_elements(spark, sf_dir))


@query
def pq_topk(spark, sf_dir):
    return queues.smallest(_elements(spark, sf_dir), 100)


@query
def pq_peek(spark, sf_dir):
    return queues.peek(_elements(spark, sf_dir))


def _queue_log(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "extract").when(F.col("event_type") == "error", "peek").otherwise("insert")
    return events(spark, sf_dir).select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("value") % 50).alias("priority"), "value")


@query
def pq_replay(spark, sf_dir):
    return queues.replay(_queue_log(spark, sf_dir))


@query
def pq_sizes(spark, sf_dir):
    return queues.sizes(_queue_log(spark, sf_dir)).select("queue", "seq", long("size"))


# Graphs


def _tree(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("id"), long("p_size", "label")), parts.filter("p_partkey >= 2").select(F.shiftright("p_partkey", 1).alias("u"), F.col("p_partkey").alias("v"))


@query
def graph_neighbors(spark, sf_dir):
    return graphs.neighbours(_tree(spark, sf_dir)[1])


@query
def tfp_depth(spark, sf_dir):
    vertices, edges = _tree(spark, sf_dir)
    return graphs.process_dag(vertices, edges, lambda v, label, incoming: max(incoming, default=0) + 1).select("id", long("value", "depth"))


@query
def tfp_path_labels(spark, sf_dir):
    """The sum of labels on the way from the root."""
    vertices, edges = _tree(spark, sf_dir)
    return graphs.process_dag(vertices, edges, lambda v, label, incoming: sum(incoming) + label).select("id", long("value", "total"))


def _conflicts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts, joined if they are lines 1 and 2 of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    one = lines.filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("u"))
    two = lines.filter("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("v"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), one.join(two, "l_orderkey").select("u", "v")


@query
def mis(spark, sf_dir):
    return graphs.independent_set(*_conflicts(spark, sf_dir))


@query
def tfp_depth_rounds(spark, sf_dir):
    """In rounds alone, whatever number of vertices is ready."""
    vertices, edges = _tree(spark, sf_dir)
    return graphs.process_dag(vertices, edges, lambda v, label, incoming: max(incoming, default=0) + 1, wide=1).select("id", long("value", "depth"))


@query
def mis_rounds(spark, sf_dir):
    return graphs.independent_set(*_conflicts(spark, sf_dir), wide=1)


@query
def mis_spoilt(spark, sf_dir):
    """What the checks find wrong with every third vertex as a set."""
    vertices, edges = _conflicts(spark, sf_dir)
    spoilt = vertices.filter("id % 3 = 0")
    inside = graphs.dependent_edges(vertices, edges, spoilt).distinct().agg(F.count("*").alias("dependent"))
    return inside.crossJoin(graphs.uncovered_vertices(vertices, edges, spoilt).agg(F.count("*").alias("uncovered")))  # one row each


@query
def mis_independent(spark, sf_dir):
    vertices, edges = _conflicts(spark, sf_dir)
    bad = graphs.dependent_edges(vertices, edges, graphs.independent_set(vertices, edges))
    return bad.agg(F.count("*").alias("violations"))


@query
def mis_maximal(spark, sf_dir):
    vertices, edges = _conflicts(spark, sf_dir)
    bad = graphs.uncovered_vertices(vertices, edges, graphs.independent_set(vertices, edges))
    return bad.agg(F.count("*").alias("violations"))


# Stacks and linked lists


def _stack_log(spark, sf_dir) -> DataFrame:
    op = F.when(F.col("event_type").isin("purchase", "error"), "pop").otherwise("push")
    return events(spark, sf_dir).select(F.col("user_id").alias("stack"), F.col("event_id").alias("seq"), op.alias("op"), "value")


@query
def stack_pops(spark, sf_dir):
    return stacks.pops(_stack_log(spark, sf_dir))


@query
def stack_final(spark, sf_dir):
    return stacks.remains(_stack_log(spark, sf_dir)).select("stack", long("level"), "value")


@query
def stack_depths(spark, sf_dir):
    return stacks.depths(_stack_log(spark, sf_dir)).select("stack", long("depth"))


def _inserts(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return orders(spark, sf_dir).select((key + 1).alias("pointer"), F.when(key > 0, key * 7919 % F.greatest(key, F.lit(1)) + 1).alias("after"), key.alias("seq"), F.col("total").alias("value"))


def _removed(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).filter("o_orderstatus = 'P'").select((F.col("o_orderkey") + 1).alias("pointer"))


@query
def llist_traverse(spark, sf_dir):
    return linked.traverse(linked.order(_inserts(spark, sf_dir), _removed(spark, sf_dir)))


@query
def llist_traverse_from(spark, sf_dir):
    """Fifty elements from the one that was inserted second."""
    return linked.traverse(linked.order(_inserts(spark, sf_dir)), 2, 50)


@query
def llist_lookup(spark, sf_dir):
    """Each pointer looked up halfway between its insertion and twice that, where half of the removals have come."""
    removals = _removed(spark, sf_dir).select("pointer", (F.col("pointer") * 2).alias("seq"))
    probes = _inserts(spark, sf_dir).select("pointer", (F.col("seq") + F.col("value") % 3 * F.col("pointer")).alias("seq"))
    return linked.lookups(_inserts(spark, sf_dir), probes, removals)
