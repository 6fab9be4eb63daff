"""A tour of the operators on small tables: python examples/tour.py"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from sluice.operators import dictionaries, graphs, iomodel, joining, linked, lists, matrices, queues, range_sums, sorting, stacks  # noqa: E402


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    make = spark.createDataFrame

    print("A stable sort, a sort of bounded values, and joins")
    sorting.external_sort(make([(0, 5), (1, 2), (2, 5), (3, 1)], "pos long, v long"), "v").orderBy("rank").show()
    sorting.partition_sort(make([(v,) for v in (2, 1, 3, 2)], "v long"), "v", 1, 3, 2).orderBy("rank").show()
    left, right = make([(1, 10), (2, 20), (4, 40)], "key long, v long"), make([(2, 100), (4, 400)], "k long, w long")
    joining.merge_join(left, right, "key", "k", "left_outer", default=-999).show()

    print("Range sums, online and over a log")
    online = range_sums.StaticRangeSums(make([(i, 10 * (i + 1)) for i in range(8)], "idx long, val long"))
    print(online.query(0, 7), online.query(2, 5))
    online.close()
    log = [(0, 0, 2, 5), (1, 1, 0, 4), (2, 2, 2, 3), (3, 1, 0, 4), (4, 2, 4, 10), (5, 0, 4, -2), (6, 1, 0, 4)]
    range_sums.dynamic_offline(make(log, "time_id long, op_type long, arg1 long, arg2 long"), 8).orderBy("query_id").show()

    print("List ranking")
    lists.list_rank(lists.random_list(spark, 10)).orderBy("rank").show()

    print("A transpose")
    matrices.transpose(make([(0, 1, 2.0), (1, 2, 6.0)], "i long, j long, v double")).show()

    print("A dictionary's log, a priority queue, a stack, a linked list")
    ops = [(0, "insert", 10, "a"), (1, "insert", 20, "b"), (2, "delete", 20, None), (3, "search", 20, None), (4, "search", 10, None)]
    dictionaries.search_results(make(ops, "seq long, op string, key long, value string")).show()
    queue = [(0, s, op, p, p) for s, (op, p) in enumerate([("insert", 10), ("insert", 5), ("extract", None), ("peek", None)])]
    queues.replay(make(queue, "queue long, seq long, op string, priority long, value long")).show()
    stack = [(0, 0, "push", 1), (0, 1, "push", 2), (0, 2, "pop", None), (0, 3, "pop", None)]
    stacks.pops(make(stack, "stack long, seq long, op string, value long")).show()
    linked.order(make([(1, None, 0, 10), (2, 1, 1, 20), (3, 1, 2, 15)], "pointer long, after long, seq long, value long")).orderBy("place").show()

    print("Time-forward processing and a maximal independent set")
    vertices, edges = make([(i, 0) for i in range(5)], "id long, label long"), make([(0, 1), (1, 2), (2, 3), (3, 4)], "u long, v long")
    graphs.process_dag(vertices, edges, lambda v, label, incoming: sum(incoming) + 1).orderBy("id").show()
    graphs.independent_set(vertices, edges).orderBy("id").show()

    print("Block transfers of a trace")
    trace = make([("t", i, x, w) for i, (x, w) in enumerate([(5, False), (5, True), (15, True), (25, False), (35, False)])], "trace_id string, seq long, flat_index long, is_write boolean")
    iomodel.simulate_block_io(trace, 10, 30).show()
    spark.stop()


if __name__ == "__main__":
    main()
