"""DuckDB SQL for the registered queries. What is replayed or iterated has SQL only where windows or unrolled rounds say it."""

from __future__ import annotations

_CENTS = "cast(round({} * 100) as bigint)"
_EVENTS = f"events_ as (select event_id, ts, user_id, event_type, {_CENTS.format('value')} as value from events)"
_ORDERS = f"orders_ as (select o_orderkey, o_custkey, o_orderstatus, {_CENTS.format('o_totalprice')} as total, o_orderpriority from orders)"
_BUCKET = "least(greatest((p_size - 1) // 7, 0), 7)"

_ARRAY = f"""with {_EVENTS}, p as (select event_id as idx, sum(value) over (order by event_id) as s from events_),
n as (select count(*) as n from events_),
q as (select o_orderkey as query_id, o_orderkey * 7919 % n as i, least(n - 1, o_orderkey * 7919 % n + o_custkey % 1000) as j from orders, n)"""
_STATIC = f"""{_ARRAY} select query_id, cast(u.s - coalesce(l.s, 0) as bigint) as sum from q join p u on u.idx = j left join p l on l.idx = i - 1"""

_LOG = f"""with {_EVENTS}, m as (select max(user_id) + 1 as n from events_),
log as (select event_id as time_id, case when event_type in ('click', 'view') then 0 when event_type = 'purchase' then 2 else 1 end as op_type, user_id as arg1,
 case when event_type in ('click', 'view', 'purchase') then value else least(n - 1, user_id + event_id % 97) end as arg2 from events_, m),
g as (select time_id, op_type, arg1 as idx, arg2 as val, sum(case when op_type = 2 then 1 else 0 end) over (partition by arg1 order by time_id) as g from log where op_type <> 1),
a as (select *, sum(val) over (partition by idx, g order by time_id) as after from g),
rel as (select time_id, op_type, idx, val, after - coalesce(lag(after) over (partition by idx order by time_id), 0) as rel from a)"""

_CHAIN = f"with {_EVENTS}, chain as (select event_id as node_id, lead(event_id) over (order by ts) as next_id, value as weight, ts from events_)"
_COIN = "(({} * 2654435761) % 2147483647) % 2"

_CELLS = "with cells as (select cast(vec_id as bigint) as i, unnest(range(len(embedding))) as j, cast(unnest(embedding) as double) as v from embeddings)"

_OPS = f"""with {_EVENTS}, ops as (select user_id as key, event_id as seq, case event_type when 'error' then 'delete' when 'view' then 'search' else 'insert' end as op, value from events_)"""
_SEARCHES = f"""{_OPS}, s as (select *, last_value(case when op <> 'search' then {{'op': op, 'value': value}} end ignore nulls) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as st from ops),
seen as (select seq, key, coalesce(st.op = 'insert', false) as found, case when st.op = 'insert' then st.value end as value from s where op = 'search')"""

_TREE = "with e as (select p_partkey // 2 as lo, p_partkey as hi from part where p_partkey >= 2)"
_CONFLICTS = """with recursive e as (select distinct least(a.l_partkey, b.l_partkey) as lo, greatest(a.l_partkey, b.l_partkey) as hi from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
 where a.l_linenumber = 1 and b.l_linenumber = 2 and a.l_partkey <> b.l_partkey), v as (select p_partkey as id from part)"""


def _rounds(n: int = 10) -> str:
    """Each round takes the open vertices without open lower neighbours and closes what they touch."""
    parts, open_ = [_CONFLICTS], "v"
    for k in range(1, n + 1):
        parts.append(f"in{k} as materialized (select id from {open_} where id not in (select hi from e join {open_} o on o.id = e.lo))")
        parts.append(f"v{k} as materialized (select id from {open_} where id not in (select id from in{k}) and id not in (select hi from e join in{k} i on i.id = e.lo))")
        open_ = f"v{k}"
    return ", ".join(parts) + ", mis as materialized (" + " union all ".join(f"select id from in{k}" for k in range(1, n + 1)) + f" union all select id from {open_})"


_STACK = f"""with {_EVENTS}, log as (select user_id as stack, event_id as seq, case when event_type in ('purchase', 'error') then 'pop' else 'push' end as op, value from events_),
r as (select *, sum(case op when 'push' then 1 else -1 end) over (partition by stack order by seq) as r from log),
l as (select *, least(0, min(r) over (partition by stack order by seq)) as low from r),
d as (select *, r - low as depth, op = 'pop' and low < lag(low, 1, 0) over (partition by stack order by seq) as underflow from l),
t as (select *, case op when 'push' then depth else depth + 1 end as level from d)"""

_LLIST = f"""with recursive {_ORDERS}, ins as (select o_orderkey + 1 as pointer, case when o_orderkey > 0 then o_orderkey * 7919 % greatest(o_orderkey, 1) + 1 else 0 end as after, o_orderkey as seq, total as value from orders_),
tree as (select pointer, value, [-seq] as path from ins where after = 0 union all select i.pointer, i.value, list_append(t.path, -i.seq) from ins i join tree t on i.after = t.pointer),
gone as (select o_orderkey + 1 as pointer from orders where o_orderstatus = 'P')"""

#: Cache: an access misses if ten other blocks came since the block's last one; a block's stay ends with its next miss, or
#: when ten others follow its last access.
_LRU = f"""with {_EVENTS}, t as (select event_type as trace_id, event_id as seq, user_id // 10 as b, value % 2 = 0 as w from events_),
a as (select *, lag(seq) over (partition by trace_id, b order by seq) as prv, coalesce(lead(seq) over (partition by trace_id, b order by seq), 1000000000000) as nxt from t),
d as (select a.trace_id, a.seq, count(x.seq) as apart from a left join a x on x.trace_id = a.trace_id and x.seq > a.prv and x.seq < a.seq and x.nxt > a.seq group by all),
m as (select a.*, a.prv is null or d.apart >= 10 as miss from a join d using (trace_id, seq))"""
_LRU_COST = f"""{_LRU}, r as (select *, sum(miss::int) over (partition by trace_id, b order by seq) as stay from m),
s as (select trace_id, b, stay, bool_or(w) as dirty, max(seq) as seq, max(nxt) = 1000000000000 as final from r group by all),
e as (select s.trace_id, s.b, s.stay, any_value(s.dirty) as dirty, any_value(s.final) and count(x.seq) < 10 as held from s left join a x on x.trace_id = s.trace_id and x.seq > s.seq and x.nxt = 1000000000000 group by all),
n as (select trace_id, count(*) as reads, count(*) filter (dirty and not held) as dirty_evictions, count(*) filter (held) as flush_writes from e group by trace_id)
select *, reads + dirty_evictions + flush_writes as total from n"""

#: First fit: of the beginnings of free stretches, the least from which the length is free.
_ALLOC = f"""with recursive {_EVENTS}, ev as (select user_id as disk, event_id as seq, value % 20 + 1 as length, row_number() over (partition by user_id order by event_id) as rn from events_),
st as (select distinct disk, cast(0 as bigint) as rn, cast([] as struct(s bigint, l bigint)[]) as held, cast(null as bigint) as seq, cast(null as bigint) as start, cast(0 as bigint) as length from ev
union all select disk, rn, case when c is null then held else list_append(held, {{'s': c, 'l': length}}) end, seq, c, length from (
 select e.disk, e.rn, st.held, e.seq, e.length, list_min(list_filter(list_concat([cast(0 as bigint)], list_transform(st.held, lambda x: x.s + x.l)), lambda p: p + e.length <= 1000 and len(list_filter(st.held, lambda x: x.s < p + e.length and x.s + x.l > p)) = 0)) as c
 from st join ev e on e.disk = st.disk and e.rn = st.rn + 1)),
al as (select disk, seq, start, length, sum(case when start is null then 0 else length end) over (partition by disk order by seq) as used from st where rn > 0)"""

_QUEUE = f"""with recursive {_EVENTS}, log as (select user_id as queue, event_id as seq, case event_type when 'purchase' then 'extract' when 'error' then 'peek' else 'insert' end as op, value % 50 as priority, value,
 row_number() over (partition by user_id order by event_id) as rn from events_),
st as (select distinct queue, cast(0 as bigint) as rn, cast([] as struct(p bigint, s bigint, v bigint)[]) as held, cast(null as bigint) as seq, cast(null as varchar) as op, cast(null as struct(p bigint, s bigint, v bigint)) as got from log
union all select l.queue, l.rn, case l.op when 'insert' then list_sort(list_append(st.held, {{'p': l.priority, 's': l.seq, 'v': l.value}})) when 'extract' then st.held[2:] else st.held end, l.seq, l.op, case when l.op <> 'insert' then st.held[1] end
 from st join log l on l.queue = st.queue and l.rn = st.rn + 1)"""

_PAIRS = """with top as (select max(p_partkey) + 1 as m from part), pairs as (select p_partkey as key, p_partkey as value, p_partkey as n from part
union all select l_partkey, l_orderkey, l_orderkey * 10 + l_linenumber + m from lineitem, top), probes as (select c_custkey * 3 as key from customer)"""

ORACLES: dict[str, str] = {
    "record_scan": f"with {_ORDERS} select * from orders_",
    "record_point_read": f"with {_ORDERS} select o_orderkey, o_custkey, total from orders_ join customer on o_orderkey = c_custkey * 7",
    "record_overlay": f"with {_EVENTS} select user_id, event_id, value from events_ qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "block_sums": f"with {_EVENTS}, b as (select event_id // 100 as block, cast(sum(value) as bigint) as total from events_ group by 1) select block, total, cast(sum(total) over (order by block) as bigint) as prefix from b",
    "lru_io_cost": _LRU_COST,
    "io_spans": f"""{_LRU.replace("value % 2 = 0 as w", "false as w")}, c as (select trace_id, seq, sum(miss::int) over (partition by trace_id order by seq) as total, miss::int as own from m),
p as (select trace_id, seq // 1000 as part, min(seq) as first, max(seq) as last from t group by all)
select p.trace_id || '/own/' || part as span, cast(l.total - f.total + f.own as bigint) as total from p join c f on f.trace_id = p.trace_id and f.seq = first join c l on l.trace_id = p.trace_id and l.seq = last
union all select p.trace_id || '/all/' || part, cast(l.total as bigint) from p join c l on l.trace_id = p.trace_id and l.seq = last""",
    "alloc_replay": f"""{_ALLOC}, fr as (select disk, seq, start, length, sum(length) over (partition by disk order by seq) as given from al where start is not null), whole as (select disk, max(used) as used from al group by disk)
select disk, seq, 'alloc' as op, start, length, cast(1000 - used as bigint) as free from al
union all select fr.disk, seq + 1000000000, 'free', start, length, cast(1000 - used + given as bigint) from fr join whole using (disk)""",
    "alloc_free_segments": f"""{_ALLOC}, kept as (select disk, start, start + length as stop from al where start is not null and seq % 2 = 1),
edges as (select disk, start, stop from kept union all select distinct disk, 1000, 1000 from ev union all select distinct disk, 0, 0 from ev),
gaps as (select disk, max(stop) over (partition by disk order by start, stop rows between unbounded preceding and 1 preceding) as a, start as b from edges)
select disk, a as start, b - a as length from gaps where b > a""",
    "block_read": f"with {_EVENTS} select event_id as pos, value from events_ where event_id >= 700 and event_id < 800",
    "block_write": f"with {_EVENTS} select event_id as pos, case when event_id >= 700 and event_id < 800 then -value else value end as value from events_",
    "record_write": f"with {_ORDERS} select o_orderkey, total from orders_",
    "merge_streams": f"""with {_EVENTS}, {_ORDERS}, u as (select event_id as time, 0 as o, value, cast(null as bigint) as total from events_ union all select o_orderkey, 1, null, total from orders_)
select row_number() over (order by time, o) - 1 as place, time, value, total from u""",
    "sort_stable": "select o_orderkey, o_custkey, row_number() over (order by o_custkey, o_orderkey) - 1 as rank from orders",
    "sort_second_key": f"with {_ORDERS} select o_orderkey, total, row_number() over (order by total, o_orderkey) - 1 as rank from orders_",
    "merge_sort_values": "select cast(p_size as bigint) as p_size, row_number() over (order by p_size) - 1 as rank from part",
    "partition_histogram": f"with b as (select cast({_BUCKET} as bigint) as bucket, count(*) as n from part group by 1) select bucket, n, cast(coalesce(sum(n) over (order by bucket rows between unbounded preceding and 1 preceding), 0) as bigint) as start from b",
    "partition_sort": f"select cast(p_size as bigint) as p_size, row_number() over (order by p_size) - 1 as rank, cast({_BUCKET} as bigint) as bucket from part",
    "merge_join_inner": f"with {_ORDERS} select o_orderkey, o_custkey, total, cast(c_nationkey as bigint) as c_nationkey, {_CENTS.format('c_acctbal')} as balance from orders_ join customer on o_custkey = c_custkey",
    "merge_join_left_default": f"with {_ORDERS} select c_custkey, cast(c_nationkey as bigint) as c_nationkey, coalesce(o_orderkey, -999) as o_orderkey, coalesce(total, -999) as total from customer left join orders_ on c_custkey = o_custkey",
    "zip_join_1to1": f"""with {_EVENTS}, l as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events_)
select o_orderkey, o_custkey, event_id, value from l join r on o_custkey = user_id and l.n = r.n""",
    "zip_join_left_default": f"""with {_EVENTS}, l as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events_)
select o_orderkey, o_custkey, coalesce(event_id, -1) as event_id, coalesce(value, -1) as value from l left join r on o_custkey = user_id and l.n = r.n""",
    "prefix_sums": f"with {_EVENTS} select event_id, value, cast(sum(value) over (order by event_id) as bigint) as prefix from events_",
    "rsq_static_offline": _STATIC,
    "rsq_static_block": _STATIC,
    "rsq_static_naive": _STATIC,
    "abs_to_rel": f"{_LOG} select time_id, cast(op_type as bigint) as op_type, idx, val, cast(rel as bigint) as rel from rel",
    "rsq_dynamic_offline": f"""{_LOG}, q as (select row_number() over (order by time_id) - 1 as query_id, time_id, arg1 as i, arg2 as j from log where op_type = 1)
select query_id, cast(coalesce(sum(rel), 0) as bigint) as sum from q left join rel on idx between i and j and rel.time_id < q.time_id group by query_id""",
    "list_head": f"{_CHAIN} select node_id from chain where node_id not in (select next_id from chain where next_id is not null)",
    "list_rank": f"{_CHAIN} select node_id, cast(coalesce(sum(weight) over (order by ts rows between unbounded preceding and 1 preceding), 0) as bigint) as rank from chain",
    "list_rank_rounds": f"{_CHAIN} select node_id, cast(coalesce(sum(weight) over (order by ts rows between unbounded preceding and 1 preceding), 0) as bigint) as rank from chain",
    "list_contract_round": f"""{_CHAIN}, t as (select *, case when node_id in (select next_id from chain) then {_COIN.format('node_id')} else 0 end as bit from (select * from chain)),
b as (select t.*, t.bit = 1 and coalesce(n.bit, 1) = 0 as gone from t left join t n on t.next_id = n.node_id)
select x.node_id, case when y.node_id is null then x.next_id else y.next_id end as next_id, x.weight + coalesce(y.weight, 0) as weight from b x left join b y on x.next_id = y.node_id and y.gone where not x.gone""",
    "matrix_transpose": f"{_CELLS} select j as i, i as j, v from cells",
    "matrix_transpose_tiles": f"{_CELLS} select j as i, i as j, v from cells where v <> 0",
    "matrix_submatrix": f"{_CELLS} select i - 10 as i, j - 5 as j, v from cells where i >= 10 and i < 50 and j >= 5 and j < 60",
    "matrix_set_submatrix": f"""{_CELLS}, s as (select j + 100 as i, i + 20 as j, v from cells where i < 32 and j < 32)
select i, j, v from cells anti join s using (i, j) union all select i, j, v from s""",
    "matrix_elements": "select cast(unnest([3, 1073741824, 1073741824]) as bigint) as i, cast(unnest([5, 9, 10]) as bigint) as j, cast(unnest([-7.5, 2.25, 0]) as double) as v",
    "dict_search": "select o_custkey as key, o_custkey in (select l_partkey from lineitem) as found from orders",
    "dict_insert_delete": """with h as (select key, count(*) as n from (select l_partkey as key from lineitem union all select p_partkey from part) group by key), d as (select o_custkey as key, count(*) as d from orders group by 1)
select key from (select h.key, unnest(range(greatest(n - coalesce(d, 0), 0))) as c from h left join d on h.key = d.key)""",
    "dict_min_max": "select min(l_partkey) as min_key, max(l_partkey) as max_key from lineitem",
    "dict_neighbors": """with k as (select distinct l_partkey as k from lineitem), p as (select distinct o_orderkey as key from orders),
a as (select key as x, 0 as real from p union all select k, 1 from k), g as (select x, max(real) as real, max(1 - real) as ask from a group by x),
w as (select x, ask, max(case when real = 1 then x end) over (order by x rows between unbounded preceding and 1 preceding) as predecessor, min(case when real = 1 then x end) over (order by x rows between 1 following and unbounded following) as successor from g)
select x as key, predecessor, successor from w where ask = 1""",
    "kv_lookup": "select o_orderkey as key, p_name from orders left join part on o_orderkey = p_partkey",
    "kv_insert_all": f"{_PAIRS} select p.key, value from probes p left join pairs using (key)",
    "kv_insert_first": f"{_PAIRS} select p.key, min_by(value, n) as value from probes p left join pairs using (key) group by p.key",
    "kv_insert_last": f"{_PAIRS} select p.key, max_by(value, n) as value from probes p left join pairs using (key) group by p.key",
    "oplog_final_state": f"{_OPS} select key, value from (select key, value, op from ops where op <> 'search' qualify row_number() over (partition by key order by seq desc) = 1) where op = 'insert'",
    "oplog_search_results": f"{_SEARCHES} select seq, key, found, value from seen",
    "oplog_last_search": f"{_SEARCHES} select key, seq, found, value from seen qualify row_number() over (partition by key order by seq desc) = 1",
    "pq_drain": f"with {_ORDERS} select o_orderpriority as priority, o_orderkey as seq, total as value, row_number() over (order by o_orderpriority, o_orderkey) - 1 as rank from orders_",
    "pq_topk": f"with {_ORDERS} select o_orderpriority as priority, o_orderkey as seq, total as value from orders_ order by 1, 2 limit 100",
    "pq_peek": f"with {_ORDERS} select o_orderpriority as priority, total as value from orders_ order by o_orderpriority, o_orderkey limit 1",
    "pq_replay": f"{_QUEUE} select queue, seq, op, got.p as priority, got.v as value, cast(len(held) as bigint) as size from st where rn > 0 and op <> 'insert'",
    "pq_sizes": f"""with {_EVENTS}, log as (select user_id as queue, event_id as seq, case event_type when 'purchase' then -1 when 'error' then 0 else 1 end as step from events_),
r as (select *, sum(step) over (partition by queue order by seq) as r from log) select queue, seq, cast(r - least(0, min(r) over (partition by queue order by seq)) as bigint) as size from r""",
    "graph_neighbors": f"{_TREE} select lo as id, hi as neighbour, 'out' as direction from e union all select hi, lo, 'in' from e",
    "tfp_depth": "select p_partkey as id, case when p_partkey = 0 then 1 else length(bin(p_partkey)) end as depth from part",
    "tfp_depth_rounds": "select p_partkey as id, case when p_partkey = 0 then 1 else length(bin(p_partkey)) end as depth from part",
    "tfp_path_labels": f"""with recursive p as (select p_partkey as id, cast(p_size as bigint) as total from part where p_partkey < 2 union all
select c.p_partkey, p.total + c.p_size from part c join p on p.id = c.p_partkey // 2 where c.p_partkey >= 2) select id, total from p""",
    "mis": f"{_rounds()} select id from mis",
    "mis_rounds": f"{_rounds()} select id from mis",
    "mis_spoilt": f"""{_CONFLICTS} select (select count(*) from e where lo % 3 = 0 and hi % 3 = 0) as dependent,
(select count(*) from v where id % 3 <> 0 and id not in (select hi from e where lo % 3 = 0) and id not in (select lo from e where hi % 3 = 0)) as uncovered""",
    "mis_independent": f"{_rounds()} select count(*) as violations from e where lo in (select id from mis) and hi in (select id from mis)",
    "mis_maximal": f"{_rounds()} select count(*) as violations from v where id not in (select id from mis) and id not in (select hi from e where lo in (select id from mis)) and id not in (select lo from e where hi in (select id from mis))",
    "stack_pops": f"""{_STACK}, p as (select *, lag(value) over (partition by stack, level order by seq) as v from t where not underflow)
select stack, seq, v as value, false as underflow from p where op = 'pop' union all select stack, seq, null, true from t where underflow""",
    "stack_final": f"{_STACK} select stack, cast(level as bigint) as level, value from (select * from t where not underflow qualify row_number() over (partition by stack, level order by seq desc) = 1) where op = 'push'",
    "stack_depths": f"{_STACK} select stack, cast(depth as bigint) as depth from t qualify row_number() over (partition by stack order by seq desc) = 1",
    "llist_traverse": f"{_LLIST} select pointer, value, row_number() over (order by path) - 1 as place from tree anti join gone using (pointer)",
    "llist_traverse_from": f"{_LLIST}, o as (select pointer, value, row_number() over (order by path) - 1 as place from tree), f as (select place as p from o where pointer = 2) select pointer, value, place from o, f where place >= p and place < p + 50",
    "llist_lookup": f"""{_LLIST}, probes as (select pointer, seq + value % 3 * pointer as seq from ins)
select p.pointer, p.seq, i.seq < p.seq and (g.pointer is null or g.pointer * 2 > p.seq) as found, case when i.seq < p.seq and (g.pointer is null or g.pointer * 2 > p.seq) then i.value end as value from probes p join ins i using (pointer) left join gone g using (pointer)""",
}
