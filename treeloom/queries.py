"""Registered queries of the tree operators, with the SQL that states each one's result.

The test tables hold no trees: each user's events make one tree (NODES), a heap-shaped binary one (BINARY), or a forest
(FOREST), by expressions that Spark and DuckDB evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions import atlas, tensors
from treeloom.operators import tree_ops
from treeloom.plans import pipeline

_EVENTS = "e as (select user_id as tree_id, event_id, event_type, value, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as n from events)"
_COLUMNS = (
    "tree_id, n, case when n = 1 then 1 when event_type in ('view', 'click') then 2 when event_type = 'error' then 4 else 3 end as type,"
    " cast((event_id * 7919) % 1000 as double) as x, cast((event_id * 104729) % 800 as double) as y, value as z, cast(1 as double) as r"
)
_RANDOM_PARENT = "case when n = 1 then cast(-1 as bigint) else 1 + ((event_id * 31 + n * 17) % (n - 1)) end"
NODES = f"{_EVENTS}, t as (select {_COLUMNS}, {_RANDOM_PARENT} as parent from e)"
BINARY = f"{_EVENTS}, t as (select {_COLUMNS}, case when n = 1 then cast(-1 as bigint) else cast(floor(n / 2) as bigint) end as parent from e)"
FOREST = f"{_EVENTS}, t as (select {_COLUMNS}, case when n % 25 = 1 then cast(-1 as bigint) else {_RANDOM_PARENT} end as parent from e)"
BROKEN = f"{_EVENTS}, t as (select {_COLUMNS}, case when tree_id % 7 = 1 and n = 5 then cast(100000 as bigint) when tree_id % 7 = 2 and n = 1 then cast(2 as bigint) else {_RANDOM_PARENT} end as parent from e)"
LIMIT = 300.0

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def view(spark: SparkSession, sf_dir: str, sql: str = NODES) -> DataFrame:
    """One of the derived node tables, without registering anything in the session."""
    return spark.sql(f"with events as (select * from {{events}}), {sql} select * from t", events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) and, unless None, the body of its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_LEN = "sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z))"
_EDGES = f"g as (select c.tree_id, c.n, c.parent, {_LEN} as len from t c join t p on c.tree_id = p.tree_id and c.parent = p.n)"
_KIDS = "k as (select tree_id, parent as n, count(*) as c from t where parent != -1 group by 1, 2)"
_TOPOLOGY = "l as (select t.*, case when coalesce(k.c, 0) = 0 then 'T' when k.c > 1 then 'B' when t.parent = -1 then 'R' else 'G' end as node_type from t left join k on t.tree_id = k.tree_id and t.n = k.n)"
#: a: each node with itself and all its ancestors (x over a node of the subtree s).
_CLOSURE = "a as (select tree_id, n as s, n as x, parent from t union all select a.tree_id, a.s, t.n, t.parent from a join t on a.tree_id = t.tree_id and a.parent = t.n)"


#: w: each node with the ids on the way from its root.
_PATHS = "w as (select tree_id, n, [n] as path from t where parent = -1 union all select t.tree_id, t.n, list_append(w.path, t.n) from w join t on w.tree_id = t.tree_id and t.parent = w.n)"


def _named(nodes: str, name: str) -> str:
    """One of the derived node tables under another name than t."""
    return nodes.replace("), t as (select", f"), {name} as (select")


def _bifurcated(src: str, dst: str) -> str:
    """Tables up to dst: the binary tree of each tree in src. A node v with m > 2 children but the root's gets copies 1 to m - 1 above it.

    Copies form a chain down to v; all children but the longest hang on the copy of their rank. Ids follow the preorder.
    """
    return (
        f"b1 as (select tree_id, n, [n] as path from {src} where parent = -1 union all select c.tree_id, c.n, list_append(b1.path, c.n) from b1 join {src} c on c.tree_id = b1.tree_id and c.parent = b1.n),"
        " b2 as materialized (select tree_id, n, row_number() over (partition by tree_id order by path) as id from b1),"
        f" b3 as materialized (select s.tree_id, b2.id, coalesce(u.id, -1) as up, s.type, s.x, s.y, s.z from {src} s join b2 on b2.tree_id = s.tree_id and b2.n = s.n left join b2 u on u.tree_id = s.tree_id and u.n = s.parent),"
        " b4 as materialized (select c.tree_id, c.id, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z)) as len from b3 c join b3 p on c.tree_id = p.tree_id and c.up = p.id),"
        " b5 as (select tree_id, id as s, id as x, up from b3 union all select b5.tree_id, b5.s, b3.id, b3.up from b5 join b3 on b3.tree_id = b5.tree_id and b3.id = b5.up),"
        " b6 as (select b5.tree_id, b5.x as id, sum(coalesce(b4.len, 0)) as weight from b5 left join b4 on b4.tree_id = b5.tree_id and b4.id = b5.s group by 1, 2),"
        " b7 as materialized (select c.tree_id, c.id, c.up, row_number() over (partition by c.tree_id, c.up order by round(b6.weight, 6), c.id) as rk, count(*) over (partition by c.tree_id, c.up) as m, p.up != -1 as inner_up"
        " from b3 c join b6 on b6.tree_id = c.tree_id and b6.id = c.id join b3 p on p.tree_id = c.tree_id and p.id = c.up),"
        " b8 as (select distinct tree_id, up as id, m from b7 where m > 2 and inner_up),"
        " b9 as (select tree_id, id, unnest(range(1, m)) as i, m from b8),"
        " c1 as materialized (select b9.*, (select count(*) from b3 where b3.tree_id = b9.tree_id) + row_number() over (partition by b9.tree_id order by b9.id, i) as own from b9),"
        # where what stands for a node hangs: its parent, or the copy of its rank
        " c2 as materialized (select b3.tree_id, b3.id, coalesce(c1.own, b3.up) as hang from b3 left join b7 on b7.tree_id = b3.tree_id and b7.id = b3.id left join c1 on c1.tree_id = b3.tree_id and c1.id = b3.up and c1.i = b7.rk),"
        " c3 as materialized (select b3.tree_id, b3.id, coalesce(l.own, c2.hang) as up, b3.type, b3.x, b3.y, b3.z from b3 join c2 on c2.tree_id = b3.tree_id and c2.id = b3.id left join c1 l on l.tree_id = b3.tree_id and l.id = b3.id and l.i = l.m - 1"
        " union all select k.tree_id, k.own, coalesce(l.own, c2.hang), b3.type, b3.x, b3.y, b3.z from c1 k join c2 on c2.tree_id = k.tree_id and c2.id = k.id join b3 on b3.tree_id = k.tree_id and b3.id = k.id left join c1 l on l.tree_id = k.tree_id and l.id = k.id and l.i = k.i - 1),"
        " c4 as (select tree_id, id, [id] as path from c3 where up = -1 union all select c3.tree_id, c3.id, list_append(c4.path, c3.id) from c4 join c3 on c3.tree_id = c4.tree_id and c3.up = c4.id),"
        " c5 as materialized (select tree_id, id, row_number() over (partition by tree_id order by path) as n from c4),"
        f" {dst} as materialized (select c3.tree_id, c5.n, coalesce(u.n, -1) as parent, c3.type, c3.x, c3.y, c3.z from c3 join c5 on c5.tree_id = c3.tree_id and c5.id = c3.id left join c5 u on u.tree_id = c3.tree_id and u.id = c3.up)"
    )


def _pruned(src: str, dst: str, limit: float, rounds: int) -> str:
    """Tables up to dst: src after so many rounds of cutting short terminal chains; without trees that have no branch."""
    out = (
        f"p0 as materialized (select c.tree_id, c.n, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) + (c.z - p.z) * (c.z - p.z)) as len from {src} c join {src} p on c.tree_id = p.tree_id and c.parent = p.n),"
        f" q0 as materialized (select * from {src} where tree_id in (select tree_id from {src} where parent != -1 group by tree_id, parent having count(*) > 1))"
    )
    for k in range(rounds):
        q = f"q{k}"
        out += (
            f", k{k} as materialized (select s.tree_id, s.n, s.parent, (select count(*) from {q} c where c.tree_id = s.tree_id and c.parent = s.n) as c from {q} s),"
            f" h{k} as (select tree_id, n as tail, n, parent from k{k} where c != 1 union all select h{k}.tree_id, h{k}.tail, b.n, b.parent from h{k} join k{k} b on h{k}.tree_id = b.tree_id and h{k}.parent = b.n and b.c = 1),"
            f" i{k} as materialized (select h{k}.tree_id, h{k}.tail, sum(coalesce(p0.len, 0)) as len, arg_min(h{k}.parent, h{k}.n) as parent_seg from h{k} left join p0 on p0.tree_id = h{k}.tree_id and p0.n = h{k}.n group by 1, 2),"
            f" j{k} as (select v.*, exists (select 1 from i{k} c where c.tree_id = v.tree_id and c.parent_seg = v.tail) as has_child from i{k} v),"
            f" z{k} as materialized (select *, bool_and(not has_child) over (partition by tree_id, parent_seg) as all_end, row_number() over (partition by tree_id, parent_seg order by len desc, tail) as rk from j{k}),"
            f" q{k + 1} as materialized (select {q}.* from {q} where not exists (select 1 from h{k} join z{k} on z{k}.tree_id = h{k}.tree_id and z{k}.tail = h{k}.tail where h{k}.tree_id = {q}.tree_id and h{k}.n = {q}.n"
            f" and z{k}.parent_seg != -1 and not z{k}.has_child and z{k}.len <= {limit} and not (z{k}.all_end and z{k}.rk = 1)))"
        )
    return out + f", {dst} as materialized (select * from q{rounds})"


@query(f"with {NODES} select tree_id, n, type, x, y, z, r, parent from t")
def node_table(spark, sf_dir):
    return view(spark, sf_dir)


@query(f"with {NODES}, {_EDGES}, {_KIDS}, {_TOPOLOGY}, s as (select tree_id, sum(len) as len from g group by 1)"
       " select l.tree_id, count(*) as n_nodes, count(*) filter (where node_type = 'T') as n_terminals, count(*) filter (where node_type = 'B') as n_branches, round(max(s.len), 4) as path_len from l join s on l.tree_id = s.tree_id group by 1")
def tree_summary(spark, sf_dir):
    nodes = view(spark, sf_dir)
    counts = tree_ops.topology_label(nodes).groupBy("tree_id").agg(
        F.count("*").alias("n_nodes"), F.count(F.when(F.col("node_type") == "T", 1)).alias("n_terminals"), F.count(F.when(F.col("node_type") == "B", 1)).alias("n_branches"))
    return counts.join(tree_ops.path_length(nodes), "tree_id").withColumn("path_len", F.round("path_len", 4))


@query(f"with {NODES}, {_KIDS} select t.tree_id, t.n, cast(coalesce(k.c, 0) as bigint) as n_children from t left join k on t.tree_id = k.tree_id and t.n = k.n")
def child_counts(spark, sf_dir):
    return tree_ops.child_counts(view(spark, sf_dir))


@query(f"with {NODES} select tree_id, parent as n, string_agg(cast(n as varchar), ',' order by n) as children from t where parent != -1 group by 1, 2")
def child_map(spark, sf_dir):
    return tree_ops.child_map(view(spark, sf_dir)).select("tree_id", "n", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query(f"with {NODES}, {_KIDS}, {_TOPOLOGY} select tree_id, n, node_type from l")
def topology_label(spark, sf_dir):
    return tree_ops.topology_label(view(spark, sf_dir)).select("tree_id", "n", "node_type")


@query(f"with {NODES} select tree_id, n from t where not exists (select 1 from t c where c.tree_id = t.tree_id and c.parent = t.n)")
def terminals(spark, sf_dir):
    return tree_ops.terminals(view(spark, sf_dir)).select("tree_id", "n")


@query(f"with {FOREST} select tree_id, n from t where parent = -1")
def roots(spark, sf_dir):
    return tree_ops.roots(view(spark, sf_dir, FOREST)).select("tree_id", "n")


@query(f"with {NODES}, {_EDGES} select tree_id, n, round(len, 4) as edge_len from g")
def edge_lengths(spark, sf_dir):
    return tree_ops.edge_lengths(view(spark, sf_dir)).withColumn("edge_len", F.round("edge_len", 4))


@query(f"with {NODES}, {_EDGES} select t.tree_id, round(coalesce(sum(g.len), 0), 4) as path_len from t left join g on t.tree_id = g.tree_id and t.n = g.n group by 1")
def tree_path_len(spark, sf_dir):
    return tree_ops.path_length(view(spark, sf_dir)).withColumn("path_len", F.round("path_len", 4))


@query(f"with {NODES}, {_EDGES} select t.tree_id, round(coalesce(sum(g.len), 0), 4) as path_len from t left join g on t.tree_id = g.tree_id and t.n = g.n and t.type = 2 group by 1")
def subset_path_len(spark, sf_dir):
    nodes = view(spark, sf_dir)
    return tree_ops.path_length(nodes, nodes.where("type = 2")).withColumn("path_len", F.round("path_len", 4))


@query(f"with recursive {NODES}, {_EDGES}, {_CLOSURE} select a.tree_id, a.x as n, count(*) as size, round(sum(case when a.s != a.x then coalesce(g.len, 0) else 0 end), 3) as below, round(sum(coalesce(g.len, 0)), 3) as with_edge"
       " from a left join g on a.tree_id = g.tree_id and a.s = g.n group by 1, 2")
def subtree_weights(spark, sf_dir):
    rows = pipeline.accepted(pipeline.subtree_weights(view(spark, sf_dir)))
    return rows.select("tree_id", "n", "size", F.round("below", 3).alias("below"), F.round("with_edge", 3).alias("with_edge"))




@query(f"with recursive {NODES}, {_PATHS}, o as (select tree_id, n, cast(row_number() over (partition by tree_id order by path) as bigint) as new_n from w)"
       " select o.tree_id, o.new_n as n, coalesce(q.new_n, -1) as parent, t.x, t.z from o join t on o.tree_id = t.tree_id and o.n = t.n left join o q on q.tree_id = t.tree_id and q.n = t.parent")
def renumber(spark, sf_dir):
    return pipeline.accepted(pipeline.renumber(view(spark, sf_dir))).select("tree_id", "n", "parent", "x", "z")


@query(f"with recursive {FOREST}, m as (select tree_id, min(n) as n from t where parent = -1 group by 1), w as (select tree_id, n from m union all select t.tree_id, t.n from w join t on w.tree_id = t.tree_id and t.parent = w.n)"
       " select t.tree_id, t.n, t.parent from t join w on t.tree_id = w.tree_id and t.n = w.n")
def first_root_component(spark, sf_dir):
    return pipeline.accepted(pipeline.first_root(view(spark, sf_dir, FOREST))).select("tree_id", "n", "parent")


@query(f"with recursive {NODES}, {_bifurcated('t', 'd')} select tree_id, n, parent, x, z from d")
def bifurcate(spark, sf_dir):
    return pipeline.accepted(pipeline.bifurcate(view(spark, sf_dir))).select("tree_id", "n", "parent", "x", "z")


#: h: each node with the segment it belongs to, by climbing from tails through only children.
_SEGMENTS = (
    f"{_KIDS}, b as (select t.tree_id, t.n, t.parent, coalesce(k.c, 0) as c from t left join k on t.tree_id = k.tree_id and t.n = k.n),"
    " h as (select tree_id, n as tail, n, parent from b where c != 1 union all select h.tree_id, h.tail, b.n, b.parent from h join b on h.tree_id = b.tree_id and h.parent = b.n and b.c = 1),"
    " u as (select tree_id, tail, count(*) as n_nodes, min(n) as top from h group by 1, 2),"
    " v as (select u.tree_id, u.tail, u.n_nodes, b.parent as parent_seg from u join b on u.tree_id = b.tree_id and u.top = b.n)"
)


@query(f"with recursive {NODES}, {_SEGMENTS}, {_CLOSURE}, le as (select a.tree_id, a.x as n, min(a.s) as least from a join b on b.tree_id = a.tree_id and b.n = a.s and b.c = 0 group by 1, 2)"
       " select v.tree_id, v.tail, v.parent_seg, (select string_agg(cast(h.n as varchar), ',' order by h.n desc) from h where h.tree_id = v.tree_id and h.tail = v.tail) as nodes,"
       " coalesce((select string_agg(cast(c.tail as varchar), ',' order by le.least) from v c join le on le.tree_id = c.tree_id and le.n = c.tail where c.tree_id = v.tree_id and c.parent_seg = v.tail), '') as child_segs from v")
def segments(spark, sf_dir):
    rows = pipeline.accepted(pipeline.segments(view(spark, sf_dir)))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select("tree_id", "tail", "parent_seg", joined("nodes").alias("nodes"), joined("child_seg").alias("child_segs"))


@query(f"with recursive {NODES}, {_CLOSURE}, {_PATHS} select a.tree_id, a.x as n, string_agg(cast(a.s as varchar), ',' order by w.path) as nodes from a join w on w.tree_id = a.tree_id and w.n = a.s group by 1, 2")
def subtree_nodes(spark, sf_dir):
    rows = pipeline.accepted(pipeline.subtree_nodes(view(spark, sf_dir)))
    return rows.select("tree_id", "n", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"))


@query(f"with recursive {NODES}, {_EDGES}, {_SEGMENTS},"
       " y as (select h.tree_id, h.tail, sum(coalesce(g.len, 0)) as len from h left join g on h.tree_id = g.tree_id and h.n = g.n group by 1, 2),"
       " i as (select v.*, y.len, exists (select 1 from v c where c.tree_id = v.tree_id and c.parent_seg = v.tail) as has_child from v join y on v.tree_id = y.tree_id and v.tail = y.tail),"
       " j as (select *, bool_and(not has_child) over (partition by tree_id, parent_seg) as all_end, row_number() over (partition by tree_id, parent_seg order by len desc, tail) as rk from i),"
       f" z as (select tree_id, tail from j where parent_seg != -1 and not has_child and len <= {LIMIT} and not (all_end and rk = 1))"
       " select h.tree_id, h.n from h where not exists (select 1 from z where z.tree_id = h.tree_id and z.tail = h.tail)")
def prune_round(spark, sf_dir):
    return pipeline.accepted(pipeline.prune(view(spark, sf_dir), LIMIT, rounds=1)).select("tree_id", "n")


#: A limit at which chains of the heap-shaped trees are cut in several rounds; ROUNDS more than any tree of them needs.
FAR, ROUNDS = 2500.0, 8


@query(f"with recursive {BINARY}, {_pruned('t', 'd', FAR, ROUNDS)} select tree_id, n, parent from d")
def prune(spark, sf_dir):
    return pipeline.accepted(pipeline.prune(view(spark, sf_dir, BINARY), FAR)).select("tree_id", "n", "parent")


def _cleaned(nodes: str, dst: str, least: int = 10) -> str:
    """Tables up to dst: quality control over a derived node table. t0: the raw nodes; d: binary trees; f: pruned ones."""
    return (
        f"{_named(nodes, 't0')}, t1 as (select tree_id, min(n) as n from t0 where parent = -1 group by 1),"
        " t2 as (select tree_id, n from t1 union all select c.tree_id, c.n from t2 join t0 c on c.tree_id = t2.tree_id and c.parent = t2.n),"
        f" t3 as materialized (select t0.* from t0 join t2 on t2.tree_id = t0.tree_id and t2.n = t0.n), {_bifurcated('t3', 'd')}, {_pruned('d', 'f', LIMIT, 4)},"
        f" {dst} as materialized (select * from f where tree_id in (select tree_id from f group by 1 having count(*) >= {least}))"
    )


@query(f"with recursive {_cleaned(FOREST, 't')} select tree_id, n, type, x, y, z, parent, cast(null as varchar) as reason from t union all"
       " select tree_id, null, null, null, null, null, null, case when tree_id in (select tree_id from f) then 'too_small' else 'unbranched' end from (select distinct tree_id from t0) where tree_id not in (select tree_id from t)")
def qc_pipeline(spark, sf_dir):
    return pipeline.quality_control(view(spark, sf_dir, FOREST), LIMIT).select("tree_id", "n", "type", "x", "y", "z", "parent", "reason")


_CLASS = "m as (select *, case when type = 2 then 'axon' else 'dendrite' end as cls from t where parent != -1)"
#: o: nodes of the binary trees with their component's top node; d: path length under each node within its component.
_PARTS = (
    f"{_EDGES}, {_CLASS}, o as (select m.tree_id, m.cls, m.n, m.n as top from m left join m p on m.tree_id = p.tree_id and m.parent = p.n and m.cls = p.cls where p.n is null"
    " union all select m.tree_id, m.cls, m.n, o.top from o join m on m.tree_id = o.tree_id and m.cls = o.cls and m.parent = o.n)"
)


@query(f"with recursive {BINARY}, {_PARTS}, q as (select o.tree_id, o.cls, o.top, min(o.n) filter (where not exists (select 1 from m c where c.tree_id = o.tree_id and c.cls = o.cls and c.parent = o.n)) as least from o group by 1, 2, 3),"
       " s as (select *, row_number() over (partition by tree_id, cls order by least) - 1 as comp_ord from q)"
       " select o.tree_id, o.cls as class, s.comp_ord, o.n from o join s on o.tree_id = s.tree_id and o.cls = s.cls and o.top = s.top")
def components(spark, sf_dir):
    return pipeline.accepted(pipeline.class_components(view(spark, sf_dir, BINARY)))


def _traversal(ordering: str, lesser_first: bool) -> str:
    """Tables up to tr (tree_id, pos, n): a traversal of t by child codes 1 and 3 along the path, closed by 0, 2 or 4.

    Components come by length, then class and order.
    """
    own = {"pre": 0, "in": 2, "post": 4}[ordering]
    first, second = (1, 3) if lesser_first else (3, 1)
    way = "asc" if lesser_first else "desc"
    return (
        f"{_PARTS},"
        " ca as (select o.tree_id, o.top, o.n as s, o.n as x from o union all select ca.tree_id, ca.top, ca.s, t.parent from ca join t on t.tree_id = ca.tree_id and t.n = ca.x where ca.x != ca.top),"
        " dw as (select ca.tree_id, ca.x as n, ca.top, sum(case when ca.s != ca.x then g.len else 0 end) as below from ca join g on g.tree_id = ca.tree_id and g.n = ca.s group by 1, 2, 3),"
        " rk as (select dw.*, t.parent, row_number() over (partition by dw.tree_id, dw.top, t.parent order by round(dw.below, 6), dw.n) as rk from dw join t on t.tree_id = dw.tree_id and t.n = dw.n),"
        f" pw as (select tree_id, top, n, cast([] as integer[]) as path from rk where n = top union all select rk.tree_id, rk.top, rk.n, list_append(pw.path, case when rk.rk = 1 then {first} else {second} end) from pw join rk on rk.tree_id = pw.tree_id and rk.top = pw.top and rk.parent = pw.n where rk.n != rk.top),"
        " q as (select o.tree_id, o.cls, o.top, min(o.n) filter (where not exists (select 1 from m c where c.tree_id = o.tree_id and c.cls = o.cls and c.parent = o.n)) as least from o group by 1, 2, 3),"
        " z as (select q.*, dw.below from q join dw on dw.tree_id = q.tree_id and dw.n = q.top),"
        f" tr as (select pw.tree_id, row_number() over (partition by pw.tree_id order by round(z.below, 6) {way}, z.cls, z.least, list_append(pw.path, {own})) as pos, pw.n from pw join z on z.tree_id = pw.tree_id and z.top = pw.top)"
    )


def _register_traversals() -> None:
    for ordering in ("pre", "in", "post"):
        for lesser_first in (True, False):
            name = f"{ordering}order" + ("" if lesser_first else "_greater_first")

            def run(spark, sf_dir, ordering=ordering, lesser_first=lesser_first):
                return pipeline.accepted(pipeline.sequences(view(spark, sf_dir, BINARY), ordering, lesser_first)).select("tree_id", "pos", "n")

            QUERIES[name], ORACLE_SQL[name] = run, f"with recursive {BINARY}, {_traversal(ordering, lesser_first)} select * from tr"


_register_traversals()

_VOXELS = "cast(round_even(x / 25, 0) as bigint) as ix, cast(round_even(y / 25, 0) as bigint) as iy, cast(round_even(z / 25, 0) as bigint) as iz"
_SIZE = (38, 30, 20)


@query(f"with {NODES}, v as (select *, {_VOXELS} from t) select v.tree_id, v.n, case when ix between 0 and {_SIZE[0] - 1} and iy between 0 and {_SIZE[1] - 1} and iz between 0 and {_SIZE[2] - 1} then coalesce(r.r_name, 'unknown') else 'unknown' end as region"
       " from v left join nation q on q.n_nationkey = (ix * 7 + iy * 3 + iz) % 31 left join region r on r.r_regionkey = q.n_regionkey")
def region_annotation(spark, sf_dir):
    """Nations stand in for fine regions, their regions for the selected ones; voxels outside 0 to 24 have none."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    b, c = _SIZE[1:]
    volume = spark.range(_SIZE[0] * b * c).selectExpr(f"id div {b * c} as ix", f"id div {c} % {b} as iy", f"id % {c} as iz")
    volume = volume.withColumn("region_id", (F.col("ix") * 7 + F.col("iy") * 3 + F.col("iz")) % 31)
    rollup = read("nation").select(F.col("n_nationkey").cast("bigint").alias("region_id"), F.col("n_regionkey").cast("bigint").alias("selected_id"))
    names = read("region").select(F.col("r_regionkey").cast("bigint").alias("selected_id"), F.col("r_name").alias("abbreviation"))
    return atlas.annotate(view(spark, sf_dir), volume, rollup, names, _SIZE, (25.0, 25.0, 25.0)).select("tree_id", "n", "region")


@query(f"with {NODES} select tree_id, n, " + ", ".join(f"round(({c} - avg({c}) over w) / case when stddev_pop({c}) over w = 0 then 1 else stddev_pop({c}) over w end, 4) as {c}_z" for c in "xyz") + " from t window w as (partition by tree_id)")
def zscore_per_tree(spark, sf_dir):
    rows = tree_ops.z_scores(view(spark, sf_dir))
    return rows.select("tree_id", "n", *[F.round(f"{c}_z", 4).alias(f"{c}_z") for c in "xyz"])


@query("with u as (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings) select vec_id, cast(dim as bigint) as dim, round((v - avg(v) over w) / case when stddev_pop(v) over w = 0 then 1 else stddev_pop(v) over w end, 4) + 0.0 as v_z from u window w as (partition by dim)")
def vocab_zscore(spark, sf_dir):
    from treeloom.sources.lookups import standardised_vectors

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))
    return standardised_vectors(vectors).select(F.col("token").alias("vec_id"), F.posexplode("vec").alias("dim", "v")).select("vec_id", F.col("dim").cast("bigint").alias("dim"), (F.round("v", 4) + 0.0).alias("v_z"))


@query(f"with {NODES}, {_KIDS}, {_TOPOLOGY} select tree_id, n, cast(node_type = 'B' as double) as is_b, cast(node_type = 'G' as double) as is_g, cast(node_type = 'T' as double) as is_t from l")
def one_hot_node_type(spark, sf_dir):
    rows = tree_ops.topology_label(view(spark, sf_dir))
    return rows.select("tree_id", "n", *[(F.col("node_type") == t).cast("double").alias(f"is_{t.lower()}") for t in tensors.NODE_TYPES])


@query("with c as (select distinct c_mktsegment as label from customer), k as (select label, row_number() over (order by label) - 1 as code from c), b as (select c_custkey as tree_id, code, (select count(*) from k) as m from customer join k on k.label = c_mktsegment)"
       " select tree_id, code, i.i as at, cast(i.i = code as double) as hot from b, (select unnest(range(0, 100)) as i) i where i.i < m")
def label_one_hot(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("tree_id"), F.col("c_mktsegment").alias("label"))
    return tensors.encode_labels(labels).select("tree_id", F.col("code").cast("bigint").alias("code"), F.posexplode("one_hot").alias("at", "hot")).select("tree_id", "code", F.col("at").cast("bigint").alias("at"), F.col("hot").cast("double").alias("hot"))


@query(f"with {NODES}, s as (select tree_id, n, z, count(*) over (partition by tree_id) as m from t), p as (select distinct tree_id, m from s)"
       f" select p.tree_id, i.i as pos, round(coalesce(s.z, 0), 3) as v from p join (select unnest(range(0, {60})) as i) i on true left join s on s.tree_id = p.tree_id and s.n = i.i + p.m - 60 + 1")
def pad_sequence(spark, sf_dir):
    rows = view(spark, sf_dir).groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "z"))), lambda x: x["z"]).alias("v"))
    rows = rows.select("tree_id", F.posexplode(tensors.padded(F.col("v"), 60, F.lit(0.0))).alias("pos", "v"))
    return rows.select("tree_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 3).alias("v"))


@query(f"with {NODES}, {_KIDS}, {_TOPOLOGY}, a as (select *, 1 + coalesce(sum(case when node_type = 'T' then 1 else 0 end) over (partition by tree_id order by n rows between unbounded preceding and 1 preceding), 0) as word, sum(case when node_type = 'T' then 1 else 0 end) over (partition by tree_id) as words from l),"
       " b as (select tree_id, n, word from a where word <= words union all select tree_id, n, word + 1 from a where node_type = 'T' and word < words)"
       " select tree_id, cast(word as bigint) as word, row_number() over (partition by tree_id, word order by n) as at, n from b")
def words(spark, sf_dir):
    rows = tree_ops.topology_label(view(spark, sf_dir)).withColumn("pos", F.col("n"))
    return tensors.words(rows).select("tree_id", F.col("word").cast("bigint").alias("word"), F.col("at").cast("bigint").alias("at"), "n")


@query(f"with {BROKEN}, c as (select tree_id, count(*) filter (where parent = -1) as roots, count(*) filter (where parent != -1 and not exists (select 1 from t p where p.tree_id = t.tree_id and p.n = t.parent)) as lost, count(*) as m from t group by 1)"
       " select tree_id, case when roots = 0 then 'no_root' when lost > 0 then 'dangling_parent' else 'too_small' end as reason from c where roots = 0 or lost > 0 or m < 60")
def reject_report(spark, sf_dir):
    return tree_ops.reject_reasons(view(spark, sf_dir, BROKEN), least=60)


@query(f"with {NODES} select tree_id, count(*) as n_nodes from t group by 1 having count(*) >= 70")
def tree_size_filter(spark, sf_dir):
    return tree_ops.large_enough(view(spark, sf_dir), 70).groupBy("tree_id").agg(F.count("*").alias("n_nodes"))


def _sequence(spark, sf_dir, limit: float = LIMIT) -> DataFrame:
    return pipeline.TreeDataset(view(spark, sf_dir)).sequence(limit=limit)


#: sq: the sequences of the cleaned trees.
_SEQUENCES = (
    f"{_cleaned(NODES, 't')}, {_traversal('pre', True)}, {_KIDS}, {_TOPOLOGY},"
    " sq as materialized (select tr.tree_id, tr.pos, tr.n, l.x, l.y, l.z, l.type, l.node_type from tr join l on l.tree_id = tr.tree_id and l.n = tr.n)"
)


@query(f"with recursive {_SEQUENCES} select * from sq")
def sequence_table(spark, sf_dir):
    return _sequence(spark, sf_dir)


def _inputs(spark, sf_dir) -> DataFrame:
    rows = _sequence(spark, sf_dir).withColumn("region", F.concat(F.lit("r"), (F.col("n") % 5).cast("string")))
    vectors = spark.createDataFrame([(f"r{k}", [float(k), float(k * k)]) for k in range(4)] + [("unknown", [-1.0, -1.0])], "token string, vec array<double>")
    return tensors.preprocess(rows, vectors)


def _step_columns(values: str, width: int) -> list:
    return [(F.round(F.get(values, k).cast("double"), 3) + 0.0).alias(f"v{k}") for k in range(width)]


def _features(*columns: str) -> str:
    return ", ".join(f"round(cast(cast({c} as float) as double), 3) + 0.0 as v{k}" for k, c in enumerate(columns))


def _kept(values, some) -> object:
    """A row (at, v) for each element that isn't padding: they are picked in the array, so that padding makes no rows."""
    return F.explode(F.filter(F.transform(values, lambda v, i: F.struct(i.cast("bigint").alias("at"), v.alias("v"))), lambda x: some(x["v"])))


def _real(step) -> object:
    return F.exists(step, lambda x: x != 0)


_REGION = [f"case when n % 5 = 4 then -1 else {value} end" for value in ("n % 5", "(n % 5) * (n % 5)")]
_COORD = [f"({c} - avg({c}) over w) / case when stddev_pop({c}) over w = 0 then 1 else stddev_pop({c}) over w end" for c in "xyz"]
_ONE_HOT = [f"case when node_type = '{t}' then 1 else 0 end" for t in tensors.NODE_TYPES]


def _flat(spark, sf_dir) -> DataFrame:
    return tensors.flat_tensor(_inputs(spark, sf_dir), features=("region", "coord", "topology"))


@query(f"with recursive {_SEQUENCES} select tree_id, 2000 as steps, 2000 - m + pos - 1 as at, {', '.join(f'v{k}' for k in range(8))} from"
       f" (select tree_id, pos, count(*) over w as m, {_features(*_REGION, *_COORD, *_ONE_HOT)} from sq window w as (partition by tree_id)) where pos > m - 2000")
def flat_tensor(spark, sf_dir):
    """The steps of the tensors that aren't padding; at counts from the front."""
    steps = _flat(spark, sf_dir).select("tree_id", F.size("values").cast("bigint").alias("steps"), _kept("values", _real).alias("s"))
    return steps.select("tree_id", "steps", "s.at", *_step_columns("s.v", 8))


@query(f"with recursive {_SEQUENCES}, wa as (select *, 1 + coalesce(sum(case when node_type = 'T' then 1 else 0 end) over (partition by tree_id order by pos rows between unbounded preceding and 1 preceding), 0) as word, sum(case when node_type = 'T' then 1 else 0 end) over (partition by tree_id) as words from sq),"
       " wb as (select * from wa where word <= words union all select * replace (word + 1 as word) from wa where node_type = 'T' and word < words),"
       " wc as (select *, row_number() over (partition by tree_id, word order by pos) as nth, count(*) over (partition by tree_id, word) as m from wb)"
       f" select tree_id, cast(300 - words + word - 1 as bigint) as word_at, cast(20 - m + nth - 1 as bigint) as step_at, {_features(*_REGION, *_ONE_HOT)} from wc where word > words - 300 and nth > m - 20")
def nested_tensor(spark, sf_dir):
    """The steps of the tensors that aren't padding; word_at and step_at count from the front."""
    made = tensors.nested_tensor(_inputs(spark, sf_dir), features=("region", "topology"))
    words = made.select("tree_id", _kept("values", lambda w: F.exists(w, _real)).alias("w"))
    steps = words.select("tree_id", F.col("w.at").alias("word_at"), _kept("w.v", _real).alias("s"))
    return steps.select("tree_id", "word_at", F.col("s.at").alias("step_at"), *_step_columns("s.v", 5))


@query()
def recurrent_encoding(spark, sf_dir):
    """Latent vectors of the flat tensors under fixed random weights: the forward pass, not a trained model."""
    from treeloom.functions import models

    weights = models.random_gru(8, 16, "enc1", 1) | models.random_gru(16, 8, "enc2", 2) | models.random_gru(8, 4, "enc3", 3)
    return models.predict_latent(_flat(spark, sf_dir), weights)


def _texts(spark, sf_dir) -> DataFrame:
    """Texts of tree files: blanks or commas, comments, CRLF; one file in 11 has a bad cell, one in 13 no rows."""
    nodes = view(spark, sf_dir)
    cells = [F.when((F.col("tree_id") % 11 == 3) & (F.col("n") == 2), F.lit("bad")).otherwise(F.col("x").cast("string")) if c == "x" else F.col(c).cast("string") for c in ("n", "type", "x", "y", "z", "r", "parent")]
    line = F.when(F.col("tree_id") % 3 == 1, F.concat_ws(",", *cells)).otherwise(F.concat_ws(" ", *cells))
    lines = nodes.withColumn("line", line).groupBy("tree_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    lines = lines.withColumn("lines", F.when(F.col("tree_id") % 13 == 4, F.array().cast("array<string>")).otherwise(F.col("lines")))
    end = F.when(F.col("tree_id") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    return lines.select("tree_id", F.concat(F.lit("# made of events"), end, F.array_join(F.transform("lines", lambda x: F.concat(F.lit(" "), x, end)), ""), F.lit("# end")).alias("value"))


@query(f"with {NODES} select tree_id, n - 1 as row_ord, n, type, x, y, z, r, parent from t where tree_id % 11 != 3 and tree_id % 13 != 4")
def tree_texts(spark, sf_dir):
    from treeloom.sources import node_files

    return node_files.parse_node_texts(_texts(spark, sf_dir))[0]


@query(f"with {NODES} select distinct tree_id, case when tree_id % 13 = 4 then 'empty' else 'parse_error' end as reason from t where tree_id % 11 = 3 or tree_id % 13 = 4")
def tree_text_rejects(spark, sf_dir):
    from treeloom.sources import node_files

    return node_files.parse_node_texts(_texts(spark, sf_dir))[1]
