"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. Every document becomes its set of distinct word shingles (64-bit hashes) and a MinHash signature. Documents with equal
   sets form a class; only its smallest id goes on, so copies never meet pair by pair.
2. The signature is read in several rotated orders ("trees"). In each tree the classes are range-sorted by that order: a
   region is a run with the same first DEPTH values, and inside it the next TAIL values decide. The rows next to each
   other (NEAR on either side) share the longest prefixes and are candidates; where a region is dense, its order is decided
   that much deeper, so the depth follows the density. Range partitions cut a hot region wherever needed, so none lands in
   one task; the rows at a cut are paired afterwards. The first EARLY trees go first: what their screened candidates have
   joined is one part, and the other trees give no candidates inside a part, where they would join nothing more. So a
   class in a large group of near copies takes part in few candidates more than those of EARLY trees.
3. Candidates are screened by their signatures. Inside the clusters that they span, exact Jaccard similarity on full sets
   decides, for all pairs across groups and not only for the candidates. In blocks of BLOCK classes all pairs are tried.
   Groups of a larger cluster are then joined by confirming, round by round, the likeliest candidate of each two groups.
   What is still apart goes through an exact prefix filter: two sets at the similarity asked for share one of the hashes
   that are rarest in the cluster, at a place near the front of either set, so only sets that do are compared, and never
   two of the cluster's largest group. Work therefore follows the number of true links, not the square of a cluster.

A pair at similarity s shares no region with probability (1 - s**DEPTH)**TREES: 3.2e-6 at 0.8, and far less above it.
The screen at 0.55 lies six standard deviations under 0.8. Sharing a region is not yet being neighbours: where NEAR rows
unlike both sort between the two, on each side and in every region they share, and nothing else joins their clusters, a
link is lost. That takes texts that agree with them on more of the TAIL values than they do with each other.

Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text shorter than a shingle is
one shingle; rows that share a doc_id are one node: what is linked with one of them is linked with all; a null doc_id
stands alone (component null, kept); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import compact, short_batches, stored

DEPTH, TREES, TAIL, NEAR = 4, 24, 16, 3
#: Trees whose candidates are screened and joined before the others give theirs.
EARLY = 3
PERMUTATIONS = DEPTH * TREES
SCREEN = 0.55
#: Classes in a block, and hashes, at which a cluster is cut into more blocks.
BLOCK, BLOCK_HASHES = 500, 400_000
#: Ids of classes with candidates are broadcast up to this number (100 bytes each in memory or less); beyond it the texts are shuffled.
BROADCAST_IDS = 400_000
SALTS = 16
#: Rounds in which the likeliest candidates between groups of a cluster are confirmed.
ROUNDS = 8
#: A hash that more than one in COMMON of a cluster's classes hold is common: such hashes go to the classes as one array.
COMMON = 8
#: Edges that a task of components() contracts at once.
CONTRACTED = 200_000

_rng = np.random.default_rng(20240607)
_MULTIPLY = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


class _Words(dict):
    """Hashes of words, remembered by the worker; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z count as a-z."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    used = min(width, len(words))
    out = np.full(len(words) - used + 1, used, np.uint64)
    for j in range(used):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return np.unique(_mix(out))


def signature(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each of the least values of random linear maps."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(20)).astype(">u2")


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, keys, signs = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, width)
                    sizes.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    signs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sign"])

    return short_batches(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, sign binary")


def _tree_rows(signs: DataFrame, trees: range) -> DataFrame:
    """A row per class and tree: region (its first DEPTH values), a byte of each of the next TAIL values, node, its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                if not batch.num_rows:
                    continue
                sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, PERMUTATIONS)
                turned = np.concatenate([sign, sign], axis=1)
                for t in trees:
                    first = turned[:, t * DEPTH : (t + 1) * DEPTH].astype(np.uint64)
                    # the tree's number goes into the region, so that trees don't mix
                    region = _mix((first[:, 0] << np.uint64(48) | first[:, 1] << np.uint64(32) | first[:, 2] << np.uint64(16) | first[:, 3]) + np.uint64(t)).view(np.int64)
                    tail = np.ascontiguousarray(turned[:, (t + 1) * DEPTH : (t + 1) * DEPTH + TAIL].astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array(region), pa.array([x.tobytes() for x in tail], pa.binary()), batch.column(0), batch.column(2)], names=["region", "tail", "node", "part"])

    return signs.select("node", "sign", "part").mapInArrow(run, "region bigint, tail binary, node bigint, part bigint")


def _neighbours(rows: DataFrame) -> DataFrame:
    """a, b: rows of a region with at most NEAR - 1 others between them in its order; none of the same part, where rows have parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, region, node, own, seen = 0, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0

        def rows_of(a: np.ndarray, b: np.ndarray, place: np.ndarray | None = None) -> pa.RecordBatch:
            where = pa.nulls(len(a), pa.int32()) if place is None else pa.array(np.full(len(a), part, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), where, pa.nulls(len(a), pa.int32()) if place is None else pa.array(place.astype(np.int32))], names=["a", "b", "part", "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held, part = len(region), batch.column(3)[0].as_py()
            region = np.concatenate([region, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            own = np.concatenate([own, batch.column(2).to_numpy()])
            if seen < NEAR:  # the partition's first rows: their region may have begun in the one before
                some = min(NEAR - seen, batch.num_rows)
                yield rows_of(region[held : held + some], node[held : held + some], np.arange(seen + 1, seen + some + 1))
            seen += batch.num_rows
            for lag in range(1, min(NEAR, len(region) - 1) + 1):
                at = np.flatnonzero((region[lag:] == region[:-lag]) & (own[lag:] != own[:-lag]) & (np.arange(lag, len(region)) >= held)) + lag
                if len(at):
                    yield rows_of(np.minimum(node[at], node[at - lag]), np.maximum(node[at], node[at - lag]))
            region, node, own = region[-NEAR:], node[-NEAR:], own[-NEAR:]
        yield rows_of(region, node, -np.arange(len(region), 0, -1))  # and the last ones, counted back from the end

    rows = rows if "part" in rows.columns else rows.withColumn("part", F.col("node"))
    spread = rows.repartitionByRange("region", "tail", "node").sortWithinPartitions("region", "tail", "node")
    found = stored(spread.select("region", "node", "part", F.spark_partition_id()).mapInArrow(run, "a bigint, b bigint, part int, place int"), "neighbours", "medium")
    near = found.where("part is null").select("a", "b")
    # a few rows for each partition
    ends = found.where("place < 0").select((F.col("part") + 1).alias("part"), F.col("a").alias("region"), F.col("b").alias("x"), F.col("place").alias("back"))
    starts = found.where("place > 0").select("part", F.col("a").alias("region"), F.col("b").alias("y"), "place")
    cut = ends.join(starts, ["part", "region"]).where(F.col("place") - F.col("back") <= NEAR + 1).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return near.union(cut).where("a != b").distinct()


def _screened(edges: DataFrame, signs: DataFrame) -> DataFrame:
    """a, b, likeness of the edges whose signatures agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), ">u2").reshape(-1, PERMUTATIONS) for i in (2, 3))
            like = (x == y).mean(axis=1)
            keep = pa.array(like >= SCREEN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["a", "b", "likeness"]).filter(keep)

    both = edges.join(signs.select(F.col("node").alias("a"), F.col("sign").alias("sign_a")), "a").join(signs.select(F.col("node").alias("b"), F.col("sign").alias("sign_b")), "b")
    return both.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a bigint, b bigint, likeness double")


def _contracted(edges: DataFrame) -> DataFrame:
    """v, u: edges with the same components as a, b, of every CONTRACTED edges only the stars around their smallest nodes."""

    def stars(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in pairs:
            low, high = sorted((top(a), top(b)))
            up[high] = low
        found = [(top(x), x) for x in up if up[x] != x]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["v", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        for batch in batches:
            pairs += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(pairs) >= CONTRACTED:
                yield stars(pairs)
                pairs = []
        yield stars(pairs)

    return edges.select("a", "b").where("a != b").mapInArrow(run, "v bigint, u bigint")


def _candidates(signs: DataFrame) -> DataFrame:
    """a, b, likeness of the candidates that pass the screen; those of the later trees only between what the early ones left apart."""
    alone = signs.withColumn("part", F.col("node"))
    early = stored(_screened(_neighbours(_tree_rows(alone, range(EARLY))), signs), "edges", "medium")
    parts = components(early).select("node", F.col("component").alias("part"))
    apart = signs.join(_bounded(parts), "node", "left").select("node", "sign", F.coalesce("part", "node").alias("part"))
    late = stored(_screened(_neighbours(_tree_rows(apart, range(EARLY, TREES))), signs), "edges", "medium")
    return early.union(late)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of a graph given as a, b: alternating large and small stars.

    Edges are contracted where they lie before the first round; if CONTRACTED or fewer are left, one task ends the work.
    Else rounds grow with the logarithm of the longest path; each aggregates by node before it joins, and the joins are
    salted by the other end, so a hub's edges don't meet in one task.
    """
    now = stored(_contracted(edges).distinct(), "stars", "small")
    n = now.count()
    if n <= CONTRACTED:
        done = _contracted(now.select(F.col("v").alias("a"), F.col("u").alias("b")).coalesce(1))
        return stored(done, "stars", "small").select(F.col("u").alias("node"), F.col("v").alias("component"))

    def with_least(rows: DataFrame, low: DataFrame) -> DataFrame:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["u", "salt"]).drop("salt")

    said = None
    while True:
        both = now.union(now.select(F.col("u"), F.col("v")).toDF("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v")  # repeated ones fall to the distinct below
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = small.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u != v").distinct()
        now = stored(small, "stars", "small")
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if told == said:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        said = told


def _linker(percent: int):
    """links(node, group, hashes): pairs of a block whose full sets are alike, as many as it takes to join their groups.

    One pass over the flat hashes of the block gives a node's intersections with all others. Only nodes outside the
    largest group need that pass, for any link across groups has such an end.
    """

    def links(node: np.ndarray, group: np.ndarray, hashes: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(x) for x in hashes], np.int64)
        values, code = np.unique(np.concatenate(hashes), return_inverse=True)
        code = code.astype(np.int32)
        start = np.r_[0, np.cumsum(size)]
        names, group = np.unique(group, return_inverse=True)
        members = {g: np.flatnonzero(group == g).tolist() for g in range(len(names))}
        marked, found, waiting = np.zeros(len(values), bool), [], list(range(len(node)))
        while waiting and len(members) > 1:
            largest = max(members, key=lambda g: len(members[g]))
            i = next((k for k in waiting if group[k] != largest), None) if len(found) else waiting[0]
            if i is None:
                break
            waiting.remove(i)
            own = code[start[i] : start[i + 1]]
            marked[own] = True
            common = np.add.reduceat(marked[code], start[:-1], dtype=np.int64)
            marked[own] = False
            for j in np.flatnonzero((common * 100 >= (size + size[i] - common) * percent) & (group != group[i])).tolist():
                if group[j] != group[i]:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    small, big = sorted((group[i], group[j]), key=lambda g: len(members[g]))
                    group[members[small]] = big
                    members[big] += members.pop(small)
        return found

    def run(key, rows):
        node, group = rows["node"].to_numpy(), rows["part"].to_numpy()
        hashes = [x.values.to_numpy() for x in rows["hashes"].combine_chunks()]
        found = links(node, group, hashes) if len(node) > 1 else []
        return pa.table({"a": pa.array([int(x[0]) for x in found], pa.int64()), "b": pa.array([int(x[1]) for x in found], pa.int64())})

    return run


def _bounded(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, nodes: DataFrame, width: int, repeated: bool) -> DataFrame:
    """node, hashes of the full sets of some classes: their texts are read again, so that no set is kept for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [shingle_set(x, width).view(np.int64) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(_bounded(nodes), "node", "left_semi")
    if repeated:
        rows = rows.groupBy("node", F.xxhash64("text"), F.octet_length("text")).agg(F.first("text").alias("text")).select("node", "text")
    return short_batches(rows).mapInArrow(run, "node bigint, hashes array<bigint>").where(F.size("hashes") > 0)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are alike."""
    common, x, y = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.where(common * 100 >= (x + y - common) * percent).select("a", "b").distinct()


def _joined_groups(seats: DataFrame, edges: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """seats (node, cluster, part) with parts joined by confirmed edges, the likeliest of each two parts first; those edges."""
    tested = links = None
    # what is still apart after the last round goes through the exact filter like everything else
    ends = edges.join(seats.select(F.col("node").alias("a")), "a", "left_semi")
    for _ in range(ROUNDS):
        side = lambda end: seats.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}"))  # noqa: E731, B023
        cross = ends.join(side("a"), "a").join(side("b"), "b").where("part_a != part_b")
        if tested is not None:
            cross = cross.join(tested, ["a", "b"], "left_anti")
        best = cross.groupBy(F.least("part_a", "part_b").alias("p"), F.greatest("part_a", "part_b").alias("q")).agg(F.max(F.struct("likeness", "a", "b")).alias("best"))
        best = stored(best.select("p", "q", "best.a", "best.b"), "best", "small")
        found = stored(_confirmed(best.select("a", "b"), sets, percent), "links")
        links = found if links is None else links.union(found)
        tested = best.select("a", "b") if tested is None else tested.union(best.select("a", "b"))
        if found.isEmpty():
            break
        merged = components(best.join(found, ["a", "b"]).select(F.col("p").alias("a"), F.col("q").alias("b"))).select(F.col("node").alias("part"), "component")
        seats = stored(seats.join(merged, "part", "left").select("node", "cluster", F.coalesce("component", "part").alias("part")), "seats", "small")
    return seats, links


def _across(seats: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """a, b: all links between parts of the same cluster, by an exact prefix filter; None if no cluster has two parts."""
    sizes = seats.groupBy("cluster", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.sum("n").alias("nodes"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    main = stored(main, "mains", "small")
    if main.isEmpty():
        return None
    rows = seats.join(main, "cluster").join(sets, "node").select("cluster", "nodes", "node", "part", (F.col("part") == F.col("main")).alias("of_main"), F.size("hashes").alias("size"), F.xxhash64("hashes").alias("own"), "hashes")
    counted = rows.select("cluster", "nodes", "part", F.explode("hashes").alias("hash")).groupBy("cluster", "hash")
    counted = counted.agg(F.count("*").alias("n"), (F.min("part") != F.max("part")).alias("mixed"), (F.count("*") * COMMON > F.max("nodes")).alias("often"))
    counted = stored(counted.where("mixed").drop("mixed"), "counted", "medium")
    in_order = lambda: F.sort_array(F.collect_list(F.struct("n", "hash")))["hash"]
    # one order for all sets of a cluster: hashes of one part alone, which can't be shared across parts, then the rarest first
    common = stored(counted.where("often").groupBy("cluster").agg(in_order().alias("common")), "common", "small")
    rows = rows.join(common, "cluster", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>"))).withColumn("last", F.array_intersect("common", "hashes"))
    known = ["cluster", "node", "part", "of_main", "size", F.size("last").alias("n_last")]
    each = rows.select(*known, "own", F.explode(F.array_except("hashes", "common")).alias("hash")).join(counted.where("not often"), ["cluster", "hash"])
    some = each.groupBy("cluster", "node", "part", "of_main", "size", "n_last", "own").agg(in_order().alias("some"))
    # a set of size s meets one at least as large with a hash at place p only if the rest can hold 2 * percent / (100 + percent)
    # of s, and one at most as large only if it can hold percent of s
    least = F.ceil(F.col("size") * percent / 100)

    def fronts(of: DataFrame, hashes: str, left) -> DataFrame:
        """The hashes of a node that have enough others after them; left is their number, with what follows these hashes."""
        first = F.slice(hashes, 1, F.greatest(left - least + 1, F.lit(0)).cast("int"))
        return of.select("cluster", "node", "part", "of_main", "size", left.alias("left"), F.posexplode(first).alias("place", "hash")).select("cluster", "hash", "node", "part", "of_main", "size", (F.col("left") - F.col("place")).alias("rest"))

    front = fronts(some, "some", F.col("n_last") + F.size("some")).union(fronts(rows.select(*known, "last"), "last", F.col("n_last")))
    front = stored(front, "fronts")
    small = front.where((100 + percent) * F.col("rest") >= 2 * percent * F.col("size"))
    named = lambda df, c: df.select("cluster", "hash", *[F.col(x).alias(f"{x}_{c}") for x in ("node", "part", "size", "rest", "of_main")])
    pairs = None
    for left, right in ((small.where("not of_main"), front), (small.where("of_main"), front.where("not of_main"))):
        both = named(left, "x").join(named(right, "y"), ["cluster", "hash"]).where("part_x != part_y and (size_x < size_y or size_x = size_y and (node_x < node_y or of_main_x != of_main_y))")
        both = both.where((100 + percent) * F.least("rest_x", "rest_y") >= percent * (F.col("size_x") + F.col("size_y"))).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
        pairs = both if pairs is None else pairs.union(both)
    return stored(_confirmed(pairs.distinct(), sets, percent), "links")


def _links(docs: DataFrame, edges: DataFrame, sizes: DataFrame, width: int, percent: int, repeated: bool) -> DataFrame:
    """a, b: confirmed links that join what belongs together, within the clusters that the candidate edges span."""
    clusters = components(edges)
    roots = clusters.select("component", F.col("component").alias("cluster")).distinct().toDF("node", "cluster")
    clusters = stored(roots.union(clusters.toDF("node", "cluster")), "clusters", "small")
    sized = clusters.join(sizes, "node")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_HASHES)).cast("int").alias("blocks"))
    blocks = stored(blocks.where("blocks > 1"), "blocks", "small")
    placed = clusters.join(_bounded(blocks), "cluster", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int"))
    inner = placed.join(_sets(docs, clusters.select("node"), width, repeated), "node").withColumn("part", F.col("node"))
    found = stored(inner.groupBy("cluster", "block").applyInArrow(_linker(percent), "a bigint, b bigint"), "links", "medium")
    if blocks.isEmpty():
        return found
    seats = placed.where("blocks is not null").join(components(found).select("node", F.col("component").alias("part")), "node", "left")
    seats = stored(seats.select("node", "cluster", F.coalesce("part", "node").alias("part")), "seats", "small")
    held = stored(_sets(docs, seats.select("node"), width, repeated), "sets")
    seats, more = _joined_groups(seats, edges, held, percent)
    last = _across(seats, held, percent)
    return found.union(more) if last is None else found.union(more).union(last)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document. 100 * intersection >= percent * union links two."""
    every = stored(_signatures(docs.select(F.col("doc_id").cast("bigint"), "text"), width), "signatures")
    able = every.where("set_key is not null and doc_id is not null")
    classes = stored(able.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("n_shingles").alias("size"), F.first("sign").alias("sign")), "classes", "medium")
    signs = classes.select("node", "sign")
    edges = _candidates(signs)
    repeated = not able.groupBy("doc_id").count().where("count > 1").isEmpty()
    links = None if edges.isEmpty() else _links(docs, edges, classes.select("node", "size"), width, percent, repeated)
    if repeated:  # an id joins the classes of all its rows
        own = able.select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
        tied = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a != z").drop("z"), "doc_id").select("a", F.col("node").alias("b"))
        links = tied if links is None else links.union(tied)

    parts = components(links) if links is not None else None

    out = every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    shared = classes.where("n > 1").select("set_key", F.col("node"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # merged: their files are small, but not what the salts make of them, so that no estimate may choose to broadcast
    out = out.join(shared.hint("merge"), ["set_key", "salt"], "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"))
    if parts is not None:
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        wide = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = out.withColumn("salt", spread).join(wide.hint("merge"), ["node", "salt"], "left")
        out = out.withColumn("component_id", F.coalesce("component", "node"))
    else:
        out = out.withColumn("component_id", F.col("node"))
    return compact(out, "medium").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
