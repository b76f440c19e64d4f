"""Documents that hold a passage of a benchmark, by SimHash of item-sized windows. Native expressions only.

Texts and items are words in lower case, and a window or item is the multiset of its SHINGLE-word shingles.

1. Windows: a window of an item's length can only reach the similarity asked for if it shares a shingle with an item. So
   every shingle of every document is looked up among the items' shingles, and the alignments that the hits give, moved
   by as many words as that similarity admits, give the windows. None that could match is left out; which item it is that
   a window resembles is not known yet.
2. SimHash: windows and items get 64-bit fingerprints, cut into BLOCKS (bits, reach). Fingerprints that differ by RADIUS
   bits or fewer differ by at most a block's reach in one block at least, for RADIUS + 1 is the sum of all reaches plus one
   for each block. So the items' index holds, for each of their blocks, every value within its reach, and a window's own
   block values find all items of its length within RADIUS: no window meets the others. A pair that several blocks find is
   taken from the first one. At a similarity of 0.8 fingerprints differ in 9.7 bits on average, with deviation 2.9.
3. Candidates are verified by exact weighted (multiset) Jaccard similarity of their shingles.

Defined cases: null, empty and blank texts and items match nothing; items shorter than a shingle are one shingle; a
document shorter than an item is compared whole; rows that share a doc_id, or have none, count as one document in the
result, and each row's text is searched by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import SPACE, let, running, stored, window_hashes
from treeloom.llm.quality_mcd import WHITE

SHINGLE = 5
BLOCKS = ((13, 2), (13, 2), (13, 2), (13, 2), (12, 2))
RADIUS = sum(reach + 1 for _, reach in BLOCKS) - 1
#: Rows of lookups (shingles, index entries, window starts; some 160 bytes each in memory) up to which they are broadcast.
BROADCAST_ROWS = 300_000
#: SimHash counts in lanes of 16 bits: hashes that they can hold.
LANE = 65_535


def _split(text: Column) -> Column:
    bare = F.btrim(F.lower(text), F.lit(WHITE))
    return F.when(bare != "", F.split(bare, SPACE + "+"))


def shingles(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of all shingles of an array of words; one for an array shorter than a shingle."""
    return F.when(F.size(words) < width, F.array(F.xxhash64(words))).otherwise(window_hashes(words, width))


def as_multiset(hashes: Column) -> Column:
    """Distinct marks of a multiset: each hash with the number of its equals in front of it."""

    def marked(s: Column) -> Column:
        opens = F.transform(s, lambda h, i: F.when(h == F.get(s, i - 1), F.lit(0)).otherwise(i))
        return let(running(opens, F.greatest), lambda first: F.transform(s, lambda h, i: F.xxhash64(h, i - F.get(first, i))))

    single = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(single, F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))).otherwise(let(F.array_sort(hashes), marked))


def simhash(hashes: Column) -> Column:
    """64 majority bits over the hashes of a multiset."""
    shifted = lambda x, by: F.shiftrightunsigned(x, by)
    zero, ones = F.lit(0).cast("bigint"), F.lit(0x0001000100010001)
    n = F.size(hashes)

    def in_lanes() -> Column:
        lane = lambda j: F.aggregate(hashes, zero, lambda acc, h: acc + shifted(h, j).bitwiseAND(ones))
        lanes = F.array(*[lane(j) for j in range(16)])
        bits = lambda s: [F.when(2 * shifted(F.get(s, F.lit(k % 16)), k - k % 16).bitwiseAND(F.lit(0xFFFF)) > n, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(zero) for k in range(64)]
        return let(lanes, lambda s: sum(bits(s)[1:], bits(s)[0]))

    def one_by_one() -> Column:
        count = lambda j: F.aggregate(hashes, zero, lambda acc, h: acc + F.call_function("getbit", h, j).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda acc, j: acc.bitwiseOR(F.when(2 * count(j) > n, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(zero)))

    return F.when(n <= LANE, in_lanes()).otherwise(one_by_one())


def _block(fingerprint: Column, no: int) -> Column:
    before = sum(bits for bits, _ in BLOCKS[:no])
    return F.shiftrightunsigned(fingerprint, before).bitwiseAND(F.lit((1 << BLOCKS[no][0]) - 1).cast("bigint"))


def block_values(fingerprint: Column) -> Column:
    """(no, value) of every block of a fingerprint."""
    return F.array(*[F.struct(F.lit(no).alias("no"), _block(fingerprint, no).alias("value")) for no in range(len(BLOCKS))])


def index_values(fingerprint: Column) -> Column:
    """(no, value) of all values within reach of a fingerprint's blocks."""

    def within(no: int, bits: int, reach: int) -> Column:
        masks = [sum(1 << b for b in at) for k in range(reach + 1) for at in combinations(range(bits), k)]
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.lit(no).alias("no"), _block(fingerprint, no).bitwiseXOR(m).alias("value")))

    return F.concat(*[within(no, *block) for no, block in enumerate(BLOCKS)])


def found_first(a: Column, b: Column, no: Column) -> Column:
    """Whether fingerprints lie within RADIUS and no block before this one finds them."""
    apart = lambda k: F.bit_count(_block(a, k).bitwiseXOR(_block(b, k)))
    earlier = F.lit(False)
    for k in range(len(BLOCKS) - 1):
        earlier = earlier | ((no > k) & (apart(k) <= BLOCKS[k][1]))
    return (F.bit_count(a.bitwiseXOR(b)) <= RADIUS) & ~earlier


def prepared(items: DataFrame) -> DataFrame:
    """item_id, words, length, hashes, marks, fingerprint of the items that have words."""
    items = items.select("item_id", _split(F.col("text")).alias("words")).where("words is not null").select("item_id", "words", F.size("words").alias("length"), shingles(F.col("words")).alias("hashes"))
    return stored(items.withColumn("fingerprint", simhash(F.col("hashes"))).withColumn("marks", as_multiset(F.col("hashes"))), "items", "small")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """doc_id, length, start, hashes, print of all windows that share a shingle with an item at an admitted place."""
    short = [r[0] for r in items.where(F.col("length") < SHINGLE).select("length").distinct().collect()]  # four at most
    docs = docs.select("doc_id", F.xxhash64("text").alias("own"), "text")
    hits = None
    for width in [*short, SHINGLE]:
        of_width = items.where((F.col("length") == width) if width < SHINGLE else (F.col("length") >= SHINGLE))
        seeds = of_width.select("length", F.posexplode(shingles(F.col("words"), width)).alias("item_at", "seed")).distinct()
        at = docs.select("doc_id", "own", F.posexplode(let(_split(F.col("text")), lambda w: F.when(F.size(w) >= width, shingles(w, width)))).alias("at", "seed"))
        found = at.join(_bounded(seeds, seeds.count()), "seed")
        # a window that shares 8/9 of an item's shingles shares one that is at most this many words out of line
        slack = F.floor((F.col("length") - (width - 1)) * (1 - least) / (1 + least) + 1e-9).cast("int")
        found = found.select("doc_id", "own", "length", (F.col("at") - F.col("item_at")).alias("line"), slack.alias("slack")).distinct()
        hits = found if hits is None else hits.union(found)
    starts = hits.select("doc_id", "own", "length", F.explode(F.sequence(F.col("line") - F.col("slack"), F.col("line") + F.col("slack"))).alias("start")).distinct()
    starts = stored(starts.groupBy("doc_id", "own").agg(F.collect_list(F.struct("length", "start")).alias("starts"), F.count("*").alias("n")), "starts", "small")
    starts = _bounded(starts, starts.agg(F.sum("n")).first()[0] or 0).withColumnRenamed("doc_id", "of")
    texts = docs.join(starts, docs["doc_id"].eqNullSafe(starts["of"]) & (docs["own"] == starts["own"])).select("doc_id", "text", "starts")

    def cut(words: Column, hashes: Column) -> Column:
        inside = lambda s: F.greatest(F.lit(0), F.least(s["start"], F.size(words) - s["length"]))
        own = lambda s: F.when(s["length"] < SHINGLE, F.array(F.xxhash64(F.slice(words, inside(s) + 1, s["length"])))).otherwise(F.slice(hashes, inside(s) + 1, F.greatest(s["length"] - (SHINGLE - 1), F.lit(1))))
        return F.transform(F.array_distinct(F.transform("starts", lambda s: F.struct(s["length"].alias("length"), inside(s).alias("start")))), lambda s: F.struct(s["length"].alias("length"), s["start"].alias("start"), own(s).alias("hashes")))

    made = texts.select("doc_id", F.explode(let(_split(F.col("text")), lambda w: let(shingles(w), lambda h: cut(w, h)))).alias("w"))
    return made.select("doc_id", "w.*").withColumn("print", simhash(F.col("hashes")))


def candidates(cut: DataFrame, items: DataFrame) -> DataFrame:
    """Windows with the items (item_id, marks) of their length whose fingerprints lie within RADIUS."""
    keyed = lambda df, values: df.withColumn("block", F.explode(values)).select("*", "block.no", "block.value").drop("block")
    index = keyed(items.select("item_id", "length", "fingerprint"), index_values(F.col("fingerprint")))
    n = items.count()
    entries = n * sum(len(list(combinations(range(bits), k))) for bits, reach in BLOCKS for k in range(reach + 1))
    near = keyed(cut, block_values(F.col("print"))).join(_bounded(index, entries), ["length", "no", "value"]).where(found_first(F.col("print"), F.col("fingerprint"), F.col("no")))
    return near.select("doc_id", "start", "length", "hashes", "item_id").join(_bounded(items.select("item_id", "marks"), n), "item_id")


def matches(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each document for each item it holds."""
    items = prepared(items)
    both = candidates(windows(docs, items, least), items)
    common = F.size(F.array_intersect("x", "marks"))
    both = both.withColumn("x", as_multiset(F.col("hashes"))).withColumn("similarity", common / (F.size("x") + F.size("marks") - common)).where(F.col("similarity") >= least)
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"), F.col("best.length").alias("n_words"))
