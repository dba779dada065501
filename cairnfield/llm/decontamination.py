"""Benchmark decontamination, in DataFrame functions only.

A window of as many words as a benchmark item is compared with the items of that
length. Both get a 64-bit SimHash over their five-word shingles, a shingle as
often as it occurs, and where shingles repeat a second one, over distinct shingles: a
few that repeat often would outvote all others of a long window. A fingerprint is cut into BLOCKS blocks; of two fingerprints within
the radius, one block differs in radius / BLOCKS bits at most. An item is entered under every
key near its own blocks, a window is looked up under its own, so an equi-join on
(length, block, bits) finds all pairs within the radius. Candidates are verified by the
weighted Jaccard similarity of their shingles; a document's best window for an item is reported.
A document that is shorter than the item is one window as a whole.

A window that shares no shingle with any item has similarity zero, so windows are
fingerprinted only around shingles that some item has. These are found in a bitmap of
``bitmap_bits`` bits, a literal in the plan: a fixed size, whatever the benchmark's;
its false alarms cost time only, as the places are then looked up exactly. Places go by text, so copies count
once: their rows are merged before the shuffle, and one copy of each text that has places is compared.

Vote counts are packed: sixteen 64-bit numbers hold four sums of 16 bits each, so that
a window's 64 votes are sixteen sums of numbers. Windows of over PACKED shingles are
counted bit by bit instead.

Edge cases: null texts, texts shorter than every item and items of fewer than five
words (their one shingle is the whole item, compared with windows of that many words) are
handled alike; items and texts may be of any length; an item without words matches nothing; repeated rows give one result
for each doc_id; a null doc_id is reported as null; other columns aren't read, whatever their names; empty
tables give an empty result. Texts are known by 64 bits of hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise

WIDTH = 5
#: Shingles of a window whose votes fit the packed sums.
PACKED = 8000
BLOCKS = 8
_LANES = 0x0001000100010001


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII white space."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[ \\t-\\r]+"), lambda w: w != "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once, though then uses it within lambda functions."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of width words, from the words' hashes; none where there are fewer."""

    def runs(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, each).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def spread(nibble: Column) -> Column:
    """The four bits of a number below 16 in four lanes of 16 bits."""
    return (nibble * F.lit(0x0000200040008001)).bitwiseAND(F.lit(_LANES))


def packed_votes(hashes: Column, size: Column) -> Column:
    """SimHash of an array of PACKED hashes at most: bit 4 j + k of the hashes is bit 16 k + j."""
    out = F.lit(0).cast("long")
    for j in range(16):

        def vote(acc: Column, h: Column) -> Column:
            return acc + spread(F.shiftrightunsigned(h, 4 * j).bitwiseAND(F.lit(15)))  # noqa: B023  called at once

        votes = F.aggregate(hashes, F.lit(0).cast("long"), vote)
        # A lane above half its window reaches bit 14.
        bias = (F.lit(0x4000) - (F.floor(size / 2) + 1)).cast("long") * F.lit(_LANES)
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(votes + bias, 14).bitwiseAND(F.lit(_LANES)), j))
    return out


def plain_votes(hashes: Column, size: Column) -> Column:
    """The same fingerprint of any number of hashes, counted bit by bit."""
    zero = F.lit(0).cast("long")

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, zero, lambda acc, h: acc + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(1)))
        place = 16 * (b % 4) + F.floor(b / 4).cast("int")
        return F.when(votes * 2 > size, F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(zero)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), zero, lambda acc, x: acc.bitwiseOR(x))


def fingerprint(hashes: Column, size: Column) -> Column:
    return F.when(size <= PACKED, packed_votes(hashes, size)).otherwise(plain_votes(hashes, size))


def prints(hashes: Column) -> Column:
    """The fingerprints of a window or an item: by all its shingles, and by distinct ones if some repeat."""
    once = F.array_distinct(hashes)
    each = F.array(fingerprint(hashes, F.size(hashes)))
    return F.when(F.size(once) == F.size(hashes), each).otherwise(F.concat(each, let(once, lambda h: F.array(fingerprint(h, F.size(h))))))


def block_bits(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * 64 // BLOCKS).bitwiseAND(F.lit((1 << 64 // BLOCKS) - 1))


def own_blocks(fp: Column) -> Column:
    """(block, its bits) of a window's fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), block_bits(fp, i).alias("bits")) for i in range(BLOCKS)])


def near_blocks(fp: Column, radius: int) -> Column:
    """(block, bits) within radius / BLOCKS flips of each block of an item's fingerprint."""
    width = 64 // BLOCKS
    flips = [sum(1 << b for b in chosen) for n in range(min(radius // BLOCKS, width) + 1) for chosen in itertools.combinations(range(width), n)]
    masks = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")

    def keys(i: int) -> Column:
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("block"), block_bits(fp, i).bitwiseXOR(m).alias("bits")))

    return F.concat(*map(keys, range(BLOCKS)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of the same hashes' multisets: sum of minima over sum of maxima."""

    def times(x: Column, h: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == h))

    def plain(x: Column) -> Column:
        return F.size(F.array_distinct(x)) == F.size(x)

    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, h: acc + F.least(times(a, h), times(b, h)))
    common = F.when(plain(a) & plain(b), F.size(F.array_intersect(a, b))).otherwise(counted)
    return common / (F.size(a) + F.size(b) - common)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, length, width (of a shingle), hashes, size."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("w")).withColumn("length", F.size("w")).where(F.col("length") > 0)
    rows = rows.select("item_id", "length", F.least("length", F.lit(WIDTH)).alias("width"), "w")
    hashes = F.coalesce(*[F.when(F.col("width") == k, shingles(F.col("w"), k)) for k in range(WIDTH, 0, -1)])
    return rows.select("item_id", "length", "width", hashes.alias("hashes")).withColumn("size", F.size("hashes"))


def slots(h: Column, bits: int) -> list[Column]:
    """Two places of a hash in a bitmap of bits (a power of two), from different parts of it."""
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(bits - 1)) for by in (0, 32)]


def bitmap(items: DataFrame, bits: int) -> Column:
    """The set bits of all item shingles' hashes as an array<bigint> literal of bits / 64 numbers."""
    slot = F.explode(F.array(*slots(F.col("h"), bits))).alias("s")
    rows = items.select(F.explode("hashes").alias("h")).select(slot).groupBy(F.shiftrightunsigned("s", 6).alias("i"))
    found = {r["i"]: r["b"] for r in rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).collect()}
    return F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, start (word), similarity: the best window of each document for each item it holds."""
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("tid"), "text")
    found = contaminated_texts(texts.select("tid", "text"), benchmark, **options)
    rows = texts.select("doc_id", "tid").join(found, "tid")
    return _best(rows, "doc_id")


def _best(rows: DataFrame, key: str) -> DataFrame:
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("s"))).alias("m")
    return rows.groupBy(key, "item_id").agg(best).select(key, "item_id", (-F.col("m.s")).alias("start"), F.col("m.similarity").alias("similarity"))


def contaminated_texts(texts: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 23, bitmap_bits: int = 1 << 20, max_broadcast: int = 2_000_000) -> DataFrame:
    """tid, item_id, start, similarity, of texts (tid, text); written to the shared folder.

    Tables are broadcast up to max_broadcast rows; larger ones are joined by shuffles.
    """
    items = items_of(benchmark.select("item_id", "text"))
    found = None
    for width in [r["width"] for r in items.select("width").distinct().orderBy("width").collect()] or [WIDTH]:
        own = items.where(F.col("width") == width)
        windows = _windows(texts, own, width, least, bitmap_bits, max_broadcast)
        part = _verified(_candidates(windows, own, radius, max_broadcast), least)
        found = part if found is None else found.union(part)
    return broadcast_if_small(materialise(_best(found, "tid"), "contaminated"), max_broadcast)


def _hits(texts: DataFrame, items: DataFrame, width: int, bits: int, max_broadcast: int) -> DataFrame:
    """tid, length, size (of the items that have it), at, n (the text's shingles): places (from 0) of items' shingles."""
    marks = bitmap(items, bits)
    hashes = texts.select("tid", shingles(words_of(F.col("text")), width).alias("h"))

    def marked(h: Column) -> Column:
        one, two = (F.bit_get(F.get(marks, F.shiftrightunsigned(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1 for s in slots(h, bits))
        return one & two

    spots = F.filter(F.transform(F.col("h"), lambda h, i: F.when(marked(h), F.struct(h.alias("hit"), i.alias("at")))), lambda x: x.isNotNull())
    some = hashes.select("tid", F.size("h").alias("n"), spots.alias("spots"))
    # explode() would have the optimizer test for empty arrays first, evaluating all of this twice.
    rows = some.select("tid", "n", F.explode_outer("spots").alias("x")).where(F.col("x").isNotNull()).select("tid", "n", "x.hit", "x.at")
    real = items.select(F.explode("hashes").alias("hit"), "length", "size").distinct()
    return rows.join(broadcast_if_small(real, max_broadcast), "hit").select("tid", "length", "size", "at", "n")


def _windows(texts: DataFrame, items: DataFrame, width: int, least: float, bits: int, max_broadcast: int) -> DataFrame:
    """tid, length, start, hashes: windows of an item's length over the shingles that such items have.

    A text too short for the similarity has none; one shorter than the item is its own window.
    """
    hits = _hits(texts, items, width, bits, max_broadcast).where(F.col("n") / F.col("size") >= least)
    spots = hits.groupBy("tid", "length", "size", "n").agg(F.array_sort(F.collect_set("at")).alias("spots"))

    # A window belongs to the first place in it, so each is made once.
    def starts(at: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get("spots", i - 1)).otherwise(F.lit(-1))
        return F.struct(F.greatest(at - F.col("size") + 1, before + 1, F.lit(0)).alias("lo"), F.least(at, F.greatest(F.col("n") - F.col("size"), F.lit(0))).alias("hi"))

    ranges = F.filter(F.transform("spots", starts), lambda r: r["lo"] <= r["hi"])
    of_text = spots.groupBy("tid").agg(F.collect_list(F.struct("length", "size", ranges.alias("ranges"))).alias("lengths"))
    of_text = materialise(of_text, "places")
    once = texts.join(broadcast_if_small(of_text.select("tid"), max_broadcast), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    # As many tasks as a shuffle has: the rows are few bytes and long work.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = once.join(of_text, "tid").repartition(tasks, "tid")
    rows = rows.select("tid", shingles(words_of(F.col("text")), width).alias("h"), "lengths")
    rows = rows.select("tid", "h", F.explode_outer("lengths").alias("l")).select("tid", "h", "l.length", "l.size", F.explode_outer("l.ranges").alias("r"))
    rows = rows.where(F.col("r").isNotNull()).select("tid", "h", "length", "size", F.explode(F.sequence("r.lo", "r.hi")).alias("start"))
    return rows.select("tid", "length", "start", F.slice("h", F.col("start") + 1, F.col("size")).alias("hashes"))


def _candidates(windows: DataFrame, items: DataFrame, radius: int, max_broadcast: int) -> DataFrame:
    """tid, item_id, start, hashes, item_hashes: windows and items of one length with fingerprints within the radius."""
    keys = windows.select("*", F.explode_outer(prints(F.col("hashes"))).alias("fp"))
    keys = keys.select("*", F.explode(own_blocks(F.col("fp"))).alias("k")).select("*", "k.block", "k.bits")
    # Shingles stay out of the table of keys, which has many rows for each item.
    items = items.select("item_id", "length", F.col("hashes").alias("item_hashes"), F.xxhash64("hashes").alias("item"))
    table = items.select("item_id", "item", "length", F.explode_outer(prints(F.col("item_hashes"))).alias("item_fp"))
    table = table.select("*", F.explode(near_blocks(F.col("item_fp"), radius)).alias("k")).select("item_id", "item", "length", "item_fp", "k.block", "k.bits")
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # Of several blocks that are near, the first one makes the candidate.
    first = F.coalesce(*[F.when(F.bit_count(block_bits(apart, i)) <= radius // BLOCKS, F.lit(i)) for i in range(BLOCKS)])
    near = keys.join(broadcast_if_small(table, max_broadcast), ["length", "block", "bits"]).where((F.bit_count(apart) <= radius) & (first == F.col("block")))
    return near.join(broadcast_if_small(items.select("item", "item_hashes").dropDuplicates(["item"]), max_broadcast), "item")


def _verified(near: DataFrame, least: float) -> DataFrame:
    return near.select("tid", "item_id", "start", similarity(F.col("hashes"), F.col("item_hashes")).alias("similarity")).where(F.col("similarity") >= least)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item; its columns stay as they are.

    Documents are matched by a hash of their text, so null and repeated ids do no harm.
    """
    key = F.xxhash64("text")
    texts = docs.where(F.col("text").isNotNull()).select(key.alias("tid"), "text")
    found = contaminated_texts(texts, benchmark, **options).select(F.col("tid").alias("__found_tid")).distinct()
    return docs.join(found, docs["text"].isNotNull() & (key == F.col("__found_tid")), "left_anti")
