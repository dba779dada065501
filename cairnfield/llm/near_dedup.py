"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit set where more than half of its word shingles'
XXH64 values have it set. Fingerprints link when ``radius`` bits differ at most;
a document's class is its component, named by the smallest doc_id.

Equal fingerprints are first made one. The distinct ones are dealt to shards by
``keep`` of ``blocks`` equal bit blocks: with blocks = radius + keep, two fingerprints
within the radius agree in at least keep whole blocks, so one shard holds both.
Each shard becomes a BK-tree: children are keyed by their Hamming distance to the
parent, and a search follows only edges within the radius of its own distance.
The trees stay on the executors, next to the fingerprints that search them: a tree of
all fingerprints has no size bound, so it can't be broadcast. A shard with over
``tree_rows`` rows is cut into parts of about that size, and every pair of parts
meets as a tree and its searchers, so that no task holds more than two parts.
A shard passes on a spanning forest of its links, not all pairs.

Edge cases: a text without words (null, empty, white space) has fingerprint zero,
linked like any other; fewer words than a shingle are one shingle; repeated rows and
copies share a fingerprint; a null doc_id is no name for a class, and a class of
such rows only has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialise, release
from .components import components
from .words import chunks, fresh, grown

BITS = 64


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of width words of the lower-cased text."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-width] + 1]).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The fingerprint as a signed 64-bit number."""
    if not len(h):
        return 0
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, width: int, name: str = "fp") -> DataFrame:
    """docs with one more column, the fingerprint of its column text."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            prints = pa.array([majority(shingle_hashes(t, width)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*columns, name])

    return docs.mapInArrow(run, grown(docs.schema, f"{name} long"))


def with_set(docs: DataFrame, width: int, names: list[str]) -> DataFrame:
    """docs with three more columns: a hash of the text's set of shingles, and that set's fingerprint in two numbers."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch, texts in chunks(batches, "text"):
            rows = []
            for t in texts:
                # Each shingle votes once, as the similarity to be caught is one of sets.
                h = np.unique(shingle_hashes(t, width))
                rows.append((xxhash.xxh3_64_intdigest(h.tobytes()), majority(h), majority(second(h))))
            cols = [pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*columns, *names])

    return docs.mapInArrow(run, grown(docs.schema, ", ".join(f"`{n}` long" for n in names)))


def distances(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y)


class BKTree:
    """Of distinct fingerprints (uint64). Node i's children sit in kids[i], by distance."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.kids: list[dict[int, int]] = [{} for _ in prints]
        todo = [np.arange(len(prints))] if len(prints) else []
        while todo:
            own = todo.pop()
            rest = own[1:]
            if not len(rest):
                continue
            d = distances(self.prints[rest], self.prints[own[0]])
            order = np.argsort(d, kind="stable")
            edges = np.flatnonzero(np.diff(d[order])) + 1
            for group in np.split(rest[order], edges):
                self.kids[own[0]][int(distances(self.prints[group[0]], self.prints[own[0]]))] = int(group[0])
                todo.append(group)

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions in asked within the radius of it); searchers walk down together."""
        todo = [(0, np.arange(len(asked)))] if len(self.prints) else []
        while todo:
            node, here = todo.pop()
            d = distances(asked[here], self.prints[node]).astype(np.int16)
            if len(near := here[d <= radius]):
                yield node, near
            for edge, kid in self.kids[node].items():
                if len(down := here[np.abs(d - edge) <= radius]):
                    todo.append((kid, down))


def forest(tree: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between distinct fingerprints that connect whatever tree and asked connect."""
    prints = np.unique(np.concatenate([tree, asked]))
    if len(prints) == 2:
        return (prints[:1], prints[1:]) if distances(prints[:1], prints[1]) <= radius else (prints[:0], prints[:0])
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    nodes, where = np.searchsorted(prints, tree), np.searchsorted(prints, asked)
    for node, near in BKTree(tree).within(asked, radius):
        top = root(nodes[node])
        for i in np.unique(parent[where[near]]):
            r = root(i)
            if r != top:
                parent[max(r, top)] = min(r, top)
                top = min(r, top)
    tops = np.array([root(i) for i in range(len(prints))])
    moved = np.flatnonzero(tops != np.arange(len(prints)))
    return prints[moved], prints[tops[moved]]


def shard_keys(fp: Column, radius: int, keep: int) -> Column:
    """One key for each choice of keep out of radius + keep blocks: (choice, the bits of its blocks)."""
    n = radius + keep
    edges = [round(i * BITS / n) for i in range(n + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for i, chosen in enumerate(itertools.combinations(masks, keep)):
        mask = sum(chosen)
        keys.append(F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask).cast("long")).alias("key")))
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 4, keep: int = 2, tree_rows: int = 1024) -> DataFrame:
    """(a, b) between distinct fingerprints (column fp), a spanning forest for each shard."""
    rows = prints.select("fp", F.explode(shard_keys(F.col("fp"), radius, keep)).alias("s")).select("fp", "s.t", "s.key")
    sizes = rows.groupBy("t", "key").count().where(F.col("count") > 1)
    # Shards of one fingerprint have no link; they end here.
    rows = rows.join(sizes, ["t", "key"])
    parts = F.ceil(F.col("count") / tree_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    # Part i meets part j as the pair (min, max): every row goes to as many pairs as there are parts.
    rows = rows.select("fp", "t", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    rows = rows.select("fp", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    dealt = rows.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "key", "i", "j", "own", "fp"]
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                new = np.stack([b.column(c).to_numpy().astype(np.int64) for c in names], 1)
                held = new if held is None else np.concatenate([held, new])
            if held is None or not len(held):
                continue
            cuts = np.flatnonzero((np.diff(held[:, :4], axis=0) != 0).any(1)) + 1
            groups = np.split(held, cuts)
            # The last group may go on in the next batch.
            held = groups.pop() if b is not None else held[:0]
            found = []
            for g in groups:
                if len(g) > 1:
                    first = g[:, 4] == g[0, 2]
                    p = g[:, 5].view(np.uint64) if g[:, 5].flags.c_contiguous else np.ascontiguousarray(g[:, 5]).view(np.uint64)
                    found.append(forest(p[first], p[~first] if g[0, 2] != g[0, 3] else p, radius))
            cols = [np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

    return dealt.select("t", "key", "i", "j", "own", "fp").mapInArrow(run, "a long, b long")


def classes(prints: DataFrame, radius: int = 4, keep: int = 2) -> DataFrame:
    """fp, component_id, first_fp of every distinct fingerprint of prints (doc_id, fp).

    component_id is the smallest doc_id of the class, first_fp that document's fingerprint.
    """
    each = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    return named(each, components(links(each, radius, keep)))


def named(each: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, component_id, first_fp of fingerprints (fp, least doc_id) and the roots of the linked ones."""
    known = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Nulls last: a row without an id names a class only if there is no other.
    first = known.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("m"))
    return known.join(first, "root").select("fp", F.col("m.least").alias("component_id"), F.col("m.fp").alias("first_fp"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialise(with_fingerprint(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "documents-fp")
    found = prints.join(classes(prints, radius), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def second(h: np.ndarray) -> np.ndarray:
    """Another 64 bits of each hash, mixed from the first."""
    x = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of two words (rows of two columns)."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int16)


def band_keys(prints: np.ndarray, tables: int, bits: int, seed: int = 9) -> np.ndarray:
    """rows x tables: (table, the fingerprint's bits at places drawn for it) as one number."""
    rng = np.random.default_rng(seed)
    unpacked = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    powers = 1 << np.arange(bits, dtype=np.int64)
    places = [rng.choice(unpacked.shape[1], bits, replace=False) for _ in range(tables)]
    return np.stack([(t << bits) + unpacked[:, p] @ powers for t, p in enumerate(places)], 1)


def trees(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, kids): BK-trees of fingerprints of two words, one a group, grown together level by level.

    group: numbers of groups, in order. A group's first row is its root, and rows go in by their order, so a
    node's descendants come after it. keys are parent * 256 + distance, in order, of the nodes in kids.
    """
    first = np.searchsorted(group, group)
    rows = np.flatnonzero(first != np.arange(len(group)))
    at = first[rows]
    keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows):
        key, one, of = np.unique(at * 256 + apart(prints[rows], prints[at]), return_index=True, return_inverse=True)
        keys.append(key)
        kids.append(rows[one])
        down = np.ones(len(rows), bool)
        down[one] = False
        rows, at = rows[down], rows[one][of[down]]
    keys, kids = np.concatenate(keys), np.concatenate(kids)
    order = np.argsort(keys)
    return keys[order], kids[order]


def near_earlier(prints: np.ndarray, group: np.ndarray, radius: int, most: int, few: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance), j < i, of one group: for each row the ``most`` nearest earlier ones within the radius.

    group: numbers of groups, in order. Each group is a BK-tree, which each of its rows searches: it walks down
    edges within the radius of its own distance, to nodes before it. Searchers of few * 1024 pairs at most, or one, walk
    together.
    """
    keys, kids = trees(prints, group)
    first = np.searchsorted(group, group)
    behind = np.cumsum(np.arange(len(group)) - first)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16))]
    lo = 0
    while lo < len(group):
        hi = max(lo + 1, int(np.searchsorted(behind, (behind[lo - 1] if lo else 0) + few * 1024, "right")))
        i = lo + np.flatnonzero(first[lo:hi] != np.arange(lo, hi))
        j = first[i]
        while len(i):
            d = apart(prints[i], prints[j])
            near = d <= radius
            found.append((i[near], j[near], d[near]))
            edge = j * 256 + d
            low = np.searchsorted(keys, np.maximum(edge - radius, j * 256))
            n = np.searchsorted(keys, np.minimum(edge + radius, j * 256 + 255), "right") - low
            i = np.repeat(i, n)
            j = kids[np.arange(len(i)) + np.repeat(low - (np.cumsum(n) - n), n)]
            before = j < i
            i, j = i[before], j[before]
        lo = hi
    i, j, d = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[kept], j[kept], d[kept]


def joined(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links (i, j, d), j < i < n, in order of i and d: each row's first, and links that join the trees of these which other links join."""
    one = np.flatnonzero(np.diff(i, prepend=-1))
    top = np.arange(n)
    top[i[one]] = j[one]
    while (top[top] != top).any():
        top = top[top]
    x, y = np.maximum(top[i], top[j]), np.minimum(top[i], top[j])
    more = []
    for p, q in np.unique(np.stack([x, y], 1)[x != y], axis=0).tolist():
        if top[p] != top[q]:
            more.append((p, q))
            top[top == top[p]] = top[q]
    far = np.array(more, np.int64).reshape(-1, 2)
    return np.concatenate([i[one], far[:, 0]]), np.concatenate([j[one], far[:, 1]]), np.concatenate([d[one], np.full(len(far), 2 * BITS + 1)])


def reach(prints: np.ndarray, group: np.ndarray, radius: int, few: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance), j < i, of one group: links that connect whatever all pairs within the radius connect.

    Those are each row's nearest earlier one, and between the trees of these links at distance 2 * BITS + 1,
    which say no more than that both are connected.
    """
    sizes = np.bincount(group)
    deep = [np.arange(lo, lo + sizes[group[lo]]) for lo in np.searchsorted(group, np.flatnonzero(sizes > few))]
    found = []
    for own in [np.flatnonzero(sizes[group] <= few), *deep]:
        if len(own):
            i, j, d = joined(len(own), *near_earlier(prints[own], group[own] - group[own[0]], radius, len(own), few))
            found.append((own[i], own[j], d))
    return tuple(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))


def candidates(prints: DataFrame, radius: int = 32, tables: int = 128, bits: int = 16, part_rows: int = 1024) -> DataFrame:
    """(a, b, d): links that connect all pairs of fingerprints (fp, fp2) within the radius that agree in all bits of some table.

    A bucket is a shard with a BK-tree of its own, which all its fingerprints search, and gives a spanning forest of the pairs found (``reach``), so that a group of copies gives links of its
    size and not of its square, and no pair within the radius is left unconnected. Buckets of many
    rows, found in a sixteenth of the fingerprints, are cut into parts, and every pair of parts meets.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                b = batch.slice(lo, 2048)
                x = np.stack([b.column(c).to_numpy() for c in ("fp", "fp2")], 1).view(np.uint64)
                k = band_keys(x, tables, bits)
                wide = np.repeat(x, tables, axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(wide[:, 0]), pa.array(wide[:, 1])], names=["k", "fp", "fp2"])

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("fp", "fp2").mapInArrow(keys, "k long, fp long, fp2 long")

    some = keyed(prints.where(F.pmod(F.xxhash64("fp", "fp2"), F.lit(16)) == 0)).groupBy("k").count()
    hot = materialise(some.where(F.col("count") > part_rows // 16).select("k", F.ceil(F.col("count") * 16 / part_rows).cast("int").alias("parts")), "hot")
    rows = keyed(prints).join(broadcast_if_small(hot, 100_000), "k", "left")
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.select("fp", "fp2", "k", F.pmod(F.xxhash64("fp", "fp2", F.lit(1)), parts).alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    bucket = (F.col("k") * 4096 + F.least("own", "other")) * 4096 + F.greatest("own", "other")
    dealt = rows.select(bucket.cast("long").alias("k"), "fp", "fp2").repartition("k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = np.concatenate([held, np.stack([b.column(c).to_numpy() for c in ("k", "fp", "fp2")], 1)])
            if not len(held):
                continue
            # The last bucket may go on in the next batch.
            end = int(np.searchsorted(held[:, 0], held[-1, 0])) if b is not None else len(held)
            own, held = held[:end], held[end:]
            group = np.cumsum(np.diff(own[:, 0], prepend=own[:1, 0]) != 0)
            x = np.ascontiguousarray(own[:, 1:]).view(np.uint64)
            i, j, d = reach(x, group, radius) if len(own) else (np.zeros(0, np.int64),) * 3
            a, c = own[i, 1], own[j, 1]
            rows = np.unique(np.stack([np.maximum(a, c), np.minimum(a, c), d.astype(np.int64)], 1)[a != c], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], names=["a", "b", "d"])

    return dealt.mapInArrow(run, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, h: the distinct shingles (32 bits of their hashes) of each set of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            first = {f: t for f, t in zip(batch.column("id").to_pylist(), texts, strict=True)}
            sets = [np.unique(shingle_hashes(t, width).astype(np.uint32)).view(np.int32) for t in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.int64()), pa.array(sets, pa.list_(pa.int32()))], names=["id", "h"])

    return docs.mapInArrow(run, "id long, h array<int>").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b) of the pairs whose shingle sets have that Jaccard similarity."""
    rows = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("h").alias("x")), "a")
    rows = rows.join(sets.select(F.col("id").alias("b"), F.col("h").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return rows.where(common / (F.size("x") + F.size("y") - common) >= least).select("a", "b")


def alike(sides: np.ndarray, owners: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between owners that have sets of that Jaccard similarity, on sides 0 and 1; sets of one side only meet each other.

    All pairs but those of owners that are linked already, and of sizes too unequal, are compared.
    """
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(codes.max(initial=0) + 1, np.uint8)
    top = np.unique(owners, return_inverse=True)[1]
    two = sides.any()
    found = []
    for i in np.flatnonzero(sides == 0):
        fits = (top != top[i]) & (np.minimum(sizes, sizes[i]) >= least * np.maximum(sizes, sizes[i])) & (sizes > 0)
        other = np.flatnonzero(fits & (sides == 1)) if two else i + np.flatnonzero(fits[i:])
        if not len(other):
            continue
        mark[codes[starts[i] : ends[i]]] = 1
        n = sizes[other]
        first = np.cumsum(n) - n
        common = np.add.reduceat(mark[codes[np.arange(n.sum()) + np.repeat(starts[other] - first, n)]], first, dtype=np.int64)
        mark[codes[starts[i] : ends[i]]] = 0
        for j in other[common / (sizes[i] + n - common) >= least]:
            if top[j] != top[i]:
                found.append((int(owners[i]), int(owners[j])))
                top[top == top[j]] = top[i]
    return found


def compared(rows: DataFrame, least: float, cell: int = 1 << 18) -> DataFrame:
    """(a, b): links between classes c of a group g that hold sets h of that similarity; rows are (id, c, g, h).

    Each pair of sets of one group and two classes is compared. A group's sets are dealt to cells of about
    ``cell`` shingles: a large class has cells of its own, the others share some. Every pair of cells meets
    in one task but those of one class, so the work on a large class grows with the sets beside it.
    """
    weight = F.sum(F.size("h") + 256).alias("w")
    classes = materialise(rows.groupBy("g", "c").agg(weight), "classes")
    large = F.col("w") > cell // 2
    own = classes.where(large).select("g", "c", F.ceil(F.col("w") / cell).cast("int").alias("n"))
    rest = classes.where(~large).groupBy("g").agg(F.ceil(F.sum("w") / cell).cast("int").alias("m"))
    parts = [own.select("g", F.lit(True).alias("whole"), F.col("c").alias("o"), "n"), rest.select("g", F.lit(False).alias("whole"), F.col("g").alias("o"), F.col("m").alias("n"))]
    cells = parts[0].union(parts[1]).select("g", "whole", "o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p")).select("g", F.struct("whole", "o", "p").alias("x"))
    pairs = cells.join(cells.withColumnRenamed("x", "y"), "g").where((F.col("x") <= F.col("y")) & ~(F.col("x.whole") & F.col("y.whole") & (F.col("x.o") == F.col("y.o"))))
    pairs = materialise(pairs.select("g", "x", "y", F.monotonically_increasing_id().alias("pair")), "cells")
    sides = pairs.select("pair", "g", F.lit(0).alias("side"), "x").union(pairs.where(F.col("x") != F.col("y")).select("pair", "g", F.lit(1), "y"))
    sides = sides.select("pair", "side", "g", "x.whole", "x.o", "x.p")
    whole = F.col("n").isNotNull()
    placed = rows.join(own, ["g", "c"], "left").join(rest, "g", "left")
    placed = placed.select("g", whole.alias("whole"), F.when(whole, F.col("c")).otherwise(F.col("g")).alias("o"), F.when(whole, F.pmod(F.xxhash64("id"), "n")).otherwise(F.pmod(F.xxhash64("c"), "m")).cast("int").alias("p"), "c", "h")
    dealt = placed.join(sides, ["g", "whole", "o", "p"]).select("pair", "side", "c", "h").repartition("pair").sortWithinPartitions("pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for b in itertools.chain(batches, [None]):
            found = []
            new = [(None,) * 4]
            if b is not None:
                h = b.column("h")
                sets = np.split(h.flatten().to_numpy(), np.cumsum(h.value_lengths().to_numpy())[:-1])
                new = zip(b.column("pair").to_pylist(), b.column("side").to_pylist(), b.column("c").to_pylist(), sets, strict=True)
            for pair, *row in new:
                if pair != now:
                    # The last pair of cells may go on in the next batch.
                    if held:
                        found += alike(np.array([r[0] for r in held]), np.array([r[1] for r in held]), [r[2] for r in held], least)
                    held, now = [], pair
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def similar(texts: DataFrame, prints: DataFrame, width: int, least: float, **how) -> DataFrame:
    """(node, root) of the sets of texts (id, text) that are linked by that similarity; prints has their id, fp, fp2.

    Sets of one fingerprint are candidates: each is linked to the smallest of them, which stands for all in
    links between fingerprints. Each set's nearest candidate is verified first, which makes classes. Classes
    that candidates connect are a group, and all its pairs of sets of two classes are compared. So a group of
    copies costs about one verification each, and no pair goes untried for its nearer neighbours.
    """
    found = candidates(prints.select("fp", "fp2").distinct(), **how)
    first = prints.groupBy("fp").agg(F.min("id").alias("id"))
    for c in "ab":
        found = found.join(first.select(F.col("fp").alias(c), F.col("id").alias(f"s{c}")), c)
    same = prints.join(first.withColumnRenamed("id", "first"), "fp").where(F.col("id") != F.col("first"))
    found = found.select(F.col("sa").alias("a"), F.col("sb").alias("b"), "d").union(same.select("id", "first", F.lit(0)))
    found = materialise(found, "pairs")
    release(texts.sparkSession)
    wanted = found.select("a").union(found.select("b")).distinct().withColumnRenamed("a", "id")
    sets = materialise(shingle_sets(texts.join(wanted, "id", "left_semi"), width), "shingles")
    release(texts.sparkSession)
    nearest = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b")
    roots = components(verified(nearest, sets, least))
    of = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
    rest = found.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    groups = components(rest)
    rows = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("c"), "h")
    rows = rows.join(groups.select(F.col("node").alias("c"), F.col("root").alias("g")), "c")
    more = components(compared(rows, least))
    known = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.union(more.join(roots, "node", "left_anti"))


def first_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, **how) -> DataFrame:
    """docs with one row of each class, the one with the smallest doc_id; its columns stay as they are.

    Texts are linked where their sets of width-word shingles have a Jaccard similarity of least or more; equal
    sets, known by a hash, are made one first. At
    0.8, the 64 bits of half of such pairs differ in nine places or more, too many for whole blocks to
    agree, so the fingerprint has 128 bits here, and candidates agree in drawn bits, in one table at least of many.
    Repeated rows are one; among rows without a doc_id only copies are.
    """
    own, fp, fp2 = names = fresh(docs.columns, "set", "fp", "fp2")
    full = materialise(with_set(docs, width, names), "documents-fp")
    prints = materialise(full.groupBy(F.col(own).alias("id")).agg(F.min("doc_id").alias("least"), F.min(fp).alias("fp"), F.min(fp2).alias("fp2")), "prints")
    found = named(prints.select(F.col("id").alias("fp"), "least"), similar(full.select(F.col(own).alias("id"), "text"), prints, width, least, **how))
    first = found.select("component_id", "first_fp").distinct()
    kept = full.join(first, (full[own] == first["first_fp"]) & full["doc_id"].eqNullSafe(first["component_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*[f"`{c}`" for c in docs.columns])
