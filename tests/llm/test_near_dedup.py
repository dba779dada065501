from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import near_dedup as nd
from cairnfield.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_classes(prints, radius):
    """Class of each position by union of all pairs."""
    own = list(range(len(prints)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                own[b] = a
    return [root(i) for i in range(len(prints))]


def test_hashes_are_sparks(spark):
    import xxhash

    texts = ["", "a", "some four word run", "é ü 日本", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] & (2**64 - 1) for r in df] == [xxhash.xxh64_intdigest(t, 42) for t in texts]


def plain_fingerprint(text, width):
    import re

    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two three four", "A b C d e F g", "x y " * 200, "é Ü ß"])
def test_fingerprint_by_the_definition(text):
    got = nd.majority(nd.shingle_hashes(None if text is None else text.encode(), 4))
    assert got & (2**64 - 1) == plain_fingerprint(text, 4)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1).map(lambda v: v * 0x0041000100010001 & (2**64 - 1)), min_size=1, max_size=60, unique=True), st.integers(0, 6))
def test_tree_finds_all_within_radius(prints, radius):
    p = np.array(prints, np.uint64)
    found = {(node, int(i)) for node, near in nd.BKTree(p).within(p, radius) for i in near}
    assert found == {(i, j) for i in range(len(p)) for j in range(len(p)) if (prints[i] ^ prints[j]).bit_count() <= radius}


@pytest.mark.parametrize("tree_rows", [7, 1024])
def test_links_and_classes_against_all_pairs(spark, tree_rows):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = list(dict.fromkeys([*base, *[b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)) for b in base for _ in range(6)], 0, 1, 2**63 + 1]))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for radius, keep in ((4, 2), (6, 3)):
        roots = {r["node"]: r["root"] for r in components(nd.links(df, radius, keep, tree_rows)).collect()}
        brute = brute_classes(prints, radius)
        groups, ours = {}, {}
        for i, s in enumerate(signed):
            groups.setdefault(brute[i], set()).add(s)
            ours.setdefault(roots.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = nd.near_duplicates(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i], 4) for i in ids]
    brute = dict(zip(ids, (ids[c] for c in brute_classes(prints, 4)), strict=True))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", brute[i]) for i, p in zip(ids, prints, strict=True)}


def test_edges(docs):
    df = docs(["", None, " ", "a b c d e", "a b c d e", "q"], [5, 3, None, 9, 9, None])
    got = Counter((r["doc_id"], r["component_id"]) for r in nd.near_duplicates(df).collect())
    assert got == {(None, None): 1, (None, 3): 1, (3, 3): 1, (5, 3): 1, (9, 9): 2}
    assert nd.near_duplicates(docs([])).count() == 0


def test_first_of_each(docs):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs([text, text, text, "something else here", None, "", "q r s"], [4, 2, 2, 7, 8, 6, None])
    got = nd.first_of_each(df)
    assert got.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["2", "6", "7", "None"]


def test_columns_of_any_name(docs):
    from cairnfield.llm import language_id

    names = {"fp": "set", "pos": "FP2", "source": "component_id", "lang": "first_fp", "score": "lang_pred"}
    df = docs(["a b c", "a b c", "d e f g h i", None], langs=["x"] * 4).withColumnsRenamed(names).withColumn("fp", F.lit("z"))
    got = nd.first_of_each(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [0, 2, 3]
    known = language_id.known_language(df.withColumn("lang", F.lit("en")))
    assert known.columns == [*df.columns, "lang"] and sorted(r["doc_id"] for r in known.collect()) == [0, 1, 2]


def test_pages_of_one_line_stay(docs):
    """A line that fills both texts makes their fingerprints equal, by repeats, but not their sets of shingles."""
    line = "this line is on every page "
    rng = np.random.default_rng(0)
    texts = [line * 400 + " ".join(f"own{v}" for v in rng.integers(0, 10**6, 60)) for _ in range(3)]
    texts += [line + texts[0][len(line) * 400 :] + " " + line * 30]
    assert sorted(r["doc_id"] for r in nd.first_of_each(docs(texts)).collect()) == [0, 1, 2]


def test_written_tables_leave_no_unused_memory(spark):
    """The driver's heap shrinks with every table written, or many small plans fill all of it."""
    from cairnfield.session import materialise, trim

    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    junk = [spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, 1 << 23) for _ in range(12)]
    large = runtime.totalMemory()
    del junk
    assert materialise(spark.range(3), "few").count() == 3
    assert runtime.totalMemory() - runtime.freeMemory() < large - (1 << 29)
    assert trim(spark) in (True, False)


def test_long_chain_is_one_component(spark):
    links = spark.range(200).selectExpr("id a", "id + 1 b").union(spark.sql("select 500L a, 501L b")).union(spark.sql("select 9L a, 9L b"))
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.sql("select 1L a, 1L b")).count() == 0


def test_similar_texts_against_all_pairs(docs):
    """Copies with a few words changed, some above and some below the similarity; the fixed seeds make this one outcome."""
    rng = np.random.default_rng(6)
    texts = []
    for _ in range(40):
        base = [f"w{v}" for v in rng.integers(0, 5000, rng.integers(40, 400))]
        for _ in range(6):
            own = list(base)
            for at in rng.choice(len(own), rng.integers(0, max(2, len(own) // 40)), replace=False):
                own[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(own))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [set(nd.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    own = list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                own[b] = a
    want = {i for i in range(len(texts)) if root(i) == i}
    got = {r["doc_id"] for r in nd.first_of_each(docs(texts)).collect()}
    assert len(want) < len(texts)
    assert got == want


def test_near_earlier_against_all_pairs():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    prints[200:] = prints[:200] ^ (np.uint64(1) << rng.integers(0, 60, (200, 2)).astype(np.uint64))
    group = np.sort(rng.integers(0, 4, 400))
    group[group == 3] = 2
    for few in (3, 1000):
        i, j, d = nd.near_earlier(prints, group, 8, 1000, few)
        brute = {(a, b) for a in range(400) for b in range(a) if group[a] == group[b] and nd.apart(prints[a], prints[b]) <= 8}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == brute
        assert (nd.apart(prints[i], prints[j]) == d).all()


def test_buckets_are_searched_by_trees(monkeypatch):
    """Each bucket is a BK-tree: siblings differ in their distance to the parent, and a search leaves out what the distances rule out."""
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**63, (600, 2)).astype(np.uint64)
    prints[60:] = prints[rng.integers(0, 60, 540)] ^ (np.uint64(1) << rng.integers(0, 60, (540, 2)).astype(np.uint64))
    group = np.sort(rng.integers(0, 2, 600))
    keys, kids = nd.trees(prints, group)
    assert len(set(keys.tolist())) == len(kids) == 598 and sorted([*kids, *np.searchsorted(group, [0, 1])]) == list(range(600))
    assert (keys // 256 < kids).all() and (group[keys // 256] == group[kids]).all()
    assert (nd.apart(prints[keys // 256], prints[kids]) == keys % 256).all()
    seen = [0]

    def counted(x, y, f=nd.apart):
        d = f(x, y)
        seen[0] += d.size
        return d

    brute = {(a, b) for a in range(600) for b in range(a) if group[a] == group[b] and nd.apart(prints[a], prints[b]) <= 4}
    monkeypatch.setattr(nd, "apart", counted)
    i, j, _ = nd.near_earlier(prints, group, 4, 1000)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == brute
    assert 0 < seen[0] < sum(n * (n - 1) // 2 for n in np.bincount(group).tolist()) / 2


def same_classes(texts, least=0.8):
    """Position of the first text of each text's class, by all pairs."""
    sets = [set(nd.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    own = list(range(len(texts)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= least * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                own[b] = a
    return [root(i) for i in range(len(texts))]


def changed(rng, words, n, name):
    """words with n of them changed, at least five apart."""
    own = list(words)
    for at in rng.choice(np.arange(4, len(own) - 4, 5), n, replace=False):
        own[at] = f"{name}{at}"
    return own


def test_pairs_in_a_crowd_are_all_found(docs):
    """Texts of one template below the similarity, and some whose partner is only one of many near fingerprints."""
    rng = np.random.default_rng(4)
    base = [f"w{v}" for v in range(204)]
    crowd = [changed(rng, base, 4, f"a{k}x") for k in range(500)]
    crowd += [changed(rng, crowd[k], 4, f"b{k}x") for k in range(200)]
    texts = [" ".join(crowd[i]) for i in rng.permutation(len(crowd))]
    want = {i for i, r in enumerate(same_classes(texts)) if i == r}
    assert 400 < len(want) < 550
    assert {r["doc_id"] for r in nd.first_of_each(docs(texts)).collect()} == want


def test_reach_connects_all_pairs():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, (500, 2)).astype(np.uint64)
    prints[100:] = prints[rng.integers(0, 100, 400)] ^ (np.uint64(1) << rng.integers(0, 60, (400, 2)).astype(np.uint64))
    group = np.sort(rng.integers(0, 3, 500))

    def parts(links):
        top = list(range(500))
        for a, b in links:
            top = [top[b] if t == top[a] else t for t in top]
        return {frozenset(i for i in range(500) if top[i] == t) for t in top}

    brute = [(a, b) for a in range(500) for b in range(a) if group[a] == group[b] and nd.apart(prints[a], prints[b]) <= 3]
    for few in (3, 1000):
        i, j, d = nd.reach(prints, group, 3, few)
        assert len(i) < 500 and (j < i).all() and parts(zip(i.tolist(), j.tolist(), strict=True)) == parts(brute)
        near = d <= 3
        assert (nd.apart(prints[i[near]], prints[j[near]]) == d[near]).all()


@pytest.mark.parametrize("cell", [700, 1 << 18])
def test_compared_against_all_pairs(spark, cell):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**31, (4, 60))
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.08]), rng.integers(0, 2**31, 60), base[k % 4])).tolist() for k in range(120)]
    rows = [(k, 1000 + (0 if k % 3 else k), k % 2, sets[k]) for k in range(120)]
    got = {tuple(sorted((r["a"], r["b"]))) for r in nd.compared(spark.createDataFrame(rows, "id long, c long, g long, h array<int>"), 0.8, cell).collect()}
    brute = {tuple(sorted((x[1], y[1]))) for x in rows for y in rows if x[1] != y[1] and x[2] == y[2] and len({*x[3]} & {*y[3]}) >= 0.8 * len({*x[3]} | {*y[3]})}
    assert brute and got <= brute

    def parts(links):
        top = {c: c for _, c, _, _ in rows}
        for a, b in links:
            top = {c: top[b] if t == top[a] else t for c, t in top.items()}
        return {frozenset(c for c in top if top[c] == t) for t in top.values()}

    assert parts(got) == parts(brute)


def test_equal_fingerprints_are_verified(docs):
    """A line repeated many times makes the fingerprint, with repeats, of texts that share little else."""
    rng = np.random.default_rng(5)
    line = [f"l{v}" for v in range(9)] * 120
    texts = [" ".join([*line, *(f"own{k}x{v}" for v in range(rng.integers(60, 200)))]) for k in range(12)]
    texts += [texts[3] + " end", texts[4].upper().replace(" ", "\n"), " ".join(line), " ".join(line[:-1])]
    want = {i for i, r in enumerate(same_classes([" ".join(t.lower().split()) for t in texts])) if i == r}
    assert want == {*range(12), 14}
    assert {r["doc_id"] for r in nd.first_of_each(docs(texts)).collect()} == want


@pytest.mark.parametrize("times", [5, 10, 20])
def test_copies_with_a_repeated_line_are_found(docs, times):
    rng = np.random.default_rng(times)
    texts = []
    for k in range(20):
        own, line = [f"v{v}" for v in rng.integers(0, 10**6, 250)], [f"l{k}x{v}" for v in range(12)]
        texts += [" ".join([*own, *line]), " ".join([*own, *line * times])]
    assert same_classes(texts) == [i - i % 2 for i in range(40)]
    assert {r["doc_id"] for r in nd.first_of_each(docs(texts)).collect()} == set(range(0, 40, 2))
