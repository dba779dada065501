import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import ann, queries, sharding, url_filters

SF = "/root/testdata/sf0.01"

# --- URLs ------------------------------------------------------------------------------


def plain_rule(host, path, rules):
    fits = [(len(h), len(p), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[4], max(fits)[3]) if fits else None


def test_trie_against_plain_rules():
    rng = np.random.default_rng(0)
    labels, parts = ["com", "example", "a", "b", "c0m"], ["en", "e", "7", "77", "", "x"]
    make = lambda: (".".join(rng.choice(labels, rng.integers(1, 4))), "/" + "/".join(rng.choice(parts, rng.integers(0, 4))) if rng.random() < 0.9 else "")
    rules = [(str(rng.choice(["allow", "block"])), *make()) for _ in range(60)] + [("block", "com", ""), ("allow", "a.com", "/en/7"), ("block", "a.com", "/en/7")]
    trie = url_filters.Trie(rules)
    for _ in range(3000):
        host, path = make()
        assert trie.judge(host, path) == plain_rule(host, path, rules), (host, path)


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
    ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    ("http://notexample.com/en", "notexample.com", "/en", None, "allow"),
    ("x://net?q=/de/", "net", "", None, "allow"),
    ("a://b.net/de/#z", "b.net", "/de/", "net/de/", "block"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("a://h.org/es/x://y", "h.org", "/es/x://y", "org/es/", "block"), ("a://É.com/en/\n7", "É.com", "/en/\n7", "com/en/", "block"),
])
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "h", "p")], "page_id long, url string, host string, rule string")
    r = url_filters.filter_urls(df, queries.URL_RULES).first()
    assert tuple(r) == (1, host, path, rule, verdict)


# --- shards -----------------------------------------------------------------------------


def test_fill_is_fair_and_stable():
    shards = [f"s{i}" for i in range(16)]
    owner = sharding.fill(shards, 1619)
    n = Counter(owner)
    assert max(n.values()) - min(n.values()) <= 1
    fewer = sharding.fill(shards[:-1], 1619)
    moved = sum(shards[a] != shards[b] for a, b in zip(owner, fewer, strict=True) if a != 15)
    assert moved < 0.15 * 1619
    for bad in (lambda: sharding.fill([], 7), lambda: sharding.fill(["a", "a"], 7), lambda: sharding.fill(["a"], 8), lambda: sharding.fill(["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            bad()


def test_turns_are_taken():
    """By the definition, claim by claim."""
    shards, size = ["x", "y", "z"], 11
    lists = [[(sharding._number(f"{s}/offset") + j * (sharding._number(f"{s}/skip") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = {}
    while len(owner) < size:
        for i, prefs in enumerate(lists):
            free = [p for p in prefs if p not in owner]
            if free:
                owner[free[0]] = i
    assert sharding.fill(shards, size) == [owner[s] for s in range(size)]


def test_placement_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, shard string")
    got = sharding.place(df, "doc_id", ["p", "q"], 211).collect()
    assert len(got) == 3 and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.place(df.limit(0), "doc_id", ["p"], 7).count() == 0


@pytest.mark.parametrize("name", ["slot", "shard", "owner", "key", "a.b"])
def test_keys_of_any_name(spark, name):
    df = spark.createDataFrame([("x", 1), (None, 2)], f"`{name}` string, other int")
    got = sharding.place(df, name, ["p", "q"], 211)
    assert got.columns == [name if name not in ("slot", "shard") else "key", "slot", "shard"]
    plain = sharding.place(df.toDF("plain", "other"), "plain", ["p", "q"], 211)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, plain.collect())))


# --- neighbours ---------------------------------------------------------------------------


def brute(ids, x, every, k):
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x.astype(float) - x[ids == q][0].astype(float)) ** 2).sum(1))
        own = ids != q
        order = np.lexsort((ids[own], d[own]))[:k]
        out[int(q)] = list(zip(ids[own][order].tolist(), d[own][order].tolist(), strict=True))
    return out


def recall(spark, d):
    table = spark.read.parquet(f"{d}/embeddings.parquet")
    pdf = table.toPandas()
    want = brute(pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_numpy()), 100, 10)
    got = {}
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    exact = {q: dict(v) for q, v in want.items()}
    for q, rows in got.items():
        assert all(math.isclose(s, exact[q][v], rel_tol=1e-12) for v, s in rows if v in exact[q])
        assert rows == sorted(rows, key=lambda r: (r[1], r[0]))
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want])


def test_recall(spark):
    assert recall(spark, SF) >= 0.95
    assert recall(spark, "/root/testdata/sf0.1") >= 0.95


def test_anisotropic_loss_weighs_parallel_error():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def parallel(threshold):
        book = ann.train(x, threshold)
        codes = ann.assign(x.copy(), book)
        back = np.take_along_axis(book.centres, codes.T[:, :, None], 1).transpose(1, 0, 2).reshape(x.shape)
        return np.abs(((x - back) * x).sum(1)).mean()

    assert parallel(0.6) < 0.8 * parallel(0.0)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (100, [0.0, 1.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 0.0]), (4, [1.0, nan, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, 0.0, 0.5]), (7, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (200, None), (6, [1.0, 0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 6), (0, 2, 100), (100, 1, 0), (100, 2, 6)]
    assert math.isclose(got[0][3], 0.5) and math.isclose(got[1][3], math.sqrt(2))
    assert ann.nearest(df.limit(0)).count() == 0


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, block=64, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(np.arange(600), x, 100, 10)
    assert got == {q: [v for v, _ in rows] for q, rows in want.items()}


def test_one_id_with_two_vectors_and_double_precision(spark):
    """The smallest vector asks; both are candidates of others; distances are those of the doubles."""
    x = {0: [[1.0, 0.0], [0.5, 9.0]], 1: [[1.0, 1e-12]], 2: [[1.0, 2e-12]], 100: [[5.0, 5.0]]}
    df = spark.createDataFrame([(i, v) for i, vs in x.items() for v in vs] * 2, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    own = {q: min(x[q]) for q in (0, 100)}
    want = []
    for q in (0, 100):
        near = sorted((math.dist(v, own[q]), i) for i, vs in x.items() if i != q for v in vs)
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12) for g, w in zip(got, want, strict=True))


def test_all_ids_ask(spark):
    """Query blocks follow the rows that ask, not a share of all rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(100 * i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, block=50, query_block=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: [v for v, _ in rows] for q, rows in brute(np.arange(300) * 100, x, 100, 10).items()}
