import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.llm import decontamination, language_id, lm_scoring, queries, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- substring dedup -----------------------------------------------------------------


def test_cover_reaches_all_remainders():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))
    assert substring_dedup.ANCHOR + p - 1 == substring_dedup.WINDOW == 35


def brute_dedup(texts):
    all_words = [words(t) for t in texts]
    n = Counter(tuple(w[i : i + 35]) for w in all_words for i in range(len(w) - 34))
    out = []
    for w in all_words:
        gone = {p for i in range(len(w) - 34) if n[tuple(w[i : i + 35])] > 1 for p in range(i, i + 35)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_substring_dedup_against_brute_force(docs):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, short = fresh(50), fresh(34)
    texts = [" ".join(fresh(rng.randrange(30)) + shared[: rng.randrange(30, 51)] + fresh(rng.randrange(40))) for _ in range(25)]
    texts += [" ".join(short + fresh(3)), " ".join(fresh(2) + short), "a " * 36, "b " * 35, "c " * 34, None, "", " ", " ".join(fresh(40)), "é\u00a0ü " * 50, texts[0], "\t".join(shared)]
    df = docs(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup(df).collect()}
    assert got == dict(enumerate(brute_dedup(texts)))
    again = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup(df.repartition(7)).collect()}
    assert again == got
    cleaned = substring_dedup.dedup(df, out="text")
    assert cleaned.schema == df.schema
    for r in cleaned.collect():
        t, (_, gone, sha) = texts[r["doc_id"]], got[r["doc_id"]]
        assert r["text"] == t if not gone else hashlib.sha256(r["text"].encode()).hexdigest() == sha
    assert substring_dedup.dedup(docs([])).count() == 0


# --- decontamination -----------------------------------------------------------------


def brute_leaks(texts, items, least=0.8):
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
    runs = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for d, t in texts:
        w = low(t)
        for i, item in items:
            v = low(item)
            k = min(5, len(v))
            for s in range(len(w) - len(v) + 1) if v else ():
                a, b = runs(w[s : s + len(v)], k), runs(v, k)
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= least and j > out.get((d, i), (0, 0))[1]:
                    out[d, i] = (s, j)
    return out


def test_copies_give_each_place_once(spark, docs):
    """A hot text gives one row of places, whatever the chunks and partitions, and a hot passage no hot row."""
    text = " ".join(f"w{i}" for i in range(200))
    df = docs([text] * 400).repartition(8)
    few = substring_dedup.repeated_windows(df, spark.createDataFrame([], "tid long")).collect()
    assert [sorted(r["places"]) for r in few] == [list(range(166))]
    assert [sorted(r["places"]) for r in substring_dedup.repeated_windows(df).collect()] == [list(range(166))]
    passage = " ".join(f"p{i}" for i in range(50))
    mixed = docs([f"a{i} {passage} b{i}" for i in range(300)] + [text] * 40 + ["short copy"] * 40 + [text + " more"]).repartition(5)
    for heavy in (substring_dedup.HEAVY, 0):
        rows = substring_dedup.dedup(mixed, heavy=heavy).collect()
        got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows}
        assert got == {**{i: (52, 50) for i in range(300)}, **{i: (200, 200) for i in range(300, 340)}, **{i: (2, 0) for i in range(340, 380)}, 380: (201, 200)}


def test_merged_rows_of_a_chunk():
    """One row a hash asks, the chunk's other places of it are known to be shared."""
    h = np.array([5, 5, 5, 9, 7], np.uint64)
    b = substring_dedup._merged(h, np.zeros(5, np.int32), np.array([1, 1, 2, 2, 3]), np.array([0, 8, 3, 4, 1], np.int32), np.array([False, False, False, False, True]))
    rows = sorted(zip(*(b.column(c).to_pylist() for c in ("g", "tid", "pos", "twice", "h")), strict=True))
    assert [r[:4] for r in rows] == [(-1, 1, 8, True), (-1, 2, 3, True), (0, 1, 0, True), (0, 2, 4, False), (0, 3, 1, True)]
    assert {r[4] for r in rows[2:]} == {5, 9, 7} and len({r[4] for r in rows}) == 5


def test_substring_columns_of_any_name(spark, docs):
    df = docs(["x " * 80, "y"]).withColumnsRenamed({"fp": "__tid", "pos": "__places", "source": "__text", "score": "__heavy", "lang": "__0"})
    got = substring_dedup.dedup(df, out="text")
    assert got.columns == df.columns and sorted(r["text"] for r in got.collect()) == ["", "y"]


def test_decontamination_against_all_windows(spark, docs):
    rng = random.Random(5)
    fresh = lambda n: [f"v{rng.randrange(10**5)}" for _ in range(n)]
    items = [(i, " ".join(fresh(n))) for i, n in enumerate((15, 20, 33, 57, 57, 4, 1, 70))] + [(90, ""), (91, None), (92, " ".join(["z"] * 30))]
    texts = [(0, None), (1, ""), (2, " ".join(fresh(200)))]
    for k, (_, item) in enumerate(items):
        w = words(item)
        texts.append((10 + k, " ".join(fresh(30) + [x.upper() for x in w] + fresh(30))))
        texts.append((30 + k, " ".join(w)))
        if len(w) > 50:
            changed = [*w]
            changed[len(w) // 2] = "other"
            texts.append((50 + k, " ".join(fresh(9) + changed)))
            texts.append((70 + k, " ".join(fresh(3) + w[3:] + fresh(3))))
            half = [x if i % 2 else "other" for i, x in enumerate(w)]
            texts.append((110 + k, " ".join(half)))
    texts += [(200, "z " * 500), (201, " ".join(words(items[2][1]) * 3)), (30, texts[3][1])]
    df = docs([t for _, t in texts], [d for d, _ in texts])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontamination.contaminated(df, bench).collect()}
    want = brute_leaks(texts, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in got)
    left = decontamination.clean(df, bench)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in texts if not any(k[0] == d for k in want))
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(df, none).count() == 0 and decontamination.contaminated(docs([]), bench).count() == 0


def test_items_of_any_length(spark, docs):
    """A piece of a long item is not the item; windows of 9,000 words are counted as any others."""
    rng = random.Random(8)
    item = [f"v{rng.randrange(10**6)}" for _ in range(9000)]
    changed = [w if i % 100 else "other" for i, w in enumerate(item)]
    texts = [item, item[:8000], item[:5000], ["a", "b", *item, "c"], [*item[:8500], *["x"] * 500], item[-1000:], [*changed, "end"], item[-1:]]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["start"], r["similarity"]) for r in decontamination.contaminated(docs([" ".join(t) for t in texts]), bench).collect()}
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, t in enumerate(texts):
        for s in range(max(1, len(t) - len(item) + 1)):
            a, b = runs(t[s : s + len(item)]), runs(item)
            j = sum((a & b).values()) / sum((a | b).values())
            if j >= 0.8 and j > want.get(d, (0, 0))[1]:
                want[d] = (s, j)
    assert got == want and {0, 1, 3, 4, 6} == want.keys()


def test_blocks_find_all_within_the_radius(spark):
    """Pairs within the radius meet once, others don't; far fewer meet in a block than there are pairs of fingerprints and blocks."""
    rng = np.random.default_rng(3)
    items = rng.integers(-(2**63), 2**63 - 1, 40)
    prints = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)]
    prints += [int(i) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 30), replace=False)) for i in items for _ in range(8)]
    for radius in (23, 9, 3):
        a = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "a long, x long").select("a", "x", F.explode(decontamination.own_blocks(F.col("x"))).alias("k"))
        b = spark.createDataFrame([(i, int(p)) for i, p in enumerate(items)], "b long, y long").select("b", "y", F.explode(decontamination.near_blocks(F.col("y"), radius)).alias("k"))
        met = {(r["a"], r["b"]) for r in a.join(b, "k").collect()}
        near = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(items) if ((p ^ int(q)) & (2**64 - 1)).bit_count() <= radius}
        assert near <= met


def test_plain_votes_are_the_packed_ones(spark):
    rng = np.random.default_rng(1)
    rows = [([int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)],) for n in (1, 2, 37, 800)] + [([7] * 64,)]
    df = spark.createDataFrame(rows, "h array<bigint>")
    h, n = F.col("h"), F.size("h")
    assert all(r[0] == r[1] for r in df.select(decontamination.packed_votes(h, n), decontamination.plain_votes(h, n)).collect())


def test_copies_are_compared_once(spark, docs):
    leak = " ".join(f"w{i}" for i in range(60))
    df = docs([f"before {leak} after"] * 300 + ["clean words only"] * 50).repartition(8)
    bench = spark.createDataFrame([(5, leak)], "item_id long, text string")
    got = decontamination.contaminated(df, bench).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(300)) and {(r["start"], r["similarity"]) for r in got} == {(1, 1.0)}
    assert decontamination.clean(df, bench).count() == 50
    texts = df.select(F.xxhash64("text").alias("tid"), "text")
    items = decontamination.items_of(bench)
    assert decontamination._windows(texts, items, 5, 0.8, 1 << 12, 1000).count() == 3


def test_documents_shorter_than_an_item(spark, docs):
    item = [f"v{i}" for i in range(50)]
    texts = [item[:48], item[3:47], item[:41], item[5:46], item[:40], item[:30], [*item[:20], "other", *item[21:48]], item[:4], ["z"] * 30]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:45])), (9, "z " * 33)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontamination.contaminated(docs([" ".join(t) for t in texts]), bench).collect()}
    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for d, t in enumerate(texts):
        for i, v in ((7, item), (8, item[:45]), (9, ["z"] * 33)):
            for s in range(max(1, len(t) - len(v) + 1)):
                a, b = runs(t[s : s + len(v)]), runs(v)
                j = sum((a & b).values()) / sum((a | b).values())
                if j >= 0.8 and j > want.get((d, i), (0, 0))[1]:
                    want[d, i] = (s, j)
    assert got == want
    assert {(0, 7), (1, 7), (2, 7), (9 - 1, 9)} <= want.keys() and (5, 7) not in want


def test_packed_votes_are_a_simhash(spark):
    """The fingerprint's bits, in its own order, are the majorities of the hashes' bits."""
    rng = np.random.default_rng(0)
    h = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 37)]
    df = spark.createDataFrame([(h,)], "h array<bigint>")
    got = df.select(decontamination.fingerprint(F.col("h"), F.size("h"))).first()[0] & (2**64 - 1)
    for j in range(16):
        for lane in range(4):
            votes = sum((x >> (4 * j + lane)) & 1 for x in h)
            assert (got >> (16 * lane + j)) & 1 == (2 * votes > 37)


def test_no_python_on_executors(spark):
    for q in (queries.op7_decontamination, queries.op9_sharding):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


# --- language -------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6, 9])
def test_codewords_are_apart(k):
    book = language_id.codebook(k)
    assert book.shape[0] == k and len({tuple(r) for r in book}) == k
    gaps = [(book[i] != book[j]).sum() for i in range(k) for j in range(i)]
    assert min(gaps) >= (1 if k == 2 else book.shape[1] // 3)


def test_held_out_languages(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_decoding_by_hand():
    """The nearest codeword by weighted losses, its share and lead, bit by bit."""
    rng = np.random.default_rng(5)
    texts = [t.encode() for t in ("das haus ist gross und der hund", "the house is big and the dog", "la maison est grande et le chien", "x", "")]
    codes = language_id.codebook(5)
    trust = rng.random(codes.shape)
    m = language_id.Model(list("abcde"), codes, trust / trust.sum(1, keepdims=True), rng.normal(0, 3, (language_id.DIM, codes.shape[1])).astype(np.float32), rng.normal(size=codes.shape[1]).astype(np.float32))
    x = language_id.grams(texts)
    best, share, lead = language_id.decode(m, x)
    for i in range(len(texts)):
        loss = []
        for lang in range(5):
            f = [float(x[i].astype(float) @ m.weights[:, b].astype(float)) + float(m.bias[b]) for b in range(codes.shape[1])]
            loss.append(sum(m.trust[lang, b] * np.log1p(np.exp(-codes[lang, b] * f[b])) for b in range(codes.shape[1])))
        p = np.exp((min(loss) - np.array(loss)) * codes.shape[1])
        p /= p.sum()
        assert best[i] == int(np.argmin(loss)) and abs(share[i] - p.max()) < 1e-4 and abs(lead[i] - (np.sort(p)[-1] - np.sort(p)[-2])) < 1e-4


def test_predictions_are_those_of_the_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language_id.train(docs, ~queries.remainder_is(4, 2))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op1_language_id(spark, SF).collect():
        t = texts[r["doc_id"]]
        if not t or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            continue
        best, share, lead = language_id.decode(m, language_id.grams([t.encode()]))
        assert r["lang_pred"] == m.langs[best[0]] and abs(r["score"] - share[0]) < 1e-4 and r["ambiguous"] == (lead[0] < 0.2)


def test_long_texts(spark, docs):
    """Texts of megabytes, whole, beside short ones, in every operator on texts."""
    long = " ".join(f"w{i % 5000} the" for i in range(150_000))
    df = docs([long, "short text here", None, long + " end"], langs=["en"] * 4)
    assert language_id.identify(df, language_id.train(df, F.lit(True))).count() == 4
    scored = {r["doc_id"]: r["n_tokens"] for r in lm_scoring.train_and_score(df, F.lit(True)).collect()}
    assert scored == {0: 300_001, 1: 4, 2: 1, 3: 300_002}
    gone = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(df).collect()}
    assert gone == {0: (300_000, 300_000), 1: (3, 0), 2: (0, 0), 3: (300_001, 300_000)}
    bench = spark.createDataFrame([(1, " ".join(f"w{i} the" for i in range(4980, 5000)) + " w0 the w1 the end")], "item_id long, text string")
    found = decontamination.contaminated(df, bench).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 3] and all(r["similarity"] >= 0.8 for r in found)
    assert toxicity.score(df, toxicity.Model()).count() == 4


def test_language_edges(docs):
    df = docs([None, "", "12 34 !!", "ein haus", "a house", "das haus ist", "the house is"], langs=[None, "de", "de", "de", "en", "de", "en"])
    m = language_id.train(df, F.lit(True))
    rows = {r["doc_id"]: r for r in language_id.identify(df, m).collect()}
    assert [rows[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and rows[0]["score"] == 0 and rows[0]["ambiguous"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    one = language_id.train(df.where("lang = 'de'"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(df, one).collect()} == {"und", "de"}
    nothing = language_id.train(df.where("lang = 'xx'"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(df, nothing).collect()} == {"und"}
    kept = language_id.known_language(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    unlabelled = language_id.known_language(docs(["a", "1 2", None]))
    assert [r["doc_id"] for r in unlabelled.collect()] == [0]
    assert language_id.identify(docs([]), m).count() == 0


# --- language model ----------------------------------------------------------------------------


def test_base_scores_and_proper_model(spark):
    rows = {r["doc_id"]: r for r in queries.op2_lm_scoring(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", queries.remainder_is(5, 1)).collect()
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [None]
    c = Counter(w for r in table if not r["held"] for w in low(r["text"]))
    n, v = sum(c.values()), len(c)
    for r in table:
        own = low(r["text"])
        got = rows[r["doc_id"]]
        assert (got["held_out"], got["n_tokens"], got["n_known"], got["train_tokens"]) == (r["held"], len(own), sum(w in c for w in own), n)
        assert abs(got["base_score"] - sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-6 * len(own)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_unit_probabilities_add_up():
    rng = np.random.default_rng(0)
    u = lm_scoring.UNITS
    runs, last = rng.integers(0, u**3, 5000), rng.integers(0, 49, u)
    units = lm_scoring.train(runs, np.bincount(runs % u, minlength=u), last, steps=20)
    assert sorted(units.place) == list(range(u))
    every = np.arange(u)
    for one, two in rng.integers(0, u, (5, 2)):
        assert abs((10 ** units.logs(every, np.full(u, one), np.full(u, two))).sum() - 1) < 1e-4


def test_pairs_of_words_are_learned():
    """Words that follow one another get far more than their share of all tokens."""
    rng = np.random.default_rng(1)
    u = lm_scoring.UNITS
    one = rng.integers(0, 40, 20_000)
    w = np.where(rng.random(20_000) < 0.9, (one * 7 + 3) % 40, rng.integers(0, 40, 20_000))
    runs = (rng.integers(0, 40, 20_000) * u + one) * u + w
    units = lm_scoring.train(runs, np.bincount(w, minlength=u), np.arange(u) % 49)
    own = np.arange(40)
    follows = 10 ** units.logs((own * 7 + 3) % 40, own, own)
    assert np.median(follows) > 0.5


def _by_columns(params, squares, drawn, shares, rng, rate, noise, few):
    """The step of NCE example by example: rows are gathered, and gradients added up column by column."""
    near, far, c1, c2, group, group_bias, unit, unit_bias = params
    n, u, slots, groups = len(drawn), lm_scoring.UNITS, lm_scoring.SLOTS, lm_scoring.GROUPS
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    sums = lambda rows, x, m: np.stack([np.bincount(rows, x[:, j], m) for j in range(x.shape[1])], 1)
    drawn = drawn[np.argsort(shares.place[drawn % u] // slots, kind="stable")]
    w, one, two = shares.place[drawn % u], drawn // u % u, drawn // u**2
    g = w // slots
    q = near[one] @ c1 + far[two] @ c2
    fake = np.repeat(np.arange(groups), shares.groups(rng))
    extra = np.log(noise * shares.group_share).astype(np.float32)
    real = -sig(-((q * group[g]).sum(1) + group_bias[g] - extra[g])) / n
    false = sig(q @ group[fake].T + group_bias[fake] - extra[fake]) * np.float32(noise / groups / n)
    dq = real[:, None] * group[g] + false @ group[fake]
    d_group = sums(g, real[:, None] * q, groups) + sums(fake, false.T @ q, groups)
    d_group_bias = np.bincount(g, real, groups) + np.bincount(fake, false.sum(0), groups)
    wrong = shares.slots(g, few, rng).T + (g * slots)[:, None]
    extra = np.log(few * shares.unit_share).astype(np.float32)
    real = -sig(-((q * unit[w]).sum(1) + unit_bias[w] - extra[w])) / n
    false = sig(np.einsum("bd,bfd->bf", q, unit[wrong]) + unit_bias[wrong] - extra[wrong]) / n
    dq += real[:, None] * unit[w] + np.einsum("bf,bfd->bd", false, unit[wrong])
    rows = np.concatenate([w, wrong.ravel()])
    d_unit = sums(rows, np.concatenate([real[:, None] * q, (false[:, :, None] * q[:, None]).reshape(-1, q.shape[1])]), u)
    d_unit_bias = np.bincount(rows, np.concatenate([real, false.ravel()]), u)
    grads = [sums(one, dq @ c1.T, u), sums(two, dq @ c2.T, u), near[one].T @ dq, far[two].T @ dq, d_group, d_group_bias, d_unit, d_unit_bias]
    for p, d, sq in zip(params, grads, squares, strict=True):
        sq *= np.float32(0.99)
        d = d.astype(np.float32)
        sq += np.float32(0.01) * d**2
        p -= np.float32(rate) * d / (np.sqrt(sq) + np.float32(1e-7))


def _skewed():
    rng = np.random.default_rng(4)
    u = lm_scoring.UNITS
    drawn = rng.choice(u, (3, 20_000), p=(x := 1 / np.arange(1, u + 1)) / x.sum())
    shares = lm_scoring.noise_of(np.bincount(drawn[2], minlength=u), rng.integers(0, 49, u))
    return (drawn[0] * u + drawn[1]) * u + drawn[2], shares


def test_steps_are_dense_products():
    """A step does what gathering and adding up by columns does, in clearly less CPU time."""
    lm_scoring.keep_freed()
    runs, shares = _skewed()
    ways = [(step, rng := np.random.default_rng(6), *lm_scoring.started(shares, rng, 16)) for step in (lm_scoring.stepped, _by_columns)]
    took = []
    for k in range(40):
        for step, rng, params, squares in ways:
            drawn = runs[rng.integers(0, len(runs), 4096)]
            t = time.thread_time()
            step(params, squares, drawn, shares, rng, 0.02, 24, 4)
            took.append(time.thread_time() - t)
        if k < 3:
            for a, b in zip(*([*w[2], *w[3]] for w in ways), strict=True):
                # A unit whose gradient is next to nothing takes a whole step on the sign of a rounding error.
                assert np.mean(np.abs(a - b) > 1e-4 + 1e-3 * np.abs(b)) < 1e-3
    assert min(took[::2]) < 0.75 * min(took[1::2]) or np.median(took[::2]) < 0.75 * np.median(took[1::2])


def test_noise_is_drawn_by_shares():
    """The alias tables stand for the units' shares of their groups, to rounding; draws stay within them."""
    _, shares = _skewed()
    size = (lm_scoring.GROUPS, lm_scoring.SLOTS)
    stays, other, want = (x.reshape(size) for x in (shares.stays, shares.other, shares.unit_share))
    for own, to, share in zip(stays, other, want, strict=True):
        assert np.allclose((own + np.bincount(to, 1 - own, len(own))) / len(own), share, rtol=1e-9, atol=1e-13)
    g = np.repeat([0, 5], 50_000)
    drawn = shares.slots(g, 4, np.random.default_rng(2))
    for k in (0, 5):
        assert np.abs(np.bincount(drawn[:, g == k].ravel(), minlength=size[1]) / 200_000 - want[k]).max() < 0.005


@pytest.mark.parametrize("scale", [0.3, 10, 100])
def test_logs_of_any_size(scale):
    """Probabilities by blocks are those of single rows in double precision, where exponentials don't fit 32 bits too."""
    _, shares = _skewed()
    rng = np.random.default_rng(7)
    params, _ = lm_scoring.started(shares, rng, 16)
    m = lm_scoring.fitted([p * np.float32(scale / 0.3) if p.ndim == 2 and len(p) > 16 else p for p in params], shares)
    w, one, two = rng.integers(0, lm_scoring.UNITS, (3, 500))
    got = m.logs(w, one, two)
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for a, b, c, x in zip(w, one, two, got, strict=True):
        q = m.near[b].astype(float) @ m.mix[0] + m.far[c].astype(float) @ m.mix[1]
        g, slot = divmod(int(m.place[a]), lm_scoring.SLOTS)
        of = slice(g * lm_scoring.SLOTS, (g + 1) * lm_scoring.SLOTS)
        want = (soft(m.group @ q + m.group_bias)[g] + soft(m.unit[of] @ q + m.unit_bias[of])[slot]) / np.log(10)
        assert abs(x - want) < 1e-5 * max(1, abs(want))


def test_every_token_is_learned_from(docs):
    """Runs are those of all tokens, and models that tasks learn from parts of them make one."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 40, 30)) for _ in range(200)] + [None, "", "only once"]
    df = docs(texts).repartition(5)
    top = {int(h): k for k, h in enumerate(lm_scoring._hashes([f"w{v}".encode() for v in range(40)]))}
    want = Counter()
    for t in texts:
        k = [lm_scoring.END, lm_scoring.END, *lm_scoring.units_of(x := [w.encode() for w in words(t)] + [b""], top, lm_scoring._hashes(x)).tolist()]
        want.update((a * lm_scoring.UNITS + b) * lm_scoring.UNITS + c for a, b, c in zip(k, k[1:], k[2:], strict=False))
    cells = lm_scoring.coded(df, top)
    assert Counter(lm_scoring.runs_of([r["units"] for r in cells.collect()]).tolist()) == want
    pairs = docs([" ".join(f"w{(3 * v + i) % 40} w{(3 * v + i) % 40 + 40}" for i in range(30)) for v in range(400)]).repartition(3)
    model, _ = lm_scoring.fit(pairs, local=0, part=8000, batch=64)
    unit = lambda w: model.top[int(lm_scoring._hashes([w.encode()])[0])]
    one = np.array([unit(f"w{v}") for v in range(40)])
    assert np.median(10 ** model.units.logs(np.array([unit(f"w{v + 40}") for v in range(40)]), one, one)) > 0.05


def test_scores_by_hand(spark):
    """Every score of held-out rows from the model's numbers, token by token."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model, counts = lm_scoring.fit(table.where(~queries.remainder_is(5, 1)), steps=60)
    rows = table.where(queries.remainder_is(5, 1)).limit(12)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(rows, model, counts).collect()}
    low = lambda t: [re.sub(b"[A-Z]", lambda m: m[0].lower(), w.encode()) for w in words(t)] + [b""]
    texts = {r["doc_id"]: low(r["text"]) for r in rows.collect()}
    c = Counter(w for r in table.where(~queries.remainder_is(5, 1)).collect() for w in low(r["text"]))
    ids = dict(zip(c, lm_scoring._hashes(list(c)).tolist(), strict=True))
    unit = lambda w: model.top.get(int(lm_scoring._hashes([w])[0]), lm_scoring.END if not w else lm_scoring.tail_class(w[-1]))
    n, v = Counter(), Counter()
    for w, k in c.items():
        if w and ids[w] not in model.top:
            n[unit(w)] += k
            v[unit(w)] += 1
    assert n and len(model.top) == lm_scoring.TOP
    m = model.units
    soft = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    for d, tokens in texts.items():
        total, one, two = 0.0, lm_scoring.END, lm_scoring.END
        for w in tokens:
            u = unit(w)
            q = m.near[one] @ m.mix[0] + m.far[two] @ m.mix[1]
            g, slot = divmod(int(m.place[u]), lm_scoring.SLOTS)
            of = slice(g * lm_scoring.SLOTS, (g + 1) * lm_scoring.SLOTS)
            total += (soft(m.group @ q + m.group_bias)[g] + soft(m.unit[of] @ q + m.unit_bias[of])[slot]) / np.log(10)
            if u > lm_scoring.END:
                total += np.log10((c[w] + 0.5) / (n[u] + 0.5 * (v[u] + 1)))
            one, two = u, one
        assert abs(got[d] - total) < 1e-3 * len(tokens), d


def test_rare_words_are_looked_up(spark, docs, monkeypatch):
    """Scores don't depend on how many words are in the broadcast head, nor on partitions."""
    df = docs(["a b c a b a", "a b zz", None, "", "q " * 50, "A B\tC"])
    monkeypatch.setattr(lm_scoring, "HEAD", 1000)
    one = lm_scoring.train_and_score(df, F.col("doc_id") != 1).orderBy("doc_id").toPandas()
    model, counts = lm_scoring.fit(df.where("doc_id != 1"))
    keep = np.isin(model.head, list(model.top)[:2])
    model.head, model.head_logs = model.head[keep], model.head_logs[keep]
    two = lm_scoring.score(df.repartition(3), model, counts).orderBy("doc_id").toPandas()
    assert np.allclose(one.base_score, two.base_score) and (one.n_known == two.n_known).all()
    assert lm_scoring.train_and_score(df, F.lit(False)).agg(F.sum("n_known")).first()[0] == 0
    assert lm_scoring.train_and_score(docs([]), F.lit(True)).count() == 0


# --- toxicity -------------------------------------------------------------------------------------


def test_pairs_are_learned():
    """Neither word alone tells; the two together do."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        rows.append(" ".join([f"n{rng.integers(30)}" for _ in range(5)] + ["insult"] * int(a) + ["group"] * int(b)).encode())
        y.append(float(a and b))
    terms, offsets = toxicity.terms_of(rows)
    m = toxicity.fit(terms, offsets, np.array(y), epochs=25)
    p = toxicity.sigmoid(toxicity.logits(m, terms, offsets))
    assert ((p >= 0.5) == np.array(y, bool)).mean() > 0.97


def test_logits_against_all_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.Model(np.arange(5, dtype=np.uint64), 0.3, rng.normal(size=6).astype(np.float32), rng.normal(size=(6, 4)).astype(np.float32))
    m.weight[5] = m.factors[5] = 0
    sets = [[0, 2, 4], [], [3], [1, 2, 9]]
    got = toxicity.logits(m, np.array([t for s in sets for t in s], np.uint64), np.cumsum([0, *map(len, sets)]))
    for s, z in zip(sets, got, strict=True):
        own = [t for t in s if t < 5]
        want = 0.3 + sum(m.weight[t] for t in own) + sum(m.factors[a] @ m.factors[b] for k, a in enumerate(own) for b in own[:k])
        assert abs(z - want) < 1e-5


def test_exclusive_or_is_learned():
    """Neither word tells anything alone: an additive model can't, pairs can."""
    rng = np.random.default_rng(2)

    def rows(n):
        a, b = rng.integers(0, 2, (2, n))
        noise = [" ".join(f"n{k}" for k in rng.integers(0, 400, 20)) for _ in range(n)]
        return [f"{w} {'insult' if i else ''} {'people' if j else ''}".encode() for w, i, j in zip(noise, a, b, strict=True)], (a ^ b).astype(float)

    texts, y = rows(3000)
    m = toxicity.fit(*toxicity.terms_of(texts), y)
    others, truth = rows(1000)
    held = toxicity.terms_of(others)
    right = lambda m: ((toxicity.sigmoid(toxicity.logits(m, *held)) >= 0.5) == truth).mean()
    assert right(m) > 0.95
    alone = toxicity.fit(*toxicity.terms_of(texts), y, rank=0)
    assert right(alone) < 0.8


def test_pair_gaps_against_counts():
    rng = np.random.default_rng(3)
    held = rng.random((500, 7)) < 0.4
    y = (held[:, 0] ^ held[:, 1]).astype(float)
    row, ids = np.nonzero(held)
    got = toxicity.pair_gaps(ids, row, y, 7)
    odds = lambda x: np.log((x.sum() + 0.5) / ((1 - x).sum() + 0.5))
    want = np.zeros(7)
    for i in range(7):
        for j in range(7):
            both = held[:, i] & held[:, j]
            if i == j or both.sum() >= 0.9 * min(held[:, i].sum(), held[:, j].sum()):
                continue
            p = 1 / (1 + np.exp(-(odds(y[held[:, i]]) + odds(y[held[:, j]]) - odds(y))))
            want[i] = max(want[i], abs(y[both].sum() - both.sum() * p) / np.sqrt(both.sum() * p * (1 - p) + 1))
    assert np.allclose(got, want, rtol=1e-4)
    assert got[:2].min() > 6 > got[2:].max()


def test_scores_of_the_query_by_hand(spark):
    """Every row's score from the model's numbers, term by term and pair by pair."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"), ~queries.remainder_is(3, 1))
    own = {int(t): k for k, t in enumerate(m.terms)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op10_toxicity(spark, d).collect():
        terms, _ = toxicity.terms_of([(texts[r["doc_id"]] or "").encode()])
        k = [own[t] for t in terms.tolist() if t in own]
        z = m.bias + sum(float(m.weight[i]) for i in k) + sum(float(m.factors[i] @ m.factors[j]) for n, i in enumerate(k) for j in k[:n])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-4 and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op10_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / got.predicted.sum() > 0.95 and hit.sum() / got.toxic.sum() > 0.8


def test_toxicity_edges(spark, docs):
    df = docs([None, "", "x " * 5, "x"])
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.train(df, labels, F.lit(True))
    got = toxicity.score(df, m).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.score(docs([]), m).count() == 0
