import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnfield.llm import packing, words


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), st.text()), max_size=5))
def test_words_are_runs_of_other_bytes(texts):
    import re

    raw = [None if t is None else t.encode() for t in texts]
    codes, offsets, distinct = words.encode(raw)
    for i, t in enumerate(raw):
        assert [distinct[c] for c in codes[offsets[i] : offsets[i + 1]]] == re.findall(rb"[^\x20\x09-\x0D]+", t or b"")


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c"], "k": [1, 2, 3, 4, 5]})
    parts = list(words.chunks(iter([batch]), "text", 20))
    assert [k for b, _ in parts for k in b.column("k").to_pylist()] == [1, 2, 3, 4, 5]
    assert [len(t or b"") for _, ts in parts for t in ts] == [10, 0, 100, 0, 1]
    assert len(parts) == 3


def test_ids_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.encoder(packing.vocabulary())
    rng = np.random.default_rng(0)
    odd = ["", " ", "  a  b\n\n c\t", "don't we'll I'M", "x" * 3000, "日本語 ½ é \u00a0 \u200b 🎉👩‍👧", "<|endoftext|> a", "a <|endoftext|><|endoftext|>\n b<|endoftext|", "1234567 3.14", "\r\n\r\n  end ", "".join(map(chr, rng.integers(1, 0xD7FF, 3000)))]
    for text in odd:
        assert e(text) == t.encode(text, add_special_tokens=False).ids, repr(text[:40])


def check_packed(rows, want, length):
    """want: doc -> ids. Every id lies in one piece, sequences are gapless, all but the last are full."""
    for doc, ids in want.items():
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["length"] == len(part) > 0 and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
        assert sum(r["length"] for r in own) == len(ids)
    last = max(r["sequence_id"] for r in rows)
    for s in range(last + 1):
        own = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist()
        assert sum(r["length"] for r in own) == length or s == last


def test_pack_round_trip(docs):
    texts = ["one two three", None, "", "word " * 900, "é" * 50, "one two three", "a<|endoftext|>b", "long text " * 60_000]
    e = packing.encoder(packing.vocabulary())
    want = {i: [*(e(t) if t else ()), 0] for i, t in enumerate(texts)}
    for parts in (1, 3):
        rows = packing.pack(docs(texts).repartition(parts), 64).collect()
        check_packed(rows, want, 64)
    several = packing.pack(docs(texts).repartition(3), 64, max_parts=1).collect()
    check_packed(several, want, 64)
    assert packing.pack(docs([])).count() == 0
    assert packing.pack(docs(["a", "a"], [None, None])).count() == 2


def test_texts_that_are_not_utf8(spark):
    """Broken bytes count as replacement characters; nothing fails."""
    from pyspark.sql import functions as F

    from cairnfield.llm import language_id, near_dedup, substring_dedup, toxicity

    df = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("cast(unhex('61FF6220C3') as string)").alias("text"), F.lit("en").alias("lang"))
    assert packing.pack(df).count() == 3
    assert near_dedup.near_duplicates(df).select("component_id").distinct().count() == 1
    assert substring_dedup.dedup(df).count() == 3
    assert language_id.identify(df, language_id.train(df, F.lit(True))).first()["lang_pred"] == "en"
    assert toxicity.score(df, toxicity.Model()).count() == 3
