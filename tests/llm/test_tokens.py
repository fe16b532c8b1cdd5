"""SentencePiece codec and token counts against the library."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from brevia.llm import piece_bpe, sentencepiece_codec, token_counts

ODD = [None, "", " ", "  a", "\n", "a" * 3000, " " * 500, "▁", "▁ ▁x", "<s>", "</s><unk>", "<0x0A>", "日本語" * 300, "😀é\x00b", "l'été.\nThe U.S. e.g. x², ¼", "word " * 20000]


def fuzz(n=1500):
    rnd = random.Random(5)
    alphabet = "ab \n\t▁  éü中文字😀\x00theingion.,!|%ABC1²"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_exact(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ODD + fuzz()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    ids = {r.doc_id: r.ids for r in sentencepiece_codec.encode(df, model).collect()}
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df, model), model).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(df, model, limit=100).collect()}
    for k, t in enumerate(texts):
        expected = sp.encode(t or "", add_bos=True, add_eos=True)
        assert ids[k] == expected, t
        assert back[k] == sp.decode(expected), t
        assert counts[k].n_tokens == len(expected) - 2 and counts[k].n_bytes == len((t or "").encode()), t
        assert counts[k].over_limit == (len(expected) - 2 > 100)


def test_registered_queries(spark, sf, model):
    """op2 and op6 over their whole table against the library."""
    from hashlib import sha256

    import numpy as np

    from brevia.llm import queries

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {k: sp.encode(t, add_bos=True, add_eos=True) for k, t in texts.items()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_sentencepiece(spark, sf).collect()}
    assert got == {k: (len(x), sha256(np.array(x, "<u4").tobytes()).hexdigest(), sha256(sp.decode(x).encode()).hexdigest()) for k, x in ids.items()}
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_token_counts(spark, sf).collect()}
    assert got == {k: (len(texts[k].encode()), len(x) - 2, len(x) - 2 > 4096) for k, x in ids.items()}


def test_prefix_table_is_bpe(model):
    """The table against merging by the definition."""
    m = piece_bpe.Model(open(model, "rb").read())
    for t in fuzz(400):
        for u in m.split(t):
            if all(c in m.ids for c in u):
                assert m.encode_unit(u) == b"".join(m.code[i] for i in m.merged(u))


def test_small_caches_change_nothing(model):
    blob = open(model, "rb").read()
    a, b = piece_bpe.Model(blob), piece_bpe.Model(blob, cached_units=3, cached_pairs=3)
    for t in fuzz(100):
        assert a.encode(t) == b.encode(t)


def test_rows_stay(spark, model):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert sentencepiece_codec.digests(df, model).count() == 3
    assert token_counts.count_tokens(df, model).count() == 3
    empty = df.where(F.lit(False))
    assert sentencepiece_codec.digests(empty, model).count() == 0
    assert token_counts.count_tokens(empty, model).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        piece_bpe.Model(b"not a model")
