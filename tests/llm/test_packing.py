import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import packing


def test_the_encoder_agrees_with_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Encoder(packing.default_vocabulary(), public_tokenizers.PATTERN)
    texts = ["", " ", "a", "a b", " a  b ", "a\n b\n\nc", "it's 12 o'clock…", "x" * 500, "  y", "tab\t z", "日本 語", "end "]
    for text in texts:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_in_texts_have_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Encoder(packing.default_vocabulary(), public_tokenizers.PATTERN)
    for text in ["a <|endoftext|>b", "<|endoftext|>", "a<|endoftext|> b  c", "x  <|endoftext|><|endoftext|>\n y", "<|endoftext", " <|endoftext|> "]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    window = 32
    h = rng.integers(0, (3, 50, 1, 400)[seed], window) * (rng.random(window) < 0.6)
    h[0] = 7
    p = packing.plan(h, window, slack=1)
    seen = {}
    for length in range(1, window):
        for rank in range(int(h[length])):
            for start, n, seq, offset in packing.pieces_of(length, length, rank, 0, p, 10**9, window):
                for k in range(n):
                    assert offset + k < window and (seq, offset + k) not in seen
                    seen[seq, offset + k] = 1
    total = int((h * np.arange(window)).sum())
    assert len(seen) == total
    sequences = {s for s, _ in seen}
    assert len(sequences) * window - total <= len(sequences) + window


def test_pack_covers_all_texts_with_repeats_nulls_and_extra_columns(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "y"), (2, None, "z"), (3, "", "z"), (None, "word " * 3000, "z"), (4, "a b c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = packing.pack(docs).withColumn("crc", F.crc32("ids")).toPandas()
    assert got.length.sum() == got.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens.sum() + 3 + 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert all(zlib.crc32(bytes(i)) == c for i, c in zip(got.ids, got.crc))
    assert got[got.doc_id.isna()].length.sum() == got[got.doc_id.isna()].doc_tokens.iloc[0]
    assert packing.pack(docs.limit(0)).count() == 0
