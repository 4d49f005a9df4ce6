import zlib
from collections import defaultdict

import numpy as np
import pytest
from pagewright.llm import packing


def check(rows, texts, capacity, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : at], "<u4").tobytes())
        assert at == len(ids[d])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= limit * sum(map(len, ids.values())) + capacity


@pytest.mark.parametrize("fan_in", [packing.FAN_IN, 2])
def test_whole_table(spark, sf_dir, monkeypatch, fan_in):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.pack(docs.repartition(7)).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048, 0.02)


def test_edges(spark):
    texts = ["", None, " ", "  a  b ", "a\n\n b\t\tc  \n", "x<|endoftext|> y  <|endoftext|>", "a  b  c", " \x1c a", "it's I'll   don't", "word " * 30_000, "日本語 テキスト 🙂  🙂", "1 22  333", "a" + " " * 5000 + "b", "\n" * 2_000_000 + "x", "ab1" * 50_000, "\u1680x\u2028 y\u00a0\u3000 1\u0660\u00b2 \U0001f600\u0301é"]
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check(packing.pack(docs).collect(), [r[:2] for r in rows], 2048, 1)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(docs.unionByName(docs))
    assert twice.where("doc_id = 0").count() == 2
    assert packing.pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first().doc_id is None


def test_ranks_give_the_same_ids():
    """Every code point between letters, digits, signs and blanks."""
    from tokenizers import Tokenizer

    own, theirs = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    assert own.ranks is not None
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}.  {chr(c)}  {chr(c)}{chr(c)}x " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, want in zip(texts, theirs.encode_batch_fast(texts, add_special_tokens=False)):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == want.ids


def test_other_vocabularies_keep_their_tokenizer():
    import public_tokenizers

    assert packing.Encoder(public_tokenizers.path("word_bpe_49k.json")).ranks is None
