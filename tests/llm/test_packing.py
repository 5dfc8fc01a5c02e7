import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from astroloom.llm import packing
from astroloom.llm.packing import Example, Limits, Packer

SCHEMA = "doc_id long, text string, start long, length long"


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts):
    """The exact round trip: every id in one piece, sequences gapless and within the limits."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # full or a power of two


def test_corpus_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(packing.op5_packing(spark, small).collect(), {r.doc_id: r.text for r in docs.collect()})


ODD = [None, "", " ", "a", "a  b", "a \n b", "b\n \nc", "b\n\n c", " lead", "trail ", "x\n", "tab\tx y", "nbsp x y", "it's  we'll", "<|endoftext|> x", "é ñ 日本 語", "a" * 5000, "wo " * 30000]


def test_odd_texts(spark):
    check(packing.pack_documents(spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(ODD)], SCHEMA)).collect(), dict(enumerate(ODD)))


def test_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, "a b", 0, 0), (1, "a b", 0, 0), (None, "c", 0, 0)], SCHEMA)
    assert packing.pack_documents(frame.limit(0)).count() == 0
    assert sorted((r.doc_id is None, r.length) for r in packing.pack_documents(frame.coalesce(1)).collect())[-1][0]


def test_pieces_match_the_tokenizer_at_random():
    rng, pieces = random.Random(5), packing.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", " ", "\n", "é", "1", ".", "'s", "\t", "!!", "Ñ"]) for _ in range(rng.randint(0, 25)))
        assert list(np.frombuffer(pieces.packed(text), dtype="<u4")) == ids_of(text)[:-1], repr(text)


@pytest.mark.parametrize("seed", range(4))
def test_limits_hold_together(seed):
    rng, limits = random.Random(seed), Limits(tokens=32, segments=3, loss_tokens=12, waiting=8)
    packer, made = Packer(limits), []
    examples = [Example(k, n, np.array([rng.random() < 0.5 for _ in range(n)])) for k, n in enumerate(rng.choices(range(1, 60), k=60))]
    for x in examples:
        made += packer.add(x)
    made += packer.finish()
    use, seen = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for x, start, n, sequence, _ in made:
        use[sequence] = [a + b for a, b in zip(use[sequence], (n, 1, int(x.loss[start : start + n].sum())))]
        seen[x.key] += range(start, start + n)
    assert all(a <= 32 and b <= 3 and c <= 12 for a, b, c in use.values())
    assert all(sorted(seen[x.key]) == list(range(x.tokens)) for x in examples)


def test_examples_on_spark(spark):
    frame = spark.createDataFrame([(1, [True, False, True]), (2, []), (3, None), (4, [False] * 5000)], "example_id long, loss array<boolean>")
    out = packing.pack_examples(frame, Limits(loss_tokens=1)).collect()
    assert {k: sum(r.length for r in out if r.example_id == k) for k in (1, 2, 3, 4)} == {1: 3, 2: 0, 3: 0, 4: 5000}
