import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import Capacity
from tidemark.llm.scratch import Scratch

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ENCODER = packing.WordEncoder(PATH, most=200)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \t\n\x0b\x1c\x85\xa0　é́İΣ'<|>"), max_size=40) | st.sampled_from(["<|endoftext|> a", "it's Don'T", "e ́x"]), max_size=4))
def test_words_give_the_ids_of_the_whole_text(texts):
    ids, bounds = ENCODER.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == WHOLE.encode(t, add_special_tokens=False).ids


def check(rows, found, tokens):
    pieces = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found if r.doc_id is not None)
    wanted = []
    for i, t in rows:
        if i is None:
            continue
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), tokens)):
            part = np.array(ids[a : a + tokens], "<u4")
            wanted.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    assert pieces == sorted(wanted)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        content.sort()
        assert [o for o, _ in content] == [sum(n for _, n in content[:k]) for k in range(len(content))]
        assert sum(n for _, n in content) <= tokens
    return bins


def test_round_trip(spark):
    rng = random.Random(4)
    words = ["the", "Tiger", "naïve", "x1234", "don't", "—", "語"]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for n in range(60)]
    rows += [(60, None), (61, ""), (61, ""), (None, "a b"), (62, "w " * 2047), (63, "w " * 2048)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "'x' as g")
    found = packing.pack(docs, Scratch(spark, "t"), PATH).collect()
    bins = check(rows, found, 2048)
    total = sum(r.length for r in found)
    assert len(bins) <= -(-total // 2048) * 1.1 + 1
    assert packing.pack(docs.limit(0), Scratch(spark, "t"), PATH).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    capacity = Capacity(tokens=128, documents=4, attention=9000, weights=(1.0, 0.3, 0.5), rule=rule)
    chosen = packing.best_fit(lengths, capacity)
    for b in np.unique(chosen):
        own = lengths[chosen == b]
        assert own.sum() <= 128 and len(own) <= 4
        assert (own**2).sum() <= 9000 or len(own) == 1
    floor = max(lengths.sum() / 128, len(lengths) / 4, (lengths**2).sum() / 9000)
    assert chosen.max() + 1 <= 1.25 * floor


def test_best_fit_is_close_to_the_token_floor():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.lognormal(6.3, 0.9, 4000).astype(int) + 2, 2048)
    chosen = packing.best_fit(lengths, Capacity())
    assert chosen.max() + 1 <= 1.02 * lengths.sum() / 2048 + 1
