import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.bpe import WordBpe, bpe_round_trip, op3_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    library = Tokenizer.from_str(text)
    library.no_truncation()
    library.no_padding()
    return WordBpe(text), library


def same(both, text):
    own, library = both
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_fixed_texts(both):
    for t in ("", " ", "Hello  World's <|endoftext|>\nx", "<|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ İstanbul", "a" * 3000, "!?!?!?...", "é é", "日本語 ０１２ ½ ²", "I'll we've they're it's", "\u0085\x1c​"):
        same(both, t)


def test_random_texts(both):
    r = random.Random(2)
    for _ in range(3000):
        same(both, "".join(r.choice("abcdeaaathing 'sSΣİéß\n\t　你🙂12!?.<|>") for _ in range(r.randint(0, 40))))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_greedy_merging_by_hand(both):
    """The backtracking encoder gives what merging by rank, pair by pair, gives."""
    own, _ = both
    r = random.Random(4)
    for _ in range(1500):
        word = "".join(r.choice("thereingandaabb") for _ in range(r.randint(1, 14)))
        parts = [own.vocab[c] for c in word[:-1]] + [own.vocab[word[-1] + "</w>"]]
        names = {i: t for t, i in own.vocab.items()}
        while True:
            pairs = [(own.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 1 << 30:
                break
            _, i = min(pairs)
            parts[i:i + 2] = [own.vocab[names[parts[i]] + names[parts[i + 1]]]]
        assert list(own.encode_word(word)) == parts


def test_odd_rows(odd_docs, no_docs, both):
    _, library = both
    out = bpe_round_trip(odd_docs, PATH)
    assert [c for c in odd_docs.columns if c not in out.columns] == [] and out.count() == odd_docs.count()
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe_round_trip(no_docs, PATH).count() == 0


def test_query_against_the_library(spark, sf, both):
    _, library = both
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
