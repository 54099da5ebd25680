import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tesserae.llm import bpe
from tesserae.llm.catalog import LLM_QUERIES
from tesserae.llm.common import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def t():
    return bpe.transducer(PATH)


def same(t, text):
    want = LIB.encode(text, add_special_tokens=False).ids
    ids = t.encode(text)
    assert ids == want
    assert t.decode(ids) == "".join(t.decode_stream(ids)) == LIB.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    same(bpe.transducer(PATH), text)


@pytest.mark.parametrize("text", ["", "ΑΣ ΣΑΣ", "İstanbul", "it's we'LL", "<|endoftext|>a<|startoftext|>", "\x1c\x1d a\x85b", "ﬁ ½ Ⅳ", "é é"])
def test_corners(t, text):
    same(t, text)


def test_long_pieces_stream(t):
    rng = random.Random(4)
    for text in ("a" * 9000, "".join(rng.choice("abcde") for _ in range(20_000)), "ha" * 6000, "=" * 5000 + "!?" * 3000):
        same(t, text)


def test_stable_tokens_come_before_the_end(t):
    read = []

    def blocks():
        for _ in range(40):
            read.append(1)
            yield b"abcde" * 200

    stream = t.stream(blocks())
    next(stream)
    assert len(read) < 10
    rest = list(stream)
    assert len(read) == 40 and rest


def in_blocks(t, text, sizes, seed=0):
    """Ids of text fed in blocks of random sizes, and the most that was held."""
    rng, e, ids, most, at = random.Random(seed), bpe.Encoder(t), [], 0, 0
    while at < len(text):
        n = rng.choice(sizes)
        ids += e.feed(text[at : at + n])
        most, at = max(most, e.size), at + n
    return ids + e.close(), most


PARTS = st.sampled_from(["word ", "it's", "'r", "'", "e", "'ll", "<|endoftext|>", "<|end", "oftext|>", "e\u0301", "\u0301", "\u1100\u1161\u11a8", "\u0995\u09c7\u09be", "12", "!?", "\n", "\u3000", "ΑΣ", "漢字", "x" * 30])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40), st.integers(0, 5))
def test_blocks_of_any_size(parts, seed):
    t, text = bpe.transducer(PATH), "".join(parts)
    whole = bpe.BLOCK, bpe.LONG
    try:
        bpe.BLOCK, bpe.LONG = 24, 8  # cuts without white space and open runs
        assert in_blocks(t, text, (1, 5, 17), seed)[0] == LIB.encode(text, add_special_tokens=False).ids
    finally:
        bpe.BLOCK, bpe.LONG = whole


def test_held_state_is_bounded_on_50_mb(t):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéñ漢") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    prose = " ".join(rng.choice(words) for _ in range(40_000)) + " "
    e, fed, most, n = bpe.Encoder(t), 0, 0, 0
    while fed < 50_000_000:
        for i in range(0, len(prose), 50_000):
            n += len(e.feed(prose[i : i + 50_000]))
            most = max(most, e.size)
        fed += len(prose.encode())
    assert most <= 2 * bpe.BLOCK and n > 0
    for block in ("ab" * 25_000, "=" * 50_000, "漢字" * 25_000):
        e, most = bpe.Encoder(t), 0
        for _ in range(12):
            e.feed(block)
            most = max(most, e.size)
        assert most <= 2 * bpe.BLOCK + bpe.STEP + t.lookahead + 64


def test_lookahead_of_a_small_list():
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 4  # c can undo ab: one b and one a back, longest token 2
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([("ab", "c"), ("a", "b")])


def test_text_decoding(t):
    assert "".join(t.text_stream(t.encode("Hello, wörld 👍"))) == "hello , wörld 👍 "
    broken = [t.inner[0xF0], t.inner[0x9F], t.vocab["a</w>"]]
    assert "".join(t.text_stream(broken)) == "�a "


def test_query_and_operators(spark, sf, docs, none):
    rows = {r["doc_id"]: r for r in LLM_QUERIES["op5_bpe_transducer"](spark, sf).collect()}
    for r in documents(spark, sf).collect():
        ids = LIB.encode(r["text"] or "", add_special_tokens=False).ids
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert got["text_sha256"] == hashlib.sha256("".join(bpe.transducer(PATH).text_stream(ids)).encode()).hexdigest()
    encoded = bpe.encode_texts(docs, PATH)
    assert encoded.count() == docs.count() and bpe.encode_texts(none, PATH).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, PATH, plain=False).collect()}
    assert back[2] == back[3] == "" and back[5].startswith("the first line")
