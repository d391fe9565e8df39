import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, nothing, texts
from vellum.llm.op06_bpe import ByteToText, Memory, Transducer, decode_documents, encode_documents, sufficient_lookahead, token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return Transducer(PATH, block=8), Tokenizer.from_file(PATH)


def some_texts():
    rng = random.Random(1)
    letters = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x340), *range(0x380, 0x400), 0x1C, 0x85, 0xA0, 0x2028, 0x3000, 0x200B, 0x130, 0x1F600, 0xAC00]]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out += ["".join(rng.choice("abcdetinoshr") for _ in range(rng.randint(100, 2500))) for _ in range(40)]
    return out + ["<|endoftext|>", "a <|endoftext|>b<|startoftext|>", "", "  ", "it's we'LL 's", "ΑΣ ΣΑΣ", "a" * 3000, "!" * 700, *(t for _, t, _ in texts() if t)]


def test_equals_the_library(both):
    mine, library = both
    for text in some_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(mine.encode(text)) == ids
        assert "".join(mine.decode(ids)) == library.decode(ids, skip_special_tokens=False)


def test_streaming_holds_a_block_and_the_lookahead(both):
    mine, _ = both
    assert list(mine.transduce(iter("the" * 2000))) == mine.merge(list("the" * 2000))


def test_lookahead_of_a_small_list():
    # a waits for b, which may go to c, which may go to d.
    assert sufficient_lookahead([("c", "d"), ("b", "c"), ("a", "b")], len) == 3
    assert sufficient_lookahead([("a", "b"), ("b", "c")], len) == 1


def test_bytes_become_text_as_they_come():
    machine = ByteToText()
    assert [machine.push(bytes([b])) for b in "é漢".encode()] == ["", "é", "", "", "漢"] and machine.finish() == ""


def test_memory_is_bounded():
    memory = Memory(lambda k: k * 2, 10)
    assert [memory[i] for i in range(100)] == [2 * i for i in range(100)] and len(memory) <= 10 and len(memory.old) <= 10


def test_query_rows(spark, both):
    library = both[1]
    got = sorted(token_digests(documents(spark), PATH).collect(), key=str)
    want = []
    for i, t, _ in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_digests(nothing(spark), PATH).collect() == []


def test_round_trip(spark):
    docs = documents(spark, [(1, "The cat's 3 naïve résumés", "a")])
    assert decode_documents(encode_documents(docs, PATH), PATH).collect()[0]["text"] == "the cat 's 3 naïve résumés"
