import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lakeval.llm import bpe

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


@pytest.mark.parametrize("name", FILES)
def test_equals_reference_encoder(name):
    ranks = bpe.read_ranks(P.path(name))
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.Encoder(ranks, P.PATTERN)
    rng = random.Random(3)
    alphabets = ["ab", "a", "the and ", "aAbB \n\t", "0123456789.", "éñüß日本語 ", "-=_*# ", " \x1c\x85  　a"]
    for _ in range(1500):
        s = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))
        assert np.frombuffer(got.encode(s), "<u4").tolist() == want.encode_ordinary(s), s
    for s in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(20_000))):
        assert np.frombuffer(got.encode(s), "<u4").tolist() == want.encode_ordinary(s)


def test_small_state_tables_give_the_same():
    ranks = bpe.read_ranks(P.path(FILES[0]))
    a, b = bpe.LazyTransducer(ranks), bpe.LazyTransducer(ranks, max_states=3)
    for w in (b"unbelievable", b"zxqjkvb", b"aaaaaaaaabbbbbb", "çédille".encode()):
        assert a.encode_piece(w) == b.encode_piece(w)


def test_rare_pieces_are_walked():
    """A piece met once makes no deterministic states; walked, determinised and both in turn give the same."""
    ranks = bpe.read_ranks(P.path(FILES[1]))
    rng = random.Random(4)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ab", "aeinrst", "éñüß日本語", "-=_*#", "привет"]
    pieces = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(1, 20))).encode() for _ in range(800)]
    rare, soon, always = bpe.LazyTransducer(ranks, due=10**9), bpe.LazyTransducer(ranks, due=2, max_states=50), bpe.LazyTransducer(ranks, most_walked=0)
    for p in pieces:
        assert rare.encode_piece(p) == soon.encode_piece(p) == always.encode_piece(p), p
    assert len(rare._walks) == 1 and len(soon._walks) > 1
    once = bpe.LazyTransducer(ranks)
    once.encode_piece(b"unbelievableness")
    assert len(once._walks) == 1


def test_plain_pattern_cuts_alike():
    plain, want = bpe.plain_pattern(P.PATTERN), bpe.regex.compile(P.PATTERN)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    assert plain.findall(every) == want.findall(every)
    rng = random.Random(6)
    for _ in range(3000):
        s = "".join(rng.choice(" \t\n\r\x0b\x1c\x85\u3000aB9_²½Ⅷ一é'stredml.,-\u0301") for _ in range(rng.randrange(30)))
        assert plain.findall(s) == want.findall(s), s
    for other in (r"(?i:'s)|\p{L}+", r"\w+|\W", r"[[:alpha:]]+|.", r"\P{L}+|\p{L}+"):
        assert bpe.plain_pattern(other) is None


def test_chunks_of_any_bytes_are_fed_alike():
    rng = random.Random(7)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0x80, 0x9F, 0xA9, 0xC1, 0xC3, 0xE6, 0xF0, 0xF4, 0xF5, 0xFF]) for _ in range(rng.randrange(20)))
        one, some = bpe.StreamDecoder({i: bytes([i]) for i in range(256)}), bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
        cut = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        for a, b in zip([0, *cut], [*cut, len(data)], strict=True):
            assert some.feed(data[a:b]) == b"".join(one.feed([c]) for c in data[a:b]) and some.state == one.state
        assert some.flush() == one.flush()


def test_stream_decoder_keeps_unfinished_characters():
    d = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    data = "aé日😀z".encode()
    parts = [d.feed([c]) for c in data]
    assert b"".join(parts) + d.flush() == data
    assert [p.decode() for p in parts if p] == ["a", "é", "日", "😀", "z"]
    assert "".join(d.text([[0xE6, 0x97], [65], [0xFF], [0xC3]])) == "�A��"


def test_round_trip(spark, docs, corpus):
    df = docs(corpus).withColumnRenamed("key", "token_ids")
    path = P.path(FILES[0])
    out = bpe.decode(bpe.encode(df, path, P.PATTERN), path).collect()
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert len(out) == len(corpus)
    for r in out:
        ids = want.encode_ordinary(r["text"] or "")
        assert r["n_tokens"] == len(ids)
        assert hashlib.sha256(bytes(r["token_ids"])).digest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest()
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(docs([]), path, P.PATTERN).count() == 0
    once = bpe.round_trip(df.withColumnRenamed("node", "decoded"), path, P.PATTERN).collect()
    key = lambda r: (r["doc_id"], r["n_tokens"], bytes(r["token_ids"]), bytes(r["decoded"]))
    assert sorted(map(key, once)) == sorted(map(key, out))
