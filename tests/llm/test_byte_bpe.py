"""Byte-level BPE against the tiktoken library, its transducer's streaming, and round trips of decoding."""

from __future__ import annotations

import codecs
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tracefold.llm import byte_bpe

FOLDER = "/root/testdata/sf0.001"
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def merges(request):
    return byte_bpe.read_ranks(public_tokenizers.path(request.param))


def library(merges):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges.rank, special_tokens={})


def random_texts(merges, n, seed):
    rng = random.Random(seed)
    any_char = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0xE000, 0x1FFFF), 0x85, 0x1C, 0xA0]))
    for _ in range(n):
        parts = [rng.choice([lambda: rng.choice(merges.tokens).decode("utf-8", "ignore"), any_char, lambda: "a" * rng.randrange(9), lambda: " \n" * rng.randrange(3)])() for _ in range(rng.randint(1, 12))]
        yield "".join(parts)


def test_tokens_equal_the_library(spark, merges):
    texts = [*random_texts(merges, 3000, 1), "ab" * 30_000, "é" * 20_000, "<|endoftext|> x", " " * 5000]
    rows = [(i, t, [1], "d") for i, t in enumerate(texts)] + [(None, None, None, None), (0, "", [], ""), (0, "again", [], "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, data string")
    coded = byte_bpe.encode(table, merges, PATTERN)
    got = [(r.doc_id, r.ids) for r in coded.collect()]
    plain = library(merges)
    assert sorted(map(str, got)) == sorted(str((k, plain.encode_ordinary(t or ""))) for k, t, *_ in rows)
    back = byte_bpe.decode(coded, merges).collect()
    assert sorted(map(str, ((r.doc_id, r.text, bytes(r.data)) for r in back))) == sorted(str((k, t or "", (t or "").encode())) for k, t, *_ in rows)
    assert byte_bpe.decode(byte_bpe.encode(table.limit(0), merges, PATTERN), merges).count() == 0


def test_lookahead_is_bounded(merges):
    """A token is emitted before as many bytes as the longest token has have been read beyond it; small tables of states change nothing."""
    rng, longest = random.Random(2), max(map(len, merges.tokens))
    machine, small = merges.transducer(), byte_bpe.Transducer(merges, states=20, transitions=60)
    for _ in range(40):
        piece = b"".join(rng.choice(merges.tokens) for _ in range(60))
        read, out, wait = 0, [], 0

        def feed(piece=piece):
            nonlocal read
            for b in piece:
                read += 1
                yield b

        emitted = 0
        for group in machine.stream(feed()):
            out += group
            wait = max(wait, read - emitted)
            emitted = sum(len(merges.tokens[t]) for t in out)
        assert b"".join(merges.tokens[t] for t in out) == piece and wait <= 2 * longest
        assert out == machine.encode(piece) == small.encode(piece)


def test_a_whole_piece_that_merges_do_not_make():
    """``abq`` is a token without merges that lead to it; the library gives it for the piece ``abq`` alone."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abq", b"abc", b"aa", b"aabc"]
    own = byte_bpe.Merges(tokens)
    assert not own.made(257)
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.rank, special_tokens={})
    for piece in ("abq", "abc", "xabq", "abqx", "aabbcc", "abcabq", "aabc", "aaabc", "aaaabcq", "abqabq"):
        assert own.transducer().encode(piece.encode()) == plain.encode_ordinary(piece), piece
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.Merges(tokens[1:])
    with pytest.raises(ValueError, match="higher rank"):
        byte_bpe.Merges([*tokens[:257], b"abcd", b"abc"])


def test_utf8_stream_is_the_incremental_decoder():
    rng = random.Random(3)
    lead = [0x41, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xF5, 0x80, 0x9F, 0xA0, 0xBF, 0x90, 0xC1, 0xFF]
    for _ in range(3000):
        data = bytes(rng.choice(lead) for _ in range(rng.randrange(12))) + "aé€𝄞".encode()[: rng.randrange(11)]
        own, plain, at, out = byte_bpe.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace"), 0, ["", ""]
        while at < len(data):
            step = rng.randrange(1, 4)
            part, at = data[at : at + step], at + step
            out = [out[0] + own.push(part), out[1] + plain.decode(part)]
            assert len(own.held) <= 3 and len(out[0]) >= len(out[1])  # nothing is held longer
        assert out[0] + own.finish() == out[1] + plain.decode(b"", final=True) == data.decode("utf-8", "replace")


def test_decoding_of_any_ids(spark, merges):
    """Ids that cut characters, and ids that aren't there."""
    cut = [merges.rank[bytes([b])] for b in "x€y".encode()]
    rows = [(1, cut), (2, cut[:2]), (3, [cut[2], cut[0]]), (4, []), (5, None), (None, cut[:1] * 9000)]
    got = {r.doc_id: r.text for r in byte_bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), merges).collect()}
    assert got == {1: "x€y", 2: "x�", 3: "�x", 4: "", 5: "", None: "x" * 9000}
    for bad in (-1, 60_000):
        with pytest.raises(Exception, match="no token has the id"):
            byte_bpe.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), merges).collect()


def test_query(spark):
    plain = library(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.QUERIES["op11_byte_bpe"](spark, FOLDER).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = plain.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))
    assert got == want
