"""Byte-level BPE: encoding by a finite-state transducer that is made deterministic as it is used, and streaming decoding.

Compiling: the merges give each token its halves (``Merges``). Two tokens may stand side by side if no merge crosses their border: what touches
it at any time are nodes of the left token's right edge and the right token's left edge, so the two edges are walked in order of rank. A byte string has exactly one
sequence of tokens whose neighbours may all stand side by side, and that is its encoding.

Transducer: its nondeterministic form guesses tokens along the vocabulary's trie; a configuration is (last whole token, trie node, tokens not
emitted yet). A deterministic state is the set of live configurations, found when first entered (subset construction on demand). Tokens that all
configurations share are emitted at once: a configuration lives for as long as its trie path, so a token waits for fewer bytes than the longest token has.
States are kept up to a bound and then made anew. A piece that is a token as a whole is that token, even where the merges don't make it.

Decoding is a stream too: ids become bytes, and a UTF-8 state machine holds back at most three bytes of an unfinished character; invalid
sequences become U+FFFD, while ``data`` has the bytes as they are.

Defined cases: null and empty texts have no tokens, null ids decode to nothing; keys of any kind are passed on, repeated rows are encoded each; an empty table
gives no rows; an id outside of the vocabulary is an error. Texts are streamed piece by piece whatever their length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import table

#: States and transitions of a transducer before they are made anew; pieces whose tokens are remembered in each of two generations, of so many characters at most.
STATES, TRANSITIONS, PIECES, PIECE_CHARS = 300_000, 700_000, 200_000, 32
#: Pairs of tokens whose answer is remembered.
BESIDE = 150_000
#: Ids that are turned to text at once.
DECODED = 4096
NEVER = 1 << 40


class Merges:
    """A vocabulary of byte strings whose ids are their ranks, with the two halves of each (-1: a byte, -2: the merges don't make it)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.halves = [self._split(t) for t in tokens]
        self.edges: tuple[dict, dict] = ({}, {})
        self._transducer = None

    def _split(self, token: bytes) -> tuple[int, int]:
        if len(token) == 1:
            return -1, -1
        parts, own, late = [token[i : i + 1] for i in range(len(token))], self.rank[token], False
        while len(parts) > 2:
            best, i = min((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == NEVER:
                return -2, -2
            late |= best > own
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if late:
            raise ValueError(f"token {own} is made of tokens of higher rank")
        return self.rank[parts[0]], self.rank[parts[1]]

    def made(self, token: int) -> bool:
        return self.halves[token][0] != -2

    def edge(self, token: int, side: int) -> list[int]:
        """From the outermost byte of a side (0 left, 1 right) up to the token, and a last entry above all ranks."""
        out = self.edges[side].get(token)
        if out is None:
            out = [NEVER, token]
            while self.halves[out[-1]][0] >= 0:
                out.append(self.halves[out[-1]][side])
            out = self.edges[side][token] = out[::-1]
        return out

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` apart. Among equal merges the one on the left comes first."""
        left, right, rank, tokens, i, j = self.edge(a, 1), self.edge(b, 0), self.rank.get, self.tokens, 0, 0
        while True:
            over, under = left[i + 1], right[j + 1]
            across = rank(tokens[left[i]] + tokens[right[j]], NEVER)
            if across < over and across <= under:
                return False
            if over <= under:
                if over == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def transducer(self) -> Transducer:
        """One a worker, kept with the broadcast from task to task."""
        if self._transducer is None:
            self._transducer = Transducer(self)
        return self._transducer

    def __getstate__(self):
        return self.__dict__ | {"_transducer": None, "edges": ({}, {})}


def read_ranks(path: str) -> Merges:
    """A file of lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return Merges([t for _, t in pairs])


class Transducer:
    """Bytes to tokens; state 0 is the start of a piece.

    A state is kept as the packed integers of its configurations: last token (-1: none), trie node, number of tokens not emitted yet, these tokens. A
    transition is the next state, doubled; it is odd if tokens are emitted, which ``emitted`` then has.
    """

    def __init__(self, merges: Merges, states: int = STATES, transitions: int = TRANSITIONS):
        self.merges, self.bounds = merges, (states, transitions)
        self.child: dict[int, int] = {}  # (node, byte) to node; node 0 is the root
        self.at, self.inner = array("i", [-1]), bytearray([1])  # the token that ends at a node; whether tokens go on from it
        for i, token in enumerate(merges.tokens):
            node = 0
            for b in token:
                self.inner[node] = 1
                key = node << 8 | b
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.at)
                    self.at.append(-1)
                    self.inner.append(0)
            self.at[node] = i
        self.beside: dict[int, bool] = {}
        self.recent: dict[str, bytes] = {}  # packed tokens of pieces seen lately, and of those seen before these
        self.before: dict[str, bytes] = {}
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.step: dict[int, int] = {}
        self.emitted: dict[int, tuple] = {}
        self.last: dict[int, tuple] = {}
        self._reset()

    def _reset(self) -> None:
        for kept in (self.states, self.number, self.step, self.emitted, self.last):
            kept.clear()
        self._state(array("i", [-1, 0, 0]).tobytes())

    def _may_follow(self, a: int, b: int) -> bool:
        if a < 0:
            return self.merges.made(b)
        key = a << 32 | b
        out = self.beside.get(key)
        if out is None:
            if len(self.beside) >= BESIDE:
                self.beside.clear()
            out = self.beside[key] = self.merges.made(b) and self.merges.side_by_side(a, b)
        return out

    def _configurations(self, state: int) -> Iterator[tuple[int, int, tuple]]:
        flat = array("i")
        flat.frombytes(self.states[state])
        i = 0
        while i < len(flat):
            end = i + 3 + flat[i + 2]
            yield flat[i], flat[i + 1], tuple(flat[i + 3 : end])
            i = end

    def _state(self, packed: bytes) -> int:
        number = self.number.get(packed)
        if number is None:
            number = self.number[packed] = len(self.states)
            self.states.append(packed)
        return number

    def _first(self, state: int, byte: int) -> tuple[int, tuple]:
        """A transition that is used for the first time, and what it emits; beyond the bounds all are made anew, from the current state on."""
        if len(self.states) > self.bounds[0] or len(self.step) > self.bounds[1]:
            here = self.states[state]
            self._reset()
            state = self._state(here)
        after = []
        for last, node, out in self._configurations(state):
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            # a token of the vocabulary that is the whole piece counts even if merges don't make it, so its start lives on to be asked at the end
            if self.inner[child] or last < 0:
                after.append((last, child, out))
            token = self.at[child]
            if token >= 0 and self._may_follow(last, token):
                after.append((token, 0, (*out, token)))
        shared = 0
        for same in zip(*(out for _, _, out in after), strict=False):
            if same.count(same[0]) < len(same):
                break
            shared += 1
        flat = array("i")
        for last, node, out in after:
            flat.extend((last, node, len(out) - shared, *out[shared:]))
        key, out = state << 8 | byte, after[0][2][:shared]
        found = self.step[key] = self._state(flat.tobytes()) << 1 | bool(out)
        if out:
            self.emitted[key] = out
        return found, out

    def _end(self, state: int) -> tuple:
        """What is emitted where a piece ends."""
        out = self.last.get(state)
        if out is None:
            own = list(self._configurations(state))
            whole = [self.at[node] for last, node, _ in own if last < 0 and self.at[node] >= 0]
            out = self.last[state] = (whole[0],) if whole else next((out for _, node, out in own if node == 0), ())
        return out

    def stream(self, data: Iterable[int]) -> Iterator[tuple]:
        """Tokens of one piece whose bytes come one by one, in groups as they become certain."""
        state = 0
        for byte in data:
            found = self.step.get(state << 8 | byte)
            if found is None:
                found, out = self._first(state, byte)
            else:
                out = self.emitted[state << 8 | byte] if found & 1 else ()
            state = found >> 1
            if out:
                yield out
        yield self._end(state)

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a whole piece."""
        state, out, step, emitted = 0, [], self.step.get, self.emitted
        for byte in piece:
            key = state << 8 | byte
            found = step(key)
            if found is None:
                found, group = self._first(state, byte)
                out += group
            elif found & 1:
                out += emitted[key]
            state = found >> 1
        out += self._end(state)
        return out

    def packed(self, piece: str) -> bytes:
        """Tokens of a piece as 32-bit numbers; short pieces are remembered."""
        out = self.before.get(piece) or array("i", self.encode(piece.encode())).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self.recent) >= PIECES:
                self.before.clear()
                self.before.update(self.recent)
                self.recent.clear()
            self.recent[piece] = out
        return out


#: UTF-8 as a state machine: (state, first byte, last byte, next state). 0: between characters; 1 to 3: so many bytes to come; 4 to 7: the second byte is bound.
_RULES = (
    (0, 0x00, 0x7F, 0), (0, 0xC2, 0xDF, 1), (0, 0xE0, 0xE0, 4), (0, 0xE1, 0xEC, 2), (0, 0xED, 0xED, 5), (0, 0xEE, 0xEF, 2), (0, 0xF0, 0xF0, 6), (0, 0xF1, 0xF3, 3), (0, 0xF4, 0xF4, 7),
    (1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2),
)


class Utf8Stream:
    """Text of bytes that come in parts. Whole characters are given on at once, an unfinished one is held."""

    STEP = {(s, b): t for s, low, high, t in _RULES for b in range(low, high + 1)}

    def __init__(self):
        self.held = b""

    def _unfinished(self, data: bytes) -> int:
        """Bytes at the end that begin a character and break off."""
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state = 0
                for b in data[len(data) - back :]:
                    state = self.STEP.get((state, b))
                    if state is None:
                        return 0
                return back if state else 0
        return 0

    def push(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def _typed(df: DataFrame, key: str, columns: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, {columns}"


def encode(df: DataFrame, merges: Merges, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the tokens of each text; matches of ``pattern`` are encoded separately, without special tokens. Other columns are not passed on."""
    shared = df.sparkSession.sparkContext.broadcast(merges)

    def run(batches):
        machine, pieces = shared.value.transducer(), regex.compile(pattern).findall
        known, packed = machine.recent.get, machine.packed
        for batch, raw, offs in B.chunks(batches, text):
            flat, ends = bytearray(), [0]
            blob = raw.tobytes()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for piece in pieces(blob[a:b].decode()):
                    flat += known(piece) or packed(piece)
                ends.append(len(flat) // 4)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, _typed(df, key, "ids array<int>"))


def decode(df: DataFrame, merges: Merges, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, data, text``: the bytes of each list of ids, and their text."""
    shared = df.sparkSession.sparkContext.broadcast(merges.tokens)

    def run(batches):
        tokens = shared.value
        for batch in batches:
            names = batch.schema.get_field_index
            column = batch.column(names(ids))
            data, texts, begin, size = [], [], 0, 0
            for row in range(batch.num_rows):
                flat, stream, blobs, parts = column[row].values, Utf8Stream(), [], []
                for i in range(0, len(flat) if flat is not None else 0, DECODED):
                    chunk = flat.slice(i, DECODED).to_numpy(zero_copy_only=False)
                    if chunk.min() < 0 or chunk.max() >= len(tokens):
                        raise ValueError(f"no token has the id {chunk.min() if chunk.min() < 0 else chunk.max()}")
                    blobs.append(b"".join([tokens[t] for t in chunk.tolist()]))
                    parts.append(stream.push(blobs[-1]))
                data.append(b"".join(blobs))
                texts.append("".join([*parts, stream.finish()]))
                size += len(data[-1])
                if size >= B.CHUNK or row + 1 == batch.num_rows:
                    keys = batch.column(names(key)).slice(begin, len(data))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(data, pa.binary()), pa.array(texts, pa.string())], names=[key, "data", "text"])
                    data, texts, begin, size = [], [], row + 1, 0

    return df.select(key, ids).mapInArrow(run, _typed(df, key, "data binary, text string"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    merges = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode(table(spark, sf_dir, "documents"), merges, public_tokenizers.PATTERN)
    # the ids' figures ride along as the key of the decoding, so nothing is encoded twice or joined
    figures = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    back = decode(coded.select(figures.alias("row"), "ids"), merges, "row")
    return back.select("row.*", F.sha2("data", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11}
SQL: dict[str, str] = {}
