"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

The merges are compiled, as far as the corpus needs them, into a deterministic transducer.  A
state stands for the bytes of a word that are not yet decided together with the last token
emitted; reading a byte leads to another state and emits the tokens that no continuation can
change any more.  That lookahead is bounded by the longest token.  States and transitions are made
when they are first met and kept by the worker; whole words met before are taken from a table.

Defined results: null and empty texts give an empty list; no special tokens are used, their
strings are ordinary text; any text decodes back to itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are split into words before merges apply.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What a worker keeps at most; beyond it, it starts anew.  A state takes about half a kilobyte.
WORDS_KEPT = 200_000
STATES_KEPT = 250_000


class _State:
    __slots__ = ("cells", "edges", "flush", "last", "pending")

    def __init__(self, last: int, pending: bytes, cells: list[tuple[int, int]]) -> None:
        #: ``cells[i]``: the last token, and its length, of the encoding of the first ``i`` pending bytes.
        self.last, self.pending, self.cells = last, pending, cells
        self.edges: dict[int, tuple[tuple[int, ...], _State]] = {}
        self.flush: tuple[int, ...] | None = None


class Transducer:
    """Byte-level BPE as a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int], split: str = SPLIT) -> None:
        import regex

        self.ranks, self.split = ranks, regex.compile(split)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.heads = {b[:i] for b in ranks for i in range(1, len(b))}
        self.joins: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.states: dict[tuple[int, bytes], _State] = {}
        self.made = 0
        self.start = _State(-1, b"", [(-1, 0)])

    @classmethod
    def load(cls, path: str | None = None) -> Transducer:
        """Read a ``.tiktoken`` vocabulary; by default the installed public one."""
        return _loaded(path)

    def _merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short string by rank, used to decide whether two tokens may be neighbours."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[at] + parts[at + 1] not in self.ranks:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _neighbours(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.joins:
            if len(self.joins) > STATES_KEPT:
                self.joins.clear()
            self.joins[key] = self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.joins[key]

    def _chain(self, cells: list[tuple[int, int]], end: int) -> list[int]:
        out = []
        while end > 0:
            token, length = cells[end]
            out.append(token)
            end -= length
        return out[::-1]

    def _step(self, state: _State, byte: int) -> tuple[tuple[int, ...], _State]:
        self.made += 1
        pending, cells = state.pending + bytes((byte,)), list(state.cells)
        n = len(pending)
        for length in range(min(n, self.longest), 0, -1):
            token = self.ranks.get(pending[n - length :])
            if token is None:
                continue
            before = cells[n - length][0] if length < n else state.last
            if before < 0 or self._neighbours(before, token):
                cells.append((token, length))
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        # tokens shared by every encoding that can still follow are decided
        chains = [self._chain(cells, n)]
        for start in range(n - 1, max(-1, n - self.longest), -1):
            if pending[start:] in self.heads:
                chains.append(self._chain(cells, start))
        shared = 0
        while all(len(c) > shared and c[shared] == chains[0][shared] for c in chains):
            shared += 1
        out = tuple(chains[0][:shared])
        if not shared:
            return out, _State(state.last, pending, cells)
        cut = sum(len(self.bytes_of[t]) for t in out)
        key = (out[-1], pending[cut:])
        if key not in self.states:
            self.states[key] = _State(out[-1], pending[cut:], [(-1, 0), *cells[cut + 1 :]])
        return out, self.states[key]

    def word(self, text: str) -> tuple[int, ...]:
        """Token ids of one word of the split."""
        state, out = self.start, []
        for byte in text.encode("utf-8", "surrogatepass"):
            edge = state.edges.get(byte)
            if edge is None:
                edge = state.edges[byte] = self._step(state, byte)
            if edge[0]:
                out.extend(edge[0])
            state = edge[1]
        if state.flush is None:
            state.flush = tuple(self._chain(state.cells, len(state.pending)))
        return (*out, *state.flush)

    def _unseen(self, word: str) -> tuple[int, ...]:
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        if self.made > STATES_KEPT:
            self.made, self.start = 0, _State(-1, b"", [(-1, 0)])
            self.states.clear()
        ids = self.word(word)
        if len(word) < 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text."""
        out: list[int] = []
        if text:
            get, unseen, extend = self.words.get, self._unseen, out.extend
            for word in self.split.findall(text):
                extend(get(word) or unseen(word))
        return out

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        get, unseen = self.words.get, self._unseen
        return sum([len(get(w) or unseen(w)) for w in self.split.findall(text)])

    def decode(self, ids: list[int]) -> str:
        """The text of token ids."""
        return "".join(decode_stream(self.bytes_of[i] for i in ids))


def _utf8_machine() -> list[dict[int, int]]:
    """Transitions of the UTF-8 automaton: state 0 is between characters, a missing entry is an error."""
    machine: list[dict[int, int]] = [{} for _ in range(8)]
    every = range(0x80, 0xC0)
    machine[0] |= dict.fromkeys(range(0x80), 0) | dict.fromkeys(range(0xC2, 0xE0), 1) | dict.fromkeys(range(0xE1, 0xF0), 2) | dict.fromkeys(range(0xF1, 0xF4), 3) | {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    machine[1] |= dict.fromkeys(every, 0)
    machine[2] |= dict.fromkeys(every, 1)
    machine[3] |= dict.fromkeys(every, 2)
    machine[4] |= dict.fromkeys(range(0xA0, 0xC0), 1)
    machine[5] |= dict.fromkeys(range(0x80, 0xA0), 1)
    machine[6] |= dict.fromkeys(range(0x90, 0xC0), 2)
    machine[7] |= dict.fromkeys(range(0x80, 0x90), 2)
    return machine


_UTF8 = _utf8_machine()


def decode_stream(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of a stream of byte pieces that may end inside a character; a broken sequence gives U+FFFD."""
    held, state = bytearray(), 0
    for piece in pieces:
        if state == 0 and not held and piece.isascii():
            yield piece.decode("ascii")
            continue
        for byte in piece:
            follow = _UTF8[state].get(byte)
            if follow is None:
                if held:
                    yield "�"
                held.clear()
                follow = _UTF8[0].get(byte)
                if follow is None:
                    yield "�"
                    state = 0
                    continue
            held.append(byte)
            state = follow
            if state == 0:
                yield held.decode("utf-8")
                held.clear()
    if held:
        yield "�"


@lru_cache(maxsize=4)
def _loaded(path: str | None) -> Transducer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Transducer(ranks)


def encode_corpus(df: DataFrame, doc_id: Column, text: Column, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row."""
    rows = df.select(doc_id.alias("doc_id"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Transducer.load(path)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1):
                flat.extend(tokens.encode(text.as_py()))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def count_corpus(df: DataFrame, doc_id: Column, text: Column, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row."""
    rows = df.select(doc_id.alias("doc_id"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Transducer.load(path)
        for batch in batches:
            counts = pa.array([tokens.count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["doc_id", "tokens"])

    return rows.mapInArrow(run, f"doc_id {kind}, tokens long")


def decode_corpus(df: DataFrame, doc_id: Column, ids: Column, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows of token ids; null ids give a null text."""
    rows = df.select(doc_id.alias("doc_id"), ids.alias("ids"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Transducer.load(path)
        for batch in batches:
            texts = [None if x is None else tokens.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
