"""Encoding a corpus with a public byte-level BPE tokenizer.

Texts are joined into one array of code points per batch and mapped to classes. A
finite automaton over the classes says where a pre-token begins. It runs without a
regular expression and without a loop over characters: the transition functions of
blocks are composed (an associative scan), which gives each block's entry state, and
then all blocks step together. The slices are looked up in a cache; what is missing is
merged by rank.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "byte_bpe_50k.tiktoken"

# classes of code points; SEPARATOR stands between texts
LETTER, NUMBER, OTHER, SPACE, BLANK, SEPARATOR = range(6)
# what the automaton reads: a class together with what follows
L, N, O, SHORT, LONG, PREFIX, LAST_BLANK, MID_BLANK, END, SAME = range(10)
# what it remembers of the token so far
FRESH, IN_L, IN_N, IN_O, AFTER_SPACE, IN_BLANK, ONE_MORE, TWO_MORE = range(8)

SEP = 0x110000
BLOCK = 256
CHUNK = 1 << 20

# White space of Unicode's White_Space property but U+0020.
BLANKS = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters after an apostrophe that make a token with it.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token begins) by symbol and state."""
    step = np.zeros((10, 8), np.uint8)
    begins = np.ones((10, 8), bool)

    def go(symbol: int, to: int, joins: dict[int, int]) -> None:
        step[symbol] = to
        for state, then in joins.items():
            step[symbol, state], begins[symbol, state] = then, False

    go(L, IN_L, {IN_L: IN_L, AFTER_SPACE: IN_L, ONE_MORE: FRESH, TWO_MORE: ONE_MORE})
    go(N, IN_N, {IN_N: IN_N, AFTER_SPACE: IN_N})
    go(O, IN_O, {IN_O: IN_O, AFTER_SPACE: IN_O})
    go(SHORT, ONE_MORE, {IN_O: IN_O, AFTER_SPACE: IN_O})
    go(LONG, TWO_MORE, {IN_O: IN_O, AFTER_SPACE: IN_O})
    go(PREFIX, AFTER_SPACE, {})
    go(LAST_BLANK, FRESH, {})
    go(MID_BLANK, IN_BLANK, {IN_BLANK: IN_BLANK})
    go(END, FRESH, {})
    go(SAME, FRESH, {s: s for s in range(8)})  # padding
    return step, begins


STEP, BEGINS = _automaton()


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(SEP + 1, OTHER, np.uint8)
    for cp in range(SEP):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[BLANKS] = BLANK
    table[0x20], table[SEP] = SPACE, SEPARATOR
    return table


def _symbols(cps: np.ndarray) -> np.ndarray:
    classes = _classes()[cps]
    after = np.append(classes[1:], SEPARATOR)
    solid = after <= OTHER  # a character that is no white space follows
    by_class = np.array([L, N, O, MID_BLANK, MID_BLANK, END], np.uint8)
    out = by_class[classes]
    out[(classes == SPACE) & solid] = PREFIX
    out[(classes == BLANK) & solid] = LAST_BLANK
    at = np.flatnonzero(cps == 0x27)
    if at.size:
        padded = np.append(cps, [SEP, SEP])
        first, second = padded[at + 1], padded[at + 2]
        out[at[np.isin(first, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
        for a, b in LONG_ENDINGS:
            out[at[(first == ord(a)) & (second == ord(b))]] = LONG
    return out


def token_starts(cps: np.ndarray) -> np.ndarray:
    """For each code point whether a pre-token begins at it; texts are parted by SEP."""
    n = len(cps)
    blocks = -(-n // BLOCK)
    symbols = np.full(blocks * BLOCK, SAME, np.uint8)
    symbols[:n] = _symbols(cps)
    by_step = np.ascontiguousarray(symbols.reshape(blocks, BLOCK).T)
    # each block's transition function: the state it ends in, by the state it begins in
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for row in by_step:
        whole = STEP[row[:, None], whole]
    # scan: after it, row i maps the state before block 0 to that after block i
    d = 1
    while d < blocks:
        whole[d:] = np.take_along_axis(whole[d:], whole[:-d], axis=1)
        d *= 2
    state = np.concatenate(([FRESH], whole[:-1, FRESH])).astype(np.uint8)
    starts = np.empty((BLOCK, blocks), bool)
    for j, row in enumerate(by_step):
        starts[j] = BEGINS[row, state]
        state = STEP[row, state]
    return starts.T.reshape(-1)[:n]


class Merger:
    """Pair merging by rank, with a cache of at most ``most`` pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        self.ranks = ranks
        self.most = most
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            rank = self.ranks.get(piece)
            found = (rank,) if rank is not None else self._merged(piece)
            if len(piece) <= 64:
                if len(self.cache) >= self.most:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that begins here
        before = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heap.append((r, i, j, end[j])) if not ready else heapq.heappush(heap, (r, i, j, end[j]))

        ready = False
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        ready = True
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
                continue
            end[i] = k
            alive[j] = 0
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)


def vocabulary_path(folder: str | None, name: str) -> str:
    """The vocabulary's place: in ``folder``, else where the installed package keeps it."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


@functools.lru_cache(4)
def merger(folder: str | None = None, name: str = RANKS) -> Merger:
    with open(vocabulary_path(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Merger(ranks)


def encode_batch(texts: list[str | None], m: Merger) -> tuple[list[list[int]], list[list[int]], list[list[int]]]:
    """Of each text: its ids, the offset (in code points) of each pre-token, and the ids of each pre-token."""
    ids: list[list[int]] = []
    offsets: list[list[int]] = []
    sizes: list[list[int]] = []
    i = 0
    while i < len(texts):
        part, room = [], CHUNK
        while i < len(texts) and (room > 0 or not part):
            part.append(texts[i] or "")
            room -= len(part[-1]) + 1
            i += 1
        _encode_part(part, m, ids, offsets, sizes)
    return ids, offsets, sizes


def _encode_part(texts: list[str], m: Merger, ids, offsets, sizes) -> None:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # a separator after each text
    cps = np.full(int((lengths + 1).sum()), SEP, np.uint32)
    solid = np.ones(len(cps), bool)
    solid[firsts + lengths] = False
    joined = "".join(texts)
    cps[solid] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(token_starts(cps))
    width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
    width[~solid] = 0
    byte_at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
    data = joined.encode()
    bounds = byte_at[at].tolist()
    bounds.append(len(data))
    text_of = np.searchsorted(at, firsts)  # index of each text's first pre-token, in ``at``
    ends = np.searchsorted(at, firsts + lengths)  # the separator begins a token of its own, of no bytes
    look, miss = m.cache.get, m.ids
    for t in range(len(texts)):
        a, b = int(text_of[t]), int(ends[t])
        out: list[int] = []
        per: list[int] = []
        for k in range(a, b):
            piece = data[bounds[k] : bounds[k + 1]]
            found = look(piece) or miss(piece)
            out += found
            per.append(len(found))
        ids.append(out)
        sizes.append(per)
        offsets.append((at[a:b] - firsts[t]).tolist())


def encode(df: DataFrame, *, text: str, keep: list[str], vocabulary: str | None = None, name: str = RANKS) -> DataFrame:
    """Columns ``keep`` and, for each row's text, ids, token_offsets and token_sizes.

    ids are ordinary tokens; strings of special tokens are encoded as text. Null and
    empty texts get empty lists. token_offsets are the code-point offsets of the
    pre-tokens, token_sizes how many ids each has, so any stretch of ids can be decoded
    to its place in the text. ``vocabulary`` is the folder of the rank file ``name``.
    """
    fields = [df.schema[c] for c in keep]
    lists = ["ids", "token_offsets", "token_sizes"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} array<int>" for c in lists)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary, name)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                columns = encode_batch(part.column(part.num_columns - 1).to_pylist(), m)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=[*keep, *lists]
                )

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def token_counts(df: DataFrame, *, text: str, keep: list[str], vocabulary: str | None = None, name: str = RANKS) -> DataFrame:
    """Columns ``keep`` and ``tokens``, the number of ids of each row's text."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(vocabulary, name)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                ids, _, _ = encode_batch(part.column(part.num_columns - 1).to_pylist(), m)
                counts = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], names=[*keep, "tokens"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str | None = None, name: str = RANKS) -> str:
    """The text of ``ids``."""
    back = _bytes_of(vocabulary, name)
    return b"".join(back[i] for i in ids).decode("utf-8", errors="replace")


@functools.lru_cache(4)
def _bytes_of(vocabulary: str | None, name: str) -> dict[int, bytes]:
    return {r: b for b, r in merger(vocabulary, name).ranks.items()}
