"""Encoding of a corpus with a public byte-level BPE vocabulary.

Text is cut without regular expressions. Every code point is mapped to a class by one table
lookup, the cutting rule is a small finite automaton over these classes, and the automaton is
run by an associative scan: the transition functions of all code points of a block are composed,
the block functions are composed by doubling, and one replay gives the state at each code point.
The slices between boundaries feed a cached pair merge.

Defined results: null and empty texts give the empty array; ids never include special tokens, a
text that spells one is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces whose merge is remembered by a worker before the memory is emptied.
CACHE_PIECES = 400_000
#: Code points scanned together; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000

# Classes of code points. A letter that may open a contraction has a class of its own.
_LETTER, _NUMBER, _OTHER, _APOS, _ONE, _TWO, _SPACE_END, _WHITE_END, _WHITE = range(9)
_N_CLASSES = 9
_RAW_SPACE, _RAW_WHITE = 6, 7

# White space by the Unicode property White_Space.
_WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]

# States: what the piece in progress is.
_FRESH, _IN_LETTERS, _IN_NUMBERS, _IN_OTHER, _AT_APOS, _IN_WHITE, _AFTER_SPACE, _MID_SUFFIX, _CLOSED = range(9)
_N_STATES = 9


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point before look-ahead: letters, numbers, white space, the rest."""
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    category = unicodedata.category
    first = np.frombuffer("".join(category(chr(c))[0] for c in range(0x110000)).encode(), dtype=np.uint8)
    table[first == ord("L")] = _LETTER
    table[first == ord("N")] = _NUMBER
    table[_WHITE_SPACE] = _RAW_WHITE
    table[0x20] = _RAW_SPACE
    table[ord("'")] = _APOS
    return table


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a piece) by symbol and state; symbols from ``_N_CLASSES`` on open a text."""
    step = np.zeros((2 * _N_CLASSES, _N_STATES), dtype=np.uint8)
    cut = np.ones((2 * _N_CLASSES, _N_STATES), dtype=bool)
    target = {
        _LETTER: _IN_LETTERS, _ONE: _IN_LETTERS, _TWO: _IN_LETTERS, _NUMBER: _IN_NUMBERS, _OTHER: _IN_OTHER,
        _APOS: _AT_APOS, _SPACE_END: _AFTER_SPACE, _WHITE_END: _CLOSED, _WHITE: _IN_WHITE,
    }
    for symbol, state in target.items():
        step[symbol, :] = state
    joins = {
        _IN_LETTERS: (_LETTER, _ONE, _TWO), _IN_NUMBERS: (_NUMBER,), _IN_OTHER: (_OTHER, _APOS),
        _AT_APOS: (_OTHER, _APOS), _IN_WHITE: (_WHITE,),
        _AFTER_SPACE: (_LETTER, _ONE, _TWO, _NUMBER, _OTHER, _APOS),
    }
    for state, symbols in joins.items():
        for symbol in symbols:
            cut[symbol, state] = False
            if symbol == _APOS:
                step[symbol, state] = _IN_OTHER
    cut[_ONE, _AT_APOS], step[_ONE, _AT_APOS] = False, _CLOSED
    cut[_TWO, _AT_APOS], step[_TWO, _AT_APOS] = False, _MID_SUFFIX
    for symbol in (_LETTER, _ONE, _TWO):
        cut[symbol, _MID_SUFFIX], step[symbol, _MID_SUFFIX] = False, _CLOSED
    # a symbol that opens a text acts as from a fresh state, whatever came before
    step[_N_CLASSES:, :] = step[:_N_CLASSES, _FRESH][:, None]
    return step, cut


def scan_states(symbols: np.ndarray, step: np.ndarray, start: int) -> np.ndarray:
    """State before each symbol, by composing transition functions (an associative operation)."""
    n, k = len(symbols), step.shape[1]
    if n == 0:
        return np.zeros(0, dtype=np.uint8)
    columns = max(1, int(np.sqrt(n)))
    rows = -(-n // columns)
    grid = np.full(rows * columns, step.shape[0], dtype=np.intp)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, columns).T)
    flat = np.vstack([step, np.arange(k, dtype=np.uint8)]).astype(np.intp).ravel()  # the last symbol changes nothing
    whole = np.tile(np.arange(k, dtype=np.intp), (rows, 1))
    for column in grid:
        whole = flat[column[:, None] * k + whole]
    reach = 1
    while reach < rows:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach], axis=1)
        reach *= 2
    state = np.empty(rows, dtype=np.intp)
    state[0], state[1:] = start, whole[:-1, start]
    before = np.empty((columns, rows), dtype=np.uint8)
    for j, column in enumerate(grid):
        before[j] = state
        state = flat[column * k + state]
    return before.T.ravel()[:n]


def cut_points(points: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Positions in ``points`` (code points of texts laid end to end) at which a piece starts.

    ``opens`` holds the position of the first code point of each non-empty text.
    """
    n = len(points)
    raw = class_table()[points]
    is_open = np.zeros(n + 1, dtype=bool)
    is_open[opens] = True
    is_open[n] = True
    following = np.empty(n, dtype=points.dtype)
    following[:-1] = points[1:]
    following[-1:] = 0
    white = raw >= _RAW_SPACE
    ends_run = np.zeros(n, dtype=bool)  # white space before something visible of the same text
    ends_run[:-1] = white[:-1] & ~white[1:]
    ends_run &= ~is_open[1:]
    symbols = raw.copy()
    symbols[white] = _WHITE
    symbols[white & ends_run] = _WHITE_END
    symbols[(raw == _RAW_SPACE) & ends_run] = _SPACE_END
    for letter in "stmd":
        symbols[points == ord(letter)] = _ONE
    follows = ~is_open[1:]
    for first, second in ("re", "ve", "ll"):
        symbols[(points == ord(first)) & (following == ord(second)) & follows] = _TWO
    symbols[is_open[:-1]] += _N_CLASSES
    step, cut = automaton()
    return np.flatnonzero(cut[symbols, scan_states(symbols, step, _FRESH)])


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes batches of texts; one per worker process."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the pair of lowest rank, leftmost first, is joined until none is left."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        # a linked list of parts over byte positions, and a heap of the pairs that may join
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                r = ranks.get(piece[i : after[end]])
                if r is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if before[i] >= 0:
                r = ranks.get(piece[before[i] : end])
                if r is not None:
                    heapq.heappush(heap, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and how many each text has."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(lengths) - lengths
        cuts = cut_points(points, starts[lengths > 0])
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        raw = joined.encode()
        bounds = place[np.append(cuts, len(points))].tolist()
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        pieces = []
        for a, b in zip(bounds, bounds[1:]):
            piece = raw[a:b]
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self.merge(piece)
            pieces.append(ids)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.fromiter(chain.from_iterable(pieces), dtype=np.int32, count=int(sizes.sum()))
        running = np.concatenate([[0], np.cumsum(sizes)])
        first = np.searchsorted(cuts, starts)
        last = np.searchsorted(cuts, starts + lengths)
        return flat, running[last] - running[first]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``block``, over any number of texts, in blocks of bounded size; null counts as empty."""
        flats, counts, held, chars = [], [], [], 0
        for text in texts:
            text = text or ""
            if held and chars + len(text) > BLOCK_CHARS:
                a, b = self.block(held)
                flats.append(a)
                counts.append(b)
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        if held:
            a, b = self.block(held)
            flats.append(a)
            counts.append(b)
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate(flats or [empty.astype(np.int32)]), np.concatenate(counts or [empty])

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id; running sums within a text are the offsets of its tokens."""
        return np.fromiter((len(self.tokens[i]) for i in ids.tolist()), dtype=np.int32, count=len(ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids that encode a whole text."""
        return b"".join(self.tokens[i] for i in ids).decode()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(path)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str, with_offsets: bool = False) -> DataFrame:
    """Rows (key, ids) of every row of ``df``; with offsets also the first byte of each token.

    One row out for one row in, repeated keys included; other columns are left out, so none can clash. No shuffle.
    """
    kind = df.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)]
    if with_offsets:
        fields.append(T.StructField("offsets", T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            ids, counts = own.encode(batch.column(1).to_pylist())
            ends = np.concatenate([[0], np.cumsum(counts)])
            where = pa.array(ends.astype(np.int32))
            columns = [batch.column(0), pa.ListArray.from_arrays(where, pa.array(ids))]
            if with_offsets:
                size = own.offsets(ids)
                run_on = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
                begin = run_on[:-1] - np.repeat(run_on[ends[:-1]], counts)
                columns.append(pa.ListArray.from_arrays(where, pa.array(begin.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return df.select(key, df[text].cast("string")).mapInArrow(run, T.StructType(fields))


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary: str, out: str = "n_tokens") -> DataFrame:
    """Rows (*keys, n_tokens): the size of each row's text in tokens; a null text has 0."""
    fields = [df.schema[k] for k in keys] + [T.StructField(out, T.LongType(), False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            _, counts = own.encode(batch.column(len(keys)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(counts)], names=[f.name for f in fields])

    return df.select(*keys, df[text].cast("string")).mapInArrow(run, T.StructType(fields))
