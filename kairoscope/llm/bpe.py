"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding with offsets.

Pre-tokenisation reads code-point classes and runs the tokenizer pattern as a finite automaton. Each class is a
function from states to states; the functions that compositions of them can give are few (a finite monoid, closed
here at import), so a scan over an array composes numbers by one table look-up each. The scan is the associative
one: rows of a block are composed for all blocks at once, block results are scanned in turn, and every position
then gets its state. No regular expression takes part.

Pieces are byte slices that a bounded cache maps to token ids; pieces not held are merged all together, one merge
in each per round. Offsets (byte starts) are kept for decoding and for cutting text by tokens.

Defined results: null or empty text gives no ids and decodes to nothing. Any Unicode text round-trips; rows are
independent, so repeated rows repeat their results. Ids of another vocabulary than the ranks' raise a KeyError.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from kairoscope.llm.common import declared, map_slices, named, offsets

# Character classes. CONTRACT_2 and CONTRACT_3 are apostrophes that 1 and 2 letters complete to a contraction.
LETTER, NUMBER, OTHER, SPACE, BLANK, CONTRACT_2, CONTRACT_3, SPACE_LAST, BLANK_LAST, EDGE = range(10)
# States after a character: within a run, after a space that may lead a token, with 2 or 1 characters of a
# contraction to come, or at the end of a token.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, LED, TWO_LEFT, ONE_LEFT, DONE = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this character. *_LAST: white space that something else follows."""
    if kind == EDGE:
        return DONE, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return DONE, False
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if kind in runs:
        return runs[kind], state not in (runs[kind], LED)
    if kind in (CONTRACT_2, CONTRACT_3):
        if state in (IN_OTHERS, LED):
            return IN_OTHERS, False
        return (ONE_LEFT if kind == CONTRACT_2 else TWO_LEFT), True
    if kind in (SPACE, BLANK):
        return IN_BLANKS, state != IN_BLANKS
    return (LED if kind == SPACE_LAST else DONE), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each class's function, product table [f, g] = f then g, image of each function at DONE, starts [state, class])."""
    base = [tuple(_step(s, k)[0] for s in range(8)) for k in range(10)]
    number = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in base:
            if (h := tuple(g[s] for s in f)) not in number:
                number[h] = len(number)
                todo.append(h)
    every = list(number)
    product = np.array([[number[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8 if len(every) < 256 else np.uint16)
    return np.array([number[g] for g in base], product.dtype), product, np.array([f[DONE] for f in every], np.uint8), np.array([[_step(s, k)[1] for k in range(10)] for s in range(8)])


FUNCTIONS, PRODUCT, AT_DONE, STARTS = _monoid()


def _classes() -> np.ndarray:
    r"""Class of every code point: \p{L}, \p{N}, white space, else OTHER.

    Unicode versions differ in what they call a letter, so the properties are read from the library whose ids are to
    be matched: with single bytes as ranks, it returns the characters of a text that a property holds for.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    singles = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        found = bytes(tiktoken.Encoding(kind_name(kind), pat_str=pattern, mergeable_ranks=singles, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    out[0x20] = SPACE
    return out


def kind_name(kind: int) -> str:
    return f"characters-{kind}"


_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASS:
        _CLASS.append(_classes())
    return _CLASS[0]


def scan(functions: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive scan of composition (first to last) of function numbers, in blocks of `width`."""
    n = len(functions)
    if n <= width:
        out = functions.copy()
        for i in range(1, n):
            out[i] = PRODUCT[out[i - 1], functions[i]]
        return out
    rows = -(-n // width)
    block = np.zeros(rows * width, functions.dtype)
    block[:n] = functions
    block = np.ascontiguousarray(block.reshape(rows, width).T)
    size = len(PRODUCT)
    flat = PRODUCT.ravel()
    for i in range(1, width):
        block[i] = flat[block[i - 1].astype(np.intp) * size + block[i]]
    before = np.zeros(rows, functions.dtype)  # the identity, number 0, before the first block
    before[1:] = scan(block[-1], width)[:-1]
    return flat[before.astype(np.intp) * size + block].T.ravel()[:n]


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pattern's pieces start in code points of texts set end to end; firsts: each text's first position (of a non-empty text)."""
    n = len(points)
    kind = classes()[points]
    space = kind == SPACE
    blank = space | (kind == BLANK)
    ends = np.zeros(n + 1, bool)  # a text starts here, or all ends
    ends[firsts] = True
    ends[n] = True
    last = blank.copy()
    last[:-1] &= ~blank[1:]
    last &= ~ends[1:]  # white space at the very end of a text stays whole
    kind[last & space] = SPACE_LAST
    kind[last & ~space] = BLANK_LAST
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        end = np.append(firsts[1:], n)[np.searchsorted(firsts, marks, "right") - 1]
        one = np.where(marks + 1 < end, points[np.minimum(marks + 1, n - 1)], 0)
        two = np.where(marks + 2 < end, points[np.minimum(marks + 2, n - 1)], 0)
        kind[marks[np.isin(one, _ONE)]] = CONTRACT_2
        kind[marks[np.isin(one.astype(np.int64) << 32 | two, _TWO)]] = CONTRACT_3
    return _decide(kind, firsts, n)


_ONE = np.array([ord(c) for c in "stmd"])
_TWO = np.array([ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])


def _decide(kind: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """Run the automaton; an EDGE goes before each text but the first, so that it starts at a token's end."""
    if not n:
        return np.zeros(0, np.int64)
    inner = firsts[1:]
    place = np.arange(n) + np.searchsorted(inner, np.arange(n), "right") if len(inner) else np.arange(n)
    stream = np.full(n + len(inner), EDGE, np.uint8)
    stream[place] = kind
    state = AT_DONE[scan(FUNCTIONS[stream])]
    before = np.empty_like(state)
    before[0] = DONE
    before[1:] = state[:-1]
    return np.flatnonzero(STARTS[before, stream][place])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class ByteBPE:
    """Encoder and decoder of one rank file. Cached pieces are bounded in number and in bytes."""

    def __init__(self, ranks: dict[bytes, int], most: int = 250_000, most_bytes: int = 8 << 20):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.size = max(self.token) + 1
        pairs = {}
        for merged, rank in ranks.items():
            for cut in range(1, len(merged)):
                a, b = ranks.get(merged[:cut]), ranks.get(merged[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.append(np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64), self.size)
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.lengths = np.zeros(self.size, np.int64)
        self.lengths[list(self.token)] = [len(b) for b in self.token.values()]
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.pieces: list[list[int]] = []
        self.digits: list[bytes] = []
        self.held = 0

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of merging a and b, `size` if they do not merge."""
        key = a * self.size + b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.size) if len(self.pair_keys) else np.full(len(key), self.size)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: whole if it is a token, else merged by lowest rank, leftmost first."""
        out: list[list[int]] = [[]] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > 64:
                out[i] = self.merge_long(p)
            else:
                groups.setdefault(8 if len(p) <= 8 else 16 if len(p) <= 16 else 64, []).append(i)
        for width, at in groups.items():
            for low in range(0, len(at), 8192):
                for i, ids in zip(at[low : low + 8192], self._merge_all([pieces[i] for i in at[low : low + 8192]], width)):
                    out[i] = ids
        return out

    def _merge_all(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        none = self.size
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = self.byte_ids[raw]
        column = np.arange(width)
        ids[column >= length[:, None]] = -1
        rank = np.full((n, width), none, np.int64)  # of merging with the next
        ok = column[:-1] < length[:, None] - 1
        rank[:, :-1][ok] = self.ranks_of(ids[:, :-1][ok], ids[:, 1:][ok])
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            go = best < none
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            shift = column + (column > at[:, None])
            shift[:, -1] = np.minimum(shift[:, -1], width - 1)
            new = np.take_along_axis(ids[live], shift, 1)
            new[:, -1] = -1
            moved = np.take_along_axis(rank[live], shift, 1)
            moved[:, -1] = none
            row = np.arange(len(live))
            new[row, at] = best
            length[live] -= 1
            right = np.minimum(at + 1, width - 1)
            has = at + 1 < length[live]
            moved[row, at] = np.where(has, self.ranks_of(best, np.maximum(new[row, right], 0)), none)
            left = np.maximum(at - 1, 0)
            moved[row, left] = np.where(at > 0, self.ranks_of(new[row, left], best), moved[row, left])
            ids[live], rank[live] = new, moved
        return [row[:k] for row, k in zip(ids.tolist(), length.tolist())]

    def merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs, for pieces of any length."""
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, token = self.ranks, self.token

        def rank(i):
            j = after[i]
            return None if j >= n else ranks.get(token[ids[i]] + token[ids[j]])

        heap = [(r, i, ids[i], ids[after[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            if ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (q := rank(k)) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]

    def numbered(self, pieces: list[bytes]) -> list[int]:
        """Numbers of pieces in self.pieces, which are valid until the next call."""
        if len(self.numbers) > self.most or self.held > self.most_bytes:
            self.clear()
        numbers = self.numbers
        before = len(numbers)
        got = [numbers.setdefault(p, len(numbers)) for p in pieces]
        if len(numbers) > before:
            new = list(numbers)[before:]
            ids = self.merge(new)
            self.held += sum(map(len, new))
            self.pieces.extend(ids)
            self.digits.extend([b",".join([b"%d" % i for i in x]) for x in ids])
        return got

    def split(self, texts: list[str | None]) -> list[list[bytes]]:
        """The pieces of each text."""
        joined = "".join(t or "" for t in texts)
        sizes = offsets([len(t or "") for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = joined.encode()
        starts = token_starts(points, np.unique(sizes[:-1][np.diff(sizes) > 0]))
        if len(raw) == len(points):
            at = starts
        else:
            octets = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = (np.cumsum(octets) - octets)[starts]
        edges = [*at.tolist(), len(raw)]
        every = [raw[a:b] for a, b in zip(edges, edges[1:])]
        cut = np.searchsorted(starts, sizes).tolist()
        return [every[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        found = self.split(texts)
        number = self.numbered([p for ps in found for p in ps])
        cut = offsets([len(ps) for ps in found]).tolist()
        held = self.pieces
        return [[i for k in number[a:b] for i in held[k]] for a, b in zip(cut, cut[1:])]

    def digest(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(count of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes decoded from the ids) of each text."""
        found = self.split(texts)
        number = self.numbered([p for ps in found for p in ps])
        cut = offsets([len(ps) for ps in found]).tolist()
        held, digits, out = self.pieces, self.digits, []
        for a, b in zip(cut, cut[1:]):
            own = number[a:b]
            ids = [i for k in own for i in held[k]]
            out.append((len(ids), hashlib.sha256(b",".join([digits[k] for k in own])).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def starts(self, ids: list[int]) -> list[int]:
        """Byte offset of each token in the decoded bytes."""
        return (np.cumsum(self.lengths[ids]) - self.lengths[ids]).tolist() if ids else []


_LOADED: dict[str, ByteBPE] = {}


def loaded(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(load_ranks(path))
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, all if None) with ids and offsets (byte start of each token). path: a rank file that every worker can read."""
    added = {"ids": "array<int>", "offsets": "array<int>"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs = docs.select(*named(dict.fromkeys([*kept, text])))

    def make():
        codec = loaded(path)

        def add(part: pa.Table) -> pa.Table:
            ids = codec.encode(part.column(text).to_pylist())
            return part.select(kept).append_column("ids", pa.array(ids, pa.list_(pa.int32()))).append_column("offsets", pa.array([codec.starts(x) for x in ids], pa.list_(pa.int32())))

        return add

    return map_slices(docs, make, declared(docs.select(*named(kept)), added), text)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`, the bytes of its ids (null ids: none)."""
    kept = [c for c in encoded.columns if c != "decoded"]

    def make():
        codec = loaded(path)

        def add(part: pa.Table) -> pa.Table:
            return part.select(kept).append_column("decoded", pa.array([codec.decode(x or []) for x in part.column(ids).to_pylist()], pa.binary()))

        return add

    return map_slices(encoded.select(*named(kept)), make, declared(encoded.select(*named(kept)), {"decoded": "binary"}), None)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256: encodes and decodes without moving the ids out of the worker."""
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    docs = docs.select(*named(dict.fromkeys([*kept, text])))

    def make():
        codec = loaded(path)

        def add(part: pa.Table) -> pa.Table:
            found = codec.digest(part.column(text).to_pylist())
            part = part.select(kept)
            for k, (name, kind) in enumerate((("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()))):
                part = part.append_column(name, pa.array([x[k] for x in found], kind))
            return part

        return add

    return map_slices(docs, make, declared(docs.select(*named(kept)), added), text)
