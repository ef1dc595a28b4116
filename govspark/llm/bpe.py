"""Byte-level BPE by a public rank file: encoding with offsets, and decoding.

A text is cut into pieces by a small automaton over codepoint classes. Each class is a transition function; the functions
form a finite monoid, so that "compose with the one on the left" is one table lookup, and a doubling scan over the
functions gives the state after every character without walking through the text. A scan entry that has become a
constant needs no more steps, which after two or three rounds holds for all. The cuts follow from the states on either
side. Equal pieces are merged once: Arrow's dictionary finds the distinct pieces of a batch, and merges are cached.

Defined results: a null text is empty; an empty text has no tokens; rows keep their other columns, and columns with
the names of the results are replaced. Very long pieces are merged with a heap, in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from govspark.llm.words import map_texts, parts, text_buffers

#: Merges that are kept in a worker.
CACHE_PIECES = 300_000
#: Bytes of a piece beyond which it is merged alone, with a heap.
LONG_PIECE = 100
NO_MERGE = np.iinfo(np.int64).max

# Classes of codepoints. The contractions 's 't 'm 'd 're 've 'll and Unicode's white space.
OTHER, BLANK, SPACE, NUMBER, LETTER, QUOTE, L_ONE, L_R, L_V, L_L, L_E = range(11)
WHITE_SPACE = (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States after a character. AP: a quote that begins a piece; AP_R, AP_V, AP_L: such a quote and the first letter of a
# contraction of two; DONE: a contraction is complete.
S_START, S_BLANK, S_SPACE, S_NUMBER, S_LETTER, S_OTHER, S_AP, S_AP_R, S_AP_V, S_AP_L, S_DONE = range(11)
STATES = 11


@cache
def codepoint_classes() -> np.ndarray:
    kinds = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            kinds[code] = LETTER
        elif major == "N":
            kinds[code] = NUMBER
    kinds[list(WHITE_SPACE)] = BLANK
    kinds[0x20] = SPACE
    kinds[ord("'")] = QUOTE
    kinds[[ord(c) for c in "stmd"]] = L_ONE
    for letter, kind in (("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E)):
        kinds[ord(letter)] = kind
    return kinds


def _step(kind: int, state: int) -> int:
    if kind == BLANK:
        return S_BLANK
    if kind == SPACE:
        return S_SPACE
    if kind == NUMBER:
        return S_NUMBER
    if kind == OTHER:
        return S_OTHER
    if kind == QUOTE:  # it begins a piece unless it goes on a run of signs or takes the space before it
        return S_OTHER if state in (S_SPACE, S_OTHER, S_AP) else S_AP
    if state == S_AP and kind in (L_ONE, L_R, L_V, L_L):
        return {L_ONE: S_DONE, L_R: S_AP_R, L_V: S_AP_V, L_L: S_AP_L}[kind]
    if (state, kind) in ((S_AP_R, L_E), (S_AP_V, L_E), (S_AP_L, L_L)):
        return S_DONE
    return S_LETTER


@cache
def transition_monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table [left, right], result [element, state], is the element constant)."""
    elements = [tuple(_step(kind, s) for s in range(STATES)) for kind in range(11)]
    elements = list(dict.fromkeys(elements))
    generators = [elements.index(tuple(_step(kind, s) for s in range(STATES))) for kind in range(11)]
    elements += [c for s in range(STATES) if (c := (s,) * STATES) not in elements]
    known = {e: i for i, e in enumerate(elements)}
    at = 0
    while at < len(elements):  # closed under composition on either side
        for other in range(at + 1):
            for a, b in ((at, other), (other, at)):
                both = tuple(elements[b][elements[a][s]] for s in range(STATES))
                if both not in known:
                    known[both] = len(elements)
                    elements.append(both)
        at += 1
    n = len(elements)
    table = np.empty((n, n), np.uint16)
    for a in range(n):
        for b in range(n):
            table[a, b] = known[tuple(elements[b][elements[a][s]] for s in range(STATES))]
    result = np.array(elements, np.uint8)
    return np.array(generators, np.uint16), table, result, (result == result[:, :1]).all(axis=1)


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin among the codepoints of several texts; ``first`` are the beginnings of non-empty texts."""
    if not len(codes):
        return np.empty(0, np.int64)
    kinds = codepoint_classes()[codes]
    generators, table, result, constant = transition_monoid()
    scan = generators[kinds]
    # the first character of a text knows its state: replace its function by the constant it gives
    to_constant = np.array([np.flatnonzero((result == s).all(axis=1))[0] for s in range(STATES)], np.uint16)
    scan[first] = to_constant[result[scan[first], S_START]]
    open_at = np.flatnonzero(~constant[scan])
    reach = 1
    while len(open_at):
        scan[open_at] = table[scan[open_at - reach], scan[open_at]]
        open_at = open_at[~constant[scan[open_at]]]
        reach *= 2
    state = result[scan, 0]

    before = np.empty_like(state)
    before[0] = S_START
    before[1:] = state[:-1]
    before[first] = S_START
    run = np.array([0, 1, 1, 2, 3, 4, 4, 3, 3, 3, 5], np.uint8)  # start, white, number, letter, sign, done
    kind_run = np.array([4, 1, 1, 2, 3, 4, 3, 3, 3, 3, 3], np.uint8)[kinds]
    starts = kind_run != run[before]
    # a letter after a quote that begins a piece: part of it only if the contraction gets complete
    starts[(state == S_DONE) & (before == S_AP)] = False
    pending = np.flatnonzero((state >= S_AP_R) & (state <= S_AP_L))
    following = np.minimum(pending + 1, len(state) - 1)
    complete = (pending + 1 < len(state)) & (state[following] == S_DONE) & (before[following] != S_START)
    starts[pending[complete]] = False
    # the last white space before other characters begins a piece, and a space takes what follows into it
    white = kind_run == 1
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[-1] = False
    last[first[1:] - 1] = False
    at = np.flatnonzero(last)
    starts[at] = True
    starts[at[kinds[at] == SPACE] + 1] = False
    starts[first] = True
    return np.flatnonzero(starts)


class Ranks:
    """A rank file with its merges. Merges of pieces seen before are kept: ``slots`` says where in ``flat``."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        tokens: list[bytes] = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        merges = {
            (self.ids[token[:i]] << 32) | self.ids[token[i:]]: rank
            for token, rank in self.ids.items()
            for i in range(1, len(token))
            if token[:i] in self.ids and token[i:] in self.ids
        }
        keys = np.fromiter(merges, np.int64, len(merges))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(merges.values(), np.int64, len(merges))[order]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.bounds = np.zeros(1, np.int64)
        self.flat = np.empty(0, np.int32)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_MERGE)

    def merged(self, pieces: list[bytes]) -> pa.LargeListArray:
        """The ids of each of some distinct pieces."""
        if len(self.slots) > CACHE_PIECES:
            self._forget()
        missing = [piece for piece in pieces if piece not in self.slots]
        short = [piece for piece in missing if len(piece) <= LONG_PIECE]
        if short:
            flat, sizes = self._merge_together(short)
            self.slots.update(zip(short, range(len(self.slots), len(self.slots) + len(short))))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        bounds, flat, long = self.bounds, self.flat, {}
        if len(short) < len(missing):  # a long piece is hardly met again, and is not kept
            found = {piece: _merge_long(piece, self.ids) for piece in missing if len(piece) > LONG_PIECE}
            long = dict(zip(found, range(len(self.slots), len(self.slots) + len(found))))
            bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([len(ids) for ids in found.values()])])
            flat = np.concatenate([flat, *(np.array(ids, np.int32) for ids in found.values())])
        kept = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat))
        places = map(self.slots.__getitem__, pieces) if not long else (self.slots[p] if p in self.slots else long[p] for p in pieces)
        return kept.take(pa.array(np.fromiter(places, np.int64, len(pieces))))

    def _merge_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each): one merge in every unfinished piece at a time, for all at once."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        token = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        rank = np.full(len(token), NO_MERGE)
        if len(token) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.pair_rank(token[inner], token[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(token))))
            going = best != NO_MERGE
            done.append((owner[~going], token[~going]))
            token, owner, rank, best = token[going], owner[going], rank[going], best[going]
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])] if len(at) else at
            token[at] = rank[at]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            token, owner, rank = token[stay], owner[stay], rank[stay]
            at -= np.arange(len(at))
            for changed in (at, at[at > 0] - 1):
                follower = np.minimum(changed + 1, len(token) - 1)
                inside = (follower > changed) & (owner[follower] == owner[changed])
                rank[changed] = np.where(inside, self.pair_rank(token[changed], token[follower]), NO_MERGE)
        if not done:
            return np.empty(0, np.int64), np.zeros(len(pieces), np.int64)
        owners, tokens = (np.concatenate(x) for x in zip(*done))
        return tokens[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(pieces))


def _merge_long(piece: bytes, ids: dict[bytes, int]) -> list[int]:
    """The same merges, lowest rank first and the leftmost of equals, kept in a heap beside a linked list."""
    n = len(piece)
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ids.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, left, stop = heapq.heappop(heap)
        if not alive[left] or (right := following[left]) >= n or following[right] != stop:
            continue
        following[left] = stop
        alive[right] = 0
        if stop < n:
            previous[stop] = left
            if (rank := ids.get(piece[left : following[stop]])) is not None:
                heapq.heappush(heap, (rank, left, following[stop]))
        if (before := previous[left]) >= 0 and (rank := ids.get(piece[before:stop])) is not None:
            heapq.heappush(heap, (rank, before, stop))
    out, at = [], 0
    while at < n:
        out.append(ids[piece[at : following[at]]])
        at = following[at]
    return out


_loaded: dict[str, Ranks] = {}


def load_ranks(path: str) -> Ranks:
    """Once in a worker process."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def encode_batch(texts: pa.Array, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, where each text begins in them)."""
    data, offsets = text_buffers(texts)
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
    if data.max() < 0x80:
        codes, at_byte = data, None
        first = offsets[:-1]
    else:
        codes = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(at_byte, offsets[:-1])
    filled = offsets[:-1] < offsets[1:]
    starts = piece_starts(codes, first[filled])
    if at_byte is not None:
        starts = at_byte[starts]
    cuts = np.append(starts, len(data))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    encoded = pieces.dictionary_encode()
    merged = ranks.merged(encoded.dictionary.to_pylist())
    indices = encoded.indices.to_numpy()
    sizes = np.diff(merged.offsets.to_numpy())[indices]
    ids = merged.take(encoded.indices).flatten().to_numpy()
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return ids, ends[np.searchsorted(starts, offsets)]


def decode_batch(ids: np.ndarray, offsets: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, where each begins)."""
    joined = ranks.tokens.take(pa.array(ids))
    cuts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(ids) else np.zeros(1, np.int64)
    raw = joined.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8), cuts[offsets]


def _same_columns(df: DataFrame, drop: tuple[str, ...], fields: list[T.StructField]) -> T.StructType:
    lowered = {name.lower() for name in drop}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in lowered] + fields)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", tokens: str = "tokens", starts: str = "token_starts") -> DataFrame:
    """All columns of ``docs``, the token ids of ``text`` and the byte at which each token begins in its UTF-8 form."""
    fields = [T.StructField(tokens, T.ArrayType(T.IntegerType(), False), False), T.StructField(starts, T.ArrayType(T.IntegerType(), False), False)]
    schema = _same_columns(docs, (tokens, starts), fields)
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        widths = pc.binary_length(ranks.tokens).to_numpy()
        for batch in batches:
            for part in parts(batch, text):
                ids, at = encode_batch(part.column(text), ranks)
                ends = np.concatenate([[0], np.cumsum(widths[ids])])
                place = ends[:-1] - np.repeat(ends[at[:-1]], np.diff(at))
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32))) for v in (ids, place)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + lists, names=[*kept, tokens, starts])

    return map_texts(docs.select(*{c: docs[c] for c in [*kept, text]}.values()) if text in kept else docs, run, schema)


def decode(docs: DataFrame, ranks_path: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the bytes that the ids stand for; null ids give no bytes."""
    schema = _same_columns(docs, (text,), [T.StructField(text, T.BinaryType(), False)])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        for batch in batches:
            lists = batch.column(tokens)
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, cuts = decode_batch(pc.list_flatten(lists).to_numpy(zero_copy_only=False), at, ranks)
            out = pa.array([data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, text])

    return docs.mapInArrow(run, schema)


def encode_verified(docs: DataFrame, ranks_path: str, kept: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``kept`` columns, n_tokens, tokens and decoded_sha256, a digest of the bytes that the ids give back.

    Encoding and decoding share one pass and one worker, and a part's ids are all that is held beside its text.
    """
    plain = docs.select(*(docs[c].alias(f"kept_{i}") for i, c in enumerate(kept)), docs[text].cast("string").alias("body"))
    fields = [T.StructField(f"kept_{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.IntegerType(), False), T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded_sha256", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        for batch in batches:
            for part in parts(batch):
                ids, at = encode_batch(part.column("body"), ranks)
                data, cuts = decode_batch(ids, at, ranks)
                data = memoryview(np.ascontiguousarray(data))
                digests = pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())
                tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(np.diff(at).astype(np.int32)), tokens, digests], names=schema.names)

    found = map_texts(plain, run, schema)
    return found.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)), "n_tokens", "tokens", "decoded_sha256")


def round_trip_digests(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of tokens and digests of its ids and of what they decode to.

    Ids are joined in bulk from a table of their decimal forms, so that no token costs a Python step.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(ranks_path)
        decimal = pa.array([f" {i}".encode() for i in range(len(ranks.tokens))], pa.large_binary())
        for batch in batches:
            for part in parts(batch, text):
                ids, at = encode_batch(part.column(text), ranks)
                data, cuts = decode_batch(ids, at, ranks)
                joined = decimal.take(pa.array(ids))
                marks = np.frombuffer(joined.buffers()[1], np.int64)[at] if len(ids) else np.zeros(len(at), np.int64)
                digits = memoryview(joined.buffers()[2]) if len(ids) else memoryview(b"")
                data = memoryview(np.ascontiguousarray(data))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key),
                        pa.array(np.diff(at)),
                        pa.array([hashlib.sha256(digits[a + 1 : b] if b > a else b"").hexdigest() for a, b in zip(marks, marks[1:])]),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]),
                    ],
                    names=schema.names,
                )

    return map_texts(docs.select(key, text), run, schema)
