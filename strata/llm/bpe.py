"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

Each word is a row of symbols. A tournament tree over the ranks of its adjacent pairs
has at its root the lowest rank, leftmost on ties; a merge changes at most three leaves,
so an update is logarithmic. Short words go through their trees in lockstep, one numpy
row each; a longer word gets a tree of its own.

Texts are cut into units as bytes, a window at a time: words, digits and runs of signs
where there is nothing but ASCII and Latin-1 letters, else whole chunks between white
space, whose words are found by the library's own normaliser and splitter. The different
units of a window are encoded once; those of before are remembered in a table of bounded
bytes per Python worker.

Nulls and empty texts encode to no ids; very long texts are encoded whole, a window at a
time; repeated rows each get their row; an empty table gives an empty one. A decoded id
outside the vocabulary is skipped. Columns besides the id and the text play no part.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The rank of a pair that does not merge; above all ranks, and with a place in a word still a 32-bit integer.
NONE = np.int32(1 << 23)
#: Bytes of remembered units in a Python worker, of the longest of them, and of text that is cut into units at once.
MEMORY, LONGEST, WINDOW = 8_000_000, 64, 1 << 22


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def byte_classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 sign, 4 anything beyond ASCII."""
    out = np.full(256, 3, np.uint8)
    out[[*range(9, 14), 32]] = 0
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[48:58] = 2
    out[128:] = 4
    return out


CLASS = byte_classes()
LOWER = np.array([b + 32 * (65 <= b <= 90) for b in range(256)], np.uint8)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `at` of flat, one after the other, and where each ends."""
    n = sizes[at]
    ends = np.cumsum(n)
    place = np.repeat(starts[at] - (ends - n), n)
    place += np.arange(len(place))
    return flat[place], ends


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts, and where each begins, then where the last ends; a null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[at[0] : at[-1]], at - at[0]) if len(at) else (raw[:0], np.zeros(1, np.int64))


def kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, where the two bytes of a Latin-1 letter are letters, and where such letters begin."""
    kind = CLASS[data]
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] & 0x9F != 0x97))
    kind[lead], kind[lead + 1] = 1, 1
    return kind, lead


def window_end(data: np.ndarray, begins: np.ndarray, here: int) -> int:
    """Where the window that begins here ends: at white space or at another text."""
    end = here + WINDOW
    if end >= len(data):
        return len(data)
    next_text = int(begins[np.searchsorted(begins, end)])
    while end < next_text:
        blank = np.flatnonzero(CLASS[data[end : min(end + WINDOW, next_text)]] == 0)
        if len(blank):
            return end + int(blank[0])
        end += WINDOW
    return next_text


def stretches(data: np.ndarray, solid: np.ndarray, start: np.ndarray) -> pa.Array:
    """The solid bytes of data, cut where start says, as an Arrow array."""
    kept = data[solid]
    ends = np.append(np.flatnonzero(start[solid]), len(kept)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(kept)])


def units(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units of a window, in lower case but for whole chunks, and where each begins; begins: where texts do."""
    (kind, lead), low = kinds(data), LOWER[data]
    low[lead + 1] |= np.where(data[lead + 1] < 0xA0, np.where(data[lead + 1] == 0x9F, 0, 0x20), 0).astype(np.uint8)
    solid = kind > 0
    chunk = solid.copy()
    chunk[1:] &= ~solid[:-1]
    begins = begins[begins < len(data)]
    chunk[begins] = solid[begins]
    start = chunk.copy()
    start[1:] |= solid[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    # 's, 't, 'm, 'd, 're, 've and 'll are words where the sign begins a word.
    sign = np.flatnonzero((data == 39) & start)
    sign = sign[sign + 1 < len(data)]
    if len(sign):
        sign = sign[~chunk[sign + 1]]
        one, two = low[sign + 1], low[np.minimum(sign + 2, len(data) - 1)]
        inside = (sign + 2 < len(data)) & ~chunk[np.minimum(sign + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        sign, size = sign[short | long], np.where(short, 2, 3)[short | long]
        start[sign + 1] = False
        after = sign + size
        after = after[after < len(data)]
        start[after] = solid[after]
    odd = kind == 4
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124) & ~chunk[1:]  # what may be a special token
    if odd.any():
        at = np.flatnonzero(chunk)
        whole = np.logical_or.reduceat(odd, at)
        inside = np.repeat(whole, np.diff(np.append(at, len(data))))
        start[at[0] :] = np.where(inside, chunk[at[0] :], start[at[0] :])
        low[at[0] :] = np.where(inside, data[at[0] :], low[at[0] :])
    return stretches(low, solid, start), np.flatnonzero(start)


def restarted(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some stretches of flat as an array of their own."""
    return gathered(flat, starts, sizes, np.arange(len(starts)))[0], np.cumsum(sizes) - sizes, sizes


class Units(NamedTuple):
    """Different units, and of each where its ids begin and how many they are."""

    names: pa.Array
    flat: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def none(cls) -> Units:
        return cls(pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def joined(self, more: Units) -> Units:
        return Units(pa.concat_arrays([self.names, more.names]), np.append(self.flat, more.flat), np.append(self.starts, len(self.flat) + more.starts), np.append(self.sizes, more.sizes))

    def held(self) -> int:
        return self.names.nbytes + self.flat.nbytes + self.starts.nbytes + self.sizes.nbytes


class WordBPE:
    """A lower-casing word vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_ids = {k.encode(): np.array([v], np.int32) for k, v in special.items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        model = {"type": "BPE", "vocab": {}, "merges": []}
        self.rules = Tokenizer.from_str(json.dumps({"version": "1.0", "normalizer": spec["normalizer"], "pre_tokenizer": split, "added_tokens": [], "model": model}))
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + self.end, -1) for c in letters], np.int32)
        pairs = np.array([(vocab[a] << 32 | vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], np.int64)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.keys, self.made, self.rank = pairs[order, 0], pairs[order, 1].astype(np.int32), order.astype(np.int32)
        self.result = pairs[:, 1].astype(np.int32)
        self.memory = Units.none()

    @functools.cached_property
    def places(self) -> np.ndarray:
        """The merge table by hash: the index of a key, at the first free place from its own on; -1 where free."""
        table = np.full(1 << 19, -1, np.int32)
        index, at = np.arange(len(self.keys), dtype=np.int32), self.place(self.keys)
        while len(index):
            free = table[at] < 0
            table[at[free]] = index[free]  # of several, the last stays; the others go on
            left = table[at] != index
            index, at = index[left], at[left] + 1 & (1 << 19) - 1
        return table

    @staticmethod
    def place(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair (NONE: not mergeable)."""
        key = left.astype(np.int64) << 32 | right
        at, table = self.place(key), self.places
        found = table[at]
        other = np.flatnonzero((found >= 0) & (self.keys[found] != key))
        while len(other):
            at.flat[other] = at.flat[other] + 1 & (1 << 19) - 1
            found.flat[other] = table[at.flat[other]]
            other = other[(found.flat[other] >= 0) & (self.keys[found.flat[other]] != key.flat[other])]
        return np.where(found >= 0, self.rank[found], NONE)

    def merged(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, one word's after the other's, and how many each has; words are stretches of data."""
        flats, counts, order = [], [], []
        for least, width in ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            step = 1 << 17 >> width.bit_length()
            for i in range(0, len(some), step):
                part = some[i : i + step]
                for out, x in zip((flats, counts), self.lockstep(data, starts[part], sizes[part], width)):
                    out.append(x)
                order.append(part)
        for k in np.flatnonzero(sizes > 64):
            flats.append(self.alone(data[starts[k] : starts[k] + sizes[k]].tobytes()))
            counts.append(np.array([len(flats[-1])]))
            order.append(np.array([k]))
        if not order:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        count = np.concatenate(counts)
        at = np.empty(len(sizes), np.int64)
        at[np.concatenate(order)] = np.arange(len(sizes))
        return gathered(np.concatenate(flats), np.cumsum(count) - count, count, at)[0], count[at]

    def lockstep(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(starts), sizes[:, None]
        at = np.arange(width, dtype=np.int32)
        raw = data[np.minimum(starts[:, None] + at, len(data) - 1)]
        ids = np.where(at == size - 1, self.last[raw], self.inner[raw])
        ids[at >= size] = -1
        bits = width.bit_length()
        tree = np.full((n, 2 * width), NONE << bits, np.int32)
        tree[:, width : 2 * width - 1] = self.pair(ids[:, :-1], ids[:, 1:]) << bits | at[:-1]
        for k in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        tree = tree.ravel()
        # A word has width + 2 places, of which the first and the last hold no symbol: nothing merges with them.
        wide = width + 2
        ids = np.pad(ids, ((0, 0), (1, 1)), constant_values=-1).ravel()
        place = np.arange(n * wide, dtype=np.int32)
        nxt, prv = place + 1, place - 1
        nxt[np.arange(n) * wide + sizes] = np.arange(n) * wide + width + 1
        live = np.arange(n, dtype=np.int32)
        while True:
            top = tree[live * (2 * width) + 1]
            going = top >> bits < NONE
            if not going.all():
                live, top = live[going], top[going]
            if not len(live):
                break
            first, root = live * wide + 1, live * (2 * width)
            here = first + (top & (1 << bits) - 1)
            gone = nxt[here]
            after, before = nxt[gone], prv[here]
            ids[here], ids[gone] = self.result[top >> bits], -1
            nxt[here], prv[after] = after, here
            ranks = self.pair(ids[np.concatenate([here, before])], ids[np.concatenate([after, here])])
            leaf = np.concatenate([gone, here, np.maximum(before, first)]) - np.concatenate([first, first, first])
            rank = np.concatenate([np.full(len(live), NONE, np.int32), ranks])
            none = np.flatnonzero(before < first)
            rank[2 * len(live) + none] = ranks[none]  # the first symbol has none before it: its own leaf again
            # The leaves of the three pairs that change, then the nodes above them, level by level.
            root, node = np.concatenate([root, root, root]), width + leaf
            tree[root + node] = rank << bits | leaf
            for _ in range(bits - 1):
                node = node >> 1
                low = root + 2 * node
                tree[root + node] = np.minimum(tree[low], tree[low + 1])
        ids = ids.reshape(n, wide)
        real = ids >= 0
        return ids[real], real.sum(1)

    def alone(self, raw: bytes) -> bytes:
        """One long word."""
        n = len(raw)
        first = self.inner[np.frombuffer(raw, np.uint8)].astype(np.int64)
        first[-1] = self.last[raw[-1]]
        ids = array("q", first.tobytes())
        width = 1 << (n - 1).bit_length()
        bits, none = width.bit_length(), int(NONE)
        leaves = np.full(width, none, np.int64)
        leaves[: n - 1] = self.pair(first[:-1], first[1:])
        levels = [leaves << bits | np.arange(width)]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = array("q", np.concatenate([np.zeros(1, np.int64), *reversed(levels)]).tobytes())
        nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        table = self.table

        def put(leaf: int, rank: int) -> None:
            node = leaf + width
            tree[node] = rank << bits | leaf
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] >> bits < none:
            here = tree[1] & (1 << bits) - 1
            gone = nxt[here]
            ids[here], ids[gone] = int(self.made[table[ids[here] << 32 | ids[gone]]]), -1
            after = nxt[here] = nxt[gone]
            put(gone, none)
            put(here, self.ranked(ids[here], ids[after]) if after < n else none)
            if after < n:
                prv[after] = here
            if (before := prv[here]) >= 0:
                put(before, self.ranked(ids[before], ids[here]))
        found = np.frombuffer(ids, np.int64)
        return found[found >= 0].astype(np.int32)

    @functools.cached_property
    def table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), range(len(self.keys))))

    def ranked(self, left: int, right: int) -> int:
        at = self.table.get(left << 32 | right)
        return int(NONE) if at is None else int(self.rank[at])

    def parts(self, unit: bytes) -> list[bytes]:
        """The words of a unit that is a whole chunk, special tokens as they are."""
        out: list[bytes] = []
        for k, text in enumerate(self.special.split(unit.decode()) if self.special else [unit.decode()]):
            if k & 1:
                out.append(text.encode())
            elif text:
                out += [w.encode() for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))]
        return out

    def learnt(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the different units, and where each unit's begin and how many they are."""
        names, old = coded.dictionary, self.memory
        at = pc.index_in(names, old.names).fill_null(-1).to_numpy()
        new = np.flatnonzero(at < 0)
        data, ends = text_buffers(names)
        starts, sizes = ends[:-1], np.diff(ends)
        kind, _ = kinds(data)
        odd = kind == 4
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        whole = np.logical_or.reduceat(odd, starts) if len(starts) else odd  # units have at least a byte
        plain, chunks = new[~whole[new]], new[whole[new]]
        split = [self.parts(data[starts[k] : ends[k + 1]].tobytes()) for k in chunks.tolist()]
        words = list({w for ws in split for w in ws}.difference(self.special_ids))
        more = np.array([*map(len, words), 0], np.int64)[:-1]
        flat, count = self.merged(np.append(data, np.frombuffer(b"".join(words), np.uint8)), np.append(starts[plain], len(data) + np.cumsum(more) - more), np.append(sizes[plain], more))
        begin = np.cumsum(count) - count
        ids = dict(self.special_ids)
        for w, a, n in zip(words, begin[len(plain) :].tolist(), count[len(plain) :].tolist()):
            ids[w] = flat[a : a + n]
        rest = [np.concatenate([ids[w] for w in ws]) if ws else flat[:0] for ws in split]
        length = np.array([*map(len, rest), 0], np.int64)[:-1]
        first, n = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        base = len(old.flat) + len(flat)
        first[plain], n[plain] = len(old.flat) + begin[: len(plain)], count[: len(plain)]
        first[chunks], n[chunks] = base + np.cumsum(length) - length, length
        known = np.flatnonzero(at >= 0)
        first[known], n[known] = old.starts[at[known]], old.sizes[at[known]]
        flat = np.concatenate([old.flat, flat, *rest])
        again = np.bincount(coded.indices.to_numpy(), minlength=len(names)) > 1
        again[known] = False
        kept = np.flatnonzero(again & (sizes <= LONGEST))
        fresh = Units(names.take(pa.array(kept)), *restarted(flat, first[kept], n[kept]))
        both = old.joined(fresh)
        if both.held() > MEMORY:  # what is found again is learnt again
            both = fresh if fresh.held() <= MEMORY else Units.none()
        self.memory = both
        return flat, first, n

    def encoded(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as text_buffers() gives them, and where each text's begin, then where the last end."""
        out, at, done = [], [], 0
        here = 0
        while here < len(data):
            end = window_end(data, begins, here)
            own = begins[np.searchsorted(begins, here) : np.searchsorted(begins, end)] - here
            found, place = units(data[here:end], own)
            coded = found.dictionary_encode()
            flat, starts, sizes = self.learnt(coded)
            flat, ends = gathered(flat, starts, sizes, coded.indices.to_numpy())
            out.append(flat.astype("<u4"))
            at.append(np.append(0, ends)[np.searchsorted(place, own)] + done)
            done += len(flat)
            here = end
        at.append(np.full(len(begins) - sum(map(len, at)), done, np.int64))
        return np.concatenate([np.zeros(0, "<u4"), *out]), np.concatenate(at)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, at = self.encoded(*text_buffers(pa.array(texts, pa.string())))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


class Pieces:
    """What each id stands for, to decode with."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {i: t.encode() for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
        pieces = [known[i] + b" " if i in known else b"" for i in range(max(known) + 1)]
        self.sizes = np.array([*map(len, pieces), 0], np.int64)
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(pieces), np.uint8)

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids[at[0] : at[1]], ids[at[1] : at[2]], ...

        What the library's decode gives where a vocabulary names no decoder: its pieces
        with blanks between.
        """
        known = np.minimum(ids, len(self.sizes) - 1).astype(np.int64)
        data, ends = gathered(self.flat, self.starts, self.sizes, known)
        at = np.append(0, ends)[at]
        last = at[1:][at[1:] > at[:-1]] - 1  # the blank after each text's last piece
        return large_array(np.delete(data, last), at - np.searchsorted(last, at), pa.large_string())

    def decode(self, ids: bytes | None) -> str:
        found = np.frombuffer(ids or b"", "<u4")
        return self.decoded(found, np.array([0, len(found)]))[0].as_py()


def large_array(data: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow array of the stretches of data that end at `at`."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


@functools.cache
def vocabulary(path: str) -> WordBPE:
    """Of this Python process; read once."""
    return WordBPE(path)


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


#: Bytes of texts, and rows, that are worked on at once.
SLICE, ROWS = 1 << 22, 4096


def portions(column: pa.Array, rows: int = ROWS) -> Iterator[tuple[int, pa.Array]]:
    """A column of texts in slices of about SLICE bytes (at least a row), with the row at which each begins."""
    at = np.append(0, np.cumsum(pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64)))
    here = 0
    while here < len(column):
        end = min(max(int(np.searchsorted(at, at[here] + SLICE, "right")) - 1, here + 1), here + rows)
        yield here, column.slice(here, end - here)
        here = end


def slices(column: pa.Array, rows: int = 512):
    """A column in lists of a few rows and bytes, so that few texts are Python objects at once."""
    for _, part in portions(column, rows):
        yield part.to_pylist()


def joined(arrays, kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays([pa.array([], kind), *arrays])


def encoded(text: str | Column, path: str) -> Column:
    """Ids of a text column as binary: little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        bpe = vocabulary(path)
        return joined((packed_ids(*bpe.encoded(*text_buffers(part))) for _, part in portions(column)), pa.binary())

    return encode.asNondeterministic()(text)  # so that Spark runs it once


def packed_ids(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return large_array(ids, 4 * at, pa.large_binary()).cast(pa.binary())


def decoded(ids: str | Column, path: str) -> Column:
    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        known = pieces_of(path)
        return joined((known.decoded(np.frombuffer(b"".join(x or b"" for x in part), "<u4"), np.cumsum([0, *(len(x or b"") // 4 for x in part)])).cast(pa.string()) for part in slices(column)), pa.string())

    return decode.asNondeterministic()(ids)


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of docs (doc_id, text).

    One Python worker does both, and hands back few rows at a time.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = vocabulary(path), pieces_of(path)
        for batch in batches:
            for here, part in portions(batch.column(1)):
                ids, at = bpe.encoded(*text_buffers(part))
                yield pa.record_batch([batch.column(0).slice(here, len(part)), packed_ids(ids, at), known.decoded(ids, at).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: each document's ids and what they decode to, as digests.

    One row per row of documents; a null text counts as empty.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = round_trips(docs, public_tokenizers.path("word_bpe_49k.json"))
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
