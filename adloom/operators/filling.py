"""Filling of compiled templates, many products at a time.

A text is a row of pieces: literals and values of the product. All pieces of a batch are numbers of entries in one pool (the
literals, the products' values, drawn integers, filled hooks), so filling is a single gather: the gathered bytes lie in the order
of the texts already, and a text is where its first piece begins. Draws are the words of MD5 digests, made for a whole batch at
once; the blocks that only the product's seed fills are digested once per product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Items that a batch holds at a time, and the bounds of its products.
ITEMS, FEWEST, MOST = 64_000, 16, 2_048
#: Columns of one digest round: small enough for a core's cache.
DIGESTED = 16_384

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = (np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _compress(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """MD5 states (n, 4) after one more block (n, 64 bytes) each."""
    out = np.empty_like(state)
    for at in range(0, len(state), DIGESTED):
        first = state[at:at + DIGESTED].T
        words = np.ascontiguousarray(blocks[at:at + DIGESTED]).view("<u4").T.copy()
        a, b, c, d = (x.copy() for x in first)
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            np.add(f, words[_WORDS[i]], out=f)
            np.add(f, _SINES[i], out=f)
            np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
            np.left_shift(f, np.uint32(_TURNS[i]), out=f)
            np.bitwise_or(f, g, out=f)
            np.add(f, b, out=f)
            # The oldest state is free to hold the next value.
            a, b, c, d, f = d, f, b, c, a
        for k, x in enumerate((a, b, c, d)):
            np.add(first[k], x, out=out[at:at + DIGESTED, k])
    return out


def digests(seeds: list[bytes], tags: list[bytes]) -> np.ndarray:
    """The four 32-bit numbers of MD5(seed | tag) for every seed and tag: (seeds, tags, 4)."""
    longest = max(map(len, tags), default=0)
    if longest > 48:
        made = b"".join(hashlib.md5(s + b"|" + t, usedforsecurity=False).digest() for s in seeds for t in tags)
        return np.frombuffer(made, ">u4").reshape(len(seeds), len(tags), 4).astype(np.uint32)
    heads = [s + b"|" for s in seeds]
    sizes = np.array([len(h) for h in heads], np.int64)
    whole = sizes // 64
    state = np.tile(_START, (len(heads), 1))
    for k in range(int(whole.max(initial=0))):
        own = np.flatnonzero(whole > k)
        blocks = np.frombuffer(b"".join(heads[i][64 * k:64 * k + 64] for i in own), np.uint8).reshape(-1, 64)
        state[own] = _compress(state[own], blocks)
    ends = np.zeros((len(tags), longest + 1), np.uint8)
    for i, t in enumerate(tags):
        ends[i, :len(t) + 1] = np.frombuffer(t + b"\x80", np.uint8)
    tails = np.zeros((len(heads), len(tags), 128), np.uint8)
    for i, h in enumerate(heads):
        rest = np.frombuffer(h[64 * int(whole[i]):], np.uint8)
        tails[i, :, :len(rest)] = rest
        tails[i, :, len(rest):len(rest) + longest + 1] = ends
    sizes_of_tags = np.array([len(t) for t in tags], np.int64)
    bits = (sizes[:, None] + sizes_of_tags) * 8
    two = (sizes % 64)[:, None] + sizes_of_tags + 9 > 64
    numbers = tails.view("<u8")
    numbers[..., 7] |= np.where(two, 0, bits).astype(np.uint64)
    numbers[..., 15] |= np.where(two, bits, 0).astype(np.uint64)
    tails = tails.reshape(-1, 128)
    out = _compress(np.repeat(state, len(tags), axis=0), tails[:, :64])
    more = np.flatnonzero(two.ravel())
    if more.size:
        out[more] = _compress(out[more], tails[more, 64:])
    return out.byteswap().reshape(len(heads), len(tags), 4)


#: Kinds of pieces: a literal; a value of the product; an integer; a hook.
LITERAL, VALUE, NUMBER, HOOK = range(4)


@dataclass(frozen=True)
class Piece:
    """Part of a text. ``value`` is a literal's text or the product's list; ``word`` of the digest of ``tag`` picks, where something is drawn."""

    kind: int
    value: str | int = ""
    tag: int = -1
    word: int = -1
    lo: int = 0
    hi: int = 0


@dataclass
class Texts:
    """One text per item. A text of several forms has a number that is drawn (digest of ``tag``, word 3)."""

    pool: dict[str, int]
    pieces: list[Piece] = field(default_factory=lambda: [Piece(LITERAL)])
    numbers: dict[Piece, int] = field(default_factory=lambda: {Piece(LITERAL): 0})
    base: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    several: list[tuple[int, int, list[int]]] = field(default_factory=list)

    def _number(self, p: Piece) -> int:
        if p not in self.numbers:
            self.numbers[p] = len(self.pieces)
            self.pieces.append(p)
        return self.numbers[p]

    def add(self, forms: list[list[Piece]], tag: int) -> None:
        self.starts.append(len(self.base))
        for k in range(max(1, *map(len, forms))):
            own = [self._number(f[k]) if k < len(f) else 0 for f in forms]
            if len(set(own)) > 1:
                self.several.append((len(self.base), tag, own))
            self.base.append(own[0])

    def close(self) -> None:
        of = lambda f, kind=np.int64: np.array([f(p) for p in self.pieces], kind)
        self.kind = of(lambda p: p.kind)
        self.source = of(lambda p: self.pool.setdefault(p.value, len(self.pool)) if p.kind == LITERAL else p.value if p.kind == VALUE else 0)
        self.tag, self.word, self.lo, self.span = of(lambda p: p.tag), of(lambda p: p.word), of(lambda p: p.lo), of(lambda p: p.hi - p.lo + 1)
        self.row, self.first = np.array(self.base, np.int64), np.array(self.starts, np.int64)
        fixed = np.ones(len(self.row), bool)
        fixed[[q for q, *_ in self.several]] = False
        at = lambda test: np.flatnonzero(fixed & test(self.row))
        drawn = self.word >= 0
        self.values = at(lambda p: (self.kind[p] == VALUE) & ~drawn[p])
        self.draws = at(lambda p: (self.kind[p] == VALUE) & drawn[p])
        self.integers, self.quotes = at(lambda p: self.kind[p] == NUMBER), at(lambda p: self.kind[p] == HOOK)
        most = max((len(own) for *_, own in self.several), default=1)
        self.open = np.array([q for q, *_ in self.several], np.int64)
        self.open_tag = np.array([t for _, t, _ in self.several], np.int64)
        self.open_forms = np.array([len(own) for *_, own in self.several], np.int64)
        self.forms = np.array([own + [0] * (most - len(own)) for *_, own in self.several], np.int64).reshape(-1, most)
        del self.pieces, self.numbers, self.base, self.starts, self.several

    def fill(self, b: "Batch") -> pa.StringArray:
        """The texts of all products, product by product."""
        n, width = b.n, len(self.row)
        at = np.tile(np.where(self.kind[self.row] == LITERAL, self.source[self.row], b.empty), (n, 1))
        p = self.row[self.values]
        at[:, self.values] = b.start[:, self.source[p]]
        p = self.row[self.draws]
        at[:, self.draws] = b.start[:, self.source[p]] + b.words[:, self.tag[p], self.word[p]] % b.size[:, self.source[p]]
        extra = []
        if self.integers.size:
            p = self.row[self.integers]
            self._integers(b, at, (slice(None), self.integers), self.lo[p] + b.words[:, self.tag[p], self.word[p]] % self.span[p], extra)
        if self.quotes.size:
            p = self.row[self.quotes]
            at[:, self.quotes] = b.quote(np.arange(n)[:, None], b.words[:, self.tag[p], self.word[p]])
        if self.open.size:
            self._open(b, at, extra)
        gathered = pa.concat_arrays([b.pool, *extra]).take(pa.array(at.ravel()))
        _, offsets, data = gathered.buffers()
        ends = np.frombuffer(offsets, np.int32, n * width + 1)
        bounds = (np.arange(n)[:, None] * width + self.first).ravel()
        found = np.append(ends[bounds], ends[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(bounds), pa.py_buffer(found), data if data is not None else pa.py_buffer(b""))

    def _open(self, b: "Batch", at: np.ndarray, extra: list) -> None:
        """Pieces of texts with several forms."""
        drawn = b.words[:, self.open_tag, 3] % self.open_forms
        p = self.forms[np.arange(len(self.open)), drawn]
        kind, source, word = self.kind[p], self.source[p], self.word[p]
        rows, columns = np.arange(b.n)[:, None], np.broadcast_to(self.open, p.shape)
        number = b.words[rows, np.maximum(self.tag[p], 0), np.maximum(word, 0)] if b.words.size else np.zeros(p.shape, np.int64)
        own = np.where(kind == VALUE, source, 0)
        value = b.start[rows, own] + np.where(word >= 0, number % b.size[rows, own], 0) if b.start.shape[1] else source
        at[:, self.open] = np.where(kind == LITERAL, source, np.where(kind == VALUE, value, b.empty))
        i, j = np.nonzero(kind == NUMBER)
        if i.size:
            self._integers(b, at, (i, columns[i, j]), self.lo[p[i, j]] + number[i, j] % self.span[p[i, j]], extra)
        i, j = np.nonzero(kind == HOOK)
        if i.size:
            at[i, columns[i, j]] = b.quote(i, number[i, j])

    @staticmethod
    def _integers(b: "Batch", at: np.ndarray, where: tuple, numbers: np.ndarray, extra: list) -> None:
        found, number = np.unique(numbers, return_inverse=True)
        at[where] = len(b.pool) + sum(map(len, extra)) + number.reshape(numbers.shape)
        extra.append(pc.cast(pa.array(found), pa.string()))


@dataclass
class Batch:
    """Products that are filled together. ``start`` and ``size`` of their lists are in the pool; a list without values is the empty text."""

    n: int
    words: np.ndarray
    pool: pa.StringArray
    empty: int
    start: np.ndarray
    size: np.ndarray
    hooks: int = 0
    hooks_at: int = 0

    def quote(self, product: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self.hooks_at + product * self.hooks + number % self.hooks


class Items:
    """Compiled items: their names, their texts by column, and the attributes that some texts fill."""

    def __init__(self, pool: dict[str, int], fields: list[str]):
        self.fields, self.pool = fields, pool
        self.texts = {x: Texts(pool) for x in (*fields, "values") if x in ("title", "text", "detail", "values")}
        self.names: dict = {x: [] for x in fields if x in ("module", "item_group")}
        self.ords: list[int] = []
        self.keys: list[int] = []
        self.counts: list[int] = []

    def add(self, names: dict[str, str], number: int, texts: dict[str, list[list[Piece]]], attrs: list[tuple[str, list[list[Piece]]]], tag: int) -> None:
        for x, own in self.names.items():
            own.append(self.pool.setdefault(names[x], len(self.pool)))
        self.ords.append(number)
        for x, own in self.texts.items():
            if x != "values":
                own.add(texts[x], tag)
        if "attrs" in self.fields:
            self.counts.append(len(attrs))
            for key, forms in attrs:
                self.keys.append(self.pool.setdefault(key, len(self.pool)))
                self.texts["values"].add(forms, tag)

    def close(self) -> "Items":
        for own in self.texts.values():
            own.close()
        return self

    def fill(self, b: Batch, types: pa.StructType) -> pa.StructArray:
        n, size = b.n, len(self.ords)
        columns = []
        for f in types:
            if f.name == "ord":
                columns.append(pa.array(np.tile(np.array(self.ords, np.int32), n)))
            elif f.name in self.names:
                columns.append(b.pool.take(pa.array(np.tile(np.array(self.names[f.name], np.int64), n))))
            elif f.name == "attrs":
                ends = np.concatenate([[0], np.cumsum(np.tile(np.array(self.counts, np.int64), n))]).astype(np.int32)
                keys = b.pool.take(pa.array(np.tile(np.array(self.keys, np.int64), n)))
                values = self.texts["values"].fill(b) if self.keys else pa.array([], pa.string())
                columns.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, values).cast(f.type) if not self.keys else
                               pa.Array.from_buffers(f.type, n * size, [None, pa.py_buffer(ends)], children=[pa.StructArray.from_arrays([keys, values], fields=[f.type.key_field, f.type.item_field])]))
            else:
                columns.append(self.texts[f.name].fill(b))
        return pa.StructArray.from_arrays(columns, fields=list(types))


class Sheet:
    """Everything that a worker needs to fill the items of products.

    ``groups`` are the numbers of items in each list of the result. ``hooks`` are the product's hooks, for texts that quote one and
    for the drawn variants, of which there are ``kept`` with the names and the detail in ``shown``.
    """

    def __init__(self, pool: dict[str, int], items: Items, groups: list[int], tags: list[str], hooks: Items | None, quoted: bool, kept: int, shown: dict[str, str], order: list[int]):
        self.literals = pa.array(list(pool), pa.string())
        self.items, self.groups, self.tags, self.hooks = items, groups, [t.encode() for t in tags], hooks
        self.quoted, self.kept, self.shown, self.order = quoted, kept, shown, order

    def batches(self, chunks: Iterator[tuple[pa.Array, pa.Array]], out: pa.DataType) -> Iterator[pa.Array]:
        each = max(FEWEST, min(MOST, ITEMS // max(1, len(self.items.ords) + (len(self.hooks.ords) if self.hooks else 0))))
        for seeds, lists in chunks:
            for at in range(0, len(seeds), each):
                yield self.fill(seeds.slice(at, each), lists.slice(at, each), out)
            if not len(seeds):
                yield pa.array([], out)

    def _batch(self, seeds: pa.Array, lists: pa.Array) -> Batch:
        n = len(seeds)
        words = digests([(s or "").encode() for s in seeds.to_pylist()], self.tags) if self.tags else np.zeros((n, 0, 4), np.uint32)
        inner = lists.flatten()
        values = inner.flatten().cast(pa.string())
        several = len(inner) // n
        size = pc.list_value_length(inner).fill_null(0).to_numpy(zero_copy_only=False).reshape(n, several).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size.ravel())[:-1]]).reshape(n, several) if several else size
        pool = pa.concat_arrays([self.literals, values.fill_null("")])
        empty = self.literals.index("").as_py()
        return Batch(n, words.astype(np.int64), pool, empty, np.where(size > 0, start + len(self.literals), empty), np.maximum(size, 1))

    def fill(self, seeds: pa.Array, lists: pa.Array, out: pa.StructType) -> pa.StructArray:
        b = self._batch(seeds, lists)
        item = out.field("groups").type.value_type.value_type
        hooks = None
        if self.hooks is not None:
            own = item if self.kept else pa.struct([pa.field("text", pa.string())])
            hooks = self.hooks.fill(b, own)
        if self.quoted:
            quoted = hooks.field("text")
            b = Batch(b.n, b.words, pa.concat_arrays([b.pool, quoted]), b.empty, b.start, b.size, len(self.hooks.ords), len(b.pool))
        items = self.items.fill(b, item)
        ends = np.concatenate([[0], np.cumsum(np.tile(np.array(self.groups, np.int64), b.n))]).astype(np.int32)
        inner = pa.ListArray.from_arrays(pa.array(ends), items, type=out.field("groups").type.value_type)
        each = (np.arange(b.n + 1) * len(self.groups)).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array(each), inner, type=out.field("groups").type)]
        if self.kept:
            columns.append(self._variants(b, hooks, out.field("hooks").type))
        return pa.StructArray.from_arrays(columns, fields=list(out))

    def _variants(self, b: Batch, hooks: pa.StructArray, out: pa.ListType) -> pa.ListArray:
        """Hooks without repeats, in the order of the digests of their places."""
        w = b.words[:, self.order].astype(np.uint64)
        high, low = (w[..., 0] << np.uint64(32)) | w[..., 1], (w[..., 2] << np.uint64(32)) | w[..., 3]
        ranked = np.lexsort((low, high), axis=1)[:, :self.kept]
        kept = ranked.shape[1]
        drawn = pa.array((np.arange(b.n)[:, None] * len(self.order) + ranked).ravel())
        columns = [pa.repeat(pa.scalar(self.shown[f.name], f.type), b.n * kept) if f.name in self.shown else hooks.field(f.name).take(drawn) for f in out.value_type]
        items = pa.StructArray.from_arrays(columns, fields=list(out.value_type))
        return pa.ListArray.from_arrays(pa.array((np.arange(b.n + 1) * kept).astype(np.int32)), items, type=out)
