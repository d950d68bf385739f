"""Repeated passages: bytes covered by a string of ``match`` bytes that also starts in a document of smaller id.

The suffixes of all texts are dealt out so that equal strings of ``match`` bytes meet in one task, and each task merges Burrows-Wheeler
transforms of its shards:

1. Every window of ``match`` bytes has an anchor, the leftmost of its ``GRAM``-byte strings with the least hash; neighbouring windows
   that share an anchor are a piece. Equal windows have equal anchors at equal places, so only pieces of equal anchors can hold equal
   windows.
2. Equal pieces are combined inside tasks first and then by anchor: in every document but the smallest one all their windows are repeated.
   What is left is one copy of each different piece. Two pieces of an anchor can share a window only if they agree in the
   half of the window before the anchor or in the half behind it; those halves are the keys of the shards.
3. Each shard's suffix array is sorted alone. The transforms of the shards of a task are merged by iterative interleave refinement: the order
   of rows by h - 1 symbols, dealt stably by the symbol that stands before each row, is their order by h symbols. No suffix is compared or
   sorted again. A row that gets into another block than its predecessor in step h has a common prefix of h - 1 symbols with it,
   so the refinement yields the common prefixes as it goes; runs of rows with a common prefix of ``match`` are the repeated intervals.
4. A window is repeated if its interval holds a document of smaller id. Windows become spans of their document, which are cut out.

A key whose pieces do not fit (more than ``HEAVY``: the end of a passage that very many documents go on from differently) is dealt out by
its single windows instead, whose smallest documents are found by grouping. Long texts are cut into overlapping stretches. Pieces are
compared by 96 bits of hashes of their bytes, everything after that by the bytes.

Defined results: null texts are empty; texts shorter than ``match`` have no window. Rows of null ids neither lose bytes nor make others lose
any. Rows of equal ids are copies of one document and take nothing from each other. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import need
from adloom.llm.minhash import M1, SEED, mixed
from adloom.session import shared_dir, staged

MATCH = 50
GRAM = 12
#: Bytes of text that are hashed at a time; longer texts are cut into stretches of as many windows.
STRETCH = 1 << 20
#: Rows that a task groups at a time, bytes whose transforms it merges at a time, pieces of a key that are merged at most.
ROWS, MERGED, HEAVY = 1 << 17, 1 << 19, 20_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * SEED) | np.uint64(1)

#: Rows are narrow, since there is one for about every 20 bytes of text. ``at`` packs where a piece is: its first window, then 7 bits each for
#: the number of windows and the anchor's distance. Runs of repeated windows have no anchor: ``x`` is their length, ``at`` is negative.
PIECE = pa.schema([("h", pa.int32()), ("x", pa.int64()), ("at", pa.int64()), ("d", pa.int64()), ("t", pa.int32())])
FOUND = pa.schema([("d", pa.int64()), ("t", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("lead", pa.int32()), ("alone", pa.bool_())])
PART = pa.schema([("g", pa.int64()), ("d", pa.int64()), ("t", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])
MADE = pa.schema([("d", pa.int64()), ("t", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("window", pa.binary())])
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,last:long>>, kept binary"


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class _Hashes:
    """Hashes of any stretch of ``data``: a polynomial modulo 2 ** 64 from prefix sums; the base is odd, so it has an inverse."""
    up, down = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(self.up) <= len(data):
            _Hashes.up, _Hashes.down = _powers(len(data) + 1, BASE), _powers(len(data) + 1, np.uint64(pow(int(BASE), -1, 1 << 64)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * self.up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.down[:len(self.sums) - length]


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least hash among every ``width`` neighbours."""
    # The upper 40 bits of the mixed hash, then the place.
    least = ((hashes * M1) & ~np.uint64((1 << 24) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def pieces(data: np.ndarray, begin: np.ndarray, end: np.ndarray, match: int):
    """h, x, owner, start, n, anchor of the pieces of all texts data[begin:end], which follow each other. Starts count from the begin of ``data``.

    ``h`` has 32 bits of the anchor's hash. ``x`` has 16 bits each for the half of the window before and behind the anchor (0: the piece has no such
    windows), then 32 bits of all its bytes.
    """
    empty = tuple(np.empty(0, np.int64) for _ in range(6))
    if len(data) < match:
        return empty
    gram, half = min(GRAM, match), (match - min(GRAM, match)) // 2
    hashes = _Hashes(data)
    at = anchors(hashes.all(gram), match - gram + 1)
    last = end - match + 1  # behind the last window
    cuts = np.unique(np.concatenate([np.flatnonzero(at[1:] != at[:-1]) + 1, begin, np.maximum(last, begin)]))
    cuts = cuts[cuts < len(at)]
    stop = np.append(cuts[1:], len(at))
    owner = np.searchsorted(begin, cuts, "right") - 1
    # Empty texts share their begin with the next text; the last of them is the one that has windows.
    good = (owner >= 0) & (cuts < last[owner])
    start, owner, n = cuts[good], owner[good], (stop - cuts)[good]
    anchor = at[start]
    h = mixed(hashes.of(anchor, gram))
    before, behind = start <= anchor - half, start + n - 1 > anchor - half
    size = len(data)
    left = mixed(hashes.of(np.where(before, anchor - half, 0), min(half + gram, size)))
    width = match - half + 1  # of windows that begin less than half before the anchor
    right = mixed(hashes.of(np.where(behind, anchor, 0), min(width, size)) + SEED)
    short = lambda v, have: np.where(have, (v >> np.uint64(48)) % np.uint64(65535) + np.uint64(1), np.uint64(0))
    whole = mixed(hashes.of(start, n + match - 1) + n.astype(np.uint64) * SEED) >> np.uint64(32)
    x = (short(left, before) << np.uint64(48)) | (short(right, behind) << np.uint64(32)) | whole
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32), x.view(np.int64), owner, start, n, anchor


def _merged_runs(owner, start, n):
    """Owner, start, n of maximal runs of neighbouring windows; sorted by owner and start."""
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], (start + n)[order]
    if not len(owner):
        return owner, start, n
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] > stop[:-1])]
    first = np.flatnonzero(fresh)
    return owner[first], start[first], np.maximum.reduceat(stop, first) - start[first]


def _cut_up(match: int):
    """Pieces of whole texts: those that a smaller document in the same stretch repeats come as spans (n < 0)."""
    def stretch(data, begin, end, d, t, base):
        found = pieces(data, begin, end, match)
        order = np.lexsort((d[found[2]], found[1], found[0]))
        h, x, owner, start, n, anchor = (v[order] for v in found)
        ids = d[owner]
        fresh = np.r_[np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (x[1:] != x[:-1])]
        low = ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(h) else ids
        again = ids > low
        keep = np.sort(order[~again])  # in the order of the texts, where neighbouring rows resemble each other
        # Places are counted from the begin of the text.
        place = lambda o, s: s - begin[o] + base[o]
        o, s, k = _merged_runs(owner[again], start[again], n[again])
        h, x, owner, start, n, anchor = found
        at = (place(owner, start) << 14) | (n << 7) | (anchor - start)
        yield _batch(PIECE, h[keep], x[keep], at[keep], d[owner[keep]], t[owner[keep]])
        yield _batch(PIECE, t[o], k, -1 - place(o, s), d[o], t[o])

    def run(batches):
        np.seterr(over="ignore")  # hashing is arithmetic modulo 2 ** 64
        for batch in batches:
            if not batch.num_rows:
                continue
            text, d, t = batch.column("text"), _column(batch, "d"), _column(batch, "t")
            text = text.cast(pa.large_binary()) if text.type != pa.large_binary() else text
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset: text.offset + len(text) + 1]
            whole = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(text):
                upto = max(int(np.searchsorted(ends, ends[at] + STRETCH, "right")) - 1, at + 1)
                if ends[upto] - ends[at] <= STRETCH:
                    begin = ends[at:upto] - ends[at]
                    yield from stretch(whole[ends[at]: ends[upto]], begin, ends[at + 1: upto + 1] - ends[at], d[at:upto], t[at:upto], np.zeros(upto - at, np.int64))
                else:
                    for base in range(0, int(ends[upto] - ends[at]), STRETCH):
                        data = whole[ends[at] + base: min(ends[at] + base + STRETCH + match - 1, ends[upto])]
                        yield from stretch(data, np.zeros(1, np.int64), np.array([len(data)]), d[at:upto], t[at:upto], np.array([base]))
                at = upto
    return run


def _groups():
    """Over rows sorted by h, x, d: spans of pieces that a smaller document repeats, and single copies of pieces that may share windows with others."""
    def decide(rows, run, wide):
        """rows: columns of whole groups, or of a part of a wide group. run: (h, x, low) of the run that the rows may go on with."""
        h, x, at, d, t = rows
        start, n, lead = at >> 14, ((at >> 7) & 127).astype(np.int32), (at & 127).astype(np.int32)
        fresh = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])]
        first = np.flatnonzero(fresh)
        lows = d[first].copy()
        if run is not None and run[0] == h[0] and run[1] == x[0]:
            lows[0] = min(lows[0], run[2])
        nr = np.cumsum(fresh) - 1
        again = d > lows[nr]
        hs, xs = h[first], x[first].view(np.uint64)
        if wide:
            open_run = np.ones(len(first), bool)
        else:
            group = np.cumsum(np.r_[True, hs[1:] != hs[:-1]]) - 1
            begin = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
            several = (np.minimum.reduceat(lows, begin) < np.maximum.reduceat(lows, begin))[group]
            open_run = np.zeros(len(first), bool)
            for half in ((xs >> np.uint64(48)), (xs >> np.uint64(32)) & np.uint64(0xFFFF)):
                order = np.lexsort((half, group))
                same = (group[order][1:] == group[order][:-1]) & (half[order][1:] == half[order][:-1]) & (half[order][1:] > 0)
                open_run[order[1:][same]] = True
                open_run[order[:-1][same]] = True
            open_run &= several
        alone = open_run[nr] & ~again
        give = again | alone
        return _batch(FOUND, d[give], t[give], start[give], n[give], lead[give], alone[give]), (int(h[-1]), int(x[-1]), int(lows[-1]))

    def take(rows, keep):
        return tuple(v[keep] for v in rows)

    def groups(batches):
        held, size, run, wide = [], 0, None, None
        for batch in batches:
            rows = tuple(_column(batch, f.name) for f in PIECE)
            runs = rows[2] < 0
            if runs.any():
                _, k, at, d, t = take(rows, runs)
                yield _batch(FOUND, d, t, -1 - at, k.astype(np.int32), np.zeros(len(k), np.int32), np.zeros(len(k), bool))
                rows = take(rows, ~runs)
            held.append(rows)
            size += len(rows[0])
            if size < ROWS:
                continue
            rows = tuple(map(np.concatenate, zip(*held)))
            tail = rows[0] == rows[0][-1]
            if wide is not None and not (rows[0][0] == wide):
                wide = None
            if wide is not None:  # what goes on with a wide group
                same = rows[0] == wide
                found, run = decide(take(rows, same), run, True)
                yield found
                rows, tail = take(rows, ~same), tail[~same]
            if len(rows[0]) and tail.all():  # one group fills the buffer: its pieces are judged as they come
                wide = rows[0][0]
                found, run = decide(rows, None, True)
                yield found
                rows = take(rows, ~tail)
            elif len(rows[0]):
                wide = None
                found, run = decide(take(rows, ~tail), None, False)
                yield found
                rows = take(rows, tail)
            held, size = ([rows], len(rows[0])) if len(rows[0]) else ([], 0)
        if size:
            rows = tuple(map(np.concatenate, zip(*held)))
            same = rows[0] == wide if wide is not None else np.zeros(len(rows[0]), bool)
            if same.any():
                yield decide(take(rows, same), run, True)[0]
            if not same.all():
                yield decide(take(rows, ~same), None, False)[0]
    return groups


def _parts(match: int):
    """Bytes of open pieces: the windows that begin at least half before the anchor, and the others, each under the hash of what they have in common."""
    half = (match - min(GRAM, match)) // 2

    def run(batches):
        for batch in batches:
            out = []
            for d, t, text, found in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                data = text.encode("utf-8", "surrogatepass") if found else b""
                for piece in found or []:
                    start, n, anchor = piece["start"], piece["n"], piece["start"] + piece["lead"]
                    middle = min(max(anchor - half + 1, start), start + n)  # first window of the second part
                    for side, low, high in ((0, start, middle), (1, middle, start + n)):
                        if low < high:
                            key = data[anchor - half: anchor + min(GRAM, match)] if side == 0 else data[anchor: anchor + match - half + 1]
                            g = int.from_bytes(xxhash.xxh3_64_digest(key, side), "big", signed=True)
                            out.append((g, d, t, low, high - low, data[low: high + match - 1]))
            yield _batch(PART, *(zip(*out) if out else [[]] * len(PART)))
    return run


class Shard:
    """Suffix array and transform of some strings, sorted alone.

    Symbols are ``step`` bytes each, and every suffix is read in such symbols; 0 stands for what is left of less than a symbol. Equal rests
    follow in the order of their strings, which keeps the rows in step with those one symbol further on.
    """

    def __init__(self, strings: list[bytes], step: int = 1):
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lengths + 1)
        n = int(ends[-1])
        self.owner = np.repeat(np.arange(len(strings)), lengths + 1)
        self.place = np.arange(n) - (ends - lengths - 1)[self.owner]
        data = np.append(np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1, np.zeros(6, np.int64))
        left = lengths[self.owner] - self.place
        left -= left % step  # bytes of whole symbols
        rank, known = np.zeros(n, np.int64), 6
        for i in range(known):
            rank = (rank << 9) | np.where(left > i, data[i: n + i], 0)
        rank = np.unique(rank, return_inverse=True)[1].reshape(-1)
        while known <= left.max(initial=0):  # doubling: ranks by ``known`` bytes give ranks by twice as many
            further = np.where(left >= known, rank[np.minimum(np.arange(n) + known, n - 1)] + 1, 0)
            rank = np.unique(rank * (n + 1) + further, return_inverse=True)[1].reshape(-1)
            known *= 2
        self.order = np.argsort(rank, kind="stable")
        symbols = data[:n] if step == 1 else data[:n] * 257 + data[1: n + 1]
        self.before = np.where(self.place >= step, symbols[np.maximum(np.arange(n) - step, 0)], 0)[self.order]


def _dense(symbols: np.ndarray) -> np.ndarray:
    """Symbols in 16 bits, in their order, where there are few enough."""
    code = np.cumsum(np.bincount(symbols, minlength=1) > 0) - 1
    return code[symbols].astype(np.uint16 if code[-1] < 1 << 16 else np.int32)


def interleave(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every row of the merged order by ``depth`` symbols, and the common prefix of each row with the one before (in symbols, at most ``depth``)."""
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) <= 256 else np.uint16), [len(x) for x in transforms])
    block = np.zeros(len(symbols), np.int32)
    common = np.full(len(symbols), depth, np.int32)
    if len(common):
        common[0] = 0
        symbols = _dense(symbols)
    here = np.empty_like(symbols)
    for h in range(1, depth + 1):
        here[np.argsort(shard, kind="stable")] = symbols  # every shard's rows keep their own order
        order = np.argsort(here, kind="stable")
        shard, block, first = shard[order], block[order], here[order]
        fresh = (first[1:] != first[:-1]) | (block[1:] != block[:-1])
        new = np.flatnonzero(fresh & (common[1:] == depth)) + 1
        common[new] = h - 1
        block = np.r_[np.int32(0), np.cumsum(fresh, dtype=np.int32)]
        if len(new) == 0 and fresh.all():
            break
    return shard, common


def repeated_windows(shards: list[list[bytes]], low: np.ndarray, windows: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of every window that a string of smaller ``low`` has too. Strings of all shards are numbered through."""
    step = 1 if match % 2 else 2
    built = [Shard(s, step) for s in shards]
    begin = np.cumsum([0] + [len(s) for s in shards])
    shard, common = interleave([s.before for s in built], match // step)
    rows = np.argsort(shard, kind="stable")
    owner, place = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    owner[rows] = np.concatenate([s.owner[s.order] + b for s, b in zip(built, begin)])
    place[rows] = np.concatenate([s.place[s.order] for s in built])
    interval = np.cumsum(common < match // step) - 1
    window = place < windows[owner]  # the others reach beyond their string
    least = np.full(interval[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, interval[window], low[owner[window]])
    hit = window & (least[interval] < low[owner])
    return owner[hit], place[hit]


def _merge(match: int, heavy: int = HEAVY):
    """Over parts sorted by key: the batches of a task are shards; what is complete is merged, the last key waits for the next shard.

    Gives runs of repeated windows, and of heavy keys all windows with their bytes.
    """
    def merged(batches):
        g, d = (np.concatenate([_column(b, c) for b in batches]) for c in "gd")
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        nr = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
        meet = (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first))[nr]  # other documents under the same key
        if not meet.any():
            return None
        t, start, n = (np.concatenate([_column(b, c) for b in batches])[meet] for c in ("t", "start", "n"))
        d, at, shards, number, string = d[meet], 0, [], {}, []
        for b in batches:  # equal parts are one string, of their smallest document
            fresh = []
            for x, m in zip(b.column("data").to_pylist(), meet[at: at + b.num_rows].tolist()):
                if m:
                    if x not in number:
                        number[x] = len(number)
                        fresh.append(x)
                    string.append(number[x])
            at += b.num_rows
            if fresh:
                shards.append(fresh)
        string = np.array(string)
        low = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(low, string, d)
        windows = np.zeros(len(number), np.int64)
        windows[string] = n
        owner, place = repeated_windows(shards, low, windows, match)
        o, s, k = _merged_runs(owner, place, np.ones(len(owner), np.int64))
        # Copies of a part in larger documents are repeated as a whole; those in its smallest document have the runs of the string.
        again = d > low[string]
        own = np.flatnonzero(~again)
        begin, count = np.searchsorted(o, string[own]), np.bincount(o, minlength=len(number))[string[own]]
        part = np.repeat(own, count)
        run = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        return _spans_of(np.r_[d[again], d[part]], np.r_[t[again], t[part]], np.r_[start[again], start[part] + s[run]], np.r_[n[again], k[run]])

    def single(batches):
        rows = [(d, t, start + i, 1, data[i: i + match]) for b in batches
                for d, t, start, n, data in zip(*(b.column(c).to_pylist() for c in ("d", "t", "start", "n", "data"))) for i in range(n)]
        return _batch(MADE, *zip(*rows))

    def run(batches):
        held, size, large = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if large is not None:
                same = int((_column(batch, "g") == large).sum())
                if same:
                    yield single([batch.slice(0, same)])
                batch = batch.slice(same)
                if not batch.num_rows:
                    continue
                large = None
            held.append(batch)
            size += batch.column("data").nbytes
            first, last = held[0].column("g")[0].as_py(), batch.column("g")[-1].as_py()
            if first == last:
                if sum(b.num_rows for b in held) > heavy:
                    yield single(held)
                    held, size, large = [], 0, last
                continue
            if size < MERGED and sum(int((_column(b, "g") == last).sum()) for b in held) <= heavy:
                continue
            tails = [int((_column(b, "g") != last).sum()) for b in held]
            found = merged([b.slice(0, k) for b, k in zip(held, tails) if k])
            if found is not None:
                yield found
            held = [b.slice(k) for b, k in zip(held, tails) if k < b.num_rows]
            if sum(b.num_rows for b in held) > heavy:
                yield single(held)
                held, large = [], last
            size = sum(len(x) for b in held for x in b.column("data").to_pylist())
        if held:
            found = merged(held)
            if found is not None:
                yield found
    return run


def _spans_of(d, t, start, n) -> pa.RecordBatch:
    return _batch(MADE, d, t, start, n.astype(np.int32), np.full(len(d), None, object))


def _spans(docs: DataFrame, match: int, folder: str, heavy: int) -> DataFrame:
    """d, t, start, n: runs of repeated windows. Documents are (id, hash of the text), so rows of one id with different texts keep apart."""
    dealt = docs.filter("d IS NOT NULL AND text IS NOT NULL").mapInArrow(_cut_up(match), _ddl(PIECE)).repartition("h").sortWithinPartitions("h", "x", "d")
    found = staged(dealt.mapInArrow(_groups(), _ddl(FOUND)), folder, "found")
    opened = found.filter("alone").repartition("d", "t").groupBy("d", "t").agg(F.collect_list(F.struct("start", "n", "lead")).alias("found"))  # of one text
    # The outer join lets the texts be dealt out once for this and for the removal.
    parts = docs.join(opened, ["d", "t"], "left").select("d", "t", "text", "found").mapInArrow(_parts(match), _ddl(PART))
    made = staged(parts.repartition("g").sortWithinPartitions("g").mapInArrow(_merge(match, heavy), _ddl(MADE)), folder, "merged")
    single = made.filter("window IS NOT NULL")
    least = single.groupBy("window").agg(F.min("d").alias("low"), F.max("d").alias("high")).filter("low < high").select("window", "low")
    windows = single.join(least, "window").filter("d > low")
    columns = ["d", "t", "start", "n"]
    return found.filter("NOT alone").select(columns).unionByName(made.filter("window IS NULL").select(columns)).unionByName(windows.select(columns))


def _remove(match: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist(), batch.column("found").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans, kept, at = [], [], 0
                for first, n in sorted((x["start"], x["n"]) for x in found or []):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], first + n + match - 1)
                    else:
                        spans.append([first, first + n + match - 1])
                for first, last in spans:
                    kept.append(data[at:first])
                    at = last
                kept = b"".join(kept) + data[at:]
                out.append((doc_id, len(data), len(data) - len(kept), len(spans), [{"first": a, "last": b} for a, b in spans], kept))
            types = [pa.int64()] * 4 + [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names=names)
    return run


def remove_repeats(docs: DataFrame, match: int = MATCH, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (first byte, byte behind the last), kept (the remaining bytes): one row per document."""
    rows = need(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("d"), F.hash("text").alias("t"), "text")
    spans = _spans(rows, match, shared_dir(docs.sparkSession, "suffixes"), heavy)
    found = spans.repartition("d", "t").groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("found"))  # of one text
    return rows.join(found, ["d", "t"], "left").select("d", "text", "found").mapInArrow(_remove(match), CUT)


def digests(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, match).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

