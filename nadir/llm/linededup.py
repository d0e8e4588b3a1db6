"""Line deduplication by an exact set-similarity join.

A line is the set of its words. A line goes if an earlier line has Jaccard
similarity of at least 4/5 with it, earlier meaning lesser (doc_id, line
number); equal sets are merged first, so exact repeats never meet each other.

The texts are read once to be taken apart: their lines are stored as places in
a dictionary of word hashes for each stretch of text (half the input's size),
and all later steps work on that table.

The join orders a line's words by rarity and files the line under those of
its first ``size - ceil(4/5 size) + 1`` words that occur anywhere else: two
similar lines share one. Rarity is the number of lines with a word of its
bucket among 2**22; any one order of the words makes the prefix filter exact, so
the table of counts has a fixed size and is broadcast. What meets under a word
passes the length filter, the positional filter and a bound on the symmetric
difference from parity signatures, all exact; Jaccard is verified on whole sets.
A line needs one match only: each posting list first names a line's
``witnesses`` best candidates. What of a posting list such a choice was made
from is stored with them, and a line for which none of them held gets all the
others from there in a second round. So a group of n near copies costs some n
pairs to verify, and no candidate is lost. Signatures are compared for all pairs,
but in pieces, so that memory follows a list and not its pairs.

Sets are told apart by two 64-bit hashes: of their words, and of their parity
signatures. The texts are shuffled once, to take lines out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import Scratch, dealt, partitions_for, rest_hash, session_of

BUCKET_BITS = 22
SLICES = 64
BLOOM_BITS = 26
#: Entries of posting lists that a task holds on average.
ENTRIES_PER_TASK = 1_000_000
#: Pairs of a posting list that are compared at once, and those held before only each line's best stay.
PAIRS_AT_ONCE = 1 << 18
PAIRS_HELD = 1 << 19
#: Bytes of text that share a dictionary.
STRETCH_BYTES = 8 << 20
#: Lines of more words have signatures of 128 bits, others of 64.
SHORT = 64

_ONE = np.uint64(1)


def fewer_tasks(df: DataFrame) -> DataFrame:
    """A scan in an eighth of its tasks, as far as that keeps all cores busy: each gives a table of counts of fixed size."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions() // 8))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _slices(table: np.ndarray):
    """A table of fixed size in SLICES rows (slice, payload)."""
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([z.compress(x.tobytes()) for x in np.split(table, SLICES)], pa.binary())], names=["slice", "payload"])


def _combined(rows: DataFrame, dtype: str, bitwise: bool) -> np.ndarray:
    """Sum (of 64 bits) or union of the tables that tasks gave in slices; SLICES rows reach the driver."""
    import zstandard

    wide = dtype if bitwise else "u8"

    def merge(batches):
        import pyarrow as pa
        import zstandard

        total: dict[int, np.ndarray] = {}
        z = zstandard.ZstdDecompressor()
        for batch in W.trimmed(batches):
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(z.decompress(raw), dtype)
                if k not in total:
                    total[k] = part.astype(wide)
                elif bitwise:
                    total[k] |= part
                else:
                    total[k] += part
        c = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.compress(x.tobytes()) for x in total.values()], pa.binary())], names=["slice", "payload"])

    z = zstandard.ZstdDecompressor()
    got = dict(dealt(rows, "slice", min(SLICES, max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism))).mapInArrow(merge, "slice int, payload binary").toLocalIterator())
    width = (1 << (BLOOM_BITS - 3) if bitwise else 1 << BUCKET_BITS) // SLICES
    return np.concatenate([np.frombuffer(z.decompress(got[k]), wide) if k in got else np.zeros(width, wide) for k in range(SLICES)])


# --- lines as places in dictionaries -----------------------------------------

#: A stretch of text: ids and hashes of its rows; row, number and size of each line with words; the lines'
#: distinct words, end to end, as places in the dictionary.
STRETCH = "ids binary, nulls binary, text_hash binary, row binary, number binary, size binary, word binary, dictionary binary, word_width int, prefixes long"


def lines_of(part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, size, word) of the lines with words of some texts: the hashes of their distinct words, end to end."""
    import pyarrow as pa

    breaks = np.flatnonzero(part == 10) + 1
    begin = np.unique(np.concatenate([own[:-1][np.diff(own) > 0], breaks[~np.isin(breaks, own[1:])]])) if len(part) else np.zeros(0, np.int64)
    row = np.searchsorted(own, begin, side="right") - 1
    number = np.arange(len(begin)) - np.searchsorted(row, row, side="left")
    starts, ends, _ = W.scan(part, own)
    line = np.searchsorted(begin, starts, side="right") - 1
    coded = pa.array(W.hash_spans(part, starts, ends)).dictionary_encode()
    key = np.sort((line << 32) | coded.indices.to_numpy().astype(np.int64))
    key = key[np.diff(key, prepend=-1) != 0]
    line = key >> 32
    first, size = _runs_of(line)
    used = line[first]
    return row[used], number[used], size, coded.dictionary.to_numpy().astype(np.uint64)[key & 0xFFFFFFFF]


def _stretches(batches):
    """Rows of STRETCH, each of about STRETCH_BYTES of text, which is scanned in smaller chunks."""
    import pyarrow as pa

    names = [c.split()[0] for c in STRETCH.split(", ")]
    types = [pa.binary()] * 8 + [pa.int32(), pa.int64()]
    held, n_rows, n_bytes = [], 0, 0

    def out():
        nonlocal held, n_rows, n_bytes
        ids, nulls, text_hash, row, number, size, word = (np.concatenate(x) for x in zip(*held, strict=True))
        held, n_rows, n_bytes = [], 0, 0
        coded = pa.array(word).dictionary_encode()
        dictionary, place = coded.dictionary.to_numpy().astype(np.uint64), coded.indices.to_numpy()
        width = 2 if len(dictionary) <= 1 << 16 else 3 if len(dictionary) <= 1 << 24 else 4
        planes = place.astype("<u2").tobytes() + ((place >> 16).astype(("u1", "<u2")[width - 3]).tobytes() if width > 2 else b"")
        values = [ids.tobytes(), nulls.tobytes(), text_hash.tobytes(), row.astype("<u4").tobytes(), number.astype("<u4").tobytes(), size.astype("<u4").tobytes(), planes, dictionary.tobytes(), width, int((size - (4 * size + 4) // 5 + 1).sum())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    for batch in W.trimmed(batches):
        data, offsets = W.flat(batch.column(1))
        ids, nulls = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
        text_hash = batch.column(2).to_numpy(zero_copy_only=False)
        for a, b in W.chunks(offsets):
            row, number, size, word = lines_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(size):
                continue
            held.append((ids[a:b], nulls[a:b], text_hash[a:b], row + n_rows, number, size, word))
            n_rows, n_bytes = n_rows + b - a, n_bytes + int(offsets[b] - offsets[a])
            if n_bytes >= STRETCH_BYTES:
                yield out()
    if held:
        yield out()


def _places_of(planes: bytes, width: int) -> np.ndarray:
    n = len(planes) // width
    low = np.frombuffer(planes, "<u2", n)
    return low if width == 2 else low.astype(np.int64) | (np.frombuffer(planes, ("u1", "<u2")[width - 3], n, 2 * n).astype(np.int64) << 16)


def _count_words(batches):
    """In how many lines words of each bucket are."""
    table, some = np.zeros(1 << BUCKET_BITS, np.uint32), False
    for batch in W.trimmed(batches):
        for word, dictionary, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            dictionary = np.frombuffer(dictionary, np.uint64)
            np.add.at(table, _bucket(dictionary), np.bincount(_places_of(word, width), minlength=len(dictionary)).astype(np.uint32))
            some = True
    if some:
        yield _slices(table)


def _second_hash(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    return W.mix(p1 ^ W.mix(p2 + W._K2))


class Stretch:
    """A stored stretch of text; ``h1``, ``h2`` tell the sets of its lines apart."""

    def __init__(self, row: dict):
        self.ids, self.nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.text_hash = np.frombuffer(row["text_hash"], np.int64)
        self.row, self.number, self.size = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("row", "number", "size"))
        self.word = _places_of(row["word"], row["word_width"])
        self.dictionary = np.frombuffer(row["dictionary"], np.uint64)
        self.first = np.cumsum(self.size) - self.size
        d = self.dictionary
        bit, low = _ONE << (d & np.uint64(63)), (d & np.uint64(64)) == 0
        self.p1 = np.bitwise_xor.reduceat(np.where(low, bit, np.uint64(0))[self.word], self.first)
        self.p2 = np.bitwise_xor.reduceat(np.where(low, np.uint64(0), bit)[self.word], self.first)
        self.h1 = np.add.reduceat(W.mix(d + W._K1)[self.word], self.first)
        short = self.size <= SHORT
        self.p1[short] ^= self.p2[short]
        self.p2[short] = 0
        self.h2 = _second_hash(self.p1, self.p2)

    def firsts(self) -> np.ndarray:
        """A line of each set."""
        return np.sort(np.unique(self.h1, return_index=True)[1])


def _each(job):
    """A task that gives ``job(stretch)`` for every stretch."""

    def run(batches):
        for batch in W.trimmed(batches):
            for row in batch.to_pylist():
                yield job(Stretch(row))

    return run


# --- candidates --------------------------------------------------------------

#: Part of the posting lists, and a block of their entries.
BLOCK = "part int, block binary"
ENTRY = (("token", "u8"), ("h1", "u8"), ("p1", "u8"), ("p2", "u8"), ("doc", "i8"), ("number", "u4"), ("size", "u4"), ("place", "u4"))
PAIR = "later long, later2 long, earlier long, earlier2 long, more boolean, block binary"


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of a block of entries: tokens in five bytes, the second signature of long lines only, small numbers in as few bytes as they need."""
    token, h1, p1, p2, *rest = columns
    n = len(token)
    long = rest[2] > SHORT
    out = [np.array([n, long.sum()], np.int64).tobytes(), (token & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (token >> np.uint64(32)).astype(np.uint8).tobytes(), h1.tobytes(), p1.tobytes(), p2[long].tobytes()]
    for c in rest:
        low, high = (int(c.min()), int(c.max())) if n else (0, 0)
        kind = next((k for k, m in (("u1", 1 << 8), ("u2", 1 << 16), ("u4", 1 << 32)) if high - low < m), "i8")
        low = low if kind != "i8" else 0
        out += [kind.encode(), np.int64(low).tobytes(), (c - low).astype(kind).tobytes()]
    return b"".join(out)


def _unpacked(block: bytes) -> list[np.ndarray]:
    n, n_long = np.frombuffer(block, np.int64, 2).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    token = take("<u4", n).astype(np.uint64) | (take("u1", n).astype(np.uint64) << np.uint64(32))
    h1, p1, second, rest = take("u8", n), take("u8", n), take("u8", n_long), []
    for _ in range(4):
        kind = block[at : at + 2].decode()
        at += 2
        low = int(take("i8", 1)[0])
        rest.append(take(kind, n).astype(np.int64) + low)
    p2 = np.zeros(n, np.uint64)
    p2[rest[2] > SHORT] = second
    return [token, h1, p1, p2, *rest]


def _by_rarity(line: np.ndarray, often: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by line, then by a coarse logarithm of the count, then by the word's hash."""
    rarity = np.minimum(np.log2(often.astype(np.float64) + 1) * 64, 2047).astype(np.uint64)
    if len(line) and line.max() >= 1 << 22:
        return np.lexsort((word, rarity, line))
    key = (line.astype(np.uint64) << np.uint64(42)) | (rarity << np.uint64(31)) | (word >> np.uint64(33))
    order = np.argsort(key)
    while True:  # words that agree in all of that are put in the order of their whole hashes
        k, w = key[order], word[order]
        wrong = np.flatnonzero((k[1:] == k[:-1]) & (w[1:] < w[:-1]))
        if not len(wrong):
            return order
        wrong = wrong[np.concatenate([[True], np.diff(wrong) > 1])]
        order[wrong], order[wrong + 1] = order[wrong + 1], order[wrong]


def prefixes(s: Stretch, often: np.ndarray) -> list[np.ndarray]:
    """The columns of ENTRY for a line of each set under each word of its prefix that other lines have.

    ``often``: in how many lines each word of the dictionary is.
    """
    rarest = np.lexsort((s.dictionary, often))
    rank = np.empty(len(rarest), np.int64)
    rank[rarest] = np.arange(len(rarest))
    key = np.sort((np.repeat(np.arange(len(s.size)), s.size) << 32) | rank[s.word])
    line, word = key >> 32, rarest[key & 0xFFFFFFFF]
    place = np.arange(len(key)) - np.repeat(s.first, s.size)
    keep = np.zeros(len(s.size), bool)
    keep[s.firsts()] = True
    reach = np.where(keep, s.size - (4 * s.size + 4) // 5 + 1, 0)
    at = np.flatnonzero((place < np.repeat(reach, s.size)) & (often[word] > 1))
    line, word, place = line[at], word[at], place[at]
    return [s.dictionary[word], s.h1[line], s.p1[line], s.p2[line], s.ids[s.row[line]], s.number[line], s.size[line], place]


def _entries(counts, parts: int):
    def run(batches):
        import pyarrow as pa

        def blocks():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            mixed = W.mix(columns[0])
            part, columns[0] = (mixed % np.uint64(parts)).astype(np.int64), mixed >> np.uint64(24)  # words that share a token only meet in vain
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edge))
            columns = [c[order] for c in columns]
            packed = [_packed([c[edge[k] : edge[k + 1]] for c in columns]) for k in some.tolist()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "block"])

        table, held = counts.value, []
        for batch in W.trimmed(batches):
            for row in batch.to_pylist():
                s = Stretch(row)
                held.append(prefixes(s, table[_bucket(s.dictionary)]))
                if sum(len(h[0]) for h in held) >= ENTRIES_PER_TASK:
                    yield blocks()
        if held:
            yield blocks()

    return run


def _runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def listed(entries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``entries``, which are sorted by token, in lists of two or more, and the number of each one's list.

    A list has the first line of each set. Rows are in order of list and size.
    """
    token, h1, p1, p2, doc, number, size, _ = entries
    first, length = _runs_of(token)
    at = np.flatnonzero(np.repeat(length > 1, length))
    run = np.repeat(np.arange(int((length > 1).sum())), length[length > 1])
    if not len(at):
        return at, run
    order = np.lexsort((number[at], doc[at], h1[at], run))
    at, run = at[order], run[order]
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (h1[at][1:] != h1[at][:-1]) | (p1[at][1:] != p1[at][:-1]) | (p2[at][1:] != p2[at][:-1])])
    at, run = at[new], run[new]
    order = np.lexsort((size[at], run))
    return at[order], run[order]


def meetings(entries: list[np.ndarray], at: np.ndarray, run: np.ndarray):
    """(later, earlier, room) of the pairs of ``listed`` rows that pass the filters, as places in ``at``.

    They come in arrays of PAIRS_AT_ONCE or little more, so a list's pairs are never held together.
    """
    if not len(at):
        return
    _, h1, p1, p2, doc, number, size, place = (c[at] for c in entries)
    n = len(at)
    # sizes grow in a run, so partners of up to 5/4 the size follow at once
    wide = int(size.max()) * 2 + 2
    reach = np.searchsorted(run * wide + size, run * wide + (5 * size) // 4, side="right")
    # the shared word must be early enough in the smaller line for enough to follow
    own = np.flatnonzero((reach > np.arange(n) + 1) & (place <= size - (8 * size + 8) // 9))
    turn = np.empty(n, np.int64)
    turn[np.lexsort((p2, p1, h1, number, doc))] = np.arange(n)

    def passed(a, b):
        """Those of the pairs (a, b) that pass the filters."""
        sa, sb = size[a], size[b]
        least = (4 * (sa + sb) + 8) // 9  # words that they must share
        # signatures of 128 bits fold into those of 64; both bound the symmetric difference from below
        long = (sa > SHORT) & (sb > SHORT)
        apart = np.where(long, np.bitwise_count(p1[a] ^ p1[b]).astype(np.int64) + np.bitwise_count(p2[a] ^ p2[b]), np.bitwise_count(p1[a] ^ p2[a] ^ p1[b] ^ p2[b]))
        ok = np.flatnonzero((apart <= sa + sb - 2 * least) & (np.minimum(sa - place[a], sb - place[b]) >= least))
        a, b, room = a[ok], b[ok], (apart - (sa + sb - 2 * least))[ok]
        swap = turn[b] < turn[a]
        return np.where(swap, a, b), np.where(swap, b, a), room

    step = 1
    while len(own) * 8 >= n:  # all lines with one partner each, while most have one
        for lo in range(0, len(own), PAIRS_AT_ONCE):
            yield passed(own[lo : lo + PAIRS_AT_ONCE], own[lo : lo + PAIRS_AT_ONCE] + step)
        step += 1
        own = own[reach[own] >= own + step + 1]
    for lo in range(0, len(own), 1 << 12):
        some = own[lo : lo + (1 << 12)]
        count = reach[some] - some - step
        for cut in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS_AT_ONCE)) + 1):
            c = count[cut]
            x = np.repeat(some[cut], c)
            yield passed(x, x + step + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c))


def candidates(entries: list[np.ndarray], witnesses: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, more, crowded) as rows of ``entries``, which are sorted by token.

    A later line gets its ``witnesses`` best candidates, and ``more`` if it has
    others; ``crowded`` are the rows among which it has them. A line never
    holds more than its best ones, so memory follows the entries and not the pairs.
    """
    at, run = listed(entries)
    n = len(at)
    if not n:
        return at, at, np.zeros(0, bool), at
    _, h1, p1, p2, doc, number, _, _ = entries
    order = np.lexsort((p2[at], p1[at], h1[at]))
    set_of = np.empty(n, np.int64)
    set_of[order] = np.cumsum(np.concatenate([[0], np.any([c[at[order]][1:] != c[at[order]][:-1] for c in (h1, p1, p2)], axis=0)]))
    turn = np.empty(n, np.int64)
    turn[np.lexsort((set_of, number[at], doc[at]))] = np.arange(n)
    # the room of a line's best candidate that is one too many; nothing worse need be held
    enough = np.full(n, 1 << 62)
    crowd = np.zeros(n, bool)

    def best(held):
        """Of a line's candidates those whose signatures leave most room, which most likely hold: one more than it gets."""
        y, x, room = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((turn[x], room, set_of[y]))
        y, x, room = y[order], x[order], room[order]
        line, other = set_of[y], set_of[x]
        group = np.concatenate([[True], line[1:] != line[:-1]]) if len(y) else np.zeros(0, bool)
        new = group.copy()
        new[1:] |= other[1:] != other[:-1]  # under another word they met already
        nth = np.cumsum(new) - 1
        nth -= nth[np.flatnonzero(group)][np.cumsum(group) - 1]
        many = new & (nth > witnesses)
        crowd[y[many]] = crowd[x[many]] = True
        last = new & (nth == witnesses)
        enough[line[last]] = room[last]
        kept = new & (nth <= witnesses)
        return (y[kept], x[kept], room[kept]), nth[kept] < witnesses

    none = np.zeros(0, np.int64)
    held, n_held, most = [(none, none, none)], 0, PAIRS_HELD
    for y, x, room in meetings(entries, at, run):
        late = room >= enough[set_of[y]]
        if late.any():
            crowd[y[late]] = crowd[x[late]] = True
            y, x, room = y[~late], x[~late], room[~late]
        held.append((y, x, room))
        n_held += len(y)
        if n_held > most:
            held = [best(held)[0]]
            n_held = len(held[0][0])
            most = 2 * n_held + PAIRS_HELD
    (y, x, _), few = best(held)
    more = enough[set_of[y]] < 1 << 62
    crowd[y[more]] = crowd[x[more]] = True
    return at[y[few]], at[x[few]], more[few], np.sort(at[crowd])


def _pairs(columns, later, earlier, more, block=None):
    import pyarrow as pa

    def h2(at):
        return _second_hash(columns[2][at], columns[3][at]).view(np.int64)

    arrays = [columns[1][later].view(np.int64), h2(later), columns[1][earlier].view(np.int64), h2(earlier), more]
    fields = [pa.array(v) for v in arrays]
    blocks = pa.nulls(len(later), pa.binary())
    if block is not None:
        fields = [pa.concat_arrays([f, pa.nulls(1, f.type)]) for f in fields]
        blocks = pa.concat_arrays([blocks, pa.array([block], pa.binary())])
    return pa.RecordBatch.from_arrays([*fields, blocks], names=[c.split()[0] for c in PAIR.split(", ")])


def _first_round(witnesses: int):
    """The best candidates of each part of the posting lists, and what the others can be found in."""

    def run(batches):
        def done():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            order = np.argsort(columns[0], kind="stable")
            columns = [c[order] for c in columns]
            later, earlier, more, crowded = candidates(columns, witnesses)
            return _pairs(columns, later, earlier, more, _packed([c[crowded] for c in columns]) if len(crowded) else None)

        now, held = None, []
        for batch in W.trimmed(batches):  # sorted by part
            for part, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield done()
                now = part
                held.append(_unpacked(block))
        if held:
            yield done()

    return run


def _second_round(bits):
    """All candidates of the lines asked for in stored parts of posting lists."""

    def run(batches):
        for batch in W.trimmed(batches):
            for block in batch.column(0).to_pylist():
                columns = _unpacked(block)
                at, lists = listed(columns)
                asked = _in_bloom(bits.value, columns[1][at].view(np.int64))
                for later, earlier, _ in meetings(columns, at, lists):
                    wanted = asked[later]
                    if wanted.any():
                        later, earlier = at[later[wanted]], at[earlier[wanted]]
                        yield _pairs(columns, later, earlier, np.zeros(len(later), bool))

    return run


# --- verification ------------------------------------------------------------


def _bloom_places(h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = W.mix(h1.view(np.uint64) + W._K2)
    return (u >> np.uint64(64 - BLOOM_BITS)).astype(np.int64), (u & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _in_bloom(bits: np.ndarray, h1: np.ndarray) -> np.ndarray:
    a, b = _bloom_places(h1)
    return ((bits[a >> 3] >> (a & 7)) & (bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def _bloom(batches):
    bits, some = np.zeros(1 << (BLOOM_BITS - 3), np.uint8), False
    for batch in W.trimmed(batches):
        for place in _bloom_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)):
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
            some = True
    if some:
        yield _slices(bits)


def _bitmap(spark: SparkSession, ids: DataFrame):
    """A bitmap of fixed size that holds all ids of a frame, and some others."""
    return spark.sparkContext.broadcast(_combined(ids.mapInArrow(_bloom, "slice int, payload binary"), "u1", True))


def _sets(bits):
    """(h1, h2, sorted word hashes) of sets that may be candidates."""

    def job(s: Stretch):
        import pyarrow as pa

        at = s.firsts()
        at = at[_in_bloom(bits.value, s.h1[at].view(np.int64))]
        own = [np.sort(s.dictionary[s.word[a : a + n]]).tobytes() for a, n in zip(s.first[at].tolist(), s.size[at].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(s.h1[at].view(np.int64)), pa.array(s.h2[at].view(np.int64)), pa.array(own, pa.binary())], names=["h1", "h2", "words"])

    return _each(job)


def _places(s: Stretch):
    """Every line with words."""
    import pyarrow as pa

    ids = pa.array(s.ids[s.row], mask=s.nulls[s.row])
    return pa.RecordBatch.from_arrays([pa.array(s.h1.view(np.int64)), pa.array(s.h2.view(np.int64)), ids, pa.array(s.text_hash[s.row]), pa.array(s.number)], names=["h1", "h2", "doc_id", "text_hash", "line"])


def _verify(batches):
    """Whether Jaccard is 4/5 or more."""
    import pyarrow as pa

    for batch in W.trimmed(batches):
        held = []
        for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            held.append(5 * both >= 4 * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.bool_()), batch.column(2)], names=["later", "later2", "held", "more"])


def removed_lines(docs: DataFrame, scratch: Scratch, witnesses: int = 6) -> DataFrame:
    """(doc_id, text_hash, lines array<long>) of the rows of ``docs`` that lose lines, numbered from 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    stretches = scratch.table("stretches", rows.mapInArrow(_stretches, STRETCH))
    table = _combined(stretches.select("word", "dictionary", "word_width").transform(fewer_tasks).mapInArrow(_count_words, "slice int, payload binary"), "u4", False)
    counts = spark.sparkContext.broadcast(np.minimum(table, 0xFFFFFFFF).astype(np.uint32))  # only their order matters
    total = stretches.agg(F.coalesce(F.sum("prefixes"), F.lit(0))).first()[0]
    parts = partitions_for(spark, total, ENTRIES_PER_TASK)

    def first_round() -> DataFrame:
        blocks = stretches.mapInArrow(_entries(counts, parts), BLOCK)
        blocks = dealt(blocks, "part", parts).sortWithinPartitions("part")
        return scratch.table("first-round", blocks.mapInArrow(_first_round(witnesses), PAIR))

    first = first_round()
    scratch.release()

    def once(pairs: DataFrame) -> DataFrame:
        return pairs.where("later is not null").groupBy("later", "later2", "earlier", "earlier2").agg(F.max("more").alias("more"))

    def verified(pairs: DataFrame) -> DataFrame:
        bits = _bitmap(spark, pairs.select("later").union(pairs.select("earlier")))
        sets = scratch.table("sets", stretches.mapInArrow(_sets(bits), "h1 long, h2 long, words binary")).groupBy("h1", "h2").agg(F.min("words").alias("words"))
        ends = [sets.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.col("words").alias(w)) for x, w in (("later", "a"), ("earlier", "b"))]
        joined = pairs.join(ends[0], ["later", "later2"]).join(ends[1], ["earlier", "earlier2"])
        tried = joined.select("later", "later2", "more", "a", "b").mapInArrow(_verify, "later long, later2 long, held boolean, more boolean")
        return tried.groupBy("later", "later2").agg(F.max("held").alias("held"), F.max("more").alias("more"))

    pairs = scratch.table("pairs", once(first))
    tried = scratch.table("tried", verified(pairs))
    similar = tried.where("held").select("later", "later2")
    open_ = scratch.table("open", tried.where("more and not held").select("later", "later2"))
    if not open_.isEmpty():
        rest = first.where("block is not null").select("block").mapInArrow(_second_round(_bitmap(spark, open_.select("later"))), PAIR)
        rest = once(rest.join(open_, ["later", "later2"], "left_semi"))
        # what the first round has tried needs no second try
        rest = scratch.table("rest", rest.join(pairs.drop("more"), ["later", "later2", "earlier", "earlier2"], "left_anti"))
        if not rest.isEmpty():
            similar = similar.union(scratch.table("retried", verified(rest)).where("held").select("later", "later2"))

    # a set's first line stays unless the set itself is similar to an earlier one
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "line", "text_hash")
    own = stretches.mapInArrow(_each(_places), "h1 long, h2 long, doc_id long, text_hash long, line long")
    firsts = own.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    firsts = firsts.join(similar.select(F.col("later").alias("h1"), F.col("later2").alias("h2"), F.lit(True).alias("similar")), ["h1", "h2"], "left")
    # sets that lose lines are few, and as a table of their own they can meet the lines of a very common set in parts
    firsts = scratch.table("losing", firsts.where("n > 1 or similar").drop("n"))
    marked = own.join(firsts, ["h1", "h2"])
    gone = marked.where(F.col("similar").isNotNull() | (place != F.col("first")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("lines"))


def _without(text_at: int, chars_at: int | None):
    def run(batches):
        import pyarrow as pa

        for batch in W.trimmed(batches):
            cols = batch.columns
            out, n_lines, n_gone = [], [], []
            for text, lines, nth in zip(cols[text_at].to_pylist(), cols[-2].to_pylist(), cols[-1].to_pylist(), strict=True):
                own = text.split("\n") if text else []
                if nth > 1:  # a row that repeats another has no line of its own
                    gone = {i for i, x in enumerate(own) if x.encode().split(None, 1)}
                else:
                    gone = set(lines or ())
                n_lines.append(len(own))
                n_gone.append(len(gone))
                out.append(text if not gone else "\n".join(x for i, x in enumerate(own) if i not in gone))
            cols = [*cols[:-2]]
            cols[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                cols[chars_at] = pa.array([None if x is None else len(x) for x in out], pa.int64()).cast(cols[chars_at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=[f"c{i}" for i in range(len(cols) + 2)])

    return run


def dedup_lines(docs: DataFrame, scratch_group: str = "lines", witnesses: int = 6) -> tuple[DataFrame, str, str]:
    """``docs`` (doc_id integer, text, more columns) without the lines that match an earlier one.

    Returns the frame with two more columns at its end and their names: lines
    of the text, and lines taken out. ``n_chars``, if there is one, is counted anew.

    A line without words is never taken out. Null and empty text have no lines
    and stay as they are; null doc_id comes first; of rows with one doc_id,
    lines count by number, then by text; of rows that are alike in both the first
    in an order of hashes keeps its lines, the others lose all lines with words. An empty table gives no rows. Columns may have any names.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    # one key without nulls on both sides: the join and the window then share one shuffle of the texts
    key = lambda: F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("\0"))
    gone = scratch.table("gone", removed_lines(docs, scratch, witnesses))
    scratch.drop("stretches")
    gone = gone.select(key().alias("k_id"), F.col("text_hash").alias("k_hash"), "lines")
    scratch.release()
    columns = docs.columns
    left = docs.select(key().alias("k_id"), F.xxhash64("text").alias("k_hash"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    joined = left.join(gone, ["k_id", "k_hash"], "left")
    nth = F.row_number().over(Window.partitionBy("k_id", "k_hash").orderBy(rest_hash("row", docs.schema)))
    wide = joined.withColumn("nth", nth).select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(columns)), "lines", "nth")
    n = len(columns)
    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)), T.StructField(f"c{n}", T.LongType()), T.StructField(f"c{n + 1}", T.LongType())])
    out = wide.mapInArrow(_without(columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None), schema)
    lines, taken = "n_lines", "n_removed"
    while lines in columns or taken in columns:
        lines, taken = f"_{lines}", f"_{taken}"
    return out.toDF(*columns, lines, taken), lines, taken
