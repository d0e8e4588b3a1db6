"""Katz backoff scores: Good-Turing discounted bigrams over unigrams over one class of unknown words.

P(w) of a word with count c is d_c c / N; what the discounts leave is the
class of words not in training, as one word. P(w|v) of a bigram with count c
is d_c c / C(v); otherwise it is alpha(v) P(w), where
alpha(v) = (1 - sum of seen P(.|v)) / (1 - sum of P over the words seen after v),
so each distribution sums to one exactly. Counts over ``k`` are not discounted.
Where nothing is left, one more is added to the denominator (the unknown
class then always has some mass). A context not in training gives P(w).
Each text is its words between a start context and an end token.

Tables. Words are their 64-bit hashes. Everything about a bigram lives in the
part of its second word, where that word's own count is known, too: it is the
sum over its contexts. A context's sums are collected from those parts into
the part of the context, which gives back its total and keeps its alpha. A
row of a table is one sorted, dictionary-coded and compressed block of a part,
so shuffles carry a few bytes a bigram. Scoring sends each text's bigrams to
the parts of their second words, and only those not in training further, to
the parts of their contexts; the sums come back for each text. A task holds one
part of the model at a time and streams over the blocks it scores; the number of
parts follows the input. A block is what a task has for a part, so that blocks
don't get smaller, and more, with the square of the parts: texts share a block
as far as HELD_BYTES goes, bigrams not in training up to HELD_UNSEEN, and a task
adds the sums of its parts up before they come back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import Scratch, dealt, session_of

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
K = 5
#: Bytes of text to a part of the model.
PART_BYTES = 24 << 20
CHUNK_BYTES = 8 << 20
#: Bytes of text that share their blocks; bigrams not in training, and rows with sums, that a task holds.
HELD_BYTES = 32 << 20
HELD_UNSEEN = 1 << 20
HELD_SUMS = 4 << 20
#: A wave is scored in at most so many tasks for each core, as far as they get no more than so many parts.
TASKS_PER_CORE = 6
PARTS_PER_TASK = 8
_BLOCK = "part int, kind int, chunk long, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block; bytes of equal weight lie together."""
    import json

    import zstandard

    head = json.dumps([(a.dtype.str, len(a)) for a in arrays]).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(block: bytes) -> list[np.ndarray]:
    import json

    import zstandard

    n = int.from_bytes(block[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(block[4 + n :]), 0, []
    for kind, size in json.loads(block[4 : 4 + n]):
        dtype = np.dtype(kind)
        raw = np.frombuffer(body, np.uint8, size * dtype.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, size).T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds counts or indexes."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _record(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "kind", "chunk", "payload"])


def _records(job):
    """A task that gives the rows of ``job(batches)`` in records of some megabytes."""

    def run(batches):
        held, size = [], 0
        for row in job(batches):
            held.append(row)
            size += len(row[3])
            if size >= 4 << 20 or len(held) >= 512:
                yield _record(held)
                held, size = [], 0
        if held:
            yield _record(held)

    return run


def _tokens(part: np.ndarray, own: np.ndarray):
    """Row, context and word of every token (END included) of some texts."""
    starts, ends, rows = W.scan(part, own)
    n = len(own) - 1
    h = W.hash_spans(part, starts, ends)
    stop = np.cumsum(np.bincount(rows, minlength=n))
    word = np.insert(h, stop, END)
    row = np.insert(rows, stop, np.arange(n))
    before = np.empty(len(word), np.uint64)
    before[1:] = word[:-1]
    before[np.concatenate([[0], (stop + np.arange(1, n + 1))[:-1]])] = START
    return row, before, word


def _blocks(parts: int, row: np.ndarray | None, before: np.ndarray, word: np.ndarray):
    """(part, arrays) of the distinct bigrams (and rows) with how often each comes."""
    names, ids = np.unique(np.concatenate([word, before]), return_inverse=True)
    part = (names % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    names, part = names[order], part[order]
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    ids = to[ids]
    w, v = ids[: len(word)], ids[len(word) :]
    bits = max(1, int(len(names) - 1).bit_length())
    if row is None:
        key, again = np.unique((w << bits) | v, return_counts=True)
        r = None
    else:
        row_bits = max(1, int(row.max()).bit_length())
        if 2 * bits + row_bits <= 62:
            key, again = np.unique((((w << bits) | v) << row_bits) | row, return_counts=True)
            r, key = key & ((1 << row_bits) - 1), key >> row_bits
        else:
            both, r, again = (w << bits) | v, row, np.ones(len(w), np.int64)
            o = np.argsort(both, kind="stable")
            key, r = both[o], r[o]
    w, v = key >> bits, key & ((1 << bits) - 1)
    edge = np.searchsorted(part[w], np.arange(parts + 1))
    for p in range(parts):
        a, b = edge[p], edge[p + 1]
        if a == b:
            continue
        own, size = np.unique(w[a:b], return_counts=True)
        ctx, at = np.unique(v[a:b], return_inverse=True)
        arrays = [names[own], small(size), names[ctx], small(at), small(again[a:b])]
        if r is not None:
            arrays.append(small(r[a:b]))
        yield p, arrays


class _Held:
    """Blocks of some chunks of text, for each part of the model."""

    def __init__(self):
        self.parts: dict[int, list[list[np.ndarray]]] = {}
        self.size = self.rows = 0

    def add(self, blocks, size: int, rows: int) -> None:
        for p, arrays in blocks:
            if len(arrays) > 5:
                arrays[5] = arrays[5].astype(np.uint32) + np.uint32(self.rows)
            self.parts.setdefault(p, []).append(arrays)
        self.size, self.rows = self.size + size, self.rows + rows

    def out(self):
        """(part, payload), with the chunks' arrays end to end."""
        for p in sorted(self.parts):
            own = self.parts.pop(p)
            arrays = [np.concatenate(c) for c in zip(*own, strict=True)]
            begin = np.cumsum([0] + [len(b[2]) for b in own[:-1]])
            arrays[3] = np.concatenate([b[3].astype(np.int64) + k for b, k in zip(own, begin.tolist(), strict=True)])
            yield p, pack(arrays[0], small(arrays[1]), arrays[2], *(small(a) for a in arrays[3:]))
        self.size = self.rows = 0


def _bigrams(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context, count of a block."""
    return np.repeat(arrays[0], arrays[1].astype(np.int64)), arrays[2][arrays[3].astype(np.int64)], arrays[4].astype(np.int64)


def _runs(part_batches):
    """Blocks of a sorted partition, one at a time: (part, kind, chunk, payload)."""
    for batch in W.trimmed(part_batches):
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


# --- training ----------------------------------------------------------------

MODEL, CONTEXTS, SCALARS, TOTALS, TOKENS, ALPHA, UNSEEN, ROWS, SUMS = range(9)


def _count(parts: int):
    def job(batches):
        held = _Held()
        for batch in W.trimmed(batches):
            data, offsets = W.flat(batch.column(0))
            data = W._LOWER[data]
            for a, b in W.chunks(offsets, CHUNK_BYTES):
                _, before, word = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.add(_blocks(parts, None, before, word), int(offsets[b] - offsets[a]), b - a)
                if held.size >= HELD_BYTES:
                    yield from ((p, MODEL, 0, payload) for p, payload in held.out())
        yield from ((p, MODEL, 0, payload) for p, payload in held.out())

    return _records(job)


def _merge(parts: int):
    """The counts of each part; its contexts' sums by the parts of the contexts; its scalars."""

    def emit(part: int, got: list):
        w, v, n = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.lexsort((v, w))
        w, v, n = w[order], v[order], n[order]
        del order
        head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])]))
        n = np.add.reduceat(n, head)
        w, v = w[head], v[head]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        size = np.diff(np.append(first, len(w)))
        total = np.add.reduceat(n, first)
        ctx, at = np.unique(v, return_inverse=True)
        yield part, MODEL, 0, pack(w[first], small(size), ctx, small(at), small(n))
        of_word = np.repeat(total, size)
        one = lambda pick, weights=None: np.bincount(at[pick], weights=None if weights is None else weights[pick], minlength=len(ctx)).astype(np.int64)
        every = np.ones(len(w), bool)
        stats = [one(every, n)] + [one(n == r) for r in range(1, K + 1)] + [one(of_word == r) for r in range(1, K + 1)] + [one(of_word > K, of_word)]
        to = (ctx % np.uint64(parts)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[by], np.arange(parts + 1))
        for q in range(parts):
            pick = by[edge[q] : edge[q + 1]]
            if len(pick):
                yield q, CONTEXTS, part, pack(ctx[pick], *(small(s[pick]) for s in stats))
        scalars = [total.sum(), len(total), *(int((total == r).sum()) for r in range(1, K + 2)), *(int((n == r).sum()) for r in range(1, K + 2))]
        yield part, SCALARS, 0, pack(np.array(scalars, np.int64))

    def job(batches):
        now, got = None, []
        for part, _, _, payload in _runs(batches):
            if part != now and got:
                yield from emit(now, got)
                got = []
            now = part
            got.append(_bigrams(unpack(payload)))
        if got:
            yield from emit(now, got)

    return _records(job)


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts d_0..d_K (d_0 unused) from the numbers n_1..n_{K+1} of things counted so often.

    Katz's renormalised discounts; one that would not lie in (0, 1] is 1.
    """
    d = np.ones(K + 1)
    if n[0] > 0:
        tail = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            if n[r - 1] > 0 and tail < 1:
                x = ((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Unigrams:
    """The unigram level: discounts, denominator, mass of unknown words."""

    def __init__(self, total: int, words: int, counts: list[int], bigram_counts: list[int]):
        self.total, self.words = total, words
        self.d, self.d2 = good_turing(counts), good_turing(bigram_counts)
        lost = sum(counts[r - 1] * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.denominator = total if lost > 0 else total + 1
        self.unknown = (lost if lost > 0 else 1.0) / self.denominator

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K)] ** (count <= K) * count / self.denominator, self.unknown)


def context_weights(stats: list[np.ndarray], u: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and alpha of contexts from their summed statistics."""
    total, seen, of_word, big = stats[0], stats[1 : K + 1], stats[K + 1 : 2 * K + 1], stats[2 * K + 1]
    lost = sum(seen[r - 1] * r * (1 - u.d2[r]) for r in range(1, K + 1))
    denominator = total + (lost <= 0)
    left = np.where(lost > 0, lost, 1.0) / denominator
    known = (sum(of_word[r - 1] * r * u.d[r] for r in range(1, K + 1)) + big) / u.denominator
    return denominator, left / np.maximum(1 - known, u.unknown)


def _weigh(u: Unigrams):
    def emit(part: int, got: list):
        names, at = np.unique(np.concatenate([g[1][0] for g in got]), return_inverse=True)
        stats = [np.bincount(at, weights=np.concatenate([g[1][i] for g in got]).astype(np.float64), minlength=len(names)) for i in range(1, 2 * K + 3)]
        denominator, alpha = context_weights(stats, u)
        yield part, ALPHA, 0, pack(names, np.log10(alpha))
        begin = 0
        for source, arrays in got:
            own = at[begin : begin + len(arrays[0])]
            begin += len(arrays[0])
            yield source, TOTALS, part, pack(arrays[0], small(denominator[own].astype(np.int64)))

    def job(batches):
        now, got = None, []
        for part, _, source, payload in _runs(batches):
            if part != now and got:
                yield from emit(now, got)
                got = []
            now = part
            got.append((source, unpack(payload)))
        if got:
            yield from emit(now, got)

    return _records(job)


class Model:
    """Tables of a trained model, in the shared folder."""

    def __init__(self, parts: int, unigrams: Unigrams, counts: DataFrame, weights: DataFrame):
        self.parts, self.unigrams, self.counts, self.weights = parts, unigrams, counts, weights


def _deal(blocks: DataFrame, parts: int, *order: str) -> DataFrame:
    n = max(parts, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (dealt(blocks, "part", n) if order[0] == "part" else blocks.repartition(n, order[0])).sortWithinPartitions(*order)


def _deal_lots(blocks: DataFrame, parts: int, waves: int) -> DataFrame:
    """Blocks by part in tasks that get some parts each, one after the other; those of a wave are every ``waves``-th."""
    own = -(-parts // waves)
    n = min(own, max(TASKS_PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism, -(-own // PARTS_PER_TASK)))
    return dealt(blocks, F.floor(F.col("part") / F.lit(waves)), n).sortWithinPartitions("part", "kind", "chunk")


def train(docs: DataFrame, scratch: Scratch) -> Model:
    """Count the whole texts of ``docs``; null text is the empty one. No rows give the model that knows nothing."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    merged = scratch.table("counts", _deal(docs.select("text").mapInArrow(_count(parts), _BLOCK), parts, "part").mapInArrow(_merge(parts), _BLOCK), by=("kind",))
    scratch.release()
    scalars = np.zeros(2 + 2 * (K + 1), np.int64)
    for r in merged.where(F.col("kind") == SCALARS).select("payload").toLocalIterator():  # some numbers from each part
        scalars += unpack(r[0])[0]
    u = Unigrams(int(scalars[0]), int(scalars[1]), scalars[2 : K + 3].tolist(), scalars[K + 3 :].tolist())
    weights = scratch.table("weights", _deal(merged.where(F.col("kind") == CONTEXTS), parts, "part", "chunk").mapInArrow(_weigh(u), _BLOCK))
    scratch.drop(f"counts/kind={CONTEXTS}")
    scratch.release()
    return Model(parts, u, merged, weights)


# --- scoring -----------------------------------------------------------------


def _ask(parts: int, waves: int, wave: int):
    """Blocks of the bigrams of the texts that are in a wave's parts and, in the first, the rows of each chunk."""

    def job(batches):
        import xxhash
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        blocks, rows, name = _Held(), [], xxhash.xxh64(seed=place)

        def out():
            nonlocal place, rows, name
            # the name holds the chunk's place and content: it differs if another pass gets other rows
            key = name.intdigest()
            chunk, place = key - (1 << 64) if key >> 63 else key, place + 1
            yield from ((p, TOKENS, chunk, payload) for p, payload in blocks.out())
            if not wave:
                yield -1 - chunk % parts, ROWS, chunk, pack(*(np.concatenate(c) for c in zip(*rows, strict=True)))
            rows, name = [], xxhash.xxh64(seed=place)

        for batch in W.trimmed(batches):
            data, offsets = W.flat(batch.column(1))
            data = W._LOWER[data]
            ids, held = batch.column(0), batch.column(2)
            for a, b in W.chunks(offsets, CHUNK_BYTES):
                row, before, word = _tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                own = ids.slice(a, b - a)
                own_ids = own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                name.update(data[offsets[a] : offsets[b]].tobytes() + own_ids.tobytes())
                null = np.array(own.is_null().to_numpy(zero_copy_only=False), np.uint8)
                rows.append((own_ids, null, held.slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.uint8), np.bincount(row, minlength=b - a).astype(np.int64)))
                mine = word % np.uint64(parts) % np.uint64(waves) == wave
                blocks.add(_blocks(parts, row[mine], before[mine], word[mine]) if mine.any() else (), int(offsets[b] - offsets[a]), b - a)
                if blocks.size >= HELD_BYTES:
                    yield from out()
        if rows:
            yield from out()

    return _records(job)


def _keys(word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    return W.mix(word * W._K1 ^ W.mix(ctx + W._K3))


class _Part:
    """What a part of the model knows: its words' counts and its bigrams' probabilities."""

    def __init__(self, u: Unigrams, model: list[np.ndarray] | None, totals: list[list[np.ndarray]]):
        self.u = u
        none = np.zeros(0, np.uint64)
        self.words, self.count, self.key, self.log = none, np.zeros(0, np.int64), none, np.zeros(0)
        if model is None:
            return
        word, ctx, n = _bigrams(model)
        self.words = model[0]
        self.count = np.add.reduceat(n, np.cumsum(model[1].astype(np.int64)) - model[1]) if len(n) else self.count
        names = np.concatenate([t[0] for t in totals])
        order = np.argsort(names)
        total = np.concatenate([t[1].astype(np.float64) for t in totals])[order][np.searchsorted(names[order], model[2])]
        p = u.d2[np.minimum(n, K)] ** (n <= K) * n / total[model[3].astype(np.int64)]
        key = _keys(word, ctx)
        order = np.argsort(key)
        self.key, self.log = key[order], np.log10(p)[order]

    @staticmethod
    def find(names: np.ndarray, want: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.full(len(want), -1)
        at = np.minimum(np.searchsorted(names, want), len(names) - 1)
        return np.where(names[at] == want, at, -1)

    def score(self, arrays: list[np.ndarray]):
        """Sums for each row, and the (row, context, times) that are not among the bigrams."""
        u = self.u
        size, at_ctx, n, row = (a.astype(np.int64) for a in (arrays[1], arrays[3], arrays[4], arrays[5]))
        slot = self.find(self.words, arrays[0])
        count = np.where(slot >= 0, self.count[slot] if len(self.count) else 0, 0)
        base = np.repeat(np.log10((count + 0.5) / (u.total + 0.5 * (u.words + 1))), size)
        known = np.repeat(count > 0, size)
        plain = np.repeat(np.log10(u.probability(count)), size)
        got = self.find(self.key, _keys(np.repeat(arrays[0], size), arrays[2][at_ctx]))
        seen = got >= 0
        log = np.where(seen, self.log[got] if len(self.log) else 0.0, plain)
        rows, back = np.unique(row, return_inverse=True)
        sums = [np.bincount(back, weights=x * n, minlength=len(rows)) for x in (log, base, known)]
        rest = ~seen
        return rows, sums, (row[rest], arrays[2][at_ctx[rest]], n[rest])


class _Sums:
    """Sums of rows of chunks, added up over the parts of a task."""

    def __init__(self):
        self.of: dict[int, np.ndarray] = {}
        self.held = 0

    def add(self, chunk: int, rows: np.ndarray, sums: list[np.ndarray]) -> None:
        have, need = self.of.get(chunk), int(rows.max()) + 1 if len(rows) else 0
        if have is None or have.shape[1] < need:
            more = np.zeros((3, need))
            if have is not None:
                more[:, : have.shape[1]] = have
                self.held -= have.shape[1]
            self.of[chunk] = have = more
            self.held += need
        for k, x in enumerate(sums):
            have[k, rows] += x

    def out(self, part: int):
        for chunk, sums in self.of.items():
            rows = np.flatnonzero(sums.any(axis=0))
            if len(rows):
                log, base, known = sums[:, rows]
                yield part, SUMS, chunk, pack(small(rows), log, base, small(np.rint(known).astype(np.int64)))
        self.of, self.held = {}, 0


def _unseen(held: list[tuple], parts: int):
    """Blocks of (chunk, row, context, times), for the parts of the contexts."""
    chunks = np.array([h[0] for h in held], np.int64)
    row, ctx, n = (np.concatenate(c) for c in list(zip(*held, strict=True))[1:])
    of = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
    held.clear()
    to = (ctx % np.uint64(parts)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edge = np.searchsorted(to[by], np.arange(parts + 1))
    for q in np.flatnonzero(np.diff(edge)).tolist():
        pick = by[edge[q] : edge[q + 1]]
        names, at = np.unique(ctx[pick], return_inverse=True)
        used, which = np.unique(of[pick], return_inverse=True)
        yield q, UNSEEN, 0, pack(names, small(at), small(row[pick]), small(n[pick]), chunks[used], small(which))


def _score(u: Unigrams, parts: int):
    def job(batches):
        now, model, totals, part_model = None, None, [], None
        sums, unseen, n_unseen = _Sums(), [], 0
        for part, kind, chunk, payload in _runs(batches):
            if part != now:
                now, model, totals, part_model = part, None, [], None
            if kind == ROWS:
                yield part, ROWS, chunk, payload
                continue
            arrays = unpack(payload)
            if kind == MODEL:
                model = arrays
            elif kind == TOTALS:
                totals.append(arrays)
            else:
                if part_model is None:
                    part_model = _Part(u, model, totals)
                    model, totals = None, []
                rows, own, (row, ctx, n) = part_model.score(arrays)
                sums.add(chunk, rows, own)
                if len(row):
                    unseen.append((chunk, row.astype(np.uint32), ctx, n.astype(np.uint32)))
                    n_unseen += len(row)
                if sums.held >= HELD_SUMS:
                    yield from sums.out(part)
                if n_unseen >= HELD_UNSEEN:
                    yield from _unseen(unseen, parts)
                    n_unseen = 0
        if now is not None:
            yield from sums.out(now)
        if unseen:
            yield from _unseen(unseen, parts)

    return _records(job)


def _backed(part: int, held: list[tuple]):
    """Sums of (chunk, row, weight of back-off)."""
    chunk, row, x = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    chunks, of = np.unique(chunk, return_inverse=True)
    key, back = np.unique((of.astype(np.int64) << 32) | row.astype(np.int64), return_inverse=True)
    total, row = np.bincount(back, weights=x, minlength=len(key)), key & 0xFFFFFFFF
    edge = np.searchsorted(key >> 32, np.arange(len(chunks) + 1))
    for k, name in enumerate(chunks.tolist()):
        own = row[edge[k] : edge[k + 1]]
        yield part, SUMS, name, pack(small(own), total[edge[k] : edge[k + 1]], np.zeros(len(own)), np.zeros(len(own), np.uint8))


def _back_off(batches):
    now, names, log = None, np.zeros(0, np.uint64), np.zeros(0)
    held, n_held = [], 0
    for part, kind, _, payload in _runs(batches):
        if part != now:
            now, names, log = part, np.zeros(0, np.uint64), np.zeros(0)
        arrays = unpack(payload)
        if kind == ALPHA:
            names, log = arrays
            continue
        slot = _Part.find(names, arrays[0])
        alpha = np.where(slot >= 0, log[slot] if len(log) else 0.0, 0.0)
        held.append((arrays[4][arrays[5].astype(np.int64)], arrays[2].astype(np.uint32), alpha[arrays[1].astype(np.int64)] * arrays[3]))
        n_held += len(arrays[2])
        if n_held >= HELD_UNSEEN:
            yield from _backed(part, held)
            n_held = 0
    if held:
        yield from _backed(now, held)


def _gather(batches):
    import pyarrow as pa

    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def out(rows, sums):
        ids, null, held, n = rows
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])], names=names)

    now, rows, sums = None, None, None
    for _, kind, chunk, payload in _runs(batches):
        arrays = unpack(payload)
        if kind == ROWS:  # sorts first: its part is negative
            if now is not None:
                yield out(rows, sums)
            now, rows, sums = chunk, arrays, np.zeros((3, len(arrays[0])))
        elif chunk != now:
            raise ValueError("the texts came in other partitions in another pass over them: write them to a table first")
        else:
            at = arrays[0].astype(np.int64)
            for i in range(3):
                sums[i][at] += arrays[1 + i]
    if now is not None:
        yield out(rows, sums)


def score(docs: DataFrame, model: Model, scratch: Scratch, waves: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score of rows with doc_id, text, held_out.

    The parts are scored in ``waves``, each with its own pass over the texts,
    so that shuffle files hold only a wave's bigrams at a time. ``docs`` must
    give the same rows in the same partitions each time, as a scan of a table
    does; where it doesn't, the job fails.
    """
    parts, kind, wave = model.parts, F.col("kind"), F.pmod("part", F.lit(waves))
    rows = docs.select(F.col("doc_id").cast("long"), "text", "held_out")
    scored = None
    for k in range(waves):
        to_words = rows.mapInArrow(_ask(parts, waves, k), _BLOCK).unionAll(model.counts.where((kind == MODEL) & (wave == k))).unionAll(model.weights.where((kind == TOTALS) & (wave == k)))
        got = scratch.table(f"scored-{k}", _deal_lots(to_words, parts, waves).mapInArrow(_score(model.unigrams, parts), _BLOCK))
        scored = got if scored is None else scored.unionAll(got)
        del to_words
        scratch.release()
    # unseen bigrams have the greater kind: a part's alphas come before them
    to_contexts = scored.where(kind == UNSEEN).unionAll(model.weights.where(kind == ALPHA))
    backed = scratch.table("backed", _deal_lots(to_contexts, parts, 1).mapInArrow(_records(_back_off), _BLOCK))
    sums = scored.where(kind.isin(ROWS, SUMS)).unionAll(backed.withColumn("part", F.col("part") + F.lit(1 << 30)))
    return _deal(sums, parts, "chunk", "part").mapInArrow(_gather, T._parse_datatype_string("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))


def score_with_holdout(docs: DataFrame, folds: int = 5, held_fold: int = 1, scratch_group: str = "katz") -> DataFrame:
    """Train on the rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_fold``; score all rows.

    A-Z count as a-z. Returns doc_id, held_out, n_tokens (words and the end),
    n_known (tokens with a count), train_tokens, base_score (add-half
    unigrams), score (the model), both log10. Null text is empty: one token,
    the end. A null doc_id is trained on. Repeated rows count and come out as
    often as they came; an empty table gives no rows; extra columns are
    ignored.
    """
    spark = session_of(docs)
    scratch = Scratch(spark, scratch_group)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    model = train(rows.where(~F.col("held_out")), scratch)
    return score(rows, model, scratch).withColumn("train_tokens", F.lit(model.unigrams.total).cast("long"))
