"""Sampled SentencePiece segmentations by forward filtering, backward sampling.

A text becomes a space mark, then itself with each space as a mark, as the
model expects. No piece has a mark after another character and some characters
(a line feed) are in no piece at all, so the piece lattice of a text falls
apart exactly at those places: the parts are sampled one by one. Forward sums
are found once for each distinct part; backward draws are made for all its
occurrences at once. A draw depends on the row's key and on the place in the
text only, so segmentations are the same in every run and in every batch.

Weights: a unigram model's scores times ``alpha``; a merge model (BPE) has the
order of merges for scores, and its pieces weigh ``(1 + order) ** -alpha``.
Characters that are no piece are written as their UTF-8 bytes' pieces.
Decoding gives every text back exactly; a space mark in the text itself is
written as bytes, so it isn't taken for a space.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import session_of

_MARK, _OWN_MARK = 0x2581, 0x110000
_K = np.uint64(0x9E3779B97F4A7C15)
_BYTES = 1 << 30  # edge ids from here on stand for a code point written as bytes

_models: dict[tuple[str, float], PieceModel] = {}


class PieceModel:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        score = np.array([sp.get_score(i) for i in range(n)])
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = np.full(256, -1, np.int64)
        self.bytes = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
        if (self.byte_id < 0).any():
            raise ValueError("the model has no pieces for single bytes")
        text = {i: sp.id_to_piece(i) for i in normal}
        for i, p in text.items():
            self.bytes[i] = p.replace("▁", " ").encode()
            if "▁" in p.lstrip("▁"):
                raise ValueError("a piece has a space mark inside")
        s = score[normal]
        merges = len(s) and (s == np.round(s)).all() and 2 * len(np.unique(s)) > len(s)
        weight = -alpha * np.log1p(-s) if merges else alpha * s
        self.floor = float(weight.min()) - 10.0 if len(s) else -10.0
        # hash of every prefix of a piece -> piece or -1
        table: dict[int, tuple[int, float]] = {}
        for i, w in zip(normal, weight, strict=True):
            h, hashes = np.zeros(1, np.uint64), []
            for c in text[i]:
                unit = np.array([ord(c) + 1], np.uint64)
                h = W.mix(h * _K + unit if hashes else unit * _K)
                hashes.append(int(h[0]))
            for x in hashes[:-1]:
                table.setdefault(x, (-1, 0.0))
            table[hashes[-1]] = (i, float(w))
        keys = np.array(list(table), np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.piece = np.array([p for p, _ in table.values()], np.int64)[order]
        self.weight = np.array([w for _, w in table.values()])[order]
        # the first bits of a hash find its range of keys at once
        self.shift = np.uint64(64 - 18)
        self.range = np.searchsorted(self.keys >> self.shift, np.arange((1 << 18) + 1, dtype=np.uint64))
        self.deepest = int(np.diff(self.range).max())
        self.longest = max(map(len, text.values()), default=1)
        self.in_piece = np.unique(np.array([ord(c) for c in {c for p in text.values() for c in p}], np.int64))
        size = np.fromiter(map(len, self.bytes), np.int64, n)
        self.flat, self.first, self.size = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(size) - size, size

    @classmethod
    def of(cls, path: str, alpha: float) -> PieceModel:
        if (path, alpha) not in _models:
            _models[path, alpha] = cls(path, alpha)
        return _models[path, alpha]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, or -1."""
        at = self.range[h >> self.shift]
        end = self.range[(h >> self.shift) + np.uint64(1)]
        out = np.full(len(h), -1, np.int64)
        live = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            got = self.keys[at[live]] == h[live]
            out[live[got]] = at[live[got]]
            at[live] += 1
            live = live[~got]
            live = live[at[live] < end[live]]
            if not len(live):
                break
        return out

    def lattice(self, code: np.ndarray, part_end: np.ndarray):
        """Edges (start, end, id, weight) of parts laid end to end; part_end[i] ends the part of character i."""
        n = len(code)
        starts, ends, ids, weights = [], [], [], []
        at = np.arange(n)
        h = W.mix((code.astype(np.uint64) + np.uint64(1)) * _K)
        single = np.zeros(n, bool)
        length = 1
        while len(at):
            found = self.find(h)
            live = found >= 0
            at, h, found = at[live], h[live], found[live]
            piece = self.piece[found]
            ok = piece >= 0
            if length == 1:
                single[at[ok]] = True
            starts.append(at[ok])
            ends.append(at[ok] + length)
            ids.append(piece[ok])
            weights.append(self.weight[found[ok]])
            more = at + length < part_end[at]
            at, h = at[more], h[more]
            h = W.mix(h * _K + code[at + length].astype(np.uint64) + np.uint64(1))
            length += 1
        rest = np.flatnonzero(~single)
        starts.append(rest)
        ends.append(rest + 1)
        ids.append(_BYTES + code[rest])
        weights.append(np.full(len(rest), self.floor))
        return tuple(map(np.concatenate, (starts, ends, ids, weights)))

    def encode(self, column, keys: np.ndarray):
        """For some rows at a time: all ids, and how many each row has. keys: 64 bits for each row."""
        data, offsets = W.flat(column)
        for a, b in W.chunks(offsets, 1 << 20):
            yield self._encode(data[offsets[a] : offsets[b]].tobytes(), offsets[a : b + 1] - offsets[a], keys[a:b])

    def _encode(self, raw: bytes, offsets: np.ndarray, keys: np.ndarray):
        rows = len(keys)
        code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(W.code_points(np.frombuffer(raw, np.uint8)))])[offsets]
        count = np.diff(before)
        code = np.where(code == _MARK, _OWN_MARK, np.where(code == 32, _MARK, code))
        begin = np.flatnonzero(count > 0)
        code = np.insert(code, before[begin], _MARK)  # the mark before a text
        own = np.concatenate([[0], np.cumsum(count + (count > 0))])
        n = len(code)
        if not n:
            return np.zeros(0, np.int64), np.zeros(rows, np.int64)
        mark = code == _MARK
        slot = np.minimum(np.searchsorted(self.in_piece, code), len(self.in_piece) - 1)
        alien = self.in_piece[slot] != code
        cut = np.zeros(n, bool)
        cut[own[:-1][count > 0]] = True
        cut[1:] |= (mark[1:] & ~mark[:-1]) | alien[1:] | alien[:-1]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], n)
        row = np.searchsorted(own, first, side="right") - 1
        # distinct parts
        bytes_ = code.astype("<u4").view(np.uint8)
        h = W.hash_spans(bytes_, first * 4, last * 4)
        _, where, back = np.unique(h, return_index=True, return_inverse=True)
        size = (last - first)[where]
        base = np.cumsum(size) - size
        total = int(size.sum())
        inside = np.arange(total) - np.repeat(base, size)
        own_code = code[np.repeat(first[where], size) + inside]
        s, e, ids, w = self.lattice(own_code, np.repeat(base + size, size))
        # nodes: part p has nodes base[p] + p .. base[p] + p + size[p]
        part = np.repeat(np.arange(len(size)), size)
        part_e = part[e - 1]
        s, e = s + part_e, e + part_e
        node0 = base + np.arange(len(size))
        depth = inside[e - 1 - part_e] + 1
        order = np.lexsort((e, depth))
        s, e, ids, w, depth = s[order], e[order], ids[order], w[order], depth[order]
        alpha = np.full(total + len(size), -np.inf)
        alpha[node0] = 0.0
        group = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        group_end = np.append(group[1:], len(e))
        step = np.searchsorted(depth[group], np.arange(1, int(depth.max()) + 2))
        share = np.empty(len(e))
        for t in range(len(step) - 1):
            g0, g1 = step[t], step[t + 1]
            if g0 == g1:
                continue
            lo, hi = group[g0], group_end[g1 - 1]
            x = alpha[s[lo:hi]] + w[lo:hi]
            heads = group[g0:g1] - lo
            width = group_end[g0:g1] - group[g0:g1]
            top = np.maximum.reduceat(x, heads)
            p = np.exp(x - np.repeat(top, width))
            total_p = np.add.reduceat(p, heads)
            alpha[e[group[g0:g1]]] = top + np.log(total_p)
            run = np.cumsum(p)
            run -= np.repeat(run[heads] - p[heads], width)
            share[lo:hi] = run / np.repeat(total_p, width)
        node_group = np.full(total + len(size), -1, np.int64)
        node_group[e[group]] = np.arange(len(group))
        ladder = np.repeat(np.arange(len(group)), group_end - group) + share
        # backward draws for all occurrences
        seed = W.mix(keys.astype(np.uint64)[row] ^ _K)
        place = first - own[row]  # of a part in its text
        local0 = node0[back]
        at = local0 + (last - first)
        occ = np.arange(len(first))
        steps, drawn = [], []
        while len(occ):
            u = W.mix(seed[occ] + (place[occ] + at - local0[occ]).astype(np.uint64) * _K)
            u = (u >> np.uint64(11)).astype(np.float64) / (1 << 53)
            g = node_group[at]
            k = np.clip(np.searchsorted(ladder, g + u, side="right"), group[g], group_end[g] - 1)
            steps.append(occ)
            drawn.append(ids[k])
            at = s[k]
            live = at > local0[occ]
            occ, at = occ[live], at[live]
        made = np.zeros(len(first), np.int64)
        for o in steps:
            made[o] += 1
        to = np.cumsum(made)
        out = np.empty(int(to[-1]), np.int64)
        for t, (o, d) in enumerate(zip(steps, drawn, strict=True)):
            out[to[o] - 1 - t] = d
        per_row = np.bincount(row, weights=made, minlength=rows).astype(np.int64)
        wide = np.flatnonzero(out >= _BYTES)
        if len(wide):
            cp = np.where(out[wide] - _BYTES == _OWN_MARK, _MARK, out[wide] - _BYTES)
            units, back_cp = np.unique(cp, return_inverse=True)
            coded = [self.byte_id[np.frombuffer(chr(c).encode(), np.uint8)] for c in units.tolist()]
            n_bytes = np.ones(len(out), np.int64)
            n_bytes[wide] = np.fromiter(map(len, coded), np.int64, len(coded))[back_cp]
            spread = np.repeat(out, n_bytes)
            begin = (np.cumsum(n_bytes) - n_bytes)[wide]
            for j in range(4):
                has = n_bytes[wide] > j
                spread[begin[has] + j] = np.array([c[j] if len(c) > j else 0 for c in coded])[back_cp[has]]
            out_row = np.repeat(np.arange(rows), per_row)
            per_row = np.bincount(out_row, weights=n_bytes, minlength=rows).astype(np.int64)
            out = spread
        return out, per_row

    def decode(self, ids: np.ndarray, per_row: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row."""
        size = self.size[ids]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[ids], size)
        raw = self.flat[at].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(per_row)]
        starts = np.concatenate([[0], ends[:-1]])
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def row_keys(column, seed: int) -> np.ndarray:
    """64 bits for each key of a column, by its text; null is a key of its own."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest("" if k is None else f"={k}", seed=seed) for k in column.to_pylist()], np.uint64)


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 0, id_lists: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sampled ids of every whole text of ``docs`` (doc_id, text), and whether they decode to it.

    Returns doc_id, the columns named in ``keep``, n_pieces long, ids_crc32 long
    (of the ids as little-endian 32-bit integers), lossless boolean, and ids if
    ``id_lists``. Null text is empty and has no ids; a row's key is its doc_id,
    null included, so repeated rows come out alike; an empty table gives no
    rows. Rows are independent: nothing is shuffled. Other columns are ignored;
    a kept one must not have the name of a column of the result. The model must
    have pieces for all bytes and none with the mark of a blank inside.
    """
    session_of(docs)
    clash = {"doc_id", "n_pieces", "ids_crc32", "lossless", "ids"} & set(keep)
    if clash:
        raise ValueError(f"kept columns have names of the result's: {sorted(clash)}")
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(docs.schema[c] for c in keep), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("lossless", T.BooleanType())]
    if id_lists:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def run(batches):
        import pyarrow as pa

        m = PieceModel.of(model, alpha)
        for batch in W.trimmed(batches):
            keys = row_keys(batch.column(0), seed)
            text = batch.column(1)
            at = 0
            for ids, count in m.encode(text, keys):
                rows = len(count)
                cut = np.concatenate([[0], np.cumsum(count)])
                data = ids.astype("<i4")
                back = m.decode(ids, count)
                same = [(x or "").encode() == y for x, y in zip(text.slice(at, rows).to_pylist(), back, strict=True)]
                arrays = [batch.column(0).slice(at, rows), *(batch.column(2 + i).slice(at, rows) for i in range(len(keep))), pa.array(count), pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64()), pa.array(same, pa.bool_())]
                if id_lists:
                    arrays.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(data)))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                at += rows

    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give null text."""
    session_of(encoded)
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        m = PieceModel.of(model, 1.0)
        for batch in W.trimmed(batches):
            lists = batch.column(1).to_pylist()
            ids = np.array([i for x in lists for i in x or ()], np.int64)
            back = m.decode(ids, np.array([len(x or ()) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else y.decode() for x, y in zip(lists, back, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, schema)
