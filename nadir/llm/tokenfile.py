"""Token ids in a grammar-compressed file format (Re-Pair).

Documents are tokenised, closed with an end id and laid end to end in
ascending doc_id order. A file is a range of doc_ids; it is cut into blocks of
about ``block_ids`` ids, each with a grammar of its own. Re-Pair replaces
frequent pairs of ids by nonterminals until none is left; a block stores its
rules, the expansion length of each nonterminal, the final sequence and where
each document ends. Any range of ids is decoded by the lengths alone, without
expanding what lies before it.

The files are Parquet with one row per block, so they live in whatever store
Spark writes to, and both directions stream: a task holds one block.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch, session_of

BLOCK_SCHEMA = "file int, block int, n_docs int, n_ids long, first_rule int, doc_ids array<bigint>, doc_ends array<bigint>, rules binary, lengths binary, sequence binary, width int"

# --- Re-Pair -----------------------------------------------------------------


_PAIR_BITS = 20


def _may_be_frequent(seq: np.ndarray, least: int) -> np.ndarray:
    """Places of pairs whose bucket of 2**20 has ``least`` pairs or more."""
    bucket = ((seq[:-1].view(np.uint32) * np.uint32(0x9E3779B1) + seq[1:].view(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - _PAIR_BITS)).astype(np.int64)
    return np.flatnonzero((np.bincount(bucket, minlength=1 << _PAIR_BITS) >= least)[bucket])


def repair(ids: np.ndarray, first_rule: int, min_count: int = 6, max_rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): pairs are replaced until none is found ``min_count`` times (or after ``max_rounds``, if given).

    Each round replaces all pairs found so often at once; where occurrences
    overlap, every other one of the run is taken. A pair that is left with a
    single place by that waits for the next round. A pair can only become
    frequent with a new symbol in it or be one that lost places to others, so
    later rounds count those alone. Rule k stands for symbol ``first_rule + k``.
    """
    seq, rules, top, rounds = ids.astype(np.int32), [np.zeros((0, 2), np.int64)], first_rule, 0
    some = _may_be_frequent(seq, min_count) if len(seq) > 1 else np.zeros(0, np.int64)
    while len(some) and rounds != max_rounds:
        key = (seq[some].astype(np.int64) << 32) | seq[some + 1]
        ordered = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        chosen = ordered[edge[np.flatnonzero(np.diff(edge) >= min_count)]]
        if not len(chosen):
            break
        slot = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
        hit = np.flatnonzero(chosen[slot] == key)
        at, slot = some[hit], slot[hit]
        head = np.concatenate([[True], np.diff(at) != 1])
        take = ((at - np.maximum.accumulate(np.where(head, at, 0))) & 1) == 0
        places = np.bincount(slot[take], minlength=len(chosen))
        used = places >= (2 if places.max() >= 2 else 1)
        take &= used[slot]
        left = at[~take]
        at, slot = at[take], (np.cumsum(used) - 1)[slot[take]]
        chosen = chosen[used]
        seq[at] = top + slot
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        left = left[stay[left] & stay[left + 1]]  # pairs that lost this place but are still there
        fresh = place[at]
        seq = seq[stay]
        again = np.zeros(len(seq), bool)
        again[place[left]] = True
        again[fresh] = True
        again[fresh[fresh > 0] - 1] = True
        some = np.flatnonzero(again[:-1])
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1))
        top += len(chosen)
        rounds += 1
    return seq, np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    out = np.ones(len(rules), np.int64)
    done, top = 0, first_rule
    while done < len(rules):  # rules of a round use symbols of earlier rounds only
        reach = np.flatnonzero(rules[done:].max(axis=1) >= first_rule + done)
        to = done + (int(reach[0]) if len(reach) else len(rules) - done)
        part = rules[done:to]
        out[done:to] = sum(np.where(part[:, i] >= first_rule, out[np.maximum(part[:, i] - first_rule, 0)], 1) for i in (0, 1))
        done, top = to, first_rule + to
    return out


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, end to end."""
    before = np.cumsum(size) - size
    return flat[np.arange(int(size.sum())) + np.repeat(first - before, size)]


class Expansions:
    """The ids that each symbol of a grammar stands for, end to end."""

    def __init__(self, rules: np.ndarray, first_rule: int, lengths: np.ndarray):
        self.size = np.concatenate([np.ones(first_rule, np.int64), lengths.astype(np.int64)])
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.empty(int(self.size.sum()), np.int32)
        self.flat[:first_rule] = np.arange(first_rule)
        done = 0
        while done < len(rules):  # rules of a round use symbols of earlier rounds only
            reach = np.flatnonzero(rules[done:].max(axis=1) >= first_rule + done)
            to = done + (int(reach[0]) if len(reach) else len(rules) - done)
            symbols = rules[done:to].ravel()
            a, b = self.first[first_rule + done], self.first[first_rule + to] if to < len(rules) else len(self.flat)
            self.flat[a:b] = self.of(symbols)
            done = to

    def of(self, seq: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.first[seq], self.size[seq])


def expand(seq: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """All ids of a sequence of symbols."""
    return Expansions(rules, first_rule, expansion_lengths(rules, first_rule)).of(seq)


class Block:
    """A stored block, for random access: ``ids(a, b)`` are the ids at [a, b)."""

    def __init__(self, first_rule: int, rules: bytes, lengths: bytes, sequence: bytes, width: int):
        self.first_rule = first_rule
        self.rules = np.frombuffer(rules, "<u4").reshape(-1, 2).astype(np.int64)
        self.seq = np.frombuffer(sequence, f"<u{width}").astype(np.int64)
        self.symbols = Expansions(self.rules, first_rule, np.frombuffer(lengths, "<u4"))
        self.ends = np.cumsum(self.symbols.size[self.seq]) if len(self.seq) else np.zeros(0, np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.int64)
        i, j = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.ends, b, side="left")
        before = int(self.ends[i - 1]) if i else 0
        return self.symbols.of(self.seq[i : j + 1])[a - before : b - before]


# --- encoding ----------------------------------------------------------------

_encoders: dict[str, TextEncoder] = {}
#: Bytes of text that are encoded together: the more, the fewer distinct words to look up.
_ENCODE_BYTES = 8 << 20
#: Steps of a tokenizer that take any text apart at its white space and drop it (fixed values of its file).
_SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}]
_LOWERCASE = {"type": "Lowercase"}
_SIGNS = ".,;:!?"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LATIN_LETTER = np.zeros(256, bool)  # after the byte C3: U+00C0 to U+00FF but the signs of multiplication and division
_LATIN_LETTER[128:192] = True
_LATIN_LETTER[[0x97, 0xB7]] = False
_LATIN_CAPITAL = _LATIN_LETTER.copy()
_LATIN_CAPITAL[0x9F:] = False
_SIGN_OF = np.zeros(256, np.int64)
_SIGN_OF[list(_SIGNS.encode())] = np.arange(1, len(_SIGNS) + 1)


class TextEncoder:
    """Encodes texts with a tokenizer of the tokenizers library.

    If the file declares just the steps above (with or without lower-casing)
    and a BPE model with word ends, the ids of a text are those of its words
    between white space, so each distinct word is encoded once. A word of
    letters up to U+00FF, with one of the signs ``.,;:!?`` after it at most, is
    one piece of those steps and the sign another; normalisation does no more to it
    than to lower its letters. Such words go through the same model with the
    white space alone as divider, many at a time, and come apart at the ends of
    words. All other words go through the tokenizer as it is. With any other
    tokenizer whole texts do.

    The words seen are kept, up to ``most`` of them, over the tasks of a worker;
    they are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, most: int = 3_000_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        declared = json.loads(self.tokenizer.to_str())
        steps, model = (declared["normalizer"] or {}).get("normalizers"), declared["model"]
        self.fold = steps == [*_NORMAL, _LOWERCASE]
        plain_model = model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "unk_token", "byte_fallback", "ignore_merges"))
        whole = all(not re.search(r"\s", x["content"]) and not x["lstrip"] and not x["rstrip"] for x in declared["added_tokens"])
        self.by_word = (self.fold or steps == _NORMAL) and declared["pre_tokenizer"] == _SPLIT and declared["post_processor"] is None and plain_model and whole and declared["truncation"] is None and declared["padding"] is None
        if self.by_word:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[i for t, i in vocabulary.items() if t.endswith(model["end_of_word_suffix"])]] = True
            signs = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in _SIGNS]
            self.by_word = all(len(x) == 1 for x in signs)
            self.sign_ids = np.array([0, *(x[0] for x in signs)], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.n_flat = np.zeros(1 << 20, np.int32), 0

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, end to end, and how many each has."""
        joined = [b" ".join(words[i : i + 1000]).decode() for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer's model doesn't close every word")
        return ids, np.diff(ends, prepend=0)

    def _encode_each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded], np.int64)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.n_flat], np.zeros(self.n_flat + len(ids), np.int32)])
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        first = self.n_flat + np.cumsum(size) - size
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.first, self.size = np.insert(self.keys, at, keys[order]), np.insert(self.first, at, first[order]), np.insert(self.size, at, size[order])
        self.n_flat += len(ids)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where keys are among those kept, and whether they are."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def _by_word(self, part: np.ndarray, own: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each row)."""
        import pyarrow as pa

        starts, ends, _ = W.scan(part, own)
        low, plain = W._LOWER[part] if self.fold else part, _ASCII_LETTER[part]
        lead = np.flatnonzero(part == 0xC3)  # it begins a letter of two bytes
        plain[lead] = True
        after = lead[lead + 1 < len(part)] + 1
        plain[after] = _LATIN_LETTER[part[after]]
        if self.fold:
            after = after[_LATIN_CAPITAL[part[after]]]
            low[after] = part[after] + 32
        odd = np.zeros(len(part) + 1, np.int32)
        np.cumsum(~plain, dtype=np.int32, out=odd[1:])
        odd = odd[ends] - odd[starts]
        sign = _SIGN_OF[part[ends - 1]] if len(ends) else np.zeros(0, np.int64)
        sign[(odd != 1) | (ends - starts < 2)] = 0
        letters = odd == (sign > 0)
        core_ends = ends - (sign > 0)
        key = np.empty(len(starts), np.uint64)
        key[letters] = W.hash_spans(low, starts[letters], core_ends[letters])
        key[~letters] = W.mix(W.hash_spans(part, starts[~letters], ends[~letters]) ^ W._K2)
        coded = pa.array(key).dictionary_encode()
        index, keys = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy().astype(np.uint64)
        at, known = self._places(keys)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.most:
                self._forget()
                known[:] = False
            example = np.empty(len(keys), np.int64)
            example[index] = np.arange(len(index))
            learned = []
            for raw, which, encode in ((low, letters, self._encode_plain), (part, ~letters, self._encode_each)):
                new = np.flatnonzero(~known & which[example])
                if len(new):
                    text, e = raw.tobytes(), example[new]
                    words = [text[i:j] for i, j in zip(starts[e].tolist(), core_ends[e].tolist(), strict=True)]
                    learned.append((keys[new], *encode(words)))
            self._learn(*(np.concatenate(x) for x in zip(*learned, strict=True)))
            at, _ = self._places(keys)
        core = self.size[at]
        first, core = self.first[at][index], core[index]
        n = core + (sign > 0)
        words_before = np.searchsorted(starts, own)
        total = np.concatenate([[0], np.cumsum(n)])
        count = np.diff(total[words_before])
        closing = end_id is not None
        begin = total[:-1] + (np.repeat(np.arange(len(own) - 1), np.diff(words_before)) if closing else 0)
        ids = np.empty(int(total[-1]) + closing * (len(own) - 1), np.int32)
        before = np.cumsum(core) - core
        each = np.arange(int(core.sum()))
        ids[each + np.repeat(begin - before, core)] = self.flat[each + np.repeat(first - before, core)]
        signed = np.flatnonzero(sign)
        ids[begin[signed] + core[signed]] = self.sign_ids[sign[signed]]
        if closing:
            count = count + 1
            ids[np.cumsum(count) - 1] = end_id
        return ids, count

    def batch(self, column, end_id: int | None):
        """(ids, number of ids of each row) for some rows at a time."""
        data, offsets = W.flat(column)
        for a, b in W.chunks(offsets, _ENCODE_BYTES):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if self.by_word:
                yield self._by_word(part, own, end_id)
                continue
            text = part.tobytes()
            ids, count = self._encode_each([text[i:j] for i, j in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
            if end_id is not None:
                ids, count = np.insert(ids, np.cumsum(count), end_id), count + 1
            yield ids, count


def _write_blocks(path: str, end_id: int, block_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = TextEncoder.of(path)
        first_rule = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        file, number = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal number
            ids = np.concatenate([h[1] for h in held])
            ends = np.cumsum(np.concatenate([h[2] for h in held]))
            keys = [k for h in held for k in h[0]]
            seq, rules = repair(ids, first_rule)
            width = 2 if first_rule + len(rules) <= 1 << 16 else 4
            values = [file, number, len(keys), len(ids), first_rule, keys, ends.tolist(), rules.astype("<u4").tobytes(), expansion_lengths(rules, first_rule).astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes(), width]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            number += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in W.trimmed(batches):
            keys, at = batch.column(0).to_pylist(), 0
            for ids, count in encoder.batch(batch.column(1), end_id):
                ends = np.cumsum(count)
                a = 0
                while a < len(count):  # a block is closed by the document that fills it
                    had, begin = sum(len(h[1]) for h in held), int(ends[a] - count[a])
                    b = min(len(count), int(np.searchsorted(ends, begin + block_ids - had)) + 1)
                    held.append((keys[at + a : at + b], ids[begin : ends[b - 1]], count[a:b]))
                    a = b
                    if sum(len(h[1]) for h in held) >= block_ids:
                        yield flush()
                at += len(count)
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, rows_per_file: int = 4096, max_files: int = 65_536, block_ids: int = 1 << 20) -> None:
    """Write the ids of every whole text of ``docs`` (doc_id integer, text) to ``path``.

    Null text is empty: only the end id. Null doc_id comes first; rows of one
    doc_id follow in order of their texts; equal rows are written as often as
    they come; extra columns are ignored, whatever their names. An empty table
    writes no blocks. There are ``max_files`` files at most, as the driver holds a
    number of each when they are read.
    """
    spark = session_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(max_files, -(-rows.count() // rows_per_file)))
    # an id that many rows share is divided by how their texts begin
    ordered = rows.repartitionByRange(files, "doc_id", F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write_blocks(tokenizer, end_id, block_ids), BLOCK_SCHEMA).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the number of ids in all blocks before."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted(blocks.groupBy("file").agg(F.sum("n_ids")).collect())  # a row per file: at most max_files
    at, rows = 0, []
    for file, n in totals:
        rows.append((file, at))
        at += n
    base = spark.createDataFrame(rows, "file int, base long")
    # the sum runs over the narrow columns; the payloads are joined to it
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "n_ids").join(F.broadcast(base), "file").select("file", "block", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("start"))
    return blocks.join(starts, ["file", "block"])


def _documents(batches):
    import pyarrow as pa

    for batch in W.trimmed(batches):
        for row in batch.to_pylist():
            block = Block(row["first_rule"], row["rules"], row["lengths"], row["sequence"], row["width"])
            ids = block.ids(0, row["n_ids"]).astype("<u4")
            ends = row["doc_ends"]
            cut = [0, *ends]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["start"] + a for a in cut[:-1]], pa.int64()),
                    pa.array([b - a for a, b in zip(cut, ends, strict=False)], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, ends, strict=False)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    return read_token_files(spark, path).mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 1, scratch_group: str = "tokens", **options) -> DataFrame:
    spark = session_of(docs)
    path = f"{Scratch(spark, scratch_group).path}/files"
    write_token_files(docs, path, tokenizer, end_id, **options)
    return document_digests(spark, path)
