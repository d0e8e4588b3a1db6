"""Quality rules over whole texts, with repetition measured on a suffix array.

The words of many documents are laid end to end and sorted by suffix at once.
Ranks start from (document, word), so suffixes of different documents never
share a prefix. Prefix doubling refines only the groups that are still tied,
which is little of ordinary prose, and keeps the rank of each level; the
longest common prefix (LCP) of neighbours in the array then comes from the
levels, greatest first. The greater of the two LCPs beside a suffix is the depth
of its deepest LCP interval: the longest substring that starts there and is
found elsewhere in the document. Those that are as long as ``min_repeat_words``
are the maximal repeats; the union of their spans is what repeats cover.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .scratch import session_of

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def repeat_lengths(rows: np.ndarray, word: np.ndarray) -> np.ndarray:
    """At each word, the length of the longest run of words that starts there and is found elsewhere in its row."""
    n = len(word)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    # any order of the (document, word) alphabet will do, so one 64-bit key of both is sorted
    letter = W.mix(word ^ W.mix(rows.astype(np.uint64) + W._K1))
    order = np.argsort(letter)
    letter = letter[order]
    first = np.concatenate([[True], letter[1:] != letter[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's rank is where it begins
    rank = np.empty(n, np.int64)
    rank[order] = start
    last = np.searchsorted(rows, rows, side="right")  # where each row ends
    levels, width = [rank], 1
    while True:
        size = np.diff(np.append(np.flatnonzero(first), n))
        tied = np.repeat(size > 1, size)
        where = np.flatnonzero(tied)
        if not len(where):
            break
        at = order[where]
        follow = at + width
        inside = follow < last[at]
        second = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key)
        order[where] = at[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first[where] = fresh
        rank = rank.copy()
        rank[at[by]] = np.maximum.accumulate(np.where(fresh, where, 0))
        levels.append(rank)
        width *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        p, q = a + lcp, b + lcp
        live = np.flatnonzero((p < last[a]) & (q < last[b]) & (rows[a] == rows[b]))
        # a level's rank at the end of a row stands for the rest of the row, so both runs must be whole
        whole = (p[live] + (1 << k) <= last[a[live]]) & (q[live] + (1 << k) <= last[b[live]])
        live = live[whole]
        same = levels[k][p[live]] == levels[k][q[live]]
        lcp[live[same]] += 1 << k
    best[a] = lcp
    best[b] = np.maximum(best[b], lcp)
    return best


def covered(best: np.ndarray, length: np.ndarray | int, at_least: int) -> np.ndarray:
    """Words inside the union of spans ``[i, i + length)`` where ``best[i] >= at_least``."""
    n = len(best)
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(best >= at_least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + (length if np.isscalar(length) else length[starts]), -1)
    return np.cumsum(change[:-1]) > 0


def _measure(window: int, min_repeat: int):
    def run(batches):
        import pyarrow as pa

        for batch in W.trimmed(batches):
            data, offsets = W.flat(batch.column(1))
            out = [[] for _ in COLUMNS]
            for a, b in W.chunks(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, rows = W.scan(part, own)
                count = np.bincount(rows, minlength=b - a)
                edge = np.concatenate([[0], np.cumsum(count)])
                best = repeat_lengths(rows, W.hash_spans(part, starts, ends))
                chars = W.counts_by_row(W.code_points(part) & ~W._SPACE[part], own)
                longest = np.zeros(b - a, np.int64)
                np.maximum.at(longest, rows, best)
                twice = []
                for i in range(a, b):
                    seen, twin = set(), 0
                    for line in data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n"):
                        if line in seen:
                            twin += bool(line.split(None, 1))
                        else:
                            seen.add(line)
                    twice.append(twin)
                for col, values in zip(out, (count, chars, W.counts_by_row(_SYMBOL[part], own), twice, W.counts_by_row(covered(best, window, window), edge), W.counts_by_row(covered(best, best, min_repeat), edge), longest), strict=True):
                    col.append(np.asarray(values, np.int64))
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *COLUMNS])

    return run


def measure(docs: DataFrame, window: int = 8, min_repeat: int = 8) -> DataFrame:
    """doc_id and, as long: words, code points in words, symbols of ``#*$%&|<>``,
    lines with a word that equal an earlier line, words in ``window``-word
    windows found twice or more, words that repeats of ``min_repeat`` or more
    words cover, and the longest repeat in words.

    Null text has no words and no lines: all zero. Rows are independent.
    """
    session_of(docs)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.LongType()) for c in COLUMNS)])
    return docs.select("doc_id", "text").mapInArrow(_measure(window, min_repeat), schema)


def verdicts(docs: DataFrame, min_words: int = 20, max_window_percent: int = 30, min_repeat: int = 8, max_covered_percent: int = 30, max_longest_repeat: int = 100) -> DataFrame:
    """``measure`` with base_failed and kept.

    base_failed: fewer than ``min_words`` words, or over ``max_window_percent``
    of them in windows found twice. kept: not base_failed, repeats cover no
    more than ``max_covered_percent`` of the words, and none is longer than
    ``max_longest_repeat`` words. Null and empty text has no words and fails.
    Repeated rows come out as often as they came, extra columns are ignored,
    whatever their names, and an empty table gives no rows.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_window_percent * F.col("n_words"))
    repeats = (100 * F.col("covered_words") > max_covered_percent * F.col("n_words")) | (F.col("longest_repeat") > max_longest_repeat)
    return measure(docs, 8, min_repeat).withColumn("base_failed", base).withColumn("kept", ~base & ~repeats)


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that ``verdicts`` keeps, whole and with their own columns.

    Each row is judged by itself, in one pass: nothing is shuffled or joined, so
    repeated rows share their fate. Columns may have any names.
    """
    session_of(docs)
    columns = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    judge = _keep(columns.index("text"), options)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema.fields)])
    return rows.mapInArrow(judge, schema).toDF(*columns)


def _keep(text_at: int, options: dict):
    o = {"min_words": 20, "max_window_percent": 30, "min_repeat": 8, "max_covered_percent": 30, "max_longest_repeat": 100} | options
    measure_batch = _measure(8, o["min_repeat"])

    def run(batches):
        import pyarrow as pa

        for batch in W.trimmed(batches):
            ask = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(text_at)], names=["doc_id", "text"])
            for got in measure_batch([ask]):
                n, _, _, _, window, cover, longest = (got.column(i).to_numpy() for i in range(1, 8))
                keep = (n >= o["min_words"]) & (100 * window <= o["max_window_percent"] * n) & (100 * cover <= o["max_covered_percent"] * n) & (longest <= o["max_longest_repeat"])
                yield batch.filter(pa.array(keep))

    return run
