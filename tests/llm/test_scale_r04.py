"""What kept line dedup and Katz scores from larger tables: pairs held together, and blocks of single rows."""

import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from nadir.llm import katz, linededup
from nadir.llm import words as W


def entries_of(lines, first=0):
    """Posting-list entries of lines (sorted hashes of words), each under all words of its prefix."""
    out = [[] for _ in linededup.ENTRY]
    for i, w in enumerate(lines):
        bit, low = np.uint64(1) << (w & np.uint64(63)), (w & np.uint64(64)) == 0
        p1, p2 = (np.bitwise_xor.reduce(np.where(x, bit, np.uint64(0))) for x in (low, ~low))
        if len(w) <= linededup.SHORT:
            p1, p2 = p1 ^ p2, np.uint64(0)
        h1 = np.add.reduce(W.mix(w + W._K1))
        for place in range(len(w) - (4 * len(w) + 4) // 5 + 1):
            for c, v in zip(out, (w[place], h1, p1, p2, first + i // 3, i % 3, len(w), place), strict=True):
                c.append(v)
    columns = [np.array(c, np.uint64 if k < 4 else np.int64) for k, c in enumerate(out)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def near_copies(rng, groups, n, size, most):
    """``n`` near copies of each of some lines, with up to ``most`` words changed."""
    words = rng.integers(1, 1 << 63, 40 * size, dtype=np.uint64)
    for _ in range(groups):
        base = rng.choice(words, size, replace=False)
        for _ in range(n):
            line = base.copy()
            k = int(rng.integers(0, most + 1))
            line[rng.choice(size, k, replace=False)] = rng.choice(words, k)
            yield np.unique(line)


def test_memory_of_candidates_follows_the_lines_of_a_group_of_near_copies():
    columns = entries_of(near_copies(np.random.default_rng(3), 1, 2400, 50, 1))
    tracemalloc.start()
    later, _, more, crowded = linededup.candidates(columns, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20  # all pairs of the group took 500 MB
    assert more.any() and len(crowded) and Counter(columns[1][later].tolist()).most_common(1)[0][1] <= 6 * 11


@pytest.mark.parametrize(("held", "at_once"), [(1 << 19, 1 << 18), (40, 7)])
def test_no_candidate_is_lost_when_few_pairs_are_held(monkeypatch, held, at_once):
    monkeypatch.setattr(linededup, "PAIRS_HELD", held)
    monkeypatch.setattr(linededup, "PAIRS_AT_ONCE", at_once)
    lines = list(near_copies(np.random.default_rng(4), 4, 40, 30, 5))
    columns = entries_of(lines)
    doc, number, h1 = columns[4], columns[5], columns[1]
    turn = {}  # of the first line of each set
    for h, d, n in zip(h1.tolist(), doc.tolist(), number.tolist(), strict=True):
        turn[h] = min(turn.get(h, (d, n)), (d, n))
    sets = {int(np.add.reduce(W.mix(w + W._K1))): set(w.tolist()) for w in lines}
    similar = {(a, b) for a, s in sets.items() for b, o in sets.items() if a != b and (turn[b], b) < (turn[a], a) and 5 * len(s & o) >= 4 * len(s | o)}
    later, earlier, more, crowded = linededup.candidates(columns, 2)
    named = defaultdict(set)
    for y, x in zip(h1[later].tolist(), h1[earlier].tolist(), strict=True):
        named[y].add(x)
    assert max(map(len, named.values())) == 2
    others = set(h1[later[more]].tolist())
    rest = [c[crowded] for c in columns]
    at, lists = linededup.listed(rest)
    found = {(a, b) for y, x, _ in linededup.meetings(rest, at, lists) for a, b in zip(rest[1][at[y]].tolist(), rest[1][at[x]].tolist(), strict=True)}
    assert similar and all(b in named[a] or (a in others and (a, b) in found) for a, b in similar)


def test_chunks_of_a_task_share_its_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{x}" for x in rng.integers(0, 90, 30)) for _ in range(20)])], names=["text"]) for _ in range(6)]
    want = Counter()
    for b in batches:
        data, offsets = W.flat(b.column(0))
        _, before, word = katz._tokens(data, offsets)
        want.update(zip(word.tolist(), before.tolist(), strict=True))
    rows = [r for b in katz._count(5)(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == 5  # one for each part; it was one for each batch and part
    got = Counter()
    for r in rows:
        for w, v, n in zip(*(x.tolist() for x in katz._bigrams(katz.unpack(r["payload"]))), strict=True):
            assert w % 5 == r["part"]
            got[w, v] += n
    assert got == want


def test_bigrams_not_in_training_of_many_chunks_share_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    names = np.unique(rng.integers(1, 1 << 63, 60, dtype=np.uint64))
    parts, weight = 7, dict(zip(names.tolist(), rng.random(len(names)).tolist(), strict=True))
    held, want = [], defaultdict(float)
    for chunk in range(-20, 20):
        row, ctx, n = rng.integers(0, 9, 50), rng.choice(names, 50), rng.integers(1, 4, 50)
        held.append((chunk, row, ctx, n))
        for r, c, k in zip(row.tolist(), ctx.tolist(), n.tolist(), strict=True):
            want[chunk, r] += weight[c] * k
    blocks = list(katz._unseen(held, parts))
    assert len(blocks) == parts  # it was one for each chunk and part
    own = [names[names % np.uint64(parts) == q] for q in range(parts)]
    alphas = [(q, katz.ALPHA, 0, katz.pack(own[q], np.array([weight[c] for c in own[q].tolist()]))) for q in range(parts)]
    for at_most in (1 << 20, 100):
        monkeypatch.setattr(katz, "HELD_UNSEEN", at_most)
        got = defaultdict(float)
        for _, kind, chunk, payload in katz._back_off([katz._record(sorted(alphas + blocks, key=lambda x: x[:2]))]):
            assert kind == katz.SUMS
            rows, log, _, _ = katz.unpack(payload)
            for r, x in zip(rows.tolist(), log.tolist(), strict=True):
                got[chunk, r] += x
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sums_of_a_task_come_back_once_for_each_chunk():
    sums = katz._Sums()
    sums.add(3, np.array([0, 2]), [np.array([-1.0, -2.0]), np.array([-3.0, -4.0]), np.array([1.0, 1.0])])
    sums.add(3, np.array([2, 5]), [np.array([-1.0, -2.0]), np.array([-1.0, -1.0]), np.array([0.0, 2.0])])
    assert sums.held == 6
    ((part, kind, chunk, payload),) = sums.out(1)
    rows, log, base, known = (x.tolist() for x in katz.unpack(payload))
    assert (part, kind, chunk, rows, log, base, known) == (1, katz.SUMS, 3, [0, 2, 5], [-1, -3, -2], [-3, -5, -1], [1, 1, 2])
