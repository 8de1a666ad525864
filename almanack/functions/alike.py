"""Which of many names may be similar: pairs that meet bounds no similar pair can miss.

Similarity is the ratio ``2M / S`` of the standard library (``functions/similarity.py``), and a pair
is similar if its ``M`` matched characters reach ``least(S)``. Names are compared where they lie,
by one of two ways. Both are exact: a pair that is left out is not similar.

* **By grams**, if both names have 200 letters or more and *few rare ones*. The library's matcher
  starts a block only at a letter that stands in no more than one place in a hundred of its second
  name (``autojunk``), but for one block at the very beginning. So a pair has at most ``R + 1``
  blocks, ``R`` the rare letters of the name that has more of them, and shares at least
  ``M - (q - 1) (R + 1)`` grams of ``q`` letters. That allows grams so long that unlike names have
  few in common, and pairs are found through the grams they share. For those, ``R`` is
  the rare letters that both names have.
* **By letters** otherwise. The letters of a name are counted; a pair shares the sum of the lesser
  counts. Counts are written as bits (the k-th bit of a letter: it stands there k times or more), so
  this sum is the number of bits in common, for whole runs of names at once. Pairs with enough of
  them get the length of their longest common subsequence, many pairs at a time, bit by bit; rare
  letters may pass for one another there, which can only add candidates.

Pairs that share enough grams are measured in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np

from almanack.functions.similarity import longest_partner, shortest_partner

Pairs = tuple[np.ndarray, np.ndarray]
Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Length from which the library's matcher leaves common letters out.
JUNK_FROM = 200
#: Most rare letters, as a share of its length, of a name that is compared by grams, and the least share of the grams that similar ones then have in common.
FEW = 0.1
LEAST_SHARE = 0.1

#: Letters that are told apart when counted, and when subsequences are measured.
KINDS = 256
CODES = 63
#: Meetings of equal grams, and pairs of names, that one step of a comparison holds at once.
MEETINGS = 1 << 21
CELLS = 1 << 22
#: Pairs whose bits are compared at once, pairs whose subsequences are measured at once, and bits that are packed at once.
AREA = 1 << 16
BATCH = 1 << 13
PACKED = 1 << 24
#: Below this number of pairs per 63 letters, measuring them together is slower than one by one, as the exact test does.
TOGETHER = 8


def least(total: np.ndarray, threshold: float) -> np.ndarray:
    """Fewest characters that two similar names of ``total`` characters match."""
    return np.ceil(threshold * total / 2 - 1e-9).astype(np.int64)


class Letters:
    """The letters of ``names`` one after another, as ranks by frequency."""

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4")
        times = np.bincount(self.text)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        self.rank = rank[self.text].astype(np.int32)
        self.codes = (self.rank % CODES).astype(np.uint8)
        self.kinds = int(np.count_nonzero(times))
        self.of = np.repeat(np.arange(len(names), dtype=np.int32), self.lengths)

    def counts(self, kind: np.ndarray) -> np.ndarray:
        """Names by kinds."""
        return np.bincount(self.of * np.int64(KINDS) + kind, minlength=len(self.lengths) * KINDS).reshape(-1, KINDS).astype(np.int32)

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Names by kinds: how often a letter stands there, and, at least, where a block can start if the name is the second."""
        counts = self.counts(np.minimum(self.rank, KINDS - 1))
        rare = (counts <= (self.lengths // 100 + 1)[:, None]) | (self.lengths < JUNK_FROM)[:, None]
        if self.kinds > KINDS:
            rare[:, -1] = True  # several letters are counted as one here
        return counts, np.where(rare, counts, 0)


def alike(names: list[str], split: int, threshold: float, allowed: Allowed) -> Iterator[Pairs]:
    """Pairs (i, j) of places in ``names`` that may be similar, each once.

    The first ``split`` names meet the others, or one another if there are no others.
    ``allowed(i, j)`` tells which pairs count.
    """
    own, place, letters = split == len(names), np.arange(len(names)), Letters(names)
    counts, starts = letters.starts()
    few = (letters.lengths >= JUNK_FROM) & (starts.sum(axis=1) <= FEW * letters.lengths)
    long, rest = place[few], place[~few]
    if len(long):
        found = by_grams([names[k] for k in long], int((long < split).sum()), own, threshold, counts[long], starts[long], lambda i, j: allowed(long[i], long[j]))
        yield from measured(letters, ((long[i], long[j]) for i, j in found), threshold)
    if own:
        yield from measured(letters, by_letters(letters, rest, rest, True, threshold, allowed), threshold)
        yield from measured(letters, by_letters(letters, rest, long, False, threshold, allowed), threshold)
    else:
        yield from measured(letters, by_letters(letters, rest[rest < split], place[split:], False, threshold, allowed), threshold)
        yield from measured(letters, by_letters(letters, long[long < split], rest[rest >= split], False, threshold, allowed), threshold)


def _grams(names: list[str], q: int) -> tuple[np.ndarray, ...]:
    """(name, gram, first place, last place) of the grams of ``names``, by name.

    A gram's n-th occurrence in a name is a gram of its own, so shared ones are counted with
    multiplicity; its places are those of all occurrences. Grams are told apart by the upper bits of
    a hash, the place below them: two that fall together are one gram to all names, which can only
    add candidates.
    """
    lengths = np.array([len(n) for n in names], np.int64)
    begins = np.cumsum(lengths) - lengths
    text = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    key = np.zeros(max(len(text) - q + 1, 0), np.uint64)
    for i in range(q):
        key = (key + text[i : i + len(key)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    of = np.repeat(np.arange(len(names), dtype=np.int32), lengths)[: len(key)]
    place = (np.arange(len(key)) - begins[of]).astype(np.int32)
    at = np.flatnonzero(place + q <= lengths[of])
    of, place = of[at], place[at]
    low = np.uint64(max(len(at), 1).bit_length())
    packed = np.sort((key[at] >> low << low) | np.arange(len(at), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    packed >>= low
    other = np.r_[True, packed[1:] != packed[:-1]][: len(packed)]
    name = of[order]
    start = np.flatnonzero(other | np.r_[True, name[1:] != name[:-1]][: len(name)])
    times = np.diff(np.r_[start, len(order)])
    nth = np.arange(len(order)) - np.repeat(start, times)
    ids = np.cumsum(other) - 1
    again = np.flatnonzero(nth)
    if len(again):
        many = ids[-1] + 1
        _, ids[again] = np.unique(ids[again] * (1 + int(times.max())) + nth[again], return_inverse=True)
        ids[again] += many
    gram, first, last = (np.empty(len(order), np.int32) for _ in range(3))
    gram[order] = ids
    first[order], last[order] = np.repeat(place[order[start]], times), np.repeat(place[order[start + times - 1]], times)
    return of, gram, first, last


def _common_starts(counts: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Most blocks but one that each of the pairs may have, in either order of its names."""
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), BATCH):
        p, q = i[k : k + BATCH], j[k : k + BATCH]
        out[k : k + BATCH] = np.maximum(np.minimum(counts[p], starts[q]).sum(axis=1), np.minimum(counts[q], starts[p]).sum(axis=1))
    return out


def by_grams(names: list[str], split: int, own: bool, threshold: float, counts: np.ndarray, starts: np.ndarray, allowed: Allowed) -> Iterator[Pairs]:
    """Pairs of names with few rare letters that share enough grams, where they may stand.

    Shared grams are counted per pair, wherever they stand, and then, for pairs with enough of
    them, those in places that may align.
    """
    n = len(names)
    # so wide that equally long similar names still share LEAST_SHARE of them
    q = 1 + max(0, math.floor((threshold / (2 - threshold) - LEAST_SHARE) / (FEW + 1 / JUNK_FROM)))
    lengths, rare = np.array([len(x) for x in names], np.int64), starts.sum(axis=1)
    of, gram, first_at, last_at = _grams(names, q)
    border = len(of) if own else int(np.searchsorted(of, split))
    a = np.argsort(gram[:border], kind="stable").astype(np.int32)
    found = np.searchsorted(gram[:border][a], np.arange(int(gram.max(initial=-1)) + 2)).astype(np.int32)
    first = 0 if own else split
    b = np.arange(0 if own else border, len(of), dtype=np.int32)
    begin, many = found[gram[b]], np.diff(found)[gram[b]]
    owner = of[b]
    # second names in runs, each with a bounded number of meetings and of pairs
    sums, at = np.r_[0, np.cumsum(np.bincount(owner, many, n)[first:])], 0
    while at < n - first:
        size = min(CELLS // max(split, 1), int(np.searchsorted(sums, sums[at] + MEETINGS, "right")) - 1 - at, n - first - at)
        low, size = first + at, max(1, size)
        at += size
        lo, hi = np.searchsorted(owner, [low, low + size])
        c = many[lo:hi]
        total = int(c.sum())
        if not total:
            continue
        x = a[np.repeat(begin[lo:hi] - np.cumsum(c, dtype=np.int32) + c, c) + np.arange(total, dtype=np.int32)]
        y = np.repeat(b[lo:hi], c)
        cell = np.repeat((owner[lo:hi] - np.int32(low)) * np.int32(split), c) + of[x]
        shared = np.bincount(cell, minlength=size * split)
        pair = np.flatnonzero(shared)
        i, j = pair % split, pair // split + low
        s, longer = lengths[i] + lengths[j], lengths[j] - lengths[i]
        matched = least(s, threshold)
        slack = s - 2 * matched
        # a block less than unmatched letters and one, or than letters to start at and one
        need = matched - (q - 1) * (np.minimum(slack, np.maximum(rare[i], rare[j])) + 1)
        good = (shared[pair] >= need) & (np.abs(longer) <= slack)
        if own:
            good &= i < j
        good[good] &= allowed(i[good], j[good])
        blocks = np.minimum(slack[good], _common_starts(counts, starts, i[good], j[good])) + 1
        need[good] = matched[good] - (q - 1) * blocks
        good[good] &= shared[pair[good]] >= need[good]
        if not good.any():
            continue
        pair, i, j, need, longer, slack = (v[good] for v in (pair, i, j, need, longer, slack))
        number = np.full(size * split, -1, np.int32)
        number[pair] = np.arange(len(pair))
        k = number[cell]
        x, y, k = x[k >= 0], y[k >= 0], k[k >= 0]
        may = (2 * (first_at[y] - last_at[x]) <= (longer + slack)[k]) & (2 * (last_at[y] - first_at[x]) >= (longer - slack)[k])
        good = np.bincount(k[may], minlength=len(pair)) >= need
        yield i[good], j[good]


def _bits(counts: np.ndarray, letter: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Words by names: whether each ``letter`` stands in a name the given ``times`` or more."""
    words = -(-len(letter) // 64)
    out, rows = np.empty((words, len(counts)), np.uint64), max(1, PACKED // max(1, len(letter)))
    for k in range(0, len(counts), rows):
        flags = np.zeros((len(counts[k : k + rows]), words * 64), bool)
        flags[:, : len(letter)] = counts[k : k + rows][:, letter] >= times
        out[:, k : k + rows] = np.packbits(flags, axis=1).view(np.uint64).T
    return out


def by_letters(letters: Letters, x: np.ndarray, y: np.ndarray, own: bool, threshold: float, allowed: Allowed) -> Iterator[Pairs]:
    """Pairs of the names ``x`` and ``y`` with enough letters in common."""
    if not len(x) or not len(y):
        return
    size = letters.lengths
    x = x[np.argsort(size[x], kind="stable")]
    y = x if own else y[np.argsort(size[y], kind="stable")]
    counts = letters.counts(letters.rank % KINDS)
    # a letter's bits: as many as two names at least have
    used = counts[x if own else np.r_[x, y]]
    top = np.partition(used, max(0, len(used) - 2), axis=0)[max(0, len(used) - 2)]
    letter = np.repeat(np.arange(KINDS), top)
    times = np.arange(len(letter)) - np.repeat(np.cumsum(top) - top, top) + 1
    left = _bits(counts[x], letter, times)
    right = left if own else _bits(counts[y], letter, times)
    kind = np.uint16 if len(letter) < 1 << 16 else np.uint32
    partner, r = size[y], 0
    while r < len(x):
        lo, hi = np.searchsorted(partner, [shortest_partner(int(size[x[r]]), threshold), longest_partner(int(size[x[min(r + 63, len(x) - 1)]]), threshold) + 1])
        rows = max(1, min(64, AREA // max(1, hi - lo), len(x) - r))
        hi = min(np.searchsorted(partner, longest_partner(int(size[x[r + rows - 1]]), threshold) + 1), r + rows if own else len(y))
        if hi > lo:
            shared, common, ones = (np.zeros((rows, hi - lo), k) for k in (kind, np.uint64, np.uint8))
            for p, q in zip(left, right):
                np.bitwise_and(p[r : r + rows, None], q[None, lo:hi], out=common)
                np.bitwise_count(common, out=ones)
                np.add(shared, ones, out=shared)
            # first by the shortest name of the rows
            p = np.flatnonzero(shared >= least(size[x[r]] + partner[lo:hi], threshold).astype(kind))
            i, j = p // (hi - lo) + r, p % (hi - lo) + lo
            s, longer = size[x[i]] + partner[j], partner[j] - size[x[i]]
            matched = least(s, threshold)
            good = (shared.ravel()[p] >= matched) & (np.abs(longer) <= s - 2 * matched)
            if own:
                good &= j < i
            i, j = x[i[good]], y[j[good]]
            good = allowed(i, j)
            yield i[good], j[good]
        r += rows


def measured(letters: Letters, found: Iterator[Pairs], threshold: float) -> Iterator[Pairs]:
    """The pairs of ``found`` with enough letters in the same order, in batches."""
    waiting, held = [], 0
    for pairs in found:
        waiting.append(pairs)
        held += len(pairs[0])
        if held >= BATCH:
            yield in_order(letters, *map(np.concatenate, zip(*waiting)), threshold)
            waiting, held = [], 0
    if held:
        yield in_order(letters, *map(np.concatenate, zip(*waiting)), threshold)


def in_order(letters: Letters, a: np.ndarray, b: np.ndarray, threshold: float) -> Pairs:
    """Those of the pairs whose longest common subsequence may reach what similar names match.

    Bit-parallel addition as in :func:`~almanack.functions.similarity.common_length`, a letter of all
    second names at a time; words have 63 letters of the first name and a bit for the carry. A letter's
    partner stands no further off than unmatched letters move it, and other words rest.
    """
    size = letters.lengths
    words = -(-int(size[a].max()) // 63)
    if len(a) < TOGETHER * words:
        return a, b
    order = np.argsort(-size[b], kind="stable")
    a, b = a[order], b[order]
    la, lb = size[a], size[b]
    matched = least(la + lb, threshold)
    back, ahead = int((lb - matched).max()), int((la - matched).max())
    names, base = np.unique(a, return_inverse=True)
    base *= CODES + 1
    stands = np.zeros((words, len(names) * (CODES + 1)), np.uint64)
    for k in range(int(la.max())):
        u = np.flatnonzero(size[names] > k)
        stands[k // 63][u * (CODES + 1) + letters.codes[letters.begins[names[u]] + k]] |= np.uint64(1 << k % 63)
    steps = int(lb[0])
    active = np.searchsorted(-lb, -np.arange(steps), "left")
    place, full, up = letters.begins[b], np.uint64((1 << 63) - 1), np.uint64(63)
    row = np.full((words, len(a)), full)
    common, total, carry = (np.empty(len(a), np.uint64) for _ in range(3))
    at, code = np.empty(len(a), np.int64), np.empty(len(a), np.uint8)
    for k in range(steps):
        p = active[k]
        np.take(letters.codes, place[:p], out=code[:p], mode="clip")
        np.add(base[:p], code[:p], out=at[:p])
        place[:p] += 1
        u, s, c, start, stop = common[:p], total[:p], carry[:p], max(0, (k - back) // 63), min(words, (k + ahead) // 63 + 1)
        for w in range(start, stop):
            v = row[w, :p]
            np.take(stands[w], at[:p], out=u, mode="clip")
            np.bitwise_and(v, u, out=u)
            np.add(v, u, out=s)
            if w > start:
                np.add(s, c, out=s)
            if w + 1 < stop:
                np.right_shift(s, up, out=c)
            np.bitwise_xor(v, u, out=u)
            np.bitwise_or(s, u, out=v)
            np.bitwise_and(v, full, out=v)
    length = np.zeros(len(a), np.int64)
    for w in range(words):
        inside = np.clip(la - 63 * w, 0, 63)
        length += inside - np.bitwise_count(row[w] & ((np.uint64(1) << inside.astype(np.uint64)) - np.uint64(1)))
    good = length >= matched
    return a[good], b[good]
