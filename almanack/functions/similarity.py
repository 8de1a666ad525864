"""Name normalising, sequence similarity, and the grams used to find candidates.

Similarity is the Ratcliff-Obershelp ratio ``2M / (|a| + |b|)`` of the standard library, with
the earlier name as first argument (it is not symmetric).

Candidate rule, without loss. Let ``S = |a| + |b|`` and let ``M`` characters match in ``k``
blocks. Between two blocks at least one character is unmatched, so ``k <= S - 2M + 1``, and the
names share at least ``M - (q - 1) k`` grams of ``q`` characters counted with multiplicity, in
places that differ by no more than the unmatched characters allow. From this:

* Similar names' lengths stand in a bounded ratio, so they meet in the longer one's *length
  step*: a name is indexed in its own step and, for longer partners, in the next.
* ``q`` is the longest for which long names of the threshold still share a good part of their
  grams; steps of short names take a shorter one, down to single characters.
* Of the grams that a name shares with any partner, half may be left out, the most common
  first and no gram in part. Under one order for all names, a pair then still shares its need
  less the larger of the two numbers left out, and pairs that share fewer are no candidates.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Trademark signs, a trailing dash-wrapped subtitle, and white space to drop.
TRADEMARKS = ("®", "Ⓡ")
TRADEMARK_TEXT = "(r)"
SUBTITLE = r"(?U)[－—\-][^－—\-]{2,}[－—\-]\s*$"
SPACES = r"(?U)\s+"


def norm_name(c: Column) -> Column:
    """Name key: trademark signs spelled out, subtitle and all white space dropped, lower case."""
    for sign in TRADEMARKS:
        c = F.replace(c, F.lit(sign), F.lit(TRADEMARK_TEXT))
    c = F.regexp_replace(c, SUBTITLE, "")
    return F.lower(F.regexp_replace(c, SPACES, ""))


def bigrams(name: str) -> Counter:
    return Counter(zip(name, name[1:]))


def sequence_ratio(a: str, b: str, floor: float = 0.0, count=bigrams) -> float:
    """The ratio, or 0.0 when too few shared bigrams already rule out ``floor``."""
    if floor and not _plausible(a, b, floor, count):
        return 0.0
    return SequenceMatcher(None, a, b).ratio()


def common_length(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel addition; ``masks`` are those of ``a``."""
    found = (letter_masks(a) if masks is None else masks).get
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        if u := v & found(ch, 0):
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _plausible(a: str, b: str, floor: float, count) -> bool:
    """False when shared bigrams or the common subsequence, both upper bounds, rule out ``floor``."""
    total = len(a) + len(b)
    need = shared_bigrams(total, floor)
    if need > 0 and (count(a) & count(b)).total() < need:
        return False
    return common_length(a, b) >= floor * total / 2 - 1e-9


def ratio(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Similarity of two normalised names, in Arrow batches."""

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        count = lru_cache(maxsize=10_000)(bigrams)
        return pd.Series(
            [None if p is None or q is None else sequence_ratio(p, q, floor, count) for p, q in zip(x, y)],
            dtype="float64",
        )

    return apply(a, b)


def letter_masks(a: str) -> dict[str, int]:
    """Where each character stands in ``a``, as bits."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def both_ratios(p: str, q: str, floor: float, masks=letter_masks) -> tuple[float, float]:
    """The ratio in both argument orders, or zeros if the common subsequence, an upper bound, rules out ``floor``."""
    if common_length(p, q, masks(p)) < floor * (len(p) + len(q)) / 2 - 1e-9:
        return 0.0, 0.0
    return sequence_ratio(p, q), sequence_ratio(q, p)


def _matched(total: int, threshold: float) -> int:
    """Fewest characters that two similar names of ``total`` characters match."""
    return math.ceil(threshold * total / 2 - 1e-9)


def shared_grams(total: int, q: int, threshold: float) -> int:
    """Fewest grams of ``q`` characters two similar names of ``total`` characters can share."""
    return (2 * q - 1) * _matched(total, threshold) - (q - 1) * (total + 1)


def shared_bigrams(total: int, threshold: float) -> int:
    return shared_grams(total, 2, threshold)


def longest_partner(length: int, threshold: float) -> int:
    return math.floor(length * (2 - threshold) / threshold + 1e-9)


def shortest_partner(length: int, threshold: float) -> int:
    return math.ceil(length * threshold / (2 - threshold) - 1e-9)


#: Longest grams that are used, and the least share of a name's grams that equally long similar names have in common.
WIDEST = 4
LEAST_SHARE = 0.25


def _gain(q: int, threshold: float) -> float:
    """Shared grams per character of a name, in the limit of long names."""
    return (2 * q - 1) * threshold - 2 * (q - 1)


def widest(threshold: float) -> int:
    return max(q for q in range(1, WIDEST + 1) if q == 1 or _gain(q, threshold) >= LEAST_SHARE - 1e-9)


def _least_shared(low: int, high: int, q: int, threshold: float) -> int:
    """Least need over totals from ``low`` to ``high``; it grows but for the rounding of one step."""
    span = math.ceil((4 * q + 2) / _gain(q, threshold)) + 4
    return min(shared_grams(s, q, threshold) for s in range(low, min(high, low + span) + 1))


@lru_cache(maxsize=None)
def length_steps(threshold: float, upto: int = 1 << 31) -> tuple[list[int], list[int]]:
    """First length of every step, and the width of the grams used in it."""
    starts, widths = [1], []
    while starts[-1] <= upto:
        starts.append(longest_partner(starts[-1], threshold) + 1)
    for first in starts:
        low = first + shortest_partner(first, threshold)
        widths.append(next((q for q in range(widest(threshold), 1, -1) if _least_shared(low, 4 * low, q, threshold) >= 1), 1))
    return starts, widths


def _ranked(name: str, q: int, common: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(gram, times, first place, last place), the least common first."""
    places: dict[str, list[int]] = {}
    for i in range(len(name) - q + 1):
        places.setdefault(name[i : i + q], []).append(i)
    return [(g, len(at), at[0], at[-1]) for g, at in sorted(places.items(), key=lambda x: (common.get(x[0], 0), x[0]))]


def name_grams(name: str, threshold: float, common: dict[str, int]) -> list[tuple[int, bool, str, int, int, int, int]]:
    """Index entries (step, upper, gram, times, first place, last place, left out) of one name.

    ``upper`` marks the step above the name's own. The empty name resembles no other.
    """
    length = len(name)
    if not length:
        return []
    starts, widths = length_steps(threshold)
    own = bisect_right(starts, length) - 1
    out, ranked, width = [], [], 0
    for step, upper in ((own, False), (own + 1, True)):
        q = widths[step]
        if upper:
            low, high = length + starts[step], length + longest_partner(length, threshold)
            if low > high:
                continue
        else:
            low, high = length + shortest_partner(length, threshold), length + starts[step + 1] - 1
        if q != width:
            ranked, width = _ranked(name, q, common), q
        spare, left, kept = _least_shared(low, high, q, threshold) // 2, 0, len(ranked)
        while kept and left + ranked[kept - 1][1] <= spare:
            kept -= 1
            left += ranked[kept][1]
        out += [(step, upper, *g, left) for g in ranked[:kept]]
    return out
