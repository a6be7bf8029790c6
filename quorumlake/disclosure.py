"""Small-cell disclosure: counts under k are held back, with those that would give them away."""

from __future__ import annotations

from collections.abc import Sequence


def suppressed_counts(n_true: int, n_false: int, n_unknown: int, k: int) -> tuple[int | None, int | None, int | None]:
    """The three counts of a cohort. Zero is shown; a count from 1 to k - 1 isn't. As the total is known, the smallest
    other one that isn't zero goes with it if it stands alone or if what is hidden comes to less than k in all."""
    counts: list[int | None] = [n_true, n_false, n_unknown]
    small = [i for i, n in enumerate(counts) if 0 < n < k]
    if len(small) == 1 or small and sum(counts[i] for i in small) < k:
        rest = [i for i in range(3) if i not in small and counts[i]]
        small += sorted(rest, key=lambda i: counts[i])[:1]
    hidden = set(small)
    if len(hidden) == 1:  # the only count that isn't zero
        hidden = {0, 1, 2}
    return tuple(None if i in hidden else n for i, n in enumerate(counts))


def merged_bins(counts: Sequence[int], k: int) -> list[tuple[int, int, int]]:
    """(first, last, count): neighbouring bins merged from the left until each is 0 or at least k. A single filled bin
    stays as it is: merging it with empty ones would hide nothing."""
    if sum(n > 0 for n in counts) <= 1:
        return [(i, i, n) for i, n in enumerate(counts)]
    out: list[list[int]] = []
    for i, n in enumerate(counts):
        if out and 0 < out[-1][2] < k:
            out[-1][1], out[-1][2] = i, out[-1][2] + n
        else:
            out.append([i, i, n])
    while len(out) > 1 and 0 < out[-1][2] < k:
        last = out.pop()
        out[-1][1], out[-1][2] = last[1], out[-1][2] + last[2]
    return [tuple(b) for b in out]


def shown_split(k_true: int, n: int, least: int) -> bool:
    """Whether a predicate's split of n units may be shown: no side from 1 to least - 1."""
    return not (0 < k_true < least or 0 < n - k_true < least)


def shown_counts(counts: Sequence[int], least: int) -> bool:
    """Whether none of the counts is from 1 to least - 1."""
    return not any(0 < n < least for n in counts)
