"""Sizes from binomial tails. Runs on the driver; the results are literals of plans."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations_with_replacement


def log2_add(a: float, b: float) -> float:
    """log2(2**a + 2**b)."""
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log2(1 + 2 ** -abs(a - b))


def log2_choose(n: int, k: int) -> float:
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)


def log2_pmf(k: int, n: int, p: float) -> float:
    """log2 P[Binomial(n, p) = k]."""
    if not 0 <= k <= n:
        return -math.inf
    if p in (0.0, 1.0):
        return 0.0 if k == n * p else -math.inf
    return log2_choose(n, k) + k * math.log2(p) + (n - k) * math.log2(1 - p)


def log2_tail(k: int, n: int, p: float) -> float:
    """log2 P[Binomial(n, p) > k]."""
    total = -math.inf
    for i in range(k + 1, n + 1):
        term = log2_pmf(i, n, p)
        total = log2_add(total, term)
        if i > n * p and term < total - 60:
            break
    return total


def least(low: int, high: int, good: Callable[[int], bool]) -> int:
    """Least number in low..high that is good, if all after a good one are; high if none is."""
    while low < high:
        mid = (low + high) // 2
        if good(mid):
            high = mid
        else:
            low = mid + 1
    return low


def max_per_shard(batch: int, shards: int, log2_fail: float = -40) -> int:
    """Least load that a shard of evenly hashed distinct keys surpasses with less than 2**log2_fail."""
    return least(-(-batch // shards), batch, lambda n: log2_tail(n, batch, 1 / shards) < log2_fail)


def real_per_bucket(bucket: int, ways: int, log2_fail: float = -60) -> int:
    """Most rows of a bucket that may be filled so that, when as many such buckets are dealt anew `ways` ways, one
    overflows with less than 2**log2_fail."""
    return bucket - least(1, bucket - 1, lambda empty: log2_tail(bucket, (bucket - empty) * ways, 1 / ways) < log2_fail)


#: The most shards of one load, the factors that a pass may split by, and the one count whose factors
#: are not the closest ones.
MOST_SHARDS, FACTORS, OTHER_FACTORS = 64, range(2, 9), {24: [3, 8]}


def _factors(shards: int) -> list[int] | None:
    """As few factors as possible and, of as many, those closest to each other; None if there are none."""
    for n in range(1, 7):
        if found := [c for c in combinations_with_replacement(FACTORS, n) if math.prod(c) == shards]:
            return OTHER_FACTORS.get(shards) or list(min(found, key=lambda c: c[-1] - c[0]))
    return None


def shard_factors(shards: int) -> list[int]:
    """Ascending factors from 2 to 8 whose product is the count. An error for one shard, for more than 64, and for
    counts with a greater prime factor."""
    if not 2 <= shards <= MOST_SHARDS or (found := _factors(shards)) is None:
        raise ValueError(f"{shards} shards: 2 to {MOST_SHARDS} are possible, without prime factors above 7")
    return found


def suitable_shards(threads: int, empty: bool = False) -> int:
    """Shards for a number of threads: two for up to four, else half of them up to 64, and unless the table starts
    empty the next lower count that has factors."""
    if threads <= 4:
        return 2
    n = min(threads // 2, MOST_SHARDS)
    while not empty and _factors(n) is None:
        n -= 1
    return n
