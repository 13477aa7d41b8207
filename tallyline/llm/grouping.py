"""A grouping genetic algorithm for bin packing of one shard: a solution's genes are whole bins."""

from __future__ import annotations

import numpy as np


def best_fit(lengths: np.ndarray, bins: np.ndarray, loose: np.ndarray, limit: int) -> np.ndarray:
    """Puts the loose items, in the given order, into the fullest bins that have room, or into new ones."""
    bins = bins.copy()
    placed = bins >= 0
    used, packed = np.unique(bins[placed], return_inverse=True)
    bins[placed] = packed
    room = limit - np.bincount(packed, weights=lengths[placed], minlength=len(used)).astype(np.int64)
    having: list[list[int]] = [[] for _ in range(limit + 1)]
    open_rooms = 0
    for number in np.flatnonzero(room).tolist():
        having[room[number]].append(number)
        open_rooms |= 1 << int(room[number])
    count = len(used)
    found = []
    for size in lengths[loose].tolist():
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            own = having[left]
            number = own.pop()
            if not own:
                open_rooms ^= 1 << left
        else:
            left, number = limit, count
            count += 1
        found.append(number)
        left -= size
        if left:
            having[left].append(number)
            open_rooms |= 1 << left
    bins[loose] = found
    return bins


def fitness(lengths: np.ndarray, bins: np.ndarray, limit: int) -> float:
    """Fewer bins first; of as many bins, the more unequally filled."""
    fill = np.bincount(bins, weights=lengths) / limit
    return float((fill**2).sum() / len(fill)) - len(fill)


def start(lengths: np.ndarray, limit: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit solutions: one of the items from large to small, the others with noise in that order."""
    empty = np.full(len(lengths), -1, dtype=np.int64)
    orders = [np.argsort(-lengths, kind="stable")]
    orders += [np.argsort(-lengths * rng.uniform(1 - 0.1 * n, 1, len(lengths)), kind="stable") for n in range(1, size)]
    return [best_fit(lengths, empty, order, limit) for order in orders]


def cross(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Injects well-filled bins of the giver whole, removes the taker's bins that hold any of their items, and best-fits
    the items displaced by that, together with those of the emptiest bins and of a few others, about from large to small."""
    fill = np.bincount(giver, weights=lengths)
    well = np.flatnonzero(fill >= np.median(fill))
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[well[rng.random(len(well)) < 0.5]] = True
    injected = chosen[giver]
    hit = np.zeros(int(taker.max()) + 1, dtype=bool)
    hit[taker[injected]] = True
    room = limit - np.bincount(taker, weights=lengths)
    hit[np.argsort(-room, kind="stable")[: max(2, len(room) // 50)]] = True
    hit |= rng.random(len(hit)) < 0.05
    child = np.where(hit[taker], -1, taker + len(fill))
    child[injected] = giver[injected]
    loose = np.flatnonzero(child < 0)
    noise = rng.choice([0.0, 0.3])
    return best_fit(lengths, child, loose[np.argsort(-lengths[loose] * rng.uniform(1 - noise, 1, len(loose)), kind="stable")], limit)


def evolve(
    lengths: np.ndarray, population: list[np.ndarray], limit: int, generations: int, rng: np.random.Generator
) -> list[np.ndarray]:
    """The population after some generations, best first. It ends early when no packing can be smaller."""
    least = -(-int(lengths.sum()) // limit)
    ranked = sorted(((fitness(lengths, own, limit), n, own) for n, own in enumerate(population)), key=lambda one: -one[0])
    for number in range(generations):
        if len(ranked) < 2 or int(ranked[0][2].max()) + 1 <= least:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = cross(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], limit, rng)
        value = fitness(lengths, child, limit)
        if value > ranked[-1][0] and value not in {one[0] for one in ranked}:
            ranked[-1] = (value, len(population) + number, child)
            ranked.sort(key=lambda one: -one[0])
    return [own for _, _, own in ranked]
