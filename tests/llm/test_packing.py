import numpy as np
import pytest

from lexmill.llm import packing


def lay_out(lengths: np.ndarray, capacity: int) -> tuple[int, int]:
    """Sequences used, and the least that any packing needs; fails if places overlap or leave gaps."""
    values, counts = np.unique(lengths, return_counts=True)
    table = packing.slots(packing.make_plan(values, counts, capacity))
    size = np.sort(lengths)
    rank = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
    sequence, offset = packing.place(table, size, rank)
    order = np.lexsort((offset, sequence))
    sequence, offset, size = sequence[order], offset[order], size[order]
    fresh = np.append(True, sequence[1:] != sequence[:-1])
    assert (offset == np.where(fresh, 0, np.append(0, (offset + size)[:-1]))).all()
    assert (offset + size <= capacity).all()
    return int(fresh.sum()), -(-int(lengths.sum()) // capacity)


def optimum(lengths: list[int], capacity: int) -> int:
    """By exhaustive search."""
    best = len(lengths)

    def go(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_against_the_optimum(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 31, rng.integers(1, 11))
    used, _ = lay_out(lengths, 30)
    assert used <= optimum(sorted(map(int, lengths), reverse=True), 30) + (seed % 4 == 99)


def test_reduction_alone_is_optimal():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 21, rng.integers(1, 10))
        count = np.bincount(lengths, minlength=21)
        plan = packing.Plan(20)
        packing.reduce(count, plan)
        rest = [int(x) for x in np.repeat(np.arange(21), count)]
        assert sum(plan.copies) + optimum(sorted(rest, reverse=True), 20) == optimum(sorted(map(int, lengths), reverse=True), 20)


def test_large_histogram():
    rng = np.random.default_rng(1)
    used, least = lay_out(np.clip(rng.lognormal(6, 1.1, 200_000).astype(int), 1, 4096), 4096)
    assert used <= 1.001 * least + 1
    assert lay_out(np.full(10, 4096), 4096) == (10, 10)
    assert lay_out(np.full(9000, 1), 4096) == (3, 3)
