"""Exact medians of large columns without a shuffle of the data.

``median`` keeps every distinct value of a group in one task, which fits a small table only. Here each rank is narrowed down: an approximate quantile sketch proposes two values around it, the next pass counts exactly
how many values lie below, on and between them, and the sketch of the values between proposes the next pair. Each
pass is one aggregation over the needed columns with a one-row result. Sketch errors cost passes, never exactness,
since only exact counts move the bounds. The last pass fetches the few values that are left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 400
SKETCH_SIZE = 1600
FETCH_ROWS = 100_000
FETCHED_AT_ONCE = 1_000_000


@dataclass
class _Rank:
    """The search for the value at one 0-based rank: it lies strictly between two bounds, or is known."""

    rank: int
    low: float | None = None  # exclusive; None is open
    high: float | None = None
    below: int = 0  # values at or under ``low``
    inside: int = 0  # values strictly between the bounds
    cuts: tuple[float, float] | None = None
    value: float | None = None

    def state(self, column_no: int) -> tuple:
        return column_no, self.low, self.high, self.cuts

    def within(self, value: Column) -> Column:
        keep = value.isNotNull()
        if self.low is not None:
            keep = keep & (value > F.lit(self.low))
        if self.high is not None:
            keep = keep & (value < F.lit(self.high))
        return keep

    def propose(self, count: int, grid: list[float] | None) -> None:
        """Choose the sketch values two grid steps to either side of the rank.

        Sketches count all numbers but leave NaN out, which sorts last, so a rank beyond the count is NaN.
        """
        offset = self.rank - self.below
        if offset >= count:
            self.value = float("nan")
            return
        place = round(offset / max(count - 1, 1) * GRID)
        self.cuts = (grid[max(place - 2, 0)], grid[min(place + 2, GRID)])

    def narrow(self, under: int, on_first: int, between: int, on_second: int) -> bool:
        """Move the bounds by the exact counts; true when the rank fell between the cuts."""
        first, second = self.cuts
        offset = self.rank - self.below
        self.cuts = None
        if offset < under:
            self.high, self.inside = first, under
        elif offset < under + on_first:
            self.value = first
        elif offset < under + on_first + between:
            self.low, self.high = first, second
            self.below, self.inside = self.below + under + on_first, between
            return True
        elif offset < under + on_first + between + on_second:
            self.value = second
        else:
            passed = under + on_first + between + on_second
            self.low, self.below, self.inside = second, self.below + passed, self.inside - passed
        return False


def _grid(value: Column, keep: Column) -> Column:
    """The count of the kept numbers and their evenly spaced quantiles."""
    sketch = F.kll_sketch_agg_double(F.when(keep, value), F.lit(SKETCH_SIZE))
    steps = F.expr("array(" + ", ".join(f"{step / GRID}D" for step in range(GRID + 1)) + ")")
    count = F.kll_sketch_get_n_double(sketch)
    quantiles = F.when(count > 0, F.kll_sketch_get_quantile_double(sketch, steps))
    return F.struct(F.coalesce(count, F.lit(0)).alias("count"), quantiles.alias("quantiles"))


def _batches(sizes: dict[tuple, int]) -> list[list[tuple]]:
    """The lists in groups of at most ``FETCHED_AT_ONCE`` values, so that many columns need more passes, not more memory."""
    groups: list[list[tuple]] = []
    held = 0
    for name, size in sizes.items():
        if not groups or held + size > FETCHED_AT_ONCE:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += size
    return groups


def exact_medians(
    df: DataFrame,
    values: dict[str, Column],
    fetch_rows: int = FETCH_ROWS,
) -> dict[str, float | None]:
    """The exact median of each double column, nulls skipped; null for a column without values."""
    if not values:
        return {}
    names = list(values)
    data = df.select(*[values[name].cast("double").alias(f"v{i}") for i, name in enumerate(names)])
    cols = [F.col(f"v{i}") for i in range(len(names))]

    start = data.agg(
        F.array(*[F.count(col) for col in cols]).alias("counts"),
        *[_grid(col, col.isNotNull()).alias(f"g{i}") for i, col in enumerate(cols)],
    ).first()
    searches: list[list[_Rank]] = []
    for i, count in enumerate(start["counts"]):
        ranks = sorted({(count - 1) // 2, count // 2}) if count else []
        searches.append([_Rank(rank, inside=count) for rank in ranks])
        for search in searches[-1]:
            search.propose(*start[f"g{i}"])

    while True:
        open_ranks = [(i, s) for i, found in enumerate(searches) for s in found if s.value is None]
        wide = [(i, s) for i, s in open_ranks if s.inside > fetch_rows]
        if not wide:
            break
        # Exact counts compile to fast code and sketches do not, so the counts are taken alone when what lies between
        # the cuts, some five grid steps at most, should be few enough to fetch.
        sketching = max(search.inside for _, search in wide) * 5 / GRID > fetch_rows
        aggregates: dict[tuple, Column] = {}  # the two middle ranks mostly share their bounds
        for i, search in wide:
            if search.state(i) in aggregates:
                continue
            col, keep = cols[i], search.within(cols[i])
            if search.cuts is None:
                aggregates[search.state(i)] = F.struct(_grid(col, keep).alias("grid"))
                continue
            first, second = map(F.lit, search.cuts)
            aggregates[search.state(i)] = F.struct(
                F.count_if(keep & (col < first)).alias("under"),
                F.count_if(keep & (col == first)).alias("on_first"),
                F.count_if(keep & (col > first) & (col < second)).alias("between"),
                F.count_if(keep & (col == second) & (first != second)).alias("on_second"),
                *([_grid(col, keep & (col > first) & (col < second)).alias("grid")] if sketching else []),
            )
        row = data.agg(*[aggregate.alias(f"a{n}") for n, aggregate in enumerate(aggregates.values())]).first()
        results = dict(zip(aggregates, row, strict=True))
        for i, search in wide:
            seen = results[search.state(i)]
            sketched = search.cuts is None or search.narrow(
                seen["under"], seen["on_first"], seen["between"], seen["on_second"]
            )
            if sketched and search.value is None and "grid" in seen:
                search.propose(*seen["grid"])

    if open_ranks:
        # Each list holds at most ``fetch_rows`` values, by the exact counts above.
        lists = {
            (i, search.low, search.high): F.sort_array(F.collect_list(F.when(search.within(cols[i]), cols[i])))
            for i, search in open_ranks
        }
        sizes = {(i, search.low, search.high): search.inside for i, search in open_ranks}
        for group in _batches(sizes):
            row = data.agg(*[lists[name].alias(f"a{n}") for n, name in enumerate(group)]).first()
            left = dict(zip(group, row, strict=True))
            for i, search in open_ranks:
                if (i, search.low, search.high) in left:
                    search.value = left[i, search.low, search.high][search.rank - search.below]

    return {
        name: (found[0].value + found[-1].value) / 2.0 if found else None
        for name, found in zip(names, searches, strict=True)
    }
