"""Exact values at positions of an order, for many orders at once and without ordering anything.

Each pass is one aggregation over the table, shared by all orders. For each order it counts the rows below a bracket and, inside
of the bracket, the rows of each key of a sample. The sample's keys are equi-depth cells of the bracket, and the counts say
which of them hold the wanted position, so the next pass only looks between their ends. Once few different keys
are left, all are counted instead of a sample, and the position is read off exactly. Nothing is sorted or
written. The sample decides where to look, never what is found: if a position lies outside of its bracket, the counts
show it, and the bracket is widened again.

One pass settles up to `FEW` rows, two about a million, and each further one some fifty times as many. Keys may be compound, so ties
cost no passes of their own, and a value that a third of all rows share is one key.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of one order that are counted one by one, and the most that are sampled. They size the passes.
FEW = 20_000
MOST_SAMPLED = 65_536
#: Standard deviations on either side of a position that a bracket leaves room for.
MARGIN = 3.5
SEED = 11


@dataclass(frozen=True)
class Order:
    """Rows in ascending order of `keys`, which are not null where `where` holds, and the positions asked for.

    The positions, from 1, may depend on the number of rows; `rows` is that number, if it is known.
    """

    keys: tuple[Column, ...]
    positions: Callable[[int], Iterable[int]]
    where: Column | None = None
    rows: int | None = None


@dataclass(frozen=True)
class Cut:
    """The key at a position, how many rows come before it, and how many share it."""

    key: tuple
    texts: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    before: int
    equal: int


def _literal(texts: tuple[str, ...], kinds: tuple[T.DataType, ...]) -> str:
    """A key in SQL. The text forms of its parts lose nothing."""
    quoted = ["'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'" for text in texts]
    parts = [f"'k{j}', CAST({text} AS {kind.simpleString()})" for j, (text, kind) in enumerate(zip(quoted, kinds))]
    return f"named_struct({', '.join(parts)})"


def _key(keys: Iterable[Column]) -> Column:
    return F.struct(*[k.alias(f"k{j}") for j, k in enumerate(keys)])


def _number(text: str) -> tuple[bool, float]:
    number = float(text)
    return (True, 0.0) if math.isnan(number) else (False, number)


def _parser(kind: T.DataType) -> Callable:
    """What makes of a text a value that orders in Python as the text's value does in Spark."""
    for kinds, parse in (
        ((T.DoubleType, T.FloatType), _number),
        (T.IntegralType, int),
        (T.DecimalType, Decimal),
        (T.BooleanType, "true".__eq__),
        ((T.StringType, T.DateType), str),
    ):
        if isinstance(kind, kinds):
            return parse
    raise TypeError(f"no positions in an order by {kind.simpleString()}")


def _sample_size(rows: float) -> float:
    """How many keys of a bracket are sampled: enough to narrow it well, few enough to be handed to the driver."""
    return min(MOST_SAMPLED, max(1024.0, rows ** (2 / 3)))


class _Search:
    """The bracket around some neighbouring positions of an order, and what is known about it."""

    def __init__(self, number: int, order: int, positions: list[int], kinds: tuple[T.DataType, ...], rows: int):
        self.number, self.order, self.left, self.kinds, self.rows = number, order, positions, kinds, rows
        if not 1 <= positions[0] <= positions[-1] <= rows:
            raise ValueError(f"position {positions[-1]} is not among the {rows} ordered rows")
        self.found: dict[int, Cut] = {}
        self.bracket: list[tuple[str, ...] | None] = [None, None]
        self.margin = MARGIN
        self.share = 1.0 if rows <= FEW else _sample_size(rows) / rows

    def state(self) -> str:
        """Of a row: the search's number, and null below the bracket, the key inside of it, or none if not sampled."""
        key, (low, high) = f"order{self.order}", self.bracket
        texts = f"array({', '.join(f'CAST({key}.k{j} AS STRING)' for j in range(len(self.kinds)))})"
        if self.share < 1:
            texts = f"IF(draw < {self.share!r}D, {texts}, CAST(array() AS ARRAY<STRING>))"
        if low is not None:
            texts = f"IF({key} >= {_literal(low, self.kinds)}, {texts}, NULL)"
        inside = f"{key} IS NOT NULL" if high is None else f"{key} <= {_literal(high, self.kinds)}"
        return f"IF({inside}, named_struct('search', {self.number}, 'texts', {texts}), NULL)"

    def learn(self, below: int, groups: list[tuple[tuple[str, ...], int]], unsampled: int) -> None:
        """Take the counts of one pass in: settle positions, or narrow (or widen) the bracket."""
        merged: dict[tuple, list] = {}
        parsers = [_parser(kind) for kind in self.kinds]
        columns = [[parse(texts[j]) for texts, _ in groups] for j, parse in enumerate(parsers)]
        for key, (texts, n) in zip(zip(*columns), groups):
            merged.setdefault(key, [texts, 0])[1] += n
        keys = sorted(merged)
        ends = list(accumulate(merged[k][1] for k in keys))
        sampled = ends[-1] if ends else 0
        inside = sampled + unsampled
        if not below < self.left[0] <= self.left[-1] <= below + inside or not sampled:
            self.bracket, self.margin = [None, None], 2 * self.margin
            self.share = min(1.0, self.margin * _sample_size(self.rows) / self.rows)
            return
        if not unsampled:
            for position in self.left:
                at = bisect_left(ends, position - below)
                texts, n = merged[keys[at]]
                self.found[position] = Cut(keys[at], texts, self.kinds, below + ends[at] - n, n)
            self.left = []
            return

        def at_rank(rank: float) -> int:
            return min(bisect_left(ends, rank), len(keys) - 1)

        def spread(rank: float) -> float:
            return self.margin * math.sqrt(max(rank * (1 - rank / sampled), 1.0)) + 2

        first, last = ((p - below) / inside * sampled for p in (self.left[0], self.left[-1]))
        low, high = first - spread(first), last + spread(last)
        if low >= 1:
            self.bracket[0] = merged[keys[at_rank(low)]][0]
        if high <= sampled:
            self.bracket[1] = merged[keys[at_rank(high)]][0]
        before, self.share = self.share, 1.0
        held = [merged[k][1] for k in keys[at_rank(max(low, 1)) : at_rank(min(high, sampled)) + 1]]
        # keys met once stand for those that were not met
        different = len(held) + sum(n == 1 for n in held) * inside / sampled
        rows = max(1.0, sum(held) * inside / sampled)
        if different > FEW:
            # each pass reads a larger share, so the passes come to an end whatever the keys are
            self.share = min(1.0, max(_sample_size(rows) / rows, 2 * before))


def cuts(df: DataFrame, orders: list[Order]) -> list[dict[int, Cut]]:
    """For each order the cut at each of its positions. A position that is not among the rows is an error."""
    unknown = [i for i, o in enumerate(orders) if o.rows is None]
    rows = {i: o.rows for i, o in enumerate(orders)}
    if unknown:
        counts = [F.count("*") if orders[i].where is None else F.count_if(orders[i].where) for i in unknown]
        rows |= dict(zip(unknown, df.agg(*[c.alias(f"n{i}") for i, c in zip(unknown, counts)]).head()))
    columns = []
    for i, order in enumerate(orders):
        key = _key(order.keys)
        columns.append((key if order.where is None else F.when(order.where, key)).alias(f"order{i}"))
    keyed = df.select(*columns, F.rand(SEED).alias("draw"))
    kinds = [tuple(f.dataType for f in keyed.schema[f"order{i}"].dataType) for i in range(len(orders))]
    searches: list[_Search] = []
    for i, order in enumerate(orders):
        wanted = sorted(set(order.positions(rows[i])))
        starts = [p for p in wanted if p - 1 not in wanted]
        for first, end in zip(starts, [*starts[1:], math.inf]):  # positions far apart are searched for apart
            searches.append(_Search(len(searches), i, [p for p in wanted if first <= p < end], kinds[i], rows[i]))
    while waiting := [s for s in searches if s.left]:
        states = keyed.selectExpr(f"inline(array({', '.join(s.state() for s in waiting)}))").where("search IS NOT NULL")
        counted = states.groupBy("search", "texts").agg(F.count("*").alias("n")).toArrow().to_pydict()
        below, unsampled = dict.fromkeys(range(len(searches)), 0), dict.fromkeys(range(len(searches)), 0)
        groups: dict[int, list] = {s.number: [] for s in waiting}
        for number, texts, n in zip(counted["search"], counted["texts"], counted["n"]):
            if texts is None:
                below[number] = n
            elif not texts:
                unsampled[number] = n
            else:
                groups[number].append((tuple(texts), n))
        for s in waiting:
            s.learn(below[s.number], groups[s.number], unsampled[s.number])
    found: list[dict[int, Cut]] = [{} for _ in orders]
    for s in searches:
        found[s.order] |= s.found
    return found


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians over the values that are numbers (mean of the middle two); 0.0 where there are none."""
    values = [F.col(c).cast("double") for c in columns]
    orders = [
        Order((v,), lambda n: {(n + 1) // 2, n // 2 + 1} if n else set(), v.isNotNull() & ~F.isnan(v)) for v in values
    ]
    middle = [[float(cut.texts[0]) for cut in found.values()] for found in cuts(df, orders)]
    return {c: sum(m) / len(m) if m else 0.0 for c, m in zip(columns, middle)}


@dataclass(frozen=True)
class Selection:
    """The first k rows of an order: all rows of `sure`, and `count` of the `tied` rows, which agree in all keys."""

    sure: Column
    tied: Column
    count: int
    of: int

    def total(self, value: Column) -> Column:
        """The sum of `value` over the selection, if the tied rows share one value."""
        share = F.lit(self.count) / F.lit(max(self.of, 1))
        sure = F.coalesce(F.sum(F.when(self.sure, value)), F.lit(0))
        return sure.cast("double") + F.coalesce(F.sum(F.when(self.tied, value)), F.lit(0)).cast("double") * share


@dataclass(frozen=True)
class First:
    """Asks for the first `k` of the `rows` rows where `where` holds, in ascending order of `keys`."""

    k: int
    keys: list[Column]
    rows: int
    where: Column | None = None


def select_first(df: DataFrame, asked: list[First]) -> list[Selection]:
    """The selections as predicates, which need neither a sort nor a shuffle. `where` is not part of them."""
    cut_short = [i for i, a in enumerate(asked) if 0 < a.k < a.rows]
    orders = [Order(tuple(asked[i].keys), lambda _, k=asked[i].k: {k}, asked[i].where, asked[i].rows) for i in cut_short]
    found = dict(zip(cut_short, cuts(df, orders))) if orders else {}
    chosen = []
    for i, a in enumerate(asked):
        if i not in found:
            chosen.append(Selection(F.lit(a.k > 0), F.lit(False), 0, 0))
            continue
        cut = found[i][a.k]
        key, at = _key(a.keys), F.expr(_literal(cut.texts, cut.kinds))
        left = a.k - cut.before
        all_tied = left == cut.equal
        chosen.append(Selection(key <= at, F.lit(False), 0, 0) if all_tied else Selection(key < at, key == at, left, cut.equal))
    return chosen


def first_k(df: DataFrame, asked: list[First]) -> list[Column]:
    """Predicates true for exactly the first rows asked for; the keys together tell any two rows apart."""
    found = select_first(df, asked)
    if any(s.count for s in found):
        raise ValueError("the ordering keys do not tell all rows apart")
    return [s.sure for s in found]
