"""Filling containers of fixed capacity by linear grouping (problem 8).

Rows are dealt by a hash of their key and their rank among equal rows to shards of bounded size, which are packed
independently (at most one badly filled container a shard is lost by that). In a shard, items above `LARGE` of the
capacity are sorted and cut into groups of equal cardinality; every length is rounded up to the largest of its group,
which leaves a few sizes. Column generation finds the configurations of these sizes with the best fractional solution;
each is used as often as the whole part of its multiplicity. Actual items replace the rounded ones: a place takes the
largest item left that is no longer than the group's bound, the last place of a container the largest that fits, so
that what the rounding left over is used. Small items, and the few large ones that the whole parts leave, are put,
largest first, where they fit best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 20_000
#: Most groups of large items, and the least items of a group: their product bounds what the whole parts leave.
GROUPS, GROUP_ITEMS = 256, 16
#: Items above this share of the capacity are planned; at most three of them fit a container.
LARGE = 1 / 4


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 5000) -> list[tuple[np.ndarray, float]]:
    """Patterns (how many of each size) with their fractional multiplicities, by Gilmore-Gomory column generation.

    `sizes` fall and are above a quarter of the capacity, so a pattern has at most three items: the best one for given
    prices is found among all pairs, each with the dearest size that still fits.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    x = demand * np.diag(inverse)
    first, second = np.triu_indices(k)
    room = capacity - sizes[first] - sizes[second]
    first, second, room = first[room >= 0], second[room >= 0], room[room >= 0]
    fitting = np.searchsorted(sizes[::-1], room, side="right")  # so many of the smallest sizes fit as a third
    for nth in range(rounds):
        price = inverse.sum(axis=0)
        rising = price[::-1]
        best = np.maximum.accumulate(np.concatenate([[0.0], rising]))
        value = price[first] + price[second] + best[fitting]
        column, top, single = np.zeros(k), int(value.argmax()) if len(value) else -1, int(price.argmax())
        if top >= 0 and value[top] >= price[single]:
            gain = value[top]
            column[first[top]] += 1
            column[second[top]] += 1
            if best[fitting[top]] > 0:
                column[k - 1 - int(rising[: fitting[top]].argmax())] += 1
        else:
            gain = price[single]
            column[single] = 1
        if gain <= 1 + 1e-7:
            break
        used = np.flatnonzero(column)
        step = (inverse[:, used] * column[used]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        entering = ratio[out]
        x = x - entering * step
        x[out] = entering
        basis[:, out] = column
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        if nth % 200 == 199:  # rounding errors of the updates do not add up
            inverse = np.linalg.inv(basis)
            x = inverse @ demand
        x = np.maximum(x, 0)
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(k) if x[j] > 1e-9]


def grouped(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded sizes, falling, and how many items each stands for, of falling lengths: groups of equal cardinality."""
    values, counts = np.unique(lengths, return_counts=True)
    if len(values) <= GROUPS and counts.mean() >= GROUP_ITEMS:
        return values[::-1], counts[::-1].astype(float)
    groups = max(1, min(GROUPS, len(lengths) // GROUP_ITEMS))
    starts = np.unique(np.linspace(0, len(lengths), groups + 1).astype(np.int64)[:-1])
    sizes, of = np.unique(-lengths[starts], return_inverse=True)
    return -sizes, np.bincount(of, weights=np.diff(np.append(starts, len(lengths))))


def planned(lengths: np.ndarray, big: np.ndarray, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """Containers of large items by the best configurations, and the large items that they leave.

    `big` are positions in `lengths`, by falling length. Items beside which no other large one fits need no plan.
    """
    alone = lengths[big] + lengths[big[-1]] > capacity
    made = [[i] for i in big[alone].tolist()]
    big = big[~alone]
    if not len(big):
        return made, big
    sizes, demand = grouped(lengths[big])
    stacks: dict[int, list[int]] = {}
    mask = 0
    for i in big[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
        mask |= 1 << int(lengths[i])
    for pattern, times in sorted(configurations(sizes, demand, capacity), key=lambda p: (-p[1], tuple(-p[0]))):
        places = np.repeat(sizes, pattern).tolist()
        for _ in range(int(times + 1e-9)):
            room, container = capacity, []
            for nth, size in enumerate(places, 1):
                below = mask & ((1 << ((room if nth == len(places) else size) + 1)) - 1)
                if not below:
                    break
                length = below.bit_length() - 1
                container.append(stacks[length].pop())
                if not stacks[length]:
                    mask &= ~(1 << length)
                room -= length
            if container:
                made.append(container)
    left = np.array([i for s in stacks.values() for i in s], np.int64)
    return made, left


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A container number for each length (1..capacity)."""
    place = np.full(len(lengths), -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    big = order[lengths[order] > LARGE * capacity]
    containers = planned(lengths, big, capacity)[0] if len(big) else []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for c, items in enumerate(containers):
        place[items] = c
        r = capacity - int(lengths[items].sum())
        by_room.setdefault(r, []).append(c)
        mask |= 1 << r
    used = len(containers)
    for i in order[place[order] < 0].tolist():
        size = int(lengths[i])
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            c = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, c, used = capacity, used, used + 1
        place[i] = c
        by_room.setdefault(r - size, []).append(c)
        mask |= 1 << (r - size)
    return place


def fill(lengths: DataFrame, windows: list[tuple[int, int]], key: str = "doc_id", size: str = "n_tokens", shard_rows: int = SHARD_ROWS, rows: int | None = None) -> DataFrame:
    """Assign every row of `lengths` to containers, for each (window_id, capacity) of `windows` (a fixed, short list).

    Gives window_id, capacity, key, piece, start_token, n_tokens, container_id. A row longer than the capacity becomes
    full pieces, each filling a container, and one rest that is packed like any item; no other row is split. Rows of
    length 0 or null take no space and go to their shard's first container. Repeated rows are packed each on their
    own: they are counted first and told apart by rank, so the result depends on the rows alone, not on where they lie.
    An empty table gives an empty table. `rows`, if known, saves counting them. container_id is unique in a window, not across windows.
    """
    rows = lengths.count() if rows is None else rows
    shards = max(1, -(-rows // shard_rows))
    kind = lengths.schema[key].dataType.simpleString()
    windows = [(int(w), int(c)) for w, c in windows if c and c > 0]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = np.int64(pdf["shard"].iloc[0]) << np.int64(32)
        pdf = pdf.sort_values([size, key], kind="stable")
        n = pdf[size].fillna(0).to_numpy(np.int64)
        keys = pdf[key].to_numpy()
        made = []
        for window, capacity in windows:
            full = np.maximum(n - 1, 0) // capacity
            rest = n - full * capacity
            items = np.flatnonzero(rest > 0)
            place = np.zeros(len(n), np.int64)
            place[items] = pack(rest[items], capacity)
            used = int(place.max(initial=-1)) + 1
            of_full = np.repeat(np.arange(len(n)), full)
            piece = np.arange(len(of_full)) - np.repeat(np.cumsum(full) - full, full)
            who = np.concatenate([of_full, np.arange(len(n))])
            nth = np.concatenate([piece, full])
            made.append(
                pd.DataFrame(
                    {
                        "window_id": np.int32(window),
                        "capacity_tokens": np.int32(capacity),
                        key: keys[who],
                        "piece": nth.astype(np.int32),
                        "start_token": (nth * capacity).astype(np.int64),
                        "n_tokens": np.concatenate([np.full(len(of_full), capacity), rest]).astype(np.int32),
                        "container_id": shard + np.concatenate([used + np.arange(len(of_full)), place]),
                    }
                )
            )
        return pd.concat(made) if made else pd.DataFrame()

    schema = f"window_id int, capacity_tokens int, `{key}` {kind}, piece int, start_token long, n_tokens int, container_id long"
    blocks = lengths.groupBy(key, size).agg(F.count("*").alias("_n")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.expr("(_n - 1) div 1024"))))
    ranked = blocks.withColumn("_r", F.explode(F.sequence(F.col("_b") * 1024, F.least(F.col("_n"), (F.col("_b") + 1) * 1024) - 1)))
    dealt = ranked.select(key, size, F.pmod(F.xxhash64(key, "_r"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(of, schema)


def report(containers: DataFrame) -> DataFrame:
    """Per window: items, tokens, containers used, the least number that could do, and the share of space filled."""
    per = containers.groupBy("window_id", "capacity_tokens").agg(
        F.count("*").alias("items"),
        F.sum("n_tokens").cast("long").alias("tokens"),
        F.countDistinct("container_id").alias("containers"),
    )
    return per.select(
        "*",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("filled_share"),
    )
