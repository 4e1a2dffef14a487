"""Filling fixed-capacity containers with items (problem 9).

Items longer than a container are cut into full containers and a rest; everything else stays whole.
A grouping genetic algorithm packs the items.  An individual is a set of bins.  Crossover injects the
best-filled bins of one parent into the other and dissolves the bins with items that came twice; the
displaced items first improve bins, by taking the place of one or two smaller ones, and then go back
by best fit.  The population is split into islands that begin with differently ordered items, evolve
as separate tasks and hand their best individual on in a ring after every epoch.

A collection of any size is packed in districts of bounded size, each with its islands.  A district
that has reached the bound which no packing can beat evolves no further.  Bins that are full enough
are kept; the items of the others are pooled over all districts and packed again, round by round,
until a round saves no bin or one district is left.

Defined results: null and empty texts have no tokens and need no container, so they give no row;
items with equal sizes are told apart by id; repeated ids are separate items; an empty table gives
no row.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.session import drop, materialize

CAPACITY = 2_048
DISTRICT = 1_500
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 5, 12, 10
FULL_ENOUGH = 0.995

Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins, ordered: bool = True) -> Bins:
    """Put items, largest first or as they come, each into the fullest bin that has room."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: (-sizes[i], i)) if ordered else items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - sizes[i], k))
        else:
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Mean squared fill: few well-filled bins beat many half-filled ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def least_bins(sizes: list[int], capacity: int) -> int:
    """The bound that no packing can beat."""
    return math.ceil(sum(sizes) / capacity)


def improve(bins: Bins, free: list[int], sizes: list[int], capacity: int) -> list[int]:
    """Swap one or two free items for up to two smaller ones of a bin where that fills the bin better; returns the items then free."""
    free = sorted(free, key=lambda i: (sizes[i], i))
    totals = [sizes[i] for i in free]
    for b in sorted(bins, key=lambda b: sum(sizes[i] for i in b)):
        room = capacity - sum(sizes[i] for i in b)
        if not room:
            continue
        if not free:
            break
        own = sorted(range(len(b)), key=lambda k: sizes[b[k]])[:12]
        outs = [(), *((k,) for k in own), *((k, m) for x, k in enumerate(own) for m in own[x + 1 :])]
        best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
        for out in outs:
            gone = sum(sizes[b[k]] for k in out)
            most = room + gone
            if most - gone <= best[0]:
                continue
            at = bisect_right(totals, most) - 1
            if at >= 0 and totals[at] - gone > best[0]:
                best = (totals[at] - gone, out, (at,))
            low, high = 0, min(at, len(free) - 1)
            while low < high:
                both = totals[low] + totals[high]
                if both > most:
                    high -= 1
                else:
                    if both - gone > best[0]:
                        best = (both - gone, out, (low, high))
                    low += 1
            if best[0] == room:
                break
        gain, out, came = best
        if gain:
            moved = [b[k] for k in out]
            taken = [free[k] for k in came]
            for k in sorted(out, reverse=True):
                b.pop(k)
            b += taken
            for k in sorted(came, reverse=True):
                free.pop(k)
                totals.pop(k)
            for i in moved:
                at = bisect_right(totals, sizes[i])
                totals.insert(at, sizes[i])
                free.insert(at, i)
    return free


def crossover(one: Bins, two: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``one`` into ``two``."""
    fill = sorted(one, key=lambda b: (-sum(sizes[i] for i in b), rng.random()))
    injected = [list(b) for b in fill[: max(1, int(len(fill) * rng.uniform(0.2, 0.6)))]]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in two:
        if taken.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    bins = injected + kept
    return best_fit(improve(bins, displaced, sizes, capacity), sizes, capacity, bins)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and some at random, and put their items back."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    gone = set(order[: max(1, len(bins) // 20)]) | set(rng.sample(range(len(bins)), min(len(bins), max(2, len(bins) // 15))))
    items = [i for k in gone for i in bins[k]]
    kept = [list(b) for k, b in enumerate(bins) if k not in gone]
    return best_fit(improve(kept, items, sizes, capacity), sizes, capacity, kept)


def evolve(sizes: list[int], capacity: int, seed: int, start: Bins | None, generations: int = GENERATIONS, population: int = POPULATION) -> Bins:
    """The best individual of one island after some generations; it stops early at the bound no packing can beat."""
    rng = random.Random(seed)
    least = least_bins(sizes, capacity)
    items = list(range(len(sizes)))
    everyone = [start] if start else [best_fit(items, sizes, capacity, [])]
    if len(everyone[0]) > least:
        largest = max(sizes)
        while len(everyone) < population:
            # between falling order and no order at all, by how far an item may be moved
            blur = rng.uniform(0.02, 1.0) * largest
            order = sorted(items, key=lambda i: -sizes[i] + rng.uniform(-blur, blur))
            everyone.append(best_fit(order, sizes, capacity, [], ordered=False))
        for _ in range(generations):
            everyone.sort(key=lambda b: (len(b), -fitness(b, sizes, capacity)))
            if len(everyone[0]) <= least:
                break
            parents = everyone[: max(2, population // 2)]
            children = [crossover(*rng.sample(parents, 2), sizes, capacity, rng) for _ in range(population - len(parents) - 2)]
            everyone = [*parents, *children, mutate(parents[0], sizes, capacity, rng), mutate(rng.choice(parents), sizes, capacity, rng)]
    return min(everyone, key=lambda b: (len(b), -fitness(b, sizes, capacity)))


def _island(capacity: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        district, island = key
        rows = rows.sort_values(["item", "piece"], kind="stable").reset_index(drop=True)
        sizes = rows["size"].astype(int).tolist()
        start: Bins | None = None
        if rows["bin"].notna().all():
            start = [list(map(int, g)) for g in rows.groupby("bin").indices.values()]
        bins = evolve(sizes, capacity, (int(district) * 1_000_003 + int(island) * 1_009 + epoch) & 0x7FFFFFFF, start)
        number = [0] * len(sizes)
        for k, b in enumerate(bins):
            for i in b:
                number[i] = k
        return rows.assign(bin=number, bins=len(bins), quality=fitness(bins, sizes, capacity))

    return run


_ROW = "district long, island int, item long, piece int, size long, bin double, bins int, quality double"


def _round(items: DataFrame, districts: int, capacity: int) -> DataFrame:
    """Pack items (``item``, ``piece``, ``size``) in districts; (district, item, piece, size, bin)."""
    # by hash, every district gets the same mix of sizes
    spread = F.pmod(F.xxhash64("item", "piece"), F.lit(districts))
    rows = items.select(spread.alias("district"), F.lit(0).alias("island"), "item", "piece", "size", F.lit(None).cast("double").alias("bin"))
    done: DataFrame | None = None
    for epoch in range(EPOCHS):
        rows = rows.select("district", "island", "item", "piece", "size", "bin").groupBy("district", "island").applyInPandas(_island(capacity, epoch), _ROW)
        rows = materialize(rows, "islands")
        best = rows.groupBy("district").agg(F.min_by(F.struct("island", "bins"), F.struct("bins", -F.col("quality"), "island")).alias("b"))
        least = rows.filter("island = 0" if epoch == 0 else "true").groupBy("district", "island").agg(F.sum("size").alias("total"), F.max("bins").alias("bins"))
        least = least.groupBy("district").agg((F.min("bins") <= F.ceil(F.max("total") / F.lit(capacity))).alias("least"))
        best = best.join(least, "district").select("district", F.col("b.island").alias("island"), "least")
        last = epoch == EPOCHS - 1
        best = materialize(best.withColumn("ready", F.col("least") | F.lit(last)), "best")
        ready = rows.join(best.filter("ready"), ["district", "island"]).select("district", "item", "piece", "size", F.col("bin").cast("long").alias("bin"))
        done = ready if done is None else done.unionByName(ready)
        if last or best.filter("not ready").isEmpty():
            break
        # the other districts go on, with all their islands, and each elite moves to the next island
        going = rows.join(best.filter("not ready").select("district"), "district", "left_semi")
        if epoch == 0:
            rows = going.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("bin", F.when(F.col("island") == 0, F.col("bin")))
        else:
            rows = going.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int"))
    return done


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(item, piece, size, container) of rows (``item``, ``size``): where every piece lies."""
    rows = items.filter(F.col("size") > 0).select(F.col("item").cast("long").alias("item"), F.col("size").cast("long").alias("size"))
    full, rest = F.floor(F.col("size") / capacity).cast("int"), F.pmod("size", F.lit(capacity))
    wholes = F.array_repeat(F.lit(capacity).cast("long"), full)
    cut = rows.select("item", F.explode(F.when(rest > 0, F.concat(wholes, F.array(rest))).otherwise(wholes)).alias("size"))
    # pieces are numbered within their item, and repeated ids stay apart so
    numbered = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("size"))) - 1
    pieces = materialize(cut.withColumn("piece", numbered.cast("int")), "pieces")
    done = [pieces.filter(F.col("size") == capacity).select("item", "piece", "size", F.concat_ws("-", F.lit("f"), "item", "piece").alias("container"))]
    left = pieces.filter(F.col("size") < capacity).select("item", "piece", "size")
    n, number = left.count(), 0
    while n:
        districts = max(1, n // DISTRICT)
        packed = materialize(_round(left, districts, capacity), "packed")
        name = F.concat_ws("-", F.lit(f"r{number}"), "district", "bin").alias("container")
        fill = packed.groupBy("district", "bin").agg(F.sum("size").alias("fill"))
        last = districts == 1
        good = fill.filter(F.lit(last) | (F.col("fill") >= int(FULL_ENOUGH * capacity))).select("district", "bin")
        done.append(packed.join(good, ["district", "bin"]).select("item", "piece", "size", name))
        if last:
            break
        former, left = left, materialize(packed.join(good, ["district", "bin"], "left_anti").select("item", "piece", "size"), "left")
        if number:
            drop(former)
        m = left.count()
        if m > 0.9 * n:
            # more rounds in districts gain nothing: keep this packing of what is left
            done.append(packed.join(good, ["district", "bin"], "left_anti").select("item", "piece", "size", name))
            break
        n, number = m, number + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
