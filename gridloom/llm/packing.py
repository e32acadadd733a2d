"""Best-fit packing of tokenized documents by a grouping genetic algorithm.

A document is its token ids and an end id. Documents longer than a sequence are
cut into full sequences, with the shorter remainder first, so that every item
to pack is one length from 1 to ``CAPACITY``. How many items there are of each
length is a table of at most ``CAPACITY`` rows, whatever the corpus holds, and a
packing is a list of patterns (lengths that share a sequence) with the number of
sequences that follow each; that is what the algorithm evolves. A crossover
injects whole well-filled patterns of one parent, takes from the other what
still has items left, and best-fits the displaced lengths. Islands evolve in
separate tasks and pass their elite on between rounds.

The winning plan is applied to all items by a join: the n-th item of a length
takes the n-th place for that length. Places come from counts per task and
length, so no item moves before it is placed and one length may hold any share
of the rows.

Null or empty texts are one end id. Repeated rows are items of their own and
keep their ``doc_id``, null included. An empty table gives no rows; extra
columns are ignored. Equal lengths are placed in the order in which they were
stored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.tokens import default_path, encode
from gridloom.session import materialize

CAPACITY, END = 1024, 2
ISLANDS, POPULATION = 4, 6
#: An island ends its turn after PATIENCE generations, and the islands end after REST rounds, that together save less than
#: a share of LEAST of the sequences (but one at least).
PATIENCE, REST, LEAST = 150, 2, 1e-6
Plan = list[tuple[tuple[int, ...], int]]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        nth: Counter[int] = Counter()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py(), path), END], "<u4")
                start, piece = 0, 0
                while start < len(ids):
                    n = (len(ids) - start) % capacity or capacity
                    out.append((piece, start, n, zlib.crc32(ids[start : start + n].tobytes()), task, nth[n]))
                    row.append(i)
                    nth[n] += 1
                    start, piece = start + n, piece + 1
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names
            )

    return run


def best_fit(left: np.ndarray, capacity: int, rng: np.random.Generator | None = None) -> Plan:
    """Patterns for all items of ``left`` (count per length), largest first.

    The room beside the largest length is filled by the pair of lengths, or the
    one, that leaves least; ``rng`` sometimes takes another first filler.
    """
    left, plan = left.copy(), []
    sizes = np.flatnonzero(left)
    while len(sizes):
        used = [int(sizes[-1])]
        room = capacity - used[0]
        while room >= sizes[0]:
            spare = sizes[sizes <= room]
            spare = spare[left[spare] > np.bincount(used, minlength=capacity + 1)[spare]]
            if not len(spare):
                break
            rest = room - spare
            at = np.searchsorted(spare, rest, "right") - 1
            second = np.where(at >= 0, spare[np.maximum(at, 0)], 0)
            # a length can't be its own partner if only one is left
            second = np.where((second == spare) & (left[spare] - np.bincount(used, minlength=capacity + 1)[spare] < 2), 0, second)
            pick = len(spare) - 1 - int(np.argmax((spare + second)[::-1]))
            if rng is not None and rng.random() < 0.1:
                pick = int(rng.integers(len(spare)))
            used.append(int(spare[pick]))
            room -= used[-1]
        need = Counter(used)
        times = min(int(left[s]) // n for s, n in need.items())
        plan.append((tuple(sorted(used, reverse=True)), times))
        for s, n in need.items():
            left[s] -= times * n
        sizes = sizes[left[sizes] > 0]
    return plan


def bins(plan: Plan) -> int:
    return sum(times for _, times in plan)


def bound(counts: np.ndarray, capacity: int) -> int:
    """No packing needs fewer: by volume, and by lengths of which no two fit together, for every small cut."""
    lengths = np.arange(len(counts))
    best = math.ceil(int((counts * lengths).sum()) / capacity)
    for cut in range(0, capacity // 2 + 1):
        alone = int(counts[lengths > capacity - cut].sum())
        half = (lengths <= capacity - cut) & (lengths > capacity / 2)
        small = (lengths <= capacity / 2) & (lengths >= cut)
        free = int(counts[half].sum()) * capacity - int((counts * lengths)[half].sum())
        more = max(0, math.ceil((int((counts * lengths)[small].sum()) - free) / capacity))
        best = max(best, alone + int(counts[half].sum()) + more)
    return best


def fitness(plan: Plan) -> tuple[int, int]:
    """Fewer sequences first; of equally many, those filled most unevenly, as they leave the most usable room."""
    return bins(plan), -sum(times * sum(pattern) ** 2 for pattern, times in plan)


def crossover(one: Plan, two: Plan, counts: np.ndarray, capacity: int, rng: np.random.Generator) -> Plan:
    """Well-filled patterns of ``two`` go in whole; duplicates in ``one`` go out and displaced lengths are best-fitted."""
    left, child = counts.copy(), []

    def take(pattern: tuple[int, ...], times: int) -> None:
        need = Counter(pattern)
        times = min([times, *(int(left[s]) // n for s, n in need.items())])
        if times > 0:
            child.append((pattern, times))
            for s, n in need.items():
                left[s] -= times * n

    full = [p for p in two if sum(p[0]) >= capacity - 2]
    for i in rng.permutation(len(full))[: int(len(full) * rng.choice([0.1, 0.25, 0.5])) + 1]:
        take(*full[i])
    least, lost = capacity - int(rng.integers(1, 40)), rng.choice([0, 0.02, 0.1])
    for pattern, times in sorted(one, key=lambda p: -sum(p[0])):
        if sum(pattern) >= least and rng.random() >= lost:
            take(pattern, times)
    child += best_fit(left, capacity, rng)
    return child


def _enough(n: int) -> int:
    """Sequences that a gain on ``n`` must save to count as one."""
    return max(1, math.ceil(n * LEAST))


def evolve(counts: np.ndarray, capacity: int, elite: list[Plan], seed: int, patience: int = PATIENCE) -> Plan:
    """The best plan of one island: at the bound, or without a gain for ``patience`` generations."""
    rng = np.random.default_rng(seed)
    least = bound(counts, capacity)
    people = [*elite, best_fit(counts, capacity)]
    people += [best_fit(counts, capacity, rng) for _ in range(POPULATION - len(people))]
    people.sort(key=fitness)
    mark, idle = math.inf, 0
    while True:
        now = bins(people[0])
        if now <= mark - _enough(now):
            mark, idle = now, 0
        if now <= least or idle == patience:
            return people[0]
        idle += 1
        one, two = rng.choice(min(4, len(people)), 2, replace=False)
        child = crossover(people[one], people[two], counts, capacity, rng)
        known = [fitness(p) for p in people]
        if fitness(child) < known[-1] and fitness(child) not in known:
            people = sorted([*people[:-1], child], key=fitness)


def plan_packing(spark: SparkSession, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Islands evolve plans for the counts per length; elites migrate round the ring between rounds."""
    if not counts.any():
        return []
    elite: list[Plan] = [[] for _ in range(ISLANDS)]
    least, mark, idle, step = bound(counts, capacity), math.inf, 0, 0
    while idle < REST:
        known = [e for e in elite if e]

        def island(frames: Iterator[pd.DataFrame], elite=elite, known=known, step=step) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for i in frame["id"]:
                    guests = [elite[i], elite[(i - 1) % ISLANDS]] if known else []
                    best = evolve(counts, capacity, guests, 1000 * step + int(i))
                    yield pd.DataFrame([{"island": int(i), "pattern": list(p), "times": t} for p, t in best])

        grown = spark.range(ISLANDS).repartition(ISLANDS, "id").mapInPandas(island, "island long, pattern array<int>, times long")
        elite = [[] for _ in range(ISLANDS)]
        for r in grown.collect():  # some thousand patterns at most, as there are only so many lengths
            elite[r["island"]].append((tuple(r["pattern"]), r["times"]))
        now, step = min(map(bins, elite)), step + 1
        idle = 0 if now <= mark - _enough(now) else idle + 1
        mark = min(mark, now)
        if now <= least:
            break
    return min(elite, key=fitness)


def places(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, from, upto, sequence, offset): items from <= n < upto of a length take that offset in following sequences."""
    taken: Counter[int] = Counter()
    out, first = [], 0
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            out.append((size, taken[size], taken[size] + times, first, offset))
            taken[size] += times
            offset += size
        first += times
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(
        _pieces(path or default_path(), capacity),
        f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, task long, nth long",
    )
    cut = materialize(cut, "pieces")
    share = materialize(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "share")
    counts = np.zeros(capacity + 1, np.int64)
    for r in share.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    plan = plan_packing(spark, counts, capacity)
    table = spark.createDataFrame(places(plan), "length long, low long, high long, first long, offset long")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    share = materialize(share.select("task", "length", before.alias("before")), "before")
    rank = F.col("nth") + F.col("before")
    found = cut.join(share, ["task", "length"]).withColumn("rank", rank)
    # bounded by the number of lengths, not by the corpus
    placed = found.join(F.broadcast(table), (found["length"] == table["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        "doc_id", "piece", "start", found["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"
    )
