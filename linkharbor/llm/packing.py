"""Filling fixed-capacity containers with items, sizes in tokens.

Planning needs only how many items there are of each length.  For one capacity C that histogram has at most C
rows whatever the number of items, so the plan is made on the driver from at most C integers and consists of
patterns: "fill m containers with lengths (a, b, ...)".  From long to short, a length looks up by exact
complement whether one, two or three available lengths fill its gap to the last token; each hit is taken as
often as the availability counts allow.  What has no exact complement goes by best fit: the longest available
length that fits, then the same search for the smaller gap.

Items then find their container by rank: the k-th item of a length belongs to the k-th place that the plan
gives that length.  Ranks come from running counts inside each partition plus partition offsets, so no length
is ever gathered, even if a third of all items share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize
from .tokens import VOCABULARY, encoder
from .tokens import count as count_tokens


@dataclass(frozen=True)
class Pattern:
    """``times`` containers, each holding these lengths."""

    times: int
    lengths: tuple[int, ...]


class _Counts:
    """Availability of lengths 1..capacity."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for k, v in counts.items():
            if v:
                self.n[k] = v
        self.dead: list[set[int]] = [set(), set(), set()]  # gaps for which 1, 2, 3 lengths were found not to exist

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.n[x] -= times

    def uses(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        return min(int(self.n[x]) // lengths.count(x) for x in lengths)

    def pair(self, gap: int, below: int | None = None) -> tuple[int, int] | None:
        """Two available lengths with sum ``gap``, the longer one as long as possible (at most ``below``)."""
        lo, hi = (gap + 1) // 2, min(gap - 1, below if below is not None else gap)
        if hi < lo:
            return None
        a = np.arange(hi, lo - 1, -1)
        ok = (self.n[a] > 0) & (self.n[gap - a] > 0)
        if gap % 2 == 0 and a[-1] * 2 == gap:
            ok[-1] = self.n[gap // 2] > 1
        at = int(ok.argmax())
        return (int(a[at]), int(gap - a[at])) if ok[at] else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths with sum ``gap``.

        Availability only shrinks, so a gap that was missed once is not searched again.  (A length hidden while
        its own complement was looked for could have filled it; that costs a little room, never an item.)
        """
        if gap not in self.dead[0]:
            if self.n[gap] > 0:
                return (gap,)
            self.dead[0].add(gap)
        if gap not in self.dead[1]:
            two = self.pair(gap)
            if two:
                return two
            self.dead[1].add(gap)
        if gap not in self.dead[2]:
            for a in np.flatnonzero(self.n[: gap - 1])[::-1]:
                a = int(a)
                if a * 3 < gap:
                    break
                self.n[a] -= 1
                two = self.pair(gap - a, a)
                self.n[a] += 1
                if two:
                    return (a, *two)
            self.dead[2].add(gap)
        return None

    def largest(self, most: int) -> int:
        at = np.flatnonzero(self.n[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that place every item once.  Deterministic; its work depends on the number of lengths only."""
    c, out = _Counts(counts, capacity), []
    for longest in range(capacity, 0, -1):
        while c.n[longest] > 0:
            held: tuple[int, ...] = (longest,)
            times = int(c.n[longest])
            gap = capacity - longest
            while gap > 0:
                c.take(held, 1)  # hidden while their complement is looked for
                more = c.exact(gap)
                step = more or ((f,) if (f := c.largest(gap)) else None)
                c.take(held, -1)
                if step is None:
                    break
                held, gap = held + step, gap - sum(step)
                if more:
                    break
            times = c.uses(held)
            c.take(held, times)
            out.append(Pattern(times, held))
    return out


#: Ranks are below 2^40, lengths at most MOST_ROOM.
_SHIFT = 40
#: The sum of all capacities is at most so many tokens: as many rows at most reach the driver as histograms.
MOST_ROOM = 1 << 20


@dataclass(frozen=True)
class _Places:
    """Where the k-th item of each length goes: runs of ranks in one array, sorted by length and first rank."""

    keys: np.ndarray  # length << _SHIFT | first rank of the run
    first: np.ndarray  # container of that rank
    place: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(patterns: list[Pattern]) -> tuple[_Places, int]:
        used: dict[int, int] = {}
        rows: list[tuple[int, int, int, int]] = []
        first = 0
        for p in patterns:
            offset = 0
            for place, x in enumerate(p.lengths, 1):
                rows.append((x << _SHIFT | used.get(x, 0), first, place, offset))
                used[x] = used.get(x, 0) + p.times
                offset += x
            first += p.times
        a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        return _Places(a[:, 0], a[:, 1], a[:, 2], a[:, 3]), first

    def at(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Containers, places and offsets of items."""
        asked = length.astype(np.int64) << _SHIFT | rank
        k = np.searchsorted(self.keys, asked, side="right") - 1
        return self.first[k] + asked - self.keys[k], self.place[k], self.offset[k]


_ITEMS = "doc_id long, n_tokens long, spec_id int, piece int, n_pieces int, length int, pid int, nth long"


def items(df: DataFrame, capacities: dict[int, int], path: str = VOCABULARY) -> DataFrame:
    """One row per text, capacity and piece: a text longer than a capacity gives full pieces and a rest.

    Texts without tokens (NULL, empty) have one piece of length 0.  ``nth`` counts a length inside the
    partition ``pid``.  Written once, so that the ranks stay those of one run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        encoder(path)
        seen: dict[tuple[int, int], int] = {}
        for pdf in batches:
            n = np.fromiter((count_tokens(t, path) for t in pdf["text"]), dtype=np.int64, count=len(pdf))
            for spec, cap in capacities.items():
                full, rest = n // cap, n % cap
                k = full + ((rest > 0) | (n == 0))
                at, begin = np.repeat(np.arange(len(n)), k), np.cumsum(k) - k
                for lo in range(0, len(at), 100_000):  # a huge text is not one huge batch
                    a = at[lo : lo + 100_000]
                    piece = np.arange(lo, lo + len(a)) - begin[a]
                    length = np.where(piece < full[a], cap, rest[a])
                    s = pd.Series(length)
                    nth = s.groupby(s).cumcount().to_numpy() + s.map(lambda x, sp=spec: seen.get((sp, x), 0)).to_numpy(dtype=np.int64)
                    for x, c in s.value_counts().items():
                        seen[spec, x] = seen.get((spec, x), 0) + int(c)
                    yield pd.DataFrame(
                        {"doc_id": pdf["doc_id"].to_numpy()[a], "n_tokens": n[a], "spec_id": spec, "piece": piece + 1, "n_pieces": k[a], "length": length, "pid": pid, "nth": nth}
                    )

    return materialize(df.select("doc_id", "text").mapInPandas(run, _ITEMS))


_PLACED = "spec_id int, doc_id long, piece int, n_pieces int, n_tokens int, container_id long, place int, start_at int"


def pack(df: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(spec_id, doc_id, piece, n_pieces, n_tokens, container_id, place, start_at): the container of every piece.

    Containers are numbered from 1 per capacity; places from 1; ``start_at`` is the first token's offset.  Texts
    without tokens (NULL, empty) have container NULL and place 0; repeated documents are packed as often as they
    occur; a NULL doc_id is kept; further columns do no harm; no texts or no capacities give no rows.  ``specs`` holds (spec_id, capacity_tokens), whose
    sum is at most MOST_ROOM, which bounds the histograms the driver gets.
    """
    got = specs.filter("capacity_tokens > 0 and spec_id is not null").select("spec_id", "capacity_tokens").distinct().limit(MOST_ROOM + 1).collect()
    capacities = {r.spec_id: r.capacity_tokens for r in got}
    if len(capacities) < len(got) or sum(r.capacity_tokens for r in got) > MOST_ROOM:
        raise ValueError(f"capacities must be one per spec_id and sum up to at most {MOST_ROOM} tokens")
    it = items(df, capacities, path)
    per_part = it.filter("length > 0").groupBy("spec_id", "length", "pid").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("spec_id", "length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("spec_id", "length", "pid", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    hist = per_part.groupBy("spec_id", "length").agg(F.sum("n").alias("n")).toPandas()  # at most C rows per capacity
    places = {}
    for spec, cap in capacities.items():
        mine = hist[hist["spec_id"] == spec]
        places[spec] = _Places.of(plan(dict(zip(mine["length"].tolist(), mine["n"].tolist())), cap))[0]
    shared = df.sparkSession.sparkContext.broadcast(places)  # a few integers per pattern, as bounded as the histograms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank = (pdf["nth"] + pdf["before"].fillna(0)).to_numpy(dtype=np.int64)
            spec, length = pdf["spec_id"].to_numpy(), pdf["length"].to_numpy(dtype=np.int64)
            box, place, start = np.full(len(pdf), -1, dtype=np.int64), np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for s, where in shared.value.items():
                k = np.flatnonzero((spec == s) & (length > 0))
                if len(k):
                    box[k], place[k], start[k] = where.at(length[k], rank[k])
            out = pdf[["spec_id", "doc_id", "piece", "n_pieces"]].copy()
            out["n_tokens"] = pdf["length"]
            out["container_id"] = pd.Series(box + 1).astype("Int64").mask(box < 0).to_numpy()
            out["place"], out["start_at"] = place, start
            yield out

    return it.join(offsets, ["spec_id", "length", "pid"], "left").mapInPandas(run, _PLACED)


def containers(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container_id, n_items, used_tokens, unused_tokens), one row per container."""
    used = placed.filter("container_id is not null").groupBy("spec_id", "container_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return used.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select(
        "spec_id", "container_id", "n_items", "used_tokens", (F.col("capacity_tokens") - F.col("used_tokens")).alias("unused_tokens")
    )


def summary(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per capacity: containers, items, and the share of room left unused."""
    c = containers(placed, specs)
    return c.groupBy("spec_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used_tokens").alias("used_tokens"),
        (F.sum("unused_tokens") / (F.sum("used_tokens") + F.sum("unused_tokens"))).alias("unused_share"),
    )
