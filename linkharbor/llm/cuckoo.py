"""Has this key been seen before?  Partitioned cuckoo tables of short fingerprints.

A key's 64-bit hash chooses a partition; inside it, a 16-bit fingerprint may sit in one of two buckets of four
slots (the second bucket is the first XOR a hash of the fingerprint), so a table holds two bytes per slot and
no key.  A fingerprint can be removed again.  When a table is saturated a further one of twice its size is
added, which keeps what the old one holds.  A table never forgets an inserted key, so "new" is certain, while
"seen" may be wrong for about 8 in 65536 new keys and table; the audit finds exactly which.

The distributed operator keeps keys out of memory and out of the shuffle: a key leaves its row as 128 bits, is reduced to
one row per block of records before the shuffle, a partition's rows stream through its tables in order of arrival, and
only fingerprints stay.  The audit sorts a partition's answers where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms

SLOTS = 4
MAX_LOAD = 0.94
ROUNDS = 400


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class CuckooTable:
    """One table of ``buckets`` (a power of two) times four 16-bit slots; 0 marks a free slot."""

    def __init__(self, buckets: int, seed: int = 7) -> None:
        self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)
        self.size = 0
        self.random = np.random.default_rng(seed)

    @property
    def buckets(self) -> int:
        return len(self.slots)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of 64-bit hashes."""
        m = _mix(h)
        fp = (m & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        b1 = ((m >> np.uint64(16)) & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp, b1, self.other(b1, fp)

    def other(self, b: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return b ^ (_mix(fp) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, b1, b2 = self.places(h)
        return (self.slots[b1] == fp[:, None]).any(1) | (self.slots[b2] == fp[:, None]).any(1)

    def full(self, more: int = 0) -> bool:
        return self.size + more > MAX_LOAD * self.slots.size

    def _settle(self, fp: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Put each fingerprint into a free slot of its bucket; True where it found one."""
        done = np.zeros(len(fp), dtype=bool)
        for slot in range(SLOTS):
            todo = np.flatnonzero(~done & (self.slots[b, slot] == 0))
            if len(todo):
                _, first = np.unique(b[todo], return_index=True)  # one per bucket and slot
                at = todo[first]
                self.slots[b[at], slot] = fp[at]
                done[at] = True
        self.size += int(done.sum())
        return done

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Insert hashes, moving others to their second bucket where needed.

        Returns the (fingerprint, bucket) pairs left over when the table is saturated, as an array of
        shape (k, 2); the caller keeps them.
        """
        fp, b1, b2 = self.places(h)
        rest = ~self._settle(fp, b1)
        fp, b = fp[rest], b2[rest]
        for _ in range(ROUNDS):
            if not len(fp):
                break
            done = self._settle(fp, b)
            fp, b = fp[~done], b[~done]
            if not len(fp):
                break
            _, first = np.unique(b, return_index=True)  # one eviction per bucket and round
            slot = self.random.integers(0, SLOTS, len(first))
            evicted = self.slots[b[first], slot].copy()
            self.slots[b[first], slot] = fp[first]
            fp[first] = evicted
            b[first] = self.other(b[first], evicted)
        return np.stack([fp.astype(np.int64), b], axis=1) if len(fp) else np.zeros((0, 2), dtype=np.int64)

    def delete(self, h: int) -> bool:
        """Remove one copy of a hash that was inserted before."""
        fp, b1, b2 = self.places(np.array([h], dtype=np.int64))
        for b in (int(b1[0]), int(b2[0])):
            hit = np.flatnonzero(self.slots[b] == fp[0])
            if len(hit):
                self.slots[b, hit[0]] = 0
                self.size -= 1
                return True
        return False


class CuckooStore:
    """Growing chain of cuckoo tables for one partition."""

    def __init__(self, buckets: int = 1 << 10) -> None:
        self.tables = [CuckooTable(buckets)]
        #: (table, fingerprint, bucket) that found no place in its saturated table
        self.stash: dict[tuple[int, int, int], int] = {}

    def contains(self, h: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(h), dtype=bool)
        for t in self.tables:
            hit |= t.contains(h)
        if self.stash:
            for k, t in enumerate(self.tables):
                fp, b1, b2 = t.places(h)
                kept = {(f, b) for (n, f, b) in self.stash if n == k}
                if kept:
                    hit |= np.fromiter(((int(f), int(x)) in kept or (int(f), int(y)) in kept for f, x, y in zip(fp, b1, b2)), bool, len(h))
        return hit

    def insert(self, h: np.ndarray) -> None:
        at = 0
        while at < len(h):
            t = self.tables[-1]
            room = int(MAX_LOAD * t.slots.size) - t.size
            if room <= 0:
                self.tables.append(CuckooTable(t.buckets * 2))
                continue
            left = t.insert(h[at : at + room])
            at += room
            for f, b in left.tolist():
                key = (len(self.tables) - 1, f, b)
                self.stash[key] = self.stash.get(key, 0) + 1
            if len(left):  # saturated before its nominal load
                self.tables.append(CuckooTable(t.buckets * 2))

    def delete(self, h: int) -> bool:
        """Remove one copy of a hash that was inserted before.  Where several tables hold its fingerprint, one copy may be
        another key's, whose buckets differ in a larger table: then nothing is removed, and the hash stays seen."""
        one, found = np.array([h], dtype=np.int64), []
        for k, t in enumerate(self.tables):
            fp, b1, b2 = t.places(one)
            keys = [key for b in (b1, b2) if self.stash.get(key := (k, int(fp[0]), int(b[0])))]
            if keys or t.contains(one)[0]:
                found.append((t, keys))
        if len(found) != 1:
            return False
        t, keys = found[0]
        if t.delete(h):
            return True
        self.stash[keys[0]] -= 1
        if not self.stash[keys[0]]:
            del self.stash[keys[0]]
        return True

    def ask(self, h: np.ndarray) -> np.ndarray:
        """For hashes in order of arrival: was it there?  Each distinct hash that was not is inserted, also where its
        fingerprint equals another's of the same batch, so that none is forgotten when the next table has other buckets."""
        seen = self.contains(h)
        new = np.flatnonzero(~seen)
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            again = np.ones(len(new), dtype=bool)
            again[first] = False
            seen[new[again]] = True
            self.insert(h[new[np.sort(first)]])
        return seen

    def used_bytes(self) -> int:
        return sum(t.slots.nbytes for t in self.tables)

    def dump(self) -> list[tuple[int, bytes]]:
        return [(t.buckets, t.slots.tobytes()) for t in self.tables]

    @classmethod
    def load(cls, parts: list[tuple[int, bytes]], stash: dict | None = None) -> CuckooStore:
        s = cls.__new__(cls)
        s.tables, s.stash = [], dict(stash or {})
        for buckets, raw in parts:
            t = CuckooTable(buckets)
            t.slots = np.frombuffer(raw, dtype=np.uint16).reshape(buckets, SLOTS).copy()
            t.size = int((t.slots != 0).sum())
            s.tables.append(t)
        return s


def key_hash(*cols: Column) -> Column:
    """The 64 bits a table sees of a key."""
    return F.xxhash64(*cols)


def key_check(*cols: Column) -> Column:
    """Further 64 bits under another seed, which only the audit compares: with the hash, 128 bits stand for the key."""
    return F.xxhash64(F.lit("check"), *cols)


FIELDS = ("docordataseturl", "filehash")
_KEY = "field int, h long, check long, ord long, seen boolean"
_AUDITED = _KEY + ", wrong boolean"


def ask(first_rows: DataFrame, partitions: int, buckets: int = 1 << 12) -> DataFrame:
    """Stream rows (field, h, check, ord) through partitioned cuckoo stores in order of ``ord``; adds ``seen``.

    Rows with negative ``ord`` (earlier keys) come first.  Memory per task: the fingerprints of one partition and one
    Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = CuckooStore(buckets)
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(seen=store.ask(pdf["h"].to_numpy(dtype=np.int64)))

    return first_rows.select("field", "h", "check", "ord").repartition(partitions, "h").sortWithinPartitions("ord", "h", "check").mapInPandas(run, _KEY)


def audit(asked: DataFrame) -> DataFrame:
    """Answers with ``wrong``: a "seen" without an earlier row of its key.

    All rows of a key sit in the partition that answered them, so a sort inside it (which spills) is enough: nothing is
    shuffled, and nothing but the last key is held.  An answer "new" needs no check, for a table forgets no key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            if len(pdf):
                h, c = pdf["h"].to_numpy(), pdf["check"].to_numpy()
                first = np.ones(len(pdf), dtype=bool)
                first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
                first[0] = (h[0], c[0]) != last
                last = (h[-1], c[-1])
                yield pdf.assign(wrong=first & pdf["seen"].to_numpy(dtype=bool))

    return asked.sortWithinPartitions("h", "check", "ord").mapInPandas(run, _AUDITED)


def _key(field: int, value: Column) -> Column:
    name = F.lit(FIELDS[field])
    return F.struct(F.lit(field).alias("field"), key_hash(name, value).alias("h"), key_check(name, value).alias("check"))


def _has(field: int) -> Column:
    """Does a record have a key in the field: a document's url, a well-formed file hash?"""
    url, digest = F.col("docordataseturl"), F.col("filehash")
    return F.coalesce(url.startswith("http") if field == 0 else forms.is_hash(digest), F.lit(False))


def record_keys(records: DataFrame) -> DataFrame:
    """(record_id, field, h, check): hashes of all keys; the keys themselves go no further.

    Other cells have no key, and rows without a record_id no place in the order: neither is asked."""
    both = F.array(*[F.when(_has(k), _key(k, F.col(c))) for k, c in enumerate(FIELDS)])
    return records.filter("record_id is not null").select(F.col("record_id").cast("bigint").alias("record_id"), F.inline(F.filter(both, lambda x: x.isNotNull())))


def earlier_keys(earlier: DataFrame) -> DataFrame:
    """(field, h, check) of the log of earlier keys; unknown kinds and NULL values are no keys."""
    kind = F.col("key_kind")
    key = F.when(kind == "url", _key(0, F.col("key_value"))).when(kind == "hash", _key(1, F.col("key_value")))
    return earlier.filter(F.col("key_value").isNotNull() & kind.isin("url", "hash")).select(key.alias("k")).select("k.*")


def answers(keys: DataFrame, ids: DataFrame, earlier: DataFrame, blocks: int = 64) -> DataFrame:
    """Audited answers of the tables: (field, h, check, ord, seen, wrong), one row per key and block.

    ``keys`` has (record_id, field, h, check), ``ids`` at least all its record_id, ``earlier`` (field, h, check).
    Records are cut into at most ``blocks`` blocks of equal id ranges and the first of each key and block asks; a repeat
    inside the block is seen without asking.  So a key with a third of all rows is at most one row per block and map task.
    """
    least, most = ids.agg(F.min("record_id").alias("x")).scalar(), ids.agg(F.max("record_id").alias("x")).scalar()
    block = F.floor((F.col("record_id") - least) * blocks / (most - least + 1)).cast("int")
    firsts = keys.groupBy("field", "h", "check", block.alias("block")).agg(F.min("record_id").alias("ord")).drop("block")
    known = earlier.distinct().withColumn("ord", F.lit(-1).cast("bigint"))
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return audit(ask(firsts.unionByName(known), partitions))


def seen_before(records: DataFrame, earlier: DataFrame, blocks: int = 64) -> DataFrame:
    """(record_id, field_name) of every key met before: in ``earlier`` or in a record with a smaller id.

    A record is new exactly if it asked and was answered "new", or was answered "seen" wrongly; all other
    records with a key were seen.  NULL and malformed cells have no key; records without an id have no place in the
    order and are left out; rows repeated with their id are one record; keys of any length are compared whole, by 128
    bits; further columns do no harm; an empty table gives no rows.
    """
    got = answers(record_keys(records), records.select("record_id"), earlier_keys(earlier), blocks).filter("ord >= 0")
    new = got.filter(~F.col("seen") | F.col("wrong")).groupBy(F.col("ord").alias("record_id"))
    new = new.agg(*[F.bool_or(F.col("field") == k).alias(f"new{k}") for k in range(len(FIELDS))])
    rows = records.filter("record_id is not null").select(F.col("record_id").cast("bigint").alias("record_id"), *[_has(k).alias(f"has{k}") for k in range(len(FIELDS))]).filter("has0 or has1")
    met = [F.when(F.col(f"has{k}") & ~F.coalesce(F.col(f"new{k}"), F.lit(False)), F.lit(f)) for k, f in enumerate(FIELDS)]
    return rows.join(new, "record_id", "left").select("record_id", F.explode(F.array_compact(F.array(*met))).alias("field_name"))


def error_rate(records: DataFrame, earlier: DataFrame, blocks: int = 64) -> DataFrame:
    """Per field: questions asked, answers "seen", wrong ones among them, truly new keys, and the rate of wrong
    answers among the new keys (NULL without any).  An answer "new" is never wrong."""
    got = answers(record_keys(records), records.select("record_id"), earlier_keys(earlier), blocks).filter("ord >= 0")
    new = F.count(F.when(~F.col("seen") | F.col("wrong"), 1))
    return got.groupBy(F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("field") + 1).alias("field_name")).agg(
        F.count(F.lit(1)).alias("asked"), F.count(F.when(F.col("seen"), 1)).alias("answered_seen"),
        F.count(F.when(F.col("wrong"), 1)).alias("wrong_seen"), new.alias("new_keys"),
        (F.count(F.when(F.col("wrong"), 1)) / F.nullif(new, F.lit(0))).alias("error_rate"),
    )


# Stores kept between loads -------------------------------------------------------------------------------

STORE = "part int, table_no int, buckets long, slots binary, stash array<struct<fp:int,bucket:long,n:int>>"


def _rows(part: int, store: CuckooStore) -> pd.DataFrame:
    out = []
    for k, (buckets, raw) in enumerate(store.dump()):
        stash = [{"fp": f, "bucket": b, "n": n} for (t, f, b), n in store.stash.items() if t == k]
        out.append((part, k, buckets, raw, stash))
    return pd.DataFrame(out, columns=["part", "table_no", "buckets", "slots", "stash"])


def _restore(pdf: pd.DataFrame) -> CuckooStore:
    pdf = pdf.sort_values("table_no")
    stash = {(int(k), int(s["fp"]), int(s["bucket"])): int(s["n"]) for k, ss in zip(pdf["table_no"], pdf["stash"]) for s in ss}
    return CuckooStore.load(list(zip(pdf["buckets"], pdf["slots"])), stash)


def _part(parts: int) -> Column:
    return F.pmod(key_hash("field_name", "key_value"), F.lit(parts)).cast("int")


def _spread(keys: DataFrame, parts: int) -> DataFrame:
    """Distinct keys as (part, h), at most parts * 4-byte rows of each hot key before the shuffle."""
    return keys.select("field_name", "key_value").distinct().select(_part(parts).alias("part"), key_hash("field_name", "key_value").alias("h"))


def update_store(store: DataFrame | None, add: DataFrame, remove: DataFrame | None, parts: int, spark=None, buckets: int = 1 << 10, held: DataFrame | None = None) -> DataFrame:
    """A new store table with keys removed and then added.  Both are (field_name, key_value).

    Every added key gets a copy of its fingerprint, for fingerprints alone can't tell a key the store holds from a new
    one.  Keys of ``held``, the exact keys in the store after the removal, are not added again; without it, a key added
    twice needs two removals.  Removing a key the store never held must not be asked for (it could remove another key
    with the same fingerprint).  One task holds one partition's distinct keys of this load as hashes.
    """
    if store is None:
        store = add.sparkSession.createDataFrame([], STORE)
    if held is not None:
        add = add.select("field_name", "key_value").join(held.select("field_name", "key_value"), ["field_name", "key_value"], "left_anti")
    ops = _spread(add, parts).withColumn("op", F.lit(1))
    if remove is not None:
        ops = ops.unionByName(_spread(remove, parts).withColumn("op", F.lit(0)))

    def run(key, kept: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        s = _restore(kept) if len(kept) else CuckooStore(buckets)
        for h in np.sort(ops.loc[ops["op"] == 0, "h"].to_numpy(dtype=np.int64)):
            s.delete(int(h))
        h = np.sort(ops.loc[ops["op"] == 1, "h"].to_numpy(dtype=np.int64))
        if len(h):
            s.insert(h)
        return _rows(int(key[0]), s)

    return store.groupBy("part").cogroup(ops.groupBy("part")).applyInPandas(run, STORE)


def probe_store(store: DataFrame, keys: DataFrame, parts: int) -> DataFrame:
    """(field_name, key_value, seen) for the distinct keys of ``keys``."""
    asked = keys.select("field_name", "key_value").distinct().withColumn("part", _part(parts)).withColumn("h", key_hash("field_name", "key_value"))

    def run(key, kept: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        s = _restore(kept) if len(kept) else CuckooStore()
        out = asked[["field_name", "key_value"]].copy()
        out["seen"] = s.contains(asked["h"].to_numpy(dtype=np.int64)) if len(asked) else pd.Series([], dtype=bool)
        return out

    return store.groupBy("part").cogroup(asked.groupBy("part")).applyInPandas(run, "field_name string, key_value string, seen boolean")
