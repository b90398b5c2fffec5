"""Circuit breakers as keyed state: the same rule as the batch form, one domain's counters per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.breakers import NEVER, PATH_403, PATHS_403, THRESHOLDS

OUTPUT = "domain string, kind string, block_seq long"
#: good hits, bad counts per kind as JSON, 403 counts per path as JSON, blocked paths, blocked since
STATE = "good long, bad string, paths string, n_paths long, block_seq long"


class DomainState:
    """Counters of one domain; ``step`` returns the kind that opens its breaker, once."""

    def __init__(self, thresholds: dict[str, int], path_threshold: int, paths: int) -> None:
        self.t, self.pt, self.pn = thresholds, path_threshold, paths
        self.good, self.bad, self.by_path, self.n_paths, self.block_seq = 0, {}, {}, 0, None

    def step(self, seq: int, kind: str, path: str | None) -> str | None:
        if self.block_seq is not None:
            return None
        if kind == "ok_doc":
            self.good += 1
            return None
        opened = kind == "block_now"
        if kind in self.t:
            self.bad[kind] = self.bad.get(kind, 0) + 1
            opened = self.bad[kind] > self.t[kind] + self.good
        elif kind == "http_403" and path is not None:
            n = self.by_path[path] = self.by_path.get(path, 0) + 1
            if n == self.pt + 1:
                self.n_paths += 1
                opened = self.n_paths == self.pn + 1
        if opened:
            self.block_seq = seq
            self.bad, self.by_path = {}, {}
            return kind
        return None


def blocks(events: DataFrame, thresholds: dict[str, int] | None = None, path_threshold: int = PATH_403, paths: int = PATHS_403, ttl_ms: int | None = None) -> DataFrame:
    """Stream of (domain, kind, block_seq): one row when a domain's breaker opens.

    Events of a domain must arrive in order of ``seq`` up to a micro-batch, inside which they are sorted.  With
    ``ttl_ms`` a domain that was silent so long is forgotten (processing time), which unblocks it.
    """
    import json

    t = thresholds or THRESHOLDS

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = DomainState(t, path_threshold, paths)
        if state.exists:
            good, bad, by_path, n_paths, block = state.get
            s.good, s.bad, s.by_path, s.n_paths, s.block_seq = good, json.loads(bad), json.loads(by_path), n_paths, None if block < 0 else block
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = []
        if key[0] not in NEVER:
            for seq, kind, path in zip(pdf["seq"], pdf["kind"], pdf["path"]):
                opened = s.step(int(seq), kind, path if isinstance(path, str) else None)
                if opened:
                    out.append((key[0], opened, int(seq)))
        state.update((s.good, json.dumps(s.bad), json.dumps(s.by_path), s.n_paths, -1 if s.block_seq is None else s.block_seq))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=["domain", "kind", "block_seq"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    rows = events.filter("domain is not null").select("seq", "domain", "path", "kind")
    return rows.groupBy("domain").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)
