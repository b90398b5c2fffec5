from __future__ import annotations

import json
from collections import Counter

from linkharbor.streaming import loader


def test_stream_of_batches(spark, tmp_path):
    rows = [("a", "https://x.org/item/1"), ("a", "https://x.org/paper/1.pdf"), ("a", "https://x.org/item/1"), ("b", "https://x.org/"), ("c", ""), ("d", "nonsense"), ("e", "https://y.org/handle/1/2")]
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"id": i, "url": u}) for i, u in rows) + "\nbroken\n\n")
    (src / "2.json").write_text(json.dumps({"id": "a", "url": "https://x.org/item/1"}) + "\n")
    paths = [str(tmp_path / x) for x in ("chosen", "records", "cp")]
    loader.load(spark, str(src), *paths).awaitTermination()
    chosen = {(r.id, r.url, r.choice) for r in spark.read.parquet(paths[0]).collect()}
    assert chosen == {("a", "https://x.org/paper/1.pdf", "candidate"), ("e", "https://y.org/handle/1/2", "handle"), ("a", "https://x.org/item/1", "other")}
    recs = [json.loads(r.value) for r in spark.read.text(paths[1]).collect()]
    assert Counter((r["id"], r["docOrDatasetUrl"], r["wasUrlChecked"]) for r in recs) == {
        ("a", "unreachable", "false"): 1, ("a", "duplicate", "false"): 1, ("b", "unreachable", "true"): 1, ("c", "unreachable", "true"): 1, ("d", "unreachable", "true"): 1,
    }
    loader.load(spark, str(src), *paths).awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 3  # nothing new, nothing twice
