"""The cache of a stream against a plain ordered dictionary, over several batches and a restart."""

from __future__ import annotations

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from weft.streaming import cache

SCHEMA = "owner long, event_id long, key string, ts timestamp"


def plain(rows, seconds, capacity, renew):
    held: dict = {}
    out = {}
    for owner, event_id, key, at in rows:
        c = held.setdefault(owner, OrderedDict())
        for k in [k for k, stored in c.items() if at - stored > seconds]:
            del c[k]
        hit = (key or "") in c
        age = at - c[key or ""] if hit else None
        if not hit or renew:
            c[key or ""] = at
        c.move_to_end(key or "")
        if len(c) > capacity:
            c.popitem(last=False)
        out[event_id] = (owner, key or "", hit, age, len(c))
    return out


@pytest.mark.parametrize("renew", [False, True])
def test_equals_a_plain_cache(spark, tmp_path, renew):
    r = random.Random(7)
    keys = [*"abcdefg", None, ""]
    batches, event_id, now = [], 0, 0
    for _ in range(3):
        rows = []
        for _ in range(150):
            now += r.choice((0, 1, 5, 20))
            rows.append((r.choice((1, 1, 2, None)), event_id, r.choice(keys), now))
            event_id += 1
        batches.append(rows)
    want = plain([x for rows in batches for x in rows], 60, 3, renew)
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"

    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)

    def write(rows):
        mixed = r.sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "owner long, event_id long, key string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        df.coalesce(1).write.mode("append").parquet(source)

    write(batches[0])
    assert cache.run(cache.served(stream(), 60, 3, renew), folder).count() == 150
    for rows in batches[1:]:
        write(rows)  # a stream that is started again goes on with its state
        got = cache.run(cache.served(stream(), 60, 3, renew), folder)
    got = {x.event_id: (x.owner, x.key, x.hit, x.age, x.held) for x in got.collect()}
    assert got == want
    assert sum(x[2] for x in want.values()) > 30
    assert cache.run(cache.served(stream(), 60, 3, renew), folder).count() == 450


def test_empty_and_without_time(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "a", None)], SCHEMA).write.parquet(source)
    s = spark.readStream.schema(SCHEMA).parquet(source)
    assert cache.run(cache.served(s), f"{tmp_path}/out").count() == 0
    with pytest.raises(ValueError):
        cache.served(s, capacity=0)
