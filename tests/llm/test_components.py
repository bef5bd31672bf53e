"""Components by one task and by star rounds, against a plain search."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tramline.llm import common


def plain(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    rng = random.Random(few)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)]
    edges += [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (2**62, -(2**62))]
    got = common.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.component for r in got} == plain(edges) and len(got) == len(plain(edges))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_stored_step_leaves_no_shuffle_files(spark):
    def files():
        found, names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), set()
        while found.hasNext():
            names.add(found.next().getName())
        return {x for x in names if x.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(common.DROP_SHUFFLES)
    counted = spark.range(20_000).groupBy((F.col("id") % 5_000).alias("key")).agg(F.count("*").alias("n"))
    kept = [common.stored(counted, "counted", codec) for codec in (None, "zstd")]
    for _ in range(50):
        if not (left := {x for x in files() - before if x.endswith(".data")}):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(common.DROP_SHUFFLES) == setting
    assert [x.where("n = 4").count() for x in (*kept, counted)] == [5_000] * 3  # the frame can still be run
