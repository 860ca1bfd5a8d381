import random
import re
import time

import pytest
from kestrine.llm.common import components, swept
from pyspark.sql import functions as F


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def shuffles(spark):
    """Numbers of the shuffles of which there are files."""
    return set(re.findall(r"shuffle_(\d+)_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))


def left(spark, before, most):
    """Shuffles with files now that had none before; files go in the background, so it waits until there are at most so many."""
    for _ in range(100):
        if len(shuffles(spark) - before) <= most:
            break
        time.sleep(0.1)
    return len(shuffles(spark) - before)


def shuffled(n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    return ids


GRAPHS = {
    "none": [],
    "loops": [(3, 3), (5, 5)],
    "chain": list(zip(shuffled(60), shuffled(60)[1:], strict=False)),
    "stars": [(x, 1000 + x % 3) for x in range(90)] + [(x, x % 4 - 9) for x in range(200, 290)],
    "repeated": [(1, 2), (2, 1), (1, 2), (2, 3), (-7, 3), (8, 9)],
    "random": [(random.Random(k).randrange(120), random.Random(-k).randrange(120, 300)) for k in range(1, 130)],
}


@pytest.mark.parametrize("graph", GRAPHS)
def test_components_are_those_of_union_find(spark, graph):
    edges = GRAPHS[graph]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == brute([e for e in edges if e[0] != e[1]])


def test_rounds_leave_no_shuffle_files(spark):
    """Of a round only the count that ends the rounds leaves its files to the driver's garbage collection."""
    before, edges = shuffles(spark), GRAPHS["chain"]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert left(spark, before, 8) <= 8
    assert {r.root for r in found.collect()} == {0}


def test_swept_rows_stay_and_so_does_the_setting(spark):
    before = shuffles(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    df = spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).count()
    kept = swept(df)
    assert left(spark, before, 0) == 0 and spark.conf.get(name, None) == was
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="boom"):
        swept(spark.range(3).select(F.raise_error(F.lit("boom")).alias("x")))
    assert spark.conf.get(name, None) == was
