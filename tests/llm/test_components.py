import random

import pytest

from tidewater.llm import setjoin


def test_long_chains(spark):
    # Ids ascend towards the smallest one at the far end; another chain is shuffled; two ids stand alone.
    ids = list(range(5000, 5260))
    random.Random(2).shuffle(ids)
    edges = [(k, k + 1) for k in range(1000, 1250)] + [(1250, 5), *zip(ids, ids[1:], strict=False), (1, 2)]
    got = {r["id"]: r["component"] for r in setjoin.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 5, 1: 1, 2: 1} | {k: 5 for k in range(1000, 1251)} | {k: 5000 for k in ids}


def test_unsettled_labels_are_an_error(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1000, 1100)] + [(1100, 5)], "a long, b long")
    with pytest.raises(RuntimeError):
        setjoin.components(edges, limit=2)
