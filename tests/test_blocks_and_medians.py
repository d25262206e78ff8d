"""Ordered computations over groups of any size, with one group holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgauge.operators import blocks, conversations
from talkgauge.operators.medians import grouped_medians


@pytest.fixture(scope="module")
def skewed(spark):
    """500 messages, a third of them in one session."""
    rnd = random.Random(7)
    sizes = {"hot": 170, **{f"s{i}": rnd.randint(1, 8) for i in range(75)}}
    rows = [
        (s, i, rnd.choice(["agent", "client"]), rnd.randint(0, 9))
        for s, n in sizes.items()
        for i in range(n)
    ]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "session_id string, msg_index bigint, speaker string, v int")


@pytest.mark.parametrize("block_rows", [1, 2, 7, 4096])
@pytest.mark.parametrize("include", [True, False])
def test_running_total_equals_window(skewed, block_rows, include):
    w = (
        Window.partitionBy("session_id").orderBy("msg_index")
        .rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    )
    want = skewed.select("session_id", "msg_index", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("t"))
    got = blocks.running_total(
        skewed, ["session_id"], "msg_index", F.col("v"), "t", include, block_rows
    ).select("session_id", "msg_index", "t")
    assert sorted(want.collect()) == sorted(got.collect())


def test_block_window_is_never_a_whole_hot_group(skewed):
    blocked = blocks.with_block(skewed, "msg_index", 10)
    largest = blocked.groupBy("session_id", blocks.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest == 10


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_turn_numbers_do_not_depend_on_blocks(skewed, block_rows):
    plain = conversations.number_turns(skewed)
    cut = conversations.number_turns(skewed.repartition(13), block_rows=block_rows)
    columns = ["session_id", "msg_index", "turn_number"]
    assert sorted(plain.select(columns).collect()) == sorted(cut.select(columns).collect())


def medians_of(df, keys, columns):
    return {tuple(r[k] for k in keys): r for r in grouped_medians(df, keys, columns).collect()}


def test_medians_of_small_groups(spark):
    data = {"a": [1.0], "b": [2.0, 4.0], "c": [5.0, 1.0, 9.0], "d": [1.0, 1.0, 1.0, 7.0], "e": [None]}
    rows = [(k, v, 1) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double, n int")
    got = medians_of(df, ["k"], ["v", "n"])
    assert {k[0]: r.v_median for k, r in got.items()} == {"a": 1.0, "b": 3.0, "c": 5.0, "d": 1.0, "e": None}
    assert got[("e",)].n_median == 1.0


@pytest.mark.parametrize("shape", ["uniform", "heavy_tail", "few_values", "one_value", "negative"])
def test_medians_are_exact_on_large_skewed_groups(spark, shape):
    rnd = random.Random(shape)
    draw = {
        "uniform": lambda: rnd.random() * 90,
        "heavy_tail": lambda: rnd.paretovariate(0.3),
        "few_values": lambda: float(rnd.choice([1, 1, 2, 3])),
        "one_value": lambda: 5.0,
        "negative": lambda: rnd.gauss(0, 1e6),
    }[shape]
    rows = [("hot" if i % 3 else f"g{i % 40}", draw()) for i in range(60_001)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(16)
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    got = medians_of(df, ["k"], ["v"])
    assert {k[0]: r.v_median for k, r in got.items()} == {k: statistics.median(v) for k, v in groups.items()}
