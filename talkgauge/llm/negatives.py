"""Hard negatives: rows of another label whose score lies in a window below an anchor's positives.

*Blocks.*  Candidates are laid along a Hilbert curve over the dimensions of the greatest spread and packed, in
that order, into blocks of ``BLOCK_ROWS``: one row of a Parquet table with ids, labels, vectors and a zone map, the
least and greatest value of each dimension and label.  Blocks lie in at most ``MOST_PARTS`` folders, parts, each with a
zone map of its own.

*Bounds.*  For an anchor, the least and greatest score that a zone map allows are sums over dimensions of
the smaller and greater of the two products (interval arithmetic).  Parts, and inside them blocks, are read
only if these bounds meet what the anchor still looks for: scores above its fifth positive so far, or inside
one of its windows and above that window's last negative so far.

*Rounds.*  Anchors come in rounds of neighbours on the curve, of a bounded size in bytes; a round's vectors
are broadcast, its parts are chosen by the zone maps, and its blocks are multiplied where they are read.  The
blocks next to an anchor on the curve are looked at first, which gives the later search its thresholds.  Tasks keep the best rows of
each anchor and window, so what is shuffled does not grow with the rows read.

Scores are exact: doubles where every sum stays below 2^53, Python integers otherwise, held at the limits of
a long.  Defined results: rows with a null id, label or vector, or a component that is null or not finite, take
no part; of rows that repeat an id the smallest (label, vector) counts; shorter vectors count as ended by
zeros, empty ones score 0; fewer rows than asked for give fewer rows; an anchor without positives, or without
rows inside a window, gives none there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.frames import shared_path, stored

BLOCK_ROWS = 512
PART_ROWS = 8_192  # least rows of a part
MOST_PARTS = 4_096
ROUND_BYTES = 2 << 20  # vectors of one round's anchors
CURVE_DIMENSIONS = 15
CURVE_BITS = 4
SAMPLE = 4_096  # rows that place the curve; every row is laid along it
NONE = np.iinfo(np.int64).min
PLACES = "anchor int, kind int, vec_id bigint, score bigint"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points (n, d) with coordinates below 2^bits, where d x bits is at most 63."""
    axis = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    last = len(axis) - 1
    bit = 1 << (bits - 1)
    while bit > 1:  # turn and mirror each level back into the first one's direction
        below = bit - 1
        for k in range(len(axis)):
            set_there = (axis[k] & bit) != 0
            swapped = np.where(set_there, 0, (axis[0] ^ axis[k]) & below)
            axis[0] = np.where(set_there, axis[0] ^ below, axis[0] ^ swapped)
            axis[k] = axis[k] ^ swapped
        bit >>= 1
    for k in range(1, len(axis)):
        axis[k] = axis[k] ^ axis[k - 1]
    turn, bit = np.zeros_like(axis[0]), 1 << (bits - 1)
    while bit > 1:
        turn = np.where((axis[last] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    place = np.zeros_like(axis[0])
    for level in range(bits - 1, -1, -1):
        for k in range(len(axis)):
            place = (place << 1) | (((axis[k] ^ turn) >> level) & 1)
    return place


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows, ended by zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def labelled(embeddings: DataFrame) -> DataFrame:
    """Rows that take part, with components floor(256 x); where 7 divides the id the label moves on by one of ten."""
    vector = F.transform(F.col("embedding"), lambda x: F.rint(F.floor(F.lit(256.0) * x.cast("double")).cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(usable)
    return rows.select("vec_id", label.cast("long").alias("label"), vector.alias("vector"))


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of queries (a, d) with any vector between low and high (b, d), a little wide for rounding."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1 + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integers in doubles, exact."""
    size = np.abs(queries).max(axis=0, initial=0) @ np.abs(vectors).max(axis=0, initial=0)
    if size < 2**53:
        return (queries @ vectors.T).astype(np.int64)
    held = lambda x: max(NONE + 1, min(2**63 - 1, x))
    whole = [[int(x) for x in v] for v in vectors]
    return np.array([[held(sum(map(int.__mul__, q, v))) for v in whole] for q in ([int(x) for x in row] for row in queries)], dtype=np.int64).reshape(len(queries), len(vectors))


class Best:
    """The k best (score, smaller id) rows of several searches."""

    def __init__(self, searches: int, k: int) -> None:
        self.score, self.id = np.full((searches, k), NONE), np.full((searches, k), np.iinfo(np.int64).max)

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates with these ids and, for each of some searches, these scores; NONE is no candidate."""
        k = self.score.shape[1]
        floor = self.score[which, k - 1]
        if scores.shape[1] > k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
        row, column = np.nonzero((scores >= floor[:, None]) & (scores > NONE))
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        held = which[touched]
        at = np.concatenate((row, np.repeat(np.arange(len(held)), k)))
        score = np.concatenate((scores[touched[row], column], self.score[held].ravel()))
        name = np.concatenate((ids[column], self.id[held].ravel()))
        # best first: scores are compared as -(score + 1), which no long overflows
        order = np.lexsort((name, ~score, at))
        at, score, name = at[order], score[order], name[order]
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(len(held)))[at]
        keep = place < k
        self.score[held[at[keep]], place[keep]] = score[keep]
        self.id[held[at[keep]], place[keep]] = name[keep]


class Blocks:
    """The stored blocks of some vectors, and their parts' zone maps."""

    def __init__(self, rows: DataFrame, anchors: Column, block_rows: int, part_rows: int) -> None:
        spark = rows.sparkSession
        one = rows.withColumn("_anchor", F.coalesce(anchors, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("label", "vector", "_anchor")).alias("row"))
        one = stored(one.select("vec_id", "row.*"), "candidates")
        count, self.width = one.agg(F.count("*"), F.max(F.size("vector"))).first()
        self.width = max(1, self.width or 0)
        parts = min(MOST_PARTS, max(1, -(-count // part_rows)))
        self.round_size = max(1, ROUND_BYTES // (8 * self.width))
        keyed = one.withColumn("curve", _curve(one, self.width)).repartitionByRange(parts, "curve", "vec_id").sortWithinPartitions("curve", "vec_id")
        width, path = self.width, shared_path(spark, "blocks")
        packed = keyed.mapInPandas(lambda batches: _packed(batches, width, block_rows), "part int, block bigint, n int, n_anchors int, least_label bigint, greatest_label bigint, low binary, high binary, ids binary, labels binary, vectors binary, asked binary")
        packed.write.partitionBy("part").parquet(path)
        schema = "block bigint, n int, n_anchors int, least_label bigint, greatest_label bigint, low binary, high binary, ids binary, labels binary, vectors binary, asked binary, part int"
        self.table = spark.read.schema(schema).parquet(path)
        zones = self.table.select("part", "n_anchors", "least_label", "greatest_label", "low", "high").mapInPandas(lambda batches: _zones(batches, width), "part int, n_anchors bigint, least_label bigint, greatest_label bigint, low binary, high binary")
        # at most MOST_PARTS rows and a task's part of each
        joined = []
        for part, group in zones.toPandas().groupby("part"):
            low, high = (np.stack([np.frombuffer(x) for x in group[c]]) for c in ("low", "high"))
            joined.append((part, group["n_anchors"].sum(), group["least_label"].min(), group["greatest_label"].max(), low.min(axis=0), high.max(axis=0)))
        self.parts, self.asked, self.least_label, self.greatest_label = (np.array([j[k] for j in joined], dtype=np.int64) for k in range(4))
        self.low, self.high = (np.array([j[k] for j in joined]).reshape(len(joined), self.width) for k in (4, 5))

    def rounds(self) -> Iterator[list[int]]:
        """Neighbouring parts whose anchors are one round; one part may need more."""
        group, held = [], 0
        for part, n in zip(self.parts.tolist(), self.asked.tolist()):
            if group and held + n > self.round_size:
                yield group
                group, held = [], 0
            if n:
                group, held = [*group, part], held + n
        if group:
            yield group

    def anchors(self, group: list[int]) -> Iterator[pd.DataFrame]:
        """The anchors of these parts (part, block, vec_id, label, vector), at most a round's at a time."""
        width = self.width
        rows = self.table.where(F.col("part").isin(group) & (F.col("n_anchors") > 0)).select("part", "block", "n", "ids", "labels", "vectors", "asked").mapInPandas(lambda b: _anchors(b, width), "block bigint, vec_id bigint, label bigint, vector binary")
        total = int(self.asked[np.isin(self.parts, group)].sum())
        if total <= self.round_size:
            yield rows.toPandas().sort_values(["block", "vec_id"]).reset_index(drop=True)
            return
        pieces = -(-total // self.round_size) * 2
        for k in range(pieces):  # one part with more anchors than a round: by a hash of their ids
            yield rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == k).toPandas().sort_values(["block", "vec_id"]).reset_index(drop=True)

    def read(self, parts: np.ndarray) -> DataFrame:
        return self.table.where(F.col("part").isin([int(p) for p in parts])).drop("asked", "n_anchors")


def _curve(rows: DataFrame, width: int) -> Column:
    """The place on the curve, laid through the widest dimensions of a sample of bounded size."""
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toPandas()["vector"], width)
    if not len(sample):
        sample = np.zeros((1, width))
    spread = sample.std(axis=0)
    chosen = np.argsort(-spread, kind="stable")[:CURVE_DIMENSIONS]
    middle, reach = sample.mean(axis=0)[chosen], np.maximum(spread[chosen], 1e-9) * 2

    @F.pandas_udf("bigint")
    def place(vectors: pd.Series) -> pd.Series:
        points = (matrix(vectors, width)[:, chosen] - middle) / reach  # -1 to 1 within two deviations
        cells = np.clip(np.floor((np.clip(points, -1, 1) + 1) / 2 * (1 << CURVE_BITS)), 0, (1 << CURVE_BITS) - 1)
        return pd.Series(hilbert_index(cells.astype(np.int64), CURVE_BITS))

    return place("vector")


def _packed(batches: Iterator[pd.DataFrame], width: int, block_rows: int) -> Iterator[pd.DataFrame]:
    """Blocks of consecutive rows; at most a batch and a block are held."""
    from pyspark import TaskContext

    part, number, held = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
        while len(held) >= block_rows:
            yield pd.DataFrame([_block(part, number, held.iloc[:block_rows], width)])
            held, number = held.iloc[block_rows:], number + 1
    if held is not None and len(held):
        yield pd.DataFrame([_block(part, number, held, width)])


def _block(part: int, number: int, rows: pd.DataFrame, width: int) -> dict:
    rows = rows.sort_values("vec_id")
    vectors, labels, asked = matrix(rows["vector"], width), rows["label"].to_numpy(np.int64), rows["_anchor"].to_numpy(bool)
    narrow = np.abs(vectors).max(initial=0) < 2**15
    return {
        "part": part, "block": (part << 32) + number, "n": len(rows), "n_anchors": int(asked.sum()), "least_label": labels.min(), "greatest_label": labels.max(),
        "low": vectors.min(axis=0).tobytes(), "high": vectors.max(axis=0).tobytes(), "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "labels": labels.tobytes(),
        "vectors": vectors.astype(np.int16).tobytes() if narrow else vectors.tobytes(), "asked": asked.tobytes(),
    }


def _vectors(data: bytes, n: int, width: int) -> np.ndarray:
    """A block's vectors: 16-bit integers where all fit, else doubles."""
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * width else np.float64).reshape(n, width).astype(np.float64)


def _zones(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """The zone map of each part, of what a task has of it."""
    found: dict[int, list] = {}
    for batch in batches:
        for part, n, least, greatest, low, high in batch.itertuples(index=False):
            low, high = np.frombuffer(low), np.frombuffer(high)
            old = found.get(part, [0, least, greatest, low, high])
            found[part] = [old[0] + n, min(old[1], least), max(old[2], greatest), np.minimum(old[3], low), np.maximum(old[4], high)]
    rows = [(part, n, least, greatest, low.tobytes(), high.tobytes()) for part, (n, least, greatest, low, high) in found.items()]
    yield pd.DataFrame(rows, columns=["part", "n_anchors", "least_label", "greatest_label", "low", "high"])


def _anchors(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for _, block, n, ids, labels, vectors, asked in batch.itertuples(index=False):
            rows = np.flatnonzero(np.frombuffer(asked, bool))
            vectors, ids, labels = _vectors(vectors, n, width), np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
            out += [(block, ids[r], labels[r], vectors[r].tobytes()) for r in rows]
        yield pd.DataFrame(out, columns=["block", "vec_id", "label", "vector"])


class Round:
    """One round's anchors and what they look for; sent to the tasks.

    A search is one anchor's best rows of its own label (kind 0), or its best of other labels whose scores lie
    between ``least`` and ``most`` (a window).
    """

    def __init__(self, anchors: pd.DataFrame, width: int) -> None:
        self.ids, self.labels, self.blocks = (anchors[c].to_numpy(np.int64) for c in ("vec_id", "label", "block"))
        self.vectors = np.array([np.frombuffer(v) for v in anchors["vector"]]).reshape(len(anchors), width)
        self.width = width

    def look_for(self, anchor: np.ndarray, kind: np.ndarray, least: np.ndarray, most: np.ndarray, k: int) -> None:
        self.anchor, self.kind, self.least, self.most, self.k = anchor, kind, least, most, k

    def wanted(self, low: np.ndarray, high: np.ndarray, least_label: np.ndarray, greatest_label: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Whether searches (s) must see zones (z): (s, z)."""
        least, most = bounds(self.vectors, low, high)
        own = self.labels[self.anchor][:, None]
        same = self.kind[:, None] == 0
        label = np.where(same, (own >= least_label) & (own <= greatest_label), (own != least_label) | (own != greatest_label))
        return label & (most[self.anchor] >= floor.astype(np.float64)[:, None]) & (least[self.anchor] <= self.most.astype(np.float64)[:, None])

    def search(self, batches: Iterator[pd.DataFrame], near: bool) -> Iterator[pd.DataFrame]:
        """The best rows of each search in a task's blocks; ``near``: only in the blocks next to an anchor's own."""
        best = Best(len(self.anchor), self.k)
        for batch in batches:
            for row in batch.itertuples(index=False):
                self._block(row, best, near)
        at, place = np.nonzero(best.score > NONE)
        yield pd.DataFrame({"anchor": self.anchor[at], "kind": self.kind[at], "vec_id": best.id[at, place], "score": best.score[at, place]})

    def _block(self, row: tuple, best: Best, near: bool) -> None:
        low, high = np.frombuffer(row.low)[None], np.frombuffer(row.high)[None]
        floor = np.maximum(best.score[:, -1], self.least)
        seen = self.wanted(low, high, np.array([row.least_label]), np.array([row.greatest_label]), floor)[:, 0]
        if near:
            seen &= np.abs(self.blocks[self.anchor] - row.block) <= 1
        searches = np.flatnonzero(seen)
        if not len(searches):
            return
        vectors, ids, labels = _vectors(row.vectors, row.n, self.width), np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
        asked, at = np.unique(self.anchor[searches], return_inverse=True)
        for a in range(0, len(asked), 256):  # a bounded table of products
            part = asked[a : a + 256]
            scores = products(self.vectors[part], vectors)
            inside = searches[(at >= a) & (at < a + 256)]
            mine = scores[at[(at >= a) & (at < a + 256)] - a]
            anchor = self.anchor[inside][:, None]
            same = labels[None, :] == self.labels[anchor]
            fits = np.where(self.kind[inside][:, None] == 0, same & (ids[None, :] != self.ids[anchor]), ~same)
            fits &= (mine >= self.least[inside][:, None]) & (mine <= self.most[inside][:, None])
            best.offer(inside, np.where(fits, mine, NONE), ids)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each search; tasks send k rows of each, and Spark cuts to k before it shuffles them."""
    return found.selectExpr("*", "row_number() OVER (PARTITION BY anchor, kind ORDER BY score DESC, vec_id) AS rank").where(F.col("rank") <= k)


def _searched(blocks: Blocks, asked: Round, k: int) -> DataFrame:
    """Two passes: the anchors' neighbourhood for thresholds, then all blocks whose bounds reach these."""
    spark = blocks.table.sparkSession

    def run(parts: np.ndarray, near: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)
        return _ranked(blocks.read(parts).mapInPandas(lambda batches: sent.value.search(batches, near), PLACES), k)

    home = np.unique(asked.blocks >> 32)
    first = run(home, True).groupBy("anchor", "kind").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).toPandas()
    place = {key: s for s, key in enumerate(zip(asked.anchor.tolist(), asked.kind.tolist()))}
    for anchor, kind, floor in zip(first["anchor"], first["kind"], first["floor"]):
        s = place[int(anchor), int(kind)]
        asked.least[s] = max(asked.least[s], floor)
    chosen = asked.wanted(blocks.low, blocks.high, blocks.least_label, blocks.greatest_label, asked.least).any(axis=0)
    return run(blocks.parts[chosen], False)


def mine_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels inside the window.

    ``rows`` holds vec_id, label and vector, whose components are integers as doubles.  ``window`` is in percent of the
    positive's score, both ends included.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    blocks = Blocks(rows.select("vec_id", "label", "vector"), anchors, block_rows, part_rows)
    path, number = shared_path(spark, "negatives"), 0
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{path}/round=-1")
    for group in blocks.rounds():
        for listed in blocks.anchors(group):
            if not len(listed):
                continue
            asked = Round(listed, blocks.width)
            n = len(listed)
            asked.look_for(np.arange(n), np.zeros(n, np.int64), np.full(n, NONE + 1), np.full(n, np.iinfo(np.int64).max), positives)
            # of one round: anchors x positives rows
            found = _searched(blocks, asked, positives).toPandas().sort_values(["anchor", "rank"]).reset_index(drop=True)
            low = np.array([-((-window[0] * int(s)) // 100) for s in found["score"]], dtype=object)
            high = np.array([window[1] * int(s) // 100 for s in found["score"]], dtype=object)
            found = found[low <= high] if len(found) else found
            if not len(found):
                continue
            held = lambda x: np.array([max(NONE + 1, min(2**63 - 1, int(v))) for v in x[low <= high]], dtype=np.int64)  # noqa: B023, E731
            asked.look_for(found["anchor"].to_numpy(np.int64), found["rank"].to_numpy(np.int64), held(low), held(high), negatives)
            names = pd.DataFrame({"anchor": found["anchor"].astype("int32"), "kind": found["rank"].astype("int32"), "anchor_id": asked.ids[found["anchor"].to_numpy(np.int64)], "positive_id": found["vec_id"], "positive_score": found["score"]})
            named = F.broadcast(spark.createDataFrame(names))  # at most a round's anchors times the positives
            mined = _searched(blocks, asked, negatives).join(named, ["anchor", "kind"])
            mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/round={number}")
            number += 1
    return spark.read.schema(schema).parquet(path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
