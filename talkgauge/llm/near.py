"""N-gram Jaccard join: documents whose sets of 5-word runs agree to 0.8 or more.

1. Copies of a text collapse to one node before anything else is shuffled.
2. A node's MinHash values are cut into bands; bands and rows are chosen for a target recall at the
   threshold.  Nodes meet on band hashes.  Of each band hash only its smallest node, the *leader*, and
   whether there are others are kept, by an aggregation that combines before the shuffle.
3. Every node joins the groups of its leaders.  Two nodes that share a band hash share its leader, so all
   pairs to verify lie inside groups.  Groups of many texts or of long ones are cut into blocks, bounded in rows
   and in bytes; each pair of blocks is one piece of work of bounded size, in which full sets are intersected as matrix products.  Pairs are never rows:
   a piece of work returns one row per node, with its links and the smallest node it reaches.
   A pair that shares several leaders counts with the smallest.
4. Classes are connected components of what is reached, by smallest labels and pointer jumping.

Words are maximal runs of digits, letters and non-ASCII bytes, A-Z lower-cased; a text of one to four
words has one run, all its words.  Sets hold 64-bit hashes of the runs, nodes are 64-bit hashes of texts.

Defined results: null, empty and wordless texts have no runs, no links and a class of their own; exact
copies are linked; repeated rows count as copies; a null doc_id is never the id of a class unless the
class has no other; a result column replaces one of its name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.frames import fresh, stored, without
from talkgauge.llm.text import batches, shingle_hashes, texts_words

SHINGLE = 5
_BATCH = 2 << 20
_LANE = 1 << 15
_BLOCK = 256
_BLOCK_BYTES = 4 << 20
_TASK_ROWS = 2048
_TASK_BYTES = 32 << 20
_FILTER_BITS = 1 << 23, 1 << 28  # at least and at most: 1 and 32 MB


def choose_bands(threshold: float = 0.8, recall: float = 0.9995, most_hashes: int = 160) -> tuple[int, int]:
    """Bands and rows of each: the most rows whose bands reach the recall at the threshold within the hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall within so many hashes")
    return best


def band_hashes(words: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of the texts that have words, and which texts these are."""
    runs, at = shingle_hashes(words, offsets, SHINGLE)
    has = np.flatnonzero(np.diff(at) > 0)
    factors = np.random.default_rng(5).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.empty((len(has), bands * rows), dtype=np.uint64)
    starts, ends = at[:-1][has], at[1:][has]
    i = 0
    while i < len(has):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _LANE, side="right")))
        part, inner = runs[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        buffer = np.empty_like(part)
        for k, factor in enumerate(factors):
            np.multiply(part, factor, out=buffer)
            least[i:j, k] = np.minimum.reduceat(buffer, inner)
        i = j
    out = np.empty((len(has), bands), dtype=np.uint64)
    for b in range(bands):
        value = np.full(len(has), b + 1, dtype=np.uint64)
        for r in range(rows):
            value = (value ^ least[:, b * rows + r]) * np.uint64(0xD6E8FEB86659FD93)
            value ^= value >> np.uint64(32)
        out[:, b] = value
    return out, has


def _nodes(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per distinct text with words: node, copies, the smallest doc_id and the band hashes."""

    def run(arrivals):
        for part in batches(arrivals, "text", _BATCH):
            hashes, has = band_hashes(*texts_words(part["text"]), bands, rows)
            flat = pa.array(hashes.ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part["node"].combine_chunks().take(pa.array(has)), part["doc_id"].combine_chunks().take(pa.array(has)), lists], ["node", "doc_id", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(run, f"node bigint, doc_id {kind}, bands array<bigint>")
    grouped = signed.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    return stored(grouped, "near-nodes")


def _members(nodes: DataFrame) -> DataFrame:
    """Every (node, leader) of band hashes that several nodes share."""
    met = nodes.select("node", F.explode("bands").alias("band"))
    leaders = met.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last")
    shared = met.join(leaders.select("band", "leader"), "band")
    return stored(shared.select("node", "leader").distinct(), "near-members")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """A filter that every given node passes and, up to some 2^25 nodes, at most an eighth of the others.

    Its size follows the number of nodes up to a bound; beyond that more of the others pass, which costs work only.
    """
    least, most = _FILTER_BITS
    size = min(most, max(least, 1 << int(8 * nodes.count()).bit_length()))
    place = F.pmod(F.col("node"), F.lit(size))
    words = nodes.groupBy((place / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {size}) % 64 AS INT))")).alias("bits"))
    out = np.zeros(size // 64, dtype=np.int64)
    found = words.toArrow()  # at most size / 64 rows of 12 bytes
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out


def _passes(nodes: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for all given nodes and for few others."""
    shared = nodes.sparkSession.sparkContext.broadcast(_bitmap(nodes))

    @F.pandas_udf("boolean")
    def passes(node: pd.Series) -> pd.Series:
        place = np.mod(node.to_numpy(), 64 * len(shared.value))
        return pd.Series(((shared.value[place >> 6] >> (place & 63)) & 1).astype(bool))

    return passes


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sorted set of runs of each wanted node, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(arrivals):
        bits = shared.value
        for part in batches(arrivals, "text", _BATCH):
            node = part["node"].to_numpy()
            place = np.mod(node, 64 * len(bits))
            passing = np.flatnonzero((bits[place >> 6] >> (place & 63)) & 1)
            _, first = np.unique(node[passing], return_index=True)  # copies in one batch
            passing = passing[np.sort(first)]
            kept = part.take(pa.array(passing))
            runs, at = shingle_hashes(*texts_words(kept["text"]), SHINGLE)
            sets = [np.unique(runs[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(node[passing]), pa.array(sets, pa.binary())], ["node", "runs"])

    found = docs.select("node", "text").mapInArrow(run, "node bigint, runs binary").groupBy("node").agg(F.first("runs").alias("runs"))
    return found.join(wanted, "node")


def _matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, a few thousand shared members at a time."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    distinct, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    number = np.cumsum(count > 1) - 1
    owner, column = owner[common], number[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, a), np.searchsorted(column, a + width)
        grid = np.zeros((n, min(width, int(column[-1]) + 1 - a)), dtype=np.float32)
        grid[owner[low:high], column[low:high] - a] = 1
        out += grid @ grid.T
    return out


def _verify(group: pd.DataFrame, leader: int, low: int, high: int, numerator: int, denominator: int) -> pd.DataFrame:
    """Links of the nodes of one pair of blocks, and the smallest node that each reaches in it."""
    node, block = group["node"].to_numpy(), group["block"].to_numpy()
    sets = [np.frombuffer(r, dtype=np.uint64) for r in group["runs"]]
    size = np.array([len(s) for s in sets])
    inner = _matrix(sets).astype(np.int64)
    near = denominator * inner >= numerator * (size[:, None] + size[None, :] - inner)
    np.fill_diagonal(near, False)
    label = node.copy()
    while near.any():
        reached = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (reached == label).all():
            break
        label = reached
    if low != high:
        near &= block[:, None] != block[None, :]  # pairs inside a block are counted by the block's own work
    leads = group["leaders"].tolist()
    if max(map(len, leads)) > 1:
        width = max(map(len, leads))
        grid = np.array([list(x) + [leader] * (width - len(x)) for x in leads], dtype=np.int64)
        left, right = np.nonzero(near)
        for a in range(0, len(left), 4096):
            i, j = left[a : a + 4096], right[a : a + 4096]
            same = (grid[i][:, :, None] == grid[j][:, None, :]) & (grid[i] < leader)[:, :, None]
            near[i, j] = ~same.any(axis=(1, 2))
    copies = group["copies"].to_numpy()
    return pd.DataFrame({"node": node, "texts": near.sum(axis=1), "docs": near @ copies, "root": label})


def _links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Per node and piece of work: links to texts and to documents, and the smallest node reached."""
    numerator, denominator = round(threshold * 1000), 1000
    known = members.groupBy("node").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    rich = stored(sets.join(known, "node"), "near-sets")
    weighed = members.join(rich.select("node", F.octet_length("runs").alias("bytes")), "node")
    blocks = F.greatest(F.ceil(F.count("*") / _BLOCK), F.ceil(F.sum("bytes") / _BLOCK_BYTES))
    placed = weighed.join(weighed.groupBy("leader").agg(blocks.alias("blocks")), "leader").withColumn("block", F.pmod(F.xxhash64("node", "leader"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    work = placed.select("node", "leader", "block", "bytes", other)
    work = stored(work.select("node", "leader", "block", "bytes", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")), "near-work")
    n, size = work.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, -(-n // _TASK_ROWS), -(-size // _TASK_BYTES))
    task = F.pmod(F.xxhash64("leader", "low", "high"), F.lit(tasks))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [_verify(g, *key, numerator, denominator) for key, g in rows.groupby(["leader", "low", "high"], sort=False) if len(g) > 1]
        return pd.concat(parts) if parts else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "texts", "docs", "root")})

    full = work.drop("bytes").join(rich, "node").withColumn("task", task)
    return full.groupBy("task").applyInPandas(run, "node bigint, texts bigint, docs bigint, root bigint")


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component, for the nodes of edges (a, b)."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        told = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("label"))
        seen = labels.select("node", "label", F.col("label").alias("old")).unionByName(told.select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("old")))
        least = stored(seen.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")), "labels")
        if not least.where("label <> old").limit(1).count():
            return least.select("node", "label")
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = stored(least.join(jump, "label").select("node", F.least("label", "further").alias("label")), "labels")


def near_duplicates(docs: DataFrame, text: str = "text", threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """Add per document: ``class_id`` (the smallest doc_id of its class), ``n_links`` (other documents that agree
    with it to the threshold, copies included), ``linked_texts`` (other texts among them) and ``class_node``.

    ``class_node`` is null for documents that are alone.  Documents need a column doc_id.
    """
    results = ["class_id", "n_links", "linked_texts", "class_node"]
    bands, rows = choose_bands(threshold, recall)
    source = docs.select(F.col("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    source = source.withColumn("node", F.xxhash64("text"))
    nodes = _nodes(source, bands, rows)
    members = _members(nodes)
    wanted = members.select("node").distinct().join(nodes.select("node", "copies"), "node")
    links = stored(_links(members, _sets(source, wanted), threshold), "near-links")
    labels = components(links.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    counts = links.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("linked"))
    joined = nodes.select("node", "copies", "first_id").join(labels, "node", "left").where("copies > 1 or label is not null")
    joined = joined.withColumn("label", F.coalesce("label", "node"))
    classes = joined.groupBy("label").agg(F.min("first_id").alias("class"))
    found = joined.join(classes, "label").join(counts, "node", "left")
    found = stored(
        found.select("node", "label", "class", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), F.coalesce("texts", F.lit(0)).cast("long").alias("texts")),
        "near-classes",
    )
    key, node, label, cls, n, texts = fresh([*docs.columns, *results], "_node", "_n", "_label", "_class", "_links", "_texts")
    own = without(docs, results)
    base = own.withColumn(key, F.when(F.col(f"`{text}`").isNotNull(), F.xxhash64(F.col(f"`{text}`"))))
    # rows that are surely alone skip the join, so that their texts are not shuffled
    maybe = F.col(key).isNotNull() & _passes(found)(F.coalesce(F.col(key), F.lit(0)))
    found = found.toDF(node, label, cls, n, texts)
    joined = base.where(maybe).join(found.hint("merge"), F.col(key) == F.col(node), "left")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields]
    out = joined.unionByName(base.where(~maybe).select("*", *nothing))
    kept = [F.col(f"`{c}`") for c in own.columns]
    return out.select(
        *kept,
        F.when(F.col(label).isNull(), F.col("doc_id")).otherwise(F.col(cls)).alias("class_id"),
        F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col(texts), F.lit(0)).cast("long").alias("linked_texts"),
        F.col(label).alias("class_node"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id, with its own columns only."""
    (row,) = fresh(docs.columns, "_row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "doc_id", "text")
    found = near_duplicates(packed)
    alone = found.where(F.col("class_node").isNull())
    first = found.where(F.col("class_node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).dropDuplicates(["class_node"])
    return alone.unionByName(first).select(f"{row}.*")
