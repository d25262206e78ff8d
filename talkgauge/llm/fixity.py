"""Fixity audit of replicated WARC archives by Merkle trees over records and offset ranges.

Records are leaves.  A node of level 1 covers the records that begin in one range of ``RANGE`` bytes of an
archive, a node of level n + 1 ``FANOUT`` neighbouring ranges of level n, up to one root per archive.  A
node's hash is the SHA-256 of its children, each with its place, in order.  Two replicas are compared from
their roots: only nodes that differ are opened, level by level, down to the records.

Trees are sums of small groups: a node has at most ``FANOUT`` children, or the records that fit a range,
so an archive of any size is built and compared by shuffles of hashes; contents are hashed where they are
read.  All nodes of a replica are one table in the shared folder.

Defined results: a null payload has the hash of the empty one and another length, -1; records are known by
archive and offset; of several records at one place of a replica all count, in the order of their hashes;
an archive that one replica lacks is wholly missing; empty replicas agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.frames import stored

RANGE = 1 << 16
FANOUT = 16
RECORDS_PER_ARCHIVE = 1000


def leaves(records: DataFrame) -> DataFrame:
    """Archive, offset, length and hash of records (archive, offset, payload)."""
    return records.select(
        "archive",
        "offset",
        F.coalesce(F.octet_length("payload").cast("long"), F.lit(-1).cast("long")).alias("length"),
        F.sha2(F.coalesce(F.col("payload"), F.lit("")).cast("binary"), 256).alias("hash"),
    )


def _parents(children: DataFrame, place: Column, level: int) -> DataFrame:
    item = F.concat_ws(":", F.col("place").cast("string"), F.col("length").cast("string"), F.col("hash"))
    joined = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("place", "hash", item.alias("item")))), lambda x: x["item"]))
    own = children.groupBy("archive", place.alias("up")).agg(F.sum("length").alias("length"), F.sha2(joined, 256).alias("hash"))
    return own.select(F.lit(level).alias("level"), "archive", F.col("up").alias("place"), "length", "hash")


def tree(records: DataFrame) -> DataFrame:
    """All nodes (level, archive, place, length, hash) of the trees over leaves (archive, offset, length, hash).

    Level 0 holds the records, their place is the offset.  The last level has place 0 only.
    """
    level_0 = records.select(F.lit(0).alias("level"), "archive", F.col("offset").alias("place"), "length", "hash")
    last = records.agg(F.max("offset")).first()[0] or 0
    below = stored(level_0, "tree")
    parts = [below]
    span, level = RANGE, 0
    while level == 0 or last // (span // FANOUT) > 0:
        level += 1
        below = stored(_parents(below, F.floor(F.col("place") / F.lit(RANGE if level == 1 else FANOUT)).cast("long"), level), "tree")
        parts.append(below)
        span *= FANOUT
    return reduce(DataFrame.unionAll, parts)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records in which two replicas differ, from leaves (archive, offset, length, hash).

    Returns archive, offset, status (``corrupt``, ``missing`` from the right or ``extra`` in it), both
    lengths and both hashes.
    """
    trees = [tree(side) for side in (left, right)]
    top = max((t.agg(F.max("level")).first()[0] or 0) for t in trees)
    opened = None
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level).drop("level") for t in trees)
        if opened is not None:
            up = F.floor(F.col("place") / F.lit(RANGE if level == 0 else FANOUT)).cast("long")
            a, b = (t.withColumn("up", up).join(opened, ["archive", "up"], "left_semi").drop("up") for t in (a, b))
        a, b = (_together(t) for t in (a, b))
        both = a.select("archive", "place", *[F.col(c).alias(f"left_{c}") for c in ("length", "hash")]).join(
            b.select("archive", "place", *[F.col(c).alias(f"right_{c}") for c in ("length", "hash")]), ["archive", "place"], "full"
        )
        differ = both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")) | ~F.col("left_length").eqNullSafe(F.col("right_length")))
        if level:
            opened = stored(differ.select("archive", F.col("place").alias("up")), "opened")
    status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("corrupt")
    return differ.select("archive", F.col("place").alias("offset"), status.alias("status"), "left_length", "right_length", "left_hash", "right_hash")


def _together(nodes: DataFrame) -> DataFrame:
    """One row per place; several records at one place are hashed as one."""
    several = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("hash"))), 256)
    return nodes.groupBy("archive", "place").agg(F.sum("length").alias("length"), F.when(F.count("*") == 1, F.min("hash")).otherwise(several).alias("hash"))


def warc_record(url: Column, html: Column, key: Column) -> Column:
    """A page as the text of one WARC response record, its date left out."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def page_archives(pages: DataFrame, damaged: Column, lost: Column) -> DataFrame:
    """Pages as records of archives in two replicas, the second with damage.

    Equal rows are one record.  Records are dealt to archives by their hash and follow it inside them, so
    that each archive has about ``RECORDS_PER_ARCHIVE`` records whatever the ids.  Columns: archive, offset,
    page_id, copies, length, hash and the second replica's other_length and other_hash, null where lost.
    ``damaged`` overwrites the middle byte of a record by ``#``, or by ``*`` where it is ``#``.
    """
    record = warc_record(F.col("url"), F.col("html"), F.col("page_id"))
    rows = pages.select("page_id", damaged.alias("damaged"), lost.alias("lost"), record.cast("binary").alias("record"))
    length, middle = F.octet_length("record"), F.floor(F.octet_length("record") / 2).cast("int")
    sign = F.when(F.substring("record", middle, F.lit(1)) == F.lit("#").cast("binary"), F.lit("*")).otherwise(F.lit("#")).cast("binary")
    other = F.concat(F.substring("record", F.lit(1), middle - 1), sign, F.substring("record", middle + 1, length))
    hashed = rows.select(
        "page_id", F.sha2("record", 256).alias("hash"), length.cast("long").alias("length"),
        F.when(~F.col("lost"), F.when(F.col("damaged"), F.sha2(other, 256)).otherwise(F.sha2("record", 256))).alias("other_hash"),
        F.when(~F.col("lost"), length.cast("long")).alias("other_length"),
    )
    single = stored(hashed.groupBy("page_id", "hash", "length", "other_hash", "other_length").agg(F.count("*").alias("copies")), "records")
    archives = max(1, -(-single.count() // RECORDS_PER_ARCHIVE))
    number = (F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % archives).alias("archive")
    # a record's offset is the length of all before it; an archive is of bounded size
    return stored(
        single.select(number, "*").selectExpr(
            "archive", "coalesce(sum(length) OVER (PARTITION BY archive ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset",
            "page_id", "copies", "length", "hash", "other_length", "other_hash",
        ), "archives",
    )
