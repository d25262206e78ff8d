"""A Merkle manifest of a dataset: one digest per row, per group and for the whole, with inclusion proofs.

A row's leaf is the SHA-256 of its fields, each with its length.  The leaves of a group, in order, are cut
into runs of ``FANOUT``; a run's digests, concatenated, are hashed into its parent, and so on until one node
is left, the group's subroot.  The subroots, in order, give the root in the same way.

*Slot pivot.*  One aggregation per level spreads the children of each parent into ``FANOUT`` columns, s0 to
s7, by conditional aggregates.  All columns in a row hash to the parent; the columns without a child's own
are its siblings.  Rows of a level are thus as many as its parents, an eighth of the level below.

Proofs are made from the root down: a parent's row gets the siblings on its own way to the root, once for
all eight children, and is spread to the children at the very end, in the projection that hashes the proof
and folds the leaf.  No proof is shuffled for each leaf.

Defined results: a null field is written ``-`` and so differs from the empty text; a null group is one of its
own and comes first; rows of one id follow one another by their leaves, a null id comes first; repeated rows
are leaves of their own; a group of one leaf has that leaf as subroot; the subroot of a single group is the
root; an empty table gives no rows.  Columns that are not digested may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.frames import stored
from talkgauge.llm.ranks import placed

FANOUT = 8
SLOTS = [f"s{k}" for k in range(FANOUT)]
STEP = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _joined(slots: list[str]) -> Column:
    return F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in slots]) if slots else F.lit("")


def _up(place: str) -> Column:
    return F.expr(f"{place} div {FANOUT}")


def _pivoted(nodes: DataFrame) -> DataFrame:
    """One row per parent of nodes (tree, place, digest, size): its children in columns, its own digest and the parents' number."""
    slot = F.pmod(F.col("place"), F.lit(FANOUT))
    spread = [F.max(F.when(slot == k, F.col("digest"))).alias(c) for k, c in enumerate(SLOTS)]
    parents = nodes.groupBy("tree", _up("place").alias("place")).agg(*spread, F.expr(f"(max(size) + {FANOUT - 1}) div {FANOUT}").alias("size"))
    return parents.select("*", F.sha2(_joined(SLOTS).cast("binary"), 256).alias("digest"))


def _siblings(place: Column) -> Column:
    """Left and right siblings of the child at a place, from its parent's columns: all slots but its own."""
    slot, found = F.pmod(place, F.lit(FANOUT)), None
    for k in range(FANOUT):
        step = F.struct(_joined(SLOTS[:k]).alias("left"), _joined(SLOTS[k + 1 :]).alias("right"))
        found = F.when(slot == k, step) if found is None else found.when(slot == k, step)
    return found


def levels(leaves: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels of trees over leaves (tree, place, digest, size), lowest first, and the tops (tree, digest).

    A tree ends at the level where it has one node; what is left of it is its top.
    """
    nodes, found = leaves.select("tree", "place", "digest", "size"), []
    tops = nodes.where("size = 1")
    left = leaves.agg(F.max("size")).first()[0] or 0
    while left > 1:
        nodes = stored(_pivoted(nodes.where("size > 1")), f"{label}-level")
        found.append(nodes)
        tops = tops.unionByName(nodes.where("size = 1").select(tops.columns))
        left = -(-left // FANOUT)
    return found, stored(tops.select("tree", "digest"), f"{label}-tops")


def ways(pivoted: list[DataFrame], above: DataFrame, label: str) -> DataFrame:
    """The lowest level's rows with ``way``, the siblings of each step from the row's own node to the root.

    ``above`` (tree, way) has the steps from each tree's top on; a tree ends at the level where it has one node.
    """
    known = None
    for level in reversed(pivoted):
        nodes = level.select("tree", "place", "size", *SLOTS)
        found = nodes.where("size = 1").join(above, "tree").select("tree", "place", "way", *SLOTS)
        if known is not None:
            found = found.unionByName(_lengthened(nodes.where("size > 1"), known, SLOTS))
        known = stored(found, f"{label}-ways")
    return known


def _lengthened(children: DataFrame, parents: DataFrame, keep: list[str]) -> DataFrame:
    """Children (tree, place, ...) of pivoted parents with the way through them: their siblings, then the parent's way."""
    own = children.select("tree", "place", *[F.col(c).alias(f"_{c}") for c in keep])
    over = parents.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "way", *SLOTS)
    way = F.concat(F.array(_siblings(F.col("place"))), F.col("way"))
    joined = own.join(over, (F.col("tree") == F.col("_tree")) & (_up("place") == F.col("_place")))
    return joined.select("tree", "place", way.alias("way"), *[F.col(f"_{c}").alias(c) for c in keep])


def fold(leaf: Column, way: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(way, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, changed: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and what a changed leaf folds to.

    ``leaf`` and ``changed`` are digests made of the columns of ``rows``; where ``changed`` is null the leaf
    itself is folded.  Returns the columns ``order`` and ``group`` of each row with leaf, subroot, root, way
    (the siblings, left and right, of each step), proof_sha256, folded_root and verified.
    """
    own = rows.select(F.col(f"`{group}`").alias("lang"), F.col(f"`{order}`").alias("id"), leaf.alias("digest"), (leaf if changed is None else changed).alias("changed"))
    # groups by a text that sorts as they do: null before all others
    # and stored, since texts would be hashed a second time to find the ranges they are dealt by
    own = stored(own.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))), "manifest-hashed")
    leaves = stored(placed(own, ["tree"], ["id", "digest", "changed"], "manifest"), "manifest-leaves")
    below, subroots = levels(leaves, "manifest")
    ranked = stored(placed(subroots.withColumnRenamed("tree", "named"), [], ["named"], "manifest-groups").withColumn("tree", F.lit("")), "manifest-subroots")
    above, roots = levels(ranked, "manifest-top")
    top = roots.first()  # one digest
    root = F.lit(top["digest"] if top else None).cast("string")
    end = F.array().cast(STEP)
    keep = ["named", "digest"]
    starts = ranked.where("size = 1").select("tree", "place", end.alias("way"), *keep)
    if above:
        starts = _lengthened(ranked, ways(above, roots.select("tree", end.alias("way")), "manifest-top"), keep)
    starts = stored(starts.select(F.col("named").alias("tree"), F.col("digest").alias("subroot"), "way"), "manifest-starts")
    keep = ["id", "lang", "digest", "changed"]
    found = leaves.where("size = 1").join(starts, "tree").select("tree", "place", "way", *keep)
    if below:
        found = found.unionByName(_lengthened(leaves.where("size > 1"), ways(below, starts.select("tree", "way"), "manifest"), keep))
    siblings = F.array_join(F.transform("way", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce("changed", "digest"), F.col("way"))
    proved = found.join(starts.select("tree", "subroot"), "tree").select(
        F.col("id").alias(order), F.col("lang").alias(group), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "way",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(documents: DataFrame) -> DataFrame:
    """The manifest of documents by language; texts whose id's crc32 is divisible by 3 are lower-cased (A-Z) afterwards."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(hit, leaf_of(*columns[:-1], lowered))
    return manifest(documents, "lang", "doc_id", leaf_of(*columns), changed)
