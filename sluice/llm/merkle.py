"""Merkle manifest of a dataset as a content-addressed DAG.

Every row is a leaf, the digest of its fields.  Per language the leaves stand by doc_id; while several nodes remain, every
``FAN`` consecutive ones become their digest.  What remains is the language's subroot, and the subroots, by language, are reduced in
the same way to the root.  The manifest stores one record for every digest that has children: ``digest -> children``.

Proofs come from descending that DAG.  Requests start at the root and are told apart by the digits of their ranks, most significant first; all
requests with the same digits so far are one row.  At every level the record of the current digest is looked up by the digest itself,
the children that the digit does not select are collected as a path segment, and the descent goes on with the selected one.
Reversed, the segments are the proof from the leaf up; folding a leaf through them gives the root again.

Ranks inside a language are made without sorting a language in one task: rows are dealt by ranges of (language, doc_id,
leaf), counted per range, and ranked inside their range.  A level is grouped by its parent, at most ``FAN`` rows each.  Everything
is DataFrame code.

A null lang is a language of its own and comes first; a null doc_id comes before all others; rows with equal doc_id stand by their leaf
digest (equal rows are interchangeable).  A null field counts as ``-``.  A single row is its own subroot and root, with an empty proof.
An empty table gives an empty result.  Only doc_id, source, lang, n_chars and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import stored

BITS = 3
FAN = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "array<struct<before:string,after:string>>"


@dataclass
class Manifest:
    """``leaves``: (tree, rank, height, doc_id, leaf, folded); ``trees``: (tree, number, height, digest), one row per language;
    ``levels[k - 1]`` and ``top[k - 1]``: records (digest, children) of nodes k levels above the leaves and above the subroots;
    ``root``: one row (digest, height)."""

    leaves: DataFrame
    trees: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: DataFrame


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.lower(text)  # the same where all code points are ASCII
    return F.when(F.char_length(text) == F.octet_length(text), plain) \
        .otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def leaf_rows(docs: DataFrame, tampered: Column) -> DataFrame:
    """tree (a non-null name that sorts like lang), doc_id, leaf, and folded: the leaf of the row with A-Z lower-cased where ``tampered``."""
    rows = docs.select(*[F.col(c) for c in FIELDS])
    head = [field(F.col(c)) for c in FIELDS[:-1]]
    text = F.col("text").cast("string")
    return rows.select(F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                       digest(*head, field(text)).alias("leaf"), F.when(tampered, digest(*head, field(lower_ascii(text)))).alias("folded"))


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with their rank (from 0) in their group by ``order``, nulls first, and the group's size ``members``."""
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = stored(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(F.col(group), *by, F.col("tie"))
                   .drop("tie").withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    parts = Window.partitionBy(group)
    base = counts.select(group, "part", (F.sum("n").over(parts.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(parts).alias("members"))
    inside = F.row_number().over(Window.partitionBy(group, "part").orderBy(*by)) - 1
    return dealt.withColumn("inside", inside).join(base, [group, "part"]) \
        .withColumn("rank", (F.col("base") + F.col("inside")).cast("long")).drop("part", "base", "inside")


def height_of(members: Column) -> Column:
    """Levels above the leaves: how often the number of nodes must be divided by ``FAN`` until one remains."""
    return sum(((members > F.lit(FAN ** k)).cast("int") for k in range(21)), F.lit(0))


def raised(nodes: DataFrame) -> DataFrame:
    """The parents of nodes (tree, rank, height, digest) of one level, with their children in order."""
    run = F.array_sort(F.collect_list(F.struct("rank", "digest")))
    return nodes.groupBy("tree", "height", F.shiftright("rank", BITS).alias("parent")).agg(F.transform(run, lambda c: c["digest"]).alias("children")) \
        .select("tree", "height", F.col("parent").alias("rank"), F.sha2(F.array_join("children", "").cast("binary"), 256).alias("digest"), "children")


def reduced(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """What remains of every tree (tree, height, digest), and the stored records of every level."""
    most = nodes.agg(F.max("height")).first()[0] or 0
    levels, left = [], [nodes.where("height = 0").select("tree", "height", "digest")]
    for k in range(1, most + 1):
        nodes = stored(raised(nodes.where(F.col("height") >= k)), f"{name}-{k}")
        levels.append(nodes.select("digest", "children"))
        left.append(nodes.where(F.col("height") == k).select("tree", "height", "digest"))
    roots = left[0]
    for more in left[1:]:
        roots = roots.unionByName(more)
    return roots, levels


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of ``docs``; ``tampered`` marks rows for which ``leaves`` also has the leaf of a changed row."""
    rows = stored(leaf_rows(docs, F.lit(False) if tampered is None else tampered), "leaves")
    leaves = stored(ranked(rows, "tree", "doc_id", "leaf").withColumn("height", height_of(F.col("members"))).drop("members"), "ranked_leaves")
    roots, levels = reduced(leaves.select("tree", "rank", "height", F.col("leaf").alias("digest")), "records")
    trees = stored(roots, "subroots")  # a row per language
    numbered = stored(ranked(trees.withColumn("all", F.lit("root")), "all", "tree"), "subroots")
    above = numbered.select(F.col("all").alias("tree"), "rank", height_of(F.col("members")).alias("height"), "digest")
    root, top = reduced(above, "top")
    return Manifest(leaves, numbered.select("tree", F.col("rank").alias("number"), "height", "digest"), levels, top, root.select("digest", "height"))


def looked_up(at: DataFrame, records: DataFrame) -> DataFrame:
    """Rows with the children of their digest, found by the digest."""
    return at.join(records.dropDuplicates(["digest"]), "digest")


def segment(children: Column, digit: Column) -> Column:
    """The children before and after the selected one, as one array of a segment."""
    joined = lambda start, n: F.array_join(F.slice(children, start, n), "")
    return F.array(F.struct(joined(F.lit(1), digit).alias("before"), joined(digit + 2, F.size(children) - digit - 1).alias("after")))


def selected(at: DataFrame) -> DataFrame:
    """One step down: every child with its digit added to the rank and its siblings to the path."""
    return at.select("*", F.posexplode("children").alias("digit", "child")).select(
        "tree", ((F.col("rank") * FAN) + F.col("digit")).alias("rank"), "height", F.col("child").alias("digest"),
        F.concat("path", segment(F.col("children"), F.col("digit"))).alias("path"))


def descend(start: DataFrame, levels: list[DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """From roots (tree, rank 0, height, digest, path) to the nodes one level above the leaves, with their children.

    ``wanted`` (tree, rank of a leaf, height) leaves only digits that some request has.
    """
    at = None
    for k in range(len(levels), 0, -1):
        enter = start.where(F.col("height") == k)
        at = enter if at is None else enter.unionByName(selected(at))
        if wanted is not None:
            digits = wanted.where(F.col("height") >= k).select("tree", F.shiftright("rank", BITS * k).alias("rank")).distinct()
            at = at.join(digits, ["tree", "rank"], "left_semi")
        at = looked_up(at, levels[k - 1])
    return at


def proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves (all, or those of the requests (tree, rank)) with subroot, root and path: the segments from the leaf up to the root."""
    leaves = manifest.leaves
    if requests is not None:
        leaves = leaves.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi")
    columns = leaves.columns
    no_path = F.array().cast(NO_PATH).alias("path")
    entry = manifest.root.select(F.lit("root").alias("tree"), F.lit(0).cast("long").alias("rank"), "height", "digest", no_path)
    subroots = entry.where("height = 0")  # a single language is the root
    if manifest.top:
        subroots = subroots.unionByName(selected(descend(entry, manifest.top)))
    root = manifest.root.first()  # one digest
    top = manifest.trees.join(subroots.select(F.col("rank").alias("number"), "path"), "number")
    top = stored(top.select("tree", F.lit(0).cast("long").alias("rank"), "height", "digest", "path", F.col("digest").alias("subroot"),
                            F.lit(root and root["digest"]).cast("string").alias("root")), "paths")
    known = top.select("tree", "subroot", "root")
    alone = leaves.where("height = 0").join(top.select("tree", "path"), "tree").select(*columns, "path")
    found = alone
    if manifest.levels:
        nodes = descend(top.drop("subroot", "root"), manifest.levels, None if requests is None else leaves.select("tree", "rank", "height"))
        parents = nodes.select("tree", F.col("rank").alias("parent"), "path", "children")
        digit = F.col("rank").bitwiseAND(FAN - 1).cast("int")
        below = leaves.where("height > 0").withColumn("parent", F.shiftright("rank", BITS)).join(parents, ["tree", "parent"])
        found = found.unionByName(below.select(*columns, F.concat("path", segment(F.col("children"), digit)).alias("path")))
    return found.join(known, "tree").withColumn("path", F.reverse("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """Per row: its leaf, subroot, root, the digest of its proof, the root recomputed from the (changed) leaf, and whether it is the same."""
    shown = proofs(build(docs, tampered)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        fold(F.coalesce("folded", "leaf"), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
