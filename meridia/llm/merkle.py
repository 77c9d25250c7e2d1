"""Merkle manifest of a dataset: leaves, a tree for each source, a tree over the sources, and proofs.

Positions come from a range-partitioned order, so no task ranks a whole source.
Node digests are events.  A task keeps one partial parent for each parent it has
heard of, with the digests of the children seen so far; the number of children
due follows from the parent's place and the size of its tree.  Once it is met
the parent's digest is the next event, and so on up.  What stays incomplete at
the end of a partition is its frontier: those children, few as partitions are
runs of leaves, are reshuffled by the ancestor ``LEVELS`` levels up and combined
again, until each ancestor is complete; then the next ``LEVELS`` levels follow.

Proofs run the other way.  Every node learns its ancestor's proof by a reverse
link (node to the ancestor that closed its round) and puts its own way up to
that ancestor before it, round by round down to the leaves.

A proof is text: levels from the leaf up, separated by ``/``, each the sibling
digests from left to right with ``*`` in the node's own place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, discard, free_names, shuffle_parts, small_side, staged

ARITY = 3
#: Levels of the tree that one round of combining covers: at most ``ARITY ** LEVELS`` events meet under an ancestor.
LEVELS = 8


def field_text(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def digest(*inputs: str) -> str:
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def width_at(size: int, level: int) -> int:
    """Nodes of a level of a tree of ``size`` leaves."""
    for _ in range(level):
        size = -(-size // ARITY)
    return size


def placed(df: DataFrame, *order: str, position: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of some columns (nulls first, text bytewise); ties are in any order.

    Rows are dealt into ranges of the order and numbered within them; ranges'
    row counts, one for each, give the first place of a range.  A number of
    its own breaks ties, so equal rows may fill several ranges.
    """
    row, held = free_names(df, "row", "held")
    numbered = staged(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    keys = [F.asc_nulls_first(c) for c in (*order, row)]
    ranged = numbered.repartitionByRange(shuffle_parts(df.sparkSession), *keys).sortWithinPartitions(*keys).drop(row)
    ranged = staged(ranged.withColumn(held, F.monotonically_increasing_id()), "ranged")
    discard(numbered)
    part = F.shiftright(F.col(held), 33)
    counts = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select(F.col("part").alias(row), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias(position))
    found = ranged.join(F.broadcast(firsts), part == F.col(row))  # a row for each range
    return found.select(*df.columns, (F.col(position) + F.col(held).bitwiseAND((1 << 33) - 1)).alias(position))


def climb(nodes: DataFrame, top: int) -> DataFrame:
    """Events ``tree, size, level, place, digest`` combined up to level ``top`` or their tree's root, task by task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple, dict[int, str]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            done: list[tuple] = []
            for tree, size, level, place, value in arrow_rows(batch, *names):
                while level < top and width_at(size, level) > 1:
                    parent, slot = divmod(place, ARITY)
                    held = partial.setdefault((tree, size, level, parent), {})
                    held[slot] = value
                    if len(held) < min(ARITY, width_at(size, level) - ARITY * parent):
                        break
                    del partial[tree, size, level, parent]
                    level, place, value = level + 1, parent, digest(*(held[s] for s in range(len(held))))
                else:
                    done.append((tree, size, level, place, value))
            if done:
                yield out(done)
        frontier = [(tree, size, level, ARITY * parent + slot, value) for (tree, size, level, parent), held in partial.items() for slot, value in held.items()]
        if frontier:
            yield out(frontier)

    names = ["tree", "size", "level", "place", "digest"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return nodes.select(*names).mapInArrow(work, "tree long, size long, level int, place long, digest string")


def rounds_up(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The events each round starts from, all of one level: leaves, then nodes ``levels`` higher, at last roots only.

    ``leaves`` is ``tree, size, place, digest``.
    """
    nodes = leaves.withColumn("level", F.lit(0))
    rounds = [nodes]
    longest = leaves.agg(F.max("size")).first()[0] or 0
    for top in range(levels, 10_000, levels):
        if width_at(longest, top - levels) <= 1:
            return rounds
        first = climb(nodes, top)
        ancestor = F.floor(F.col("place") / F.pow(F.lit(float(ARITY)), F.lit(top) - F.col("level")))
        again = first.repartition(shuffle_parts(leaves.sparkSession), "tree", ancestor)
        nodes = staged(climb(again, top), "nodes")
        rounds.append(nodes)
    return rounds


def _block_proofs(block: list[tuple[int, str]], size: int, level: int, above: str | None, levels: int) -> list[str]:
    """Proofs of the nodes of one block: all of a tree's nodes of a level that share the ancestor ``levels`` higher."""
    heights, places, values = [], [p for p, _ in block], [v for _, v in block]
    for step in range(levels):
        if width_at(size, level + step) <= 1:
            break
        first = places[0] - places[0] % ARITY
        runs = [values[i : i + ARITY] for i in range(0, len(values), ARITY)]
        heights.append((first, runs))
        places, values = [first // ARITY + i for i in range(len(runs))], [digest(*r) for r in runs]
    proofs = [above or ""] * len(values)
    for _, runs in reversed(heights):
        made = []
        for run, up in zip(runs, proofs):
            for i in range(len(run)):
                own = "".join("*" if i == j else v for j, v in enumerate(run))
                made.append(f"{own}/{up}" if up else own)
        proofs = made
    return proofs


def prove(nodes: DataFrame, above: DataFrame, level: int, levels: int, *others: str) -> DataFrame:
    """``nodes`` (all of one level) with ``proof``, given ``above``: ``tree, block, proof`` of their ancestors ``levels`` higher or roots."""
    block = F.floor(F.col("place") / float(ARITY**levels)).cast("long")
    columns = ["tree", "size", "place", "digest", *others]
    rows = nodes.select(*columns, block.alias("block"), F.lit(None).cast("string").alias("above"), F.lit(1).alias("side"))
    for c in rows.columns:
        if c not in above.columns:
            above = above.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    above = above.withColumn("above", F.col("proof")).withColumn("side", F.lit(0)).select(*rows.columns)
    met = rows.unionByName(above).repartition(shuffle_parts(nodes.sparkSession), "tree", "block")
    met = met.sortWithinPartitions("tree", "block", "side", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, up, held = None, None, []

        def out() -> pa.RecordBatch:
            proofs = _block_proofs([(r[2], r[3]) for r in held], held[0][1], level, up, levels)
            cells = [*zip(*held), proofs]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

        for batch in batches:
            for own, text, side, *row in arrow_rows(batch, "block", "above", "side", *columns):
                if (row[0], own) != now:
                    if held:
                        yield out()
                    now, up, held = (row[0], own), None, []
                if side:
                    held.append(row)
                else:
                    up = text
        if held:
            yield out()

    names = [*columns, "proof"]
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("proof", T.StringType())])
    arrow = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BooleanType: pa.bool_()}
    types = [arrow[type(f.dataType)] for f in schema.fields]
    return met.mapInArrow(work, schema)


def proofs_down(rounds: list[DataFrame], roots: DataFrame, levels: int, *others: str) -> DataFrame:
    """The first round's events with their ``proof``; ``roots`` is ``tree, block, proof``, what stands above a tree's root."""
    above = roots
    for k in range(len(rounds) - 1, -1, -1):
        if k == len(rounds) - 1 and k > 0:
            continue  # roots only
        made = prove(rounds[k], above, k * levels, levels, *(others if k == 0 else ()))
        if k:
            # A smaller tree's root is in every later round, too: its proof is what stands above, passed on.
            above = staged(made.select("tree", F.col("place").alias("block"), "proof"), "above")
    return made


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings."""
    return F.sha2(F.translate(proof, "*/", ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    up = F.aggregate(F.split(proof, "/"), leaf, lambda held, level: F.sha2(F.replace(level, F.lit("*"), held), 256))
    return F.when(proof == "", leaf).otherwise(up)


def dataset_manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), checked: Column | None = None, levels: int = LEVELS
) -> DataFrame:
    """``doc_id, source, leaf, checked, subroot, root, proof`` for every row; nothing is written in the text's order.

    A leaf is the digest of ``columns``.  Per source, leaves stand in the order
    of ids, null ids first; a null source is a source of its own and comes
    first among the subroots.  Rows of one id stand in the order of their
    leaves, and equal rows are interchangeable.  ``checked`` is a leaf's digest
    as read again (``leaf`` itself unless given), to be folded up with
    ``proof``.  An empty table gives an empty result.
    """
    leaf = leaf_digest(*[docs[c] for c in columns])
    leaves = docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), leaf.alias("leaf"), (leaf if checked is None else checked).alias("checked"))
    ranked = staged(placed(leaves, "source", "doc_id", "leaf", position="at"), "leaves")
    sources = staged(placed(ranked.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size")), "first", position="tree"), "sources")

    # The tree of a source is named by its place among the sources.
    named = ranked.join(small_side(sources.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
    named = staged(named.select("tree", "size", (F.col("at") - F.col("first")).alias("place"), F.col("leaf").alias("digest"), "doc_id", "source", "checked"), "named")
    up = rounds_up(named, levels)
    tops = staged(up[-1].select("tree", F.col("digest").alias("subroot")), "tops") if len(up) > 1 else named.select("tree", F.col("digest").alias("subroot"))

    count = sources.count()
    heads = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.col("tree").alias("place"), F.col("subroot").alias("digest"))
    over = rounds_up(heads, levels)
    root = over[-1].select("digest").first()
    root = root["digest"] if root else None
    nothing = heads.limit(0).select("tree", F.lit(0).cast("long").alias("block"), F.lit("").alias("proof"))
    roots = staged(proofs_down(over, nothing, levels).select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("block"), "proof"), "roots")

    proven = proofs_down(up, roots, levels, "doc_id", "source", "checked")
    subroots = tops.withColumnRenamed("tree", "t")
    found = proven.join(small_side(subroots), F.col("tree") == F.col("t"))
    for done in (ranked, sources):
        discard(done)
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "checked", "subroot", F.lit(root).cast("string").alias("root"), "proof")


def tampered_leaf(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The leaf of a row whose text has lost its line feeds where 2 divides the crc32 of its decimal id, else its own; a null id is left alone."""
    hit = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace(docs[text_col], F.lit("\n"), F.lit(""))).otherwise(docs[text_col])
    return leaf_digest(*[text if c == text_col else docs[c] for c in columns])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row, after tampering as ``tampered_leaf`` does."""
    manifest = dataset_manifest(docs, checked=tampered_leaf(docs))
    found = manifest.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("checked"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
