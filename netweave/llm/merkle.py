"""A Merkle manifest of a table, built and verified in Pregel-style supersteps.

Rows are leaves.  Every node sends its digest to its parent; a parent that has
its whole run of children hashes them and is a node of the next level.  A tree
per source ends in a subroot, and the subroots are the leaves of one more tree.
Then messages go down: each parent hands every child the digests of its siblings
and the path above, until each leaf can fold its own digest up to a root.

A superstep takes ``STEPS`` levels: the nodes of a block of ``FAN ** STEPS`` stand
together, so messages between them need no shuffle, and a path travels down once
for each block.  A block's key holds its position, so one source with most of
the rows is spread like any other.  Positions come from one range partitioning;
the driver sees two sources and two counts for each partition of it, and the
root.  Each superstep's result is written to the shared folder.

Defined results: a null value is the field ``-``; leaves of one source stand by
doc_id, null first, of one doc_id by leaf digest, and repeated rows are leaves of
their own; rows without a source are a source of their own, first; a null doc_id
is never tampered with; extra columns are ignored; very long texts are hashed
whole; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import Scratch, ascii_lower

#: Consecutive nodes that one parent hashes, levels of a superstep, and the nodes that stand together in it.
FAN, STEPS = 16, 3
BLOCK = FAN**STEPS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(children: list[bytes]) -> bytes:
    """The digest of a run: over the hex text of its children's digests."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def leaf(columns: list[Column]) -> Column:
    """The hex digest of a row: each field ``-`` if null, else its length in bytes, ``:`` and its value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)).cast("binary"), 256)


def _place(key) -> int:
    return zlib.crc32(repr(key).encode())


def _number(part: int, rows: Iterator) -> Iterator[tuple]:
    """Rows sorted by source -> (part, row, position in its source within the part); last, what the part begins and ends with."""
    at, seen, first, source = 0, False, None, None
    for row in rows:
        if seen and row[0] != source:
            first = first or (source, at)
            at = 0
        seen, source = True, row[0]
        yield part, tuple(row), at
        at += 1
    if seen:
        yield part, None, (first or (source, at), (source, at), first is None)


def _carried(parts: list[tuple]) -> dict[int, tuple]:
    """part -> (its first source, how many rows of that source stand in earlier parts)."""
    out, source, n, begun = {}, None, 0, False
    for part, _, (first, last, single) in sorted(parts, key=lambda p: p[0]):
        before = n if begun and first[0] == source else 0
        out[part] = (first[0], before)
        source, n, begun = last[0], last[1] + (before if single else 0), True
    return out


def _whole(index: int, nodes: list) -> bool:
    """Whether a block is all that remains of its tree: the first one, not full."""
    return index == 0 and len(nodes) < BLOCK


def _layers(index: int, nodes: list[bytes]) -> list[list[bytes]]:
    """The digests of a block level by level: ``STEPS`` levels up to its one parent, or as far as the top of a whole tree."""
    layers = [nodes]
    while len(layers) <= STEPS and not (_whole(index, nodes) and len(layers[-1]) == 1):
        layers.append([digest(layers[-1][i : i + FAN]) for i in range(0, len(layers[-1]), FAN)])
    return layers


def _completed(block: tuple) -> tuple:
    """A block whose nodes have all sent their digests: the nodes in order, and the digest that they end in."""
    (tree, index), sent = block
    nodes = [n[1:] for n in sorted(sent, key=lambda n: n[0])]
    return (tree, index), (nodes, _layers(index, [n[0] for n in nodes])[-1][0])


def _paths(index: int, nodes: list[tuple], above: list[tuple]) -> Iterator[list[tuple]]:
    """For each node of a block its path to the root: (place, siblings) by level."""
    layers = _layers(index, [n[0] for n in nodes])
    for i in range(len(nodes)):
        path = []
        for height, layer in enumerate(layers[:-1]):
            at = i // FAN**height
            first = at - at % FAN
            path.append((at % FAN, layer[first:at] + layer[at + 1 : first + FAN]))
        yield path + above


def _up(nodes: RDD, keep: Callable[[RDD, str], RDD], parts: int, label: str) -> tuple[list[RDD], RDD]:
    """The blocks of each superstep, ((tree, index), (nodes, digest)), and the tops as (tree, superstep, digest); nodes are (tree, position, digest, payload)."""
    steps: list[RDD] = []
    while True:
        grown = nodes.context.accumulator(0)

        def forward(block: tuple, grown=grown) -> tuple:
            if not _whole(block[0][1], block[1][0]):
                grown.add(1)
            return block

        sent = nodes.map(lambda n: ((n[0], n[1] // BLOCK), (n[1] % BLOCK, n[2], n[3])))
        steps.append(keep(sent.groupByKey(max(1, parts // BLOCK ** len(steps)), _place).map(_completed).map(forward), f"{label}{len(steps)}"))
        if not grown.value:  # every tree has ended; counts of a task that ran twice only add to what is not zero
            break
        nodes = steps[-1].filter(lambda b: not _whole(b[0][1], b[1][0])).map(lambda b: (*b[0], b[1][1], None))
    tops = [blocks.filter(lambda b: _whole(b[0][1], b[1][0])).map(lambda b, k=k: (b[0][0], k, b[1][1])) for k, blocks in enumerate(steps)]
    return steps, keep(nodes.context.union(tops).coalesce(max(1, parts // FAN)), f"{label}-tops")


def _down(steps: list[RDD], tops: RDD, parts: int) -> RDD:
    """The blocks of the first superstep with what came from above: (key, (nodes, (path of the block's last digest, note of the tree))).

    ``tops``: (tree, superstep in which it ends, path, note).
    """
    paths = None
    for k in range(len(steps) - 1, -1, -1):
        own = tops.filter(lambda t, k=k: t[1] == k).map(lambda t: ((t[0], 0), (t[2], t[3])))
        paths = own if paths is None else paths.union(own)
        met = steps[k].mapValues(lambda b: b[0]).join(paths, max(1, parts // BLOCK**k))
        paths = met.flatMap(_hand_down)
    return met


def _hand_down(met: tuple) -> Iterator[tuple]:
    (tree, index), (nodes, (above, note)) = met
    for i, path in enumerate(_paths(index, nodes, above)):
        yield (tree, index * BLOCK + i), (path, note)


def _fold(own: bytes, path: list[tuple]) -> bytes:
    for at, siblings in path:
        own = digest([*siblings[:at], own, *siblings[at:]])
    return own


def _verify(root: bytes) -> Callable[[tuple], Iterator[tuple]]:
    def run(met: tuple) -> Iterator[tuple]:
        (_, index), (nodes, (above, subroot)) = met
        for (own, (doc_id, shown)), path in zip(nodes, _paths(index, nodes, above)):
            folded = _fold(shown or own, path)
            proof = digest([s for _, siblings in path for s in siblings])
            yield doc_id, own.hex(), subroot.hex(), root.hex(), proof.hex(), folded.hex(), folded == root

    return run


def manifest(docs: DataFrame, id_col: str = "doc_id", source: str = "source", fields: tuple[str, ...] = FIELDS, shown: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``shown`` is the digest (hex) that a row presents to be verified, where it
    is not null; else a row presents its leaf.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    scratch = Scratch(spark, "merkle")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def keep(rdd: RDD, label: str) -> RDD:
        path = f"{scratch.root}/{label}"
        rdd.saveAsPickleFile(path)
        return sc.pickleFile(path)

    own = leaf([F.col(c) for c in fields])
    rows = docs.select(F.col(source).cast("string").alias("source"), F.col(id_col).alias("id"), F.unhex(own).alias("leaf"), F.unhex(F.lit(None).cast("string") if shown is None else shown).alias("shown"), F.monotonically_increasing_id().alias("row"))
    order = ["source", "id", "leaf", "row"]
    leaves = scratch.store(rows, "leaves")
    dealt = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("source", "id", "leaf", "shown")
    numbered = keep(dealt.rdd.mapPartitionsWithIndex(_number), "numbered")
    carried = _carried(numbered.filter(lambda r: r[1] is None).collect())  # one row per partition
    if not carried:
        return spark.createDataFrame([], schema)

    def node(r: tuple) -> tuple:
        part, (tree, doc_id, own, shown), at = r
        first, before = carried[part]
        return tree, at + (before if tree == first else 0), bytes(own), (doc_id, shown and bytes(shown))

    steps, tops = _up(numbered.filter(lambda r: r[1] is not None).map(node), keep, parts, "up")
    ordered = tops.sortBy(lambda t: (t[0] is not None, (t[0] or "").encode()), numPartitions=max(1, parts // FAN))
    upper, last = _up(ordered.zipWithIndex().map(lambda t: (0, t[1], t[0][2], t[0])), keep, parts, "top")
    ((_, step, root),) = last.collect()
    # Every subroot gets its path in the upper tree, and takes it to the top of its own tree.
    met = _down(upper, sc.parallelize([(0, step, [], None)], 1), parts)
    ways = met.flatMap(lambda m: [(source, k, path, subroot) for (_, (source, k, subroot)), path in zip(m[1][0], _paths(m[0][1], m[1][0], m[1][1][0]))])
    found = _down(steps, keep(ways, "ways"), parts).flatMap(_verify(root))
    return spark.createDataFrame(found, schema, verifySchema=False)


def tampered(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fields: tuple[str, ...] = FIELDS, every: int = 5) -> Column:
    """The digest that a row presents after its text was lower-cased (A-Z), where ``every`` divides the crc32 of its id; else null."""
    changed = leaf([ascii_lower(F.col(c)) if c == text else F.col(c) for c in fields])
    return F.when(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, changed)
