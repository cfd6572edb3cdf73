"""Links between rows that share bucket keys, found without pairs of all rows of a bucket, and their components.

First every row meets one row, the most central one of its largest bucket, which connects
most of what is alike: as many pairs as rows. What then is of different components in one
bucket is met in full, in cells: the rows outside the bucket's largest component are cut into
blocks, each of which meets every block of the bucket in one group of rows. A cell decides
its pairs on the whole payloads, by one matrix product, and gives only the links that
connect components, so no table of pairs grows with the square of a bucket. Rows of one
component never meet each other in a cell of their own. Every step is written; nothing is
gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_frames, materialize, materialize_counted, ship

#: Rows of a block of a bucket, and their summed sizes (words of texts) where rows are large.
BLOCK_ROWS, BLOCK_SIZE = 256, 200_000


@dataclass
class Measure:
    """What makes two payloads a link; sent to the executors."""

    def read(self, payload: bytes | str) -> object:
        """The payload as linked() takes it."""
        raise NotImplementedError

    def linked(self, one: list, two: list, wanted: np.ndarray | None = None) -> np.ndarray:
        """Which of the read payloads of two lists are links; pairs that aren't ``wanted`` need no answer."""
        raise NotImplementedError


def connected_components(links: DataFrame) -> DataFrame:
    """node, label per node of the links (a, b): the smallest node that it is connected with.

    Each pass takes the smallest label of the neighbours and then that label's own label, so
    passes grow with the logarithm of a component's diameter. Every pass is written.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    edges = materialize(links.select(ends).select("e.u", "e.v"), "edges")
    labels = materialize(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("u") == F.col("node")).groupBy(F.col("v").alias("w")).agg(F.min("label").alias("near"))
        better = labels.join(near, F.col("node") == F.col("w")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        after = better.join(jump, F.col("to") == F.col("at"), "left").select("node", "old", F.least("to", F.coalesce("beyond", "to")).alias("label"))
        after, changed = materialize_counted(after, "labels", F.col("old") != F.col("label"))
        labels = after.select("node", "label")
        if not changed:
            return labels


def shared_members(members: DataFrame) -> tuple[DataFrame, int]:
    """Of rows (k, node) those whose bucket k holds other nodes too, with its number n of them; and how many there are."""
    many = members.groupBy(F.col("k").alias("k2")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = materialize(many, "buckets")
    return materialize_counted(members.join(many, F.col("k") == F.col("k2")).select("k", "node", "n"), "members")


def _by_node(members: DataFrame) -> DataFrame:
    """Per node: the keys ``ks`` of its buckets, their summed sizes c, and the key of the largest."""
    # A node that many others resemble lies in many large buckets.
    own = members.groupBy("node").agg(F.sum("n").alias("c"), F.max(F.struct("n", "k"))["k"].alias("largest"), F.collect_list("k").alias("ks"))
    return materialize(own, "central")


def _centres(own: DataFrame) -> DataFrame:
    """A pair (a, b) per node of _by_node(): itself and the most central node of its largest bucket, where that is another one."""
    centres = own.select("node", "c", F.explode("ks").alias("k")).groupBy("k").agg(F.max(F.struct("c", "node"))["node"].alias("b"))
    pairs = own.select("node", "largest").join(materialize(centres, "centres"), F.col("largest") == F.col("k")).where("node != b")
    return materialize(pairs.select(F.col("node").alias("a"), "b"), "pairs")


def _verified(pairs: DataFrame, held: DataFrame, measure: Measure) -> DataFrame:
    """Of pairs (a, b) those that are links."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, other = None, None
        for frame in frames:
            kept = []
            for b, x, y in zip(frame["b"], frame["_payload_a"], frame["_payload_b"], strict=True):
                if b != last:
                    last, other = b, measure.read(y)
                kept.append(bool(measure.linked([measure.read(x)], [other])[0, 0]))
            yield frame.loc[kept, ["a", "b"]]

    one, two = (held.select(F.col("node").alias(f"n{x}"), F.col("_payload").alias(f"_payload_{x}")) for x in "ab")
    met = pairs.join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb")).select("a", "b", "_payload_a", "_payload_b")
    return map_frames(met, run, "a long, b long")


def forest(comps: np.ndarray, linked: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Of links (one[i], two[j]) for linked[i, j], as many as connect the components ``comps`` of the rows as all of them would."""
    x, y = np.nonzero(linked)
    if not len(x):
        return []
    x, y = one[x], two[y]
    # One link of two components is enough.
    low, high = np.minimum(comps[x], comps[y]), np.maximum(comps[x], comps[y])
    _, first = np.unique(low.astype(np.int64) << 32 | high, return_index=True)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while (up := parent.setdefault(c, c)) != c:
            parent[c] = parent[up] = parent.setdefault(up, up)
            c = parent[c]
        return c

    out = []
    for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True):
        a, b = root(int(comps[i])), root(int(comps[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _cells(own: DataFrame, held: DataFrame, labels: DataFrame | None, measure: Measure, rows: int, size: int) -> DataFrame:
    """Links (a, b) that connect rows of different components in one bucket of the nodes of _by_node().

    ``held``: node, _size, _payload. Joins see a node once, not once for each of its keys.
    """
    ship(own.sparkSession)
    sized = own.select("node", "ks").join(held.select(F.col("node").alias("node2"), "_size"), F.col("node") == F.col("node2")).drop("node2")
    if labels is None:
        named = sized.withColumn("comp", F.col("node"))
    else:
        named = sized.join(labels.select(F.col("node").alias("node3"), "label"), F.col("node") == F.col("node3"), "left").withColumn("comp", F.coalesce("label", "node"))
    now = materialize(named.select(F.explode("ks").alias("k"), "node", "_size", "comp"), "met")
    parts = now.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("_size").alias("s"))
    mixed = parts.groupBy("k").agg(F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.max(F.struct("m", "s", "comp")).alias("main")).where("parts > 1")
    blocks = lambda m, s: F.greatest(F.ceil(m / rows), F.ceil(s / size), F.lit(1)).cast("int")
    # A bucket of one block is one cell; else the largest component's blocks only meet those of the others.
    whole = blocks(F.col("m"), F.col("s")) == 1
    mixed = mixed.select(
        F.col("k").alias("k2"),
        F.when(~whole, F.col("main.comp")).alias("main"),
        F.when(whole, 1).otherwise(blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s"))).alias("minor"),
        F.when(whole, 0).otherwise(blocks(F.col("main.m"), F.col("main.s"))).alias("major"),
    )
    dealt = now.join(materialize(mixed, "mixed"), F.col("k") == F.col("k2"))
    of_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    place = F.xxhash64("node")
    dealt = dealt.withColumn("own", F.when(of_main, F.col("minor") + F.pmod(place, F.col("major"))).otherwise(F.pmod(place, F.col("minor"))).cast("int"))
    last = F.when(of_main, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")
    full = dealt.join(held.select(F.col("node").alias("n2"), "_payload"), F.col("node") == F.col("n2")).drop("n2")

    def met(cell: pd.DataFrame) -> list[tuple[int, int]]:
        own, nodes = cell["own"].to_numpy(), cell["node"].to_numpy()
        codes, _ = pd.factorize(cell["comp"])
        i, j = int(cell["i"].iat[0]), int(cell["j"].iat[0])
        one, two = np.flatnonzero(own == i), np.flatnonzero(own == j)
        apart = codes[one][:, None] != codes[two][None]
        if not apart.any():
            return []
        items = [measure.read(x) for x in cell["_payload"]]
        linked = measure.linked([items[x] for x in one], [items[x] for x in two], apart) & apart
        return [(min(nodes[x], nodes[y]), max(nodes[x], nodes[y])) for x, y in forest(codes, linked, one, two)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            if rest is not None and len(rest):
                frame = pd.concat([rest, frame], ignore_index=True)
            key = frame[["k", "i", "j"]].to_numpy()
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
            # The last cell may go on in the next frame.
            found = [pair for x, y in zip(starts, starts[1:], strict=False) for pair in met(frame.iloc[x:y])]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
            rest = frame.iloc[starts[-1] :]
        if rest is not None and len(rest) and (found := met(rest)):
            yield pd.DataFrame(found, columns=["a", "b"])

    return map_frames(full.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j"), run, "a long, b long", 2048)


def _small_pairs(members: DataFrame, few: int, shared: int) -> DataFrame:
    """Pairs (a, b) of nodes that share ``shared`` buckets of up to ``few`` nodes; at most (few - 1) / 2 a row of members."""
    held = members.where(F.col("n") <= few).groupBy("k").agg(F.sort_array(F.collect_list("node")).alias("of"))
    pairs = F.flatten(F.transform("of", lambda x, i: F.transform(F.slice("of", i + 2, F.size("of")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = held.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= shared).select("a", "b")


def find_links(members: DataFrame, held: DataFrame, measure: Measure, rows: int = BLOCK_ROWS, size: int = BLOCK_SIZE, few: int = 0, shared: int = 1) -> tuple[DataFrame | None, DataFrame | None]:
    """Links (a, b) between nodes, and node, label of what they connect; None, None without links.

    ``members``: k, node (long), n, as shared_members() gives. ``held``: node, _size, _payload.
    Every two nodes of a bucket that are links end in one component; the links are
    enough of them to connect it, not all. ``few``: buckets of up to so many nodes give pairs
    instead, and of these, pairs that share ``shared`` such buckets are compared; for nodes
    of very many keys, most of whose buckets are chance.
    """
    ship(members.sparkSession)
    own = _by_node(members.where(F.col("n") > few))
    pairs = _centres(own)
    if few:
        pairs = materialize(pairs.unionByName(_small_pairs(members, few, shared)), "pairs")
    links, some = materialize_counted(_verified(pairs, held, measure), "links")
    labels = connected_components(links) if some else None
    more, new = materialize_counted(_cells(own, held, labels, measure, rows, size), "more-links")
    if new:
        links = materialize(links.unionByName(more).distinct(), "all-links")
        labels = connected_components(links)
    return (links, labels) if some or new else (None, None)


def with_classes(nodes: DataFrame, links: DataFrame | None, labels: DataFrame | None) -> DataFrame:
    """Per node (node, least, rows): node, label, class_id, class_size, n_links."""
    if links is None or labels is None:
        return nodes.select("node", F.col("node").alias("label"), F.col("least").alias("class_id"), F.col("rows").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    ends = links.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(labels.withColumnRenamed("node", "node2"), F.col("node") == F.col("node2"), "left").select("node", "least", "rows", F.coalesce("label", "node").alias("label"))
    named = named.join(ends, F.col("node") == F.col("e"), "left").select("node", "least", "rows", "label", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = materialize(named, "named")
    classes = named.groupBy(F.col("label").alias("l2")).agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    return named.join(classes, F.col("label") == F.col("l2")).select("node", "label", "class_id", "class_size", "n_links")
