"""MinHash near-dedup: bottom-k sketches from one hash function, inverted lists, union sketches, exact Jaccard.

1. Each text becomes the set of 64-bit hashes of its word shingles. Texts with equal sets form a class; only one
   document of each class goes on, so that thousands of copies cost as much as one.
2. The bottom-k sketch keeps the upper 31 bits of the k smallest hashes. Inverted lists are kept for runs of `RUN` neighbouring retained values
   among the first `indexed`, and for runs of two of sets of under `SMALL`. Two sets of up to `indexed` shingles over the threshold always share a
   run (`indexed` being under k); larger ones but for a chance of about 0.70**indexed (tests/llm counts misses). Texts with one common passage rarely do.
3. Lists generate overlaps. First each list's members meet one hub, whatever the length of the list; links found so make components, and
   lists that lie within one component are done. In the others, an eighth of them first and then the rest, the overlaps of all sketches from different components are counted within the task; a
   long list is cut into blocks by set size, and each pair of blocks whose sizes can match is a group of its own. The overlap of two sketches within
   the smallest k values of their union estimates the similarity; what is more than five standard deviations below the threshold goes.
4. What leaves a group is trees, not pairs: those of pairs estimated over the threshold are links if the full sets confirm them. Trees of all pairs make
   clusters; what the first lists have put into one cluster needs no further trees in the rest; within those that aren't one component by then full sets are compared, again in blocks and with trees as the result. Full sets are made for the documents that
   occur in such pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec
from .common import bounded, discard, few, small_batches, stored
from .components import components

#: Neighbouring values in a run; sets of fewer shingles than SMALL have runs of two, those of LARGE and more runs of RUN. Both kinds overlap, so that
#: sets that can be linked share a kind: with one shingle of difference in a union under 10 only runs of two are sure to be common.
RUN, SMALL, LARGE = 3, 10, 8
#: Fewer shingles than these have no other set that near.
LEAST = 4
#: Members of a list that are compared in one group, and how far above the threshold an estimate makes a link all but certain.
BLOCK, MARGIN = 512, 0.06


def _signature(rows: Iterator[pa.RecordBatch], n: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in bounded(rows):
        sets = textvec.shingle_sets(batch.column("text").to_pylist(), n)
        size = np.array([len(s) for s in sets], np.int64)
        a = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
        b = np.array([textvec.mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64)
        sketch = _arrays([(s[:k] >> np.uint64(33)).astype(np.int32) for s in sets])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), sketch], names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"])


def _arrays(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _sets(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in bounded(rows):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("node"), _arrays([s.view(np.int64) for s in textvec.shingle_sets(batch.column("text").to_pylist(), n)])], names=["node", "items"])


def run_keys(sketch: Column, n: Column, indexed: int) -> Column:
    """The keys of a set's runs: its list memberships."""

    def runs(size: int) -> Column:
        at = F.sequence(F.lit(1), F.least(F.size(sketch) - (size - 1), F.lit(indexed)))

        def key(i: Column) -> Column:
            values = [F.element_at(sketch, i + j).cast("long") for j in range(size)]
            if size == 2:
                return F.bitwise_not(F.shiftleft(values[0], 33).bitwiseXOR(F.shiftleft(values[1], 1)))
            return F.shiftleft(values[0], 33).bitwiseXOR(F.shiftleft(values[1], 16)).bitwiseXOR(values[2])

        return F.transform(at, key)

    return F.when(n < LARGE, runs(2)).when(n < SMALL, F.concat(runs(2), runs(RUN))).otherwise(runs(RUN))


def _least(threshold: float, union, size, root=np.sqrt, most=np.maximum, least=np.minimum):
    """The overlap within the smallest `union` values below which a pair is ruled out: five standard deviations of a draw without replacement from about
    `size` values at the threshold. For arrays, and for columns with their functions."""
    part = least(most((size - union) / most(size - 1, 1), 0), 1)
    return union * threshold - 5 * root(threshold * (1 - threshold) * most(union, 1) * part) - 1e-3


def estimated(pairs: DataFrame, heads: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those that the union of their bottom-k sketches doesn't rule out."""
    of = lambda x: heads.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))
    met = few(pairs).join(of("a"), "a").join(of("b"), "b")
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), union))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    low = _least(threshold, F.size(union), F.col("a_n") + F.col("b_n") - both, F.sqrt, lambda x, y: F.greatest(lit(x), lit(y)), lambda x, y: F.least(lit(x), lit(y)))
    return met.where(both >= low).select(*pairs.columns)


def _sets_of(nodes: DataFrame, docs: DataFrame, shingle: int, repeated: bool) -> DataFrame:
    """Full sets (node, items) of nodes, stored: made of their texts. repeated: an id may have several texts, which are a row each."""
    wanted = few(nodes)
    texts = docs.join(wanted, docs["doc_id"] == wanted["node"]).select("node", "text")
    return stored((texts.dropDuplicates() if repeated else texts).mapInArrow(lambda it: _sets(it, shingle), "node long, items array<long>"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of nodes, those linked, by full sets (node, items)."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items"))
    shared = F.size(F.array_intersect("a_items", "b_items"))
    exact = 100 * shared >= round(100 * threshold) * (F.size("a_items") + F.size("b_items") - shared)
    return few(pairs).join(of("a"), "a").join(of("b"), "b").where(exact).select(*pairs.columns)


def _incidence(row: np.ndarray, value: np.ndarray, members: int) -> Iterator[np.ndarray]:
    """0-1 matrices, members by values that more than one holds, one slice of bounded size at a time."""
    _, value, times = np.unique(value, return_inverse=True, return_counts=True)
    again = times > 1
    keep = again[value]
    row, column, total = row[keep], (np.cumsum(again) - 1)[value[keep]], int(again.sum())
    width = max(1, 2**21 // max(1, members))
    for c in range(0, total, width):
        part = (column >= c) & (column < c + width)
        m = np.zeros((members, min(width, total - c)), np.float32)
        m[row[part], column[part] - c] = 1
        yield m


def _trees(near: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trees that connect what the symmetric 0-1 matrix near and equal labels connect, broadly from the first members on, so that many groups have the same
    ones: both ends of each edge between labels, and new labels, one for each tree."""
    adjacent = near | (label[:, None] == label[None, :])
    tree, xs, ys = np.full(len(near), -1), [], []
    for root in np.flatnonzero(near.any(0)).tolist():
        if tree[root] >= 0:
            continue
        tree[root], front = root, np.array([root])
        while len(front):
            left = np.flatnonzero(tree < 0)
            to = adjacent[np.ix_(front, left)]
            hit = to.any(0)
            new, parent = left[hit], front[to[:, hit].argmax(0)]
            tree[new], front = root, new
            across = label[parent] != label[new]
            xs.append(parent[across])
            ys.append(new[across])
    alone = tree < 0
    tree[alone] = np.searchsorted(np.unique(label), label[alone]) + len(near)
    return np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*ys, np.zeros(0, np.int64)]), tree


def _close(rows: Iterator[pa.RecordBatch], k: int, threshold: float, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j, node), with sketches, or if exact with whole sets, as items: of each group the pairs between different components that are
    near enough, as trees, fewer than it has members: what they connect is what all such pairs connect. In a group of two blocks a pair has a member
    of each. sure: the estimate is over the threshold, or the sets are whole and so is their similarity; these trees also use what is connected already.
    The other trees are of all pairs but those of whole sets, as an estimate may be wrong either way. They connect clusters, and touch every member of such
    a pair that is still a cluster of its own; what is in one cluster by then has been touched.

    The overlaps are products of the group's 0-1 matrix (members by values held more than once) with itself.
    """
    names = ["a", "ca", "b", "cb", "sure"]

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n, comp, cluster, side = (t.column(c).to_numpy() for c in ("node", "n", "component", "cluster", "side"))
        if len(node) < 2 or (comp == comp[0]).all():
            return
        lists = t.column("items").combine_chunks()
        held, value = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        n = held.astype(np.int64) if exact else n  # an id may have several sets
        both = np.zeros((len(node), len(node)), np.float32)
        for m in _incidence(np.repeat(np.arange(len(node)), held), value, len(node)):
            both += m @ m.T
        union = held[:, None] + held[None, :] - both
        other = comp[:, None] != comp[None, :]
        ok = other & (100 * np.minimum(n[:, None], n[None, :]) >= round(100 * threshold) * np.maximum(n[:, None], n[None, :]))
        if side.any():
            ok &= side[:, None] != side[None, :]
        whole = (held == n)[:, None] & (held == n)[None, :]
        ok &= np.where(whole, 100 * both >= round(100 * threshold) * union, both >= _least(threshold, np.minimum(k, union), n[:, None] + n[None, :] - both))
        if not ok.any():
            return
        sure = ok & (whole | (both >= threshold * np.minimum(k, union)))
        # what is surely a link connects first, then what may just be one
        firm = sure & (whole | (both >= (threshold + MARGIN) * np.minimum(k, union)))
        x, y, label = _trees(firm, comp)
        x2, y2, _ = _trees(sure & (label[:, None] != label[None, :]), label)
        x3, y3, _ = _trees(ok & ~whole & (cluster[:, None] != cluster[None, :]), cluster)
        x, y = np.concatenate([x, x2, x3]), np.concatenate([y, y2, y3])
        likely = np.arange(len(x)) < len(x) - len(x3)
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[x], comp[x], node[y], comp[y], likely)], names=names)

    rest: pa.Table | None = None
    for batch in rows:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not t.num_rows:
            continue
        group = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        bounds = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist()]
        for s, e in zip(bounds, bounds[1:], strict=False):
            yield from pairs(t.slice(s, e - s).combine_chunks())
        rest = t.slice(bounds[-1])
    if rest is not None and rest.num_rows:
        yield from pairs(rest.combine_chunks())


def _met(lists: DataFrame, items: DataFrame, k: int, threshold: float, block: int, exact: bool) -> DataFrame:
    """What _close() finds in lists (key, node, n, component, cluster) with items (node, items): lists of up to `block` members are a group each; longer ones are cut
    into blocks by set size, and blocks meet in twos, with themselves too, if their sizes can match and their components aren't all the same."""
    per = lists.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("key", "members")
    lists = stored(lists.select("key", "node", "n", "component", "cluster").join(per, "key"), "open")
    every = lists.where(F.col("members") <= block).select("key", "node", "n", "component", "cluster", *(F.lit(0).alias(c) for c in ("i", "j", "side")))
    long = lists.where(F.col("members") > block)
    if not long.isEmpty():
        place = F.row_number().over(W.partitionBy("key").orderBy("n", "node"))
        long = long.select("key", "node", "n", "component", "cluster", F.floor((place - 1) / block).cast("int").alias("i"))
        blocks = long.groupBy("key", "i").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        other = blocks.select("key", F.col("i").alias("j"), F.col("least").alias("least2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        met = blocks.join(other, "key").where("i <= j").where(100 * F.col("most") >= round(100 * threshold) * F.col("least2"))
        met = met.where(F.least("lo", "lo2") < F.greatest("hi", "hi2")).select("key", "i", "j")
        every = every.unionByName(long.join(met, ["key", "i"]).withColumn("side", F.lit(0)))
        every = every.unionByName(long.withColumnRenamed("i", "j").join(met.where("i < j"), ["key", "j"]).withColumn("side", F.lit(1)))
    dealt = every.join(items, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    found = stored(dealt.mapInArrow(lambda it: _close(it, k, threshold, exact), "a long, ca long, b long, cb long, sure boolean").distinct(), "close")
    discard(lists)
    return found


def _merged(df: DataFrame, merge: DataFrame, column: str = "component") -> DataFrame:
    """df with its components replaced by those that merge (node, component) puts them into."""
    to = few(merge.select(F.col("node").alias(column), F.col("component").alias("_to")))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, k: int = 128, indexed: int = 64, block: int = BLOCK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of that similarity (0.8 at least) or more; kept marks the row that has it.
    Null, empty and wordless texts have no shingles, are linked with nothing and kept. A repeated row gets the same
    result each time it occurs; an id that occurs with different texts is a node that carries all of them.
    Rows without an id are returned with null component_id and kept, and link nothing. Other columns are ignored.
    Texts of any length are taken whole. An empty table gives an empty result. The result is a table in the shared folder; all others that were
    written on the way are gone by then.
    """
    if threshold < 0.8:
        raise ValueError("runs of neighbouring values find similarities of 0.8 and more")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(lambda it: _signature(it, shingle, k), "doc_id long, n_shingles long, set_a long, set_b long, sketch array<int>"), "signatures")
    same = ["n_shingles", "set_a", "set_b"]
    classes = stored(signed.where("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    repeated = not signed.groupBy("doc_id").count().where("count > 1").isEmpty()
    heads = signed.join(classes, same).where(F.col("doc_id") == F.col("node")).where(F.col("n_shingles") >= LEAST).select("node", F.col("n_shingles").alias("n"), "sketch")
    heads = stored(heads.dropDuplicates() if repeated else heads, "heads")

    postings = heads.select("node", "n", F.explode(run_keys(F.col("sketch"), F.col("n"), indexed)).alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    lists = stored(postings.join(shared, "key").withColumn("component", F.col("node")), "lists")
    merges: list[DataFrame] = []

    def link(pairs: DataFrame) -> None:
        """Takes stored pairs (a, ca, b, cb) as links if they are confirmed."""
        if not pairs.isEmpty():
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            sets = _sets_of(nodes, docs, shingle, repeated)
            merge(stored(confirmed(pairs, sets, threshold), "links"))
            discard(sets)
        discard(pairs)

    def merge(links: DataFrame) -> None:
        merges.append(components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        discard(links)

    def up_to_date(df: DataFrame, since: int) -> DataFrame:
        return reduce(_merged, merges[since:], df)

    # one hub for each list
    hub = lists.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"))
    met = lists.join(hub, "key").select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"))
    met = met.where("a <> b").where(100 * F.least("na", "nb") >= round(100 * threshold) * F.greatest("na", "nb")).select("a", F.col("a").alias("ca"), "b", F.col("b").alias("cb")).distinct()
    met = stored(met, "met")
    hubs = stored(estimated(met, heads, k, threshold), "hubs")
    discard(met)
    link(hubs)
    # the likely links that are left, by some of the lists, as those of large groups share most; then by the rest that aren't one component by then
    first, sketches = F.pmod(F.xxhash64("key"), F.lit(8)) == 0, heads.select("node", F.col("sketch").alias("items"))
    others: list[DataFrame] = []
    maybe = None
    for some in (lists.where(first), lists.where(~first)):
        some = up_to_date(some, 0).withColumn("cluster", F.col("node"))
        found = _met(some if maybe is None else _merged(some, maybe, "cluster"), sketches, k, threshold, block, False)
        others.append(stored(found.where("not sure").drop("sure"), "others"))
        likely = stored(found.where("sure").drop("sure"), "likely")
        discard(found)
        link(likely)
        if maybe is None:
            maybe = components(others[0].select("a", "b"))
    discard(lists, maybe)
    # clusters of nodes that may have others: whole sets within each
    pairs = others[0].unionByName(others[1])
    maybe = components(pairs.select("a", "b"))
    if not maybe.isEmpty():
        clusters = few(maybe.select("node", F.col("component").alias("key"))).join(heads.select("node", "n").distinct(), "node")
        clusters = up_to_date(clusters.withColumns({"component": F.col("node"), "cluster": F.col("node")}), 0)
        open_ = clusters.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        clusters = stored(clusters.join(open_, "key"), "clusters")
        if not clusters.isEmpty():
            sets = _sets_of(clusters.select("node").distinct(), docs, shingle, repeated)
            merge(_met(clusters, sets, k, threshold, block, True))
            discard(sets)
        discard(clusters)
    discard(maybe, *others)

    of = up_to_date(classes.withColumn("component", F.col("node")), 0)
    of = of.select(*(F.col(c).alias(f"_{c}") for c in same), F.col("component").alias("_component"))
    joined = signed.join(of, [signed[c] == of[f"_{c}"] for c in same], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    out = stored(joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), "components")
    discard(signed, classes, heads, *merges)
    return out
