"""Near-duplicates by bottom-k sketches from one hash function.

A text's set is its distinct five-word shingles, as 64-bit hashes; its sketch the
``K`` smallest of them.  Texts with equal sets are one class from the start.

1. Inverted lists.  Two sets as alike as the threshold differ in at most a share
   of their sketches; so, in any order of all values, the first ``slack + 1``
   values of both sketches have one in common (``slack``: the expected share plus
   four standard deviations).  The order is by how many classes retain a value:
   rare ones first, so that a passage that very many texts share makes no list
   unless it is nearly all that a text has.
2. Every list, long or short, gives pairs of its most central class with all its
   others.  A pair's union sketch estimates its similarity; four standard deviations
   below the threshold it is dropped, else whole texts are read and the exact
   similarity decides.  Components of these links are taken, and lists that lie in
   one component are done: a group of copies costs as much as it has members.
3. Of the lists that are left, those of up to ``HOT`` classes give the pairs that are
   still in different components, checked in the same way.  Longer ones are dealt
   into blocks of bounded size; each pair of blocks is one piece of work.  There the
   sets are whole: classes with too many shingles of their own leave at once, the
   rest are compared exactly, and only edges that join two components come out, at
   most one for each class.
4. Components of all edges by alternating stars.

Nothing is capped or sampled, no pairs within a long list leave a task, and what
reaches the driver is counts.  Classes, active texts and edges are tables in the
shared folder, deleted as soon as nothing reads them.  What stays quadratic is a long
list whose classes are too much alike for the sketches and not enough for the
threshold; the README has figures.

Rows: texts without words are linked with nothing; equal doc_ids are one
document with several texts; a null doc_id is in no group, its component is null
and it is kept; repeated rows are each answered; a very long text is one set, read
whole; of equally central classes the smallest doc_id is compared with the others;
an empty table gives an empty one.  Extra columns are not read by
:func:`group_near_duplicates` and kept by :func:`keep_one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cedarflow.llm.common import discard, materialise, partitions_of, small_batches, spread
from cedarflow.llm.shingles import shingle_hashes

K = 64
HOT = 64
SIGMAS = 4
BLOCK_SHINGLES = 1 << 20
BLOCK_CLASSES = 4096
RARE = 32


def sets_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's set, sorted, as signed 64-bit integers."""
    for hashes in shingle_hashes(texts):
        yield np.unique(hashes.view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, two halves of its set's digest, and its sketch."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, ones, twos, kept = [], [], [], []
            for s in sets_of(batch.column("text").to_pylist()):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sizes.append(len(s))
                ones.append(int.from_bytes(digest[:8], "little", signed=True))
                twos.append(int.from_bytes(digest[8:], "little", signed=True))
                kept.append(s[:K])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(kept, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "sketch"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def slack(size: Column, percent: int) -> Column:
    """How many values of a sketch of that size a similar one may lack."""
    q = 1 - percent / 100
    return F.least(size - 1, F.floor(size * q + F.sqrt(size * (q * (1 - q))) * SIGMAS) + 1)


def listed(classes: DataFrame, percent: int) -> DataFrame:
    """The inverted lists' entries, as a table: v, rep, n, central."""
    entries = classes.select("rep", "d1", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("v"))
    common = materialise(entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "common")
    own = entries.hint("merge").join(common, "v").groupBy("rep", "d1", "n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("central"))
    first = slack(F.col("size"), percent) + 1 - (F.col("size") - F.size("vs"))  # what occurs once comes before
    found = own.filter(first > 0).select("rep", "n", "central", F.explode(F.slice("vs", F.lit(1), first.cast("int"))).alias("x"))
    out = materialise(found.select(F.col("x.v").alias("v"), "rep", "n", "central"), "entries")
    discard(common)
    return out


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def may_be_similar(a: Column, b: Column, percent: int) -> Column:
    """The union sketch does not speak against the threshold."""
    t = percent / 100
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    m = F.size(union)
    return shared >= m * t - F.sqrt(m * (t * (1 - t))) * SIGMAS


def verified(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar; ``active`` has the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 256):
                batch = big.slice(i, 256)
                texts = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
                held: dict[str, np.ndarray] = {}
                every = list(dict.fromkeys(texts[0] + texts[1]))
                held.update(zip(every, sets_of(every), strict=True))
                ok = []
                for x, y in zip(*texts, strict=True):
                    x, y = held[x], held[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    rows = pairs
    for c in ("a", "b"):
        rows = rows.hint("merge").join(active.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), c)
    likely = rows.filter(similar_sizes(F.col("n_a"), F.col("n_b"), percent) & may_be_similar(F.col("s_a"), F.col("s_b"), percent)).select("a", "b")
    for c in ("a", "b"):
        likely = likely.hint("merge").join(active.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")), c)
    return likely.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


class Parts:
    """Which of the members are known to be connected."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right one."""
    n, m = len(left), len(right)
    values = np.concatenate(left + right)
    rows = np.repeat(np.arange(n + m), [len(s) for s in left + right])
    _, column, df = np.unique(values, return_inverse=True, return_counts=True)
    out = np.zeros((n, m), np.float32)
    order = np.argsort(column, kind="stable")
    rows, ends = rows[order], np.cumsum(df)
    starts = ends - df
    for c in range(2, RARE + 1):  # few rows: all their pairs
        at = starts[df == c]
        if len(at):
            mine = rows[at[:, None] + np.arange(c)]
            x, y = (z.ravel() for z in np.broadcast_arrays(mine[:, :, None], mine[:, None, :]))
            ok = (x < n) & (y >= n)
            np.add.at(out, (x[ok], y[ok] - n), 1)
    many = np.flatnonzero(df > RARE)
    for i in range(0, len(many), 2048):
        part = many[i : i + 2048]
        matrix = np.zeros((n + m, len(part)), np.float32)
        for k, c in enumerate(part):
            matrix[rows[starts[c] : ends[c]], k] = 1
        out += matrix[:n] @ matrix[n:].T
    return out


def block_edges(members: list[tuple[int, int, np.ndarray]], i: int, j: int, percent: int, roots: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Edges that connect the similar ones among (rep, block, set); with different
    blocks, between them.  Classes of one root are connected already."""
    roots = roots or {}
    _, column, df = np.unique(np.concatenate([s for *_, s in members]), return_inverse=True, return_counts=True)
    own = np.add.reduceat((df[column] == 1).astype(np.int64), np.cumsum([0] + [len(s) for *_, s in members[:-1]]))
    members = [x for x, u in zip(members, own, strict=True) if 100 * u <= (100 - percent) * len(x[2])]
    left = [x for x in members if x[1] == i]
    right = [x for x in members if x[1] == j]
    if not left or not right or len({roots.get(x[0], x[0]) for x in members}) < 2:
        return []
    na, nb = (np.array([len(s) for *_, s in x], np.float64) for x in (left, right))
    parts, edges = Parts(), []
    for at in range(0, len(left), 1024):
        both = common_counts([s for *_, s in left[at : at + 1024]], [s for *_, s in right]).astype(np.float64)
        x, y = np.nonzero(100 * both >= percent * (na[at : at + 1024, None] + nb[None, :] - both))
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            a, b = left[at + p][0], right[q][0]
            if a != b and parts.join(roots.get(a, a), roots.get(b, b)):
                edges.append((min(a, b), max(a, b)))
    return edges


def hot_edges(entries: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) within long lists: entries are v, rep, root, blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, roots = None, [], {}

        def done() -> list[pa.RecordBatch]:
            edges = block_edges(members, key[1], key[2], percent, roots) if len(members) > 1 else []
            return [pa.RecordBatch.from_pydict({"a": [e[0] for e in edges], "b": [e[1] for e in edges]})] if edges else []

        for batch in small_batches(batches, "text"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("v", "i", "j", "rep", "root", "block")), sets_of(batch.column("text").to_pylist()), strict=True)
            for v, i, j, rep, root, block, s in rows:
                if (v, i, j) != key:
                    yield from done()
                    key, members, roots = (v, i, j), [], {}
                members.append((rep, block, s))
                roots[rep] = root
        yield from done()

    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = entries.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = dealt.select("v", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "rep", "root", "block")
    joined = dealt.hint("merge").join(active.select("rep", "text"), "rep")
    dealt = joined.repartition(2 * partitions_of(entries.sparkSession), "v", "i", "j").sortWithinPartitions("v", "i", "j", "rep")
    return dealt.select("v", "i", "j", "rep", "root", "block", "text").mapInArrow(run, "a long, b long").distinct()


def with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the least v of their u as m.

    A node's edges are dealt by salts, as many as there are shuffle partitions, and
    only the salts that it has carry its m; so a node of very many edges is in no
    one task, and others cost no more rows than they have edges.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(partitions_of(edges.sparkSession))).cast("int"))
    least = salted.groupBy("u", "salt").agg(F.min("v").alias("m")).select("u", "salt", F.min("m").over(Window.partitionBy("u")).alias("m"))
    return salted.hint("merge").join(least, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (a, b): node, root (the smallest node it reaches)."""
    here = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = here.unionByName(here.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = with_least(large).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least).distinct()
        after = materialise(small, "edges")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(here)
        here = after
        if now == mark:
            return here.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def group_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    signed = materialise(sketches(spread(docs.select("doc_id", "text"), "doc_id", "text")), "sketches")
    grouped = signed.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = materialise(grouped, "classes")
    entries = listed(classes, percent)
    top = F.max(F.struct("central", (-F.col("rep")).alias("less"), "n")).alias("top")
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("len") / BLOCK_CLASSES)).cast("long").alias("blocks")
    grown = entries.groupBy("v").agg(F.count("*").alias("len"), F.sum("n").alias("total"), top).filter("len > 1")
    lists = materialise(grown.select("v", "len", blocks, (-F.col("top.less")).alias("pivot"), F.col("top.n").alias("pivot_n")), "lists")
    known = materialise(entries.hint("merge").join(lists, "v"), "known")
    discard(entries)
    discard(lists)
    wanted = known.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).hint("merge").join(wanted, "rep", "left_semi").distinct()
    active = materialise(texts.hint("merge").join(classes.select("rep", "n", "sketch"), "rep"), "active")

    star = known.filter((F.col("rep") != F.col("pivot")) & similar_sizes(F.col("n"), F.col("pivot_n"), percent)).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    edges = materialise(verified(star, active, percent), "edges")
    roots = components(edges)
    discard(edges)

    labelled = known.filter("len > 2").select("v", "len", "blocks", "rep", "n").hint("merge").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    labelled = materialise(labelled, "labelled")
    split = materialise(labelled.groupBy("v").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("v"), "split")
    mixed = materialise(labelled.hint("merge").join(split, "v", "left_semi"), "mixed")
    for done in (known, labelled, split):
        discard(done)
    short, long = mixed.filter(F.col("len") <= HOT), mixed.filter(F.col("len") > HOT)
    x, y = (short.select("v", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "root")]) for s in "ab")
    rest = x.hint("merge").join(y, "v").filter((F.col("rep_a") < F.col("rep_b")) & (F.col("root_a") != F.col("root_b")) & similar_sizes(F.col("n_a"), F.col("n_b"), percent))
    pairs = verified(rest.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), active, percent)
    more = materialise(pairs.unionByName(hot_edges(long.select("v", "rep", "root", "blocks"), active, percent)), "edges")
    for done in (mixed, active):
        discard(done)
    if more.take(1):
        earlier, roots = roots, components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        discard(earlier)
    discard(more)

    named = classes.select("n", "d1", "d2", "rep").hint("merge").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "n", "d1", "d2").hint("merge").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents with the smallest doc_id of their groups, columns as they came."""
    gone = group_near_duplicates(docs.select("doc_id", "text"), percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.hint("merge").join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
