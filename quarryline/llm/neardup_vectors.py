"""Near-duplicate embeddings by NN-descent.

Vectors link when their labels are equal and their cosine, in double precision, reaches the threshold. Equal vectors of a
label are collapsed first and stand for their copies.

1. Start. A label's vectors are dealt into buckets by the signs of random hyperplanes and a bucket's vectors compared with
   each other; the best ``K`` with cosine over ``FLOOR`` start each list. Hyperplanes and repetitions follow the label's size:
   buckets hold about ``RUN`` vectors, and a pair just at the threshold that never shares one has probability ``MISS`` at
   most. A label of up to ``RUN`` vectors is one bucket. Overfull buckets are compared a pair of pieces at a time, but not
   the pairs of dense groups (step 3) among each other.
2. Descent. Lists and reverse lists of a node are gathered with their vectors and its neighbours compared with each other
   where one of the two is new there. All that reaches the threshold is kept apart as an edge and never dropped again;
   lists keep their best, by which the next round's candidates are chosen. A list full of links is saturated: its length
   is doubled, up to ``MOST_K``. Rounds go on until nearly nothing changes and no list grows. Large neighbourhoods are dealt
   into pieces of ``CHUNK``, anew in each round.
3. Threshold edges give components. Those with a list still saturated at ``MOST_K``, or a node that met more links than that in
   one comparison, are dense: lists cannot hold their links. Their members are counted exactly: ordered by component and the
   halves of eight projections, they are cut into blocks of ``TILE`` with a centre and a radius. Of two blocks of a label all
   members link if the angle of the centres plus both radii stays within that of the threshold, none if less both radii it
   goes beyond, whatever their components; only blocks between the two are compared vector by vector, a pair of blocks to a
   task. So dense groups cost their blocks, not their pairs, and two groups whose lists hide each other still meet.
4. Audit. ``AUDIT_MOST`` vectors of least id hash are compared with all vectors, in one pass. If fewer than ``RECALL`` of the
   links of those with few links, or of those with many, were found, another start with other hyperplanes is made on top of
   the graph; after ``ATTEMPTS`` the job fails rather than return less.

Pieces, chunks and blocks bound what one task holds, whatever the size of a label, of a dense group or of a node's reverse
list; only counts and the audit's sample reach the driver. The graph is probabilistic by nature: what bounds its losses are
``MISS`` and the audit.

No link: vectors that are null, of no components, zero, or hold a null or non-finite component, null labels, null ids,
and vectors of unequal lengths with each other. Their n_links is 0, their component their own id (null for a null id), and
they are kept. Rows that repeat an id with another vector count as one node with the links of both. Ties between equal
cosines: the lesser id stays in a list. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import checkpointed, keyed_groups, partitions, sized

THRESHOLD, FLOOR = 0.98, 0.9
K, MOST_K = 16, 64
RUN, MISS, BITS = 2048, 1e-7, 40
CHUNK = 64
SETTLED = 0.001
TILE = 2048
#: Pairs taken again in double precision at once, and rows of a bucket that are compared at once.
PAIRS, ROWS = 1 << 16, 512
AUDIT_MOST, RECALL, ATTEMPTS = 1000, 0.99, 3
EDGE = "u long, v long, sim double"
#: Chance that a random hyperplane leaves a pair at the threshold on one side.
SAME_SIDE = 1 - math.acos(THRESHOLD) / math.pi


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, vec, length of the rows that can link; single precision stays so until it is compared."""
    kind = dict(vectors.dtypes)["embedding"]
    vec = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
    rows = vectors.filter(good).select(F.col("vec_id").cast("long").alias("id"), "label", vec.alias("vec"), F.size("embedding").alias("length"))
    finite = F.coalesce(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))), F.lit(False))
    return rows.filter(finite).filter(F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows, in double precision, of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares of extreme components finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _edges(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float64())], ["u", "v", "sim"])


def trees(size: int, run: int) -> tuple[int, int]:
    """Hyperplanes of a bucket and repetitions for a label of so many vectors."""
    if size <= run:
        return 0, 1
    bits = min(BITS, math.ceil(math.log2(size / run)))
    return bits, math.ceil(math.log(MISS) / math.log1p(-(SAME_SIDE**bits)))


def buckets(nodes: DataFrame, seed: int) -> DataFrame:
    """id, tree, bucket: a row for each repetition of its label."""
    run = RUN
    sizes = nodes.groupBy("label", "length").agg(F.count("*").alias("size"))
    rows = nodes.join(sizes, ["label", "length"]).select("id", "vec", "length", "size", F.xxhash64("label", "length").alias("group"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, size = (batch.column(c).to_numpy() for c in ("length", "size"))
            for n, m in {*zip(length.tolist(), size.tolist(), strict=True)}:
                at = pa.array(np.nonzero((length == n) & (size == m))[0])
                bits, repeats = trees(m, run)
                planes = np.random.default_rng([seed, n]).normal(size=(n, bits * repeats))
                on = (_matrix(batch.column("vec").take(at)) @ planes > 0).reshape(len(at), repeats, bits)
                code = on @ (1 << np.arange(bits, dtype=np.int64))
                each = pa.array(np.repeat(np.arange(len(at)), repeats))
                tree = np.tile(np.arange(repeats, dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at).take(each) for c in ("id", "group")), pa.array(tree), pa.array(code.ravel().astype(np.int64))], ["id", "group", "tree", "code"])

    coded = rows.mapInArrow(work, "id long, group long, tree int, code long")
    return coded.select("id", "tree", F.xxhash64("group", "tree", "code").alias("bucket"))


def compared(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes of each key of dealt(id, key, side): of its side 0, or of the two sides if it has both."""
    rows = dealt.join(nodes, "id").select("key", "side", "id", F.xxhash64("label", "length").alias("group"), "vec")
    most = 16 * RUN

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in keyed_groups(batches, "key", most):
            ids, group, side = (part.column(c).to_numpy() for c in ("id", "group", "side"))
            for g in np.unique(group):  # one, but for a collision of keys
                sides = [np.nonzero((group == g) & (side == k))[0] for k in (0, 1)]
                x = [_matrix(part.column("vec").take(pa.array(at))) if len(at) else None for at in sides]
                for k, other in ((0, 1), (1, 0)) if len(sides[1]) else ((0, 0),):
                    for low in range(0, len(sides[k]), ROWS):
                        u, v = ids[sides[k][low : low + ROWS]], ids[sides[other]]
                        if len(v):
                            sim = x[k][low : low + ROWS] @ x[other].T
                            sim[u[:, None] == v[None]] = -1
                            yield from _best_of(u, v, sim, np.full(len(u), FLOOR))

    return rows.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(work, EDGE)


def start(nodes: DataFrame, seed: int) -> DataFrame:
    """Each node's best neighbours in its buckets.

    Where some buckets are overfull, the first repetition is compared in random pieces, which mark the nodes of dense groups.
    Then every two nodes of a bucket are compared, a pair of pieces at a time, but for dense nodes of unlike pieces.
    """
    placed = checkpointed(buckets(nodes, seed))
    piece = F.xxhash64("id", "bucket")
    overfull = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * RUN)
    first = nodes.sparkSession.createDataFrame([], EDGE)
    if not overfull.isEmpty():
        some = placed.filter("tree = 0").join(overfull, "bucket")
        first = checkpointed(compared(some.select("id", F.xxhash64("bucket", F.pmod(piece, F.ceil(F.col("n") / RUN))).alias("key"), F.lit(0).alias("side")), nodes))
    marked = placed.join(marks_of(first).select(F.col("u").alias("id"), F.lit(True).alias("dense")), "id", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    plain, dense = F.count_if(~F.col("dense")), F.count_if("dense")
    small = F.count("*") <= 2 * RUN
    sizes = marked.groupBy("bucket").agg(F.when(small, 1).when(plain <= 2 * RUN, F.least(plain, F.lit(1))).otherwise(F.ceil(plain / RUN)).cast("int").alias("a"), F.when(small, 0).otherwise(F.ceil(dense / RUN)).cast("int").alias("b"))
    a, b = F.col("a"), F.col("b")
    apart = F.col("dense") & (b > 0)
    rows = marked.join(sizes, "bucket").withColumn("piece", F.when(apart, a + F.pmod(piece, b)).otherwise(F.pmod(piece, a)).cast("int"))
    others = F.when(apart, F.array_append(F.when(a > 0, F.sequence(F.lit(0), a - 1)).otherwise(F.array().cast("array<int>")), F.col("piece"))).otherwise(F.sequence(F.lit(0), a + b - 1))
    dealt = rows.withColumn("other", F.explode(others)).select("id", F.xxhash64("bucket", F.least("piece", "other"), F.greatest("piece", "other")).alias("key"), (F.col("piece") > F.col("other")).cast("int").alias("side"))
    return first.union(compared(dealt, nodes))


def _best_of(u: np.ndarray, v: np.ndarray, sim: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Edges from each u to its K best v among those that reach its least, and to all its links.

    A u with more than MOST_K links here has its K best only and an edge to itself, which marks it as dense.
    """
    dense = (sim >= THRESHOLD).sum(axis=1) > MOST_K
    if sim.shape[1] > K:
        cut = np.partition(sim, sim.shape[1] - K, axis=1)[:, -K]
        least = np.maximum(least, np.where(dense, cut, np.minimum(cut, THRESHOLD)))
    i, j = np.nonzero(sim >= least[:, None])
    if len(i):
        yield _edges(np.r_[u[i], u[dense]], np.r_[v[j], u[dense]], np.r_[sim[i, j], np.ones(dense.sum())])


def lists_of(edges: DataFrame) -> DataFrame:
    """u, v, sim, new, k of edges with these columns: each u's best k, k doubled where all of them are links.

    ``new`` (1 or 0) is that of the older of repeated edges. A list that is full of links at MOST_K, or whose u is marked, is
    dense: it keeps the mark and proposes nothing new.
    """
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"), F.max("k").alias("k"))
    own = Window.partitionBy("u")
    mark = F.col("u") == F.col("v")
    ranked = once.withColumns({"k": F.max("k").over(own), "marked": F.max(mark).over(own)}).withColumn("rank", F.row_number().over(own.orderBy(mark, F.desc("sim"), "v"))).filter((F.col("rank") <= F.col("k")) | mark)
    full = (F.count_if(~mark).over(own) >= F.col("k")) & (F.min("sim").over(own) >= THRESHOLD)
    state = ranked.withColumn("full", full).withColumn("dense", F.col("marked") | (F.col("full") & (F.col("k") >= MOST_K)))
    kept = state.select("u", "v", "sim", F.when(F.col("dense"), 0).otherwise(F.col("new")).alias("new"), F.when(F.col("full") & ~F.col("dense"), F.col("k") * 2).otherwise(F.col("k")).alias("k"), "dense", "marked", "rank")
    again = F.when(F.col("dense") & ~F.col("marked") & (F.col("rank") == 1), F.array("v", "u")).otherwise(F.array("v"))
    return kept.withColumn("v", F.explode(again)).select("u", "v", "sim", "new", "k")


def local_join(lists: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Edges both ways between neighbours of a node, of which one is new there, that would enter a list or reach the threshold."""
    lists = lists.filter("u != v")
    worst = lists.groupBy(F.col("u").alias("v")).agg(F.when(F.count("*") >= F.max("k"), F.min("sim")).otherwise(F.lit(FLOOR)).alias("least"))
    around = lists.select("u", "v", "new").union(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "new")).groupBy("u", "v").agg(F.max("new").alias("new"))
    sizes = around.groupBy("u").agg(F.count("*").alias("n"), F.max("new").alias("any")).filter("any = 1 and n > 1").select("u", F.ceil(F.col("n") / CHUNK).alias("pieces"))
    members = around.join(sizes, "u").select("v", "new", F.xxhash64("u", F.pmod(F.xxhash64("v", F.lit(turn)), "pieces")).alias("key"))
    described = nodes.select(F.col("id").alias("v"), F.xxhash64("label", "length").alias("group"), "vec").join(worst, "v", "left").withColumn("least", F.coalesce("least", F.lit(FLOOR)))
    rows = members.join(described, "v").select("key", "v", "new", "group", "least", "vec")
    most = 4 * CHUNK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in keyed_groups(batches, "key", most):
            v, new, group, least = (part.column(c).to_numpy() for c in ("v", "new", "group", "least"))
            if len(v) < 2 or not new.any() or (group != group[0]).any():
                continue
            x = _matrix(part.column("vec"))
            sim = x @ x.T
            sim[(v[:, None] == v[None]) | (new[:, None] + new[None] == 0)] = -1
            yield from _best_of(v, v, sim, np.minimum(np.maximum(FLOOR, least), THRESHOLD))

    spread = rows.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return spread.mapInArrow(work, EDGE).groupBy("u", "v").agg(F.max("sim").alias("sim"))


def links_of(edges: DataFrame) -> DataFrame:
    """u < v of edges that reach the threshold, once."""
    return edges.filter((F.col("sim") >= THRESHOLD) & (F.col("u") != F.col("v"))).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def marks_of(edges: DataFrame) -> DataFrame:
    """u of the edges that mark a node as dense."""
    return edges.filter("u = v").select("u").distinct()


def descend(lists: DataFrame, links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists that the local join no longer changes, and all threshold edges met on the way."""
    turn, grown = 0, lists.agg(F.sum("k").alias("k")).first()["k"]
    while True:
        turn += 1
        found = checkpointed(local_join(lists, nodes, turn))
        if found.isEmpty():
            return lists, links
        links = checkpointed(links.union(links_of(found)).distinct())
        old = lists.select("u", "v", "sim", F.lit(0).alias("new"), "k")
        lists = checkpointed(lists_of(old.unionByName(found.select("*", F.lit(1).alias("new"), F.lit(K).alias("k")))))
        state = lists.agg(F.count("*").alias("n"), F.sum("new").alias("new"), F.sum("k").alias("k")).first()
        if state["new"] <= SETTLED * state["n"] and state["k"] == grown:
            return lists, links
        grown = state["k"]


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether each two unit rows of x and y reach the threshold."""
    sim = x.astype(np.float32) @ y.astype(np.float32).T
    slack = (x.shape[1] + 4) * 2.0**-23  # over the rounding of a single-precision product of unit vectors
    link = sim >= THRESHOLD + slack
    i, j = np.nonzero((sim >= THRESHOLD - slack) & ~link)
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        link[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= THRESHOLD
    return link


def least_ids(link: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a link matrix, the least id of its component; its own id without links."""
    of_row, of_column = rows.copy(), columns.copy()
    open_row, open_column, turned = link.any(axis=1), link.any(axis=0), np.ascontiguousarray(link.T)
    for first in np.nonzero(open_row)[0]:
        if not open_row[first]:
            continue
        in_row, in_column, new = [], [], np.array([first])
        open_row[first] = False
        while len(new):
            in_row.append(new)
            met = np.nonzero(link[new].any(axis=0) & open_column)[0]
            open_column[met] = False
            in_column.append(met)
            new = np.nonzero(turned[met].any(axis=0) & open_row)[0]
            open_row[new] = False
        i, j = np.concatenate(in_row), np.concatenate(in_column)
        of_row[i] = of_column[j] = min(rows[i].min(), columns[j].min())
    return of_row, of_column


def blocks_of(members: DataFrame) -> DataFrame:
    """members(component, label, length, id, vec, copies) with their block, a long, of one component and TILE at most."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            p = np.zeros((len(length), 8))
            for n in np.unique(length):
                at = np.nonzero(length == n)[0]
                p[at] = _matrix(batch.column("vec").take(pa.array(at))) @ np.random.default_rng(int(n)).normal(size=(int(n), 8))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("component"), *map(pa.array, p.T)], ["id", "component", *(f"p{i}" for i in range(8))])

    sides = checkpointed(members.select("id", "component", "length", "vec").mapInArrow(project, "id long, component long, " + ", ".join(f"p{i} double" for i in range(8))))
    tile = TILE
    middle = sized(checkpointed(sides.groupBy("component").agg(*(F.percentile_approx(f"p{i}", 0.5).alias(f"m{i}") for i in range(8)))))
    code = sum(((F.col(f"p{i}") > F.col(f"m{i}")).cast("int") * (1 << i) for i in range(8)), F.lit(0))
    ordered = sides.join(middle, "component").select("id", "component", code.alias("code"))
    order = ["component", "code", F.xxhash64("id")]
    spread = ordered.repartitionByRange(partitions(members.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, last = -1, 0, None
        for batch in batches:
            out = []
            for c in batch.column("component").to_pylist():
                if c != last or held == tile:
                    block, held, last = block + 1, 0, c
                held += 1
                out.append(block)
            part = batch.column("_part").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((part << 40) + np.array(out, np.int64))], ["id", "block"])

    return checkpointed(members.join(spread.mapInArrow(cut, "id long, block long"), "id"))


def dense_links(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n) link counts of members among each other, copies of others included, and (u, v) edges that connect them."""
    placed = blocks_of(members)
    angle = math.acos(THRESHOLD)

    def describe(part: pa.Table) -> pa.Table:
        x, copies = _matrix(part.column("vec")), part.column("copies").to_numpy()
        centre = x.sum(axis=0)
        centre /= np.linalg.norm(centre) or 1.0
        radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1))) + 1e-7  # over the rounding of an arc cosine
        return pa.table({"label": part.column("label").slice(0, 1), "length": part.column("length").slice(0, 1), "block": part.column("block").slice(0, 1), "centre": pa.array([centre.tolist()]), "radius": [radius], "total": pa.array([int(copies.sum())], pa.int64()), "least": pa.array([min(part.column("id").to_pylist())], pa.int64())})

    kind = dict(members.dtypes)["label"]
    found = checkpointed(placed.groupBy("block").applyInArrow(describe, f"label {kind}, length int, block long, centre array<double>, radius double, total long, least long"))
    a, b = found.alias("a"), found.alias("b")
    dot = F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    between = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    reach = F.col("a.radius") + F.col("b.radius")
    # Blocks of a label meet as their centres, a vector and a few numbers each; a block stands for up to TILE vectors.
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.length") == F.col("b.length")) & (F.col("a.block") <= F.col("b.block")))
    near = checkpointed(pairs.filter(between - reach <= angle).select(F.col("a.block").alias("a"), F.col("b.block").alias("b"), (between + reach <= angle).alias("all"), F.col("a.total").alias("total_a"), F.col("b.total").alias("total_b"), F.col("a.least").alias("least_a"), F.col("b.least").alias("least_b")))
    sure, open_ = near.filter("all"), near.filter("not all")
    one_way = sure.select(F.col("a").alias("block"), F.col("total_b").alias("total"), F.col("least_b").alias("least"))
    other_way = sure.filter("a < b").select(F.col("b").alias("block"), F.col("total_a").alias("total"), F.col("least_a").alias("least"))
    whole = one_way.union(other_way).groupBy("block").agg(F.sum("total").alias("total"), F.min("least").alias("least"))
    own = sure.filter("a = b").select(F.col("a").alias("block"), F.lit(True).alias("own"))
    counted = placed.join(whole, "block").join(own, "block", "left").select("id", (F.col("total") - F.when(F.col("own"), F.col("copies")).otherwise(F.lit(0))).alias("n"), "least")
    tiles = placed.join(open_.select("a", "b").select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")), "block")

    def work(tile: pa.Table) -> pa.Table:
        x, ids, copies, block = _matrix(tile.column("vec")), tile.column("id").to_numpy(), tile.column("copies").to_numpy(), tile.column("block").to_numpy()
        same = tile.column("a")[0] == tile.column("b")[0]
        left = np.nonzero(block == tile.column("a")[0].as_py())[0]
        right = left if same else np.nonzero(block != tile.column("a")[0].as_py())[0]
        link = linked(x[left], x[right]) & (ids[left][:, None] != ids[right][None])
        i, j = np.nonzero(link.any(axis=1))[0], np.nonzero(link.any(axis=0))[0]
        link, left, right = link[np.ix_(i, j)], left[i], right[j]
        of_left, of_right = least_ids(link, ids[left], ids[right])
        n = np.concatenate([link @ copies[right], np.zeros(len(right), np.int64) if same else link.T @ copies[left]])
        return pa.table({"id": pa.array(ids[np.r_[left, right]], pa.int64()), "n": pa.array(n, pa.int64()), "least": pa.array(np.r_[of_left, of_right], pa.int64())})

    every = checkpointed(counted.union(tiles.groupBy("a", "b").applyInArrow(work, "id long, n long, least long")))
    return every.groupBy("id").agg(F.sum("n").alias("n")), every.filter("n > 0 or id != least").select(F.col("id").alias("u"), F.col("least").alias("v"))


def audit(nodes: DataFrame, counts: DataFrame) -> float:
    """The found share of the links of a sample, measured against all nodes: the less of that of nodes with at most K and of others."""
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(AUDIT_MOST).select("id", F.xxhash64("label", "length").alias("group"), "vec").toArrow().combine_chunks()
    if not sample.num_rows:
        return 1.0
    at = {g: np.nonzero(sample.column("group").to_numpy() == g)[0] for g in set(sample.column("group").to_pylist())}
    asked = {g: _matrix(sample.column("vec").take(pa.array(i))) for g, i in at.items()}
    shared = nodes.sparkSession.sparkContext.broadcast((sample.column("id").to_numpy(), at, asked))  # AUDIT_MOST vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, asked = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            groups, copies, own = (batch.column(c).to_numpy() for c in ("group", "copies", "id"))
            for g in set(groups.tolist()) & at.keys():
                rows = np.nonzero(groups == g)[0]
                sim = asked[g] @ _matrix(batch.column("vec").take(pa.array(rows))).T
                total[at[g]] += ((sim >= THRESHOLD) & (ids[at[g]][:, None] != own[rows][None])) @ copies[rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    exact = nodes.select("id", F.xxhash64("label", "length").alias("group"), "vec", "copies").mapInArrow(work, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    both = exact.join(counts.withColumnRenamed("n", "found"), "id", "left").withColumn("found", F.least("n", F.coalesce("found", F.lit(0))))
    row = both.agg(*(F.try_divide(F.sum(F.when(test, F.col("found"))), F.sum(F.when(test, F.col("n")))).alias(c) for c, test in (("few", F.col("n") <= K), ("many", F.col("n") > K)))).first()
    return min(1.0 if row[c] is None else row[c] for c in ("few", "many"))


def link_counts(nodes: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(id, n) of nodes with links, (node, component), and the audited recall of nodes(id, label, length, vec, copies)."""
    spark = nodes.sparkSession
    lists = spark.createDataFrame([], "u long, v long, sim double, new int, k int")
    links = spark.createDataFrame([], "u long, v long")
    for attempt in range(ATTEMPTS):
        first = checkpointed(start(nodes, attempt))
        begun = lists.select("u", "v", "sim", F.lit(0).alias("new"), "k").unionByName(first.select("*", F.lit(1).alias("new"), F.lit(K).alias("k")))
        lists, links = descend(checkpointed(lists_of(begun)), checkpointed(links.union(links_of(first)).distinct()), nodes)
        marks = checkpointed(marks_of(lists))
        weights = nodes.select(F.col("id").alias("v"), "copies")
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        counts, components = both.join(weights, "v").groupBy(F.col("u").alias("id")).agg(F.sum("copies").alias("n")), checkpointed(connected_components(links))
        if not marks.isEmpty():
            dense = sized(checkpointed(components.join(marks, F.col("node") == F.col("u")).select("component").distinct()))
            members = checkpointed(components.join(dense, "component").join(nodes, F.col("node") == F.col("id")).select("component", "label", "length", "id", "vec", "copies"))
            n_dense, edges = dense_links(members)
            counts = counts.join(members.select("id"), "id", "left_anti").union(n_dense)
            # A component stands for its nodes: only what the dense ones' edges join anew is looked at again.
            across = checkpointed(edges.join(components.toDF("u", "_u"), "u").join(components.toDF("v", "_v"), "v").filter("_u != _v").select("_u", "_v").distinct())
            if not across.isEmpty():
                merged = sized(checkpointed(connected_components(across).toDF("component", "_least")))
                components = checkpointed(components.join(merged, "component", "left").select("node", F.coalesce("_least", "component").alias("component")))
        counts = checkpointed(counts)
        recall = audit(nodes, counts)
        if recall >= RECALL:
            return counts, components, recall
    raise RuntimeError(f"only {recall:.3f} of the audited links were found in {ATTEMPTS} attempts")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = usable(vectors)
    nodes = checkpointed(rows.groupBy("label", "length", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "label", "length", "vec", "copies"))
    counts, components, _ = link_counts(nodes)
    of_class = nodes.join(counts, "id", "left").join(components, F.col("id") == F.col("node"), "left").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    found = rows.join(of_class, ["label", "vec"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    kind = dict(vectors.dtypes)["vec_id"]
    joined = vectors.select("vec_id").join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id").cast(kind)
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
