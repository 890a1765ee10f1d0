"""Near duplicates among vectors by NN-descent on a neighbour graph.

Equal vectors are one node. Nodes close to one another are then gathered into
balls: sorted by the signs of random projections, each block of neighbours is
compared within, and a node within half the threshold's angle of an earlier one
joins it. Any two members of a ball link, by the triangle inequality for angles,
so that they need no comparison, however many they are. Where chains of such
steps lead too far from the ball's centre, nodes leave it again.

What is left, the centres, gets a neighbour graph. It starts from blocks sorted
by random projections. In each round every centre's neighbours and those that
have it as neighbour are compared with each other (a hub's in portions of bounded
size, dealt anew each round), and each keeps the best few. A list whose last
entry may still link is saturated and is doubled. After each round the graph is
audited: a bounded sample of centres is compared with all; where it misses links, the next
round also starts the graph anew beside the old. Rounds end when the
audit finds at least ``RECALL`` of the links, no list is saturated and the last
round brought hardly any new link; pairs that the audit finds are kept.

Edges of the graph are decided in double precision. For a pair of balls the
distance and radii decide where they can; otherwise members are compared in
blocks, and only counts leave a block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are components of their own; shorter vectors are
filled with zeros; equal vectors link, whatever their ids; rows of one id are rows
of their own; rows with a null id take part, their component's id is the smallest
that is not null, and a component of such rows alone has a null id and keeps its
rows; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mapped, stored
from .jaccard import _groups, components

THRESHOLD = 0.9
#: Rows of a sorted block that are compared with each other; each row is in two.
BLOCK = 256
#: Sorted passes that gather balls at most, and that start the graph.
GATHERINGS, STARTS = 6, 3
#: Neighbours of a list at first, members of a portion of a hub's neighbours, rounds at most.
NEIGHBOURS, PORTION, MAX_ROUNDS = 10, 48, 12
#: Nodes of the audit, the recall asked for, and the share of new links below which a round counts as the last.
AUDITED, RECALL, GAINED = 4096, 0.99, 0.005
#: Above what rounding can change in a cosine of doubles, and of single precision.
SLACK, SLACK32 = 1e-9, 1e-5
#: Bits of the sorted projections.
SIGNS = 40


def _units(size: int):
    """Each row's direction as doubles and the 128-bit name of its bytes; null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            length = np.diff(np.asarray(lists.offsets))
            x = np.zeros((len(lists), size))
            x[np.arange(size) < length[:, None]] = np.asarray(lists.flatten())
            largest = np.abs(x).max(1, initial=0)
            ok = largest > 0
            x[ok] /= largest[ok, None]
            x[ok] /= np.sqrt((x[ok] * x[ok]).sum(1))[:, None]
            x += 0.0  # no negative zeros: equal vectors have equal bytes
            unit = pa.array([r.tobytes() if good else None for r, good in zip(x, ok)], pa.binary())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "vec_id": batch.column("vec_id"), "unit": unit})

    return run


def directions(vectors: DataFrame, size: int) -> DataFrame:
    """row (a number of its own), vec_id, unit and name of each row; unit and name are null for rows that link with nothing."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, x).otherwise(F.array().cast("array<double>")).alias("x"))
    return stored(rows.transform(mapped, _units(size), "row long, vec_id long, unit binary").withColumn("name", F.unhex(F.md5("unit"))), "directions")


def _matrix(column, kind=np.float64) -> np.ndarray:
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1).astype(kind) if cells else np.zeros((0, 1), kind)


def _coded(seed: int):
    """Signs of random projections as a number, the first one highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("unit"))
            planes = np.random.default_rng(seed).normal(size=(x.shape[1], SIGNS)) if planes is None else planes
            code = ((x @ planes > 0) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)).sum(1)
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "unit": batch.column("unit"), "code": pa.array(code, pa.int64())})

    return run


def in_order(points: DataFrame, seed: int) -> DataFrame:
    """``points`` (node, unit) sorted by projections; ranges split equal codes too."""
    coded = points.select("node", "unit").transform(mapped, _coded(seed), "node long, unit binary, code long")
    return coded.repartitionByRange("code", "node").sortWithinPartitions("code", "node")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and units of overlapping blocks of a sorted partition."""
    node, unit, fresh = np.zeros(0, np.int64), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        more = _matrix(batch.column("unit"), np.float32)
        node, unit = np.concatenate([node, np.asarray(batch.column("node"))]), more if unit is None else np.concatenate([unit, more])
        fresh += batch.num_rows
        while len(node) >= BLOCK:
            yield node[:BLOCK], unit[:BLOCK]
            node, unit = node[BLOCK // 2 :], unit[BLOCK // 2 :]
            fresh = len(node) - BLOCK // 2
    if fresh > 0 and len(node) > 1:
        yield node, unit


def _gather(half: float):
    """(node, leader): nodes that an earlier node of their block is near enough to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the block before, which shares half its rows: nodes that joined, and leaders, which stay in this pass.
        gone, leaders = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for node, unit in _windows(batches):
            near = unit @ unit.T >= half
            order = np.argsort(node)
            rank = np.empty(len(node), np.int64)
            rank[order] = np.arange(len(node))
            free, may_join = ~np.isin(node, gone), ~np.isin(node, leaders)
            leader = np.full(len(node), -1)
            for i in order[near.sum(1)[order] > 1].tolist():
                if free[i]:
                    taken = near[i] & free & may_join & (rank > rank[i])
                    leader[taken] = i
                    free[taken] = False
            joined = np.flatnonzero(leader >= 0)
            gone, leaders = node[joined], np.concatenate([leaders[np.isin(leaders, node)], node[leader[joined]]])
            yield pa.RecordBatch.from_pydict({"node": pa.array(node[joined]), "leader": pa.array(node[leader[joined]])})

    return run


def gathered(points: DataFrame, threshold: float) -> DataFrame | None:
    """(node, leader) of the nodes that lie in another's ball, after a few passes; None if there are none.

    A leader may join another in a later pass; its nodes follow.
    """
    half = float(np.sqrt((1 + threshold) / 2)) + SLACK32
    left, home, total = points, None, 0
    for seed in range(GATHERINGS):
        joined = stored(in_order(left, seed).transform(mapped, _gather(half), "node long, leader long"), "joined")
        n = joined.count()
        if not n:
            discard(joined)
            break
        left = stored(left.join(joined, "node", "left_anti").select("node", "unit"), "left")
        if home is None:
            home = joined
        else:
            next_ = joined.select(F.col("node").alias("leader"), F.col("leader").alias("next"))
            last, home = home, stored(home.join(next_, "leader", "left").select("node", F.coalesce("next", "leader").alias("leader")).union(joined), "home")
            discard(last, joined)
        total += n
        if n <= GAINED * total:
            break
    return home


def _centred(half: float):
    """Cosines of nodes with their leaders, and whether they stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cos = np.clip((_matrix(batch.column("unit")) * _matrix(batch.column("centre"))).sum(1), -1, 1)
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "unit": batch.column("unit"), "copies": batch.column("copies"), "leader": pa.array(np.where(cos >= half, np.asarray(batch.column("leader")), np.asarray(batch.column("node")))), "angle": pa.array(np.where(cos >= half, np.arccos(cos), 0.0))})

    return run


_MEMBERS = "node long, unit binary, copies long, leader long, angle double"


def balls(points: DataFrame, threshold: float) -> DataFrame:
    """node, unit, copies, leader and angle to it of each of ``points`` (node, unit, copies); a node alone is its own leader."""
    home = gathered(points, threshold)
    alone = points.select("node", "unit", "copies", F.col("node").alias("leader"), F.lit(0.0).alias("angle"))
    if home is None:
        return stored(alone, "members")
    centres = points.select(F.col("node").alias("leader"), F.col("unit").alias("centre")).hint("merge")
    met = points.join(home, "node").join(centres, "leader")  # a large ball's rows are split by the skew join
    half = float(np.sqrt((1 + threshold) / 2)) + SLACK
    return stored(met.transform(mapped, _centred(half), _MEMBERS).union(alone.join(home.select("node"), "node", "left_anti")), "members")


# ---- the graph ----------------------------------------------------------------------------------------------------------

_EDGES = "node long, nbr long, cos float"


def _best_pairs(cos: np.ndarray, node: np.ndarray, most: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its ``most`` best others with a cosine over ``above``."""
    cos = cos.copy()
    np.fill_diagonal(cos, -2)
    k = min(int(most.max()), len(node) - 1)
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(node) - 1 else np.argsort(-cos, axis=1)[:, :k]
    value = np.take_along_axis(cos, top, 1)
    order = np.argsort(-value, axis=1)
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    i, j = np.nonzero((value > above[:, None]) & (np.arange(k) < most[:, None]))
    return node[i], node[top[i, j]], value[i, j]


def _edges(pairs) -> pa.RecordBatch:
    a, b, c = (np.concatenate(x) for x in zip(*pairs))
    return pa.RecordBatch.from_pydict({"node": pa.array(a, pa.int64()), "nbr": pa.array(b, pa.int64()), "cos": pa.array(c, pa.float32())})


def _start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for node, unit in _windows(batches):
        yield _edges([_best_pairs(unit @ unit.T, node, np.full(len(node), NEIGHBOURS), np.full(len(node), -2.0))])


def _join_around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each portion of a hub's neighbours that are better for each other than the ends of their lists."""
    pairs, n = [], 0
    for group in _groups(batches, ["hub", "portion"]):
        if len(group) < 2:
            continue
        unit = _matrix(group.column("unit"), np.float32)
        node, most, above = (group.column(c).to_numpy() for c in ("node", "most", "least"))
        pairs.append(_best_pairs(unit @ unit.T, node, most, above))
        n += len(pairs[-1][0])
        if n > 50_000:
            yield _edges(pairs)
            pairs, n = [], 0
    if pairs:
        yield _edges(pairs)


def _shorten(edges: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Each node's best neighbours: as many as its list's size, ``NEIGHBOURS`` if it has none in ``sizes``."""
    once = edges.groupBy("node", "nbr").agg(F.max("cos").alias("cos"))
    once = once.withColumn("most", F.lit(NEIGHBOURS)) if sizes is None else once.join(sizes, "node", "left").withColumn("most", F.coalesce("most", F.lit(NEIGHBOURS)))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cos"), "nbr"))
    return once.withColumn("rank", rank).where("rank <= most").select("node", "nbr", "cos", "most")


def descend(lists: DataFrame, points: DataFrame, seed: int) -> DataFrame:
    """Candidates (node, nbr, cos) from one neighbours-of-neighbours join over ``lists``."""
    ends = lists.groupBy("node").agg(F.first("most").alias("most"), F.when(F.count("*") >= F.first("most"), F.min("cos")).otherwise(F.lit(-2.0)).cast("double").alias("least"))
    both = lists.select(F.col("node").alias("hub"), F.col("nbr").alias("node")).union(lists.select(F.col("nbr").alias("hub"), "node")).distinct()
    counts = both.groupBy("hub").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    dealt = both.join(counts, "hub").withColumn("portion", F.when(F.col("portions") == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("node", F.lit(seed)), "portions")).cast("long"))
    known = points.select("node", "unit").join(ends, "node", "left").select("node", "unit", F.coalesce("most", F.lit(NEIGHBOURS)).alias("most"), F.coalesce("least", F.lit(-2.0)).alias("least"))
    rows = dealt.join(known.hint("merge"), "node").select("hub", "portion", "node", "unit", "most", "least")
    return rows.repartition("hub", "portion").sortWithinPartitions("hub", "portion").transform(mapped, _join_around, _EDGES)


def _audit(held, widest: float, threshold: float):
    """All pairs of the sample with others that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, unit, radius = held.value
        least = np.arccos(threshold) + SLACK
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                node, r = np.asarray(part.column("node")), np.asarray(part.column("radius"))
                cos = _matrix(part.column("unit"), np.float32) @ unit.T
                a, b = np.nonzero(cos >= np.cos(min(np.pi, least + widest + r.max(initial=0))) - SLACK32)
                near = (np.arccos(np.clip(cos[a, b], -1, 1)) <= least + r[a] + radius[b] + SLACK32) & (node[a] != own[b])
                a, b = a[near], b[near]
                yield _edges([(own[b], node[a], cos[a, b])])

    return run


def graph(points: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Near pairs (a, b, cos) of ``points`` (node, unit, radius): those whose balls may hold a link."""
    spark = points.sparkSession
    angle = float(np.arccos(threshold))
    widest = points.agg(F.max("radius")).first()[0] or 0.0
    radii = points.where("radius > 0").select("node", "radius")
    sample = points.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(AUDITED).toArrow()
    held = spark.sparkContext.broadcast((sample.column("node").to_numpy(), _matrix(sample.column("unit"), np.float32), sample.column("radius").to_numpy()))
    truth = stored(points.transform(mapped, _audit(held, widest, threshold), _EDGES), "audit")
    n_true = truth.count()

    def near(edges: DataFrame) -> DataFrame:
        """Pairs whose balls may hold a link."""
        met = edges.where(F.col("cos") >= F.lit(float(np.cos(min(np.pi, angle + 2 * widest))) - SLACK32)).select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b"), "cos")
        met = met.groupBy("a", "b").agg(F.max("cos").alias("cos"))
        for c in ("a", "b"):
            met = met.join(radii.select(F.col("node").alias(c), F.col("radius").alias(f"radius_{c}")), c, "left")
        reach = F.lit(angle) + F.coalesce("radius_a", F.lit(0.0)) + F.coalesce("radius_b", F.lit(0.0))
        return met.where(F.acos(F.least(F.col("cos").cast("double"), F.lit(1.0))) <= reach + SLACK32).select("a", "b", "cos")

    def sorted_pass(seed: int) -> DataFrame:
        return in_order(points, 100 + seed).transform(mapped, _start, _EDGES)

    lists = stored(_shorten(reduce(DataFrame.union, map(sorted_pass, range(STARTS))), None), "lists")
    found, n_found = stored(near(lists), "near"), 0
    n_found = found.count()
    audited = truth.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    enough = True
    for seed in range(MAX_ROUNDS):
        ends = lists.groupBy("node").agg(F.count("*").alias("n"), F.min("cos").alias("least"), F.first("most").alias("most")).join(radii, "node", "left")
        full = (F.col("n") >= F.col("most")) & (F.acos(F.least(F.col("least").cast("double"), F.lit(1.0))) <= F.lit(angle + widest) + F.coalesce("radius", F.lit(0.0)))
        sizes = stored(ends.select("node", F.when(full, F.col("most") * 2).otherwise(F.col("most")).alias("most"), full.alias("full")).where(F.col("most") > NEIGHBOURS), "sizes")
        grown = sizes.where("full").count()
        candidates = descend(lists.drop("most").join(sizes.drop("full"), "node", "left").withColumn("most", F.coalesce("most", F.lit(NEIGHBOURS))), points, seed)
        if not enough:  # parts of the graph may have no edge between them; another start can join them
            candidates = candidates.union(sorted_pass(STARTS + seed))
        last, lists = lists, stored(_shorten(lists.select("node", "nbr", "cos").union(candidates), sizes.drop("full")), "lists")
        older, found = found, stored(near(found.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "cos").union(lists.select("node", "nbr", "cos"))), "near")
        n, n_before = found.count(), n_found
        n_found = n
        met = audited.join(found, ["a", "b"], "left_semi").count()
        n_audited = audited.count() if n_true else 0
        discard(last, older, sizes)
        enough = met >= recall * n_audited
        if enough and not grown and n_found - n_before <= GAINED * n_found:
            break
    out = stored(near(found.select(F.col("a").alias("node"), F.col("b").alias("nbr"), "cos").union(truth)), "near")
    held.unpersist()
    discard(lists, found, truth)
    return out


# ---- links ---------------------------------------------------------------------------------------------------------------


def _compared(threshold: float):
    """Counts of links of each member with the other ball's block, and the balls that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["a", "b", "x", "y"]):
            side = group.column("side").to_numpy()
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(one) or not len(two):
                continue
            unit, node, copies = _matrix(group.column("unit")), group.column("node").to_numpy(), group.column("copies").to_numpy()
            linked = unit[one] @ unit[two].T >= threshold
            count = np.concatenate([linked @ copies[two], linked.T @ copies[one]])
            nodes = np.concatenate([node[one], node[two]])
            some = count > 0
            if some.any():
                k = int(some.sum())
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.full(k, group.column("a")[0].as_py())), "b": pa.array(np.full(k, group.column("b")[0].as_py())), "node": pa.array(nodes[some]), "n": pa.array(count[some].astype(np.int64))})

    return run


def links(near: DataFrame, members: DataFrame, points: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Pairs (a, b) of linking balls, and (node, n) further links of members with those of other balls."""
    angle = float(np.arccos(threshold))
    sides = near
    for c in ("a", "b"):
        sides = sides.join(points.select(F.col("node").alias(c), F.col("radius").alias(f"radius_{c}"), F.col("members").alias(f"members_{c}"), F.col("weight").alias(f"weight_{c}")), c)
    far = F.acos(F.least(F.col("cos").cast("double"), F.lit(1.0)))
    # Single precision decides only where it is well inside.
    sure = far + F.col("radius_a") + F.col("radius_b") <= F.lit(angle - 0.01)
    sides = stored(sides.withColumn("sure", sure), "sides")
    blocks = lambda c: F.ceil(F.col(f"members_{c}") / BLOCK)
    open_pairs = sides.where("not sure").select("a", "b", blocks("a").alias("blocks_a"), blocks("b").alias("blocks_b"))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    def side(own: str, other: str, number: int) -> DataFrame:
        """Members of one ball in their block, once for each block of the other."""
        rows = open_pairs.select("a", "b", f"blocks_{own}", f"blocks_{other}").join(members.select(F.col("leader").alias(own), "node", "unit", "copies").hint("merge"), own)
        place = F.pmod(F.xxhash64("node"), F.col(f"blocks_{own}"))
        x, y = (place, upto(f"blocks_{other}")) if number == 0 else (upto(f"blocks_{other}"), place)
        return rows.select("a", "b", x.alias("x"), y.alias("y"), F.lit(number).alias("side"), "node", "unit", "copies")

    dealt = side("a", "b", 0).union(side("b", "a", 1)).repartition("a", "b", "x", "y").sortWithinPartitions("a", "b", "x", "y")
    counted = stored(dealt.transform(mapped, _compared(threshold), "a long, b long, node long, n long"), "counted")
    linked = counted.select("a", "b").distinct().union(sides.where("sure").select("a", "b"))
    whole = sides.where("sure").select(F.col("a").alias("leader"), F.col("weight_b").alias("n")).union(sides.where("sure").select(F.col("b").alias("leader"), F.col("weight_a").alias("n"))).groupBy("leader").agg(F.sum("n").alias("n"))
    more = members.select("node", "leader").join(whole, "leader").select("node", "n").union(counted.select("node", "n")).groupBy("node").agg(F.sum("n").alias("n"))
    return linked, more, [sides, counted]


def classes(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding)."""
    size = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 1)
    rows = directions(vectors, size)
    nodes = stored(rows.where("unit IS NOT NULL").groupBy("name").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("unit").alias("unit")), "nodes")
    members = balls(nodes.select("node", "unit", "copies"), threshold)
    sizes = members.groupBy("leader").agg(F.max("angle").alias("radius"), F.count("*").alias("members"), F.sum("copies").alias("weight"))
    points = stored(members.where("node = leader").select("node", "unit").join(sizes.withColumnRenamed("leader", "node"), "node"), "points")
    near = graph(points, threshold)
    linked, more, used = links(near, members, points, threshold)
    labels = components(linked)
    of_node = members.select("node", "leader").join(points.select(F.col("node").alias("leader"), "weight"), "leader").join(labels.withColumnRenamed("node", "leader"), "leader", "left")
    of_node = stored(of_node.join(more, "node", "left").select("node", F.coalesce("label", "leader").alias("label"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "labelled")
    named = nodes.select("name", "node", "least").join(of_node, "node")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = rows.where("name IS NOT NULL").select("vec_id", "name").join(named.select("name", "label", "n_links"), "name").join(least, "label")
    lone = rows.where("name IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.select("vec_id", "n_links", "component_id").union(lone)
    out = stored(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())), "classes")
    discard(rows, nodes, members, points, near, labels, of_node, *used)
    return out
