"""Embedding near-duplicates by NN-descent: a neighbour graph refined by local joins.

Neighbours of neighbours find what lies in a neighbourhood, but hardly a pair that lies alone. So
the graph starts from blocks of random projections, in as many tables as leave a pair at the
threshold apart in all of them with probability MISSED only, whatever the number of vectors. Lists
that are full of links are doubled and refined again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlens.llm.common import connected_components, cut, least_labels, table

THRESHOLD = 0.93
#: Neighbours a list holds at first and at most, size of starting blocks, tables that give lists, pieces of a local join.
NEIGHBOURS, LONGEST, BLOCK, TABLES, JOIN = 8, 64, 256, 6, 24
#: Full lists are doubled in components of so many vectors at most; those of larger ones would stay full.
GROUP = 4 * LONGEST
#: Chance that a pair at the threshold shares no starting block. Further tables give links only, no lists.
MISSED = 1e-4
#: The audit compares this many vectors with all others; refinement stops at this recall or after MAX_ROUNDS.
AUDIT, RECALL, MAX_ROUNDS = 256, 0.98, 5
TILE = 512
SEED = 17


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of one batch; all have the length of the first."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _of_one_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, split where they hold vectors of different lengths."""
    for batch in batches:
        if batch.num_rows:
            sizes = batch["vec"].value_lengths().to_numpy()
            if (sizes == sizes[0]).all():
                yield batch
            else:
                for size in np.unique(sizes):
                    yield batch.filter(pa.array(sizes == size))


def _pairs(i: np.ndarray, j: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids[i], ids[j], sims[i, j]


def _best(ids: np.ndarray, unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's ``k`` nearest others of the group, with their cosines."""
    n = len(ids)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2.0)
    k = min(k, n - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < n - 1 else np.array([np.delete(np.arange(n), r) for r in range(n)])
    row = np.repeat(np.arange(n), near.shape[1])
    return _pairs(row, near.ravel(), ids, sims)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Groups of rows that are adjacent and equal in ``names``, in pieces of at most ``most``."""
    held: list[pa.RecordBatch] = []
    last, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[name].to_numpy(zero_copy_only=False) for name in names]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = True
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            this = tuple(k[a] for k in keys)
            if this != last:
                if held:
                    yield held
                held, last, size = [], this, 0
            while a < b:
                step = min(b - a, most - size)
                held.append(batch.slice(a, step))
                a, size = a + step, size + step
                if size == most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _local_joins(keys: list[str], most: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the members of each group and returns each one's best others."""
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for held in _groups(batches, keys, most):
            ids, first = np.unique(np.concatenate([b["id"].to_numpy() for b in held]), return_index=True)
            unit = np.concatenate([_matrix(b["vec"]) for b in held])[first]
            out.append(_best(ids, unit, k))
            size += len(out[-1][0])
            if size > 50_000:
                yield _edges(out)
                out, size = [], 0
        if out:
            yield _edges(out)

    return run


def _edges(parts: list[tuple[np.ndarray, ...]], names: Sequence[str] = ("u", "v", "sim")) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate([p[n] for p in parts])) for n in range(len(names))], list(names))


_EDGES = "u long, v long, sim double"


def _top(edges: DataFrame, size: int) -> DataFrame:
    """The ``size`` best neighbours of each vector, each neighbour once."""
    best = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return distinct.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= size).drop("_n")


def tables_needed(bits: int, threshold: float, missed: float = MISSED) -> int:
    """How many tables of ``bits`` signs a pair at the threshold needs to share a block with probability 1 - missed.

    Vectors at an angle share the sign of a random projection with probability 1 - angle / pi.
    """
    shared = (1 - acos(max(-1.0, min(1.0, threshold))) / pi) ** bits
    return TABLES if shared >= 1 else max(TABLES, ceil(log(missed) / log(1 - shared)))


def _block_joins(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compares the members of each block: their ``k`` best others, of further tables only links; with the table's parity."""
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for held in _groups(batches, ["g"], 4 * BLOCK):
            ids, first = np.unique(np.concatenate([b["id"].to_numpy() for b in held]), return_index=True)
            unit = np.concatenate([_matrix(b["vec"]) for b in held])[first]
            table_ = held[0]["table"][0].as_py()
            u, v, sim = _best(ids, unit, k)
            if table_ >= TABLES:
                near = sim >= threshold
                u, v, sim = u[near], v[near], sim[near]
            out.append((u, v, sim, np.full(len(u), table_ % 2, np.int32)))
            size += len(u)
            if size > 50_000:
                yield _edges(out, ["u", "v", "sim", "odd"])
                out, size = [], 0
        if out:
            yield _edges(out, ["u", "v", "sim", "odd"])

    return run


def start_graph(nodes: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """First neighbour lists, and ``(odd, even)`` for each link of vectors with fewer than a list: which half of the tables has found it.

    Vectors of one label meet in blocks of the signs of random projections. The blocks are as fine
    as leaves about BLOCK vectors of the largest label in each; a fuller one is dealt out by hash.
    """
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, ceil(log2(max(1, largest) / BLOCK)))
    tables = tables_needed(bits, threshold)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _of_one_length(batches):
            unit = _matrix(batch["vec"])
            random = np.random.default_rng(SEED).standard_normal((tables, unit.shape[1], max(1, bits)))
            code = np.zeros((len(unit), tables), np.int64)
            for t in range(tables if bits else 0):
                code[:, t] = ((unit @ random[t] > 0) * (1 << np.arange(bits))).sum(axis=1)
            code += np.arange(tables) << bits
            yield pa.record_batch([batch["label"], batch["id"], pa.array(list(code), pa.list_(pa.int64()))], ["label", "id", "codes"])

    label = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("label", "id", "vec").mapInArrow(signs, f"label {label}, id long, codes array<long>")
    spread = cut(coded.select("label", "id", F.explode("codes").alias("code")))
    full = spread.groupBy("label", "code").count().where(F.col("count") > 2 * BLOCK).select("label", "code", F.ceil(F.col("count") / BLOCK).alias("parts"))
    dealt = (
        spread.join(full, ["label", "code"], "left")
        .withColumn("part", F.pmod(F.xxhash64("id", "code"), F.coalesce("parts", F.lit(1))))
        .join(nodes.select("id", "vec"), "id")
        .select(F.xxhash64("label", "code", "part").alias("g"), F.shiftright("code", bits).cast("int").alias("table"), "id", "vec")
    )
    edges = cut(dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_block_joins(size, threshold), f"{_EDGES}, odd int"))
    each = edges.where(F.col("sim") >= threshold).groupBy("u", "v").agg(F.max("odd").alias("odd"), (1 - F.min("odd")).alias("even"))
    open_ = each.withColumn("_n", F.count("*").over(Window.partitionBy("u"))).where(F.col("_n") < size)  # a full block list hides links from its half
    halves = cut(open_.select("odd", "even"))
    return cut(_top(edges, size)), halves


def found_share(halves: DataFrame) -> float | None:
    """Share of all links that starting blocks have found, from how often one half of the tables finds what the other has; None without links.

    The halves' projections are independent, so of the links that one half finds the other finds as
    large a share as of all links, the isolated ones too, which a sample of vectors hardly holds.
    """
    n = halves.agg(*[F.count_if(x) for x in ((F.col("odd") == 1), (F.col("even") == 1), (F.col("odd") + F.col("even") == 2))]).first()
    if not n[0] or not n[1]:
        return None if not n[0] + n[1] else 0.0
    return 1 - (1 - n[2] / n[1]) * (1 - n[2] / n[0])


def refine(graph: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One round of NN-descent: the neighbours of each vector, forward and reverse, meet each other.

    A vector's neighbours are joined in pieces of at most JOIN, so that one with very many
    reverse neighbours is no large group.
    """
    around = graph.select(F.col("u").alias("c"), F.col("v").alias("id")).union(graph.select(F.col("v").alias("c"), F.col("u").alias("id"))).distinct()
    counted = graph.groupBy(F.col("v").alias("c")).count().where(F.col("count") > JOIN).select("c", F.ceil(F.col("count") / JOIN).alias("parts"))
    own = nodes.select(F.col("id").alias("c"), "id")
    met = (
        around.join(counted, "c", "left")
        .withColumn("part", F.pmod(F.xxhash64("id", "c"), F.coalesce("parts", F.lit(1))))
        .select("c", "part", "id").union(own.select("c", F.lit(0).cast("long"), "id"))
        .join(nodes.select("id", "vec"), "id")
        .select(F.xxhash64("c", "part").alias("g"), "id", "vec")
    )
    found = met.repartition("g").sortWithinPartitions("g", "id").mapInArrow(_local_joins(["g"], 2 * JOIN, max(4, size // 2)), _EDGES)
    return cut(_top(graph.union(found), size))


def sampled_links(nodes: DataFrame, linked: DataFrame, threshold: float) -> DataFrame:
    """``(u, n, weight)``: of AUDIT vectors, compared with all vectors, the linked nodes and their copies.

    Half of them are drawn from all vectors, half from linked(id), those with a link so far, so that
    there are links to be counted if there are any at all.
    """
    wanted = nodes.select("id", "label", "vec").orderBy(F.xxhash64("id")).limit(AUDIT // 2)
    known = linked.select("id").distinct().orderBy(F.xxhash64("id")).limit(AUDIT // 2)
    asked = wanted.union(nodes.select("id", "label", "vec").join(known, "id", "left_semi")).dropDuplicates(["id"]).collect()  # a bounded sample
    ids = np.array([r["id"] for r in asked])
    labels, lengths = np.array([r["label"] for r in asked]), np.array([len(r["vec"]) for r in asked])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _of_one_length(batches):
            others, matrix = batch["id"].to_numpy(), _matrix(batch["vec"])
            own = np.flatnonzero(lengths == matrix.shape[1])
            if len(own):
                unit = _unit(np.array([asked[k]["vec"] for k in own], np.float64))
                near = (unit @ matrix.T >= threshold) & (labels[own][:, None] == batch["label"].to_numpy()[None, :]) & (ids[own][:, None] != others[None, :])
                weight = near @ batch["copies"].to_numpy()
                yield pa.record_batch([pa.array(ids[own]), pa.array(near.sum(axis=1).astype(np.int64)), pa.array(weight.astype(np.int64))], ["u", "n", "weight"])

    found = nodes.select("id", "label", "vec", "copies").mapInArrow(links, "u long, n long, weight long")
    return cut(found.groupBy("u").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).where("n > 0"))


def audit(graph: DataFrame, wanted: DataFrame, threshold: float, size: int) -> float | None:
    """Share of the sampled vectors' links that the graph's lists hold; None if they have no link.

    A list that is full of links holds what it can: only min(links, length) links are asked of
    it here. What it can't hold is found in longer lists or tiles and asked for by ``final_audit``.
    """
    lists = graph.join(wanted, "u").where(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("held"))
    sums = wanted.join(lists, "u", "left").agg(F.sum(F.least("n", F.lit(size))).alias("n"), F.sum(F.least(F.coalesce("held", F.lit(0)), F.lit(size))).alias("held")).first()
    return None if not sums["n"] else sums["held"] / sums["n"]


def final_audit(counted: DataFrame, wanted: DataFrame) -> float | None:
    """The mean, over the sampled vectors with links, of the share of all their links that ``counted(u, links)`` has; None without such."""
    share = F.coalesce("links", F.lit(0)) / F.col("weight")
    return wanted.join(counted, "u", "left").agg(F.avg(share).alias("share")).first()["share"]


def neighbour_graph(graph: DataFrame, nodes: DataFrame, wanted: DataFrame, threshold: float, size: int = NEIGHBOURS) -> DataFrame:
    """Neighbour lists, refined at least twice and until the audit finds the recall asked for, if it finds a link."""
    for done in range(1, MAX_ROUNDS + 1):
        graph = refine(graph, nodes, size)
        share = audit(graph, wanted, threshold, size) if done >= 2 else 0.0
        if share is None or share >= RECALL:
            break
    return graph


def enlarged(graph: DataFrame, nodes: DataFrame, threshold: float, only: DataFrame, size: int = NEIGHBOURS, most: int = LONGEST) -> tuple[DataFrame, int]:
    """The graph with the lists of only(u) doubled where all they hold are links, and refined again, and the length they have come to.

    Each time only the vectors with full lists and their neighbours meet again, until no list is
    full or all have ``most`` neighbours.
    """
    while size < most:
        near = graph.where(F.col("sim") >= threshold)
        full = cut(near.groupBy("u").count().where(F.col("count") >= size).select("u").join(only, "u", "left_semi"))
        if full.isEmpty():
            break
        size *= 2
        around = cut(full.union(near.join(full, "u", "left_semi").select("v")).distinct())
        own = cut(graph.join(around, "u", "left_semi"))
        members = cut(nodes.join(around.withColumnRenamed("u", "id"), "id", "left_semi"))
        met = own
        for _ in range(2):
            met = refine(met, members, size)
        graph = cut(graph.join(around, "u", "left_anti").union(_top(own.union(met), size)))
    return graph, size


def _tile_links(threshold: float, weight: str):
    """With ``weight`` 'copies', rows link by their cosine. With 'reach', each stands for all vectors
    within that angle of it, and rows link unless the triangle inequality rules out a link of theirs."""

    def linked(left: np.ndarray, right: np.ndarray, reach_left: np.ndarray, reach_right: np.ndarray) -> np.ndarray:
        sims = left @ right.T
        if weight == "copies":
            return sims >= threshold
        return np.arccos(np.clip(sims, -1, 1)) <= np.arccos(threshold) + reach_left[:, None] + reach_right[None, :] + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (g, lo, hi) hold one tile or two: links of each row, and a forest over components."""
        for held in _groups(batches, ["g", "lo", "hi"], 1 << 30):
            ids, own, side, weights = (np.concatenate([b[n].to_numpy() for b in held]) for n in ("id", "component", "side", weight))
            unit = np.concatenate([_matrix(b["vec"]) for b in held])
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = np.zeros((len(ids), len(ids)), bool)
            if len(right):
                near[np.ix_(left, right)] = linked(unit[left], unit[right], weights[left], weights[right])
                near |= near.T
            else:
                near = linked(unit, unit, weights, weights)
                np.fill_diagonal(near, False)
            root = least_labels(*np.nonzero(near), len(ids))
            yield pa.record_batch([pa.array(ids), pa.array(own), pa.array(own[root]), pa.array((near @ weights).astype(np.int64))], ["u", "a", "b", "links"])

    return run


def _dense_links(members: DataFrame, nodes: DataFrame, threshold: float, weight: str = "copies") -> DataFrame:
    """``(u, a, b, links)``: the members(id, component, g) of each group g compared tile by tile.

    The enlarged list of a vector is its whole group. The group is dealt into tiles; each pair of
    tiles is one group of rows; links are counted, and of their pairs only a forest is kept, as
    links (a, b) of the components that the members are in so far.
    """
    sizes = members.groupBy("g").count().select("g", F.ceil(F.col("count") / TILE).alias("tiles"))
    placed = members.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda t: F.struct(F.least("own", t).alias("lo"), F.greatest("own", t).alias("hi"), F.when(F.col("own") <= t, 0).otherwise(1).alias("side")),
    )
    dealt = (
        placed.select("g", "id", "component", F.explode(pairs).alias("x")).select("g", "id", "component", "x.lo", "x.hi", "x.side")
        .join(nodes.select("id", "vec", weight), "id")
    )
    return dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(_tile_links(threshold, weight), "u long, a long, b long, links long")


def _reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest angle between a component's first vector and its members in each batch."""
    for batch in _of_one_length(batches):
        cosines = (_matrix(batch["vec"]) * _matrix(batch["first"])).sum(axis=1)
        own, place = np.unique(batch["component"].to_numpy(), return_inverse=True)
        reach = np.zeros(len(own))
        np.maximum.at(reach, place, np.arccos(np.clip(cosines, -1, 1)))
        yield pa.record_batch([pa.array(own), pa.array(reach)], ["id", "reach"])


def _meeting(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """members(id, component) with the group ``g`` of components that must be compared with each other.

    Lists that are full hold nothing of other components, so these may link all the same. The
    first vectors of a label's components are compared in tiles; components whose members can't
    link, as their first vectors lie too far apart for how far the members reach, needn't meet.
    """
    vecs = nodes.select("id", "vec")
    firsts = members.select("component").distinct().join(nodes.select(F.col("id").alias("component"), "label", F.col("vec").alias("first")), "component")
    spread = members.join(vecs, "id").join(firsts.drop("label"), "component").select("component", "vec", "first")
    reach = spread.mapInArrow(_reaches, "id long, reach double").groupBy("id").agg(F.max("reach").alias("reach"))
    balls = cut(firsts.select(F.col("component").alias("id"), "label", F.col("first").alias("vec")).join(reach, "id"))
    near = _dense_links(balls.select("id", F.col("id").alias("component"), F.col("label").alias("g")), balls, threshold, "reach")
    meet = connected_components(near.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("g"))
    return members.join(meet, "component", "left").select("id", "component", F.coalesce("g", "component").alias("g"))


def _joined(groups: DataFrame, compared: DataFrame) -> DataFrame:
    """groups(node, component) after the links (a, b) between components."""
    merged = connected_components(compared.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return groups.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label, ...): ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold``.
    Equal vectors of a label are one node with a number of copies, which link with one another.
    Vectors that are null, empty, zero or hold null or non-finite components, and those without a
    label, link with nothing. Vectors of different lengths never meet. Null vec_ids are never a
    component's smallest id; rows that repeat a vec_id count as copies; other columns are ignored;
    an empty table gives no rows.
    """
    vec = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(
        F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select("vec_id", "label", F.when(usable, F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).alias("vec"))
    keyed = rows.withColumn("key", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec")))
    # equal vectors of a label: the smallest hash pair stands for them, so copies need no comparison
    nodes = cut(
        keyed.where("vec is not null").groupBy("key", "label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("id", F.xxhash64("key", F.size("vec"), F.hash("vec")))
        .withColumn("label", F.xxhash64("label", F.size("vec")))
    )
    start, halves = start_graph(nodes, NEIGHBOURS, threshold)
    known = found_share(halves)
    wanted = sampled_links(nodes, start.where(F.col("sim") >= threshold).select(F.col("u").alias("id")), threshold)
    graph = neighbour_graph(start, nodes, wanted, threshold)
    linked = lambda near: near.select("u", "v").union(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    links = cut(linked(graph.where(F.col("sim") >= threshold)))
    groups = cut(connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    # saturated lists: as many links as a list is long. Longer lists find what else a group links with, if it isn't large
    small = groups.groupBy("component").count().where(F.col("count") <= GROUP).select("component")
    growing = cut(groups.join(small, "component").select(F.col("node").alias("u")))
    graph, longest = enlarged(graph, nodes, threshold, growing)
    near = graph.where(F.col("sim") >= threshold)
    if longest > NEIGHBOURS:
        links = cut(linked(near))
        every = nodes.select(F.col("id").alias("node")).join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        ends = links.join(every.select(F.col("node").alias("u"), F.col("component").alias("a")), "u").join(every.select(F.col("node").alias("v"), F.col("component").alias("b")), "v")
        met = cut(_joined(every, ends.where("a <> b")))
        groups = met.join(links.select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    # refined lists still miss a few links of a group; those groups are small or go to the tiles anyway, so all are compared whole
    full = near.groupBy("u").count().where(F.col("count") >= NEIGHBOURS).select(F.col("u").alias("node"))
    dense = groups.join(full, "node", "left_semi").select("component").distinct()
    members = cut(groups.join(dense, "component").select(F.col("node").alias("id"), "component"))
    compared = cut(_dense_links(_meeting(members, nodes, threshold), nodes, threshold))
    copies = nodes.select(F.col("id").alias("v"), "copies")
    loose = links.join(groups.join(dense, "component", "left_anti").select(F.col("node").alias("u")), "u", "left_semi")
    counted = cut(
        loose.join(copies, "v").groupBy("u").agg(F.sum("copies").alias("links"))
        .union(compared.groupBy("u").agg(F.sum("links").alias("links")))
    )
    shares = [share for share in (known, final_audit(counted, wanted)) if share is not None]  # without any link nothing was missed but by MISSED
    if min(shares, default=1.0) < RECALL:  # too much is missing: each label is compared whole
        groups = nodes.select(F.col("id").alias("node"), F.col("id").alias("component"))
        compared = cut(_dense_links(nodes.select("id", F.col("id").alias("component"), F.col("label").alias("g")), nodes, threshold))
        counted = compared.groupBy("u").agg(F.sum("links").alias("links"))
    groups = _joined(groups, compared)
    rooted = cut(
        nodes.join(counted.withColumnRenamed("u", "id"), "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
        .select("id", "key", "label", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    )
    least = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "component").select("id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    own = keyed.withColumn("id", F.when(F.col("key").isNotNull(), F.xxhash64("key", F.size("vec"), F.hash("vec")))).select("vec_id", "id")
    return (
        own.join(named, "id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op8_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
