"""Hierarchical communities of the entity graph, their reports and summaries.

Levels come from repeated rounds of local moving on the modularity of weighted undirected edges, each round on the
graph of the communities before. All nodes decide at once: in each move, a half of them, drawn by a hash of name and
move, go to the neighbouring community of largest gain. A round ends when no node would gain, or PATIENCE moves in a
row have not raised modularity; the best labelling it saw stands, so modularity never falls. Rounds end when nothing
merges. The rule is one for every size: graphs of up to SMALL_EDGES edges are solved in one task, larger ones over edges
that stay where they lie during a round, with the same arithmetic and the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kairoscope.operators.graph import internal_facts
from kairoscope.sources.store import discard, materialize

#: Edges up to which a graph is solved in one task; the result does not depend on it.
SMALL_EDGES = 200_000
#: Nodes up to which a move sends their labels, two numbers each, to all tasks; beyond, edges are shuffled to them.
SENT_NODES = 8_000_000
#: Names up to which a table with a row for each is sent to all tasks.
SENT_NAMES = 2_000_000
#: Edges of a round, in both directions, that lie in one task.
TASK_EDGES = 1_000_000
#: Moves without a gain of LEAST_GAIN in modularity after which a round ends.
PATIENCE, LEAST_GAIN = 4, 1e-9


def detect(weights: DataFrame, nodes: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(level, entity_key, community: the smallest member): every entity at every level; isolated ones are alone.

    weights (a, b, weight), a < b; nodes (entity_key). Level 0 is the finest. Weights are whole numbers.
    """
    if weights.limit(small + 1).count() > small:
        return _distributed(weights, nodes, small)
    rows = weights.select("a", "b", F.col("weight").cast("double").alias("w")).unionByName(nodes.select(F.col("entity_key").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w")))
    return _in_one_task(rows, True)


def _in_one_task(rows: DataFrame, first: bool) -> DataFrame:
    """(level, entity_key, community) of rows (a, b, w), where b is null for a node alone. first: as in solved()."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf[pdf.b.notna()]
        found = solved(list(linked[["a", "b", "w"]].itertuples(index=False, name=None)), sorted({*pdf.a, *linked.b}), first)
        return pd.DataFrame([(k, n, c) for k, level in enumerate(found) for n, c in level.items()], columns=["level", "entity_key", "community"])

    # at most `small` edges meet in one task
    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(solve, "level int, entity_key string, community string")


class _Round:
    """What both ways of solving share: which labelling of a round stands, and when the round is over."""

    def __init__(self) -> None:
        self.best, self.quality, self.idle = None, -np.inf, 0

    def over(self, label, quality: float, wanted: bool) -> bool:
        """Take note of a labelling; whether no further move is to be made. wanted: whether some node would gain."""
        if quality > self.quality + LEAST_GAIN:
            self.best, self.quality, self.idle = label, quality, 0
        else:
            self.idle += 1
        return not wanted or self.idle >= PATIENCE


def solved(edges: list[tuple[str, str, float]], nodes: list[str], first: bool = True) -> list[dict[str, str]]:
    """Per level, the community (named by its smallest member) of every node. first: there is at least one level, even if
    nothing merges."""
    of, levels = {n: n for n in nodes}, []
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    number = {n: i for i, n in enumerate(names)}
    a, b, w = (np.array([number[e[0]] for e in edges], np.int64), np.array([number[e[1]] for e in edges], np.int64), np.array([e[2] for e in edges], np.float64))
    n, m, w = np.append(a, b), np.append(b, a), np.append(w, w)
    loops = np.bincount(n[n == m], w[n == m], len(names)) / 2
    n, m, w = n[n != m], m[n != m], w[n != m]
    while names:
        degree = np.bincount(n, w, len(names)) + loops
        total = degree.sum() or 1.0
        ended, label = _Round(), np.arange(len(names))
        for move, (near, to) in enumerate(_moves(n, m, w, degree, total, lambda: label)):
            mass = np.bincount(label, degree, len(names))
            if ended.over(label, (near.sum() + loops.sum()) / total - (mass * mass).sum() / (total * total), bool((to != label).any())):
                break
            label = np.array([t if t != h and _turn(names[i], move) else h for i, (t, h) in enumerate(zip(to.tolist(), label.tolist()))])
        kept, group = np.unique(ended.best, return_inverse=True)
        least = np.full(len(kept), len(names))
        np.minimum.at(least, group, np.arange(len(names)))  # names are sorted
        if (levels or not first) and len(kept) == len(names):
            break
        of = {x: names[least[group[number[c]]]] if c in number else c for x, c in of.items()}
        levels.append(dict(of))
        if len(kept) == len(names):
            break
        order = np.argsort(least)  # communities in the order of their names
        place = np.empty(len(kept), np.int64)
        place[order] = np.arange(len(kept))
        group = place[group]
        inner = group[n] == group[m]
        loops = np.bincount(group, loops, len(kept)) + np.bincount(group[n[inner]], w[inner], len(kept))
        pairs, at = np.unique(group[n[~inner]] * len(kept) + group[m[~inner]], return_inverse=True)
        n, m, w = pairs // len(kept), pairs % len(kept), np.bincount(at, w[~inner], len(pairs))
        names = [names[i] for i in least[order]]
        number = {x: i for i, x in enumerate(names)}
    return levels or ([dict(of)] if first else [])


def _moves(n: np.ndarray, m: np.ndarray, w: np.ndarray, degree: np.ndarray, total: float, current) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the current labels, again and again: the weight between each node and its community, and the best community for it."""
    size, every = len(degree), np.arange(len(degree))
    while True:
        label = current()
        mass = np.bincount(label, degree, size)
        keys, at = np.unique(np.append(n * size + label[m], every * size + label), return_inverse=True)
        near = np.bincount(at, np.append(w, np.zeros(size)), len(keys))
        node, c = keys // size, keys % size
        stay = c == label[node]
        gain = near - degree[node] * (mass[c] - np.where(stay, degree[node], 0.0)) / total
        order = np.lexsort((c, stay, gain, node))
        last = order[np.append(node[order][1:] != node[order][:-1], True)]
        yield near[stay], c[last]


def _turn(name: str, move: int) -> bool:
    return hashlib.md5(f"{name}:{move}".encode()).hexdigest() < "8"


def _distributed(weights: DataFrame, nodes: DataFrame, small: int) -> DataFrame:
    """solved() over edges between numbers in the order of names. Once few edges are left between communities, one task
    solves the rest."""
    names, many = _numbered(nodes.select(F.col("entity_key").alias("name")).union(weights.select(F.explode(F.array("a", "b")))).distinct())
    own = materialize(names.join(nodes.select(F.col("entity_key").alias("name")).distinct(), "name", "left_semi").select("name", "n"), "own")
    at = lambda end: sent(names.select(F.col("name").alias(end), F.col("n").alias(f"n_{end}")), many)
    pairs = materialize(weights.join(at("a"), "a").join(at("b"), "b").select("n_a", "n_b", F.col("weight").cast("bigint").alias("w")), "edges")
    both = pairs.where("n_a <> n_b").select(F.inline(F.array(F.struct(F.col("n_a").alias("n"), F.col("n_b").alias("m"), "w"), F.struct(F.col("n_b").alias("n"), F.col("n_a").alias("m"), "w"))))
    loops = pairs.where("n_a = n_b").groupBy(F.col("n_a").alias("n")).agg(F.sum("w").alias("w"))
    return (_packed_rounds if many <= SENT_NODES else _shuffled_rounds)(both, loops, names, many, own, small)


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df, for tasks to have as a whole if its rows are few enough."""
    return F.broadcast(df) if rows <= SENT_NAMES else df


def _numbered(names: DataFrame) -> tuple[DataFrame, int]:
    """names with n, without gaps from 0 in their order, and how many there are."""
    # the number holds the partition in its upper bits and the place in it in the lower 33
    ranged = materialize(names.orderBy("name").withColumn("_id", F.monotonically_increasing_id()), "names")
    part = F.shiftright("_id", 33).alias("_part")
    counts = sorted(map(tuple, ranged.groupBy(part).count().collect()))  # a row a partition
    starts = np.cumsum([0, *[n for _, n in counts]]).tolist()
    before = ranged.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(counts, starts)], "_part bigint, _before bigint")
    numbered = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return materialize(numbered.select("name", (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias("n")), "names"), starts[-1]


def _packed_rounds(both: DataFrame, loops: DataFrame, names: DataFrame, many: int, own: DataFrame, small: int) -> DataFrame:
    """The levels of own (name, n). A round's edges lie packed by node; a move sends all tasks two numbers a node, its label
    and the mass of the community so named, and hears of the labels that change: no row is shuffled or written."""
    context, out, level, of, live = names.sparkSession.sparkContext, None, 0, np.arange(many), names
    both = both.unionByName(loops.select("n", F.col("n").alias("m"), "w"))  # a loop is an edge to itself
    while True:
        if out is not None and (rest := _rest(both.where("n <> m"), both.where("n = m").select("n", "w"), names, small)) is not None:
            above = _labelled(own, of).join(names.select(F.col("n").alias("c"), F.col("name").alias("below")), "c").join(rest, "below")
            return out.unionByName(above.select((F.col("level") + level).alias("level"), F.col("name").alias("entity_key"), "community"))
        packed, degree, inner = _packed(both, live), np.zeros(many), 0
        for r in packed.select("nodes", "d", "loops").toLocalIterator():  # two numbers a node
            degree[np.frombuffer(r.nodes, np.int32)] = np.frombuffer(r.d, np.int64)
            inner += int(np.frombuffer(r.loops, np.int64).sum())
        total = degree.sum() or 1.0
        ended, label, move, degrees = _Round(), np.arange(many, dtype=np.int32), 0, context.broadcast(degree)
        while True:
            mass = np.bincount(label, degree, many)
            now = context.broadcast((label, mass))
            told = packed.mapInArrow(_mover(now, degrees, total, move), "near double, wanted boolean, n binary, c binary").collect()  # of each node at most its number and label
            now.destroy()
            if ended.over(label, (sum(r.near for r in told) + inner) / total - (mass * mass).sum() / (total * total), any(r.wanted for r in told)):
                break
            label, move = label.copy(), move + 1
            for r in told:
                label[np.frombuffer(r.n, np.int32)] = np.frombuffer(r.c, np.int32)
        kept, least = np.unique(ended.best, return_index=True)
        group = np.zeros(many, np.int64)
        group[kept] = least  # a community's smallest number
        group = group[ended.best]
        alone = bool((group == np.arange(many)).all())
        if out is not None and alone:
            packed.unpersist()
            return out
        of = group[of]
        found = _labelled(own, of).join(names.select(F.col("n").alias("c"), F.col("name").alias("community")), "c")
        found = materialize(found.select(F.lit(level).alias("level"), F.col("name").alias("entity_key"), "community"), "communities")
        out = found if out is None else out.unionByName(found)
        if not alone:
            merged = packed.mapInArrow(_merger(context.broadcast(group)), "n bigint, m bigint, w bigint")
            both = materialize(merged.groupBy("n", "m").agg(F.sum("w").alias("w")), "edges")
        packed.unpersist()
        degrees.destroy()
        if alone:
            return out
        live, level = _labelled(names, of).where("n = c").drop("c"), level + 1


def _labelled(df: DataFrame, of: np.ndarray) -> DataFrame:
    """df with c, what `of` holds at its n."""
    held = df.sparkSession.sparkContext.broadcast(of)

    def look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held.value[rows.column("n").to_numpy()])], [*rows.schema.names, "c"])

    return df.mapInArrow(look, StructType([*df.schema.fields, StructField("c", LongType())]))


def _packed(both: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row a task, kept: nodes (n, name) in order with their degrees, and the edges (n, m, w) of both as the place of n
    among them, m and w; each node has an edge of weight 0 to itself, and its loops lie apart."""
    rows = both.count() + nodes.count()
    parts = max(both.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_EDGES))
    none = F.lit(None)
    rows = both.select("n", "m", "w", none.cast("string").alias("name")).unionByName(nodes.select("n", none.cast("bigint").alias("m"), none.cast("bigint").alias("w"), "name"))

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (parts := list(parts)):
            return
        table = pa.Table.from_batches(parts)
        is_node = table["m"].is_null()
        own = table.filter(is_node).sort_by("n")
        nodes, edges = own["n"].to_numpy().astype(np.int32), table.filter(pa.compute.invert(is_node))
        n, m, w = (edges[x].to_numpy() for x in ("n", "m", "w"))
        at, loop = np.searchsorted(nodes, n), n == m
        loops = np.bincount(at[loop], w[loop], len(nodes)).astype(np.int64)
        at, m, w = np.append(at[~loop], np.arange(len(nodes))), np.append(m[~loop], nodes), np.append(w[~loop], np.zeros(len(nodes), np.int64))
        d = loops + np.bincount(at, w, len(nodes)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        lists = [nodes, d, loops, at[order].astype(np.int32), m[order].astype(np.int32), w[order]]
        yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in lists], pa.array([own["name"].to_pylist()], pa.list_(pa.string()))], ["nodes", "d", "loops", "at", "m", "w", "names"])

    packed = rows.repartition(parts, "n").mapInArrow(pack, "nodes binary, d binary, loops binary, at binary, m binary, w binary, names array<string>").persist(StorageLevel.MEMORY_AND_DISK)
    packed.count()
    return packed


def _unpacked(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for rows in parts:
        for r in range(rows.num_rows):
            at = lambda c: np.frombuffer(rows.column(c)[r].as_buffer(), np.int64 if c in ("loops", "w") else np.int32)  # noqa: E731, B023
            yield *map(at, ("nodes", "loops", "at", "m", "w")), rows.column("names")[r]


def _mover(now: Broadcast, degrees: Broadcast, total: float, move: int):
    """What a task tells of its nodes in a move: the weight between them and their communities, whether one would gain,
    and those whose turn it is with their new communities. The arithmetic is that of _moves()."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, mass = now.value
        size = len(label)
        for nodes, _, at, m, w, names in _unpacked(parts):
            keys = at.astype(np.int64) * size + label[m]
            order = np.argsort(keys)
            keys = keys[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            near = np.add.reduceat(w[order], starts).astype(np.float64)
            node, c = np.divmod(keys[starts], size)
            stay, d = c == label[nodes][node], degrees.value[nodes][node]
            gain = near - d * (mass[c] - np.where(stay, d, 0.0)) / total
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            best = np.maximum.reduceat(gain, first)[node]
            # of equal gains the own community, then the largest number
            to = np.maximum.reduceat(np.where(gain == best, c + size * stay, -1), first) % size
            gains = np.flatnonzero(to != label[nodes])
            moved = [i for i in gains.tolist() if _turn(names[i].as_py(), move)]
            told = [near[stay].sum(), len(gains) > 0, nodes[moved].tobytes(), to[moved].astype(np.int32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in told], ["near", "wanted", "n", "c"])

    return run


def _merger(group: Broadcast):
    """Edges between communities, those of a task added up; both directions of an inner edge are loops."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, loops, at, m, w, _ in _unpacked(parts):
            own = group.value[nodes]
            n, m, w = np.append(own[at], own), np.append(group.value[m], own), np.append(w, loops)
            keys, place = np.unique(n * len(group.value) + m, return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, place, w)
            kept = sums > 0
            n, m = np.divmod(keys[kept], len(group.value))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n, m, sums[kept])], ["n", "m", "w"])

    return run


def _shuffled_rounds(both: DataFrame, loops: DataFrame, names: DataFrame, many: int, own: DataFrame, small: int) -> DataFrame:
    """As _packed_rounds, for nodes too many to be sent: a round's edges lie by node, kept in that order; what a move tells
    them is a row of numbers a node, which it writes to the shared folder."""
    of = own.select("name", F.col("n").alias("c"))
    out, level = None, 0
    while True:
        if out is not None and (rest := _rest(both, loops, names, small)) is not None:
            above = of.join(names.select(F.col("n").alias("c"), F.col("name").alias("below")), "c").join(rest, "below")
            return out.unionByName(above.select((F.col("level") + level).alias("level"), F.col("name").alias("entity_key"), "community"))
        ended, inner = _Round(), loops.agg(F.sum("w")).first()[0] or 0
        edges, round_nodes, total, several = _laid_out(both, loops, names)
        label, move, written = round_nodes.select("n", F.col("n").alias("c"), "d"), 0, []
        while True:
            mass = materialize(label.groupBy("c").agg(F.sum("d").alias("mass")), "mass")
            moved = materialize(_move(edges, round_nodes, label.join(mass, "c"), total, move, several), "label")
            sums = moved.agg(F.sum("near"), F.coalesce(F.max(F.col("to") != F.col("home")), F.lit(False))).crossJoin(mass.agg(F.sum(F.col("mass").cast("double") * F.col("mass"))))  # one row each
            near, wanted, square = sums.first()
            discard(mass)
            over = ended.over(label, ((near or 0) + inner) / total - (square or 0.0) / (total * total), wanted)
            for old in [x for x in written if x is not ended.best]:
                discard(old)
            if over:
                break
            label, move, written = moved, move + 1, [*[x for x in written if x is ended.best], moved]
        edges.unpersist()
        new = ended.best.groupBy("c").agg(F.min("n").alias("to"))
        new = materialize(ended.best.select("n", "c").join(new, "c").select(F.col("n").alias("c"), "to"), "communities")
        round_nodes.unpersist()
        alone = new.where("c <> to").isEmpty()
        if out is not None and alone:
            return out
        of = materialize(of.join(new, "c", "left").select("name", F.coalesce("to", "c").alias("c")), "communities")
        found = of.join(names.select(F.col("n").alias("c"), F.col("name").alias("community")), "c").select(F.lit(level).alias("level"), F.col("name").alias("entity_key"), "community")
        out = found if out is None else out.unionByName(found)
        if alone:
            return out
        to = lambda c: new.select(F.col("c").alias(c), F.col("to").alias(f"{c}2"))
        merged = materialize(both.join(to("n"), "n").join(to("m"), "m").groupBy(F.col("n2").alias("n"), F.col("m2").alias("m")).agg(F.sum("w").alias("w")), "edges")
        inside = merged.where("n = m").select("n", "w").unionByName(loops.join(to("n"), "n").select(F.col("n2").alias("n"), "w"))
        loops = materialize(inside.groupBy("n").agg(F.sum("w").alias("w")), "loops")
        both, level = merged.where("n <> m"), level + 1


def _laid_out(both: DataFrame, loops: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, float, bool]:
    """A round's edges (n, m, w, d: the degree of n), with one of weight 0 from each node to itself, and nodes (n, name,
    d), both kept by n; twice the weight of all; whether the labels are too many to be sent to all tasks."""
    degree = materialize(both.select("n", "w").unionByName(loops.select("n", "w")).groupBy("n").agg(F.sum("w").alias("d")), "degree")
    total, n_nodes = degree.agg(F.sum("d"), F.count("*")).first()
    rows = both.count() + n_nodes
    parts = max(both.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_EDGES))
    loose = both.join(degree, "n").unionByName(degree.select("n", F.col("n").alias("m"), F.lit(0).cast("bigint").alias("w"), "d"))
    lying = lambda df: df.repartition(parts, "n").sortWithinPartitions("n").persist(StorageLevel.MEMORY_AND_DISK)
    edges, nodes = lying(loose), lying(degree.join(names, "n"))
    for kept in (edges, nodes):
        kept.count()  # only what is kept already is known to lie by n
    return edges, nodes, float(total or 1), n_nodes > SENT_NODES


def _move(edges: DataFrame, nodes: DataFrame, label: DataFrame, total: float, move: int, several: bool) -> DataFrame:
    """(n, home, to, c, d, near): the best community of each node and, if it is its turn, its new one. Nothing but labels
    (n, c, mass) is moved, unless they are too many."""
    there = label.select(F.col("n").alias("m"), "c", "mass")
    met = edges.join(there if several else F.broadcast(there), "m")
    offers = met.groupBy("n", "d", "c", "mass").agg(F.sum("w").alias("near"), F.max(F.col("m") == F.col("n")).alias("stay"))
    d, mass = F.col("d").cast("double"), F.col("mass").cast("double")
    gain = F.col("near").cast("double") - d * (mass - F.when(F.col("stay"), d).otherwise(0.0)) / F.lit(total)
    best = offers.groupBy("n", "d").agg(F.max(F.struct(gain.alias("g"), "stay", "c")).alias("b"), F.max(F.when(F.col("stay"), F.col("c"))).alias("home"), F.max(F.when(F.col("stay"), F.col("near"))).alias("near"))
    turn = F.md5(F.concat("name", F.lit(f":{move}")).cast("binary")) < "8"
    return best.join(nodes.select("n", "name"), "n").select("n", "home", F.col("b.c").alias("to"), F.when(turn, F.col("b.c")).otherwise(F.col("home")).alias("c"), "d", "near")


def _rest(both: DataFrame, loops: DataFrame, names: DataFrame, small: int) -> DataFrame | None:
    """(level from 0, below, community): the levels above a graph of at most `small` edges, else None."""
    if both.where("n < m").limit(small + 1).count() > small:
        return None
    at = lambda end: names.select(F.col("n").alias(end), F.col("name").alias("a" if end == "n" else "b"))
    ends = both.where("n < m").unionByName(loops.select("n", F.col("n").alias("m"), "w"))
    rows = ends.join(at("n"), "n").join(at("m"), "m").select("a", "b", F.col("w").cast("double").alias("w"))
    return _in_one_task(rows, False).withColumnRenamed("entity_key", "below")


def identified(levels: DataFrame) -> DataFrame:
    """(community_id, level, entity_key): id from the level and a hash of the sorted members."""
    groups = levels.groupBy("level", "community").agg(F.array_sort(F.collect_set("entity_key")).alias("members"))
    name = F.concat(F.lit("L"), F.col("level"), F.lit("-"), F.substring(F.sha1(F.array_join("members", "\0")), 1, 12))
    return groups.select(name.alias("community_id"), "level", F.explode("members").alias("entity_key"))


def parents(members: DataFrame) -> DataFrame:
    """(community_id, parent_id): levels nest, so any one member finds the community above."""
    one = members.groupBy("community_id", "level").agg(F.min("entity_key").alias("entity_key"))
    above = members.select(F.col("community_id").alias("parent_id"), (F.col("level") - 1).alias("level"), "entity_key")
    return one.join(above, ["level", "entity_key"], "left").select("community_id", "parent_id")


def reports(members: DataFrame, named: DataFrame, entities: DataFrame, most_facts: int = 80, most_names: int = 6) -> DataFrame:
    """(community_id, level, member_count, report, content_hash, videos). Title of the first names, then a line for each
    of the first facts inside the community. named: edges with subject and object."""
    named_members = members.join(entities.select("entity_key", "canonical_name"), "entity_key")
    first = W.partitionBy("community_id", "level").orderBy("canonical_name", "entity_key")  # the limit goes before its shuffle
    few = named_members.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most_names)
    few = few.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "canonical_name"))), lambda x: x["canonical_name"]).alias("names"))
    names = named_members.groupBy("community_id", "level").agg(F.count("*").alias("member_count")).join(few, "community_id")
    line = F.format_string("- %s — %s — %s (%s, %.1f-%.1f)", "subject", "predicate", "object", "video_id", "start_timestamp", "end_timestamp")
    inside = internal_facts(named, members, most_facts).groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("video_id", "start_timestamp", "edge_key", line.alias("line")))).alias("lines"), F.array_sort(F.collect_set("video_id")).alias("videos"))
    rows = names.join(inside, "community_id", "left")
    lines = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>"))
    title = F.array_join("names", "، ")
    rows = rows.withColumn("report", F.array_join(F.concat(F.array(title), lines), "\n"))
    return rows.select("community_id", "level", "member_count", "report", F.sha2("report", 256).alias("content_hash"), F.coalesce("videos", F.array().cast("array<string>")).alias("videos"))


def with_summaries(reported: DataFrame, summaries: DataFrame, model_id: str) -> DataFrame:
    """Reports with the summary that this model made of just this content; null where there is none."""
    own = summaries.where(F.col("model_id") == model_id).select("community_id", "content_hash", "summary")
    return reported.join(own, ["community_id", "content_hash"], "left")


def missing_summaries(reported: DataFrame, summaries: DataFrame, model_id: str) -> DataFrame:
    return reported.join(summaries.where(F.col("model_id") == model_id), ["community_id", "content_hash"], "left_anti")


def in_scope(reported: DataFrame, members: DataFrame, edges: DataFrame, video_id: str | Column | None = None, level: int | None = None) -> DataFrame:
    """Communities with any member at an end of an edge of the video, by level and size, largest first."""
    if video_id is not None:
        ends = edges.where(F.col("video_id") == video_id).select(F.explode(F.array("subject_key", "object_key")).alias("entity_key")).distinct()
        reported = reported.join(members.join(ends, "entity_key", "left_semi").select("community_id").distinct(), "community_id", "left_semi")
    if level is not None:
        reported = reported.where(F.col("level") == level)
    return reported.orderBy(F.desc("level"), F.desc("member_count"), "community_id")


def modularities(weights: DataFrame, levels: DataFrame) -> list[float]:
    """The modularity of every entity on its own, then of each level in order; none without edges. Edges meet their ends'
    communities, as numbers, at all levels at once."""
    last = levels.agg(F.max("level")).first()[0]
    if last is None:
        return []
    ids, many = _numbered(levels.where("level = 0").select(F.col("entity_key").alias("name")))
    of = levels.join(sent(ids.select(F.col("name").alias("community"), F.col("n").alias("c")), many), "community")
    of = of.groupBy("entity_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "c"))), lambda x: x["c"]).alias("cs"))
    of = of.join(ids.withColumnRenamed("name", "entity_key"), "entity_key")
    of = materialize(of.select("entity_key", F.concat(F.array("n"), "cs").alias("cs")), "levels")
    at = lambda end: sent(of.select(F.col("entity_key").alias(end), F.col("cs").alias(f"cs_{end}")), many)
    rows = weights.join(at("a"), "a").join(at("b"), "b")
    same = lambda k: F.sum(F.when(F.get("cs_a", F.lit(k)) == F.get("cs_b", F.lit(k)), F.col("weight")).otherwise(0))
    total, *inside = rows.agg(F.sum("weight"), *[same(k) for k in range(last + 2)]).first()
    if not total:
        return []
    degree = weights.select(F.inline(F.array(F.struct(F.col("a").alias("entity_key"), "weight"), F.struct(F.col("b").alias("entity_key"), "weight")))).groupBy("entity_key").agg(F.sum("weight").alias("d"))
    mass = degree.join(of, "entity_key").select(F.posexplode("cs").alias("k", "c"), "d").groupBy("k", "c").agg(F.sum("d").cast("double").alias("d"))
    square = {r.k: r.s for r in mass.groupBy("k").agg(F.sum(F.col("d") * F.col("d")).alias("s")).collect()}
    return [i / total - square[k] / (4.0 * total * total) for k, i in enumerate(inside)]


def modularity(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: modularity of labels (entity_key, community) over weights (a, b, weight)."""
    at = lambda c: labels.select(F.col("entity_key").alias(c), F.col("community").alias(f"c_{c}"))
    rows = weights.join(at("a"), "a").join(at("b"), "b")
    total = rows.agg(F.sum("weight").alias("t"), F.sum(F.when(F.col("c_a") == F.col("c_b"), F.col("weight")).otherwise(0)).alias("inside"))
    mass = rows.select(F.inline(F.array(F.struct(F.col("c_a").alias("c"), "weight"), F.struct(F.col("c_b").alias("c"), "weight")))).groupBy("c").agg(F.sum("weight").alias("d"))
    return mass.agg(F.sum(F.col("d") * F.col("d")).alias("square")).crossJoin(total).select((F.col("inside") / F.col("t") - F.col("square") / (4 * F.col("t") * F.col("t"))).alias("modularity"))
