"""Approximate nearest neighbours by NN-descent and greedy graph search.

The index is a graph: every vector knows the ``NEAREST`` closest ones found so far. It
starts from blocks of vectors that lie together under random projections, and is
improved by joins: a vector's neighbours, and those that have it as a neighbour, meet at
it and are compared with each other, since a neighbour's neighbour is often a neighbour.
Only pairs with a new member meet again, and only what beats a vector's worst neighbour
is sent back. A reverse list keeps its ``NEAREST`` closest; the links beyond it stay in
the forward lists.

A query starts at its own vector and expands the closest vectors it has not expanded,
``EXPANDED`` in a round at first and twice as many in each later one, until the ``BEAM``
closest it knows are expanded. The graph is read from a table bucketed by vector, so a
round shuffles only what the queries ask. Among many near copies a beam moves on for long;
what is left to expand there is expanded at once, as each round has its fixed cost.

Equal vectors are one node. Codes of one byte per component serve build and search; the
results are scored on the original vectors in double precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from solvenza.llm.common import written
from solvenza.session import shared_dir

NEAREST = 24        # neighbours of a vector in the graph
BLOCK = 2048        # vectors compared with each other at the start, at most
LEAST_BLOCK, PARTS = 64, 8      # and at most a part of all, unless they are very few
PROJECTIONS = 4     # orders in which they are blocked
ENOUGH = 0.02       # share of new links below which improvement ends
BEAM, EXPANDED = 256, 64
RESCORED = 64       # of a beam, by the original vectors
TOP = 5
SEED = 7


# --- helpers for tasks -----------------------------------------------------------

def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold only whole runs of the first column, from sorted ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0 and held and held[0].column(0)[0].as_py() == keys[-1]:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, last)]
        if sum(b.num_rows for b in done):
            yield pa.concat_batches(done)
        held = [batch.slice(last)]
    if held:
        yield pa.concat_batches(held)


def _cuts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))


def _bytes(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """A binary column of equal sizes as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _unit(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _best(ids: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` closest distinct ids; of equal ids the first place counts."""
    order = np.lexsort((ids, -sims))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:n]]


def _list_column(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


# --- nodes -----------------------------------------------------------------------

def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """vec_id, vec (array<double>) and key of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_column).alias("vec_id"), v.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists(v, lambda x: x != 0)
    )
    # 0.0 and -0.0 are one value.
    plain = F.transform("vec", lambda x: x + F.lit(0.0))
    kept = kept.withColumn("vec", plain)
    return kept.withColumn("key", F.concat_ws("-", F.xxhash64("vec"), F.xxhash64(F.lit(SEED), "vec")))


def _code(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, _ = _lists(batch.column(1))
                x = values.reshape(-1, dimension)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                codes = np.rint(x * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["node", "vec", "code"],
                )
    return run


GRAPH = "node bigint, ids array<bigint>, sims array<float>, fresh array<boolean>"


def _graph_batch(rows: list[tuple]) -> pa.RecordBatch:
    nodes, ids, sims, fresh = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(nodes, pa.int64()), _list_column(list(ids), pa.int64()),
        _list_column(list(sims), pa.float32()), _list_column(list(fresh), pa.bool_()),
    ], names=["node", "ids", "sims", "fresh"])


def _blocked(dimension: int, nearest: int, block: int):
    """Closest neighbours of each vector in its block; rows (node, code) in the order of
    a projection."""
    def pairs(nodes: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        x = _unit(codes)
        sims = x @ x.T
        np.fill_diagonal(sims, -np.inf)
        n = min(nearest, len(nodes) - 1)
        near = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n else np.empty((len(nodes), 0), int)
        return _graph_batch([
            (u, nodes[p], s, np.ones(n, bool))
            for u, p, s in zip(nodes, near, np.take_along_axis(sims, near, 1))
        ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, codes = np.empty(0, np.int64), np.empty((0, dimension), np.int8)
        for batch in batches:
            if batch.num_rows:
                nodes = np.concatenate([nodes, batch.column(0).to_numpy()])
                codes = np.concatenate([codes, _bytes(batch.column(1), np.int8, dimension)])
            while len(nodes) >= 2 * block:
                yield pairs(nodes[:block], codes[:block])
                nodes, codes = nodes[block:], codes[block:]
        if len(nodes):
            yield pairs(nodes, codes)

    return run


def _merged(links: DataFrame, nearest: int) -> DataFrame:
    """One row per node with its closest distinct neighbours, the closest first; of links
    that several rows have, an old one keeps being old."""
    one = links.repartition("node").select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("l"))
    one = one.groupBy("node", F.col("l.ids").alias("id")).agg(
        F.max(F.struct(F.col("l.sims").alias("sim"), (~F.col("l.fresh")).alias("old"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("b.sim"), "id"))
    best = one.withColumn("r", rank).filter(F.col("r") <= nearest).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("r", "id", "b"))).alias("best"))
    return best.select(
        "node", F.col("best.id").alias("ids"), F.col("best.b.sim").alias("sims"),
        F.transform("best", lambda x: ~x["b"]["old"]).alias("fresh"))


def _start(nodes: DataFrame, n: int, dimension: int, nearest: int, block: int) -> DataFrame:
    """Links within blocks under several random projections, merged."""
    random = np.random.default_rng(SEED)
    bits = max(1, int(np.ceil(np.log2(max(2, n / block)))) + 1)
    found = None
    for _ in range(PROJECTIONS):
        planes = random.standard_normal((bits + 1, dimension))
        # Leading signs put vectors of one direction together, the last projection
        # orders those of equal signs, so blocks are equal in size whatever the data.
        dots = [_dot(F.col("vec"), p) for p in planes]
        signs = F.concat(*[F.when(d > 0, F.lit("1")).otherwise(F.lit("0")) for d in dots[:-1]])
        placed = nodes.select("node", "code", signs.alias("s"), dots[-1].alias("d"))
        ordered = placed.repartitionByRange("s", "d", "node").sortWithinPartitions("s", "d", "node")
        near = ordered.select("node", "code").mapInArrow(_blocked(dimension, nearest, block), GRAPH)
        found = near if found is None else found.unionByName(near)
    return written(_merged(found, nearest), "nn-graph")


def _dot(vector: Column, plane: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(x)) for x in plane])
    return F.aggregate(F.zip_with(vector, weights, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)


def _members(graph: DataFrame, codes: DataFrame, nearest: int) -> DataFrame:
    """(at, node, fresh, worst, code): who meets at each node, and the similarity that a
    new neighbour of theirs must beat."""
    worst = F.when(F.size("sims") >= nearest, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float")
    known = graph.join(codes, "node").select("node", "ids", "sims", "fresh", worst.alias("worst"), "code")
    links = graph.select("node", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("l")).select(
        F.col("node").alias("at"), F.col("l.ids").alias("node"), F.col("l.fresh").alias("fresh")
    )
    forward = links.join(known.select("node", "worst", "code"), "node").select("at", "node", "fresh", "worst", "code")
    back = known.select("node", "worst", F.explode(F.arrays_zip("ids", "sims", "fresh")).alias("l"))
    back = back.select(
        F.col("l.ids").alias("at"), "node", F.col("l.fresh").alias("fresh"), "worst", F.col("l.sims").alias("sim")
    )
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("sim"), "node"))
    back = back.withColumn("r", rank).filter(F.col("r") <= nearest).drop("r", "sim")
    return forward.unionByName(back.join(codes, "node").select("at", "node", "fresh", "worst", "code"))


def _met(dimension: int):
    """Compares the members of each node; for each the others that beat its worst."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = batch.column(2).to_numpy(zero_copy_only=False)
            worst, units = batch.column(3).to_numpy(), _unit(_bytes(batch.column(4), np.int8, dimension))
            rows, cuts = [], _cuts(keys)
            for a, b in zip(cuts[:-1], cuts[1:]):
                if not fresh[a:b].any():
                    continue
                x, ids, new = units[a:b], nodes[a:b], fresh[a:b]
                sims = x @ x.T
                good = (sims > worst[a:b, None]) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
                for i in np.flatnonzero(good.any(axis=1)):
                    j = np.flatnonzero(good[i])
                    rows.append((ids[i], ids[j], sims[i, j], np.ones(len(j), bool)))
            if rows:
                yield _graph_batch(rows)
    return run


def build(nodes: DataFrame, n: int, dimension: int, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """The neighbour graph of the nodes (node, vec, code): node, ids, sims, fresh.

    Rounds go on until few links are new. Every round a link is either kept or gives way to
    a closer one, so they end; usually after about as many as log2(n) / 2.
    """
    codes = nodes.select("node", "code")
    graph = _start(nodes, n, dimension, nearest, min(block, max(LEAST_BLOCK, n // PARTS)))
    while True:
        met = _members(graph, codes, nearest).repartition("at").sortWithinPartitions("at")
        better = met.mapInArrow(_met(dimension), GRAPH)
        old = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
        graph = written(_merged(old.unionByName(better), nearest), "nn-graph")
        share = graph.agg(
            F.try_divide(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("ids")))
        ).first()[0]
        if not share or share < ENOUGH:
            return graph


# --- search ----------------------------------------------------------------------

STATE = "node bigint, code binary, ids array<bigint>, sims array<float>, expanded array<boolean>"


def _adjacent(dimension: int):
    """One row per node with the ids and codes of all that meet at it, and itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            keys, nodes, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_pylist()
            ids, joined, cuts = [], [], _cuts(keys)
            for a, b in zip(cuts[:-1], cuts[1:]):
                one, first = np.unique(nodes[a:b], return_index=True)
                ids.append(one)
                joined.append(b"".join(codes[a + i] for i in first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[cuts[:-1]]), _list_column(ids, pa.int64()), pa.array(joined, pa.binary())],
                names=["at", "near", "codes"],
            )
    return run


def _expanded(dimension: int):
    """(query, code, floor, near, codes) to what is closer to the query than its floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queries, floors = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own = _unit(_bytes(batch.column(1), np.int8, dimension))
            (ids, at), rows = _lists(batch.column(3)), []
            for i, codes in enumerate(batch.column(4).to_pylist()):
                sims = _unit(np.frombuffer(codes, np.int8).reshape(-1, dimension)) @ own[i]
                there = ids[at[i]:at[i + 1]]
                good = np.flatnonzero((sims > floors[i]) & (there != queries[i]))
                if len(good):
                    rows.append((queries[i], there[good], sims[good], np.zeros(len(good), bool)))
            if rows:
                yield _graph_batch(rows)
    return run


def _beams(beam: int, expand: int):
    """Rows of each query (node, code, ids, sims, expanded), its state and what it found,
    to its new state. The ``expand`` closest ones not expanded were expanded this round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            keys, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            (ids, at), (sims, _), (done, _) = (_lists(batch.column(c)) for c in (2, 3, 4))
            rows, kept, cuts = [], [], _cuts(keys)
            for a, b in zip(cuts[:-1], cuts[1:]):
                s = slice(at[a], at[b])
                order = np.argsort(~done[s], kind="stable")     # expanded ones first
                i, v, d = ids[s][order], sims[s][order], done[s][order]
                best = _best(i, v, beam)
                rows.append((keys[a], i[best], v[best], d[best]))
                kept.append(next(c for c in codes[a:b] if c is not None))
            nodes, ids, sims, done = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.int64()), pa.array(kept, pa.binary()), _list_column(list(ids), pa.int64()),
                _list_column(list(sims), pa.float32()), _list_column(list(done), pa.bool_()),
            ], names=["node", "code", "ids", "sims", "expanded"])
    return run


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, dimension: int, nearest: int = NEAREST,
           beam: int = BEAM, expand: int = EXPANDED) -> DataFrame:
    """The closest nodes that greedy search finds for each query (node, code): state rows."""
    spark = graph.sparkSession
    name = f"nn_adjacent_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = _members(graph, codes, nearest).repartition(buckets, "at").sortWithinPartitions("at")
    (met.mapInArrow(_adjacent(dimension), "at bigint, near array<bigint>, codes binary")
     .write.bucketBy(buckets, "at").sortBy("at").option("path", shared_dir(spark, "nn-adjacent")).saveAsTable(name))
    try:
        adjacent = spark.table(name)
        empty = [F.array().cast(t).alias(c) for c, t in
                 (("ids", "array<bigint>"), ("sims", "array<float>"), ("expanded", "array<boolean>"))]
        state = queries.select("node", "code", *empty)
        # The first round expands the query's own node, later ones the closest not yet expanded.
        asked = queries.select(F.col("node").alias("at"), "node", "code", F.lit(-2.0).cast("float").alias("floor"))
        while True:
            hits = asked.join(adjacent, "at").select("node", "code", "floor", "near", "codes")
            found = hits.mapInArrow(_expanded(dimension), GRAPH).select(
                "node", F.lit(None).cast("binary").alias("code"), "ids", "sims", F.col("fresh").alias("expanded")
            )
            dealt = state.unionByName(found).repartition("node").sortWithinPartitions("node")
            state = written(dealt.mapInArrow(_beams(beam, expand), STATE), "nn-state")
            open_ones = F.filter(F.arrays_zip("ids", "sims", "expanded"), lambda x: ~x["expanded"])
            if state.filter(F.size(open_ones) > 0).isEmpty():
                return state
            # Beams are sorted, the closest first.
            floor = F.when(F.size("ids") >= beam, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float")
            asked = state.select("node", "code", floor.alias("floor"), F.explode(F.slice(open_ones, 1, expand)).alias("o"))
            asked = asked.select(F.col("o.ids").alias("at"), "node", "code", "floor")
            chosen = F.transform(F.slice(open_ones, 1, expand), lambda x: x["ids"])
            marked = F.transform(F.arrays_zip("ids", "expanded"), lambda x: x["expanded"] | F.array_contains("_now", x["ids"]))
            state = state.withColumn("_now", chosen).withColumn("expanded", marked).drop("_now")
            expand = min(beam, 2 * expand)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# --- operator ---------------------------------------------------------------------

def nearest_neighbours(
    vectors: DataFrame, queries: Column, id_column: str = "vec_id", vector: str = "embedding", top: int = TOP,
    nearest: int = NEAREST, block: int = BLOCK, beam: int = BEAM,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest vectors found for each query.

    ``queries`` is a condition on the id. Nearness is the cosine in double precision,
    ties go to the smaller id; a query is not its own neighbour. Vectors that are NULL or
    zero, hold NULL or non-finite components, have no id or another dimension than most
    take no part. Equal vectors all count. A repeated id counts as often as its vectors
    differ, and is no neighbour of itself. Where there are fewer candidates, all are
    returned; an empty table gives an empty result. Only id and vector are read.
    """
    every = usable(vectors, id_column, vector)
    spark = vectors.sparkSession
    sizes = every.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimension = sizes["d"]
    every = every.filter(F.size("vec") == dimension)
    # Equal vectors are one node, named by its smallest id; no query needs more of
    # their ids than it returns, and one for its own.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    some = every.select("key", "vec_id").distinct().withColumn("r", rank).filter(F.col("r") <= top + 1)
    names = some.groupBy("key").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    vecs = every.groupBy("key").agg(F.min("vec").alias("vec"))
    # A repeated id may name two vectors, so nodes have numbers of their own.
    keyed = names.join(vecs, "key").withColumn("node", F.xxhash64("key"))
    keyed = written(keyed, "nn-classes")
    nodes = written(keyed.select("node", "vec").mapInArrow(
        _code(dimension), "node bigint, vec array<double>, code binary"), "nn-nodes")
    n, codes = nodes.count(), nodes.select("node", "code")
    graph = build(nodes, n, dimension, nearest, block)
    asked = every.filter(queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("key").alias("node")).distinct()
    asked = written(asked, "nn-queries")
    state = search(graph, codes, codes.join(asked.select("node").distinct(), "node", "left_semi"), dimension, nearest, beam)
    # Score on the original vectors, the query's own class among the candidates.
    found = state.select("node", F.explode(F.concat(F.array("node"), F.slice("ids", 1, RESCORED))).alias("other"))
    # Scaled by a power of two: the same digits, and squares that stay in range.
    size = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    scale = F.pow(F.lit(2.0), F.floor(F.log2(size)))
    scaled = keyed.withColumn("s", scale).withColumn("vec", F.transform("vec", lambda x: x / F.col("s")))
    of = scaled.select("node", "vec", "members")
    found = found.join(of.select(F.col("node").alias("other"), F.col("vec").alias("v"), "members"), "other")
    found = found.join(of.select("node", "vec"), "node")

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    scored = found.select("node", "members", (dot("vec", "v") / (F.sqrt(dot("vec", "vec")) * F.sqrt(dot("v", "v")))).alias("score"))
    listed = scored.select("node", "score", F.explode("members").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))
    listed = listed.withColumn("r", best).filter(F.col("r") <= top + 1).groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best")
    )
    answers = asked.join(written(listed, "nn-answers"), "node")
    others = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    answers = answers.select("query_id", F.posexplode(F.slice(others, 1, top)).alias("p", "b"))
    return answers.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
