"""Approximate nearest neighbours: one navigable small-world hierarchy per shard.

Equal vectors are one node (a hot vector is pre-aggregated; its node keeps the
``k + 1`` smallest row ids, which is all that k neighbours can ever need). Nodes are
dealt by hash to shards of about ``SHARD`` vectors. A task builds a shard's
hierarchy: nodes, in the order of their ids, draw a top layer from a seeded generator, layers are built from the
top down, and nodes enter a layer in batches that search it together, choose diverse
neighbours and link back. A shard is stored as one row of flat arrays: vectors,
ids, and for each layer its nodes and a padded neighbour array.

Query vectors go to every shard in blocks; a (shard, block) pair is one bounded
task. Beams are re-scored in double precision on the original vectors; each query's
shard results are merged by score.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without id, take no part; repeated rows count once; vectors are
compared with vectors of as many components only; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.session import materialize

SHARD = 4096
LINKS, BEAM_BUILD, BEAM_SEARCH = 16, 48, 96
BATCH, QUERY_BLOCK = 256, 2048
SEED = 7


def beam_search(q: np.ndarray, vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Lockstep best-first search of many queries in one layer. ``links`` holds
    neighbour numbers, -1 for none; ``entry`` start nodes of each query. Returns node
    numbers and similarities, best first, -1 and -inf for none."""
    n, rows = len(q), np.arange(len(q))
    ids = np.full((n, beam), -1, np.int32)
    sim = np.full((n, beam), -np.inf, np.float32)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(vectors)), bool)
    e = min(entry.shape[1], beam)
    ids[:, :e] = entry[:, :e]
    sim[:, :e] = np.where(entry[:, :e] >= 0, np.einsum("bd,bed->be", q, vectors[entry[:, :e]]), -np.inf)
    open_[:, :e] = entry[:, :e] >= 0
    seen[rows[:, None], entry[:, :e]] = True
    active = rows
    while True:
        best = np.where(open_[active], sim[active], -np.inf)
        j = best.argmax(1)
        on = best[np.arange(len(active)), j] > -np.inf
        active, j = active[on], j[on]
        if not len(active):
            break
        open_[active, j] = False
        near = links[ids[active, j]]
        new = (near >= 0) & ~seen[active[:, None], near]
        seen[active[:, None], np.where(near >= 0, near, ids[active, j][:, None])] = True
        s = np.where(new, np.einsum("bd,bmd->bm", q[active], vectors[near]), -np.inf)
        all_sim = np.concatenate([sim[active], s], 1)
        keep = np.argpartition(-all_sim, beam - 1, 1)[:, :beam]
        sim[active] = np.take_along_axis(all_sim, keep, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, near, -1)], 1), keep, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], 1), keep, 1)
    order = np.argsort(-sim, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def diverse(cand: np.ndarray, sim: np.ndarray, vectors: np.ndarray, m: int) -> np.ndarray:
    """From candidates, best first, choose up to m that are nearer to the node than to
    any chosen before; free places go to the best left out."""
    n, c = cand.shape
    v = vectors[cand]
    between = np.einsum("bcd,bed->bce", v, v)
    chosen = np.zeros((n, c), bool)
    nearest = np.full((n, c), -np.inf, np.float32)  # to any chosen
    for k in range(c):
        take = (cand[:, k] >= 0) & (sim[:, k] > nearest[:, k]) & (chosen.sum(1) < m)
        chosen[:, k] = take
        np.maximum(nearest, np.where(take[:, None], between[:, k], -np.inf), out=nearest)
    rank = np.where(cand < 0, 3 * c, np.where(chosen, 0, c) + np.arange(c))
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def build_layer(vectors: np.ndarray, entry: np.ndarray, m: int, beam: int, batch: int = BATCH) -> np.ndarray:
    """Neighbour array of a layer whose nodes are numbered in the order they enter.
    ``entry`` names for each node one that entered before it (or 0)."""
    n = len(vectors)
    links = np.full((n, m), -1, np.int32)
    for at in range(0, n, batch):
        new = np.arange(at, min(n, at + batch))
        q = vectors[new]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        k = min(len(new) - 1, m)
        own = np.argsort(-among, 1, kind="stable")[:, :k]
        cand, sim = (own + at).astype(np.int32), np.take_along_axis(among, own, 1)
        if at:
            found, s = beam_search(q, vectors[:at], links[:at], np.minimum(entry[new], at - 1)[:, None], beam)
            cand, sim = np.concatenate([found, cand], 1), np.concatenate([s, sim], 1)
            order = np.argsort(-sim, 1, kind="stable")[:, :beam]
            cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        if not cand.shape[1]:
            continue
        links[new] = diverse(cand, sim, vectors, m)
        # link back: old neighbours and the new ones, the diverse of them
        target, source = links[new].ravel(), np.repeat(new, m)
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((-np.einsum("ed,ed->e", vectors[source], vectors[target]), target))
        source, target = source[order], target[order]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(who), batch):
            w, f, c = who[low : low + batch], first[low : low + batch], np.minimum(count[low : low + batch], m)
            wide = np.full((len(w), c.max()), -1, np.int32)
            col = np.arange(c.max())
            wide[col < c[:, None]] = source[(f[:, None] + col)[col < c[:, None]]]
            wide[(wide[:, :, None] == links[w][:, None, :]).any(2)] = -1
            cand = np.concatenate([links[w], wide], 1)
            sim = np.where(cand >= 0, np.einsum("bd,bcd->bc", vectors[w], vectors[cand]), -np.inf)
            order = np.argsort(-sim, 1, kind="stable")
            links[w] = diverse(np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1), vectors, m)
    return links


def build_graph(vectors: np.ndarray, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top down: (node numbers, neighbour array by places in them).
    Nodes of higher layers come first in every lower one."""
    n = len(vectors)
    u = np.random.default_rng(seed).random(n)
    level = np.floor(-np.log(1 - u) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    layers, above = [], None
    for top in range(level.max(), -1, -1):
        nodes = order[level[order] >= top]
        v = vectors[nodes]
        entry = np.zeros(len(nodes), np.int64)
        if above is not None:  # a node of the layer above enters there, others at the nearest found above
            entry[: len(above)] = np.maximum(np.arange(len(above)) - 1, 0)
            for at in range(len(above), len(nodes), BATCH):
                part = np.arange(at, min(len(nodes), at + BATCH))
                entry[part] = descend(v[part], vectors, layers)
        layers.append((nodes, build_layer(v, entry, LINKS * (2 if top == 0 else 1), BEAM_BUILD)))
        above = nodes
    return layers


def descend(q: np.ndarray, vectors: np.ndarray, layers: list) -> np.ndarray:
    """Place, in the last of ``layers``, of the node found nearest."""
    at = np.zeros((len(q), 1), np.int64)
    for nodes, links in layers:
        at = beam_search(q, vectors[nodes], links, at, 4)[0][:, :1].astype(np.int64)
    return at[:, 0]


def search_graph(q: np.ndarray, vectors: np.ndarray, layers: list, beam: int) -> np.ndarray:
    """Node numbers found nearest, best first, -1 for none."""
    entry = descend(q, vectors, layers[:-1]) if len(layers) > 1 else np.zeros(len(q), np.int64)
    nodes, links = layers[-1]
    found, _ = beam_search(q, vectors[nodes], links, entry[:, None], beam)
    return np.where(found >= 0, nodes[found], -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: exact, and no
    square of a component leaves the range of doubles."""
    _, power = np.frexp(np.abs(x).max(1, keepdims=True))
    half = power // 2  # in two steps, since the whole power may be out of range
    return np.ldexp(np.ldexp(x.astype(np.float64), -half), half - power)


def unit(x: np.ndarray) -> np.ndarray:
    y = scaled(x)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the rows that take part, once each."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and embedding is not null").where(finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v)).distinct()


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest row ids."""
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("embedding", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).withColumn("node", F.col("members")[0])


def build_index(nodes: DataFrame, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The index, one row of flat arrays per shard, and the number of shards per dimension."""
    shards = materialize(nodes.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(float(shard))).cast("int").alias("shards")))
    dealt = nodes.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).drop("shards")

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        flat = table.column("embedding").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(len(order), -1)
        layers = build_graph(unit(vectors))
        members = table.column("members").combine_chunks()
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "vectors": pa.array([vectors.tobytes()], pa.binary()), "member_sizes": pa.array([members.value_lengths().to_numpy().astype(np.int32).tobytes()], pa.binary()),
            "members": pa.array([members.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "layer_nodes": pa.array([[x.astype(np.int32).tobytes() for x, _ in layers]], pa.list_(pa.binary())), "layer_links": pa.array([[x.tobytes() for _, x in layers]], pa.list_(pa.binary()))})

    schema = "dim int, shard int, vectors binary, member_sizes binary, members binary, layer_nodes array<binary>, layer_links array<binary>"
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, schema)), shards


def search(index: DataFrame, shards: DataFrame, wanted: DataFrame, k: int, beam: int = BEAM_SEARCH) -> DataFrame:
    """(node, vec_id, score): for each query vector (node, embedding, dim) the k best rows found."""
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    asked = wanted.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")).drop("shards")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]

    def find(queries: pa.Table, shard: pa.Table) -> pa.Table:
        out = {"node": [], "vec_id": [], "score": []}
        if len(queries) and len(shard):
            row, dim = shard.slice(0, 1).to_pylist()[0], shard.column("dim")[0].as_py()
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
            members, sizes = np.frombuffer(row["members"], np.int64), np.frombuffer(row["member_sizes"], np.int32)
            first = np.concatenate([[0], np.cumsum(sizes)])
            layers = []
            for nodes, links in zip(row["layer_nodes"], row["layer_links"], strict=True):
                nodes = np.frombuffer(nodes, np.int32)
                layers.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
            small, even = unit(vectors), scaled(vectors)
            norm = np.linalg.norm(even, axis=1)
            q = queries.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            ids = queries.column("node").to_numpy()
            for at in range(0, len(q), BATCH):
                part = q[at : at + BATCH]
                found = search_graph(unit(part), small, layers, max(beam, k))
                part = scaled(part)
                exact = np.einsum("bd,bcd->bc", part, even[found]) / (np.linalg.norm(part, axis=1)[:, None] * norm[found])
                exact = np.where(found >= 0, exact, -np.inf)
                for b in range(len(part)):
                    rows = [(-s, v) for s, f in zip(exact[b].tolist(), found[b].tolist(), strict=True) if f >= 0 for v in members[first[f] : first[f + 1]].tolist()]
                    for s, v in sorted(rows)[:k]:
                        out["node"].append(ids[at + b])
                        out["vec_id"].append(v)
                        out["score"].append(-s)
        return pa.table({"node": pa.array(out["node"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(find, "node bigint, vec_id bigint, score double")


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, beam: int = BEAM_SEARCH, shard: int = SHARD) -> DataFrame:
    """The k nearest rows found for each row whose id is divisible by ``every``."""
    rows = usable(embeddings)
    nodes = materialize(nodes_of(rows, k))
    index, shards = build_index(nodes, shard)
    asking = materialize(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").join(nodes.select("embedding", "node"), "embedding").select("query_id", "node"))
    wanted = materialize(nodes.select("node", "embedding", "dim").join(asking.select("node").distinct(), "node"))
    def best(key):
        return Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_id")

    found = search(index, shards, wanted, k + 1, beam).withColumn("rank", F.row_number().over(best("node"))).where(F.col("rank") <= k + 1).drop("rank")
    own = asking.join(found, "node").where("vec_id <> query_id")
    return own.withColumn("rank", F.row_number().over(best("query_id"))).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
