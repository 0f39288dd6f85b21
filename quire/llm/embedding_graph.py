"""Embedding near-duplicates: robust-pruned flat graphs on overlapping cluster shards, range search from medoids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.simhash import forest
from quire.storage import Scratch

#: Rows that the centroids of one cell are fitted on, centroids of a cell, and vectors that recall is audited on, at most.
FIT_ROWS, FIT_CENTRES, AUDIT_ROWS = 8192, 256, 1024


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest component first, so that no square is out of range."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def robust_prune(points: np.ndarray, candidates: np.ndarray, vectors: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each point's candidates (places in ``vectors``, -1: none) its pruned neighbours; -1 fills up.

    The nearest candidate left is taken, and those go that lie nearer to it, by the factor alpha, than to the point.
    """
    n, rows = len(points), np.arange(len(points))
    near_by = vectors[candidates]
    near = np.where(candidates >= 0, 2 - 2 * np.einsum("nd,nmd->nm", points, near_by), np.inf)
    out = np.full((n, degree), -1)
    for k in range(min(degree, candidates.shape[1])):
        best = near.argmin(axis=1)
        ok = np.isfinite(near[rows, best])
        if not ok.any():
            break
        out[:, k] = np.where(ok, candidates[rows, best], -1)
        apart = 2 - 2 * np.einsum("nd,nmd->nm", near_by[rows, best], near_by)
        near[(alpha * alpha * apart <= near) & ok[:, None]] = np.inf
        near[rows, best] = np.inf
    return out


def greedy(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, least: float = np.inf, width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beams, who, found): the ``beam`` best vertices that greedy search meets for each query (-1: none), and all pairs
    (query, vertex) met with a cosine of ``least`` or more.

    From ``starts`` (vertices of each query, -1: none) the best vertices of the beam not yet expanded are, ``width`` at a
    time, until all are; then every vertex in range is expanded too, and theirs, until none is new.
    """
    m, n = len(queries), len(vectors)
    seen, expanded, turn = np.zeros((m, n), bool), np.zeros((m, n), bool), np.zeros((m, n), np.int32)
    ids, scores = np.full((m, beam), -1), np.full((m, beam), -np.inf)
    who_in, found_in = [], []

    def visit(who: np.ndarray, vertex: np.ndarray) -> None:
        """Score what is new, keep what is in range, and merge it into the beams. ``who`` ascends."""
        fresh = np.flatnonzero((vertex >= 0) & ~seen[who, vertex])
        who, vertex = who[fresh], vertex[fresh]
        turn[who, vertex] = np.arange(len(who))
        once = turn[who, vertex] == np.arange(len(who))
        who, vertex = who[once], vertex[once]
        if not len(who):
            return
        seen[who, vertex] = True
        score = np.einsum("nd,nd->n", queries[who], vectors[vertex])
        hit = score >= least
        who_in.append(who[hit])
        found_in.append(vertex[hit])
        begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        rows, many = who[begin], np.diff(np.append(begin, len(who)))
        inside, at = np.arange(len(who)) - np.repeat(begin, many), np.repeat(np.arange(len(rows)), many)
        all_ids, all_scores = np.full((len(rows), beam + many.max()), -1), np.full((len(rows), beam + many.max()), -np.inf)
        all_ids[:, :beam], all_scores[:, :beam] = ids[rows], scores[rows]
        all_ids[at, beam + inside], all_scores[at, beam + inside] = vertex, score
        top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        ids[rows], scores[rows] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_scores, top, 1)

    def expand(who: np.ndarray, vertex: np.ndarray) -> None:
        expanded[who, vertex] = True
        for at in range(0, len(who), 1 << 13):
            visit(np.repeat(who[at : at + (1 << 13)], graph.shape[1]), graph[vertex[at : at + (1 << 13)]].reshape(-1))

    visit(np.repeat(np.arange(m), starts.shape[1]), starts.reshape(-1))
    while True:
        open_ = np.where((ids >= 0) & ~expanded[np.arange(m)[:, None], ids], scores, -np.inf)
        best = np.argpartition(-open_, min(width, beam) - 1, axis=1)[:, : min(width, beam)]
        who, place = np.nonzero(np.isfinite(np.take_along_axis(open_, best, 1)))
        if not len(who):
            break
        expand(who, ids[who, best[who, place]])
    at = 0
    while at < len(who_in):  # what expansions find is appended and expanded in turn
        who, vertex = who_in[at], found_in[at]
        at += 1
        todo = ~expanded[who, vertex]
        if todo.any():
            expand(who[todo], vertex[todo])
    none = np.zeros(0, np.int64)
    return ids, np.concatenate([none, *who_in]), np.concatenate([none, *found_in])


def build_graph(vectors: np.ndarray, degree: int = 16, pool: int = 40, alpha: float = 1.2, seed: int = 9) -> np.ndarray:
    """Adjacency (n, 2 * degree, -1: none) of a shard. Vertices come in at random, in blocks that grow with the graph; each
    searches it greedily from the medoid, and what it meets is pruned robustly and linked both ways; then all search once
    more. A vertex with too many links back is pruned again."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    medoid = int((vectors @ vectors.sum(axis=0)).argmax())
    order = rng.permutation(n)
    order = np.concatenate([[medoid], order[order != medoid]])
    graph = np.full((n, 2 * degree), -1)

    def link(block: np.ndarray) -> None:
        found, _, _ = greedy(vectors, graph, vectors[block], np.full((len(block), 1), medoid), min(pool, n))
        found = np.concatenate([found, graph[block]], axis=1)
        found = np.where(found == block[:, None], -1, found)
        graph[block] = -1
        graph[block, :degree] = robust_prune(vectors[block], found, vectors, degree, alpha)
        a, b = np.repeat(block, degree), graph[block, :degree].reshape(-1)
        a, b = a[b >= 0], b[b >= 0]
        by = np.argsort(b, kind="stable")
        to, begin, many = np.unique(b[by], return_index=True, return_counts=True)
        back = np.full((len(to), int(many.max(initial=0))), -1)
        back[np.repeat(np.arange(len(to)), many), np.arange(len(by)) - np.repeat(begin, many)] = a[by]
        for column in graph[to].T:  # those linked already
            back[back == column[:, None]] = -1
        both = np.concatenate([graph[to], back], axis=1)
        over = (both >= 0).sum(axis=1) > 2 * degree
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        graph[to[~over]] = both[~over, : 2 * degree]
        if over.any():
            graph[to[over]] = -1
            graph[to[over], :degree] = robust_prune(vectors[to[over]], both[over], vectors, degree, alpha)

    at = 1
    while at < n:
        step = min(n - at, max(8, at // 2), 256)
        link(order[at : at + step])
        at += step
    for at in range(0, n, 256):
        link(order[at : at + 256])
    return graph


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after another; ``shard`` is the first column and sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != shard[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def split_cells(members: DataFrame, counts: DataFrame, dim: int, least: float, shard_rows: int, overlap: int, scratch: Scratch, name: str) -> DataFrame:
    """(rep, cell, parent): members (rep, v, cell) of the cells of ``counts`` (cell, rows) in new cells, ``overlap`` each.

    Centroids in range of each other (``least``) make one cell, so that a group of close vectors isn't cut by its noise.

    A cell's centroids, as many as make cells of ``shard_rows`` rows, are fitted on a sample of it, in one task of FIT_ROWS rows at
    most. They then travel with the cell's rows, which are salted by their number: a copy for each salt.
    """
    here = members.join(counts, "cell")
    share = F.pmod(F.xxhash64("rep", F.lit(name)), F.lit(1 << 30)) < F.least(F.lit(float(1 << 30)), F.lit(2.0**30) * FIT_ROWS / 2 / F.col("rows"))
    sample = here.where(share).select("cell", "rows", "v").repartition("cell").sortWithinPartitions("cell")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_shard(batches):
            centres = fit_centroids(unit(_matrix(table["v"].slice(0, FIT_ROWS), dim)), max(4 * overlap, min(FIT_CENTRES, -(-table["rows"][0].as_py() * overlap // shard_rows))))
            yield pa.RecordBatch.from_arrays([table["cell"].combine_chunks()[:1], pa.array([centres.reshape(-1)])], names=["cell", "centres"])

    centres = scratch.put(sample.mapInArrow(fit, "cell long, centres array<double>"), f"centres{name}")
    salts = F.ceil(F.col("rows") / FIT_ROWS)
    rows = here.select("cell", F.pmod(F.xxhash64("rep"), salts).alias("salt"), "rep", "v")
    copies = centres.join(counts, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("long").alias("rep"), F.col("centres").alias("v"))
    dealt = rows.unionByName(copies).select(F.xxhash64("cell", "salt").alias("shard"), "cell", "rep", "v")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", F.col("rep").asc_nulls_first())

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_shard(batches):
            centres = _matrix(table["v"].slice(0, 1), dim)
            same = forest(len(centres), iter([np.nonzero(centres @ centres.T >= least)]))
            for at in range(1, len(table), 4096):
                part = table.slice(at, 4096)
                near = np.argsort(-(unit(_matrix(part["v"], dim)) @ centres.T), axis=1, kind="stable")[:, :overlap]
                to = np.unique(np.repeat(np.arange(len(part)), near.shape[1]) * len(centres) + same[near].reshape(-1))
                who = pa.array(to // len(centres))
                yield pa.RecordBatch.from_arrays([part["rep"].combine_chunks().take(who), part["cell"].combine_chunks().take(who), pa.array(to % len(centres))], names=["rep", "parent", "k"])

    placed = dealt.mapInArrow(assign, "rep long, parent long, k long")
    return placed.select("rep", F.xxhash64("parent", "k").alias("cell"), "parent")


def place(classes: DataFrame, dim: int, least: float, shard_rows: int, overlap: int, scratch: Scratch, name: str, levels: int = 12) -> DataFrame:
    """(rep, cell, rows): each vector in its cells, ``overlap`` on the first level, two on each further one.

    Cells of over two shards' rows are split again, as often as needed; one of which a child keeps nearly all rows can't
    be split: its vectors lie too close.
    """
    vectors = classes.select("rep", "v")
    now = vectors.select("rep", F.pmod(F.col("rep"), F.lit(1).cast("long")).alias("cell"))  # all in one; a literal would make the joins below cross joins
    done = None
    for level in range(levels):
        counts = scratch.put(now.groupBy("cell").agg(F.count("*").alias("rows")), f"counts{name}_{level}")
        large = counts.where(F.col("rows") > 2 * shard_rows)
        if not large.limit(1).count() or level == levels - 1:
            small = now.join(counts, "cell")
            done = small if done is None else done.unionByName(small)
            break
        small = now.join(counts.where(F.col("rows") <= 2 * shard_rows), "cell")
        done = small if done is None else done.unionByName(small)
        split = split_cells(now.join(vectors, "rep"), large, dim, least, shard_rows, overlap if not level else min(2, overlap), scratch, f"{name}_{level}")
        split = scratch.put(split, f"cells{name}_{level}")
        kept = split.groupBy("cell", "parent").agg(F.count("*").alias("rows")).join(large.select(F.col("cell").alias("parent"), F.col("rows").alias("before")), "parent")
        dense = scratch.put(kept.groupBy("parent").agg((F.max("rows") >= 0.8 * F.max("before")).alias("dense"), F.max("before").alias("rows")), f"dense{name}_{level}")
        flat = now.join(dense.where("dense").select(F.col("parent").alias("cell"), "rows"), "cell")
        done = done.unionByName(flat)
        now = split.join(dense.where("not dense").select("parent"), "parent").select("rep", "cell").distinct()
    return scratch.put(done.select("rep", "cell", "rows"), f"placed{name}")


def shard_graphs(members: DataFrame, dim: int) -> DataFrame:
    """(rep, near) from each shard that indexes a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_shard(batches):
            rep = table["rep"].to_numpy()
            graph = build_graph(unit(_matrix(table["v"], dim)))
            lists = [rep[row[row >= 0]] for row in graph]
            yield pa.RecordBatch.from_arrays([table["rep"].combine_chunks(), pa.array(lists, pa.list_(pa.int64()))], names=["rep", "near"])

    dealt = members.where("indexed").select("shard", "rep", "v").repartition("shard").sortWithinPartitions("shard", "rep")
    return dealt.mapInArrow(run, "rep long, near array<long>")


def _common(cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cell that rows a and b of ``cells`` share; the largest number fills short rows and counts as none."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for i in range(cells.shape[1]):
        for j in range(cells.shape[1]):
            x = cells[a, i]
            out = np.minimum(out, np.where(x == cells[b, j], x, none))
    return out


def search_graphs(members: DataFrame, dim: int, least: float, beam: int = 32) -> DataFrame:
    """(rep, links, root) from each shard: vectors linked, by weight, and the smallest vector that links reach there.

    A pair that shares several cells counts in the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_shard(batches):
            rep, n, cell = table["rep"].to_numpy(), table["n"].to_numpy(), table["cell"][0].as_py()
            v = unit(_matrix(table["v"], dim))
            own = np.flatnonzero(table["indexed"].to_numpy(zero_copy_only=False))
            links, root = np.zeros(len(rep), np.int64), rep
            if len(own):
                lists = table["cells"].to_pylist()
                cells = np.full((len(rep), max(map(len, lists))), np.iinfo(np.int64).max)
                for k, x in enumerate(lists):
                    cells[k, : len(x)] = x
                where = {r: k for k, r in enumerate(rep[own].tolist())}
                near = [[where[x] for x in row if x in where] for row in table["near"].take(pa.array(own)).to_pylist()]
                graph = np.full((len(own), max([1, *map(len, near)])), -1)
                for k, row in enumerate(near):
                    graph[k, : len(row)] = row
                start = np.full((len(rep), 2), -1)
                start[own, 0] = np.arange(len(own))
                start[:, 1] = int((v[own] @ v[own].sum(axis=0)).argmax())
                pairs, step = [], max(16, min(512, (1 << 22) // len(own)))
                for at in range(0, len(rep), step):
                    _, query, found = greedy(v[own], graph, v[at : at + step], start[at : at + step], min(beam, len(own)), least)
                    query, found = query + at, own[found]
                    other = query != found
                    query, found = query[other], found[other]
                    pairs.append((query, found))
                    for k in range(0, len(query), 1 << 16):
                        a, b = query[k : k + (1 << 16)], found[k : k + (1 << 16)]
                        first = _common(cells, a, b) == cell
                        np.add.at(links, a[first], n[b[first]])
                by_rep = np.argsort(rep, kind="stable")
                rank = np.empty(len(rep), np.int64)
                rank[by_rep] = np.arange(len(rep))
                root = rep[by_rep[forest(len(rep), ((rank[a], rank[b]) for a, b in pairs))[rank]]]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], names=["rep", "links", "root"])

    dealt = members.select("shard", "cell", "rep", "n", "v", "cells", "indexed", "near").repartition("shard").sortWithinPartitions("shard", "rep")
    return dealt.mapInArrow(run, "rep long, links long, root long")


def true_links(classes: DataFrame, audited: pa.Table, dim: int, least: float) -> dict[int, int]:
    """Links of the audited vectors to other vectors than their own kind, by comparison with all rows."""
    probe, names = unit(_matrix(audited["v"], dim)), audited["rep"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            if batch.num_rows:
                other = batch.column(0).to_numpy()[:, None] != names
                total += batch.column(1).to_numpy() @ ((unit(_matrix(batch.column(2), dim)) @ probe.T >= least) & other)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], names=["rep", "n"])

    rows = classes.select("rep", "n", "v").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    return {r["rep"]: r["n"] for r in rows.collect()}  # a row for each audited vector


def audit(classes: DataFrame, found: DataFrame, dim: int, least: float) -> float:
    """Mean share of its links that were found for a vector, of AUDIT_ROWS by hash: half of those with links found, half of
    all. Every vector counts alike, so a large group hides no small one. 1 if none of them has a link."""
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    half = lambda rows: rows.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT_ROWS // 2)
    chosen = half(sums.where("links > 0").select("rep")).unionByName(half(classes.select("rep"))).distinct()
    table = classes.join(F.broadcast(chosen), "rep").select("rep", "v").join(sums, "rep", "left").toArrow()  # AUDIT_ROWS rows
    truth = true_links(classes, table, dim, least)
    shares = [min(1.0, (got or 0) / truth[rep]) for rep, got in zip(table["rep"].to_pylist(), table["links"].to_pylist(), strict=True) if truth.get(rep)]
    return float(np.mean(shares)) if shares else 1.0


def linked(classes: DataFrame, dim: int, scratch: Scratch, name: str, least: float, shard_rows: int, overlap: int, recall: float, lowest: float) -> DataFrame:
    """(rep, links, root) of vectors (rep, n, v) of one length, from all shards; see ``near_duplicate_vectors``."""
    best = 0.0
    for attempt in range(4):
        key = f"{name}_{attempt}"
        placed = place(classes, dim, least, shard_rows, overlap + 2 * attempt, scratch, key)
        cells = placed.groupBy("rep").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
        each = placed.dropDuplicates(["rep", "cell"]).join(classes.join(cells, "rep"), "rep")
        parts = F.when(F.col("rows") > 2 * shard_rows, F.ceil(F.col("rows") / shard_rows)).otherwise(F.lit(1).cast("long"))
        each = each.withColumn("home", F.pmod(F.xxhash64("rep"), parts)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        each = scratch.put(each.withColumns({"shard": F.xxhash64("cell", "part"), "indexed": F.col("part") == F.col("home")}), f"each{key}")
        graphs = scratch.put(shard_graphs(each, dim), f"graphs{key}")
        united = graphs.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        found = scratch.put(search_graphs(each.join(united, "rep"), dim, least), f"found{key}")
        scratch.drop(f"each{key}", f"graphs{key}")
        best = audit(classes, found, dim, least)
        if best >= recall:
            return found
    if best < lowest:
        raise RuntimeError(f"audited recall {best:.3f} of the graph search is below {lowest}")
    return found


def near_duplicate_vectors(rows: DataFrame, least: float = 0.95, shard_rows: int = 1000, overlap: int = 3, recall: float = 0.98, lowest: float = 0.9, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per row: key, n_links, component_id, kept: links are pairs with a cosine of ``least`` or more, in double precision.

    Equal vectors are one vertex with a weight. Vertices are dealt to cells by centroids, each to several, and cells of
    over two shards' rows are dealt again, so centroids grow with the table (``place``). A cell whose vectors lie too
    close to be split is cut by a hash: each vertex is indexed in one part and sought in all. Shards build graphs of
    robustly pruned neighbours from greedy searches, a vertex's lists of all its shards are united, and every vertex is
    sought by range-expanding greedy search from the medoid and from itself; only pairs whose exact cosine is in range
    count. Recall is audited against all rows (``audit``); below ``recall`` everything is done again with two more cells a
    vertex, up to three times; below ``lowest`` at last it is an error.

    Vectors of different lengths never link; each length is searched by itself. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing. Rows with a null key link with nothing, their component is null and
    they aren't kept. Repeated rows are equal vectors. Components may be as large as the table: they are found by
    alternating stars. ``kept``: key = component_id. Each input row gives one row; other columns aren't read.
    """
    scratch = Scratch(rows.sparkSession)
    source = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(F.col("key").isNotNull() & finite, F.lit(False))
    marked = source.withColumn("v", F.when(good, F.col("v")))
    classes = scratch.put(marked.where("v is not null").groupBy("v").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "classes")
    found = rows.sparkSession.createDataFrame([], "rep long, links long, root long")
    for r in classes.groupBy(F.size("v").alias("dim")).count().collect():  # a row for each length
        same = classes.where(F.size("v") == r["dim"])
        found = found.unionByName(linked(same, r["dim"], scratch, f"d{r['dim']}", least, shard_rows, overlap, recall, lowest))
    label = connected_components(found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst")), scratch)
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    table = classes.join(sums, "rep", "left").join(label, F.col("rep") == F.col("id"), "left")
    table = scratch.put(table.select(F.col("v").alias("w"), "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "table")
    out = marked.join(table, marked["v"] == table["w"], "left")
    out = out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
