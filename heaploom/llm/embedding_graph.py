"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors are one point.  Points are dealt to overlapping cells (the nearest OVERLAP centroids of a k-means on a
bounded sample); in each cell every point keeps a robust-pruned list of neighbours, and a point's lists of all
its cells are united.  Then each point is searched for in its nearest cell, on the united graph: a greedy
beam search from the cell's medoid, and from what it finds in range an expansion along the graph as long as points lie in
range.  Cosines of found pairs are computed in double precision and compared with the limit.  Links between points of one home cell
leave their task as counts and as components, so a group of near copies makes no rows but its own; links
between cells leave it as pairs.  The recall is audited against all points for a sample of queries; if it is too low, everything is done
again with more overlap, and if that does not help either, every two chunks of points are compared.

Cells that exceed MOST points are split again by centroids of their own, to any depth, so no cell grows with the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

LIMIT = 0.95
CELL = 600
MOST = 3_000
OVERLAP = 3
#: Points that centroids of one level are fitted on (CELL of each cell at least), and centroids of one cell at most.
SAMPLE = 20_000
CENTROIDS = 512
DEGREE = 24
CANDIDATES = 64
ALPHA = 1.2
BEAM = 24
DENSE = 0.5
#: Rows that a task deals to cells at once, or so.
DEALT = 10_000
#: How far below the limit a point may lie and still be expanded.
SLACK = 0.03
#: Points that an audit asks first, and true links that it wants to see; it asks twice as many until then, MOST_ASKED at most.
AUDIT = 64
AUDIT_LINKS = 200
MOST_ASKED = 4_096
RECALL = 0.98


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors; deterministic."""
    rng = np.random.default_rng(11)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            mine = x[near == j]
            if len(mine):
                m = mine.sum(0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c


def robust_prune(i: int, candidates: np.ndarray, sim: np.ndarray, cand_sim: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of point i out of candidates from near to far: one is left out if a kept one is alpha times nearer to it."""
    kept: list[int] = []
    alive = np.ones(len(candidates), bool)
    dist = 1 - cand_sim
    for a in range(len(candidates)):
        if not alive[a]:
            continue
        kept.append(int(candidates[a]))
        if len(kept) >= degree:
            break
        alive &= alpha * (1 - sim[candidates[a], candidates]) > dist
    return kept


def build_graph(x: np.ndarray) -> list[list[int]]:
    """The robust-pruned lists of a cell's unit vectors, with reverse edges and a link from the medoid to all others kept
    reachable through the nearest point before them."""
    n = len(x)
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(CANDIDATES, n - 1)
    out: list[list[int]] = [[] for _ in range(n)]
    if not k:
        return out
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    for i in range(n):
        c = near[i][np.lexsort((near[i], -sim[i, near[i]]))]
        out[i] = robust_prune(i, c, sim, sim[i, c])
    sets = [set(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            sets[j].add(i)
    # parts that no list joins hang on by their most similar points
    m = medoid(x)
    seen = np.zeros(n, bool)
    stack = [m]
    while True:
        while stack:
            i = stack.pop()
            if not seen[i]:
                seen[i] = True
                stack += [j for j in sets[i] if not seen[j]]
        if seen.all():
            return [sorted(s) for s in sets]
        inner, outer = np.flatnonzero(seen), np.flatnonzero(~seen)
        block = sim[np.ix_(outer, inner)]
        o, i = np.unravel_index(int(block.argmax()), block.shape)
        sets[outer[o]].add(int(inner[i]))
        sets[inner[i]].add(int(outer[o]))
        stack = [int(outer[o])]


def medoid(x: np.ndarray) -> int:
    m = x.mean(0)
    return int((x @ m).argmax())


def range_search(q: np.ndarray, x: np.ndarray, graph: list[np.ndarray], start: int, limit: float) -> np.ndarray:
    """Points at cosine >= limit - SLACK of q that a beam search from start and an expansion in range reach."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    beam = [(float(x[start] @ q), start)]
    done: set[int] = set()
    while True:
        todo = [p for p in beam if p[1] not in done]
        if not todo:
            break
        for _, i in todo[:4]:
            done.add(i)
        new = np.concatenate([graph[i] for _, i in todo[:4]])
        new = np.unique(new[~seen[new]])
        if len(new):
            seen[new] = True
            beam += zip((x[new] @ q).tolist(), new.tolist())
            beam = sorted(beam, key=lambda p: (-p[0], p[1]))[:BEAM]
    found = {i for s, i in beam if s >= limit - SLACK}
    front = list(found)
    while front:
        new = np.unique(np.concatenate([graph[i] for i in front]))
        new = new[[int(i) not in found for i in new]] if len(new) else new
        if not len(new):
            break
        inside = new[(x[new] @ q) >= limit - SLACK]
        front = inside.tolist()
        found |= set(front)
    return np.array(sorted(found), np.int64)


def points_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Usable vectors as doubles: (id, x).  Left out: null ids, null, empty, zero vectors and those with a component that is null or
    not finite."""
    x = F.col(vector).cast("array<double>")
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(key).alias("id"), x.alias("x")).where(F.col("id").isNotNull()).where(good).where(F.exists("x", lambda v: v != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(points: DataFrame, overlap: int, limit: float = LIMIT) -> DataFrame:
    """(cell, id, x, copies, home, side): each point in the cells of its nearest centroids; home marks the nearest one.

    Cells above MOST points are dealt again, within themselves, by centroids fitted on a sample of their points.
    Cells that centroids do not part, or in whose sample DENSE of all pairs are links, are cut into chunks, and every two chunks make a
    cell, in which only points of different sides (or of the one chunk) are to be linked.
    """
    kind = dict(points.dtypes)["id"]
    placed = points.select(F.lit("r").alias("cell"), "id", "x", "copies", F.lit(True).alias("home"))
    done: list[DataFrame] = []
    before = None
    while True:
        placed = written(placed, "cells")
        large = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > MOST)
        if before is None:
            large = large.withColumn("above", F.lit(None).cast("long"))
        else:
            parent = F.regexp_replace("cell", r"\.[^.]*$", "")
            large = large.withColumn("parent", parent).join(before.select(F.col("cell").alias("parent"), F.col("n").alias("above")), "parent", "left")
        large = written(large.select("cell", "n", "above"), "sizes")  # a row per MOST rows at most; stays distributed
        number = large.count()
        done.append(placed.join(large, "cell", "left_anti").withColumn("side", F.lit(0)))
        if not number:
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        each = max(CELL, SAMPLE // number)

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            """The centroids of a cell; none where it is to be cut into chunks."""
            rows = rows.sort_values("id", kind="stable")
            n, above = int(rows["n"].iloc[0]), rows["above"].iloc[0]
            x = _unit(np.stack(rows["x"].to_numpy()))
            near = x[:CELL] @ x[:CELL].T >= limit
            stuck = n > 0.8 * (2 * n if pd.isna(above) else above) or near.mean() > DENSE
            c = None if stuck else kmeans(x, min(CENTROIDS, max(2 * overlap, n // CELL))).tolist()
            return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "centres": pd.Series([c], dtype=object)})

        share = F.greatest(F.lit(1), F.least(F.lit(1.0), 1.2 * each / F.col("n")) * 1_000_003).cast("long")
        sample = placed.select("cell", "id", "x").join(large, "cell").where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < share)
        fitted = sample.groupBy("cell").applyInPandas(fit, "cell string, centres array<array<double>>")
        fitted = written(large.join(fitted, "cell", "left"), "centres")  # a cell without a sampled point is cut into chunks, too
        stuck = fitted.where("centres is null").select("cell", F.ceil(2 * F.col("n") / MOST).alias("chunks"))
        done.append(_pairs_of_chunks(placed.join(stuck, "cell")))
        before = large

        def deal(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(own):
                centres = np.stack([np.asarray(c, float) for c in own["centres"].iloc[0]])
                sim = _unit(np.stack(rows["x"].to_numpy())) @ centres.T
                k = min(overlap, max(1, sim.shape[1] // 2))
                near = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                for j in range(k):
                    cell = [f"{key[0]}.{t}" for t in near[:, j]]
                    out.append(rows[["id", "x", "copies"]].assign(cell=cell, home=rows["home"].to_numpy(bool) & (j == 0)))
            columns = ["cell", "id", "x", "copies", "home"]
            return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

        parts = F.ceil(F.col("n") / DEALT).cast("long")  # a task deals DEALT rows of a cell at once, or so, however large the cell
        centred = fitted.where("centres is not null")
        rest = placed.join(centred.select("cell", parts.alias("parts")), "cell")
        rest = rest.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts"))).drop("parts")
        own = centred.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "centres")
        dealt = rest.groupBy("cell", "part").cogroup(own.groupBy("cell", "part"))
        placed = dealt.applyInPandas(deal, f"cell string, id {kind}, x array<double>, copies long, home boolean")


def _pairs_of_chunks(cells: DataFrame) -> DataFrame:
    """Every two chunks of each cell as a cell; cells: with a column chunks."""
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    rows = cells.select("*", mine.alias("i")).select("*", other.alias("j"))
    name = F.concat_ws("-", F.concat("cell", F.lit(".b")), F.least("i", "j"), F.greatest("i", "j"))
    return rows.select(name.alias("cell"), "id", "x", "copies", "home", F.col("i").cast("int").alias("side"))


def find_links(points: DataFrame, limit: float, overlap: int, exact: bool = False) -> DataFrame:
    """Links of points (id, x, copies), as rows (a, b, n): with n, a has links that make n other vectors (and a null b), or a and b
    are in one component (n = 0); without n, a and b, a < b, are linked, and neither count says so.

    exact: every two chunks of points are compared, without a graph.
    """
    kind = dict(points.dtypes)["id"]
    if exact:
        whole = points.select(F.lit("all").alias("cell"), "id", "x", "copies", F.lit(True).alias("home"))
        cells = _pairs_of_chunks(whole.withColumn("chunks", F.lit(-(-2 * points.count() // MOST)).cast("long")))
    else:
        cells = cells_of(points, overlap, limit)
    cells = written(cells, "placed")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        lists = build_graph(_unit(np.stack(rows["x"].to_numpy())))
        return pd.DataFrame({"id": ids, "near": [ids[o].tolist() for o in lists]})

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        ids, side, home = (rows[c].to_numpy() for c in ("id", "side", "home"))
        raw = np.stack(rows["x"].to_numpy())
        x = _unit(raw)
        linked = np.zeros((len(x), len(x)), bool)
        if exact:
            graph = None
        else:
            place = {v: i for i, v in enumerate(ids.tolist())}
            local = [np.array([place[v] for v in near if v in place], np.int64) for near in rows["near"]]
            back: list[list[int]] = [[] for _ in local]
            for i, o in enumerate(local):
                for j in o.tolist():
                    back[j].append(i)
            graph = [np.unique(np.concatenate([o, np.array(b, np.int64)])) for o, b in zip(local, back)]
            start = medoid(x)
        for i in np.flatnonzero(home).tolist():
            hit = np.arange(len(x)) if exact else range_search(x[i], x, graph, start, limit)
            sim = x[hit] @ x[i]
            for j in np.flatnonzero(np.abs(sim - limit) < 1e-9).tolist():  # rounding may decide: by the formula
                sim[j] = 2 if cosine(raw[i], raw[hit[j]]) >= limit else -2
            linked[i, hit[sim >= limit]] = True
        if (side != side[0]).any():
            linked &= side[:, None] != side[None, :]
        np.fill_diagonal(linked, False)
        own = linked & home[:, None] & home[None, :]
        own |= own.T
        n = own @ rows["copies"].to_numpy()
        has = np.flatnonzero(n)
        head = np.arange(len(x))
        for i in has.tolist():
            if head[i] == i:  # the smallest of its component that is not done
                mine = np.zeros(len(x), bool)
                mine[i] = True
                new = mine
                while new.any():
                    new = own[new].any(0) & ~mine
                    mine |= new
                head[mine] = i
        member = np.flatnonzero(head != np.arange(len(x)))
        i, j = np.nonzero(linked & ~home[None, :])  # the other's home is another cell
        a = np.concatenate([ids[has], ids[head[member]], np.minimum(ids[i], ids[j])])
        b = pd.Series([None] * len(has), dtype=object)
        b = pd.concat([b, pd.Series(np.concatenate([ids[member], np.maximum(ids[i], ids[j])]), dtype=object)], ignore_index=True)
        count = [*n[has].tolist(), *[0] * len(member), *[None] * len(i)]
        return pd.DataFrame({"a": a, "b": b, "n": pd.Series(count, dtype=object)})

    if exact:
        rows = cells
    else:
        graph = cells.groupBy("cell").applyInPandas(build, f"id {kind}, near array<{kind}>")
        united = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        rows = cells.join(written(united, "graph"), "id")
    return written(rows.groupBy("cell").applyInPandas(search, f"a {kind}, b {kind}, n long"), "links")


def counted(found: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What find_links() found, as (id, more), how many other vectors a point's links make, and as links (a, b) that join components."""
    pairs = written(found.where("n is null").select("a", "b").distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(points.select(F.col("id").alias("b"), F.col("copies").alias("n")), "b").select("a", "n")
    near = found.where("b is null").select("a", "n")
    more = near.unionByName(far).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    return written(more, "counts"), pairs.unionByName(found.where("n = 0").select("a", "b"))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In double precision; vectors are scaled by their largest component before, so that no square is lost."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y)))


def audit(points: DataFrame, more: DataFrame, limit: float, queries: int = AUDIT) -> float:
    """The share of the true links of a sample of points that more(id, more) counts; all that it counts are true.

    The points of smallest hash are compared with all; of twice as many, until they have AUDIT_LINKS links.
    """
    kind = dict(points.dtypes)["id"]
    while True:
        asked = points.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "x").collect()
        sent = points.sparkSession.sparkContext.broadcast(pickle.dumps(([r["id"] for r in asked], np.array([r["x"] for r in asked]))))

        def compare(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = pickle.loads(sent.value)
            ids, q = np.array(ids), _unit(q)
            for part in parts:
                if len(part):
                    near = (_unit(np.stack(part["x"].to_numpy())) @ q.T >= limit + 1e-9) & (part["id"].to_numpy()[:, None] != ids)
                    n = part["copies"].to_numpy() @ near
                    yield pd.DataFrame({"id": ids[n > 0], "true": n[n > 0]})

        true = points.mapInPandas(compare, f"id {kind}, true long").groupBy("id").agg(F.sum("true").alias("true"))
        n, hit = true.join(more, "id", "left").agg(F.coalesce(F.sum("true"), F.lit(0)), F.coalesce(F.sum(F.least("true", "more")), F.lit(0))).first()
        if n >= AUDIT_LINKS or len(asked) < queries or queries >= MOST_ASKED:
            return hit / n if n else 1.0
        queries *= 2


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, overlap: int = OVERLAP, recall: float = RECALL) -> DataFrame:
    """Link vectors with cosine >= limit: (key, n_links, component_id, kept), a row for every row of vectors.

    n_links counts the other vectors that one links with directly, component_id is the smallest key that links reach, kept
    marks the vector that gives its component the name.  Null, empty and zero vectors and those with a null or non-finite
    component have no links and are kept; vectors of different lengths don't link; equal vectors do, whatever
    their number, without being paired.  A null key stands alone (null component, not kept); rows with equal keys get
    the same result, their vectors being taken as copies.  Other columns are ignored.
    """
    good = points_of(vectors, key, vector)
    groups = written(good.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "points")
    points = groups.select("id", "x", "copies").dropDuplicates(["id"])
    kind = dict(vectors.dtypes)[key]
    more = vectors.sparkSession.createDataFrame([], f"id {kind}, more long")
    links = vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    for (size,) in points.select(F.size("x").alias("s")).distinct().orderBy("s").collect():
        part = points.where(F.size("x") == size)
        wide = overlap
        while True:
            own, pairs = counted(find_links(part, limit, wide, exact=wide > 4 * overlap), part)
            if wide > 4 * overlap or audit(part, own, limit) >= recall:
                break
            wide *= 2
        more, links = more.unionByName(own), links.unionByName(pairs)
    comp = components(links).select(F.col("node").alias("id"), F.col("component").alias("comp"))
    reps = groups.join(more, "id", "left").join(comp, "id", "left")
    reps = reps.select("x", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("comp", "id").alias("comp"))
    mine = good.join(reps, "x").groupBy("id").agg(F.max("n").alias("n"), F.min("comp").alias("comp"))
    out = vectors.select(F.col(key).alias("id")).join(mine, "id", "left")
    component = F.coalesce("comp", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept")
    )
