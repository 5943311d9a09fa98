"""Embedding near-dedup with int8 tile products.

Every vector is scaled to unit length and quantised to int8 with its own scale; the length of what quantisation
left over is kept as its error. For unit vectors x = s q + e the true product differs from s_x s_y (q_x . q_y) by at
most |e_x| (1 + |e_y|) + |e_y|, so the integer product decides most pairs: below the threshold by more than the
bound is no link, above it by more than the bound is one. Only pairs in between are computed in double precision.

Equal vectors become one class first. Classes are dealt into tiles of a bounded size; each pair of tiles is one unit
of work in which the int8 blocks are multiplied (as small integers in float32, whose products are exact) and the
links are counted and joined to a spanning forest in place; no pair leaves a task. Large inputs are dealt by nearest
pivot first, and a pair of tiles is left out if the angle of their centres minus both radii rules out any link. The
pairs of tiles are made and judged on the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import forest, read, unite
from lexweave.operators.graph import connected_components
from lexweave.operators.indexing import dense_index
from lexweave.plans.session import cut

#: Classes in a tile. Two tiles of 64 dimensions with their double-precision rows take about 25 MB.
TILE = 8192
#: Dimensions over which products of int8 numbers are summed exactly in float32.
EXACT = 1024
#: Rows of a block inside a tile product.
BLOCK = 256
#: Pivots are at most so many; they come from a sample of that size.
MAX_PIVOTS = 1024
#: Slack for the rounding of the scaled products (float32) and of the bounds themselves.
SLACK = 2e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, int8 rows, scales and the exact lengths of the errors."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)  # first: the length of the smallest numbers is none
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return unit, q, scale, error


def exact_products(qa: np.ndarray, fb: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows, in float32 as far as its sums are exact (127 * 127 * 1024 < 2 ** 24); of longer vectors the
    parts are added in float64."""
    if fb.shape[0] <= EXACT:
        return qa.astype(np.float32) @ fb
    out = np.zeros((len(qa), fb.shape[1]))
    for i in range(0, fb.shape[0], EXACT):
        out += qa[:, i : i + EXACT].astype(np.float32) @ fb[i : i + EXACT]
    return out


def tile_links(a: tuple, b: tuple, parent: np.ndarray, shift: int, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, each (unit, q, scale, error, count): for each row the number of vectors it is linked
    with on the other side. ``parent`` joins rows of a with rows of b, which start at ``shift``."""
    ua, qa, sa, ea, na = a
    ub, qb, sb, eb, nb = b
    to_a, to_b = np.zeros(len(sa), dtype=np.int64), np.zeros(len(sb), dtype=np.int64)
    fb = qb.astype(np.float32).T
    for i in range(0, len(sa), BLOCK):
        rows = slice(i, min(i + BLOCK, len(sa)))
        first = i if same else 0
        products = exact_products(qa[rows], fb[:, first:])
        products *= sa[rows, None].astype(np.float32)
        e = ea[rows].max()
        bar = (least - SLACK - (e * (1 + eb[first:]) + eb[first:])) / sb[first:]
        r, c = np.nonzero(products >= (bar - 1e-6 * np.abs(bar)).astype(np.float32))
        if not len(r):
            continue
        r_, c_ = r + i, c + first
        if same:
            ahead = c_ > r_
            r, c, r_, c_ = r[ahead], c[ahead], r_[ahead], c_[ahead]
        near = sb[c_] * products[r, c].astype(np.float64)
        bound = ea[r_] * (1 + eb[c_]) + eb[c_] + SLACK
        sure = near - bound >= least
        open_ = np.flatnonzero(~sure & (near + bound >= least))
        for s in range(0, len(open_), 1 << 16):
            part = open_[s : s + (1 << 16)]
            sure[part] = np.einsum("ij,ij->i", ua[r_[part]], ub[c_[part]]) >= least
        r_, c_ = r_[sure], c_[sure]
        if len(r_):
            np.add.at(to_a, r_, nb[c_])
            np.add.at(to_b, c_, na[r_])
            unite(parent, r_, c_ + shift)
    return to_a, to_b


def _pivots(classes: DataFrame, n: int, tile: int) -> np.ndarray:
    """Unit pivots from a bounded sample (the classes with the least hashes); none while a few tiles hold all."""
    count = min(MAX_PIVOTS, n // tile // 8)
    if count < 2:
        return np.zeros((1, 0))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(count).select("vec").collect()
    x = np.array([r["vec"] for r in rows if len(r["vec"]) == len(rows[0]["vec"])], dtype=np.float64)
    return quantise(x)[0]


def embedding_groups(vectors: DataFrame, least: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept.

    ``vectors``: vec_id, embedding (an array of numbers). Vectors link at a cosine of ``least`` or more, in double
    precision. A vector that is null, empty, all zero or holds a null or non-finite component links with nothing, and
    so do vectors of different lengths; such rows are their own component. Equal vectors link with each other. Rows
    with equal vec_ids are each returned and count as separate vectors; a row with a null vec_id counts as a partner
    but names no component (its component_id is that of its group, null if the group has no other id, and kept is
    false). Other columns are not read.
    """
    if not 0.0 < least <= 1.0:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vec")).withColumn(
        "vec", F.when(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda v: v != 0), F.col("vec"))
    )
    good = rows.where("vec is not null")
    classes = cut(good.groupBy("vec").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    pivots = _pivots(classes, n, tile)
    per_cell = None
    if pivots.shape[1]:

        def nearest(batches):
            for batch in batches:
                cell = np.zeros(len(batch))
                fits = np.flatnonzero(batch["vec"].map(len).to_numpy() == pivots.shape[1])
                if len(fits):
                    cell[fits] = np.argmax(np.stack(batch["vec"].to_numpy()[fits]) @ pivots.T, axis=1)
                yield batch.assign(cell=cell.astype(np.int32))

        celled = classes.mapInPandas(nearest, "vec array<double>, low long, n long, rep long, cell int")
        per_cell = F.broadcast(celled.groupBy("cell").count())  # a row for each pivot at most
        chunks = F.ceil(F.col("count") / tile)
        celled = celled.join(per_cell, "cell")
    else:
        celled, chunks = classes.withColumn("cell", F.lit(0)), F.lit(max(1, -(-n // tile)))
    place = F.pmod(F.xxhash64("rep", F.lit(1)), chunks.cast("long")).cast("int")
    # a class is numbered within the run by (cell, chunk, dimension), so that a tile has one width
    dealt = celled.select(F.concat_ws(".", F.size("vec"), "cell", place).alias("tile"), "vec", "low", "n", "rep")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for each tile: its blocks, and the cone that holds it."""
        pdf = pdf.sort_values("rep", kind="stable")
        v = np.stack(pdf["vec"].to_numpy())
        unit, q, scale, error = quantise(v)
        centre = unit.sum(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 0 else unit[0]
        radius = float(np.arccos(np.clip(unit @ centre, -1, 1)).max())
        blob = b"".join(np.ascontiguousarray(y).tobytes() for y in (unit, q, scale, error, pdf["n"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)))
        return pd.DataFrame([(key[0], len(v), v.shape[1], blob, centre.tolist(), radius)], columns=["tile", "m", "d", "blob", "centre", "radius"])

    tiles = cut(dealt.groupBy("tile").applyInPandas(pack, "tile string, m int, d int, blob binary, centre array<double>, radius double"))
    # pairs of tiles of one width, by number: each tile asks for those from its own number on
    cones = cut(dense_index(tiles.select("tile", "d", "centre", "radius"), ["tile"], "no", within=["d"]))
    asked = cones.join(cones.groupBy("d").agg(F.max("no").alias("last")), "d").select(
        "d", F.col("tile").alias("a"), F.col("centre").alias("centre_a"), F.col("radius").alias("radius_a"), F.explode(F.sequence("no", "last")).alias("no")
    )
    met = asked.join(cones, ["d", "no"])
    cosine = F.aggregate(F.zip_with("centre_a", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    near = met.where(angle - F.col("radius_a") - F.col("radius") <= float(np.arccos(least)) + 1e-6).select("a", F.col("tile").alias("b"))
    schedule = near.select(F.concat_ws(" ", "a", "b").alias("pair"), "a", "b")
    both = F.array(F.struct(F.col("a").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("b").alias("tile"), F.lit(1).alias("side")))
    sides = schedule.select("pair", F.inline(F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)))

    def unpack(row) -> tuple:
        m, d, raw, at, out = int(row["m"]), int(row["d"]), row["blob"], 0, []
        for kind, shape in ((np.float64, (m, d)), (np.int8, (m, d)), (np.float64, (m,)), (np.float64, (m,)), (np.int64, (m,)), (np.int64, (m,))):
            size = int(np.prod(shape))
            out.append(np.frombuffer(raw, dtype=kind, count=size, offset=at).reshape(shape))
            at += size * np.dtype(kind).itemsize
        return tuple(out)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a pair of tiles: for each row with links their number on the other side, and the forest's edge."""
        parts = [unpack(r) for _, r in pdf.sort_values("side").iterrows()]
        same = len(parts) == 1
        a, b = parts[0], parts[-1]
        shift = 0 if same else len(a[2])
        rep = a[5] if same else np.concatenate([a[5], b[5]])
        parent = np.arange(len(rep))
        to_a, to_b = tile_links(a[:5], b[:5], parent, shift, same, least)
        links = to_a + to_b if same else np.concatenate([to_a, to_b])
        at = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[at], "links": links[at], "root": rep[parent[at]]})

    found = cut(
        tiles.select("tile", "m", "d", "blob").join(sides, "tile").groupBy("pair").applyInPandas(multiply, "rep long, links long, root long")
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = connected_components(found, "rep", "root")
    labelled = classes.select("vec", "rep", "low", "n").join(counts, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    lows = labelled.groupBy("component").agg(F.min("low").alias("component_id"))
    labelled = labelled.join(lows, "component").select(F.col("vec").alias("own"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.join(labelled, F.col("vec") == F.col("own"), "left")
    alone = F.col("own").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT r, vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT r AS s, r AS t FROM v UNION SELECT reach.s, p.b FROM reach JOIN p ON reach.t = p.a),
c AS (SELECT s, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY s),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.s = v.r LEFT JOIN n ON n.a = v.r
"""
