"""Near-duplicate embeddings: inverted lists with product-quantised residuals, table-lookup distances, exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, written

#: Vectors the index is fitted on at the most; every vector is indexed.
SAMPLE = 20_000
#: Vectors of a label that a list should hold, the fewest and (as the sample is bounded) the most lists, subspaces, codewords, vectors of a block.
PER_LIST, FEWEST, LISTS, SUBSPACES, CODES, BLOCK = 2_000, 16, 1_024, 8, 64, 512


@dataclass(frozen=True)
class Index:
    """Coarse centroids (lists x dim) and codebooks (subspace -> codes x width) of unit vectors of one dimension."""

    coarse: np.ndarray
    books: tuple[np.ndarray, ...]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = (x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse * self.coarse).sum(1)
        return d.argmin(1), np.maximum(d, 0)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual to what its codes stand for."""
        codes, err, at = [], np.zeros(len(residual)), 0
        for b in self.books:
            r = residual[:, at : at + b.shape[1]]
            d = (r * r).sum(1)[:, None] - 2 * r @ b.T + (b * b).sum(1)
            c = d.argmin(1)
            codes.append(c)
            err += ((r - b[c]) ** 2).sum(1)
            at += b.shape[1]
        return np.stack(codes, 1).astype(np.uint8), np.sqrt(err)

    def distances(self, q: np.ndarray, centroid: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: of each query's residual to each code's vector, by sums of table entries."""
        r, at, out = q - centroid, 0, np.zeros((len(q), len(codes)))
        for m, b in enumerate(self.books):
            x = r[:, at : at + b.shape[1]]
            table = (x * x).sum(1)[:, None] - 2 * x @ b.T + (b * b).sum(1)
            out += table[:, codes[:, m]]
            at += b.shape[1]
        return np.sqrt(np.maximum(out, 0))


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        total, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int) -> Index:
    """An index from a sample of vectors of one dimension."""
    x = unit(sample.astype(np.float64))
    coarse = _kmeans(x, max(1, lists))
    near = ((coarse * coarse).sum(1) - 2 * x @ coarse.T).argmin(1)
    residual = x - coarse[near]
    return Index(coarse, tuple(_kmeans(r, CODES) for r in np.array_split(residual, min(SUBSPACES, x.shape[1]), axis=1)))


def usable(c: Column) -> Column:
    """Not null or zero, with finite components only."""
    good = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & good & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _joined(met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links the least vertex that its links reach (rows first, then columns)."""
    n, m = met.shape
    rows, cols, none = np.arange(n), n + np.arange(m), n + m
    while True:
        new_rows = np.minimum(rows, np.where(met, cols[None], none).min(axis=1, initial=none))
        new_cols = np.minimum(cols, np.where(met, new_rows[:, None], none).min(axis=0, initial=none))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def link_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """Links between classes (columns id, label, n, vec, all of one dimension) with equal label and cosine >= threshold.

    (id, other, linked): rows with other null say that ``linked`` vectors of other classes link with id (to be
    summed), the others are edges that join what links. A block of two times BLOCK vectors gives that many rows of
    either kind at the most, however many of its pairs link.

    A vector x lies in the list of its nearest centroid. If x is within r of a query, the query is within r of
    the plane between its own centroid and that list's, so only lists beyond that are left out; codes are left
    out only if even their quantisation error can't bring them within r. Nothing that links is lost, so the
    recall is 1 (tests measure it against brute force). Lists of any length are cut into blocks of about BLOCK,
    and a block of queries meets a block of the list in one row.
    """
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], _LINKS)
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    sample = [r[0] for r in classes.orderBy(F.xxhash64("id"), "id").select("vec").limit(SAMPLE).collect()]
    index = fit(_matrix(sample), int(min(LISTS, len(sample), max(FEWEST, most // PER_LIST))))
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = np.sqrt(np.maximum(((index.coarse[:, None] - index.coarse[None]) ** 2).sum(2), 1e-18))
        for b in batches:
            if not len(b):
                continue
            x = unit(_matrix(b["vec"]))
            own, d = index.nearest(x)
            codes, err = index.encode(x - index.coarse[own])
            to_plane = (d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own])
            ok = to_plane <= r
            ok[np.arange(len(x)), own] = True
            ok &= np.arange(len(index.coarse))[None] >= own[:, None]  # the other way the pair is met from the other side
            yield b.assign(list=own.astype("int32"), code=[c.tobytes() for c in codes], err=err, probes=[np.flatnonzero(o).astype("int32") for o in ok])

    kind = f"id long, label {classes.schema['label'].dataType.simpleString()}, n long, vec {classes.schema['vec'].dataType.simpleString()}, list int, code binary, err double, probes array<int>"
    placed, _ = written(classes.select("id", "label", "n", "vec").mapInPandas(place, kind), "placed")

    def blocks(rows: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
        """Rows of a label and list in about equal blocks, dealt by a hash of their id."""
        sizes = rows.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n_blocks"))
        dealt = rows.join(sizes, ["label", "list"]).withColumn(name, F.pmod(F.xxhash64("id"), F.col("n_blocks")))
        return dealt.groupBy("label", "list", name).agg(F.collect_list(F.struct(*columns)).alias("rows"))

    stored = blocks(placed.drop("probes"), "s", ("id", "n", "vec", "code", "err"))
    asked = blocks(placed.select("id", "label", "n", "vec", F.col("list").alias("own"), F.explode("probes").alias("list")), "q", ("id", "n", "vec", "own"))
    pairs = asked.withColumnRenamed("rows", "asked").join(stored, ["label", "list"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lst, asked, rows in zip(b["list"], b["asked"], b["rows"]):
                q, x = _matrix([v["vec"] for v in asked]), _matrix([v["vec"] for v in rows])
                (qi, qn), (xi, xn) = (np.array([(v["id"], v["n"]) for v in side]).T for side in (asked, rows))
                codes = np.stack([np.frombuffer(v["code"], dtype=np.uint8) for v in rows])
                err = np.array([v["err"] for v in rows])
                near = index.distances(unit(q), index.coarse[lst], codes) - err[None] <= r + 1e-6
                i, j = np.nonzero(near & (qi[:, None] != xi[None]))
                cosine = (q[i] * x[j]).sum(1) / (np.linalg.norm(q[i], axis=1) * np.linalg.norm(x[j], axis=1))
                met = np.zeros(near.shape, dtype=bool)
                met[i, j] = cosine >= threshold
                if not met.any():
                    continue
                own = np.array([v["own"] for v in asked]) == lst  # these pairs are met from either side
                ids, (to_rows, to_cols) = np.concatenate((qi, xi)), _joined(met)
                to = np.concatenate((to_rows, to_cols))
                moved = np.flatnonzero(to != np.arange(len(to)))
                of_q, of_x = met @ xn, (met & ~own[:, None]).T @ qn
                n = np.concatenate((of_q[of_q > 0], of_x[of_x > 0]))
                told = np.concatenate((qi[of_q > 0], xi[of_x > 0]))
                yield pd.DataFrame(
                    {
                        "id": np.concatenate((told, ids[moved])),
                        "other": pd.array(np.concatenate((np.zeros(len(told), dtype=np.int64), ids[to[moved]])), dtype="Int64"),
                        "linked": np.concatenate((n, np.zeros(len(moved), dtype=np.int64))),
                    }
                ).assign(other=lambda d, k=len(told): d["other"].mask(np.arange(len(d)) < k))

    return pairs.select("list", "asked", "rows").mapInPandas(compare, _LINKS)


_LINKS = "id long, other long, linked long"


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links between equal labels with cosine >= threshold, in double precision.

    Equal vectors of a label are one class, which is compared once; its members link with one another and with
    all members of linked classes, and are counted, not paired. Vectors that are null, empty, zero or hold null
    or non-finite components, and null labels, link with nothing; vectors link only with those of their own
    dimension. A row with a null key links with nothing, has no component and isn't kept. Repeated keys each keep
    a row and count as vectors of their own; other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    of = vectors.schema[vector].dataType.elementType.simpleString()
    values = F.col(vector) if of in ("float", "double") else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), values.alias("vec"))
    rows = rows.withColumn("good", usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("k1", F.when(F.col("good"), F.xxhash64("label", "vec"))).withColumn("k2", F.when(F.col("good"), F.xxhash64(F.lit(1), "vec", "label")))
    rows, _ = written(rows, "vectors")
    good = rows.where("good")
    classes, _ = written(good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec")), "classes")
    found = None
    for (dim,) in classes.select(F.size("vec")).distinct().collect():  # dimensions, usually one
        one = link_classes(classes.where(F.size("vec") == dim), threshold)
        found = one if found is None else found.unionByName(one)
    found, _ = written(found if found is not None else spark.createDataFrame([], _LINKS), "links")
    others = found.where("other is null").groupBy("id").agg(F.sum("linked").alias("linked"))
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    known = classes.join(others, "id", "left").join(parts, "id", "left")
    known = known.select("label", "k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("vec_id", "label", "k1", "k2").join(known, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: The same in DuckDB's SQL, over all pairs of a label.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(x, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
k AS (SELECT x, min(c) AS c FROM r GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, k.c AS component_id, vec_id = k.c AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN k ON k.x = vec_id
"""
