"""Near-duplicate embeddings by an inverted multi-index.

Two independent codebooks, one for each half of the unit vectors, form a grid of cells.
A vector is stored in the cell of its nearest codewords, and looked for from every cell
that a near copy of it could lie in, nearest first. Pairs that meet are verified by their
cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlesieve.llm.components import components, forest
from titlesieve.sources.storage import materialise

THRESHOLD = 0.98
#: Chance that a near copy, displaced in a random direction, is in a cell that is visited.
TARGET_RECALL = 1 - 1e-9
#: Vectors that the codebooks are fitted on, at most.
TRAIN_ROWS = 4_096
#: Rows of a cell that one task compares with so many queries at a time.
STORED_BLOCK, QUERY_BLOCK = 1_024, 4_096
#: Vectors of one label that a cell should hold on average, and codewords at most.
CELL_ROWS, MOST_CODEWORDS = 64, 64


class Codebooks(NamedTuple):
    left: np.ndarray
    right: np.ndarray
    reach: float  # squared distance to the borders of a cell up to which it is visited


def fit_codebooks(sample: np.ndarray, codewords: int, threshold: float, recall: float) -> Codebooks:
    """k-means codebooks of both halves of unit vectors.

    A pair at the threshold is rho = sqrt(2 - 2 * threshold) apart. To be in another cell
    it has to cross a border in one half or one in each, so its displacement has a squared
    projection on those directions of at least the squared distance to the borders. In a
    random direction of d dimensions the projection on a plane is above x * rho**2 with
    probability (1 - x)**(d/2 - 1). ``recall`` = 1 visits every cell that is possible at all.
    """
    width = sample.shape[1]
    half = width // 2
    books = [_kmeans(part, codewords) for part in (sample[:, :half], sample[:, half:])]
    share = 1.0
    if recall < 1 and width > 2:
        share = 1 - (1 - recall) ** (1 / (width / 2 - 1))
    return Codebooks(*books, (2 - 2 * threshold) * share)


def _kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(11)
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        nearest = _squared(points, centres).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        centres[counts > 0] = total[counts > 0] / counts[counts > 0, None]
    return np.unique(centres, axis=0)


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)


def _borders(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre, and squared distance to the border between it and each other one."""
    away = _squared(points, centres)
    nearest = away.argmin(axis=1)
    apart = _squared(centres, centres)[nearest]
    gap = away - away[np.arange(len(points)), nearest][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        border = np.where(apart > 1e-18, np.maximum(gap, 0) ** 2 / (4 * apart), 0.0)
    return nearest, border


def multi_sequence(left: np.ndarray, right: np.ndarray, reach: float) -> np.ndarray:
    """Cells (i * len(right) + j) with left[i] + right[j] <= reach, nearest first.

    Both lists are put in order; the cells within reach then are a staircase of prefixes.
    """
    i, j = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    stairs = np.searchsorted(right[j], reach - left[i], "right")
    rows = np.repeat(np.arange(len(i)), stairs)
    columns = np.arange(len(rows)) - np.repeat(np.cumsum(stairs) - stairs, stairs)
    order = np.argsort(left[i[rows]] + right[j[columns]], kind="stable")
    return (i[rows] * len(right) + j[columns])[order]


def _unit(batch_column: pa.Array, width: int) -> np.ndarray:
    points = batch_column.flatten().to_numpy().astype(np.float64).reshape(-1, width)
    # By a power of two first, which is exact: squares of very large or small numbers are not.
    _, exponent = np.frexp(np.abs(points).max(axis=1, initial=0))
    points = np.ldexp(points, -exponent[:, None])
    return points / np.sqrt((points**2).sum(axis=1))[:, None]


def _place(shared, width: int):
    """Cell and visited cells of (label, rep, copies, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            points = _unit(batch.column(3), width)
            half = width // 2
            i, left = _borders(points[:, :half], books.left)
            j, right = _borders(points[:, half:], books.right)
            visits = [multi_sequence(a, b, books.reach) for a, b in zip(left, right)]
            ends = np.concatenate([[0], np.cumsum([len(v) for v in visits])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *visits]).astype(np.int32)
            cell = pa.array((i * len(books.right) + j).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), cell,
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["label", "rep", "copies", "embedding", "cell", "visits"],
            )

    return run


def _compare(threshold: float, width: int):
    """Links of one block: (rep, n vectors linked, parent in this block's forest or null)."""

    def run(table: pa.Table) -> pa.Table:
        stored = table["stored"].to_numpy().astype(bool)
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        points = _unit(table["embedding"].combine_chunks(), width)
        s, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        # Each pair is looked for once, from its larger number.
        hit = (points[q] @ points[s].T >= threshold) & (rep[q][:, None] > rep[s][None, :])
        of_query, of_stored = hit @ copies[s], hit.T @ copies[q]
        a, b = np.nonzero(hit)
        node, root = forest(rep[q[a]], rep[s[b]])
        counted = np.concatenate([rep[q], rep[s]]), np.concatenate([of_query, of_stored])
        some = counted[1] > 0
        reps = np.concatenate([counted[0][some], node])
        return pa.table({
            "rep": reps,
            "n": np.concatenate([counted[1][some], np.zeros(len(node), np.int64)]),
            "parent": pa.array(
                np.concatenate([np.zeros(int(some.sum()), np.int64), root]),
                mask=np.arange(len(reps)) < int(some.sum()),
            ),
        })

    return run


def _linked(classes: DataFrame, width: int, threshold: float, recall: float) -> DataFrame:
    """label, embedding, links, component of classes of vectors of one length."""
    largest = classes.groupBy("label").count().agg(F.max("count")).head()[0]
    sample = (
        classes.orderBy(F.xxhash64("rep")).limit(TRAIN_ROWS).select("embedding").toArrow()["embedding"]
    )
    codewords = int(np.clip(np.ceil(np.sqrt(largest / CELL_ROWS)), 1, MOST_CODEWORDS))
    books = fit_codebooks(_unit(sample.combine_chunks(), width), codewords, threshold, recall)
    shared = classes.sparkSession.sparkContext.broadcast(books)
    placed = materialise(
        classes.select("label", "rep", "copies", "embedding").mapInArrow(
            _place(shared, width),
            "label string, rep long, copies long, embedding array<double>, cell int, visits array<int>",
        ),
        "placed",
    )
    visits = placed.select("label", "rep", "copies", "embedding", F.explode("visits").alias("cell"))
    n_stored = placed.groupBy("label", "cell").agg(F.count("*").alias("n_stored"))
    n_query = visits.groupBy("label", "cell").agg(F.count("*").alias("n_query"))
    grid = n_stored.join(n_query, ["label", "cell"]).select(
        "label",
        "cell",
        F.ceil(F.col("n_stored") / STORED_BLOCK).cast("int").alias("stored_blocks"),
        F.ceil(F.col("n_query") / QUERY_BLOCK).cast("int").alias("query_blocks"),
    )

    def dealt(side: DataFrame, own: str, other: str, stored: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("rep"), F.col(f"{own}_blocks")).cast("int")
        return side.join(grid, ["label", "cell"]).select(
            "label", "cell", "rep", "copies", "embedding", F.lit(int(stored)).alias("stored"),
            block.alias(f"{own}_block"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
        )

    pairs = dealt(placed, "stored", "query", True).unionByName(dealt(visits, "query", "stored", False))
    compared = materialise(
        pairs.groupBy("label", "cell", "stored_block", "query_block").applyInArrow(
            _compare(threshold, width), "rep long, n long, parent long"
        ),
        "compared",
    )
    counts = compared.groupBy("rep").agg(F.sum("n").alias("n"))
    links = compared.where("parent is not null").select(F.col("rep").alias("a"), F.col("parent").alias("b"))
    found = components(links).toDF("rep", "component")
    return (
        classes.select("label", "embedding", "rep", "copies")
        .join(counts, "rep", "left")
        .join(found, "rep", "left")
        .select(
            "label", "embedding",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``.

    ``vectors`` has vec_id, embedding (ARRAY<FLOAT> or DOUBLE) and label; other columns
    are ignored. Vectors of one non-null label are linked if their cosine is at least
    ``threshold``; vectors of different lengths are not, each length is worked through on
    its own. A vector that is null, empty, zero, or has a null or non-finite component is
    linked with nothing; so is a null id. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id that links lead to, itself included, ``kept``
    marks that vector. An empty table gives no rows.

    Equal vectors of a label are one class, with their number. Codebooks are fitted on at
    most TRAIN_ROWS vectors, drawn by a hash of the id; all vectors are indexed and
    searched. Cells and their queries are dealt into blocks of bounded size, so neither a
    hot label nor a hot cell is one task, and a block gives counts and a forest, not
    pairs. The stages run when this function is called.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)),
    )
    valid = (
        (F.size("embedding") > 0)
        & finite
        & F.exists("embedding", lambda x: x != 0)
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
    )
    marked = rows.select("*", F.coalesce(valid, F.lit(False)).alias("valid"))
    classes = materialise(
        marked.where("valid")
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("width", F.size("embedding")),
        "vector-classes",
    )
    widths = sorted(row.width for row in classes.select("width").distinct().collect())
    if not widths:
        return rows.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    by_class = reduce(
        DataFrame.unionByName,
        [_linked(classes.where(F.col("width") == w).drop("width"), w, threshold, recall) for w in widths],
    )
    joined = marked.select("vec_id", "valid", "label", "embedding").join(
        by_class.withColumn("valid", F.lit(True)), ["valid", "label", "embedding"], "left"
    )
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
