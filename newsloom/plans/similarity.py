"""Exact cosine joins: blocks of bounded bytes are multiplied in numpy, pair of blocks by pair of blocks.

Vectors are unit length inside this module, so cosine c and distance d are tied by d^2 = 2 - 2c and the triangle
inequality applies: where vectors cluster, pairs of blocks that are too far apart are never sent. Where they do not, all
pairs of blocks are compared; a row is then sent once per block of the other side, and blocks are as large as a task's
memory allows, so few copies move. A task holds two blocks, multiplies them strip by strip and returns matches or maxima,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import vectors as V
from newsloom.plans.keys import split_hot_group, spread, top_per_key
from newsloom.plans.lineage import cut_lineage

BLOCK_ROWS = 2000  # no block is cut smaller for the sake of more tasks
BLOCK_VALUES = 1 << 22  # components in a block at most: 32 MB
STRIP_ROWS = 2048  # rows of either side that are multiplied at once
PIVOT_ROWS, MAX_PIVOTS = 1000, 1024  # one pivot per block of at least this many rows, and never more than this many
BATCH_PAIRS = 1 << 16  # pairs a task rates or hands back at once
SLACK = 1e-6  # the root in a distance turns rounding of 1e-16 into 1e-8; bounds are widened by more than that


def _unit(rows: DataFrame, row_id: str, vector: str, *extra: str) -> DataFrame:
    """Ids with unit vectors, and ``extra`` columns as they are; vectors without length or with missing or infinite parts match nothing."""
    length = V.norm(F.col(vector))
    known = rows.filter(F.col(vector).isNotNull() & (length > 0) & (length < float("inf"))).select(
        F.col(row_id).alias("id"), F.col(vector).alias("v"), *extra)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch["v"])
                points = points / np.sqrt((points * points).sum(axis=1))[:, None]
                yield pa.record_batch([batch["id"], _listed(points), *[batch[c] for c in extra]], ["id", "v", *extra])

    return known.mapInArrow(scale, ", ".join([
        f"id {known.schema['id'].dataType.simpleString()}", "v array<double>", *[f"{c} {known.schema[c].dataType.simpleString()}" for c in extra]]))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List values as rows of a matrix."""
    if column.null_count or pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors of different lengths cannot be compared; name the space they are of")
    flat = pc.list_flatten(column).to_numpy()
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def _listed(points: np.ndarray) -> pa.Array:
    offsets = np.arange(0, points.size + 1, points.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(points.ravel()))


def _size(units: DataFrame) -> tuple[int, int]:
    """Rows, and rows that fit into a block."""
    row = units.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    return row["n"], max(1, BLOCK_VALUES // max(1, row["dims"] or 1))


def _tasks(df: DataFrame) -> int:
    """Tasks that keep all cores busy to the end."""
    spark = df.sparkSession
    return 3 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _halves(batches: Iterator[pa.RecordBatch]) -> list[pa.Table] | None:
    """The left and the right block."""
    both = pa.Table.from_batches(list(batches))
    halves = [both.filter(mask) for mask in (both["is_left"], pc.invert(both["is_left"]))]
    return halves if all(half.num_rows for half in halves) else None


def _sides(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Ids and vectors of the left and of the right block."""
    halves = _halves(batches)
    if halves is None:
        return None
    (a, x), (b, y) = [(half["id"].to_numpy(), _matrix(half["v"])) for half in halves]
    return a, x, b, y


def _strips(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(i, j, cosines)`` of strips of both sides that start at rows i and j."""
    for i in range(0, len(left), STRIP_ROWS):
        for j in range(0, len(right), STRIP_ROWS):
            yield i, j, np.clip(left[i:i + STRIP_ROWS] @ right[j:j + STRIP_ROWS].T, -1.0, 1.0)


def _close(left: np.ndarray, right: np.ndarray, threshold: float, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, columns, cosines)`` of all pairs at least ``threshold`` alike, strip by strip; of one block with itself each pair once.

    Strips are multiplied in single precision; what comes within its rounding of the threshold is rated in double precision.
    """
    rough = [left.astype(np.float32)] + ([] if alone else [right.astype(np.float32)])
    least = np.float32(threshold - (left.shape[1] + 8) * 2.0 ** -22)
    for i in range(0, len(left), STRIP_ROWS):
        for j in range(i if alone else 0, len(right), STRIP_ROWS):
            x, y = left[i:i + STRIP_ROWS], right[j:j + STRIP_ROWS]
            near = np.flatnonzero(rough[0][i:i + STRIP_ROWS] @ rough[-1][j:j + STRIP_ROWS].T >= least)
            exact = (x @ y.T).ravel() if len(near) * 8 > len(x) * len(y) else None
            for at in range(0, len(near), BATCH_PAIRS):
                flat = near[at:at + BATCH_PAIRS]
                row, col = np.divmod(flat, len(y))
                if alone and i == j:
                    upper = row < col
                    flat, row, col = flat[upper], row[upper], col[upper]
                cosines = np.einsum("ij,ij->i", x[row], y[col]) if exact is None else exact[flat]
                hit = cosines >= threshold
                yield row[hit] + i, col[hit] + j, np.clip(cosines[hit], -1.0, 1.0)


def _pivots(units: DataFrame, count: int) -> np.ndarray:
    """A few vectors picked by id hash."""
    picked = units.orderBy(F.xxhash64("id"), "id").limit(count).collect()
    return np.array([row["v"] for row in picked], dtype=np.float64)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * points @ pivots.T))


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("id"), count).cast("int")


def _pair_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Place ``(cell, id, v)`` rows of both sides into (cell, left block, right block) tasks."""
    left_sizes = left.groupBy("cell").agg(split_hot_group(F.count(F.lit(1)), BLOCK_ROWS).alias("nl"))
    right_sizes = right.groupBy("cell").agg(split_hot_group(F.count(F.lit(1)), BLOCK_ROWS).alias("nr"))
    sizes = left_sizes.join(right_sizes, "cell")

    def place(rows: DataFrame, own: str, other: str, side: bool) -> DataFrame:
        across = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = rows.join(sizes, "cell").withColumn("_own", _block(F.col(own))).withColumn("_other", across)
        bl, br = ("_own", "_other") if side else ("_other", "_own")
        return placed.select("cell", F.col(bl).alias("bl"), F.col(br).alias("br"), F.lit(side).alias("is_left"), "id", "v")

    both = place(left, "nl", "nr", True).unionByName(place(right, "nr", "nl", False))
    return spread(both, "cell", "bl", "br")


def _split(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    left, right = block[block["is_left"]], block[~block["is_left"]]
    if left.empty or right.empty:
        return None
    cosines = np.vstack(left["v"].to_numpy()) @ np.vstack(right["v"].to_numpy()).T
    return left["id"].to_numpy(), right["id"].to_numpy(), np.clip(cosines, -1.0, 1.0)


#: Made in a task from the ``about`` columns of two blocks; of the pairs found, as positions in the blocks, it tells which to return.
Chooser = Callable[[pa.ChunkedArray, pa.ChunkedArray], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def similar_pairs(rows: DataFrame, row_id: str, vector: str, threshold: float, folded: bool = True, about: str | None = None,
                  choose: Chooser | None = None) -> DataFrame:
    """``(src, dst, cosine)`` with src < dst for all vectors at least ``threshold`` alike.

    ``folded``: exact copies are folded first. Copies hang on their smallest id by a star of edges with cosine 1, and only
    that representative is compared with other vectors, so a large group of copies costs one edge per copy. This keeps
    what is connected, but not all pairs. Otherwise every pair of rows is returned, copies or not.

    Who needs of the pairs only some, such as those that connect groups, and cannot hold all, names a column ``about`` that goes
    along with the rows and a ``choose`` that picks pairs in the task that finds them.
    """
    extra = [] if about is None else [about]
    units = cut_lineage(_unit(rows, row_id, vector, *extra))
    id_type = units.schema["id"].dataType.simpleString()
    if folded:
        reps = cut_lineage(units.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
        stars = units.join(reps.filter("n > 1").select("v", "rep"), "v").filter(F.col("id") != F.col("rep")).select(
            F.col("rep").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("cosine"))
        compared = reps.select(F.col("rep").alias("id"), "v")
    else:
        stars, compared = None, units
    total, fit = _size(compared)
    if not total:
        return stars if folded else rows.sparkSession.createDataFrame([], f"src {id_type}, dst {id_type}, cosine double")
    # n blocks make n * (n + 1) / 2 pairs, several to a core; a row is sent n times, so no more blocks than cores ask for
    wished = -(-total // int(np.ceil(np.sqrt(6 * rows.sparkSession.sparkContext.defaultParallelism))))
    block_rows = min(fit, max(BLOCK_ROWS, wished))
    pivots = _pivots(compared, min(MAX_PIVOTS, -(-total // max(PIVOT_ROWS, block_rows))))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _distances(_matrix(batch["v"]), pivots)
                cell = away.argmin(axis=1)
                yield pa.record_batch([pa.array(cell.astype(np.int32)), *batch.columns, pa.array(away.min(axis=1))],
                                      ["cell", *batch.schema.names, "away"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in compared.schema)
    placed = cut_lineage(compared.mapInArrow(home, f"cell int, {kept}, away double"))
    blocks = placed.join(_visits(placed, pivots, block_rows, float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))), "cell").select(
        *compared.columns, (F.col("first") + _block(F.col("subs"))).alias("block"),
        F.explode(F.col("visits")[_block(F.col("subs"))]).alias("other"))
    # a block meets itself in one task, to which its rows are sent once
    sent = blocks.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                         (F.col("block") <= F.col("other")).alias("is_left"), *compared.columns)

    def match(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone = key[0].as_py() == key[1].as_py()
        halves = [pa.Table.from_batches(list(batches))] * 2 if alone else _halves(batches)
        if halves is None:
            return
        ids = [half["id"].to_numpy() for half in halves]
        points = [_matrix(halves[0]["v"])] * 2 if alone else [_matrix(half["v"]) for half in halves]
        chosen = choose(halves[0][about], halves[1][about]) if choose is not None else None
        del halves
        for row, col, cosines in _close(*points, threshold, alone):
            if not folded:  # ids may repeat
                other = ids[0][row] != ids[1][col]
                row, col, cosines = row[other], col[other], cosines[other]
            if chosen is not None:
                kept = chosen(row, col)
                row, col, cosines = row[kept], col[kept], cosines[kept]
            one, two = ids[0][row], ids[1][col]
            yield pa.record_batch([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(cosines)],
                                  ["src", "dst", "cosine"])

    found = _dealt(sent, "lo", "hi").groupBy("lo", "hi").applyInArrow(match, f"src {id_type}, dst {id_type}, cosine double")
    return found.unionByName(stars) if folded else found


def _visits(placed: DataFrame, pivots: np.ndarray, block_rows: int, reach: float) -> DataFrame:
    """``(cell, first, subs, visits)``: a cell's blocks, numbered from ``first``, and the blocks each of them is compared with.

    Cells whose pivots are further apart than both radii and ``reach`` hold no match.
    """
    # one row per pivot
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).orderBy("cell").collect()
    subs = np.array([-(-c["n"] // block_rows) for c in cells])
    first = np.concatenate([[0], np.cumsum(subs)])
    centres, radii = pivots[[c["cell"] for c in cells]], np.array([c["radius"] for c in cells])
    meet = _distances(centres, centres) - radii[:, None] - radii[None, :] <= reach + SLACK
    np.fill_diagonal(meet, True)
    rows = []
    for at, cell in enumerate(cells):
        others = [int(b) for o in np.nonzero(meet[at])[0] for b in range(first[o], first[o + 1])]
        rows.append((cell["cell"], int(first[at]), int(subs[at]), [others] * int(subs[at])))
    return placed.sparkSession.createDataFrame(rows, "cell int, first int, subs int, visits array<array<int>>")


def _dealt(sent: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs of blocks dealt to tasks, several tasks to a core, as one pair can be far more work than its bytes tell."""
    return sent.repartition(_tasks(sent), left, right)


def nearest(queries: DataFrame, query_id: str, query_vector: str, corpus: DataFrame, corpus_id: str,
            corpus_vector: str, k: int) -> DataFrame:
    """Exact ``k`` nearest corpus rows per query: ``(query, neighbour, cosine, rank)``; equals rank by id.

    Every block of queries meets every block of the corpus. A task keeps the best ``k`` of a query as it goes through its
    corpus block and returns no more than these.
    """
    wanted = cut_lineage(_unit(queries, query_id, query_vector))
    stored = cut_lineage(_unit(corpus, corpus_id, corpus_vector))
    qt, ct = wanted.schema["id"].dataType.simpleString(), stored.schema["id"].dataType.simpleString()
    schema = f"query {qt}, neighbour {ct}, cosine double"
    (asked, fit), (total, _) = _size(wanted), _size(stored)
    if not total or not asked:
        return wanted.sparkSession.createDataFrame([], schema + ", rank int")
    across = -(-total // fit)
    down = max(-(-asked // fit), min(-(-_tasks(wanted) // across), -(-asked // BLOCK_ROWS)))

    def side(rows: DataFrame, is_left: bool) -> DataFrame:
        own, other = (down, across) if is_left else (across, down)
        visits = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        bl, br = (_block(F.lit(own)), visits) if is_left else (visits, _block(F.lit(own)))
        return rows.select(bl.alias("bl"), br.alias("br"), F.lit(is_left).alias("is_left"), "id", "v")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _sides(batches)
        if parts is None:
            return
        a, x, b, y = parts
        for i in range(0, len(a), STRIP_ROWS):
            strip = x[i:i + STRIP_ROWS]
            worst = np.full(len(strip), -np.inf)
            row, ids, found = np.empty(0, np.int64), b[:0], np.empty(0)
            for _, j, cosines in _strips(strip, y):
                if cosines.shape[1] >= k and np.isneginf(worst).any():
                    worst = np.maximum(worst, np.partition(cosines, -k, axis=1)[:, -k])
                hit, col = np.nonzero(cosines >= worst[:, None])
                row, ids, found = np.concatenate([row, hit]), np.concatenate([ids, b[col + j]]), np.concatenate([found, cosines[hit, col]])
                order = np.lexsort((ids, -found, row))
                row, ids, found = row[order], ids[order], found[order]
                starts = np.searchsorted(row, np.arange(len(strip)))
                keep = np.arange(len(row)) - starts[row] < k
                row, ids, found = row[keep], ids[keep], found[keep]
                held = np.bincount(row, minlength=len(strip))
                ends = np.cumsum(held) - 1
                worst = np.where(held == k, found[np.maximum(ends, 0)], worst)
            yield pa.record_batch([pa.array(a[i + row]), pa.array(ids), pa.array(found)], ["query", "neighbour", "cosine"])

    blocks = _dealt(side(wanted, True).unionByName(side(stored, False)), "bl", "br")
    ranked = blocks.groupBy("bl", "br").applyInArrow(best, schema)
    return cut_lineage(top_per_key(ranked, ["query"], (F.col("cosine").desc(), F.col("neighbour")), k, rank="rank"))


def best_in_group(members: DataFrame, group: str, row_id: str, vector: str) -> DataFrame:
    """``(group, id, best_cosine)``: best cosine of every member to another member of its group.

    Small groups share a block, large groups are cut into block pairs; members without another
    member to compare with are absent. A vector without length has cosine 0 to everything.
    """
    rows = cut_lineage(members.filter(F.col(vector).isNotNull()).select(
        F.col(group).alias("grp"), F.col(row_id).alias("id"), V.unit(F.col(vector)).alias("v")))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = sizes.filter(F.col("n") <= BLOCK_ROWS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = max(1, -(-int(total) // BLOCK_ROWS))
    sized = rows.join(sizes, "grp")
    small = sized.filter(F.col("n") <= BLOCK_ROWS).withColumn("slot", F.pmod(F.xxhash64("grp"), F.lit(shared)))
    # a small group is both sides of its one block, so its rows are sent once
    together = small.select(F.lit(None).cast(types["grp"]).alias("cell"), F.col("slot").cast("int").alias("bl"),
                            F.lit(-1).alias("br"), F.lit(True).alias("is_left"), "grp", "id", "v")
    large = sized.filter(F.col("n") > BLOCK_ROWS).select(F.col("grp").alias("cell"), "id", "v")
    apart = _pair_blocks(large, large).withColumn("grp", F.col("cell"))

    def peak(block: pd.DataFrame) -> pd.DataFrame:
        left = block[block["is_left"]]
        right = left if block["br"].iloc[0] < 0 else block[~block["is_left"]]
        out = {"grp": left["grp"].to_numpy(), "id": left["id"].to_numpy()}
        if left.empty or right.empty:
            return pd.DataFrame({"grp": [], "id": [], "best_cosine": []})
        cosines = np.clip(np.vstack(left["v"].to_numpy()) @ np.vstack(right["v"].to_numpy()).T, -1.0, 1.0)
        allowed = (left["grp"].to_numpy()[:, None] == right["grp"].to_numpy()[None, :]) & (
            left["id"].to_numpy()[:, None] != right["id"].to_numpy()[None, :])
        best = np.where(allowed, cosines, -np.inf).max(axis=1)
        found = pd.DataFrame({**out, "best_cosine": best})
        return found[np.isfinite(best)]

    blocks = spread(together.unionByName(apart.select(*together.columns)), "cell", "bl", "br")
    return blocks.groupBy("cell", "bl", "br").applyInPandas(
        peak, f"grp {types['grp']}, id {types['id']}, best_cosine double").groupBy("grp", "id").agg(
        F.max("best_cosine").alias("best_cosine"))
