"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import components, cut, table

#: Vectors with this cosine or more are linked.
LEAST_COSINE = 0.95
#: Vectors that the cells are fitted on at most, vectors a cell is meant for, cells of one length at least and at most, rounds of the fit.
FIT_ROWS, CELL_ROWS, LEAST_CELLS, MOST_CELLS, ROUNDS = 65_536, 8_192, 16, 16_384, 8
#: Bytes of the vectors that the cells are fitted on, of which the centres of one length take a quarter at most.
FIT_BYTES = 64 << 20
#: Home rows of a block, and rows multiplied at a time.
BLOCK, STRIP = 4_096, 256

_THETA = float(np.arccos(LEAST_COSINE))
#: Slack for rounding where a bound prunes.
_SLACK = 1e-9


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (the components' bytes in double precision, null if it links with nothing), key (a digest of the bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "vec"])

    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return raw.mapInArrow(run, "vec_id long, vec binary").withColumn("key", F.md5("vec"))


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_cells(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of k cells by spherical k-means on unit vectors x, begun at evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([(x[lo : lo + 4096] @ centres.T).argmax(1) for lo in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.sqrt((sums * sums).sum(1))
        full = norm > 1e-12
        centres[full] = sums[full] / norm[full, None]
    return centres


def _assign(spaces: dict[int, np.ndarray]):
    """Each vector to its home cell and to every cell whose border it is within half the linking angle of.

    Between two linked vectors of different cells the border of their cells passes; one of them is within half their
    angle of it, so the pair meets in a cell where the other is at home. A row at home lists the cells it is sent to.
    spaces: centres by length; a length without any is one cell around its first axis. Cells are numbered through all
    lengths.
    """
    near = np.sin(_THETA / 2) + _SLACK
    names = ["cell", "home", "band", "rep", "n", "cells", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_raw = b.column(2).to_pylist()
            lengths = np.fromiter((len(r) // 8 for r in all_raw), np.int64, len(all_raw))
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                centres = spaces.get(length, np.eye(1, length))
                apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 1e-18))
                for lo in range(0, len(rows), 1024):
                    part = b.take(pa.array(rows[lo : lo + 1024]))
                    x = unit([all_raw[r] for r in rows[lo : lo + 1024]])
                    dots = x @ centres.T
                    home = dots.argmax(1)
                    margin = (dots[np.arange(len(x)), home][:, None] - dots) / apart[home]
                    also = margin <= near
                    also[np.arange(len(x)), home] = True
                    row, cell = np.nonzero(also)
                    lists = [(np.flatnonzero(a) + length * MOST_CELLS).tolist() for a in also]
                    angle = np.arccos(np.clip(dots[row, cell], -1, 1))
                    core = (angle <= _THETA / 2 - _SLACK) & (home[row] == cell)
                    band = np.where(core, 0, 1 + np.floor(angle / (_THETA / 2)).astype(np.int64))
                    at, first = pa.array(row), length * MOST_CELLS
                    yield pa.RecordBatch.from_arrays([pa.array(cell + first), pa.array(home[row] + first), pa.array(band, pa.int32()), part.column(0).take(at), part.column(1).take(at), pa.array([lists[r] if home[r] == c else [] for r, c in zip(row.tolist(), cell.tolist())], pa.list_(pa.int64())), part.column(2).take(at)], names=names)

    return run


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the labels of pairs (i, j) in place; a label is the smallest index of its group."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


class _Block:
    """The home rows of one block against all rows sent to it: counts of links and spanning edges, not the pairs."""

    def __init__(self):
        self.rep, self.n, self.cells, self.raw, self.closed = [], [], [], [], False

    def close(self, cell: int, core: bool):
        self.cell, self.closed, self.x = cell, True, unit(self.raw)
        self.rep, self.n = np.array(self.rep, np.int64), np.array(self.n, np.int64)
        self.label, self.count = np.arange(len(self.rep)), np.zeros(len(self.rep), np.int64)
        self.sends: dict[int, list[int]] = {}
        for r, c in enumerate(self.cells):
            for other in c:
                self.sends.setdefault(other, []).append(r)
        if not core:  # pairs of a cell's core need no product: all are linked and counted by its size
            for lo in range(0, len(self.rep), STRIP):
                hit = self.x[lo : lo + STRIP] @ self.x.T >= LEAST_COSINE
                hit[np.arange(len(hit)), np.arange(lo, lo + len(hit))] = False
                self.count[lo : lo + STRIP] += hit @ self.n
                i, j = np.nonzero(hit)
                _merge(self.label, i + lo, j)

    def meet(self, home: np.ndarray, rep: np.ndarray, n: np.ndarray, raw: list[bytes]):
        """Other rows: of this cell's other blocks (each side counts its own) or at home elsewhere (counted here for both)."""
        y, size = unit(raw), len(self.rep)
        label = np.concatenate((self.label, np.arange(size, size + len(rep))))
        other = np.zeros(len(rep), np.int64)
        guest = home != self.cell
        lower = np.unique(home[guest & (home < self.cell)])  # such a pair also meets in the lower cell if the row here is sent there
        for lo in range(0, size, STRIP):
            hit = self.x[lo : lo + STRIP] @ y.T >= LEAST_COSINE
            if not hit.any():
                continue
            for c in lower:
                sent = [r - lo for r in self.sends.get(int(c), ()) if lo <= r < lo + len(hit)]
                if sent:
                    hit[np.ix_(sent, np.flatnonzero(home == c))] = False
            self.count[lo : lo + STRIP] += hit @ n
            other += np.where(guest, self.n[lo : lo + STRIP] @ hit, 0)
            i, j = np.nonzero(hit)
            _merge(label, i + lo, j + size)
        self.label = label[:size]
        moved = np.flatnonzero(label[size:] != np.arange(size, size + len(rep)))
        return other, moved, label[size:][moved]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, part, sub, role); role 0: home rows of the block, role 1: rows that meet them."""

    def out(kind, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def end(block):
        if block and block.raw:
            if not block.closed:
                block.close(key[0], key[1] == 0)
            yield out(0, block.rep, block.count)
            moved = np.flatnonzero(block.label != np.arange(len(block.rep)))
            yield out(1, block.rep[moved], block.rep[block.label[moved]])

    block, key = None, None
    for b in batches:
        if not b.num_rows:
            continue
        cell, part, sub, role, home = (b.column(i).to_numpy() for i in range(5))
        rep, n = b.column(5).to_numpy(), b.column(6).to_numpy()
        new = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (sub[1:] != sub[:-1]) | (role[1:] != role[:-1])) + 1
        for lo, hi in zip([0, *new], [*new, b.num_rows]):
            own = (int(cell[lo]), int(part[lo]), int(sub[lo]))
            if own != key:
                yield from end(block)
                block, key = _Block(), own
            raw = b.column(8).slice(lo, hi - lo).to_pylist()
            if role[lo] == 0:
                block.rep += rep[lo:hi].tolist()
                block.n += n[lo:hi].tolist()
                block.cells += b.column(7).slice(lo, hi - lo).to_pylist()
                block.raw += raw
            elif block.raw:
                if not block.closed:
                    block.close(own[0], own[1] == 0)
                for s in range(0, hi - lo, 4 * BLOCK):
                    part_of = slice(lo + s, min(hi, lo + s + 4 * BLOCK))
                    other, moved, to = block.meet(home[part_of], rep[part_of], n[part_of], raw[s : s + 4 * BLOCK])
                    some = np.flatnonzero(other)
                    yield out(0, rep[part_of][some], other[some])
                    both = np.concatenate((block.rep, rep[part_of]))
                    yield out(1, rep[part_of][moved], both[to])
    yield from end(block)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept.

    A vector is an id with its components: rows that repeat both are one vector, an id with different components holds
    several, which are in one component. n_links counts the other vectors linked directly. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do rows with a null id (component_id null, kept
    false); vectors of different lengths have no cosine and don't link. An empty table gives no rows; other columns are
    ignored; vectors may be of any length. Equal vectors become one row with a count first. Exact: every pair of linked
    vectors meets in a cell. Cells of up to BLOCK rows are compared as they are, larger ones by bands of angle and blocks.
    """
    spark = df.sparkSession
    rows = cut(vectors(df, id_col, vec_col))
    valid = rows.where("vec is not null and vec_id is not null")
    held = valid.groupBy("key", "vec_id").agg(F.first("vec").alias("vec"))
    groups = cut(held.groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("rep", F.monotonically_increasing_id()))
    spaces = fit_spaces(groups)
    placed = cut(groups.select("rep", "n", "vec").mapInArrow(_assign(spaces), "cell long, home long, band int, rep long, n long, cells array<long>, vec binary"))
    at_home = F.col("cell") == F.col("home")
    sizes = placed.where(at_home).groupBy("cell").agg(F.count("*").alias("rows"))
    placed = placed.join(sizes.where(F.col("rows") > BLOCK).select("cell", F.lit(True).alias("hot")), "cell", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    placed = placed.withColumn("band", F.when(F.col("hot"), F.col("band")).otherwise(1))
    # one row a cell and band
    bands = placed.where(at_home).groupBy("cell", F.col("band").alias("part")).agg(F.count("*").alias("rows"), F.sum("n").alias("core_n"), F.min("rep").alias("core_rep"))
    bands = cut(bands.withColumn("subs", F.ceil(F.col("rows") / BLOCK).cast("int")))
    own_sub = F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int")
    # A link's angles to a centre differ by the linking angle at most: two bands of half that width, one more after the core.
    low, high = F.when(F.col("hot"), F.greatest(F.col("band") - 3, F.lit(0))).otherwise(1), F.when(F.col("hot"), F.col("band") + 3).otherwise(1)
    sent = placed.withColumn("part", F.explode(F.sequence(low, high))).where("not (part = 0 and band = 0 and home <> cell)")
    sent = sent.join(bands.select("cell", "part", "subs"), ["cell", "part"])
    inside = sent.where("cell = home and band = part").withColumn("sub", own_sub).withColumn("role", F.lit(0))
    meeting = sent.where("not (part = 0 and band = 0)").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("role", F.lit(1)).withColumn("cells", F.array().cast("array<long>"))
    meeting = meeting.where(~(at_home & (F.col("band") == F.col("part")) & (F.col("sub") == own_sub)))
    names = ["cell", "part", "sub", "role", "home", "rep", "n", "cells", "vec"]
    dealt = inside.select(*names).unionByName(meeting.select(*names)).repartition("cell", "part", "sub").sortWithinPartitions("cell", "part", "sub", "role")
    found = cut(dealt.mapInArrow(_compare, "kind int, a long, b long"))
    core = placed.where(at_home & (F.col("band") == 0)).select("cell", "rep", "n").join(bands.where("part = 0").select("cell", "core_n", "core_rep"), "cell")
    # an id with several vectors links them
    by_id = valid.select("key", "vec_id").distinct().join(groups.select("key", "rep"), "key")
    firsts = by_id.groupBy("vec_id").agg(F.min("rep").alias("first"), F.count("*").alias("many")).where("many > 1")
    same = by_id.join(firsts, "vec_id").where("rep <> first").select("rep", "first")
    linked = cut(components(found.where("kind = 1").select("a", "b").union(core.select("rep", "core_rep")).union(same)))
    counts = found.where("kind = 0").select(F.col("a").alias("rep"), F.col("b").alias("links")).union(core.select("rep", F.col("core_n") - F.col("n")))
    counts = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    rooted = cut(groups.select("key", "rep", "n", "low").join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("key", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("key", "links", "component_id")
    good = valid.join(named, "key").select("vec_id", F.col("links").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = F.struct(F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    rest = rows.where(F.col("vec").isNull() | F.col("vec_id").isNull()).select("vec_id", alone.alias("x")).select("vec_id", "x.*")
    return good.unionByName(rest)


def fit_spaces(groups: DataFrame) -> dict[int, np.ndarray]:
    """Centres by vector length, fitted on FIT_ROWS vectors and FIT_BYTES at most in the order of their digests. It shapes cells, no result."""
    size = groups.agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    n_groups = size["n"]
    sample = groups.orderBy("key").limit(max(1, min(FIT_ROWS, FIT_BYTES // (size["bytes"] or 8)))).select("vec").collect()
    by_length: dict[int, list[bytes]] = {}
    for r in sample:
        by_length.setdefault(len(r["vec"]) // 8, []).append(bytes(r["vec"]))
    out = {}
    for length, raw in by_length.items():
        k = int(min(MOST_CELLS, max(LEAST_CELLS, n_groups * len(raw) // len(sample) // CELL_ROWS), len(raw), FIT_BYTES // 32 // length))
        if k > 1:
            out[length] = fit_cells(unit(raw), k)
    return out


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
