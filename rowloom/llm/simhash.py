"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import components, cut, table

#: Bits of a fingerprint at which two documents may differ, words of a shingle, seed of its hash.
MAX_BITS, SHINGLE, SEED = 3, 3, 42
#: Reference fingerprints of the distance tables.
N_PIVOTS = 16
#: Rows of one candidate group that a task compares; larger groups are split into cells of the pivot table, then into blocks.
GROUP_ROWS = 20_000
#: Width of a cell on one pivot's axis, and the axes used for cells, split by split.
CELL, CELL_AXES = 8, ((1, 2, 3), (4, 5, 6))


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: a fixed pseudo-random sequence (splitmix64)."""
    x, out, mask = 0x9E3779B97F4A7C15, [], (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


def masks(max_bits: int = MAX_BITS, kept: int = 2) -> list[int]:
    """64 bits in max_bits + kept blocks: two fingerprints at max_bits or fewer agree on some `kept` whole blocks."""
    n = max_bits + kept
    ends = [64 * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]
    return [sum(block[i] for i in c) for c in combinations(range(n), kept)]


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of some hashes; of none: 0."""
    octets = np.ascontiguousarray(h, np.uint64).view(np.uint8).reshape(len(h), 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """Of one whole text: bit j is 1 if set in over half of its shingles' hashes; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    a, b = starts[:n].tolist(), ends[-n:].tolist()
    one = xxhash.xxh64_intdigest
    return majority(np.fromiter((one(joined[i:j], SEED) for i, j in zip(a, b)), np.uint64, n))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long) of every row of docs; whole texts, no shuffle."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_fingerprints, "doc_id long, fp long")


def _link(group: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints that share a group and differ in max_bits bits at most.

    The distance table holds each fingerprint's distances to the pivots. By the triangle inequality two fingerprints
    within max_bits differ by no more in any coordinate: rows are sorted by the first one, so that only a window is
    compared, the other coordinates discard pairs, and survivors are verified.
    """
    dist = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((dist[:, 0], group))
    group, fp, dist = group[order], fp[order], dist[order]
    label = np.arange(len(fp))
    at = np.arange(len(fp))
    lag = 0
    while len(at):
        lag += 1
        at = at[at + lag < len(fp)]
        to = at + lag
        near = (group[at] == group[to]) & (dist[to, 0] - dist[at, 0] <= max_bits)
        at = at[near]
        i, j = at, at + lag
        for p in range(1, dist.shape[1]):
            if not len(i):
                break
            ok = np.abs(dist[i, p] - dist[j, p]) <= max_bits
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        i, j = i[ok], j[ok]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label != label[label]).any():
                label = label[label]
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def _cells(fp: np.ndarray, axes: tuple[int, ...], max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the pivot cells they belong to: the own cell and, within max_bits of its lower edge, the cell below, on each axis.

    Two fingerprints within max_bits, CELL at most, meet in the cell of the smaller coordinate on each axis.
    """
    row, cell = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    for axis in axes:
        d = np.bitwise_count(fp[row] ^ pivots()[axis]).astype(np.int64)
        low = (d % CELL < max_bits) & (d >= CELL)
        row, cell = np.concatenate((row, row[low])), np.concatenate((cell * 16 + d // CELL, cell[low] * 16 + d[low] // CELL - 1))
    return row, cell


_ROWS, _GROUP = "t int, k long, cell long, fp long", ["t", "k", "cell"]


def _split(axes: tuple[int, ...], max_bits: int):
    """Rows of large groups to the cells that they belong to on some axes: each row apart, so a hot group is split in many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(3).to_numpy().view(np.uint64)
            row, cell = _cells(fp, axes, max_bits)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(b.column(2).to_numpy()[row] * 16 ** len(axes) + cell), b.column(3).take(at)], names=["t", "k", "cell", "fp"])

    return run


def _compare(max_bits: int):
    """Links of complete groups, which come sorted by (t, k, cell) and hold some GROUP_ROWS at most."""

    def links(t, k, c, fp):
        new = np.ones(len(fp), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        a, b = _link(np.cumsum(new), fp, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new[3] = new[3].view(np.uint64)
            t, k, c, fp = new if rest is None else (np.concatenate(x) for x in zip(rest, new))
            if not len(fp):
                continue
            last = int(np.flatnonzero((t != t[-1]) | (k != k[-1]) | (c != c[-1])).max(initial=-1)) + 1
            if last:
                yield links(t[:last], k[:last], c[:last], fp[:last])
            rest = [t[last:], k[last:], c[last:], fp[last:]]
        if rest is not None and len(rest[3]) > 1:
            yield links(*rest)

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (column fp) within max_bits of each other, without all pairs of a group.

    Groups share two whole blocks of bits. A group over GROUP_ROWS goes to the cells of the pivot table, those still over
    it to the cells of more pivots, and what is left is cut into blocks by hash, each pair of which meets in one task.
    Sizes are counted first, so no task ever holds or streams a large group.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("k")) for i, m in enumerate(masks(max_bits))])).alias("x")
    rows = fps.select("fp", keys).select("x.t", "x.k", F.lit(0).cast("long").alias("cell"), "fp")

    def compared(groups: DataFrame) -> DataFrame:
        return groups.select(*_GROUP, "fp").repartition(*_GROUP).sortWithinPartitions(*_GROUP).mapInArrow(_compare(max_bits), "a long, b long")

    found = []
    for axes in (*CELL_AXES, None):
        large = cut(rows.groupBy(*_GROUP).agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS))
        if large.isEmpty():
            found.append(compared(rows))
            break
        found.append(compared(rows.join(large, _GROUP, "left_anti")))
        if axes:
            rows = cut(rows.join(large, _GROUP, "left_semi").select(*_GROUP, "fp").mapInArrow(_split(axes, max_bits), _ROWS))
            continue
        blocks = rows.join(large.withColumn("blocks", F.ceil(F.col("n") / GROUP_ROWS).cast("long")), _GROUP).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
        met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pair = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        found.append(compared(met.select("t", F.xxhash64("k", "cell").alias("k"), pair.alias("cell"), "fp")))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, fp, fingerprint (hex), component_id (smallest doc_id reachable by links).

    Null or blank text: fingerprint zero, linked like any other. A null doc_id gets its component's smallest id, null if
    the component has none. Repeated rows each get a row. An empty table gives no rows. Other columns are ignored.
    Distinct fingerprints are found first, so groups of exact copies cost one row from then on.
    """
    of_doc = cut(fingerprints(docs, id_col, text_col))
    distinct = of_doc.groupBy("fp").agg(F.min("doc_id").alias("low"))
    linked = components(links(distinct.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(linked, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    component = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return of_doc.join(component, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """docs with one document of each group (the smallest doc_id); a repeated doc_id stays once (its least row), rows without an id all stay.

    groups: doc_id, component_id of every row of docs; by default those of near_duplicates.
    """
    found = (near_duplicates(docs) if groups is None else groups).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = cut(found)
    once = docs.join(found.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    one = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    more = docs.join(found.where("n > 1").select("doc_id"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(one, F.to_json(one)).alias("row"))
    more = more.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return once.unionByName(more).unionByName(docs.where("doc_id is null"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
