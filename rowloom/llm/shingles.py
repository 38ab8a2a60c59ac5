"""Near-duplicates by the exact Jaccard similarity of word shingles.

SimHash fingerprints of the sets, met through pivot distance tables, gather sets that may be similar; rare shingles gather what
lies beyond the fingerprints' radius; what is gathered is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import Cut, components, cut, drop_since, made
from rowloom.llm.simhash import links, majority

#: Words of a shingle; least similarity as a fraction (numerator, denominator), compared in integers.
SHINGLE, LEAST = 5, (4, 5)
SEED = 42
#: Texts of the sample that tells frequent shingles, the shingles it keeps. It orders work and changes no result.
SAMPLE, FREQUENT = 20_000, 50_000
#: Bits of a set's parity sketch: two sketches differ in no more bits than their sets in shingles.
SKETCH = 1024
#: Shingles of a set from which on its sketch tells too little and counts by WIDE ranges of hashes are kept beside it.
LARGE, WIDE = 1_000, 1024
#: Texts whose sets a task holds at a time.
SLICE = 1_000
#: Bits of a SimHash fingerprint at which two sets are gathered; shingles gather those beyond.
NEAR = 6
#: Sets of a shingle, and shingles of gathered sets, that a task compares at a time; more are cut into blocks, each pair of which meets.
GROUP, LOAD = 20_000, 4_000_000


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles, lower case; fewer words than a shingle make one, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    one = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((one(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[-n:].tolist())), np.uint64, n))


def _prefix(s: np.ndarray, often: np.ndarray, counts: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """The first shingles in the common order (rare in the sample, then by hash): two similar sets share one of them."""
    if not len(s):
        return s
    rank = np.zeros(len(s), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        rank = np.where(often[at] == s, counts[at], 0)
    return s[np.lexsort((s, rank))][: len(s) + (-least[0] * len(s) // least[1]) + 1]


def _sketch(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the shingles that several different texts of a sample hold, by hash."""
    share = max(1, -(-docs.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()
    seen = texts.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    found = seen.orderBy(F.col("n").desc(), "s").limit(FREQUENT).collect()
    often = np.array([r["s"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(often)
    return often[order], np.array([r["n"] for r in found], np.int64)[order]


def _wide(s: np.ndarray) -> bytes | None:
    """Counts up to 255 by ranges of hashes of a large set: two such rows differ in sum by no more than their sets in shingles."""
    if len(s) <= LARGE:
        return None
    return np.minimum(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=WIDE), 255).astype(np.uint8).tobytes()


def _close(a: list, b: list) -> np.ndarray:
    """The least by which large sets differ, pair by pair of their counts; 0 where one isn't large."""
    out = np.zeros(len(a), np.int64)
    at = np.array([i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None], np.int64)
    for lo in range(0, len(at), SLICE):
        some = at[lo : lo + SLICE]
        x, y = (np.frombuffer(b"".join(side[i] for i in some), np.uint8).reshape(-1, WIDE).astype(np.int16) for side in (a, b))
        out[some] = np.abs(x - y).sum(axis=1, dtype=np.int64)
    return out


def _key(s: np.ndarray) -> int:
    """What a set is known by: the hash of its shingles."""
    import xxhash

    h = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return h - (1 << 64) if h >> 63 else h


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sorted sets share."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """root, the least member of each one's class, once the classes of i and j are joined pair by pair."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if len(i):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _likely(least: tuple[int, int]):
    """Links of groups that come sorted by (s, n, key): they connect the labels of all sets of a group that may be similar.

    Sizes, the shingle's positions, the sketches and counts tell sets apart that can't be; what is connected already isn't
    compared. So a group's work may grow with its pairs, but what leaves it only with its labels.
    """
    up, down = least

    def links(s, n, key, pos, label, sketch, *wide) -> pa.RecordBatch:
        tag, own = np.unique(label, return_inverse=True)
        root = np.arange(len(tag))
        bits = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(s), SKETCH // 64)
        at, lag = np.arange(len(s)), 0
        while len(at):
            lag += 1
            at = at[at + lag < len(s)]
            at = at[(s[at] == s[at + lag]) & (down * n[at] >= up * n[at + lag])]
            i = at[root[own[at]] != root[own[at + lag]]]
            j = i + lag
            small = np.minimum(n[i] - pos[i], n[j] - pos[j])  # the most that two sets share from this shingle on
            ok = (up + down) * small >= up * (n[i] + n[j])
            i, j = i[ok], j[ok]
            ok = (up + down) * np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (down - up) * (n[i] + n[j])
            i, j = i[ok], j[ok]
            if wide:
                ok = (up + down) * _close(wide[0][i].tolist(), wide[0][j].tolist()) <= (down - up) * (n[i] + n[j])
                i, j = i[ok], j[ok]
            root = _joined(root, own[i], own[j])
        moved = root != np.arange(len(tag))
        return pa.RecordBatch.from_arrays([pa.array(tag[moved]), pa.array(tag[root[moved]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if not len(new[0]):
                continue
            if rest and new[0][-1] == rest[0][0][0]:  # still the same group: keep for later
                rest.append(new)
                continue
            cols = [np.concatenate(x) for x in zip(*rest, new)]
            last = int(np.flatnonzero(cols[0] != cols[0][-1]).max(initial=-1)) + 1
            yield links(*(c[:last] for c in cols))
            rest = [[c[last:] for c in cols]]
        if rest:
            yield links(*(np.concatenate(x) for x in zip(*rest)))

    return run


def _similar(shingle: int, least: tuple[int, int]):
    """Links that connect all similar sets of a group, verified on the whole sets of their texts; groups come together, by size and key."""
    up, down = least

    def links(keys: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        n = np.array([len(x) for x in sets])
        bits = np.frombuffer(b"".join(map(_sketch, sets)), np.uint64).reshape(len(sets), SKETCH // 64)
        root = np.arange(len(sets))
        at, lag = np.arange(len(sets)), 0
        while len(at):
            lag += 1
            at = at[at + lag < len(sets)]
            at = at[down * n[at] >= up * n[at + lag]]
            i = at[root[at] != root[at + lag]]
            i = i[(up + down) * np.bitwise_count(bits[i] ^ bits[i + lag]).sum(axis=1, dtype=np.int64) <= (down - up) * (n[i] + n[i + lag])]
            shared = np.array([_shared(sets[a], sets[a + lag]) for a in i.tolist()], np.int64)
            i = i[(up + down) * shared >= up * (n[i] + n[i + lag])]
            root = _joined(root, i, i + lag)
        moved = np.flatnonzero(root != np.arange(len(sets))).tolist()
        return [keys[i] for i in moved], [keys[root[i]] for i in moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, sets = None, [], []
        for b in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for *now, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                if now != group:
                    for side, more in zip(out, links(keys, sets)):
                        side += more
                    group, keys, sets = now, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    sets.append(shingle_set(text.as_py(), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links(keys, sets)], names=["a", "b"])

    return run


def _blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """rows with pair: 0, or where there are several blocks one row for each pair of blocks that the row's key is of."""
    own = F.pmod(F.xxhash64("key"), blocks)
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return met.withColumn("pair", F.least(own, "other") * blocks + F.greatest(own, "other")).drop("other")


def _fingerprint_links(sets: DataFrame, max_bits: int) -> DataFrame:
    """a, b: pairs that connect all sets (columns key, fp) whose fingerprints are equal or met within max_bits by the pivot tables."""
    prints = cut(sets.groupBy("fp").agg(F.min("key").alias("low")))
    equal = sets.join(prints, "fp").where("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    met = links(prints.select("fp"), max_bits)
    for side in "ab":
        met = met.join(prints.select(F.col("fp").alias(side), F.col("low").alias(f"low_{side}")), side)
    return equal.union(met.select("low_a", "low_b"))


def _named(edges: DataFrame) -> DataFrame:
    """key, root of every set with an edge, the roots included (components leaves them out)."""
    found = cut(components(edges)).select(F.col("node").alias("key"), "root")
    return found.union(found.select("root", "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: tuple[int, int] = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, component_id (smallest doc_id reachable by pairs with Jaccard >= least).

    Every such pair is found. Equal sets are one set first. Sets whose SimHash fingerprints differ in NEAR bits at most are
    gathered through the pivot tables. No radius holds all similar sets, so an exact way gathers the rest: a set of n
    shingles is listed under its n - ceil(least n) + 1 first ones in one order for all, where similar sets meet; sizes,
    positions and sketches discard, and sets that fingerprints gathered already aren't compared. Whatever was gathered,
    directly or over others, is told apart once more by the sketches and by counts of large sets, and verified on whole sets. Only links that connect leave a task, never all pairs. Null or
    blank texts are alike. A null doc_id gets its component's smallest id, null if it has none. Shingles are compared by
    64-bit hashes.
    """
    mark = made()
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    often, counts = _frequent(picked, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
            fps = np.array([majority(x) for x in sets], np.uint64).view(np.int64)
            heads = pa.array([_prefix(x, often, counts, least).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_key, sets), pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps), heads, pa.array(map(_sketch, sets), pa.binary()), pa.array(map(_wide, sets), pa.binary())], names=["doc_id", "key", "n", "fp", "head", "sketch", "wide"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            keys, at = [], []
            for i, t in enumerate(b.column(0)):
                key = _key(shingle_set(t.as_py(), shingle))
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], names=["key", "text"])

    of_doc = Cut(picked.mapInArrow(run, "doc_id long, key long, n long, fp long, head array<long>, sketch binary, wide binary"))
    ids = cut(of_doc.df.select("doc_id", "key"))
    sets = cut(of_doc.df.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "head", "sketch", "wide")]))
    of_doc.drop()

    label = _named(_fingerprint_links(sets.select("key", "fp"), NEAR))
    listed = sets.select("key", "n", F.posexplode("head").alias("pos", "s"))
    listed = cut(listed.withColumn("sets", F.count("*").over(Window.partitionBy("s"))).where("sets > 1"))
    known = sets.join(label, "key", "left").select("key", F.coalesce("root", "key").alias("label"), "sketch")
    sent = _blocks(listed.join(known, "key"), F.ceil(F.col("sets") / GROUP).cast("long"))
    sent = sent.select(F.when(F.col("sets") > GROUP, F.xxhash64("s", "pair")).otherwise(F.col("s")).alias("s"), "n", "key", F.col("pos").cast("long").alias("pos"), "label", "sketch")
    beyond = cut(sent.repartition("s").sortWithinPartitions("s", "n", "key").mapInArrow(_likely(least), "a long, b long"))

    gathered = cut(_named(label.toDF("a", "b").union(beyond)).join(sets.select("key", "n", "sketch", "wide"), "key"))
    sizes = gathered.groupBy("root").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("blocks"))
    sent = _blocks(gathered.join(sizes, "root"), F.col("blocks")).select(F.xxhash64("root", "pair").alias("s"), "n", "key", F.lit(0).cast("long").alias("pos"), F.col("key").alias("label"), "sketch", "wide")
    closer = _named(cut(sent.repartition("s").sortWithinPartitions("s", "n", "key").mapInArrow(_likely(least), "a long, b long")))
    gathered = closer.join(sets.select("key", "n"), "key")
    loads = gathered.groupBy("root").agg(F.ceil(F.sum("n") / LOAD).cast("long").alias("blocks"))
    needed = cut(_blocks(gathered.join(loads, "root"), F.greatest("blocks", F.lit(1))).select("key", "root", "pair", "n"))
    rows = picked.select("text").mapInArrow(keyed, "key long, text string").join(needed, "key")
    rows = rows.select("root", "pair", "key", "text", "n").repartition("root", "pair").sortWithinPartitions("root", "pair", "n", "key").drop("n")
    similar = cut(rows.mapInArrow(_similar(shingle, least), "a long, b long"))

    rooted = cut(ids.groupBy("key").agg(F.min("doc_id").alias("low")).join(_named(similar), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root")))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    component = rooted.select("key", "root").join(named, "root").select("key", "component_id")
    out = Cut(ids.join(component, "key").select("doc_id", "component_id"))
    drop_since(mark, keep=out)
    return out.df
