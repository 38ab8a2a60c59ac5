"""SentencePiece encoding and decoding as relations: a lattice of substrings joined to the piece table, folded by word.

Model files of two kinds are read. For a unigram model the fold is Viterbi. The model supplied here is a BPE model, whose
encoding isn't the path of greatest score, so Viterbi would give wrong ids; for it the same lattice is folded by replaying
the merges: at each step the best edge that joins exactly two current symbols. See the README.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import Cut, cut, drop_since, let, made, setting, table

#: Where the model file lies; a parameter of every public function.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points of a word whose borders fit the bit mask of the fold in the JVM; the lattice of a longer word is folded in Python.
MOST_CHARS = 60
#: Code points of the chunks that a longer word's substrings are taken from.
CHUNK = 256
#: Bytes of the dictionary's part that is broadcast to all tasks, the most frequent words; the rest is joined by a shuffle.
BROADCAST_BYTES = 24 << 20
#: Words of a task whose edges are gathered in memory; a task with more sorts them.
GROUPED_WORDS = 50_000
#: Bytes of the texts that are looked up, and symbols of those that are put together, at a time; one text may hold more.
BATCH_BYTES = 1 << 21
BATCH_SYMBOLS = 1 << 18
#: What tells texts apart: the id, whether there is none, and hashes.
_ROW = ["id", "none", "tag", "more"]
#: The sign that stands for a space in pieces.
SPACE = "▁"
#: ASCII punctuation, from which `Pieces.marks` picks those that never follow a letter in a piece.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bits of an edge's packed form: rank, start, length, id; a character that is no piece has the greatest rank and id.
_RANK, _START, _SIZE, _NONE = 32, 26, 20, (1 << 20) - 1


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialised message, in order; values are integers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        key = varint()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if size == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


def is_unigram(raw: bytes) -> bool:
    """Whether a model file's trainer settings (its field 2) name the unigram type (their field 3: 1 or absent) rather than BPE (2)."""
    kind = 1
    for number, value in _fields(raw):
        if number == 2:
            kind = dict(_fields(value)).get(3, kind)
    if kind not in (1, 2):
        raise ValueError("the model is neither of the unigram nor of the BPE type")
    return kind == 1


class Pieces:
    """The piece table of a model file: rows (piece, id, score), the id of byte 0, the kind, the longest piece."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(s.vocab_size())
        self.rows = [(s.id_to_piece(i), i, float(s.get_score(i))) for i in ids if not (s.is_control(i) or s.is_unknown(i) or s.is_byte(i) or s.is_unused(i))]
        self.bytes = [i for i in ids if s.is_byte(i)]
        self.unknown = s.unk_id()
        self.size = len(ids)
        self.longest = max(len(p) for p, _, _ in self.rows)
        if len(self.bytes) != 256 or self.bytes != list(range(self.bytes[0], self.bytes[0] + 256)):
            raise ValueError("the model has no row of 256 byte pieces")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _, _ in self.rows):
            raise ValueError("a piece reaches over a word border")
        if self.longest >= MOST_CHARS or len(ids) >= _NONE:
            raise ValueError("a piece of 60 characters or over a million pieces")
        self.viterbi = is_unigram(Path(path).read_bytes())
        self.marks = "".join(c for c in PUNCTUATION if not any(a.isalpha() and b == c for p, _, _ in self.rows for a, b in zip(p, p[1:])))

    @property
    def ranked(self) -> list[tuple[str, int, float]]:
        """rows from the best score down."""
        return sorted(self.rows, key=lambda r: (-r[2], r[1]))

    @property
    def octets(self) -> list[bytes]:
        """What each id decodes to; a control id or the unknown one to the replacement character."""
        out = ["\ufffd".encode()] * self.size
        for p, i, _ in self.rows:
            out[i] = p.replace(SPACE, " ").encode()
        for k, i in enumerate(self.bytes):
            out[i] = bytes([k])
        return out

    @property
    def word(self) -> str:
        """The pattern of words: spaces and what follows up to a space, a line end or a mark after a letter; spaces before a
        line end or the text's end; single line ends. No piece reaches over these borders: none holds a space sign after
        another character, a line end, or one of `marks` after a letter; of letters A-Z and a-z make borders here, so that
        `_cut_texts` finds the same ones in bytes. So words are encoded apart from each other. A space
        sign in the text is encoded like a space; `word_of_plain` is the same, and faster, for texts without one.
        """
        return self._pattern(f" {SPACE}")

    @property
    def word_of_plain(self) -> str:
        return self._pattern(" ")

    def _pattern(self, spaces: str) -> str:
        marks = "".join(f"\\{c}" for c in self.marks)
        more = f"(?:[^{spaces}\\n{marks}]++|(?<![A-Za-z])[{marks}])*+" if marks else f"[^{spaces}\\n]*+"
        return f"[{spaces}]*+[^{spaces}\\n]{more}|[{spaces}]++|\\n"

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, score, rank and h, a 64-bit hash of the piece: joins are on it, and compare the pieces of what they find."""
        rows = [(p, i, s, k) for k, (p, i, s) in enumerate(self.ranked)]
        return cut(spark.createDataFrame(rows, "piece string, id int, score double, rank int").withColumn("h", F.xxhash64("piece")).coalesce(1))


def _spaced(text: Column) -> Column:
    """The text after the space that encoding puts before it, bytes that are no UTF-8 replaced; an empty one stays empty."""
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.make_valid_utf8(text)))


def segments(text: Column, pieces: Pieces) -> Column:
    """The words of a text in order; joined they are the text after the space that encoding puts before it. Empty: none."""
    cuts = [F.regexp_extract_all(_spaced(text), F.lit(pattern), F.lit(0)) for pattern in (pieces.word, pieces.word_of_plain)]
    return F.when(text == "", F.array().cast("array<string>")).when(F.contains(text, F.lit(SPACE)), cuts[0]).otherwise(cuts[1])


def key(word: Column) -> Column:
    """What words are grouped and joined by: the word itself, or if it is long a line end (which no such word holds) and its digest."""
    return F.when(F.length(word) <= MOST_CHARS, word).otherwise(F.concat(F.lit("\n"), F.md5(word)))


def _by_merges(n: Column, edges: Column) -> Column:
    """Bit mask of the symbol borders of a word of n code points after all merges.

    One fold over the edges (s, id, ends, inner), best first. An edge joins two symbols if its ends are borders
    and one border lies inside. If more lie inside it may come to join two later, before any worse edge: it waits, and
    waiting edges are tried again after every merge. An edge whose end isn't a border any more never returns.
    """

    def joined(mask: Column, x: Column) -> Column:
        return mask.bitwiseAND(F.bitwise_not(x["inner"]))

    def free(mask: Column, x: Column) -> Column:
        return (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1)

    def settled(mask: Column, wait: Column) -> Column:
        def again(m: Column, _: Column) -> Column:
            return let(F.get(F.filter(wait, lambda x: free(m, x)), F.lit(0)), lambda best: F.when(best.isNull(), m).otherwise(joined(m, best)))

        return F.when(F.size(wait) == 0, mask).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(wait)), mask, again))

    def step(acc: Column, x: Column) -> Column:
        mask, wait = acc["mask"], acc["wait"]
        inside = F.bit_count(mask.bitwiseAND(x["inner"]))
        merged = F.struct(settled(joined(mask, x), wait).alias("mask"), wait.alias("wait"))
        return F.when(mask.bitwiseAND(x["ends"]) != x["ends"], acc).when(inside == 1, merged).when(inside > 1, F.struct(mask.alias("mask"), F.array_append(wait, x).alias("wait"))).otherwise(acc)

    joins = F.filter(edges, lambda x: x["inner"] != 0)
    start = F.struct((F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1).alias("mask"), F.filter(edges, lambda x: F.lit(False)).alias("wait"))
    return F.aggregate(joins, start, step, lambda acc: acc["mask"])


def _by_viterbi(n: Column, edges: Column) -> Column:
    """Bit mask of the borders of the best path: a fold over the ends, with the best score and mask up to each position."""
    one = F.lit(1).cast("long")

    def step(best: Column, e: Column) -> Column:
        ways = F.transform(F.filter(edges, lambda x: (x["e"] == e) & (x["id"] != _NONE)), lambda x: F.struct((F.get(best, x["s"])["score"] + x["score"]).alias("score"), F.get(best, x["s"])["mask"].bitwiseOR(F.call_function("shiftleft", one, e)).alias("mask")))
        spare = F.struct((F.get(best, e - 1)["score"] - 1e6).alias("score"), F.get(best, e - 1)["mask"].bitwiseOR(F.call_function("shiftleft", one, e)).alias("mask"))
        return F.concat(best, F.array(F.array_max(F.concat(ways, F.array(spare)))))

    start = F.array(F.struct(F.lit(0.0).alias("score"), one.alias("mask")))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda b: F.element_at(b, -1)["mask"])


def _byte_ids(char: Column, first: int) -> Column:
    def of_hex(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), (F.length(h) / 2).cast("int")), lambda k: (F.conv(F.substring(h, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + first))

    return let(F.hex(F.encode(char, "UTF-8")), of_hex)


def _fold_long(ranked: list, longest: int, first_byte: int, viterbi: bool):
    """The fold for words of any length: edges come as start << 26 | size << 20 | rank; a few dozen bytes a code point are held."""
    ids, scores = [i for _, i, _ in ranked], [s for _, _, s in ranked]
    wide = longest + 1

    def merged(n: int, rank) -> list[int]:
        """Starts of the symbols after all merges: the best pair of neighbours first, of equal ones the leftmost."""
        size, start_of = [1] * n, list(range(-1, n))  # start_of[e]: where the symbol that ends at e starts
        heap: list[tuple] = []

        def offer(i: int) -> None:
            j = i + size[i]
            if j < n and (k := size[i] + size[j]) <= longest and (r := rank[i * wide + k]) >= 0:
                heapq.heappush(heap, (r, i, size[i], k))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, k = heapq.heappop(heap)
            if size[i] != a or size[i + a] != k - a:
                continue
            size[i], size[i + a], start_of[i + k] = k, 0, i
            if i:
                offer(start_of[i])
            offer(i)
        return [i for i in range(n) if size[i]]

    def best(n: int, rank) -> list[int]:
        score, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            score[e], back[e] = score[e - 1] - 1e6, e - 1
            for s in range(max(0, e - longest), e):
                r = rank[s * wide + e - s]
                if r >= 0 and score[s] + scores[r] > score[e]:
                    score[e], back[e] = score[s] + scores[r], s
        out, e = [], n
        while e:
            e = back[e]
            out.append(e)
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, edges in zip(b.column(1).to_pylist(), b.column(3)):
                n, e = len(word), edges.values.to_numpy()
                grid = np.full(n * wide, -1, np.int32)
                known = e[e & _NONE != _NONE]
                grid[(known >> _START) * wide + (known >> _SIZE & 63)] = known & _NONE
                rank = array("i", grid.tobytes())
                starts = (best if viterbi else merged)(n, rank)
                found: list[int] = []
                for s, t in zip(starts, [*starts[1:], n]):
                    r = rank[s * wide + t - s]
                    found += [ids[r]] if r >= 0 else [first_byte + x for x in word[s].replace(" ", SPACE).encode("utf-8", "surrogatepass")]
                out.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int32()))], names=["key", "word", "n_rows", "ids"])

    return run


def _edges(parts: DataFrame, pieces: Pieces, names: list[str]) -> DataFrame:
    """The lattice: for each start of a part (columns names, base, own: starts in it, w: its text) every substring up to the
    longest piece, joined to the piece table, whose size is the model's, by a 64-bit hash; then the texts must be equal.
    Adds s, len, rank, id, score; a single character stays without a piece.
    """
    starts = parts.select(*names, "base", "w", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("at"))
    subs = starts.select(*names, "base", "w", "at", F.explode(F.sequence(F.lit(1), F.least(F.length("w") - F.col("at"), F.lit(pieces.longest)))).alias("len"))
    subs = subs.select(*names, (F.col("base") + F.col("at")).alias("s"), "len", F.expr("substring(w, at + 1, len)").alias("sub")).withColumn("h", F.xxhash64("sub"))
    same = F.col("piece") == F.col("sub")
    found = subs.join(F.broadcast(pieces.table(parts.sparkSession)), "h", "left").where(same | (F.col("len") == 1))
    return found.select(*names, "s", "len", *[F.when(same, F.col(c)).alias(c) for c in ("rank", "id", "score")])


def encode_words(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """key, word, n_rows, ids of distinct words (columns word, n_rows): the lattice and its fold.

    Words are dealt out by hash once; substrings, the broadcast join with the piece table and the grouping of edges by
    word keep that partitioning. An edge is packed into one number that sorts by rank and start. Words over MOST_CHARS
    have the same lattice, its substrings taken from overlapping chunks; its edges, gathered by word, are folded in
    Python, since a fold in the JVM copies its state at every step.
    """
    return _encode_short(counts, pieces).unionByName(_encode_long(counts, pieces))


def _encode_short(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """The same for the words of up to MOST_CHARS, still dealt out by word."""
    spark = counts.sparkSession
    n_parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shown = F.regexp_replace("word", " ", SPACE)
    short = counts.where(F.length("word") <= MOST_CHARS).select("word", "n_rows").repartition(n_parts, "word")
    parts = short.select("word", "n_rows", F.lit(0).alias("base"), F.length("word").alias("own"), shown.alias("w"))
    packed = f"shiftleft(cast(coalesce(rank, {_NONE}) as bigint), {_RANK}) | shiftleft(cast(s as bigint), {_START}) | shiftleft(cast(len as bigint), {_SIZE}) | coalesce(id, {_NONE})"
    edges = _edges(parts, pieces, ["word", "n_rows"]).select("word", "n_rows", F.expr(packed).alias("k"), "score")
    # Viterbi adds up scores, merges need ranks alone
    lattice = edges.groupBy("word").agg(F.max("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct("k", "score") if pieces.viterbi else F.col("k"))).alias("edges"))

    def shaped(x: Column) -> Column:
        number = x["k"] if pieces.viterbi else x
        s = F.shiftright(number, _START).bitwiseAND(F.lit(63)).cast("int")
        e = s + F.shiftright(number, _SIZE).bitwiseAND(F.lit(63)).cast("int")
        bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
        more = [e.alias("e"), x["score"].alias("score")] if pieces.viterbi else []
        return F.struct(s.alias("s"), number.bitwiseAND(F.lit(_NONE)).cast("int").alias("id"), bit(s).bitwiseOR(bit(e)).alias("ends"), (bit(e) - bit(s + 1)).alias("inner"), *more)

    def tokens(edges: Column) -> Column:
        def on(mask: Column) -> Column:
            """The edges without a border inside whose ends are borders, by place; a character that is no piece as its bytes."""
            path = F.filter(edges, lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (mask.bitwiseAND(x["inner"]) == 0))
            placed = F.array_sort(F.transform(path, lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))))

            def plain(placed: Column) -> Column:
                each = F.transform(placed, lambda x: F.when(x["id"] != _NONE, F.array(x["id"])).otherwise(_byte_ids(F.regexp_replace(F.substring("word", x["s"] + 1, F.lit(1)), " ", SPACE), pieces.bytes[0])))
                return F.when(F.exists(placed, lambda x: x["id"] == _NONE), F.flatten(each)).otherwise(F.transform(placed, lambda x: x["id"]))

            return let(placed, plain)

        return let((_by_viterbi if pieces.viterbi else _by_merges)(F.length("word"), edges), on)

    return lattice.select(F.col("word").alias("key"), "word", "n_rows", let(F.transform("edges", shaped), tokens).alias("ids"))


def _encode_long(counts: DataFrame, pieces: Pieces) -> DataFrame:
    """The same for the words over MOST_CHARS."""
    n_parts = 4 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = counts.where(F.length("word") > MOST_CHARS).select(key(F.col("word")).alias("key"), "word", "n_rows")
    chunks = long.select("key", F.regexp_extract_all(F.regexp_replace("word", " ", SPACE), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("c"))
    chunks = chunks.select("key", F.posexplode(F.transform("c", lambda x, i: F.struct(F.length(x).alias("own"), F.concat(x, F.coalesce(F.left(F.get("c", i + 1), F.lit(pieces.longest)), F.lit(""))).alias("w")))).alias("part", "x"))
    chunks = chunks.repartition(n_parts).select("key", (F.col("part") * CHUNK).alias("base"), "x.own", "x.w")
    numbers = f"shiftleft(cast(s as bigint), {_START}) | shiftleft(cast(len as bigint), {_SIZE}) | coalesce(rank, {_NONE})"
    gathered = _edges(chunks, pieces, ["key"]).select("key", F.expr(numbers).alias("k")).groupBy("key").agg(F.collect_list("k").alias("edges"))
    return long.join(gathered, "key").select("key", "word", "n_rows", "edges").mapInArrow(_fold_long(pieces.ranked, pieces.longest, pieces.bytes[0], pieces.viterbi), "key string, word string, n_rows long, ids array<int>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tag and more (hashes that tell texts of one id, and the many of none, apart: 64 bits, 128 for a null id), text
    (null: empty) of every row.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    more = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(7), "text")).otherwise(F.lit(0).cast("long"))
    return picked.select("doc_id", F.xxhash64("text").alias("tag"), more.alias("more"), "text")


def _grouped_by_hash(spark: SparkSession):
    """Edges of a word arise next to each other in one task; up to this many words a task they are gathered without a sort."""
    return setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPED_WORDS))


def _counted(docs: DataFrame, pieces: Pieces, text_col: str) -> Cut:
    """word, n_rows of every distinct word of the documents, written to the shared folder."""
    words = docs.select(_spaced(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("spaced")).mapInArrow(_tallied(pieces.marks), "word string, n long")
    return Cut(words.groupBy("word").agg(F.sum("n").alias("n_rows")))


def dictionary(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """key, word, n_rows, ids of every distinct word of the documents, written to the shared folder."""
    counts = _counted(docs, pieces, text_col)
    with _grouped_by_hash(docs.sparkSession):
        found = cut(encode_words(counts.df, pieces))
    counts.drop()
    return found


def frequent(found: DataFrame, size: Column) -> DataFrame:
    """The rows of a dictionary that occur most often: all from a least count on, so that their sizes add up to BROADCAST_BYTES at most."""
    by_count = found.groupBy("n_rows").agg(F.sum(size + 48).alias("bytes"))
    upto = by_count.withColumn("upto", F.sum("bytes").over(Window.orderBy(F.col("n_rows").desc())))
    least = upto.where(F.col("upto") <= BROADCAST_BYTES).agg(F.min("n_rows").alias("least")).first()["least"]
    return found.where(F.col("n_rows") >= least if least is not None else F.lit(False))


def encode(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """doc_id, tag, more, pos, ids for every word of every whole text: concatenated by pos they are the text's ids.

    tag and more tell different texts of one id apart; rows that repeat id and text repeat their words. Null and empty texts have
    no words. A null doc_id stays null; an empty table gives no rows; other columns are ignored. Frequent words meet the
    dictionary in a broadcast join of bounded size, the others in a shuffled one.
    """
    pieces = pieces or Pieces()
    found = dictionary(docs, pieces, text_col) if found is None else found
    top = F.broadcast(frequent(found, F.octet_length("key") + 4 * F.size("ids")).select("key", "ids"))
    words = _texts(docs, id_col, text_col).select("doc_id", "tag", "more", F.posexplode(segments(F.col("text"), pieces)).alias("pos", "word")).withColumn("key", key(F.col("word")))
    near = words.join(top, "key").select("doc_id", "tag", "more", "pos", "ids")
    far = words.join(top.select("key"), "key", "left_anti").join(found.select("key", "ids"), "key").select("doc_id", "tag", "more", "pos", "ids")
    return near.unionByName(far)


def assembled(encoded: DataFrame) -> DataFrame:
    """doc_id, tag, more, ids: the whole id sequence of each text with words; repeated rows give one."""
    by_text = encoded.groupBy("doc_id", "tag", "more").agg(F.array_sort(F.collect_set(F.struct("pos", "ids"))).alias("x"))
    return by_text.select("doc_id", "tag", "more", F.flatten(F.col("x.ids")).alias("ids"))


def decode(encoded: DataFrame, key: list[str], pieces: Pieces) -> DataFrame:
    """key columns and text of id arrays (column ids): ids joined to the piece table, pieces and bytes joined in order.

    Space signs become spaces. The space before the text stays; the caller that holds a whole text drops it.
    """
    spark = encoded.sparkSession
    each = encoded.select(*key, F.posexplode("ids").alias("k", "id"))
    joined = each.join(F.broadcast(pieces.table(spark).select("id", "piece")), "id", "left")
    first = pieces.bytes[0]
    octets = F.when(F.col("piece").isNotNull(), F.hex(F.encode(F.regexp_replace("piece", SPACE, " "), "UTF-8"))).when(F.col("id").between(first, first + 255), F.lpad(F.hex((F.col("id") - first).cast("long")), 2, "0")).otherwise(F.lit("EFBFBD"))
    parts = joined.select(*key, F.struct("k", octets.alias("o")).alias("x")).groupBy(*key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return parts.select(*key, F.regexp_replace(F.decode(F.unhex(F.array_join(F.col("x.o"), "")), "UTF-8"), SPACE, " ").alias("text"))


def _spread(starts: np.ndarray, lens: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The pieces values[start : start + len] one after the other."""
    ends = np.cumsum(lens)
    return values[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


def _slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """First row and number of rows of slices whose sizes add up to `most` at most, or of one row."""
    upto, out, first = np.cumsum(sizes), [], 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
        out.append((first, last - first))
        first = last
    return out


def _cut_texts(texts: pa.StringArray, marks: str) -> tuple[pa.StringArray, np.ndarray]:
    """The words that `segments` cuts texts into, which come after their space, and how many each text has.

    A border depends on the characters on its two sides alone: line ends stand alone, spaces begin a word unless they follow
    one, and so do marks after a letter. So it is found in the bytes, of which no copy is made.
    """
    kind, border = np.zeros(256, np.uint8), np.zeros((8, 8), bool)
    space, line_end, mark, letter = 1, 2, 3, 4
    for k, chars in ((space, b" "), (line_end, b"\n"), (mark, marks.encode()), (letter, bytes(c for c in range(128) if chr(c).isalpha()))):
        kind[list(chars)] = k
    border[line_end], border[:, line_end], border[:, space], border[letter, mark] = True, True, True, True
    border[space, space] = False

    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffer or b"", np.uint8)[offsets[0] : offsets[-1]]
    kinds = kind[data]
    if SPACE.encode() in memoryview(data).tobytes():
        signs = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        for k in range(3):
            kinds[signs + k] = space
    begins = np.zeros(len(data), bool)
    begins[1:] = border.ravel()[kinds[:-1] << 3 | kinds[1:]]
    upto = offsets - offsets[0]
    begins[upto[:-1][upto[:-1] < upto[1:]]] = True
    starts = np.flatnonzero(begins)
    ends = (np.append(starts, len(data)) + offsets[0]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), buffer), np.diff(np.searchsorted(starts, upto))


def _cut_batch(texts: pa.Array, marks: str) -> Iterator[tuple[int, int, pa.StringArray, np.ndarray]]:
    """First row, number of rows, words and their counts, by slices."""
    texts = texts.cast(pa.string())
    for first, n in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), BATCH_BYTES):
        yield first, n, *_cut_texts(texts.slice(first, n), marks)


def _tallied(marks: str):
    """A pass over texts after their space (the only column): each different word of a batch and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.chunked_array([words for _, _, words, _ in _cut_batch(b.column(0), marks)], pa.string()).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return run


def _coded(top, size: int, marks: str, far: bool):
    """A pass over texts after their space (the last column), with the ids of frequent words in hand.

    far: a row for each different word of a text that isn't among them: the text's columns of _ROW, which come first, the
    word's place j among these words of the text by first occurrence, and its key. Else a row for each text: its other
    columns, n_parts, the number of symbols, and the symbols: ids in order, size + j where such a word stands, as 32-bit
    numbers laid out by byte planes and compressed.
    """

    def short(words: pa.Array) -> pa.Array:
        """The words as `key` has them."""
        long = pc.greater(pc.binary_length(words), MOST_CHARS)
        if pc.any(long).as_py() and pc.any(long := pc.greater(pc.utf8_length(words), MOST_CHARS)).as_py():
            digests = ["\n" + hashlib.md5(w).hexdigest() for w in words.filter(long).cast(pa.binary()).to_pylist()]
            words = pc.replace_with_mask(words, long, pa.array(digests, words.type))
        return words

    def of(b: pa.RecordBatch, counts: np.ndarray, words: pa.Array, found: pa.Array, codec: pa.Codec) -> pa.RecordBatch:
        _, starts, lens, values = top.value
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        row_of = np.repeat(np.arange(b.num_rows), counts)[missing]
        away = words.take(pa.array(missing))
        js, new, seen, last = np.zeros(len(missing), np.int32), [], {}, -1
        for k, (r, w) in enumerate(zip(row_of.tolist(), away.to_pylist())):
            if r != last:
                seen, last = {}, r
            if w not in seen:
                seen[w] = len(seen)
                new.append(k)
            js[k] = seen[w]
        if far:
            at = pa.array(row_of[new])
            return pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in range(len(_ROW))], pa.array(js[new]), away.take(pa.array(new, pa.int64()))], names=[*_ROW, "j", "key"])
        at = found.fill_null(0).to_numpy()
        # the places of words that are away come after all ids
        word_starts, word_lens = (starts[at], lens[at]) if len(lens) else (np.zeros(len(at), np.int64), np.ones(len(at), np.int64))
        word_starts[missing], word_lens[missing] = len(values) + js, 1
        most = int(js.max(initial=-1)) + 1
        symbols = _spread(word_starts, word_lens, np.concatenate([values, np.arange(size, size + most, dtype=np.int32)]))
        ends = np.concatenate([[0], np.cumsum(word_lens)])[np.cumsum(counts)]
        n = np.diff(ends, prepend=0)
        blobs = [codec.compress(np.ascontiguousarray(symbols[e - k : e].view(np.uint8).reshape(-1, 4).T), asbytes=True) if k else b"" for e, k in zip(ends.tolist(), n.tolist())]
        names = [*b.schema.names[:-1], "n_parts", "n", "symbols"]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts), pa.array(n), pa.array(blobs, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            cuts = [(first, n, short(words), counts) for first, n, words, counts in _cut_batch(b.column(b.num_columns - 1), marks)]
            # all at once, since each call lays the frequent words out anew
            found = pc.index_in(pa.chunked_array([words for _, _, words, _ in cuts], pa.string()), value_set=top.value[0])
            at = 0
            for first, n, words, counts in cuts:
                yield of(b.slice(first, n), counts, words, found.slice(at, len(words)).combine_chunks(), codec)
                at += len(words)

    return run


def _assembled(octets: list[bytes], n_others: int):
    """Whole texts: symbols become ids, with the ids of the words that were away (the last column) put in; ids become the text's bytes.

    Columns n_others and after are n_parts, n, symbols, away: an array of (j, ids). Those before are passed on.
    """
    size = len(octets)

    def of(b: pa.RecordBatch) -> pa.RecordBatch:
        n, blobs, away = (b.column(n_others + k) for k in (1, 2, 3))
        n = n.to_numpy()
        parts = [np.frombuffer(pa.decompress(x, decompressed_size=4 * k, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel() for x, k in zip(blobs.to_pylist(), n.tolist()) if k]
        symbols = np.concatenate([np.zeros(0, np.int32), *parts])
        gaps = np.flatnonzero(symbols >= size)
        items = away.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        inner = away.flatten()
        js, ids = inner.field("j").to_numpy(), inner.field("ids")
        base = np.cumsum(items) - items
        slot = np.full(len(js) + 1, -1)
        slot[np.repeat(base, items) + js] = np.arange(len(js))
        places = base[np.repeat(np.arange(b.num_rows), n)[gaps]] + symbols[gaps] - size
        item = slot[places]
        if (item < 0).any():
            raise ValueError("a word's ids are missing")
        item_lens = ids.value_lengths().to_numpy().astype(np.int64)
        starts, lens = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        starts[gaps], lens[gaps] = len(symbols) + (np.cumsum(item_lens) - item_lens)[item], item_lens[item]
        whole = _spread(starts, lens, np.concatenate([symbols, ids.flatten().to_numpy()]))
        ends = np.concatenate([[0], np.concatenate([[0], np.cumsum(lens)])[np.cumsum(n)]])
        plain = table.take(pa.array(whole))
        at = np.frombuffer(plain.buffers()[1], np.int32, len(whole) + 1)[ends]
        texts = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at.tobytes()), plain.buffers()[2]])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole, pa.int32()))
        return pa.RecordBatch.from_arrays([*b.columns[: n_others + 1], lists, texts], names=[*b.schema.names[: n_others + 1], "ids", "octets"])

    table = pa.array(octets, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n in _slices(b.column(n_others + 1).to_numpy(), BATCH_SYMBOLS):
                yield of(b.slice(first, n))

    return run


def encode_texts(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_parts (words), ids (of the whole text in order), text (what these ids decode to),
    decoded (whether that is the row's text, by 64-bit hashes of both).

    Null and empty texts have no parts and no ids, a null doc_id stays null, repeated rows each get a row, an empty table
    gives none; other columns are ignored. The texts are cut into words three times, in their bytes: to find the dictionary; to find each
    text's words that aren't among the frequent ones, whose ids are looked up by a shuffled join; and to put each text's ids in
    order, where frequent words are found in a table of bounded size. A text travels once, as compressed ids, to meet the rest.
    """
    pieces, spark = pieces or Pieces(), docs.sparkSession
    mark = made()
    found = dictionary(docs, pieces, text_col)
    frequent_words = frequent(found, F.octet_length("key") + 4 * F.size("ids")).select("key", "ids").toArrow()
    ids, keys = frequent_words["ids"].combine_chunks(), frequent_words["key"].combine_chunks().cast(pa.string())
    lens = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    top = spark.sparkContext.broadcast((keys, np.cumsum(lens) - lens, lens, ids.flatten().to_numpy(zero_copy_only=False)))
    whole = F.xxhash64(F.concat(F.lit(" "), "text")).alias("whole")  # encoding puts a space before a text
    row = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "tag", "more"]
    texts, spaced = _texts(docs, id_col, text_col), _spaced(F.col("text")).alias("spaced")
    kinds = "id long, none boolean, tag long, more long"
    size = len(pieces.octets)
    away = texts.select(*row, spaced).mapInArrow(_coded(top, size, pieces.marks, True), f"{kinds}, j int, key string")
    away = away.join(found.select("key", "ids"), "key").repartition(*_ROW)
    away = Cut(away.groupBy(*_ROW).agg(F.collect_list(F.struct("j", "ids")).alias("away")))
    drop_since(mark, keep=away)
    coded = texts.select(*row, whole, spaced).mapInArrow(_coded(top, size, pieces.marks, False), f"{kinds}, whole long, n_parts long, n long, symbols binary")
    met = coded.join(away.df.hint("shuffle_hash"), _ROW, "left").select("id", "none", "whole", "n_parts", "n", "symbols", "away")
    out = met.mapInArrow(_assembled(pieces.octets, 3), "id long, none boolean, whole long, n_parts long, ids array<int>, octets binary")
    return out.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_parts",
        "ids",
        F.decode(F.substring("octets", 2, 1 << 30), "UTF-8").alias("text"),
        ((F.col("n_parts") == 0) | (F.xxhash64("octets") == F.col("whole"))).alias("decoded"),
    )


def _digests() -> list[Column]:
    return [F.col("doc_id"), F.col("n_parts"), F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded")]


def token_counts(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_parts, n_tokens, ids_hash (of the whole id sequence), decoded: the digests of what `encode_texts` gives for each row."""
    return encode_texts(docs, pieces, id_col, text_col).select(*_digests())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests and the ids of every text."""
    return encode_texts(table(spark, sf_dir, "documents")).select(*_digests(), "ids")
