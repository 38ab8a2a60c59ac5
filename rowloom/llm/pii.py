"""Personal data: base patterns, high-recall candidate spans, boosted trees over format and context, redaction.

DataFrame functions only; the trees are fitted in plain Python on a small table of counts and applied as column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import last_at_or_before, let, scan, table

#: The base patterns, written so that Java's matcher neither recurses nor backtracks over long runs; \G lets a match
#: begin inside a run of local-part characters only where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Words before a span that mark it as a secret for the fit.
SECRET_WORDS = "password|passwd|pwd|token|secret|api_key|apikey"

#: High-recall generators; their spans may overlap each other and the base spans.
GENERATORS = {
    "contact": r"(?<![^\s@])[^\s@]++@[^\s@]++",
    "number": r"[+(]?[0-9][0-9\x20().-]{5,}+(?<=[0-9])|[+(]?[0-9][0-9\x20().-]{5,}[0-9]",
    "secret": r"[A-Za-z0-9+/_-]{16,}+",
    "password": rf"(?i)(?<=(?:{SECRET_WORDS})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?)[^\s\"']{{6,}}+",
}

#: Words before a span that mark contact data.
CONTACT_WORDS = "mail|phone|tel|call|card|address"

#: Rounds, shrinkage, precision asked of a threshold.
ROUNDS, RATE, PRECISION = 16, 0.4, 0.95

#: Code points of the chunks that a text is redacted by.
CHUNK = 1000

FEATURES = ("generator", "length", "digits", "share", "separators", "opening", "hexes", "before", "after", "at_dot", "dots")


def _names_secret(text: Column) -> Column:
    """Whether a text holds a word that names a secret: plain searches, far cheaper than a pattern over the whole text."""

    def held(low: Column) -> Column:
        out = F.lit(False)
        for word in SECRET_WORDS.split("|"):
            out = out | F.contains(low, F.lit(word))
        return out

    return let(F.lower(text), held)


def _any(text: Column) -> Column:
    """What holds for every text with a span."""
    return text.rlike("[0-9@]") | _names_secret(text)


def _bin(x: Column, *edges: int) -> Column:
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(x < edges[k], F.lit(k)).otherwise(out)
    return out


def _found(text: Column, pattern: str, guard: Column, keep) -> Column:
    """Matches of a pattern as an array of (start, end, body, before, after), offsets in code points, for which keep(match) holds."""
    shape = "array<struct<start:int,end:int,body:string,before:string,after:string>>"

    def placed(gaps: Column) -> Column:
        def of_bodies(bodies: Column) -> Column:
            ends = scan(F.transform(bodies, lambda b, i: F.length(F.get(gaps, i)) + F.length(b)), lambda a, x: a + x)

            def one(end: Column, i: Column) -> Column:
                body = F.get(bodies, i)
                return F.struct((end - F.length(body)).alias("start"), end.alias("end"), body.alias("body"), F.right(F.get(gaps, i), F.lit(16)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))

            return F.filter(F.transform(ends, one), keep)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of_bodies)

    none = F.array().cast(shape)
    return F.when(guard, let(F.split(text, pattern, -1), lambda g: F.when(F.size(g) < 2, none).otherwise(placed(g)))).otherwise(none)


def _digits(x: Column) -> Column:
    return F.translate(x, " ().-+", "")


def _luhn(x: Column) -> Column:
    def total(d: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            v = F.substring(d, i, F.lit(1)).cast("int")
            twice = 2 * v
            return acc + F.when((F.length(d) - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0

    return let(_digits(x), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), total(d)).otherwise(F.lit(False)))


def _parts_fit(x: Column) -> Column:
    return F.forall(F.split(x, "\\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255"))))


CHECKS = {
    "email": lambda x: F.lit(True),
    "ip": _parts_fit,
    "card": _luhn,
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """Struct of one array of (start, end, ...) for each base kind, in their listed order."""
    has_digit = text.rlike("[0-9]")
    guards = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": has_digit, "phone": F.contains(text, F.lit("+"))}

    def of_kind(k: str) -> Column:
        return _found(text, PATTERNS[k], guards[k], lambda m: CHECKS[k](m["body"])).alias(k)

    return F.struct(*map(of_kind, PATTERNS))


def candidates(text: Column) -> Column:
    """Array of candidate spans with their bounded features: (generator, start, end, named, and the FEATURES as small ints)."""
    guards = {"contact": F.contains(text, F.lit("@")), "number": text.rlike("[0-9]"), "secret": text.rlike("[0-9]"), "password": _names_secret(text) & text.rlike(f"(?i)(?:{SECRET_WORDS})[\"']?\\s{{0,2}}[=:]")}
    checks = {"contact": lambda m: F.lit(True), "number": lambda m: F.length(_digits(m["body"])) >= 6, "secret": lambda m: m["body"].rlike("[0-9]") & m["body"].rlike("[A-Za-z]"), "password": lambda m: F.lit(True)}

    def of_generator(g: int, name: str) -> Column:
        def described(m: Column) -> Column:
            body, before, after = m["body"], m["before"], m["after"]
            digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
            seps = F.length(body) - F.length(_digits(body))
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.lower(before).rlike(SECRET_WORDS).alias("named"),
                F.lit(g).alias("generator"),
                _bin(F.length(body), 8, 12, 16, 20, 32).alias("length"),
                _bin(digits, 1, 4, 9, 13, 20).alias("digits"),
                _bin(digits * 4 / F.length(body), 1, 2, 3, 4).alias("share"),
                _bin(seps, 1, 2, 4).alias("separators"),
                F.when(F.startswith(body, F.lit("+")), 1).when(F.startswith(body, F.lit("(")), 2).otherwise(0).alias("opening"),
                F.when(body.rlike("^[0-9a-f]+$"), 1).when(body.rlike("[A-Z]") & body.rlike("[a-z]"), 2).otherwise(0).alias("hexes"),
                F.when(before.rlike("[=:\"']\\s?$"), 1).when(F.lower(before).rlike(CONTACT_WORDS), 2).otherwise(0).alias("before"),
                F.when(after.rlike("[\\p{L}\\p{N}]"), 1).otherwise(0).alias("after"),
                F.when(body.rlike("@.*\\."), 1).otherwise(0).alias("at_dot"),
                _bin(F.length(body) - F.length(F.translate(body, ".", "")), 1, 2, 3, 4).alias("dots"),
            )

        return F.transform(_found(text, GENERATORS[name], guards[name], checks[name]), described)

    return F.concat(*[of_generator(g, name) for g, name in enumerate(GENERATORS)])


def _picked(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _beside(base: Column, body) -> Column:
    """body(near): near(candidate, "overlaps" or "holds") tells whether a base span overlaps or holds a candidate.

    A kind's spans are in order and don't overlap, so only the last that starts early enough can; it is found by halving.
    """

    def sides(spans: Column) -> Column:
        starts = F.struct(*[F.transform(spans[k], lambda m: m["start"]).alias(k) for k in PATTERNS])

        def with_starts(starts: Column) -> Column:
            def by_kind(k: str, at: Column, least: Column) -> Column:
                reaches = let(last_at_or_before(starts[k], at), lambda n: F.coalesce(F.get(spans[k], n - 1)["end"] >= least, F.lit(False)))
                return F.when(F.size(starts[k]) == 0, F.lit(False)).otherwise(reaches)

            def near(c: Column, how: str) -> Column:
                at, least = (c["end"] - 1, c["start"] + 1) if how == "overlaps" else (c["start"], c["end"])
                out = F.lit(False)
                for k in PATTERNS:
                    out = out | by_kind(k, at, least)
                return out

            return body(near)

        return let(starts, with_starts)

    return let(base, sides)


def patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The fit's counts over all documents: the features with n_pos, n_neg (fit) and c_pos, c_neg (calibration, a fifth of candidates).

    A candidate counts as positive if it overlaps a base span or is named as a secret just before it. The features are
    small numbers: there are at most as many rows as combinations of their values.
    """
    found = _picked(docs, text_col).where(_any(F.col("text"))).select(base_spans(F.col("text")).alias("b"), candidates(F.col("text")).alias("c"), F.xxhash64("text").alias("h"))
    marked = _beside(F.struct(*[F.col(f"b.{k}").alias(k) for k in PATTERNS]), lambda near: F.transform("c", lambda c: F.struct(c.alias("c"), (near(c, "overlaps") | (c["generator"] == 3) | ((c["generator"] == 2) & c["named"])).alias("y"))))
    rows = found.select("h", F.explode(marked).alias("m")).select(*[f"m.c.{f}" for f in FEATURES], "m.y", (F.pmod(F.xxhash64("h", "m.c.start"), F.lit(5)) == 0).alias("held"))
    y, held = F.col("y"), F.col("held")
    return rows.groupBy(*FEATURES).agg(*[F.count_if(cond).alias(n) for n, cond in (("n_pos", y & ~held), ("n_neg", ~y & ~held), ("c_pos", y & held), ("c_neg", ~y & held))])


class Model:
    """Depth-two trees [(feature, cut, (feature, cut, low, high), (feature, cut, low, high))] and a threshold for each generator."""

    def __init__(self, bias: float, trees: list, thresholds: list[float]):
        self.bias, self.trees, self.thresholds = bias, trees, thresholds

    @staticmethod
    def _leaf(node, row) -> float:
        f, cut, low, high = node
        return low if row[f] <= cut else high

    def score(self, row: dict) -> float:
        s = self.bias
        for f, cut, left, right in self.trees:
            s += self._leaf(left if row[f] <= cut else right, row)
        return s

    def column(self, c: Column) -> Column:
        """The same score over a candidate struct."""

        def leaf(node) -> Column:
            f, cut, low, high = node
            return F.when(c[f] <= cut, F.lit(low)).otherwise(F.lit(high))

        s = F.lit(self.bias)
        for f, cut, left, right in self.trees:
            s = s + F.when(c[f] <= cut, leaf(left)).otherwise(leaf(right))
        return s

    def selects(self, c: Column) -> Column:
        least = F.lit(math.inf)
        for g, t in enumerate(self.thresholds):
            least = F.when(c["generator"] == g, F.lit(float(t))).otherwise(least)
        return self.column(c) >= least


def _stump(rows: list[dict], bound: float = 1.0) -> tuple[float, tuple]:
    """Best single split of rows with gradients g and curvatures h: (gain, (feature, cut, low, high))."""
    total_g, total_h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best = (0.0, (FEATURES[0], 99, -RATE * total_g / (total_h + bound), 0.0))
    for f in FEATURES:
        by: dict[int, list[float]] = {}
        for r in rows:
            x = by.setdefault(r[f], [0.0, 0.0])
            x[0] += r["g"]
            x[1] += r["h"]
        g = h = 0.0
        for v in sorted(by)[:-1]:
            g, h = g + by[v][0], h + by[v][1]
            gain = g * g / (h + bound) + (total_g - g) ** 2 / (total_h - h + bound) - total_g**2 / (total_h + bound)
            if gain > best[0] + 1e-12:
                best = (gain, (f, v, -RATE * g / (h + bound), -RATE * (total_g - g) / (total_h - h + bound)))
    return best


def boost(rows: list[dict]) -> Model:
    """Fit trees by Newton boosting of the logistic loss on pattern counts; thresholds from the held-out counts."""
    n_pos, n_neg = sum(r["n_pos"] for r in rows), sum(r["n_neg"] for r in rows)
    model = Model(math.log((n_pos + 1) / (n_neg + 1)), [], [math.inf] * len(GENERATORS))
    if not n_pos:
        return model
    scores = [model.bias] * len(rows)
    for _ in range(ROUNDS):
        for r, s in zip(rows, scores):
            p, n = 1 / (1 + math.exp(-s)), r["n_pos"] + r["n_neg"]
            r["g"], r["h"] = n * p - r["n_pos"], max(n * p * (1 - p), 1e-9)
        gain, (f, cut, _, _) = _stump(rows)
        if gain <= 1e-6:
            break
        parts = [[r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]]
        model.trees.append((f, cut, *(_stump(p)[1] for p in parts)))
        one = Model(0.0, model.trees[-1:], [])
        scores = [s + one.score(r) for r, s in zip(rows, scores)]
    for g in range(len(GENERATORS)):
        pos = neg = 0
        for s, p, n in sorted(((s, r["c_pos"], r["c_neg"]) for r, s in zip(rows, scores) if r["generator"] == g), reverse=True):
            pos, neg = pos + p, neg + n
            if pos and pos >= PRECISION * (pos + neg) and s > 0:
                model.thresholds[g] = s
    return model


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """A model from all documents themselves. Only the counts of feature patterns come to the driver, one row a combination
    of the features' few values.
    """
    return boost([r.asDict() for r in patterns(docs, text_col).orderBy(*FEATURES).collect()])


def annotate(text: Column, model: Model) -> Column:
    """Struct of n_email, n_ip, n_card, n_phone, base (array of kind, start, end) and added (the model's further spans)."""

    def all_of(b: Column) -> Column:
        def of_kind(k: str) -> Column:
            return F.transform(b[k], lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

        base = F.concat(*[of_kind(k) for k in PATTERNS])

        def with_base(known: Column) -> Column:
            chosen = _beside(b, lambda near: F.filter(candidates(text), lambda c: model.selects(c) & ~near(c, "holds")))
            name = lambda c: F.element_at(F.array(*[F.lit(g) for g in GENERATORS]), c["generator"] + 1)
            added = F.array_sort(F.transform(chosen, lambda c: F.struct(name(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
            counts = [F.size(b[k]).cast("long").alias(f"n_{k}") for k in PATTERNS]
            return F.struct(*counts, known.alias("base"), F.when(_any(text), added).otherwise(F.filter(known, lambda k: F.lit(False))).alias("added"))

        return let(base, with_base)

    return let(base_spans(text), all_of)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named after the first.

    The text is cut into chunks once, so that a piece of it costs no walk from its start.
    """
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def of_spans(s: Column) -> Column:
        def of_reach(reach: Column) -> Column:
            """reach: the furthest end so far. A span that begins at or after it begins a redaction."""
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))

            def of_heads(h: Column) -> Column:
                one = F.transform(h, lambda i, k: F.struct(F.get(s, i)["kind"].alias("kind"), F.get(s, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(h, k + 1), F.size(s)) - 1).alias("end")))
                return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda chunks: let(one, lambda m: replaced(chunks, m)))

            return let(heads, of_heads)

        return let(scan(F.transform(s, lambda x: x["end"]), F.greatest), of_reach)

    def piece(chunks: Column, start: Column, end: Column) -> Column:
        a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        first = F.coalesce(F.get(chunks, a), F.lit(""))
        last = F.left(F.coalesce(F.get(chunks, b), F.lit("")), end % CHUNK)
        many = F.concat(F.substring(first, start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), last)
        return F.when(a == b, F.substring(first, start % CHUNK + 1, end - start)).otherwise(many)

    def replaced(chunks: Column, merged: Column) -> Column:
        pieces = F.transform(merged, lambda m, i: F.concat(piece(chunks, F.when(i == 0, F.lit(0)).otherwise(F.get(merged, i - 1)["end"]), m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]")))
        return F.concat(F.array_join(pieces, ""), piece(chunks, F.element_at(merged, -1)["end"], F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(by_start, of_spans))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base, added.

    Null text counts as empty and has no spans; a null doc_id stays null; repeated rows each get a row; an empty table
    gives no rows; other columns are ignored. Without a model one is fitted on docs. No shuffle but the fit's counts. The
    time for a text grows with its length and its matches, so a very long one, such as a log, is read whole.
    """
    model = model or fit(docs, text_col)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return picked.select("doc_id", annotate(F.col("text"), model).alias("a")).select("doc_id", "a.*")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs, same columns and rows, with every span of the text replaced; null text stays null."""
    model = model or fit(docs, text_col)
    text = F.col(text_col)
    clean = let(annotate(text, model), lambda a: redacted(text, F.concat(a["base"], a["added"])))
    return docs.withColumn(text_col, F.when(_any(text), clean).otherwise(text))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"))
