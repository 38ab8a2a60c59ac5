"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import licenses, mixing, pii, quality_rules, sentencepieces, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, word string, row long, n long, root long, key string"
LONG = "word " * 30_000 + "x" * 5_000
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf again and again.",
    "the QUICK brown fox jumps over the lazy dog and runs away from the big bad wolf again and again.",
    "one two three", "one", "", None, " \t\n ", "a b a b a b a b", LONG, "line\nline\nline\n\nother\r\nline", "#$% *** |", "é ñ 😀 ü\x0b\x0cz", "mail a.b@c.d.e, call +1 (269) 555-3296 or 4111 1111 1111 1111 at 10.0.0.255",
    "Licensed under the Apache License, Version 2.0.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s0", 1), (3, "one", "en", "s0", 1), (50, "one", None, None, None), (None, "one two three", "en", "s1", 1), (60, "p q r", "en", "s2", 1), (60, "other text of the same id", "en", "s2", 1)]
    return spark.createDataFrame([(*r, 7, "w", 7, 7, 7, "k") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_fingerprint(text):
    import xxhash

    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, linked):
    items = list(items)
    root = {x: x for x in items}
    for x in items:
        for y in items:
            if linked(x, y) and root[x] != root[y]:
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


def test_simhash(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = {i: brute_fingerprint(r.text) for i, r in enumerate(rows)}
    root = brute_components(set(prints.values()), lambda x, y: (x ^ y).bit_count() <= 3)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[root[prints[i]]] += [r.doc_id] if r.doc_id is not None else []
    want = Counter((r.doc_id, f"{prints[i]:016x}", min(low[root[prints[i]]])) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base for _ in range(12)]
    prints = sorted({int(b) for b in base} | set(near))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    root = brute_components(prints, lambda x, y: (x ^ y).bit_count() <= 3)
    want = {frozenset(k for k in prints if root[k] == r) for r in root.values()}
    for group_rows in (20_000, 4):  # the second passes every group on by pivot cells
        monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long").repartition(4)).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
        found = {p: {p} for p in prints}
        for a, b in pairs:
            if found[a] is not found[b]:
                found[a] |= found[b]
                for x in found[b]:
                    found[x] = found[a]
        assert {frozenset(v) for v in found.values()} == want


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and Counter(ids)[3] == 1 and Counter(ids)[None] == 1 and 1 not in ids and 0 in ids and 50 not in ids


def brute_shingles(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("near", [4, 0])
def test_near_copies_of_the_pipeline_stage(spark, monkeypatch, near):
    """Every pair of 5-word Jaccard 0.8 or more is linked, however far its fingerprints are, and no other pair."""
    import corpus_pipeline
    from rowloom.llm import shingles

    monkeypatch.setattr(shingles, "NEAR", near)
    rng = np.random.default_rng(11)
    rows = []
    for base in range(14):
        words = [f"w{k}" for k in rng.integers(0, 300 if base % 2 else 40, rng.integers(3, 160))]
        for _ in range(9):
            copy = list(words)
            for at in rng.integers(0, len(words), rng.integers(0, 5)):
                copy[at] = f"x{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(copy[: len(copy) - int(rng.integers(0, 12))] if len(copy) > 40 else copy)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (5, rows[5][1])]
    sets = {i: brute_shingles(t) for i, t in rows}

    def similar(x, y):
        a, b = sets[x], sets[y]
        return (not a and not b) or (a | b and len(a & b) >= 0.8 * len(a | b))

    root = brute_components(sets, similar)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.component_id) for r in shingles.near_duplicates(df).collect()) == sorted((i, root[i]) for i, _ in rows)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == sorted(set(root.values()))
    assert any(similar(x, y) and (simhash.fingerprint(dict(rows)[x]) ^ simhash.fingerprint(dict(rows)[y])).bit_count() > 3 for x in sets for y in sets)
    assert shingles.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints_gather_and_links_stay_linear(spark, monkeypatch):
    """The pivot tables meet fingerprints at any radius; a group of near copies leaves the listing with fewer links than sets."""
    import pyarrow as pa

    from rowloom.llm import shingles

    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(63, k % 8, replace=False)) for k, f in enumerate(fps)]
    links = simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp long"), 6).collect()
    want = brute_components(dict.fromkeys(fps), lambda x, y: (x ^ y).bit_count() <= 6)
    met = {(r.a, r.b) for r in links}
    assert all((a ^ b).bit_count() <= 6 for a, b in met) and brute_components(dict.fromkeys(fps), lambda x, y: (x, y) in met or (y, x) in met) == want
    words = [f"w{k}" for k in range(200)]
    sets = [shingles.shingle_set(" ".join([*words[:k], f"x{k}", *words[k:]])) for k in range(10, 190, 3)]
    rows = sorted((int(s), len(x), k, int(p), k, shingles._sketch(x)) for k, x in enumerate(sets) for p, s in enumerate(shingles._prefix(x, x[:0], x[:0].astype(np.int64), shingles.LEAST).view(np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["s", "n", "key", "pos", "label", "sketch"])
    out = [b for b in shingles._likely(shingles.LEAST)(iter([batch]))]
    assert 0 < sum(b.num_rows for b in out) < len(sets)
    monkeypatch.setattr(shingles, "GROUP", 3)
    monkeypatch.setattr(shingles, "LOAD", 500)
    df = spark.createDataFrame([(k, " ".join([*words[:k], f"x{k}", *words[k:]])) for k in range(10, 190, 3)], "doc_id long, text string")
    assert {r.component_id for r in shingles.near_duplicates(df).collect()} == {10}


def brute_rules(text):
    text = text or ""
    w = split(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[w[i], w[i + 1], w[i + 2]] > 1}
    lines = [x for x in text.split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty):
    found = quality_rules.decide(quality_rules.ledger(docs))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found.collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        m = brute_rules(r.text)
        want[(r.doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert not found.where("base_failed and kept").count() and quality_rules.ledger(empty).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_policies_and_ablations(docs):
    led = quality_rules.ledger(docs).cache()
    for version, rules in quality_rules.POLICIES.items():
        m = quality_rules.mask(version)
        bits = [r.failed_bits & m for r in led.collect()]
        got = {r.rule: (r.n_failed, r.n_only, r.kept_without, r.kept) for r in quality_rules.ablations(led, version).collect()}
        assert got == {r: (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits), sum(b & ~(1 << k) == 0 for b in bits), sum(b == 0 for b in bits)) for r in rules for k in [quality_rules.RULES.index(r)]}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def fits(kind, body):
        d = re.sub("[^0-9]", "", body)
        if kind == "ip":
            return all(int(p) <= 255 for p in body.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m.group())]


HARD = [
    "a@b.c_d@e.f x@y 😀é q@w.e..r @a.b a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "+1 269 555 3296 4111", "+1((((((((9 +12345678 +123456789", "4111-1111-1111-1111 4111 1111  1111 1111 41111111111111112222",
    "4111 1111 1111 1111.", "9" * 3000, "a." * 3000 + "@" + "b." * 3000 + "c", "+" + "1(" * 3000, "1-2-3 4 5", "x@y.z@w.v", "",
]


def test_pii_base(spark, docs):
    hard = spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(hard)
    model = pii.fit(all_docs)
    found = pii.find(all_docs, model)
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, tuple((s.kind, s.start, s.end) for s in r.base)) for r in found.collect())
    want = Counter()
    for r in all_docs.collect():
        s = brute_spans(r.text)
        want[(r.doc_id, *(sum(x[0] == k for x in s) for k in PATTERNS), tuple(s))] += 1
    assert got == want
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_redaction_and_digest(spark):
    df = spark.createDataFrame([(1, "é a.b@c.de and 10.0.0.1 x"), (2, None), (3, "nothing here"), (4, "a@b.cc")], "doc_id long, text string")
    none = pii.Model(0.0, [], [float("inf")] * len(pii.GENERATORS))
    assert [r.text for r in pii.redact(df, none).orderBy("doc_id").collect()] == ["é [EMAIL] and [IP] x", None, "nothing here", "[EMAIL]"]
    row = pii.find(df, none).where("doc_id = 1").select(F.sha2(pii.written(F.col("base")), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"email:2:10,ip:15:23").hexdigest()


def brute_candidates(text):
    """Spans of the generators with their features, one by one."""
    import regex

    def at(x, *edges):
        return next((k for k, e in enumerate(edges) if x < e), len(edges))

    out, secret = [], f"(?i)(?:{pii.SECRET_WORDS})"
    for g, (name, pattern) in enumerate(pii.GENERATORS.items()):
        last = 0
        for m in regex.finditer(pattern, text):
            body, before, after = m.group(), text[last : m.start()][-16:], text[m.end() : m.end() + 1]
            last = m.end()
            after = "" if any(n.start() == m.end() for n in regex.finditer(pattern, text)) else after
            plain = re.sub("[ ().+-]", "", body)
            if (g == 1 and len(plain) < 6) or (g == 2 and not (re.search("[0-9]", body) and re.search("[A-Za-z]", body))):
                continue
            digits, seps, dots = len(re.sub("[^0-9]", "", body)), len(body) - len(plain), body.count(".")
            row = {
                "generator": g, "length": at(len(body), 8, 12, 16, 20, 32), "digits": at(digits, 1, 4, 9, 13, 20), "share": at(digits * 4 / len(body), 1, 2, 3, 4), "separators": at(seps, 1, 2, 4),
                "opening": 1 if body[0] == "+" else 2 if body[0] == "(" else 0, "hexes": 1 if re.fullmatch("[0-9a-f]+", body) else 2 if re.search("[A-Z]", body) and re.search("[a-z]", body) else 0,
                "before": 1 if re.search("[=:\"']\\s?$", before) else 2 if re.search(pii.CONTACT_WORDS, before.lower()) else 0, "after": int(bool(regex.match("[\\p{L}\\p{N}]", after))), "at_dot": int(bool(re.search("@.*\\.", body))), "dots": at(dots, 1, 2, 3, 4),
            }
            out.append((name, m.start(), m.end(), row))
    return out if re.search("[0-9@]", text) or re.search(secret, text) else []


def test_pii_method_spans(spark):
    """Spans that the trees add, against every candidate scored and compared with every base span one by one."""
    rng = np.random.default_rng(7)
    parts = ["mail", "a.b@c.de", "10.0.0.1", "password: hunter2x", "token = 'ZmFrZS1zZWNyZXQtdmFsdWU'", 'secret="4f3a9c0d17be55aa61"', "call (269) 555 3296 now", "x@y", "2024-01-02 10:11", "4111 1111 1111 1111", "abcdefghijklmnop1", "é😀", "+1 269 555 3296.", "1.2.3.4.5.6.7.8", "API_KEY: qwertzuiop"]
    df = spark.createDataFrame([(i, " ".join(rng.choice(parts, rng.integers(1, 12)))) for i in range(300)], "doc_id long, text string").repartition(3)
    model = pii.fit(df)
    assert any(np.isfinite(t) for t in model.thresholds)
    added = 0
    for r in pii.find(df, model).join(df, "doc_id").collect():
        base = [(s.start, s.end) for s in r.base]
        want = sorted((k, a, b) for k, a, b, row in brute_candidates(r.text) if model.score(row) >= model.thresholds[row["generator"]] - 1e-12 and not any(s <= a and b <= e for s, e in base))
        assert [(s.kind, s.start, s.end) for s in r.added] == want, r.text
        added += len(want)
    assert added > 100


def test_pii_of_a_log(spark):
    """Many matches in one text: offsets, redaction and time that grows with the matches."""
    line = "10.0.0.1 GET /x a@b.cc\n"
    df = spark.createDataFrame([(1, "é" + line * 20_000)], "doc_id long, text string")
    none = pii.Model(0.0, [], [float("inf")] * len(pii.GENERATORS))
    row = pii.find(df, none).first()
    n = len(line)
    assert (row.n_ip, row.n_email) == (20_000, 20_000)
    assert [(s.kind, s.start, s.end) for s in row.base] == [("email", 1 + n * i + 16, 1 + n * i + 22) for i in range(20_000)] + [("ip", 1 + n * i, 9 + n * i) for i in range(20_000)]
    assert pii.redact(df, none).first().text == "é" + "[IP] GET /x [EMAIL]\n" * 20_000


def test_pii_model_scores_agree(spark):
    rng = np.random.default_rng(1)
    rows = [{f: int(rng.integers(0, 3)) for f in pii.FEATURES} | {"generator": int(rng.integers(0, len(pii.GENERATORS)))} for _ in range(200)]
    for r in rows:
        y = int(r["digits"] > 1) * 20
        r.update(n_pos=y, n_neg=20 - y, c_pos=y // 4, c_neg=(20 - y) // 4)
    model = pii.boost(rows)
    assert len(model.trees) > 1 and all(np.isfinite(t) for t in model.thresholds)
    df = spark.createDataFrame([tuple(r[f] for f in pii.FEATURES) for r in rows], ", ".join(f"{f} int" for f in pii.FEATURES))
    got = [r.s for r in df.select(model.column(F.struct(*pii.FEATURES)).alias("s")).collect()]
    assert np.allclose(got, [model.score(r) for r in rows])
    assert all((model.score(r) >= model.thresholds[r["generator"]]) == (r["digits"] > 1) for r in rows)


def brute_mix(rows):
    """source: (size, target) by resharing until none is above."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(split(text))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, stopped = sum(size.values()), set()
    while True:
        left, open_ = total - sum(3 * size[s] for s in stopped), [s for s in order if s not in stopped]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not above:
            return {s: (size[s], 3 * size[s] if s in stopped else level * weight[s]) for s in order}
        stopped |= above


def test_mixing(spark, docs, empty):
    extra = spark.createDataFrame([(1000 + i, "w " * (i % 40), "big" if i % 3 else "tiny" if i % 90 == 0 else None) for i in range(900)], "doc_id long, text string, source string")
    all_docs = docs.select("doc_id", "text", "source").union(extra).withColumn("size", F.lit("clash")).repartition(5)
    want = brute_mix([tuple(r)[:3] for r in all_docs.collect()])
    got = mixing.mix(all_docs).collect()
    sources = {r.doc_id: r.source for r in all_docs.collect()}
    taken = defaultdict(int)
    for r in got:
        s = sources[r.doc_id]
        assert r.source_size == want[s][0] and abs(r.target - want[s][1]) < 1e-3 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == all_docs.count() and all(abs(taken[s] - want[s][1]) <= 3 for s in want)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(all_docs.repartition(2)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("text is null")).collect()[0].taken == 0


def test_resample(docs):
    out = mixing.resample(docs)
    assert out.columns == docs.columns
    assert max(Counter(r.doc_id for r in out.collect()).values()) <= 9


def test_sentencepiece_equals_the_library(spark, docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    real = [t for _, t, _ in licenses.TEMPLATES] + ["naïve café — “quoted” 日本語のテキスト 12,345.67 don't  stop\r\n\tdef f(x):\n        return x**2  # done", "ab" * 400, "  lead and trail  ", "\n\n \n"]
    all_docs = docs.select("doc_id", "text", "row", "word").union(spark.createDataFrame([(200 + i, t, 1, "w") for i, t in enumerate(real)], "doc_id long, text string, row long, word string"))
    pieces = sentencepieces.Pieces()
    got = Counter((r.doc_id, tuple(r.ids)) for r in sentencepieces.assembled(sentencepieces.encode(all_docs, pieces)).collect())
    assert got == Counter({(r.doc_id, tuple(lib.encode(r.text))) for r in all_docs.collect() if r.text})
    counts = sentencepieces.token_counts(all_docs, pieces).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in counts) == Counter((r.doc_id, len(lib.encode(r.text or ""))) for r in all_docs.collect()) and all(r.decoded for r in counts)
    back = sentencepieces.decode(sentencepieces.assembled(sentencepieces.encode(all_docs, pieces)), ["doc_id", "tag", "more"], pieces).collect()
    assert Counter((r.doc_id, r.text[1:]) for r in back) == Counter({(r.doc_id, r.text) for r in all_docs.collect() if r.text})
    assert sentencepieces.token_counts(empty, pieces).count() == 0


def test_long_words_equal_the_library(spark):
    """Words on both sides of the bit mask's limit, of letters, marks, digits and characters without a piece."""
    import random

    import sentencepiece

    lib, rng = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL), random.Random(4)
    pool = ["abcdefghilmnorstu", "the", "éèñßü", "0123456789", "日本語テ", "\U0001f600\u0378", "=-_/+.", "tion", "aa"]
    texts = ["".join(rng.choice(rng.choice(pool)) if rng.random() < 0.7 else rng.choice(pool) for _ in range(rng.choice((40, 58, 59, 60, 61, 62, 255, 256, 257, 700)))) for _ in range(120)]
    texts += ["a" * n for n in (59, 60, 61, 256, 5000)] + ["x" * 100_000, "日" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: list(r.ids) for r in sentencepieces.assembled(sentencepieces.encode(df)).collect()}
    assert got == {i: lib.encode(t) for i, t in enumerate(texts)}
    counts = {r.doc_id: (r.n_tokens, r.decoded) for r in sentencepieces.token_counts(df).collect()}
    assert counts == {i: (len(lib.encode(t)), True) for i, t in enumerate(texts)}


@pytest.mark.parametrize("in_hand", [24 << 20, 2_000])
def test_whole_texts_are_encoded_and_decoded(spark, docs, tmp_path, monkeypatch, in_hand):
    """op2 returns each text's ids, its digests are of them, with most words in hand or looked up; the space sign in a text is a space."""
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "BROADCAST_BYTES", in_hand)
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    signs = [(300 + i, t) for i, t in enumerate(["\u2581 a", "a\u2581\u2581  b", "\u2581\u2581\u2581 b", " \u2581", "=" * 80 + " x " + "=" * 80])]
    docs.select("doc_id", "text").union(spark.createDataFrame(signs, "doc_id long, text string")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = Counter((r.doc_id, tuple(lib.encode(r.text or "")), "\u2581" not in (r.text or "")) for r in rows.collect())
    out = sentencepieces.op2_sentencepiece(spark, str(tmp_path))
    got = out.withColumn("same", F.col("ids_hash") == F.xxhash64("ids")).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert all(r.same and r.n_tokens == len(r.ids) for r in got)
    texts = sentencepieces.encode_texts(rows).collect()
    assert Counter((r.doc_id, r.text) for r in texts) == Counter((r.doc_id, (r.text or "").replace("\u2581", " ")) for r in rows.collect())


def coded_batch(texts):
    import pyarrow as pa

    texts = ["".join(words) for words in texts]

    n = len(texts)
    columns = [pa.array(range(n), pa.int64()), pa.array([False] * n), pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(texts, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "none", "tag", "more", "spaced"])


def in_hand_words(*words):
    from types import SimpleNamespace

    import pyarrow as pa

    lens = np.arange(1, len(words) + 1)
    return SimpleNamespace(value=(pa.array(words), np.cumsum(lens) - lens, lens, np.arange(lens.sum(), dtype=np.int32)))


@pytest.mark.parametrize("most", [1, 7, 1 << 30])
def test_texts_are_coded_alike_in_slices_of_any_size(monkeypatch, most):
    import pyarrow as pa

    texts = [[], [" a", " x", " b", " x", " y"], [" y"] * 9, [], [" a"], [" " + "z" * 61, " b", " " + "é" * 40], [" " + "é" * 61, " x"], [], []]
    monkeypatch.setattr(sentencepieces, "BATCH_BYTES", most)
    top, n_ids, marks = in_hand_words(" a", " b"), 3, ","
    far = pa.Table.from_batches(sentencepieces._coded(top, n_ids, marks, True)(iter([coded_batch(texts), coded_batch([[]])]))).to_pylist()
    digest = {w: "\n" + hashlib.md5(w.encode()).hexdigest() for w in (" " + "z" * 61, " " + "é" * 61)}
    away = [list(dict.fromkeys(digest.get(w, w) for w in ws if w not in (" a", " b"))) for ws in texts]
    assert [(r["id"], r["j"], r["key"]) for r in far] == [(i, j, w) for i, ws in enumerate(away) for j, w in enumerate(ws)]
    near = pa.Table.from_batches(sentencepieces._coded(top, n_ids, marks, False)(iter([coded_batch(texts)]))).to_pylist()
    ids = {" a": [0], " b": [1, 2]}
    want = [[x for w in ws for x in ids.get(w) or [n_ids + away[i].index(digest.get(w, w))]] for i, ws in enumerate(texts)]
    got = [np.frombuffer(pa.decompress(r["symbols"], 4 * r["n"], "zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel().tolist() if r["n"] else [] for r in near]
    assert got == want and [r["n_parts"] for r in near] == [len(ws) for ws in texts]
    # put together again, in slices of the same size: every word that was away gets its ids
    monkeypatch.setattr(sentencepieces, "BATCH_SYMBOLS", most)
    items = pa.array([[{"j": j, "ids": [1] * (j + 1)} for j in range(len(ws))] or None for ws in away], pa.list_(pa.struct([("j", pa.int32()), ("ids", pa.list_(pa.int32()))])))
    columns = [pa.array([r[c] for r in near], t) for c, t in (("id", pa.int64()), ("n_parts", pa.int64()), ("n", pa.int64()), ("symbols", pa.binary()))]
    whole = pa.Table.from_batches(sentencepieces._assembled([b"p", b"q", b"r"], 1)(iter([pa.RecordBatch.from_arrays([*columns, items], names=["id", "n_parts", "n", "symbols", "away"])]))).to_pylist()
    full = [[y for x in xs for y in ([x] if x < n_ids else [1] * (x - n_ids + 1))] for xs in want]
    assert [r["ids"] for r in whole] == full and [r["octets"] for r in whole] == [bytes(b"pqr"[y] for y in ys) for ys in full]


@pytest.mark.parametrize("far", [True, False])
def test_memory_of_coding_does_not_grow_with_a_batch(far):
    import tracemalloc

    batch = coded_batch([[" a", " b", " c", " b"] * 500] * 2_000)
    tracemalloc.start()
    try:
        for out in sentencepieces._coded(in_hand_words(" a", " b"), 3, ",", far)(iter([batch])):
            assert out.num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 80 << 20, most


@pytest.mark.parametrize("most", [1, 50, 1 << 21])
def test_words_are_cut_in_bytes_as_by_the_pattern(spark, monkeypatch, most):
    import random

    import pyarrow as pa

    monkeypatch.setattr(sentencepieces, "BATCH_BYTES", most)
    pieces, rng = sentencepieces.Pieces(), random.Random(5)
    pool = [*sentencepieces.PUNCTUATION, *" \u2581\n\n  \r\t\xa0\x00", *"abZé日\U0001f600\u0301\ue096\u2580\u2582", "word", "don't", "caf\u00e9,", "e.g."]
    texts = ["", " ", "\n", "\u2581", "a", *[t for t in TEXTS if t], *["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(600)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select(sentencepieces.segments(F.col("text"), pieces).alias("words"), sentencepieces._spaced(F.col("text")).alias("spaced")).collect()
    got = []
    for _, n, words, counts in sentencepieces._cut_batch(pa.array(["cut off", *[r.spaced for r in rows]]).slice(1), pieces.marks):
        ends = np.cumsum(counts)
        got += [words[e - k : e].to_pylist() for e, k in zip(ends.tolist(), counts.tolist())]
        assert len(counts) == n and ends[-1] == len(words)
    assert got == [r.words for r in rows]
    counted = {r.word: r.n_rows for r in sentencepieces._counted(df, pieces, "text").df.collect()}
    assert counted == Counter(w for ws in got for w in ws)


def test_texts_that_are_no_utf8(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    df = spark.sql("select * from values (1L, cast(X'61FF2062' as string)), (2L, 'ab') as t(doc_id, text)")
    got = {r.doc_id: (list(r.ids), r.decoded) for r in sentencepieces.encode_texts(df).collect()}
    assert got == {1: (lib.encode("a\ufffd b"), False), 2: (lib.encode("ab"), True)}


def test_texts_without_ids_stay_apart(spark):
    df = spark.range(200_000).selectExpr("cast(null as long) as doc_id", "concat('t', id) as text")
    keyed = sentencepieces._texts(df, "doc_id", "text")
    assert keyed.select("tag", "more").distinct().count() == 200_000


def test_viterbi_fold(spark):
    """A small unigram table: the fold finds the path of greatest score."""
    pieces = sentencepieces.Pieces()
    pieces.rows, pieces.viterbi, pieces.longest = [(p, i, s) for i, (p, s) in enumerate([("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.1), ("▁ab", -4.4), ("ba", -1.0), ("▁a", -2.2)], 300)], True, 3
    words = [" ab", " aba", " abab", " bbaab"]
    table = {p: (i, s) for p, i, s in pieces.rows}

    def best(w):
        ways = {0: (0.0, [])}
        for e in range(1, len(w) + 1):
            ways[e] = max((ways[s][0] + table[w[s:e]][1], [*ways[s][1], table[w[s:e]][0]]) for s in range(max(0, e - 3), e) if w[s:e] in table and s in ways)
        return ways[len(w)][1]

    got = {r.word: list(r.ids) for r in sentencepieces.encode_words(spark.createDataFrame([(w, 1) for w in words], "word string, n_rows long"), pieces).collect()}
    assert got == {w: best(w.replace(" ", "▁")) for w in words}


def test_licenses_against_exhaustive_alignment():
    """Every template verbatim, with one word substituted and with one inserted: found where an alignment at any offset is."""
    index = licenses.Index()
    for text in ("Released under the terms of the MIT License.", "Released under the permissive MIT License.", "Released under an MIT License."):
        assert [m[0] for m in licenses.scan(text, index)] == ["MIT"]
    for t, ids in enumerate(index.ids):
        words = re.findall("[a-z0-9]+", licenses.TEMPLATES[t][1].lower())
        edits = [words]
        for p in range(0, len(words), 1 if len(words) < 20 else 9):
            edits += [words[:p] + ["zzz"] + words[p + 1 :], words[:p] + ["zzz"] + words[p:], words[:p] + ["zzz"] * 5 + words[p:]]
        for e in edits if len(words) < 40 else edits[::17]:
            doc = ["x", "y", *e, "z"]
            codes = np.array([index.words.get(w, 0) for w in doc])
            best = max(licenses.align(ids, codes, offset, index.decides[t])[0] for offset in range(-licenses.BAND, len(doc) if len(words) < 40 else 3 * licenses.BAND))
            found = licenses.scan(" ".join(doc), index)
            assert (best >= licenses.LEAST_COVERAGE * len(ids)) <= any(m[3] >= best for m in found), (words, e)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("CC BY 4.0", []), ("Licensed under CC BY-NC 9.0.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is licensed under the GNU General Public License, version 7.", []),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]), ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", ["CC-BY-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]), ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", []),
        (licenses._BSD + licenses._AS_IS, ["BSD-2-Clause"]), (licenses._BSD + licenses._NAMES + licenses._AS_IS, ["BSD-3-Clause"]), ("the general public license of version", []),
    ],
)
def test_licenses_that_differ_in_a_word(text, names):
    assert [m[0] for m in licenses.scan("Foreword. " + text + " Afterword.", licenses.Index())] == names


def test_licenses(spark, docs, empty):
    apache = max((t for n, t, _ in licenses.TEMPLATES if n == "Apache-2.0"), key=len)
    words = apache.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 12)
    df = spark.createDataFrame([(1, "é x " + apache + " tail"), (2, changed), (3, " ".join(words[:20])), (4, "LICENSED under the apache license, version 2.0"), (5, "under the License you may"), (6, "Released under the MIT License.\n" * 3)], "doc_id long, text string")
    got = licenses.matches(df.withColumn("start", F.lit(1))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.license for r in by[1]] == ["Apache-2.0"] and by[1][0].coverage == 1 and by[1][0].start == 4
    assert ("é x " + apache + " tail")[by[1][0].start : by[1][0].end] == apache.rstrip(".")
    assert by[2][0].license == "Apache-2.0" and 0.85 < by[2][0].coverage < 1
    assert [r.license for r in by[4]] == ["Apache-2.0"] and not by[5] and len(by[6]) == 3 and all(r.matched_words < 30 for r in by[3])
    assert [r.doc_id for r in licenses.matches(docs).collect()] == [13] and licenses.matches(empty).count() == 0
