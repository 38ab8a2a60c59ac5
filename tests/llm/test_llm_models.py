"""Embeddings, chat, classifiers and the pipeline on small tables."""

import json
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import chat, common, embedding, quality_model, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_links(rows, least=0.95):
    """Rows (id, n_links, component, kept): a vector is an id with its components, an id's vectors are in one component."""
    ok = {}
    for i, v in rows:
        x = np.array(v if v is not None and None not in v else [], float)
        if i is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i, tuple(x)] = x / np.linalg.norm(x)
    keys = sorted(ok)
    root = {i: i for i, _ in rows if i is not None}
    n = dict.fromkeys(keys, 0)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            linked = len(ok[a]) == len(ok[b]) and float(ok[a] @ ok[b]) >= least
            n[a], n[b] = n[a] + linked, n[b] + linked
            if linked or a[0] == b[0]:
                x, y = sorted((root[a[0]], root[b[0]]))
                root = {k: x if v == y else v for k, v in root.items()}
    out = []
    for i, v in rows:
        links = n.get((i, tuple(map(float, v))), 0) if v is not None and None not in v else 0
        out.append((i, links, root.get(i), i is not None and root[i] == i))
    return Counter(out)


@pytest.mark.parametrize(("cell_rows", "least_cells", "block"), [(2000, 1, 4096), (2000, 16, 4096), (30, 1, 16)])
def test_embedding(spark, monkeypatch, cell_rows, least_cells, block):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + rng.normal(size=16) * (0.12 if i % 3 else 0.5)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[5][1]) for i in range(20)] + [(500, [2 * x for x in rows[5][1]]), (501, [0.0] * 16), (502, None), (503, [1.0, None] + [0.0] * 14), (504, [float("nan")] * 16), (505, [1.0, 2.0]), (506, []), (None, rows[0][1])]
    rows += [(510, [2.0, 4.0]), (511, [2.0, 4.1]), (512, [-1.0, 1.0]), (513, [1.0, 0.0, 0.0])]  # other lengths
    rows += [(400, rows[5][1]), (7, rows[7][1]), (520, rows[1][1]), (520, rows[2][1]), (520, rows[2][1]), (521, [7.0] * 16), (521, [-7.0] * 16), (522, [8.0] * 16)]  # repeated ids
    monkeypatch.setattr(embedding, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embedding, "LEAST_CELLS", least_cells)
    monkeypatch.setattr(embedding, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, home int").repartition(4)
    got = embedding.near_duplicates(df).collect()
    assert Counter(map(tuple, got)) == brute_links(rows)
    assert embedding.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embedding.near_duplicates(df.where("vec_id = 501")).collect()] == [(501, 0, 501, True)]


def test_components(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)]
    edges = chain + [tuple(map(int, e)) for e in rng.integers(200, 400, (120, 2))] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b:
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_chat(spark):
    def calls(*items):
        return json.dumps({"tool_calls": list(items)})

    rows = [
        (1, 0, "user", 'hi "é"\n'), (1, 1, "assistant", calls({"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": {"x": "one"}, "depends_on": ["a"]})),
        (1, 2, "tool", json.dumps({"tool_results": [{"id": "a", "content": {"v": 3}}, {"id": "z", "content": "lost"}]})), (1, 3, "tool", json.dumps({"tool_results": [{"id": "a", "content": "again"}]})),
        (2, 0, "user", ""), (2, 1, "assistant", "ok"), (2, 2, "user", None), (3, 0, "assistant", "first"), (4, 0, "assistant", calls({"id": "p", "name": "nope", "arguments": None, "depends_on": ["q"]}, {"id": "q", "name": "add", "arguments": {"x": 1}})),
        (5, 0, "assistant", calls({"id": "m", "name": "add", "arguments": {"x": 1}, "depends_on": ["n"]}, {"id": "n", "name": "add", "arguments": {"x": 1}, "depends_on": ["m"]})), (None, None, "user", "no ids"), (2, 1, "assistant", "ok"), (6, 0, "user", '{"broken'),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")
    schemas = chat.SCHEMAS | {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}, "required": ["x"]}}
    got = {(r.conv_id, r.call_id): r for r in chat.link(*chat.extract(df), schemas).collect()}
    assert (got[1, "a"].status, got[1, "a"].n_results, got[1, "a"].faults) == ("linked", 2, "")
    assert got[1, "a"].json == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","result":"{\\"v\\":3}"}'
    assert (got[1, "b"].status, got[1, "b"].faults) == ("unanswered", "$.x: not integer") and got[1, "z"].status == "orphan"
    assert got[1, "0"].json == '{"arguments":{"text":"hi \\"é\\"\\n"},"id":"0","name":"reply"}' and got[1, "0"].status == "unanswered"
    assert (got[2, "0"].faults, got[2, "0"].n_results) == ("$.text: length", 2) and got[2, "2"].faults == "$.text: missing" and got[3, "-1"].status == "orphan"
    assert got[4, "p"].level == 1 and got[4, "q"].level == 0 and got[4, "p"].faults == "unknown tool"
    assert got[1, "b"].level == 1 and got[2, "2"].level == 1 and got[5, "m"].level is None
    assert "cyclic" in got[5, "m"].faults and "cyclic" in got[5, "n"].faults and got[6, "0"].status == "unanswered"
    assert chat.link(*chat.extract(df.limit(0))).count() == 0


def brute_levels(depends):
    """Longest chain before each call; None on a cycle or beyond one."""
    level, left = {}, dict(depends)
    while ready := [c for c, on in left.items() if not any(o in left for o in on)]:
        for c in ready:
            level[c] = max((level[o] + 1 for o in left[c] if o in level), default=0)
        left = {c: on for c, on in left.items() if c not in ready}
    return level | dict.fromkeys(left)


@pytest.mark.parametrize("task_edges", [100_000, 1])
def test_chat_levels(spark, monkeypatch, task_edges):
    """Random graphs, chains and cycles, in one task and in rounds."""
    monkeypatch.setattr(chat, "TASK_EDGES", task_edges)
    rng = np.random.default_rng(11)
    graphs = {1: {str(i): [str(i - 1)] if i else [] for i in range(40)}, 2: {"a": ["b"], "b": ["c"], "c": ["a"], "d": ["a", "x"], "x": [], "e": ["x"]}, 3: {"p": ["p"], "q": ["p", "nowhere"], "r": ["nowhere"]}}
    for g in range(4, 12):
        graphs[g] = {str(i): [str(j) for j in rng.choice(14, rng.integers(0, 3), replace=False) if g % 2 or j < i] for i in range(14)}
    rows = [(g, i, 0, c, on) for g, calls in graphs.items() for i, (c, on) in enumerate(calls.items())]
    calls = spark.createDataFrame(rows + [(None, 0, 0, "a", ["a"]), (1, 99, 0, None, ["1"])], "conv_id long, turn long, part int, call_id string, depends array<string>")
    got = {(r.conv_id, r.call_id): (r.level, r.cyclic) for r in chat.levels(calls).collect()}
    want = {(g, c): (n, n is None) for g, calls in graphs.items() for c, n in brute_levels({c: [o for o in on if o in calls] for c, on in calls.items()}).items()}
    assert got == want | {(None, "a"): (0, False), (1, None): (0, False)}


def test_chat_takes_any_text(spark):
    """Malformed, deep, huge and odd JSON in every field: a row each, no crash."""
    one = '{"tool_calls":[%s]}'
    odd = ['{"a":' * 100_000, "[" * 50_000, '{"tool_calls":' + "[" * 300 + "]" * 300 + "}", '{"tool_calls":5}', one % '5,null,"x",[]', '{"tool_calls":[]}', "{}", '{"tool_results":{"id":1}}', '{"tool_calls":[NaN]}', one % '{"id":1e999}']
    texts = [*odd, one % '{"id":5,"name":7,"arguments":[1],"depends_on":5}', one % '{"id":"\\ud800","name":"\\udfffx","arguments":{"\\ud801":"\\ud802"},"depends_on":{"\\ud803":1}}', one % ('{"id":"big","name":"add","arguments":{"x":%s}}' % ("9" * 400))]
    texts += [one % '{"id":"t","name":"add","arguments":"{\\"x\\":3}","depends_on":["t",null,5]}', one % '{"id":"f","type":"function","function":{"name":"add","arguments":"not json"}}', one % '{"id":null,"name":null}', '{"tool_results":[{"tool_call_id":5,"content":[1]},{"id":{"a":1}},7]}', one % ('{"id":"d","name":"add","arguments":%s}' % ("[" * 150 + "]" * 150)), "x" * 200_000]
    df = spark.createDataFrame([(9, i, "tool" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(9, None, None, None)], "conv_id long, turn long, role string, text string")
    schemas = chat.SCHEMAS | {"add": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0, "enum": [3, int("9" * 400)]}}, "required": ["x"], "additionalProperties": False}}
    rows = chat.link(*chat.extract(df), schemas).collect()
    got = {r.call_id: r for r in rows}
    assert (got["big"].faults, got["t"].faults, got["f"].faults, got["d"].faults) == ("", "cyclic", "$: not object", "$: not object") and got["5"].status == "linked" and got["5"].n_results == 1
    assert got["5"].faults == "unknown tool; cyclic" and "\\ud800" in got and json.loads(got["\\ud800"].json)["arguments"] == {"\ud801": "\ud802"} and got['{"a":1}'].status == "orphan"
    assert sum(r.call_id is None and r.status == "unanswered" for r in rows) == 1 and all(json.loads(r.json) for r in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["vileword", "meanterm", "rotstem"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, rng.integers(30, 90)))
        toxic, poor = i % 7 == 0, i % 5 == 0
        for _ in range(rng.integers(1, 5) if toxic else 0):
            words.insert(rng.integers(0, len(words)), str(rng.choice(bad)) + ("s" if rng.random() < 0.3 else ""))
        words = [w + "###" for w in words] if poor else words
        rows.append((i, (" ".join(words) + ".").capitalize(), "en", f"s{i % 4}", 0))
        if i % 2 == 0:
            labels.append((i, int(not poor), int(toxic)))
    rows += [(None, "no id", None, None, None), (5000, None, "en", None, None), (5001, "", "en", "s1", 0), (5002, "word " * 20_000, "en", "s1", 1), (3, rows[3][1], "en", "s3", 0)]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], DOCS + ", score double").repartition(4)
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 900 and r.kept == (r.doc_id % 7 == 0)]
    assert len(rows) == docs.count() and len(wrong) <= 5
    assert np.all(np.diff(model.cuts) > 0) and all(0 <= r.severity <= toxicity.GRADES for r in rows)
    assert {r.kept for r in rows if r.doc_id in (None, 5000, 5001)} == {True}
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(r.doc_id for r in rows if r.kept)
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("not kept").count() == 0 and toxicity.score(docs.limit(0), model).count() == 0


def test_severity_grows_with_toxic_words(corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels)
    s = [model.severity(np.array([model.eta(t)]))[0] for t in ("plain", "plain vileword", "plain vileword meanterm rotstem")]
    assert s[0] < s[1] < s[2]


def test_quality_model(corpus):
    docs, labels = corpus
    model = quality_model.fit(docs, labels)
    rows = quality_model.score(docs, model).collect()
    wrong = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 900 and r.kept == (r.doc_id % 5 == 0)]
    assert len(rows) == docs.count() and len(wrong) <= 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality_model.score(docs, quality_model.fit(docs, labels.limit(0))).where("not kept").count() == 0
    assert quality_model.score(docs.limit(0), model).count() == 0


def test_quality_rounds_look_at_every_row(spark, corpus):
    """Pseudo-labels and slopes over the unlabelled rows, against numpy on all of them at once; texts measured once score the same."""
    docs, labels = corpus
    found = []
    model = quality_model.fit(docs, labels, found=found)
    scales, seen = [(6.0, 0.1), (12.0, -0.1)], 0
    rows = found[0].collect()
    ids = [np.array([r[k] for r in rows], np.int64) for k in ("t", "p")]
    assert len(rows) == docs.count()
    for k, (n, sums) in enumerate(quality_model._taught(found[0], model.views, model.views, scales)):
        a, b = scales[1 - k]
        p = 1 / (1 + np.exp(-np.clip(a * model.views[1 - k].logit(ids[1 - k]) + b, -30, 30)))
        sure = (p >= quality_model.CONFIDENT) | (p <= 1 - quality_model.CONFIDENT)
        seen += n
        assert n == sure.sum() and np.allclose(sums, model.views[k].slopes(ids[k][sure], (p[sure] >= 0.5) * 1.0))
    assert seen > 0
    one, two = ({(r.doc_id, round(r.score, 6)) for r in df.collect()} for df in (quality_model.co_train(docs, labels), quality_model.score(docs, model)))
    assert one == two


def test_view_steps_down_the_true_slope():
    """Gradient and curvature of a view against finite differences of its loss."""
    rng = np.random.default_rng(5)
    x, buckets, y = rng.normal(size=(60, 2)), np.column_stack([rng.integers(0, 16, 60), 16 + rng.integers(0, 16, 60)]), (rng.random(60) < 0.4) * 1.0
    view = quality_model.View(x)
    ids, d = view.ids(x, buckets), view.size
    view.w = rng.normal(size=d) * 0.1

    def loss(w):
        z = w[ids].sum(1)
        return (np.logaddexp(0, z) - y * z).sum()

    sums, e = view.slopes(ids, y), 1e-4 * np.eye(d)
    assert np.allclose(sums[:d], [(loss(view.w + u) - loss(view.w - u)) / 2e-4 for u in e], atol=1e-5)
    assert np.allclose(sums[d:].reshape(d, d)[0, :3], [(loss(view.w + e[0] + u) - loss(view.w + e[0] - u) - loss(view.w - e[0] + u) + loss(view.w - e[0] - u)) / 4e-8 for u in e[:3]], atol=1e-3)


def test_grades_come_from_the_other_half(spark):
    """Marks of a half are made from its own rows: brute-force log odds of each word."""
    rows = [(i, int(i % 3 == 0), i % 2, f"plain{i % 5} " + ("vile" if i % 3 == 0 or i % 50 == 1 else "fair") + (" odd" if i % 6 == 0 else "")) for i in range(600)]
    names = {n: (a, b) for k, n, a, b in toxicity.vocabulary(spark.createDataFrame(rows, "doc_id long, y int, half int, text string")) if k == 0}

    def strong(word, half):
        pos, neg = ([r for r in rows if r[2] == half and r[1] == y] for y in (1, 0))
        p, q = (sum(word in r[3].split() for r in part) + 0.5 for part in (pos, neg))
        odds = np.log(p / (len(pos) + 1)) - np.log(q / (len(neg) + 1))
        return bool(odds >= toxicity.STRONG and abs(odds) / np.sqrt(1 / p + 1 / q) >= toxicity.LEAST_Z / 2)

    assert names and all(names[w] == (strong(w, 0), strong(w, 1)) for w in names) and any(names["vile"])
    assert "odd" not in names or names["odd"] == (strong("odd", 0), strong("odd", 1))


def test_ordinal_fit_orders_grades():
    """Held-out accuracy: the expected severity of unseen rows grows with their grade."""
    rng = np.random.default_rng(9)
    grades = rng.integers(0, toxicity.GRADES + 1, 2000)
    rows = [[j for j in range(30) if rng.random() < (0.05 + 0.2 * g if j < 15 else 0.2)] for g in grades]
    w, cuts = toxicity.fit_ordinal(rows[:1500], grades[:1500], 30)
    model = toxicity.Ordinal([], w, cuts, 1.0)
    s = model.severity(np.array([w[r].sum() if r else 0.0 for r in rows[1500:]]))
    means = [s[grades[1500:] == g].mean() for g in range(toxicity.GRADES + 1)]
    assert all(a + 0.3 < b for a, b in zip(means, means[1:])) and np.corrcoef(s, grades[1500:])[0, 1] > 0.8


def brute_near(rows, least=0.8):
    """id: smallest id reachable by pairs of 5-word shingle sets with Jaccard >= least; equal sets are alike."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root, ids = {i: i for i in sets}, sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if root[a] != root[b] and (x == y or (x and y and 10 * len(x & y) >= 8 * len(x | y))):
                low, high = sorted((root[a], root[b]))
                root = {n: low if v == high else v for n, v in root.items()}
    return root


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """Documents with near copies, personal data, nulls, repeated rows, and a column that clashes with inner names."""
    docs, labels = corpus
    path = tmp_path_factory.mktemp("corpus")
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id < 900}
    more = []
    for i in range(30):
        words = texts[i].split()
        more.append((2000 + i, " ".join(words[:-1] + ["changed"]) if i % 3 else texts[i], "en", f"s{i % 4}", 3, 0.5))
        more.append((3000 + i, f"{' '.join(reversed(texts[i + 40].split()))} mail a{i}@b.cc or 10.0.0.{i} now", "en", f"s{i % 4}", 3, 0.5))
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(str(path / "documents.parquet"))
    labels.write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_pipeline(spark, folder, tmp_path):
    """Each stage's whole output against a brute-force version on its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    from rowloom.llm import mixing, pii, sentencepieces

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, labels = now.columns, spark.read.parquet(f"{folder}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        rows, after = now.collect(), Counter(map(tuple, out.collect()))
        if name == "toxicity":
            model = toxicity.fit(now, labels)
            eta = [sum(model.weights[v[f]] for found, v in zip(toxicity.features(r.text), model.vocabulary) for f in found if f in v) for r in rows]
            severity = [sum(1 / (1 + np.exp(-(e - c))) for c in model.cuts) for e in eta]
            assert after == Counter(tuple(r) for r, s in zip(rows, severity) if s < model.reject) and len(rows) > sum(after.values()) > 500
            bad = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 7 == 0]
            assert sum(tuple(r) in after for r in bad) <= 3
        elif name == "simhash_near_dedup":
            roots = brute_near([(r.doc_id, r.text) for r in rows if r.doc_id is not None])
            want = {i for i, v in roots.items() if i == v}
            assert Counter(r[0] for r in after.elements()) == Counter([*want, *[None for r in rows if r.doc_id is None]]) and set(after) <= set(map(tuple, rows))
            assert len(want) <= len(roots) - 20
        elif name == "pii":
            model = pii.fit(now)
            spans = {r.doc_id: [(s.start, s.end, s.kind) for s in [*r.base, *r.added]] for r in pii.find(now, model).collect()}

            def redacted(text, found):
                for start, end, kind in sorted(_merged(sorted(found)), reverse=True):
                    text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
                return text

            want = Counter()
            for r in rows:
                text = None if r.text is None else redacted(r.text, spans[r.doc_id])
                want[(*[text if c == "text" else len(text) if c == "n_chars" and text is not None else r[c] for c in columns],)] += 1
            assert after == want and sum("[EMAIL]" in (r[1] or "") for r in after) >= 20
        elif name == "mixing":
            mixed = {(r.doc_id, r.size): r.taken for r in mixing.mix(now).collect()}
            for r in rows:
                size = len((r.text or "").split())
                if size:
                    assert after[tuple(r)] == int(mixed[r.doc_id, size] / size + 0.5), r.doc_id
            assert set(after) <= set(map(tuple, rows))
        else:
            want = Counter((r.doc_id, len(lib.encode(r.text or ""))) for r in rows)
            assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == want and out.where("not decoded").count() == 0
        assert name == "sentencepiece" or out.columns == columns
        now = out
    assert corpus_pipeline.run(spark, folder).count() == now.count()


def _merged(spans):
    """Overlapping spans as one, named after the first."""
    out = []
    for start, end, kind in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((start, end, kind))
    return out


def test_pipeline_stages_on_an_empty_table(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
