from __future__ import annotations

import random
import time
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import html_text, licences, pieces, quality, vectors
from weft.llm.trees import BoostedTrees

sentencepiece = pytest.importorskip("sentencepiece")


# Quality


def labelled(n=400):
    r = random.Random(4)
    good = ["the", "of", "house", "and", "river", "stone", "small", "for", "that", "green"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(good) for _ in range(r.randint(20, 90))]
        bad = i % 3 == 0
        docs.append((i, " ".join(x + "***" for x in w) if bad else ". ".join(w)))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_classifier_learns_and_holds_out(spark):
    docs, labels = labelled()
    extra = [(9000, None), (9001, ""), (9002, "x " * 50_000), (None, "a b")]
    d = spark.createDataFrame([*docs, *extra], "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(d, lab)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, net).collect()}
    assert len(got) == len(docs) + len(extra) and all(0 <= s <= 1 for s in got.values())
    test = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(q) for i, q in test]) > 0.95
    kept = quality.keep(d, net)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}
    held = d.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).where("doc_id is not null").collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)


def test_classifier_without_labels(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    net = quality.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert 0 <= quality.score(d, net).first()["score"] <= 1
    assert quality.score(d.limit(0), net).count() == 0


def test_whole_text_is_read():
    net = quality.Network()
    assert net.score("a" * 70_000 + "zqzqzq") != net.score("a" * 70_006)


def test_gradient():
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text = "some text, long enough to have more than two halves. " * 8
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    net._backward(text, 1, 1.0, grad)
    loss = lambda: -np.log(net.score(text))
    r = np.random.default_rng(0)
    for k, v in net.p.items():
        at = tuple(r.integers(0, s) for s in v.shape) if k != "embed" else (ord("t"), 1)
        old, eps = v[at], 1e-5
        v[at] = old + eps
        up = loss()
        v[at] = old - eps
        down = loss()
        v[at] = old
        assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-3 * max(1, abs(grad[k][at])), k


# SentencePiece


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b   c\n\n x ", "Hello  world\n\tñ   foo ", "日本語 テスト 🎉🎉", "a" * 50, " " * 70, "if (a==b) {\n        return 1;\n}", "-" * 33, "\x00\x01"])
def test_pieces_are_the_librarys(text):
    m, lib = pieces.model(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = m.encode_batch([text])[0].tolist()
    assert ids == lib.encode(text) and m.decode(ids) == text


def test_pieces_of_random_words():
    r = random.Random(1)
    m, lib = pieces.model(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [" ".join("".join(r.choice("aeionrstldäöé.,-'") for _ in range(r.randint(1, 14))) for _ in range(60)) for _ in range(60)]
    assert [x.tolist() for x in m.encode_batch(texts)] == lib.encode(texts)


@pytest.mark.parametrize("text", ["▁", "a▁b", "▁x ▁▁", " ▁"])
def test_own_marks_survive(text):
    m = pieces.model(pieces.MODEL)
    assert m.decode(m.encode_batch([text])[0].tolist()) == text


def test_pieces_table(spark, corpus):
    named = corpus.withColumn("ids", F.lit("clash"))
    coded = pieces.encode(named)
    back = pieces.decode(coded)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in corpus.collect()), key=str)
    trip = pieces.round_trip(named, with_ids=True).collect()
    assert sorted((str(r["doc_id"]), r["n_pieces"], r["decoded_chars"]) for r in trip) == sorted((str(r["doc_id"]), len(r["ids"]), len(t["text"])) for r, t in [(r, {"text": pieces.model(pieces.MODEL).decode(r["ids"])}) for r in trip])
    assert pieces.encode(named.limit(0)).count() == 0


def _as_unigram(folder):
    """The public model's pieces and scores as a model of the unigram kind, for which the best path is that of the greatest sum."""
    raw = bytearray(open(pieces.MODEL, "rb").read())

    def fields(i, end):
        def varint(i):
            x = shift = 0
            while raw[i] > 127:
                x, shift, i = x | (raw[i] & 127) << shift, shift + 7, i + 1
            return x | raw[i] << shift, i + 1

        while i < end:
            tag, i = varint(i)
            if tag & 7 == 2:
                n, i = varint(i)
            else:
                n = varint(i)[1] - i if tag & 7 == 0 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, i, i + n
            i += n

    kind = next(a for number, lo, hi in fields(0, len(raw)) if number == 2 for n, a, _ in fields(lo, hi) if n == 3)
    raw[kind] = pieces.UNIGRAM
    path = folder / "unigram.model"
    path.write_bytes(raw)
    return str(path)


def test_unigram_paths_are_the_best(tmp_path):
    path = _as_unigram(tmp_path)
    m, lib = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert m.kind == pieces.UNIGRAM
    r = random.Random(4)
    words = {"".join(r.choice("aeionrstlhdä.,-'") for _ in range(r.randint(1, 12))) for _ in range(800)}
    total = lambda parts: sum(m.scores[m.ids[p]] for p in parts)
    for word, parts in m.segment([pieces.MARK + w for w in words]):
        best = lib.nbest_encode_as_pieces(word[1:], 2)[0]
        assert "".join(parts) == word and total(parts) == total(best), word
    # The same sums are not what merging by rank gives, which is why the state of such models is another.
    bpe = pieces.model(pieces.MODEL)
    assert sum(bpe.merged(w) != parts for w, parts in m.segment([pieces.MARK + w for w in words])) > 0.2 * len(words)


@pytest.mark.parametrize("text", [" " * 300_000, "a" * 300_000, "  " + "ab" * 150_000, "x" + " " * 50_000 + "y"])
def test_long_runs_are_the_librarys(text):
    m, lib = pieces.model(pieces.MODEL), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    start = time.time()
    assert m.encode_batch([text])[0].tolist() == lib.encode(text)
    assert time.time() - start < 20


# HTML


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><nav><a href=x>Home</a><a href=y>News</a></nav><article><h1>Title &amp; all</h1><p><b>First  one.<br><p>Second\n two. More words are here, and more.</p></article><div class='ad'>Buy this now.</div><footer>&copy; x</footer></body></html>", "Title & all\nFirst one.\nSecond two. More words are here, and more."),
        ("<body><article><p>Cut off text of some length, with a sentence. And &quo", "Cut off text of some length, with a sentence. And &quo"),
        ("<article><p>It is a text. With words, in sentences.</p><script>var a='<p>no</p>'</script><style>p{}</style></article><div class=comments><p>Nice post!</p></div>", "It is a text. With words, in sentences."),
    ],
)
def test_main_text(page, text):
    assert html_text.extract([page], html_text.fitted()) == [text]


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<p><button>" + "<div>" * 100_000, "<ul><li>" + "<div><li>" * 50_000, "<b>" * 100_000 + "</i>" * 100_000])
def test_deep_pages(page):
    start = time.time()
    root = html_text.parse(page + "text")
    assert len(html_text._listed(root)) <= 100_010
    assert time.time() - start < 20


_SAID = "It is a long paragraph with several words in it, and it goes on for a while. Then there is more."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article><div class='comment-policy'><p>Our essay is about policies. {_SAID}</p><p>{_SAID}</p></div></article>", f"Our essay is about policies. {_SAID}\n{_SAID}"),
        (f"<body><div class='c7'><p>{_SAID}</p></div><div class='c7'><p>Second. {_SAID}</p></div></body>", f"{_SAID}\nSecond. {_SAID}"),
        (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number. {_SAID}</p></article>", f"Let x=2 be a number. {_SAID}"),
        (f"<article><p>See <svg><title>no</title><text>A to B</text></svg> here. {_SAID}</p></article>", f"See A to B here. {_SAID}"),
        (f"<article><h1>T</h1><p>{_SAID}</p><div class='comments'><p>Nice post, thanks.</p><p>Me too!</p></div></article>", f"T\n{_SAID}"),
    ],
)
def test_misleading_names_and_plain_pages(page, text):
    assert html_text.extract([page], html_text.fitted()) == [text]


def test_rare_tokens_hardly_move():
    w = html_text.token_weights([[[1], [1], [2]]] * 50 + [[[3]]], [np.array([1.0, 1.0, 0.0])] * 50 + [np.array([1.0])])
    assert w[1] > 2 > w[3] > 0 > -2 > w[2] and w[4] == 0


def test_pages_of_other_seeds():
    w, model, wrong, total = html_text._Writer(77), html_text.fitted(), 0, 0
    for _ in range(60):
        page, mark = w.page()
        nodes = html_text._listed(html_text.parse(page))
        kept = html_text.decode(nodes, model.logits([nodes]))
        assert all(id(n.parent) in kept for n in nodes if id(n) in kept and n.parent)
        wrong += sum((id(n) in kept) != (i == 0 or mark in n.attributes) for i, n in enumerate(nodes))
        total += len(nodes)
    assert wrong / total < 0.03


def test_pages_table(spark):
    rows = [(1, "u", "<p>A text, with a sentence. And more of it here.</p>", "x"), (None, None, None, "y"), (1, "u", "<p>A text, with a sentence. And more of it here.</p>", "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.main_text(d)
    assert out.columns == ["page_id", "url", "text"] and out.count() == 3
    assert html_text.main_text(d.limit(0)).count() == 0


def test_trees_fit_a_rule():
    x = np.random.default_rng(0).random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = BoostedTrees(20).fit(x, y)
    assert ((m.logits(x) > 0) == y).mean() > 0.97


# Licences


def test_licences(spark):
    rows = [(1, "Some text.\nReleased under the MIT License.\nmore"), (2, "licensed UNDER the apache license, version 2.0"), (3, "The driver lost his license."), (4, None), (5, ""), (None, "All rights reserved."), (6, "All rights reserved."), (6, "All rights reserved."), (7, "Licensed under CC BY-NC 4.0. " + "und der die das " * 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(d).collect()), key=str)
    assert got == sorted([(1, 1, "mit"), (2, 0, "apache-2.0"), (None, 0, "all-rights-reserved"), (6, 0, "all-rights-reserved"), (7, 0, "cc-by-nc")], key=str)
    assert licences.scan(d.limit(0)).count() == 0


@pytest.mark.parametrize("width", [30, 60, 75])
def test_wrapped_notices(spark, width):
    heads = [(f, t) for f, t in licences.NOTICES if t.split()[0] in ("Permission", "Redistribution") or t.startswith("This program is free")]
    assert {f for f, _ in heads} == {"mit", "isc", "gpl-3.0", "bsd"}
    rows = [(i, "Some text before.\n\n" + "\n".join(" * " + x for x in textwrap.wrap(t, width)) + "\n\nText after it.") for i, (_, t) in enumerate(heads)]
    rows.append((9, rows[0][1] + "\n" + rows[3][1] + "\n" + rows[0][1]))
    got = [(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x[0] < 9) == [(i, 2, f) for i, (f, _) in enumerate(heads)]
    assert sorted(f for i, _, f in got if i == 9) == sorted([heads[0][0], heads[0][0], heads[3][0]])


def test_licence_columns_match_the_model(spark):
    m = licences.fitted()
    texts = [t for _, t in licences.NOTICES] + [f"foo {t} bar baz" for _, t in licences.NOTICES]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licences.scan(d).collect():
        p = m.probabilities(texts[r["doc_id"]])
        assert abs(p[r["family"]] - r["probability"]) < 1e-5 and p[r["family"]] == max(p.values())


def test_anchors_are_in_every_paragraph_that_can_count():
    r = random.Random(0)
    anchors = licences.fitted().anchors
    for _, t in licences.NOTICES:
        pairs = licences._pairs(t)
        hit = [p for p in pairs if any(a in p if " " in a else a in p.split() for a in anchors)]
        assert len(pairs) - len(hit) < licences.OVERLAP * len(pairs)
        assert r


# Vectors


def test_vectors_match_brute_force(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(300, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    for i in range(150):
        v = base[i % 20] + r.normal(size=16) * 0.2
        rows.append((1000 + i, [float(x) for x in v]))
    rows += [(2000 + i, rows[3][1]) for i in range(30)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] + [1.0] * 15), (3003, [None] + [1.0] * 15), (3004, [float("inf")] * 16), (3005, []), (3006, [1.0, 2.0]), (3008, [1.0, 2.1]), (3007, [2 * x for x in rows[3][1]])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {x["vec_id"]: x for x in vectors.near_duplicates(d).collect()}
    assert len(got) == len(rows)
    ok = {i: np.array(v) for i, v in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = list(ok)
    u = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = u @ u.T >= 0.9
    true = {i: int(s[k].sum()) - 1 for k, i in enumerate(ids)}
    found = sum(min(got[i]["n_links"], true[i]) for i in ids)
    assert found >= 0.95 * sum(true.values())
    assert all(got[i]["n_links"] <= true[i] for i in ids)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in rows if i not in ok and i not in (3006, 3008))
    assert got[3006]["n_links"] == got[3008]["n_links"] == 1 and got[3008]["component_id"] == 3006  # of a length of their own
    assert all(got[i]["component_id"] == got[3]["component_id"] and got[i]["n_links"] == got[3]["n_links"] for i in range(2000, 2030))
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.values())


def _many(r, n, groups, size, spread):
    base = r.normal(size=(n, 32))
    near = [base[k] + r.normal(size=(size, 32)) * spread for k in range(groups)]
    return np.concatenate((base, *near))


@pytest.mark.parametrize(("shard", "most"), [(1500, 4500), (300, 500)])
def test_vectors_in_many_shards(spark, shard, most):
    """Overlapping shards, shards that are split, and a group of near copies larger than a shard may be, against brute force."""
    v = np.concatenate((_many(np.random.default_rng(3), 8000, 60, 30, 0.25), _many(np.random.default_rng(4), 1, 1, 1200, 0.15)))
    assert len(v) > 11_000
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(6)
    got = vectors.near_duplicates(d, shard=shard, most=most).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    true, root = np.zeros(len(v), np.int64), np.arange(len(v))
    for i in range(0, len(v), 1000):
        true[i : i + 1000] = (u[i : i + 1000] @ u.T >= 0.9).sum(axis=1) - 1
    n = np.zeros(len(v), np.int64)
    for x in got:
        n[x["vec_id"]], root[x["vec_id"]] = x["n_links"], x["component_id"]
    assert (n <= true).all() and n.sum() >= 0.98 * true.sum() > 500_000
    assert got[0]["audited_recall"] >= 0.95 and got[0]["audited_links"] > 100
    assert len(set(root[-1200:].tolist())) <= 3  # the large group is one component but for its outliers


def test_a_bad_index_falls_back_to_all_pairs(spark, monkeypatch):
    v = _many(np.random.default_rng(5), 300, 10, 20, 0.2)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    true = ((lambda u: u @ u.T >= 0.9)(v / np.linalg.norm(v, axis=1, keepdims=True))).sum(axis=1) - 1
    monkeypatch.setattr(vectors, "audit", lambda rows, found, threshold: (0, 1))
    got = {x["vec_id"]: x["n_links"] for x in vectors.near_duplicates(d, most=100).collect()}
    assert [got[i] for i in range(len(v))] == true.tolist()


def test_forest():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 200, 120), r.integers(0, 200, 120)
    label = vectors.forest(200, iter([(a[:60], b[:60]), (a[60:], b[60:])]))
    least = list(range(200))
    for _ in range(200):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            least[x] = least[y] = min(least[x], least[y])
    assert label.tolist() == least


def test_vectors_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_score_is_that_of_plain_loops():
    n = quality.Network(3)
    p = {k: v.astype(float) for k, v in n.p.items()}
    for text in ("", "a", "Some words, and äöü 漢字. " * 9, "x" * 700):
        raw = list(text.encode())
        size = max(2, -(-len(raw) // quality.HALF)) * quality.HALF
        raw += [256] * (size + quality.WIDTH - 1 - len(raw))
        response = [[sum(p["embed"][raw[i + k]][e] * p["filters"][k * quality.EMBED + e][f] for k in range(quality.WIDTH) for e in range(quality.EMBED)) for f in range(quality.FILTERS)] for i in range(size)]
        chunks = [[max(response[j][f] for j in range(at, at + 2 * quality.HALF)) for f in range(quality.FILTERS)] for at in range(0, size - quality.HALF, quality.HALF)]
        hidden = [[np.tanh(sum(c[f] * p["hidden"][f][h] for f in range(quality.FILTERS)) + p["hidden0"][h]) for h in range(quality.HIDDEN)] for c in chunks]
        means = [sum(x[h] for x in hidden) / len(hidden) for h in range(quality.HIDDEN)]
        tops = [max(x[h] for x in hidden) for h in range(quality.HIDDEN)]
        z = sum(v * w for v, w in zip(means + tops, p["out"], strict=True)) + p["out0"][0]
        assert abs(n.score(text) - 1 / (1 + np.exp(-z))) < 1e-4


def _found_by_loops(text, model):
    """(part, family) of the parts and runs that declare a licence, by trying all of them."""
    parts = [licences._words(x) for x in text.split("\n")]
    notices = [(f, licences._pairs(t)) for f, t in licences.NOTICES]
    seen = []
    for i, first in enumerate(parts):
        for j in range(i, len(parts)):
            between = sum(map(len, parts[i + 1 : j]))
            if not parts[j] or not first or between > licences.WRAPPED:
                break
            w = first if i == j else [*first[-licences.WRAPPED :], *[x for y in parts[i + 1 : j] for x in y], *parts[j][: licences.WRAPPED]]
            p = model.probabilities(" ".join(w))
            family = max(p, key=lambda k: (p[k], k))
            pairs = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
            overlap = max((len(q & pairs) / len(q) for f, q in notices if f == family), default=0)
            if family != licences.UNKNOWN and p[family] >= 0.5 and overlap >= licences.OVERLAP - 1e-9:
                seen.append((i, j, family, round(overlap, 6)))
    alone = {(i, f) for i, j, f, _ in seen if i == j}
    out = set()
    for i, j, f, o in seen:
        inside = [x for x in seen if x[2] == f and x[:2] != (i, j) and i <= x[0] and x[1] <= j and (x[0] == x[1] or x[3] >= o)]
        if i == j or not inside:
            out.add((i, j, f, o))
    rank = lambda x: (x[0] == x[1], x[3], x[0] - x[1], -x[0])
    meets = lambda x, y: x[2] == y[2] and y[0] <= x[1] and x[0] <= y[1]
    kept = {x for x in out if x[0] == x[1] or not any(meets(x, y) and rank(y) > rank(x) for y in out)}
    assert {(i, f) for i, j, f, _ in kept if i == j} == alone
    return sorted((i, f) for i, _, f, _ in kept)


def test_licences_are_those_of_plain_loops(spark):
    r = random.Random(13)
    filler = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 8))) for _ in range(80)]
    say = lambda n: " ".join(r.choice(filler) for _ in range(n))
    texts = []
    for k in range(40):
        lines = []
        for _ in range(r.randint(1, 4)):
            notice = r.choice(licences.NOTICES)[1].split()
            if r.random() < 0.4:
                notice = [w for w in notice if r.random() > 0.2]
            width = r.choice((3, 6, 12, 99))
            lines += [say(r.randint(0, 6)), *[" ".join(notice[i : i + width]) for i in range(0, len(notice), width)], r.choice(("", say(5), r.choice(licences.OTHERS)))]
        texts.append("\n".join(lines))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for x in licences.scan(d).collect():
        got.setdefault(x["doc_id"], []).append((x["paragraph"], x["family"]))
    m = licences.fitted()
    for k, t in enumerate(texts):
        assert sorted(got.get(k, [])) == _found_by_loops(t, m), t


def test_licences_in_long_texts(spark):
    """100,000 short lines around a notice and a wrapped one, a text of 20,000 words in a line, 3,000 notices below each other."""
    lines = ["a b"] * 50_000 + ["Released under the MIT License."] + ["a b"] * 50_000
    lines[20_000:20_000] = ["This program is licensed under the", "GNU General Public License, version 2."]
    rows = [(1, "\n".join(lines)), (2, "word " * 20_000 + "\nLicensed under the MIT License."), (3, "\n".join(["Licensed under the MIT License.", "All rights reserved."] * 1500))]
    got = {}
    for x in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x["doc_id"], []).append((x["paragraph"], x["family"]))
    assert sorted(got[1]) == [(20_000, "gpl-2.0"), (50_002, "mit")] and got[2] == [(1, "mit")]
    assert sorted(got[3]) == [(i, ("mit", "all-rights-reserved")[i % 2]) for i in range(3000)]


def test_optional_tags_left_out():
    """Pages without </head>, or any of the tags that authors may leave out, give what the full page gives."""
    text = ["One title", "Some words that make a sentence of the article, and more of it.", "A second paragraph, that says some more than the first did."]
    r = random.Random(4)
    model = html_text.fitted()
    for _ in range(60):
        keep = lambda tag: tag if r.random() < 0.5 else ""
        head = f"{keep('<head>')}<meta charset=utf-8><title>t</title>{keep('</head>')}"
        page = f"{keep('<html>')}{head}{keep('<body>')}<nav><a href=/>Home</a></nav><article><h1>{text[0]}</h1><p>{text[1]}{keep('</p>')}<p>{text[2]}{keep('</p>')}</article>{keep('</body>')}{keep('</html>')}"
        assert html_text.extract([page], model) == ["\n".join(text)], page
