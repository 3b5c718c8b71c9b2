"""Spelling variants, whitening and language identification."""

import random
import zlib
from decimal import Decimal

import duckdb
import numpy as np
import pytest

import __spark_entry__
from quarry.llm import language_id, spelling, whitening

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, word string, n int, key string, h int, id string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", lang) for i, t, lang in rows], DOCS)


# Spelling variants.


def runs_of(text):
    run = ""
    for c in text + " ":
        if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
            run += c
        elif run:
            yield run
            run = ""


def spelled(rows):
    """The contract, word by word."""
    n = {}
    for i, text, _ in rows:
        for run in runs_of(text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    letters = set("".join(n))
    out = {}
    for w in n:
        edits = {w[:k] + w[k + 1 :] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + far :] for k in range(len(w) + 1) for c in letters for far in (0, 1)}
        near = [x for x in edits - {w} if x in n]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        out[w] = (best if near and n[best] >= 10 * n[w] else None, len(near))
    result = {}
    for w, (form, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        result[w] = (form, root, n[w], near, n[form] if form else None)
    return result


def rows_of_words(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 12))) for _ in range(60)] + ["zzzzzzzz", "zzzzzzzy", "zzzzzzy", "Zzzzzyy"]
    rows = []
    for i in range(300):
        words = [rng.choice(base[: rng.choice((3, 20, 64))]) for _ in range(rng.randint(0, 12))]
        words = [w.upper() if rng.random() < 0.2 else w[:3] + rng.choice("abé") + w[4:] if rng.random() < 0.3 else w for w in words]
        rows.append((i, rng.choice((" ", ", ", "\n", "9", "Ā")).join(words), None))
    return [*rows, (5, None, None), (6, "", None), (None, " ".join(["zzzzzzzz"] * 30 + ["×××÷÷÷÷"] * 2), None), (7, "a" * 300 + " " + "a" * 299 + " " + "a" * 300 + " " + "a" * 299, None), rows[3], rows[3]]


@pytest.mark.parametrize("large, listed", [(20_000, 10), (5, 10), (5, 0)])
def test_spelling_against_every_edit(spark, monkeypatch, large, listed):
    monkeypatch.setattr(spelling, "LARGE", large)
    monkeypatch.setattr(spelling, "LISTED", listed)
    rows = rows_of_words(1)
    got = spelling.spelling_groups(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = got.collect()
    expected = spelled(rows)
    assert len(found) == len(expected) and {r.word: tuple(r)[1:] for r in found} == expected
    assert sum(v[0] is not None for v in expected.values()) > 5 and max(v[3] for v in expected.values()) > 3


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(frame(spark, [])).count() == 0
    assert spelling.spelling_groups(frame(spark, [(1, None, None), (2, "short words", None)])).count() == 0


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(18)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k}": "w18" for k in range(18)}


@pytest.mark.parametrize("seed", range(3))
def test_a_pair_meets_in_one_block_only(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(7, 13)))
        k = rng.randrange(len(a) + 1)
        b = rng.choice((a[:k] + "a" + a[k:], a[:k] + "b" + a[k + 1 :]))
        common = spelling.near(a, b)
        if a == b or abs(len(a) - len(b)) > 1:
            assert common is None
            continue
        at = spelling.cuts(len(a))
        holes = [j for j in range(spelling.PIECES) if a[: at[j]] == b[: at[j]] and a[at[j + 1] :] == b[len(b) - (len(a) - at[j + 1]) :]]
        assert spelling.first_hole(a, *common) == holes[0]


# Whitening.

VECTORS = "vec_id long, embedding array<float>, x string, width string, w int, id int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2) for i, v in rows], VECTORS)


def whitened(rows):
    """The contract with a covariance and its eigenvectors: {id: (n, deviation, whitened, explained)} and identity's error."""
    usable = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in usable:
        c = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), [c @ u[:, k] / np.sqrt(e[k]) for k in range(4)], [e[k] / np.trace(v) for k in range(4)]))
    return out


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_against_eigenvectors(spark, scale):
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) * np.array([1, 2, 3, 4, 5, 6]) * scale
    rows = [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(mixed)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)] + [(7, rows[8][1]), (None, rows[9][1])]
    bad = [(501, None), (502, []), (503, [None] * 6), (504, [float("nan")] * 6), (505, [float("inf")] + [1.0] * 5), (506, [1.0] * 5)]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(7)).collect()
    expected = sorted(whitened(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert len(got) == 4 * len(expected)
    by = {}
    for r in got:
        by.setdefault((r.vec_id is None, r.vec_id or 0, r.deviation_exact), {}).setdefault(r.component, r)
    signs = None
    for i, n, deviation, values, explained in expected:
        mine = by[i is None, i or 0, Decimal(deviation)]
        signs = signs or {k: np.sign(mine[k].whitened * values[k - 1]) for k in mine}
        for k in (1, 2, 3, 4):
            r = mine[k]
            assert r.n == n and r.deviation == (deviation if deviation < 2**63 else None)
            assert abs(r.whitened * signs[k] - values[k - 1]) < 1e-9 and abs(r.explained / explained[k - 1] - 1) < 1e-9
            assert r.identity_error < 1e-9


def test_whitening_merges_triangles_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, [float(c) for c in np.float32(v)]) for k, v in enumerate(rng.normal(size=(200, 8)))]
    one = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows)).collect()}
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK", 16)
    two = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-10


def test_whitening_of_what_does_not_vary(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 1.0, float(-k)]) for k in range(5)])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    wide = whitening.whiten(vectors(spark, [(k, [float(np.float32(3e38 * (k % 3 - 1))), float(k)]) for k in range(9)])).collect()
    assert len(wide) == 9 and {r.component for r in wide} == {1}


def test_sums_are_exact_beyond_a_long():
    fit = whitening.Fit(3, 2, (2**64, -5), 2**63 - 1)
    x = np.array([[2**62, 1], [-(2**62), -7]])
    assert fit.deviations(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(row, fit.sums)) for row in x]
    assert np.allclose(fit.centred(x), [[2**62 - 2**64 / 3, 1 + 5 / 3], [-(2**62) - 2**64 / 3, -7 + 5 / 3]], rtol=1e-15)


# Language identification.


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    network = language_id.Network.random(["a", "b", "c"], 4)
    rows, sizes, labels = rng.integers(97, 110, (5, 7)).astype(np.uint8), np.array([7, 3, 7, 1, 5]), np.array([0, 1, 2, 1, 0])
    _, grads = network.loss(rows, sizes, labels)
    for name, w in network.weights.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in w.shape)
            at = (at[0], int(rng.integers(97, 110))) if "table" in name else at
            before, step = w[at], 1e-2
            values = []
            for d in (step, -step):
                w[at] = before + d
                values.append(network.loss(rows, sizes, labels)[0])
            w[at] = before
            slope = (values[0] - values[1]) / (2 * step)
            assert abs(slope - grads[name][at]) < 3e-4 + 2e-2 * abs(slope), name


def by_bytes(network, text):
    """Mean of the bytes' probabilities, byte by byte."""
    w, octets = network.weights, text.lower().encode()
    squash = lambda x: x / (1 + np.abs(x))
    total = np.zeros(len(network.languages))
    for lo in range(0, len(octets), language_id.WINDOW):
        window = octets[lo : lo + language_id.WINDOW].ljust(language_id.WINDOW, b" ")
        states = {}
        for name, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            d = w[f"{name}_u"].shape[1]
            h = np.zeros(d)
            for t in order:
                x, u = w[f"{name}_table"][:, window[t]], w[f"{name}_u"] @ h + w[f"{name}_b"]
                z, r = (0.5 + 0.5 * squash(x[k] + u[k]) for k in (slice(0, d), slice(d, 2 * d)))
                c = squash(x[2 * d :] + r * u[2 * d :])
                h = z * h + (1 - z) * c
                states[name, t] = h
        for t in range(min(language_id.WINDOW, len(octets) - lo)):
            e = np.exp(w["out"] @ np.concatenate([states["f", t], states["b", t]]) + w["bias"])
            total += e / e.sum()
    return total / len(octets)


def test_labels_are_those_of_the_network_byte_by_byte(monkeypatch):
    monkeypatch.setattr(language_id, "TOGETHER", 2)
    network = language_id.Network.random(["a", "b", "c"], 3)
    texts = ["Ab", "x" * 64, "Überall 12 " * 30, None, "", "12 !", "ñ" * 33, "word " * 13]
    names, scores = language_id.predict(network, texts)
    for text, name, score in zip(texts, names, scores):
        if not text or text == "12 !":
            assert (name, score) == ("und", 0)
        else:
            mean = by_bytes(network, text)
            assert name == network.languages[mean.argmax()] and abs(score - mean.max()) < 1e-5


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = language_id.fit_from(docs)
    got = language_id.identify(docs, network).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang) and network.languages == sorted(set(lang.values()))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    ok = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(ok) > 200 and np.mean(ok) > 0.95


def test_labels_of_rows_that_are_held_out_do_not_matter(spark):
    rows = [(k, f"{'der die das und ' if k % 2 else 'the of and to '}{k}" * 3, "de" if k % 2 else "en") for k in range(60)]
    other = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    one, two = language_id.fit_from(frame(spark, rows)), language_id.fit_from(frame(spark, other))
    assert one.languages == two.languages == ["de", "en"]
    assert all((one.weights[k] == two.weights[k]).all() for k in one.weights)


def test_little_to_learn_from(spark):
    rows = [(1, "Text", "en"), (3, None, None), (None, "some text", "fr"), (4, "12", None), (5, "", "en")]
    ids = [i for i, _, _ in rows if i and zlib.crc32(str(i).encode()) % 3 != 1]
    assert 1 in ids
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame(spark, rows), language_id.fit_from(frame(spark, rows))).collect()}
    assert got == {1: ("en", 1.0), 3: ("und", 0.0), None: ("en", 1.0), 4: ("und", 0.0), 5: ("und", 0.0)}
    nothing = language_id.fit_from(frame(spark, []))
    assert language_id.identify(frame(spark, []), nothing).count() == 0
    assert [r.lang_pred for r in language_id.identify(frame(spark, [(1, "Text", None)]), nothing).collect()] == ["und"]


def test_the_sample_of_labels_is_bounded_and_even(spark):
    rows = [(k, f"text {k % 50} {'a' * (k % 7)}", "en" if k % 10 else "de") for k in range(300)] + [(999, "again and again", "en")] * 100
    network = language_id.fit_from(frame(spark, rows), documents=20, windows=8)
    assert network.languages == ["de", "en"] and network.weights["out"].shape[0] == 2
    few = language_id.fit_from(frame(spark, rows[:300]), documents=20, windows=8)
    # A hundred copies count once.
    assert few.languages == network.languages and all(np.isfinite(v).all() for v in network.weights.values())


# The registered queries.

SMALL = "/root/testdata/sf0.001"


def test_the_spelling_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = db.execute(__spark_entry__.oracle_sql()["op13_spelling_groups"])
    columns = [c[0] for c in found.description]
    got = __spark_entry__.queries()["op13_spelling_groups"](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall())) and len(got) > 500


def test_the_queries_return_what_they_should(spark):
    every = __spark_entry__.queries()
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    got = every["op11_whitening"](spark, SMALL).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((r.vec_id, k) for r in vectors.collect() for k in (1, 2, 3, 4))
    assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == len({r.n for r in got}) == 1
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    named = every["op12_language_id"](spark, SMALL)
    assert named.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert sorted(r.doc_id for r in named.collect()) == sorted(r.doc_id for r in docs.collect())
