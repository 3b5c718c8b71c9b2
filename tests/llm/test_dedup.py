import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import common, embedding_dedup, simhash, suffix_dedup
from quarry.llm import exact_dedup as exact_dedup_module
from quarry.llm.exact_dedup import drop_exact_duplicates, exact_dedup

DOCS = "doc_id long, text string, keep_id string, fp int, h string, row string, id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w", 2) for i, t in rows], DOCS)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(n // 3)]
    return [(k, rng.choice(base) if rng.random() < 0.7 else rng.choice(base) + " tail") for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, " "), (n + 3, "\t \n")]


def test_exact_against_plain_rule(spark):
    rows = random_rows(1)
    sha = {i: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, t in rows}
    groups = {}
    for i, s in sorted(sha.items()):
        groups.setdefault(s, []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, rows)).collect()}
    assert got == {i: (groups[s][0], len(groups[s]), i == groups[s][0], s) for i, s in sha.items()}
    kept = drop_exact_duplicates(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in groups.values())


@pytest.mark.parametrize("bits, least", [(1, 0), (2**15, 0), (2**28, 0)])
def test_exact_is_the_same_with_filters_that_are_not_broadcast_or_saturated(spark, monkeypatch, bits, least):
    monkeypatch.setattr(common, "hot_from", lambda total: 5)
    rows = random_rows(2) + [(1000 + k, "the same") for k in range(40)] + [(1001, "the same"), (1000, "the same")]
    one = sorted(map(tuple, exact_dedup(frame(spark, rows)).collect()))
    assert sorted(map(tuple, exact_dedup(frame(spark, rows), broadcast_bits=bits).collect())) == one
    kept = sorted(map(tuple, drop_exact_duplicates(frame(spark, rows)).collect()))
    assert len(kept) == len({r[4] for r in one})
    assert sorted(map(tuple, drop_exact_duplicates(frame(spark, rows), broadcast_bits=bits, broadcast_rows=least).collect())) == kept


def test_the_filter_grows_with_the_rows(spark):
    digests = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("s"))
    slots = exact_dedup_module.set_slots(digests, "s", 20_000, 2)
    assert slots.blocks * exact_dedup_module.BLOCK_BITS >= 16 * 20_000 and slots.broadcast
    assert not exact_dedup_module.set_slots(digests, "s", 20_000, 2, broadcast_bits=2**15).broadcast
    assert slots.test(digests, "s").where("__maybe").count() < 400


def test_of_rows_that_share_id_and_text_the_same_one_stays(spark):
    rows = [(1, "a", str(k), k, "y", "z", "w", 2) for k in range(30)]
    kept = {tuple(drop_exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(n)).collect()[0]) for n in (1, 3, 7)}
    assert len(kept) == 1


def test_exact_edges(spark):
    assert exact_dedup(frame(spark, [])).count() == drop_exact_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a"), (1, "a"), (1, "a"), (None, "b"), (2, "c")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 2, 1, True)], key=str)
    assert sorted(((r.doc_id, r.text) for r in drop_exact_duplicates(frame(spark, rows)).collect()), key=str) == sorted([(1, "a"), (None, "b"), (2, "c")], key=str)


def test_exact_uses_no_python_and_unique_rows_do_not_shuffle(spark, capsys):
    exact_dedup(frame(spark, random_rows(3))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def plain_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows(seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(15):
        words = ["".join(rng.choice("abcdeéß") for _ in range(4)) for _ in range(rng.choice([0, 2, 3, 4, 60, 300]))]
        for c in range(4):
            copy = list(words)
            if copy and c:
                copy[rng.randrange(len(copy))] = "X"
            rows.append((k * 4 + c, " \n".join(copy)))
    return rows + [(100, None), (101, "A b"), (102, "a  B")]


LIMITS = [(64, 1024, 16_384), (0, 2, 100), (0, 4, 3)]


def set_limits(monkeypatch, limits):
    for name, value in zip(("DIRECT", "CHUNK", "SPLIT"), limits):
        monkeypatch.setattr(simhash, name, value)


@pytest.mark.parametrize("limits", LIMITS)
def test_links_within_a_crowded_key(spark, monkeypatch, limits):
    set_limits(monkeypatch, limits)
    rng = random.Random(3)
    fps = sorted({0xABCDEF0123400000 + rng.getrandbits(20) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)})
    expected = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps), 4)
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in edges.collect()]
    assert components(fps, found) == expected


def test_further_masks_keep_every_close_pair():
    mask = simhash.table_masks(7, 4)[3] % (1 << 64)
    places = [k for k in range(64) if not mask >> k & 1]
    masks = [m % (1 << 64) for m in simhash.further_masks(mask, 4)]
    assert len(masks) == 15 and all(m & mask == 0 for m in masks)
    rng = random.Random(1)
    for _ in range(200):
        flips = sum(1 << p for p in rng.sample(places, 4))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("limits", LIMITS)
def test_simhash_against_plain_rule(spark, monkeypatch, limits):
    set_limits(monkeypatch, limits)
    rows = near_rows()
    fp = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    expected = components(list(fp), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert got == {i: (f"{fp[i]:016x}", expected[i]) for i in fp}
    kept = simhash.keep_one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values())) and len(kept.columns) == 8


@pytest.mark.parametrize("most", [0, 100])
def test_near_copies_go_by_id_and_text(spark, most):
    rng = random.Random(7)
    a, b, c = (" ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)) for _ in range(3))
    assert (plain_fingerprint(a) ^ plain_fingerprint(a + " end")).bit_count() <= 4
    rows = [(1, a), (7, a + " end"), (7, b), (9, c), (9, c + " end"), (None, b), (None, None)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(frame(spark, rows), broadcast_rows=most).collect()]
    assert sorted(kept, key=str) in [sorted([(1, a), (7, b), (9, t), (None, None)], key=str) for t in (c, c + " end")]


def test_every_pair_within_the_distance_shares_a_table():
    rng = np.random.default_rng(0)
    for r in (5, 6, 7, 9):
        masks = [np.uint64(m & (2**64 - 1)) for m in simhash.table_masks(r, 4)]
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(int(m) & flips == 0 for m in masks)
    assert [simhash.blocks_for(n, 4) for n in (0, 10**4, 3 * 10**5, 10**9, 10**12)] == sorted(simhash.blocks_for(n, 4) for n in (0, 10**4, 3 * 10**5, 10**9, 10**12))


def test_simhash_edges(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(frame(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")])).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {1000 + k: 1000 for k in range(60)}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_cut(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b, spans = (t or "").encode(), []
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
            seen.add(s)
        left, at = b"", 0
        for lo, hi in spans:
            left, at = left + b[at:lo], hi
        left += b[at:]
        out[i] = (len(b), len(b) - len(left), len(spans), hashlib.sha256(left).hexdigest())
    return out


def passage_rows(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abé d") for _ in range(n))
    shared = [text(90), text(100), text(150), text(400)]
    rows = [(k, text(rng.randint(0, 300)) + rng.choice(shared) + text(rng.randint(0, 50)) + rng.choice(shared)) for k in range(40)]
    return rows + [(50, None), (51, ""), (52, "x" * 500), (53, "ab" * 400), (54, rows[3][1]), (55, "x" * 99), (56, "\0" * 250)]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_suffix_against_plain_rule(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rows = passage_rows(chunk)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(frame(spark, rows), with_text=False).collect()}
    assert got == plain_cut(rows)


@pytest.mark.parametrize("length", [100, 150, 200])
@pytest.mark.parametrize("chunk", [2048, 3])
def test_suffix_of_other_lengths_and_texts_that_differ_in_the_middle(spark, monkeypatch, length, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = random.Random(length)
    rows = []
    for k in range(0, 80, 2):  # pairs that differ in one byte, at every distance from the ends
        t = "".join(rng.choices("abcdefgh", k=2 * length - 1))
        rows += [(k, t), (k + 1, t[: length - 1 - k // 4] + "Z" + t[length - k // 4 :])]
    rows += [(100 + k, t) for k, (_, t) in enumerate(passage_rows(length))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(frame(spark, rows), length=length, with_text=False).collect()}
    assert got == plain_cut(rows, length)


def test_suffix_common_anchors_meet_once_a_slab(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 4000)
    monkeypatch.setattr(suffix_dedup, "KNOWN", 4)
    rows = passage_rows(7) + [(100 + k, "boilerplate " * 12 + str(k) * 120) for k in range(60)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(frame(spark, rows), with_text=False).collect()}
    assert got == plain_cut(rows)
    h = np.array([5, 9, 5, 7, 9, 5], np.uint64)
    how, known = suffix_dedup._meetings(h, np.array([9], np.uint64))
    assert how.tolist() == [1, 2, 2, 0, 2, 2] and known.tolist() == [5, 9]
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2)
    assert suffix_dedup._meetings(np.full(6, 5, np.uint64), known)[0].tolist() == [2, 2, 3, 3, 4, 4]


def test_suffix_real_outputs_and_edges(spark):
    rows = [(1, "a" * 5 + "q" * 100), (2, "b" + "q" * 100 + "c")]
    got = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.cut_repeats(frame(spark, rows)).collect()}
    assert got == {1: (b"a" * 5 + b"q" * 100, []), 2: (b"bc", [(1, 101)])}
    assert suffix_dedup.cut_repeats(frame(spark, [])).count() == 0
    text = "".join(random.Random(1).choices("abc", k=150))
    nulls = suffix_dedup.cut_repeats(frame(spark, [(None, text), (None, text), (3, text), (3, text)]), with_text=False).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in nulls) == [("3", 150), ("3", 150), ("None", 0), ("None", 0)]
    with pytest.raises(ValueError):
        suffix_dedup.cut_repeats(frame(spark, rows), length=50)


def test_suffix_rows_that_share_an_id_keep_to_their_own_text(spark):
    rng = random.Random(31)
    x, a, b, c = ("".join(rng.choice("abcdefghijklmnop ") for _ in range(n)) for n in (150, 20, 20, 300))
    rows = [(1, x + a), (5, x + b), (5, c), (-3, b + c + c), (5, x + b), (2**61, "short")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(frame(spark, rows), with_text=False).collect())
    # Text c comes first in the row of the smallest id, where its second copy goes as well.
    assert got == [(-3, 620, 300), (1, 170, 0), (5, 170, 150), (5, 170, 150), (5, 300, 300), (2**61, 5, 0)]
    three = suffix_dedup.cut_repeats(frame(spark, [(1, x + a), (5, x + b), (5, c)]), with_text=False).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in three) == [(1, 170, 0), (5, 170, 150), (5, 300, 0)]


@pytest.mark.parametrize("hot", [2, 10**9])
def test_suffix_copies_of_a_row_are_worked_on_once(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "hot_from", lambda total: hot)
    rng = random.Random(32)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2000))
    rows = [(None, text)] * 400 + [(4, text[:1000])] * 30 + [(6, text[500:] + text[:300])]
    seen = []
    original = suffix_dedup.repeated_ranges

    def ranges(docs, length):
        seen.append(docs.count())
        return original(docs, length)

    monkeypatch.setattr(suffix_dedup, "repeated_ranges", ranges)
    got = sorted({(r.doc_id or 0, r.n_removed) for r in suffix_dedup.cut_repeats(frame(spark, rows), with_text=False).collect()})
    assert got == [(0, 0), (4, 1000), (6, 1800)] and seen == [3]


def test_suffix_order_and_common_prefixes():
    rng = random.Random(5)
    contexts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode() for _ in range(30)]
    sizes = np.array([len(c) + 1 for c in contexts])
    begins = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int16) + 1
    symbols[begins + sizes - 1] = 0
    owner = np.repeat(np.arange(30), sizes)
    left = sizes[owner] - 1 - (np.arange(len(symbols)) - begins[owner])
    order = suffix_dedup.suffix_order(symbols, left)
    suffix = lambda k: bytes((symbols[k : k + left[k]] - 1).astype(np.uint8))
    assert [suffix(k) for k in order] == sorted(suffix(k) for k in range(len(symbols)))
    shared = suffix_dedup.common_prefixes(symbols, order, begins, left, 20)
    for a, b, n in zip(order, order[1:], shared[1:]):
        x, y = suffix(a), suffix(b)
        same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert n == min(same, 20)


def test_binary_search():
    rows = np.array(sorted([b"abcd", b"abce", b"zzzz"]), "S4").view("V4")
    assert suffix_dedup.search(rows, np.array([b"abce", b"abcz", b"abcd", b"zzzz", b"aaaa"], "S4").view("V4"), 4).tolist() == [1, -1, 0, 2, -1]


VECTORS = "vec_id long, embedding array<float>, label int, node int, key string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, b, 1, "k", 2) for i, v, b in rows], VECTORS)


@pytest.mark.parametrize("hashes", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("width", [64, 384])
def test_pairs_at_the_threshold_share_a_bucket(hashes, width):
    rng = np.random.default_rng([hashes, width])
    a, b = rng.normal(size=(2, 500, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    left, right = (embedding_dedup.bucket_codes(x, hashes, embedding_dedup.TABLES[hashes]) for x in (a, b))
    shared = (left[:, :, :, None] == right[:, :, None, :]).any((1, 2, 3))
    assert shared.mean() >= 0.98


@pytest.mark.parametrize("chunk, split", [(256, 16_384), (3, 16_384), (4, 5)])
def test_embeddings_against_brute_force(spark, monkeypatch, chunk, split):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    monkeypatch.setattr(embedding_dedup, "SPLIT", split)
    rng = np.random.default_rng(chunk)
    rows = []
    for c in range(40):
        center = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            v = center + rng.normal(size=24) * rng.choice([0, 0.05, 0.2])
            rows.append((len(rows), [float(x) for x in v], int(rng.integers(0, 2))))
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([b for *_, b in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    expected = components(range(len(rows)), list(zip(*map(lambda a: a.tolist(), np.nonzero(near)))))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()}
    links = {i: int(near[i].sum()) for i in range(len(rows))}
    found = sum(n for n, *_ in got.values())
    assert found >= 0.97 * sum(links.values()) and all(got[i][0] <= links[i] for i in links)
    assert sum(got[i][1] == expected[i] for i in expected) >= 0.97 * len(rows)
    assert all(r[2] == (i == r[1]) for i, r in got.items())


def test_embedding_edges(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1),
        (9, [float("inf"), 1.0], 1), (10, [None, 1.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (13, [3.0], 1), (14, [5.0], 1),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert got == {i: (0, i, True) for i in range(4, 13)} | {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 13: (1, 13, True), 14: (1, 13, False)}
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


def test_attach_keeps_every_row_with_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    assert common.attach(rows, table, "k", "n", 3000).count() == 3000
    spread = common.attach_spread(rows, table, "k", "n", 3000, ["id"])
    assert spread.count() == 3000 and spread.where("k = 7 and low = 0 and n > 999").count() == rows.where("k = 7").count()
