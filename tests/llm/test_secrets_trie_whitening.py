"""Secrets, the prefix trie and whitening against brute force, and their odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from logloom.llm import prefix_trie, secrets, whitening

# Secrets.

NAIVE = {
    "assign": re.compile(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
LEAST = {"assign": 6, "access": 20, "hex": 24}


def naive_spans(text):
    found = []
    for k, (kind, pattern) in enumerate(NAIVE.items()):
        at = 0
        while m := pattern.search(text or "", at):
            at = m.end()
            if len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]:
                found.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def hexes(rng, n):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    words = "the report of this season tells about international cooperation with partnerships".split()
    texts = [
        None, "", " \n", "password", "password=", "token: abc", "secret=token: abcdefgh",
        "api_key='A1B2C3D4' and APIKEY = zzzzzz", "ſecret=abcdefgh toKen=abcdefgh",
        "AKIA" + "A" * 15, "AKIA" + "A" * 16, "AKIAAKIA" + "B" * 14, "x" + "a" * 24 + "y",
        "ünï " + hexes(rng, 40) + "\U0001f600 password=\"geheim99\" " + hexes(rng, 23),
        "token=" + "ab12" * 40000, " ".join(rng.choice(words) for _ in range(60000)),
    ]
    for k in range(300):
        line = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            line.insert(rng.randrange(30), f'token = "{hexes(rng, 40)}"')
        if k % 7 == 0:
            line.insert(rng.randrange(30), f"{rng.randrange(10**15, 10**16)}")
        if k % 9 == 0:
            line.insert(rng.randrange(30), f"name{k}@mail{k % 5}.example.com")
        texts.append(" ".join(line))
    return [(k, text) for k, text in enumerate(texts)] + [(None, "password: 123456"), (20, texts[20])]


def test_base_secrets_stay_and_added_ones_are_new(spark, leaks):
    table = spark.createDataFrame(
        [(i, t, "x", 1, "y", 0) for i, t in leaks],
        "doc_id bigint, text string, id string, runs int, spans string, base int",
    )
    found = secrets.find_secrets(table).collect()
    assert len(found) == len(leaks)
    by_id = {row["doc_id"]: row for row in found}
    for doc_id, text in leaks:
        row, base = by_id[doc_id], naive_spans(text)
        for kind in NAIVE:
            assert row[f"n_{kind}"] == sum(s.startswith(kind) for s in base)
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        added = [s for s in spans if s.startswith(secrets.ADDED)]
        assert [s for s in spans if s not in added] == base
        assert len(added) == row["n_added"]
        # Plain words, addresses and numbers are left alone.
        assert doc_id is None or doc_id < 16 or not added


def test_secrets_of_other_forms_are_added(spark, leaks):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hidden = [
        (1000 + k, "the report of " + "".join(rng.choice(letters) for _ in range(36)) + " tells this")
        for k in range(5)
    ]
    # Unlabelled secrets are few among the harmless runs, as they are in a corpus.
    harmless = [
        (2000 + k, f"the report of {rng.randrange(10**12, 10**13)} for word{k}.name@mail{k}.example.com")
        for k in range(300)
    ]
    table = spark.createDataFrame(leaks + hidden + harmless, "doc_id bigint, text string")
    found = secrets.find_secrets(table).filter("doc_id >= 1000").collect()
    assert sum(row["n_added"] for row in found if row["doc_id"] < 2000) >= 4
    assert sum(row["n_added"] for row in found if row["doc_id"] >= 2000) <= 3


def test_without_labels_nothing_is_added(spark, leaks):
    few = spark.createDataFrame(leaks[:16], "doc_id bigint, text string")
    assert {row["n_added"] for row in secrets.find_secrets(few).collect()} == {0}
    assert secrets.find_secrets(few.limit(0)).collect() == []


def test_network_by_a_walk_over_places(monkeypatch):
    rng = np.random.default_rng(0)
    net = secrets.Network(
        rng.normal(size=(secrets.TAPS, secrets.N_CLASSES, secrets.FILTERS)),
        rng.normal(size=secrets.FILTERS),
        rng.normal(size=(4 * secrets.FILTERS, secrets.HIDDEN)),
        rng.normal(size=secrets.HIDDEN),
        rng.normal(size=secrets.HIDDEN) * 0.01,
        0.1,
    )
    cores = ["abcDEF123+/=" * k for k in (1, 2, 9)] + ["é" * 13, "0" * 12]
    windows = ["\0" * 20 + " = \"" + core + "\" and so on more"[: secrets.AFTER] for core in cores]
    assert all(len(w) == secrets.BEFORE + len(c) + secrets.AFTER for w, c in zip(windows, cores))
    table = secrets._class_table()
    expected = []
    for window in windows:
        codes = [0 if c == "\0" else int(table[ord(c)]) if ord(c) < 128 else secrets.OTHER for c in window]
        padded = [0, 0, *codes, 0, 0]
        places = np.array(
            [
                np.maximum(sum(net.taps[t][padded[p + t]] for t in range(secrets.TAPS)) + net.bias, 0)
                for p in range(len(codes))
            ]
        )
        inner = places[secrets.BEFORE : -secrets.AFTER]
        features = [inner.mean(0), inner.max(0), places[: secrets.BEFORE].max(0), places[-secrets.AFTER :].max(0)]
        hidden = np.maximum(np.concatenate(features) @ net.hidden + net.hidden_bias, 0)
        expected.append(1 / (1 + math.exp(-(hidden @ net.out + net.out_bias))))
    for block in (secrets.BLOCK, 60, 30):
        # A small block makes windows longer than it, which are convolved in pieces.
        monkeypatch.setattr(secrets, "BLOCK", block)
        assert np.allclose(net.probabilities(windows), expected)


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    parts = [
        rng.normal(0, 0.3, (secrets.TAPS, secrets.N_CLASSES, secrets.FILTERS)), rng.normal(size=secrets.FILTERS) * 0.1,
        rng.normal(0, 0.2, (4 * secrets.FILTERS, secrets.HIDDEN)), rng.normal(size=secrets.HIDDEN) * 0.1,
        rng.normal(0, 0.3, secrets.HIDDEN), np.zeros(()),
    ]
    windows = ["a" * 24 + core + " 9" * 8 for core in ("Zq81+abcdef0", "plainwordshere")]
    labels, weights = np.array([1.0, 0.0]), np.array([0.7, 0.3])

    def loss():
        net = secrets.Network(*parts)
        z = net.logits(net.pooled(*secrets.encoded(windows)))
        return (weights * (np.log1p(np.exp(z)) - labels * z)).sum()

    slopes = secrets._gradients(secrets.Network(*parts), *secrets.encoded(windows), labels, weights)
    for k in (0, 1, 2, 3, 4):
        for spot in rng.integers(parts[k].size, size=25):
            at = np.unravel_index(spot, parts[k].shape)
            before, step = parts[k][at], 1e-6
            parts[k][at] = before + step
            up = loss()
            parts[k][at] = before - step
            down = loss()
            parts[k][at] = before
            assert (up - down) / (2 * step) == pytest.approx(slopes[k][at], abs=1e-5)


def test_thresholds_let_held_out_secrets_through():
    rng = random.Random(8)
    windows, shapes, labels = [], [], []
    for k in range(400):
        core = hexes(rng, 32) if k % 2 else rng.choice(["internationality", "www.example.com", "123456789012345"])
        windows.append("x y z is a quiet text = " + core + " and then it end")
        shapes.append(secrets.shape(core)), labels.append(bool(k % 2))
    net = secrets.trained(windows, shapes, labels)
    p, cut = net.probabilities(windows), np.asarray(net.thresholds)[shapes]
    flagged = p >= cut
    assert flagged[1::2].mean() >= secrets.RECALL - 0.02 and flagged[::2].mean() == 0


def test_every_finding_teaches_or_is_held_out(spark, monkeypatch):
    rng = random.Random(12)
    texts = [
        f"see {rng.randrange(10**13)}-page and words-like-these-{k} in token={hexes(rng, 30) if k % 20 == 0 else 'x'}"
        for k in range(5000)
    ]
    tables, counted = {}, []
    saved, settle = secrets.saved, secrets._settle
    monkeypatch.setattr(secrets, "SHARD", 1500)
    monkeypatch.setattr(
        secrets, "saved", lambda df, purpose: tables.setdefault(purpose, saved(df, purpose))
    )
    monkeypatch.setattr(
        secrets, "_settle", lambda net, *counts: (counted.append(counts[-1].sum()), settle(net, *counts))
    )
    found = secrets.find_secrets(spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string"))
    every = tables["secret-findings"].select("hash").collect()
    shards = tables["secret-shards"].collect()
    taught = {row["hash"] for shard in shards for row in shard["rows"]}
    assert len(every) > 2 * 4000 and len(shards) > 5
    assert len(taught) + counted[0] == len({row[0] for row in every}) == len(every)
    # Secrets are rare, so that a shard has those of others too.
    assert all(sum(row["secret"] for row in shard["rows"]) > 50 for shard in shards)
    assert found.agg({"n_added": "sum"}).first()[0] < 50


# The prefix trie.


def naive_trie(rows):
    """Nodes by lists of turns; turns of equal number must not differ."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += children[p] == 0
    nodes = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(rebuilt[c]) == len(p))
        nodes.append(
            (
                m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p],
                saved[p], hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(nodes, key=repr)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def trie(spark, rows, schema=CONVERSATIONS):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=repr)


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rng = random.Random(2)
    rows = []
    ids = [0, 1, 2, 3, 4, 5, 7, 100, 105, 106, 250, 251, 399, -5, -100, -101, -203]
    for c in ids:
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 17])):
            rows.append((c, t if t else None, rng.choice(["u", "a", None]), rng.choice(["x", "ÿß", "", None])))
    # Copies, also of a long one, and one that is a third of the table.
    rows += [(c, t, "u", "x") for c in (8, 9, 10, 1008) for t in range(33)]
    rows += [(300 + c, t, "s", "same") for c in range(40) for t in range(2)]
    rows += [(None, 0, "u", "x"), (5000, None, None, None)]
    assert trie(spark, rows) == naive_trie(rows)


def test_trie_of_repeated_rows_and_other_columns(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "a", "b")]
    wide = [(*row, 7, 8, "z") for row in rows]
    schema = CONVERSATIONS + ", conv bigint, depth int, digest string"
    assert trie(spark, wide, schema) == naive_trie(rows)
    assert trie(spark, [], CONVERSATIONS) == []


def test_trie_of_one_conversation_over_many_tasks(spark):
    rows = [(7, t, "u", f"t{t % 5}") for t in range(300)]
    assert trie(spark, rows) == naive_trie(rows)


# Whitening.


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_inertia_counts_eigenvalues(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d))
    for matrix in (a + a.T, np.triu(a, 1) + np.triu(a, 1).T):
        values = np.linalg.eigvalsh(matrix)
        for shift in (*rng.uniform(values[0] - 1, values[-1] + 1, 15), 0.0):
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.above(matrix, shift) == (values > shift).sum()


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 8, 7, 6, 5, 4, 3, 2, 1, 0.5],
        [5.0] * 6 + [1.0] * 6,
        [3.0, 3 - 1e-7, 3 - 2e-7, 2, 2 - 1e-12, 1, 0.1, 0.01, 1e-3, 1e-4],
        [1e6, 1, 1e-3, 0, 0, 0, 0, 0, 0],
        [2.0],
    ],
)
def test_contours_find_the_largest_eigenvalues(spark, values):
    rng = np.random.default_rng(5)
    turn, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    matrix = turn @ np.diag(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.largest(spark, matrix, 8)
    expected = [v for v in sorted(values, reverse=True)[:8] if v > 0]
    assert found == pytest.approx(expected, rel=1e-7, abs=1e-9 * max(values))
    assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-12 * max(values))


def whiten(spark, rows, schema="vec_id bigint, embedding array<float>"):
    return whitening.whitened_vectors(spark.createDataFrame(rows, schema)).collect()


def test_whitening(spark):
    rng = np.random.default_rng(9)
    base = (rng.normal(size=(120, 12)) * np.linspace(0.1, 1, 12)).astype(np.float32)
    rows = [(k, v.tolist(), 1, "q") for k, v in enumerate(base)]
    rows += [rows[3], (None, base[5].tolist(), 1, "q"), (900, None, 1, "q")]
    rows += [(901, [float("nan")] + [0.0] * 11, 1, "q"), (902, [float("inf")] + [0.0] * 11, 1, "q")]
    rows += [(903, [None] + [0.0] * 11, 1, "q"), (904, [0.0] * 12, 1, "q")]
    found = whiten(spark, rows, "vec_id bigint, embedding array<float>, component int, id string")
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    x = np.array([[math.floor(1024 * c) + 100000 for c in r[1]] for r in kept])
    n, total = len(x), x.sum(axis=0)
    assert n == 123 and len(found) == 8 * n
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    got = collections.defaultdict(list)
    for row in found:
        assert row["n"] == n and row["identity_error"] <= 1e-9
        assert row["explained"] == pytest.approx(values[row["component"] - 1] / np.trace(centred.T @ centred / n))
        got[row["vec_id"], row["deviation"]].append((row["component"], row["whitened"]))
    signs = None
    for (vec_id, *_), row, z in zip(kept, x, centred):
        deviation = sum(int(n * int(a) - int(s)) ** 2 for a, s in zip(row, total))
        ours = np.array([w for _, w in sorted(got[vec_id, deviation])])
        theirs = z @ vectors / np.sqrt(values)
        if vec_id == 3:
            assert len(ours) == 16
            ours = ours[::2]
        signs = np.sign(ours * theirs) if signs is None else signs
        assert np.allclose(ours, theirs * signs, atol=1e-9)


def test_whitening_of_few_dimensions_and_no_vectors(spark):
    line = [(k, [float(k), 2.0 * k, -1.0]) for k in range(9)]
    found = whiten(spark, line)
    assert {row["component"] for row in found} == {1} and len(found) == 9
    assert found[0]["explained"] == pytest.approx(1.0)
    assert whiten(spark, [(k, [1.0, 2.0]) for k in range(4)]) == []
    assert whiten(spark, [(1, []), (2, [])]) == []
    assert whiten(spark, [(1, None)]) == []
    assert whiten(spark, []) == []
    with pytest.raises(ValueError):
        whiten(spark, [(1, [1.0]), (2, [1.0, 2.0])])
    with pytest.raises(Exception, match="too large"):
        whiten(spark, [(1, [1e30]), (2, [1.0])])


def test_deviations_beyond_64_bits_of_work_are_exact():
    x = np.array([[3, -(2**45)], [2**45, 5]])
    sums = np.array([2**45 + 3, 5 - 2**45], dtype=object)
    u = whitening._centred(x, 2, sums)
    assert u.tolist() == [[2 * int(a) - int(s) for a, s in zip(row, sums)] for row in x.tolist()]
    assert whitening._deviations(np.array([[2**30, 2**30]])) == [2**61]
    with pytest.raises(OverflowError):
        whitening._deviations(u)
