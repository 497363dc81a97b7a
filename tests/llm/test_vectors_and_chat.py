"""Vector codes, whitening and the conversation tree against brute force, on small tables with nulls, odd numbers, ties, repeated rows and columns of clashing names."""

import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.llm import chat_tree, integer_vectors, vector_codes, whitening
from webloom.llm.hot import attach

VECTORS = "vec_id long, embedding array<double>, label int, code string, n long, x string"
CHATS = "conv_id long, turn long, role string, text string, node string, path string"


def vectors(spark, found):
    return spark.createDataFrame([(i, v, label, "c", 7, "x") for i, v, label in found], VECTORS)


def clustered(seed=1, n=120, size=8):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(6)]
    found = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]
    same = found[5][1]
    return found + [(1000 + i, same, 0) for i in range(20)] + [found[3], found[3]]


ODD = [
    (2000, None, 1), (2001, [], 1), (2002, [1.0, None, 2.0], 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] + [0.0] * 7, 1), (2005, [0.5, -0.25], None), (None, [1.0] * 8, None), (2006, [1e300] * 8, 2), (2007, [-0.0001] * 8, 2),
]


def plain_integers(found):
    kept = [(i, v, label) for i, v, label in found if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    scaled = [[max(-(1 << 24), min(1 << 24, math.floor(1024 * c) if abs(c) < 1e200 else math.copysign(1 << 30, c))) for c in v] for _, v, _ in kept]
    return kept, [[int(c) for c in x] + [0] * (width - len(x)) for x in scaled]


def plain_codes(found, parts=4, entries=256, rounds=4):
    kept, xs = plain_integers(found)
    width = -(-len(xs[0]) // parts)
    xs = [x + [0] * (parts * width - len(x)) for x in xs]
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for x in xs]
    order = sorted(range(len(xs)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, xs[k]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def assign():
        out = []
        for x in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(x[p], c)), j) for j, c in enumerate(books[p])) for p in range(parts)]
            out.append(([j for _, j in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        found_ = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut[k][p] for k in range(len(xs)) if found_[k][0][p] == j]
                if own:
                    books[p][j] = tuple(sum(c) // len(own) for c in zip(*own))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    errors = collections.Counter()
    coded = assign()
    for (_, _, label), (_, error) in zip(kept, coded):
        errors[label] += error
    return sorted((repr(i), "".join(f"{j:02x}" for j in c), e, errors[label], sha) for (i, _, label), (c, e) in zip(kept, coded))


@pytest.mark.parametrize("config", [vector_codes.CodeConfig(), vector_codes.CodeConfig(parts=3, entries=5, rounds=3), vector_codes.CodeConfig(entries=1, rounds=0)])
@pytest.mark.parametrize("odd", [[], ODD])
def test_vector_codes(spark, config, odd):
    found = clustered() + odd
    rows = vectors(spark, found).repartition(7)
    got = sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(rows, config).collect())
    assert got == plain_codes(found, config.parts, config.entries, config.rounds)


def test_vector_codes_of_nothing(spark):
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert vector_codes.compress(vectors(spark, ODD[:1] + ODD[2:5])).count() == 0
    only = vector_codes.compress(vectors(spark, [(1, [], None)])).collect()
    assert [(r.vec_id, r.error) for r in only] == [(1, 0)]


def test_vector_codes_decode(spark):
    rows = integer_vectors.integer_vectors(vectors(spark, clustered()), vec_id=F.col("vec_id"))
    books = vector_codes.train(rows)
    back = vector_codes.decode(vector_codes.encode(rows, books), books).join(rows.withColumnRenamed("x", "y"), "vec_id").where("vec_id < 1000 AND vec_id <> 3")
    for r in back.collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(r.x, r.y))


def test_labels_meet_their_sums_by_either_way(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else k % 40) for k in range(4000)], "vec_id long, label long")
    table = rows.groupBy("label").agg(F.count("*").alias("_n"), F.sum("vec_id").alias("s")).persist()
    a, b = (sorted(map(repr, attach(rows, table, "label", "_n", limit).collect())) for limit in (1000, 3))
    assert a == b and len(a) == 4000


# Whitening


def exact_covariance(xs):
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    centred = [[n * v - s for v, s in zip(x, sums)] for x in xs]
    size = len(sums)
    return n, sums, centred, [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(size)] for i in range(size)]


@pytest.mark.parametrize("odd", [[], ODD[:6] + ODD[8:]])
@pytest.mark.parametrize("block", [1024, 16])
def test_whitening(spark, odd, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", block)
    found = clustered() + odd
    kept, xs = plain_integers(found)
    n, sums, centred, v = exact_covariance([[c + 100_000 for c in x] for x in xs])
    values, basis = np.linalg.eigh(np.array(v, dtype=np.float64))
    values, basis = values[::-1], basis[:, ::-1]
    plain = np.array(centred, dtype=np.float64) / n @ basis / np.sqrt(values)
    rows = whitening.whiten(vectors(spark, found).repartition(5)).collect()
    assert len(rows) == 8 * len(kept) and {r.n for r in rows} == {n}
    expected = collections.defaultdict(list)
    for (i, _, _), c, p in zip(kept, centred, plain):
        expected[i].append((sum(a * a for a in c), np.abs(p)))
    for r in rows:
        near = [e for e in expected[r.vec_id] if e[0] == r.deviation]
        assert near and min(abs(abs(r.whitened) - e[1][r.component - 1]) for e in near) < 1e-9
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-10


def test_covariance_beyond_doubles(spark):
    """Sums and covariance agree with rational arithmetic far below the rounding of doubles, also about a large mean and with one wide dimension."""
    rng = random.Random(5)
    found = [(i, [rng.gauss(9000, 0.01), rng.gauss(0, 3000), rng.gauss(0, 0.5)], 0) for i in range(300)]
    _, xs = plain_integers(found)
    n, sums, _, v = exact_covariance([[c + 100_000 for c in x] for x in xs])
    rows = integer_vectors.integer_vectors(vectors(spark, found).repartition(6), vec_id=F.col("vec_id"))
    got_n, got_sums, _, _, high, low = whitening.covariance(rows, 3, 100_000)
    assert (got_n, got_sums.tolist()) == (n, sums)
    for i in range(3):
        for j in range(3):
            miss = Fraction(float(high[i, j])) + Fraction(float(low[i, j])) - v[i][j]
            assert abs(miss) < Fraction(v[i][i] * v[j][j]) ** Fraction(1, 2) * 1e-24


def test_slices_lose_nothing():
    rng = np.random.default_rng(3)
    high = rng.normal(0, 1, (50, 4)) * 10.0 ** rng.integers(-8, 8, (50, 4))
    low = high * 2.0**-60 * rng.uniform(-1, 1, high.shape)
    parts = whitening._sliced(high, low)
    for at in np.ndindex(high.shape):
        whole = Fraction(float(high[at])) + Fraction(float(low[at]))
        assert abs(sum(Fraction(float(p[at])) for p in parts) - whole) <= Fraction(float(np.abs(high[:, at[1]]).max())) * Fraction(1, 2**100)
    total, rest = whitening.outer_sum(high, low)
    for i, j in np.ndindex(4, 4):
        whole = sum((Fraction(float(high[k, i])) + Fraction(float(low[k, i]))) * (Fraction(float(high[k, j])) + Fraction(float(low[k, j]))) for k in range(50))
        scale = sum(abs(Fraction(float(high[k, i])) * Fraction(float(high[k, j]))) for k in range(50))
        assert abs(Fraction(float(total[i, j])) + Fraction(float(rest[i, j])) - whole) <= max(scale, Fraction(float(np.abs(high[:, i]).max() * np.abs(high[:, j]).max()))) * Fraction(1, 2**96)


def test_whitening_without_variance(spark):
    rows = whitening.whiten(vectors(spark, [(1, [0.5, 0.5, 1.0], 0)] * 3)).collect()
    assert len(rows) == 9 and all((r.n, r.deviation, r.whitened, r.identity_error, r.explained) == (3, 0, None, None, 0.0) for r in rows)
    flat = whitening.whiten(vectors(spark, [(i, [i / 8, -i / 8], 0) for i in range(20)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and all(abs(r.identity_error) < 1e-10 for r in flat)
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, ODD[:2])).count() == 0


def test_deviations_beyond_64_bits():
    n = 10**10
    model = whitening.Whitening(n, np.array([0, 0]), np.zeros(2), np.zeros(2), np.eye(2), np.ones(2), 2.0, np.ones(2, bool))
    got = whitening.deviations(np.array([[0, 0], [1, 0], [0, 303_700_049]], np.int64) // np.array([1, 1]), model).to_pylist()
    assert got[0] == 0 and got[1] is None
    model = whitening.Whitening(1, np.array([0, 0]), np.zeros(2), np.zeros(2), np.eye(2), np.ones(2), 2.0, np.ones(2, bool))
    near = [[3_037_000_499, 0], [3_037_000_499, 70_000], [3_037_000_499, 100_000]]
    assert whitening.deviations(np.array(near, np.int64), model).to_pylist() == [s if (s := a * a + b * b) < 1 << 63 else None for a, b in near]


# Conversations


def chats(seed=1, n=60):
    """Conversations that share first turns, some whole, some one the start of another, with marks in their texts."""
    rng = random.Random(seed)
    said = ["", "hi", "é ✓ 漢字", "[INST] no [/INST]", "</s>", "<\\s>", "[\\\\INST]", "a\\", "<<s>>", "x" * 500, " lead and trail \n", "[ROLE]u[TEXT]", "two\n\nlines"]
    heads = [[("system", rng.choice(said)), ("user", rng.choice(said))] for _ in range(3)]
    rows = []
    for c in range(n):
        own = list(rng.choice(heads))[: rng.randrange(3)]
        own += [(rng.choice(["user", "assistant", "tool", "", None, "[TEXT]"]), rng.choice([*said, None])) for _ in range(rng.randrange(0 if own else 1, 6))]
        rows += [(c, t, role, text) for t, (role, text) in enumerate(own)]
    twice = [(c + 1000, t, role, text) for c, t, role, text in rows if c < 20]
    many = [(2000 + k, t, "user", f"q{t}") for k in range(30) for t in range(2)]
    long = [(5000, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(200)] + [(5001, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(120)]
    odd = [(6000, 1, "user", "b"), (6000, 1, "user", "a"), (6000, None, "assistant", "first"), (6000, 1, "user", "a"), (None, 0, "user", "no id"), (None, 5, "assistant", "none")]
    return rows + twice + many + long + odd


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, "n", "p") for r in rows], CHATS)


def plain_chats(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    return {conv: [(x[3], x[5]) for x in sorted(own)] for conv, own in by.items()}


CONFIGS = [chat_tree.ChatConfig(), chat_tree.ChatConfig(None, range_tokens=300), chat_tree.ChatConfig(range_tokens=500)]


@pytest.mark.parametrize("config", CONFIGS)
def test_chat_digests(spark, config):
    rows = chats()
    got = {r.conv_id: tuple(r)[1:] for r in chat_tree.digests(chat_table(spark, rows), config).collect()}
    plain = plain_chats(rows)
    assert got.keys() == plain.keys()
    for conv, own in plain.items():
        turns = "".join(f"{role}\n{text}\n" for role, text in own)
        loss = "".join(text for role, text in own if role == "assistant")
        length = len("<s>") + sum(len("".join(chat_tree.render(role, text))) for role, text in own)
        assert got[conv] == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), length)


@pytest.mark.parametrize("config", CONFIGS)
def test_chat_tree_is_one_stream(spark, config):
    """Every shared first turn stands once, the stream has no gaps, and what a node attends to is its conversation up to it, token for token."""
    rows = chats(seed=2)
    tree, ends = chat_tree.build(chat_table(spark, rows), config)
    nodes = sorted(tree.collect(), key=lambda r: r.start)
    plain = plain_chats(rows)
    assert len(nodes) == len({tuple(own[: k + 1]) for own in plain.values() for k in range(len(own))})
    stream = [i for r in nodes for i in r.ids]
    place = 0
    for r in nodes:
        assert r.start == place and list(r.position_ids) == list(range(r.position_ids[0], r.position_ids[0] + len(r.ids)))
        place += len(r.ids)
    tokens = chat_tree._sent(tree, config)()
    by_node = {bytes(r.node): r for r in nodes}
    for e in ends.collect():
        r = by_node[bytes(e.node)]
        seen = [i for a in r.attend for i in range(a.start, a.stop)]
        own = plain[e.conv_id]
        assert r.depth == len(own) and r.attend[-1].stop == r.start + len(r.ids)
        assert [stream[i] for i in seen] == [i for k, turn in enumerate(own) for i in tokens.encode(*turn, k == 0)[0]]
        positions = {n.start + k: p for n in nodes for k, p in enumerate(n.position_ids)}
        assert [positions[i] for i in seen] == list(range(len(seen)))
    assert sum(r.copies for r in nodes) == len(plain)


def test_chat_depth_first(spark):
    """Below a node come all nodes that follow from it before any other: intervals of subtrees nest."""
    tree, _ = chat_tree.build(chat_table(spark, chats(seed=3)), chat_tree.ChatConfig(range_tokens=100))
    path = []
    for r in sorted(tree.collect(), key=lambda r: r.start):
        del path[r.depth - 1 :]
        path.append(r.start)
        starts = {i for a in r.attend for i in range(a.start, a.stop)}
        assert len(path) == r.depth and all(s in starts for s in path)


def test_chat_odd_tables(spark):
    assert chat_tree.digests(chat_table(spark, [])).count() == 0
    got = {r.conv_id: r for r in chat_tree.digests(chat_tree.with_odd(chat_table(spark, [(1, 0, "user", "y" * 3_000_000), (1, 1, "assistant", "a b " * 500_000)]))).collect()}
    assert got[1].loss_chars == 2_000_000 and got[1].formatted_chars == 5_000_000 + 3 + 13 + 9
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(chat_tree.ODD_TEXT)


def test_escapes_turn_back():
    rng = random.Random(4)
    parts = [*chat_tree.MARKS, *(m[0] for m in chat_tree.MARKS), *(m[1:] for m in chat_tree.MARKS), "\\", "\\\\", "a", "<", "["]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        escaped = chat_tree.escape(text)
        assert chat_tree.unescape(escaped) == text and not any(m in escaped for m in chat_tree.MARKS)
        assert chat_tree.parse("".join(chat_tree.render(text, text))) == (text, text)


def test_tokens_are_lossless():
    with open(chat_tree.ChatConfig().tokenizer_file, "rb") as file:
        tokens = chat_tree.Tokens(file.read(), 20)
    for text in ("", "a" * 1000, " \t\n  double  spaces ", "漢字" * 50, " x y", "emoji 👩‍👩‍👧 \U0010ffff"):
        ids, begin, end = tokens.encode("assistant", text, True)
        assert tokens.decode(np.array(ids[begin:end], np.int32)) == text and re.fullmatch(r"<s>\[OUT\](?s:.*)</s>", tokens.decode(np.array(ids, np.int32)))
