"""Operators against brute force, on small tables with nulls, blanks, ties, repeated rows and columns of clashing names."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import subprocess
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import attention_lm, decontamination, graph, jaccard, licenses, mixing, pii, quality, sharding, suffix_dedup, text, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, shard int"
KEYED = pii.PiiConfig(b"k")
VISIBLE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(value):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or "")


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, ("en", "de", None)[k % 3], f"src{k % 5}" if k % 7 else None, len(t or ""), "r", "k", 7) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def samples(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for k in range(0, n, 4):
        words = texts[k].split() + passage.split()
        texts[k] = " ".join(words)
        edited = list(words)
        edited[rng.randrange(len(edited))] = "new"
        texts += [texts[k], " ".join(edited)]
    return texts + [None, "", " \n\t ", "a", "A b\nA b\nA b", "x " * 3000, "é" * 500, "same line\n" * 60]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, samples())


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# quality rules


def plain_measures(value):
    value = value or ""
    words = VISIBLE.findall(value)
    grams = collections.defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    covered = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(3)}
    lines = [x for x in value.split("\n") if VISIBLE.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in value), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs, rows):
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    for i, value in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_measures(value)
        assert not (r.base_failed and r.kept)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality.score(empty(spark)).count() == 0


def test_quality_outlier(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)) for _ in range(300)]
    texts.append(" ".join(w + "***" for w in texts[0].split()))
    got = {r.doc_id: r.kept for r in quality.score(table(spark, texts)).collect()}
    assert not got[300] and all(got[i] for i in range(300))


# sharding


def test_sharding(spark, docs, rows):
    for source, config in ((docs, sharding.ShardConfig()), (docs.union(docs), sharding.ShardConfig(shards=3, ranges_per_shard=4))):
        got = sharding.assign(source, config).collect()
        assert len(got) == source.count()
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        texts = dict(rows)
        for shard, own in by.items():
            assert 0 <= shard < config.shards and sorted(r.slot for r in own) == list(range(len(own)))
            for r in own:
                data = (texts[r.doc_id] or "").encode()
                assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "bytes")
        sizes = [sum(r["size"] for r in own) for own in by.values()]
        assert max(sizes) - sum(sizes) / config.shards <= max(r["size"] for r in got) + 1
    assert sharding.assign(empty(spark)).count() == 0
    placed = sharding.shard_rows(docs)
    assert placed.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] and placed.count() == docs.count()


def test_one_large_group_is_split(spark):
    same = table(spark, ["copy of one text"] * 600 + samples(n=20))
    got = sharding.assign(same, sharding.ShardConfig(shards=4, ranges_per_shard=8)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 4 and max(r.b for r in got) < 1.3 * sum(r.b for r in got) / 4


# repeated passages


def plain_repeats(rows):
    seen, found = set(), {}
    for i, value in sorted(rows, key=lambda r: r[0]):
        data = (value or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            part = data[k : k + 100]
            if part in seen:
                gone[k : k + 100] = True
            seen.add(part)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(data) else 0
        found[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return found


@pytest.mark.parametrize("config", [suffix_dedup.SuffixConfig(), suffix_dedup.SuffixConfig(hot_runs=2, array_bytes=500, chunk_runs=300, block_bytes=5000), suffix_dedup.SuffixConfig(hot_runs=2, hot_listed=0, bitmap_bits=8, chunk_runs=300, block_bytes=5000)])
def test_suffix_dedup(spark, docs, rows, config):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(docs, config).collect()}
    assert got == plain_repeats(rows)


def test_suffix_dedup_odd_rows(spark):
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    odd = table(spark, ["y" * 150, "y" * 150, None], [None, 5, 5])
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(odd).collect()) == [(-1, 150, 149), (5, 0, 0), (5, 150, 150)]


@pytest.mark.parametrize("order", [1, -1])
def test_suffix_dedup_repeated_ids(spark, order):
    rng = random.Random(12)
    own = ["".join(rng.choice("abcdefgh") for _ in range(350)) for _ in range(3)]
    texts, ids = [own[0], own[0], own[1], own[2], own[2], own[2] + own[1]], [1, 5, 5, None, None, None]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(table(spark, texts[::order], ids[::order])).collect())
    # of the rows without an id either the joined text or its second half comes first, by a hash of the texts
    lost = sorted(x for x in got if x[0] == -1)
    assert lost in ([(-1, 350, 0), (-1, 350, 350), (-1, 700, 350)], [(-1, 350, 350), (-1, 350, 350), (-1, 700, 0)])
    assert [x for x in got if x[0] != -1] == [(1, 350, 0), (5, 350, 350), (5, 350, 350)]


def plain_factors(raw, starts, length):
    found = []
    for k, s in enumerate(starts):
        best = 0
        for r in starts[:k]:
            n = 0
            while n < length and s + n < len(raw) and r + n < len(raw) and raw[s + n] == raw[r + n]:
                n += 1
            best = max(best, n)
        found.append(best)
    return found


@pytest.mark.parametrize("length", [3, 7, 20, 100])
def test_longest_previous_factors(length):
    rng = np.random.default_rng(length)
    for letters in (1, 2, 4):
        data = rng.integers(97, 97 + letters, 300).astype(np.uint8)
        data[150:260] = data[20:130]
        starts = np.arange(0, 300 - length)
        starts = starts[rng.random(len(starts)) < 0.8]
        assert suffix_dedup.longest_previous_factors(data, starts, length).tolist() == plain_factors(data.tobytes(), starts.tolist(), length)


# mixing


def test_waterfill(spark):
    leaves = [("d0", "en", "a", 100), ("d0", "en", "b", 10), ("d0", "de", "a", 50), ("d1", "en", "c", 1000), (None, None, None, 30)]
    config = mixing.MixConfig(max_epochs=1, weights={"domain": {"d0": 3}, "lang": {}, "source": {}})
    rows = spark.createDataFrame(leaves, "domain string, lang string, source string, n_tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(rows, 300, config).collect()}
    # 3 : 1 : 1 of 300 is 180, 60, 60; d0 holds 160 and the null domain 30, so d1 gets the rest
    assert got == {("d0", "en", "a"): 100, ("d0", "en", "b"): 10, ("d0", "de", "a"): 50, ("d1", "en", "c"): 110, (None, None, None): 30}


def test_mixing_prefixes(spark, docs, rows):
    config = mixing.MixConfig(budget_permille=700, max_epochs=3)
    got = mixing.select(docs, config).collect()
    leaves = collections.defaultdict(list)
    for r in mixing.tokens(docs, config).collect():
        leaves[r.domain, r.lang, r.source].append((r.doc_id, r.n_tokens))
    budget = {(r.domain, r.lang, r.source): r.budget for r in got}
    taken = collections.Counter((r.doc_id, r.epoch) for r in got)
    assert all(n == 1 for n in taken.values())
    for leaf, own in leaves.items():
        left, total = budget.get(leaf, 0), sum(n for _, n in own)
        expected = set()
        for epoch in range(config.max_epochs):
            if left >= total:
                expected |= {(i, epoch) for i, _ in own}
                left -= total
                continue
            for h, i, n in sorted((hashlib.md5(f"{config.seed}:{epoch}:{i}".encode()).hexdigest(), i, n) for i, n in own):
                if n > left:
                    break
                left -= n
                expected.add((i, epoch))
            break
        if leaf in budget:
            assert {k for k in taken if k[0] in {i for i, _ in own}} == expected
    assert mixing.select(empty(spark), config).count() == 0
    assert mixing.mix(docs, config).columns == docs.columns and mixing.mix(docs, config).count() == len(got)


# personal data


def test_pii_round_trip_and_checks(spark):
    value = "a card 4111 1111 1111 1111, not one 4111111111111112; call +1 (415) 555-0142 or mail Jo.Doe7@example.com on 2024-02-29, ip 192.168.0.1, id 123-45-6789"
    new, found = pii.pseudonymise(value, b"k")
    assert [k for k, _, _ in found] == ["card", "phone", "email", "date", "ip", "ssn"] and "4111111111111112" in new
    assert pii.luhn(re.sub(r"\D", "", found[0][2])) and len(new) >= len(value) - 12
    assert pii.pseudonymise(new, b"k", forward=False)[0] == value
    got = pii.replace(table(spark, [value, None, "", "x " + value]), KEYED).orderBy("doc_id").collect()
    assert got[1].text is None and got[1].n_found == 0 and got[2].text == "" and got[0].pseudonyms == got[3].pseudonyms
    assert pii.replace(empty(spark), KEYED).count() == 0


def plain_finds(value):
    """Finds by trying every stretch of a text against every rule, one rule after another."""
    taken = []
    for kind, pattern, make in pii._PATTERNS:
        at = 0
        while at < len(value):
            ends = [b for b in range(at + 1, len(value) + 1) if pattern.fullmatch(value, at, b) and pattern.match(value, at) and pattern.match(value, at).end() == b]
            if ends:
                if not any(at < b and a < ends[0] for a, b, *_ in taken) and (new := make(value[at : ends[0]], b"k", True)) is not None:
                    taken.append((at, ends[0], kind, value[at : ends[0]], new))
                at = ends[0]
            else:
                at += 1
    return sorted(taken)


def test_pii_against_every_stretch():
    rng = random.Random(9)
    good = ["4111 1111 1111 1111", "5500000000000004", "+1 (415) 555-0142", "(415) 555-0142", "jo@ex.org", "2024-02-29", "31.12.1999", "10.0.0.255", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "d41d8cd98f00b204e9800998ecf8427e"]
    bad = ["4111 1111 1111 1112", "2023-02-30", "300.1.1.1", "000-12-3456", "GB82 WEST 1234 5698 7654 33", "+1 23", "jo@", "12345678901234567890", "1.2.3.4.5"]
    for _ in range(40):
        value = rng.choice([" ", ", ", " x", "/"]).join(rng.choice(good + bad + ["word"]) for _ in range(6))
        new, found = pii.pseudonymise(value, b"k")
        expected = plain_finds(value) if pii._HINT.search(value) else []
        assert found == [x[2:] for x in expected]
        assert pii.pseudonymise(new, b"k", forward=False)[0] == value or any(k == "date" for k, _, _ in found)


def test_pii_time_grows_with_the_finds():
    seconds = []
    for n in (2000, 8000):
        value = " ".join(f"user{i}@mail.example.com" for i in range(n))
        pii.pseudonym.cache_clear()
        began = time.process_time()
        assert len(pii.pseudonymise(value, b"k")[1]) == n
        seconds.append(time.process_time() - began)
    assert seconds[1] < 9 * seconds[0]


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        f = pii.Feistel(b"k", "t", size)
        image = [f.walk(x) for x in range(size)]
        assert sorted(image) == list(range(size)) and [f.walk(y, False) for y in image] == list(range(size))


# language model


def small_model(seed=0, n_ids=9):
    """A model over a few ids with weights drawn at random."""
    config = attention_lm.LmConfig(inputs=7, groups=4, width=4, hidden=3, window=8, stride=5)
    rng = np.random.default_rng(seed)
    vocabulary = attention_lm.Vocabulary.of(rng.integers(0, 50, n_ids), config)
    flat = rng.normal(0, 0.5, sum(math.prod(s) for s in attention_lm.shapes(config).values()))
    return config, vocabulary, flat, rng


def test_gradient():
    config, vocabulary, flat, rng = small_model()
    inputs, ids, live = rng.integers(0, 7, (2, 6)), rng.integers(0, 9, (2, 6)), rng.random((2, 6)) < 0.8

    def loss(x):
        p = attention_lm.unpack(x, config)
        z, _ = attention_lm.forward(p, inputs)
        return -attention_lm.log_probabilities(p, z[live], ids[live], vocabulary).mean()

    g = attention_lm.gradient(attention_lm.unpack(flat, config), inputs, ids, live, vocabulary)
    made = np.concatenate([g[n].ravel() for n in attention_lm.shapes(config)])
    for i in range(len(flat)):
        step = np.zeros(len(flat))
        step[i] = 1e-4
        assert made[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-4, abs=2e-3)


def test_probabilities_sum_to_one():
    for seed in range(5):
        config, vocabulary, flat, rng = small_model(seed)
        p = attention_lm.unpack(flat, config)
        z = rng.normal(0, 2, (3, config.width))
        total = sum(np.exp(attention_lm.log_probabilities(p, z, np.full(3, i), vocabulary)) for i in range(9))
        assert total == pytest.approx(np.ones(3), abs=1e-6)


def plain_token_score(p, vocabulary, config, context, target):
    """Natural log probability of one id after a few inputs, one number at a time."""
    d = config.width
    x = [p["embed"][c] + p["place"][k] for k, c in enumerate(context)]
    rows = [v @ p["qkv"] for v in x]
    weights = [math.exp(float(rows[-1][:d] @ r[d : 2 * d]) / math.sqrt(d)) for r in rows]
    y = x[-1] + sum(w * r[2 * d :] for w, r in zip(weights, rows)) / sum(weights) @ p["o"]
    z = y + np.maximum(y @ p["up"] + p["up_bias"], 0) @ p["down"]
    groups = [math.exp(v) for v in z @ p["group"] + p["group_bias"]]
    group = int(vocabulary.group_of[target])
    found = math.log(groups[group] / sum(groups))
    if group == config.groups - 1:
        return found + vocabulary.log_share[target]
    first, last = vocabulary.bounds[group : group + 2]
    own = [math.exp(v) for v in p["slot"][first:last] @ z + p["slot_bias"][first:last]]
    return found + math.log(own[vocabulary.slot_of[target]] / sum(own))


def test_windowed_scores_are_those_of_one_token_at_a_time():
    config, vocabulary, flat, rng = small_model(3)
    p = attention_lm.unpack(flat, config)
    ids, begin = rng.integers(0, 9, 60), np.array([0, 1, 9, 17, 18, 48, 60])
    got = attention_lm.token_scores(ids, begin, p, vocabulary, config)
    for a, b in zip(begin[:-1], begin[1:]):
        inputs = [1, *vocabulary.input_of[ids[a : b - 1]]]
        for k in range(b - a):
            window = 0 if k < config.window else (k - config.window) // config.stride + 1
            context = inputs[window * config.stride : k + 1]
            assert got[a + k] == pytest.approx(plain_token_score(p, vocabulary, config, context, ids[a + k]), abs=1e-6)


def test_subwords_are_those_of_the_tokenizer():
    config = attention_lm.LmConfig(piece=7)
    subwords, encoder = attention_lm.Subwords(config), attention_lm._encoder(config.tokenizer_dir, config.tokenizer, 7)[0]
    subwords.BITS = 3  # so that many words have one place
    subwords.forget()
    for seed in range(3):
        texts = [t or "" for t in samples(seed, 12)]
        block = next(text.blocks(pa.array(texts), 1 << 30))
        w, ids, begin = attention_lm.text_ids(block, subwords, -5)
        for k, t in enumerate(texts):
            own = [i for x in VISIBLE.findall(lower(t)) for i in encoder.encode_ordinary(" " + x)]
            assert ids[begin[k] : begin[k + 1]].tolist() == [*own, -5]


def test_model_beats_word_shares_on_held_out_texts(spark):
    rng = random.Random(4)
    # each word follows from the one before it but for one in ten: shares of words say nothing of that
    words, texts = ["river", "stone", "green", "seven", "under", "light", "paper", "music", "ocean", "tiger"], []
    for _ in range(400):
        k, own = rng.randrange(10), []
        for _ in range(100):
            k = (k + 3) % 10 if rng.random() < 0.9 else rng.randrange(10)
            own.append(words[k])
        texts.append(" ".join(own))
    held = attention_lm.score_held_out(table(spark, texts).coalesce(2), attention_lm.LmConfig()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.6 * held[1]


def test_attention_lm(spark, docs, rows):
    config = attention_lm.LmConfig(min_windows=200, rounds=1)
    got = {r.doc_id: r for r in attention_lm.score_held_out(docs, config).collect()}
    words = {i: VISIBLE.findall(lower(t)) + [None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    counts = collections.Counter(w for i, own in words.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in words.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(base, rel=1e-6) and r.score < 0
    assert attention_lm.score_held_out(empty(spark), config).count() == 0


def test_lm_learns_from_every_id():
    """Windows hold each id of each text once, and each text has its turn in one round, or in several of a small table."""
    config = attention_lm.LmConfig(window=8)
    vocabulary = attention_lm.Vocabulary.of(np.arange(50), config)
    rng = np.random.default_rng(4)
    lengths = np.array([1, 8, 9, 64, 3, 17])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, 50, begin[-1])
    place, live, before = attention_lm.training_windows(ids, begin, vocabulary, config)
    assert sorted(place[live]) == list(range(len(ids)))
    assert all(before[k] == (1 if k in begin[:-1] else vocabulary.input_of[ids[k - 1]]) for k in range(len(ids)))
    config = attention_lm.LmConfig()
    docs = pa.RecordBatch.from_arrays([pa.array([*range(40), None], pa.int64()), pa.array(["one two three"] * 41)], ["doc_id", "text"])
    vocabulary = attention_lm.Vocabulary.of(np.ones(attention_lm.vocabulary_size(config), np.int64), config)
    flat = attention_lm.initial(vocabulary, config)
    for n_rounds, times in ((1, 41), (2, 82), (4, 164)):
        made = [next(attention_lm._train_whole(iter([docs]), flat, vocabulary, config, n_rounds, t)).column("w")[0].as_py() for t in range(config.rounds)]
        assert sum(made) == times and all(0 < n for n in made)
    assert attention_lm.rounds_of_a_text(10**6, 100, config) == 4 and attention_lm.rounds_of_a_text(10**9, 10**5, config) == 1


def test_lm_trains_on_the_ids_that_counting_wrote():
    """Texts are cut into ids once, for counting; training on what was written gives the weights that training on the texts gives."""
    config = attention_lm.LmConfig()
    texts = [*(t for seed in range(2) for t in samples(seed, 20)), None, "", "  ", "x" * 3000]
    docs = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    read = pa.Table.from_batches(attention_lm._count(iter([docs.slice(0, 9), docs.slice(9)]), config)).to_pandas()
    ids = np.zeros(attention_lm.vocabulary_size(config), np.int64)
    ids[read.key[read.kind == 1].astype(int)] = read.n[read.kind == 1]
    written = read[read.kind == 2]
    assert len(written) == len(texts) and sum(map(len, written.ids)) == 2 * ids.sum() and read.ids[read.kind < 2].isna().all()
    assert set(written.n) <= set(range(config.rounds)) and written.n.tolist() == attention_lm.turn_of(docs.column(0), config).tolist()
    vocabulary = attention_lm.Vocabulary.of(ids, config)
    flat = attention_lm.initial(vocabulary, config)
    again = pa.RecordBatch.from_arrays([docs.column(0), pa.array(written.ids.tolist(), pa.binary())], ["key", "ids"])
    for n_rounds, turn in ((4, 0), (1, 2)):
        made = [pa.Table.from_batches(attention_lm._train_whole(iter([b]), flat, vocabulary, config, n_rounds, turn)) for b in (docs, again)]
        assert made[0].num_rows and made[0].equals(made[1])


def test_lm_windows_grow_with_the_texts():
    config = attention_lm.LmConfig()
    doc = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array(["some words " * 9000])], ["doc_id", "text"])
    made = []
    for n_texts in (200, 400, 800):
        per_byte = attention_lm.windows_per_byte(n_texts * 99_000, n_texts, config)
        made.append(per_byte * n_texts * (99_000 + config.window * 5))
    assert made[1] - made[0] == pytest.approx(200 * 99_320 / config.window_bytes) and made[2] - made[1] == pytest.approx(400 * 99_320 / config.window_bytes)
    assert made[0] > 12000 and config.rounds >= 4 and config.inputs >= 2048 and config.window - config.stride >= 16
    vocabulary = attention_lm.Vocabulary.of(np.ones(attention_lm.vocabulary_size(config), np.int64), config)
    flat = attention_lm.initial(vocabulary, config)
    used = [next(attention_lm._train(iter([doc]), flat, vocabulary, config, x, 0)).column("w")[0].as_py() for x in (1e-4, 2e-4)]
    assert abs(used[0] - 9.9) <= 1 and abs(used[1] - 19.9) <= 1


def test_each_token_is_scored_once():
    config = attention_lm.LmConfig(window=8, stride=6)
    begin = np.array([0, 1, 9, 40, 45])
    first, used, fresh = attention_lm.windows_of(begin, config)
    assert sorted(x for a, n, f in zip(first, used, fresh) for x in range(a + f, a + n)) == list(range(45))


# n-gram join


def plain_sets(rows):
    found = {}
    for i, value in rows:
        w = VISIBLE.findall(lower(value))
        found[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return found


def plain_components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_jaccard_join(spark, block):
    rng = random.Random(8)
    texts = samples(seed=5, n=24)
    seedling = [f"w{rng.randrange(200)}" for _ in range(60)]
    for _ in range(40):  # a chain of edits: neighbours link, ends do not
        seedling = list(seedling)
        seedling[rng.randrange(60)] = f"w{rng.randrange(200)}"
        texts.append(" ".join(seedling))
    for n in range(1, 30):
        own = [f"s{n}-{k}" for k in range(n + 3)]
        texts += [" ".join(own), " ".join([*own, "tail"]), " ".join(["head", *own])]
    docs = table(spark, texts)
    sets = plain_sets(list(enumerate(texts)))
    expected = plain_components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, jaccard.JaccardConfig(block_shingles=block)).collect()}
    assert got == {i: (len(sets[i]), expected[i]) for i in sets}


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_jaccard_passage_in_many_texts(spark, block):
    rng = random.Random(13)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for k in range(300):  # all share a passage, which few consist of; a family of near copies of one text, in bands of size
        own = [f"o{k}-{i}" for i in range(rng.randrange(6, 200))]
        texts.append(" ".join(passage + own))
    base = [f"b{i}" for i in range(80)]
    for _ in range(60):
        edited = base[: rng.randrange(66, 81)]
        edited[rng.randrange(len(edited))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    texts += [" ".join(passage), " ".join([*passage, "x"]), " ".join(passage[:52])]
    sets = plain_sets(list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in jaccard.join(table(spark, texts), jaccard.JaccardConfig(block_shingles=block, chunk_shingles=3000, column_bytes=20_000, pivots=4)).collect()}
    assert got == plain_components(sets)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_prefixes_of_linked_sets_meet(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        one = rng.choice(80, n, replace=False).astype(np.uint64)
        other = np.unique(np.where(rng.random(n) < 0.1, rng.integers(100, 200, n), one)).astype(np.uint64)
        other = other[: max(1, len(other) - int(rng.integers(0, 4)))]
        overlap = len(np.intersect1d(one, other))
        rank = np.random.default_rng(1).permutation(200)
        keys = []
        for own in (one, other):
            shared = np.intersect1d(one, other)  # what nobody else has comes first and is not listed
            listed = shared[np.argsort(rank[shared.astype(int)])]
            keys.append(jaccard.prefix_keys(len(own), listed, percent) if 100 * len(listed) >= percent * len(own) else np.zeros(0, np.uint64))
        if 100 * overlap >= percent * (len(one) + len(other) - overlap):
            assert len(np.intersect1d(*keys))


def test_jaccard_keep_first_is_one_row_whatever_the_order(spark):
    texts, ids = ["b " * 9, "a " * 9, "a " * 9, "c d e f g h"], [3, 3, 3, 9]
    kept = {tuple((r.doc_id, r.text) for r in jaccard.keep_first(table(spark, texts[::o], ids[::o])).orderBy("doc_id").collect()) for o in (1, -1)}
    assert kept == {((3, "a " * 9), (9, "c d e f g h"))}


def test_jaccard_odd_rows(spark):
    odd = table(spark, ["a b c d e", "a b c d e", "a b c d e", None], [None, 4, 4, 4])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.join(odd).collect()) == [(-1, -1), (4, 4), (4, 4), (4, 4)]
    assert jaccard.join(empty(spark)).count() == 0
    assert jaccard.keep_first(odd).count() == 2 and jaccard.keep_first(odd).columns == odd.columns


@pytest.mark.parametrize("block", [1_000_000, 100])
def test_jaccard_repeated_ids(spark, block):
    texts, ids = [], []
    for k in range(8):  # rows of one doc_id with different texts, each with a near copy of a larger doc_id
        for c in range(3):
            own = [f"{c}w{k}-{i}" for i in range(60)]
            texts += [" ".join(own), " ".join([*own, "tail"])]
            ids += [k, 100 + 10 * k + c]
    for order in (1, -1):
        got = jaccard.join(table(spark, texts[::order], ids[::order]), jaccard.JaccardConfig(block_shingles=block)).collect()
        assert len(got) == 48 and all(r.component_id == (r.doc_id if r.doc_id < 100 else (r.doc_id - 100) // 10) for r in got)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}
    for a, b in links:
        for x in (a, b):
            up.setdefault(x, {x})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    assert got == {x: min(s) for x, s in up.items() if len(s) > 1}


# archives


def test_warc_round_trip(spark):
    rng = random.Random(6)
    noise = ["".join(chr(rng.randrange(32, 0x250)) for _ in range(rng.randrange(3000))) for _ in range(80)]
    pages = noise + noise[:20] + [None, "", "short", "short", "\x1f\x8b\x08 not a member" * 100]
    df = spark.createDataFrame([(i, f"http://e/{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, digest string")
    keepers = {}
    for i, p in enumerate(pages):
        data = (p or "").encode()
        if len(data) >= 1000:
            keepers[data] = i
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    for i, p in enumerate(pages):
        data = (p or "").encode()
        keeper = keepers.get(data, i)
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "response" if keeper == i else "revisit", None if keeper == i else keeper)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_files_are_plain_gzip(spark, tmp_path):
    pages = [(i, "http://e/x", p) for i, p in enumerate(["text " * 300, "text " * 300, None, "short", "é" * 9_000_000])]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w", "2021-02-03T04:05:06Z")
    [file] = (tmp_path / "w").glob("*.warc.gz")
    run = subprocess.run(["gzip", "-dc", file], capture_output=True, check=True)
    assert run.stderr == b"" and run.stdout.count(b"WARC/1.1\r\n") == 6 and run.stdout.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert run.stdout.count(b"WARC-Date: 2021-02-03T04:05:06Z") == 6 and ("é" * 9_000_000).encode() in run.stdout
    assert sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w", 1000).collect()) == [(0, 1500, 1), (1, 1500, None), (2, 0, None), (3, 5, None), (4, 18_000_000, None)]


def test_warc_of_other_writers(spark, tmp_path):
    """Records that this writer does not make are read, and bad ones have a row that says what is wrong."""
    body, page = b"<p>hello</p>", hashlib.sha1(b"<p>hello</p>").digest()

    def made(fields, block, stated=None):
        head = ["WARC/1.0", *fields, f"Content-Length: {len(block) if stated is None else stated}"]
        return warc.member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    plain = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;a=b\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    base32 = "WARC-Payload-Digest: sha1:" + base64.b32encode(page).decode()
    data = b"".join([
        made(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:0>"], b"GET / HTTP/1.1\r\n\r\n"),
        made(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", base32], plain),
        made(["warc-type:response", "warc-record-id:<urn:uuid:2>", base32], chunks),
        made(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:3>", "WARC-Payload-Digest: md5:" + hashlib.md5(body).hexdigest()], plain),
        made(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:4>", "WARC-Payload-Digest: odd:zz"], b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n" + body),
        made(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:5>", base32], b"dns answer"),
        made(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:6>", base32], plain, len(plain) + 50),
        made(["WARC-Type: response"], plain, "many"),
        made(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:8>", base32, "WARC-Refers-To: <urn:uuid:1>"], b"HTTP/1.1 200 OK\r\n\r\n"),
        made([], plain),
        made(["WARC-Type: response", "WARC-Record-ID: <urn:page:9>", base32], b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\n" + body),
    ])
    (tmp_path / "x.warc.gz").write_bytes(data)
    rows = warc.read(spark, f"file://{tmp_path}", 300).collect()
    got = {r.record_id: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bool(r.error)) for r in rows}
    good = (None, 12, page.hex(), "response", None, False)
    assert len(rows) == len(got) == 9 and all(got[f"<urn:uuid:{k}>"] == good for k in (1, 2, 3, 4))
    assert got["<urn:uuid:5>"][1:2] == (10,) and got["<urn:uuid:5>"][5] and got["<urn:uuid:6>"][5]
    assert got[None] == (None, None, None, "response", None, True)
    assert got["<urn:uuid:8>"] == (None, None, page.hex(), "revisit", None, False)
    assert got["<urn:page:9>"] == (9, 12, page.hex(), "response", None, True)


def test_warc_null_and_repeated_keys(spark):
    rows = [(None, "u", "p" * 2000), (7, "u", "p" * 2000), (7, "u", "p" * 2000), (None, "u", "q"), (7, "u", None)]
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(-1, 1, "response", None), (-1, 2000, "revisit", 7), (7, 0, "response", None), (7, 2000, "response", None), (7, 2000, "response", None)]


@pytest.mark.parametrize("size", [97, 1000, 4096, 10**7])
def test_warc_ranges_own_each_record_once(size):
    rng = random.Random(size)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(2500))) + warc.MAGIC for _ in range(40)]
    data = b"".join(warc.member(warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), len(p), None, "2020-01-01T00:00:00Z")) for i, p in enumerate(payloads))
    file = pa.PythonFile(io.BytesIO(data), mode="r")
    found = [warc.parse(r)["page_id"] for a in range(0, len(data), size) for r in warc.records_from(file, len(data), a, min(len(data), a + size))]
    assert found == list(range(40))


# decontamination


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination(spark, docs, rows, block):
    rng = random.Random(12)
    texts = dict(rows)
    items = [(k, " ".join((texts[4 * k] or "x").split()[:n])) for k, n in enumerate((30, 9, 1, 10, 11))] + [(10, None), (11, " .. "), (2, "zzz"), (12, "Same LINE same")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.hits(docs, benchmark, decontamination.DecontaminationConfig(block_windows=block)).collect()}
    windows = collections.defaultdict(set)
    for k, value in items:
        w = ALNUM.findall(lower(value))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(k))
    for i, value in rows:
        w, hit, found = ALNUM.findall(lower(value)), set(), set()
        for window, own in windows.items():
            for a in range(len(w) - len(window) + 1):
                if tuple(w[a : a + len(window)]) == window:
                    hit |= set(range(a, a + len(window)))
                    found |= own
        assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    clean = decontamination.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, r in got.items() if not r[4])
    assert decontamination.hits(empty(spark), benchmark).count() == 0
    assert decontamination.hits(docs, benchmark.limit(0)).where("contaminated").count() == 0
    del rng


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_repeated_ids(spark, block):
    first, second = (" ".join(f"{c}{k}" for k in range(12)) for c in "pq")
    texts = [f"x {first} y", "clean text", second, f"{first} {second}", "clean", None, first, first]
    docs = table(spark, texts, [7, 7, 7, None, None, None, 8, 8])
    benchmark = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    got = decontamination.hits(docs, benchmark, decontamination.DecontaminationConfig(block_windows=block)).collect()
    one, two, both, none = (decontamination.items_digest(x) for x in (["1"], ["2"], ["1", "2"], []))
    expected = [(7, 14, 12, 1, one, True), (7, 2, 0, 0, none, False), (7, 12, 12, 1, two, True), (None, 24, 24, 2, both, True)]
    expected += [(None, 1, 0, 0, none, False), (None, 0, 0, 0, none, False), (8, 12, 12, 1, one, True), (8, 12, 12, 1, one, True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_decontamination_blocks_are_bounded(spark):
    """Long items, of whatever characters between their words, are parted; every window is in one block, and rows do not depend on the blocks."""
    rng = random.Random(5)
    own = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    items = [("dots", ".".join(own[:1500])), ("hyphens", "-".join(own[1000:2500])), ("short", "W1.w2"), ("none", "..."), (None, " ".join(own[2500:2520])), ("null", None)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for size in (1, 7, 100, 10_000):
        config = decontamination.DecontaminationConfig(block_windows=size)
        blocks = list(decontamination._item_blocks(benchmark, config))
        found = [(row["item_id"], tuple(w[i : i + 10])) for b in blocks for row in b for w in [ALNUM.findall(lower(row["text"]))] for i in range(max(1, len(w) - 9))]
        plain = [(item, tuple(w[i : i + 10])) for item, t in items for w in [ALNUM.findall(lower(t))] if w for i in range(max(1, len(w) - 9))]
        assert sorted(found, key=repr) == sorted(plain, key=repr)
        assert all(sum(max(1, len(ALNUM.findall(lower(row["text"]))) - 9) for row in b) <= size for b in blocks)
        assert size != 100 or len(blocks) <= 2 * 3000 // 100 + 3
    docs = table(spark, [" ".join(own), " ".join(own[95:106]), " ".join(own[:9]), "w1 w2 w3 " + " ".join(own[2500:2512]), None])
    rows = []
    for size in (400, 10_000):
        config = decontamination.DecontaminationConfig(block_windows=size)
        rows.append(sorted(map(tuple, decontamination.hits(docs, benchmark, config).collect())))
    assert rows[0] == rows[1] and [r[2:4] for r in rows[0]] == [(2520, 2), (11, 1), (0, 0), (14, 1), (0, 0)]


# licenses


def test_licenses(spark):
    texts = ["x Released under the MIT License. y mit license", None, "", "Licensed under CC BY-NC 4.0", "mit", "General  public-LICENSE", "words only", "Licensed as it is under the Apache License, Version 2.0. Apache License"]
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    assert [(got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels) for i in range(8)] == [
        (9, 2, 4, 7, "mit", "mit"), (0, 0, None, None, "", ""), (0, 0, None, None, "", ""), (7, 0, None, None, "", "cc-by-nc"), (1, 0, None, None, "", ""),
        (3, 1, 0, 0, "gpl", "gpl"), (2, 0, None, None, "", ""), (13, 2, 6, 11, "apache", "apache"),
    ]
    assert got[0].score == 1.0 and got[6].score == 0.0 and all(0 <= r.score <= 1 for r in got.values())
    assert licenses.scan(empty(spark)).count() == 0


# words


def test_words_and_hashes(rows):
    for kind, pattern in (("visible", VISIBLE), ("alnum", ALNUM)):
        for size in (1, 50, 1 << 20):
            hashes = {}
            for block in text.blocks(pa.array([t for _, t in rows], pa.string()), size):
                w = text.words(block, kind)
                for k in range(len(block)):
                    own = pattern.findall(lower(rows[block.first + k][1]))
                    got = w.hashes[w.of_text[k] : w.of_text[k + 1]].tolist()
                    assert len(own) == len(got)
                    for a, b in zip(own, got):
                        assert hashes.setdefault(a, b) == b
            assert len(set(hashes.values())) == len(hashes)


def plain_license_labels(value):
    """Base figures by counting, and the labels of templates that stand in the text word for word."""
    w = ALNUM.findall(lower(value))
    places = sorted((i, label) for label, phrase in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    whole = {label for label, t in licenses.TEMPLATES for own in [ALNUM.findall(lower(t))] if any(w[i : i + len(own)] == own for i in range(len(w)))}
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})), whole


def test_licenses_against_a_plain_scan(spark):
    rng = random.Random(3)
    noise = ["lorem", "license", "mit", "general", "public", "apache", "under", "the", "software", "licensed", "cc", "by", "4"]
    texts = []
    for k, (label, template) in enumerate(licenses.TEMPLATES * 2):
        around = [" ".join(rng.choice(noise) for _ in range(rng.randrange(30))) for _ in range(2)]
        texts.append(f"{around[0]} zzz {template}. zzz {around[1]}")
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, value in enumerate(texts):
        n, n_base, first, last, base, whole = plain_license_labels(value)
        r, label = got[i], (licenses.TEMPLATES * 2)[i][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base)
        assert label in r.labels.split(",") and set(r.labels.split(",")) <= whole | set(base.split(",")) and r.score == 1.0


def test_licenses_near_misses(spark):
    texts = [
        "licensed under CC licensed under CC licensed under CC",  # one run of the template, three times
        "cc by 4 cc by 4 cc by 4 zzz",
        "Licensed under CC BY 4.0",
        "Licensed under CC BY-NC 4.0",  # not cc-by, which is in it
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Permission to use, copy, and/or distribute this nice software for any purpose with or without fee is hereby granted",  # a word put in, one left out
        "granted hereby is fee without or with purpose any for software this distribute and or modify copy use to permission",  # the words, not in order
        "permission to use is granted for any purpose",
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(table(spark, texts)).collect()}
    assert [got[i][0] for i in range(8)] == ["", "", "cc-by", "cc-by-nc", "cc-by-sa", "isc", "", ""]
    assert got[0][1] == got[6][1] == 0 and got[3][1] == 1 and 0.75 <= got[5][1] < 1


def test_licenses_of_like_wording(spark):
    """Relatives of a template are their own license or none, and a denied one is none."""
    cc = "This work is{} licensed under a Creative Commons Attribution{} 4.0 International License"
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation"
    cases = [
        ("Licensed under the Academic Free License, Version 2.0", "afl"),
        (cc.format("", "-NoDerivatives"), "cc-by-nd"),
        (cc.format("", "-NonCommercial-ShareAlike"), "cc-by-nc-sa"),
        (gnu.format("Affero"), "agpl,gpl"),  # gpl by the base phrase, which stays
        (gnu.format("Library").replace("program", "library"), "gpl,lgpl"),
        (cc.format(" NOT", ""), ""),
        ("It is not licensed under CC BY 4.0", ""),
        ("It was never yet licensed under CC BY 4.0", ""),
        ("Of the rest we do not speak here. Licensed under CC BY 4.0", "cc-by"),
        (cc.format("", ""), "cc-by"),
        ("Released under the MIT terms", "mit"),
        ("Released under the Apache terms", ""),
        ("Licensed under the Artistic License, Version 2.0", "artistic"),
        ("Licensed under the Made-Up License, Version 2.0", ""),
        (gnu.format("").replace("free software", "quite free and open and useful software"), "gpl"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(table(spark, [t for t, _ in cases])).collect()}
    assert [got[i][0] for i in range(len(cases))] == [label for _, label in cases]
    assert all((got[i][1] > 0) == (label not in ("", "gpl") or i == 14) for i, (_, label) in enumerate(cases))


def test_licenses_with_words_put_in_and_changed(spark):
    """A word put in or changed away from the edges of a template costs the share what plain arithmetic says, whatever joins the library to the texts."""
    rng, texts, expected = random.Random(8), [], []
    long = [(label, ALNUM.findall(lower(t))) for label, t in licenses.TEMPLATES if len(ALNUM.findall(lower(t))) >= 8]
    names = {word for words in licenses.NAMES for word in words}
    for label, own in long:
        for change in ("put in", "changed"):
            at = [i for i in range(3, len(own) - 3) if own[i] not in names and len(own) - i - 1 >= 3]
            if not at:
                continue
            i = rng.choice(at)
            texts.append(" ".join(["zzz", *own[:i], "qqq", *own[i + (change == "changed") :], "zzz"]))
            expected.append((label, len(own) / (len(own) + 1) if change == "put in" else (len(own) - 1) / len(own)))
    for config in (licenses.LicenseConfig(), licenses.LicenseConfig(broadcast_grams=0)):
        got = {r.doc_id: r for r in licenses.scan(table(spark, texts), config).collect()}
        assert len(got) == len(texts) > 30
        for i, (label, share) in enumerate(expected):
            assert label in got[i].labels.split(",") and got[i].score >= share - 1e-12, (texts[i], got[i])


def test_licenses_ties():
    config = licenses.LicenseConfig(templates=(("one", "a b c d"), ("two", "a b c d")))
    spans = [(*s, label) for label in ("one", "two") for s in licenses.verified_spans([(5, 0), (6, 1)], 4, config)]
    assert {s[4] for s in licenses.chosen(spans)} == {"one", "two"}


# very long texts, names that differ by case


def test_one_text_longer_than_every_block(spark):
    rng = random.Random(21)
    words = [f"w{rng.randrange(5000)}" for _ in range(450_000)]  # 2.5 MB, more than any block of texts
    long = " ".join(words)
    other = " ".join(words[:400_000] + ["tail"] * 10)
    few = table(spark, [long, other, "short text"], [1, 2, 3])
    assert {r.doc_id: r.component_id for r in jaccard.join(few).collect()} == {1: 1, 2: 1, 3: 3}
    repeated = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(few).collect()}
    shared = len(" ".join(words[:400_000])) + 1
    assert repeated[1] == (len(long), 0) and repeated[3] == (10, 0) and shared <= repeated[2][1] <= shared + 5
    benchmark = spark.createDataFrame([("a", " ".join(words[300_000:300_030]))], "item_id string, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.hits(few, benchmark).collect()}
    assert hit == {1: (450_000, 30), 2: (400_010, 30), 3: (2, 0)}
    found = {r.doc_id: (r.n_words, r.labels) for r in licenses.scan(table(spark, [long + " Released under the MIT License"], [1])).collect()}
    assert found == {1: (450_005, "mit")}
    scored = {r.doc_id: r.n_tokens for r in attention_lm.score_held_out(few, attention_lm.LmConfig(rounds=1, min_windows=50)).collect()}
    assert scored == {1: 450_001, 2: 400_011, 3: 3}
