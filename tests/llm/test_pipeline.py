import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import ALNUM, VISIBLE, lower, plain_measures, samples

from webloom.llm import decontamination, jaccard, mixing, quality


def test_stages(spark, tmp_path):
    texts = samples(seed=21, n=80)
    rows = [(i, t, ("en", "de")[i % 2], f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(texts[1].split()[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    def run_stage(k, docs):
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        return spark.read.parquet(str(tmp_path / f"stage{k}"))

    first = run_stage(0, docs)
    assert first.columns == docs.columns and ids(first) == ids(quality.score(docs).where("kept"))
    second = run_stage(1, first)
    assert second.columns == docs.columns and ids(second) == ids(jaccard.join(first).where("doc_id = component_id"))
    third = run_stage(2, second)
    bad = decontamination.hits(second, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("NOT contaminated")
    assert third.columns == docs.columns and ids(third) == ids(bad)
    fourth = run_stage(3, third)
    assert fourth.columns == docs.columns and ids(fourth) == ids(mixing.select(third))
    last = run_stage(4, fourth)
    assert ids(last) == ids(fourth) and last.groupBy("shard").agg((F.max("slot") - F.count("*") + 1).alias("gap")).where("gap <> 0").count() == 0
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == ids(last)


def test_near_duplicates_of_five_words(spark, tmp_path):
    words = [f"w{k}" for k in range(470)]
    edited = [f"new{k}" if k % 47 == 20 else w for k, w in enumerate(words)]  # five-word similarity 416 of 516, four-word 427 of 507
    rows = [(1, " ".join(words), "en", "s", 0), (2, " ".join(edited), "en", "s", 0), (3, " ".join(f"x{w}" for w in words), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3]


def plain_shingles(value, n):
    w = VISIBLE.findall(lower(value))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_first_of_groups(rows):
    """Of rows (doc_id, text) linked by five words and 0.8, or by their id, the one of the smallest id; of equal ids the smallest text; all without an id."""
    named = [r for r in rows if r[0] is not None]
    sets, up = [plain_shingles(t, 5) for _, t in named], list(range(len(named)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            same = sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or named[a][0] == named[b][0])
            if same:
                up[find(a)] = find(b)
    least = {}
    for k, row in enumerate(named):
        least[find(k)] = min(least.get(find(k), row), row)
    return sorted(least.values()) + [r for r in rows if r[0] is None]


def plain_is_clean(value, items):
    w = ALNUM.findall(lower(value))
    for item in items:
        own = ALNUM.findall(lower(item))
        windows = [own[i : i + 10] for i in range(max(1, len(own) - 9))] if own else []
        if any(w[i : i + len(x)] == x for x in windows for i in range(len(w) - len(x) + 1)):
            return False
    return True


def test_run_against_plain_stages(spark, tmp_path):
    texts = [t for t in samples(seed=33, n=60) if t is None or len(t) < 3000]
    ids = [None if k % 29 == 5 else k - 1 if k % 31 == 7 else k for k in range(len(texts))]
    rows = [(i, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 6 else None, len(t or ""), "x", True, k, 1) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += rows[10:14]  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, shard long, class int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    items = [" ".join(texts[k].split()[5:30]) for k in (1, 9)] + [None, "", "one two"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, pair = spark.read.parquet(str(tmp_path / "documents.parquet")), lambda df: [(r.doc_id, r.text) for r in df.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")

    def stage(k, docs):
        corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"plain{k}"))
        return spark.read.parquet(str(tmp_path / f"plain{k}"))

    first = stage(0, docs)
    assert first.columns == docs.columns and not any(plain_measures(t)[-1] for _, t in pair(first))
    second = stage(1, first)
    assert second.columns == docs.columns and sorted(pair(second), key=key) == sorted(plain_first_of_groups(pair(first)), key=key)
    third = stage(2, second)
    assert third.columns == docs.columns and sorted(pair(third), key=key) == sorted([r for r in pair(second) if plain_is_clean(r[1], items)], key=key)
    fourth = stage(3, third)
    assert fourth.columns == docs.columns and set(pair(fourth)) <= set(pair(third))
    last = stage(4, fourth)
    assert sorted(pair(last), key=key) == sorted(pair(fourth), key=key)


def test_stages_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
