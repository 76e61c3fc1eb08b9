"""The near-duplicates stage of the pipeline on small fixtures."""

import random

import corpus_pipeline
from ledgerline.llm import op5_simhash, similar

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)


def texts():
    """Families of edited texts, at all similarities about 0.8."""
    rng = random.Random(3)
    out = []
    for family in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((7, 40, 150)))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return [*out, "one", "One", "", "  "]


def test_near_copies_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    least = list(range(len(rows)))
    for _ in rows:
        least = [min(least[j] for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
    assert {i for i, _ in kept(spark, rows)} == set(least)
    assert len(set(least)) < len(rows) - 20


def test_links_of_a_bucket_beyond_its_neighbours_are_found(spark):
    """With all shingles frequent, the order still loses no pair."""
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in enumerate(texts() * 5)], SCHEMA)
    found = {r.h for r in similar.similar(docs).collect()}
    assert found == {r.h for r in similar.similar(docs.dropDuplicates(["text"])).collect()}


def test_shares_of_large_buckets_lose_no_link(spark):
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in enumerate(texts())], SCHEMA)
    whole, dealt = ({(r.h, r.root) for r in similar.similar(docs, bucket=b).collect()} for b in (similar.BUCKET, 2))
    assert whole == dealt and whole


def test_shares_and_bands_of_the_second_pass_lose_no_pair(spark):
    """Shares of three rows, and every bucket a large one: the same links as with none."""
    docs = spark.createDataFrame([(i, t, "s", "en", 0) for i, t in enumerate(texts())], SCHEMA)
    plain, dealt = ({(r.h, r.root) for r in similar.similar(docs, small=n, share=m).collect()} for n, m in ((10**6, 10**6), (0, 3)))
    assert plain == dealt and plain


def test_rows_meet_once_in_bands_and_shares(spark):
    rng = random.Random(9)
    rows = [(1, h, rng.choice((0, 1, 4, 5, 8, 10, 80, 100, 101, 125)), 4) for h in range(60)]
    frame = similar.dealt(spark.createDataFrame(rows, "g long, h long, n int, parts int"), 0.8)
    met = [(r.a, r.b) for r in frame.alias("x").join(frame.alias("y"), similar.meet_once()).selectExpr("x.h a", "y.h b").collect()]
    close = {(a, b) for _, a, n, _ in rows for _, b, m, _ in rows if min(n, m) >= 0.8 * max(n, m)}
    assert len(met) == len(set(met)) and close <= set(met)


def test_null_and_repeated_ids_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (8, c), (None, None), (9, "")]
    out = kept(spark, rows)
    assert out == sorted([(None, a), (None, b), (7, c), (7, d), (9, "")], key=str)


def test_fingerprints_of_op5_give_the_first_candidates(spark):
    """Their components are those of op5's operator on the same shingles."""
    rng = random.Random(5)
    rows = []
    for family in range(5):
        base = [f"w{rng.randrange(10**5)}" for _ in range(2000)]
        rows += [" ".join([*base[:k], f"e{k}", *base[k:]]) for k in range(4)]
    rows += rows[:3] + ["", "  ", "one"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    texts = docs.select("doc_id", similar.row_key("text").alias("h"), "text").cache()
    with similar.scratch(spark) as staged:
        pairs = [(r.a, r.b) for r in similar.fingerprint_pairs(texts.select("h", "text"), 5, staged).collect()]
    root = {r.h: r.h for r in texts.collect()}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    ids = {r.doc_id: r.component_id for r in op5_simhash.near_duplicates(docs, width=5).collect()}
    of = {r.doc_id: root[r.h] for r in texts.collect()}
    assert all((of[i] == of[j]) == (ids[i] == ids[j]) for i in of for j in of)
    assert pairs and all(a < b for a, b in pairs) and len(set(ids.values())) < len(rows) - 5


def test_frequent_shingles_come_from_a_fixed_share_of_different_texts(spark, monkeypatch):
    """A smaller share of a larger table would let the buckets grow with it; copies make no shingle frequent."""
    monkeypatch.setattr(similar, "SAMPLE", 1)
    rows = [f"a b c d e {i} f g h" for i in range(100)] + ["copied words of one text here"] * 50
    texts = spark.createDataFrame([(t,) for t in rows], "text string").select(similar.row_key("text").alias("h"), "text")
    g, n, rate = similar.frequent(texts, 5)
    assert rate == similar.RATE
    assert g.tolist() == similar.shingle_set("a b c d e", 5).tolist() and n[0] <= 100


def test_no_task_of_the_first_candidates_has_two_python_steps(spark):
    """Each such step has a worker of its own, which stays."""
    texts, steps = spark.createDataFrame([(i, f"a b c d e {i % 3}") for i in range(9)], "h long, text string"), []

    def staged(df, name="step"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        for stage in plan.split("Exchange"):
            steps.append(stage.count("MapInPandas") + stage.count("ArrowEvalPython"))
        return df.localCheckpoint()

    assert len(similar.fingerprint_pairs(texts, 5, staged).collect()) >= 2
    assert max(steps) == 1
