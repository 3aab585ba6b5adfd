"""Stages of the pipeline on small tables."""

import random

import corpus_pipeline
from marketlens.llm import neardup


def test_near_duplicates_from_80_percent(spark):
    """Pairs at a similarity of 0.80 up to under 0.85, by brute force: of n words c in the middle are replaced one after another."""
    rng = random.Random(8)
    rows = []
    for i in range(200):
        n = rng.choice([60, 104, 304, 1004])
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        shingles = n - 4
        lost = rng.randint(-(-shingles * 15 // 185) + 1, shingles * 20 // 180)  # (s - l) / (s + l) is in 0.80 to 0.85
        near = list(words)
        at = 10
        for k in range(lost - 4):
            near[at + k] = f"v{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    want = sorted(doc for doc, _, _, kept in neardup.brute_force(rows, 80) if kept)
    assert len(want) == 200 and sum(kept for *_, kept in neardup.brute_force(rows, 85)) == 400
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_least_estimate_follows_the_limit():
    assert abs(neardup.least_estimate(85, 256) - 0.76) < 0.001 and abs(neardup.least_estimate(80, 280) - 0.704) < 0.001


def test_mixed_languages_stay(spark):
    """A document in three languages without a majority, and an even split in two, stay; one without letters goes."""
    rng = random.Random(1)
    vocab = {k: ["".join(rng.choices(v, k=rng.randint(2, 4))) for _ in range(150)] for k, v in {"aa": ["the", "er", "on", "sh"], "bb": ["él", "qu", "eau", "oi"], "cc": ["sch", "ung", "ei", "ver"]}.items()}
    rows = [(i, " ".join(rng.choices(vocab[k], k=60)), k) for i in range(300) for k in [["aa", "bb", "cc"][i % 3]]]
    parts = lambda **n: " ".join(w for k, m in n.items() for w in rng.choices(vocab[k], k=m))
    rows += [(900, parts(aa=45, bb=30, cc=25), None), (901, parts(bb=34, cc=33, aa=33), None), (902, parts(aa=49, bb=49, cc=2), None), (903, "12 !!", "aa")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert set(range(300)) | {900, 901, 902} == set(found) and found[900] == "aa"
