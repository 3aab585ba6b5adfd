"""The whole pipeline against plain Python, stage by stage, and its stages on odd tables."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import bpe, lang_id, neardup, secret_scan

VOCAB = {"aa": ["the", "er", "on", "sh"], "bb": ["él", "qu", "eau", "oi"], "cc": ["sch", "ung", "ei", "ver"]}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_posteriors(model, text):
    """For each word with letters of a text its distribution over the labels."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    emit = [lang_id.emissions(model, lang_id.read_words([w]))[0].astype(float) for w in words]
    k = len(model.labels)
    alpha, beta = [], []
    for t, e in enumerate(emit):
        before = model.starts if t == 0 else np.array([np.logaddexp.reduce(alpha[-1] + model.transitions[:, j]) for j in range(k)])
        alpha.append(e + before)
    for t in range(len(emit) - 1, -1, -1):
        beta.insert(0, np.zeros(k) if t == len(emit) - 1 else np.array([np.logaddexp.reduce(model.transitions[j] + emit[t + 1] + beta[0]) for j in range(k)]))
    post = [np.exp(a + b - np.logaddexp.reduce(a + b)) for a, b in zip(alpha, beta, strict=True)]
    return np.array([p for p, w in zip(post, words, strict=True) if re.search(rb"[A-Za-z\x80-\xff]", w.encode())])


def plain_mix(rows):
    """(doc, text, source) as often as the mix takes each."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:  # share, cap those above, share again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    out, nth = [], {}
    for doc, text, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        n = nth[doc, text, s] = nth.get((doc, text, s), 0) + 1
        draw = int(hashlib.md5(f"17:{doc}:{hashlib.md5((text or '').encode()).hexdigest()}:{n}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(doc, text)] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_pipeline_by_plain_python(spark, tmp_path):
    rng = random.Random(5)
    words = {k: ["".join(rng.choices(v, k=rng.randint(2, 4))) for _ in range(120)] for k, v in VOCAB.items()}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    rows = [(i, text(k, rng.randint(20, 60)), k, rng.choice(["s1", "s2", "s3", None])) for i in range(150) for k in [sorted(words)[i % 3]]]
    rows += [(200 + i, rows[i][1] + (" extra" if i % 2 else ""), "aa", "s2") for i in range(20)]  # exact and near copies
    rows += [(300 + i, f"{text('bb', 30)} password = abcDEF123{i} {text('bb', 10)} {'0a' * 20}", "bb", "s1") for i in range(10)]
    rows += [(400, None, "aa", "s1"), (401, "", None, None), (402, "123 !! --", "cc", "s3"), (403, text("aa", 25) + " " + text("cc", 25), None, None)]
    spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = lang_id.fit_on(docs)
    kept = []
    for i, t, _, s in rows:
        post = plain_posteriors(model, t) if t else np.zeros((0, 3))
        if t and any(map(str.isalpha, t)) and len(post) and post.max(axis=1).mean() >= corpus_pipeline.LEAST_CERTAINTY:
            kept.append((i, t, s))
    assert len(kept) == len(rows) - 3
    firsts = {doc for doc, *_, first in neardup.brute_force([(i, t) for i, t, _ in kept], corpus_pipeline.SIMILAR) if first}
    assert len(firsts) < len(kept) - 10
    clean = []
    for i, t, s in kept:
        if i in firsts:
            spans = [(m.start(), m.end()) for m in re.finditer(secret_scan.ASSIGN, t) if len(m[2]) >= 8] + [(m.start(), m.end()) for m in re.finditer(secret_scan.HEX, t) if len(m[0]) >= 32]
            for a, b in sorted(spans, reverse=True):
                t = t[:a] + "[SECRET]" + t[b:]
            clean.append((i, t, s))
    assert sum("[SECRET]" in t for _, t, _ in clean) == 10
    want = sorted((doc, n, decoded) for doc, n, _, decoded in bpe.brute_force(plain_mix(clean)))
    assert sorted(tuple(r)[:3] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_take_empty_and_odd_tables(spark):
    odd = [(None, "a b c d e f", None, None, 11), (None, None, None, None, None), (7, "x" * 200_000, "en", "s", 200_000), (7, "x" * 200_000, "en", "s", 200_000), (8, "", "en", "s", 0)]
    docs = spark.createDataFrame(odd, COLUMNS).withColumn("bands", F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "")
        found = stage(spark, docs, "").collect()
        assert empty.count() == 0 and len(found) >= (1 if name == "language" else 3)
        if name != "tokens":
            assert empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]
