"""Language identification with a linear-chain conditional random field.

A word's emission scores sum learned weights of its affixes, its byte n-grams and its place in
the languages' lexicons; learned transitions tie it to its neighbours. Forward-backward gives
every word of a text, which may switch between languages, a distribution over the labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GAP
from .textops import U, Words, mix64, read_words, slices, split_words

#: The model's bounds: weights are 2**16 rows of one number per language, and it is fitted on at most
#: so many documents of each of the most frequent languages, a run of so many words of each.
BITS = 16
SAMPLE_DOCS, SAMPLE_WORDS, MOST_LANGUAGES = 300, 200, 100
LEXICON = 20_000
NGRAMS, AFFIXES = (2, 3, 4), (1, 2, 3, 4)
#: Chains are worked out in runs of so many words, and texts in slices of about so many bytes.
RUN = 128
SLICE = 1 << 19
#: Words are scored in rounds of at most so many, whose features' weights are at most so many numbers; a word with more is scored a piece of so many bytes at a time.
ROUND, ROUND_WEIGHTS, PIECE = 5_000, 1 << 24, 1 << 18


@dataclass
class Crf:
    """labels, weights by hashed feature, lexicon (word hashes) with its weights, transitions, starts."""

    labels: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    transitions: np.ndarray
    starts: np.ndarray


def word_features(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, word by word, and where each word's begin.

    A word is taken with a mark before and behind it: its n-grams of bytes, and its first and last 1 to 4 bytes.
    """
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    # every word between two marks in one buffer
    begin = np.cumsum(size + 2) - (size + 2)
    flat = np.full(int((size + 2).sum()), 0xFF, np.uint64)
    inside = np.ones(len(flat), bool)
    inside[begin] = inside[begin + size + 1] = False
    source = np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)
    flat[inside] = np.frombuffer(data, np.uint8)[source]
    width = size + 2
    columns, owners = [], []
    word = np.repeat(np.arange(len(size)), width)
    within = np.arange(len(flat)) - np.repeat(begin, width)
    for n in NGRAMS:
        at = np.flatnonzero(within + n <= width[word])
        code = np.zeros(len(at), np.uint64)
        for k in range(n):
            code = (code << U(8)) | flat[at + k]
        columns.append(code | U(n << 40))
        owners.append(word[at])
    for n in AFFIXES:
        at = np.flatnonzero(size >= n)
        head = np.zeros(len(at), np.uint64)
        tail = np.zeros(len(at), np.uint64)
        for k in range(n):
            head = (head << U(8)) | flat[begin[at] + 1 + k]
            tail = (tail << U(8)) | flat[begin[at] + 1 + size[at] - n + k]
        columns += [head | U((16 + n) << 40), tail | U((32 + n) << 40)]
        owners += [at, at]
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    features = (mix64(np.concatenate(columns)) >> U(64 - BITS)).astype(np.int64)[order]
    return features, np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))]


def long_word_scores(model: Crf, word: bytes) -> np.ndarray:
    """The scores of a word of any length from the counts of its features, with a piece of it in memory at a time."""
    flat = np.frombuffer(b"\xff" + word + b"\xff", np.uint8)
    counts = np.zeros(1 << BITS, np.int64)
    feature = lambda code: (mix64(code) >> U(64 - BITS)).astype(np.int64)
    for n in NGRAMS:
        for i in range(0, len(flat) - n + 1, PIECE):
            part = flat[i : i + PIECE + n - 1].astype(np.uint64)
            m = len(part) - n + 1
            code = np.zeros(m, np.uint64)
            for k in range(n):
                code = (code << U(8)) | part[k : k + m]
            counts += np.bincount(feature(code | U(n << 40)), minlength=1 << BITS)
    for n in AFFIXES:
        for mark, affix in ((16, word[:n]), (32, word[len(word) - n :])):
            if len(word) >= n:
                counts[feature(np.array([int.from_bytes(affix, "big") | (mark + n) << 40], np.uint64))] += 1
    return counts @ model.weights / np.sqrt(counts.sum())


def emissions(model: Crf, words: Words) -> np.ndarray:
    """A row of scores for each word; each distinct word is scored once. Memory is bounded whatever the words' lengths are."""
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    out = np.zeros((len(first), len(model.labels)), np.float32)
    weights = (words.ends - words.starts)[first] * len(NGRAMS) * len(model.labels)
    long = np.flatnonzero(weights > ROUND_WEIGHTS)
    for at in long.tolist():
        out[at] = long_word_scores(model, words.data[words.starts[first[at]] : words.ends[first[at]]])
    rest = np.flatnonzero(weights <= ROUND_WEIGHTS)
    sums = np.cumsum(weights[rest])
    i = 0
    while i < len(rest):
        j = min(i + ROUND, max(i + 1, int(np.searchsorted(sums, sums[i] - weights[rest[i]] + ROUND_WEIGHTS, "right"))))
        some = first[rest[i:j]]
        features, bounds = word_features(words.data, words.starts[some], words.ends[some])
        scores = np.add.reduceat(model.weights[features], bounds[:-1], axis=0)
        out[rest[i:j]] = scores / np.sqrt(np.diff(bounds))[:, None]
        i = j
    if len(model.lexicon):
        hashes = words.hashes[first]
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        out += np.where((model.lexicon[at] == hashes)[:, None], model.entries[at], 0)
    return out[back]


def _abreast(begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For each step the places of the runs that go on, runs longest first."""
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    return [begin[:k] + t for t, k in enumerate(active.tolist())]


def _run_ends(emit: np.ndarray, chain: np.ndarray, begin: np.ndarray, size: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters each run from before it, and what comes back to its last word from behind it.

    Only chains of several runs need more than the start and ones: each of their runs becomes a
    matrix, and products of vectors with these go from run to run of all chains abreast.
    """
    labels = len(start)
    enter, behind = np.tile(start, (len(begin), 1)), np.ones((len(begin), labels))
    n_runs = np.bincount(chain)
    several = np.flatnonzero(n_runs[chain] > 1) if len(chain) else np.zeros(0, np.int64)
    if not len(several):
        return enter, behind
    order = several[np.argsort(-size[several], kind="stable")]
    matrix = np.tile(np.eye(labels), (len(order), 1, 1))
    for t, at in enumerate(_abreast(begin[order], size[order])):
        k = len(at)
        step = matrix[:k] if t == 0 else (matrix[:k].reshape(-1, labels) @ move).reshape(k, labels, labels)
        step = step * emit[at][:, None, :]
        matrix[:k] = step / step.sum(axis=(1, 2), keepdims=True)
    whole = np.zeros((len(begin), labels, labels))
    whole[order] = matrix
    chains = np.flatnonzero(n_runs > 1)
    chains = chains[np.argsort(-n_runs[chains], kind="stable")]
    rounds = _abreast((np.cumsum(n_runs) - n_runs)[chains], n_runs[chains])
    for at, then in zip(rounds[:-1], rounds[1:], strict=True):
        end = np.einsum("ki,kij->kj", enter[at[: len(then)]], whole[at[: len(then)]])
        enter[then] = (end / end.sum(axis=1, keepdims=True)) @ move
    for at, then in zip(rounds[-2::-1], rounds[:0:-1], strict=True):
        back = np.einsum("kij,kj->ki", whole[then], behind[then]) @ move.T
        behind[at[: len(then)]] = back / back.sum(axis=1, keepdims=True)
    return enter, behind


def forward_backward(scores: np.ndarray, counts: np.ndarray, transitions: np.ndarray, starts: np.ndarray, pairs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Posteriors of the labels for chains laid end to end, and the log partition over all; pairs gains expected transitions.

    Chains are cut into runs of RUN words, which go abreast, longest first, so a step is one operation
    on those that go on and a long chain takes no more steps than a short one. The cuts change nothing: `_run_ends` carries over them.
    """
    counts = counts.astype(np.int64)
    n_runs = -(-counts // RUN)
    chain = np.repeat(np.arange(len(counts)), n_runs)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    begin = np.repeat(np.cumsum(counts) - counts, n_runs) + nth * RUN
    size = np.minimum(RUN, np.repeat(counts, n_runs) - nth * RUN)
    top = scores.max(axis=1, keepdims=True)
    emit = np.exp((scores - top).astype(np.float64))
    move = np.exp(transitions)
    enter, behind = _run_ends(emit, chain, begin, size, move, np.exp(starts))
    order = np.argsort(-size, kind="stable")
    places = _abreast(begin[order], size[order])
    alpha = np.zeros_like(emit)
    scale = np.ones(len(emit))
    state = enter[order]
    for t, at in enumerate(places):
        state = (state if t == 0 else state[: len(at)] @ move) * emit[at]
        norm = state.sum(axis=1)
        state /= norm[:, None]
        alpha[at] = state
        scale[at] = norm
    last = alpha[begin + size - 1]
    behind /= (last * behind).sum(axis=1, keepdims=True)
    beta = behind[order]
    for t in range(len(places) - 1, -1, -1):
        at = places[t]
        if t + 1 < len(places):
            nxt = places[t + 1]
            k = len(nxt)
            ahead = emit[nxt] * beta[:k] / scale[nxt][:, None]
            if pairs is not None:
                pairs += move * (alpha[at[:k]].T @ ahead)
            beta[:k] = ahead @ move.T
        both = alpha[at] * beta[: len(at)]
        alpha[at] = both / both.sum(axis=1, keepdims=True)
    if pairs is not None:
        onward = np.flatnonzero(chain[1:] == chain[:-1])
        heads = begin[onward + 1]
        first = np.empty_like(beta)
        first[order] = beta
        pairs += move * (last[onward].T @ (emit[heads] * first[onward + 1] / scale[heads][:, None]))
    return alpha, float(np.log(scale).sum() + top.sum())


def _switched(texts: list[str], langs: list[int], n: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Training chains: half of one language, half of runs of 4 to 20 words from several; and a label for each word."""
    split = [[w.decode() for w in split_words(t)] for t in texts]
    usable = [i for i, w in enumerate(split) if w]
    chains, labels = [], []
    for c in range(n):
        out: list[str] = []
        while len(out) < 48:
            i = usable[int(rng.integers(len(usable)))]
            run = 48 if c % 2 else int(rng.integers(4, 21))
            at = int(rng.integers(max(1, len(split[i]) - run + 1)))
            piece = split[i][at : at + run]
            out += piece
            labels += [langs[i]] * len(piece)
            if c % 2:
                break
        chains.append(" ".join(out))
    return chains, np.array(labels)


def fit_crf(texts: list[str], langs: list[str], n_chains: int = 2000, rounds: int = 60, seed: int = 5) -> Crf:
    """A model from texts (words joined by spaces) and their languages, by Adam on the conditional likelihood."""
    names = sorted(set(langs))
    if not names:
        return Crf([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    by_lang: dict[str, list[int]] = {k: [i for i, x in enumerate(langs) if x == k] for k in names}
    even = [int(rng.choice(by_lang[names[k % len(names)]])) for k in range(max(len(texts), 4 * len(names)))]  # languages weigh alike
    chains, label = _switched([texts[i] for i in even], [names.index(langs[i]) for i in even], n_chains, rng)
    words = read_words(chains, lower=True)
    count, size = words.counts.astype(np.int64), len(names)
    _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
    features, bounds = word_features(words.data, words.starts[first], words.ends[first])
    width = np.sqrt(np.diff(bounds))[:, None]
    owner = np.repeat(np.arange(len(first)), np.diff(bounds))
    # the lexicon: words met at least three times, nine times in ten in one language
    seen = np.stack([np.bincount(back[label == k], minlength=len(first)) for k in range(size)], axis=1)
    sure = np.flatnonzero((seen.sum(axis=1) >= 3) & (seen.max(axis=1) >= 0.9 * seen.sum(axis=1)))
    sure = sure[np.argsort(-seen[sure].sum(axis=1), kind="stable")][:LEXICON]
    lexicon = np.sort(words.hashes[first][sure])
    row = np.full(len(first), -1)
    row[sure] = np.searchsorted(lexicon, words.hashes[first][sure])
    known = row >= 0
    params = [np.zeros((1 << BITS, size)), np.zeros((max(1, len(lexicon)), size)), np.zeros((size, size)), np.zeros(size)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    truth = np.eye(size)[label]
    begins = np.cumsum(count) - count
    inner = np.ones(len(label), bool)
    inner[begins] = False
    real = np.zeros((size, size))
    np.add.at(real, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    real_start = truth[begins].sum(axis=0)
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(params[0][features], bounds[:-1], axis=0) / width
        scores[known] += params[1][row[known]]
        pairs = np.zeros((size, size))
        posterior, _ = forward_backward(scores[back], count, params[2], params[3], pairs)
        gap = posterior - truth
        by_word = np.stack([np.bincount(back, gap[:, k], len(first)) for k in range(size)], axis=1)
        spread = (by_word / width)[owner]
        grads = [np.stack([np.bincount(features, spread[:, k], 1 << BITS) for k in range(size)], axis=1), np.zeros_like(params[1]), pairs - real, posterior[begins].sum(axis=0) - real_start]
        np.add.at(grads[1], row[known], by_word[known])
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            g = g / len(label) + 1e-6 * p
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p -= 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Crf(names, params[0].astype(np.float32), lexicon, params[1][: len(lexicon)].astype(np.float32), params[2], params[3])


def training_sample(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, words_per_doc: int = SAMPLE_WORDS, languages: int = MOST_LANGUAGES) -> tuple[list[str], list[str]]:
    """Runs of words of labelled documents, at most docs_per_lang of each of the most frequent languages, chosen by a hash of id and text.

    Counts are over all labelled rows; what is collected is bounded by the three parameters and
    words of up to 64 characters, however large the table is and whatever its ids are.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # repeated rows draw alike, so different ones are counted
    different = F.approx_count_distinct(F.xxhash64(key, "text")).alias("different")
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), different).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    counts = {r.lang: max(1, r.different) for r in found}
    if not counts:
        return [], []
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 2 * docs_per_lang / n))])
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), key, "text"), F.lit(1 << 30)) / float(1 << 30)
    words = F.split(F.col("text"), GAP)
    start = F.floor(draw(2) * F.greatest(F.size(words) - words_per_doc, F.lit(1))).cast("int")
    run = F.transform(F.slice(words, start + 1, words_per_doc), lambda w: F.substring(w, 1, 64))
    some = labelled.withColumn("draw", draw(1)).filter(F.col("draw") < F.coalesce(shares[F.col("lang")], F.lit(0.0)))
    # about twice as many as are wanted, repeated rows once; of them the first by draw
    some = some.select("lang", "draw", F.array_join(run, " ").alias("run")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "run"))
    rows = some.withColumn("place", place).filter(F.col("place") <= docs_per_lang).select("lang", "run").collect()
    rows.sort(key=lambda r: (r.lang, r.run))
    return [r.run for r in rows], [r.lang for r in rows]


_SPAN = T.StructType().add("first", "integer").add("words", "integer").add("lang", "string")
ADDED = T.StructType().add("lang_pred", "string").add("score", "double").add("certainty", "double").add("spans", T.ArrayType(_SPAN))


def label_documents(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score, certainty and spans, from the text alone.

    spans: runs of words with the same likeliest label (the first word's place, how many, the label).
    lang_pred is the label with the largest mean posterior over the words that have a letter or a
    byte beyond ASCII, and score is that mean; certainty is these words' mean of the largest posterior, which
    is high where each word is surely of some language, however many take turns. A text that is null or has no
    letter is `und` with score and certainty 0 and no spans, as is every text if the model has no labels. Of labels with equal
    means the first by name counts. A very long text is one chain, worked out in runs. Repeated
    rows, null ids and other columns pass through (columns of the four names are replaced), and an empty table gives an empty one.
    """
    rest = [c for c in docs.columns if c not in ADDED.names]
    docs = docs.select(*[F.col(f"`{c}`") for c in rest])
    place = rest.index(text)
    schema = T.StructType([*docs.schema.fields, *ADDED])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
    is_letter = np.zeros(256, bool)
    is_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = pa.array(model.labels, pa.string())
        texts = batch.column(place).to_pylist()
        lettered = [bool(model.labels) and t is not None and any(map(str.isalpha, t)) for t in texts]
        words = read_words([t if ok else None for t, ok in zip(texts, lettered, strict=True)], lower=True)
        preds, scores, certain, spans, bounds = [], [], [], [], [0]
        firsts: list[np.ndarray] = []
        if len(words.hashes):
            posterior, _ = forward_backward(emissions(model, words), words.counts.astype(np.int64), model.transitions, model.starts)
            mark = np.r_[0, np.cumsum(is_letter[np.frombuffer(words.data, np.uint8)])]
            counts_in = (mark[words.ends] > mark[words.starts]).astype(np.float64)
            best = posterior.argmax(axis=1)
            total = np.r_[np.zeros((1, posterior.shape[1])), np.cumsum(posterior * counts_in[:, None], axis=0)]
            weight = np.r_[0, np.cumsum(counts_in)]
            surest = np.r_[0, np.cumsum(posterior.max(axis=1) * counts_in)]
        for ok, (a, b) in zip(lettered, words.per_text(), strict=True):
            if not ok or weight[b] == weight[a]:
                preds.append("und")
                scores.append(0.0)
                certain.append(0.0)
                bounds.append(bounds[-1])
                continue
            mean = (total[b] - total[a]) / (weight[b] - weight[a])
            preds.append(model.labels[int(mean.argmax())])
            scores.append(float(min(1.0, max(0.0, mean.max()))))
            certain.append(float(min(1.0, max(0.0, (surest[b] - surest[a]) / (weight[b] - weight[a])))))
            own = best[a:b]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            firsts.append(np.stack([heads, np.diff(np.r_[heads, b - a]), own[heads]]))
            bounds.append(bounds[-1] + len(heads))
        spans = np.concatenate(firsts, axis=1) if firsts else np.zeros((3, 0), np.int64)
        runs = pa.StructArray.from_arrays([pa.array(spans[0], pa.int32()), pa.array(spans[1], pa.int32()), names.take(pa.array(spans[2], pa.int64()))], fields=list(kind.value_type))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(certain, pa.float64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)], [*rest, *ADDED.names])

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a slice's arrays end with its call, so the last one's are gone when memory is given back
        yield from map(labelled, slices(batches, text, SLICE))

    return docs.mapInArrow(label, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame) -> Crf:
    """A model from the documents that aren't held out."""
    return fit_crf(*training_sample(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))))


def op1(docs: DataFrame) -> DataFrame:
    return label_documents(docs.select("doc_id", "text"), fit_on(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
