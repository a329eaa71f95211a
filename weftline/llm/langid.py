"""Language identification of mixed-language text.

A word's script (Unicode ranges) narrows the languages to those that were seen in it; hashed character n-grams score the
word in each of them; Viterbi over the words, with a fixed penalty for switching, labels spans. A document's language is
the one with most letters, its score that language's share of the letters.

The model is counted on about FIT_ROWS labelled documents (all where there are fewer), chosen by a hash of the id; it has
BUCKETS numbers a language, fewer (a smaller power of two) where there are more than CELLS / BUCKETS languages, so that the
model is bounded whatever their number. Defined results: a null text or one without
letters is "und" with score 0; without any labelled document every text is "und"; words in a script that no language was
seen in don't vote; ties go to the language first by name; repeated rows give equal results; an empty table gives no rows;
a null doc_id counts as empty text for the fold; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain_columns, table

FIT_ROWS = 20_000
BUCKETS = 1 << 16
CELLS = 1 << 25
LENGTHS = (1, 2, 3, 4)
#: Most that a word can say against a language, and what a switch costs, in nats.
CLIP = 6.0
SWITCH = 9.0
#: Characters that are labelled together.
CHUNK = 4_000_000
LETTERS = re.compile(r"[^\W\d_]+")
#: First code points of script ranges; Latin up to the next entry.
SCRIPTS = ((0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "southeast"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
STARTS = np.array([0] + [a for a, _ in SCRIPTS])
NAMES = sorted({s for _, s in SCRIPTS} | {"latin"})
SCRIPT_OF = np.array([NAMES.index("latin")] + [NAMES.index(s) for _, s in SCRIPTS])


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # [buckets, languages]
    scripts: np.ndarray  # [scripts, languages]: was the language seen in the script?


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' n-grams: bucket and word; and each word's script, by its first letter."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(points == 2)
    word = np.cumsum(points == 2) - 1
    scripts = SCRIPT_OF[np.searchsorted(STARTS, points[starts + 1].astype(np.int64), "right") - 1]
    buckets, of = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        h = h[: len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(n)
        h ^= h >> np.uint64(29)
        whole = word[: len(h)] == word[n - 1 :]
        if n in LENGTHS:
            mixed = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
            buckets.append(mixed[whole].astype(np.int64) % BUCKETS)
            of.append(word[: len(h)][whole])
    return np.concatenate(buckets), np.concatenate(of), scripts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to lang, kind (0 n-gram, 1 script), key, n: sums of this task."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        part = batch.to_pandas()
        for lang, texts in part.groupby("lang")["text"]:
            ws = LETTERS.findall(" ".join(t for t in texts if t).lower())
            if not ws:
                continue
            names, n = np.unique(np.array(ws, object), return_counts=True)
            b, of, scripts = _grams(names.tolist())
            g, s = sums.setdefault(lang, (np.zeros(BUCKETS), np.zeros(len(NAMES))))
            g += np.bincount(b, n[of], BUCKETS)
            s += np.bincount(scripts, n, len(NAMES))
    for lang, both in sums.items():
        for kind, x in enumerate(both):
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "kind": pa.array(np.full(len(at), kind, np.int32)), "key": pa.array(at.astype(np.int32)), "n": x[at].astype(np.int64)})


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model of the labelled rows outside of fold 0."""
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    there = known.select("lang").count()
    if there > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * rows / there))
    sums = known.select("lang", "text").mapInArrow(_counts, "lang string, kind int, key int, n long")
    sums = sums.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    sums = cut(sums, "counts")
    languages = sorted(r[0] for r in sums.select("lang").distinct().collect())  # of the sample's rows
    buckets = BUCKETS
    while buckets > 1 and buckets * len(languages) > CELLS:
        buckets //= 2
    folded = sums.groupBy("lang", "kind", F.when(F.col("kind") == 0, F.col("key") % buckets).otherwise(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    got = folded.toPandas() if languages else pd.DataFrame({"lang": [], "kind": [], "key": [], "n": []})  # at most CELLS rows, and one a script and language
    counts, scripts = np.zeros((buckets, len(languages))), np.zeros((len(NAMES), len(languages)))
    lang = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    for kind, x in enumerate((counts, scripts)):
        own = (got["kind"] == kind).to_numpy(bool)
        x[got["key"].to_numpy(int)[own], lang[own]] = got["n"].to_numpy()[own]
    logp = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * buckets))
    seen = scripts >= np.maximum(1, 0.005 * scripts.sum(0))
    return Model(languages, logp.astype(np.float32), seen)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """[words, languages]: log of the languages' shares, at least -CLIP; 0 for all where the script says nothing."""
    b, of, scripts = _grams(words)
    order = np.argsort(of, kind="stable")
    sums = np.add.reduceat(model.logp[b[order] % len(model.logp)], np.searchsorted(of[order], np.arange(len(words))), axis=0)
    can = model.scripts[scripts]
    sums[~can] = -1e9
    sums -= sums.max(1, keepdims=True)
    sums -= np.log(np.exp(sums).sum(1, keepdims=True))
    sums = np.maximum(sums, -CLIP)
    sums[~can.any(1)] = 0
    return sums.astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; scores of all documents one after the other. Documents advance together, longest first."""
    n, k = scores.shape
    labels = np.zeros(n, np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    live = np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), "left")  # how many documents have a t-th word
    back = np.zeros((n, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    v = np.zeros((len(sizes), k), np.float32)
    for t, m in enumerate(live):
        at, now = starts[:m] + t, v[:m]
        if t:
            best = now.argmax(1)
            top = now[np.arange(m), best] - switch
            stay = now >= top[:, None]
            back[at] = np.where(stay, own, best[:, None].astype(np.int16))
            now = np.where(stay, now, top[:, None])
        v[:m] = now + scores[at]
    last = v.argmax(1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = starts[:m] + t
        labels[at] = last[:m]
        last[:m] = back[at, last[:m]]
    return labels


def label(texts: list[str | None], model: Model) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """For each text: its spans (start, end, language), and the letters of each language."""
    found = [[(m.start(), m.end()) for m in LETTERS.finditer(t)] if t else [] for t in texts]
    words = [t[a:b].lower() for t, f in zip(texts, found, strict=True) for a, b in f]
    lengths = np.array([len(f) for f in found])
    labels = _labels(words, lengths, model)
    at = 0
    for f in found:
        own, spans, letters = labels[at : at + len(f)].tolist(), [], np.zeros(len(model.languages))
        at += len(f)
        for (a, b), x in zip(f, own, strict=True):
            letters[x] += b - a
            if spans and spans[-1][2] == x:
                spans[-1] = (spans[-1][0], b, x)
            else:
                spans.append((a, b, x))
        yield spans, letters


def _labels(words: list[str], lengths: np.ndarray, model: Model) -> np.ndarray:
    if not words:
        return np.zeros(0, np.int16)
    ids: dict[str, int] = {}
    own = np.array([ids.setdefault(w, len(ids)) for w in words])
    return viterbi(word_scores(list(ids), model)[own], lengths)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df's other columns as they are, with lang_pred and score."""
    others = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            langs, scores, k = [], [], 0
            while k < len(texts):
                end, size = k, 0
                while end < len(texts) and (end == k or size < CHUNK):
                    size += len(texts[end] or "")
                    end += 1
                found = [LETTERS.findall(t.lower()) if t else [] for t in texts[k:end]] if m.languages else [[]] * (end - k)
                lengths = np.array([len(f) for f in found])
                words = [w for f in found for w in f]
                labels = _labels(words, lengths, m)
                sums = np.zeros((end - k, max(1, len(m.languages))))
                np.add.at(sums, (np.repeat(np.arange(end - k), lengths), labels), np.array([len(w) for w in words], float))
                best = sums.argmax(1)
                for i, (b, total) in enumerate(zip(best.tolist(), sums.sum(1).tolist(), strict=True)):
                    langs.append(m.languages[b] if total else "und")
                    scores.append(sums[i, b] / total if total else 0.0)
                k = end
            keep = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*others, "lang_pred", "score"])

    fields = df.select(*[F.col(f"`{c}`") for c in others]).schema.add("lang_pred", "string").add("score", "double")
    return df.select(*[F.col(f"`{c}`") for c in [*others, text]]).mapInArrow(run, fields)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain_columns(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])
    model = fit(docs)
    return predict(docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "text"), model)
