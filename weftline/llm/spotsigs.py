"""SpotSigs fingerprints: chains of content words that follow frequent words.

An anchor is a frequent word (of four languages) or the text's beginning; its signature is the anchor with the next CHAIN
content words, every second one, or fewer at the text's end. A content word that no anchor's chain reads begins a chain
without an anchor, so every content word is read, whatever the language. A text's signatures form a set; its fingerprint
is the set's size and all its hashes, sorted, so that likenesses can be had from fingerprints. Likeness is the Jaccard
similarity of two sets, compared in one pass over the sorted hashes.

Defined results: a null or empty text, or one without content words, has the empty set and the fingerprint "0:"; two empty
sets are alike (1.0) if both texts are empty of words, and an empty set is unlike any other; equal texts, repeated rows
among them, have equal fingerprints; a null doc_id comes last; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_columns, table
from .jaccard import join
from .quality import STOP_WORDS

ANCHORS = frozenset(w.lower() for w in STOP_WORDS)
CHAIN = 3
STEP = 2
WORD = re.compile(r"\w+").findall


def signatures(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's signatures."""
    ws = WORD((text or "").lower())
    content = [w for w in ws if w not in ANCHORS]
    if not content:
        return np.zeros(0, np.uint64)
    reach = STEP * (CHAIN - 1) + 1
    spots, seen = [("", 0)], 0
    for w in ws:
        if w in ANCHORS:
            spots.append((w, seen))
        else:
            seen += 1
    read = {i + k for _, i in spots for k in range(0, reach, STEP)}
    spots += [("", i) for i in range(seen) if i not in read]
    chains = {f"{a}:{' '.join(content[i : i + reach : STEP])}" for a, i in spots if i < seen} if seen >= reach else {":" + " ".join(content)}
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(c) for c in chains], np.uint64))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 where it is under least, found from the sizes alone if they differ enough."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    like = both / (len(a) + len(b) - both)
    return like if like >= least else 0.0


def fingerprint(s: np.ndarray) -> str:
    return f"{len(s)}:" + s.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the following text's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
#: Rows handed on at once; their fingerprints are longer than their texts.
ROWS = 1000


def _batch(out: list[tuple]) -> pa.RecordBatch:
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (part, doc_id, text, peek), by part and descending doc_id; a peek row only shows what follows its part's last document."""
    before = None

    def row(part: int, doc_id: int | None, text: str, own: np.ndarray, following: str, other: np.ndarray) -> tuple:
        new = edited(text, following)
        sigs = signatures(new)
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(own), fingerprint(sigs), likeness(own, sigs), likeness(own, other), len(own)

    for batch in batches:
        out = []
        for part, doc_id, text, peek in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "peek")), strict=True):
            own = signatures(text)
            if before is not None and before[0] == part:
                out.append(row(*before, text, own))
            before = None if peek else (part, doc_id, text, own)
            if len(out) == ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def with_next(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of (part, doc_id, text, peek), dealt by part and sorted, in which each document is followed by the next one by
    descending doc_id and the last document by the first.

    Part bounds are quantiles of the ids over all documents. A part's first document, one row a part, is also put behind the
    part before it. Texts are shuffled once. Equal ids go by text; the driver holds one id a part, whatever the input."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or 4 * partitions
    docs = plain_columns(df, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (-F.col("doc_id").cast("long")).alias("k"))
    bounds = sorted(set(docs.select(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []))
    below = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b < F.col("k"))) if bounds else F.lit(0)
    docs = docs.withColumn("part", F.when(F.col("k").isNull(), len(bounds) + 1).otherwise(below).cast("int"))
    heads = sorted(map(tuple, docs.groupBy("part").agg(F.min("k")).collect()))
    at = [(heads[i - 1][0], part, k) for i, (part, k) in enumerate(heads)]
    shown = docs.join(F.broadcast(spark.createDataFrame(at, "to int, of int, first long")), (F.col("part") == F.col("of")) & F.col("k").eqNullSafe(F.col("first")))
    shown = shown.groupBy("to", "k", "doc_id").agg(F.min("text").alias("text"))
    rows = docs.select("part", "k", "doc_id", "text", F.lit(False).alias("peek")).unionByName(shown.select(F.col("to").alias("part"), "k", "doc_id", "text", F.lit(True).alias("peek")))
    dealt = rows.repartition(partitions, "part").sortWithinPartitions("part", "peek", F.col("k").asc_nulls_last(), "text")
    return dealt.select("part", "doc_id", "text", "peek")


def fingerprints(df: DataFrame) -> DataFrame:
    """One row a document, as OUT: its fingerprint, its edited text's, and how alike they and the next document's are."""
    return with_next(df).mapInArrow(_pairs, OUT)


def near_copies(df: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """One row a document: doc_id, n_shingles (the size of its signature set), component_id (the smallest doc_id reachable by
    likenesses of num / den or more). Sets are partitioned by length, and compared through Jaccard pruned by sizes and bitmaps
    before the exact one: the join of the n-gram sets, over signatures. No query calls it."""
    return join(df, n=1, num=num, den=den, sets=lambda: lambda text: signatures((text or b"").decode()))


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
