"""Exact removal of long repeated byte strings with a run-length index.

Every window of LENGTH bytes has a smallest K-gram hash, its anchor; equal windows have equal anchors, wherever they
stand. Stretches of windows with one anchor are the units: (anchor, digest of the stretch's bytes). A stretch that occurs
twice is repeated throughout. Where an anchor has several different stretches, or stands twice in one, these are compared
by the index: their concatenation's Burrows-Wheeler transform is cut into runs, the ends of runs are sampled with their
text positions, and from each sample the length of the match with the neighbouring suffix is streamed to the right (from
a position that is not a sample the match is one shorter than from the position before it). Windows at positions with
matches of LENGTH or more are marked. Anchors whose stretches are too many for one block hash their windows instead and
count them over the cluster: the same result, without a bound on the group.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; all rows of a repeated text lose it all
(if it is long enough); ids may be null or repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, plain_columns, table
from .jaccard import C1, mix

LENGTH = 400
K = 128
#: Bytes of an index block; an anchor with more is counted by window hashes.
BLOCK = 1_000_000
FILTER_BITS = 1 << 24
CODES = mix(np.arange(1, 257, dtype=np.uint64) * C1)
END = 0xFF  # in no UTF-8 text
BYTES = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)


def _doubled(h: np.ndarray, step: int) -> np.ndarray:
    h = h[: len(h) - step] * C1 + h[step:]
    return h ^ (h >> np.uint64(29))


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of bytes; k: a power of two."""
    h, step = CODES[b], 1
    while step < k:
        h, step = _doubled(h, step), 2 * step
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x, size = np.minimum(x[: len(x) - size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def stretches(b: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window, last window, and whether the anchor stands more than once in the stretch."""
    h = gram_hashes(b, k)
    w = length - k + 1
    m = sliding_min(h, w)
    first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    last = np.append(first[1:] - 1, len(m) - 1)
    anchors = m[first]
    places = np.flatnonzero((h == np.repeat(m[first], np.diff(first, append=len(m)))[np.minimum(np.arange(len(h)), len(m) - 1)]) | np.isin(h, anchors))
    value = h[places]
    twice = np.zeros(len(first), bool)
    order = np.argsort(value, kind="stable")
    sv, sp = value[order], places[order]
    a, z = np.searchsorted(sv, anchors, "left"), np.searchsorted(sv, anchors, "right")
    for i in np.flatnonzero(z - a > 1):
        own = sp[a[i] : z[i]]
        twice[i] = np.count_nonzero((own >= first[i]) & (own <= last[i] + w - 1)) > 1
    return anchors, first, last, twice


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by prefix doubling from 8 bytes, sorting only what is still undecided; and the 8-byte keys."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j in range(8):
        keys = (keys << np.uint64(8)) | padded[j : j + n]
    sa = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[sa][1:] != keys[sa][:-1]])
    rank = np.empty(n + 1, np.int64)
    starts = np.flatnonzero(new)
    rank[sa] = np.repeat(starts, np.diff(starts, append=n))
    rank[n] = -1
    h = 8
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            return sa, keys
        at = sa[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[slots] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh
        begin = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[at] = begin
        h *= 2


def matches(keys: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at p and q have in common, eight at a time."""
    n = len(keys)
    out = np.zeros(len(p), np.int64)
    live = np.arange(len(p))
    while len(live):
        a, b = p[live] + out[live], q[live] + out[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        x = keys[a] ^ keys[b]
        equal = x == 0
        out[live[equal]] += 8
        out[live[~equal]] += 7 - np.searchsorted(BYTES, x[~equal], "right")
        live = live[equal]
    return np.minimum(out, n - np.maximum(p, q))


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its windows also start elsewhere in the parts (or again in itself), by the run-length index."""
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    sa, keys = suffix_array(t)
    n = len(t)
    bwt = t[sa - 1]
    cuts = np.concatenate([[True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == END)])
    heads = np.flatnonzero(cuts)
    tails = np.append(heads[1:] - 1, n - 1)
    heads, tails = heads[heads > 0], tails[tails < n - 1]
    p = np.concatenate([sa[heads], sa[tails]])
    q = np.concatenate([sa[heads - 1], sa[tails + 1]])
    far = matches(keys, p, q)
    long = far >= length
    marks = np.zeros(n + 2, np.int64)
    np.add.at(marks, p[long], 1)
    np.add.at(marks, p[long] + far[long] - length + 1, -1)
    on = np.cumsum(marks)[:n] > 0
    out, at = [], 0
    for x in parts:
        out.append(on[at : at + len(x) - length + 1])
        at += len(x) + 1
    return out


def runs(on: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, body) by anchor, to (anchor, digest, starts, ends): repeated windows."""
    now, group, block, size = None, {}, [], 0

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        got = [runs(x) for x in repeated_windows([r[2] for r in rows])]
        kept = [(r[0], r[1], *g) for r, g in zip(rows, got, strict=True) if g[0]]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], kind) for i, kind in enumerate(kinds)], names=["anchor", "digest", "starts", "ends"])

    for batch in batches:
        for anchor, digest, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "body")), strict=True):
            if anchor != now:
                block += [(now, d, x) for d, x in group.items()]
                size += sum(map(len, group.values()))
                now, group = anchor, {}
                if size >= BLOCK:
                    yield solve(block)
                    block, size = [], 0
            group[digest] = body
    block += [(now, d, x) for d, x in group.items()]
    if block:
        yield solve(block)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, body) to a row a window: (anchor, digest, at, hash)."""
    for batch in batches:
        for anchor, digest, body in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "body")), strict=True):
            b = np.frombuffer(body, np.uint8)
            n = len(b) - LENGTH + 1
            h, step, total, at, left = CODES[b], 1, np.zeros(n, np.uint64), 0, LENGTH
            while left:
                if left & step:
                    total = mix(total * C1 + h[at : at + n])
                    at, left = at + step, left - step
                if left:
                    h, step = _doubled(h, step), 2 * step
            yield pa.RecordBatch.from_pydict({"anchor": np.full(n, anchor), "digest": np.full(n, digest), "at": np.arange(n, dtype=np.int32), "hash": total.view(np.int64)})


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text to the row's key, size, digest and stretches."""
    unit = pa.struct([("anchor", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("twice", pa.bool_())])
    for batch in batches:
        keys, sizes, shas, units, offsets = [], [], [], [], [0]
        for text in batch.column("text"):
            raw = text.as_py() or b""
            keys.append(xxhash.xxh3_128_digest(raw))
            sizes.append(len(raw))
            shas.append(hashlib.sha256(raw).hexdigest())
            if len(raw) >= LENGTH:
                anchors, first, last, twice = stretches(np.frombuffer(raw, np.uint8))
                h = xxhash.xxh3_64_intdigest
                digests = np.array([h(raw[a : z + LENGTH]) for a, z in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                units.append((anchors.view(np.int64), digests.view(np.int64), first.astype(np.int32), last.astype(np.int32), twice))
            offsets.append(offsets[-1] + (len(units[-1][0]) if len(raw) >= LENGTH else 0))
        flat = [np.concatenate(x) for x in zip(*units, strict=True)] if units else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)]
        rows = pa.StructArray.from_arrays([pa.array(x) for x in flat], fields=list(unit))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], names=["doc_id", "key", "n_bytes", "sha", "units"]
        )


def _bit(keys: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "little") for k in keys], np.uint64) & np.uint64(FILTER_BITS - 1)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bitmap of the keys' hashes, FILTER_BITS whatever their number; the join behind it is exact."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column("key").to_pylist())
            yield pa.RecordBatch.from_pydict({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    words = keys.select("key").mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text of the wanted keys (with wanted's other columns); copies within a task are sent once."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column("text")]
            keys = [xxhash.xxh3_128_digest(x) for x in texts]
            at = _bit(keys)
            there = ((held.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).tolist()
            some = [i for i, (k, on) in enumerate(zip(keys, there, strict=True)) if on and not (k in sent or sent.add(k))]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array([texts[i] for i in some], pa.binary())], names=["key", "text"])

    return docs.select("text").mapInArrow(fetch, "key binary, text binary").join(wanted, "key")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, units to (anchor, digest, body)."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, units in zip(batch.column("text").to_pylist(), batch.column("units").to_pylist(), strict=True):
            for u in units:
                for x, v in zip(out, (u["anchor"], u["digest"], text[u["first"] : u["last"] + LENGTH]), strict=True):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["anchor", "digest", "body"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, spans to (key, kept_sha)."""
    for batch in batches:
        shas = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            h, at = hashlib.sha256(), 0
            for s in spans:
                h.update(text[at : s["start"]])
                at = s["end"]
            h.update(text[at:])
            shas.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shas, pa.string())], names=["key", "kept_sha"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, marks (windows first to last) to merged byte spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out, removed = [], []
        for marks in batch.column("marks").to_pylist():
            spans: list[dict] = []
            for a, z in sorted((m["a"], m["z"] + LENGTH) for m in marks):
                if spans and a <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], z)
                else:
                    spans.append({"start": a, "end": z})
            out.append(spans)
            removed.append(sum(s["end"] - s["start"] for s in spans))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, span), pa.array(removed, pa.int64())], names=["key", "spans", "n_removed"])


def repeats(df: DataFrame, hot: int = 3 * BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (merged, in bytes) and kept_sha of every row. hot: bytes of an anchor's stretches beyond which windows are counted over the cluster."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = plain_columns(df, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    unit = "struct<anchor:bigint,digest:bigint,first:int,last:int,twice:boolean>"
    facts = cut(docs.mapInArrow(_facts, f"doc_id long, key binary, n_bytes long, sha string, units array<{unit}>"), "stretches")
    each = facts.select("key", F.explode("units").alias("u")).select("key", "u.*")
    often = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 OR t").select("anchor")
    shared = cut(each.join(often, "anchor", "left_semi").groupBy("key", "anchor", "digest", "first", "last").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")), "shared")
    kinds = cut(shared.groupBy("anchor", "digest").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"), F.max(F.col("last") - F.col("first") + LENGTH).cast("long").alias("size"), F.min("key").alias("key")), "kinds")
    disputed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("t"), F.sum("size").alias("size")).where("c > 1 OR t")
    disputed = cut(disputed.select("anchor", (F.col("size") > hot).alias("hot")), "disputed")
    # one text shows each disputed stretch
    shown = kinds.join(disputed, "anchor", "left_semi").select("anchor", "digest", "key")
    shown = shared.join(shown, ["anchor", "digest", "key"], "left_semi").groupBy("key", "anchor", "digest").agg(F.min("first").alias("first"), F.min("last").alias("last"))
    wanted = cut(shown.groupBy("key").agg(F.collect_list(F.struct("anchor", "digest", "first", "last")).alias("units")), "wanted")
    bodies = cut(texts_of(docs, wanted).select("text", "units").mapInArrow(_bodies, "anchor long, digest long, body binary").join(disputed, "anchor"), "bodies")
    index = bodies.where("NOT hot").select("anchor", "digest", "body").repartition(parts, "anchor").sortWithinPartitions("anchor", "digest")
    found = index.mapInArrow(_blocks, "anchor long, digest long, starts array<int>, ends array<int>")
    found = found.select("anchor", "digest", F.explode(F.arrays_zip("starts", "ends")).alias("w")).select("anchor", "digest", F.col("w.starts").alias("a"), F.col("w.ends").alias("z"))
    rows = bodies.where("hot").dropDuplicates(["anchor", "digest"]).select("anchor", "digest", "body").mapInArrow(_window_rows, "anchor long, digest long, at int, hash long")
    twice = rows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "hash")
    counted = rows.join(twice, ["anchor", "hash"], "left_semi").select("anchor", "digest", F.col("at").alias("a"), F.col("at").alias("z"))
    found = cut(found.unionByName(counted), "windows")
    whole = shared.join(kinds.where("n > 1").select("anchor", "digest"), ["anchor", "digest"], "left_semi").select("key", F.col("first").alias("a"), F.col("last").alias("z"))
    some = shared.join(found, ["anchor", "digest"]).select("key", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("z")).alias("z"))
    marks = whole.unionByName(some).distinct().groupBy("key").agg(F.collect_list(F.struct("a", "z")).alias("marks"))
    spans = marks.mapInArrow(_merge, "key binary, spans array<struct<start:bigint,end:bigint>>, n_removed long")
    sizes = facts.groupBy("key").agg(F.max("n_bytes").alias("n"))
    spans = cut(spans.join(sizes, "key"), "spans")
    partly = texts_of(docs, spans.where("n_removed < n").select("key", "spans")).dropDuplicates(["key"]).mapInArrow(_kept, "key binary, kept_sha string")
    done = spans.join(partly, "key", "left").select("key", "spans", "n_removed", F.coalesce("kept_sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("kept_sha"))
    out = facts.select("doc_id", "key", "n_bytes", "sha").join(done, "key", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Which bytes go, by counting every window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out
