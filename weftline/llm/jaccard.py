"""Exact Jaccard join of word n-gram sets: size-banded tiles, hashed bitmaps, sorted-array intersection.

1. Documents with equal sets form a class (a digest, summed before it is shuffled); one stands for all, and of a task's
   equal sets one gives keys. Keys go with 64 bits of the digest; where those meet by chance, sets are only compared.
2. Candidates. Where sets of a size band link they differ in a bounded number of elements, which fall into a bounded number
   of k ranges of the hash space: the others hold the same elements in both. Each non-empty range's content is hashed to a
   key, and k is so large that nearly all sets have more non-empty ranges than can differ; any other set also gives keys
   for its empty ranges. The bounds hold but for one linked pair in 1e12, as hashes collide. A set gives keys in its own
   band and in each band of larger sets that it can link with. It shares as many keys as it has beyond the ranges that can
   differ, or it goes, as do keys left to one set. Keys are sorted and streamed, so that a key which many sets have needs
   no memory; one of N sets is at most one row in hundreds.
3. Sets that share keys form blocks (connected components over stars, a linear number of edges).
4. A block that fits one tile, by the number of its sets and by their bytes, is one. Of a larger block, the sets that
   share the leading set of a key form a tile for each size band (a key belongs to one band), so that sets which only a
   chain of others connects don't meet. A tile compares its sets, smallest first: those of one known component are
   skipped, sizes and then bitmaps bound the overlap from above (differing bits need differing elements), and what is left
   is intersected exactly. Such a group beyond one tile is cut into several; then the smallest of each component meet, and
   where several components remain, every set outside the largest one meets all others, tile by tile. The union of all
   links found is exact. Tiles are planned over ids and sizes; texts are dealt to them, and sets made there.

Defined results: a null or empty text, or one without words, has the empty set, links with nothing and is its own
component; a text of fewer words than n is one shingle; ties and repeated rows are members of one class; rows that repeat
a doc_id with other texts are one document, linked where one of them is; a row without doc_id has the component of the rows
with an equal set, and null if there are none, and carries no link; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, plain_columns, table
from .components import components

#: Most sets, and most bytes of sets, that meet in one tile.
TILE = 8_000
TILE_BYTES = 48_000_000
#: Bytes of a set beside its hashes: bitmap, digest, objects.
SET_BYTES = 700
#: More than the size bands; a power of two.
BANDS = 128
SetMaker = Callable[[], Callable[[bytes | None], np.ndarray]]
NEEDS = pa.list_(pa.struct([("band", pa.int32()), ("need", pa.int32())]))
FILTER_BITS = 1 << 24
C1, C2, C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """The sorted distinct 64-bit hashes of a text's n-grams of words; A-Z are lower-cased, other letters are not."""

    def __init__(self, n: int, most: int = 500_000) -> None:
        self.n, self.most, self.known = n, most, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = (text or b"").lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.most:
            self.known.clear()
        known, h = self.known, xxhash.xxh64_intdigest
        for w in set(ws).difference(known):
            known[w] = h(w)
        a = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        n = min(self.n, len(a))
        x = a[: len(a) - n + 1] + np.uint64(n)
        for i in range(1, n):
            x = mix(x * C1 + a[i : len(a) - n + 1 + i])
        return np.unique(mix(x))


#: Elements up to which occupancy is counted exactly; beyond, Bernstein's bound holds it (occupied ranges are a sum of
#: independent indicators).
EXACT = 400
#: A linked pair is lost, and a set gives keys for its empty ranges, with at most these probabilities.
LOSS, ODD = 1e-12, 1e-5


@lru_cache(4096)
def _occupied(k: int, d: int) -> np.ndarray:
    """Probabilities of how many of k ranges d elements of random hashes fall into."""
    p = np.zeros(min(k, d) + 1)
    p[0] = 1.0
    stay = np.arange(len(p)) / k
    for _ in range(d):
        move = p[:-1] * (1 - stay[:-1])
        p *= stay
        p[1:] += move
    return p


def _bernstein(k: int, d: int, miss: float) -> tuple[float, float]:
    one, two = (1 - 1 / k) ** d, (1 - 2 / k) ** d if k > 1 else 0.0
    var, log = max(0.0, k * (k - 1) * two + k * one - (k * one) ** 2), -math.log(miss)
    return k * (1 - one), log / 3 + math.sqrt(log * log / 9 + 2 * var * log)


@lru_cache(4096)
def most_hit(k: int, d: int) -> int:
    """Of k ranges, how many d elements fall into at most, but for a probability of LOSS."""
    if d > EXACT:
        mean, off = _bernstein(k, d, LOSS)
        return min(d, k, math.ceil(mean + off))
    above = np.cumsum(_occupied(k, d)[::-1])[::-1]  # of so many or more
    return int(np.flatnonzero(above >= LOSS)[-1])


@lru_cache(4096)
def least_hit(k: int, n: int) -> int:
    """How many n elements fall into at least, but for a probability of ODD."""
    if n > EXACT:
        mean, off = _bernstein(k, n, ODD)
        return max(1, math.floor(mean - off))
    return int(np.flatnonzero(np.cumsum(_occupied(k, n)) >= ODD)[0])


@lru_cache(8)
def bands(num: int, den: int, top: int = 1 << 40) -> list[tuple[int, int, int, int]]:
    """(lowest size, lowest size of the next, ranges k, most of them that differ in a linked pair) for the threshold num / den.
    k is 0 where sets of a band link only if they are equal; else so large that the smallest set of the band occupies more
    ranges than can differ."""
    out, low = [], 2
    while low < top:
        high = max(low + 1, math.ceil(low * math.sqrt(2)))
        differ = 2 * (high - 1) * (den - num) // (den + num)
        smallest = max(1, -(-low * num // den))
        k = max(2, differ // 3) if differ else 0
        while k and least_hit(k, smallest) <= most_hit(k, differ) and k < 64 * high:
            k += max(1, k // 12)
        out.append((low, high, k, most_hit(k, differ) if k else 0))
        low = high
    return out


@lru_cache(256)
def _ranges(k: int) -> np.ndarray:
    return np.array([(j << 64) // k for j in range(k)], np.uint64)


def banded(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The keys of a set, each with its size band in the lowest bits; and (band, need): how many keys of the band at least
    are shared with any set that it links with there."""
    n, out, needs = len(s), [], []
    mixed = mix(s + C1)
    for g, (low, high, k, most) in enumerate(bands(num, den)):
        if high <= n:
            continue
        if low > n and n * den < low * num:
            break
        if not k:
            continue  # sets of this band link only where they are equal
        at = np.searchsorted(s, _ranges(k))
        full = np.diff(at, append=n) > 0
        salt = np.arange(k, dtype=np.uint64) * C1 + np.uint64(g << 40)
        sums = np.add.reduceat(mixed, at[full])
        own, held = [mix(sums + mix(salt[full]))], int(full.sum())
        # so many ranges at most differ; the others' content is shared where it isn't empty
        if held <= most:
            own.append(mix(~mix(salt[~full])))
            needs.append((g, 1))
        else:
            needs.append((g, held - most))
        out += [(x & ~np.uint64(BANDS - 1)) | np.uint64(g) for x in own]
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), needs


def band_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    return banded(s, num, den)[0]


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, id) sorted by both, to (id, lead, band) of every key that different ids have; lead: its smallest id, which
    is among the ids. A key is streamed, however many rows it has."""
    key, lead, last_id, shown = None, None, None, False
    for batch in batches:
        keys, ids = (batch.column(c).to_numpy() for c in ("key", "id"))
        new = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        if not len(keys):
            continue
        starts = np.flatnonzero(new)
        group = np.cumsum(new)  # 0: goes on from the batch before
        leads = np.concatenate([[lead if lead is not None else 0], ids[starts]]).astype(np.int64)[group]
        same = np.concatenate([[ids[0] == last_id], ids[1:] == ids[:-1]]) & ~new
        other = (ids != leads) & ~same
        first = np.unique(group[other], return_index=True)[1]
        at = np.flatnonzero(other)[first]  # the first row of each group that has another id
        tell = at if not (shown and len(at) and group[at[0]] == 0) else at[1:]
        out_id = np.concatenate([ids[other], leads[tell]])
        out_lead = np.concatenate([leads[other], leads[tell]])
        band = (np.concatenate([keys[other], keys[tell]]) & (BANDS - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(out_id), pa.array(out_lead), pa.array(band)], names=["id", "lead", "band"])
        last = group[-1]
        shown = bool((group[at] == last).any()) or (shown and last == 0)
        key, lead, last_id = keys[-1], leads[-1], ids[-1]


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return den * both >= num * (len(a) + len(b) - both)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words a set; as many bits as the largest set has elements, 4096 at most."""
    bits = min(4096, max(64, 1 << (max(map(len, sets)) - 1).bit_length()))
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for row, s in zip(out, sets, strict=True):
        at = (s & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(row, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


def solve(nodes: list[int], sets: list[np.ndarray], known: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning set of the links between the tile's sets, beyond the components that are known."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    nodes, sets = [nodes[i] for i in order], [sets[i] for i in order]
    names: dict[int, int] = {}
    comp = np.array([names.setdefault(known[i], len(names)) for i in order])
    sizes = np.array([len(s) for s in sets])
    if len(names) == 1:
        return []
    maps, found = bitmaps(sets), []
    for i in range(1, len(sets)):
        first = int(np.searchsorted(sizes, -(-int(sizes[i]) * num // den)))
        while True:
            rest = first + np.flatnonzero(comp[first:i] != comp[i])
            if not len(rest):
                break
            near = rest[-64:] if len(rest) > 64 else rest  # a few first: in a large group one of them links
            for some in (near, rest[: len(rest) - len(near)]):
                differ = np.bitwise_count(maps[some] ^ maps[i]).sum(1, dtype=np.int64)
                total = sizes[some] + sizes[i]
                both = (total - differ) // 2  # at most
                may = some[den * both >= num * (total - both)]
                hit = next((j for j in may[np.argsort(-both[den * both >= num * (total - both)], kind="stable")].tolist() if links(sets[i], sets[j], num, den)), None)
                if hit is not None:
                    break
            if hit is None:
                break
            found.append((nodes[i], nodes[hit]))
            comp[comp == comp[i]] = comp[hit]
    return found


def join(df: DataFrame, n: int, num: int, den: int, tile: int = TILE, tile_bytes: int = TILE_BYTES, sets: SetMaker | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text). sets: makes a function of a text's bytes to its sorted
    distinct hashes, in place of n-grams of words."""
    sets = sets or (lambda: Shingler(n))
    spark = df.sparkSession
    docs = plain_columns(df, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = sets(), set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            sizes, digests, keys, needs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                s = shingles(text.as_py())
                digest = xxhash.xxh3_128_digest(s.tobytes())
                sizes.append(len(s))
                digests.append(digest)
                own, need = none, []
                if len(s) and doc_id is not None and digest not in seen:  # equal sets have equal keys: one of a task's shows them
                    own, need = banded(s, num, den)
                    seen.add(digest)
                keys.append(own.view(np.int64))
                needs.append([{"band": g, "need": k} for g, k in need])
            flat = np.concatenate(keys) if keys else none
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            ids = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(needs, NEEDS)],
                names=["doc_id", "n_shingles", "digest", "id", "keys", "needs"],
            )

    every = cut(docs.mapInArrow(describe, "doc_id long, n_shingles long, digest binary, id long, keys array<long>, needs array<struct<band:int,need:int>>"), "sets")
    facts = cut(every.drop("keys"), "facts", count=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = every.select("id", F.explode("keys").alias("key")).repartition(parts, "key").sortWithinPartitions("key", "id")
    stars = cut(keyed.mapInArrow(meet, "id long, lead long, band int").groupBy("id", "lead", "band").agg(F.count(F.lit(1)).alias("n")), "stars", count=True)
    free(every)
    needs = facts.select("id", F.explode("needs").alias("x")).groupBy("id", "x.band").agg(F.min("x.need").alias("need"))
    for _ in range(2):  # every set that goes leaves fewer shared keys to the others
        enough = stars.groupBy("id", "band").agg(F.sum("n").alias("own")).join(needs, ["id", "band"]).where("own >= need").select("id", "band")
        left = stars.join(enough, ["id", "band"], "left_semi")
        met = left.groupBy("lead", "band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("lead", "band")
        stars = cut(left.join(met, ["lead", "band"], "left_semi"), "stars", rows=stars.cut_rows, count=True)
    blocks = components(stars.select(F.col("id").alias("a"), F.col("lead").alias("b")), rows=stars.cut_rows).select(F.col("node").alias("id"), F.col("component").alias("block"))
    blocks = blocks.join(stars.select("id").distinct(), "id", "left_semi")
    classes = cut(facts.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("id").alias("id"), F.first("n_shingles").alias("n_shingles")), "classes", rows=facts.cut_rows)
    # a set's share of a tile, by count and by bytes
    weight = F.greatest(F.lit(1.0 / tile), (F.col("n_shingles") * 8 + SET_BYTES) / tile_bytes)
    active = cut(classes.join(blocks, "id").withColumn("weight", weight), "active", rows=facts.cut_rows)
    found = compare(docs, active, stars, sets, num, den)
    comps = components(found, rows=found.cut_rows)
    of = classes.join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    out = facts.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out.cut_rows = facts.cut_rows  # as of a table that cut() gives
    return out


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + C1) & np.uint64(bits - 1)).astype(np.int64)


def _there(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bit(ids, 64 * len(bitmap))
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _filter(df: DataFrame, column: str, size: int) -> np.ndarray:
    """A bitmap of a column's hashed numbers, of one size whatever their count. It only saves shuffling: the join behind it is exact."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bit(batch.column(column).to_numpy(), size)
            yield pa.RecordBatch.from_pydict({"word": at >> 6, "bit": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    words = df.select(column).mapInArrow(bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def solved(docs: DataFrame, tiles: DataFrame, sets: SetMaker, num: int, den: int) -> DataFrame:
    """Links (a, b) found in tiles, of rows (tile, node, digest, known). Texts are dealt to their tiles, which are smaller
    than the sets, and the sets are made there again; a text whose set has another digest is another row of its doc_id."""
    spark = docs.sparkSession
    active = spark.sparkContext.broadcast(_filter(tiles, "node", FILTER_BITS))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = active.value, set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keep = []
            for i in np.flatnonzero(_there(held, ids)).tolist():
                mark = (int(ids[i]), xxhash.xxh3_64_intdigest(batch.column("text")[i].as_py() or b""))
                if mark not in sent:
                    sent.add(mark)
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("doc_id", "text")], names=["node", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, now = sets(), None
        held: dict[bytes, tuple[int, int, np.ndarray]] = {}

        def done() -> pa.RecordBatch:
            rows = list(held.values())
            got = solve([r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows], num, den) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for i, t in enumerate(batch.column("tile").to_pylist()):
                if t != now:
                    if held:
                        yield done()
                    now, held = t, {}
                digest = batch.column("digest")[i].as_py()
                if digest not in held:
                    s = shingles(batch.column("text")[i].as_py())
                    if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                        held[digest] = (batch.column("node")[i].as_py(), batch.column("known")[i].as_py(), s)
        if held:
            yield done()

    texts = docs.where("doc_id IS NOT NULL").mapInArrow(fetch, "node long, text binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.join(tiles, "node").select("tile", "node", "digest", "known", "text").repartition(parts, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(run, "a long, b long")


def compare(docs: DataFrame, active: DataFrame, stars: DataFrame, sets: SetMaker, num: int, den: int) -> DataFrame:
    """Links (a, b) between the sets of each block, of rows (node, id, digest, weight, block); enough of them for its components."""
    whole = F.col("w") <= 1
    active = active.join(active.groupBy("block").agg(F.sum("weight").alias("w")), "block")
    small = active.where(whole).select("node", "digest", F.col("block").cast("string").alias("tile"))
    # of a larger block, the sets that share a key, which has a size band, meet
    large = cut(active.where(~whole).join(stars.select("id", "lead", "band"), "id").select("node", "digest", "weight", F.concat_ws("/", "lead", "band").alias("tile")), "large")
    cuts = large.groupBy("tile").agg(F.ceil(F.sum("weight")).cast("long").alias("cuts"))
    large = large.join(cuts, "tile").withColumn("part", F.pmod(F.xxhash64("node"), F.col("cuts")))
    first = small.unionByName(large.select("node", "digest", F.concat_ws("/", "tile", "part").alias("tile")))
    found = cut(solved(docs, cut(first.withColumn("known", F.col("node")), "tiles"), sets, num, den), "links", count=True)
    hot = large.where("cuts > 1")
    if hot.isEmpty():
        return found
    hot = cut(hot, "hot")
    for leaders in (True, False):
        state = hot.join(components(found, rows=found.cut_rows), "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component")
        counts = state.groupBy("tile", "known").agg(F.count(F.lit(1)).alias("m"))
        best = counts.groupBy("tile").agg(F.max(F.struct("m", "known"))["known"].alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        state = cut(state.join(best, "tile"), "state")
        if leaders:
            own = state.where("node = known")
            parts = own.groupBy("tile").agg(F.ceil(F.sum("weight")).cast("long").alias("parts"))
            tiles = own.join(parts, "tile").withColumn("tile", F.concat_ws("/", "tile", F.pmod(F.xxhash64("known"), F.col("parts"))))
        else:
            # every set outside the main component, in tiles of its own, meets every tile of the group
            rest = state.where("known <> main")
            many = rest.groupBy("tile").agg(F.ceil(F.sum("weight")).cast("long").alias("rests"))
            rest = rest.join(many, "tile").withColumn("r", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")))
            rest = rest.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
            all_ = state.join(many, "tile").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1))).withColumn("t", F.col("part"))
            keep = ["tile", "node", "digest", "known", "r", "t"]
            tiles = all_.select(*keep).unionByName(rest.select(*keep)).distinct().withColumn("tile", F.concat_ws("/", "tile", "r", "t"))
        found = cut(found.unionByName(solved(docs, cut(tiles.select("node", "digest", "tile", "known"), "tiles"), sets, num, den)), "links", count=True)
    return found


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest doc_id
    stays; of rows that repeat a doc_id and text, one; rows without doc_id stay, one of each text."""
    found = join(docs, n=5, num=4, den=5)
    found = cut(found, "groups", rows=found.cut_rows)
    gone = found.where("doc_id <> component_id").select("doc_id", F.lit(1).alias("__how"))
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    once = docs.where("doc_id IS NOT NULL").join(gone.select("doc_id").unionByName(twice).distinct(), "doc_id", "left_anti")
    again = docs.join(twice, "doc_id", "left_semi").join(gone.select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*names).unionByName(again.select(*names)).unionByName(docs.where("doc_id IS NULL").dropDuplicates(["text"]))
