"""The registered queries over tables of odd cases and over empty ones: against SQL where there is some, else by brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import jaccard, langid, rindex, spotsigs
from weftline.llm.registry import QUERIES, SQL

from .conftest import rows


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("where", ["hard", "empty"])
def test_like_sql(spark, oracle, request, name, where):
    d = request.getfixturevalue(where)
    df = QUERIES[name](spark, d)
    columns, want = oracle(d, SQL[name])
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(key, df.select(*columns).collect())) == sorted(map(key, want))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def brute_components(docs, n, num, den):
    """doc_id to (size, component) by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_jaccard(spark, hard):
    got = QUERIES["op4_ngram_jaccard"](spark, hard).collect()
    want = brute_components([(r[0], r[1]) for r in rows() if r[0] is not None], 4, 85, 100)
    assert len(got) == len(rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert want[3][1] == want[2][1] == 1 and want[13][1] == want[11][1] == 10


def near_copies(groups=3, copies=14, words=90):
    r = np.random.default_rng(5)
    out, i = [], 0
    for g in range(groups):
        base = [f"w{g}_{k}" for k in range(words)]
        for _ in range(copies):
            w = list(base)
            for at in r.integers(0, words, r.integers(0, 3)):
                w[at] = f"x{r.integers(0, 10**9)}"
            out.append((i, " ".join(w)))
            i += 1
        out.append((i, " ".join(base[: words // 2] + [f"y{g}{k}" for k in range(words // 2)])))
        i += 1
    return out


@pytest.mark.parametrize("tile", [8000, 5])
@pytest.mark.parametrize("how", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_in_tiles(spark, tile, how):
    """Small tiles force the cut of a block, its leaders' meeting and the comparison of what remains."""
    docs = near_copies()
    got = jaccard.join(spark.createDataFrame(docs, "doc_id bigint, text string"), *how, tile=tile)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(docs, *how)


def test_band_keys_lose_no_pair():
    """Any two sets at the threshold share a key."""
    r = np.random.default_rng(1)
    for size in (6, 7, 9, 13, 20, 33, 64, 100, 181, 182, 400):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            gone = int(r.integers(0, max(1, size // 12) + 1))
            more = r.integers(0, 2**63, int(r.integers(0, max(1, size // 12) + 1))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            b = np.unique(np.concatenate([r.permutation(a)[gone:], more]))
            if not np.array_equal(a, b) and jaccard.links(a, b, 85, 100):
                assert np.intersect1d(jaccard.band_keys(a, 85, 100), jaccard.band_keys(b, 85, 100)).size, (len(a), len(b))


def test_occupancy_bounds():
    """Against simulation, and against each other where the exact count meets the bound."""
    r = np.random.default_rng(3)
    for k, d in ((10, 6), (47, 46), (200, 150)):
        hit = np.array([len(np.unique(r.integers(0, k, d))) for _ in range(4000)])
        p = jaccard._occupied(k, d)
        assert abs(p.sum() - 1) < 1e-9 and abs((p * np.arange(len(p))).sum() - hit.mean()) < 0.5
        assert jaccard.least_hit(k, d) <= hit.min() and hit.max() <= jaccard.most_hit(k, d) <= d
        mean, off = jaccard._bernstein(k, d, jaccard.LOSS)
        assert jaccard.most_hit(k, d) <= mean + off + 1
    for num, den in ((85, 100), (4, 5)):
        for low, high, k, most in jaccard.bands(num, den):
            assert k == 0 or k > most and jaccard.least_hit(k, max(1, -(-low * num // den))) > most, (low, high)


def test_linked_sets_share_as_many_keys_as_they_need():
    """In the larger set's band, both of a linked pair share the keys without which they are left out."""
    r = np.random.default_rng(2)
    for size in (8, 20, 64, 150, 181, 400, 900):
        for _ in range(20):
            a = np.unique(r.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            gone, more = (int(x) for x in r.integers(0, size // 12 + 1, 2))
            b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**63, more).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            if np.array_equal(a, b) or not jaccard.links(a, b, 85, 100):
                continue
            (x, nx), (y, ny) = (jaccard.banded(s, 85, 100) for s in (a, b))
            shared = Counter((np.intersect1d(x, y) & np.uint64(jaccard.BANDS - 1)).tolist())
            g = max({g for g, _ in nx} & {g for g, _ in ny} & {g for g, (low, high, *_) in enumerate(jaccard.bands(85, 100)) if low <= max(len(a), len(b)) < high})
            assert shared[g] >= max(dict(nx)[g], dict(ny)[g]), (len(a), len(b))


def test_meeting_streams_keys_over_batches():
    import pyarrow as pa

    r = np.random.default_rng(7)
    rows = sorted((int(k) * jaccard.BANDS + 3, int(i)) for k, i in zip(r.integers(0, 40, 400), r.integers(0, 30, 400), strict=True))
    ids = {}
    for k, i in rows:
        ids.setdefault(k, set()).add(i)
    want = Counter((i, min(own), 3) for own in ids.values() if len(own) > 1 for i in own)
    for step in (1, 2, 7, 1000):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = (pa.RecordBatch.from_arrays([pa.array([x[c] for x in p], pa.int64()) for c in (0, 1)], names=["key", "id"]) for p in [[], *parts])
        assert Counter(tuple(x.values()) for b in jaccard.meet(batches) for x in b.to_pylist()) == want


def check_repeats(got, docs):
    gone = rindex.brute([(t or "").encode() for _, t in docs])
    want = Counter()
    for (i, t), g in zip(docs, gone, strict=True):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        want[(i, len(raw), int(g.sum()), len(rindex.runs(g)[0]), hashlib.sha256(raw[~g].tobytes()).hexdigest())] += 1
    assert Counter(got) == want


def test_suffix_dedup(spark, hard):
    got = QUERIES["op7_suffix_dedup"](spark, hard)
    check_repeats([tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], [(r[0], r[1]) for r in rows()])


@pytest.mark.parametrize("hot", [10**9, 0])
def test_suffix_dedup_both_ways(spark, hot):
    line = "".join(f"part {i} of a line; " for i in range(40))
    texts = ["a" * 1200, line, line[:500] + "#" + line[500:], "x" * 450 + line[100:600], "periodic " * 200, "short", "é" * 300, "é" * 300 + "!", line[:399]]
    docs = list(enumerate(texts))
    out = rindex.repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), hot=hot)
    check_repeats([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in out.collect()], docs)


def test_run_index_marks_all_repeats():
    r = np.random.default_rng(3)
    for _ in range(15):
        base = [bytes(r.choice(list(b"abc"), int(r.integers(20, 90))).tolist()) for _ in range(3)]
        parts = list(dict.fromkeys(b"".join(base[i] for i in r.integers(0, 3, int(r.integers(2, 6)))) for _ in range(7)))
        seen = Counter(p[i : i + 40] for p in parts for i in range(len(p) - 39))
        for p, on in zip(parts, rindex.repeated_windows(parts, 40), strict=True):
            assert on.tolist() == [seen[p[i : i + 40]] > 1 for i in range(len(p) - 39)]


def check_packing(got, docs):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in docs)
    ids = {i: np.array(x, "<u4") for i, x in want}
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, Counter())[(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    padding = sum(1024 - n for n in (sum(x for _, x in s) for s in seqs.values()) if n & (n - 1))
    assert padding < 1024 * len({k >> 32 for k in seqs}) + 1
    for i, own in pieces.items():
        if i is None:
            continue
        times = sum(n for (d, _), n in want.items() if d == i)
        assert sum(length * n for (_, length, _, _), n in own.items()) == times * len(ids[i])
        for start, length, crc, total in own:
            assert zlib.crc32(ids[i][start : start + length].tobytes()) == crc and total == len(ids[i])
    assert pieces.keys() == {i for i, _ in docs}


def test_packing(spark, hard):
    check_packing(QUERIES["op8_packing"](spark, hard).collect(), [(r[0], r[1]) for r in rows()])


def test_fingerprints(spark, hard):
    got = QUERIES["op10_spot_signatures"](spark, hard).collect()
    docs = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter()
    for i, (d, t) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        e = spotsigs.edited(t, following)
        a, b, c = map(spotsigs.signatures, (t, e, following))
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.fingerprint(a), spotsigs.fingerprint(b), spotsigs.likeness(a, b), spotsigs.likeness(a, c))] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint != by[4].fingerprint


def plain_signatures(text):
    """SpotSigs by hand, with the words of chains in place of hashes."""
    import re

    from weftline.llm.quality import STOP_WORDS

    frequent = {w.lower() for w in STOP_WORDS}
    ws = re.findall(r"\w+", text.lower())
    content = [w for w in ws if w not in frequent]
    if len(content) < 5:
        return {("", *content)} if content else set()
    out, read, before = set(), set(), 0
    for anchor in ["", *ws]:
        if anchor and anchor not in frequent:
            before += 1
        elif before < len(content):
            out.add((anchor, *content[before : before + 5 : 2]))
            read |= set(range(before, before + 5, 2))
    return out | {("", *content[i : i + 5 : 2]) for i in range(len(content)) if i not in read}


def jaccard_of(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


def test_fingerprints_by_hand(spark, hard):
    """Against sets of words made here, whose Jaccard is counted here."""
    got = QUERIES["op10_spot_signatures"](spark, hard).collect()
    docs = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want, prints = Counter(), {}
    for i, (d, t) in enumerate(docs):
        following, n = docs[(i + 1) % len(docs)][1], len(t) // 3
        e = t[: len(t) - n] + following[:n]
        own, new, other = map(plain_signatures, (t, e, following))
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), len(own), round(jaccard_of(own, new), 9), round(jaccard_of(own, other), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, int(r.fingerprint.split(":")[0]), round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    for r in got:  # equal fingerprints, equal sets
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    sets = {}
    for d, t in docs:
        sets.setdefault(frozenset(plain_signatures(t)), set()).add(d)
    assert set(map(frozenset, prints.values())) == set(map(frozenset, sets.values()))


def test_near_copies_by_signatures(spark):
    """Against the Jaccard of all pairs of sets made by hand."""
    docs = [(i, t.replace("w", "the w", 3)) for i, t in near_copies(2, 8, 60)] + [(900, None), (901, "")]
    sets = {i: plain_signatures(t or "") for i, t in docs}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and jaccard_of(sets[a], sets[b]) >= 0.8:
                x, y = sorted((up[a], up[b]))
                up = {k: x if v == y else v for k, v in up.items()}
    got = spotsigs.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), up[i]) for i in sets}
    assert len(set(up.values())) < len(up)


def test_likeness_is_pruned_jaccard():
    a, b = np.arange(10, dtype=np.uint64), np.arange(5, 12, dtype=np.uint64)
    assert spotsigs.likeness(a, b) == 5 / 12 and spotsigs.likeness(a, b, 0.5) == 0.0
    assert spotsigs.likeness(a, a[:2], 0.5) == 0.0 and spotsigs.likeness(a[:0], a[:0]) == 1.0 and spotsigs.likeness(a, a[:0]) == 0.0


def test_language_id(spark, hard):
    got = QUERIES["op3_language_id"](spark, hard).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert (by[6].lang_pred, by[6].score) == ("und", 0.0) and by[7].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got)
    assert by[1].held_out == (zlib.crc32(b"1") % 5 == 0)


def test_language_accuracy_and_mixed_text(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(d)
    held = d.where(langid.fold(d.doc_id) == 0)
    got = langid.predict(held.select("doc_id", "text"), model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    text = "the tion of and with the nter. " * 6 + "der die ung nicht schen und keit. " * 6
    (spans, letters), (none, _) = langid.label([text, None], model)
    assert [model.languages[x] for _, _, x in spans] == ["en", "de"] and none == []
    assert letters.sum() == sum(c.isalpha() for c in text)


def test_viterbi_is_best_path():
    """Against all paths of a few words."""
    from itertools import product

    r = np.random.default_rng(2)
    lengths = np.array([4, 1, 0, 3])
    s = r.normal(size=(lengths.sum(), 3)).astype(np.float32) * 3
    got, at = langid.viterbi(s, lengths, 2.0), 0
    for n in lengths.tolist():
        worth = lambda p, at=at: sum(s[at + i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(worth(p) for p in product(range(3), repeat=n))
        assert worth(tuple(got[at : at + n])) == pytest.approx(best, abs=1e-4)
        at += n


def test_languages_by_hand(spark):
    """The query's predictions against the best of all label paths, from counts made here with dictionaries."""
    import math
    from itertools import product

    r = np.random.default_rng(8)
    stems = {"aa": ["kalo", "mira", "tosu", "pela"], "bb": ["strek", "vund", "grolt", "knapf"], "cc": ["ouai", "eauxe", "ieuno", "aouel"]}
    docs = [(i, " ".join(r.choice(stems[la], 5)) + ("" if i % 3 else " " + stems["aa"][i % 4]), la) for i, la in enumerate(sorted(stems) * 12)] + [(99, "12 ?", "aa"), (98, None, "bb")]
    mask = (1 << 64) - 1

    def grams(w):
        p = [2, *map(ord, w), 3]
        for n in (1, 2, 3, 4):
            for at in range(len(p) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + p[at + k] + k + 1) & mask
                    h ^= h >> 29
                yield (h * 0xBF58476D1CE4E5B9 & mask) >> 48

    counts = {la: Counter() for la in stems}
    for i, t, la in docs:
        if t and zlib.crc32(str(i).encode()) % 5:
            for w in langid.LETTERS.findall(t.lower()):
                counts[la].update(grams(w))

    def score(w):
        s = [sum(math.log((counts[la][g] + 0.5) / (counts[la].total() + 0.5 * 65536)) for g in grams(w)) for la in sorted(stems)]
        norm = max(s) + math.log(sum(math.exp(x - max(s)) for x in s))
        return [max(x - norm, -6.0) for x in s]

    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df.select("doc_id", "text"), langid.fit(df)).collect()}
    for i, t, _ in docs:
        ws = langid.LETTERS.findall((t or "").lower())
        if not ws:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        s = [score(w) for w in ws]
        best = max(product(range(3), repeat=len(ws)), key=lambda p: sum(s[k][x] for k, x in enumerate(p)) - 9.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        letters = [sum(len(w) for w, x in zip(ws, best, strict=True) if x == k) for k in range(3)]
        top = max(range(3), key=lambda k: (letters[k], -k))
        assert got[i].lang_pred == sorted(stems)[top] and got[i].score == pytest.approx(letters[top] / sum(letters)), (i, t)


def test_model_does_not_see_the_fold(spark):
    rows_ = [(i, "alpha beta gamma delta" if zlib.crc32(str(i).encode()) % 5 else "omega", "en" if zlib.crc32(str(i).encode()) % 5 else "xx") for i in range(40)]
    assert langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string")).languages == ["en"]
