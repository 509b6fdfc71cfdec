import random
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.llm import common, components, partenum, repeats, substring_dedup, suffix_dedup
from cellforge.llm import textnum as tn
from cellforge.llm.shingles import Shingles
from tests.llm import brute
from tests.llm.corpus import documents


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def sha(c):
    return F.sha2(F.col(c).cast("binary"), 256).alias("sha")


@pytest.mark.parametrize("hot", [8192, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed, hot):
    docs = documents(seed)
    got = substring_dedup.dedup(frame(spark, docs), hot=hot).select("doc_id", "n_words", "n_removed", sha("kept_text")).collect()
    assert Counter(map(tuple, got)) == brute.substring_dedup(docs)


@pytest.mark.parametrize("window,gram,hot", [(400, 40, 8192), (60, 10, 8192), (60, 10, 2)])
def test_suffix_dedup(spark, window, gram, hot):
    docs = documents(3)
    got = suffix_dedup.dedup(frame(spark, docs), window, gram, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", sha("kept")).collect()
    assert Counter(map(tuple, got)) == brute.suffix_dedup(docs, window)


def test_contested_windows_before_the_arrays(monkeypatch):
    """Only what may be equal gets into a suffix array, and nothing that is equal stays out."""
    rng = random.Random(4)
    window, gram, texts = 24, 5, []
    passage = bytes(rng.choices(b"abcd", k=90))
    for _ in range(60):
        t = bytearray(rng.choices(b"abcd", k=rng.randint(10, 150)))
        for _ in range(rng.randint(0, 2)):
            a = rng.randrange(80)
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage[a : a + rng.randint(6, 50)]
        texts.append(bytes(t))
    data, rows = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    runs = list(zip(*tn.anchors(tn.Prefix(tn.byte_values(data)), rows, window, gram)))
    seen = Counter(int(r[3]) for r in runs)
    refs = [(int(k), int(a - rows[k]), data[a : z + window].tobytes(), int(np.uint64(h).view(np.int64))) for k, a, z, h in runs if seen[int(h)] > 1]
    arrays, exact = [], suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda c, w: arrays.extend(c) or exact(c, w))
    for classes in (1, 3, 9, 20):
        monkeypatch.setattr(suffix_dedup.hopeful, "__defaults__", (classes,))
        arrays.clear()
        found, refused = suffix_dedup.index(refs, [], True, window, gram)
        marked = {(k, w) for k, s, e in found for w in range(s, e - window + 1)}
        where = Counter(body[w : w + window] for _, _, body, _ in refs for w in range(len(body) - window + 1))
        want = {(k, lo + w) for k, lo, body, _ in refs for w in range(len(body) - window + 1) if where[body[w : w + window]] > 1}
        assert want and want <= marked and not refused  # joined spans may cover windows between
        assert {b for k, s, e in found for b in ((k, x) for x in range(s, e))} == {(k, x) for k, w in want for x in range(w, w + window)}
        if classes > 1:
            assert sum(map(len, arrays)) < 0.8 * sum(len(r[2]) for r in refs)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        t = rng.integers(0, 3, n)
        sa = suffix_dedup.suffix_array(t)
        raw = bytes(t.tolist())
        want = sorted(range(n), key=lambda i: raw[i:])
        assert sa.tolist() == want
        lcp = suffix_dedup.kasai(t.astype(np.uint8), np.arange(n, 0, -1), sa, 10, lanes=7)
        for r in range(1, n):
            a, b, k = raw[want[r - 1] :], raw[want[r] :], 0
            while k < 10 and k < len(a) and k < len(b) and a[k] == b[k]:
                k += 1
            assert lcp[r] == k


def test_shards_merge_by_binary_search():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 4, 40)
    ctx = [np.concatenate([rng.integers(0, 4, 9), shared[rng.integers(0, 9) :], rng.integers(0, 4, 9)]).astype(np.uint8) for _ in range(30)]
    whole = suffix_dedup.repeated_windows(ctx, 20)
    split = suffix_dedup.repeated_windows(ctx, 20, limit=130)
    assert [w.tolist() for w in whole] == [s.tolist() for s in split]


def test_automaton():
    rng = np.random.default_rng(2)
    seqs = [[b"%d" % x for x in rng.integers(0, 3, 30)] for _ in range(20)]
    runs = [(n // 2, 40 * (n % 2), b" ".join(s), 0) for n, s in enumerate(seqs)]
    found, _ = substring_dedup.index(runs, [], True, 5)
    got, seen = set(), set()
    for key, s, e in found:
        got.update((key, p) for p in range(s, e))
    want = set()
    for (key, lo, _, _), t in zip(runs, seqs):
        wins = [tuple(t[i : i + 5]) for i in range(26)]
        want.update((key, lo + p) for i, w in enumerate(wins) if w in seen for p in range(i, i + 5))
        seen.update(wins)
    assert got == want


def test_only_earlier_places_count():
    """A run that the reference itself holds is no repeat; nor is one that only starts later."""
    body = b" ".join(b"w%d" % n for n in range(30))
    words = lambda a, b: substring_dedup.index([(*a, body, 0)], [(*b, body, 0)], False)
    assert words((1, 0), (1, 0)) == ([], [(1, 0, body, 0)])
    assert words((1, 0), (0, 5)) == ([], [(0, 5, body, 0)])
    assert words((1, 0), (2, 5)) == ([(2, 5, 35)], [])
    raw, nul = body * 3, lambda n: b"\0" * n
    suffixes = lambda refs, runs: suffix_dedup.index([(*r, 0) for r in refs], [(*r, 0) for r in runs], False, 50)
    assert suffixes([(1, 0, raw)], [(1, 0, raw)]) == ([], [(1, 0, raw, 0)])
    assert suffixes([(1, 0, raw)], [(1, 0, body)]) == ([(1, 0, len(body))], [])
    assert suffixes([(1, 0, raw + nul(60)), (4, 0, nul(90))], [(2, 7, nul(60)), (3, 0, nul(91))]) == ([(2, 7, 67)], [(3, 0, nul(91), 0)])


def thue_morse(n=1024):
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_constructed_collisions(spark):
    """Words that polynomial hashes modulo 2^64 cannot tell apart, whatever their base and table."""
    tail = " " + " ".join(f"t{i}" for i in range(19))
    one, two = thue_morse()
    assert tn.word_hashes(np.frombuffer(one.encode(), np.uint8), np.array([0]), np.array([1024])) == tn.word_hashes(np.frombuffer(two.encode(), np.uint8), np.array([0]), np.array([1024]))
    docs = [(1, one + two + tail), (2, two + one + tail)]
    assert sorted(r.n_removed for r in substring_dedup.dedup(frame(spark, docs)).collect()) == [0, 0]
    docs = [(1, one), (2, two)]
    assert sorted(r.component_id for r in partenum.join_components(frame(spark, docs)).collect()) == [1, 2]
    docs = [(1, one + two), (2, two + one)]
    assert Counter(map(tuple, suffix_dedup.dedup(frame(spark, docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", sha("kept")).collect())) == brute.suffix_dedup(docs)


def test_refused_claims_remove_nothing(spark, monkeypatch):
    """Were all digests equal, wrong claims would be refused and another salt tried."""
    keyed = common.with_key(frame(spark, documents(1)), "keyed")
    units, index, real = repeats.Units("word", 20, 5), partial(substring_dedup.index, window=20), repeats.occurrences
    monkeypatch.setattr(repeats, "occurrences", lambda *a: real(*a).withColumn("ctx", F.lit(7).cast("long")))
    assert repeats._attempt(keyed, units, index, True, 2048, 2048, 0) is None
    with pytest.raises(RuntimeError):
        repeats.repeated_spans(keyed, units, index, True)


def test_long_witnesses_are_cut_and_hot_ones_copied(spark, monkeypatch):
    monkeypatch.setattr(repeats.Units, "shard", property(lambda self: 240 if self.kind == "word" else 2400))
    rng = np.random.default_rng(8)
    long = [f"v{x}" for x in rng.integers(0, 10**6, 300)]
    docs = [(n, " ".join(long if n % 3 else long[n:] + ["x"] * 3 + long[: n + 25])) for n in range(30)]
    got = substring_dedup.dedup(frame(spark, docs)).select("doc_id", "n_words", "n_removed", sha("kept_text")).collect()
    assert Counter(map(tuple, got)) == brute.substring_dedup(docs)
    got = suffix_dedup.dedup(frame(spark, docs), 60, 10).select("doc_id", "n_bytes", "n_removed", "n_spans", sha("kept")).collect()
    assert Counter(map(tuple, got)) == brute.suffix_dedup(docs, 60)


def test_windows_of_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    values = rng.integers(0, 5, 900).astype(np.uint64)
    rows = np.array([0, 10, 400, 400, 900])

    def starts():
        row, lo, hi, h = tn.anchors(tn.Prefix(values), rows, 20, 5)
        return sorted((int(r), int(p), int(g)) for r, a, z, g in zip(row, lo, hi, h) for p in range(a, z + 1))

    whole = starts()
    monkeypatch.setattr(tn, "PART", 64)
    assert starts() == whole


@pytest.mark.parametrize("block", [512, 3])
@pytest.mark.parametrize("seed", [4, 5])
def test_join_components(spark, seed, block):
    docs = documents(seed, 140)
    got = partenum.join_components(frame(spark, docs), block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute.join_components(docs)


@pytest.mark.parametrize("block", [512, 3])
def test_join_components_of_other_shingles(spark, block):
    docs = documents(4, 140)
    got = partenum.join_components(frame(spark, docs), 80, block, shingle=5).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute.join_components(docs, 80, 5)


def test_signatures_lose_no_link():
    rng = np.random.default_rng(3)
    for n in (7, 10, 19, 40, 100, 300):
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            for cut in range(n // 10 + 1):
                b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, rng.integers(0, n // 10 + 1), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= 90 * (len(a) + len(b) - common) and set(a) != set(b):
                    assert set(partenum.signatures_of(np.unique(a)).tolist()) & set(partenum.signatures_of(b).tolist())


def test_signatures_at_80_percent():
    rng = np.random.default_rng(4)
    sig = lambda x: set(partenum.signatures_of(x, 80).tolist())
    for n in (5, 9, 10, 19, 40, 100, 300, 1000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            for cut in range(0, n // 5 + 1, max(1, n // 40)):
                b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**64, rng.integers(0, n // 4 + 1), dtype=np.uint64)]))
                common = len(np.intersect1d(a, b))
                if 100 * common >= 80 * (len(a) + len(b) - common) and set(a) != set(b):
                    assert sig(a) & sig(b)
    # sets that have nothing in common share no signature, however many parts they leave empty
    many = [sig(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))) for n in (400, 401, 402, 403) * 20]
    assert len(set().union(*many)) == sum(map(len, many))


def test_signatures_of_large_sets():
    """A few hundred however large the set, and no similar pair is lost; sets of another kind share none."""
    rng = np.random.default_rng(6)
    for n in (1500, 6000, 100_000):
        for percent in (90, 80):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            sig = partenum.signatures_of(a, percent)
            assert len(sig) <= 2 * 3 * partenum.PARTS
            for _ in range(5):
                gone = partenum.distance(n, percent) // 2
                b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, gone, dtype=np.uint64)]))
                assert set(sig.tolist()) & set(partenum.signatures_of(b, percent).tolist())
            assert not set(sig.tolist()) & set(partenum.signatures_of(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)), percent).tolist())


def test_ids_with_several_tags_are_told_apart():
    kind = Shingles(3, lower=True)
    none = np.zeros(0, np.int64)
    one, tag = kind.ids(b"A b  c", none)
    assert kind.ids(b"a\nb c ", none) == (one, tag) and kind.ids(b" \t", none) == (None, None)
    assert kind.ids(b"a b c", np.array([one]))[0] != one and kind.ids(b"a b d", np.array([one])) == kind.ids(b"a b d", none)


def test_links_are_decided_on_the_sets():
    """Two sets whose hashes all agree, but which have nothing in common."""
    h = np.arange(5, dtype=np.uint64)
    exact = [frozenset("abcde"), frozenset("vwxyz"), frozenset("abcde")]
    assert components._links(np.array([7, 8, 9]), [h, h, h], exact.__getitem__, 90) == [(7, 9)]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (150, 300), (-5, 1000), (7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **dict.fromkeys((100, 150, 200, 300), 100), -5: -5, 1000: -5}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("op", [substring_dedup.dedup, suffix_dedup.dedup, partenum.join_components])
def test_odd_tables(spark, op):
    cols = "doc_id long, text string, _key string, n_removed string, kept string, h string, _c0 int"
    long = "p q r s t u v w x y z a b c d e f g h i j " * 30
    rows = [(1, long, "k", "r", "x", None, 7), (1, long, "k", "r", "x", None, 7), (None, long, None, None, None, None, None), (2, None, "k", "", "", "", 0), (3, "", "", "", "", "", 0)]
    out = op(spark.createDataFrame(rows, cols))
    assert out.count() == len(rows)
    assert {"doc_id", "text", "_key", "h", "_c0"} <= set(out.columns)
    assert sorted(r["_c0"] is None for r in out.collect()) == [False] * 4 + [True]
    assert op(spark.createDataFrame([], cols)).count() == 0


def test_repeated_rows_are_documents(spark):
    t = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(5, t), (5, t), (6, t), (None, t)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.dedup(d).collect()) == [0, 40, 40, 40]
    assert {r.component_id for r in partenum.join_components(d).collect()} == {None}  # the null id comes first
    assert {r.is_first for r in partenum.join_components(d.where("doc_id = 6")).collect()} == {True}
