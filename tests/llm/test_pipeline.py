"""The whole pipeline against plain Python."""

import random
from collections import Counter

import corpus_pipeline as cp
from cellforge.llm import common, mixing
from tests.llm import brute
from tests.llm.corpus import words
from tests.llm.test_prepare import check_packing, exact_ids


def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    passage, rows = words(rng, 60), []
    for i in range(160):
        k = i % 8
        if k == 1 and i > 8:
            t = rows[i - 2][1]
        elif k == 2 and i > 8:
            w = rows[i - 3][1].split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif k == 3:
            t = "\n".join([" ".join(words(rng, 40)), " ".join(passage), " ".join(words(rng, 30))])
        elif k == 4:
            t = rng.choice((None, "", "few words only", "again and again " * 30))
        else:
            t = " ".join(words(rng, rng.choice((25, 200, 900))))
        rows.append((i, t, "en", rng.choice(("s1", "s2", None)), len(t or "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(160)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    alive = {i: (t, s) for i, t, _, s, _ in rows if not brute.base_failed(brute.measures(t))}
    comp = {i: c for i, _, c in brute.join_components([(i, t) for i, (t, _) in alive.items()], 80, 5)}
    alive = {i: v for i, v in alive.items() if comp[i] == i}
    texts = plain_cut({i: t for i, (t, _) in alive.items()})
    copies = brute.mix([(i, s, brute.measures(texts[i])[0]) for i, (_, s) in alive.items()])
    want = Counter()
    for i, n in copies.items():
        for _ in range(int(n)):
            want.update((i, *p) for p in brute.pieces(exact_ids(texts[i])))

    rows_ = cp.run(spark, str(tmp_path)).collect()
    check_packing(rows_, want)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    # the curriculum reaches the sequences: copies stand at their training positions, sequences follow them
    order = mixing.curriculum(mixing.plan(spark.read.parquet(f"{tmp_path}/substring dedup"), common.n_words(common.text_or_empty()))).orderBy("position", "doc_id").collect()
    at = {r["position"]: r["doc_id"] for r in rows_}
    assert sorted(at) == list(range(len(order)))
    place = {}
    for n, r in enumerate(order):
        place.setdefault(r.doc_id, []).append(r.position)
    seen = Counter()
    got = []
    for p in sorted(at):
        got.append(place[at[p]][seen[at[p]]])
        seen[at[p]] += 1
    assert got == sorted(got)
    firsts = {}
    for r in rows_:
        firsts[r["sequence_id"]] = min(firsts.get(r["sequence_id"], 1 << 60), r["position"])
    assert [firsts[k] for k in sorted(firsts)] == sorted(firsts.values()) and sorted(firsts) == list(range(len(firsts)))


def plain_cut(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = brute.WORD.findall(texts[i] or "")
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone.update(range(s, s + window))
            seen.add(g)
        out[i] = " ".join(x for n, x in enumerate(w) if n not in gone) if gone else texts[i]
    return out


def test_near_duplicates_of_five_words_at_80_percent(spark):
    """Two words of a hundred replaced: 5-word Jaccard 86 / 106, 3-word Jaccard 92 / 104."""
    w = [f"w{i}" for i in range(100)]
    near, far = list(w), list(w)
    near[30] = near[60] = "edited"
    for i in (10, 30, 50, 70):
        far[i] = "other"
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.ngram_join(spark, docs, "").collect()) == [1, 3]
