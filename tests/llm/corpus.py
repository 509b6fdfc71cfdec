"""Small corpora with the awkward cases."""

import random

SYLLABLES = "an ber cho du el fi gra hun ig jo kla lum mé no pra qui ré sto ti ulm vor wen xi yal zu".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def documents(seed=1, n=90):
    """[(id, text)]: originals, exact and near copies, shared passages, repeats inside a text, odd texts."""
    rng = random.Random(seed)
    passage = words(rng, 45)
    second = words(rng, 30)
    docs, base = [], []
    for _ in range(n):
        k = rng.random()
        if base and k < 0.12:
            t = rng.choice(base)
        elif base and k < 0.35:
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(1, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "".join(rng.choices(SYLLABLES, k=3))
            t = " ".join(w)
        else:
            w = words(rng, rng.choice((1, 2, 3, 5, 21, 60, 150, 240)))
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = passage[rng.randint(0, 5) :] if rng.random() < 0.7 else second
            if rng.random() < 0.15:
                w += w[: len(w) // 2]
            t = " ".join(w)
        base.append(t)
        docs.append(t)
    docs += [None, "", " \t\n", "a", "ab " * 400, "x" * 1500, "Ä" * 700, "\n".join(["same line here"] * 30), "tab\tand\x0bvertical\x0cform\rreturn  end "]
    docs += [docs[0], docs[1].upper()]
    ids = list(range(0, 3 * len(docs), 3))
    rng.shuffle(ids)
    return list(zip(ids, docs))
