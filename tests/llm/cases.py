"""Small corpora with the awkward cases, shared by the operator tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, id string, key string, band long"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), "x", "y", "z", 0)


def frame(spark, rows):
    return spark.createDataFrame([r if len(r) > 3 else row(*r) for r in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über", "naïve", "omega", "sigma", "rho", "tau",
                                "kappa", "iota", "zeta", "eta"]) + str(rng.randrange(40)) for _ in range(n))


def corpus(seed=3, n=40):
    """Random documents, exact and near copies, null, empty, blank and long texts, repeated rows."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(3, 160)) + "\n" + sentence(rng, 12) for _ in range(n)]
    out = [(i, t) for i, t in enumerate(base)]
    k = n
    for t in base[:10]:                                   # copies, but for letter case
        out.append((k, t.upper() if k % 2 else t))
        k += 1
    for t in base[10:25]:                                 # near copies: a word changed
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append((k, " ".join(words)))
        k += 1
    out += [(k, None), (k + 1, ""), (k + 2, "   \n\t"), (k + 3, "one two"), (k + 4, "one  two"), (None, base[0]),
            (k + 5, sentence(rng, 6000)), (3, base[3]), (3, base[3])]
    return out


FOLD = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def folded(text):
    return (text or "").translate(FOLD)
