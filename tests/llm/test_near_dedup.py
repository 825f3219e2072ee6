import random
from itertools import combinations

import corpus_pipeline
from frostline.llm import near_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    """Unrelated texts, edited copies of them on both sides of 0.8, and a group of copies that each differ."""
    r = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", " ", "one two", "One  two", "one two three"]
    for edits in [0, 1, 2, 3, 4, 5, 6, 7, 8] * 4:
        base = r.choices(words, k=r.randrange(60, 400))
        copy = list(base)
        for at in r.sample(range(len(copy)), edits):
            copy[at] = "edited"
        out += [" ".join(base), " ".join(copy)]
    base = r.choices(words, k=120)
    for _ in range(60):
        copy = list(base)
        copy[r.randrange(len(copy))] = "changed"
        out.append(" ".join(copy))
    return out


def brute(found, similarity=0.8):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in found]
    root = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_against_brute_force(spark):
    found = texts()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    want = dict(enumerate(brute(found)))
    assert 20 < len(found) - len(set(want.values())) < len(found) - 40
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(want.values()))


def test_parted_band(spark):
    """Nodes that the first links leave apart are paired: a chain whose ends are not similar to each other."""
    # 31 words again and again outvote the ends in a fingerprint, but of the shingles half are of the ends
    often = " ".join([f"w{i}" for i in range(31)] * 20)
    texts = [f"{often} " + " ".join(f"{end}{i}" for i in range(10)) for end in "xyz"] + [" ".join(f"v{i}" for i in range(90)), "a b c d", "a  B c D", "", None]
    assert len(set(brute(texts))) == 6
    ids = list(range(len(texts)))
    rows = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    label = brute([t or "" for t in texts])
    joined = list(range(len(texts)))
    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= 2 or label[i] == label[j]:
                old, new = joined[i], joined[j]
                joined = [new if x == old else x for x in joined]
    first = {}
    for i in ids:
        first[joined[i]] = min(first.get(joined[i], i), i)
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_dedup(rows, simhash=3).collect()}
    assert found == {i: (first[joined[i]], first[joined[i]] == i) for i in ids}
