import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import common, embed_dedup, exact_dedup, simhash
from frostline.llm.queries import ORACLES, QUERIES

from ..compare import assert_same, connection

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, keep_id string, _id int"
LONG = "".join(f"word{i % 977} " for i in range(40000))
#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own.
ROWS = [
    (1, "a b c d", "en", "s", "x", 1), (2, "a  b\tc d ", "en", "s", "x", 2), (2, "a  b\tc d ", "en", "s", "x", 2), (None, None, None, None, None, None), (5, "", None, None, "", 0), (6, " \n\x0b", "de", "s", None, 3),
    (7, LONG, "en", "s", "x", 1), (8, LONG + " ", "en", "s", "x", 1), (9, LONG + "!", "en", "s", "x", 1), (None, "only", "en", "s", "x", 1), (11, "é x y z", "fr", "s", "x", 1), (10, "é x y z", "fr", "s", "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("name", ["op10_exact_dedup", "op7_embedding_dedup"])
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF).toPandas(), connection(SF).sql(ORACLES[name]).df())


def test_exact_dedup_cases(docs):
    rows = exact_dedup.exact_dedup(docs, carry=("source",)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        mine = [t for t in ROWS if hashlib.sha256(norm(t[1]).encode()).hexdigest() == r.text_sha256]
        best = min(mine, key=lambda t: (-len(t[1] or ""), t[0] is None, t[0] or 0))
        assert r.group_size == len(mine) and r.keep_id == best[0]
    groups = {r.text_sha256: sum(x.kept for x in rows if x.text_sha256 == r.text_sha256) for r in rows}
    assert set(groups.values()) == {1}  # of repeated rows one stays


def test_exact_dedup_of_nothing(docs):
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


@given(st.binary(max_size=30000), st.binary(max_size=40))
@settings(max_examples=60, deadline=None)
def test_chunks_cover_the_text_and_find_their_place_again(data, before):
    ends = exact_dedup.chunk_ends(data)
    assert (ends[-1] if ends else 0) == len(data) and all(0 < b - a <= exact_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))
    assert all(b - a >= exact_dedup.LEAST for a, b in zip([0, *ends[:-1]], ends[:-1], strict=False))


def test_an_insertion_changes_few_chunks():
    data = np.random.default_rng(1).integers(97, 123, 200_000, dtype=np.uint8).tobytes()

    def chunks(x):
        ends = exact_dedup.chunk_ends(x)
        return {x[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    assert len(chunks(data) - chunks(b"new" + data)) < 5


def test_identifiers_that_clash_are_not_trusted(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "recipe_of", lambda data: (b"8 bytes.", hashlib.sha256(data).digest()[: exact_dedup.WIDE]))
    assert not exact_dedup.chunk_catalogue(docs.sparkSession.createDataFrame([(b"8 bytes.", bytes(28)), (b"8 bytes.", bytes(27) + b"x")], "recipe binary, wide binary")).first().verified


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    label = list(range(len(values)))
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed = changed or label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def test_simhash_cases(docs):
    rows = simhash.simhash_dedup(docs).collect()
    assert sorted(r.fingerprint for r in rows) == sorted(f"{slow_fingerprint(t[1]):016x}" for t in ROWS)
    label = brute_components([int(r.fingerprint, 16) for r in rows])
    for i, r in enumerate(rows):
        ids = [x.doc_id for k, x in enumerate(rows) if label[k] == label[i] and x.doc_id is not None]
        assert r.component_id == min(ids, default=None)
        assert sum(x.kept for k, x in enumerate(rows) if label[k] == label[i]) == 1
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_simhash_query_against_brute_force(spark):
    rows = QUERIES["op6_simhash_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.fingerprint == f"{slow_fingerprint(texts[r.doc_id]):016x}" for r in rows)
    rows.sort(key=lambda r: r.doc_id)
    label = brute_components([int(r.fingerprint, 16) for r in rows])
    assert [r.component_id for r in rows] == [rows[k].doc_id for k in label]


def test_links_are_all_found_once(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(8):
            y = x
            for bit in rng.choice(63, rng.integers(1, 4), replace=False).tolist():
                y ^= 1 << bit
            fps.add(y)
    fps |= {0, -1, 1, 1 << 62}
    got = [tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    want = {tuple(sorted((a, b))) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(10, 60)] + [tuple(e) for e in rng.integers(1000, 1100, (60, 2)).tolist()]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def brute_vectors(rows):
    def ok(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.sqrt((a @ a) * (b @ b))

    n = len(rows)
    link = [[i != j and bool(ok(rows[i][1]) and ok(rows[j][1])) and len(rows[i][1]) == len(rows[j][1]) and cos(rows[i][1], rows[j][1]) >= 0.9 for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    label[i] = label[j] = min(label[i], label[j])
    return {rows[i][0]: (sum(link[i]), rows[label[i]][0]) for i in range(n)}


def test_embedding_cases(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + rng.normal(size=24) * rng.choice([0, 0.05, 0.3, 0.5])).tolist()) for i in range(90)]
    rows += [(i, [float(x) for x in rows[0][1]]) for i in (90, 91)] + [(92, [x * 3 for x in rows[0][1]]), (93, None), (94, []), (95, [0.0] * 24), (96, [float("nan")] + [1.0] * 23), (97, [None] + [1.0] * 23), (98, [1.0, 2.0]), (99, [1.0, 2.1]), (100, [float("inf")] * 24), (101, [1.0]), (102, [-2.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, kept string")
    want = brute_vectors(rows)
    for tile in (1 << 23, 7 * 4 * 24):  # the second: crowded cells
        monkeypatch.setattr(embed_dedup, "TILE_BYTES", tile)
        got = embed_dedup.near_vectors(df).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [24, 40])
def test_embeddings_on_a_grid(spark, dim):
    """Vectors near a circle or a sphere: their leading axes spread further than the radius, so that there are many
    cells, guests from neighbouring ones, and blocks without a grid beside them."""
    rng = np.random.default_rng(dim)
    around = np.zeros((400, dim))
    around[:, : dim // 12] = rng.normal(size=(400, dim // 12))
    around /= np.linalg.norm(around, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(around + rng.normal(size=around.shape) * 0.25 / np.sqrt(dim))]
    seen = []
    rotation = embed_dedup.Rotation(0.2)
    rotation.fit(np.array([v for _, v in rows], np.float32))
    axes, blocks = rotation.of(dim)
    y = embed_dedup.unit(np.array([v for _, v in rows], np.float32)) @ axes
    for block in blocks:
        seen.append(len(np.unique(block.cells(y)[0], axis=0)))
        assert len(block.columns) <= embed_dedup.BLOCK_DIMS
    assert max(seen) > 4
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows)
