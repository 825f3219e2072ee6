import re
import zlib
from collections import Counter, defaultdict, namedtuple
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frostline.llm import mixing, packing, sharding, tokens
from frostline.llm.queries import ORACLES, QUERIES

from ..compare import assert_same, connection
from .test_dedup import DOCS, ROWS

SF = "/root/testdata/sf0.001"
Mixed = namedtuple("Mixed", "source size source_size target copies")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def words():
    return tokens.WordTokenizer(packing.default_tokenizer())


def library_ids(words, text):
    return np.array(words.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.text(max_size=200) | st.text(alphabet="ab'sStTrevE lLdD 19.,!é À ß|<>\x1c\x85 ́İΣ一", max_size=120))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_tokenizers(text):
    words = tokens.tokenizer(packing.default_tokenizer())
    assert words.ids(text.encode()) == library_ids(words, text)


def test_ids_with_special_tokens_and_a_full_memory(words):
    small = tokens.WordTokenizer(packing.default_tokenizer(), words=2, pieces=2)
    for text in ("a <|endoftext|> b", "<|startoftext|>", "we'll see 12 of Them's, aren't they?" * 3):
        assert words.ids(text.encode()) == small.ids(text.encode()) == library_ids(words, text)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), max_size=40))
@settings(max_examples=200, deadline=None)
def test_plans_hold_every_piece(held):
    counts = np.zeros(65, np.int64)
    for length, n in held.items():
        counts[length] = n
    total = Counter()
    for times, items in packing.plan_sequences(counts):
        assert sum(items) <= 64 and times > 0
        for x in items:
            total[x] += times
    assert total == {k: v for k, v in held.items() if v}


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=40))
@settings(max_examples=150, deadline=None)
def test_plans_are_never_worse_than_best_fit(held):
    counts = np.zeros(41, np.int64)
    for length, n in held.items():
        counts[length] = n
    assert packing.n_sequences(packing.plan_sequences(counts)) <= packing.n_sequences(packing._best_fit(counts))


@given(st.lists(st.integers(0, 3), min_size=24, max_size=24), st.lists(st.integers(1, 23), max_size=12))
@settings(max_examples=150, deadline=None)
def test_index_of_sums(held, taken):
    """The index tells the pairs that are left, and finds a single, pair or triple wherever there is one."""
    index = packing.SumIndex(np.array([0, *held[1:]]))
    for x in taken:
        if index.left[x]:
            index.take(x, int(min(index.left[x], 2)))
    left = {x: int(n) for x, n in enumerate(index.left) if n}
    bag = [x for x, n in left.items() for _ in range(n)]
    for gap in range(1, 24):
        pairs = {(a, gap - a) for a in left if a <= gap - a and left.get(gap - a, 0) > (a == gap - a)}
        assert index.pairs[gap] == len(pairs)
        some = index.complement(gap, Counter())
        exists = gap in left or bool(pairs) or any(a + b + c == gap for a, b, c in combinations(bag, 3))
        assert bool(some) == exists
        if some:
            assert sum(some) == gap and all(left.get(x, 0) >= n for x, n in Counter(some).items())


def test_parts_of_one_length(spark, words, monkeypatch):
    monkeypatch.setattr(packing, "PART", 3)
    texts = [(i % 7, "the same text" if i % 3 else f"text {i}") for i in range(60)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_packing(rows, texts, words)


def test_plan_fills_exactly():
    counts = np.zeros(2049, np.int64)
    counts[[2000, 48, 1500, 300, 248, 700, 648]] = [5, 5, 4, 4, 4, 3, 3]
    counts[700] += 0
    plan = packing.plan_sequences(counts)
    full = sum(t for t, items in plan if sum(items) == 2048)
    assert full >= 9
    lengths = np.random.default_rng(0).integers(1, 2049, 20000)
    plan = packing.plan_sequences(np.bincount(lengths, minlength=2049))
    assert sum(t for t, _ in plan) <= 1.02 * lengths.sum() / 2048


def check_packing(rows, texts, words, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    want = Counter()
    for i, text in texts:
        ids = words.ids((text or "").encode()) + bytes(4)
        for piece, start in enumerate(range(0, len(ids), 4 * size)):
            part = ids[start : start + 4 * size]
            want[(i, piece, start // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_sequence)


def test_packing_query(spark, words):
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_packing(rows, texts, words)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_cases(docs, words):
    check_packing(packing.pack(docs).collect(), [(r[0], r[1]) for r in ROWS], words)
    assert packing.pack(docs.limit(0)).count() == 0


def check_shards(rows, texts):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[s]) for s in range(24)]


def test_sharding_query(spark):
    rows = QUERIES["op2_vector_sharding"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    loads = check_shards(rows, texts)
    assert max(loads) <= 1.1 * np.mean(loads)


def balance(rows, texts):
    """The largest shard over the mean, of bytes, tokens and rows."""
    size = {i: (len((t or "").encode()) + 8, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), 1) for i, t in texts}
    sums = np.zeros((24, 3))
    for r in rows:
        sums[r.shard] += size[r.doc_id]
    return sums.max(axis=0) / sums.mean(axis=0)


def test_shards_balance_bytes_tokens_and_rows(spark, monkeypatch):
    """Also with many small blocks that are merged over three levels."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(["word"] * int(rng.integers(1, 60))) + " x" * int(rng.integers(0, 90)) + str(i)) for i in range(6000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert (balance(sharding.shard(df).collect(), texts) <= 1.02).all()
    monkeypatch.setattr(sharding, "GROUPS_PER_BLOCK", 250)
    monkeypatch.setattr(sharding, "FAN", 3)
    rows = sharding.shard(df).collect()
    check_shards(rows, texts)
    assert (balance(rows, texts) <= 1.03).all()


def test_sharding_cases(spark, docs):
    check_shards(sharding.shard(docs).collect(), [(r[0], r[1]) for r in ROWS])
    assert sharding.shard(docs.limit(0)).count() == 0
    hot = [(i, "the same text") for i in range(600)] + [(1000 + i, f"text {i} " * (i % 40)) for i in range(900)]
    rows = sharding.shard(spark.createDataFrame(hot, "doc_id long, text string")).collect()
    loads = check_shards(rows, hot)
    assert max(loads) <= 1.05 * np.mean(loads)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) == 1  # only the hot group is split


def test_blocks_balance_together():
    rng = np.random.default_rng(1)
    load, share = np.zeros((24, 3)), np.array([50 * 24 * 100.0] * 3)
    for _ in range(50):
        put = sharding.place(rng.uniform(50, 150, (24, 3)), 24, once=True, load=load, share=share / 24)
        assert sorted(put.tolist()) == list(range(24))
    assert load[:, 0].max() / load[:, 0].mean() < 1.02


def test_mix_query_equals_its_sql(spark):
    assert_same(QUERIES["op9_source_mix"](spark, SF).toPandas(), connection(SF).sql(ORACLES["op9_source_mix"]).df())


def slow_targets(sizes):
    """The limits by repetition: give out the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if s in over else unit * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_cases(spark, docs):
    rows = [(i, "w " * (i % 50), ["b", "a", None, "é", "z"][i % 5 if i % 3 else 0], "x") for i in range(900)] + [(5, None, "a", "x"), (None, "p q", None, "x"), (5, None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    flat = lambda out: [Mixed(r["_doc"].source, r["_size"], r["_source_size"], r["_target"], r["_copies"]) for r in out.collect()]
    got = flat(mixing.mix_sources(df))
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, flat(mixing.mix_sources(df.repartition(3)))))
    size = Counter()
    for _, text, source, _ in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target, taken = slow_targets(dict(size)), Counter()
    for r in got:
        assert 0 <= r.copies <= 2 and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.copies * r.size
    for s in size:
        assert 0 <= target[s] - taken[s] < 1 + 1e-6  # there are documents of one word
    assert mixing.mix_sources(df.limit(0)).count() == 0
    named = df.withColumnsRenamed({"size": "_size"}).withColumns({"_file": F.lit("f"), "_row": F.lit(7), "_doc": F.lit("d")})
    out = mixing.mix_sources(named)
    assert out.columns == ["_doc", "_size", "_source_size", "_target", "_copies"]
    assert {(r["_doc"]["_file"], r["_doc"]["_row"], r["_doc"]["_doc"], r["_doc"]["_size"]) for r in out.collect()} == {("f", 7, "d", "x")}
    mixing.mix_sources(docs).collect()


@pytest.mark.parametrize("same", [[(7, "one two three", "hot")] * 400, [(None, "one two three", "hot")] * 400])
def test_repeated_rows_are_split(spark, same):
    """One row, or a null id, many times over: as many rows are taken as the target holds."""
    rows = [*same, *[(i, f"w{i} x", "b") for i in range(200)], *[(i, "a b c d e", "c") for i in range(90)]]
    got = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r["size"] * r.copies
        target[r.source_size] = r.target
    assert {k: target[k] - v < 5 and v <= target[k] + 1e-6 for k, v in taken.items()} == dict.fromkeys(taken, True)


def test_mix_code_is_compiled(spark, capfd):
    """No expression is so large that its code isn't compiled, and no Python runs."""
    out = mixing.mix_sizes(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    spark.sparkContext.setLogLevel("WARN")
    try:
        out.collect()
        mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    finally:
        spark.sparkContext.setLogLevel("ERROR")
    assert "grows beyond 64 KB" not in capfd.readouterr().err
