import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frostline.llm import byte_bpe
from frostline.llm.queries import QUERIES

from .test_dedup import DOCS, ROWS, SF

LIBRARY = Tokenizer.from_file(byte_bpe.default_tokenizer())
MINE = byte_bpe.byte_bpe(byte_bpe.default_tokenizer())
TABLE = byte_bpe.offset_table(byte_bpe.default_tokenizer())
ODD = ["ab", "aA- '\n\t", "e t.,!é", "0123a ", "—’“中文字😀 \x85\x1c\u01c5\u0107\u00a0\u2003", "thein ", "=-_*", "'s're'LL "]


def theirs(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def mine(text):
    return np.frombuffer(MINE.encode(text), "<i4").tolist()


@given(st.one_of(st.text(max_size=80), st.sampled_from(ODD).flatmap(lambda a: st.text(a, max_size=120))))
@settings(max_examples=600, deadline=None)
def test_encoding_is_the_librarys(text):
    assert mine(text) == theirs(text)
    assert TABLE.decode(np.array(mine(text))).decode() == text


def test_every_token_can_stand_alone():
    assert all(MINE.merged(TABLE.blob[TABLE.starts[t] : TABLE.starts[t + 1]].tobytes()) == [t] for t in MINE.length)


def test_pair_table_against_merging():
    rng = np.random.default_rng(1)
    tokens = list(MINE.length)
    model = LIBRARY.model
    shown = {t: LIBRARY.id_to_token(t) for t in tokens}
    for a, b in rng.choice(tokens, (4000, 2)).tolist():
        assert MINE.table.fits(a, b) == ([t.id for t in model.tokenize(shown[a] + shown[b])] == [a, b])


@pytest.mark.parametrize("text", ["a" * 300_000, "-" * 200_000, "thein" * 50_000, " " * 300_000 + "x", "word 12, " * 200_000])
def test_long_texts_take_linear_time(text):
    assert mine(text) == theirs(text)


def test_special_tokens_inside_texts():
    for text in ("a<|endoftext|>b", "<|endoftext|><|endoftext|> ", " <|endoftext|", "x <|endoftext|>  y"):
        assert mine(text) == theirs(text) and TABLE.decode(np.array(mine(text))).decode() == text


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        byte_bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_untrained_merges_are_refused():
    with pytest.raises(ValueError, match="later"):
        byte_bpe.PairTable({(300, 1): (0, 301), (2, 3): (1, 300)})


def test_rows_of_all_kinds(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = byte_bpe.round_trip(docs).collect()
    key = lambda r: tuple(map(str, r))
    want = []
    for t in ROWS:
        ids = theirs(t[1] or "")
        want.append((t[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t[1] or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_decoding_odd_ids(spark):
    ids = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [31373, None, -4, 99999999, 995], "x"), (4, [50256, 220], "x")], "doc_id long, ids array<int>, decoded string")
    assert [r.decoded for r in byte_bpe.decode(ids).orderBy("doc_id").collect()] == [None, "", "hello world", "<|endoftext|> "]


def test_query_gives_back_every_text(spark):
    rows = QUERIES["op11_byte_bpe"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("want"))
    assert rows.join(texts, "doc_id").where("want = decoded_sha256").count() == docs.count()
    want = {d.doc_id: theirs(d.text or "") for d in docs.select("doc_id", "text").collect()}
    for r in rows.collect():
        assert r.n_tokens == len(want[r.doc_id]) and r.ids_sha256 == hashlib.sha256(",".join(map(str, want[r.doc_id])).encode()).hexdigest()
