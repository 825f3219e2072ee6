import json
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import html_main, langid, licenses, quality
from frostline.llm.queries import QUERIES

from .test_dedup import DOCS, ROWS

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


# Quality.


def slow_score(net, data):
    """The network window by window, chunks from the definition."""
    n = max(1, -(-(len(data) - quality.WIDTH + 1) // quality.STEP))
    x = data + bytes(n * quality.STEP + quality.WIDTH - 1 - len(data))
    echo = [any(i >= lag + quality.ECHO - 1 and data[i + 1 - quality.ECHO : i + 1] == data[i + 1 - quality.ECHO - lag : i + 1 - lag] for lag in quality.LAGS) for i in range(len(data))]
    echo += [False] * (len(x) - len(data))

    def response(at):
        return sum(net.table[j, x[at + j]].astype(float) for j in range(quality.WIDTH)) + echo[at + quality.WIDTH - 1] * net.echo

    pools = np.array([np.max([response(c * quality.STEP + t) for t in range(quality.STEP)], axis=0) for c in range(n)])
    active = np.maximum(pools + net.bias, 0)
    z = np.concatenate([active.mean(axis=0), active.max(axis=0)]) @ net.weights + net.offset
    return 1 / (1 + np.exp(-z))


def test_network_sees_every_window_once():
    net = quality.train([b"good text here. " * 9, b"BAD!! BAD!! " * 9] * 4, np.array([1.0, 0.0] * 4), steps=5)
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 6, 511, 512, 517, 518, 1300):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        data = data[: n // 2] + (b"echo! " * n)[: n - n // 2]
        assert net.score(data) == pytest.approx(slow_score(net, data), abs=1e-4)
        batch = quality.Batch(net, [quality._chunked(net, b"other"), quality._chunked(net, data)])
        assert np.allclose(batch.pools[1:], net.pools(data), atol=1e-4) and batch.places.shape == batch.pools.shape


def test_gradients_are_those_of_differences():
    """Every kind of parameter of a batch's mean log loss, against the network window by window."""
    rng = np.random.default_rng(4)
    net = quality.train([b"good text here. " * 9, b"BAD!! BAD!! " * 9] * 4, np.array([1.0, 0.0] * 4), steps=3)
    for name in ("table", "echo", "bias", "weights"):
        setattr(net, name, (getattr(net, name) + rng.normal(0, 0.2, getattr(net, name).shape)).astype(np.float64))
    texts = [b"some good text, not very long", b"echo! " * 30, rng.integers(97, 123, 700, dtype=np.uint8).tobytes(), b""]
    labels = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = np.array([slow_score(net, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    table, bias, weights, offset, echo = quality.Batch(net, [quality._chunked(net, t) for t in texts]).gradients(labels)
    step = 1e-5
    for name, found in (("table", table), ("bias", bias), ("weights", weights), ("echo", echo)):
        values = getattr(net, name)
        places = list(zip(*np.nonzero(found), strict=True))
        for at in [places[i] for i in rng.choice(len(places), min(6, len(places)), replace=False)]:
            kept, sides = values[at], []
            for sign in (1, -1):
                values[at] = kept + sign * step
                sides.append(loss())
            values[at] = kept
            assert found[at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=2e-3, abs=1e-6), (name, at)
    net.offset += step
    high = loss()
    net.offset -= 2 * step
    assert offset[0] == pytest.approx((high - loss()) / (2 * step), rel=2e-3)


def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op3_conv_quality"](spark, LARGE).toPandas()
    truth = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all() and len(rows) == 1000
    held = rows[rows["held_out"]].merge(truth, on="doc_id")
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    assert (held[held["quality"] == 1]["predicted"] == 1).mean() >= 0.98
    mean = held.groupby("quality")["score"].mean()
    assert mean[1] > mean[0] + 0.5


def test_quality_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1), (7, 1), (7, 0)], "doc_id long, quality int")
    for labels in (none, odd):
        rows = quality.classify(docs, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), odd).count() == 0


# Languages.


def test_language_on_held_out_rows(spark):
    rows = QUERIES["op5_language_id"](spark, LARGE).toPandas().merge(spark.read.parquet(f"{LARGE}/documents.parquet").toPandas(), on="doc_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows.itertuples())
    held = rows[rows["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.98
    assert (held[~held["rejected"]]["lang_pred"] == held[~held["rejected"]]["lang"]).mean() >= 0.99


def test_language_cases(spark, docs):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? \n", "en"), (4, "x", None), (5, "é", "fr"), (None, "und so weiter", "de"), (7, "a b " * 60000, "en"), (8, "一二", "zh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and all(got[i].lang_pred != "und" for i in (4, 5, 7, 8, None))
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert langid.identify(docs).count() == len(ROWS)


def test_every_language_is_learned(spark, monkeypatch):
    long = "".join(f"wort{i % 89} und " for i in range(8000))
    rows = [(i, f"the text number {i} of many", "en") for i in range(300)] + [(1000 + i, f"{long} {i}", "de") for i in range(8)] + [(2000, "tres tristes tigres", "es"), (2001, "otra frase más", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learn(df).languages) == {"en", "de", "es"}
    assert set(langid.learn(df, most=2).languages) == {"en", "de", "es"}  # less than one row of each is wanted
    one = df.select(langid._stretch(langid.F.col("text")).alias("t"), "text").collect()
    assert all(len(r.t.encode()) <= langid.MOST_BYTES and r.t in r.text and (r.t == r.text) == (len(r.text) <= langid.MOST_BYTES) for r in one)


def slow_language(model, text):
    """The forward pass from the definition: every subword by itself."""
    low = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in text]
    total, n = np.zeros(langid.DIM), 0
    for size in langid.SIZES:
        for i in range(len(low) - size + 1):
            h = low[i]
            for b in low[i + 1 : i + size]:
                h = (h * 0x01000193 ^ b) & 0xFFFFFFFF
            total += model.embeddings[((h * 0x9E3779B1) & 0xFFFFFFFF) >> 18]
            n += 1
    z = model.weights @ (total / max(n, 1)) + model.bias
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.languages[int(p.argmax())], float(p.max())


def test_languages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    texts = {r.doc_id: r.text for r in docs.where("n_chars < 1500").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    assert len(texts) > 50
    for i, text in texts.items():
        name, score = slow_language(model, text.encode())
        assert got[i].lang_pred == name and got[i].score == pytest.approx(score, abs=1e-5)


def test_language_shares_broadcast_or_in_parts(spark, monkeypatch):
    hashed = spark.range(5000).selectExpr("if(id % 10 = 0, 'rare', 'hot') AS _lang", "pmod(xxhash64(id), 1000) AS _place")
    shares = spark.createDataFrame([("hot", 100), ("rare", 700)], "_of string, _share long")
    want = sorted((r._lang, r._place) for r in hashed.collect() if r._place < {"hot": 100, "rare": 700}[r._lang])
    for most in (langid.MOST_BROADCAST, 0):
        monkeypatch.setattr(langid, "MOST_BROADCAST", most)
        assert sorted((r._lang, r._place) for r in langid._below_share(hashed, shares).collect()) == want
    assert langid._below_share(hashed, shares.limit(0)).count() == 0


def test_no_language_is_left_out(spark):
    rows = [(None if i % 2 else i, f"{name} text of {name} number {i}", name) for i in range(40) for name in ("aa", "bb", "cc", "dd")]
    df = spark.createDataFrame([*rows, *rows[:50]], "doc_id long, text string, lang string")
    assert langid.learn(df, sample=20, most=40).languages == ["aa", "bb", "cc", "dd"]
    a, b = (langid.learn(x, sample=20) for x in (df, df.repartition(3)))
    assert np.array_equal(a.embeddings, b.embeddings) and np.array_equal(a.weights, b.weights)
    labels = spark.createDataFrame([(i, i % 4 // 2) for i in range(0, 40, 2)], "doc_id long, quality int")
    a, b = (quality.learn(x, labels, sample=8) for x in (df, df.repartition(3)))
    assert np.array_equal(a.table, b.table)


@given(st.binary(min_size=0, max_size=300))
@settings(max_examples=50, deadline=None)
def test_parts_of_a_text_make_its_average(data):
    model = langid.train([b"the cat sat", b"le chat noir"] * 3, ["en", "fr"] * 3)
    whole = model.probabilities(data)
    part, langid.PART = langid.PART, 50
    try:
        assert np.allclose(whole, model.probabilities(data), atol=1e-6)
    finally:
        langid.PART = part


# Licences.


def slow_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        want = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), hits


def agrees(row, text):
    n, hits = slow_base(text)
    starts = [i for i, _ in hits]
    labels = {x for _, x in hits}
    more = {x for _, _, x, _ in json.loads(row.spans)}
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n, len(hits), min(starts, default=None), max(starts, default=None))
    assert row.base_labels == ",".join(sorted(labels)) and row.labels == ",".join(sorted(labels | more)) and 0 <= row.score <= 1
    return True


def test_licence_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGE}/documents.parquet").collect()}
    rows = QUERIES["op8_license_scan"](spark, LARGE).collect()
    assert len(rows) == len(texts) and all(agrees(r, texts[r.doc_id]) for r in rows) and any("mit" in r.labels for r in rows)


def test_long_texts_take_linear_time():
    began = time.time()
    words = licenses.normal(b"all rights reserved, cc by! " * 370_000)  # 10 MB
    places = licenses.base_places(words, licenses.BASE)
    assert len(places) == 740_000 and places[0][0] == 3 and max(n for n, _ in places) == 5 * 369_999 + 3
    assert time.time() - began < 30
    for html in ("<div>" * 200_000 + "deep", "<b><div>" + "<span>x" * 50_000 + "</b>" * 50_000, "<div>" * 50_000 + "<td>x</td>" * 50_000, "<div>some text, here " * 50_000):
        began = time.time()
        assert html_main.main_text(html)
        assert time.time() - began < 60


def least_edits(words, notice):
    """The fewest edits that make a notice of whole words of a text, names in braces as they are: every word is a begin, and
    each name is where its words stand; what is between is measured to every end."""
    parts = re.split("[{}]", notice)
    most, best = licenses.edits_for(notice), 99
    text = " ".join(words)
    begins = {0, *(i + 1 for i, c in enumerate(text) if c == " ")}
    ends = {len(text), *(i for i, c in enumerate(text) if c == " ")}

    def go(at, i, spent):
        nonlocal best
        if spent > most or spent >= best:
            return
        if i == len(parts):
            if at in ends:
                best = spent
            return
        part = parts[i]
        if not part:
            go(at, i + 1, spent)
        elif i % 2:
            if at in begins and text.startswith(part, at) and at + len(part) in ends:
                go(at + len(part), i + 1, spent)
        else:
            for stop in range(max(at, at + len(part) - most), min(len(text), at + len(part) + most) + 1):
                go(stop, i + 1, spent + distance(text[at:stop], part))

    for begin in sorted(begins):
        near = text[begin : begin + len(notice) + 8]
        letters = sum(max(0, licenses.plain(notice).count(c) - near.count(c)) for c in set(licenses.plain(notice)))
        if letters <= most:
            go(begin, 0, 0)
    return best


SOME = ["licensed under the {mit} license", "released under a {bsd} license", "spdx license identifier {gpl 3 0}", "all rights reserved", "licensed under the {apache} license {version 2 0}", "{gnu general public} license {version 3}", "licensed under {cc by nc}"]


def test_fuzzy_labels_against_brute_force():
    """Notices with edits on both sides of what is allowed, in names too: found just where brute force finds them."""
    rng = np.random.default_rng(8)
    hits = 0
    for notice in SOME:
        search, k = licenses.NoticeSearch({notice: "x"}), licenses.edits_for(notice)
        for edits in [*range(k + 3), 1, 1, k, k]:
            letters = list(licenses.plain(notice))
            for _ in range(edits):
                at = int(rng.integers(0, len(letters)))
                kind = rng.integers(4)
                letters[at : at + (kind not in (0, 3))] = ["q"] if kind in (0, 2) else [" "] if kind == 3 else []
            text = licenses.normal(f"some words {''.join(letters)} and more".encode()).decode()
            want, found = least_edits(text.split(" "), notice), search.spans(text)
            assert (want <= k) == bool(found), (notice, text, want, found)
            hits += bool(found)
            for a, b, _, e in found:
                assert (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " ") and want <= e <= k
    assert hits > 20


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("small rights reserved", ""), ("overall rights reserved", ""), ("licensed under the nist license", ""), ("licensed under the ms license", ""), ("Released under a MIT licence.", "mit"), ("all rights are reserved", "reserved"),
        ("SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: GPL-3.0-or-later", "gpl"), ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache,apache-2.0"), ("Licensed under the Apache Licence, Version 1.1", "apache"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("licensed under the GNU Lesser General Public License", "gpl,lgpl"), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"), ("distributed under the Boost Software License, Version 1.0", "boost"), ("licensed under the emit license", ""),
        ("licensed under the summit license", ""), ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl"), ("made available under the terms of the Eclipse Public License v2.0", "epl"), ("licensed under the permit license", ""),
    ],
)
def test_labels_of_notices(spark, text, labels):
    (row,) = licenses.scan(spark.createDataFrame([(1, f"Words before. {text} Words after.")], "doc_id long, text string")).collect()
    assert row.labels == labels


def test_copies_beside_each_other_are_all_found():
    search = licenses.NoticeSearch({"licensed under the apache license": "apache"})
    exact, edited = "licensed under the apache license", "licensed undr the apache license"
    assert [(a, b, e) for a, b, _, e in search.spans(f"{edited} {exact} {exact} {edited}")] == [(0, 32, 1), (33, 66, 0), (67, 100, 0), (101, 133, 1)]
    text = "Licensed -- under\tthe ApachE license 2.0 & more"
    (span,) = search.spans(licenses.normal(text.encode()).decode())
    assert text[slice(*licenses.document_spans(text, licenses.normal(text.encode()).decode(), [span])[0][:2])] == "Licensed -- under\tthe ApachE license"


def test_licence_cases(spark, docs):
    for r in licenses.scan(docs).collect():
        assert r.n_base == 0 and r.labels == "" and r.score == 0
    texts = ["CC BY cc-by", "accc by", "cc by" * 2, "All rights reserved; all RIGHTS\x7freserved", "general public licensé", "KKcc by", "x GENERAL\n\npublic_license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(agrees(r, texts[r.doc_id]) for r in licenses.scan(df).collect())
    assert licenses.scan(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_notices_with_edits_are_found():
    search, rng = licenses.NoticeSearch(licenses.NOTICES), np.random.default_rng(6)
    for notice, label in licenses.NOTICES.items():
        k = licenses.edits_for(notice)
        for _ in range(3):
            parts = re.split("([{}])", notice)
            letters, free = [], []  # where edits may be: not in names, and not at a border of words
            inside = False
            for part in parts:
                if part in ("{", "}"):
                    inside = part == "{"
                    continue
                free += [not inside and 0 < i < len(part) - 1 and part[i] != " " and part[i - 1 : i + 2 : 2] != "  " for i in range(len(part))]
                letters += list(part)
            for at in sorted(rng.choice(np.flatnonzero(free), min(k, sum(free)), replace=False).tolist(), reverse=True) if any(free) else []:
                kind = rng.integers(3)
                letters[at : at + (kind != 0)] = ["q"] if kind != 1 else []
            text = licenses.normal(("some words before " + "".join(letters) + " and after").encode()).decode()
            assert any(x[2] == label for x in search.spans(text)), (notice, text)
    text = "xx relased under the mit licence yy"
    (span,) = [s for s in search.spans(text) if s[2] == "mit"]
    assert span[3] == 2 and text[span[0] : span[1]] == "relased under the mit licence"
    assert search.spans("nothing of the kind is written here") == []


# Pages.

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><a href="/">Home, home</a></header><nav><ul><li>Menu, menu, menu</ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, and more text to be long enough for a paragraph.</p></div>
<main><article class="post"><header><h1>The  title</h1></header><script>var t = "<p>script</p>";</script><p>First &amp; <b>bo</b>ld,&nbsp;text that is long enough, with commas.<br>Next line<p>Second&#x21; paragraph <!-- hidden, text -->of the article, which goes on for a while, and ends.
<form><p>Your mail, please, so that we can write to you again and again.</p></form><div class="ad">Buy, buy, buy now and save a lot of money today, friends.</div>
<ul><li>item one<li>item two</ul></article><section id="comments"><p>I agree, this is a great text, said a reader, and wrote on and on.</p></section></main>
<aside><p>Side, bar, text, that would be long enough to be counted as well, really.</p></aside><footer><p>Foot, note, and so on, long enough to count as a paragraph too.</p></footer></body></html>"""


def test_main_text_of_a_page():
    assert html_main.main_text(PAGE) == "The title First & bold, text that is long enough, with commas. Next line Second! paragraph of the article, which goes on for a while, and ends. item one item two"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>a<p>b", "a b"), ("<div>x<div>y</div>z</div>", "x y z"), ("<p>a<i>b</i>c</p>", "abc"), ("<script>x", ""),
        ("<p title='a>b'>c", "c"), ('<p title="unclosed>c</p>d', "c d"), ("<article><p>short</p></article>", "short"), ("</p></div>text", "text"), ("<p>1 < 2 &amp 3</p>", "1 < 2 & 3"), ("<![CDATA[x &amp; y]]>", "x &amp; y"),
    ],
)
def test_odd_pages(html, text):
    assert html_main.main_text(html) == text


def test_deep_and_long_pages():
    assert html_main.main_text("<div>" * 20000 + "deep") == "deep"
    assert len(html_main.main_text("<p>word, " * 50000)) == 6 * 50000 - 1


MB = 1 << 20


@pytest.mark.parametrize(
    "html",
    ["<a" * (MB // 2), "a<b" * (MB // 3), "<p>text</p>" + "<a" + "x" * MB, "<a>\">" * (MB // 5), '<a ">"' * (MB // 6), "<a '" * (MB // 4), "<!--" * (MB // 4), "<![CDATA[" * (MB // 9), "&#" + "9" * MB + ";", "&#" + "0" * MB + "65;",
     "<div class=" * (MB // 11), "<p " + "class " * (MB // 6) + ">", "</p>" * (MB // 4), "<li><ul>" * (MB // 8), "<script>" * (MB // 8), "<" * MB, "&" * MB, " " * MB, "plain words " * (MB // 12)],
    ids=range(19),
)
def test_pages_of_any_kind_take_linear_time(html):
    began = time.process_time()
    html_main.main_text(html)
    assert time.process_time() - began < 30


def test_numbers_of_characters():
    assert html_main.main_text("<p>&#000000000000065;&#x42;&#67 &#99999999999;&#128512;</p>") == "ABC \ufffd\U0001f600"


SENTENCE = "A sentence of the article, long enough to count. "
GONE = "ad-slot ad-unit advert-card promo-card gdpr-layer comment-thread user-comments replies-thread discussion responses user-reviews cookie-law sponsored-story commentSection js-comments-v2".split()


@pytest.mark.parametrize("name", GONE)
def test_adverts_and_comments_go(name):
    article = f"<h1>Title</h1><p>{SENTENCE * 4}</p><p>{SENTENCE}</p>"
    want = " ".join(f"Title {SENTENCE * 4} {SENTENCE}".split())
    other = f'<div class="{name}"><p>{"Something else, said by somebody else, of some length. " * 3}</p></div>'
    thread = f'<div id="{name}"><ul>{"".join(f"<li><p>Reader {i} wrote, at some length, what came to mind, and more.</p></li>" for i in range(40))}</ul></div>'
    for html in (f"{article}{other}", f"{article}{thread}", f"{other}{article}", f"<h1>Title</h1><p>{SENTENCE * 4}</p>{other}<p>{SENTENCE}</p>"):
        for around in ("<main>{}</main>", "<main><article>{}</article></main>", "<article>{}</article>", "<div>{}</div>"):
            assert html_main.main_text(f"<body><nav><a href=x>menu</a></nav>{around.format(html)}</body>") == want, (html, around)
    after = f'<body><main><article>{article}</article>{thread}</main></body>'
    assert html_main.main_text(after) == want


def test_an_article_in_an_odd_container_stays():
    body = f"<h1>Title</h1><p>{SENTENCE * 4}</p><p>{SENTENCE * 3}</p>"
    bare = f"<p>{SENTENCE * 4}</p><p>{SENTENCE * 3}</p>"
    foot = f"<div><p>{'Words at the foot of the page, which nobody marked as such. ' * 2}</p></div>"
    text = lambda html: " ".join(re.sub("<[^>]+>", " ", html).split())
    for name in ("ad-free-reading", "comment-and-debate", "cookie-recipes", "reviews-of-books"):
        for inner in (body, bare):
            assert html_main.main_text(f'<body><div class="{name}">{inner}</div></body>') == text(inner)
            assert text(inner) in html_main.main_text(f'<body><article><div class="{name}">{inner}</div></article>{foot}</body>')
    section = f'<article><p>{SENTENCE * 4}</p><section class="discussion"><h2>Discussion</h2><p>{SENTENCE * 2}</p></section></article>'
    assert html_main.main_text(f"<body>{section}</body>") == text(section)


@given(st.text(alphabet="<>/pdiv ab&;\"'=!-", max_size=120))
@settings(max_examples=300, deadline=None)
def test_any_text_is_a_page(html):
    assert html_main.main_text(html) == " ".join(html_main.main_text(html).split())


def test_page_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    from html import unescape

    for r in QUERIES["op4_main_text"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        assert r.text == " ".join(unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", article))).split())
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_page_cases(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>é</p>", "x"), (1, "u", "", "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_main.extract(df).collect()) == [("", 0)] * 3 + [("é", 1)]
    assert html_main.extract(df.limit(0)).count() == 0


def test_article_text_stays_whatever_its_class():
    long = "<p>" + "A sentence of the article, long enough to count. " * 9 + "</p>"
    legal = '<p class="legal">Legal remarks of the author.</p><p class="share print">Printed words.</p><h2 class="header">Part two</h2>'
    board = '<div class="notice-board"><p>What the board said, in some words.</p></div><math><mi>x</mi></math><div class="tabs">' + long + "</div>"
    gone = '<div class="cookie-notice"><p>Cookies, and so on.</p></div><div class="share"><a href=x>Share this</a></div><div class="ad-box">Buy, buy</div><p class="advert">Buy</p><div class="print">Print</div>'
    text = lambda html: " ".join(re.sub("<[^>]+>", " ", html).split())
    for tag in ("article", "main"):
        assert html_main.main_text(f"<body><{tag}>{long}{legal}{gone}{board}</{tag}></body>") == text(long + legal + board)


def test_sectioned_pages():
    """No part of an article is lost for being short."""
    p = lambda i, size=420: f"<p>{f'part{i} ' + 'word ' * (size // 5)}</p>"
    first, second = "".join(p(i) for i in range(5)), p(5) + p(6)
    nav = "<nav><a href=x>menu</a></nav><div class=related>see also</div>"
    text = lambda html: " ".join(re.sub("<[^>]+>", " ", html).split())
    short = "<h3>End</h3><ul><li>one</li><li>two</li></ul><section><p>Short.</p></section>"
    for tag in ("article", "main"):
        for body in (f"<section>{first}</section><section>{second}</section>", f"<section>{first}</section>{short}", f"<div><div>{first}</div></div><div><div>{second}</div></div>{short}"):
            assert html_main.main_text(f"<html><body>{nav}<{tag}>{body}{nav}</{tag}><footer>foot</footer></body></html>") == text(body)
    body = f"<div>{first}</div><h3>End</h3><div>{second}</div><ul><li>one of the items of a list</li></ul>"
    links = "<h3>More</h3><ul><li><a href=x>one of the other pages</a></li></ul>"
    assert html_main.main_text(f"<html><body><div>{body}{links}</div></body></html>") == text(body)
