"""Token counts, personal data, licences and archives against brute force."""

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assetloom.llm import licences, pii, tokens, warc


@pytest.fixture(scope="module")
def sp():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return tokens.PairCounter(path), sentencepiece.SentencePieceProcessor(model_file=path)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" ▁\n\tabthe<s>é漢\x00😀.", max_size=40))
def test_token_counts_equal_the_library(sp, text):
    assert sp[0].count(text) == len(sp[1].encode(text))


def test_token_counts_of_whole_table(spark, docs, odd, sp):
    for r in tokens.token_counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.n_bytes == len(r.text.encode()) and r.n_tokens == len(sp[1].encode(r.text)) and r.over_limit == (r.n_tokens > 4096)
    assert tokens.token_counts(odd.limit(0)).count() == 0
    got = tokens.token_counts(odd, limit=3).collect()
    assert len(got) == 9 and sum(r.n_tokens == 0 for r in got) == 3 and any(r.over_limit for r in got)


def test_models_with_other_pieces_are_refused(tmp_path, sp):
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    assert tokens.piece_kinds(raw) <= {1, 2, 3, 6}
    piece = b"\x0a\x05<own>\x15" + b"\0" * 4 + b"\x18\x04"
    path = tmp_path / "own.model"
    path.write_bytes(raw + b"\x0a" + bytes([len(piece)]) + piece)
    with pytest.raises(ValueError, match="user-defined"):
        tokens.PairCounter(str(path))


def test_long_word_needs_no_quadratic_time(sp):
    text = "ab" * 30_000
    assert sp[0].count(text) == len(sp[1].encode(text))


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            v, d = m[0], re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda v, d: True,
                "ip": lambda v, d: all(int(x) <= 255 for x in v.split(".")),
                "card": lambda v, d: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda v, d: 8 <= len(d) <= 15,
            }[kind](v, d)
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_brute_force(spark, docs):
    rnd = random.Random(5)
    alphabet = ["a", "b.c", "@", "x@y.z", ".", "-", "+", " ", "1", "22", "255", "256", "4591718099287256", "4111 1111 1111 1111", "+1 (679) 555-1339", "é", "漢", "10.0.0.1", "\n", "😀"]
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))) for i in range(2000)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    both = made.unionByName(docs.select("doc_id", "text").filter("text rlike '[0-9@]'").selectExpr("doc_id + 10000 doc_id", "text"))
    text = {r.doc_id: r.text for r in both.collect()}
    for r in pii.find(both).collect():
        want = base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text[r.doc_id], r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert set(want) <= set(r.spans.split(",")) | {""} and len(r.spans.split(",")) == len(want) + r.added or not want


def test_cards_of_any_grouping_are_found(spark):
    rnd = random.Random(7)
    digits = ["4111111111111111", "4591718099287256", "6304000000000000000", "4111111111111112"]

    def dealt(d, sizes, sep):
        out = []
        while d:
            n = rnd.choice(sizes)
            out, d = [*out, d[:n]], d[n:]
        return "".join(x + rnd.choice(sep) for x in out[:-1]) + out[-1]

    rows = ["41 11 11 11 11 11 11 11", "-".join("4111111111111111"), "x 1 2 y 33-44"]
    rows += [dealt(rnd.choice(digits), sizes, sep) for sizes in ([1], [2], [3], [1, 2], [1, 2, 3]) for sep in (" ", "-", " -") for _ in range(10)]
    rows += ["".join(rnd.choice(["4 1 1 1 1 1 1 1 ", "1 1 1 1 1 1 1 1", "41-11-11-11-", "11 11", "a", " ", "-", "7", "12"]) for _ in range(8)) for _ in range(300)]
    got = pii.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sum(r.n_card for r in got) > 100
    for r in got:
        want = base_spans(rows[r.doc_id])
        assert r.n_card == sum(x.startswith("card") for x in want), rows[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), rows[r.doc_id]


def test_pii_adds_convincing_candidates_only(spark, odd):
    rows = [(i, f"please call our phone (212) 555-{i:04d} or write mail to joe{i} [at] mail [dot] com") for i in range(60)]
    rows += [(100 + i, f"invoice order serial 212-555-{i:04d}") for i in range(60)] + [(200 + i, f"mail me@host{i}.com") for i in range(20)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].added == 2 for i in range(60)) and all(got[200 + i].n_email == 1 for i in range(20))
    assert all(got[100 + i].added == 0 for i in range(60))
    assert len(pii.find(odd).collect()) == 9 and pii.find(odd.limit(0)).count() == 0


def test_secrets_and_gazetteers(spark):
    rnd = random.Random(3)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words then token = "{key()}" and more') for i in range(40)]
    rows += [(100 + i, f"see the page at chapters/section_{i}_with_many_words/page") for i in range(40)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_secret == 1 and got[i].spans == "secret:25:65" for i in range(40))
    assert all(got[100 + i].added == 0 for i in range(40))


def brute_trust(rows, rounds=200):
    """The same expectation-maximisation over single candidates instead of counted patterns, for one kind."""
    import math

    p = [1 / (1 + math.exp(-1.5 * sum(x - 1 for x in v))) for v in rows]
    for _ in range(rounds):
        good, bad, odds = 2 + sum(p), 2 + sum(1 - x for x in p), []
        for v in rows:
            o = math.log(good / bad)
            for i, x in enumerate(v):
                g = (0.2, 0.6, 1.2)[x] + sum(q for w, q in zip(rows, p, strict=True) if w[i] == x)
                b = (1.2, 0.6, 0.2)[x] + sum(1 - q for w, q in zip(rows, p, strict=True) if w[i] == x)
                o += math.log(g / good) - math.log(b / bad)
            odds.append(o)
        p = [1 / (1 + math.exp(-o)) for o in odds]
    return p


def test_trust_equals_brute_force():
    import math
    from collections import Counter

    rnd = random.Random(6)
    rows = []
    for i in range(60):
        good = i % 3 > 0
        rows.append(tuple((2 if rnd.random() < a else 1 if rnd.random() < 0.5 else 0) if good else (0 if rnd.random() < a else 1) for a in (0.9, 0.7, 0.6, 0.3, 0.5)))
    model = pii.estimate([("ip", "".join(map(str, v)), n) for v, n in Counter(rows).items()])
    start, weight = model["ip"]
    got = [1 / (1 + math.exp(-start - sum(weight[i][x] for i, x in enumerate(v)))) for v in rows]
    assert got == pytest.approx(brute_trust(rows), abs=1e-5)
    counts = Counter()
    for v, q in zip(rows, got, strict=True):
        for place, x in enumerate(v):
            counts["ip", place, x, 0] += q
            counts["ip", place, x, 1] += 1 - q
    start, table = pii.classifier([(k, p, v, counts[k, p, v, 0], counts[k, p, v, 1]) for k, p, v, i in list(counts) if i == 0])["ip"]
    good, bad = 1 + sum(got), 1 + sum(1 - q for q in got)
    assert start == pytest.approx(math.log(good / bad))
    assert table[1][2] == pytest.approx(math.log((counts["ip", 1, 2, 0] + 1 / 3) / good) - math.log((counts["ip", 1, 2, 1] + 1 / 3) / bad))


def test_added_spans_touch_no_base_span_and_cover_the_given_secrets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    added = 0
    for r in pii.find(docs).collect():
        base = [tuple(map(int, x.split(":")[1:])) for x in base_spans(text[r.doc_id])]
        more = [x.split(":") for x in r.spans.split(",") if x and x not in base_spans(text[r.doc_id])]
        assert len(more) == r.added and all(int(e) <= s or t <= int(b) for _, b, e in more for s, t in base)
        want = {m[1] for m in re.finditer(r'token = "([0-9a-f]{40})"', text[r.doc_id])}
        assert want <= {text[r.doc_id][int(b) : int(e)] for _, b, e in more}
        added += r.added
    assert added > 0


def test_many_matches_are_linear(spark):
    rows = [(1, ", ".join(str(10**6 + i) for i in range(130_000))), (2, ", ".join(["4111 1111 1111 1111"] * 30_000)), (3, "x[.]" + ", 10.0.0.1, 10[.]0[.]0[.]2" * 5000)]
    began = time.time()
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_card == 0 and got[2].n_card == 30_000 and got[3].n_ip == 5000 and time.time() - began < 60
    assert got[2].spans.startswith("card:0:19,card:21:40,")


def test_long_runs_are_linear(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "a@b" + ".c" * 50_000), (4, "1 " * 50_000), (5, "+1" + "-" * 100_000)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].n_email == 1 and got[1].n_email == got[2].n_card == got[4].n_card == got[5].n_phone == 0


def test_licences(spark, odd):
    mit = "Copyright (c) 2020 Someone\n\n" + licences.LICENCE_TEXTS[0][1].replace("sublicense", "sub-license").upper()
    rows = [(1, mit), (2, "x\n  Released under the MIT Licence!\ny\nSPDX-License-Identifier: Apache-2.0"), (3, mit + " more")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].licence == "MIT" and got[2].licence is None and got[2].notices == "Apache-2.0,MIT" and got[3].licence is None
    for r in rows:
        assert got[r[0]].canonical_sha256 == licences._digest(r[1])
    assert {r.licence for r in licences.scan(odd).collect()} == {None} and licences.scan(odd.limit(0)).count() == 0


def wrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))


def test_whole_licences_in_any_wrapping(spark):
    import os

    rows, want = [], []
    for name, text in licences.LICENCE_TEXTS:
        for head in ("", "Copyright (c) 2001-2020, The Authors\nAll rights reserved.\n\n", "Copyright The Foo Authors\n\n", "© 2020 X\n", "Copyright <YEAR> <HOLDER>\n\n"):
            for width in (60, 79, 10_000):
                rows.append(head + wrapped(text, width))
                want.append(name)
    folder = "/usr/share/common-licenses"
    for name, file in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f"{folder}/{file}"):
            text = open(f"{folder}/{file}").read()
            rows += [text, text.replace("\n", "\r\n").upper(), re.sub(r"[ \n]+", " ", text) if name in ("CC0-1.0", "MPL-2.0") else text]
            want += [name] * 3
    rows += [rows[0] + " and more", "licence", "Copyright notice and nothing else\n\nbody"]
    want += [None] * 3
    out = licences.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    got = {r.doc_id: r.licence for r in out}
    assert [(i, rows[i][:80], got[i]) for i in range(len(rows)) if got[i] != want[i]] == []
    assert all(r.canonical_sha256 == licences._digest(rows[r.doc_id]) for r in out)


def test_licence_sql_on_odd_texts(spark):
    import duckdb
    import pandas as pd

    rnd = random.Random(8)
    bits = ["Copyright (c) 2020 A", "copyright notice and", "All rights reserved.", "", "", " ", "\t", "Released under the MIT Licence!", "licence licenced organisation", "sub-license", "© x", "A & B",
            "Copyright The Authors", "(c) 1999", "wilful_favour", "déjà-licence", "SPDX-License-Identifier: MIT", "all rights reserved to x", "non infringement", "silicence"]
    rows = [(i, "\n".join(rnd.choice(bits) for _ in range(rnd.randint(0, 7)))) for i in range(3000)] + [(5000, None), (5001, "")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.execute(f"select doc_id, canonical_sha256, licence, notices from ({licences.oracle()})").fetchall()
    left, right = {r[0]: tuple(r) for r in got}, {r[0]: r for r in want}
    text = dict(rows)
    wrong = [(text[i], left[i], right[i]) for i in left if left[i] != right[i]]
    assert not wrong, wrong[:5]


PAGES = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (None, "v", "<p>é</p>"), (7, "w", "y" * 300_000)]


def test_warc_round_trip(spark, tmp_path):
    import zstandard

    path = str(tmp_path / "warc")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(pages, path, archive_bytes=1000)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(PAGES)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].record_type == "revisit" and by[1][0].refers_to == 2
    assert sorted(r.record_type for r in by[2]) == ["response", "revisit"]
    assert by[3][0].record_type == "revisit" and by[3][0].refers_to == 4 and by[4][0].payload_bytes == 0
    assert by[None][0].payload.decode() == "<p>é</p>" and by[7][0].payload_bytes == 300_000
    for r in got:
        html = next(p[2] for p in PAGES if p[0] == r.page_id) or ""
        assert r.payload_digest == warc.base32_sha1(html.encode()) and r.payload_bytes == len(html.encode())
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        assert not data or data[:4] == warc.DICTIONARY_MAGIC  # an embedded dictionary leads every archive
        if data:
            size = int.from_bytes(data[4:8], "little")
            d = zstandard.ZstdCompressionDict(data[8 : 8 + size])
            plain = zstandard.ZstdDecompressor(dict_data=d).stream_reader(data, read_across_frames=True).read()
            assert plain.count(b"WARC/1.1") >= 1
    empty = str(tmp_path / "none")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_sql_on_odd_pages(spark, tmp_path):
    import duckdb
    import pandas as pd

    from assetloom.llm import queries as q

    rows = PAGES + [(None, "x", "<p>x</p>"), (None, "x", "<p>x</p>"), (9, "x", None), (9, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = q.op6_warc(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({q.SQL['op6_warc']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
