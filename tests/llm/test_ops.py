"""Training-data operators against brute force, round trips, and awkward input."""

import hashlib
import random
import re
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verisift.llm import common, components, decontaminate, htmltext, langid, licenses, neighbours, packing, shards, simhash, urlfilter, warc

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, key string, fp long"


def docs_frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), len(t or ""), "clash", "clash", 1) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- language ---------------------------------------------------------------------------------------------------------

EN = "the cat sat on the mat and the dog was with them in this house of theirs "
DE = "der hund ist mit der katze und das haus ist nicht so weit von hier entfernt "


def longest_parse(text, learned):
    n, count = 0, 0
    while n < len(text):
        k = 1
        while n + k < len(text) and tuple(text[n : n + k + 1]) in learned:
            k += 1
        n, count = n + k, count + 1
    return count


def test_automaton_parses_like_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        seq = np.array([rng.randrange(1, 5) for _ in range(60)], np.uint8)
        learned = {tuple(seq[i:j].tolist()) for i in range(60) for j in range(i + 1, 61)}
        table = langid.automaton(seq, 7)
        for _ in range(5):
            text = [rng.randrange(1, 7) for _ in range(rng.randrange(1, 40))]
            lanes = np.array(text, np.uint8)[:, None]
            assert langid.phrases(lanes, table, 7)[0] == longest_parse(text, learned)


def test_language(spark):
    texts = [(i, (EN if i % 2 else DE) * (1 + i % 3)) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "123 ..."), (103, EN * 300), (103, EN * 300), (None, DE)]
    df = docs_frame(spark, texts, lang={i: "en" if i % 2 else "de" for i in range(80)} | {103: None})
    got = langid.identify(df).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "de") for i in range(80)) and by_id[103].lang_pred == "en" and by_id[None].lang_pred == "de"
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (100, 101, 102))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0)).collect() == []
    kept = langid.with_language(df)
    assert kept.columns == df.columns and kept.count() == len(texts) - 3


# -- WARC -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "<p>Ü</p>" * 200
    pages = [(1, "http://a/x y", big), (2, "http://a/\r\nX: y", big), (3, None, "x"), (4, "http://b", "x"), (5, "u", None), (5, "u", None), (7, "http://c", big), (7, "http://c", big), (None, "http://d", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = common.scratch(spark, "warc-test")
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(pages) and all(r.intact for r in got)
    for r in got:
        html = next(h or "" for p, _, h in pages if p == r.page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        revisit = r.page_id in (1, 2, None)
        assert (r.record_type, r.refers_to) == (("revisit", 7) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == html
    some = warc.read_records(index.where("url = 'http://b'"), folder).collect()
    assert [(r.page_id, bytes(r.payload)) for r in some] == [(4, b"x")]
    assert warc.read_records(warc.write_archives(df.limit(0), folder), folder).collect() == []


def test_ranges_are_coalesced(tmp_path):
    from pyarrow import fs

    (tmp_path / "f").write_bytes(bytes(range(256)) * 1000)
    reads = []

    class Counting(fs.LocalFileSystem):
        def open_input_file(self, path):
            f = super().open_input_file(path)

            class File:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    f.close()

                def read_at(self, n, at):
                    reads.append((at, n))
                    return f.read_at(n, at)

            return File()

    ranges = [(0, 10), (10, 5), (100, 7), (200_000, 3)]
    got = list(warc.read_ranges(Counting(), str(tmp_path / "f"), ranges))
    data = (tmp_path / "f").read_bytes()
    assert got == [data[a : a + n] for a, n in ranges] and reads == [(0, 107), (200_000, 3)]


# -- licenses ---------------------------------------------------------------------------------------------------------


def plain_scan(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    places = [(label, i) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.encode().split()]
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places}))


def test_licenses(spark):
    texts = ["cc by cc BY", "CC-BY 4.0", "All rights reserved. all  rights\treserved", "the GNU General Public License", "", None, "éCC by", "Relaesed under the MIT License", "Released undr the MIT Licence here"]
    texts += ["word " * 50_000 + "Licensed under teh Apache License, Version 2.0", "nothing to see", "permits reserved rights all"]
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(t), t
    assert got[7].labels == "mit" and got[8].labels == "mit" and 0.8 < got[8].score < 1 and got[8].spans[0].errors == 2
    assert got[9].labels == "apache-2.0" and got[10].labels == got[11].labels == "" and got[10].score == 0
    assert got[2].labels == "reserved" and got[2].score == 1
    assert licenses.scan(docs_frame(spark, []), "doc_id").collect() == []


def test_adjoining_notices_are_all_found():
    spans = lambda text: sorted(x[1:4] for x in licenses.Scanner().fuzzy(text.encode().split()) if x[0] == "mit")
    worse, best = "released undr the mit license", "released under the mit license"
    assert [x[2] for x in spans(f"{worse} {best}")] == [1, 0]
    assert [x[2] for x in spans(f"{worse} {best} {worse} {best} {worse}")] == [1, 0, 1, 0, 1]


def spoiled(rng, notice):
    """A notice with as many errors outside of its braces as are allowed."""
    free = [m.start() + 1 for m in re.finditer(r"(?<![{a-z0-9])[a-z]{3,}(?![^{]*\})", notice)]  # no word vanishes, which would be an error more
    k = max(1, (len(notice) - notice.count("{") * 2) // licenses.CHARS_PER_ERROR)
    chars = list(notice)
    for at in sorted(rng.sample(free, min(k, len(free))), reverse=True):
        chars[at : at + rng.choice([0, 1])] = rng.choice(["", "q", "z"])
    return "".join(chars).replace("{", "").replace("}", "")


def test_pigeonhole_finds_all_within_the_bound():
    rng, scanner = random.Random(5), licenses.Scanner()
    for label, notice in licenses.NOTICES:
        for _ in range(20):
            text = spoiled(rng, notice)
            assert label in {x[0] for x in scanner.fuzzy(("aa bb " + text + " cc dd").encode().split())}, text


def test_spans_are_those_of_a_search_without_seeds():
    rng, scanner = random.Random(15), licenses.Scanner()
    for _ in range(30):
        words = []
        for _ in range(12):
            words += (spoiled(rng, rng.choice(licenses.NOTICES)[1]) if rng.random() < 0.6 else rng.choice(["the license", "all rights", "apache mit bsd", "x y z"])).split()
        text = " ".join(words)
        plain = sorted((scanner.notices[i][0], *m.span()) for i in range(len(scanner.notices)) for m in scanner._matches(i, text, 0, len(text)))
        assert sorted(x[:3] for x in scanner.fuzzy([w.encode() for w in words])) == plain, text


@pytest.mark.parametrize("text", ["released under the mpl license", "Licensed under the Apache License, Version 1.1", "Mozilla Public License Version 1.1", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: MITNFA", "unreleased under the mit licenses of x"])
def test_other_licenses_are_no_errors(text):
    assert licenses.Scanner().scan(text.encode())["labels"] in ("", "mit" if text.startswith("unrel") else "")


def test_long_texts_take_linear_time():
    import time

    scanner, began = licenses.Scanner(), time.perf_counter()
    found = scanner.scan(b"cc by " * 80_000)
    assert time.perf_counter() - began < 1.5 and (found["n_base"], found["first_word"], found["last_word"]) == (80_000, 0, 159_998)
    assert len(scanner.scan(b"all rights reserved " * 20_000)["spans"]) == 20_000 and time.perf_counter() - began < 5


# -- main text --------------------------------------------------------------------------------------------------------


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def text_of(html):
    return htmltext.main_text(htmltext.blocks(html), [])


@pytest.mark.parametrize(
    "body, want",
    [
        ("<nav><a>x</a></nav><article><h1>A &amp; B</h1><p><b>one<br><p>two &eacute;\n  three</p></article><footer>f</footer>", "A & B\none\ntwo é three"),
        ("<article><p>a</p><div class='ad-box'>b</div><script>var t='</p>';</script><p>c</article><aside>d</aside>", "a\nc"),
        ("<div class=sidebar><p>x</div><div id='content'><p>a<p>b</div><form><input>z</form>", "a\nb"),
        ("<main><article><p>a</p></article><section id='comments'><article class='comment'><p>c</p></article></section></main>", "a"),
        ("<header>top</header><article><header><h1>T</h1><p>by x</p></header><p>a</p></article>", "T\nby x\na"),
        ("<article><header><h1>T</h1><p>lead</p></header><div class='share-price-table'>s</div><div class='social-history'>h</div><p>x <math><mi>y</mi></math></p></article>", "T\nlead\ns\nh\nx y"),
        ("<div class='cookie-notice'>n</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<p title='a > b'>x<!-- <p>y --> z", "x z"),
        ("<p>1 < 2 and <unknown>3</unknown>", "1 < 2 and 3"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert text_of(page(body)) == want


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = [a[i] for i in sorted(htmltext.shared_lines(a, b))]
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(x in it for x in got)


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_differencing(spark):
    """Menus and footers without any mark go if neighbours share them; copies of a page say nothing about it."""
    rng = random.Random(3)
    texts = {i: words(rng, 12) for i in range(6)}
    html = lambda x: page(f"<div>Site menu</div><div>{x}</div><div>{'All about us ' * 40}</div>")
    pages = [(i, f"http://h/a/{i}", html(texts[i])) for i in range(3)] + [(10 + i, "http://h/a/1", html(texts[1])) for i in range(80)]
    pages += [(3, "http://i/a", html(texts[3])), (4, None, None), (None, "x", ""), (2, "http://h/a/2", html(texts[2])), (5, "http://h/a/1", html(texts[1] + " more"))]
    got = [(r.page_id, r.text) for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()]
    assert len(got) == len(pages)
    want = {0: texts[0], 1: texts[1], 2: texts[2], 5: texts[1] + " more", 4: "", None: "", 3: f"Site menu\n{texts[3]}\n{('All about us ' * 40).strip()}"}
    assert all(t == want.get(i, texts[1]) for i, t in got)


def test_marked_parts_are_confirmed_and_names_overruled():
    rng = random.Random(4)
    body, quote = [words(rng, 30) for _ in range(6)], words(rng, 30)
    html = lambda i: page(f"<main>Welcome to us</main><div class='notice'><p>{body[i]}</p></div><p>Legal text</p>")
    lines = lambda h: [b.text for b in htmltext.blocks(h)]
    text = lambda h, others: htmltext.main_text(htmltext.blocks(h), htmltext.aligned(lines(h), map(lines, others)))
    assert text(html(0), [html(1), html(2)]) == body[0]
    article = lambda i: page(f"<article><h1>{body[i][:20]}</h1><p>{body[i]}</p><p>{quote}</p><div class='x'>Tell your friends</div></article>")
    assert text(article(0), [article(i) for i in (1, 2, 3)]) == f"{body[0][:20]}\n{body[0]}\n{quote}"


def test_large_hosts_give_the_same_as_one_task(spark, monkeypatch):
    rng = random.Random(5)
    menus = [words(rng, 4) for _ in range(3)]
    pages = []
    for i in range(700):
        section = rng.randrange(3)
        body = "".join(f"<p>{words(rng, rng.randrange(1, 9))}</p>" for _ in range(rng.randrange(1, 4)))
        pages.append((i, f"http://big/{'abc'[section]}/{rng.randrange(400)}", page(f"<div>{menus[section]}</div>{body}<div>Foot</div>")))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    monkeypatch.setattr(htmltext, "HOST_PAGES", 1 << 20)
    want = sorted(rows(htmltext.extract(df)))
    assert all("Foot" not in r[2] for r in want) and sum(any(m in r[2] for m in menus) for r in want) == 0
    monkeypatch.setattr(htmltext, "HOST_PAGES", 100)
    assert sorted(rows(htmltext.extract(df))) == want


# -- nearest neighbours -----------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2, size=(900, 1))
    v[5:60] = v[3]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] + [1.0] * 15), (2080, [1.0, 2.0]), (None, [1.0] * 16), (40, [float(x) for x in v[40]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).withColumn("rid", F.lit(0))
    got = neighbours.nearest(df, lambda i: i % 20 == 0).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(20, 900, 20):
        if q == 40:
            continue
        scores = (np.vstack([v, v[40]]) * v[q]).sum(axis=1)
        ids = np.append(np.arange(900), 40)
        own = np.flatnonzero(ids == q)[0]
        scores[own] = -np.inf
        want = ids[np.lexsort((ids, -scores))[:20]]
        found = sorted(by_query[q])
        assert [x[0] for x in found] == list(range(1, 21))
        assert all(abs(s - v[i] @ v[q]) < 1e-9 for _, i, s in found)
        hits, total = hits + len(set(want) & {x[1] for x in found}), total + len(set(want))
    assert hits / total >= 0.9
    assert not {2000, 2020, 2040, 2060, 2080} & set(by_query)
    assert len(by_query[40]) == 40  # two rows with this id, a query each
    few = neighbours.nearest(df.where("vec_id < 4"), lambda i: i % 20 == 0, k=20).collect()
    assert sorted((r["rank"], r.query_id) for r in few) == [(1, 0), (2, 0), (3, 0)]
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).collect() == []


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_neighbours_over_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 700)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 60)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(4000, 32))
    if kind == "clustered":
        v = v * 0.3 + rng.normal(size=(20, 32))[rng.integers(0, 20, 4000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    scores = v[::20] @ v.T
    scores[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = np.argsort(-scores, axis=1, kind="stable")[:, :20]
    assert sum(len(got[20 * q] & set(want[q].tolist())) for q in range(200)) >= 0.9 * 200 * 20


def test_windows_save_verifications():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = neighbours.Index(np.arange(4000), v, float(np.linalg.norm(v, axis=1).max()))
    found = [set(rows.tolist()) for rows, _ in index.search(v[:100], list(range(100)), [None] * 100, 20)]
    first, index.verified = index.verified, 0
    scores = v[:100] @ v.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    want = [set(np.argsort(-s)[:20].tolist()) for s in scores]
    assert sum(len(a & b) for a, b in zip(found, want)) >= 0.9 * 2000 and first < 0.75 * 100 * 4000
    bounds = [float(np.sort(s)[-20]) for s in scores]
    again = [set(rows.tolist()) for rows, _ in index.search(v[:100], list(range(100)), bounds, 20)]
    assert sum(len(a & b) for a, b in zip(again, want)) >= 0.9 * 2000 and index.verified < 0.75 * 100 * 4000


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_collisions_lose_none_of_a_window(n):
    """All that lie in THRESHOLD windows collide, what the widest hold is everything, and copies collide alike."""
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8))
    v[n // 3 : n // 2] = v[0]
    index = neighbours.Index(np.arange(n), v, float(np.linalg.norm(v, axis=1).max()))
    lift = np.sqrt(np.maximum(index.longest**2 - (v**2).sum(axis=1), 0))
    hashed, centres = np.column_stack([v, lift]) @ index.planes, rng.normal(size=(30, neighbours.PROJECTIONS)) * 3
    for half in (0.0, 2.0, 5.0, 1e9):
        sets = index._colliding(index._ends(centres, np.full(30, half)))
        for q in range(30):
            rows = index._rows(sets[q]).tolist()
            assert set(np.flatnonzero((np.abs(hashed - centres[q]) <= half).sum(axis=1) >= neighbours.THRESHOLD).tolist()) <= set(rows)
            assert half < 1e9 or rows == list(range(n))
            assert len(set(range(n // 3, n // 2)) - set(rows)) in (0, n // 2 - n // 3)
    for q, (rows, scores) in enumerate(index.search(v, list(range(n)), [None] * n, n)):
        assert sorted(rows.tolist()) == [i for i in range(n) if i != q] and (np.diff(scores) <= 0).all()


def test_counting_takes_less_than_a_look_at_each_entry():
    """The work of a block is queries times vectors; what one of them costs decides how CPU seconds grow."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(12_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    queries, v = v[:64], v[64:]
    index = neighbours.Index(np.arange(len(v)), v, 1.0)
    bounds = np.sort(queries @ v.T, axis=1)[:, -20].tolist()
    hashed = np.column_stack([v, np.sqrt(np.maximum(1 - (v**2).sum(axis=1), 0))]) @ index.planes
    order, values = np.argsort(hashed, axis=0).T.astype(np.int32), np.sort(hashed, axis=0).T.copy()
    began = time.thread_time()
    found = [set(rows.tolist()) for rows, _ in index.search(queries, [-1] * 64, bounds, 20)]
    took, began = time.thread_time() - began, time.thread_time()
    centres = queries @ index.planes[:-1]
    for q, query in enumerate(queries):
        half = index._reach(bounds[q], 1.0)
        hits = np.concatenate([o[np.searchsorted(x, c - half) : np.searchsorted(x, c + half, side="right")] for o, x, c in zip(order, values, centres[q])])
        rows = np.flatnonzero(np.bincount(hits, minlength=len(v)) >= neighbours.THRESHOLD)
        assert set(rows[(v[rows] * query).sum(axis=1) >= bounds[q] + 1e-12].tolist()) <= found[q]
    assert took < (time.thread_time() - began) / 2


# -- packing ----------------------------------------------------------------------------------------------------------


class Letters:
    def __call__(self, text):
        return np.array([ord(c) for c in text], dtype="<u4")


def check_pieces(pieces, docs, encode):
    by_seq, by_doc = {}, {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= packing.WINDOW
    for i, text in docs:
        ids, at = np.append(encode(text or ""), np.uint32(1)).astype("<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return by_seq


def test_packing(spark):
    rng = random.Random(4)
    docs = [(i, "abc\U0001f600 "[: rng.randrange(6)] * rng.randrange(900)) for i in range(300)] + [(900, None), (901, ""), (902, "x" * 50_000)]
    df = docs_frame(spark, docs, source={i: "hot" if i % 3 else f"s{i % 7}" for i in range(300)} | {900: None})
    pieces = packing.pack(df, bin_tokens=100_000, encoder=Letters).collect()
    by_seq = check_pieces(pieces, docs, Letters())
    full = sum(sum(n for _, n in x) for x in by_seq.values())
    assert full / (len(by_seq) * packing.WINDOW) > 0.97
    assert packing.pack(df.limit(0), encoder=Letters).collect() == []
    check_pieces(packing.pack(df, weights={"hot": 1.0, "s0": 5.0, "none": -1}, encoder=Letters).collect(), docs, Letters())


def test_round_robin_keeps_the_shares():
    docs = [("a", 300)] * 200 + [("b", 100)] * 300 + [("c", 37)] * 100
    total = {s: sum(n for x, n in docs if x == s) for s in "abc"}
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    got = {}
    for i, _, n, sequence, _ in packing.deal(docs, shares, {}):
        got.setdefault(sequence, dict.fromkeys("abc", 0))[docs[i][0]] += n
    run = dict.fromkeys("abc", 0)
    for k in sorted(got)[:-2]:
        for s in "abc":
            run[s] += got[k][s]
            assert abs(run[s] - shares[s] * (k + 1) * packing.WINDOW) <= 2 * packing.WINDOW * max(shares.values())


@pytest.mark.parametrize("weights", [None, {"s0": 3.0, "s1": 2.0, "s2": 1.0}])
def test_windows_keep_the_shares_over_all_bins(spark, weights):
    rng = random.Random(14)
    docs = [(i, "x" * rng.randrange(10, 1200)) for i in range(2400)]
    source = {i: f"s{min(3, rng.randrange(6)) % 3}" for i, _ in docs}
    pieces = packing.pack(docs_frame(spark, docs, source=source), weights=weights, bin_tokens=60_000, encoder=Letters).collect()
    check_pieces(pieces, docs, Letters())
    size = {s: sum(len(t) + 1 for i, t in docs if source[i] == s) for s in ("s0", "s1", "s2")}
    share = {s: (weights[s] / 6 if weights else size[s] / sum(size.values())) for s in size}
    sent, order = dict.fromkeys(size, 0), sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    assert len({r.sequence_id >> 32 for r in pieces}) > 10
    for last, r in zip([None, *order], order):
        if last and last.sequence_id != r.sequence_id:
            if any(sent[s] == size[s] for s in size):  # the mixture holds until a source is empty
                break
            done = sum(sent.values())
            # A document and a turn of a window for each source.
            assert all(abs(sent[s] - share[s] * done) <= 3 * packing.WINDOW for s in size), (sent, done)
        sent[r.source] += r.length
    assert sum(sent.values()) > 0.95 * min(size[s] / share[s] for s in size)


def test_encoder_is_the_tokenizers_library():
    encode, rng = packing.Encoder(), random.Random(6)
    pieces = ["Hello ", "wörld", "  ", "\n\n", "\t", "don't", "12345", "é", "日本", "\u0301", "🙂", "...", "<|endoftext|>", "\x85", "\xa0", " x", "I'LL", "ſ", "½", "—", "\r\n"]
    for _ in range(300):
        t = "".join(rng.choice(pieces) for _ in range(12))
        assert encode(t).tolist() == encode.exact.encode(t, add_special_tokens=False).ids, t


# -- shards -----------------------------------------------------------------------------------------------------------


def test_shards(spark):
    store = shards.ShardStore(spark, common.scratch(spark, "store"), target_bytes=60_000, fan_in=3, least_bytes=4_000)
    with pytest.raises(FileNotFoundError):
        store.read()
    texts = [(i, f"text {i} " * (i % 50)) for i in range(400)] + [(None, None), (7, "again"), (7, "again")]
    df = docs_frame(spark, texts).repartition(3)
    for part in range(4):
        store.append(df.where(F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0)) == part))
    before = store.manifest()
    assert store.versions() == [1, 2, 3, 4] and len(before["shards"]) >= 8
    want = sorted(rows(df.select("doc_id", "text")), key=str)
    assert sorted(rows(store.read().select("doc_id", "text")), key=str) == want
    assert store.compact() > 0
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) and store.plan() == []
    assert sorted(rows(store.read().select("doc_id", "text")), key=str) == want
    assert store.read(version=4).count() == len(texts)  # older versions stay readable until the vacuum
    assert store.vacuum() >= len(before["shards"]) - len(after["shards"])
    assert sorted(rows(store.read().select("doc_id", "text")), key=str) == want
    with pytest.raises(shards.Conflict):
        store.commit([], [before["shards"][0]["path"]])
    other = shards.ShardStore(spark, store.root)
    stale = store.manifest()
    assert other.commit([]) == stale["version"] + 1 and store.commit([]) == stale["version"] + 2


# -- SimHash ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_masks_cover_every_pair(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    assert min(m.bit_count() for m in masks) >= 20
    for _ in range(2000):
        flips = sum(1 << i for i in rng.sample(range(64), radius))
        assert any(not flips & m for m in masks)


def brute_components(ids, fps, radius):
    root = {}
    order = sorted(zip(ids, fps))
    for i, f in order:
        todo, root[i] = None, root.get(i, i)
    changed = True
    while changed:
        changed = False
        for a, f in order:
            for b, g in order:
                if (f ^ g).bit_count() <= radius and root[b] > root[a]:
                    root[b], changed = root[a], True
    return root


@pytest.mark.parametrize("radius, bucket", [(2, 4_096), (2, 4), (4, 4_096), (4, 4)])
def test_links_lose_no_pair(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng, fps = random.Random(radius), []
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for _ in range(12)]
    fps = sorted(set(fps))
    signed = [simhash._signed(f) for f in fps]
    links = simhash.hamming_links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius)
    for a, b in rows(links):
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= radius
    got = dict(rows(components.connected_components(links)))
    want = brute_components(signed, [f & (1 << 64) - 1 for f in signed], radius)
    assert all(got.get(f, f) == want[f] for f in signed)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 90)] + [(1, 1), (None, 2)]
    got = dict(rows(components.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(400):
        for a, b in edges:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert rows(components.connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_near_groups(spark):
    import xxhash

    base = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    texts = [(1, base), (2, base.upper()), (3, base), (4, None), (5, ""), (6, " \n"), (7, "one two"), (8, "one\ttwo"), (9, "other words here entirely"), (None, base), (3, base), (10, "x " * 40_000)]
    got = rows(simhash.near_groups(docs_frame(spark, texts)))
    assert len(got) == len(texts)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:] == by_id[2][1:] == by_id[3][1:] and by_id[1][2] == 1
    assert {by_id[i][1:] for i in (4, 5, 6)} == {("0" * 16, 4)} and by_id[7][1:] == by_id[8][1:] == (f"{xxhash.xxh64_intdigest(b'one two', 42):016x}", 7)
    assert by_id[None][1] == by_id[1][1] and by_id[None][2] is None
    kept = simhash.without_near_copies(docs_frame(spark, texts))
    assert kept.columns == DOCS.replace(" string", "").replace(" long", "").split(", ")
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "7", "9", "10"])
    assert rows(simhash.near_groups(docs_frame(spark, []))) == []


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"edit{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("run_rows", [1 << 16, 2])
def test_similar_groups(spark, monkeypatch, run_rows):
    if run_rows == 2:  # workers see the number that the function carries with it
        monkeypatch.setattr(simhash, "RUN_ROWS", run_rows)
        monkeypatch.setattr(simhash, "BUCKET", 4)
    rng, texts = random.Random(21), []
    for family in range(12):
        base = [f"word{rng.randrange(3000)}" for _ in range(220)]
        for copy in range(8):
            texts.append((len(texts), " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 30])))))
    texts += [(500, None), (501, ""), (502, "kurz"), (503, "KURZ"), (504, "kurz zwei"), (0, texts[0][1]), (None, texts[0][1])]
    got = {}
    for i, c in rows(simhash.similar_groups(docs_frame(spark, texts))):
        got.setdefault(i, set()).add(c)
    assert got.pop(None) == got[0]
    assert all(len(c) == 1 for c in got.values())
    got = {i: c.pop() for i, c in got.items()}
    ids = sorted(i for i in got)
    sets = {i: simhash.shingle_set((t or "").encode()) for i, t in texts if i is not None}
    root = {i: i for i in ids}
    similar = [(a, b) for a in ids for b in ids if a < b and simhash.similarity(sets[a], sets[b]) >= 0.8]
    for _ in ids:
        for a, b in similar:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[got[i]] == root[i] for i in ids)  # no group holds documents that are not linked
    assert sum(got[i] == root[i] for i in ids) >= 0.9 * len(ids)
    assert got[500] == got[501] == 500 and got[502] == got[503] == 502 and got[504] == 504


def groups_by_brute_force(texts):
    ids = [i for i, _ in texts]
    sets = {i: simhash.shingle_set(t.encode()) for i, t in texts}
    root = {i: i for i in ids}
    similar = [(a, b) for a in ids for b in ids if a < b and simhash.similarity(sets[a], sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in similar:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


def test_dense_families_lose_no_link(spark):
    """Variants of a template around the threshold: most candidates fail, and copies are reached past failed ones."""
    rng, texts = random.Random(77), []
    for family in range(4):
        base = [f"word{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(30):
            one = edited(rng, base, rng.choice([3, 4, 5]))
            texts.append((len(texts), " ".join(one)))
            texts.append((len(texts), " ".join(edited(rng, one, 2))))
    want = groups_by_brute_force(texts)
    assert 10 < len(set(want.values())) < 230
    assert dict(rows(simhash.similar_groups(docs_frame(spark, texts)))) == want


def test_rows_without_an_id_are_compared(spark):
    """A row key decides, not the id alone: copies go, with or without an id, and repeated rows count once."""
    base, other = " ".join(f"word{i}" for i in range(50)), " ".join(f"else{i}" for i in range(50))
    texts = [(None, base), (5, base), (None, other), (None, other), (None, other + " more"), (7, "alone"), (7, "alone"), (7, base + " more"), (8, None), (None, "")]
    kept = rows(simhash.without_near_copies(docs_frame(spark, texts)).select("doc_id", "text"))
    assert len(kept) == 4 and {(5, base), (7, "alone"), (8, None)} < set(kept)
    assert [t for i, t in kept if i is None][0] in (other, other + " more")


def test_equal_words_in_another_order_are_compared(spark):
    """The text with the smallest id is unlike the others of the same words, which are like each other."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(80)]
    mixed = rng.sample(words, 80)
    swapped = mixed[:78] + mixed[:77:-1]
    far = mixed[:70] + [f"other{i}" for i in range(4)] + mixed[70:]
    texts = [(1, " ".join(words)), (2, " ".join(mixed)), (3, " ".join(swapped)), (4, " ".join(far))]
    want = groups_by_brute_force(texts)
    assert want == {1: 1, 2: 2, 3: 2, 4: 2}
    assert dict(rows(simhash.similar_groups(docs_frame(spark, texts)))) == want


def test_added_passages_and_short_texts_are_found(spark):
    rng, texts = random.Random(8), []
    for n, more in [(100, 20), (200, 40), (60, 10), (20, 2), (9, 1)] * 6:
        base = [f"word{rng.randrange(10**6)}" for _ in range(n)]
        texts += [(len(texts), " ".join(base)), (len(texts) + 1, " ".join(base + [f"new{rng.randrange(10**6)}" for _ in range(more)]))]
    want = groups_by_brute_force(texts)
    assert all(want[i] == i - i % 2 for i in want)
    assert dict(rows(simhash.similar_groups(docs_frame(spark, texts)))) == want


# -- URLs -------------------------------------------------------------------------------------------------------------


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), raw)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_urls(spark):
    rng = random.Random(8)
    hosts, paths = ["example.com", "www.Example.com", "a.www.example.com", "x.net", "net", "notexample.com", "", "example.com:80", "ünet", "a..com", "com."], ["", "/", "/en/", "/en", "/en/x", "/es/", "/fr/a/b", "//", "/EN/x"]
    urls = [f"{s}{h}{p}{e}" for s in ("http://", "a://b://", "") for h in hosts for p in paths for e in ("", "?q=/en/", "#f://", "/?")] + [None, "", "://", "http://" + "a." * 500 + "net/es/" + "x" * 5000]
    rules = [*urlfilter.RULES, ("example.com", "", "block"), ("example.com", "/en/", "allow"), ("www.example.com", "/en/x", "block"), (None, "/", "block"), ("net", "/es/", "block"), ("", "/", "block")]
    data = [(i if rng.random() < 0.9 else None, u) for i, u in enumerate(urls)]
    df = spark.createDataFrame(data, "page_id long, url string").withColumn("host", F.lit("clash"))
    plain = [*[r for r in rules if r[0]]]
    got = sorted(map(str, rows(urlfilter.url_filter(df, urlfilter.rules_frame(spark, rules)))))
    assert got == sorted(str((i, *plain_verdict(u, plain))) for i, u in data)
    assert rows(urlfilter.url_filter(df.limit(0), urlfilter.rules_frame(spark))) == []
    assert rows(urlfilter.url_filter(spark.createDataFrame([(1, "http://comen/")], "page_id long, url string"), urlfilter.rules_frame(spark, [("com", "en/", "block")]))) == [(1, "comen", "/", None, "allow")]
    none = urlfilter.url_filter(df, urlfilter.rules_frame(spark).limit(0)).collect()
    assert len(none) == len(data) and all(r.rule is None and r.verdict == "allow" for r in none)


def test_any_number_of_rule_shapes(spark, monkeypatch):
    rules = [("a.b.net", "/" + "x" * k, "block") for k in range(40)] + [("net", "/" + "x" * k, "allow") for k in range(30, 60)]
    urls = [(k, f"http://{h}/{'x' * k}") for k in range(0, 70, 3) for h in ("a.b.net", "c.a.b.net", "b.net", "org")] + [(99, None)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    want = sorted(map(str, ((i, *plain_verdict(u, rules)) for i, u in urls)))
    for most in (urlfilter.MAX_SHAPES, 8):
        monkeypatch.setattr(urlfilter, "MAX_SHAPES", most)
        assert sorted(map(str, rows(urlfilter.url_filter(df, urlfilter.rules_frame(spark, rules))))) == want


# -- decontamination --------------------------------------------------------------------------------------------------


def plain_leaks(docs, items, least=0.8, k=5):
    from collections import Counter

    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    grams = lambda w, s: Counter(tuple(w[i : i + s]) for i in range(len(w) - s + 1))
    out = {}
    for item, t in items:
        iw = words(t)
        s = min(k, len(iw))
        if not iw:
            continue
        own = grams(iw, s)
        for doc, d in docs:
            w = words(d)
            for at in range(max(1, len(w) - len(iw) + 1)):
                g = grams(w[at : at + len(iw)], s)
                sim = sum((own & g).values()) / max(1, sum((own | g).values()))
                if sim >= least:
                    out[doc, item] = max(sim, out.get((doc, item), 0))
    return out


def test_leaks(spark):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(500)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([14, 20, 37, 60, 60, 90, 3, 1])] + [(20, None), (21, ""), (22, "One two, three; four five six seven.")]
    docs = []
    for i, (_, t) in enumerate(items[:6]):
        w = t.split()
        docs += [(100 + i, " ".join(some(50) + w + some(40))), (200 + i, " ".join(some(20) + w[:20] + ["changed"] + w[21:] + some(9))), (300 + i, " ".join(w[: len(w) // 2] + some(30))), (400 + i, t.upper().replace(" ", ",\n"))]
        docs += [(500 + i, " ".join(some(10) + w[:30] + w[31:] + some(10))), (600 + i, " ".join(some(5) + w[:15] + ["new"] + w[15:]))]
    docs += [(1, None), (2, ""), (3, items[6][1]), (4, "x " + items[7][1] + " y"), (5, "one TWO three-four five six (seven)"), (6, " ".join(some(30_000) + items[3][1].split() + some(9)))]
    df, it = docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(df, it).collect()}
    want = plain_leaks(docs, items)
    assert got == pytest.approx(want)
    twice = decontaminate.leaks(df.union(df), it.union(it)).collect()
    assert len(twice) == 2 * len(want)
    clean = decontaminate.without_leaks(df, it)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert rows(decontaminate.leaks(df, it.limit(0))) == [] and rows(decontaminate.leaks(df.limit(0), it)) == []


def test_leaks_of_rows_without_an_id_and_long_items(spark, monkeypatch):
    item = " ".join(f"word{i}" for i in range(40))
    docs = [(None, item), (None, "clean words only"), (1, item + " x"), (1, "another clean text")]
    df, it = docs_frame(spark, docs), spark.createDataFrame([(7, item)], "item_id long, text string")
    for most, shuffled in ((decontaminate.MAX_SHINGLES, False), (20, False), (20, True)):
        monkeypatch.setattr(decontaminate, "MAX_SHINGLES", most)
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1 if shuffled else 1_000_000)
        assert {(r.doc_id, r.text) for r in decontaminate.without_leaks(df, it).collect()} == {(None, "clean words only"), (1, "another clean text")}


def test_blocks_guarantee_the_radius():
    rng, masks = random.Random(12), decontaminate._block_masks(decontaminate.RADIUS)
    assert sum(m & (1 << 64) - 1 for m in masks) == (1 << 64) - 1
    for _ in range(1000):
        x = sum(1 << i for i in rng.sample(range(64), decontaminate.RADIUS))
        assert any(not x & m for m in masks)


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    en, de = EN.split(), DE.split()
    fresh = lambda w, n, i: " ".join(rng.choice(w) + (f"{i}x{rng.randrange(50)}" if rng.random() < 0.5 else "") for _ in range(n))
    texts = [(i, fresh(en if i % 2 else de, 120, i)) for i in range(60)]
    leak = "an item of the benchmark that somebody has copied into a document on the web by mistake"
    texts += [(100, texts[5][1]), (101, texts[6][1] + " more"), (102, texts[7][1] + " " + leak), (103, "12 34"), (104, fresh(en, 60, 104) + " " + leak)]
    docs_frame(spark, texts, lang={i: "en" if i % 2 else "de" for i in range(60)}).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = common.table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.save(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = {i for i, _ in texts}
    assert kept[0] == everything - {103}
    assert {100, 101} & kept[1] == set() and everything - {103, 100, 101, 102} <= kept[1]
    assert kept[2] == kept[1] - {102, 104}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_pieces(pieces, [(i, t) for i, t in texts if i in kept[2]], packing.Encoder())
    assert {r.doc_id for r in pieces} == kept[2]
