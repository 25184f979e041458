"""Edge cases of every operator: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelmark.llm import catalog, lm, pii, simhash
from duelmark.llm.components import components
from duelmark.llm.decontaminate import contained_items, drop_contaminated
from duelmark.llm.exact import boundaries, chunks, drop_exact_copies, exact_groups
from duelmark.llm.html import best_path, extract, extract_main_text
from duelmark.llm.lm import score_texts
from duelmark.llm.packing import pack_documents
from duelmark.llm.quality import quality, train as train_quality
from duelmark.llm.simhash import drop_near_copies, near_groups
from duelmark.llm.toxicity import drop_toxic, toxicity, train as train_toxicity
from duelmark.llm.warc import read_captures, url_key, write_archive

LONG = " ".join(f"w{i * 7919 % 30011}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven."), (2, "One two three four five six seven."), (3, "One  two three\nfour five six seven."),
    (4, None), (5, ""), (6, " \n"), (None, "A row without an id"), (None, None), (7, LONG), (8, LONG + " end"), (9, LONG),
    (9, LONG), (10, "😀 Ünï ñ"), (11, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that operators use inside, under the same names
    return spark.createDataFrame([(i, t, "a", None, 1, 2, 3) for i, t in ROWS],
                                 "doc_id long, text string, doc string, fp string, row long, key int, label int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def no_rows(df):
    return df.count() == 0


def test_exact(docs, empty):
    got = exact_groups(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].keep_id == by[2].keep_id == by[3].keep_id == 3 or len(ROWS[2][1]) == len(ROWS[0][1])
    assert by[1].group_size == 3 and by[3].kept and not by[1].kept          # the longest stays
    assert by[4].group_size == 4 and by[4].keep_id == 6                     # null and empty texts are equal
    assert by[7].group_size == 3 and by[7].keep_id == 7 and by[8].group_size == 1
    assert by[10].text_sha256 == hashlib.sha256("😀Ünïñ".encode()).hexdigest()
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 6, 7, 8, 10, 11]
    assert no_rows(exact_groups(empty)) and no_rows(drop_exact_copies(empty))


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "other"), (2, "ab ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_exact_copies(rows).collect()) == [(1, "a b"), (1, "other")]


def test_chunks_follow_content():
    data = np.random.default_rng(1).integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    assert b"".join(chunks(data)) == data
    assert max(np.diff([0, *boundaries(data)])) <= 16384
    moved = b"inserted" + data
    assert len(set(chunks(moved)) & set(chunks(data))) > 0.9 * len(boundaries(data))


def test_near_groups(docs, empty):
    got = near_groups(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        texts = {t or "" for i, t in ROWS if i == r.doc_id}
        assert r.fingerprint in {format(simhash.fingerprint(t.encode()), "016x") for t in texts}
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[7] == by[8] == by[9] == 7
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert no_rows(near_groups(empty)) and no_rows(drop_near_copies(empty))


def test_near_copies_are_decided_per_row(spark, docs):
    kept = [(r.doc_id or 0, r.text) for r in drop_near_copies(docs).collect()]
    assert sorted(kept, key=lambda k: k[0]) == [(0, "A row without an id"), (1, ROWS[0][1]), (4, None), (7, LONG), (10, ROWS[-2][1]), (11, "x")]
    rows = [(3, "one text of a few words"), (5, "one text of a few words"), (5, "quite another thing that nobody else has"), (6, "the last of them all"),
            (None, "one text of a few words"), (None, "no id and no copy anywhere here")]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, rows[5][1]), (3, rows[0][1]), (5, rows[2][1]), (6, rows[3][1])]


@pytest.mark.parametrize("block", [8, 4096])
def test_links_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)        # small blocks: large cells meet block by block
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:12].tolist() + [base[0].item()] * 60:
        for _ in range(5):
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    root = {x: x for x in fps.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps.tolist()):
        for y in fps[i + 1:][np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 4].tolist():
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
    df = spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df)).collect()}
    classes = {}
    for x in fps.tolist():
        signed = int(np.uint64(x).astype(np.int64))
        classes.setdefault(find(x), set()).add(got.get(signed, signed))
    assert all(len(c) == 1 for c in classes.values()) and len({min(c) for c in classes.values()}) == len(classes)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, j) for j in range(1001, 1300)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in range(1000, 1300)} == {1000} and got[5001] == 5000
    assert no_rows(components(spark.createDataFrame([], "a long, b long")))


def test_contained_items(spark, docs, empty):
    items = spark.createDataFrame([(1, "three four FIVE six seven."), (2, "x"), (3, None), (4, ""), (None, "a row without an id"),
                                   (5, " ".join(LONG.split()[100:120])), (6, "not in any document at all here")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.containment) for r in contained_items(docs, items).collect())
    assert got == [(0, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (7, 5, 1.0), (8, 5, 1.0), (9, 5, 1.0), (9, 5, 1.0), (11, 2, 1.0)]
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect()), key=str) == [(0, None), (10, ROWS[-2][1]), (4, None), (5, ""), (6, " \n")]
    assert no_rows(contained_items(empty, items)) and no_rows(contained_items(docs, items.limit(0)))
    assert drop_contaminated(docs, items.limit(0)).count() == len(ROWS)


def test_contaminated_rows_are_decided_one_by_one(spark):
    rows = [(1, "a b c d e f"), (1, "something else"), (None, "x a b c d e f"), (None, "a clean row"), (2, "a b c d e f"), (2, "a b c d e f")]
    items = spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string")
    kept = drop_contaminated(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _gone string"), items)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a clean row"), (1, "something else")]


def test_containment_at_the_threshold(spark):
    words = [f"v{i}" for i in range(44)]                # 40 shingles
    kept = words[:36]                                   # 32 of them: exactly 0.8
    docs = spark.createDataFrame([(1, " ".join(kept)), (2, " ".join(words[:35]))], "doc_id long, text string")
    got = contained_items(docs, spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.shared, r.item_shingles) for r in got] == [(1, 32, 40)]


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    from duelmark.llm.tokens import resolve

    own = Tokenizer.from_file(resolve(catalog.TOKENIZER))
    pieces = pack_documents(docs, catalog.TOKENIZER, window=64).collect()
    want = sorted(own.encode(t or "", add_special_tokens=False).ids + [1] for _, t in ROWS)
    spans = {}
    for p in pieces:
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length, len(p.ids)))
    for row in spans.values():
        row.sort()
        total = sum(n for _, n, _ in row)
        assert [o for o, _, _ in row] == np.cumsum([0] + [n for _, n, _ in row])[:-1].tolist() and all(4 * n == b for _, n, b in row)
        assert total == 64 or total & total - 1 == 0 and total < 64
    ids = {}
    for p in sorted(pieces, key=lambda p: p.start):
        ids.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    for i, t in ROWS:
        if i not in (None, 9):
            assert ids[i] == own.encode(t or "", add_special_tokens=False).ids + [1]
    assert sum(map(len, ids.values())) == sum(map(len, want))
    assert no_rows(pack_documents(empty, catalog.TOKENIZER))


def test_toxicity(spark, docs, empty):
    rows = [(i, ("good words here " if i % 3 else "vile words here ") + f"n{i % 50}", int(i % 3 == 0)) for i in range(900)]
    known = spark.createDataFrame([*rows, (1000, None, 0), (None, "vile", 1), (1001, "vile", None)], "doc_id long, text string, label int")
    model = train_toxicity(known)
    scored = {r.doc_id: r.s for r in spark.createDataFrame([(1, "so Vile!"), (2, "so good"), (3, None), (4, "")], "doc_id long, text string")
              .select("doc_id", toxicity(spark, model).alias("s")).collect()}
    assert scored[1] > 0.5 > scored[2] and scored[3] == scored[4] and all(0 <= s <= 1 for s in scored.values())
    kept = drop_toxic(docs, model)
    rated = docs.select(toxicity(spark, model).alias("s"))
    assert kept.columns == docs.columns and kept.count() == rated.filter("s < 0.5").count() and no_rows(drop_toxic(empty, model))
    none = train_toxicity(known.limit(0))
    assert docs.select(toxicity(spark, none).alias("s")).distinct().collect()[0].s == 0.5


def test_toxicity_sees_pairs_with_two_words_between():
    from duelmark.llm import toxicity as tox

    begins, hashes = np.array([0, 4]), np.arange(1, 5, dtype=np.uint64)
    assert len(tox.features(begins, hashes, hashes)[0]) == 4 + 4 + 3 + 2 + 1
    assert tox.MOST_ROWS == 20_000


def test_quality(spark, docs, empty):
    rows = [(i, f"Fine prose with many words number {i} here." if i % 4 else "SPAM!! " * 9, int(i % 4 != 0)) for i in range(400)]
    model = train_quality(spark.createDataFrame([*rows, (1000, None, 1), (1001, "x", None)], "doc_id long, text string, label int"))
    test = spark.createDataFrame([(1, "Other prose with plain words."), (2, "BUY!! " * 20)], "doc_id long, text string")
    scored = {r.doc_id: r.s for r in test.select("doc_id", quality(spark, model).alias("s")).collect()}
    assert scored[1] >= 0.7 > scored[2]
    assert all(0 <= r.s <= 1 for r in docs.select(quality(spark, model).alias("s")).collect())
    one_label = train_quality(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, text string, label int"))
    nothing = train_quality(spark.createDataFrame([], "doc_id long, text string, label int"))
    for m in (one_label, nothing):
        assert docs.select(quality(spark, m).alias("s")).distinct().count() == 1
    assert no_rows(empty.select(quality(spark, model).alias("s")))


def test_language_model(docs, empty):
    import math
    from collections import Counter

    got = score_texts(docs, F.col("doc_id") == 8).collect()
    tokens = [((t or "").encode().lower().split() + [None], i == 8) for i, t in ROWS]
    count = Counter(w for words, held in tokens if not held for w in words)
    n, v = sum(count.values()), len(count)
    want = sorted((round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 4), len(words), sum(count[w] > 0 for w in words), held)
                  for words, held in tokens)
    assert sorted((round(r.base_score, 4), r.n_tokens, r.n_known, r.held_out) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert no_rows(score_texts(empty, F.lit(False)))
    untrained = score_texts(docs, F.lit(True)).collect()
    assert len(untrained) == len(ROWS) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in untrained)


def test_language_model_keeps_all_counts_beyond_a_broadcast(spark, docs, monkeypatch):
    def scores():
        return sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.base_score, round(r.score, 9)) for r in score_texts(docs, F.col("doc_id") == 8).collect())

    whole = scores()
    monkeypatch.setattr(lm, "MOST_FILTER_BITS", 1 << 12)      # less than the n-grams that occur once need
    assert scores() == whole
    # the slices' answers and the texts' scores are written, so nothing works them out again
    plan = score_texts(docs, F.col("doc_id") == 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" not in plan and "FlatMapGroupsInPandas" not in plan


def test_main_text(spark):
    soup = """<html><head><title>t</title></head><body><div id="top" class="menu"><a href=x>Home</a></div><div class="cookie-notice">We use
      cookies</div><div class="layout"><div class="post-body post-17"><h2>Head</h2><p>First para &amp; more<p>Second &lt;b&gt;
      text<ul><li>one<li>two</ul><div class="ad-box">Buy now</div><script>var a="</p>"</script><form>Mail <input></form></div><div class=sidebar>
      Side</div></div><section id="comments"><p>I loved reading this, a long comment that goes on and on.</p></section><footer>(c)</footer>"""
    want = "Head First para & more Second <b> text one two"
    assert extract(soup, best_path(soup)) == want
    pages = spark.createDataFrame([(1, "http://a.example/1", soup), (2, "http://www.a.example/2", soup), (2, None, None), (3, "", ""), (None, "x", "plain &lt; text"),
                                   (4, "http://a.example/3", "<p" * 2000), (5, "http://b.example", "<div>" * 3000 + "deep" + "</div>" * 10)],
                                  "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract_main_text(pages).collect()))
    assert [g for g in got if g[0] in (1, 2)] == [(1, want, len(want)), (2, "", 0), (2, want, len(want))]
    assert (0, "plain < text", 12) in got and (5, "deep", 4) in got and len(got) == 7
    assert no_rows(extract_main_text(pages.limit(0)))


ARTICLE = "<h1>Head line</h1><p>" + "Plain words of the article. " * 12 + "</p><p>Its second part &amp; end.</p>"
ARTICLE_TEXT = "Head line " + ("Plain words of the article. " * 12).strip() + " Its second part & end."


@pytest.mark.parametrize("before, after", [
    ('<div class="layout has-sidebar">', "</div>"), ('<main class="content with-sidebar">', "</main>"), ('<article class="post tag-privacy category-social">', "</article>"),
    ('<section id="search-results">', "</section>"), ('<div class="page no-sidebar">', "</div>"), ('<form action="/"><div>', "</div></form>"),
    ('<div class="comment-enabled entry">', "</div>"), ('<main id="widget">', "</main>"), ('<form><div class="toolbar"><input>', "</div></form>"), ("<div>", "</div>")])
def test_wrappers_with_words_of_boilerplate_keep_the_article(before, after):
    around = ('<nav><a href="/">Home</a> <a href="/x">More</a></nav>{}<aside>Beside it</aside><div class="cookie-notice">We use cookies.</div>'
              '<div id="comments"><p>Some reader says a thing.</p></div><footer>(c) someone</footer>')
    page = f"<html><body>{around.format(before + ARTICLE + after)}</body></html>"
    assert extract(page, best_path(page)) == ARTICLE_TEXT


def test_long_comments_are_no_article():
    page = f"<body><article><h1>Short</h1><p>A short article.</p></article><section id='comments'>{'<p>A long comment of a reader.</p>' * 60}</section></body>"
    assert extract(page, best_path(page)) == "Short A short article."


def test_main_text_of_generated_pages(spark):
    """Pages built from known articles and known rest, against the articles."""
    rng = np.random.default_rng(4)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows, want = [], {}
    for k in range(60):
        paragraphs = [" ".join(rng.choice(words, rng.integers(20, 60))) + "." for _ in range(rng.integers(2, 6))]
        host = k % 3
        body = "".join(f"<p class='p{j}'>{p.replace('alpha', '<b>alpha</b>')}</p>" for j, p in enumerate(paragraphs))
        wrapped = [f"<article class='post-{k} tag-social'>{body}</article>", f"<div class='content no-sidebar' id='c{k}'>{body}</div>",
                   f"<form><div class='story-{k}'>{body}<script>x = '<p>no</p>'</script></div></form>"][host]
        rest = "<ul class='menu'>" + "".join(f"<li><a href='/{j}'>link {j}</a></li>" for j in range(9)) + "</ul>"
        page = f"<html><head><title>T{k}</title></head><body>{rest}<div class='wrap'>{wrapped}<div class='sidebar-box'>side</div></div><div class='related-posts'><p>{'other ' * 30}</p></div></body></html>"
        rows.append((k, f"http://h{host}.example/{k}", page, "x", 3))
        want[k] = " ".join(paragraphs)
    # columns with the names that the operator uses inside
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string, page int")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got == want


def test_archives(spark):
    rows = [(1, "http://a.example/x", "<p>same"), (2, "http://b.example/y z", "<p>same"), (2, "http://b.example/y z", "<p>same"), (3, "http://a.example/x", "<p>other"),
            (4, None, None), (5, "http://a.example/x#frag", ""), (None, "q", ""), (6, "http://c.example/", "x" * 300_000), (None, None, "alone\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = read_captures(write_archive(pages), pages.select(url_key("url").alias("key"))).collect()
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = sorted((i or 0, (h or "").encode(), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if (i or -1) == largest[h or ""] else "revisit", 0 if (i or -1) == largest[h or ""] else largest[h or ""]) for i, _, h in rows)
    assert sorted((r.page_id or 0, bytes(r.payload), r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == want
    some = read_captures(write_archive(pages), spark.createDataFrame([("example,a)/x",), ("no,such)/",)], "key string"))
    assert sorted(r.page_id for r in some.collect()) == [1, 3, 5]
    assert no_rows(read_captures(write_archive(pages.limit(0)), pages.select(url_key("url").alias("key"))))
    short = read_captures(write_archive(pages, least=100), pages.select(url_key("url").alias("key")))
    assert {r.record_type for r in short.collect()} == {"response"}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, form) in enumerate(PLAIN.items()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            odd = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and odd % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_private_data(spark, docs, empty):
    texts = ["a" * 3000, "1-" * 2000, "+1 " * 900, "1.1.1.1." * 300, "a@b.c+d@e.f+g@h.i " * 90, "😀x@y.z 😀 +1 (988) 555-2485 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4",
             "", None, "a.b@-.-.-@q.r 4041 8949 7460 8795, 4041894974608795! 1.2.3 .4 +12345678901234567890", "x@" * 900]
    texts += [f"please call me at +1 (988) 555-{1000 + i} today" for i in range(12)] + ["please call me at 555-2485 today", "we saw 555-2486 years"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = pii.find_private_data(df).select("doc_id", "base", pii.spans_text(F.col("base")).alias("text"), pii.spans_text(F.col("added")).alias("added"))
    for r in got.collect():
        want = plain_spans(texts[r.doc_id] or "")
        assert r.text == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.added == ("phone:18:26" if r.doc_id == len(texts) - 2 else "")
        assert all((texts[r.doc_id])[s.start:s.stop] == s.value for s in r.base)
    assert pii.find_private_data(docs).count() == len(ROWS) and no_rows(pii.find_private_data(empty))


def test_remainders_are_those_of_crc32(spark):
    from duelmark.llm.batches import remainder

    df = spark.createDataFrame([(7,), (123456,), (None,)], "doc_id long").select("doc_id", remainder("doc_id", 5).alias("r"))
    assert {r.doc_id: r.r for r in df.collect()} == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i in (7, 123456, None)}


def test_language_model_workers_hold_little():
    # bytes that a task holds: n-grams with their counts, and again when they are merged; words with their dictionary entries
    assert 4 * 16 * (lm.HELD_KEYS + lm.SLICE // 2) <= 160 << 20
    assert 250 * (lm.LEXICON + lm.FREQUENT) <= 64 << 20
