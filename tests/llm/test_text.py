"""Fingerprints, language, quality and HTML."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillmill.llm import html, langid, quality, queries, simhash


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


# --- fingerprints ----------------------------------------------------------------------------------------------------


def check_edits(rows, docs):
    """docs: (key, text) in descending order."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    prints = {t: p for t, p in zip([t for _, t in docs], simhash.hexed(simhash.fingerprints([t for _, t in docs])))}
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        r = next(x for x in by[k] if x["n_chars"] == len(t) and x["edited"] == edited)
        by[k].remove(r)
        assert r["fingerprint"] == prints[t] and r["edited_fingerprint"] == simhash.hexed(simhash.fingerprints([edited]))[0]
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / simhash.BITS
        assert r["near_edited"] == pytest.approx(bits(r["fingerprint"], r["edited_fingerprint"])) and r["near_next"] == pytest.approx(bits(prints[t], prints[after]))
    assert not any(by.values())


def test_op1(spark, small, none):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()), reverse=True)
    found = simhash.edited_likeness(spark.read.parquet(f"{small}/documents.parquet")).collect()
    check_edits(found, docs)
    assert np.mean([r["near_edited"] > r["near_next"] for r in found]) > 0.95
    got = {r["doc_id"]: r["edited_sha256"] for r in queries.op1_simhash(spark, small).collect()}
    assert got == {r["doc_id"]: hashlib.sha256(r["edited"].encode()).hexdigest() for r in found}
    assert simhash.edited_likeness(none).count() == 0


def test_edits_of_odd_rows(spark, odd):
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    check_edits(simhash.edited_likeness(odd).collect(), docs)
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert simhash.edited_likeness(one).head()["edited"] == "abcdab"


def test_fingerprints_by_brute_force():
    texts = ["a b c d e", "a b c d e", "A B c d E", "one", "", None, "x y z " * 9, "漢 字 é x"]
    prints = simhash.fingerprints(texts)
    assert (prints[0] == prints[2]).all() and (prints[0] == prints[1]).all() and not prints[4].any() and not prints[5].any()
    term, owner = simhash._term_hashes(texts)
    for k in range(len(texts)):
        votes, total = np.zeros(simhash.BITS), 0.0
        for h, n in zip(*np.unique(term[owner == k], return_counts=True)):
            both = np.array([h, simhash.vectext.mix(np.array([h]) + np.uint64(0x632BE59BD9B4E019))[0]], np.uint64)
            votes += (1 + np.log(n)) * np.unpackbits(both.view(np.uint8))
            total += 1 + np.log(n)
        assert (np.packbits(2 * votes > total + 1e-6) == prints[k]).all()


def test_near_pairs(spark):
    pick = random.Random(7)
    base = [pick.getrandbits(128) for _ in range(30)]
    values = {f"{b:032x}" for b in base}
    for b in base[:12]:
        for flips in (1, 3, 6, 7):
            for bit in pick.sample(range(128), flips):
                b ^= 1 << bit
            values.add(f"{b:032x}")
    df = spark.createDataFrame([(v,) for v in sorted(values)] * 2 + [(None,)], "fingerprint string")
    got = {(r["a"], r["b"], r["bits"]) for r in simhash.near_pairs(df, radius=6).collect()}
    ordered = sorted(values)
    want = {(a, b, n) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (n := bin(int(a, 16) ^ int(b, 16)).count("1")) <= 6}
    assert got == want and len(want) >= 12
    prints = simhash.with_fingerprint(spark.createDataFrame([("a b c d",), (None,)], "text string")).collect()
    assert prints[1]["fingerprint"] == "0" * 32 and len(prints[0]["fingerprint"]) == 32


def test_near_pairs_of_near_copies(spark, small):
    def terms(words):
        return {tuple(words[k : k + simhash.TERM]) for k in range(len(words) - simhash.TERM + 1)}

    pick = random.Random(11)
    texts, copies = [], []
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id IS NOT NULL AND text IS NOT NULL").orderBy("doc_id")
    for r in docs.limit(60).collect():
        words = r["text"].lower().split()
        if len(terms(words)) < 80:
            continue
        # from a place on, words are others: as many as leave a likeness of 0.8 at least
        cut = len(words) // 12
        at = pick.randrange(len(words) - cut)
        other = words[:at] + [f"new{pick.randrange(10**6)}" for _ in range(cut)] + words[at + cut :]
        a, b = terms(words), terms(other)
        if 0.8 <= len(a & b) / len(a | b) <= 0.9:
            texts += [" ".join(words), " ".join(other)]
            copies.append((len(texts) - 2, len(texts) - 1))
    prints = simhash.hexed(simhash.fingerprints(texts))
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(df).collect()}
    radius, ordered = simhash.radius_of(0.8), sorted(set(prints))
    assert got == {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if bin(int(a, 16) ^ int(b, 16)).count("1") <= radius}
    assert len(copies) >= 15 and np.mean([prints[a] == prints[b] or tuple(sorted((prints[a], prints[b]))) in got for a, b in copies]) > 0.9


# --- language --------------------------------------------------------------------------------------------------------


def test_op4(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op4_language(spark, path).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(2)
    scores = -rng.integers(0, 9, (40, 3)).astype(np.float32)
    rows = [rng.integers(0, 40, n) for n in (0, 1, 7, 7, 5)]

    def cost(path, row):
        return sum(float(scores[r, s]) for r, s in zip(row, path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))

    from itertools import product

    for row, path in zip(rows, langid.viterbi(rows, scores)):
        assert len(path) == len(row)
        assert cost(path.tolist(), row) == max(cost(p, row) for p in product(range(3), repeat=len(row)))


def test_viterbi_of_many_languages():
    rng = np.random.default_rng(3)
    scores = -rng.random((500, 200)).astype(np.float32) * 20
    scores[:, 180] += 15  # often the winner, so that its number has to come back whole
    rows = [rng.integers(0, 500, n) for n in (60, 0, 3, 41)]
    for row, path in zip(rows, langid.viterbi(rows, scores)):
        value = np.zeros(200)
        for r in row:
            value = np.maximum(value, value.max() - langid.SWITCH) + scores[r]
        got = sum(float(scores[r, s]) for r, s in zip(row, path.tolist())) - langid.SWITCH * int((path[1:] != path[:-1]).sum())
        assert len(path) == len(row) and abs(got - value.max()) < 1e-3 and (not len(row) or path.max() >= 128)


def test_spans_and_odd_rows(spark, odd, none):
    words = {"en": "the of and thing with house other", "de": "der und nicht schön über straße ein", "ru": "и в не на что он быть"}
    train = spark.createDataFrame([(" ".join(random.Random(k).choices(w.split(), k=30)), lang) for lang, w in words.items() for k in range(20)] + [(None, "en"), ("x", None)], "text string, lang string")
    model = langid.train(train)
    assert model.languages == ("de", "en", "ru")
    mixed = "the house of the other thing and the house with the other " * 3 + "und nicht über der straße ein schön und nicht der straße " * 3 + "и в не на что он быть и что на"
    df = spark.createDataFrame([(mixed,), (None,), ("",), ("123 !?",), ("́",)], "text string")
    rows = [r["language"] for r in langid.with_spans(df, model).collect()]
    assert [s["lang"] for s in rows[0]["spans"]] == ["en", "de", "ru"] and rows[0]["lang"] == "de" and 0.3 < rows[0]["score"] < 0.6
    assert all(r["lang"] == "und" and r["score"] == 0 and r["spans"] == [] for r in rows[1:])
    found = langid.with_spans(odd, langid.train(odd), out="id")
    assert found.count() == odd.count() and found.columns == odd.columns
    empty = langid.train(none)
    assert empty.languages == () and {r["language"]["lang"] for r in langid.with_spans(odd, empty).collect()} == {"und"}
    assert langid.with_spans(none, model).count() == 0


def test_training_sample_is_of_distinct_texts(spark):
    rows = [("the copied text of this house", "en")] * 500 + [(f"the other text number {chr(97 + k % 26)}{chr(97 + k // 26)} with thing", "en") for k in range(60)]
    rows += [("der und nicht schön", "de")] * 300 + [("ein haus über straße", "de")] * 300
    once = langid.train(spark.createDataFrame(sorted(set(rows)), "text string, lang string"), sample=5)
    assert langid.train(spark.createDataFrame(rows, "text string, lang string"), sample=5).digest() == once.digest()
    for sample in (1, 5):
        model = langid.train(spark.createDataFrame(rows, "text string, lang string"), sample=sample)
        assert model.languages == ("de", "en") and model.writes[1].all()
        # n-grams counted: of as many texts as the bound allows, at most
        counted = np.exp(-model.levels[0]) - (1 << langid.BUCKET_BITS)
        lengths = {lang: sorted(len(langid.ngram_buckets(t.split())[0]) for t, x in set(rows) if x == lang)[-sample:] for lang in model.languages}
        assert 0 < counted[0] <= sum(lengths["de"]) + 0.5 and 0 < counted[1] <= sum(lengths["en"]) + 0.5


def test_texts_of_no_learned_language_are_rejected(spark, small):
    import corpus_pipeline

    pick = random.Random(3)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    gibberish = " ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60))
    extra = [(10**9, gibberish, None), (10**9 + 1, "и в не на что он быть с как это по но они мы этот который " * 4, None), (10**9 + 2, "".join(chr(pick.randint(0x4E00, 0x9FFF)) for _ in range(200)), None)]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(spark.createDataFrame(extra, docs.schema)), small).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


# --- quality ---------------------------------------------------------------------------------------------------------


def test_op5(spark):
    path = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = queries.op5_quality(spark, path).collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    seen = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = np.array([s for s, y in seen if y]), np.array([s for s, y in seen if not y])
    assert np.mean(good[:, None] > bad[None, :]) > 0.98 and np.mean(good >= 0.3) > 0.97 and np.mean(bad < 0.3) > 0.7


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (8, 1), (3, None), (None, 1), (99, 0)], "doc_id long, quality int")
    for model in (quality.train(odd, labels), quality.train(none, labels), quality.train(odd, labels.where("quality = 1")), quality.train(odd, labels.where("false"))):
        rows = quality.with_score(odd, model, out="n").collect()
        assert len(rows) == odd.count() and all(0 <= r["n"] <= 1 for r in rows)
        assert len({r["n"] for r in rows if not r["text"]}) == 1
    assert quality.with_score(none, model).count() == 0


def test_dictionaries_see_whole_texts(spark, monkeypatch):
    given = []
    monkeypatch.setattr(quality, "_dictionary", lambda pieces: given.append(pieces) or b"".join(pieces)[:1000])
    texts = [" ".join(f"{side}{k}" for k in range(9000)) for side in "abcd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quality.train(docs, spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int"))
    assert len(given) == 2 and all(b"".join(p).decode() in texts for p in given)
    # contradictory labels count in both classes, and rows that repeat a key count each
    given.clear()
    both = spark.createDataFrame([(k, y) for k in range(4) for y in (0, 1)] * 2, "doc_id long, quality int")
    quality.train(docs.union(docs), both)
    assert len(given) == 2 and sorted(given[0]) == sorted(given[1]) and sum(map(len, given[0])) == 2 * sum(len(t.encode()) for t in texts if any(p[:40] == t.encode()[:40] for p in given[0]))


# --- html ------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<body><nav><a href=x>menu</a></nav><article><h1>T &amp; x</h1><p>a<b>b</b> c&nbsp;d<br>e<p>f<ul><li>x<li>y</ul></article><footer>foot</footer>", "T & x\nab c d e\nf\nx\ny"),
    ("<article><p>one<script>var t='</p>';</script> two<style>p{}</style></p><!-- <p>no</p> --><form>q<input></form></article>", "one two"),
    ("<div class='cookie-notice'>we use</div><main><p>text</p><aside>side</aside><div class=comments><p>hi</p></div></main>", "text"),
    ("<article><header><h1>head</h1><span>by me</span></header><p>p</p><section id='comments'>c</section></article>", "head\np"),
    ("<div><a href=x>menu</a> <a>two</a></div><div>Real <a>content</a> here</div>", "Real content here"),
    ("<div class='content with-sidebar'><article class='post sidebar-right'><div class='post-header'><h1>T</h1><i>x</i></div><p>t</div><div class=sidebar>s</div>", "T\nt"),
    ("<div id=comments><article class=comment-body>c</article></div><article>a<div class='related-posts wrapper'>r</div></article>", "a"),
    ("<table><tr><td>1<td>2</tr><tr><td>3</table>", "1 2\n3"),
    ("plain <b>te</b>xt &lt;tag&gt; &#233; &eacute;", "plain text <tag> é é"),
    ("<p>open <!-- never closed <p>gone", "open"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_page(page, want):
    assert html.extract_group([page])[0] == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h2 id='search-results'>Results</h2><section id='discussion'><p>We discuss</p></section><section id=related-work>Others</section><p id='notice-period'>One month<ul><li id=menu-3>item</ul></article>", "Results\nWe discuss\nOthers\nOne month\nitem"),
        ("<main><div class='row with-sidebar'><h1>T</h1><p>text</p><div class=sidebar>s</div></div></main>", "T\ntext"),
        ("<main><div class='sidebar-layout'><p>text</p></div></main>", "text"),
        ("<article><p>long text<div class='row no-ads'>short</div><div class='ad-container'>buy</div></article>", "long text\nshort"),
        ("<article><p>text<div class=discussion><p>We <a href=x>found</a> that it holds</div><div class=share>Share: <a>one site</a> <a>another site</a></div></article>", "text\nWe found that it holds"),
        ("<body><h2 id=search-results>Results</h2><p>text</p><section id=discussion>We discuss</section></body>", "Results\ntext\nWe discuss"),
        ("<main><section id=discussion><article>text</article></section></main>", "text"),
        ("<article><p>a<section id=comments>c</section><div class='share-buttons'>x</div><div role=search>q</div><div class='row related-posts'>r</div></article>", "a"),
    ],
)
def test_names_of_parts_of_articles(page, want):
    assert html.extract_group([page])[0] == want


def test_template_of_a_host():
    page = lambda k: f"<body><div>Welcome to the site</div><div class=x>Story {k}</div><p>Text {k} of many</p><div>All rights</div></body>"
    for n in (2, 3, 8):
        found = html.extract_group([page(k) for k in range(n)])
        assert found[1] == "Story 1\nText 1 of many" and found[1] != html.extract_group([page(k) for k in range(n)], aligned=False)[1]
    assert html.extract_group([page(0)])[0].startswith("Welcome") and html.extract_group([page(0)] * 9)[0].startswith("Welcome")


@pytest.mark.parametrize("n", [1, 4, 6, 499, 501])
def test_what_articles_share_is_no_template(n):
    own = lambda k: [f"Dish number {k}", "Ingredients", f"Take {k} eggs and {k * 3} onions.", "Method", f"Boil for {k} minutes and {k * 7} seconds.", "Enjoy your meal!"]
    body = lambda k: "<h1>{}</h1><h2>{}</h2><p>{}</p><h2>{}</h2><p>{}</p><p>{}</p>".format(*own(k))
    article = lambda k: f"<body><nav>x</nav><article>{body(k)}</article><footer>f</footer></body>"
    bare = lambda k: f"<body><div class=top>Our site</div><div class=text>{body(k)}</div><div class=end>Imprint of the house</div></body>"
    assert html.extract_group([article(k) for k in range(n)]) == ["\n".join(own(k)) for k in range(n)]
    # without an article, the alignment finds what holds the varying text, as soon as there are two pages
    around = ([], []) if n > 1 else (["Our site"], ["Imprint of the house"])
    assert html.extract_group([bare(k) for k in range(n)]) == ["\n".join([*around[0], *own(k), *around[1]]) for k in range(n)]


@pytest.mark.parametrize("n", [2, 5, 501])
def test_pages_that_mark_an_article_are_aligned(n):
    # of several articles, one that all pages of the host have is none; alone on a page, it stays
    about = "<article class=about><h3>The house</h3><p>We bake since 1900.</p></article>"
    story = lambda k: f"<article class=story><h1>Story {k}</h1><h2>Shared heading</h2><p>Text {k} of many.</p></article>"
    own = lambda k: f"Story {k}\nShared heading\nText {k} of many."
    house = "The house\nWe bake since 1900."
    pages = [f"<body><div class=top>Our site</div>{about}{story(k)}</body>" for k in range(n)]
    assert html.extract_group(pages) == [own(k) for k in range(n)]
    assert html.extract_group(pages, aligned=False) == [f"{house}\n{own(k)}" for k in range(n)]
    assert html.extract_group([*pages, f"<body>{about}</body>"])[-1] == house
    assert html.extract_group(pages[:1] * 3) == [f"{house}\n{own(0)}"] * 3
    # a single page without an article loses nothing of its own
    *others, last = html.extract_group([*pages, "<body><div class=top>Our site</div><div class=text>Another page</div></body>"])
    assert others == [own(k) for k in range(n)] and last.endswith("Another page")


def test_references_end_with_their_run():
    page = "<article><p>R&<b>lt; x</b></p><p>a&<i>copy; b</i></p><p>a &lt; b&amp;lt; c</p></article>"
    assert html.extract_group([page]) == ["R&lt; x\na&copy; b\na < b&lt; c"]


def test_copies_are_no_template():
    copy = lambda k: f"<body><div>Site</div><script>track({k})</script><article><h1>Same</h1><p>Copied text</p></article></body>"
    other = lambda k: f"<body><div>Site</div><article><h1>Other {k}</h1><p>By us</p><p>Own text {k}</p></article></body>"
    found = html.extract_group([copy(k) for k in range(92)] + [other(k) for k in range(8)])
    assert found == ["Same\nCopied text"] * 92 + [f"Other {k}\nBy us\nOwn text {k}" for k in range(8)]
    # what articles share stays, and so does what one of them says instead
    page = lambda k, foot: f"<article><h1>Story {k}</h1><div>{foot}</div></article>"
    found = html.extract_group([page(k, "All rights") for k in range(20)] + [page(20, "Corrected"), "<article><div>All rights</div></article>"])
    assert found[3] == "Story 3\nAll rights" and found[20:] == ["Story 20\nCorrected", "All rights"]


def test_alignment_by_brute_force(monkeypatch):
    pick = random.Random(4)

    def tree(depth):
        return (pick.choice("ab"), tuple(tree(depth - 1) for _ in range(pick.randint(0, 2))) if depth else ())

    def best(a, b):
        if a[0] != b[0]:
            return 0

        def children(x, y):
            if not x or not y:
                return 0
            return max(children(x[1:], y), children(x, y[1:]), best(x[0], y[0]) + children(x[1:], y[1:]))

        return 1 + children(a[1], b[1])

    def known(shapes, x):
        return shapes.shape(x[0], tuple(known(shapes, c) for c in x[1]))

    def preorder(x):
        return [x[0]] + [label for c in x[1] for label in preorder(c)]

    for k in range(200):
        a, b = tree(3), tree(3)
        shapes = html.Shapes()
        monkeypatch.setattr(html, "CELLS", (1 << 20, 1, 4)[k % 3])  # long sequences are halved
        found = shapes.align(known(shapes, a), known(shapes, b))
        places = [p for p in found if p is not None]
        assert len(places) == len(set(places)) == best(a, b) and places == sorted(places)
        assert all(p is None or preorder(b)[p] == label for p, label in zip(found, preorder(a), strict=True))


def test_deep_wide_and_mirrored_pages():
    deep = lambda k: "<div>" * (5000 + k) + f"text {k}" + "</div>" * 5000
    assert html.extract_group([deep(k) for k in range(6)]) == [f"text {k}" for k in range(6)]
    lists = lambda k: "<ul><li>" * 3000 + f"item {k}"
    assert html.extract_group([lists(k) for k in range(6)]) == [f"item {k}" for k in range(6)]
    # the same parts in another order at both ends, so that nothing is equal from the start
    wide = lambda k: "<article>" + f"<ul><li>first {k}</ul>" * (k % 2) + "".join(f"<h2>head {n}</h2><p>text {n} of {k}</p>" for n in range(5000 - k)) + f"<ol><li>last {k}</ol>" * (k % 3) + "</article>"
    for k, found in enumerate(html.extract_group([wide(k) for k in range(6)])):
        want = [f"first {k}"] * (k % 2) + [x for n in range(5000 - k) for x in (f"head {n}", f"text {n} of {k}")] + [f"last {k}"] * (k % 3)
        assert found == "\n".join(want)
    # pages of one article that differ beside it, of whatever number
    mirror = lambda k: f"<body><nav>menu</nav><article><h1>Same title</h1><p>Same body text.</p></article><div class=comments>comment {k}</div><script>token({k})</script></body>"
    for n in (1, 4, 5, 8, 50):
        assert html.extract_group([mirror(k) for k in range(n)]) == ["Same title\nSame body text."] * n


def test_op3(spark, small, none):
    import re
    from html import unescape

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op3_html(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r["page_id"]]
        body = page["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"]) and r["url"] == page["url"]
    schema = "page_id long, url string, html string, k string, u string, host string, salt int"
    odd = spark.createDataFrame([(1, "http://a/x", "<p>x", "", "", "", 1), (1, "http://a/x", "<p>x", "", "", "", 1), (None, None, None, "", "", "", 1), (2, "::", "", "", "", "", 1), (3, "http://a", "<p>" + "long " * 50_000, "", "", "", 1)], schema)
    assert sorted((r["page_id"] or 0, r["text"][:4]) for r in html.with_main_text(odd).collect()) == [(0, ""), (1, "x"), (1, "x"), (2, ""), (3, "long")]
    assert html.with_main_text(odd.limit(0)).count() == 0
