import re

import pytest

from cartaspark.llm import decontaminate as D, htmltext as H, licences as I
from cartaspark.llm.queries import op4_html_extraction, op8_license_scans, op10_benchmark_decontamination

ITEM = " ".join(f"tok{i}" for i in range(40))


def test_decontamination_edge_cases(spark, make_docs):
    substituted = ITEM.split()
    for i in (7, 15, 22):
        substituted[i] = "other"
    docs = make_docs([(1, "lead in " + ITEM.upper() + ", tail"), (2, " ".join(substituted)), (3, "tok1 tok2 nothing else"), (4, None), (5, ""), (6, "filler " * 40000 + ITEM), (7, " ".join(ITEM.split()[10:30])), (8, "a b c d e f g h i j k l m n")])
    items = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "y"), (2, None, ""), (3, "", ""), (4, "short item", ""), (5, "nine words make a short item that still counts", "")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_equal"]) for r in D.find_overlaps(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 1), (7, 1)}
    assert got[1, 1] == (40, 40) and got[2, 1] == (40, 37) and got[7, 1] == (20, 20)
    assert sorted(r["doc_id"] for r in D.decontaminate(docs, items).collect()) == [3, 4, 5, 8]
    assert {tuple(r) for r in D.find_overlaps(docs, items, block_chars=50).collect()} == {tuple(r) for r in D.find_overlaps(docs, items).collect()}
    assert D.find_overlaps(make_docs([]), items).collect() == D.find_overlaps(docs, items.limit(0)).collect() == []


def test_rows_and_items_without_id_and_with_one_id(spark, make_docs):
    from cartaspark.llm import decontaminate

    item = " ".join(f"w{i}" for i in range(20))
    docs = make_docs([(None, f"x {item} y"), (2, "a clean text"), (2, f"{item} z"), (None, "clean too"), (3, "words of no item"), (4, f"{item} z")])
    bench = spark.createDataFrame([(None, item), (None, None), (7, "another item that nobody holds at all here")], "item_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.decontaminate(docs, bench).collect())
    assert kept == [(0, "clean too"), (2, "a clean text"), (3, "words of no item")]
    found = sorted((r["doc_id"] or 0, r["item_id"], r["n_equal"]) for r in decontaminate.find_overlaps(docs, bench).collect())
    assert found == [(0, None, 20), (2, None, 20), (4, None, 20)]


def test_short_items(spark, make_docs):
    items = spark.createDataFrame([(5, "nine words make a short item that still counts")], "item_id long, text string")
    docs = make_docs([(1, "so nine words make a short item that still counts!"), (2, "nine words make a short list")])
    assert [r["doc_id"] for r in D.find_overlaps(docs, items).collect()] == [1]


def test_upper_cased_accented_passages(spark, make_docs):
    item = "la acción más fácil será también útil según él año über straße fünf größe müde école déjà où très"
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    docs = make_docs([(1, f"Antes. {item.upper()}. Después."), (2, item.title()), (3, re.sub("[áéíóú]", "x", item))])
    got = {r["doc_id"]: r["n_equal"] for r in D.find_overlaps(docs, items).collect()}
    assert got == {1: 19, 2: 19}


def test_every_overlap_within_the_bound_is_found(spark, make_docs):
    import random

    rng = random.Random(4)
    items = {n: [f"i{n}t{k}" for k in range(n)] for n in (8, 10, 15, 17, 40)}
    rows, want = [], {}

    def add(n, gone):
        words = ["other" if k in gone else w for k, w in enumerate(items[n])]
        # the rule by brute force: the most equal tokens of a stretch with three quarters equal
        most = max((sum(k not in gone for k in range(a, b)) for a in range(n) for b in range(a + 1, n + 1) if 4 * sum(k in gone for k in range(a, b)) <= b - a), default=0)
        if most >= min(13, -(-4 * n // 5)):
            want[len(rows), n] = most
        rows.append((len(rows), "lead in " + " ".join(words) + " tail"))

    add(15, {2, 12})
    add(40, set(range(3, 40, 4)))
    assert want == {(0, 15): 13, (1, 40): 30}
    for k in range(8):
        add(8, {k})
    assert len(want) == 10
    for n in items:
        for _ in range(300):
            add(n, set(rng.sample(range(n), rng.randrange(n // 3 + 1))))
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): r["n_equal"] for r in D.find_overlaps(make_docs(rows), table).collect()} == want


def test_hits_in_small_runs(spark):
    data = ["a b c d e f g h i j k l m n o p", "c d e f g h a b c d e f g h i j k l m n x", "", "a b"]
    hashes, _, _, first = D.words(*D.utf8(D._folded(D.pa.array(data))), D.ASCII_MARK)
    seeds = D.SeedTable([(7, data[0]), (8, ""), (9, data[0][:23])], D.MASKS, 8)
    whole = list(seeds.overlaps(hashes, first, 13))
    assert whole and whole == list(seeds.overlaps(hashes, first, 13, most=3))


def test_decontamination_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    items = {r[0]: re.findall(r"[^\W_]+", r[1].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()}
    docs = [(r[0], " " + " ".join(re.findall(r"[^\W_]+", r[1].lower())) + " ") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    whole = {(d, i) for i, w in items.items() for d, t in docs if f" {' '.join(w)} " in t}
    got = {(r[0], r[1]) for r in op10_benchmark_decontamination(spark, sf).select("doc_id", "item_id").collect()}
    assert whole and whole <= got
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in items.items()}
    text = dict(docs)
    for d, i in got - whole:
        w = text[d].split()
        assert len(grams[i] & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) >= 3


def test_licence_rules(make_docs):
    mit = I.SENTENCES
    full = f"The MIT License\n\nCopyright (c) 2020 Someone\n\n{mit['mit-grant']}:\n\n{mit['mit-notice']}.\n\n{mit['mit-asis']}."
    wrapped = re.sub(r" ", "\n", I.SENTENCES["apache2-notice"], count=3)
    docs = make_docs([(1, "Prose here.\nLicensed under the Apache License, Version 2.0."), (2, full), (3, f"prose {wrapped}."), (4, f"Text. {wrapped}."), (5, None), (6, ""), (7, "we are licensed under the MIT license of old"), (8, "x " * 100000 + "\nReleased under the MIT License."), (9, f"{mit['mit-notice']}. {mit['mit-grant']}.")])
    got = {}
    for r in I.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["licence"], r["rule"], r["n_sentences"]))
    assert got == {1: [("Apache-2.0", "notice", 1)], 2: [("MIT", "titled-text", 4)], 4: [("Apache-2.0", "notice", 1)], 8: [("MIT", "released", 1)]}
    assert I.scan(make_docs([])).collect() == []


def test_licence_spans_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    text = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {(r["doc_id"], r["start"]): text[r["doc_id"]][r["start"] : r["end"]] for r in op8_license_scans(spark, sf).collect()}
    lines = ("Licensed under CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3", "Licensed under the Apache License, Version 2.0", "Released under the MIT License", "All rights reserved")
    want = {(d, m.start()): m[0] for d, t in text.items() for s in lines for m in re.finditer(rf"(?:^|(?<=[\n.!?;:])|(?<=[\n.!?;:] )){re.escape(s)}(?=[\s]*[.!?;:,(\n]|\s*\Z)", t)}
    assert want and got == want


def longest(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(row[-1], rows[-1][j + 1]))
        rows.append(row)
    return rows[-1][-1]


@pytest.mark.parametrize("cells", [1 << 26, 8])
def test_shared_lines_are_a_longest_common_subsequence(cells):
    import random

    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        kept = H.shared_lines(a, b, cells)
        picked = [x for x, k in zip(a, kept, strict=True) if k]
        at = iter(b)
        assert len(picked) == longest(a, b) and all(x in at for x in picked)


def test_blocks():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site</header><nav><a>Menu</a></nav>
    <div class="cookie-notice">Cookies</div><article><header><h1>A &amp;  B</h1></header><p>One<br>two <b>three</b><p>Four &eacute;<ul><li>x<li>y</ul>
    <div class="comments">Nice</div><form><input><p>Mail</p></form></article><aside>Side</aside><div>loose</div><!-- gone --><footer>End</footer>"""
    assert [b for b in H.blocks(page) if b[1]] == [("A & B", 2), ("One two three", 2), ("Four é", 2), ("x", 2), ("y", 2), ("loose", 1)]
    assert H.blocks("plain &lt;text&gt;\n here") == [("plain <text> here", 1)]
    assert H.blocks("<p>open <b>tag<p>next") == [("open tag", 1), ("next", 1)]
    assert H.blocks("") == H.blocks("<script>x") == []


def test_names_inside_articles():
    page = """<div class="page-header">Site</div><article><header class="entry-header"><h1>Title</h1></header><h2 id="comments">On comments</h2>
    <section id="related-work"><p>Others</p></section><div class="social-history">Life</div><div class="menu-planning notice">Food</div><div class="text widget">More</div>
    <div class="ad">Buy</div><div class="box Comments-area">Nice</div><div id="comments">Me too</div><ul class="share-buttons"><li>Post</ul><p class="newsletter">Mail</p></article>
    <main><div class="header">Head</div><p class="advert">Buy</p></main><div class="social-history">Links</div>"""
    assert [t for t, k in H.blocks(page) if k] == ["Title", "On comments", "Others", "Life", "Food", "More", "Head"]
    assert {k for _, k in H.blocks(page)} <= {H.MAIN, H.CHROME_KIND}


def test_differencing_decides_undecided_blocks(spark):
    page = lambda body: f"<div>Template line</div><p>{body}</p><div>Imprint of the site</div>"
    rows = [(i, f"http://h.example/a/{i}?q=1", page(f"body {i}"), "clash", 1) for i in range(9)]
    rows += [(20, "http://h.example/a/4x", page("body 4"), "", 1), (21, "http://alone.example/", page("alone"), "", 1), (22, None, page("no url"), "", 1), (23, "http://h.example/z", None, "", 1), (24, "http://h.example/zz", "", "", 1), (25, "http://h.example/a/5", page("body 5"), "", 1)]
    rows += [(30 + i, f"http://g.example/{i}", f"<article><p>same</p><p>{i}</p></article><div>same</div>", "", 1) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, row long")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert [got[i] for i in range(4)] == [f"body {i}" for i in range(4)]
    assert got[21] == "Template line\nalone\nImprint of the site" and got[22] == "Template line\nno url\nImprint of the site"
    assert got[23] == got[24] == ""
    assert got[30] == "same\n0" and got[32] == "same\n2"
    assert H.extract(pages.limit(0)).collect() == []


def test_article_text_of_all_small_pages(spark):
    import html

    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op4_html_extraction(spark, sf).collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]] == (want, len(want))


def test_short_items_match_whole_and_exactly(spark, make_docs):
    items = spark.createDataFrame([(1, "Three odd words"), (2, "zyx"), (3, "..."), (4, None), (5, "six tokens are in this item")], "item_id long, text string")
    docs = make_docs([(1, "here: three ODD words!"), (2, "three odd other words"), (3, "a zyx b"), (4, "six tokens are in this item"), (5, "six tokens are not this item"), (None, "zyx")])
    got = {(r["doc_id"], r["item_id"], r["n_equal"]) for r in D.find_overlaps(docs, items).collect()}
    assert got == {(1, 1, 3), (3, 2, 1), (4, 5, 6), (None, 2, 1)}
    assert sorted(r["doc_id"] or 0 for r in D.decontaminate(docs, items).collect()) == [0, 1, 2, 3, 5]


def test_blocks_of_the_benchmark_give_the_same(spark, make_docs):
    items = spark.createDataFrame([(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    docs = make_docs([(i, "pre " + " ".join(f"q{i}x{j}" for j in range(20))) for i in range(9)])
    whole = sorted(D.find_overlaps(docs, items).collect())
    assert len(whole) == 9 and sorted(D.find_overlaps(docs, items, block_chars=300).collect()) == whole


def test_chrome_by_name_inside_main_and_article():
    gone = ["cookie-notice", "cookie-banner", "notice", "ad-banner", "sidebar-left", "menu", "related-posts", "social-share", "reader-comments", "comment-thread", "commentlist", "adSlot-2", "user_comments", "SocialLinks"]
    kept = ["entry-header", "related-work", "social-history", "share price-list", "noticeable", "adaptation", "sidebars-of-law", "related", "content", "2"]
    for tag in ("main", "article"):
        got = [t for t, k in H.blocks(f"<{tag}>" + "".join(f"<div class='{c}'>{c}</div>" for c in gone + kept) + f"</{tag}>") if k]
        assert got == [c for c in kept if c != "share price-list"]  # a container goes by any of its classes
    assert [t for t, k in H.blocks("<article><div id='disqus_thread'>x</div><p id='comments'>y</p></article>") if k] == ["y"]
    formula = "<article><p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='application/x-tex'>x=1</annotation></semantics></math> holds</p></article>"
    assert [t for t, k in H.blocks(formula) if k] == ["so x=1 holds"]


def test_odd_markup():
    assert H.blocks("<p data-x=don't>two</p><p title='a > b'>three</p><p data-y=it's>four") == [("two", 1), ("three", 1), ("four", 1)]
    assert [t for t, k in H.blocks("<article><p class='share price'>a</p><section class='social-history'>b</section><p>c <button>buy</button> d</p><div class=ad>e</div></article>") if k] == ["a", "b", "c d"]
    import time

    for page in ("<b>" * 50000 + "x" + "</i>" * 50000, "<a " * 50000, "<p " + "x='" * 30000):
        start = time.time()
        H.blocks(page)
        assert time.time() - start < 5


def test_differencing_decides_plain_pages(spark):
    page = lambda i, own: f"<body><p>Site name<p>Menu<p>{own}<p>More of {i}<p>Imprint</body>"
    rows = [(i, f"http://h/{i:02d}", page(i, f"Story {i}")) for i in range(6)]
    rows += [(20 + k, f"http://h/03{k}", page(3, "Story 3")) for k in range(5)]  # copies of one page in a row
    rows += [(40, "http://lone/x", page(1, "Alone")), (41, None, page(2, "No URL")), (42, "http://h/0", None), (43, "http://h/0", "")]
    rows.append(rows[1])
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] in (42, 43):
            assert (r["text"], r["n_blocks"]) == ("", 0)
        elif r["page_id"] in (40, 41):
            assert r["text"].startswith("Site name") and r["n_shared"] == 0
        else:
            own = 3 if r["page_id"] >= 20 else r["page_id"]
            assert r["text"] == f"Story {own}\nMore of {own}" and (r["n_blocks"], r["n_shared"], r["n_overruled"]) == (5, 3, 0)


def test_differencing_takes_part_on_the_given_pages(spark):
    from pyspark.sql import functions as F

    found = op4_html_extraction(spark, "/root/testdata/sf0.01").agg(F.sum("n_blocks"), F.sum("n_shared"), F.sum("n_overruled")).first()
    assert 0 < found[1] < found[0] and found[2] < found[0]  # hardly a block of these pages comes again on the next


def brute_licences(text, sentences, rules, max_gap):
    """Every sentence tried at every word, every rule at every sentence."""
    import re

    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    mark = lambda gap, marks: any(c in marks for c in gap)
    gaps = [text[(words[i - 1][2] if i else 0) : words[i][1]] for i in range(len(words))] + [text[words[-1][2] :] if words else ""]
    known = {name: [w.lower() for w in re.findall(r"[^\W_]+|\*", s)] for name, s in sentences.items()}

    def ends(ws, at):
        if not ws:
            return {at}
        if ws[0] == "*":
            return {e for n in range(1, 17) if at + n <= len(words) for e in ends(ws[1:], at + n)}
        return ends(ws[1:], at + 1) if at < len(words) and words[at][0] == ws[0] else set()

    found, i = [], 0
    while i < len(words):
        fits = [(e - i, name) for name, ws in known.items() for e in (ends(ws, i) if words[i][0] == ws[0] else ()) if e == len(words) or mark(gaps[e], "\n.!?;:,(")]
        if fits and (i == 0 or mark(gaps[i], "\n.!?;:")):
            n = max(fits)[0]
            name = min(own for e, own in fits if e == n)
            found.append((name, i, i + n))
            i += n
        else:
            i += 1
    options = []
    for licence, rule, ids in rules:
        for start in range(len(found)):
            at, j = [start], start
            while len(at) < len(ids) and j + 1 < len(found):
                j += 1
                if found[j][1] - found[at[-1]][2] > max_gap:
                    break
                if found[j][0] == ids[len(at)]:
                    at.append(j)
            if found[start][0] == ids[0] and len(at) == len(ids):
                options.append((-len(ids), words[found[start][1]][1], licence, rule, words[found[at[-1]][2] - 1][2], at))
    taken, out = set(), []
    for n, start, licence, rule, end, at in sorted(options):
        if taken.isdisjoint(at):
            taken.update(at)
            out.append((licence, rule, start, end, -n))
    return sorted(out, key=lambda m: (m[2], m[3], m[0], m[1]))


HOLDERS = ["the copyright holder", "its contributors", "Example University", "the X Y Z Foundation, Inc. and A. N. Other", "THE REGENTS AND CONTRIBUTORS ``"]


def test_holders_and_products():
    from cartaspark.llm import licences

    scanner, s = licences.RuleSet(), licences.SENTENCES
    for holder in HOLDERS:
        for endorse in ("bsd-endorse", "bsd-endorse-author", "bsd-endorse-names"):
            text = ".\n".join(s[i].replace("*", holder) for i in ("bsd-redistribution", "bsd-source", "bsd-binary", endorse, "bsd-asis"))
            assert [(m[0], m[4]) for m in scanner.scan(text)] == [("BSD-3-Clause", 5)]
    two = ".\n".join(s[i].replace("*", "ACME") for i in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-asis"))
    assert [m[0] for m in scanner.scan(two)] == ["BSD-2-Clause"]
    for text, licence in (("Licensed under the Apache License 2.0.", "Apache-2.0"), ("This library is licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This software is distributed under the terms of the MIT license.", "MIT"), ("Distributed under the terms of the MIT license", "MIT")):
        assert [m[0] for m in scanner.scan(text)] == [licence]
    assert scanner.scan("Neither the name of " + "word " * 17 + "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.") == []


def test_licence_rules_against_brute_force():
    import random

    from cartaspark.llm import licences

    rng, names, scanner = random.Random(5), sorted(licences.SENTENCES), licences.RuleSet(max_gap=20)
    hits = 0
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            ids = list(rng.choice(licences.RULES)[2])
            if rng.random() < 0.3:
                rng.shuffle(ids)
            if rng.random() < 0.3:
                ids.insert(rng.randrange(len(ids) + 1), rng.choice(names))
            for name in ids:
                parts.append(rng.choice((str, str.upper))(licences.SENTENCES[name].replace("*", rng.choice(HOLDERS))).replace(" ", rng.choice((" ", "\n  "))))
                parts.append(" ".join(["filler"] * rng.choice((0, 0, 3, 19, 20, 21, 40))))
        text = rng.choice((". ", "\n", "; ")).join(parts)
        want = brute_licences(text, licences.SENTENCES, licences.RULES, 20)
        assert scanner.scan(text) == want, text
        hits += sum(m[4] > 1 for m in want)
    assert hits > 50


def test_every_licence_rule_is_found_in_its_own_sentences():
    from cartaspark.llm import licences

    scanner = licences.RuleSet()
    for licence, rule, ids in licences.RULES:
        found = scanner.scan("\n".join(f"{licences.SENTENCES[i].replace('*', 'some holder')}." for i in ids))
        assert [(m[0], m[1], m[4]) for m in found] == [(licence, rule, len(ids))]
    assert scanner.scan("SPDX-License-Identifier: MIT-1") == [] and scanner.scan("SPDX-License-Identifier: GPL-2.0-or-later\n")[0][0] == "GPL-2.0-or-later"


def test_licences_of_long_repeated_and_nameless_rows(make_docs):
    from cartaspark.llm import licences

    long = "filler words. " * 100_000 + "\nMIT License\n"
    got = licences.scan(make_docs([(1, long), (1, long), (None, "MIT License"), (2, None), (3, "")])).collect()
    assert sorted((str(r[0]), r[1], r[4] - r[3]) for r in got) == [("1", "MIT", 11), ("1", "MIT", 11), ("None", "MIT", 11)]
