"""Edge cases of the native and page operators: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import gzip
import hashlib
import html as entities
import itertools
import random
import textwrap
import tracemalloc
import zlib

import pytest
from docmill.llm import chat, html, licenses, urls, warc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LONG = "wörd " * 60_000


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Licences.


def test_licenses_whole_texts_and_lines(spark):
    mit = licenses._MIT
    rows = [
        (1, mit), (2, "Copyright (c) 2020 A. Holder\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "sublicense").replace(",", " ,")), (3, mit + " more"), (4, None), (5, ""), (6, LONG),
        (7, "words\nReleased under the MIT licence\nmore"), (1, mit), (None, "LICENSED UNDER CC BY-NC 4.0!\nlicensed under the Apache License, version 2.0"),
    ]
    docs = frame(spark, rows, "doc_id long, text string").withColumn("license_id", F.lit("clash")).withColumn("digest", F.lit(0)).withColumn("lines", F.lit(""))
    out = [(r["doc_id"], r["license_id"], r["n_license_lines"], r["line_license_ids"]) for r in licenses.scan_licenses(docs, licenses.known_licenses(spark)).collect()]
    assert sorted(out, key=str) == sorted(
        [(1, "MIT", 0, ""), (1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (7, None, 1, "MIT"), (None, None, 2, "Apache-2.0,CC-BY-NC-4.0")], key=str
    )
    assert licenses.scan_licenses(docs.limit(0), licenses.known_licenses(spark)).count() == 0


def test_canonical_spelling_twice_in_a_row(spark):
    row = frame(spark, [("Licence LICENCE\tcentre",)], "t string").select(licenses.canonical(F.col("t")).alias("c")).first()
    assert row["c"] == "license license center"


def test_canonical_forms_agree(spark):
    texts = [t for _, t in licenses.known_texts()] + ["Copyright Jane Doe\nx", "copyright notice and\nCopyright by ACME Corp. and Sons 2020\n(c) 2001\nCOPYRIGHT HOLDERS BE LIABLE\r\n# Copyright <year>", "a_b--c"]
    rows = frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", licenses.canonical(F.col("t")).alias("c")).collect()
    assert all(r["c"] == licenses.canonical_text(texts[r["i"]]) for r in rows)
    assert licenses.canonical_text(texts[-2]) == "copyright notice and copyright holders be liable" and licenses.canonical_text(texts[-3]) == "x"


def test_entire_texts_of_licences_under_other_headers(spark):
    names = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0", "Apache-2.0", "MPL-2.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC0-1.0", "GFDL-1.3", "Artistic-1.0-Perl"]
    wrapped = lambda t, n: "\n\n".join("\n".join(textwrap.wrap(p, n, break_on_hyphens=False)) for p in t.split("\n\n"))
    whole = {}
    for i, t in licenses.known_texts():
        whole.setdefault(i, t)
    heads = ["The MIT License", "The MIT License (MIT)", "MIT License"]
    rows = [(name, f"Copyright (c) 1999-2020 Jane Doe\r\n{'(c) 2001 x' if i % 2 else 'Copyright Jane Doe'}\nAll rights reserved.\n\n{whole[name]}") for i, name in enumerate(names)]
    rows += [("MIT", f"{h}\n\nCopyright Jane Doe and The Others\n\n{wrapped(licenses._MIT, n)}") for h in heads for n in (40, 60, 77)] + [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2001, A\n\n" + wrapped(dict(licenses.SHORT)["BSD-3-Clause"], 70))]
    rows += [(None, licenses._MIT.replace("free of charge", "for a fee")), (None, "The MIT License")]
    out = licenses.scan_licenses(frame(spark, [(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in out} == {i: name for i, (name, _) in enumerate(rows)}


def test_any_number_of_known_texts(spark, monkeypatch):
    known = [(f"L{i}", f"known text {'x' * (i % 300)} number {i}") for i in range(3000)]
    docs = frame(spark, [(i, f"Known text: {'x' * (i % 300)} number {i}" if i % 2 else f"a\nknown text {'X' * (i % 300)} number {i}!\nb\nnumber {i}") for i in range(0, 3000, 7)], "doc_id long, text string")
    table = licenses.known_licenses(spark, known)
    first = sorted(map(str, licenses.scan_licenses(docs, table).collect()))
    assert all((f"license_id='L" in r) != ("n_license_lines=0" not in r and "license_id=None" in r) for r in first) and len(first) == docs.count()
    assert sum("n_license_lines=1" in r for r in first) == len(first)
    monkeypatch.setattr(licenses, "LENGTHS", 10)
    monkeypatch.setattr(licenses, "sized", lambda df: df)
    assert sorted(map(str, licenses.scan_licenses(docs, table).collect())) == first


# Chat.

turns_strategy = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb%", ""]), st.text(alphabet="a<|\\im_start>/s[]INST \n%é", max_size=30)), min_size=1, max_size=6)


@settings(max_examples=15, deadline=None)
@given(conversations=st.lists(turns_strategy, min_size=1, max_size=8))
def test_chat_round_trip(spark, conversations):
    rows = [(i, j, role, text) for i, c in enumerate(conversations) for j, (role, text) in enumerate(c)]
    formatted = chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in formatted.select("conv_id", "formatted", "segments", chat.read_chats(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned")).collect()}
    for i, c in enumerate(conversations):
        assert [tuple(t) for t in got[i]["turns"]] == c
        assert got[i]["learned"] == "".join(t for r, t in c if r == "assistant")
        assert "".join(s["text"] for s in got[i]["segments"]) == got[i]["formatted"]
        assert got[i]["formatted"].count("<|im_start|>") == sum(j == 0 or c[j - 1][0] != c[j][0] for j in range(len(c)))


def test_chat_digests_of_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "hi"), (None, None, "user", "x"), (2, 1, "user", "same"), (2, 1, "user", "same"), (3, 1, "assistant", LONG)]
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1)))).collect()}
    assert out[1]["turns_sha256"] == hashlib.sha256(b"\nhi\nassistant\n\n").hexdigest() and out[1]["n_turns"] == 2 and out[1]["loss_chars"] == 0
    assert out[2]["n_turns"] == 2 and out[None]["n_turns"] == 1 and out[3]["loss_chars"] == len(LONG)
    alone = chat.digests(chat.format_chats(frame(spark, [(None, 1, "user", "x")] * 3 + [(None, 2, "assistant", "y")], "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r["n_turns"], r["loss_chars"]) for r in alone) == [(1, 0)] * 3 + [(1, 1)]
    assert chat.format_chats(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_control_strings_are_escaped(spark):
    text = chat.escape(F.lit("</s>[INST] ok [/INST] <|im_end|> <\\|"))
    row = spark.range(1).select(text.alias("e"), chat.unescape(text).alias("u")).first()
    assert row["u"] == "</s>[INST] ok [/INST] <|im_end|> <\\|"
    assert not any(c in row["e"] for c in ("</s>", "[INST]", "[/INST]", "<|"))


# HTML.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=/a>One</a><li>Two</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>{title} &amp; more</h1><p>First{n} <b>bold</b>
  text&nbsp;here &lt;tag&gt; &#233;<br>next<p>Second{n}<script>var x = "</p>";</script><div class="box">Subscribe to our list today</div><ul><li>item a<li>item b</ul>
<section id="comments"><p>reader says</p></section></article><aside>side</aside><form><input><p>fill</p></form><footer>&copy; end</footer></body>"""


def test_html_article_and_boilerplate(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(title=f"Title {i}", n=i)) for i in range(12)]
    rows += [(50, None, None), (51, "https://one.example/x", ""), (52, "https://one.example/y", "<p>plain &am text</p><nav>menu</nav>"), (53, "https://two.example/", "<article><p>" + LONG), (0, "https://h.example/0", rows[0][2])]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("template", F.lit("clash")).withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    # The box and the list say the same on every page of the host, and so are the site's.
    assert out[3]["text"] == "Title 3 & more\n\nFirst3 bold text here <tag> é next\n\nSecond3"
    assert (out[50]["text"], out[50]["n_chars"]) == ("", 0) and out[51]["text"] == ""
    assert out[52]["text"] == "plain &am text" and out[53]["text"] == LONG.strip()
    assert html.extract_pages(pages).count() == len(rows) and html.extract_pages(pages.limit(0)).count() == 0


def test_html_equal_pages_of_a_small_host_keep_their_text(spark):
    rows = [(i, "https://same.example/", "<article><p>the same</p></article>") for i in range(9)]
    assert {r["text"] for r in html.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()} == {"the same"}


@pytest.mark.parametrize("copies", [10, 1000])
def test_html_copies_keep_their_text(spark, copies):
    page = "<nav><a>menu</a></nav><article><h1>Title</h1><p>the same</p></article>"
    rows = [(i, "https://same.example/", page) for i in range(copies)]
    assert {r["text"] for r in html.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()} == {"Title\n\nthe same"}


def test_html_near_copies_keep_what_they_share(spark):
    shared = [f"A paragraph with the number {i} that all of them have." for i in range(8)]
    rows = [(i, "https://near.example/", "<div>site</div><article>" + "".join(f"<p>{p}</p>" for p in [f"Copy {i}", *shared]) + "</article>") for i in range(20)]
    rows += [(100 + i, "https://near.example/", rows[0][2]) for i in range(20)]
    rows += [(200 + i, "https://bare.example/", f"<body data-n={i}><p>{shared[0]}</p></body>") for i in range(12)]
    out = {r["page_id"]: r["text"] for r in html.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert out[7] == "\n\n".join(["Copy 7", *shared]) and out[110] == out[0] == "\n\n".join(["Copy 0", *shared])
    assert out[203] == shared[0]


def test_html_copies_do_not_outvote_the_other_pages(spark):
    rows = [(i, "https://mixed.example/", f"<div>site</div><p>text {i} of its own</p>") for i in range(12)]
    rows += [(100 + i, "https://mixed.example/", "<p>copy</p>") for i in range(50)]
    out = {r["page_id"]: r["text"] for r in html.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "text 3 of its own" and out[100] == "copy"


@given(st.text(alphabet="<>/aphdiv=\"'&; \n!-", max_size=200))
def test_html_parser_takes_anything(page):
    html.main_text(page)


@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), min_size=1).filter(lambda s: s.strip()), max_size=5))
def test_html_round_trip(paragraphs):
    page = "<html><body><nav>menu</nav><main>" + "".join(f"<p>{entities.escape(p)}</p>" for p in paragraphs) + "</main></body></html>"
    assert html.main_text(page) == "\n\n".join(" ".join(p.split()) for p in paragraphs)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<main><div class=x>more</div><article><header class='entry-header'><h1>T</h1></header><p>a</p><footer>by</footer></article></main>", "T\n\na"),
        ("<div id=siteHeader>s</div><div class='main-content'><p>a</p><div class='user_comments'>c</div><p style='display: none'>h</p><div role=alert>n</div></div><div>z</div>", "a"),
        ("<header>s</header><p>one<p>two<table><tr><td>x<td>y</table><noscript>no</noscript><textarea><b>t</textarea>", "one\n\ntwo\n\nx\n\ny"),
        ("<article><p>a <!-- <p>no</p> --> b<script>if (a<b) '</article>'</script></p><p>open <a href='x>y'>link</a> &notit; &#x41; &amp", "a b\n\nopen link ¬it; A &"),
        ("<ul><li><a href=1>menu one</a></li></ul><p>text with <a>link</a></p>", "text with link"),
        ("<article><div class='AdSlot'>buy</div>plain</article><section class='comments'><article>reader</article></section>", "plain"),
    ],
)
def test_html_of_single_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html class='has-sidebar'><body class='single sidebar comments-open'><p>a</p><nav>n</nav></body></html>", "a"),
        ("<body id=sidebar-left class='page header'><div class='sidebar'>s</div><main class='content with-sidebar'><p>a</p><div class=comments>c</div></main>", "a"),
        ("<article class='post has-comments widget'><p>a</p><div class='sidebar'>s</div></article>", "a"),
        ("<p>tag</p><div class='layout sidebar-right'><div><article><p>a text</p></article></div><div class='sidebar'>more</div></div>", "a text"),
        ("<div class='content no-sidebar'><p>a</p></div><div class='sidebar-content'>s</div>", "a"),
        ("<div class='comments-layout'><main><p>a</p></main></div>", "a"),
        ("<p>a</p><section class='comments'><article>a longer word of a reader</article></section>", "a"),
        ("<main><p>a</p><div class='comments'><article>a longer word of a reader</article></div></main>", "a"),
        ("<main>a</main><div class=sidebar><div class='recent post'>a longer teaser</div></div>", "a"),
    ],
)
def test_html_names_of_the_layout_empty_no_page(page, text):
    assert html.main_text(page) == text


def brute_template(pages, share=0.9):
    """Classes from whole occurrence vectors, nested by comparing all pairs of occurrences: {tokens: (parent's tokens or None, gap)}."""
    pages = [html._tokens(p)[0] for p in dict.fromkeys(pages)]
    counts = {t: [seq.count(t) for seq in pages] for seq in pages for t in seq}
    apart = {t for t, v in counts.items() if len(set(v)) == 1 and 2 <= v[0] <= 16}
    sequences = [[(t, seq[:i].count(t) if t in apart else -1) for i, t in enumerate(seq)] for seq in pages]
    vectors, places = {}, {}
    for i, seq in enumerate(sequences):
        for t in seq:
            vectors.setdefault(t, [0] * len(sequences))[i] += 1
        for t in set(seq):
            places.setdefault(t, []).append(seq.index(t))
    by = {}
    for t, v in vectors.items():
        if sum(map(bool, v)) >= share * len(sequences):
            by.setdefault(tuple(v), []).append(t)
    mean = lambda t: sum(places[t]) / len(places[t])
    classes = sorted((min((mean(t), t) for t in ts), tuple(sorted(ts, key=lambda t: (mean(t), t))), sum(map(bool, v))) for v, ts in by.items())
    wrong = {}
    for seq in sequences:
        for c, (_, ts, _) in enumerate(classes):
            ks = [ts.index(t) for t in seq if t in ts]
            if sorted(ks) == list(range(len(ts))):
                for k in html.out_of_order(ks):
                    wrong[c, k] = wrong.get((c, k), 0) + 1
    classes = [(tuple(t for k, t in enumerate(ts) if wrong.get((c, k), 0) <= (1 - share) * n), n) for c, (_, ts, n) in enumerate(classes)]
    classes = [c for c in classes if c[0]]
    rank = sorted(range(len(classes)), key=lambda c: (-classes[c][1], -len(classes[c][0]), c))
    within = lambda x, y: any(a < x[0] and x[-1] < b for a, b in zip(y, y[1:], strict=False))
    clear = lambda x, y: x[-1] < y[0] or y[-1] < x[0] or within(x, y) or within(y, x)
    valid, births = {}, {}
    for seq in sequences:
        spans = {}
        for c, (ts, _) in enumerate(classes):
            at = [(i, ts.index(t)) for i, t in enumerate(seq) if t in ts]
            if at and [k for _, k in at] == [j % len(ts) for j in range(len(at))] and len(at) % len(ts) == 0:
                spans[c] = [tuple(i for i, _ in at[j : j + len(ts)]) for j in range(0, len(at), len(ts))]
        kept = []
        for c in rank:
            if c in spans and all(clear(x, y) for d in kept for x in spans[c] for y in spans[d]):
                kept.append(c)
        for c in kept:
            valid[c] = valid.get(c, 0) + 1
            for x in spans[c]:
                around = [(y[-1] - y[0], d, y) for d in kept for y in spans[d] if within(x, y)]
                parent = (-1, 0)
                if around:
                    _, d, y = min(around)
                    parent = d, sum(p < x[0] for p in y) - 1
                births.setdefault(c, []).append(parent)
    out = {}
    for c, n in valid.items():
        best = max(set(births[c]), key=lambda p: (births[c].count(p), -p[0], -p[1]))
        if n >= share * classes[c][1] and births[c].count(best) >= share * len(births[c]):
            out[classes[c][0]] = (classes[best[0]][0] if best[0] >= 0 else None, best[1])
    return out


@given(st.permutations(range(6)))
def test_html_least_tokens_out_of_order(ks):
    away = html.out_of_order(ks)
    rest = [k for k in ks if k not in away]
    assert rest == sorted(rest) and len(rest) == max(len(s) for n in range(7) for s in itertools.combinations(ks, n) if list(s) == sorted(s))


def random_pages(seed, n):
    rng = random.Random(seed)
    word = lambda k: " ".join(rng.choice("alpha beta gamma delta omega".split()) + str(rng.randrange(k)) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        parts = ["<div class=top>site</div>" * (rng.random() < 0.95), "".join(f"<div><a>{word(9)}</a><p>{word(99)}</p></div>" for _ in range(2)), f"<ul>{''.join(f'<li><b>{word(9)}</b>' for _ in range(rng.randrange(1, 4)))}</ul>"]
        if rng.random() < (0.0, 0.06, 0.3)[seed % 3]:
            rng.shuffle(parts)
        foot = rng.choice(["<p>one</p><p>two</p>", "<p>two</p><p>one</p>"]) if seed % 2 else "<p>one</p><p>two</p>"
        out.append(f"<body>{''.join(parts)}<section>{''.join(f'<p>{word(999)}</p>' for _ in range(rng.randrange(1, 5)))}</section>{foot}<i>{i % 7}</i></body>")
    return out


@pytest.mark.parametrize("seed", range(6))
def test_html_templates_against_brute_force(spark, seed):
    pages = random_pages(seed, 30)
    row = html.templates(frame(spark, [("h", p) for p in pages + pages[:9]] + [("", p) for p in pages], "host string, html string")).collect()
    assert [r["host"] for r in row] == ["h"]
    found = html.Template(row[0]["template"])
    classes = [tuple(c) for c in found.classes]
    got = {classes[c]: (classes[p] if p >= 0 else None, g) for c, (p, g) in found.parents.items()}
    assert got == brute_template(pages) and len(got) >= (3, 2, 1)[seed % 3]
    assert {c for here in found.of.values() for c, _ in here.values()} == set(found.parents)


def test_html_nesting_tells_repeated_containers_apart(spark):
    """Without a name to go by: the head, the article and the rail are the first, second and third div of the body."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(15):
        title, parts = text(4), [text(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
        rows.append((i, "https://plain.example/", f"<body><div>{text(3)}</div><div><h2>{title}</h2>{''.join(f'<p>{p}</p>' for p in parts)}</div><div><p>{text(2)}</p><p>{text(2)}</p></div></body>"))
        want[i] = "\n\n".join([title, *parts])
    pages = frame(spark, rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_pages(pages).collect()} == want
    off = {r["page_id"]: r["text"] for r in html.extract_pages(pages, least=100).collect()}
    assert all(off[i] != want[i] and want[i] in off[i] for i in want)


def test_html_rail_of_other_items_on_every_page(spark):
    rows = [(i, "https://rail.example/", f"<body><div class=wrap><h1>T{i}</h1><p class=lead>lead {i}</p><div class=body>{''.join(f'<p>paragraph {i} {k} with some words</p>' for k in range(4))}</div></div><div class=rail><p>item {i}</p><p>item {i + 1}</p></div></body>") for i in range(12)]
    out = {r["page_id"]: r["text"] for r in html.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "\n\n".join(["T3", "lead 3", *(f"paragraph 3 {k} with some words" for k in range(4))])


def test_html_template_alone_finds_the_article_of_real_pages(spark):
    """With all names switched off, the template gives the text that names give."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").repartition(4)
    by = {n: {r["page_id"]: r["text"] for r in html.extract_pages(pages, names=n, least=5).collect()} for n in (True, False)}
    off = {r["page_id"]: r["text"] for r in html.extract_pages(pages, names=False, least=10**6).collect()}
    hosts = {r["h"] for r in pages.groupBy(urls.host_of(F.col("url")).alias("h")).agg(F.countDistinct("html").alias("n")).where("n >= 5").collect()}
    ids = [r["page_id"] for r in pages.select("page_id", urls.host_of(F.col("url")).alias("h")).collect() if r["h"] in hosts]
    assert len(ids) > 50 and sum(by[True][i] == by[False][i] for i in ids) >= 0.98 * len(ids) and not any(off[i] == by[True][i] for i in ids)


@pytest.mark.parametrize("most", [0, 500_000])
def test_html_templates_too_many_to_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(html, "sized", lambda df: F.broadcast(df) if most else df)
    monkeypatch.setattr(html, "PAGES_AT_ONCE", 4)
    rows = [(i, f"https://h{i % 2}.example/", f"<div>site</div><p>text {i} of its own</p>") for i in range(26)]
    assert {r["text"] for r in html.extract_pages(frame(spark, rows, "page_id long, url string, html string")).collect()} == {f"text {i} of its own" for i in range(26)}


# WARC.


def test_warc_round_trip(spark, tmp_path):
    body = "é" * 60
    rows = [
        (5, "http://a/", body), (3, "http://b/x\r\ny", body), (9, None, body), (None, "http://n/", body), (7, "http://c/", "short"), (8, "http://d/", "short"), (10, "http://e/", None), (11, "http://f/", ""),
        (12, "http://g/", "a\r\n\r\nb" + "x" * 200), (13, "http://h/", LONG), (14, "http://i/", LONG),
    ]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    assert {k: (v["record_type"], v["refers_to"]) for k, v in got.items() if v["record_type"] == "revisit"} == {5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3), 14: ("revisit", 13)}
    for page, url, text in rows:
        raw = (text or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"], got[page]["url"]) == (len(raw), hashlib.sha256(raw).hexdigest(), url)
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    found = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path, payload=True).where("record_type = 'response'").collect()}
    assert found[12] == rows[8][2] and found[13] == LONG and found[10] == ""
    warc.write_archives(pages.limit(0), path + "0")
    assert warc.read_archives(spark, path + "0").count() == 0


def members(path):
    """What each gzip member of a file holds, by a parser of its own."""
    data = path.read_bytes()
    while data:
        unpack = zlib.decompressobj(31)
        yield unpack.decompress(data) + unpack.flush()
        data = unpack.unused_data


def test_warc_files_for_other_readers(spark, tmp_path):
    urls_ = ["http://h.example/a%20b?q=%2F", "http://h.example/x:y: z", "", None, "http://h.example/é"]
    rows = [(i, urls_[i % 5], "p" * 150 if i % 3 else f"own {i} " * 40) for i in range(60)]
    warc.write_archives(frame(spark, rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"), most=8000)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz")]
    seen = {}
    for f in files:
        for k, member in enumerate(members(f)):
            head, block = member.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and (fields["WARC-Type"] == "warcinfo") == (k == 0) and block.endswith(b"\r\n\r\n") and len(block) - 4 == int(fields["Content-Length"])
            if k:
                seen[int(fields["X-Page-Id"])] = fields, block[:-4].split(b"\r\n\r\n", 1)
            else:
                assert fields["WARC-Filename"] == f.name
    assert len(files) >= 3 and {i: f.get("WARC-Target-URI") for i, (f, _) in seen.items()} == {i: u for i, u, _ in rows}
    assert all(b[1].decode() == (rows[i][2] if f["WARC-Type"] == "response" else "") for i, (f, b) in seen.items())
    first = next(f["WARC-Record-ID"] for i, (f, _) in sorted(seen.items()) if i % 3)
    assert {f.get("WARC-Refers-To") for i, (f, _) in seen.items() if f["WARC-Type"] == "revisit"} == {first} and len({f["WARC-Record-ID"] for f, _ in seen.values()}) == 60


def test_warc_files_of_failed_tasks_and_of_others(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "x" * 100 + str(i)) for i in range(20)]
    path = tmp_path / "w"
    warc.write_archives(frame(spark, rows, "page_id long, url string, html string"), str(path))
    whole = next(f for f in path.iterdir() if f.name.endswith(".warc.gz"))
    (path / "part-00000-left.warc.gz").write_bytes(whole.read_bytes()[:-20])
    assert warc.read_archives(spark, f"file://{path}").count() == 20
    other = tmp_path / "other"
    other.mkdir()
    (other / "plain.warc").write_bytes(b"".join(members(whole)))
    (other / "one.warc.gz").write_bytes(gzip.compress(b"".join(members(whole))))
    n = len(list(members(whole))) - 1
    assert warc.read_archives(spark, str(other), payload=True).where("payload like 'xxx%'").count() == 2 * n
    (other / "cut.warc").write_bytes(b"".join(members(whole))[:-30])
    with pytest.raises(Exception, match="ends inside"):
        warc.read_archives(spark, str(other)).count()


def test_warc_of_many_repeated_payloads(spark, monkeypatch):
    rows = [(i if i % 7 else None, f"http://a/{i}", f"{i % 9} " * 70) for i in range(100)] + [(1, "http://again/", "1 " * 70)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    show = lambda: sorted(map(str, warc.archive_round_trip(pages).collect()))
    first = show()
    monkeypatch.setattr(warc, "sized", lambda df: df)
    assert show() == first and sum("revisit" in r for r in first) == 91


def test_warc_streams_a_long_payload(tmp_path):
    """Reading holds pieces: a payload of 64 MB is never whole."""
    text = b"abcdefgh" * (8 << 20)
    parts = warc.record(1, "u", text, hashlib.sha256(text).hexdigest(), None, None, False, "d")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join([*parts, b"\r\n\r\n"])) * 2)
    tracemalloc.start()
    with (tmp_path / "a.warc.gz").open("rb") as source:
        sizes = [sum(map(len, warc.body(block))) for _, block in warc.read_records(source)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [len(text)] * 2 and peak < 16 << 20


# URLs.

URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?q", "https://x.example.com/de/1", "https://example.com/de", "https://a.org/fr/1", "http://b.net", "http://b.net/", "ftp://notexample.net/en/", "http://casino-win.example/en/1",
    "http://docs.example/en/1#a?b", "x://h?u/://y", "https://İ.example.ORG/FR/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = [(h + p, a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None)))


def test_urls_against_brute_force(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)]
    out = urls.judge_urls(frame(spark, rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("p_block", F.lit(2))).collect()
    model = urls.trained()
    for r in out:
        host, path, rule, action = brute(URLS[r["page_id"] % len(URLS)])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (action or ("block" if model.probability([host], [path])[0] >= 0.5 else "allow"))
    assert urls.judge_urls(frame(spark, [], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("fold", range(4))
def test_url_classifier_on_words_it_has_not_seen(fold):
    """Hosts of which every word is held out, a quarter of the words at a time."""
    kept = [[w for w in words if words.index(w) % 4 != fold] for words in (urls.BLOCK_WORDS, urls.ALLOW_WORDS)]
    held = [[w for w in words if words.index(w) % 4 == fold] for words in (urls.BLOCK_WORDS, urls.ALLOW_WORDS)]
    model, test = urls.trained(urls.labelled_urls(*kept)), urls.labelled_urls(*held)[1:]
    p = model.probability(*zip(*[urls._split(u) for u, _ in test], strict=True))
    assert sum((x >= 0.5) == y for x, (_, y) in zip(p, test, strict=True)) / len(test) >= 0.85
    unseen = [urls._split(f"https://{w}.example/en/1") for w in ("zorbul", "quentel", "mirrawyn", "thonderly")]
    assert all(model.probability(*zip(*unseen, strict=True)) < 0.5)


@pytest.mark.parametrize("url, blocked", [("https://free-bets.example.net/en/2947.html", True), ("https://www.cheap-pills.example.com/en/1/", True), ("http://m.therat.example.com/en/41466", False)])
def test_url_classifier_verdicts(url, blocked):
    host, path = urls._split(url)
    assert (urls.trained().probability([host], [path])[0] >= 0.5) == blocked


def test_warc_values_keep_their_spaces(spark, tmp_path):
    rows = [(1, " http://x.example/a ", "<p>" + "a" * 200), (2, "\thttp://x.example/b", "<p>" + "a" * 200)]
    warc.write_archives(frame(spark, rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    assert {(r["page_id"], r["url"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {(1, " http://x.example/a "), (2, "\thttp://x.example/b")}
