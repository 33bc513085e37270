import sqlite3

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmill.functions import text, vocabulary
from docmill.functions.porter import fold, stem

SUFFIXES = ["", "s", "ing", "ed", "ation", "ational", "fulness", "izer", "ly", "ies", "eed", "ement", "ousness", "iviti", "sses", "y", "e", "ll", "sion"]


@given(st.lists(st.builds(lambda a, b: a + b, st.text(alphabet="abcdefgilmnoprstuvwy", min_size=1, max_size=7), st.sampled_from(SUFFIXES)), min_size=1, max_size=30))
def test_stems_are_those_of_the_full_text_index(terms):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(terms))
    assert [r[1] for r in sorted(db.execute("select doc, term from v"))] == [stem(t) for t in terms]


def test_fold():
    assert [fold(w) for w in ("café", "naïve", "abc")] == ["cafe", "naive", "abc"]


def test_vocabulary_sizes():
    assert (len(vocabulary.STOPWORDS), len(vocabulary.TFIDF_STOPWORDS), len(vocabulary.ABBREVIATIONS), len(vocabulary.SYNONYMS)) == (106, 32, 125, 55)


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_cases(spark):
    r = row(
        spark, a=text.slug(F.lit("Hello, World! It's  A-b")), b=text.kebab_to_pascal(F.lit("review-panel-x")), c=text.pascal_to_kebab(F.lit("TdsButtonHTMLView")), d=text.strip_html(F.lit("<p>a <b>b</b>\n c</p>")),
        e=text.without_suffix(F.lit("ButtonComponent")), f=text.stem_of(F.lit("a/b.component.ts")), g=text.chunk_uri(F.lit("s"), F.lit("p.md"), F.lit("x")), h=text.chunk_uri(F.lit("s"), F.lit("p.md"), F.lit(None).cast("string")),
    )
    assert list(r) == ["hello-world-its-a-b", "ReviewPanelX", "tds-button-html-view", "a b c", "Button", "b.component", "docs://s/section/p.md#x", "docs://s/section/p.md"]


def snippet(content, terms, tail):
    low, at = content.lower(), len(content)
    for t in terms:
        p = low.find(t)
        at = p if p != -1 and p < at else at
    start = 0 if at == len(content) and not tail else max(0, at - 50)
    end = min(len(content), start + 200)
    return ("..." if start else "") + " ".join(("x" + content[start:end].strip() + "x").split())[1:-1] + ("..." if end < len(content) else "")


def test_snippets(spark):
    contents = ["", "short", "needle at start " + "y" * 300, "z" * 120 + " needle " + "y " * 200, "no match " * 40, "Needle"]
    rows = spark.createDataFrame([(c,) for c in contents], "c string")
    for tail in (False, True):
        got = [r[0] for r in rows.select(text.snippet(F.col("c"), F.array(F.lit("needle"), F.lit("absent")), tail=tail)).collect()]
        assert got == [snippet(c, ["needle", "absent"], tail) for c in contents]


def test_usage_snippet(spark):
    rows = spark.createDataFrame([("a" * 100 + "<app-tds-button>" + "b" * 400,), ("none",), ("q" * 400,)], "c string")
    got = [r[0] for r in rows.select(text.usage_snippet(F.col("c"), F.lit("TdsButton"))).collect()]
    assert got[0].startswith("..." + "a" * 50 + "<app-tds-button>") and got[0].endswith("b...") and got[1] == "none" and got[2] == "q" * 300 + "..."
