import io
import json
import re
import zipfile
from collections import Counter

import pytest

from tessera import config, plugins
from tessera.operators import chapters as ch
from tessera.operators import text
from tessera.plans import pipelines
from tessera.sources import epub, files, sinks


def epub_bytes(title, pages, nav):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(pages))
        z.writestr("OPS/p.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest></package>')
        z.writestr("OPS/nav.xhtml", nav)
        for n, h in pages.items():
            z.writestr(f"OPS/{n}", h)
    return out.getvalue()


VALID = {"12": True, "Ⅳ": True, "½": True, "1.5": False, "": False, "Chapter  12": False, "prologue ": False, "Prologue": True, "Chapter 7": True, "KAPITEL 7": True, "chapter x": False, "Bar": False, "twice": True, "TWICE": True, "Mixed": True, "mixed": True, "Once": False}


def test_chapter_validity(spark):
    heads = [*VALID, "twice", "mixed"]
    got = {r.heading: r.valid for r in ch.valid(spark.createDataFrame([("b", k, h) for k, h in enumerate(heads)], "book_id string, pos int, heading string")).collect()}
    assert got == VALID
    listed = ch.valid(spark.createDataFrame([("b", 0, " Bar ")], "book_id string, pos int, heading string"), ["bar"])
    assert listed.first().valid


def test_beautify(spark):
    c = spark.createDataFrame([("b", k, h) for k, h in enumerate(["Foo", "Bar", "Foo", "Foo"])], "book_id string, pos int, heading string")
    assert [(r.heading_beautified, r.shown) for r in sorted(ch.beautify(c).collect(), key=lambda r: r.pos)] == [("Foo I", "Foo I"), (None, "Bar"), ("Foo II", "Foo II"), ("Foo III", "Foo III")]


def test_html_columns(spark):
    page = "<h1>A &amp; <b>B</b></h1><script>x='</p>'</script><p>one<p class=x>two</p><!-- <p>no</p> --><div>no</div><P>three</P><h2></h2>"
    r = spark.createDataFrame([(page,)], "html string").select(ch.headings(ch.F.col("html")).alias("h"), ch.paragraphs(ch.F.col("html")).alias("p")).first()
    assert r.h == ["A & B", ""] and r.p == ["one", "two", "three"]


def test_book_pipeline(spark, tmp_path):
    pages = {
        "c1.xhtml": "<html><body><h1>Chapter 1</h1><p>The first one. It has 12 words for you!</p><p>Mail a@b.org now.</p></body></html>",
        "c2.xhtml": "<html><body><h2>Foo</h2><p>Text is here.</p></body></html>",
        "c3.xhtml": "<html><body><h2>Foo</h2><p>More of it.</p></body></html>",
        "no.xhtml": "<html><body><h1>A</h1><h1>B</h1></body></html>",
        "out.xhtml": "<html><body><h1>Chapter 9</h1></body></html>",
    }
    nav = "<nav><a href='c2.xhtml'/><a href='c1.xhtml'/><a href='c3.xhtml'/><a href='no.xhtml'/></nav>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(epub_bytes("My book", pages, nav))
    (tmp_path / "in" / "y.epub").write_bytes(b"PK nothing")
    found = files.routed(files.discover(spark, [f"{tmp_path}/in"]))
    assert {r.pipeline for r in found.collect()} == {"book"}
    items = epub.book_items(found).cache()
    assert items.where("error is not null").count() == 1
    out = pipelines.book(items.where("error is null").withColumnRenamed("path", "book_id"))
    assert [(r.heading, r.shown) for r in sorted(out["chapters"].collect(), key=lambda r: r.pos)] == [("Foo", "Foo I"), ("Chapter 1", "Chapter 1"), ("Foo", "Foo II")]
    assert out["books"].first().title == "My book" and out["books"].first().language == "en"
    assert {(r.label, r.ent) for r in out["entities"].collect()} == {("NUMBER", "12"), ("EMAIL", "a@b.org")}
    book = json.loads(out["book.json"].first().book)
    assert [c["heading"] for c in book["chapters"]] == ["Foo I", "Chapter 1", "Foo II"] and "ner" not in book["chapters"][0]
    assert book["chapters"][1]["sentences"] == ["The first one.", "It has 12 words for you!", "Mail a@b.org now."]
    paths = sinks.store({"book.json": out["book.json"]}, f"{tmp_path}/out")
    assert spark.read.text(paths[0]).count() == 1
    with pytest.raises(KeyError):
        sinks.store({"else": items}, f"{tmp_path}/out")


def test_entities_have_offsets(spark):
    s = spark.createDataFrame([(1, 0, "Call (555) 123-4567 or x@y.com and https://a.b/c 7")], "doc_id long, sent_no int, sentence string")
    for r in text.entities(s, ["doc_id"]).collect():
        assert s.first().sentence[r["from"] : r["to"]] == r.ent
    assert {r.label for r in text.entities(s, ["doc_id"]).collect()} == {"EMAIL", "URL", "PHONE", "NUMBER"}


def test_recursive_split_covers_the_text():
    t = "One two. Three, four\nfive six.\n\nSeven eight nine ten eleven twelve thirteen " * 8 + "x" * 300
    for size, overlap in ((40, 0), (60, 20), (1000, 100), (10, 3)):
        chunks = text.split_recursive(t, size, overlap)
        assert all(len(c) <= size for c in chunks)
        assert len("".join("".join(chunks).split())) >= len("".join(t.split()))
    assert text.split_recursive("", 10, 2) == [] and text.split_recursive("short", 10, 2) == ["short"]


def test_refine_with_function(spark):
    c = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "z")], "id long, chunk_no int, chunk string")
    assert {r.id: r.summary for r in text.refine_with(c, "id", lambda s, x: s + x.upper()).collect()} == {1: "AB", 2: "Z"}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"summary": {"chunk-size": 5, "new": 1}, "nothing": {"x": 1}}')
    _, c = config.parsed(["-c", str(tmp_path / "c.json"), "--diarizer_segment-length", "60"])
    assert c["summary"]["chunk-size"] == 5 and c["summary"]["new"] == 1 and "nothing" not in c and c["diarizer"]["segment-length"] == 60
    _, c = config.parsed(["-c", str(tmp_path / "c.json"), "--summary_chunk-size", "7"])
    assert c["summary"]["chunk-size"] == 7  # the command line counts most
    with pytest.raises(ValueError, match="underscore"):
        config.registered({"a_b": {}})


def test_plugins():
    calls = []

    def load():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "model"

    assert plugins.retried(load, 3, 0) == "model"
    with pytest.raises(OSError):
        plugins.retried(lambda: (_ for _ in ()).throw(OSError()), 2, 0)
    with pytest.raises(ValueError, match="unknown"):
        plugins.get("summary", "nothing")
    assert plugins.messages("s", "p", {"file": "x"}) == "s\n\nfile: x\n\np"


def test_sentence_words_count_where_the_sentence_is(spark):
    texts = ["The cat saw a cat. A dog, Dog dog! It ran", "", None, "zebra " * 5000 + "apple Zebra", "One. One one? ÄÖ äö", "of the and"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, "One two. Three"), (None, "null one"), (None, "null two. three"), (9, "last last")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stop = {w for v in text.STOPWORDS.values() for w in v}
    want = Counter()
    for k, t in rows:
        for no, sentence in enumerate(s for s in re.split(r"(?<=[.!?])\s+", t or "") if s):
            want.update((k, no, w) for w in re.findall(r"[^\W\d_]+", sentence.lower()) if w not in stop)
    got = text.document_words(docs, ["doc_id"])
    assert got.dtypes == [("doc_id", "bigint"), ("sent_no", "int"), ("lemma", "string"), ("n", "bigint")]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(want) and {r[:3]: r[3] for r in out} == want
    assert text.document_words(docs.where("doc_id < 4"), ["doc_id"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert sorted(map(tuple, text.sentence_words(text.sentence_table(docs, ["doc_id"]), ["doc_id"]).collect()), key=str) == sorted(out, key=str)


def test_chapter_words_need_one_shuffle(spark):
    rows = [(1, "a", "Cat cat. Dog the ΣΑΣ. ΟΔΟΣ"), (2, "a", "dog"), (3, "b", None), (4, "b", "cat!"), (4, "b", "cat? Cat"), (None, None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, book_id string, text string")
    got = text.total_words(docs, ["book_id"])
    sents = text.sentence_table(docs, ["book_id", "doc_id"])
    want = text.rollup(text.sentence_words(sents, ["book_id", "doc_id"]), ["book_id"])
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert text.total_words(docs, ["book_id"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.book_id, r.lemma): r.n for r in got.collect()}["b", "cat"] == 3
