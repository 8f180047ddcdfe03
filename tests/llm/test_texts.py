from __future__ import annotations

import hashlib
import random

import pytest

from sheaf.llm import licenses, line_blocks, merkle


def test_merkle_edits_are_located():
    a = "First paragraph of this text, it has some words.\nSecond paragraph stays as it was.\nThird one ends the text here."
    b = a.replace("stays as it was", "has been changed")
    assert merkle.fingerprint(a) == merkle.fingerprint(a) != merkle.fingerprint(b)
    assert merkle.changed_paragraphs(merkle.fingerprint(a), merkle.fingerprint(b)) == [1]
    assert 0.3 < merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) < 1
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint("nothing in common with it whatsoever, not a word.")) < 0.2
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0
    assert merkle.fingerprint("a\nb")[:32] != merkle.fingerprint("a\n\nb")[:32]


def test_next_text_by_id(spark, docs):
    texts = [f"text number {i} " + "some words that follow it " * (i % 7) + ("é" * i) for i in range(40)]
    df = docs(texts).repartition(7)
    rows = {r["doc_id"]: r for r in merkle.compare_with_next(df).collect()}
    assert len(rows) == 40
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % 40][:q]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == merkle.fingerprint(t) and r["edited_fingerprint"] == merkle.fingerprint(edited)
        assert r["near_edited"] == merkle.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == merkle.likeness(r["fingerprint"], rows[(i + 1) % 40]["fingerprint"])


def own_pieces(text):
    """Pieces of a text, written anew from the definition: words with the space after them, cut after words whose hash says so."""
    import re
    import zlib

    out = []
    for line in text.encode().split(b"\n"):
        found = re.findall(rb"\S+\s*|\s+", line)
        if len(text) < 160:
            for w in found:
                out += [w[i : i + 6] for i in range(0, len(w), 6)] if len(w) > 12 else [w]
            continue
        piece, n = b"", 0
        for w in found:
            if len(w) > 64:
                out += [piece] * bool(piece) + [w[i : i + 32] for i in range(0, len(w), 32)]
                piece, n = b"", 0
                continue
            piece, n = piece + w, n + 1
            if n == 12 or n >= 3 and (zlib.crc32(w.rstrip()) * 2654435761 & 0xFFFFFFFF) % 6 == 0:
                out.append(piece)
                piece, n = b"", 0
        out += [piece] * bool(piece)
    return out


def own_likeness(a, b):
    """Bytes in common pieces, by trying all pairs of pieces."""
    if a == b:
        return 1.0
    left, right = own_pieces(a), own_pieces(b)
    total, common = sum(map(len, left)) + sum(map(len, right)), 0
    for p in left:
        if p in right:
            right.remove(p)
            common += len(p)
    return 2 * common / total if total else 0.0


def test_likeness_equals_brute_force_on_texts(spark, docs):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 90 if r.random() < 0.02 else 8)))
    texts = ["".join(word() + r.choice((" ", " ", " ", "\n", "  ")) for _ in range(r.choice((0, 3, 20, 150)))) for _ in range(60)]
    texts[10] = texts[11]
    texts[20], texts[21] = "", ""
    rows = {x["doc_id"]: x for x in merkle.compare_with_next(docs(texts)).collect()}
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert rows[i]["near_edited"] == pytest.approx(own_likeness(t, edited), abs=2e-6)
        assert rows[i]["near_next"] == pytest.approx(own_likeness(t, following), abs=2e-6)
        assert all((rows[i]["fingerprint"] == rows[j]["fingerprint"]) == (t == texts[j]) for j in rows)


def test_merkle_odd_rows(odd_docs, none_docs, docs):
    assert merkle.compare_with_next(odd_docs).count() == odd_docs.count()
    assert merkle.compare_with_next(none_docs).count() == 0
    (one,) = merkle.compare_with_next(docs(["only one"])).collect()
    assert one["near_next"] == 1.0
    assert merkle.fingerprints(odd_docs).count() == odd_docs.count()


def test_license_phrases_and_templates(docs):
    texts = [
        "Some text.\nReleased under the MIT License.",
        "It is licensed under the Apache License, Version 2.0 as is.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "Nothing of the kind, by the way; the license of an apache pilot.",
        "mit license and MIT-LICENSE",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        None,
    ]
    rows = licenses.license_scan(docs(texts)).orderBy("doc_id").collect()
    assert [r["base_labels"] for r in rows] == ["mit", "apache", "gpl", "cc-by", "", "mit", "", ""]
    assert [r["labels"] for r in rows] == ["mit", "apache,apache-2.0", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "", "mit", "mit", ""]
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"]) == (2, 0, 3)
    assert rows[4]["first_word"] is None and all(0 <= r["score"] <= 1 for r in rows) and rows[6]["spans"][0]["begin"] == 0


def test_license_templates_are_found_at_every_beginning(docs):
    notices = [t.notice for t in licenses.TEMPLATES]
    whole = "Some words. ".join(f"{n}.\n" for n in notices)
    texts = [whole, *(f"{notices[1]}, and {n}" for n in notices), *[f"row {i}: {notices[1]}" for i in range(12)], *["nothing here"] * 6]
    rows = licenses.license_scan(docs(texts)).orderBy("doc_id").collect()
    index = licenses.Index(*licenses.word_documents(docs(texts)))
    for text, row in zip(texts, rows, strict=True):
        found = licenses.words(text.encode())
        want = []
        for (t, notice, must), total in zip(index.templates, index.total):
            for begin in range(1 - len(notice), len(found)):
                share = sum(index.weight[w] for i, w in enumerate(notice) if 0 <= begin + i < len(found) and found[begin + i] == w) / total
                if share >= licenses.SHARE and all(begin + i >= 0 and found[begin + i : begin + i + len(p)] == p for i, p in must):
                    want.append((t.label, max(begin, 0), min(begin + len(notice), len(found)), share))
        assert [tuple(s) for s in row["spans"]] == sorted(want)
        assert {s[0] for s in want} <= set(row["labels"].split(","))
    assert set(rows[0]["labels"].split(",")) >= {t.label for t in licenses.TEMPLATES}


def test_license_odd_rows(odd_docs, none_docs):
    assert licenses.license_scan(odd_docs).count() == odd_docs.count()
    assert licenses.license_scan(none_docs).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy now, it is good.</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First &copy; para<br>goes   on.<p>Second.</p><div class="sidebar">Links</div><section class="comments"><p>I agree!</p></section><form>Name <input></form></article><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_marked_article():
    assert line_blocks.main_text(PAGE) == "Head & line\nFirst © para goes on.\nSecond."


def test_main_text_without_marks():
    body = "".join(f"<p>{'Long enough sentence to be text. ' * 4}</p>" for _ in range(3))
    page = f"<div id=menu><a href=/>Home</a></div><ul><li><a href=/b>b</a></ul><div>{body}<p>Short.</p></div><div class='footer'>Imprint</div>"
    got = line_blocks.main_text(page).split("\n")
    assert len(got) == 4 and got[-1] == "Short."


def test_main_text_without_marks_is_whole():
    long = [f"Paragraph {i} is a sentence that is long enough to be text, and it goes on for some more words." for i in range(5)]
    apart = "<div class=ad><p>Buy now,</p><p>it is good,</p><p>and it is cheap.</p></div>"
    links = "".join(f"<p><a href=/{i}>Read {i}</a></p>" for i in range(3))
    p = "<p>{}</p>".format
    page = f"<ul>{links}</ul><div>{p(long[0])}{p(long[1])}{apart}{p(long[2])}<p><a href=/x>Only a link</a></p>{p(long[3])}{apart}{p('Short.')}</div><div>{links}</div>{p(long[4])}{links}<p>x</p>"
    assert line_blocks.main_text(page).split("\n") == [*long[:3], "Only a link", long[3], "Short.", long[4]]
    assert line_blocks.main_text(f"<p>One.</p>{links}<p>Two, longer.</p>") == "Two, longer."


def test_article_keeps_its_heading_captions_and_links():
    long = "This paragraph is long enough to be text, and it goes on for some more words than that."
    page = f"<nav><a href=/>Home</a></nav><article class=post><header class='post-header'><h1 class='entry-header'>Title</h1></header><p>{long}</p><figure><img><figcaption>A caption</figcaption></figure><math>x = 1</math><p><a href=/s>Source</a></p></article><p>Outside.</p>"
    assert line_blocks.main_text(page).split("\n") == ["Title", long, "A caption", "x = 1", "Source"]
    teasers = "".join(f"<article><a href=/{i}>Teaser {i} with a title of some length</a></article>" for i in range(5))
    assert line_blocks.main_text(f"<article><p>{long}</p></article><p>Outside.</p>{teasers}") == long
    # the distribution decides on marked pages too: what is heavy enough outside the element is text
    assert line_blocks.main_text(f"<article><p>{long}</p></article><div><p>{long * 9}</p></div>") == f"{long}\n{long * 9}"
    assert line_blocks.main_text(f"<div><p>{long}<a href=/x>never closed</p><p>{long}</p></div>") == f"{long}never closed\n{long}"


@pytest.mark.parametrize("seed", range(5))
def test_main_text_of_pages_built_from_known_text(spark, seed):
    """Pages whose main text is known by the way they are built, marked and unmarked, with apart blocks at any place."""
    r = random.Random(seed)
    rows, want = [], []
    for i in range(40):
        word = lambda: "".join(r.choice("abcdefghijklmnop é") for _ in range(r.randint(2, 9))).strip() or "x"
        blocks = [" ".join(" ".join(word() for _ in range(r.randint(20, 60))).split()) + " & more." for _ in range(r.randint(2, 9))]
        noise = ["<div class='ad'><p>Buy now</p><p>or never</p><p>at all</p></div>", "<aside>See also this and that</aside>", "<form><p>Your name</p><input></form>", "<script>var a = '<p>no</p>';</script>", "<section id=comments><p>I do not agree at all with what was said up there, and I say so at length.</p></section>", "<!-- <p>gone</p> -->", "<ul class=menu><li><a href=/>One</a><li><a href=/>Two</a></ul>"]
        body = ""
        for b in blocks:
            tag = r.choice(("p", "h2", "blockquote", "p"))
            inner = b.replace("&", "&amp;").replace(" ", r.choice((" ", "  \n", "\t ")), 1)
            body += f"<{tag}>{inner}" + ("" if tag == "p" and r.random() < 0.4 else f"</{tag}>") + (r.choice(noise) if r.random() < 0.5 else "")
        box = r.choice(("article", "main", "div"))
        head = "<nav><ul>" + "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(5)) + "</ul></nav>"
        rows.append((i, f"u{i}", f"<html><head><title>t</title><style>p {{}}</style></head><body>{head}<header><p>Site name and motto</p></header><{box}>{body}</{box}><footer>Imprint, and all rights that are reserved by whoever has them, which goes on for a while.</footer></body></html>"))
        want.append("\n".join(blocks))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in line_blocks.main_texts(pages).collect()}
    assert [got[i] for i in range(40)] == want


def test_pages_with_very_long_texts_ties_and_clashing_columns(spark):
    long = "word " * 400_000
    rows = [(1, "u", f"<article><p>{long}</p></article>", 7, "x"), (1, "v", "<p>tie</p>", 8, "y"), (2, "u", None, None, None)]
    got = line_blocks.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, text string")).collect()
    assert [(r["page_id"], r["url"], len(r["text"]), r["n_chars"]) for r in got] == [(1, "u", 1_999_999, 7), (1, "v", 3, 8), (2, "u", 0, None)]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a href='x", "<!-- x", "<script>alert(1)", "&", "</p></div>", "<p>" * 3000])
def test_broken_pages(page):
    line_blocks.main_text(page)


def test_main_texts_of_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    rows = line_blocks.main_texts(pages).collect()
    assert sorted(len(r["text"]) for r in rows) == [0, 0, 41, 41] and rows[0].asDict().keys() == {"page_id", "url", "text"}
    assert line_blocks.main_texts(pages.limit(0)).count() == 0
