import itertools
import random
import re
import time

import pytest

from spanweave.llm.html_text import extract, visible_text

CASES = {
    "<b>a</b>b <i> c</i>": "ab c",
    "<p>one<p>two": "one\n\ntwo",
    "a<br>b": "a\nb",
    "<ul><li>a<li>b<ul><li>c</ul></ul>": "- a\n- b\n  - c",
    "<ol start=3><li>a<li>b</ol>": "3. a\n4. b",
    "<table><tr><th>Name<th>N<tr><td>long name<td>1</table>": "Name       N\nlong name  1",
    "<div hidden>x</div><p style='display: none'>y</p><span style=visibility:hidden>z</span>w": "w",
    "<script>var a = '</p>'</script><style>p{}</style><!-- no -->t<template>u</template>": "t",
    "<pre>  a\n    b</pre>": "  a\n    b",
    "&lt;b&gt; &amp; &eacute;": "<b> & é",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "1 < 2 and a<b": "1 < 2 and a",
    "</p></b>x</div>": "x",
    "<h1>T</h1>text": "T\n\ntext",
    "<title>no</title><img alt=pic>": "pic",
    "": "",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert visible_text(html) == CASES[html]


def test_columns_line_up():
    rng = random.Random(1)
    rows = [["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))).strip() or "x" for _ in range(3)] for _ in range(20)]
    out = visible_text("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>").split("\n")
    wide = [max(len(" ".join(r[k].split())) for r in rows) for k in range(3)]
    assert out == ["  ".join(" ".join(c.split()).ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in rows]


def test_no_visible_text_is_lost():
    rng = random.Random(2)
    tags = ["p", "div", "b", "li", "ul", "td", "tr", "table", "pre", "a", "h2", "ol", "dd", "html", "head", "title", "body", "meta", "option", "optgroup", "rt"]
    for _ in range(1500):
        n, parts, shown, title = 0, [], [], False
        for _ in range(rng.randrange(40)):
            part = rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", f" w{n} "])
            parts.append(part)
            # only a title hides text, up to its own end tag
            title = part != "</title>" if title else part == "<title>"
            if part == f" w{n} ":
                shown += [] if title else [part.strip()]
                n += 1
        got = visible_text("".join(parts)).split()
        assert sorted(w for w in got if w[0] == "w") == sorted(shown), "".join(parts)


HEADS = {
    "<html><head><title>T</title><body><p>Hello</p></body></html>": "Hello",
    "<head><meta charset=x><p>Hello world": "Hello world",
    "<head><title>T</title> text": "text",
    "<head><noscript><link></noscript><style>p{}</style><main>m": "m",
    "<head><title>T</title></head><head><p>still": "still",
    "text<head>shown</head>": "textshown",
    "<body>a<body hidden>b": "ab",
    "<head><template><p>no</p></template><link rel=x>\n<body>yes": "yes",
    "<table><tr><td>\u4f60\u597d<td>x<tr><td>abcd<td>y</table>": "\u4f60\u597d  x\nabcd  y",
    "<select><optgroup label=a><option>1<optgroup><option>2</select>": "a\n1\n2",
    "<ruby>\u6f22<rp>(<rt>kan<rp>)</ruby>": "\u6f22(kan)",
}


@pytest.mark.parametrize("html", HEADS)
def test_heads_end_where_their_content_does(html):
    assert visible_text(html) == HEADS[html]


def test_bad_markup_ends_in_time():
    for bad in ["<a " * 50_000, "<!--" * 50_000, "<a '" * 20_000, "<p>" * 50_000, "<script>" * 20_000, "</b>" * 50_000, "<ul><li>" * 1500, "<div>" * 50_000 + "x"]:
        began = time.time()
        visible_text(bad)
        assert time.time() - began < 20


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None)], "page_id long, html string")
    assert {r.page_id: r.text for r in extract(df).collect()} == {1: "a", 2: ""}


SHOWN = {
    "a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> b": "a x=2 b",
    "<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><text>yes</text></svg>": "yes",
    "<svg><defs/><title/><path d='M0'/><text>yes</text></svg> on": "yes on",
    "<object data=x.swf><param name=a>fallback</object>": "fallback",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>": "yes",
    "<div style='display:none'><b style='visibility:visible'>no</b></div>yes": "yes",
    "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>": "  yes",
    "<p title=don't>Hello it's fine</p>": "Hello it's fine",
    "<p title=x'hidden'>shown</p>": "shown",
    "<p title = 'a>b' class=\"c>d\">q</p>": "q",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>": "a  b\n   c\nd  e",
    "<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g</table>": "a  b    c\nd       e\nf  g",
}


@pytest.mark.parametrize("html", SHOWN)
def test_shown_text_stays(html):
    assert visible_text(html) == SHOWN[html]


def test_bad_attributes_end_in_time():
    for bad in ["<a b=" * 50_000, "<a b='" * 30_001, '<p x="' * 30_001 + ">", "<p " + "=" * 100_000, "<p a" + " " * 100_000]:
        began = time.time()
        visible_text(bad)
        assert time.time() - began < 20


PROBES = {
    "<p>x</p><!-->y<!-- c --!>z": "x\n\nyz",
    "a<!--->b<!-- c -- > d -->e<!---->f": "abef",
    "a</ no>b</>c<?php x ?>d<!DOCTYPE html>e": "abcde",
    "<svg><text><![CDATA[a < b]]></text></svg><![CDATA[no]]>c": "a < bc",
    "<p style='display:none;display:block'>yes</p><p style='display:none!important;display:block'>no</p>": "yes",
    "<p style='x-display:none'>a</p><p style='display:none;display:nonsense'>no</p><p style='/*display:none*/'>b</p><p style='content:\";display:none\"'>c": "a\n\nb\n\nc",
    "Name<input type=submit value=Go><input value='x &amp; y'><input type=hidden value=no><input type=checkbox value=no><input placeholder=hint><input type=password value=no><input type=image alt=pic>": "Name Go x & y hint pic",
    "<select><optgroup label=Fruit><option>a<option label=B>no<optgroup label=C hidden><option>no</select>": "Fruit\na\nB",
    "<dialog>no</dialog><dialog open>yes</dialog><details><p>no</p><summary>head</summary>no</details><details open><summary>s</summary>body</details>": "yes\nhead\ns\nbody",
    "<fieldset><legend>Name</legend>text</fieldset><search>a</search>b": "Name\ntext\na\nb",
    "<ol><li value=4>a<li>b<li value=x>c</ol><ol reversed><li>a<li>b</ol><ol type=a start=26><li>z<li>aa</ol><ol type=I><li value=1994>m<li type=1>n</ol>": "4. a\n5. b\n6. c\n2. a\n1. b\nz. z\naa. aa\nMCMXCIV. m\n1995. n",
    "<xmp>&lt;b>  x</xmp>y<plaintext><b>&amp;</b></plaintext>": "&lt;b>  x\n\ny\n\n<b>&amp;</b></plaintext>",
    "<pre>\n  a\n</pre><div style='white-space: pre'>b   c</div>a</br>b<image alt=q>": "  a\n\nb   c\na\nbq",
    "<textarea placeholder=p></textarea> <textarea placeholder=no>\nv</textarea><meter>no</meter><progress>no</progress>": "p v",
}


@pytest.mark.parametrize("html", PROBES)
def test_probes(html):
    assert visible_text(html) == PROBES[html]


def drawn(rng, counter, depth, seen):
    """A random piece of markup and the words of it that show, both from the same draw; no parser takes part."""
    word = lambda: f"w{next(counter)}"
    out, shows = [], []
    for _ in range(rng.randrange(1, 5)):
        w = word()
        kind = rng.randrange(13 if depth else 5)
        if kind == 0:
            out.append(f" {w} ")
            shows += [w] * seen
        elif kind == 1:
            out.append(rng.choice(["<!-- {} -->", "<!--{}--!>", "<!-->", "<!--->", "<!-- > {} -- -->", "<?x {}?>", "</ {}>", "<!x {}>"]).format(w))
        elif kind == 2:
            shown = rng.random() < 0.5
            attrs = rng.choice(["value={}", 'value="{}" type=TEXT', "type=submit value='{}'", "placeholder={}", "value='' placeholder={}", "type=image alt={}"] if shown else ["type=hidden value={}", "type=radio value={}", "type=password value={}", "name={}", "hidden value={}", "type=submit placeholder={}"])
            out.append(f"<input {attrs.format(w)}{rng.choice(['', ' /', ' data-x=1'])}>")
            shows += [w] * (shown and seen)
        elif kind == 3:
            out.append(f"<img {rng.choice(['alt', 'ALT'])}='{w} '>")
            shows += [w] * seen
        elif kind == 4:
            tag = rng.choice(["script", "style", "textarea", "xmp"])
            out.append(f"<{tag}> {w} </{tag}>")
            shows += [w] * (seen and tag in ("textarea", "xmp"))
        elif kind == 5:
            w2 = word()
            out.append(f"<select><optgroup label={w}><option>{w2}{rng.choice(['', '</option>'])}<option label={w2}b>{word()}</select>")
            shows += [w, w2, f"{w2}b"] * seen
        elif kind == 6:
            opened = rng.random() < 0.5
            a, b = drawn(rng, counter, depth - 1, seen and opened)
            out.append(f"<details{' open' * opened}><summary> {w} </summary>{a}</details>")
            shows += [w] * seen + b
        elif kind == 7:
            opened = rng.random() < 0.5
            a, b = drawn(rng, counter, depth - 1, seen and opened)
            out.append(f"<dialog{' open' * opened}>{a}</dialog>")
            shows += b
        elif kind == 8:
            style, shown = rng.choice([("display:none", 0), ("display:none;display:block", 1), ("display:block;DISPLAY: none", 0), ("display:none !important;display:block", 0), ("x-display:none", 1), ("display:none;display:bad", 0), ("--display: none", 1), ("color:red;;display : none ;", 0)])
            a, b = drawn(rng, counter, depth - 1, seen and bool(shown))
            out.append(f'<div class="a>b" style="{style}">{a}</div>')
            shows += b
        elif kind == 9:
            a, b = drawn(rng, counter, depth - 1, seen)
            c, d = drawn(rng, counter, depth - 1, seen)
            out.append(rng.choice(["<ul><li>{}<li>{}</ul>", "<ol reversed><li value=7>{}</li><li>{}</ol>", "<dl><dt>{}<dd>{}</dl>", "<table><tr><td>{}<td rowspan=2>{}</table>", "<fieldset><legend>{}</legend>{}</fieldset>"]).format(a, c))
            shows += b + d
        else:
            tag = rng.choice(["div", "b", "section", "blockquote", "span", "form", "h2", "label", "button", "article", "em", "noscript", "template", "datalist"])
            a, b = drawn(rng, counter, depth - 1, seen and tag not in ("noscript", "template", "datalist"))
            out.append(f"<{tag} title='it \"is\"' data-y={w}>{a}</{tag}>")
            shows += b
    return "".join(out), shows


def test_drawn_pages_show_what_they_should():
    rng = random.Random(21)
    for _ in range(1500):
        html, shows = drawn(rng, itertools.count(), 4, True)
        assert sorted(re.findall(r"w\d+b?", visible_text(html))) == sorted(shows), html
