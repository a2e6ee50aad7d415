"""The lexer on hand-written texts, against the plain pattern where that is exact, and on long texts."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scan_files import files_df

from codelens.functions.lexer import JS_STRIP, strip_js_text
from codelens.operators import detect as D


@pytest.mark.parametrize("text, code", [
    ('x.replace(/"/g, "q"); fetch(u); y = "a"', "x.replace( ,  ); fetch(u); y =  "),
    ("`a ${fetch(u)} b`", " fetch(u) "),
    ('`a ${`b ${c({x: "}"})} d`} e` + f', "  c({x:  })   + f"),
    ('a / b / c; "x/y"', "a / b / c;  "),
    ('if (x) /re"/.test(y); z', "if (x)  .test(y); z"),
    ('(x) / 2 / "q"', "(x) / 2 /  "),
    ('x = {a: 1} / 2 / "s"', "x = {a: 1} / 2 /  "),
    ('f = function () {} /re/.exec("a")', "f = function () {}  .exec( )"),
    ('return /[/"]+/g.test(x) ? "a" : b', "return  .test(x) ?   : b"),
    ('x++ / 2 / "q"', "x++ / 2 /  "),
    ('a[0] / 2 / "q"', "a[0] / 2 /  "),
    ("obj.return / 2 / fetch('x/')", "obj.return / 2 / fetch( )"),
    ('<b>don\'t</b><br/> "x" fetch()', "<b>don't</b><br/>   fetch()"),
    ("f(/* \" */ x // \"\n)", "f(  x  \n)"),
    ("x = y ? /a'/ : /b`/; fetch(1)", "x = y ?   :  ; fetch(1)"),
    ("'open\nfetch()", "'open\nfetch()"),
    ("/* open fetch()", "/* open fetch()"),
    ("`open fetch()", "`open fetch()"),
    (r"'a\'b' + /\/'/ + c", "  +   + c"),
    ("", ""),
])
def test_by_hand(text, code):
    assert strip_js_text(text) == code


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n\"'`\\$;(){}*/", max_size=30))
def test_equals_the_pattern_where_no_slash_or_interpolation_is_left(text):
    plain = re.sub(JS_STRIP, " ", text)
    if "/" not in plain and "${" not in text:
        assert strip_js_text(text) == plain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(['"', "'", "`", "${", "}", "/", "//", "/*", "*/", "\\", "\n", "[", "]", "(", ")", "{", "a", "=", " "]), max_size=40))
def test_any_text_ends(parts):
    code = strip_js_text("".join(parts))
    assert len(code) <= len("".join(parts))


@pytest.mark.parametrize("text", ['"' + 'a\\"' * 400_000 + '"', "`" + "a" * 10**6 + "`", "/" + "a" * 10**6 + "/", "x/" * 300_000, "`${" * 200_000,
                                  "`" * 300_001, "/*" * 300_000, "'" * 300_001, '"\\' + '"\\' * 300_000, "(/[" * 200_000, "a=/b" * 200_000])
def test_linear_time(text):
    start = time.time()
    strip_js_text(text)
    assert time.time() - start < 20


def features(spark, path, content):
    return {r.feature for r in D.detect_features(files_df(spark, [(path, content)])).collect()}


def test_rules_read_code_only(spark):
    assert features(spark, "a.js", 'x.replace(/"/g, "q"); fetch(u); y = "a"') == {"fetch"}
    assert features(spark, "b.js", "const s = `a ${await fetch(u)} b ${navigator.share(x)}`;") == {"fetch", "async-await", "top-level-await", "WebShare"}
    assert features(spark, "c.ts", "const s = `fetch(u) await`, r = /fetch(u) ?? await/;") == set()
    rows = files_df(spark, [("a.js", None), ("b.js", ""), ("c.js", "a / b"), ("d.js", "fetch(`${x}`)"), ("e.css", "`${")])
    assert [(r.file, r.feature) for r in D.detect_js(rows).collect()] == [("d.js", "fetch")]


def test_css_literals(spark):
    assert features(spark, "a.css", '.a::before { content: "} .b { display: grid; "; color: red; }') == set()
    assert features(spark, "b.css", ".a { background: url(data:x;display:grid;); flex-wrap: wrap; }") == {"css-flexbox"}
    assert features(spark, "c.scss", "// .a { display: grid; }\n.b { background: url(http://x/y); flex: 1; }") == {"css-flexbox"}
    assert features(spark, "d.css", "/* { display: grid; } */ .a:has(b) { --x: 1; }") == {"css-has-pseudo", "css-variables"}
