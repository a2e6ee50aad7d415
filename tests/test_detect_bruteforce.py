"""JS/CSS feature detection (DET-01/02) over the generated code corpus checked
against a plain-Python evaluation of the same rules, file by file (the
lookaround patterns have no DuckDB oracle)."""

import re

from codelens import rules
from codelens.functions.lexer import strip_js_text
from codelens.operators import detect as D
from codelens.plans import bindings as V

SF = "/root/testdata/sf0.001"


def has_class_field(code):
    """Walk the braces character by character, with a stack of class bodies."""
    stack, seg = [], ""
    for ch in code:
        if ch not in "{}":
            seg += ch
            continue
        if stack and stack[-1]:
            for part in re.split(r"[;\n]", re.sub(r"\([^()]*\)", "()", seg) + ("\n" if ch == "}" else "?")):
                words = re.match(r"\s*((?:(?:public|private|protected|readonly|static|declare|override)\s+)*)([A-Za-z_$][\w$]*)[?!]?\s*(.*)", part)
                if words and re.match(r"=[^=>]|=$|:[^=]*=[^=>]", words[3] + " "):
                    return True
            plain = re.sub(r"\([^()]*\)", "()", seg)
            name = r"(?:^|[;\n])\s*(?:(?:public|private|protected|readonly|static|declare|override)\s+)*[A-Za-z_$][\w$]*[?!]?\s*(?::[^;=(){}]+)?"
            if re.search(name + ";", plain) or (ch == "}" and re.search(name + r"\s*\Z", plain)):
                return True
        if ch == "{":
            stack.append(bool(re.search(r"(?<![\w$.])class(?![\w$])[^;]*\Z", seg)))
        elif stack:
            stack.pop()
        seg = ""
    return False


def has_nesting(css):
    stack, seg = [], ""
    for ch in css:
        if ch == "{":
            selector = seg.rsplit(";", 1)[-1].strip()
            rule = not selector.startswith("@")
            if rule and "&" in selector and stack and stack[-1]:
                return True
            stack.append(rule)
        elif ch == "}" and stack:
            stack.pop()
        seg = "" if ch in "{}" else seg + ch
    return False


def py_js_features(raw):
    c = strip_js_text(raw or "")
    out = {k for k, lit, p in D.JS_RULES if lit in c and re.search(p, c)}
    if "await" in c:
        segs = re.split(D.AWAIT_SPLIT, c)
        depth = 0
        for seg in segs[:-1]:
            depth += seg.count("{") - seg.count("}")
            if depth <= 0:
                out.add("top-level-await")
                break
    if "class" in c and re.search(rf"{D.NB}class{D.NA}", c) and has_class_field(c):
        out.add("class-fields")
    if "core-js/" in (raw or ""):
        out.update(re.findall(D.CORE_JS_IMPORT, raw))
    return out


def py_css_features(raw):
    css = re.sub(r"/\*[\s\S]*?\*/", " ", raw or "")
    decls = [(p.strip(), v) for p, v in re.findall(D.CSS_DECL, css)]
    out = set()
    if ":has(" in css:
        out.add("css-has-pseudo")
    if has_nesting(css):
        out.add("css-nesting")
    for p, v in decls:
        if p.startswith("--"):
            out.add("css-variables")
        if p == "backdrop-filter":
            out.add("css-backdrop-filter")
        if "grid" in p:
            out.add("css-grid")
        if p in ("grid-template-columns", "grid-template-rows") and "subgrid" in v:
            out.add("css-subgrid")
        if "flex" in p:
            out.add("css-flexbox")
        if "clamp(" in v:
            out.add("css-clamp")
    if "@container" in css and re.search(r"@container([^A-Za-z0-9_-]|$)", css):
        out.add("css-container-queries")
    return out


def test_features_match_python_rules(spark):
    corpus = V.v_code(spark, SF).unionByName(V.v_files(spark, SF))
    got = {}
    for r in D.detect_features(corpus).collect():
        got.setdefault((r.scan_id, r.file), set()).add(r.feature)
    want = {}
    for r in corpus.collect():
        if r.ext in rules.JS_EXTS:
            fs = py_js_features(r.content)
        elif r.ext in rules.CSS_EXTS:
            fs = py_css_features(r.content)
        else:
            continue
        if fs:
            want[(r.scan_id, r.path)] = fs
    assert got == want
    all_feats = set().union(*got.values())
    assert {"fetch", "AbortController", "optional-chaining", "nullish-coalescing", "XMLHttpRequest", "class-fields",
            "private-class-fields", "top-level-await", "promise-allSettled", "css-grid", "css-nesting",
            "core-js/features/promise"} <= all_feats


def features_of(spark, path, content):
    from scan_files import files_df
    return {r.feature for r in D.detect_features(files_df(spark, [(path, content)])).collect()}


def test_long_literals_do_not_end_the_job(spark):
    for quote in "\"'`":
        code = f"const a = {quote}" + "x\\n" * 350_000 + f"{quote};\nfetch('/a');\n"
        assert features_of(spark, "a.js", code) == {"fetch"}
    assert "fetch" in features_of(spark, "a.js", "/*" + "y" * 1_000_000 + "*/ fetch('/a')")


def test_class_fields_only_in_class_bodies(spark):
    method = "class A {\n  m(a = 1) {\n    i = 0;\n    return;\n  }\n  get x() { return 1; }\n}\nlet y = 2;\n"
    assert "class-fields" not in features_of(spark, "a.js", method)
    for body in ("x = 1;", "static n = 0", "m() { }\n  done;", "run = () => { };", "readonly a: string;", "x"):
        assert "class-fields" in features_of(spark, "a.ts", f"class A extends B {{\n  {body}\n}}\n"), body
    assert "class-fields" not in features_of(spark, "a.js", "const o = { a: 1 }; x = 1; class A { }")


def test_css_after_nested_rules(spark):
    assert "css-flexbox" in features_of(spark, "a.css", ".a { .x { color: red } flex-wrap: wrap; }")
    assert "css-nesting" in features_of(spark, "a.scss", ".a { color: red; &:hover { color: blue } }")
    for flat in ("&:hover { color: blue }", "@media print { &.x { color: red } }", ".a::after { content: '&'; }"):
        assert "css-nesting" not in features_of(spark, "a.scss", flat)


def test_package_in_both_maps(spark):
    from scan_files import files_df
    both = '{"dependencies": {"react": "1", "next": "1"}, "devDependencies": {"react": "1", "next": "1"}}'
    got = {r.name for r in D.detect_frameworks(files_df(spark, [("package.json", both)])).collect()}
    assert {"React", "Next.js"} <= got
