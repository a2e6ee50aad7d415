"""Source texts without comments and literals.

``strip_js_text`` reads a JavaScript / TypeScript text once, from left to right,
with a stack of modes: code in braces, code in parentheses, and the ``${ }`` of a
template literal (in which code goes on, to any depth).  Each step takes a whole
token by one pattern without backtracking, so time is linear in the text, however
long a literal is.  Whether a slash divides or opens a regular expression follows
from the token before it; for a closing bracket, from what stood before the
bracket that it closes.

``code_column`` is the DataFrame form.  Most texts need no automaton: comments and
plain literals come out by one native pattern, and only if a slash remains then, or
the text has a ``${``, is it sent to the workers.  (Up to the first regular
expression the pattern reads as the automaton does, so its slash remains.)
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# comments and string / template literals (one left-to-right alternation, so a
# '//' inside a string is consumed as part of the string).  Literals are unrolled
# with possessive loops: Java's engine then iterates, so a literal of any length
# (a minified bundle, a data URI) neither recurses per character nor backtracks.
JS_STRIP = (r"""//[^\n]*|/\*[\s\S]*?\*/|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"""
            r"""|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`""")

_TOKEN = re.compile(r"""
    (?P<space>\s++)
  | (?P<comment>//[^\n]*+)
  | (?P<quote>["'])
  | (?P<word>[\w$]++)
  | (?P<step>\+\+|--)
  | (?P<arrow>=>)
  | (?P<open>[({\[])
  | (?P<close>[)}\]])
  | (?P<tick>`)
  | (?P<slash>/)
  | (?P<other>[\s\S])
""", re.X)
_STRING = {q: re.compile(rf"{q}(?:[^{q}\\\n]++|\\[\s\S])*+") for q in "\"'"}
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+")
_REGEX = re.compile(r"/(?![*/>])(?:[^\\/\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[A-Za-z]*+")

# Words of the language behind which an expression begins, and those whose parentheses are no operand.
_BEFORE_EXPRESSION = frozenset("return typeof instanceof in of new delete void throw case do else yield await default extends".split())
_CONTROL = frozenset("if while for with".split())
# in front of a brace: a block follows (else an object)
_BLOCK_WORDS = frozenset("do else try finally default".split())


def strip_js_text(text: str) -> str:
    """``text`` with every comment and every string, template or regular expression
    literal replaced by a space; what stands in the ``${ }`` of a template stays.
    A quote, backtick or comment that never ends is read as a single character."""
    out: list[str] = []
    stack: list[tuple[str, bool]] = []  # (opening token, whether an operand ends where it closes)
    operand = False                     # whether the token before was the end of an operand
    last = ""                           # the token before
    at, n = 0, len(text)
    comment_end = text.rfind("*/")
    open_template = False               # whether a backtick was met that nothing closes
    dead = {'"': 0, "'": 0, "/": 0}     # up to where no such sign opens a literal: an earlier one never ended
    while at < n:
        m = _TOKEN.match(text, at)
        kind, token = m.lastgroup, m[0]
        end = m.end()
        if kind == "space":
            out.append(token)
        elif kind == "comment":
            out.append(" ")
        elif kind == "quote":
            end = _STRING[token].match(text, at).end() if at >= dead[token] else n
            if end < n and text[end] == token:
                out.append(" ")
                operand, last, end = True, token, end + 1
            else:
                dead[token] = max(dead[token], end)
                out.append(token)
                operand, last, end = False, token, at + 1
        elif kind == "word":
            out.append(token)
            operand, last = last == "." or token not in _BEFORE_EXPRESSION, token if last != "." else "."
        elif kind == "tick":
            body = n if open_template else _TEMPLATE.match(text, end).end()
            if text.startswith(("`", "${"), body):
                out.append(" ")
                if text[body] == "`":
                    operand, last, end = True, "`", body + 1
                else:
                    stack.append(("${", True))
                    operand, last, end = False, "{", body + 2
            else:
                open_template = True
                out.append(token)
                operand, last = False, token
        elif kind == "open":
            if token == "(":
                stack.append((token, last not in _CONTROL))
            elif token == "[":
                stack.append((token, True))
            else:  # an object where an expression may begin, else a block
                block = operand or last in ("", ";", "{", "}", ")", "=>") or last in _BLOCK_WORDS
                stack.append((token, not block))
            out.append(token)
            operand, last = False, token
        elif kind == "close":
            opened, ends = stack.pop() if stack else ("", token != "}")
            if opened == "${" and token == "}":  # the template goes on
                out.append(" ")
                body = _TEMPLATE.match(text, end).end()
                if text.startswith("`", body):
                    operand, last, end = True, "`", body + 1
                elif text.startswith("${", body):
                    stack.append(("${", True))
                    operand, last, end = False, "{", body + 2
                else:
                    operand, last = False, token
            else:
                out.append(token)
                operand, last = ends, token
        elif kind == "slash" and text.startswith("*", end) and at + 2 <= comment_end:
            out.append(" ")
            end = text.index("*/", at + 2) + 2
        elif kind == "slash":
            maybe = not (operand or at < dead["/"] or last == "<" and text[at - 1] == "<")
            literal = _REGEX.match(text, at) if maybe else None
            if maybe and not literal and not text.startswith(("/*", "/>"), at):
                line = text.find("\n", at)
                dead["/"] = n if line < 0 else line
            if literal:
                out.append(" ")
                end = literal.end()
                operand, last = True, "/"
            else:
                out.append(token)
                operand, last = False, "/"
        else:
            out.append(token)
            if kind != "step":  # behind x++ an operand ends, behind ++ none has begun
                operand, last = False, token
        at = end
    return "".join(out)


@F.pandas_udf(StringType())
def _strip_js(texts: pd.Series) -> pd.Series:
    return texts.map(strip_js_text, na_action="ignore")


def code_column(files: DataFrame, when: Column | None = None, content: str = "content", out: str = "_code") -> DataFrame:
    """Add ``out``: ``content`` (null: empty) without comments and literals, for
    the rows where ``when`` holds (default: all; null in the others)."""
    text = F.coalesce(F.col(content), F.lit(""))
    text = text if when is None else F.when(when, text)
    plain = f"{out}_plain"
    f = files.withColumn(plain, F.regexp_replace(text, JS_STRIP, " "))
    needed = F.col(plain).contains("/") | text.contains("${")
    return f.withColumn(out, F.coalesce(_strip_js(F.when(needed, text)), F.col(plain))).drop(plain)


# comments, strings and unquoted addresses of a style sheet; SCSS has line comments besides
_CSS_LITERAL = (r"""/\*[\s\S]*?\*/|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"""
                r"""|(?i:url)\(\s*+[^"'()\s][^()\n]*+\)""")
SCSS_LINE = r"|//[^\n]*"


def strip_css(text: Column, line_comments: Column | None = None) -> Column:
    """A style sheet with every comment, string and unquoted ``url()`` replaced by a
    space, so that braces and words inside them are none of the sheet's; where
    ``line_comments`` holds, ``//`` comments too."""
    plain = F.regexp_replace(text, _CSS_LITERAL, " ")
    if line_comments is None:
        return plain
    return F.when(line_comments, F.regexp_replace(text, _CSS_LITERAL + SCSS_LINE, " ")).otherwise(plain)
