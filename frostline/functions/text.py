"""Text expressions: trim, line split, word tokens, paragraph extraction.

All are built-in column expressions (JVM side, inside whole-stage codegen);
no Python runs per row. The regular expressions are written so that Java's
engine and RE2 read them the same way.
"""

from __future__ import annotations

import html.entities
import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes of the original text handling --------
# Characters Python's str.strip() / str.isspace() treat as white space.
PY_SPACE = (r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Line boundaries of Python's str.splitlines().
PY_LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# Word tokens of the TF-IDF vectoriser: two or more word characters.
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
NON_WORD = r"[^\p{L}\p{N}_]+"
# What is dropped before paragraphs are read (comments, scripts and styles, an open
# one to the end), a tag (a quoted value may hold any sign) and its name.
DROPPED = (r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)"
           r"|<style\b[^>]*>.*?(?:</style\s*>|\z)")
INSIDE_TAG = r"""[^'">]*(?:(?:"[^"]*"|'[^']*')[^'">]*)*"""
ANY_TAG = f"<[A-Za-z/!?]{INSIDE_TAG}>"
TAG_NAME = r"^</?([A-Za-z][^\t\n\r\f />]*)"
# Elements without content: closed as soon as they are opened.
VOID = ("area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img",
        "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr")
# A character reference: decimal, hexadecimal or named, with or without its semicolon. A name goes
# as far as letters, digits, dots and hyphens do; without a semicolon another sign must follow.
REFERENCE = r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[A-Za-z][-.A-Za-z0-9]*)(?:;|(?![0-9A-Za-z]))"
# -----------------------------------------------------------------------------

_STRIP = f"^{PY_SPACE}+|{PY_SPACE}+$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def py_strip(x) -> Column:
    """Trim white space at both ends, as Python's ``str.strip()``."""
    return F.regexp_replace(_c(x), _STRIP, "")


def nonblank_lines(x) -> Column:
    """Lines of a text, each trimmed, blank ones dropped (array, in order)."""
    lines = F.split(F.coalesce(_c(x), F.lit("")), PY_LINE_BREAK)
    return F.filter(F.transform(lines, lambda s: F.regexp_replace(s, _STRIP, "")),
                    lambda s: s != "")


def word_tokens(x) -> Column:
    """Lower-cased word tokens of two or more word characters (array)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(WORD_TOKEN), 0)


def token_pieces(x) -> Column:
    """Lower-cased runs of word characters (array; may hold empty and
    one-character pieces). Exploded and filtered on length >= 2 it yields the
    same tokens as ``word_tokens``, a little cheaper than matching each token."""
    return F.split(F.lower(F.coalesce(_c(x), F.lit(""))), NON_WORD)


# Characters of named references, from the standard library's table, and of the numbers
# that stand for Windows-1252 characters.
_NAMED = json.dumps({n[:-1]: c for n, c in html.entities.html5.items() if n.endswith(";")}
                    | {str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if bytes([i]).decode("cp1252", "ignore")})


def _character(ref: Column) -> Column:
    """The text a reference stands for; an unknown name stays, without its semicolon."""
    table = F.from_json(F.lit(_NAMED), "map<string,string>")
    name = F.regexp_extract(ref, "^&([^;]*)", 1)
    digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+)", 1)
    number = F.when(F.length(digits) > 7, F.lit(1 << 30)).when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.cast("bigint"))
    known = (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    numeric = F.coalesce(F.element_at(table, number.cast("string")), F.when(known, char).otherwise("�"))
    return (F.when(name == "amp", "&").when(name == "nbsp", " ").when(ref.startswith("&#"), numeric)
            .otherwise(F.coalesce(F.element_at(table, name), F.concat(F.lit("&"), name))))


def decode_entities(x, cut: Column | None = None) -> Column:
    """Character references decoded, once: what a reference gives is not read again. Where ``cut`` holds,
    the page ends with the text, and a last reference without its semicolon isn't one yet."""
    c = _c(x)

    def decoded(pattern: str) -> Column:
        between, refs = F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), 0)
        return F.array_join(F.zip_with(between, refs, lambda t, r: F.concat(t, F.coalesce(_character(r), F.lit("")))), "")

    out = F.when(~F.contains(c, F.lit("&")), c)
    if cut is not None:
        out = out.when(cut, decoded(REFERENCE.replace("(?![0-9A-Za-z])", "(?=[^0-9A-Za-z])")))
    return out.otherwise(decoded(REFERENCE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


_OPEN, _DONE = "array<struct<name:string,at:int>>", "array<struct<at:int,till:int>>"


def _fold(tags: Column, last: Column) -> Column:
    """Paragraphs by a fold over a page's tags. ``open``: the elements not closed yet, outermost first, with the
    place of their tag; ``done``: the paragraphs closed so far with the places of both tags. A closing tag closes the
    last open element of its name and all that is open inside it; without one it closes nothing."""
    def closed(elements: Column, till: Column) -> Column:
        return F.transform(F.filter(elements, lambda e: e["name"] == "p"), lambda e: F.struct(e["at"].alias("at"), till.alias("till")))

    def state(opened: Column, done: Column) -> Column:
        return F.struct(opened.alias("open"), done.alias("done"))

    def step(acc: Column, t: Column) -> Column:
        opened, done = acc["open"], acc["done"]
        back = F.array_position(F.reverse(opened["name"]), t["name"]).cast("int")
        stay = F.size(opened) - back
        return (F.when(t["kind"] == "open", state(F.concat(opened, F.array(F.struct(t["name"].alias("name"), t["at"].alias("at")))), done))
                .when(t["kind"] == "both", state(opened, F.concat(done, F.array(F.struct(t["at"].alias("at"), t["at"].alias("till"))))))
                .when(back == 0, acc)
                .otherwise(state(F.slice(opened, 1, stay), F.concat(done, closed(F.slice(opened, stay + 1, back), t["at"])))))

    return F.aggregate(tags, state(F.array().cast(_OPEN), F.array().cast(_DONE)), step,
                       lambda acc: F.array_sort(F.concat(acc["done"], closed(acc["open"], last))))


def _paragraphs(tags: Column) -> Column:
    """(at, till) of the ``p`` elements among the tags of a page, in page order: the places of
    their opening tag and of the tag that closes them (the number of tags: none does)."""
    def read(t: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(t, TAG_NAME, 1))
        kind = (F.when((name == "") | name.isin(*VOID), "none").when(t.startswith("</"), "close")
                .when(~t.endswith("/>"), "open").when(name == "p", "both").otherwise("none"))
        return F.struct(name.alias("name"), kind.alias("kind"), i.alias("at"))

    return _fold(F.filter(F.transform(tags, read), lambda t: t["kind"] != "none"), F.size(tags))


def paragraph_text(page, most: int | None = None) -> Column:
    """Text of the ``<p>`` elements of a page as a tolerant parser sees them, one paragraph per line.

    Scripts and styles go first. A paragraph runs from its tag to the tag that closes it: its own
    ``</p>``, or that of an element around it; one that is never closed runs to the end of the page. A ``<p>`` in an open
    paragraph stands inside it, so the outer one holds the inner one's text too, and the inner one follows by itself.
    Every text piece between tags (or comments) is decoded, trimmed and dropped when empty; pieces are joined by one space.

    NULL if the pieces alone, without the blanks between, are longer than ``most``: nested paragraphs repeat their text, so a
    page that never closes any may give a text far longer than itself.
    """
    body = F.regexp_replace(F.coalesce(_c(page), F.lit("")), DROPPED, "<!>")

    def pieces(texts: Column) -> Column:
        return F.transform(texts, lambda s, i: py_strip(decode_entities(s, cut=i == F.size(texts) - 1)))

    def inside(values: Column, p: Column) -> Column:
        return F.slice(values, p["at"] + 2, p["till"] - p["at"])

    def text_of(parts: Column, found: Column) -> Column:
        lines = F.transform(found, lambda p: F.array_join(F.filter(inside(parts, p), lambda s: s != ""), " "))
        whole = F.array_join(lines, "\n")
        if most is None:
            return whole
        return let(F.transform(parts, lambda s: F.length(s).cast("long")), lambda sizes: F.when(F.aggregate(
            found, F.lit(0).cast("long"), lambda n, p: F.when(n > most, n).otherwise(
                n + F.aggregate(inside(sizes, p), F.lit(0).cast("long"), lambda a, b: a + b))) <= most, whole))

    return let(body, lambda b: F.when(~b.rlike("(?i)<p[\t\n\r\f />]"), F.lit("")).otherwise(let(
        F.split(b, ANY_TAG), lambda texts: let(pieces(texts), lambda parts: let(
            _paragraphs(F.regexp_extract_all(b, F.lit(ANY_TAG), 0)), lambda found: text_of(parts, found))))))
