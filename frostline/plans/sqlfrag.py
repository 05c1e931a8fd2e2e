"""DuckDB SQL fragments used by the oracles (written apart from the Spark side)."""

from __future__ import annotations

import re

from frostline.functions import text


# References in the test pages, '&amp;' last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&"))


def lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10)."""
    pieces = s.split("\n")
    out = " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in pieces)
    return out


def fill(template: str, **exprs: str) -> str:
    """SQL concatenation of ``template`` with ``{name}`` replaced by SQL expressions."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(f"coalesce(cast(({exprs[piece[1:-1]]}) as varchar), '')")
        else:
            parts.append(lit(piece))
    return "(" + " || ".join(parts) + ")"


def strip(x: str) -> str:
    ws = text.PY_SPACE
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def decode(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    return out


_TAG = "<[A-Za-z/!?][^>]*>"
_VOID = "'br', 'meta', 'img', 'hr', 'link', 'input', 'wbr'"

# Paragraph text of the pages (url, html) of ``pg``, step by step over each page's tags: ``st`` holds
# the open elements after a tag and those that it closed. The test pages hold no '>' in attribute
# values, only the references listed above, and no other element without content.
PARAGRAPHS = f"""
, tk AS (select url, string_split_regex(body, '{_TAG}') as texts, regexp_extract_all(body, '{_TAG}') as tags
         from (select url, regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '<!>', 'g') as body from pg) z)
, tg AS (select url, i, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) as name, t like '</%' as closing
         from (select url, unnest(tags) as t, unnest(range(1, len(tags) + 1)) as i from tk) z)
, ev AS (select url, i, name, closing, row_number() over (partition by url order by i) as k
         from tg where name <> '' and name not in ({_VOID}))
, st AS (
  select url, cast(0 as bigint) as k, cast(0 as bigint) as i, cast([] as struct(name varchar, pos bigint)[]) as stack,
         cast([] as struct(name varchar, pos bigint)[]) as closed
  from tk
  union all
  select st.url, ev.k, ev.i,
         case when not ev.closing then list_append(st.stack, struct_pack(name := ev.name, pos := ev.i))
              when len(list_filter(st.stack, lambda e: e.name = ev.name)) = 0 then st.stack
              else st.stack[:len(st.stack) - list_position(list_reverse(list_transform(st.stack, lambda e: e.name)), ev.name)] end,
         case when ev.closing and len(list_filter(st.stack, lambda e: e.name = ev.name)) > 0
              then st.stack[len(st.stack) - list_position(list_reverse(list_transform(st.stack, lambda e: e.name)), ev.name) + 1:]
              else [] end
  from st join ev on ev.url = st.url and ev.k = st.k + 1)
, ends AS (
  select url, unnest(list_filter(closed, lambda e: e.name = 'p')).pos as pos, i as till from st
  union all
  select s.url, unnest(list_filter(s.stack, lambda e: e.name = 'p')).pos as pos, len(tk.tags) + 1 as till
  from (select url, max_by(stack, k) as stack from st group by url) s join tk on tk.url = s.url)
, paras AS (
  select e.url, e.pos, array_to_string(list_filter(list_transform(tk.texts[e.pos + 1:e.till], lambda s: {strip(decode("s"))}), lambda s: s <> ''), ' ') as para
  from ends e join tk on tk.url = e.url)
, art AS (select tk.url, coalesce(string_agg(p.para, chr(10) order by p.pos), '') as article
          from tk left join paras p on p.url = tk.url group by tk.url)
"""


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{text.WORD_TOKEN}')"


def lines(x: str) -> str:
    """Non-blank trimmed lines (list)."""
    return (f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '{text.PY_LINE_BREAK}'), "
            f"lambda s: {strip('s')}), lambda s: s <> '')")
