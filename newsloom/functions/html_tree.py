"""HTML to interval-encoded elements: the one place where a row needs Python.

Spark has no HTML parser.  This helper turns one page into a list of elements
with ``pre``/``post`` positions (an element's descendants are exactly those with
``pre < d.pre <= post``), text sizes, running counters and the place of each
element in a balanced copy of the markup.  Everything decided from these
numbers (selection, scoring, cleaning) is Spark expressions.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.fixed_values import SCORE_DROP_TAGS, SCORED_TAGS
from newsloom.functions.basics import TRIM_CHARS, as_col

NODE_FIELDS = (
    ("pre", "int"), ("post", "int"), ("depth", "int"),
    ("tag", "string"), ("cls", "string"), ("id", "string"),
    ("text_bytes", "bigint"),      # trimmed text of the whole subtree
    ("visible_bytes", "bigint"),   # the same without scripts, styles, forms ...
    ("hidden", "boolean"),         # inside one of those
    ("start", "int"), ("stop", "int"),
    # running counters over visible elements, in document order
    ("p_run", "bigint"), ("link_run", "bigint"), ("heading_run", "bigint"),
    ("image_run", "bigint"), ("list_run", "bigint"),
    ("words", "bigint"),           # words of the visible text, for scored containers
)
_TYPES = {
    "int": (T.IntegerType(), pa.int32()),
    "bigint": (T.LongType(), pa.int64()),
    "string": (T.StringType(), pa.string()),
    "boolean": (T.BooleanType(), pa.bool_()),
}
_NODE_TYPE = T.StructType([T.StructField(name, _TYPES[kind][0]) for name, kind in NODE_FIELDS])
_NODE_ARROW = [pa.field(name, _TYPES[kind][1]) for name, kind in NODE_FIELDS]
TREE_TYPE = T.StructType(
    [T.StructField("markup", T.StringType()), T.StructField("nodes", T.ArrayType(_NODE_TYPE))]
)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*)>|<[!?][^>]*>""", re.S
)
# one attribute after the other, so that a name inside a quoted value is not taken for one
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW_TEXT = frozenset(("script", "style"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_LISTS = frozenset(("ul", "ol", "dl"))
_ENDS_P = _HEADINGS | _LISTS | frozenset(
    "address article aside blockquote div fieldset figure footer form header hr main nav p pre section table".split()
)
# an opening tag ends these open elements, unless one of the borders is met first
_IMPLIED_END = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
_P_BORDERS = ("table", "td", "th", "caption", "button", "object")


def _byte_size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class _Runs:
    """Text pieces in order, with sizes that make the measures of any run of them a subtraction."""

    def __init__(self) -> None:
        self.size, self.words = [0], [0]        # bytes and word beginnings before each piece
        self.lead: list[int] = []               # blank bytes at a piece's beginning and end; all of a blank piece
        self.tail: list[int] = []
        self.blank: list[bool] = []
        self.joins: list[bool] = []             # the piece goes on with the word that the one before it ends in
        self.open = False

    def __len__(self) -> int:
        return len(self.blank)

    def add(self, text: str) -> None:
        size = _byte_size(text)
        left, right = text.lstrip(TRIM_CHARS), text.rstrip(TRIM_CHARS)
        self.lead.append(len(text) - len(left))  # the trimmed characters are one byte each
        self.tail.append(len(text) - len(right))
        self.blank.append(not left)
        joins = self.open and not text[0].isspace()
        self.joins.append(joins)
        self.size.append(self.size[-1] + size)
        self.words.append(self.words[-1] + len(text.split()) - joins)
        self.open = not text[-1].isspace()

    def finish(self) -> None:
        """The blank bytes that follow each border, and those that come before it, over all pieces."""
        count = len(self)
        self.after, self.before = [0] * (count + 1), [0] * (count + 1)
        for k in range(count - 1, -1, -1):
            self.after[k] = self.lead[k] + (self.after[k + 1] if self.blank[k] else 0)
        for k in range(count):
            self.before[k + 1] = self.tail[k] + (self.before[k] if self.blank[k] else 0)

    def trimmed_bytes(self, first: int, last: int) -> int:
        """Bytes of the pieces from ``first`` up to ``last``, without blanks at both ends."""
        return max(0, self.size[last] - self.size[first] - self.after[first] - self.before[last])

    def word_count(self, first: int, last: int) -> int:
        return self.words[last] - self.words[first] + int(first < last and self.joins[first])


def encode_page(page: str) -> tuple[str, list[tuple]]:
    """The balanced markup and the element tuples (in ``NODE_FIELDS`` order)."""
    markup: list[str] = []
    shown = _Runs()             # all text, entities decoded
    seen = _Runs()              # text outside the dropped elements
    at = 0                      # length of the markup so far
    nodes: list[dict] = []
    stack: list[dict] = []
    still_open: Counter[str] = Counter()

    def put(piece: str) -> None:
        nonlocal at
        markup.append(piece)
        at += len(piece)

    def put_text(piece: str, decode: bool = True) -> None:
        if not piece:
            return
        put(piece)
        text = html.unescape(piece) if decode and "&" in piece else piece
        if not text:  # character references to nothing
            return
        shown.add(text)
        if not (stack and stack[-1]["hidden"]):
            seen.add(text)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            node = stack.pop()
            still_open[node["tag"]] -= 1
            put(f"</{node['tag']}>")
            node.update(post=len(nodes) - 1, stop=at, text_end=len(shown), seen_end=len(seen))

    def close_nearest(tags, borders) -> None:
        if not any(still_open[tag] for tag in tags):
            return
        for index in range(len(stack) - 1, -1, -1):
            tag = stack[index]["tag"]
            if tag in tags:
                close(index)
                return
            if tag in borders:
                return

    def open_element(tag: str, attributes: str, raw: str) -> None:
        if tag in _ENDS_P:
            close_nearest(("p",), _P_BORDERS)
        if tag in _IMPLIED_END:
            close_nearest(*_IMPLIED_END[tag])
        named = {"class": "", "id": ""}
        if attributes:
            for found in _ATTRIBUTE.finditer(attributes):
                key = found.group(1).lower()
                if key in named:
                    named[key] = named[key] or html.unescape(found.group(2) or found.group(3) or found.group(4) or "")
        parent = stack[-1] if stack else None
        node = {
            "pre": len(nodes), "post": len(nodes), "depth": len(stack), "tag": tag,
            "cls": named["class"], "id": named["id"],
            "hidden": tag in SCORE_DROP_TAGS or bool(parent and parent["hidden"]),
            "start": at, "text_start": len(shown), "seen_start": len(seen),
        }
        put(raw)
        node.update(stop=at, text_end=len(shown), seen_end=len(seen))
        nodes.append(node)
        if tag not in _VOID:
            stack.append(node)
            still_open[tag] += 1

    position, size = 0, len(page)
    while position < size:
        found = _MARKUP.search(page, position)
        if not found:
            put_text(page[position:])
            break
        put_text(page[position:found.start()])
        position = found.end()
        if not found.group(2):
            put(found.group(0))
            continue
        tag = found.group(2).lower()
        if found.group(1):
            if not still_open[tag]:
                continue
            for index in range(len(stack) - 1, -1, -1):
                if stack[index]["tag"] == tag:
                    close(index)
                    break
            continue
        open_element(tag, found.group(3), found.group(0))
        if tag in _RAW_TEXT:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, position)
            put_text(page[position:end.start() if end else size], decode=False)
            position = end.end() if end else size
            close(len(stack) - 1)
    close(0)

    shown.finish()
    seen.finish()
    link_sizes = []
    for node in nodes:
        node["text_bytes"] = shown.trimmed_bytes(node["text_start"], node["text_end"])
        node["visible_bytes"] = seen.trimmed_bytes(node["seen_start"], node["seen_end"])
        node["words"] = seen.word_count(node["seen_start"], node["seen_end"]) if node["tag"] in SCORED_TAGS else 0
        link_sizes.append(node["visible_bytes"] if node["tag"] == "a" and not node["hidden"] else 0)

    def counter(tags) -> accumulate:
        return accumulate(int(n["tag"] in tags and not n["hidden"]) for n in nodes)

    runs = zip(
        counter(("p",)), accumulate(link_sizes), counter(_HEADINGS), counter(("img",)), counter(_LISTS), strict=True
    )
    rows = [
        (
            n["pre"], n["post"], n["depth"], n["tag"], n["cls"], n["id"], n["text_bytes"], n["visible_bytes"],
            n["hidden"], n["start"], n["stop"], *run, n["words"],
        )
        for n, run in zip(nodes, runs, strict=True)
    ]
    return "".join(markup), rows


@F.arrow_udf(TREE_TYPE)
def _page_tree(pages: pa.Array) -> pa.Array:
    markups, columns, offsets, missing, total = [], [[] for _ in NODE_FIELDS], [0], [], 0
    for page in pages.to_pylist():
        if page:
            markup, rows = encode_page(page)
            for column, values in zip(columns, zip(*rows), strict=False):
                column.extend(values)
            total += len(rows)
        else:
            markup = None
        markups.append(markup)
        missing.append(markup is None)
        offsets.append(total)
    flat = pa.StructArray.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _NODE_ARROW, strict=True)], fields=_NODE_ARROW
    )
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
    return pa.StructArray.from_arrays(
        [pa.array(markups, pa.string()), nodes], names=["markup", "nodes"], mask=pa.array(missing, pa.bool_())
    )


def page_tree(html_text) -> Column:
    """The tree of a page; null for a null or empty page (no work is done then)."""
    return _page_tree(as_col(html_text))
