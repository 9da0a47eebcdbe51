"""Finding and cleaning the main block of a page.

All of it works on the elements of one page inside that page's row: no element
is ever shuffled, and pages of any number spread as the scan splits them.
The expressions are SQL text over the column that holds the element array
(``nodes``), see ``newsloom.functions.html_tree`` for its fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom import fixed_values as fixed
from newsloom.functions.html_tree import page_tree
from newsloom.functions.page import clean_attributes, jsonld_body


def page_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element."""
    trees = pages.select(key, page_tree(F.col(html)).alias("tree"))
    return trees.select(key, F.inline("tree.nodes"))


def _any_of(words: Sequence[str]) -> str:
    """A pattern that finds any of the literal words."""
    return "|".join("".join(c if c.isalnum() or c == "-" else "\\" + c for c in w) for w in words)


def _listed(words: Sequence[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- by selector -----------------------------------------------------------

def _selector_rank(node: str) -> str:
    """Position of the first selector the element satisfies; null if none."""
    cases = []
    for rank, (tag, field, test, value) in enumerate(fixed.SELECTORS):
        hit = f"{node}.tag = '{tag}'"
        if test == "contains":
            hit += f" AND contains({node}.{field}, '{value}')"
        elif test == "equals":
            hit += f" AND {node}.{field} = '{value}'"
        cases.append(f"WHEN {hit} THEN {rank}")
    return f"CASE {' '.join(cases)} END"


def selector_block(nodes: str = "nodes") -> Column:
    """Struct of the first container, by selector and then by place, with enough text."""
    return F.expr(f"""
        array_min(filter(
            transform(
                filter({nodes}, n -> n.text_bytes > {fixed.SELECTOR_MIN_BYTES}),
                n -> named_struct('rank', {_selector_rank('n')}, 'pre', n.pre, 'post', n.post,
                                  'start', n.start, 'stop', n.stop, 'text_bytes', n.text_bytes)),
            c -> c.rank IS NOT NULL))""")


# --- by score --------------------------------------------------------------

def _metrics(nodes: str) -> str:
    def inside(counter: str) -> str:
        """The counter's growth from the element itself to its last descendant."""
        return f"(element_at({nodes}, c.post + 1).{counter} - c.{counter})"

    return f"""
        transform(
            filter({nodes}, n -> n.tag IN ({_listed(fixed.SCORED_TAGS)}) AND NOT n.hidden),
            c -> named_struct(
                'pre', c.pre, 'post', c.post, 'depth', c.depth, 'tag', c.tag, 'cls', c.cls, 'id', c.id,
                'start', c.start, 'stop', c.stop, 'text_bytes', c.visible_bytes, 'words', c.words,
                'p_count', {inside('p_run')}, 'link_bytes', {inside('link_run')},
                'headings', {inside('heading_run')}, 'images', {inside('image_run')}, 'lists', {inside('list_run')},
                'link_density', {inside('link_run')} / greatest(1, c.visible_bytes)))"""


def block_metrics(nodes: str = "nodes") -> Column:
    """Array with the measures of every visible container."""
    return F.expr(_metrics(nodes))


def _score(block: str, scoring: str) -> str:
    names = f"concat_ws(' ', {block}.cls, {block}.id)"
    base = f"{block}.text_bytes / 100 + {block}.p_count * 10"
    links = f"IF({block}.link_density > {fixed.LINK_DENSITY_LIMIT}D, {block}.link_density * 100, 0D)"
    good, bad = f"{names} RLIKE r'{fixed.GOOD_NAME}'", f"IF({names} RLIKE r'{fixed.BAD_NAME}', 100D, 0D)"
    if scoring == "standard":
        total = f"{base} - {links} + IF({good}, 30D, 0D) - {bad}"
    elif scoring == "documented":
        total = (
            f"{base} + {block}.headings * 5 + {block}.images * 2 + {block}.lists * 3 - {links}"
            f" - IF({block}.depth > 8, 50D, 0D)"
            f" - IF({block}.p_count > 0 AND {block}.words < {block}.p_count * 20, 30D, 0D)"
            f" + IF({block}.tag IN ('article', 'main'), 30D, 0D) + IF({good}, 25D, 0D) - {bad}"
        )
    else:
        raise ValueError(f"unknown scoring: {scoring}")
    return f"IF({block}.text_bytes < {fixed.SCORE_MIN_BYTES}, 0D, {total})"


def block_score(block: str = "block", scoring: str = "standard") -> Column:
    """Score of a measured container.

    ``standard`` weighs text, paragraphs, links and names; ``documented`` is the
    longer published table with headings, images, lists, depth and sparseness.
    """
    return F.expr(_score(block, scoring))


def best_block(nodes: str = "nodes", min_score: float = fixed.MIN_SCORE, scoring: str = "standard") -> Column:
    """Struct of the container with the highest score (the first one on ties)."""
    return F.expr(f"""
        array_min(filter(
            transform({_metrics(nodes)},
                b -> named_struct('minus_score', -({_score('b', scoring)}), 'pre', b.pre, 'post', b.post,
                                  'start', b.start, 'stop', b.stop, 'text_bytes', b.text_bytes)),
            s -> -s.minus_score > {float(min_score)}D))""")


# --- cleaning --------------------------------------------------------------

def clean_block(
    markup: str = "markup",
    nodes: str = "nodes",
    block: str = "block",
    drop_hidden: str = "false",
    extra_classes: Sequence[str] = (),
    extra_ids: Sequence[str] = (),
) -> Column:
    """Markup of the block without the unwanted subtrees, attributes tidied.

    ``drop_hidden`` is a SQL condition: scripts, styles, forms and frames go too.
    """
    unwanted = f"""
        n.tag IN ({_listed(fixed.CLEAN_DROP_TAGS)})
        OR n.id RLIKE r'{_any_of((*fixed.CLEAN_DROP_IDS, *extra_ids))}'
        OR n.cls RLIKE r'{_any_of((*fixed.CLEAN_DROP_CLASSES, *extra_classes))}'
        OR (({drop_hidden}) AND n.hidden)"""
    kept = "concat(s.kept, substr({markup}, s.at + 1, greatest({stop} - s.at, 0)))"
    # a subtree inside one that is gone already starts before ``at`` and changes nothing
    return clean_attributes(F.expr(f"""
        aggregate(
            filter({nodes}, n -> n.pre BETWEEN {block}.pre AND {block}.post AND ({unwanted})),
            named_struct('at', {block}.start, 'kept', ''),
            (s, n) -> IF(n.start < s.at, s,
                         named_struct('at', n.stop, 'kept', {kept.format(markup=markup, stop='n.start')})),
            s -> {kept.format(markup=markup, stop=f'{block}.stop')})"""))


# --- the whole search ------------------------------------------------------

def main_content(
    pages: DataFrame,
    html: str = "html",
    min_score: float = fixed.MIN_SCORE,
    scoring: str = "standard",
    drop_scripts: bool = False,
    extra_classes: Sequence[str] = (),
    extra_ids: Sequence[str] = (),
) -> DataFrame:
    """Add ``content`` and ``origin`` (jsonld, selector, score or none).

    Pages with a JSON-LD body are not parsed; scoring is done only where no
    selector gave a block.
    """
    source = F.col(html)
    place = "named_struct('pre', {0}.pre, 'post', {0}.post, 'start', {0}.start, 'stop', {0}.stop)"
    block = f"""CASE WHEN _selected IS NOT NULL THEN {place.format('_selected')}
                     WHEN _scored IS NOT NULL THEN {place.format('_scored')} END"""
    drop_hidden = "true" if drop_scripts else "_selected IS NULL"
    cleaned = clean_block("_tree.markup", "_tree.nodes", "_block", drop_hidden, extra_classes, extra_ids)
    by_score = best_block("_tree.nodes", min_score, scoring)
    return (
        pages.withColumn("_jsonld", jsonld_body(source))
        .withColumn("_tree", page_tree(F.when(F.col("_jsonld").isNull(), source)))
        .withColumn("_selected", selector_block("_tree.nodes"))
        .withColumn("_scored", F.when(F.col("_selected").isNull(), by_score))
        .withColumn("_block", F.expr(block))
        .withColumns({
            "content": F.coalesce("_jsonld", F.when(F.col("_block").isNotNull(), cleaned), F.lit("")),
            "origin": F.expr("""CASE WHEN _jsonld IS NOT NULL THEN 'jsonld' WHEN _selected IS NOT NULL THEN 'selector'
                                     WHEN _scored IS NOT NULL THEN 'score' ELSE 'none' END"""),
        })
        .drop("_jsonld", "_tree", "_selected", "_scored", "_block")
    )
