"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a node that is content or not. A node's label depends on its
parent's label and on the kind of element (the potential of the edge), and its features (words
of its attributes, how much text stands below it, how much of that in links) depend on its
label. Sum-product messages go from the leaves up and from the root down, which gives each
node's exact content marginal. Text is taken from nodes whose marginal is above one half.

Both kinds of potentials are smoothed counts over labelled pages: pages that mark their article
themselves (an ``article`` element, else ``main``), where what lies in it is content unless it
or something above it inside the article is boilerplate by name. Each labelled page is counted
twice, once with the mark seen as a plain container, which gives the potentials for pages
without any mark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molspark.llm import dom
from molspark.llm.common import slices

#: Pages that the potentials are counted on, as expected number of a hash sample.
LABELLED_PAGES = 600
#: Counts that every potential starts from, as if seen in labelled pages: of features, and of
#: edges (no, yes) by the parent's label. Without labelled pages labels are inherited.
PRIOR = 0.5
EDGES = {
    "marked": ((2.0, 0.02), (0.05, 100.0)),
    "unmarked": ((1.0, 0.3), (0.05, 100.0)),
}
#: Kinds whose edges are known beforehand.
FIXED = {"hidden": (1e6, 1e-3), "boiler": (1e6, 1e-3), "below boiler": (1e6, 1e-2), "main": (1e-1, 1e3)}
#: Below content a doubtful element is one thing as often as the other: its features and what
#: stands in it decide.
DOUBTFUL = ((1.0, 0.02), (1.0, 1.0))
KINDS = (*FIXED, "doubtful", "heading", "prose", "list", "table", "link", "container", "inline")


def _article(page: dom.Page) -> set[int]:
    """The nodes that mark the article: the first kind of mark that the page has, outside
    boilerplate if there is one outside."""
    below = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        named = page.marks[i].boiler or (page.tags[i] in dom.BOILER and page.tags[i] != "form")
        below[i] = below[page.parents[i]] or named
    plain = [i for i, tag in enumerate(page.tags) if tag == "article" and not page.marks[i].boiler]
    main = [i for i, tag in enumerate(page.tags) if (tag == "main" or page.marks[i].main) and not page.marks[i].boiler]
    named = [i for i, told in enumerate(page.marks) if told.content and not told.boiler and page.tags[i] in dom.BLOCKS]
    every = [[i for i in found if not below[i]] for found in (plain, main, named)] + [plain, main, named]
    return set(next((found for found in every if found), ()))


def kinds(page: dom.Page, marks: set[int]) -> list[str]:
    """A form outside the article is doubtful, because some wrap the page."""
    out: list[str] = []
    inside = [False] * len(page.tags)  # the article
    for i, tag in enumerate(page.tags):
        above = out[page.parents[i]] if i else ""
        inside[i] = i in marks or (i > 0 and inside[page.parents[i]])
        doubtful = tag == "form" and not inside[i]
        if tag in dom.HIDDEN or above == "hidden":
            kind = "hidden"
        elif page.marks[i].boiler or (tag in dom.BOILER and not doubtful):
            kind = "boiler"
        elif i in marks:
            kind = "main"
        elif above in ("boiler", "below boiler"):
            kind = "below boiler"
        elif doubtful or page.marks[i].doubtful:
            kind = "doubtful"
        elif tag in dom.HEADING:
            kind = "heading"
        elif tag in dom.PROSE:
            kind = "prose"
        elif tag in dom.LISTS:
            kind = "list"
        elif tag in dom.TABLES:
            kind = "table"
        elif tag == "a":
            kind = "link"
        elif tag in dom.BLOCKS:
            kind = "container"
        else:
            kind = "inline"
        out.append(kind)
    return out


def features(page: dom.Page) -> list[tuple[str, ...]]:
    """Text below each block and its share in links, in steps; other elements have none."""
    text, linked = [0] * len(page.tags), [0] * len(page.tags)
    for node, run in page.runs:
        if node >= 0:
            text[node] += len(run)
    for i in range(len(page.tags) - 1, 0, -1):
        if page.tags[i] in dom.HIDDEN:
            text[i] = linked[i] = 0
        if page.tags[i] == "a":
            linked[i] = text[i]
        text[page.parents[i]] += text[i]
        linked[page.parents[i]] += linked[i]
    told = []
    for tag, n, links in zip(page.tags, text, linked, strict=True):
        block = tag in dom.BLOCKS or tag in dom.PROSE
        told.append((f"length {min(6, n.bit_length() // 2)}", f"links {int(4 * links / n) if n else 5}") if block else ())
    return told


def labels(page: dom.Page, marks: set[int], kind: list[str]) -> list[int]:
    """1 for the marked nodes and what lies in them outside boilerplate."""
    out = [0] * len(kind)
    for i in range(1, len(kind)):
        out[i] = int(kind[i] not in ("boiler", "below boiler", "hidden") and (i in marks or out[page.parents[i]]))
    return out


def _tally(page: dom.Page, counts: Counter) -> None:
    marks = _article(page)
    if not marks or all(page.tags[i] not in ("article", "main") for i in marks):
        return
    kind, told = kinds(page, marks), features(page)
    truth = labels(page, marks, kind)
    for marked in ("marked", "unmarked"):
        for i in range(1, len(kind)):
            if kind[i] == "doubtful" and truth[page.parents[i]]:
                continue  # the mark does not tell
            seen = "container" if marked == "unmarked" and kind[i] == "main" else kind[i]
            counts[marked, "edge", seen, truth[page.parents[i]], truth[i]] += 1
            for value in told[i]:
                counts[marked, "node", value, -1, truth[i]] += 1


@dataclass
class Potentials:
    edge: dict[tuple[str, str], tuple[tuple[float, float], tuple[float, float]]]
    node: dict[tuple[str, str], tuple[float, float]]

    @staticmethod
    def of(counts: dict[tuple, float]) -> Potentials:
        edge: dict[tuple[str, str], tuple] = {}
        node: dict[tuple[str, str], tuple] = {}
        totals: dict[tuple[str, str, int], float] = {}
        get = lambda *key: counts.get(key, 0)
        for (marked, sort, value, _, label), n in counts.items():
            if sort == "node":
                family = value.split()[0]
                totals[marked, family, label] = totals.get((marked, family, label), 0) + n
        for marked in ("marked", "unmarked"):
            for kind in KINDS:
                rows = []
                for above in (0, 1):
                    prior = DOUBTFUL[above] if kind == "doubtful" else FIXED.get(kind, EDGES[marked][above])
                    no, yes = get(marked, "edge", kind, above, 0) + prior[0], get(marked, "edge", kind, above, 1) + prior[1]
                    rows.append((no / (no + yes), yes / (no + yes)))
                edge[marked, kind] = tuple(rows)
            for value in [f"length {k}" for k in range(7)] + [f"links {k}" for k in range(6)]:
                family = value.split()[0]
                node[marked, value] = tuple(
                    (get(marked, "node", value, -1, label) + PRIOR) / (totals.get((marked, family, label), 0) + 7 * PRIOR) for label in (0, 1)
                )
        return Potentials(edge, node)


def marginals(page: dom.Page, potentials: Potentials) -> list[float]:
    """The probability of each node to be content, by one pass up and one down the tree."""
    marks = _article(page)
    marked = "marked" if marks else "unmarked"
    kind, told = kinds(page, marks), features(page)
    n = len(kind)
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n  # evidence below and at a node, by its label
    message: list[tuple[float, float]] = [(1.0, 1.0)] * n  # what a node tells its parent
    for i in range(n):
        no = yes = 1.0
        for value in told[i]:
            p = potentials.node[marked, value]
            no, yes = no * p[0], yes * p[1]
        up[i] = (no, yes)
    for i in range(n - 1, 0, -1):
        rows = potentials.edge[marked, kind[i]]
        told_up = tuple(rows[above][0] * up[i][0] + rows[above][1] * up[i][1] for above in (0, 1))
        total = told_up[0] + told_up[1]
        message[i] = (told_up[0] / total, told_up[1] / total)
        above = up[page.parents[i]]
        no, yes = above[0] * message[i][0], above[1] * message[i][1]
        up[page.parents[i]] = (no / (no + yes), yes / (no + yes)) if no + yes > 0 else (0.5, 0.5)
    out = [0.0] * n
    down: list[tuple[float, float]] = [(1.0, 0.0)] * n  # what comes from above; the root is no content
    for i in range(n):
        if i:
            parent = page.parents[i]
            # the parent's belief without what this node told it
            rest = [down[parent][k] * up[parent][k] / max(message[i][k], 1e-300) for k in (0, 1)]
            rows = potentials.edge[marked, kind[i]]
            told_down = tuple(rest[0] * rows[0][k] + rest[1] * rows[1][k] for k in (0, 1))
            total = told_down[0] + told_down[1]
            down[i] = (told_down[0] / total, told_down[1] / total) if total > 0 else (0.5, 0.5)
        no, yes = down[i][0] * up[i][0], down[i][1] * up[i][1]
        out[i] = yes / (no + yes) if no + yes > 0 else 0.0
    return out


def main_text(html: str, potentials: Potentials) -> str:
    page = dom.parse(html)
    content = marginals(page, potentials)
    hidden = [False] * len(content)
    for i in range(1, len(content)):
        hidden[i] = hidden[page.parents[i]] or page.tags[i] in dom.HIDDEN
    taken = [" " if node < 0 else run for node, run in page.runs if node < 0 or (content[node] > 0.5 and not hidden[node])]
    return " ".join("".join(taken).split())


def fit(pages: DataFrame, html: str = "html") -> Potentials:
    """Count the potentials over about ``LABELLED_PAGES`` pages; the number of different counts
    is fixed by the kinds and features. Without labelled pages the priors alone hold."""
    rate = min(1.0, LABELLED_PAGES / max(1, pages.count()))
    sample = pages.where(F.pmod(F.xxhash64(html), F.lit(1 << 20)) < rate * (1 << 20)).select(html)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                _tally(dom.parse(text or ""), counts)
        keys = list(counts)
        columns = [pa.array([k[j] for k in keys], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], ["marked", "sort", "value", "above", "label", "n"])

    schema = "marked string, sort string, value string, above int, label int, n long"
    summed = sample.mapInArrow(count, schema).groupBy("marked", "sort", "value", "above", "label").agg(F.sum("n").alias("n"))
    return Potentials.of({tuple(row[:5]): row[5] for row in summed.collect()})


def extract(pages: DataFrame, potentials: Potentials, html: str = "html", out: str = "text") -> DataFrame:
    """Replace ``html`` by ``out``: the blocks of the main text in page order, joined by a space.

    Character references are decoded, white space becomes one space and the ends are trimmed. A
    null, empty or contentless page gives the empty string. Broken and cut markup is read as far
    as it goes. Other columns and all rows are kept, repeated ones too; the potentials are a
    fixed small table.
    """
    rest = [c for c in pages.columns if c not in (html, out)]
    rows = pages.select(*rest, html)
    schema = T.StructType(list(pages.select(*rest).schema.fields)).add(out, "string")
    shared = pages.sparkSession.sparkContext.broadcast(potentials)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(text, shared.value) if text else "" for text in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*rest, out])

    return rows.mapInArrow(run, schema)
