"""Main-text extraction from HTML by tag-path ratios.

Each text node has a tag path, from the root to the element that holds it.
Text length and punctuation are added up by path and divided by the path's
nodes; along the page, these two ratios are smoothed over neighbouring nodes
and averaged by path again, which lifts a lone path among content ones (a
heading) and lowers one among clutter.  A path's score is the geometric mean of
its length ratio and its length weighted by punctuation; paths of at least
STRENGTH standard deviations are content, and so are all of their nodes.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRENGTH, SIGMA, REACH = 0.8, 1.0, 2
_KERNEL = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(script|style|noscript|template|svg|iframe)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|([^<]++|<)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends the open elements of the set, up to one of the second set.
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_BOUNDS = frozenset("article aside body div footer header main nav section table td th".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
_SPACE = re.compile(r"\s+")


def _close(stack: list[str], ends: frozenset, bounds: frozenset) -> None:
    """Takes off the outermost element of ends that stands above the innermost one of bounds, and all above it."""
    at = len(stack)
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] in ends:
            at = k
        elif stack[k] in bounds:
            break
    del stack[at:]


def text_nodes(page: str) -> list[tuple[str, int, str]]:
    """(tag path, block, text) of each text node that isn't white space; nodes of one block have no block-level tag between them."""
    stack: list[str] = []
    path, block, nodes, changed = "", 0, [], False
    for m in _TOKEN.finditer(page):
        text = m[6]
        if text is not None:
            if "&" in text:
                text = entities.unescape(text)
            if text.isspace():
                if nodes and nodes[-1][1] == block and not nodes[-1][2].endswith(" "):
                    nodes[-1] = (*nodes[-1][:2], nodes[-1][2] + " ")
                continue
            if changed:
                path, changed = "/".join(stack), False
            nodes.append((path, block, _SPACE.sub(" ", text)))
            continue
        name = m[3] or m[5]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            block += 1
        if m[2] or m[4]:
            if name in stack:
                while stack.pop() != name:
                    pass
                changed = True
            continue
        if name in _P_ENDS and "p" in stack:
            _close(stack, frozenset(["p"]), _BOUNDS)
            changed = True
        if name in _ENDS:
            _close(stack, *_ENDS[name])
            changed = True
        if name not in _VOID and not m[0].endswith("/>"):
            stack.append(name)
            changed = True
    return nodes


def content_paths(paths: np.ndarray, length: np.ndarray, marks: np.ndarray, n: int, strength: float = STRENGTH) -> np.ndarray:
    """Which of the n paths are content; paths, length and marks are each node's path, text length and punctuation."""
    nodes = np.bincount(paths, minlength=n)
    reach = np.convolve(np.ones(len(paths)), _KERNEL)[REACH:-REACH]
    smooth = []
    for value in (length, marks):
        ratio = np.bincount(paths, weights=value, minlength=n) / nodes
        along = np.convolve(ratio[paths], _KERNEL)[REACH:-REACH] / reach
        smooth.append(np.bincount(paths, weights=along, minlength=n) / nodes)
    fused = smooth[0] * np.sqrt(1 + smooth[1])
    spread = fused[paths].std()
    return fused >= min(strength * spread, fused.max())


def extract(page: str | None, strength: float = STRENGTH) -> tuple[str, int, int]:
    """(main text, text nodes, content nodes) of a page; content blocks are lines."""
    nodes = text_nodes(page or "")
    if not nodes:
        return "", 0, 0
    number: dict[str, int] = {}
    paths = np.array([number.setdefault(p, len(number)) for p, _, _ in nodes])
    length = np.array([len(t) for _, _, t in nodes], dtype=np.float64)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, _, t in nodes], dtype=np.float64)
    keep = content_paths(paths, length, marks, len(number), strength)[paths]
    lines: list[list[str]] = []
    last = None
    for ok, (_, block, text) in zip(keep.tolist(), nodes):
        if ok:
            if block != last:
                lines.append([])
                last = block
            lines[-1].append(text)
    return "\n".join(line for x in lines if (line := "".join(x).strip())), len(nodes), int(keep.sum())


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", strength: float = STRENGTH) -> DataFrame:
    """(page_id, text, n_nodes, n_content) for each row of pages, whatever its id.

    A null or empty page, or one without text, has an empty text and no nodes;
    markup that is never closed runs to the page's end.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [extract(x.as_py(), strength) for x in batch.column(1)]
            texts, nodes, content = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(nodes, pa.int64()), pa.array(content, pa.int64())], names=["page_id", "text", "n_nodes", "n_content"])

    return pages.select(F.col(id_col), F.col(html_col)).mapInArrow(run, f"page_id {kind}, text string, n_nodes long, n_content long")
