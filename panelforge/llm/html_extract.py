"""Main text of web pages by a tree-structured graphical model.

The variables are the block-level DOM nodes of a page: is a node's own text part of the article? A node's potential
comes from its tag, its class and id words and the shape of its text, a parent-child potential from the labels of both
and the child's kind of tag. Sum-product messages go from the leaves to the root and back, for all pages of a batch at
once, level by level, and give each node's exact marginal. Weights are learned from labelled pages by following the
gradient of the likelihood: what the labels hold less what the marginals expect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import modest_batches, table
from .html_tree import Node, attributes, read
from .labelled_pages import labelled_pages

BUCKETS = 1 << 13
LABEL = "data-article"
STRUCTURE = {t: k for k, ts in enumerate((("article", "main"), ("nav", "aside", "footer", "header", "form"), ("div", "section", "body", "html", "#root"))) for t in ts}
KINDS = 4  # of child tags for the parent-child potentials; the last is any other tag
PAGES_AT_ONCE = 128
NEAREST = 32  # ancestors with names or structure whose features a node gets: work on a page is linear in its nodes
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _bucket(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % BUCKETS


class Names(dict):
    """feature name -> bucket, remembered up to a bound."""

    def __missing__(self, name: str) -> int:
        if len(self) >= 50_000:
            self.clear()
        out = self[name] = _bucket(name)
        return out


def _log_bin(n: int) -> int:
    return min(n.bit_length(), 10)


def features_of(nodes: list[Node], texts: list[str], names: Names) -> list[list[int]]:
    """Buckets of each node's features, from the node itself and what it holds."""
    n = len(nodes)
    chars, links, words = [0] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        own = sum(len(texts[b]) for b in node.blocks)
        chars[k] += own
        links[k] += min(node.link_chars, own)
        if node.parent >= 0:
            chars[node.parent] += chars[k]
            links[node.parent] += links[k]
        words[k] = own
    out, around = [], []  # around: what a node's children have above them, for NEAREST ancestors at most
    for k, node in enumerate(nodes):
        tag, own = node.tag, words[k]
        parent = nodes[node.parent].tag if node.parent >= 0 else ""
        density = 4 * links[k] // max(chars[k], 1)
        f = ["", f"t {tag}", f"o {_log_bin(own)}", f"l {density}", f"t {tag} l {density}", f"t {tag} p {parent}", f"t {tag} o {_log_bin(own)}", f"a {_log_bin(chars[k])}", f"t {tag} c {min(node.children, 3)}", f"d {min(node.depth, 6)}"]
        chain = around[node.parent] if node.parent >= 0 else ()
        above = frozenset().union(*chain)
        f += sorted(above)
        mine = {f"in {tag}" if f"in {tag}" not in above else f"in {tag} twice"} if tag in STRUCTURE or tag in ("ul", "ol", "table") else set()
        if node.controls:
            f.append("controls")
        if node.attrs:
            got = attributes(node.attrs)
            found = {w.lower() for w in _NAME.findall(f"{got.get('class', '')} {got.get('id', '')}")}
            f += [f"n {w}" for w in sorted(found)]
            mine |= {f"in .{w}" for w in found}
            if "role" in got:
                f.append(f"r {got['role'].lower()}")
        around.append((*chain[-NEAREST + 1 :], frozenset(mine)) if mine else chain)
        out.append([names[x] for x in f])
    return out


class Forest:
    """The trees of many pages as arrays."""

    def __init__(self, pages: list[tuple[list[Node], list[str]]], names: Names) -> None:
        parent, depth, kind, cols, rows, at = [], [], [], [], [], 0
        for nodes, texts in pages:
            for k, (node, f) in enumerate(zip(nodes, features_of(nodes, texts, names), strict=True)):
                parent.append(node.parent + at if node.parent >= 0 else -1)
                depth.append(node.depth)
                kind.append(STRUCTURE.get(node.tag, KINDS - 1))
                cols += f
                rows += [at + k] * len(f)
            at += len(nodes)
        self.n = at
        self.parent, self.kind = np.array(parent, np.int64), np.array(kind, np.int64)
        self.cols, self.rows = np.array(cols, np.int64), np.array(rows, np.int64)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))[1:]

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label = 1) of each node; P(parent's label, own label) of each node with a parent. pair: (kind, parent,
        child) log potentials."""
        local = np.zeros((self.n, 2))
        local[:, 1] = np.bincount(self.rows, weights[self.cols], self.n)
        up = np.zeros((self.n, 2))  # log messages to the parent
        below = local.copy()  # own potential and messages from the children
        for level in reversed(self.levels):
            x = pair[self.kind[level]] + below[level][:, None, :]
            up[level] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            np.add.at(below, self.parent[level], up[level])
        down = np.zeros((self.n, 2))  # log messages from the parent
        joint = np.zeros((self.n, 2, 2))
        for level in self.levels:
            above = below[self.parent[level]] + down[self.parent[level]] - up[level]
            x = pair[self.kind[level]] + above[:, :, None]
            message = np.logaddexp(x[:, 0], x[:, 1])
            down[level] = message - message.max(1, keepdims=True)
            j = x + below[level][:, None, :]
            j = np.exp(j - j.max((1, 2), keepdims=True))
            joint[level] = j / j.sum((1, 2), keepdims=True)
        belief = below + down
        return 0.5 * (1 + np.tanh((belief[:, 1] - belief[:, 0]) / 2)), joint


class TreeModel:
    def __init__(self, weights: np.ndarray, pair: np.ndarray) -> None:
        self.weights, self.pair = weights, pair

    def texts(self, pages: list[str | None], names: Names) -> list[str]:
        trees = [read(p) for p in pages]
        forest = Forest(trees, names)
        p, _ = forest.marginals(self.weights, self.pair)
        out, at = [], 0
        for nodes, texts in trees:
            chosen = sorted(b for k, node in enumerate(nodes) if node.blocks and p[at + k] > 0.5 for b in node.blocks)
            out.append("\n\n".join(texts[b] for b in chosen))
            at += len(nodes)
        return out


def fit(pages: list[str], steps: int = 150, l2: float = 2e-4) -> TreeModel:
    """pages: HTML whose elements have LABEL attributes; an element without one has its parent's label."""
    names, trees, labels = Names(), [read(p) for p in pages], []
    for nodes, _ in trees:
        at = len(labels)
        for node in nodes:
            own = attributes(node.attrs).get(LABEL)
            labels.append(int(own) if own is not None else labels[at + node.parent] if node.parent >= 0 else 0)
    forest, y = Forest(trees, names), np.array(labels)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[inner], y[forest.parent[inner]], y[inner]), 1.0)
    theta, pair = np.zeros(BUCKETS), np.zeros((KINDS, 2, 2))
    state = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(pair), np.zeros_like(pair)]
    for step in range(1, steps + 1):
        p, joint = forest.marginals(theta, pair)
        expected = np.zeros_like(pair)
        np.add.at(expected, forest.kind[inner], joint[inner])
        grads = np.bincount(forest.cols, (y - p)[forest.rows], BUCKETS) / forest.n - l2 * theta, (seen - expected) / forest.n - l2 * pair
        for k, (x, g) in enumerate(zip((theta, pair), grads, strict=True)):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g**2 - s)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return TreeModel(theta, pair)


def main_text(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty html has the empty text, as has a page without an article. Each row has its own result, repeated
    ones too; ids and urls may be null. No rows give no rows. Other columns are ignored."""
    modest_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = Names()
        for html in batches:
            pages, out = html.tolist(), []
            for k in range(0, len(pages), PAGES_AT_ONCE):
                out += model.texts(pages[k : k + PAGES_AT_ONCE], names)
            yield pd.Series(out, dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(F.col(html_col)).alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), fit(labelled_pages()))
