"""Main text of web pages by a tree-structured graphical model.

DOM nodes carry a hidden state, content or not. Node factors are likelihood ratios of a node's features (its position
under the nearest article or boilerplate mark, element name, whole class tokens, size of its own text, share of its text
in links); pair factors are its state given its parent's and the kind of element. Both are counted on labelled pages,
where the article element alone marks the content, on top of stated starting counts for what those pages do not show.
Sum-product messages go from the leaves to the root and back in full; a text whose node's content marginal is over one
half is kept.

Tags, quotes and comments are read as the HTML standard does, in linear time: an unfinished tag runs to the end of the
page. A null or empty page gives an empty text, as does one without content. Pages are read one by one, so repeated rows
change nothing; an empty table gives an empty result, and without labelled pages the starting counts decide.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import append_columns, table

TRAIN_PAGES = 2_000
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)", re.S)
CLUE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACE = re.compile(r"\s+")
#: Elements of the HTML standard.
RAW = frozenset("script style noscript template iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
ASIDE = frozenset("head svg nav footer aside form button select menu dialog".split())
MAIN = frozenset(("article", "main"))
#: Words that class tokens of boilerplate are made of, and words that add nothing to them.
BOILER = frozenset(
    "ad ads advert advertisement advertising banner sidebar cookie cookies consent notice notices comment comments menu nav navbar "
    "navigation footer header promo related share sharing social breadcrumb breadcrumbs newsletter sponsor sponsored".split()
)
NEUTRAL = frozenset("area bar block bottom box container content inner left list main outer page right section site top widget wrap wrapper".split())

#: How far each feature may speak: its share is mixed with one half by this weight.
MIX = {"position": 0.04, "name": 0.5, "token": 0.3, "size": 0.3, "links": 0.3}
PAIR_MIX = 0.04
#: Starting counts (not content, content): for positions, and for a node's state under either state of its parent.
START = {("position", "main"): (1, 8), ("position", "aside"): (8, 1), ("position", "outside"): (8, 1)}
PAIR_START = {"main": ((1, 8), (1, 8)), "aside": ((8, 1), (8, 1)), "other": ((8, 1), (1, 8))}
TOKEN_SIGHTINGS = 20


def marks_boilerplate(token: str) -> bool:
    """Whether a whole class token says boilerplate: ``site-nav`` does, ``no-sidebar`` and ``share-price`` do not."""
    parts = [p for p in re.split("[-_]+", token) if p]
    return any(p in BOILER for p in parts) and all(p in BOILER or p in NEUTRAL for p in parts)


class Page:
    """Nodes in page order: parent, name, class tokens, and pieces of text (node, block number, text)."""

    def __init__(self, source: str):
        self.parent, self.name, self.tokens = [-1], ["#root"], [()]
        self.texts: list[tuple[int, int, str]] = []
        open_, names, at, block = [0], Counter(("#root",)), 0, 0
        while True:
            match = TOKEN.search(source, at)
            end = match.start() if match else len(source)
            if end > at:
                self.texts.append((open_[-1], block, source[at:end]))
            if not match:
                break
            at = match.end()
            if not match[2]:
                continue
            name = match[2].lower()
            block += name in BLOCK
            if match[1]:
                if names[name]:
                    while True:
                        last = self.name[open_.pop()]
                        names[last] -= 1
                        if last == name:
                            break
                continue
            if name in ("p", "li", "td", "tr", "dt", "dd", "option") and self.name[open_[-1]] == name:
                names[self.name[open_.pop()]] -= 1
            elif name in BLOCK and name != "br" and names["p"]:
                # A block ends the paragraph it stands in, unless another block lies between.
                for back in range(1, min(4, len(open_)) + 1):
                    above = self.name[open_[-back]]
                    if above == "p":
                        names.subtract(self.name[i] for i in open_[-back:])
                        del open_[-back:]
                    if above in BLOCK:
                        break
            self.parent.append(open_[-1])
            self.name.append(name)
            self.tokens.append(tuple(" ".join(x.strip("\"'") for x in CLUE.findall(match[3])).lower().split()) if "=" in match[3] else ())
            if name in RAW:  # inside raw text only its end tag counts
                found = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = found.end() if found else len(source)
            elif name not in VOID and not match[3].endswith("/"):
                open_.append(len(self.name) - 1)
                names[name] += 1

    def describe(self) -> None:
        """Kinds, positions, and features of the nodes."""
        n = len(self.name)
        size, linked, total = [0] * n, [0] * n, [0] * n
        for node, _, text in self.texts:
            size[node] += len(text.strip())
        in_link = [False] * n
        self.kind, self.position = ["other"] * n, [""] * n
        mains = not MAIN.isdisjoint(self.name)
        for i in range(1, n):
            name, above = self.name[i], self.position[self.parent[i]]
            in_link[i] = name == "a" or in_link[self.parent[i]]
            if name in MAIN:
                self.kind[i] = "main"
            elif name in ASIDE or (name == "header" and above != "main") or any(map(marks_boilerplate, self.tokens[i])):
                self.kind[i] = "aside"
            if self.kind[i] != "other":
                self.position[i] = self.kind[i]
            else:
                self.position[i] = above or ("outside" if mains else "")
        for i in range(n - 1, 0, -1):
            total[i] += size[i]
            linked[i] += size[i] if in_link[i] else 0
            total[self.parent[i]] += total[i]
            linked[self.parent[i]] += linked[i]
        self.features = [
            (
                ("position", self.position[i]), ("name", self.name[i]), ("size", str(min(3, size[i].bit_length() // 3))),
                ("links", str(2 * linked[i] // total[i] if total[i] else 0)), *(("token", t) for t in self.tokens[i]),
            )
            for i in range(1, n)
        ]

    def labels(self) -> list[int]:
        """1 inside an article or main element, 0 outside."""
        state = [0] * len(self.name)
        for i in range(1, len(state)):
            state[i] = int(self.name[i] in MAIN or state[self.parent[i]])
        return state


def count_pages(pages: list[str]) -> Counter:
    """Sightings of (group, key, state) on labelled pages; a pair's key holds its parent's state and its kind."""
    counts: Counter = Counter()
    for source in pages:
        page = Page(source)
        page.describe()
        state = page.labels()
        for i in range(1, len(state)):
            counts["pair", f"{state[page.parent[i]]}{page.kind[i]}", state[i]] += 1
            for group, key in page.features[i - 1]:
                counts[group, key, state[i]] += 1
    return counts


def make_model(counts: dict) -> dict:
    """Log likelihood ratios by feature, and pair factors (p00, p01, p10, p11) by kind."""
    counts = Counter(counts)
    pairs = {}
    for kind, start in PAIR_START.items():
        rows = []
        for above in (0, 1):
            seen = [start[above][s] + counts["pair", f"{above}{kind}", s] for s in (0, 1)]
            rows += [(1 - PAIR_MIX) * x / sum(seen) + PAIR_MIX / 2 for x in seen]
        pairs[kind] = tuple(rows)
    for (group, key), start in START.items():
        for s in (0, 1):
            counts[group, key, s] += start[s]
    nodes = {}
    for group, mix in MIX.items():
        keys = {k for g, k, _ in counts if g == group and k}
        whole = [max(sum(counts[group, k, s] for k in keys), 1) for s in (0, 1)]
        for key in keys:
            out, in_ = ((counts[group, key, s] + 0.1) / (whole[s] + 0.1 * len(keys)) for s in (0, 1))
            share = (1 - mix) * in_ / (in_ + out) + mix / 2
            nodes[group, key] = math.log(share / (1 - share))
    return {"nodes": nodes, "pairs": pairs}


def _odds(log: float) -> float:
    return math.exp(min(max(log, -300.0), 300.0))


def marginals(page: Page, model: dict) -> list[float]:
    """Log odds of content by messages up to the root and down again; parents come before children."""
    page.describe()
    parent, nodes = page.parent, model["nodes"]
    up = [0.0] + [sum(nodes.get(f, 0.0) for f in features) for features in page.features]
    pairs = [model["pairs"][k] for k in page.kind]
    sent = [0.0] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        p00, p01, p10, p11 = pairs[i]
        odds = _odds(up[i])
        sent[i] = math.log((p10 + p11 * odds) / (p00 + p01 * odds))
        up[parent[i]] += sent[i]
    belief = up
    for i in range(1, len(parent)):
        p00, p01, p10, p11 = pairs[i]
        odds = _odds(belief[parent[i]] - sent[i])
        belief[i] += math.log((p01 + p11 * odds) / (p00 + p10 * odds))
    return belief


def main_text(source: str | None, model: dict) -> str:
    if not source:
        return ""
    page = Page(source)
    content = marginals(page, model)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if content[node] > 0:
            blocks.setdefault(block, []).append(text)
    cleaned = (SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in blocks.values())
    return "\n".join(b for b in cleaned if b)


def fit_extractor(pages: DataFrame, rows: int = TRAIN_PAGES) -> dict:
    """Factors from at most ``rows`` different pages that hold an article or main element.

    The pages are picked by hash; only hashes leave the scan. They are counted where they lie, and counts are added.
    """
    marked = pages.filter(F.lower("html").rlike("<(article|main)\\b")).select("html", F.xxhash64("html").alias("h"))
    picked = marked.select("h").distinct().orderBy("h").limit(rows)
    texts = marked.join(F.broadcast(picked), "h").groupBy("h").agg(F.first("html").alias("html")).select("html")

    def count(batches):
        for batch in batches:
            found = count_pages(batch.column(0).to_pylist())
            keys = list(found)
            columns = [[k[j] for k in keys] for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
                 pa.array([found[k] for k in keys], pa.int64())], names=["part", "key", "state", "n"],
            )

    counts = texts.mapInArrow(count, "part string, key string, state int, n long").groupBy("part", "key", "state").agg(F.sum("n").alias("n"))
    # Rare names and tokens stay behind, so what is collected is bounded by the picked pages' size over TOKEN_SIGHTINGS.
    kept = counts.filter(~F.col("part").isin("token", "name") | (F.col("n") >= TOKEN_SIGHTINGS))
    return make_model({(r["part"], r["key"], r["state"]): r["n"] for r in kept.collect()})


def extract_text(pages: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    return append_columns(pages, ["html"], "text string", lambda found: [[main_text(x, model) for x in found]], keep)


def op8_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = extract_text(pages, fit_extractor(pages), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
