"""Main text of web pages by a recurrent block labeller: a bidirectional LSTM over a page's leaf blocks, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.llm.common import small_batches
from tablewright.llm.textvec import trim

# What HTML says of its elements.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe select textarea option".split())
#: What may stand in a head; any other element, and text, ends a head whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
# Words in tags, classes and ids that speak for main text or against it.
AGAINST = frozenset(
    "nav navigation navbar menu menus breadcrumb breadcrumbs header masthead footer foot aside sidebar side rail notice notices cookie "
    "cookies consent banner alert ad ads adv advert adverts advertisement sponsor sponsored promo promotion form newsletter subscribe "
    "signup login comment comments reply replies respond discussion disqus related recommended recommendations share sharing social "
    "widget popup modal pagination pager tags copyright legal".split()
)
FOR = frozenset("article main content post entry story text body".split())

PATH_DIMS, WORD_DIMS, STATS, HIDDEN_UNITS = 192, 32, 11, 16
#: Pages that the labeller is trained on, at most, blocks of each, and passes over them.
SAMPLE, TRAIN_BLOCKS, EPOCHS = 400, 512, 12
#: Steps that training takes at least, of 16 pages each; few pages are passed over more often.
LEAST_STEPS = 200
#: Blocks, those filled in to a like length included, that are labelled in one go.
GO = 4096
PARTS = re.compile(r"[a-z0-9]+")


class Leaves(HTMLParser):
    """Collects (path, text, characters in links, numbers of the path's elements) of each run of text between block
    boundaries, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int]] = []
        self.elements = 0
        self.hidden = self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.found: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((tuple(d for _, d, _ in self.stack), text, self.linked, tuple(n for _, _, n in self.stack)))
        self.text, self.linked = [], 0

    def pop(self, upto: int) -> None:
        for tag, _, _ in self.stack[upto:]:
            self.hidden -= tag in HIDDEN
            self.links -= tag == "a"
        del self.stack[upto:]

    def end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":  # even out of an element that was left open in the head, but for a template
            open_ = [own for own, _, _ in self.stack]
            if "head" in open_ and "template" not in open_:
                self.pop(open_.index("head"))
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCK:
            self.end_block()
            for k in range(len(self.stack) - 1, -1, -1):  # what this element closes by starting
                own = self.stack[k][0]
                if own == "p" or own in CLOSED_BY.get(tag, ()):
                    self.pop(k)
                    break
                if own in BLOCK and own not in ("p",):
                    break
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        self.elements += 1
        self.stack.append((tag, f"{tag} {names.lower()}" if names else tag, self.elements))
        self.hidden += tag in HIDDEN
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCK:
            self.end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.pop(k)
                return
            if tag not in BLOCK and self.stack[k][0] in BLOCK:
                return  # a stray end of an inline element

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no declaration that the parser knows: a comment up to its ">", as HTML has it
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.text.append(data)
            self.linked += len(data) * bool(self.links)


def placed_leaves(html: str | None) -> list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    parser = Leaves()
    if isinstance(html, str):
        parser.feed(html)
        parser.close()
        parser.end_block()
    return parser.found


def leaves(html: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    return [b[:3] for b in placed_leaves(html)]


def elements(block: tuple) -> tuple:
    """Numbers of the elements around a block; where only its path is known, equal paths are one element."""
    return block[3] if len(block) > 3 else tuple(block[0][: k + 1] for k in range(len(block[0])))


def alike(a: Sequence, b: Sequence) -> int:
    """How many elements both begin with."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def layout(blocks: list[tuple]) -> np.ndarray:
    """What the page's structure says of each block, whatever its elements are called: where it stands to the element that
    holds most of the page's own text. That is found from the top down, as long as one child with several blocks holds
    three fifths of its parent's text outside links."""
    around = [elements(b) for b in blocks]
    weight = [max(0, len(b[1]) - b[2]) for b in blocks]
    total, inside, chain = max(1, sum(weight)), range(len(blocks)), []
    while True:
        held: dict = {}
        for k in inside:
            if len(around[k]) > len(chain):
                w, n = held.get(around[k][len(chain)], (0, 0))
                held[around[k][len(chain)]] = (w + weight[k], n + 1)
        several = [(w, e) for e, (w, n) in held.items() if n > 1]
        best = max(several, key=lambda x: x[0], default=(0, None))
        if best[0] == 0 or best[0] < 0.6 * sum(weight[k] for k in inside):
            break
        inside = [k for k in inside if len(around[k]) > len(chain) and around[k][len(chain)] == best[1]]
        chain.append(best[1])
    branch: dict = {}
    common, parts = [], []
    for own, w in zip(around, weight, strict=True):
        n = alike(own, chain)
        common.append(n)
        parts.append(own[n] if n < len(own) else ("end", n))
        branch[parts[-1]] = branch.get(parts[-1], 0) + w
    out, before = [], ()
    for own, n, part in zip(around, common, parts, strict=True):
        out.append((n == len(chain), min(len(chain) - n, 4) / 4, branch[part] / total, alike(own, before) / max(1, len(own)), min(len(own) - n, 6) / 6))
        before = own
    return np.array(out, np.float32).reshape(len(blocks), 5)


_hash: dict[str, int] = {}


def place(word: str) -> int:
    if len(_hash) > 500_000:
        _hash.clear()
    if word not in _hash:
        _hash[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return _hash[word]


def block_vectors(blocks: list[tuple], first: int = 0, total: int = 0, places: np.ndarray | None = None) -> np.ndarray:
    """A row for each block: hashed parts of its path, hashed words, a few shapes and its place in the page's layout. The
    blocks are those from `first` of a page that has `total` and this layout, or the whole page."""
    m = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + STATS), np.float32)
    total = total or len(blocks)
    places = layout(blocks) if places is None else places[first : first + len(blocks)]
    for k, (path, text, linked, *_) in enumerate(blocks):
        for part in path:
            for name in PARTS.findall(part):
                h = place(name)
                m[k, h % PATH_DIMS] += 1.0 if h >> 16 & 1 else -1.0
        words = text.split()
        w = np.bincount([place(x) % WORD_DIMS for x in words], minlength=WORD_DIMS)
        m[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.sqrt(w) / max(1.0, np.sqrt(len(words)))
        m[k, -STATS:] = (np.log1p(len(text)) / 6, np.log1p(len(words)) / 4, linked / len(text), (first + k + 1) / total, len(path) / 8, text[-1] in ".!?", 0, 0, 0, 0, 0)
    m[:, -5:] = places
    return m


def weak_labels(blocks: list[tuple]) -> list[int]:
    """What the names along the paths say, read together with the page: foreign names are foreign and article names main.

    A header inside an article is a part of it. What bears neither name is foreign where an article that the page names
    holds a good part of its text (a fifth for the elements article and main, half for other names); else it is main if it
    isn't mostly links, and, where an article is named at all, is a sentence of some length. On a page that names none it
    must stand in the element that the layout finds, or be the title over it.
    """
    places = layout(blocks)
    said, tagged, named, whole = [], 0, 0, 0
    for path, text, linked, *_ in blocks:
        article = foreign = tag = False
        for part in path:
            names = set(PARTS.findall(part))
            foreign |= bool(names & (AGAINST - {"header"} if article else AGAINST))
            tag |= part.split(" ", 1)[0] in ("article", "main")
            article |= tag or part.split(" ", 1)[0] != "body" and bool(names & FOR)
        own = max(0, len(text) - linked)
        said.append(0 if foreign else 1 if article else None)
        if not foreign:
            tagged, named, whole = tagged + own * (tag and article), named + own * article, whole + own
    closed = tagged * 5 > whole or named * 2 > whole
    some = any(x == 1 for x in said)
    out = []
    for x, (path, text, linked, *_), (inside, above, *_) in zip(said, blocks, places, strict=True):
        open_text = linked < len(text) / 2
        if some:
            open_text &= len(text) >= 60 and text[-1] in ".!?"
        else:
            open_text &= bool(inside or above <= 0.25 and path and path[-1].split(" ", 1)[0] == "h1")
        out.append(x if x is not None else int(open_text and not closed))
    return out


def varied(blocks: list, rng: np.random.RandomState, others: list[str]) -> list:
    """The page as other sites might have written it: containers renamed, foreign blocks inserted, remarks of readers in a
    container without a name (their texts from other pages), the title in a header of the article."""
    swaps = {
        "article": rng.choice(["article", "main", "div content", "section", "div post", "div entry", "main article"]),
        "nav": rng.choice(["nav", "div menu", "ul navigation", "div navbar", "header"]),
        "footer": rng.choice(["footer", "div footer", "div copyright", "div legal"]),
        "div ad": rng.choice(["div ad", "div banner", "aside", "div sponsor", "div promo", "div cookie notice", "aside sidebar"]),
    }
    out = [(tuple(swaps.get(p, p) for p in b[0]), b[1], b[2], elements(b)) for b in blocks]
    texts = [b[1] for b in blocks]
    for n in range(rng.randint(0, 4)):
        kind = rng.choice(["div comments", "aside", "form", "div related", "div sidebar", "section comments", "header", "div share", "div notice", "div newsletter"])
        at = rng.randint(0, len(out) + 1)
        around = out[at] if at < len(out) else (("html", "body"), "", 0, (0, 1))
        depth = min(len(around[0]), 2 + rng.randint(2))
        out.insert(at, ((*around[0][:depth], kind, "p"), texts[rng.randint(len(texts))], 0, (*around[3][:depth], f"new {n}", f"p {n}")))
    labels = weak_labels(out)
    main = [k for k, y in enumerate(labels) if y]
    if main and rng.rand() < 0.3:
        path, text, linked, own = out[main[0]]
        if len(path) > 2:
            out[main[0]] = ((*path[:-1], "header entry-header", path[-1]), text, linked, (*own[:-1], "header", own[-1]))
    remarks = []
    if main and rng.rand() < 0.5:
        path, _, _, own = out[main[-1]]
        depth = max(0, min(len(path) - 2, 2))
        for n in range(rng.randint(1, 5)):
            remarks.append(((*path[:depth], "div", "p"), others[rng.randint(len(others))], 0, (*own[:depth], "remarks", f"remark {n}")))
    after = main[-1] + 1 if main else 0
    return list(zip(out[:after] + remarks + out[after:], labels[:after] + [0] * len(remarks) + labels[after:], strict=True))


def nameless(block: tuple) -> tuple:
    """The block with nothing in its path that tells what a container is for."""
    tags = [part.split(" ", 1)[0] for part in block[0]]
    return (tuple("div" if t in AGAINST | FOR and t != "body" else t for t in tags), *block[1:])


@dataclass
class Labeller:
    """Weights of both directions (x and h to four gates, bias) and of the output."""

    w: dict[str, np.ndarray]

    def scan(self, d: str, x: np.ndarray, mask: np.ndarray, h: np.ndarray, c: np.ndarray, steps: list | None = None):
        """One direction over x, from the state (h, c): the states after each block, and the last."""
        out = np.zeros((*x.shape[:2], HIDDEN_UNITS), np.float32)
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            z = x[:, t] @ self.w[f"x{d}"] + h @ self.w[f"h{d}"] + self.w[f"b{d}"]
            s = 1.0 / (1.0 + np.exp(-z[:, : 3 * HIDDEN_UNITS]))
            g = np.tanh(z[:, 3 * HIDDEN_UNITS :])
            i, f, o = np.split(s, 3, 1)
            m = mask[:, t : t + 1]
            new = f * c + i * g
            tc = np.tanh(new)
            if steps is not None:
                steps.append((t, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out, h, c

    def chance(self, both: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(both @ self.w["out"] + self.w["out_b"])))

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: pages x blocks x dims; mask: which blocks are there. Probabilities, and what training needs if `keep`."""
        zero = np.zeros((len(x), HIDDEN_UNITS), np.float32)
        held: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.scan(d, x, mask, zero, zero, held[d] if keep else None)[0] for d in ("f", "b")], 2)
        p = self.chance(both)
        return (p, both, held) if keep else p

    def run_page(self, blocks: list) -> np.ndarray:
        """Probabilities of one page of any length: both directions go over it in parts, and only their states stay."""
        n = len(blocks)
        both, places = np.zeros((n, 2 * HIDDEN_UNITS), np.float32), layout(blocks)
        for k, d in enumerate(("f", "b")):
            h = c = np.zeros((1, HIDDEN_UNITS), np.float32)
            starts = list(range(0, n, GO))
            for a in starts if d == "f" else reversed(starts):
                x = block_vectors(blocks[a : a + GO], a, n, places)[None]
                out, h, c = self.scan(d, x, np.ones(x.shape[:2], np.float32), h, c)
                both[a : a + GO, k * HIDDEN_UNITS : (k + 1) * HIDDEN_UNITS] = out[0]
        return self.chance(both)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, both, held = self.run(x, mask, keep=True)
        dz = (p - y) * mask / max(1.0, mask.sum())
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"] = np.einsum("ptd,pt->d", both, dz)
        g["out_b"] = dz.sum(keepdims=True).reshape(1)
        dboth = dz[:, :, None] * self.w["out"]
        for n, d in enumerate(("f", "b")):
            dh_all = dboth[:, :, n * HIDDEN_UNITS : (n + 1) * HIDDEN_UNITS]
            dh_next = np.zeros((len(x), HIDDEN_UNITS), np.float32)
            dc_next = dh_next
            for t, h, c, i, f, o, gg, tc, m in reversed(held[d]):
                dh = dh_all[:, t] + dh_next
                dc = dc_next * m + dh * m * o * (1 - tc * tc)
                do, di, df, dg = dh * m * tc, dc * gg, dc * c, dc * i
                dzz = np.concatenate((di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), dg * (1 - gg * gg)), 1)
                g[f"x{d}"] += x[:, t].T @ dzz
                g[f"h{d}"] += h.T @ dzz
                g[f"b{d}"] += dzz.sum(0)
                dh_next = dzz @ self.w[f"h{d}"].T + dh * (1 - m)
                dc_next = dc * f + dc_next * (1 - m)
        return g


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(p) for p in pages)
    x = np.zeros((len(pages), longest, PATH_DIMS + WORD_DIMS + STATS), np.float32)
    mask = np.zeros((len(pages), longest), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


def train(pages: list[list], seed: int = 3) -> Labeller:
    """Fit to weak labels of the pages' blocks, each page in other dress in every pass, half of them with all names hidden
    after they were labelled, so that the layout has to tell; Adam."""
    rng, dims = np.random.RandomState(seed), PATH_DIMS + WORD_DIMS + STATS
    w = {}
    for d in ("f", "b"):
        w[f"x{d}"] = (rng.randn(dims, 4 * HIDDEN_UNITS) / np.sqrt(dims)).astype(np.float32)
        w[f"h{d}"] = (rng.randn(HIDDEN_UNITS, 4 * HIDDEN_UNITS) / np.sqrt(HIDDEN_UNITS)).astype(np.float32)
        w[f"b{d}"] = np.zeros(4 * HIDDEN_UNITS, np.float32)
        w[f"b{d}"][HIDDEN_UNITS : 2 * HIDDEN_UNITS] = 1
    w["out"], w["out_b"] = (rng.randn(2 * HIDDEN_UNITS) / 4).astype(np.float32), np.zeros(1, np.float32)
    net = Labeller(w)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    pages = [p for p in pages if p]
    texts = [b[1] for p in pages for b in p]
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(pages) // 16))) if pages else 0
    for epoch in range(epochs):
        rate = 0.01 * min(1.0, 2.0 * (epochs - epoch) / (epochs + 1))
        seen = [varied(p, rng, texts) if epoch % 3 else list(zip(p, weak_labels(p), strict=True)) for p in pages]
        seen = [[(nameless(b), y) for b, y in p] if rng.rand() < 0.5 else p for p in seen]
        seen.sort(key=len)
        batches = [seen[a : a + 16] for a in range(0, len(seen), 16)]
        for k in rng.permutation(len(batches)):
            x, mask = padded([block_vectors([b for b, _ in p]) for p in batches[k]])
            y = np.zeros_like(mask)
            for r, p in enumerate(batches[k]):
                y[r, : len(p)] = [label for _, label in p]
            step += 1
            for name, g in net.gradients(x, mask, y).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                w[name] -= (rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(net: Labeller, htmls: list[str | None]) -> list[str]:
    """The blocks that the labeller takes for main text, joined; pages of like length run together, GO blocks at most."""
    found = [placed_leaves(h) for h in htmls]
    out = [""] * len(htmls)
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    while order:
        most = max(16, 2 * len(found[order[0]]))
        part = [k for k in order[: max(1, GO // most)] if len(found[k]) <= most]
        order = order[len(part) :]
        if len(part) == 1:
            p = [net.run_page(found[part[0]])]
        else:
            p = net.run(*padded([block_vectors(found[k]) for k in part]))
        for r, k in enumerate(part):
            out[k] = "\n\n".join(b[1] for b, q in zip(found[k], p[r], strict=False) if q >= 0.5)
            found[k] = []
    return out


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Labeller:
    """Train on the `sample` pages whose html has the least hash, and of each on TRAIN_BLOCKS blocks in a row from anywhere.

    Hashes are chosen first and one page of each then reduced to its blocks, so html is not brought together.
    """

    def reduce(batches):
        for pdf in batches:
            found = [placed_leaves(h) for h in pdf.html]
            at = [int(k) % max(1, len(f) - TRAIN_BLOCKS + 1) for k, f in zip(pdf.k, found, strict=True)]
            found = [f[a : a + TRAIN_BLOCKS] for a, f in zip(at, found, strict=True)]
            yield pd.DataFrame({"k": pdf.k, "path": [[list(b[0]) for b in f] for f in found], "text": [[b[1] for b in f] for f in found], "linked": [[b[2] for b in f] for f in found], "own": [[list(b[3]) for b in f] for f in found]})

    own = pages.select(F.xxhash64(html_col, F.lit("html")).alias("k"), F.col(html_col).alias("html")).filter("html <> ''")
    chosen = own.select("k").distinct().orderBy("k").limit(sample)  # bounded, so it may be broadcast
    own = own.join(F.broadcast(chosen), "k").withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.lit(1)))).filter("nth = 1")
    small_batches(pages)
    got = own.select("k", "html").mapInPandas(reduce, "k long, path array<array<string>>, text array<string>, linked array<int>, own array<array<long>>").collect()
    got = sorted(got, key=lambda r: (r.k, r.text))
    return train([[(tuple(p), t, n, tuple(o)) for p, t, n, o in zip(r.path, r.text, r.linked, r.own, strict=True)] for r in got])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html column, with text (main blocks in page order, two line feeds between) and n_chars.

    A block is the text between block boundaries, character references decoded, white space turned into one space and
    trimmed; blocks without text don't count. Every block of every page gets the labeller's own verdict; a page of any
    length is labelled as a whole, in parts of GO blocks that hand on their state. A null or empty html gives an empty
    text. Repeated rows get equal texts; an empty table none. Other columns pass through, but for `text` and `n_chars`,
    which are replaced.
    """
    net = fit(pages, html_col)
    small_batches(pages)

    @F.pandas_udf("string")
    def main(htmls: pd.Series) -> pd.Series:
        out = main_texts(net, htmls.tolist())
        trim()
        return pd.Series(out, dtype=object)

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars", html_col)]
    out = pages.select(*rest, main(F.col(f"`{html_col}`")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
