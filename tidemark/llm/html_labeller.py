"""Main text of web pages: a bidirectional LSTM labels the sequence of text blocks of a page.

Each block is a vector of hashed names on its tag path, hashed words and four plain numbers; the recurrent network reads
the sequence forwards and backwards, so that every block is judged in the context of the whole page. Blocks it calls main
are joined by line feeds.

Training: no page is labelled, so the network learns from (a) pages of the table that mark their article or main element,
labelled by these marks and by the section elements inside them (at most ``SAMPLE_PAGES`` pages, those with the smallest
hash), and (b) ``MADE_PAGES`` page layouts drawn at random, which show the same roles under other names. Both are bounded
and seeded, so that a model depends on the sample alone.

Defined results: null and empty pages give an empty text; a page without any block called main gives an empty text;
repeated rows are extracted row by row; pages of any length and depth are read whole; a block at even odds is not main; an empty
table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .html_blocks import leaves

PATH_DIM, WORD_DIM, PLAIN = 192, 32, 4
DIM = PATH_DIM + WORD_DIM + PLAIN
HIDDEN = 16
SAMPLE_PAGES, MADE_PAGES, EPOCHS, BATCH = 200, 1200, 14, 48


@lru_cache(100_000)
def _slot(name: str, dim: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % dim


def block_vector(path: tuple[str, ...], text: str, linked: float, at: int) -> np.ndarray:
    v = np.zeros(DIM, np.float32)
    for name in path:
        v[_slot(name, PATH_DIM)] = 1
    words = text.encode("utf-8", "replace").split()
    slots = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % WORD_DIM
    v[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(slots, minlength=WORD_DIM) * (0.25 / max(1, len(words)))
    v[-4:] = np.log1p(len(text)) / 10, linked, sum(c in ".!?" for c in text[-1:]), min(1.0, at / 20)
    return v


class Labeller:
    """Numpy BiLSTM with one output per block; parameters of both directions are stacked in one array each."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"wx": rng.normal(0, 0.1, (2, DIM, 4 * h)), "wh": rng.normal(0, 0.2, (2, h, 4 * h)), "b": np.zeros((2, 4 * h)),
                  "wo": rng.normal(0, 0.3, (2 * h + DIM,)) * np.r_[np.ones(2 * h), np.zeros(DIM)], "bo": np.zeros(1)}
        self.p["b"][:, h : 2 * h] = 1
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def forward(self, x: np.ndarray, mask: np.ndarray):
        """x: (pages, blocks, DIM), mask: (pages, blocks). Returns logits and what the backward pass needs."""
        n, steps, _ = x.shape
        h = HIDDEN
        kept = []
        for d in range(2):
            order = range(steps) if d == 0 else range(steps - 1, -1, -1)
            pre = x.reshape(-1, DIM) @ self.p["wx"][d] + self.p["b"][d]
            pre = pre.reshape(n, steps, 4 * h)
            out, state, cell, trace = np.zeros((n, steps, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
            for t in order:
                g = pre[:, t] + state @ self.p["wh"][d]
                i, f, o, c = self._sig(g[:, :h]), self._sig(g[:, h : 2 * h]), self._sig(g[:, 2 * h : 3 * h]), np.tanh(g[:, 3 * h :])
                new = f * cell + i * c
                tc = np.tanh(new)
                m = mask[:, t, None]
                trace.append((t, state, cell, i, f, o, c, tc))
                state, cell = np.where(m, o * tc, state), np.where(m, new, cell)
                out[:, t] = state
            kept.append((out, trace))
        both = np.concatenate([kept[0][0], kept[1][0], x], -1)
        return both @ self.p["wo"] + self.p["bo"][0], both, kept

    def gradients(self, x, mask, y):
        h = HIDDEN
        logit, both, kept = self.forward(x, mask)
        p = self._sig(logit)
        err = ((p - y) * mask / max(1, mask.sum())).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["wo"], g["bo"][0] = np.einsum("nt,ntk->k", err, both), err.sum()
        for d in range(2):
            back = err[..., None] * self.p["wo"][d * h : (d + 1) * h]
            ds, dc = np.zeros((len(x), h), np.float32), np.zeros((len(x), h), np.float32)
            pre = np.zeros((*x.shape[:2], 4 * h), np.float32)
            for t, state, cell, i, f, o, c, tc in reversed(kept[d][1]):
                m = mask[:, t, None]
                ds = ds + back[:, t]
                dh, keep_s, keep_c = np.where(m, ds, 0), np.where(m, 0, ds), np.where(m, 0, dc)
                dn = np.where(m, dc, 0) + dh * o * (1 - tc * tc)
                gate = np.concatenate([dn * c * i * (1 - i), dn * cell * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - c * c)], 1)
                pre[:, t] = gate
                g["wh"][d] += state.T @ gate
                ds, dc = gate @ self.p["wh"][d].T + keep_s, dn * f + keep_c
            flat = pre.reshape(-1, 4 * h)
            g["wx"][d], g["b"][d] = x.reshape(-1, DIM).T @ flat, flat.sum(0)
        loss = -(np.log(np.clip(np.where(y > 0, p, 1 - p), 1e-9, 1)) * mask).sum() / max(1, mask.sum())
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 4) -> "Labeller":
        """Adam on batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        pages = sorted((p for p in pages if len(p[1])), key=lambda p: len(p[1]))
        batches = [pages[i : i + BATCH] for i in range(0, len(pages), BATCH)]
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for e in range(epochs):
            for k in rng.permutation(len(batches)):
                x, mask, y = padded([p[0] for p in batches[k]], [p[1] for p in batches[k]])
                _, g = self.gradients(x, mask, y)
                step += 1
                r = rate * (1 if e < epochs - 4 else 0.3)
                for name, a in g.items():
                    a = np.clip(a, -1, 1) + 1e-5 * self.p[name]
                    m[name] = 0.9 * m[name] + 0.1 * a
                    v[name] = 0.999 * v[name] + 0.001 * a * a
                    self.p[name] -= r * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages go in groups of similar length."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            n = max(1, min(64, 4096 // len(pages[order[at]])))
            while n > 1 and len(pages[order[min(at + n, len(order)) - 1]]) * n > 8192:
                n //= 2
            group = order[at : at + n]
            at += n
            x, mask, _ = padded([pages[k] for k in group])
            logit, _, _ = self.forward(x, mask)
            for k, row in zip(group, logit):
                out[k] = row[: len(pages[k])] > 0
        return out


def padded(xs, ys=None):
    steps = max(map(len, xs))
    x, mask, y = np.zeros((len(xs), steps, DIM), np.float32), np.zeros((len(xs), steps), bool), np.zeros((len(xs), steps), np.float32)
    for k, a in enumerate(xs):
        x[k, : len(a)], mask[k, : len(a)] = a, True
        if ys is not None:
            y[k, : len(a)] = ys[k]
    return x, mask, y


def vectors(blocks) -> np.ndarray:
    return np.array([block_vector(*b, k) for k, b in enumerate(blocks)], np.float32).reshape(len(blocks), DIM)


# -- training pages -----------------------------------------------------------------------------------------------------

#: Names that say what a section is for; any of them below an article takes its blocks out again.
BOILERPLATE = ("nav menu navbar breadcrumb breadcrumbs topbar masthead banner header footer bottom copyright legal sidebar aside rail widget related "
               "recommended more popular trending ad ads advert advertisement sponsor sponsored promo promotion notice cookie consent alert popup modal "
               "newsletter subscribe signup login search form comments comment reply replies disqus discussion share social tags pagination pager author").split()
MAIN = "content article post entry story body main text page node prose".split()


def marked(path: tuple[str, ...]) -> bool | None:
    """The label that a page's own marks give a block; None where the page marks no main part."""
    inside = [k for k, n in enumerate(path) if n in ("article", "main")]
    if not inside:
        return False
    return not any(n in ("nav", "aside", "footer", "form", "header") or n[:1] == "." and n[1:] in BOILERPLATE for n in path[inside[0] + 1 :])


def labelled_page(page: str):
    blocks = leaves(page)
    y = np.array([bool(marked(b[0])) for b in blocks])
    return (vectors(blocks), y) if y.any() else None


def made_page(rng: random.Random):
    """A random layout: an article part among parts of other roles, under varying tags and names."""
    word = lambda: "".join(rng.choice("aeioustrnlmdhcpg") for _ in range(rng.randint(2, 9)))
    line = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi))).capitalize()
    blocks, labels = [], []

    def add(path, text, linked, main):
        blocks.append((tuple(path), text, linked))
        labels.append(main)

    def named(tag, names):
        return [tag, *("." + n for n in rng.sample(names, min(len(names), rng.randint(1, 2))))]

    def boiler(base, inside=False):
        kind = rng.randrange(9)
        if kind == 0:
            path = [*base, *(["nav"] if rng.random() < 0.6 else named("div", ["menu", "nav", "navbar", "breadcrumb", "topbar"]))]
            for _ in range(rng.randint(2, 9)):
                add([*path, "ul", "li"], line(1, 2), 1.0, False)
        elif kind == 1:
            path = [*base, *(["header"] if rng.random() < 0.5 else named("div", ["header", "masthead", "banner", "topbar"]))]
            for _ in range(rng.randint(1, 3)):
                add([*path, rng.choice(["div", "p", "h1", "h2"])], line(1, 8), rng.choice([0.0, 1.0]), False)
        elif kind == 2:
            path = [*base, *(["footer"] if rng.random() < 0.6 else named("div", ["footer", "bottom", "copyright", "legal"]))]
            for _ in range(rng.randint(1, 4)):
                add([*path, *([] if rng.random() < 0.5 else [rng.choice(["p", "div", "li"])])], line(2, 14), rng.choice([0.0, 0.0, 1.0]), False)
        elif kind == 3:
            path = [*base, *(["aside"] if rng.random() < 0.5 else named("div", ["sidebar", "aside", "rail", "widget", "related", "recommended", "more", "popular", "trending"]))]
            add([*path, rng.choice(["h2", "h3", "h4"])], line(1, 4), 0.0, False)
            for _ in range(rng.randint(1, 6)):
                add([*path, rng.choice(["p", "li", "div"])], line(2, 25), rng.choice([0.0, 1.0]), False)
        elif kind == 4:
            path = [*base, *named(rng.choice(["div", "section", "aside", "p"]), ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion"])]
            for _ in range(rng.randint(1, 2)):
                add([*path, *([] if rng.random() < 0.6 else ["p"])], line(3, 20), rng.choice([0.0, 1.0]), False)
        elif kind == 5:
            path = [*base, *named(rng.choice(["div", "section", "p"]), ["notice", "cookie", "consent", "alert", "popup", "modal", "newsletter", "subscribe"])]
            add([*path, *([] if rng.random() < 0.6 else ["p"])], line(4, 25), 0.0, False)
        elif kind == 6:
            path = [*base, "form", *([] if rng.random() < 0.5 else named("div", ["search", "login", "signup", "subscribe", "form"]))]
            for _ in range(rng.randint(1, 4)):
                add([*path, rng.choice(["div", "p", "fieldset"])], line(1, 8), 0.0, False)
        elif kind == 7:
            path = [*base, *named(rng.choice(["div", "section", "ul", "aside", "ol"]), ["comments", "comment", "reply", "replies", "disqus", "discussion"])]
            if rng.random() < 0.6:
                add([*path, rng.choice(["h2", "h3"])], line(1, 3), 0.0, False)
            for _ in range(rng.randint(1, 7)):
                add([*path, *rng.choice([["p"], ["div", ".comment"], ["li", "p"], ["article", ".comment", "p"], ["div"], ["li"]])], line(3, 60), 0.0, False)
        else:
            path = [*base, *named(rng.choice(["div", "ul", "p"]), ["share", "social", "tags", "pagination", "pager", "author"])]
            for _ in range(rng.randint(1, 4)):
                add([*path, *([] if rng.random() < 0.5 else ["li"])], line(1, 3), 1.0, False)

    outer = ["html", "body"] + (named("div", ["wrapper", "page", "container", "site", "layout"]) if rng.random() < 0.4 else [])
    for _ in range(rng.randint(0, 4)):
        boiler(outer)
    shape = rng.randrange(6)
    own = [["article"], ["main"], ["main", "article"], named("div", MAIN), ["main", *named("div", MAIN)], ["article", *named("div", MAIN)]][shape]
    path = [*outer, *own]
    if rng.random() < 0.8:
        add([*path, *rng.choice([["h1"], ["h2"], ["header", "h1"]] if rng.random() < 0.1 else [["h1"], ["h2"]])], line(2, 12), 0.0, True)
        if "header" in blocks[-1][0]:
            labels[-1] = False
    for _ in range(rng.randint(0, 18)):
        add([*path, *rng.choices([["p"], ["ul", "li"], ["ol", "li"], ["blockquote", "p"], ["h2"], ["h3"], ["pre"], ["table", "tr", "td"], ["div"], ["section", "p"], []],
                                 [14, 2, 1, 1, 1, 1, 0.5, 0.5, 1, 1, 1])[0]], line(1, 120), rng.choice([0.0, 0.0, 0.0, 0.1, 0.3]), True)
        if rng.random() < 0.05:
            boiler(path, True)
    if rng.random() < 0.25:
        boiler(path, True)
    for _ in range(rng.randint(0, 4)):
        boiler(outer)
    return vectors(blocks), np.array(labels, bool)


def fit(pages: DataFrame) -> Labeller:
    """Trains on the driver, on the bounded sample named above."""
    hashed = pages.where("html IS NOT NULL").select(F.xxhash64("html").alias("hash"), "html")
    drawn = [r.hash for r in hashed.select("hash").distinct().orderBy("hash").limit(SAMPLE_PAGES).collect()]  # hashes first: pages are long
    rows = hashed.where(F.col("hash").isin(drawn)).groupBy("hash").agg(F.first("html").alias("html")).orderBy("hash").collect() if drawn else []
    rng = random.Random(11)
    made = [made_page(rng) for _ in range(MADE_PAGES)]
    found = [p for p in (labelled_page(r.html) for r in rows) if p is not None]
    return Labeller().fit([*found, *made])


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """page_id, url, text of every row; a narrow pass over whole pages."""
    model = model or fit(pages)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                blocks = [leaves(p.decode("utf-8", "replace")) for p in utf8(part["html"])]
                keep = model.main([vectors(x) for x in blocks])
                texts = ["\n".join(t for (_, t, _), k in zip(x, ks) if k) for x, ks in zip(blocks, keep)]
                yield pa.record_batch([part["page_id"].cast(pa.int64()), part["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id LONG, url STRING, text STRING")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
