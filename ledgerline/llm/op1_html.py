"""HTML main text by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in order: text between block-level tags, with the tags, classes,
ids and roles of its ancestors. Each block has features of those and of its text; a two-state
linear-chain CRF (content, boilerplate) scores a page's blocks together, and Viterbi decoding
picks the content. It is trained by gradient steps on labelled pages: TRAIN_PAGES pages at most
(documented bound), labelled by their markup where that is plain (see `mark`), once as they are
and once with sectioning tags turned into bare `div` with class names, so that text features
and classes are learned too. All pages are decoded, whole.

Scripts, styles and the head are no blocks. Nulls: a null html is an empty page, whose text is
empty. Rows that repeat are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_fraction, session, table

TRAIN_PAGES, EPOCHS, STEP, DECAY, SEED = 300, 12, 0.3, 1e-4, 5
#: Tags that end a block.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Tags whose text is never shown as running text.
SILENT = set("script style head title noscript template svg math iframe object canvas audio video textarea button select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that never stand within a head, control or drawing: they close one that was left open.
OUTSIDE = set("body article section main p h1 h2 h3 h4 h5 h6 ul ol table blockquote".split())
LEFT_OPEN = SILENT - set("script style template".split())
#: Open tags that a new block closes implicitly.
CLOSED_BY_BLOCK = {"p"}
#: Words in class names, ids and roles that tell boilerplate and content when pages are labelled.
BAD = set("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright sidebar side aside related recommended widget social share sharing comment comments reply replies respond disqus notice cookie cookies consent alert popup modal newsletter subscribe signup login form search pagination pager tags meta toolbar skip".split())
GOOD = set("article content main post entry body story text".split())
BAD_TAGS = set("nav header footer aside form menu dialog search".split())
PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Blocks(HTMLParser):
    """Leaf blocks of a page: (ancestors' tags, ancestors' words, text, characters in links)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.out: list[tuple[list[str], list[str], str, int]] = []
        self.text: list[str] = []
        self.linked = self.silent = self.anchors = 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.out.append(([t for t, _ in self.open if t in BLOCKS], [w for _, words in self.open for w in words], text, self.linked))
        self.text, self.linked = [], 0

    def close_to(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.silent -= tag in SILENT
            self.anchors -= tag == "a"
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
            return
        if tag in OUTSIDE:
            at = next((i for i, (name, _) in enumerate(self.open) if name in LEFT_OPEN), None)
            if at is not None:
                self.flush()
                self.close_to(at)
        if tag in BLOCKS:
            self.flush()
            for at in range(len(self.open) - 1, -1, -1):
                name = self.open[at][0]
                if name in CLOSED_BY_BLOCK or name == tag == "li":
                    self.close_to(at)
                    break
                if name in BLOCKS:
                    break
        if tag in VOID:
            return
        words = tuple(w for k, v in attrs if k in ("class", "id", "role", "itemprop") and v for w in PART.findall(v.lower()))
        self.open.append((tag, words))
        self.silent += tag in SILENT
        self.anchors += tag == "a"

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self.close_to(at)
                break
            if tag not in BLOCKS and self.open[at][0] in BLOCKS:
                break

    def parse_marked_section(self, i, report=1):
        """Any `<![...>` is a comment, whatever stands in it."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            self.linked += len(data) if self.anchors else 0


def blocks(html: str | None) -> list[tuple[list[str], list[str], str, int]]:
    page = Blocks()
    page.feed(html or "")
    page.close()
    page.flush()
    return page.out


def mark(block) -> int:
    """1 content, 0 boilerplate, by plain markup."""
    tags, words, _, _ = block
    if BAD_TAGS & set(tags) or BAD & set(words):
        return 0
    return int("article" in tags or "main" in tags or bool(GOOD & set(words)))


def described(page: list) -> list[list[str]]:
    """Names of the features of each block that are on."""
    out = []
    for i, (tags, words, text, linked) in enumerate(page):
        n = len(text)
        density = linked / max(1, n)
        f = ["bias", f"leaf={tags[-1] if tags else ''}", f"length={min(6, int(np.log2(n + 1)) // 2)}", f"links={0 if density == 0 else 1 if density < 0.5 else 2}", f"stop={text[-1] in '.!?…:;\"”»'}", f"words={min(5, int(np.log2(text.count(' ') + 1)))}"]
        f += [f"in={t}" for t in set(tags)] + [f"word={w}" for w in set(words)]
        f += ["bad"] * bool(BAD & set(words)) + ["good"] * bool(GOOD & set(words)) + ["bad-tag"] * bool(BAD_TAGS & set(tags))
        f += ["first"] * (i == 0) + ["last"] * (i == len(page) - 1) + ["sign"] * bool(re.search("[©®™|·»]", text))
        out.append(f)
    return out


def plain(page: list, seed: int) -> list:
    """The page with its sectioning tags as divs with class names."""
    names = {"article": ("content", "post", "entry", "main")[seed % 4], "main": "main", "nav": ("menu", "navbar")[seed % 2], "header": "header", "footer": ("footer", "copyright")[seed % 2], "aside": ("sidebar", "related", "comments", "notice")[seed % 4], "form": "form"}
    return [([t if t not in names else "div" for t in tags], [*words, *(names[t] for t in tags if t in names)], text, linked) for tags, words, text, linked in page]


def chain(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of states (n, 2) and of steps (2, 2, summed)."""
    n = len(emit)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = emit[0]
    for i in range(1, n):
        a[i] = emit[i] + np.logaddexp(*(a[i - 1][:, None] + trans))
    for i in range(n - 2, -1, -1):
        b[i] = np.logaddexp(*(trans + emit[i + 1] + b[i + 1]).T)
    z = np.logaddexp(*a[-1])
    both = np.zeros((2, 2))
    for i in range(1, n):
        both += np.exp(a[i - 1][:, None] + trans + emit[i] + b[i] - z)
    return np.exp(a + b - z), both


def fit(pages: list[list]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature ids, their weights (features, 2) and transitions (2, 2), by AdaGrad steps."""
    ids: dict[str, int] = {}
    data = []
    for i, page in enumerate(p for p in pages if p):
        y = np.array([mark(x) for x in page])
        for version in (page, plain(page, i)):
            data.append(([np.array([ids.setdefault(f, len(ids)) for f in fs]) for fs in described(version)], y))
    w, t = np.zeros((len(ids), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-3), np.full_like(t, 1e-3)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            rows, y = data[k]
            p, both = chain(np.array([w[r].sum(0) for r in rows]), t)
            error = np.eye(2)[y] - p
            at = np.concatenate(rows)
            g = np.repeat(error, [len(r) for r in rows], axis=0)
            dense = np.zeros_like(w)
            np.add.at(dense, at, g)
            dense -= DECAY * w
            gw += dense**2
            w += STEP * dense / np.sqrt(gw)
            step = -both
            np.add.at(step, (y[:-1], y[1:]), 1)
            gt += step**2
            t += STEP * step / np.sqrt(gt)
    return ids, w, t


def viterbi(emit: np.ndarray, trans: np.ndarray) -> list[int]:
    best, back = emit[0], []
    for e in emit[1:]:
        s = best[:, None] + trans
        back.append(s.argmax(0))
        best = s.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def train(pages: DataFrame, most: int = TRAIN_PAGES):
    """The CRF from about `most` pages, chosen by a hash of their html; None without pages."""
    n = pages.where("html is not null").count()
    if not n:
        return None
    held = pages.where("html is not null").where(hash_fraction(SEED, F.col("html")) < min(1.0, most / n)).select("html").limit(2 * most).toPandas()
    return fit([blocks(h) for h in sorted(held["html"])])


def extract(html: str | None, model) -> str:
    page = blocks(html)
    if not page or model is None:
        return ""
    ids, w, t = model
    emit = np.array([w[[ids[f] for f in fs if f in ids]].sum(0) for fs in described(page)])
    return "\n".join(x[2] for x, y in zip(page, viterbi(emit, t)) if y)


def main_text(pages: DataFrame, model) -> DataFrame:
    """pages with text and n_chars."""
    session(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(htmls: pd.Series) -> pd.Series:
        return htmls.map(lambda h: extract(h, shared.value))

    return pages.withColumn("text", text("html")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, train(pages)).select("page_id", "url", "text", "n_chars")
