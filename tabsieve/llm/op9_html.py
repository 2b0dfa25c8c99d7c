"""HTML extraction: gradient-boosted trees over DOM-node features, hierarchical decoding.

A page becomes a tree of its block elements, with one row of features for each node: its tag, tokens of its class, id and role, depth, place among its siblings,
size of its subtree, text density, share of link text, punctuation, form controls and what its ancestors are. Three one-against-rest boosted models give
each node a probability of being main text (K), boilerplate (D) or a container of both (M). Decoding takes the most likely labelling of the whole tree in which
a D node has only D descendants and a K node only K or D ones, so no choice contradicts an ancestor's. Text is kept where the innermost block is K.

There are no labelled pages, so the models are trained on pages whose regions say what they are: a bounded sample of at most about `most_pages` pages with an
article, main or role=main element (semantic elements and telling class names give the labels), each also in a disguised variant in which semantic
elements become div elements with usual class names and notices, adverts, forms and reader comments are put in; and pages made by rule.

Distribution: the sample's features are made on the executors; extraction is one Arrow pass without a shuffle, features and trees vectorised over
about a MB of pages.

Defined results: null and empty html give empty text; pages without an element are one block of the body; malformed markup is read as browsers do in the
common cases (unclosed p, li, td; stray end tags; only raw-text elements such as script run to the end of a page); pages of any length are read whole; null or
repeated page_ids are extracted row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsieve.llm import trees

SUB_CHARS = 1 << 20
#: Comments and declarations; elements whose content is raw text up to their end tag or the end of the page; elements whose content is no text of the page, if
#: they are closed (an unclosed one hides nothing); tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|textarea|iframe|noembed|noframes|xmp)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|select|button|object|canvas|video|audio)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:(?!<\2\b).)*?</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTR = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
#: Block elements by group (fixed values); the groups are features.
GROUPS = (
    "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li", "ul ol dl menu dd dt", "table tbody thead tfoot tr td th caption", "nav", "header", "footer",
    "aside", "form fieldset legend dialog", "blockquote pre figure figcaption address details summary", "head title", "html body", "hr center hgroup search",
)
GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
VOID = frozenset("hr".split())
P_CLOSERS = frozenset(GROUP) - {"html", "body", "head", "title"}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
SCOPE = frozenset("ul ol dl table div article section main body td th".split())
#: Tokens of class, id and role that speak for main text, and against it (fixed values).
GOOD = frozenset("article content post entry story main body text page blog prose".split())
BAD = frozenset(
    "nav navbar navigation menu menubar footer foot header masthead topbar sidebar side aside ad ads adv advert advertisement banner bannerad sponsor sponsored promo promoted cookie cookies consent gdpr notice "
    "notification alert popup modal overlay newsletter subscribe signup comment comments respond reply discussion disqus share sharing social related recommended breadcrumb breadcrumbs "
    "pagination pager login search widget toolbar tags meta copyright complementary contentinfo skip hidden".split()
)
SEMANTIC_BAD = frozenset("nav footer aside form head title dialog menu search".split())
N_FEATURES = len(GROUPS) + 26
K, D, M = 0, 1, 2


class Page:
    """Block nodes in document order and the text segments between block boundaries. Only pages made for training are read with their labels."""

    __slots__ = ("tag", "parent", "end", "depth", "good", "bad", "forms", "label", "role_main", "text", "owner", "linked", "own", "links", "marks", "pieces", "words")

    def __init__(self, source: str, labelled: bool = False):
        self.tag, self.parent, self.end, self.depth, self.good, self.bad, self.forms, self.label, self.role_main = ["body"], [-1], [0], [0], [0], [0], [0], [None], [False]
        self.text, self.owner, self.linked = [], [], []
        stack, link = [0], False
        run: list[str] = []
        run_linked = 0

        def settle():
            nonlocal run_linked
            if run:
                t = "".join(run)
                t = " ".join((entities.unescape(t) if "&" in t else t).split())
                if t:
                    self.text.append(t)
                    self.owner.append(stack[-1])
                    self.linked.append(min(run_linked, len(t)))
                run.clear()
            run_linked = 0

        def close(k: int):
            for n in stack[k:]:
                self.end[n] = len(self.tag)
            del stack[k:]

        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                run.append(source[at : m.start()])
                if link:
                    run_linked += m.start() - at
            at = m.end()
            name = m[4]
            if name is None:
                if (m[1] or m[2] or "").lower() in ("textarea", "select", "button"):
                    self.forms[stack[-1]] += 1
                continue
            name = name.lower()
            if name not in GROUP:
                if name == "a":
                    link = not m[3]
                elif name == "br":
                    run.append(" ")
                elif name in ("input", "label", "option"):
                    self.forms[stack[-1]] += 1
                continue
            if name in ("html", "body") or name == "hr":
                settle()
                if name == "body" and not m[3]:
                    k = next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == "head"), 0)
                    if k:
                        close(k)
                continue
            settle()
            if m[3]:
                k = next((i for i in range(len(stack) - 1, 0, -1) if self.tag[stack[i]] == name), 0)
                if k:
                    close(k)
                continue
            if self.tag[stack[-1]] == "p" and name in P_CLOSERS:
                close(len(stack) - 1)
            elif name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    t = self.tag[stack[i]]
                    if t in CLOSES[name]:
                        close(i)
                        break
                    if t in SCOPE and not (name == "tr" and t in ("td", "th")):
                        break
            node = len(self.tag)
            good = bad = 0
            label, main = None, False
            if m[5]:
                for a in ATTR.finditer(m[5]):
                    key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if key in ("class", "id", "role", "itemprop"):
                        tokens = set(WORDS.findall(value.lower()))
                        good += len(tokens & GOOD)
                        bad += len(tokens & BAD)
                        main |= key == "role" and value == "main"
                    elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                        bad += 1
                    elif labelled and key == "data-y":
                        label = value
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.end.append(0)
            self.depth.append(len(stack))
            self.good.append(good)
            self.bad.append(bad)
            self.forms.append(0)
            self.label.append(label)
            self.role_main.append(main)
            stack.append(node)
        if at < len(source):
            run.append(source[at:])
        settle()
        close(0)


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of all pages, in order."""
    sizes = [len(p.tag) for p in pages]
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = int(base[-1])
    page = np.repeat(np.arange(len(pages)), sizes)
    flat = lambda name: np.array([x for p in pages for x in getattr(p, name)], float)
    group = np.array([GROUP[t] for p in pages for t in p.tag], np.int64)
    parent = np.array([x for p in pages for x in p.parent], np.int64) + base[page]
    root = np.zeros(n, bool)
    root[base[:-1]] = True
    parent[root] = np.flatnonzero(root)
    end = flat("end").astype(np.int64) + base[page]
    here = np.arange(n)
    depth, good, bad, forms = flat("depth"), flat("good"), flat("bad"), flat("forms")
    owner = np.concatenate([np.array(p.owner, np.int64) + b for p, b in zip(pages, base)]) if pages else np.zeros(0, np.int64)
    texts = [t for p in pages for t in p.text]
    chars = np.array([len(t) for t in texts], float)
    linked = np.array([x for p in pages for x in p.linked], float)
    marks = np.array([t.count(",") + t.count(".") + t.count(";") for t in texts], float)

    def subtree(own: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(own)])
        return c[end] - c[here]

    own = np.bincount(owner, chars, n)
    text, link, mark = subtree(own), subtree(np.bincount(owner, linked, n)), subtree(np.bincount(owner, marks, n))
    runs, paras, form = subtree(np.bincount(owner, minlength=n).astype(float)), subtree((group == 3).astype(float)), subtree(forms + (group == 12))
    nodes = (end - here).astype(float)
    total = text[base[:-1]][page] if n else text
    before = np.concatenate([[0], np.cumsum(own)])[:-1]
    before = before - before[base[:-1]][page] if n else before
    # siblings: nodes of one parent are in order
    order = np.argsort(parent, kind="stable")
    first = np.flatnonzero(np.r_[True, parent[order][1:] != parent[order][:-1]]) if n else np.zeros(0, np.int64)
    count = np.diff(np.append(first, n))
    place, many = np.zeros(n), np.zeros(n)
    place[order] = np.arange(n) - np.repeat(first, count)
    many[order] = np.repeat(count, count)
    alike = np.bincount(parent, minlength=n)
    same = np.zeros(n)
    key = parent * len(GROUPS) + group
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    same = counts[inverse].astype(float) if n else same
    # what the ancestors are: one level of the tree after the other
    up_good, up_bad, in_main, in_bad, link_up = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    semantic_bad = np.isin(group, [8, 10, 11, 12, 14])
    for d in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        p = parent[at]
        up_good[at], up_bad[at] = np.minimum(up_good[p] + good[p], 9), np.minimum(up_bad[p] + bad[p], 9)
        in_main[at], in_bad[at] = np.maximum(in_main[p], group[p] == 0), np.maximum(in_bad[p], semantic_bad[p])
        link_up[at] = np.maximum(link_up[p], link[p] / np.maximum(text[p], 1))
    x = np.zeros((n, N_FEATURES))
    x[here, group] = 1
    dense = np.maximum(text, 1)
    cols = (
        depth, good, bad, up_good, up_bad, in_main, in_bad, place, place / np.maximum(many, 1), many, same, alike, np.log1p(nodes), np.log1p(text), np.log1p(own),
        text / np.maximum(total, 1), link / dense, mark / dense, text / nodes, text / np.maximum(runs, 1), np.log1p(paras), form, before / np.maximum(total, 1),
        text[parent] / np.maximum(total, 1) if n else text, link[parent] / np.maximum(text[parent], 1) if n else link, link_up,
    )
    for k, c in enumerate(cols):
        x[:, len(GROUPS) + k] = c
    return x


def teacher(p: Page) -> list[int] | None:
    """Labels of a page whose elements say what they are; None for other pages."""
    n = len(p.tag)
    size = [0] * (n + 1)
    own = [0] * n
    for o, t in zip(p.owner, p.text):
        own[o] += len(t)
    for k in range(n):
        size[k + 1] = size[k] + own[k]
    roots = [k for k in range(n) if p.label[k] == "k"] or [k for k in range(n) if p.tag[k] in ("article", "main") or p.role_main[k]]
    if not roots:
        return None
    root = max(roots, key=lambda k: (size[p.end[k]] - size[k], -k))
    heads = {"h1"}
    out = [D] * n
    up = root
    while up >= 0:
        out[up] = M
        up = p.parent[up]
    out[root] = K
    for k in range(root + 1, p.end[root]):
        header = p.tag[k] == "header" and not heads & set(p.tag[k : p.end[k]])
        drop = out[p.parent[k]] == D or p.label[k] == "d" or p.tag[k] in SEMANTIC_BAD or header or (p.bad[k] > 0 and p.good[k] < p.bad[k])
        out[k] = D if drop else K
    return out


#: Texts for pages made by rule (fixed values).
_SYLLABLES = "ba ne ti ro lu ka mi so de fa gri ento aran isc hel vor und".split()


def _salad(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, 9):
        words[k] = words[k].title()
        words[min(k + 8, n - 1)] += rng.choice([".", ".", ",", "?"])
    return " ".join(words)


def _links(rng: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{k}">{_salad(rng, rng.randint(1, 3))}</a></li>' for k in range(n)) + "</ul>"


def _boilerplate(rng: random.Random) -> str:
    t = lambda a, b: _salad(rng, rng.randint(a, b))
    return rng.choice(
        [
            f'<aside data-y="d" class="sidebar"><h3>{t(1, 3)}</h3>{_links(rng, 5)}</aside>',
            f'<div data-y="d" class="ad">{t(8, 30)}</div>',
            f'<div data-y="d" class="advert banner"><p>{t(8, 30)}</p></div>',
            f'<div data-y="d" id="cookie-notice"><p>{t(10, 30)}</p><button>OK</button></div>',
            f'<section data-y="d" id="comments"><h2>{t(1, 2)}</h2>' + "".join(f'<div class="comment"><p>{t(5, 60)}</p></div>' for _ in range(rng.randint(1, 5))) + "</section>",
            f'<form data-y="d" action="/s"><label>{t(1, 3)}</label><input name="q"><p>{t(3, 9)}</p><button>{t(1, 1)}</button></form>',
            f'<div data-y="d" class="newsletter"><p>{t(6, 15)}</p><form><input></form></div>',
            f'<div data-y="d" class="related"><h3>{t(1, 3)}</h3>{_links(rng, 4)}</div>',
            f'<div data-y="d" class="notice"><p>{t(8, 25)}</p></div>',
            f'<header data-y="d"><a href="/">{t(1, 3)}</a><p>{t(3, 12)}</p></header>',
            f'<header data-y="d" class="top"><h2>{t(1, 3)}</h2>{_links(rng, 3)}</header>',
            f'<footer data-y="d"><p>{t(4, 20)}</p></footer>',
        ]
    )


def made_page(seed: int) -> str:
    """A page made by rule, with labels in data-y."""
    rng = random.Random(seed)
    nav = rng.choice(['<nav data-y="d">{}</nav>', '<div data-y="d" class="menu">{}</div>', '<header data-y="d"><h2>Site</h2><nav>{}</nav></header>']).format(_links(rng, rng.randint(3, 9)))
    foot = rng.choice(['<footer data-y="d">{}</footer>', '<div data-y="d" class="footer"><p>{}</p></div>', '<div data-y="d" id="foot">{}</div>']).format("&copy; " + _salad(rng, rng.randint(4, 25)))
    body = [rng.choice(["<h1>{}</h1>"] * 3 + ["<header><h1>{}</h1></header>"]).format(_salad(rng, rng.randint(3, 9)))]
    for _ in range(rng.randint(1, 12)):
        body.append(
            rng.choice(
                [f"<p>{_salad(rng, rng.randint(1, 120))}</p>"] * 6
                + [f"<h2>{_salad(rng, 4)}</h2>", f"<ul><li>{_salad(rng, 9)}</li><li>{_salad(rng, 12)}</li></ul>", f"<blockquote><p>{_salad(rng, 20)}</p></blockquote>", f"<p><b>{_salad(rng, 10)}<br><p>{_salad(rng, 30)}</p>", f"<table><tr><td>{_salad(rng, 3)}</td><td>{_salad(rng, 3)}</td></tr></table>", f'<div class="section"><p>{_salad(rng, 40)}</p></div>']
            )
        )
        if rng.random() < 0.12:
            body.append(_boilerplate(rng))
    outer = rng.choice(['<article data-y="k">{}</article>', '<main><article data-y="k">{}</article></main>', '<main data-y="k">{}</main>', '<div data-y="k" class="content">{}</div>', '<div class="page"><div data-y="k" class="post-body">{}</div></div>', '<div id="wrap"><section data-y="k" class="entry">{}</section></div>'])
    pre, post = ["".join(_boilerplate(rng) for _ in range(rng.randint(0, 2))) for _ in range(2)]
    return f"<!DOCTYPE html><html><head><title>{_salad(rng, 5)}</title></head><body>{nav}{pre}{outer.format(''.join(body))}{post}{foot}</body></html>"


def disguised(source: str) -> str:
    """A variant of a page with an article element: other elements and class names, and more boilerplate around and inside. No label of the page's own stays."""
    source = re.sub(r"data-y\b", "data-x", source, flags=re.I)
    rng = random.Random(zlib.crc32(source.encode("utf-8", "replace")))
    inner = _boilerplate(rng) if rng.random() < 0.5 else ""
    source = re.sub(r"<article\b[^>]*>", lambda m: '<div data-y="k" class="%s">' % rng.choice(["content", "post", "entry-content", "story", "x1"]), source, flags=re.I)
    source = re.sub(r"</article\s*>", lambda m: inner + "</div>" + _boilerplate(rng), source, flags=re.I)
    if rng.random() < 0.5:
        source = re.sub(r"<nav\b[^>]*>", '<div class="menu">', source, flags=re.I)
        source = re.sub(r"</nav\s*>", "</div>" + _boilerplate(rng), source, flags=re.I)
    if rng.random() < 0.5:
        source = re.sub(r"<footer\b[^>]*>", '<div class="footer">', source, flags=re.I)
        source = re.sub(r"</footer\s*>", "</div>", source, flags=re.I)
    return source


def _examples(batches):
    for batch in batches:
        x, y = [], []
        for source in batch.column("html").to_pylist():
            for p in (Page(source), Page(disguised(source), True)):
                labels = teacher(p)
                if labels:
                    x += features([p]).tolist()
                    y += labels
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])


class Model:
    def __init__(self, boosted):
        self.boosted = boosted

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of K, D and M for each node."""
        p = np.stack([b.predict(x) for b in self.boosted], 1) + 1e-6
        return np.log(p / p.sum(1, keepdims=True))


def decode(parent: list[int], scores: list) -> list[int]:
    """The most likely labels of a tree (nodes in document order) in which D has only D below it, and K only K or D."""
    n = len(parent)
    k, d, m = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        s = scores[i]
        k[i] += s[0]
        d[i] += s[1]
        m[i] += s[2]
        up = parent[i]
        if up >= 0:
            best = k[i] if k[i] >= d[i] else d[i]
            k[up] += best
            d[up] += d[i]
            m[up] += best if best >= m[i] else m[i]
    out = [D] * n
    for i in range(n):
        above = out[parent[i]] if parent[i] >= 0 else M
        if above == D:
            continue
        if above == M and m[i] > k[i] and m[i] > d[i]:
            out[i] = M
        else:
            out[i] = K if k[i] >= d[i] else D
    return out


def train(pages: DataFrame, most_pages: int = 300, made: int = 150) -> Model:
    n = max(pages.count(), 1)
    sample = pages.where(F.col("html").isNotNull()).where(F.pmod(F.xxhash64("page_id", F.lit(9)), F.lit(1 << 30)) < min(1.0, most_pages / n) * (1 << 30))
    table = sample.select("html").mapInArrow(_examples, "y int, x array<double>").toArrow()
    own = [Page(made_page(k), True) for k in range(made)]
    x = np.concatenate([features(own), np.array(table.column("x").to_pylist(), float).reshape(-1, N_FEATURES)])
    y = np.concatenate([np.array([v for p in own for v in teacher(p)]), table.column("y").to_numpy()])
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    return Model([trees.fit(x, (y == c).astype(float), n_trees=24, depth=5, rate=0.3, bins=32) for c in (K, D, M)])


def main_text(pages: list[Page], model: Model) -> list[str]:
    scores = model.scores(features(pages)).tolist()
    out, at = [], 0
    for p in pages:
        labels = decode(p.parent, scores[at : at + len(p.tag)])
        at += len(p.tag)
        out.append("\n".join(t for t, o in zip(p.text, p.owner) if labels[o] == K))
    return out


def _extracted(batches, model: Model):
    for batch in batches:
        sources = batch.column("html").to_pylist()
        texts, at = [], 0
        while at < len(sources):
            end, size = at, 0
            while end < len(sources) and (end == at or size < SUB_CHARS):
                size += len(sources[end] or "")
                end += 1
            texts += main_text([Page(s or "") for s in sources[at:end]], model)
            at = end
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, most_pages: int = 300) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    model = train(pages, most_pages)
    return pages.mapInArrow(lambda it: _extracted(it, model), "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
