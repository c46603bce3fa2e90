"""Operator 3: main text of HTML by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, outside scripts, styles and
the like.  A block's vector adds up the learned vectors of its hashed tag path (tags with class,
id and role words), of its hashed words, and a few shape features.  A bidirectional LSTM in numpy reads
the page's blocks in both directions and labels each as main text or not, so that a
block without telling tags is judged by the whole document around it.  Kept blocks, with references decoded
and white space folded, are joined by blank lines.

The network is trained when the operator runs.  Its teacher is weak supervision: on at most
``FIT_PAGES`` pages (the smallest by a hash of page_id) a rule reads the semantic tags and class words of the
path.  Variations of those pages (renamed or missing classes, article replaced by div, boilerplate moved or
wrapped, comment, form and notice blocks inserted) keep the labels, and make it rely on words and
neighbours where tags tell nothing.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

FIT_PAGES = 300
EPOCHS = 4
BATCH = 16
#: Blocks of a training sequence; longer pages are trained in windows that overlap by a quarter.
WINDOW = 400
HIDDEN = 16
WIDTH = 24
PATH_BUCKETS, WORD_BUCKETS = 4096, 4096
#: Words of a block that its vector adds up: all, as bags; longer texts only take more time.
SHAPES = 6

#: Elements whose content is text up to their end tag, or to the end of the page.
RAW = frozenset(("script", "style", "textarea"))
#: Elements whose content is no text of the page.
SILENT = frozenset(("head", "noscript", "template", "svg", "iframe", "object", "select", "math", "canvas"))
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta title noscript style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul button label option".split())
#: Elements that end where the next of their kind begins.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCKS - {"body", "html", "button", "label", "option", "legend", "caption"}

# quotes count at the beginning of a value only, and only if they are closed
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[a-z]+")
#: Steps of a tag path; what is nested deeper has the path of its ancestor.
DEEPEST = 200

#: Names in tag paths that the teacher takes for boilerplate.
BOILERPLATE = frozenset(
    "nav menu footer header aside sidebar ad ads advert advertisement sponsored promo banner cookie notice consent form comment comments reply "
    "discussion share social related breadcrumb breadcrumbs pagination newsletter subscribe popup modal widget toolbar masthead navigation "
    "complementary contentinfo search login disclaimer copyright".split())


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str]]:
    """(tag path, text) of each leaf block in page order; texts aren't empty.

    Markup need not be well formed.  A head ends at the first thing that no head holds.  Of the other elements
    whose content isn't text (``SILENT``) one that is closed somewhere later ends there or with its parent; one that
    never is closed ends at the next block or with its parent.
    """
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: Counter = Counter()
    path: tuple[str, ...] = ()
    parts: list[str] = []
    last_end: dict[str, int] = {}
    silent = soft = 0  # silent elements on the stack, and those of them without an end tag
    at, n = 0, len(page)

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((path, text))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal path, silent, soft
        if any(t in BLOCKS for t, _ in stack[depth:]):
            flush()
        for t, _ in stack[depth:]:
            opened[t] -= 1
            silent -= t.lstrip("~") in SILENT
            soft -= t[0] == "~"
        path = stack[depth][1]
        del stack[depth:]

    def innermost(test) -> int:
        return next(i for i in range(len(stack) - 1, -1, -1) if test(stack[i][0]))

    def closed_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}\b", page, re.I)), default=-1)
        return last_end[tag] >= at

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text and opened["head"] and not text.isspace():
            close(innermost("head".__eq__))
        if text and not silent:
            parts.append(text)
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        empty = (m[3] or "").rstrip().endswith("/")
        if m[1]:
            if opened[tag]:
                close(innermost(tag.__eq__))
            elif opened[f"~{tag}"]:
                close(innermost(f"~{tag}".__eq__))
            elif tag in BLOCKS:
                flush()
            continue
        if opened["head"] and tag not in IN_HEAD:
            close(innermost("head".__eq__))
        if tag in RAW or tag == "title":
            if tag == "title":
                flush()
            if not empty:
                # a title that is never closed ends at the next tag
                end = re.compile(rf"</{tag}\b[^>]*>" if tag in RAW or closed_later(tag) else "(?=<)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if soft and tag in BLOCKS and tag not in ("option", "label", "legend"):
            close(next(i for i, (t, _) in enumerate(stack) if t[0] == "~"))
        if tag == "br":
            if not silent:
                parts.append(" ")
            continue
        if tag in SILENT:
            if tag == "head":
                flush()
            if not empty:
                name = tag if tag == "head" or closed_later(tag) else f"~{tag}"
                stack.append((name, path))
                opened[name] += 1
                silent += 1
                soft += name[0] == "~"
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            ends = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in BLOCKS or stack[i][0] in SILENT:
                    break
        if tag in BLOCKS:
            flush()
        if tag in VOID or empty:
            continue
        names = [tag]
        for a in ATTRIBUTE.finditer(m[3] or ""):
            names += NAMES.findall((a[2] or a[3] or a[4] or "").lower())
        stack.append((tag, path))
        opened[tag] += 1
        if len(path) < DEEPEST and (tag in BLOCKS or len(names) > 1 or tag == "a"):
            path = (*path, ".".join(names))
    flush()
    return out


def teacher(path: tuple[str, ...]) -> int:
    """1 for main text by what the tags and their classes say."""
    names = {x for step in path for x in step.split(".")}
    inside = next((i for i, step in enumerate(path) if step.split(".")[0] in ("article", "main")), None)
    if inside is not None:  # what stands inside the article decides; its own header holds the title
        names = {x for step in path[inside + 1 :] for x in step.split(".")} - {"header"}
    return int(not names & BOILERPLATE and (inside is not None or bool({"p", "blockquote", "pre", "h", "content"} & names)))


def _hash(text: str, buckets: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % buckets


class Features:
    """Hashed features, remembered up to a bound in each worker."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.paths: dict[tuple, list[int]] = {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            names = [x for step in path for x in step.split(".")]
            last = [f"{i}:{x}" for i, x in enumerate(reversed(path[-3:]))]
            got = self.paths[path] = [_hash(x, PATH_BUCKETS) for x in dict.fromkeys(names + last)] or [0]
        return got

    def text(self, text: str) -> list[int]:
        if len(self.words) > 300_000:
            self.words.clear()
        get, out = self.words.get, []
        for w in text.split(" "):
            h = get(w)
            if h is None:
                h = self.words[w] = _hash(w.lower(), WORD_BUCKETS)
            out.append(h)
        return out

    def shape(self, path: tuple[str, ...], text: str) -> list[float]:
        n = text.count(" ") + 1
        last = path[-1].split(".")[0] if path else ""
        return [np.log1p(n) / 5, float(n < 4), float(text[-1] in ".!?:;\"'"), float(any(s.split(".")[0] == "a" for s in path)), float(last in ("p", "blockquote", "pre")), float("©" in text)]


class Labeller:
    """The network: embedding bags, a forward and a backward LSTM, a logistic output."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {"path": draw(PATH_BUCKETS, WIDTH), "word": draw(WORD_BUCKETS, WIDTH), "shape": draw(SHAPES, WIDTH)}
        for d in "fb":
            self.p |= {f"x{d}": draw(WIDTH, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"out": draw(2 * HIDDEN + WIDTH), "bias": np.zeros(1, np.float32)}

    @staticmethod
    def bags(pages: list, features: Features) -> dict:
        """Pages of blocks, padded to the longest, as index lists."""
        longest = max(map(len, pages))
        path_at, path_row, word_at, word_row, weight = [], [], [], [], []
        shape, mask = np.zeros((len(pages), longest, SHAPES), np.float32), np.zeros((len(pages), longest), np.float32)
        for i, page in enumerate(pages):
            for j, (path, text) in enumerate(page):
                row = i * longest + j
                a, b = features.path(path), features.text(text)
                path_at += a
                path_row += [row] * len(a)
                word_at += b
                word_row.append((row, len(b)))
                weight.append(1 / len(b))
                shape[i, j], mask[i, j] = features.shape(path, text), 1
        rows, counts = np.array(word_row).reshape(-1, 2).T
        return {
            "path": (np.array(path_at), np.array(path_row)), "word": (np.array(word_at), np.repeat(rows, counts)), "rows": rows, "cuts": np.cumsum(counts) - counts,
            "weight": np.repeat(np.array(weight, np.float32), counts), "shape": shape, "mask": mask}

    def _input(self, bag: dict) -> np.ndarray:
        n, t = bag["mask"].shape
        x = np.zeros((n * t, WIDTH), np.float32)
        at, row = bag["path"]
        np.add.at(x, row, self.p["path"][at])
        at, _ = bag["word"]
        for lo in range(0, len(bag["cuts"]), 4096):  # bounds the gathered vectors
            hi = min(lo + 4096, len(bag["cuts"]))
            a, b = bag["cuts"][lo], bag["cuts"][hi] if hi < len(bag["cuts"]) else len(at)
            x[bag["rows"][lo:hi]] += np.add.reduceat(self.p["word"][at[a:b]] * bag["weight"][a:b, None], bag["cuts"][lo:hi] - a, axis=0)
        return x.reshape(n, t, WIDTH) + bag["shape"] @ self.p["shape"]

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        n, t, _ = x.shape
        pre = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for j in range(t) if d == "f" else range(t - 1, -1, -1):
            g = pre[:, j] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, j, None]
            c2 = f * c + i * u
            th = np.tanh(c2)
            if keep is not None:
                keep.append((j, h, c, i, f, o, u, th, m))
            c, h = m * c2 + (1 - m) * c, m * (o * th) + (1 - m) * h
            out[:, j] = h
        return out

    def scores(self, bag: dict) -> np.ndarray:
        """Log odds of main text, pages by blocks."""
        x = self._input(bag)
        z = np.concatenate((self._run(x, bag["mask"], "f"), self._run(x, bag["mask"], "b"), x), axis=2)
        return z @ self.p["out"] + self.p["bias"]

    def step(self, bag: dict, labels: np.ndarray, state: dict, rate: float) -> float:
        """One Adam step on the cross entropy; returns it."""
        x, mask, keeps = self._input(bag), bag["mask"], {"f": [], "b": []}
        hf, hb = self._run(x, mask, "f", keeps["f"]), self._run(x, mask, "b", keeps["b"])
        z = np.concatenate((hf, hb, x), axis=2)
        p = 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["bias"], -30, 30)))
        total = max(1.0, mask.sum())
        loss = -(mask * np.where(labels == 1, np.log(p + 1e-7), np.log(1 - p + 1e-7))).sum() / total
        dz0 = (mask * (p - labels) / total).astype(np.float32)
        grad = {"out": np.einsum("nt,ntk->k", dz0, z), "bias": np.array([dz0.sum()], np.float32)}
        dz = dz0[..., None] * self.p["out"]
        dx = dz[..., 2 * HIDDEN :].copy()
        for d, lo in (("f", 0), ("b", HIDDEN)):
            dh_out = dz[..., lo : lo + HIDDEN]
            dh, dc = np.zeros_like(hf[:, 0]), np.zeros_like(hf[:, 0])
            gx, gh, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"h{d}"]), np.zeros_like(self.p[f"c{d}"])
            for j, h0, c0, i, f, o, u, th, m in reversed(keeps[d]):
                dh = dh + dh_out[:, j]
                dhm, dcm = dh * m, dc * m + dh * m * o * (1 - th * th)
                g = np.concatenate((dcm * u * i * (1 - i), dcm * c0 * f * (1 - f), dhm * th * o * (1 - o), dcm * i * (1 - u * u)), axis=1)
                gx += x[:, j].T @ g
                gh += h0.T @ g
                gc += g.sum(0)
                dx[:, j] += g @ self.p[f"x{d}"].T
                dh, dc = g @ self.p[f"h{d}"].T + dh * (1 - m), dcm * f + dc * (1 - m)
            grad |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
        flat = dx.reshape(-1, WIDTH)
        grad["shape"] = bag["shape"].reshape(-1, SHAPES).T @ flat
        for name in ("path", "word"):
            at, row = bag[name]
            g = flat[row] * (bag["weight"][:, None] if name == "word" else 1)
            order = np.argsort(at, kind="stable")
            cut = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
            grad[name] = np.zeros_like(self.p[name])
            grad[name][at[order][cut]] = np.add.reduceat(g[order], cut, axis=0)
        state["n"] = state.get("n", 0) + 1
        for name, g in grad.items():
            m1, m2 = state.get(name, (0.0, 0.0))
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            state[name] = m1, m2
            self.p[name] -= rate * (m1 / (1 - 0.9 ** state["n"])) / (np.sqrt(m2 / (1 - 0.999 ** state["n"])) + 1e-8)
        return float(loss)


def vary(blocks: list, labels: list[int], rng: random.Random, others: list[str]) -> tuple[list, list[int]]:
    """A page with other markup around the same texts, and its labels."""
    drop, swap = rng.random() < 0.4, rng.choice(("div", "section", "td", "div.content", "main", "div.post"))
    noise = rng.choice(BOILER_NAMES)
    out, kept = [], []
    for (path, text), y in zip(blocks, labels, strict=True):
        steps = []
        for s in path:
            if y and s.split(".")[0] in ("article", "main"):
                s = swap
            elif not y and drop and s.split(".")[0] in ("nav", "footer", "header", "aside", "div"):
                s = noise
            elif y and rng.random() < 0.05:
                s = f"{s}.{rng.choice(('text', 'body', 'entry', 'lead', 'intro'))}"
            steps.append(s)
        out.append((tuple(steps), text))
        kept.append(y)
    # boilerplate inside or around the article
    main = [i for i, y in enumerate(kept) if y] or [0]
    for _ in range(rng.randint(0, 4)):
        at = rng.choice((main[0], main[-1] + 1, rng.choice(main)))
        base = out[main[0]][0][:-1] if main[0] < len(out) and rng.random() < 0.6 else ("html", "body")
        block = ((*base, rng.choice(BOILER_NAMES), rng.choice(("p", "li", "div", "span.text"))), rng.choice(others))
        out.insert(at, block)
        kept.insert(at, 0)
        main = [i for i, y in enumerate(kept) if y] or [0]
    return out, kept


#: Elements that the variations put boilerplate into.
BOILER_NAMES = (
    "nav", "footer", "header", "aside", "form", "div.ad", "div.ads", "div.advert", "div.sponsored", "div.sidebar", "div.menu", "ul.menu", "div.comments", "section.comments",
    "div.comment", "ol.comment.list", "div.cookie.notice", "div.notice", "div.cookie.banner", "div.newsletter", "div.related", "div.share", "div.social", "div.footer", "div.header",
    "div.nav", "div.breadcrumb", "div.promo", "div.widget", "div.navbar", "div.site.footer", "div.consent", "div.popup", "form.search", "div.banner", "section.related.posts")


def train(pages: list[str], seed: int = 5) -> Labeller:
    """A labeller fitted to the given pages and their variations."""
    rng, features, net, state = random.Random(seed), Features(), Labeller(), {}
    known = [b for b in map(blocks_of, pages) if b]
    if not known:
        return net
    labels = [[teacher(path) for path, _ in b] for b in known]
    others = [t for b in known for _, t in b]
    for epoch in range(EPOCHS):
        order = list(range(len(known)))
        rng.shuffle(order)
        for lo in range(0, len(order), BATCH):
            part = [(known[i], labels[i]) if rng.random() < 0.3 else vary(known[i], labels[i], rng, others) for i in order[lo : lo + BATCH]]
            part = sorted((w for b, y in part for w in windows(b, y)), key=lambda x: len(x[0]))
            for a in range(0, len(part), BATCH):
                some = part[a : a + BATCH]
                bag = Labeller.bags([b for b, _ in some], features)
                y = np.zeros(bag["mask"].shape, np.float32)
                for i, (_, each) in enumerate(some):
                    y[i, : len(each)] = each
                net.step(bag, y, state, 0.02 if epoch < EPOCHS - 1 else 0.005)
    return net


def windows(blocks: list, labels: list[int]) -> Iterator[tuple[list, list[int]]]:
    """The page itself, or overlapping stretches of a long one, the last of which ends with it."""
    last = max(0, len(blocks) - WINDOW)
    for lo in [*range(0, last, WINDOW * 3 // 4), last]:
        yield blocks[lo : lo + WINDOW], labels[lo : lo + WINDOW]


def extract(pages: list[str], net: Labeller, features: Features) -> list[str]:
    """Main text of each page."""
    cut = [blocks_of(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if cut[i]), key=lambda i: len(cut[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(cut[order[hi]]) <= 8192:  # pages of like length share a padded batch
            hi += 1
        part = order[lo:hi]
        scores = net.scores(Labeller.bags([cut[i] for i in part], features))
        for i, s in zip(part, scores, strict=True):
            out[i] = "\n\n".join(text for (_, text), x in zip(cut[i], s, strict=False) if x > 0)
        lo = hi
    return out


def extract_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Null html is an empty page with empty text; repeated rows repeat; null ids and urls stay null; other columns
    are ignored.  Without any page that has blocks the network stays untrained and there is nothing to label.
    """
    spark = pages.sparkSession
    chosen = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    sample = pages.join(F.broadcast(chosen), "page_id", "left_semi").select("page_id", text_of("html").alias("html")).orderBy("page_id", "html").limit(2 * fit_pages).toPandas()
    shared = spark.sparkContext.broadcast(train(sample["html"].tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.iloc[lo : lo + 200]
                texts = extract(part["html"].tolist(), shared.value, features)
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), text_of("html").alias("html"))
    return rows.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))


def op3_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
