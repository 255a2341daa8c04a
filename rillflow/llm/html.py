"""Operator 9: main text of web pages, each block labelled by a bidirectional LSTM.

A page becomes the sequence of its leaf blocks. A block is described by its hashed tag path
(tags with their classes and ids), its hashed words and a few measures; two numpy LSTMs read
the sequence from both ends, so that each block is classified in the context of its page.
The network is trained on a bounded sample of sections of pages whose own markup tells main
text from the rest, varied by hiding that markup and by adding the usual kinds of boilerplate.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_sample, slices, table

#: Sections that the network is trained on, at most, and consecutive blocks of each.
TRAIN_SECTIONS, TRAIN_BLOCKS = 240, 200
#: Words of a training block that may stand in made-up boilerplate.
SNIPPET = 60
PATH, WORDS, MEASURES, HIDDEN = 96, 16, 6, 16
#: Steps of training, however many pages there are to learn from.
STEPS, BATCH, RATE = 420, 24, 0.01
CHUNK = 1 << 21

_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no text of the page.
_DROP = frozenset("script style template title textarea".split())
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>?|[^<]++|<""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")


def leaves(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters of links) of each leaf block with text, in page order.

    Character references are decoded and white space is turned into single spaces. Unclosed
    and stray tags are taken as browsers do, roughly: a new paragraph or item ends the last.
    """
    page = page or ""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    links, in_link = 0, False

    def end_block() -> None:
        nonlocal links
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append((tuple(x for _, names in stack for x in names), text, min(links, len(text))))
        pieces.clear()
        links = 0

    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m["tag"]
        if tag is None:
            piece = m[0]
            if piece[:2] in ("<!", "<?"):
                continue
            pieces.append(piece)
            links += len(piece) * in_link
            continue
        tag = tag.lower()
        if tag in _DROP:
            if not m["end"] and not m["attrs"].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                # a template that is never closed hides no page
                at = close.end() if close else at if tag == "template" else len(page)
            continue
        if tag not in _BLOCK:
            if tag == "a":
                in_link = not m["end"]
            continue
        end_block()
        in_link = False
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                stack.pop()
            if tag not in _VOID:
                names = [p for a in _NAMED.findall(m["attrs"]) for p in _PARTS.findall("".join(a).lower())]
                stack.append((tag, ("<" + tag, *names)))
    end_block()
    return out


#: Markup that says by itself what a block is; used for training labels only.
_MAIN_TAGS = {"<article", "<main"}
_REST_TAGS = {"<nav", "<footer", "<aside", "<form", "<header", "<menu", "<dialog"}
_REST_NAMES = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent footer header login masthead menu nav navbar navigation newsletter notice pagination popup promo related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_MAIN_NAMES = ("content", "post", "entry", "story", "body", "article", "text")


def told(path: tuple[str, ...]) -> int | None:
    """1 main text, 0 the rest, None if the markup doesn't tell."""
    if any(p in _REST_TAGS or p in _REST_NAMES for p in path):
        return 0
    return 1 if any(p in _MAIN_TAGS for p in path) else None


def guessed(block: tuple[tuple[str, ...], str, int]) -> int | None:
    """The same for a page whose markup tells no main text: long blocks with few links are, lists of links are not."""
    _, text, links = block
    if links > 0.5 * len(text):
        return 0
    return 1 if len(text) >= 60 and links < 0.3 * len(text) else None


def measures(text: str, links: int, known: dict[str, int]) -> np.ndarray:
    """What the network reads of a block's whole text. known: cache of word hashes."""
    words = text.split(" ")
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[w] = zlib.crc32(w.lower().encode()) % (2 * WORDS)
        hashes.append(h)
    bag = np.bincount(hashes, minlength=2 * WORDS)
    bag = (bag[:WORDS] - bag[WORDS:]).astype(float)
    n = len(text)
    return np.concatenate([bag / (1 + 2 * np.sqrt((bag**2).sum())), (np.log1p(n) / 5, links / n, text.count(".") / len(words), text.count(",") / len(words))])


def inputs(rows: list[tuple[tuple[str, ...], np.ndarray]], first: int = 0, total: int | None = None) -> np.ndarray:
    """Input rows of the network for consecutive (path, measures) of a page of ``total`` blocks, from its ``first`` on."""
    x = np.zeros((len(rows), PATH + WORDS + MEASURES))
    for i, (path, said) in enumerate(rows):
        for depth, p in enumerate(path):
            for key in (p, "leaf" + p if depth == len(path) - 1 else p):
                h = zlib.crc32(key.encode())
                x[i, h % PATH] += 1.0 if h & 1 << 20 else -1.0
        x[i, PATH:-2] = said
    np.clip(x[:, :PATH], -2, 2, out=x[:, :PATH])
    at = first + np.arange(len(rows))
    x[:, -2] = np.minimum(at / 50, 1.0)
    x[:, -1] = np.minimum(((len(rows) if total is None else total) - at) / 50, 1.0)
    return x


def describe(blocks: list[tuple[tuple[str, ...], str, int]], known: dict[str, int]) -> np.ndarray:
    """Input rows of the network for all blocks of a page."""
    return inputs([(path, measures(text, links, known)) for path, text, links in blocks])


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d = PATH + WORDS + MEASURES
    model = {}
    for way in "fb":
        model["w" + way] = rng.standard_normal((d, 4 * HIDDEN)) / np.sqrt(d)
        model["u" + way] = rng.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        model["c" + way] = np.zeros(4 * HIDDEN)
        model["c" + way][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
    model["o"] = rng.standard_normal((2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)
    model["d"] = rng.standard_normal((d, 1)) * 0.01
    model["e"] = np.zeros(1)
    return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(z: np.ndarray, u: np.ndarray, steps: range, live: np.ndarray, keep: bool):
    """Hidden states of z (time, page, 4 x HIDDEN); states of steps that a page lacks stay zero."""
    n = z.shape[1]
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    out = np.zeros((z.shape[0], n, HIDDEN))
    trace = {}
    for t in steps:
        g = z[t] + h @ u
        i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        s = np.tanh(g[:, 3 * HIDDEN :])
        m = live[t][:, None]
        new = (f * c + i * s) * m
        tc = np.tanh(new)
        if keep:
            trace[t] = (h, c, i, f, o, s, tc)
        h, c = o * tc * m, new
        out[t] = h
    return out, trace


def _lstm_back(d_out: np.ndarray, u: np.ndarray, steps: range, live: np.ndarray, trace) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of z and u."""
    dz, du = np.zeros((*d_out.shape[:2], 4 * HIDDEN)), np.zeros_like(u)
    dh, dc = np.zeros(d_out.shape[1:]), np.zeros(d_out.shape[1:])
    for t in reversed(steps):
        h, c, i, f, o, s, tc = trace[t]
        m = live[t][:, None]
        dh = (dh + d_out[t]) * m
        dn = (dc + dh * o * (1 - tc**2)) * m
        g = np.concatenate([dn * s * i * (1 - i), dn * c * f * (1 - f), dh * tc * o * (1 - o), dn * i * (1 - s**2)], axis=1)
        dz[t] = g
        du += h.T @ g
        dh, dc = g @ u.T, dn * f
    return dz, du


def _stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x = np.zeros((t, len(pages), PATH + WORDS + MEASURES))
    live = np.zeros((t, len(pages)))
    for k, p in enumerate(pages):
        x[: len(p), k], live[: len(p), k] = p, 1.0
    return x, live


def logits(model: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray, keep: bool = False):
    t = range(x.shape[0])
    hf, tf = _lstm(x @ model["wf"] + model["cf"], model["uf"], t, live, keep)
    hb, tb = _lstm(x @ model["wb"] + model["cb"], model["ub"], t[::-1], live, keep)
    h = np.concatenate([hf, hb], axis=2)
    return (h @ model["o"] + x @ model["d"])[..., 0] + model["e"][0], (h, tf, tb)


def gradients(model: dict[str, np.ndarray], x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    z, (h, tf, tb) = logits(model, x, live, keep=True)
    err = ((_sigmoid(z) - y) * weight / max(1.0, weight.sum()))[..., None]
    d_h = err @ model["o"].T
    t = range(x.shape[0])
    out = {"o": np.einsum("tnh,tnk->hk", h, err), "d": np.einsum("tnd,tnk->dk", x, err), "e": np.array([err.sum()])}
    for way, steps, trace, part in (("f", t, tf, d_h[..., :HIDDEN]), ("b", t[::-1], tb, d_h[..., HIDDEN:])):
        dz, out["u" + way] = _lstm_back(part, model["u" + way], steps, live, trace)
        out["w" + way] = np.einsum("tnd,tng->dg", x, dz)
        out["c" + way] = dz.sum(axis=(0, 1))
    return out


#: A section: place of its first block, blocks of the page, and (path, measures, label, some words) of each.
Section = tuple[int, int, list[tuple[tuple[str, ...], np.ndarray, int | None, str]]]


def sections(page: str | None, pick: int = 0, count: int = 1, size: int = TRAIN_BLOCKS) -> list[Section]:
    """``count`` sections of a page at most, from the ``pick``-th on and counted around: ``size`` blocks each, described by their whole texts."""
    blocks, known = leaves(page), {}
    labels = [told(b[0]) for b in blocks]
    if 1 not in labels:
        labels = [guessed(b) if y is None else y for b, y in zip(blocks, labels, strict=True)]
    every, out = -(-len(blocks) // size), []
    for k in range(min(count, every)):
        first = (pick + k) % every * size
        part = slice(first, first + size)
        rows = [(path, measures(text, links, known), y, " ".join(text.split(" ", SNIPPET)[:SNIPPET])) for (path, text, links), y in zip(blocks[part], labels[part], strict=True)]
        out.append((first, len(blocks), rows))
    return out


def lessons(taught: list[Section], seed: int = 3) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, labels, weights) of training sections: as they are, with the telling tags hidden, and with boilerplate added.

    If no block of all is told or guessed to be main text, all are that aren't known to be the rest.
    """
    rng = np.random.default_rng(seed)
    found, known = [], {}
    if not any(y == 1 for *_, rows in taught for _, _, y, _ in rows):
        taught = [(first, total, [(path, said, 1 if y is None else y, some) for path, said, y, some in rows]) for first, total, rows in taught]
    prose = [r[3] for *_, rows in taught for r in rows if r[2] == 1] or [r[3] for *_, rows in taught for r in rows]
    names = sorted(_REST_NAMES)

    def extra() -> tuple[tuple[str, ...], np.ndarray, int]:
        text = " ".join(prose[rng.integers(len(prose))].split(" ")[: int(rng.integers(2, SNIPPET))])
        kind = rng.integers(3)
        tag = ("<aside", "<form", "<header", "<nav", "<footer")[rng.integers(5)] if kind == 0 else "<div"
        path = ("<html", "<body", *(("<article",) if rng.random() < 0.3 else ()), tag, *((names[rng.integers(len(names))],) if kind else ()), ("<p", "<div", "<li")[rng.integers(3)])
        return path, measures(text, len(text) if rng.random() < 0.4 else 0, known), 0

    for first, total, blocks in taught:
        for style in range(3):
            rows = [(path, said, y) for path, said, y, _ in blocks]
            if style and prose:
                hide = {"<article": ("<div", _MAIN_NAMES[rng.integers(len(_MAIN_NAMES))]) if rng.random() < 0.7 else ("<div",), "<main": ("<div",)} if style == 2 else {}
                rows = [(tuple(q for p in path for q in hide.get(p, (p,))), said, y) for path, said, y in rows]
                for _ in range(int(rng.integers(1, max(7, len(rows) // 8)))):
                    rows.insert(int(rng.integers(len(rows) + 1)), extra())
            if not rows:
                continue
            x = inputs([r[:2] for r in rows], first, total + len(rows) - len(blocks))
            y = np.array([float(t or 0) for *_, t in rows])
            found.append((x, y, np.array([float(t is not None) for *_, t in rows])))
    return found


def learn(taught: list[Section], steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    model, data, rng = start(), lessons(taught), np.random.default_rng(seed)
    if not data:
        return model
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    epochs = -(-steps // -(-len(data) // BATCH))
    for epoch in range(epochs):
        # sections of like length share a batch, batches are shuffled
        order = sorted(range(len(data)), key=lambda i: (len(data[i][0]), i))
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            some = [data[i] for i in groups[g]]
            x, live = _stack([s[0] for s in some])
            y, weight = np.zeros(live.shape), np.zeros(live.shape)
            for k, s in enumerate(some):
                y[: len(s[1]), k], weight[: len(s[1]), k] = s[1], s[2]
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for k, d in gradients(model, x, live, y, weight).items():
                d = np.clip(d, -1, 1)
                first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.99 * second[k] + 0.01 * d * d
                model[k] = model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def label(model: dict[str, np.ndarray], pages: list[np.ndarray], room: int = 40_000) -> list[np.ndarray]:
    """Whether each block of each page is main text. room: blocks held at once, padding included."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    group: list[int] = []
    for i in [*order, None]:
        if i is None or (group and len(pages[i]) * (len(group) + 1) > room):
            if group:
                z, _ = logits(model, *_stack([pages[k] for k in group]))
                for k, row in zip(group, z.T, strict=True):
                    out[k] = row[: len(pages[k])] > 0
            group = []
        if i is not None:
            group.append(i)
    return out


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            pages = batch.column("html").to_pylist()
            texts: list[str] = []
            for part in slices([len(p or "") for p in pages], CHUNK):
                blocks = [leaves(p) for p in pages[part]]
                kept = label(model.value, [describe(b, known) for b in blocks])
                texts += [" ".join(b[1] for b, k in zip(bs, ks, strict=True) if k) for bs, ks in zip(blocks, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _cut_sections(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sections of each different page of a task, packed."""
        seen: set[int] = set()
        for batch in batches:
            for key, page in zip(batch.column("key").to_pylist(), batch.column("html"), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                for first, total, rows in sections(page.as_py(), key, count):
                    paths, labels, some = [" ".join(r[0]) for r in rows], [r[2] for r in rows], [r[3] for r in rows]
                    said = np.array([r[1] for r in rows], np.float32).tobytes()
                    columns = [pa.array([key], pa.int64()), pa.array([first], pa.int64()), pa.array([total], pa.int64()), pa.array([paths], pa.list_(pa.string())), pa.array([said], pa.binary()), pa.array([labels], pa.list_(pa.int32())), pa.array([some], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "first", "total", "paths", "said", "labels", "some"])

    return run


def training_sections(pages: DataFrame, sample: int = TRAIN_SECTIONS) -> list[Section]:
    """``sample`` sections at most of the different pages with the smallest hashes, whatever their length.

    One of each page, more where there are fewer pages. Pages are parsed where they lie; the
    driver gets sections of TRAIN_BLOCKS described blocks.
    """
    keyed = pages.where("html is not null").select(F.xxhash64("html").alias("key"), "html")
    keys = [r["key"] for r in bounded_sample(keyed.select("key").distinct(), ["key"], sample).collect()]
    schema = "key long, first long, total long, paths array<string>, said binary, labels array<int>, some array<string>"
    parts = keyed.where(F.col("key").isin(keys)).mapInArrow(_cut_sections(sample // len(keys)), schema).dropDuplicates(["key", "first"]).collect() if keys else []
    found = []
    for r in sorted(parts, key=lambda r: (r["key"], r["first"])):
        said = np.frombuffer(bytes(r["said"]), np.float32).reshape(len(r["paths"]), -1).astype(float)
        found.append((r["first"], r["total"], [(tuple(p.split()), m, y, t) for p, m, y, t in zip(r["paths"], said, r["labels"], r["some"], strict=True)]))
    return found


def extract_text(pages: DataFrame, sample: int = TRAIN_SECTIONS) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html) of ``pages``.

    Main-text blocks in page order, joined by one space; the whole page is read. A null or
    empty html, and one without main text, gives an empty text. The network is trained on the
    driver, on ``sample`` of ``training_sections``; it has a fixed size, and so has what
    is broadcast. Where a training page's markup tells no main text, its long blocks with few
    links are taken for it, and if there are none in all of the sample, all blocks whose markup
    doesn't call them boilerplate. Repeated rows are kept.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = learn(training_sections(rows, sample))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(model)), f"page_id {kind}, url string, text string, n_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
