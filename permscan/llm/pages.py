"""Main text of web pages: a recurrent labeller of blocks, trained here on generated pages."""

import random
import zlib
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary table "
    "tbody td textarea tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript svg math object iframe canvas audio video".split())
CLOSES_P = BLOCKS - {"button", "label", "legend", "option", "body", "html"}

PATH_SIZE, WORD_SIZE, NUMBERS = 96, 64, 6
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS
EMBEDDED, HIDDEN = 32, 16
TRAINING_PAGES, EPOCHS, BATCH = 600, 8, 24
PAGES_AT_ONCE = 64


class _Reader(HTMLParser):
    """Splits a page into blocks: ``(path, text, characters inside links)`` in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[tuple, str, int]] = []
        self.stack: list[tuple[str, tuple]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.unseen = 0
        self.links = 0

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((tuple(t for _, names in self.stack for t in names), text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, place: int):
        for tag, _ in self.stack[place:]:
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
        del self.stack[place:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P or tag == "li":
            # An open paragraph or list item ends here, and with it whatever is open inside.
            ends = {"p", "li"} if tag == "li" else {"p"}
            for place in range(len(self.stack) - 1, -1, -1):
                if self.stack[place][0] in ends:
                    self._pop(place)
                    break
                if self.stack[place][0] in BLOCKS:
                    break
        if tag == "body" or tag in BLOCKS:
            # The end of the head may be left out: the body or the first block in it, unless within a template or the like, ends it.
            inside = [name for name, _ in self.stack if name in UNSEEN]
            if inside == ["head"]:
                self._pop(next(place for place, (name, _) in enumerate(self.stack) if name == "head"))
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [f"{tag}.{w}" for w in value.lower().replace("_", "-").split()]
                names += [f".{w}" for part in value.lower().replace("_", "-").split() for w in part.split("-")]
        self.stack.append((tag, tuple(names)))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._flush()
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place][0] == tag:
                self._pop(place)
                return

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[tuple[tuple, str, int]]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._flush()
    return reader.blocks


class _Slots(dict):
    """Word → place in the hashed vector, remembered for the words seen last."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        slot = self[word] = zlib.crc32(word.strip(".,;:!?()\"'").encode()) % WORD_SIZE
        return slot


class _Paths(dict):
    """Tag path → its hashed vector."""

    def __missing__(self, path: tuple) -> np.ndarray:
        if len(self) >= 20_000:
            self.clear()
        vector = self[path] = np.zeros(PATH_SIZE, np.float32)
        vector[[zlib.crc32(name.encode()) % PATH_SIZE for name in path]] = 1.0
        return vector


_slots, _paths = _Slots(), _Paths()


def features(pages: list[list[tuple[tuple, str, int]]]) -> list[np.ndarray]:
    """For each page a row per block: hashed tag path, hashed words, and a few measures."""
    blocks = [b for page in pages for b in page]
    sizes = np.array([len(page) for page in pages])
    if not blocks:
        return [np.zeros((0, INPUT), np.float32) for _ in pages]
    words = [text.lower().split() for _, text, _ in blocks]
    counts = np.array([len(w) for w in words])
    slots = np.fromiter((slot for w in words for slot in map(_slots.__getitem__, w)), np.int64, counts.sum())
    cells = np.repeat(np.arange(len(blocks)), counts) * WORD_SIZE + slots
    bags = np.bincount(cells, minlength=len(blocks) * WORD_SIZE).reshape(-1, WORD_SIZE)
    ends = np.array([text.count(".") + text.count("?") + text.count("!") for _, text, _ in blocks])
    linked = np.array([linked / len(text) for _, text, linked in blocks])
    place = np.arange(len(blocks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(blocks), INPUT), np.float32)
    out[:, :PATH_SIZE] = [_paths[path] for path, _, _ in blocks]
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.sqrt(bags / counts[:, None])
    out[:, PATH_SIZE + WORD_SIZE :] = np.stack(
        [
            np.log1p(counts) / 4,
            np.minimum(linked, 1.0),
            np.minimum(ends / counts, 1.0),
            place / np.repeat(sizes, sizes),
            1.0 / (1 + place),
            [float("a" in path) for path, _, _ in blocks],
        ],
        axis=1,
    )
    return np.split(out, np.cumsum(sizes)[:-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)

    def weights(*shape):
        return draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

    model = {"embed": weights(INPUT, EMBEDDED), "embed_bias": np.zeros(EMBEDDED, np.float32)}
    for way in ("forward", "backward"):
        model[f"{way}_in"] = weights(EMBEDDED, 4 * HIDDEN)
        model[f"{way}_state"] = weights(HIDDEN, 4 * HIDDEN)
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1.0
        model[f"{way}_bias"] = bias
    model["out"] = weights(2 * HIDDEN + EMBEDDED, 1)
    model["out_bias"] = np.zeros(1, np.float32)
    return model


def _lstm(model, way, x, mask):
    """States for ``x`` (steps, pages, EMBEDDED); steps beyond a page's end keep the state. Also what the way back needs."""
    steps, pages, _ = x.shape
    state = np.zeros((pages, HIDDEN), np.float32)
    cell = np.zeros_like(state)
    states, kept = np.zeros((steps, pages, HIDDEN), np.float32), [None] * steps
    projected = x @ model[f"{way}_in"] + model[f"{way}_bias"]
    for t in range(steps) if way == "forward" else range(steps - 1, -1, -1):
        gates = projected[t] + state @ model[f"{way}_state"]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        inside = mask[t][:, None]
        new = f * cell + i * g
        bent = np.tanh(new)
        kept[t] = (state, cell, i, f, o, g, bent)
        cell = np.where(inside, new, cell)
        state = np.where(inside, o * bent, state)
        states[t] = state
    return states, kept


def _lstm_back(model, way, x, mask, kept, grads, outer):
    """Gradients of the weights and of ``x``, from those of the states."""
    steps, pages, _ = x.shape
    dx = np.zeros_like(x)
    ds, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1) if way == "forward" else range(steps):
        state, cell, i, f, o, g, bent = kept[t]
        inside = mask[t][:, None]
        ds = ds + outer[t]
        d_state = np.where(inside, ds, 0)
        d_cell = np.where(inside, dc + d_state * o * (1 - bent**2), 0)
        gates = np.concatenate(
            [
                d_cell * g * i * (1 - i),
                d_cell * cell * f * (1 - f),
                d_state * bent * o * (1 - o),
                d_cell * i * (1 - g**2),
            ],
            axis=1,
        )
        grads[f"{way}_in"] += x[t].T @ gates
        grads[f"{way}_state"] += state.T @ gates
        grads[f"{way}_bias"] += gates.sum(0)
        dx[t] = gates @ model[f"{way}_in"].T
        ds = np.where(inside, gates @ model[f"{way}_state"].T, ds)
        dc = np.where(inside, d_cell * f, dc)
    return dx


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for n, page in enumerate(pages):
        x[: len(page), n], mask[: len(page), n] = page, True
    return x, mask


def _run(model, x, mask):
    embedded = np.tanh(x @ model["embed"] + model["embed_bias"])
    forward, kept_f = _lstm(model, "forward", embedded, mask)
    backward, kept_b = _lstm(model, "backward", embedded, mask)
    joined = np.concatenate([forward, backward, embedded], axis=2)
    return _sigmoid(joined @ model["out"] + model["out_bias"])[..., 0], embedded, joined, kept_f, kept_b


def predict(model: dict[str, np.ndarray], pages: list[np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for every block of every page."""
    out = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((n for n in range(len(pages)) if len(pages[n])), key=lambda n: len(pages[n]))
    for at in range(0, len(order), PAGES_AT_ONCE):
        some = order[at : at + PAGES_AT_ONCE]
        found = _run(model, *_padded([pages[n] for n in some]))[0]
        for k, n in enumerate(some):
            out[n] = found[: len(pages[n]), k]
    return out


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on the log loss of ``(features, labels)`` per page, in a seeded order."""
    model = initial(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    draw, step = random.Random(seed), 0
    for _ in range(epochs):
        order = list(range(len(pages)))
        draw.shuffle(order)
        for at in range(0, len(order), BATCH):
            some = [pages[n] for n in order[at : at + BATCH]]
            x, mask = _padded([p for p, _ in some])
            label = np.zeros(mask.shape, np.float32)
            for n, (_, y) in enumerate(some):
                label[: len(y), n] = y
            found, embedded, joined, kept_f, kept_b = _run(model, x, mask)
            error = np.where(mask, found - label, 0)[..., None].astype(np.float32) / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in model.items()}
            grads["out"] += np.einsum("tbi,tbo->io", joined, error)
            grads["out_bias"] += error.sum((0, 1))
            back = error @ model["out"].T
            dx = back[..., 2 * HIDDEN :].copy()
            dx += _lstm_back(model, "forward", embedded, mask, kept_f, grads, back[..., :HIDDEN])
            dx += _lstm_back(model, "backward", embedded, mask, kept_b, grads, back[..., HIDDEN : 2 * HIDDEN])
            dx *= 1 - embedded**2
            grads["embed"] += np.einsum("tbi,tbo->io", x, dx)
            grads["embed_bias"] += dx.sum((0, 1))
            step += 1
            for k in model:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                model[k] = model[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


MARK = "\ue000"
# Words that page furniture often has.
FURNITURE = {
    "menu": "home about contact news products services login register search archive blog help sitemap".split(),
    "notice": "we use cookies accept privacy policy subscribe newsletter sign up javascript enable consent".split(),
    "advert": "advertisement sponsored buy now offer sale free shipping deal promoted ad click".split(),
    "form": "email password name submit send subscribe your message username search remember".split(),
    "comments": "reply says posted comments comment like share report thanks great ago guest leave".split(),
    "side": "related popular recent posts tags categories follow us share trending more read also".split(),
    "foot": "copyright © all rights reserved terms privacy imprint contact powered by ·".split(),
}


class _Generator:
    """Pages of many layouts, whose main text is marked."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        letters = ["etaoinshrdlucmfwypvbgk", "enisratdhulcgmobwfkzäöüß", "esaitnrulodcpmévqfbgàèç", "αβγδεζηικλμνορστ", "абвгдежиклмнопрст"]
        self.alphabets = letters

    def words(self, count, furniture=None):
        draw = self.draw
        out = ["".join(draw.choices(self.alphabet, k=draw.randint(1, 9))) for _ in range(count)]
        if furniture and draw.random() < 0.7:
            out = [draw.choice(FURNITURE[furniture]) if draw.random() < 0.5 else w for w in out]
        return out

    def text(self, low, high, furniture=None):
        draw = self.draw
        out = self.words(draw.randint(low, high), furniture)
        sentence = []
        for n, word in enumerate(out):
            sentence.append(word.capitalize() if n == 0 or sentence[-1].endswith(".") else word)
            if draw.random() < 0.1:
                sentence[-1] += draw.choice([".", ",", "."])
        if high > 12 and draw.random() < 0.8:
            sentence[-1] += "."
        return " ".join(sentence)

    def pick(self, *options):
        return self.draw.choice(options)

    def attributes(self, *names):
        kind = self.draw.random()
        name = self.draw.choice(names)
        more = f" {self.pick('wide', 'box', 'clearfix', 'x1', 'inner')}" if self.draw.random() < 0.3 else ""
        if kind < 0.5:
            return f' class="{name}{more}"'
        return f' id="{name}"' if kind < 0.75 else ""

    def links(self, furniture, low=3, high=9):
        items = [f'<a href="/x">{self.text(1, 4, furniture)}</a>' for _ in range(self.draw.randint(low, high))]
        kind = self.draw.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return "".join(f"<p>{i}</p>" for i in items) if kind < 0.75 else self.pick(" | ", " ").join(items)

    def furniture(self):
        """One piece of page furniture, for any place outside the article or between its paragraphs."""
        advert = self.attributes("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-box")
        if not advert:
            advert = ' class="ad"'
        notice = self.attributes("cookie", "notice", "cookie-notice", "popup", "newsletter", "alert", "consent")
        if not notice:
            notice = ' class="notice"'
        return self.pick(
            f"<div{advert}>{self.text(3, 20, 'advert')}</div>",
            f"<div{notice}><p>{self.text(4, 30, 'notice')}</p><button>{self.text(1, 2, 'notice')}</button></div>",
            f"<form>{self.label()}<input name='q'><button>{self.text(1, 2, 'form')}</button></form>",
            f"<nav{self.attributes('menu', 'nav', 'breadcrumbs')}>{self.links('menu')}</nav>",
            f"<aside{self.attributes('sidebar', 'related', 'widget')}><h3>{self.text(1, 3, 'side')}</h3>{self.links('side')}"
            f"{self.pick('', f'<p>{self.text(8, 40, "side")}</p>')}</aside>",
        )

    def label(self):
        return f"<label>{self.text(1, 3, 'form')}</label>"

    def paragraph(self):
        draw = self.draw
        words = (MARK + self.text(1, draw.choice([6, 40, 120]))).split(" ")
        if len(words) > 4 and draw.random() < 0.5:
            at = draw.randrange(1, len(words) - 1)
            tag = self.pick("b", "i", "em", "strong", "span", 'a href="/y"')
            words[at] = f"<{tag}>{words[at]}</{tag.split(' ')[0]}>"
        if len(words) > 4 and draw.random() < 0.1:
            words[2] += "<br>"
        body = " ".join(words)
        kind = draw.random()
        if kind < 0.1:
            return f"<h2>{MARK}{self.text(1, 8)}</h2>"
        if kind < 0.2:
            items = "".join(f"<li>{MARK}{self.text(1, 20)}</li>" for _ in range(draw.randint(2, 5)))
            return f"<{(tag := self.pick('ul', 'ol'))}>{items}</{tag}>"
        if kind < 0.25:
            return f"<blockquote>{body}</blockquote>"
        if kind < 0.28:
            return f"<pre>{body}</pre>"
        if kind < 0.31:
            return f"<table><tr><td>{body}</td><td>{MARK}{self.text(1, 5)}</td></tr></table>"
        if kind < 0.4:
            return f"<p><b>{body}<br>"
        return f"<p>{body}</p>" if kind < 0.95 else f"<div>{body}</div>"

    def comments(self):
        tag = self.pick("div", "section", "ol")
        item = "li" if tag == "ol" else "div"
        attributes = self.attributes("comments", "comment-list", "discussion", "replies", "respond")
        if not attributes:
            attributes = ' class="comments"'
        each = "".join(
            f'<{item} class="comment"><span>{self.text(1, 3, "comments")}</span><p>{self.text(3, 50, "comments")}</p></{item}>'
            for _ in range(self.draw.randint(1, 5))
        )
        return f"<{tag}{attributes}>{self.pick('', f'<h3>{self.text(1, 3, "comments")}</h3>')}{each}</{tag}>"

    def page(self):
        draw = self.draw
        self.alphabet = draw.choice(self.alphabets)
        out = ["<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body>"]
        head = f"<header{self.attributes('header', 'top', 'masthead')}>{self.pick('', f'<h1>{self.text(1, 4)}</h1>')}{self.text(1, 6, 'menu')}</header>"
        nav = f"<{(tag := self.pick('nav', 'nav', 'div class="menu"', 'div id="nav"'))}>{self.links('menu')}</{tag.split(' ')[0]}>"
        out += [x for x in (head, nav) if draw.random() < 0.6] if draw.random() < 0.9 else []
        out += [self.furniture() for _ in range(draw.choice([0, 0, 1, 1, 2]))]
        main = self.pick(
            "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"',
            'div class="article-body"', 'div id="main"', 'section class="story"',
        )
        title = f"<h1>{MARK}{self.text(2, 12)}</h1>"
        if main in ("article", "main") and draw.random() < 0.2:
            title = f"<header>{title}</header>"
        body = [title] if draw.random() < 0.9 else []
        count = draw.choice([1, 3, 6, 12, 25])
        for _ in range(draw.randint(1, count)):
            body.append(self.paragraph())
            if draw.random() < 0.04:
                body.append(self.furniture())
        inner = "".join(body)
        if draw.random() < 0.3:
            inner = f"<div>{inner}</div>"
        if main == "article" and draw.random() < 0.2:
            out.append("<main>")
        out.append(f"<{main}>{inner}</{main.split(' ')[0]}>")
        out += [self.furniture() for _ in range(draw.choice([0, 0, 1, 2]))]
        if draw.random() < 0.3:
            out.append(self.comments())
        foot = self.pick("footer", "footer", 'div class="footer"', 'div id="foot"')
        if draw.random() < 0.85:
            body = self.pick(f"{self.text(3, 20, 'foot')}", f"<p>{self.text(3, 20, 'foot')}</p>{self.links('foot', 1, 4)}")
            out.append(f"<{foot}>&copy; {body}</{foot.split(' ')[0]}>")
        return "".join(out) + ("</body></html>" if draw.random() < 0.8 else "")


def generated(count: int, seed: int) -> list[tuple[list, np.ndarray]]:
    """Blocks and labels of generated pages."""
    maker, out = _Generator(seed), []
    for _ in range(count):
        found = blocks_of(maker.page())
        label = np.array([MARK in text for _, text, _ in found], np.float32)
        out.append(([(path, text.replace(MARK, ""), linked) for path, text, linked in found], label))
    return out


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> dict[str, np.ndarray]:
    """The labeller, fitted to ``pages`` generated pages. The same every time."""
    made = [(b, y) for b, y in generated(pages, seed) if b]
    return train(list(zip(features([b for b, _ in made]), (y for _, y in made), strict=True)))


def extract_text(model: dict[str, np.ndarray], htmls: list[str]) -> list[str]:
    blocks = [blocks_of(h) for h in htmls]
    found = predict(model, features(blocks))
    return [
        "\n\n".join(text for (_, text, _), p in zip(page, share, strict=True) if p >= 0.5)
        for page, share in zip(blocks, found, strict=True)
    ]


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None
) -> DataFrame:
    """``(page_id, url, text)`` for every row: the blocks that the labeller takes for main text, in page order, joined by
    two line feeds.

    A block is a run of text between block-level tags, with character references decoded and white space as single
    spaces; scripts, styles and the head have none. A two-way LSTM reads each page's blocks as vectors of hashed tag
    path, hashed words and a few measures, and labels every block in view of the whole page. Null and empty pages, and pages
    without main text, give an empty text. Null and repeated ids stay; other columns are not read. An empty table
    gives no rows. The model is fitted on the driver and sent with the tasks (about 100 kB).
    """
    model = model or trained()
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * PAGES_AT_ONCE):
                part = batch.slice(at, 4 * PAGES_AT_ONCE)
                texts = extract_text(model, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    return rows.mapInArrow(run, f"{', '.join(kinds)}, text string")
