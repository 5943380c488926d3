"""HTML main text by consensus host paths.

Each page is parsed once, in Arrow batches: its blocks (text, containers around it, characters of links, marks of noise) are
written down, and its containers are scored (text of their own blocks less the text of links); the best one votes with its
generalised tag-class path (digits removed) for its host; the winner by votes, then score, then path is extracted from the
blocks of each page of the host, or the page's own best container where it lacks that path. Blocks inside noise (by tag or by
words of class and id) are marked, not cut: a mark does not count on an element that holds more than half of a page's text
without links, nor on the container taken or what is around it, and where only marked blocks are left they are taken.

Null or empty html gives an empty text; pages without a host vote together; votes tie by score, then path; an empty table
gives no rows; repeated rows are extracted alike; whole pages are read, whatever their length; other columns, whatever their
names, are ignored."""
import json
import re
from html.parser import HTMLParser

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronorank.llm.shared import settled, small

# Never text; and noise unless the page's text lies there.
CUT = {"script", "style", "noscript", "template", "iframe", "svg", "head"}
DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "menu", "dialog"}
BOXES = {"article", "main", "section", "div", "body", "td"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "script", "style", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
NOISE = re.compile(r"(^|[-_ ])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|discussion|disqus\w*|cookies?|disclaimer|footer|header|menu|nav|navbar|navigation\w*|navlist|navmenu|navs|newsletter|notice|popup|promo\w*|related|replies|respond|responses|share|sidebar|social|sponsor\w*|subscribe)($|[-_ ])", re.I)


TITLED, OWN = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}, {"article", "main"}


class Page(HTMLParser):
    """blocks: (paths of the open containers, text, link characters, marks); a mark is a noisy element and how many containers are around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text, self.link, self.blocks, self.n = [], [], 0, [], 0

    def _end_block(self):
        if t := " ".join("".join(self.text).split()):
            self.blocks.append((tuple(p for _, p, _, _ in self.stack if p), t, self.link, tuple(m for _, _, _, m in self.stack if m)))
        self.text, self.link = [], 0

    def _dropped(self):
        return any(d for _, _, d, _ in self.stack)

    def _noisy(self, tag, a):
        if tag in DROP:
            return True
        if tag in TITLED or tag == "body" or tag in OWN and not any(t in OWN for t, _, _, _ in self.stack):
            return False
        i = a.get("id") or ""
        return bool(NOISE.search(a.get("class") or "") or (NOISE.search(i) if tag != "section" or not re.search(r"[-_ ]", i) else None))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE and tag != "br":
            self._end_block()
            if tag in ("p", "li", "tr", "td", "h1", "h2", "h3", "article", "div", "section") and (open_p := next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == "p"), None)) is not None and tag in ("p", "article", "div", "section", "h1", "h2", "h3"):
                del self.stack[open_p:]
        if tag in VOID:
            return
        a = dict(attrs)
        path = None
        if tag in BOXES:
            up = next((p for _, p, _, _ in reversed(self.stack) if p), "")
            path = f"{up}/{tag}" + "".join("." + re.sub(r"\d+", "", c) for c in (a.get("class") or "").split())
        self.n += 1
        self.stack.append((tag, path, tag in CUT, (self.n, sum(p is not None for _, p, _, _ in self.stack)) if self._noisy(tag, a) else None))

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if not self._dropped():
            self.text.append(data)
            self.link += len(data) * any(t == "a" for t, _, _, _ in self.stack)


def blocks(html):
    p = Page()
    p.feed(html or "")
    p.close()
    p._end_block()
    held, total = {}, 0
    for _, t, link, marks in p.blocks:
        own = max(0, len(t) - 2 * link)
        total += own
        for m in marks:
            held[m] = held.get(m, 0) + own
    return [(paths, t, link, tuple(m for m in marks if 2 * held[m] <= total)) for paths, t, link, marks in p.blocks]


def best(found):
    """(path, score) of the best container: most text without links, deepest among equals."""
    score = {}
    for paths, t, link, marks in found:
        for x in paths if not marks else ():
            score[x] = score.get(x, 0) + len(t) - 2 * link + 100 * ("/article" in x)
    return max(((x, s) for x, s in score.items()), key=lambda v: (v[1], len(v[0]), v[0]), default=("", 0))


def inside(found, path):
    """Texts of the container (or the page, without one) but for noise strictly inside it; with nothing else, that too."""
    of = [(t, paths.index(path) if path else -1, marks) for paths, t, _, marks in found if not path or path in paths]
    return [t for t, i, marks in of if all(k <= i for _, k in marks)] or [t for t, _, _ in of]


HOSTS = 200_000  # host paths that may be broadcast


def pack(found):
    """Blocks as text: containers and marks are numbered, as most blocks share them."""
    paths, marks = {}, {}
    rows = [([paths.setdefault(x, len(paths)) for x in p], t, n, [marks.setdefault(m, len(marks)) for m in ms]) for p, t, n, ms in found]
    return json.dumps([list(paths), [list(m) for m in marks], rows])


def unpack(text):
    paths, marks, rows = json.loads(text)
    return [(tuple(paths[i] for i in p), t, n, tuple(tuple(marks[i]) for i in ms)) for p, t, n, ms in rows]


def _parse(batches):
    for pdf in batches:
        found = [blocks(h if isinstance(h, str) else "") for h in pdf["html"]]
        top = [best(x) for x in found]
        yield pdf[["page_id", "url", "host"]].assign(path=[x for x, _ in top], score=[s for _, s in top], found=list(map(pack, found)))


def _take(batches):
    for pdf in batches:
        out = []
        for text, mine, win in zip(pdf["found"], pdf["path"], pdf["win"]):
            found = unpack(text)
            out.append("\n".join((inside(found, win) if win else []) or inside(found, mine)))
        yield pdf[["page_id", "url"]].assign(text=out)


def extract(pages):
    """page_id, url, text, n_chars."""
    kind = dict(pages.dtypes)["page_id"]
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/]*:?//([^/?#]+)", 1)), F.lit(""))
    p = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), "html")  # ids as text: beside nulls they would become floats
    p = settled(p.mapInPandas(_parse, "page_id string, url string, host string, path string, score long, found string"))
    votes = p.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    win = votes.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("s"), "path"))).where("r = 1").select("host", F.col("path").alias("win"))
    out = p.join(small(win, HOSTS), "host", "left").select("page_id", "url", "found", "path", "win").mapInPandas(_take, "page_id string, url string, text string")
    return out.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
