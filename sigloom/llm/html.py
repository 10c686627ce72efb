"""Main text of web pages by template deduction from token equivalence classes.

A token is a tag in its place: its name with class and id, below its container elements, known by a 64-bit hash.  Runs
of digits in class and id count as one sign, and those of html, body, article and main are left out, as they name the
page.  For each host every token's occurrence vector over the host's pages is summed up in a commutative hash, so the
vectors of any number of pages are compared without being gathered.  Tokens with one vector form an equivalence
class; classes on at least ``SHARE`` of the host's pages (and two of them) are valid.  Sorted by support and place, and
nested by their containers, they are the host's template.

The template decides.  A container of a valid class is a slot if its text differs from page to page; if it has the same text
on all its pages (three or more, and not all copies of one page), it is part of the template and left out with all it holds.  The
main slot is the host's articles or main element, if they hold a quarter of the text outside boilerplate elements, or else the
lowest container of all that text; containers count the text of everything below them, be it in the template or not.  A page's
text is what the page has in the main slot.  A page whose host has no template, or that lacks the main slot, is judged by
its own tokens alone.

Elements made for other things (navigation, headers, forms and so on) never hold main text.  Names in class and id tell
what differs from page to page and still isn't the article, such as comments; they don't count where they would leave
next to nothing: if a host has under ``SPARE`` of its text outside of named containers, its largest one is freed, and on a
page without any other text its largest one is.

Single paragraphs are no containers, so one that a host's pages share stays.  Null or empty html gives an empty
text; a null url counts as a host of its own; repeated rows and repeated page_ids give repeated rows; other
columns are ignored.  Work and memory grow with a page's length, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ROWS_PER_BATCH, Cut, _arrow_schema

SHARE, SPARE, SMALL_MB, SALTS = 0.3, 0.1, 8, 32

#: Elements by what they do to text (fixed values).
CONTAINERS = {"html", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "table", "td", "ul", "ol", "dl", "figure", "blockquote", "details", "dialog", "fieldset", "menu"}
#: What may be a slot, and what stands for itself whatever its class and id.
SLOTS, PLAIN = {"html", "body", "article", "main", "section", "div"}, {"html", "body", "article", "main"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "pre", "br", "hr", "figcaption", "address", "summary", "caption", "legend", "title", "option"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "select", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "track", "area", "base", "col", "embed"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset", "button"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "note"}
NAMES = re.compile(
    r"(?:^|[\s_\-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|notification|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|"
    r"comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|popup|modal|overlay|widget|toolbar|search|pagination|pager|tags)(?:$|[\s_\-])",
    re.I,
)
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
#: Start tags that end an open element of these names, if it is the innermost one (fixed values).
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
DIGITS = re.compile(r"\d+")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)


def _label(name: str, attributes: str) -> tuple[str, int]:
    """Tag with class and id, and whether it is boilerplate: 2 by what it is, 1 by its name."""
    got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    own = " ".join(x for x in (got.get("class"), got.get("id")) if x)
    hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    if name in BOILERPLATE or hidden or got.get("role", "").lower() in ROLES:
        bad = 2
    else:
        bad = int(bool(own and name not in PLAIN and NAMES.search(own)))
    return name + ("" if name in PLAIN else "".join(f".{x}" for x in sorted(set(DIGITS.sub("#", own).split())))), bad


def _key(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1) - (1 << 63)


class Page:
    """A page's containers (key, label, container, first place, boilerplate), its tokens' counts and its text blocks ``(container, text)``."""

    def __init__(self, page: str | None):
        page = page or ""
        self.keys, self.labels, self.parents, self.places, self.bad = [0], [""], [-1], [0], [0]
        self.tokens: dict[int, list] = {}  # key: number, first place, label, container's key
        self.blocks: list[tuple[int, str]] = []
        stack: list[tuple[str, int]] = [("", 0)]
        opened: dict[str, int] = {}
        words: list[str] = []
        at = place = 0

        def close() -> None:
            if words:
                text = " ".join(entities.unescape("".join(words)).split())
                if text:
                    self.blocks.append((stack[-1][1], text))
                words.clear()

        def pop() -> str:
            name = stack.pop()[0]
            opened[name] -= 1
            return name

        def seen(key: int, label: str) -> None:
            nonlocal place
            place += 1
            self.tokens.setdefault(key, [0, place, label, self.keys[stack[-1][1]]])[0] += 1

        while True:
            m = TAG.search(page, at)
            words.append(page[at : m.start()] if m else page[at:])
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            block = name in BLOCKS or name == "head"
            if block:
                close()
            if m[1] or m[4]:
                seen(_key(self.keys[stack[-1][1]], f"/{name}"), f"/{name}")
                if opened.get(name):
                    while pop() != name:
                        pass
                continue
            attributes = m[3] or m[6] or ""
            label, bad = _label(name, attributes)
            if block and stack[-1][0] == "p":
                pop()
            for _ in range(2):
                if stack[-1][0] in ENDS.get(name, ()):
                    pop()
            if name == "body" and opened.get("head"):
                while pop() != "head":
                    pass
            top = stack[-1][1]
            key = _key(self.keys[top], label)
            seen(key, label)
            if name in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if (name in CONTAINERS or name in ("head", "button") or bad) and name not in VOID and not attributes.endswith("/"):
                for values, x in ((self.keys, key), (self.labels, label), (self.parents, top), (self.places, place), (self.bad, bad)):
                    values.append(x)
                stack.append((name, len(self.keys) - 1))
                opened[name] = opened.get(name, 0) + 1
        close()

    def flags(self, freed: int = 0) -> list[int]:
        """For each container the worst mark of it and those around it; ``freed`` has none by its name."""
        out = [0]
        for i in range(1, len(self.keys)):
            own = 0 if self.bad[i] == 1 and self.keys[i] == freed else self.bad[i]
            out.append(max(own, out[self.parents[i]]))
        return out

    def whole(self, flags: list[int], mark: int) -> list[int]:
        """Characters of text in and below each container, of blocks with this mark."""
        out = [0] * len(self.keys)
        for i, text in self.blocks:
            if flags[i] == mark:
                out[i] += len(text)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def named(self, flags: list[int]) -> dict[int, int]:
        """Characters by key of the outermost containers that only their names mark."""
        sizes, out = self.whole(flags, 1), {}
        for i in range(1, len(self.keys)):
            if flags[i] == 1 and not flags[self.parents[i]] and sizes[i]:
                out[self.keys[i]] = out.get(self.keys[i], 0) + sizes[i]
        return out

    def contents(self) -> list[int]:
        """A hash of all text in and below each container, in its order."""
        out = [0] * len(self.keys)
        for n, (i, text) in enumerate(self.blocks):
            out[i] += xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return [x & (1 << 63) - 1 for x in out]


def main_slot(labels: dict[int, str], parents: dict[int, int], whole: dict[int, int], total: int) -> int:
    """The key of the slot that holds the text, from the characters in and below containers (outer ones first): the lowest
    container of all articles, or of main elements, with a quarter of the ``total``; without them, of all text; 0: none."""
    if not total:
        return 0
    tag = {k: x.partition(".")[0] for k, x in labels.items()}
    within: dict[int, bool] = {}  # whether a container lies in an article
    for k in labels:
        p = parents.get(k, 0)
        within[k] = within.get(p, False) or tag.get(p) == "article"
    outer = [k for k in labels if tag[k] in ("article", "main") and whole.get(k) and not within[k]]
    outer = [k for k in outer if tag[k] == "article"] or outer
    goal, need = (set(outer), sum(whole[k] for k in outer)) if outer and sum(whole[k] for k in outer) * 4 >= total else (None, total)
    held = dict.fromkeys(labels, 0)
    if goal is not None:  # text of the articles in and below each container
        for k in reversed(list(labels)):
            held[k] += whole[k] if k in goal else 0
            if parents.get(k, 0) in held:
                held[parents[k]] += held[k]
    else:
        held = whole
    found = 0
    for k in labels:  # outer ones come first, so the last one is the lowest
        if held.get(k, 0) >= need and tag[k] in SLOTS and not within[k]:
            found = k
    return found


def text_of(page: str | None, main: int = 0, fixed: frozenset = frozenset(), freed: int = 0) -> str:
    """The page's text in slot ``main``, or in the one its own tokens give, without ``fixed`` containers."""
    p = Page(page)
    flags = p.flags(freed)
    if not any(flags[i] == 0 for i, _ in p.blocks):
        named = p.named(flags)
        flags = p.flags(max(named, key=lambda k: (named[k], k))) if named else flags
    out = [False] * len(p.keys)
    inside = [False] * len(p.keys)
    for i in range(1, len(p.keys)):
        inside[i] = inside[p.parents[i]] or p.keys[i] == main
        out[i] = out[p.parents[i]] or (p.keys[i] in fixed and p.keys[i] != main)
    good = [(i, t) for i, t in p.blocks if not flags[i] and not out[i]]
    if not main or not any(inside[i] for i, _ in good):
        sizes, labels, parents, whole = p.whole(flags, 0), {}, {}, {}
        for i in range(1, len(p.keys)):
            k = p.keys[i]
            labels.setdefault(k, p.labels[i])
            parents.setdefault(k, p.keys[p.parents[i]])
            whole[k] = whole.get(k, 0) + sizes[i]
        main = main_slot(labels, parents, whole, sizes[0])
        for i in range(1, len(p.keys)):
            inside[i] = inside[p.parents[i]] or p.keys[i] == main
    return "\n".join(t for i, t in good if inside[i] or not main)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.\-]*:)?//([^/?#]*)", url or "")
    return (m[1] if m else "").rpartition("@")[2].lower()


COUNTS = "host string, token long, label string, parent long, support long, vector long, place double, chars long, named long, least long, most long, first long, last long"


def token_counts(pages: DataFrame) -> DataFrame:
    """By host and token: pages, hashed occurrence vector, mean place, characters of text in and below (and of those that only a name
    marks), least and greatest hash of the text in it, and of its pages' text; and by host (token 0) its pages and all text.
    ``pages (key, url, html)``; each task adds up what it reads."""
    arrow = _arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            rows = [(*k, *v[:3], v[3] - (1 << 64) if v[3] >> 63 else v[3], *v[4:]) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for b in batches:
            for i in range(b.num_rows):
                row, host = str(b.column(0)[i].as_py()), host_of(b.column(1)[i].as_py())
                p = Page(b.column(2)[i].as_py())
                flags, contents = p.flags(), p.contents()
                whole, text = p.whole(flags, 0), contents[0]
                own: dict[int, list] = {0: [whole[0], text]}
                for k, key in enumerate(p.keys):
                    if k:
                        x = own.setdefault(key, [0, 0])
                        x[0] += whole[k]
                        x[1] = (x[1] * 31 + contents[k]) & (1 << 63) - 1
                named = p.named(flags)
                tokens = {0: [1, 0, "", 0], **p.tokens}
                for key, (n, first, label, parent) in tokens.items():
                    chars, content = own.get(key, (0, 0))
                    x = held.setdefault((host, key), [label, parent, 0, 0, 0.0, 0, 0, content, content, text, text])
                    x[2] += 1
                    x[3] = (x[3] + xxhash.xxh3_64_intdigest(f"{row}:{n}".encode())) & (1 << 64) - 1
                    x[4] += first
                    x[5] += chars
                    x[6] += named.get(key, 0)
                    x[7:] = min(x[7], content), max(x[8], content), min(x[9], text), max(x[10], text)
                if len(held) > 100_000:
                    yield out()
        yield out()

    sums = [F.sum(c).alias(c) for c in ("support", "place", "chars", "named")]
    ends = [F.min(c).alias(c) for c in ("label", "parent", "least", "first")] + [F.max(c).alias(c) for c in ("most", "last")]
    return pages.mapInArrow(run, COUNTS).groupBy("host", "token").agg(*sums, _wrapped_sum("vector"), *ends)


def _wrapped_sum(column: str):
    """A sum modulo 2**64 that never overflows: halves are added apart."""
    low, high = F.col(column).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(column, 32)
    low, high = F.sum(low), F.sum(high)
    carried = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF))).alias(column)


def deduce(rows: pd.DataFrame) -> tuple[int, list[int], int, str, list[dict]]:
    """Main slot, fixed containers, freed container, the main slot's path and the template of a host from its tokens' counts."""
    host = rows[rows["token"] == 0]
    total = int(host["chars"].sum())
    rows = rows[rows["token"] != 0].assign(mean=lambda x: x["place"] / x["support"]).sort_values(["mean", "token"])
    classes, valid = [], set()
    for (support, _), g in rows.groupby(["support", "vector"]):
        if len(g) > 1:
            classes.append({"support": int(support), "start": float(g["mean"].iloc[0]), "end": float(g["mean"].iloc[-1]), "tokens": g["label"].tolist()})
            valid |= set(g["token"])
    classes.sort(key=lambda c: (-c["support"], c["start"], c["tokens"]))
    for i, c in enumerate(classes):  # a class lies in the latest one before it whose tokens stand around its own
        around = [k for k in range(i) if classes[k]["start"] <= c["start"] and c["end"] <= classes[k]["end"]]
        c["within"] = around[-1] if around else -1
    rows = rows[rows["token"].isin(valid)]
    labels = dict(zip(rows["token"].tolist(), rows["label"], strict=True))
    parents = dict(zip(rows["token"].tolist(), rows["parent"].tolist(), strict=True))
    same = rows[(rows["support"] > 2) & (rows["chars"] > 0) & (rows["least"] == rows["most"]) & (rows["first"] != rows["last"])]
    fixed = dict(zip(same["token"].tolist(), same["chars"].astype(int).tolist(), strict=True))
    named = rows[rows["named"] > 0].sort_values(["named", "token"])
    differs = total - sum(n for t, n in fixed.items() if parents[t] not in fixed)
    if len(named) and differs < SPARE * (differs + int(named["named"].sum())):
        main = freed = int(named["token"].iloc[-1])
    else:
        freed, main = 0, main_slot(labels, parents, dict(zip(rows["token"].tolist(), rows["chars"].astype(int).tolist(), strict=True)), total)
    keep, path, at = {main}, "", main
    while at in labels:
        path, at = f">{labels[at]}{path}", parents[at]
        keep.add(at)
    return main, [t for t in fixed if t not in keep], freed, path, classes


def templates(pages: DataFrame) -> DataFrame:
    """``(host, n_pages, main, slot, fixed, freed, template)``: main slot (path and key), containers of the template's own text, and
    nested classes (JSON) of each host."""
    cut = Cut(pages.sparkSession)
    counts = cut.write(token_counts(pages))
    totals = counts.where("token = 0").select("host", F.col("support").alias("n_pages"))
    # a token on SHARE of the pages: a host has at most (tokens of a page) / SHARE of them
    common = counts.join(totals, "host").where((F.col("support") >= F.greatest(F.lit(2.0), F.col("n_pages") * SHARE)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        slot, fixed, freed, main, classes = deduce(rows)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "n_pages": [int(rows["n_pages"].iloc[0])], "main": [main], "slot": [slot], "fixed": [fixed], "freed": [freed], "template": [json.dumps(classes)]})

    return common.groupBy("host").applyInPandas(run, "host string, n_pages long, main string, slot long, fixed array<long>, freed long, template string")


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """The contract's row for each page."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    found = Cut(spark).write(templates(pages).select("host", F.struct("slot", "fixed", "freed").alias("main")))
    size = found.agg(F.sum(F.length("host") + 200 + 64 * F.size("main.fixed"))).first()[0] or 0
    arrow = _arrow_schema(EXTRACTED)

    def rows(part: pa.RecordBatch, mains: list[dict | None]) -> pa.RecordBatch:
        texts = [text_of(h, m["slot"], frozenset(m["fixed"]), m["freed"]) if m else text_of(h) for h, m in zip(part.column(2).to_pylist(), mains, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(arrow.field(1).type), pa.array(texts, arrow.field(2).type), pa.array(list(map(len, texts)), pa.int64())], schema=arrow)

    if size <= SMALL_MB << 20:
        shared = spark.sparkContext.broadcast({r.host: r.main.asDict() for r in found.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS_PER_BATCH):
                    part = b.slice(at, ROWS_PER_BATCH)
                    yield rows(part, [shared.value.get(host_of(u.as_py())) for u in part.column(1)])

        return pages.mapInArrow(run, EXTRACTED)
    # many hosts: each template goes to some salts, so that a host with a third of all pages is dealt out
    host = F.lower(F.coalesce(F.regexp_replace(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.\-]*:)?//([^/?#]*)", 1), "^.*@", ""), F.lit("")))
    salted = found.select("host", "main", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    left = pages.withColumn("host", host).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS_PER_BATCH):
                part = b.slice(at, ROWS_PER_BATCH)
                yield rows(part, part.column(3).to_pylist())

    return left.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "main").mapInArrow(run_joined, EXTRACTED)
