"""The one pass over pages that needs a document tree: main text, meta map, links, forms and calls to action.

Everything else about a page is a native column. A page is walked once, in Arrow batches of at most `rules.PAGES_AT_ONCE` pages; a walk keeps the open
elements only. All text goes to one list, in which an open link or button remembers its beginning, until more follows than a call to action may have: unclosed elements cost no
more than closed ones, however many there are.
Defined results: a null page counts as empty; malformed markup is read as far as it goes and never fails.
Block elements end a line of main text, as layout would; what layout hides is not known.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..schemas import PARSED

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class Walk(HTMLParser):
    """What a page holds, gathered while its elements open and close."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base = base
        self.open: list[tuple[str, int | None, str | None]] = []  # tag, number of what it gathers, place among CONTENT_ORDER
        self.times: Counter[str] = Counter()  # open elements of each tag
        self.pieces: list[str] = []
        self.size = 0  # characters of all pieces
        self.gathering: dict[int, tuple[int, int]] = {}  # pieces and characters before an open link or button
        self.oldest: deque[int] = deque()  # what gathers or did, in the order of beginnings
        self.places: list[str] = []  # open places
        self.hidden = 0  # open elements that are pruned
        self.content: dict[str, list[str]] = {}
        self.meta: dict[str, str] = {}
        self.links: dict[str, None] = {}
        self.forms: list[list[str]] = []
        self.form_depth = 0
        self.actions: list[str] = []  # texts of links and buttons, empty where they are too long
        self.action_classes: list[str] = []
        self.label: list[str] | None = None
        self.label_open: int | None = None

    def _pruned(self, tag: str, classes: list[str]) -> bool:
        return tag in rules.PRUNED_TAGS or any(c in rules.PRUNED_CLASSES for c in classes)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        attr = {k: v or "" for k, v in reversed(attrs)}
        classes = attr.get("class", "").split()
        pruned = self._pruned(tag, classes)
        if tag in _BLOCK:
            self._text("\n")
        if not self.hidden and not pruned:
            if tag == "meta" and (key := attr.get("name") or attr.get("property")) and attr.get("content"):
                self.meta[key] = attr["content"]
            if tag == "a" and "href" in attr:
                try:
                    link = urljoin(self.base, attr["href"].strip())
                except ValueError:
                    link = ""
                if link.lower().startswith("http"):
                    scheme, _, rest = link.partition("://")
                    host, slash, path = rest.partition("/")
                    self.links[f"{scheme.lower()}://{host.lower()}{slash or '/' * ('?' not in host and '#' not in host)}{path}"] = None
        if tag == "form":
            self.forms.append([])
            self.form_depth += 1
        if tag in ("input", "textarea", "select") and self.form_depth and attr.get("type", "text").lower() not in rules.NO_FIELDS:
            name = (attr.get("aria-label") or attr.get("placeholder") or attr.get("name") or attr.get("id") or "").strip()
            name = name or "".join(t.strip() for t in self.label or ())
            if name:
                self.forms[-1].append(name.lower())
        if tag in _VOID:
            return
        gathers: int | None = None
        if tag in ("a", "button"):
            gathers = len(self.actions)
            self.gathering[gathers] = len(self.pieces), self.size
            self.oldest.append(gathers)
            self.actions.append("")
            self.action_classes.append(" ".join(classes))
        if tag == "label":
            self.label, self.label_open = [], len(self.open)
        place = None
        if not self.hidden and not pruned:
            names = [tag, "#" + attr.get("id", ""), *("." + c for c in classes)]
            place = next((p for p in rules.CONTENT_ORDER if p in names and p not in self.content), None)
            if place:
                self.content[place] = []
                self.places.append(place)
        self.hidden += pruned
        self.times[tag] += 1
        self.open.append((tag, gathers, place if not pruned else "-"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self._text("\n")
        if not self.times[tag]:
            return
        while self.open:
            t, gathers, place = self.open.pop()
            self.times[t] -= 1
            if gathers in self.gathering:
                self.actions[gathers] = self._since(self.gathering.pop(gathers)[0])
            if place and place != "-":
                self.places.remove(place)
            if self.label_open == len(self.open):
                self.label_open = None
            self.hidden -= place == "-"
            self.form_depth -= t == "form"
            if t == tag:
                break

    def _text(self, data: str) -> None:
        if self.hidden:
            return
        self.content.setdefault("", []).append(data)
        for place in self.places:
            self.content[place].append(data)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.pieces.append(data)
        self.size += len(data)
        # The oldest have gathered most; those that closed are passed over.
        while self.oldest and self.size - self.gathering.get(self.oldest[0], (0, self.size - rules.LONGEST_ACTION - 1))[1] > rules.LONGEST_ACTION:
            self.gathering.pop(self.oldest.popleft(), None)
        if self.label_open is not None:
            self.label.append(data)
        self._text(data)

    def _since(self, piece: int) -> str:
        return "".join(t.strip() for t in self.pieces[piece:])

    def close(self) -> None:
        super().close()
        texts: dict[int, str] = {}
        for k, (piece, _) in self.gathering.items():
            if piece not in texts:
                texts[piece] = self._since(piece)
            self.actions[k] = texts[piece]

    def main_text(self) -> str:
        for place in rules.CONTENT_ORDER:
            text = _laid_out(self.content.get(place, []))
            if len(text.encode("utf-16-le", "surrogatepass")) // 2 > rules.LEAST_CONTENT:
                return text
        return _laid_out(self.content.get("body") or self.content.get("", []))


def _laid_out(parts: list[str]) -> str:
    """Text as lines: blanks within a line collapse, empty lines go."""
    raw = "".join(p if p == "\n" else " ".join(p.split("\n")) for p in parts)
    return "\n".join(line for line in (" ".join(x.split()) for x in raw.split("\n")) if line)


def walked(html: str | None, url: str | None) -> dict:
    walk = Walk(url or "")
    walk.feed(html or "")
    walk.close()
    forms = [{"fields": f, "field_count": len(f), "likely_lead_capture": any(h in x for x in f for h in rules.LEAD_HINTS)} for f in walk.forms if f]
    actions = [{"text": text, "classes": classes} for text, classes in zip(walk.actions, walk.action_classes, strict=True)]
    return {"main_text": walk.main_text(), "meta": list(walk.meta.items()), "links": list(walk.links), "forms": forms, "actions": actions}


def parsed(pages: DataFrame, html: str = "html", url: str = "final_url") -> DataFrame:
    """pages with main_text, meta, links, forms and actions."""
    arrow = pa.struct([
        ("main_text", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("links", pa.list_(pa.string())),
        ("forms", pa.list_(pa.struct([("fields", pa.list_(pa.string())), ("field_count", pa.int32()), ("likely_lead_capture", pa.bool_())]))),
        ("actions", pa.list_(pa.struct([("text", pa.string()), ("classes", pa.string())]))),
    ])

    @F.arrow_udf(f"struct<{PARSED.replace(' string', ':string').replace(' map', ':map').replace(' array', ':array')}>")
    def walk(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, urls in parts:
            yield pa.array([walked(h, u) for h, u in zip(htmls.to_pylist(), urls.to_pylist(), strict=True)], arrow)

    conf = pages.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rules.PAGES_AT_ONCE))
    return pages.withColumn("_walk", walk(F.col(html), F.col(url))).select(*pages.columns, "_walk.*")


def calls_to_action(actions: Column) -> Column:
    """Short texts of links and buttons that begin with an action word or look like a button: distinct, sorted, fifteen at most."""
    def is_call(a: Column) -> Column:
        words = F.split(F.regexp_replace(a["text"], r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
        first = F.regexp_replace(F.lower(F.get(words, 0)), r"^[.,!:]+|[.,!:]+$", "")
        return (a["text"] != "") & (F.size(words) <= rules.MOST_ACTION_WORDS) & (first.isin(*rules.ACTION_WORDS) | F.lower(a["classes"]).rlike("|".join(rules.ACTION_CLASSES)))

    return F.slice(F.array_sort(F.array_distinct(F.transform(F.filter(actions, is_call), lambda a: a["text"]))), 1, rules.MOST_ACTIONS)
