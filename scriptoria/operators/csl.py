"""Citation styles as column expressions: a style's XML is compiled, once for each kind of item, to what a row of items writes.

Items have the columns of ITEM. Only these variables exist, so conditions on others, and on the type and on whether there are authors, are decided while compiling, and what is left is a
plain expression without loops over rows. A style comes as text, from a caller's file; terms and dates come from TERMS, a locale file and the style's own locales, the last of these first.

Not there: notes, locators, disambiguation by given names, editors and other roles than authors, seasons and date ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F

from .styles import StyleError, inspect

ITEM = {
    "title": "title", "container-title": "container_title", "container-title-short": "container_title_short", "volume": "volume", "issue": "issue", "page": "page", "DOI": "DOI", "URL": "URL", "PMID": "PMID",
    "publisher": "publisher", "publisher-place": "publisher_place", "event-title": "event_title", "event": "event_title",
}
TYPES = ("article-journal", "paper-conference", "article", "book", "chapter", "report", "thesis", "manuscript")
MONTHS = "January February March April May June July August September October November December".split()
#: English terms: (name, form): (one, several).
TERMS = {
    ("and", "long"): ("and", "and"), ("et-al", "long"): ("et al.", "et al."), ("in", "long"): ("in", "in"), ("no date", "long"): ("no date", "no date"), ("no date", "short"): ("n.d.", "n.d."),
    ("page", "long"): ("page", "pages"), ("page", "short"): ("p.", "pp."), ("volume", "long"): ("volume", "volumes"), ("volume", "short"): ("vol.", "vols."), ("issue", "long"): ("issue", "issues"), ("issue", "short"): ("no.", "nos."),
    ("open-quote", "long"): ("“", "“"), ("close-quote", "long"): ("”", "”"), ("retrieved", "long"): ("retrieved", "retrieved"), ("from", "long"): ("from", "from"), ("available at", "long"): ("available at", "available at"),
    ("presented at", "long"): ("presented at the", "presented at the"), ("internet", "long"): ("internet", "internet"), ("anonymous", "long"): ("anonymous", "anonymous"), ("page-range-delimiter", "long"): ("–", "–"),
}
#: Names that are added, at most, to tell citations apart.
ADDED = 3
_HTML = {"font-style": {"italic": "i", "oblique": "i"}, "font-weight": {"bold": "b"}, "vertical-align": {"sup": "sup", "sub": "sub"}, "text-decoration": {"underline": "u"}}
_NAME = ("and", "delimiter-precedes-et-al", "delimiter-precedes-last", "et-al-min", "et-al-use-first", "et-al-use-last", "initialize", "initialize-with", "initialize-with-hyphen", "name-as-sort-order", "sort-separator")

Truth = bool | Column


def any_of(xs: list[Truth]) -> Truth:
    rest = [x for x in xs if x is not False]
    return True if any(x is True for x in rest) else reduce(lambda a, b: a | b, rest) if rest else False


def negated(x: Truth) -> Truth:
    return not x if isinstance(x, bool) else ~x


def all_of(xs: list[Truth]) -> Truth:
    return negated(any_of([negated(x) for x in xs])) if any(isinstance(x, bool) for x in xs) else reduce(lambda a, b: a & b, xs)


@dataclass
class Out:
    """What an element writes: text, null where some is false. asks: it calls variables (of a choice, in the branch that is taken); filled: one of these has a value."""

    text: Column
    some: Truth
    asks: Truth = False
    filled: Truth = False


def _when(cond: Truth, text: Column) -> Column | None:
    return text if cond is True else None if cond is False else F.when(cond, text)


@dataclass
class Kind:
    """The kind of item and the place that an expression is for."""

    type: str
    authors: bool
    part: ET.Element
    html: bool
    suffixes: bool
    added: int = 0
    names_only: bool = False
    sort: bool = False
    gone: set[str] = field(default_factory=set)
    dated: bool = False
    delimiter: str = ""


class Style:
    """A compiled style: what items, clusters and bibliographies read like. See inspect() for what is refused."""

    def __init__(self, xml: str, locale: str | None = None, types: tuple = TYPES, costly: bool = False):
        """types: those that items have, others are written as if they were the first. costly: macros may expand to more than inspect() lets pass, as only what the items' variables reach is compiled."""
        self.types = types
        self._kept: dict = {}
        self._plain = ET.Element("name")
        facts = inspect(xml, costly)
        if facts["parent"]:
            raise StyleError(f"a dependent style: compile its parent, {facts['parent']}")
        self.label = facts["label"]
        self.root = ET.fromstring(xml)
        self.ns = self.root.tag.partition("}")[0] + "}" if self.root.tag.startswith("{") else ""
        self.macros = {m.get("name"): m for m in self.root.iter(f"{self.ns}macro")}
        self.citation, self.bibliography = self.root.find(f"{self.ns}citation"), self.root.find(f"{self.ns}bibliography")
        self.terms, self.dates, self.options = dict(TERMS), {}, {}
        for k, name in enumerate(MONTHS, 1):
            self.terms[f"month-{k:02d}", "long"] = (name, name)
            short = name if len(name) < 5 else f"{name[:3]}."
            self.terms[f"month-{k:02d}", "short"] = (short, short)
        lang = self.root.get("default-locale") or "en-US"
        own = [x for x in self.root.findall(f"{self.ns}locale")]
        at = "{http://www.w3.org/XML/1998/namespace}lang"
        fits = [[x for x in own if x.get(at) is None], [x for x in own if x.get(at) == lang[:2]], [x for x in own if x.get(at) == lang]]
        for x in ([ET.fromstring(locale)] if locale else []) + [x for group in fits for x in group]:
            self._localised(x)

    def for_types(self, types: list[str]) -> Style:
        """This style for items of these types only."""
        out = copy(self)
        out.types, out._kept = tuple(types) or TYPES[:1], {}
        return out

    def _localised(self, x: ET.Element) -> None:
        for e in x.iter():
            tag = self._tag(e)
            if tag == "term":
                one, more = next((c.text for c in e if self._tag(c) == "single"), e.text), next((c.text for c in e if self._tag(c) == "multiple"), None)
                self.terms[e.get("name"), e.get("form", "long")] = (one or "", more or one or "")
            elif tag == "date":
                self.dates[e.get("form")] = e
            elif tag == "style-options":
                self.options |= e.attrib

    def _tag(self, e: ET.Element) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def term(self, name: str, form: str = "long", plural: bool = False) -> str:
        for f in {"verb-short": ("verb-short", "verb", "long"), "symbol": ("symbol", "short", "long")}.get(form, (form, "long")):
            if (name, f) in self.terms:
                return self.terms[name, f][plural]
        return ""

    # ---- what is around a text ----

    def _dressed(self, e: ET.Element, out: Out, k: Kind) -> Out:
        if out.some is False:
            return out
        t = out.text
        if e.get("strip-periods") == "true":
            t = F.replace(t, F.lit("."), F.lit(""))
        if case := e.get("text-case"):
            t = cased(t, case)
        if e.get("quotes") == "true" and not k.sort:
            t = F.concat(F.lit(self.term("open-quote")), t, F.lit(self.term("close-quote")))
        if k.html and not k.sort:
            for attribute, tags in _HTML.items():
                if tag := tags.get(e.get(attribute, "")):
                    t = F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))
            if e.get("font-variant") == "small-caps":
                t = F.concat(F.lit('<span style="font-variant:small-caps">'), t, F.lit("</span>"))
        if e.get("prefix") or e.get("suffix"):
            t = F.concat(F.lit(self._markup(e.get("prefix", ""), k)), t, F.lit(self._markup(e.get("suffix", ""), k)))
        return Out(t, out.some, out.asks, out.filled)

    @staticmethod
    def _markup(s: str, k: Kind) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if k.html else s

    def _joined(self, outs: list[Out], delimiter: str, k: Kind, group: bool = False) -> Out:
        """Several texts as one. A group that calls variables writes only where one of them has a value."""
        outs = [o for o in outs if o.asks is not False or o.some is not False]
        asks, filled, some = any_of([o.asks for o in outs]), any_of([o.filled for o in outs]), any_of([o.some for o in outs])
        cond = some if not group or asks is False else filled if asks is True else any_of([filled, all_of([negated(asks), some])])
        written = [o.text for o in outs if o.some is not False]
        if cond is False or not written:
            return Out(F.lit(None).cast("string"), False, asks, filled)
        text = written[0] if len(written) == 1 else F.concat_ws(self._markup(delimiter, k), *written)
        return Out(text if cond is some and len(written) == 1 else _when(cond, text), cond, asks, filled)

    # ---- elements ----

    def _all(self, es, k: Kind) -> list[Out]:
        return [self._one(e, k) for e in es]

    def _one(self, e: ET.Element, k: Kind) -> Out:
        make: Callable = getattr(self, f"_{self._tag(e)}", None)
        return make(e, k) if make else Out(F.lit(None).cast("string"), False)

    def _value(self, name: str, k: Kind, short: bool = False) -> Column | None:
        if name in k.gone or name == "citation-number" and k.names_only:
            return None
        if name == "citation-number":
            return F.lpad(F.col("number").cast("string"), 9, "0") if k.sort else F.col("number").cast("string")
        if name == "year-suffix":
            k.dated = True
            return F.col("year_suffix") if k.suffixes else None
        if short and f"{name}-short" in ITEM:
            return F.coalesce(self._value(f"{name}-short", k), self._value(name, k))
        if name == "title-short":
            return self._value("title", k)
        if name not in ITEM:
            return None
        if (name, k.html) not in self._kept:
            c = F.nullif(F.col(ITEM[name]), F.lit(""))
            if k.html:
                for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                    c = F.replace(c, F.lit(plain), F.lit(code))
            self._kept[name, k.html] = page_range(c, self.root.get("page-range-format"), self.term("page-range-delimiter") or "–") if name == "page" else c
        return self._kept[name, k.html]

    def _has(self, name: str, k: Kind) -> Truth:
        if name == "author":
            return k.authors and "author" not in k.gone
        if name == "issued":
            return F.size("date_parts") > 0
        if name in ("citation-number",):
            return not k.names_only
        if name == "year-suffix":
            return F.col("year_suffix").isNotNull() if k.suffixes else False
        if name.endswith("-short") and name not in ITEM:
            return self._has(name[:-6], k)
        if name in k.gone or name not in ITEM:
            return False
        if name not in self._kept:
            self._kept[name] = F.coalesce(F.col(ITEM[name]) != "", F.lit(False))
        return self._kept[name]

    def _variable(self, e: ET.Element, k: Kind, c: Column | None, has: Truth) -> Out:
        if c is None or has is False:
            return Out(F.lit(None).cast("string"), False, True, False)
        return self._dressed(e, Out(c, has, True, has), k)

    def _text(self, e: ET.Element, k: Kind) -> Out:
        if name := e.get("macro"):
            return self._dressed(e, self._joined(self._inside(self.macros[name], k), "", k), k)
        if name := e.get("term"):
            t = self.term(name, e.get("form", "long"), e.get("plural") == "true")
            return self._dressed(e, Out(F.lit(self._markup(t, k)), bool(t)), k) if t else Out(F.lit(None).cast("string"), False)
        if (v := e.get("value")) is not None:
            return self._dressed(e, Out(F.lit(self._markup(v, k)), bool(v)), k)
        name = e.get("variable", "")
        short = e.get("form") == "short"
        has = any_of([self._has(f"{name}-short", k), self._has(name, k)]) if short and f"{name}-short" in ITEM else self._has(name, k)
        return self._variable(e, k, self._value(name, k, short), has)

    def _number(self, e: ET.Element, k: Kind) -> Out:
        name = e.get("variable", "")
        c = self._value(name, k)
        if c is not None and e.get("form") == "ordinal":
            n = c.try_cast("int")
            end = F.when(F.floor(n / 10) % 10 == 1, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
            c = F.when(n.isNotNull(), F.concat(n.cast("string"), end)).otherwise(c)
        return self._variable(e, k, c, self._has(name, k))

    def _label(self, e: ET.Element, k: Kind) -> Out:
        name = e.get("variable", "")
        has, form = self._has(name, k), e.get("form", "long")
        one, more = (self.term(name, form, p) for p in (False, True))
        if has is False or not one:
            return Out(F.lit(None).cast("string"), False)
        several = F.regexp_like(F.col(ITEM[name]), F.lit(r"\d\s*[-–—,&;]\s*\S")) if name in ITEM else F.lit(False)
        plural = {"always": F.lit(more), "never": F.lit(one)}.get(e.get("plural", ""), F.when(several, more).otherwise(one))
        return self._dressed(e, Out(_when(has, plural), has), k)

    def _date(self, e: ET.Element, k: Kind) -> Out:
        if e.get("variable") != "issued" or "issued" in k.gone or k.names_only:
            return Out(F.lit(None).cast("string"), False, True, False)
        parts = {p.get("name"): p for p in e if self._tag(p) == "date-part"}
        order, delimiter = list(parts), e.get("delimiter", "")
        if form := e.get("form"):
            local = self.dates.get(form)
            given = [p for p in local if self._tag(p) == "date-part"] if local is not None else [ET.Element("date-part", {"name": n, "form": f} | ({"suffix": s} if s else {})) for n, f, s in (("month", "long", " "), ("day", "numeric", ", "), ("year", "long", ""))]
            shown = {"year": ("year",), "year-month": ("year", "month")}.get(e.get("date-parts", ""), ("year", "month", "day"))
            own = parts
            parts = {p.get("name"): ET.Element("date-part", p.attrib | own.get(p.get("name"), ET.Element("x")).attrib) for p in given if p.get("name") in shown}
            order, delimiter = list(parts), (local.get("delimiter", "") if local is not None else "")
        at = lambda i: F.get("date_parts", F.lit(i))
        if k.sort:
            t = F.concat(*[F.lpad(F.coalesce(at(i), F.lit(0)).cast("string"), w, "0") for i, w in ((0, 6), (1, 2), (2, 2))])
            return Out(t, self._has("issued", k), True, self._has("issued", k))
        outs = []
        for name in order:
            p, i = parts[name], ("year", "month", "day").index(name)
            has: Truth = F.size("date_parts") > i
            c = at(i).cast("string")
            if name == "month":
                names = [self.term(f"month-{m:02d}", "short" if p.get("form") == "short" else "long") for m in range(1, 13)]
                c = F.lpad(c, 2, "0") if p.get("form") == "numeric-leading-zeros" else c if p.get("form") == "numeric" else F.element_at(F.array(*map(F.lit, names)), F.greatest(F.lit(1), F.least(F.lit(12), at(i))))
            elif name == "day" and p.get("form") == "numeric-leading-zeros":
                c = F.lpad(c, 2, "0")
            elif name == "year":
                if k.suffixes and not k.dated and not any(t.get("variable") == "year-suffix" for t in self.root.iter(f"{self.ns}text")):
                    c = F.concat(c, F.coalesce(F.col("year_suffix"), F.lit("")))
                    k.dated = True
            outs.append(self._dressed(p, Out(_when(has, c), has), k))
        has = self._has("issued", k)
        joined = self._joined(outs, delimiter, k)
        return self._dressed(e, Out(joined.text, joined.some, True, has), k)

    def _group(self, e: ET.Element, k: Kind) -> Out:
        return self._dressed(e, self._joined(self._inside(e, k, e.get("delimiter", "")), e.get("delimiter", ""), k, True), k)

    def _inside(self, es, k: Kind, delimiter: str = "") -> list[Out]:
        """What stands in a group or macro; choices are seen through, so its delimiter parts what they hold too."""
        outer, k.delimiter = k.delimiter, delimiter
        out = self._all(es, k)
        k.delimiter = outer
        return out

    def _choose(self, e: ET.Element, k: Kind) -> Out:
        cases, left = [], True
        for branch in e:
            cond = True if self._tag(branch) == "else" else self._condition(branch, k)
            if cond is False:
                continue
            cases.append((cond, self._joined(self._all(branch, k), k.delimiter, k)))
            if cond is True:
                left = False
                break
        if not cases:
            return Out(F.lit(None).cast("string"), False)
        if cases[0][0] is True:
            return cases[0][1]

        def pick(get, last):
            out = last
            for cond, o in reversed(cases):
                v = get(o)
                v = F.lit(v) if isinstance(v, bool) else v
                out = v if cond is True else F.when(cond, v) if out is None else F.when(cond, v).otherwise(out)
            return out

        no = F.lit(False)
        every = [o.asks for _, o in cases]
        asks: Truth = every[0] if not left and all(x is every[0] for x in every) and isinstance(every[0], bool) else pick(lambda o: o.asks, no) if any(x is not False for x in every) else False
        if all(o.some is False for _, o in cases):
            some: Truth = False
        else:
            some = pick(lambda o: o.some, no)
        filled = pick(lambda o: o.filled, no) if any(o.filled is not False for _, o in cases) else False
        return Out(pick(lambda o: o.text if o.some is not False else F.lit(None).cast("string"), None if left else None), some, asks, filled)

    def _condition(self, e: ET.Element, k: Kind) -> Truth:
        tests: list[Truth] = []
        for name in e.get("type", "").split():
            tests.append(name == k.type)
        for name in e.get("variable", "").split():
            tests.append(self._has(name, k))
        for name in e.get("is-numeric", "").split():
            has = self._has(name, k)
            tests.append(False if has is False or name not in ITEM else all_of([has, F.regexp_like(F.col(ITEM[name]), F.lit(r"^\s*[A-Za-z]?\d+[A-Za-z]?(\s*[-–,&]\s*[A-Za-z]?\d+[A-Za-z]?)*\s*$"))]))
        for name in ("locator", "position", "disambiguate", "is-uncertain-date"):
            tests += [False] * len(e.get(name, "").split())
        match = e.get("match", "all")
        return negated(any_of(tests)) if match == "none" else any_of(tests) if match == "any" else all_of(tests)

    def _names(self, e: ET.Element, k: Kind) -> Out:
        if "author" in e.get("variable", "").split() and k.authors and "author" not in k.gone:
            name = next((c for c in e if self._tag(c) == "name"), self._plain)
            et_al = next((c for c in e if self._tag(c) == "et-al"), None)
            o = {a: v for a in _NAME for x in (self.root, k.part, name) if (v := x.get(a)) is not None}
            o["form"] = name.get("form") or k.part.get("name-form") or self.root.get("name-form") or "long"
            o["delimiter"] = name.get("delimiter") or k.part.get("name-delimiter") or self.root.get("name-delimiter") or ", "
            parts = {p.get("name"): p for p in name if self._tag(p) == "name-part"}
            at = (id(name), id(k.part), k.html, k.added, k.sort)
            if at not in self._kept:
                self._kept[at] = self._people(o, parts, et_al, k)
            inner = self._dressed(name, Out(self._kept[at], True), k)
            return self._dressed(e, Out(inner.text, True, True, True), k)
        for sub in e:
            if self._tag(sub) == "substitute":
                for c in sub:
                    before = set(k.gone)
                    if self._tag(c) == "names" and not len(c):  # as the names that it stands for are written
                        c = ET.Element(c.tag, c.attrib)
                        c.extend(x for x in e if self._tag(x) in ("name", "et-al"))
                    out = self._one(c, k)
                    if out.some is not False:
                        k.gone = before | self._called(c)
                        return Out(self._dressed(e, out, k).text, out.some, True, out.filled)
        return Out(F.lit(None).cast("string"), False, True, False)

    def _called(self, e: ET.Element) -> set[str]:
        out: set[str] = set()
        for x in e.iter():
            out |= set(x.get("variable", "").split()) if self._tag(x) in ("text", "number", "names") else set()
            if self._tag(x) == "text" and x.get("macro"):
                out |= self._called(self.macros[x.get("macro")])
        return out

    def _people(self, o: dict, parts: dict, et_al: ET.Element | None, k: Kind) -> Column:
        sep, inverted = o.get("sort-separator", ", "), "all" if k.sort else o.get("name-as-sort-order", "")
        start = None if k.sort or o.get("initialize") == "false" else o.get("initialize-with")

        def dress(part: str, c: Column) -> Column:
            return self._dressed(parts[part], Out(c, True), k).text if part in parts else c

        def one(a: Column, i: Column) -> Column:
            esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) if k.html else c
            family, given, literal = (F.nullif(a[x], F.lit("")) for x in ("family", "given", "literal"))
            if o["form"] == "short" and not k.sort:
                return dress("family", esc(F.coalesce(family, literal, given)))
            if start is not None:
                given = initials(given, start, o.get("initialize-with-hyphen") != "false")
            shown, last = dress("given", esc(given)), dress("family", esc(family))
            plain, turned = F.concat_ws(" ", shown, last), F.concat_ws(sep, last, shown)
            named = turned if inverted == "all" else F.when(i == 0, turned).otherwise(plain) if inverted == "first" else plain
            return F.when(literal.isNotNull(), dress("family", esc(literal))).otherwise(named)

        n = F.size("author")
        people = F.transform("author", one)
        delimiter = self._markup(o["delimiter"], k)
        word = {"text": self.term("and"), "symbol": "&amp;" if k.html else "&"}.get(o.get("and", ""))
        precedes = o.get("delimiter-precedes-last", "contextual")
        before = F.lit({"always": delimiter, "never": " "}.get(precedes, " " if inverted != "first" or precedes == "contextual" else delimiter))
        if precedes == "contextual":
            before = F.when(n > 2, delimiter).otherwise(" ")
        elif precedes == "after-inverted-name":
            before = F.when((n == 2) & F.lit(inverted in ("first", "all")), delimiter).otherwise(" ")
        every = F.array_join(people, delimiter) if not word else F.when(n == 1, F.get(people, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(people, 1, n - 1), delimiter), before, F.lit(f"{word} "), F.element_at(people, -1)))
        least, first = int(o.get("et-al-min", 0)), int(o.get("et-al-use-first", 1)) + k.added
        if not least or first < 1:
            return every
        others = self.term(et_al.get("term", "et-al") if et_al is not None else "et-al")
        rest = self._dressed(et_al, Out(F.lit(others), True), k).text if et_al is not None else F.lit(others)
        head = F.array_join(F.slice(people, 1, first), delimiter)
        if o.get("et-al-use-last") == "true":
            short = F.when(n > first + 1, F.concat(head, F.lit(delimiter), F.lit("… "), F.element_at(people, -1))).otherwise(every)
        else:
            rule = o.get("delimiter-precedes-et-al", "contextual")
            between = delimiter if rule == "always" or rule == "contextual" and first > 1 or rule == "after-inverted-name" and inverted in ("first", "all") else " "
            short = F.concat(head, F.lit(between), rest)
        return F.when((n >= least) & (n > first), short).otherwise(every)

    # ---- layouts ----

    def _each_kind(self, make: Callable[[str, bool], Column]) -> Column:
        """make for each type and for items with and without authors."""
        kind = F.when(F.col("type").isin(*self.types), F.col("type")).otherwise(F.lit(self.types[0]))
        out = None
        for authors in (True, False):
            by_type = None
            for t in self.types:
                c = make(t, authors)
                by_type = F.when(kind == t, c) if by_type is None else by_type.when(kind == t, c)
            out = F.when(F.size("author") > 0, by_type) if authors else out.otherwise(by_type)
        return out

    def written(self, part: str, html: bool = False, suffixes: bool = True, added: int = 0, names_only: bool = False) -> Column:
        """What an item reads like in a citation or in the bibliography (part), without the layout's own affixes in a citation. Null if it writes nothing."""
        e = self.citation if part == "citation" else self.bibliography
        layout = e.find(f"{self.ns}layout")

        def make(t: str, authors: bool) -> Column:
            k = Kind(t, authors, e, html, suffixes, added, names_only)
            outs = self._all(layout, k)
            if part == "bibliography" and e.get("second-field-align"):  # a first field with a column of its own is parted from the rest by a blank
                outs = [outs[0], Out(F.lit(" "), True), *outs[1:]]
            out = self._joined(outs, "", k)
            out = self._dressed(layout, out, k) if part == "bibliography" else out
            return out.text if out.some is not False else F.lit(None).cast("string")

        return tidy(self._each_kind(make), self.options.get("punctuation-in-quote") == "true" or (self.root.get("default-locale") or "en-US") == "en-US")

    def sort_keys(self, part: str) -> list[tuple[Column, bool]] | None:
        """(key, descending) of the part's sort, None if it has none."""
        e = self.citation if part == "citation" else self.bibliography
        sort = e.find(f"{self.ns}sort") if e is not None else None
        if sort is None:
            return None
        keys = []
        for key in sort:
            x = ET.Element("text", {"macro": key.get("macro")}) if key.get("macro") else ET.Element("date", {"variable": "issued"}) if key.get("variable") == "issued" else ET.Element("names", {"variable": "author"}) if key.get("variable") == "author" else ET.Element("text", {"variable": key.get("variable", "")})

            def make(t: str, authors: bool, x=x) -> Column:
                out = self._one(x, Kind(t, authors, e, False, False, sort=True))
                return F.lower(out.text) if out.some is not False else F.lit(None).cast("string")

            keys.append((self._each_kind(make), key.get("sort") == "descending"))
        return keys

    @property
    def by_number(self) -> bool:
        called = set()
        for x in self.citation.find(f"{self.ns}layout").iter():
            called |= {x.get("variable")} | (self._called(self.macros[x.get("macro")]) if x.get("macro") else set())
        return "citation-number" in called

    @property
    def superscript(self) -> bool:
        return self.citation.find(f"{self.ns}layout").get("vertical-align") == "sup"


def cased(t: Column, case: str) -> Column:
    first = F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, F.lit(2), F.length(t)))
    sentence = F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, F.lit(2), F.length(t))))
    if case == "capitalize-all":
        return F.array_join(F.transform(F.split(t, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")
    if case == "title":
        small = "a an and as at but by down for from in into nor of on onto or over so the till to up via with yet".split()
        words = F.split(t, " ")
        up = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
        return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & (i < F.size(words) - 1) & w.isin(*small), w).when(w == F.lower(w), up(w)).otherwise(w)), " ")
    return {"lowercase": F.lower(t), "uppercase": F.upper(t), "capitalize-first": first, "sentence": F.when(t == F.upper(t), sentence).otherwise(first)}.get(case, t)


def initials(given: Column, start: str, hyphens: bool = True) -> Column:
    """First letters of given names, each with start; parts joined by hyphens stay joined, with the hyphen if the style keeps it."""
    core = start.rstrip(" ")
    words = F.filter(F.split(given, r"[\s.]+"), lambda w: w != "")
    letters = F.transform(words, lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda x: x != ""), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lit(core))), "-" if hyphens else ""))
    return F.array_join(letters, start[len(core) :])


def page_range(pages: Column, form: str | None, dash: str) -> Column:
    """Ranges with an en dash, their second number written out or shortened as the style wants."""
    pages = F.regexp_replace(pages, r"(\d)\s*[-–—]+\s*(?=[A-Za-z]*\d)", f"$1{dash}")
    if form not in ("minimal", "minimal-two", "expanded"):
        return pages
    one = rf"^(\d+){dash}(\d+)$"
    a, b = F.regexp_extract(pages, one, 1), F.regexp_extract(pages, one, 2)
    full = F.when(F.length(b) < F.length(a), F.concat(F.left(a, F.length(a) - F.length(b)), b)).otherwise(b)
    if form != "expanded":
        keep = 1 if form == "minimal" else 2
        same = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(full, i, F.lit(1))), i).otherwise(n))
        full = F.when(F.length(full) == F.length(a), F.substring(full, F.least(same, F.length(a) - keep) + 1, F.length(full))).otherwise(full)
    return F.when(a != "", F.concat(a, F.lit(dash), full)).otherwise(pages)


def tidy(t: Column, into_quotes: bool) -> Column:
    """Punctuation that meets at the seams of parts, made single."""
    tags = r"((?:</?[a-z][^>]*>)*)"
    if into_quotes:
        t = F.regexp_replace(t, rf"([”’]{tags})([.,])", "$3$1")
    t = F.regexp_replace(t, rf"(?<!\.)([.,]){tags}\1(?!\.)", "$1$2")
    t = F.regexp_replace(t, rf"([?!]){tags}\.", "$1$2")
    t = F.regexp_replace(t, rf"[,;:] ?{tags}([.])", "$1$2")
    t = F.regexp_replace(t, r" +([,;:.)\]])", "$1")
    return F.btrim(F.regexp_replace(t, " {2,}", " "))
