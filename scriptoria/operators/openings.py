"""Opening pages of papers: which template a page follows, the parts it falls into, and its paragraphs part by part.

What runs and papers show by themselves are columns; then a page's runs are gathered into one row, on the one shuffle that runs come by. There its evidence (its headings, the type and the width of its runs) is looked at, which goes
by the order of runs, every run gets the part it stands in, or none, and each part is laid out for itself. A page that shows too little is laid out whole.

Templates, tried in this order:
wide: on the first two pages, an abstract with a heading at the left over the full width, above the introduction in columns. What is above, the abstract, and the rest are parts.
set off: on the first page of one publisher, an abstract without a heading in a heavy sans serif above the introduction. It is plain text; what is above and beside it goes.
split: on the first page, an abstract that begins in the left column and goes on at the top of the right one, above the introduction; notes in smaller type below it come last. What is above goes.
inset: on the first page of one family, an abstract without a heading in larger prose at the right, above the text in smaller prose. Other type goes, unless it stands in a line of prose.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from itertools import groupby
from math import nan

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout
from .furniture import families
from .reading import canonical_section
from .sections import profile

KEY = ["pdf_id", "page"]
#: Faces of publishers. Abstracts set off; prose of one family, in its older files too; bold faces whose names don't say so.
SET_OFF_FACES = ("myriadpro-semibold", "myriadpro-bold")
PROSE_FACE, OLDER_PROSE_FACE = "hardingtext", "advotdd63dae3"
BOLD_FACES = (("cell", ("advpshn-hi", "advpshn-h")), ("communications", ("advot70e1938e",)))
#: How notes below an abstract begin.
NOTE_STARTS = ("equal contribution", "co-corresponding authors", "corresponding author")
#: Characters of lines that count as evidence, for each template.
WIDE, SET_OFF, SPLIT, INSET = 50, 30, 35, 30


@dataclass(frozen=True)
class Part:
    """Whether a part of a page is one column, the section that it begins without a heading, whether it may go on with the sentence of the part before, and whether all its type is plain."""

    one_column: bool = False
    opens: str = ""
    goes_on: bool = False
    plain: bool = False


#: A page without a template.
WHOLE = (Part(),)


@dataclass(slots=True)
class Shown:
    """A page as templates look at it: its number, width, paper and runs, the lists' values in order of seq. Unknown places and sizes are NaN, which no comparison holds for."""

    page: int
    width: float
    nature: bool
    families: list[str]
    x: list[float]
    y: list[float]
    w: list[float]
    size: list[float]
    text: list[str]
    chars: list[int]
    font: list[str]
    face: list[str]
    section: list[str | None]

    def first(self, section: str, fits: Callable[[int], bool] = lambda i: True) -> int | None:
        """The first run that names a section."""
        return next((i for i, s in enumerate(self.section) if s == section and fits(i)), None) if section in self.section else None


@lru_cache(4096)
def _low(face: str) -> tuple[str, frozenset[str]]:
    """A font in lower case, and the names in it, of which one may be the sign of a subset."""
    low = face.lower()
    return low, frozenset(re.split(r"[+\s]", low, flags=re.ASCII))


@lru_cache(4096)
def _is_bold(face: str) -> bool:
    return layout.bold_name(face)


def _wide(p: Shown) -> list[int] | None:
    """Each run's part, -1 for one that goes, if the page follows the template; None if not."""
    if p.page > 2 or (a := p.first("Abstract")) is None or (i := p.first("Introduction")) is None:
        return None
    top, bottom = p.y[a] + p.size[a], p.y[i] + p.size[i] * 0.8
    if not (p.y[a] > p.y[i] and p.x[a] < p.width * 0.2):
        return None
    if sum([bottom < y <= top and w > p.width * 0.6 and n > WIDE for y, w, n in zip(p.y, p.w, p.chars, strict=True)]) < 3:
        return None
    return [0 if y > top else 1 if bottom < y <= top else 2 if y <= bottom else -1 for y in p.y]


def _set_off(p: Shown) -> list[int] | None:
    if p.page != 1 or "advances" not in p.families or (i := p.first("Introduction")) is None:
        return None
    low = p.y[i] + p.size[i]
    heavy = [k for k, (x, y, s, n) in enumerate(zip(p.x, p.y, p.size, p.chars, strict=True)) if y > low and x < p.width * 0.8 and 8 <= s <= 11 and n > SET_OFF and any(f in _low(p.face[k])[0] for f in SET_OFF_FACES)]
    lines: dict[str, set] = {}
    chars: dict[str, int] = {}
    for k in heavy:
        lines.setdefault(p.font[k], set()).add(Decimal(repr(p.y[k])).to_integral_value(ROUND_HALF_UP))
        chars[p.font[k]] = chars.get(p.font[k], 0) + p.chars[k]
    font = next((f for f in (p.font[k] for k in heavy) if len(lines[f]) >= 4 and chars[f] > 350), None)
    own = [k for k in heavy if p.font[k] == font]
    if not own:
        return None
    bottom, high = min([p.y[k] for k in own]) - p.size[own[0]] * 0.7, max([p.y[k] + p.size[k] for k in own]) + 1
    if not any(y < bottom and n > 0 for y, n in zip(p.y, p.chars, strict=True)):
        return None
    return [0 if bottom <= y <= high and x < p.width * 0.81 else 1 if y < bottom else -1 for x, y in zip(p.x, p.y, strict=True)]


def _split(p: Shown) -> list[int] | None:
    middle = p.width / 2
    if p.page != 1 or p.nature or (a := p.first("Abstract", lambda k: p.x[k] < middle)) is None or (i := p.first("Introduction", lambda k: p.x[k] >= middle)) is None:
        return None
    if not p.y[i] < p.y[a]:
        return None
    runs = range(len(p.x))
    left, right, top = [x < middle for x in p.x], [x >= middle for x in p.x], p.y[a] + 1
    prose = next((p.size[k] for k in runs if left[k] and p.y[k] < top and p.chars[k] > SPLIT), 0.0)
    small = [left[k] and p.size[k] < prose * 0.95 for k in runs]
    note = next((k for k in runs if small[k] and p.y[k] < top and p.text[k].strip(" ").lower().startswith(NOTE_STARTS)), None)
    noted = [note is not None and small[k] and p.y[k] <= p.y[note] + p.size[note] * 0.7 for k in runs]
    begins = [left[k] and p.y[k] <= top and not noted[k] for k in runs]
    end = p.y[i] + p.size[i] * 0.5
    ends = [right[k] and end < p.y[k] <= top for k in runs]
    if sum(begins) <= 3 or not any(ends) or any(ends[k] and p.chars[k] > 0 and p.size[k] > prose * 1.15 for k in runs):
        return None
    return [0 if begins[k] else 1 if ends[k] else 2 if p.y[k] <= top and not noted[k] else 3 if noted[k] else -1 for k in runs]


def _inset(p: Shown) -> list[int] | None:
    if p.page != 1 or not p.nature:
        return None
    older, runs = "communications" in p.families, range(len(p.x))
    prose = [PROSE_FACE in low or older and OLDER_PROSE_FACE in names for low, names in map(_low, p.face)]
    line = [prose[k] and p.chars[k] > INSET for k in runs]
    small = min([p.size[k] for k in runs if line[k] and p.size[k] > 0], default=nan)
    large = [prose[k] and p.size[k] > small * 1.05 and p.x[k] > p.width * 0.3 for k in runs]
    chief = [k for k in runs if large[k] and line[k]]
    if sum([len(p.text[k]) for k in runs if line[k]]) < 500 or len(chief) < 3:
        return None
    known = lambda values: [v for v in values if v == v]
    low = min(known([p.y[k] for k in runs if large[k]]), default=nan) - small * 0.7
    high, edge = max(known([p.y[k] + p.size[k] for k in chief]), default=nan) + 2, min([p.x[k] for k in chief]) - 3
    body = [(p.x[k], p.y[k], p.w[k], p.size[k]) for k in runs if line[k] and p.y[k] < low]

    def beside(x: float, y: float) -> bool:
        return any(abs(by - y) < size * 0.65 and bx - 2 <= x <= bx + w + size for bx, by, w, size in body)

    under = [p.y[k] < low and (prose[k] or beside(p.x[k], p.y[k])) for k in runs]
    if not any(under[k] and p.chars[k] > 0 for k in runs):
        return None
    return [0 if low <= p.y[k] <= high and p.x[k] >= edge else 1 if under[k] else -1 for k in runs]


TEMPLATES: dict[str, tuple[Callable[[Shown], list[int] | None], tuple[Part, ...]]] = {
    "wide": (_wide, (Part(), Part(one_column=True), Part())),
    "set off": (_set_off, (Part(one_column=True, opens="Abstract", plain=True), Part())),
    "split": (_split, (Part(one_column=True), Part(one_column=True, goes_on=True), Part(), Part(one_column=True))),
    "inset": (_inset, (Part(one_column=True, opens="Abstract"), Part(opens="Introduction"))),
}


def _placed(p: Shown) -> tuple[str | None, list[int], tuple[Part, ...]]:
    """The template of a page, each run's part (-1 for a run that goes), and what the parts are."""
    for name, (template, told) in TEMPLATES.items():
        if (places := template(p)) is not None:
            return name, places, told
    return None, [0] * len(p.x), WHOLE


def _gathered(items: DataFrame, pages: DataFrame, papers: DataFrame, fonts: DataFrame | None, *more: str) -> DataFrame:
    """A row for each page: pdf_id, page, page_width, splits, nature, families and runs, in order of seq, with more of their columns."""
    rows = items.withColumns({"_text": F.coalesce("str", F.lit("")), "_font": F.coalesce("fontName", F.lit(""))})
    if fonts is None:
        rows = rows.withColumns({"_full": F.lit(""), "_known": F.lit(False)})
    else:
        named = fonts.select("pdf_id", "fontName", F.concat_ws(" ", "postscriptName", "fontFamily").alias("_full"), F.coalesce("bold", F.lit(False)).alias("_known"))
        rows = rows.join(named, ["pdf_id", "fontName"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    if "splits" not in pages.columns:
        pages = pages.withColumn("splits", F.lit(None).cast("array<double>"))
    # what the templates look at is only asked of opening pages
    section = F.when((F.col("page") <= 2) & (F.length(F.trim("_text")) < 60), canonical_section("_text"))
    number = lambda c, k=None: (F.col(c) if k is None else F.col(c)[k]).cast("double")
    run = F.struct(
        "seq", number("transform", 4).alias("x"), number("transform", 5).alias("y"), number("width").alias("w"), number("height").alias("size"), F.col("_text").alias("text"),
        F.col("_font").alias("font"), F.concat_ws(" ", "_font", "_full").alias("face"), F.col("_known").alias("known"), section.alias("section"), *more,
    )
    whole = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    known = papers.select("pdf_id", families(F.col("journal"), F.col("doi")).alias("families"), (profile("journal", "doi") == "nature").alias("nature"))
    about = pages.select(*KEY, "page_width", "splits").join(known, "pdf_id", "left")
    about = about.withColumns({"families": F.coalesce("families", F.array(F.lit("any"))), "nature": F.coalesce("nature", F.lit(False))})
    return whole.join(about, KEY)


def _read(b: pa.RecordBatch) -> Iterator[tuple[Shown, list[bool], list[float] | None]]:
    """The pages of a batch of _gathered, with which of their runs are bold, and their splits."""
    runs = b.column("runs")
    bounds = runs.offsets.to_pylist()
    every = runs.values.slice(bounds[0], bounds[-1] - bounds[0]) if bounds else runs.values
    fields = {every.type.field(k).name: every.field(k) for k in range(every.type.num_fields)}
    # by way of numpy, which makes lists of values some times faster; unknown numbers are NaN
    values = lambda c: fields[c].to_numpy(zero_copy_only=False).tolist()
    x, y, w, size, text, font, face, section, known = map(values, ("x", "y", "w", "size", "text", "font", "face", "section", "known"))
    chars = [len(t.strip(" ")) for t in text]
    dark = [own or _is_bold(f) for own, f in zip(known, face, strict=True)]
    about = [b.column(c).to_pylist() for c in ("page", "page_width", "nature", "families", "splits")]
    for k, (page, width, nature, kinds, splits) in enumerate(zip(*about, strict=True)):
        part = slice(bounds[k] - bounds[0], bounds[k + 1] - bounds[0])
        p = Shown(page, nan if width is None else float(width), nature, kinds, x[part], y[part], w[part], size[part], text[part], chars[part], font[part], face[part], section[part])
        bold = dark[part]
        for family, faces in BOLD_FACES:
            if family in kinds:
                bold = [own or not _low(f)[1].isdisjoint(faces) for own, f in zip(bold, p.face, strict=True)]
        yield p, bold, splits


def parts(items: DataFrame, pages: DataFrame, papers: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """items with template (null for a page without one), part (from 0; null for a run that goes), bold, and the part's one_column, opens, goes_on.

    items: pdf_id, page, seq, str, transform, width, height, fontName. pages: pdf_id, page, page_width and, where known, splits. papers: pdf_id, journal, doi; without a row or a value, a paper has no known journal.
    fonts: pdf_id, fontName, postscriptName, fontFamily, bold. Null texts are empty.
    """
    own = F.struct(*[F.coalesce("str", F.lit("")).alias("str") if c == "str" else F.col(c) for c in items.columns]).alias("item")
    whole = _gathered(items.withColumn("item", own), pages, papers, fonts, "item")
    place = pa.struct([("bold", pa.bool_()), ("template", pa.string()), ("part", pa.int32()), ("one_column", pa.bool_()), ("opens", pa.string()), ("goes_on", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, bold, _ in _read(b):
                template, places, told = _placed(p)
                of = lambda k: told[k] if k >= 0 else Part()  # noqa: B023, E731
                out.append([{"bold": dark and not of(k).plain, "template": template, "part": k if k >= 0 else None, "one_column": of(k).one_column, "opens": of(k).opens, "goes_on": of(k).goes_on} for k, dark in zip(places, bold, strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(place))], [*b.schema.names, "places"])

    placed = whole.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.schema) + ", places array<struct<bold: boolean, template: string, part: int, one_column: boolean, opens: string, goes_on: boolean>>")
    rows = placed.select("page_width", "splits", "nature", F.inline(F.arrays_zip(F.col("runs.item").alias("item"), "places")))
    return rows.select("item.*", "page_width", "splits", "nature", "places.*")


def _laid_out(p: Shown, bold: list[bool], known: list[float] | None) -> tuple[str | None, list[tuple[str, int | None, bool]]]:
    """A page's template, and its paragraphs: text, level, synthetic."""
    template, places, told = _placed(p)
    out: list[tuple[str, int | None, bool]] = []
    for part, own in groupby(sorted([k for k in range(len(places)) if places[k] >= 0], key=places.__getitem__), key=places.__getitem__):
        head = told[part]
        glyphs = [layout.Run(p.text[k], p.x[k], p.y[k], p.w[k], p.size[k], bold[k] and not head.plain) for k in own]
        splits = [] if head.one_column else known if known is not None else layout.column_splits([r for r in glyphs if r.text.strip()], p.width, 2) if p.nature else None
        texts, heads = layout.page_text(glyphs, p.width, splits)
        level = {at: n for at, _, n in heads}
        if texts and head.opens:
            out.append((head.opens, 1, True))
        for i, t in enumerate(texts):
            if i == 0 and head.goes_on and len(out) > 1 and re.match("[a-z]", t) and not re.search("[.!?:]$", out[-1][0]):
                out[-1] = (f"{out[-1][0]} {t}", *out[-1][1:])
            else:
                out.append((t, level.get(i), False))
    return template, out


def paragraphs(items: DataFrame, pages: DataFrame, papers: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """pdf_id, page, paragraph, text, level, synthetic and template: as layout.paragraphs gives them, with opening pages laid out part by part. A synthetic row is a heading that the page does not have."""
    kind = items.schema["pdf_id"].dataType.simpleString()
    whole = _gathered(items, pages, papers, fonts)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
        for b in batches:
            at, out = [], []
            for k, page in enumerate(_read(b)):
                template, texts = _laid_out(*page)
                at += [k] * len(texts)
                out += [(i, *row, template) for i, row in enumerate(texts)]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            made = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            of = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("pdf_id").take(of), b.column("page").take(of).cast(pa.int32()), *made], ["pdf_id", "page", "paragraph", "text", "level", "synthetic", "template"])

    return whole.mapInArrow(lay, f"pdf_id {kind}, page int, paragraph int, text string, level int, synthetic boolean, template string")
