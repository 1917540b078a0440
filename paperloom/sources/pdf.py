"""PDF files: a parser behind an interface, and what is worked out from the parts that it finds.

No parser is in the box but ``SimplePdf``, a stand-in for files whose text is plain in their content streams; a real one has the
same two methods. A page with too little text goes to an image reader, if there is one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SETTINGS
from ..functions.text import extension, strip


@dataclass
class Page:
    """A page's text, its tables as rows of cells, and its line segments as differences of their ends."""

    text: str = ""
    tables: list[list[list[str | None]]] = field(default_factory=list)
    segments: list[tuple[float, float]] = field(default_factory=list)


@dataclass
class Pdf:
    """A file's pages, and its form's fields: name, type code, flags, value."""

    pages: list[Page]
    fields: list[tuple[str, str | None, int | None, str | None]] = field(default_factory=list)


class PdfReader(Protocol):
    name: str

    def read(self, content: bytes) -> Pdf: ...


class ImageReader(Protocol):
    """Reads the text of a page's image, given the whole file and the page from 1."""

    def page_text(self, content: bytes, page: int) -> str: ...


@dataclass(frozen=True)
class SimplePdf:
    """Stand-in: text shown by Tj and TJ in plain or deflated streams, lines drawn by m and l, and form fields. It knows no fonts."""

    name: str = "simple"

    def read(self, content: bytes) -> Pdf:
        if not content.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content)}
        pages = [self._page(objects[k], objects) for k in self._order(objects)]
        if not pages:
            # Objects may be packed in streams (PDF 1.5), which the stand-in doesn't read.
            raise ValueError("no page could be read")
        fields = []
        for _, body in sorted(objects.items()):
            if kind := re.search(rb"/FT\s*/(\w+)", body):
                flags, value = re.search(rb"/Ff\s+(\d+)", body), re.search(rb"/V\s*(?:\(((?:\\.|[^()\\])*)\)|/(\w+))", body)
                shown = None if value is None else self._string(value[1]) if value[1] is not None else value[2].decode()
                name = re.search(rb"/T\s*\(((?:\\.|[^()\\])*)\)", body)
                fields.append((self._string(name[1]) if name else "", kind[1].decode(), int(flags[1]) if flags else None, shown))
        return Pdf(pages, fields)

    @staticmethod
    def _order(objects: dict[int, bytes]) -> list[int]:
        """The pages' objects as the page tree has them, from its root on; by number where there is no tree."""
        is_page = lambda k: k in objects and re.search(rb"/Type\s*/Page\b", objects[k])
        roots = [int(m[1]) for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body))]
        nodes = [k for k, body in sorted(objects.items()) if re.search(rb"/Type\s*/Pages\b", body)]
        roots = roots[-1:] or [k for k in nodes if not re.search(rb"/Parent\b", objects[k])][:1]
        out, seen, open_ = [], set(), roots[::-1]
        while open_:
            if (k := open_.pop()) in seen or k not in objects:
                continue
            seen.add(k)
            if is_page(k):
                out.append(k)
            elif kids := re.search(rb"/Kids\s*\[([^\]]*)\]", objects[k]):
                open_ += [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])][::-1]
        return out or [k for k in sorted(objects) if is_page(k)]

    def _page(self, body: bytes, objects: dict[int, bytes]) -> Page:
        page = Page()
        wanted = re.search(rb"/Contents\s*(?:\[([^\]]*)\]|(\d+\s+\d+\s+R))", body)
        for number in re.findall(rb"(\d+)\s+\d+\s+R", (wanted[1] or wanted[2]) if wanted else b""):
            part = re.search(rb"(?s)stream\r?\n(.*?)\r?\nendstream", objects.get(int(number), b""))
            if part is None:
                continue
            data = zlib.decompress(part[1]) if b"/FlateDecode" in objects[int(number)] else part[1]
            at = (0.0, 0.0)
            for m in re.finditer(rb"\((?:\\.|[^()\\])*\)\s*Tj|\[[^\]]*\]\s*TJ|T\*|\bTd\b|\bTD\b|(-?[\d.]+)\s+(-?[\d.]+)\s+([ml])\b", data):
                if m[3]:
                    to = float(m[1]), float(m[2])
                    if m[3] == b"l":
                        page.segments.append((to[0] - at[0], to[1] - at[1]))
                    at = to
                elif m[0].endswith((b"Tj", b"TJ")):
                    page.text += "".join(self._string(x) for x in re.findall(rb"\(((?:\\.|[^()\\])*)\)", m[0]))
                elif page.text and not page.text.endswith("\n"):
                    page.text += "\n"
        return page

    @staticmethod
    def _string(raw: bytes) -> str:
        return re.sub(rb"\\(.)", rb"\1", raw).decode("latin-1")


PARSED = (
    "source string, page int, total_pages int, text string, tables array<array<array<string>>>, fields array<struct<name:string,kind:string,flags:int,value:string>>, "
    "horizontal int, vertical int, image_text string, error string"
)


def parsed(files: DataFrame, reader: PdfReader, images: ImageReader | None = None) -> DataFrame:
    """A row for each page of the PDF files among files (path, content), and one of page 0 with the fields of each. A file that can't be read
    has one row, with an error; images: read for pages with too little text."""
    import math

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        pdf = reader.read(content)
        n = len(pdf.pages)
        yield path, 0, n, None, [], [{"name": a, "kind": b, "flags": c, "value": d} for a, b, c, d in pdf.fields], 0, 0, None, None
        for k, page in enumerate(pdf.pages, 1):
            angles = [abs(math.degrees(math.atan2(dy, dx))) for dx, dy in page.segments]
            short = images is not None and len(page.text.strip()) < SETTINGS.least_text and not page.tables
            yield path, k, n, page.text, page.tables, [], sum(a < 10 or a > 170 for a in angles), sum(80 < a < 100 for a in angles), images.page_text(content, k) if short else None, None

    kinds = pa.schema([("source", pa.string()), ("page", pa.int32()), ("total_pages", pa.int32()), ("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))),
                       ("fields", pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("flags", pa.int32()), ("value", pa.string())]))), ("horizontal", pa.int32()), ("vertical", pa.int32()), ("image_text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    out = list(rows(path, content.as_py()))
                except Exception as e:  # noqa: BLE001  whatever is wrong with a file goes into its row
                    out = [(path, None, None, None, [], [], None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return files.where(extension(F.col("path")) == ".pdf").select("path", "content").mapInArrow(run, PARSED)


def documents(pages: DataFrame, reader: str) -> DataFrame:
    """(source, page, total_pages, text, content_type, content_extracted, rotated_degrees, error) of what ``parsed`` gives: the form's summary as
    page 0 if there are fields, and each page with its text, its tables and what was read from its image. Pages without any text are left out."""
    form = form_summary(F.transform("fields", lambda f: F.struct(f["name"].alias("name"), field_type(f["kind"], f["flags"]).alias("type"), F.lit("N/A").alias("page"), field_value(f["value"]).alias("value"))))
    tables = F.array_join(F.transform("tables", lambda t, i: table_text(F.col("page"), i + 1, t)), "")
    own = strip(F.coalesce("text", F.lit("")))
    body = F.concat(F.when(own != "", F.concat(own, F.lit("\n\n"))).otherwise(""), tables)
    image = strip(F.coalesce("image_text", F.lit("")))
    by_image = needs_ocr(body) & (image != "")
    whole = strip(F.when(by_image, F.concat(body, F.lit("--- OCR Extracted Text ---\n"), image, F.lit("\n---\n"))).otherwise(body))
    log = F.array_join(F.array_sort(F.array_compact(F.array(F.when(own != "", f"Text({reader})"), F.when(F.size("tables") > 0, F.concat(F.lit("Tables("), F.size("tables").cast("string"), F.lit(")"))), F.when(by_image, "Text(OCR)")))), ", ")
    turned = F.nullif(rotation(F.col("horizontal"), F.col("vertical")), F.lit(0))
    summary = F.col("page") == 0
    out = pages.select(
        "source", "page", "total_pages", F.when(summary, F.when(F.size("fields") > 0, form)).otherwise(whole).alias("text"), F.when(summary, "form_data_summary").alias("content_type"),
        F.when(~summary, F.coalesce(F.nullif(log, F.lit("")), F.lit("None"))).alias("content_extracted"), F.when(~summary, turned).alias("rotated_degrees"), "error",
    )
    return out.where(F.col("error").isNotNull() | (F.coalesce("text", F.lit("")) != ""))


def field_type(kind: Column, flags: Column) -> Column:
    """A form field's type from its code and flags: of buttons bit 15 means radio, then bit 16 push, else a checkbox."""
    bit = lambda n: F.shiftright(F.coalesce(flags, F.lit(0)), n).bitwiseAND(F.lit(1)) == 1
    button = F.when(bit(15), "Radio").when(bit(16), "Pushbutton").otherwise("Checkbox")
    return F.when(kind == "Tx", "Text").when(kind == "Btn", button).when(kind == "Ch", "Choice").when(kind == "Sig", "Signature").otherwise(F.coalesce(kind, F.lit("Unknown")))


def field_value(value: Column) -> Column:
    """A form field's value as text: Yes and Off are truth values, none is written None."""
    return F.when(value == "Yes", "True").when(value == "Off", "False").otherwise(F.coalesce(value, F.lit("None")))


def form_summary(fields: Column) -> Column:
    """A form's fields, array of (name, type, page, value), as one text with a line for each."""
    line = lambda f: F.concat(F.lit("- Field '"), f["name"], F.lit("' (Type: "), f["type"], F.lit(", Page: "), f["page"], F.lit("): '"), f["value"], F.lit("'"))
    return F.concat(F.lit("Document Form Fields:\n"), F.array_join(F.transform(fields, line), "\n"))


def table_text(page: Column, number: Column, rows: Column) -> Column:
    """A page's table, array of rows of cells, under its title: cells stripped, line ends in them blanks, parted by tabs."""
    cell = lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    body = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), "\t")), "\n")
    titled = F.concat(F.lit("--- Table "), page.cast("string"), F.lit("."), number.cast("string"), F.lit(" ---\n"), body, F.lit("\n---\n\n"))
    return F.when(strip(body) == "", "").otherwise(titled)


def needs_ocr(text: Column) -> Column:
    """Whether a page has so little text that it is read as an image."""
    return F.length(strip(F.coalesce(text, F.lit("")))) < SETTINGS.least_text


def rotation(horizontal: Column, vertical: Column) -> Column:
    """The turn that a page needs by its lines: a quarter if upright ones outnumber the others by half."""
    return F.when(vertical > 1.5 * horizontal, 90).otherwise(0)


def line_votes(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Whether a line segment counts as horizontal, and as vertical."""
    angle = F.abs(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))))
    return (angle < 10) | (angle > 170), (angle > 80) & (angle < 100)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def nearest_labels(marks: DataFrame, labels: DataFrame, reach: float) -> DataFrame:
    """(mark, label, gap): each mark's nearest label on its page within the reach; ties go to the least label.

    marks: page, mark, x; labels: page, label, x, which is a double. Places are cut into strips wider than the reach and a label is put into its strip and
    the two beside it. In a strip, sorted by place, a mark's nearest label is the last one before it or the first one behind: no pairs are made, and a
    task holds no more than the sort does. Labels so close together that their gaps may be the same double are kept as one run."""
    width, tie = reach * 1.25 or 1.0, reach * 2.0**-50
    x = F.col("x").cast("double")
    # Far beyond, all is one strip.
    strip_of = F.floor(F.greatest(F.least(x / width, F.lit(1e15)), F.lit(-1e15))).cast("bigint")
    known = F.col("page").isNotNull() & (F.abs(x) < float("inf"))
    left = marks.where(known).select("page", strip_of.alias("strip"), x.alias("x"), F.struct("mark").alias("m"), F.lit(None).alias("near"))
    # Of labels at one place the least counts.
    places = labels.where(known).groupBy("page", x.alias("x")).agg(F.min(F.struct("label"))["label"].alias("label"))
    right = places.select("page", F.explode(F.sequence(strip_of - 1, strip_of + 1)).alias("strip"), "x", F.lit(None).alias("m"), F.struct(F.col("x").alias("lx"), "label").alias("near"))
    run = lambda frame: F.when(F.col("near").isNotNull(), F.expr(f"collect_list(near) over (partition by page, strip order by x range between {frame})"))
    rows = left.unionByName(right).withColumns({"before": run(f"{tie!r}D preceding and current row"), "behind": run(f"current row and {tie!r}D following")})
    up, down = (Window.partitionBy("page", "strip").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("x"), F.desc("x")))
    rows = rows.withColumns({"before": F.last("before", ignorenulls=True).over(up), "behind": F.last("behind", ignorenulls=True).over(down)}).where("m is not null")
    none = F.array().cast(rows.schema["before"].dataType)
    near = F.transform(F.concat(F.coalesce("before", none), F.coalesce("behind", none)), lambda n: F.struct(F.abs(F.col("x") - n["lx"]).alias("gap"), n["label"].alias("label")))
    best = rows.select("m.mark", F.array_min(F.filter(near, lambda n: n["gap"] <= reach)).alias("best")).where("best is not null")
    return best.groupBy("mark").agg(F.min("best").alias("best")).select("mark", "best.label", "best.gap")
