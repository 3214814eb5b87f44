"""Sheets and string tables of any size: read from the archive as a stream, cut into fragments, parsed in many tasks.

One task opens a package and passes over each part once, in pieces; what leaves it are fragments of
whole rows (or strings), each with the place and number of its first one. No text of a whole sheet exists.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.scalars import parse_cell_ref
from quire.sources.files import UNREADABLE, guard_archive

#: Bytes of a fragment, about: it ends with the row that reaches this.
FRAGMENT = 1 << 20
_BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))


def _utf8(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The same text in UTF-8, whatever of the marked encodings it came in."""
    first = next(pieces, b"")
    kind = next((name for mark, name in _BOMS if first.startswith(mark)), None)
    if kind is None:
        yield first
        yield from pieces
        return
    decoder = codecs.getincrementaldecoder(kind)()
    yield decoder.decode(first).encode()
    for piece in pieces:
        yield decoder.decode(piece).encode()


class _Cutter:
    """Follows a part's elements of one name as they begin, and cuts between them."""

    def __init__(self, element: str, size: int):
        self.element, self.size = element, size
        self.depth = self.level = 0  # level: depth of the elements that are counted, once one began
        self.count, self.number = 0, 1  # elements so far, and the number of the next if it has none of its own
        self.held, self.base = bytearray(), 0  # bytes from `base` on that are not given out
        self.began, self.latest, self.first = -1, -1, (0, 1)
        self.cut: list[tuple[int, int, str]] = []
        self.parser = expat.ParserCreate("UTF-8")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._begin, self._end

    def _begin(self, name: str, attributes: dict[str, str]) -> None:
        self.depth += 1
        if name.rpartition(":")[2] != self.element or self.level not in (0, self.depth):
            return
        self.level, self.latest = self.depth, self.parser.CurrentByteIndex
        if self.began >= 0 and self.latest - self.began >= self.size:
            self._give(self.latest)
        if self.began < 0:
            self.began, self.first = self.latest, (self.count, self.number)
        own = attributes.get("r", "")
        self.number = (int(own) if own.isascii() and own.isdigit() else self.number) + 1
        self.count += 1

    def _end(self, _: str) -> None:
        self.depth -= 1
        if self.level and self.depth == self.level - 2 and self.began >= 0:  # what holds them ends
            self._give(self.parser.CurrentByteIndex)

    def _give(self, to: int) -> None:
        if to > self.began >= 0:
            self.cut.append((*self.first, bytes(self.held[self.began - self.base : to - self.base]).decode()))
        self.began = -1
        del self.held[: to - self.base]
        self.base = to

    def fragments(self, pieces: Iterator[bytes]) -> Iterator[tuple[int, int, str]]:
        """(first, number, text): place of the fragment's first element, and the number it has if it has none of its own. Of markup that breaks off, all elements but the last are given."""
        try:
            for piece in pieces:
                self.held += piece
                self.parser.Parse(piece, False)
                yield from self.cut
                self.cut = []
                if self.began < 0 and (passed := self.parser.CurrentByteIndex) > self.base:
                    del self.held[: passed - self.base]
                    self.base = passed
            self.parser.Parse(b"", True)
        except expat.ExpatError:
            yield from self.cut
            self.cut = []
            self._give(self.latest)
            raise
        finally:
            left, self.cut = self.cut, []
        yield from left


FRAGMENTS = "file_id string, part string, fragment int, first long, number long, xml string, problem string"


def part_fragments(files: DataFrame, parts: str, element: str, size: int = FRAGMENT) -> DataFrame:
    """files(file_id, content) -> FRAGMENTS: packages' parts whose names match, cut between elements of that name.

    A part or package that cannot be read to its end gives what came before, and a row with its problem
    and no fragment. Packages that the guard refuses give nothing; as no part is held whole, it asks for
    their size only where they expand beyond measure. A null content is no package.
    """

    def cut(z: zipfile.ZipFile, entry: zipfile.ZipInfo) -> Iterator[tuple]:
        cutter, n = _Cutter(element, size), 0
        with z.open(entry) as stream:
            try:
                for found in cutter.fragments(_utf8(iter(lambda: stream.read(1 << 16), b""))):
                    yield entry.filename, n, *found, None
                    n += 1
            except (expat.ExpatError, UnicodeError, *UNREADABLE) as e:
                for found in cutter.cut:
                    yield entry.filename, n, *found, None
                    n += 1
                yield entry.filename, None, None, None, None, f"{type(e).__name__}: {e}"[:220]

    def read(content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for entry in z.infolist():
                    if matches(entry.filename):
                        yield from cut(z, entry)
        except UNREADABLE as e:
            yield None, None, None, None, None, f"{type(e).__name__}: {e}"[:220]

    matches = re.compile(parts).search
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in FRAGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column("file_id"), batch.column("content"), strict=True):
                for row in read(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((file_id.as_py(), *row), kinds, strict=True)], names)

    safe = guard_archive(files.select("file_id", "content"), streamed=True).filter("verdict = 'ok'").select("file_id", "content")
    return safe.mapInArrow(run, FRAGMENTS)


_OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
_TEXT = "t:string,r:array<struct<t:string>>"
_ROWS = f"row array<struct<_r:int,c:array<struct<_r:string,_t:string,v:string,is:struct<{_TEXT}>>>>>"
_STRINGS = f"si array<struct<{_TEXT}>>"
_KEYS = ["file_id", "part", "fragment"]


def _parsed(fragments: DataFrame, root: str, schema: str, element: str) -> DataFrame:
    """One row per element, dealt by fragment over all tasks: the keys, first, number, i (place in the fragment) and x."""
    spread = fragments.filter("problem is null").repartition(*_KEYS)
    found = F.from_xml(F.concat(F.lit(f"<{root}>"), "xml", F.lit(f"</{root}>")), schema, _OPTIONS)
    return spread.select(*_KEYS, "first", "number", F.posexplode(found[element]).alias("i", "x"))


def _plain(x: str) -> Column:
    return F.coalesce(F.col(f"{x}.t"), F.array_join(F.transform(F.col(f"{x}.r"), lambda r: r["t"]), ""))


def fragment_cells(fragments: DataFrame) -> DataFrame:
    """Fragments of sheets, cut between rows -> (file_id, part, row_pos, row_no, pos, row, col, ref, raw_type, raw_value) in document order.

    A row without a number follows the row before it, also over the edge of a fragment and after a row
    without cells; a cell without a reference follows the cell before it. Fragments are parsed, numbered
    and placed where the one exchange puts them.
    """
    rows = _parsed(fragments, "sheetData", _ROWS, "row")
    held = Window.partitionBy(*_KEYS).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("x._r").isNotNull(), F.struct(F.col("x._r").alias("no"), "i")), ignorenulls=True).over(held)
    rows = rows.withColumn("_known", known)
    row_no = F.coalesce(F.col("_known.no") + F.col("i") - F.col("_known.i"), F.col("number") + F.col("i")).cast("int")
    cells = rows.select(*_KEYS, (F.col("first") + F.col("i")).alias("row_pos"), row_no.alias("row_no"), F.posexplode("x.c").alias("at", "c")).withColumn("_ref", parse_cell_ref(F.col("c._r")))
    held = Window.partitionBy(*_KEYS, "row_pos").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_known", F.last(F.when(F.col("_ref.col").isNotNull(), F.struct(F.col("_ref.col").alias("col"), "at")), ignorenulls=True).over(held))
    col = F.coalesce(F.col("_known.col") + F.col("at") - F.col("_known.at"), F.col("at"))
    return cells.select(
        "file_id", "part", "row_pos", "row_no", (F.col("row_pos") * 100000 + F.col("at")).alias("pos"), F.coalesce("_ref.row", F.col("row_no") - 1).cast("int").alias("row"), col.cast("int").alias("col"),
        F.col("c._r").alias("ref"), F.col("c._t").alias("raw_type"), F.when(F.col("c._t") == "inlineStr", _plain("c.is")).otherwise(F.col("c.v")).alias("raw_value"),
    )


def fragment_strings(fragments: DataFrame) -> DataFrame:
    """Fragments of string tables, cut between si elements -> (file_id, idx, text)."""
    return _parsed(fragments, "sst", _STRINGS, "si").select("file_id", (F.col("first") + F.col("i")).alias("idx"), F.coalesce(_plain("x"), F.lit("")).alias("text"))
