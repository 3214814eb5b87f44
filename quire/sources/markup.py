"""XML parts as tables of elements: a reader that only reports what begins and ends, everything else in Spark.

A node is one element with its place in document order (pre when it begins, post when it ends), the
elements around it (tags and path, outermost first, itself last) and its attributes and own text. So
"the paragraph that this run stands in" is an expression on one row, not a walk.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The namespaces of the formats and the prefixes used for them here.
PREFIXES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://purl.oclc.org/ooxml/wordprocessingml/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://purl.oclc.org/ooxml/officeDocument/math": "m",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://purl.oclc.org/ooxml/drawingml/main": "a",
    "http://schemas.openxmlformats.org/presentationml/2006/main": "p",
    "http://purl.oclc.org/ooxml/presentationml/main": "p",
    "http://schemas.openxmlformats.org/spreadsheetml/2006/main": "x",
    "http://purl.oclc.org/ooxml/spreadsheetml/main": "x",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://purl.oclc.org/ooxml/officeDocument/relationships": "r",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "urn:schemas-microsoft-com:vml": "v",
}

#: Elements inside each other; deeper markup is refused, as its paths would grow with the square of the depth.
MOST_DEPTH = 400

NODE = "pre long, post long, child int, twin int, path array<long>, tags array<string>, children array<int>, attrs map<string,string>, text string, problem string"
_ARROW = {
    "pre": pa.int64(), "post": pa.int64(), "child": pa.int32(), "twin": pa.int32(), "path": pa.list_(pa.int64()), "tags": pa.list_(pa.string()), "children": pa.list_(pa.int32()),
    "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string(), "problem": pa.string(),
}


def _named(name: str) -> str:
    space, _, local = name.rpartition(" ")
    return local if not space else f"{PREFIXES.get(space, '?')}:{local}"


class _Reader:
    """Reports elements as they end; the numbers of a node are those of the calls that began and ended it."""

    def __init__(self, wanted: frozenset[str]):
        self.wanted, self.done, self.step = wanted, [], 0
        self.tags, self.path, self.children, self.open = [], [], [], [(Counter(), [])]
        self.parser = expat.ParserCreate("UTF-8", " ")
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self.begin, self.end, self.characters

    def begin(self, name: str, attributes: dict[str, str]) -> None:
        tag, around = _named(name), self.open[-1][0]
        if len(self.tags) >= MOST_DEPTH:
            raise ValueError(f"elements are nested more than {MOST_DEPTH} deep")
        self.tags.append(tag)
        self.path.append(self.step)
        self.children.append(around.total())
        self.open.append((Counter(), [], around[tag], attributes))
        around[tag] += 1
        self.step += 1

    def characters(self, text: str) -> None:
        self.open[-1][1].append(text)

    def end(self, _: str) -> None:
        _, text, twin, attributes = self.open.pop()
        tag = self.tags[-1]
        if tag in self.wanted:
            self.done.append((self.path[-1], self.step, self.children[-1], twin, self.path[:], self.tags[:], self.children[:], [(_named(k), v) for k, v in attributes.items()], "".join(text), None))
        self.step += 1
        self.tags.pop()
        self.path.pop()
        self.children.pop()


def _problem(data: bytes) -> str | None:
    """Why this is no XML; found before any element is reported, so that a damaged part gives its problem alone."""
    try:
        expat.ParserCreate("UTF-8", " ").Parse(data, True)
    except expat.ExpatError as e:
        return str(e)
    return None


def _reported(data: bytes | None, reader: _Reader, blank: tuple, step: int = 1 << 16) -> Iterator[list[tuple]]:
    """What the reader reports of a part; its problem, if there is one, stands behind the columns of blank."""
    data = data or b""
    problem = _problem(data)
    try:
        for at in range(0, 0 if problem else len(data), step):
            reader.parser.Parse(data[at : at + step], at + step >= len(data))
            if len(reader.done) >= 4096:
                yield reader.done
                reader.done = []
    except ValueError as e:
        problem = str(e)
    if problem:
        reader.done.append((*blank, problem))
    yield reader.done


def _nodes(data: bytes | None, wanted: frozenset[str]) -> Iterator[list[tuple]]:
    return _reported(data, _Reader(wanted), (0, 0, 0, 0, [0], [], [0], None, None))


#: Rows of a batch at least, where there are as many: small parts share batches.
BATCH = 4096


def _in_batches(batches: Iterator[pa.RecordBatch], xml: str, keys: list[str], kinds: dict[str, pa.DataType], reported: Callable[[bytes | None], Iterator[list[tuple]]]) -> Iterator[pa.RecordBatch]:
    """What is reported of each part, with its keys, in batches that do not end with the part."""
    for batch in batches:
        own, held, owners = [batch.column(k) for k in keys], [], []

        def made() -> pa.RecordBatch:
            at = pa.array(owners, pa.int64())
            columns = zip(*held, strict=True) if held else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([c.take(at) for c in own] + [pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], [*keys, *kinds])

        for i, data in enumerate(batch.column(xml)):
            for rows in reported(data.as_py()):
                held += rows
                owners += [i] * len(rows)
                if len(held) >= BATCH:
                    yield made()
                    held, owners = [], []
        if held:
            yield made()


def xml_nodes(parts: DataFrame, wanted: set[str], xml: str = "xml") -> DataFrame:
    """parts(keys..., xml) -> (keys..., NODE): a row for each element of a wanted name, wherever it stands.

    child is its number among the elements of its parent, twin among those of its own name, children the
    child numbers of all of path. A part that is null, no XML or nested too deep is one row with its
    problem (with the elements before the place that is too deep).
    """
    keys = [c for c in parts.columns if c != xml]
    names = frozenset(wanted)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema) + ", " + NODE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(batches, xml, keys, _ARROW, lambda data: _nodes(data, names))

    return parts.select(*keys, F.col(xml).cast("binary").alias(xml)).mapInArrow(run, schema)


class _Places(_Reader):
    """Reports elements of the branches that are read with their numbers in their scopes, not with all that is around them."""

    def __init__(self, wanted: frozenset[str], scopes: dict[str, str | None], outer: frozenset[str], attributes: tuple[str, ...]):
        super().__init__(wanted)
        self.slots, self.outer, self.attributes, self.names = {tag: i for i, tag in enumerate(scopes)}, outer, attributes, {}
        self.within = [self.slots.get(scope) for scope in scopes.values()]
        self.cleared = [tuple(k for k, scope in enumerate(scopes.values()) if scope == tag) for tag in scopes]
        self.of_all, self.bare = [0] * len(scopes), (None,) * len(attributes)
        # of an element: name, pre, elements in it so far (by name, too), twin, (number, depth, elements numbered in it) by scope and their numbers and depths as columns, outermost, whether it is read, attributes, text
        self.open = [[None, None, 0, {}, 0, ((None,) * len(scopes), (None,) * (2 * len(scopes))), None, True, {}, []]]

    def begin(self, name: str, attributes: dict[str, str]) -> None:
        tag = self.names.get(name) or self.names.setdefault(name, _named(name))
        if len(self.open) > MOST_DEPTH:
            raise ValueError(f"elements are nested more than {MOST_DEPTH} deep")
        over = self.open[-1]
        read, near, outer, twin = over[7] and (over[0] != "mc:AlternateContent" or over[2] == 0), over[5], over[6], over[3].get(tag, 0)
        over[2] += 1
        over[3][tag] = twin + 1
        slot = self.slots.get(tag)
        if slot is not None and read and outer is None:
            near = self.numbered(near, slot)
        if outer is None and tag in self.outer:
            outer = self.step
        self.open.append([tag, self.step, 0, {}, twin, near, outer, read, attributes, []])
        self.step += 1

    def numbered(self, near: tuple, slot: int) -> tuple:
        """The numbers around an element whose own is told: among those of its name in the scope's element, or in the part."""
        scope, before, out = self.within[slot], near[0][slot], list(near[0])
        counts = self.of_all if scope is None else out[scope] and out[scope][2]
        if counts is None:
            return near
        out[slot] = (counts[slot], before[1] + 1 if before else 0, [0] * len(out))
        counts[slot] += 1
        for k in self.cleared[slot]:
            out[k] = None
            for j in self.cleared[k]:
                out[j] = None
        return tuple(out), tuple(x for n in out for x in (n[:2] if n else (None, None)))

    def characters(self, text: str) -> None:
        self.open[-1][9].append(text)

    def end(self, _: str) -> None:
        tag, pre, _, _, twin, near, outer, read, attributes, text = self.open.pop()
        if read and tag in self.wanted:
            over, above = self.open[-1], self.open[-2] if len(self.open) > 1 else self.open[0]
            own = self.bare
            if attributes:
                told = {self.names.get(k) or self.names.setdefault(k, _named(k)): v for k, v in attributes.items()}
                own = [told.get(a) for a in self.attributes]
            self.done.append((pre, self.step, over[1], above[1], twin, tag, over[0], above[0], outer, *near[1], *own, "".join(text), None))
        self.step += 1


def xml_places(parts: DataFrame, wanted: set[str], scopes: dict[str, str | None], outer: set[str] = frozenset(), attributes: tuple[str, ...] = ()) -> DataFrame:
    """parts(keys..., xml) -> a row for each element of a wanted name in the branches that are read, with a few columns of what is around it.

    pre and post as of xml_nodes; up and upper, the pre of its parent and of that one's; twin; tag, over and above, its name
    and theirs; outermost, the pre of the outermost element around it named in `outer`, itself included. For each name of
    `scopes` no_<name> and in_<name>: the number of the nearest element of that name among those in the element its scope
    names (None: the part), and how many of that name are around that. Elements inside one of `outer` have no numbers of
    their own. a_<name> for each of `attributes`; text and problem as of xml_nodes.
    """
    keys = [c for c in parts.columns if c != "xml"]
    local = {tag: tag.replace(":", "_") for tag in (*scopes, *attributes)}
    columns = {**dict.fromkeys(("pre", "post", "up", "upper"), "long"), "twin": "int", **dict.fromkeys(("tag", "over", "above"), "string"), "outermost": "long"}
    for tag in scopes:
        columns |= {f"no_{local[tag]}": "long", f"in_{local[tag]}": "int"}
    columns |= {f"a_{local[a]}": "string" for a in attributes} | {"text": "string", "problem": "string"}
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = {c: types[k] for c, k in columns.items()}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*keys).schema] + [f"`{c}` {k}" for c, k in columns.items()])
    names, outermost_of = frozenset(wanted), frozenset(outer)
    blank = (0, 0, *[None] * (len(columns) - 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(batches, "xml", keys, kinds, lambda data: _reported(data, _Places(names, scopes, outermost_of, attributes), blank))

    return parts.select(*keys, F.col("xml").cast("binary").alias("xml")).mapInArrow(run, schema)


def name() -> Column:
    return F.try_element_at("tags", F.lit(-1))


def parent() -> Column:
    return F.try_element_at("tags", F.lit(-2))


def enclosing(*tags: str) -> Column:
    """pre of the nearest element of one of these names around a node, or the node itself; null if there is none."""
    return F.array_max(F.transform(F.filter(F.arrays_zip("tags", "path"), lambda x: x["tags"].isin(*tags)), lambda x: x["path"]))


def outermost(*tags: str) -> Column:
    return F.array_min(F.transform(F.filter(F.arrays_zip("tags", "path"), lambda x: x["tags"].isin(*tags)), lambda x: x["path"]))


def shown() -> Column:
    """Whether a node is in the branch of alternatives that is read: of each mc:AlternateContent the first."""
    behind = F.arrays_zip(F.slice("tags", 1, F.size("tags") - 1).alias("over"), F.slice("children", 2, F.size("tags") - 1).alias("child"))
    return ~F.array_contains("tags", "mc:AlternateContent") | ~F.exists(behind, lambda x: (x["over"] == "mc:AlternateContent") & (x["child"] > 0))
