"""Best-fit packing of tokenized documents into sequences, finished by swap-based local search.

Pieces are dealt evenly over shards, each of which is packed by itself: the longest first into the
fullest sequence that still takes it, and then underfull sequences trade pieces. A move, a one-for-one
or a two-for-one exchange is made when it raises the sum of squared fills, so fuller sequences fill up
and emptier ones run empty. A shard wastes less than a sequence or so, whatever the corpus' size.
"""

from __future__ import annotations

import bisect
import string
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quire.llm.common import stored
from quire.llm.shingles import in_chunks

_OPEN: dict[str, "_Words"] = {}


class _Words(dict):
    """A tokenizer whose ids of a text are those of its white-space separated parts, remembered by part (ids as little-endian 32-bit words).

    The pre-tokenizer drops white space, never joins across it, and parts letters from marks, so a part
    of letters and a tail of ASCII marks is the ids of both. Latin letters are lowered and spelt in bytes
    here as the tokenizer does it, and its model is asked for the word; other parts are encoded whole, also
    where only the lowered letters are others (U+018F gives U+0259), and so are texts with a control
    character that Python takes for white space and the tokenizer doesn't. A part costs little while its
    word is known, so words are forgotten apart from parts.
    """

    ODD = "\x1c\x1d\x1e\x1f"
    MARKS = string.punctuation

    def __init__(self, path: str, remembered: int = 1_000_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {i: "".join(t for t, _ in spell(chr(i))) for i in range(128, 592)}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.most_parts, self.most_words = remembered * 2 // 5, remembered * 3 // 5

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, part: str) -> bytes:
        letters = part.rstrip(self.MARKS)
        low, ascii_only = letters.lower(), letters.isascii()
        if not letters.isalpha() or not (ascii_only or (max(letters) < "\u0250" and max(low) < "\u0250")):
            found = self.whole(part)
        else:
            found = self.words.get(low)
            if found is None:
                if len(self.words) >= self.most_words:
                    self.words.clear()
                found = self.words[low] = array("I", [t.id for t in self.model.tokenize(low if ascii_only else low.translate(self.spelt))]).tobytes()
            if len(letters) < len(part):
                tail = part[len(letters) :]
                if tail not in self.tails:
                    self.tails[tail] = self.whole(tail)
                found += self.tails[tail]
        if len(self) >= self.most_parts:
            self.clear()
            self.tails.clear()
        self[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(c in text for c in self.ODD):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, start, length, ids): documents as ids and end_id, cut only if over capacity.

    ids are little-endian unsigned 32-bit words. A null or empty text is only end_id; null doc_ids stay
    null, repeated rows are cut alike, other columns are ignored, an empty table stays empty.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _OPEN.get(tokenizer) or _OPEN.setdefault(tokenizer, _Words(tokenizer))
        for rest, texts in in_chunks(batches, most=1 << 20):
            rows = []
            for i, t in zip(rest["doc_id"], texts, strict=True):
                ids = words.encode(t.decode()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(cut) // 4, cut))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items, longest first, into the fullest bin that takes each."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, in order
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        at = bisect.bisect_left(rooms, need)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(item)
        left = room - need
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Held:
    """Which bins hold what a trade can give (a piece, or two) by its size, the emptiest bin first."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, capacity: int):
        self.bins: dict[int, list[tuple[int, int]]] = {}
        self.least = np.full(capacity + 1, self.NONE)  # the fill of the emptiest bin by size

    def put(self, b: int, fill: int, sizes: list[int]) -> None:
        for v in sizes:
            bisect.insort(self.bins.setdefault(v, []), (fill, b))
            self.least[v] = self.bins[v][0][0]

    def drop(self, b: int, fill: int, sizes: list[int]) -> None:
        for v in sizes:
            held = self.bins[v]
            del held[bisect.bisect_left(held, (fill, b))]
            self.least[v] = held[0][0] if held else self.NONE

    def best(self, fill: int, room: int, take: list[int]) -> tuple[int, int] | None:
        """The d up to room, the largest first, and the place in take, for which take + d comes from a bin emptier than fill + d."""
        top = len(self.least) - 1
        found, step = (0, 0), max(1, (1 << 20) // room)
        for at in range(0, len(take), step):
            d = np.arange(room, found[0], -1)
            want = np.array(take[at : at + step])[:, None] + d
            good = (self.least[np.minimum(want, top)] < fill + d) & (want <= top)
            first = int(good.any(axis=0).argmax()) if len(d) else 0
            if len(d) and good[:, first].any():
                found = int(d[first]), at + int(good[:, first].argmax())
        return found if found[0] else None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Trades pieces between bins with room until no trade of any two raises the sum of squared fills; empty bins go.

    A bin takes a piece for nothing, for one or for two of its own, or two for one, from any other bin:
    what fills it most, if it ends fuller than the other was. A full bin has no trade that raises the sum.
    """
    size = lengths.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    one, two = _Held(capacity), _Held(capacity)
    singles: dict[int, list[int]] = {}
    doubles: dict[int, list[int]] = {}

    def put(b: int) -> None:
        if 0 < fill[b] < capacity:
            n = Counter(size[i] for i in bins[b])
            singles[b] = sorted(n)
            doubles[b] = sorted({x + z for x in n for z in n if x < z} | {2 * x for x in n if n[x] > 1})
            one.put(b, fill[b], singles[b])
            two.put(b, fill[b], doubles[b])

    def drop(b: int) -> None:
        one.drop(b, fill[b], singles.pop(b))
        two.drop(b, fill[b], doubles.pop(b))

    def pick(b: int, total: int, n: int) -> list[int]:  # n pieces of b of this total size
        if n < 2:
            return next(([i] for i in bins[b] if size[i] == total), [])
        seen: dict[int, int] = {}
        for i in bins[b]:
            if total - size[i] in seen:
                return [seen[total - size[i]], i]
            seen[size[i]] = i
        raise ValueError("no such pieces")

    def trade(b: int) -> bool:
        mine, pairs = singles[b], doubles[b]
        drop(b)  # not with itself
        room = capacity - fill[b]
        a1, a2 = one.best(fill[b], room, [0, *mine, *pairs]), two.best(fill[b], room, mine)
        if not a1 and not a2:
            put(b)
            return False
        if a1 and (not a2 or a1[0] >= a2[0]):
            d, k = a1
            back, n_back, held, n = [0, *mine, *pairs][k], (0 if k == 0 else 1 if k <= len(mine) else 2), one, 1
        else:
            d, k = a2
            back, n_back, held, n = mine[k], 1, two, 2
        a = held.bins[back + d][0][1]
        give, take = pick(a, back + d, n), pick(b, back, n_back) if n_back else []
        drop(a)
        bins[a] = [i for i in bins[a] if i not in give] + take
        bins[b] = [i for i in bins[b] if i not in take] + give
        fill[a] -= d
        fill[b] += d
        put(a)
        put(b)
        return True

    for b in range(len(bins)):
        put(b)
    changed = len(singles) > 1
    while changed:
        changed = False
        for b in sorted(singles, key=lambda b: (-fill[b], b)):
            while b in singles and trade(b):
                changed = True
    return [b for b in bins if b]


def _placed(pieces: DataFrame, pieces_per_shard: int) -> DataFrame:
    """pieces with _shard: runs of pieces_per_shard rows in the order in which they come. Only the number of rows of each partition is summed up."""
    pieces = pieces.withColumn("_part", F.shiftright("_place", 33))
    counts = pieces.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return pieces.join(counts.select("_part", before.alias("_before")), "_part").withColumn("_shard", F.floor(at / pieces_per_shard))


def pack(pieces: DataFrame, *, capacity: int = 4096, pieces_per_shard: int = 20000) -> DataFrame:
    """pieces(doc_id, piece, length, ...) -> pieces and sequence_id, offset.

    Every length must be 1 to capacity. Shards are runs of pieces_per_shard rows (2**20 at most) in the
    order in which the rows come, so no key, document or source can make one large, and what comes in a
    certain mix is packed in that mix. Offsets are gapless from 0; sequence ids are unique and follow the
    shards' order. Equal rows are packed as often as they come; empty tables stay empty.
    """
    rest = [c for c in pieces.columns if c != "_place"]
    if "_place" not in pieces.columns:
        pieces = stored(pieces.withColumn("_place", F.monotonically_increasing_id()), "packing-places")
    schema = pieces.select(*rest).schema

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(rest).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])  # reruns agree
        lengths = rows.column("length").to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        sequence, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for k, items in enumerate(bins):
            sequence[items] = k
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        return rows.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 20))).append_column("offset", pa.array(offset))

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", sequence_id long, offset long"
    return _placed(pieces, pieces_per_shard).groupBy("_shard").applyInArrow(run, out)


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    One row per piece of each row of docs; see token_pieces and pack. Documents are packed with those
    that stand near them in docs. Repeated rows are packed as often as they come, null doc_ids stay
    null, and other columns are ignored.
    """
    ids = token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id)
    pieces = stored(ids.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("_place")), "packing-pieces")
    return pack(pieces, capacity=capacity)

