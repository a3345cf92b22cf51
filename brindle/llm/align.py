"""Alignment of two tokenisations of the same texts (operator 11).

Two encoders cut the same bytes into tokens.  Each gives a table of *end events*: where each of its
tokens ends, in bytes, with the token's id.  The events of both sides are united, partitioned by document and
sorted within partitions by offset; a machine streams through a partition and cuts a document where
both sides end.  Between two cuts lies a *group*; the tokens of both sides that end at a cut are
*linked*.  An event row holds a run of at most ``RUN`` tokens (its start and their ids as bytes; an id gives
the length and so the end), so a document costs a few rows to shuffle, not one for each token.  The machine holds the runs of each
side that the other has not reached yet and the open group, so its memory does not grow with the
length of a document.

How often two ids are linked in the corpus is a count over the links, combined for each document
before the shuffle.  The counts meet the documents' links by broadcast while they are few enough
(``most_pairs``, counted first); beyond that the pairs that hold a thousandth of all links or more,
at most a thousand, are broadcast, and the others are joined by shuffle, where none is hot.

Encoding a text costs a look-up for each word: a text is cut at single spaces between characters that
are not white space, where no token of either kind can reach across, and each distinct unit is encoded
once for each worker, by the library of its vocabulary (``tokenizers`` or ``sentencepiece``).

Defined results: texts that are null, empty, or that an encoder's tokens do not give back byte for
byte (with one space before) have no tokens, so zeros; special strings in a text are text; the longest
texts are encoded whole; repeated rows are documents of their own; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow, spread
from . import kernels
from .storage import materialize
from .tokens import _byte_letters, _must_be_plain

#: Tokens of one event row.
RUN = 1 << 14
#: Distinct units that a worker keeps, and their bytes.
MOST_UNITS, MOST_UNIT_BYTES = 600_000, 16 << 20
#: Pairs of ids that are broadcast with their counts.
MOST_PAIRS = 1_000_000
EVENTS = "row long, doc_id long, side int, start long, ids binary"


class JsonEncoder:
    """Ids and token lengths by a ``tokenizers`` file of byte-level BPE; special strings are text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks run side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = _byte_letters()
        size = self.library.get_vocab_size(with_added_tokens=True)
        tokens = (self.library.id_to_token(n) or "" for n in range(size))
        self.bytes_of = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            _must_be_plain(spec)
            self.cuts = True
        except ValueError:
            self.cuts = False

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]


class PieceEncoder:
    """Ids and token lengths by a ``sentencepiece`` model, which adds the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(n) for n in range(self.library.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.library.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)]
        #: Whether spaces stand at the start of pieces only, so that no token reaches across a unit's start.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [self.library.encode(u[1:]) for u in units]


@lru_cache(maxsize=8)
def encoder(path: str) -> JsonEncoder | PieceEncoder:
    return JsonEncoder(path) if path.endswith(".json") else PieceEncoder(path)


class Side:
    """What one encoder makes of the units known: ids, laid end to end."""

    def __init__(self, of: JsonEncoder | PieceEncoder):
        self.of = of
        self.lengths = np.array([len(b) for b in of.bytes_of], np.int64)
        self.id_type = np.uint16 if len(self.lengths) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, self.id_type), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.n = self.used = 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New units, numbered on: their ids, and how many each has (-1: not its bytes)."""
        room = lambda held, n: held if n <= len(held) else np.concatenate([held, np.zeros(max(n, len(held)), held.dtype)])
        self.flat, self.starts, self.sizes = room(self.flat, self.used + len(ids)), room(self.starts, self.n + len(sizes)), room(self.sizes, self.n + len(sizes))
        own, now = np.maximum(sizes, 0), slice(self.n, self.n + len(sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[now], self.starts[now] = sizes, self.used + np.cumsum(own) - own
        self.n, self.used = self.n + len(sizes), self.used + len(ids)

    def learn_words(self, words: list[str]) -> None:
        """Words are encoded as one text, which is parted where each ends."""
        joined = " " + " ".join(words)
        ids = np.array(self.of.encode([joined])[0], self.id_type)
        ends, reached = np.cumsum([1 + len(w.encode()) for w in words]), np.cumsum(self.lengths[ids])
        upto = np.searchsorted(reached, ends, "right")
        if b"".join([self.of.bytes_of[n] for n in ids.tolist()]) == joined.encode() and np.array_equal(reached[upto - 1], ends):
            self._keep(ids, np.diff(upto, prepend=0))
        else:
            self.learn_each(words)

    def learn_each(self, units: list[str]) -> None:
        for unit, ids in zip(units, self.of.encode([" " + u for u in units])):
            good = b"".join([self.of.bytes_of[n] for n in ids]) == b" " + unit.encode()
            self._keep(np.array(ids if good else [], self.id_type), np.array([len(ids) if good else -1]))

    def gathered(self, at: np.ndarray) -> np.ndarray | None:
        """The ids of a text whose units these are; None if they do not give its bytes back."""
        sizes = self.sizes[at]
        if sizes.min() < 0:
            return None
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[at] - (ends - sizes), sizes)]


class Units:
    """Encodes texts by their units, on one side or more, and remembers those."""

    def __init__(self, *of: JsonEncoder | PieceEncoder):
        self.sides = [Side(e) for e in of]
        self.cuts = all(e.cuts for e in of)
        self.place: dict[str, int] = {}
        self.n_bytes = 0

    def _learn(self, units: list[str], how: str) -> None:
        if units:
            self.place.update(zip(units, range(len(self.place), len(self.place) + len(units))))
            self.n_bytes += sum(map(len, units))
            for side in self.sides:
                getattr(side, how)(units)

    @staticmethod
    def parted(text: str) -> list[str]:
        """The text's units: cut at single spaces between characters that are not white space."""
        out: list[list[str]] = []
        closed = False
        for word in text.split(" "):
            if closed and word and not word[0].isspace():
                out.append([word])
            elif out:
                out[-1].append(word)
            else:
                out.append([word])
            closed = bool(word) and not word[-1].isspace()
        return [" ".join(x) for x in out]

    def encode(self, texts: list[str]) -> list[list[np.ndarray | None]]:
        """For each side, each text's ids; None if they do not give its bytes back.

        A word that neither begins nor ends with white space is a unit; a text with other words is cut more
        slowly.  What is new in all the texts is encoded at once.
        """
        if len(self.place) > MOST_UNITS or self.n_bytes > MOST_UNIT_BYTES:
            self.place, self.n_bytes = {}, 0
            for side in self.sides:
                side.forget()
        parts = [text.split(" ") if self.cuts else [text] for text in texts]
        words = dict.fromkeys(chain.from_iterable(parts))
        loose = {w for w in words if not w or w[0].isspace() or w[-1].isspace()} if self.cuts else set(words)
        if loose and self.cuts:
            parts = [p if loose.isdisjoint(p) else self.parted(t) for p, t in zip(parts, texts)]
            words = dict.fromkeys(chain.from_iterable(parts))
        place = self.place
        new = [u for u in words if u not in place]
        free = [u for u in new if self.cuts and u not in loose and " " not in u]
        self._learn(free, "learn_words")
        self._learn([u for u in new if u not in place] if len(free) < len(new) else [], "learn_each")
        here = {u: place[u] for u in words}  # the words of these texts alone: a small table
        found = [np.array(list(map(here.get, p))) for p in parts]
        return [[side.gathered(at) for at in found] for side in self.sides]


@lru_cache(maxsize=4)
def units(vocabularies: tuple[str, ...]) -> Units:
    return Units(*map(encoder, vocabularies))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id and text; a row's number is its place in ``docs``, which must give its rows in the same order whenever it is read."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encoded(held: Units, data: list[bytes]) -> list[list[np.ndarray]]:
    """For each side the ids of texts; none on any for those that are empty, no text at all, or not given back."""
    texts = [d.decode(errors="replace") for d in data]
    good = [n for n, (d, t) in enumerate(zip(data, texts)) if d and ("\ufffd" not in t or t.encode() == d)]
    made = held.encode([texts[n] for n in good]) if good else [[] for _ in held.sides]
    out = [[np.zeros(0, side.id_type)] * len(data) for side in held.sides]
    for place, n in enumerate(good):
        if all(ids[place] is not None for ids in made):
            for side, ids in enumerate(made):
                out[side][n] = ids[place]
    return out


def end_events(rows: DataFrame, vocabularies: dict[int, str]) -> DataFrame:
    """``EVENTS`` of the sides named: where a run of tokens starts, in bytes, and its ids, whose lengths give the ends.

    A text without tokens has one empty run.  Both sides in one pass read the texts once; tables of single sides can be united.
    """
    numbers, paths = list(vocabularies), tuple(vocabularies.values())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = units(paths)
        for batch in kernels.small_batches(batches, "text", 2 << 20):
            row_numbers, keys = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            out: list[list] = [[], [], [], [], []]
            for number, side, texts in zip(numbers, held.sides, encoded(held, kernels.text_bytes(batch.column("text")))):
                for row, key, ids in zip(row_numbers, keys, texts):
                    start = 0
                    for at in range(0, max(len(ids), 1), RUN):
                        part = ids[at : at + RUN]
                        for column, value in zip(out, (row, key, number, start, part.tobytes())):
                            column.append(value)
                        start += int(side.lengths[part].sum())
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "doc_id", "side", "start", "ids"])

    return map_arrow(rows.select("row", "doc_id", "text"), run, EVENTS)


def sorted_events(events: DataFrame) -> DataFrame:
    """The end events of both sides, a document's together and in the order of their offsets."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return events.repartition(parts, "row").sortWithinPartitions("row", "start", "side")


class Cut(NamedTuple):
    """What the machine has passed: whole groups of one document, between ``start`` and the last of ``ends``."""

    row: int
    doc_id: int | None
    start: int
    ends: np.ndarray
    a: np.ndarray
    b: np.ndarray
    #: How many ids of each side every group has.
    n_a: np.ndarray
    n_b: np.ndarray
    #: Whether the document ends here.
    last: bool


class Pending:
    """Tokens of one side that the other has not reached yet."""

    def __init__(self, of: Side):
        self.of = of
        self.ends, self.ids, self.at = np.zeros(0, np.int64), np.zeros(0, of.id_type), 0

    def take(self, data: bytes) -> None:
        ids = np.frombuffer(data, self.of.id_type)
        ends = self.at + np.cumsum(self.of.lengths[ids])
        self.ends, self.ids = (np.concatenate([self.ends, ends]), np.concatenate([self.ids, ids])) if len(self.ends) else (ends, ids)
        self.at = int(ends[-1]) if len(ends) else self.at

    def give(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids up to the last cut, and how many lie in each group."""
        upto = np.searchsorted(self.ends, cuts, "right")
        n = int(upto[-1])
        ids = self.ids[:n]
        self.ends, self.ids = self.ends[n:], self.ids[n:]
        return ids, np.diff(upto, prepend=0)


def common(a: np.ndarray, b: np.ndarray, done: int) -> np.ndarray:
    """The ends that both sides have; all lie beyond ``done``."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64)
    seen = np.zeros(int(max(a[-1], b[-1])) - done + 1, bool)
    seen[b - done] = True
    return a[seen[a - done]]


def sweep(batches: Iterable[pa.RecordBatch], held: Units) -> Iterator[Cut]:
    """Streams through sorted events and gives what lies between the ends that both sides share."""
    row, doc_id, sides, done = None, None, [Pending(s) for s in held.sides], 0
    none = np.zeros(0, np.int64)

    def closing(last: bool) -> Cut | None:
        nonlocal done
        a, b = sides
        cuts = common(a.ends, b.ends, done) if not last or a.at == b.at else none
        if not len(cuts):
            return Cut(row, doc_id, done, none, none, none, none, none, last) if last else None
        (a_ids, n_a), (b_ids, n_b) = (s.give(cuts) for s in sides)
        out = Cut(row, doc_id, done, cuts, a_ids, b_ids, n_a, n_b, last)
        done = int(cuts[-1])
        return out

    for batch in batches:
        for number, key, side, data in zip(*(batch.column(n).to_pylist() for n in ("row", "doc_id", "side", "ids"))):
            if number != row:
                if row is not None:
                    yield closing(True)
                row, doc_id, sides, done = number, key, [Pending(s) for s in held.sides], 0
            sides[side].take(data)
            if min(len(s.ends) for s in sides) >= RUN and (cut := closing(False)):  # pass what both sides have reached
                yield cut
    if row is not None:
        yield closing(True)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int32()))


def groups(events: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """row, doc_id, start, end (bytes of space + text), a_ids and b_ids of every group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in sweep(batches, units(vocabularies)):
            n = len(cut.ends)
            if n:
                starts = np.concatenate(([cut.start], cut.ends[:-1]))
                columns = [pa.array(np.full(n, cut.row)), pa.array([cut.doc_id] * n, pa.int64()), pa.array(starts), pa.array(cut.ends), _lists(cut.a, cut.n_a), _lists(cut.b, cut.n_b)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "start", "end", "a_ids", "b_ids"])

    return map_arrow(events, run, "row long, doc_id long, start long, end long, a_ids array<int>, b_ids array<int>")


class GroupText:
    """Writes groups as ``a1,a2|b1;...``: every id is a string with the sign after it, and Arrow joins them."""

    def __init__(self, n_a: int, n_b: int):
        signs = [*((",", "|") * n_a), *((",", ";") * n_b)]
        self.table = pa.array([f"{n // 2 if n < 2 * n_a else n // 2 - n_a}{sign}" for n, sign in enumerate(signs)])
        self.first_b = 2 * n_a

    def of(self, cut: Cut) -> memoryview:
        both = np.stack([cut.n_a, cut.n_b], 1)
        before = np.cumsum(both.ravel()).reshape(both.shape)
        places = np.empty(len(cut.a) + len(cut.b), np.int64)
        for ids, counts, ends, base in ((cut.a, cut.n_a, before[:, 0], 0), (cut.b, cut.n_b, before[:, 1], self.first_b)):
            own = np.cumsum(counts)
            at = np.arange(len(ids)) + np.repeat(ends - own, counts)
            places[at] = base + 2 * ids.astype(np.int64)
            places[ends - 1] += 1
        joined = self.table.take(pa.array(places))
        ends = np.frombuffer(joined.buffers()[1], np.int32)
        return memoryview(joined.buffers()[2])[: int(ends[len(joined)])]


def passed(events: DataFrame, vocabularies: tuple[str, str]) -> DataFrame:
    """Of every document the rows (row, doc_id, pair, n): links of two ids, a pair being a << 32 | b; and one row
    without a pair, with n_a, n_b, n_groups and groups_sha256 ('' without tokens)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = GroupText(*(len(s.lengths) for s in units(vocabularies).sides))
        whole, n_a, n_b, n_groups, ended = hashlib.sha256(), 0, 0, 0, b""
        made: list[tuple] = []
        heads: list[tuple] = []
        held = 0
        for cut in sweep(batches, units(vocabularies)):
            if len(cut.ends):
                told = text.of(cut)
                whole.update(ended)  # the sign after a group stands before the next one only
                whole.update(told[:-1])
                ended = b";"
                n_a, n_b, n_groups = n_a + len(cut.a), n_b + len(cut.b), n_groups + len(cut.ends)
                ends = [np.cumsum(n) - 1 for n in (cut.n_a, cut.n_b)]
                pairs, counts = np.unique(cut.a[ends[0]].astype(np.int64) << 32 | cut.b[ends[1]].astype(np.int64), return_counts=True)
                made.append((cut.row, cut.doc_id, pairs, counts))
                held += len(pairs)
            if cut.last:
                heads.append((cut.row, cut.doc_id, n_a, n_b, n_groups, whole.hexdigest() if n_groups else ""))
                whole, n_a, n_b, n_groups, ended = hashlib.sha256(), 0, 0, 0, b""
            if len(heads) >= 4096 or held >= 1 << 16:
                yield batch_of(made, heads)
                made, heads, held = [], [], 0
        if made or heads:
            yield batch_of(made, heads)

    def batch_of(made: list[tuple], heads: list[tuple]) -> pa.RecordBatch:
        n = np.array([len(m[2]) for m in made] + [1] * len(heads))
        rows = np.repeat(np.array([x[0] for x in (*made, *heads)], np.int64), n)
        keys = [x[1] for x in (*made, *heads)]
        null = np.repeat(np.array([k is None for k in keys]), n)
        ids = np.repeat(np.array([k or 0 for k in keys], np.int64), n)
        total, more = int(n.sum()) - len(heads), len(heads)
        pairs, counts = (pa.concat_arrays([*[pa.array(m[k], pa.int64()) for m in made], pa.nulls(more, pa.int64())]) for k in (2, 3))
        tail = [pa.concat_arrays([pa.nulls(total, kind), pa.array([h[k] for h in heads], kind)]) for k, kind in ((2, pa.int64()), (3, pa.int64()), (4, pa.int64()), (5, pa.string()))]
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, mask=null), pairs, counts, *tail], ["row", "doc_id", "pair", "n", "n_a", "n_b", "n_groups", "groups_sha256"])

    return map_arrow(events, run, "row long, doc_id long, pair long, n long, n_a long, n_b long, n_groups long, groups_sha256 string")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count and best (whether no pair of the same B id has more) over all links (pair, n)."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def scored_links(links: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The links (with a pair) with their pair's count and best, in a form that no hot pair slows.

    ``counts`` is read several times: a written table.
    """
    if counts.count() <= most_pairs:
        return links.join(F.broadcast(counts), "pair")
    hot = F.col("count") * 1000 >= counts.agg(F.sum("count")).first()[0]  # at most a thousand pairs
    found = links.join(F.broadcast(counts.filter(hot)), "pair", "left")
    known = F.col("count").isNotNull()
    return found.filter(known).unionByName(found.filter(~known).drop("count", "best").join(counts.filter(~hot), "pair"))


def digest(docs: DataFrame, vocabularies: tuple[str, str], most_pairs: int = MOST_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the alignment of every document holds: tokens, groups, links, and how common its links are in the corpus."""
    rows = numbered(docs, id_col, text_col)
    events = sorted_events(end_events(spread(rows), dict(enumerate(vocabularies))))
    found = materialize(passed(events, vocabularies), "links")
    links = found.filter("pair is not null").select("row", "doc_id", "pair", "n")
    counts = materialize(pair_counts(links), "pairs")
    of_links = scored_links(links, counts, most_pairs).groupBy("row", "doc_id").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")
    )
    heads = found.filter("pair is null").select("row", "n_a", "n_b", "n_groups", "groups_sha256", F.col("doc_id").alias("key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    both = heads.join(of_links.drop("doc_id"), "row", "left")
    return both.select(F.col("key").alias("doc_id"), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
