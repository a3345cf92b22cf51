"""Exact token counts at every prefix by dynamic programming (operator 9).

Byte-pair encoding has a useful property: a token sequence is the encoding of its text exactly
when every two neighbours are *compatible*, that is, when encoding the two tokens' joined bytes
gives those two tokens back.  So the last token of each prefix is unique, and one pass over a
piece finds it: at byte i take a token ending there whose start j has a last token compatible
with it; then count[i] = count[j] + 1.  Each distinct piece is solved once per worker and its
counts at all prefixes are kept, so the questions "how many tokens has this prefix" and "how long
a prefix fits the budget" are look-ups, not encodings.

The text is first cut into special tokens, then into pieces by the tokenizer's own pattern; pieces
are independent, so a text's count is the sum of its pieces' last counts.

Defined results: null counts as empty (0 bytes, 0 tokens); texts are never cut; special strings in
a text are special tokens, as the library's default has it; repeated rows give repeated rows; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from . import kernels

# Fixed value: the public split pattern of byte-level BPE vocabularies of this kind.
PIECE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def _must_be_plain(spec: dict) -> None:
    """Refuses vocabulary files whose texts are cut or changed otherwise than this module does."""
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    flags = [x["content"] for x in spec.get("added_tokens", []) if any(x.get(f) for f in ("single_word", "lstrip", "rstrip", "normalized"))]
    good = {
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(f) for f in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "normalizer": spec.get("normalizer") is None, "added_tokens": not flags,
        "pre_tokenizer": cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"),
    }
    if not all(good.values()):
        raise ValueError(f"only plain byte-level BPE is counted by prefixes; other settings in: {[k for k, ok in good.items() if not ok]}")


class PrefixCounter:
    """Prefix counts for one vocabulary file (``tokenizers`` JSON, byte-level BPE)."""

    #: Pieces of up to so many bytes share prefix states.
    SHARED = 32

    def __init__(self, path: str, keep: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _must_be_plain(spec)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        model = spec["model"]
        special = {x["content"] for x in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(self.ids[raw(a)], self.ids[raw(b)]): (n, self.ids[raw(a + b)]) for n, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.piece = regex.compile(PIECE)
        self.keep = keep
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, int] = {}
        self.states: dict[bytes, int] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by repeated merging; only for the short strings of compatibility tests."""
        parts = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            ok = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[a, b] = ok
        return ok

    def prefixes(self, data: bytes) -> list[int]:
        """Token count of data[:i] for i = 0 .. len(data), as one piece."""
        ids, last, count = self.ids, [-1], [0]
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - self.longest), i):
                token = ids.get(data[j:i])
                if token is not None and (j == 0 and self.whole(token) or j and self.compatible(last[j], token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        return count

    @lru_cache(maxsize=None)  # noqa: B019 - one counter lives as long as its worker
    def whole(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        return self.merged(self.bytes_of[token]) == [token]

    def _count(self, piece: str) -> int:
        """Tokens of one piece; pieces share the stored states of their common prefixes."""
        data = piece.encode()
        if len(data) > self.SHARED:
            n = self.prefixes(data)[-1]
        else:
            n = self._shared(data) >> 20
        if len(self.known) >= self.keep:
            self.known.clear()
        self.known[piece] = n
        return n

    def _shared(self, data: bytes) -> int:
        """count << 20 | last token of ``data``, from the longest prefix whose state is stored."""
        if len(self.states) >= self.keep:
            self.states.clear()
        states, ids, fits = self.states, self.ids, self.fits
        at = len(data)
        while at and data[:at] not in states:
            at -= 1
        for i in range(at + 1, len(data) + 1):
            token = ids.get(data[:i])
            if token is not None and self.whole(token):
                states[data[:i]] = 1 << 20 | token
                continue
            for j in range(1, i):
                token = ids.get(data[j:i])
                if token is None:
                    continue
                before = states[data[:j]]
                pair = (before & 0xFFFFF, token)
                ok = fits.get(pair)
                if self.compatible(*pair) if ok is None else ok:
                    states[data[:i]] = (before >> 20) + 1 << 20 | token
                    break
        return states[data]

    def _segments(self, text: str) -> list[tuple[bool, str]]:
        if self.special is None or not self.special.search(text):
            return [(False, text)] if text else []
        return [(bool(n % 2), x) for n, x in enumerate(self.special.split(text)) if x]

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        total, known = 0, self.known.get
        for is_special, part in self._segments(text):
            if is_special:
                total += 1
                continue
            pieces = self.piece.findall(part)
            counts = list(map(known, pieces))
            if None in counts:
                counts = [self._count(p) if n is None else n for p, n in zip(pieces, counts)]
            total += sum(counts)
        return total

    def table(self, text: str) -> list[int]:
        """Exact token count of text[:i] for every i = 0 .. len(text) (code points)."""
        out, base = [0], 0
        for is_special, part in self._segments(text):
            if is_special:  # a cut special string is ordinary text, joined to what precedes it
                start = self._before_special(text, len(out) - 1)
                done = len(out) - 1
                fixed = base - self.count(text[start:done])
                out += [fixed + self.count(text[start : done + n]) for n in range(1, len(part))] + [base + 1]
                base += 1
                continue
            base = self._table_of_segment(part, base, out)
        return out

    def _before_special(self, text: str, end: int) -> int:
        stops = [m.end() for m in self.special.finditer(text[:end])]
        return stops[-1] if stops else 0

    def _table_of_segment(self, part: str, base: int, out: list[int]) -> int:
        blank_from, blank_base = None, 0
        for m in self.piece.finditer(part):
            piece = m[0]
            counts = self.prefixes(piece.encode())
            at = 0
            for n, letter in enumerate(piece, 1):
                at += len(letter.encode())
                if letter.isspace():  # a prefix that ends in white space ends in one whole run of it
                    if blank_from is None:
                        blank_from, blank_base = m.start() + n - 1, out[-1]
                    out.append(blank_base + self.prefixes(part[blank_from : m.start() + n].encode())[-1])
                    continue
                blank_from = None
                if piece[0] == "'" and 1 < n < len(piece):  # a cut contraction is two pieces
                    out.append(base + self.count(piece[:n]))
                else:
                    out.append(base + counts[at])
            base += counts[-1]
        return base

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        found = self.table(text)
        return max(i for i, n in enumerate(found) if n <= budget) if budget >= 0 else 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    ``tokenizer`` is the path of the vocabulary file on the workers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in kernels.small_batches(batches, "text"):
            texts = kernels.text_bytes(batch.column("text"))
            found = [count(x.decode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_tables(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts: the token count of every prefix, for later budget look-ups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(tokenizer).table
        for batch in kernels.small_batches(batches, "text", 1 << 20):
            found = [table(x.decode()) for x in kernels.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, counts array<long>")
