import bisect
import hashlib
import random
from collections import Counter
from itertools import groupby

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm import align, queries
from brindle.llm.tokens import _byte_letters

from .fixtures import AWKWARD, DATA, documents

FILES = tuple(str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LETTERS = _byte_letters()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def tokens(libraries, text):
    """(id, bytes) of either side, both empty if they do not give the text back."""
    a, b = libraries
    if not text:
        return [], []
    one = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])


def ends(found):
    at, out = 0, []
    for i, data in found:
        at += len(data)
        out.append((at, i))
    return out


def brute(libraries, rows):
    cut = []
    for doc_id, text in rows:
        a, b = map(ends, tokens(libraries, text))
        common = sorted({e for e, _ in a} & {e for e, _ in b})
        at = dict(b)  # no token is empty, so no two of a side end together
        links = [(i, at[e]) for e, i in a if e in at]
        owner = lambda e: common[bisect.bisect_left(common, e)]
        parts = [{k: [str(i) for _, i in v] for k, v in groupby(side, key=lambda x: owner(x[0]))} for side in (a, b)]
        told = ";".join(f"{','.join(parts[0][c])}|{','.join(parts[1][c])}" for c in common)
        cut.append((doc_id, a, b, common, links, told))
    counts = Counter(link for c in cut for link in c[4])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(
        (
            (d, len(a), len(b), len(common), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if common else "")
            for d, a, b, common, links, told in cut
        ),
        key=repr,
    )


def test_whole_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, DATA).collect()), key=repr) == brute(libraries, rows)


ODD = ["a  b", " lead", "trail ", "\n\nx \n y z　w", "<|endoftext|> and <s> </s> <unk> <0x41>", "literal ▁ sign", "it's we'll 've", "\x00\x01 \x85 \x1c q", "中文 \U0001f600 é", ".", " ", "   ", "� known"]


def test_awkward_rows_and_both_joins(spark, libraries):
    rows = AWKWARD + [(100 + n, t, "s") for n, t in enumerate(ODD)]
    want = brute(libraries, [r[:2] for r in rows])
    assert dict((r[0], r[1]) for r in want)[105] == 0  # its bytes are not given back
    for most in (align.MOST_PAIRS, 0):
        assert sorted(map(tuple, align.digest(documents(spark, rows), FILES, most).collect()), key=repr) == want
    assert align.digest(documents(spark, []), FILES).count() == 0


def test_units_encode_as_whole_texts(libraries):
    rng = random.Random(1)
    held = align.Units(*map(align.encoder, FILES))
    texts = ["".join(rng.choice(["ab", "The", " ", " ", "\n", "'s", "é", "中", "19", ".", ",", "\t", "x "]) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    parts = [held.encode(texts[n : n + 50]) for n in range(0, 600, 50)]
    for number, side in enumerate(held.sides):
        assert [g.tolist() for p in parts for g in p[number]] == side.of.encode([" " + t for t in texts])


def test_groups_and_small_runs(spark, libraries, monkeypatch):
    monkeypatch.setattr(align, "RUN", 7)
    text = "Some words, then ümläute and 中文 in one text. " * 6
    rows = align.numbered(documents(spark, [(1, text, "s"), (2, None, "s"), (3, "x", "s")]))
    events = align.sorted_events(align.end_events(rows, {0: FILES[0]}).unionAll(align.end_events(rows, {1: FILES[1]})))
    got = [r for r in align.groups(events, FILES).orderBy("row", "end").collect() if r.doc_id == 1]
    data = (" " + text).encode()
    left, right = tokens(libraries, text)
    assert got[0].start == 0 and got[-1].end == len(data) and all(x.end == y.start for x, y in zip(got, got[1:]))
    assert [i for r in got for i in r.a_ids] == [i for i, _ in left] and [i for r in got for i in r.b_ids] == [i for i, _ in right]
    # the machine passes what both sides have reached, whatever the runs
    made = events.toArrow().to_batches()
    cuts = [c for c in align.sweep(iter(made), align.units(FILES)) if c.doc_id == 1]
    assert cuts[-1].last and sum(len(c.ends) for c in cuts) == len(got)
