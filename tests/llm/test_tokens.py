import json
import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import queries, tokens

from .fixtures import AWKWARD, DATA, documents

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op9_token_counts(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_awkward_rows(spark, library):
    rows = AWKWARD + [(9, "a<|endoftext|>b <|endoftext", "s")]
    got = tokens.token_counts(documents(spark, rows), PATH).collect()
    want = sorted((len(library.encode(t or "", add_special_tokens=False).ids)) for _, t, _ in rows)
    assert sorted(r.n_tokens for r in got) == want
    assert tokens.token_counts(documents(spark, []), PATH).count() == 0


def test_every_prefix(library):
    rng = random.Random(3)
    counter = tokens.PrefixCounter(PATH)
    for _ in range(400):
        text = "".join(rng.choice("ab 'é中  \n\t19$|<>restvdml") for _ in range(rng.randint(0, 24)))
        if rng.random() < 0.3:
            at = rng.randint(0, len(text))
            text = text[:at] + "<|endoftext|>" + text[at:]
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.table(text) == want
        budget = rng.randint(0, 12)
        assert counter.fitting(text, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_prefix_tables(spark, library):
    got = tokens.prefix_tables(documents(spark, [(1, "It's here", "s"), (2, None, "s")]), PATH).collect()
    assert {r.doc_id: r.counts for r in got} == {1: [len(library.encode("It's here"[:i]).ids) for i in range(10)], 2: [0]}


def test_other_kinds_of_vocabulary_are_refused():
    spec = json.loads(Path(PATH).read_text(encoding="utf-8"))
    tokens._must_be_plain(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "byte_fallback": True}}, {"added_tokens": [{"content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError, match=next(iter(change))):
            tokens._must_be_plain({**spec, **change})
