"""Exact and near duplicates of records with provenance.

Exact: records with one content hash merge into the first (by sequence), across languages.
Near: within a language, short texts by shingle similarity and long ones by SimHash distance;
candidates come from an exact index (three equal blocks of nine for at most six differing bits;
shared rare shingles for the similarity), so no pair is missed.  The merge is greedy in sequence
order, decided in rounds over all linked records at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut
from ..shipping import map_pandas

SHORT, JACCARD, RADIUS, LONGER = 80, 0.82, 6, 1.25
#: Blocks of a signature, and how many of them agree when at most RADIUS bits differ.
BLOCKS, EQUAL = 9, 3


def exact_groups(records: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """Every record with its content hash, the surviving record's sequence, and the group's size."""
    group = W.partitionBy("hash")
    return records.withColumn("hash", key).withColumns({"survivor": F.min(seq).over(group), "copies": F.count("*").over(group)})


def _grams(text: str) -> tuple[int, list[str]]:
    tokens = re.findall("[a-z0-9]+", text.lower())
    return len(tokens), [" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)] or ([" ".join(tokens)] if tokens else [])


def _signature(grams: list[str]) -> tuple[int, int]:
    if not grams:
        return 0, 0
    low = np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[8:] for g in grams), np.uint8).reshape(-1, 8)
    bits = 2 * np.unpackbits(low, axis=1).sum(axis=0, dtype=np.int64) > len(grams)
    return tuple(int.from_bytes(np.packbits(half).tobytes(), "big") for half in (bits[:32], bits[32:]))


def signatures(records: DataFrame, seq: str = "seq", text: str = "text") -> DataFrame:
    """seq and the SimHash of four-word shingles as two 32-bit halves (zero without shingles).

    A bit is the majority over the low 64 bits of each shingle's MD5.  Votes are counted where the
    text is, so nothing is shuffled; 64 conditional sums over exploded shingles took about twice as long.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_signature(_grams(t)[1]) for t in pdf["text"].fillna("")]
            yield pd.DataFrame({"seq": pdf["seq"], "sig_hi": [h for h, _ in found], "sig_lo": [l for _, l in found]})

    rows = records.select(F.col(seq).cast("long").alias("seq"), F.col(text).cast("string").alias("text"))
    return map_pandas(rows, run, "seq long, sig_hi long, sig_lo long")


def read_texts(records: DataFrame, most: float = (SHORT - 4) / JACCARD) -> DataFrame:
    """seq, language, n_tokens, sig (SimHash) of texts that are not short, and grams (distinct shingles, null beyond ``most``).

    Each text is tokenised once.  A set similar to a short text's cannot be larger than ``most``.  In
    Python, because a filter on the column form is pushed below it and re-tokenises the text for every shingle.
    """
    def one(text: str) -> tuple:
        n, grams = _grams(text)
        sets = sorted(set(grams))
        hi, lo = _signature(grams) if n >= SHORT else (0, 0)
        sig = (hi << 32 | lo) - ((hi >> 31) << 64)
        return n, sig if n >= SHORT else None, sets if len(sets) <= most else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, sig, sets = zip(*map(one, pdf["text"].fillna(""))) if len(pdf) else ((), (), ())
            yield pd.DataFrame({"seq": pdf["seq"], "language": pdf["language"], "n_tokens": n, "sig": pd.array(sig, "Int64"), "grams": sets})

    return map_pandas(records.select("seq", "language", "text"), run, "seq long, language string, n_tokens long, sig long, grams array<string>")


def _keys(sig: str) -> Column:
    """The signature's keys: every three of its nine blocks, 21 bits or 22, under the number of the three."""
    edges = [0, 8, 15, 22, 29, 36, 43, 50, 57, 64]
    cuts = [(lo, (1 << (hi - lo)) - 1, hi - lo) for lo, hi in zip(edges, edges[1:])]
    blocks = [F.shiftrightunsigned(sig, lo).bitwiseAND(F.lit(mask).cast("long")) for lo, mask, _ in cuts]
    out = []
    for n, three in enumerate(combinations(range(BLOCKS), EQUAL)):
        key = F.lit(n).cast("long")
        for b in three:
            key = F.shiftleft(key, cuts[b][2]).bitwiseOR(blocks[b])
        out.append(key)
    return F.array(*out)


def indexed_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, distance), a < b, of one language within RADIUS bits; rows have seq, language, sig.

    Six differing bits leave three of nine blocks equal, so the 84 keys of three blocks together miss no
    pair; a key's 21 bits keep its bucket at a two-millionth of the rows, and the pairs met in proportion.
    Keys are joined for distinct signatures only: however many records share one, they meet once.
    """
    members = rows.select("seq", "language", "sig")
    keyed = members.select("language", "sig").distinct().withColumn("key", F.explode(_keys("sig")))
    left = keyed.select("language", F.col("sig").alias("sa"), "key")
    right = keyed.select("language", F.col("sig").alias("sb"), "key")
    distance = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))).cast("int")
    near = left.join(right, ["language", "key"]).filter((F.col("sa") < F.col("sb")) & (distance <= RADIUS)).drop("key").distinct()
    same = members.groupBy("language", F.col("sig").alias("sa")).agg(F.count("*").alias("n")).filter("n > 1").select("language", "sa", F.col("sa").alias("sb"))
    met = near.unionByName(same).withColumn("distance", distance)
    met = met.join(members.select("language", F.col("sig").alias("sa"), F.col("seq").alias("x")), ["language", "sa"])
    met = met.join(members.select("language", F.col("sig").alias("sb"), F.col("seq").alias("y")), ["language", "sb"])
    met = met.filter((F.col("x") < F.col("y")) | (F.col("x") > F.col("y")) & (F.col("sa") != F.col("sb")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()


def shingle_pairs(rows: DataFrame, threshold: float = JACCARD) -> DataFrame:
    """Pairs (a, b), a < b, of one language with set similarity of ``threshold`` or more where one is short.

    rows: seq, language, n_tokens, grams (distinct shingles).  Two sets that similar share one of
    their rarest few shingles (prefix filter), so only those are joined on.
    """
    rows = rows.filter("grams is not null")
    long = rows.select("seq", "language", "n_tokens", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    seen = long.groupBy("language", "gram").agg(F.count("*").alias("seen")).filter("seen > 1")
    order = F.row_number().over(W.partitionBy("seq").orderBy("seen", "gram"))
    # shingles of one text only come first in that order, so they shorten the prefix that is left
    alone = F.col("n") - F.count("*").over(W.partitionBy("seq"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold) + 1 - alone
    prefix = long.join(seen, ["language", "gram"]).withColumn("nth", order).withColumn("keep", keep).filter("nth <= keep")
    prefix = prefix.select("seq", "language", "n_tokens", "gram")
    l, r = prefix.alias("l"), prefix.alias("r")
    on = (F.col("l.language") == F.col("r.language")) & (F.col("l.gram") == F.col("r.gram")) & (F.col("l.seq") < F.col("r.seq"))
    some = l.join(r, on).filter(F.least("l.n_tokens", "r.n_tokens") < SHORT).select(F.col("l.seq").alias("a"), F.col("r.seq").alias("b")).distinct()
    sets = rows.select("seq", "grams")
    pairs = some.join(sets.select(F.col("seq").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("seq").alias("b"), F.col("grams").alias("gb")), "b")
    pairs = pairs.select("a", "b", T.jaccard(F.col("ga"), F.col("gb")).alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold)


def near_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, distance) under the near-duplicate rule; rows: seq, language, text."""
    told = cut(read_texts(rows))
    # the index serves both branches: the rule itself looks at the shorter text
    short = shingle_pairs(told).select("a", "b", F.round((1 - F.col("similarity")) * 100).cast("int").alias("distance"))
    return short.unionByName(indexed_pairs(told.filter("sig is not null")))


def greedy_merge(pairs: DataFrame, rounds: int = 10_000) -> DataFrame:
    """seq and survivor of every linked record: in order, each joins the first survivor it is linked to.

    Decided in rounds over all records at once: one with a survivor before it among its links is merged,
    one whose earlier links are all merged survives.  A round decides the first open record of every
    component at least, and in groups of copies nearly all.
    """
    links = cut(pairs.select("a", "b").distinct())
    nodes = links.select(F.col("a").alias("seq")).union(links.select("b")).distinct()
    state = cut(nodes.join(links.select(F.col("b").alias("seq")).distinct().withColumn("later", F.lit(True)), "seq", "left").select("seq", F.when(F.col("later"), "open").otherwise("kept").alias("state")))
    for _ in range(rounds):
        if state.filter("state = 'open'").isEmpty():
            break
        before = links.join(state.select(F.col("seq").alias("a"), F.col("state").alias("before")), "a")
        before = before.join(state.filter("state = 'open'").select(F.col("seq").alias("b")), "b", "left_semi")
        met = before.groupBy(F.col("b").alias("seq")).agg(F.max(F.col("before") == "kept").alias("kept"), F.max(F.col("before") == "open").alias("open"))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("kept"), "merged").when(F.col("open"), "open").otherwise("kept")
        state = cut(state.join(met, "seq", "left").select("seq", new.alias("state")))
    else:
        raise RuntimeError(f"merges not settled after {rounds} rounds")
    kept = state.filter("state = 'kept'").select(F.col("seq").alias("a"))
    first = links.join(kept, "a").groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("first"))
    return state.join(first, "seq", "left").select("seq", F.when(F.col("state") == "kept", F.col("seq")).otherwise(F.col("first")).alias("survivor"))


def merge_near(records: DataFrame) -> DataFrame:
    """Near-merged records (seq, language, text): survivor, merged_from (in order) and the text kept.

    A newcomer over 1.25 times as long as the survivor's text replaces it, payload and all.  Texts stay out
    of the fold, which needs their lengths alone.
    """
    merged = greedy_merge(near_pairs(records))
    sizes = records.select("seq", F.length("text").alias("n")).join(merged, "seq", "left").withColumn("survivor", F.coalesce("survivor", "seq"))
    group = sizes.groupBy("survivor").agg(F.array_sort(F.collect_list(F.struct("seq", "n"))).alias("all"))
    rest = F.slice("all", 2, F.size("all"))
    kept = F.aggregate(rest, F.get("all", F.lit(0)), lambda acc, x: F.when(x["n"] > acc["n"] * LONGER, x).otherwise(acc))
    chosen = group.select("survivor", F.transform(rest, lambda x: x["seq"]).alias("merged_from"), kept["seq"].alias("text_from"))
    return chosen.join(records.select(F.col("seq").alias("text_from"), "text"), "text_from").select("survivor", "merged_from", "text_from", "text")
