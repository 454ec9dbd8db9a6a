"""Mixing sources to target shares of all tokens, by balanced sampling with the cube method.

Every document of a source gets the same expected number of copies. Its whole copies are certain; the fraction left is an inclusion probability, and the
probabilities of each source move through the null space of two constraints - tokens and documents of the source - until all but two are 0 or 1 (the flight).
Flights run in bounded groups of documents side by side; what they leave flies again, and the last one or two documents of a source are rounded (the landing).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.lineage import cut

#: Ranks of the byte-pair tokenizer that sizes are counted with.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that tokenizer splits a text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this are counted piece by piece, between two tokens.
PIECE = 100_000
#: Most documents that fly together.
GROUP = 20_000
SEED = 17
_CLEFT = re.compile(r"(?<=\S) (?=\S)")


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces that begin where a token of the pattern begins."""
    begin = 0
    while len(text) - begin > PIECE and (m := _CLEFT.search(text, begin + PIECE)):
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a string column; null and empty texts have none. The tokenizer's file (under 1 MB) is read once and broadcast."""
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for series in batches:
            yield pd.Series([sum(len(coder.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in series], dtype="int64")

    return count.asNondeterministic()(F.col(text))


@dataclass(frozen=True)
class Quota:
    """What a source gives to the mix: ``copies`` is the expected number of copies of each of its documents."""

    source: str
    target_share: float
    max_repeats: int
    documents: int
    tokens: int
    copies: float

    @property
    def planned(self) -> float:
        return self.copies * self.tokens


def quotas(targets: list[tuple[str, float, int]], sizes: dict[str, tuple[int, int]], total: int | None = None) -> list[Quota]:
    """Expected copies by source, for a mix of ``total`` tokens (by default as many as the listed sources have).

    A source gives at most ``max_repeats`` times its tokens. What sources at that limit cannot give is given by the others, in proportion to their targets,
    so every share is its target unless a limit forbids it. Sources without documents give nothing.
    """
    limit = {s: sizes.get(s, (0, 0))[1] * max(0, r or 0) for s, _, r in targets}
    want = {s: max(0.0, t or 0.0) for s, t, _ in targets}
    goal = float(sum(sizes.get(s, (0, 0))[1] for s in want) if total is None else total)
    goal = min(goal, float(sum(limit[s] for s in want if want[s] > 0)))
    given: dict[str, float] = {}
    open_ = {s for s in want if want[s] > 0}
    while open_:
        left, weight = goal - sum(given.values()), sum(want[s] for s in open_)
        full = {s for s in open_ if left * want[s] / weight >= limit[s]}
        if not full:
            given |= {s: left * want[s] / weight for s in open_}
            break
        given |= {s: float(limit[s]) for s in full}
        open_ -= full
    out = []
    for s, t, r in targets:
        n, tokens = sizes.get(s, (0, 0))
        out.append(Quota(s, t, r, n, tokens, min(float(r or 0), given.get(s, 0.0) / tokens) if tokens else 0.0))
    return out


def fly(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight: their sum and their sum weighted by size are what they were, and at most two lie between 0 and 1."""
    p = chances.astype(float).tolist()
    x = sizes.astype(float).tolist()
    eps = 1e-9
    draws = rng.random(len(p) + 8).tolist()
    waiting = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    waiting.reverse()
    held: list[int] = []
    d = 0
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 2 or len(held) == 2 and x[held[0]] != x[held[1]]:
            break
        if len(held) == 2:
            u = [1.0, -1.0]
        else:
            a, b, c = (x[i] for i in held)
            u = [b - c, c - a, a - b]  # orthogonal to the sizes and to (1, 1, 1)
            if not any(u):
                u = [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u) if v)
        step = up if draws[d % len(draws)] * (up + down) < down else -down
        d += 1
        for i, v in zip(held, u):
            p[i] = min(1.0, max(0.0, p[i] + step * v))
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = float(round(p[i]))
        held = [i for i in held if 0 < p[i] < 1]
    return np.array(p)


def land(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """The last one or two documents rounded so that the tokens come nearest to what they should be; ties keep more documents out."""
    p = chances.copy()
    loose = [i for i in range(len(p)) if 0 < p[i] < 1]
    if not loose:
        return p
    should = sum(p[i] * sizes[i] for i in loose)
    best = min(range(1 << len(loose)), key=lambda bits: (abs(sum(sizes[i] for k, i in enumerate(loose) if bits >> k & 1) - should), bits))
    for k, i in enumerate(loose):
        p[i] = float(best >> k & 1)
    return p


def _flight(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id"], kind="stable")
        first = group.iloc[0]
        rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{SEED}\0{first['source']}\0{first['bucket']}\0{len(group)}"))
        sizes = group["n_tokens"].to_numpy()
        p = fly(sizes, group["chance"].to_numpy(), rng)
        return group.assign(chance=land(sizes, p) if last else p)

    return run


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The selection and the shares.

    Selection: ``(doc_id, source, n_tokens, copies)`` for every document that is used at least once. Shares: ``(source, target_share, max_repeats,
    available_documents, available_tokens, selected_documents, selected_copies, selected_tokens, actual_share)`` for every listed source.

    Documents without text, of no source or of a source that is not listed are not used. Repeated rows are documents of their own. ``targets`` is the list of
    sources; it is read by the driver.
    """
    listed = [(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).collect()]
    spark = documents.sparkSession
    names = spark.createDataFrame([(s,) for s, *_ in listed], "source string") if listed else spark.createDataFrame([], "source string")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").where(F.col("text") != "").join(F.broadcast(names), "source", "left_semi")
    sized = cut(base.select("doc_id", "source", token_counts(base, "text", tokenizer).alias("n_tokens")).where("n_tokens > 0"))
    sizes = {r.source: (r.n, r.t) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    plan = quotas(listed, sizes, total)
    per_source = spark.createDataFrame([(q.source, int(q.copies), q.copies - int(q.copies), ceil(q.documents / GROUP)) for q in plan], "source string, whole int, chance double, buckets int")
    order = F.xxhash64("doc_id", "n_tokens", F.lit(SEED))
    flying = sized.join(F.broadcast(per_source), "source").withColumn("order", order)
    certain = flying.where("chance < 1e-9 OR chance > 1 - 1e-9").select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("chance")).cast("int").alias("copies"))
    open_ = flying.where("chance >= 1e-9 AND chance <= 1 - 1e-9").withColumn("bucket", F.pmod(F.col("order"), F.greatest(F.col("buckets"), F.lit(1))).cast("int"))
    schema = "doc_id long, source string, n_tokens long, whole int, order long, bucket int, chance double"
    columns = ["doc_id", "source", "n_tokens", "whole", "order", "bucket", "chance"]
    most = max([q.documents for q in plan], default=0)
    settled = None
    # the groups of each level leave at most two documents each; the level with one group per source lands them
    while True:
        last = most <= GROUP
        if last:
            open_ = open_.withColumn("bucket", F.lit(0))
        flown = cut(open_.select(columns).groupBy("source", "bucket").applyInPandas(_flight(last), schema))
        done = flown if last else flown.where("chance <= 0 OR chance >= 1")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        most = 2 * ceil(most / GROUP)
        open_ = flown.where("chance > 0 AND chance < 1").withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(ceil(most / GROUP))).cast("int"))
    chosen = certain.unionByName(settled.select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("chance")).cast("int").alias("copies")))
    selection = chosen.where("copies > 0")
    used = selection.groupBy("source").agg(
        F.count(F.lit(1)).alias("selected_documents"), F.sum("copies").cast("long").alias("selected_copies"), F.sum(F.col("copies") * F.col("n_tokens")).cast("long").alias("selected_tokens")
    )
    known = spark.createDataFrame([(q.source, q.target_share, q.max_repeats, q.documents, q.tokens) for q in plan], "source string, target_share double, max_repeats int, available_documents long, available_tokens long")
    counted = known.join(used, "source", "left").na.fill(0, ["selected_documents", "selected_copies", "selected_tokens"])
    everything = counted.agg(F.sum("selected_tokens").alias("all_tokens"))
    shares = counted.crossJoin(F.broadcast(everything)).withColumn("actual_share", F.coalesce(F.try_divide(F.col("selected_tokens"), F.col("all_tokens")), F.lit(0.0))).drop("all_tokens")
    return selection, shares
