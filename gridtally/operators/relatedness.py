"""Relatedness of pairs of samples from genotype likelihoods.

A site's likelihood under each number of alleles that two outbred samples share by descent (0, 1 or 2) is a sum over their
genotypes. The shares k0, k1, k2 of the genome are the weights of that mixture, found by expectation-maximisation: each
round is one aggregation over all sites of the pairs that aren't settled, of the posteriors and of the curvature. The curvature's
step replaces the plain M-step while it raises the likelihood; else the plain one, which always does, follows.
A pair is settled when its residual, by how much the largest mean posterior ratio exceeds 1, is within TOLERANCE. theta is
k1 / 4 + k2 / 2, rab is k1 / 2 + k2.

The sites of a pair are a join of its samples' calls. A pair of up to BLOCK of them is one row with a matrix, and goes through its
rounds where that row is. Those of a longer pair lie in blocks of about BLOCK by a hash, so that it is many tasks and a round shuffles
some numbers a block; weights of up to BROADCAST_PAIRS such pairs are broadcast, more are joined.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtally.session import checkpointed

BLOCK = 4096
TOLERANCE = 1e-9
BROADCAST_PAIRS = 50_000
#: Short pairs of a task, about.
PAIRS_A_TASK = 1024
#: The sets of states that may have weight.
SUPPORTS = [list(s) for n in (1, 2, 3) for s in itertools.combinations(range(3), n)]
UPPER = np.triu_indices(3)


def allele_frequencies(likelihoods: DataFrame) -> DataFrame:
    """(site, freq): the mean expected dosage of (sample, site, g0, g1, g2) over 2, each genotype being equally likely before."""
    whole = F.col("g0") + F.col("g1") + F.col("g2")
    dosage = F.when(whole > 0, (F.col("g1") + 2 * F.col("g2")) / whole)
    return likelihoods.groupBy("site").agg((F.sum(dosage.cast("decimal(20,12)")).cast("double") / F.count(dosage) / 2).alias("freq")).filter("freq is not null")


def state_likelihoods(a: str, b: str, freq: Column) -> list[Column]:
    """A site's likelihood where 0, 1 or 2 alleles are shared, from two samples' structs of g0, g1 and g2."""
    p, q = freq, 1 - freq
    single = [q * q, 2 * p * q, p * p]
    x, y = ([F.col(f"{s}.g{i}") for i in range(3)] for s in (a, b))
    total = lambda parts: parts[0] + parts[1] + parts[2]
    none = total([g * s for g, s in zip(x, single)]) * total([g * s for g, s in zip(y, single)])
    both = total([g * h * s for g, h, s in zip(x, y, single)])
    # one shared allele: it is drawn once, the other of each sample by itself
    of = lambda g, shared: g[shared] * q + g[shared + 1] * p
    one = q * of(x, 0) * of(y, 0) + p * of(x, 1) * of(y, 1)
    return [none, one, both]


def moments(rows: np.ndarray, lengths: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each matrix of lengths rows, at its weights w: the log-likelihood, its gradient and its negative curvature's upper half."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        m = (rows * np.repeat(w, lengths, axis=0)).sum(axis=1)
        ratio = rows / m[:, None]
        parts = np.column_stack([np.log(m), ratio, ratio[:, UPPER[0]] * ratio[:, UPPER[1]]])
        return np.add.reduceat(parts, np.cumsum(lengths) - lengths)


def best_weights(gradient: np.ndarray, curve: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each pair the weights, at least 0 and of sum 1, that maximise the quadratic model of the log-likelihood about w."""
    c = gradient + (curve @ w[:, :, None])[:, :, 0]
    best, most = w.copy(), np.full(len(w), -np.inf)
    for s in SUPPORTS:
        n = len(s)
        system = np.ones((len(w), n + 1, n + 1))
        system[:, :n, :n], system[:, n, n] = curve[:, s][:, :, s], 0
        right = np.column_stack([c[:, s], np.ones(len(w))])
        x = np.zeros_like(w)
        x[:, s] = (np.linalg.pinv(system, rcond=(n + 1) * np.finfo(float).eps) @ right[:, :, None])[:, :n, 0]
        value = (c * x).sum(axis=1) - (x * (curve @ x[:, :, None])[:, :, 0]).sum(axis=1) / 2
        better = (x.min(axis=1) >= -1e-12) & (np.abs(x.sum(axis=1) - 1) < 1e-6) & (value > most)
        x = np.maximum(x[better], 0)
        best[better], most[better] = x / x.sum(axis=1)[:, None], value[better]
    return best


def advance(n: np.ndarray, w: np.ndarray, plain: np.ndarray, before: np.ndarray, sums: np.ndarray) -> tuple:
    """The next (w, plain, before, residual) of pairs: settled, stepped on, or back to the plain M-step of the round before."""
    ll, gradient = sums[:, 0], sums[:, 1:4]
    curve = np.empty((len(n), 3, 3))
    curve[:, UPPER[0], UPPER[1]] = curve[:, UPPER[1], UPPER[0]] = sums[:, 4:]
    back = ~np.isfinite(sums[:, 1:]).all(axis=1) | (ll < before - 1e-10 * n)
    residual = np.where(back, np.inf, gradient.max(axis=1) / n - 1)
    go = ~back & ~(residual <= TOLERANCE)
    to, by = np.where(back[:, None], plain, w), np.where(back[:, None], plain, w)
    to[go], by[go] = best_weights(gradient[go], curve[go], w[go]), (w * gradient / n[:, None])[go]
    return to, by, np.where(back, before, ll), residual


def settle(rows: np.ndarray, lengths: np.ndarray, rounds: int) -> tuple:
    """(w, log-likelihood, residual) of pairs whose sites are all here, after at most so many rounds."""
    w = np.full((len(lengths), 3), 1 / 3)
    plain, before, residual = w.copy(), np.full(len(w), -np.inf), np.full(len(w), np.inf)
    at, n = np.arange(len(w)), lengths
    for _ in range(rounds):
        if not len(at):
            break
        w[at], plain[at], before[at], residual[at] = advance(n, w[at], plain[at], before[at], moments(rows, n, w[at]))
        open_ = ~(residual[at] <= TOLERANCE)
        rows, at, n = rows[np.repeat(open_, n)], at[open_], n[open_]
    return w, before, residual


def _matrices(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all matrices, and how many each has."""
    lengths = column.map(len).to_numpy() // 3
    return np.concatenate(column.to_numpy()).reshape(-1, 3), lengths


def _pair_blocks(likelihoods: DataFrame, freqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n, block, rows): the likelihoods of a pair's n sites as a flat matrix, or as one for each of its blocks."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sample")).distinct()
    genotypes = F.struct(*(F.col(c).cast("double").alias(c) for c in ("g0", "g1", "g2")))
    known = likelihoods.filter("g0 + g1 + g2 > 0").join(asked, "sample", "left_semi").groupBy("sample", "site").agg(F.min(genotypes).alias("g"))
    one, two = (known.select(F.col("sample").alias(k), "site", F.col("g").alias(f"of_{k}")) for k in "ab")
    usable = freqs.filter("freq between 0 and 1").groupBy("site").agg(F.min(F.col("freq").cast("double")).alias("freq"))
    both = one.join(pairs, "a").join(two, ["b", "site"]).join(usable, "site")
    states = F.array(*state_likelihoods("of_a", "of_b", F.col("freq"))).alias("states")
    # sites whose likelihoods a frequency of 0 or 1 rules out say nothing
    sites = checkpointed(both.select("a", "b", "site", states).filter(F.nanvl(F.get("states", F.lit(0)), F.lit(0.0)) > 0))
    sizes = sites.groupBy("a", "b").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("site"), F.ceil(F.col("n") / BLOCK)).alias("block")
    return sites.join(sizes, ["a", "b"]).groupBy("a", "b", "n", block).agg(F.flatten(F.sort_array(F.collect_list("states"))).alias("rows"))


def relatedness(likelihoods: DataFrame, freqs: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(a, b, n_sites, k0, k1, k2, theta, rab, log_likelihood, residual) for each pair (a, b), from (sample, site, g0, g1, g2) and (site, freq).

    Rows that repeat a sample and site count once, the least of them. Sites are those that both samples have and that have a
    frequency; a pair without any has a row with n_sites 0 and nulls. Where a pair isn't settled after `rounds`, it raises.
    """
    pairs = checkpointed(pairs.select("a", "b").filter("a is not null and b is not null").distinct())
    blocks = checkpointed(_pair_blocks(likelihoods, freqs, pairs))
    keys = [pairs.schema["a"], pairs.schema["b"]]
    sums = [T.StructField(f"m{i}", T.DoubleType()) for i in range(10)]
    third = F.array(*[F.lit(1 / 3)] * 3)
    short, sites = blocks.filter(F.col("n") <= BLOCK), blocks.filter(F.col("n") > BLOCK)
    state = sites.select("a", "b", "n").distinct().withColumns({"w": third, "plain": third, "before": F.lit(float("-inf")), "residual": F.lit(float("inf"))})
    state = checkpointed(state)

    def alone(batches):
        for batch in batches:
            if len(batch):
                w, ll, residual = settle(*_matrices(batch["rows"]), rounds)
                yield batch[["a", "b", "n"]].assign(w=list(w), plain=list(w), before=ll, residual=residual)

    def measure(batches):
        for batch in batches:
            if len(batch):
                rows = moments(*_matrices(batch["rows"]), np.stack(batch["w"]))
                yield pd.concat([batch[["a", "b"]], pd.DataFrame(rows, columns=[s.name for s in sums], index=batch.index)], axis=1)

    def step(batches):
        for batch in batches:
            if len(batch):
                w, plain, before, residual = advance(batch["n"].to_numpy(), np.stack(batch["w"]), np.stack(batch["plain"]), batch["before"].to_numpy(), batch[[s.name for s in sums]].to_numpy())
                yield batch[["a", "b", "n"]].assign(w=list(w), plain=list(plain), before=before, residual=residual)

    tasks = max(1, math.ceil(pairs.count() / PAIRS_A_TASK))
    first = checkpointed(short.select("a", "b", "n", "rows").repartition(tasks, "a", "b").mapInPandas(alone, state.schema))
    settled = [first.filter(F.col("residual") <= TOLERANCE)]
    if left := first.filter(F.col("residual") > TOLERANCE).count():
        raise RuntimeError(f"{left} pairs aren't settled after {rounds} rounds")
    open_ = state.count()
    for _ in range(rounds):
        if open_ == 0:
            break
        weights = state.select("a", "b", "w")
        held = sites.join(F.broadcast(weights) if open_ <= BROADCAST_PAIRS else weights, ["a", "b"])
        measured = held.select("a", "b", "rows", "w").mapInPandas(measure, T.StructType([*keys, *sums]))
        total = measured.groupBy("a", "b").agg(*(F.sum(s.name).alias(s.name) for s in sums))
        moved = checkpointed(state.join(total, ["a", "b"]).mapInPandas(step, state.schema))
        settled.append(moved.filter(F.col("residual") <= TOLERANCE))
        state = moved.filter(F.col("residual") > TOLERANCE)
        open_ = state.count()
    if open_:
        raise RuntimeError(f"{open_} pairs aren't settled after {rounds} rounds")
    done = state
    for part in settled:
        done = done.unionByName(part)
    k = [F.get("w", i) for i in range(3)]
    out = pairs.join(done, ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("n", F.lit(0).cast("long")).alias("n_sites"), *(c.alias(f"k{i}") for i, c in enumerate(k)), (k[1] / 4 + k[2] / 2).alias("theta"), (k[1] / 2 + k[2]).alias("rab"), F.when(F.col("n") > 0, F.col("before")).alias("log_likelihood"), "residual")
