"""Operator 10: toxic spans by a linear-chain conditional random field.

Documents carry labels, not tokens, so tokens are labelled from them: a token of a toxic sample
document is toxic if one of its features (the word, its first four and its first five bytes) is
met in toxic documents far more often than in others. On these tokens a two-state linear chain
is fitted by gradient ascent on its conditional likelihood. Forward-backward gives each token's
marginal; a document's score is a logistic function of its greatest marginal and of its expected
toxic tokens, fitted on the other half of the sample; tokens with a marginal of a half or more
are the offending offsets.

The sample: at most SAMPLE_ROWS labelled rows of either label, the least by a hash of their id,
of at most SAMPLE_CHARS characters, and for the chain SAMPLE_PIECES pieces of PIECE tokens; only rows that may be learnt from. Scoring reads whole texts,
in the tasks that read the rows; nothing is shuffled.

Defined cases: null and empty texts have no tokens and get the score of no evidence; without
usable labels of both kinds every score is 0; a label that is null or neither 0 nor 1 is ignored;
repeated rows give repeated results; extra columns are not read (filter keeps them); a null
doc_id is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.texts import mix, releasing, text_slices

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_PIECES, SLICE_CHARS = 2000, 20_000, 2000, 1_000_000
#: A feature is kept if it has this many documents and these log odds; a token is toxic from STRONG on.
LEAST_DOCS, KEPT, STRONG = 4, 1.5, 2.5
PIECE = 128

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_APART = np.zeros(256, bool)
_APART[[b for b in range(128) if not chr(b).isalnum()]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd base, modulo 2 to the 64."""
    if len(_POWERS[0]) < n:
        more = np.full(n * 2, 0x9E3779B97F4A7C15, np.uint64)
        more[0] = 1
        _POWERS[0] = np.multiply.accumulate(more)
    return _POWERS[0]


def lowered(text: str) -> str:
    """The text in lower case with as many code points as before: those whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Tokens:
    """Runs of ASCII letters, digits and other code points, with the hashes of their features."""

    def __init__(self, texts: list[str]):
        encoded = [lowered(t).encode("utf-8", "surrogatepass") for t in texts]
        raw = _FOLD[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
        apart = _APART[raw]
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        if not apart[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.text_of = np.searchsorted(ends, self.starts, side="right")
        self.raw, self.text_start = raw, np.concatenate(([0], ends[:-1]))
        self.n_texts = len(texts)
        self.counts = np.bincount(self.text_of, minlength=len(texts))
        size = self.ends - self.starts
        if not len(size):
            self.features = np.zeros((0, 3), np.uint64)
            return
        inner = np.flatnonzero(~apart)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        place = np.arange(len(inner)) - np.repeat(first, size)
        terms = _LETTER[raw[inner]] * powers(int(size.max()))[place]
        cumulated = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        columns = [mix(cumulated[first + size] - cumulated[first], 1)]
        for k in (4, 5):
            head = np.minimum(size, k)
            columns.append(np.where(size >= k, mix(cumulated[first + head] - cumulated[first], k), np.uint64(0)))
        self.features = np.stack(columns, axis=1)


    def spans(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in their texts the tokens at some positions begin and end, in code points."""
        before = np.concatenate(([0], np.cumsum((self.raw & 0xC0) != 0x80)))
        base = before[self.text_start[self.text_of[at]]]
        return before[self.starts[at]] - base, before[self.ends[at]] - base

    @staticmethod
    def of(texts: list[str], at_once: int = 200) -> "Tokens":
        """The tokens of many texts, made some texts at a time to hold little memory."""
        parts = [Tokens(texts[i : i + at_once]) for i in range(0, max(1, len(texts)), at_once)]
        whole = Tokens.__new__(Tokens)
        whole.n_texts = len(texts)
        whole.counts = np.concatenate([p.counts for p in parts])
        whole.text_of = np.repeat(np.arange(len(texts)), whole.counts)
        whole.features = np.concatenate([p.features for p in parts])
        return whole


def sample(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, text, label) of the sample: at most SAMPLE_ROWS labelled ids of either label, and 4 * SAMPLE_ROWS rows of them, should ids repeat.

    An id with labels that contradict each other is left out.
    """
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = None
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.union(part)
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("label"), F.max("toxic").alias("most")).filter("label = most").select("doc_id", "label")
    rows = docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", "label").orderBy("doc_id", "text").limit(4 * SAMPLE_ROWS)


def distinct_texts(texts: list[str]) -> list[int]:
    """Positions without copies and near copies: no two share six of eight least hashes of word pairs."""
    tokens = Tokens.of(texts)
    h = tokens.features[:, 0]
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    cut = np.concatenate(([0], np.cumsum(tokens.counts)))
    seen: set[tuple[int, int]] = set()
    kept = []
    for i in range(len(texts)):
        own = pair[cut[i] : max(cut[i], cut[i + 1] - 1)]
        marks = [(k, int(mix(own, k + 20).min())) for k in range(8)] if len(own) else [(8, hash(texts[i]))]
        if sum(m in seen for m in marks) < max(1, len(marks) * 3 // 4):
            kept.append(i)
        seen.update(marks)
    return kept


class Model:
    """The features with their weights, the chain, and the document's logistic function."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.weights = np.zeros(0)
        self.background = 0.0
        self.chain = np.zeros((2, 2))
        self.document = np.array([-30.0, 0.0, 0.0, 0.0])

    def emissions(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's score of the toxic state over the other, and whether a feature is known."""
        if not len(self.keys):
            return np.full(len(features), self.background), np.zeros(len(features), bool)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        hit = self.keys[at] == features
        return self.background + np.where(hit, self.weights[at], 0.0).sum(axis=1), hit.any(axis=1)

    def marginals(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the tokens with known features, and their marginals of the toxic state.

        Between them all tokens score alike, so a stretch of k of them is the k-th power of one
        2 x 2 matrix; the chain is thus walked from one known token to the next, all texts at once.
        """
        score, known = self.emissions(tokens.features)
        at = np.flatnonzero(known)
        if not len(at):
            return at, np.zeros(0)
        base = np.exp(self.chain)  # from row to column
        plain = base * np.exp([0.0, self.background])[None, :]
        values, vectors = np.linalg.eig(plain)
        values, vectors = values.real, vectors.real
        inverse = np.linalg.inv(vectors)
        top = np.abs(values).max()

        def stretch(k: np.ndarray) -> np.ndarray:
            return np.einsum("ij,nj,jk->nik", vectors, (values / top)[None, :] ** k[:, None], inverse)

        owner = tokens.text_of[at]
        first = np.cumsum(tokens.counts) - tokens.counts
        place, length = at - first[owner], tokens.counts[owner]
        new = np.ones(len(at), bool)
        new[1:] = owner[1:] != owner[:-1]
        last = np.ones(len(at), bool)
        last[:-1] = new[1:]
        gap = np.where(new, place, np.concatenate(([0], np.diff(place))) - 1)
        tail = length - place - 1
        emit = np.stack((np.ones(len(at)), np.exp(np.clip(score[at], -30, 30))), axis=1)
        between = stretch(gap)
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        order = np.argsort(rank, kind="stable")
        groups = np.split(order, np.cumsum(np.bincount(rank))[:-1])
        forward = np.empty((len(at), 2))
        for step, g in enumerate(groups):
            if step == 0:
                opening = np.array([0.5, 0.5 * np.exp(self.background)])  # the text's first token, if nothing is known of it
                start = np.einsum("i,nij->nj", opening, stretch(np.maximum(gap[g] - 1, 0)))
                f = np.where(gap[g][:, None] > 0, start @ base, np.array([[0.5, 0.5]]))
            else:
                f = np.einsum("ni,nij->nj", forward[g - 1], between[g]) @ base
            f = f * emit[g]
            forward[g] = f / f.sum(axis=1, keepdims=True)
        backward = np.empty((len(at), 2))
        closing = stretch(tail).sum(axis=2)
        for g in reversed(groups):
            b = closing[g].copy()
            inner = g[~last[g]]
            if len(inner):
                nxt = inner + 1
                b[~last[g]] = np.einsum("nij,nj->ni", between[nxt], (emit[nxt] * backward[nxt]) @ base.T)
            backward[g] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return at, both[:, 1] / both.sum(axis=1)

    def evidence(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the logistic function's inputs; positions and marginals of known tokens."""
        at, p = self.marginals(tokens)
        owner = tokens.text_of[at]
        most = np.zeros(tokens.n_texts)
        np.maximum.at(most, owner, p)
        # a word counts once a text, however often it stands there
        _, which, times = np.unique(mix(tokens.features[at, 0] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        total = np.bincount(owner, p**2 / times[which], minlength=tokens.n_texts)
        x = np.stack((np.ones(tokens.n_texts), most, np.log1p(total), total / np.maximum(tokens.counts, 1) * 20), axis=1)
        return x, at, p

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def _chain_fit(emission_ids: list[np.ndarray], toxic: list[np.ndarray], n: int, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, background and chain of a two-state field, over pieces of PIECE tokens side by side."""
    rows = len(toxic)
    y = np.zeros((rows, PIECE), np.int8)
    live = np.zeros((rows, PIECE), bool)
    ids = np.full((rows, PIECE, 3), n, np.int64)
    for i, (e, t) in enumerate(zip(emission_ids, toxic)):
        ids[i, : len(t)], y[i, : len(t)], live[i, : len(t)] = e, t, True
    w, bias, chain = np.zeros(n + 1), -2.0, np.zeros((2, 2))
    velocity = [np.zeros(n + 1), 0.0, np.zeros((2, 2))]
    scale = [np.zeros(n + 1), 0.0, np.zeros((2, 2))]
    pair = live[:, 1:] & live[:, :-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    for turn in range(1, rounds + 1):
        s = w[ids].sum(axis=2) + bias
        base = np.exp(chain)
        emit = np.stack((np.ones_like(s), np.exp(np.clip(s, -30, 30))), axis=2)
        f, b = np.empty((rows, PIECE, 2)), np.ones((rows, PIECE, 2))
        f[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, PIECE):
            z = f[:, k - 1] @ base * emit[:, k]
            f[:, k] = np.where(live[:, k, None], z / z.sum(axis=1, keepdims=True), f[:, k - 1])
        for k in range(PIECE - 2, -1, -1):
            z = (b[:, k + 1] * emit[:, k + 1]) @ base.T
            b[:, k] = np.where(live[:, k + 1, None], z / z.sum(axis=1, keepdims=True), 1.0)
        p = f * b
        p = p[:, :, 1] / p.sum(axis=2)
        xi = f[:, :-1, :, None] * base[None, None] * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
        xi = (xi / xi.sum(axis=(2, 3), keepdims=True))[pair].sum(axis=0)
        error = np.where(live, y - p, 0.0)
        grads = [np.bincount(ids.reshape(-1), np.repeat(error.reshape(-1), 3), minlength=n + 1) - 0.3 * w, error.sum() - 0.01 * bias, seen - xi - 0.3 * chain]
        values = [w, bias, chain]
        for k in range(3):  # Adam
            velocity[k] = 0.9 * velocity[k] + 0.1 * grads[k]
            scale[k] = 0.99 * scale[k] + 0.01 * np.square(grads[k])
            values[k] = values[k] + 0.25 * velocity[k] / (1 - 0.9**turn) / (np.sqrt(scale[k] / (1 - 0.99**turn)) + 1e-6)
        w, bias, chain = values
        w[n] = 0.0
    return w[:n], float(bias), chain


def fit(rows: list[tuple[str, int]], toxic_share: float) -> Model:
    model = Model()
    kept = distinct_texts([t for t, _ in rows]) if rows else []
    rows = [rows[i] for i in kept]
    first, second = rows[0::2], rows[1::2]
    if {y for _, y in first} != {0, 1} or {y for _, y in second} != {0, 1}:
        return model
    tokens, label = Tokens.of([t for t, _ in first]), np.array([y for _, y in first])
    cut = np.concatenate(([0], np.cumsum(tokens.counts)))
    own = [np.unique(tokens.features[cut[i] : cut[i + 1]]) for i in range(len(first))]
    keys, which = np.unique(np.concatenate(own), return_inverse=True)
    toxic = np.repeat(label, [len(u) for u in own])
    inside = np.bincount(which, toxic, minlength=len(keys))
    outside = np.bincount(which, 1 - toxic, minlength=len(keys))
    n_toxic, n_clean = label.sum(), (label == 0).sum()
    slack = 0.5 + 0.0015 * n_clean  # a word of few documents needs more of them to count, the more words were tried
    odds = np.log((inside + 0.5) / (n_toxic + 1)) - np.log((outside + slack) / (n_clean + 2 * slack))
    use = (inside >= LEAST_DOCS) & (odds >= KEPT) & (keys > 0)
    keys, odds = keys[use], odds[use]
    if not len(keys):
        return model
    at = np.minimum(np.searchsorted(keys, tokens.features), len(keys) - 1)
    hit = keys[at] == tokens.features
    strong = (np.where(hit, odds[at], 0.0).max(axis=1) >= STRONG) & (label[tokens.text_of] == 1)
    ids = np.where(hit, at, len(keys))
    pieces = [(a, min(a + PIECE, cut[i + 1])) for i in range(len(first)) for a in range(cut[i], cut[i + 1], PIECE)]
    pieces = [(a, b) for a, b in pieces if hit[a:b].any()]  # the others say the same of the background
    pieces = [pieces[k] for k in np.argsort(mix(np.arange(len(pieces), dtype=np.uint64)))[:SAMPLE_PIECES]]
    model.weights, model.background, model.chain = _chain_fit([ids[a:b] for a, b in pieces], [strong[a:b].astype(np.int8) for a, b in pieces], len(keys))
    model.keys = keys
    y = np.array([y for _, y in second], float)
    x, _, _ = model.evidence(Tokens.of([t for t, _ in second]))
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 0.05 * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    model.document = beta
    return model


def held_out(doc_id):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The field fitted on the sample, in one task, as the sample is bounded; the driver gets the model alone."""
    usable = labels.filter("toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    share = float(usable.agg(F.avg("toxic")).first()[0] or 0.0)

    def run(batches):
        rows = sorted((i, t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
        m = fit([(t, y) for _, t, y in rows], share)
        values = [m.keys.view(np.int64).tolist(), m.weights.tolist(), [m.background], m.chain.reshape(-1).tolist(), m.document.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64() if k == 0 else pa.float64())) for k, v in enumerate(values)], ["keys", "weights", "background", "chain", "document"])

    row = sample(docs, labels).repartition(1).mapInArrow(run, "keys array<long>, weights array<double>, background array<double>, chain array<double>, document array<double>").first()
    model = Model()
    if row is not None:
        model.keys, model.weights = np.array(row.keys, np.int64).view(np.uint64), np.array(row.weights, float)
        model.background, model.chain, model.document = row.background[0], np.array(row.chain).reshape(2, 2), np.array(row.document)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, with_spans: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted) and, with_spans, where toxic tokens begin and end in the text, in code points, the end exclusive."""
    schema = "doc_id long, score double" + ", toxic_spans array<struct<start:int,end:int>>" * with_spans

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                tokens = Tokens(texts)
                x, at, p = model.evidence(tokens)
                columns = [part.column(0), pa.array(model.scores(x))]
                if with_spans:
                    at = at[p >= 0.5]
                    owner = tokens.text_of[at]
                    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
                    pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in tokens.spans(at)], ["start", "end"])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pairs))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "toxic_spans"][: len(columns)])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), schema)
    out = scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["toxic_spans"] * with_spans)
    return out


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, that are not predicted toxic."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, batch.schema.names[at], SLICE_CHARS):
                x, _, _ = model.evidence(Tokens(texts))
                yield part.filter(pa.array(model.scores(x) < threshold))

    return docs.mapInArrow(releasing(run), docs.schema)
