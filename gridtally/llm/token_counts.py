"""Operator 3: token counts by a compiled finite-state tokenizer.

Two deterministic transducers are composed. The outer one reads character classes and marks
where the pieces of byte-level BPE begin. Each class is a function on its few states; the
functions that arise by composition form a small monoid with a table of products, so chunks
of the text are reduced to one state map each, a prefix scan composes the maps of all chunks
in a logarithmic number of steps, and every chunk then knows the state that it starts in.

The inner transducer reads the bytes of one piece. After a prefix its state holds, for each
place where a token may still be open, the node of the vocabulary's trie, the token before
that place and the number of tokens up to it relative to now. A transition carries the number
of tokens that it adds to the encoding of the prefix (it may be negative, as two tokens may
become one). By the property that a prefix of an encoding is the encoding of its text, just
one token can end a prefix, so states are deterministic. Transitions are compiled as they are
first met. Long pieces are cut into chunks, each of which becomes a map from the state that it is
entered in to the state that it is left in and the tokens in between; pieces and chunks run through
the table side by side, and a piece's maps are composed. Pieces are told apart by their characters.

Nothing is shuffled. Nulls and empty texts count 0 tokens and 0 bytes; repeated rows give
repeated results; extra columns are not read; an empty table gives no rows. A text of any
length, and a piece of any length, is cut into chunks.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtally.llm.bpe import byte_letters
from gridtally.llm.texts import WHITE_SPACE, members, releasing, text_slices

#: Characters taken at a time, characters of a text's chunk, bytes of a long piece's chunk and those its entry state is
#: guessed from; pieces of at most so many characters and transitions remembered. None changes results.
SLICE_CHARS, CHUNK, PART, OVERLAP = 1_500_000, 256, 1024, 192
CACHED_PIECES, CACHED_CHARS, CACHED_STEPS = 300_000, 64, 400_000

# Character classes.
END, SPACE, WHITE, QUOTE, NUMBER, OTHER, LETTER, STMD, R, V, L, E = range(12)
# States: nothing open; a run of letters, of numbers, of other characters; white space of one
# or of more characters that ends in a space or in another; a quote, with the first letter of a contraction.
FREE, IN_L, IN_N, IN_O, ONE_S, ONE_W, MANY_S, MANY_W, AT_Q, AT_QR, AT_QV, AT_QL = range(12)
# What a transition marks: a piece begins here, a piece began one character before.
HERE, BEFORE = 1, 2


def outer_step(state: int, c: int) -> tuple[int, int]:
    """The next state and the marks."""
    letter = c >= LETTER
    fresh = FREE if c == END else ONE_S if c == SPACE else ONE_W if c == WHITE else AT_Q if c == QUOTE else IN_N if c == NUMBER else IN_O if c == OTHER else IN_L
    begins = HERE if c != END else 0
    if state == FREE:
        return fresh, begins
    if (state == IN_L and letter) or (state == IN_N and c == NUMBER):
        return state, 0
    if state in (IN_O, AT_Q) and c in (OTHER, QUOTE):
        return IN_O, 0
    if state in (ONE_S, ONE_W, MANY_S, MANY_W):
        if c == SPACE or c == WHITE:
            return (MANY_S if c == SPACE else MANY_W), 0
        if c == END:
            return FREE, 0
        own = BEFORE if state in (MANY_S, MANY_W) else 0
        if state in (ONE_S, MANY_S):  # the last space goes with what follows, so a quote there starts no contraction
            return (IN_O if c == QUOTE else fresh), own
        return fresh, own | HERE
    if state == AT_Q and c in (STMD, R, V, L):
        return {STMD: FREE, R: AT_QR, V: AT_QV, L: AT_QL}[c], 0
    if state in (AT_QR, AT_QV, AT_QL):
        if c == (L if state == AT_QL else E):
            return FREE, 0
        return (IN_L, BEFORE) if letter else (fresh, BEFORE | begins)
    return fresh, begins


class PieceMarks:
    """The outer transducer, its monoid of state maps, and the scan over them."""

    def __init__(self):
        n = 12
        steps = [[outer_step(s, c) for s in range(n)] for c in range(n)]
        self.mark = np.array([[steps[c][s][1] for c in range(n)] for s in range(n)], np.uint8)
        maps = [tuple(s for s, _ in row) for row in steps]
        found = {tuple(range(n)): 0}
        order = list(found)
        for f in maps:
            if f not in found:
                found[f] = len(order)
                order.append(f)
        k = 1
        while k < len(order):  # closure under one more class
            for f in maps:
                g = tuple(f[s] for s in order[k])
                if g not in found:
                    found[g] = len(order)
                    order.append(g)
            k += 1
        self.of_class = np.array([found[f] for f in maps], np.int32)
        self.after = np.array(order, np.uint8)
        self.product = np.array([[found[tuple(g[s] for s in f)] for g in order] for f in order], np.int32)
        table = np.full(0x110000, OTHER, np.uint8)
        table[members("L")] = LETTER
        table[members("N")] = NUMBER
        table[WHITE_SPACE] = WHITE
        for letters, c in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
            table[[ord(x) for x in letters]] = c
        self.classes = table

    def bounds(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pieces; points[ends] stand for the ends of texts."""
        kind = self.classes[points]
        kind[ends] = END
        n = len(kind)
        rows = -(-n // CHUNK)
        padded = np.full(rows * CHUNK, END, np.uint8)
        padded[:n] = kind
        maps = np.ascontiguousarray(self.of_class[padded].reshape(rows, CHUNK).T)
        for i in range(1, CHUNK):  # each chunk's running map
            maps[i] = self.product[maps[i - 1], maps[i]]
        scan = maps[-1].copy()  # the prefix scan over chunks
        step = 1
        while step < rows:
            scan[step:] = self.product[scan[:-step], scan[step:]]
            step *= 2
        entry = np.full(rows, FREE, np.uint8)
        entry[1:] = self.after[scan[:-1], FREE]
        state = self.after[maps, entry[None, :]].T.reshape(-1)[:n]
        prior = np.empty(n, np.uint8)
        prior[0], prior[1:] = FREE, state[:-1]
        mark = self.mark[prior, kind]
        begins = (mark & HERE) > 0
        begins[:-1] |= (mark[1:] & BEFORE) > 0
        cut = begins.copy()
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        opens = begins[cuts]
        starts = cuts[opens]
        return starts, cuts[np.flatnonzero(opens) + 1]


class PieceCounts:
    """The inner transducer: tokens in the byte-level BPE encoding of a piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.added = [x["content"] for x in spec["added_tokens"]]
        byte = {x: b for b, x in enumerate(byte_letters())}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        self.child: dict[int, int] = {}
        self.token_at, self.inner = [-1], [True]
        for token, i in vocab.items():
            node = 0
            for x in token:
                key = node << 8 | byte[x]
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[key]
            self.token_at[node] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], r) for r, (a, b) in enumerate(pairs)}
        self.spines: dict[int, tuple[list, list]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: dict[int, int] = {}
        self.start = self.state(((0, -1, 0),))

    def state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def edges(self, token: int) -> tuple[list, list]:
        """The tokens that stand at its left and at its right end as merges go on, each with the rank of the merge that ends it."""
        if token not in self.spines:
            out = []
            for side in (0, 1):
                spine, x, until = [], token, len(self.rank)
                while True:
                    spine.append((x, until))
                    if x not in self.parts:
                        break
                    until, x = self.parts[x][2], self.parts[x][side]
                out.append(spine)
            self.spines[token] = out[0], out[1]
        return self.spines[token]

    def adjoins(self, a: int, b: int) -> bool:
        """Whether the encoding of both texts together is a, b: no merge crosses the border while both its parts stand."""
        if (a, b) not in self.fits:
            rank = self.rank.get
            self.fits[a, b] = not any((r := rank((x, y))) is not None and r < p and r <= q for x, p in self.edges(a)[1] for y, q in self.edges(b)[0])
        return self.fits[a, b]

    def compile(self, state: int, b: int) -> int:
        """The transition as next state * 64 + added tokens + 32."""
        open_, token, total = [], -1, 0
        for node, last, count in self.keys[state]:
            child = self.child.get(node << 8 | b)
            if child is None:
                continue
            t = self.token_at[child]
            if token < 0 <= t and (last < 0 or self.adjoins(last, t)):
                token, total = t, count + 1
            if self.inner[child]:
                open_.append((child, last, count))
        key = (*((node, last, count - total) for node, last, count in open_), (0, token, 0))
        self.steps[state << 8 | b] = step = self.state(key) << 6 | total + 32
        return step

    def run(self, parts: list[bytes], entry: list[int]) -> tuple[list[int], list[int]]:
        """The state after each part, read from the state that it is entered in, and the tokens that it adds; all parts side by side."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-size, kind="stable")
        size, raw = size[order], np.frombuffer(b"".join([parts[i] for i in order.tolist()]), np.uint8)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        state = np.array(entry, np.int64)[order]
        total = np.zeros(len(parts), np.int64)
        live = len(parts)
        for i in range(int(size[0]) if len(size) else 0):
            while live and size[live - 1] <= i:
                live -= 1
            met, where = np.unique(state[:live] << 8 | raw[first[:live] + i], return_inverse=True)
            found = self.steps.get
            step = np.array([x if (x := found(k)) is not None else self.compile(k >> 8, k & 255) for k in met.tolist()], np.int64)[where]
            state[:live] = step >> 6
            total[:live] += (step & 63) - 32
        back = np.empty(len(parts), np.int64)
        back[order] = np.arange(len(parts))
        return state[back].tolist(), total[back].tolist()

    def count(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each piece.

        A piece is cut into chunks of PART bytes, and each chunk is reduced to its map from the state that it
        is entered in to the state that it is left in and the tokens in between. The state that a chunk is entered in is
        first guessed from the OVERLAP bytes before it, as states forget what lies further back; so all chunks
        run side by side. Then the maps are composed from the left, and where a guess was wrong
        the chunk runs again from the state that was found.
        """
        if len(self.steps) > CACHED_STEPS:
            self.reset()
            self.fits.clear()
        chunks = [[p[i : i + PART] for i in range(0, len(p), PART)] for p in pieces]
        inner = [(c[k - 1], c[k]) for c in chunks for k in range(1, len(c))]
        guessed, _ = self.run([before[-OVERLAP:] for before, _ in inner], [self.start] * len(inner))
        wanted = list(dict.fromkeys([*((c[0], self.start) for c in chunks if c), *((x, s) for (_, x), s in zip(inner, guessed))]))
        maps: dict[tuple[bytes, int], tuple[int, int]] = {}
        state, total, at = [self.start] * len(pieces), [0] * len(pieces), [0] * len(pieces)
        open_ = [i for i, c in enumerate(chunks) if c]
        while open_:
            maps.update(zip(wanted, zip(*self.run([x for x, _ in wanted], [s for _, s in wanted]))))
            wanted, still = {}, []
            for i in open_:
                while at[i] < len(chunks[i]) and (step := maps.get((chunks[i][at[i]], state[i]))) is not None:
                    state[i], total[i], at[i] = step[0], total[i] + step[1], at[i] + 1
                if at[i] < len(chunks[i]):
                    wanted[chunks[i][at[i]], state[i]] = None
                    still.append(i)
            open_, wanted = still, list(wanted)
        return total


class TokenCounter:
    """Both transducers and the counts of pieces met."""

    def __init__(self, path: str):
        self.marks, self.inner, self.known = PieceMarks(), PieceCounts(path), {}

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; an added token's string counts one and ends the text before it."""
        special = np.zeros(len(texts), np.int64)
        parts, ends, at = [], [], 0
        end_of_text = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            segments = [text]
            for token in self.inner.added:
                segments = [x for s in segments for x in s.split(token)]
            special[i] = len(segments) - 1
            for s in segments:
                parts.append(s)
                at += len(s) + 1
                ends.append(at - 1)
            end_of_text[i] = at
        whole = "\n".join(parts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, stops = self.marks.bounds(points, np.array(ends))
        pieces = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        if new := set(pieces) - self.known.keys():
            if len(self.known) + len(new) > CACHED_PIECES:
                self.known.clear()
                new = set(pieces)
            fresh = list(new)
            self.known.update(zip(fresh, self.inner.count([x.encode("utf-8", "surrogatepass") for x in fresh])))
        counts = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        for x in [x for x in new if len(x) > CACHED_CHARS]:
            del self.known[x]
        cumulated = np.concatenate(([0], np.cumsum(counts)))
        upto = cumulated[np.searchsorted(starts, end_of_text)]
        return np.diff(upto, prepend=0) + special


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches):
        counter = token_counter(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                n = counter.count(texts)
                size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], [id_column, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_column], docs[text_column].alias("text")).mapInArrow(releasing(run, lambda: token_counter(path).known.clear()), f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
