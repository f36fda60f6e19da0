"""Operator 1: byte-pair encoding and decoding with a pair occurrence index.

The distinct new words of a batch lie in one flat symbol array with links to their
neighbours. An index maps the rank of each mergeable pair to all its positions in the
batch; a heap gives the active ranks in ascending order, and applying one rank merges all
its positions at once and adds the pairs that arise beside them to the lists of their ranks.
Nothing is shuffled: each task encodes the rows that it reads.

Nulls and empty texts have no tokens and decode to the empty text. Repeated rows give
repeated results, extra columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtally.llm.texts import char_class, releasing, text_slices

#: Chars of text encoded at a time, words remembered at most, and their characters at most; none changes results.
SLICE_CHARS, CACHED_WORDS, CACHED_CHARS = 2_000_000, 150_000, 64
#: What str.split() takes for white space beyond Unicode's property.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


#: Lower-case forms that str.lower() gives by context (sigma), or not yet (letters of Unicode 16 and 17).
_LOWER = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}

_ODD = re.compile("[" + "".join(map(chr, _LOWER)) + "]")

#: Combining marks of later versions of Unicode than the vocabulary's library knows; to it they are letters that nothing is reordered about. U+11930 composes with nothing there.
_UNORDERED = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b"
    "\U0001145e\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44"
    "\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)


def composed(text: str) -> str:
    """NFC by the canonical order that the library knows."""
    if unicodedata.is_normalized("NFC", text):
        return text
    return "".join(unicodedata.normalize("NFC", part) for part in _UNORDERED.split(text))


@lru_cache(maxsize=1)
def piece_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of anything else but white space; and line ends."""
    letter, number, white = (char_class(x) for x in ("L", "N", ""))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{white}{letter}{number}]+|\n")


class WordBpe:
    """Encoder and decoder for a tokenizer file of lower-cased BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int64)
        self.base = max(self.token) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.base + self.right
        self.rank_by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_by_key]
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.find = piece_pattern().findall
        self.gap = re.compile(f"[{char_class('')}]+")
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def forget(self) -> None:
        """Drops the words met."""
        self.ids.clear()
        self.shown.clear()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_by_key[at], -1)

    def words(self, text: str) -> list[str]:
        """What stands between white space, in lower case, which is encoded one by one as no piece crosses it; added tokens stand behind a space."""
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        out: list[str] = []
        for part in parts:
            if part in self.added:
                out.append(" " + part)
            elif part:
                if not part.isascii():
                    part = composed(part)
                    if _ODD.search(part):
                        part = part.translate(_LOWER)
                part = part.lower()
                if _SEPARATORS.search(part):  # str.split() cuts at them too, but they are no white space
                    out += [w for w in self.gap.split(part) if w]
                else:
                    out += part.split()
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words that have not been met before."""
        for w in words:
            if w[0] == " ":
                self.ids[w], self.shown[w] = self.added[w[1:]].to_bytes(4, "little"), w[1:]
        todo = [w for w in words if w[0] != " "]
        if not todo:
            return
        # a line end stands behind each word as a piece of its own
        raw = list(map(str.encode, self.find("\n".join(todo) + "\n")))
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        letters = np.frombuffer(b"".join(raw), np.uint8)
        symbols, live = self.merge(letters, size)
        live[letters == 10] = False
        kept = np.concatenate(([0], np.cumsum(live)))
        bounds = kept[np.concatenate(([0], np.flatnonzero(letters == 10)))].tolist()
        ids = symbols[live].astype("<u4")
        data, token = ids.tobytes(), list(map(self.token.__getitem__, ids.tolist()))
        for w, a, b in zip(todo, bounds, bounds[1:]):
            self.ids[w], self.shown[w] = data[4 * a : 4 * b], " ".join(token[a:b])

    def merge(self, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols after all merges, and which of the positions still stand."""
        ends = np.cumsum(size) - 1
        symbol = self.inner[letters]
        symbol[ends] = self.final[letters[ends]]
        n = len(symbol)
        after = np.arange(1, n + 1)
        after[ends] = -1
        before = np.arange(-1, n - 1)
        before[ends - size + 1] = -1
        live = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def occurs(positions: np.ndarray) -> None:
            """Adds pairs, given by their left symbol's position, to the index."""
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for group, r in zip(np.split(positions, cut), rank[np.concatenate(([0], cut))].tolist()):
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(active, r)

        occurs(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            nxt = after[at]
            fits = live[at] & (symbol[at] == a) & (nxt >= 0)
            fits &= symbol[nxt] == b
            at, nxt = at[fits], nxt[fits]
            if a == b and len(at) > 1:  # a run such as aaa: from the left, without overlap
                used, take = -1, np.ones(len(at), bool)
                for k, (p, q) in enumerate(zip(at.tolist(), nxt.tolist())):
                    if p == used:
                        take[k] = False
                    else:
                        used = q
                at, nxt = at[take], nxt[take]
            if not len(at):
                continue
            symbol[at] = self.made[r]
            live[nxt] = False
            beyond = after[nxt]
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            ahead = before[at]
            occurs(np.unique(np.concatenate((at[after[at] >= 0], ahead[ahead >= 0]))))
        return symbol, live

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the decoded text."""
        split = [self.words(t) for t in texts]
        if new := set().union(*split) - self.ids.keys():
            if len(self.ids) + len(new) > CACHED_WORDS:
                self.forget()
                new = set().union(*split)
            self.learn(list(new))
        out = [(b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.shown.__getitem__, words))) for words in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.ids[w], self.shown[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of a list of ids joined by spaces, special ones included."""
        return " ".join(self.token[i] for i in ids)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_tokens: bool = True, with_decoded: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and, with_tokens, token_ids and, with_decoded, decoded for each row."""
    kind = dict(docs.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_tokens + ", decoded string" * (with_tokens and with_decoded)

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for part, texts in text_slices(batch, "text", SLICE_CHARS):
                done = bpe.encode(texts)
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x, _ in done], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in done], pa.string()),
                    pa.array([hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest() for _, s in done], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_tokens:
                    offsets = np.cumsum([0, *(len(x) // 4 for x, _ in done)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(x for x, _ in done), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())))
                    names.append("token_ids")
                    if with_decoded:
                        columns.append(pa.array([s for _, s in done], pa.string()))
                        names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, [id_column, *names[1:]])

    return docs.select(docs[id_column], docs[text_column].alias("text")).mapInArrow(releasing(run, lambda: word_bpe(path).forget()), schema)
