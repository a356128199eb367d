"""Order-preserving packing: window cuts at document or sentence ends that minimise padding and cut penalties."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches
from tablewright.llm.textvec import IS_SPACE, chunks, lay_out, runs, segment_hashes, trim

#: In tokens: what a window costs besides its padding, and what cuts cost at a sentence's end and inside a sentence.
PER_WINDOW, CUT, HARD_CUT = 16, 4, 64
#: Sentence ends nearer than this to the last boundary are passed over.
STEP = 24
#: Words whose ids a Python worker remembers, tokens that are packed in one go, words that the tokenizer gets at once.
CACHE_WORDS, BLOCK_TOKENS, LEARN_WORDS = 600_000, 500_000, 5_000
END_ID = 1
#: ASCII punctuation but for the apostrophe, which contractions begin with.
TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: How byte-level vocabularies show a byte: printable Latin-1 as itself, the others in order from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


class WordTokens:
    """Token ids of many texts by a tokenizer that treats words apart; each distinct word is tokenized once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [(i, t) for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.stops = np.zeros(max(self.tokenizer.get_vocab_size(), 1 + END_ID) + 1, bool)
        self.stops[[i for i, t in ends if t[:-4] and t[:-4][-1] in ".!?"]] = True
        self.forget()

    def forget(self) -> None:
        self.tails: dict[str, list[int]] = {}
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Letters and then ASCII punctuation are two words to the tokenizer: the letters, lower-cased, go
        straight to its model, the punctuation is looked up; all else takes the tokenizer's full way."""
        out: list[list[int] | None] = [None] * len(words)
        rest = []
        model = self.tokenizer.model
        for k, word in enumerate(words):
            letters = word.rstrip(TAIL)
            low = letters.lower()
            if not low.isalpha() or "\u03a3" in letters or not is_normalized("NFC", low):
                rest.append(k)
                continue
            ids = [t.id for t in model.tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(SHOWN))]
            tail = word[len(letters) :]
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
                ids = ids + self.tails[tail]
            out[k] = ids
        for a in range(0, len(rest), LEARN_WORDS):
            part = rest[a : a + LEARN_WORDS]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = self.word_ids(words)
        n = np.array([len(i) for i in ids], np.int32)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate((self.flat, np.fromiter((x for i in ids for x in i), np.int32, int(n.sum()))))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.len = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.len, where, n)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        buf, at = lay_out(texts)
        starts, ends = runs((~IS_SPACE[buf]).astype(np.int8))
        if not len(starts):
            return [np.zeros(0, np.int32) for _ in texts]
        keys, first, inverse = np.unique(segment_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            raw, new = buf.tobytes(), np.flatnonzero(~known)
            self.learn(keys[new], [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in first[new].tolist()])
            place = np.searchsorted(self.keys, keys)
        n = self.len[place][inverse]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[place][inverse] - (upto - n), n) + np.arange(int(upto[-1]))]
        cut = np.searchsorted(starts, at)
        bound = np.concatenate(([0], upto))[cut]
        return [ids[a:b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


_tokens: dict[str, WordTokens] = {}


def worker_tokens(path: str) -> WordTokens:
    """One for each Python worker, which keeps it from task to task."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def boundaries(lengths: list[int], stops: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Places where a window may end, and what a cut there costs: document ends 0, sentence ends CUT, else HARD_CUT."""
    ends = np.cumsum(lengths)
    place, cost, last = [0], [0], 0
    docs = set(ends.tolist())
    for p in np.union1d(ends, np.flatnonzero(stops) + 1).tolist():
        doc = p in docs
        if p == last or not doc and p - last < STEP:
            continue
        while p - last > window:
            last += window
            place.append(last)
            cost.append(HARD_CUT)
        place.append(p)
        cost.append(0 if doc else CUT)
        last = p
    return place, cost


def best_cuts(place: list[int], cost: list[int], window: int) -> list[int]:
    """The indices of `place` at which windows end, at the least total cost.

    A window from j to i costs PER_WINDOW, the cut's cost, and its padding window - (p_i - p_j), or none if its length is
    a power of two. For the first kind the least of best_j + p_j over a sliding range is at the front of a monotone queue.
    """
    m = len(place)
    best, back = [0] * m, [0] * m
    where = {p: i for i, p in enumerate(place)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    queue: deque[int] = deque([0])
    for i in range(1, m):
        p = place[i]
        while place[queue[0]] < p - window:
            queue.popleft()
        j = queue[0]
        value = best[j] + place[j] + window - p
        for w in powers:
            k = where.get(p - w)
            if k is not None and best[k] < value:
                j, value = k, best[k]
        best[i], back[i] = value + PER_WINDOW + cost[i], j
        key = best[i] + p
        while queue and best[queue[-1]] + place[queue[-1]] >= key:
            queue.pop()
        queue.append(i)
    cuts, i = [], m - 1
    while i > 0:
        cuts.append(i)
        i = back[i]
    return cuts[::-1]


def packer(path: str, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = worker_tokens(path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        serial = part << 32
        rows: list[tuple] = []  # (doc_id, start, ids still to pack, doc_tokens)
        held = 0

        def flush(last: bool) -> pd.DataFrame:
            nonlocal rows, held, serial
            ids = np.concatenate([r[2] for r in rows])
            place, cost = boundaries([len(r[2]) for r in rows], tokens.stops[ids], window)
            cuts = [place[k] for k in best_cuts(place, cost, window)]
            if not last:
                cuts = cuts[:-2]  # the last windows wait for what follows
            begun = np.cumsum([0] + [len(r[2]) for r in rows])
            done = cuts[-1] if cuts else 0
            edges = np.union1d(np.array([0, *cuts], np.int64), begun[begun <= done])
            doc = np.searchsorted(begun, edges[:-1], side="right") - 1
            win = np.searchsorted(np.array(cuts, np.int64), edges[:-1], side="right")
            opened = np.array([0, *cuts], np.int64)[win]
            raw = ids.astype("<u4").tobytes()
            a, b = edges[:-1], edges[1:]
            out = pd.DataFrame(
                {
                    "doc_id": pd.array([rows[d][0] for d in doc], "Int64"),
                    "start": [rows[d][1] + int(x - begun[d]) for d, x in zip(doc, a, strict=True)],
                    "length": b - a,
                    "ids_crc32": [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)],
                    "doc_tokens": [rows[d][3] for d in doc],
                    "sequence_id": serial + win,
                    "offset": a - opened,
                }
            )
            serial += len(cuts)
            left = []
            for k, r in enumerate(rows):
                if begun[k + 1] > done:
                    off = max(0, done - int(begun[k]))
                    left.append((r[0], r[1] + off, r[2][off:], r[3]))
            rows, held = left, int(begun[-1]) - done
            return out

        for pdf in batches:
            names = pdf.doc_id.astype("Int64").tolist()
            for first, texts in chunks(pdf.t.tolist()):
                for k, ids in enumerate(tokens.encode(texts), first):
                    ids = np.append(ids, np.int32(END_ID))
                    rows.append((names[k], 0, ids, len(ids)))
                    held += len(ids)
                if held > BLOCK_TOKENS:
                    yield flush(False)
        if rows:
            yield flush(True)
        trim()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents laid into sequences of at most `window` tokens, in the order in which partitions hold the rows.

    A document is its ids by the tokenizer file, as the library gives them (so a literal such as <|endoftext|> is its
    special id), and then END_ID. Returns one row for each piece: doc_id, start (ids of
    the document before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. Every partition is packed by itself while it streams by, without a shuffle; a sequence never holds rows of
    two partitions, and its id has the partition's number in its upper half.

    A null or blank text is the end id alone. Repeated rows and null ids are packed as any others. A text of any length
    is read whole and cut where it must. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInPandas(packer(tokenizer, window), schema)
