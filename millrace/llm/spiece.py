"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together. All their substrings of up to the
longest piece are hashed at once and probe the sorted piece keys; at each
position the candidates that end there are scored over all words, and
vectorised maxima store backpointers.

Two kinds of models differ only in what a candidate scores. In a unigram model
a path scores the sum of its pieces. In a BPE model the sum of scores is *not*
what merging gives, so a candidate scores only if merging would leave it next
to the piece before it. Whether two pieces can stand side by side is a property
of the pair alone: undo their last merges step by step, latest first, and see
if an earlier merge crosses the seam. One path at most survives at each
position (of equal scores the maximum takes any, of one it takes it), so the
Viterbi path is the sequence of pieces that merging gives.

Texts split into words where no piece can cross: before a blank that follows
another character, and around newlines. Runs of blanks merge last of all in
the model and are set by a small table.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _powers, mix64, slices, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_MODEL = 64 << 20
BLANK = "▁"
CACHED = 1_000_000
# Characters whose words a worker hashes and looks up at once; its arrays are many times as large.
RUN_CHARS = 250_000


class Pieces:
    """Piece tables of one model."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("models that rewrite characters or blanks are not supported")
        self.prefix = spec.add_dummy_prefix
        self.bpe = {1: False, 2: True}[model.trainer_spec.model_type]
        self.text = [p.piece for p in model.pieces]
        score = np.array([p.score for p in model.pieces])
        kind = np.array([p.type for p in model.pieces])
        self.unknown = int(np.flatnonzero(kind == 2)[0])
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        normal = np.flatnonzero(kind == 1).tolist()
        self.ids = {self.text[i]: i for i in normal}
        if any(BLANK in t.lstrip(BLANK) or "\n" in t or (t.startswith(BLANK * 2) and t.strip(BLANK)) for t in self.ids):
            raise ValueError("a piece crosses words")
        self.runs = {len(t) for t in self.ids if t.strip(BLANK) == ""}
        self.longest = max(len(t) for t in self.ids if t.strip(BLANK)) if self.ids else 1
        self.score = score
        self.least = float(score[normal].min()) - 10.0
        # rank: the order in which merges happen; characters, which no merge makes, come before all
        words = [t for t in self.ids if len(t) > 1]
        _, dense = np.unique([-score[self.ids[t]] for t in words], return_inverse=True)
        self.rank = np.full(len(self.text) + 1, -1, np.int64)
        self.rank[[self.ids[t] for t in words]] = dense
        self._keys()
        self._seams()
        if self.bpe:
            self._splits()

    def _keys(self) -> None:
        """Sorted hashes of all pieces that can be part of a word, and their ids."""
        ids = [i for t, i in self.ids.items() if len(t.lstrip(BLANK)) or t == BLANK]
        self.factor = mix64(np.arange(3, 3 + max(self.longest, 1), dtype=U64)) | U64(1)
        keys = np.array([self._hash(self.text[i]) for i in ids], U64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(ids, np.int64)[order]
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.keys >> U64(44)] = True
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")

    def _seams(self) -> None:
        """Pairs of characters that stand side by side in some piece; between others no piece can cross."""
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in self.ids]
        self.chars = np.unique(np.concatenate(codes))
        self.seams = np.unique(np.concatenate([c[:-1] << 21 | c[1:] for c in codes]))
        self.near = np.zeros((1 << 10, 1 << 10), bool)
        low = self.seams[(self.seams >> 21 < 1 << 10) & (self.seams & 0x1FFFFF < 1 << 10)]
        self.near[low >> 21, low & 0x1FFFFF] = True

    def cuts(self, codes: np.ndarray) -> np.ndarray:
        """For each but the first of the characters, whether a text can be cut before it."""
        a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        joined = self.near[np.minimum(a, 1023), np.minimum(b, 1023)]
        far = np.flatnonzero((a >= 1 << 10) | (b >= 1 << 10))
        pair = a[far] << 21 | b[far]
        at = np.searchsorted(self.seams, pair)
        at[at == len(self.seams)] = 0
        joined[far] = self.seams[at] == pair
        if not self.bytes:  # unknown characters side by side are one unknown piece
            strange = ~np.isin(codes, self.chars)
            joined |= strange[:-1] & strange[1:]
        return ~joined

    def _hash(self, text: str) -> int:
        codes = mix64(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U64) + U64(1))
        return int(mix64(np.array([(codes * self.factor[: len(codes)]).sum(dtype=U64) + U64(len(codes))], U64))[0])

    def probe(self, codes: np.ndarray, length: int) -> np.ndarray:
        """Ids of all substrings of one length of equally long words, -1 where there is no such piece."""
        width = codes.shape[1] - length + 1
        total = np.full((len(codes), width), length, U64)
        for j in range(length):
            total += codes[:, j : j + width] * self.factor[j]
        total = mix64(total)
        out = np.full(total.shape, -1, np.int64)
        some = np.nonzero(self.likely[total >> U64(44)])  # cells without a key spare the search
        wanted = total[some]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        out[some] = np.where(self.keys[at] == wanted, self.key_ids[at], -1)
        return out

    def merge(self, text: str) -> list[str]:
        """Merging as the model defines it: the best pair first, of equals the leftmost."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(parts)
            if a >= 0 and b < len(parts):
                i = self.ids.get(parts[a] + parts[b])
                if i is not None:
                    heapq.heappush(heap, (self.rank[i], a, b, parts[a] + parts[b]))

        for a in range(len(parts)):
            offer(a)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or b >= len(parts) or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [p for p in parts if p is not None]

    def _splits(self) -> None:
        """The two pieces that each piece is made of at last, and the pairs that merge."""
        n = len(self.text) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.whole = np.zeros(n, bool)
        pairs, made = [], []
        for text, i in sorted(self.ids.items(), key=lambda x: (self.rank[x[1]], len(x[0]))):
            if len(text) == 1:
                self.whole[i] = True
                continue
            if text.strip(BLANK) == "":
                continue
            # its last merge joins the two parts that stand when all earlier merges are done
            best = None
            for k in range(1, len(text)):
                a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                if a is not None and b is not None:
                    pairs.append(a << 20 | b)
                    made.append(i)
                    if best is None and self.whole[a] and self.whole[b] and self.rank[a] <= self.rank[i] and self.rank[b] <= self.rank[i] and self._stands(a, b, self.rank[i]):
                        best = a, b
            if best:
                self.left[i], self.right[i] = best
                self.whole[i] = True
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs, self.made = np.array(pairs, np.int64)[order], np.array(made, np.int64)[order]
        self.hint = np.zeros(1 << 22, bool)  # cells without a pair spare the search
        self.hint[self._cell(self.pairs)] = True

    @staticmethod
    def _cell(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(42)

    def _stands(self, a: int, b: int, until: int) -> bool:
        """Whether no merge of a rank below ``until`` crosses the seam of two whole pieces."""
        limit = until
        while True:
            i = self.ids.get(self.text[a] + self.text[b])
            if i is not None and self.rank[i] < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] < 0:
                return True
            else:
                limit, b = self.rank[b] + 1, self.left[b]

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of whole pieces, whether merging leaves them as they are; -1 stands for an unknown character."""
        good = np.ones(len(a), bool)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        a, b = a[todo], b[todo]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            pair = a << 20 | b
            joins = self.hint[self._cell(pair)]
            some = np.flatnonzero(joins)
            at = np.searchsorted(self.pairs, pair[some])
            at[at == len(self.pairs)] = 0
            joins[some] = (self.pairs[at] == pair[some]) & (self.rank[self.made[at]] < limit[some])
            good[todo[joins]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo = ra > rb
            go = ~joins & (undo | (rb >= 0))
            limit = np.where(undo, ra, rb + 1)[go]
            a, b = np.where(undo, self.right[a], a)[go], np.where(undo, b, self.left[b])[go]
            todo = todo[go]
        return good

    def viterbi(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, one word after another, and their numbers; an unknown character is -1 - its code."""
        n, length = len(words), len(words[0])
        plain = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        codes = mix64(plain.astype(U64) + U64(1))
        table = [None, *(self.probe(codes, k) for k in range(1, min(self.longest, length) + 1))]
        if self.bpe:
            table[1:] = [np.where((t >= 0) & self.whole[t], t, -1) if k > 1 else t for k, t in enumerate(table[1:], 1)]
        best = np.zeros((n, length + 1))
        back = np.zeros((n, length + 1), np.int16)
        last = np.full((n, length + 1), -1, np.int64)
        for j in range(1, length + 1):
            most = min(self.longest, j)
            if self.bpe:  # one candidate survives at each position, so a word is done with the first
                left = np.arange(n)
                for k in range(most, 0, -1):
                    piece = table[k][left, j - k]
                    rows = np.flatnonzero(piece >= 0) if k > 1 else np.arange(len(left))
                    if j > k and len(rows):
                        rows = rows[self.side_by_side(last[left[rows], j - k], piece[rows])]
                    if len(rows):
                        back[left[rows], j], last[left[rows], j] = k, piece[rows]
                        left = np.delete(left, rows)
                        if not len(left):
                            break
                continue
            scores = np.full((n, most), -np.inf)
            for k in range(1, most + 1):
                piece = table[k][:, j - k]
                rows = np.flatnonzero(piece >= 0) if k > 1 else np.arange(n)
                scores[rows, k - 1] = best[rows, j - k] + np.where(piece[rows] >= 0, self.score[piece[rows]], self.least)
            top = most - 1 - scores[:, ::-1].argmax(axis=1)  # of equal scores, the longest piece
            row = np.arange(n)
            best[:, j] = scores[row, top]
            back[:, j] = top + 1
            for k in range(1, most + 1):
                rows = np.flatnonzero(top == k - 1)
                last[rows, j] = table[k][rows, j - k]
        out, at = np.zeros((n, length), np.int64), np.full(n, length)
        used = np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            piece = last[live, at[live]]
            piece = np.where(piece < 0, -1 - plain[live, at[live] - 1].astype(np.int64), piece)
            used[live] += 1
            out[live, length - used[live]] = piece
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        return out[np.arange(length) >= (length - used)[:, None]], used

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has; words may begin with a run of blanks."""
        by: dict[int, list[int]] = {}
        runs = []
        for i, w in enumerate(words):
            if w.startswith(BLANK * 2):
                runs.append(i)
            else:
                by.setdefault(len(w), []).append(i)
        flat, count, order = [], [], []
        for length, where in by.items():
            size = max(1, 400_000 // (length * min(length, self.longest)))
            for k in range(0, len(where), size):
                part = where[k : k + size]
                pieces, used = self.viterbi([words[i] for i in part])
                if (pieces < 0).any():
                    spelled = [self._spell(x) for x in np.split(pieces, np.cumsum(used)[:-1])]
                    pieces, used = np.concatenate(spelled), np.array([len(x) for x in spelled])
                flat.append(pieces)
                count.append(used)
                order += part
        for i in runs:
            pieces = self._after_blanks(words[i])
            flat.append(pieces)
            count.append(np.array([len(pieces)]))
            order.append(i)
        pieces, used, place = np.concatenate(flat), np.concatenate(count), np.argsort(np.array(order))
        start = np.cumsum(used) - used
        return gather(pieces, start[place], used[place]), used[place]

    def _after_blanks(self, word: str) -> np.ndarray:
        """A run takes in the blank of the word after it unless that merged into the word."""
        rest = word.lstrip(BLANK)
        run = len(word) - len(rest)
        if not rest:
            return np.array(self.blanks(run), np.int64)
        ids = self.words([BLANK + rest])[0]
        if self.bpe and ids[0] != self.ids.get(BLANK, -1):
            return np.concatenate((np.array(self.blanks(run - 1), np.int64), ids))
        if self.bpe:
            return np.concatenate((np.array(self.blanks(run), np.int64), ids[1:]))
        options = [(self._worth(x), x) for x in (np.concatenate((np.array(self.blanks(run - 1), np.int64), ids)), np.concatenate((np.array(self.blanks(run), np.int64), self.words([rest])[0])))]
        return max(options, key=lambda o: o[0])[1]

    def _worth(self, ids: np.ndarray) -> float:
        return float(np.where(ids == self.unknown, self.least, self.score[ids]).sum())

    def _spell(self, pieces: np.ndarray) -> np.ndarray:
        ids: list[int] = []
        for p in pieces.tolist():
            if p >= 0:
                ids.append(p)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, np.int64)

    def blanks(self, n: int) -> list[int]:
        return [self.ids[p] for p in self.merge(BLANK * n)] if self.bpe else self._run(n)

    def _run(self, n: int) -> list[int]:
        """The best split of a run of blanks under a unigram model."""
        best: list[tuple[float, list[int]]] = [(0.0, [])]
        for j in range(1, n + 1):
            options = [(best[j - k][0] + self.score[self.ids[BLANK * k]], k) for k in self.runs if k <= j]
            if not options:
                best.append((best[j - 1][0] + self.least, [*best[j - 1][1], self.unknown]))
                continue
            score, k = max(options)
            best.append((score, [*best[j - k][1], self.ids[BLANK * k]]))
        return best[n][1]


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]``, one after another."""
    ends = np.cumsum(length)
    return values[np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Encodes texts; remembers the pieces of up to ``CACHED`` words by their hashes."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.known = np.empty(0, U64)
        self.start, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, count = self.pieces.words(words)
        known = np.concatenate((self.known, hashes))
        start = np.concatenate((self.start, np.cumsum(count) - count + len(self.ids)))
        order = np.argsort(known)
        self.known, self.start, self.count = known[order], start[order], np.concatenate((self.count, count))[order]
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        flat, ends = self.flat(texts)
        return np.split(flat, ends[:-1]) if len(texts) else []

    def flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's ids end.

        Texts are cut into words and looked up in runs of about ``RUN_CHARS``
        characters; new words of all runs are learnt at once.
        """
        if len(self.known) > CACHED:
            self.clear()
        runs, fresh, words = [], [np.empty(0, U64)], []
        for run in text_runs(texts, RUN_CHARS):
            distinct, which, ends, hashes, found = self._cut(run)
            runs.append((distinct, which, ends))
            fresh.append(hashes)
            words += found
        if words:
            hashes, first = np.unique(np.concatenate(fresh), return_index=True)
            self._learn(hashes, [words[i] for i in first.tolist()])
        flat, stops, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for distinct, which, ends in runs:
            of = np.searchsorted(self.known, distinct)[which]
            count = self.count[of]
            flat.append(gather(self.ids, self.start[of], count))
            stops.append(np.concatenate(([0], np.cumsum(count)))[ends] + at)
            at += len(flat[-1])
        return np.concatenate(flat), np.concatenate(stops)

    def _cut(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Distinct hashes of the words of texts, which of them each word has, the number of words up to each text's end; hashes of unknown words and these."""
        lead = " " if self.pieces.prefix else ""
        joined = "".join(lead + t if t else "" for t in texts).replace(" ", BLANK)
        if not joined:
            return np.empty(0, U64), np.empty(0, np.int32), np.zeros(len(texts), np.int64), np.empty(0, U64), []
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + len(lead) if t else 0 for t in texts])
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = self.pieces.cuts(codes)
        cut[ends] = True
        at = np.flatnonzero(cut)
        start, length = at[:-1], np.diff(at)
        power, inverse = _powers(len(codes) + 1)
        total = np.zeros(len(codes) + 1, U64)
        np.cumsum(mix64(codes.astype(U64) + U64(1)) * power[:-1], out=total[1:])
        hashes = mix64((total[at[1:]] - total[start]) * inverse[start] + length.astype(U64) * U64(0x9E3779B97F4A7C15))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != distinct[inside]
        where = first[new]
        words = [joined[a : a + n] for a, n in zip(start[where].tolist(), length[where].tolist(), strict=True)]
        return distinct, which.astype(np.int32), np.searchsorted(start, ends), distinct[new], words


def text_runs(texts: Sequence[str], most: int) -> Iterator[Sequence[str]]:
    """Texts cut into runs of about ``most`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield texts[start:]


class Decoder:
    """Decodes ids: bytes of all pieces, gathered in one go."""

    def __init__(self, pieces: Pieces):
        raw = [t.replace(BLANK, " ").encode() for t in pieces.text]
        for b, i in pieces.bytes.items():
            raw[i] = bytes([b])
        raw[pieces.unknown] = " ⁇ ".encode()
        self.prefix = pieces.prefix
        self.length = np.array([len(r) for r in raw])
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.data = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        length = self.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[ids] - ends + length, length) + np.arange(total)
        text = self.data[take].tobytes()
        if self.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


_LOADED: dict[bytes, tuple[Pieces, Encoder, Decoder]] = {}


def load(data: bytes) -> tuple[Pieces, Encoder, Decoder]:
    """Tables, encoder and decoder of a model, kept for the life of a worker."""
    key = hashlib.blake2b(data, digest_size=16).digest()
    if key not in _LOADED:
        pieces = Pieces(data)
        _LOADED[key] = pieces, Encoder(pieces), Decoder(pieces)
    return _LOADED[key]


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        data = file.read(MOST_MODEL + 1)
    if len(data) > MOST_MODEL:
        raise ValueError("the model is too large to broadcast")
    Pieces(data)  # unsupported models fail here and not on an executor
    return docs.sparkSession.sparkContext.broadcast(data)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs(doc_id, text)``, as the model's own library encodes it.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows
    are encoded as often as they occur; other columns are ignored; an empty
    table gives an empty result. Texts are encoded whole. The model file is
    read on the driver, at most ``MOST_MODEL`` bytes, and broadcast.
    """
    held = _model(docs, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, _ = load(held.value)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                ids, ends = encoder.flat([t or "" for t in batch.column("text").to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) for every row of ``coded(doc_id, ids)``; null and empty ids give an empty text, broken bytes U+FFFD."""
    held = _model(coded, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(held.value)[2]
        for batch in batches:
            ids = batch.column("ids")
            texts = [decoder.decode(np.array(i.as_py() or [], np.int64)) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_chars, n_pieces, ids_sha256, round_trip): each text encoded and decoded again.

    ``ids_sha256`` is that of the ids as little-endian 32-bit numbers;
    ``round_trip`` tells whether decoding gives the text back (U+2581 stands
    for a blank, so texts that hold it don't come back). For odd rows see
    ``encode``.
    """
    held = _model(docs, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder, decoder = load(held.value)
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = encoder.encode(texts)
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]),
                    pa.array([decoder.decode(i) == t for i, t in zip(ids, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "n_pieces", "ids_sha256", "round_trip"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_chars long, n_pieces long, ids_sha256 string, round_trip boolean")
