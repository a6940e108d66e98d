"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Patterns find plain emails, addresses, cards and phone numbers. The field finds
the same kinds as people disguise or shorten them: ``jo [at] mail [dot] example
[dot] org``, ``(017) 555-7713``, ``192[.]0[.]2[.]7``, ``4111.1111.1111.1111``.
It is trained from a small labelled table on word shapes of a token and its
neighbours, and decoded by Viterbi over many stretches of tokens at once.

A token far from digits, @ and bracketed cues can only be outside of personal
data (its other labels are masked), so the best path of a whole text is the
join of the best paths of the stretches between such tokens, and these alone
are decoded. What the field proposes must pass its kind's own check (digits,
Luhn, parts up to 255, an @ or a cue) and may not overlap a pattern's span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_CUE = re.compile(r"[\[({<]\s*(?:at|dot|\.|@)\s*[\])}>]", re.IGNORECASE)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def _small(parts: Sequence[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def patterns(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and without overlap in each kind, by start and then kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # from each @ back to the start of its local part: linear on any text
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", domain.end() if domain else at + 1)
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _small(m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= len(m[0]):
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ------------------------------------------------------------------ features


def shape(token: str) -> str:
    """Letters as a or A, one for each run; digits as 9, kept up to 16; other characters as they are."""
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", token[:48])
    return re.sub(r"[0-9]", "9", out)


def kind_of(token: str) -> str:
    bare = token.strip(".,;:!?\"'*#%&$").lower()
    if bare.strip("[](){}<>") in ("at", "dot") and bare[:1] in "[({<":
        return bare.strip("[](){}<>")
    if _CUE.search(token):
        return "cue"
    digits = sum(c in "0123456789" for c in bare)
    if "@" in bare:
        return "@"
    if bare in ("tel", "phone", "call", "fax", "mobile", "telephone"):
        return "tel"
    if digits:
        mixed = any(c.isalpha() for c in bare)
        return f"{'x' if mixed else 'd'}{min(digits, 20)}" + ("p" if bare[:1] in "(+0" else "")
    return "w" if bare.isalpha() else "s"


def features(tokens: Sequence[str]) -> list[list[str]]:
    marks = [(shape(t.strip(".,;:!?\"'*#%&$")), kind_of(t)) for t in tokens]
    edge = ("", "-")
    out = []
    for i, (s, k) in enumerate(marks):
        (ls, lk), (rs, rk) = marks[i - 1] if i else edge, marks[i + 1] if i + 1 < len(marks) else edge
        out.append(["bias", f"s={s}", f"k={k}", f"l={ls}", f"r={rs}", f"lk={lk},{k}", f"kr={k},{rk}", f"lkr={lk},{k},{rk}"])
    return out


WIDTH = 8


# ------------------------------------------------------------------ training


def labelled(seed: int = 11, rows: int = 400) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences as tokens and labels, from a few templates."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    word = lambda: "".join(pick("aeiourstnlmdc") for _ in range(int(rng.integers(2, 9))))

    def with_luhn(n: int) -> str:
        head = str(rng.integers(1, 10)) + number(n - 2)
        return next(head + str(d) for d in range(10) if luhn(head + str(d)))

    def entity(kind: str) -> list[str]:
        if kind == "email":
            at, dot = pick(["[at]", "(at)", "{at}", "<at>", "[AT]", "(AT)"]), pick(["[dot]", "(dot)", "{dot}", "[DOT]"])
            if rng.random() < 0.4:
                return [word() + at + word() + dot + pick(["com", "org", "net"])]
            local = [word(), dot, word()] if rng.random() < 0.3 else [word() + pick(["", "." + word(), number(2)])]
            return [*local, at, *([word(), dot, word()] if rng.random() < 0.3 else [word()]), dot, pick(["com", "org", "net", "example"])] if rng.random() < 0.7 else [*local, at, word() + ".com"]
        if kind == "ip":
            parts = [str(rng.integers(1, 256)) for _ in range(4)]
            return [pick(["[.]", "(.)", "[dot]"]).join(parts)]
        if kind == "card":
            d = with_luhn(16)
            parts = [d[i : i + 4] for i in range(0, 16, 4)]
            return [pick([".", "/", "_"]).join(parts)] if rng.random() < 0.6 else [p + "." for p in parts[:3]] + [parts[3]]
        a, b, c = number(3), number(3), number(4)
        return pick([[f"({a})", f"{b}-{c}"], [f"({a}){b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["00" + number(2), number(2), number(7)], ["0" + number(3), number(3), number(4)]])

    def other() -> list[str]:
        return pick(
            [
                [word().capitalize() + "."],
                [f"{rng.integers(1, 30)}.{rng.integers(0, 20)}"],
                [str(rng.integers(1900, 2100))],
                [f"{rng.integers(1990, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"],
                [f"{rng.integers(1, 29)}/{rng.integers(1, 13)}/{rng.integers(1990, 2030)}"],
                [f"${number(3)},{number(3)}.{number(2)}"],
                ["token", "=", '"' + "".join(pick("0123456789abcdef") for _ in range(40)) + '"'],
                ["version", str(rng.integers(1, 9)) + "."],
                ["pages", f"{rng.integers(1, 99)}-{rng.integers(100, 300)}"],
                [number(16)],
                [f"{number(3)}.{number(2)}.{number(3)}.{number(2)}"],
                [f"{word()}.{number(2)}@mail{number(1)}.example.com"],
                ["+1", f"({number(3)})", f"555-{number(4)}"],
                ["No.", number(int(rng.integers(1, 8)))],
                ["ISBN", f"978-{number(1)}-{number(3)}-{number(5)}-{number(1)}"],
                [word(), "at", word()],
                ["at", word(), "(" + word() + ")"],
                [f"({rng.integers(1, 99)})", word()],
                [f"{number(2)}:{number(2)}"],
                [f"{number(1)}e{number(2)}", word() + number(1)],
            ]
        )

    table = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 4))):
                tokens.append(word() + pick(["", "", "", ",", ".", "***"]))
                labels.append("O")
            if rng.random() < 0.55:
                kind = pick(KINDS)
                part = entity(kind)
                if rng.random() < 0.3:
                    part[-1] += pick([".", ",", "!!", ";"])
                labels += [f"{'I' if k else 'B'}-{kind}" for k in range(len(part))]
            else:
                part = other()
                labels += ["O"] * len(part)
            tokens += part
        if tokens:
            table.append((tokens, labels))
    return table


class Field:
    """Weights of the features and transitions; small enough to be broadcast."""

    def __init__(self, vocabulary: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.vocabulary, self.emit, self.move = vocabulary, emit, move

    def codes(self, rows: Sequence[Sequence[str]], length: int) -> np.ndarray:
        out = np.full((len(rows), length, WIDTH), len(self.vocabulary), np.int64)
        for n, tokens in enumerate(rows):
            for i, names in enumerate(features(tokens)):
                out[n, i] = [self.vocabulary.get(f, len(self.vocabulary)) for f in names]
        return out

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best labels of (stretch, token, label) scores, all stretches of one length; O stands before and after each."""
        n, length, k = scores.shape
        best = scores[:, 0] + self.move[0]
        back = np.zeros((n, length, k), np.int64)
        for i in range(1, length):
            reach = best[:, :, None] + self.move
            back[:, i] = reach.argmax(axis=1)
            best = np.take_along_axis(reach, back[:, i][:, None], axis=1)[:, 0] + scores[:, i]
        path = np.zeros((n, length), np.int64)
        path[:, -1] = (best + self.move[:, 0]).argmax(axis=1)
        for i in range(length - 1, 0, -1):
            path[:, i - 1] = np.take_along_axis(back[:, i], path[:, i][:, None], axis=1)[:, 0]
        return path


def _never() -> np.ndarray:
    """Moves that no labelling has: I of a kind follows B or I of that kind only."""
    out = np.zeros((len(LABELS), len(LABELS)), bool)
    for b, label in enumerate(LABELS):
        if label[0] == "I":
            out[:, b] = True
            out[[LABELS.index(f"{p}-{label[2:]}") for p in "BI"], b] = False
    return out


def train(table: Sequence[tuple[Sequence[str], Sequence[str]]], rounds: int = 70, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Maximum likelihood with an L2 penalty, by full gradients of forward-backward over all sentences at once."""
    vocabulary: dict[str, int] = {}
    for tokens, _ in table:
        for names in features(tokens):
            for f in names:
                vocabulary.setdefault(f, len(vocabulary))
    k, v = len(LABELS), len(vocabulary)
    never = _never()
    field = Field(vocabulary, np.zeros((v + 1, k)), np.where(never, -1e4, 0.0))
    length = np.array([len(t) for t, _ in table])
    most = int(length.max())
    codes = field.codes([t for t, _ in table], most)
    gold = np.zeros((len(table), most), np.int64)
    for n, (_, labels) in enumerate(table):
        gold[n, : len(labels)] = [LABELS.index(x) for x in labels]
    live = np.arange(most) < length[:, None]
    one = np.eye(k)[gold] * live[:, :, None]
    moves = np.zeros((k, k))
    np.add.at(moves, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
    np.add.at(moves, (0, gold[:, 0]), 1)
    np.add.at(moves, (gold[np.arange(len(table)), length - 1], 0), 1)
    rows = np.arange(len(table))
    state = [np.zeros_like(x) for x in (field.emit, field.emit, field.move, field.move)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for step in range(1, rounds + 1):
        e = field.emit[codes].sum(axis=2)
        fore, hind = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0] + field.move[0]
        for i in range(1, most):
            fore[:, i] = lse(fore[:, i - 1][:, :, None] + field.move, 1) + e[:, i]
        hind[:, most - 1] = field.move[:, 0]
        for i in range(most - 2, -1, -1):
            inner = lse(field.move + (e[:, i + 1] + hind[:, i + 1])[:, None, :], 2)
            hind[:, i] = np.where((i == length - 1)[:, None], field.move[:, 0], inner)
        total = lse(fore[rows, length - 1] + field.move[:, 0], 1)
        seen = np.exp(fore + hind - total[:, None, None]) * live[:, :, None]
        grad_e = np.zeros_like(field.emit)
        np.add.at(grad_e, codes, np.broadcast_to((one - seen)[:, :, None, :], (*codes.shape, k)))
        grad_e[v] = 0
        expected = np.zeros((k, k))
        for i in range(1, most):
            both = fore[:, i - 1][:, :, None] + field.move + (e[:, i] + hind[:, i])[:, None, :] - total[:, None, None]
            expected += (np.exp(both) * live[:, i][:, None, None]).sum(axis=0)
        expected[0] += seen[:, 0].sum(axis=0)
        expected[:, 0] += seen[rows, length - 1].sum(axis=0)
        grad_m = np.where(never, 0.0, moves - expected)
        for weight, grad, a, b in ((field.emit, grad_e, *state[:2]), (field.move, grad_m, *state[2:])):
            grad = grad / len(table) - decay * np.where(np.abs(weight) < 1e3, weight, 0)
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            weight += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    field.move[never] = -1e4
    return field


# ------------------------------------------------------------------ decoding


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of token spans that are not bound to be outside: those within two tokens of a digit, an @ or a bracketed cue."""
    spots = [m.start() for m in re.finditer(r"[0-9@]|[\[({<]\s*(?:at|dot|\.)\s*[\])}>]", text, re.IGNORECASE)]
    if not spots:
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([a for a, _ in tokens])
    hot = np.unique(np.searchsorted(starts, np.array(spots), side="right") - 1)
    near = np.unique(np.clip((hot[:, None] + np.arange(-2, 3)).ravel(), 0, len(tokens) - 1))
    return [[tokens[i] for i in run] for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1)]


def propose(field: Field, texts: Sequence[str]) -> list[list[Span]]:
    """Checked spans of the field in each text."""
    work: dict[int, list[tuple[int, list[tuple[int, int]], list[str]]]] = {}
    out: list[list[Span]] = [[] for _ in texts]
    for n, text in enumerate(texts):
        for run in stretches(text):
            work.setdefault(len(run), []).append((n, run, [text[a:b] for a, b in run]))
    for length, items in work.items():
        for start in range(0, len(items), max(1, 20_000 // length)):
            part = items[start : start + max(1, 20_000 // length)]
            path = field.viterbi(field.emit[field.codes([t for _, _, t in part], length)].sum(axis=2))
            for (n, run, _), labels in zip(part, path, strict=True):
                if labels.any():
                    out[n] += _read_labels(texts[n], run, labels)
    return out


def _read_labels(text: str, run: list[tuple[int, int]], labels: np.ndarray) -> list[Span]:
    found, i = [], 0
    while i < len(run):
        name = LABELS[labels[i]]
        j = i + 1
        if name[0] == "B":
            while j < len(run) and LABELS[labels[j]] == f"I-{name[2:]}":
                j += 1
            span = _check(text, name[2:], run[i][0], run[j - 1][1])
            if span:
                found.append(span)
        i = j
    return found


def _check(text: str, kind: str, start: int, end: int) -> Span | None:
    """The span without punctuation at its ends, if it is what its kind must be."""
    while start < end and not (text[start].isalnum() or (kind == "phone" and text[start] in "(+")):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    body = text[start:end]
    digits = "".join(c for c in body if c in "0123456789")
    letters = any(c.isalpha() for c in body)
    if kind == "email":
        plain = re.sub(r"\s*[\[({<]\s*at\s*[\])}>]\s*", "@", body, flags=re.IGNORECASE)
        plain = re.sub(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", ".", plain, flags=re.IGNORECASE)
        good = patterns(plain) == [("email", 0, len(plain))] and plain != body
    elif kind == "ip":
        parts = re.split(r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", body, flags=re.IGNORECASE)
        good = len(parts) == 4 and all(p and p.strip("0123456789") == "" for p in parts) and _small(parts)
    elif kind == "card":
        good = not letters and 12 <= len(digits) <= 19 and luhn(digits)
    else:
        good = not letters and 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?[\x20().0-9/-]+", body)) and body.count(".") != 3
    return (kind, start, end) if good else None


def find(field: Field, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, all spans) of each text, each sorted by start and kind."""
    base = [patterns(t) for t in texts]
    out = []
    for own, extra in zip(base, propose(field, texts), strict=True):
        more = [s for s in extra if all(s[2] <= b[1] or s[1] >= b[2] for b in own)]
        out.append((own, sorted({*own, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))))
    return out


def written(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ------------------------------------------------------------------ operators


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for whole in batches:
        for batch in slices(whole, column):
            yield batch, [t or "" for t in batch.column(column).to_pylist()]


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added) for every row of ``docs(doc_id, text)``.

    The counts and ``base_sha256`` are those of the patterns; ``spans`` has all
    spans, those of the field included, and ``added`` counts the latter. Spans
    are kind:start:end in code points, the end exclusive, by start and then
    kind. A null text is empty and has none; a null doc_id stays null; repeated
    rows are read as often as they occur; other columns are ignored; an empty
    table gives an empty result. Texts are read whole.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or train(labelled()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "text"):
            found = find(held.value, texts)
            columns = [batch.column("doc_id")]
            columns += [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            columns.append(pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([written(spans) for _, spans in found], pa.string()))
            columns.append(pa.array([len(spans) - len(base) for base, spans in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added long")


def redact(docs: DataFrame, field: Field | None = None, mask: str = "[{kind}]") -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by ``mask``; overlapping spans are one, named for the first.

    All rows and all other columns stay as they are, null texts too.
    """
    held = docs.sparkSession.sparkContext.broadcast(field or train(labelled()))

    def cut(text: str, spans: Sequence[Span]) -> str:
        out, at = [], 0
        for kind, a, b in spans:
            if a >= at:
                out += [text[at:a], mask.format(kind=kind)]
            at = max(at, b)
        return "".join([*out, text[at:]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "text"):
            found = find(held.value, texts)
            new = [None if old is None else cut(t, spans) for old, t, (_, spans) in zip(batch.column("text").to_pylist(), texts, found, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
