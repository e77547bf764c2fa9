"""Personal data: fixed patterns, and a conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- fixed patterns ------------------------------------------------------------------
# Fixed values of the task. Local part and domain are matched from the "@" outwards, and runs
# of digits from their first digit, which finds the same leftmost matches in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, by kind, then start."""
    found: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        match = DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            found.append(("email", begin, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    if re.search("[0-9]", text) is None:
        return found
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


# ---- the labelled table --------------------------------------------------------------
# Own lines; [kind:...] marks a span.
TABLE = """
call me at [phone:(415) 555-0132] before noon
phone: [phone:415-555-0199] or write
my number is [phone:555-0142] thanks
tel [phone:020 7946 0958] office
please dial [phone:(030) 555-2671] today
reach us on [phone:+1 (212) 555-0175] now
mobile [phone:0171 555 0123] evenings
fax [phone:415.555.0111] and phone [phone:415.555.0112]
write to [email:mary dot jones at example dot com] please
mail [email:john at example dot org] for help
email: [email:sam (at) example.net] soon
contact [email:lee [at] mail.example.com] again
send it to [email:ann_b at mail.example.org] tomorrow
my address is [email:kim.w@example.com] here
from [email:jo@mail3.example.org] with thanks
card [card:4539 1488 0343 6467] expires
paid with [card:4539148803436467] in full
number [card:6011-0009-9013-9424] on file
words [card:9807915762804490] more words
host [ip:192.168.10.24] is down
the server [ip:10.0.0.7] answered
login from [ip:203.0.113.55] failed
page 12 of 300 is missing
it happened on 2024-05-13 at 12:30
version 1.2.3 was released in 2019
the price is 400 or 1,250.00 in total
see chapter 7 and section 3.14 there
isbn 978-3-16-148410-0 in print
order 20240513-0042 was shipped
room 415 on floor 2 at noon
there were 1200 people at the market
pages 100-200 and 300-400 of it
we met at the station on monday
he looked at the dot on the map
she was at home and the phone was off
write your name at the top of the page
call the office or mail the form
the com port at the back is broken
words and more words of plain text here
und das ist ein Satz mit Worten
une phrase avec des mots et rien
esto es una frase con palabras
| one | two | 33 | four |
HELLO!! THIS IS LOUD!! REALLY!!
token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" thanks
score 3-2 after 90 minutes
id 555-01 and lot 42-7719 in stock
between 1914 and 1918 or 1939-1945
100 200 300 400 500
""".strip().split("\n")


def parse_table(lines: list[str]) -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of marked lines; a label is O, or B- or I- and the kind."""
    parsed = []
    for line in lines:
        tokens: list[str] = []
        labels: list[str] = []
        at = 0
        for m in re.finditer(r"\[(email|ip|card|phone):(.*?(?:\[at\].*?)?)\]", line):
            plain = line[at : m.start()].split()
            own = m.group(2).split()
            tokens += plain + own
            labels += ["O"] * len(plain) + ["B-" + m.group(1)] + ["I-" + m.group(1)] * (len(own) - 1)
            at = m.end()
        rest = line[at:].split()
        parsed.append((tokens + rest, labels + ["O"] * len(rest)))
    return parsed


# ---- the model -----------------------------------------------------------------------

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
PUNCTUATION = ".,;:!?\"'"


def shape_of(word: str) -> str:
    """Digits as 9, runs of letters as a, all else as it is; without punctuation around."""
    word = word[:64].strip(PUNCTUATION)
    if word.isalpha() or not word:
        return "a" if word else ""
    return re.sub("a+", "a", "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word))


def viterbi(emit: np.ndarray, lengths: np.ndarray, begin: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of sequences that stand one after the other in `emit` (tokens, labels).

    All sequences go on together, place by place, the longest first; those at their end
    drop out.
    """
    order = np.argsort(-lengths, kind="stable")
    firsts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    back = np.zeros(emit.shape, dtype=np.int8)
    labels = np.zeros(len(emit), dtype=np.int8)
    best = begin + emit[firsts]
    final = np.zeros(len(sizes), dtype=np.int64)
    live = len(sizes)
    longest = int(sizes[0]) if live else 0
    for t in range(1, longest + 1):
        still = int(np.searchsorted(-sizes, -t, side="left"))  # sizes over t
        final[still:live] = best[still:live].argmax(axis=1)
        live = still
        if not live:
            break
        reach = best[:live, :, None] + move
        at = firsts[:live] + t
        back[at] = reach.argmax(axis=1)
        best = reach.max(axis=1) + emit[at]
    now = np.zeros(len(sizes), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        ending = sizes[:live] == t + 1
        now[:live] = np.where(ending, final[:live], now[:live])
        at = firsts[:live] + t
        labels[at] = now[:live]
        now[:live] = back[at, now[:live]]
    return labels


@dataclass
class Tagger:
    """A linear-chain field: weights of shapes and cue words of a token and its neighbours.

    Shapes and words that the table does not hold have no weight, so a token is one of a
    fixed number of types, by the shape and the cue word it has, and `emit` has the weights
    of each type as the token itself, as the one before and as the one behind.
    """

    shapes: dict[str, int]  # 1, 2, ...; 0 is any other
    cues: dict[str, int]
    emit: np.ndarray  # (3, types, labels)
    begin: np.ndarray
    move: np.ndarray

    def type_of(self, word: str) -> int:
        cue = self.cues.get(word[:32].strip(PUNCTUATION).lower(), 0)
        return self.shapes.get(shape_of(word), 0) * (len(self.cues) + 1) + cue

    def emissions(self, types: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first = np.zeros(len(types), dtype=bool)
        first[np.cumsum(lengths) - lengths] = True
        last = np.roll(first, -1)
        emit = self.emit[0][types]
        emit += np.where(first[:, None], 0, np.roll(self.emit[1][types], 1, axis=0))
        emit += np.where(last[:, None], 0, np.roll(self.emit[2][types], -1, axis=0))
        return emit

    def label(self, types: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(types):
            return np.zeros(0, dtype=np.int8)
        return viterbi(self.emissions(types, lengths), lengths, self.begin, self.move)


def _pieces(theta: np.ndarray, n_shapes: int, n_cues: int) -> tuple:
    k = len(LABELS)
    sizes = [3 * n_shapes * k, 3 * n_cues * k, k, k * k]
    a, b, c, d = np.split(theta, np.cumsum(sizes)[:-1])
    return a.reshape(3, n_shapes, k), b.reshape(3, n_cues, k), c, d.reshape(k, k)


def train(lines: list[str] = TABLE, rounds: int = 150, decay: float = 0.02) -> Tagger:
    """Maximises the log likelihood of the labelled lines less a decay (forward-backward)."""
    rows = parse_table(lines)
    shapes = {s: i + 1 for i, s in enumerate(sorted({shape_of(w) for t, _ in rows for w in t}))}
    cues = {w: i + 1 for i, w in enumerate(sorted({w.strip(PUNCTUATION).lower() for t, _ in rows for w in t if w.strip(PUNCTUATION).isalpha()}))}
    n_shapes, n_cues, k = len(shapes) + 1, len(cues) + 1, len(LABELS)
    longest = max(len(t) for t, _ in rows)
    size = np.array([len(t) for t, _ in rows])
    s = np.zeros((len(rows), longest + 2), dtype=int)
    c = np.zeros_like(s)
    y = np.zeros((len(rows), longest), dtype=int)
    for r, (tokens, labels) in enumerate(rows):
        for i, (w, l) in enumerate(zip(tokens, labels, strict=True)):
            s[r, i + 1], c[r, i + 1], y[r, i] = shapes[shape_of(w)], cues.get(w.strip(PUNCTUATION).lower(), 0), LABELS.index(l)
    inside = np.arange(longest) < size[:, None]
    real = np.pad(inside, ((0, 0), (1, 1)))
    theta = np.zeros(3 * n_shapes * k + 3 * n_cues * k + k + k * k)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    views = [(slice(1, longest + 1)), slice(0, longest), slice(2, longest + 2)]  # self, before, behind
    one = np.eye(k)
    for step in range(1, rounds + 1):
        of_shape, of_cue, begin, move = _pieces(theta, n_shapes, n_cues)
        emit = sum(
            (of_shape[j][s[:, v]] + of_cue[j][c[:, v]]) * real[:, v, None] for j, v in enumerate(views)
        )
        forward = np.zeros((len(rows), longest, k))
        backward = np.zeros_like(forward)
        forward[:, 0] = begin + emit[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + move, axis=1) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            there = inside[:, t + 1, None]
            ahead = np.logaddexp.reduce(move + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(there, ahead, 0)
        z = np.logaddexp.reduce(forward[np.arange(len(rows)), size - 1], axis=1)
        p = np.exp(forward + backward - z[:, None, None]) * inside[:, :, None]
        wrong = (one[y] - p) * inside[:, :, None]
        slope_s, slope_c = np.zeros_like(of_shape), np.zeros_like(of_cue)
        for j, v in enumerate(views):
            np.add.at(slope_s[j], s[:, v], wrong * real[:, v, None])
            np.add.at(slope_c[j], c[:, v], wrong * real[:, v, None])
        pair = forward[:, :-1, :, None] + move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :]
        pair = np.exp(pair - z[:, None, None, None]) * inside[:, 1:, None, None]
        seen = one[y[:, :-1]][:, :, :, None] * one[y[:, 1:]][:, :, None, :] * inside[:, 1:, None, None]
        slope = np.concatenate(
            [slope_s.ravel(), slope_c.ravel(), wrong[:, 0].sum(axis=0), (seen - pair).sum(axis=(0, 1)).ravel()]
        ) - decay * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    of_shape, of_cue, begin, move = _pieces(theta, n_shapes, n_cues)
    emit = (of_shape[:, :, None, :] + of_cue[:, None, :, :]).reshape(3, n_shapes * n_cues, k)
    return Tagger(shapes, cues, emit.astype(np.float32), begin.astype(np.float32), move.astype(np.float32))


# ---- spans of texts ------------------------------------------------------------------

# What str.split() takes for white space.
_SPACES = np.zeros(0x3002, dtype=bool)
_SPACES[[c for c in range(0x3001) if chr(c).isspace()]] = True


def _plausible(kind: str, text: str) -> bool:
    """Marks that an added span must bear besides its label; cards and ips have none and are
    not added."""
    digits = len(_digits(text))
    if kind == "phone":
        return 7 <= digits <= 15 and re.fullmatch(r"[+()\x20.0-9/-]+", text) is not None
    return kind == "email" and re.search(r"(?i)\bat\b|@", text) is not None and re.search(r"(?i)\bdot\b|\.", text) is not None


def added_spans(tagger: Tagger, texts: list[str], known: dict[str, int]) -> list[list[Span]]:
    """Spans that the field finds in each text, line by line."""
    found: list[list[Span]] = [[] for _ in texts]
    whole = "\n".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = ~_SPACES[np.minimum(codes, 0x3001)]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = whole.split()
    if not words:
        return found
    if len(known) > 300_000:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = tagger.type_of(w)
    types = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    line = np.cumsum(codes == 10)[starts]
    lengths = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(line)]]))
    # Lines of plain words alone differ by their length only: one of each length is decoded.
    plain = known.setdefault("x", tagger.type_of("x"))
    special = np.add.reduceat(types != plain, np.cumsum(lengths) - lengths) > 0
    of_length = {n: tagger.label(np.full(n, plain), np.array([n])).any() for n in np.unique(lengths[~special]).tolist()}
    decoded = special | np.array([of_length.get(n, False) for n in lengths.tolist()])
    token = np.repeat(decoded, lengths)
    labels = np.zeros(len(types), dtype=np.int8)
    labels[token] = tagger.label(types[token], lengths[decoded])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    k = 0
    marked = np.flatnonzero(labels)
    while k < len(marked):
        head = marked[k]
        kind = LABELS[labels[head]][2:]
        last = k
        while (
            last + 1 < len(marked)
            and marked[last + 1] == marked[last] + 1
            and LABELS[labels[marked[last + 1]]] == "I-" + kind
            and line[marked[last + 1]] == line[head]
        ):
            last += 1
        a, b = int(starts[head]), int(ends[marked[last]])
        while a < b and whole[a] in PUNCTUATION:
            a += 1
        while b > a and whole[b - 1] in PUNCTUATION:
            b -= 1
        doc = int(np.searchsorted(offsets, a, side="right")) - 1
        if _plausible(kind, whole[a:b]):
            found[doc].append((kind, a - int(offsets[doc]), b - int(offsets[doc])))
        k = last + 1
    return found


def all_spans(base: list[Span], added: list[Span]) -> list[Span]:
    """The base spans and the added ones that overlap none of them, by kind, then start."""
    free = [s for s in added if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
    return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> Column:
    """Struct of FOUND for each whole text: counts and digest of the base spans, all spans.

    The field adds only spans of phones and emails. It labels cards and ips too, but no marks
    tell these from other numbers, so they come from the fixed patterns alone.

    Null texts are empty and have no spans. Only the text is looked at, so null ids, repeated
    rows and further columns change nothing.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger or train())

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = []
            for texts in slices(batch):
                for own, more in zip(texts, added_spans(shared.value, texts, known), strict=True):
                    base = base_spans(own)
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows.append((*counts, digest, joined(all_spans(base, more))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(find, FOUND)(F.col(text).cast("string"))


def masked(docs: DataFrame, spans: Column, text: str = "text") -> Column:
    """The text with each span replaced by its kind in brackets; null stays null."""

    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for own, joined_spans in zip(texts, found, strict=True):
            if isinstance(own, str) and joined_spans:
                end = len(own) + 1
                cut = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in joined_spans.split(","))]
                for a, b, kind in sorted(cut, reverse=True):
                    # Of spans that overlap, the later stays whole and the earlier ends before it.
                    own = own[:a] + f"[{kind}]" + own[min(b, end) :]
                    end = a
            out.append(own)
        return pd.Series(out, dtype=object)

    mask.__annotations__ = {"texts": pd.Series, "found": pd.Series, "return": pd.Series}
    return F.pandas_udf(mask, "string")(F.col(text).cast("string"), spans)
