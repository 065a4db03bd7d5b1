"""Texts that were decoded with the wrong character encoding: finding and restoring them.

A hidden Markov model runs over the words of a text that hold other than ASCII characters
(ASCII is the same in all states and tells nothing). One state is *clean*; every other state
is an encoding pair (bytes written in T were read as W), in which the characters seen are the
image of a text that the inverse transform gives back. A state emits a word with the
probability that a character model gives to the word's restored form; the character model
(pairs of characters and of letter shapes) is counted over the whole corpus first. Going into a
state costs, staying is free, so that many weak signs in a row decide as one strong one does.
The best path (Viterbi) labels the words; each labelled span is restored by its inverse. A last
state, *lost*, emits only the replacement character and has no inverse.

Words are scored once per task: their emissions are kept in a table of fixed greatest size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import importable

#: The single-byte encodings considered, the first one winning ties.
CODECS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac-roman", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-9")
LOST = "�"
#: Costs (natural logarithms) of entering a state: words that are valid UTF-8 are rarely so by chance.
ENTER_UTF8, ENTER_BYTE, LEAVE = 3.0, 14.0, 1.0
#: What a word costs that its state cannot have written.
IMPOSSIBLE = 12.0
#: Words kept by a task at most.
MEMO = 200_000
#: Longest word scored whole; a longer one is scored in parts of this length.
LONGEST = 256

#: Encodings by script, and those in whose place a text's own may stand anywhere.
FAMILIES = (("cp1250", "iso8859-2"), ("cp1251", "koi8-r", "cp866", "iso8859-5"), ("cp1253", "iso8859-7"), ("cp1254", "iso8859-9"))
WESTERN = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman")
#: Encodings that are part of another one considered, and so never the true one.
PARTS = ("latin-1", "iso8859-9")
#: What it costs if typographic punctuation, which is ordinary in any text, would become a letter, and if a character is lost.
PUNCTUATION, UNKNOWN = 4.0, 8.0

WORDS = re.compile(r"(?<![^ \t\r\n])[\x00-\x08\x0b\x0c\x0e-\x1f!-\x7f]*+[^\x00-\x7f][^ \t\r\n]*")


def plausible(true: str, seen: str) -> bool:
    """Whether bytes of one encoding are read as another one in practice: within a script, or to or from a Western one."""
    if true == seen or true in PARTS:
        return False
    if seen in WESTERN or (true == "cp1252"):
        return True
    return any(true in f and seen in f for f in FAMILIES)


def parts_of(text: str) -> list[tuple[int, int]]:
    """Where the words lie that hold other than ASCII characters.

    A run of more than LONGEST characters without a space (as of scripts that write none) is
    labelled in parts. It is cut before an ASCII character or, without one, between sequences of
    UTF-8 in the encoding in which it holds most of them.
    """
    out = []
    for m in WORDS.finditer(text):
        a, end = m.span()
        while end - a > LONGEST:
            b = next((i for i in range(a + LONGEST, a, -1) if text[i].isascii()), None) or a + _between_sequences(text[a : a + LONGEST + 4])
            out.append((a, b))
            a = b
        out.append((a, end))
    return out


_SEQUENCE = re.compile(r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _between_sequences(part: str) -> int:
    """The last place up to LONGEST that lies in no sequence, by the encoding with most of them."""
    spans = max(([m.span() for m in _SEQUENCE.finditer(part.translate(_backward(c)))] for c in CODECS), key=lambda found: sum(b - a for a, b in found))
    return next((a for a, b in spans if a < LONGEST < b and a), LONGEST)


def words_of(text: str) -> list[str]:
    """The words that hold other than ASCII characters; very long ones in parts (see :func:`parts_of`)."""
    words = WORDS.findall(text)
    if words and max(map(len, words)) > LONGEST:
        words = [text[a:b] for a, b in parts_of(text)]
    return words


def _table(codec: str) -> list[str]:
    """The characters of all bytes; undefined bytes stand for themselves."""
    return [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]


@lru_cache(maxsize=1)
def alphabet() -> tuple[np.ndarray, list[str]]:
    """Number of each code point (0: white space, 1: any other character) and the characters by number."""
    chars = sorted({c for codec in CODECS for c in _table(codec)} | {chr(c) for c in range(0xA0, 0x180)} | {chr(c) for c in range(0x370, 0x460)} | {LOST, "♪", "♫"} | {chr(c) for c in range(0x300, 0x330)} | {chr(c) for c in range(0x2010, 0x2040)})
    chars += [c.lower() for c in chars if len(c.lower()) == 1 and c.lower() not in set(chars)]
    lut = np.ones(0x110000, dtype=np.int16)
    names = ["\n", ""]
    for c in chars:
        if c in " \t\r\n":
            continue
        lut[ord(c)] = len(names)
        names.append(c)
    for c in " \t\r\n":
        lut[ord(c)] = 0
    return lut, names


SHAPES = 8


def _shape(c: str) -> int:
    if c == "\n":
        return 0
    if c.islower():
        return 1 if c.isascii() else 2
    if c.isupper():
        return 3 if c.isascii() else 4
    if c.isalnum():
        return 5
    return 6 if c.isascii() else 7


@lru_cache(maxsize=1)
def reduced() -> tuple[np.ndarray, np.ndarray, int]:
    """By character number: the number of its class (lower case; all digits are one) and its shape; the number of classes."""
    _, names = alphabet()
    number = {c: i for i, c in enumerate(names)}
    cls = np.array([number["0"] if c.isdigit() and c.isascii() else number.get(c.lower(), i) for i, c in enumerate(names)], dtype=np.int32)
    return cls, np.array([_shape(c) for c in names], dtype=np.int32), len(names)


def _mojibake() -> re.Pattern:
    """UTF-8 read as a Western encoding; words that hold it are kept out of the character model."""
    lead2 = "".join(_table("cp1252")[b] + _table("latin-1")[b] for b in range(0xC2, 0xE0))
    lead3 = "".join(_table("cp1252")[b] for b in range(0xE0, 0xF0))
    tail = "".join(re.escape(_table(c)[b]) for b in range(0x80, 0xC0) for c in ("cp1252", "latin-1"))
    return re.compile(rf"[{lead2}][{tail}]|[{lead3}][{tail}][{tail}]")


@lru_cache(maxsize=1)
def _skipped() -> re.Pattern:
    return _mojibake()


def count_pairs(words: dict[str, int]) -> np.ndarray:
    """Counts of class pairs, then of shape pairs, flattened, over words and their numbers."""
    lut, _ = alphabet()
    cls, shape, k = reduced()
    bad = _skipped().search
    words = {w: c for w, c in words.items() if LOST not in w and not bad(w)}
    joined = "\n" + "\n".join(words) + "\n"
    n = lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    weight = np.zeros(len(n) - 1)
    if len(words):
        weight[:] = np.repeat(np.fromiter(words.values(), dtype=np.float64, count=len(words)), lengths)
    c, s = cls[n], shape[n]
    pairs = np.bincount(c[:-1] * k + c[1:], weight, minlength=k * k)
    return np.concatenate([pairs, np.bincount(s[:-1] * SHAPES + s[1:], weight, minlength=SHAPES * SHAPES)])


class Model:
    """Log-probabilities of one class after another and of one shape after another."""

    def __init__(self, counts: np.ndarray) -> None:
        _, _, k = reduced()
        n = counts[: k * k].reshape(k, k).astype(np.float64)
        one = n.sum(axis=0)
        base = (one + 0.5) / (one.sum() + 0.5 * k)
        self.next = np.log((n + 4.0 * base) / (n.sum(axis=1, keepdims=True) + 4.0)).astype(np.float32)
        # Frames may be drawn in any corpus, however few of them this one has; so it is for what is seen,
        # not for what it is taken back to.
        self.seen = self.next.copy()
        draw = np.flatnonzero([0x2500 <= ord(c or " ") <= 0x259F for c in alphabet()[1]])
        for a, b, least in ((draw[:, None], draw[None, :], -1.5), (0, draw, -4.0), (draw, 0, -1.0)):
            self.seen[a, b] = np.maximum(self.seen[a, b], least)
        s = counts[k * k :].reshape(SHAPES, SHAPES).astype(np.float64) + 0.5
        self.shape = np.log(s / s.sum(axis=1, keepdims=True)).astype(np.float32)


def entry(pair: tuple[str, str]) -> float:
    """What it costs to enter a pair's state."""
    return ENTER_UTF8 if pair[0] == "utf-8" else ENTER_BYTE


class Scorer:
    """Readings of words: which pair could have written it, and how much likelier its restored form is."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.lut, self.names = alphabet()
        self.cls, self.shapes, _ = reduced()
        number = {c: i for i, c in enumerate(self.names)}
        tables = {c: _table(c) for c in CODECS}
        self.bytes = {}
        for c in CODECS:
            back = np.full(len(self.names), -1, dtype=np.int16)
            for b in range(255, -1, -1):
                if tables[c][b] in number:
                    back[number[tables[c][b]]] = b
            back[0] = 10
            self.bytes[c] = back
        self.pairs: list[tuple[str, str]] = []
        maps = []
        seen = set()
        for w in CODECS:
            for t in CODECS:
                if not plausible(t, w):
                    continue
                there = np.array([-1 if b < 0 else number.get(tables[t][b], 1) if b >= 128 else i for i, b in enumerate(self.bytes[w])], dtype=np.int16)
                if there.tobytes() not in seen:
                    seen.add(there.tobytes())
                    self.pairs.append((t, w))
                    maps.append(there)
        self.maps = maps
        letter = np.array([c.isalpha() for c in self.names])
        mark = np.array([c in "‘’‚“”„–—…«»" for c in self.names])
        self.costs = [np.where(mark & letter[np.maximum(m, 0)], PUNCTUATION, 0.0).astype(np.float32) for m in maps]
        self.lost = self.names.index(LOST)
        #: All states but clean, and what it costs to enter each; a word's readings are one gain per state.
        self.states = sorted([*self.pairs, *(("utf-8", codec) for codec in CODECS)])
        self.column = {p: j for j, p in enumerate(self.states)}
        self.enter = np.array([entry(p) for p in self.states], dtype=np.float32)
        self.memo: dict[str, np.ndarray] = {}

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n" + "\n".join(words) + "\n"
        n = self.lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.zeros(len(words), dtype=np.int64)
        np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
        return n, starts

    def _sums(self, n: np.ndarray, starts: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        c, s = self.cls[n], self.shapes[n]
        each = (self.model.next if table is None else table)[c[:-1], c[1:]] + self.model.shape[s[:-1], s[1:]]
        return np.add.reduceat(each - UNKNOWN * (n[1:] == self.lost), starts)

    def score(self, words: list[str]) -> np.ndarray:
        """For each word a row of gains, one per state: how much likelier the restored form is; -IMPOSSIBLE where the state cannot have written the word."""
        n, starts = self._numbers(words)
        clean = self._sums(n, starts, self.model.seen)
        found = np.full((len(words), len(self.states)), -IMPOSSIBLE, dtype=np.float32)
        for pair, there, cost in zip(self.pairs, self.maps, self.costs):
            m = there[n]
            bad = np.minimum.reduceat(m, starts) < 0
            if bad.all():
                continue
            gain = self._sums(np.where(m < 0, 1, m), starts) - clean - np.add.reduceat(cost[n], starts)
            gain[np.logical_and.reduceat(m == n, starts)] = 0.0  # written alike by both encodings
            found[~bad, self.column[pair]] = gain[~bad]
        for codec in CODECS:
            b = self.bytes[codec][n]
            lead, tail = (b[:-1] >= 0xC2) & (b[:-1] <= 0xF4), (b[1:] >= 0x80) & (b[1:] <= 0xBF)
            hit = np.logical_or.reduceat(lead & tail, starts)
            at = np.flatnonzero(hit)
            back = [restore(words[i], ("utf-8", codec)) for i in at]
            some = [(i, r) for i, r in zip(at, back) if r is not None and r != words[i]]
            if some:
                at = np.array([i for i, _ in some])
                found[at, self.column["utf-8", codec]] = self._sums(*self._numbers([r for _, r in some])) - clean[at]
        return found

    def readings(self, words: list[str]) -> None:
        """Fills the table for these words."""
        new = list({w for w in words if w not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()  # a text may have more words than MEMO: they are kept until the next one
            new = list(set(words))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.memo.update(zip(part, self.score(part)))

    def payable(self, gains: np.ndarray) -> np.ndarray:
        """The numbers of the states whose gains over a text's words, a row each, can pay for their entry; no other lies on the best path."""
        return np.flatnonzero(np.maximum(gains, 0.0).sum(axis=0) > self.enter)

    def path(self, words: list[str]) -> list[tuple[str, str] | None]:
        """The most likely state of each word (None: clean)."""
        if not words:
            return []
        gains = np.stack([self.memo[w] for w in words])
        able = self.payable(gains)
        pairs = [self.states[j] for j in able]
        enter = [0.0, *map(entry, pairs)]
        best = [0.0] + [-enter[j + 1] for j in range(len(pairs))]
        trail: list[list[int]] = []
        for row in gains[:, able].tolist():
            emit = [0.0, *row]
            if trail:
                top = max(range(len(best)), key=best.__getitem__)
                came, now = [], []
                for j in range(len(best)):
                    move = best[top] - (enter[j] if j else 0.0) - (LEAVE if top else 0.0)
                    stay = best[j] >= move
                    came.append(j if stay else top)
                    now.append((best[j] if stay else move) + emit[j])
                best = now
            else:
                came = list(range(len(best)))
                best = [x + e for x, e in zip(best, emit)]
            trail.append(came)
        j = max(range(len(best)), key=best.__getitem__)
        states: list[tuple[str, str] | None] = []
        for came in reversed(trail):
            states.append(pairs[j - 1] if j else None)
            j = came[j]
        return states[::-1]


@lru_cache(maxsize=64)
def _backward(codec: str) -> dict[int, str]:
    """For str.translate: each character of a codec to the one whose number is its byte; others stay."""
    table = _table(codec)
    return {ord(table[b]): chr(b) for b in range(255, -1, -1)} | {i: chr(i) for i in range(128)}


def restore(word: str, pair: tuple[str, str]) -> str | None:
    """The word before bytes of pair[0] were read as pair[1]; None if they cannot have been.

    UTF-8 that was read wrongly several times is taken back as often; what cannot be taken
    back of a word that is otherwise valid is left as the replacement character.
    """
    true, seen = pair
    data = word.translate(_backward(seen))
    try:
        raw = data.encode("latin-1")
    except UnicodeEncodeError:
        if true != "utf-8":
            return None
        raw = b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("utf-8", "surrogatepass") for c in data)
    if true != "utf-8":
        table = _table(true)
        return "".join(table[b] for b in raw)
    text = raw.decode("utf-8", "replace")
    if text.count(LOST) * 3 > len(text):
        return None
    if text != word and LOST not in text and not text.isascii():
        again = restore(text, pair)
        if again is not None and again != text and LOST not in again and len(again) < len(text):
            return again
    return text


def label(scorer: Scorer, text: str | None) -> list[tuple[int, int, tuple[str, str]]]:
    """The spans (start, end, pair) of a text that were decoded wrongly."""
    if not text or text.isascii():
        return []
    words = words_of(text)
    scorer.readings(words)
    if not words or LOST not in text and not len(scorer.payable(np.stack([scorer.memo[w] for w in words]))):
        return []  # no state can pay for its entry
    spans = parts_of(text)
    out = []
    for (a, b), w, state in zip(spans, words, scorer.path(words)):
        if state is None and LOST in w:
            state = (LOST, LOST)
        if state is not None:
            out.append((a, b, state))
    return out


def restored(text: str, spans: list[tuple[int, int, tuple[str, str]]]) -> str:
    """The text with each labelled span taken back."""
    parts, at = [], 0
    for a, b, pair in spans:
        back = None if pair[0] == LOST else restore(text[a:b], pair)
        parts += [text[at:a], text[a:b] if back is None else back]
        at = b
    return "".join([*parts, text[at:]])


def model(df: DataFrame, text: str) -> Model:
    """The character model of a corpus: pairs counted over all its texts.

    What reaches the driver is one number per pair of an alphabet of fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        total = None
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t and not t.isascii():
                    words.update(words_of(t))
            if len(words) > MEMO:
                total = count_pairs(words) + (0 if total is None else total)
                words.clear()
        total = count_pairs(words) + (0 if total is None else total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    importable(df.sparkSession)
    _, _, k = reduced()
    counts = np.zeros(k * k + SHAPES * SHAPES)
    for row in df.select(text).mapInArrow(run, "at int, n bigint").groupBy("at").sum("n").collect():
        counts[row[0]] = row[1]
    return Model(counts)


def wrongly_decoded(df: DataFrame, key: str, text: str, trained: Model | None = None) -> DataFrame:
    """(key, restored, states): the rows whose text holds wrongly decoded characters.

    restored is the text with every span taken back whose state has an inverse; states names
    the pairs found (``utf-8 as cp1252``; ``lost`` for replacement characters). Null, empty
    and ASCII texts are no cases. Repeated rows keep their rows; other columns are ignored.
    """
    spark = df.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(trained or model(df, text))  # one matrix over a fixed alphabet

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            foreign = [i for i, t in enumerate(texts) if t and not t.isascii()]
            scorer.readings(list({w for i in foreign for w in words_of(texts[i])}))
            found = [(i, spans) for i in foreign if (spans := label(scorer, texts[i]))]
            names = [sorted({"lost" if p[0] == LOST else f"{p[0]} as {p[1]}" for *_, p in spans}) for _, spans in found]
            keys = batch.column(0).take(pa.array([i for i, _ in found], pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([restored(texts[i], spans) for i, spans in found], pa.string()), pa.array(names, pa.list_(pa.string()))], names=[key, "restored", "states"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, restored string, states array<string>")
