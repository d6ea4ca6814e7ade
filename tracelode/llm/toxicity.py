"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words that look disguised are restored by Viterbi decoding. Each written character opens a column of a lattice: a letter is itself,
or dropped where it repeats the letter before; a digit or symbol is itself, a letter that it stands for (LEET), or dropped; a
separator between single characters is a word end or dropped. Paths are weighed by these channel costs and a character trigram
model of the training texts. Disguised are: words with digits or symbols among letters or mostly of symbols that stand for letters,
letters repeated three times or more, and runs of single characters with separators. A symbol repeated at a word's edge is
decoration, but where it may stand for a letter the word is decoded with it too. Other words are their own restoration.

Every distinct word of the restored text gets the largest log odds of its features (the word, its first letters, the word without
doubled letters), learnt from document counts in the toxic and other training texts. The TOP largest of a text give its probability
by logistic regression, in which both classes weigh the same and whose own inputs leave the text itself out of the counts.

Training uses the whole texts of all labelled documents outside the held-out fold (crc32(doc_id as text) mod 5 = 0); lang, source and
doc_id are no inputs. It counts on the executors: the driver gets the character trigrams, the features of two or more toxic texts and,
per task, the sums of a Newton step. Scoring covers the whole of every text.

Cases: null and empty texts have no words and get the score of a text without any toxic word; repeated rows get equal scores; ids
without a label, with a null label or with both labels aren't trained on; without labels of both classes the score is the share of class 1 (0 with
none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm import common as C
from tracelode.llm.labelled import every

TOP, SHRINK = 4, 4.0
THRESHOLD = 0.5
#: Letters that a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "#": "h", "%": "x", "&": "a", "*": "aeiou"}
#: Channel costs in nats: a digit or symbol kept, read as a letter, dropped (if it may be a letter: less likely); a repeated letter
#: dropped; a separator dropped, kept.
KEPT, READ, DROPPED, LETTER_DROPPED, REPEAT, GAP, END = 6.0, 1.0, 4.0, 12.0, 1.5, 0.5, 1.0
#: Distinct words whose counts one task keeps, and of which one worker remembers what little it needs to.
MEMO, REMEMBERED = 300_000, 1_000_000
#: Ends of words up to so many characters whose decoding is remembered, and letters by which the bounds of odds are kept.
TAIL, HEAD = 8, 5

AGAIN, START, STOP = "\0", "\1\1", "\2"
_EDGE = ".,;:?!\"'()[]{}<>*$%&#|=-_+~^/\\`´«»¿¡…"
_SOFT = ".,;:?\"'()[]{}<>«»¿¡…"
_AFTER = _SOFT + "!"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]")
#: Single characters with one or two separators between them, as many as there are; and where such a chain may end.
_CHAIN = re.compile(r"(?<!\S)[^\s.\-_](?:[ .\-_]{1,2}[^\s.\-_])*+")
_CHAIN_END = re.compile(r"[^\s.\-_](?!\S)")
_CHAIN_CHARACTER = re.compile(r"[^\s.\-_]")
#: Any spaced word has its second and third character like this; most texts have none, and this finds that out faster.
_SPACED = re.compile(r"[ .\-_][^\s.\-_][ .\-_]{1,2}[^\s.\-_](?![^\s.\-_])")
_DOUBLE = re.compile(r"(.)\1+")


def chains(text: str) -> Iterator[str]:
    """Words whose characters are spaced out: chains of three or more, up to the last character that white space or the end follows.
    All places of a chain have the same last one, so each is gone through once."""
    for m in _CHAIN.finditer(text):
        ends = [e.end() for e in _CHAIN_END.finditer(text, m.start(), min(len(text), m.end() + 1)) if e.end() <= m.end()]
        if ends and len(_CHAIN_CHARACTER.findall(text, m.start(), ends[-1])) > 2:
            yield text[m.start() : ends[-1]]


def trigrams(word: str) -> list[str]:
    s = START + word + STOP
    return [s[i - 2 : i + 1] for i in range(2, len(s))]


class Letters:
    """Character trigrams of words with interpolated shorter contexts, in nats."""

    def __init__(self, words: Iterable[str]) -> None:
        self.count(Counter(t for w in words for t in trigrams(w)))

    @classmethod
    def of(cls, tri: Counter[str]) -> Letters:
        out = cls.__new__(cls)
        out.count(tri)
        return out

    def count(self, tri: Counter[str]) -> None:
        self.tri, self.bi, self.one, self.after2, self.after1 = tri, Counter(), Counter(), Counter(), Counter()
        for k, n in tri.items():
            self.bi[k[1:]] += n
            self.one[k[2]] += n
            self.after2[k[:2]] += n
            self.after1[k[1]] += n
        self.total = sum(self.one.values())
        self.known: dict[str, float] = {}
        self.tails: dict[tuple[str, str], str] = {}

    def cost(self, before: str, c: str) -> float:
        k = before + c
        if (x := self.known.get(k)) is None:
            p = (self.one[c] + 0.5) / (self.total + 200)
            p = (self.bi[k[1:]] + 3 * p) / (self.after1[k[1]] + 3)
            p = (self.tri[k] + 3 * p) / (self.after2[k[:2]] + 3)
            x = self.known[k] = -math.log(p)
            if len(self.known) > 1 << 18:
                self.known.clear()
        return x


@lru_cache(4096)
def column(c: str) -> list[tuple[str, float]]:
    if c.isalpha():
        return [(c, 0.0), (AGAIN, REPEAT)]
    if c in " .-_":
        return [("", GAP), (" ", END)]
    return [(c, KEPT), ("", LETTER_DROPPED if c in LEET and c not in "*#&%" else DROPPED), *((x, READ) for x in LEET.get(c, ""))]


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """For each character what it may be ('' is dropped, ' ' a word's end) and at which cost; AGAIN: the letter before, dropped."""
    return [column(c) for c in written]


def choose(before: str, written: str, at: int, letters: Letters) -> tuple[str, str, int]:
    """The cheapest path from one state and place to where all paths meet in one state again, or to the end: its letters, that
    state, the place."""
    states: dict[str, tuple[float, tuple]] = {before: (0.0, ())}
    known = letters.known
    while at < len(written):
        options = column(written[at])
        at += 1
        nxt: dict[str, tuple[float, tuple]] = {}
        for before, (cost, path) in states.items():
            for c, extra in options:
                if c == AGAIN:
                    if before[1] != options[0][0]:
                        continue
                    k, total, way = before, cost + extra, path
                elif c == "":
                    k, total, way = before, cost + extra, path
                elif c == " ":
                    if before == START:
                        continue
                    k, total, way = START, cost + extra + letters.cost(before, STOP), (path, " ")
                else:
                    x = known.get(before + c)
                    k, total, way = before[1] + c, cost + extra + (letters.cost(before, c) if x is None else x), (path, c)
                if k not in nxt or total < nxt[k][0]:
                    nxt[k] = total, way
        states = nxt
        if len(states) == 1:
            break
    _, before, path = min(((cost + letters.cost(before, STOP) if before != START else cost, before, path) for before, (cost, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out)), before, at


def restore(written: str, letters: Letters) -> str:
    """The cheapest path through the lattice under the character model; words are separated by blanks. While there is one state,
    what follows depends on it alone: letters other than the one before leave no choice, and short ends are remembered."""
    out, before, at, end = [], START, 0, len(written)
    while at < end:
        first, last = at, before[1]
        while at < end and (c := written[at]) != last and c.isalpha():
            at, last = at + 1, c
        if at > first:
            out.append(written[first:at])
            before = (before + written[max(first, at - 2) : at])[-2:]
        if at == end:
            break
        tail = (before, written[at:]) if end - at <= TAIL else None
        part = letters.tails.get(tail)
        if part is not None:
            out.append(part)
            break
        part, before, at = choose(before, written, at, letters)
        out.append(part)
        if tail and at == end:
            if len(letters.tails) >= MEMO:
                letters.tails.clear()
            letters.tails[tail] = part
    return "".join(out)


def spaced(low: str, letters: Letters) -> list[str]:
    """The words of runs of single characters with separators."""
    return [w for s in chains(low) for w in restore(s, letters).split()] if _SPACED.search(low) else []


def disguised(word: str) -> bool:
    return bool(_TRIPLE.search(word) or _OTHER.search(word) and (_MIXED.search(word) or all_symbols(word)))


def all_symbols(word: str) -> bool:
    """Whether all of it may stand for letters, most of it is symbols, not digits, and it isn't one symbol repeated."""
    return len(word) > 2 and word != word[0] * len(word) and all(c in LEET for c in word) and 2 * sum(c.isdigit() for c in word) < len(word)


def undecorated(word: str) -> str:
    """Without a symbol that is repeated before the word, and one that is repeated after it."""
    if word[:1] == word[1:2] and not word[:1].isalnum():
        word = word.lstrip(word[:1])
    if word[-1:] == word[-2:-1] and not word[-1:].isalnum():
        word = word.rstrip(word[-1:])
    return word


class Restorer:
    """Restored words of texts; each distinct word is decoded once while it is remembered."""

    def __init__(self, letters: Letters) -> None:
        self.letters = letters
        self.memo: dict[str, tuple[str, ...]] = {}
        self.same: set[str] = set()

    def word(self, token: str) -> tuple[str, ...]:
        whole = token.rstrip(_AFTER)
        if whole.isalpha() and not _TRIPLE.search(whole):
            return (whole,)
        bare = undecorated(whole).strip(_SOFT)
        whole = whole.strip(_SOFT)
        # what looks like decoration may be letters, as in a$$
        more = {whole} if len(bare) < len(whole) and all(c in LEET for c in whole.replace(bare, "", 1)) and disguised(whole) else set()
        if bare.isalpha() and not _TRIPLE.search(bare) and not more:
            return (bare,)
        w = bare.strip(_EDGE)
        if not disguised(bare) and not more:
            return (w,) if w else ()
        shapes = {x for x in (w, bare) if x and disguised(x)} | more
        found = [w] if w else []
        for x in shapes:
            for part in restore(x, self.letters).split():
                found.append(part.strip(_EDGE))
        return tuple(dict.fromkeys(x for x in found if x))

    def words(self, text: str) -> set[str]:
        low = text.lower()
        tokens, memo, same = set(low.split()), self.memo, self.same
        other = tokens.difference(same)
        out = tokens.difference(other)
        for t in other:
            got = memo.get(t)
            if got is None:
                if len(memo) + len(same) >= REMEMBERED:
                    memo.clear()
                    same.clear()
                got = self.word(t)
                if got == (t,):
                    same.add(t)
                else:
                    memo[t] = got
            out.update(got)
        out.update(spaced(low, self.letters))
        return out


def features(word: str) -> list[str]:
    out = [word, f"={_DOUBLE.sub(r'\1', word)}"]
    out += [f"{word[:n]}*" for n in (4, 5, 6, 7) if len(word) > n]
    return out


def best(odds: dict[str, float], word: str) -> float:
    """The largest of its features' odds, 0 at least."""
    get, n = odds.get, len(word)
    out = max(0.0, get(word, 0.0), get("=" + _DOUBLE.sub(r"\1", word), 0.0))
    if n > 4:
        out = max(out, get(word[:4] + "*", 0.0))
        if n > 5:
            out = max(out, get(word[:5] + "*", 0.0))
            if n > 6:
                out = max(out, get(word[:6] + "*", 0.0))
                if n > 7:
                    out = max(out, get(word[:7] + "*", 0.0))
    return out


class Listed:
    """Counts in how many texts each of some features is. Of each word it remembers a row of the places of its features."""

    def __init__(self, listed: list[str]) -> None:
        self.listed = listed

    def start(self) -> None:
        """For each task; the rows serve all tasks of the worker."""
        if not hasattr(self, "place"):
            self.place = {f: i for i, f in enumerate(self.listed, 1)}
            self.row: dict[str, int] = {}
            self.rows = np.zeros((4096, 6), np.int32)
        self.n = np.zeros(len(self.listed) + 1, np.int64)  # the first: of features that aren't listed

    def places(self, word: str) -> list[int]:
        out = [self.place.get(f, 0) for f in features(word)]
        return out + [0] * (6 - len(out))

    def add(self, text: str) -> None:
        """text: the words with a blank between them."""
        words, row = text.split(" "), self.row
        if len(row) + len(words) > REMEMBERED:
            row.clear()
        at = list(map(row.get, words))
        if None in at:
            new = list({w for w, r in zip(words, at) if r is None})
            end = len(row) + len(new)
            while end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(row) : end] = [self.places(w) for w in new]
            row.update(zip(new, range(len(row), end)))
            at = list(map(row.get, words))
        self.n[self.rows[at].ravel()] += 1  # once for each place, however often it is there


class Largest:
    """The TOP largest values of the distinct words of a text, largest first. A token whose words' values aren't known is worked out
    only if the bound for its first letters is above the least of those found so far."""

    def __init__(self, odds: dict[str, float], restorer: Restorer | None = None, most: int = REMEMBERED) -> None:
        self.odds, self.restorer, self.most = odds, restorer, most
        self.above: dict[str, float] = {}
        for f, v in odds.items():
            # a feature may be a word, "=" and a word, or first letters and "*", whatever its characters
            for head in {f[:HEAD], *((f[1 : HEAD + 1],) if f[:1] == "=" else ()), *((f[:-1][:HEAD],) if f[-1:] == "*" else ())}:
                if v > self.above.get(head, 0.0):
                    self.above[head] = v
        self.bound: dict[str, float] = {}
        self.known: dict[str, list[tuple[str, float]]] = {}

    def limit(self, token: str) -> float:
        """No value of the token's words is above it."""
        word = token
        if self.restorer:
            word = token.rstrip(_AFTER)
            if not word.isalpha():
                return math.inf
        single = _DOUBLE.sub(r"\1", word)
        if self.restorer and len(single) + 1 < len(word) and _TRIPLE.search(word):
            return math.inf
        get = self.above.get
        out = max(get(word[:HEAD], 0.0), get(word[:4], 0.0))
        return out if len(single) == len(word) else max(out, get(single[:HEAD], 0.0))

    def work_out(self, token: str) -> list[tuple[str, float]]:
        words = self.restorer.word(token) if self.restorer else (token,)
        got = [(w, v) for w in words if (v := best(self.odds, w)) > 0]
        self.bound[token] = max((v for _, v in got), default=0.0)
        if got:
            self.known[token] = got
        return got

    def __call__(self, tokens: set[str], words: Iterable[str] = ()) -> list[float]:
        """Of the words of tokens, and of words that are restored already."""
        found: dict[str, float] = {}
        least = 0.0

        def add(more: Iterable[tuple[str, float]]) -> float:
            for w, v in more:
                if v > least or len(found) < TOP:
                    found[w] = v
            while len(found) > TOP:
                del found[min(found, key=found.__getitem__)]
            return min(found.values()) if len(found) == TOP else 0.0

        bound, known, new = self.bound, self.known, []
        for t, most in zip(tokens, map(bound.get, tokens)):
            if most is None:
                new.append(t)
            elif most > least:
                got = known.get(t)
                least = add(self.work_out(t) if got is None else got)
        if len(bound) + len(new) > self.most:
            bound.clear()
            known.clear()
        for t in new:
            most = self.limit(t)
            if most > least:
                least = add(self.work_out(t))
            else:
                bound[t] = most
        for w in words:
            if (v := best(self.odds, w)) > least:
                least = add([(w, v)])
        return sorted(found.values(), reverse=True)


class Model:
    def __init__(self, letters: Letters, odds: dict[str, float], weights: np.ndarray) -> None:
        self.letters, self.odds, self.weights = letters, odds, weights

    def start(self) -> None:
        """Once per worker: what it remembers serves all tasks of the worker."""
        if not hasattr(self, "largest"):
            self.restorer = Restorer(self.letters)
            self.largest = Largest(self.odds, self.restorer)

    def score(self, text: str) -> float:
        low = text.lower()
        top = self.largest(set(low.split()), spaced(low, self.letters))
        z = self.weights[-1] + sum(a * b for a, b in zip(self.weights, top))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


# Training: what it counts, for rows on the driver (train) and for tables (fit) alike


def plain(token: str) -> str:
    """What of a token of a lower-cased text teaches the character model."""
    x = token.strip(_EDGE)
    return x if x.isalpha() and not _TRIPLE.search(x) else ""


def times(n: int) -> int:
    """How often a word that comes n times counts for the character model."""
    return 1 + int(math.log2(n))


def seen_in(words: Iterable[str]) -> set[str]:
    """The features of one text."""
    return {f for w in words for f in features(w)}


class Odds:
    """Log odds of the features that two or more toxic texts have: all (the model's), and for texts of class 0 and 1 with themselves left
    out of the counts."""

    def __init__(self, n0: dict[str, int], n1: dict[str, int], sizes: np.ndarray) -> None:
        eps = SHRINK / sizes.min()
        odd = lambda a, b: math.log((b / sizes[1] + eps) / (a / sizes[0] + eps))
        counts = [(f, n0.get(f, 0), n) for f, n in n1.items() if n > 1]
        self.all = {f: v for f, a, b in counts if (v := odd(a, b)) > 0.2}
        self.without = {f: v for f, a, b in counts if a and (v := odd(a - 1, b)) > 0}, {f: v for f, a, b in counts if f in self.all and (v := odd(a, b - 1)) > 0}

    def inputs(self, rows: Iterable[tuple[int, set[str]]]) -> np.ndarray:
        """The regression's inputs of (label, words): the TOP largest values and 1."""
        if not hasattr(self, "largest"):  # once per worker
            self.largest = [Largest(o, most=REMEMBERED // 2) for o in self.without]
        out = []
        for y, words in rows:
            top = self.largest[y](words)
            out.append(top + [0.0] * (TOP - len(top)) + [1.0])
        return np.array(out).reshape(-1, TOP + 1)


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the loss in which both classes weigh the same, as rows of one array."""
    weight = np.where(y == 1, 0.5 / sizes[1], 0.5 / sizes[0]) * sizes.sum()
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.vstack([x.T @ ((p - y) * weight), (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x])


def newton(total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights that make the loss with a ridge least; total: sums() of all rows for given weights."""
    w = np.zeros(TOP + 1)
    ridge = np.full(TOP + 1, 0.5)
    ridge[TOP] = 1e-6
    for _ in range(40):
        both = total(w)
        step = np.linalg.solve(both[1:] + np.diag(ridge), both[0] + ridge * w)
        w -= step * min(1.0, 3 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return w.round(9)  # the order in which tasks are summed doesn't show


def train(rows: list[tuple[int, bytes]], share: float) -> Model | float:
    """The model of rows that the driver has."""
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return share if len(y) else 0.0
    texts = [t.decode(errors="ignore") for _, t in rows]
    counts = Counter(x for t in texts for w in t.lower().split() if (x := plain(w)))
    letters = Letters(w for w, n in counts.items() for _ in range(times(n)))
    restorer = Restorer(letters)
    sizes = np.array([(y == 0).sum(), (y == 1).sum()], float)
    each = [(int(k), restorer.words(t)) for k, t in zip(y, texts)]
    n0, n1 = (Counter(f for k, words in each if k == c for f in seen_in(words)) for c in (0, 1))
    odds = Odds(n0, n1, sizes)
    x = odds.inputs(each)
    return Model(letters, odds.all, newton(lambda w: sums(x, y, w, sizes)))


def _counted(rows: DataFrame, column: str, of: Callable[[str], Iterable[str]], key: Callable[[str], str] | None = None) -> DataFrame:
    """(key, n): how often `of` gives each key for the values of a column; with key(): how often what key() makes of it, if not empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def pack() -> pa.RecordBatch:
            found = seen
            if key:
                found = Counter()
                for x, n in seen.items():
                    if k := key(x):
                        found[k] += n
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

        for batch in batches:
            for t in C.blobs(batch[column]):
                seen.update(of(t.decode(errors="ignore")))
                if len(seen) >= MEMO:
                    yield pack()
                    seen.clear()
        yield pack()

    return rows.select(column).mapInArrow(each, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _trigrams(texts: DataFrame) -> Counter[str]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for w, n in zip(batch["key"].to_pylist(), batch["n"].to_pylist()):
                for t in trigrams(w):
                    seen[t] += times(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["key", "n"])

    words = _counted(texts, "text", lambda t: t.lower().split(), plain)
    return Counter(dict(words.mapInArrow(each, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()))


def _restored(texts: DataFrame, letters: Letters) -> DataFrame:
    """(label, words) of (label, text), the words with a blank between them."""
    sent = texts.sparkSession.sparkContext.broadcast(Restorer(letters))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = sent.value
        for batch in batches:
            words = [" ".join(restorer.words(t.decode(errors="ignore"))) for t in C.blobs(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(words, pa.string())], ["label", "words"])

    return C.stored(texts.mapInArrow(each, "label int, words string"), "restored")


def _counted_of(words: DataFrame, listed: list[str]) -> dict[str, int]:
    """In how many rows of words each of the listed features is."""
    sent = words.sparkSession.sparkContext.broadcast(Listed(listed))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        counts.start()
        for batch in batches:
            for t in C.blobs(batch["words"]):
                counts.add(t.decode())
        n = counts.n[1:]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["place", "n"])

    found = words.select("words").mapInArrow(each, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    return {listed[i]: n for i, n in found.collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model that train() makes of all labelled documents outside the held-out fold."""
    found, share = every(docs, labels, "toxic")
    texts = C.stored(found, "labelled")
    count = dict(texts.groupBy("label").count().collect())
    if len(count) < 2:
        return share if count else 0.0
    sizes = np.array([count[0], count[1]], float)
    letters = Letters.of(_trigrams(texts))
    words = _restored(texts, letters)
    C.drop_stored(texts)
    n1 = dict(_counted(words.filter("label = 1"), "words", lambda t: seen_in(t.split(" "))).filter("n > 1").collect())
    odds = Odds(_counted_of(words.filter("label = 0"), sorted(n1)), n1, sizes)
    sent = docs.sparkSession.sparkContext.broadcast(odds)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch["label"].to_pylist()
            x = sent.value.inputs((k, set(t.decode().split(" "))) for k, t in zip(y, C.blobs(batch["words"])))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), *(pa.array(c) for c in x.T)], ["y", *(f"x{i}" for i in range(TOP + 1))])

    values = C.stored(words.mapInArrow(inputs, "y int, " + ", ".join(f"x{i} double" for i in range(TOP + 1))), "inputs")
    C.drop_stored(words)

    def total(w: np.ndarray) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((TOP + 2, TOP + 1))
            for batch in batches:
                y, *x = (c.to_numpy() for c in batch.columns)
                out += sums(np.stack(x, axis=1), y, w, sizes)
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        return np.sum([r["s"] for r in values.mapInArrow(each, "s array<double>").collect()], axis=0).reshape(TOP + 2, TOP + 1)

    return Model(letters, odds.all, newton(total))


def scored(docs: DataFrame, model: Model | float, column: str = "score") -> DataFrame:
    """docs with the probability of toxicity as a further column; one of this name is replaced."""
    C.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # character trigrams, and the odds of features of toxic texts
    docs = docs.drop(column)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if isinstance(m, Model):
            m.start()
        for batch in batches:
            s = [m if isinstance(m, float) else m.score(t.decode()) for t in C.blobs(batch["text"])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(s, pa.float64())], [*names, column])

    return docs.mapInArrow(each, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
