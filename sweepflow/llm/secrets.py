"""Secret scans: three base patterns and a novelty measure.

Base kinds are fixed patterns, matched leftmost and without overlap, each kind
on its own. The novelty kind looks at long key-like strings that no base span
touches and that stand shortly before or after a sensitive word, and at what
follows a `=` in them, with the name before it as part of what may be sensitive.

zstandard is primed with a dictionary: common identifiers of code, and the most
frequent words and identifiers of the corpus itself, counted over all texts, as
many as fit into Novelty.dictionary bytes. With it the text around a candidate
is compressed without and with the candidate at its end. What the candidate
adds, in bytes for each of its characters, is its novelty. Strings made of words
that were seen before add little, random ones can't be compressed and are
reported. The limit depends on the length, since short strings cost more for
each character, and on the kinds of characters, which bound what a random string
can add. Words with digits never enter the dictionary, so that a key that is
copied often stays new.

Null text counts as empty. Spans are in code points, end exclusive, and cover
the whole match. Every row is judged by itself, given the dictionary, so
repeated rows, ties and empty tables need no rule; words that are equally
frequent enter the dictionary by code point. A text of any length is scanned as
a whole. Carried columns whose names clash with a result's give way to it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, aside, back, written

#: The base patterns in the order in which kinds are listed, with the least length of what counts.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest run of fewer characters would fail in any case
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ["assign", "access", "hex", "novel"]

IDENTIFIERS = (
    "import export return function class const static public private protected void string number boolean null true false undefined "
    "self this super new delete async await yield lambda def elif else finally except raise throw catch try while for break continue "
    "request response header headers body status error message config settings options default value values key keys index count size "
    "length offset limit name names path file files dir directory host port user username account email address url uri http https www "
    "com org net html json xml yaml csv text data database table column row query select insert update where from join group order by "
    "get set put post add remove create read write open close start stop init main test example sample version build release debug info "
    "warn log logger print format encode decode parse serialize client server service session cookie cache queue thread process event "
    "handler callback listener manager factory provider controller model view template component module package library the and of to "
    "in is that it was with as on be at by this have or one had not but what all were when your can said there use an each which she do "
    "der die und den von das mit sich des auf ist el la que los del las por con una les des est pour dans qui sur pas plus par"
)


@dataclass(frozen=True)
class Novelty:
    """Parameters of the novelty kind. `limits` are a and b of the limit a + b / length in bytes for each character, for strings with digits, with letters of both cases, and others."""

    least: int = 12
    letters: int = 4
    context: int = 512
    sensitive_near: int = 48
    dictionary: int = 32768
    longest_word: int = 24
    limits: tuple[tuple[float, float], ...] = ((0.62, 1.2), (0.82, 0.8), (0.74, 0.8))
    identifiers: str = IDENTIFIERS
    sensitive: str = r"pass(?:word|wd|phrase|code)|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(?:orization)?|bearer|credential|signature|client[_ -]?id|connection[_ -]?string"


def corpus_dictionary(docs: DataFrame, text: str = "text", novelty: Novelty = Novelty()) -> bytes:
    """The dictionary: rarer words first, frequent ones and the identifiers of code last, where they are cheapest to refer to.

    A histogram of the counts tells from which count on the words are few
    enough, so no more than these come to the driver.
    """
    words = docs.select(F.explode(F.split(F.col(f"`{text}`"), r"[^\p{L}_]+")).alias("word")).where(F.length("word").between(2, novelty.longest_word))
    counts = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    step, total, least = F.floor(F.log2("n") * 16), 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += r["count"]
        if total > novelty.dictionary // 3:  # a word takes three bytes or more
            break
        least = r["step"]
    top = counts.where(step >= least).collect() if least is not None else []
    data, room = [], novelty.dictionary - len(novelty.identifiers.encode())
    for r in sorted(top, key=lambda r: (-r["n"], r["word"])):
        room -= len(r["word"].encode()) + 1
        if room < 0:
            break
        data.append(r["word"])
    return " ".join([*reversed(data), novelty.identifiers]).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


class Scanner:
    """Finds all spans of a text. One is made in each task."""

    def __init__(self, novelty: Novelty = Novelty(), dictionary: bytes | None = None):
        self.novelty = novelty
        self.long = re.compile(rf"[A-Za-z0-9+/_.=-]{{{novelty.least},}}")
        self.sensitive = re.compile(novelty.sensitive, re.IGNORECASE | re.ASCII)
        primed = zstandard.ZstdCompressionDict(dictionary or novelty.identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)

    def added(self, before: str, candidate: str, after: str) -> float:
        """Bytes that the candidate adds to the compressed text around it, for each of its characters."""
        size = lambda x: len(self.compressor.compress(x.encode("utf-8", "surrogatepass")))
        return (size(after + before + candidate) - size(after + before)) / len(candidate)

    def limit(self, piece: str) -> float:
        kind = 0 if any(c.isdigit() for c in piece) else 1 if piece != piece.lower() and piece != piece.upper() else 2
        a, b = self.novelty.limits[kind]
        return a + b / len(piece)

    @staticmethod
    def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
        while e > s and text[e - 1] in "._=-/+":
            e -= 1
        while s < e and text[s] in "._=-/+":
            s += 1
        return s, e

    def values(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """What follows each `=` within a run, base64 padding at its end included."""
        parts = [m.span() for m in re.finditer("[^=]+", text[start:end])]
        out = []
        for i, (s, e) in enumerate(parts):
            if s:  # there is a name or at least a `=` before it
                if i == len(parts) - 1 and end - start - e <= 2:
                    e = end - start
                out.append((start + s, start + e))
        return out

    def novel(self, text: str, s: int, e: int, name: int, taken: list[tuple[int, int]], k: int, words: list[tuple[int, int]]) -> bool:
        """Whether a candidate is long enough without sensitive words in it, free of base spans, near a sensitive word (the name glued to it included), and new."""
        p = self.novelty
        if e - s < p.least or sum(c.isalpha() for c in text[s:e]) < p.letters:
            return False
        first = bisect_left(words, (max(0, min(name, s - p.sensitive_near)), 0))
        near = words[first : bisect_left(words, (e + p.sensitive_near, 0))]
        inside = sum(min(b, e) - max(a, s) for a, b in near if a < e and b > s)
        if e - s - inside < p.least or not any(b <= s or a >= e for a, b in near):
            return False
        while k < len(taken) and taken[k][0] < e:
            if taken[k][1] > s:
                return False
            k += 1
        return self.added(text[max(0, s - p.context) : s], text[s:e], text[e : e + p.context]) >= self.limit(text[s:e])

    def novel_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found, words = [], [m.span() for m in self.sensitive.finditer(text)]
        taken, k = sorted((s, e) for s, e, _ in base), 0
        for m in self.long.finditer(text) if words else ():
            start, end = m.span()
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            values = [v for v in self.values(text, start, end) if self.novel(text, *v, start, taken, k, words)]
            if not values:
                s, e = self.trimmed(text, start, end)
                if self.novel(text, s, e, s, taken, k, words):
                    values = [(s, e)]
            found += [(s, e, 3) for s, e in values]
        return found

    def scan(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans, each by start and then by kind."""
        base = base_spans(text or "")
        return base, sorted([*base, *self.novel_spans(text or "", base)], key=lambda x: (x[0], x[2]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, text: str = "text", keep: list[str] | None = None, novelty: Novelty = Novelty()) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_novel, base_sha256 and spans to each document."""
    dictionary = corpus_dictionary(docs, text, novelty)
    fields = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("n_novel", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]

    def start():
        scanner = Scanner(novelty, dictionary)

        def work(texts):
            out = {n: [] for n, _ in fields}
            for base, spans in map(scanner.scan, texts):
                for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_novel")):
                    out[n].append(sum(x[2] == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return work

    return annotate(docs, start, fields, text, keep)


def mask_secrets(docs: DataFrame, text: str = "text", novelty: Novelty = Novelty()) -> DataFrame:
    """Replaces what spans cover by <SECRET>, overlapping spans by one; other columns and rows stay. Null text stays null."""

    dictionary = corpus_dictionary(docs, text, novelty)

    def start():
        scanner = Scanner(novelty, dictionary)

        def mask(value):
            if value is None:
                return None
            parts, end = [], 0
            for s, e, _ in scanner.scan(value)[1]:
                if s >= end:
                    parts += [value[end:s], "<SECRET>"]
                end = max(end, e)
            return "".join([*parts, value[end:]])

        return lambda texts: {"masked": [mask(t) for t in texts]}

    columns = docs.columns
    masked = annotate(docs.select(*aside(columns), F.col(f"`{text}`").alias("text")), start, [("masked", T.StringType())], "text", [f"carried {i}" for i in range(len(columns))])
    return masked.select(*[F.col("masked").alias(c) if c == text else x for c, x in zip(columns, back(columns))])
