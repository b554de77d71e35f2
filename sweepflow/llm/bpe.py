"""Byte-level BPE with a compiled lexicon of frequent words.

The words that occur most often in the corpus are merged once, on the driver,
and compiled into a minimal acyclic automaton with shared suffixes. The number
of words that sort before a path is kept on its edges, so that a path yields
the word's number, and that number the word's ids. The automaton, the ids and
the merges are arrays in one file that Spark ships to the executors, where it
is memory-mapped. Words that are not in the lexicon are merged exactly: the
pair of lowest rank first, the leftmost of equal ones. The lexicon decides on
speed alone, never on a result.

Decoding turns the ids back into bytes and reads them as UTF-8. Null text
counts as empty and has no ids. Special tokens in a text become their own ids.
Every row is encoded by itself, as a whole, whatever its length, so repeated rows
have equal results and ids play no part; null ids stay null. Words of equal
counts enter the lexicon together or not at all. Empty tables give empty results
and an empty lexicon. Carried columns whose names clash with a result's give way.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, written

#: Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter by which the tokenizer's file writes each byte: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@dataclass
class Merges:
    """What exact merging needs: the id of each byte, and rank and product of each pair of ids (as one number)."""

    byte_ids: list[int]
    pairs: dict[int, tuple[int, int]]
    token_bytes: list[bytes]
    special: dict[str, int]

    @staticmethod
    def read(path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(map(tuple, data["model"]["merges"]))}
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in vocab.items():
            token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        return Merges([vocab[c] for c in letters], pairs, token_bytes, special)

    def encode(self, word: bytes) -> list[int]:
        """Exact merging of one word of any length."""
        return self.encode_long([self.byte_ids[b] for b in word])

    def encode_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links between neighbours, for words of any length."""
        n, get = len(ids), self.pairs.get
        ids, before, after = list(ids), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(p[0], i, p[1], ids[i], ids[i + 1]) for i in range(n - 1) if (p := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := get(ids[x] << 32 | ids[after[x]])):
                    heapq.heappush(heap, (p[0], x, p[1], ids[x], ids[after[x]]))
        return [x for x in ids if x >= 0]


class PairTable:
    """Values of pairs of ids, found for many pairs at once. A pair is in the first free slot from its own on."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing, slots: int = 1 << 18):
        slots = max(slots, 1 << (2 * len(keys)).bit_length())
        self.last, self.missing = np.int64(slots - 1), missing
        self.keys, self.values = np.full(slots, -1, np.int64), np.full(slots, missing, values.dtype)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[at] < 0
            taken, first = np.unique(at[free], return_index=True)
            chosen = left[free][first]
            self.keys[taken], self.values[taken] = keys[chosen], values[chosen]
            rest = ~np.isin(left, chosen)
            left, at = left[rest], at[rest]
            at = np.where(self.keys[at] >= 0, (at + 1) & self.last, at)

    def slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(36)).view(np.int64) & self.last

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = self.slot(key)
        there, out = self.keys[at], self.values[at]
        wrong = there != key
        out[wrong] = self.missing
        left = np.flatnonzero(wrong & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            there = self.keys[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Merger:
    """Exact merging of many words at once, in numpy: one merge in every word in each step."""

    NONE = np.int32(1 << 30)
    WIDTHS = (8, 12, 16, 24, 32)

    def __init__(self, merges: Merges):
        self.merges = merges
        ranks = np.array([r for r, _ in merges.pairs.values()], np.int32)
        self.products = np.zeros(max(len(ranks), 1), np.int64)
        self.products[ranks] = [p for _, p in merges.pairs.values()]
        self.pairs = PairTable(np.array(list(merges.pairs), np.int64), ranks, self.NONE)
        self.byte_ids = np.array(merges.byte_ids, np.int64)
        a, b = np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")
        self.byte_pairs = self.rank(a.ravel(), b.ravel()).reshape(256, 256)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; an id below 0 is no id."""
        out = self.pairs.find(a, np.maximum(b, 0))
        out[b < 0] = self.NONE
        return out

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in self.WIDTHS:
            mine = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for s in range(0, len(mine), 8192):
                at = mine[s : s + 8192]
                for i, ids in zip(at.tolist(), self.merge_block([words[i] for i in at], sizes[at], width)):
                    out[i] = ids
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = tuple(self.merges.encode(words[i]))
        return out

    def merge_block(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[tuple[int, ...]]:
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        inside = np.arange(width) < sizes[:, None]
        ids = np.where(inside, self.byte_ids[data], -1)
        ranks = np.where(inside[:, 1:], self.byte_pairs[data[:, :-1], data[:, 1:]], self.NONE)
        ranks = np.concatenate([ranks, np.full((len(words), 1), self.NONE)], 1)
        out: list[tuple[int, ...]] = [()] * len(words)
        left = np.arange(len(words))
        while len(left):
            best = ranks.argmin(1)
            rows = np.arange(len(left))
            lowest = ranks[rows, best]
            done = lowest == self.NONE
            if done.any():
                counts = (ids[done] >= 0).sum(1).tolist()
                for i, row, n in zip(left[done].tolist(), ids[done].tolist(), counts):
                    out[i] = tuple(row[:n])
                go = ~done
                left, ids, ranks, best, lowest = left[go], ids[go], ranks[go], best[go], lowest[go]
                if not len(left):
                    break
                rows = rows[: len(left)]
            # The pair becomes its product: every row loses one place.
            ids[rows, best] = self.products[lowest]
            stays = np.ones(ids.shape, bool)
            stays[rows, best + 1] = False
            ids = ids[stays].reshape(len(left), -1)
            stays = np.ones(ranks.shape, bool)
            stays[rows, best] = False
            ranks = ranks[stays].reshape(len(left), -1)
            new, behind = ids[rows, best], ids[rows, np.minimum(best + 1, ids.shape[1] - 1)]
            ranks[rows, best] = self.rank(new, np.where(best + 1 < ids.shape[1], behind, -1))
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.rank(ids[before, best[before] - 1], new[before])
        return out


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Compiles sorted, distinct words. States with equal futures are one.

    first[s] to first[s + 1] are the edges of state s, in order of their byte;
    skip is the number of words that an edge passes over, counting the state's
    own; final tells whether a word ends in a state. State 0 is the start.
    """
    known: dict[tuple, int] = {}
    nodes: list[tuple] = []
    count: list[int] = []

    def settle(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in known:
            known[key] = len(nodes)
            nodes.append(key)
            count.append(final + sum(count[t] for _, t in edges))
        return known[key]

    # The states of the last word's path that are still open: whether final, and the edges so far.
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    last = b""
    for word in [*words, None]:
        same = 0 if word is None else len(os.path.commonprefix([last, word]))
        while len(path) > same + 1:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, edges)))
        if word is not None:
            path += [(False, []) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
    settle(*path[0])
    # The start was settled last; it becomes number 0.
    order = [len(nodes) - 1, *range(len(nodes) - 1)]
    number = {old: new for new, old in enumerate(order)}
    first, labels, targets, skips = [0], [], [], []
    for old in order:
        passed = int(nodes[old][0])
        for byte, target in nodes[old][1]:
            labels.append(byte)
            targets.append(number[target])
            skips.append(passed)
            passed += count[target]
        first.append(len(labels))
    return {"first": np.array(first, np.uint32), "labels": np.array(labels, np.uint8), "targets": np.array(targets, np.uint32), "skips": np.array(skips, np.uint32), "final": np.array([nodes[x][0] for x in order], np.uint8)}


def write_arrays(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: length of the directory, the directory, then the arrays, each at a multiple of 16."""
    directory, at = {}, 0
    for name, a in arrays.items():
        directory[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 16) * 16
    head = json.dumps(directory).encode()
    head += b" " * (-(len(head) + 8) % 16)
    with open(path, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 16))


def map_arrays(path: str) -> dict[str, memoryview]:
    with open(path, "rb") as f:
        data = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    size = int.from_bytes(data[:8], "little")
    kinds = {"|u1": "B", "<u4": "I", "<u8": "Q"}
    out = {}
    for name, (kind, n, at) in json.loads(bytes(data[8 : 8 + size])).items():
        width = int(kind[2])
        out[name] = data[8 + size + at : 8 + size + at + n * width].cast(kinds[kind])
    return out


def compile_lexicon(merges: Merges, frequent: list[str], path: str) -> None:
    """Writes merges and lexicon. A word goes in as it is and with a space before it, as it mostly stands in a text."""
    words = sorted({x for w in frequent for x in (w.encode(), b" " + w.encode())})
    encoded = [merges.encode(w) for w in words]
    automaton = minimal_automaton(words)
    pairs = sorted(merges.pairs.items(), key=lambda x: x[1])
    blob = b"".join(merges.token_bytes)
    special = json.dumps(merges.special).encode()
    write_arrays({
        **automaton,
        "id_start": np.cumsum([0, *map(len, encoded)]).astype(np.uint32),
        "ids": np.array(list(chain.from_iterable(encoded)), np.uint32),
        "byte_ids": np.array(merges.byte_ids, np.uint32),
        "pair": np.array([k for k, _ in pairs], np.uint64),
        "product": np.array([v[1] for _, v in pairs], np.uint32),
        "token_start": np.cumsum([0, *map(len, merges.token_bytes)]).astype(np.uint32),
        "token_bytes": np.frombuffer(blob, np.uint8),
        "special": np.frombuffer(special, np.uint8),
    }, path)


def merger_of(arrays: dict[str, memoryview]) -> Merger:
    pairs = {k: (i, p) for i, (k, p) in enumerate(zip(arrays["pair"], arrays["product"]))}
    return Merger(Merges(list(arrays["byte_ids"]), pairs, [], {}))


class Lexicon:
    """The memory-mapped automaton and its ids."""

    def __init__(self, arrays: dict[str, memoryview]):
        view = lambda name: np.asarray(arrays[name])
        self.first, self.labels, self.targets, self.skips, self.final, self.start, self.ids = map(view, ("first", "labels", "targets", "skips", "final", "id_start", "ids"))
        #: Edges by state and byte, which is their order in the file.
        state = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first.astype(np.int64)))
        self.keys = np.append(state << 8 | self.labels, np.int64(1) << 62)

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """The ids of each word, or None. All words take a step at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        offsets = np.cumsum(sizes) - sizes
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        found, active, j = np.zeros(len(words), bool), np.arange(len(words)), 0
        while len(active):
            done = sizes[active] == j
            found[active[done]] = self.final[state[active[done]]] != 0
            active = active[~done]
            key = state[active] << 8 | data[offsets[active] + j]
            edge = np.searchsorted(self.keys, key)
            there = self.keys[edge] == key
            active, edge = active[there], edge[there]
            number[active] += self.skips[edge]
            state[active] = self.targets[edge]
            j += 1
        out: list[tuple[int, ...] | None] = [None] * len(words)
        for i in np.flatnonzero(found).tolist():
            n = number[i]
            out[i] = tuple(self.ids[self.start[n] : self.start[n + 1]].tolist())
        return out


class Encoder:
    """Knows the words met so far with their ids; new ones come from the lexicon or else from exact merging.

    Forgets all once it knows `most` words. Texts are taken in groups of about
    `chars` characters, and a longer one in groups of words, so that what is
    held at a time has a bound.
    """

    def __init__(self, path: str, most: int = 300_000, chars: int = 250_000, group: int = 50_000):
        arrays = map_arrays(path)
        self.known: dict[str, tuple[int, ...]] = {}
        self.lexicon, self.most, self.chars, self.group = Lexicon(arrays), most, chars, group
        blob, at = bytes(arrays["token_bytes"]), list(arrays["token_start"])
        self.token_bytes = [blob[a:b] for a, b in zip(at, at[1:])]
        self.digits = list(map(str, range(len(self.token_bytes))))
        self.special = json.loads(bytes(arrays["special"]))
        self.merger = merger_of(arrays)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        ids = self.lexicon.find(data)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.merger.merge([data[i] for i in rest])):
            ids[i] = x
        self.known.update(zip(new, ids))
        self.known.update((w, (i,)) for w, i in self.special.items())

    def parts(self, text: str) -> list[str]:
        """The text cut at its special tokens."""
        return [p for p in self.cut.split(text) if p] if self.cut and self.cut.search(text) else [text]

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        waiting, held = [], 0
        for text in texts:
            if text and len(text) > self.chars:
                yield from self.encode_group(waiting)
                yield self.encode_long(text)
                waiting, held = [], 0
                continue
            waiting.append(text or "")
            held += len(waiting[-1])
            if held >= self.chars:
                yield from self.encode_group(waiting)
                waiting, held = [], 0
        yield from self.encode_group(waiting)

    def encode_group(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [[[p] if p in self.special else self.words.findall(p) for p in self.parts(t)] if t else [] for t in texts]
        self.learn(set().union(*(words for parts in cut for words in parts)) - self.special.keys())
        return (self.ids_of(chain.from_iterable(parts)) for parts in cut)

    def encode_long(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            found = iter([part]) if part in self.special else (m.group() for m in self.words.finditer(part))
            while words := list(islice(found, self.group)):
                self.learn(set(words) - self.special.keys())
                out += self.ids_of(words)
        return out

    def ids_of(self, words: Iterable[str]) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def encoder_of(name: str) -> Encoder:
    """The encoder of this worker process; later tasks go on with the words it knows."""
    return Encoder(SparkFiles.get(name))


def frequent_words(docs: DataFrame, most: int = 32768, text: str = "text") -> list[str]:
    """The words (runs of letters) that occur most often in all texts, `most` of them or, for ties, less.

    Counts are stored; a histogram of their logarithms, which has a few hundred
    rows at any size, tells from which count on words are few enough to go to
    the driver.
    """
    found = docs.select(F.explode(F.split(F.col(f"`{text}`"), r"[^\p{L}]+")).alias("word")).where("word <> '' and length(word) <= 60")
    counts = written(found.groupBy("word").count().where("count > 1"), "word-counts")
    step = F.floor(F.log2("count") * 16)
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return [] if least is None else sorted(r["word"] for r in counts.where(step >= least).select("word").collect())


def ship(spark: SparkSession, frequent: list[str], tokenizer: str | None = None) -> str:
    """Compiles the lexicon and has Spark bring it to the executors; returns the name of the file there."""
    folder = tempfile.mkdtemp(prefix="lexicon-")
    path = os.path.join(folder, f"lexicon-{uuid.uuid4().hex}.bin")
    compile_lexicon(Merges.read(tokenizer or default_tokenizer()), frequent, path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def prepare(docs: DataFrame, tokenizer: str | None = None, most: int = 32768, text: str = "text") -> str:
    """Counts the words of all texts and ships their lexicon; returns the name that encode() and decode() take."""
    return ship(docs.sparkSession, frequent_words(docs, most, text), tokenizer)


def encode(docs: DataFrame, name: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256, and ids (array<int>) if asked for. `name` is what prepare() returned."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def start():
        encoder = encoder_of(name)
        digits = encoder.digits.__getitem__
        digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

        def work(texts):
            out = {n: [] for n, _ in fields}
            for ids in encoder.encode_all(texts):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(digest(",".join(map(digits, ids))))
                out["decoded_sha256"].append(digest(encoder.decode(ids)))
                if with_ids:
                    out["ids"].append(np.array(ids, np.int32))
            return out

        return work

    return annotate(docs, start, fields, text, keep)


def decode(rows: DataFrame, name: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds the decoded text of an array of ids; null stays null."""

    def start():
        encoder = encoder_of(name)
        return lambda values: {"decoded": [None if v is None else encoder.decode(v) for v in values]}

    return annotate(rows, start, [("decoded", T.StringType())], ids, keep)
