"""Operator 8: byte-level BPE through a minimal acyclic transducer of frequent words.

The corpus' most frequent words (pieces of the pre-tokenizer) are encoded once
and compiled, in sorted order, into a minimal acyclic automaton: equal suffixes
share states, every edge carries how many words it passes over, so the sum
along a word's path is its place in a table of id lists.  The automaton is one
file that tasks map into memory.  Words it lacks are merged exactly by rank.
Decoding looks each id's bytes up.

Defined cases: a null or empty text has no ids and decodes to the empty text;
``<|endoftext|>`` in a text is its own id, as in the library; texts of any
length are encoded whole (merging takes n log n steps for a word of n bytes);
an empty table gives no row and an empty lexicon; repeated rows are encoded
alike; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from relscope.llm.common import slices, written
from relscope.session import scratch_dir

#: Bound of the lexicon: words beyond it are merged, with the same ids.
LEXICON_WORDS = 50_000
#: Bound of a task's memory of recent words.
RECENT_WORDS = 200_000
#: Bytes up to which words are merged together; longer ones go one by one.
SHORT = 48
#: Texts that become Python strings at once: rows, and bytes beyond the first row.
SLICE_ROWS, SLICE_BYTES = 512, 4_000_000

# Fixed value: the pre-tokenizer's pattern.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of ASCII and the Latin letters up to U+017F only, which the standard library matches about twice as fast.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
LATIN_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile("[^\t-\r -~À-ÖØ-öø-ſ]")
# Code points whose class (letter, number or neither) differs between the regex module's Unicode version and
# the library's.  Texts with one of them are cut by the library itself; a test sweeps all code points against it.
DIFFERENT = """
    0x558 0x58B-0x58C 0x88F 0xC5C 0xCDC 0x208F 0x209D-0x209F 0xA7CE-0xA7CF 0xA7D2 0xA7D4 0xA7DD 0xA7E2 0xA7F1
    0xAB6C-0xAB6D 0x107BB-0x107BF 0x10940-0x10959 0x10EC5-0x10EC7 0x10ED9-0x10EEE 0x11B0A 0x11DB0-0x11DDB 0x11DE0-0x11DE9
    0x11DF1 0x1246F 0x12475-0x1247F 0x12550-0x12686 0x16EA0-0x16EB8 0x16EBB-0x16ED3 0x16FF2-0x16FF6 0x187F8-0x187FF
    0x18CD6-0x18CDA 0x18D09-0x18D20 0x18D80-0x18DF2 0x18E00-0x19191 0x191A0-0x191D2 0x1B123-0x1B128 0x1B168 0x1D6A6
    0x1DF1F-0x1DF24 0x1DF2B-0x1DF81 0x1DF90-0x1DF96 0x1DFCD-0x1DFFF 0x1E6C0-0x1E6DE 0x1E6E0-0x1E6E2 0x1E6E4-0x1E6E5
    0x1E6E7-0x1E6ED 0x1E6F0-0x1E6F4 0x1E6FE-0x1E6FF 0x2B73A-0x2B73F 0x2B81E 0x2CEA2-0x2CEAD 0x323B0-0x33479
    0x3D000-0x3FC3F
"""


def _class(ranges: str) -> str:
    """A character class of ranges written as hexadecimal code points."""
    ends = [[chr(int(x, 16)) for x in r.split("-")] for r in ranges.split()]
    return "[" + "".join(re.escape(e[0]) + "-" + re.escape(e[-1]) for e in ends) + "]"


NEWER = re.compile(_class(DIFFERENT))


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        self.to_byte = to_byte = {c: b for b, c in enumerate(chars)}
        raw = {t: bytes(to_byte[c] for c in t) for t in spec["model"]["vocab"]}
        self.id_of = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(raw[a], raw[b]): r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.letters = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.first_letter = np.cumsum([0, *map(len, self.bytes_of)])
        self.pattern = regex.compile(PIECES)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # For merging many words at once: merges as sorted keys (left id << 20 | right id), their ranks, and what each rank makes.
        self.id_of_byte = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        keys = np.array([self.id_of[x] << 20 | self.id_of[y] for x, y in self.rank], np.int64)
        ranks = np.array(list(self.rank.values()), np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], ranks[order]
        self.made = np.zeros(ranks.max(initial=-1) + 1, np.int64)
        self.made[ranks] = [self.id_of[x + y] for x, y in self.rank]
        self.byte_rank = self._ranks(np.repeat(self.id_of_byte, 256), np.tile(self.id_of_byte, 256))  # at (left byte << 8 | right byte)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece: the lowest-ranked neighbours merge first, the leftmost of equals."""
        parts: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1)
                if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.id_of[p] for p in parts if p is not None]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; pairs that never merge get a rank beyond all."""
        if not len(self.pair_key):
            return np.zeros(len(left), np.int64)
        want = left << 20 | right
        e = np.minimum(np.searchsorted(self.pair_key, want), len(self.pair_key) - 1)
        return np.where(self.pair_key[e] == want, self.pair_rank[e], len(self.made))

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after the other, and where each begins.

        Every round merges one pair in each word that still has one: the
        lowest-ranked, the leftmost of equals, as ``merge`` does.
        """
        short = [i for i, w in enumerate(words) if 0 < len(w) <= SHORT]
        far, parts = len(self.made), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i, w in enumerate(words):
            if len(w) > SHORT:
                ids = np.array(self.merge(w), np.int64)
                parts.append((np.full(len(ids), i), ids))
        size = np.array([len(words[i]) for i in short], np.int64)
        word = np.repeat(np.array(short, np.int64), size)
        letters = np.frombuffer(b"".join(words[i] for i in short), np.uint8).astype(np.int64)
        ids = self.id_of_byte[letters]
        rank = np.full(len(ids), far)
        rank[:-1] = np.where(word[1:] == word[:-1], self.byte_rank[letters[:-1] << 8 | letters[1:]], far)
        while len(size):
            low = np.minimum.reduceat(rank, np.cumsum(size) - size)
            going = np.repeat(low < far, size)
            parts.append((word[~going], ids[~going]))
            size, low, word, ids, rank = size[low < far], low[low < far], word[going], ids[going], rank[going]
            at = np.nonzero(rank == np.repeat(low, size))[0]
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at
            ids[at] = self.made[low]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            size, word, ids, rank = size - 1, word[stays], ids[stays], rank[stays]
            at -= np.arange(len(at))  # one place is gone in each earlier word
            for left in (at, at[at > 0] - 1):
                inner = left + 1 < len(ids)
                rank[left[~inner]] = far
                left = left[inner]
                same = word[left] == word[left + 1]
                rank[left[~same]] = far
                left = left[same]
                rank[left] = self._ranks(ids[left], ids[left + 1])
        word, ids = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]).astype(np.int64)

    def pieces(self, text: str) -> list[str]:
        """The words of a plain stretch."""
        if not NOT_LATIN.search(text):
            return LATIN_PIECES.findall(text)
        if not NEWER.search(text):
            return self.pattern.findall(text)
        words = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str(text)
        return [bytes(self.to_byte[c] for c in w).decode() for w, _ in words]

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Plain stretches (text, None) and special tokens (token, id)."""
        for s in self.split.split(text) if self.split else [text]:
            if s:
                yield s, self.special.get(s)


# ------------------------------------------------------------------ lexicon
class Lexicon:
    """A minimal acyclic transducer from words (bytes) to id lists, as arrays.

    Edge e leads from state ``key[e] >> 8`` by byte ``key[e] & 255`` (sorted) to
    ``target[e]`` and passes over ``skip[e]`` words; ``final`` marks word ends;
    word w has the ids ``ids[first[w]:first[w + 1]]``.
    """

    NAMES = ("key", "target", "skip", "final", "first", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: list[bytes], id_lists: list[list[int]]) -> Lexicon:
        """``words`` sorted and distinct.  States are merged as soon as no later word can change them."""
        states: list[list] = [[False, {}]]  # final, {byte: state}; the root is 0
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the last word's own branch

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, byte, child = path.pop()
                shape = (states[child][0], tuple(states[child][1].items()))
                same = register.setdefault(shape, child)
                states[parent][1][byte] = same

        last = b""
        for word in words:
            common = len(os.path.commonprefix([last, word]))
            settle(common)
            at = path[-1][2] if path else 0
            for byte in word[common:]:
                states.append([False, {}])
                states[at][1][byte] = len(states) - 1
                path.append((at, byte, len(states) - 1))
                at = len(states) - 1
            states[at][0] = True
            last = word
        settle(0)

        number, order, todo = {0: 0}, [0], [0]
        while todo:
            for child in states[todo.pop()][1].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
                    todo.append(child)
        below: dict[int, int] = {}  # words that end in or below a state
        todo = [0]
        while todo:
            s = todo[-1]
            missing = [c for c in states[s][1].values() if c not in below]
            if missing:
                todo += missing
            else:
                below[todo.pop()] = int(states[s][0]) + sum(below[c] for c in states[s][1].values())
        key, target, skip = [], [], []
        for s in order:
            passed = int(states[s][0])
            for byte, child in sorted(states[s][1].items()):
                key.append(number[s] << 8 | byte)
                target.append(number[child])
                skip.append(passed)
                passed += below[child]
        first = np.concatenate([[0], np.cumsum([len(x) for x in id_lists], dtype=np.int64)]) if id_lists else np.zeros(1, np.int64)
        return cls({"key": np.array(key, np.int64), "target": np.array(target, np.int64), "skip": np.array(skip, np.int64),
                    "final": np.array([states[s][0] for s in order], np.int64), "first": first.astype(np.int64),
                    "ids": np.array([i for x in id_lists for i in x], np.int64)})

    def to_bytes(self) -> bytes:
        arrays = [getattr(self, n) for n in self.NAMES]
        return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """The lexicon in a file, mapped into memory."""
        data = np.memmap(path, np.int64, "r")
        ends = np.cumsum(np.concatenate([[len(cls.NAMES)], data[:len(cls.NAMES)]]))
        return cls({n: data[a:b] for n, a, b in zip(cls.NAMES, ends, ends[1:])})

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, or -1: all words walk the automaton together, a byte at a time."""
        size = np.array([len(w) for w in words], np.int64)
        place, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        letters = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live = np.nonzero(size > 0)[0] if len(self.key) else np.zeros(0, np.int64)
        place[size == 0] = -1
        if not len(self.key):
            place[:] = -1
        for depth in range(int(size.max(initial=0))):
            live = live[size[live] > depth]
            if not len(live):
                break
            want = state[live] << 8 | letters[start[live] + depth]
            e = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            good = self.key[e] == want
            place[live[~good]] = -1
            live, e = live[good], e[good]
            place[live] += self.skip[e]
            state[live] = self.target[e]
        ended = place >= 0
        place[ended] = np.where(self.final[state[ended]] > 0, place[ended], -1)
        return place


# ------------------------------------------------------------------ texts
def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``start``, one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _pieces(v: Vocabulary, text: str | None) -> list[str | int]:
    """The words of a text; a number is a special token."""
    out: list = []
    for stretch, special in v.segments(text or ""):
        if special is not None:
            out.append(special)
        else:
            out += v.pieces(stretch)
    return out


@cache
def _vocabulary(path: str) -> Vocabulary:
    """The vocabulary in a file, read once by a Python worker."""
    return Vocabulary(path)


class Coder:
    """Encodes and decodes texts with a vocabulary and a lexicon; remembers the ids of recent words."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.v, self.lexicon = vocabulary, lexicon
        special = sorted(vocabulary.special.values())
        self._remember(special, np.array(special, np.int64), np.arange(len(special) + 1), np.zeros(len(special), np.int64))

    def _remember(self, words: list[str | int], ids: np.ndarray, first: np.ndarray, uses: np.ndarray) -> None:
        """Word number n has the ids ``ids[first[n]:first[n + 1]]``; the special tokens come first.  A new word gets the next number."""
        self.number: dict[str | int, int] = defaultdict(count(len(words)).__next__, zip(words, range(len(words))))
        self.ids, self.first, self.uses = ids, first, uses

    def _forget(self) -> None:
        """Forgets the least used words: half of the bound stays."""
        size, special = np.diff(self.first), len(self.v.special)
        order = special + np.argsort(-self.uses[special:], kind="stable")
        keep = np.sort(np.concatenate([np.arange(special), order[:RECENT_WORDS // 2]]))
        keep = keep[np.cumsum(size[keep]) <= 5 * RECENT_WORDS]
        words = list(self.number)
        self._remember([words[i] for i in keep.tolist()], _gather(self.ids, self.first[keep], size[keep]),
                       np.concatenate([[0], np.cumsum(size[keep])]), self.uses[keep] // 2)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and where each begins: from the lexicon, else merged."""
        raw, lex = [w.encode() for w in words], self.lexicon
        place = lex.places(raw)
        unseen = np.nonzero(place < 0)[0]
        merged, begin = self.v.merge_all([raw[i] for i in unseen])
        known = np.maximum(place, 0)
        start, size = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        if len(unseen) < len(raw):
            start, size = lex.first[known], lex.first[known + 1] - lex.first[known]
        start[unseen], size[unseen] = len(lex.ids) + begin[:-1], np.diff(begin)
        return _gather(np.concatenate([lex.ids, merged]), start, size), np.concatenate([[0], np.cumsum(size)])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and where each begins; what is new in all of them is learned at once."""
        if len(self.number) > RECENT_WORDS or len(self.ids) > 10 * RECENT_WORDS:
            self._forget()
        lists, known = [_pieces(self.v, t) for t in texts], len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), np.int64)
        if len(self.number) > known:
            ids, first = self.words(list(islice(self.number, known, None)))
            self.first = np.concatenate([self.first, len(self.ids) + first[1:]])
            self.ids = np.concatenate([self.ids, ids])
        uses = np.bincount(at, minlength=len(self.number))
        uses[:known] += self.uses
        self.uses = uses
        size = np.diff(self.first)[at]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, lists)])]
        return _gather(self.ids, self.first[at], size), ends

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, first = self.encode_all(texts)
        return [x.tolist() for x in np.split(ids, first[1:-1])] if texts else []

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts of ids as ``encode_all`` gives them."""
        size = np.diff(self.v.first_letter)[ids]
        letters = _gather(self.v.letters, self.v.first_letter[ids], size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        return [letters[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def count_words(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(word, n) over all texts; each task counts before the shuffle, in bounded memory."""
    def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = _vocabulary(SparkFiles.get(vocabulary)), Counter()

        def flush():
            for i in v.special.values():
                seen.pop(i, None)
            return pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for part in slices(batch, 0, SLICE_ROWS, SLICE_BYTES):
                for text in part.column(0).to_pylist():
                    seen.update(_pieces(v, text))
                    if len(seen) > RECENT_WORDS:
                        yield flush()
                        seen.clear()
        if seen:
            yield flush()
    counts = docs.select("text").mapInArrow(count_task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _ship(spark, path: str) -> str:
    """Adds a file to the executors' own; its name there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """The most frequent words, at most ``size``: those above the least frequency that a small histogram allows.

    Frequencies are taken to an eighth of their binary order, so the histogram
    has some hundred rows whatever the corpus, and no more than ``size`` words reach the driver.
    Words that occur once are never among them."""
    counts = written(counts.where("n > 1").withColumn("order", F.floor(F.log2("n") * 8).cast("int")), "bpe-counts")
    cut, total = None, 0
    for r in sorted(counts.groupBy("order").count().collect(), key=lambda r: -r["order"]):
        total += r["count"]
        if total > size:
            break
        cut = r["order"]
    return [] if cut is None else [r["word"] for r in counts.where(F.col("order") >= cut).select("word").collect()]


def build_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of the corpus into a file in the shared folder; returns its path."""
    spark, v = docs.sparkSession, Vocabulary(vocabulary_path)
    words = sorted(w.encode() for w in frequent_words(count_words(docs, _ship(spark, vocabulary_path)), size))
    lexicon = Lexicon.compile(words, [v.merge(w) for w in words])
    folder = scratch_dir(spark, "lexicon")
    target, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    target.create_dir(root, recursive=True)
    name = f"lexicon-{uuid.uuid4().hex[:12]}.bin"
    with target.open_output_stream(f"{root}/{name}") as f:
        f.write(lexicon.to_bytes())
    return f"{folder}/{name}"


def transcode(docs: DataFrame, vocabulary_path: str, size: int = LEXICON_WORDS, id_column: str = "doc_id") -> DataFrame:
    """Every document's id, its token ids, and the text these decode to."""
    spark = docs.sparkSession
    lexicon, vocabulary = _ship(spark, build_lexicon(docs, vocabulary_path, size)), _ship(spark, vocabulary_path)
    schema = pa.schema([(id_column, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(_vocabulary(SparkFiles.get(vocabulary)), Lexicon.map(SparkFiles.get(lexicon)))
        for batch in batches:
            for part in slices(batch, 1, SLICE_ROWS, SLICE_BYTES):  # texts make large lists: few at a time
                ids, first = coder.encode_all(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), lists, pa.array(coder.decode_all(ids, first), pa.string())], schema=schema)

    return docs.select(id_column, "text").mapInArrow(code, f"{id_column} long, ids array<int>, decoded string")


def digest(coded: DataFrame) -> DataFrame:
    """Counts and hashes of ids and decoded texts."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
