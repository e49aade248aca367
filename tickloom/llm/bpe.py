"""Byte-level BPE encoding and decoding through a transducer lexicon.

The frequent words of the corpus are compiled, with their merged ids as outputs,
into a minimal acyclic automaton: equal suffixes share states, and every arc
carries how many words precede it, so the sum along a path is the word's place
in the table of id lists. The automaton is two matrices in a file that Spark
ships to every executor, where the workers map it into memory; a batch of words
walks it in step. Words it does not hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common
from tickloom.llm.packing import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
LEXICON_WORDS = 65_536
LONGEST_WORD = 32
FLUSH = 300_000
REMEMBERED = 200_000
LONG_WORD = 48  # bytes; longer words are merged with a heap
SLOT_BITS = 20
NO_PAIR = 1 << 30
# The pattern by which the published vocabulary was made.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_characters() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return shown | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The vocabulary file: exact merging of one word, and bytes of ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        of = byte_characters()
        plain = lambda token: bytes(of[c] for c in token)
        self.ids = {plain(token): i for token, i in held["model"]["vocab"].items() if all(c in of for c in token)}
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        self.ranks = {(plain(a), plain(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # The same pairs by id: keys in order, with rank and id of the joined token.
        joined = [(self.ids[a] << 32 | self.ids[b], rank, self.ids[a + b]) for (a, b), rank in self.ranks.items()]
        rows = np.array(sorted(joined), np.int64).reshape(-1, 3)
        self.pairs, self.pair_ranks, self.pair_ids = (np.ascontiguousarray(x) for x in rows.T)
        self.byte_ids = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        # Where a pair stands by a hash of its key; several keys of one slot are looked up by search.
        slots = self._slots(self.pairs)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int64)
        self.slot[slots] = np.arange(len(slots))
        self.slot[np.flatnonzero(np.bincount(slots, minlength=1 << SLOT_BITS) > 1)] = -2

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of ids in `pairs`, or -1."""
        keys = left << 32 | right
        found = self.slot[self._slots(keys)]
        if (several := np.flatnonzero(found == -2)).size:
            found[several] = np.minimum(np.searchsorted(self.pairs, keys[several]), len(self.pairs) - 1)
        if len(self.pairs):
            found[self.pairs[found] != keys] = -1
        return found

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, how many each has), as `merge` gives them.

        In a round every word joins its pair of lowest rank, the leftmost one.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks_of = np.append(self.pair_ranks, NO_PAIR)  # the last one is found by -1

        def ranks(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at these places."""
            out = np.full(len(at), NO_PAIR)
            inside = np.flatnonzero(at + 1 < len(ids))
            inside = inside[owner[at[inside]] == owner[at[inside] + 1]]
            out[inside] = ranks_of[self.places(ids[at[inside]], ids[at[inside] + 1])]
            return out

        rank = ranks(np.arange(len(ids)))
        done_ids, done_owners = [], []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(first, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            ended = least == NO_PAIR
            if ended.any():
                done_ids.append(ids[ended])
                done_owners.append(owner[ended])
                ids, owner, rank, least = ids[~ended], owner[~ended], rank[~ended], least[~ended]
                if not len(ids):
                    break
            best = np.flatnonzero(rank == least)
            best = best[np.concatenate([[True], owner[best[1:]] != owner[best[:-1]]])]
            ids[best] = self.pair_ids[self.places(ids[best], ids[best + 1])]
            kept = np.ones(len(ids), bool)
            kept[best + 1] = False
            ids, owner, rank = ids[kept], owner[kept], rank[kept]
            best -= np.arange(len(best))  # one place went in every word before
            rank[best] = ranks(best)
            before = best[best > 0] - 1
            rank[before] = ranks(before)
        if not done_ids:
            return np.empty(0, np.int64), lengths
        owners = np.concatenate(done_owners)
        order = np.argsort(owners, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(owners, minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of lowest rank, leftmost first, until none is left."""
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        found = [ranks.get(pair, NO_PAIR) for pair in zip(parts, parts[1:])]
        while found:
            rank = min(found)
            if rank == NO_PAIR:
                break
            i = found.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), NO_PAIR)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), NO_PAIR)
        return [self.ids[p] for p in parts]

    def _merge_long(self, word: bytes) -> list[int]:
        """The same with a heap, for words of any length."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < len(parts):
                    pair = (parts[a], parts[after[a]])
                    if pair in self.ranks:
                        heapq.heappush(heap, (self.ranks[pair], a, *pair))
        return [self.ids[p] for p in parts if p is not None]


def compile_lexicon(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(arcs, skips, byte classes) of the minimal automaton of sorted distinct words.

    arcs[state, class] is the next state or -1; the class after the last one
    stands for the end of a word. skips[state, class] is the number of words that
    leave the state by a smaller class or end in it.
    """
    used = sorted({b for w in words for b in w})
    classes = np.full(256, -1, np.int32)
    classes[used] = np.arange(len(used))
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            child = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], child))

    for word in words:
        same = os.path.commonprefix([word, last])
        close(len(same))
        for _ in word[len(same) :]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = settle(path[0])

    # Children are settled before parents, so counts can be summed in order.
    held = np.zeros(len(states), np.int64)
    arcs = np.full((len(states), len(used) + 1), -1, np.int32)
    skips = np.zeros((len(states), len(used) + 1), np.int32)
    for state, (final, out) in enumerate(states):
        total = int(final)
        arcs[state, -1] = 0 if final else -1
        for byte, child in out:
            place = classes[byte]
            arcs[state, place], skips[state, place] = child, total
            total += held[child]
        held[state] = total
    # The root becomes state 0.
    order = np.arange(len(states))
    order[[0, root]] = order[[root, 0]]
    renamed = np.empty(len(states), np.int32)
    renamed[order] = np.arange(len(states))
    inner = arcs[:, :-1]
    inner[inner >= 0] = renamed[inner[inner >= 0]]
    return arcs[order], skips[order], classes


class Lexicon:
    """The compiled automaton with its id lists, mapped from files `prefix` + part."""

    PARTS = ("arcs", "skips", "classes", "starts", "ids")

    def __init__(self, prefix: str) -> None:
        loaded = (np.load(f"{prefix}{part}.npy", mmap_mode="r") for part in self.PARTS)
        self.arcs, self.skips, classes, self.starts, self.ids = loaded
        self.classes = np.array(classes)

    @classmethod
    def save(cls, prefix: str, words: list[bytes], ids: list[list[int]]) -> None:
        arcs, skips, classes = compile_lexicon(words)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        for part, value in zip(cls.PARTS, (arcs, skips, classes, starts, flat), strict=True):
            np.save(f"{prefix}{part}.npy", value)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of every word in the id lists, or -1, all words walking in step."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(lengths > 0)
        if not len(live) or not len(self.arcs):
            return out
        text = self.classes[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        state, total, step = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            ended = lengths[live] == step
            done = live[ended]
            final = self.arcs[state[ended], -1] == 0
            out[done[final]] = total[ended][final]
            live, state, total = live[~ended], state[~ended], total[~ended]
            byte = text[starts[live] + step]
            following = np.where(byte >= 0, self.arcs[state, np.maximum(byte, 0)], -1)
            good = following >= 0
            total = (total + self.skips[state, np.maximum(byte, 0)])[good]
            live, state, step = live[good], following[good].astype(np.int64), step + 1
        return out

    def output(self, place: int) -> list[int]:
        return self.outputs(np.array([place]))[0].tolist()

    def outputs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id lists at these places one after another, how many each has)."""
        starts = self.starts[places]
        sizes = self.starts[places + 1] - starts
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return self.ids[at], sizes


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        found: Counter[str] = Counter()
        for chunk, n in seen.items():
            for word in WORDS.findall(" " + chunk):
                if len(word) <= LONGEST_WORD:
                    found[word] += n
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(text.split())
        if len(seen) > FLUSH:
            yield rows()
            seen.clear()
    yield rows()


def build_lexicon(docs: DataFrame, text_col: str, vocabulary: str | None, words: int) -> str:
    """Compile the corpus's `words` most frequent words; returns the prefix Spark ships the files by.

    Word counts cover all texts; only the `words` chosen ones reach the driver.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = texts.mapInArrow(_count_chunks, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = common.most_frequent(common.stored(counts.where("n > 1"), "bpe-words"), "n", words)
    merges = Merges(vocabulary or vocabulary_path(VOCABULARY))
    frequent = sorted(r["word"].encode("utf-8", "surrogatepass") for r in rows)
    frequent = [w for w in frequent if len(w) <= LONGEST_WORD]
    name = f"lexicon-{uuid.uuid4().hex}-"
    # Spark's file server reads the files when an executor asks, so they stay as long as the driver.
    folder = os.path.realpath(tempfile.mkdtemp(prefix="tickloom-"))
    Lexicon.save(os.path.join(folder, name), frequent, [merges.merge(w) for w in frequent])
    for part in Lexicon.PARTS:
        spark.sparkContext.addFile(os.path.join(folder, f"{name}{part}.npy"))
    return name


def shipped_lexicon(name: str) -> Lexicon:
    """The lexicon in the folder where Spark has put it on this executor."""
    return Lexicon(os.path.join(SparkFiles.getRootDirectory(), name))


class Codec:
    """Ids, as joined decimals, and decoded bytes of the words of a text."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None) -> None:
        self.merges, self.lexicon = merges, lexicon
        self.joined: dict[str, bytes] = {}
        self.bytes: dict[str, bytes] = {}
        self.decimals = {i: str(i).encode() for i in merges.tokens}

    def learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        places = self.lexicon.places(raw) if self.lexicon else np.full(len(raw), -1)
        held = np.flatnonzero(places >= 0)
        if len(held):
            self.keep([words[i] for i in held.tolist()], *self.lexicon.outputs(places[held]))
        others = np.flatnonzero(places < 0).tolist()
        short = [i for i in others if len(raw[i]) <= LONG_WORD]
        self.keep([words[i] for i in short], *self.merges.merge_all([raw[i] for i in short]))
        for i in others:
            if len(raw[i]) > LONG_WORD:
                ids = self.merges.merge(raw[i])
                self.keep([words[i]], np.array(ids, np.int64), np.array([len(ids)]))

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        flat = ids.tolist()
        decimals = list(map(self.decimals.__getitem__, flat))
        tokens = list(map(self.merges.tokens.__getitem__, flat))
        ends = np.cumsum(sizes).tolist()
        for word, low, high in zip(words, [0, *ends], ends, strict=False):
            self.joined[word] = b",".join(decimals[low:high])
            self.bytes[word] = b"".join(tokens[low:high])

    def words(self, text: str) -> list[str]:
        split = self.merges.split
        if split is None or not split.search(text):
            return WORDS.findall(text)
        out = []
        for part in split.split(text):
            out += [part] if part in self.merges.special else WORDS.findall(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, their decimals joined by commas, decoded bytes) of every text."""
        split = [self.words(t) for t in texts]
        met = set().union(*split)
        if len(self.joined) > REMEMBERED:
            # What these texts hold stays: the frequent words are in all of them.
            for held in (self.joined, self.bytes):
                kept = {word: held[word] for word in met.intersection(held)}
                held.clear()
                held.update(kept)
        for content, i in self.merges.special.items():
            self.joined[content], self.bytes[content] = self.decimals[i], self.merges.tokens[i]
        self.learn(list(met.difference(self.joined)))
        for words in split:
            joined = b",".join(map(self.joined.__getitem__, words))
            yield (joined.count(b",") + 1 if joined else 0, joined, b"".join(map(self.bytes.__getitem__, words)))


def _digests(vocabulary: str | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Merges(vocabulary or vocabulary_path(VOCABULARY)), shipped_lexicon(name))
        for batch in batches:
            numbers, ids, texts = [], [], []
            for number, joined, decoded in codec.encode(batch.column(1).to_pylist()):
                numbers.append(number)
                ids.append(hashlib.sha256(joined).hexdigest())
                texts.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _ids(vocabulary: str | None, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Merges(vocabulary or vocabulary_path(VOCABULARY)), shipped_lexicon(name))
        for batch in batches:
            found = list(codec.encode(batch.column(1).to_pylist()))
            ids = [[int(x) for x in joined.split(b",")] if joined else [] for _, joined, _ in found]
            texts = [decoded.decode("utf-8", "replace") for _, _, decoded in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())],
                names=["id", "ids", "decoded"],
            )

    return run


def _run(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, words: int, task, schema: str) -> DataFrame:
    common.prepare(docs.sparkSession)
    name = build_lexicon(docs, text_col, vocabulary, words)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(task(vocabulary, name), f"id {dict(rows.dtypes)['id']}, {schema}")
    return found.withColumnRenamed("id", id_col)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    words: int = LEXICON_WORDS,
) -> DataFrame:
    """(doc_id, ids, decoded) per row of `docs`.

    Ids are those of the tokenizers library for the vocabulary file without added
    tokens; names of special tokens inside a text are those tokens, as there. A
    null text counts as empty: no ids. Null and repeated ids are rows of their
    own; other columns are not looked at; an empty table gives no rows.
    `vocabulary` is the file's path on driver and executors, by default that of
    the installed public vocabulary.
    """
    return _run(docs, id_col, text_col, vocabulary, words, _ids, "ids array<int>, decoded string")


def encode_digests(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    words: int = LEXICON_WORDS,
) -> DataFrame:
    """As `encode`, with the number of ids and SHA-256 digests in their place."""
    return _run(
        docs, id_col, text_col, vocabulary, words, _digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
