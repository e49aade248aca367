"""Toxicity of documents with noisy-channel restoration of disguised words.

A token that looks disguised (digits or signs among letters, runs of one letter,
letters set apart) becomes a lattice: every position offers the letters its sign
may stand for, a run may shrink to one or two letters, a separator may vanish.
Over a run of short tokens, a blank may also vanish or end a word.
Viterbi search picks the restoration with the best sum of channel cost and
character language model. Evidence is counted on restored words and their
beginnings; the score of a text is a logistic function of its strongest
evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common
from tickloom.llm.quality import fit_logistic

HELD_OUT_OF, HELD_OUT = 3, 1
TOXIC_FROM = 0.7
MOST_FEATURES = 50_000
MOST_GRAMS = 60_000
MOST_FITTED = 20_000
LEAST_DOCS = 3
REMEMBERED = 250_000
FLUSH = 150_000  # distinct entries a task counts before it passes them on
MOST_BINS = 1 << 22  # grams of more possible letters are counted by sorting
PREFIXES = (4, 5, 6)

# What a sign may stand for, besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
    "#": "h", "%": "x", "&": "a",
}
SEPARATORS = ".-_*~'’·"
SUBSTITUTED, SHRUNK, JOINED = -1.5, -0.7, -0.7
DROPPED = -2.0  # cost of a blank that does not end a word; between two single letters it costs nothing
LONG_RUN = 16  # tokens; longer runs are worked out anew, so that what is remembered has a bound
STRETCH = 512  # single letters that are read together; stretches overlap by two longest words
NEAR, SPELLED = 12.0, 24  # of single letters in a row, words of up to so many in readings so close to the best one count too
EDGE = "^"
RUN = re.compile(r"([^\W\d_])\1\1")
CLOSING = frozenset(".,;:!?)]}\"'»”")
TRIM = re.compile(r"^(?:([^\w\s])\1+|[(\[{\"'«“¿])+|(?:([^\w\s])\2+|[.,;:!?)\]}\"'»”])+$")
DISGUISED = re.compile(rf"(?=.*[^\W\d_])(?:.*[{re.escape(''.join(LEET))}]|[^\W\d_](?:[{re.escape(SEPARATORS)}][^\W\d_])+$)")
# Tokens of a few letters or signs; blanks between two or more in a row may be part of a disguise.
SHORT = re.compile(
    rf"[(\[{{\"'«“¿]*(?:[^\W_]|[{re.escape(''.join(LEET) + SEPARATORS)}]){{1,4}}[.,;:!?)\]}}\"'»”]*"
)


class CharacterModel:
    """Interpolated character trigrams over words, from counts of (gram, n)."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.context: Counter[str] = Counter()
        for gram, n in counts.items():
            self.context[gram[:-1]] += n
        self.letters = max(2, sum(1 for g in counts if len(g) == 1))
        self.seen: dict[str, float] = {}

    def log(self, context: str, letter: str) -> float:
        """log P(letter | last two letters), smoothed toward shorter contexts."""
        key = context + letter
        value = self.seen.get(key)
        if value is None:
            p = 1 / self.letters
            for k in range(min(2, len(context)) + 1):
                part = context[len(context) - k :]
                total = self.context.get(part, 0)
                p = (self.counts.get(part + letter, 0) + 4 * p) / (total + 4)
            value = self.seen[key] = math.log(p)
        return value


def grams(word: str) -> list[str]:
    """Character grams of one to three of a word with its edges marked."""
    padded = EDGE + EDGE + word + EDGE
    return [padded[i - k : i + 1] for i in range(2, len(padded)) for k in range(3)]


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per position: what it may read as ('' for nothing) and the channel's log cost."""
    steps = []
    for i, sign in enumerate(token):
        options = [(sign, 0.0)] if sign.isalpha() else []
        options += [(letter, SUBSTITUTED) for letter in LEET.get(sign, "")]
        if sign in SEPARATORS or not options:
            options.append(("", JOINED))
        if sign.isalpha() and i and token[i - 1] == sign and (
            (i > 1 and token[i - 2] == sign) or (i + 1 < len(token) and token[i + 1] == sign)
        ):
            options.append(("", SHRUNK))
        steps.append(options)
    return steps


def _advanced(states: dict[str, tuple[float, tuple]], token: str, model: CharacterModel) -> dict[str, tuple[float, tuple]]:
    """The best way to every context after `token`: log cost and letters, as nested pairs."""
    for options in lattice(token):
        after: dict[str, tuple[float, tuple]] = {}
        for context, (cost, text) in states.items():
            for letter, channel in options:
                if letter:
                    value, reached = cost + channel + model.log(context, letter), context[1:] + letter
                else:
                    value, reached = cost + channel - 2.0, context
                if reached not in after or value > after[reached][0]:
                    after[reached] = (value, (text, letter) if letter else text)
        states = after
    return states


def _spelled(text: tuple) -> str:
    letters = []
    while text:
        text, letter = text
        letters.append(letter)
    return "".join(reversed(letters))


def restore(token: str, model: CharacterModel) -> str:
    """The likeliest plain word behind a lower-cased token."""
    states = _advanced({EDGE + EDGE: (0.0, ())}, token, model)
    return _spelled(_ended(states, model)[1])


def trimmed(core: str) -> str:
    """`core` without signs around it."""
    return core[:-1] if core[-1:] in CLOSING and core[:-1].isalpha() else TRIM.sub("", core)


def looks_disguised(core: str) -> bool:
    return bool(RUN.search(core) or DISGUISED.match(core))


def readings(token: str, model: CharacterModel | None) -> str:
    """The plain word of a raw token; '' if it has no letters."""
    core = token.lower()
    if core.isalpha() and not RUN.search(core):
        return core
    if not core[:1].isalnum() or not core[-1:].isalnum():
        core = trimmed(core)
    if core.isalpha() and not RUN.search(core):
        return core
    if model is not None and looks_disguised(core):
        return restore(core, model)
    if core.isalpha():
        return core
    return "".join(filter(str.isalpha, core))


def plain_words(tokens: list[str]) -> tuple[list[str], list[bool]]:
    """(lower-cased tokens, whether each is a plain word: letters, no three equal ones in a row), for tokens without line feeds."""
    if not tokens:
        return [], []
    text = "\n".join(tokens).lower()
    lowered = text.split("\n")
    plain = np.fromiter(map(str.isalpha, lowered), bool, len(lowered))
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    runs = np.flatnonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]))
    plain[np.searchsorted(np.flatnonzero(points == ord("\n")), runs)] = False
    return lowered, plain.tolist()


def _blank(left: str, right: str) -> float:
    return 0.0 if len(left) == len(right) == 1 else DROPPED


def _ended(states: dict[str, tuple[float, tuple]], model: CharacterModel) -> tuple[float, tuple]:
    return max(((cost + model.log(c, EDGE), text) for c, (cost, text) in states.items()), key=lambda x: x[0])


def segmented(tokens: list[str], model: CharacterModel) -> list[str]:
    """Words over two or more tokens in the likeliest reading, in which every blank is kept or dropped."""
    states: dict[str, tuple[float, tuple]] = {EDGE + EDGE: (0.0, ())}
    for i, token in enumerate(tokens):
        if i:
            cost, text = _ended(states, model)
            blank = _blank(tokens[i - 1], token)
            states = {c: (cost + blank, (text, "+")) for c, (cost, text) in states.items()}
            if EDGE + EDGE not in states or cost > states[EDGE + EDGE][0]:
                states[EDGE + EDGE] = (cost, (text, " "))
        states = _advanced(states, token, model)
    words = _spelled(_ended(states, model)[1]).split()
    return [w.replace("+", "") for w in words if "+" in w]


def spelled(letters: list[str], model: CharacterModel) -> list[str]:
    """Words over two or more single letters, in all readings close to the likeliest one of their stretch."""
    step = STRETCH - 2 * SPELLED
    starts = range(0, max(1, len(letters) - 2 * SPELLED), step)
    return [word for i in starts for word in _spelled_words(letters[i : i + STRETCH], model)]


def _spelled_words(letters: list[str], model: CharacterModel) -> list[str]:
    n = len(letters)
    best, rest = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    ways: list[tuple[int, int, float, tuple]] = []
    for begin in range(n):
        states: dict[str, tuple[float, tuple]] = {EDGE + EDGE: (0.0, ())}
        for end in range(begin + 1, min(n, begin + SPELLED) + 1):
            states = _advanced(states, letters[end - 1], model)
            cost, text = _ended(states, model)
            ways.append((begin, end, cost, text))
            best[end] = max(best[end], best[begin] + cost)
    for begin, end, cost, _ in reversed(ways):
        rest[begin] = max(rest[begin], cost + rest[end])
    return [_spelled(t) for b, e, cost, t in ways if e > b + 1 and best[b] + cost + rest[e] >= best[n] - NEAR]


class Joins(dict):
    """Words written over several tokens; by token: what a short one has without its outer signs, '' for others."""

    def __init__(self, model: CharacterModel) -> None:
        self.model = model
        self.gains: dict[str, float] = {}
        self.runs: dict[tuple[str, ...], list[str]] = {}

    def gain(self, left: str, right: str) -> float:
        """Log cost of a dropped blank less that of a kept one; exact if both sides are two plain letters or more."""
        key = left[-2:] + right[:2]
        value = self.gains.get(key)
        if value is None:
            log, (a, b) = self.model.log, (left[-2:], right[:2])
            value = self.gains[key] = (
                DROPPED + log(a, b[0]) + log(a[1] + b[0], b[1]) - log(a, EDGE) - log(EDGE + EDGE, b[0]) - log(EDGE + b[0], b[1])
            )
        return value

    def __missing__(self, token: str) -> str:
        short = len(token) < 5 if token.isalpha() else SHORT.fullmatch(token)
        core = token.lower() if short else ""
        value = self[token] = core if not core or core.isalpha() else TRIM.sub("", core) or core
        return value

    def joined(self, run: list[str]) -> list[str]:
        """Words over all readings of a run of short tokens."""
        key = tuple(run[: LONG_RUN + 1])
        value = self.runs.get(key) if len(key) <= LONG_RUN else None
        if value is None:
            found = segmented(run, self.model)
            for single, letters in groupby(run, lambda x: len(x) == 1):
                if single and len(row := list(letters)) > 2:
                    found += spelled(row, self.model)
            value = list(dict.fromkeys(found))
            if len(key) <= LONG_RUN:
                self.runs[key] = value
        return value

    def within(self, cores: list[str]) -> list[str]:
        """Words that are written over several of `cores`, short tokens in a row."""
        found: list[str] = []
        run: list[str] = []
        gains, plain = self.gains, False
        for core in cores:
            before, plain = plain, len(core) > 1 and core.isalpha()
            # Blanks that the likeliest reading keeps, whatever stands around them, split the run.
            if before and plain:
                gain = gains.get(run[-1][-2:] + core[:2])
                if (self.gain(run[-1], core) if gain is None else gain) < 0:
                    if len(run) > 1:
                        found += self.joined(run)
                    run = []
            run.append(core)
        if len(run) > 1 and any(map(str.isalpha, run)):
            found += self.joined(run)
        return found

    def of(self, text: str) -> list[str]:
        """Words of `text` that are written over several tokens."""
        return self.over(text.split())

    def over(self, tokens: list[str]) -> list[str]:
        """Words written over several of `tokens`, a text split at white space."""
        found: list[str] = []
        for short, cores in groupby(map(self.__getitem__, tokens), bool):
            if short and len(row := list(cores)) > 1:
                found += self.within(row)
        if len(self) + len(self.runs) > REMEMBERED:
            self.clear()
        return found

    def across(
        self, tokens: list[str], lowered: list[str], letters: list[bool], places: np.ndarray, texts: np.ndarray
    ) -> Iterator[tuple[int, str]]:
        """(text, word) of the words written over several tokens, for coded texts; as `over` finds them in each.

        `lowered` and `letters` are the `plain_words` of `tokens`.
        """
        cores = [
            (word if len(token) < 5 else "") if plain else self[token]
            for token, word, plain in zip(tokens, lowered, letters, strict=True)
        ]
        plain, left, right = (np.zeros(len(cores), kind) for kind in (bool, np.int64, np.int64))
        ends: dict[str, int] = {}
        short = np.fromiter(map(bool, cores), bool, len(cores))
        for i in np.flatnonzero(short).tolist():
            core = cores[i]
            if len(core) > 1 and core.isalpha():
                plain[i] = True
                left[i], right[i] = ends.setdefault(core[-2:], len(ends)), ends.setdefault(core[:2], len(ends))
        at = np.flatnonzero(short[places])
        code = places[at]
        joined = (at[1:] == at[:-1] + 1) & (texts[at[1:]] == texts[at[:-1]])
        # Blanks that the likeliest reading keeps, whatever stands around them, split the run.
        both = np.flatnonzero(joined & plain[code[:-1]] & plain[code[1:]])
        pairs, place = np.unique(left[code[both]] << 32 | right[code[both + 1]], return_inverse=True)
        names = list(ends)
        gains = [self.gain(names[pair >> 32], names[pair & 0xFFFFFFFF]) for pair in pairs.tolist()]
        joined[both[np.array(gains, float)[place] < 0]] = False
        change = np.diff(np.concatenate([[0], joined, [0]]).astype(np.int8))
        for low, high in zip(np.flatnonzero(change > 0).tolist(), np.flatnonzero(change < 0).tolist(), strict=True):
            run = [cores[c] for c in code[low : high + 1].tolist()]
            if any(map(str.isalpha, run)):
                text = int(texts[at[low]])
                for word in self.joined(run):
                    yield text, word
        if len(self) + len(self.runs) > REMEMBERED:
            self.clear()

    def clear(self) -> None:
        super().clear()
        self.runs.clear()


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, the place of each token among them, its text) of texts split at white space."""
    tokens, places, edges = common.coded(pc.utf8_split_whitespace(texts))
    places, texts_of = places.to_numpy(), np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    if (empty := tokens.index("") if "" in tokens else -1) >= 0:  # white space at the edges of a text
        full = places != empty
        places, texts_of = places[full], texts_of[full]
    return tokens, places, texts_of


def units(word: str) -> list[str]:
    """What evidence is counted on: the word and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)] if len(word) >= 3 else []


def _gram_rows(seen: dict[str, int]) -> pa.RecordBatch:
    """Character grams of plain words, as `grams` gives them, with the words' counts."""
    cores = [token if token.isalpha() else trimmed(token) for token in seen]
    _, plain = plain_words(cores)
    words = list(compress(cores, plain))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 3
    text = f"{EDGE}{EDGE}" + f"{EDGE}{EDGE}{EDGE}".join(words) + EDGE if words else ""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    weights = np.repeat(np.fromiter(compress(seen.values(), plain), np.float64, len(words)), lengths - 2)
    starts = np.cumsum(lengths) - lengths
    inside = np.ones(len(points), bool)
    inside[starts] = inside[starts + 1] = False
    ends = np.flatnonzero(inside)
    used = np.zeros(0x110000, np.int32)
    used[points] = 1
    alphabet = np.flatnonzero(used)
    used[alphabet] = np.arange(len(alphabet))
    points, letters = used[points], list(map(chr, alphabet.tolist()))
    names, counts = [], []
    for size in (1, 2, 3):
        key, bins = np.zeros(len(ends), np.int64), len(letters) ** size
        for k in range(size):
            key = key * len(letters) + points[ends - size + 1 + k]
        if bins <= MOST_BINS:
            sums = np.bincount(key, weights, bins)
            found = np.flatnonzero(sums)
            sums = sums[found]
        else:
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            found, sums = key[starts], np.add.reduceat(weights[order], starts)
        counts += sums.astype(np.int64).tolist()
        parts = [[letters[i] for i in (found // len(letters) ** k % len(letters)).tolist()] for k in reversed(range(size))]
        names += map("".join, zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["gram", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        tokens, places, _ = coded(batch.column(0))
        lowered = "\n".join(tokens).lower().split("\n") if tokens else []
        for word, n in zip(lowered, np.bincount(places, minlength=len(lowered)).tolist(), strict=True):
            seen[word] = seen.get(word, 0) + n
        if len(seen) > FLUSH:
            yield _gram_rows(seen)
            seen.clear()
    yield _gram_rows(seen)
    common.release(seen)


def character_model(docs: DataFrame, text_col: str, most: int = MOST_GRAMS) -> CharacterModel:
    """Character counts over all texts; the `most` commonest grams reach the driver."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = common.most_frequent(common.stored(counted, "toxic-grams"), "n", most)
    return CharacterModel({r["gram"]: r["n"] for r in rows})


class Reader(dict):
    """Restored word of a raw token, remembered."""

    def __init__(self, model: CharacterModel | None) -> None:
        self.model = model
        self.joins = Joins(model)

    def __missing__(self, token: str) -> str:
        value = self[token] = readings(token, self.model)
        return value

    def words(self, text: str) -> list[str]:
        if len(self) > REMEMBERED:
            self.clear()
        tokens = text.split()
        return [*map(self.__getitem__, tokens), *self.joins.over(tokens)]

    def coded(self, texts: pa.Array, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the word) of all words that `words` finds; new words get the next numbers in `number`."""
        if len(self) > REMEMBERED:
            self.clear()
        tokens, places, texts_of = coded(texts)
        lowered, plain = plain_words(tokens)
        found = [word if letters else self[token] for token, word, letters in zip(tokens, lowered, plain, strict=True)]
        own = np.array([number.setdefault(word, len(number)) for word in found], np.int64)
        across = self.joins.across(tokens, lowered, plain, places, texts_of)
        joined = [(text, number.setdefault(word, len(number))) for text, word in across]
        more = np.array(joined, np.int64).reshape(-1, 2)
        return np.concatenate([texts_of, more[:, 0]]), np.concatenate([own[places], more[:, 1]])


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _unit_rows(names: pa.Array, texts_of: np.ndarray, words: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
    """`units` of the distinct words of texts: in how many texts, and in how many toxic ones, each unit is.

    `names` are distinct words; text texts_of[i] has word words[i].
    """
    texts_of, words = np.divmod(_distinct(texts_of * len(names) + words), max(1, len(names)))
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    found, which = [], []
    for size in (0, *PREFIXES):
        long = np.flatnonzero(lengths >= (size or 3))
        part = names.take(pa.array(long))
        found.append(pc.utf8_slice_codeunits(part, 0, size) if size else pc.binary_join_element_wise(part, "$", ""))
        which.append(long)
    coded_units = pa.concat_arrays(found).dictionary_encode()
    codes, count = coded_units.indices.to_numpy(), len(coded_units.dictionary)
    keys = []
    for long, code in zip(which, np.split(codes, np.cumsum([len(x) for x in which])[:-1]), strict=True):
        of_word = np.full(len(names), -1)
        of_word[long] = code
        unit = of_word[words]
        keys.append((texts_of * count + unit)[unit >= 0])
    texts_of, unit = np.divmod(_distinct(np.concatenate(keys)), max(1, count))
    return pa.RecordBatch.from_arrays(
        [
            coded_units.dictionary,
            pa.array(np.bincount(unit, minlength=count).astype(np.int64)),
            pa.array(np.bincount(unit[toxic[texts_of]], minlength=count).astype(np.int64)),
        ],
        names=["unit", "n", "toxic"],
    )


def _count_units(model: CharacterModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            number: dict[str, int] = {}
            texts_of, words = reader.coded(batch.column(0), number)
            toxic = batch.column(1).to_numpy(zero_copy_only=False) >= 0.5
            yield _unit_rows(pa.array(list(number), pa.string()), texts_of, words, toxic)
        common.release(reader, reader.joins, model.seen)

    return run


class TokenEvidence(dict):
    """Strongest evidence of the restored word of a raw token, remembered."""

    def __init__(self, model: CharacterModel, evidence: dict[str, float]) -> None:
        self.model, self.evidence = model, evidence
        # The first four letters of a word, or its three, are the beginning of all its units.
        self.starts = {unit.removesuffix("$")[:4] for unit in evidence}
        self.joins = Joins(model)

    def of(self, word: str) -> float:
        if word[:4] not in self.starts:
            return 0.0
        found = self.evidence.get
        return max([found(word + "$", 0.0), *[found(word[:k], 0.0) for k in PREFIXES]])

    def __missing__(self, token: str) -> float:
        value = self[token] = self.of(readings(token, self.model))
        return value


class Scorer:
    """Probability that a text is toxic."""

    def __init__(self, model: CharacterModel, evidence: dict[str, float], weights: np.ndarray) -> None:
        self.model, self.evidence, self.weights = model, evidence, weights

    def start(self) -> None:
        self.known = TokenEvidence(self.model, self.evidence)

    def vectors(self, texts: pa.Array) -> np.ndarray:
        """Strongest evidence, log of the count of words with strong evidence, their share; a row per text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        tokens, places, texts_of = coded(texts)
        lowered, plain = plain_words(tokens)
        known, of, starts = self.known, self.known.of, self.known.starts
        # Plain words need not be remembered.
        values = [
            (of(word) if word[:4] in starts else 0.0) if letters else known[token]
            for token, word, letters in zip(tokens, lowered, plain, strict=True)
        ]
        values = np.array(values, float)[places]
        across = known.joins.across(tokens, lowered, plain, places, texts_of)
        joined = [(text, of(word)) for text, word in across]
        more = np.array(joined, float).reshape(-1, 2)
        texts_of, values = np.concatenate([texts_of, more[:, 0].astype(np.int64)]), np.concatenate([values, more[:, 1]])
        most, count = np.zeros(len(texts)), len(texts)
        np.maximum.at(most, texts_of, values)
        strong = np.bincount(texts_of[values > 2.0], minlength=count)
        share = strong / np.maximum(1, np.bincount(texts_of, minlength=count))
        return np.stack([most, np.log1p(strong), np.sqrt(share)], axis=1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = self.vectors(pa.array(texts, pa.string()))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _vectors(scorer: Scorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.start()
        for batch in batches:
            x = scorer.vectors(batch.column(0))
            yield pa.RecordBatch.from_arrays([common.lists(x), batch.column(1)], names=["x", "toxic"])
        common.release(scorer.known.joins, scorer.known)

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer from the labelled documents that are not held out.

    All of them are counted. The final weights are fitted on about `MOST_FITTED`
    of them, chosen by a hash of the id; the evidence table is cut to the
    `MOST_FEATURES` units of the highest cautious odds.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    model = character_model(docs, text_col)
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(common.fraction(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT)
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.avg("toxic").alias("toxic"))
    )
    marked = common.stored(marked, "toxic-marked")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Texts that surely have no label stay where they are; the join by hash is the same plan at every size.
    rows = rows.where(common.may_be_in(marked.select("id"))(F.col("id")))
    train = common.stored(rows.join(marked.hint("shuffle_hash"), "id"), "toxic-train")
    total = train.agg(F.count("*").alias("n"), F.sum((F.col("toxic") >= 0.5).cast("long")).alias("t")).first()
    n, toxic = total["n"], total["t"] or 0
    prior = (toxic + 1) / (n + 2)
    counts = (
        train.select("text", "toxic")
        .mapInArrow(_count_units(model), "unit string, n bigint, toxic bigint")
        .groupBy("unit")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= LEAST_DOCS)
    )
    # Odds against the prior, with a cautious share: one standard error below the smoothed one.
    share = (F.col("toxic") + prior) / (F.col("n") + 1)
    careful = F.greatest(share - F.sqrt(share * (1 - share) / (F.col("n") + 1)), F.lit(1e-3))
    odds = F.log(careful / (1 - careful)) - math.log(prior / (1 - prior))
    rows = common.stored(counts.withColumn("odds", F.least(odds, F.lit(8.0))).where("odds > 0.7"), "toxic-units")
    rows = common.most_frequent(rows, "odds", MOST_FEATURES, fill="unit")
    scorer = Scorer(model, {r["unit"]: r["odds"] for r in rows}, np.array([math.log(prior / (1 - prior)), 0, 0, 0]))
    if 0 < toxic < n:
        chosen = train.where(common.one_of(F.xxhash64("id"), MOST_FITTED, n))
        found = chosen.select("text", "toxic").mapInArrow(_vectors(scorer), "x array<double>, toxic double").toPandas()
        if found["toxic"].ge(0.5).nunique() == 2:
            scorer.weights = fit_logistic(np.stack(found["x"]), found["toxic"].ge(0.5).to_numpy(float), 0.1)
    return scorer


def toxic_udf(scorer: Scorer):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer.start()
        for texts in parts:
            yield pd.Series(scorer(texts.tolist()), dtype=float)
        common.release(scorer.known.joins, scorer.known)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`.

    `labels` has (doc_id, toxic 0/1); labels of held-out ids are never read.
    Predictions use the text alone. A null text counts as empty and, like a text
    without evidence, gets the score of no evidence. A null id is not held out
    and never trains. Repeated rows are scored each; contradicting labels of one
    id are averaged. Without usable labels every score is the prior 0.5. Other
    columns are not looked at; an empty table gives no rows.
    """
    scorer = scorer or fit(docs, labels, id_col, text_col)
    column = F.col(id_col)
    return (
        docs.select(
            column.alias(id_col),
            F.coalesce(common.fraction(column, HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"),
            toxic_udf(scorer)(F.coalesce(F.col(text_col), F.lit(""))).alias("score"),
        )
        .withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their own columns."""
    scorer = fit(docs, labels)
    value = toxic_udf(scorer)(F.coalesce(F.col("text"), F.lit("")))
    return docs.where(value < TOXIC_FROM)
