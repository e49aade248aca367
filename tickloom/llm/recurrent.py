"""Language-model scores of whole texts by a gated recurrent network.

The network is a GRU with a class-factored output softmax, trained in numpy by
truncated backpropagation. Frequent words are predicted as class, then word in
the class. Every other word belongs to the class of its ending; in it, words
have their smoothed share of the corpus counts, so the vocabulary is not cut.

Training: a first fit in one task on a bounded sample, then every task trains
from there on all training texts of its partition, and the weights
are averaged by Spark. Scoring carries the state through a text from its first to its last word.
Counts cover all training texts. Counts of frequent words are shipped in a table
of fixed size; all other words of a text are joined to the counts by a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

HELD_OUT_OF, HELD_OUT = 5, 1
END = b""
MARKS = b".,;:!?)\"'"
HOT_WORDS = 131_072
OUTPUT_WORDS = 2_048
CLASS_WORDS = 64
ENDINGS = 127
HIDDEN = 24
WINDOW = 16
LANES, TRAIN_LANES = 128, 64
SAMPLE_DOCS = 2_000
COUNT_TOKENS = 2_000_000
FLUSH_TOKENS = 16_384  # of which the output is computed at a time
CHUNK = 1_024  # columns of a softmax at a time
BLOCK = 8_192  # weights that are updated at a time, few enough to stay in the processor's cache
OFTEN = 8  # times an id occurs in a window
LEAST_SUM = 1e-20  # of exponentials that are summed as they are
BATCH_TOKENS = 600_000
RATE = 0.08
SMOOTH = 0.5


def ending(word: bytes) -> bytes:
    """Last letters of a word before its punctuation, by which rare words are classed."""
    return word.rstrip(MARKS)[-3:]


def ending_rows(words: pa.Array) -> pa.Array:
    """`ending` of each of the words, which are binary."""
    return pc.binary_slice(pc.ascii_rtrim(words.view(pa.utf8()), characters=MARKS.decode()).view(pa.binary()), -3)


class Vocabulary:
    """Frequent words with their counts; classes of all words.

    Ids 0 to `size` - 1 are predicted words (0 is the end), the following ids are
    the ending classes, the last one of all other endings.
    """

    def __init__(self, words: list[bytes], endings: list[bytes]) -> None:
        self.size = len(words)
        self.words, self.endings = pa.array(words, pa.binary()), pa.array(endings, pa.binary())
        self.rest = self.size + len(endings)
        self.inputs = self.rest + 1
        self.word_classes = -(-self.size // CLASS_WORDS)
        self.classes = self.word_classes + len(endings) + 1
        every = np.arange(self.inputs)
        self.class_by_id = np.where(every < self.size, every // CLASS_WORDS, self.word_classes + every - self.size)

    def ids(self, words: pa.Array) -> np.ndarray:
        found = places(words, self.words)
        others = np.flatnonzero(found == self.size)
        found[others] += places(ending_rows(words.take(pa.array(others))), self.endings)
        return found

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return self.class_by_id.take(ids)


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word in `among`, or its length."""
    return pc.index_in(words, value_set=among).fill_null(len(among)).to_numpy(zero_copy_only=False).astype(np.int64)


class Network:
    """GRU weights by name, all float32.

    `gates` maps an input id to its part of the reset, update and candidate
    gates, an embedding already multiplied by the input weights.
    """

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.__dict__.update(weights)
        self.names = list(weights)

    @classmethod
    def start(cls, vocabulary: Vocabulary, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(11)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        words = vocabulary.word_classes * CLASS_WORDS
        return cls(
            {
                "gates": normal(vocabulary.inputs, 3 * hidden),
                "state": normal(hidden, 3 * hidden) * 3,
                "bias": np.zeros(3 * hidden, np.float32),
                "to_class": normal(hidden, vocabulary.classes),
                "class_bias": np.zeros(vocabulary.classes, np.float32),
                "to_word": normal(words, hidden),
                "word_bias": np.where(np.arange(words) < vocabulary.size, 0, -30).astype(np.float32),
            }
        )

    def set_shares(self, vocabulary: Vocabulary, words: np.ndarray, masses: np.ndarray) -> None:
        """Biases at which a network without memory gives every word its share of the counts."""
        padded = np.zeros(vocabulary.word_classes * CLASS_WORDS)
        padded[: len(words)] = words
        with np.errstate(divide="ignore"):
            self.word_bias[:] = np.maximum(np.log(padded), -30)
        self.class_bias[:] = np.log(np.concatenate([padded.reshape(-1, CLASS_WORDS).sum(axis=1), masses]) / (padded.sum() + masses.sum()))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.names])

    def filled(self, flat: np.ndarray) -> Network:
        weights, at = {}, 0
        for name in self.names:
            value = getattr(self, name)
            weights[name] = flat[at : at + value.size].reshape(value.shape).astype(np.float32)
            at += value.size
        return Network(weights)

    def inputs_table(self) -> np.ndarray:
        """Part of every input in the gates, with the bias; `run` takes half of the reset and update gates."""
        table = self.gates + self.bias
        table[:, : 2 * len(self.state)] *= np.float32(0.5)
        return table

    def run(
        self, inputs: np.ndarray, first: np.ndarray, state: np.ndarray, table: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, gates, gated states) of a window; `inputs` are steps by lanes, all others have the lanes last.

        `gates` holds reset, update and candidate one below the other. Where `first`
        is true a lane starts from zero. With the `inputs_table` of these weights the
        states alone are kept of all steps.
        """
        (steps, width), size = inputs.shape, len(state)
        # 1 / (1 + exp(-x)) is half of tanh(x / 2) and a half.
        half, keep = np.float32(0.5), table is None
        if keep:
            added = self.gates.take(inputs, axis=0)
            added += self.bias
            added[:, :, : 2 * size] *= half
        else:
            added = table.take(inputs, axis=0)
        added = added.transpose(0, 2, 1)
        if keep:
            added = added.copy()
        to_both, to_candidate = half * self.state[:, : 2 * size].T, self.state[:, 2 * size :].T.copy()
        gates = np.empty((steps if keep else 1, 3 * size, width), np.float32)
        gated = np.empty((len(gates), size, width), np.float32)
        states = np.empty((steps, size, width), np.float32)
        begins = first.any(axis=1).tolist()
        for t in range(steps):
            if begins[t]:
                state = np.where(first[t], np.float32(0), state)
            here, now, product, after = added[t], gates[t if keep else 0], gated[t if keep else 0], states[t]
            both, update, candidate = now[: 2 * size], now[size : 2 * size], now[2 * size :]
            np.dot(to_both, state, out=both)
            both += here[: 2 * size]
            np.tanh(both, out=both)
            both *= half
            both += half
            np.multiply(now[:size], state, out=product)
            np.dot(to_candidate, product, out=candidate)
            candidate += here[2 * size :]
            np.tanh(candidate, out=candidate)
            np.subtract(candidate, state, out=after)
            after *= update
            after += state
            state = after
        return states, gates, gated

    def log_probabilities(self, vocabulary: Vocabulary, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for predicted words, of P(word | class)."""
        return self.row_logs(vocabulary, with_ones(states.T[None]), targets)

    def row_logs(self, vocabulary: Vocabulary, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """`log_probabilities` of states that end with a column of ones."""
        out = np.empty(len(targets))
        classes = vocabulary.class_of(targets)
        to_class = np.vstack([self.to_class, self.class_bias])
        for low in range(0, len(targets), CHUNK):
            part = slice(low, low + CHUNK)
            out[part] = log_shares(states[part], to_class, classes[part])
        order, edges = self._by_class(vocabulary, classes)
        ordered, inside, to_word = states.take(order, axis=0), targets[order] % CLASS_WORDS, self.words_by_class()
        found = np.empty(len(order))
        for c in np.flatnonzero(np.diff(edges)).tolist():
            for low in range(edges[c], edges[c + 1], CHUNK):
                part = slice(low, min(low + CHUNK, edges[c + 1]))
                found[part] = log_shares(ordered[part], to_word[c], inside[part])
        out[order] += found
        return out

    def words_by_class(self) -> np.ndarray:
        """Output weights of words, with their bias in the last row: classes, hidden units and one, words."""
        hidden = len(self.state)
        out = np.empty((len(self.to_word) // CLASS_WORDS, hidden + 1, CLASS_WORDS), np.float32)
        out[:, :hidden] = self.to_word.reshape(-1, CLASS_WORDS, hidden).transpose(0, 2, 1)
        out[:, hidden] = self.word_bias.reshape(-1, CLASS_WORDS)
        return out

    @staticmethod
    def _by_class(vocabulary: Vocabulary, classes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(places of the predicted words, class by class, where each class begins and the last one ends)."""
        edges = np.cumsum(np.bincount(classes, minlength=vocabulary.word_classes)[: vocabulary.word_classes]).tolist()
        # Classes of words are the first ones.
        return sorted_places(classes, vocabulary.classes)[: edges[-1]], [0, *edges]


def sorted_places(ids: np.ndarray, count: int) -> np.ndarray:
    """Places of ids below `count` in their order; numpy sorts short integers by their digits."""
    return np.argsort(ids.astype(np.int16) if count <= 1 << 15 else ids, kind="stable")


def exponentials(scores: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """(exponentials, their sum in each row, what was taken off the scores first).

    Nothing is taken off unless a sum becomes very large or small.
    """
    found = scores()
    every = np.ones(found.shape[1], np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(found, out=found)
        sums = found @ every
    if LEAST_SUM < sums.min(initial=1) and sums.max(initial=1) < 1 / LEAST_SUM:
        return found, sums, 0.0
    found = scores()
    top = found.max(axis=1)
    found -= top[:, None]
    np.exp(found, out=found)
    return found, found @ every, top


def log_shares(states: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at the place `wanted`; `states` end with a column of ones."""
    _, sums, top = exponentials(lambda: states @ weights)
    return np.einsum("ij,ij->i", states, weights.T.take(wanted, axis=0)) - (np.log(sums) + top)


def softmax_errors(scores: Callable[[], np.ndarray], wanted: np.ndarray, scale: np.float32) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays whose product is `scale` times the softmax of each row of scores less one at the place `wanted`."""
    found, sums, _ = exponentials(scores)
    found.reshape(-1)[np.arange(0, found.size, found.shape[1]) + wanted] -= sums
    return found, (scale / sums)[:, None]


def with_ones(states: np.ndarray) -> np.ndarray:
    """States (steps, hidden, lanes) as rows, with a column of ones by which a product adds the bias."""
    steps, hidden, width = states.shape
    rows = np.ones((steps, width, hidden + 1), np.float32)
    rows[:, :, :hidden] = states.transpose(0, 2, 1)
    return rows.reshape(-1, hidden + 1)


def lanes(texts: list[np.ndarray], count: int) -> list[list[int]]:
    """Texts dealt to lanes of about equal length, the longest first."""
    dealt: list[list[int]] = [[] for _ in range(max(1, min(count, len(texts))))]
    load = np.zeros(len(dealt), np.int64)
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        lane = int(np.argmin(load))
        dealt[lane].append(i)
        load[lane] += len(texts[i])
    order = np.argsort(-load, kind="stable")
    return [dealt[i] for i in order if dealt[i]]


def streams(texts: list[np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, first, lengths): lanes as columns, longest first; `first` marks where a text begins."""
    dealt = lanes(texts, count)
    lengths = np.array([sum(len(texts[i]) for i in lane) for lane in dealt], np.int64)
    tokens = np.zeros((int(lengths.max(initial=0)), len(dealt)), np.int64)
    first = np.zeros(tokens.shape, bool)
    for column, lane in enumerate(dealt):
        tokens[: lengths[column], column] = np.concatenate([texts[i] for i in lane])
        starts = np.cumsum([0, *(len(texts[i]) for i in lane[:-1])])
        first[starts, column] = True
    return tokens, first, lengths


def previous_tokens(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each one; an end before a text."""
    before = np.vstack([np.zeros((1, tokens.shape[1]), np.int64), tokens[:-1]])
    before[first] = 0
    return before


def windows(lengths: np.ndarray, steps: int, size: int) -> Iterator[tuple[int, tuple[slice, slice], np.ndarray]]:
    """(first step, rows and lanes, which places hold a token) of each window; a lane that is used up leaves."""
    for low in range(0, steps, size):
        width = int(np.searchsorted(-lengths, -low, side="left"))
        high = min(low + size, steps)
        yield low, (slice(low, high), slice(width)), np.arange(low, high)[:, None] < lengths[:width]


def text_logs(network: Network, vocabulary: Vocabulary, texts: list[np.ndarray], count: int = LANES) -> np.ndarray:
    """log10 probability of every text's network tokens; each text ends with id 0.

    Lanes step together; a lane that is used up leaves. Between windows of the
    output computation the state is carried on.
    """
    if not texts:
        return np.empty(0)
    dealt = lanes(texts, count)
    tokens, first, lengths = streams(texts, count)
    before = previous_tokens(tokens, first)
    logs = np.zeros(tokens.shape, np.float64)
    state, table = np.zeros((network.state.shape[0], len(lengths)), np.float32), network.inputs_table()
    held, targets, places = [], [], []

    def flush() -> None:
        if held:
            value = network.row_logs(vocabulary, np.concatenate(held), np.concatenate(targets))
            at = 0
            for low, live in places:
                size, into = np.count_nonzero(live), logs[low : low + len(live), : live.shape[1]]
                if size == live.size:
                    into[:] = value[at : at + size].reshape(live.shape)
                else:
                    into[live] = value[at : at + size]
                at += size
            held.clear(), targets.clear(), places.clear()

    for low, part, live in windows(lengths, len(tokens), WINDOW):
        states, *_ = network.run(before[part], first[part], state[:, : live.shape[1]], table)
        state = states[-1]
        rows, wanted, on = with_ones(states), tokens[part].reshape(-1), live.reshape(-1)
        held.append(rows if on.all() else rows[on])
        targets.append(wanted if on.all() else wanted[on])
        places.append((low, live))
        if sum(map(len, targets)) >= FLUSH_TOKENS:
            flush()
    flush()
    out = np.empty(len(texts))
    for column, lane in enumerate(dealt):
        starts = np.cumsum([0, *(len(texts[i]) for i in lane[:-1])])
        out[lane] = np.add.reduceat(logs[: lengths[column], column], starts)
    return out / np.log(10)


class Trainer:
    """Truncated backpropagation with Adagrad over lanes of texts."""

    def __init__(self, network: Network, vocabulary: Vocabulary, rate: float = RATE, window: int = WINDOW) -> None:
        self.network, self.vocabulary, self.rate, self.window = network, vocabulary, rate, window
        self.squares = {n: np.full(getattr(network, n).shape, 1e-2, np.float32) for n in network.names}

    def apply(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        weights, squares = getattr(self.network, name), self.squares[name]
        if not isinstance(rows, slice):
            held = squares.take(rows, axis=0)
            self._change(gradient, held)
            squares[rows] = held
            weights[rows] = np.subtract(weights.take(rows, axis=0), gradient, out=gradient)
            return
        size = max(1, BLOCK * len(gradient) // max(1, gradient.size))
        for low in range(0, len(gradient), size):
            part = slice(low, low + size)
            self._change(gradient[part], squares[part])
            weights[part] -= gradient[part]

    def _change(self, gradient: np.ndarray, squares: np.ndarray) -> None:
        """Adds to the squares and turns a gradient into the change of the weights."""
        root = gradient * gradient
        if not root.max(initial=0) <= 1:
            np.minimum(np.maximum(gradient, -1, out=gradient), 1, out=gradient)
            np.multiply(gradient, gradient, out=root)
        squares += root
        np.sqrt(squares, out=root)
        gradient *= np.float32(self.rate)
        gradient /= root

    def fit(self, texts: list[np.ndarray], count: int = TRAIN_LANES) -> None:
        tokens, first, lengths = streams(texts, count)
        before = previous_tokens(tokens, first)
        state = np.zeros((self.network.state.shape[0], len(lengths)), np.float32)
        for _, part, live in windows(lengths, len(tokens), self.window):
            state = self._window(before[part], tokens[part], first[part], live, state[:, : live.shape[1]])

    def _window(
        self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray, live: np.ndarray, state: np.ndarray
    ) -> np.ndarray:
        net, (steps, width), hidden = self.network, inputs.shape, len(state)
        states, gates, gated = net.run(inputs, first, state)
        previous = np.concatenate([state[None], states[:-1]])
        np.copyto(previous, 0, where=first[:, None])
        flat = with_ones(states)
        on, wanted = live.reshape(-1), targets.reshape(-1)
        if on.all():
            back = self._output(flat, wanted, on.size)
        else:
            back = np.zeros((on.size, hidden), np.float32)
            back[on] = self._output(flat[on], wanted[on], max(1, int(on.sum())))
        back = back.reshape(steps, width, hidden).transpose(0, 2, 1).copy()

        # The parts of the gradients that do not depend on later steps, for the whole window.
        reset, update, candidate = (gates[:, i * hidden : (i + 1) * hidden] for i in range(3))
        kept = 1 - update
        by_candidate = (1 - candidate * candidate) * update
        by_reset = (1 - reset) * reset * previous
        by_update = (candidate - previous) * update * kept
        from_both, from_candidate = net.state[:, : 2 * hidden].copy(), net.state[:, 2 * hidden :].copy()
        to_gates = np.empty_like(gates)
        carried = np.zeros_like(states[0])
        begins = first.any(axis=1).tolist()
        for t in reversed(range(steps)):
            carried += back[t]
            np.multiply(carried, by_candidate[t], out=to_gates[t, 2 * hidden :])
            d_gated = np.dot(from_candidate, to_gates[t, 2 * hidden :])
            np.multiply(d_gated, by_reset[t], out=to_gates[t, :hidden])
            np.multiply(carried, by_update[t], out=to_gates[t, hidden : 2 * hidden])
            carried *= kept[t]
            d_gated *= reset[t]
            carried += d_gated
            carried += np.dot(from_both, to_gates[t, : 2 * hidden])
            if begins[t]:
                carried[:, first[t]] = 0
        lanes_first = to_gates.transpose(0, 2, 1)
        by_both = previous @ lanes_first[:, :, : 2 * hidden]
        by_candidate = gated @ lanes_first[:, :, 2 * hidden :]
        state_gradient = np.concatenate([by_both.sum(axis=0), by_candidate.sum(axis=0)], axis=1)
        by_token = lanes_first.reshape(-1, 3 * hidden)
        self.apply("gates", *row_sums(by_token, inputs.reshape(-1), len(net.gates)))
        self.apply("state", state_gradient)
        self.apply("bias", to_gates.sum(axis=2).sum(axis=0))
        return states[-1]

    def _output(self, states: np.ndarray, targets: np.ndarray, total: int) -> np.ndarray:
        """Updates the output weights; returns the gradient of the states. `states` ends with a column of ones, by which a product adds the bias."""
        net, scale, hidden = self.network, np.float32(32.0 / total), states.shape[1] - 1
        classes = self.vocabulary.class_of(targets)
        to_class = np.vstack([net.to_class, net.class_bias])
        scores, factor = softmax_errors(lambda: states @ to_class, classes, scale)
        back = scores @ net.to_class.T
        back *= factor
        gradient = (states * factor).T @ scores
        self.apply("to_class", gradient[:-1])
        self.apply("class_bias", gradient[-1])
        # The words of all classes that occur; a class that does not gets a gradient of zero, which changes nothing.
        order, edges = net._by_class(self.vocabulary, classes)
        here, to_word = states.take(order, axis=0), net.words_by_class()
        parts = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]

        def word_scores() -> np.ndarray:
            out = np.empty((len(order), CLASS_WORDS), np.float32)
            for c, part in parts:
                np.dot(here[part], to_word[c], out=out[part])
            return out

        gradient = np.zeros((len(to_word), CLASS_WORDS, hidden + 1), np.float32)
        if parts:
            scores, factor = softmax_errors(word_scores, targets[order] % CLASS_WORDS, scale)
            here *= factor
            to_states, net_words = np.empty((len(order), hidden), np.float32), net.to_word.reshape(-1, CLASS_WORDS, hidden)
            for c, part in parts:
                np.dot(scores[part].T, here[part], out=gradient[c])
                np.dot(scores[part], net_words[c], out=to_states[part])
            to_states *= factor
            back[order] = np.add(to_states, back.take(order, axis=0), out=to_states)
        gradient = gradient.reshape(-1, hidden + 1)
        self.apply("to_word", gradient[:, :-1].copy())
        self.apply("word_bias", gradient[:, -1].copy())
        return back


def row_sums(values: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the rows of each id that occurs, these ids); ids are smaller than `count`.

    Ids that occur often are summed run by run, all others row after row together.
    """
    times = np.bincount(ids, minlength=count)
    rows = np.flatnonzero(times)
    times = times[rows]
    order, starts = sorted_places(ids, count), np.cumsum(times) - times
    sums = values.take(order[starts], axis=0)
    for k in range(1, OFTEN):
        more = np.flatnonzero((times > k) & (times <= OFTEN))
        if not len(more):
            break
        sums[more] = sums.take(more, axis=0) + values.take(order[starts[more] + k], axis=0)
    often = times > OFTEN
    if often.any():
        ends = np.cumsum(times[often])
        sums[often] = np.add.reduceat(values.take(order[np.repeat(often, times)], axis=0), ends - times[often], axis=0)
    return sums, rows


def tokens_of(texts: pa.Array) -> pa.ListArray:
    """Words of binary texts as `common.words` finds them, each text with its end, the empty word."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(pa.utf8())))
    # What follows the last blank is the end; a text without words has no blank.
    with_end = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), trimmed, pc.binary_join_element_wise(trimmed, "", " "))
    split = pc.ascii_split_whitespace(with_end)
    return pa.ListArray.from_arrays(split.offsets, split.values.view(pa.binary()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0

    def rows() -> pa.RecordBatch:
        counted = pa.chunked_array(held, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "c"])

    for batch in batches:
        held.append(tokens_of(batch.column(0)).flatten())
        total += len(held[-1])
        if total >= COUNT_TOKENS:
            yield rows()
            held, total = [], 0
    yield rows()


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([ending_rows(batch.column(0)), batch.column(1)], names=["ending", "c"])


def _token_batches(batches: Iterator[pa.RecordBatch], column: int, most: int):
    """Runs of rows with about `most` tokens: (record batches, distinct words, place of each token among them, edges of the texts)."""
    held, texts, total = [], [], 0

    def run() -> tuple[list[pa.RecordBatch], pa.Array, np.ndarray, np.ndarray]:
        coded = pa.chunked_array([x.flatten() for x in texts]).dictionary_encode().unify_dictionaries().chunks
        lengths = [x.value_lengths().to_numpy(zero_copy_only=False) for x in texts]
        indices = [x.indices.to_numpy(zero_copy_only=False) for x in coded]
        return held, coded[0].dictionary, np.concatenate(indices), np.cumsum(np.concatenate([[0], *lengths]))

    for batch in batches:
        held.append(batch)
        texts.append(tokens_of(batch.column(column)))
        total += len(texts[-1].flatten())
        if total >= most:
            yield run()
            held, texts, total = [], [], 0
    if total:
        yield run()


def _train(vocabulary: Vocabulary, start: np.ndarray, passes: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(Network.start(vocabulary).filled(start), vocabulary, rate)
        tokens, kept = 0, []
        for _, words, coded, edges in _token_batches(batches, 0, BATCH_TOKENS):
            texts = np.split(vocabulary.ids(words)[coded], edges[1:-1])
            trainer.fit(texts)
            tokens += len(coded)
            if passes > 1:
                kept.append(texts)
        for _ in range(passes - 1):
            for texts in kept:
                trainer.fit(texts)
        if tokens:
            flat = trainer.network.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64)), pa.array(np.full(len(flat), tokens))],
                names=["place", "weight", "tokens"],
            )

    return run


def _averaged(trained: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """Weights of all tasks averaged by tokens; one row per weight reaches the driver."""
    rows = trained.groupBy("place").agg((F.sum(F.col("weight") * F.col("tokens")) / F.sum("tokens")).alias("weight"))
    found = rows.toPandas().sort_values("place")
    return found["weight"].to_numpy(np.float32) if len(found) else otherwise


def _score(vocabulary: Vocabulary, flat: np.ndarray, hot: dict[bytes, int], masses: np.ndarray):
    """Per text its sums over frequent words, and its other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.start(vocabulary).filled(flat)
        row = TaskContext.get().partitionId() << 36
        log_mass = np.log10(np.maximum(masses, SMOOTH))
        hot_words, counts = pa.array(list(hot), pa.binary()), np.fromiter(hot.values(), np.float64, len(hot))
        logs = np.append(np.log10(counts + SMOOTH), 0.0)
        seen = np.append(counts > 0, False).astype(np.int64)
        for held, words, coded, edges in _token_batches(batches, 1, BATCH_TOKENS):
            own, place = vocabulary.ids(words), places(words, hot_words)
            rare = own >= vocabulary.size
            inside = np.where(rare, logs[place] - log_mass[np.maximum(own - vocabulary.size, 0)], 0.0)
            starts, n = edges[:-1], len(edges) - 1
            scores = text_logs(network, vocabulary, np.split(own[coded], edges[1:-1]))
            # Distinct words of a text that are not among the frequent ones, with their numbers.
            cold = np.flatnonzero((place == len(hot))[coded])
            text = np.searchsorted(edges, cold, side="right") - 1
            pairs, cold_n = np.unique(text * len(words) + coded[cold], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * len(words)).astype(np.int32))
            rows = pa.array(np.arange(row, row + n))
            row += n
            yield pa.RecordBatch.from_arrays(
                [
                    rows,
                    pa.concat_arrays([b.column(0) for b in held]),
                    pa.array(np.diff(edges), pa.int64()),
                    pa.array(np.add.reduceat(seen[place][coded], starts), pa.int64()),
                    pa.array(np.add.reduceat(logs[place][coded], starts), pa.float64()),
                    pa.array(np.add.reduceat(inside[coded], starts) + scores, pa.float64()),
                    pa.ListArray.from_arrays(offsets, words.take(pa.array(pairs % len(words)))),
                    pa.ListArray.from_arrays(offsets, pa.array(cold_n, pa.int64())),
                ],
                names=["row", "id", "n_tokens", "known", "hot_log", "rare_log", "cold", "cold_n"],
            )

    return run


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_words: int = HOT_WORDS,
    output_words: int = OUTPUT_WORDS,
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs`.

    Tokens are the words and one end. `base_score` is the smoothed unigram log10
    probability, `score` the network's. Both give a positive probability to every
    word: an unseen word counts as half an occurrence.

    The counts cover all training texts. The weights are first fitted on about
    `sample_docs` of them, chosen by a hash, then on all of them in parallel.

    Texts with a null id neither train nor are held out. A null text counts as
    empty: its end alone. Repeated rows are scored and counted each. Without
    training texts both scores are defined by the smoothing alone. Other columns
    are not looked at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), common.text_bytes(F.col(text_col)).alias("text"))
    train = rows.where(F.coalesce(common.fraction(F.col("id"), HELD_OUT_OF) != HELD_OUT, F.lit(False)))
    counts = common.stored(
        train.select("text").mapInArrow(_count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"),
        "word-counts",
    )
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    number, distinct = total["n"] or 0, total["v"]
    frequent = {bytes(r["word"]): r["c"] for r in common.most_frequent(counts, "c", hot_words)}
    hot = {END: 0} | {w: frequent[w] for w in sorted(frequent, key=lambda w: (-frequent[w], w))}
    predicted = [END, *[w for w in hot if w != END][: output_words - 1]]

    # Masses of the endings: all counts, with the predicted words taken off.
    by_ending = counts.mapInArrow(_endings, "ending binary, c bigint").groupBy("ending").agg(
        F.sum("c").alias("c"), F.count("*").alias("v")
    )
    by_ending = common.stored(by_ending, "ending-counts")
    inside_c: Counter[bytes] = Counter()
    inside_v: Counter[bytes] = Counter()
    for word in predicted:
        if hot[word]:
            inside_c[ending(word)] += hot[word]
            inside_v[ending(word)] += 1
    top = by_ending.orderBy(F.desc("c"), "ending").limit(4 * ENDINGS).collect()
    mass = {bytes(r["ending"]): r["c"] - inside_c[bytes(r["ending"])] + SMOOTH * (r["v"] - inside_v[bytes(r["ending"])]) for r in top}
    endings = sorted(mass, key=lambda e: (-mass[e], e))[:ENDINGS]
    vocabulary = Vocabulary(predicted, endings)
    every = by_ending.agg(F.sum("c").alias("c"), F.sum("v").alias("v")).first()
    whole = (every["c"] or 0) - sum(inside_c.values()) + SMOOTH * ((every["v"] or 0) - sum(inside_v.values()))
    masses = np.array([*(mass[e] for e in endings), whole - sum(mass[e] for e in endings)]) + SMOOTH

    start = Network.start(vocabulary)
    hashed = F.xxhash64("id", F.length("text"))
    start.set_shares(vocabulary, np.array([hot[w] for w in predicted]) + SMOOTH, masses)
    start = start.flat()
    chosen = train.where(common.one_of(hashed, sample_docs, train.count()))
    schema = "place bigint, weight double, tokens bigint"
    first = _averaged(chosen.select("text").repartition(1).mapInArrow(_train(vocabulary, start, 2, RATE), schema), start)
    flat = _averaged(train.select("text").mapInArrow(_train(vocabulary, first, 1, RATE / 4), schema), first)

    shared = spark.sparkContext.broadcast((vocabulary, flat, hot, masses))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(*shared.value)(batches)

    id_type = dict(rows.dtypes)["id"]
    partial = common.stored(
        rows.mapInArrow(
            run,
            f"row bigint, id {id_type}, n_tokens bigint, known bigint, hot_log double, rare_log double, "
            "cold array<binary>, cold_n array<bigint>",
        ),
        "lm-partial",
    )
    cold = partial.select("row", F.explode(F.arrays_zip("cold", "cold_n")).alias("x")).select(
        "row", F.col("x.cold").alias("word"), F.col("x.cold_n").alias("n")
    )
    known = F.col("c").isNotNull()
    found = (
        cold.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(known, F.col("n")).otherwise(0)).alias("cold_known"),
            F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("cold_log"),
        )
    )
    norm = float(np.log10(number + SMOOTH * (distinct + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return partial.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce(common.fraction(F.col("id"), HELD_OUT_OF) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("cold_known")).alias("n_known"),
        F.lit(number).cast("long").alias("train_tokens"),
        (F.col("hot_log") + zero("cold_log") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("rare_log") + zero("cold_log")).alias("score"),
    )
