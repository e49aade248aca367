"""Packing of token sequences by first-fit decreasing in randomised groups.

Documents are tokenised and cut at the sequence length; the pieces are dealt to
groups of a few thousand by their row number, and each group is packed by
first-fit decreasing. A tournament tree over the bins' free room gives the first
bin that fits in logarithmic time. Groups are independent, so a task never holds
more than one group; the padding lost at group ends is below one bin per group.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common

VOCABULARY = "word_bpe_49k.json"
SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 4096
RUN_CHUNKS = 64  # pieces that are encoded as one text
LATIN_END = r"^[\x00-\xff]*[0-9A-Za-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]$"  # a letter or a number after nothing but Latin-1
PIECES = "length long, start long, ids_crc32 long, doc_tokens long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkIds(dict):
    """Little-endian 32-bit ids of the pieces of a text between blanks.

    The tokenizer never joins characters across white space and drops it, so a
    text's ids are those of its pieces one after another. Each distinct piece of a
    batch is looked up once, and Arrow puts the ids in order. White space other than
    ASCII stays inside a piece and is left to the tokenizer. It lower-cases and
    splits signs from letters, so a piece of Latin letters with signs at its end
    is its lower-cased letters, then its signs.
    """

    signs = ".,;:!?|#$%&*"

    def __init__(self, path: str, most: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.most = most
        added = (x.content for x in self.tokenizer.get_added_tokens_decoder().values())
        # Letters by what of them reaches the model, so that it can be asked for their words alone.
        letters = "".join(x for x in map(chr, range(97, 256)) if x.isalpha() and x.islower() and self.seen(x) is not None)
        self.letters = {x: self.seen(x) for x in letters}
        self.table = str.maketrans(self.letters)
        self.plain = (
            self.tokenizer.post_processor is None
            and not any(map(str.isalpha, added))
            and self.seen(letters) == letters.translate(self.table)
        )

    def seen(self, word: str) -> str | None:
        """What the model gets of a word that is neither changed nor cut before."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is not None and normal.normalize_str(word) != word:
            return None
        parts = [(word, (0, len(word)))] if cut is None else cut.pre_tokenize_str(word)
        return parts[0][0] if len(parts) == 1 and parts[0][1] == (0, len(word)) else None

    def separator(self) -> tuple[str, int] | None:
        """(text, id) of a special token in signs that the tokenizer cuts out of the raw text wherever it stands."""
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            inside = token.content[:1].isalnum() or token.content[-1:].isalnum()
            if token.special and not (inside or token.normalized or token.single_word or token.lstrip or token.rstrip):
                return token.content, i
        return None

    def halves(self, chunk: str) -> tuple[str, str]:
        core = chunk.rstrip(self.signs)
        if not core or not core[-1].isalnum() or "<|" in core or not core.isascii() and max(core) > "\xff":
            return chunk, ""
        return core.lower(), chunk[len(core) :]

    def add(self, chunks: list[str]) -> None:
        """Plain words are given to the model. Other chunks are encoded as longer texts, set apart by a special token; those that hold it alone."""
        if self.plain:
            others, model, own = [], self.tokenizer.model, frozenset(self.letters)
            ascii_as_is = all(self.letters[x] == x for x in own if x.isascii())
            for chunk in chunks:
                if chunk and own.issuperset(chunk):
                    seen = chunk if ascii_as_is and chunk.isascii() else chunk.translate(self.table)
                    self[chunk] = array("I", [token.id for token in model.tokenize(seen)]).tobytes()
                else:
                    others.append(chunk)
            chunks = others
        apart = self.separator()
        if apart is not None:
            text, between = apart
            joined = [c for c in chunks if text not in c]
            for start in range(0, len(joined), RUN_CHUNKS):
                part = joined[start : start + RUN_CHUNKS]
                (found,) = self.tokenizer.encode_batch_fast([text.join(part)], add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                data, edges = ids.tobytes(), (4 * np.flatnonzero(ids == between)).tolist()
                for chunk, low, high in zip(part, [-4, *edges], [*edges, len(data)], strict=True):
                    self[chunk] = data[low + 4 : high]
            chunks = [c for c in chunks if text in c]
        for start in range(0, len(chunks), 4096):
            part = chunks[start : start + 4096]
            for chunk, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[chunk] = array("I", found.ids).tobytes()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of every piece."""
        if len(self) > self.most:
            # What is asked for stays: the frequent pieces are in every batch.
            kept = {chunk: self[chunk] for chunk in chunks if chunk in self}
            self.clear()
            self.update(kept)
        found = list(map(self.get, chunks))
        places = [i for i, ids in enumerate(found) if ids is None]
        new = [chunks[i] for i in places]
        cores, tails = self.all_halves(new)
        self.add([x for x in {*cores, *filter(None, tails)} if x not in self])
        for i, chunk, core, tail in zip(places, new, cores, tails, strict=True):
            found[i] = self[chunk] = self[core] + self[tail] if tail else self[core]
        return found

    def all_halves(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """`halves` of many pieces; Arrow splits those of Latin letters."""
        split = pa.array(chunks, pa.string())
        cores = pc.ascii_rtrim(split, characters=self.signs)
        plain = pc.match_substring_regex(cores, LATIN_END)
        plain = pc.and_not(plain, pc.match_substring(cores, "<|"))
        found = common.strings(pc.if_else(plain, pc.utf8_lower(cores), split))
        tails = [chunk[len(core) :] for chunk, core in zip(chunks, found, strict=True)]
        for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
            found[i], tails[i] = self.halves(chunks[i])
        return found, tails

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text, without the end."""
        chunks, places, edges = common.coded(pc.ascii_split_whitespace(texts))
        found = pa.array(self.learn(chunks), pa.large_binary()).take(places)
        if not len(found) or found.buffers()[2] is None:
            return iter([b""] * len(texts))
        starts = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1)
        data = memoryview(found.buffers()[2])
        ends = starts[edges].tolist()
        return (bytes(data[low:high]) for low, high in zip(ends, ends[1:]))


_HELD: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The pieces that this Python worker has met, kept from task to task."""
    if path not in _HELD:
        _HELD[path] = ChunkIds(path)
    return _HELD[path]


def _pieces(path: str | None, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = chunk_ids(path or vocabulary_path(VOCABULARY))
        for batch in batches:
            rows, lengths, starts, sums, totals = [], [], [], [], []
            for row, text in enumerate(ids.encode(batch.column(1))):
                found = text + end
                total = len(found) // 4
                for start in range(0, total, size):
                    part = found[4 * start : 4 * (start + size)]
                    rows.append(row)
                    lengths.append(len(part) // 4)
                    starts.append(start)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (lengths, starts, sums, totals))],
                names=["id", "length", "start", "ids_crc32", "doc_tokens"],
            )

    return run


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; pieces of one length keep their order."""
    count = len(lengths)
    leaves = 1 << max(0, math.ceil(math.log2(max(count, 1))))
    room = [size] * (2 * leaves)  # the largest room below each node
    bins, offsets = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[piece] = node - leaves
        offsets[piece] = size - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _pack(size: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(pieces["length"].to_numpy(), size)
        return pieces.assign(sequence_id=pieces["pack_group"].to_numpy() * 2**32 + bins, offset=offsets)

    return run


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    size: int = SEQUENCE,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every id of every document lies in exactly one piece; a sequence holds at
    most `size` ids and is filled from offset 0 without gaps. A null or empty
    text is its end id alone. Null and repeated document ids are kept as rows of
    their own. Other columns are not looked at; an empty table gives no rows.
    `vocabulary` is the path of the tokenizer file on the executors, by default
    that of the installed public vocabulary.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    pieces = common.stored(rows.mapInArrow(_pieces(vocabulary, size, end_id), f"id {id_type}, {PIECES}"), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    dealt = pieces.withColumn(
        "pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups).cast("long"))
    )
    packed = dealt.groupBy("pack_group").applyInPandas(
        _pack(size), f"id {id_type}, {PIECES}, pack_group long, sequence_id long, offset long"
    )
    return packed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
