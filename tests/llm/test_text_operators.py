"""Text operators against brute force on small tables with odd rows."""

import math
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bpe, common, language, minhash, packing, quality, quotes, recurrent, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, score double"
EN = "the quick brown fox jumps over the lazy dog and runs to the river with all of its friends today"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft mit allen freunden zum fluss"


def documents(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, lang, src, None if t is None else len(t), "x", 7, 0.5) for i, t, lang, src in rows], SCHEMA
    )


def odd(spark, number=40):
    rows = [(i, f"{EN if i % 2 else DE} number {i} {'again ' * (i % 5)}", "en" if i % 2 else "de", f"s{i % 3}") for i in range(number)]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \n\t ", "de", None), (None, EN, "en", "s1")]
    rows += [(103, "1234 5678 !!!", "en", "s2"), (104, EN, "en", "s0"), (104, EN, "en", "s0"), (105, EN.upper(), "en", "s0")]
    rows += [(106, "long " * 30_000, "en", "s0"), (107, "<|endoftext|> and it's the end", "en", "s0"), (108, "one two", None, "")]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def sets(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_components(texts, percent):
    found = [sets(t) for t in texts]
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if both and 100 * both >= percent * (len(a) + len(found[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(found))]


def near_rows(number=90):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 900, 120)]
    rows = []
    for i in range(number):
        words = list(base) if i % 3 else [f"v{x}" for x in rng.integers(0, 900, 60)]
        for place in rng.integers(0, len(words), i % 7):
            words[place] = f"n{i}"
        rows.append(" ".join(words))
    return rows + ["a b c", "A b  C", "a b c d", "", None]


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_a_full_or_small_filter_loses_no_row(spark, monkeypatch, bits):
    """With few bits nearly every id passes the filter; the joins decide alike."""
    docs = documents(spark, [(10 + i, t, "en", "s") for i, t in enumerate(near_rows(40))])
    wanted = sorted(r["doc_id"] for r in minhash.keep_one(docs).collect())
    monkeypatch.setattr(minhash, "FILTER_BITS", bits)
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == wanted


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    texts = near_rows()
    docs = documents(spark, [(10 + i, t, "en", "s") for i, t in enumerate(texts)]).repartition(5)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(docs, percent=percent).collect()}
    want = brute_components(texts, percent)
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        row = found[10 + i]
        assert (row["n_shingles"], row["component_id"]) == (len(sets(t)), 10 + want[i])
        assert row["kept"] == (row["component_id"] == row["doc_id"])
    kept = minhash.keep_one(docs, percent=percent)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {10 + w for w in want}


def test_near_duplicates_odd(spark):
    found = minhash.near_duplicates(odd(spark)).collect()
    assert len(found) == odd(spark).count()
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    rows = [r for r in odd(spark).collect() if r["doc_id"] is not None]
    want = brute_components([r["text"] for r in rows], 85)
    roots = {}
    for r, w in zip(rows, want, strict=True):
        roots[w] = min(roots.get(w, 1000), r["doc_id"])
    expected = sorted((r["doc_id"], roots[w]) for r, w in zip(rows, want, strict=True))
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == expected
    assert [r["n_shingles"] for r in sorted(found, key=lambda r: r["doc_id"] or 0) if r["doc_id"] in (100, 101, 102)] == [0, 0, 0]
    assert minhash.near_duplicates(empty(spark)).count() == 0
    twice = documents(spark, [(1, EN, "en", "s"), (1, EN, "en", "s"), (2, DE, "de", "s"), (None, EN, "en", "s"), (3, "", "en", "s")])
    assert sorted(str(r["doc_id"]) for r in minhash.keep_one(twice).collect()) == ["1", "2", "3", "None"]


def test_repeated_ids_with_different_texts(spark):
    other = "a text of its own that has nothing in common with any of the other ones in this table"
    rows = [(1, EN, "en", "s"), (2, EN, "en", "s"), (2, DE, "de", "s"), (3, DE, "de", "s"), (4, other, "en", "s"), (4, DE + " " + EN, "en", "s")]
    kept = minhash.keep_one(documents(spark, rows + rows[:1] + rows[2:3]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, EN), (2, DE), (4, other), (4, DE + " " + EN)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + i, 99) for i in range(2, 30)] + [(500, 500)]
    found = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(51)} | {i: 99 for i in [99, *range(102, 130)]}


def tokens(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_packing(spark):
    docs = odd(spark)
    pieces = packing.pack(docs, size=64, group_pieces=50).toPandas()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(tokens(r["text"]))) for r in docs.collect())
    firsts = pieces[pieces["start"] == 0]
    assert sorted(zip(firsts["doc_id"].fillna(-1).astype(int), firsts["doc_tokens"], strict=True)) == want
    by = {r["doc_id"]: tokens(r["text"]) for r in docs.collect()}
    for p in pieces.dropna(subset=["doc_id"]).itertuples():
        ids = by[int(p.doc_id)][p.start : p.start + p.length]
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and len(ids) == p.length
    ordered = pieces.sort_values(["sequence_id", "offset"])
    before = ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"]
    assert (before == ordered["offset"]).all()
    assert ordered.groupby("sequence_id")["length"].sum().max() <= 64
    assert packing.pack(empty(spark)).count() == 0


class CountingTokenizer:
    """Hands on to a tokenizer and counts the texts."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_pieces_are_encoded_in_runs():
    import pyarrow as pa

    ids = packing.ChunkIds(packing.vocabulary_path(packing.VOCABULARY), most=100)
    ids.tokenizer = CountingTokenizer(ids.tokenizer)
    words = [f"Word{chr(97 + i % 26)}{chr(97 + i // 26)}in," for i in range(300)]
    odd_texts = ["", " ", "\v a<|endoftext|>b\x0c", "< <| |> <|startoftext|>x", "e\u0301 \u0301 K\u212a", "\x1c a\u3000b"]
    for texts in ([" ".join(words), *odd_texts], odd_texts, [""], []):
        found = list(ids.encode(pa.array(texts, pa.string())))
        assert found == [tokens(t)[:-1].tobytes() for t in texts]
    assert ids.tokenizer.texts < 60


def test_latin_words_are_given_to_the_model_alone():
    import pyarrow as pa

    ids = packing.ChunkIds(packing.vocabulary_path(packing.VOCABULARY))
    ids.tokenizer = CountingTokenizer(ids.tokenizer)
    words = [f"{a}{b}{c}re" for a in "\u00e9\u00dfn\u00fc" for b in "\u00f1\u00ffe\u00c9" for c in "o\u00e7\u00b5"]
    found = list(ids.encode(pa.array([" ".join(words)], pa.string())))
    assert found == [tokens(" ".join(words))[:-1].tobytes()] and ids.tokenizer.texts == 0
    chunks = [x + y for x in ["a", "", "\u00c9t\u00e9", "\u0130", "\u0101b", "<|", "x\u00bd", "\u00d7", "1\u00b2"] for y in ["", ".", "!?", "\u2026", ")."]]
    assert list(zip(*ids.all_halves(chunks), strict=True)) == [ids.halves(x) for x in chunks]


def test_words_merged_in_step_are_those_merged_alone():
    merges = bpe.Merges(bpe.vocabulary_path(bpe.VOCABULARY))
    rng = np.random.default_rng(6)
    letters = np.frombuffer(b" aehinrst.,\xc3\xa9\xff0", np.uint8)
    words = [rng.choice(letters, n).tobytes() for n in rng.integers(1, bpe.LONG_WORD + 1, 2_000)] + [b"a" * n for n in range(1, 40)]
    ids, sizes = merges.merge_all(words)
    alone = [merges.merge(w) for w in words]
    assert ids.tolist() == [i for x in alone for i in x] and sizes.tolist() == [len(x) for x in alone]
    assert [len(x) for x in merges.merge_all([])] == [0, 0]


def test_toxic_words_and_evidence_of_a_batch_are_those_of_its_texts():
    import pyarrow as pa

    counts = {}
    for word in ["the"] * 30 + ["idiot"] * 8 + ["moron", "you", "are", "an", "in"] * 4:
        for gram in toxicity.grams(word):
            counts[gram] = counts.get(gram, 0) + 1
    model = toxicity.CharacterModel(counts)
    texts = ["you are an i d i o t.", "", "  \u2003 ", "the m o r o n, the th e an in a r e", "1d1ot! ..word.. (you) the the", "Stra\u00dfe \u0130d the"]
    texts += ["an", "in a", "i d"]  # nothing runs from one text into the next
    number = {}
    texts_of, words = toxicity.Reader(model).coded(pa.array(texts), number)
    names = list(number)
    for i, text in enumerate(texts):
        assert sorted(names[w] for w in words[texts_of == i]) == sorted(toxicity.Reader(model).words(text))
    toxic = np.arange(len(texts)) % 2 == 0
    rows = toxicity._unit_rows(pa.array(names, pa.string()), texts_of, words, toxic).to_pylist()
    want = {}
    for i, text in enumerate(texts):
        for unit in {u for w in toxicity.Reader(model).words(text) for u in toxicity.units(w)}:
            n, bad = want.get(unit, (0, 0))
            want[unit] = n + 1, bad + toxic[i]
    assert {r["unit"]: (r["n"], r["toxic"]) for r in rows} == want
    scorer = toxicity.Scorer(model, {"idiot$": 5.0, "moro": 4.0, "you$": 1.0}, np.array([-3.0, 1, 1, 1]))
    scorer.start()
    known = scorer.known
    for text, row in zip(texts, scorer.vectors(pa.array(texts)), strict=True):
        values = [known.of(w) for w in toxicity.Reader(model).words(text)]
        strong = sum(v > 2 for v in values)
        assert row == pytest.approx([max(values, default=0.0), math.log1p(strong), math.sqrt(strong / max(1, len(values)))])


def test_plain_words_of_a_batch_are_read_at_once_and_not_remembered():
    import pyarrow as pa

    tokens = ["The", "", "fooool", "aaa", "bAAa", "\u0130d", "\u039f\u0394\u039f\u03a3", "1d1ot!", "i\u0301d", "\U00010400\U00010400\U00010400", "\u4e00\u4e00\u4e00"]
    lowered, plain = toxicity.plain_words(tokens)
    assert lowered == [t.lower() for t in tokens]
    assert plain == [t.lower().isalpha() and not toxicity.RUN.search(t.lower()) for t in tokens]
    assert toxicity.plain_words([]) == ([], [])
    model = toxicity.CharacterModel({g: n for w, n in {"idiot": 60, "the": 300}.items() for g in toxicity.grams(w)})
    scorer = toxicity.Scorer(model, {"idiot$": 5.0, "idi$": 3.0, "the$": 1.0}, np.array([-3.0, 1, 1, 1]))
    scorer.start()
    assert [row[0] for row in scorer.vectors(pa.array(["the Idiot", "idi the", "1d1ot", "id"])).tolist()] == [5.0, 3.0, 5.0, 0.0]
    assert list(scorer.known) == ["1d1ot"]
    assert scorer.vectors(pa.array([], pa.string())).shape == (0, 3)
    assert scorer.vectors(pa.array(["", " "])).tolist() == [[0.0, 0.0, 0.0]] * 2
    texts = ["The the (you)", "fooool \u039f\u0394\u039f\u03a3 x\u2003\u0130d", "", "the"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (rows,) = toxicity._count_grams([batch])
    want = {}
    for word in ["the", "the", "you", "\u03bf\u03b4\u03bf\u03c2", "x", "the"]:
        for gram in toxicity.grams(word):
            want[gram] = want.get(gram, 0) + 1
    assert {r["gram"]: r["n"] for r in rows.to_pylist()} == want


@pytest.mark.parametrize("bins", [1 << 22, 1])
def test_grams_of_words(monkeypatch, bins):
    monkeypatch.setattr(toxicity, "MOST_BINS", bins)
    seen = {"the": 3, "idiot,": 2, "\u017cle": 1, "a1": 5, "(you)": 1, "fooool": 2}
    want = {}
    for word, n in (("the", 3), ("idiot", 2), ("\u017cle", 1), ("you", 1)):
        for gram in toxicity.grams(word):
            want[gram] = want.get(gram, 0) + n
    assert {r["gram"]: r["n"] for r in toxicity._gram_rows(seen).to_pylist()} == want
    assert toxicity._gram_rows({}).num_rows == 0


def test_a_window_updates_each_weight_once(monkeypatch):
    vocabulary = recurrent.Vocabulary([b"", *(f"w{i}".encode() for i in range(300))], [b"abc"])
    trainer = recurrent.Trainer(recurrent.Network.start(vocabulary), vocabulary)
    names, apply = [], recurrent.Trainer.apply
    monkeypatch.setattr(recurrent.Trainer, "apply", lambda self, name, *more: (names.append(name), apply(self, name, *more)))
    before = trainer.network.to_word.copy()
    trainer.fit([np.array([5, 70, 5, 130, 0])])  # classes 0 to 2 of 5
    assert sorted(names) == sorted(trainer.network.names)
    changed = np.flatnonzero((trainer.network.to_word != before).any(axis=1))
    assert changed.min() == 0 and changed.max() == 191


def test_words_of_texts_are_found_and_classed_together():
    texts = [b"", b" \n ", b"a", b" A\x0bb ", b"x\x1cy\x00 Z", "\u00c9\u00a0\u0416. e".encode(), b"\xff\x85 Walking, b", b"b b"]
    want = [[*common.words(t), b""] for t in texts]
    assert recurrent.tokens_of(pa.array(texts, pa.binary())).to_pylist() == want
    parts = [pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], names=["text"]) for x in (texts[:3], texts[3:])]
    (held, words, coded, edges), *more = recurrent._token_batches(iter(parts), 0, 1_000)
    assert held == parts and not more
    assert len(words) == len(set(words.to_pylist()))  # each word is classed once
    assert [words.take(pa.array(x)).to_pylist() for x in np.split(coded, edges[1:-1])] == want
    vocabulary = recurrent.Vocabulary([b"", b"b", b"a"], [b"ing", b""])
    by = dict(zip(words.to_pylist(), vocabulary.ids(words).tolist(), strict=True))
    assert (by[b""], by[b"b"], by[b"a"], by[b"walking,"], by[b"z"]) == (0, 1, 2, 3, 5)
    assert vocabulary.ids(pa.array([b".!", b"?ing)"], pa.binary())).tolist() == [4, 3]
    rows = [r for b in recurrent._count(iter(parts)) for r in b.to_pylist()]
    counts = {w: sum(x.count(w) for x in want) for w in by}
    assert {r["word"]: r["c"] for r in rows} == counts


def test_scoring_keeps_the_states_alone():
    vocabulary = recurrent.Vocabulary([b"", *(f"w{i}".encode() for i in range(40))], [b"ing"])
    network = recurrent.Network.start(vocabulary, 6)
    rng = np.random.default_rng(5)
    network.bias[:] = rng.standard_normal(18)
    inputs, first, state = rng.integers(0, 42, (9, 4)), rng.random((9, 4)) < 0.2, rng.standard_normal((6, 4)).astype(np.float32)
    states, gates, gated = network.run(inputs, first, state)
    again, last, _ = network.run(inputs, first, state, network.inputs_table())
    assert np.array_equal(states, again) and np.array_equal(gates[-1], last[0])
    assert (len(gates), len(gated), len(last)) == (9, 9, 1)


def test_rows_of_a_window_are_summed_by_id():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.full(40, 7), np.full(9, 2), np.full(8, 30), rng.integers(0, 50, 60), [49]])
    values = rng.standard_normal((len(ids), 6)).astype(np.float32)
    want = np.zeros((50, 6))
    np.add.at(want, ids, values)
    order = rng.permutation(len(ids))
    sums, rows = recurrent.row_sums(values[order], ids[order], 50)
    assert rows.tolist() == np.unique(ids).tolist() and np.allclose(sums, want[rows], atol=1e-4)
    sums, rows = recurrent.row_sums(values[:1], ids[:1], 50)
    assert rows.tolist() == [7] and np.array_equal(sums, values[:1])


def test_softmax_of_scores_of_any_size():
    rng = np.random.default_rng(4)
    wanted = rng.integers(0, 5, 8)
    for size in (1, 30, 1_000):
        scores = (rng.standard_normal((8, 5)) * size).astype(np.float32)
        shares = np.exp(scores.astype(float) - scores.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        shares[np.arange(8), wanted] -= 1
        errors, factor = recurrent.softmax_errors(scores.copy, wanted, np.float32(0.25))
        assert np.allclose(errors * factor, shares / 4, atol=1e-6)


def test_first_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        place = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if place == len(room):
            room.append(100)
        room[place] -= lengths[i]
        want[i] = place
    assert [want[i] for i in range(300)] == bins.tolist()


def test_bpe(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    texts = [None, "", " \n\n a", "it's  an\tÜber-Straße!", "<|endoftext|>x", "zzzz" * 5000, "漢字 😀‍é", "'s 've don't ''s"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a b", "en", "s")])
    plain = {r["doc_id"]: r for r in bpe.encode(docs, words=5).collect()}
    digests = {r["doc_id"]: r for r in bpe.encode_digests(docs, words=5).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (plain[i]["ids"], plain[i]["decoded"]) == (ids, decoded)
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert len(plain) == len(texts) + 1
    assert bpe.encode_digests(empty(spark)).count() == 0


def test_lexicon(tmp_path):
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in "aeiou"} | {b"a", b"ab", "é".encode()})
    bpe.Lexicon.save(f"{tmp_path}/x-", words, [[i, i + 1] for i in range(len(words))])
    lexicon = bpe.Lexicon(f"{tmp_path}/x-")
    assert lexicon.places(words).tolist() == list(range(len(words)))
    assert lexicon.places([b"", b"abx", b"aaingg", b"aain", b"zz"]).tolist() == [-1] * 5
    assert lexicon.output(3) == [3, 4]
    assert len(lexicon.arcs) < sum(map(len, words)) / 3


def test_language(spark):
    docs = odd(spark, 200)
    found = language.predict(docs).toPandas()
    assert len(found) == docs.count()
    by = {int(r.doc_id): r for r in found.dropna(subset=["doc_id"]).itertuples()}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(100))
    assert [by[i].lang_pred for i in (100, 101, 102, 103)] == ["und"] * 4
    assert found["score"].between(0, 1).all()
    assert by[1].held_out == (zlib.crc32(b"1") % 4 == 2)
    assert language.predict(empty(spark)).count() == 0
    assert set(language.predict(odd(spark), model=language.Filter([], np.zeros(2, np.uint64))).toPandas()["lang_pred"]) == {"und"}


def test_false_positives_are_corrected():
    masks = np.random.default_rng(0).integers(0, 4, 1 << language.SLOT_BITS).astype(np.uint64)
    found = language.Filter(["a", "b"], masks)
    assert np.allclose(found.false, 0.125, atol=0.01)


def quality_docs(spark):
    rows = [(i, f"{EN} {i}. And then, {DE} {i}." if i % 3 else f"x{i} | y{i} | z{i} | " * 20, "en", f"s{i % 4}/p{i % 2}") for i in range(240)]
    docs = documents(spark, rows + [(1000, None, None, None), (1001, "", None, "s1"), (None, EN, None, "s1/p0/x?y")])
    marks = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)] + [(2, 1, 0), (None, 1, 0), (9999, 0, 0)])
    return docs, marks


def test_quality(spark):
    docs, marks = quality_docs(spark)
    found = quality.score(docs, marks)
    assert found.columns[: len(docs.columns)] == docs.columns
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == docs.count()
    assert all(rows[i]["quality_kept"] == (i % 3 > 0) for i in range(240))
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.where("doc_id < 240").count() == 160
    assert quality.score(empty(spark), marks).count() == 0
    without = quality.score(docs, labels(spark, []))
    assert without.select("quality_evidence").distinct().count() == 1


def test_sites(spark):
    rows = spark.createDataFrame([("https://A.com/b/c?d",), ("src1",), (None,), ("x.org/q#z",), ("http://h",)], "s string")
    found = rows.select(quality.host(F.col("s")).alias("h"), quality.path(F.col("s")).alias("p")).collect()
    assert [tuple(r) for r in found] == [("a.com", "b"), ("src1", ""), ("", ""), ("x.org", "q"), ("h", "")]


def test_posteriors_shrink(spark):
    rows = [("big", "", 0.9)] * 400 + [("big", "bad", 0.1)] * 100 + [("small", "", 0.0)] + [("mid", "", 0.5)] * 50
    found, prior = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = {(r["host"], r["path"]): r for r in found.collect()}
    assert by["big", "bad"]["path_posterior"] < by["big", "bad"]["host_posterior"] < by["big", ""]["path_posterior"]
    assert 0.05 < by["small", ""]["path_posterior"] < prior


def test_restoring():
    words = {"idiot": 50, "stupid": 50, "the": 300, "book": 80, "is": 100, "loser": 40, "good": 90}
    counts = {}
    for word, n in words.items():
        for gram in toxicity.grams(word):
            counts[gram] = counts.get(gram, 0) + n
    model = toxicity.CharacterModel(counts)
    for raw, plain in {"1d10t": "idiot", "$tup!d": "stupid", "i.d.i.o.t": "idiot", "looooser": "loser", "b00k": "book"}.items():
        assert toxicity.readings(raw, model) == plain, raw
    assert toxicity.readings("Good,", model) == "good"
    assert toxicity.readings("###", model) == ""
    assert toxicity.readings("1" + "d" * 60 + "10t", model) == "idiot"
    assert toxicity.readings("i" + "-" * 50 + "d10t", model) == "idiot"
    assert "idiot" in toxicity.Reader(model).words("an i d i o t here")


def test_blanks_of_disguised_words():
    counts = {}
    for text, n in {EN: 20, DE: 20, "you are a moron and an idiot": 60, "the scum of it all": 30, "not an ass": 30}.items():
        for word in text.split():
            for gram in toxicity.grams(word):
                counts[gram] = counts.get(gram, 0) + n
    reader = toxicity.Reader(toxicity.CharacterModel(counts))
    for text, word in {
        "you are a m o r o n": "moron", "y o u i d i o t": "idiot", "all s c u m.": "scum", "y o u a r e a m o r o n": "moron",
        "an a s s": "ass", "you mo ron": "moron", "you id iot": "idiot", "m\no\nr\no\nn": "moron", "I d 1 0 t": "idiot",
        "I s c u m": "scum", "à s c u m": "scum", "y m o r o n": "moron", "M. o. r. o. n.": "moron", "o i d i o t": "idiot",
    }.items():
        assert word in reader.words(text), text
    assert reader.joins.of("the quick fox and the dog and all of it") == []
    long = " ".join("you are a moron " * 500).replace("   ", " ")
    assert "moron" in reader.words(long)


def toxic_docs(spark):
    rng = np.random.default_rng(3)
    plain = (EN + " " + DE).split()
    rows, marks = [], []
    for i in range(600):
        words = list(rng.choice(plain, 30))
        bad = i % 6 == 0
        if bad:
            words[int(rng.integers(30))] = ["idiot", "stupid", "scum"][i // 6 % 3]
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2 == 0 or i % 5 == 0:
            marks.append((i, 1, int(bad)))
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "you 1d10t and st.u.pid", "en", "s"), (None, EN, "en", "s")]
    rows += [(1003, "what an i d i o o o t today", "en", "s"), (1004, EN, "en", "s"), (1004, EN, "en", "s")]
    return documents(spark, rows), labels(spark, marks + [(None, 1, 1), (0, 1, 1)])


def test_long_runs_of_letters():
    model = toxicity.CharacterModel({g: n for w, n in {"moron": 60, "the": 300}.items() for g in toxicity.grams(w)})
    letters = list("the" * 400 + "moron" + "the" * 400)
    found = toxicity.spelled(letters, model)
    assert "moron" in found
    joins = toxicity.Joins(model)
    assert "moron" in joins.over(letters) and not joins.runs  # only short runs are remembered
    joins.over(["m", "o", "r", "o", "n"])
    assert list(joins.runs) == [tuple("moron")]


def readings_by_hand(token, model):
    """All ways through the lattice, each with its cost."""
    ways = [("", 0.0)]
    for options in toxicity.lattice(token):
        ways = [
            (word + letter, cost + channel + (model.log(("^^" + word)[-2:], letter) if letter else -2.0))
            for word, cost in ways
            for letter, channel in options
        ]
    return {word: max(c for w, c in ways if w == word) + model.log(("^^" + word)[-2:], "^") for word, _ in ways}


def test_restored_words_are_the_best_of_all_ways():
    counts = {}
    for word, n in {"idiot": 50, "stupid": 50, "the": 300, "loser": 40, "good": 90}.items():
        for gram in toxicity.grams(word):
            counts[gram] = counts.get(gram, 0) + n
    model = toxicity.CharacterModel(counts)
    rng = np.random.default_rng(8)
    for token in ["1d10t", "$t|_|pid", "looo0er", "g.0.o.d", *("".join(rng.choice(list("idot10!*.-s"), 6)) for _ in range(60))]:
        ways = readings_by_hand(token, model)
        found = toxicity.restore(token, model)
        assert found in ways and math.isclose(ways[found], max(ways.values()), abs_tol=1e-9), token


def test_evidence_beyond_its_limit_is_filled_up(spark):
    units = spark.createDataFrame([(f"u{i}", 8.0) for i in range(4000)] + [("top", 9.0)], "unit string, odds double")
    assert [r["unit"] for r in common.most_frequent(units, "odds", 1000)] == ["top"]
    found = {r["unit"] for r in common.most_frequent(units, "odds", 1000, fill="unit")}
    assert "top" in found and 850 < len(found) < 1150


def test_sampling_threshold(spark):
    one = lambda most, rows: spark.range(4000).where(common.one_of(F.xxhash64("id"), most, rows)).count()
    assert one(2000, 1500) == 4000 and one(5, 0) == 4000
    assert 1800 < one(2000, 4000) < 2200
    # Beyond two billion rows the share is small but not zero.
    bound = common.one_of(F.lit(0).cast("bigint"), 2000, 3_000_000_000)
    assert spark.range(1).where(bound).count() == 1


def test_stages_keep_columns_of_any_name(spark):
    docs, marks = toxic_docs(spark)
    names = ["_host", "_path", "_site_host", "_site_path", "quality_score", "quality_kept", "_toxic_score"]
    names += ["_kept_id", "_kept_node", "_own_node", "_kept", "_rows"]
    more = docs.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("text"), F.lit(""))) for name in names})
    for stage in (
        lambda x: quality.keep_good(x, marks),
        lambda x: toxicity.keep_clean(x, marks),
        lambda x: minhash.keep_one(x, percent=80),
    ):
        plain, kept = stage(docs), stage(more)
        assert kept.columns == more.columns
        assert sorted(map(str, kept.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
        assert all(r[n] == n + (r["text"] or "") for r in kept.collect() for n in names)


def test_toxicity(spark):
    docs, marks = toxic_docs(spark)
    rows = toxicity.score(docs, marks).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["predicted"] == (i % 6 == 0) for i in range(600))
    assert by[1002]["predicted"] == 1 and by[1003]["predicted"] == 1
    assert by[1000]["score"] == by[1001]["score"] < 0.2 and by[1000]["predicted"] == 0
    assert by[5]["held_out"] == (zlib.crc32(b"5") % 3 == 1)
    clean = toxicity.keep_clean(docs, marks)
    assert clean.columns == docs.columns and clean.where("doc_id < 600").count() == 500
    assert toxicity.score(empty(spark), marks).count() == 0
    assert {r["predicted"] for r in toxicity.score(docs, labels(spark, [])).collect()} == {0}


def test_recurrent_counts(spark):
    docs = odd(spark)
    rows = recurrent.score(docs, hot_words=20, output_words=10).toPandas()
    assert len(rows) == docs.count()
    counts, texts = {}, docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, t in texts:
        if i is not None and not held(i):
            for word in [*common.words((t or "").encode()), b""]:
                counts[word] = counts.get(word, 0) + 1
    number, distinct = sum(counts.values()), len(counts)
    by = {int(r.doc_id): r for r in rows.dropna(subset=["doc_id"]).itertuples()}
    for i, t in texts:
        if i is None:
            continue
        words = [*common.words((t or "").encode()), b""]
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (number + 0.5 * (distinct + 1))) for w in words)
        r = by[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(words), number)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    assert recurrent.score(empty(spark)).count() == 0


def test_network_learns_from_all_training_texts(spark, monkeypatch):
    docs = documents(spark, [(i, f"{EN} number {i}", "en", "s") for i in range(400)])
    averaged, trained = recurrent._averaged, []

    def noted(rows, otherwise):
        trained.append(rows.where("place = 0").agg({"tokens": "sum"}).first()[0])
        return averaged(rows, otherwise)

    monkeypatch.setattr(recurrent, "_averaged", noted)
    rows = recurrent.score(docs, hot_words=40, output_words=20, sample_docs=40).toPandas()
    assert trained[-1] == rows["train_tokens"].iloc[0] == rows.loc[~rows["held_out"], "n_tokens"].sum()
    held = rows[rows["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_network_sums_to_one_and_carries_its_state():
    words = [b"", *(f"w{i}".encode() for i in range(69))]
    vocabulary = recurrent.Vocabulary(words, [b"ing", b"ed"])
    network = recurrent.Network.start(vocabulary, 6)
    state = np.random.default_rng(1).standard_normal((1, 6)).astype(np.float32)
    every = np.arange(vocabulary.inputs)
    logs = network.log_probabilities(vocabulary, np.repeat(state, len(every), axis=0), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(2)
    texts = [np.r_[rng.integers(1, vocabulary.inputs, n), 0] for n in (50, 1, 0, 700, 20)]
    together = recurrent.text_logs(network, vocabulary, texts, 2)
    alone = [recurrent.text_logs(network, vocabulary, [t], 1)[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-4)


def test_training_lowers_the_loss_and_matches_finite_differences():
    words = [b"", *(f"w{i}".encode() for i in range(9))]
    vocabulary = recurrent.Vocabulary(words, [b"ing"])
    network = recurrent.Network.start(vocabulary, 5)
    texts = [np.array([1, 2, 3, 4] * 6 + [0])] * 8
    before = recurrent.text_logs(network, vocabulary, texts).sum()
    trainer = recurrent.Trainer(network, vocabulary, 0.1)
    for _ in range(60):
        trainer.fit(texts, 4)
    after = recurrent.text_logs(network, vocabulary, texts).sum()
    assert after > 0.3 * before

    probe = recurrent.Network.start(vocabulary, 5)
    caught = {}
    trainer = recurrent.Trainer(probe, vocabulary, 0.0, window=64)
    trainer.apply = lambda name, gradient, rows=slice(None): caught.setdefault(name, gradient.copy())
    text = [np.array([1, 2, 10, 3, 0])]
    trainer.fit(text, 1)
    scale = 32 / len(text[0])
    for place in ((0, 0), (2, 7), (4, 14)):
        value = probe.state[place]
        losses = []
        for step in (1e-2, -1e-2):
            probe.state[place] = value + step
            losses.append(-recurrent.text_logs(probe, vocabulary, text)[0] * np.log(10))
        probe.state[place] = value
        assert caught["state"][place] == pytest.approx(scale * (losses[0] - losses[1]) / 2e-2, rel=0.05, abs=2e-3)


def test_quotes(spark):
    rows = [
        (1, 0, "user", "The first question.\nHow does it work? I do not know."),
        (1, 1, "assistant", "On Monday user wrote:\n> How does it work?\nIt works well.\nReally."),
        (1, 2, "user", "Something else entirely."),
        (1, 3, "assistant", "> It works\n> well. Really.\n>> How does it work?\nWhy not?"),
        (1, 4, "user", "> something ELSE   entirely.\nAgreed."),
        (1, 5, "user", "> nobody said this\nOdd."),
        (2, 0, "user", None), (2, 1, "user", ""), (None, 1, "user", "> How does it work?"), (3, None, "user", "x"), (1, 5, "user", "> nobody said this\nOdd."),
    ]
    schema = "conv_id long, turn long, role string, text string, level int"
    found = quotes.reply_order(spark.createDataFrame([(*r, 1) for r in rows], schema)).collect()
    assert len(found) == len(rows)
    first = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in first] == [0, 1, 3, 2, 4, 5, 5]
    assert [r["parent_turn"] for r in first] == [None, 0, 1, None, 2, None, None]
    assert [r["depth"] for r in first] == [0, 1, 2, 0, 1, 0, 0]
    assert first[1]["text"] == "It works well.\nReally." and first[2]["text"] == "Why not?"
    assert quotes.reply_order(spark.createDataFrame([], schema)).count() == 0


def test_no_python_in_quotes(spark):
    frame = spark.createDataFrame([(1, 0, "user", "> a\nb")], "conv_id long, turn long, role string, text string")
    plan = quotes.reply_order(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


