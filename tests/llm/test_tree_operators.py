"""Prefix trie, Merkle manifest and quality rules against brute force on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import manifest, prefixes, rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, hash string, tree long, words string, id long"
TURNS = "conv_id long, turn long, role string, text string, conv string, place long, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie ---------------------------------------------------------------


def conversations(spark, rows):
    """Turns with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], TURNS)


def brute_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = (turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"))
            turns.setdefault(conv, []).append((order, (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    new = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        new[conv] = tuple(own.get(conv - conv % 5, [])[:h] + own[conv][h:])
    members, below = {}, {}
    for conv, path in new.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    for path in members:
        if path:
            below.setdefault(path[:-1], []).append(path)
    sums, found = {}, []
    for path in sorted(members, key=len, reverse=True):
        inner = below.get(path, [])
        leaves = sum(sums[p][0] for p in inner) if inner else 1
        here = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        sums[path] = leaves, here + sum(sums[p][1] for p in inner)
        parent = min(members[path[:-1]]) if path else None
        ends = ",".join(map(str, sorted(c for c in members[path] if len(new[c]) == len(path))))
        found.append((min(members[path]), len(path), parent, len(members[path]), len(inner), *sums[path], sha(ends)))
    return sorted(found, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(df, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefixes.rebuilt_trie(df, **options).collect()), key=str)


def odd_conversations():
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), -7]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 30])):
            rows.append((conv, rng.choice([None, t, t]), rng.choice(["u", None, ""]), rng.choice(["a", "b", "a", None, "é"])))
    for conv in range(1000, 1040):  # a third are copies, some of them shorter
        rows += [(conv, t, "u", f"same{t % 3}") for t in range(rng.choice([40, 40, 40, 17]))]
    return rows + [(None, 1, "u", "x"), (7, None, None, None), (2000, 1, "u", "long " * 50_000)]


@pytest.mark.parametrize("block_turns", [4, 3])
def test_trie(spark, block_turns):
    rows = odd_conversations()
    df = conversations(spark, rows + rows[:5]).repartition(5)
    assert trie_of(df, block_turns=block_turns) == brute_trie(rows + rows[:5])


def test_trie_of_nothing_and_of_one(spark):
    assert trie_of(conversations(spark, [])) == []
    assert trie_of(conversations(spark, [(None, 1, "u", "x")])) == []
    one = [(5, 0, "u", "hello"), (5, 1, "a", "there")]
    assert trie_of(conversations(spark, one)) == brute_trie(one)


def test_members_beyond_one_chunk(spark, monkeypatch):
    """Ids of a class spread over many chunks are hashed in order, those of a negative chunk first."""
    monkeypatch.setattr(prefixes, "CHUNK_BITS", 2)
    ids = [*range(-9, 200, 3)]
    members = spark.createDataFrame([(min(ids), i) for i in reversed(ids)] + [(500, 500)], "rep long, conv long")
    found = {r.rep: r.ends_sha256 for r in prefixes._member_hashes(members).collect()}
    assert found == {min(ids): sha(",".join(map(str, ids))), 500: sha("500")}


def test_long_conversation_keys_add_up_over_slices(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "SLICE_BLOCKS", 3)
    rows = [(c, t, "u", f"{t if t < 70 else (c, t)}") for c in (5, 10, 15) for t in range(90)]
    assert trie_of(conversations(spark, rows)) == brute_trie(rows)


# --- manifest -------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, src, None if t is None else len(t), "x", 7, "w", 1) for i, t, lang, src in rows], DOCUMENTS
    )


def odd_documents():
    rows = [(i, f"text {i} é", ("en", "de", None)[i % 7 % 3], f"s{i % 4}") for i in range(150)]
    rows += [(500, None, "", None), (501, "", "fr", "s"), (None, "no id", "en", "s"), (None, None, None, None)]
    rows += [(9, "same id, other text", "en", "s"), (600, "twice", "en", "s"), (600, "twice", "en", "s")]
    return rows + [(700, "long " * 100_000, "zh", "s")]


def brute_manifest(rows, fanout):
    def text_field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row, more=0):
        i, t, lang, src = row
        chars = None if t is None else len(t) + more
        return sha("".join(map(text_field, (i, src, lang, chars, t))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(run)) for run in itertools.batched(out[-1], fanout)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            first = i - i % fanout
            yield "".join(level[first:i]), "".join(level[i + 1 : first + fanout])
            i //= fanout

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    sorted_rows = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups}
    trees = {g: levels([leaf(r) for r in sorted_rows[g]]) for g in groups}
    top = levels([trees[g][-1][0] for g in order])
    found = []
    for at, g in enumerate(order):
        for i, row in enumerate(sorted_rows[g]):
            steps = [*path(trees[g], i), *path(top, at)]
            folded = leaf(row, 1 if zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[0] is not None else 0)
            for left, right in steps:
                folded = sha(left + folded + right)
            proof = sha("".join(left + right for left, right in steps))
            root = top[-1][0]
            found.append((row[0], leaf(row), trees[g][-1][0], root, proof, folded, folded == root))
    return sorted(found, key=str)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 2), (2, 6), (3, 1)])
def test_manifest(spark, fanout, levels):
    rows = odd_documents()
    docs = documents(spark, rows).repartition(5)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1)
    claim = {"n_chars": F.coalesce(changed, F.col("n_chars"))}
    found = manifest.verified(manifest.manifest(docs, tampered=claim, fanout=fanout, levels=levels))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str) == brute_manifest(rows, fanout)


def test_manifest_of_nothing_and_of_one(spark):
    assert manifest.verified(manifest.manifest(documents(spark, []))).count() == 0
    (row,) = manifest.verified(manifest.manifest(documents(spark, [(1, "a", "en", "s")]))).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha("")


# --- quality rules ----------------------------------------------------------------


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for w in words for c in w)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [zlib.crc32(g.encode()) % buckets for g in [*words, *map(" ".join, itertools.pairwise(words))]]


def rule_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40, 200))), "en", "s") for i in range(60)]
    rows += [(100 + i, " | ".join(rng.choices(words, k=90)) + " #%", "en", "s") for i in range(10)]
    rows += [(200, None, None, None), (201, "", "en", "s"), (202, " \n\t ", "en", "s"), (203, "a a a a", "en", "s")]
    rows += [(204, "x\ny\nx\n\n \nx", "en", "s"), (205, "é 𝄞 ü ü", "en", "s"), (206, "a b c " * 40, "en", "s")]
    rows += [(None, rows[0][1], "en", "s"), (1, rows[1][1], "en", "s"), (207, "long text 　 " * 60_000, "en", "s")]
    return rows


def test_rules(spark):
    rows = rule_rows()
    marks = [(i, 1, 0) for i in range(0, 40)] + [(100, 0, 0), (101, None, 0), (5, 0, 0), (None, 1, 0), (999, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).repartition(4)
    buckets = 512
    found = sorted(rules.judged(docs, labels, buckets=buckets).collect(), key=lambda r: (str(r.doc_id), r.n_words))

    trusted = {i for i in range(40) if i != 5}
    raw, good = [0] * buckets, [0] * buckets
    for i, text, *_ in rows:
        for b in grams(text, buckets):
            raw[b] += 1
            good[b] += i in trusted
    share = sum(good) / sum(raw)
    weights = [round(rules.SCALE * math.log((g + rules.SMOOTHING) / (r * share + rules.SMOOTHING))) for g, r in zip(good, raw)]
    wanted = []
    for i, text, *_ in rows:
        n_words, chars, symbols, dups, repeats = counts(text)
        score, n = sum(weights[b] for b in grams(text, buckets)), max(2 * n_words - 1, 0)
        failed = n_words < 50 or 100 * repeats > 50 * n_words
        kept = not failed and score >= math.ceil(rules.THRESHOLD * rules.SCALE) * n
        wanted.append((i, n_words, chars, symbols, dups, repeats, score, n, failed, kept))
    assert [tuple(r) for r in found] == sorted(wanted, key=lambda r: (str(r[0]), r[1]))


def test_rules_reject_what_trusted_texts_do_not_say(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3_000)]
    rows = [(i, " ".join(rng.choices(words, k=400)), "en", "s") for i in range(60)]
    rows += [(100 + i, "!! ".join(rng.choices(words[:20], k=120)), "en", "s") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in rules.judged(documents(spark, rows), labels).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {i for i, r in found.items() if r.kept} == set(range(60))


def test_rules_without_trusted_texts_or_rows(spark):
    docs = documents(spark, rule_rows()[:20])
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.llr_sum == 0 and r.kept == (not r.base_failed) for r in rules.judged(docs, nothing).collect())
    assert rules.judged(documents(spark, []), nothing).count() == 0


def test_windows_of_one_hash_are_compared(spark, monkeypatch):
    """With a hash of two values all windows look alike; the count stays right."""
    monkeypatch.setattr(rules.F, "xxhash64", lambda first, *rest: F.length(first).cast("long"))
    texts = ["a b c d e a b c", "aa b aa b aa b", "x y z"]
    docs = documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    found = {r.doc_id: r.n_repeat_words for r in rules.measured(docs.select("doc_id", "text")).collect()}
    assert found == {i: counts(t)[4] for i, t in enumerate(texts)}


def test_rules_run_no_python(spark):
    docs = documents(spark, rule_rows()[:5])
    plan = rules.judged(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text) and "Exchange" not in text
