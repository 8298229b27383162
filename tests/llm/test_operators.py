"""Each corpus operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenfold.llm import alignment, ann, byte_bpe, importance, language_id, near_dedup, quality_cascade, secret_scan, simple8b, source_mix, suffix_dedup, token_files, warc, whitening
from lumenfold.operators.graph import components
from lumenfold.llm.queries import BYTE_TOKENIZER, PATTERN, PIECE_TOKENIZER, VOCABULARY, WORD_TOKENIZER, queries
from lumenfold.llm.shared import fresh_path
from lumenfold.llm.word_tokens import LETTER, Words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS).repartition(3)


def babble(rnd, n, words=("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu")):
    return " ".join(rnd.choice(words) + rnd.choice("abcdefgh") * rnd.randrange(3) for _ in range(n))


# 1 ------------------------------------------------------------------------------------------------


def exact_neighbours(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, float))
    out = {}
    for q in good:
        if q % every == 0:
            hits = sorted((-float(v @ good[q] / math.sqrt((v @ v) * (good[q] @ good[q]))), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in hits[:k]]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(1)
    vec = rnd.normal(size=(400, 8)).tolist()
    rows = list(enumerate(vec)) + [(i, vec[0]) for i in range(1000, 1012)] + [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8)] + [(3, vec[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 50 == 0, shard=128).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact_neighbours(rows)
    assert set(got) == set(want)
    assert all(len(got[q]) == 5 for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.95
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]  # equal scores: smaller ids
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q in want for i, s in got[q])


def test_neighbours_of_any_size(spark):
    """Vectors whose squares overflow or vanish."""
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=6) * 10.0 ** (250 * (i % 3 - 1))).tolist()) for i in range(60)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact_neighbours([(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows])
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few, F.col("id") % 50 == 0).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0), F.col("id") % 50 == 0).count() == 0


def test_neighbours_in_bundles(spark):
    """More shards than bundles; blocks of queries are not broadcast, however small they are before they are sent to each bundle."""
    rnd = np.random.default_rng(4)
    rows = list(enumerate(rnd.normal(size=(300, 6)).tolist()))
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, shard=3)
    got = defaultdict(list)
    for r in sorted(found.collect()):
        got[r.query_id].append((r.rank, r.vec_id))
    assert got == {q: [(n, i) for n, (i, _) in enumerate(x, 1)] for q, x in exact_neighbours(rows).items()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [ann.bundles(n) for n in (1, 64, 65, 150, 1024, 1025, 16000)] == [1, 64, 64, 64, 64, 65, 1000]


def test_neighbours_of_floats(spark):
    """Floats and the same numbers as doubles give the same rows; zeros of either sign make equal vectors."""
    rnd = np.random.default_rng(5)
    vec = rnd.normal(size=(200, 4)).astype(np.float32).astype(float)
    vec[:100, 0] = np.where(np.arange(100) % 2, 0.0, -0.0)
    vec[1:10, 1:] = vec[0, 1:]
    rows = list(enumerate(vec.tolist()))
    one, two = (ann.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), F.col("id") % 50 == 0, shard=40).collect() for kind in ("float", "double"))
    assert sorted(one) == sorted(two)
    top = sorted(one)[:5]
    assert [r.vec_id for r in top] == [1, 2, 3, 4, 5] and len({r.score for r in top}) == 1


# 2 ------------------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def exact_components(rows, width, percent=80):
    sets = [shingle_set(t, width) if i is not None else set() for i, t in rows]
    top = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top[a], top[b]
                top = [y if t == x else t for t in top]
    low = {}
    for t, (i, _) in zip(top, rows, strict=True):
        low[t] = i if low.get(t) is None else min(low[t], i)
    return [(i, len(shingle_set(t, width)), low[g] if i is not None else None) for g, (i, t) in zip(top, rows, strict=True)]


@pytest.mark.parametrize(("width", "node"), [(4, 400), (5, 24)])
def test_near_duplicates(spark, width, node):
    rnd = random.Random(width)
    rows, i = [], 0
    for _ in range(12):
        base = babble(rnd, 120).split()
        for edits in (0, 0, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            rows.append((i := i + 1, " ".join(w)))
    base = babble(rnd, 150).split()  # a group larger than a node
    for _ in range(70):
        w = list(base)
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(9999)}"
        rows.append((i := i + 1, " ".join(w)))
    rows += [(901, None), (902, ""), (903, " \t\n"), (904, "One two"), (905, "one TWO"), (906, "Ä b"), (907, "ä b"), (908, babble(rnd, 20_000)), (None, "one two"), (905, "one TWO")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("set", F.lit(2)).repartition(3)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, width=width, node=node).collect()], key=repr)
    assert got == sorted(exact_components(rows, width), key=repr)
    kept = near_dedup.near_duplicates(df, width=width).where("kept").select("doc_id").collect()
    assert {k.doc_id for k in kept} == {c for _, _, c in exact_components(rows, width)}


def test_near_copies_in_a_template(spark):
    """Documents of one template, too alike to branch and too different to link, with single near copies among them."""
    rnd = random.Random(11)
    shared, rows = [f"t{k}" for k in range(80)], []
    for i in range(300):
        own = [f"u{i}_{k}" for k in range(13)]
        rows.append((i, " ".join(shared + own)))
        if i % 6 == 0:
            rows.append((1000 + i, " ".join(shared + own[:4] + [f"w{i}_{k}" for k in range(9)])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, node=40).collect())
    want = sorted(exact_components(rows, 5))
    assert sum(i != c for i, _, c in want) == 50
    assert got == want


def test_trees_keep_a_pair_at_any_depth():
    """The chance that all trees miss a pair whose sketches agree in 0.8 of the positions, by levels of branching."""
    live = 1.0
    for _ in range(40):
        live = 1 - (1 - 0.8**near_dedup.POSITIONS * live) ** near_dedup.CHILDREN
        assert (1 - 0.8 * live) ** near_dedup.TREES < 1e-5


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert components(spark.createDataFrame([], "a binary, b binary")).count() == 0


# 3 ------------------------------------------------------------------------------------------------


def slow_phrases(text, train):
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and (at + k) % language_id.BLOCK and text[at : at + k + 1] in train:
            k += 1
        n, at = n + 1, at + k
    return n


def test_automaton_and_phrases():
    rnd = random.Random(2)
    train = "".join(rnd.choice("abcd") for _ in range(500))
    rows = language_id.automaton(np.frombuffer(train.encode(), np.uint8) - 97)
    for _ in range(300):
        s = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9)))
        state = 0
        for c in s:
            state = rows[state].get(ord(c) - 97, -1) if state >= 0 else -1
        assert (state >= 0) == (s in train)
    given = {(i, s): rnd.randrange(600) for i in range(600) for s in rnd.sample(range(90), rnd.choice((0, 1, 1, 1, 2, 3, 20, 88)))}
    steps = language_id.Steps(*np.array([(i, s, t) for (i, s), t in given.items()], np.int64).T, 600, 90)
    asked = [(i, s) for i in range(600) for s in range(90)]
    to, nowhere = steps.take(*(np.array(x) for x in zip(*((steps.name[i], s) for i, s in asked))))
    gone = set(nowhere.tolist())
    assert all((k in gone) == (x not in given) and (k in gone or to[k] == steps.name[given[x]]) for k, x in enumerate(asked))
    parser = language_id.Parser((("x", train), ("y", train[::-1])))
    for n in (1, 5, 1023, 1024, 1025, 3000):
        text = "".join(rnd.choice("abcd") for _ in range(n))
        assert parser.phrases([text]).tolist() == [[slow_phrases(text, train), slow_phrases(text, train[::-1])]]


def test_language_of_large_alphabets(spark):
    """Han, Kana, Cyrillic and Greek beside Latin: more letters than a small alphabet holds, and a source that labels without ids."""
    rnd = random.Random(6)
    letters = {"han": (0x4E00, 1500), "kana": (0x3041, 80), "ru": (0x430, 32), "el": (0x3B1, 25), "en": (97, 26)}
    words = {k: ["".join(chr(a + rnd.randrange(n)) for _ in range(rnd.randrange(1, 6))) for _ in range(150)] for k, (a, n) in letters.items()}
    rows = [(i if i % 3 else None, " ".join(rnd.choice(words[k]) for _ in range(40)), k, "s") for i, k in enumerate(list(words) * 60)]
    df = docs(spark, rows)
    model = language_id.fit(df, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True)))
    assert all(r.lang == r.lang_pred for r in language_id.predict(df, model).collect())


def test_language(spark):
    rnd = random.Random(4)
    speak = {"aa": ("the", "and", "thing", "with", "from"), "bb": ("der", "und", "nicht", "auf", "ein"), "cc": ("que", "los", "para", "ción", "una")}
    rows = [(i, " ".join(rnd.choice(speak[k]) for _ in range(60)), k, "s") for i, k in enumerate(list(speak) * 40)]
    rows += [(1000, None, "aa", "s"), (1001, "", None, None), (1002, "123 !?", "bb", "s"), (1003, "x" * 50_000, None, "s"), (5, rows[5][1], rows[5][2], "s")]
    df = docs(spark, rows).withColumn("score", F.lit("clash"))
    out = language_id.held_out()
    model = language_id.fit(df, ~out)
    got = [(r.doc_id, r.lang, r.lang_pred, r.score) for r in language_id.predict(df, model).collect()]
    assert len(got) == len(rows)
    assert all(p == lang for i, lang, p, _ in got if i < 1000)
    assert {i: p for i, _, p, _ in got if i in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    assert all(0 <= s <= 1 for *_, s in got)
    assert language_id.fit(df.limit(0), ~out) == ()
    assert {r.lang_pred for r in language_id.predict(df, ()).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def fair_targets(size):
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
        free -= over


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, babble(rnd, rnd.randrange(1, 60)), "en", rnd.choice(["a"] * 9 + ["b", "c", "d", None, "é"])) for i in range(900)]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "z"), (2002, babble(rnd, 3000), "en", "b"), (7, rows[7][1], "en", rows[7][3]), (None, "one two", None, "b")]
    df = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit(0))
    got = source_mix.mix(df).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    want = fair_targets(size)
    assert len(got) == len(rows)
    assert all(r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-9) for r in got)
    assert all(0 <= r.copies <= 2 for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - want[s]) <= max(0.06 * want[s], 200) for s in ("a", "c", "d", None))
    again = {(r.doc_id, r.copies) for r in source_mix.mix(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert source_mix.mix(df.limit(0)).count() == 0


def test_mix_of_equal_and_missing_ids(spark):
    """Rows of one id, or none, and other sizes: a rerun over other partitions takes the same words."""
    rnd = random.Random(31)
    rows = [(7 if i % 2 else None, babble(rnd, 100 + rnd.randrange(9)), "en", rnd.choice("abc")) for i in range(200)]
    df = docs(spark, rows)
    runs = [sorted((r.doc_id or 0, r.source, r.size, r.copies) for r in source_mix.mix(df.repartition(n)).collect()) for n in (2, 7)]
    assert runs[0] == runs[1]


def test_systematic_sample_crosses_once_a_unit(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 13).alias("size"))
    got = source_mix.copies(df, F.lit(int(0.37 * source_mix.UNIT)).cast("long"))
    assert got.agg(F.sum("copies")).first()[0] in (739, 740)
    assert got.agg(F.max("copies")).first()[0] == 1


# 5 ------------------------------------------------------------------------------------------------


def test_importance(spark):
    rnd = random.Random(8)
    good, bad = ("river", "stone", "meadow", "cloud", "lantern"), ("buy", "cheap", "click", "now", "deal")
    rows = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(50)), "en", "s") for i in range(300)]
    rows += [(900, None, None, None), (901, "", None, None), (3, rows[3][1], "en", "s")]
    df = docs(spark, rows).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(df, labels, keep=0.6).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by["none" if r.doc_id >= 900 else "good" if r.doc_id % 3 else "bad"].append(r)
    assert np.mean([r.kept for r in by["good"]]) > 0.8 > 0.2 > np.mean([r.kept for r in by["bad"]])
    assert all(r.log_ratio == 0 for r in by["none"])
    least = min(r.gumbel_key for r in got if r.kept)
    assert sum(r.kept for r in got) >= math.ceil(0.6 * len(rows))
    assert sum(r.gumbel_key > least + 1e-5 for r in got) < math.ceil(0.6 * len(rows))
    assert importance.resample(df.limit(0), labels).count() == 0
    assert {r.log_ratio for r in importance.resample(df, labels.limit(0)).collect()} == {0.0}


def test_log_ratio_by_brute_force(spark):
    """The mean log ratio of smoothed n-gram shares, counted here by hand over the same buckets."""
    rnd = random.Random(16)
    texts = [babble(rnd, rnd.randrange(0, 60)) for _ in range(60)] + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    targets = list(range(0, 60, 4))
    ratio = importance.fit(df, targets)
    own = [Counter(importance.grams([t or ""])[0].tolist()) for t in texts]
    for t, c in zip(texts, own):
        words = WORDS.findall(t or "")
        assert sum(c.values()) == max(0, 2 * len(words) - 1)
    raw, good = sum(own, Counter()), sum((own[i] for i in targets), Counter())
    all_raw, all_good = sum(raw.values()) + importance.BUCKETS, sum(good.values()) + importance.BUCKETS
    for r in importance.score(df, ratio).collect():
        c = own[r.doc_id]
        want = sum(n * (math.log((good[b] + 1) / all_good) - math.log((raw[b] + 1) / all_raw)) for b, n in c.items()) / max(1, sum(c.values()))
        assert abs(r.log_ratio - want) < 1e-9


def test_kth_largest(spark):
    values = [0, 5, 5, 9, (1 << 50) + 3, 1 << 50, 7]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [importance.kth_largest(df, "v", k) for k in range(1, 8)] == sorted(values, reverse=True)
    assert importance.kth_largest(df, "v", 0) is None


# 6 ------------------------------------------------------------------------------------------------


def exact_removal(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("few", [128, 2])
def test_long_repeats(spark, few):
    rnd = random.Random(few)
    text = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    passage, short, edge = text(700), text(395), text(400)
    base = text(1500)
    rows = [(i, text(rnd.randrange(300)) + passage[rnd.randrange(150) : 700 - rnd.randrange(150)] + text(rnd.randrange(300))) for i in range(30)]
    rows += [(100 + i, base[: 300 * i] + "#" + base[300 * i :]) for i in range(5)]
    rows += [(200, text(50) + short + text(60)), (201, text(70) + short), (202, text(10) + edge), (203, edge + text(20)), (204, "ab" * 450), (205, None), (206, ""), (207, edge[:399])]
    rows += [(208, passage), (208, passage), (209, text(3000) * 2), (None, text(800))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("windows", F.lit(1)).repartition(3)
    got = suffix_dedup.removed(df, few=few)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()], key=repr) == exact_removal(rows, 400)
    assert suffix_dedup.removed(df.limit(0)).count() == 0


def test_ranges_over_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdef") for _ in range(5000))
    rows = [(1, text), (2, "x" + text[300:3300] + "y")]
    docs_ = suffix_dedup._identified(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    got = suffix_dedup.repeated(docs_).join(docs_, "uid").select("id", F.explode(F.sequence("lo", "hi")).alias("p")).distinct()
    assert {(r.id, r.p) for r in got.collect()} == {(1, p) for p in range(300, 2901)} | {(2, p) for p in range(1, 2602)}


# 7 ------------------------------------------------------------------------------------------------

BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    return sorted((m.start(), list(BASE).index(k), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text) if ok(m))


def entropy(s, w=20):
    best = 0.0
    for i in range(max(1, len(s) - w + 1)):
        part = s[i : i + w]
        best = max(best, -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values()))
    return best


def test_secrets(spark):
    rnd = random.Random(10)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rnd.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789+/") for _ in range(n))
    texts = [None, "", "no secret here", "Password = 'hunter22' and token:abc", "secret=token:abcdefgh", "token=secret=abcdefgh", "API_KEY: " + mixed(30), "apikey=12345", f"é😀 AKIA{'A1' * 8} AKIA12 {hexes(24)} {hexes(23)}", "AKIAAKIA" + "B" * 15]
    texts += ["x " + mixed(40) + " y " + mixed(24), "id 123e4567-e89b-12d3-a456-426614174000", "/usr/lib/python3/site/packages1234567890", "ABCDEFGHIJ0123456789abcdefghij", "Key " + hexes(30).upper(), " ".join(f"token='{mixed(12)}'" for _ in range(300)), "a" * 60_000 + " " + hexes(40)]
    texts += [" ".join(rnd.choice(["word", "password:", hexes(rnd.randrange(10, 40)), mixed(rnd.randrange(10, 40)), "AKIA" + mixed(18).upper()]) for _ in range(40)) for _ in range(20)]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s")]).withColumn("secret_spans", F.lit("clash"))
    got = secret_scan.scan(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        spans = [(s.start, s.kind, s.end) for s in r.secret_spans]
        assert [s for s in spans if s[1] < 3] == base_spans(t)
        assert spans == sorted(spans)
        for a, k, b in spans:
            if k >= 3:
                assert entropy(t[a:b]) >= secret_scan.THRESHOLD[secret_scan.KINDS[k]] - 1e-9
        assert [s for s in spans if s[1] >= 3] == method_spans(t, base_spans(t)), repr(t[:80])
    found = {r.doc_id: [s for s in r.secret_spans if s.kind >= 3] for r in got}
    assert len(found[10]) == 2
    assert not found[11] and not found[12] and not found[13] and found[14]
    clean = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.scan(df)).collect()}
    assert clean[3] == "[secret]' and token:abc"
    assert clean[2] == texts[2] and clean[0] is None
    assert secret_scan.scan(df.limit(0)).count() == 0


KNOWN = re.compile(secret_scan.KNOWN)
WORD = re.compile(secret_scan.WORD)


def is_dense(s):
    kind = 3 if re.fullmatch("[0-9a-fA-F]+", s) else 4 if re.fullmatch("[0-9A-Za-z]+", s) else 5
    return bool(re.search("[0-9]", s) and re.search("[A-Za-z]", s)) and entropy(s) >= secret_scan.THRESHOLD[secret_scan.KINDS[kind]] - 1e-9, kind


def method_spans(text, base):
    out = []
    for m in re.finditer(secret_scan.CANDIDATE, text):
        dense, kind = is_dense(m[0])
        path = "/" in m[0] and all(WORD.match(x) for x in re.split("[-_=+/]+", m[0]))
        other = not KNOWN.search(m[0]) or any(len(x) >= 20 and is_dense(x)[0] for x in re.split(secret_scan.PIECES, m[0]))
        if dense and not path and other and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append((m.start(), kind, m.end()))
    return out


def test_secrets_with_slashes_long_and_many(spark):
    """Random keys are found whatever stands in them or before them; paths of words are not; long candidates and many matches stay quick."""
    rnd = random.Random(21)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n, a=b64: "".join(rnd.choice(a) for _ in range(n))
    keys = [key(n) for n in (40, 64, 88, 256, 5_000) for _ in range(6)]
    texts = [f"see {k} here" for k in keys] + [f"see /{k} here" for k in keys[:6]]
    paths = ["see /usr/local/lib/python3/site-packages/numpy here", "at docs/guide/chapter-12/section-3/index-page there", "id 550e8400-e29b-41d4-a716-446655440000 ok", "an example-key-0123456789-abcdefghij here"]
    webhook = f"post to /services/T00000000/B0001/{key(28, b64[:62])} now"
    example = f"use example={key(40, b64[:62])} now"
    many = " ".join(f"password=hunter{i:05d} {key(24, b64[:62])}" for i in range(3_000))
    long_ = key(300_000, b64[:62])
    texts += [*paths, webhook, example, many, long_]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    began = time.time()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.secret_spans] for r in secret_scan.scan(df).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        if len(t) < 200_000:
            assert got[i] == sorted(base_spans(t) + method_spans(t, base_spans(t))), repr(t[:80])
    n = len(keys) + 6
    assert all(got[i] for i in range(n))
    assert not any(got[n + i] for i in range(len(paths)))
    assert got[n + 4] and got[n + 5]
    assert sum(k == 0 for _, k, _ in got[n + 6]) == 3_000
    assert got[n + 7] == [(0, 4, 300_000)]
    clean = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.scan(df)).collect()}
    for i, t in enumerate(texts):
        out, at = [], 0
        for a, _, b in got[i]:
            if a >= at:
                out += [t[at:a], "[secret]"]
            at = max(at, b)
        assert clean[i] == "".join(out) + t[at:]


def test_window_entropy(spark):
    rnd = random.Random(11)
    strings = ["".join(rnd.choice("0123456789abcdef"[: rnd.randrange(1, 16)]) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    got = {r.s: r.e for r in df.select("s", secret_scan.best_entropy(F.col("s"), "0123456789abcdef").alias("e")).collect()}
    assert all(abs(got[s] - entropy(s)) < 1e-9 for s in strings)


# 8 ------------------------------------------------------------------------------------------------


def slow_measures(text):
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality(spark):
    rnd = random.Random(12)
    texts = [None, "", "short", "a\x85b c d e f g h i j k", "é " * 30, "\n".join(["same line here"] * 9), babble(rnd, 100), babble(rnd, 40_000), "### " * 40, "1 2 3 4 5 6 7 8 9 10 11 12"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(80)] + ["x y z w v " * 2 + babble(rnd, 90), "- a b\n" * 3 + "* c d e\n- f g h\n- i j"]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(6, texts[6], "en", "s")]).withColumn("kept", F.lit("clash"))
    order = quality_cascade.plan(df)
    assert sorted(order) == sorted(quality_cascade.RULES)
    got = quality_cascade.run(df, order).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert m == slow_measures(t), repr(t[:60])
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r.kept == (not r.base_failed and not any(rule(t, WORDS.findall(t), m) for rule in quality_cascade.RULES.values()))
    assert {(r.doc_id, r.kept) for r in quality_cascade.run(df, order[::-1]).collect()} == {(r.doc_id, r.kept) for r in got}
    assert quality_cascade.plan(df.limit(0)) == list(quality_cascade.RULES)
    assert quality_cascade.run(df.limit(0), order).count() == 0


# 9 ------------------------------------------------------------------------------------------------


def test_warc(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big, other = "<p>" + "é" * 700, trap * 30
    rows = [(1, "http://a/", big), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "c", trap), (5, "d", big), (6, "e", big), (7, "f", other), (8, "g", other + "x"), (9, "h", "s"), (10, "i", "s"), (6, "e", big), (None, "j", "null id"), (11, "k", "z" * 300_000)]
    rows += [(100 + i, "u", f"page {i}" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash")).withColumn("at", F.lit(0)).repartition(2)
    got = sorted(([r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to] for r in warc.round_trip(df.select("page_id", "url", "html", "at")).collect()), key=repr)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, i), i)
    want = [[i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in first and first[h] != i else "response", first[h] if h in first and first[h] != i else None] for i, _, h in rows]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_chain_rejects_magic(spark, tmp_path):
    record = lambda n, body: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (n, len(body), body)
    inner = record(77, b"inner") * 3
    data = record(1, b"a") + record(2, inner) + record(3, b"WARC/1.1\r\nbroken") + record(4, b"")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    assert sorted(r.page_id for r in warc.read(spark, f"file://{tmp_path}").collect()) == [1, 2, 3, 4]
    assert len(list(warc.candidates(data))) == 7


@pytest.mark.parametrize("ahead", [4, 0])
def test_warc_hostile_payloads(spark, monkeypatch, ahead):
    """Payloads full of magic, with and without blank lines, that claim long bodies, cost one walk; every class of sizes is written; null ids with large payloads."""
    claim = "WARC/1.1\r\nContent-Length: 900000\r\n"
    for data in ((warc.MAGIC * 100_000), (claim * 25_000).encode(), ((claim + "\r\n") * 25_000).encode(), b"WARC/1.1\r\n" + b"a" * 1_000_000):
        began = time.perf_counter()
        found = list(warc.candidates(data + b"\r\n\r\n"))
        assert time.perf_counter() - began < 1 and len(found) in (0, 25_000)
    monkeypatch.setattr(warc, "CLASSES", ((1_000, 3), (5_000, 2), (None, 1)))
    monkeypatch.setattr(warc, "AHEAD", ahead)
    texts = [claim * 40, (claim + "\r\n") * 40, "x" * 999, "y" * 1_000, "z" * 7_000, warc.MAGIC.decode() * 700, ""]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(None, "q" * 2_000), (None, "q" * 2_000), (50, "r" * 2_000), (None, "r" * 2_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    first = {}
    for i, h in rows:
        if i is not None and len(h) >= 1_000:
            first[h] = max(first.get(h, i), i)
    want = [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if h in first and first[h] != i else "response", first[h] if h in first and first[h] != i else None) for i, h in rows]
    assert got == sorted(want, key=repr)


# 10 -----------------------------------------------------------------------------------------------


def test_bpe(spark):
    with open(VOCABULARY, "rb") as f:
        ranks = byte_bpe.ranks_of(f.read())
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(13)
    pieces = ["a", "th", "é", "日本", "\u0085", "\x1c", " ", "\n", "\t", "'s", "12", "٣", "😀", "$%", "ing", "<|endoftext|>", "ab" * 45]
    texts = [None, "", " ", "hello world", "x" * 3000, "ab" * 5000, babble(rnd, 30_000)] + ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(80))) for _ in range(300)]
    df = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s")]).withColumn("token_ids", F.lit("clash"))
    out = byte_bpe.decode(byte_bpe.encode(df, VOCABULARY, PATTERN), VOCABULARY).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()
    assert byte_bpe.encode(df.limit(0), VOCABULARY, PATTERN).count() == 0


def test_bpe_table_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEEP", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK", 40)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.ranks_of(f.read())
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    merge, cut = byte_bpe.Merger(ranks), byte_bpe.regex.compile(PATTERN)
    rnd = random.Random(14)
    texts = [babble(rnd, rnd.randrange(200)) for _ in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in merge.encode(texts, cut)] == [library.encode_ordinary(t) for t in texts]


def test_shared_folder_is_the_sessions(spark):
    assert fresh_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


# 11 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_simple8b_round_trip(block):
    rnd = np.random.default_rng(block)
    kinds = [rnd.integers(0, 2, 500), rnd.integers(0, 50_000, 3000), np.zeros(400, np.int64), np.array([0]), np.zeros(0, np.int64)]
    kinds += [rnd.integers(0, 2**int(b), 50, dtype=np.uint64) for b in rnd.integers(1, 64, 40)] + [np.array([2**64 - 1, 0, 2**60, 2**60 - 1, 5], np.uint64)]
    for values in [*kinds, np.concatenate([k.astype(np.uint64) for k in kinds])]:
        values = values.astype(np.uint64)
        words, offsets = simple8b.encode(values, block)
        assert simple8b.decode(words).tolist() == values.tolist()
        for k, i in enumerate(range(0, len(values), block)):
            assert simple8b.decode(words[offsets[k] : offsets[k + 1]]).tolist() == values[i : i + block].tolist()
        assert offsets[-1] == len(words) <= 2 * len(values)
    assert len(simple8b.encode(np.ones(60), 64)[0]) == 1 and len(simple8b.encode(np.full(300, 40_000), 1024)[0]) == 100


ODD_TEXTS = [
    "", "Hello, WORLD! it's 12 o'clock", "  two  blanks\u00a0and\u2003wide\tones \r\n", "ΣΑΣ İstanbul ŉ ſtraße ǅ", "e\u0301 cafe\u0301 \u0301x", "<|startoftext|>a<|endoftext|> <|STARTOFTEXT|>",
    "日本語 텍스트 \u1100\u1161", "a\x1cb \x85c \x00 \x7f", "don't we'LL I'M 'sss ''s", "½ ² ٣ ①", "#" * 300 + " " + "ab" * 900, "🙂🙂 👩‍👩‍👧 ﬁ", "_under_score_ --- ***",
]


def test_word_tokens_are_those_of_the_library():
    with open(WORD_TOKENIZER, "rb") as f:
        own = Words(f.read())
    library = Tokenizer.from_file(WORD_TOKENIZER)
    assert own.chunked
    texts = [*ODD_TEXTS, *("".join(map(chr, range(a, a + 64))) for a in range(0, 0x250, 64)), " ".join(map(chr, range(0x21, 0x180)))]
    rnd = random.Random(11)
    texts += ["".join(rnd.choice("aÀ ésS'’t0_-\n\tıſß!") for _ in range(rnd.randrange(1, 60))) for _ in range(500)]
    for text, packed in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    bare = Words(Tokenizer(library.model).to_str().encode())
    assert not bare.chunked and np.frombuffer(bare.encode(["ab"])[0], "<u4").tolist() == Tokenizer(library.model).encode("ab").ids


def tokens_by_hand(rows):
    library, out, start = Tokenizer.from_file(WORD_TOKENIZER), [], 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rnd = random.Random(3)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, babble(rnd, rnd.randrange(0, 90))) for i in range(300)] + [(None, "first"), (-5, None), (5000, babble(rnd, 30_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("tie", F.lit(1)).repartition(3)
    path = fresh_path(spark, "tokens")
    manifest = token_files.write(df, WORD_TOKENIZER, 1, path, file_bytes=4000)
    assert manifest.count() > 4 and manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    got = [tuple(r) for r in token_files.read(spark, path, manifest).collect()]
    want = tokens_by_hand(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted(got, key=lambda r: r[1]) == want
    name = manifest.orderBy("task", "part").first()["name"]
    content = spark.read.format("binaryFile").load(f"{path}/{name}").first()["content"]
    reader = token_files.Reader(bytes(content))
    library = Tokenizer.from_file(WORD_TOKENIZER)
    held = {i: t for i, t in rows}
    for i, start, count, _ in reader.documents():
        assert reader.tokens(start, count).tolist() == [*library.encode(held[i] or "", add_special_tokens=False).ids, 1]
    assert token_files.round_trip(df.limit(0), WORD_TOKENIZER, 1).collect() == []
    twice = token_files.round_trip(spark.createDataFrame([(7, "same words")] * 40 + [(7, "other")], "doc_id long, text string").repartition(4), WORD_TOKENIZER, 1).collect()
    assert sorted(r.start for r in twice)[:2] == [0, min(r.n_tokens for r in twice if r.start == 0)] and len({r.start for r in twice}) == 41 and {r.doc_id for r in twice} == {7}


def test_token_file_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(map(tuple, queries()["op11_token_files"](spark, folder).collect())) == tokens_by_hand(rows)


# 12 -----------------------------------------------------------------------------------------------


def whitened_by_hand(rows, d, count=4):
    kept = [(i, [math.floor(float(c) * 256) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    total = [int(s) for s in fit.sum(0)]
    n, level = len(fit), fit - fit.mean(0)
    value, vector = np.linalg.eigh(level.T @ level / n)
    out = {}
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
        for k in range(min(count, d)):
            e, u = value[-1 - k], vector[:, -1 - k]
            out.setdefault((i, k + 1), []).append((n, dev, abs((np.array(x) - fit.mean(0)) @ u / math.sqrt(e)), e / value.sum()))
    return out


def test_whitening(spark):
    rnd = np.random.default_rng(12)
    wide = (rnd.normal(size=(300, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.2])).astype("float32").tolist()
    rows = list(enumerate(wide)) + [(0, wide[0]), (1000, wide[7]), (None, wide[8]), (1001, None), (1002, []), (1003, [float("nan")] * 6), (1004, [float("inf"), *wide[1][1:]]), (1005, [None, *wide[1][1:]])]
    short = [(2000 + i, v) for i, v in enumerate(rnd.normal(size=(40, 3)).astype("float32").tolist())]
    df = spark.createDataFrame(rows + short, "vec_id long, embedding array<float>").withColumn("component", F.lit("x")).withColumn("x", F.lit(1)).repartition(3)
    got = defaultdict(list)
    for r in whitening.whiten(df).collect():
        got[r.vec_id, r.component].append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert 0 <= r.identity_error < 1e-9
    want = whitened_by_hand(rows, 6) | whitened_by_hand(short, 3)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for k, v in want.items():
        for a, b in zip(sorted(got[k]), sorted(v), strict=True):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-7, atol=1e-9)


def test_whitening_of_flat_and_empty_tables(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 3.0])], kind)).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in flat] == [(i, k, 2, 256**2) for i in (1, 2, 3) for k in (1, 2)]
    assert [r.whitened for r in flat if r.component == 2] == [None] * 3 and [r.explained for r in flat[:2]] == [1.0, 0.0]
    assert abs(flat[0].whitened) == pytest.approx(1) and flat[0].identity_error < 1e-12
    assert [(r.whitened, r.explained, r.deviation) for r in whitening.whiten(spark.createDataFrame([(1, [2.0])], kind)).collect()] == [(None, None, 0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e14, 0.0]), (2, [-1e14, 1.0])], kind)).collect()
    assert all(r.deviation is None and math.isfinite(r.whitened) for r in huge if r.component == 1)


# 13 -----------------------------------------------------------------------------------------------


def aligned_by_hand(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each row, and its groups, by the two libraries."""
    byte, piece = Tokenizer.from_file(BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)
    byte.encode_special_tokens = True
    back = {letter: b for b, letter in LETTER.items()}
    found, count = [], Counter()
    for i, t in rows:
        raw = b" " + (t or "").encode()
        a = byte.encode(" " + (t or ""), add_special_tokens=False).ids
        b = piece.encode(t or "")
        a_raw = [bytes(back[c] for c in byte.id_to_token(x)) for x in a]
        b_raw = [bytes([int(p[3:5], 16)]) if piece.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, map(piece.id_to_piece, b), strict=True)]
        if not t or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            a = b = []
        a_end, b_end = np.cumsum([len(x) for x in a_raw]).tolist() if a else [], np.cumsum([len(x) for x in b_raw]).tolist() if b else []
        cuts = sorted(set(a_end) & set(b_end))
        links = [(a[a_end.index(c)], b[b_end.index(c)]) for c in cuts]
        groups = [([x for x, e in zip(a, a_end, strict=True) if low < e <= high], [x for x, e in zip(b, b_end, strict=True) if low < e <= high]) for low, high in zip([0, *cuts], cuts, strict=False)]
        count.update(links)
        found.append((i, a, b, links, groups))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for i, a, b, links, groups in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, {i: groups for i, _, _, _, groups in found}


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment(spark):
    rnd = random.Random(13)
    odd = [*ODD_TEXTS, None, " ", "  lead", "trail  ", "a  b   c \n\n d\t e", "▁x ▁ y", "tab\tand ▁", "naïve café — “quotes” …", "　wide　", "<s> </s> <unk> <0x41>", "it's we'll 's", "日本語テキスト 日本", "1234567890 12 3"]
    rows = list(enumerate(odd)) + [(100 + i, "".join(rnd.choice(["a", "B", " ", " ", "\n", "é", "'s", "1", "▁"[: rnd.randrange(40) == 0], "…", "，", " the", "ing", "-"]) for _ in range(rnd.randrange(80)))) for i in range(200)]
    rows += [(None, "same text"), (950, "same text"), (950, "same text"), (900, babble(rnd, 900))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("links", F.lit("x")).withColumn("_row", F.lit(1)).withColumn("a_ids", F.lit(2)).withColumn("kept", F.lit(3)).repartition(3)
    found = alignment.align(df, BYTE_TOKENIZER, PIECE_TOKENIZER)
    assert "kept" in found.columns
    want, groups = aligned_by_hand(rows)
    by = lambda r: (repr(r[0]), r[1:])
    assert sorted((tuple(r) for r in found.select(*ALIGNED).collect()), key=by) == sorted(want, key=by)
    assert sum(r[1] == 0 for r in want) > 3 and any(r[3] != r[1] for r in want)
    made = alignment.linked(alignment.tokenised(spark.createDataFrame(rows[:-4], "doc_id long, text string"), BYTE_TOKENIZER, PIECE_TOKENIZER)).select("doc_id", alignment.groups().alias("g")).collect()
    assert {r.doc_id: [(g.a, g.b) for g in r.g] for r in made} == {i: groups[i] for i, _ in rows[:-4]}
    assert alignment.align(df.limit(0), BYTE_TOKENIZER, PIECE_TOKENIZER).collect() == []


def test_alignment_scores_without_a_whole_broadcast(spark):
    links = spark.createDataFrame([(1, [1, 1, 2, 9], [5, 5, 5, 7]), (2, [2, 1], [5, 6]), (3, [], [])], "key long, a array<int>, b array<int>")
    counts = alignment.counted(links)
    assert sorted(map(tuple, counts.collect())) == [(1, 5, 2, True), (1, 6, 1, True), (2, 5, 2, True), (9, 7, 1, True)]
    want = [(1, 4, 2 + 2 + 2 + 1), (2, 2, 3)]
    for limit, hot in ((10, 10), (0, 3), (0, 10_000), (0, 1)):
        assert sorted(map(tuple, alignment.scored(links, counts, "key", limit, hot).collect())) == want


def test_alignment_of_long_texts_is_linear(spark):
    rnd = random.Random(14)
    text = babble(rnd, 150_000)
    began = time.perf_counter()
    row = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), BYTE_TOKENIZER, PIECE_TOKENIZER).first()
    assert row.n_links > 300_000 and time.perf_counter() - began < 60


def test_late_trees_are_compared_in_full(spark):
    """Classes that meet only in the trees of the second half, in nodes that branching does not shrink: every pair shares a unit."""
    early = {t * near_dedup.SKETCH // near_dedup.TREES for t in range(near_dedup.TREES // 2)}
    rows = [(bytes([i]), i, [1000 + i if p in early else p for p in range(near_dedup.SKETCH)]) for i in range(12)]
    classes = spark.createDataFrame(rows, "class binary, lab long, sketch array<int>")
    units = {}
    for r in near_dedup.leaves(classes, near_dedup.TREES, 4).collect():
        units.setdefault(r.unit, set()).add(r["class"][0])
    assert {(a, b) for u in units.values() for a in u for b in u if a < b} == {(a, b) for a in range(12) for b in range(a + 1, 12)}


def test_a_large_group_is_confirmed_once(spark):
    """Edges that repeat in the units of twelve trees: a large group is compared in block pairs, which hold each two labels once, not unit by unit; a large group of few edges stays with its units."""
    name = lambda i: i.to_bytes(2, "big")
    star = [(t, name(0), name(i)) for t in range(12) for i in range(1, 200)]
    chain = [(1000 + i, name(i), name(i + 1)) for i in range(500, 599)]
    members = [(name(i), name(0), i if i < 20 else -1) for i in range(200)] + [(name(i), name(500), i) for i in range(500, 600)]
    maybe = spark.createDataFrame(star + chain, "unit long, a binary, b binary")
    groups = spark.createDataFrame(members, "class binary, group binary, lab long")
    units = {}
    rows = near_dedup.confirming(maybe, groups, 40).collect()
    for r in rows:
        units.setdefault(r.unit, set()).add(int.from_bytes(r["class"], "big"))
    met = {(a, b) for u in units.values() for a in u for b in u if a < b}
    assert {(a, b) for a in range(20) for b in range(a + 1, 200)} <= met
    assert {(i, i + 1) for i in range(500, 599)} <= met
    assert sum(x < 500 for u in units.values() for x in u) < 600 < len(star) and sum(x >= 500 for u in units.values() for x in u) == 2 * len(chain)


def test_one_label_is_not_compared(spark):
    """Sketches that are all equal: only pairs of different labels are candidates."""
    rows = [(u, bytes([u, i]), 7, i if u == 1 else 0) for u in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "unit long, class binary, sketch int, lab long")
    found = near_dedup._grouped(df, "unit", "sketch", lambda a: [np.full(near_dedup.SKETCH, x) for x in a.to_pylist()], near_dedup._alike_sketches(40)).collect()
    assert {(r.unit, r.a, r.b) for r in found} == {(1, bytes([1, 0]), bytes([1, i])) for i in range(1, 5)}
