"""Operators across documents, and the pipeline, against plain versions."""

import collections

import random
import re

import numpy as np
import pytest


from docsieve.llm import common, decontamination, jaccard_join, substring_dedup

DOCS = "doc_id long, text string, token string, label int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n ", "a", "a b", "A b", "x" * 50_000, "the " * 4000, "\xa0\x1c \x85"]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in zip(ids, texts)], DOCS)


def family(rng, n=40, size=120, vocabulary=400, edits=6):
    """Texts with exact and near copies, shared passages and unrelated ones."""
    word = lambda: f"w{rng.randrange(vocabulary)}"
    bases = [[word() for _ in range(size)] for _ in range(4)]
    passage = [f"p{k}" for k in range(60)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(5):]
        if rng.random() < 0.2:
            w = [word() for _ in range(rng.randint(0, size))]
        out.append(" ".join(w))
    return [*out, *out[:5]]


# ---- components -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("local", [0, 10_000])
def test_components(spark, local):
    rng = random.Random(5)
    edges = [(rng.randrange(-40, 80), rng.randrange(-40, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 230)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}
    assert common.components(spark.createDataFrame([], "a long, b long"), local).count() == 0


# ---- Jaccard join ---------------------------------------------------------------------------------------------------------------


def shingles(t):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i:i + 3]) for i in range(len(w) - 2)])


def plain_components(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = label[a], label[b]
                label = [min(p, q) if v in (p, q) else v for v in label]
    low = {}
    for (i, s), v in zip(sets, label):
        if i is not None and s:
            low[v] = min(low.get(v, i), i)
    return [(i, len(s), None if i is None else low.get(v, i) if s else i) for (i, s), v in zip(sets, label)]


@pytest.mark.parametrize(("percent", "block"), [(90, 256), (90, 4), (80, 8), (100, 256)])
def test_jaccard_join_against_all_pairs(spark, percent, block):
    rng = random.Random(percent + block)
    texts = [*family(rng, 60, 60, edits=5), *ODD]
    ids = [*rng.sample(range(1000), len(texts) - 2), None, 7]
    got = jaccard_join.jaccard_join(frame(spark, texts, ids), percent=percent, block=block, hot=3)
    rows = sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect())))
    assert rows == sorted(map(repr, plain_components(list(zip(ids, texts)), percent)))


def test_jaccard_join_of_nothing_and_first_of_each_group(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_join(frame(spark, [None, "", " "])).where("component_id = doc_id and n_shingles = 0").count() == 3
    text = " ".join(f"w{k}" for k in range(80))
    d = frame(spark, [text, text + " end", text, "other words entirely", None])
    kept = jaccard_join.keep_first(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4] and kept.columns == d.columns


def test_pipeline_stage_drops_copies_between_080_and_090(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(104)]  # 100 shingles of five words
    longer = lambda n: " ".join(words + [f"e{k}" for k in range(n)])
    texts = [longer(0), longer(12), longer(25), " ".join(words[:-20]), " ".join(f"o{k}" for k in range(104)), longer(28)]
    alone = lambda *rows: sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, [texts[k] for k in rows], rows), "").collect())
    assert alone(0, 1, 4) == alone(0, 2, 4) == alone(0, 3, 4) == [0, 4]  # 100/112, 100/125, 80/100
    assert alone(0, 5) == [0, 5]  # 100/128
    assert jaccard_join.jaccard_join(frame(spark, texts[:2])).select("component_id").distinct().count() == 2  # op3's own contract


@pytest.mark.parametrize("percent", [80, 90])
def test_least_common_holds_for_every_size_of_a_group(spark, percent):
    def common_of(n, m):
        both = -(-percent * (n + m) // (100 + percent))
        return min(jaccard_join.spare(n, percent) + 1 - (n - both), jaccard_join.spare(m, percent) + 1 - (m - both))

    want = {}
    for n in range(1, 90):
        low, high = -(-n * percent // 100), n * 100 // percent
        for a in range(low, high + 1):
            least = common_of(n, a)
            for b in range(a, high + 1):
                least = want[n, a, b] = min(least, common_of(n, b))
    rows = spark.createDataFrame(list(want), "n long, a long, b long")
    got = rows.withColumn("bound", jaccard_join.least_common(rows["n"], rows["a"], rows["b"], percent)).collect()
    assert len(got) == len(want) and all(1 <= r["bound"] <= want[r["n"], r["a"], r["b"]] for r in got)


def test_link_to_a_size_inside_a_group_is_found(spark):
    """x links with y alone, by one prefix token; y and z are a group of sizes 29 and 30."""
    def prefix(t):
        s = jaccard_join.shingle_set(t, 3)
        return set(s[:jaccard_join.spare(len(s), 90) + 1].tolist())

    low = lambda t: jaccard_join.min_hash(jaccard_join.shingle_set(t, 3))
    for seed in range(10_000):
        w = [f"{chr(97 + k % 26)}{k:02d}{seed:04d}" for k in range(30)]
        y = [w[0], "l" * 20, *w[1:]]
        x, y, z = map(" ".join, (w, y, [*y[:-1], "m" * 40, y[-1]]))
        if low(y) == low(z) != low(x) and len(prefix(x) & (prefix(y) | prefix(z))) == 1:
            break
    got = jaccard_join.jaccard_join(frame(spark, [x, y, z]))
    assert sorted((r["n_shingles"], r["component_id"]) for r in got.collect()) == [(28, 0), (29, 0), (30, 0)]


# ---- substring dedup ------------------------------------------------------------------------------------------------------------


def plain_dedup(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k:k + window])] < i for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("bits", [27, 6])
@pytest.mark.parametrize("window", [50, 7])
def test_substring_dedup_against_a_loop(spark, window, bits):
    rng = random.Random(window)
    texts = [*family(rng, 50), *ODD, "lorem " * 70, "x " + "lorem " * 70]
    ids = [*rng.sample(range(1000), len(texts) - 3), None, 3, 3]
    got = substring_dedup.substring_dedup(frame(spark, texts, ids), window=window, filter_bits=bits)
    rows = sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect())))
    assert rows == sorted(map(repr, plain_dedup(list(zip(ids, texts)), window)))
    assert all(sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] for r in got.collect())
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("piece", [1, 3])
def test_long_passages_in_pieces_and_split_shards(spark, piece):
    rng = random.Random(piece)
    long = [f"v{rng.randrange(10_000)}" for _ in range(400)]
    texts = [" ".join(long), "head " + " ".join(long[3:370]) + " tail", *["same row " + " ".join(long[:90])] * 30, " ".join(long[60:160] + long[10:70]), *family(rng, 20)]
    ids = [5, 2, *[9] * 30, 11, *range(20, len(texts) - 13)]
    got = substring_dedup.substring_dedup(frame(spark, texts, ids), window=7, shard_bytes=1000, piece=piece)
    rows = sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect())))
    assert rows == sorted(map(repr, plain_dedup(list(zip(ids, texts)), 7)))


def strip(texts, known, window=7):
    import pandas as pd

    docs = pd.DataFrame(texts, columns=["doc_id", "text"])
    return {r[0]: r[2] for r in substring_dedup._strip(docs, pd.DataFrame(known, columns=["lo", "words"]), window)}


def test_the_automaton_and_the_words_decide_what_goes(monkeypatch):
    import ahocorasick

    rng = random.Random(4)
    passage = [f"p{k}" for k in range(30)]
    texts = [(k, " ".join(rng.choices("abcdef", k=20) + passage[k % 5:] + rng.choices("abcdef", k=20))) for k in range(3, 12)] + [(1, " ".join(passage)), (50, "other " * 30)]
    known = [(2, " ".join(passage))]
    want = {i: 0 if i in (1, 50) else 30 - i % 5 for i, _ in texts}
    assert strip(texts, known) == want
    assert set(strip(texts, [(2, " ".join(passage[:4] + ["else"] + passage[5:])), (2, "a b c d e f g h")]).values()) != set(want.values())
    # hashes that tell nothing apart, as far as anchors stay the same in equal windows, change nothing
    with monkeypatch.context() as m:
        m.setattr(substring_dedup, "word_hashes", lambda w: np.array([len(x) % 2 for x in w], np.uint64))
        assert strip(texts, known) == want
    # an automaton that finds nothing removes nothing
    class Empty:
        add_word = make_automaton = lambda self, *a: None
        iter = lambda self, *a: iter(())
        __len__ = lambda self: 1

    monkeypatch.setattr(ahocorasick, "Automaton", Empty)
    assert set(strip(texts, known).values()) == {0}


def test_ids_that_are_no_integers_are_refused(spark):
    d = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for f in (substring_dedup.substring_dedup, jaccard_join.jaccard_join):
        with pytest.raises(TypeError, match="must be an integer column"):
            f(d)


# ---- decontamination ------------------------------------------------------------------------------------------------------------

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_hits(text, items, window):
    low = lambda t: ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = low(text)
    hit, found = set(), set()
    for name, t in items:
        v = low(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for a in range(len(w) - n + 1):
                if w[a:a + n] == v[k:k + n]:
                    found.add("null" if name is None else str(name))
                    hit |= set(range(a, a + n))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("shard", "block"), [(400_000, 8_000_000), (40, 60)])
def test_decontamination_against_a_loop(spark, shard, block):
    rng = random.Random(shard)
    some = lambda n: " ".join(rng.choices(["a", "B", "c", "d", "é", "e-f"], k=n))
    items = [(k % 9 if k else None, some(rng.randint(0, 9))) for k in range(14)] + [(50, None)]
    texts = [*ODD, *(some(rng.randint(0, 40)) + " zz " + some(rng.randint(0, 10)) for _ in range(60))]
    bench = spark.createDataFrame(items, "item_id int, text string")
    options = {"window": 5, "shard_words": shard, "block_bytes": block}
    d = frame(spark, texts)
    odd = decontamination.find_contamination(frame(spark, texts[-3:] * 2, [None, None, 4, 4, 4, None]), bench, **options).collect()
    assert sorted((str(r["doc_id"]), r["n_hit"]) for r in odd) == sorted((str(i), plain_hits(t, items, 5)[1]) for i, t in zip([None, None, 4, 4, 4, None], texts[-3:] * 2))
    got = {r["doc_id"]: r for r in decontamination.find_contamination(d, bench, **options).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["items"]) == plain_hits(t, items, 5), t
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    clean = decontamination.decontaminate(d, bench, **options)
    assert clean.columns == d.columns
    for r in clean.collect():
        before = texts[r["doc_id"]]
        assert (r["text"] == before) if not got[r["doc_id"]]["n_hit"] else plain_hits(r["text"], [], 5)[0] == got[r["doc_id"]]["n_words"] - got[r["doc_id"]]["n_hit"]
    assert decontamination.find_contamination(frame(spark, []), bench).count() == 0
    assert decontamination.find_contamination(d, bench.where("false")).where("n_hit > 0").count() == 0


def test_suffix_order_is_that_of_sorting():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = np.r_[rng.integers(0, 3, rng.integers(0, 60)), 0]

        def key(i, x=x):
            end = i + int(np.flatnonzero(x[i:] == 0)[0])
            return [*x[i:end].tolist(), 0, end]  # cut at the separator, which counts by its position

        want = sorted(range(len(x)), key=lambda i: (key(i)[:-1], key(i)[-1]))
        assert decontamination.suffix_order(x).tolist() == want


# ---- pipeline -------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    prose = lambda n: " ".join(f"{w}." if k % 9 == 8 else w for k, w in enumerate(rng.choice(["house", "river", "of", "the", "stone", "walks", "evening", "slowly"]) + "abcdefgh"[rng.randrange(8)] for _ in range(n)))
    good = [prose(80) for _ in range(160)]
    bad = [" | ".join(rng.choice(["AAA!!", "###", "%%%"]) + str(rng.randrange(99)) for _ in range(60)) for _ in range(80)]
    leak = prose(14)
    special = [good[0] + " again", good[1] + " " + leak + " " + prose(20), good[2] + " password=abcdef0123456789ff " + prose(20)]
    special[1:] = [prose(40) + " " + leak + " " + prose(40), prose(40) + " password=abcdef0123456789ff " + prose(40)]
    texts = [*good, *bad, *special]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 160), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        d = common.materialize(stage(spark, d, str(tmp_path)))
        seen[name] = d
    ids = lambda name: {r["doc_id"] for r in seen[name].collect()}
    first, second, third, fourth = [n for n, _ in corpus_pipeline.STAGES][:4]
    assert all(seen[n].columns == docs.columns for n in (first, second, third, fourth))
    clean = set(range(160)) | set(range(240, 243))
    assert len(ids(first) & clean) >= len(clean) - 2 and len(ids(first) - clean) <= 2
    assert ids(first) - ids(second) == {240}
    after = {r["doc_id"]: r["text"] for r in seen[fourth].collect()}
    assert leak not in after[241] and "password" not in after[242] and "[SECRET]" in after[242]
    assert all(after[k] == texts[k] for k in after if k not in (241, 242))
    total = collections.Counter()
    for r in seen[corpus_pipeline.STAGES[4][0]].collect():
        total[r["doc_id"]] += r["length"]
    assert set(total) == set(after)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    digest = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert digest(whole) == digest(seen[corpus_pipeline.STAGES[4][0]])



def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (None, "words " * 50, None, "b", 300), (None, "words " * 50, None, "b", 300), (4, "word " * 20_000, "en", "a", 1)]
    for name, given in (("odd", rows), ("none", [])):
        home = tmp_path / name
        spark.createDataFrame(given, schema).write.parquet(str(home / "documents.parquet"))
        # all labelled rows are good ones, so nothing is rejected
        spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(home / "labels.parquet"))
        spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(home / "benchmark.parquet"))
        got = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(home)).where("start = 0").collect())
        assert got == collections.Counter(r[0] for r in given)
