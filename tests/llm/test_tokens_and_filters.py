"""Trie encoding, token alignment and the audit of filters, against the libraries and plain versions."""

import collections
import hashlib
import itertools
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsieve.llm import bpe_trie, filter_audit, token_alignment
from docsieve.llm.token_counts import byte_chars

from .test_text_operators import ODD, PIECES, docs, empty, mixed

SF = "/root/testdata/sf0.001"
WORD, BYTE, PIECE = (public.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


# ---- encoding and decoding --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoding_and_decoding_equal_the_library(spark, path):
    rng = random.Random(4)
    texts = [*ODD, *mixed(rng, PIECES, 300), "".join(rng.choices("etaoinshr", k=3000)), "<|endoftext|>" * 3]
    own = Tokenizer.from_file(path)
    out = bpe_trie.decode(bpe_trie.encode(docs(spark, texts), path), path)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = {r["doc_id"]: r for r in out.collect()}
    for k, t in enumerate(texts):
        want = own.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == want and got[k]["decoded"] == own.decode(want, skip_special_tokens=False), repr(t)[:80]
    assert bpe_trie.encode(docs(spark, texts), path, decoded=True).exceptAll(out).count() == 0
    assert bpe_trie.encode(empty(spark), path).count() == 0
    broken = spark.createDataFrame([(1, None), (1, []), (None, [220, 128])], "doc_id long, ids array<int>")
    assert sorted(x["decoded"] for x in bpe_trie.decode(broken, path).collect()) == sorted(["", "", own.decode([220, 128], skip_special_tokens=False)])


def test_repeated_rows_and_null_ids_are_encoded_each(spark):
    got = bpe_trie.encode(docs(spark, ["ab c", "ab c", None], [None, 7, 7]), WORD).collect()
    want = Tokenizer.from_file(WORD).encode("ab c").ids
    assert sorted(((r["doc_id"] or 0), r["ids"]) for r in got) == [(0, want), (7, []), (7, want)]


def _plain(symbols, merges):
    rank = {p: k for k, p in enumerate(merges)}
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return symbols
        i = best[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


@pytest.mark.parametrize("suffix", ["", "</w>"])
def test_trie_against_one_merge_at_a_time(suffix):
    rng = random.Random(5)
    for trial in range(40):
        vocab = {c + s: k for k, (c, s) in enumerate((c, s) for s in dict.fromkeys(["", suffix]) for c in byte_chars())}
        merges = []
        while len(merges) < 25:  # any merges of what is there already, in any order
            a = rng.choice([x for x in vocab if not (suffix and x.endswith(suffix)) and set(x) <= set("abc")])
            b = rng.choice([x for x in vocab if set(x.removesuffix(suffix) if suffix else x) <= set("abc") and x != suffix])
            if a + b not in vocab and len(a + b) < 12 + len(suffix):
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        pairs = bpe_trie.BytePairs(vocab, merges, suffix, remember=50)
        words = list({"".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(150)})
        names = {k: x for x, k in vocab.items()}
        got = [[names[t] for t in w] for w in pairs.encode_words([w.encode() for w in words])]
        assert got == [_plain([*w[:-1], w[-1] + suffix], merges) for w in words], (trial, merges)


def test_a_shared_prefix_is_walked_once():
    class Counting(dict):
        looked = 0

        def __getitem__(self, key):
            Counting.looked += 1
            return super().__getitem__(key)

    pairs = bpe_trie.BytePairs({c: k for k, c in enumerate(byte_chars())}, [])
    pairs.edges = Counting(pairs.edges)
    pairs.encode_words([b"prefix" * 20 + bytes([65 + k]) for k in range(26)])
    assert Counting.looked == 120 + 26


def test_a_vocabulary_whose_merges_come_before_their_parts_is_refused():
    vocab = {c: k for k, c in enumerate(byte_chars())} | {"abc": 256, "ab": 257}
    with pytest.raises(ValueError, match="merge 0"):
        bpe_trie.BytePairs(vocab, [("ab", "c"), ("a", "b")])


# ---- alignment ----------------------------------------------------------------------------------------------------------------------

def _aligned(texts):
    """Groups, overlaps and links of each text by walking over its bytes."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_chars())}
    out = []
    for t in texts:
        groups, common = [], 0
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            raw_a = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a]
            raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
            if b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
                ends_a, ends_b = set(itertools.accumulate(map(len, raw_a))), set(itertools.accumulate(map(len, raw_b)))
                common = len(ends_a | ends_b)
                at = dict.fromkeys(sorted(ends_a & ends_b))
                for end in at:
                    at[end] = ([], [])
                for ids, raw, side in ((ids_a, raw_a, 0), (ids_b, raw_b, 1)):
                    for x, end in zip(ids, itertools.accumulate(map(len, raw))):
                        at[min(e for e in at if e >= end)][side].append(x)
                groups = list(at.values())
        out.append((groups, common))
    return out


ALIGN = [*ODD[:4], "x" * 3000, *ODD[5:], "▁a", "a ▁", "<s>a</s>", "<|endoftext|>", "  two  spaces  ", "naïve façade – “quoted”", "\r\n\t1234567 12.5%", "😀😀 漢字かな"]


@pytest.mark.parametrize("max_pairs", [2_000_000, 40, 0])
def test_alignment_against_walking_over_bytes(spark, max_pairs):
    rng = random.Random(6)
    texts = [*ALIGN, *mixed(rng, [*PIECES, " the", " of", "ing "], 60)]
    want = _aligned(texts)
    counts = collections.Counter((g[0][-1], g[1][-1]) for groups, _ in want for g in groups)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    more = (public.path("byte_bpe_50k.tiktoken"), public.PATTERN) if max_pairs else (None, None)
    spans = {r["doc_id"]: r for r in token_alignment.align(docs(spark, texts), BYTE, PIECE, *more).collect()}
    got = {r["doc_id"]: r for r in token_alignment.score_links(token_alignment.summarize(docs(spark, texts), BYTE, PIECE, *more), max_pairs=max_pairs).collect()}
    for k, (groups, common) in enumerate(want):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""
        assert tuple(got[k][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == (
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest), repr(texts[k])[:80]
        assert spans[k]["n_overlaps"] == common and len(spans[k]["a_ends"]) == len(spans[k]["b_ends"]) == len(groups)
    assert set(got[0].asDict()) == {"doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"}


def test_alignment_of_no_rows_null_ids_and_repeated_rows(spark):
    run = lambda d: token_alignment.score_links(token_alignment.summarize(d, BYTE, PIECE))
    assert run(empty(spark)).count() == 0
    got = run(docs(spark, ["a b", "a b", None], [None, None, 3])).collect()
    assert sorted((r["n_links"], r["n_best"], r["count_sum"]) for r in got) == [(0, 0, 0), (2, 2, 4), (2, 2, 4)]


def test_overlaps_and_cuts_of_owner_arrays():
    a, b = token_alignment.owners(np.array([2, 3, 1])), token_alignment.owners(np.array([1, 1, 4]))
    assert token_alignment.overlaps(a, b).tolist() == [0, 1, 2, 5] and token_alignment.cuts(a, b).tolist() == [1, 5]
    none = token_alignment.owners(np.zeros(0, int))
    assert not len(token_alignment.overlaps(none, none)) and not len(token_alignment.cuts(none, none))


def test_counts_are_passed_on_when_a_task_holds_many(spark):
    rows = [(k, [k % 7, 100 + k], [2, 1]) for k in range(60)]
    summary = spark.createDataFrame(rows, "doc_id long, links array<long>, times array<long>").coalesce(1)
    got = {r["pair"]: r["count"] for r in token_alignment.count_pairs(summary, held=5).collect()}
    want = collections.Counter()
    for _, links, times in rows:
        want.update(dict(zip(links, times)))
    assert got == dict(want)


# ---- filters ------------------------------------------------------------------------------------------------------------------------

LONG = " ".join(f"w{k}" for k in range(220))
AUDIT = [None, "", LONG, LONG, LONG.upper(), LONG + " #", "a " * 250, "a b", "A", "x" * 50_000, "é É " * 120, LONG, " \x1c\x85 ", LONG + " x"]


def _audit(rows, labels):
    """Every order run over all rows as they stand. rows: (id, text, part)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    marks = {k: [any(x[0] == k and x[j] == 1 for x in labels) for j in (1, 2)] for k in {x[0] for x in labels} - {None}}
    flags = []
    for i, t, part in rows:
        t = t or ""
        w = word.findall(t)
        flags.append((part or "", {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)},
            *marks.get(i, (False, False))))
    out = {}
    for part in {f[0] for f in flags}:
        mine = [f for f in flags if f[0] == part]
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), k] = [
                    len(left), len(gone), sum(x[1][f] for x in mine) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, k), x in out.items():
            if p == part:
                x.append(total[order[k - 1]])
    return out


def test_audit_against_running_every_order(spark):
    rng = random.Random(7)
    texts = [*AUDIT, *(rng.choice(AUDIT) for _ in range(60)), *mixed(rng, ["a ", "B ", "# ", "word ", LONG + " "], 40)]
    ids = [None if k % 17 == 5 else rng.randint(0, 90) for k in range(len(texts))]
    rows = [(i, t, rng.choice(["en", "de", "", None])) for i, t in zip(ids, texts)]
    rows += rows[:9]  # the same rows again
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in [*range(0, 60), *range(10, 20), None, 500]]
    table = spark.createDataFrame([(*r, 1, True, "x") for r in rows], "doc_id long, text string, lang string, n int, A boolean, part string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in filter_audit.audit_filters(table, marks).collect()}
    want = _audit(rows, labels)
    assert len(want) in (3 * 600, 4 * 600) and got == want


def test_audit_without_documents_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(spark.createDataFrame([], "doc_id long, text string, lang string"), none).count() == 0
    one = filter_audit.audit_filters(spark.createDataFrame([(1, LONG, None)], "doc_id long, text string, lang string"), none)
    assert one.count() == 600 and one.where("part = '' and kept = 1 and removed = 0 and shapley = 0").count() == 600


def test_ids_that_are_no_integers_are_refused(spark):
    none = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    with pytest.raises(TypeError, match="integer"):
        filter_audit.audit_filters(spark.createDataFrame([], "doc_id string, text string, lang string"), none)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_audit_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(filter_audit.ORACLE)
    got = filter_audit.op13_filter_audit(spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_token_queries_over_the_table(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = Tokenizer.from_file(WORD)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe_trie.op11_bpe_trie(spark, SF).collect():
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False)))
    ids = sorted(texts)
    want = dict(zip(ids, _aligned([texts[k] for k in ids])))
    counts = collections.Counter((g[0][-1], g[1][-1]) for groups, _ in want.values() for g in groups)
    for r in token_alignment.op12_token_alignment(spark, SF).where(F.col("doc_id") % 10 == 0).collect():
        groups = want[r["doc_id"]][0]
        assert r["n_groups"] == len(groups) and r["count_sum"] == sum(counts[g[0][-1], g[1][-1]] for g in groups)
