"""Null and repeated ids, very long texts and clashing names, for operators whose other tests leave them out."""

import public_tokenizers as public
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsieve.llm import chat_format, decontamination, packing, quality_rules, token_counts


def test_token_counts_of_null_and_repeated_ids(spark):
    path = public.path("word_bpe_49k.json")
    rows = [(None, "two words"), (7, "a"), (7, "a"), (7, None), (None, None)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    count = lambda t: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids)
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((i or -1, count(t)) for i, t in rows)


def test_chats_with_very_long_texts_and_texts_that_begin_alike(spark):
    long, same = "long text " * 300_000, "x" * 64
    turns = [("a", 0, "user", long), ("a", 1, "assistant", long + "end"), ("b", 0, "user", same + "2"), ("b", 0, "user", same + "1"), ("b", 0, "user", same), ("b", 1, "assistant", "ok")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string").repartition(3)
    rows = {}
    for r in chat_format.format_chats(df).orderBy("conv_id", "part").collect():
        rows.setdefault(r["conv_id"], []).append(r)
    whole = "".join(r["rendered"] for r in rows["a"])
    assert whole.count("long text ") == 600_000 and sum(r["n_turns_in"] for r in rows["a"]) == 2
    text = "".join(r["rendered"] for r in rows["b"])
    places = [text.index(same), text.index(same + "1"), text.index(same + "2")]
    assert places == sorted(places) and sum(r["n_turns_in"] for r in rows["b"]) == 4


def test_rules_keep_columns_but_their_own(spark):
    df = spark.createDataFrame([(1, "some words of a text " * 20, "x", 5, 9)], "doc_id long, text string, kept string, failed_rule int, n_words int")
    out = quality_rules.quality_rules(df, columns=("n_words",))
    row = out.first()
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_words", "failed_rule", "kept"]) and row["n_words"] == 100 and row["kept"] in (True, False)


def test_decontamination_with_clashing_columns(spark):
    phrase = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"before {phrase} after", 3, "x", True, "row"), (2, "clean", 4, "y", False, "row")],
                               "doc_id long, text string, spans int, items string, clean_text boolean, _row string")
    bench = spark.createDataFrame([("i", phrase, 1)], "item_id string, text string, spans int")
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontamination.find_contamination(df, bench).collect()) == [(1, 12), (2, 0)]
    out = decontamination.decontaminate(df, bench)
    assert out.columns == df.columns and {r["doc_id"]: (" ".join(r["text"].split()), r["spans"], r["items"], r["clean_text"]) for r in out.collect()} == {
        1: ("before after", 3, "x", True), 2: ("clean", 4, "y", False)}


def test_packing_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words", "a", 5, "x", 6), (None, None, None, 5, "x", 6)], "doc_id long, text string, source string, start int, length string, sequence_id int")
    got = packing.pack(df, public.path("byte_bpe_50k.json"), length=16).select("doc_id", "start", "length", "doc_tokens").collect()
    assert sorted((r["doc_id"] or 0, sum(x["length"] for x in got if x["doc_id"] == r["doc_id"])) for r in got if r["start"] == 0) == [(0, 1), (1, 3)]
    assert dict(packing.pack(df, public.path("byte_bpe_50k.json"), length=16).where(F.col("doc_id") == 1).dtypes)["length"] in ("bigint", "int")
