"""Clashing columns, hot ids, empty vectors, many domains, unusual texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospect.llm import decontaminate, mixing, sharding, simhash, tokenfiles, topk

pytestmark = pytest.mark.filterwarnings("ignore")
CLASHES = ["leak_id", "leak_hash", "keep_id", "keep_hash", "keep_times", "slot", "mix_rate", "mix_draw", "mix_copy", "mix_f_source", "__id", "__rate",
           "a.b", "DOC_HASH", "fp", "rate", "copies", "at", "name"]


def clashing(spark, rows=60):
    base = spark.range(rows).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id").cast("string"), F.lit(" and a few more of them")).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.lit(40).alias("n_chars"))
    return base.select("*", *(F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")).alias(c) for k, c in enumerate(CLASHES)))


def extras(df):
    return {r["doc_id"]: tuple(r[c] for c in CLASHES) for r in df.collect()}


@pytest.mark.parametrize("stage", ["keep_one", "drop_leaks", "mix", "assign_shards"])
def test_any_column_names_pass_through(spark, stage):
    df = clashing(spark)
    item = spark.createDataFrame([(1, "some words of text number 7 and a few more of them")], "item_id long, text string")
    domains = df.select("doc_id", F.col("source").alias("domain"))
    out = {"keep_one": lambda: simhash.keep_one(df), "drop_leaks": lambda: decontaminate.drop_leaks(df, item),
           "mix": lambda: mixing.mix(df, domains), "assign_shards": lambda: sharding.assign_shards(df)}[stage]()
    assert out.columns == [*df.columns, "shard"] if stage == "assign_shards" else out.columns == df.columns
    before, after = extras(df), extras(out)
    assert after and all(before[k] == v for k, v in after.items())


def test_ten_thousand_domains(spark):
    n = 10_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 4 + 1).cast("int")).alias("text"),
                               F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows = mixing.rates(df, df.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("domain")))
    assert rows.count() == n and rows.filter("rate IS NULL OR rate < 0 OR isnan(rate)").count() == 0


def test_fitted_tokens_meet_the_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 60))), "en", f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labelled, goal = df.select("doc_id", F.col("source").alias("domain")), {"s0": 0.6, "s1": 0.3, "s2": 0.1}
    # Independent of the fit: expected domain tokens from the posteriors and rates it returns.
    cells, rated, _ = mixing.document_rates(df, labelled, goal)
    mass = cells.join(rated, list(mixing.FEATURES)).select((F.col("tokens") * F.col("rate")).alias("m"), F.posexplode("p")).groupBy("pos").agg(
        F.sum(F.col("m") * F.col("col")).alias("m")).orderBy("pos").collect()
    total = sum(r["m"] for r in mass)
    assert [round(r["m"] / total, 2) for r in mass] == [0.6, 0.3, 0.1]


def test_posteriors_equal_naive_bayes(spark):
    rows = [(0, "en", "a"), (1, "en", "a"), (2, "de", "b"), (3, "fr", "c"), (4, "en", "c"), (5, None, "a")]
    df = spark.createDataFrame([(i, "same text", lang, "s") for i, lang, _ in rows], "doc_id long, text string, lang string, source string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows], "doc_id long, domain string")
    _, rated, _ = mixing.document_rates(df, labelled)
    held, langs = {"a": 3, "b": 1, "c": 2}, {("en", "a"): 2, ("de", "b"): 1, ("fr", "c"): 1, ("en", "c"): 1, ("", "a"): 1}
    for r in rated.collect():
        # The four other features have one value each, which every labelled document shows.
        w = [held[d] / 6 * (langs.get((r["f_lang"], d), 0) + 1) / (held[d] + 5) * ((held[d] + 1) / (held[d] + 2)) ** 4 for d in "abc"]
        assert np.allclose(r["p"], np.array(w) / sum(w))


def test_empty_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.25, 2.0]), (100, []), (200, None), (300, [1.0, 1.0]), (300, [1.0, 1.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.search(v, v.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 300), (0, 2, 1), (300, 1, 1), (300, 2, 0)] or {q for q, *_ in got} == {0, 300} and (100 not in {c for *_, c in got})
    none = v.limit(0)
    assert topk.search(none, none, 10).count() == 0


def test_words_are_encoded_like_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        own, tok = tokenfiles.Encoder(f.read(), "<u2"), Tokenizer.from_file(path)
    rng = random.Random(1)
    words = ["a", "Straße", "naïve", "don't", "x.", "x..", "É!", "1", "12,", "½", " ", "́", "你好", "😀", "<|endoftext|>", "\t", "", "#$", "a_b", "ǅ", "ñandú;", "А."]
    texts = [rng.choice([" ", "\n", " "]).join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(3000)]
    texts += [f"a {chr(c)}b c{chr(c)} d" for c in range(1, 0x600)] + [f"a {chr(c)}\n{chr(c)}." for c in range(1, 0x600)]
    want = [np.asarray(e.ids, "<u2").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want


def test_the_word_table_starts_anew_without_changing_ids(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    texts = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(50)]
    want = tokenfiles.Encoder(spec, "<u2").encode(texts)
    monkeypatch.setattr(tokenfiles, "PIECES", 30)
    small = tokenfiles.Encoder(spec, "<u2")
    assert small.encode(texts) == want and len(small.spaced) < 60


def test_one_id_for_all_rows_spreads(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # or it would join these small partitions again
        manifest = tokenfiles.write_token_files(df, tokenfiles.scratch_path(spark, "one-id"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    parts = [r["docs"] for r in manifest.collect()]
    assert sum(parts) == 4000 and max(parts) <= 2000
    rows = tokenfiles.read_token_files(manifest).collect()
    assert len(rows) == 4000 and {r["doc_id"] for r in rows} == {None}
