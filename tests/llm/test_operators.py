"""The corpus operators against brute force, round trips and held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from prospect.llm import decontaminate, htmltext, licenses, lm, mixing, quality, sharding, simhash, tokenfiles, topk

pytestmark = pytest.mark.filterwarnings("ignore")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, shard int"


def docs(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, 1, 9) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), DOCS)


ODD = [None, "", "  \n\t ", "one", "The Cat sat on the mat and looked at the moon tonight", "x" * 30_000, "word " * 5_000]


# ------------------------------------------------------------------ simhash

def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.unique(np.concatenate([centre] + [centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 12)).astype(np.uint64), axis=0) for k in (1, 2, 3, 4, 5, 6)]))
    i, j = simhash.join_nodes(np.zeros(len(fp), int), fp, 4)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 4}
    assert got == want and want


@pytest.mark.parametrize("blocks", [5, 6])
def test_every_near_pair_meets_in_a_trie(blocks):
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = int(rng.integers(0, 1 << 62))
        b = a
        for bit in rng.integers(0, 64, 4):
            b ^= 1 << int(bit)
        assert any(all((a >> s) & ((1 << w) - 1) == (b >> s) & ((1 << w) - 1) for s, w in t) for t in simhash._tries(blocks, 4))


def test_near_duplicates_and_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [*ODD, base, base.replace("w200", "other"), base.upper()]
    df = docs(spark, texts, [(None, base, "en", "s", 1, 0.0, 0, 0), (7, base, "en", "s", 1, 0.0, 0, 0)])
    rows = simhash.near_duplicates(df).collect()
    fps = {i: simhash.fingerprint(t) for i, t in enumerate(texts)}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["fp"] & ((1 << 64) - 1) == fps[r["doc_id"]]
    want = {i: min(k for k in fps if _reach(fps, i, k)) for i in fps}
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] is not None} == set(want.items())
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [7] and len(rows) == len(texts) + 2
    kept = simhash.keep_one(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values())) and set(kept[0].asDict()) == set(df.columns)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_groups_are_told_apart_by_more_than_their_smallest_id(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(400)) for w in ("a", "b", "c"))
    near = next(t for t in (three.replace(f"c{k} ", "other ") for k in range(100, 200))
                if 0 < (simhash.fingerprint(three) ^ simhash.fingerprint(t)).bit_count() <= 4)
    rows = [(0, one), (5, one.upper()), (0, two), (6, two), (None, three), (None, near)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["text"][0].lower()) for r in kept) == [(False, "a"), (False, "b"), (True, "c")]


def _reach(fps, a, b):
    seen, todo = {a}, [a]
    while todo:
        x = todo.pop()
        new = [y for y in fps if y not in seen and (fps[x] ^ fps[y]).bit_count() <= 4]
        seen.update(new)
        todo += new
    return b in seen


# ------------------------------------------------------------------ quality

def test_quality_learns_and_scores_every_row(spark):
    good = ["the quick brown fox number %d runs over the lazy dog" % i for i in range(60)]
    bad = ["spam%%%%*** click### %d buy&&& now$$$ spam***" % i for i in range(60)]
    df = docs(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.score_documents(df, labels).collect()}
    assert len(rows) == 120 + len(ODD)
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (i in held) for i in range(120))
    assert sum(rows[i]["predicted"] == int(i < 60) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    none = quality.score_documents(df, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.keep_good(df, labels).columns == df.columns


# ------------------------------------------------------------ decontaminate

def _jaccard(a, b):
    ca, cb = Counter(a), Counter(b)
    return sum((ca & cb).values()) / sum((ca | cb).values())


def _grams(text):
    import re
    ws = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else ([tuple(ws)] if ws else [])


def test_leaks_equal_brute_force(spark):
    item = " ".join(f"item{i}" for i in range(40))
    near = item.replace("item0 ", "changed ").replace("item39", "end")
    far = " ".join(f"item{i}" if i % 6 else "gap" for i in range(40))
    filler = " ".join(f"fill{i}" for i in range(60))
    texts = [*ODD, item, f"{filler} {item} {filler}", f"{filler}\n{near}, {filler}", f"{filler} {far}", filler, f"{item} {item}", item[:-20]]
    bench = spark.createDataFrame([(1, item), (2, "short words only"), (3, None), (4, item), (5, "")], "item_id long, text string")
    df = docs(spark, texts, [(8, texts[8], "en", "s", 1, 0.0, 0, 0)])
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(df, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        g = _grams(t)
        for i, q in ((1, item), (2, "short words only"), (4, item)):
            h = _grams(q)
            best = max((_jaccard(h, g[s:s + len(h)]) for s in range(max(1, len(g) - len(h) + 1))), default=0) if g else 0
            if best >= 0.8:
                want[d, i] = best
    assert got == pytest.approx(want) and len(want) >= 8
    left = decontaminate.drop_leaks(df, bench).collect()
    assert {r["doc_id"] for r in left} == set(range(len(texts))) - {d for d, _ in want}


# ------------------------------------------------------------------- mixing

def test_rates_move_domains_to_their_targets(spark):
    df = docs(spark, ["one two three four"] * 300 + ODD)
    labelled = spark.createDataFrame([(i, f"s{i % 3}") for i in range(0, 300, 2)], "doc_id long, domain string")
    goal = {"s0": 0.6, "s1": 0.3, "s2": 0.1}
    rows = mixing.rates(df, labelled, goal).collect()
    assert len(rows) == 300 + len(ODD) and all(r["rate"] >= 0 and r["copies"] >= 0 for r in rows)
    mass = Counter()
    for r in rows:
        mass[f"s{r['doc_id'] % 3}"] += r["rate"] * r["tokens"]
    total = sum(mass.values())
    assert mass["s0"] / total > 0.5 > mass["s1"] / total > mass["s2"] / total
    mixed = mixing.mix(df, labelled, goal)
    assert mixed.columns == df.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert mixing.rates(df.limit(0), labelled).count() == 0
    assert {r["rate"] for r in mixing.rates(df, labelled.limit(0)).collect()} == {1.0}


# ----------------------------------------------------------------- sharding

def test_table_is_fair_and_moves_little():
    table = sharding.fill_table(sharding.shard_names(16))
    sizes = Counter(table)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    other = sharding.fill_table(sharding.shard_names(15))
    assert sum(a != b for a, b in zip(table, other)) < 0.25 * len(table)


def test_every_row_gets_a_shard(spark):
    df = docs(spark, ODD * 3, [(None, "a", "en", "s", 1, 0.0, 0, 0), (None, None, "en", "s", 1, 0.0, 0, 0)])
    rows = sharding.assign_shards(df).collect()
    assert len(rows) == len(ODD) * 3 + 2 and all(0 <= r["shard"] < 16 for r in rows)


# -------------------------------------------------------------------- top k

def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(300, 8)).round(2).tolist()
    vec[5] = vec[6] = vec[7]
    rows = [(i, v) for i, v in enumerate(vec)] + [(900, None), (1000, [float("nan")] * 8), (1100, [None] * 8), (1200, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(v, v.filter("vec_id % 5 = 0"), 10).collect()}
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in enumerate(vec)}
    for q in range(0, 300, 5):
        best = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(c, -s) for s, c in best]
    assert len(got) == 600


# -------------------------------------------------------------- token files

def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + ["a  b\n\nc \n", "Ünï çödé x", "tab\tand 's <|endoftext|>"]
    df = docs(spark, texts, [(None, "none", "en", "s", 1, 0.0, 0, 0)])
    rows = sorted(tokenfiles.tokenize(spark, df, path).collect(), key=lambda r: r["start"])
    tok = Tokenizer.from_file(path)  # untouched: the end token's string inside a text is its id
    at = 0
    for r, t in zip(rows, ["none", *texts]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in rows] == [None, *range(len(texts))]
    assert tokenfiles.tokenize(spark, df.limit(0), path).count() == 0


# -------------------------------------------------------------------- model

def test_language_model_counts_and_sums_to_one(spark):
    text = "the cat sat on the mat . a dog ran in the park ."
    df = docs(spark, [f"{text} {text} number{i}" for i in range(60)] + ODD)
    rows = {r["doc_id"]: r for r in lm.score_documents(df).collect()}
    data = {i: [*lm.tokens(t), b" "] for i, t in enumerate([f"{text} {text} number{i}" for i in range(60)] + ODD)}
    held = {i for i in data if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, ws in data.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in data.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0


def test_language_model_learns_from_all_documents_however_they_are_dealt(spark):
    text = "the cat sat on the mat . a dog ran in the park . " * 30
    df = docs(spark, [f"{text} number{i}" for i in range(60)])
    scores = [{r["doc_id"]: r for r in lm.score_documents(df.repartition(n)).collect()} for n in (1, 7)]
    for i, r in scores[0].items():
        assert r["score"] == pytest.approx(scores[1][i]["score"], rel=1e-4)
        assert r["score"] > 0.95 * r["base_score"]
    training = df.filter("doc_id < 60")
    known = lm._vocabulary(lm.count_words(training))
    rows = lm.training_streams(training, known)[0].collect()
    assert len(rows) == 60 and sum(len(r["symbols"]) // 2 for r in rows) == known[2]


def test_network_is_a_distribution():
    words = [b" ", b"a", b"b", b"c"]
    v = lm.Vocabulary(words, [5, 4, 3, 2], 14, 4, {})
    p = lm._network(v)
    end = [v.encode([b" "])] * 4
    total = sum(math.exp(lm.score_batch(p, v, [v.encode([w])], [v.symbol[v.encode([w])]])[0]) for w in words)
    tail = sum(math.exp(lm.score_batch(p, v, [np.array([-1 - k])], [np.array([lm.HEAD + k])])[0]) for k in range(lm.TAIL))
    assert end and total + tail == pytest.approx(1.0, abs=0.02)


# --------------------------------------------------------------------- html

PAGE = ('<html><head><title>T{0}</title><script>var t="</p>";</script></head><body><nav><a href="/x">m{0}</a></nav><div class="ad">ad{0}</div>'
        "<article><h1>Head {0}</h1><p>First&amp;{0}  text\n here</p><div class='comments'>rude {0}</div><p>Second {0}</article><footer>f{0}</footer></body></html>")


def test_main_text_of_templated_pages(spark):
    rows = [(i, "http://a.org/%d" % i, PAGE.format(i)) for i in range(6)] + [
        (10, None, None), (11, "http://b.org/", ""), (12, "http://c.org/", PAGE.format("z")[:-30]), (13, "odd", "plain words"), (14, "http://d.org", "<article>cut <b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.main_texts(df).collect()}
    for i in [*range(6), 12]:
        n = "z" if i == 12 else i
        assert got[i]["text"] == f"Head {n}\nFirst&{n} text here\nSecond {n}"
    assert [got[i]["text"] for i in (10, 11, 13, 14)] == ["", "", "plain words", "cut"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert htmltext.main_texts(df.limit(0)).count() == 0


def test_one_page_with_an_extra_div_keeps_its_hosts_articles(spark):
    page = ('<html><body><div class="ad">buy {0}</div>{1}<article><h1>Head {0}</h1><div class="ad">more {0}</div><p>Text {0}</p></article>'
            "<footer>f{0}</footer></body></html>")
    rows = [(i, "http://a.org/%d" % i, page.format(i, "<div>Notice</div>" if i == 4 else "")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nText {i}" for i in range(6)}


@pytest.mark.parametrize("odd", [{1}, {0, 2, 4}])
def test_blocks_in_another_order_lose_no_article(spark, odd):
    bar = '<section class="extra"><h4>Side</h4><b>{0}</b></section>'
    art = "<article><h1>Head {0}</h1><p>Text {0}</p></article>"
    rows = [(i, "http://a.org/%d" % i, f"<html><body>{bar + art if i in odd else art + bar}</body></html>".format(i)) for i in range(8)]
    for turn in (0, 1):  # either layout may hold the page that was the reference
        df = spark.createDataFrame([(r[0] + 100 * turn, *r[1:]) for r in rows], "page_id long, url string, html string")
        got = {r["page_id"]: r["text"] for r in htmltext.main_texts(df).collect()}
        assert got == {i + 100 * turn: f"Head {i}\nText {i}" for i in range(8)}


def test_what_a_host_repeats_is_template_without_article_or_telling_names(spark):
    # "Home" stands twice a page and "By" once a record: neither is found once a page.
    record = "<li class='x4'><i>By</i><p>Words {0}{1}</p></li>"
    page = ("<html><body><div class='x1'><b>Home</b><a>Help</a></div><div class='x2'><h2>Title {0}</h2><ul>{1}</ul></div>"
            "<div class='x3'><b>Home</b>Site rules apply</div></body></html>")
    rows = [(i, "http://a.org/%d" % i, page.format(i, "".join(record.format(i, "abcd"[k]) for k in range(1 + i % 4)))) for i in range(12)]
    rows += [(100 + i, "http://a.org/%d" % i, rows[i][2]) for i in range(2)]  # pages that come twice
    got = {r["page_id"]: r["text"] for r in htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = {i: "\n".join([f"Title {i}", *(f"Words {i}{'abcd'[k]}" for k in range(1 + i % 4))]) for i in range(12)}
    assert got == text | {100: text[0], 101: text[1]}


def test_roles_by_slot_and_instance():
    member = lambda c, k, x: {"class": c, "rank": k, "role": x, "content": False}
    level = htmltext.Level([member(0, 0, 2), member(0, 1, 4), member(1, 0, 10), member(1, 1, 12)])
    a, b, c, d, e, f, g, h, i, j = level.roles([2, 20, 10, 20, 12, 10, 20, 12, 4, 20])
    assert (a, i) == (2, 4)  # found once a page: kept
    assert len({b, d, j}) == 3 and d == g and (c, e) == (f, h)
    assert htmltext.Level([]).roles([2, 20]) == [2, 20]


def test_instances_are_ordered_and_nest():
    def orders(seq, fixed=()):
        return htmltext.instance_orders(seq, {10: 0, 12: 1, 20: 2, 22: 3}, [1, 1, 2, 2], {1: 2, 2: 2}, {1: 9, 2: 5}, dict.fromkeys(fixed))

    assert orders([10, 20, 22, 20, 22, 12, 10, 12]) == {1: (0, 1), 2: (2, 3)}
    assert orders([10, 12, 12, 10, 20, 22]) == {2: (2, 3)}   # no single order
    assert orders([10, 20, 12, 22, 10, 12]) == {1: (0, 1)}   # crossed: the rarer class goes
    assert orders([10, 2, 12, 20, 22], [2]) == {2: (2, 3)}   # a template token inside
    assert orders([10, 10, 20, 22, 20]) == {}                # one token twice, an open end


def test_longest_run_of_ranks():
    assert htmltext.longest_run([3, 4, 5, 0, 1, 2, 6, 7]) in ([0, 1, 2, 6, 7], [3, 4, 5, 6, 7])
    assert htmltext.longest_run([2, 1, 0]) in ([0], [1], [2]) and htmltext.longest_run([]) == []


# ----------------------------------------------------------------- licences

def test_licences_are_found_and_confirmed(spark):
    plain = "\n".join(f"ordinary line number {i} about gardens and rivers" for i in range(40))
    texts = [*ODD, f"{plain}\nReleased under the MIT License.", f"Licensed under CC BY-NC 4.0.\n{plain}", plain]
    rows = licenses.scan(docs(spark, texts)).filter("confirmed").collect()
    assert {(r["doc_id"], r["paragraph"], r["family"]) for r in rows} == {(7, 40, "mit"), (8, 0, "cc-by-nc")}


def test_licences_inside_long_lines_and_over_wrapped_lines(spark):
    long = " ".join(f"garden{i % 97} river{i % 89}" for i in range(1000))
    texts = [f"{long} Released under the MIT License. {long}", f"plain first line\n# Licensed under the\n# Apache License, Version 2.0.\n\n{long}",
             "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software", "Licensed under the\n\nApache License, Version 2.0.",
             f"{long}\n{long}", "Released under the MIT License."]
    rows = licenses.scan(docs(spark, texts)).filter("confirmed").collect()
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in rows if r["doc_id"] != 3) == [(0, 0, "mit"), (1, 1, "apache"), (2, 0, "mit"), (5, 0, "mit")]
