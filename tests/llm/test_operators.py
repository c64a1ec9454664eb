"""Small cases and brute-force twins of the training-data operators."""

import hashlib
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from factweave.llm import (
    chat_format, decontaminate, html_extract, language_id, line_dedup, mixing, near_duplicates, quality_rules, token_counts, warc,
)
from factweave.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n string, pos int, w string, rep long, id string, bands string, tokens long, at string, s string, t string, `a b` string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ing")) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(1)
    long_text = "\n".join(prose(rng, 40) for _ in range(800))
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "only words here and there", "en", None), (3, "  \n\n ", "de", "b"), (4, long_text, "en", "a"),
            (5, prose(rng, 80), "de", "a"), (5, None, "de", "a"), (6, "1234 !!", "en", "b"), (7, "x", None, "b")]
    rows += [(8, "same text " * 40, "en", "a")] * 3 + [(9, "same text " * 40, "en", "a")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["q"] * 2, 1, "q", 2, "q", "q", 3, *["q"] * 4) for r in rows], SCHEMA)


def test_quality_rules(spark, odd):
    got = [r for r in quality_rules.ledger(odd).collect()]
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id == 8:
            assert (r.n_words, r.n_repeat_words) == (80, 80)
        if r.doc_id in (1, 2):
            assert (r.n_words, r.n_repeat_words, r.word_chars) == (0, 0, 0)
    rated = quality_rules.apply_policy(quality_rules.ledger(odd), "2024.2")
    table = {r.rule: r for r in quality_rules.ablation(rated, "2024.2").collect()}
    assert set(table) == set(quality_rules.RULES)
    assert table["few_words"].n_failed == rated.where(F.col("failed").bitwiseAND(F.lit(1)) != 0).count()
    alone = rated.where(F.col("failed") == 1).count()
    assert table["few_words"].n_regained == alone
    assert quality_rules.ledger(odd.limit(0)).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(odd.limit(0)), "base").count() == 2


def test_repeat_words_brute(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b c d".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({p + d for p, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)}), t


def test_line_dedup(spark, odd):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "a\nb"), (4, "a\nb"), (5, "c\nd\ne\nc\nd\ne"), (6, None), (7, ""), (8, "\n\n\n")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].text == "a\nb\nc\nd\ne" and got[2].text == "x\ny" and got[2].n_removed == 3
    assert got[3].text == "a\nb" and got[4].text == "" and got[4].n_removed == 2
    assert got[5].text == "" and got[5].n_removed == 6  # first three lines stand in document 1, the others here
    assert got[6].text is None and got[6].n_lines == 0 and got[7].text == "" and got[8].text == "\n\n\n"
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and {r.n_removed for r in out.where("doc_id = 8").collect()} == {0}
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_line_dedup_symbol_lines(spark):
    """Lines without letters belong to their window, and so does their place."""
    texts = ["{\nreturn x;\n}", "---\nreturn x;\n***", "return x;\n{\n}", "{\nreturn x;\n}"]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[2], 3: ""}


def test_decontamination(spark, odd):
    rng = random.Random(3)
    item = prose(rng, 30).split()
    changed = list(item)
    for k in (4, 11, 19, 26):
        changed[k] = "other"
    far = [w if k % 2 else "zzz" for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "tiny exact item"), (3, None), (4, ""), (1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, prose(rng, 20) + " " + " ".join(item) + " tail"), (2, "pre " + " ".join(changed).upper() + "! post"), (3, " ".join(far)), (4, "a Tiny, exact ITEM here"), (5, "tiny other item"), (6, " ".join(item[:14]))], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.flag_documents(docs, bench).collect()}
    assert got == {1: "1", 2: "1", 3: "", 4: "2", 5: "", 6: "1"}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {3, 5}
    blocked = {r.doc_id: r["items"] for r in decontaminate.flag_documents(docs, bench, block_tokens=10).collect()}
    assert blocked == got
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()
    assert decontaminate.flag_documents(odd.limit(0), bench).count() == 0


def test_decontamination_shared_ids(spark):
    """Every text of an item is searched for, null ids count, and only the rows that hold one go."""
    rng = random.Random(12)
    texts = [prose(rng, 20) for _ in range(4)]
    bench = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "item_id long, text string")
    rows = [(k, f"see {t} end") for k, t in enumerate(texts)] + [(None, texts[0]), (None, "clean one"), (None, "clean two"), (0, "clean three"), (9, texts[1] + " . " + texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"block_tokens": 10}):
        got = {r.doc_id: (r.contaminated, r.n_items, r["items"]) for r in decontaminate.flag_documents(docs, bench, **options).collect()}
        assert got == {0: (True, 1, "1"), 1: (True, 1, "1"), 2: (True, 1, ""), 3: (True, 1, ""), None: (True, 1, "1"), 9: (True, 2, "1")}
        left = decontaminate.decontaminate(docs, bench, **options)
        assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["clean one", "clean three", "clean two"]


def near_corpus(seed, n):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n):
        base = prose(rng, rng.randint(3, 120)).split()
        for _ in range(rng.choice((1, 1, 1, 3, 12))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def test_near_duplicates_brute(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4000)  # several blocks and bins
    rows = near_corpus(2, 60)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    links = {i: set() for i, _ in rows}
    for a in links:
        for b in links:
            if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
    group = {}
    for a in sorted(links):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = a
                todo += links[x]
    got = {r.id: r for r in near_duplicates.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r.class_id for i, r in got.items()} == group


def test_near_duplicates_odd(spark, odd):
    got = near_duplicates.link_documents(odd).collect()
    assert len(got) == odd.count()
    assert {(r.class_id, r.n_links) for r in got if r.id in (8, 9)} == {(8, 3)}
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (8, 9)").select("doc_id").distinct().count() == 1
    assert near_duplicates.link_documents(odd.limit(0)).count() == 0
    bands, rows = near_duplicates.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= near_duplicates.RECALL


def test_keep_one_row(spark, odd):
    """Repeated rows are counted as rows, not as ids; which of them stays doesn't depend on the order."""
    assert near_duplicates.keep_one(odd).where("doc_id in (8, 9)").count() == 1
    same, near, apart = "one two three four five six", "one two three four five six", "something else that stands quite alone"
    rows = [(None, same, "b"), (None, same, "a"), (3, near, "a"), (4, apart, "z"), (4, apart, "y"), (4, apart, "y"), (5, None, "x")]
    for order in (rows, rows[::-1]):
        kept = near_duplicates.keep_one(spark.createDataFrame(order, "doc_id long, text string, source string"))
        assert sorted((str(r.doc_id), r.source) for r in kept.collect()) == [("4", "y"), ("5", "x"), ("None", "a")]


def test_mixing(spark, odd):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), rng.choice(("en", "de")), "big" if i % 3 == 0 else rng.choice("xyz")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    rated = mixing.rate_documents(docs).select("source", "lang", "rate", "kept", mixing.count_tokens(F.col("text")).alias("t"))
    by = {r.source: r.x for r in rated.groupBy("source").agg(F.sum(F.col("rate") * F.col("t")).alias("x")).collect()}
    own = {r.source: r.x**0.5 for r in rated.groupBy("source").agg(F.sum("t").alias("x")).collect()}
    for s in by:
        assert abs(by[s] / sum(by.values()) - own[s] / sum(own.values())) < 1e-6
    assert rated.where("rate > 1.0000001").count() == 0 and 0 < rated.where("kept").count() < 600
    assert mixing.rate_documents(odd).count() == odd.count()
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_chat_format(spark):
    control = chat_format.CONTROL
    raw = ['{"messages":[{"role":"user","content":"a & b <|x"},{"role":"assistant","content":"&lt;|"}]}', '{"conversations":[{"value":"hi","from":"human"},{"from":"gpt","value":null}]}',
           '{"prompt":"p","response":"%s"}' % control, '{"instruction":"i","output":""}', '{"other":[1,2]}', "no json", None, '{"messages":[]}', '{"messages":[{"role":"we\\nird","content":"x\\ny"}]}']
    done = chat_format.format_turns(chat_format.to_turns(spark.createDataFrame(list(enumerate(raw)), "i int, r string"), "r"))
    got = {r.i: r for r in done.select("i", "layout", "turns", "formatted", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [got[i].layout for i in range(9)] == ["messages", "from_value", "prompt_response", "instruction_output", None, None, None, "messages", "messages"]
    for r in got.values():
        assert r.back == r.turns
        if r.turns is not None:
            assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
            assert r.formatted.count(chat_format.OPEN) == len(r.turns)
    assert [t.role for t in got[1].turns] == ["user", "assistant"] and got[7].turns == []
    odd_rows = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, None, "assistant", "x" * 200000)], "conv_id long, turn long, role string, text string")
    assert chat_format.to_turns(chat_format.records_of(odd_rows), "record").where("layout is null").count() == 0
    assert chat_format.records_of(odd_rows.limit(0)).count() == 0


def test_token_counts(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = shared_dir(spark, "test-cache")
    got = token_counts.count_tokens(odd, cache, path).collect()
    assert len(got) == odd.count()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = {hashlib.sha256((r.text or "").encode()).hexdigest(): len(t.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()}
    assert {r.content: r.n_tokens for r in got} == want
    size = token_counts.stored(spark, cache).count()
    assert size == len(want)
    token_counts.count_tokens(odd, cache, path).collect()
    assert token_counts.stored(spark, cache).count() == size  # nothing encoded twice
    more = spark.createDataFrame([(1, "a<|endoftext|> b. c, d.e  f\t.\n x")], "doc_id long, text string")
    assert token_counts.count_tokens(more, cache, path).first().n_tokens == len(t.encode(more.first().text, add_special_tokens=False).ids)
    assert token_counts.stored(spark, cache).count() == size + 1


def test_token_pieces():
    import public_tokenizers

    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    parts = ["word", "Word.", "it's", "1,000", ",", ".", "...", "a.b,", "é.", "ß,", "<|endoftext|>", "x\ny", "\n", " ", "\t", " ", "　", "don't.", "😀", "we'll,"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    assert counter.count(texts) == counter.encode(texts)


def test_warc(spark):
    page = "<p>" + "x" * 200
    pages = spark.createDataFrame([(2, "u", page), (1, "u", page), (3, None, None), (4, "u\r\nX: y", "short"), (5, "u", "short"), (1, "u", page), (None, "u", "é" * 300)], "page_id long, url string, html string")
    got = warc.round_trip(pages.withColumn("payload", F.lit(1)).withColumn("a", F.lit(2)), shared_dir(spark, "test-warc")).collect()
    assert len(got) == 7 and {r.kind for r in got} == {"record"}
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert by[2] == [("revisit", 1, 203)] and by[1] == [("response", None, 203)] * 2 and by[3] == [("response", None, 0)]
    assert by[4] == by[5] == [("response", None, 5)] and by[None] == [("response", None, 600)]
    assert warc.round_trip(pages.limit(0), shared_dir(spark, "test-warc")).count() == 0


def test_warc_salvage():
    records = [warc.make_record(i, f"http://h/{i}", f"<p>{i}</p>".encode() * 50, hashlib.sha256(f"<p>{i}</p>".encode() * 50).hexdigest(), None, False) for i in range(6)]
    for pack in (lambda r: warc.member(r), lambda r: r):
        data = [bytearray(pack(r)) for r in records]
        data[1][-20] ^= 0xFF  # in the payload
        data[3] = data[3][:-9]
        stream = bytes(b"".join(data[:5]) + b"junk WARC/1.1 junk" + bytes(data[5]))
        out = list(warc.salvage(stream))
        assert [int(x[3]["x-page-id"]) for x in out if x[0] == "record"] == [0, 2, 4, 5]
        assert sum(stop - start for _, start, stop, _, _ in out) == len(stream)  # records and gaps cover every byte
    assert list(warc.salvage(b"")) == []


def test_language_id(spark, odd):
    rng = random.Random(8)
    sounds = {"aa": "la le lo na ne no".split(), "bb": "ksch krt zwa grz tz sch".split()}
    rows = [(i, " ".join("".join(rng.choice(sounds[k]) for _ in range(3)) for _ in range(rng.randint(3, 200))), k) for i in range(300) for k in [rng.choice(("aa", "bb"))]]
    rows += [(1000, None, "aa"), (1001, "12 !", "bb"), (1002, "la", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == 303 and (got[1000].lang_pred, got[1001].lang_pred) == ("und", "und")
    for i, _, k in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
    held = [(i, k) for i, _, k in rows[:300] if got[i].held_out]
    assert sum(got[i].lang_pred == k for i, k in held) / len(held) > 0.95
    assert language_id.keep_identified(docs).where("doc_id >= 1000").select("doc_id").collect() in ([], [(1002,)])
    assert language_id.identify(odd).count() == odd.count() and language_id.identify(odd.limit(0)).count() == 0
    assert language_id.keep_identified(odd).columns == odd.columns
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_language_sample(spark):
    """Copies count once, and a rare language doesn't let all texts of a common one through."""
    rows = [(f"common {i} text", "aa") for i in range(4000)] + [(f"rare {i}", "bb") for i in range(6)] + [(f"often {i}", "cc") for i in range(20) for _ in range(60)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    seen = {r.lang: r["count"] for r in language_id.training_candidates(docs, 10).groupBy("lang").count().collect()}
    assert 10 <= seen["aa"] <= 60 and seen["bb"] <= 6 and seen["cc"] == 20
    texts, labels = language_id.training_sample(docs, 10)
    assert {x: labels.count(x) for x in set(labels)} == {"aa": 10, "bb": seen["bb"], "cc": 10} and len(set(texts)) == len(texts)


def test_html(spark):
    chain = html_extract.trained()
    rng, n, good = random.Random(77), 0, 0
    for _ in range(200):
        page, labels = html_extract.labelled_page(rng)
        own = html_extract.blocks(page)
        assert len(own) == len(labels)
        got = chain.decode([chain.emit(b, {}) for b in own])
        n, good = n + len(labels), good + sum(a == b for a, b in zip(got, labels))
    assert good / n > 0.98
    rows = [(1, None), (2, ""), (3, "<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>Some  longer text,\n with <b>bold</b> words.<p>Next &eacute; one here.</article><footer>&copy; x</footer>"),
            (4, "<p>" * 3000 + "deep"), (5, "<script>if (a<b) {</script><div class='comments'><p>nice post</div>"), (6, "<a title=\"x>y\"")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumns({"url": F.lit("u"), "text": F.lit(1), "n_chars": F.lit("z")})
    got = {r.page_id: r for r in html_extract.extract(df, chain).collect()}
    assert got[1].text == got[2].text == "" and got[5].text == "" and got[6].n_chars == 0
    assert got[3].text == "A & B\nSome longer text, with bold words.\nNext é one here." and got[3].n_chars == len(got[3].text)
    assert html_extract.extract(df.limit(0), chain).count() == 0


def test_html_long_class_lists():
    """Near ancestors count however many class words the outer ones have, and unknown words change no score."""
    chain, rng = html_extract.trained(), random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join(f"zq{a}{b}" for a in letters[:10] for b in letters[:10])
    for _ in range(60):
        page, _ = html_extract.labelled_page(rng)
        want = html_extract.main_text(f"<div>{page}</div>", chain, {})
        assert html_extract.main_text(f'<div class="{many}">{page}</div>', chain, {}) == want
        every, own = html_extract.blocks(page), html_extract.blocks(page, chain.weights)
        assert [chain.emit(b, {}) for b in every] == pytest.approx([chain.emit(b, {}) for b in own])
    deep = "".join(f'<section class="zq{a}{b}{c}">' for a in letters for b in letters for c in letters[:5])
    assert html_extract.main_text(f"{deep}<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title</h1><p>Some longer text, with words in it.</p></article>", chain, {}) == "Title\nSome longer text, with words in it."
    assert max(len(b.around) for b in html_extract.blocks(deep + "x", chain.weights)) <= len(chain.weights)


def test_viterbi_brute():
    rng = random.Random(9)
    for _ in range(50):
        chain = html_extract.Chain({}, [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)])
        s = [rng.gauss(0, 1) for _ in range(rng.randint(1, 7))]
        rate = lambda y: sum(v for v, b in zip(s, y) if b) + sum(chain.moves[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(([int(c) for c in f"{k:0{len(s)}b}"] for k in range(2 ** len(s))), key=rate)
        assert chain.decode(s) == best
    assert chain.decode([]) == [] and re.match("a", "a")


def test_line_dedup_brute(spark):
    """Against a plain loop, with lines of marks only, blank lines and long documents."""
    rng = random.Random(31)
    pool = ["---", "***", "", "  ", "}", "one", "two", "three", "four", "five"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(150)] + ["\n".join(f"line {i}" for i in range(30_000))] * 2
    seen, want = set(), {}
    for d, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for p in range(max(1, len(lines) - 2)):
            window = tuple(lines[p : p + 3])
            if any(c.isalnum() for x in window for c in x):
                if window in seen:
                    gone |= set(range(p, min(p + 3, len(lines))))
                seen.add(window)
        want[d] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == want


def test_decontamination_long_item(spark):
    """The work grows with an item's length, not with its square; a leak anywhere in it is found."""
    rng = random.Random(41)
    item = [f"w{rng.randrange(50_000)}" for _ in range(50_000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "w1 w2 w3")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(item[-13:])), (2, " ".join(item[30_000:30_010])), (3, "x " + " ".join(item)), (4, " ".join(item[63:76]))], "doc_id long, text string")
    for block in (400_000, 20_000):
        got = {r.doc_id: r["items"] for r in decontaminate.flag_documents(docs, bench, block_tokens=block).collect()}
        assert got[1] == got[4] == "1" and got[2] == "" and got[3].startswith("1")


def test_decontamination_brute(spark):
    rng = random.Random(43)
    words = [f"t{i}" for i in range(30)]
    items = [[rng.choice(words) for _ in range(rng.randint(13, 40))] for _ in range(12)]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        own = list(rng.choice(items))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = "zz"
        cut = rng.randrange(max(1, len(own) - 12))
        docs.append((i, " ".join(t + own[cut:] + t)))

    def leaked(doc, item):
        for shift in range(-len(item), len(doc)):
            same = [0 <= shift + j < len(doc) and doc[shift + j] == x for j, x in enumerate(item)]
            if any(sum(same[k : k + 13]) >= 11 for k in range(len(item) - 12)):
                return True
        return False

    got = {r.doc_id: r["items"] for r in decontaminate.flag_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()}
    assert got == {i: ",".join(str(k) for k in sorted(k for k, x in enumerate(items) if leaked(t.split(), x))) for i, t in docs}


def test_near_duplicate_recall(spark):
    """At the default setting nothing of the planted pairs is missed by more than one in ten."""
    rows = near_corpus(7, 90)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    true = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    found = sum(r.n_links for r in near_duplicates.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()) / 2
    assert 0.9 * true <= found <= true


def test_near_duplicate_chain():
    """Members of a bucket that are unlike aren't chained; like ones are, in one tree."""
    import numpy as np

    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (40, 100), dtype=np.uint8)
    assert near_duplicates.spanning_links(np.arange(40), base) == []
    near = np.repeat(base[:4], 10, axis=0)
    near[:, :5] = rng.integers(0, 256, (40, 5), dtype=np.uint8)
    edges = near_duplicates.spanning_links(np.arange(40), near)
    assert len(edges) == 36 and all(u // 10 == v // 10 and u > v for u, v in edges)


def test_near_duplicate_forest_brute():
    """The forest joins just the members that a chain of agreeing sketches joins."""
    import numpy as np

    rng = np.random.default_rng(11)
    base = rng.integers(0, 256, (6, 100), dtype=np.uint8)
    sketches = base[rng.integers(0, 6, 70)].copy()
    for row in sketches:
        at = rng.choice(100, rng.integers(0, 60), replace=False)
        row[at] = rng.integers(0, 256, len(at))

    def trees(edges):
        root = list(range(70))
        for u, v in edges:
            root = [root[v] if r == root[u] else r for r in root]
        return [root.index(r) for r in root]

    edges = near_duplicates.spanning_links(np.arange(70), sketches)
    every = [(i, j) for i in range(70) for j in range(i) if (sketches[i] == sketches[j]).mean() >= near_duplicates.AGREE]
    assert trees(edges) == trees(every) and len(edges) == 70 - len(set(trees(every)))


def test_near_duplicate_parts(spark):
    """How finely buckets are dealt out changes nothing: one part, and parts of a few members."""
    rows = near_corpus(3, 60)
    hot = "north wind carries small grey birds over the old stone bridge near river mouth at dawn while boats wait for rain and the long road goes on to town".split()
    rows += [(1000 + i, " ".join([*hot[:-1], f"w{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, fine = ({tuple(r[:3]) for r in near_duplicates.link_documents(docs, part=p).select("id", "class_id", "n_links").collect()} for p in (2_000, 7))
    assert whole == fine and {(1000 + i, 1000, 39) for i in range(40)} <= fine
    members = spark.createDataFrame([(0, 5, i, 40) for i in range(40)] + [(1, 5, i, 3) for i in range(3)], "band int, code long, rep long, members long")
    cells = near_duplicates.bucket_cells(members, 7).groupBy("band", "x", "y").agg(F.collect_set("rep").alias("r")).collect()
    assert {frozenset((a, b)) for c in cells if c.band == 0 for a in c.r for b in c.r if a < b} == {frozenset((a, b)) for a in range(40) for b in range(a)}
    assert [(c.x, c.y, sorted(c.r)) for c in cells if c.band == 1] == [(0, 0, [0, 1, 2])]


def test_chat_sizes(spark):
    """A layout is known by its paths whatever the size of its texts; faulty strings are refused at every size."""
    own = chat_format.Mapping("long_name", "OBJECT<%s: ARRAY<OBJECT<content, role>>>" % ("n" * 70), array=("n" * 70, "role", "content"))
    for size in (100, 1_100_000):
        said = ('é \\"q\\": \\\\ ' * size)[:size].rstrip("\\")
        raw = ['{"mess\\u0061ges" : [{"role":"user", "content" : "%s"}]}' % said, '{"%s":[{"role":"user","content":"%s"}]}' % ("n" * 70, said), '{"prompt":"%s\\q","response":"x"}' % said,
               '{"prompt":"%s\n","response":"x"}' % said, '{"prompt":"%s","response":"x}' % said, '{"prompt":"%s","response":null}' % said, '["%s", {"a":"b"}]' % said]
        got = {r.i: r for r in chat_format.to_turns(spark.createDataFrame(list(enumerate(raw)), "i int, r string"), "r", (*chat_format.MAPPINGS, own)).collect()}
        assert [got[i].layout for i in range(7)] == ["messages", "long_name", None, None, None, "prompt_response", None]
        text = json.loads('"%s"' % said)
        assert got[0].turns[0].text == text and got[1].turns[0].text == text and got[5].turns[0].text == text


def test_chat_long_turn(spark):
    text = ('He said "so\n\\ok" é <|x|> & ' * 1_000_000)[:21_000_000]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text)]
    done = chat_format.format_turns(chat_format.to_turns(chat_format.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "record"))
    r = done.select("layout", F.sha2(chat_format.loss_text(F.col("formatted"), F.col("loss_mask")), 256).alias("x"), F.size(chat_format.read_back(F.col("formatted"))).alias("n")).first()
    assert r.layout in ("messages", "from_value", "prompt_response", "instruction_output") and r.n == 2 and r.x == hashlib.sha256(text.encode()).hexdigest()


def test_warc_foreign():
    """Digests of other algorithms, unknown ones, several records in a member, and damage inside one."""
    import base64
    import gzip

    page = lambda i: f"<p>{i}</p>".encode() * 50
    own = [warc.make_record(i, "http://h/", page(i), hashlib.sha256(page(i)).hexdigest(), None, False) for i in range(6)]
    sha1 = [r.replace(b"sha256:" + hashlib.sha256(page(i)).hexdigest().encode(), b"sha1:" + base64.b32encode(hashlib.sha1(page(i)).digest())) for i, r in enumerate(own)]
    ids = lambda s: [x[3]["x-page-id"] if x[0] == "record" else "gap" for x in warc.salvage(s)]
    assert ids(b"".join(sha1[:5])) == list("01234")
    bad = bytearray(sha1[1])
    bad[-30] ^= 1
    assert ids(sha1[0] + bytes(bad) + sha1[2]) == ["0", "gap", "2"]
    assert ids(own[0].replace(b"sha256:", b"other9:")) == ["0"]
    assert ids(gzip.compress(b"".join(own)) + warc.member(own[0])) == [*"012345", "0"]
    torn = bytearray(gzip.compress(b"".join(own)))
    torn[-6] ^= 0xFF
    assert ids(bytes(torn) + warc.member(own[0])) == [*"01234", "gap", "0"]
    long = warc.make_record(9, "u", b"x" * 3_000_000, hashlib.sha256(b"x" * 3_000_000).hexdigest(), None, False)
    assert ids(b"??" + warc.member(long) + long) == ["gap", "9", "9"]


def test_warc_ids_and_long_headers(spark):
    """Ids at both ends of 64 bits, and a url longer than the first look at a header."""
    ids = [2**63 - 1, -(2**63), 10**18 + 5, 10**17, None]
    pages = spark.createDataFrame([(x, "u", "<p>same</p>" * 40) for x in ids] + [(7, "v" * 3_000_000, "<p>long url</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages, shared_dir(spark, "test-warc")).collect()}
    assert set(got) == {*ids, 7} and len(got[7].url) == 3_000_000
    assert all(r.refers_to == (None if r.page_id in (None, 7) else None if r.record_type == "response" else r.refers_to) for r in got.values())
    assert {got[x].refers_to for x in ids if got[x].record_type == "revisit"} <= set(ids)
    long = warc.make_record(9, "w" * 2_500_000, b"x", hashlib.sha256(b"x").hexdigest(), None, False)
    assert [x[3].get("x-page-id") for x in warc.salvage(b"??" + long + warc.member(long))] == [None, "9", "9"]
    assert [x[0] for x in warc.salvage(b"WARC/1.1\r\n" + b"a" * 2_000_000 + b"\r\nno header\r\n" + long)] == ["gap", "record"]


def test_html_formulas():
    """Text of formulas and the text inside an object are content."""
    page = "<article><p>The formula <math><mi>E</mi>=<mi>m</mi></math> holds, <object data='x'>as said</object> here.</p></article>"
    assert [b.text for b in html_extract.blocks(page)] == ["The formula E=m holds, as said here."]


def test_warc_gap_log(spark):
    folder = shared_dir(spark, "test-warc")
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(8)], "page_id long, url string, html string")
    written = warc.write_archives(warc.with_revisits(pages).coalesce(1), folder).collect()
    path = written[0].path.removeprefix("file:").replace("//", "/")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(path, "wb").write(data)
    read = warc.read_archives(spark.createDataFrame([(written[0].path,)], "path string"))
    warc.log_gaps(read, f"{folder}-gaps")
    assert spark.read.parquet(f"{folder}-gaps").count() == 1 and read.where("kind = 'record'").count() == 7


def test_token_cache_kept(spark, odd, tmp_path):
    """With the setting, a second run of the query finds every count and encodes nothing."""
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set(token_counts.CACHE_SETTING, f"{tmp_path}/cache")
    try:
        first = sorted(map(str, token_counts._query(spark, str(tmp_path)).collect()))
        size = token_counts.stored(spark, f"{tmp_path}/cache").count()
        assert sorted(map(str, token_counts._query(spark, str(tmp_path)).collect())) == first
        assert token_counts.stored(spark, f"{tmp_path}/cache").count() == size
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)


def test_mixing_reach(spark):
    """Targets within reach are met; those that no weights meet end the raking, or are an error if asked for."""
    docs = spark.createDataFrame([(1, "a b c", "en", "s"), (2, "d e f", "de", "t"), (3, "g", "en", "t")], "doc_id long, text string, lang string, source string")
    goal = lambda d, x: spark.createDataFrame(list(x.items()), f"{d} string, share double")
    met = {"source": goal("source", {"s": 0.3, "t": 0.7}), "lang": goal("lang", {"en": 0.6, "de": 0.4}), "topic": goal("topic", {"prose": 1.0})}
    raked, goals = mixing.raked_cells(docs, targets=met)
    assert all(abs(r.share - r.achieved) < 1e-8 for r in mixing.achieved_margins(raked, goals).collect())
    far = met | {"lang": goal("lang", {"en": 0.1, "de": 0.9})}
    assert mixing.rate_documents(docs, targets=far).count() == 3
    with pytest.raises(ValueError):
        mixing.rate_documents(docs, targets=far, strict=True)


def test_network_brute():
    """Lookups by pairs against plain convolution; gradients against differences."""
    import numpy as np

    rng = np.random.default_rng(3)
    model = language_id.train(["la le lo " * 30, "ksch tz " * 30] * 8, ["aa", "bb"] * 8, epochs=1)
    x = rng.integers(0, 256, (5, language_id.WINDOW), dtype=np.uint8)
    plain = []
    for places in model.tables:
        conv = np.stack([sum(places[k][x[:, i + k]] for k in range(len(places))) for i in range(x.shape[1] - len(places) + 1)], axis=1)
        plain.append(conv.max(axis=1))
    plain = np.maximum(np.concatenate(plain, axis=1) + model.bias, 0)
    assert np.allclose(model.pooled(x), plain, atol=1e-4) and np.allclose(language_id._Fast(model).pooled(x), plain, atol=1e-4)
    y = np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.log(model.probabilities(x)[np.arange(5), y]).mean()
    # differences in double precision
    model.tables = [[t.astype(np.float64) for t in places] for places in model.tables]
    model.bias, model.dense, model.last = (p.astype(np.float64) for p in (model.bias, model.dense, model.last))
    params = [t for places in model.tables for t in places] + [model.bias, model.dense, model.last]
    for p, g in zip(params, language_id._gradients(model, x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_html_held_out_layouts():
    """Openings of parts that training never saw."""
    odd_ones = {k: v[1::2] for k, v in html_extract.LAYOUTS.items()}
    chain = html_extract.trained(layouts={k: v[::2] for k, v in html_extract.LAYOUTS.items()})
    rng, n, good = random.Random(78), 0, 0
    for _ in range(200):
        page, labels = html_extract.labelled_page(rng, odd_ones)
        got = chain.decode([chain.emit(b, {}) for b in html_extract.blocks(page)])
        n, good = n + len(labels), good + sum(a == b for a, b in zip(got, labels))
    print("held-out layouts", good / n)
    assert good / n > 0.8
