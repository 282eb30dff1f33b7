"""Tokenizer, packing, sentences, markup and reading level."""

import math
import os
import random

import numpy as np
import pytest

from corpusloom.llm import markup, pack_containers, reading_level, sentences, tokenize_corpus

VOCABULARY = tokenize_corpus.default_vocabulary()
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file here")
DOCS = "doc_id bigint, text string, lang string, is_flow boolean, ids string, tokens string, key string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", True, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " ", "\n\n", "Hello world", "<|endoftext|> </s> it's", "a" * 3000, "ab" * 1500, "日本語のテキスト。" * 40, "สวัสดีครับ", "🏳️‍🌈👩🏽‍🔧 ok", "\x00\x07 tab\t", "  two  spaces \n\n x", "Ünïcödé 12345 !!??", "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(2500))]


@needs_vocabulary
def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    alphabet = "abc ABC.,'012\n\t éüßжщ日本語ไทยक्षि🙂"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    real = Tokenizer.from_file(VOCABULARY)
    real.encode_special_tokens = True
    got = {r["doc_id"]: r["ids"] for r in tokenize_corpus.encode_texts(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == real.encode(t or "", add_special_tokens=False).ids, repr(t)[:80]
    assert tokenize_corpus.encode_texts(docs(spark, ["x"]).limit(0)).count() == 0


def test_plan_uses_every_item_once():
    rng = random.Random(5)
    for capacity, n in ((2048, 4000), (100, 500), (10, 50), (7, 0)):
        sizes = [min(capacity, 1 + int(rng.expovariate(1 / (capacity / 4)))) for _ in range(n)]
        histogram = {s: sizes.count(s) for s in set(sizes)}
        made = pack_containers.plan(histogram, capacity)
        assert all(sum(p) <= capacity and k > 0 for p, k in made)
        used = {}
        for p, k in made:
            for s in p:
                used[s] = used.get(s, 0) + k
        assert used == histogram
        if n > 400:
            assert sum(k for _, k in made) <= math.ceil(1.01 * math.ceil(sum(sizes) / capacity))
    assert pack_containers.plan({5: 3}, 10) and pack_containers.plan({}, 10) == []


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary file here")
def test_pack(spark):
    rng = random.Random(6)
    texts = [None, "", *[" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(1, 60))) for _ in range(200)], "word " * 200]
    rows = docs(spark, texts)
    sizes = {r["key"]: r["tokens"] for r in pack_containers.token_counts(rows, "doc_id", "text").collect()}
    got = pack_containers.pack(rows, capacity=50).collect()
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_container.setdefault(r["container_id"], []).append(r)
    assert set(by_doc) == {i for i, n in sizes.items() if n > 0}
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["piece"])
        assert sum(r["tokens"] for r in parts) == sizes[i] and len(parts) == -(-sizes[i] // 50) and [r["start_token"] for r in parts] == [50 * k for k in range(len(parts))]
    assert all(sum(r["tokens"] for r in c) <= 50 and sorted(r["slot"] for r in c) == list(range(len(c))) for c in by_container.values())
    assert len(by_container) <= math.ceil(sum(sizes.values()) / 50) + 3 and set(by_container) == set(range(len(by_container)))
    assert pack_containers.pack(rows.limit(0)).count() == 0 and pack_containers.pack(docs(spark, [None, ""])).count() == 0


SENTENCES = [
    ("One here. Two there! Three? Four", ["One here.", "Two there!", "Three?", "Four"]),
    ("Dr. Who met Mr. Ro at 4 p.m. on Monday. It was 3.5 km.", ["Dr. Who met Mr. Ro at 4 p.m. on Monday.", "It was 3.5 km."]),
    ("They left at 6 p.m. Then it rained.", ["They left at 6 p.m.", "Then it rained."]),
    ("We need ropes, lamps, etc. for it. See No. 5 of it, e.g. this.", ["We need ropes, lamps, etc. for it.", "See No. 5 of it, e.g. this."]),
    ("“Stop! It is hot,” said Ann. He said: “It is.” Then all went.", ["“Stop! It is hot,” said Ann.", "He said: “It is.”", "Then all went."]),
    ("\"Is it full?\" asked Jo. Yes.", ["\"Is it full?\" asked Jo.", "Yes."]),
    ("It was new... and then it broke. Well… Fine.", ["It was new... and then it broke.", "Well…", "Fine."]),
    ("No stop\n\nNext one\nwraps. End", ["No stop", "Next one\nwraps.", "End"]),
    ("“停下！很旧。”他说。版本2.3运行……大概吧。为什么？", ["“停下！很旧。”他说。", "版本2.3运行……大概吧。", "为什么？"]),
    ("主管问：“在哪里？在这吗？”请看图1.3。", ["主管问：“在哪里？在这吗？”", "请看图1.3。"]),
    ("「止まれ！赤い。」と言いました。次です。", ["「止まれ！赤い。」と言いました。", "次です。"]),
    ("यह है। डॉ. राम कि. ग्रा. देखें।", ["यह है।", "डॉ. राम कि. ग्रा. देखें।"]),
    ("«أين هو؟» سأل علي. قال د. عمر نعم.", ["«أين هو؟» سأل علي.", "قال د. عمر نعم."]),
    ("ผมไป3.5กม. เขามา ดร.สม", ["ผมไป3.5กม.", "เขามา", "ดร.สม"]),
    ("Das gilt ab der 3. Fassung. Am 9. März kam er, z. B. heute.", ["Das gilt ab der 3. Fassung.", "Am 9. März kam er, z. B. heute."]),
    ("«Стой!», — сказал г. Ким. Весит 2 кг, т. е. мало.", ["«Стой!», — сказал г. Ким.", "Весит 2 кг, т. е. мало."]),
    ("« Stop ! Non », dit le Dr. Roy. Oui !", ["« Stop ! Non », dit le Dr. Roy.", "Oui !"]),
    ("An \"open quote stays. Another one.", ["An \"open quote stays.", "Another one."]),
]


def test_sentences(spark):
    texts = [t for t, _ in SENTENCES] + [None, "", " \n ", "x" * 70_000]
    got = {}
    for r in sentences.sentences(docs(spark, texts)).collect():
        got.setdefault(r["doc_id"], []).append((r["sentence"], r["start_offset"], r["end_offset"], r["text"]))
    for i, (text, want) in enumerate(SENTENCES):
        units = sorted(got[i])
        assert [u[3] for u in units] == want
        assert all(text[a:b] == s for _, a, b, s in units)
    assert set(got) == {*range(len(SENTENCES)), len(texts) - 1}
    assert sentences.sentences(docs(spark, ["x"]).limit(0)).count() == 0


def test_scan_equals_a_plain_run():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        stream = rng.integers(0, 10, n).astype(np.uint8)
        state, want = sentences.START, []
        for i, s in enumerate(stream.tolist()):
            if sentences.EMIT[state, s]:
                want.append(i)
            state = int(sentences.TO[state, s])
        assert sentences.scan(stream).tolist() == want


def test_batching_changes_nothing():
    texts = [t for t, _ in SENTENCES]
    assert sentences.sentence_ends(texts) == [sentences.sentence_ends([t])[0] for t in texts]


def test_long_texts_go_in_sections(monkeypatch):
    text = "One two. Three four!\n\n\n  Five. Six" * 40
    whole = sentences.sentence_ends([text])[0]
    monkeypatch.setattr(sentences, "SECTION", 50)
    assert sentences.sentence_ends([text, "Go on. B", None]) == [whole, [6, 8], []]


@needs_vocabulary
def test_long_texts_are_encoded_in_runs(monkeypatch):
    encoder = tokenize_corpus.encoder(VOCABULARY)
    texts = ["short one", "a longer text, with words " * 9, None]
    want = encoder.encode(texts)
    monkeypatch.setattr(tokenize_corpus, "SLICE_CHARS", 20)
    monkeypatch.setattr(tokenize_corpus, "CACHE_WORDS", 2)
    assert encoder.encode(texts) == want


MARKED = [
    ("# Title\n\nText with **bold** and `code`.", ["markdown"], "# Title\n\nText with bold and code."),
    ("Head\n====\n\n- a **b**\n- c", ["markdown"], "# Head\n\n- a b\n- c"),
    ("| a | b |\n| --- | --- |\n| 1 | 2 |", ["markdown"], "a | b\n1 | 2"),
    ("```\n<b> $x$ [[y]]\n```", ["markdown"], "```\n<b> $x$ [[y]]\n```"),
    ("<p>One &amp; <a href='x'>two</a></p><ul><li>three</li></ul>", ["html"], "One & two\n\n- three"),
    ("<!-- note -->\nText here.", ["html"], "Text here."),
    ("== Heading ==\nA [[link|label]] and '''bold''' {{note|x}}.", ["wiki"], "## Heading\n\nA label and bold ."),
    ("{| class=x\n|-\n! A !! B\n|-\n| 1 || 2\n|}", ["wiki"], "A | B\n1 | 2"),
    ("\\section{One}\nText \\textbf{bold} $x^2$.\n\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"], "## One\n\nText bold $x^2$.\n\n- a"),
    ("\\begin{equation}\nx = \\frac{a}{b} \\label{eq:1}\n\\end{equation}", ["latex"], "$x = \\frac{a}{b}$"),
    ("\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", ["latex"], "```\n**x** <b>\n```"),
]
PLAIN = ["Paid $5 to $9 for a < b and c > d.", "[Page 3]\n\n--- Page 4 ---\n\n1.2 Title", "Intro ........ 5\n42 | Footer\n| text", "Copy C:\\data\\new\\plan_8 to it.", "<|endoftext|> </s><s> x", "unit_of_6 is null [84]; 3 * 4 * 5; R&D ~5", "Rank #3 of the C# team -> 4 >> 2", "With p<0.05; x^2 is 6; {3, 4}", "- plain item\n- another", "", " "]


def test_markup(spark):
    rows = docs(spark, [t for t, _, _ in MARKED] + PLAIN + [None])
    got = {r["doc_id"]: r for r in markup.clean(rows).collect()}
    for i, (text, found, clean) in enumerate(MARKED):
        assert (got[i]["markups"], got[i]["clean_text"]) == (found, clean), text
    for i, text in enumerate(PLAIN, len(MARKED)):
        assert (got[i]["markups"], got[i]["clean_text"]) == ([], text)
    assert got[len(MARKED) + len(PLAIN)]["clean_text"] is None
    assert markup.clean(rows.limit(0)).count() == 0


def test_smallest_marks_are_read():
    cases = {
        "The _quick_ fox.": "markdown", "$$\nE = mc^2\n$$": "latex", "$x_1 =\n y$": "latex", " # Title": "markdown", "  > said": "markdown", "Head\n=": "markdown", "Head\n   ---": "markdown", "a __b__": "markdown",
        "a *b*": "markdown", "~~b~~": "markdown", "`b`": "markdown", "a | b\n--|--\n---|---": "markdown", "[a](b)": "markdown", "- [x] a": "markdown", "[^1]: a": "markdown", "~~~\na\n~~~": "markdown",
        "<b>": "html", "&amp;": "html", "&#65;": "html", "\\item": "latex", "\\(x\\)": "latex", "== a ==": "wiki", "[[a]]": "wiki", "{{a}}": "wiki", "''a''": "wiki", "{|\n|}": "wiki",
    }
    for text, found in cases.items():
        assert markup.convert(text)[1] == [found], text


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_chunks_are_cleaned_too(spark):
    from corpusloom.llm import catalogue

    rows = catalogue.queries()["p3_chunk_clean"](spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/chunks.parquet").count()
    assert rows.where("markups != ''").count() > 0


def test_long_and_nested_marks():
    long = "word " * 300 + "end"
    for opening, closing, found in (("**", "**", "markdown"), ("*", "*", "markdown"), ("_", "_", "markdown"), ("__", "__", "markdown"), ("~~", "~~", "markdown"), ("`", "`", "markdown"), ("''", "''", "wiki")):
        assert markup.convert(f"The {opening}{long}{closing} of it.")[:2] == (f"The {long} of it.", [found]), opening
    assert markup.convert(f"[{long}](x)")[1] == ["markdown"] and markup.convert(f"[[a|{long}]]")[1] == ["wiki"]
    assert markup.convert("A {{box|" + long + "|{{b|{{c}}}}}} z {{open")[:2] == ("A  z {{open", ["wiki"])
    assert markup.convert("$x = " + "y + " * 200 + "z$")[1] == ["latex"]
    assert markup.convert("\\textbf{" * 9 + "deep" + "}" * 9)[:2] == ("deep", ["latex"])


def test_block_rules():
    links = "\x03Home\x04 \x03About\x04 \x03Jobs\x04 \x03Contact\x04"
    long = "This is the text that we have for all of you and it is not a list of the links. " * 4
    blocks = [("heading1", "Menu"), ("paragraph", links), ("paragraph", "Zap"), ("paragraph", links), ("heading1", "News"), ("paragraph", long), ("paragraph", "Zap"), ("paragraph", long), ("code", "x")]
    assert markup.judge(blocks) == [False, False, False, False, True, True, True, True, True]


def test_reading_level(spark):
    easy, hard = "The cat is on the mat. We see a dog. ", "Notwithstanding interdisciplinary considerations, characterisation presupposes instrumentation. "
    refs = [("en", 1, easy * 5), ("en", 3, hard * 5), ("de", 1, "Die Katze ist da. Wir sehen den Hund. " * 5), ("de", 3, "Ungeachtet der Zuständigkeitsabgrenzung ist die Beurteilung anzusehen. " * 5)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(refs)], "ref_id int, lang string, level int, text string")
    model = reading_level.train(table)
    rows = spark.createDataFrame([(1, "We see the cat.", "EN", True), (2, "Interdisciplinary characterisation.", "en-x", True), (3, "Wir sehen die Katze und den Hund.", None, True), (4, None, "en", True), (5, "123 !", "en", True), (6, "кот и пёс", "ru", True)], "doc_id int, text string, lang string, is_flow boolean")
    got = {r["doc_id"]: (r["level_lang"], r["level"]) for r in reading_level.reading_levels(rows, model).collect()}
    assert got == {1: ("en", 1), 2: ("en", 3), 3: ("de", 1), 4: (None, None), 5: (None, None), 6: (None, 1)}
    assert reading_level.reading_levels(rows.limit(0), model).count() == 0


GRADED = "/root/testdata/sf0.001/graded_texts.parquet"


@pytest.mark.skipif(not os.path.exists(GRADED), reason="no test data here")
def test_held_out_accuracy():
    import pyarrow.parquet as pq

    rows = [(r["lang"], r["level"], r["text"]) for r in pq.read_table(GRADED).to_pylist()]
    right = 0
    for fold in range(4):
        model = reading_level.LevelModel([r for i, r in enumerate(rows) if i % 4 != fold])
        right += sum(model.judge(t, None)[:2] == (lang, level) for i, (lang, level, t) in enumerate(rows) if i % 4 == fold)
    assert right / len(rows) >= 0.95


def test_two_passes_drop_boilerplate():
    prose = "The pump in the hall has to be cleaned by the crew before it is started again, and that is the rule for all of the shifts in this plant."
    links = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/p'>Products</a></li></ul></nav>"
    page = f"{links}<p>Search</p><ul><li><a href='/x'>Imprint</a></li></ul><h2>Care of pumps</h2><p>{prose}</p><p>Done.</p><p>{prose}</p><div><a href='/a'>Previous</a> | <a href='/b'>Next</a></div><p>Share</p><div><a href='/f'>Follow our page</a></div>"
    text, found, kept, dropped = markup.convert(page)
    assert text == f"## Care of pumps\n\n{prose}\n\nDone.\n\n{prose}" and found == ["html"] and (kept, dropped) == (4, 7)
    text, found, kept, dropped = markup.convert(f"[Home](/) | [About](/about)\n\nMenu\n\n[Login](/in)\n\n# Title\n\n{prose}\n\nSee [the manual](/m) for it.")
    assert text == f"# Title\n\n{prose}\n\nSee the manual for it." and dropped == 3
    blocks = [("paragraph", prose), ("paragraph", "Share"), ("paragraph", prose)]
    assert markup.judge(blocks) == [True, True, True]  # the same short block between two of prose stays
    link = ("paragraph", "\x03Follow our page\x04")
    assert markup.judge([link, ("paragraph", "Share"), link]) == [False, False, False]
    assert markup.judge([link, ("heading2", "More"), link, ("heading2", "Care"), blocks[0]]) == [False, False, False, True, True]


def test_marks_in_any_case_and_unclosed_ones():
    assert [x.strip() for x in markup.convert("a <PRE>x\ny</Pre> b")[0].split("\n\n")] == ["a", "```\nx\ny\n```", "b"]
    import time

    began = time.time()
    for opening in ("<!-- ", "<script> ", "<pre> ", "<a> ", "\\begin{verbatim} ", "\\( ", "\\[ ", "''a ", "<h1> ", "{| ", "**a "):
        markup.convert(opening * 40_000)
    assert time.time() - began < 20


def test_the_fit_saves_containers(monkeypatch):
    """Equal numbers of lengths 5, 4 and 3 fill containers of 12 without a gap; largest first would pair the fives."""
    histogram = {5: 600, 4: 600, 3: 600}
    fitted = sum(n for _, n in pack_containers.plan(histogram, 12))
    monkeypatch.setattr(pack_containers, "SWEEPS", 0)
    greedy = sum(n for _, n in pack_containers.plan(histogram, 12))
    assert fitted <= 605 and greedy >= 650


@needs_vocabulary
def test_decoding_is_the_inverse(spark):
    texts = ["Plain words, 12.5 %", "", None, "naïve 日本語 ไทย हिन्दी 😀\x00\t\n", "<|endoftext|> </s>", " " * 7, "a" * 300]
    rows = docs(spark, texts)
    coded = tokenize_corpus.encode_texts(rows)
    got = {r["doc_id"]: r["text"] for r in tokenize_corpus.decode_ids(coded).collect()}
    assert [got[i] for i in range(len(texts))] == [t or "" for t in texts]
    odd = spark.createDataFrame([(1, None), (2, []), (3, [70000]), (4, [262])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokenize_corpus.decode_ids(odd).collect()} == {1: None, 2: "", 3: None, 4: " the"}
    assert tokenize_corpus.decode_ids(odd.limit(0)).count() == 0
