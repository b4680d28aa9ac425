"""The training-data operators on small rows: brute force, round trips, nulls, ties, repeats."""

import random

import numpy as np
import pytest
from corpusgauge.llm import languages as lang
from corpusgauge.llm import leakage, lookalikes, markup, near_duplicates, personal, sentences, splitting, templates, tokenization
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

ITEMS = "item_type string, item_id string, content string, headings array<string>, piece string"


def items(spark, *texts):
    return spark.createDataFrame([("document", f"d{i}", t, ["H"] if t else None, "clash") for i, t in enumerate(texts)], ITEMS)


# 1 splitting


@pytest.mark.parametrize("text", ["word " * 3000, " " * 9000, "\n" * 4500, "x" * 9000, "。".join("字" * 30 for _ in range(200)), "# A\n\n" + "One sentence here. " * 500, ("a " * 40 + "\n\n") * 60])
@pytest.mark.parametrize("overlap", [0, 30])
def test_pieces_keep_the_limits(text, overlap):
    pieces = splitting.split_text(text, 500, 4000, overlap)
    assert len(pieces) > 1 and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, n, _), (c, _, _, _) in zip(pieces, pieces[1:]):
        assert c <= b and n <= 500 and b - a <= 4000
    for a, b, n, _ in pieces:
        assert b - a <= 4000 and splitting.count_tokens(text[a:b]) <= 500


def test_cuts_inside_a_token_overlap_in_characters():
    pieces = splitting.split_text("x" * 9000, 500, 4000, 30)
    assert all(b - c == 30 for (_, b, _, _), (c, _, _, _) in zip(pieces, pieces[1:]))
    with pytest.raises(ValueError):
        splitting.split_text("word " * 200, 3, 1, 0)


def test_split_prefers_paragraphs(spark):
    para = "Some words of one paragraph stand here together. " * 20
    pieces = splitting.split_text("\n\n".join([para] * 10), 500, 4000, 30)
    assert {k for *_, k in pieces[:-1]} == {"paragraph"}
    got = splitting.split_oversized(items(spark, None, "", "short", "w " * 501, "w " * 500)).collect()
    assert {r.item_id for r in got} == {"d3"} and all(r.headings == ["H"] for r in got)


# 2 personal data


def test_personal_data(spark):
    text = "Please contact Ruth L. Quinik at ruth_q+x (at) some-desk (dot) example or +1 (402) 555-0186. Passport no. X00700894 was scanned."
    got = {(r.pii_type, r.value) for r in personal.find_personal(items(spark, text, text, None, "", "Batch 4221-77117-024 weighs 3 kg.")).where("item_id = 'd0'").collect()}
    assert got == {("name", "Ruth L. Quinik"), ("email", "ruth_q+x (at) some-desk (dot) example"), ("phone", "+1 (402) 555-0186"), ("id_number", "X00700894")}
    rows = {r.item_id: r for r in personal.redact(items(spark, text, None, "", "Batch 4221-77117-024 weighs 3 kg.")).collect()}
    assert rows["d0"].redacted.startswith("Please contact [NAME] at [EMAIL] or [PHONE]. Passport no. [ID_NUMBER]") and rows["d0"].replaced == 4
    assert rows["d1"].redacted is None and rows["d2"].redacted == "" and rows["d3"].replaced == 0


def test_personal_data_in_changed_characters():
    finder = personal.Finder(personal.models())
    text = "Tel: ０２０ ７９４６ ０８８１ and Owen Qui​nley asked why. Approved by Dr. Ruth Brel’s."
    spans = finder.find_batch([text])[0]
    assert ("phone", "０２０ ７９４６ ０８８１") in {(k, text[a:b]) for k, a, b in spans}


def test_held_out_f1():
    for kind, model in personal.models().items():
        assert model.f1 > (0.85 if kind == "name" else 0.9), kind  # invented given names without any cue are counted as lost


# 3 look-alikes


def test_consistent_form():
    r = lookalikes.Restorer({})
    same = ["Café of the owner's file 12", "Café of the owner's file 12", "Café of the оwnеr's file 12", "Ca­fé of​ the owner's ﬁle 12", "Café of the owner's file １２", "Café　of the owner's ｆｉｌｅ 12"]
    assert len({r.consistent(t) for t in same}) == 1
    different = ["Cafe", "Café", "café", "Café.", "Caf²", "“Café”", '"Café"', "Café…", "Café...", "Cafe–", "Cafe-"]
    assert len({r.consistent(t) for t in different}) == len(different)
    assert r.consistent(None) is None and r.consistent("") == "" and r.consistent("👩🏽‍💻") == "👩🏽‍💻"
    assert r.consistent("привет пpивет") == "привет привет"


def test_same_visible_text(spark):
    rows = [("a", "one text"), ("b", "оne text"), ("c", "one text"), ("c", "one text"), ("d", "One text"), ("e", None), ("f", ""), ("g", "one​ text")]
    got = {tuple(r) for r in lookalikes.same_visible_text(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got == {("a", "b"), ("b", "c"), ("a", "g"), ("b", "g"), ("c", "g")}
    many = [(f"x{i:02d}", "one text" if i % 2 else "оne text") for i in range(20)]
    df = spark.createDataFrame(many, "id string, content string")
    assert lookalikes.same_visible_text(df, copies=3).count() == lookalikes.same_visible_text(df).count() == 100


# 4 languages

SAMPLES = {
    "en": "The quick report about the house was written by the people who live there. ",
    "de": "Der schnelle Bericht über das Haus wurde von den Leuten geschrieben, die dort wohnen. ",
    "fr": "Le rapport rapide sur la maison a été écrit par les gens qui y habitent. ",
    "ja": "この家についての報告は、そこに住んでいる人々によって書かれました。",
}


def model():
    return lang.Model({k: lang.count_ngrams([v * 20]) for k, v in SAMPLES.items()})


def test_languages(spark):
    rows = [
        ("right", "en-US", SAMPLES["en"] * 5), ("wrong", "French", SAMPLES["de"] * 5), ("none", None, SAMPLES["fr"] * 5), ("odd", "n/a", SAMPLES["ja"] * 5),
        ("mixed", "en", SAMPLES["en"] * 5 + "\n\n" + SAMPLES["de"] * 5), ("code", "en", SAMPLES["en"] * 5 + "\n```\nder die das und von den Leuten\n```\n"), ("null", None, None), ("empty", None, ""), ("empty", None, ""),
    ]
    got = {tuple(r) for r in lang.mislabelled(spark.createDataFrame(rows, "id string, language string, content string"), model()).collect()}
    assert got == {("wrong", "de"), ("none", "fr"), ("odd", "ja"), ("mixed", "en"), ("mixed", "de")}
    seg = lang.document_segments(spark.createDataFrame(rows, "id string, language string, content string"), model()).where("document_id = 'mixed'").orderBy("segment").collect()
    assert [s.language for s in seg] == ["en", "de"] and all(0 < s.confidence <= 1 for s in seg)


def test_labels():
    assert [lang.language_code(x) for x in ("EN", "en_GB", "zh-Hans", "German", "deu", "und", "", None, "xx")] == ["en", "en", "zh", "de", "de", None, None, None, None]
    assert [lang.language_code(x) for x in ("pt-BR", "Russian", "nl", "KO", "n/a", "unknown")] == ["pt", "ru", "nl", "ko", None, None]


VOCABULARY = {
    "en": "the house was built by people who live there with their children and every morning they walk through town before work",
    "es": "la casa fue construida por las personas que viven allí con sus hijos y cada mañana caminan por el pueblo antes del trabajo",
    "nl": "het huis werd gebouwd door mensen die daar wonen met hun kinderen en elke ochtend lopen zij door de stad voor het werk begint",
}
PORTUGUESE = "não há então questões sobre as reuniões porque os cidadãos já têm informações à disposição nas eleições e também às vezes não vêm"


def test_languages_are_those_of_the_labelled_rows(spark):
    rng = random.Random(2)
    speak = lambda words, n=40: " ".join(rng.choices(words.split(), k=n)).capitalize() + "."
    labelled = [(f"{c}{i}", speak(v), c) for c, v in VOCABULARY.items() for i in range(80)] + [("none", None, "en"), ("nolabel", speak(VOCABULARY["en"]), None)]
    model = lang.fit(spark.createDataFrame(labelled, "k string, t string, l string"), "k", "t", "l")
    assert model.languages == ["en", "es", "nl"] and set(model.usual) == set(model.languages)
    rows = [
        ("dutch", "en", speak(VOCABULARY["nl"], 120)), ("right", "nl", speak(VOCABULARY["nl"], 120)), ("portuguese", "pt", speak(PORTUGUESE, 120)),
        ("wrong", "pt", speak(VOCABULARY["en"], 120)), ("greek", "el", "Το σπίτι χτίστηκε από ανθρώπους που ζουν εκεί. " * 5),
    ]
    got = {tuple(r) for r in lang.mislabelled(spark.createDataFrame(rows, "id string, language string, content string"), model).collect()}
    assert got == {("dutch", "nl"), ("wrong", "en")}


def test_no_labelled_rows(spark):
    empty = spark.createDataFrame([], "k string, t string, l string")
    assert lang.mislabelled(spark.createDataFrame([("a", None, "text of some kind here")], "id string, language string, content string"), lang.fit(empty, "k", "t", "l")).count() == 0


# 5 near duplicates


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(60)]
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 8):
            other = list(base)
            for _ in range(changes):
                other[rng.randrange(60)] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    texts += [texts[0], texts[0], None, "", "short"]
    rows = [(f"c{i:03d}", t, "clash") for i, t in enumerate(texts)] + [("c000", texts[0], "clash")]
    df = spark.createDataFrame(rows, "id string, normalized_content string, class_id string")
    got = {(r.chunk_id_a, r.chunk_id_b) for r in near_duplicates.similar_chunks(df).collect()}
    kept = [(f"c{i:03d}", t) for i, t in enumerate(texts) if t and len(t) >= 150]
    parts = {a: {x[k : k + 9] for k in range(len(x) - 8)} for a, x in kept}
    want = {(a, b) for i, (a, _) in enumerate(kept) for b, _ in kept[i + 1 :] if len(parts[a] & parts[b]) >= 0.7 * len(parts[a] | parts[b])}
    assert got == want and len(want) > 40
    assert near_duplicates.similar_chunks(df.limit(0)).count() == 0


def test_groups(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [("a", base), ("b", base + " more"), ("c", base), ("d", "lone " * 40 + "text"), ("e", "twin " * 41), ("f", "twin " * 41), ("g", None)]
    got = {r.chunk_id: r for r in near_duplicates.groups(spark.createDataFrame(rows, "id string, normalized_content string")).collect()}
    assert set(got) == {"a", "b", "c", "e", "f"}
    assert got["a"].group_id == got["b"].group_id == got["c"].group_id != got["e"].group_id == got["f"].group_id
    assert (got["a"].links, got["e"].links, got["e"].similarity) == (1, 0, 1.0) and 0.7 <= got["b"].similarity < 1


def test_sketch_never_overstates():
    signer = near_duplicates.Signer()
    a, b = "the same beginning " * 12 + "end one", "the same beginning " * 12 + "finish two"
    _, sketch, _ = signer.sign([a, b])
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in sketch)
    sets = [set(near_duplicates.substring_hashes(t).tolist()) for t in (a, b)]
    assert np.bitwise_count(x ^ y).sum() <= len(sets[0] ^ sets[1])


def test_tiles_meet_every_pair(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"c{i:02d}", " ".join([*base, f"tail{i:02d}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, normalized_content string")
    assert near_duplicates.candidate_pairs(df, tile=7).count() == 40 * 39 // 2


def test_texts_of_one_number_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "_number", lambda text: F.lit(7).cast("bigint"))
    base = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([("a", base), ("b", base + " more"), ("c", "other " * 40 + "text"), ("d", base)], "id string, normalized_content string")
    assert {(r.chunk_id_a, r.chunk_id_b) for r in near_duplicates.similar_chunks(df).collect()} == {("a", "b"), ("a", "d"), ("b", "d")}


def test_copies_are_paired_in_parts(spark):
    rows = [(f"c{i:02d}", "hot" if i < 20 else f"lone{i}") for i in range(25)]
    got = near_duplicates.equal_chunks(spark.createDataFrame(rows, "chunk_id string, class_id string"), copies=3).collect()
    assert len(got) == len(set(got)) == 190 and {r.x for r in got} | {r.y for r in got} == {f"c{i:02d}" for i in range(20)}


# 6 markup


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("# Head\n\nText with **bold**.\n\n- a\n- b\n\n```\n<b>x</b>\n```\n", {("markdown", "heading"), ("markdown", "inline"), ("markdown", "list"), ("markdown", "code")}),
        ("<h1>A</h1><p>b &amp; c</p><ul><li>x</ul><pre>y</pre><table><tr><td>1</td></tr></table>", {("html", "heading"), ("html", "inline"), ("html", "list"), ("html", "code"), ("html", "table")}),
        ("== Head ==\n\n# one\n# two\n\n{| class=\"w\"\n|-\n| a || b\n|}\n\n<math>x^2</math> [[a|b]]", {("wiki", "heading"), ("wiki", "list"), ("wiki", "table"), ("wiki", "formula"), ("wiki", "inline")}),
        ("\\section{A}\n\\begin{itemize}\n\\item x\n\\end{itemize}\n$x^2 + y$ and \\textbf{b}", {("latex", "heading"), ("latex", "list"), ("latex", "formula"), ("latex", "inline")}),
        ("It costs $5 or $6 if x < 3 and y > 4, see [12], R&D, a_b_c, 2 * 3 * 4, [EMAIL] or <PHONE> and ===== X =====.", set()),
        ("", set()),
    ],
)
def test_markup_kinds(text, kinds):
    assert set(markup.markup_kinds(text)) == kinds


def test_clean_text(spark):
    assert markup.clean_text("<h2>A</h2><p>b &amp; <b>c</b></p><ul><li>x<li>y</ul>").split("\n") == ["## A", "", "b & c", "", "- x", "- y"]
    assert markup.clean_text("== A ==\n\n[[x|y]] '''z''' {{t}}") == "== A ==\n\ny z".replace("== A ==", "## A")
    assert markup.clean_text("\\section{A}\n\\textbf{b} \\cite{c} 5\\%") == "# A\nb  5%"
    assert markup.clean_text(None) is None and markup.clean_text("") == ""
    rows = spark.createDataFrame([("a", "# x"), ("a", "# x"), ("b", None)], "id string, content string")
    assert markup.found_markup(rows).count() == 1 and markup.cleaned(rows).count() == 3


def test_long_lines_are_quick():
    markup.markup_kinds("x" * 200_000 + "\n-\n" + "a | b " * 5000 + "`" * 50)


PAGE = "<html><nav>Home News</nav><h1>{0}</h1><ul>{1}</ul><footer>All rights kept</footer></html>"
SOURCED = "id string, source struct<source_id:string>, content string, host string"


def test_templates(spark):
    rows = [(f"p{i}", ("s",), PAGE.format(f"title{i} here{i}", "".join(f"<li>item{i}x{k}</li>" for k in range(1 + i % 3))), "clash") for i in range(6)]
    rows += [rows[0], ("null", ("s",), None, None), ("empty", ("s",), "", None), ("other", ("t",), "alone on its host", None)]
    df = spark.createDataFrame(rows, SOURCED)
    got = templates.templates(df).collect()
    frame = next(r for r in got if "<nav>" in r.tokens)
    inner = next(r for r in got if "<li>" in r.tokens)
    assert frame.tokens == ["<html>", "<nav>", "Home", "News", "</nav>", "<h1>", "</h1>", "<ul>", "</ul>", "<footer>", "All", "rights", "kept", "</footer>", "</html>"]
    assert frame.support == 6 and frame.parent is None
    assert inner.tokens == ["<li>", "</li>"] and inner.parent == frame.class_id and frame.tokens[inner.gap] == "</ul>"
    found = {(r.page, r.content) for r in templates.slots(df, templates.templates(df)).collect()}
    assert found == {(f"p{i}", t) for i in range(6) for t in [f"title{i} here{i}", *(f"item{i}x{k}" for k in range(1 + i % 3))]}
    assert templates.templates(df.limit(0)).count() == 0


def test_a_class_out_of_order_is_no_template(spark):
    rows = [(f"p{i}", ("s",), ("alpha one{0} beta" if i % 2 else "beta one{0} alpha").format(i), None) for i in range(6)]
    assert templates.templates(spark.createDataFrame(rows, SOURCED)).count() == 0


# 7 tokenization

TOKENIZERS = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = TOKENIZERS.Tokenizer.from_file(tokenization.default_vocabulary())
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_ids_equal_the_library(reference, texts):
    assert tokenization.encoder().encode_batch(texts) == [reference.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_hard_texts(spark, reference):
    texts = ["aaaaaaaaaaaaaaa aaaa", "<|endoftext|>", "  \n\n \t x", "安全第一安全第一" * 30, "ｆｕｌｌ ﬁ Å", "=" * 300, "don't've'll", None, ""]
    rows = {r.doc_id: r.ids for r in tokenization.encode(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == reference.encode(t or "", add_special_tokens=False).ids


# 8 leaks

NAMES = "Velka Ostran Mirolo Tarbex Quenil Sarvo Helmur Dintra Polvak Ermine Fostra Gundel".split()


def item(k):
    rng = random.Random(k)
    return " ".join(f"The archive of {rng.choice(NAMES)}{rng.randint(10, 99)} keeps {rng.randint(100, 999)} pages before {rng.choice(NAMES)}{rng.randint(10, 99)} opens." for _ in range(5))


def test_leaks(spark):
    tests = [(k, item(k)) for k in range(6)] + [(100, item(0).upper()), (101, None), (102, "")]
    filler = "Unrelated words about weather and gardens fill this line of the document. " * 40
    words = item(1).split()
    words[7], words[20] = "changed", "other"
    docs = [
        (0, filler + item(0).replace(" ", "\n") + filler), (1, filler + " ".join(words)), (2, filler + " ".join(item(2).split()[:12])), (3, filler), (4, None), (5, ""),
        (6, " ".join(item(3).split()[: len(item(3).split()) * 2 // 3])), (7, item(4) + filler * 20 + item(5)), (7, item(4) + filler * 20 + item(5)),
    ]
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(tests, "item_id bigint, text string")).collect()}
    assert got == {(0, 0), (0, 100), (1, 1), (6, 3), (7, 4), (7, 5)}
    assert leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


# 9 sentences


@pytest.mark.parametrize(
    "text, units",
    [
        ("See Fig. 3 and Sec. 4.2, cf. the appendix. It ended.", ["See Fig. 3 and Sec. 4.2, cf. the appendix.", "It ended."]),
        ("Mr. Brown met Dr. J. R. White of Acorn Inc. today. The list has pages, etc. The end.", ["Mr. Brown met Dr. J. R. White of Acorn Inc. today.", "The list has pages, etc.", "The end."]),
        ('He asked, "Is it ready? Can we go?" and left. "Stop now!" said Ann.', ['He asked, "Is it ready? Can we go?" and left.', '"Stop now!" said Ann.']),
        ("It ran. (Nobody saw it.) It stopped ... slowly.", ["It ran.", "(Nobody saw it.)", "It stopped ... slowly."]),
        ("Am 3. Mai 2021 kam er. Die Regel gilt gem. Abs. 2 Nr. 5, d. h. immer.", ["Am 3. Mai 2021 kam er.", "Die Regel gilt gem. Abs. 2 Nr. 5, d. h. immer."]),
        ("« Arrêtez tout ! » demanda-t-il. C'est fini !", ["« Arrêtez tout ! » demanda-t-il.", "C'est fini !"]),
        ("等等……真的空了吗？“请停止。”值班员说。他写着：“备份！”完了。", ["等等……真的空了吗？", "“请停止。”值班员说。", "他写着：“备份！”", "完了。"]),
        ("本（第2版。改訂）を配った。「止めて。」と言った。", ["本（第2版。改訂）を配った。", "「止めて。」と言った。"]),
        ("ทีมตรวจเสร็จแล้ว ฐาน Velka ส่งต่อ 12 หน้า", ["ทีมตรวจเสร็จแล้ว", "ฐาน Velka ส่งต่อ 12 หน้า"]),
        ("क्या यह तैयार है? डॉ. Rao ने जाँच की। ठीक है।", ["क्या यह तैयार है?", "डॉ. Rao ने जाँच की।", "ठीक है।"]),
        ("هل انتهى؟ قال د. Tom إن الملف جاهز.", ["هل انتهى؟", "قال د. Tom إن الملف جاهز."]),
        ("Heading\n\nOne line\nwraps here. Next\n\n1. First item. Still it.\n2. Second", ["Heading", "One line\nwraps here.", "Next", "1. First item. Still it.", "2. Second"]),
        ("a\r\n\r\nb\r\rc", ["a", "b", "c"]),
        (" \n\t\n ", []),
    ],
)
def test_units(text, units):
    ends = sentences.Splitter().units(text)
    got = [text[a:b].strip() for a, b in zip([0, *ends], ends)]
    assert got == units


def test_sentence_rows(spark):
    rows = [(1, "Aa bb. Cc dd."), (1, "Aa bb. Cc dd."), (2, None), (3, ""), (4, "   ")]
    got = sentences.sentence_units(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "sent_end").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 6), (1, 13)}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aA. \n\"'()“”«»。！?…1-", max_size=80))
def test_units_end_after_text(text):
    ends = sentences.Splitter().units(text)
    assert ends == sorted(set(ends)) and all(not text[e - 1].isspace() for e in ends)


# the queries over the smallest tables


def test_p1_against_sql(spark):
    import os

    import duckdb
    from corpusgauge.llm import queries

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("scan_documents", "chunks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        assert {tuple(r) for r in queries.queries()[name](spark, data).collect()} == set(con.execute(sql).fetchall())
    for name, q in queries.queries().items():
        assert q(spark, data).columns, name


def test_leaks_of_items_with_several_variants():
    passage = " ".join(f"shared{i}" for i in range(40))
    variants = [(n, f"{passage} " + " ".join(f"own{n}x{k}" for k in range(12))) for n in range(1, 5)]
    index = leakage.LeakIndex(variants)
    noise = " ".join(f"noise{i}" for i in range(60))
    found = {item for _, item, *_ in index.search([f"{noise} {passage} {noise}"])}
    assert found == {1, 2, 3, 4}
    # a stock opening that many items have is no leak of them
    opening = " ".join(f"stock{i}" for i in range(8))
    items = [(n, f"{opening} " + " ".join(f"body{n}x{k}" for k in range(20))) for n in range(30)]
    assert not leakage.LeakIndex(items).search([f"{noise} {opening} {noise}"])


def test_leak_search_equals_an_exact_search_over_all_items():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(n, " ".join(word() for _ in range(rng.randrange(12, 60)))) for n in range(40)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(30))]
        for n, text in rng.sample(items, 2):
            words = text.split()
            size = rng.randrange(len(words) // 3, len(words) + 1)
            at = rng.randrange(len(words) - size + 1)
            parts += [" ".join(words[at : at + size]), " ".join(word() for _ in range(30))]
        texts.append(" ".join(parts))
    index = leakage.LeakIndex(items)
    got = {(row, item) for row, item, *_ in index.search(texts)}
    want = set()
    for row, text in enumerate(texts):
        hashes = [index.hash[w] for w in leakage.words_of(text)]
        shingles = leakage._shingles(np.array(hashes, dtype=np.uint64)).tolist()
        want |= {(row, index.ids[i][0]) for i in range(len(index.words)) if index.verify(hashes, shingles, i)}
    assert want and len(got & want) >= 0.98 * len(want) and got <= want


def test_document_evidence_outweighs_the_lists():
    def units(text, **lexicon):
        ends = sentences.Splitter(sentences.Lexicon(**lexicon)).units(text)
        return [text[a:b].strip() for a, b in zip([0, *ends], ends)]

    assert units("We saw Main St. The shop closed.") == ["We saw Main St.", "The shop closed."]
    assert units("They use max. Then they rest.") == ["They use max.", "Then they rest."]
    # an unlisted abbreviation: known from the document, or else from the corpus; a listed one the corpus has without a stop
    assert units("See qnt. 4 first. The qnt. Falcon ran.") == ["See qnt. 4 first.", "The qnt. Falcon ran."]
    assert units("The qnt. Falcon ran.") == ["The qnt.", "Falcon ran."]
    assert units("The qnt. Falcon ran.", abbreviations=frozenset({"qnt"})) == ["The qnt. Falcon ran."]
    assert units("It grew approx. Falcon ran.") == ["It grew approx. Falcon ran."]
    assert units("It grew approx. Falcon ran.", plain=frozenset({"approx"})) == ["It grew approx.", "Falcon ran."]


def test_long_pairs_and_long_texts():
    inside = "He said it again and again. " * 60
    text = f"It began (as noted: {inside}and so on) and went on. Then it ended."
    ends = sentences.Splitter().units(text)
    assert len(ends) == 2 and text[: ends[0]].endswith("went on.")
    deep = "".join("([{"[i % 2] for i in range(200)) + "x. Y" + "".join(")]"[i % 2] for i in range(199, -1, -1)) + " end. Next."
    assert len(sentences.Splitter().units(deep)) == 2
    import time

    begun = time.time()
    sentences.Splitter().units("Mr. Brown saw abc. Next one etc. Another " * 10_000 + '"' + "In it. Out. " * 20_000 + '"')
    assert time.time() - begun < 6


@pytest.mark.parametrize("line", ["{}. item\n", "- item\n", "# head\n\n", "`a b ", "``a` ", "$a b ", "costs $5 and x\n", "**b ", "\\item x \\textbf{{a}}\n", "<script> x\n"])
def test_markup_is_read_in_linear_time(line):
    import time

    text = "".join(line.format(i % 9000) for i in range(100_000))
    begun = time.time()
    markup.markup_kinds(text)
    assert time.time() - begun < 4


def test_long_formulas_and_spans():
    long = " + ".join(f"x_{i}" for i in range(200))
    assert ("latex", "formula") in markup.markup_kinds(f"\\section{{A}}\nLet ${long}$ hold.")
    assert markup.markup_kinds("It costs $5 to $7, or US$ 3 and $HOME or $PATH.") == []
    assert markup.code_spans("a `b` ``c ` d`` e` `f\n`") == [(2, 5, "b"), (6, 15, "c ` d"), (17, 20, " ")][:2]
    assert markup.doubled_spans("**a** b ** c **d e**", "**") == [(0, 5, "a"), (13, 20, "d e")]


HELD_OUT = [  # wordings that no training sentence has; names outside the list of given names
    ("Please forward this to {} by Friday.", "Haruto Nakamura"), ("The meeting notes were shared with {} yesterday.", "Oluwaseun Adeyemi"), ("{} asked for a refund of the fee.", "Svetlana Petrova"), ("According to {}, the report is late.", "Rajesh Iyer"),
    ("Our reviewer {} found two errors.", "Katarzyna Nowak"), ("You can reach {} on weekdays.", "Thandiwe Mokoena"), ("The keys are with {} downstairs.", "Pieter van der Merwe"), ("Signed: {}", "Ingeborg Lindqvist"), ("Dear {}, your file is ready.", "Yolanda Quispe"),
    ("We thank {} and the whole staff.", "Dmitri Volkov"), ("I spoke with {} about the lease.", "Aaliyah Washington"), ("Mrs. {} called twice.", "Branwen Llewellyn"), ("The patient {} was moved to room four.", "Tomoko Ishikawa"), ("Bitte geben Sie die Mappe an {} weiter.", "Gudrun Hoffmeister"),
    ("Der Brief stammt von {} und liegt bei.", "Ottokar Baumgartner"), ("Frau {} hat angerufen.", "Roswitha Engelhardt"), ("Nous avons reçu la lettre de {} hier.", "Ghislaine Fontaine"), ("Contactez {} avant midi.", "Thibault Marchand"), ("Ho parlato con {} del contratto.", "Ludovica Bianchi"),
    ("La pratica di {} è chiusa.", "Ermenegildo Conti"), ("Hablé con {} sobre el contrato.", "Itziar Etxeberria"), ("Entregue la carpeta a {} mañana.", "Xiomara Delgado Ruiz"), ("Mr. {} will attend.", "Kwame Boateng"), ("Regards,\n{}", "Niamh Gallagher"),
]
PLACES = [("Send it to {} today.", "14 Willow Crest Mews, Exeter EX4 6TT"), ("He stays at {} now.", "7 Harbour View Gardens, Cardiff CF10 4PA"), ("Unser Büro: {}.", "Lindenhain 12, 04229 Leipzig"), ("Write to {}.", "221 Baker Row, Tulsa, OK 74103"), ("The parcel went to {} again.", "3 rue des Lilas, 69003 Lyon")]
CLEAN = [
    "The Quarterly Report covers Northern Europe and Southern Asia.", "Open Source Software runs on Monday Morning.", "Der Neue Index liest die Alte Liste.", "Project Silver Harbor moved to Amsterdam.", "See Table 12 in Annex Four of the Handbook.",
    "The account DE44 5001 0517 5407 3249 31 is closed.", "Version 4.12.3 replaced build 20231101.7 on 192.0.2.44.", "La Biblioteca Nacional abre en Mayo.", "Le Conseil Général lit le Rapport Annuel.", "Room 14, Oak Building, stays shut.",
]


def test_personal_data_in_other_wordings():
    finder = personal.Finder(personal.models())
    values = lambda text: {(k, text[a:b]) for k, a, b in finder.find_batch([text])[0]}
    names = sum(("name", v) in values(t.format(v)) for t, v in HELD_OUT)
    places = sum(("address", v) in values(t.format(v)) for t, v in PLACES)
    wrong = [v for t in CLEAN for v in values(t)]
    print(f"names outside the list: {names} of {len(HELD_OUT)}; addresses: {places} of {len(PLACES)}; wrong: {wrong}")
    assert names >= len(HELD_OUT) // 2 and places >= 3 and len(wrong) <= 3
    assert ("email", "ivan@bücher.example") in values("Write to ivan@bücher.example soon.")
