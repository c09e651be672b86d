"""Problems 5, 7, 8 and 9: labelled examples, an independent tokenizer, brute force, and odd cases."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.llm import bpe, mixing, residue, sentences

# 5: sentences are parted by a bar here; what stands between them is white space or nothing
GOLD = [
    "Dr. Brown met J. R. Smith et al. at 10 a.m. in the U.S. office.|They left at 5 p.m.|It was fine, i.e. good (see Fig. 3).",
    "See No. 12 of App. B, cf. Tab. 4.|Vol. 3, pp. 4-9, is of type B.|The U.S. and the E.U. agree.|No.|Yes!",
    'He said "Stop it!" and left.|The label reads "No. 5 failed."|Then “Why?” was asked.|(This is all.)|End',
    "Version 1.2.3 of notes.txt is at www.site.example now.|A dose of approx. 2.5 mg... then more.|It ends...|Next one",
    "‘The cell covers it. . .’ is how it begins.|Labels, etc. are kept.|Labels, notes, etc.|He wrote a Ph.D. thesis.|pH values rise.|mRNA too.",
    "One ends.|Two ends?|Three isn't it?!|A heading",
    "Am 3. Mai 2001 kam Prof. Dr. Weber, z. B. mit Notizen usw.|Der Hinweis „Halt!“ bleibt.|„Ist es gut?“, fragte er.|Das Teil bzw. Organ, d. h. Nr. 5 Abs. 2, ist vom Typ B.|Es endet im Jahr 2015.",
    "Según M. A. Pérez et al. el motor, p. ej. el núm. 3, pág. 4, pesa aprox. 2,5 kg.|En EE. UU. el Sr. López vive.|¿Qué es?|¡Nada!|La nota «¡Pare!» queda.|Viene de EE. UU.|¿Sí?",
    "Selon J.-P. Martin et al. le chap. 3, p. 40, dit non.|M. Durand a dit : « Oui ! »|« Est-ce vrai ? » demanda Paul.|Quel mot\xa0?|Le mot... puis rien.|Une dose de env. 3 mg, notes, etc.",
    "W 1999 r. prof. Nowak pisze, np. m.in. termin (zob. rys. 3).|„Czy działa?” – zapytał Jan.|Notatki, karty itd.|Koniec od 2004 r.|Tak.",
    "Una dosi d'aprox. 3 mg, p. ex. el núm. 4.|La Sra. Puig va dir: «Sí.»|Quin és?",
    "约3.5毫克的药物。|Drevanol写道：“合同停止。”|据Dr. Brown的报告，无。|说明写着“停止！”并延缓。|（全部。）|慢性……|最后",
    "図3.4の弁。|注記の「なぜ？」が示す。|彼は「止めて。」と述べた。|（以上。）|どれ？",
    "डॉ. वर्मा के अनुसार लगभग 3.5 मि.ग्रा. मात्रा है।|“क्या यह है?” यह लिखा है।|अंत!",
    "يرى د. تولدان أن الدواء جيد.|هل هذا صحيح؟|السؤال «هل يعمل؟» ورد هنا.",
]


def marked(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "seg_id long, segment string").withColumn("sentence", F.lit("clash"))
    got = sentences.sentences(df, id_col="seg_id", text="segment").orderBy("seg_id", "sent_start").collect()
    return [[(r.sent_start, r.sent_end, r.sentence) for r in got if r.seg_id == i] for i in range(len(texts))]


@pytest.mark.parametrize("joint", [" ", "\xa0", "\n", "  \t"])
def test_gold_sentences(spark, joint):
    got = marked(spark, [g.replace("|", joint) for g in GOLD])
    for g, s in zip(GOLD, got, strict=True):
        assert [x for _, _, x in s] == g.split("|")


def test_missing_blanks(spark):
    got = marked(spark, ["The cell grows.Every wall stays.«Yes.»He left.It weighs.35.5 mg do.", "慢性。急性！", "Stop!pH rises.¿Qué?"])
    assert [x for _, _, x in got[0]] == ["The cell grows.", "Every wall stays.", "«Yes.»", "He left.", "It weighs.", "35.5 mg do."]
    assert [x for _, _, x in got[1]] == ["慢性。", "急性！"]
    assert [x for _, _, x in got[2]] == ["Stop!", "pH rises.", "¿Qué?"]


def test_thai_and_lines(spark):
    got = marked(spark, ["โรคลดเครื่องมือ ขนาดยา17.35มก.ลดโรค ในปีพ.ศ. 2560อาการ", "A heading\n\nThe text\ngoes on. And on", "one \r\n \r\n two"])
    assert [x for _, _, x in got[0]] == ["โรคลดเครื่องมือ", "ขนาดยา17.35มก.ลดโรค", "ในปีพ.ศ. 2560อาการ"]
    assert [x for _, _, x in got[1]] == ["A heading", "The text\ngoes on.", "And on"]
    assert [x for _, _, x in got[2]] == ["one", "two"]


def test_sentences_of_odd_texts(spark):
    texts = [None, "", " \xa0\n", "no end", "...", "  x.  ", " A. B", "a" * 30_000, "One. " * 3000]
    got = marked(spark, texts)
    assert [len(g) for g in got[:7]] == [0, 0, 0, 1, 1, 1, len(got[6])]
    assert got[5] == [(2, 4, "x.")]
    assert got[7][0][:2] == (0, 30_000)
    assert len(got[8]) == 3000
    for t, g in zip(texts, got, strict=True):
        end = 0
        for a, b, s in g:
            assert s == t[a:b] == s.strip()
            assert not t[end:a].strip()
            end = b
        assert not (t or "")[end:].strip()


# 7
ALPHABET = "abst'’  \n\t\xa01²½.,!?'srevldm中あक्ि‍😀́\r\x00<|>_-"


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path(None, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.text(alphabet=ALPHABET, max_size=50), st.text(max_size=30)), min_size=1, max_size=8))
def test_ids_equal_the_library(library, texts):
    ids, offsets, sizes = bpe.encode_batch(texts, bpe.merger())
    assert ids == library(texts)
    for t, i, o, z in zip(texts, ids, offsets, sizes, strict=True):
        assert bpe.decode(i) == t
        assert sum(z) == len(i)
        at = 0
        for k, (a, n) in enumerate(zip(o, z, strict=True)):
            b = o[k + 1] if k + 1 < len(o) else len(t)
            assert bpe.decode(i[at : at + n]) == t[a:b]
            at += n


def test_long_texts(library):
    texts = ["x" * 70_000, "中文" * 20_000, " " * 5000, "<|endoftext|> it's", "ab" * (bpe.CHUNK // 2 + 5)]
    assert bpe.encode_batch(texts, bpe.merger())[0] == library(texts)


def test_encode(spark, library):
    df = spark.createDataFrame([(1, "it's fine", 0), (2, None, 0), (3, "", 0), (1, "it's fine", 0)], "doc_id long, text string, ids int")
    got = bpe.encode(df, text="text", keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(1, library(["it's fine"])[0])] * 2 + [(2, []), (3, [])]
    assert bpe.encode(df.limit(0), text="text", keep=["doc_id"]).collect() == []
    counts = bpe.token_counts(df, text="text", keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.tokens) for r in counts) == [(1, 3), (1, 3), (2, 0), (3, 0)]


# 8
TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, lang string, tokens long"


def corpus(rng, sizes):
    out = []
    for s, (docs, most) in sizes.items():
        for _ in range(docs):
            out.append((len(out), s, rng.choice(["en", "English", "de", None, "xx"]), rng.randint(1, most)))
    return out


def test_mix_reaches_its_targets(spark):
    rng = random.Random(3)
    docs = corpus(rng, {"a": (800, 60), "b": (300, 60), "c": (40, 60)})
    docs += [(9001, None, "en", 50), (9002, "other", "en", 50), (9003, "a", "en", 0)]
    df = spark.createDataFrame(docs, DOCS).withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 5), (None, 0.5, 1)], TARGETS)
    domains = {"a": "x", "b": "x", "c": "y", "none": "y"}
    for buckets in (4096, 1, 7):
        got = mixing.mixed(df, targets, domains=domains, buckets=buckets)
        rows = got.collect()
        assert {r.source for r in rows} == {"a", "b", "c"}
        assert len({r.doc_id for r in rows}) == len(rows)
        assert all(1 <= r.copies <= {"a": 2, "b": 2, "c": 3}[r.source] for r in rows)
        share = {r.source: r.share for r in mixing.shares(got, targets).collect()}
        # the empty source's share goes to its sibling as far as that can take it, which here is nothing
        assert share["c"] == pytest.approx(0.2, abs=0.01)
        assert share["a"] / share["b"] == pytest.approx(4 / 3, rel=0.03)
        assert share["none"] == 0
    again = [r.doc_id for r in mixing.mixed(df, targets, domains=domains).orderBy("doc_id").collect()]
    assert again == [r.doc_id for r in mixing.mixed(df.repartition(7), targets, domains=domains).orderBy("doc_id").collect()]


def test_mix_of_a_given_total(spark):
    docs = corpus(random.Random(1), {"a": (500, 40), "b": (10, 40)})
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    have = {s: sum(d[3] for d in docs if d[1] == s) for s in "ab"}
    full = {r.source: r for r in mixing.shares(mixing.mixed(df, targets, total="available"), targets).collect()}
    assert full["b"].tokens == 2 * have["b"]
    assert full["a"].tokens == pytest.approx(have["a"] - have["b"], abs=40)
    small = mixing.shares(mixing.mixed(df, targets, total=200), targets)
    assert small.agg(F.sum("tokens")).first()[0] == pytest.approx(200, abs=40)
    assert mixing.mixed(df.limit(0), targets).collect() == []
    assert mixing.mixed(df, targets.limit(0)).collect() == []


def test_shortages_go_to_siblings_first():
    rows = [("a", "en", 1000), ("b", "en", 10), ("c", "en", 1000)]
    goal = {"a": (0.4, 1), "b": (0.2, 1), "c": (0.4, 1)}
    got, total = mixing.budgets(rows, goal, {"a": "x", "b": "x", "c": "y"}, 100)
    assert total == 100
    assert got["b", "en"] == 10
    assert got["a", "en"] == pytest.approx(50)  # its sibling takes all that b lacks
    assert got["c", "en"] == pytest.approx(40)


# 9
FILL = "red blue green large small cold warm fast slow old".split()


def template(i, value=None):
    w = random.Random(i)
    return f"Every {w.choice(FILL)} cell of the {value or w.choice(FILL)} wall explains the {w.choice(FILL)} index."


def pages():
    """(text, whether it is residue) with templates that align; numbers make the texts differ."""
    out = [(f"{template(i)} {template(i + 500)} Case {i} is closed.", False) for i in range(60)]
    out += [(f"{template(i)} {template(i + 900, p)} Case {i} stays.", True) for i, p in enumerate(
        ["{{name}}", "${user}", "{0}", "%s", "[INSERT name HERE]", "____", "<<title>>", "&lt;note&gt;", "[TBD]", "undefined", "%(x)s", "{% lang %}", "__site__"])]
    out += [(f"{template(i)} The token {{{i % 3}}} stands for the name in file {i}.", False) for i in range(12)]
    out += [(f"{template(i)} The column headed undefined counts terms. Case {i}.", False) for i in range(6)]
    out += [
        ("Home | Terms | Contact\n404 Not Found\n© 2019 site", True),
        ("<h1>Error 503: the page you asked for could not be found.</h1>", True),
        ("Please enable JavaScript to view this page.", True),
        ("Skip to content\n\nBitte aktivieren Sie JavaScript, um fortzufahren.", True),
        ("Lorem ipsum dolor sit amet. Consectetur adipiscing elit sed do.", True),
        ("A heading\n\nDolor magna aliqua commodo cillum laborum. Ipsum quis nostrud.", True),
        ("Sample text for this block. Sample text for this block.", True),
        ("asdf asdf jkl Texto de ejemplo.", True),
        ("blah blah blah blah", True),
        ("The error 404 is explained in the third chapter of the handbook.", False),
        ('The entry "page not found" stands in the glossary.', False),
        ("JavaScript is the language in which the viewer was written.", False),
        ("Typesetters fill a blank layout with lorem ipsum, a habit of theirs.", False),
        ("Please enable JavaScript to view this page. The wall of the cell is red, and every index explains it.", False),
        ("The set {x, y} holds. See [1] and 5 % of it.", False),
    ]
    return out


def test_residue(spark, rows):
    made = pages()
    data = [(i, t, "placeholder") for i, (t, _) in enumerate(made)] + [(1000, None, ""), (1001, "", ""), (1002, " \xa0\n", "")]
    data += [(2000 + i, made[60][0], "") for i in range(30)]  # copies of one residue text
    df = spark.createDataFrame(data, "doc_id long, text string, reason string")
    got = {r.doc_id for r in residue.residue(df, id_col="doc_id", text="text").collect()}
    want = {i for i, (_, bad) in enumerate(made) if bad} | set(range(2000, 2030))
    assert got - want == set(), [made[i][0] for i in got - want if i < 1000]
    assert want - got == set(), [made[i][0] for i in want - got if i < 1000]
    kept = residue.without_residue(df, id_col="doc_id", text="text")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in data} - want
    assert residue.residue(df.limit(0), id_col="doc_id", text="text").collect() == []


def test_page_blocks():
    assert residue.page_blocks("Home | Terms | Contact") == []
    assert [k for k, _ in residue.page_blocks("Error 404. Something else is said here.")] == ["strong", "plain"]
    a = residue.page_blocks('Could not connect to database "x1"')
    assert a == residue.page_blocks('Could not connect to database "y2"')


def test_messages_of_every_pattern(spark):
    pages = [
        "401 Unauthorized", "HTTP Status 500", "Errno 13", "You do not have permission to view this page.", "The page does not exist.",
        "The page you are looking for has moved.", "Página no encontrada", "PÁGINA NO ENCONTRADA", "页面不存在", "P&aacute;gina no encontrada",
        "Lorem ipsum consectetur adipiscing elit.", "xyz xyz xyz", "jkl jkl bar baz",
    ]
    df = spark.createDataFrame([*enumerate(pages), (100, "The wall of the cell is red, and every index explains it.")], "doc_id long, text string")
    got = {r.doc_id for r in residue.residue(df, id_col="doc_id", text="text").where("reason = 'page'").collect()}
    assert got == set(range(len(pages))), [pages[i] for i in set(range(len(pages))) - got]


def test_verdict_of_a_placeholder_without_counts(spark):
    entry = "Begriff: Wand {}\nQuelle: ____"
    literal = [
        "The mail of office {} greets with [name] in brackets, as is said.",
        "The column headed undefined counts {} terms.",
        "The {} manuals keep variables such as %s or ${{user}} untouched.",
        "Die Variable %s bleibt in Zeile {} stehen.",
    ]
    for n in (1, 2, 40):  # the same in any number of records
        data = [(i, t.format(i)) for i in range(n) for t in literal]
        data += [(1000 + i, entry.format(i)) for i in range(n)]
        # a slot that others fill, though a noun for placeholders leads to it
        data += [(2000 + i, f"The token {w} was given to reader {i}.") for i, w in enumerate(["{{id}}", "abc", "klm", "xyz"])]
        df = spark.createDataFrame(data, "doc_id long, text string")
        got = {r.doc_id for r in residue.residue(df, id_col="doc_id", text="text").collect()}
        assert got == {*range(1000, 1000 + n), 2000}, n


def test_slots_that_other_records_fill(spark):
    bad = {
        "Dear {}, thank you for your order of the red wall.": ["Company Name", "first_name", "clientName", "CLIENT"],
        "Contract between the wall and {} of the third cell.": ["Client", ""],
        "Thank you for the visit to {}.": [""],
    }
    fills = ["Velmar", "Mr. Hadrovec", "Toldanek", "Nimbastro", "Ilve Stone"]
    data, want, i = [], set(), 0
    for n, (t, values) in enumerate(bad.items()):
        data += [(1000 + 100 * n + j, t.format(f)) for j, f in enumerate(fills)]
        for v in values:
            data.append((i, t.format(v)))
            want.add(i)
            i += 1
    # no slot: nobody else fills it
    data += [(5000, "The function first_name is called with Company Name in the manual."), (5001, "Welcome , said the wall."), (5002, "标准血压增加5%而减少10%。")]
    shapes = ["{{first-name}}", "{{ first name }}", "{{prénom}}", "{größe}", "%état%", "{{" + "a" * 90 + "}}", "(Your company name goes here)",
              "[Insert the full name of the company that signs the contract here]"]
    data += [(6000 + j, f"Every cell of the {x} wall explains the index.") for j, x in enumerate(shapes)]
    want |= {6000 + j for j in range(len(shapes))}
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id for r in residue.residue(df, id_col="doc_id", text="text").collect()}
    assert got == want, [t for k, t in data if k in got ^ want]


def test_long_quotation_within_a_sentence(spark):
    texts = ["他说“" + "语" * n + "。”然后离开。" for n in (5, 1990, 2500, 30000)]
    df = spark.createDataFrame(enumerate(texts), "seg_id long, segment string")
    got = sentences.sentences(df, id_col="seg_id", text="segment").groupBy("seg_id").count().collect()
    assert {r.seg_id: r["count"] for r in got} == dict.fromkeys(range(4), 1)


def test_selection_of_the_full_total(spark):
    from termloom.llm import queries

    d = "/root/testdata/sf0.001"
    per = {r.source: r.tokens for r in queries.queries()["p8_mix_full"](spark, d).selectExpr("source", "tokens * copies as t").groupBy("source").sum("t").toDF("source", "tokens").collect()}
    want = {r.source: r.tokens for r in queries.p8_shares_full(spark, d).collect() if r.tokens}
    assert per == want


def sentence_texts(spark, items):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(items)], "id long, t string, lang string")
    out = {i: [] for i in range(len(items))}
    for r in sentences.sentences(df, id_col="id", text="t", lang="lang").orderBy("id", "sent_start").collect():
        out[r.id].append(r.sentence)
    return list(out.values())


def test_abbreviations_by_language(spark):
    words = [
        "She studied modern art. The museum hired her.", "It is ok. We can go now.", "Please send the doc. It is needed today.", "He is wearing a cap. Nobody cares.",
        "Prices fell to 3 sec. The test ended.", "J'aime le cap. Il est beau.",
    ]
    named = [
        ("Przyszedł doc. Nowak i zob. rys. Kowalskiego.", "pl"), ("Przyszedł doc. Nowak i mgr Kowalski, jest to np. Warszawa.", None), ("Voir art. Premier de la loi.", "fre"),
        ("See Fig. A and sec. 4 of it.", "English"), ("Nach Abb. Vier und Abs. 2 gilt das.", "de"), ("Smith et al. Found nothing.", None),
    ]
    got = sentence_texts(spark, [(w, None) for w in words] + [(w, "en") for w in words[:5]] + named)
    assert all(len(x) == 2 for x in got[:11])
    assert all(len(x) == 1 for x in got[11:])
    long = "L" + "a" * 50
    assert sentence_texts(spark, [(f"{long} B. Smith came. He left.", "en"), (" " * 20 + "3. Punkt hier. Ende.", "de")]) == [
        [f"{long} B. Smith came.", "He left."], ["3. Punkt hier.", "Ende."]
    ]


def test_slots_of_letters_and_pages_of_no_known_language(spark):
    t = [(i, f"Dear {n}, thank you for your order number {100 + i * 7}. It will be sent on Monday.") for i, n in enumerate("Ann Bob Carla Dmitri Eve".split())]
    left = [" CUSTOMER_NAME", " firstName", " ", " Customer Name", " {{ name }}"]
    t += [(100 + i, f"Dear{x}, thank you for your order number {900 + i}. It will be sent on Monday.") for i, x in enumerate(left)]
    t += [(300 + i, f"Hjem | Ordliste | Hjelp\nSiden du leter etter finnes ikke. Kode {i}.") for i in range(6)]
    t += [(700 + i, f"Avtalen gjelder i {i} år for alle.") for i in range(6)]  # without a frame it may be contents
    # a sentence of contents recurs too, but stands beside others elsewhere
    t += [(400 + i, f"The result is given in Fig. {i}.") for i in range(4)] + [(410 + i, f"The result is given in Fig. {i}. Cats like it number {i}.") for i in range(4)]
    t += [(500, "Your text here"), (501, "TODO: write the introduction."), (502, "{{" + "a" * 300 + "}}"), (503, "Sign: [insert the full legal name of the contracting party]")]
    t += [(600 + i, "The same legal text stands here.") for i in range(9)]
    df = spark.createDataFrame(t, "id long, text string")
    got = {r.id: r.reason for r in residue.residue(df, id_col="id", text="text").collect()}
    assert sorted(got) == [*range(100, 105), *range(300, 306), 500, 501, 502, 503]
    assert got[300] == "page" and got[502] == "placeholder"
