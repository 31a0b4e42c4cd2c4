import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexframe.llm import pii
from lexframe.llm import names as nm

# What a collection might have taught: names in use there, one that is a town too, and a plain word.
KNOWN = nm.Names(
    given={**nm.Names().given, **dict.fromkeys(("rovka", "danisa", "rovisa", "selias", "livias"), 0.6), **dict.fromkeys(("rose", "lily"), 0.3)},
    family={**dict.fromkeys(("kasuski", "halingham", "wynöder", "skersholt"), 0.6), **dict.fromkeys(("field", "velwick", "winter"), 0.3)},
    plain=frozenset(("cards", "place")),
    han_family=frozenset(("楠渡", "灰浦", "濮阳", "蛍渡", *nm.COMMON_HAN.split())),
    han_given=frozenset(("澪斗", "蘅")),
)


def found(text):
    return [(text[a:b], kind) for a, b, kind, _ in pii.find_spans(text, KNOWN)]


CASES = [
    ("Reply to a.b+lex@mail.example.test, not to me", [("a.b+lex@mail.example.test", "email")]),
    ("mail jane [at] post [dot] example [dot] org or", [("jane [at] post [dot] example [dot] org", "email")]),
    ("cc: jane dot doe AT post DOT example DOT org; x", [("jane dot doe AT post DOT example DOT org", "email")]),
    ("x (jane (at) post.example.org) y", [("jane (at) post.example.org", "email")]),
    ("ご連絡はjane＠post.exampleまで", [("jane＠post.example", "email")]),
    ("jane@​post.example.", [("jane@​post.example", "email")]),
    ("Say verb@9 and NOUN@2; https://example.org/entry/837?sense=3", []),
    ("Ring +1 (917) 555-0184 after six", [("+1 (917) 555-0184", "phone")]),
    ("tel 555-0195 or (646) 555 0155 (evenings)", [("555-0195", "phone"), ("(646) 555 0155", "phone")]),
    ("Tel. 030/23125-343, abends auch 0049-30-23125-519", [("030/23125-343", "phone"), ("0049-30-23125-519", "phone")]),
    ("Tél. 01.99.00.79.77 ; et 0199 003199", [("01.99.00.79.77", "phone"), ("0199 003199", "phone")]),
    ("звоните 8 (000) 555 61 82.", [("8 (000) 555 61 82", "phone")]),
    ("電話：（０３）００００－９１７７　メール", [("（０３）００００－９１７７", "phone")]),
    ("phone on five five five oh one three seven.", [("five five five oh one three seven", "phone")]),
    ("one or two of three cards", []),
    ("National ID no. 666-75-4060, copy", [("666-75-4060", "id")]),
    ("passport QQ 57 10 61 D, was", [("QQ 57 10 61 D", "id")]),
    ("national id no. qq965767d.", [("qq965767d", "id")]),
    ("Ausweisnummer L00T05670, unterschrieben", [("L00T05670", "id")]),
    ("Carte d'identité 0 00 00 00 697 531 00, au", [("0 00 00 00 697 531 00", "id")]),
    ("Documento de identidad 00001273-D, firmado", [("00001273-D", "id")]),
    ("Documento de identidad 000892465, firmado", [("000892465", "id")]),
    ("correo o llamar al 000892465 hoy", [("000892465", "phone")]),
    ("身份证号99999919420302659x，姓名", [("99999919420302659x", "id")]),
    ("身分証番号0000 2061 2015、", [("0000 2061 2015", "id")]),
    ("The box number on the shelf is 840-11-2. ISBN 978-1-933-10-4. Price 1 825.50 of 2021-01-24, hash 8b4df13a4f2ecf9a58b3febc9730c510fb461198", []),
    ("pack 5d0c7e1a-93b4-4c58-8f21-0a6be4d1c701 went out", []),
    ("My address is Flat 25, 199 Orver Close, Dunby.", [("Flat 25, 199 Orver Close", "address")]),
    ("marked 49 Quillen Rd.. Then", [("49 Quillen Rd.", "address")]),
    ("lives at 30 Quillen Row, Apt 14 and", [("30 Quillen Row, Apt 14", "address")]),
    ("Anschrift lautet Perrergasse 75 b, Dunford.", [("Perrergasse 75 b", "address")]),
    ("J'habite 18 bis, avenue Bramen, Merrford.", [("18 bis, avenue Bramen", "address")]),
    ("Vivo en C/ Bramer, 199, 2º B, Quillham.", [("C/ Bramer, 199, 2º B", "address")]),
    ("адрес: просп. Хасков, д. 21, корп. 2, Velford", [("просп. Хасков, д. 21, корп. 2", "address")]),
    ("住所は苔沢市灰浦1番地です", [("苔沢市灰浦1番地", "address")]),
    ("我的地址是霁棠街191号3单元201室。", [("霁棠街191号3单元201室", "address")]),
    ("I do not agree with Korka O'Quendrigal-Winter about sense 4", [("Korka O'Quendrigal-Winter", "name")]),
    ("According to Dr Field, Danisa the word", [("Field, Danisa", "name")]),
    ("noticed by J.S. Halingham and then by de Wynöder, Rovisa.", [("J.S. Halingham", "name"), ("de Wynöder, Rovisa", "name")]),
    ("Je tiens mot de Skersholt, Rose, qui le disait", [("Skersholt, Rose", "name")]),
    ("Interviewer: Rose. Place: Velwick.", [("Rose", "name")]),
    ("Rose, Lily and Fern are in the flower group. Mark the stress, and May is a month.", []),
    ("near Velwick, though it may (see also field).", []),
    ("氏名楠渡 澪斗。", [("楠渡 澪斗", "name")]),
    ("住所は7 Bramer Streetです", [("7 Bramer Street", "address")]),
    ("我的地址是Flat 19, 76 Luntow Avenue。", [("Flat 19, 76 Luntow Avenue", "address")]),
    ("メール：a.b@post.example2019-05-04に", [("a.b@post.example", "email")]),
    ("氏名楠渡。この点は灰浦さんの指摘による", [("楠渡", "name"), ("灰浦", "name")]),
    ("Dear Maria K. Gonzalez, thank you. Dear Editor, no. dear friend", [("Maria K. Gonzalez", "name")]),
    ("firmado por Ana-María Ruiz.", [("Ana-María Ruiz", "name")]),
    ("氏名山田 花子。", [("山田 花子", "name")]),
    ("由濮阳蘅先生指出", [("濮阳蘅", "name")]),
]


@pytest.mark.parametrize(("text", "spans"), CASES)
def test_spans(text, spans):
    assert found(text) == spans


def test_checks():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.valid("dni", "12345678-Z") and not pii.valid("dni", "12345678A")
    assert pii.valid("han", "11010519491231002X") and not pii.valid("han", "110105194912310021")
    assert found("my card 4111 1111 1111 1111.") == [("4111 1111 1111 1111", "id")]
    for bad in ("my card 4111 1111 1111 1112.", "seen 1 85 05 78 006 084 99 there", "GB82 WEST 1234 5698 7654 33", "11010519491231002Y"):
        assert found(bad) == []
    assert found("IBAN GB82 WEST 1234 5698 7654 32, thanks") == [("GB82 WEST 1234 5698 7654 32", "id")] == found("to GB82 WEST 1234 5698 7654 32 today")
    assert found("IBAN GB82 WEST 1234 5698 7654 33, thanks") == [("GB82 WEST 1234 5698 7654 33", "id")]  # labelled: one with a slip
    assert found("identity number 4111 1111 1111 1112") == [("4111 1111 1111 1112", "id")]
    assert found("DE89 3704 0044 0532 0130 00 please") == [("DE89 3704 0044 0532 0130 00", "id")]


def test_redaction_keeps_the_rest():
    assert pii.redact("Dear Sarah Kasuski, mail a@b.example or ring 555-0195.") == "Dear [NAME], mail [EMAIL] or ring [PHONE]."
    assert pii.redact(None) is None and pii.redact("") == ""


@given(st.text(alphabet=st.sampled_from(list("aé@. 0195-+()Rosekamp\n日号区İ")), max_size=200))
@settings(max_examples=300, deadline=None)
def test_spans_are_in_order_and_inside(text):
    spans = pii.find_spans(text)
    assert all(0 <= a < b <= len(text) for a, b, _, _ in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    at, out = 0, []
    for a, b, kind, _ in spans:
        out += [text[at:a], pii.PLACEHOLDERS[kind]]
        at = b
    assert pii.redact(text) == "".join([*out, text[at:]])


def test_whole_long_texts():
    text = "word " * 200_000 + "a@b.example"
    assert found(text) == [("a@b.example", "email")]


def test_tables(spark):
    df = spark.createDataFrame([(1, "Dear Sarah Kasuski,", "x"), (2, None, "x"), (3, "", "x"), (None, "a@b.example", "x"), (1, "Dear Sarah Kasuski,", "x")], "doc_id bigint, text string, kind string")
    assert sorted((r["doc_id"] or 0, r["kind"], r["start_pos"], r["end_pos"]) for r in pii.found(df).collect()) == [(0, "email", 0, 11), (1, "name", 5, 18), (1, "name", 5, 18)]
    assert {(r["doc_id"], r["text"]) for r in pii.redacted(df).collect()} == {(1, "Dear [NAME],"), (2, None), (3, ""), (None, "[EMAIL]")}
    assert pii.found(df.where("false")).count() == 0


UNLISTED = [
    ("Otto Brandt said that it is rare", ["Otto Brandt"]),
    ("Hanna Meyer lives at home", ["Hanna Meyer"]),
    ("it was noticed by Otto Brandt and", ["Otto Brandt"]),
    ("according to Otto Brandt the word", ["Otto Brandt"]),
    ("ask for Hanna Meyer at the desk", ["Hanna Meyer"]),
    ("昨日、田中さんの話では", ["田中"]),
    ("李梅女士", ["李梅"]),
    ("王小明告诉我这个词", ["王小明"]),
    ("由褚明先生指出", ["褚明"]),
    ("so I agree with E. Gruber-Holm about it", ["E. Gruber-Holm"]),
    ("Form received: name OTTO BRANDT; mail", ["OTTO BRANDT"]),
    ("proof read by Brandt, Otto, and", ["Brandt, Otto"]),
    ("He said that. Nobody said that. Quien dijo eso. 有人告诉我", []),
    ("Please contact Sarah Thompson or Michael Rodriguez", ["Sarah Thompson", "Michael Rodriguez"]),
    ("Elizabeth Warren wrote that Ivan Petrov did not", ["Elizabeth Warren", "Ivan Petrov"]),
    ("Mark the stress. Rose, Lily and Fern are flowers. May is a month", []),
    ("Die Mehrzahl von Haus, der Artikel zu Garten", []),
]


@pytest.mark.parametrize(("text", "names"), UNLISTED)
def test_names_that_nobody_taught(text, names):
    assert [text[a:b] for a, b, kind, _ in pii.find_spans(text) if kind == "name"] == names


def test_what_a_collection_teaches(spark):
    lines = ["Dear Zorva Quimblet, thanks.", "As Zorva Quimblet said that, so be it.", "Best wishes, Zorva Trelk", "signed by Mardin Quimblet and more", "agree with Mardin Trelk about it", "Mr Trelk lives here", "a word from Dunville and the hills, in Dunville too"]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines * 2)] + [(99, None), (98, "")], "doc_id bigint, text string")
    names = pii.learn(docs)
    assert {"zorva", "mardin"} <= set(names.given) and {"quimblet", "trelk"} <= set(names.family) and "dunville" not in {*names.given, *names.family}
    text = "i met zorva trelk there; Trelk, Mardin came from Dunville"
    assert [text[a:b] for a, b, kind, _ in pii.find_spans(text, names) if kind == "name"] == ["zorva trelk", "Trelk, Mardin"]
    assert pii.learn(docs.where("false")) == nm.Names()
    # What closes letters by accident but mostly opens sentences is no name.
    odd = spark.createDataFrame([(i, "Best wishes, Glosses") for i in range(4)] + [(i + 9, "Here it is. Glosses are short.") for i in range(300)], "doc_id bigint, text string")
    assert "glosses" not in {*pii.learn(odd).given, *pii.learn(odd).family}
    assert pii.learn(docs, sample=7) is not None


def test_names_are_learnt_from_every_document(spark):
    # Three places among 40,003 documents (a part of 20,000 held some of them only), and none of the plain words is left out.
    told = ["Dear Zorva Quimblet, thanks.", "signed by Zorva Quimblet and more", "agree with Zorva Quimblet about it"]
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('card ', id) AS text").union(spark.createDataFrame([(40_000 + i, t) for i, t in enumerate(told)], "doc_id bigint, text string"))
    names = pii.learn(docs)
    assert names.given.get("zorva") == 0.6 == names.family.get("quimblet")
    text = "i met zorva quimblet there"
    assert [r["end_pos"] for r in pii.found(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), names).collect()] == [20]
    words = ["".join(chr(97 + n // 26**k % 26) for k in (3, 2, 1, 0)) for n in range(70_000)]
    names = pii.learn(spark.createDataFrame([(1, " ".join([*words, "zzplain"] * 2) + " Zzplain")], "doc_id bigint, text string"))
    assert names.plain == {"zzplain"}


def test_counts_of_words_are_those_of_the_tokens():
    lines = ["Dear Anna-Lena O'Rose, VAN der Berg and Van.", "the Cards, cards (Cards) an_Old X3Roses", "all lower", "İzmir Ärger ÄRGER Это Weg\u00a0Weg", "A. Rose"]
    both, each = nm.places(lines), nm.Counter()
    for line in lines:
        t = nm.Tokens(line, nm.Names(given={}), [])
        each.update(("c", x) for (_, _, w), role in zip(t.all, t.roles) if role == "N" for x in nm._HYPHEN.split(w.lower()) if len(x) > 1)
        each.update(("l", w) for w in nm._LOW.findall(line) if not line.islower())
    assert both == each and both["c", "cards"] == 2 and both["l", "cards"] == 1


def test_long_local_parts_and_streets():
    local, street = "x" * 300 + ".y", "Q" + "u" * 300
    assert found(f"write {local}@post.example now") == [(f"{local}@post.example", "email")]
    assert found(f"at {street}straße 7, a") == [(f"{street}straße 7", "address")]
    assert found(f"I live at 12 {street} Street, a") == [(f"12 {street} Street", "address")]


STREETS = [
    ("Im Winkel 5", ["Im Winkel 5"]), ("緑町2-4-7", ["緑町2-4-7"]), ("Zum Anger 12 b", ["Zum Anger 12 b"]), ("An der Lohe 3", ["An der Lohe 3"]), ("12, bd Voltaire", ["12, bd Voltaire"]),
    ("Im Jahr 2019 und im Bestand 5, 花町2019-05-04", []),
]


@pytest.mark.parametrize(("text", "streets"), STREETS)
def test_every_form_of_address_is_tried(text, streets):
    assert [s for s, kind in found(text) if kind == "address"] == streets
