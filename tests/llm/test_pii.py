import random

import pytest

from deltarill.llm import pii

NAMES = [("Hattie", "given", "en"), ("PERCY", "given", None), ("Jörg", "given", "de"), ("Will", "given", "en"), ("Marsh", "family", "en"), ("Brackwell", "family", "en"), ("Torfmeier", "family", "de"), ("Meadow", "family", "en"), (None, "given", "en")]


def corpus():
    """Documents that teach the statistics: labelled numbers, streets in frames, names beside names."""
    r = random.Random(4)
    out = []
    for i in range(60):
        out.append(f"Call me at ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}.\n\nTel. 030 {r.randrange(10000, 99999)} {r.randrange(100, 999)}")
        out.append(f"SSN: 9{r.randrange(10, 99)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}\n\nThe order number is 8842-1190.\n\nFlight 5550 leaves at 10:30.")
        out.append(f"Ich wohne Birkenweg {i + 1}.\n\nUnser Laden: Krähengasse {i + 1}\n\nIch wohne Hinterm Deich {i + 1}.")
        out.append(f"My name is Wilmot {r.choice(['Marsh', 'Brackwell', 'Torfmeier'])}.\n\nIn Quarlow we met.")
        out.append("Meet me at the Silver Meadow.")
    return out


CASES = {
    "Have you met Brackwell, Percy?": {("name", "Brackwell, Percy")},
    "My name is HATTIE MARSH-BRACKWELL.": {("name", "HATTIE MARSH-BRACKWELL")},
    "Herr J&ouml;rg T. wartet.": {("name", "J&ouml;rg T.")},
    "Herr JÃ¶rg Torfmeier wartet.": {("name", "JÃ¶rg Torfmeier")},
    "H. Marsh signed it.": {("name", "H. Marsh")},
    "Hattie\nMarsh is here, and Will waits.": {("name", "Hattie Marsh")},
    "Mail wilmot_ma12 (at) post.nord.example": {("email", "wilmot_ma12 (at) post.nord.example")},
    "It was sent from greer at mail dot tarn dot example when you land.": {("email", "greer at mail dot tarn dot example")},
    "Follow @nightcrew for more.": set(),
    "That's (212) 555-0163. I know.": {("phone", "(212) 555-0163")},
    "Die Nummer ist 030\n23125 661, merk sie dir.": {("phone", "030 23125 661")},
    "The form says 945-48-9676 and nothing more.": {("id", "945-48-9676")},
    "Order number 8842-1190 is ready. It cost 1,200,000 crowns.": set(),
    "They live at 18B Cobbler Way, Wexcombe.": {("address", "18B Cobbler Way")},
    "I grew up at 56 Foxley Ave. and left.": {("address", "56 Foxley Ave.")},
    "J'habite au 156 bis rue du Puits.": {("address", "156 bis rue du Puits")},
    "Vivo en Avda. Los Olmos 130.": {("address", "Avda. Los Olmos 130")},
    "Я живу: ул. Кленовая, д. 47.": {("address", "ул. Кленовая, д. 47")},
    "Fahren Sie zum Haus Hinterm Deich 19 b, sofort!": {("address", "Hinterm Deich 19 b")},
    "Rose Garden, Silver Meadow and Hattie alone.": set(),
    "12 men stood in the lane.": set(),
}


@pytest.fixture(scope="module")
def result(spark):
    texts = corpus() + list(CASES) + [None, "", "x " * 100_000 + "Percy Marsh"]
    docs = spark.createDataFrame([(i, t, "srt", "q") for i, t in enumerate(texts)], "doc_id long, text string, cue_format string, found string")
    names = spark.createDataFrame(NAMES, "name string, name_role string, lang string")
    found = pii.found_pieces(docs, names).cache()
    return docs, found, len(corpus())


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(NAMES, "name string, name_role string, lang string")


@pytest.mark.parametrize("text", list(CASES))
def test_case(result, text):
    _, found, first = result
    got = {(r.pii_type, r.found) for r in found.where(found.doc_id == first + list(CASES).index(text)).collect()}
    assert got == CASES[text]


def test_learned_name_and_long_text(result):
    docs, found, first = result
    assert found.where("found like 'Wilmot %' and pii_type = 'name'").count() == 60
    assert found.where("found = 'Silver Meadow'").count() == 0
    assert [r.found for r in found.where(found.doc_id == first + len(CASES) + 2).collect()] == ["Percy Marsh"]


def test_redaction(spark, result, names, monkeypatch):
    docs, found, first = result
    out = {r.doc_id: r for r in pii.redact(docs, names).collect()}
    assert len(out) == docs.count()
    at = lambda t: out[first + list(CASES).index(t)].text
    assert at("Die Nummer ist 030\n23125 661, merk sie dir.") == "Die Nummer ist [PHONE], merk sie dir."
    assert at("Herr J&ouml;rg T. wartet.") == "Herr [NAME] wartet."
    assert at("12 men stood in the lane.") == "12 men stood in the lane." and out[first + len(CASES)].text is None
    # the pieces are those that are reported
    want = {(r.doc_id, r.pii_type) for r in found.collect()}
    assert {(i, k) for i, r in out.items() if r.text for k in pii.KINDS if f"[{k.upper()}]" in r.text} == want
    # so many terms that they are not sent to the tasks
    monkeypatch.setattr(pii, "MAX_TERMS", 1)
    assert {r.doc_id: (r.text, r.n_pieces) for r in pii.redact(docs, names).collect()} == {i: (r.text, r.n_pieces) for i, r in out.items()}


def test_redaction_keeps_words_whole(spark, names):
    d = spark.createDataFrame([(1, "Percy Marsh met Percy Marshall. Percy Marsh left."), (2, "Mary. Hattie J. Marsh and J. Marsh."), (1, "Percy Marsh again")], "doc_id long, text string")
    out = [(r.text, r.n_pieces) for r in pii.redact(d, names, cue_format=None).orderBy("doc_id", "text").collect()]
    assert out == [("[NAME] again", 1), ("[NAME] met Percy Marshall. [NAME] left.", 2), ("Mary. [NAME] and [NAME].", 2)]


def test_the_threshold_decides(spark, result, names):
    docs, found, _ = result
    key = lambda df: {(r.doc_id, r.pii_type, r.found) for r in df.collect()}
    usual, none, all_ = key(found), key(pii.found_pieces(docs, names, threshold=float("inf"))), key(pii.found_pieces(docs, names, threshold=float("-inf")))
    assert not none and usual < all_ | usual
    for kind in ("name", "id", "address", "email"):  # decided by the corpus, not by form
        assert {x for x in all_ if x[1] == kind} - usual, kind
    assert len(all_ - usual) > 150


def test_the_corpus_decides(spark, names):
    """The same piece is protected in one corpus and not in another, each without a label or list of its own."""
    def found(texts):
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {(r.doc_id, r.found) for r in pii.found_pieces(d, names, cue_format=None).collect()}

    number = "It says 8842-1190 there."
    assert (0, "8842-1190") in found([number] + [f"My phone is {1000 + i}-{2000 + i}." for i in range(5)])
    assert (0, "8842-1190") not in found([number] + [f"The order is {1000 + i}-{2000 + i}." for i in range(5)])
    name = "Wilmot Oakes is here."
    known = ["Wilmot Marsh", "Wilmot Brackwell", "Wilmot Torfmeier", "Hattie Oakes", "Percy Oakes", "Will Oakes"]
    assert (0, "Wilmot Oakes") in found([name, *known])
    assert (0, "Wilmot Oakes") not in found([name, *known[:1], *known[3:4]])
    street = "The taxi stopped by Hinterm Deich 9."
    assert (0, "Hinterm Deich 9") in found([street, "Ich wohne Hinterm Deich 4.", "Ich wohne Birkenweg 3.", "Ich wohne Krähengasse 8."])
    assert (0, "Hinterm Deich 9") not in found([street, "Ich sah Hinterm Deich 4 Leute.", "Ich wohne Birkenweg 3."])


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, cue_format string")
    names = spark.createDataFrame(NAMES, "name string, name_role string, lang string")
    assert pii.found_pieces(docs, names).count() == 0
    one = spark.createDataFrame([(1, "Mail a@b.example, Hattie Marsh", None)], docs.schema)
    assert {r.pii_type for r in pii.found_pieces(one, names.limit(0)).collect()} == {"email"}


def test_places_in_damaged_text():
    text = "Mäntel &amp; Jörg".encode().decode("latin-1")
    meant, at = pii.meant(text)
    assert meant == "Mäntel & Jörg" and text[at[meant.index("J")] :].startswith("J")
    ru = "Меня зовут Демьян Ветлугин, и это моя новая работа"
    for n in (17, 49):  # short texts too
        for wrong, right in (("cp1251", "koi8-r"), ("cp1252", "cp1251"), ("koi8-r", "cp1251")):
            assert pii.meant(ru[:n].encode(right).decode(wrong))[0] == ru[:n], (n, wrong)
    for plain in (ru, "Les élèves étaient là, à côté du hôtel où l'été brûlait déjà.", "Über die größten Bäume läuft ein Mädchen.", "œuvre ÄÖÜ éééé"):
        assert pii.meant(plain)[0] == plain


def numbers_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'srt' as cue_format")
    names = spark.createDataFrame(NAMES, "name string, name_role string, lang string")
    return {(r.doc_id, r.pii_type, r.found) for r in pii.found_pieces(docs, names).collect()}


def test_labelled_numbers_stay_whatever_their_share(spark):
    phones = [f"Tel. 030 {10000 + i} {100 + i}" for i in range(90)]
    ids = [f"SSN: 9{10 + i}-{10 + i}-{1000 + i}" for i in range(10)]
    plain = ["The number 030 99999 999 is mine.", "The form says 945-48-9676 and nothing more."]
    want = {(i, "phone", t[5:]) for i, t in enumerate(phones)} | {(90 + i, "id", t[5:]) for i, t in enumerate(ids)}
    assert numbers_of(spark, phones + ids + plain) == want | {(100, "phone", "030 99999 999"), (101, "id", "945-48-9676")}
    assert numbers_of(spark, ["Tel. 030 12345 678"]) == {(0, "phone", "030 12345 678")}
    # its shape is mostly one of things
    things = [f"The order number is {8842 + i}-1190." for i in range(9)]
    assert numbers_of(spark, [*things, "SSN: 9945-4896", "It says 7745-4896 there."]) == {(9, "id", "9945-4896")}
