import random

from hypothesis import given, settings
from hypothesis import strategies as st

from deltarill.llm import leaks

ITEM = "The heavy teapot carried the old cellar beyond Heskford. So my brother broke the button without the faded sailor toward Wexhythe."
GERMAN = "Die Wirtin aus Wolfsmoor öffnete süße Karten vor der Kirche in Tannwerder und der Fremde zeigte kaputte Fässer."
RUSSIAN = "Учитель из города Березоград продавал тёплые яблоки возле церкви у станции Каменоречье и сети на рынке зимой."


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6))
def test_search_like_brute_force(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4)]
    items = [(i, [leaks.form(r.choice(words)) for _ in range(r.randrange(3, 9))]) for i in range(4)]
    text = [r.choice(words) for _ in range(40)]
    m = r.choice([1, 2, 4, 5])
    t = leaks.Tables(items, m)
    forms = [leaks.form(w) for w in text]
    want = {i for i, ws in items if any(ws[a : a + m] == forms[b : b + m] for a in range(len(ws) - m + 1) for b in range(41 - m))}
    assert t.search(t.ids(" ".join(text))) == want


def cues(text, *between):
    """A text as numbered cues of four words."""
    ws, out = text.split(), []
    for i in range(0, len(ws), 4):
        out.append(f"{i + 1}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n" + " ".join(ws[i : i + 4]))
        out += between
    return "\n\n".join(out)


def found(spark, docs, items=(ITEM, GERMAN, RUSSIAN)):
    d = spark.createDataFrame([(i, t, f, "x") for i, (t, f) in enumerate(docs)], "doc_id long, text string, cue_format string, item_id string")
    e = spark.createDataFrame([(10 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    return sorted(tuple(r) for r in leaks.leaks(d, e).collect())


def test_damage(spark):
    ocr = ITEM.replace("teapot", "leapot").replace("brother", "brolher").replace("old", "olcl").replace("button", "biitton").replace("So", "5o").replace("sailor", "sai!or")
    docs = [
        (cues(ITEM), "srt"), (cues(ITEM.upper(), "(thunder rumbling)", "♪ ♪", "<i>* phone rings *</i>", "[APPLAUSE]"), "srt"), (cues(ocr), "srt"),
        (cues(GERMAN.upper()), "srt"), (cues(GERMAN.encode().decode("latin-1")), "srt"), (cues(GERMAN.encode("latin-1").decode("cp437")), "srt"),
        (cues(GERMAN).replace("ö", "&ouml;").replace("ß", "?").replace("ü", "�"), "srt"), (cues(RUSSIAN.encode("koi8-r").decode("cp1251")), "srt"),
        (cues(RUSSIAN.encode("cp1251").decode("cp1252")), "srt"), ("{1}{2}" + ITEM.replace(" ", "|", 5), "sub"), (cues(ITEM).replace("\n", "\r\n"), "srt"),
        ("\n".join("- " + x if x[:1].isalpha() else x for x in cues(ITEM).split("\n")), "vtt"),
    ]
    assert found(spark, docs) == [(0, 10), (1, 10), (2, 10), (3, 11), (4, 11), (5, 11), (6, 11), (7, 12), (8, 12), (9, 10), (10, 10), (11, 10)]


def test_length_of_passages(spark):
    ws = ITEM.split()
    docs = [("x y " + " ".join(ws[3:15]) + " z", None), (" ".join(ws[3:14]) + " other words", None), (" ".join(ws[0:6]) + " but " + " ".join(ws[6:]), None)]
    assert found(spark, docs) == [(0, 10), (2, 10)]


def test_edge_cases(spark):
    long = "word " * 200_000 + ITEM + " word" * 200_000
    assert found(spark, [(None, None), ("", "srt"), (long, "srt"), (long, "srt")], (ITEM, ITEM, "too short", None, "")) == [(2, 10), (2, 11), (3, 10), (3, 11)]
    assert found(spark, []) == []
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks.leaks(d, none, cue_format=None).count() == 0


def test_many_items_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "ITEM_WORDS", 5)
    assert found(spark, [(ITEM, "srt"), (GERMAN, "srt")]) == [(0, 10), (1, 11)]
    monkeypatch.setattr(leaks, "KEPT_SIGNS", 5)
    assert found(spark, [(ITEM, "srt"), (GERMAN, "srt"), ("x", None), (ITEM, "srt")]) == [(0, 10), (1, 11), (3, 10)]


def test_long_markup_goes_and_open_brackets_stay():
    long = "[" + "a sound " * 60 + "]"
    assert leaks.spoken(f"1\n00:00:01,000 --> 00:00:02,000\n{long} stays\n\n2\n00:00:03,000 --> 00:00:04,000\nthis [ too\n\n3\nand ] this").split() == "stays this [ too and ] this".split()


def test_many_words_cost_about_the_same():
    """Compared windows per document do not grow with the number of item words, though the words are the same few thousand."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    docs = [r.choices(vocabulary, weights, k=400) for _ in range(30)]
    steps = {}
    for n in (12_000, 200_000):
        t = leaks.Tables([(0, [leaks.form(w) for w in r.choices(vocabulary, weights, k=n)])])
        looked = 0
        for d in docs:
            ids = t.ids(" ".join(d))
            for pos in range(leaks.MIN_WORDS, len(ids) + 1):
                by_prefix = t.ends.get(tuple(ids[pos - t.block : pos]), {})
                looked += len(by_prefix.get(tuple(ids[pos - t.m : pos - t.m + t.block]), ()))
        steps[n] = looked
    assert steps[200_000] <= 30 * 400 // 100
