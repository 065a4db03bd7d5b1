import random

import pytest

from factloom.llm import encoding as e

CLEAN = {
    "fr": "Le garçon voulait réparer la forêt brûlée où ça s’arrête, dès février… élève été château crème déjà",
    "de": "Das Mädchen öffnete früher die schöne Brücke während der Prüfung größte Straße Kälte zwölf Äpfel",
    "ru": "Старый моряк хочет вернуть последний фонарь без причины — Твоя сестра видела тёплое пальто",
    "el": "Ο αδελφός μου βρήκε το παλιό ρολόι μετά τη βροχή χωρίς λόγο κανείς εδώ",
    "pl": "Żołnierz przyniósł święty obraz później źródło żółtą łódź mąkę znalazł już",
    "tr": "Öğretmen görmüş şu küçük kutuyu gümüş yüzüğü köprüde ışığı kardeşim",
    "es": "El señor escondió la canción según él ¿verdad? montaña también corazón jamás",
    "en": "They can’t open the naïve plan “since the flood” – René’s café ♪",
    "is": "Bróðir minn þráði það sem týndist þegar veðrið lægði fyrir dögun",
}


@pytest.fixture(scope="module")
def scorer():
    words: dict = {}
    rng = random.Random(1)
    for text in CLEAN.values():
        for w in e.words_of(text):
            words[w] = words.get(w, 0) + 200 + rng.randrange(50)
    return e.Scorer(e.Model(e.count_pairs(words)))


@pytest.mark.parametrize("lang", CLEAN)
def test_clean_text_is_no_case(scorer, lang):
    assert e.label(scorer, CLEAN[lang]) == []
    assert e.label(scorer, "╔═══╗ ║ " + CLEAN[lang] + " ╚═══╝") == []


PAIRS = [("fr", "utf-8", "cp1252"), ("de", "utf-8", "cp437"), ("ru", "utf-8", "cp1251"), ("el", "utf-8", "cp1253"), ("pl", "utf-8", "mac-roman"), ("es", "utf-8", "cp850"), ("en", "utf-8", "latin-1"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1251"), ("el", "iso8859-7", "latin-1"), ("pl", "cp1250", "cp1252"), ("tr", "cp1254", "latin-1"), ("fr", "cp1252", "mac-roman"), ("de", "cp1252", "cp850")]


@pytest.mark.parametrize("lang,true,seen", PAIRS)
def test_found_and_restored(scorer, lang, true, seen):
    text = CLEAN[lang]
    raw = text.encode(true, "ignore")
    wrong = "".join(e._table(seen)[b] for b in raw)
    whole = f"1\n00:01 --> 00:02\n{wrong}\n\nplain line"
    spans = e.label(scorer, whole)
    assert spans
    got = e.restored(whole, spans)
    want = raw.decode(true).split()
    assert sum(w in got.split() for w in want) >= 0.9 * len(want), got


def test_read_wrongly_twice(scorer):
    wrong = CLEAN["fr"].replace("’", "'").replace("…", ".")
    for _ in range(2):
        wrong = wrong.encode("utf-8").decode("latin-1")
    assert "réparer la forêt brûlée" in e.restored(wrong, e.label(scorer, wrong))


def test_lost_characters_are_found(scorer):
    spans = e.label(scorer, "Le gar�on")
    assert [s[2][0] for s in spans] == [e.LOST] and e.restored("Le gar�on", spans) == "Le gar�on"


def test_one_bad_line_only(scorer):
    text = CLEAN["es"] + "\nMi tÃ\xada enseÃ±Ã³ la canciÃ³n.\n" + CLEAN["es"]
    assert e.restored(text, e.label(scorer, text)) == CLEAN["es"] + "\nMi tía enseñó la canción.\n" + CLEAN["es"]


def test_long_words_and_small_table(scorer, monkeypatch):
    monkeypatch.setattr(e, "MEMO", 2)
    assert e.label(scorer, "é" * 10_000 + " " + CLEAN["fr"]) is not None


def test_dataframe(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN.values())] * 30
    rows += [(100, "JoÃ£o canÃ§Ã£o", "x"), (101, None, "x"), (102, "", "x"), (103, "ascii", "x"), (None, "caf�", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    got = {r.doc_id: r for r in e.wrongly_decoded(df, "doc_id", "text").collect()}
    assert set(got) == {100, None} and got[100].restored == "João canção" and got[None].states == ["lost"]
    assert e.wrongly_decoded(df.limit(0), "doc_id", "text").collect() == []


def test_words_that_both_encodings_write_alike_cost_nothing(scorer):
    # a-acute and e-acute are the same in cp1250 and cp1252, o-umlaut and u-umlaut in cp1254 and cp1252.
    for pair, words in ((("cp1250", "cp1252"), ["já", "é", "ná"]), (("cp1254", "cp1252"), ["köprü", "gümüş".replace("ş", "s")])):
        assert scorer.score(words)[:, scorer.column[pair]].tolist() == [0.0] * len(words)
    # A character that the wrong encoding does not have cannot come from it.
    assert scorer.score(["ж"])[0, scorer.column["cp1250", "cp1252"]] == -e.IMPOSSIBLE


def test_weakly_damaged_words_among_words_written_alike(scorer):
    gain = scorer.score(["þu"])[0, scorer.column["cp1254", "cp1252"]]
    assert 0 < gain < e.IMPOSSIBLE
    text = " ".join(["þu", "için", "él"] * 8)
    assert e.restored(text, e.label(scorer, text)) == " ".join(["şu", "için", "él"] * 8)


def test_long_runs_are_cut_between_sequences():
    text = "".join(chr(0x4E00 + i % 500) for i in range(700)).encode().decode("latin-1")
    cuts = e.parts_of(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert all(b - a <= e.LONGEST and not 0x80 <= ord(text[a]) <= 0xBF for a, b in cuts)
    assert "".join(e.words_of(text)) == text
