"""Problem 1."""

import random

import pytest

from tidewrack.llm import languages as G

SENT = {
    "en": "The council of the town said that the plan would be ready by the end of the year",
    "de": "Der Rat der Stadt sagte, dass der Plan noch vor dem Ende des Jahres fertig wird",
    "fr": "Le conseil de la ville a dit que le projet sera prêt avant la fin de cette année",
    "es": "El consejo de la ciudad dijo que el plan estará listo antes del final de este año",
    "vi": "Hội đồng thành phố cho biết kế hoạch sẽ sẵn sàng trước khi kết thúc năm nay",
    "th": "สภาเมืองกล่าวว่าแผนจะพร้อมก่อนสิ้นปีนี้",
    "zh": "市议会表示，该计划将在今年年底前准备就绪。",
    "ja": "市議会は、計画は今年の終わりまでに準備ができると述べた。",
}


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(1)
    texts = []
    for lang, s in SENT.items():
        words = s.split()
        for _ in range(40):
            texts.append((s if lang in ("th", "zh", "ja") else " ".join(rnd.sample(words, len(words))) + ".", lang))
    rnd.shuffle(texts)
    wrong = [(t, "de" if lang == "en" and k % 9 == 0 else lang) for k, (t, lang) in enumerate(texts)]
    return G.LanguageField().fit(wrong, epochs=2)


def test_names():
    assert [G.named_language(x) for x in ("en_US", "Deutsch", "zh-Hans", "jp", "castellano", "tiếng Việt", "ภาษาไทย", " EN ")] == ["en", "de", "zh", "ja", "es", "vi", "th", "en"]
    assert [G.named_language(x) for x in (None, "", " ", "und", "pt", "mul", "xx", "N/A", "auto")] == [None] * 9


def test_whole_and_mixed(spark, field):
    rows = [(k, s, k2) for k, (k2, s) in enumerate(SENT.items())]
    mixed = [(100, SENT["en"] + ". " + SENT["de"] + ".", "en"), (101, SENT["th"] + " " + SENT["en"] + ".", "th"), (102, None, "en"), (103, "", None), (104, " \n", "x"), (105, "12 34", "en"), (106, SENT["zh"], "unknown"), (107, SENT["th"] + " Smart City", "th"), (106, SENT["zh"], "unknown")]
    df = spark.createDataFrame([(*r, "clash") for r in rows + mixed], "summary_id bigint, summary string, language string, rec string")
    got = {}
    for r in G.mislabelled(df, field, "summary_id", "summary", "language").collect():
        got.setdefault(r.summary_id, set()).add(r.lang)
        assert 0 < r.confidence <= 1
    assert got == {100: {"en", "de"}, 101: {"th", "en"}, 106: {"zh"}}


def test_passages_and_empty(spark, field):
    df = spark.createDataFrame([(1, SENT["en"] + ". " + SENT["fr"] + ".")], "id bigint, t string")
    p = sorted((r.start_pos, r.lang) for r in G.passages(df, field, "id", "t").collect())
    assert p == [(0, "en"), (len(SENT["en"]) + 2, "fr")]
    assert G.passages(df.limit(0), field, "id", "t").count() == 0
    assert G.LanguageField().fit([]).w.shape[1] == 8


def test_long_text(field):
    out = G.Tagger(field).sentences([(SENT["en"] + ". ") * 2000, "", SENT["ja"]])
    assert len(out[0]) == 2000 and out[1] == [] and G.languages_of(out[2]).keys() == {"ja"}


def test_no_text_or_segment_without_passage(spark, field):
    notes = "Plan ready\nThe year\nEnd said"
    rows = [(1, "请启用JavaScript后继续浏览。"), (2, notes), (3, "Yes.\n" + SENT["en"] + ". " + SENT["fr"] + ".\nOui, oui."), (4, SENT["de"] + ". Nein. " + SENT["th"] + " Smart City"), (5, ""), (6, None), (7, "12 34"), (8, "Plan")]
    got = {}
    for r in G.passages(spark.createDataFrame(rows, "id bigint, t string"), field, "id", "t").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.end_pos, r.lang))
        assert 0 < r.confidence <= 1
    assert got.keys() == {1, 2, 3, 4, 8}
    assert len(got[1]) == 1 and got[1][0][:2] == (0, len(rows[0][1]))
    assert len(got[2]) == 1 and got[2][0][:2] == (0, len(notes))
    first, last = sorted(got[3])
    assert first[0] == 0 and first[2] == "en" and last[1] == len(rows[2][1]) and last[2] == "fr"
    assert [x[2] for x in sorted(got[4])] == ["de", "th"]
