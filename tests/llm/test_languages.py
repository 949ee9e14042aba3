import numpy as np
import pytest

from tallyforge.llm import charmodel, languages

EN = "The review checklist leaves a stuck process behind. The tray menu refuses to load when the network is down."
DE = "Das Einstellungsfenster verweigert den Start seit der letzten Aktualisierung. Der Prüfbericht verlangt unnötige Rechte."
RU = "Первый рецензент назвал отсутствующую зависимость. Второй осмотр ничего не измерил во время работы."
ZH = "安装脚本每次尝试时拒绝启动。设置窗口与校验值不一致。"


def test_probabilities_add_up():
    words = {"abc": 3, "abd": 2, "b": 1}
    m = charmodel.fit({"x": words, "y": {"zz": 4}}, order=3)
    letters = "abcdz "
    # the chance of a first letter: all seen letters and the rest of the alphabet
    codes = {c: m.grams[0][0] for c in letters}
    assert codes
    one = np.exp(m.score([c for c in "abcdz"]))
    assert one[1, 0] > one[0, 1] and np.all(one < 1) and np.all(one > 0)
    best = m.score(["abc", "zz"])
    assert best[0].argmax() == 0 and best[1].argmax() == 1
    assert m.score([]).shape == (0, 2)


def test_clauses_leave_code_out():
    text = "# ember.tray-x\n\nRead the file src/Main.qml now, please.\n```sh\nsudo make it\n```\nThe tab called «Сохранить» is v1.2 wide https://x.y/z `code here`"
    assert read([text]) == [(0, "read the file now"), (0, "please"), (0, "the tab called is wide")]
    assert read(["", "`x` 12 a/b", "Мир-2.0-beta v1x x_y 2-foo foo-2 naïve", "Да"]) == [(2, "мир foo naïve"), (3, "да")]
    assert read([]) == [] == read(["", ""])


def read(texts):
    c = languages.clauses(texts)
    return [(int(t), " ".join(c.words[w] for w in c.word[c.clause == k])) for k, t in enumerate(c.text)]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, EN if i % 3 else EN.upper(), "en" if i % 5 else "de") for i in range(40)] + [(100 + i, DE, "German") for i in range(20)] + [(200 + i, RU, "ru-RU") for i in range(20)]
    rows += [(300, f"{EN} {RU}\n\n{EN}", "en"), (301, f"{ZH}{DE}", "zh"), (302, None, "en"), (303, "", None), (304, "`code` 12 src/x.qml", "en"), (305, EN + " The tab called 設定 is too wide.", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    return {(r.doc_id, r.seg_no): r for r in languages.segments(docs, languages.train(docs)).collect()}


def test_segments(found):
    assert [found[300, i].lang for i in range(3)] == ["en", "ru", "en"] and [found[301, i].lang for i in range(2)] == ["zh", "de"]
    assert found[301, 1].start >= len(ZH) - 1 and found[305, 0].n_segs == 1 and found[0, 0].lang == "en"
    assert not {302, 303, 304} & {k[0] for k in found}
    assert all(0 < r.confidence <= 1 for r in found.values())


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "English": "en", "pt-BR": "pt", "ko_KR": "ko", "zho": "zh", " de ": "de", "xx": None, "": None, None: None, "nl": None, "n/a": None}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r[0]: r[1] for r in df.select("l", languages.known_label(df.l)).collect()} == cases


def test_held_out_sentences(spark):
    """Models that saw half of the labelled documents name the language of the other half."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    models = languages.train(docs.where("doc_id % 2 = 0"))
    held = languages.segments(docs.where("doc_id % 2 = 1"), models).where("n_segs = 1").withColumn("known", languages.known_label(languages.F.col("label"))).where("known is not null")
    assert held.where("known = lang").count() >= 0.9 * held.count()  # labels themselves are wrong now and then


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert languages.segments(docs, languages.train(docs)).count() == 0


def test_best_paths_against_all_paths():
    """The paths of many texts at once, against every path of each."""
    import itertools

    rng = np.random.default_rng(3)
    text = np.repeat([0, 2, 3, 7], [4, 1, 5, 3])
    scores, ends = -rng.random((13, 3)) * 40, rng.random(13) < 0.5
    c = languages.Clauses(text, text, text, ends, text, text, text, text, text, text, [])
    got = languages.paths(c, scores)
    for t in (0, 2, 3, 7):
        mine = np.flatnonzero(text == t)
        cost = {p: sum(scores[i, k] for i, k in zip(mine, p)) - sum((languages.SWITCH if ends[i] else languages.SWITCH_INSIDE) for i, a, b in zip(mine[1:], p, p[1:]) if a != b) for p in itertools.product(range(3), repeat=len(mine))}
        assert cost[tuple(got[mine])] == pytest.approx(max(cost.values()))


FOREIGN = ["Okno ustawień odmawia uruchomienia po ostatniej aktualizacji. Raport kontrolny żąda niepotrzebnych uprawnień.", "Asetusikkuna kieltäytyy käynnistymästä viimeisimmän päivityksen jälkeen. Tarkastusraportti vaatii tarpeettomia oikeuksia.", "نافذة الإعدادات ترفض التشغيل منذ آخر تحديث. يطلب تقرير الفحص أذونات غير ضرورية."]
EVERYDAY = {
    "en": "Yesterday we went to the lake with the children because the weather was finally fine.", "de": "Gestern sind wir mit den Kindern zum See gefahren, weil das Wetter endlich wieder schön war.",
    "es": "Ayer fuimos con los niños al lago porque por fin hacía buen tiempo.", "fr": "Hier nous sommes allés au lac avec les enfants parce qu'il faisait enfin beau.",
    "ja": "昨日、天気がようやく良くなったので子供たちと湖へ行きました。", "zh": "昨天天气终于好了，所以我们带孩子们去了湖边。",
}


def test_rejection_and_confidence(spark):
    """Languages without a model are unknown, texts about something else are not; and confidence follows how often labels are right."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    models = languages.train(docs)
    more = [(-1 - i, t, None) for i, t in enumerate(FOREIGN)] + [(-100 - i, t, None) for i, t in enumerate(EVERYDAY.values())] + [(-200, "Ja", None)]
    rows = languages.segments(docs.unionByName(spark.createDataFrame(more, docs.schema)), models).where("doc_id < 0").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [{(r.lang, r.seg_no) for r in by[-1 - i]} for i in range(len(FOREIGN))] == [{("unknown", None)}] * len(FOREIGN)
    assert [{r.lang for r in by[-100 - i]} for i in range(len(EVERYDAY))] == [{x} for x in EVERYDAY]
    assert by[-200][0].lang == "unknown" and by[-200][0].confidence == 0.5
    raw = languages.measured(docs, models)
    t = languages.calibrate(raw, models.unseen).temperature
    table = languages.reliability(raw).collect()
    assert sum(r.n for r in table) > 500
    for r in table:
        if r.n >= 30:
            assert abs(r.agreed / r.n - 1 / (1 + np.exp(-(r.bin + 0.25) / t))) < 0.15
