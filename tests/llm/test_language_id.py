import numpy as np
import pyarrow as pa
import pytest

from siftstone.llm.language_id import MARGIN, fit, train

TEXTS = {
    "ru": ["это было очень хорошее утро и мы пошли в город", "он сказал что завтра будет дождь и ветер", "мы ещё не знаем где она живёт сейчас", "книга лежит на столе возле окна"],
    "uk": ["це був дуже гарний ранок і ми пішли до міста", "він сказав що завтра буде дощ і вітер", "ми ще не знаємо де вона живе зараз", "книжка лежить на столі біля вікна"],
    "el": ["ήταν ένα πολύ ωραίο πρωί και πήγαμε στην πόλη", "είπε ότι αύριο θα βρέξει και θα φυσάει", "δεν ξέρουμε ακόμα πού μένει τώρα", "το βιβλίο είναι στο τραπέζι"],
    "zh": ["今天早上天气很好我们去了城里", "他说明天会下雨刮风", "我们还不知道她现在住在哪里", "书在窗边的桌子上"],
    "hi": ["आज सुबह बहुत अच्छी थी और हम शहर गए", "उसने कहा कि कल बारिश होगी", "हमें अभी नहीं पता वह कहाँ रहती है", "किताब मेज़ पर है"],
    "pl": ["to był bardzo piękny ranek i poszliśmy do miasta", "powiedział że jutro będzie deszcz i wiatr", "jeszcze nie wiemy gdzie ona teraz mieszka", "książka leży na stole przy oknie"],
    "cs": ["bylo to velmi krásné ráno a šli jsme do města", "řekl že zítra bude déšť a vítr", "ještě nevíme kde teď bydlí", "kniha leží na stole u okna"],
}
UNSEEN = {"ru": "мы сказали что книга была очень хорошая", "uk": "ми сказали що книжка була дуже гарна", "el": "είπε ότι το βιβλίο είναι πολύ ωραίο", "zh": "他说今天天气很好", "hi": "हमें पता है कि किताब अच्छी है", "pl": "powiedział że książka jest bardzo piękna", "cs": "řekl že kniha je velmi krásná"}


@pytest.fixture(scope="module")
def model():
    return fit([t for texts in TEXTS.values() for t in texts], [lang for lang, texts in TEXTS.items() for _ in texts])


@pytest.mark.parametrize("lang", UNSEEN)
def test_languages_of_any_script_are_told_apart(model, lang):
    s, known = model.scores(pa.array([UNSEEN[lang]]))
    assert known[0]
    assert model.languages[int(s[0].argmax())] == lang


def test_text_declared_as_another_script_is_rejected(model):
    s, _ = model.scores(pa.array([UNSEEN["uk"]]))
    assert s[0].max() - s[0][model.languages.index("el")] > MARGIN


def test_kernel_is_the_blended_spectrum_one():
    def spectrum(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower())
        return {t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1)}

    texts = ["Добрий день, світе", "dzień dobry, świecie!", "καλημέρα κόσμε", "早上好世界", ""]
    k, letters = fit(texts[:4], list("abcd")).kernel(pa.array(texts))
    marks = [texts[n] for n in range(4)]
    for i, x in enumerate(texts):
        for j, y in enumerate(marks):
            a, b = spectrum(x), spectrum(y)
            assert np.isclose(k[i, j], len(a & b) / np.sqrt(max(1, len(a)) * len(b)), atol=1e-5)
    assert letters.tolist() == [True] * 4 + [False]


def test_rare_language_is_in_the_bounded_sample(spark):
    rows = [(k, f"the common text number {k} of many", "en") for k in range(300)]
    docs = spark.createDataFrame([*rows, (1000, TEXTS["el"][0], "el"), (1001, "", "fr")], "doc_id bigint, text string, lang string")
    model = train(docs, sample=20)
    assert model.languages == ["el", "en"]
    assert len(model.norms) <= 20
