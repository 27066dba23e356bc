import itertools
import random
import unicodedata

import numpy as np
import pytest

from keyloom.llm import langid
from keyloom.llm.langid import blank_markup, label_languages, label_resolver, marginals, words_of, wrong_or_missing

LANGS = [("de", "German", "Deutsch"), ("en", "English", "English"), ("fr", "French", "français"), ("ja", "Japanese", "日本語"), ("ru", "Russian", "русский")]
SENTENCES = {
    "de": ["Der alte Turm steht noch immer am Fluss.", "Wir haben gestern lange auf den Zug gewartet.", "Die Kinder spielen heute im Garten.", "Nächste Woche wird das Wetter schöner, sagt man."],
    "en": ["The old tower still stands by the river.", "We waited a long time for the train yesterday.", "The children are playing in the garden today.", "They say the weather will be nicer next week."],
    "fr": ["La vieille tour se dresse encore près de la rivière.", "Nous avons attendu longtemps le train hier.", "Les enfants jouent dans le jardin aujourd'hui.", "On dit que le temps sera plus beau la semaine prochaine."],
    "ja": ["古い塔は今も川のそばに立っています。", "昨日は長い間電車を待ちました。", "子供たちは今日庭で遊んでいます。"],
    "ru": ["Старая башня всё ещё стоит у реки.", "Вчера мы долго ждали поезда.", "Дети сегодня играют в саду."],
}
DDL = "doc_id bigint, text string, lang string, cells array<struct<cell_type:string,execution_count:int,char_from:int,char_to:int>>, label string, langs string"


def notebook(i, cells, label):
    text, spans = "", []
    for kind, body in cells:
        text += "# %%\n"
        spans.append((kind, None, len(text), len(text) + len(body)))
        text += body + "\n\n"
    return (i, text, label, spans, "x", "y")


def prose(rng, lang, n=4):
    return " ".join(rng.choice(SENTENCES[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    code = ("code", "for the_old in range(3):  # la vieille tour est dans le jardin\n    print('Der Turm steht')")
    docs, want = [], {}
    for i in range(240):
        lang = rng.choice(list(SENTENCES))
        label = rng.choice([lang, lang.upper(), f"{lang}-XX", dict((c, e) for c, e, _ in LANGS)[lang]])
        kind = rng.random()
        cells = [("markdown", f"# {prose(rng, lang, 1)}\n\n{prose(rng, lang)}"), code, ("markdown", prose(rng, lang)), ("output", prose(rng, "en"))]
        if kind < 0.08:
            label = rng.choice([None, "", "?", "utf-8", "python"])
            want[i] = {lang}
        elif kind < 0.16:
            label = rng.choice([x for x in SENTENCES if x != lang])
            want[i] = {lang}
        elif kind < 0.26:
            other = rng.choice([x for x in SENTENCES if x != lang])
            cells.append(("markdown", prose(rng, other, 7)))
            want[i] = {lang, other}
        if kind > 0.9:
            cells = [(k, unicodedata.normalize("NFD", b).replace("\n", "\r\n")) for k, b in cells]
        docs.append(notebook(i, cells, label))
    docs += [(900, None, "en", None, "", ""), (901, "", None, [], "", ""), notebook(902, [("code", "x")], None), notebook(903, [("markdown", "`only code` $x+y$ ![](data:image/png;base64,AAAA)")], "zz"), (904, "no cells here", None, None, "", "")]
    return label_languages(spark.createDataFrame(docs, DDL), spark.createDataFrame(LANGS, "code string, english_name string, own_name string"), per_label=30), docs, want


def test_found_against_truth(labelled):
    out, docs, want = labelled
    got = {}
    for r in wrong_or_missing(out).collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
        assert 0 < r.confidence <= 1
    wrong = {i for i in {*got, *want} if got.get(i) != want.get(i)}
    assert len(wrong) <= 2, {i: (got.get(i), want.get(i)) for i in wrong}
    assert out.count() == len(docs)


def test_stretches_cover_the_prose_in_order(labelled):
    out, docs, want = labelled
    text = {d[0]: d[1] for d in docs}
    for r in out.collect():
        last = 0
        for s in r.stretches:
            assert last <= s.char_from < s.char_to <= len(text[r.doc_id])
            last = s.char_to
        assert [s.lang for s in r.stretches] == [k for k, _ in itertools.groupby(s.lang for s in r.stretches)]
        assert bool(r.stretches) == bool(r.langs) and (not r.langs or abs(sum(x.share for x in r.langs) - 1) < 1e-9)
        if r.doc_id >= 900:
            assert not r.langs


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    k, lengths = 3, np.array([4, 1, 3])
    emit, trans, start = rng.normal(size=(8, k)) * 3, rng.normal(size=(2, k, k)), rng.normal(size=k)
    begins = rng.random(8) < 0.4
    p, expected, loglik = marginals(emit, begins, lengths, trans, start)
    want, want_e, total, at = np.zeros((8, k)), np.zeros((2, k, k)), 0.0, 0
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        score = np.array([start[y[0]] + sum(emit[at + t, y[t]] for t in range(n)) + sum(trans[int(begins[at + t]), y[t - 1], y[t]] for t in range(1, n)) for y in paths])
        z = np.log(np.exp(score).sum())
        total += z
        for y, s in zip(paths, score):
            for t in range(n):
                want[at + t, y[t]] += np.exp(s - z)
                if t:
                    want_e[int(begins[at + t]), y[t - 1], y[t]] += np.exp(s - z)
        at += n
    assert np.allclose(p, want) and np.allclose(expected, want_e) and np.isclose(loglik, total)


def test_windows_change_nothing_that_matters(monkeypatch):
    rng = np.random.default_rng(1)
    model = langid.Model(list("abc"), np.zeros((langid.BUCKETS, 3)), np.stack([np.eye(3) * 2, np.eye(3)]), np.zeros(3))
    vocab = langid.Vocabulary(model.weights)
    vocab.scores = rng.normal(size=(50, 3)) * 2
    rows, begins, lengths = rng.integers(0, 50, 3000), rng.random(3000) < 0.1, np.array([2000, 0, 1000])
    exact = marginals(vocab.scores[rows], begins, np.array([2000, 1000]), model.transitions, model.start)[0]
    assert np.abs(langid.label_words(model, vocab, rows, begins, lengths) - exact).max() < 1e-3


def test_labels_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = langid.Model(list("abc"), np.zeros((langid.BUCKETS, 3)), np.stack([np.eye(3) * 5] * 2), np.array([2.0, 0, 0]))
    vocab = langid.Vocabulary(model.weights)
    vocab.scores = rng.normal(size=(50, 3)) * 0.1
    rows, begins = rng.integers(0, 50, 800), rng.random(800) < 0.1
    alone = langid.label_words(model, vocab, rows[:200], begins[:200], np.array([200]))
    beside = langid.label_words(model, vocab, rows, begins, np.array([200, 600]))[:200]
    assert np.allclose(alone, beside, atol=1e-12)


def test_markup():
    body = "Text `code` and $x^2$ costs $5\n\n```py\nx = 1\n```\n![alt](a.png) [link](http://x.y/z) <b>bold</b> https://a.b/c $$\na\n$$ end"
    out = blank_markup(body)
    assert len(out) == len(body) and out.split() == ["Text", "and", "costs", "$5", "bold", "end"]
    words, starts, ends, begins = words_of("# A b. C\nd 日本語です。次")
    assert words == ["A", "b", "C", "d", "日本語で", "す", "次"] and begins == [True, False, True, True, False, False, True]
    assert all(a < b for a, b in zip(starts, ends)) and ends[2] == 8


def test_labels():
    r = label_resolver(LANGS)
    for label, code in {"de": "de", " DE": "de", "deu": "de", "ger": "de", "German": "de", "Francais": "fr", "français": "fr", "fr_CA": "fr", "en_US.UTF-8": "en", "日本語": "ja", "English (UK)": "en", "utf-8": None, "python": None, "ir": None, "?": None, "": None, "n/a": None, None: None}.items():
        assert r(label) == code, label


def test_empty_table_and_no_labels(spark):
    langs = spark.createDataFrame(LANGS, "code string, english_name string, own_name string")
    assert label_languages(spark.createDataFrame([], DDL), langs).count() == 0
    one = label_languages(spark.createDataFrame([notebook(1, [("markdown", "и это на русском языке, как и все. " * 3000)], None)], DDL), langs).collect()
    assert one[0].langs[0].lang == "ru"
