import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from wordmosaic.llm import mixing, subjects, tokenize

MODEL = f"{tokenize.TOKENIZERS}/byte_bpe_50k.json"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files here")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids if text else []


# Problem 7


@needs_model
@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert tokenize.encoder(tokenize.model_text(MODEL))([text]) == [library()(text)]


@needs_model
def test_odd_texts_and_order(spark):
    texts = ["", None, " ", "<|endoftext|>", "a" * 30_000, "x  y\t\t z\r\n", "naïve Straße 日本語 👩‍👩‍👧 é", "it's we'll 1234567890", "ab " * 9_000, "\x00\x01", "= " * 500 + "{{[["]
    data = [(k, t, "x", 5) for k, t in enumerate(texts)] + [(None, "null key", "x", 5), (0, "", "x", 5)]
    found = tokenize.token_ids(spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int")).collect()
    assert len(found) == len(data)
    lib = library()
    for r in found:
        want = "null key" if r["doc_id"] is None else texts[r["doc_id"]]
        assert r["ids"] == lib(want)
    counts = tokenize.token_counts(spark.createDataFrame(data, "doc_id long, text string, ids string, n_tokens int"))
    assert sorted(r["n_tokens"] for r in counts.collect()) == sorted(len(r["ids"]) for r in found)
    assert rows(tokenize.token_ids(spark.createDataFrame([], "doc_id long, text string"))) == []


@needs_model
def test_round_trip():
    m = tokenize.merges_of(tokenize.model_text(MODEL))
    parts = {i: bytes([b]) for b, i in enumerate(m.of_byte)}
    for (a, b), (_, new) in sorted(m.rank.items(), key=lambda x: x[1][0]):
        parts[new] = parts[a] + parts[b]
    text = "Der Wechselkurs fiel um 3,5 % — “naïve” \n\n tokens\ttoo 🙂"
    assert b"".join(parts[i] for i in tokenize.encoder(tokenize.model_text(MODEL))([text])[0]).decode() == text


@needs_model
def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "REMEMBERED", 3)
    encode = tokenize.encoder(tokenize.model_text(MODEL))
    lib = library()
    for t in ("one two three four five", "six seven", "one two"):
        assert encode([t]) == [lib(t)]
    assert list(tokenize.chunks(["ab", None, "cdef", "g", ""], 4)) == [(0, 3), (3, 5)]


# Problem 8


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 50, 200)
    sizes[:5] = 0
    p = rng.uniform(0, 1, 200)
    total = np.zeros(200)
    for k in range(400):
        done, held = mixing.pivotal(list(range(200)), sizes, p, np.random.default_rng(k))
        assert abs((sizes * done).sum() - (sizes * p).sum()) < 1e-6
        others = np.delete(done, held) if held >= 0 else done
        assert set(np.unique(others)) <= {0.0, 1.0}
        total += done
    assert np.abs(total / 400 - p).max() < 0.13


def mix_tables(spark, n=600):
    rng = np.random.default_rng(1)
    sizes = [(k, ["big", "mid", "tiny", "other", None][0 if k % 10 < 6 else 1 if k % 10 < 8 else 2 if k % 50 == 8 else 3], int(rng.integers(1, 90))) for k in range(n)]
    targets = [("Big ", 0.3, 1), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("absent", 0.1, 2), ("none", 0.0, 2), ("bad", None, 2), (None, 0.5, 1), ("mid", 0.1, 9)]
    return spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, "source string, target_weight double, max_repeat int")


@pytest.mark.parametrize("groups", [50_000, 20])
def test_mixture(spark, groups):
    sizes, targets = mix_tables(spark)
    mixed = mixing.mixture(sizes, targets, group_docs=groups, fan_in=3).cache()
    report = {r["source"]: r for r in mixing.share_report(mixed, sizes, targets).collect()}
    total = sizes.groupBy().sum("n_tokens").first()[0]
    for s, w in (("big", 0.3), ("mid", 0.4)):
        if report[s]["too_small"]:
            assert report[s]["reached_tokens"] == report[s]["tokens"] * report[s]["max_repeat"]
        else:
            assert abs(report[s]["reached_tokens"] - w * total) <= 90
    assert report["tiny"]["too_small"] and report["tiny"]["most_copies"] == 4 and report["tiny"]["reached_tokens"] == 4 * report["tiny"]["tokens"]
    assert report["absent"]["reached_tokens"] == 0 and report["absent"]["too_small"]
    assert {"none", "bad"} <= set(report) and not {None, "other"} & set(report)
    assert mixed.groupBy("doc_id").count().filter("count > 1").count() == 0
    again = mixing.mixture(sizes.repartition(7), targets, group_docs=groups, fan_in=3)
    assert rows(again) == rows(mixed)


def test_mixture_of_nothing(spark):
    sizes, targets = mix_tables(spark)
    assert rows(mixing.mixture(sizes.limit(0), targets)) == []
    assert rows(mixing.mixture(sizes, targets.limit(0))) == []
    assert mixing.share_report(mixing.mixture(sizes.limit(0), targets), sizes.limit(0), targets).count() == 6


@needs_model
def test_sized_documents(spark):
    data = [(1, "a b", " BIG "), (1, "a b c", "big"), (2, None, "mid"), (None, "x", "big"), (3, "", None)]
    found = mixing.sized_documents(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "big", 3), (2, "mid", 0), (3, None, 0)]


# Problem 9


def test_prose():
    text = """{{Infobox x | a = {{{b|}}} | orchestra
}}
'''Name''' (x): The [[verdict (Y)|Verdict]] was near.<ref>sonata p. 3</ref> A {{cn|date={{{d}}}}} plaintiff came. An earlier title of this page was "sonata".
== Compiler ==
* The telescope was seen again.
* Telescope Place
{| class="wikitable"
! Year !! n
|-
| genome || 3
|}
It should not be confused with the polymer of the same name. A picture of a sonata was once shown here by mistake.
<!-- orchestra. -->[[Category:Orchestra]]
"""
    found = subjects.sentences(text)
    assert [s.split(" ", 2)[:2] for s in found] == [["Name", "(x):"], ["A", "plaintiff"], ["The", "telescope"]]
    assert subjects.sentences("#REDIRECT [[Orchestra]]") == subjects.sentences(None) == subjects.sentences("  ") == []
    assert subjects.sentences("x" * 100_000 + ". The orchestra plays.")[-1] == "The orchestra plays."


def test_matches_are_longest_and_on_bounds():
    words = subjects.lexicon(subjects.listing())
    names = lambda parts: [(s, words.terms[t]) for s, t in words.matches(parts)]
    assert names(["The Tennis Court and the appeal courts.", "A rewarding wardrobe."]) == [(0, "tennis court"), (0, "appeal court")]
    assert names(["Kelor Brines kept brines."]) == [(0, "brine")]
    assert names(["İİ the orchestra"]) == [(0, "orchestra")]
    assert len(words.subjects) == 10
    assert names(["The goa#keeper left thezshareholdxr."]) == [(0, "goalkeeper"), (0, "shareholder")]
    assert names(["The goaxkeeper left."]) == []  # no sign of damage: another word


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, subject string, at int")


def test_subjects(spark):
    law, sport = "The verdict was near. ", "The goalkeeper was near. "
    texts = [law * 7 + sport * 3, law * 8 + sport * 2, "Nothing of note.", None, "", "#redirect [[Verdict]]", "The pitch was near. " + sport, "The pitch was near. The sonata ended. ", law + "The plaintiff met the goalkeeper and the defendant."]
    found = rows(subjects.subject_areas(documents(spark, texts)))
    assert found == [(0, "law"), (0, "sport"), (1, "law"), (6, "sport"), (7, "music"), (8, "law")]
    assert rows(subjects.subject_areas(documents(spark, []))) == []
    twice = documents(spark, [law]).unionAll(documents(spark, [law]))
    assert rows(subjects.subject_areas(twice)) == [(0, "law")]


#: Plain sentences, not drawn from the test tables.
PLAIN = [
    ("science", "The physicist measured the mass of the electron."),
    ("software", "The program was written in Java and runs on Linux."),
    ("food", "Bread is baked from flour, water and yeast."),
    ("history", "The king signed a treaty after the long war in the fourteenth century."),
    ("geography", "The river rises in the mountains and flows through three countries."),
    ("law", "The judge sentenced the man to five years in prison."),
    ("sport", "The striker scored twice in the second half of the match."),
    ("music", "She wrote two symphonies and a concerto for piano."),
    ("medicine", "The doctor prescribed a drug against the infection."),
    ("economy", "Prices rose because the central bank lowered rates."),
    ("science", "Plants turn sunlight into sugar through photosynthesis."),
    ("software", "Users can download the app and edit files in the browser."),
    ("food", "The cook adds onions and garlic to the soup."),
    ("history", "Roman soldiers built the fortress during the reign of Hadrian."),
    ("geography", "The island has about two thousand inhabitants and a small port."),
    ("law", "Parliament passed an act that made the practice illegal."),
    ("sport", "He won the gold medal at the Olympic Games."),
    ("music", "The band released its second album in May."),
    ("medicine", "Surgeons removed the tumour from her lung."),
    ("economy", "Unemployment fell while exports grew by four percent."),
    ("science", "Der Forscher untersuchte die Zelle unter dem Mikroskop."),
    ("software", "Das Programm wurde in einer neuen Programmiersprache geschrieben."),
    ("history", "Der König wurde nach der Schlacht gefangen genommen."),
    ("food", "Le cuisinier ajoute du beurre et de la farine à la pâte."),
    ("sport", "L'équipe a gagné le match en prolongation."),
    ("economy", "El desempleo subió y la inflación llegó al diez por ciento."),
    ("music", "La cantante grabó su primer álbum con una orquesta."),
    ("medicine", "Die Patienten wurden mit Antibiotika behandelt."),
    ("law", "El juez condenó al acusado a tres años de prisión."),
    ("geography", "Le fleuve se jette dans la mer près de la capitale."),
    ("none", "She walked home because it was late."),
    ("none", "The name has several spellings."),
    ("none", "He was born on a Tuesday and liked long walks."),
    ("none", "They met again after many years."),
]


def test_plain_sentences(spark):
    """Everyday sentences in four languages get their subject, and none where they have none."""
    found = {}
    for k, subject in rows(subjects.subject_areas(documents(spark, [t for _, t in PLAIN]))):
        found.setdefault(k, set()).add(subject)
    met = [subject in found.get(k, {"none"}) for k, (subject, _) in enumerate(PLAIN)]
    assert np.mean(met) >= 0.9
    assert all(k not in found for k, (subject, _) in enumerate(PLAIN) if subject == "none")


def test_everyday_words_need_company(spark):
    texts = ["The team was late.", "The team won the match.", "The cell was small.", "He measured the mass and the energy of it."]
    assert rows(subjects.subject_areas(documents(spark, texts))) == [(1, "sport"), (3, "science")]


def test_terms_of_the_text_language(spark):
    """Spanish "pan" is bread and French "but" a goal; neither is in an English text."""
    texts = ["The plan was good, but the pan was in the house and the four of us left.", "El pan de la casa se come con la sopa."]
    assert rows(subjects.subject_areas(documents(spark, texts))) == [(1, "food")]
    assert subjects.language_mask("the and der die") == 0b11


def test_calibration_on_labels(spark):
    docs = documents(spark, ["The verdict was near. "] * 6 + ["The team was here. "] * 6)
    labels = spark.createDataFrame([(k, " Law" if k < 6 else "sport") for k in range(12)] + [(None, "law"), (3, None), (99, "law")], "doc_id long, subject string")
    by = subjects.calibrated_weight(docs, labels, (1, 2, 3))
    assert by[1] > by[2] > by[3] and max(by[3]) == 0.0


def test_agreement_with_labels(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    found = {}
    for r in subjects.p9_found(spark, d).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    labels = {}
    for r in spark.read.parquet(f"{d}/doc_labels.parquet").filter("subject is not null").collect():
        labels.setdefault(r["doc_id"], set()).add(r["subject"].strip().lower())
    known = {r[0] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()}
    scored = [labels[k] == found.get(k) for k in labels if k in known]
    assert np.mean(scored) >= 0.9
