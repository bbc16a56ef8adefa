"""Problem 9: the subject areas of each document.

Method: curated, weighted subject terms are found by a multi-pattern automaton in the
prose of a text, terms of the text's language only. A term has a curated weight (2 if it
names a subject by itself, 1 for an everyday word that needs company) and weighs more the
longer and the rarer in the corpus it is; a sentence is about the subject with most
weight, if its curated weights reach a calibrated sum; a document gets every subject that
reaches the asked share of its subject sentences.

Texts are read once: the first pass writes the matches (sentence, term) of each
document, from which both the term statistics of the whole corpus and the result
are made.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import ne
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmosaic.session import written

#: Curated terms by subject, language and weight; a term listed under two subjects with one weight is ambiguous.
TERMS = Path(__file__).with_name("subject_terms.json")
#: Share of the subject sentences at which a document has a subject, in hundredths.
LEAST_SHARE = 30

#: Sum of curated weights a sentence needs, calibrated by :func:`calibrated_weight` on labelled documents.
LEAST_WEIGHT = 2

REDIRECT = re.compile(r"\s*#\s*(redirect(ion)?|weiterleitung|redirecci[oó]n)\b", re.I)
#: A letter beside a sign or digit that belongs in no word: the text is damaged, and terms are also found with letters replaced.
DAMAGE = re.compile(r"[#@$%~^¤\ufffd](?:(?<=[^\W\d_].)|(?=[^\W\d_]))|\d(?<=[^\W\d_].)(?=[^\W\d_])")
#: Shortest term looked for in damaged form.
LEAST_DAMAGED = 8
#: How sentences about the page itself speak, in the four languages: hatnotes, titles, pictures, moves of the page.
ABOUT_PAGE = (
    "not be confused with|not to be confused with|of the same name|other uses|disambiguation|redirects here|redirect here|redirects to|this page|the page|this article|"
    "the article|this stub|of this page|of this article|earlier title|former title|previous title|old title|earlier titles|former titles|picture of|image of|photo of|"
    "photograph of|drawing of|picture showing|image showing|photo showing|shown here|displayed here|uploaded here|by mistake|"
    "nicht zu verwechseln|verwechselt werden mit|begriffsklärung|diese seite|dieser seite|dieser artikel|dieses artikels|früherer titel|frühere titel|ein bild|dieses bild|hier gezeigt|versehentlich|"
    "ne pas confondre|ne doit pas être confondu|ne doit pas être confondue|du même nom|homonymie|cette page|cet article|ancien titre|titre précédent|une image de|une photo de|montré ici|montrée ici|par erreur|"
    "no debe confundirse|no confundir|del mismo nombre|desambiguación|esta página|este artículo|título anterior|antiguo título|una imagen de|una foto de|mostrado aquí|mostrada aquí|por error"
).split("|")
#: Function words by which a text's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is was were has have had that for with as by from been than not which its an be are on",
    "de": "der die das und ist war wurde von mit den dem des ein eine nicht auf für als im zu sich wird auch er sie",
    "fr": "le la les des est et une un dans par pour avec été du que qui au aux sur ne pas se ont il elle",
    "es": "el la los las es y una un en por para con fue del que se al su sobre no ha han más como lo",
}
SPANS = re.compile(r"<!--.*?-->|<(ref|nowiki|math|gallery|pre|code)\b[^<>]*?(?:/>|>.*?</\1\s*>)|\[\[\s*(?:category|kategorie|cat[eé]gorie|categor[ií]a|file|image|datei|fichier|archivo)\s*:[^\[\]]*\]\]", re.I | re.S)
TRIPLE = re.compile(r"\{\{\{[^{}]*\}\}\}")
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
TAG = re.compile(r"<[^<>\n]{1,80}>")
SPACE = re.compile(r"&nbsp;|[^\S\n]+")
END = re.compile(r"[.!?…](?=[\"'»”)\]]*\s)|$")


def _phrases() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in ABOUT_PAGE:
        made.add_word(phrase, len(phrase))
    made.make_automaton()
    return made


PAGE_PHRASES = _phrases()


def about_page(sentence: str) -> bool:
    """Whether a sentence speaks about the page itself: it holds one of the phrases on word bounds."""
    low = sentence.lower()
    for end, n in PAGE_PHRASES.iter(low):
        start = end - n + 1
        if not (start and low[start - 1].isalnum()) and not (end + 1 < len(low) and low[end + 1].isalnum()):
            return True
    return False


def sentences(text: str | None) -> list[str]:
    """The prose sentences of a text with markup, without those about the page itself.

    Redirects have none; tables, templates, headings, categories and list items that are
    no sentences (name lists) are left out, broken markup is cut to its own line.
    """
    if not text or REDIRECT.match(text):
        return []
    text = SPANS.sub(" ", text)
    text = TRIPLE.sub("", text)
    while True:
        less, n = TEMPLATE.subn(" ", text)
        if not n:
            break
        text = less
    text = LINK.sub(r"\1", text).replace("'''", "").replace("''", "")
    text = SPACE.sub(" ", TAG.sub(" ", text))
    found = []
    in_table = False
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("{|"):
            in_table = True
        if line.startswith("|}"):
            in_table = False
            continue
        if not line or line[0] in "|!=" or line.startswith(("{{", "}}", "{|")):
            continue
        if in_table and not line.endswith((".", "!", "?")):
            continue
        item = line[0] in "*#:;"
        line = line.lstrip("*#:; ").replace("[[", " ").replace("]]", " ")
        if item and not line.endswith((".", "!", "?", "…")):
            continue
        at = 0
        for m in END.finditer(line):
            s = line[at : m.end()].strip()
            at = m.end()
            if len(s) > 3 and not about_page(s):
                found.append(s)
    return found


LANGUAGES = tuple(FUNCTION_WORDS)
SIGNALS = {w: sum(1 << k for k, lang in enumerate(LANGUAGES) if w in FUNCTION_WORDS[lang].split()) for words in FUNCTION_WORDS.values() for w in words.split()}


def language_mask(low: str) -> int:
    """The language of a text in lower case as a bit, by its function words; several bits where it stays open."""
    words = Counter(low.split())
    seen = [0] * len(LANGUAGES)
    for w in SIGNALS.keys() & words.keys():
        for k in range(len(LANGUAGES)):
            if SIGNALS[w] >> k & 1:
                seen[k] += words[w]
    most = max(seen)
    return sum(1 << k for k, n in enumerate(seen) if n == most)


def inflected(term: str, language: str) -> set[str]:
    """Regular plural and case forms of a term (its last word)."""
    if language == "en":
        return {term + "s", term + "es", term[:-1] + "ies" if term.endswith("y") else term + "s"}
    if len(term) < 5:
        return set()
    ends = {"de": ("e", "en", "n", "s", "es", "er", "ern"), "fr": ("s", "x"), "es": ("s", "es")}[language]
    return {term + e for e in ends}


class Lexicon:
    """The subject terms as one automaton over their written forms."""

    def __init__(self, listing: str) -> None:
        listed = json.loads(listing)
        self.subjects = sorted(listed)
        self.terms: list[str] = []
        self.of_term: list[list[tuple[int, int]]] = []  # subjects with their curated weights
        index: dict[str, int] = {}
        forms: dict[tuple[str, str], tuple[int, bool]] = {}  # form and language: term, and whether a capital letter makes it a name
        for k, subject in enumerate(self.subjects):
            for language, weights in listed[subject].items():
                for weight, words in weights.items():
                    for word in words:
                        low = word.lower()
                        t = index.setdefault(f"{language}:{low}", len(self.terms))
                        if t == len(self.terms):
                            self.terms.append(low)
                            self.of_term.append([])
                        if k not in [s for s, _ in self.of_term[t]]:
                            self.of_term[t].append((k, int(weight)))
                        forms[low, language] = (t, False)
        for key, t in index.items():
            language, low = key.split(":", 1)
            for form in inflected(low, language):
                forms.setdefault((form, language), (t, language == "en" and " " not in low))
        by_form: dict[str, list[tuple[int, int, bool]]] = {}
        for (form, language), (t, name) in forms.items():
            by_form.setdefault(form, []).append((1 << LANGUAGES.index(language), t, name))
        self.automaton = ahocorasick.Automaton()
        for form, of in by_form.items():
            self.automaton.add_word(form, (len(form), of))
        self.automaton.make_automaton()
        # A form with k letters replaced keeps one of its k + 1 pieces whole.
        pieces: dict[str, list[tuple[str, int, int, int, int]]] = {}
        for form, of in by_form.items():
            if len(form) >= LEAST_DAMAGED:
                n = 2 if len(form) < 14 else 3
                cuts = [len(form) * k // n for k in range(n + 1)]
                for bit, t, _ in of:
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        pieces.setdefault(form[a:b], []).append((form, bit, t, a, n - 1))
        self.pieces = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.pieces.add_word(piece, (len(piece), of))
        self.pieces.make_automaton()

    def damaged(self, low: str, mask: int) -> list[tuple[int, int, int]]:
        """Hits ``(start, -length, term)`` of terms with a letter or two replaced; of a long one also the blank on one side."""
        hits = []
        for end, (n, of) in self.pieces.iter(low):
            for form, bit, t, at, most in of:
                start = end - n + 1 - at
                if bit & mask and start >= 0 and start + len(form) <= len(low):
                    after = start + len(form)
                    open_ends = (start > 0 and low[start - 1].isalnum()) + (after < len(low) and low[after].isalnum())
                    if open_ends <= (len(form) >= 10) and sum(map(ne, low[start:after], form)) <= most:
                        hits.append((start, -len(form), t))
        return hits

    def matches(self, parts: list[str]) -> list[tuple[int, int]]:
        """``(sentence, term)`` of the longest matches on word bounds that do not overlap."""
        text = "\n".join(parts)
        low = text.lower()
        if len(low) != len(text):  # a few letters grow in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        mask = language_mask(low)
        hits = []
        for end, (n, of) in self.automaton.iter(low):
            start, after = end - n + 1, end + 1
            if (start and low[start - 1].isalnum()) or (after < len(low) and low[after].isalnum()):
                continue
            hits += [(start, -n, t) for bit, t, name in of if bit & mask and not (name and text[start].isupper())][:1]
        if DAMAGE.search(text):
            hits += self.damaged(low, mask)
        hits.sort()
        found, free, sentence, edge = [], 0, 0, 0
        ends = []
        for p in parts:
            edge += len(p) + 1
            ends.append(edge)
        for start, n, t in hits:
            if start >= free:
                free = start - n
                while start >= ends[sentence]:
                    sentence += 1
                found.append((sentence, t))
        return found


@lru_cache(maxsize=4)
def lexicon(listing: str) -> Lexicon:
    return Lexicon(listing)


def listing(path: str = str(TERMS)) -> str:
    """The term list as text: it travels with the functions, so workers need no file."""
    return Path(path).read_text(encoding="utf-8")


def _match_pass(terms: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon(terms)
        for batch in batches:
            keys, at, found_terms = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words.matches(s) if (s := sentences(text.as_py())) else None
                if found:
                    keys.append(key)
                    at.append([m[0] for m in found])
                    found_terms.append([m[1] for m in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.types[0]), pa.array(at, pa.list_(pa.int32())), pa.array(found_terms, pa.list_(pa.int32()))], names=["doc_id", "at", "terms"])

    return run


def subject_matches(documents: DataFrame, terms: str) -> DataFrame:
    """``(doc_id, at, terms)``: sentence and term numbers of all matches of documents that have any."""
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_match_pass(terms), f"doc_id {kind}, at array<int>, terms array<int>")


def term_weights(matches: DataFrame, words: Lexicon) -> list[float]:
    """Per term: its length in words, times the logarithm of its rarity among all documents with terms."""
    n = matches.count()
    df = dict(matches.select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count().collect())  # no more rows than terms
    return [(1 + 0.5 * t.count(" ")) * math.log((n + 1) / (df.get(k, 0) + 0.5) + 1) for k, t in enumerate(words.terms)]


def document_subjects(at: list[int], terms: list[int], of_term: list[list[tuple[int, int]]], weight: list[float], n_subjects: int, least_weight: int = LEAST_WEIGHT) -> list[int]:
    """Subject sentences per subject of one document, and their number."""
    scores: dict[int, dict[int, float]] = {}
    curated: dict[int, dict[int, int]] = {}
    whole = [0.0] * n_subjects
    for s, t in zip(at, terms, strict=True):
        own, sure = scores.setdefault(s, {}), curated.setdefault(s, {})
        for k, c in of_term[t]:
            own[k] = own.get(k, 0.0) + c * weight[t]
            sure[k] = sure.get(k, 0) + c
            if len(of_term[t]) == 1:
                whole[k] += c * weight[t]
    counts = [0] * n_subjects
    total = 0
    for s, own in scores.items():
        sure = curated[s]
        own = {k: v for k, v in own.items() if sure[k] >= least_weight}
        if not own:
            continue  # everyday words alone
        total += 1
        best = max(own.values())
        winners = [k for k, v in own.items() if v >= best - 1e-9]
        if len(winners) > 1:  # only ambiguous terms: what the rest of the text is about decides
            most = max(whole[k] for k in winners)
            winners = [k for k in winners if whole[k] == most]
        for k in winners:
            counts[k] += 1
    return [*counts, total]


def _share_pass(listed: str, weight: list[float], least_weight: int = LEAST_WEIGHT):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lexicon(listed)
        for batch in batches:
            out: list[tuple] = []
            for key, at, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *counts, total = document_subjects(at, terms, words.of_term, weight, len(words.subjects), least_weight)
                out += [(key, words.subjects[k], c, total) for k, c in enumerate(counts) if c]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.types[0]), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "subject", "sentences", "of"])

    return run


def subject_sentences(documents: DataFrame, terms: str = str(TERMS)) -> DataFrame:
    """``(doc_id, subject, sentences, of)``: sentences about each subject and about any, of every row.

    Null, empty and blank texts, redirects and texts without subject terms give no row. Rows
    are judged each by its own text, repeated ids too; other columns are ignored.
    """
    listed = listing(terms)
    matches = written(subject_matches(documents, listed), "matches")
    kind = matches.schema["doc_id"].dataType.simpleString()
    weight = term_weights(matches, lexicon(listed))
    return matches.mapInArrow(_share_pass(listed, weight), f"doc_id {kind}, subject string, sentences long, of long")


def calibrated_weight(documents: DataFrame, labels: DataFrame, choices: tuple[int, ...] = (1, 2, 3), terms: str = str(TERMS)) -> dict[int, tuple[float, float]]:
    """Per choice of the least curated weight: share of correct labels on one half of the labelled documents, and on the other.

    ``labels`` is ``(doc_id, subject)``, spelling and blanks aside; the first share is for choosing, the
    second for measuring. A label is met if the document has the subject. Null labels are left out.
    """
    listed = listing(terms)
    wanted = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("doc_id").isNotNull() & F.col("subject").isNotNull()).distinct()
    matches = written(subject_matches(documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), listed), "matches")
    weight = term_weights(matches, lexicon(listed))
    kind = matches.schema["doc_id"].dataType.simpleString()
    found = {}
    for c in choices:
        shares = matches.mapInArrow(_share_pass(listed, weight, c), f"doc_id {kind}, subject string, sentences long, of long").filter(F.col("sentences") * 100 >= F.col("of") * LEAST_SHARE)
        met = wanted.join(shares.select("doc_id", "subject", F.lit(1).alias("hit")), ["doc_id", "subject"], "left")
        half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
        by = {r[0]: r[1] for r in met.groupBy(half.alias("h")).agg(F.avg(F.coalesce("hit", F.lit(0)))).collect()}
        found[c] = (by.get(0, 0.0), by.get(1, 0.0))
    return found


def subject_areas(documents: DataFrame, terms: str = str(TERMS), least_share: int = LEAST_SHARE) -> DataFrame:
    """``(doc_id, subject)``: every subject with ``least_share`` percent of a document's subject sentences."""
    shares = subject_sentences(documents, terms)
    return shares.filter(F.col("sentences") * 100 >= F.col("of") * least_share).select("doc_id", "subject").distinct()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 9 over whole ``documents``."""
    return subject_areas(spark.read.parquet(f"{d}/documents.parquet"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and subject sentences of the corpus by subject."""
    documents = spark.read.parquet(f"{d}/documents.parquet")
    shares = subject_sentences(documents)
    return shares.groupBy("subject").agg(F.count_if(F.col("sentences") * 100 >= F.col("of") * LEAST_SHARE).alias("documents"), F.sum("sentences").alias("sentences"))
