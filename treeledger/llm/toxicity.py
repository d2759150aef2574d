"""Toxicity by a weighted lexicon.

Texts are folded (lower case, accents and look-alike letters to ASCII, digits and signs that stand for letters to letters,
all else to spaces), and one Aho-Corasick automaton finds lexicon terms and exception phrases as whole words. A match inside an
exception phrase does not count. The matched weight, alone and as a share of the text's words, goes through a
logistic curve.

Weights and curve are fitted on at most SAMPLE_ROWS labelled rows, those whose ids hash smallest. Words and word
beginnings outside the lexicon join it when the sample shows them surely more often in toxic texts, and after many
different words (those of a passage that was copied follow the same word each time).
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.llm.common import at_work, by_bytes, materialize

SAMPLE_ROWS = 20_000
#: Preceding words are counted up to so many in each part of a partition; learning asks for no more.
MOST_BEFORE = 20
#: Counts leave a worker once they are so many.
MOST_HELD = 20_000
#: A term is learned when it is surely (but for this chance) LEAST_RATIO times as frequent in toxic texts as in clean ones.
CHANCE, LEAST_RATIO = 0.001, 2.7
BEGIN = (4, 7)
PRIOR_WEIGHT, STRONG_WEIGHT = 2.0, 3.0

#: Terms known to insult (those with a star are beginnings), those among them that do so in any context, and phrases in which they do not.
TERMS = """
arrogant arsehole asshole bastard bitch blockhead bloody bollocks bullshit clown coward crap creep cretin cunt damn degenerate dickhead dimwit disgusting
douchebag dumb dumbass dunce faggot* fool freak fuck* garbage halfwit hate idiot* ignorant imbecile jackass jerk kill lame liar loser lowlife lunatic
maggot moron* motherfuck* nasty nigger* nitwit numbskull parasite pathetic pervert pig prick psycho retard* rotten scum scumbag shit shithead shut
sick simpleton slut stupid* suck sucker swine thug trash trashy twat ugly useless vermin vile wanker weirdo whore worthless
abschaum arschloch blod blodmann depp dreckig drecksau dummkopf ekelhaft fotze hurensohn missgeburt miststuck scheiss* schlampe schwachkopf schwein
schweinehund trottel versager vollidiot wichser
abruti batard connard connasse debile degoutant encule merde ordure putain pute salaud salope
asqueroso basura cabron estupido gilipollas hijo de puta imbecil inutil maricon mierda pendejo puta puto subnormal
bastardo cazzo coglione cretino merda puttana scemo stronzo vaffanculo caralho filho da puta otario
hoer klootzak kut chuj debil dupek kurwa skurwysyn cyka
"""
PHRASES = ("hijo de puta", "filho da puta")
TERMS = [*dict.fromkeys([*PHRASES, *(t for t in TERMS.replace(PHRASES[0], "").replace(PHRASES[1], "").split())])]
#: Terms that also have everyday senses; without labels that speak for them they weigh nothing.
MILD = "arrogant bloody coward creep damn depp freak hate ignorant kill kut lame liar lunatic nasty parasite pig psycho rotten shut sick suck swine thug ugly useless vermin vile basura inutil ordure schwein".split()
STRONG = "asshole arsehole arschloch bitch connard cunt encule faggot* fotze fuck* gilipollas hijo de puta hurensohn klootzak kurwa motherfuck* nigger* retard* salope stronzo vaffanculo whore wichser".replace(PHRASES[0], "").split() + [PHRASES[0]]
EXCEPTIONS = """
trash can|trash bin|trash bag|trash collection|garbage can|garbage truck|garbage collection|garbage collector|clown fish|class clown|
clown school|sore loser|fool proof|april fool|guinea pig|kill switch|kill time|rotten tomatoes|stupid simple|sick leave|sick pay|
shut down|dumb bell|dumb terminal|fool s gold|creep resistance|freak accident|hate crime|hate speech
""".replace("\n", "").split("|")
#: Letters of other scripts and signs that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "s", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
    "ß": "ss", "æ": "ae", "œ": "oe",
}
STANDINS = {"0": "o", "1": "1", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "1", "€": "e"}
#: This sign stands for either letter: folding leaves it, and terms are looked for with it.
EITHER, LETTERS = "1", "il"
_EITHER = str.maketrans(LETTERS, EITHER * 2)
#: Invisible characters are dropped, so that they do not part a word.
INVISIBLE = "­​‌‍⁠﻿"

_SIGNS = re.compile(r"[@$!|€]{2,}|[@$!|€](?![^\W\d_])|(?<![\w@$!|€])[0-9]+(?![\w@$!|€])")
#: Single letters with one sign between each two are one word.
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .*_-][^\W_]){2,}(?![^\W_])")
_cached: dict[tuple, object] = {}


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """The translation table for lower-cased texts, from the Unicode decompositions and the fixed values above."""
    table = {c: " " for c in range(0x80) if not chr(c).isalpha()}
    for c in [*range(0x80, 0x600), *range(0x1D00, 0x2C00), *range(0x3000, 0x3040), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).lower() if not unicodedata.combining(x))
        if plain and plain.isascii() and plain.isalpha():
            table[c] = plain
        elif unicodedata.category(chr(c)) in ("Mn", "Cf"):
            table[c] = ""
        elif not chr(c).isalpha():
            table[c] = " "
    table |= {ord(k): v for k, v in LOOKALIKES.items()} | {ord(k): v for k, v in STANDINS.items()} | {ord(c): "" for c in INVISIBLE}
    return table


def fold(text: str) -> str:
    """Folded words between single or several spaces, with one at either end. Signs and numbers that do not touch a letter stand for nothing; spaced-out words are closed up."""
    lower = _SPACED.sub(lambda m: m[0][::2], text.lower())
    return " " + _SIGNS.sub(" ", lower).translate(folding()) + " "


def automaton(terms: tuple[str, ...]):
    """Terms (whole words with plural forms, or word beginnings) and exception phrases, with EITHER for LETTERS."""
    if ("automaton", terms) not in _cached:
        import ahocorasick

        forms: dict[str, list[tuple[int, str]]] = {}
        for i, t in enumerate(terms):
            for form in [f" {t[:-1]}"] if t[-1] == "*" else [f" {t} ", f" {t}s ", f" {t}es "]:
                forms.setdefault(form.translate(_EITHER), []).append((i, form))
        for form in (f" {p}{ending} " for p in EXCEPTIONS for ending in ("", "s")):
            forms.setdefault(form.translate(_EITHER), []).append((-1, form))
        made = ahocorasick.Automaton()
        for form, held in forms.items():
            made.add_word(form, held)
        made.make_automaton()
        _cached.clear()
        at_work("toxicity", _cached.clear)
        _cached["automaton", terms] = made
    return _cached["automaton", terms]


def spelt(piece: str, form: str) -> bool:
    return piece == form or EITHER in piece and all(a == b or a == EITHER and b in LETTERS for a, b in zip(piece, form, strict=True))


def matches(folded: str, terms: tuple[str, ...]) -> list[int]:
    """Numbers of the terms that occur, as often as they do, outside exception phrases."""
    found = [(end, i, len(form)) for end, held in automaton(terms).iter(folded.translate(_EITHER)) for i, form in held if spelt(folded[end - len(form) + 1 : end + 1], form)]
    spared = sorted((end - n + 1, end) for end, i, n in found if i < 0)
    if not spared:
        return [i for _, i, _ in found]
    starts, furthest = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    # A match lies in a phrase when one that starts no later than it ends no earlier.
    inside = lambda a, b: (k := bisect_right(starts, a)) > 0 and furthest[k - 1] >= b
    return [i for end, i, n in found if i >= 0 and not inside(end - n + 1, end)]


def measures(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(100 * weight / max(words, 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text and toxic of at most `rows` labelled rows that are not held out; fewer than two labels for a doc_id must not differ, or the larger counts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).alias("toxic"))


def affixes(folded: str) -> dict[str, str]:
    """Words and word beginnings (marked by *) of a folded text, each with a word that it follows."""
    words = folded.replace(EITHER, LETTERS[0]).split()
    out = {}
    for before, w in zip(["", *words], words, strict=False):
        if len(w) > 2:
            out[w] = before
            for k in range(BEGIN[0], min(BEGIN[1], len(w)) + 1):
                out[w[:k] + "*"] = before
    return out


def _counted(sample: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """In how many texts each affix occurs, and after how many different words (up to a bound)."""

    def run(batches):
        counts: dict[str, list] = {}

        def out():
            w, held = zip(*counts.items(), strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(w), pa.array([n for n, _ in held], pa.int64()), pa.array([sorted(p) for _, p in held], pa.list_(pa.string()))], ["affix", "n", "before"])
            counts.clear()
            return batch

        for b in batches:
            for text in b.column(0):
                for w, before in affixes(fold(text.as_py())).items():
                    if wanted is None or w in wanted:
                        at = counts.setdefault(w, [0, set()])
                        at[0] += 1
                        if wanted is None and len(at[1]) < MOST_BEFORE:
                            at[1].add(before)
                if len(counts) >= MOST_HELD:
                    yield out()
        if counts:
            yield out()

    return by_bytes(sample).mapInArrow(run, "affix string, n long, before array<string>").groupBy("affix").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("before")))).alias("before"))


def chance(toxic: int, n: int, share: float) -> float:
    """The chance of at least `toxic` of `n` texts being toxic when each is with probability `share` (1 where that many are expected)."""
    if toxic <= n * share:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(toxic + 1) - math.lgamma(n - toxic + 1) + toxic * math.log(share) + (n - toxic) * math.log1p(-share)
    term = total = math.exp(log)
    for k in range(toxic, n):
        # Beyond the mean, terms fall; those that add nothing to the sum end it.
        term *= (n - k) / (k + 1) * share / (1 - share)
        total += term
        if term < total * 1e-9:
            break
    return total


def found_terms(sample: DataFrame) -> list[str]:
    """Words and word beginnings outside the lexicon that the sample shows surely more often in toxic texts, the surest first.

    The test is exact for samples of any size. What is collected is bounded by the sample.
    """
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    sizes = kinds.get(True, 0), kinds.get(False, 0)
    if not all(sizes):
        return []
    # The share of toxic texts among those that hold a term which is LEAST_RATIO times as frequent there.
    share = LEAST_RATIO * sizes[0] / (LEAST_RATIO * sizes[0] + sizes[1])
    # What fewer texts hold cannot pass, even if no clean one holds it.
    fewest = math.ceil(math.log(CHANCE) / math.log(share))
    enough = (F.col("n") >= fewest) & (F.col("before") >= 0.6 * F.least("n", F.lit(MOST_BEFORE)))
    toxic = {r["affix"]: r["n"] for r in _counted(sample.where("toxic"), None).where(enough).collect()}
    clean = {r["affix"]: r["n"] for r in _counted(sample.where("not toxic"), frozenset(toxic)).collect()}
    known = {f for t in TERMS for f in (t, t + "s", t + "es")}
    rate = {w: (n + 0.5) / (clean.get(w, 0) + 0.5) for w, n in toxic.items()}
    odds = {w: chance(n, n + clean.get(w, 0), share) for w, n in toxic.items()}
    found: list[str] = []
    # What a surer beginning covers adds nothing.
    for w in sorted((w for w in odds if odds[w] <= CHANCE), key=lambda w: (odds[w], -rate[w], len(w), w)):
        of_known = w in known or any(t[-1] == "*" and w.startswith(t[:-1]) for t in TERMS) or w[-1] == "*" and any(t.startswith(w[:-1]) for t in TERMS)
        if not of_known and not any(f[-1] == "*" and w.startswith(f[:-1]) for f in found):
            found.append(w)
    return found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Bias and slopes by Newton's method; the ridge keeps a separable sample finite."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - ridge * b)
    return b


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Terms, weights and curve. Without labelled rows of both kinds, the prior weights and a curve that one term tips."""
    sample = materialize(docs.sparkSession, labelled_sample(docs, labels, rows), "labelled")
    terms = tuple(dict.fromkeys([*TERMS, *found_terms(sample)]))

    def run(batches):
        for b in batches:
            folded = [fold(t) for t in b.column(0).to_pylist()]
            held = [sorted(Counter(matches(f, terms)).items()) for f in folded]
            yield pa.RecordBatch.from_arrays([pa.array([[i for i, _ in h] for h in held], pa.list_(pa.int32())), pa.array([[n for _, n in h] for h in held], pa.list_(pa.int64())), pa.array([len(f.split()) for f in folded], pa.int64()), b.column(1)], ["terms", "times", "words", "toxic"])

    seen = by_bytes(sample).mapInArrow(run, "terms array<int>, times array<long>, words long, toxic boolean").collect()  # at most `rows` rows of distinct terms
    y = np.array([r["toxic"] for r in seen], float)
    prior = {**dict.fromkeys(STRONG, STRONG_WEIGHT), **dict.fromkeys(MILD, 0.0)}
    weights = np.array([prior.get(t, PRIOR_WEIGHT) for t in terms])
    if not 0 < y.sum() < len(y):
        return {"terms": terms, "weights": weights.tolist(), "curve": [-2.0, 4.0, 0.0]}
    hits = np.zeros((len(terms), 2))
    for r in seen:
        for i in r["terms"]:
            hits[i, int(r["toxic"])] += 1
    odds = np.log((hits[:, 1] + 0.5) / (y.sum() + 1)) - np.log((hits[:, 0] + 0.5) / (len(y) - y.sum() + 1))
    n = hits.sum(axis=1)
    weights = np.maximum(0, (n * odds + 5 * weights) / (n + 5))
    x = np.array([measures(sum(weights[i] * n for i, n in zip(r["terms"], r["times"], strict=True)), r["words"]) for r in seen])
    return {"terms": terms, "weights": weights.tolist(), "curve": logistic(x, y).tolist()}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches, n_words of every row.

    Null and empty texts have no match and the score of that. Rows with a null doc_id are scored too (not held out).
    Repeated rows give equal results; an empty table gives no rows. Other columns are ignored. Texts are read whole.
    """
    terms, weights, (bias, a, c) = model["terms"], model["weights"], model["curve"]

    def run(batches):
        for b in batches:
            scores, counts, words = [], [], []
            for t in b.column(2):
                folded = fold(t.as_py() or "")
                found = matches(folded, terms)
                n = len(folded.split())
                x, y = measures(sum(weights[i] for i in found), n)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, bias + a * x + c * y)))))
                counts.append(len(found))
                words.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(counts, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "held_out", "score", "predicted", "n_matches", "n_words"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return by_bytes(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_matches long, n_words long")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out and score every document."""
    return score_documents(docs, train(docs, labels))


def reject(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose texts are not judged toxic, with all columns."""
    model = train(docs, labels)
    terms, weights, (bias, a, c) = model["terms"], model["weights"], model["curve"]

    @F.arrow_udf("boolean")
    def fine(texts):
        def one(t):
            folded = fold(t or "")
            x, y = measures(sum(weights[i] for i in matches(folded, terms)), len(folded.split()))
            return bias + a * x + c * y < 0

        return pa.array([one(t.as_py()) for t in texts], pa.bool_())

    return by_bytes(docs).where(fine(F.coalesce("text", F.lit(""))))
