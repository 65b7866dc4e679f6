"""Subject areas of documents by interpolated n-gram language models.

Each subject has a model of word pairs and words, interpolated with the background model of the whole corpus. A clause
mentions the subject whose model gives it the lowest cross-entropy, if that beats the background's by a margin, which is calibrated on
the labelled examples; a document is about every subject that at least ``MENTIONS`` of its clauses mention. A second
round trains the subject models again on the corpus as labelled by the first.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.plans.durable import cut

#: Weights of the pair and of its words in a subject's model (the rest is the background's), and of the background for single words.
PAIR, WORD, BACK = 0.4, 0.2, 0.4
#: Share of the rarer word of a pair that must stand in it for the pair to count as one unit.
BOUND = 0.45
#: Clauses that must mention a subject: one mention is one in passing.
MENTIONS = 2
#: Loss of F1 on the labelled rows up to which retrained models are taken.
SLACK = 0.01
#: Labelled rows used at most: a hash sample over all subjects. Share of all tokens below which an n-gram is no evidence, so that a model has at most 2 / RARE of them.
LABELLED, RARE = 20_000, 1e-6
_CLAUSE = r"[.;!?:\n。；]+(?:\s+|$)|,\s+then\s+"
_TOKEN = r"[\p{L}\p{N}]+"
_SPLIT, _WORDS = re.compile(_CLAUSE), re.compile(r"[^\W_]+")


def clauses(text: str) -> list[list[str]]:
    """Words of each clause, lower-cased; a mark ends a clause only before a blank or the end."""
    return [w for w in (_WORDS.findall(c) for c in _SPLIT.split(text.lower())) if w]


@dataclass
class SubjectModel:
    """Log ratios of the subject models to the background, by word and by closely bound pair of words."""

    subjects: list[str]
    word: dict[str, np.ndarray]
    pair: dict[tuple[str, str], np.ndarray]
    margin: np.ndarray | float = 1.0

    def __post_init__(self):
        rows = [*self.word.values(), *self.pair.values()]
        self._rows = np.array(rows) if rows else np.zeros((0, len(self.subjects)))
        self._word = {w: i for i, w in enumerate(self.word)}
        self._after: dict[str, dict[str, int]] = defaultdict(dict)
        for i, (v, w) in enumerate(self.pair, len(self.word)):
            self._after[v][w] = i
        self._after = dict(self._after)

    def _units(self, words: list[str]) -> list[int]:
        """Rows of the clause's pairs and words; those without entry are as likely under every model."""
        out, i, n = [], 0, len(words)
        while i < n:
            w = words[i]
            after = self._after.get(w)
            k = after.get(words[i + 1]) if after is not None and i + 1 < n else None
            i += 1 if k is None else 2
            if k is None:
                k = self._word.get(w)
            if k is not None:
                out.append(k)
        return out

    def clause(self, words: list[str]) -> np.ndarray:
        """Summed log ratio of a clause for each subject: the cross-entropy it gains as a whole; per word it depends on how long the rest is."""
        return self._rows[self._units(words)].sum(0)

    def about_all(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The subjects of each text: those that at least ``MENTIONS`` clauses mention; none for a null one."""
        units, starts, owner = [], [], []
        n = 0
        for n, t in enumerate(texts, 1):
            for words in clauses(t) if isinstance(t, str) else ():
                if found := self._units(words):
                    starts.append(len(units))
                    owner.append(n - 1)
                    units += found
        counts = np.zeros((n, len(self.subjects)), np.int64)
        if units:
            gain = np.add.reduceat(self._rows[units], starts, axis=0)
            best = gain.argmax(1)
            hit = gain[np.arange(len(best)), best] >= np.broadcast_to(self.margin, len(self.subjects))[best]
            np.add.at(counts, (np.array(owner)[hit], best[hit]), 1)
        out: list[list[str]] = [[] for _ in range(n)]
        for i, k in zip(*np.nonzero(counts >= MENTIONS), strict=True):
            out[i].append(self.subjects[k])
        return out

    def about(self, text: str | None) -> list[str]:
        return self.about_all([text])[0]


def _ratios(subjects: list[str], s1: dict, s2: dict, n_s: dict, b1: Counter, b2: Counter, total: float) -> tuple[dict, dict]:
    """Log ratios from counts by subject (``s1`` words, ``s2`` pairs, ``n_s`` tokens) and of the background.

    A closely bound pair counts as a unit: its words' own counts are those of their other uses only.
    """
    pair, word = {}, {}
    own = {w: dict(by) for w, by in s1.items()}
    back1 = Counter(b1)
    for (v, w), by in s2.items():
        if b2[(v, w)] < BOUND * max(min(b1[v], b1[w]), 1):
            continue  # the words alone tell as much
        back = max(b2[(v, w)], 1) / total
        ratio = np.array([
            math.log((PAIR * by.get(s, 0) / max(n_s[s], 1) + WORD * s1.get(v, {}).get(s, 0) * s1.get(w, {}).get(s, 0) / max(n_s[s], 1) ** 2 + (1 - PAIR - WORD) * back) / back) for s in subjects
        ])
        if ratio.max() <= 0.4:
            continue
        pair[(v, w)] = ratio
        for x in (v, w):
            back1[x] -= b2[(v, w)]
            if x in own:
                for s, n in by.items():
                    own[x][s] = own[x].get(s, 0) - n
    for w, by in own.items():
        back = max(back1[w], 1) / total
        ratio = np.array([math.log(((1 - BACK) * max(by.get(s, 0), 0) / max(n_s[s], 1) + BACK * back) / back) for s in subjects])
        if ratio.max() > 0.4:
            word[w] = ratio
    return word, pair


def _count(examples: list[tuple[str, str]]):
    s1, s2, n_s = defaultdict(lambda: defaultdict(float)), defaultdict(lambda: defaultdict(float)), defaultdict(float)
    for subject, text in examples:
        for words in clauses(text):
            for i, w in enumerate(words):
                s1[w][subject] += 1
                n_s[subject] += 1
                if i:
                    s2[(words[i - 1], w)][subject] += 1
    return s1, s2, n_s


def _background(texts: DataFrame, words: list[str], pairs: list[tuple[str, str]]) -> tuple[Counter, Counter, float]:
    """Counts over the whole corpus of the given n-grams, whose number is bounded, and of all tokens."""
    spark = texts.sparkSession
    clause = texts.select(F.explode(F.split(F.lower("text"), _CLAUSE)).alias("c")).select(F.regexp_extract_all("c", F.lit(f"({_TOKEN})")).alias("w")).filter(F.size("w") > 0)
    grams = clause.select(F.explode(F.concat(F.col("w"), F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)))).alias("g"))
    wanted = spark.createDataFrame(pd.DataFrame({"g": [*words, *(" ".join(p) for p in pairs)]}), "g string")
    # the wanted n-grams are those of the bounded labelled sample; all others are dropped before anything is shuffled
    got = {r["g"]: r["n"] for r in grams.join(F.broadcast(wanted), "g", "left_semi").groupBy("g").agg(F.count("*").alias("n")).collect()}
    total = clause.agg(F.sum(F.size("w"))).first()[0] or 1
    return Counter({w: got.get(w, 0) for w in words}), Counter({p: got.get(" ".join(p), 0) for p in pairs}), float(total)


def _scores(model: SubjectModel, examples: list[tuple[str, str]]) -> list[tuple[str, list[tuple[int, float]]]]:
    """For each labelled text the best subject of every clause and its gain over the background."""
    return [(s, [(int(g.argmax()), float(g.max())) for g in (model.clause(w) for w in clauses(t))]) for s, t in examples]


def _f1(model: SubjectModel, scores: list, margin, only: str | None = None) -> float:
    """F1 of the labels at a margin, over all subjects or ``only`` one."""
    tp = fp = fn = 0
    margin = np.broadcast_to(margin, len(model.subjects))
    for s, gains in scores:
        n = Counter(k for k, g in gains if g >= margin[k])
        got = {model.subjects[k] for k, c in n.items() if c >= MENTIONS}
        want = {s}
        if only is not None:
            got, want = got & {only}, want & {only}
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    return 2 * tp / max(1, 2 * tp + fp + fn)


def _calibrate(model: SubjectModel, examples: list[tuple[str, str]]) -> np.ndarray:
    """Acceptance margin of each subject: the one for all subjects with the best F1 on labelled texts, in the middle of the best range; a subject
    that does clearly better at another margin gets its own."""
    scores, steps = _scores(model, examples), np.arange(0.5, 2.51, 0.1)

    def best(only: str | None) -> tuple[float, float]:
        got = [(_f1(model, scores, m, only), m) for m in steps]
        top = max(f for f, _ in got)
        good = [m for f, m in got if f >= top - 0.002]
        return top, float(good[len(good) // 2])

    _, shared = best(None)
    out = np.full(len(model.subjects), shared)
    for k, s in enumerate(model.subjects):
        top, own = best(s)
        if top > _f1(model, scores, shared, s) + SLACK:
            out[k] = own
    return out


def train(texts: DataFrame, examples: DataFrame, areas: DataFrame, *, labelled: int = LABELLED, rare: float = RARE, rounds: int = 1) -> SubjectModel:
    """Fit on about ``labelled`` rows ``(subject, text)`` at most and scope notes, with counts over all of ``texts (text)``.

    ``rounds`` times the corpus is labelled and the models trained again on its texts with exactly one subject, by their n-grams that make up a
    share ``rare`` of all tokens or more: 2 / ``rare`` of them at most, whatever the corpus.
    """
    usable = examples.select("subject", "text").dropna()
    n = usable.count()
    if n > labelled:  # every subject keeps its share
        usable = usable.filter(F.pmod(F.xxhash64("subject", "text"), F.lit(n)) < labelled)
    rows = sorted((r["subject"], r["text"]) for r in usable.collect())
    notes = [(r["subject"], r["scope_note"] or "") for r in areas.select("subject", "scope_note").filter("subject is not null").collect()]
    subjects = sorted({s for s, _ in [*rows, *notes]})
    s1, s2, n_s = _count([*rows, *notes])
    b1, b2, total = _background(texts, list(s1), list(s2))
    word, pair = _ratios(subjects, s1, s2, n_s, b1, b2, total)
    model = SubjectModel(subjects, word, pair)
    model.margin = _calibrate(model, rows)
    for _ in range(rounds):
        again = _retrain(texts, model, rows, rare)
        # the first models have seen the labelled rows, so the new ones may do a little worse on them
        if _f1(again, _scores(again, rows), again.margin) < _f1(model, _scores(model, rows), model.margin) - SLACK:
            break
        model = again
    return model


def _retrain(texts: DataFrame, model: SubjectModel, rows: list[tuple[str, str]], rare: float) -> SubjectModel:
    labelled = cut(texts.mapInPandas(_labeller(model), "text string, subject string"))
    spark = texts.sparkSession
    clause = labelled.select("subject", F.explode(F.split(F.lower("text"), _CLAUSE)).alias("c")).select("subject", F.regexp_extract_all("c", F.lit(f"({_TOKEN})")).alias("w")).filter(F.size("w") > 0)
    grams = clause.select("subject", F.explode(F.concat(F.col("w"), F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b)))).alias("g"))
    counts = grams.select("g", F.when(F.col("subject") == "", "none").otherwise(F.concat(F.lit("s:"), "subject")).alias("subject")).groupBy("g").pivot("subject", ["none", *(f"s:{s}" for s in model.subjects)]).count().fillna(0)
    counts = cut(counts.withColumnsRenamed({f"s:{s}": s for s in model.subjects}))
    all_of = sum(F.col(f"`{s}`") for s in model.subjects)
    top = F.greatest(*[F.col(f"`{s}`") for s in model.subjects])
    sizes = {r["subject"]: r["n"] for r in clause.groupBy("subject").agg(F.sum(F.size("w")).alias("n")).collect()}
    total = float(sum(sizes.values()) or 1)
    strong = counts.withColumn("n", all_of + F.col("none")).filter((top >= max(3.0, rare * total)) & (top >= 0.4 * all_of))
    got = strong.collect()
    s1, s2, b1, b2 = {}, {}, Counter(), Counter()
    for r in got:
        by = {s: r[s] for s in model.subjects}
        if " " in r["g"]:
            p = tuple(r["g"].split(" "))
            s2[p], b2[p] = by, r["n"]
        else:
            s1[r["g"]], b1[r["g"]] = by, r["n"]
    # words that only the pairs hold still need their own counts
    missing = sorted({w for p in s2 for w in p} - set(s1))
    if missing:
        wanted = spark.createDataFrame(pd.DataFrame({"g": missing}), "g string")
        for r in counts.withColumn("n", all_of + F.col("none")).join(F.broadcast(wanted), "g").collect():
            s1[r["g"]], b1[r["g"]] = {s: r[s] for s in model.subjects}, r["n"]
    word, pair = _ratios(model.subjects, s1, s2, {s: sizes.get(s, 0) for s in model.subjects}, b1, b2, total)
    word = {w: v for w, v in word.items() if v.max() > 0.7}
    out = SubjectModel(model.subjects, word, pair)
    out.margin = _calibrate(out, rows)
    return out


def _labeller(model: SubjectModel):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            about = model.about_all(pdf["text"])
            pdf["subject"] = [a[0] if len(a) == 1 else "" for a in about]
            yield pdf[["text", "subject"]]

    return run


def document_subjects(df: DataFrame, ident: str, text: str, model: SubjectModel) -> DataFrame:
    """``(ident, subjects)``: the subjects of every row's text, an empty array where it is null or shows none."""
    kind = df.schema[ident].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in parts:
            yield pd.DataFrame({"id": pdf["id"], "subjects": m.about_all(pdf["t"])})

    out = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).mapInPandas(run, f"id {kind}, subjects array<string>")
    return out.withColumnRenamed("id", ident)


def category_subjects(found: DataFrame, subjects: list[str], least: float = 0.3, z: float = 2.6) -> DataFrame:
    """``(category, subject)`` for categories that name a subject: its own name, or one that their texts are about.

    ``found`` has ``id, category, subjects``. The share of a category's texts with a subject that are about the most frequent one must
    be above ``least`` with confidence ``z`` (Wilson's bound); general categories spread over many subjects and so name none.
    """
    one = found.filter("category <> '' and size(subjects) > 0").dropDuplicates(["id", "category"])
    n = one.groupBy("category").agg(F.count("*").alias("n"))
    by = one.select("category", F.explode("subjects").alias("subject")).groupBy("category", "subject").agg(F.count("*").alias("k"))
    best = by.groupBy("category").agg(F.max(F.struct("k", "subject")).alias("best")).join(n, "category").select("category", "best.*", "n")
    p = F.col("k") / F.col("n")
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))) / (1 + z * z / F.col("n"))
    own = found.select("category").filter(F.col("category").isin(subjects)).distinct().select("category", F.col("category").alias("subject"))
    return best.filter((bound > least) & ~F.col("category").isin(subjects)).select("category", "subject").unionByName(own)


def subject_rows(df: DataFrame, ident: str, text: str, category: str, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """``(ident, subject)``: what each document is about, or, if its text is null, blank or shows nothing, what its category names.

    Repeated rows of one identifier give their subjects once; documents without a subject have no row. Empty tables give no rows.
    """
    rows = cut(df.select(F.col(f"`{ident}`").alias("id"), F.lower(F.trim(F.col(f"`{category}`"))).alias("category"), F.col(f"`{text}`").cast("string").alias("text")).filter("id is not null").distinct())
    texts = rows.filter("text is not null").select("id", "text").dropDuplicates().select("text")
    model = train(texts, examples, areas)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in parts:
            pdf["subjects"] = m.about_all(pdf["text"])
            yield pdf[["id", "category", "subjects"]]

    found = cut(rows.mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, category string, subjects array<string>"))
    direct = found.select("id", F.explode("subjects").alias("subject")).distinct()
    names = category_subjects(found, model.subjects)
    silent = found.groupBy("id").agg(F.max(F.size("subjects")).alias("most")).filter("most = 0").select("id")
    by_category = found.join(silent, "id", "left_semi").select("id", "category").distinct().join(names, "category").select("id", "subject")
    return direct.unionByName(by_category).distinct().withColumnRenamed("id", ident)
