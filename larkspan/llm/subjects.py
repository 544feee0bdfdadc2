"""The subjects a text treats, found through weighted subject terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.text import clean_key
from larkspan.operators.numbering import hash_key
from larkspan.session import discard, materialise

#: Labelled documents that the terms, their weights and the thresholds are drawn from, at most; chosen by
#: hash. They are also the bound of what the driver fits: the sample ends before its texts exceed so many characters.
LABELLED_DOCUMENTS, SAMPLE_CHARACTERS = 20_000, 500_000_000
#: Of the sample one document in so many is not used for the terms; the thresholds are calibrated on these.
HELD_OUT = 5
#: The allowed subjects fit on the driver; more raise an error.
MOST_SUBJECTS = 1_000
#: A term needs this many sentences of labelled documents, and a weight of this size for some subject.
LEAST_SENTENCES, LEAST_WEIGHT = 3, 0.5
#: A document treats a subject in at least this share of its sentences that treat any subject.
LEAST_SHARE = 0.25
#: A term speaks for a subject if of equally many sentences per subject this share has it there.
LEAST_PURITY = 0.5
#: Mean evidence per matched term (natural logarithm) that a sentence may need for a subject against none;
#: each subject has the one that agrees best with held-out documents, the first of equals.
EVIDENCE = (1.0, 0.5, 0.75, 1.25, 1.5, 2.0, 3.0)
#: Times that each subject's threshold is chosen anew beside the others'.
SWEEPS = 2
ROUNDS = 12
NO_SUBJECT = "none"
SENTENCE_ENDS = re.compile(r"(?<=[.!?])[\s\"'»)*_]+|[\r\n]+|</?(?:p|li|br|div|h\d)\b[^>]*>")
WORDS = re.compile(r"[^\W_]+")
BETWEEN_WORDS = re.compile(r"[\W_]+")


def sentences(text: str) -> list[str]:
    """The sentences of a text, in lower case; line ends end a sentence too."""
    return [s for s in SENTENCE_ENDS.split(text.lower()) if s and not s.isspace()]


class Lexicon(NamedTuple):
    """Weighted terms: a row of `weights` per term with a number per subject and a last one for none."""

    subjects: list[str]
    terms: list[str]
    weights: np.ndarray
    priors: np.ndarray
    thresholds: np.ndarray


def fit_lexicon(documents: list[tuple[str, set[str]]], subjects: list[str]) -> Lexicon:
    """Draw subject terms from labelled documents.

    A document's labels hold for it as a whole, while its sentences treat one of its subjects or none,
    and labels may be wrong. Each sentence is therefore given to the subjects of its document's labels
    or to none in proportion to how well its words fit, the words' frequencies per subject follow from
    that, and so on for a fixed number of rounds. A term's weight is the logarithm of its frequency in
    a subject's sentences against its frequency in all; rare terms of few sentences are smoothed to 0.
    Without documents the lexicon is empty and no text treats a subject. One document in HELD_OUT gives no
    terms; on these the subjects' thresholds are calibrated.
    """
    held, documents = documents[HELD_OUT - 1 :: HELD_OUT], [d for i, d in enumerate(documents) if i % HELD_OUT != HELD_OUT - 1]
    known = {s: i for i, s in enumerate(subjects)}
    classes, none = len(subjects) + 1, len(subjects)
    rows, terms, allowed, index = [], [], [], {}
    for text, labels in documents:
        allow = np.full(classes, 0.01)
        allow[none] = 0.5
        marked = [known[x] for x in labels if x in known]
        if marked:
            allow[marked] = 1.0
        elif NO_SUBJECT in labels:
            allow[none] = 1.0
        for sentence in sentences(text):
            words = {*WORDS.findall(sentence)}
            if words:
                row = len(allowed)
                allowed.append(allow)
                for w in words:
                    rows.append(row)
                    terms.append(index.setdefault(w, len(index)))
    if not rows:
        return Lexicon(subjects, [], np.zeros((0, classes)), np.zeros(classes), np.zeros(none))
    rows, terms, allow = np.array(rows), np.array(terms), np.log(np.array(allowed))
    frequency = np.bincount(terms, minlength=len(index))
    kept = frequency >= LEAST_SENTENCES
    use = kept[terms]
    rows, terms = rows[use], terms[use]
    number = len(allowed)
    fit = np.exp(allow)
    fit /= fit.sum(1, keepdims=True)
    base = (frequency * kept + 1e-9) / number
    for _ in range(ROUNDS):
        size = fit.sum(0) + 1e-9
        count = np.stack([np.bincount(terms, weights=fit[rows, k], minlength=len(index)) for k in range(classes)], 1)
        # Two sentences' worth of the overall frequency smooth each class.
        rate = (count + 2 * base[:, None]) / (size + 2)
        weight = np.log(rate) - np.log(base[:, None])
        # Words that no single subject claims tell subjects from none, but not one subject from another.
        share = rate[:, :none] / rate[:, :none].sum(1, keepdims=True)
        common = share.max(1) < LEAST_PURITY
        weight[common, :none] = np.log(rate[common, :none].mean(1, keepdims=True)) - np.log(base[common, None])
        score = np.stack([np.bincount(rows, weights=weight[terms, k], minlength=number) for k in range(classes)], 1)
        score += allow
        score -= score.max(1, keepdims=True)
        fit = np.exp(score)
        fit /= fit.sum(1, keepdims=True)
    chosen = np.flatnonzero(np.abs(weight).max(1) * kept >= LEAST_WEIGHT)
    names = list(index)
    priors = np.log(fit.sum(0) / number + 1e-6)
    lexicon = Lexicon(subjects, [names[i] for i in chosen], weight[chosen].astype(np.float32), priors, np.full(none, EVIDENCE[0]))
    return lexicon._replace(thresholds=calibrated(held, lexicon))


def calibrated(documents: list[tuple[str, set[str]]], lexicon: Lexicon) -> np.ndarray:
    """The evidence that each subject needs, chosen for the best F1 of the subjects assigned to `documents`."""
    evidence = batch_evidence([text for text, _ in documents], build_automaton(lexicon.terms), lexicon.weights)
    labelled = np.array([[s in labels for s in lexicon.subjects] for _, labels in documents], dtype=bool).reshape(len(documents), -1)

    def agreement(thresholds: np.ndarray) -> float:
        given = document_shares(evidence, len(documents), lexicon.priors, thresholds)[0] >= LEAST_SHARE
        return 2 * (given & labelled).sum() / max(1, given.sum() + labelled.sum())

    best = max((np.full(len(lexicon.subjects), e) for e in EVIDENCE), key=agreement)
    for _ in range(SWEEPS):
        for k in range(len(best)):
            tried = [np.where(np.arange(len(best)) == k, e, best) for e in (best[k], *EVIDENCE)]
            best = max(tried, key=agreement)
    return best


class Evidence(NamedTuple):
    """Per sentence with known terms: its document, the sum of its terms' weights by class, and the number of terms."""

    document: np.ndarray
    scores: np.ndarray
    sizes: np.ndarray


def build_automaton(terms: list[str]):
    """Terms with a blank on both sides, as `batch_evidence` writes its sentences; so only whole words match."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        automaton.add_word(f" {term} ", i)
    automaton.make_automaton()
    return automaton


def batch_evidence(texts: list, automaton, weights: np.ndarray) -> Evidence:
    """The evidence of all sentences of whole texts; what is no text has none. A term counts once a sentence."""
    documents, pairs = [], []
    for number, text in enumerate(texts):
        if not isinstance(text, str) or not len(weights):
            continue
        for sentence in sentences(text):
            found = {i for _, i in automaton.iter(f" {BETWEEN_WORDS.sub(' ', sentence)} ")}
            if found:
                documents.append(number)
                pairs.append(np.fromiter(found, dtype=np.int64, count=len(found)))
    sizes = np.array([len(p) for p in pairs], dtype=np.int64)
    scores = np.zeros((len(pairs), weights.shape[1]))
    if len(pairs):
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        # Parts of sentences, so that the terms' weights of a large batch needn't lie side by side.
        for at in range(0, len(pairs), 20_000):
            part = np.concatenate(pairs[at : at + 20_000])
            scores[at : at + 20_000] = np.add.reduceat(weights[part].astype(np.float64), starts[at : at + 20_000] - starts[at], axis=0)
    return Evidence(np.array(documents, dtype=np.int64), scores, sizes)


def document_shares(evidence: Evidence, documents: int, priors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: each subject's share of the sentences that treat any, these sentences, and those with known terms.

    A sentence has the subject with the most evidence if that exceeds the evidence for none by the
    subject's threshold per term. A second pass adds what the text's other sentences treat, which settles
    sentences whose own terms leave it open.
    """
    at, scores, sizes = evidence
    classes = len(priors)
    none = classes - 1
    needed = np.r_[thresholds, 0.0]

    def counts(score: np.ndarray) -> np.ndarray:
        best = score.argmax(1)
        sure = (score[np.arange(len(score)), best] - score[:, none]) / sizes >= needed[best]
        return np.bincount(at * classes + np.where(sure, best, none), minlength=documents * classes).reshape(documents, classes)

    first = counts(scores + priors)
    treated = counts(scores + np.log((first + 0.3) / (first.sum(1, keepdims=True) + 0.3 * classes))[at])
    own = treated[:, :none]
    total = own.sum(1)
    return own / np.maximum(total, 1)[:, None], total, treated.sum(1)


def subject_names(subjects: DataFrame) -> list[str]:
    """The allowed subjects in order; they must be at most MOST_SUBJECTS."""
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().limit(MOST_SUBJECTS + 1).collect()]  # bounded by the check that follows
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return sorted(names)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = LABELLED_DOCUMENTS, characters: int = SAMPLE_CHARACTERS) -> list[tuple[str, set[str]]]:
    """At most `most` labelled documents (text, labels) of at most `characters` in all, in an order by hash.

    Bounded, so collected, and the same in every run. Labels compare without case and blanks; null labels,
    labels of unknown documents and null or empty texts are left out.
    """
    cleaned = labels.select("doc_id", clean_key(F.col("subject")).alias("label")).filter("doc_id is not null and label <> ''")
    hashed = cleaned.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("labels")).withColumn("order", hash_key(F.col("doc_id")))
    chosen = hashed.orderBy("order").limit(most)
    sample = materialise(documents.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(chosen), "doc_id"))  # at most `most` rows
    upto = sample.select("order", "text", F.length("text").cast("bigint").alias("length")).withColumn("upto", F.sum("length").over(Window.orderBy("order", "length").rowsBetween(Window.unboundedPreceding, 0)))
    kept = upto.filter(F.col("upto") <= characters).agg(F.max("order").alias("last"))
    rows = sample.join(F.broadcast(kept), F.col("order") <= F.col("last")).select("order", "text", "labels").collect()  # one row broadcast; at most `characters`
    discard(sample)
    return [(r["text"], set(r["labels"])) for r in sorted(rows, key=lambda r: (r["order"], r["text"]))]


def assign_subjects(documents: DataFrame, document: str, text: str, lexicon: Lexicon) -> DataFrame:
    """Per row of `documents`: its id, `subjects` (array of subject and share), `main_subject`, and sentence counts.

    A subject is assigned if it has at least LEAST_SHARE of the sentences that treat any subject; several
    or none are possible. `main_subject` is the largest one, of equals the first in the order of the
    subjects, null without any. Whole texts are read, in Arrow batches; null, blank or wordless texts get
    no subject. Other columns are dropped, so their names can't clash. Repeated rows stay repeated.
    """
    # Plain lists and arrays: a broadcast object of this package could not be read where the package isn't installed.
    told = documents.sparkSession.sparkContext.broadcast((lexicon.subjects, lexicon.terms, lexicon.weights, lexicon.priors, lexicon.thresholds))
    kind = dict(documents.dtypes)[document]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, terms, weights, priors, thresholds = told.value
        automaton = build_automaton(terms)
        for whole in batches:
            for start in range(0, len(whole), 2_000):
                batch = whole.iloc[start : start + 2_000]
                evidence = batch_evidence(batch["text"].tolist(), automaton, weights)
                shares, total, known = document_shares(evidence, len(batch), priors, thresholds)
                given = (shares >= LEAST_SHARE) & (total > 0)[:, None]
                main = np.where(given.any(1), shares.argmax(1), -1)
                yield pd.DataFrame({
                    "document": batch["document"].to_numpy(),
                    "subjects": [[{"subject": names[k], "share": float(row[k])} for k in np.flatnonzero(g)] for row, g in zip(shares, given, strict=True)],
                    "main_subject": [names[k] if k >= 0 else None for k in main],
                    "known_sentences": known.astype(np.int32), "subject_sentences": total.astype(np.int32),
                })

    rows = documents.select(F.col(document).alias("document"), F.col(text).alias("text"))
    schema = f"document {kind}, subjects array<struct<subject:string,share:double>>, main_subject string, known_sentences int, subject_sentences int"
    return rows.mapInPandas(assign, schema).withColumnRenamed("document", document)


def subject_rows(assigned: DataFrame, document: str) -> DataFrame:
    """One row (document, subject, share) per subject assigned; repeated documents once."""
    each = assigned.select(document, F.explode("subjects").alias("s")).select(document, "s.subject", "s.share")
    return each.dropDuplicates([document, "subject"])


def composition(assigned: DataFrame, document: str) -> DataFrame:
    """The corpus by subject: documents and their share; `none` stands for documents without a subject."""
    each = assigned.select(document, F.explode_outer("subjects.subject").alias("subject")).distinct()
    whole = assigned.agg(F.count_distinct(document).alias("_all"))
    counts = each.groupBy(F.coalesce("subject", F.lit(NO_SUBJECT)).alias("subject")).agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(F.broadcast(whole)).select("subject", "documents", (F.col("documents") / F.col("_all")).alias("share"))  # one row
