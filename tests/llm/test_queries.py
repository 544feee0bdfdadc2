"""The registered queries without an SQL twin: against brute force, sums in SQL, and labels."""

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from larkspan.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER, LARGEST = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORDS = "len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"


def sql(text, folder=FOLDER):
    return duckdb.sql(text.replace("@", f"{folder}/")).fetchall()


# 1. grouping


def certain_groups(folder):
    """All groups of p1_found by comparing every pair of cells."""
    rows = sql("SELECT lower(hex(label)), list(centroid) FROM '@ivf_cells.parquet' WHERE label IS NOT NULL AND centroid IS NOT NULL GROUP BY 1", folder)
    usable = lambda v: len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    cells = {label: min(tuple(v) for v in vs if usable(v)) for label, vs in rows if any(usable(v) for v in vs)}
    labels = sorted(cells)
    x = np.array([cells[c] for c in labels], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    near = cosine >= 0.80
    left, out = set(range(len(labels))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            more = set(np.flatnonzero(near[i]).tolist()) & left
            left -= more
            todo += more
        own = sorted(group)
        if len(own) > 1 and cosine[np.ix_(own, own)].min() >= 0.85:
            out |= {labels[i]: labels[own[0]] for i in own}
    return out, len(labels)


@pytest.mark.parametrize("folder", [FOLDER, LARGER, LARGEST])
def test_certain_groups(spark, folder):
    truth, _ = certain_groups(folder)
    got = {r["label"]: r["group_label"] for r in queries.p1_found(spark, folder).collect()}
    assert got.items() <= truth.items() and len(got) >= 0.999 * len(truth) and len(truth) > 0.3 * 1000 * (folder == LARGER)


def test_groups_account_for_all_cells(spark):
    truth, usable = certain_groups(LARGER)
    got = queries.p1_groups(spark, LARGER).collect()
    assert sum(r["cells"] for r in got) == usable and len({r["group_label"] for r in got}) == len(got)
    assert all(1 <= len(r["typical_labels"]) <= min(3, r["cells"]) for r in got)
    sizes = defaultdict(int)
    for group in truth.values():
        sizes[group] += 1
    told = {r["group_label"]: r["cells"] for r in got}
    assert sum(told.get(g) == n for g, n in sizes.items()) >= 0.99 * len(sizes)
    entries = sql("""SELECT sum(n) FROM (SELECT greatest(coalesce(max(offset_to - offset_from), 0), 0) AS n, bool_or(len(centroid) = 64
      AND len(list_filter(centroid, lambda v: v IS NULL OR isnan(v))) = 0 AND len(list_filter(centroid, lambda v: v <> 0)) > 0) AS good
      FROM '@ivf_cells.parquet' WHERE label IS NOT NULL GROUP BY label) WHERE good""", LARGER)[0][0]
    assert sum(r["posting_entries"] for r in got) == entries


# 6. packing


@pytest.mark.parametrize("folder", [FOLDER, LARGER])
def test_packing(spark, folder):
    sizes = dict(sql(f"SELECT doc_id, {WORDS} FROM '@documents.parquet'", folder))
    packed = queries.p6_packing(spark, folder).collect()
    per, of = defaultdict(int), defaultdict(list)
    for r in packed:
        of[r["doc_id"]].append((r["piece_no"], r["first_token"], r["tokens"]))
        if r["container"] is not None:
            per[r["container"]] += r["tokens"]
    assert of.keys() == sizes.keys() and max(per.values()) <= queries.CONTAINER
    for doc, parts in of.items():
        parts.sort()
        assert sum(t for *_, t in parts) == sizes[doc] and len(parts) == max(1, -(-sizes[doc] // queries.CONTAINER))
        assert [a for _, a, _ in parts] == [i * queries.CONTAINER for i in range(len(parts))]
    report = queries.p6_report(spark, folder).first()
    total = sum(sizes.values())
    assert (report["pieces"], report["tokens"], report["containers"]) == (len(packed), total, len(per))
    assert report["least_containers"] == -(-total // queries.CONTAINER) and report["fullest"] == max(per.values())
    assert abs(report["used_share"] - total / len(per) / queries.CONTAINER) < 1e-9 and report["used_share"] > (0.98 if folder == LARGER else 0.9)


def test_packing_by_a_public_tokenizer(spark):
    if not os.path.exists(queries.TOKENIZER):
        pytest.skip("no tokenizer files")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    tokenizer.encode_special_tokens = True
    texts = dict(sql("SELECT doc_id, coalesce(text, '') FROM '@documents.parquet'"))
    got, per = defaultdict(int), defaultdict(int)
    for r in queries.p6_packing_bpe(spark, FOLDER).collect():
        got[r["doc_id"]] += r["tokens"]
        per[r["container"]] += r["tokens"]
    assert got == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}
    per.pop(None, None)
    assert max(per.values()) <= queries.CONTAINER and sum(per.values()) > 0.9 * len(per) * queries.CONTAINER


# 7. mixing


def test_mixture_of_the_documents(spark):
    mixed = queries.mixture(spark, LARGER)
    report = {r["source"]: r for r in mixed.report.collect()}
    wanted = dict(sql(f"""WITH d AS (SELECT regexp_replace(lower(trim(source, {queries._BLANK})), '[\\s\\x{{a0}}-]+', '_', 'g') AS source, {WORDS} AS n FROM '@documents.parquet')
      SELECT source, (count(*), sum(n)) FROM d GROUP BY 1""", LARGER))
    targets = {s: (share, most) for s, share, most in sql("SELECT source, target_share, max_repeats FROM '@source_targets.parquet'", LARGER)}
    total = sum(wanted.get(s, (0, 0))[1] for s in report)
    assert len(report) == len(targets)
    uses = mixed.uses.collect()
    reached = defaultdict(int)
    for r in uses:
        assert 0 <= r["uses"] <= report[r["source"]]["max_repeats"]
        reached[r["source"]] += r["uses"] * r["tokens"]
    everything = sum(reached.values())
    for s, r in report.items():
        assert (r["documents"], r["available_tokens"]) == wanted.get(s, (0, 0)) and abs(r["target_tokens"] - r["target_share"] * total) < 1e-6
        assert r["reached_tokens"] == reached[s] and abs(r["reached_share"] - reached[s] / everything) < 1e-12
        goal = min(r["target_tokens"], r["max_repeats"] * r["available_tokens"])
        assert abs(r["raked_tokens"] - goal) < 1e-6 * max(goal, 1) and abs(reached[s] - goal) < 0.05 * goal + 600
        assert r["short"] == (r["max_repeats"] * r["available_tokens"] < r["target_tokens"])
    sides = mixed.marginals.collect()
    assert {r["axis"] for r in sides} == {"source", "language", "topic"}
    for axis in ("source", "language", "topic"):
        own = [r for r in sides if r["axis"] == axis]
        assert sum(r["reached_tokens"] for r in own) == everything and abs(sum(r["raked_tokens"] for r in own) - sum(r["raked_tokens"] for r in report.values())) < 1e-3
        # All marginals hold together, but for those that the caps of short sources bend.
        assert sum(abs(r["raked_tokens"] - min(r["wanted_tokens"], r["raked_tokens"] if axis == "source" else r["wanted_tokens"])) for r in own) < 0.02 * everything


# 8. subjects


def test_subjects_against_labels(spark):
    """The hand labels, some of which are wrong, agree with what is found; and the composition counts it."""
    labels = defaultdict(set)
    for doc, subject in sql("SELECT doc_id, lower(trim(subject)) FROM '@subject_labels.parquet' WHERE doc_id IS NOT NULL AND subject IS NOT NULL", LARGEST):
        labels[doc].add(subject)
    rows = queries.p8_found(spark, LARGEST).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["subject"])
    assert len(rows) == sum(map(len, got.values()))
    right = sum(len(got[d] & (s - {"none"})) for d, s in labels.items())
    given, true = sum(len(got[d]) for d in labels), sum(len(s - {"none"}) for s in labels.values())
    assert right / given >= 0.93 and right / true >= 0.93
    told = {r["subject"]: r for r in queries.p8_composition(spark, LARGEST).collect()}
    documents = sql("SELECT count(DISTINCT doc_id) FROM '@documents.parquet'", LARGEST)[0][0]
    for subject in {r["subject"] for r in rows}:
        n = sum(subject in s for s in got.values())
        assert told[subject]["documents"] == n and abs(told[subject]["share"] - n / documents) < 1e-12
    assert told["none"]["documents"] == documents - sum(map(bool, got.values()))


def test_thresholds_are_per_subject_and_held_out(spark, monkeypatch):
    """A document that calibrates gives no terms, and a subject whose sentences need more evidence gets its own threshold."""
    from larkspan.llm import subjects

    seen = []
    monkeypatch.setattr(subjects, "calibrated", lambda held, lexicon: seen.append(held) or np.array([1.0, 2.0]))
    texts = [(f"only{i} word{i} " * 4 + ". court jury judge.", {"law"}) for i in range(20)]
    lexicon = subjects.fit_lexicon(texts, ["food", "law"])
    assert [t for t, _ in seen[0]] == [t for i, (t, _) in enumerate(texts) if i % subjects.HELD_OUT == subjects.HELD_OUT - 1]
    assert lexicon.thresholds.tolist() == [1.0, 2.0]
    monkeypatch.undo()
    # Sentences for subject 0 with weak evidence are noise, those for subject 1 are not.
    weights = np.array([[0.8, 0.0, 0.0], [0.0, 0.8, 0.0], [3.0, 0.0, 0.0]], dtype=np.float32)
    lexicon = subjects.Lexicon(["a", "b"], ["weaka", "weakb", "stronga"], weights, np.zeros(3), np.ones(2))
    held = [("weaka", set()), ("weakb", {"b"}), ("stronga", {"a"})] * 5
    best = subjects.calibrated(held, lexicon)
    assert best[0] > 0.8 >= best[1]


def test_sample_is_bounded_by_characters(spark):
    from larkspan.llm import subjects

    documents = spark.createDataFrame([(i, "x" * (10 * (i + 1))) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "law") for i in range(20)], "doc_id bigint, subject string")
    whole = [len(t) for t, _ in subjects.labelled_sample(documents, labels)]
    some = [len(t) for t, _ in subjects.labelled_sample(documents, labels, characters=500)]
    assert len(whole) == 20 and sum(some) <= 500 and some == whole[: len(some)]
    assert len(subjects.labelled_sample(documents, labels, most=7)) == 7
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(subjects, "MOST_SUBJECTS", 1)
        with pytest.raises(ValueError):
            subjects.subject_names(spark.createDataFrame([("a",), ("b",)], "subject string"))
