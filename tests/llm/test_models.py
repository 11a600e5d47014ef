from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from shopflow.llm import chat, language, packing, quality, toxicity
from shopflow.llm.common import fold_of
from shopflow.llm.labelled import labelled_sample
from shopflow.llm.queries import learnable, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def accuracy(scores, labels, label, limit):
    held = scores.join(labels, "doc_id").where(fold_of(F.col("doc_id"), 5) == 0)
    right = (F.col("score") >= limit).cast("int") == F.col(label)
    return held.agg(F.avg(right.cast("double"))).first()[0]


def test_toxicity_of_held_out_rows(tables, make_docs):
    docs, labels = tables
    model = toxicity.learn(docs, labels, learnable())
    assert accuracy(toxicity.score(docs, model), labels, "toxic", 0.5) > 0.95
    odd = toxicity.score(make_docs([None, "", "word " * 50_000, "...", "same", "same"]), model).collect()
    assert len(odd) == 6 and all(0 <= r.score < 0.5 for r in odd)


def test_samples_are_bounded_in_rows_where_ids_repeat(spark, make_docs):
    docs = make_docs([(7, f"copy {k:03}") for k in range(300)] + [(8, None), (9, "b"), (9, None), (None, "z")])
    labels = spark.createDataFrame([(7, 1), (7, 1), (7, 0), (8, 0), (9, 1), (10, 1), (None, 1), (9, None)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 50).collect()
    assert sorted(map(tuple, sample)) == [("", 0), ("", 1), ("copy 000", 0), ("copy 000", 1)]
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), 1).collect()) == 2


def test_languages_are_bounded_in_rows_and_number(spark):
    rows = [(1, f"text {k:03}", "en") for k in range(300)] + [(k, f"more {k}", "en") for k in range(2, 40)]
    rows += [(k, f"texte {k}", "fr") for k in range(30)] + [(1, "texte", "fr"), (2, None, "fr"), (3, "4", "fr")]
    rows += [(k, "junk", f"x{k}") for k in range(20)] + [(None, "text", "en"), (5, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sample = language.sample_of(docs, F.lit(True), 10, 2).collect()
    ids = {lang: sorted(r.doc_id for r in sample if r.lang == lang) for lang in ("en", "fr")}
    assert len(sample) == 20 and all(len(set(v)) == 10 for v in ids.values())
    assert all(r.text == {"en": "text 000" if r.doc_id == 1 else f"more {r.doc_id}", "fr": "texte" if r.doc_id == 1 else f"texte {r.doc_id}"}[r.lang] for r in sample)
    every = language.sample_of(docs, F.lit(True), 1000, 200).collect()
    assert sorted({r.lang for r in every}) == sorted(["en", "fr", *(f"x{k}" for k in range(20))]) and len(every) == 39 + 30 + 20


def test_nothing_to_learn_from(tables):
    docs, labels = tables
    none = labels.where("doc_id < 0")
    assert toxicity.score(docs, toxicity.learn(docs, none, learnable())).where("score >= 0.5").count() == 0
    assert quality.score(docs, quality.learn(docs, none, learnable())).where("score is null").count() == 0
    nothing = language.predict(docs, language.learn(docs, F.lit(False)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_grammar_weighs_what_stands_around():
    reader = toxicity.Reader({"fool": 1.0, "idio*": 2.0})
    weight = lambda s: reader.clause(s.split())
    assert weight("a fool came") == 1.0 and weight("idiots") == 2.0 and weight("nothing here") == 0.0
    assert weight("you fool") == 1.5
    assert weight("not a fool") == pytest.approx(0.3)
    assert weight("not one two three four fool") == 1.0
    assert weight("he said fool") == pytest.approx(0.75)
    assert weight("kill you") == pytest.approx(3.0 / 2 * 2.0)
    assert weight("kill the lights") == 0.0


def test_composition_is_one_after_the_other():
    parts = (toxicity.negation(), toxicity.reported(), toxicity.threats(), toxicity.targeted())
    whole = toxicity.grammar()
    draw = random.Random(1)
    for _ in range(200):
        symbols = draw.choices("oithnr", k=12)
        states, state = [0] * 4, 0
        for s in symbols:
            out, weight = s, 1.0
            for k, p in enumerate(parts):
                states[k], out, w = p.step(states[k], out)
                weight *= w
            state, written, total = whole.step(state, s)
            assert written == out and total == pytest.approx(weight)


def test_quality_of_held_out_rows(tables, make_docs):
    docs, labels = tables
    model = quality.learn(docs, labels, learnable())
    assert accuracy(quality.score(docs, model), labels, "quality", 0.3) > 0.95
    odd = quality.score(make_docs([None, "", "word " * 50_000, "!!!", "same", "same"]), model).collect()
    assert len(odd) == 6 and all(0 <= r.score <= 1 for r in odd)


def test_discriminant_is_the_difference_of_log_densities():
    draw = np.random.default_rng(2)
    x = [draw.standard_normal((500, 3)) @ np.diag([1, 2, 3.0]), draw.standard_normal((300, 3)) + 1]
    sums = [np.array([len(v) for v in x], float), np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x])]
    model = quality.fit(*sums, pooled_share=0.0, diagonal_share=0.0, ridge=0.0)
    at = draw.standard_normal((20, 3))
    density = []
    for k, v in enumerate(x):
        lean = 3 / (3 + len(v))  # as few rows as statistics lean on both classes
        pooled = sum((u - u.mean(0)).T @ (u - u.mean(0)) for u in x) / (len(x[0]) + len(x[1]) - 2)
        cov = (1 - lean) * np.cov(v.T) + lean * pooled
        gap = at - v.mean(axis=0)
        m = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
        density.append(np.log((len(v) + 0.5) / 801) - 0.5 * (m + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(density[0] - density[1])))


def test_language_of_held_out_rows(tables, make_docs):
    docs, _ = tables
    model = language.learn(docs, fold_of(F.col("doc_id"), 3) != 1)
    found = language.predict(docs, model).join(docs, "doc_id").where(fold_of(F.col("doc_id"), 3) == 1)
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = {r.doc_id: r for r in language.predict(make_docs([None, "", "123 !", "the and", "la " * 90_000, "² ½ ① Ⅷ _"]), model).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2, 5)] == ["und"] * 4 and odd[3].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in odd.values())


def test_gradients_of_the_network():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 256, (5, 2))
    w = language.initial(2)
    table_, loop = w["byte0"].astype(np.float64), w["loop0"].astype(np.float64)
    aim = draw.standard_normal((5, 2, language.HIDDEN)).astype(np.float32)
    loss = lambda t, u: float((language.read(x, t, u)[1:] * aim).sum())
    trace: list = []
    states = language.read(x, table_, loop, trace)
    table_grad, loop_grad = language.read_back(x, loop, states, trace, aim)
    for place in ((0, 0), (3, 20), (7, 30)):
        moved = loop.copy()
        moved[place] += 1e-2
        back = loop.copy()
        back[place] -= 1e-2
        assert (loss(table_, moved) - loss(table_, back)) / 2e-2 == pytest.approx(loop_grad[place], abs=2e-2)
    place = (int(x[2, 1]), 5)
    moved, back = table_.copy(), table_.copy()
    moved[place] += 1e-2
    back[place] -= 1e-2
    assert (loss(moved, loop) - loss(back, loop)) / 2e-2 == pytest.approx(table_grad[place], abs=2e-2)


def cheapest(roles):
    best = None
    for new in itertools.product(range(3), repeat=len(roles)):
        state, cost = 0, 0
        for role, n in zip(roles, new, strict=True):
            if (state, n) not in chat.MOVES:
                break
            cost += chat.MOVES[state, n][0] + chat.relabel_cost(role, n)
            state = n + 1
        else:
            best = cost if best is None else min(best, cost)
    return best


def test_repairs_cost_least(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 5)
    monkeypatch.setattr(chat, "FAN", 4)
    draw = random.Random(2)
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(c or None, t, draw.choice(roles), f"{c}.{t}") for c in range(25) for t in range(draw.randint(1, 6))]
    rows += [(999, t, draw.choice(roles[:3]), f"long {t}") for t in range(400)]  # over all tasks
    rows += [(77, 1, "user", "same")] * 30 + [(78, None, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.repaired(turns).toPandas()
    assert len(got) == len(rows)
    for conv in {r[0] for r in rows}:
        mine = got[got.conv_id.isna() if conv is None else got.conv_id == conv].sort_values("place")
        own = [r for r in rows if r[0] == conv]
        assert mine.place.tolist() == list(range(len(own)))
        if len(own) <= 6:
            assert mine.cost.sum() == cheapest([r[2] for r in sorted(own, key=lambda r: r[1] or 0)])
    long = got[got.conv_id == 999].sort_values("place")
    cost = np.array([0] + [chat.FREE] * 3)
    for r in (r[2] for r in rows if r[0] == 999):
        cost = (cost[:, None] + chat.step(r)).min(axis=0)
    assert long.cost.sum() == cost.min()
    heads = [p.split("\n")[0] for p in "".join(long.rendered).split(chat.OPEN)[1:]]
    assert all(a != b for a, b in itertools.pairwise(heads)) and "system" not in heads[1:]


def test_chat_of_legal_and_of_no_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.repaired(turns).orderBy("place").collect()
    assert "".join(r.rendered for r in got) == "".join(
        f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, _, role, text in rows
    )
    assert sum(r.cost for r in got) == 0
    assert chat.repaired(turns.where("turn > 9")).count() == 0


def test_pipeline_keeps_what_each_stage_should(spark, tables):
    docs, labels = tables
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, seen, SF)
        assert after.columns == docs.columns, name
        assert after.join(seen, "doc_id", "left_anti").count() == 0
        kept.append({r.doc_id for r in after.select("doc_id").collect()})
        seen = after
    truth = labels.groupBy().agg(
        F.collect_set(F.when(F.col("toxic") == 1, F.col("doc_id"))), F.collect_set(F.when(F.col("toxic") == 0, F.col("doc_id")))
    ).first()
    assert len(kept[0] & set(truth[0])) <= 0.15 * len(truth[0])
    assert len(set(truth[1]) - kept[0]) <= 0.02 * len(truth[1])
    pieces = packing.pack(seen, corpus_pipeline.VOCABULARY)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept[2]


def test_pipeline_of_an_odd_table(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "some text"), (3, "some text " * 9)])
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    empty = docs.where("doc_id > 9")
    for _, stage in corpus_pipeline.STAGES:
        empty_after = stage(spark, empty, SF)
        assert empty_after.count() == 0
