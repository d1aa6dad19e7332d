from __future__ import annotations

import random
import time
import zlib
from itertools import combinations

import numpy as np
from covaria.llm import toxicity
from covaria.llm.queries import QUERIES


def spread(word):
    """Subsequences of three letters by their weight, by plain enumeration."""
    held = {}
    for places in combinations(range(len(word)), 3):
        key = "".join(word[i] for i in places)
        held[key] = held.get(key, 0.0) + toxicity.DECAY ** (places[-1] - places[0] + 1)
    return held


def brute_kernel(a, b):
    x, y = spread(a), spread(b)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def test_kernel_equals_enumeration():
    words = ["idiot", "idixot", "banana", "aaa", "at", "statistic", "x", "trash", "crash"]
    marks = ["idiot", "trash", "anan"]
    want = [[brute_kernel(w, m) for m in marks] for w in words]
    assert np.allclose(toxicity._kernel(words, marks), want)


def test_scorer_is_the_trained_kernel_machine():
    scorer = toxicity.Scorer(np.array([5]), np.array([1.0]), -0.5)
    tokens = toxicity.tokens_of("S t u p i d st-upid $cum x" + "y" * 40)
    assert "stupid" in {toxicity.letters_of(t) for t in tokens} and toxicity.letters_of("$cum") == "scum"
    assert [len(s) for s in toxicity.strings_of("y" * 40)] == [16, 16, 16, 16]
    assert scorer.texts([set()]).tolist() == [[-1.0, -1.0, 0.0]]


def model():
    draw = random.Random(2)
    word = lambda: "".join(draw.choices("bcdgmnprst", k=3)) + draw.choice(["ing", "ed", "er", "le"])
    clean = [{word() for _ in range(20)} | {"closer", "the"} for _ in range(120)]
    toxic = [{word() for _ in range(20)} | {"the", draw.choice(["gruffle", "snorkle"])} for _ in range(40)]
    return toxicity.train(toxic, clean)


def test_gapped_and_inserted_insults(spark):
    texts = ["you gruffle", "you gru-ffle!", "g r u f f l e", "you gruxffle", "snorklle", "closer the banter", "", None]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "you gruffle", 9), (0, "you gruffle", 9)], "doc_id long, text string, score int")
    rows = toxicity.scored(docs, model()).collect()
    scores = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert min(scores[i] for i in range(5)) > 0.3 > max(scores[i] for i in (5, 6, 7))
    assert scores[None] == scores[0]
    assert toxicity.scored(docs.limit(0), model()).collect() == []


def corpus(insults, n_toxic=1000, n_clean=3000, seed=3):
    """Texts of everyday and of chance words; a toxic one has one insult, or one inside another word."""
    draw = random.Random(seed)
    syllable = lambda: draw.choice("bcdfglmnprst") + draw.choice("aeiou") + draw.choice(["", "n", "r", "s"])
    common = ["".join(syllable() for _ in range(draw.randint(1, 3))) for _ in range(800)]
    text = lambda: {draw.choice(common) for _ in range(25)} | {"".join(syllable() for _ in range(3)) for _ in range(6)}
    toxic = [text() | {insults(draw)} for _ in range(n_toxic)]
    return toxic, [text() for _ in range(n_clean)]


def held_out(insults):
    model = toxicity.train(*corpus(insults, seed=3))
    toxic, clean = corpus(insults, 300, 900, seed=4)
    scorer = toxicity.Scorer(np.array(model["codes"], np.int64), np.array(model["weights"]), model["bias"])
    scores = toxicity.chance(model, scorer.texts(toxic + clean))
    return (scores[:300] >= toxicity.THRESHOLD).mean(), (scores[300:] >= toxicity.THRESHOLD).mean()


def test_many_insults():
    draw = random.Random(5)
    names = ["".join(draw.choices("hjkvwxyzqu", k=draw.randint(5, 8))) for _ in range(150)]
    recall, false = held_out(lambda d: d.choice(names))
    assert recall >= 0.9 and false <= 0.03


def test_insults_of_three_letters():
    recall, false = held_out(lambda d: d.choice(["zug", "vok", "jix", "wuz", "qep"]))
    assert recall >= 0.9 and false <= 0.03


def test_insults_inside_other_words():
    draw = random.Random(6)
    carriers = ["".join(draw.choices("abcdefgilmnoprst", k=6)) for _ in range(400)]
    inside = lambda d: (lambda w, at: w[:at] + d.choice(["gruvk", "wozzek", "kwyj"]) + w[at:])(d.choice(carriers), d.randint(0, 6))
    recall, false = held_out(inside)
    assert recall >= 0.9 and false <= 0.03


def test_chances_are_those_of_all_labelled_rows():
    toxic, clean = corpus(lambda d: d.choice(["gruvk", "wozzek"]), 200, 600)
    even = toxicity.train(toxic, clean)
    rare = toxicity.train(toxic, clean, counts=(200, 60_000))
    assert rare["share"] < 0.01 < even["share"] and rare["sigmoid"][-1] < even["sigmoid"][-1]


def test_scores_equal_a_plain_kernel_machine(spark):
    """The score of a text from its words, by enumeration of subsequences."""
    made = model()
    weights = dict(zip(made["codes"], made["weights"], strict=True))
    code = lambda k: int(np.array([toxicity._letters([c])[0] for c in k]) @ [toxicity.LETTERS**2, toxicity.LETTERS, 1])

    def margin(word):
        held = spread(word)
        norm = np.sqrt(sum(v * v for v in held.values())) or 1.0
        return made["bias"] + sum(v * weights.get(code(k), 0.0) for k, v in held.items()) / norm

    for text in ("you gruffle", "closer the banter", "a snorxkle of it", "", "of a"):
        margins = sorted((max(map(margin, toxicity.strings_of(t))) for t in toxicity.tokens_of(text)), reverse=True)
        top = (margins + [min(made["bias"], -1.0)] * 4)[:4]
        features = [top[0], np.mean(top[1:]), sum(m > 0 for m in margins) / np.log(np.e + len(margins))]
        want = 1 / (1 + np.exp(-(np.dot(features, made["sigmoid"][:3]) + made["sigmoid"][3])))
        frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert abs(toxicity.scored(frame, made).first()["score"] - want) < 1e-9


def test_ruled_lines_are_read_once():
    for line in ("." * 10_000 + "12", "-" * 10_000 + "ab", "_" * 10_000 + "x", ". " * 10_000 + "ab", "a." * 10_000 + "bc"):
        start = time.perf_counter()
        toxicity.tokens_of(line)
        assert time.perf_counter() - start < 0.1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.judged(docs, labels).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in toxicity.judged(docs, odd).collect()}) == 1


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in rows.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    held = [(r["toxic"], rows[r["doc_id"]]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    hits = sum(r["predicted"] for t, r in held if t == 1) / sum(t == 1 for t, _ in held)
    false = sum(r["predicted"] for t, r in held if t == 0) / sum(t == 0 for t, _ in held)
    assert hits > 0.75 and false < 0.03  # 290 toxic documents to learn from
