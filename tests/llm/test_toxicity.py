import random

import pytest
from pyspark.sql import functions as F

from fanweave.llm import toxicity as x
from fanweave.llm.labels import in_fold

SCHEMA = "doc_id long, text string, score string, toxic int"


@pytest.mark.parametrize("text,want", [
    ("An IDIOT!", " an idiot "), ("1d10t", " idiot "), ("ｉｄｉｏｔ", " idiot "), ("іdіоt", " idiot "),
    ("i​diot", " idiot "), ("id!ot wins!", " idiot wins "), ("call 555 1234", " caii 555 1234 "),
    ("l0ser", " ioser "), ("$tup1d", " stupid "), ("", "  "), (" \n ", "  "),
])
def test_folding(text, want):
    assert x.folded(text) == want


def brute_total(model, text):
    """Weights of words by trying every entry at every word."""
    line = x.folded(text)
    # the space behind a phrase belongs to the next word
    spared = [(i, i + len(e) - 1) for e in model.exceptions for i in range(len(line)) if line.startswith(e, i)]
    total = 0.0
    for i, char in enumerate(line):
        if char == " " and not any(a <= i < b for a, b in spared):
            total += max([w for e, w in model.entries.items() if line.startswith(e, i)], default=0.0)
    return total


def test_matching_by_brute_force():
    model = x.ToxicityModel({" idiot ": 2.0, " idio": 1.5, " scum ": 3.0, " tras": 4.0},
                            exceptions=(" white trash bag ", " no scum "))
    auto, rng = model.matcher(), random.Random(2)
    bits = ["idiot", "idiotic", "scum", "trash", "white", "bag", "no", "Scum.", "scummy", "x"]
    for _ in range(500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert sum(x.matches(auto, x.folded(text)).values()) == brute_total(model, text)
    assert x.matches(None, " a ") == {}


def docs(n=1200):
    rng = random.Random(9)
    words = [a + b + c for a in ("re", "th", "on") for b in ("an", "er", "ou") for c in ("st", "ly", "")]
    bad = ["idiot", "scum", "verfluch"]
    rows = []
    for i in range(n):
        line = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                word = rng.choice(bad)
                word += rng.choice(["en", "ter", "ung"]) if word == "verfluch" else ""
                word = rng.choice([word, word.upper(), word.replace("i", "1").replace("u", "ｕ")])
                line.insert(rng.randrange(len(line)), word)
        elif rng.random() < 0.1:
            line[0:0] = ["pond", "scum"]
        rows.append((i, " ".join(line), "clash", int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = docs()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = df.select("doc_id", "toxic")
    model = x.fit_toxicity(df, labels, ~in_fold("doc_id", 4, 2))
    assert any("scum" in e for e in model.exceptions) or not any("scum" in e for e in model.entries)
    got = x.score_toxicity(df, model)
    assert got.columns == ["doc_id", "text", "toxic", "score"]
    held = got.filter(in_fold("doc_id", 4, 2)).collect()
    right = [(r.score >= 0.3) == (r.toxic == 1) for r in held]
    assert sum(right) / len(right) > 0.9
    assert all((r.score >= 0.3) for r in held if "idiot" in x.folded(r.text))


def test_odd_rows(spark):
    rows = docs(200) + [(None, "idiot", "", 1), (3, None, "", 1), (3, "", "", 0), (4, "x " * 100_000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", F.when(F.col("doc_id") < 150, F.col("toxic")).alias("toxic"))
    model = x.fit_toxicity(df, labels, ~in_fold("doc_id", 4, 2))
    scores = [r.score for r in x.score_toxicity(df, model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    none = x.fit_toxicity(df, labels.filter("toxic = 0"), ~in_fold("doc_id", 4, 2))
    assert none.entries == {} and len(x.score_toxicity(df, none).collect()) == len(rows)
    only_bad = x.fit_toxicity(df, labels.filter("toxic = 1"), ~in_fold("doc_id", 4, 2))
    assert len(x.score_toxicity(df, only_bad).collect()) == len(rows)
    assert x.score_toxicity(df.limit(0), model).collect() == []
    x.fit_toxicity(df.limit(0), labels, ~in_fold("doc_id", 4, 2))


def letters(n):
    return "".join(chr(ord("a") + int(c)) for c in f"{n:04d}") + "zz"


def test_all_contexts_and_exceptions_are_learned(spark):
    """A long toxic text speaks for all its contexts, and more than 1000 exceptions count."""
    model = x.ToxicityModel({" scum ": 3.0})
    spared = [f"{letters(n)} scum" for n in range(1100)]
    rows = [(0, " . ".join(spared), ) for _ in range(x.EXCEPTION_DOCS)]
    long_toxic = " . ".join(f"{letters(2000 + n)} scum" for n in range(200))
    rows += [(1, long_toxic), *[(0, f"zzzz scum {letters(2199)} scum") for _ in range(x.EXCEPTION_DOCS)]]
    df = spark.createDataFrame(rows, "y int, text string").repartition(2)
    schema = "y int, total double, words long, near array<string>"
    got = set(x._learn_exceptions(df.mapInArrow(x._fitting_rows(model), schema)))
    assert {x.folded(s) for s in spared} <= got
    assert x.folded(f"{letters(2199)} scum") not in got


def test_many_exceptions_take_linear_time():
    import time

    model = x.ToxicityModel({" scum ": 3.0, " idiot ": 2.0}, exceptions=(" pond scum ",))
    line = x.folded("pond scum idiot scum " * 100_000)
    start = time.perf_counter()
    found = x.matches(model.matcher(), line)
    assert len(found) == 200_000 and time.perf_counter() - start < 2


def test_no_limit_of_entries(spark):
    """Every pattern with the evidence becomes an entry, however many there are."""
    rows = [(i, " ".join(letters(n) for n in range(i % 8, 6000, 8)), int(i < 40)) for i in range(40)]
    rows += [(i, "re th on", 0) for i in range(40, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = x.fit_toxicity(df, df.select("doc_id", "toxic"), F.lit(True))
    assert all(x.matches(model.matcher(), x.folded(letters(n))) for n in range(6000))
    assert model.power > 0
