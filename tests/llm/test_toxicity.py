"""The toxicity model on planted clauses: threats, negations and reports, with targets that aren't function words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import toxicity


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.1"
    return toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, text STRING").select("n", model.score(F.col("text")).alias("s")).collect()
    return [r["s"] for r in sorted(rows, key=lambda r: r["n"])]


FILL = "The weather in the valley was mild, and the river ran slowly past the old mill. "


def test_planted_threats_and_insults(spark, model):
    aimed = ["I will kill you.", "kill them all", "We shall hurt you and your family!", "Someone should shoot him.", "Je vais te tuer, toi.", "Ich werde dich umbringen."]
    insults = ["you are an idiot", "You pathetic moron!", "what a worthless clown he is", "tu es un connard"]
    tame = [
        "We will not kill you.", "He said that he would kill you.", 'She wrote: "I will kill you".', "kill the process and start again", "This does not hurt you.", "they never shoot people",
        "you are not an idiot", "he said you are an idiot", "nobody called the plan stupid", "", FILL, "shoot a film in the valley", "the stroke may destroy the engine",
    ]
    assert min(scores(spark, model, aimed + insults)) >= 0.7
    assert max(scores(spark, model, tame)) < 0.5
    assert min(scores(spark, model, [FILL * 20 + x + " " + FILL * 20 for x in aimed + insults])) >= 0.7
    assert max(scores(spark, model, [FILL * 20 + x + " " + FILL * 20 for x in tame])) < 0.5


def test_targets_are_no_function_words(model):
    learned = {w for w, (symbol, _) in model.grammar.words.items() if symbol in "YN"} - {w for k in "YN" for w in toxicity.SEEDS[k].split()}
    assert not learned & {"in", "und", "and", "the", "of", "de", "la", "die", "der", "to", "on", "et", "y", "que"}


def test_words_that_are_as_frequent_elsewhere_are_refused(spark):
    rows = [(["of", "ye", "blorp", "of", "x"], 1)] * 40 + [(["a", "of", "b", "c", "of"], 0)] * 60
    df = spark.createDataFrame(rows, "words ARRAY<STRING>, toxic INT")
    assert toxicity.scopes_of(df, {"of": 1.0, "ye": 1.0}, toxicity._before(lambda w: w == "blorp")) == ["ye"]
    assert toxicity.scopes_of(df, {}, F.col("words")) == []


def test_threats_follow_insults_without_labels_of_their_own():
    rng = np.random.default_rng(1)
    sums = np.zeros((400, len(toxicity.KINDS)))
    sums[:80, toxicity.KIND_AT["I"]] = rng.integers(1, 9, 80)
    sums[80:100, toxicity.KIND_AT["In"]] = 4
    y = (np.arange(400) < 80).astype(float)
    w = toxicity.fitted(toxicity.features(sums), y)
    one = lambda k: float((toxicity.features(5 * np.eye(len(toxicity.KINDS))[[toxicity.KIND_AT[k]]]) @ w)[0])
    assert one("Ta") == pytest.approx(one("Ia"), abs=0.5) and one("Ta") > 1 > 0 > one("T") and one("Tna") < 0 and one("Tra") < 0
