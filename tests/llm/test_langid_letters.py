"""What counts as a letter, and language scores against a plain scorer."""

import math
import random

import pytest

pytest.importorskip("public_tokenizers")

from lattica.llm import langid, tokens  # noqa: E402
from lattica.llm.common import held  # noqa: E402


def _learned(spark):
    rng = random.Random(4)
    rows = []
    for lang, words in (("en", "the and house river stone of with".split()), ("de", "der und haus fluss stein von mit".split())):
        rows += [(i, " ".join(rng.choice(words) for _ in range(30)), lang) for i in range(40)]
    return langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_numbers_and_signs_that_are_no_letters(spark):
    model = _learned(spark)
    for text in ("5² ½", "Ⅷ ①②", "٣ ४", "!? _ 12", "", " \n"):
        assert model.predict(text) == ("und", 0.0), text
    rows = [(1, "5² ½ Ⅷ ①"), (2, "haus und fluss"), (3, "the river ² house"), (4, None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "de", 3: "en", 4: "und"}


def test_scores_equal_a_plain_scorer(spark):
    import regex

    model = _learned(spark)

    def plain(text):
        logs, n = [0.0] * len(model.langs), 0
        for word in regex.findall(r"\p{L}+", text.lower()):
            n += 1
            got = model.words.get(word)
            if got is None:  # the longest known n-gram at each place
                marked, parts = f"^{word}$", []
                for i in range(len(marked)):
                    parts += next(([model.grams[marked[i:i + k]]] for k in range(4, 0, -1) if i + k <= len(marked) and marked[i:i + k] in model.grams), [])
                got = [sum(float(p[j]) for p in parts) / max(len(parts), 1) for j in range(len(model.langs))]
            logs = [a + float(b) for a, b in zip(logs, got)]
        logs = [a * min(1.0, langid.FULL_WORDS / n) for a in logs]
        odds = [math.exp(a - max(logs)) for a in logs]
        return model.langs[odds.index(max(odds))], max(odds) / sum(odds)

    rng = random.Random(5)
    for _ in range(60):
        text = " ".join(rng.choice(["the", "und", "rivers", "hausen", "xyz,abc", "Stone", "5²", "mit-with"]) for _ in range(rng.randint(1, 60))) + " the"
        want, got = plain(text), model.predict(text)
        assert got[0] == want[0] and math.isclose(got[1], want[1], rel_tol=1e-3), text


def test_a_worker_keeps_one_operators_memory():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    first = tokens.json_encoder(path)
    assert tokens.json_encoder(path) is first
    held("something else", dict)
    assert tokens.json_encoder(path) is not first
