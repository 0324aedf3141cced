"""Text unlike all learned languages is rejected, and clean text is not."""

import base64
import random

import pytest

from protospan.llm import langid

WORDS = {
    "en": "the of and with that this from have which their would about people other there after where through".split(),
    "de": "der die und nicht über mit sich auch wird werden einer durch zwischen sprechen gegen schon wieder".split(),
    "fr": "le la des être avec pour dans été nous vous toujours quelque beaucoup leurs aussi chaque après".split(),
}
FINNISH = "ja on ei että hän mutta kuin kaikki sitten nyt vielä täällä yksi kaksi päivä yötä hyvää kiitos tyttö".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(30, 60)))
    clean = [(i, text(WORDS[list(WORDS)[i % 3]]), list(WORDS)[i % 3]) for i in range(600)]
    other = [(1000 + i, text(FINNISH), None) for i in range(50)]
    junk = [(2000 + i, base64.b64encode(rng.randbytes(300)).decode(), None) for i in range(50)]
    numbers = [(3000 + i, "x " + " ".join(f"{rng.random():.5f}" for _ in range(60)), None) for i in range(50)]
    return clean + other + junk + numbers


def test_unlike_text_is_rejected(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.predict(docs, langid.learn(docs)).collect()
    share = lambda a, b: sum(r.rejected for r in got if a <= r.doc_id < b) / sum(a <= r.doc_id < b for r in got)
    assert share(0, 600) <= 0.03
    assert all(r.lang == r.lang_pred for r in got if r.doc_id < 600)
    assert share(1000, 1050) >= 0.9 and share(2000, 2050) == 1 and share(3000, 3050) == 1
