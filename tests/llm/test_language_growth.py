"""What the language model gathers grows with its corpus, and scores of unseen texts with it."""

import random

from pyspark.sql import functions as F

from llm_support import bucket
from tidemark.llm import language_model


def corpus(documents: int) -> list[tuple[int, str]]:
    """Words of one ending, each with followers of its own: classes alone cannot tell them apart."""
    rng = random.Random(4)
    kinds = ["ax", "ey", "iz", "oq", "uv"]
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}on" for i in range(240)]
    follows = {w: rng.choice(kinds) for w in words}
    out = []
    for i in range(documents):
        picked = [rng.choice(words) for _ in range(60)]
        out.append((i, " ".join(f"{w} n{rng.randrange(12)}{follows[w]}" for w in picked)))
    return out


def test_more_text_gives_more_vectors_and_better_scores(spark, monkeypatch):
    monkeypatch.setattr(language_model, "OWN", 4)
    rows, held, vectors = corpus(1200), {}, {}
    for share in (40, 1200):
        # The same unseen texts, and ever more to learn from.
        docs = spark.createDataFrame([r for r in rows if r[0] < share or bucket(r[0], 7) == 2], "doc_id long, text string")
        out = language_model.score(docs)
        held[share] = out.where("held_out").agg(F.sum("score") - F.sum("base_score"), F.sum("n_tokens")).first()
        lex = language_model.lexicon(language_model.vocabulary(docs.where(F.col("doc_id").isin([r[0] for r in rows if r[0] < share and bucket(r[0], 7) != 2]))))
        vectors[share] = int((lex.counts >= language_model.SEEN).sum())
    assert vectors[1200] > vectors[40] + 200
    assert held[40][1] == held[1200][1]
    # Over the unigrams of the same corpus, which gain from more text too.
    assert held[1200][0] / held[1200][1] > held[40][0] / held[40][1] + 0.1
