import numpy as np
import public_tokenizers

from tests.llm.fixtures import documents, nothing
from vellum.llm.op04_language import Pieces, expected, fit, forward, op4_language, predict_languages, words_of
from collections import Counter

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, known, longest):
    if not word:
        yield []
    for k in range(1, min(len(word), longest) + 1):
        if word[:k] in known or k == 1:
            for rest in segmentations(word[k:], known, longest):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    have = Pieces(PATH)
    rng = np.random.default_rng(2)
    p = np.zeros((have.none + 1, 3))
    p[: have.unknown + 1] = rng.random((have.unknown + 1, 3)) * 0.01
    for word in ("▁the", "▁übung", "▁abc漢", "▁nation"):
        alpha, logs = forward(have.grid([word]), p)
        got = alpha[-1][0] * np.exp(logs[-1][0])
        splits = list(segmentations(word, have.number, 10))
        want = sum(np.prod([p[have.number.get(x, have.unknown)] for x in s], axis=0) for s in splits)
        assert np.allclose(got, want)
        q = p.copy()
        uses = expected(have, q, 1, Counter({word: 2}))
        weight = [np.prod([q[have.number.get(x, have.unknown), 1] for x in s]) for s in splits]
        first = splits[0][0]
        share = sum(w * s.count(first) for w, s in zip(weight, splits)) / sum(weight)
        assert np.isclose(uses[have.number.get(first, have.unknown)], 2 * share)


def test_accuracy_and_undetermined(spark):
    sf = "/root/testdata/sf0.01"
    got = op4_language(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_letters_and_marks():
    assert words_of("½ ² Ⅷ 12_3 ª") == ["ª"] and words_of("½²Ⅷ漢") == ["漢"]
    assert words_of("E\u0301lan क\u093c x_y") == ["e\u0301lan", "क\u093c", "x", "y"]


def test_every_piece_of_the_vocabulary_counts():
    have = Pieces(PATH)
    long = max(have.number, key=len)
    assert len(long) == have.longest > 10 and have.grid([long])[0, -1, len(long) - 1] == have.number[long]


def test_odd_rows(spark):
    docs = documents(spark)
    got = predict_languages(docs, fit(docs, PATH)).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (70, 71, 72, 78))
    assert {r["lang_pred"] for r in got} <= {"a", "b", "und"}
    empty = nothing(spark)
    assert predict_languages(empty, fit(empty, PATH)).collect() == []
    assert {r["lang_pred"] for r in predict_languages(docs, fit(empty, PATH)).collect()} == {"und"}
