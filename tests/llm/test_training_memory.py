"""The driver holds no memory of the training once the language model is learned."""

from genorigin.llm import langid


def test_memory_of_the_training_is_given_back(spark, monkeypatch):
    told, train, release = [], langid.train, langid.release
    monkeypatch.setattr(langid, "train", lambda *args: told.append("train") or train(*args))
    monkeypatch.setattr(langid, "release", lambda: told.append("release") or release())
    model = langid.fit(spark.createDataFrame([(k, f"some words {k}", "en") for k in range(40)], "doc_id long, text string, lang string"))
    assert model.languages == ["en"] and told[told.index("train") :] == ["train", "release"]
