import random

from valora.llm import language_id as L

VOCAB = {"aa": "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod".split(),
         "bb": "krach wumm plötzlich straße über größer fünfzig zwölf möglich".split(),
         "cc": "qui oiseau château forêt élève naïveté façade garçon où".split()}


def text(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(VOCAB[lang]) + r.choice(["", "", ".", ","]) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(spark):
    rows = [(i, text(lang, i), lang, "x") for i, lang in enumerate(list(VOCAB) * 60)]
    rows += [(900, None, "aa", "x"), (901, "", "aa", "x"), (902, "123 !!", "bb", "x"), (903, text("bb", 1, 40_000), None, "x"),
             (904, rows[0][1].upper(), None, "x"), (None, text("cc", 5), "cc", "x"), (0, rows[0][1], "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.fit_documents(docs)
    assert set(model) == set(VOCAB)
    out = L.predict(docs, model).withColumn("held", L.held_out())
    assert out.columns == [*docs.columns, "lang_pred", "_score", "rejected", "held"]
    got = out.collect()
    held = [r for r in got if r["held"] and r["doc_id"] < 900]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "aa"]
    assert by[900]["rejected"] and by[900]["_score"] == 0 and not by[None]["held"]
    assert all(0 <= r["_score"] <= 1 for r in got)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901, 902})


def test_ties_one_language_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "xyz", "aa")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.predict(docs, {}).collect()} == {"und"}
    assert {r["lang_pred"] for r in L.predict(docs, {"aa": b"some text of aa"}).collect()} == {"aa"}
    tie = L.predict(docs, {"aa": b"some text here", "bb": b"some text here"}).collect()
    assert all(r["lang_pred"] == "aa" and r["rejected"] for r in tie)
    assert L.predict(docs.limit(0), L.fit(docs.limit(0))).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(1000 + i, f"noise{i}", f"a{i:03}") for i in range(330)]  # sort before the others
    rows += [(i, text(lang, i), f"z{lang}") for i, lang in enumerate(list(VOCAB) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit_documents(docs)
    assert len(model) > 200
    some = docs.where("doc_id < 1000").withColumn("held", L.held_out())
    got = L.predict(some, model).collect()  # more than one block
    held = [r for r in got if r["held"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    monkeypatch.setattr(L, "BLOCK_LANGS", 1000)
    assert sorted(L.predict(some, model).collect()) == sorted(got)


def test_samples_come_from_all_of_a_text(spark):
    front = "same words at the start of every page " * 80  # more than SAMPLE_CHARS
    rows = [(i, front + text(lang, i, 1000), lang) for i, lang in enumerate(list(VOCAB) * 20)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    ask = spark.createDataFrame([(i, text(lang, 99 + i), lang) for i, lang in enumerate(list(VOCAB) * 10)],
                                "doc_id long, text string, lang string")
    got = L.predict(ask, model).collect()
    assert all(r["lang"] == r["lang_pred"] and not r["rejected"] for r in got)


def test_all_sampled_documents_are_in_the_dictionary(spark):
    rows = [(i, f"{'ж' * 2500} word{chr(97 + i // 20)}{chr(97 + i % 20)} {'ж' * 20}", "aa") for i in range(200)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model["aa"]) <= L.DICT_BYTES
    assert sum(f"word{chr(97 + i // 20)}{chr(97 + i % 20)}".encode() in model["aa"] for i in range(200)) == 200


def test_dictionaries_of_any_number_of_labels_are_bounded(spark, monkeypatch):
    noisy = {f"n{i}": 1 + i % 3 for i in range(5000)} | {"en": 3_000_000, "zh": 2_000_000}
    size = L.room(noisy)
    assert sum(size.values()) <= 2 * L.DICT_TOTAL and min(size.values()) >= 4096
    assert size["en"] == size["zh"] == L.DICT_BYTES
    assert sum(L.room({str(i): 1 for i in range(300_000)}).values()) <= 2 * L.DICT_TOTAL
    assert set(L.room({str(i): i for i in range(200)}).values()) == {L.DICT_BYTES}
    monkeypatch.setattr(L, "DICT_TOTAL", 40_000)
    rows = [(1000 + i, f"noise{i} " * 40, f"a{i:03}") for i in range(60)]
    rows += [(i, text(lang, i), f"z{lang}") for i, lang in enumerate(list(VOCAB) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert len(model) == 63 and sum(map(len, model.values())) <= 80_000
    got = L.predict(docs.where("doc_id < 1000"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_the_fewest_bytes_win(spark):
    """Against a plain count of the compressed bytes."""
    import zstandard as zs
    rows = [(i, text(lang, i, 5 + i * 7), lang) for i, lang in enumerate(list(VOCAB) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    for r in L.predict(docs, model).collect():
        body, sizes = L.letters(r["text"]), {}
        for lang, content in model.items():
            one = zs.ZstdCompressor(level=L.LEVEL, write_content_size=False, write_dict_id=False,
                                    dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT))
            sizes[lang] = sum(len(one.compress(body[p: p + L.CHUNK])) for p in range(0, len(body), L.CHUNK))
        best, second = sorted(sizes.values())[:2]
        assert r["lang_pred"] == min(sizes, key=lambda k: (sizes[k], k))
        assert abs(r["score"] - (second - best) / second) < 1e-12 and r["rejected"] == (r["score"] < L.MIN_MARGIN)
