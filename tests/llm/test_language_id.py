import zlib

import zstandard as zstd
from pyspark.sql import types as T

from treeloom.llm.language_id import Classifier, fit, identify, op4

EN = "the quick brown fox jumps over the lazy dog and then they walked home with that old thing "
DE = "der schnelle braune fuchs springt über den faulen hund und dann gingen sie nach hause mit einem alten ding "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5) for i, t, lang in rows], SCHEMA)


def corpus():
    rows = [(i, (EN if i % 2 else DE) + f"w{i}", "en" if i % 2 else "de") for i in range(60)]
    return rows + [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, EN * 3000, None), (None, EN, "en"), (1, EN + "w1", "en")]


def test_predictions_and_edges(spark):
    out = {r["doc_id"]: r for r in op4(docs(spark, corpus())).collect()}
    assert op4(docs(spark, corpus())).count() == 66
    for i in range(60):
        assert out[i]["lang_pred"] == ("en" if i % 2 else "de")
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 < out[i]["score"] <= 1
    for i in (100, 101, 102):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) == ("und", 0.0, True)
    assert out[103]["lang_pred"] == "en"
    assert out[None]["held_out"] is False


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = corpus()
    wrong = [(i, t, "xx" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    get = lambda r: sorted(map(str, op4(docs(spark, r)).collect()))
    assert get(rows) == get(wrong)


def test_same_as_plain_compression(spark):
    model = fit(docs(spark, corpus()))
    assert sorted(model) == ["de", "en"]
    text = "walked over the lazy thing"
    sizes = {}
    for k, content in model.items():
        p = zstd.ZstdCompressionParameters.from_level(6, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        sizes[k] = len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=p).compress(b"walked over the lazy thing"))
    lang, margin = Classifier(model).predict(text)
    assert lang == min(sizes, key=sizes.get)
    assert margin == (max(sizes.values()) - min(sizes.values())) / max(sizes.values())


def test_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op4(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(found) > 150 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)


def test_empty_table(spark):
    empty = spark.createDataFrame([], T._parse_datatype_string(SCHEMA))
    assert op4(empty).collect() == []
    assert [r["lang_pred"] for r in identify(docs(spark, [(1, EN, "en")]), {}).collect()] == ["und"]
