"""Nulls, empty tables, clashing columns, repeated rows and very long texts, for all operators and stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorum.llm import bpe, flac, html_main, langid, order_minhash, packing, quality, substring_dedup, suffix_dedup, warc
from quorum.llm.common import stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["g", "kept", "rep", "key", "length", "rank", "score", "keys", "bits", "media", "other", "salt", "__text", "_row", "h"]


def model(spark):
    return quality.fit([b"good words here"] * 3, quality.np.array([1.0, 1.0, 1.0]))


OPERATORS = {
    "op1": lambda d: substring_dedup.remove_repeats(d),
    "op2": lambda d: flac.digests(stored(flac.store(d))),
    "op3": lambda d: bpe.digests(d),
    "op4": lambda d: order_minhash.classes(d),
    "op5": lambda d: packing.pack(stored(packing.pieces(d))),
    "op6": lambda d: quality.judged(d, model(d.sparkSession)),
    "op7": lambda d: warc.records(stored(warc.scan(stored(warc.write(as_pages(d)))))),
    "op8": lambda d: suffix_dedup.remove_repeats(d),
    "op9": lambda d: langid.identified(d, langid.fit(d)),
    "op10": lambda d: html_main.extract(as_pages(d)),
}


def as_pages(d):
    return d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.concat(F.lit("http://h/"), F.col("source")))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(6)
    text = lambda n: " ".join(f"word{r.randint(0, 400)}" for _ in range(n))
    rows = [(i, text(60), ["en", "fr"][i % 2], str(i), 1) for i in range(12)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (None, None, None, None, None), (90, "", "en", "s", 0), (91, " \n\t ", "en", "s", 4), (92, None, "en", "s", None), (3, text(40), "fr", "t", 2)]
    return stored(spark.createDataFrame(rows, DOCS).repartition(3))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_and_clashing_columns(docs, name):
    plain = sorted(map(str, OPERATORS[name](docs).drop("class_key", "archive", "sequence_id", "offset").collect()))
    more = docs.withColumns({c: F.lit("clash") for c in CLASH})
    assert sorted(map(str, OPERATORS[name](more).drop("class_key", "archive", "sequence_id", "offset").collect())) == plain
    if name != "op5":
        assert len(plain) == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, tmp_path, name, stage):
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    more = docs.withColumns({c: F.lit("clash") for c in CLASH})
    out, wide = stage(spark, docs, sf), stage(spark, more, sf)
    if name != "packing":
        assert out.columns == docs.columns and wide.columns == more.columns
        assert sorted(map(str, wide.select(docs.columns).collect())) == sorted(map(str, out.collect()))
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_very_long_texts(spark):
    """Texts beyond a slice and a group, whole: what the last words change shows."""
    r = random.Random(1)
    words = [f"w{r.randint(0, 10**5)}" for _ in range(700_000)]
    long = " ".join(words)
    assert len(long) > 4 << 20
    tail = " ".join(f"t{i}" for i in range(40))
    rows = [(1, long + " " + tail), (2, "x " + tail + " y"), (3, tail[:100] + " other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {x.doc_id: x for x in substring_dedup.remove_repeats(df, texts=False).collect()}
    assert (one[1].n_words, one[1].n_removed, one[2].n_removed) == (700_040, 40, 40)
    assert one[1].kept_sha256 == hashlib.sha256(long.encode()).hexdigest()
    eight = {x.doc_id: x for x in suffix_dedup.remove_repeats(df, texts=False).collect()}
    assert eight[1].n_removed == 0 and eight[2].n_removed == len(" " + tail)  # "x" goes before it in neither text, " y" after it in one
    three = {x.doc_id: x for x in bpe.digests(df).collect()}
    assert three[1].decoded_sha256 == hashlib.sha256(rows[0][1].encode()).hexdigest()
    two = {x.doc_id: x for x in flac.digests(stored(flac.store(df))).collect()}
    assert two[1].n_bytes == len(rows[0][1])
    five = packing.pack(stored(packing.pieces(df))).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert five[0] == five[1] == three[1].n_tokens + 1
    four = {x.doc_id: x.class_id for x in order_minhash.classes(spark.createDataFrame([(1, long), (2, long + " " + tail), (3, "a b")], "doc_id long, text string")).collect()}
    assert four == {1: 1, 2: 1, 3: 3}
    page = "<p>" + long.replace(" ", "</p><p>", 60_000) + "</p>"
    ten = html_main.extract(spark.createDataFrame([(1, "http://h/a", page), (2, "http://h/b", page + "<p>end</p>")], "page_id long, url string, html string")).collect()
    assert {x.page_id: x.text.replace("\n\n", " ") for x in ten} == {1: " ".join(long.split()), 2: " ".join(long.split()) + " end"}
