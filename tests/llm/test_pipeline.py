"""The pipeline on a small corpus, each stage against a plain computation from what the stage before it kept."""

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_equality import alike, kmers  # noqa: E402

import corpus_pipeline  # noqa: E402
from quorum.llm import langid, quality  # noqa: E402
from quorum.llm.common import stored  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage returned for them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF)))
    return out


def plain(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "suffix-array dedup", "packing"]
    assert all(x.columns == stages[0].columns for x in stages[:-1])
    last = sorted(map(tuple, stages[-1].drop("sequence_id", "offset").collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == last


def test_quality_stage(spark, stages):
    docs, kept = plain(stages[0]), plain(stages[1])
    model = quality.fit_on(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    said = {r.doc_id: r.kept for r in quality.judged(stages[0], model).collect()}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        assert (i in kept) == (not failed and said[i])
        assert i not in kept or kept[i] == text
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 AND toxic = 0").collect()}
    long_enough = {i for i in good if i in docs and len((docs[i] or "").split()) >= 40}
    assert len(long_enough & set(kept)) >= 0.9 * len(long_enough)


def test_language_stage(spark, stages):
    before, kept = plain(stages[1]), plain(stages[2])
    said = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(stages[1], langid.fit(stages[1])).collect()}
    assert set(kept) == {i for i in before if said[i][0] != langid.UND and said[i][1] >= corpus_pipeline.LEAST_SCORE}
    assert all(kept[i] == before[i] for i in kept) and len(kept) >= 0.9 * len(before)


def test_near_dedup_stage(stages):
    before, kept = plain(stages[2]), plain(stages[3])
    ids, labs = sorted(before), {i: kmers(t or "") for i, t in before.items()}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = labs[i], labs[j]
            if not a and not b or a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and alike(a, b) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert set(kept) == {i for i in ids if find(i) == i} and all(kept[i] == before[i] for i in kept)
    assert len(kept) < len(before)


def test_suffix_stage(stages):
    before, kept = plain(stages[3]), plain(stages[4])
    first = {}
    for i in sorted(before):
        b = (before[i] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    removed = 0
    for i, text in before.items():
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k] += 1
                gone[k + 50 if k + 50 < len(gone) else len(b)] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        removed += int(gone.sum())
        # a character goes when all its bytes go
        out, at = [], 0
        for ch in text or "":
            n = len(ch.encode())
            if not gone[at : at + n].all():
                out.append(ch)
            at += n
        want = "".join(out)
        if gone.any() and not want:
            assert i not in kept
        else:
            assert (kept[i] or "") == want
    assert removed > 0


def test_packing_stage(stages):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts, pieces = plain(stages[4]), {}
    for x in stages[5].collect():
        pieces.setdefault(x.doc_id, []).append(x)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids, at = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for x in sorted(pieces[i], key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    fill = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(x.n == x.end <= 2048 for x in fill)
    assert len(fill) <= -(-sum(x.n for x in fill) // 2048) + 1
