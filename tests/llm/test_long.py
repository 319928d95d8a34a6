"""Every text operator over very long texts beside null, empty and repeated ones, in one Arrow batch."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuelake.llm import langid, lines, media, neardup, packing, pieces, quality, simhash
from cuelake.llm.common import text_slices, values


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(11)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(3000)]
    text = " ".join(rng.choices(words, k=700_000))  # about 4 MB
    return [None, "", text, text, text[:2_000_000] + "\n" + "x" * 1_500_000, "short one", "\n" * 200_000 + "short one"]


@pytest.fixture(scope="module")
def docs(spark, long_texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "docs")
    rows = [(k, t, "en" if k % 2 else "fr") for k, t in enumerate(long_texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_slices_are_bounded_and_whole(long_texts):
    import pyarrow as pa

    array = pa.array(long_texts, pa.string())
    assert list(values(array)) == long_texts and list(values(array.slice(2, 3))) == long_texts[2:5]
    assert all(len(part) == 1 or sum(len(x or "") for x in part.to_pylist()) <= 1 << 20 for part in text_slices(array))
    assert list(values(pa.array([], pa.string()))) == []


def test_pieces_and_words(docs, long_texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for k in (0, 1, 2, 3, 5, 6):
        want = model.encode(long_texts[k] or "")
        assert got[k].ids == want and got[k].decoded == model.decode(want)
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(docs, path).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    whole = Tokenizer.from_file(path)
    for r in packed:
        if r.doc_id != 4:
            n = len(whole.encode(long_texts[r.doc_id] or "", add_special_tokens=False).ids) + 1
            assert (r.n, r.last) == (n, (n - 1) // 4096)


def test_scores_lines_and_media(spark, docs, long_texts):
    model = langid.fit(docs)
    told = langid.identify_documents(docs, model).collect()
    assert len(told) == 7 and {r.doc_id for r in told if r.lang_pred == "und"} == {0, 1}
    forest = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(7)], "doc_id long, quality int"))
    assert quality.score_documents(docs, forest).where("score between 0 and 1").count() == 7
    kept = {r.doc_id: r for r in lines.drop_shared_lines(docs, min_docs=2).collect()}
    assert kept[6].n_lines == 200_001 and kept[6].n_dropped == 1 and kept[6].kept_text == "\n" * 199_999
    assert (kept[2].n_dropped, kept[2].kept_text, kept[4].n_dropped, kept[0].kept_text) == (1, "", 0, "")
    stored = media.media_column(docs).select("doc_id", "n_bytes", F.sha2("payload", 256).alias("sha"), F.crc32("payload").alias("crc")).collect()
    for r in stored:
        payload = media.pad((long_texts[r.doc_id] or "").encode())
        assert (r.sha, r.crc) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload))


def test_near_duplicates(docs):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found[0] == found[1] == 0 and found[2] == found[3] == 2 and found[5] == found[6] == 5
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).select("doc_id").collect()) == [0, 2, 4, 5]
