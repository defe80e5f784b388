"""SentencePiece spans and token-id shards against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb
from tokenizers import Tokenizer

from tests.llm.conftest import awkward, by_id
from weirstone.llm import id_shards, piece_codec

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def texts(n, alphabet, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]


ODD = [*"ab  \n\t▁éÑ中😀\0 x.<>0", "<s>", "<0x41>", "</s>", " the"]


def test_pieces_are_the_librarys():
    own = piece_codec.PieceCodec(MODEL)
    assert own.by_word
    for text in texts(3000, ODD, 14, 1):
        ids, begin, end = next(own.encode([text]))
        whole = own.encode_whole(text)
        assert ids.tolist() == own.library.encode(text)
        assert all((a == b).all() for a, b in zip((ids, begin, end), whole, strict=True))
        assert not len(ids) or (begin[0] == 0 and end[-1] == len(text.encode()) and (begin[1:] == end[:-1]).all())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_is_the_librarys(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = model_pb.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    own = piece_codec.PieceCodec.__new__(piece_codec.PieceCodec)
    own.spec, own.marks, own.map = model.normalizer_spec, [], piece_codec.CharacterMap(model.normalizer_spec.precompiled_charsmap)
    for text in texts(1500, [*"aB  　ﬁ①Å가①㍿ｱﾞé é½\t\nＡ"], 12, 2):
        data, begin, end = own.normalise(text.encode())
        assert data.decode() == library.normalize(text)
        assert len(begin) == len(end) == len(data) and (begin[1:] >= begin[:-1]).all() and (end >= begin).all()


def test_alignment_of_a_ligature():
    model = model_pb.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    own = piece_codec.PieceCodec.__new__(piece_codec.PieceCodec)
    own.spec, own.marks, own.map = model.normalizer_spec, [], piece_codec.CharacterMap(model.normalizer_spec.precompiled_charsmap)
    data, begin, end = own.normalise("aﬁb".encode())
    assert data.decode().lstrip("▁") == "afib"
    assert list(zip(begin[-4:].tolist(), end[-4:].tolist(), strict=True)) == [(0, 1), (1, 4), (1, 4), (4, 5)]


def test_piece_query(docs, nothing, crowded):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for key, text, *_ in awkward():
        ids = library.encode(text or "")
        want.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert by_id(piece_codec.digests(docs, MODEL).select(names).collect()) == by_id(want)
    assert by_id(piece_codec.digests(crowded, MODEL).select(names).collect()) == by_id(want)
    assert piece_codec.digests(nothing, MODEL).collect() == []
    encoded = piece_codec.encode(docs.where("doc_id = 108"), MODEL)
    row, text = encoded.first(), awkward()[49][1]
    assert piece_codec.decode(encoded, MODEL).first().text == library.decode(row.ids)
    assert row.begin[piece_codec.piece_starting_at(row.begin, 5)] <= 5 and row.end[-1] == len(text.encode())


def test_word_ids_are_the_librarys():
    own, library = id_shards.WordIds(WORDS), Tokenizer.from_file(WORDS)
    assert own.by_word
    many = texts(3000, [*"İıŉabΣS  \n\t\r\x0b\x1c　́é'sÉ中😀\0 x.,<>09", "<|endoftext|>", "<|startoftext|>", "'s", " the"], 14, 3)
    assert own.encode(many) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in many]
    other = id_shards.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word and len(other.encode(["a b"])[0]) == 4


def test_shards(spark, docs, nothing):
    library = Tokenizer.from_file(WORDS)
    folder, dictionary = id_shards.write(docs, WORDS, 1)
    out = id_shards.read(spark, folder, dictionary).orderBy("start").collect()
    keys = [r.doc_id for r in out]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = {}
    for key, text, *_ in awkward():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    folder, dictionary = id_shards.write(nothing, WORDS, 1)
    assert id_shards.read(spark, folder, dictionary).collect() == []


def test_shards_of_hot_ids(spark):
    """Rows without an id, and rows of one id, that are a third of a table each lie in several buckets, in order all the same."""
    rows = [(None, f"none {k}") for k in range(300)] + [(7, f"seven {k}") for k in range(300)] + [(k, f"own {k}") for k in range(-150, 150)]
    folder, dictionary = id_shards.write(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), WORDS, 1)
    out = id_shards.read(spark, folder, dictionary).orderBy("start").collect()
    keys = [r.doc_id for r in out]
    assert keys == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    held: dict = {}
    for r in spark.read.parquet(folder).collect():
        shard = id_shards.Shard(bytes(r.data), dictionary)
        for key in {None if none else k for k, none in zip(shard.keys.tolist(), shard.null.tolist(), strict=True)}:
            held.setdefault(key, set()).add(r.bucket)
    assert len(held[None]) > 3 and len(held[7]) > 3 and all(len(v) == 1 for k, v in held.items() if k not in (None, 7))


def test_files_do_not_depend_on_partitions(spark):
    rows = [(k, f"some words and the number {k} of {k * k % 97}") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert id_shards.train_dictionary(df.repartition(5), WORDS, "doc_id", "text") == id_shards.train_dictionary(df.coalesce(1), WORDS, "doc_id", "text")


def test_one_document_of_a_shard(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and the number "), F.col("id").cast("string")).alias("text"))
    folder, dictionary = id_shards.write(df, WORDS, 1)
    assert id_shards.export_files(spark, folder, str(tmp_path)) >= 1
    library, seen = Tokenizer.from_file(WORDS), []
    for path in sorted(tmp_path.iterdir()):
        shard = id_shards.Shard(path.read_bytes(), dictionary)
        seen += shard.keys.tolist()
        for key in shard.keys.tolist()[:3]:
            (k,) = shard.find(key)
            assert shard.ids(k).tolist() == [*library.encode(f"some words and the number {key}", add_special_tokens=False).ids, 1]
        assert len(shard.find(10**9)) == 0
        with pytest.raises(ValueError, match="dictionary"):
            id_shards.Shard(path.read_bytes(), b"x")
    assert seen == list(range(300))
    with pytest.raises(ValueError, match="no shard"):
        id_shards.Shard(b"\0" * 100, b"")
