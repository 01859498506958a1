import random

import pytest
import sentencepiece as spm
from sentencepiece import sentencepiece_model_pb2 as pb

from isopleth.llm import sentencepiece_codec as codec

PARTS = ["a", "b", "the", " ", "  ", "▁", "é", "日本", "\n", "\t", "😀", "<s>", "</s>", "<0x41>", "\0", "ing", "tion", "0", "　", "ﬁ", "Ａ", "'", "́", "-", "½", "①", "ｶﾞ", "​", "<x>"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_ids_are_the_librarys():
    model = codec.model_bytes()
    lib, own = spm.SentencePieceProcessor(model_proto=model), codec.Codec(model)
    assert own.own
    for t in [*texts(10_000), "▁ ▁ a", "a ▁▁  b", "x" * 5000, " " * 300, "ab" * 2000 + "é" * 100]:
        ids, lo, hi = own.encode(t)
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True), repr(t)
        data = t.encode()
        assert b"".join(data[a:b] for a, b in zip(lo[1:-1], hi[1:-1])) == data


def made_model(squeeze, dummy, user):
    """A byte-pair model by hand, with the compiled map of compatibility forms that the library has."""
    base = pb.ModelProto()
    base.ParseFromString(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    out = pb.ModelProto()
    out.normalizer_spec.CopyFrom(base.normalizer_spec)
    out.normalizer_spec.remove_extra_whitespaces, out.normalizer_spec.add_dummy_prefix, out.normalizer_spec.escape_whitespaces = squeeze, dummy, True
    out.trainer_spec.model_type, out.trainer_spec.byte_fallback = out.trainer_spec.BPE, True
    kind = pb.ModelProto.SentencePiece
    rows = [("<unk>", 0, kind.UNKNOWN), ("<s>", 0, kind.CONTROL), ("</s>", 0, kind.CONTROL)] + [(f"<0x{b:02X}>", 0, kind.BYTE) for b in range(256)] + [(u, 0, kind.USER_DEFINED) for u in user]
    plain = ["▁a", "ab", "fi", "▁fi", "▁th", "the", "▁the", "日本", "A1", "aaa", "▁▁", "▁▁▁", *dict.fromkeys("▁abfithe日本A12é")]
    for piece, score, k in rows + [(p, -i, kind.NORMAL) for i, p in enumerate(plain) if p not in user]:
        p = out.pieces.add()
        p.piece, p.score, p.type = piece, score, k
    return out.SerializeToString()


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
@pytest.mark.parametrize("user", [(), ("<x>", "ab")])
def test_models_with_a_character_map(squeeze, dummy, user):
    model = made_model(squeeze, dummy, user)
    lib, own = spm.SentencePieceProcessor(model_proto=model), codec.Codec(model)
    assert own.own and own.normalizer.map.units
    for t in texts(1500, 7):
        ids, lo, hi = own.encode(t)
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True), repr(t)
        assert own.normalize(t.encode())[0] == lib.normalize(t)
        assert (lo <= hi).all() and (lo[1:] >= lo[:-1]).all() and hi.max() <= len(t.encode())


def test_spans_point_at_the_source_of_mapped_characters():
    own = codec.Codec(made_model(False, False, ()))
    ids, lo, hi = own.encode("aｂﬁ日本")
    pieces = [(own.sp.id_to_piece(int(i)), "aｂﬁ日本".encode()[a:b].decode()) for i, a, b in zip(ids[1:-1], lo[1:-1], hi[1:-1])]
    assert pieces == [("ab", "aｂ"), ("fi", "ﬁ"), ("日本", "日本")]


def test_ids_beside_a_null_id_keep_their_digits(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a b", 7), (None, None, 8)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in codec.encode(df, keep=("doc_id", "n_tokens"), emit=("n_tokens",)).collect()}
    assert set(got) == {big, None} and got[None] == 2
